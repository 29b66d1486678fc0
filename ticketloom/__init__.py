"""Customer-support ticket analytics as composable PySpark DataFrame operators."""

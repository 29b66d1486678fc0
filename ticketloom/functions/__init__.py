"""Column expressions: parsing, normalising, labels and money."""

"""Sinks: CSV with a fixed column order, JSON documents, and landed tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_csv(frame: DataFrame, path: str, columns: list[str]) -> None:
    """Folder of CSV files with exactly ``columns``; other columns are left out."""
    (frame.select(*columns).write.mode("overwrite").option("header", True).option("quote", '"')
     .option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("emptyValue", "").option("nullValue", "").csv(path))


def write_documents(documents: DataFrame, path: str, column: str = "document") -> None:
    """One JSON document per line."""
    documents.select(column).write.mode("overwrite").text(path)


def write_lines(rows: DataFrame, path: str, order: list[str]) -> None:
    """A document of any size as shards of JSON lines, one line per field or list item, without NULL fields.

    Part files follow each other in ``order``, and the lines inside each: read by name they are the whole document.
    """
    lines = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    lines.select(F.to_json(F.struct(*rows.columns))).write.mode("overwrite").text(path)


def write_rows_json(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def land(frame: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a Parquet table and return it as read back, with the types of ``frame``.

    Used for numbered exports and canonical tickets that several reports read; partitioning by
    week lets a single week be read alone.
    """
    writer = frame.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)

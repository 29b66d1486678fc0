"""CSV and JSON readers. Every cell is read as text and trimmed; NULL becomes ''."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import scale, schemas as S
from ..functions import clean as C


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, position: bool = False) -> DataFrame:
    """CSV with a header, double-quote escapes and line breaks inside quoted cells.

    With line breaks in cells a file is one task, so large exports should be many files. All files must
    have the same header: one that names other columns, or the same in another order, fails when it is
    read. ``columns`` names the expected columns by header; ones the files lack come back empty.
    ``position`` adds ``_file`` and ``_place``: where a row comes from, for ``with_sequence``.
    """
    reader = (
        spark.read.option("header", True).option("multiLine", True).option("quote", '"')
        .option("escape", '"').option("encoding", "UTF-8")
    )
    # The header of one file declares the columns; every other header is checked against it.
    names = reader.option("inferSchema", False).csv(path).columns
    table = reader.option("enforceSchema", False).schema(S.text_schema(names)).csv(path)
    wanted, have = columns or names, set(names)
    cells = [C.strip(F.col(f"`{c}`")).alias(c) if c in have else F.lit("").alias(c) for c in wanted]
    if position:
        cells += [F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_place")]
    return table.select(*cells)


def with_sequence(rows: DataFrame, name: str = "raw_seq", start: int = 0,
                  max_broadcast_rows: int = scale.MAX_BROADCAST_ROWS) -> DataFrame:
    """Number the rows of ``read_csv(..., position=True)`` in read order.

    Files follow each other by path and rows by their place in the file, however Spark deals files to
    tasks: the high bits are the file's rank, the low 40 bits count the rows from the file's first. All numbers
    are moved up by ``start``. The files are parsed once; their list is ranked over range partitions, and
    broadcast only when it is counted within the bound.
    """
    rows = scale.settle(rows)
    # A file is never split, so its rows have consecutive places.
    files = rows.groupBy("_file").agg(F.min("_place").alias("_start"))
    ranked = scale.settle(scale.numbered(files, [F.col("_file").asc()], "_rank"))
    return scale.lookup(rows, ranked, ["_file"], ["_place"], "inner", max_broadcast_rows).withColumn(
        name, F.lit(start) + F.shiftleft(F.col("_rank").cast("long"), 40) + F.col("_place") - F.col("_start")
    ).drop("_file", "_place", "_start", "_rank")


def row_key(ticket_id="ticket_id", source="source_system", seq="raw_seq"):
    """Audit key of a raw row."""
    return F.concat_ws("__", ticket_id, source, F.col(seq).cast("string"))


def read_tickets(spark: SparkSession, path: str, seq_column: str | None = None, start: int = 0) -> DataFrame:
    """Ticket export with ``raw_seq`` and ``stable_row_key``.

    ``seq_column`` names a position column of the export; without one the read order counts, from ``start``
    on. An export that is merged into an earlier one starts behind it.
    """
    if seq_column:
        rows = read_csv(spark, path, [*S.TICKET_COLUMNS, seq_column]).withColumn(
            "raw_seq", F.col(seq_column).cast("long"))
        rows = rows.drop(seq_column) if seq_column != "raw_seq" else rows
    else:
        rows = with_sequence(read_csv(spark, path, S.TICKET_COLUMNS, position=True), start=start)
    return rows.withColumn("stable_row_key", row_key())


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    return with_sequence(read_csv(spark, path, S.ROSTER_COLUMNS, position=True), "roster_seq")


def read_sample(spark: SparkSession, path: str) -> DataFrame:
    """Labelled review sample; columns that the files lack come back empty."""
    return read_csv(spark, path, S.SAMPLE_COLUMNS)


def family_map(products: DataFrame, sku: str = "sku", family: str = "family",
               seq: str | None = None) -> DataFrame:
    """sku -> family with one row per sku; the last row of a repeated sku counts."""
    rows = products if seq else products.withColumn("_seq", F.monotonically_increasing_id())
    return rows.groupBy(C.strip(F.col(sku).cast("string")).alias("sku")).agg(
        F.max_by(C.strip(family), F.col(seq or "_seq")).alias("family"))


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """Themes of a taxonomy document as (position, name, definition) rows."""
    doc = spark.read.schema(S.TAXONOMY_SCHEMA).option("multiLine", True).json(path)
    return doc.select("version", F.posexplode("themes").alias("position", "t")).select(
        "version", "position", F.col("t.name").alias("name"), F.col("t.definition").alias("definition"))


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of a document written by ``writers.write_lines``."""
    return spark.read.schema(schema).json(path)


def optional(read, *args, **kw) -> DataFrame | None:
    """A reference table, or None when it cannot be read, so that checks on it give NULL."""
    from pyspark.errors import AnalysisException
    try:
        return read(*args, **kw)
    except AnalysisException:
        return None

"""Helpers for joins and ordered scans when one key may hold a large part of all rows."""
from __future__ import annotations

import math
import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

# A broadcast side never has more rows than this; beyond it the join shuffles.
MAX_BROADCAST_ROWS = 200_000
# A key counts as hot when it holds more rows than this and more than a quarter of a task's even share.
LEAST_HOT_ROWS = 100_000


def row_count_within(df: DataFrame, limit: int) -> int:
    """Row count of ``df``, counting no further than ``limit + 1``."""
    return df.select(F.lit(1)).limit(limit + 1).count()


def lookup(facts: DataFrame, dim: DataFrame, keys: list[str], spread: list[str],
           how: str = "left", max_broadcast_rows: int = MAX_BROADCAST_ROWS,
           dim_rows: int | None = None) -> DataFrame:
    """Join ``facts`` to a stored dimension that has at most one row per key.

    A dimension counted at or under ``max_broadcast_rows`` is broadcast; a larger one goes
    through ``spread_join``. Pass ``dim_rows`` when the count is already known.
    """
    if dim_rows is None:
        dim_rows = row_count_within(dim, max_broadcast_rows)
    if dim_rows <= max_broadcast_rows:
        return facts.join(F.broadcast(dim), keys, how)
    return spread_join(facts, dim, keys, spread, how)


def hot_keys(facts: DataFrame, keys: list[str], least: int | None = None) -> DataFrame:
    """(keys, parts): keys of ``facts`` with many rows, and into how many parts each is to be cut.

    Rows are counted per key in partial sums, once. At most four keys per shuffle partition can be hot,
    so the result may be broadcast.
    """
    least = LEAST_HOT_ROWS if least is None else least
    counts = settle(facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    partitions = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bound = max(least, math.ceil(total / (4 * partitions)))
    return counts.where(F.col("_n") > bound).select(*keys, F.ceil(F.col("_n") / bound).cast("int").alias("_parts"))


def spread_join(facts: DataFrame, dim: DataFrame, keys: list[str], spread: list[str],
                how: str = "left", least: int | None = None) -> DataFrame:
    """Shuffle join in which hot keys of the facts are cut into parts, and only those.

    A fact of a hot key goes to the part that a hash of its ``spread`` columns names; the dim rows of
    that key are repeated once per part. All other rows of either side are joined as they are. Neither side is
    broadcast, however small the optimizer takes it for.
    """
    hot = F.broadcast(hot_keys(facts, keys, least))
    parts = F.coalesce("_parts", F.lit(1))
    salted = facts.join(hot, keys, "left").withColumn("_salt", F.pmod(F.hash(*spread), parts)).drop("_parts")
    repeated = dim.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return salted.join(repeated.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def previous_row(df: DataFrame, group: str, buckets: list[Column], order: list[str],
                 payload: list[str], out: str, hot: DataFrame | None = None) -> DataFrame:
    """Add ``out``: a struct of the ``payload`` of the preceding row of the same group.

    ``buckets`` go from fine to coarse, and none may decrease along ``order``. Rows are compared inside
    (group, all buckets) first; the first and last row of each bucket meet again without the finest
    level, and so on up to the group. The widest task is one finest bucket, or two rows for each bucket
    inside the next one, never a whole group. The levels read one shuffle: the payload travels as one
    struct, so that none prunes it differently.

    Where most buckets hold one row, nearly all rows go through every level. ``hot``, the groups with many rows
    (``hot_keys``), limits that to them; all others are compared in one window, after one shuffle.
    """
    if hot is not None:
        named = F.broadcast(hot.select(F.col(group).alias("_hot")))
        is_hot = F.col(group).eqNullSafe(F.col("_hot"))
        many = previous_row(df.join(named, is_hot, "left_semi"), group, buckets, order, payload, out)
        w = W.partitionBy(group).orderBy(*order)
        few = df.join(named, is_hot, "left_anti").withColumn(out, F.lag(F.struct(*payload)).over(w))
        return few.select(many.columns).unionByName(many)
    rest = [c for c in df.columns if c not in payload]
    names = [f"_bucket{i}" for i in range(len(buckets))]
    rows = df.select(*rest, *[b.alias(n) for b, n in zip(buckets, names)], F.struct(*payload).alias("_row"))
    done = None
    for level in range(len(names) + 1):
        keys = [group, *reversed(names[level:])]
        w = W.partitionBy(*keys).orderBy(*names[:level][::-1], *order)
        back = F.lag("_row").over(w)
        marked = rows.withColumn("_back", back if level == 0 else F.when(F.col("_first"), back).otherwise(F.col("_back")))
        marked = marked.withColumn("_first", F.row_number().over(w) == 1).withColumn("_last", F.lead(F.lit(True)).over(w).isNull())
        if level == len(names):
            closed = marked
        else:
            closed, rows = marked.where(~(F.col("_first") | F.col("_last"))), marked.where(F.col("_first") | F.col("_last"))
        closed = closed.select(*rest, "_row.*", F.col("_back").alias(out))
        done = closed if done is None else done.unionByName(closed)
    return done


def _placed(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` sorted over range partitions and settled; ``_at`` counts rows from the partition's number
    times 2**33 on."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return settle(ordered.withColumn("_at", F.monotonically_increasing_id()))


def numbered(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Add ``name``: the place of each row in ``order``, from 0 and without gaps.

    Range partitions are sorted side by side; one count per partition, summed up, moves each partition's
    places. Rows equal in all of ``order`` end up in one partition: add a column that tells them apart.
    """
    placed = _placed(df, order)
    part = F.shiftright("_at", 33).alias("_part")
    counts = placed.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition.
    starts = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_ahead"))
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(
        name, F.col("_ahead") + F.col("_at") % F.lit(1 << 33)).drop("_part", "_ahead", "_at")


def running_totals(df: DataFrame, group: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the same group in front of each row.

    ``group`` columns hold no NULL, and ``order`` sorts inside a group. A group may span many range
    partitions: sums per (group, partition) are added up, and a window runs only inside one partition's share.
    """
    placed = _placed(df, [*[F.col(c).asc() for c in group], *order]).withColumn("_part", F.shiftright("_at", 33))
    sums = settle(placed.groupBy(*group, "_part").agg(F.sum(value).alias("_sum")))
    starts = sums.select(*group, "_part", (F.sum("_sum").over(W.partitionBy(*group).orderBy("_part")) - F.col("_sum")).alias("_ahead"))
    inside = W.partitionBy(*group, "_part").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    return placed.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0))).join(starts, [*group, "_part"]).withColumn(
        name, F.col(name) + F.col("_ahead")).drop("_part", "_ahead", "_at")


def holding_nodes(place: Column, levels: int) -> Column:
    """Array of (level, node): the dyadic ranges, of 2 ** level places each, that hold ``place`` (from 0)."""
    return F.array(*[F.struct(F.lit(h).alias("level"), F.shiftright(place, h).alias("node")) for h in range(levels + 1)])


def covering_nodes(first: Column, behind: Column, levels: int) -> Column:
    """Array of (level, node): the fewest dyadic ranges that together are the places from ``first`` to before ``behind``.

    At most two per level. A place lies in the interval exactly when one of them is among its holding nodes,
    so that an interval join becomes an equality join without copies per place.
    """
    nodes = []
    for h in range(levels + 1):
        low, high = F.shiftright(first + ((1 << h) - 1), h), F.shiftright(behind, h)
        for odd, node in ((low, low), (high, high - 1)):
            nodes.append(F.when((low < high) & (odd % 2 == 1), F.struct(F.lit(h).alias("level"), node.alias("node"))))
    return F.array_compact(F.array(*nodes))


def shared_location(spark: SparkSession) -> str:
    """Folder that all executors reach: spark.checkpoint.dir; the warehouse when all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")


def spread_single_file(scan: DataFrame, key: str) -> DataFrame:
    """Deal the rows of a table that is one file over the shuffle partitions.

    A small export often is one file of one row group, which one core would read and parse. Tables
    of several files pass untouched, whatever their size.
    """
    return scan if len(scan.inputFiles()) > 1 else scan.repartition(key)


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, for a report that reads it several times.

    With a shared folder in spark.checkpoint.dir it becomes a table there, which survives lost executors
    and is pruned by each reader; otherwise it is kept in memory and on the executors' disks, and
    computed again where one is lost.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    path = f"{folder.rstrip('/')}/ticketloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def once(df: DataFrame, name: str, expression: Column) -> DataFrame:
    """Add an expensive column that is computed once per row.

    The optimizer copies a projected expression into every filter and column that reads it; it
    does not look through a generator, so later steps read the finished value.
    """
    return df.select("*", F.explode_outer(F.array(expression)).alias(name))

"""Dated roster lookup and the boards built on it."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .. import scale
from ..functions import clean as C
from ..functions.text import id_label
from ..policy import DEFAULT_POLICY, SupportPolicy
from .weekly import attendance

_ATTRS = ["name", "team", "shift", "site"]


def intervals(roster: DataFrame) -> DataFrame:
    """Roster with parsed dates and a position. A blank end is open."""
    out = roster.select(
        C.strip("agent_id").alias("agent_key"),
        *[C.strip(c).alias(c) for c in _ATTRS],
        C.parse_date("from_date").alias("valid_from"),
        C.parse_date("to_date").alias("valid_to"),
        "roster_seq",
    )
    return out


def resolve(frame: DataFrame, roster: DataFrame, agent: str, day: str,
            max_broadcast_rows: int = scale.MAX_BROADCAST_ROWS) -> DataFrame:
    """As-of lookup: add ``entry``, the roster row valid for the agent on the day, or NULL.

    Overlapping rows: the latest start wins, then the first roster row. A roster within
    ``max_broadcast_rows`` is packed into one short list per agent and broadcast, which needs no
    shuffle of the frame. A larger one is resolved once per distinct (agent, day) over dyadic ranges of days
    and looked up.
    """
    rows = intervals(roster).where(F.col("valid_from").isNotNull())
    if scale.row_count_within(rows, max_broadcast_rows) <= max_broadcast_rows:
        packed = rows.groupBy("agent_key").agg(F.sort_array(F.collect_list(F.struct(
            (-F.unix_date("valid_from")).alias("latest_first"), "roster_seq",
            "valid_from", "valid_to", *_ATTRS))).alias("_spans"))
        joined = frame.join(
            F.broadcast(packed.withColumnRenamed("agent_key", agent)), agent, "left")
        hit = F.get(F.filter("_spans", lambda s: (s["valid_from"] <= F.col(day)) & (
            s["valid_to"].isNull() | (F.col(day) <= s["valid_to"]))), F.lit(0))
        return joined.withColumn("entry", F.when(
            hit.isNotNull(), F.struct(*[hit[a].alias(a) for a in _ATTRS]))).drop("_spans")

    frame = scale.settle(frame)
    asked = scale.settle(frame.where(F.col(day).isNotNull()).select(agent, day).distinct())
    low, high = asked.agg(F.min(day), F.max(day)).first()
    if low is None:
        return frame.withColumn("entry", F.lit(None).cast(_entry_type(rows)))
    levels = ((high - low).days + 1).bit_length()
    start, end = F.greatest("valid_from", F.lit(low)), F.least(F.coalesce("valid_to", F.lit(high)), F.lit(high))
    # An interval is a few dyadic ranges of days; of all intervals on one range only the one that wins there is
    # kept, so a day meets at most one row per level, however many intervals the agent has.
    best = (
        rows.where(start <= end)
        .select(F.col("agent_key").alias(agent), F.struct("valid_from", (-F.col("roster_seq")).alias("early"), *_ATTRS).alias("_top"),
                F.inline(scale.covering_nodes(F.datediff(start, F.lit(low)), F.datediff(end, F.lit(low)) + 1, levels)))
        .groupBy(agent, "level", "node").agg(F.max("_top").alias("_top"))
    )
    days = asked.select(agent, day, F.inline(scale.holding_nodes(F.datediff(day, F.lit(low)), levels)))
    # The optimizer takes rows made by a generator for one each, and would broadcast millions of them.
    found = days.join(best.hint("merge"), [agent, "level", "node"]).groupBy(agent, day).agg(F.max("_top").alias("_top")).select(
        agent, day, F.struct(*[F.col(f"_top.{c}").alias(c) for c in _ATTRS]).alias("entry"))
    return scale.spread_join(frame, found, [agent, day], frame.columns, "left")


def _entry_type(rows: DataFrame) -> str:
    return "struct<" + ", ".join(f"{c}: {rows.schema[c].dataType.simpleString()}" for c in _ATTRS) + ">"


def asof(tickets: DataFrame, roster: DataFrame, **kw) -> DataFrame:
    """Attendance tickets with the roster row valid on the day they were resolved."""
    rows = attendance(tickets).select(
        "resolved_week", "ticket_id", "agent_key", "resolved_day", "first_seq")
    return resolve(rows, roster, "agent_key", "resolved_day", **kw)


def daily_attendance(tickets: DataFrame, roster: DataFrame, **kw) -> DataFrame:
    """Completed tickets per week, agent and day, resolved against the roster after counting."""
    counted = attendance(tickets).groupBy("resolved_week", "agent_key", "resolved_day").agg(
        F.count(F.lit(1)).alias("n"), F.min("first_seq").alias("seq"))
    return resolve(counted, roster, "agent_key", "resolved_day", **kw)


def boards(tickets: DataFrame, roster: DataFrame, policy: SupportPolicy = DEFAULT_POLICY,
           **kw) -> DataFrame:
    """Both boards. An agent who changes tier within a week appears once on each of them.

    Shown attributes are those of the agent's first matching ticket of the week.
    """
    days = daily_attendance(tickets, roster, **kw).where(F.col("entry").isNotNull())
    return (
        days.withColumn("is_tier1", F.col("entry.team").isin(*policy.tier1_teams))
        .groupBy("resolved_week", "is_tier1", F.col("agent_key").alias("agent_id"))
        .agg(F.sum("n").alias("tickets_completed"), F.min_by("entry", "seq").alias("shown"))
        .select("resolved_week", "is_tier1", "agent_id", F.col("shown.name").alias("agent_name"),
                F.col("shown.team").alias("team"), F.col("shown.shift").alias("shift"),
                F.col("shown.site").alias("site"), "tickets_completed")
    )


def ranked(board: DataFrame) -> DataFrame:
    """Board order per week: most completed first, then agent id."""
    order = W.partitionBy("resolved_week").orderBy(F.desc("tickets_completed"), "agent_id")
    return board.withColumn("rank", F.row_number().over(order))


def tier1_board(tickets: DataFrame, roster: DataFrame, policy: SupportPolicy = DEFAULT_POLICY,
                **kw) -> DataFrame:
    return ranked(boards(tickets, roster, policy, **kw).where("is_tier1").drop("is_tier1"))


def specialist_board(tickets: DataFrame, roster: DataFrame,
                     policy: SupportPolicy = DEFAULT_POLICY, **kw) -> DataFrame:
    return ranked(boards(tickets, roster, policy, **kw).where("not is_tier1").drop("is_tier1"))


def top_of_board(board: DataFrame, k: int = 15) -> DataFrame:
    return board.where(F.col("rank") <= k)


def unresolved(tickets: DataFrame, roster: DataFrame, **kw) -> DataFrame:
    """Attendance tickets without a valid roster row, one row each."""
    return asof(tickets, roster, **kw).where(F.col("entry").isNull()).select(
        "resolved_week", id_label("ticket_id", "agent_key").alias("unresolved"), "first_seq")


def reconciliation(tickets: DataFrame, roster: DataFrame,
                   policy: SupportPolicy = DEFAULT_POLICY, **kw) -> DataFrame:
    """The boards as shown, added up, and the tickets without an agent, against attendance per week."""
    zero = F.lit(0).cast("long")
    total = attendance(tickets).groupBy("resolved_week").agg(F.count(F.lit(1)).alias("attendance"))
    shown = scale.settle(boards(tickets, roster, policy, **kw))
    parts = [
        ranked(shown.where("is_tier1")).groupBy("resolved_week").agg(F.sum("tickets_completed").alias("board")),
        ranked(shown.where("not is_tier1")).groupBy("resolved_week").agg(F.sum("tickets_completed").alias("specialist")),
        unresolved(tickets, roster, **kw).groupBy("resolved_week").agg(F.count(F.lit(1)).alias("unresolved")),
    ]
    for part in parts:
        total = total.join(part, "resolved_week", "left")
    counts = total.select("resolved_week", "attendance", *[
        F.coalesce(c, zero).alias(c) for c in ("board", "specialist", "unresolved")])
    return counts.withColumn(
        "reconciles",
        F.col("board") + F.col("specialist") + F.col("unresolved") == F.col("attendance"))


# Days from the year 0 to the year 9999 are fewer than 2 ** DAY_LEVELS.
_DAY_ZERO, _DAY_LEVELS = "0000-01-01", 22


def _containing(regular: DataFrame, reversed_spans: DataFrame) -> DataFrame:
    """(agent_key, n): pairs of a reversed interval (lo, hi, m times) and a regular one (a, b, w times) that contains it.

    Contained means a <= hi and lo <= b. The first condition is a prefix of days, which dyadic ranges of starts make
    up; within a range a running count from the latest end down answers the second. No pair is formed, and a
    range has at most one row per day.
    """
    place = lambda c: F.datediff(c, F.lit(_DAY_ZERO).cast("date"))
    concerned = regular.join(reversed_spans.select("agent_key").distinct(), "agent_key", "left_semi")
    zero = F.lit(0).cast("long")
    ends = concerned.select("agent_key", F.col("b").alias("day"), F.col("w"), zero.alias("m"),
                            F.inline(scale.holding_nodes(place("a"), _DAY_LEVELS)))
    asked = reversed_spans.select("agent_key", F.col("lo").alias("day"), zero.alias("w"), F.col("m"),
                                  F.inline(scale.covering_nodes(F.lit(0), place("hi") + 1, _DAY_LEVELS)))
    per_day = ends.unionByName(asked).groupBy("agent_key", "level", "node", "day").agg(F.sum("w").alias("w"), F.sum("m").alias("m"))
    later = W.partitionBy("agent_key", "level", "node").orderBy(F.desc("day")).rowsBetween(W.unboundedPreceding, 0)
    return per_day.withColumn("reaching", F.sum("w").over(later)).groupBy("agent_key").agg(
        F.sum(F.col("m") * F.col("reaching")).alias("n"))


def overlaps(roster: DataFrame) -> DataFrame:
    """Overlapping interval pairs per agent, counted without forming the pairs.

    Two intervals are disjoint when one ends before the other starts. Starts and ends are
    counted per agent and day, and a running sum over the days gives the disjoint pairs; the
    rest of the k(k-1)/2 pairs overlap. Intervals that end before they start overlap exactly
    those regular ones that contain them, and are counted apart by ``_containing``.
    """
    spans = intervals(roster).select(
        "agent_key",
        F.coalesce("valid_from", F.lit("1900-01-01").cast("date")).alias("lo"),
        F.coalesce("valid_to", F.lit("9999-12-31").cast("date")).alias("hi"),
    )
    regular = spans.where("lo <= hi")
    events = regular.select("agent_key", F.explode(F.array(
        F.struct(F.col("lo").alias("day"), F.lit(1).alias("starts"), F.lit(0).alias("ends")),
        F.struct(F.col("hi").alias("day"), F.lit(0).alias("starts"), F.lit(1).alias("ends")),
    )).alias("e")).groupBy("agent_key", F.col("e.day").alias("day")).agg(
        F.sum("e.starts").alias("starts"), F.sum("e.ends").alias("ends"))
    before = W.partitionBy("agent_key").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    swept = events.withColumn("ended", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    pairs = swept.groupBy("agent_key").agg(
        F.sum("starts").alias("k"), F.sum(F.col("starts") * F.col("ended")).alias("apart")
    ).select("agent_key", F.expr("k * (k - 1) div 2 - apart").alias("n"))
    reversed_spans = spans.where("lo > hi").groupBy("agent_key", "lo", "hi").agg(
        F.count(F.lit(1)).alias("m"))
    grouped = regular.groupBy("agent_key", F.col("lo").alias("a"), F.col("hi").alias("b")).agg(
        F.count(F.lit(1)).alias("w"))
    inside = _containing(grouped, reversed_spans)
    return pairs.unionByName(inside).groupBy(F.col("agent_key").alias("agent_id")).agg(
        F.sum("n").alias("overlaps"))

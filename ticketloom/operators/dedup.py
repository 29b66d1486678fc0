"""One row per ticket id across source systems, and typed columns on top of it."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import clean as C
from ..policy import DEFAULT_POLICY, SupportPolicy


# A row that is not from the primary system comes after all that are.
_LATER = 1 << 62


def state(raw: DataFrame, primary: str = "helpdesk") -> DataFrame:
    """What is known of each ticket id: the cells of its best row, and three columns to go on with.

    ``order_key`` ranks the best row (primary system first, then arrival), ``first_seq`` is the position at which
    the id first appeared, ``copies`` counts its rows and ``other_system`` says whether they come from several.
    One aggregate finds all of it in one reading: rows are combined before the shuffle, so a ticket id with
    very many copies reaches its task as one row per input partition, and columns that no later step
    reads are not aggregated.
    """
    rank = F.col("raw_seq") + F.when(F.coalesce(F.col("source_system") == primary, F.lit(False)), 0).otherwise(_LATER)
    rows = raw.withColumns({"order_key": rank, "first_seq": F.col("raw_seq"), "copies": F.lit(1).cast("long"),
                            "low_system": F.col("source_system"), "high_system": F.col("source_system")})
    return _combined(rows)


def _combined(rows: DataFrame) -> DataFrame:
    kept = {"ticket_id", "order_key", "first_seq", "copies", "low_system", "high_system"}
    cells = [F.min_by(F.col(f"`{c}`"), "order_key").alias(c) for c in rows.columns if c not in kept]
    return rows.groupBy("ticket_id").agg(
        *cells, F.min("order_key").alias("order_key"), F.min("first_seq").alias("first_seq"), F.sum("copies").alias("copies"),
        F.min("low_system").alias("low_system"), F.max("high_system").alias("high_system"))


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """The state of two exports from the state of each; the same as that of both exports read at once.

    Positions of the exports must not overlap: number a later export from behind the earlier one's last row
    (``readers.read_tickets(..., start=...)``).
    """
    return _combined(old.unionByName(new))


def best_rows(known: DataFrame) -> DataFrame:
    """One row per ticket id of a state: the cells of its best row, first_seq, copies and other_system."""
    return known.withColumn("other_system", F.col("low_system") != F.col("high_system")).drop("order_key", "low_system", "high_system")


def canonical(raw: DataFrame, primary: str = "helpdesk") -> DataFrame:
    """Keep the first row of the primary system per ticket id, else the first row.

    Adds first_seq, copies and other_system, which cost nothing when no later step reads them.
    """
    return best_rows(state(raw, primary))


def quarantine(raw: DataFrame, primary: str = "helpdesk") -> DataFrame:
    """The copies that ``canonical`` leaves out.

    The winner of each id is found by an aggregate that combines before the shuffle; the rows
    are then matched on the unique ``raw_seq``, so no task holds all copies of one id.
    """
    winners = raw.groupBy("ticket_id").agg(
        F.coalesce(
            F.min(F.when(F.col("source_system") == primary, F.col("raw_seq"))), F.min("raw_seq")
        ).alias("raw_seq")
    )
    return raw.join(winners.select("raw_seq"), "raw_seq", "left_anti")


def typed(tickets: DataFrame, policy: SupportPolicy = DEFAULT_POLICY) -> DataFrame:
    """Add the parsed columns that the weekly figures use.

    Unused ones are pruned by the optimizer, so every caller can start here.
    """
    parsed = tickets.select(
        "*",
        C.parse_timestamp("created_at").alias("created_ts"),
        C.parse_timestamp("first_response_at").alias("first_response_ts"),
        C.parse_timestamp("resolved_at").alias("resolved_ts"),
        C.norm("channel").alias("channel_key"),
        C.norm("status").alias("status_key"),
        C.strip("agent_id").alias("agent_key"),
        C.strip("customer_id").alias("customer_key"),
        C.csat("csat_score").alias("csat"),
        C.to_number("transfers").alias("transfer_value"),
        C.to_number("refund_amount_inr").alias("refund_value"),
    )
    return parsed.select(
        "*",
        C.monday_of(F.to_date("created_ts")).alias("week_start"),
        F.to_date("resolved_ts").alias("resolved_day"),
        C.monday_of(F.to_date("resolved_ts")).alias("resolved_week"),
        F.col("status_key").isin(*policy.done_statuses).alias("is_done"),
        C.breach("created_ts", "first_response_ts", "channel_key", policy.sla_minutes).alias("sla_breach"),
    )

"""Repeat contacts: a customer's ticket against their ticket just before it."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import scale
from ..functions import clean as C
from ..policy import DEFAULT_POLICY, SupportPolicy

# Tickets of one moment are compared in blocks of 2 ** ARRIVAL_BITS arrivals.
ARRIVAL_BITS = 14
_CARRIED = ["ticket_id", "resolved_ts", "trusted", "order_key", "sku_key", "category_key"]


def _buckets() -> list[Column]:
    """Moment of creation with a block of arrivals, and day of creation.

    Dates without a time and bulk imports put very many tickets on one moment; these are divided by
    arrival. Undated tickets sort first and form one moment.
    """
    moment = F.coalesce(F.col("created_ts"), F.lit("0001-01-01").cast("timestamp_ntz"))
    block = F.shiftright("first_seq", ARRIVAL_BITS)
    return [F.struct(moment.alias("at"), block.alias("block")), F.coalesce(F.unix_date(F.to_date("created_ts")), F.lit(-(2**31)))]


def hot_customers(tickets: DataFrame) -> DataFrame:
    """Customers with too many tickets for one task. Reads the tickets once more: for those that are settled."""
    return scale.hot_keys(tickets, ["customer_key"])


def repeat_pairs(tickets: DataFrame, window_days: int = 30, drop_blank_keys: bool = False,
                 policy: SupportPolicy = DEFAULT_POLICY, hot: DataFrame | None = None) -> DataFrame:
    """Consecutive tickets of a customer, the later one created within ``window_days`` of the
    earlier one's resolution. All weeks at once; ``week_start`` is the later ticket's week.

    Blank customer ids count as one customer unless ``drop_blank_keys``. Blank orders never
    match; blank products and categories match each other.

    ``hot`` names the customers with very many tickets (``hot_customers``), and saves shuffles of all others' tickets.
    """
    rows = tickets.select(
        "ticket_id", "customer_key", "created_ts", "resolved_ts", "first_seq", "week_start",
        C.resolved_at_trusted("source_system", "resolved_at", policy.primary_system).alias("trusted"),
        C.strip("order_id").alias("order_key"), C.strip("product_sku").alias("sku_key"),
        C.strip("category").alias("category_key"), C.strip("channel").alias("repeat_channel"),
    )
    if drop_blank_keys:
        rows = rows.where("customer_key <> ''")
    chained = scale.previous_row(
        rows, "customer_key", _buckets(), ["created_ts", "first_seq"], _CARRIED, "prior", hot)
    gap = C.days_between("created_ts", "prior.resolved_ts")
    return (
        chained.withColumn("_gap", gap)
        .where(F.col("_gap").between(0, window_days))
        .select(
            "week_start",
            F.col("prior.ticket_id").alias("prior_ticket_id"),
            F.col("ticket_id").alias("repeat_ticket_id"),
            F.col("customer_key").alias("customer_id"),
            C.round_exact(F.col("_gap"), 2).alias("gap_days"),
            F.col("prior.trusted").alias("prior_trusted_gap"),
            ((F.col("order_key") != "") & (F.col("order_key") == F.col("prior.order_key")))
            .alias("same_order"),
            (F.col("sku_key") == F.col("prior.sku_key")).alias("same_product"),
            (F.col("category_key") == F.col("prior.category_key")).alias("same_category"),
            "repeat_channel",
            F.col("category_key").alias("repeat_category"),
        )
    )


def is_same_issue() -> Column:
    """Same product, and the same order or the same category."""
    return F.col("same_product") & (F.col("same_order") | F.col("same_category"))


def same_issue(pairs: DataFrame) -> DataFrame:
    return pairs.where(is_same_issue())


def weekly_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("week_start").agg(
        F.count(F.lit(1)).alias("repeat_candidates"),
        F.count_if(is_same_issue()).alias("repeat_same_issue"))

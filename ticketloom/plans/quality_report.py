"""The data-quality report: one row per check."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import scale
from ..functions import clean as C
from ..operators import quality as Q
from ..policy import DEFAULT_POLICY, SupportPolicy


_TEXTS = ("customer_message", "agent_notes")


def _without_texts(tickets: DataFrame) -> DataFrame:
    """Tickets written once, texts reduced to whether they are blank."""
    short = tickets.drop("priority", "assigned_team", "status", "created_at", "stable_row_key")
    for c in _TEXTS:
        short = short.withColumn(c, F.when(C.is_blank(c), F.lit("")).otherwise(F.lit("x")))
    return scale.settle(short)


def quality_report(raw: DataFrame, tickets: DataFrame, roster: DataFrame,
                   refs: dict[str, DataFrame | None] | None = None,
                   policy: SupportPolicy = DEFAULT_POLICY) -> DataFrame:
    """All checks as (check, scope, value). A reference table that is absent gives NULL.

    Canonical rows know how many copies they stand for; the raw rows are read again only where ``tickets``
    lack that.
    """
    known = "copies" in tickets.columns
    tickets = _without_texts(tickets)
    every = {c: None for c in ("order_id", "customer_id", "product_sku", "agent_id")} | (refs or {})
    crossed = Q.cross_ticket_orders(tickets).select("order_id").distinct().agg(
        F.count(F.lit(1)).alias("same_order_cross_ticket_pairs"))
    parts = [
        Q.as_rows(Q.repeated_ids(tickets) if known else Q.duplicates(raw)),
        Q.as_rows(Q.scalar_checks(tickets, policy=policy)),
        Q.as_rows(crossed),
        Q.as_rows(Q.overlap_total(roster)),
        Q.as_rows(Q.roster_unresolved(tickets, roster)),
        Q.orphans(tickets, every).select(
            F.concat(F.lit("orphan_"), "column").alias("check"), F.lit("all").alias("scope"),
            F.col("orphans").alias("value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def quality_document(report: DataFrame) -> DataFrame:
    """The report as one JSON document; it has a few dozen rows."""
    entries = F.sort_array(F.collect_list(F.struct(
        F.concat_ws(".", "check", F.when(F.col("scope") != "all", F.col("scope"))).alias("k"),
        F.col("value").alias("v"))))
    return report.agg(F.to_json(F.map_from_entries(entries), {"ignoreNullFields": "false"}).alias("document"))

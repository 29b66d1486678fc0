"""Data-quality checks. ``tickets`` is a canonical frame from ``dedup.typed``."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import scale
from ..functions import clean as C
from ..policy import DEFAULT_POLICY, SupportPolicy
from .roster import overlaps, resolve

_YES = "Y"


def _has_refund() -> Column:
    return ~C.is_blank("refund_amount_inr")


def _has_replacement() -> Column:
    return F.upper(C.strip("replacement_issued")) == _YES


def duplicates(raw: DataFrame) -> DataFrame:
    """Repeated ticket ids of the raw export: groups, surplus rows, cross-system groups."""
    return repeated_ids(raw.groupBy("ticket_id").agg(
        F.count(F.lit(1)).alias("copies"), (F.min("source_system") != F.max("source_system")).alias("other_system")))


def repeated_ids(tickets: DataFrame) -> DataFrame:
    """The same from canonical rows, which know how many copies they stand for."""
    per_id = tickets.select(F.col("copies").alias("n"), F.col("other_system").alias("crossed"))
    return per_id.agg(
        F.count_if(F.col("n") > 1).alias("duplicate_ticket_id_groups"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("duplicate_extra_rows"),
        F.count_if((F.col("n") > 1) & F.col("crossed")).alias("duplicate_cross_system_groups"))


def time_order(tickets: DataFrame, policy: SupportPolicy = DEFAULT_POLICY) -> DataFrame:
    """Resolved rows and resolutions before the first response, for the two known systems."""
    return (
        tickets.where(F.col("source_system").isin(policy.primary_system, policy.legacy_system)
                      & ~C.is_blank("resolved_at"))
        .groupBy("source_system")
        .agg(F.count(F.lit(1)).alias("n_resolved"),
             F.count_if(F.col("resolved_ts") < F.col("first_response_ts")).alias("violations"))
    )


def scalar_expressions(policy: SupportPolicy = DEFAULT_POLICY) -> dict[str, Column]:
    """All checks that one aggregate over the canonical rows can answer, by report name."""
    amount = F.col("refund_value")
    numeric = _has_refund() & amount.isNotNull()
    score = C.strip("csat_score")
    out = {}
    for system in (policy.primary_system, policy.legacy_system):
        resolved = (F.col("source_system") == system) & ~C.is_blank("resolved_at")
        out[f"resolved_rows:{system}"] = F.count_if(resolved)
        out[f"resolved_before_first:{system}"] = F.count_if(
            resolved & (F.col("resolved_ts") < F.col("first_response_ts")))
    out |= {
        "first_before_created": F.count_if(F.col("first_response_ts") < F.col("created_ts")),
        "status_timestamp_mismatch": F.count_if(F.col("is_done") != ~C.is_blank("resolved_at")),
        "refund_negative": F.count_if(numeric & (amount < 0) & ~F.isnan(amount)),
        "refund_no_code": F.count_if(numeric & C.is_blank("refund_reason_code")),
        "refund_non_numeric": F.count_if(_has_refund() & amount.isNull()),
        "same_ticket_refund_replacement": F.count_if(numeric & _has_replacement()),
        "csat_out_of_range": F.count_if(~score.isin("", "0") & F.col("csat").isNull()),
        "transfer_non_integral": F.count_if(
            ~C.is_blank("transfers")
            & ~F.coalesce(C.is_integral(F.col("transfer_value")), F.lit(False))),
        "blank_order_id": F.count_if(C.is_blank("order_id")),
        "blank_agent_id": F.count_if(C.is_blank("agent_id")),
        "blank_customer_id": F.count_if(C.is_blank("customer_id")),
        "blank_product_sku": F.count_if(C.is_blank("product_sku")),
        "empty_customer_message": F.count_if(C.is_blank("customer_message")),
        "empty_agent_notes": F.count_if(C.is_blank("agent_notes")),
        "invalid_created": F.count_if(F.col("created_ts").isNull()),
        "invalid_first_response": F.count_if(
            ~C.is_blank("first_response_at") & F.col("first_response_ts").isNull()),
        "canonical_rows": F.count(F.lit(1)),
    }
    return out


def scalar_checks(tickets: DataFrame, names: list[str] | None = None,
                  policy: SupportPolicy = DEFAULT_POLICY) -> DataFrame:
    """The chosen scalar checks (all by default) as one row, in one pass."""
    every = scalar_expressions(policy)
    chosen = names or list(every)
    return tickets.agg(*[every[n].alias(n) for n in chosen])


def as_rows(wide: DataFrame) -> DataFrame:
    """A one-row frame of checks as (check, scope, value) rows."""
    cells = [F.struct(F.lit(c.split(":")[0]).alias("check"),
                      F.lit(c.split(":")[1] if ":" in c else "all").alias("scope"),
                      F.col(f"`{c}`").cast("long").alias("value")) for c in wide.columns]
    return wide.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def same_ticket_conflicts(tickets: DataFrame) -> DataFrame:
    """Tickets with a numeric refund and a replacement."""
    return tickets.where(
        F.col("refund_value").isNotNull() & _has_replacement()).select("ticket_id", "first_seq")


def cross_ticket_orders(tickets: DataFrame) -> DataFrame:
    """Orders whose refund tickets and replacement tickets are different tickets.

    One row per order, role and ticket. The marked tickets are computed once. Per order two flags and two counts
    are enough to tell that the ticket sets are disjoint; they are combined before the shuffle, and the orders
    found come back to the marked tickets as a membership filter, which Spark broadcasts or divides by its
    measured size. No list of an order's tickets is built.
    """
    marked = scale.settle(tickets.select(
        C.strip("order_id").alias("order_id"), "ticket_id",
        _has_refund().alias("refund"), _has_replacement().alias("replacement"),
    ).where((F.col("order_id") != "") & (F.col("refund") | F.col("replacement"))))
    disjoint = marked.groupBy("order_id").agg(
        F.max("refund").alias("refunded"), F.max("replacement").alias("replaced"),
        F.count_if(F.col("refund") & F.col("replacement")).alias("both"),
    ).where("refunded and replaced and both = 0").select("order_id")
    return marked.join(disjoint, "order_id", "left_semi").select(
        "order_id",
        F.when(F.col("refund"), F.lit("refund")).otherwise(F.lit("replacement")).alias("role"),
        "ticket_id")


def roster_unresolved(tickets: DataFrame, roster: DataFrame, **kw) -> DataFrame:
    """Tickets without a valid roster row: any row (created day as fallback), and attendance."""
    day = F.coalesce("resolved_day", F.to_date("created_ts"))
    done, dated = F.col("is_done"), F.col("resolved_day").isNotNull()
    grouped = tickets.groupBy("agent_key", day.alias("day")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(done & dated).alias("attended"),
        F.count_if(done & ~dated).alias("undated"))
    missing = F.col("entry").isNull()
    return resolve(grouped, roster, "agent_key", "day", **kw).agg(
        F.coalesce(F.sum(F.when(missing, F.col("n"))), F.lit(0)).alias("roster_unresolved_any_row"),
        F.coalesce(F.sum(F.when(missing, F.col("attended")).otherwise(0) + F.col("undated")), F.lit(0))
        .alias("roster_unresolved_attendance"))


def orphans(tickets: DataFrame, refs: dict[str, DataFrame | None]) -> DataFrame:
    """Non-blank keys without a row in their reference table, per key column.

    ``refs`` maps a ticket column to a one-column frame of known keys, or None when the table is
    absent, which gives NULL. Tickets are counted per key before the join, so a very frequent
    key is one row there.
    """
    spark = tickets.sparkSession
    present = [c for c, r in refs.items() if r is not None]
    absent = [c for c, r in refs.items() if r is None]
    zero = spark.createDataFrame([(c, 0) for c in present], "column string, n long") if present else None
    parts = []
    if present:
        counted = (
            tickets.select(F.explode(F.array(*[
                F.struct(F.lit(c).alias("column"), C.strip(c).alias("key")) for c in present])).alias("k"))
            .select("k.*").where("key <> ''")
            .groupBy("column", "key").agg(F.count(F.lit(1)).alias("n"))
        )
        known = None
        for c in present:
            keys = refs[c].select(F.lit(c).alias("column"), C.strip(refs[c].columns[0]).alias("key"))
            known = keys if known is None else known.unionByName(keys)
        lost = counted.join(known, ["column", "key"], "left_anti").select("column", "n")
        parts.append(lost.unionByName(zero).groupBy("column").agg(F.sum("n").alias("orphans")))
    if absent:
        parts.append(spark.createDataFrame([(c, None) for c in absent], "column string, orphans long"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def key_set(table: DataFrame, column: str) -> DataFrame:
    """Distinct trimmed non-NULL keys of a reference table."""
    return table.where(F.col(column).isNotNull()).select(
        C.strip(F.col(column).cast("string")).alias("key")).distinct()


def overlap_total(roster: DataFrame) -> DataFrame:
    return overlaps(roster).agg(F.coalesce(F.sum("overlaps"), F.lit(0)).alias("roster_overlaps"))

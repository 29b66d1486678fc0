"""Review samples with exact quotas, reproducible from a seed."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import clean as C
from ..functions.text import excerpt, pair_method
from ..schemas import SAMPLE_COLUMNS
from .quality import cross_ticket_orders, same_ticket_conflicts
from .repeat import is_same_issue


def draw_key(seed: int, *ids: str) -> Column:
    """Pseudo-random order that depends only on the ids and the seed."""
    return F.md5(F.concat_ws(":", *[F.col(i) for i in ids], F.lit(str(seed))))


def stratified(df: DataFrame, strata: list[str], quota: int, seed: int, ids: list[str]) -> DataFrame:
    """Exactly ``quota`` rows per stratum, or all of a smaller one."""
    order = W.partitionBy(*strata).orderBy(draw_key(seed, *ids), *ids)
    return df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= quota).drop("_r")


def theme_picks(assigned: DataFrame, disagreeing: DataFrame, seed: int = 42,
                taxonomy_quota: int = 2, rule_quota: int = 1, hard_quota: int = 1) -> DataFrame:
    """(ticket_id, theme, method): per theme some by category, by rule, and one hard case.

    Hard cases are unclassified tickets and those whose category and keywords disagree, less
    what was already picked.
    """
    pool = assigned.select("ticket_id", "theme", "method")
    taxonomy = stratified(pool.where("method = 'taxonomy'"), ["theme"], taxonomy_quota, seed, ["ticket_id"])
    rule = stratified(pool.where("method = 'rule'"), ["theme"], rule_quota, seed, ["ticket_id"])
    picked = taxonomy.unionByName(rule)
    hard_ids = disagreeing.select("ticket_id")
    hard = (
        pool.where("method = 'rule-fallback'")
        .unionByName(pool.where("method <> 'rule-fallback'").join(hard_ids, "ticket_id", "left_semi"))
        .join(picked.select("ticket_id"), "ticket_id", "left_anti")
    )
    return picked.unionByName(stratified(hard, ["theme"], hard_quota, seed, ["ticket_id"]))


def _review(rows: DataFrame) -> DataFrame:
    return rows.select(*[
        F.col(c) if c in rows.columns else F.lit("").alias(c) for c in SAMPLE_COLUMNS])


def theme_items(tickets: DataFrame, picks: DataFrame) -> DataFrame:
    """Review rows of the theme picks. The picks are a few rows per theme."""
    return _review(
        tickets.select("ticket_id", "channel", "source_system", "customer_message", "agent_notes")
        .join(F.broadcast(picks), "ticket_id")
        .withColumn("item_id", F.concat(F.lit("TH-"), "ticket_id"))
        .withColumn("stratum", F.lit("theme"))
        .withColumn("predicted", F.col("theme"))
        .withColumn("text", excerpt("customer_message", "agent_notes")))


def pair_picks(pairs: DataFrame, quota: int = 15, seed: int = 42) -> DataFrame:
    """``quota`` pairs that pass the same-issue test and ``quota`` that fail it."""
    flagged = pairs.withColumn("predicted", F.when(is_same_issue(), F.lit("same-issue"))
                               .otherwise(F.lit("not-same-issue")))
    return stratified(flagged, ["predicted"], quota, seed, ["repeat_ticket_id", "prior_ticket_id"])


def pair_items(tickets: DataFrame, picks: DataFrame) -> DataFrame:
    """Review rows of the picked pairs with both texts. There are twice the quota of picks."""
    texts = tickets.select("ticket_id", "channel", "source_system",
                           excerpt("customer_message", "agent_notes", 250).alias("_text"))
    later = texts.join(
        F.broadcast(picks.withColumnRenamed("repeat_ticket_id", "ticket_id")), "ticket_id")
    earlier = texts.select(F.col("ticket_id").alias("prior_ticket_id"), F.col("_text").alias("_prior")).join(
        F.broadcast(picks.select("prior_ticket_id").distinct()), "prior_ticket_id")
    return _review(
        later.join(earlier, "prior_ticket_id")
        .withColumn("item_id", F.concat(F.lit("RP-"), "ticket_id"))
        .withColumn("stratum", F.lit("repeat"))
        .withColumn("pair_id", F.col("prior_ticket_id"))
        .withColumn("method", pair_method())
        .withColumn("text", F.concat(F.lit("PRIOR["), "prior_ticket_id", F.lit("]: "), "_prior",
                                     F.lit(" || REPEAT: "), "_text")))


def refund_picks(tickets: DataFrame, conflicts: int = 4, orders: int = 4) -> DataFrame:
    """(ticket_id, pair_id, method): the first conflicts by ticket id, and every ticket of the
    first cross-ticket orders with the order as ``pair_id``. Needs no texts."""
    same = same_ticket_conflicts(tickets).select("ticket_id").orderBy("ticket_id").limit(conflicts)
    crossed = cross_ticket_orders(tickets)
    first = crossed.select("order_id").distinct().orderBy("order_id").limit(orders)
    return same.select("ticket_id", F.lit("").alias("pair_id"), F.lit("same-ticket").alias("method")).unionByName(
        crossed.join(F.broadcast(first), "order_id").select(
            "ticket_id", F.col("order_id").alias("pair_id"), F.lit("cross-ticket").alias("method")))


def refund_items(tickets: DataFrame, picks: DataFrame) -> DataFrame:
    """Review rows of the refund picks: one per conflict and one per cross-ticket order.

    The tickets of an order are rows of ``refund_item_tickets``, since an order's list has no bound.
    """
    conflict = F.concat(
        F.lit("conflict refund="), C.strip("refund_amount_inr"), F.lit(" replacement="),
        C.strip("replacement_issued"), F.lit(" order="), C.strip("order_id"))
    alone = (
        tickets.join(picks.where("method = 'same-ticket'"), "ticket_id")
        .withColumn("item_id", F.concat(F.lit("RF-"), "ticket_id"))
        .withColumn("predicted", conflict)
        .withColumn("text", excerpt("customer_message", "agent_notes")))
    orders = picks.where("method = 'cross-ticket'").groupBy("pair_id", "method").agg(
        F.concat(F.count(F.lit(1)).cast("string"), F.lit(" tickets")).alias("text")).select(
        "pair_id", "method", "text", F.concat(F.lit("RF-"), "pair_id").alias("item_id"),
        F.concat(F.lit("same-order co-occurrence order="), "pair_id").alias("predicted"))
    return _review(alone.withColumn("stratum", F.lit("refund"))).unionByName(
        _review(orders.withColumn("stratum", F.lit("refund"))))


def refund_item_tickets(tickets: DataFrame, picks: DataFrame) -> DataFrame:
    """(item_id, ticket_id, text): the tickets behind each item of a cross-ticket order."""
    return tickets.join(picks.where("method = 'cross-ticket'"), "ticket_id").select(
        F.concat(F.lit("RF-"), "pair_id").alias("item_id"), "ticket_id",
        excerpt("customer_message", "agent_notes", 180).alias("text"))


def stratum_sizes(sample: DataFrame) -> DataFrame:
    return sample.groupBy("stratum").agg(F.count(F.lit(1)).alias("items"))

"""Weekly figures for all weeks in one pass. Inputs are frames from ``dedup.typed``.

Figures count by created week; attendance counts by resolved week.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import clean as C
from ..functions.money import contact_rate
from ..policy import DEFAULT_POLICY, SupportPolicy


def created_in_week(tickets: DataFrame, week_start: str) -> DataFrame:
    """Tickets created in the seven days from ``week_start``."""
    return tickets.where(C.in_week("created_ts", week_start))


def dated(tickets: DataFrame) -> DataFrame:
    return tickets.where(F.col("week_start").isNotNull())


def attendance(tickets: DataFrame) -> DataFrame:
    """Resolved or closed tickets, by the week they were resolved in."""
    return tickets.where(F.col("is_done") & F.col("resolved_week").isNotNull())


def breach_count() -> Column:
    return F.count_if(F.coalesce("sla_breach", F.lit(False)))


def missing_count() -> Column:
    return F.count_if(F.col("sla_breach").isNull())


def transfer_sum() -> Column:
    """Sum of whole transfer counts; fractions are data errors and stay out."""
    whole = F.when(C.is_integral(F.col("transfer_value")), F.col("transfer_value").cast("long"))
    return F.coalesce(F.sum(whole), F.lit(0))


def csat_aggregates() -> list[Column]:
    answered = F.count("csat")
    return [
        answered.alias("csat_n"),
        C.share(answered, F.count(F.lit(1))).alias("response_rate_pct"),
        C.round_exact(F.avg("csat"), 3).alias("csat_mean"),
    ]


def volume(tickets: DataFrame) -> DataFrame:
    return dated(tickets).groupBy("week_start").agg(F.count(F.lit(1)).alias("volume"))


def mix(tickets: DataFrame, key: str, name: str) -> DataFrame:
    """Count and share of the week for each value of ``key``."""
    counts = dated(tickets).groupBy("week_start", F.col(key).alias(name)).agg(
        F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy("week_start"))
    return counts.withColumn("pct", C.share(F.col("n"), total))


def channel_mix(tickets: DataFrame) -> DataFrame:
    return mix(tickets, "channel_key", "channel")


def status_mix(tickets: DataFrame) -> DataFrame:
    return mix(tickets, "status_key", "status")


def sla_breaches(tickets: DataFrame) -> DataFrame:
    """Breaches per week and channel; channels without one are absent."""
    return (
        dated(tickets).where("sla_breach")
        .groupBy("week_start", F.col("channel_key").alias("channel"))
        .agg(F.count(F.lit(1)).alias("breaches"))
    )


def sla_missing(tickets: DataFrame) -> DataFrame:
    return dated(tickets).groupBy("week_start").agg(missing_count().alias("sla_missing"))


def csat_stats(tickets: DataFrame) -> DataFrame:
    return dated(tickets).groupBy("week_start").agg(*csat_aggregates())


def transfer_count(tickets: DataFrame) -> DataFrame:
    return dated(tickets).groupBy("week_start").agg(transfer_sum().alias("transfers"))


def contact_cost(tickets: DataFrame, policy: SupportPolicy = DEFAULT_POLICY) -> DataFrame:
    """Cost per week and channel; the row with a NULL channel is the week's total."""
    per_channel = dated(tickets).groupBy(
        "week_start", F.col("channel_key").alias("channel")
    ).agg(F.sum(contact_rate("channel_key", policy)).alias("cost"))
    # The total rolls up the few channel rows, not the tickets.
    return (
        per_channel.rollup("week_start", "channel").agg(F.sum("cost").alias("cost_inr"))
        .where(F.col("week_start").isNotNull())
    )


def transfer_cost(tickets: DataFrame, policy: SupportPolicy = DEFAULT_POLICY) -> DataFrame:
    return transfer_count(tickets).select(
        "week_start", (F.col("transfers") * policy.transfer_rate).alias("transfer_cost_inr"))


def sla_credit(tickets: DataFrame, policy: SupportPolicy = DEFAULT_POLICY) -> DataFrame:
    return dated(tickets).groupBy("week_start").agg(
        (breach_count() * policy.sla_credit).alias("sla_credit_inr"))


def conflict_count() -> Column:
    """Tickets of the week that carry both a refund amount and a replacement."""
    return F.count_if(~C.is_blank("refund_amount_inr")
                      & (F.upper(C.strip("replacement_issued")) == "Y"))


def created_week_figures(tickets: DataFrame, policy: SupportPolicy = DEFAULT_POLICY) -> DataFrame:
    """All created-week figures of a week in one aggregate."""
    return dated(tickets).groupBy("week_start").agg(
        F.count(F.lit(1)).alias("volume"),
        breach_count().alias("sla_breaches"),
        missing_count().alias("sla_missing"),
        *csat_aggregates(),
        F.sum(contact_rate("channel_key", policy)).alias("contact_cost_inr"),
        transfer_sum().alias("transfers"),
        (transfer_sum() * policy.transfer_rate).alias("transfer_cost_inr"),
        (breach_count() * policy.sla_credit).alias("sla_credit_inr"),
        F.count_if(F.coalesce("sla_breach", F.lit(False)) & (F.col("channel_key") == "email"))
        .alias("email_breaches"),
        conflict_count().alias("conflicts"),
    )

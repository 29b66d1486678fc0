"""One week out of a landed ticket table, read by partition.

Tickets are landed by the week they were created in and the week they were resolved in. A week's figures
need the tickets created in it and in the week before, its boards those resolved in it, and its repeat contacts
the tickets of the same customers just before. All of it is named by the two partition columns.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from .. import scale
from ..policy import DEFAULT_POLICY, DEFAULT_RULES, SupportPolicy, ThemeRules
from . import digest as G

WEEKS = ["week_start", "resolved_week"]
# Days in which a further contact of a customer is a repeat, unless told otherwise.
WINDOW_DAYS = 30


def land_by_week(tickets: DataFrame, path: str) -> DataFrame:
    """Write typed tickets by created and resolved week; returns the table.

    Rows of a week meet in as many tasks as their bytes ask for: small weeks share one, large ones are divided.
    """
    from ..sources.writers import land
    return land(tickets.hint("rebalance", *WEEKS), path, WEEKS)


def monday(week: str) -> dt.date:
    day = dt.date.fromisoformat(week)
    return day - dt.timedelta(days=day.weekday())


def _date(day: dt.date):
    return F.lit(day).cast("date")


def with_priors(table: DataFrame, week: str, window_days: int = WINDOW_DAYS) -> DataFrame:
    """Tickets that decide the repeat contacts of a week: those created in it, those created up to the
    window and a week before, and older ones of the customers that need them.

    A customer's ticket before the first one of the look-back can only make a pair when some older ticket of
    theirs was resolved inside the window. Such customers are found in the partitions resolved there; older tickets
    are read for them alone, from the week of the first candidate on, since a later one may stand between.
    """
    start = monday(week)
    low = start - dt.timedelta(days=7 * (window_days // 7 + 2))
    since = monday((start - dt.timedelta(days=window_days)).isoformat())
    recent = table.where(F.col("week_start").between(_date(low), _date(start)))
    first = recent.groupBy("customer_key").agg(F.min("week_start").alias("first"), F.max("week_start").alias("last"))
    open_ended = first.where((F.col("first") == _date(start)) & (F.col("last") == _date(start))).select("customer_key")
    older = F.col("week_start").isNull() | (F.col("week_start") < _date(low))
    late = table.where(older & F.col("resolved_week").between(_date(since), _date(start)))
    needed = scale.settle(late.join(open_ended, "customer_key", "left_semi").groupBy("customer_key").agg(
        F.min("week_start").alias("first"), F.count_if(F.col("week_start").isNull()).alias("undated")))
    found = needed.agg(F.min("first"), F.sum("undated")).first()
    if found[0] is None and not found[1]:
        return recent
    # An undated ticket comes before all dated ones: then every older week may hold the one between.
    reach = older if found[1] else (F.col("week_start") >= _date(found[0])) & (F.col("week_start") < _date(low))
    return recent.unionByName(table.where(reach).join(needed.select("customer_key"), "customer_key", "left_semi"))


def week_slice(table: DataFrame, week: str, window_days: int = WINDOW_DAYS) -> DataFrame:
    """The tickets that the figures, boards, themes and pairs of one week are made of, each once.

    The result of any report over it is right for that week alone; take it with ``digest.for_week``.
    """
    start = monday(week)
    pairs = with_priors(table, week, window_days)
    low = start - dt.timedelta(days=7 * (window_days // 7 + 2))
    created = F.coalesce(F.col("week_start").between(_date(low), _date(start)), F.lit(False))
    # Older tickets of the pairs come without those resolved in the week, which are read here.
    resolved = F.coalesce(F.col("resolved_week") == _date(start), F.lit(False))
    return pairs.where(created | ~resolved).unionByName(table.where(resolved & ~created))


def kpi_record(table: DataFrame, roster: DataFrame, week: str, policy: SupportPolicy = DEFAULT_POLICY) -> DataFrame:
    """The KPI record of one week of a landed table."""
    return G.for_week(G.kpi_record(week_slice(table, week), roster, policy), week)


def digest(table: DataFrame, roster: DataFrame, week: str, policy: SupportPolicy = DEFAULT_POLICY,
           rules: ThemeRules = DEFAULT_RULES, top: int = 15) -> DataFrame:
    """The digest of one week of a landed table, beside the previous week's counts."""
    return G.for_week(G.digest_rows(week_slice(table, week), roster, policy, rules, top), week)

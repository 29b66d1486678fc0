"""The weekly digest: theme sections, watches, actions, KPI record and report rows.

Everything is computed for all weeks; select a week at the end with ``for_week``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from .. import scale
from ..functions import clean as C
from ..operators import roster as R, themes as TH, weekly as K
from ..operators.repeat import hot_customers, repeat_pairs, weekly_pairs
from ..policy import (
    DEFAULT_POLICY, DEFAULT_RULES, EMAIL_TAIL_TRIGGER, OTHER_GROWTH_TRIGGER_PP,
    OTHER_SHARE_TRIGGER_PCT, OTHER_THEME, REPEAT_TRIGGER, SPIKE_TRIGGER, SupportPolicy, ThemeRules,
)


# Columns of a typed ticket frame that the figures, pairs and boards read; no texts.
FIGURE_COLUMNS = [
    "ticket_id", "first_seq", "week_start", "created_ts", "first_response_ts", "resolved_ts",
    "resolved_at", "resolved_day", "resolved_week", "is_done", "sla_breach", "channel",
    "channel_key", "status_key", "csat", "transfers", "transfer_value", "refund_amount_inr",
    "refund_value", "replacement_issued", "customer_key", "agent_key", "order_id", "product_sku", "category",
    "source_system",
]


def settled(tickets: DataFrame) -> DataFrame:
    """Tickets written once for a report that reads them several times, without texts."""
    extra = [c for c in ("theme", "method") if c in tickets.columns]
    return scale.settle(tickets.select(*FIGURE_COLUMNS, *extra))


def for_week(frame: DataFrame, week_start: str, column: str = "week_start") -> DataFrame:
    """Rows of one week; any day of the week may be given."""
    return frame.where(F.col(column) == C.monday_of(F.to_date(F.lit(week_start))))


def sections(counts: DataFrame) -> DataFrame:
    """Theme rows of the digest from (week_start, theme, n, position).

    A theme missing in the previous week counts 0 there; a theme only in the previous week has
    no row. Shares are taken of each week's own total.
    """
    total = F.sum("n").over(W.partitionBy("week_start"))
    totals = counts.withColumn("total", total)
    previous = counts.select(
        F.date_add("week_start", 7).alias("week_start"), "theme", F.col("n").alias("n_before"))
    previous_total = counts.groupBy(F.date_add("week_start", 7).alias("week_start")).agg(
        F.sum("n").alias("total_before"))
    joined = totals.join(previous, ["week_start", "theme"], "left").join(
        previous_total, "week_start", "left")
    n_before = F.coalesce("n_before", F.lit(0).cast("long"))
    growth = (F.col("n") * 100.0 / F.col("total")
              - n_before * 100.0 / F.greatest(F.coalesce("total_before", F.lit(0).cast("long")), F.lit(1)))
    return joined.select(
        "week_start", "position", "theme", "n", "total",
        C.share(F.col("n"), F.col("total"), 1).alias("pct"),
        (F.col("n") - n_before).alias("wow"),
        C.round_exact(growth, 1).alias("wow_pp"),
    )


def other_watch(section_rows: DataFrame, other: str = OTHER_THEME) -> DataFrame:
    """Share and growth of the unclassified theme per week, and whether a review is due."""
    is_other = F.col("theme") == other
    watched = section_rows.groupBy("week_start").agg(
        F.coalesce(F.max(F.when(is_other, F.col("pct"))), F.lit(0.0)).alias("pct"),
        F.coalesce(F.max(F.when(is_other, F.col("wow_pp"))), F.lit(0.0)).alias("wow_pp"))
    return watched.withColumn(
        "trigger", (F.col("pct") > OTHER_SHARE_TRIGGER_PCT) | (F.col("wow_pp") > OTHER_GROWTH_TRIGGER_PP))


def actions(section_rows: DataFrame, figures: DataFrame, pairs: DataFrame,
            other: str = OTHER_THEME) -> DataFrame:
    """Threshold crossings per week: theme spikes, slow email, conflicts, many repeats."""
    def row(frame: DataFrame, kind: str, subject, value: str) -> DataFrame:
        return frame.select("week_start", F.lit(kind).alias("action"), subject.alias("subject"),
                            F.col(value).cast("long").alias("value"))
    spikes = section_rows.where((F.col("wow") >= SPIKE_TRIGGER) & (F.col("theme") != other))
    slow = figures.where(F.col("email_breaches") > EMAIL_TAIL_TRIGGER)
    conflicts = figures.where(F.col("conflicts") > 0)
    repeats = pairs.where(F.col("repeat_candidates") > REPEAT_TRIGGER)
    return (
        row(spikes, "spike", F.col("theme"), "wow")
        .unionByName(row(slow, "email_tail", F.lit("email"), "email_breaches"))
        .unionByName(row(conflicts, "conflict", F.lit("refund+replacement"), "conflicts"))
        .unionByName(row(repeats, "repeats", F.lit("repeat candidates"), "repeat_candidates"))
    )


def kpi_record(tickets: DataFrame, roster: DataFrame,
               policy: SupportPolicy = DEFAULT_POLICY) -> DataFrame:
    """One row of figures per week that has created or completed tickets."""
    return _kpi_record(settled(tickets), roster, policy)


def _kpi_record(tickets, roster, policy):
    figures = K.created_week_figures(tickets, policy).drop("email_breaches", "conflicts")
    repeats = weekly_pairs(repeat_pairs(tickets, policy=policy, hot=hot_customers(tickets)))
    days = R.daily_attendance(tickets, roster).withColumn(
        "tier1", F.col("entry.team").isin(*policy.tier1_teams))
    # One row per agent and side first, so that the agent counts need no distinct aggregate.
    agents = days.groupBy(F.col("resolved_week").alias("week_start"), "agent_key", "tier1").agg(
        F.sum("n").alias("n")).groupBy("week_start").agg(
        F.count_if(F.col("tier1")).alias("tier1_agents"),
        F.count_if(~F.col("tier1")).alias("specialist_agents"),
        F.coalesce(F.sum(F.when(F.col("tier1").isNull(), F.col("n"))), F.lit(0)).alias("unresolved_attendance"))
    joined = figures.join(repeats, "week_start", "left").join(agents, "week_start", "full")
    counted = [c for c in joined.columns if c not in ("week_start", "csat_mean", "response_rate_pct")]
    return joined.select(
        "week_start",
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counted],
        F.coalesce("response_rate_pct", F.lit(0.0)).alias("response_rate_pct"), "csat_mean")


def digest_rows(tickets: DataFrame, roster: DataFrame, policy: SupportPolicy = DEFAULT_POLICY,
                rules: ThemeRules = DEFAULT_RULES, top: int = 15, rising: DataFrame | None = None) -> DataFrame:
    """The digest body as rows (week_start, section, position, key, n, pct, wow, detail).

    ``rising`` holds terms on the rise (week_start, rank, term, gain), where texts are available.
    """
    tickets = settled(TH.assign(tickets, rules))
    section_rows = sections(TH.count_themes(tickets))
    figures = K.created_week_figures(tickets, policy)
    pairs = weekly_pairs(repeat_pairs(tickets, policy=policy, hot=hot_customers(tickets)))
    boards = scale.settle(R.boards(tickets, roster, policy))
    board = R.top_of_board(R.ranked(boards.where("is_tier1").drop("is_tier1")), top)
    specialists = boards.where("not is_tier1").groupBy("resolved_week").agg(F.count(F.lit(1)).alias("agents"))
    todo = actions(section_rows, figures, pairs, rules.other)
    before = figures.select(F.date_add("week_start", 7).alias("week_start"), F.col("volume").alias("previous_volume"))
    volumes = figures.join(before, "week_start", "left").select(
        "week_start", "volume", F.coalesce("previous_volume", F.lit(0).cast("long")).alias("previous_volume"))
    watch = other_watch(section_rows, rules.other)

    def rows(frame, section, position, key, n=None, pct=None, wow=None, detail=None):
        return frame.select(
            "week_start", F.lit(section).alias("section"), position.cast("long").alias("position"),
            key.alias("key"), (F.lit(None) if n is None else n).cast("long").alias("n"),
            (F.lit(None) if pct is None else pct).cast("double").alias("pct"),
            (F.lit(None) if wow is None else wow).cast("long").alias("wow"),
            (F.lit(None) if detail is None else detail).cast("string").alias("detail"))

    def listed(frame, section, columns):
        cells = F.explode(F.array(*[
            F.struct(F.lit(i).alias("i"), F.lit(c).alias("key"), F.col(c).cast("long").alias("n"))
            for i, c in enumerate(columns, 1)])).alias("c")
        long = frame.select("week_start", cells)
        return rows(long, section, F.col("c.i"), F.col("c.key"), F.col("c.n"))

    order = W.partitionBy("week_start").orderBy("action", "subject")
    numbered = todo.withColumn("i", F.row_number().over(order))
    one = F.lit(1)
    parts = [
        listed(volumes, "volume", ["volume", "previous_volume"]),
        listed(pairs, "business", ["repeat_candidates", "repeat_same_issue"]),
        rows(section_rows, "themes", F.col("position"), F.col("theme"), F.col("n"), F.col("pct"), F.col("wow")),
        rows(watch, "other_watch", one, F.lit(rules.other), pct=F.col("pct"),
             detail=F.concat(F.lit("pp "), F.col("wow_pp").cast("string"), F.when(F.col("trigger"), " review").otherwise(""))),
        listed(figures, "cost", ["sla_breaches", "sla_credit_inr", "transfers", "transfer_cost_inr", "contact_cost_inr"]),
        rows(figures, "csat", one, F.lit("answers"), F.col("csat_n"), F.col("response_rate_pct")),
        rows(figures, "csat", F.lit(2), F.lit("mean"), pct=F.col("csat_mean")),
        rows(board.withColumnRenamed("resolved_week", "week_start"), "board", F.col("rank"), F.col("agent_id"),
             F.col("tickets_completed"), detail=F.concat_ws(" | ", "agent_name", "team", "shift")),
        rows(specialists.withColumnRenamed("resolved_week", "week_start"), "specialists", one, F.lit("agents"), F.col("agents")),
        rows(numbered, "actions", F.col("i"), F.concat("action", F.lit(": "), "subject"), F.col("value")),
    ]
    if rising is not None:
        parts.append(rows(rising, "rising", F.col("rank"), F.col("term"), pct=F.col("gain")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def kpi_rows(tickets: DataFrame, roster: DataFrame, policy: SupportPolicy = DEFAULT_POLICY,
             terms: DataFrame | None = None) -> DataFrame:
    """All weekly figures as long rows (week_start, measure, key, value), whatever channels and states occur.

    ``terms`` adds the terms of each week's groups: (week_start, grp, rank, term, score).
    """
    return _kpi_rows(settled(tickets), roster, policy, terms)


def _kpi_rows(tickets, roster, policy, terms):
    record = _kpi_record(tickets, roster, policy)
    figures = record.select("week_start", F.explode(F.array(*[
        F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value"))
        for c in record.columns if c != "week_start"])).alias("f")).select(
        "week_start", "f.measure", F.lit("").alias("key"), "f.value")

    def rows(frame, measure, key, value):
        return frame.select("week_start", F.lit(measure).alias("measure"), key.alias("key"), F.col(value).cast("double").alias("value"))

    status = K.status_mix(tickets)
    cost = K.contact_cost(tickets, policy).where(F.col("channel").isNotNull())
    parts = [
        rows(K.channel_mix(tickets), "channel_mix", F.col("channel"), "pct"),
        rows(status, "status_n", F.col("status"), "n"), rows(status, "status_pct", F.col("status"), "pct"),
        rows(K.sla_breaches(tickets), "sla_by_channel", F.col("channel"), "breaches"),
        rows(cost, "cost_by_channel", F.col("channel"), "cost_inr"),
    ]
    if terms is not None:
        parts.append(rows(terms, "group_top_term", F.concat("grp", F.lit(" # "), F.col("rank").cast("string"), F.lit(" "), "term"), "score"))
    for part in parts:
        figures = figures.unionByName(part)
    return figures


def kpi_documents(tickets: DataFrame, roster: DataFrame,
                  policy: SupportPolicy = DEFAULT_POLICY) -> DataFrame:
    """One JSON document per week, for the JSON sink.

    It holds the channels and states that the policy names; whatever else occurs is in ``kpi_rows``, which
    ``writers.write_lines`` writes whole.
    """
    def packed(frame, key, known, value, name):
        return frame.groupBy("week_start").agg(F.struct(*[
            F.max(F.when(F.col(key) == k, value)).alias(k) for k in known]).alias(name))
    tickets = settled(tickets)
    record = _kpi_record(tickets, roster, policy)
    cost = K.contact_cost(tickets, policy).where(F.col("channel").isNotNull())
    channels = list(policy.contact_rates)
    out = record
    for part in (
        packed(K.channel_mix(tickets), "channel", channels, F.col("pct"), "channel_mix"),
        packed(K.status_mix(tickets), "status", policy.statuses, F.struct("n", "pct"), "status_mix"),
        packed(K.sla_breaches(tickets), "channel", channels, F.col("breaches"), "sla_by_channel"),
        packed(cost, "channel", channels, F.col("cost_inr"), "cost_by_channel"),
    ):
        out = out.join(part, "week_start", "left")
    return out.select("week_start", F.to_json(F.struct(*out.columns)).alias("document"))

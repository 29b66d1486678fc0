"""Recount of the digest by expressions that do not use the operators under test."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .. import scale
from ..functions import clean as C
from ..operators import evaluation as E, repeat, roster as R, themes as TH, weekly as K
from ..policy import DEFAULT_POLICY, DEFAULT_RULES, SupportPolicy, ThemeRules
from .digest import sections, settled


def _check(frame: DataFrame, name: str, ok, subject=None) -> DataFrame:
    return frame.select(
        "week_start", F.lit(name).alias("check"),
        (F.lit("") if subject is None else subject).alias("subject"),
        F.coalesce(ok, F.lit(False)).alias("ok"))


def recount(tickets: DataFrame, policy: SupportPolicy = DEFAULT_POLICY) -> DataFrame:
    """Weekly money figures straight from the text cells, with plain SQL."""
    def case(values: dict[str, int], default: str) -> str:
        arms = " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items())
        return f"CASE lower(btrim(channel)) {arms} ELSE {default} END"
    def clock(c: str) -> str:
        return (f"(unix_date(to_date({c})) * 86400L + hour({c}) * 3600 + minute({c}) * 60 + second({c}))")
    late = (f"{clock('first_response_ts')} - {clock('created_ts')}"
            f" > 60 * {case(policy.sla_minutes, 'NULL')}")
    return tickets.where("created_ts IS NOT NULL").groupBy(
        F.expr("date_sub(to_date(created_ts), (dayofweek(to_date(created_ts)) + 5) % 7)").alias("week_start")
    ).agg(
        F.expr("count(*)").alias("rows"),
        F.expr(f"sum(if({late}, 1, 0))").alias("breaches"),
        F.expr("coalesce(sum(if(transfers rlike '^ *-?[0-9]+([.]0*)? *$',"
               " cast(cast(btrim(transfers) AS double) AS bigint), 0)), 0)").alias("transfers"),
        F.expr(f"sum({case(policy.contact_rates, str(policy.blended_rate))})").alias("contact"),
    )


def factuality_audit(tickets: DataFrame, roster: DataFrame, policy: SupportPolicy = DEFAULT_POLICY,
                     rules: ThemeRules = DEFAULT_RULES, top_themes: int = 5,
                     evidence: int = 10) -> DataFrame:
    """Check rows (week_start, check, subject, ok) for every week."""
    tickets = assigned = settled(TH.assign(tickets, rules))
    section_rows = sections(TH.count_themes(assigned))
    plain = recount(tickets, policy)
    totals = section_rows.groupBy("week_start").agg(
        F.max("total").alias("total"), F.sum("n").alias("summed"))
    against = totals.join(plain, "week_start")
    figures = K.created_week_figures(tickets, policy).alias("f").join(
        plain.select("week_start", F.col("breaches").alias("b"), F.col("transfers").alias("t"),
                     F.col("contact").alias("c")), "week_start")
    theme_recount = assigned.where("created_ts IS NOT NULL").groupBy(
        F.expr("date_sub(to_date(created_ts), (dayofweek(to_date(created_ts)) + 5) % 7)").alias("week_start"),
        "theme").agg(F.count(F.lit(1)).alias("again"))
    top = section_rows.where(F.col("position") <= top_themes).join(
        theme_recount, ["week_start", "theme"], "left")
    shown = W.partitionBy("week_start").orderBy("first_seq")
    rows = tickets.where("week_start IS NOT NULL").withColumn(
        "_r", F.row_number().over(shown)).where(F.col("_r") <= evidence)
    board = R.reconciliation(tickets, roster, policy).withColumnRenamed("resolved_week", "week_start")
    shown_teams = R.boards(tickets, roster, policy).where("is_tier1").groupBy(
        F.col("resolved_week").alias("week_start")).agg(
        F.count_if(F.contains("team", F.lit(policy.tier2_marker))).alias("tier2"))
    pairs = scale.settle(repeat.repeat_pairs(tickets, policy=policy, hot=repeat.hot_customers(tickets)).select(
        "week_start", "repeat_ticket_id", "prior_ticket_id"))
    ids = tickets.select("ticket_id")
    strays = pairs.select("week_start", F.explode(F.array("repeat_ticket_id", "prior_ticket_id")).alias("ticket_id")
                          ).join(ids, "ticket_id", "left_anti").groupBy("week_start").agg(
        F.count(F.lit(1)).alias("strays"))
    pair_weeks = pairs.groupBy("week_start").agg(F.count(F.lit(1)).alias("n")).join(
        strays, "week_start", "left")
    parts = [
        _check(against, "digest_total==week_rows", F.col("total") == F.col("rows")),
        _check(against, "theme_counts_sum==total", F.col("summed") == F.col("total")),
        _check(top, "theme_count", F.col("n") == F.col("again"), F.col("theme")),
        _check(rows, "id-date", C.in_week("created_ts", F.col("week_start")) & (F.col("ticket_id") != ""),
               F.col("ticket_id")),
        _check(board, "leaderboard_reconciles", F.col("reconciles")),
        _check(shown_teams, "tier2_absent_from_board", F.col("tier2") == 0),
        _check(figures, "sla_breaches_recomputed", F.col("sla_breaches") == F.col("b")),
        _check(figures, "sla_credit_recomputed", F.col("sla_credit_inr") == F.col("b") * policy.sla_credit),
        _check(figures, "transfer_count_recomputed", F.col("f.transfers") == F.col("t")),
        _check(figures, "transfer_cost_recomputed", F.col("transfer_cost_inr") == F.col("t") * policy.transfer_rate),
        _check(figures, "contact_total_recomputed", F.col("contact_cost_inr") == F.col("c")),
        _check(pair_weeks, "repeat_ids_exist", F.coalesce("strays", F.lit(0).cast("long")) == 0),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def audit_summary(audit: DataFrame) -> DataFrame:
    """Checks, errors and error rate per week."""
    n, bad = F.count(F.lit(1)), F.count_if(~F.col("ok"))
    return audit.groupBy("week_start").agg(
        n.alias("checks"), bad.alias("errors"), C.ratio(bad, n).alias("error_rate"))


def evaluation_report(labelled: DataFrame) -> DataFrame:
    """Accuracy, pair and refund figures of a labelled sample as (measure, value) rows."""
    def rows(frame: DataFrame, prefix: str) -> DataFrame:
        cells = [F.struct(F.lit(f"{prefix}.{c}").alias("measure"), F.col(c).cast("double").alias("value"))
                 for c in frame.columns]
        return frame.select(F.explode(F.array(*cells)).alias("r")).select("r.*")
    methods = E.accuracy_by_method(labelled)
    per_method = methods.select(F.explode(F.array(*[
        F.struct(F.concat(F.lit("theme."), "method", F.lit(f".{c}")).alias("measure"),
                 F.col(c).cast("double").alias("value")) for c in ("n", "agree", "accuracy")])).alias("r")
    ).select("r.*")
    return (
        rows(E.accuracy(labelled), "theme").unionByName(per_method)
        .unionByName(rows(E.confusion(labelled), "repeat"))
        .unionByName(rows(E.refund_review(labelled), "refund"))
    )


def evaluation_lines(labelled: DataFrame, audit: DataFrame) -> DataFrame:
    """The evaluation as document lines (section, key, value, predicted, human_label).

    Sections: ``measures``; ``theme_errors``, ``fp`` and ``fn``, a line per wrong item; ``factuality``, what the audit
    checked; ``failed``, its failed checks by kind. Rows stay rows: no list is gathered, however many
    items are wrong.
    """
    n, bad = F.count(F.lit(1)), F.count_if(~F.col("ok"))
    kinds = audit.groupBy("check").agg(n.alias("checks"), bad.alias("errors"))
    totals = kinds.agg(F.coalesce(F.sum("checks"), F.lit(0)).alias("checks"), F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"))
    facts = totals.withColumn("error_rate", C.ratio(F.col("errors"), F.col("checks")))

    def rows(frame, section, key, value=None, predicted=None, human_label=None):
        return frame.select(
            section.alias("section"), key.alias("key"), (F.lit(None) if value is None else value).cast("double").alias("value"),
            *[(F.lit(None) if c is None else c).cast("string").alias(name) for name, c in (("predicted", predicted), ("human_label", human_label))])

    cells = facts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in facts.columns])))
    parts = [
        rows(evaluation_report(labelled), F.lit("measures"), F.col("measure"), F.col("value")),
        rows(E.theme_errors(labelled), F.lit("theme_errors"), F.col("item_id"), None, F.col("predicted"), F.col("human_label")),
        rows(E.confusion_errors(labelled), F.col("kind"), F.col("item_id")),
        rows(cells, F.lit("factuality"), F.col("key"), F.col("value")),
        rows(kinds.where("errors > 0"), F.lit("failed"), F.col("check"), F.col("errors")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out

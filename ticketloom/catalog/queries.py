"""Registered queries: each operator applied to whole driver tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bindings as B
from ..functions import clean as C, money as M, text as X
from ..operators import (
    dedup as D, evaluation as E, quality as Q, repeat as P, responses as RS, roster as R,
    sampling as S, terms as TM, themes as TH, weekly as K,
)
from ..policy import DEFAULT_POLICY
from ..plans import audit as A, digest as G, one_week as OW, quality_report as QR
from ..schemas import ROSTER_COLUMNS as S_ROSTER, SAMPLE_COLUMNS, TICKET_COLUMNS as S_TICKETS
from ..sources import readers as RD, writers as WR

Query = Callable[[SparkSession, str], DataFrame]


# -- cleaning and de-duplication
def stable_row_keys(spark, d):
    return B.raw_tickets(spark, d).select("raw_seq", "ticket_id", "stable_row_key")


def dedup_canonical(spark, d):
    return D.canonical(B.raw_tickets(spark, d)).select(
        "ticket_id", "source_system", "raw_seq", "first_seq", "status", "channel")


def dedup_merged(spark, d):
    """A first export's landed state, merged with the state of a second one that repeats tickets of the first."""
    raw = B.raw_tickets(spark, d)
    old, new = (D.state(raw.where(f"raw_seq % 2 = {k}").withColumn("raw_seq", F.col("raw_seq") + k * (1 << 45))) for k in (0, 1))
    landed = WR.land(old, _scratch(spark))
    return D.best_rows(D.merged(landed, new)).select(
        "ticket_id", "source_system", "raw_seq", "first_seq", "copies", "other_system", "status", "channel", "stable_row_key")


def dedup_quarantine(spark, d):
    return D.quarantine(B.raw_tickets(spark, d)).select("ticket_id", "source_system", "raw_seq")




def parse_timestamps(spark, d):
    raw = B.raw_tickets(spark, d)
    day = C.parse_date("created_at")
    return raw.select(
        "raw_seq", C.parse_timestamp("created_at").cast("string").alias("created"),
        C.parse_timestamp("first_response_at").cast("string").alias("first_response"),
        day.alias("created_day"))


def week_start(spark, d):
    t = B.tickets(spark, d)
    return t.select("ticket_id", "week_start", "resolved_week",
                    C.in_week("created_ts", "2024-01-08").alias("in_week_2024_01_08"))


def parse_cells(spark, d):
    t = B.tickets(spark, d)
    return t.select("ticket_id", "csat", "transfer_value", "refund_value", "channel_key", "status_key",
                    C.resolved_at_trusted("source_system", "resolved_at").alias("trusted"))


def response_minutes(spark, d):
    t = B.tickets(spark, d)
    return t.select("ticket_id", C.minutes_between("first_response_ts", "created_ts").alias("minutes"),
                    C.round_exact(C.days_between("resolved_ts", "created_ts"), 4).alias("days"), "sla_breach")


# -- weekly figures and money
def replacement_cost(spark, d):
    part = B.table(spark, d, "part")
    return part.select("p_partkey", C.round_exact(M.replacement_cost("p_retailprice"), 2).alias("plan_cost"))


def contact_rates(spark, d):
    return B.tickets(spark, d).select("ticket_id", M.contact_rate("channel").alias("rate_inr"))


def attendance_weekly(spark, d):
    return K.attendance(B.tickets(spark, d)).groupBy("resolved_week").agg(
        F.count(F.lit(1)).alias("attendance"))


def conflicts_weekly(spark, d):
    return K.dated(B.tickets(spark, d)).groupBy("week_start").agg(K.conflict_count().alias("conflicts"))


def week_slices(spark, d):
    """Each week's volume next to the previous week's."""
    v = K.volume(B.tickets(spark, d))
    before = v.select(F.date_add("week_start", 7).alias("week_start"), F.col("volume").alias("volume_before"))
    return v.join(before, "week_start", "left").select(
        "week_start", "volume", F.coalesce("volume_before", F.lit(0).cast("long")).alias("volume_before"))


# -- roster
def roster_asof(spark, d):
    return R.asof(B.tickets(spark, d), B.roster(spark, d)).select(
        "resolved_week", "ticket_id", "agent_key", F.col("entry.team").alias("team"),
        F.col("entry.site").alias("site"))


def roster_asof_shuffled(spark, d):
    """The same lookup as for a roster too large to broadcast."""
    return R.asof(B.tickets(spark, d), B.roster(spark, d), max_broadcast_rows=0).select(
        "resolved_week", "ticket_id", "agent_key", F.col("entry.team").alias("team"),
        F.col("entry.site").alias("site"))


def _tier1(spark, d):
    return R.tier1_board(B.tickets(spark, d), B.roster(spark, d))


def specialist_table(spark, d):
    return R.specialist_board(B.tickets(spark, d), B.roster(spark, d))


def leaderboard_top15(spark, d):
    return R.top_of_board(_tier1(spark, d), 15)


def unresolved_attendance(spark, d):
    return R.unresolved(B.tickets(spark, d), B.roster(spark, d)).drop("first_seq")


def board_reconciliation(spark, d):
    return R.reconciliation(B.tickets(spark, d), B.roster(spark, d))


def _tier2():
    return F.contains("team", F.lit(DEFAULT_POLICY.tier2_marker))


def tier2_absence(spark, d):
    """Escalation teams on the Tier-1 board per week: must be none."""
    board = R.boards(B.tickets(spark, d), B.roster(spark, d)).where("is_tier1")
    return board.groupBy("resolved_week").agg(
        F.count_if(_tier2()).alias("tier2_agents"), (F.count_if(_tier2()) == 0).alias("absent"))


# -- repeat contacts
def _pairs(spark, d):
    return P.repeat_pairs(B.tickets(spark, d))


def repeat_same_issue(spark, d):
    return P.same_issue(_pairs(spark, d)).select(
        "week_start", "prior_ticket_id", "repeat_ticket_id", X.pair_method().alias("method"))


def repeat_same_issue_weekly(spark, d):
    return P.weekly_pairs(_pairs(spark, d))


def repeat_ids_exist(spark, d):
    """Pair ids without a canonical ticket: must be none."""
    pairs = _pairs(spark, d).select(F.explode(F.array("prior_ticket_id", "repeat_ticket_id")).alias("ticket_id"))
    ids = D.canonical(B.raw_tickets(spark, d)).select("ticket_id")
    return pairs.join(ids, "ticket_id", "left_anti").agg(F.count(F.lit(1)).alias("strays"))


# -- data quality
def _scalar(*names):
    def run(spark, d):
        return Q.as_rows(Q.scalar_checks(B.tickets(spark, d), list(names)))
    return run


def dq_conflict_tickets(spark, d):
    return Q.same_ticket_conflicts(B.tickets(spark, d)).select("ticket_id")


def dq_order_cross_ticket(spark, d):
    return Q.cross_ticket_orders(B.tickets(spark, d))


def dq_roster_unresolved(spark, d):
    return Q.roster_unresolved(B.tickets(spark, d), B.roster(spark, d))


def dq_orphans(spark, d):
    return Q.orphans(B.tickets(spark, d), B.reference_keys(spark, d) | {"priority": None})


def dq_report(spark, d):
    raw = B.raw_tickets(spark, d)
    return QR.quality_report(raw, D.typed(D.canonical(raw)), B.roster(spark, d), B.reference_keys(spark, d))


def reference_key_counts(spark, d):
    """Distinct keys per reference table."""
    out = None
    for name, keys in B.reference_keys(spark, d).items():
        one = Q.key_set(keys, "key").agg(F.lit(name).alias("table_key"), F.count(F.lit(1)).alias("keys"))
        out = one if out is None else out.unionByName(one)
    return out


def family_lookup(spark, d):
    """Family of each ticket's product, '?' where unknown, as a group label."""
    from .. import scale
    t = B.tickets(spark, d).select("ticket_id", "category", F.col("product_sku").alias("sku"))
    joined = scale.lookup(t, B.families(spark, d), ["sku"], ["ticket_id"])
    return joined.select("ticket_id", X.group_label("category", "family").alias("group_label"))


# -- themes
def _assigned(spark, d):
    return TH.assign(B.tickets(spark, d))


def theme_scores(spark, d):
    return TH.theme_scores(B.text_tickets(spark, d), B.WORD_RULES)


def theme_scores_support(spark, d):
    return TH.theme_scores(B.tickets(spark, d)).groupBy("theme").agg(
        F.sum("hits").alias("hits"), F.count_if(F.col("hits") > 0).alias("tickets"))


def theme_assign(spark, d):
    return _assigned(spark, d).select("ticket_id", "theme", "confidence", "method")


def theme_assign_documents(spark, d):
    return TH.assign(B.text_tickets(spark, d), B.WORD_RULES).select(
        "ticket_id", "theme", "confidence", "method")


def theme_explain(spark, d):
    return TH.explain(B.tickets(spark, d))


def theme_disagreements(spark, d):
    return TH.disagreements(TH.explain(B.tickets(spark, d)))


def theme_counts_weekly(spark, d):
    return TH.count_themes(_assigned(spark, d))


def digest_sections(spark, d):
    from .. import scale
    return G.sections(scale.settle(theme_counts_weekly(spark, d)))


def other_watch(spark, d):
    return G.other_watch(digest_sections(spark, d))


def actions_weekly(spark, d):
    t = G.settled(_assigned(spark, d))
    return G.actions(G.sections(TH.count_themes(t)), K.created_week_figures(t),
                     P.weekly_pairs(P.repeat_pairs(t, hot=P.hot_customers(t))))


def kpi_record(spark, d):
    return G.kpi_record(B.tickets(spark, d), B.roster(spark, d))


def kpi_record_one_week(spark, d):
    return G.for_week(kpi_record(spark, d), "2024-01-10")


LANDED_WEEK = "2024-01-10"


def _landed(spark, d):
    """Tickets landed by created and resolved week."""
    return OW.land_by_week(B.tickets(spark, d), _scratch(spark))


def kpi_record_landed_week(spark, d):
    """The record of one week from the partitions that it needs."""
    return OW.kpi_record(_landed(spark, d), B.roster(spark, d), LANDED_WEEK)


def digest_landed_week(spark, d):
    """The digest of one week beside the week before, from the partitions that both need."""
    return OW.digest(_landed(spark, d), B.roster(spark, d), LANDED_WEEK)


def digest_rows(spark, d):
    return G.digest_rows(B.tickets(spark, d), B.roster(spark, d), rising=emerging_terms_tickets(spark, d))


def kpi_rows(spark, d):
    return G.kpi_rows(B.tickets(spark, d), B.roster(spark, d), terms=group_top_terms_weekly(spark, d))


# -- terms
def _grouped(spark, d):
    docs = B.text_tickets(spark, d)
    return docs.select("doc_id", "week_start", X.group_label("category", "product_family").alias("grp"),
                       X.ticket_text("customer_message", "agent_notes").alias("text"))


def group_top_terms(spark, d):
    return TM.group_top_terms(_grouped(spark, d), "doc_id", "grp", "text", B.STOP_WORDS, k=5).withColumn(
        "score", C.round_exact(F.col("score"), 6))


def group_top_terms_weekly(spark, d):
    """Terms of each group within each week."""
    return TM.group_top_terms(
        _grouped(spark, d), "doc_id", ["week_start", "grp"], "text", B.STOP_WORDS, k=5).withColumn(
        "score", C.round_exact(F.col("score"), 6))


def group_skipped(spark, d):
    return TM.skipped_groups(_grouped(spark, d), "grp", 3)


def group_top_terms_tickets(spark, d):
    """Ticket groups by category and family, with the default English stop list."""
    from .. import scale
    t = B.tickets(spark, d).select(
        "ticket_id", "category", F.col("product_sku").alias("sku"), "customer_message", "agent_notes")
    fam = scale.lookup(t, B.families(spark, d), ["sku"], ["ticket_id"])
    docs = fam.select("ticket_id", X.group_label("category", "family").alias("grp"),
                      X.ticket_text("customer_message", "agent_notes").alias("text"))
    return TM.group_top_terms(docs, "ticket_id", "grp", "text", B.STOP_WORDS, k=5).withColumn(
        "score", C.round_exact(F.col("score"), 6))


def emerging_terms(spark, d):
    return TM.emerging_terms(B.text_tickets(spark, d), "week_start", "customer_message", 7, B.STOP_WORDS, k=8)


def emerging_terms_tickets(spark, d):
    return TM.emerging_terms(B.tickets(spark, d), "week_start", "customer_message", 7, B.STOP_WORDS, k=8)


# -- files
def _scratch(spark):
    from uuid import uuid4

    from .. import scale
    return f"{scale.shared_location(spark)}/ticketloom-{uuid4().hex}"


def csv_round_trip(spark, d):
    """Whole documents written as a CSV export with line breaks and quotes, and read back."""
    path = _scratch(spark)
    WR.write_csv(B.text_tickets(spark, d), path, ["ticket_id", "customer_message", "agent_notes", "category"])
    back = RD.read_csv(spark, path, S_TICKETS)
    return back.select("ticket_id", "category", "agent_notes", F.md5("customer_message").alias("message_md5"),
                       F.length("customer_message").cast("long").alias("chars"), "priority")


def csv_arrival(spark, d):
    """Tickets written as many files of unequal size, read back and de-duplicated.

    The files of the first folder hold the later copies, so these count as having arrived first.
    """
    path = _scratch(spark)
    raw = B.raw_tickets(spark, d).withColumn("agent_notes", F.concat(F.lit("row "), F.col("raw_seq").cast("string")))
    for part, rows in (("a", raw.where("raw_seq % 2 = 1")), ("b", raw.where("raw_seq % 2 = 0"))):
        WR.write_csv(rows.repartitionByRange("raw_seq").sortWithinPartitions("raw_seq"), f"{path}/part={part}", S_TICKETS)
    kept = D.canonical(RD.read_tickets(spark, path))
    return kept.select("ticket_id", "source_system", "agent_notes", "status", "created_at", (F.col("raw_seq") >= 0).alias("numbered"))


def taxonomy_round_trip(spark, d):
    """A theme per document source, written as one JSON document and read back."""
    path = _scratch(spark)
    sources = B.table(spark, d, "documents").select("source").distinct()
    themes = F.transform(F.array_sort(F.collect_list("source")), lambda s: F.struct(
        s.alias("name"), F.concat(F.lit("texts of "), s).alias("definition")))
    WR.write_documents(sources.agg(F.to_json(F.struct(F.lit("v1").alias("version"), themes.alias("themes"))).alias("document")), path)
    return RD.read_taxonomy(spark, path).withColumn("position", F.col("position").cast("long"))


def labelled_sample_round_trip(spark, d):
    """The labelled sample written with the fixed columns, read back."""
    path = _scratch(spark)
    rows = B.labelled(spark, d).withColumns({c: F.lit("") for c in ("pair_id", "channel", "source_system", "text")})
    WR.write_csv(rows, path, SAMPLE_COLUMNS)
    return RD.read_sample(spark, path)


def roster_intervals(spark, d):
    """Roster written as CSV, read back and parsed into dated intervals."""
    path = _scratch(spark)
    WR.write_csv(B.roster(spark, d), path, S_ROSTER)
    return R.intervals(RD.read_roster(spark, path)).select(
        "agent_key", "name", "team", "shift", "site", "valid_from", "valid_to")


def kpi_documents(spark, d):
    """Weekly JSON documents, read back field by field."""
    docs = G.kpi_documents(B.tickets(spark, d), B.roster(spark, d))

    def field(path, kind="long"):
        return F.get_json_object("document", path).cast(kind)
    return docs.select(
        "week_start", F.coalesce(field("$.volume"), F.lit(0).cast("long")).alias("volume"),
        field("$.channel_mix.chat", "double").alias("chat_pct"), field("$.status_mix.open.n").alias("open_n"),
        field("$.sla_by_channel.email").alias("email_breaches"), field("$.cost_by_channel.voice").alias("voice_cost"))


def quality_document(spark, d):
    """The quality report as one JSON document, read back."""
    return QR.quality_document(dq_report(spark, d)).select(
        F.get_json_object("document", "$.canonical_rows").cast("long").alias("canonical_rows"),
        F.get_json_object("document", "$.orphan_agent_id").cast("long").alias("orphan_agent_id"),
        F.get_json_object("document", "$['resolved_rows.helpdesk']").cast("long").alias("resolved_helpdesk"))


# -- model requests and replies
def excerpts(spark, d):
    return B.text_tickets(spark, d).select(
        "ticket_id", X.excerpt("customer_message", "agent_notes").alias("excerpt"))


def prompt_payload(spark, d):
    return RS.payload_items(B.text_tickets(spark, d)).select("ticket_id", "item")


def prompt_batches(spark, d):
    return RS.payload_batches(B.text_tickets(spark, d), B.RESPONSE_BATCH).select(
        "batch_id", F.array_join("ticket_ids", ",").alias("ticket_ids"),
        F.length("payload").cast("long").alias("payload_chars"))


def prompt_batches_week(spark, d):
    """Requests for the tickets of one week, which have gaps in their numbers: full ones but for the last."""
    week = B.text_tickets(spark, d).where(F.col("week_start") == F.lit("2024-01-08").cast("date"))
    return RS.payload_batches(week, B.RESPONSE_BATCH).select(
        "batch_id", F.array_join("ticket_ids", ",").alias("ticket_ids"), F.size("ticket_ids").cast("long").alias("tickets"),
        F.md5("payload").alias("payload_md5"))


def _checked(spark, d):
    """Replies parsed once, and their verdicts."""
    from .. import scale
    parsed = scale.settle(RS.parsed_replies(B.model_responses(spark, d)))
    return parsed, RS.check_responses(parsed, B.batch_members(spark, d).drop("doc_id"), B.taxonomy(spark))


def response_validate(spark, d):
    return _checked(spark, d)[1]


def _labels(spark, d):
    return RS.accepted_labels(*_checked(spark, d))


def response_merge(spark, d):
    assigned = TH.assign(B.text_tickets(spark, d), B.WORD_RULES).select("ticket_id", "theme")
    return RS.merge_labels(assigned, _labels(spark, d))


def label_coverage(spark, d):
    return RS.label_coverage(B.batch_members(spark, d), _labels(spark, d))


def polish_validate(spark, d):
    return RS.check_polished(B.drafts(spark, d)).select(
        "ticket_id", "kept", F.size(X.figures_missing("draft", "polished")).cast("long").alias("missing"))


# -- sampling and evaluation
def label_override(spark, d):
    return B.labelled(spark, d).select("item_id", "stratum", "predicted", "human_label", "notes")


def _theme_picks(spark, d):
    """Picks from a small written table of (ticket, theme, method, disagrees)."""
    from .. import scale
    judged = scale.settle(TH.judge(B.tickets(spark, d)))
    return S.theme_picks(judged, judged.where("disagrees"))


def stratified_sample(spark, d):
    return _theme_picks(spark, d).select("theme", "method", "ticket_id")


def review_sample(spark, d):
    """The whole review sample: themes, pairs and refunds, with texts.

    Picks are made on narrow tables; texts are read for the picked ids only.
    """
    from .. import scale
    t = G.settled(B.tickets(spark, d))
    themes = scale.settle(_theme_picks(spark, d))
    pairs = scale.settle(S.pair_picks(P.repeat_pairs(t, hot=P.hot_customers(t))))
    refunds = scale.settle(S.refund_picks(t))
    ids = themes.select("ticket_id").unionByName(refunds.select("ticket_id")).unionByName(
        pairs.select(F.explode(F.array("prior_ticket_id", "repeat_ticket_id")).alias("ticket_id"))).distinct()
    raw = B.raw_tickets(spark, d).join(ids, "ticket_id", "left_semi")
    texts = scale.settle(D.typed(D.canonical(raw)))
    return (S.theme_items(texts, themes).unionByName(S.pair_items(texts, pairs))
            .unionByName(S.refund_items(texts, refunds)))


def sample_pairs(spark, d):
    return S.pair_picks(_pairs(spark, d)).select("predicted", "prior_ticket_id", "repeat_ticket_id")


def sample_stratum_sizes(spark, d):
    return S.stratum_sizes(B.labelled_sample(spark, d))


def refund_review_items(spark, d):
    t = B.tickets(spark, d)
    return S.refund_items(t, S.refund_picks(G.settled(t))).select(
        "item_id", "ticket_id", "pair_id", "predicted", "method", "text")


def refund_item_tickets(spark, d):
    t = B.tickets(spark, d)
    return S.refund_item_tickets(t, S.refund_picks(G.settled(t)))


def _reviewed(spark, d):
    """The drawn sample with a reviewer's corrections of some items."""
    from .. import scale
    sample = scale.settle(review_sample(spark, d))
    fixes = sample.where(F.substring(F.md5("item_id"), 1, 1).isin(*"01234")).select(
        "item_id", F.when(F.col("stratum") == "theme", "Other / Unclassified").when(F.col("stratum") == "repeat", "not-same-issue")
        .otherwise("confirmed-violation").alias("human_label"), F.lit("second look").alias("notes"))
    return E.apply_labels(sample, fixes)


def review_evaluation(spark, d):
    """Draw, label and measure: figures of the drawn sample itself."""
    return A.evaluation_report(_reviewed(spark, d))


_LINE = "section string, key string, value double, predicted string, human_label string"


def evaluation_document(spark, d):
    """The evaluation written as shards of lines, read back field by field and item by item."""
    path = _scratch(spark)
    WR.write_lines(A.evaluation_lines(B.labelled(spark, d), factuality_audit_planted(spark, d)), path, ["section", "key"])
    section, key = F.col("section"), F.col("key")
    item = F.when(section == "theme_errors", F.concat(F.lit("error "), key, F.lit(" "), "predicted", F.lit(" "), "human_label"))
    return RD.read_lines(spark, path, _LINE).select(
        F.when(section == "measures", key).when(section == "theme_errors", item).otherwise(F.concat_ws(" ", section, key)).alias("field"),
        F.coalesce("value", F.when(section.isin("theme_errors", "fp", "fn"), 1.0)).alias("value"))


def kpi_document_lines(spark, d):
    """All weekly figures of all channels, states and terms, written as document lines and read back."""
    path = _scratch(spark)
    WR.write_lines(kpi_rows(spark, d), path, ["week_start", "measure", "key"])
    return RD.read_lines(spark, path, "week_start date, measure string, key string, value double")


def quality_document_lines(spark, d):
    """All checks of the quality report, written as document lines and read back."""
    path = _scratch(spark)
    WR.write_lines(dq_report(spark, d), path, ["check", "scope"])
    return RD.read_lines(spark, path, "check string, scope string, value long")


def theme_explain_documents(spark, d):
    return TH.explain(B.text_tickets(spark, d), B.WORD_RULES)


def theme_disagreements_documents(spark, d):
    return TH.disagreements(theme_explain_documents(spark, d))


def factuality_audit(spark, d):
    return A.factuality_audit(B.tickets(spark, d), B.roster(spark, d))


def factuality_audit_planted(spark, d):
    """The audit over figures in which every ticket of one week is wrongly late: it must say so."""
    t = B.tickets(spark, d)
    wrong = F.coalesce(F.col("week_start") == F.lit("2024-01-08").cast("date"), F.lit(False))
    return A.factuality_audit(
        t.withColumn("sla_breach", F.when(wrong, F.lit(True)).otherwise(F.col("sla_breach"))), B.roster(spark, d))


def audit_summary(spark, d):
    return A.audit_summary(factuality_audit(spark, d))


def _on_tickets(operator):
    def run(spark, d):
        return operator(B.tickets(spark, d))
    return run


def _on_labels(operator):
    def run(spark, d):
        return operator(B.labelled(spark, d))
    return run


def all_queries() -> dict[str, Query]:
    return {
        "stable_row_keys": stable_row_keys,
        "dedup_canonical": dedup_canonical,
        "dedup_quarantine": dedup_quarantine,
        "dedup_merged": dedup_merged,
        "parse_timestamps": parse_timestamps,
        "parse_cells": parse_cells,
        "week_start": week_start,
        "response_minutes": response_minutes,
        "weekly_volume": _on_tickets(K.volume),
        "week_slices": week_slices,
        "channel_mix_weekly": _on_tickets(K.channel_mix),
        "status_mix_weekly": _on_tickets(K.status_mix),
        "sla_breaches_weekly": _on_tickets(K.sla_breaches),
        "sla_missing_weekly": _on_tickets(K.sla_missing),
        "csat_stats_weekly": _on_tickets(K.csat_stats),
        "transfer_count_weekly": _on_tickets(K.transfer_count),
        "contact_rates": contact_rates,
        "contact_cost_weekly": _on_tickets(K.contact_cost),
        "transfer_cost_weekly": _on_tickets(K.transfer_cost),
        "sla_credit_weekly": _on_tickets(K.sla_credit),
        "replacement_cost": replacement_cost,
        "conflicts_weekly": conflicts_weekly,
        "attendance_weekly": attendance_weekly,
        "roster_asof": roster_asof,
        "roster_asof_shuffled": roster_asof_shuffled,
        "tier1_leaderboard": _tier1,
        "specialist_table": specialist_table,
        "leaderboard_top15": leaderboard_top15,
        "unresolved_attendance": unresolved_attendance,
        "board_reconciliation": board_reconciliation,
        "tier2_absence": tier2_absence,
        "repeat_pairs": _pairs,
        "repeat_same_issue": repeat_same_issue,
        "repeat_same_issue_weekly": repeat_same_issue_weekly,
        "repeat_ids_exist": repeat_ids_exist,
        "dq_duplicates": lambda s, d: Q.duplicates(B.raw_tickets(s, d)),
        "dq_time_order": _scalar(
            "resolved_rows:helpdesk", "resolved_before_first:helpdesk", "resolved_rows:legacy_fd",
            "resolved_before_first:legacy_fd", "first_before_created"),
        "dq_time_order_by_source": _on_tickets(Q.time_order),
        "dq_status_mismatch": _scalar("status_timestamp_mismatch"),
        "dq_refunds": _scalar("refund_negative", "refund_no_code", "refund_non_numeric",
                              "same_ticket_refund_replacement"),
        "dq_conflict_tickets": dq_conflict_tickets,
        "dq_order_cross_ticket": dq_order_cross_ticket,
        "dq_csat": _scalar("csat_out_of_range"),
        "dq_transfers": _scalar("transfer_non_integral"),
        "dq_blanks": _scalar("blank_order_id", "blank_agent_id", "blank_customer_id", "blank_product_sku",
                             "empty_customer_message", "empty_agent_notes"),
        "dq_timestamps": _scalar("invalid_created", "invalid_first_response"),
        "dq_canonical_rows": _scalar("canonical_rows"),
        "dq_roster_overlaps": lambda s, d: R.overlaps(B.roster(s, d)),
        "dq_roster_unresolved": dq_roster_unresolved,
        "dq_orphans": dq_orphans,
        "dq_report": dq_report,
        "reference_key_counts": reference_key_counts,
        "family_map": B.families,
        "family_lookup": family_lookup,
        "theme_scores": theme_scores,
        "theme_scores_support": theme_scores_support,
        "theme_assign": theme_assign,
        "theme_assign_documents": theme_assign_documents,
        "theme_explain": theme_explain,
        "theme_disagreements": theme_disagreements,
        "theme_counts_weekly": theme_counts_weekly,
        "digest_sections": digest_sections,
        "other_watch": other_watch,
        "actions_weekly": actions_weekly,
        "group_top_terms": group_top_terms,
        "group_top_terms_weekly": group_top_terms_weekly,
        "group_top_terms_tickets": group_top_terms_tickets,
        "group_skipped": group_skipped,
        "emerging_terms": emerging_terms,
        "emerging_terms_tickets": emerging_terms_tickets,
        "csv_round_trip": csv_round_trip,
        "csv_arrival": csv_arrival,
        "taxonomy_round_trip": taxonomy_round_trip,
        "labelled_sample_round_trip": labelled_sample_round_trip,
        "roster_intervals": roster_intervals,
        "kpi_documents": kpi_documents,
        "quality_document": quality_document,
        "kpi_document_lines": kpi_document_lines,
        "quality_document_lines": quality_document_lines,
        "excerpts": excerpts,
        "prompt_payload": prompt_payload,
        "prompt_batches": prompt_batches,
        "prompt_batches_week": prompt_batches_week,
        "response_validate": response_validate,
        "response_merge": response_merge,
        "label_coverage": label_coverage,
        "polish_validate": polish_validate,
        "label_override": label_override,
        "stratified_sample": stratified_sample,
        "sample_pairs": sample_pairs,
        "sample_stratum_sizes": sample_stratum_sizes,
        "refund_review_items": refund_review_items,
        "refund_item_tickets": refund_item_tickets,
        "review_evaluation": review_evaluation,
        "evaluation_document": evaluation_document,
        "theme_explain_documents": theme_explain_documents,
        "theme_disagreements_documents": theme_disagreements_documents,
        "kpi_rows": kpi_rows,
        "review_sample": review_sample,
        "theme_accuracy": _on_labels(E.accuracy),
        "theme_accuracy_by_method": _on_labels(E.accuracy_by_method),
        "theme_errors": _on_labels(E.theme_errors),
        "confusion_metrics": _on_labels(E.confusion),
        "confusion_errors": _on_labels(E.confusion_errors),
        "refund_review_counts": _on_labels(E.refund_review),
        "evaluation_report": _on_labels(A.evaluation_report),
        "factuality_audit": factuality_audit,
        "factuality_audit_planted": factuality_audit_planted,
        "audit_summary": audit_summary,
        "kpi_record": kpi_record,
        "kpi_record_one_week": kpi_record_one_week,
        "kpi_record_landed_week": kpi_record_landed_week,
        "digest_landed_week": digest_landed_week,
        "digest_rows": digest_rows,
    }

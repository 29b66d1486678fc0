"""Ticket, roster and reference tables derived from the driver's tables.

The exports the operators are meant for are not available, so their cells are derived from whole
driver tables: tickets from ``events``, the roster from ``supplier``, products from ``part``,
text tickets from ``documents``, labels from ``labels``.
"""
from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import scale
from ..functions import clean as C
from ..operators import dedup
from ..policy import ThemeRules
from ..sources.readers import family_map, row_key

CATEGORIES = [
    "Connectivity", "Charging & Battery", "Audio Quality", "App & Firmware", "Delivery & Shipping",
    "Returns & Refunds", "Billing & Payments", "Warranty & Repair", "Account & Login",
    "Product Enquiry", "Other", "",
]
MESSAGES = [
    "My left bud will not pair by bluetooth with the laptop", "I want my refund, the shop promised it on Monday",
    "The battery is empty after an hour of calls", "qwe rty uio", "No otp reaches me, so login is impossible",
    "Two weeks in repair and the warranty desk is silent", "The bank debited me although the payment failed",
    "My parcel is late and the courier tracking shows nothing", "After the firmware update the app shows a white screen",
    "The mic crackles and there is no sound in calls", "Before I buy: does this model work with a tablet", "",
    "Please send the invoice, and the coupon was refused", "Either a replacement or my money back",
    "Change the delivery address, I typed the wrong pincode", "good morning everyone", "The case is not charging over night",
]
NOTES = ["reset done", "", "asked customer for order id", "shipped again", "closed as duplicate"]
TEAMS = [
    "Chat Frontline", "Email Frontline", "Voice Frontline", "Logistics", "Billing",
    "Escalations & Warranty",
]
# Words found in the driver's texts, as themes of a keyword table.
WORD_THEMES = {
    "Articles": ["the", "la", "der", "le", "die"],
    "Prepositions": ["for", "with", "from", "von", "avec", "para"],
    "Verbs": ["was", "is", "are", "est", "ist"],
    "Joins": ["and", "und", "et", "that", "que"],
}
STOP_WORDS = [
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "on", "with", "be", "as", "by",
    "this", "are", "at", "an", "from", "de", "la", "le", "les", "des", "et", "en", "un", "une", "que",
    "der", "die", "das", "und", "den", "von", "el", "los", "las", "es", "du",
]


def word_pattern(word: str) -> str:
    """Whole-word pattern that reads the same in Java and RE2."""
    return rf"(^|[^\p{{L}}\p{{N}}_]){word}($|[^\p{{L}}\p{{N}}_])"


WORD_RULES = ThemeRules(
    category_themes={"src0": "Articles", "src1": "Prepositions", "src2": "Verbs", "src3": "Joins"},
    patterns={t: [word_pattern(w) for w in ws] for t, ws in WORD_THEMES.items()},
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index: str) -> str:
    quoted = ", ".join("'" + v.replace("'", "\\'") + "'" for v in values)
    return f"element_at(array({quoted}), cast({index} % {len(values)} AS int) + 1)"


def raw_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticket export cells from every event; one event in eighteen appears in two systems."""
    events = scale.spread_single_file(table(spark, sf_dir, "events"), "event_id").selectExpr(
        "*", "cast(get_json_object(props, '$.k') AS int) AS k",
        "explode(IF(event_id % 18 = 5, array(0, 1), array(0))) AS copy")
    stamped = events.selectExpr(
        "*",
        "IF((event_id + copy) % 4 = 1, 'legacy_fd', 'helpdesk') AS source_system",
        "IF(event_id % 23 = 0, NULL, ts + make_dt_interval(0, 0, 0, cast(floor(60 * value) AS decimal(18, 6)))) AS first_ts")
    timed = stamped.selectExpr(
        "*",
        "CASE WHEN event_id % 10 < 2 THEN NULL"
        " WHEN source_system = 'legacy_fd' THEN ts + make_dt_interval(0, 0, 10 * k - 330, 0)"
        " ELSE coalesce(first_ts, ts) + make_dt_interval(0, 0, 10 * k, 0) END AS done_ts")

    def cell(c: str) -> str:
        return f"substring(cast({c} AS string), 1, 19)"
    created = cell("ts")
    rows = timed.selectExpr(
        "2 * event_id + copy AS raw_seq",
        "concat('TK-', event_id) AS ticket_id",
        f"CASE WHEN event_id % 211 = 0 THEN 'not-a-date' WHEN event_id % 19 = 0 THEN substring({created}, 1, 10)"
        f" WHEN event_id % 7 = 0 THEN replace({created}, ' ', 'T') WHEN event_id % 7 = 1 THEN substring({created}, 1, 16)"
        f" WHEN event_id % 7 = 2 THEN concat('  ', {created}, ' ') ELSE {created} END AS created_at",
        f"CASE WHEN event_id % 199 = 0 THEN 'soon' ELSE {cell('first_ts')} END AS first_response_at",
        f"{cell('done_ts')} AS resolved_at",
        "CASE event_id % 10 WHEN 0 THEN 'open' WHEN 1 THEN 'pending' WHEN 2 THEN 'Closed' ELSE 'resolved' END AS status",
        "CASE event_type WHEN 'click' THEN 'Chat' WHEN 'view' THEN ' email' WHEN 'purchase' THEN 'voice'"
        " WHEN 'signup' THEN 'social' ELSE 'other' END AS channel",
        "CASE WHEN event_id % 101 = 0 THEN '' WHEN event_id % 103 = 0 THEN 'CX' ELSE concat('C', user_id) END AS customer_id",
        "CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 107 = 0 THEN 'OX'"
        " ELSE concat('O', user_id * 7 + event_id % 5) END AS order_id",
        "concat('S', IF(event_id % 37 = 0, -1, (user_id + event_id % 4) % 200)) AS product_sku",
        f"{_pick(CATEGORIES, 'event_id')} AS category",
        "IF(event_id % 5 = 0, 'High', 'Normal') AS priority",
        "'' AS assigned_team",
        "CASE WHEN event_id % 49 = 0 THEN 'A-1' WHEN event_id % 83 = 0 THEN ''"
        " ELSE concat('A', (user_id * 2) div 3 + event_id % 2) END AS agent_id",
        "CASE WHEN event_id % 6 = 0 THEN '' WHEN event_id % 31 = 0 THEN '1.5' WHEN event_id % 157 = 0 THEN 'n/a'"
        " ELSE cast(event_id % 3 AS string) END AS transfers",
        "CASE k % 9 WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN '9' WHEN 3 THEN '4.5' ELSE cast(k % 9 - 3 AS string) END AS csat_score",
        "CASE WHEN event_id % 97 = 0 THEN 'n/a' WHEN event_id % 89 = 0 THEN '-5'"
        " WHEN event_id % 13 = 0 THEN cast(cast(floor(value) AS bigint) AS string) ELSE '' END AS refund_amount_inr",
        "IF(event_id % 26 = 0, '', 'CODE') AS refund_reason_code",
        "IF(event_id % 17 = 0, 'Y', 'N') AS replacement_issued",
        f"{_pick(MESSAGES, 'event_id')} AS customer_message",
        f"{_pick(NOTES, 'event_id')} AS agent_notes",
        "source_system",
    )
    # With the messages, one generated method for all cells is larger than the JVM compiles. Beside a lambda each cell
    # has a method of its own; steps that read no messages leave it out, and their cells stay in one method.
    strips = {"customer_message": lambda c: F.get(F.transform(F.array(c), C.strip), F.lit(0))}
    text = [c for c in rows.columns if c != "raw_seq"]
    return rows.select("raw_seq", *[strips.get(c, C.strip)(c).alias(c) for c in text]).withColumn("stable_row_key", row_key())


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical tickets with parsed columns."""
    return dedup.typed(dedup.canonical(raw_tickets(spark, sf_dir)))


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roster cells from every supplier: movers, open starts and a few reversed intervals."""
    spans = (
        "explode(filter(array("
        "named_struct('part', 0, 'shift_by', 0, 'from_date', IF(s_suppkey % 29 = 7, '', '2023-01-01'),"
        " 'to_date', IF(s_suppkey % 3 = 0, '2024-01-15', '')),"
        "IF(s_suppkey % 3 = 0, named_struct('part', 1, 'shift_by', 1, 'from_date', '2024-01-13', 'to_date', ''), NULL),"
        "IF(s_suppkey % 31 = 5, named_struct('part', 2, 'shift_by', 2, 'from_date', '2024-01-20', 'to_date', '2024-01-10'), NULL)"
        "), s -> s IS NOT NULL)) AS span")
    return table(spark, sf_dir, "supplier").selectExpr("*", spans).selectExpr(
        "concat('A', s_suppkey) AS agent_id", "s_name AS name",
        "IF(s_nationkey % 2 = 0, 'North', 'South') AS site",
        f"{_pick(TEAMS, '(s_nationkey + span.shift_by)')} AS team",
        "IF(s_suppkey % 2 = 0, 'Day', 'Night') AS shift",
        "'1' AS tier", "span.from_date AS from_date", "span.to_date AS to_date",
        "s_suppkey * 4 + span.part AS roster_seq")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "concat('S', p_partkey) AS sku", "p_type AS family", "p_partkey AS seq")


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return family_map(products(spark, sf_dir), seq="seq")


def reference_keys(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """One-column key tables for the orphan checks."""
    return {
        "order_id": table(spark, sf_dir, "orders").selectExpr("concat('O', o_orderkey) AS key"),
        "customer_id": table(spark, sf_dir, "customer").selectExpr("concat('C', c_custkey) AS key"),
        "product_sku": products(spark, sf_dir).selectExpr("sku AS key"),
        "agent_id": table(spark, sf_dir, "supplier").selectExpr("concat('A', s_suppkey) AS key"),
    }


def text_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets whose message is a whole document; five weeks by document id."""
    return scale.spread_single_file(table(spark, sf_dir, "documents"), "doc_id").selectExpr(
        "doc_id AS first_seq", "doc_id", "concat('TK-', doc_id) AS ticket_id",
        "text AS customer_message", "IF(doc_id % 4 = 0, concat('seen in ', source), '') AS agent_notes",
        "source AS category", "lang AS product_family", "n_chars",
        "date_add(DATE'2024-01-01', 7 * cast(doc_id % 5 AS int)) AS week_start")


def labelled_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review rows for every labelled document, before the reviewer's corrections."""
    docs = table(spark, sf_dir, "documents")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").selectExpr(
        "concat('IT-', doc_id) AS item_id",
        "CASE doc_id % 3 WHEN 0 THEN 'theme' WHEN 1 THEN 'repeat' ELSE 'refund' END AS stratum",
        "concat('TK-', doc_id) AS ticket_id",
        "CASE doc_id % 3 WHEN 0 THEN IF(n_chars >= 400, 'good', 'poor')"
        " WHEN 1 THEN IF(n_chars >= 900, 'same-issue', 'not-same-issue') ELSE 'open' END AS predicted",
        "CASE lang WHEN 'en' THEN 'taxonomy' WHEN 'fr' THEN 'rule' ELSE 'rule-fallback' END AS method",
        "'' AS human_label", "'' AS notes")


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewer corrections: items whose quality or toxicity label contradicts the default."""
    return table(spark, sf_dir, "labels").where("quality = 0 OR toxic = 1").selectExpr(
        "concat('IT-', doc_id) AS item_id",
        "CASE doc_id % 3 WHEN 0 THEN IF(quality = 1, 'good', 'poor')"
        " WHEN 1 THEN IF(toxic = 1, 'not-same-issue', 'same-issue')"
        " ELSE IF(toxic = 1, 'confirmed-violation', 'violation') END AS human_label",
        "concat('quality ', quality, ' toxic ', toxic) AS notes")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.evaluation import apply_labels
    return apply_labels(labelled_sample(spark, sf_dir), corrections(spark, sf_dir))


RESPONSE_BATCH = 20
RESPONSE_THEMES = ["Articles", "Prepositions", "Verbs", "Joins"]


RETRY = 1_000_000


def taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n,) for n in RESPONSE_THEMES], "name string")


def batch_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by batch; every thirteenth batch is asked for a second time, under a later number."""
    batch = f"doc_id div {RESPONSE_BATCH}"
    return table(spark, sf_dir, "documents").selectExpr(
        f"explode(IF({batch} % 13 = 0, array({batch}, {batch} + {RETRY}), array({batch}))) AS batch_id",
        "concat('TK-', doc_id) AS ticket_id", "doc_id")


def model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply per batch of documents. Some are broken on purpose: bad JSON, text behind the object,
    single quotes, ids that are numbers, a theme outside the taxonomy, an unknown id, an id used twice.
    Every eleventh document gets no label; a second answer names other themes than the first."""
    shown = batch_members(spark, sf_dir).where("doc_id % 11 <> 3").selectExpr(
        "batch_id", "doc_id", "ticket_id",
        f"{_pick(RESPONSE_THEMES, f'(doc_id + batch_id div {RETRY})')} AS theme")
    per_theme = shown.groupBy("batch_id", "theme").agg(
        F.sort_array(F.collect_list("ticket_id")).alias("ids"))
    items = per_theme.selectExpr(
        "batch_id", "theme",
        "IF(batch_id % 13 = 4 AND theme = 'Verbs', 'Gossip', theme) AS shown_theme",
        "CASE WHEN batch_id % 13 = 7 AND theme = 'Joins' THEN concat(ids, array('TK-unknown'))"
        " WHEN batch_id % 13 = 9 AND theme = 'Joins' THEN concat(ids, array(ids[0])) ELSE ids END AS evidence"
    ).selectExpr("batch_id", "theme", "to_json(named_struct('theme', shown_theme, 'summary', 's',"
                 " 'evidence_ticket_ids', evidence, 'confidence', 0.9D)) AS item")
    whole = items.groupBy("batch_id").agg(
        F.sort_array(F.collect_list(F.struct("theme", "item"))).alias("rows")).selectExpr(
        "batch_id", "concat('{\"themes\":[', array_join(rows.item, ','), IF(batch_id % 13 = 2, '', ']}')) AS response")
    return whole.selectExpr(
        "batch_id", "CASE batch_id % 13 WHEN 5 THEN concat(response, ' Hope this helps!')"
        " WHEN 6 THEN replace(response, '\"', \"'\")"
        " WHEN 8 THEN regexp_replace(response, '\"TK-([0-9]+)\"', '$1') ELSE response END AS response")


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draft of figures per document and a text that repeats all, some or none of them."""
    return table(spark, sf_dir, "documents").selectExpr(
        "concat('TK-', doc_id) AS ticket_id",
        "to_json(named_struct('ticket', concat('TK-', doc_id), 'chars', n_chars,"
        " 'share', concat(doc_id % 100, '.5%'), 'week', '2024-01-08')) AS draft",
        "CASE doc_id % 3 WHEN 0 THEN concat('Week 2024-01-08: TK-', doc_id, ' has ', n_chars, ' chars, ', doc_id % 100, '.5% of all. ', text)"
        " WHEN 1 THEN concat('TK-', doc_id, ' has ', n_chars, ' chars. ', text) ELSE text END AS polished")

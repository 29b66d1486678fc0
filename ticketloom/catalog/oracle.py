"""DuckDB SQL for the registered queries, written apart from the operators.

The shared CTEs derive the same cells from the driver's tables and parse them with DuckDB's own
functions; each query then states its result in plain SQL.
"""
from __future__ import annotations

from .. import policy as PO
from . import bindings as B


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_text(v) for v in values) + "]"


def _pick(values: list[str], index: str) -> str:
    return f"list_extract({_list(values)}, ({index} % {len(values)})::INT + 1)"


def _case(column: str, values: dict, default: str) -> str:
    arms = " ".join(f"WHEN {_text(k)} THEN {_text(v) if isinstance(v, str) else v}" for k, v in values.items())
    return f"CASE {column} {arms} ELSE {default} END"


RAW = f"""
ev AS (
  SELECT e.*, (e.props::JSON ->> 'k')::INT AS k, c.copy
  FROM events e, LATERAL (SELECT unnest(CASE WHEN e.event_id % 18 = 5 THEN [0, 1] ELSE [0] END) AS copy) c
),
ev1 AS (
  SELECT *, CASE WHEN (event_id + copy) % 4 = 1 THEN 'legacy_fd' ELSE 'helpdesk' END AS source_system,
    CASE WHEN event_id % 23 = 0 THEN NULL ELSE ts + to_seconds(floor(60 * value)) END AS first_ts
  FROM ev
),
ev2 AS (
  SELECT *, CASE WHEN event_id % 10 < 2 THEN NULL
      WHEN source_system = 'legacy_fd' THEN ts + to_minutes(10 * k - 330)
      ELSE coalesce(first_ts, ts) + to_minutes(10 * k) END AS done_ts
  FROM ev1
),
raw AS (
  SELECT 2 * event_id + copy AS raw_seq, 'TK-' || event_id AS ticket_id,
    CASE WHEN event_id % 211 = 0 THEN 'not-a-date' WHEN event_id % 19 = 0 THEN strftime(ts, '%Y-%m-%d')
      WHEN event_id % 7 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN event_id % 7 = 1 THEN strftime(ts, '%Y-%m-%d %H:%M')
      ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS created_at,
    CASE WHEN event_id % 199 = 0 THEN 'soon' ELSE coalesce(strftime(first_ts, '%Y-%m-%d %H:%M:%S'), '') END AS first_response_at,
    coalesce(strftime(done_ts, '%Y-%m-%d %H:%M:%S'), '') AS resolved_at,
    CASE event_id % 10 WHEN 0 THEN 'open' WHEN 1 THEN 'pending' WHEN 2 THEN 'Closed' ELSE 'resolved' END AS status,
    CASE event_type WHEN 'click' THEN 'Chat' WHEN 'view' THEN 'email' WHEN 'purchase' THEN 'voice'
      WHEN 'signup' THEN 'social' ELSE 'other' END AS channel,
    CASE WHEN event_id % 101 = 0 THEN '' WHEN event_id % 103 = 0 THEN 'CX' ELSE 'C' || user_id END AS customer_id,
    CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 107 = 0 THEN 'OX'
      ELSE 'O' || (user_id * 7 + event_id % 5) END AS order_id,
    'S' || CASE WHEN event_id % 37 = 0 THEN -1 ELSE (user_id + event_id % 4) % 200 END AS product_sku,
    {_pick(B.CATEGORIES, 'event_id')} AS category,
    CASE WHEN event_id % 49 = 0 THEN 'A-1' WHEN event_id % 83 = 0 THEN ''
      ELSE 'A' || ((user_id * 2) // 3 + event_id % 2) END AS agent_id,
    CASE WHEN event_id % 6 = 0 THEN '' WHEN event_id % 31 = 0 THEN '1.5' WHEN event_id % 157 = 0 THEN 'n/a'
      ELSE (event_id % 3)::VARCHAR END AS transfers,
    CASE k % 9 WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN '9' WHEN 3 THEN '4.5' ELSE (k % 9 - 3)::VARCHAR END AS csat_score,
    CASE WHEN event_id % 97 = 0 THEN 'n/a' WHEN event_id % 89 = 0 THEN '-5'
      WHEN event_id % 13 = 0 THEN floor(value)::BIGINT::VARCHAR ELSE '' END AS refund_amount_inr,
    CASE WHEN event_id % 26 = 0 THEN '' ELSE 'CODE' END AS refund_reason_code,
    CASE WHEN event_id % 17 = 0 THEN 'Y' ELSE 'N' END AS replacement_issued,
    {_pick(B.MESSAGES, 'event_id')} AS customer_message,
    {_pick(B.NOTES, 'event_id')} AS agent_notes,
    source_system
  FROM ev2
)"""

_TARGETS = _case("channel_key", PO.SLA_TARGET_MINUTES, "NULL")
_RATES = _case("channel_key", PO.CONTACT_RATE_INR, str(PO.BLENDED_CONTACT_RATE_INR))

TICKETS = RAW + f""",
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY CASE WHEN source_system = 'helpdesk' THEN 0 ELSE 1 END, raw_seq) AS rn,
    min(raw_seq) OVER (PARTITION BY ticket_id) AS first_seq
  FROM raw
),
parsed AS (
  SELECT * EXCLUDE (rn),
    try_cast(replace(created_at, 'T', ' ') AS TIMESTAMP) AS created_ts,
    try_cast(first_response_at AS TIMESTAMP) AS first_ts,
    try_cast(resolved_at AS TIMESTAMP) AS done_ts,
    lower(channel) AS channel_key, lower(status) AS status_key,
    CASE WHEN regexp_matches(csat_score, '^[1-5]$') THEN csat_score::INT END AS csat,
    CASE WHEN regexp_matches(transfers, '^[0-9.]+$') THEN transfers::DOUBLE END AS moved,
    CASE WHEN regexp_matches(refund_amount_inr, '^-?[0-9]+$') THEN refund_amount_inr::DOUBLE END AS refund
  FROM ordered WHERE rn = 1
),
t AS (
  SELECT *, date_trunc('week', created_ts)::DATE AS week_start, date_trunc('week', done_ts)::DATE AS resolved_week,
    done_ts::DATE AS resolved_day, status_key IN ('resolved', 'closed') AS is_done,
    epoch_us(first_ts) - epoch_us(created_ts) > 60000000::BIGINT * {_TARGETS} AS late,
    {_RATES} AS rate
  FROM parsed
),
wk AS (SELECT * FROM t WHERE week_start IS NOT NULL),
att AS (SELECT * FROM t WHERE is_done AND resolved_week IS NOT NULL)"""

ROSTER = f"""
roster AS (
  SELECT 'A' || s_suppkey AS agent_id, s_name AS name, CASE WHEN s_nationkey % 2 = 0 THEN 'North' ELSE 'South' END AS site,
    {_pick(B.TEAMS, '(s_nationkey + p.part)')} AS team,
    CASE WHEN s_suppkey % 2 = 0 THEN 'Day' ELSE 'Night' END AS shift,
    CASE p.part WHEN 0 THEN CASE WHEN s_suppkey % 29 = 7 THEN NULL ELSE DATE '2023-01-01' END
      WHEN 1 THEN DATE '2024-01-13' ELSE DATE '2024-01-20' END AS lo,
    CASE p.part WHEN 0 THEN CASE WHEN s_suppkey % 3 = 0 THEN DATE '2024-01-15' END
      WHEN 2 THEN DATE '2024-01-10' END AS hi,
    s_suppkey * 4 + p.part AS roster_seq
  FROM supplier, (SELECT unnest([0, 1, 2]) AS part) p
  WHERE p.part = 0 OR (p.part = 1 AND s_suppkey % 3 = 0) OR (p.part = 2 AND s_suppkey % 31 = 5)
)"""

ASOF = TICKETS + "," + ROSTER + """,
placed AS (
  SELECT a.*, r.name, r.team, r.site, r.shift, r.agent_id IS NOT NULL AS found
  FROM att a LEFT JOIN roster r
    ON r.agent_id = a.agent_id AND r.lo <= a.resolved_day AND (r.hi IS NULL OR a.resolved_day <= r.hi)
  QUALIFY row_number() OVER (PARTITION BY a.ticket_id ORDER BY r.lo DESC NULLS LAST, r.roster_seq) = 1
),
sides AS (
  SELECT *, team IN ('Chat Frontline', 'Email Frontline', 'Voice Frontline') AS tier1 FROM placed WHERE found
),
board AS (
  SELECT resolved_week, tier1, agent_id, arg_min(name, first_seq) AS agent_name, arg_min(team, first_seq) AS team,
    arg_min(shift, first_seq) AS shift, arg_min(site, first_seq) AS site, count(*) AS tickets_completed
  FROM sides GROUP BY resolved_week, tier1, agent_id
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY resolved_week, tier1 ORDER BY tickets_completed DESC, agent_id) AS rank FROM board
)"""

PAIRS = """
chain AS (
  SELECT *, lag(ticket_id) OVER w AS p_id, lag(done_ts) OVER w AS p_done, lag(source_system) OVER w AS p_src,
    lag(order_id) OVER w AS p_order, lag(product_sku) OVER w AS p_sku, lag(category) OVER w AS p_cat
  FROM t WINDOW w AS (PARTITION BY customer_id ORDER BY created_ts NULLS FIRST, first_seq)
),
pairs AS (
  SELECT week_start, p_id AS prior_ticket_id, ticket_id AS repeat_ticket_id, customer_id,
    printf('%.2f', ((epoch_us(created_ts) - epoch_us(p_done))::DOUBLE / 1000000 / 86400)::DOUBLE)::DOUBLE AS gap_days,
    p_src = 'helpdesk' AS prior_trusted_gap,
    order_id <> '' AND order_id = p_order AS same_order, product_sku = p_sku AS same_product,
    category = p_cat AS same_category, channel AS repeat_channel, category AS repeat_category
  FROM chain
  WHERE epoch_us(created_ts) - epoch_us(p_done) BETWEEN 0 AND 30 * 86400000000
),
pair_weeks AS (
  SELECT week_start, count(*) AS repeat_candidates,
    count(*) FILTER (WHERE same_product AND (same_order OR same_category)) AS repeat_same_issue
  FROM pairs GROUP BY week_start
)"""
WITH_PAIRS = TICKETS + "," + PAIRS


def _hits(text: str, patterns: list[str]) -> str:
    return " + ".join(f"regexp_matches({text}, {_text(p)})::INT" for p in patterns)


def _themed(source: str, rules: PO.ThemeRules) -> str:
    """Scored tickets ``sc`` from a relation with message, notes and category."""
    hits = {t: _hits("body", p) for t, p in rules.patterns.items()}
    names = _list(rules.patterns)
    per_theme = ", ".join(f"({h}) AS h{i}" for i, h in enumerate(hits.values()))
    best = "greatest(" + ", ".join(f"h{i} * 100 - {i}" for i in range(len(hits))) + ")"
    stored_hits = "CASE stored " + " ".join(
        f"WHEN {_text(t)} THEN h{i}" for i, t in enumerate(rules.patterns)) + " ELSE 0 END"
    return f"""
body AS (SELECT *, lower(coalesce(customer_message, '') || chr(10) || coalesce(agent_notes, '')) AS body FROM {source}),
hit AS (SELECT *, {_case('category', rules.category_themes, 'NULL')} AS stored, {per_theme} FROM body),
top AS (SELECT *, {best} AS best FROM hit),
sc AS (
  SELECT *, list_extract({names}, ((100 - best % 100) % 100)::INT + 1) AS winner, (best + (100 - best % 100) % 100) // 100 AS winner_hits,
    {stored_hits} AS stored_hits
  FROM top
),
assigned AS (
  SELECT *, CASE WHEN stored IS NOT NULL THEN stored WHEN winner_hits > 0 THEN winner ELSE {_text(rules.other)} END AS theme,
    CASE WHEN stored IS NOT NULL THEN 1.0 WHEN winner_hits > 0 THEN 0.7 ELSE 0.3 END::DOUBLE AS confidence,
    CASE WHEN stored IS NOT NULL THEN 'taxonomy' WHEN winner_hits > 0 THEN 'rule' ELSE 'rule-fallback' END AS method
  FROM sc
)"""


THEMES = TICKETS + "," + _themed("t", PO.DEFAULT_RULES)
DOCS = """
docs AS (
  SELECT doc_id AS first_seq, doc_id, 'TK-' || doc_id AS ticket_id, text AS customer_message,
    CASE WHEN doc_id % 4 = 0 THEN 'seen in ' || source ELSE '' END AS agent_notes, source AS category,
    lang AS product_family, n_chars, DATE '2024-01-01' + (7 * (doc_id % 5))::INT AS week_start
  FROM documents
)"""
DOC_THEMES = DOCS + "," + _themed("docs", B.WORD_RULES)

COUNTS = """
counts AS (
  SELECT week_start, theme, count(*) AS n,
    row_number() OVER (PARTITION BY week_start ORDER BY count(*) DESC, min(first_seq)) AS position
  FROM assigned WHERE week_start IS NOT NULL GROUP BY week_start, theme
),
totals AS (SELECT week_start, sum(n)::BIGINT AS total FROM counts GROUP BY week_start),
sections AS (
  SELECT c.week_start, c.position, c.theme, c.n, tt.total, printf('%.1f', (c.n * 100.0::DOUBLE / tt.total)::DOUBLE)::DOUBLE AS pct,
    c.n - coalesce(p.n, 0) AS wow,
    printf('%.1f', (c.n * 100.0::DOUBLE / tt.total - coalesce(p.n, 0) * 100.0::DOUBLE / greatest(coalesce(pt.total, 0), 1))::DOUBLE)::DOUBLE AS wow_pp
  FROM counts c JOIN totals tt USING (week_start)
  LEFT JOIN counts p ON p.week_start = c.week_start - 7 AND p.theme = c.theme
  LEFT JOIN totals pt ON pt.week_start = c.week_start - 7
)"""
DIGEST = THEMES + "," + COUNTS

FIGURES = """
figures AS (
  SELECT week_start, count(*) AS volume, count(*) FILTER (WHERE late) AS sla_breaches,
    count(*) FILTER (WHERE late IS NULL) AS sla_missing, count(csat) AS csat_n,
    printf('%.2f', (count(csat) * 100.0::DOUBLE / count(*))::DOUBLE)::DOUBLE AS response_rate_pct,
    printf('%.3f', (avg(csat))::DOUBLE)::DOUBLE AS csat_mean, sum(rate)::BIGINT AS contact_cost_inr,
    coalesce(sum(moved) FILTER (WHERE moved = floor(moved)), 0)::BIGINT AS transfers,
    count(*) FILTER (WHERE late AND channel_key = 'email') AS email_breaches,
    count(*) FILTER (WHERE refund_amount_inr <> '' AND replacement_issued = 'Y') AS conflicts
  FROM wk GROUP BY week_start
)"""
ACTIONS = """
todo AS (
  SELECT week_start, 'spike' AS action, theme AS subject, wow AS value FROM sections
  WHERE wow >= 10 AND theme <> 'Other / Unclassified'
  UNION ALL SELECT week_start, 'email_tail', 'email', email_breaches FROM figures WHERE email_breaches > 10
  UNION ALL SELECT week_start, 'conflict', 'refund+replacement', conflicts FROM figures WHERE conflicts > 0
  UNION ALL SELECT week_start, 'repeats', 'repeat candidates', repeat_candidates FROM pair_weeks WHERE repeat_candidates > 60
)"""

AGENTS = """
agents AS (
  SELECT resolved_week AS week_start,
    count(DISTINCT CASE WHEN found AND team IN ('Chat Frontline', 'Email Frontline', 'Voice Frontline') THEN agent_id END) AS tier1_agents,
    count(DISTINCT CASE WHEN found AND team NOT IN ('Chat Frontline', 'Email Frontline', 'Voice Frontline') THEN agent_id END) AS specialist_agents,
    count(*) FILTER (WHERE NOT found) AS unresolved_attendance
  FROM placed GROUP BY resolved_week
)"""
KPI = ASOF + "," + PAIRS + "," + FIGURES + "," + AGENTS + """,
kpi AS (
  SELECT week_start, coalesce(volume, 0) AS volume, coalesce(sla_breaches, 0) AS sla_breaches,
    coalesce(sla_missing, 0) AS sla_missing, coalesce(csat_n, 0) AS csat_n, coalesce(contact_cost_inr, 0) AS contact_cost_inr,
    coalesce(transfers, 0) AS transfers, coalesce(transfers, 0) * 305 AS transfer_cost_inr,
    coalesce(sla_breaches, 0) * 350 AS sla_credit_inr, coalesce(repeat_candidates, 0) AS repeat_candidates,
    coalesce(repeat_same_issue, 0) AS repeat_same_issue, coalesce(tier1_agents, 0) AS tier1_agents,
    coalesce(specialist_agents, 0) AS specialist_agents, coalesce(unresolved_attendance, 0) AS unresolved_attendance,
    coalesce(response_rate_pct, 0)::DOUBLE AS response_rate_pct, csat_mean
  FROM figures FULL JOIN agents USING (week_start) LEFT JOIN pair_weeks USING (week_start)
)"""

# Data quality -----------------------------------------------------------------------------
DUPLICATES = """
dups AS (
  SELECT count(*) AS duplicate_ticket_id_groups, coalesce(sum(n - 1), 0)::BIGINT AS duplicate_extra_rows,
    count(*) FILTER (WHERE systems > 1) AS duplicate_cross_system_groups
  FROM (SELECT ticket_id, count(*) AS n, count(DISTINCT source_system) AS systems FROM raw GROUP BY ticket_id) WHERE n > 1
)"""
_SCALARS = {
    "resolved_rows:helpdesk": "source_system = 'helpdesk' AND resolved_at <> ''",
    "resolved_before_first:helpdesk": "source_system = 'helpdesk' AND done_ts < first_ts",
    "resolved_rows:legacy_fd": "source_system = 'legacy_fd' AND resolved_at <> ''",
    "resolved_before_first:legacy_fd": "source_system = 'legacy_fd' AND done_ts < first_ts",
    "first_before_created": "first_ts < created_ts",
    "status_timestamp_mismatch": "is_done <> (resolved_at <> '')",
    "refund_negative": "refund < 0",
    "refund_no_code": "refund IS NOT NULL AND refund_reason_code = ''",
    "refund_non_numeric": "refund_amount_inr <> '' AND refund IS NULL",
    "same_ticket_refund_replacement": "refund IS NOT NULL AND replacement_issued = 'Y'",
    "csat_out_of_range": "csat_score NOT IN ('', '0') AND NOT regexp_matches(csat_score, '^[1-5]$')",
    "transfer_non_integral": "transfers <> '' AND (moved IS NULL OR moved <> floor(moved))",
    "blank_order_id": "order_id = ''",
    "blank_agent_id": "agent_id = ''",
    "blank_customer_id": "customer_id = ''",
    "blank_product_sku": "product_sku = ''",
    "empty_customer_message": "customer_message = ''",
    "empty_agent_notes": "agent_notes = ''",
    "invalid_created": "created_ts IS NULL",
    "invalid_first_response": "first_response_at <> '' AND first_ts IS NULL",
    "canonical_rows": "true",
}


def _checks(names) -> str:
    rows = []
    for n in names:
        check, _, scope = n.partition(":")
        rows.append(f"SELECT {_text(check)} AS \"check\", {_text(scope or 'all')} AS scope,"
                    f" count(*) FILTER (WHERE {_SCALARS[n]}) AS value FROM t")
    return " UNION ALL ".join(rows)


CROSS = """
per_order AS (
  SELECT order_id, list(ticket_id) FILTER (WHERE refund_amount_inr <> '') AS r,
    list(ticket_id) FILTER (WHERE replacement_issued = 'Y') AS p
  FROM t WHERE order_id <> '' GROUP BY order_id
),
crossed AS (SELECT * FROM per_order WHERE len(r) > 0 AND len(p) > 0 AND NOT list_has_any(r, p)),
cross_rows AS (
  SELECT order_id, 'refund' AS role, unnest(r) AS ticket_id FROM crossed
  UNION ALL SELECT order_id, 'replacement', unnest(p) FROM crossed
)"""
OVERLAPS = """
spans AS (SELECT agent_id, coalesce(lo, DATE '1900-01-01') AS lo, coalesce(hi, DATE '9999-12-31') AS hi, roster_seq FROM roster),
overlapping AS (
  SELECT a.agent_id, count(b.roster_seq) AS overlaps FROM spans a LEFT JOIN spans b
    ON a.agent_id = b.agent_id AND a.roster_seq < b.roster_seq AND a.lo <= b.hi AND b.lo <= a.hi
  GROUP BY a.agent_id
)"""
UNRESOLVED = """
dayed AS (SELECT *, coalesce(done_ts, created_ts)::DATE AS any_day FROM t),
known AS (
  SELECT d.*, EXISTS (SELECT 1 FROM roster r WHERE r.agent_id = d.agent_id AND r.lo <= d.any_day
    AND (r.hi IS NULL OR d.any_day <= r.hi)) AS found
  FROM dayed d
),
lost AS (
  SELECT count(*) FILTER (WHERE NOT found) AS roster_unresolved_any_row,
    count(*) FILTER (WHERE is_done AND (done_ts IS NULL OR NOT found)) AS roster_unresolved_attendance FROM known
)"""
_REFS = {
    "order_id": "SELECT 'O' || o_orderkey FROM orders", "customer_id": "SELECT 'C' || c_custkey FROM customer",
    "product_sku": "SELECT 'S' || p_partkey FROM part", "agent_id": "SELECT 'A' || s_suppkey FROM supplier",
}
ORPHANS = "\norphan AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} <> '' AND {c} NOT IN ({q})) AS orphans FROM t"
    for c, q in _REFS.items()) + ")"

# Terms ------------------------------------------------------------------------------------
_STOP = ", ".join(_text(w) for w in B.STOP_WORDS)


def _grams(source: str, keys: str, text: str) -> str:
    """``gram``: every word and neighbouring pair per row of ``source``."""
    return f"""
tok AS (SELECT {keys}, list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({_STOP})) AS words FROM {source}),
gram AS (
  SELECT {keys}, unnest(words) AS term FROM tok
  UNION ALL SELECT {keys}, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS term FROM tok WHERE len(words) > 1
)"""


def _tfidf(source: str) -> str:
    return f"""
sizes AS (SELECT grp, count(*) AS n FROM {source} GROUP BY grp HAVING count(*) >= 3),
big AS (SELECT s.* FROM {source} s JOIN sizes USING (grp)),
{_grams('big', 'id, grp', 'text').strip()},
tf AS (SELECT grp, id, term, count(*) AS tf FROM gram GROUP BY grp, id, term),
vocab AS (
  SELECT grp, term, ln((1 + n) / (1 + count(*))) + 1 AS idf
  FROM tf JOIN sizes USING (grp) GROUP BY grp, term, n
  QUALIFY row_number() OVER (PARTITION BY grp ORDER BY sum(tf) DESC, term) <= 500
),
weighted AS (SELECT grp, id, term, tf * idf AS w FROM tf JOIN vocab USING (grp, term)),
norms AS (SELECT id, sqrt(sum(w * w)) AS norm FROM weighted GROUP BY id),
scored AS (
  SELECT grp, term, printf('%.9f', (sum(w / norm) / max(n))::DOUBLE)::DOUBLE AS score
  FROM weighted JOIN norms USING (id) JOIN sizes USING (grp) GROUP BY grp, term
),
top_terms AS (
  SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY score DESC, term) AS rank, term,
    printf('%.6f', (score)::DOUBLE)::DOUBLE AS score FROM scored
  QUALIFY rank <= 5
)"""


def _rising(source: str) -> str:
    return _grams(source, "week_start", "customer_message") + f""",
n AS (SELECT week_start, count(*) AS n FROM {source} WHERE week_start IS NOT NULL GROUP BY week_start),
c AS (SELECT week_start, term, count(*) AS c FROM gram WHERE week_start IS NOT NULL GROUP BY week_start, term),
both_weeks AS (
  SELECT week_start, term, sum(now) AS now, sum(before) AS before FROM (
    SELECT week_start, term, c AS now, 0 AS before FROM c
    UNION ALL SELECT week_start + 7, term, 0, c FROM c) GROUP BY week_start, term
),
frequent AS (
  SELECT * FROM both_weeks QUALIFY row_number() OVER (PARTITION BY week_start ORDER BY now + before DESC, term) <= 1000
),
gains AS (
  SELECT f.week_start, term, printf('%.4f', (f.now::DOUBLE / a.n - f.before::DOUBLE / b.n)::DOUBLE)::DOUBLE AS gain
  FROM frequent f JOIN n a USING (week_start) JOIN n b ON b.week_start = f.week_start - 7
  WHERE b.n >= 20 AND f.now::DOUBLE / a.n > f.before::DOUBLE / b.n AND f.now >= 3
),
rising AS (
  SELECT week_start, row_number() OVER (PARTITION BY week_start ORDER BY gain DESC, term) AS rank, term, gain
  FROM gains QUALIFY rank <= 8
)"""


_GROUPED_DOCS = DOCS + """,
grouped AS (
  SELECT doc_id AS id, week_start, category || ' | ' || product_family AS grp,
    lower(customer_message || chr(10) || agent_notes) AS text FROM docs
)"""
_GROUPED_TICKETS = TICKETS + """,
grouped AS (
  SELECT t.ticket_id AS id, t.category || ' | ' || coalesce(p.p_type, '?') AS grp,
    lower(customer_message || chr(10) || agent_notes) AS text
  FROM t LEFT JOIN part p ON t.product_sku = 'S' || p.p_partkey
)"""

# Replies ----------------------------------------------------------------------------------
REPLIES = f"""
members AS (
  SELECT doc_id // {B.RESPONSE_BATCH} AS batch_id, 'TK-' || doc_id AS ticket_id, doc_id FROM documents
  UNION ALL SELECT doc_id // {B.RESPONSE_BATCH} + {B.RETRY}, 'TK-' || doc_id, doc_id FROM documents WHERE (doc_id // {B.RESPONSE_BATCH}) % 13 = 0
),
claims AS (
  SELECT batch_id, ticket_id, {_pick(B.RESPONSE_THEMES, f'(doc_id + batch_id // {B.RETRY})')} AS theme FROM members WHERE doc_id % 11 <> 3
),
reply AS (
  SELECT batch_id, batch_id % 13 IN (2, 5, 6, 8) AS broken,
    batch_id % 13 = 4 AND bool_or(theme = 'Verbs') AS off_taxonomy,
    batch_id % 13 = 9 AND bool_or(theme = 'Joins') AS repeated_id,
    CASE WHEN batch_id % 13 = 7 AND bool_or(theme = 'Joins') THEN 1 ELSE 0 END::BIGINT AS unknown_ids
  FROM claims GROUP BY batch_id
),
judged AS (
  SELECT *, NOT broken AND NOT off_taxonomy AND NOT repeated_id AND unknown_ids = 0 AS accepted FROM reply
),
good AS (SELECT c.* FROM claims c JOIN judged j USING (batch_id) WHERE j.accepted),
latest AS (SELECT ticket_id, arg_max(theme, batch_id) AS theme FROM good GROUP BY ticket_id)"""

# Labels -----------------------------------------------------------------------------------
_METRICS = """
th AS (SELECT *, human_label = predicted AS ok FROM lab WHERE stratum = 'theme'),
cells AS (
  SELECT count(*) AS n,
    count(*) FILTER (WHERE predicted = 'same-issue' AND human_label = 'same-issue') AS tp,
    count(*) FILTER (WHERE predicted = 'same-issue' AND human_label <> 'same-issue') AS fp,
    count(*) FILTER (WHERE predicted <> 'same-issue' AND human_label = 'same-issue') AS fn,
    count(*) FILTER (WHERE predicted <> 'same-issue' AND human_label <> 'same-issue') AS tn
  FROM lab WHERE stratum = 'repeat'
),
acc AS (SELECT count(*) AS n, count(*) FILTER (WHERE ok) AS agree, printf('%.3f', (count(*) FILTER (WHERE ok)::DOUBLE / count(*))::DOUBLE)::DOUBLE AS accuracy FROM th),
acc_m AS (SELECT method, count(*) AS n, count(*) FILTER (WHERE ok) AS agree, printf('%.3f', (count(*) FILTER (WHERE ok)::DOUBLE / count(*))::DOUBLE)::DOUBLE AS accuracy FROM th GROUP BY method),
conf AS (
  SELECT n, tp, fp, fn, tn, printf('%.3f', (CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END)::DOUBLE)::DOUBLE AS precision,
    printf('%.3f', (CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END)::DOUBLE)::DOUBLE AS recall,
    printf('%.3f', (CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END)::DOUBLE)::DOUBLE AS f1 FROM cells
),
ref AS (
  SELECT count(*) AS n, count(*) FILTER (WHERE human_label = 'confirmed-violation') AS same_ticket_confirmed,
    count(*) FILTER (WHERE human_label = 'violation') AS same_order_violations FROM lab WHERE stratum = 'refund'
)"""
LABELS = """
sample AS (
  SELECT 'IT-' || doc_id AS item_id, CASE doc_id % 3 WHEN 0 THEN 'theme' WHEN 1 THEN 'repeat' ELSE 'refund' END AS stratum,
    CASE doc_id % 3 WHEN 0 THEN CASE WHEN n_chars >= 400 THEN 'good' ELSE 'poor' END
      WHEN 1 THEN CASE WHEN n_chars >= 900 THEN 'same-issue' ELSE 'not-same-issue' END ELSE 'open' END AS predicted,
    CASE lang WHEN 'en' THEN 'taxonomy' WHEN 'fr' THEN 'rule' ELSE 'rule-fallback' END AS method,
    CASE WHEN quality = 0 OR toxic = 1 THEN CASE doc_id % 3 WHEN 0 THEN CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END
      WHEN 1 THEN CASE WHEN toxic = 1 THEN 'not-same-issue' ELSE 'same-issue' END
      ELSE CASE WHEN toxic = 1 THEN 'confirmed-violation' ELSE 'violation' END END END AS fix,
    'quality ' || quality || ' toxic ' || toxic AS fix_note
  FROM labels JOIN documents USING (doc_id)
),
lab AS (
  SELECT item_id, stratum, predicted, method, coalesce(fix, predicted) AS human_label,
    CASE WHEN fix IS NULL THEN '' ELSE fix_note END AS notes FROM sample
)
""".rstrip() + "," + _METRICS

def _excerpt(message: str, notes: str, size: int) -> str:
    joined = f"'MSG: ' || trim({message}, {_WS}) || ' || NOTES: ' || trim({notes}, {_WS})"
    flat = f"regexp_replace({joined}, '[\\s\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{3000}}]+', ' ', 'g')"
    return f"substring(trim({flat}), 1, {size})"


_WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160)"

_PICKS = """
disagree AS (SELECT ticket_id FROM assigned WHERE stored IS NOT NULL AND winner_hits > 0 AND stored <> winner),
pool AS (SELECT theme, method, ticket_id, md5(ticket_id || ':42') AS draw FROM assigned),
first_picks AS (
  SELECT * FROM pool WHERE method <> 'rule-fallback'
  QUALIFY row_number() OVER (PARTITION BY theme, method ORDER BY draw, ticket_id) <= CASE method WHEN 'taxonomy' THEN 2 ELSE 1 END
),
hard AS (
  SELECT * FROM pool WHERE (method = 'rule-fallback' OR ticket_id IN (SELECT ticket_id FROM disagree))
    AND ticket_id NOT IN (SELECT ticket_id FROM first_picks)
  QUALIFY row_number() OVER (PARTITION BY theme ORDER BY draw, ticket_id) = 1
),
picks AS (SELECT theme, method, ticket_id FROM first_picks UNION ALL SELECT theme, method, ticket_id FROM hard)"""

_PAIR_PICKS = """
flagged AS (SELECT *, CASE WHEN same_product AND (same_order OR same_category) THEN 'same-issue' ELSE 'not-same-issue' END AS predicted FROM pairs),
pair_picks AS (
  SELECT * FROM flagged
  QUALIFY row_number() OVER (PARTITION BY predicted ORDER BY md5(repeat_ticket_id || ':' || prior_ticket_id || ':42'), repeat_ticket_id, prior_ticket_id) <= 15
)"""
_METHOD = ("'same_order=' || CASE WHEN same_order THEN 'True' ELSE 'False' END || ' same_product=' || CASE WHEN same_product THEN 'True' ELSE 'False' END"
           " || ' same_category=' || CASE WHEN same_category THEN 'True' ELSE 'False' END || ' gap=' || gap_days::VARCHAR || 'd'")
_REFUND_ITEMS = f"""
refund_orders AS (SELECT * FROM cross_rows WHERE order_id IN (SELECT DISTINCT order_id FROM cross_rows ORDER BY order_id LIMIT 4)),
refund_items AS (
  SELECT 'RF-' || ticket_id AS item_id, ticket_id, '' AS pair_id,
    'conflict refund=' || refund_amount_inr || ' replacement=' || replacement_issued || ' order=' || order_id AS predicted,
    'same-ticket' AS method, {_excerpt('customer_message', 'agent_notes', 300)} AS text, channel, source_system
  FROM (SELECT * FROM t WHERE refund IS NOT NULL AND replacement_issued = 'Y' ORDER BY ticket_id LIMIT 4)
  UNION ALL
  SELECT 'RF-' || order_id, '', order_id, 'same-order co-occurrence order=' || order_id, 'cross-ticket', count(*) || ' tickets', '', ''
  FROM refund_orders GROUP BY order_id
)"""

# Shown figures of the audit; ``planted`` makes every ticket of one week late.
_PLANTED = "(week_start = DATE '2024-01-08' OR late)"


def _audit(late: str = "late") -> str:
    return KPI + "," + _themed("t", PO.DEFAULT_RULES) + "," + COUNTS + f""",
recount AS (
  SELECT week_start, count(*) AS n, count(*) FILTER (WHERE {late}) AS shown, count(*) FILTER (WHERE late) AS again,
    sum(CASE WHEN regexp_matches(transfers, '^-?[0-9]+([.]0*)?$') THEN transfers::DOUBLE ELSE 0 END)::BIGINT AS moves
  FROM wk GROUP BY week_start
),
spent AS (
  SELECT week_start, sum(n * rate)::BIGINT AS cost FROM (SELECT week_start, rate, count(*) AS n FROM wk GROUP BY week_start, rate) GROUP BY week_start
),
per_theme AS (SELECT week_start, theme, count(*) AS n FROM assigned GROUP BY week_start, theme),
checked AS (
  SELECT f.week_start, f.contact_cost_inr, f.transfers, r.*, s.cost
  FROM figures f JOIN recount r ON r.week_start = f.week_start JOIN spent s ON s.week_start = f.week_start
),
audit AS (
  SELECT week_start, 'digest_total==week_rows' AS "check", '' AS subject, total = (SELECT count(*) FROM wk WHERE wk.week_start = totals.week_start) AS ok FROM totals
  UNION ALL SELECT week_start, 'theme_counts_sum==total', '', sum(n) = max(total) FROM sections GROUP BY week_start
  UNION ALL SELECT s.week_start, 'theme_count', s.theme, s.n = p.n FROM sections s JOIN per_theme p ON p.week_start = s.week_start AND p.theme = s.theme
    WHERE s.position <= 5
  UNION ALL SELECT week_start, 'id-date', ticket_id, created_ts::DATE BETWEEN week_start AND week_start + 6
    FROM (SELECT * FROM wk QUALIFY row_number() OVER (PARTITION BY week_start ORDER BY first_seq) <= 10)
  UNION ALL SELECT resolved_week, 'leaderboard_reconciles', '',
    count(*) = coalesce((SELECT sum(tickets_completed) FROM board b WHERE b.resolved_week = a.resolved_week), 0)
      + coalesce((SELECT count(*) FROM placed p WHERE p.resolved_week = a.resolved_week AND NOT p.found), 0)
    FROM att a GROUP BY resolved_week
  UNION ALL SELECT resolved_week, 'tier2_absent_from_board', '', NOT bool_or(team LIKE '%Warranty%') FROM board WHERE tier1 GROUP BY resolved_week
  UNION ALL SELECT week_start, 'sla_breaches_recomputed', '', shown = again FROM checked
  UNION ALL SELECT week_start, 'sla_credit_recomputed', '', shown * 350 = again * 350 FROM checked
  UNION ALL SELECT week_start, 'transfer_count_recomputed', '', transfers = moves FROM checked
  UNION ALL SELECT week_start, 'transfer_cost_recomputed', '', transfers * 305 = moves * 305 FROM checked
  UNION ALL SELECT week_start, 'contact_total_recomputed', '', contact_cost_inr = cost FROM checked
  UNION ALL SELECT week_start, 'repeat_ids_exist', '',
    bool_and(prior_ticket_id IN (SELECT ticket_id FROM t) AND repeat_ticket_id IN (SELECT ticket_id FROM t)) FROM pairs GROUP BY week_start
)"""


def _q(ctes: str, body: str) -> str:
    """A query over the CTEs; a body that starts with a comma brings one more CTE."""
    return f"WITH {ctes.strip()}\n{body}"


def _unpivot(relation: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT {_text(c)} AS \"check\", 'all' AS scope, {c}::BIGINT AS value FROM {relation}" for c in columns)


def all_sql() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql["stable_row_keys"] = _q(RAW, "SELECT raw_seq, ticket_id, ticket_id || '__' || source_system || '__' || raw_seq AS stable_row_key FROM raw")
    sql["dedup_canonical"] = _q(TICKETS, "SELECT ticket_id, source_system, raw_seq, first_seq, status, channel FROM t")
    sql["dedup_quarantine"] = _q(TICKETS, "SELECT ticket_id, source_system, raw_seq FROM ordered WHERE rn > 1")
    sql["dedup_merged"] = _q(RAW, """, numbered AS (SELECT * REPLACE (raw_seq + (raw_seq % 2) * (1::BIGINT << 45) AS raw_seq), raw_seq AS old_seq FROM raw)
      SELECT ticket_id, source_system, raw_seq, min(raw_seq) OVER w AS first_seq, count(*) OVER w AS copies,
        (min(source_system) OVER w) <> (max(source_system) OVER w) AS other_system, trim(status) AS status, trim(channel) AS channel,
        ticket_id || '__' || source_system || '__' || old_seq AS stable_row_key
      FROM numbered WINDOW w AS (PARTITION BY ticket_id)
      QUALIFY row_number() OVER (PARTITION BY ticket_id ORDER BY source_system <> 'helpdesk', raw_seq) = 1""")
    sql["parse_timestamps"] = _q(RAW, """SELECT raw_seq, strftime(try_cast(replace(created_at, 'T', ' ') AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS created,
      strftime(try_cast(first_response_at AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS first_response,
      try_cast(substring(created_at, 1, 10) AS DATE) AS created_day FROM raw""")
    sql["parse_cells"] = _q(TICKETS, """SELECT ticket_id, csat, moved AS transfer_value, refund AS refund_value, channel_key, status_key,
      source_system = 'helpdesk' AND resolved_at <> '' AS trusted FROM t""")
    sql["week_start"] = _q(TICKETS, """SELECT ticket_id, week_start, resolved_week,
      coalesce(created_ts::DATE BETWEEN DATE '2024-01-08' AND DATE '2024-01-14', false) AS in_week_2024_01_08 FROM t""")
    sql["response_minutes"] = _q(TICKETS, """SELECT ticket_id, (epoch_us(first_ts) - epoch_us(created_ts)) / 1000000.0::DOUBLE / 60.0::DOUBLE AS minutes,
      printf('%.4f', ((epoch_us(done_ts) - epoch_us(created_ts)) / 1000000.0::DOUBLE / 86400.0::DOUBLE)::DOUBLE)::DOUBLE AS days, late AS sla_breach FROM t""")
    sql["weekly_volume"] = _q(TICKETS, "SELECT week_start, count(*) AS volume FROM wk GROUP BY week_start")
    sql["week_slices"] = _q(TICKETS, """, v AS (SELECT week_start, count(*) AS volume FROM wk GROUP BY week_start)
      SELECT a.week_start, a.volume, coalesce(b.volume, 0) AS volume_before FROM v a LEFT JOIN v b ON b.week_start = a.week_start - 7""")
    for name, key, label in (("channel_mix_weekly", "channel_key", "channel"), ("status_mix_weekly", "status_key", "status")):
        sql[name] = _q(TICKETS, f"""SELECT week_start, {key} AS {label}, count(*) AS n,
          printf('%.2f', (count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY week_start))::DOUBLE)::DOUBLE AS pct FROM wk GROUP BY week_start, {key}""")
    sql["sla_breaches_weekly"] = _q(TICKETS, "SELECT week_start, channel_key AS channel, count(*) AS breaches FROM wk WHERE late GROUP BY 1, 2")
    sql["sla_missing_weekly"] = _q(TICKETS, "SELECT week_start, count(*) FILTER (WHERE late IS NULL) AS sla_missing FROM wk GROUP BY 1")
    sql["csat_stats_weekly"] = _q(TICKETS + "," + FIGURES, "SELECT week_start, csat_n, response_rate_pct, csat_mean FROM figures")
    sql["transfer_count_weekly"] = _q(TICKETS + "," + FIGURES, "SELECT week_start, transfers FROM figures")
    sql["contact_rates"] = _q(TICKETS, "SELECT ticket_id, rate::BIGINT AS rate_inr FROM t")
    sql["contact_cost_weekly"] = _q(TICKETS, """SELECT week_start, channel_key AS channel, sum(rate)::BIGINT AS cost_inr FROM wk
      GROUP BY GROUPING SETS ((week_start, channel_key), (week_start))""")
    sql["transfer_cost_weekly"] = _q(TICKETS + "," + FIGURES, "SELECT week_start, transfers * 305 AS transfer_cost_inr FROM figures")
    sql["sla_credit_weekly"] = _q(TICKETS + "," + FIGURES, "SELECT week_start, sla_breaches * 350 AS sla_credit_inr FROM figures")
    sql["replacement_cost"] = "SELECT p_partkey, printf('%.2f', (p_retailprice + 340)::DOUBLE)::DOUBLE AS plan_cost FROM part"
    sql["conflicts_weekly"] = _q(TICKETS + "," + FIGURES, "SELECT week_start, conflicts FROM figures")
    sql["attendance_weekly"] = _q(TICKETS, "SELECT resolved_week, count(*) AS attendance FROM att GROUP BY 1")

    sql["roster_asof"] = _q(ASOF, "SELECT resolved_week, ticket_id, agent_id AS agent_key, team, site FROM placed")
    sql["roster_asof_shuffled"] = sql["roster_asof"]
    columns = "resolved_week, agent_id, agent_name, team, shift, site, tickets_completed, rank"
    sql["tier1_leaderboard"] = _q(ASOF, f"SELECT {columns} FROM ranked WHERE tier1")
    sql["specialist_table"] = _q(ASOF, f"SELECT {columns} FROM ranked WHERE NOT tier1")
    sql["leaderboard_top15"] = _q(ASOF, f"SELECT {columns} FROM ranked WHERE tier1 AND rank <= 15")
    sql["unresolved_attendance"] = _q(ASOF, "SELECT resolved_week, ticket_id || ':' || agent_id AS unresolved FROM placed WHERE NOT found")
    sql["board_reconciliation"] = _q(ASOF, """, r AS (SELECT resolved_week, count(*) AS attendance,
        count(*) FILTER (WHERE found AND team LIKE '%Frontline') AS board, count(*) FILTER (WHERE found AND team NOT LIKE '%Frontline') AS specialist,
        count(*) FILTER (WHERE NOT found) AS unresolved FROM placed GROUP BY 1)
      SELECT r.*, board + specialist + unresolved = (SELECT count(*) FROM att a WHERE a.resolved_week = r.resolved_week) AS reconciles FROM r""")
    sql["tier2_absence"] = _q(ASOF, """SELECT resolved_week, count(*) FILTER (WHERE team LIKE '%Warranty%') AS tier2_agents,
      count(*) FILTER (WHERE team LIKE '%Warranty%') = 0 AS absent FROM board WHERE tier1 GROUP BY 1""")

    sql["repeat_pairs"] = _q(WITH_PAIRS, "SELECT * FROM pairs")
    sql["repeat_same_issue"] = _q(WITH_PAIRS, f"SELECT week_start, prior_ticket_id, repeat_ticket_id, {_METHOD} AS method FROM pairs WHERE same_product AND (same_order OR same_category)")
    sql["repeat_same_issue_weekly"] = _q(WITH_PAIRS, "SELECT * FROM pair_weeks")
    sql["repeat_ids_exist"] = _q(WITH_PAIRS, """SELECT count(*) AS strays FROM (SELECT unnest([prior_ticket_id, repeat_ticket_id]) AS id FROM pairs)
      WHERE id NOT IN (SELECT ticket_id FROM t)""")

    sql["dq_duplicates"] = _q(RAW + "," + DUPLICATES, "SELECT * FROM dups")
    names = list(_SCALARS)
    groups = {
        "dq_time_order": names[:5], "dq_status_mismatch": ["status_timestamp_mismatch"], "dq_refunds": names[6:10],
        "dq_csat": ["csat_out_of_range"], "dq_transfers": ["transfer_non_integral"], "dq_blanks": names[12:18],
        "dq_timestamps": names[18:20], "dq_canonical_rows": ["canonical_rows"],
    }
    for name, chosen in groups.items():
        sql[name] = _q(TICKETS, _checks(chosen))
    sql["dq_time_order_by_source"] = _q(TICKETS, """SELECT source_system, count(*) AS n_resolved, count(*) FILTER (WHERE done_ts < first_ts) AS violations
      FROM t WHERE resolved_at <> '' GROUP BY 1""")
    sql["dq_conflict_tickets"] = _q(TICKETS, "SELECT ticket_id FROM t WHERE refund IS NOT NULL AND replacement_issued = 'Y'")
    sql["dq_order_cross_ticket"] = _q(TICKETS + "," + CROSS, "SELECT * FROM cross_rows")
    sql["dq_roster_overlaps"] = _q(ROSTER + "," + OVERLAPS, "SELECT * FROM overlapping")
    sql["dq_roster_unresolved"] = _q(TICKETS + "," + ROSTER + "," + UNRESOLVED, "SELECT * FROM lost")
    sql["dq_orphans"] = _q(TICKETS + "," + ORPHANS, "SELECT * FROM orphan UNION ALL SELECT 'priority', NULL")
    sql["dq_report"] = _q(
        TICKETS + "," + DUPLICATES + "," + CROSS + "," + ROSTER + "," + OVERLAPS + "," + UNRESOLVED + "," + ORPHANS,
        _unpivot("dups", ["duplicate_ticket_id_groups", "duplicate_extra_rows", "duplicate_cross_system_groups"])
        + " UNION ALL " + _checks(names)
        + " UNION ALL SELECT 'same_order_cross_ticket_pairs', 'all', count(*) FROM crossed"
        + " UNION ALL SELECT 'roster_overlaps', 'all', sum(\"overlaps\")::BIGINT FROM overlapping UNION ALL "
        + _unpivot("lost", ["roster_unresolved_any_row", "roster_unresolved_attendance"])
        + " UNION ALL SELECT 'orphan_' || \"column\", 'all', orphans FROM orphan")
    sql["reference_key_counts"] = " UNION ALL ".join(
        f"SELECT '{c}' AS table_key, count(DISTINCT k) AS keys FROM ({q}) AS r(k)" for c, q in _REFS.items())
    sql["family_map"] = "SELECT 'S' || p_partkey AS sku, p_type AS family FROM part"
    sql["family_lookup"] = _q(_GROUPED_TICKETS, "SELECT id AS ticket_id, grp AS group_label FROM grouped")

    sql["theme_scores"] = _q(DOC_THEMES, " UNION ALL ".join(
        f"SELECT ticket_id, {_text(t)} AS theme, h{i} AS hits FROM hit" for i, t in enumerate(B.WORD_RULES.patterns)))
    sql["theme_scores_support"] = _q(THEMES, " UNION ALL ".join(
        f"SELECT {_text(t)} AS theme, sum(h{i})::BIGINT AS hits, count(*) FILTER (WHERE h{i} > 0) AS tickets FROM hit"
        for i, t in enumerate(PO.KEYWORD_PATTERNS)))
    sql["theme_assign"] = _q(THEMES, "SELECT ticket_id, theme, confidence, method FROM assigned")
    sql["theme_assign_documents"] = _q(DOC_THEMES, "SELECT ticket_id, theme, confidence, method FROM assigned")
    explained = """SELECT ticket_id, category, stored AS taxonomy_theme, stored_hits, winner_hits,
      CASE WHEN winner_hits > 0 THEN winner END AS rule_theme, coalesce(stored = winner, false) AS agree FROM sc"""
    sql["theme_explain_documents"] = _q(DOC_THEMES, explained)
    sql["theme_disagreements_documents"] = _q(DOC_THEMES, explained + " WHERE stored IS NOT NULL AND winner_hits > 0 AND stored <> winner")
    sql["theme_explain"] = _q(THEMES, explained)
    sql["theme_disagreements"] = _q(THEMES, explained + " WHERE stored IS NOT NULL AND winner_hits > 0 AND stored <> winner")
    sql["theme_counts_weekly"] = _q(DIGEST, "SELECT week_start, theme, n, position FROM counts")
    sql["digest_sections"] = _q(DIGEST, "SELECT * FROM sections")
    sql["other_watch"] = _q(DIGEST, """, o AS (SELECT week_start, coalesce(max(pct) FILTER (WHERE theme = 'Other / Unclassified'), 0)::DOUBLE AS pct,
        coalesce(max(wow_pp) FILTER (WHERE theme = 'Other / Unclassified'), 0)::DOUBLE AS wow_pp FROM sections GROUP BY 1)
      SELECT *, pct > 15 OR wow_pp > 3 AS trigger FROM o""")
    sql["actions_weekly"] = _q(DIGEST + "," + PAIRS + "," + FIGURES + "," + ACTIONS, "SELECT * FROM todo")
    sql["kpi_record"] = _q(KPI, "SELECT * FROM kpi")
    sql["kpi_record_one_week"] = _q(KPI, "SELECT * FROM kpi WHERE week_start = DATE '2024-01-08'")
    sql["kpi_record_landed_week"] = sql["kpi_record_one_week"]
    digest = ASOF + "," + _themed("t", PO.DEFAULT_RULES) + "," + COUNTS + "," + PAIRS + "," + FIGURES + "," + ACTIONS
    sql["digest_rows"] = _q(digest + "," + _rising("t") + """,
      watch AS (SELECT week_start, coalesce(max(pct) FILTER (WHERE theme = 'Other / Unclassified'), 0)::DOUBLE AS pct,
        coalesce(max(wow_pp) FILTER (WHERE theme = 'Other / Unclassified'), 0)::DOUBLE AS wow_pp FROM sections GROUP BY 1)""",
      """SELECT week_start, 'business' AS section, 1::BIGINT AS position, 'repeat_candidates' AS key, repeat_candidates AS n, NULL::DOUBLE AS pct, NULL::BIGINT AS wow, NULL::VARCHAR AS detail FROM pair_weeks
      UNION ALL SELECT week_start, 'business', 2, 'repeat_same_issue', repeat_same_issue, NULL, NULL, NULL FROM pair_weeks
      UNION ALL SELECT week_start, 'volume', 1, 'volume', volume, NULL, NULL, NULL FROM figures
      UNION ALL SELECT f.week_start, 'volume', 2, 'previous_volume', coalesce(p.volume, 0), NULL, NULL, NULL FROM figures f LEFT JOIN figures p ON p.week_start = f.week_start - 7
      UNION ALL SELECT week_start, 'themes', position, theme, n, pct, wow, NULL FROM sections
      UNION ALL SELECT week_start, 'other_watch', 1, 'Other / Unclassified', NULL, pct, NULL,
        'pp ' || wow_pp::VARCHAR || CASE WHEN pct > 15 OR wow_pp > 3 THEN ' review' ELSE '' END FROM watch
      UNION ALL SELECT week_start, 'cost', 1, 'sla_breaches', sla_breaches, NULL, NULL, NULL FROM figures
      UNION ALL SELECT week_start, 'cost', 2, 'sla_credit_inr', sla_breaches * 350, NULL, NULL, NULL FROM figures
      UNION ALL SELECT week_start, 'cost', 3, 'transfers', transfers, NULL, NULL, NULL FROM figures
      UNION ALL SELECT week_start, 'cost', 4, 'transfer_cost_inr', transfers * 305, NULL, NULL, NULL FROM figures
      UNION ALL SELECT week_start, 'cost', 5, 'contact_cost_inr', contact_cost_inr, NULL, NULL, NULL FROM figures
      UNION ALL SELECT week_start, 'csat', 1, 'answers', csat_n, response_rate_pct, NULL, NULL FROM figures
      UNION ALL SELECT week_start, 'csat', 2, 'mean', NULL, csat_mean, NULL, NULL FROM figures
      UNION ALL SELECT resolved_week, 'board', rank, agent_id, tickets_completed, NULL, NULL, agent_name || ' | ' || team || ' | ' || shift FROM ranked WHERE tier1 AND rank <= 15
      UNION ALL SELECT resolved_week, 'specialists', 1, 'agents', count(*), NULL, NULL, NULL FROM board WHERE NOT tier1 GROUP BY resolved_week
      UNION ALL SELECT week_start, 'rising', rank, term, NULL, gain, NULL, NULL FROM rising
      UNION ALL SELECT week_start, 'actions', row_number() OVER (PARTITION BY week_start ORDER BY action, subject), action || ': ' || subject, value, NULL, NULL, NULL FROM todo""")

    sql["digest_landed_week"] = f"SELECT * FROM ({sql['digest_rows']}) WHERE week_start = DATE '2024-01-08' AND section <> 'rising'"

    measured = ["volume", "sla_breaches", "sla_missing", "csat_n", "contact_cost_inr", "transfers", "transfer_cost_inr", "sla_credit_inr",
                "repeat_candidates", "repeat_same_issue", "tier1_agents", "specialist_agents", "unresolved_attendance", "response_rate_pct", "csat_mean"]
    sql["kpi_rows"] = _q(
        KPI + "," + _GROUPED_DOCS + ", by_week AS (SELECT id, {'w': week_start, 'g': grp} AS grp, text FROM grouped)," + _tfidf("by_week"),
        " UNION ALL ".join(f"SELECT week_start, '{c}' AS measure, '' AS key, {c}::DOUBLE AS value FROM kpi" for c in measured)
        + """ UNION ALL SELECT week_start, 'channel_mix', channel_key, printf('%.2f', (count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY week_start))::DOUBLE)::DOUBLE FROM wk GROUP BY week_start, channel_key
      UNION ALL SELECT week_start, 'status_n', status_key, count(*) FROM wk GROUP BY week_start, status_key
      UNION ALL SELECT week_start, 'status_pct', status_key, printf('%.2f', (count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY week_start))::DOUBLE)::DOUBLE FROM wk GROUP BY week_start, status_key
      UNION ALL SELECT week_start, 'sla_by_channel', channel_key, count(*) FROM wk WHERE late GROUP BY week_start, channel_key
      UNION ALL SELECT week_start, 'cost_by_channel', channel_key, sum(rate)::BIGINT FROM wk GROUP BY week_start, channel_key
      UNION ALL SELECT grp.w, 'group_top_term', grp.g || ' # ' || rank || ' ' || term, score FROM top_terms""")

    sql["kpi_document_lines"] = sql["kpi_rows"]
    sql["quality_document_lines"] = sql["dq_report"]
    sql["group_top_terms"] = _q(_GROUPED_DOCS + "," + _tfidf("grouped"), "SELECT * FROM top_terms")
    sql["group_top_terms_weekly"] = _q(
        _GROUPED_DOCS + ", by_week AS (SELECT id, {'w': week_start, 'g': grp} AS grp, text FROM grouped)," + _tfidf("by_week"),
        "SELECT grp.w AS week_start, grp.g AS grp, rank, term, score FROM top_terms")
    sql["group_top_terms_tickets"] = _q(_GROUPED_TICKETS + "," + _tfidf("grouped"), "SELECT * FROM top_terms")
    sql["group_skipped"] = _q(_GROUPED_DOCS, "SELECT grp, count(*) AS docs FROM grouped GROUP BY grp HAVING count(*) < 3")
    sql["emerging_terms"] = _q(DOCS + "," + _rising("docs"), "SELECT * FROM rising")
    sql["emerging_terms_tickets"] = _q(TICKETS + "," + _rising("t"), "SELECT * FROM rising")

    sql["csv_round_trip"] = _q(DOCS, f"""SELECT ticket_id, category, agent_notes, md5(trim(customer_message, {_WS})) AS message_md5,
      length(trim(customer_message, {_WS}))::BIGINT AS chars, '' AS priority FROM docs""")
    sql["csv_arrival"] = _q(RAW, """SELECT ticket_id, source_system, 'row ' || raw_seq AS agent_notes, trim(status) AS status, trim(created_at) AS created_at, true AS numbered
      FROM raw QUALIFY row_number() OVER (PARTITION BY ticket_id ORDER BY source_system <> 'helpdesk', raw_seq % 2 = 0, raw_seq) = 1""")
    sql["taxonomy_round_trip"] = """SELECT 'v1' AS version, row_number() OVER (ORDER BY source) - 1 AS position, source AS name, 'texts of ' || source AS definition
      FROM (SELECT DISTINCT source FROM documents)"""
    sql["labelled_sample_round_trip"] = _q(LABELS, """SELECT item_id, stratum, replace(item_id, 'IT-', 'TK-') AS ticket_id, '' AS pair_id, '' AS channel, '' AS source_system,
      predicted, method, '' AS text, human_label, notes FROM lab""")
    sql["roster_intervals"] = _q(ROSTER, "SELECT agent_id AS agent_key, name, team, shift, site, lo AS valid_from, hi AS valid_to FROM roster")
    sql["kpi_documents"] = _q(KPI, """SELECT week_start, volume,
      (SELECT printf('%.2f', (count(*) FILTER (WHERE channel_key = 'chat') * 100.0)::DOUBLE / count(*))::DOUBLE FROM wk WHERE wk.week_start = kpi.week_start HAVING count(*) FILTER (WHERE channel_key = 'chat') > 0) AS chat_pct,
      (SELECT count(*) FROM wk WHERE wk.week_start = kpi.week_start AND status_key = 'open' HAVING count(*) > 0) AS open_n,
      (SELECT count(*) FROM wk WHERE wk.week_start = kpi.week_start AND late AND channel_key = 'email' HAVING count(*) > 0) AS email_breaches,
      (SELECT sum(rate)::BIGINT FROM wk WHERE wk.week_start = kpi.week_start AND channel_key = 'voice') AS voice_cost FROM kpi""")
    sql["quality_document"] = _q(TICKETS + "," + ORPHANS, """SELECT count(*) AS canonical_rows,
      (SELECT orphans FROM orphan WHERE "column" = 'agent_id') AS orphan_agent_id,
      count(*) FILTER (WHERE source_system = 'helpdesk' AND resolved_at <> '') AS resolved_helpdesk FROM t""")
    sql["excerpts"] = _q(DOCS, f"SELECT ticket_id, {_excerpt('customer_message', 'agent_notes', 300)} AS excerpt FROM docs")
    item = """to_json({'ticket_id': ticket_id, 'customer_message': substring(customer_message, 1, 800),
      'agent_notes': substring(agent_notes, 1, 400), 'category': category, 'product_family': product_family})::VARCHAR"""
    sql["prompt_payload"] = _q(DOCS, f"SELECT ticket_id, {item} AS item FROM docs")
    sql["prompt_batches"] = _q(DOCS, f"""SELECT first_seq // {B.RESPONSE_BATCH} AS batch_id, string_agg(ticket_id, ',' ORDER BY first_seq) AS ticket_ids,
      (length('{{"tickets":[]}}') + sum(length({item})) + count(*) - 1)::BIGINT AS payload_chars FROM docs GROUP BY 1""")
    sql["prompt_batches_week"] = _q(DOCS, f"""SELECT place // {B.RESPONSE_BATCH} AS batch_id, string_agg(ticket_id, ',' ORDER BY place) AS ticket_ids,
      count(*) AS tickets, md5('{{"tickets":[' || string_agg({item}, ',' ORDER BY place) || ']}}') AS payload_md5
      FROM (SELECT *, row_number() OVER (ORDER BY first_seq) - 1 AS place FROM docs WHERE week_start = DATE '2024-01-08') GROUP BY 1""")
    sql["response_validate"] = _q(REPLIES, "SELECT * FROM judged")
    sql["response_merge"] = _q(DOC_THEMES + "," + REPLIES, """SELECT a.ticket_id, coalesce(g.theme, a.theme) AS theme, g.theme IS NOT NULL AS from_model
      FROM assigned a LEFT JOIN latest g USING (ticket_id)""")
    sql["label_coverage"] = _q(REPLIES, """SELECT m.batch_id, count(*) AS asked, count(g.ticket_id) AS labelled,
      printf('%.3f', (count(g.ticket_id)::DOUBLE / count(*))::DOUBLE)::DOUBLE AS coverage FROM members m LEFT JOIN good g USING (batch_id, ticket_id) GROUP BY 1""")
    sql["polish_validate"] = """WITH d AS (
        SELECT doc_id, 'TK-' || doc_id AS ticket_id, n_chars, text,
          CASE doc_id % 3 WHEN 0 THEN 'Week 2024-01-08: TK-' || doc_id || ' has ' || n_chars || ' chars, ' || doc_id % 100 || '.5% of all. ' || text
            WHEN 1 THEN 'TK-' || doc_id || ' has ' || n_chars || ' chars. ' || text ELSE text END AS polished FROM documents),
      f AS (SELECT ticket_id, polished, list_distinct(['TK-' || doc_id, n_chars::VARCHAR, doc_id % 100 || '.5%', '2024-01-08']) AS figures FROM d),
      m AS (SELECT ticket_id, len(list_filter(figures, lambda x: NOT contains(polished, x))) AS missing FROM f)
      SELECT ticket_id, missing = 0 AS kept, missing::BIGINT AS missing FROM m"""

    sql["label_override"] = _q(LABELS, "SELECT item_id, stratum, predicted, human_label, notes FROM lab")
    sql["stratified_sample"] = _q(THEMES + "," + _PICKS, "SELECT * FROM picks")
    sql["sample_pairs"] = _q(WITH_PAIRS + "," + _PAIR_PICKS, "SELECT predicted, prior_ticket_id, repeat_ticket_id FROM pair_picks")
    sql["sample_stratum_sizes"] = _q(LABELS, "SELECT stratum, count(*) AS items FROM lab GROUP BY 1")
    sql["refund_item_tickets"] = _q(TICKETS + "," + CROSS + "," + _REFUND_ITEMS, f"""SELECT 'RF-' || c.order_id AS item_id, t.ticket_id,
      {_excerpt('t.customer_message', 't.agent_notes', 180)} AS text FROM refund_orders c JOIN t USING (ticket_id)""")
    sql["refund_review_items"] = _q(TICKETS + "," + CROSS + "," + _REFUND_ITEMS, "SELECT item_id, ticket_id, pair_id, predicted, method, text FROM refund_items")
    drawn = THEMES + "," + PAIRS + "," + CROSS + "," + _PICKS + "," + _PAIR_PICKS + "," + _REFUND_ITEMS
    review = f"""SELECT 'TH-' || p.ticket_id AS item_id, 'theme' AS stratum, p.ticket_id, '' AS pair_id, t.channel, t.source_system,
          p.theme AS predicted, p.method, {_excerpt('t.customer_message', 't.agent_notes', 300)} AS text, '' AS human_label, '' AS notes
        FROM picks p JOIN t USING (ticket_id)
        UNION ALL SELECT 'RP-' || p.repeat_ticket_id, 'repeat', p.repeat_ticket_id, p.prior_ticket_id, b.channel, b.source_system, p.predicted, {_METHOD},
          'PRIOR[' || p.prior_ticket_id || ']: ' || {_excerpt('a.customer_message', 'a.agent_notes', 250)} || ' || REPEAT: ' || {_excerpt('b.customer_message', 'b.agent_notes', 250)}, '', ''
        FROM pair_picks p JOIN t a ON a.ticket_id = p.prior_ticket_id JOIN t b ON b.ticket_id = p.repeat_ticket_id
        UNION ALL SELECT item_id, 'refund', ticket_id, pair_id, channel, source_system, predicted, method, text, '', '' FROM refund_items"""
    sql["review_sample"] = _q(drawn, review)
    sql["theme_accuracy"] = _q(LABELS, "SELECT * FROM acc")
    sql["theme_accuracy_by_method"] = _q(LABELS, "SELECT * FROM acc_m")
    sql["theme_errors"] = _q(LABELS, "SELECT item_id, predicted, human_label, notes FROM th WHERE NOT ok")
    sql["confusion_metrics"] = _q(LABELS, "SELECT * FROM conf")
    sql["confusion_errors"] = _q(LABELS, """SELECT item_id, CASE WHEN predicted = 'same-issue' THEN 'fp' ELSE 'fn' END AS kind FROM lab
      WHERE stratum = 'repeat' AND (predicted = 'same-issue') <> (human_label = 'same-issue')""")
    sql["refund_review_counts"] = _q(LABELS, "SELECT * FROM ref")

    def measures(relation: str, prefix: str, columns: list[str]) -> list[str]:
        return [f"SELECT {prefix} || {_text('.' + c)} AS measure, {c}::DOUBLE AS value FROM {relation}" for c in columns]
    report = " UNION ALL ".join(
        measures("acc", "'theme'", ["n", "agree", "accuracy"])
        + measures("acc_m", "'theme.' || method", ["n", "agree", "accuracy"])
        + measures("conf", "'repeat'", ["n", "tp", "fp", "fn", "tn", "precision", "recall", "f1"])
        + measures("ref", "'refund'", ["n", "same_ticket_confirmed", "same_order_violations"]))
    sql["evaluation_report"] = _q(LABELS, report)
    fixed = "CASE stratum WHEN 'theme' THEN 'Other / Unclassified' WHEN 'repeat' THEN 'not-same-issue' ELSE 'confirmed-violation' END"
    reviewed = f""", review AS ({review}),
      lab AS (SELECT item_id, stratum, predicted, method,
        CASE WHEN substr(md5(item_id), 1, 1) IN ('0', '1', '2', '3', '4') THEN {fixed} ELSE predicted END AS human_label FROM review),"""
    sql["review_evaluation"] = _q(drawn, reviewed + _METRICS + report)
    sql["evaluation_document"] = _q(_audit(_PLANTED) + "," + LABELS, f"""SELECT measure AS field, value FROM ({report})
      UNION ALL SELECT 'error ' || item_id || ' ' || predicted || ' ' || human_label, 1 FROM th WHERE NOT ok
      UNION ALL SELECT CASE WHEN predicted = 'same-issue' THEN 'fp ' ELSE 'fn ' END || item_id, 1 FROM lab
        WHERE stratum = 'repeat' AND (predicted = 'same-issue') <> (human_label = 'same-issue')
      UNION ALL SELECT 'failed ' || "check", count(*) FROM audit WHERE NOT ok GROUP BY "check"
      UNION ALL SELECT 'factuality checks', count(*) FROM audit
      UNION ALL SELECT 'factuality errors', count(*) FILTER (NOT ok) FROM audit
      UNION ALL SELECT 'factuality error_rate', printf('%.3f', (count(*) FILTER (NOT ok)::DOUBLE / count(*))::DOUBLE)::DOUBLE FROM audit""")
    sql["factuality_audit"] = _q(_audit(), "SELECT * FROM audit")
    sql["factuality_audit_planted"] = _q(_audit(_PLANTED), "SELECT * FROM audit")
    sql["audit_summary"] = _q(_audit(), """SELECT week_start, count(*) AS checks, count(*) FILTER (WHERE NOT ok) AS errors,
      printf('%.3f', (count(*) FILTER (WHERE NOT ok)::DOUBLE / count(*))::DOUBLE)::DOUBLE AS error_rate FROM audit GROUP BY 1""")
    return sql

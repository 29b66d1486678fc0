"""Model replies, sampling and evaluation."""
import json

import pytest
from conftest import one, ticket
from pyspark.sql import functions as F

from ticketloom.functions import text as X
from ticketloom.operators import evaluation as E, repeat as P, responses as RS, sampling as S, themes as TH
from ticketloom.plans.audit import audit_summary, evaluation_report, factuality_audit


def reply(*themes):
    return json.dumps({"themes": [{"theme": t, "summary": "s", "evidence_ticket_ids": ids, "confidence": 0.9} for t, ids in themes]})


@pytest.mark.parametrize("text,accepted", [
    (reply(("A", ["TK-1"])), True), (reply(("A", ["TK-1"]), ("B", ["TK-2"])), True), (reply(), True),
    (reply(("A", ["TK-1"]), ("B", ["TK-1"])), False), (reply(("A", ["TK-1", "TK-1"])), False),
    (reply(("Z", ["TK-1"])), False), (reply(("A", ["TK-9"])), False), ("{", False), ("{}", False),
    ('{"themes":[{"theme":"A"}]}', False), ('{"themes":[{"evidence_ticket_ids":["TK-1"]}]}', False),
    (reply(("A", ["TK-1"])) + " Hope this helps!", False), (reply(("A", ["TK-1"])).replace('"', "'"), False),
    (reply(("A", [1])), False), (reply() + reply(), False), (reply(("A", [None])), False), ('{"themes":[{"theme":"A","evidence_ticket_ids":"TK-1"}]}', False), (None, False),
])
def test_replies(spark, text, accepted):
    replies = spark.createDataFrame([(1, text)], "batch_id long, response string")
    members = spark.createDataFrame([(1, "TK-1"), (1, "TK-2"), (2, "TK-9")], "batch_id long, ticket_id string")
    parsed = RS.parsed_replies(replies)
    checked = RS.check_responses(parsed, members, spark.createDataFrame([("A",), ("B",)], "name string"))
    assert one(checked)["accepted"] is accepted
    labels = RS.accepted_labels(parsed, checked)
    if not accepted:
        assert labels.count() == 0


def test_merge_and_coverage(spark):
    members = spark.createDataFrame([(1, "TK-1"), (1, "TK-2"), (1, "TK-3")], "batch_id long, ticket_id string")
    labels = spark.createDataFrame([(1, "A", "TK-1")], "batch_id long, theme string, ticket_id string")
    rules = spark.createDataFrame([("TK-1", "R"), ("TK-2", "R"), ("TK-3", "R")], "ticket_id string, theme string")
    assert {(r.ticket_id, r.theme) for r in RS.merge_labels(rules, labels).collect()} == {("TK-1", "A"), ("TK-2", "R"), ("TK-3", "R")}
    again = labels.unionByName(spark.createDataFrame([(2, "B", "TK-1")], labels.schema))
    assert {(r.ticket_id, r.theme) for r in RS.merge_labels(rules, again).collect()} == {("TK-1", "B"), ("TK-2", "R"), ("TK-3", "R")}
    assert one(RS.label_coverage(members, labels)) == {"batch_id": 1, "asked": 3, "labelled": 1, "coverage": 0.333}


def test_payload(make):
    t = make.tickets(*[ticket(ticket_id=f"t{i}", customer_message='say "hi"\n' + "m" * 900, agent_notes="n" * 500) for i in range(5)])
    rows = RS.payload_batches(t.withColumn("product_family", F.lit("earbuds")), 2).orderBy("batch_id").collect()
    assert [r.ticket_ids for r in rows] == [["t0", "t1"], ["t2", "t3"], ["t4"]]
    item = json.loads(rows[0].payload)["tickets"][0]
    assert (len(item["customer_message"]), len(item["agent_notes"]), item["product_family"]) == (800, 400, "earbuds")


@pytest.mark.parametrize("text,kept", [
    ("Week 2026-06-22 had 199 tickets including TK-240001.", True), ("Week 2026-06-22 had 250 tickets.", False)])
def test_polish_guard(spark, text, kept):
    draft = json.dumps({"week": "2026-06-22", "total": 199, "ids": ["TK-240001"]})
    assert one(RS.check_polished(spark.createDataFrame([(draft, text)], "draft string, polished string")))["kept"] is kept


def test_excerpt(make):
    t = make.tickets(ticket(customer_message="  a\n\n b ", agent_notes="c\t d"))
    assert one(t.select(X.excerpt("customer_message", "agent_notes", 20).alias("e")))["e"] == "MSG: a b || NOTES: c d"[:20]


def sample_tickets(make):
    rows = [ticket(ticket_id=f"a{i}", category="Connectivity", agent_notes="", customer_message="pairing") for i in range(5)]
    rows += [ticket(ticket_id=f"h{i}", category="Connectivity", agent_notes="", customer_message="refund please") for i in range(3)]
    rows += [ticket(ticket_id=f"r{i}", category="Other", agent_notes="", customer_message="bluetooth") for i in range(3)]
    rows += [ticket(ticket_id="f", category="Other", customer_message="zzz", agent_notes="")]
    return make.tickets(*rows)


def test_theme_quotas(make):
    t = sample_tickets(make)
    picks = S.theme_picks(TH.assign(t), TH.disagreements(TH.explain(t))).collect()
    assert len({p.ticket_id for p in picks}) == len(picks)
    connect = [p for p in picks if p.theme == "Connectivity & Pairing"]
    assert sorted(p.method for p in connect) == ["rule", "taxonomy", "taxonomy", "taxonomy"]
    assert sum(p.ticket_id.startswith("h") for p in connect) >= 1
    assert [p.ticket_id for p in picks if p.method == "rule-fallback"] == ["f"]
    again = S.theme_picks(TH.assign(t), TH.disagreements(TH.explain(t))).collect()
    assert set(picks) == set(again)


def test_review_rows(make):
    t = make.tickets(
        ticket(ticket_id="p", created_at="2026-06-01 10:00", resolved_at="2026-06-02 09:30", order_id="OX", refund_amount_inr="10"),
        ticket(ticket_id="c", order_id="OX", replacement_issued="Y"),
        ticket(ticket_id="k", customer_id="K", order_id="OK", refund_amount_inr="7", replacement_issued="Y"))
    pairs = S.pair_items(t, S.pair_picks(P.repeat_pairs(t))).collect()
    assert [(r.item_id, r.pair_id, r.predicted, r.method) for r in pairs] == [
        ("RP-c", "p", "same-issue", "same_order=True same_product=True same_category=True gap=21.0d")]
    refunds = {(r.item_id, r.ticket_id, r.pair_id, r.method): r.predicted for r in S.refund_items(t, S.refund_picks(t)).collect()}
    assert refunds == {
        ("RF-k", "k", "", "same-ticket"): "conflict refund=7 replacement=Y order=OK",
        ("RF-OX", "", "OX", "cross-ticket"): "same-order co-occurrence order=OX"}
    assert {(r.item_id, r.ticket_id) for r in S.refund_item_tickets(t, S.refund_picks(t)).collect()} == {("RF-OX", "p"), ("RF-OX", "c")}


def test_evaluation(spark):
    rows = [("1", "theme", "A", "rule"), ("2", "theme", "B", "rule"), ("3", "theme", "A", "taxonomy"),
            ("4", "repeat", "same-issue", ""), ("5", "repeat", "same-issue", ""), ("6", "repeat", "not-same-issue", ""),
            ("7", "refund", "conflict", "")]
    sample = spark.createDataFrame(rows, "item_id string, stratum string, predicted string, method string")
    fixes = spark.createDataFrame([("2", "A", "n"), ("5", "not-same-issue", ""), ("7", "confirmed-violation", "")],
                                  "item_id string, human_label string, notes string")
    labelled = E.apply_labels(sample, fixes)
    assert one(E.accuracy(labelled)) == {"n": 3, "agree": 2, "accuracy": 0.667}
    assert {r.method: r.accuracy for r in E.accuracy_by_method(labelled).collect()} == {"rule": 0.5, "taxonomy": 1.0}
    assert [tuple(r) for r in E.theme_errors(labelled).collect()] == [("2", "B", "A", "n")]
    assert one(E.confusion(labelled)) == {"n": 3, "tp": 1, "fp": 1, "fn": 0, "tn": 1, "precision": 0.5, "recall": 1.0, "f1": 0.667}
    assert [tuple(r) for r in E.confusion_errors(labelled).collect()] == [("5", "fp")]
    assert one(E.refund_review(labelled)) == {"n": 1, "same_ticket_confirmed": 1, "same_order_violations": 0}
    assert {r.measure: r.value for r in evaluation_report(labelled).collect()}["repeat.f1"] == 0.667
    empty = one(E.confusion(labelled.where("stratum <> 'repeat'")))
    assert (empty["precision"], empty["recall"], empty["f1"]) == (0.0, 0.0, 0.0)


def test_audit_passes_and_fails(make):
    t = sample_tickets(make)
    rows = factuality_audit(t, make.team()).collect()
    assert all(r.ok for r in rows) and {r.check for r in rows} >= {"digest_total==week_rows", "leaderboard_reconciles"}
    broken = t.withColumn("sla_breach", F.lit(True))
    failed = {r.check for r in factuality_audit(broken, make.team()).collect() if not r.ok}
    assert failed == {"sla_breaches_recomputed", "sla_credit_recomputed"}
    assert one(audit_summary(factuality_audit(broken, make.team())))["errors"] == 2

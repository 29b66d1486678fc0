"""Readers and writers."""
import json

import pytest
from conftest import one, ticket

from ticketloom import schemas as S
from ticketloom.operators import dedup
from ticketloom.plans.digest import digest_rows, kpi_documents
from ticketloom.sources import readers as RD, writers as WR


def test_multiline_cells_stay_in_one_row(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('a,b\n1,"line1\nline2 ""q"""\n2, plain \n3,\n', encoding="utf-8")
    rows = RD.read_csv(spark, str(path)).orderBy("a").collect()
    assert [tuple(r) for r in rows] == [("1", 'line1\nline2 "q"'), ("2", "plain"), ("3", "")]


def write_tickets(path, *rows):
    import csv
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.DictWriter(f, S.TICKET_COLUMNS)
        w.writeheader()
        w.writerows(rows)


def test_ticket_export_round_trip(spark, tmp_path, make):
    path = tmp_path / "tickets.csv"
    write_tickets(path, ticket(ticket_id="a", customer_message="x\ny"), ticket(ticket_id="b"), ticket(ticket_id="a", source_system="legacy_fd"))
    raw = RD.read_tickets(spark, str(path))
    assert [(r.raw_seq, r.stable_row_key) for r in raw.orderBy("raw_seq").collect()] == [
        (0, "a__helpdesk__0"), (1, "b__helpdesk__1"), (2, "a__legacy_fd__2")]
    landed = WR.land(raw, str(tmp_path / "raw"))
    tickets = dedup.typed(dedup.canonical(landed))
    assert tickets.count() == 2
    parts = WR.land(tickets, str(tmp_path / "canonical"), ["week_start"])
    plan = parts.where("week_start = DATE'2026-06-22'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(week_start" in plan
    WR.write_csv(tickets, str(tmp_path / "out"), ["ticket_id", "customer_message"])
    back = RD.read_csv(spark, str(tmp_path / "out"))
    assert back.columns == ["ticket_id", "customer_message"]
    assert {r.customer_message for r in back.collect()} == {"x\ny", "the left bud will not connect"}
    WR.write_rows_json(digest_rows(tickets, make.team()), str(tmp_path / "digest"))
    assert spark.read.json(str(tmp_path / "digest")).where("section = 'board'").count() == 1
    WR.write_documents(kpi_documents(tickets, make.team()), str(tmp_path / "kpi"))
    doc = json.loads(one(spark.read.text(str(tmp_path / "kpi")))["value"])
    assert (doc["volume"], doc["channel_mix"], doc["status_mix"]) == (2, {"chat": 100.0}, {"resolved": {"n": 2, "pct": 100.0}})


def test_several_files_keep_the_order_of_their_names(spark, tmp_path):
    folder = tmp_path / "export"
    folder.mkdir()
    write_tickets(folder / "p1.csv", ticket(ticket_id="T1", customer_message="first"))
    write_tickets(folder / "p2.csv", *[ticket(ticket_id=f"T{i}", customer_message="second" + "x" * 500) for i in range(1, 400)])
    write_tickets(folder / "p3.csv", ticket(ticket_id="T1", customer_message="third"))
    raw = RD.read_tickets(spark, str(folder))
    assert raw.select("raw_seq").distinct().count() == 401
    kept = {r.ticket_id: r.customer_message for r in dedup.canonical(raw).collect()}
    assert len(kept) == 399 and kept["T1"] == "first"
    order = [r.ticket_id for r in raw.orderBy("raw_seq").collect()]
    assert order == ["T1"] + [f"T{i}" for i in range(1, 400)] + ["T1"]


def test_more_files_than_may_be_broadcast(spark, tmp_path):
    folder = tmp_path / "export"
    folder.mkdir()
    for i in range(30):
        write_tickets(folder / f"p{i:02}.csv", *[ticket(ticket_id=f"T{i}-{k}") for k in range(i % 3)])
    rows = RD.read_csv(spark, str(folder), S.TICKET_COLUMNS, position=True)
    small, large = (RD.with_sequence(rows, start=5, max_broadcast_rows=n) for n in (1000, 3))
    order = [r.ticket_id for r in large.orderBy("raw_seq").collect()]
    assert order == [f"T{i}-{k}" for i in range(30) for k in range(i % 3)]
    assert {(r.ticket_id, r.raw_seq) for r in small.collect()} == {(r.ticket_id, r.raw_seq) for r in large.collect()}
    assert min(r.raw_seq for r in small.collect()) >= 5


def test_merged_exports_equal_one_reading(spark, make):
    import random
    rng = random.Random(4)
    rows = [ticket(ticket_id=f"T{rng.randrange(12)}", source_system=rng.choice(["helpdesk", "legacy_fd"]), customer_message=str(i)) for i in range(60)]
    raw = make.raw(*rows)
    whole = {tuple(r) for r in dedup.best_rows(dedup.state(raw)).collect()}
    parts = [dedup.state(raw.where(f"raw_seq between {a} and {b}")) for a, b in ((0, 24), (25, 40), (41, 59))]
    assert {tuple(r) for r in dedup.best_rows(dedup.merged(parts[0], dedup.merged(parts[2], parts[1]))).collect()} == whole
    assert {tuple(r) for r in dedup.canonical(raw).collect()} == whole
    for r in dedup.canonical(raw).collect():
        own = [(x["source_system"] != "helpdesk", i) for i, x in enumerate(rows) if x["ticket_id"] == r.ticket_id]
        assert (r.raw_seq, r.first_seq, r.copies) == (min(own)[1], min(i for _, i in own), len(own))
        assert r.other_system == (len({later for later, _ in own}) > 1)


def test_document_lines_keep_their_order(spark, tmp_path):
    import glob
    rows = spark.range(2000).selectExpr("concat('s', id % 3) AS section", "id AS key", "IF(id % 2 = 0, 1.5D, NULL) AS value").repartition(7)
    WR.write_lines(rows, str(tmp_path / "doc"), ["section", "key"])
    lines = [json.loads(x) for f in sorted(glob.glob(f"{tmp_path}/doc/part-*")) for x in open(f)]
    assert [(x["section"], x["key"]) for x in lines] == sorted((f"s{i % 3}", i) for i in range(2000))
    assert all(("value" in x) == (x["key"] % 2 == 0) for x in lines)
    assert RD.read_lines(spark, str(tmp_path / "doc"), "section string, key long, value double").exceptAll(rows).count() == 0


def test_a_file_with_another_header_fails(spark, tmp_path):
    folder = tmp_path / "export"
    folder.mkdir()
    (folder / "a.csv").write_text("ticket_id,status\nT1,open\n", encoding="utf-8")
    (folder / "b.csv").write_text("status,ticket_id\nclosed,T2\n", encoding="utf-8")
    with pytest.raises(Exception, match="(?i)header"):
        RD.read_csv(spark, str(folder)).collect()


def test_missing_columns_read_as_blank(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("agent_id,name\nA1,One\n", encoding="utf-8")
    row = one(RD.read_roster(spark, str(path)))
    assert (row["agent_id"], row["to_date"], row["roster_seq"]) == ("A1", "", 0)


def test_family_map_last_wins(spark):
    products = spark.createDataFrame([("S1 ", "old", 1), ("S1", "new", 2), ("S2", "x", 3)], "sku string, family string, seq long")
    assert {(r.sku, r.family) for r in RD.family_map(products, seq="seq").collect()} == {("S1", "new"), ("S2", "x")}


def test_taxonomy(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"version": "v1", "themes": [{"name": "B", "definition": "b"}, {"name": "A", "definition": "a"}]}, indent=1))
    assert [r["name"] for r in RD.read_taxonomy(spark, str(path)).orderBy("position").collect()] == ["B", "A"]


def test_absent_reference_table(spark, tmp_path):
    assert RD.optional(RD.read_csv, spark, str(tmp_path / "none.csv")) is None

"""Every registered query against its SQL at the smallest scale, and the shape of key plans."""
import math
import re

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as entry_module
from ticketloom.catalog.oracle import all_sql
from ticketloom.catalog.queries import all_queries

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
QUERIES, SQL = all_queries(), all_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def tidy(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        return round(v, 9) if isinstance(v, float) and math.isfinite(v) else v
    shaped = [tuple(cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(shaped, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    got = tidy(frame.columns, [tuple(r) for r in frame.collect()])
    result = duck.execute(SQL[name])
    assert got == tidy([d[0] for d in result.description], result.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry_module.queries()) and set(SQL) <= set(entry_module.oracle_sql())


def test_entry(spark):
    frame = entry_module.entry(spark)
    assert frame.count() > 0 and "week_start" in frame.columns


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_no_python_and_no_pair_products(spark):
    for name in QUERIES:
        text = plan(QUERIES[name](spark, SF))
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
            assert bad not in text, (name, bad)


def test_dedup_reads_raw_rows_once(spark):
    text = plan(QUERIES["dedup_canonical"](spark, SF))
    assert text.count("FileScan") == 1 and "Window" not in text and "Join" not in text
    assert re.search(r"partial_min_by[\s\S]*", text)


def test_one_week_reads_its_partitions(spark):
    from ticketloom.catalog import queries as CQ
    from ticketloom.plans import one_week

    rows = one_week.week_slice(CQ._landed(spark, SF), CQ.LANDED_WEEK)
    filters = re.findall(r"PartitionFilters: \[(.+?), PushedFilters", plan(rows))
    assert filters and all(f for f in filters)
    assert any("week_start" in f for f in filters) and any("resolved_week" in f for f in filters)


def test_terms_need_no_shuffle_by_document(spark):
    text = plan(QUERIES["group_top_terms_tickets"](spark, SF))
    assert "hashpartitioning(ticket_id" not in text.split("InMemoryRelation")[0]


def test_ticket_cells_stay_within_what_the_jvm_compiles(spark):
    from ticketloom.catalog import bindings
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = spark._jvm.PythonSQLUtils.explainString(bindings.raw_tickets(spark, SF)._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n.replace(",", "")) for n in re.findall(r"maxMethodCodeSize:([\d,]+)", text)]
    # Methods of more than 8,000 bytes are interpreted.
    assert sizes and max(sizes) <= 8000


def test_audit_computes_the_pairs_once(spark, monkeypatch):
    from ticketloom import scale
    kept, settle = [], scale.settle
    monkeypatch.setattr(scale, "settle", lambda frame: kept.append(frame.columns) or settle(frame))
    QUERIES["factuality_audit"](spark, SF)
    assert kept.count(["week_start", "repeat_ticket_id", "prior_ticket_id"]) == 1


def test_unused_arrival_position_costs_nothing(spark):
    assert "Join" not in plan(QUERIES["weekly_volume"](spark, SF))


def test_scan_reads_only_needed_columns(spark):
    text = plan(QUERIES["weekly_volume"](spark, SF))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in text


def test_small_roster_needs_no_shuffle_of_tickets(spark):
    text = plan(QUERIES["roster_asof"](spark, SF))
    # The one exchange on the agent packs the roster itself.
    assert "BroadcastHashJoin [agent_key" in text and text.count("Exchange hashpartitioning(agent_key") == 1


def test_pair_halves_share_one_shuffle(spark):
    frame = QUERIES["repeat_pairs"](spark, SF)
    frame.collect()
    assert "ReusedExchange" in plan(frame)

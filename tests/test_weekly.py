"""Weekly figures on hand-made tickets."""
import datetime as dt

import pytest
from conftest import WEEK, one, ticket
from pyspark.sql import functions as F

from ticketloom.functions import clean as C, money as M
from ticketloom.operators import dedup, weekly as K
from ticketloom.plans.digest import for_week


def test_week_edges(make):
    t = make.tickets(
        ticket(ticket_id="a", created_at="2026-06-28 23:59"), ticket(ticket_id="b", created_at="2026-06-29 00:00"),
        ticket(ticket_id="c", created_at="2026-06-22 00:00"))
    assert one(for_week(K.volume(t), WEEK))["volume"] == 2
    assert {r.ticket_id for r in K.created_in_week(t, WEEK).collect()} == {"a", "c"}
    assert one(for_week(K.volume(t), "2026-06-24"))["volume"] == 2


def test_channel_and_status_mix(make):
    t = make.tickets(
        ticket(ticket_id="a", channel="Chat"), ticket(ticket_id="b", channel="email", status="open"),
        ticket(ticket_id="c", channel="email"))
    assert {r.channel: r.pct for r in K.channel_mix(t).collect()} == {"chat": 33.33, "email": 66.67}
    assert {r.status: (r.n, r.pct) for r in K.status_mix(t).collect()} == {
        "resolved": (2, 66.67), "open": (1, 33.33)}


@pytest.mark.parametrize("channel,first,late", [
    ("chat", "2026-06-23 09:45", False), ("chat", "2026-06-23 09:45:01", True),
    ("chat", "2026-06-23 09:46", True), ("email", "2026-06-23 17:30", False),
    ("email", "2026-06-23 17:31", True), ("chat", "", None), ("pigeon", "2026-06-24 10:00", None),
])
def test_sla_is_strict(make, channel, first, late):
    t = make.tickets(ticket(channel=channel, first_response_at=first))
    assert one(t.select("sla_breach"))["sla_breach"] is late
    assert one(K.sla_missing(t))["sla_missing"] == (late is None)
    assert [r.breaches for r in K.sla_breaches(t).collect()] == ([1] if late else [])


def test_csat(make):
    t = make.tickets(*[ticket(ticket_id=str(i), csat_score=v) for i, v in enumerate(["", "0", "4", "2", "9"])])
    assert one(K.csat_stats(t)) == {
        "week_start": dt.date(2026, 6, 22), "csat_n": 2, "response_rate_pct": 40.0, "csat_mean": 3.0}


def test_transfers_and_money(make, spark):
    t = make.tickets(ticket(ticket_id="a", transfers="2"), ticket(ticket_id="b", transfers="1"),
                     ticket(ticket_id="c", channel="voice"), ticket(ticket_id="d", transfers="1.5", channel="voice"))
    assert one(K.transfer_count(t))["transfers"] == 3
    assert one(K.transfer_cost(t))["transfer_cost_inr"] == 915
    assert {r.channel: r.cost_inr for r in K.contact_cost(t).collect()} == {"chat": 420, "voice": 1040, None: 1460}
    assert one(K.sla_credit(t))["sla_credit_inr"] == 0
    rates = spark.range(1).select(M.contact_rate(F.lit("carrier-pigeon")).alias("r"), M.replacement_cost(F.lit(1480)).alias("c"))
    assert one(rates) == {"r": 290, "c": 1820}


def test_attendance_uses_the_resolved_week(make):
    t = make.tickets(
        ticket(ticket_id="a", resolved_at="2026-06-30 11:00"), ticket(ticket_id="b", status=" Closed "),
        ticket(ticket_id="c", status="open", resolved_at=""), ticket(ticket_id="d", status="pending"))
    assert {(r.ticket_id, str(r.resolved_week)) for r in K.attendance(t).collect()} == {
        ("a", "2026-06-29"), ("b", "2026-06-22")}


def test_dedup_keeps_the_primary_copy(make):
    raw = make.raw(
        ticket(ticket_id="D", source_system="legacy_fd"), ticket(ticket_id="D"), ticket(ticket_id="S"),
        ticket(ticket_id="L", source_system="legacy_fd"), ticket(ticket_id="L", source_system="other"),
        ticket(ticket_id="D"))
    kept = {r.ticket_id: (r.raw_seq, r.first_seq) for r in dedup.canonical(raw).collect()}
    assert kept == {"D": (1, 0), "S": (2, 2), "L": (3, 3)}
    assert {r.raw_seq for r in dedup.quarantine(raw).collect()} == {0, 4, 5}


@pytest.mark.parametrize("cell,value", [
    ("2026-06-28 23:59", "2026-06-28 23:59:00"), (" 2026-06-28T23:59:10 ", "2026-06-28 23:59:10"),
    ("2026-6-8 3:5", "2026-06-08 03:05:00"), ("2026-06-08", "2026-06-08 00:00:00"), ("", None), (None, None),
    ("not-a-date", None), ("2026-02-31", None), ("2026-06-08 10:00:00 x", None), ("26-06-08", None),
    ("2026-06-08 24:00", None),
])
def test_timestamps(spark, cell, value):
    df = spark.createDataFrame([(cell,)], "c string").select(C.parse_timestamp("c").cast("string").alias("v"))
    assert one(df)["v"] == value


@pytest.mark.parametrize("cell,number,score", [
    ("4", 4.0, 4), (" 5 ", 5.0, 5), ("+3", 3.0, 3), ("04", 4.0, 4), ("4.0", 4.0, None), ("0", 0.0, None),
    ("", None, None), ("6", 6.0, None), ("1e2", 100.0, None), ("1_000", 1000.0, None), ("1d", None, None),
    ("n/a", None, None), (".5", 0.5, None), ("5.", 5.0, None), ("-", None, None), ("inf", float("inf"), None),
])
def test_numbers_and_scores(spark, cell, number, score):
    df = spark.createDataFrame([(cell,)], "c string").select(C.to_number("c").alias("n"), C.csat("c").alias("s"))
    assert one(df) == {"n": number, "s": score}


def test_strip_is_unicode_aware(spark):
    df = spark.createDataFrame([(" 　 a b \t\x1f",)], "c string").select(C.strip("c").alias("v"))
    assert one(df)["v"] == "a b"


def test_days_do_not_depend_on_the_session_zone(spark, make):
    t = make.tickets(ticket(created_at="2026-03-28 12:00", resolved_at="2026-03-30 12:00"))
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        assert one(t.select(C.days_between("resolved_ts", "created_ts").alias("d"),
                            F.col("created_ts").cast("string").alias("c"))) == {"d": 2.0, "c": "2026-03-28 12:00:00"}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_rounding_follows_the_binary_value(spark):
    import random
    rng = random.Random(5)
    values = [rng.randrange(-10**6, 10**6) / 1000 for _ in range(3000)] + [k / 200 for k in range(500)]
    for digits in (1, 2, 3, 4):
        rows = spark.createDataFrame([(v,) for v in values], "v double").select(
            "v", C.round_exact(F.col("v"), digits).alias("r")).collect()
        assert [r for r in rows if r.r != round(r.v, digits)] == []

"""A week read by partition against the same week out of all."""
import datetime as dt
import random

import pytest
from conftest import ticket

from ticketloom.operators import repeat as P
from ticketloom.plans import digest as G, one_week as OW


def _tickets(make, seed):
    """Few customers, tickets that stay open for months, undated ones and unresolved ones."""
    rng = random.Random(seed)

    def moment(day):
        return (dt.datetime(2026, 1, 5) + dt.timedelta(days=day, minutes=rng.randrange(1440))).strftime("%Y-%m-%d %H:%M")
    rows = []
    for i in range(160):
        day = rng.randrange(170)
        done = day + rng.choice([0, 1, 3, 20, 60, 120])
        rows.append(ticket(
            ticket_id=f"T{i}", customer_id=f"K{rng.randrange(12)}", created_at=rng.choice([moment(day)] * 9 + ["", "soon"]),
            resolved_at=rng.choice([moment(done)] * 4 + [""]), status=rng.choice(["resolved", "open"]),
            agent_id=rng.choice(["G-101", "G-202", "G-303", "nobody"]), category=rng.choice(["Connectivity", "Other", ""])))
    return make.tickets(*rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_week_slice_gives_the_week_of_all(spark, make, tmp_path, seed):
    tickets = _tickets(make, seed)
    table = OW.land_by_week(tickets, str(tmp_path / "t"))
    assert table.count() == 160
    roster = make.team()
    pairs = P.repeat_pairs(tickets).collect()
    found = 0
    for week in ("2026-03-02", "2026-04-06", "2026-05-04", "2026-06-01", "2026-06-15"):
        rows = OW.week_slice(table, week)
        assert rows.count() == rows.select("ticket_id").distinct().count()
        got = {tuple(r) for r in G.for_week(P.repeat_pairs(rows), week).collect()}
        assert got == {tuple(r) for r in pairs if r.week_start == dt.date.fromisoformat(week)}
        found += len(got)
    assert found
    week = "2026-05-06"
    for one, every in ((OW.kpi_record(table, roster, week), G.kpi_record(tickets, roster)),
                       (OW.digest(table, roster, week), G.digest_rows(tickets, roster))):
        columns = sorted(one.columns)
        assert sorted(map(str, one.select(*columns).collect())) == sorted(map(str, G.for_week(every, week).select(*columns).collect()))

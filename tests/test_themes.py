"""Themes, digest and terms."""
import collections
import datetime as dt
import math
import random
import re

import pytest
from conftest import one, ticket
from pyspark.sql import functions as F

from ticketloom.functions import text as X
from ticketloom.operators import terms as TM, themes as TH, weekly as K
from ticketloom.operators.repeat import repeat_pairs, weekly_pairs
from ticketloom.plans import digest as G
from ticketloom.policy import CATEGORY_THEMES, OTHER_THEME


def assigned(make, *cells):
    rows = [ticket(ticket_id=f"t{i}", agent_notes="", **c) for i, c in enumerate(cells)]
    return [(r.theme, r.confidence, r.method) for r in TH.assign(make.tickets(*rows)).orderBy("ticket_id").collect()]


def test_stored_categories(make):
    got = assigned(make, *[{"category": c, "customer_message": ""} for c in CATEGORY_THEMES])
    assert got == [(t, 1.0, "taxonomy") for t in CATEGORY_THEMES.values()]


@pytest.mark.parametrize("message,theme", [
    ("My left bud will not pair by bluetooth with the laptop", "Connectivity & Pairing"),
    ("I want my refund, the shop promised it on Monday", "Returns & Refunds"),
    ("No otp reaches me, so login is impossible", "App & Firmware"),
    ("Two weeks in repair and the warranty desk is silent", "Warranty & Repair"),
    ("The bank debited me although the payment failed", "Billing & Payments"),
    ("qwe rty uio", OTHER_THEME), ("", OTHER_THEME),
])
def test_keyword_rules(make, message, theme):
    method = ("rule-fallback", 0.3) if theme == OTHER_THEME else ("rule", 0.7)
    assert assigned(make, {"category": "Other", "customer_message": message}) == [(theme, method[1], method[0])]


def test_category_case_matters(make):
    assert assigned(make, {"category": "connectivity", "customer_message": "zzz"})[0][2] == "rule-fallback"


def test_disagreements(make):
    t = make.tickets(
        ticket(ticket_id="a", category="Delivery & Shipping", customer_message="where is my refund and when comes my refund", agent_notes=""),
        ticket(ticket_id="b", category="Delivery & Shipping", customer_message="the parcel is late and the courier tracking is empty", agent_notes=""),
        ticket(ticket_id="c", category="Connectivity", customer_message="zzz", agent_notes=""))
    e = {r.ticket_id: r for r in TH.explain(t).collect()}
    assert (e["a"].taxonomy_theme, e["a"].rule_theme, e["a"].agree) == ("Delivery & Shipping", "Returns & Refunds", False)
    assert (e["b"].stored_hits, e["b"].agree) == (3, True)
    assert (e["c"].rule_theme, e["c"].winner_hits, e["c"].agree) == (None, 0, True)
    assert [r.ticket_id for r in TH.disagreements(TH.explain(t)).collect()] == ["a"]


def counts(spark, now, before=None):
    rows = [(dt.date(2026, 6, 22), th, n, i) for i, (th, n) in enumerate(now.items(), 1)]
    rows += [(dt.date(2026, 6, 15), th, n, i) for i, (th, n) in enumerate((before or {}).items(), 1)]
    return spark.createDataFrame(rows, "week_start date, theme string, n long, position int")


def test_digest_sections(spark):
    c = counts(spark, {"Connectivity & Pairing": 60, OTHER_THEME: 30, "Delivery & Shipping": 110},
               {"Connectivity & Pairing": 50, OTHER_THEME: 10, "Delivery & Shipping": 100, "Gone": 5})
    rows = {r.theme: r for r in G.for_week(G.sections(c), "2026-06-22").collect()}
    assert set(rows) == {"Connectivity & Pairing", OTHER_THEME, "Delivery & Shipping"}
    assert (rows["Connectivity & Pairing"].pct, rows["Connectivity & Pairing"].wow) == (30.0, 10)
    assert rows[OTHER_THEME].wow_pp == round(15 - 1000 / 165, 1)


@pytest.mark.parametrize("now,before,pct,growth,due", [
    ({OTHER_THEME: 30, "D": 170}, {OTHER_THEME: 10, "D": 150}, 15.0, 8.8, True),
    ({OTHER_THEME: 40, "D": 160}, None, 20.0, 20.0, True),
    ({OTHER_THEME: 20, "D": 180}, {OTHER_THEME: 10, "D": 170}, 10.0, 4.4, True),
    ({OTHER_THEME: 10, "D": 190}, {OTHER_THEME: 10, "D": 190}, 5.0, 0.0, False),
    ({"D": 190}, None, 0.0, 0.0, False),
])
def test_other_watch(spark, now, before, pct, growth, due):
    got = one(G.for_week(G.other_watch(G.sections(counts(spark, now, before))), "2026-06-22"))
    assert (got["pct"], got["wow_pp"], got["trigger"]) == (pct, growth, due)


def test_counts_order_and_actions(make):
    rows = [ticket(ticket_id=f"d{i}", category="Delivery & Shipping", channel="email", first_response_at="2026-06-24 10:00",
                   customer_id=f"X{i}") for i in range(12)]
    rows += [ticket(ticket_id="w", category="Warranty & Repair", customer_id="Y", refund_amount_inr="5", replacement_issued="Y"),
             ticket(ticket_id="p", category="Connectivity", customer_id="Z")]
    t = TH.assign(make.tickets(*rows))
    c = TH.count_themes(t)
    assert [(r.theme, r.n) for r in c.orderBy("position").collect()] == [
        ("Delivery & Shipping", 12), ("Warranty & Repair", 1), ("Connectivity & Pairing", 1)]
    todo = G.actions(G.sections(c), K.created_week_figures(t), weekly_pairs(repeat_pairs(t)))
    assert {(r.action, r.subject, r.value) for r in todo.collect()} == {
        ("spike", "Delivery & Shipping", 12), ("email_tail", "email", 12), ("conflict", "refund+replacement", 1)}


def grams(text, stop):
    words = [w for w in re.findall(r"\w\w+", text.lower()) if w not in stop]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def test_bags_against_brute_force(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["ab", "Cd", "the", "é1", "x", "ef_"]) for _ in range(rng.randrange(30)))) for i in range(50)]
    got = {r.id: {b.term: b.tf for b in r.bag} for r in TM.bags(
        spark.createDataFrame(docs, "id long, text string"), "text", ["the"]).collect()}
    for i, text in docs:
        g = grams(text, {"the"})
        assert got[i] == {t: g.count(t) for t in set(g)}


@pytest.mark.parametrize("bound", [200_000, 0])
def test_tfidf_against_brute_force(spark, monkeypatch, bound):
    from ticketloom import scale
    monkeypatch.setattr(scale, "MAX_BROADCAST_ROWS", bound)
    rng = random.Random(4)
    words = ["app", "bud", "case", "led", "mic", "otp", "pay"]
    docs = [(i, "hot" if i % 3 else f"g{i % 4}", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    docs += [(100, "tiny", "app"), (101, "tiny", "bud")]
    df = spark.createDataFrame(docs, "id long, grp string, text string")
    got = {}
    for r in TM.group_top_terms(df, "id", "grp", "text", [], k=4, cap=12).orderBy("grp", "rank").collect():
        got.setdefault(r.grp, []).append((r.term, round(r.score, 7)))
    expected = {}
    for g in {d[1] for d in docs} - {"tiny"}:
        texts = [grams(d[2], set()) for d in docs if d[1] == g]
        n, total, df_ = len(texts), {}, {}
        for t in texts:
            for term in t:
                total[term] = total.get(term, 0) + 1
            for term in set(t):
                df_[term] = df_.get(term, 0) + 1
        vocab = sorted(total, key=lambda t: (-total[t], t))[:12]
        score = dict.fromkeys(vocab, 0.0)
        for t in texts:
            w = {v: t.count(v) * (math.log((1 + n) / (1 + df_[v])) + 1) for v in vocab if v in t}
            norm = math.sqrt(sum(x * x for x in w.values()))
            for v, x in w.items():
                score[v] += x / norm / n
        expected[g] = [(v, round(score[v], 7)) for v in sorted(vocab, key=lambda v: (-round(score[v], 9), v))[:4]]
    assert got == expected
    assert [(r.grp, r.docs) for r in TM.skipped_groups(df, "grp").collect()] == [("tiny", 2)]


def test_group_terms_smoke(make):
    docs = make.tickets(*[ticket(ticket_id=str(i), customer_message="bluetooth pairing disconnects phone wifi signal") for i in range(4)]).select(
        "ticket_id", X.group_label("category", F.lit("earbuds")).alias("grp"), X.ticket_text("customer_message", F.lit("")).alias("text"))
    got = TM.group_top_terms(docs, "ticket_id", "grp", "text", k=3).collect()
    assert [r.grp for r in got] == ["Connectivity | earbuds"] * 3


def weekly_texts(spark, now, before):
    rows = [(dt.date(2026, 6, 22), t) for t in now] + [(dt.date(2026, 6, 15), t) for t in before]
    return spark.createDataFrame(rows, "week date, text string")


def test_emerging(spark):
    now = ["firmware update stuck frozen bricked"] * 6 + ["delivery late courier"] * 20
    before = ["delivery late courier"] * 20 + ["refund pending bank"] * 6
    got = TM.emerging_terms(weekly_texts(spark, now, before), "week", "text", 7, k=5).orderBy("rank").collect()
    assert [(r.term, r.gain) for r in got] == [(t, round(6 / 26, 4)) for t in ("bricked", "firmware", "firmware update", "frozen", "frozen bricked")]
    assert {r.week for r in got} == {dt.date(2026, 6, 22)}


@pytest.mark.parametrize("before", [[], ["x1 y1 z1"] * 5])
def test_emerging_needs_a_baseline(spark, before):
    assert TM.emerging_terms(weekly_texts(spark, ["aa bb cc"] * 5, before), "week", "text", 7).collect() == []


def rising_terms(rows, step, k, cap, least_before, least):
    """(period, rank, term, gain) in plain Python."""
    texts, counts, out = {}, {}, []
    for period, text in rows:
        texts[period] = texts.get(period, 0) + 1
        for term in grams(text, set()):
            counts.setdefault(period, {}).setdefault(term, 0)
            counts[period][term] += 1
    for period in texts:
        now, before = counts.get(period, {}), counts.get(period - step, {})
        if texts.get(period - step, 0) < least_before:
            continue
        vocabulary = sorted({*now, *before}, key=lambda t: (-now.get(t, 0) - before.get(t, 0), t))[:cap]
        gains = {t: now.get(t, 0) / texts[period] - before.get(t, 0) / texts[period - step] for t in vocabulary if now.get(t, 0) >= least}
        best = sorted(((-round(g, 4), t) for t, g in gains.items() if g > 0))[:k]
        out += [(period, i, t, -g) for i, (g, t) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("bound", [200_000, 0])
@pytest.mark.parametrize("cap,pool", [(3, 4), (12, 40), (15, 9), (60, 9), (2, 200)])
def test_emerging_against_brute_force(spark, monkeypatch, bound, cap, pool):
    """Caps below, near and above the number of words, and so many equal counts that no word may leave."""
    from ticketloom import scale
    monkeypatch.setattr(scale, "MAX_BROADCAST_ROWS", bound)
    rng = random.Random(cap * pool)
    words = [f"w{i}" for i in range(pool)]
    rows = [(rng.choice([1, 3, 5, 9, 11]), " ".join(rng.choice(words[:rng.randint(1, pool)]) for _ in range(rng.randrange(9)))) for _ in range(120)]
    got = TM.emerging_terms(spark.createDataFrame(rows, "period int, text string"), "period", "text", 2, [], 6, cap, 3, 2).collect()
    assert sorted((r.period, r["rank"], r.term, r.gain) for r in got) == rising_terms(rows, 2, 6, cap, 3, 2)


def test_words_too_rare_for_the_vocabulary_leave_before_terms_are_made(spark):
    texts = [(i, "g", f"aa bb once{i} cc aa tie") for i in range(6)] + [(9, "even", "xx yy zz ww vv uu tt")]
    worded = TM._worded(spark.createDataFrame(texts, "id long, grp string, text string"), "text", [], TM.TOKEN)
    counts = TM.unpack(worded.select("grp", "words"), "words", "term").groupBy("grp", "term").agg(F.count(F.lit(1)).alias("n"))
    frequent = TM._frequent_words(counts, ["grp"], 3)
    # Equal counts stay; where they are more than twice the cap, all terms are counted.
    assert sorted((r.grp, r.term) for r in frequent.collect()) == [("g", w) for w in ("aa", "bb", "cc", "tie")]
    made = {r.id: r.terms for r in TM._frequent_terms(worded, frequent, ["grp"], "id").collect()}
    assert made[0] == ["aa", "bb", "cc", "aa", "tie", "aa bb", "cc aa", "aa tie"] and made[9] == grams(texts[-1][2], set())


def test_combined_searches_find_what_each_pattern_finds(spark):
    """Rules that share beginnings, texts inside one another, and forms that no search covers."""
    import random
    import re
    from ticketloom.functions.text import combined_searches, hit_counts
    word = r"(^|[^\p{L}\p{N}_])%s($|[^\p{L}\p{N}_])"
    patterns = {
        "a": [r"\bpay\b", r"\bpayment\b", r"\bpay\w*\b", r"\bpa\w*\b", r"\bcharged twice\b", r"\bcharg\w*\b"],
        "b": [r"\bconnect\w*\b", r"\bdisconnect\w*\b", r"\bdie[sd]?\b", r"\bwi-fi\b", r"\bwi\b", r"\blog in\b", r"\blog\b"],
        "c": [word % "la", word % "las", word % "l", r"\bpay\b"], "d": []}
    every = [p for each in patterns.values() for p in each]
    searches, covered = combined_searches(every)
    assert len(searches) < len(set(every)) - 4 and set(every) - set(covered) == {r"\bdie[sd]?\b"}
    rng = random.Random(9)
    pool = ["pay", "payment", "pays", "pa", "charged", "twice", "connect", "disconnected", "die", "died", "dies", "wi-fi", "wi", "log", "in",
            "la", "las", "l", "repay", "Pay", "é", "_", "9", "-"]
    texts = ["".join(rng.choice(pool) + rng.choice([" ", " ", ",", "", "\n"]) for _ in range(rng.randint(0, 8))) for _ in range(800)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = [re.compile(p.replace(r"[^\p{L}\p{N}_]", r"\W")) for p in every]
    for r in frame.select("t", hit_counts(F.col("t"), patterns).alias("n")).collect():
        hits = iter([bool(p.search(r.t)) for p in plain])
        assert r.n == [sum(next(hits) for _ in each) for each in patterns.values()], r.t


def test_group_numbers_and_term_lists(spark):
    """Groups that differ in one of several columns stay apart, empty texts count as documents, no struct per term is built."""
    week = [dt.date(2024, 1, 1), dt.date(2024, 1, 8)]
    rows = [(i, week[i % 2], "gx" if i % 4 < 2 else "gy", f"aa bb aa w{i % 4}x" if i % 8 else "") for i in range(32)]
    rows += [(100 + i, None, "gx", "lost words") for i in range(5)]
    df = spark.createDataFrame(rows, "id long, week date, grp string, text string")
    got = {}
    for r in TM.group_top_terms(df, "id", ["week", "grp"], "text", [], k=20, cap=50).collect():
        got.setdefault((r.week, r.grp), {})[r.term] = r.score
    assert set(got) == {(w, g) for w in week for g in ("gx", "gy")}
    for i, (w, g) in enumerate([(week[0], "gx"), (week[1], "gx"), (week[0], "gy"), (week[1], "gy")]):
        docs = [t.split() for _, a, b, t in rows if (a, b) == (w, g)]
        bags = [collections.Counter(d + [" ".join(p) for p in zip(d, d[1:])]) for d in docs]
        idf = {t: math.log((1 + len(docs)) / (1 + sum(t in b for b in bags))) + 1 for t in set().union(*bags)}
        length = [math.sqrt(sum((n * idf[t]) ** 2 for t, n in b.items())) for b in bags]
        assert f"w{i}x" in idf and got[w, g] == pytest.approx(
            {t: sum(b[t] * idf[t] / n for b, n in zip(bags, length) if b) / len(docs) for t in idf}, abs=1e-8)
    texts = spark.createDataFrame([(1, ["b", "a", "b", "b c", "b"]), (2, []), (3, ["z"])], "id long, terms array<string>")
    assert {r.id: (r.terms, r.tfs) for r in TM._counted(texts).collect()} == {
        1: (["a", "b", "b c"], [1, 3, 1]), 2: ([], []), 3: (["z"], [1])}


def test_terms_as_codes(spark):
    """Codes stand for the frequent words and their pairs, in the order of the texts, and give the same terms and scores."""
    texts = [(i, "g", "aa ab rare%d aa \u00e9e aa0" % i) for i in range(4)]
    worded = TM._worded(spark.createDataFrame(texts, "id long, grp string, text string"), "text", [], TM.TOKEN)
    words = spark.createDataFrame([("g", w) for w in ("ab", "\u00e9e", "aa0", "aa")], "grp string, term string")
    numbered = TM._numbered_words(words, ["grp"], 4)
    coded = TM._coded_terms(worded.join(TM._term_tables(numbered, ["grp"], "code"), "grp"), 4)
    made = {r.id: r.terms for r in coded.collect()}[2]
    spelled = {r.term: r.c for r in TM._spelled(
        spark.createDataFrame([("g", c, c) for c in set(made)], "grp string, term long, c long"), numbered, ["grp"], 4).collect()}
    assert sorted(spelled) == sorted(spelled, key=spelled.get) == sorted(
        ["aa", "ab", "\u00e9e", "aa0", "aa ab", "aa \u00e9e", "\u00e9e aa0"]) and len(made) == 8

    rng = random.Random(5)
    pool = [a + b for a in "abx_9\u00e9\u00df" for b in "ac1_z"]
    rows = [(i, f"g{i % 3}", " ".join(rng.choice(pool[:rng.randint(1, len(pool))]) for _ in range(rng.randrange(12)))) for i in range(150)]
    rows += [(1000 + i, "ties", f"one{i} two{i} three{i} four{i}") for i in range(4)] + [(2000 + i, "empty", "") for i in range(4)]
    df = spark.createDataFrame(rows, "id long, grp string, text string")
    for cap in (3, 7, 40):
        # Another way to write the pattern counts all terms as texts.
        coded, plain = (sorted(map(tuple, TM.group_top_terms(df, "id", "grp", "text", [], 5, cap, pattern=p).collect()))
                        for p in (TM.TOKEN, f"(?:{TM.TOKEN})"))
        assert coded == plain and {g for g, *_ in coded} == {"g0", "g1", "g2", "ties"}

"""Passages, lines, near-duplicates and benchmark passages against plain Python, and their odd cases."""
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketloom.llm import decontaminate, lines, secretscan, setsketch, substring

from . import plain

# Columns named like ones that the operators use inside.
CLASHING = "doc_id long, text string, words string, pos string, h long, key long, first string, n long, token long, _doc string"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))


def frame(spark, rows, extra=False):
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string")
    return spark.createDataFrame([(d, t, "w", "p", 1, 2, "f", 3, 4, "x") for d, t in rows], CLASHING)


def varied(seed, n=60, vocabulary=40, most=60):
    """Texts with shared passages, copies and small changes."""
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") + str(r.randrange(vocabulary))
    bases = [[word() for _ in range(r.randint(1, most))] for _ in range(8)]
    rows = []
    for d in r.sample(range(1000), n):
        w = list(r.choice(bases))
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(w) + 1)
            w[at:at + r.randint(0, 1)] = [word()] if r.random() < 0.7 else r.choice(bases)[:20]
        rows.append((d, r.choice([" ", "\t", "  ", "\n"]).join(w)))
    return rows + [(1001, None), (1002, ""), (1003, " \t\n "), (1004, "a"), (1005, "one TWO"), (1006, "ONE two")]


@pytest.mark.parametrize("window", [4, 9])
def test_passages(spark, window):
    rows = varied(window)
    got = substring.without_repeats(frame(spark, rows, extra=True), window=window).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == plain.cut_passages(rows, window)
    assert len(got) == len(rows)


def test_second_window_hash_tells_apart_what_the_first_cannot():
    """A Thue-Morse sequence of two words and its complement collide in any polynomial modulo a power of two."""
    from ticketloom.llm.shared import window_hashes
    words = np.random.default_rng(2).integers(0, 2**63, 2, dtype=np.uint64)
    order = np.array([i.bit_count() % 2 for i in range(4096)])
    one, other = words[order], words[1 - order]
    assert (window_hashes(one, 4096) == window_hashes(other, 4096)).all()
    assert (window_hashes(one, 4096, 1) != window_hashes(other, 4096, 1)).all()
    text = np.random.default_rng(3).integers(0, 2**63, 5000, dtype=np.uint64)
    for which in (0, 1):
        every = window_hashes(text, 50, which)
        assert (every[700:800] == window_hashes(text[700:849], 50, which)).all() and len(set(every.tolist())) == 4951


def test_passages_in_odd_tables(spark):
    assert substring.without_repeats(frame(spark, [])).collect() == []
    rows = [(1, LONG), (2, "lead " + LONG + " end"), (2, "lead " + LONG + " end"), (None, LONG), (None, None)]
    got = substring.without_repeats(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in got) == [
        (0, 0, 0), (0, 30_000, 0), (1, 30_000, 0), (2, 30_002, 30_000), (2, 30_002, 30_000)]
    assert {r.kept for r in got if r.doc_id == 2} == {"lead end"}


def test_passages_inside_one_document_stay(spark):
    text = " ".join(f"w{i}" for i in range(60))
    got = substring.without_repeats(frame(spark, [(1, text + " " + text)])).first()
    assert got.n_removed == 0


def line_texts(seed, n=25):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdé ") for _ in range(r.randint(20, 44))) for _ in range(9)]
    rows = []
    for d in r.sample(range(500), n):
        own = []
        for _ in range(r.randint(1, 6)):
            line = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                at = r.randrange(len(line))
                line[at:at + r.randint(0, 1)] = r.choice(["x", "ü", "", "yz"])
            own.append("".join(line))
        rows.append((d, "\n".join(own)))
    return rows + [(601, None), (602, ""), (603, "short\nshort"), (604, "\n\n")]


@pytest.mark.parametrize("threshold,group,broadcast", [(1, 32, 500_000), (1, 2, 0), (2, 3, 500_000)])
def test_lines(spark, monkeypatch, threshold, group, broadcast):
    monkeypatch.setattr(lines, "GROUP", group)
    rows = line_texts(threshold + group)
    got = lines.without_repeats(frame(spark, rows, extra=True), threshold=threshold, least=18, max_broadcast_rows=broadcast)
    assert got.columns[:3] == ["doc_id", "text", "words"]
    assert {r.doc_id: r.text for r in got.collect()} == plain.cut_lines(rows, threshold, 18)


@pytest.mark.parametrize("threshold", [1, 2])
def test_many_lines_that_differ_by_insertions_at_one_place(spark, threshold):
    r = random.Random(threshold)
    ends = [str(i) for i in range(1, 100)] + ["字", "é9", "1é", "10é4", "9876", "abcdef", "bcdefa"]
    rows = [f"See the appendix of this report, page {end}" for end in ends]
    rows += [f"Chapter {a}{b} of the second volume" for a in " abcdefg" for b in ("", "x", "xy", "a", "zzz")]
    rows += [f"{a}the same words follow each head" for a in ["", *"abcdefghijklmnopqrstuvwxyzàéü", "ab", "ba", "ca", "cab", "abcd"]]
    docs = list(enumerate(rows)) + [(1000, "\n".join(r.sample(rows, 20)))]
    got = lines.without_repeats(frame(spark, docs), threshold=threshold, least=18).collect()
    assert {x.doc_id: x.text for x in got} == plain.cut_lines(docs, threshold, 18)


def test_thousands_of_lines_that_differ_in_one_place(spark):
    """All are one edit apart; each meets the earliest only, so the work is linear in their number."""
    docs = [(i, f"See the appendix of this report, page {chr(0x4e00 + i)}") for i in range(4000)]
    got = lines.without_repeats(frame(spark, docs)).groupBy("n_removed").agg({"doc_id": "min", "*": "count"}).collect()
    assert sorted((x.n_removed, x["min(doc_id)"], x["count(1)"]) for x in got) == [(0, 0, 1), (1, 1, 3999)]


def test_lines_in_odd_tables(spark):
    assert lines.without_repeats(frame(spark, [])).collect() == []
    one = "a line that is long enough to count"
    rows = [(1, one), (1, one), (None, one), (2, one + "!\n" + one + "\n" + "x" * 60_000), (3, "x" * 60_001), (4, None)]
    got = {(r.doc_id, r.n_lines, r.n_removed) for r in lines.without_repeats(frame(spark, rows)).collect()}
    assert got == {(1, 1, 0), (None, 1, 0), (2, 3, 2), (3, 1, 1), (4, 0, 0)}


def test_distance_of_every_small_edit(spark):
    from pyspark.sql import functions as F
    r = random.Random(5)
    pairs = set()
    while len(pairs) < 400:
        a = "".join(r.choices("abc", k=r.randint(4, 12)))
        b = list(a)
        for _ in range(r.randint(0, 4)):
            at = r.randrange(len(b) + 1)
            b[at:at + r.randint(0, 1)] = r.choice(["a", "c", ""])
        b = "".join(b)
        if 3 < len(b) <= len(a) <= len(b) + 3:
            pairs.add((a, b))
    table = spark.createDataFrame(sorted(pairs), "a string, b string")
    for t in (1, 2, 3):
        fits = table.where(F.length("a") - F.length("b") <= t)
        got = fits.select("a", "b", lines.within(F.split("a", ""), F.split("b", ""), t).alias("near")).collect()
        assert [x for x in got if x.near != (plain.edit_distance(x.a, x.b) <= t)] == []


@pytest.mark.parametrize("size,strangers", [(2, 256), (1, 3), (5, 2)])
def test_near_duplicates(spark, monkeypatch, size, strangers):
    monkeypatch.setattr(setsketch, "STRANGERS", strangers)
    monkeypatch.setattr(setsketch, "PARTNERS", 5)
    monkeypatch.setattr(setsketch, "MEMBERS", 50)
    rows = varied(size, n=90, most=80)
    got = setsketch.near_duplicates(frame(spark, rows, extra=True), shingle=size).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain.near_components(rows, size)
    kept = {r.doc_id for r in setsketch.first_of_each(frame(spark, rows), shingle=size).collect()}
    assert kept == {d for d, (_, c) in plain.near_components(rows, size).items() if c == d}


def test_strangers_of_a_group_still_meet(spark):
    """Two documents that are close to each other, but not to the smallest of their group."""
    r = random.Random(3)
    base = [f"w{i}" for i in range(200)]

    def changed(words, n):
        words = list(words)
        for at in r.sample(range(len(words)), n):
            words[at] = f"x{r.randrange(10**9)}"
        return words

    rows = [(0, " ".join(base))] + [(1 + i, " ".join(changed(base, 6))) for i in range(20)]
    for i in range(20):
        far = changed(base, 32)
        rows += [(100 + 2 * i, " ".join(far)), (101 + 2 * i, " ".join(changed(far, 8)))]
    got = setsketch.near_duplicates(frame(spark, rows), shingle=1).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == plain.near_components(rows, 1)


def test_near_duplicates_in_odd_tables(spark):
    assert setsketch.near_duplicates(frame(spark, [])).collect() == []
    rows = [(5, LONG), (3, LONG.upper()), (3, LONG.upper()), (None, LONG), (7, None), (8, "")]
    got = sorted((x.doc_id or 0, x.n_shingles, x.component_id or 0) for x in setsketch.near_duplicates(frame(spark, rows)).collect())
    assert got == [(0, 29_996, 0), (3, 29_996, 3), (3, 29_996, 3), (5, 29_996, 3), (7, 0, 7), (8, 0, 8)]


def test_joint_estimate():
    import numpy as np
    r = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.9):
        common, a, b = int(2000 * share), int(2000 * (1 - share) * 0.7), int(2000 * (1 - share) * 0.3)
        x = r.integers(0, 2**63, common + a + b, dtype=np.uint64)
        one, two = x[:common + a], np.concatenate([x[:common], x[common + a:]])
        s, t = setsketch.sketch(np.sort(one)), setsketch.sketch(np.sort(two))
        found = setsketch.joint_estimate(s[None], t[None], np.array([float(len(one))]), np.array([float(len(two))]))[0]
        assert abs(found - share) < 0.15
        assert (setsketch.merged(s, t) == setsketch.sketch(np.sort(x))).all()


def contaminated(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["Ab", "cD", "é", "the", "of"]) + str(r.randrange(12))
    items = [(i, " ".join(word() for _ in range(r.choice([1, 2, 3, 9, 14, 25])))) for i in range(8)]
    rows = []
    for d in range(50):
        w = [word() for _ in range(r.randint(0, 40))]
        for _ in range(r.randint(0, 2)):
            own = r.choice(items)[1].split(" ")
            at, start = r.randrange(len(w) + 1), r.randrange(len(own))
            w[at:at] = own[start:start + r.randint(5, 25)]
        rows.append((d, r.choice([" ", ", ", "-"]).join(w)))
    return rows + [(90, None), (91, ""), (92, "...")], items + [(20, None), (21, ""), (None, "the1 of2"), (3, items[3][1])]


@pytest.mark.parametrize("most", [200_000, 0])
@pytest.mark.parametrize("window", [10, 4])
def test_benchmark_passages(spark, window, most):
    rows, items = contaminated(window)
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(frame(spark, rows, extra=True), table, window=window, max_broadcast_rows=most).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, sorted(r.items)) for r in got} == plain.hits(rows, items, window)
    clean = {r.doc_id for r in decontaminate.clean(frame(spark, rows), table, window=window).collect()}
    assert clean == {d for d, (_, n, _) in plain.hits(rows, items, window).items() if n == 0}


def test_benchmark_passages_in_odd_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    item = spark.createDataFrame([(1, LONG[:500])], "item_id long, text string")
    assert decontaminate.contamination(frame(spark, []), item).collect() == []
    assert decontaminate.contamination(frame(spark, [(1, LONG)]), none).first().n_hit == 0
    rows = [(1, LONG), (1, LONG), (None, LONG), (None, "clean"), (2, None)]
    got = decontaminate.contamination(frame(spark, rows), item).collect()
    assert len(got) == 4 and {r.doc_id for r in got if r.n_hit} == {1, None}
    assert {r.doc_id for r in decontaminate.clean(frame(spark, rows), item).collect()} == {None, 2}


@pytest.mark.parametrize("n", [0, 1, secretscan.PART - 1, secretscan.PART, secretscan.PART + 1, 3 * secretscan.PART + 7])
def test_matches_are_gathered_in_parts(spark, n):
    pattern = r"[0-9a-f]{24,}"
    text = " ".join("%024x" % (i * 7919) + ("é" if i % 3 else "") for i in range(n))
    rows = spark.createDataFrame([(1, text), (2, None)], "id int, t string").select("id", secretscan.matches(F.col("t"), pattern).alias("m"))
    got = {r.id: r.m for r in rows.collect()}
    assert [tuple(m) for m in got[1]] == [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, text)]
    assert got[2] is None

"""Conversation repair, mixing of sources and spelling variants against plain Python, and their edge cases."""
import hashlib
import itertools
import random
import re
import zlib

import pytest

from ticketloom.llm import conversations, mixing, queries, spelling

SF = "/root/testdata/sf0.001"


def best_repair(turns):
    """(cost, audit, kept lines) of turns (role, text) in order: every edit in every place, best per last role."""
    seen, labels = set(), {"": (0, "", [])}

    def better(found, state, label):
        if state not in found or label[:2] < found[state][:2]:
            found[state] = label
            return True

    def with_inserts(found):
        for _ in range(3):
            for state, (cost, audit, lines) in list(found.items()):
                role = "assistant" if state == "u" else "user"
                better(found, role[0], (cost + 3, audit + "I", [*lines, role + ":"]))
        return found

    for role, text in turns:
        said = text.strip(" \t\n\v\f\r")
        forced, fee = not said or (role, text) in seen, 0 if said[-1:] in (".", "!", "?") else 3
        seen.add((role, text))
        found = {}
        for state, (cost, audit, lines) in with_inserts(labels).items():
            better(found, state, (cost + 4, audit + "D", lines))
            if forced:
                continue
            after = "assistant" if state == "u" else "user"
            if role[:1] == after[0] or (role[:1] == "s" and state == ""):
                better(found, role[0], (cost + fee, audit + "K", [*lines, f"{role}:{text}"]))
            better(found, after[0], (cost + fee + 3, audit + "R", [*lines, f"{after}:{text}"]))
        labels = found
    return min((with_inserts(labels)[s] for s in ("", "a") if s in labels), key=lambda x: x[:2])


def by_trial(turns):
    """The same by writing out every audit of up to two inserts a gap."""
    best = None
    seen, forced, cut = set(), [], []
    for role, text in turns:
        forced.append(not text.strip() or (role, text) in seen)
        cut.append(text.strip()[-1:] not in (".", "!", "?"))
        seen.add((role, text))
    options = [[x + y for x in ("", "I", "II") for y in ("D" if f else "DKR")] for f in forced] + [["", "I", "II"]]
    for choice in itertools.product(*options):
        audit, cost, state, i, lines = "".join(choice), 0, "", 0, []
        for edit in audit:
            follow = "assistant" if state == "u" else "user"
            if edit == "I":
                cost, state = cost + 3, follow[0]
                lines.append(follow + ":")
                continue
            role, text = turns[i]
            if edit == "K":
                if not (role[:1] == follow[0] or (role[:1] == "s" and state == "")):
                    break
                state = role[0]
                lines.append(f"{role}:{text}")
            elif edit == "R":
                state = follow[0]
                lines.append(f"{follow}:{text}")
            cost += {"D": 4, "R": 3, "K": 0}[edit] + (3 if cut[i] and edit != "D" else 0)
            i += 1
        else:
            if state in ("", "a") and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, lines)
    return best


def conversation(rng, size):
    return [(rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]),
             rng.choice(["Yes.", "No?", "well", " ", "So it is! ", f"Turn {rng.random()}.", f"open {rng.random()}"])) for _ in range(size)]


def test_plain_repairs_agree():
    rng = random.Random(3)
    for _ in range(150):
        turns = conversation(rng, rng.randint(0, 4))
        assert best_repair(turns) == by_trial(turns), turns


def check_repairs(spark, by_conv, schema="conv_id long, turn long, role string, text string"):
    rows = [(c, i, role, text) for c, turns in by_conv.items() for i, (role, text) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    report, repaired = conversations.repaired(spark.createDataFrame(rows, schema))
    got = {r.conv_id: (r.cost, r.audit) for r in report.collect()}
    lines = {}
    for r in sorted(repaired.collect(), key=lambda r: (r.conv_id, r.place)):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    digests = {r.conv_id: r.digest for r in conversations.digests(repaired).collect()}
    for c, turns in by_conv.items():
        cost, audit, kept = best_repair(turns)
        assert got[c] == (cost, audit), (c, turns)
        assert lines.get(c, []) == kept
        assert digests.get(c) == (hashlib.sha256("\n".join(kept).encode()).hexdigest() if kept else None)


def test_repairs_equal_brute_force(spark):
    rng = random.Random(11)
    check_repairs(spark, {c: conversation(rng, rng.randint(1, 12)) for c in range(300)})


def test_conversations_over_several_blocks(spark):
    rng = random.Random(7)
    long = {1: conversation(rng, 2500), 2: conversation(rng, 3), 3: [("user", f"No. {i}.") for i in range(1200)],
            4: [("tool", f"x{i}") for i in range(1100)], 5: [("assistant", "Same.")] * 1500, 6: [("user", " ")] * 1400}
    check_repairs(spark, long)


def test_repair_of_odd_rows(spark):
    rows = [(None, 0, "user", "Hi."), (None, 1, "assistant", "Yes."),
            (1, None, "user", "Hi."), (1, None, None, "Hm."), (1, 5, "assistant", None), (1, 9, "assistant", "Done."),
            (2, 3, "user", "Again."), (2, 3, "user", "Again."), (2, 3, "assistant", "A."), (2, 4, "user", "x" * 300_000 + "."),
            (3, None, "system", "Only."), (4, 1, "user", "")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr(
        "*", "1 AS number", "'x' AS steps", "'y' AS open", "2 AS place", "3 AS fault", "4 AS n", "5 AS digest")
    report, turns = conversations.repaired(frame)
    got = {r.conv_id: r for r in report.collect()}
    assert (got[None].cost, got[None].audit, got[None].gaps) == (0, "KK", 0)
    # NULL turns come first; no role goes before "user".
    assert got[1].audit == best_repair([("", "Hm."), ("user", "Hi."), ("assistant", ""), ("assistant", "Done.")])[1]
    assert (got[1].gaps, got[1].blank, got[1].illegal) == (3, 1, 2)
    assert (got[2].duplicate, got[2].gaps) == (1, 0)
    assert (got[3].gaps, got[3].cost, got[3].audit) == (0, 4, "D")
    assert (got[4].blank, got[4].audit) == (1, "D")
    assert {r.conv_id for r in turns.collect()} == {None, 1, 2}
    empty_report, empty_turns = conversations.repaired(frame.where("false"))
    assert empty_report.collect() == [] and empty_turns.collect() == [] and conversations.digests(empty_turns).collect() == []


def test_conversations_without_rows_are_reported(spark):
    got = {r.conv_id: r for r in queries.op11_repair(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    assert set(got) == {r.conv_id for r in rows}
    gone = {r.conv_id for r in rows} - {r.conv_id for r in rows if zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20}
    for c in gone:
        assert (got[c].cost, got[c].audit, got[c].repaired_sha256) == (0, "", hashlib.sha256(b"").hexdigest())


# Mixing


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [None] * (None in sizes)
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    budget, held = share * sum(sizes.values()), {}
    while True:
        rest, open_ = budget - sum(held.values()), [n for n in names if n not in held]
        total = sum(weight[n] for n in open_)
        over = {n: most * sizes[n] for n in open_ if weight[n] * rest / total > most * sizes[n]}
        if not over:
            return held | {n: weight[n] * rest / total for n in open_}
        held |= over


WORD = re.compile(mixing.WORD)


def check_mix(rows, found):
    sizes, taken = {}, {}
    for r in found:
        assert r.source_size * 2 >= r.target and 0 <= r.taken <= 2 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    want = {}
    for _, text, source in rows:
        want[source] = want.get(source, 0) + len(WORD.findall(text or ""))
    assert sizes == want
    goal = plain_targets(sizes)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source])
    assert taken == {s: int(goal[s] + 0.5) for s in goal}


def test_mix_meets_every_target(spark):
    rng = random.Random(2)
    sources = [None, "", "a", "B", "b", "é", "\U0001f600", "z"]
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 40))), "a" if rng.random() < 0.4 else rng.choice(sources)) for i in range(600)]
    rows += [(None, None, "a"), (None, "one two", None), (7, rows[7][1], rows[7][2]), (7, rows[7][1], rows[7][2])]
    rows += [(5000, "copy of copies", "hot")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr(
        "*", "1 AS size", "2 AS target", "3 AS row", "4 AS epoch", "5 AS name", "6 AS key", "7 AS arrival", "8 AS known")
    found = mixing.mixed(docs).collect()
    assert len(found) == len(rows)
    check_mix(rows, found)
    again = mixing.mixed(docs.repartition(13)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    out = mixing.copies(mixing.mixed(docs, carry=True))
    assert out.columns == [*[c for c in docs.columns if c != "epoch"], "epoch"]
    written = out.collect()
    assert sum(len(WORD.findall(r.text)) for r in written) == sum(r.taken for r in found)
    texts = {(r[0], r[1]) for r in rows}
    assert sum((r.doc_id, r.text) not in texts for r in written) <= len(sources) + 1
    assert all(r.size == 1 and r.row == 3 for r in written)


def test_mix_of_little(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mixed(spark.createDataFrame([], schema)).collect() == []
    for rows in ([(1, None, None)], [(1, "", "a"), (2, " ", "b")], [(1, "one", "a")], [(1, "x " * 50_000, "a"), (2, "y", "b")]):
        check_mix(rows, mixing.mixed(spark.createDataFrame(rows, schema)).collect())


# Spelling


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)):] == b[i + (len(b) >= len(a)):]


def plain_variants(counts, factor=5):
    near_of = {w: [x for x in counts if near(w, x)] for w in counts}
    form = {}
    for w, others in near_of.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= factor * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (counts[w], len(near_of[w]), form[w], counts[form[w]] if form[w] else None, root)
    return out


def test_variants_equal_brute_force(spark):
    rng = random.Random(4)
    counts = {}
    for letters in ("ab", "abcdefgh", "aéÀÿ"):
        for _ in range(120):
            w = "".join(rng.choice(letters) for _ in range(rng.randint(6, 9)))
            for _ in range(4):
                counts[w] = rng.choice([5, 6, 30, 40, 200, 1000, 6000])
                i = rng.randrange(len(w))
                w = (w[:i] + rng.choice(["", rng.choice(letters), w[i] + rng.choice(letters)]) + w[i + 1:]).ljust(6, letters[0])
    counts |= {"a" * n: 5 for n in range(6, 40)} | {"b" * 9_000: 5, "b" * 9_001: 25, "b" * 4_000 + "c" + "b" * 5_000: 125}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(words).collect()}
    assert got == plain_variants(counts)
    assert spelling.variants(words.where("false")).collect() == []


def test_pivots_are_the_cheapest_disjoint_pair():
    rng = random.Random(6)
    for _ in range(300):
        places = sorted(rng.sample(range(12), rng.randint(3, 7)))
        weights = [rng.randint(1, 9) for _ in places]
        cost = dict(zip(places, weights))
        best = min(cost[p] + cost[q] for p in places for q in places if q - p >= 2)
        p, q = spelling.pivot_places(places, weights)
        assert q - p >= 2 and cost[p] + cost[q] == best


def plain_words(docs, every):
    counts = {}
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if every and h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if n >= 5}


def test_words_are_counted_and_spoiled(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs += [(None, "ÉCOLES Ecoles " * 6), (1, None), (2, ""), (3, "longest " * 40_000), (3, "longest " * 40_000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n")
    for every in (0, 7, 199):
        got = {r.word: r.n for r in spelling.word_counts(frame, spoil_every=every).collect()}
        assert got == plain_words(docs, every)
    assert "Écoles" in got and "ecoles" in got

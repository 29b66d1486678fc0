"""BPE, WARC, top-k, secrets, chat and languages: brute force and odd cases."""
import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ticketloom.llm import balltree, bpe, chat, graph, langid, secretscan, warc

from . import plain

PATH = public_tokenizers.path("byte_bpe_50k.json")


def fuzz(seed, n):
    r = random.Random(seed)
    pool = ["a", "b", " ", "  ", "\n", "é", "'s", "'ll", "0", "12", "<|endoftext|>", "<|endof", "\x1c", "\x85", "\u3000", "日本", "🙂",
            "ing", "tion", "the", "\t", "\x00", "…", "-", "aaaaaaaa", "\u200b", "Ⅷ", "²"]
    return ["".join(r.choices(pool, k=r.randint(0, 40))) for _ in range(n)]


def test_bpe_equals_the_library():
    coder, library = bpe.Codec(bpe.vocabulary(PATH)), Tokenizer.from_file(PATH)
    texts = fuzz(1, 3000) + ["a" * 5000, "".join(random.Random(2).choices("ab", k=3000)), ""]
    theirs = library.encode_batch(texts, add_special_tokens=False)
    ours = list(coder.encode(texts))
    assert ours == [np.array(e.ids, "<u4").tobytes() for e in theirs]
    assert [coder.decode(o) for o in ours] == [library.decode(e.ids, skip_special_tokens=False) for e in theirs]
    every = pa.array([None, *ours, b""], pa.binary())
    assert coder.texts(every[1:]).to_pylist() == [library.decode(e.ids, skip_special_tokens=False) for e in theirs] + [""]
    assert coder.texts(every[:0]).to_pylist() == []


def test_near_texts_are_cut_as_others():
    coder, r = bpe.Codec(bpe.vocabulary(PATH)), random.Random(8)
    pool = [chr(c) for c in range(bpe.NEAR)] + ["'s", "'re", " ", "  ", "\n\n", "Ünï"] * 20
    for text in fuzz(5, 500) + ["".join(r.choices(pool, k=60)) for _ in range(3000)]:
        if not coder.far.search(text):
            assert coder.near_word.findall(text) == coder.word.findall(text)


def test_bpe_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_WORDS", 3)
    coder, library = bpe.Codec(bpe.vocabulary(PATH)), Tokenizer.from_file(PATH)
    for text in fuzz(3, 50):
        assert list(coder.encode([text])) == [np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]


def test_bpe_tables(spark):
    rows = [(1, "one two", 9), (1, "one two", 9), (None, "x", 9), (2, None, 9), (3, "", 9), (4, "long " * 200_000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = bpe.round_trip(docs, PATH).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 1), (1, 2), (1, 2), (2, 0), (3, 0), (4, 200_001)]
    assert all(r.decoded == (dict((a, b) for a, b, _ in rows)[r.doc_id] or "") for r in got)
    ids = bpe.encoded(docs, PATH)
    back = {r.doc_id: r.text for r in bpe.decoded(ids, PATH).collect()}
    assert back == {a: b or "" for a, b, _ in rows}
    assert bpe.decoded(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), PATH).first().text is None
    assert bpe.round_trip(docs.where("false"), PATH).collect() == []


@pytest.mark.parametrize("least", [0, 5])
def test_warc(spark, tmp_path, least):
    hard = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nxyz"
    rows = [(1, "http://a/1", "same page"), (2, "http://a/2\r\nEvil: x", "same page"), (3, None, hard), (4, "http://a/4", None),
            (5, "http://a/5", ""), (6, "http://a/6", "same page"), (7, "u", "é🙂" * 50_000), (8, "u", "abc"), (9, "u", "abc"), (9, "u", "abc")]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, digest string")
    warc.write(pages, f"{tmp_path}/w", least)
    got = warc.with_payload_facts(warc.assemble(warc.read(spark, f"{tmp_path}/w", payloads=True))).collect()
    assert len(got) == len(rows)
    bodies = {p: (h or "").encode() for p, _, h in rows}
    for r in got:
        page = int(r.metadata.fields["pageId"])
        body = bodies[page]
        last = max(p for p, b in bodies.items() if b == body) if len(body) >= least else page
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert r.payload_bytes == len(body) and r.response.declared_digest == digest
        assert r.response.record_type == ("response" if page == last else "revisit")
        assert r.refers_page == (None if page == last else str(last))
        if page == last:
            assert bytes(r.response.payload) == body and r.response.payload_digest == digest
        assert r.request is not None and r.n_metadata >= 1


def test_warc_size_classes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 40_000)
    r = random.Random(9)
    bodies = {i: "".join(r.choices("abcé<>", k=r.choice([3, 30, 300, 900, 30_000]))) for i in range(150)}
    bodies |= {200: bodies[0], 201: "x" * 60_000, 202: "x" * 60_000}
    warc.write(spark.createDataFrame([(i, "u", b) for i, b in bodies.items()], "page_id long, url string, html string"), f"{tmp_path}/w")
    got = warc.with_payload_facts(warc.assemble(warc.read(spark, f"{tmp_path}/w", payloads=True))).collect()
    assert sorted(int(x.metadata.fields["pageId"]) for x in got) == sorted(bodies)
    for x in got:
        body = bodies[int(x.metadata.fields["pageId"])].encode()
        assert x.payload_bytes == len(body) and (x.response.payload is None or bytes(x.response.payload) == body)
    for file in tmp_path.rglob("*.gz"):
        sizes = [len(b) for h, b in warc.parsed(file.read_bytes()) if h["warc-type"] == "response"]
        assert len(sizes) <= 1 or sum(sizes) <= 40_000 + 200 * len(sizes)
    assert [c[2] for c in warc.size_classes(10**9)] == [2000, 125, 7, 1]
    assert warc.size_classes(0) == [(0, 20, 2000)]


def test_archives_are_read_piece_by_piece(monkeypatch):
    records = [warc.record([("WARC-Type", "response"), ("X", str(i))], bytes([i]) * (i * 977 % 5000) + b"WARC/" * (i % 3)) for i in range(60)]
    plainly = b"".join(x + warc.END for x in records)
    want = [(str(i), bytes([i]) * (i * 977 % 5000) + b"WARC/" * (i % 3)) for i in range(60)]
    import gzip
    members = b"".join(gzip.compress(x + warc.END) for x in records)
    for feed, chunk in ((1, 1), (7, 3), (64, 1000), (1 << 16, 1 << 20)):
        monkeypatch.setattr(warc, "FEED", feed)
        monkeypatch.setattr(warc, "CHUNK", chunk)
        for archive in (plainly, members, gzip.compress(plainly), b""):
            assert [(h["x"], b) for h, b in warc.parsed(archive)] == (want if archive else [])
    with pytest.raises(ValueError):
        list(warc.parsed(plainly[:-2000]))


def test_warc_without_pages(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(none, f"{tmp_path}/w")
    assert warc.assemble(warc.read(spark, f"{tmp_path}/w")).collect() == []


def test_transactions_through_requests(spark):
    schema = warc.RECORD
    def row(i, kind, to=None):
        return (i, kind, to, None, None, None, None, 1 if kind == "response" else None, None, {"k": i}, None)
    rows = [row("r1", "response"), row("q1", "request", "r1"), row("q0", "request", "r1"), row("m1", "metadata", "q1"),
            row("m2", "metadata", "r1"), row("r2", "response"), row("m9", "metadata", "nothing"), row("q9", "request", None)]
    got = {r.response.record_id: r for r in warc.assemble(spark.createDataFrame(rows, schema)).collect()}
    assert got["r1"].request.record_id == "q0" and got["r1"].n_metadata == 2 and got["r1"].metadata.record_id == "m1"
    assert got["r2"].request is None and got["r2"].metadata is None and got["r2"].n_metadata == 0


@pytest.mark.parametrize("shards", [1, 7, None])
def test_top_k(spark, shards):
    r = random.Random(4)
    rows = [(i, [float(r.randint(-3, 3)) for _ in range(r.choice([4, 4, 4, 2]))]) for i in range(400)]
    rows += [(1000 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(150)]
    rows += [(2000, None), (2001, [1.0, None, 1.0, 1.0]), (2002, [1.0, float("nan"), 1.0, 1.0]), (2003, [float("inf"), 1.0, 1.0, 1.0]),
             (None, [9.0, 9.0, 9.0, 9.0]), (2004, [])]
    table = spark.createDataFrame([(*x, 1, 2) for x in rows], "vec_id long, embedding array<double>, shard int, bound int")
    good = [(i, v) for i, v in rows if i is not None and v and i < 2000]
    got = {}
    for x in balltree.top_k(table, table.where("vec_id % 20 = 0"), k=5, shards=shards).collect():
        got.setdefault(x.query_id, {})[x.rank] = (x.vec_id, x.score)
    for q, v in good:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))[:5]
            assert got[q] == {n: (i, -s) for n, (s, i) in enumerate(scored, 1)}
    assert set(got) == {q for q, _ in good if q % 20 == 0}


def test_top_k_of_few(spark):
    table = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in balltree.top_k(table, table.where("vec_id = 0")).collect()] == [(0, 1, 1, 2.0)]
    assert balltree.top_k(table.where("false"), table).collect() == []
    assert balltree.top_k(table, table.where("false")).collect() == []


def test_components(spark):
    r = random.Random(8)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {n: root(n) for a, b in links for n in (a, b) if a != b}
    assert graph.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_markov_ratio(spark):
    r = random.Random(6)
    words = ["user", "account", "name", "value", "index", "token", "count", "parser", "field", "table", "window", "reader"]
    letters = secretscan.ALPHABET[:62]
    samples = [("".join(r.choices(letters, k=24)), True) for _ in range(300)] + [
        ("_".join(r.choices(words, k=3)), False) for _ in range(300)] + [(None, True), ("x", None), ("", False)]
    table = secretscan.train(spark.createDataFrame([(*s, 1) for s in samples], "text string, random boolean, n int"))
    unseen = [("".join(r.choices(letters, k=24)), True) for _ in range(100)] + [("_".join(r.choices(words, k=4)), False) for _ in range(100)]
    got = spark.createDataFrame(unseen, "t string, random boolean").select("random", secretscan.ratio(F.col("t"), table).alias("x")).collect()
    assert sum((g.x > 0) == g.random for g in got) >= 190  # 95 of 100
    assert secretscan.train(spark.createDataFrame([], "text string, random boolean")) == [0.0] * secretscan.WIDTH**2


def test_planted_keys_are_found(spark):
    """Keys of several alphabets in documents of the given table, none of which the models have learnt from."""
    r = random.Random(14)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    kinds = {"base62": (upper + lower + digits, 24), "base64": (upper + lower + digits + "+/", 40), "url": (upper + lower + digits + "-_", 43),
             "base32": (upper + "234567", 32), "HEX": (digits + "ABCDEF", 40)}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("text is not null")
    rows = docs.collect()
    cut = len(rows) // 2
    table = secretscan.train(secretscan.labelled_strings(spark.createDataFrame(rows[:cut], docs.schema)))
    planted, where = [], {}
    for i, row in enumerate(rows[cut:]):
        kind = sorted(kinds)[i % len(kinds)]
        key = "".join(r.choices(kinds[kind][0], k=kinds[kind][1]))
        gaps = [p for p, c in enumerate(row.text) if c == " "]
        at = r.choice(gaps) + 1 if gaps else 0
        planted.append((row.doc_id, f"{row.text[:at]}{key} {row.text[at:]}"))
        where[row.doc_id] = (kind, at, at + len(key))
    found = dict.fromkeys(kinds, 0)
    others = 0
    for x in secretscan.scan(spark.createDataFrame(planted, docs.schema), table).select("doc_id", "added").collect():
        kind, start, end = where[x.doc_id]
        hits = [s for s in x.added if s.start <= start and end <= s.end]
        found[kind] += bool(hits)
        others += len(x.added) - len(hits)
    size = sum(len(t) for _, t in planted)
    print(found, "of", len(planted) / len(kinds), "each; other spans a million characters:", others / size * 1e6)
    assert all(n >= 0.9 * (len(planted) // len(kinds)) for n in found.values()), found
    assert others / size * 1e6 < 20


def test_secret_spans(spark):
    secret = "q7Xz9Lw2Kd8Rt4Vb6Ny1"
    table = secretscan.train(spark.createDataFrame(
        [(secret[i:] + secret[:i], True) for i in range(20)] + [("ordinary_words_in_names", False)], "text string, random boolean"))
    rows = [(1, f"é🙂 id {secret}"), (2, "API-key nothing, api_KEY: 'abcdef' secret=token: abcdefgh"), (3, None), (4, ""), (5, "0123456789" * 3),
            (6, f"token={secret}"), (6, f"token={secret}"), (None, "AKIA" + "A" * 16), (7, "AKIAAKIA" + "a" * 3), (8, "word " * 100_000 + "f" * 24)]
    docs = spark.createDataFrame([(*x, "b") for x in rows], "doc_id long, text string, base string")
    got = sorted((r.doc_id or 0, r.a, r.b) for r in secretscan.scan(docs, table).select(
        "doc_id", secretscan.listed(F.col("base")).alias("a"), secretscan.listed(F.col("added")).alias("b")).collect())
    assert got == [
        (0, "access:0:20", ""), (1, "", "random:6:26"), (2, "assign:17:33", ""), (3, "", ""), (4, "", ""), (5, "hex:0:30", ""),
        (6, "assign:0:26", ""), (6, "assign:0:26", ""), (7, "", ""), (8, "hex:500000:500024", "")]
    assert secretscan.scan(docs.where("false"), table).collect() == []


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "s") for r in rows], "conv_id long, turn long, role string, text string, spans string")


def test_chat_round_trip(spark):
    nasty = ["</turn>", "\\</turn>", "\\\\### User: ", "ends with \\", "\n</turn>\n### User: x", "", None, "### Role a: b", "\n", "$1 \\$1 \\"]
    rows = [(i, t, role, text) for i, pair in enumerate((a, b) for a in nasty for b in nasty)
            for t, role, text in ((0, "user", pair[0]), (1, "assistant", pair[1]))]
    got = chat.formatted(conversations(spark, rows)).select(
        "conv_id", "valid", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.learned_text(F.col("formatted"), F.col("spans")).alias("learned"), "segments", "formatted").collect()
    want = {}
    for i, _, role, text in rows:
        want.setdefault(i, []).append((role, text or ""))
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in got} == want
    assert {r.conv_id: r.learned for r in got} == {i: w[1][1] for i, w in want.items()}
    assert all(r.valid and r.formatted == "".join(s.text for s in r.segments) for r in got)


def test_chat_state_machine(spark):
    u, a, s = "user", "assistant", "system"
    cases = {1: ([s, u, a], None), 2: ([u, a, u, a], None), 3: ([u, u], 1), 4: ([a], 0), 5: ([u], -1), 6: ([s, s, u, a], 1),
             7: ([u, "tool: x\n", a], 1), 8: ([u, None], 1)}
    rows = [(c, i, role, f"t{i}") for c, (roles, _) in cases.items() for i, role in enumerate(roles)]
    got = chat.formatted(conversations(spark, rows)).withColumn("turns", chat.read_turns(F.col("formatted"))).collect()
    assert {r.conv_id: r.bad_turn for r in got} == {c: bad for c, (_, bad) in cases.items()}
    assert {r.conv_id for r in got if r.valid} == {1, 2}
    assert {r.conv_id: [t.role for t in r.turns] for r in got} == {c: [x or "" for x in roles] for c, (roles, _) in cases.items()}


def test_chat_in_odd_tables(spark):
    assert chat.formatted(conversations(spark, [])).collect() == []
    rows = [(1, 1, "assistant", "b"), (1, None, "user", "a"), (1, 1, "assistant", "b"), (None, 0, "user", "x" * 300_000), (None, 1, "assistant", "y")]
    got = {r.conv_id: [t.text for t in r.t] for r in chat.formatted(conversations(spark, rows)).select(
        "conv_id", chat.read_turns(F.col("formatted")).alias("t")).collect()}
    assert got == {1: ["a", "b", "b"], None: ["x" * 300_000, "y"]}


def test_backoff_equals_plain_python(spark):
    r = random.Random(12)
    stems = {"en": ["the", "cat", "dog", "water", "house"], "de": ["der", "hund", "wasser", "haus", "straße"], "fr": ["le", "chien", "eau", "maison", "été"]}
    rows = [(i, " ".join(r.choice(stems[lang]) + r.choice(["", "s", "en"]) for _ in range(r.randint(1, 12))), lang)
            for i in range(150) for lang in [r.choice(sorted(stems))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    odd = ["", "?", "Wasserhaus CATDOG", "xyz", "Ж", "q" * 30, "THE²", "été maisons", "hauses dogen chienwater 12", None]
    for most in (8000, 5):
        predict = plain.language_model(rows, most)
        model = langid.fit(docs, most_terms=most)
        texts = [t for _, t, _ in rows] + odd
        got = langid.identified(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
        for x in got:
            lang, score = predict(texts[x.doc_id])
            assert x.lang_pred == lang and abs(x.score - score) < 1e-9, texts[x.doc_id]


def test_languages(spark):
    rows = [(i, "the cat and the dog", "en", 1) for i in range(40)] + [(100 + i, "der Hund und die Katze", "de", 1) for i in range(40)]
    docs = spark.createDataFrame(rows + [(None, "und", "xx", 1), (500, None, "yy", 1), (501, "die", None, 1)],
                                 "doc_id long, text string, lang string, score int")
    model = langid.fit(docs)
    assert model.languages == ["de", "en"]
    odd = spark.createDataFrame([(1, "THE DOG", 1), (1, "THE DOG", 1), (2, "Hunde", 1), (3, None, 1), (4, "12 % ²", 1), (None, "und", 1), (5, "the " * 100_000, 1),
                                 (6, "Ж", 1)], "doc_id long, text string, lang_pred int")
    got = [(r.doc_id, r.lang_pred) for r in langid.identified(odd, model).collect()]
    assert got == [(1, "en"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (None, "de"), (5, "en"), (6, "de")]
    none = langid.fit(docs.where("false"))
    assert [tuple(r) for r in langid.identified(odd.limit(1), none).collect()] == [(1, "und", 0.0)]
    assert langid.identified(odd.where("false"), model).collect() == []

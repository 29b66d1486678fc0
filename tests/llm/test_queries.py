"""Every registered query with SQL against DuckDB, and the others against plain Python."""
import base64
import hashlib
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from pyspark.sql import functions as F

from ticketloom.llm import langid, lines, queries
from ticketloom.llm.shared import hash_limit

from . import plain

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, duck, name):
    frame = queries.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    result = duck.execute(queries.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert sorted(map(str, (tuple(r) for r in frame.select(*columns).collect()))) == sorted(
        str(tuple(r[i] for i in at)) for r in result.fetchall())


def test_all_operators_and_the_pipeline_are_registered():
    assert sorted(re.match(r"op(\d+)_", n)[1] for n in queries.QUERIES if n != "pipeline") == sorted(map(str, range(1, 14)))
    assert "pipeline" in queries.QUERIES and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_native_queries_run_no_python(spark):
    for name in ("op4_lines", "op7_secrets", "op8_decontaminate", "op9_chat"):
        text = queries.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|MapInArrow|CartesianProduct", text), name


def tokens(text):
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = coder.encode(text or "", add_special_tokens=False).ids
    return ids, coder.decode(ids, skip_special_tokens=False)


def test_bpe(spark, texts):
    for r in queries.op1_bpe(spark, SF).collect():
        ids, back = tokens(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), plain.sha(back))


def test_secrets(spark, duck):
    kinds = [("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
             ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]
    found = 0
    texts = dict(duck.execute("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    for r in queries.op7_secrets(spark, "/root/testdata/sf0.01").collect():
        spans = sorted((m.start(), k, m.end()) for k, (_, p, group, least) in enumerate(kinds)
                       for m in p.finditer(texts[r.doc_id] or "") if len(m[group]) >= least)
        found += len(spans)
        assert r.base_sha256 == plain.sha(",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in spans))
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[1] == k for s in spans) for k in range(3)]
        listed = r.spans.split(",") if r.spans else []
        assert {f"{kinds[k][0]}:{a}:{b}" for a, k, b in spans} <= set(listed)
    assert found


def test_language(spark, duck):
    told = {d: (lang, part) for d, lang, part in duck.execute("SELECT doc_id, lang, doc_id FROM documents").fetchall()}
    rows = queries.op10_language(spark, "/root/testdata/sf0.01").collect()
    own = dict(duck.execute("SELECT doc_id, lang FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    import zlib
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {d for d in own if zlib.crc32(str(d).encode()) % 4 == 2}
    right = sum(r.lang_pred == own[r.doc_id] for r in held) / len(held)
    assert right >= 0.95 and all(0 <= r.score <= 1 for r in rows) and told


def test_warc_digests(spark, duck):
    pages = dict(duck.execute("SELECT page_id, html FROM pages").fetchall())
    for r in queries.op3_warc(spark, SF).collect():
        body = (pages[r.page_id] or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())


def test_pipeline(spark, duck, texts):
    """All stages again in plain Python; languages are taken from the operator, which is tested on its own."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = {r.doc_id for r in stages["language_id"](spark, docs, SF).select("doc_id").collect()}
    assert kept >= {d for d, t in texts.items() if len(langid.WORD.findall(t)) > 20}
    cut = plain.cut_lines([(d, t) for d, t in texts.items() if d in kept], 1, 20)
    left = plain.own_documents([(d, t) for d, t in texts.items() if d in kept], cut, 20)
    groups = plain.near_components(left, 5)
    first = [(d, t) for d, t in left if groups[d][1] == d]
    items = duck.execute("SELECT item_id, text FROM benchmark").fetchall()
    found = plain.hits(first, items, 10)
    expected = {d: tokens(t) for d, t in first if not found[d][1]}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: (r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in rows} == {
        d: (len(ids), np.array(ids, "<u4").tobytes(), plain.sha(back)) for d, (ids, back) in expected.items()}
    assert 0 < len(rows) < len(texts)


def test_short_lines_of_their_own_keep_a_document(spark):
    head = "one header that all of them share"
    texts = {1: f"{head}\nrose", 2: f"{head}\nrose\n \n", 3: f"{head}\nrose\nlily", 4: f"lily\n{head}\nrose", 5: head,
             6: f"{head}\n\u82b1", 7: "rose\nlily", 8: f"{head}\noak\noak"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, SF).collect()}
    assert got == {1: texts[1], 3: "rose\nlily", 6: "\u82b1", 7: texts[7], 8: "oak\noak"}


def test_stages_leave_columns_of_any_name_alone(spark):
    """Names that the operators use inside; the values come back as they were."""
    names = ["new", "n_removed", "n_lines", "earlier", "score", "lang_pred", "line", "first", "row", "left", "lost", "id", "kept", "lines"]
    rows = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    docs = rows.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    cut = lines.without_repeats(docs)
    for r in cut.collect():
        assert all(r[n] == f"{n}{r.doc_id}" for n in names if n not in ("n_removed", "n_lines", "earlier"))
        assert r.n_lines >= r.n_removed >= 0
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all(r[n] == f"{n}{r.doc_id}" for r in got for n in names), name


def test_documents_with_lines_of_their_own_equal_brute_force(spark):
    rng = random.Random(3)
    pool = ["a header that many of them share", "a footer that many of them share too", "rose", "lily", " ", "", "oak", "one line of twenty or more", "elm"]
    docs = [(d, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 4)))) for d in range(120)]
    cut = plain.cut_lines(docs, 1, 20)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(tuple(r) for r in lines.own_documents(frame).collect()) == sorted(plain.own_documents(docs, cut, 20))


@pytest.mark.parametrize("rows", [10**4, 10**11, 10**15])
def test_a_share_of_any_table_is_met(rows):
    share = 8000 / rows
    assert abs((hash_limit(share) + 2**63) / 2**64 - share) < share * 1e-3
    assert hash_limit(1.0) == 2**63 - 1 and hash_limit(0.0) == -(2**63)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).collect() == [], name

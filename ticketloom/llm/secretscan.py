"""Secret scans: fixed patterns, and strings that look random to a pair of Markov models.

Two first-order character models are trained from labelled samples, one from random strings and one
from ordinary identifiers. A run of identifier characters is reported when the log of its likelihood
ratio is high enough. Everything is DataFrame expressions; texts are scanned where they lie.
"""
from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from .shared import hash_limit, picked

# Fixed patterns: (kind, pattern, group whose length counts, least length).
BASE = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]
# What the models may judge, and the characters that they tell apart; all others are one more.
RUN = r"[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"
WIDTH = len(ALPHABET) + 1
KINDS = [kind for kind, *_ in BASE] + ["random"]


def _gate(kind: str, text: Column) -> Column:
    """A cheap test that every text with a match of this kind passes."""
    return {"assign": text.rlike(r"(?i:passw|secret|token|api_?key)"), "access": F.contains(text, F.lit("AKIA")),
            "hex": text.rlike(r"[0-9a-f]{24}"), "random": text.rlike(RUN)}[kind]


# Matches that are gathered one by one before the list goes to the whole.
PART = 256


def matches(text: Column, pattern: str, group: int = 0, least: int = 1) -> Column:
    """Array of (start, end, value) of leftmost non-overlapping matches, in characters, end exclusive.

    Matches whose ``group`` is shorter than ``least`` are dropped after matching. Texts between the
    matches give the positions. They are gathered in parts, since each append copies what is there.
    """
    found = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))

    def step(s, m):
        start = s["at"] + F.char_length(m["gap"])
        end = start + F.coalesce(F.char_length(m["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), end.alias("end"), m["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(
            F.coalesce(F.char_length(m["value"]) >= least, F.lit(False)), F.array_append(s["out"], span)
        ).otherwise(s["out"]).alias("out"))

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def collected(all_found):
        def part(s, k):
            done = F.aggregate(F.slice(all_found, k * PART + 1, PART), F.struct(s["at"].alias("at"), none.alias("out")), step)
            return F.get(F.transform(F.array(done), lambda d: F.struct(
                d["at"].alias("at"), F.array_append(s["out"], d["out"]).alias("out"))), F.lit(0))

        parts = F.sequence(F.lit(0), F.floor((F.size(all_found) - 1) / PART).cast("int"))
        nothing = F.array().cast("array<array<struct<start:int,end:int,value:string>>>")
        return F.flatten(F.aggregate(parts, F.struct(F.lit(0).alias("at"), nothing.alias("out")), part)["out"])

    # An array of one element names a value that is used several times.
    return F.get(F.transform(F.array(found), collected), F.lit(0))


def _spans(text: Column) -> dict[str, Column]:
    """Base spans by kind. Runs that are maximal by themselves need no length test after matching."""
    long_enough = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
    return {
        kind: F.when(_gate(kind, text), matches(text, long_enough.get(kind, pattern), group, least))
        for kind, pattern, group, least in BASE}


def _at_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row, however often they are read."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _code(character: Column) -> Column:
    return F.instr(F.lit(ALPHABET), character)


def train(samples: DataFrame, text: str = "text", random: str = "random", smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratio of every step from one character to the next, as a flat square table.

    ``samples`` holds strings and whether they are random. Steps are counted in partial sums; the
    table has WIDTH**2 cells whatever is learnt from. NULL strings or labels teach nothing; without
    samples of a kind its model is uniform.
    """
    rows = picked(samples, text=text, random=random).where(F.col("text").isNotNull() & F.col("random").isNotNull())
    words = rows.groupBy("text", "random").agg(F.count(F.lit(1)).alias("n")).where(F.char_length("text") > 1)
    steps = words.select("random", "n", F.explode(F.sequence(F.lit(1), F.char_length("text") - 1)).alias("i"), "text").select(
        "random", "n", (F.instr(F.lit(ALPHABET), F.substring("text", F.col("i"), F.lit(1))) * WIDTH
                        + F.instr(F.lit(ALPHABET), F.substring("text", F.col("i") + 1, F.lit(1)))).alias("cell"))
    counts = steps.groupBy("cell").agg(
        F.sum(F.when(F.col("random"), F.col("n")).otherwise(0)).alias("yes"),
        F.sum(F.when(F.col("random"), 0).otherwise(F.col("n"))).alias("no"))
    at = F.floor(F.col("cell") / WIDTH)
    totals = counts.groupBy(at.alias("row")).agg(F.sum("yes").alias("all_yes"), F.sum("no").alias("all_no"))
    ratio = F.log((F.col("yes") + smoothing) / (F.col("all_yes") + smoothing * WIDTH)) - F.log(
        (F.col("no") + smoothing) / (F.col("all_no") + smoothing * WIDTH))
    empty = F.log(F.lit(1.0) / (F.col("all_yes") + smoothing * WIDTH)) - F.log(F.lit(1.0) / (F.col("all_no") + smoothing * WIDTH))
    cells = counts.withColumn("row", at).join(totals, "row").select("cell", ratio.alias("ratio"))
    rest = totals.select((-F.col("row") - 1).alias("cell"), empty.alias("ratio"))
    table = [0.0] * WIDTH**2
    learnt = {int(r["cell"]): r["ratio"] for r in cells.unionByName(rest).collect()}  # at most (WIDTH + 1) * WIDTH
    for cell in range(WIDTH**2):
        table[cell] = learnt.get(cell, learnt.get(-(cell // WIDTH) - 1, 0.0))
    return table


def ratio(text: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of a string: positive when it looks random."""
    cells = F.from_json(F.lit(json.dumps(table)), "array<double>")

    def step(s, c):
        code = _code(c)
        return F.struct(code.alias("before"), (s["sum"] + F.when(
            s["before"] >= 0, F.get(cells, s["before"] * WIDTH + code)).otherwise(0.0)).alias("sum"))

    start = F.struct(F.lit(-1).alias("before"), F.lit(0.0).alias("sum"))
    return F.aggregate(F.split(text, ""), start, step)["sum"]


def labelled_strings(docs: DataFrame, most_docs: int = 8000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, random): strings of a bounded sample of about ``most_docs`` documents, labelled by rule.

    Values that a base pattern finds are random; runs of six or more letters elsewhere are ordinary, and
    so are names made of such words in snake, camel and kebab case. Documents are chosen by a hash of id and text.
    """
    docs = picked(docs, doc_id=doc_id, text=text).where(F.col("text").isNotNull())
    share = min(1.0, most_docs / max(1, docs.count()))
    sample = docs.where(F.xxhash64("doc_id", F.length("text")) <= F.lit(hash_limit(share)))
    kinds = _spans(F.col("text"))
    values = F.flatten(F.array(*[F.coalesce(s, F.array().cast("array<struct<start:int,end:int,value:string>>"))
                                 for s in kinds.values()]))
    random = sample.select(F.explode(values["value"]).alias("text"), F.lit(True).alias("random"))
    rest = F.col("text")
    for _, pattern, _, _ in BASE[:2]:
        rest = F.regexp_replace(rest, pattern, " ")
    plain = _at_once(sample.select(rest.alias("rest")), words=F.regexp_extract_all("rest", F.lit("[A-Za-z]{6,}"), F.lit(0)))
    names = F.transform("words", lambda w, i: F.concat(
        w, F.lit("_"), F.lower(w), F.initcap(F.coalesce(F.get("words", i + 1), w)), F.lit("-"), w))
    return random.unionByName(plain.select(F.explode(F.concat("words", names)).alias("text"), F.lit(False).alias("random")))


def scan(docs: DataFrame, table: list[float], least: float = 9.0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per input row: doc_id, base and added spans, arrays of (start, kind number, end) in order.

    Base spans are the matches of the fixed patterns. Added are runs of 16 or more identifier
    characters, not digits alone, that touch no base span and whose log-likelihood ratio is at least ``least`` (9: odds of
    8,000 to 1). NULL and empty texts have none; every row is kept, repeated rows and NULL ids too.
    """
    own = picked(docs, doc_id=doc_id, text=text).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    nothing = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def numbered(spans, kind):
        return F.coalesce(F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"))), nothing)

    parts = [numbered(spans, i) for i, spans in enumerate(_spans(F.col("text")).values())]
    rows = _at_once(
        own, base=F.array_sort(F.flatten(F.array(*parts))),
        runs=F.when(_gate("random", F.col("text")), matches(F.col("text"), RUN)))
    odd = F.filter("runs", lambda r: r["value"].rlike("[A-Za-z]") & ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"]))
                   & (ratio(r["value"], table) >= least))
    return rows.select("doc_id", "base", numbered(odd, len(BASE)).alias("added"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

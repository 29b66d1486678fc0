"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of consecutive words. A document contains a window only
if it contains each of the window's shingles, so one shingle is enough to look for: the one that is
rarest in the documents. Documents are probed with that shingle alone; where it occurs, its offset
inside the window fixes the only possible start, length bounds drop starts that do not fit, and the
words of the window are compared exactly.

Everything is DataFrame expressions. Documents are read twice (once to count the item shingles,
once to probe) and never shuffled: only counts and hits are.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import except_for, lower_ascii, picked, stored

# Words: runs of anything but ASCII characters that are no letter or digit.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# A broadcast side has at most so many rows; beyond it the join shuffles.
MOST_BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))


def item_windows(items: DataFrame, window: int = 10, item_id: str = "item_id",
                 text: str = "text") -> DataFrame:
    """(item_id, win, span): each distinct window of an item; an item with fewer words is one.

    Items without id or without words give none.
    """
    words = picked(items, item_id=item_id, text=text).select("item_id", words_of("text").alias("w")).where(
        F.col("item_id").isNotNull() & (F.size("w") > 0))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return (
        words.select("item_id", "w", F.explode(starts).alias("i"))
        .select("item_id", F.slice("w", F.col("i"), F.lit(window)).alias("win")).distinct()
        .select("item_id", "win", F.size("win").alias("span"))
    )


def _shingle(words: Column, at: Column, size: int) -> Column:
    """Hash of ``size`` words from position ``at`` (from 0); NULL beyond the last word.

    The size is hashed along so that shingles of different sizes never meet.
    """
    parts = [F.get(words, at + i) for i in range(size)]
    return F.when(parts[-1].isNotNull(), F.xxhash64(F.lit(size), *parts))


def _exploded(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """One row per document word with the hashes of the shingles that start there."""
    rows = docs.select("doc_id", "text_id", "words", F.posexplode_outer("words").alias("pos", "word"))
    if len(sizes) == 1:
        return rows.withColumn("token", _shingle(F.col("words"), F.col("pos"), sizes[0])).drop("word")
    tokens = F.array(*[_shingle(F.col("words"), F.col("pos"), n) for n in sizes])
    return rows.drop("word").select("*", F.posexplode(tokens).alias("which", "token"))


def rarest_shingles(docs: DataFrame, windows: DataFrame, shingle: int, sizes: list[int],
                    max_broadcast_rows: int) -> DataFrame:
    """(win, span, items, token, offset): each distinct window with its rarest shingle.

    Rarity is the number of occurrences in all documents. A window with a shingle that occurs
    nowhere is left out: no document can contain it.
    """
    by_window = windows.groupBy("win", "span").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    length = F.least(F.col("span"), F.lit(shingle))
    token = F.coalesce(*[
        F.when(length == n, _shingle(F.col("win"), F.col("offset"), n)) for n in sizes])
    placed = by_window.select(
        "*", F.explode(F.sequence(F.lit(0), F.col("span") - length)).alias("offset")
    ).withColumn("token", token)
    wanted = placed.select("token").distinct()
    probes = _exploded(docs, sizes).select("token").where(F.col("token").isNotNull())
    if placed.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows:
        wanted = F.broadcast(wanted)
    counts = probes.join(wanted, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("seen"))
    rated = placed.join(counts, "token", "left").groupBy("win", "span", "items").agg(
        F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "offset", "token")).alias("best"))
    return rated.where("best.seen > 0").select(
        "win", "span", "items", F.col("best.token").alias("token"), F.col("best.offset").alias("offset"))


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3,
                  doc_id: str = "doc_id", text: str = "text",
                  max_broadcast_rows: int = MOST_BROADCAST_ROWS) -> DataFrame:
    """Per document: doc_id, text_id (hash of the text), n_words, n_hit, items (sorted ids), hits ((start, span) of windows).

    A word is hit when it lies in an occurrence of any window of any item.

    NULL and empty texts have no words and are never hit; a NULL id is kept as it is. Rows with
    equal id and equal text are one document and give one row; equal ids with different texts give
    one row each. An empty table of items hits nothing; repeated items count once per id.
    """
    docs = picked(docs, doc_id=doc_id, text=text).select(
        "doc_id", F.xxhash64("text").alias("text_id"), words_of(F.coalesce("text", F.lit(""))).alias("words"))
    windows = item_windows(items, window)
    sizes = sorted(r[0] for r in windows.select(F.least("span", F.lit(shingle))).distinct().collect())
    prefix = stored(rarest_shingles(docs, windows, shingle, sizes or [shingle], max_broadcast_rows), "prefix")
    rows = _exploded(docs, sizes or [shingle]).withColumn("n_words", F.size("words"))
    start = F.col("pos") - F.col("offset")
    fits = (start >= 0) & (start + F.col("span") <= F.col("n_words"))
    same = F.slice("words", F.col("start") + 1, F.col("span")) == F.col("win")
    hit = F.struct("start", "span", "items")
    if prefix.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows:
        probed = rows.join(F.broadcast(prefix), "token", "left").withColumn("start", F.when(fits, start))
        found = probed.select(
            "doc_id", "text_id", F.when(F.coalesce(F.col("pos") == 0, F.lit(True)), F.col("n_words")).alias("n_words"),
            F.when(F.col("start").isNotNull() & same, hit).alias("hit"),
        ).where(F.col("n_words").isNotNull() | F.col("hit").isNotNull())
    else:
        key = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("doc_id", "text_id")]
        placed = rows.drop("words").join(prefix, "token").where(fits).withColumn("start", start)
        hits = placed.alias("a").join(docs.alias("b"), key).where(same).select(
            "a.doc_id", "a.text_id", "a.n_words", hit.alias("hit"))
        found = hits.unionByName(
            docs.select("doc_id", "text_id", F.size("words").alias("n_words")), allowMissingColumns=True)
    covered = F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["span"] - 1)))
    return (
        found.groupBy("doc_id", "text_id")
        .agg(F.max("n_words").alias("n_words"), F.collect_set("hit").alias("hits"))
        .select(
            "doc_id", "text_id", F.col("n_words").cast("long"), F.size(F.array_distinct(covered)).cast("long").alias("n_hit"),
            F.array_distinct(F.flatten("hits.items")).alias("items"), "hits")
    )


def clean(docs: DataFrame, items: DataFrame, window: int = 10, doc_id: str = "doc_id",
          text: str = "text") -> DataFrame:
    """The documents, with all their columns, that hold no window of any item."""
    hit = contamination(docs, items, window, doc_id=doc_id, text=text).where("n_hit > 0")
    return except_for(docs, hit, {f"`{doc_id}`": "doc_id", f"xxhash64(`{text}`)": "text_id"})

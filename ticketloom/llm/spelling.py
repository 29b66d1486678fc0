"""Grouping spelling variants by pivotal grams.

Words that one edit turns into each other keep all bigrams but those at the edit. In an order by rarity,
a word's prefix is its three rarest bigrams; of these, dynamic programming chooses two disjoint ones with
the fewest occurrences as pivots, and one edit spares at least one of them. It is then found in the other word's prefix,
provided that the word with the smaller last gram of its prefix gives the pivots. Since the edit lies on one side of the
pivot, the other side is the same in both: it fixes the position, and its hash narrows the key.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import arrow_map, picked, raw_bytes, stored

# Letters of a word, once A-Z are lower case, and what counts as a word.
LETTERS = "a-zÀ-ÿ"
LEAST_SIZE, LEAST_COUNT = 6, 5
# A word of this many times the count is a variant's form.
FACTOR = 5
# Edits, letters of a gram, and what follows: grams in a prefix, and disjoint ones among them.
EDITS, GRAM = 1, 2
PREFIX, PIVOTS = EDITS * GRAM + 1, EDITS + 1
# Words whose counts a worker holds before it hands them on.
MOST_WORDS = 300_000


def spoiled(word: str, h: int, every: int) -> str:
    """``word`` without one letter when ``every`` divides ``h``."""
    if h % every:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1:]


def word_counts(docs: DataFrame, spoil_every: int = 0, least_size: int = LEAST_SIZE, least_count: int = LEAST_COUNT,
                doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): runs of letters of at least ``least_size`` with their occurrences in all texts, ``least_count`` at least.

    Only A-Z are lower-cased. With ``spoil_every`` a run loses a letter where that number divides the
    CRC-32 of ``id:run`` (a NULL id: empty), which plants misspellings. NULL texts have no words; repeated rows
    count again. Counts are summed in the workers before the shuffle.
    """
    run_of = re.compile(f"[{LETTERS}]{{{least_size},}}")

    def table(total):
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

    def run(batches):
        total: dict[str, int] = {}
        for batch in batches:
            for own, content in zip(batch.column(0).to_pylist(), raw_bytes(batch.column(1))):
                if content is None:
                    continue
                start = zlib.crc32(f"{'' if own is None else own}:".encode())
                for word, n in Counter(run_of.findall(content.lower().decode())).items():
                    if spoil_every:
                        word = spoiled(word, zlib.crc32(word.encode(), start), spoil_every)
                        if len(word) < least_size:
                            continue
                    total[word] = total.get(word, 0) + n
            if len(total) > MOST_WORDS:
                yield table(total)
                total = {}
        yield table(total)

    own = picked(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("string"))
    counts = arrow_map(own, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return stored(counts.where(F.col("n") >= least_count), "words")


def gram_ranks(words: DataFrame) -> dict[str, tuple[int, int]]:
    """Bigram -> (rank by rarity, number of words). Letters number 90, so that at most 8,100 bigrams exist."""
    grams = words.select(F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.char_length("word") - (GRAM - 1)), lambda i: F.substring(F.col("word"), i, F.lit(GRAM))))).alias("gram"))
    rows = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()
    return {gram: (rank, n) for rank, (n, gram) in enumerate(sorted((r.n, r.gram) for r in rows))}


def prefix_places(ranks: list[int]) -> tuple[list[int], int]:
    """Places of the grams in a word's prefix, in order, and the rank of its last gram.

    Equal grams are all in it or none: which of them the other word keeps is not known.
    """
    edge = sorted(ranks)[PREFIX - 1]
    return [p for p, rank in enumerate(ranks) if rank <= edge], edge


def pivot_places(places: list[int], weights: list[int]) -> list[int]:
    """The PIVOTS places, at least a gram apart, of the smallest total weight.

    best[k] holds the cheapest choice of k places among those at least a gram before the next one.
    """
    best: list[tuple[int, list[int]] | None] = [(0, []), *[None] * PIVOTS]
    waiting: list[tuple[int, list]] = []
    for place, weight in zip(places, weights):
        while waiting and waiting[0][0] + GRAM <= place:
            for k, found in waiting.pop(0)[1]:
                best[k] = found if best[k] is None else min(best[k], found)
        waiting.append((place, [(k + 1, (best[k][0] + weight, [*best[k][1], place])) for k in range(PIVOTS) if best[k]]))
    for _, choices in waiting:
        for k, found in choices:
            best[k] = found if best[k] is None else min(best[k], found)
    return best[PIVOTS][1]


def _sides(word: str) -> tuple[list[int], list[int]]:
    """Hash of what ends behind the gram at each place, and of what starts with it."""
    letters = [c.encode() for c in word]
    ahead = list(accumulate(letters, lambda h, c: zlib.crc32(c, h), initial=0))
    behind = list(accumulate(reversed(letters), lambda h, c: zlib.crc32(c, h), initial=0))
    size = len(letters)
    return [ahead[p + GRAM] for p in range(size - GRAM + 1)], [behind[size - p] for p in range(size - GRAM + 1)]


def keys_of(word: str, ranks: dict[str, tuple[int, int]]) -> tuple[list[int], list[int], int]:
    """(keys of the pivots, keys of the prefix, rank of the prefix's last gram) of a word.

    A key names a side, what stands there up to and with the gram, and the length of the word of the prefix.
    """
    grams = [ranks[word[p:p + GRAM]] for p in range(len(word) - GRAM + 1)]
    places, edge = prefix_places([rank for rank, _ in grams])
    left, right = _sides(word)

    def key(side: int, place: int, size: int) -> int:
        return (right if side else left)[place] << 31 | size << 1 | side

    pivots = pivot_places(places, [grams[p][1] for p in places])
    probes = [key(side, p, len(word) + longer) for p in pivots for side in (0, 1) for longer in range(-EDITS, EDITS + 1)]
    return probes, [key(side, p, len(word)) for p in places for side in (0, 1)], edge


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): pairs of ``words`` (word, n) one edit apart, each pair once."""
    shared = words.sparkSession.sparkContext.broadcast(gram_ranks(words))

    def run(batches):
        ranks = shared.value
        for batch in batches:
            found = [keys_of(word, ranks) for word in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([p for p, _, _ in found], pa.list_(pa.int64())),
                 pa.array([i for _, i, _ in found], pa.list_(pa.int64())), pa.array([e for _, _, e in found], pa.int32())],
                names=["word", "n", "probes", "entries", "edge"])

    keyed = stored(arrow_map(words.select("word", "n"), run, "word string, n long, probes array<long>, entries array<long>, edge int"), "grams")

    def side(prefix: str, keys: str) -> DataFrame:
        return keyed.select(F.explode(F.array_distinct(keys)).alias("key"), *[F.col(c).alias(f"{prefix}_{c}") for c in ("word", "n", "edge")])

    met = side("a", "probes").join(side("b", "entries"), "key").where(
        (F.col("a_edge") <= F.col("b_edge")) & (F.levenshtein("a_word", "b_word", EDITS) == EDITS))
    first = F.col("a_word") < F.col("b_word")
    a, b = (F.struct(F.col(f"{x}_word").alias("word"), F.col(f"{x}_n").alias("n")) for x in "ab")
    pairs = met.select(F.when(first, a).otherwise(b).alias("a"), F.when(first, b).otherwise(a).alias("b"))
    return stored(pairs.select(F.col("a.word").alias("a"), F.col("a.n").alias("a_n"), F.col("b.word").alias("b"),
                               F.col("b.n").alias("b_n")).distinct(), "near")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): the last form that can be reached.

    Each round doubles the steps behind a row; counts grow along a chain by ``FACTOR``, so rounds are few.
    """
    found = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = stored(found.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                                 F.col("further").isNotNull().alias("moved")), "roots")
        if longer.where("moved").limit(1).count() == 0:
            return longer.select("word", "root")
        found = longer.select("word", "root")


def variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """Per row of ``words`` (word, n; different words of at least 6 of the letters a-z and U+00C0 to U+00FF):
    word, n, n_near, form, form_n, root.

    n_near counts the words one inserted, deleted or replaced letter away. The form is the commonest of them (ties: the
    first by code point) if it has at least ``factor`` times the word's count, else NULL; the root is the end of the
    chain of forms, the word itself without one. An empty table gives no rows.
    """
    pairs = near_pairs(words)
    ways = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    best = stored(ways.groupBy(F.col("a").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("near"))).alias("best"),
        F.first("a_n").alias("own")), "best")
    form = _if(-F.col("best.less") >= factor * F.col("own"))
    told = stored(best.select("word", "n_near", form(F.col("best.near")).alias("form"), form(-F.col("best.less")).alias("form_n")), "forms")
    ends = roots(told.where("form is not null"))
    return words.select("word", "n").join(told, "word", "left").join(ends, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def _if(condition: Column):
    return lambda value: F.when(condition, value)

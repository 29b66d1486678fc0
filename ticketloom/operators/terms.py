"""Term statistics over whole texts: TF-IDF per group and terms on the rise."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.ml.feature import StopWordsRemover

from .. import scale
from ..functions.clean import round_exact
from ..functions.text import TOKEN, tokens


def english_stop_words() -> list[str]:
    """Default stop list; needs an active session."""
    return StopWordsRemover.loadDefaultStopWords("english")


def _run(words: Column, n: int):
    """Joins a word with the ``n - 1`` words after it; NULL where one of them is NULL."""
    def joined(w, i):
        return F.concat(w, *[part for j in range(1, n) for part in (F.lit(" "), F.get(words, i + j))])
    return joined


def _grams(words: Column, low: int, high: int) -> Column:
    """All runs of ``low`` to ``high`` neighbouring words."""
    parts = []
    for n in range(low, high + 1):
        if n == 1:
            parts.append(words)
            continue
        starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0)))
        parts.append(F.transform(starts, _run(words, n)))
    return F.concat(*parts)


def terms(docs: DataFrame, text: str, stop_words: list[str], low: int = 1, high: int = 2,
          pattern: str = TOKEN) -> DataFrame:
    """Replace the text by ``terms``: its n-grams after stop words are removed."""
    worded = docs.withColumn("_words", tokens(text, stop_words, pattern)).drop(text)
    return worded.withColumn("terms", _grams(F.col("_words"), low, high)).drop("_words")


def bags(docs: DataFrame, text: str, stop_words: list[str], low: int = 1, high: int = 2,
         pattern: str = TOKEN) -> DataFrame:
    """Replace the text by ``bag``: (term, tf) of the document, counted inside its own row.

    Equal neighbours in the sorted term list form one run, so no shuffle is needed.
    """
    counted = _counted(terms(docs, text, stop_words, low, high, pattern))
    return counted.withColumn("bag", F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))).drop("terms", "tfs")


def _counted(docs: DataFrame) -> DataFrame:
    """Replace ``terms`` by the different ones in order, and add ``tfs``: how often each occurs.

    Two lists, as building a struct per term takes several times as long.
    """
    ordered = docs.withColumn("_sorted", F.sort_array("terms")).drop("terms")
    # Last place of each run of equal terms. Places of an empty list read NULL twice and leave.
    ends = ordered.withColumn("_ends", F.filter(
        F.sequence(F.lit(0), F.size("_sorted") - 1),
        lambda i: ~F.get("_sorted", i).eqNullSafe(F.get("_sorted", i + 1))))
    return ends.withColumns({
        "terms": F.transform("_ends", lambda e: F.get("_sorted", e)),
        "tfs": F.transform("_ends", lambda e, k: e - F.coalesce(F.get("_ends", k - 1), F.lit(-1))),
    }).drop("_sorted", "_ends")


def unpack(df: DataFrame, array: str, name: str) -> DataFrame:
    """One row per element of a computed array.

    A plain ``explode`` lets the optimizer infer a not-empty filter and push it below the
    projections that build the array, which would build it again inside each lambda. The outer
    form infers nothing; its row for an empty array is dropped afterwards.
    """
    kept = [c for c in df.columns if c != array]
    return df.select(*kept, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def group_sizes(docs: DataFrame, group: str | list[str], min_docs: int = 3) -> DataFrame:
    """Documents per group, and whether the group is large enough to score."""
    return docs.groupBy(*_keys(group)).agg(F.count(F.lit(1)).alias("docs")).withColumn(
        "scored", F.col("docs") >= min_docs)


def _keys(group: str | list[str]) -> list[str]:
    return [group] if isinstance(group, str) else list(group)


def skipped_groups(docs: DataFrame, group: str | list[str], min_docs: int = 3) -> DataFrame:
    return group_sizes(docs, group, min_docs).where("not scored").select(*_keys(group), "docs")


def group_top_terms(docs: DataFrame, doc_id: str, group: str | list[str], text: str,
                    stop_words: list[str] | None = None, k: int = 10, cap: int = 500,
                    min_docs: int = 3, pattern: str = TOKEN) -> DataFrame:
    """Top ``k`` terms per group by mean TF-IDF over the group's documents.

    ``group`` names one column or several, such as a week and a label. Vocabulary per group: the
    ``cap`` terms with the highest corpus count. Weights are tf * (ln((1+n)/(1+df)) + 1), scaled to
    unit length per document, averaged over all documents of the group.

    Texts are cut into words once. Words too rare for the vocabulary leave before terms are made of the others
    (``_frequent_words``), as codes; groups in which such words are too many count all terms as texts. The bags of
    terms are kept for the second reading. Term counts are
    combined before the shuffle. The vocabulary then comes to each document as one table of its group, so that weights
    and the document's length are computed inside its row: documents are not shuffled by id. Tables have at
    most ``cap`` terms per group; they are broadcast when the number of groups keeps them within the bound, and
    joined by a shuffle that cuts large groups beyond it.
    """
    keys = _keys(group)
    stop = english_stop_words() if stop_words is None else stop_words
    sizes = scale.settle(scale.numbered(
        group_sizes(docs, keys, min_docs).where("scored").select(*keys, "docs"), [F.col(c) for c in keys], "_group"))
    bound = scale.MAX_BROADCAST_ROWS
    groups = scale.row_count_within(sizes, bound)
    chosen = scale.lookup(docs.select(doc_id, *keys, text), sizes, keys, [doc_id], "inner", bound, groups).drop(*keys)
    # All counts go by the group's number, which is shorter to hash, sort and send than its columns.
    of_group = W.partitionBy("_group")
    worded = scale.settle(_worded(chosen, text, stop, pattern))

    def ranked(bagged: DataFrame) -> DataFrame:
        """(_group, rank, term, score) of documents with ``terms``, as texts or as codes in the same order."""
        counted = scale.settle(_counted(bagged))
        occurrences = unpack(counted.select("_group", "docs", F.arrays_zip("terms", "tfs").alias("bag")), "bag", "b").select(
            "_group", "docs", F.col("b.terms").alias("term"), F.col("b.tfs").alias("tf"))
        corpus = occurrences.groupBy("_group", "term").agg(
            F.sum("tf").alias("ctf"), F.count(F.lit(1)).alias("df"), F.max("docs").alias("_n"))
        common = of_group.orderBy(F.desc("ctf"), "term")
        vocabulary = (
            corpus.withColumn("_r", F.row_number().over(common)).where(F.col("_r") <= cap)
            .select("_group", "term",
                    (F.log((1 + F.col("_n")) / (1 + F.col("df"))) + 1).alias("idf"))
        )
        tables = scale.settle(_term_tables(vocabulary, ["_group"], "idf"))
        weighed = _beside(counted, tables, ["_group"], doc_id, groups * cap, "inner")
        scores = (
            _unit_weights(weighed, ["_group", "docs"]).groupBy("_group", "term")
            .agg((F.sum("w") / F.max("docs")).alias("raw_score"))
            .withColumn("score", round_exact(F.col("raw_score"), 9))
        )
        best = of_group.orderBy(F.desc("score"), "term")
        return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
            "_group", "rank", "term", "score")

    bits = (2 * cap).bit_length()
    if pattern == TOKEN and 2 * bits < 64:
        words = unpack(worded.select("_group", "words"), "words", "term").groupBy("_group", "term").agg(F.count(F.lit(1)).alias("n"))
        frequent = scale.settle(_numbered_words(_frequent_words(words, ["_group"], cap), ["_group"], bits))
        tables = scale.settle(_term_tables(frequent, ["_group"], "code"))
        entries = scale.row_count_within(frequent, bound)
        top = _spelled(ranked(_coded_terms(_beside(worded, tables, ["_group"], doc_id, entries, "inner"), bits)), frequent, ["_group"], bits)
        rest = sizes.select("_group").join(tables.select("_group"), "_group", "left_anti")
        if not rest.isEmpty():
            rest = scale.settle(rest)
            top = top.unionByName(ranked(_frequent_terms(_beside(worded, rest, ["_group"], doc_id, groups, "inner"), None, ["_group"], doc_id)))
    else:
        top = ranked(_frequent_terms(worded, None, ["_group"], doc_id))
    return scale.lookup(top, sizes.select("_group", *keys), ["_group"], ["term"], "inner", bound, groups).select(
        *keys, "rank", "term", "score")


# Slots of a group's term table, a power of two; a look-up reads one of them, which seldom has more than one entry.
_SLOTS = 1024


def _slot(term: Column) -> Column:
    return F.hash(term).bitwiseAND(_SLOTS - 1)


def _beside(docs: DataFrame, tables: DataFrame, keys: list[str], doc_id: str, entries: int, how: str) -> DataFrame:
    """Documents with their group's table: broadcast when all tables have at most ``entries`` within the bound."""
    if entries <= scale.MAX_BROADCAST_ROWS:
        return docs.join(F.broadcast(tables), keys, how)
    return scale.spread_join(docs, tables, keys, [doc_id], how)


def _as_slots(filled: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(_SLOTS - 1)), lambda i: F.try_element_at(filled, i))


def _term_tables(vocabulary: DataFrame, keys: list[str], value: str | None = None) -> DataFrame:
    """One row per group: ``slots``, an array of _SLOTS short lists of terms; ``values``, the same of what belongs to each term.

    Two lists, as looking for a struct takes a lambda per term.
    """
    columns = {"slots": "term"} | ({"values": value} if value else {})
    entries = vocabulary.groupBy(*keys, _slot(F.col("term")).alias("_at")).agg(
        F.collect_list(F.struct(*columns.values())).alias("_entries"))
    filled = entries.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_at", "_entries"))).alias("_filled"))

    def listed(column):
        return F.transform("_slots", lambda slot: slot[column])
    return filled.select(*keys, _as_slots(F.col("_filled")).alias("_slots")).select(
        *keys, *[listed(column).alias(name) for name, column in columns.items()])


def _value(term: Column) -> Column:
    """What the table beside the row has for the term, or NULL."""
    at = F.array_position(F.get("slots", _slot(term)), term).cast("int")
    return F.get(F.get("values", _slot(term)), at - 1)


def _worded(docs: DataFrame, text: str, stop_words: list[str], pattern: str) -> DataFrame:
    return docs.withColumn("words", tokens(text, stop_words, pattern)).drop(text)


def _frequent_words(words: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """(keys, term): the words that the ``cap`` most frequent terms of a group can be made of, from (keys, term, n).

    A run of words occurs no more often than any of its words, and at least ``cap`` words occur as often as the
    ``cap``-th does: a term with a rarer word is behind all of these. Words equal to the ``cap``-th stay.
    A group in which these are too many has no rows, and all its terms are to be counted. This holds for words
    without blanks only: others may give one term from different runs.
    """
    often = W.partitionBy(*keys).orderBy(F.desc("n"))
    ranked = words.withColumn("_r", F.rank().over(often)).where(F.col("_r") <= cap)
    return ranked.withColumn("_all", F.count(F.lit(1)).over(W.partitionBy(*keys))).where(
        F.col("_all") <= 2 * cap).select(*keys, "term")


def _frequent_terms(worded: DataFrame, frequent: DataFrame | None, keys: list[str], spread: str) -> DataFrame:
    """Replace ``words`` by ``terms``: the words and pairs of neighbours that consist of the group's frequent words."""
    if frequent is None:
        return worded.withColumn("terms", _grams(F.col("words"), 1, 2)).drop("words")
    tables = scale.settle(_term_tables(frequent, keys))
    entries = scale.row_count_within(frequent, scale.MAX_BROADCAST_ROWS)

    def known(w):
        return F.when(F.array_contains(F.get("slots", _slot(w)), w), w)

    def pair(w, i):
        return F.when(w.isNotNull(), F.concat(w, F.lit(" "), F.get("_known", i + 1)))
    kept = _beside(worded, tables, keys, spread, entries, "left").withColumn(
        "_known", F.when(F.col("slots").isNull(), F.col("words")).otherwise(F.transform("words", known)))
    return kept.drop("words", "slots").withColumn(
        "terms", F.array_compact(F.concat("_known", F.transform("_known", pair)))).drop("_known")


def _numbered_words(words: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """Add ``code``: the number of the word in its group, from 1, above ``bits`` zeros that the second word of a pair takes.

    Codes sort as the terms they stand for: a blank is before all characters of a word.
    """
    return words.withColumn("code", F.shiftleft(F.row_number().over(W.partitionBy(*keys).orderBy("term")).cast("long"), bits))


def _coded_terms(worded: DataFrame, bits: int) -> DataFrame:
    """Replace ``words`` by ``terms`` as ``_frequent_terms`` does, in codes, which are shorter to join, sort and count."""
    def pair(code, i):
        return code + F.shiftright(F.get("_known", i + 1), bits)
    known = worded.withColumn("_known", F.transform("words", _value)).drop("words", "slots", "values")
    return known.withColumn("terms", F.array_compact(F.concat("_known", F.transform("_known", pair)))).drop("_known")


def _spelled(terms_of: DataFrame, words: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """Codes in ``term`` as texts again."""
    first = words.select(*keys, F.col("code").alias("_a"), F.col("term").alias("_first"))
    second = words.select(*keys, F.shiftright("code", bits).alias("_b"), F.col("term").alias("_second"))
    parts = terms_of.withColumn("_b", F.col("term").bitwiseAND((1 << bits) - 1)).withColumn("_a", F.col("term") - F.col("_b"))
    return parts.join(first, [*keys, "_a"]).join(second, [*keys, "_b"], "left").withColumn(
        "term", F.concat_ws(" ", "_first", "_second")).drop("_a", "_b", "_first", "_second")


def _unit_weights(docs: DataFrame, kept: list[str]) -> DataFrame:
    """(kept, term, w): the document's terms that its table knows, tf * idf scaled to length 1."""
    def weight(term, tf):
        return tf * _value(term)

    def add_square(total, w):
        return total + F.coalesce(w * w, F.lit(0.0))
    weighed = docs.select(*kept, "terms", F.zip_with("terms", "tfs", weight).alias("w")).withColumn(
        "_length", F.sqrt(F.aggregate("w", F.lit(0.0), add_square)))
    each = unpack(weighed.select(*kept, "_length", F.arrays_zip("terms", "w").alias("_all")), "_all", "x")
    return each.where(F.col("x.w").isNotNull()).select(
        *kept, F.col("x.terms").alias("term"), (F.col("x.w") / F.col("_length")).alias("w"))


def emerging_terms(docs: DataFrame, period: str, text: str, step: int,
                   stop_words: list[str] | None = None, k: int = 10, cap: int = 1000,
                   min_previous: int = 20, min_count: int = 3, pattern: str = TOKEN) -> DataFrame:
    """Terms whose rate per document rose from one period to the next, for every period.

    ``period`` is an integer or a date; the previous one is ``step`` before it. Vocabulary per
    pair of periods: the ``cap`` terms most frequent over both. A term counts when it occurs at
    least ``min_count`` times now and its rate is higher. Periods whose predecessor has fewer
    than ``min_previous`` documents give nothing.

    Texts are cut into words once. The words of a period that are too rare for the vocabulary of both of its pairs
    leave before terms are made of the others (``_frequent_words``).
    """
    stop = english_stop_words() if stop_words is None else stop_words
    is_date = dict(docs.dtypes)[period] == "date"
    dated = docs.where(F.col(period).isNotNull()).select(period, text)

    def ahead(c):
        return F.date_add(c, step) if is_date else (c + step).cast(dict(docs.dtypes)[period])

    sizes = dated.groupBy(period).agg(F.count(F.lit(1)).alias("n"))
    pairs = sizes.withColumnRenamed("n", "n_now").join(
        sizes.select(ahead(F.col(period)).alias(period), F.col("n").alias("n_before")), period
    ).where(F.col("n_before") >= min_previous)

    def back(c):
        return F.date_sub(c, step) if is_date else (c - step).cast(dict(docs.dtypes)[period])

    def sided(counts):
        """Counts (now, before) of each pair, which is named by its later period."""
        return counts.select("term", F.explode(F.array(
            F.struct(F.col(period).alias("p"), F.col("c").alias("now"), F.lit(0).cast("long").alias("before")),
            F.struct(ahead(F.col(period)).alias("p"), F.lit(0).cast("long").alias("now"), F.col("c").alias("before")),
        )).alias("s")).groupBy(F.col("s.p").alias(period), "term").agg(
            F.sum("s.now").alias("now"), F.sum("s.before").alias("before"))

    def counted(frame, array):
        return unpack(frame, array, "term").groupBy(period, "term").agg(F.count(F.lit(1)).alias("c"))

    worded = scale.settle(_worded(dated, text, stop, pattern))
    words = None
    if pattern == TOKEN:
        of_pairs = _frequent_words(
            sided(counted(worded, "words")).select(period, "term", (F.col("now") + F.col("before")).alias("n")), [period], cap)
        # A period belongs to two pairs, and its terms are only cut where both have their words named.
        each = of_pairs.select("term", F.explode(F.array(
            F.struct(F.col(period).alias("p"), F.lit(True).alias("later"), F.lit(False).alias("earlier")),
            F.struct(back(F.col(period)).alias("p"), F.lit(False).alias("later"), F.lit(True).alias("earlier")),
        )).alias("s")).groupBy(F.col("s.p").alias(period), "term").agg(
            F.max("s.later").alias("later"), F.max("s.earlier").alias("earlier"))
        whole = W.partitionBy(period)
        words = scale.settle(each.withColumn("_both", F.max("later").over(whole) & F.max("earlier").over(whole)).where(
            "_both").select(period, "term"))
    pair_counts = sided(counted(_frequent_terms(worded, words, [period], "words"), "terms"))
    frequent = W.partitionBy(period).orderBy(F.desc(F.col("now") + F.col("before")), "term")
    kept = pair_counts.withColumn("_r", F.row_number().over(frequent)).where(F.col("_r") <= cap)
    rated = kept.join(pairs, period).select(
        period, "term", "now",
        (F.col("now") / F.col("n_now")).alias("rate_now"),
        (F.col("before") / F.col("n_before")).alias("rate_before"),
    ).where((F.col("rate_now") > F.col("rate_before")) & (F.col("now") >= min_count))
    gains = rated.withColumn("gain", round_exact(F.col("rate_now") - F.col("rate_before"), 4))
    best = W.partitionBy(period).orderBy(F.desc("gain"), "term")
    return gains.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        period, "rank", "term", "gain")

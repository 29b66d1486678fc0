"""Language identification: known words first, shorter and shorter character n-grams otherwise.

A word of the model adds its log frequency in each language. A word that the model does not know
adds the mean log frequency of its longest n-grams that the model knows; if it knows none of that
length, the next shorter length is tried. The language with the highest sum wins.

Fitting reads a bounded sample per language; scoring reads every whole text where it lies.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from .shared import arrow_map, hash_limit, picked

WORD = re.compile(r"[^\W\d_]+")
LENGTHS = (5, 4, 3, 2, 1)
UNDECIDED = "und"
# Words whose scores a worker remembers.
MOST_WORDS = 200_000


def grams(word: str, length: int) -> list[str]:
    """Character n-grams of a word with its edges marked; one-character grams without edges."""
    edged = word if length == 1 else f" {word} "
    return [edged[i:i + length] for i in range(len(edged) - length + 1)]


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether a document's id falls into the part that is never learnt from. NULL ids do not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


class Model:
    """Log frequencies of words and n-grams by language."""

    def __init__(self, languages: list[str], counts: dict[int, dict[str, dict[str, int]]]):
        """``counts``: length (0 for words) -> term -> language -> count."""
        self.languages = languages
        self.rows, self.index = {}, {}
        place = {lang: i for i, lang in enumerate(languages)}
        for length, terms in counts.items():
            table = np.zeros((len(terms), len(languages)))
            for row, by_language in enumerate(terms.values()):
                for lang, n in by_language.items():
                    table[row, place[lang]] = n
            total = table.sum(axis=0) + 0.5 * (len(terms) + 1)
            self.rows[length] = np.log((table + 0.5) / total)
            self.index[length] = {term: row for row, term in enumerate(terms)}

    def score(self, word: str) -> np.ndarray:
        """Score of one lower-case word in each language; zeros when nothing of it is known."""
        row = self.index.get(0, {}).get(word)
        if row is not None:
            return self.rows[0][row]
        for length in LENGTHS:
            index = self.index.get(length, {})
            known = [index[g] for g in grams(word, length) if g in index]
            if known:
                return self.rows[length][known].mean(axis=0)
        return np.zeros(len(self.languages))


class Scorer:
    """A model with a bounded memory of scored words."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.table = np.empty((1024, len(self.model.languages)))

    def judge(self, text: str | None) -> tuple[str, float]:
        """Language and its share of the likelihood; (und, 0) without a letter or a model."""
        words = WORD.findall(text.lower()) if text else []
        # A run of word characters may hold signs such as a raised two and no letter at all.
        if not self.model.languages or not any(w.isalpha() or any(map(str.isalpha, w)) for w in words):
            return UNDECIDED, 0.0
        if len(self.place) > MOST_WORDS:
            self.forget()
        place = self.place
        for word in words:
            if word not in place:
                if len(place) == len(self.table):
                    self.table = np.concatenate([self.table, np.empty_like(self.table)])
                self.table[len(place)] = self.model.score(word)
                place[word] = len(place)
        rows = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        total = self.table[rows].sum(axis=0)
        best = int(total.argmax())
        return self.model.languages[best], float(1 / np.exp(total - total[best]).sum())


def training_rows(docs: DataFrame, per_language: int, doc_id: str, text: str, lang: str) -> DataFrame:
    """At most about ``per_language`` documents of each language, chosen by a hash of the id."""
    rows = picked(docs, doc_id=doc_id, text=text, lang=lang).where(
        F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    shares = rows.groupBy("lang").count().select(
        "lang", F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("count")).alias("share"))
    chosen = {r["lang"]: r["share"] for r in shares.collect()}
    if not chosen:
        return rows.select("text", "lang").limit(0)
    limit = F.element_at(F.create_map(*[F.lit(x) for lang, share in chosen.items() for x in (lang, hash_limit(share))]), F.col("lang"))
    return rows.where(F.xxhash64("doc_id") <= limit).select("text", "lang")


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Counts of words and their n-grams by language, summed over a slice."""
    for batch in batches:
        by_language: dict[str, Counter] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by_language.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
        for lang, words in by_language.items():
            tables = {0: words} | {n: Counter() for n in LENGTHS}
            for word, n in words.items():
                for length in LENGTHS:
                    table = tables[length]
                    for gram in grams(word, length):
                        table[gram] += n
            for length, table in tables.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(table)), pa.array([length] * len(table), pa.int32()),
                     pa.array(list(table)), pa.array(list(table.values()), pa.int64())],
                    names=["lang", "length", "term", "n"])


def fit(docs: DataFrame, per_language: int = 3000, most_terms: int = 8000, doc_id: str = "doc_id",
        text: str = "text", lang: str = "lang") -> Model:
    """Model from the documents that are not held out.

    The sample takes about ``per_language`` documents of each language (all, if there are fewer);
    the model keeps the ``most_terms`` most frequent words, and n-grams of each length, of each
    language, so that its size is bounded whatever is learnt from. Rows without id, text or language
    teach nothing; without any row the model knows no language.
    """
    counts = arrow_map(
        training_rows(docs, per_language, doc_id, text, lang), _counted, "lang string, length int, term string, n long"
    ).groupBy("lang", "length", "term").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang", "length").orderBy(F.desc("n"), "term"))
    kept = counts.withColumn("rank", rank).where(F.col("rank") <= most_terms).select("lang", "length", "term", "n")
    table = kept.toArrow()
    columns = [table.column(c).to_pylist() for c in ("lang", "length", "term", "n")]
    by_length: dict[int, dict[str, dict[str, int]]] = {}
    for language, length, term, n in sorted(zip(*columns)):
        by_length.setdefault(length, {}).setdefault(term, {})[language] = n
    return Model(sorted(set(columns[0])), by_length)


def identified(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per input row: doc_id, lang_pred, score.

    ``score`` is the likelihood of the language over the sum of all languages' likelihoods. Texts
    that are NULL, empty or without a letter are ``und`` with score 0; equally likely languages give
    the first by name. Every row is kept, repeated rows and NULL ids too.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, lang_pred string, score double"

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            judged = [scorer.judge(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([j[0] for j in judged], pa.string()),
                 pa.array([j[1] for j in judged], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return arrow_map(picked(docs, doc_id=doc_id, text=text), run, schema)


def with_language(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents with all their columns, and ``lang_pred`` and ``score`` behind them (in place of
    columns that had these names)."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            judged = [scorer.judge(text) for text in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([j[0] for j in judged], pa.string()),
                 pa.array([j[1] for j in judged], pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    wanted = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return arrow_map(docs, run, wanted)

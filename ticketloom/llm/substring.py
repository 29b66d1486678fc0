"""Removal of repeated passages by one doubling of the window length.

A window of words can only repeat when both of its halves repeat. So windows of half the length are
looked at first, and only those that repeat are extended to the full length. On the first level
not every position is needed: among the half windows inside a full window the one with the smallest
hash stands for it, wherever that window occurs, so that about one position in fourteen is sent out
and still no repeat can be missed. Positions whose stand-in repeats survive to the next level, where
each full window is told apart by 126 bits; the search ends early when no candidate is left.

Rows that travel are hashes with document ids. Both levels are sums per hash (the smallest and
largest document), combined before the shuffle and stored before they are joined back to the rows: both
sides of that join are shuffle reads, so that a hash which a third of all documents share is divided
among tasks, never one group of rows.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import WordHashes, arrow_map, picked, raw_bytes, signed, stored, window_hashes


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` consecutive values."""
    if len(x) < width:
        return x[:0]
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:len(out) - step], out[step:])
        have += step
    return out


def stand_ins(hashes: np.ndarray, window: int) -> np.ndarray:
    """For each full window the smallest hash of its half windows."""
    half = (window + 1) // 2
    return sliding_min(window_hashes(hashes, half), window - half + 1)


def _first_level(window: int):
    def run(batches):
        words_of = WordHashes()
        for batch in batches:
            ids, values, seconds = [], [], []
            for row, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), raw_bytes(batch.column(1)))):
                words = text.split() if text and doc is not None else []
                if len(words) < window:
                    continue
                hashes = words_of.of(words)
                own = np.unique(stand_ins(hashes, window))
                whole = [window_hashes(hashes, len(words), which) for which in (0, 1)]
                values += [own, whole[0]]
                seconds += [np.zeros(len(own), np.uint64), whole[1] | np.uint64(1)]
                ids.append(np.full(len(own) + 1, row))
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(np.concatenate(values))), pa.array(signed(np.concatenate(seconds))),
                     batch.column(0).take(pa.array(np.concatenate(ids)))], names=["h", "g", "doc_id"])
    return run


def _second_level(window: int):
    def run(batches):
        words_of = WordHashes()
        for batch in batches:
            docs, firsts, seconds = [], [], []
            found = batch.column(2).to_pylist()
            for row, text in enumerate(raw_bytes(batch.column(1))):
                hashes = words_of.of(text.split())
                repeats = np.array(found[row], np.int64).view(np.uint64)
                at = np.flatnonzero(np.isin(stand_ins(hashes, window), repeats))
                first, keep = np.unique(window_hashes(hashes, window)[at], return_index=True)
                docs.append(np.full(len(first), row))
                firsts.append(first)
                seconds.append(window_hashes(hashes, window, 1)[at][keep])
            if docs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(np.concatenate(firsts))), pa.array(signed(np.concatenate(seconds))),
                     batch.column(0).take(pa.array(np.concatenate(docs)))], names=["h", "g", "doc_id"])
    return run


def _cut(window: int):
    def run(batches):
        words_of = WordHashes()
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            repeats, copies = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for row, text in enumerate(raw_bytes(batch.column(1))):
                words = text.split() if text else []
                n_words.append(len(words))
                if copies[row]:
                    words = []
                elif repeats[row]:
                    starts = np.isin(window_hashes(words_of.of(words), window), np.array(repeats[row], np.int64).view(np.uint64))
                    steps = np.zeros(len(words) + 1, np.int64)
                    steps[:len(starts)] += starts
                    steps[window:window + len(starts)] -= starts
                    hit = np.cumsum(steps)[:-1] > 0
                    words = [w for w, gone in zip(words, hit.tolist()) if not gone]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])
    return run


def _in_several(rows: DataFrame) -> DataFrame:
    """Hashes of more than one document, with the smallest of these."""
    return stored(rows.groupBy("h", "g").agg(F.min("doc_id").alias("lowest"), F.max("doc_id").alias("highest")).where(
        "lowest < highest").select("h", "g", "lowest"), "repeated")


def repeats(docs: DataFrame, window: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, copied, windows) of documents with something to remove.

    ``windows`` holds the hashes of those windows of the document that also start in a document with
    a smaller id; ``copied`` says that all of its words are those of such a document.
    """
    docs = picked(docs, doc_id=doc_id, text=text)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"h long, g long, doc_id {kind}"
    first = stored(arrow_map(docs, _first_level(window), schema), "halves")
    found = first.join(_in_several(first), ["h", "g"])
    per_doc = found.groupBy("doc_id").agg(
        F.collect_set(F.when(F.col("g") == 0, F.col("h"))).alias("halves"),
        F.coalesce(F.max(F.when(F.col("g") != 0, F.col("lowest") < F.col("doc_id"))), F.lit(False)).alias("copied"))
    per_doc = stored(per_doc, "survivors")
    survivors = per_doc.where(~F.col("copied") & (F.size("halves") > 0))
    copies = per_doc.where("copied").select("doc_id", "copied", F.array().cast("array<bigint>").alias("windows"))
    if survivors.limit(1).count() == 0:
        return copies
    second = stored(arrow_map(
        docs.where(F.col("text").isNotNull()).join(survivors.select("doc_id", "halves"), "doc_id")
        .select("doc_id", "text", "halves"), _second_level(window), schema), "windows")
    repeated = second.join(_in_several(second), ["h", "g"]).where("lowest < doc_id")
    return repeated.groupBy("doc_id").agg(F.collect_set("h").alias("windows")).select(
        "doc_id", F.lit(False).alias("copied"), "windows").unionByName(copies)


def without_repeats(docs: DataFrame, window: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per input row: doc_id, n_words, n_removed, kept (the words that stay, joined by one space).

    Words are runs without ASCII white space. Every word goes that is covered by ``window``
    consecutive words which also start in a document with a smaller id; windows are judged on the
    input. NULL and empty texts have no words. Rows with a NULL id neither lose words nor make
    others lose any. Rows with equal ids are one document and do not repeat each other, but each is
    returned, with what is removed for that id. Documents shorter than a window stay whole.
    """
    own = picked(docs, doc_id=doc_id, text=text)
    kind = own.schema["doc_id"].dataType.simpleString()
    marked = own.join(repeats(docs, window, doc_id, text), "doc_id", "left").select("doc_id", "text", "windows", "copied")
    return arrow_map(marked, _cut(window), f"doc_id {kind}, n_words long, n_removed long, kept string")

"""Near-duplicate documents by SetSketch registers.

A register keeps the smallest of one exponential variable per shingle, cut to an integer on a
logarithmic scale: registers of a union are the larger of both (so sketches can be merged), and two
sets agree in a register about as often as their Jaccard similarity. Bands of registers give buckets.

All pairs of a bucket are never formed. Each bucket names its smallest document, and every other one is
compared with that: first by the joint likelihood of both sketches, then on the full sets. What is
linked to the smallest document forms one component already; only documents outside it (strangers) are
compared with the other documents of the bucket, in blocks of bounded size, on the full sets.

Sums per key are stored before they are joined back, so that both sides of the join are shuffle reads
and a hot key is divided among tasks.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .graph import components
from .shared import WordHashes, arrow_map, except_for, mixed, picked, raw_bytes, signed, stored, window_hashes

# Sketch: bands times rows registers. Two sets of similarity 0.8 share no band once in a billion.
BANDS, ROWS = 40, 4
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, 65534
# A broadcast side has at most so many rows; beyond it the join shuffles.
MOST_BROADCAST_ROWS = 500_000
# Strangers in a block, other documents that one block meets in one task, and set members compared at once.
STRANGERS, PARTNERS, MEMBERS = 256, 2048, 100_000

_FACTORS = mixed(np.arange(1, REGISTERS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_set(words_of: WordHashes, text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words, A-Z in lower case; fewer words are one run."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(words_of.of(words), min(size, len(words))))


def sketch(members: np.ndarray) -> np.ndarray:
    """Registers of a set of hashes."""
    least = np.full(REGISTERS, np.uint64(2**64 - 1))
    for start in range(0, len(members), 256):
        np.minimum(least, (_FACTORS[:, None] * members[None, start:start + 256]).min(axis=1), out=least)
    smallest = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(smallest, 1e-300)) / math.log(BASE)), 0, TOP + 1).astype("<u2")


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sketched sets."""
    return np.maximum(a, b)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One key per band of a matrix of sketches."""
    grouped = registers.reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), grouped.shape[:2]).copy()
    for i in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, i])
    return key


def joint_estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of each pair of sketches, given the sizes of the sets.

    The likelihood of how many registers are larger, smaller and equal is unimodal in the similarity;
    its top is found by halving.
    """
    larger, smaller = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - larger - smaller
    u = size_a / (size_a + size_b)
    v = 1 - u

    def log_likelihood(j):
        with np.errstate(divide="ignore", invalid="ignore"):
            p, q = (-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE) for x in (u - v * j, v - u * j))
            parts = [(larger, p), (smaller, q), (equal, 1 - p - q)]
            return sum(np.where(n > 0, n * np.log(np.maximum(x, 1e-12)), 0) for n, x in parts)

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        left, right = low + (high - low) / 3, high - (high - low) / 3
        better = log_likelihood(left) < log_likelihood(right)
        low, high = np.where(better, left, low), np.where(better, high, right)
    return (low + high) / 2


def _sketched(size: int):
    def run(batches):
        words_of = WordHashes()
        for batch in batches:
            counts, firsts, seconds, sketches = [], [], [], []
            for text in raw_bytes(batch.column(1)):
                members = shingle_set(words_of, text, size)
                counts.append(len(members))
                firsts.append(members.sum() if len(members) else None)
                seconds.append(mixed(members).sum() if len(members) else None)
                sketches.append(sketch(members).tobytes() if len(members) else None)
            whole = [pa.array([None if x is None else int(x.view(np.int64)) for x in f], pa.int64()) for f in (firsts, seconds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), *whole, pa.array(sketches, pa.binary())],
                names=["doc_id", "n", "f", "g", "registers"])
    return run


def _banded(batches):
    for batch in batches:
        if batch.num_rows:
            registers = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(-1, REGISTERS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(band_keys(registers).ravel())),
                 batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), BANDS)))], names=["key", "doc_id"])


def _likely(least: float):
    """Pairs whose joint estimate reaches ``least``."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, REGISTERS) for i in (4, 5))
                likely = joint_estimate(a, b, *(batch.column(i).to_numpy().astype(float) for i in (2, 3))) >= least
                yield batch.select([0, 1]).filter(pa.array(likely))
    return run


def _sets(size: int):
    def run(batches):
        words_of = WordHashes()
        for batch in batches:
            sets = [shingle_set(words_of, t, size).tobytes() for t in raw_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["doc_id", "members"])
    return run


def _linked(shared, a, b, percent: int):
    return 100 * shared >= percent * (a + b - shared)


def _confirmed(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(a) > len(b):
                    a, b = b, a
                at = np.searchsorted(b, a)
                shared = int((b[np.minimum(at, len(b) - 1)] == a).sum())
                keep.append(_linked(shared, len(a), len(b), percent))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
    return run


def block_links(strangers: list[np.ndarray], partners: list[np.ndarray], percent: int):
    """(stranger, partner) positions of all linked pairs, on the full sets."""
    terms = np.unique(np.concatenate(strangers))
    table = np.zeros((len(strangers), len(terms) + 1), np.uint8)
    for row, members in enumerate(strangers):
        table[row, np.searchsorted(terms, members)] = 1
    sizes = np.array([len(s) for s in strangers])
    start = 0
    while start < len(partners):
        end, total = start, 0
        while end < len(partners) and (end == start or total + len(partners[end]) <= MEMBERS):
            total += len(partners[end])
            end += 1
        own = partners[start:end]
        flat = np.concatenate(own)
        at = np.minimum(np.searchsorted(terms, flat), len(terms) - 1)
        at = np.where(terms[at] == flat, at, len(terms))
        lengths = np.array([len(p) for p in own])
        edges = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        for row in range(len(strangers)):
            shared = np.add.reduceat(table[row, at], edges, dtype=np.int64)
            for column in np.flatnonzero(_linked(shared, sizes[row], lengths, percent)):
                yield row, start + int(column)
        start = end


def _met(percent: int):
    """Links between strangers and other documents of a group, at most one per pair of components.

    Rows come sorted by task, strangers (side 0) first; batches of partners stream past them.
    """
    def run(batches):
        task, mine, told = None, [], set()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            sides = batch.column(1).to_pylist()
            owners = batch.column(2).to_pylist()
            sets = batch.column(3).to_pylist()
            out, waiting = [], []

            def meet():
                if mine and waiting:
                    pairs = block_links([m for _, m in mine], [m for _, m in waiting], percent)
                    for s, p in pairs:
                        pair = (mine[s][0], waiting[p][0])
                        if pair[0] != pair[1] and pair not in told:
                            told.add(pair)
                            out.append(pair)
                waiting.clear()

            for key, side, owner, members in zip(keys, sides, owners, sets):
                if key != task:
                    meet()
                    task, mine, told = key, [], set()
                entry = (owner, np.frombuffer(members, np.uint64))
                (mine if side == 0 else waiting).append(entry)
            meet()
            kind = batch.schema.field(2).type
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], kind) for i in (0, 1)], names=["u", "v"])
    return run


def _groups_to_meet(stars: DataFrame, found: DataFrame) -> DataFrame:
    """(low, doc_id, owner, home, n, strange): members of groups that still hold untested pairs.

    ``owner`` is a member's component so far and ``home`` that of the group's smallest document; the
    group has ``n`` members besides that document, ``strange`` of them in other components.
    """
    def owner(column, name):
        own = found.select(F.col("node").alias(column), F.col("component").alias(name))
        return lambda df: df.join(own, column, "left").withColumn(name, F.coalesce(name, column))

    members = stored(owner("doc_id", "owner")(owner("low", "home")(stars)), "owners")
    open_groups = members.groupBy("low").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("owner") != F.col("home")).alias("strange")).where(
        "strange > 0 and n > 1")
    return members.join(stored(open_groups, "open-groups"), "low")


def links(docs: DataFrame, sketches: DataFrame, size: int, percent: int) -> DataFrame:
    """(u, v): links that tie together all similar documents of different sets."""
    kind = sketches.schema["doc_id"].dataType.simpleString()
    keys = stored(arrow_map(sketches.select("doc_id", "registers"), _banded, f"key long, doc_id {kind}"), "bands")
    buckets = stored(keys.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
                     .where("low < high").select("key", "low"), "buckets")
    stars = stored(keys.join(buckets, "key").where("low < doc_id").select("low", "doc_id").distinct(), "stars")
    own = sketches.select("doc_id", "n", "registers")
    other = own.select(F.col("doc_id").alias("low"), F.col("n").alias("low_n"), F.col("registers").alias("low_registers"))
    paired = stars.join(own, "doc_id").join(other, "low").select(
        "low", "doc_id", "low_n", "n", "low_registers", "registers")
    margin = 6 * math.sqrt(percent / 100 * (1 - percent / 100) / REGISTERS)
    likely = arrow_map(paired, _likely(percent / 100 - margin), f"low {kind}, doc_id {kind}")
    wanted = stored(stars.select("doc_id").union(stars.select("low")).distinct(), "wanted")
    if wanted.limit(MOST_BROADCAST_ROWS + 1).count() <= MOST_BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    sets = stored(arrow_map(docs.join(wanted, "doc_id"), _sets(size), f"doc_id {kind}, members binary"), "sets")
    lows = sets.select(F.col("doc_id").alias("low"), F.col("members").alias("low_members"))
    confirmed = arrow_map(
        likely.join(sets, "doc_id").join(lows, "low").select("low", "doc_id", "low_members", "members"),
        _confirmed(percent), f"u {kind}, v {kind}")
    first = stored(confirmed, "confirmed")
    members = stored(_groups_to_meet(stars, components(first)), "groups")
    # A stranger goes to one block; a partner to one share of its group. Each block meets each share.
    blocks = F.ceil(F.col("strange") / STRANGERS).cast("int")
    shares = F.ceil(F.col("n") / PARTNERS).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
    spread = F.xxhash64("doc_id")
    strangers = members.where("owner <> home").select(
        "low", "doc_id", "owner", F.pmod(spread, blocks).cast("int").alias("block"), every(shares).alias("share"), F.lit(0).alias("side"))
    used = strangers.select("low", "block").distinct()
    partners = members.select(
        "low", "doc_id", "owner", F.pmod(F.xxhash64("doc_id", F.lit(1)), shares).cast("int").alias("share")).join(used, "low").select(
        "low", "doc_id", "owner", "block", "share", F.lit(1).alias("side"))
    tasks = strangers.unionByName(partners).join(sets, "doc_id").select(
        F.xxhash64("low", "block", "share").alias("task"), "side", "owner", "members")
    rest = arrow_map(tasks.repartition("task").sortWithinPartitions("task", "side"), _met(percent), f"u {kind}, v {kind}")
    return first.unionByName(stored(rest, "confirmed"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """Per input row: doc_id, n_shingles, component_id.

    A document's set holds its distinct runs of ``shingle`` words (ASCII white space between words,
    A-Z lower-cased); fewer words are one run. Two documents are linked when their sets share at least
    ``percent`` of their union, which is confirmed on the full sets (64-bit hashes of the runs).
    ``component_id`` is the smallest id that links lead to, the own one included.

    NULL, empty and blank texts have no set and are linked with nothing. Rows with a NULL id are
    returned with a NULL component and link nothing. Rows with equal ids are one document, linked by
    any of their texts; each row is returned. Equal sets are linked without being compared.
    """
    own = picked(docs, doc_id=doc_id, text=text)
    kind = own.schema["doc_id"].dataType.simpleString()
    sketches = stored(arrow_map(
        own, _sketched(shingle), f"doc_id {kind}, n long, f long, g long, registers binary"), "sketches")
    some = sketches.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    equal = stored(some.groupBy("n", "f", "g").agg(F.min("doc_id").alias("first")), "equal-sets")
    first = equal.select(F.col("first").alias("doc_id")).distinct()
    found = components(links(own, some.join(first, "doc_id", "left_semi"), shingle, percent).unionByName(
        some.join(equal, ["n", "f", "g"]).where("first < doc_id").select(F.col("first").alias("u"), F.col("doc_id").alias("v"))))
    return sketches.select("doc_id", "n").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def first_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """The documents, with all their columns, that have the smallest id of their component.

    Documents without a set, or with a NULL id, stay.
    """
    later = near_duplicates(docs, shingle, percent, doc_id, text).where("doc_id <> component_id")
    return except_for(docs, later, {f"`{doc_id}`": "doc_id"})

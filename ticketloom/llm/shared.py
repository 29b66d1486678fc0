"""Helpers of the operators: stored tables, word hashes, Arrow columns."""
from __future__ import annotations

import functools
import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

# Words and patterns that several operators share. ASCII white space, as bytes.split() takes it.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """Folder for tables between steps: the cluster's spark.checkpoint.dir.

    Only a session that runs in one process may go without that setting; it gets a scratch folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _scratch()


@functools.lru_cache(maxsize=1)
def _scratch() -> str:
    return tempfile.mkdtemp(prefix="ticketloom-llm-")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return it as read back.

    Cuts the lineage; the table survives lost executors and later readers prune its columns.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Rows that a worker turns into Python objects at a time, and rows of a batch that reaches it.
SLICE, BATCH = 500, 2000
_shipped: set[str] = set()


def sliced(run):
    """``run`` over slices of the batches; what the worker no longer needs is given back at the end."""
    def over(batches):
        parts = (batch.slice(start, SLICE) for batch in batches for start in range(0, batch.num_rows, SLICE))
        yield from run(parts)
        gc.collect()
        pa.default_memory_pool().release_unused()
    return over


def arrow_map(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` over slices of the batches.

    The package goes to the executors before the first call, once per application. Long texts make large
    batches, so the session's limit of rows per batch is lowered to ``BATCH`` where it is higher.
    """
    context, conf = df.sparkSession.sparkContext, df.sparkSession.conf
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH:
        conf.set(name, BATCH)
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        archive = os.path.realpath(f"{tempfile.mkdtemp(prefix='ticketloom-code-')}/{package.name}.zip")
        with zipfile.ZipFile(archive, "w") as file:
            for source in package.rglob("*.py"):
                file.write(source, source.relative_to(package.parent))
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
    return df.mapInArrow(sliced(run), schema)


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under the operator's own names; any others may be called anything."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def except_for(docs: DataFrame, dropped: DataFrame, keys: dict[str, str], most: int = 500_000) -> DataFrame:
    """Rows of ``docs`` that match no row of ``dropped``; ``keys``: expression over docs -> column of dropped.

    The rows to drop are broadcast when they are counted at no more than ``most``, and joined by a
    shuffle beyond that. NULL matches NULL.
    """
    own = {c: f"{c}-{uuid.uuid4().hex}" for c in keys.values()}  # no column of docs is called so
    dropped = stored(dropped.select(*[F.col(c).alias(name) for c, name in own.items()]).distinct(), "dropped")
    same = functools.reduce(lambda a, b: a & b, [F.expr(e).eqNullSafe(F.col(f"`{own[c]}`")) for e, c in keys.items()])
    small = dropped.limit(most + 1).count() <= most
    return docs.join(F.broadcast(dropped) if small else dropped, same, "left_anti")


def hash_limit(share: float) -> int:
    """The signed 64-bit number below which a hash lies with the probability ``share`` (from 0 to 1).

    As fine as the hash, so that a sample of some thousand rows is one at any size of table.
    """
    return min(int(share * 2.0 ** 64), 2 ** 64 - 1) - 2 ** 63


def lower_ascii(column):
    """A-Z in lower case and nothing else."""
    return F.translate(column, UPPER, LOWER)


def raw_bytes(column: pa.Array) -> list[bytes | None]:
    """Cells of a string column as UTF-8."""
    return column.cast(pa.binary()).to_pylist()


class WordHashes(dict):
    """64-bit hash of a word, remembered for the words seen first, up to a bound on memory."""

    MOST = 150_000

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.MOST:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_BASE = 0x9E3779B97F4A7C15
# Two primes below 2**31 with a base each: products fit a machine word.
_FIELDS = ((2_147_483_647, 1_103_515_249), (2_147_483_629, 1_812_433_253))


@functools.lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.empty(size, np.uint64), np.empty(size, np.uint64)
    for out, factor in ((up, _BASE), (down, pow(_BASE, -1, 1 << 64))):
        out[:] = np.uint64(factor)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return up, down


@functools.lru_cache(maxsize=2)
def _field_powers(field: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the field's base and of its inverse; ``size`` is a power of two."""
    prime, base = _FIELDS[field]
    both = []
    for factor in (base, pow(base, -1, prime)):
        out, have = np.ones(size, np.uint64), 1
        while have < size:
            out[have:2 * have] = out[:have] * np.uint64(pow(factor, have, prime)) % np.uint64(prime)
            have *= 2
        both.append(out)
    return both[0], both[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sums(words: np.ndarray, length: int, up: np.ndarray, down: np.ndarray, prime: int = 0) -> np.ndarray:
    """Polynomial of each run of ``length`` values, modulo ``prime`` or 2**64."""
    count = len(words) - length + 1
    sums = np.zeros(len(words) + 1, np.uint64)
    if not prime:
        np.cumsum(words * down[:len(words)], out=sums[1:])
        return (sums[length:] - sums[:count]) * up[:count]
    p = np.uint64(prime)
    np.cumsum(words % p * down[:len(words)] % p, out=sums[1:])  # fits for runs of up to 2**33 words
    return (sums[length:] - sums[:count]) % p * up[:count] % p


def window_hashes(words: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hash of each run of ``length`` consecutive words, by rolling polynomials.

    ``which`` is 0 for one polynomial modulo 2**64, 1 for a pair of polynomials modulo two primes of 31
    bits. The moduli share no factor, so that a sequence of words that is bad for one is none for the others.
    """
    if len(words) < length:
        return np.empty(0, np.uint64)
    size = 1 << max(12, int(len(words) + 1).bit_length())
    if which == 0:
        return mixed(_sums(words, length, *_powers(size)))
    one, two = (_sums(words ^ (words >> np.uint64(32)), length, *_field_powers(i, size), _FIELDS[i][0]) for i in (0, 1))
    return mixed(one << np.uint64(32) | two)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)

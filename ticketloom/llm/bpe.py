"""Byte-pair encoding and decoding with shared prefixes.

The encoding of a prefix is settled by its last token alone: among the tokens that end the prefix,
exactly one fits behind the last token of what remains in front of it. So the distinct words of a
block of documents are put in order, which is their trie in depth-first order: the common prefix
with the word before is the path that both share, and its last-token states stay on the stack.
Every shared prefix is thus encoded once per block, and a word's tokens are read back from its end.
"""
from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .shared import arrow_map, picked

# Fixed value: how byte-level vocabularies cut a text into words.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Texts whose letters all lie below this code point are cut by plain classes of characters.
NEAR = 0x250
# Words whose tokens a worker remembers at least; it holds up to twice as many, and those used of late stay.
MOST_WORDS = 100_000
# Bytes at the end of a prefix by which the lengths of tokens that may end it are looked up.
TAIL = 4
# Pairs of neighbouring tokens whose fit a worker remembers.
MOST_PAIRS = 150_000


def _byte_letters() -> dict[str, int]:
    """Letter -> byte of byte-level vocabularies: printable bytes stand for themselves, the others
    follow from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _near_word() -> re.Pattern:
    """WORD for texts below NEAR, where the classes are listed; what starts with a letter is tried first."""
    letter, number, space = ("".join(re.escape(chr(c)) for c in range(NEAR) if regex.match(p, chr(c))) for p in (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(rf" ?[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, document: bytes):
        spec = json.loads(document)
        letters = _byte_letters()
        self.ids = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.tokens = {i: token for token, i in self.ids.items()}
        self.longer: dict[bytes, set[int]] = {}  # last bytes -> lengths of the longer tokens that end so
        for token in self.ids:
            if len(token) > TAIL:
                self.longer.setdefault(token[-TAIL:], set()).add(len(token))
        self.lengths: dict[bytes, tuple[int, ...]] = {}
        self.packed = {i: i.to_bytes(4, "little") for i in self.tokens}
        self.rank, self.parts, self.merges = dict.fromkeys(self.tokens, -1), {}, {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair = tuple(self.ids[bytes(letters[c] for c in x)] for x in (left, right))
            whole = self.ids[self.tokens[pair[0]] + self.tokens[pair[1]]]
            if self.rank[whole] >= 0:
                raise ValueError("a token of two different merges")
            self.rank[whole], self.parts[whole], self.merges[pair] = rank, pair, rank
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens |= {i: content.encode() for content, i in added.items()}
        self.added = {content: i.to_bytes(4, "little") for content, i in added.items()}
        self.table = pa.array([self.tokens.get(i) for i in range(max(self.tokens) + 1)], pa.large_binary())
        longest_first = sorted(added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if added else None
        self.word, self.near_word, self.far = regex.compile(WORD), _near_word(), re.compile(f"[^\\x00-{chr(NEAR - 1)}]")
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.fitting: dict[tuple[int, int], bool] = {}

    def rest(self) -> None:
        """Give back at a task's end what is least likely to be needed again."""
        self.before = {}
        pa.default_memory_pool().release_unused()

    def ending(self, tail: bytes) -> tuple[int, ...]:
        """Lengths of the tokens that may end a prefix with these last bytes, longest first."""
        longer = self.longer.get(tail, ()) if len(tail) == TAIL else ()
        short = [n for n in range(1, len(tail) + 1) if tail[-n:] in self.ids]
        if len(self.lengths) > MOST_PAIRS:
            self.lengths.clear()
        found = self.lengths[tail] = (*sorted(longer, reverse=True), *reversed(short))
        return found

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges leave a border between two neighbouring tokens.

        Undoes the later of both sides' merges step by step; at each step the two pieces at the
        border must not have merged before the step that used up one of them.
        """
        rank, merges, parts = self.rank, self.merges, self.parts
        until_left = until_right = len(merges)
        while True:
            m = merges.get((left, right))
            if m is not None and m < until_left and m <= until_right:
                return False
            if rank[left] > rank[right]:
                until_left, left = rank[left], parts[left][1]
            elif rank[right] >= 0:
                until_right, right = rank[right], parts[right][0]
            else:
                return True

    def learn(self, words: set[str]) -> None:
        """Encode new words in trie order and remember them."""
        find, fitting, lengths = self.ids.get, self.fitting, self.lengths.get
        tokens, packed, known = self.tokens, self.packed, self.known
        if len(fitting) > MOST_PAIRS:
            fitting.clear()
        path, last = b"", [-1]  # last[i]: the token that ends the first i bytes of the path
        for word, text in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            size = len(word)
            depth, shared = 0, min(len(path), size)
            while depth < shared and path[depth] == word[depth]:
                depth += 1
            del last[depth + 1:]
            for end in range(depth + 1, size + 1):
                tail = word[end - TAIL:end] if end > TAIL else word[:end]
                for length in lengths(tail) or self.ending(tail):
                    start = end - length
                    if start < 0:
                        continue
                    token = find(word[start:end])
                    if token is None:
                        continue
                    if not start:
                        break
                    pair = (last[start], token)
                    fit = fitting.get(pair)
                    if fit is None:
                        fit = fitting[pair] = self.fits(*pair)
                    if fit:
                        break
                last.append(token)
            path, end, found = word, size, []
            while end:
                token = last[end]
                found.append(packed[token])
                end -= len(tokens[token])
            found.reverse()
            known[text] = b"".join(found)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        cut = [self.cut.split(t) if self.cut else [t] for t in texts]
        words = [[[p] if p in self.added else (self.word if self.far.search(p) else self.near_word).findall(p) for p in pieces]
                 for pieces in cut]
        wanted = set().union(*(piece for pieces in words for piece in pieces))
        if len(self.known) > MOST_WORDS:
            self.known, self.before = {}, self.known
        known, before, added = self.known, self.before, self.added
        wanted.difference_update(known, added)
        again = wanted.intersection(before)
        known.update((w, before[w]) for w in again)
        self.learn(wanted.difference(again))
        for pieces, source in zip(words, cut):
            yield b"".join([
                added[p] if p in added else b"".join([known[w] for w in piece]) for p, piece in zip(source, pieces)])

    def decode(self, ids: bytes) -> str:
        return self.texts(pa.array([ids], pa.binary()))[0].as_py()

    def texts(self, ids: pa.Array) -> pa.Array:
        """Text of each row of ``ids`` (binary, little-endian unsigned 32-bit).

        The tokens of all rows are taken in one step; where the rows begin, their text begins. What is no UTF-8
        is replaced, row by row.
        """
        size, (_, borders, values) = len(ids), ids.buffers()
        starts = np.frombuffer(borders, np.int32)[ids.offset:ids.offset + size + 1]
        every = np.frombuffer(values or b"", "<u4", starts[-1] // 4)[starts[0] // 4:]
        found = self.table.take(pa.array(every))
        if found.null_count:
            raise ValueError("an id that the vocabulary does not have")
        offsets = np.frombuffer(found.buffers()[1], np.int64)[found.offset:found.offset + len(found) + 1] if len(found) else np.zeros(1, np.int64)
        content = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), size, [None, pa.py_buffer(offsets[(starts - starts[0]) // 4].tobytes()), found.buffers()[2]])
        try:
            return content.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([t.decode("utf-8", "replace") for t in content.to_pylist()], pa.string())


_codecs: dict[str, Codec] = {}


def codec(document: bytes) -> Codec:
    """The codec of a vocabulary file, built once per worker."""
    key = hashlib.sha256(document).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(document)
    return _codecs[key]


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per input row: doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded.

    ``path`` is a byte-level BPE vocabulary file on the driver; its content is broadcast. Added
    tokens of the file are recognised in texts; none are put around them. NULL text counts as empty
    and empty text has no tokens; every row is kept, repeated ones and NULL ids too. Each row is
    encoded where it is read: nothing is shuffled, and a worker holds one input batch and a bounded
    memory of words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_tokens long, ids binary, decoded string"

    def run(batches):
        coder = codec(shared.value)
        for batch in batches:
            ids = pa.array(coder.encode([t or "" for t in batch.column(1).to_pylist()]), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.divide(pc.cast(pc.binary_length(ids), pa.int64()), 4), ids, coder.texts(ids)],
                names=["doc_id", "n_tokens", "ids", "decoded"])
        coder.rest()

    return arrow_map(picked(docs, doc_id=doc_id, text=text), run, schema)


def encoded(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per input row: doc_id, ids (array of int). Cases as in ``round_trip``."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, ids array<int>"

    def run(batches):
        coder = codec(shared.value)
        for batch in batches:
            ids = [np.frombuffer(i, "<i4") for i in coder.encode([t or "" for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])
        coder.rest()

    return arrow_map(picked(docs, doc_id=doc_id, text=text), run, schema)


def decoded(rows: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per input row: doc_id, text of an array of ids. NULL arrays give NULL, unknown ids an error."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary(path))
    schema = f"doc_id {rows.schema[doc_id].dataType.simpleString()}, text string"

    def run(batches):
        coder = codec(shared.value)
        for batch in batches:
            rows = batch.column(1)
            texts = coder.texts(pa.array([np.array(i or [], "<u4").tobytes() for i in rows.to_pylist()], pa.binary()))
            texts = pc.if_else(rows.is_null(), pa.scalar(None, pa.string()), texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["doc_id", "text"])

    return arrow_map(picked(rows, doc_id=doc_id, ids=ids), run, schema)

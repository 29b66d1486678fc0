"""Removal of lines that repeat, exactly or up to a few edits.

Segment-partition edit join: a line is cut into threshold + 1 even segments; at least one of them
survives any ``threshold`` edits, at a place that the difference of lengths bounds. So lines meet on the
hash of (length, segment number, segment): each line is indexed by its segments and probes those of
lines up to ``threshold`` characters shorter with the substrings at the places that can match.

Pairs are formed only in small groups. A larger group is cut on: its lines agree in the segment, so what
is left of them must agree up to the same edits, and is cut into segments again. A group of variants of
one line falls apart into groups by the place of their edits. Where too little is left of the indexed
lines to be cut again, lines meet on the line without some of the characters left, marked as replaced or as
superfluous: lines with the same marks are near for certain, so each meets only the earliest of them and no pairs
are formed. Pairs are verified by a banded, bit-parallel edit distance: one machine word holds the band, one
step per character.

Everything is DataFrame expressions. Lines travel as hashes; texts travel only for lines in a group.
Sums per key are stored before they are joined back, so that both sides of the join are shuffle reads
and a hot key is divided among tasks.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ticketloom.scale import once

from .shared import picked, stored

# Lines that may meet pair by pair; a larger group is cut into segments again.
GROUP = 32
# Up to this threshold rests are marked (5 ways at t = 1, 33 at 2); beyond it their lines meet pair by pair.
MOST_MARKED = 2
# A broadcast side has at most so many rows; beyond it the join shuffles.
MOST_BROADCAST_ROWS = 500_000


def _places(threshold: int) -> list[tuple[int, int, int]]:
    """(how much shorter the indexed line is, segment, shift of the substring): all that can match.

    With an edit budget of ``threshold``, segment i (from 0) can be chosen so that at most i edits lie
    left of it and threshold - i right of it, which bounds how far it moves.
    """
    return [(shorter, i, shift) for shorter in range(threshold + 1) for i in range(threshold + 1)
            for shift in range(max(-i, shorter - (threshold - i)), min(i, shorter + (threshold - i)) + 1)]


def segment_keys(line: Column, size: Column, threshold: int) -> Column:
    """Array of (key, at, width, indexed) of a line with ``size`` characters.

    Keys marked as indexed are the line's own segments; they serve as probes too.
    """
    parts, keys = threshold + 1, []
    for shorter, i, shift in _places(threshold):
        length = size - shorter
        base, longer_from = F.floor(length / parts).cast("int"), parts - length % parts
        width = base + (F.lit(i) >= longer_from).cast("int")
        at = base * i + F.greatest(F.lit(i) - longer_from, F.lit(0)) + shift
        key = F.xxhash64(length, F.lit(i), F.substring(line, at + 1, width))
        keys.append(F.when((length >= parts) & (at >= 0) & (at + width <= size), F.struct(
            key.alias("key"), at.cast("int").alias("at"), width.cast("int").alias("width"),
            F.lit(shorter == 0 and shift == 0).alias("indexed"))))
    return F.array_compact(F.array(*keys))


def within(longer: Column, shorter: Column, threshold: int) -> Column:
    """Whether two lines, given as arrays of characters, are at most ``threshold`` edits apart.

    ``longer`` has more than ``threshold`` characters and at most ``threshold`` more than the other.
    Bit k of each word is the row that lies k below the band's upper edge; sums run along the band's
    lower edge and then along the last row. A pair beyond reach stops counting.
    """
    width = 2 * threshold + 2
    full, top = (1 << width) - 1, 1 << (width - 1)
    m = F.size(longer)

    def inverse(x):
        return x.bitwiseXOR(F.lit(full).cast("long"))

    def word(value):
        return F.lit(value).cast("long")

    def step(s, c):
        def state(x):
            d0 = ((x.bitwiseAND(s["vp"]) + s["vp"]).bitwiseAND(word(full)).bitwiseXOR(s["vp"])).bitwiseOR(x).bitwiseOR(s["vn"])
            return F.struct(s["i"].alias("i"), s["vp"].alias("vp"), s["vn"].alias("vn"), s["distance"].alias("distance"), d0.alias("d0"))

        def advance(t):
            hp = t["vn"].bitwiseOR(inverse(t["d0"].bitwiseOR(t["vp"])))
            hn = t["d0"].bitwiseAND(t["vp"])
            half = F.shiftrightunsigned(t["d0"], 1)
            down = F.when(t["d0"].bitwiseAND(word(top)) == 0, 1).otherwise(0)
            row = word(top >> 1)
            across = F.lit(0)
            for k in range(threshold + 1):
                bit = word(top >> 1 >> k)
                across = F.when(t["i"] - (m - threshold) == k, F.when(hp.bitwiseAND(bit) != 0, 1).otherwise(0)
                                - F.when(hn.bitwiseAND(bit) != 0, 1).otherwise(0)).otherwise(across)
            return F.struct(
                (t["i"] + 1).alias("i"), hn.bitwiseOR(inverse(half.bitwiseOR(hp))).alias("vp"), half.bitwiseAND(hp).alias("vn"),
                (t["distance"] + F.when(t["i"] < m - threshold, down).otherwise(across)).alias("distance"))

        x = word(0)
        for k in range(width):
            x = x + F.when(F.get(longer, s["i"] + (threshold + 1 - width + k)) == c, word(1 << k)).otherwise(word(0))
        # Arrays of one element name a value that is used several times.
        moved = F.transform(F.transform(F.array(x), state), advance)[0]
        return F.when(s["distance"] > 3 * threshold, s).otherwise(moved)

    start = F.struct(F.lit(0).alias("i"), word(full & ~((1 << (width - threshold - 1)) - 1)).alias("vp"),
                     word(0).alias("vn"), F.lit(threshold).alias("distance"))
    return F.aggregate(shorter, start, step)["distance"] <= threshold


def _line_rows(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, pos, line, size, h, c): lines that take part; h and c together name a line."""
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return rows.withColumn("size", F.char_length("line")).where(F.col("size") >= least).withColumns(
        {"h": F.xxhash64("line"), "c": F.crc32("line")})


def _grouped(rows: DataFrame) -> DataFrame:
    """Rows of groups that hold a pair, with the number of lines and the shortest rest of the group."""
    groups = rows.groupBy("key").agg(
        F.min("h").alias("low"), F.max("h").alias("high"), F.max("indexed").alias("some"), F.count(F.lit(1)).alias("group_size"),
        F.min(F.char_length("rest")).alias("least_rest"))
    return rows.join(stored(groups.where("some and low <> high").select("key", "group_size", "least_rest"), "group-sizes"), "key")


def markings(length: Column, threshold: int) -> Column:
    """Ways to mark up to ``threshold`` of ``length`` places: arrays of (at, replaced) in order of ``at``."""
    none = F.array(F.array().cast("array<struct<at:int,replaced:boolean>>"))

    def appended(mark):
        return lambda way: F.array_append(way, mark)

    def with_place(ways, at):
        more = F.filter(ways, lambda w: F.size(w) < threshold)
        marks = [F.struct(at.alias("at"), F.lit(replaced).alias("replaced")) for replaced in (True, False)]
        return F.concat(ways, *[F.transform(more, appended(m)) for m in marks])

    places = F.when(length > 0, F.sequence(F.lit(0), length - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, none, with_place)


def marked(line: Column, marks: Column) -> Column:
    """Hash of the line without the marked places and of the gaps that replaced ones leave in it."""
    without = F.aggregate(F.reverse(marks), line, lambda s, m: F.concat(
        F.substring(s, F.lit(1), m["at"]), F.substring(s, m["at"] + 2, F.char_length(s))))
    gaps = F.transform(marks, lambda m, i: F.when(m["replaced"], m["at"] - i))
    return F.xxhash64(without, F.array_compact(gaps))


def _met_marked(rows: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """Ordered pairs of large groups whose rests are short: each line with the earliest of its likes.

    Two lines that are the same without some characters, r of which leave the same gaps in both, are at most
    r edits and one for each other character apart. Where an edit script leaves the parts that were cut out
    alone, all its edits lie in the rests, so some marks of the two rests say the same as the script. The
    indexed rests of a group are its shortest, hence no rest is longer than twice the threshold.
    """
    whole = rows.join(texts.select("h", "c", "line"), ["h", "c"])
    # Places in the rest become places in the line by putting back what was cut out, last part first.
    def place(m):
        return F.struct(F.aggregate(F.reverse("cuts"), m["at"], lambda p, cut: p + F.when(
            p >= cut["at"], cut["width"]).otherwise(0)).alias("at"), m["replaced"].alias("replaced"))

    ways = whole.select("key", "h", "c", "first", "size", "line", "cuts", F.explode(
        markings(F.char_length("rest"), threshold)).alias("way"))
    ways = once(ways, "marks", F.transform("way", place)).select(
        "key", marked(F.col("line"), F.col("marks")).alias("like"), "h", "c", "first", "size",
        F.size(F.filter("marks", lambda m: m["replaced"])).alias("replaced"), F.size("marks").alias("n"))
    ways = stored(ways.distinct(), "marked").withColumn("more", F.col("n") - F.col("replaced"))
    earliest = stored(ways.groupBy("key", "like").agg(
        F.min("h").alias("low"), F.max("h").alias("high"),
        *[F.min(F.when(F.col("more") == e, F.struct("first", "h", "c", "size"))).alias(f"with_{e}") for e in range(threshold + 1)]
    ).where("low <> high"), "earliest")
    others = F.filter(F.array(*[F.when(F.col("n") + e <= threshold, F.col(f"with_{e}")) for e in range(threshold + 1)]),
                      lambda o: o.isNotNull())
    met = ways.join(earliest, ["key", "like"]).withColumn("other", F.array_min(others)).where("other.first < first")
    return met.select(F.col("other.h").alias("a_h"), F.col("other.c").alias("a_c"), F.col("h").alias("b_h"), F.col("c").alias("b_c"),
                      F.col("other.size").alias("a_size"), F.col("size").alias("b_size"))


def _pairs(rows: DataFrame) -> DataFrame:
    """Ordered pairs of small groups: the earlier line and the later one."""
    a = rows.select("key", *[F.col(c).alias(f"a_{c}") for c in ("h", "c", "first", "indexed", "size")])
    b = rows.select("key", *[F.col(c).alias(f"b_{c}") for c in ("h", "c", "first", "indexed", "size")])
    return a.join(b, "key").where("a_first < b_first and (a_indexed or b_indexed)").select(
        "a_h", "a_c", "b_h", "b_c", "a_size", "b_size")


def similar_earlier(lines: DataFrame, docs: DataFrame, threshold: int, least: int, max_broadcast_rows: int) -> DataFrame:
    """(h, c, earlier): first place of the earliest other line within ``threshold`` edits, if it is earlier."""
    keys = lines.select("h", "c", F.inline("keys"))
    groups = keys.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.max("indexed").alias("some"))
    shared = stored(groups.where("some and low <> high").select("key"), "shared-keys")
    met = stored(keys.join(shared, "key").distinct(), "met")
    wanted = met.select("h", "c").distinct()
    if wanted.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows:
        wanted = F.broadcast(wanted)
    texts = stored(
        _line_rows(docs, least).join(wanted, ["h", "c"], "left_semi").groupBy("h", "c", "size", "line")
        .agg(F.min(F.struct("doc_id", "pos")).alias("first")), "lines")
    rest = F.concat(F.expr("substring(line, 1, at)"), F.expr("substring(line, at + width + 1)"))
    rows = stored(_grouped(met.join(texts, ["h", "c"]).select(
        "key", "h", "c", "first", "size", "indexed", rest.alias("rest"), F.array(F.struct("at", "width")).alias("cuts"))), "groups")
    pairs = None
    while True:
        small, short = F.col("group_size") <= GROUP, F.col("least_rest") <= threshold
        brief = rows.where(~small & short)
        found = _pairs(rows.where(small)).unionByName(
            _met_marked(brief, texts, threshold) if 1 <= threshold <= MOST_MARKED else _pairs(brief))
        pairs = found if pairs is None else pairs.unionByName(found)
        large = rows.where(~small & ~short)
        if large.limit(1).count() == 0:
            break
        cut = once(large, "parts", segment_keys(F.col("rest"), F.char_length("rest"), threshold)).select(
            F.col("key").alias("outer"), "h", "c", "first", "size", "rest", "cuts", F.col("indexed").alias("was_indexed"), F.inline("parts"))
        cut = cut.select(F.xxhash64("outer", "key").alias("key"), "h", "c", "first", "size",
                         (F.col("indexed") & F.col("was_indexed")).alias("indexed"),
                         F.concat(F.expr("substring(rest, 1, at)"), F.expr("substring(rest, at + width + 1)")).alias("rest"),
                         F.array_append("cuts", F.struct("at", "width")).alias("cuts"))
        rows = stored(_grouped(stored(cut.distinct(), "cut")), "groups")
    pairs = pairs.where(F.abs(F.col("a_size") - F.col("b_size")) <= threshold).distinct()
    one = texts.select(F.col("h").alias("a_h"), F.col("c").alias("a_c"), F.col("line").alias("a_line"), F.col("first").alias("a_first"))
    two = texts.select(F.col("h").alias("b_h"), F.col("c").alias("b_c"), F.col("line").alias("b_line"))
    both = pairs.join(one, ["a_h", "a_c"]).join(two, ["b_h", "b_c"])
    swap = F.col("a_size") >= F.col("b_size")
    both = once(both, "cells", F.struct(
        F.split(F.when(swap, F.col("a_line")).otherwise(F.col("b_line")), "").alias("longer"),
        F.split(F.when(swap, F.col("b_line")).otherwise(F.col("a_line")), "").alias("shorter")))
    return both.where(within(F.col("cells.longer"), F.col("cells.shorter"), threshold)).groupBy(
        F.col("b_h").alias("h"), F.col("b_c").alias("c")).agg(F.min("a_first").alias("earlier"))


def dropped_lines(docs: DataFrame, threshold: int, least: int, max_broadcast_rows: int) -> DataFrame:
    """(doc_id, gone, earlier): marks of the lines that each document loses, a hash of place and line, and
    the documents that have the earliest line like one of them."""
    lines = stored(_line_rows(docs, least).select(
        "doc_id", "pos", "h", "c", segment_keys(F.col("line"), F.col("size"), threshold).alias("keys")), "line-keys")
    earlier = similar_earlier(lines, docs, threshold, least, max_broadcast_rows)
    first = lines.groupBy("h", "c").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count(F.lit(1)).alias("n"))
    limits = stored(first.join(earlier, ["h", "c"], "left").where("n > 1 or earlier is not null").select(
        "h", "c", F.least("first", F.coalesce("earlier", "first")).alias("limit")), "limits")
    return lines.select("doc_id", "pos", "h", "c").join(limits, ["h", "c"]).where(
        F.struct("doc_id", "pos") > F.col("limit")).groupBy("doc_id").agg(
        F.collect_set(F.xxhash64("pos", "h")).alias("gone"), F.sort_array(F.collect_set("limit.doc_id")).alias("earlier"))


def without_repeats(docs: DataFrame, threshold: int = 1, least: int = 20, doc_id: str = "doc_id", text: str = "text",
                    max_broadcast_rows: int = MOST_BROADCAST_ROWS) -> DataFrame:
    """All columns of ``docs`` with the text cut, and n_lines, n_removed and earlier behind them (in place
    of columns that had these names). ``earlier`` lists the ids of the documents, the own one perhaps
    among them, that have the first line like one that was cut.

    A line goes when an earlier line (smaller id, or higher up in the same document) equals it or is at
    most ``threshold`` edits away; lines are judged on the input. Lines are what line feeds separate; those
    with fewer than ``least`` characters (more than ``threshold``) take no part and stay.

    NULL text stays NULL with no lines; an empty text is one empty line, which stays. Rows with a NULL id
    neither lose lines nor make others lose any. Rows with equal ids count as one document: a line at the
    same place in both is one line.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed", "earlier")]
    rows = _cut_rows(docs, kept, threshold, least, doc_id, text, max_broadcast_rows)
    return rows.select(
        *[F.array_join("kept", "\n").alias(c) if c == text else F.col("row")[c].alias(c) for c in kept],
        _size("lines").alias("n_lines"), (_size("lines") - _size("kept")).alias("n_removed"), "earlier")


def _size(lines: str) -> Column:
    return F.coalesce(F.when(F.col(lines).isNotNull(), F.size(lines)), F.lit(0)).cast("long")


def _cut_rows(docs: DataFrame, columns: list[str], threshold: int, least: int, doc_id: str, text: str, max_broadcast_rows: int) -> DataFrame:
    """(row, lines, kept, earlier) of each document; ``row`` holds its columns, which may have any name."""
    if not threshold < least or not 0 <= threshold <= 29:
        raise ValueError("least must exceed the threshold, and the band must fit a machine word")
    gone = dropped_lines(picked(docs, doc_id=doc_id, text=text), threshold, least, max_broadcast_rows)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    rows = rows.join(gone, F.col("row")[doc_id] == F.col("doc_id"), "left").select("row", "gone", "earlier")
    rows = once(rows, "lines", F.split(F.col("row")[text], "\n", -1))
    left = F.filter("lines", lambda line, i: ~F.array_contains("gone", F.xxhash64(i, F.xxhash64(line))))
    rows = once(rows, "kept", F.when(F.col("gone").isNull(), F.col("lines")).otherwise(left))
    return rows.select("row", "lines", "kept", F.coalesce("earlier", F.array().cast(gone.schema["earlier"].dataType)).alias("earlier"))


def own_documents(docs: DataFrame, threshold: int = 1, least: int = 20, doc_id: str = "doc_id", text: str = "text",
                  max_broadcast_rows: int = MOST_BROADCAST_ROWS) -> DataFrame:
    """``docs`` with repeated lines cut as by ``without_repeats``, and without the documents that have nothing of their own.

    A document that lost a line goes when all that is left of it are blank lines and lines under ``least``
    characters that a document with a smaller id has too, character by character. All columns stay as they
    are but for the text, whatever they are called.
    """
    cut = stored(_cut_rows(docs, docs.columns, threshold, least, doc_id, text, max_broadcast_rows).select(
        "row", F.array_join("kept", "\n").alias("left"), (_size("lines") > _size("kept")).alias("lost")), "cut")
    filled = lambda c: F.filter(F.split(c, "\n", -1), lambda line: line.rlike(r"\S"))
    whole = ~F.col("lost") | F.exists(filled("left"), lambda line: F.char_length(line) >= least)
    doubtful = stored(cut.where(~whole).select(F.col("row")[doc_id].alias("id"), F.explode(filled("left")).alias("line")).distinct(), "doubtful")
    short = picked(docs, id=doc_id, text=text).where("id is not null").select("id", F.explode(filled("text")).alias("line")).where(
        F.char_length("line") < least)
    first = stored(short.groupBy("line").agg(F.min("id").alias("first")).join(doubtful.select("line").distinct(), "line"), "first-short")
    own = stored(doubtful.join(first, "line").where("id = first").select("id").distinct(), "own")
    if own.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows:
        own = F.broadcast(own)
    rows = cut.join(own, F.col("row")[doc_id] == F.col("id"), "left").where(whole | F.col("id").isNotNull())
    return rows.select(*[F.col("left").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])

"""Mixing sources to target weights.

Each source gets a share of a budget of words by its weight, but no more than a multiple of its own
size. Its documents get hash-random keys and are sorted by them over range partitions; sums of sizes per
partition, added up, give every document the words in front of it. A source is taken whole as often as its
target holds it, and once more up to the word where the rest of the budget ends.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ticketloom.scale import lookup, numbered, running_totals, settle

# Fixed value: what a word is.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def random_key(doc_id: Column, text: Column, seed: int) -> Column:
    """Hex digest that orders documents at random, alike in every run."""
    none = F.lit("")
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), none), F.coalesce(text, none)))


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(known, name, source_size, target) of ``sources`` (known, name, source_size).

    Weights repeat along the sources by code point, unnamed (``known`` false) last. All of them share ``share`` times the
    sum of sizes; a target above ``most`` times its source's size stops there and the rest is shared
    again. The loop sees sums only, and each round stops at least one more source.
    """
    ranked = numbered(sources, [F.col("known").desc(), F.col("name").asc()], "rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = settle(ranked.select("known", "name", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap")))
    budget = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    rest, weigh, held = budget, None, -1
    while True:
        over = F.lit(False) if weigh is None else F.col("weight") * F.lit(rest) / F.lit(weigh) > F.col("cap")
        n, capped, open_weight = ranked.agg(
            F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        if n == held or not open_weight:
            break
        held, rest, weigh = n, budget - capped, open_weight
    # Without a source left open, every one stops at its cap.
    target = F.col("cap") if weigh is None or not open_weight else F.least(
        F.col("cap"), F.col("weight") * F.lit(rest) / F.lit(weigh))
    return ranked.select("known", "name", "source_size", target.cast("double").alias("target"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 0,
          doc_id: str = "doc_id", text: str = "text", source: str = "source", carry: bool = False) -> DataFrame:
    """Per document: doc_id, source, size (words), source_size, target, taken (words, repeats counted).

    The words taken from a source add up to its target, rounded; a document is taken whole, or whole once
    more, or, where a source's budget ends inside it, up to that word (``taken`` is no multiple of ``size`` then).
    With ``carry`` the whole input row comes along as the struct ``row``, for ``copies``.

    NULL and empty texts have size 0 and are taken 0 times; a NULL source is a source of its own, named
    last. Rows with equal ids and texts are copies: each is a document, and which of them the cut falls on
    is open, so the set of result rows is the same in every run. An empty table gives no rows. Input
    columns of any name may be there; only the three named ones are read.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    d, t, s = (F.col(f"`{c}`") for c in (doc_id, text, source))
    sized = settle(docs.select(
        d.alias("doc_id"), s.alias("source"), s.isNotNull().alias("known"), F.coalesce(s.cast("string"), F.lit("")).alias("name"),
        F.coalesce(F.regexp_count(t, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), random_key(d, t, seed).alias("key"),
        F.monotonically_increasing_id().alias("arrival"), *([row.alias("row")] if carry else [])))
    sources = settle(sized.groupBy("known", "name").agg(F.sum("size").alias("source_size")))
    plan = settle(targets(sources, weights, share, most))
    placed = running_totals(sized, ["known", "name"], [F.col("key").asc(), F.col("doc_id").asc(), F.col("arrival").asc()], "size", "ahead")
    told = lookup(placed, plan, ["known", "name"], ["key", "arrival"])
    budget = F.floor(F.col("target") + 0.5)
    rounds = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    left = budget - rounds * F.col("source_size") - F.col("ahead")
    taken = rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return told.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *(["row"] if carry else []))


def copies(mix: DataFrame, text: str = "text") -> DataFrame:
    """The mixture itself: the rows of ``mixed(..., carry=True)``, once per time taken.

    Columns of the input, its text cut to the words taken (joined by one space) where the budget ended inside,
    behind them ``epoch`` from 1, in place of a column of that name.
    """
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    each = mix.where("taken > 0").select("row", "size", "taken", F.explode(F.sequence(F.lit(1), times)).alias("epoch"))
    words = F.least(F.col("size"), F.col("taken") - (F.col("epoch") - 1) * F.col("size")).cast("int")
    whole = F.col("row")[text]
    cut = F.when(words == F.col("size"), whole).otherwise(
        F.array_join(F.slice(F.regexp_extract_all(whole, F.lit(f"({WORD})")), F.lit(1), words), " "))
    return each.select(*[cut.alias(c) if c == text else F.col("row")[c].alias(c)
                         for c in mix.schema["row"].dataType.names if c != "epoch"], "epoch")

"""Text expressions: excerpts, labels, tokens, n-grams, keyword hits."""
from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .clean import _col, strip

# A token is a run of two or more word characters; a figure is a ticket id, a
# date, or a number with an optional percent sign.
TOKEN = r"[\p{L}\p{N}_]{2,}"
FIGURE = r"TK-\d+|\d{4}-\d{2}-\d{2}|\d+(?:\.\d+)?%?"


def ticket_text(message: Column | str, notes: Column | str) -> Column:
    """Lower-case message and notes on separate lines."""
    return F.lower(F.concat_ws("\n", F.coalesce(_col(message), F.lit("")),
                               F.coalesce(_col(notes), F.lit(""))))


def excerpt(message: Column | str, notes: Column | str, size: int = 300) -> Column:
    """One-line review excerpt of both texts, cut at ``size`` characters."""
    joined = F.concat(F.lit("MSG: "), strip(message), F.lit(" || NOTES: "), strip(notes))
    flat = strip(F.regexp_replace(joined, r"(?U)[\s\x1c-\x1f]+", " "))
    return F.substring(flat, 1, size)


def group_label(category: Column | str, family: Column | str) -> Column:
    return F.concat(strip(category), F.lit(" | "), F.coalesce(_col(family), F.lit("?")))


def id_label(ticket: Column | str, agent: Column | str) -> Column:
    return F.concat(_col(ticket), F.lit(":"), _col(agent))


def pair_method() -> Column:
    """Review note of a repeat pair: which keys agree and how far apart the contacts are."""
    def flag(name: str) -> Column:
        return F.when(F.col(name), F.lit("True")).otherwise(F.lit("False"))
    return F.concat(
        F.lit("same_order="), flag("same_order"), F.lit(" same_product="), flag("same_product"),
        F.lit(" same_category="), flag("same_category"), F.lit(" gap="),
        F.col("gap_days").cast("string"), F.lit("d"))


def _unicode(pattern: str) -> str:
    return pattern if pattern.startswith("(?U)") else "(?U)" + pattern


# A pattern that asks for a fixed text between borders: what stands before it, the text, what stands behind it.
_BORDERED = re.compile(r"(\\b|\(\^\|\[[^\]]*\]\))([\w -]+)(\\w\*\\b|\\b|\(\$\|\[[^\]]*\]\))")


def combined_searches(patterns: list[str]) -> tuple[list[str], dict[str, tuple[int, str]]]:
    """Searches that find many patterns at once, and per pattern that one of them covers (search, text found).

    Patterns with equal borders are one search, in which a look-ahead at every place names the text that
    stands there between such borders. Of two texts one of which begins the other, only one could be named at a
    place, so they are in different searches. Patterns of another form are in none.
    """
    searches: list[tuple[tuple[str, str], list[str]]] = []
    covered: dict[str, tuple[int, str]] = {}
    for pattern in dict.fromkeys(patterns):
        found = _BORDERED.fullmatch(pattern)
        if not found:
            continue
        before, text, behind = found.groups()
        for i, (borders, texts) in enumerate(searches):
            if borders == (before, behind) and not any(t.startswith(text) or text.startswith(t) for t in texts if t != text):
                break
        else:
            i, texts = len(searches), []
            searches.append(((before, behind), texts))
        if text not in texts:
            texts.append(text)
        covered[pattern] = (i, text)
    open_group = "(?:"
    return [
        f"(?U)(?={before.replace('(', open_group, 1)}({_alternatives(texts)}){behind.replace('(', open_group, 1)})"
        for (before, behind), texts in searches], covered


def _alternatives(texts: list[str]) -> str:
    """Alternation that looks at the first letter once."""
    by_letter: dict[str, list[str]] = {}
    for text in texts:
        by_letter.setdefault(text[0], []).append(text[1:])
    return "|".join(letter + (rests[0] if len(rests) == 1 else f"(?:{'|'.join(rests)})") for letter, rests in by_letter.items())


def hit_counts(text: Column, patterns: dict[str, list[str]]) -> Column:
    """Array, in the order of ``patterns``: how many of a name's patterns occur in the text (each counted once).

    The text is read once per combined search, not once per pattern.
    """
    searches, covered = combined_searches([p for each in patterns.values() for p in each])
    found = F.struct(text.alias("text"), *[
        F.array_distinct(F.regexp_extract_all(text, F.lit(search), F.lit(1))).alias(f"s{i}") for i, search in enumerate(searches)])

    def counts(f: Column) -> Column:
        def occurs(pattern: str) -> Column:
            if pattern in covered:
                i, words = covered[pattern]
                return F.array_contains(f[f"s{i}"], words)
            return f["text"].rlike(_unicode(pattern))
        return F.array(*[sum((occurs(p).cast("int") for p in each), F.lit(0)) for each in patterns.values()])

    # An array of one element names a value that is used several times.
    return F.get(F.transform(F.array(found), counts), F.lit(0))


def tokens(text: Column | str, stop_words: list[str], pattern: str = TOKEN) -> Column:
    """Lower-case tokens in order, without stop words."""
    found = F.regexp_extract_all(F.lower(_col(text)), F.lit(pattern), F.lit(0))
    if not stop_words:
        return found
    return F.filter(found, lambda t: ~t.isin(*stop_words))


def figures_missing(draft_json: Column | str, text: Column | str) -> Column:
    """Figures of the draft that do not occur verbatim in the text."""
    wanted = F.array_distinct(F.regexp_extract_all(_col(draft_json), F.lit(FIGURE), F.lit(0)))
    return F.filter(wanted, lambda t: F.instr(_col(text), t) == 0)


def figures_kept(draft_json: Column | str, text: Column | str) -> Column:
    """True when every id, date and number of the draft occurs verbatim in the text."""
    wanted = F.regexp_extract_all(_col(draft_json), F.lit(FIGURE), F.lit(0))
    return F.forall(wanted, lambda t: F.instr(_col(text), t) > 0)

"""Parsing and normalising of text cells."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters a Unicode-aware strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Accepted cell formats.
_TIMESTAMP = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}( [0-9]{1,2}:[0-9]{1,2}(:[0-9]{1,2})?)?$"
_DATE = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"
_NUMBER = r"^[+-]?([0-9](_?[0-9])*\.?([0-9](_?[0-9])*)?|\.[0-9](_?[0-9])*)([eE][+-]?[0-9](_?[0-9])*)?$"
_NOT_FINITE = r"(?i)^[+-]?(nan|inf|infinity)$"
_SCORE = r"^\+?(0_?)*[1-5]$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trimmed text; NULL becomes the empty string."""
    return F.btrim(F.coalesce(_col(c), F.lit("")), F.lit(WHITESPACE))


def norm(c: Column | str) -> Column:
    """Trimmed lower-case text, for channels, statuses and other keys."""
    return F.lower(strip(c))


def parse_timestamp(c: Column | str) -> Column:
    """Local display time, or NULL: date with minutes, date with seconds, or a bare date."""
    flat = F.regexp_replace(strip(c), r"(?U)[T\s]+", " ")
    return F.when(flat.rlike(_TIMESTAMP), flat).try_cast("timestamp_ntz")


def parse_date(c: Column | str) -> Column:
    """Date from the first ten characters, or NULL."""
    head = F.substring(strip(c), 1, 10)
    return F.when(head.rlike(_DATE), head).try_cast("date")


def monday_of(day: Column | str) -> Column:
    """Monday of the ISO week of a date."""
    return F.date_sub(_col(day), F.weekday(_col(day)))


def in_week(moment: Column | str, week_start: Column | str) -> Column:
    """True when the moment falls on one of the seven days from ``week_start``; NULL is False."""
    day = F.to_date(_col(moment))
    start = F.to_date(F.lit(week_start)) if isinstance(week_start, str) else week_start
    return F.coalesce((day >= start) & (day < F.date_add(start, 7)), F.lit(False))


def to_number(c: Column | str) -> Column:
    """Floating-point value of a text cell, or NULL."""
    s = strip(c)
    plain = F.when(s.rlike(_NUMBER), F.replace(s, F.lit("_"), F.lit("")))
    special = F.when(s.rlike(_NOT_FINITE), s)
    return F.coalesce(plain, special).try_cast("double")


def is_integral(v: Column) -> Column:
    """True for whole numbers; NaN and infinities are not whole."""
    return F.coalesce((v == F.floor(v).cast("double")) & (F.abs(v) < F.lit(9.2e18)), F.lit(False))


def csat(c: Column | str) -> Column:
    """Whole score 1..5, or NULL for blanks, zero, fractions and other values."""
    s = strip(c)
    return F.when(s.rlike(_SCORE), F.right(s, F.lit(1)).cast("int"))


def is_blank(c: Column | str) -> Column:
    return strip(c) == ""


def resolved_at_trusted(source: Column | str, resolved_at: Column | str,
                        primary: str = "helpdesk") -> Column:
    """Only the primary system's resolution time is safe for durations."""
    return (strip(source) == primary) & ~is_blank(resolved_at)


def breach(created: Column | str, first: Column | str, channel_key: Column | str,
           targets: dict[str, int]) -> Column:
    """Whether the first response came strictly later than the channel's target.

    NULL when a timestamp is missing or the channel has no target.
    """
    waited = _col(first) - _col(created)
    out = F.lit(None).cast("boolean")
    for channel, minutes in targets.items():
        limit = F.make_dt_interval(mins=F.lit(minutes))
        out = F.when(_col(channel_key) == channel, waited > limit).otherwise(out)
    return out


def seconds_between(later: Column | str, earlier: Column | str) -> Column:
    """Exact seconds between two local timestamps."""
    return (_col(later) - _col(earlier)).cast("interval second").cast("decimal(20,6)").cast("double")


def days_between(later: Column | str, earlier: Column | str) -> Column:
    return seconds_between(later, earlier) / F.lit(86400.0)


def minutes_between(later: Column | str, earlier: Column | str) -> Column:
    return seconds_between(later, earlier) / F.lit(60.0)


def round_exact(x: Column, digits: int) -> Column:
    """Round a double to ``digits`` decimals by its exact binary value, exact ties to even.

    ``bround`` rounds the shortest decimal form instead, so 0.025 becomes 0.02 there although
    the stored double lies above the tie. The scaled value is split into a product and its exact
    rounding error; the error decides when the product falls on a tie.
    """
    scale = float(10 ** digits)

    def rounded(v: Column) -> Column:
        c = v * F.lit(134217729.0)
        high = c - (c - v)
        product = v * F.lit(scale)
        error = (high * F.lit(scale) - product) + (v - high) * F.lit(scale)
        tie = product - F.floor(product) == 0.5
        nearest = (F.when(tie & (error > 0), F.floor(product) + 1)
                   .when(tie & (error < 0), F.floor(product)).otherwise(F.rint(product)))
        return nearest.cast("double") / F.lit(scale)
    return F.get(F.transform(F.array(x.cast("double")), rounded), F.lit(0))


def share(part: Column, whole: Column, digits: int = 2) -> Column:
    """Rounded percentage; 0 for an empty whole."""
    return F.coalesce(round_exact(F.try_divide(part * F.lit(100.0), whole), digits), F.lit(0.0))


def ratio(part: Column, whole: Column, digits: int = 3) -> Column:
    return round_exact(F.try_divide(part.cast("double"), whole), digits)

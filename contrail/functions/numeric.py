"""Lenient number/boolean parsing and unit conversion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit factors (inbound: ft->m, kt->m/s, ft/min->m/s;
# outbound: m->ft, m/s->kt, m/s->ft/min).
FT_TO_M = 0.3048
KT_TO_MS = 0.514444
FTMIN_TO_MS = 0.00508
M_TO_FT = 3.28084
MS_TO_KT = 1.94384
MS_TO_FPM = 196.85

# Whitespace removed by a lenient strip: exactly the characters Python's
# str.isspace() accepts (all lie below U+3001).
WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())

# Text accepted as a number by a lenient float parser: optional sign, digits
# with single underscores between them, optional fraction and exponent, or
# the special words nan / inf / infinity. Surrounding whitespace is allowed.
_DIGITS = r"\d(?:_?\d)*"
_NUMBER_RE = (
    rf"^[+-]?(?:(?:{_DIGITS})(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"
)
_SPECIAL = ["nan", "inf", "infinity"]
_SPECIALS = [p + w for w in _SPECIAL for p in ("", "+", "-")]
# Syntax Spark's cast accepts but a Python float parser rejects: type
# suffixes (1.5d, 2f) and hexadecimal floats (0x1p3).
_CAST_ONLY_CHARS = "dDfFxXpP"


def strip_ws(c: Column) -> Column:
    """Strip leading/trailing whitespace of every kind (``trim`` only strips
    spaces); a character-set trim, no regular expression."""
    return F.btrim(c, F.lit(WHITESPACE))


def safe_number(c: Column) -> Column:
    """text -> double; null or unparseable -> null (never raises).

    Fast path: Spark's own cast, accepted unless the text uses cast-only
    syntax. Only text with underscores (``1_000``) takes the pattern check.
    """
    s = strip_ws(c.cast("string"))
    v = s.try_cast("double")
    plain = F.length(F.translate(s, _CAST_ONLY_CHARS, "")) == F.length(s)
    special = F.lower(s).isin(*_SPECIALS)
    underscored = v.isNull() & s.contains("_") & s.rlike(_NUMBER_RE)
    return (F.when(v.isNotNull() & (plain | special), v)
            .when(underscored, F.regexp_replace(s, "_", "").try_cast("double")))


def finite_or_null(c: Column) -> Column:
    """NaN and +/-infinity become null (how they serialise to JSON)."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def safe_bool_text(c: Column) -> Column:
    """F2 for text values: true iff the lower-cased text is true, 1 or yes."""
    return F.lower(c).isin("true", "1", "yes")


def safe_bool(c: Column, kind: str = "string") -> Column:
    """booleans pass, text by word, numbers by truthiness; null -> false."""
    if kind == "boolean":
        return F.coalesce(c, F.lit(False))
    if kind == "number":
        return F.coalesce(c != 0, F.lit(False))
    return F.coalesce(safe_bool_text(c), F.lit(False))


def round_half_up(c: Column) -> Column:
    """Round half toward +infinity (``round`` rounds half away from zero)."""
    return F.floor(c + F.lit(0.5)).cast("bigint")


def feet(metres: Column) -> Column:
    return round_half_up(metres * F.lit(M_TO_FT))


def knots(ms: Column) -> Column:
    return round_half_up(ms * F.lit(MS_TO_KT))


def feet_per_minute(ms: Column) -> Column:
    return round_half_up(ms * F.lit(MS_TO_FPM))

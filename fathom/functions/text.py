"""String predicates and number parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. Characters Python's str.strip() removes (str.isspace), as one
# regex class: ASCII whitespace, the four separators \x1c-\x1f, NEL, NBSP and
# the Unicode space separators / line and paragraph separators.
_WS = "[\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"

# Fixed values. Text that counts as a gap (no value) in a series.
GAP_TEXTS = ("nan", "None", "")

# Fixed value. A number as pandas' to_numeric accepts it (case-insensitive):
# optional sign, digits with optional point and exponent, with ASCII
# whitespace around; or a signed inf / infinity with no whitespace at all.
NUMBER_RE = r"(?i)^(\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?)\s*|[+-]?(inf|infinity))$"


WS_CLASS = _WS


def strip_ws(c: Column) -> Column:
    """str.strip(): remove leading and trailing whitespace of any kind."""
    return F.regexp_replace(c, f"^{_WS}+|{_WS}+$", "")


def contains_ci(c: Column, needle: str) -> Column:
    """Literal, case-insensitive substring test (``%`` and ``_`` are plain text)."""
    return F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(needle.lower()))


def search_any(cols: list[Column | str], needle: str | None) -> Column:
    """True when the needle is blank, else when any column contains it."""
    if not needle:
        return F.lit(True)
    cond = None
    for c in cols:
        term = contains_ci(F.col(c) if isinstance(c, str) else c, needle)
        cond = term if cond is None else (cond | term)
    return cond


def gap_to_null(c: Column) -> Column:
    """Text ``nan``, ``None`` or blank, in this spelling, and a NaN number mean
    no value."""
    txt = c.cast("string")
    nan_number = (F.typeof(c).isin("double", "float")) & (txt == "NaN")
    return F.when(c.isNull() | txt.isin(*GAP_TEXTS) | nan_number, F.lit(None)).otherwise(c)


# Pandas reads integer text as int64 / uint64 and rejects
# integers outside [-2^63, 2^64 - 1]; text overflowing a double is rejected.
_INT_RE = r"^\s*[+-]?\d+\s*$"
_INF_RE = r"(?i)^[+-]?inf(inity)?$"
INT_MIN = "-9223372036854775808"
UINT_MAX = "18446744073709551615"


def _parses(txt: Column, strict: bool = True) -> Column:
    """The text is a number pandas' to_numeric reads (see NUMBER_RE and the
    overflow bound above). The integer range applies to the strict test
    only: coercion turns out-of-range integers into doubles."""
    core = strip_ws(txt)
    as_double = core.try_cast("double")
    overflow = (F.abs(as_double) == F.lit(float("inf"))) & ~core.rlike(_INF_RE)
    digits = F.regexp_replace(core, "^([+-]?)0+(?=\\d)", "$1")
    as_int = digits.try_cast("decimal(38,0)")
    int_out = txt.rlike(_INT_RE) & (as_int.isNull()
                                    | (as_int < F.lit(INT_MIN).cast("decimal(38,0)"))
                                    | (as_int > F.lit(UINT_MAX).cast("decimal(38,0)")))
    ok = txt.rlike(NUMBER_RE) & ~overflow
    return ok & ~int_out if strict else ok


def is_strict_number(c: Column) -> Column:
    """Value a strict numeric conversion accepts: null or the empty text (both
    become NaN) or a number. Whitespace-only text is rejected."""
    txt = c.cast("string")
    return c.isNull() | (txt == "") | _parses(txt)


def to_number(c: Column) -> Column:
    """Lenient numeric conversion: bad values become null (never an error)."""
    txt = c.cast("string")
    return F.when(_parses(txt, strict=False), strip_ws(txt).try_cast("double"))

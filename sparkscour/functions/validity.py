"""Empty values, contract patterns, percentages and number parsing as column expressions."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from sparkscour.functions.text import as_col, trim_space

# The pattern that allows everything, and the words that stand for "no value".
ANY_VALUE = "^.*$"
EMPTY_WORDS = {
    "validator": ("NaN", "nan", "undefined"),
    "cleaner": ("null", "NULL", "NaN", "nan", "undefined"),
    "unified": ("null", "NULL", "NaN", "nan", "undefined"),
}


def is_empty(c: Column | str, mode: str = "validator") -> Column:
    """NULL, blank, or one of the empty words of ``mode``; never NULL itself."""
    text = as_col(c)
    empty = (trim_space(text) == "") | text.isin(*EMPTY_WORDS[mode])
    return F.coalesce(empty, F.lit(True))


def jvm_pattern(pattern: str) -> str:
    """Let ``$`` mean the very end of the value, not also the place before a last newline."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        in_class = (in_class or ch == "[") and not (in_class and ch == "]")
        out.append(r"\z" if ch == "$" and not in_class else ch)
        i += 1
    return "".join(out)


# Whether the JVM accepts a pattern never changes, so each is tried once per process.
_ACCEPTED: dict[str, bool] = {}


def usable_pattern(spark: SparkSession, pattern: str | None) -> str | None:
    """The pattern to test with, or None where every value passes (blank, catch-all, invalid)."""
    if not pattern or pattern == ANY_VALUE:
        return None
    ready = jvm_pattern(pattern)
    if ready not in _ACCEPTED:
        try:
            spark.sql("SELECT '' RLIKE :p AS ok", args={"p": ready}).collect()
            _ACCEPTED[ready] = True
        except PySparkException:
            _ACCEPTED[ready] = False
    return ready if _ACCEPTED[ready] else None


def matches_contract(
    c: Column | str, pattern: str | None, mode: str = "validator"
) -> Column:
    """True for empty values and for values in which the (usable) pattern is found."""
    if pattern is None:
        return F.lit(True)
    return is_empty(c, mode) | as_col(c).rlike(pattern)


def percent(part: Column, whole: Column) -> Column:
    """Percentage with two decimals; 0 where the whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part / whole * 100, 2))


def leading_number(c: Column | str, default: float = 0.0) -> Column:
    """The number a text starts with (``12abc`` is 12); ``default`` where there is none."""
    prefix = F.regexp_extract(
        trim_space(as_col(c).cast("string")),
        r"^([+-]?(?:Infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?))",
        1,
    )
    return F.coalesce(prefix.try_cast("double"), F.lit(float(default)))

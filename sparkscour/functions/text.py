"""Text cleaning, comparison keys and CSV cell text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# Typographic characters and their ASCII spelling.
ASCII_SPELLING = {
    # quotes
    "‘": "'",
    "’": "'",
    "“": '"',
    "”": '"',
    "′": "'",
    "‵": "'",
    "`": "'",
    "″": '"',
    "‶": '"',
    "‴": '"',
    "‷": '"',
    "‹": "<",
    "›": ">",
    "«": "<<",
    "»": ">>",
    # symbols
    "–": "-",
    "—": "-",
    "…": "...",
    "°": " degrees",
    "×": "x",
    "÷": "/",
    "±": "+/-",
    "≤": "<=",
    "≥": ">=",
    "≠": "!=",
    "≈": "~",
    "∞": "infinity",
    "√": "sqrt",
    "²": "^2",
    "³": "^3",
    # fractions
    "¼": "1/4",
    "½": "1/2",
    "¾": "3/4",
    "⅓": "1/3",
    "⅔": "2/3",
    "⅕": "1/5",
    "⅖": "2/5",
    "⅗": "3/5",
    "⅘": "4/5",
    "⅙": "1/6",
    "⅚": "5/6",
    "⅐": "1/7",
    "⅛": "1/8",
    "⅜": "3/8",
    "⅝": "5/8",
    "⅞": "7/8",
    "⅑": "1/9",
    "⅒": "1/10",
}


def as_col(c: Column | str) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def trim_space(c: Column | str) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(as_col(c), F.lit(SPACE_CHARS))


def collapse_space(c: Column | str) -> Column:
    """Turn each run of white space into one blank and trim.

    The JVM class knows ASCII white space only and is fast; the other kinds are turned into
    blanks first, where a value has any non-ASCII character.
    """
    text = as_col(c)
    wide = "".join(ch for ch in SPACE_CHARS if not ch.isascii())
    narrow = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, wide, " " * len(wide)))
    return _collapse_ascii_space(narrow.otherwise(text))


def _collapse_ascii_space(text: Column) -> Column:
    # A single blank is left alone, so that it costs no replacement.
    return F.trim(F.regexp_replace(text, r"\s{2,}|[^\S ]", " "))


def spell_ascii(c: Column | str) -> Column:
    """Replace the mapped typographic characters; other characters stay."""
    single = {k: v for k, v in ASCII_SPELLING.items() if len(v) == 1}
    out = F.translate(as_col(c), "".join(single), "".join(single.values()))
    for char, spelling in ASCII_SPELLING.items():
        if char not in single:
            out = F.replace(out, F.lit(char), F.lit(spelling))
    return out


def collapse_quotes(c: Column | str) -> Column:
    """Turn each run of double quotes, and each run of single quotes, into one."""
    return F.regexp_replace(as_col(c), r"""(["'])\1+""", "$1")


def strip_non_ascii(c: Column | str) -> Column:
    """Delete everything that is not printable ASCII."""
    return F.regexp_replace(as_col(c), r"[^\x20-\x7E]+", "")


def clean_text(c: Column | str) -> Column:
    """White space, then spelling, then quotes, then non-ASCII; NULL and '' stay as they are.

    Most text has no mapped character and skips the spelling step.
    """
    text = as_col(c)
    flat = collapse_space(text)
    # All mapped characters but the grave accent lie in these ranges; accented letters do not.
    mapped = text.rlike(r"[`\u00ab-\u00bf\u00d7\u00f7\u2010-\u22ff]")
    spelled = F.when(mapped, spell_ascii(flat)).otherwise(flat)
    full = strip_non_ascii(collapse_quotes(spelled))
    plain = strip_non_ascii(collapse_quotes(_collapse_ascii_space(text)))
    return F.when(text.rlike(r"[^\x00-\x7F]|`"), full).otherwise(plain)


def normalize_key(c: Column | str) -> Column:
    """Lower case words of letters, digits, ``_``, ``'`` and ``-``, with one blank in between."""
    words = F.regexp_replace(F.lower(as_col(c)), r"[\W&&[^'\-]]+", " ")
    return F.coalesce(F.trim(words), F.lit(""))


def comparison_key(*cols: Column | str) -> Column:
    """Normalized values joined by one blank; empty ones are left out."""
    return F.concat_ws(" ", *[F.nullif(normalize_key(c), F.lit("")) for c in cols])


def token_estimate(c: Column | str) -> Column:
    """Four characters to a token, rounded up."""
    return tokens_of(F.length(as_col(c)))


def tokens_of(chars: Column) -> Column:
    return F.ceil(chars / F.lit(4)).cast("long")


def csv_quote(c: Column | str) -> Column:
    """The value as a CSV field: quoted only where needed, NULL as empty."""
    text = F.coalesce(as_col(c).cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\n]'), quoted).otherwise(text)


def csv_line(*cols: Column | str) -> Column:
    return F.concat_ws(",", *[csv_quote(c) for c in cols])


def unquote(c: Column | str) -> Column:
    """Strip one outer pair of double quotes and undo doubled ones inside."""
    text = as_col(c)
    inner = F.replace(F.substring(text, F.lit(2), F.length(text) - 2), F.lit('""'), F.lit('"'))
    wrapped = text.startswith('"') & text.endswith('"')
    return F.when(wrapped, inner).otherwise(text)


def csv_fields(line: Column) -> Column:
    """Split one CSV line into an array of field values.

    A quote opens a quoted stretch anywhere in a field, a doubled quote inside it is a quote,
    and an unclosed stretch runs to the end of the line.
    """
    # With a comma in front of the line, each match takes one, so empty fields are matches too.
    field = r',([^,"]*+(?:"(?:[^"]++|"")*+(?:"|$)[^,"]*+)*+)'
    stretch = r'"((?:[^"]++|"")*+)(?:"|$)'
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(field), F.lit(1))
    return F.transform(
        raw,
        lambda f: F.replace(F.regexp_replace(f, stretch, "$1"), F.lit('""'), F.lit('"')),
    )

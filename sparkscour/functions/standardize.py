"""Rule-based standard forms. Each function gives NULL where a value has no standard form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkscour.functions.text import as_col, trim_space

# Accepted date layouts (guard pattern, layout) and company suffixes.
DATE_LAYOUTS = (
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (r"^\d{2}/\d{2}/\d{4}$", "MM/dd/yyyy"),
    (r"^\d{2} [A-Z][a-z]{2} \d{4}$", "dd MMM yyyy"),
)
COMPANY_SUFFIXES = ("Inc", "LLC", "Ltd", "Corp", "Co")
EMAIL_PATTERN = r"^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}$"
ACCOUNT_DIGITS = r"^\d{10,12}$"


def phone_e164(c: Column | str, country: str = "1") -> Column:
    """``+<country><ten digits>``."""
    digits = F.regexp_replace(as_col(c), "[^0-9]", "")
    return F.when(F.length(digits) == 10, F.concat(F.lit("+" + country), digits)).when(
        (F.length(digits) == 10 + len(country)) & digits.startswith(country),
        F.concat(F.lit("+"), digits),
    )


def iso_date(c: Column | str, layouts: Sequence[tuple[str, str]] = DATE_LAYOUTS) -> Column:
    """``YYYY-MM-DD``."""
    text = trim_space(c)
    tries = [F.when(text.rlike(g), F.try_to_timestamp(text, F.lit(f))) for g, f in layouts]
    return F.date_format(F.coalesce(*tries), "yyyy-MM-dd")


def company_name(c: Column | str, suffixes: Sequence[str] = COMPANY_SUFFIXES) -> Column:
    """The name without a legal suffix at its end."""
    names = "|".join(suffixes)
    return F.trim(F.regexp_replace(trim_space(c), rf"(?i)[,\s]+(?:{names})\.?$", ""))


def email(c: Column | str) -> Column:
    """Lower case and trimmed, if it is an address at all."""
    text = F.lower(trim_space(c))
    return F.when(text.rlike(EMAIL_PATTERN), text)


def usd(c: Column | str) -> Column:
    """``$X,XXX.XX``."""
    amount = F.regexp_replace(trim_space(c), r"[$,]", "").try_cast("double")
    body = F.concat(F.lit("$"), F.format_number(F.abs(amount), 2))
    return F.when(amount < 0, F.concat(F.lit("-"), body)).otherwise(body)


def account_digits(c: Column | str) -> Column:
    """True where the value is 10 to 12 digits."""
    return F.coalesce(as_col(c).rlike(ACCOUNT_DIGITS), F.lit(False))


def missing_critical(columns: Sequence[str], empty: Sequence[Column]) -> Column:
    """Names of the critical columns that are empty in a row."""
    names = F.array(*[F.when(e, F.lit(n)) for n, e in zip(columns, empty)])
    return F.array_compact(names)

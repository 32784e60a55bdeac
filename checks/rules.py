"""Rule-based standard forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import duck, query, table
from checks.inputs import MESSY_SQL, messy_customers
from sparkscour.functions import standardize as S
from sparkscour.operators.standardizers import flag_missing, standardize

_DIGITS = "regexp_replace(\"Phone\", '[^0-9]', '', 'g')"
PHONE = (
    f"CASE WHEN length({_DIGITS}) = 10 THEN '+1' || {_DIGITS} "
    f"WHEN length({_DIGITS}) = 11 AND starts_with({_DIGITS}, '1') THEN '+' || {_DIGITS} END"
)
_DAY = duck.trim('"Signup"')
DATE = (
    f"strftime(coalesce(TRY_STRPTIME({_DAY}, '%Y-%m-%d'), TRY_STRPTIME({_DAY}, '%m/%d/%Y'), "
    f"TRY_STRPTIME({_DAY}, '%d %b %Y')), '%Y-%m-%d')"
)
COMPANY = (
    rf"""trim(regexp_replace({duck.trim('"Company"')}, '[,\s]+(Inc|LLC|Ltd|Corp|Co)\.?$', '', 'i'))"""
)
_MAIL = f"lower({duck.trim(chr(34) + 'Email' + chr(34))})"
EMAIL = rf"CASE WHEN regexp_matches({_MAIL}, '^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{{2,}}$') THEN {_MAIL} END"


def _one(name: str, column: str, sql: str, rule) -> None:
    @query(name, f'WITH messy AS ({MESSY_SQL}) SELECT row_id, {sql} AS value FROM messy')
    def build(spark, d):
        return messy_customers(spark, d).select("row_id", rule(column).alias("value"))


_one("std_phone", "Phone", PHONE, S.phone_e164)
_one("std_date", "Signup", DATE, S.iso_date)
_one("std_company", "Company", COMPANY, S.company_name)
_one("std_email", "Email", EMAIL, S.email)


@query(
    "std_currency",
    "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || "
    "format('${:,.2f}', abs(c_acctbal)) AS value FROM customer",
)
def std_currency(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey", S.usd(F.col("c_acctbal").cast("string")).alias("value")
    )


@query(
    "std_digits",
    f"WITH messy AS ({MESSY_SQL}) SELECT row_id, regexp_matches({_DIGITS}, '^[0-9]{{10,12}}$') "
    "AS value FROM messy",
)
def std_digits(spark, d):
    digits = F.regexp_replace("Phone", "[^0-9]", "")
    return messy_customers(spark, d).select("row_id", S.account_digits(digits).alias("value"))


FORMS = {"Phone": PHONE, "Signup": DATE, "Company": COMPANY, "Email": EMAIL}


@query(
    "standardize_cells",
    f"WITH messy AS ({MESSY_SQL}) "
    + " UNION ALL ".join(
        f"SELECT row_id, '{c}' AS \"column\", {form} AS corrected_value, 'standardize' AS source, "
        f"CAST(0 AS BIGINT) AS seq FROM messy "
        f"WHERE NOT {duck.empty(chr(34) + c + chr(34), 'unified')} AND ({form}) <> \"{c}\""
        for c, form in FORMS.items()
    ),
)
def standardize_cells(spark, d):
    rules = {
        "Phone": S.phone_e164, "Signup": S.iso_date, "Company": S.company_name, "Email": S.email
    }
    return standardize(messy_customers(spark, d), rules)


CRITICAL = ["Email", "Phone", "Company"]


@query(
    "flag_missing",
    f"WITH messy AS ({MESSY_SQL}), m AS (SELECT row_id, list_filter(["
    + ", ".join(
        f"CASE WHEN {duck.empty(chr(34) + c + chr(34), 'unified')} THEN '{c}' END" for c in CRITICAL
    )
    + "], lambda x: x IS NOT NULL) AS missing FROM messy) SELECT * FROM m WHERE len(missing) > 0",
)
def missing(spark, d):
    return flag_missing(messy_customers(spark, d), CRITICAL)

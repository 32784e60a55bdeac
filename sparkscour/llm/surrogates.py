"""Keyed surrogates for personal data.

Each entity gets a replacement that depends on a secret key, its kind and its canonical form alone, so
that mentions of one entity stay one entity everywhere. Replacements keep the format: digits for digits,
letters of the same script and case for letters, a given name of the same gender. A table of all
entities is checked until no two of them share a replacement and none is replaced by a real one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscour.llm.common import let, name, packed, text_of
from sparkscour.session import durable

# Titles tell that a name follows, and its gender. Fixed values.
TITLES = {
    "f": "Mrs Ms Miss Frau Mme Madame Señora Sra Госпожа Κυρία",
    "m": "Mr Herr Monsieur Señor Господин Κύριος",
}
GIVEN = {
    ("f", "latin"): "Alma Berta Carla Dora Edith Flora Greta Helga Irma Jutta Klara Lotte",
    ("m", "latin"): "Anton Bruno Carlos Dieter Emil Fritz Georg Hugo Ivo Jonas Kurt Leon",
    ("f", "cyrillic"): "Алла Вера Галина Дарья Жанна Зоя Инна Лидия",
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Захар Игорь Леонид",
    ("f", "greek"): "Αθηνά Βασιλική Γεωργία Δήμητρα Ελένη Ζωή",
    ("m", "greek"): "Ανδρέας Βασίλης Γιώργος Δημήτρης Ηλίας Θωμάς",
}
_TITLE = "|".join(w for line in TITLES.values() for w in line.split())
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"

# Kinds in the order in which they are tried at a place.
KINDS: dict[str, str] = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "name": rf"(?<!\p{{L}})(?:{_TITLE})\.?\x20\p{{Lu}}\p{{Ll}}+(?:\x20\p{{Lu}}\p{{Ll}}+)?",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?:\x20?\d{4}){3,7}(?:\x20?\d{1,3})?(?![\p{L}\p{N}])",
    "ip": rf"(?<![\p{{L}}\d])(?<!\d\.){_OCTET}(?:\.{_OCTET}){{3}}(?![\p{{L}}\d]|\.\d)",
    "card": r"(?<![\p{L}\d])(?<!\d[.,])\d(?:[\x20-]?\d){12,18}(?![\p{L}\d]|[.,]\d)",
    "ssn": r"(?<![\p{L}\d-])\d{3}-\d{2}-\d{4}(?![\p{L}\d]|-\d)",
    "phone": r"(?<![\p{L}\d+(.])(?:\+\d{1,3}[\x20.-]?)?(?:\(\d{2,4}\)|\d{2,4})[\x20.-]?\d{3,4}[\x20.-]\d{3,4}(?![\p{L}\d]|[.-]\d)"
    r"|(?<![\p{L}\d+(.])\+\d{8,15}(?![\p{L}\d])",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
# A text without any of these has no entity; most texts need no other pass.
HINT = rf"[@\d]|{_TITLE}"
MOST_ATTEMPTS = 64


@dataclass(frozen=True)
class Key:
    """The secret that replacements depend on; whoever lacks it can't link them to entities."""

    secret: str


def kind_of(mention: Column) -> Column:
    """The first kind whose pattern matches the whole mention."""
    out = F.when(F.contains(mention, F.lit("@")), F.lit("email"))
    for kind in list(KINDS)[1:-1]:
        out = out.when(mention.rlike(f"^(?:{KINDS[kind]})$"), F.lit(kind))
    return out.otherwise(F.lit("phone"))


def canonical(kind: Column, mention: Column) -> Column:
    """One form for all mentions of an entity: digits alone, lower-cased addresses, names without title."""
    return (
        F.when(kind == "email", F.lower(mention))
        .when(kind == "name", F.concat_ws(" ", gender_of(mention), F.regexp_replace(mention, rf"^(?:{_TITLE})\.?\x20", "")))
        .when(kind.isin("iban"), F.regexp_replace(mention, r"\x20", ""))
        .when(kind == "ip", mention)
        .otherwise(F.regexp_replace(mention, r"[^\d+]", ""))
    )


def gender_of(mention: Column) -> Column:
    return F.when(mention.rlike(rf"^(?:{'|'.join(TITLES['f'].split())})\b"), F.lit("f")).otherwise(F.lit("m"))


def number(digest: Column, at: Column) -> Column:
    """A number below 65536 from four hexadecimal digits of a digest, which is used again from its start."""
    return F.conv(F.substring(digest, (F.pmod(at, F.lit(60)) + 1).cast("int"), F.lit(4)), 16, 10).cast("int")


def masked(plain: Column, digest: Column) -> Column:
    """Every letter and digit replaced by another of its script and case; all else stays."""

    def one(c: Column, i: Column) -> Column:
        n = number(digest, i * 2 + F.floor(i / 60))

        def pick(letters: str) -> Column:
            return F.substring(F.lit(letters), (F.pmod(n, F.lit(len(letters))) + 1).cast("int"), F.lit(1))

        latin, cyrillic = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшщыэюя"
        greek = "αβγδεζηθικλμνξοπρστυφχψω"
        out = F.when(c.rlike("[0-9]"), pick("0123456789"))
        for script, letters in (("Cyrillic", cyrillic), ("Greek", greek)):
            out = out.when(c.rlike(rf"[\p{{Is{script}}}&&\p{{Lu}}]"), pick(letters.upper()))
            out = out.when(c.rlike(rf"[\p{{Is{script}}}&&\p{{L}}]"), pick(letters))
        out = out.when(c.rlike(r"\p{IsHan}"), pick("天地玄黄宇宙洪荒日月盈昃辰宿列张"))
        out = out.when(c.rlike(r"\p{Lu}"), pick(latin.upper())).when(c.rlike(r"\p{L}"), pick(latin))
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(plain, ""), one), "")


def replaced(kind: Column, canon: Column, attempt: Column, key: Key) -> Column:
    """The canonical form of an entity's replacement."""
    digest = F.sha2(F.concat_ws("\u0001", F.lit(key.secret), kind, canon, attempt.cast("string")), 512)

    def by_kind(d: Column) -> Column:
        host = F.element_at(F.split(canon, "@"), -1)
        local = F.substring_index(canon, "@", 1)
        top = F.concat(F.substring_index(host, ".", 1), F.lit("."), F.lit("example"))
        email = F.concat(masked(F.concat(local, F.lit("@"), F.substring_index(top, ".", 1)), d), F.lit(".example"))
        octets = F.array_join(
            F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.pmod(number(d, i * 4), F.lit(256)).cast("string")), "."
        )
        parts = F.split(canon, " ")
        gender, given, surname = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
        script = F.when(given.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(given.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")
        first: Column = F.lit(None).cast("string")
        for (g, s), names in GIVEN.items():
            pool = F.array(*[F.lit(x) for x in names.split()])
            first = F.when((gender == g) & (script == s), F.get(pool, F.pmod(number(d, F.lit(0)), F.size(pool)))).otherwise(first)
        # A single name is masked, since a pool of names would be too small for distinctness.
        person = F.when(surname.isNull(), F.concat_ws(" ", gender, masked(given, d))).otherwise(
            F.concat_ws(" ", gender, first, masked(surname, F.substring(d, 5, 124)))
        )
        # The country code of a number and of an account stays.
        country = F.regexp_extract(canon, r"^\+\d(?=\d{10}$)|^\+\d{2}(?=\d{8})|^[A-Z]{2}", 0)
        rest = F.substring(canon, F.char_length(country) + 1, F.char_length(canon))
        return (
            F.when(kind == "email", email)
            .when(kind == "ip", octets)
            .when(kind == "name", person)
            .otherwise(F.concat(country, masked(rest, d)))
        )

    return let(digest, by_kind)


def formatted(kind: Column, mention: Column, other: Column) -> Column:
    """A replacement written in the format of a mention: its spaces, marks and title."""

    def digits() -> Column:
        """The characters of ``other`` fill the places of letters, digits and plus signs in turn."""

        def step(acc: Column, c: Column) -> Column:
            fills = c.rlike(r"[\p{L}\d+]")
            return F.struct(
                F.concat(acc["out"], F.when(fills, F.substring(other, acc["at"], F.lit(1))).otherwise(c)).alias("out"),
                (acc["at"] + fills.cast("int")).alias("at"),
            )

        start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
        return F.aggregate(F.split(mention, ""), start, step, lambda acc: acc["out"])

    title = F.regexp_extract(mention, rf"^(?:{_TITLE})\.?\x20", 0)
    return (
        F.when(kind.isin("email", "ip"), other)
        .when(kind == "name", F.concat(title, F.regexp_replace(other, "^[fm] ", "")))
        .otherwise(digits())
    )


def mentions(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row per mention: the document's key, place in its order, mention, kind and canonical form."""
    content = text_of(docs, text)
    found = F.when(content.rlike(HINT), F.regexp_extract_all(content, F.lit(PATTERN), F.lit(0)))
    listed = docs.select(*document_key(docs, text), F.posexplode(found).alias("_at", "_mention"))
    kinds = listed.withColumn("_kind", kind_of(F.col("_mention")))
    return kinds.withColumn("_canon", canonical(F.col("_kind"), F.col("_mention")))


DOC = ["_nodoc", "_doc", "_text_hash"]


def document_key(docs: DataFrame, text: str) -> list[Column]:
    doc = name("doc_id").cast("long")
    return [
        doc.isNull().alias("_nodoc"),
        F.coalesce(doc, F.lit(0)).alias("_doc"),
        F.xxhash64(text_of(docs, text)).alias("_text_hash"),
    ]


def assign(entities: DataFrame, key: Key) -> DataFrame:
    """Distinct replacements (``_other``) for distinct entities (``_kind``, ``_canon``).

    Where entities share a replacement, all but the first by name try again, and so does an entity whose
    replacement is itself a real entity, until none is left. The number left is all the driver sees.
    """
    entity = ["_kind", "_canon"]
    held = durable(entities.select(*entity).distinct().withColumn("_attempt", F.lit(0)))
    for _ in range(MOST_ATTEMPTS):
        tried = held.withColumn("_other", replaced(F.col("_kind"), F.col("_canon"), F.col("_attempt"), key))
        # Sums and minima before the shuffle; real entities count as holders of their own form.
        holders = tried.select("_kind", F.col("_other").alias("_form"), F.col("_canon").alias("_by"), F.lit(0).alias("_real"))
        real = held.select("_kind", F.col("_canon").alias("_form"), F.lit(None).cast("string").alias("_by"), F.lit(1).alias("_real"))
        forms = (
            holders.unionByName(real)
            .groupBy("_kind", "_form")
            .agg(F.min("_by").alias("_first"), F.count("_by").alias("_n"), F.max("_real").alias("_real"))
            .filter((F.col("_n") > 1) | ((F.col("_n") > 0) & (F.col("_real") > 0)))
        )
        clash = forms.select("_kind", F.col("_form").alias("_other"), "_first", "_real")
        again = tried.join(clash, ["_kind", "_other"]).filter((F.col("_real") > 0) | (F.col("_canon") != F.col("_first")))
        again = durable(again.select(*entity).withColumn("_more", F.lit(1)))
        if again.isEmpty():
            return tried.select(*entity, "_other")
        held = durable(
            held.join(again, entity, "left").select(*entity, (F.col("_attempt") + F.coalesce("_more", F.lit(0))).alias("_attempt"))
        )
    raise RuntimeError("entities of one form are too many to be told apart by replacements of that form")


def pseudonymize(docs: DataFrame, key: Key, text: str = "text") -> DataFrame:
    """Every row (``row``) with its text after replacement (``safe``) and counts per kind (``n_<kind>``).

    Entities are told apart over all documents. A null text stays null and an empty one empty; equal rows
    get equal results; an entity of any length is replaced whole, and an empty table gives an empty one.
    """
    found = durable(mentions(docs, text))
    known = assign(found, key)
    # One entity may have any share of the mentions; the others' side has one row for it.
    other = found.join(known, ["_kind", "_canon"]).select(
        *DOC, "_at", "_kind", formatted(F.col("_kind"), F.col("_mention"), F.col("_other")).alias("_new")
    )
    # Copies of a row give the same mentions several times, so they are a set.
    per_doc = other.groupBy(*DOC).agg(F.sort_array(F.collect_set(F.struct("_at", "_kind", "_new"))).alias("_news"))
    content = text_of(docs, text)
    rows = docs.select(*document_key(docs, text), content.alias("_text"), name(text).isNull().alias("_none"), packed(docs).alias("row"))
    between = F.split("_text", PATTERN, -1)
    news = F.array_append(F.transform("_news", lambda x: x["_new"]), F.lit(""))
    filled = F.array_join(F.zip_with(between, news, lambda a, b: F.concat(a, b)), "")
    safe = F.when(F.col("_none"), F.lit(None)).when(F.col("_news").isNull(), F.col("_text")).otherwise(filled)
    counts = [
        F.coalesce(F.size(F.filter("_news", lambda x: x["_kind"] == F.lit(k))), F.lit(0)).cast("long").alias(f"n_{k}")
        for k in KINDS
    ]
    return rows.join(per_doc, DOC, "left").select("row", safe.alias("safe"), *counts)


def report(docs: DataFrame, key: Key) -> DataFrame:
    """Per row: ``doc_id``, ``text`` after replacement, and how many entities of each kind it had."""
    done = pseudonymize(docs, key)
    return done.select(
        F.col("row").getField("doc_id").cast("long").alias("doc_id"),
        F.col("safe").alias("text"),
        *[F.greatest(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in KINDS],
    )

"""Column functions: locators, normalisation, validation, versions, patterns and entities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTER = r"\p{L}\p{N}"
#: What stands between a repeated header and its number.
REPEAT = "\x1f"
CURRENCIES = r"(?i)(EUR|USD|GBP|CHF|JPY|€|\$|£|¥)"


def triple(value: Column, source: Column, confidence: Column) -> Column:
    """An attributed value: {value, source, confidence}."""
    return F.struct(value.cast("string").alias("value"), source.cast("string").alias("source"), confidence.cast("decimal(5,4)").alias("confidence"))


def attachment_locator(name: Column, locator: Column) -> Column:
    return F.concat(F.lit("attachment:"), name, F.lit("#"), locator)


def cell_locator(name: Column, sheet: Column, cell: Column) -> Column:
    return F.concat(F.lit("attachment:"), name, F.lit("!"), sheet, F.lit("!"), cell)


def body_locator(segment: Column) -> Column:
    return F.concat(F.lit("body:segment:"), segment.cast("string"))


def parse_locator(source: Column) -> Column:
    """kind, file, locator and depth of a source string; both separators are read."""
    kind = F.regexp_extract(source, r"^(body|attachment|embedded)", 1)
    depth = F.regexp_extract(source, r"^embedded:(\d+):", 1)
    file = F.regexp_extract(source, r"attachment:([^#!]+)", 1)
    place = F.regexp_extract(source, r"(?:attachment:[^#!]+[#!]|segment:)(.*)$", 1)
    return F.struct(
        F.when(kind != "", kind).alias("kind"),
        F.when(file != "", file).alias("file"),
        F.when(place != "", place).alias("locator"),
        F.when(depth != "", depth.cast("int")).otherwise(F.lit(0)).alias("depth"),
    )


def normal_label(label: Column) -> Column:
    """A header or label as aliases are compared: lower case, words of letters and digits, one space between."""
    return F.trim(F.regexp_replace(F.lower(label), rf"[^{LETTER}]+", " "))


def plain_header(header: Column) -> Column:
    """A header without the number that a repeated one has."""
    return F.regexp_replace(header, f"{REPEAT}\\d+$", "")


def parse_amount(text: Column) -> Column:
    """decimal(18,2) of an amount with currency signs and separators; a comma before two last digits is decimal."""
    bare = F.regexp_replace(text, r"[^0-9,.\-]", "")
    european = bare.rlike(r",\d{1,2}$")
    plain = F.when(european, F.regexp_replace(F.regexp_replace(bare, r"\.", ""), ",", ".")).otherwise(F.regexp_replace(bare, ",", ""))
    return plain.try_cast("decimal(18,2)")


def currency_of(text: Column) -> Column:
    found = F.upper(F.regexp_extract(text, CURRENCIES, 1))
    named = F.when(found == "€", "EUR").when(found == "$", "USD").when(found == "£", "GBP").when(found == "¥", "JPY").otherwise(found)
    return F.when(named != "", named)


def parse_date(text: Column, *patterns: str) -> Column:
    """The first of the patterns that reads the text; ISO dates by default."""
    return F.coalesce(*[F.try_to_date(F.trim(text), p) for p in (patterns or ("yyyy-MM-dd", "dd/MM/yyyy", "dd.MM.yyyy"))])


def normal_value(raw: Column, kind: Column) -> Column:
    """The comparison key of a value by its declared type: decimal, date or string."""
    return F.when(kind == "decimal", parse_amount(raw).cast("string")).when(kind == "date", parse_date(raw).cast("string")).otherwise(normal_label(raw))


def within(a: Column, b: Column, tolerance: Column) -> Column:
    return F.abs(a - b) <= tolerance


def phrase_in(text: Column, phrase: str) -> Column:
    """Whether a phrase stands in a text as whole words, whatever the case; letters of any script bound it."""
    import re

    return F.lower(text).rlike(rf"(^|[^{LETTER}]){re.escape(phrase.lower())}([^{LETTER}]|$)")


def version_key(version: Column) -> Column:
    """major, minor, patch as integers that compare in order."""
    return F.transform(F.split(version, r"\."), lambda x: x.try_cast("int"))


def in_range(version: Column, version_range: Column) -> Column:
    """Whether a version meets every bound of a range such as '>=2.1.0 <3.0.0'."""
    key = version_key(version)

    def meets(bound: Column) -> Column:
        sign, limit = F.regexp_extract(bound, r"^(>=|<=|>|<|=)?", 1), version_key(F.regexp_extract(bound, r"([0-9.]+)$", 1))
        return F.when(sign == ">=", key >= limit).when(sign == "<=", key <= limit).when(sign == ">", key > limit).when(sign == "<", key < limit).otherwise(key == limit)

    return F.forall(F.split(F.trim(version_range), r"\s+"), meets)


def bump_between(old: Column, new: Column) -> Column:
    """major, minor, patch, none or backward."""
    a, b = version_key(old), version_key(new)
    return F.when(b < a, "backward").when(F.get(a, F.lit(0)) != F.get(b, F.lit(0)), "major").when(F.get(a, F.lit(1)) != F.get(b, F.lit(1)), "minor").when(F.get(a, F.lit(2)) != F.get(b, F.lit(2)), "patch").otherwise("none")


def self_contained(path: Column) -> Column:
    """Whether a bundle path is relative and never climbs."""
    return ~path.rlike(r"^([/\\]|[A-Za-z]:)|(^|[/\\])\.\.([/\\]|$)")


def at_least(value: Column, minimum: Column) -> Column:
    return F.coalesce(value >= minimum, F.lit(False))


def not_before(date: Column, other: Column) -> Column:
    """Null (not evaluated) where either operand is missing."""
    return date >= other


def code(name: str, *arg: Column) -> Column:
    """A reason code with its argument."""
    return F.concat(F.lit(f"{name}:"), *arg) if arg else F.lit(name)


def code_prefix(reason: Column) -> Column:
    return F.substring_index(reason, ":", 1)


def money_entities(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"((?:EUR|USD|GBP|CHF|[€$£¥])\s?\d[\d.,]*\d|\d[\d.,]*\d\s?(?:EUR|USD|GBP|CHF|[€$£¥]))"), F.lit(1))


def date_entities(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})"), F.lit(1))


def org_entities(text: Column) -> Column:
    """Capitalised words before a company suffix."""
    return F.regexp_extract_all(text, F.lit(r"((?:\p{Lu}[\p{L}&-]+ ){1,4}(?:GmbH|AG|Inc|Ltd|LLC|SA|SAS|SL|BV|Corp|plc))"), F.lit(1))


def pii_findings(text: Column) -> Column:
    """How many e-mail addresses, IPv4 addresses and runs of 12 to 19 digits a text has."""
    return F.struct(
        F.regexp_count(text, F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")).cast("long").alias("emails"),
        F.regexp_count(text, F.lit(r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}")).cast("long").alias("addresses"),
        F.regexp_count(text, F.lit(r"[0-9]{12,19}")).cast("long").alias("accounts"),
    )


def key_candidates(text: Column) -> Column:
    """Possible passwords named in a text: what follows 'password', 'passphrase' or 'pin'."""
    return F.regexp_extract_all(text, F.lit(r"(?i)(?:password|passphrase|pin)\s*(?:is|:|=)\s*(\S+)"), F.lit(1))


def canonical_json(record: Column) -> Column:
    """JSON of a struct in its field order; maps must be turned into sorted entries before."""
    return F.to_json(record, {"ignoreNullFields": "false"})


def sorted_entries(m: Column) -> Column:
    return F.array_sort(F.map_entries(m))


def token_budget(text: Column, budget: Column) -> Column:
    """Tokens by the rule of four characters each, and whether they keep the budget."""
    used = F.ceil(F.char_length(text) / 4).cast("long")
    return F.struct(used.alias("used"), (used <= budget).alias("ok"))


def text_density(text: Column, pages: Column) -> Column:
    return F.char_length(text) / F.greatest(pages, F.lit(1))


def mapping_confidence(header: Column, alias: Column, filled: Column, rows: Column) -> Column:
    """How surely a header means a field: equal labels beat contained ones, and filled columns beat empty ones."""
    a, b = normal_label(header), normal_label(alias)
    base = F.when(a == b, 0.9).when(a.contains(b) | b.contains(a), 0.6).otherwise(0.0)
    return F.least(F.lit(1.0), base + 0.1 * filled / F.greatest(rows, F.lit(1))).cast("decimal(5,4)")


def magic_kind(content: Column) -> Column:
    """What a file is by its first bytes, whatever its name says."""
    head = F.hex(F.substring(content, 1, 8))
    return (
        F.when(head.startswith("25504446"), "pdf")
        .when(head.startswith("504B0304"), "zip")
        .when(head.startswith("D0CF11E0A1B11AE1"), "ole")
        .when(head.startswith("50415231"), "parquet")
        .when(head.startswith("1F8B"), "gzip")
        .when(head.startswith("89504E47"), "png")
        .when(head.startswith("FFD8FF"), "jpeg")
        .when(F.octet_length(content) == 0, "empty")
        .otherwise("text")
    )

"""Column predicates on found values: check sums, shapes and placeholders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilmark.functions.catalog import CRITICAL, PLACEHOLDER_WORDS, SECRET

_IPV4 = r"(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"
#: Shapes that look like phone numbers and are none: dates, clocks, postcodes, addresses, social security numbers, coordinates.
NO_PHONE = "|".join(
    [r"\d{4}-\d{2}-\d{2}", r"\d{4}\.\d{2}\.\d{2}", r"(?:[01]?\d|2[0-3])\.[0-5]\d\.[0-5]\d", r"\d{5}-\d{4}", _IPV4, r"\d{3}-\d{2}-\d{4}", r"\d{1,3}\.\d+\s+\d{1,3}\.\d+", r"\d+"]
)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_valid(value: Column) -> Column:
    """13 to 19 digits whose Luhn sum is a multiple of ten; other characters don't count."""
    d = digits(value)
    each = F.transform(F.filter(F.split(F.reverse(d), ""), lambda x: x != ""), lambda x, i: x.cast("int") * F.when(i % 2 == 0, 1).otherwise(2))
    total = F.aggregate(each, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x))
    return F.length(d).between(13, 19) & (total % 10 == 0)


def iban_valid(value: Column) -> Column:
    """15 to 34 ASCII letters and digits whose rearranged number leaves 1 when divided by 97."""
    v = F.upper(F.regexp_replace(value, "[^A-Za-z0-9]", ""))
    turned = F.concat(F.substring(v, 5, 40), F.substring(v, 1, 4))
    numbers = F.transform(F.filter(F.split(turned, ""), lambda c: c != ""), lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    rest = F.aggregate(numbers, F.lit(0), lambda r, n: (r * F.when(n > 9, 100).otherwise(10) + n) % 97)
    return F.length(v).between(15, 34) & (rest == 1)


def phone_plausible(value: Column) -> Column:
    t = F.trim(value)
    return ~t.rlike(f"^(?:{NO_PHONE})$") & F.length(digits(t)).between(8, 15) & (F.length(F.regexp_replace(t, r"[^.]", "")) < 3)


def jwt_plausible(value: Column) -> Column:
    """Three segments, the first of which is base64url (no padding) of a JSON object with a key alg."""
    parts = F.split(value, r"\.")
    head = F.translate(parts[0], "-_", "+/")
    padded = F.rpad(head, (F.ceil(F.length(head) / 4) * 4).cast("int"), "=")
    decoded = F.try_to_binary(padded, F.lit("base64"))
    keys = F.json_object_keys(F.when(F.is_valid_utf8(decoded.cast("string")), decoded.cast("string")))
    return (F.size(parts) == 3) & ~F.contains(parts[0], F.lit("=")) & F.coalesce(F.array_contains(keys, "alg"), F.lit(False))


def entropy_plausible(value: Column) -> Column:
    """No identifier, no bare path, and at least a digit, plus or equals sign; no entropy is computed."""
    identifier = value.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$")
    path = F.contains(value, F.lit("/")) & ~value.rlike("[+=]")
    return ~identifier & ~path & value.rlike("[0-9+=]")


def is_placeholder(value: Column) -> Column:
    return value.rlike(r"[<>]|\{\{|\$\{|%\(|\*\*\*\*|\.\.\.\.") | F.lower(value).rlike("|".join(PLACEHOLDER_WORDS))


def is_single_dollar(value: Column) -> Column:
    return value.rlike(r"^\$\d$")


def plausible(entity_type: Column, value: Column) -> Column:
    """Whether a finding of a type stands: each type has its own check, other secrets that they are no placeholder."""
    return (
        F.when(entity_type == "money", ~is_single_dollar(value))
        .when(entity_type == "phone", phone_plausible(value))
        .when(entity_type == "creditCardLike", luhn_valid(value))
        .when(entity_type == "iban", iban_valid(value))
        .when(entity_type == "jwt", jwt_plausible(value))
        .when(entity_type == "highEntropyString", entropy_plausible(value))
        .when(entity_type.isin(*SECRET), ~is_placeholder(value))
        .otherwise(True)
    )


def is_critical(entity_type: Column) -> Column:
    return entity_type.isin(*CRITICAL)


def is_secret(entity_type: Column) -> Column:
    return entity_type.isin(*SECRET)


def value_preview(value: Column, limit: int = 48) -> Column:
    return F.when(F.length(value) > limit, F.concat(F.left(value, F.lit(limit)), F.lit("…"))).otherwise(value)


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "required", 0).when(severity == "recommended", 1).otherwise(2)

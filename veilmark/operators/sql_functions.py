"""The scan as functions for SQL: `SELECT ... FROM docs, LATERAL detect_spans(docs.text)`, or `find_spans(docs.text)` as an array."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

from veilmark.functions.catalog import CRITICAL, PLACEHOLDER_WORDS, SEAL_TOKEN_INNER, SECRET, Rule
from veilmark.functions.checks import NO_PHONE
from veilmark.operators import spans as S


def plausible_sql(kind: str, value: str) -> str:
    """`checks.plausible` as SQL text over a type and a value."""
    q = S.quoted
    digits = f"regexp_replace({value}, '[^0-9]', '')"
    each = f"transform(filter(split(reverse({digits}), ''), x -> x != ''), (x, i) -> cast(x as int) * if(i % 2 = 0, 1, 2))"
    luhn = f"length({digits}) between 13 and 19 and aggregate({each}, 0, (s, x) -> s + if(x > 9, x - 9, x)) % 10 = 0"
    plain = f"upper(regexp_replace({value}, '[^A-Za-z0-9]', ''))"
    turned = f"concat(substring({plain}, 5, 40), substring({plain}, 1, 4))"
    numbers = f"transform(filter(split({turned}, ''), c -> c != ''), c -> if(rlike(c, '[0-9]'), ascii(c) - 48, ascii(c) - 55))"
    iban = f"length({plain}) between 15 and 34 and aggregate({numbers}, 0, (r, n) -> cast((r * if(n > 9, 100, 10) + n) % 97 as int)) = 1"
    phone = f"not rlike(trim({value}), {q(f'^(?:{NO_PHONE})$')}) and length({digits}) between 8 and 15 and length(regexp_replace(trim({value}), '[^.]', '')) < 3"
    head = f"split({value}, {q(chr(92) + '.')})[0]"
    padded = f"rpad(translate({head}, '-_', '+/'), cast(ceil(length({head}) / 4) * 4 as int), '=')"
    opened = f"cast(try_to_binary({padded}, 'base64') as string)"
    jwt = f"size(split({value}, {q(chr(92) + '.')})) = 3 and not contains({head}, '=') and coalesce(array_contains(json_object_keys(if(is_valid_utf8({opened}), {opened}, null)), 'alg'), false)"
    entropy = f"not rlike({value}, '^[A-Za-z_][A-Za-z0-9_]*$') and (not contains({value}, '/') or rlike({value}, '[+=]')) and rlike({value}, '[0-9+=]')"
    marks = q(r"[<>]|\{\{|\$\{|%\(|\*\*\*\*|\.\.\.\.")
    placeholder = f"rlike({value}, {marks}) or rlike(lower({value}), {q('|'.join(PLACEHOLDER_WORDS))})"
    dollar = q(r"^\$\d$")
    return (
        f"case when {kind} = 'money' then not rlike({value}, {dollar}) when {kind} = 'phone' then {phone} when {kind} = 'creditCardLike' then {luhn} when {kind} = 'iban' then {iban} "
        f"when {kind} = 'jwt' then {jwt} when {kind} = 'highEntropyString' then {entropy} when {kind} in ({', '.join(map(q, SECRET))}) then not ({placeholder}) else true end"
    )


def detect_sql(text: str, rules: list[Rule]) -> str:
    """SQL of a text's findings as an array: matches behind their guards, overlaps resolved, what is implausible or within a sealed value left out."""

    own = f"f.entity_type in ({', '.join(map(S.quoted, CRITICAL))}) and not rlike(f.value, {S.quoted(SEAL_TOKEN_INNER)})"
    free = f"size(both.tokens) = 0 or ({own}) or not exists(both.tokens, k -> f.`start` >= k.`start` and f.`end` <= k.`end`)"
    kept = f"filter({S._resolved('both.raw')}, f -> ({plausible_sql('f.entity_type', 'f.value')}) and ({free}))"
    found = S.let("both", f"named_struct('raw', {S.raw_spans('doc_text', rules)}, 'tokens', {S.raw_spans('doc_text', [S._SEAL_RULE])})", S._public(kept))
    return S.let("doc_text", f"coalesce({text}, '')", found)


def register(spark: SparkSession, enabled: Iterable[str] | None = None, disabled: Iterable[str] = (), table_name: str = "detect_spans", array_name: str = "find_spans") -> None:
    """Makes the scan two temporary functions of the session, built-in SQL alone.

    `find_spans(text)` gives an array of struct<start, end, entity_type, value, confidence, source, rule_ord>, which a
    select around it may list by `LATERAL inline_outer(...)` where `start` is not null; nothing is joined. (By an inner `inline`
    the optimizer would compute the scan a second time, as a filter on the array's size.) `detect_spans(text)` is the same
    as a table function; Spark plans a call for each row of a table as a join with the distinct texts, so for large
    tables take the first. A null text has no findings; a left join that keeps its row takes the function in a select
    of its own: `LEFT JOIN LATERAL (SELECT * FROM detect_spans(text)) ON true`.
    """
    fields = [("start", "INT"), ("end", "INT"), ("entity_type", "STRING"), ("value", "STRING"), ("confidence", "DOUBLE"), ("source", "STRING"), ("rule_ord", "INT")]
    array = f"ARRAY<STRUCT<{', '.join(f'`{n}`: {t}' for n, t in fields)}>>"
    table = ", ".join(f"`{n}` {t}" for n, t in fields)
    found = detect_sql("doc", S.select_rules(enabled, disabled))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {array_name}(doc STRING) RETURNS {array} RETURN {found}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {table_name}(doc STRING) RETURNS TABLE ({table}) RETURN SELECT f.* FROM inline({found}) f")

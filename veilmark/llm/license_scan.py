"""Operator 1: licence scan by ordered signature rules behind a keyword prefilter."""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate, groupby

import ahocorasick
from pyspark.sql import DataFrame

from veilmark.llm.common import map_texts, words_of
from veilmark.llm.license_rules import rules

_SCHEMA = (
    "doc_id {}, n_words bigint, "
    "detections array<struct<rule: string, label: string, priority: int, start_word: bigint, end_word: bigint>>"
)


@lru_cache(maxsize=1)
def _compiled() -> tuple:
    """The rules with compiled regexes, and the automaton from keyword to rule numbers; once a worker."""
    table, by_keyword = [], {}
    for n, (rule, label, priority, keyword, regex) in enumerate(rules()):
        table.append((rule, label, priority, re.compile(f"(?<= )(?:{regex})(?= )")))
        for literal in keyword.split("|"):
            by_keyword.setdefault(literal, []).append(n)
    automaton = ahocorasick.Automaton()
    for keyword, numbers in by_keyword.items():
        automaton.add_word(keyword, numbers)
    automaton.make_automaton()
    return table, automaton


def is_base(rule: str) -> bool:
    return rule.startswith("base:")


def _suppressed(found: list[tuple]) -> list[tuple]:
    """Drops a detection that lies within one of higher priority, or within an earlier one as long of its own.

    Base phrases neither suppress nor go. `found` holds (priority, start, end, rule number, rule, label).
    """
    kept = [x for x in found if is_base(x[4])]
    spans: list[tuple[int, int]] = []
    rest = sorted((x for x in found if not is_base(x[4])), key=lambda x: (-x[0], x[1], -x[2], x[3]))
    for _, level in groupby(rest, key=lambda x: x[0]):
        starts = [s for s, _ in spans]
        reach = list(accumulate((e for _, e in spans), max))
        own_end = -1
        for x in level:
            above = bisect_right(starts, x[1])
            if (above and reach[above - 1] >= x[2]) or own_end >= x[2]:
                continue
            own_end = x[2]
            kept.append(x)
            spans.append(x[1:3])
        spans.sort()
    return sorted(kept, key=lambda x: (x[1], x[2], x[3]))


def detect(text: str | None) -> tuple[int, list[dict]]:
    """Number of words of a text, and its detections by start word."""
    words = words_of(text).decode("utf-8", "surrogatepass")
    n_words = words.count(" ") + 1 if words else 0
    table, automaton = _compiled()
    numbers = {n for _, hit in automaton.iter(words) for n in hit}
    if not numbers:
        return n_words, []
    padded, found = f" {words} ", []
    for n in sorted(numbers):
        rule, label, priority, regex = table[n]
        place = 1 if regex.groups else 0  # of a tag only its identifier, as an expression may name several
        found += [(priority, *m.span(place), n, rule, label) for m in regex.finditer(padded)]
    out, at, word = [], 0, -1
    for priority, start, end, _, rule, label in _suppressed(found):
        word, at = word + padded.count(" ", at, start), start
        out.append({"rule": rule, "label": label, "priority": priority, "start_word": word, "end_word": word + padded.count(" ", start, end) + 1})
    return n_words, out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, n_words, detections in the order of the text.

    Texts are read whole, as lower-cased words; a null text is empty and has no words. The automaton finds
    the keywords of a text in one pass, and only the rules they gate run their regex. A detection inside the
    interval of one with higher priority goes; base phrases always stay. Repeated rows get a row each, other
    columns are not read. Nothing shuffles, so one hot source is as good as any.
    """
    id_type = dict(docs.dtypes)[id_col]

    def scan(ids: list, texts: list) -> dict:
        results = [detect(t) for t in texts]
        return {"doc_id": ids, "n_words": [n for n, _ in results], "detections": [d for _, d in results]}

    return map_texts(docs, scan, _SCHEMA.format(id_type), id_col, text_col)

"""Small tables with every awkward case, and brute-force versions of what the operators compute."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SMALL = "/root/testdata/sf0.001"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def docs(spark, rows, extra=""):
    """A documents table of (doc_id, text), with columns whose names operators use inside."""
    clash = "lang string, keep_id bigint, row_key string, node string, sha string, id string, class_id string, n_tokens string"
    return spark.createDataFrame([(i, t, "en", 9, "x", "x", "x", "x", "x", "x") for i, t in rows], f"doc_id bigint, text string, {clash}")


def grams(text, n=5):
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def near_classes(rows, threshold=0.8):
    """{doc: (class, links)} by comparing all pairs."""
    sets = [(i, grams(t)) for i, t in rows]
    parent, links = list(range(len(sets))), [0] * len(sets)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and len(a & b) >= threshold * len(a | b):
                links[i] += 1
                links[j] += 1
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, (doc, _) in enumerate(sets):
        groups.setdefault(find(i), []).append(doc)
    return {(doc, n): (min(groups[find(n)]), links[n]) for n, (doc, _) in enumerate(sets)}


def sentence(seed, n):
    """n words, different for every seed."""
    return " ".join(f"w{(seed * 7919 + i * 104729) % 999983}" for i in range(n))

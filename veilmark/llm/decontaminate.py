"""Operator 6: benchmark decontamination by pigeonhole edit matching."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import filter_texts, map_texts, words_of

#: Characters of test items in one index; a larger benchmark is matched in several passes.
_PASS_CHARS = 4_000_000
_BITMAP_BITS = 20
#: Bytes of a text looked at at once.
_SCAN_BYTES = 1 << 20
_INDEXES: dict[str, PieceIndex] = {}


def edit_search(bits: dict[str, int], length: int, text: str) -> tuple[int, int]:
    """The smallest edit distance between a pattern and any substring of `text`, and where that ends.

    Myers' bit-parallel scan: one column of the distance table is a pair of integers of `length` bits.
    """
    mask, high = (1 << length) - 1, 1 << (length - 1)
    plus, minus, score = mask, 0, length
    best, end = length, 0
    for i, c in enumerate(text):
        eq = bits.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = (minus | ~(horizontal | plus)) & mask
        down = plus & horizontal
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up = (up << 1) & mask
        plus = ((down << 1) | ~(vertical | up)) & mask
        minus = up & vertical
        if score < best:
            best, end = score, i + 1
    return best, end


def pieces(text: str, budget: int) -> list[tuple[int, str]]:
    """`budget` + 1 pieces (offset, piece) of nearly equal length; with at most `budget` edits one stays whole."""
    cuts = [len(text) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def error_budget(words: str, edit_rate: float, min_chars: int) -> int:
    """How many edits an item of joined words may differ by: a share of its characters, but at least its longest word, as far as
    that is an eighth of it. An item under `min_chars` characters must stand as it is."""
    if len(words) < min_chars:
        return 0
    return max(int(edit_rate * len(words)), min(max(map(len, words.split(" "))), len(words) // 8))


class PieceIndex:
    """The pieces of many items, found in a text's bytes: a bitmap of the pieces' first bytes rules out nearly
    every position at once, a dictionary and a comparison decide at the rest. Items under 8 bytes that must stand as they
    are would fill that bitmap: they are looked up by themselves, and only where a word starts."""

    def __init__(self, items: list[tuple[str, int]]) -> None:
        self.items, self.bits, self.by_head = items, [], {}
        #: By number of bytes, with the blank behind them: the bytes as a number, and whose they are.
        self.short: dict[int, dict[int, int]] = {}
        #: For every item the places where its pieces start, and its end: in characters and in bytes.
        self.cuts: list[list[tuple[int, int]]] = []
        cut = []
        for n, (text, budget) in enumerate(items):
            raw = text.encode()
            found = pieces(text, budget)
            self.cuts.append([(at, len(text[:at].encode())) for at, _ in found] + [(len(text), len(raw))])
            if not budget and len(raw) < 8:
                self.short.setdefault(len(raw) + 1, {})[int.from_bytes(raw + b" ", "little")] = n
                cut.append([])
            else:
                cut.append([piece.encode() for _, piece in found])
        self.short_heads = {width: np.array(list(known), np.uint64) for width, known in self.short.items()}
        self.width = min(8, min((len(piece) for found in cut for piece in found), default=8))
        for n, found in enumerate(cut):
            for q, piece in enumerate(found):
                head = int.from_bytes(piece[: self.width], "little")
                self.by_head.setdefault(head, {}).setdefault(piece, []).append((n, q))
            bits: dict[str, int] = {}
            for i, c in enumerate(items[n][0]):
                bits[c] = bits.get(c, 0) | 1 << i
            self.bits.append(bits)
        self.bitmap = np.zeros(1 << _BITMAP_BITS, bool)
        self.bitmap[self._slots(np.array(list(self.by_head), np.uint64))] = True

    def _slots(self, heads: np.ndarray) -> np.ndarray:
        return ((heads * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITMAP_BITS)).astype(np.int64)

    def starts(self, data: bytes) -> dict[int, set[int]]:
        """By item number, the bytes at which it would start for one of its pieces to stand where it does, as far as the item may be there."""
        found: dict[int, set[int]] = {}
        padded = data + b"\0" * 8
        mask = np.uint64((1 << 8 * self.width) - 1)
        for low in range(0, len(data), _SCAN_BYTES):
            count = min(_SCAN_BYTES, len(data) - low)
            heads = np.ndarray((count,), "<u8", padded, low, (1,)) & mask
            for i in np.flatnonzero(self.bitmap[self._slots(heads)]).tolist():
                for piece, at in self.by_head.get(int(heads[i]), {}).items():
                    if data.startswith(piece, low + i):
                        for n, q in at:
                            if self._may_hold(data, n, low + i, q):
                                found.setdefault(n, set()).add(low + i - self.cuts[n][q][1])
        return found

    def _may_hold(self, data: bytes, n: int, at: int, q: int) -> bool:
        """Whether the spans of pieces above piece `q`, which stands at byte `at`, stand around it as well, each within its own budget.

        An item is halved down to its pieces; a span of m pieces may differ by m - 1 edits. With no more than that in a
        span, one of its halves keeps its own budget too, so from every place that holds the item a chain of such spans
        leads down to a piece that stands as it is, and a piece whose chain breaks can be left out.
        """
        cuts, whole = self.cuts[n], self.bits[n]
        low, high, spans = 0, len(cuts) - 1, []
        while high - low > 1:
            spans.append((low, high))
            middle = (low + high) // 2
            low, high = (low, middle) if q < middle else (middle, high)
        for low, high in spans[:0:-1]:  # the whole item is left to the caller
            (a, first), (b, last), budget = cuts[low], cuts[high], high - low - 1
            start = at - cuts[q][1] + first
            window = data[max(0, start - 4 * budget) : start + last - first + 4 * budget].decode("utf-8", "ignore")
            mask = (1 << b - a) - 1
            if edit_search({c: whole.get(c, 0) >> a & mask for c in set(window)}, b - a, window)[0] > budget:
                return False
        return True

    def short_ends(self, data: bytes) -> dict[int, int]:
        """By item number, the byte at which an item under 8 bytes first ends as whole words."""
        found: dict[int, int] = {}
        padded = data + b" " + b"\0" * 8
        for low in range(0, len(data) if self.short else 0, _SCAN_BYTES):
            count = min(_SCAN_BYTES, len(data) - low)
            behind = np.flatnonzero(np.frombuffer(padded, np.uint8, count, low) == 32) + 1
            starts = np.insert(behind, 0, 0) if low == 0 else behind
            heads = np.ndarray((count + 1,), "<u8", padded, low, (1,))[starts]
            for width, known in self.short.items():
                part = heads & np.uint64((1 << 8 * width) - 1)
                hit = np.flatnonzero(np.isin(part, self.short_heads[width]))
                for head, at in zip(*np.unique(part[hit], return_index=True), strict=True):
                    found.setdefault(known[int(head)], low + int(starts[hit[at]]) + width - 1)
        return found

    def matches(self, data: bytes) -> list[tuple[int, int, int]]:
        """(item number, distance, end in characters) of the items that a text (words joined by spaces) holds."""
        out = [(n, 0, len(data[:end].decode())) for n, end in self.short_ends(data).items()]
        for n, places in self.starts(data).items():
            pattern, budget = self.items[n]
            raw = pattern.encode()
            if not budget:  # whole words only: a short item may be the end of another word
                at = min((p for p in places if data.startswith(raw, p) and data[p - 1 : p] in (b"", b" ") and data[p + len(raw) : p + len(raw) + 1] in (b"", b" ")), default=-1)
                if at >= 0:
                    out.append((n, 0, len(data[: at + len(raw)].decode())))
                continue
            exact = data.find(raw)
            if exact >= 0:
                out.append((n, 0, len(data[: exact + len(raw)].decode())))
                continue
            best, end, window = budget + 1, 0, None
            slack = 4 * budget  # bytes that so many characters take at most
            for start in [*sorted(places), math.inf]:
                if window and start - slack > window[1]:
                    low = max(0, window[0])
                    distance, at_end = edit_search(self.bits[n], len(pattern), data[low : window[1]].decode("utf-8", "ignore"))
                    if distance < best:
                        best, end = distance, len(data[:low].decode("utf-8", "ignore")) + at_end
                    window = None
                if start < math.inf:
                    window = (window[0] if window else start - slack, start + len(raw) + slack)
            if best <= budget:
                out.append((n, best, end))
        return out


def _index(name: str, items: list[tuple[str, int]]) -> PieceIndex:
    if name not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[name] = PieceIndex(items)
    return _INDEXES[name]


def _passes(benchmark: DataFrame, item_col: str, text_col: str, edit_rate: float, min_chars: int) -> Iterator[Broadcast]:
    """The items in broadcast passes of a bounded size: (name, [(words, budget)], [item ids of these words])."""
    length = F.length(F.coalesce(F.col(text_col), F.lit("")))
    total = benchmark.agg(F.coalesce(F.sum(length), F.lit(0))).first()[0]
    passes = max(1, -(-int(total) // _PASS_CHARS))
    numbered = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(item_col, text_col), F.lit(passes)).alias("pass"))
    for k in range(passes):
        by_words: dict[str, list] = {}
        for r in numbered.filter(F.col("pass") == k).toLocalIterator():
            words = words_of(r["text"]).decode()
            if words:
                by_words.setdefault(words, []).append(r["item"])
        items = [(w, error_budget(w, edit_rate, min_chars)) for w in by_words]
        yield benchmark.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, items, list(by_words.values())))


def contaminations(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", edit_rate: float = 0.05, min_chars: int = 20,
) -> DataFrame:
    """One row for each document and test item that it holds: doc_id, item_id, distance, end_char.

    Both texts are compared as lower-cased words joined by single spaces, whole. An item of L characters
    may differ by floor(edit_rate * L) edits, or by its longest word as far as that is at most L / 8: it is split into one
    piece more than that, an index finds every place of every piece in the document, and Myers' distance decides
    around each. distance is the smallest one, end_char where that match ends in the joined words.

    Items under `min_chars` characters match where they stand unchanged as whole words; items without any word, and
    null texts on either side, never match. Items
    with equal words give a row each, repeated documents too. The items are read in passes of a bounded size,
    each broadcast to the workers; documents do not shuffle.
    """
    id_type, item_type = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    found = None
    for sent in _passes(benchmark, item_col, item_text_col, edit_rate, min_chars):

        def scan(ids: list, texts: list, sent=sent) -> dict:
            name, items, names = sent.value
            index = _index(name, items)
            out: dict[str, list] = {"doc_id": [], "item_id": [], "distance": [], "end_char": []}
            for doc, text in zip(ids, texts, strict=True):
                for n, distance, end in index.matches(words_of(text)) if items else ():
                    for name in names[n]:
                        for column, value in zip(out.values(), (doc, name, distance, end), strict=True):
                            column.append(value)
            return out

        part = map_texts(docs, scan, f"doc_id {id_type}, item_id {item_type}, distance int, end_char bigint", id_col, text_col)
        found = part if found is None else found.unionByName(part)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", edit_rate: float = 0.05, min_chars: int = 20) -> DataFrame:
    """`docs` without the documents that hold a test item; all columns stay, nothing shuffles.

    Null and empty texts hold none and stay; each row is decided by its text alone, so repeated rows share their lot; an
    empty benchmark drops nothing.
    """
    for sent in _passes(benchmark, item_col, item_text_col, edit_rate, min_chars):

        def keep(texts: list, sent=sent) -> list:
            name, items, _ = sent.value
            index = _index(name, items)
            return [not index.matches(words_of(t)) for t in texts] if items else [True] * len(texts)

        docs = filter_texts(docs, keep, text_col)
    return docs

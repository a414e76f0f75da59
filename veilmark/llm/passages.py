"""Operator 10: substring dedup with compact windows: near-duplicate passages of different documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilmark.llm.common import BROADCAST_KEYS, bound_batches, map_texts, row_key, words_of, written
from veilmark.llm.components import connected_components
from veilmark.llm.shingles import gram_hashes, mix, word_hashes

#: Documents whose windows are compared in one task; larger groups are split into blocks and pairs of blocks.
_BLOCK = 256
#: The filter of shared signatures has at most so many bits (16 MiB).
_MOST_BITS = 27


def next_equal(values: np.ndarray) -> list[int]:
    """For every place the distance to the next equal value; 0 if there is none."""
    in_order = np.sort(values)
    if not (in_order[1:] == in_order[:-1]).any():
        return [0] * len(values)
    order = np.argsort(values, kind="stable")
    same = values[order[1:]] == values[order[:-1]]
    distance = np.zeros(len(values), np.int64)
    distance[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return distance.tolist()


def compact_windows(values: np.ndarray, least: int, grams: np.ndarray | None = None, repeats: list[int] | None = None) -> list[tuple[int, int, int, int, int]]:
    """(l, c, r, run start, run end) of the Cartesian tree over `values`; windows narrower than `least` are left out.

    Every run of at least `least` values inside [l, r) that holds c has its smallest value there. Of equal
    values the first counts. Where it starts a part that repeats itself with a period of up to `least`, that part is
    one node with two centres, the first and last place of its smallest value: what lies in [l, r) and holds
    that value holds one of them, or lies inside the part (run start to run end), which looks alike all along.
    """
    grams = values if grams is None else grams
    repeats = next_equal(grams) if repeats is None else repeats
    out, stack = [], [(0, len(values))] if len(values) >= least else []
    while stack:
        low, high = stack.pop()
        c = low + int(values[low:high].argmin())
        period = repeats[c]
        last = c
        if 0 < period <= least and c + period < high:
            differs = grams[c + period : high] != grams[c : high - period]
            stop = c + period + (int(differs.argmax()) if differs.any() else len(differs))
            last = c + (stop - 1 - c) // period * period
            out += [(low, c, high, c, stop), (low, last, high, c, stop)]
        else:
            out.append((low, c, high, c, c + 1))
        if c - low >= least:
            stack.append((low, c))
        if high - last > least:
            stack.append((last + 1, high))
    return out


def centres(values: np.ndarray, least: int, owner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(centres, order): the places that hold the smallest of some run of `least` values, and numbers that order the values.

    These are the nodes of the Cartesian tree that are at least `least` wide; the smallest of every run comes
    from minima over runs of doubled lengths, and only runs of one owner count. A number is a value with its
    place in the low bits, so of equal values the first is the smallest.
    """
    bits = np.uint64(max(24, len(values).bit_length()))
    order = values >> bits << bits | np.arange(len(values), dtype=np.uint64)
    low, width = order, 1
    while 2 * width <= least:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < least:
        low = np.minimum(low[: width - least], low[least - width :])
    if owner is not None:
        low = low[owner[: len(low)] == owner[least - 1 :]]
    low = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return low[np.concatenate(([True], low[1:] != low[:-1]))], order


def _node(order: np.ndarray, c: int) -> tuple[int, int]:
    """The node of the Cartesian tree that has its smallest number at c, searched in steps of growing width."""
    low, high, step = c, c + 1, 64
    while low > 0:
        smaller = np.flatnonzero(order[max(0, low - step) : low] < order[c])
        if len(smaller):
            low = max(0, low - step) + int(smaller[-1]) + 1
            break
        low, step = max(0, low - step), 2 * step
    step = 64
    while high < len(order):
        smaller = np.flatnonzero(order[high : high + step] < order[c])
        if len(smaller):
            return low, high + int(smaller[0])
        high, step = min(len(order), high + step), 2 * step
    return low, high


class Signatures:
    """The windows of one document, and the signatures under which windows meet.

    A window's signature is its hash function, its smallest gram and the `side` grams up to or from that one.
    A verbatim passage of `least` grams holds its smallest gram and, since 2 * side - 1 <= least, one of both
    sides whole; so both of its places share a signature for every hash function.
    """

    def __init__(self, n: int, least: int, side: int, hashes: int) -> None:
        self.n, self.least, self.side, self.hashes = n, least, side, hashes
        rng = np.random.default_rng(11)
        self.seeds = rng.integers(1, 2**63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = rng.integers(1, 2**63, dtype=np.uint64) | np.uint64(1)
        self.powers = self.inverses = np.empty(0, np.uint64)

    def _runs(self, grams: np.ndarray) -> np.ndarray:
        """A hash of every `side` neighbouring grams, from prefix sums over growing powers."""
        if len(self.powers) < len(grams):
            inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
            self.powers = np.multiply.accumulate(np.full(2 * len(grams), self.base))
            self.inverses = np.multiply.accumulate(np.full(2 * len(grams), inverse))
        sums = np.zeros(len(grams) + 1, np.uint64)
        np.add.accumulate(grams * self.powers[: len(grams)], out=sums[1:])
        count = len(grams) - self.side + 1
        return (sums[self.side :] - sums[:count]) * self.inverses[:count]

    def _windows(self, values: np.ndarray, grams: np.ndarray, owner: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """(centre, run start, run end) of every compact window; nodes around a gram that soon comes again are walked one by one."""
        c, order = centres(values, self.least, owner)
        windows = np.empty((len(c), 3), np.int64)
        windows[:, 0], windows[:, 1], windows[:, 2] = c, c, c + 1
        own, soon = grams[c], np.zeros(len(c), bool)
        for ahead in range(1, self.least + 1):
            soon |= grams[np.minimum(c + ahead, len(grams) - 1)] == own
        soon &= c < stop[owner[c]] - 1
        again = c[soon]
        if not len(again):
            return windows
        walked, inside = [], np.zeros(len(values), bool)
        for at in again[np.argsort(order[again])].tolist():
            if not inside[at]:
                text = slice(first[owner[at]], stop[owner[at]])
                low, high = (int(text.start) + place for place in _node(order[text], at - int(text.start)))
                inside[low:high] = True
                part = compact_windows(values[low:high], self.least, grams[low:high])
                walked += [(low + place, low + start, low + end) for _, place, _, start, end in part]
        return np.concatenate((windows[~inside[c]], np.array(walked, np.int64).reshape(-1, 3)))

    def of(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(grams, first, owner, signatures, windows) of many texts (hashes of their words) at once.

        grams are those of all texts in order, and first the place of each text's first one; texts too short
        for a passage have none. There is a signature for each side of each window, with the number of its text and the window's
        (centre, run start, run end) among the grams. Signatures of right sides are odd.
        """
        counts = np.array([max(0, len(w) - self.n + 1) for w in texts], np.int64)
        counts[counts < self.least] = 0
        stop = np.cumsum(counts)
        first = stop - counts
        if not counts.any():
            return np.empty(0, np.uint64), first, np.empty(0, np.int64), np.empty(0, np.uint64), np.empty((0, 3), np.int64)
        words = [w for w, k in zip(texts, counts.tolist(), strict=True) if k]
        whole = np.ones(sum(map(len, words)), bool)  # a gram across two texts is none
        ends = np.cumsum([len(w) for w in words])
        for back in range(1, self.n):
            whole[ends - back] = False
        grams = gram_hashes(np.concatenate(words), self.n)
        grams = grams[whole[: len(grams)]]
        owner = np.repeat(np.arange(len(texts)), counts)
        runs, found = self._runs(grams), [self._windows(grams * seed, grams, owner, first, stop) for seed in self.seeds]
        windows, seeds = np.concatenate(found), np.repeat(self.seeds, [len(w) for w in found])
        c, text = windows[:, 0], owner[windows[:, 0]]
        left, right = c - first[text] >= self.side - 1, c + self.side <= stop[text]
        keys = mix(np.concatenate((runs[c[left] - self.side + 1] ^ seeds[left], runs[c[right]] + seeds[right])))
        keys = keys >> np.uint64(1) << np.uint64(1) | (np.arange(len(keys)) >= left.sum()).astype(np.uint64)
        return grams, first, np.concatenate((text[left], text[right])), keys, np.concatenate((windows[left], windows[right]))


def _widest(match: np.ndarray, gains: np.ndarray, centre: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, start, end) of the widest run around the centre in every row of `match` that has one.

    It starts and ends with two neighbouring matches, has at least `least` places, and its gains sum to 0 or more.
    """
    gain = np.zeros((len(match), match.shape[1] + 1), np.float32)
    np.cumsum(gains, axis=1, out=gain[:, 1:])
    edge = match[:, centre:].copy()
    edge[:, 1:] &= match[:, centre:-1]
    ends = np.where(edge, gain[:, centre + 1 :], -np.inf)
    edge = match[:, : centre + 1].copy()
    edge[:, :-1] &= match[:, 1 : centre + 1]
    starts = np.where(edge, gain[:, : centre + 1], np.inf)
    every, width = np.arange(len(match)), ends.shape[1]

    def last_end(least_gain: np.ndarray) -> np.ndarray:
        return centre + width - (ends >= least_gain[:, None] - 1e-4)[:, ::-1].argmax(axis=1)

    def first_start(most_gain: np.ndarray) -> np.ndarray:
        return (starts <= most_gain[:, None] + 1e-4).argmax(axis=1)

    start, end = first_start(ends.max(axis=1)), last_end(starts.min(axis=1))
    # the widest run from the leftmost start, and that to the rightmost end, may be two runs: each must be long enough
    from_start, to_end = last_end(gain[every, start]), first_start(gain[every, end])
    start, end = np.where(from_start - start >= least, start, to_end), np.where(end - to_end >= least, end, from_start)
    long = np.flatnonzero(end - start >= least)
    return long, start[long], end[long]


def _chain(own: np.ndarray, other: np.ndarray, centre: int, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(match, drift, skipped) of a chain of matches that leaves the centre on both sides and may change its diagonal.

    Where the diagonal it is on ends, it goes on along the nearest one, up to `band` places off, that has two
    neighbouring matches there. drift is the matched place's distance in `other`, skipped the number of places
    of `other` between it and the match before it (seen from the centre).
    """
    n, width = own.shape
    padded = np.zeros((n, width + 2 * band), other.dtype)
    padded[:, band : band + width] = other
    on = np.empty((width, 2 * band + 1, n), bool)
    for s in range(2 * band + 1):
        on[:, s] = ((own == padded[:, s : s + width]) & (own != 0)).T
    match, drift, skipped = np.zeros((n, width), bool), np.zeros((n, width), np.int32), np.zeros((n, width), np.int32)
    match[:, centre] = on[centre, band]
    every, shifts = np.arange(n), np.arange(-band, band + 1)[:, None]
    for step in (1, -1):
        at, reached = np.zeros(n, np.int64), np.full(n, centre)
        for i in range(centre + step, width if step > 0 else -1, step):
            hit = on[i, at + band, every] & (step * (i + at - reached) > 0)
            lost = np.flatnonzero(~hit)
            if len(lost) and 0 <= i + step < width:
                found = on[i][:, lost] & on[i + step][:, lost] & (step * (i + shifts - reached[lost]) > 0)
                far = np.where(found, np.abs(shifts - at[lost]), 1 << 20)
                nearest = far.argmin(axis=0)
                turned = found[nearest, np.arange(len(lost))]
                at[lost[turned]] = nearest[turned] - band
                hit[lost[turned]] = True
            match[:, i] = hit
            drift[:, i] = at
            skipped[hit, i] = (step * (i + at - reached) - 1)[hit]
            reached = np.where(hit, i + at, reached)
    return match, drift, skipped


def aligned(own: np.ndarray, other: np.ndarray, centre: int, least: int, threshold: float, finer: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], band: int) -> tuple[np.ndarray, ...]:
    """Which rows of two matrices of grams share a passage around `centre`, and its bounds in each: (rows, start, end, other start, other end).

    A first comparison goes place by place; a run of L places with x mismatches has similarity (L - x) / (L + x).
    A second one goes along chains of diagonals, so that a passage goes on behind inserted and removed words: m matches
    with x places of the one and y of the other between them have similarity m / (m + x + y). The widest
    run around the centre is taken that starts and ends with two neighbouring matches, has at least `least` places in both,
    and reaches the threshold; a row that has one by each comparison is there twice. A match may be chance, as a gram is
    16 bits of a hash, and does occur in a group of many thousand pairs; so `finer(rows)` gives both sides of the
    candidate rows with more bits, and one match alone never widens a passage.
    """
    allowed = (1 - threshold) / (1 + threshold)  # mismatches a place
    there = own != 0
    match = (other == own) & there
    count = match.sum(axis=1)
    rows = np.flatnonzero((count >= least * (1 - allowed) - 1e-6) & match[:, centre])
    out = []
    if len(rows):
        x, y = finer(rows)
        same = match[rows] & (x == y)
        long, start, end = _widest(same, np.where(same, np.float32(allowed), np.float32(allowed - 1)), centre, least)
        out.append((rows[long], start, end, start, end))
    rows = np.flatnonzero(match[:, centre] & (count < np.maximum(there.sum(axis=1), (other != 0).sum(axis=1))))
    if len(rows):
        near, width = np.zeros((len(rows), own.shape[1]), bool), own.shape[1]
        left, right = own[rows], np.zeros((len(rows), width + 2 * band), other.dtype)
        right[:, band : band + width] = other[rows]
        for s in range(2 * band + 1):
            near |= left == right[:, s : s + width]
        near &= there[rows]
        off = near & ~match[rows]  # only two neighbouring matches lead to another diagonal
        rows = rows[(near.sum(axis=1) >= threshold * least - 1e-6) & (off[:, 1:] & off[:, :-1]).any(axis=1)]
    if len(rows):
        same, drift, skipped = _chain(*finer(rows), centre, band)
        bonus = np.float32((1 - threshold) / threshold)
        long, start, end = _widest(same, np.where(same, bonus - skipped, np.float32(-1)), centre, least)
        other_start, other_end = start + drift[long, start], end + drift[long, end - 1]
        both = other_end - other_start >= least
        out.append((rows[long[both]], *(c[both] for c in (start, end, other_start, other_end))))
    return tuple(map(np.concatenate, zip(*out, strict=True))) if out else (np.empty(0, np.int64),) * 5


#: Pairs of contexts that are compared at once.
_PAIRS = 4096


class _Comparison:
    """Contexts of many groups, and the pairs of them to compare; equal contexts of a group (and block) are one.

    Two windows with both sides in common meet twice: under the signature of their left sides and that of their right
    ones. Such a pair is compared under the left one only, which both windows have.
    """

    def __init__(self, reach: int, least: int, threshold: float, band: int, side: int) -> None:
        self.reach, self.least, self.threshold, self.band = reach, least, threshold, band
        low, width = reach - side + 1, 2 * reach + 1
        self.left_grams, self.left_more = slice(2 * low, 2 * reach + 2), slice(2 * width + low, 2 * width + reach + 1)
        self.clear()

    def clear(self) -> None:
        self.contexts: list[bytes] = []
        self.members: list[list[tuple]] = []
        self.sides: list[int] = []
        self.groups: list[tuple[np.ndarray, np.ndarray, bool]] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.size = 0

    def _left_side(self, context: bytes) -> bytes | None:
        """What is kept of the grams of a window's left side; None if the text starts inside it."""
        grams = context[self.left_grams]
        return grams + context[self.left_more] if grams[:2] != bytes(2) else None

    def add(self, rows: list[tuple]) -> None:
        """The rows of one group: all pairs of one block, or those between two blocks."""
        node = rows[0][4]
        if all(r[4] == node for r in rows):
            return
        x, y = rows[0][1], rows[0][2]
        sides: dict[bytes, int] = {}
        if rows[0][0] & 1:
            found = {self._left_side(c) for c in {r[10] for r in rows}}
            if len(found) == 1 and None not in found:
                return
            sides = {side: k for k, side in enumerate(found - {None})}
        ids: dict[tuple[bool, bytes], int] = {}
        for r in rows:
            key = (x != y and r[3] == y, r[10])
            if key not in ids:
                ids[key] = len(self.contexts)
                self.contexts.append(r[10])
                self.members.append([])
                self.sides.append(sides.get(self._left_side(r[10]), -1) if sides else -1)
            self.members[ids[key]].append(r)
        if x == y and len(ids) <= 4:  # most groups: their few pairs are listed at once
            own = list(ids.values())
            for k, i in enumerate(own):
                others = [j for j in own[k:] if self.sides[i] < 0 or self.sides[i] != self.sides[j]]
                self.left += [i] * len(others)
                self.right += others
            self.size += len(own) * len(own)
            return
        a = np.array([i for (second, _), i in ids.items() if not second], np.int64)
        b = a if x == y else np.array([i for (second, _), i in ids.items() if second], np.int64)
        self.groups.append((a, b, x == y))
        self.size += len(a) * len(b)

    def _pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs to compare, a bounded number at a time; pairs of a context with itself stand for its equal members."""
        for at in range(0, len(self.left), _PAIRS):
            yield np.array(self.left[at : at + _PAIRS], np.int64), np.array(self.right[at : at + _PAIRS], np.int64)
        left, right, size = [], [], 0
        sides = np.array(self.sides, np.int64)
        for a, b, one in self.groups:
            step = max(1, _PAIRS // max(1, len(b)))
            for at in range(0, len(a), step):
                part = a[at : at + step]
                first, second = np.repeat(part, len(b)), np.tile(b, len(part))
                keep = (sides[first] != sides[second]) | (sides[first] < 0)
                if one:
                    keep &= second >= first
                left.append(first[keep])
                right.append(second[keep])
                size += len(left[-1])
                if size >= _PAIRS:
                    yield np.concatenate(left), np.concatenate(right)
                    left, right, size = [], [], 0
        if size:
            yield np.concatenate(left), np.concatenate(right)

    def found(self) -> list[tuple]:
        """(node, start, end, doc, link node, link place) of every member that shares a passage; the comparison starts anew.

        Members that pairs connect have one link, the first of their places: a place stands inside the passages
        around it, so equal links are passages of one class whatever group they come from.
        """
        prints = np.frombuffer(b"".join(self.contexts), np.uint8).reshape(len(self.contexts), -1)
        width = prints.shape[1] // 3
        grams, more = np.ascontiguousarray(prints[:, : 2 * width]).view(np.uint16), prints[:, 2 * width :]

        def whole(contexts: np.ndarray) -> np.ndarray:
            return grams[contexts].astype(np.uint32) << np.uint32(8) | more[contexts]

        nodes, number = [{r[4] for r in m} for m in self.members], {}
        alone = np.array([len(n) == 1 for n in nodes])
        only = np.array([number.setdefault(next(iter(n)), len(number)) for n in nodes], np.int64)
        start, end = np.full(len(grams), 1 << 30), np.full(len(grams), -1)
        up = list(range(len(grams)))
        rank = np.empty(len(grams), np.int64)
        rank[sorted(range(len(grams)), key=self.contexts.__getitem__)] = np.arange(len(grams))

        def top(i: int) -> int:
            while up[i] != i:
                up[i] = i = up[up[i]]
            return i

        for a, b in self._pairs():
            apart = ~(alone[a] & alone[b] & (only[a] == only[b]))
            a, b = a[apart], b[apart]
            swap = rank[a] > rank[b]  # chains start from the one side: the same one in whatever order rows come
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            hit, *bounds = aligned(grams[a], grams[b], self.reach, self.least, self.threshold, lambda rows, a=a, b=b: (whole(a[rows]), whole(b[rows])), self.band)
            for own, s, e in ((a[hit], *bounds[:2]), (b[hit], *bounds[2:])):
                np.minimum.at(start, own, s)
                np.maximum.at(end, own, e)
            for x, y in zip(a[hit].tolist(), b[hit].tolist(), strict=True):
                x, y = top(x), top(y)
                up[max(x, y)] = min(x, y)
        out, links = [], {}
        for i in np.flatnonzero(end > 0).tolist():
            place = min((r[4], r[6]) for r in self.members[i])
            links[top(i)] = min(place, links.get(top(i), place))
        for i in np.flatnonzero(end > 0).tolist():
            for _, _, _, _, node, doc, centre, last, run_start, run_end, _ in self.members[i]:
                low, high = centre + int(start[i]) - self.reach, last + int(end[i]) - self.reach
                if min(high, run_end) - max(low, run_start) >= self.least:  # what repeats itself looks alike all along
                    low, high = min(low, run_start), max(high, run_end)
                out.append((node, low, high, doc, *links[top(i)]))
        self.clear()
        return out


def _verify(members: DataFrame, reach: int, least: int, threshold: float, band: int, side: int) -> DataFrame:
    """(node, start, end, doc, link_node, link_at) of verified passages, from groups (signature, x, y) read as a stream in that order."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        held: list[tuple] = []
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                for row in zip(*(c.to_pylist() for c in batch.slice(start, 2000).columns), strict=True):
                    if held and row[:3] != held[0][:3]:
                        yield held
                        held = []
                    held.append(row)
        if held:
            yield held

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        names = ["node", "start", "end", "doc", "link_node", "link_at"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n.endswith("node") else pa.int64()) for n, c in zip(names, zip(*set(out), strict=True), strict=True)], names)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = _Comparison(reach, least, threshold, band, side)
        for rows in groups(batches):
            work.add(rows)
            if work.size >= 8 * _PAIRS and (out := work.found()):
                yield _batch(out)
        if work.size and (out := work.found()):
            yield _batch(out)

    bound_batches(members.sparkSession)
    return members.mapInArrow(verify, "node string, start bigint, end bigint, doc bigint, link_node string, link_at bigint")


def _shared(signatures: DataFrame) -> tuple[np.ndarray, DataFrame]:
    """A bitmap of the signatures of at least two documents, and the table (signature, documents) of the crowded ones.

    The bitmap's size is bounded; a fuller one only lets more windows by.
    """
    counts = signatures.groupBy("signature").agg(F.count("*").alias("documents"))
    twice = written(counts.filter("documents > 1"))
    bits = min(_MOST_BITS, max(16, (twice.count() * 16).bit_length()))
    slot = F.shiftrightunsigned("signature", 64 - bits)
    words = twice.groupBy((slot / 64).cast("bigint").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(signature, {64 - bits}) % 64 as int))")).alias("bits"))
    bitmap = np.zeros(1 << bits - 6, np.uint64)
    for batch in words.toArrow().to_batches():
        bitmap[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)
    return bitmap, twice.filter(F.col("documents") > _BLOCK)


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, least_words: int = 50, threshold: float = 0.8,
    hashes: int = 3, side: int = 16,
) -> DataFrame:
    """One row for each passage of a document that another document has too: doc_id, start_word, end_word, n_words, class_id.

    Passages are runs of at least `least_words` lower-cased words (start included, end not) whose n-grams, in
    order, reach the Jaccard similarity `threshold` with a passage of another document, whether words between them are
    substituted, inserted or removed; passages of one document that overlap or touch are one row. Words that repeat with a short period count as repeated all along where enough of them are. class_id is the smallest
    doc_id of the passage's class: rows that share a passage are linked, and classes are the connected
    components, so no link between different texts is lost (two passages that touch in one document are one row, and link theirs).

    Equal word sequences are one text and take part once; then all their documents get its passages, and the
    whole text is one where there are several. Every hash function orders a text's n-grams, its Cartesian tree
    gives the compact windows, and windows of different documents meet under shared signatures (`Signatures`).
    A first pass counts signatures; a filter of those that two documents have lets only such windows through the
    second pass, which sends them with the grams around their centres (24 bits of each); windows of a document that look
    alike and lie close go as one. Groups above a fixed size are split into
    blocks and pairs of blocks, so no group is cut short and none grows beyond a task; pairs are compared there,
    never listed. A passage found verbatim needs one hash function; more of them catch passages with changed
    words, which must keep a side of `side` n-grams beside a shared smallest one.

    Null texts, and texts under `least_words` words, have no passages. Rows that repeat id and text count as one
    document. Documents with a null id are compared too; their rows have doc_id null.
    """
    least = least_words - n + 1
    if 2 * side - 1 > least:
        raise ValueError("a side must fit twice into the shortest passage")
    reach = least
    # the most words inserted at one place of a passage whose two sides are each too short
    band = max(1, int(2 * (least - 1) * (1 - threshold) / threshold + 1e-6) - 2 * (n - 1))
    tools = Signatures(n, least, side, hashes)
    id_type = dict(docs.dtypes)[id_col]

    def sequences(ids: list, texts: list) -> dict:
        out: dict[str, list] = {"doc_id": ids, "n_words": [], "low": [], "high": []}
        for w in word_hashes([words_of(t) for t in texts]):
            order = np.arange(1, len(w) + 1, dtype=np.uint64)
            out["n_words"].append(len(w))
            out["low"].append(int(mix(w + order * tools.base).sum(dtype=np.uint64).view(np.int64)) if len(w) else 0)
            out["high"].append(int(mix(w ^ (order * tools.seeds[0])).sum(dtype=np.uint64).view(np.int64)) if len(w) else 0)
        return out

    keyed = docs.select(F.struct(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key")).alias("id"), F.col(text_col).alias("text"))
    members = map_texts(keyed, sequences, f"doc_id struct<id: {id_type}, key: string>, n_words bigint, low bigint, high bigint", "id", "text")
    members = written(members.filter(F.col("n_words") >= least_words).select(F.col("doc_id.id").alias("doc_id"), F.col("doc_id.key").alias("row_key"), "n_words", "low", "high"))
    unique = members.dropDuplicates(["row_key"])
    classes = written(
        unique.groupBy("low", "high", "n_words").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("first"), F.count("*").alias("copies"))
        .select("low", "high", "n_words", "copies", F.col("first.doc_id").cast("bigint").alias("first_doc"), F.col("first.row_key").alias("node"))
    )
    several = classes.filter("copies > 1")
    others = written(unique.join(several.select("low", "high", "n_words", "node"), ["low", "high", "n_words"]).select("row_key", "node"))
    drop = others.filter("row_key != node").select("row_key")
    drop = F.broadcast(drop) if others.count() <= BROADCAST_KEYS else drop
    texts = docs.select(F.struct(F.col(id_col).cast("bigint").alias("doc"), row_key(id_col, text_col).alias("node")).alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.withColumn("row_key", F.col("id.node")).join(drop, "row_key", "left_anti").select("id", "text")

    def count(ids: list, texts: list) -> dict:
        _, _, owner, keys, _ = tools.of(list(word_hashes([words_of(t) for t in texts])))
        order = np.lexsort((owner, keys))
        keys, owner = keys[order], owner[order]
        again = (keys[1:] == keys[:-1]) & (owner[1:] == owner[:-1])  # once for each text
        return {"signature": keys[np.concatenate((np.ones(len(keys[:1]), bool), ~again))].view(np.int64)}

    bitmap, crowded = _shared(map_texts(texts, count, "signature bigint", "id", "text"))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def windows(ids: list, texts: list) -> dict:
        bitmap = shared.value
        shift = np.uint64(64 - (len(bitmap) * 64 - 1).bit_length())
        grams, first, owner, keys, found = tools.of(list(word_hashes([words_of(t) for t in texts])))
        slots = keys >> shift
        hit = np.flatnonzero((bitmap[(slots >> np.uint64(6)).astype(np.int64)] >> (slots & np.uint64(63))) & np.uint64(1))
        hit = hit[np.lexsort((found[hit, 0], keys[hit], owner[hit]))]
        keys, owner, found = keys[hit].view(np.int64), owner[hit], found[hit]
        # the grams of each text between `reach` zeros on both sides
        gap = np.zeros(len(grams) + reach * (len(texts) + 1), np.uint64)
        counts = np.diff(np.append(first, len(grams)))
        gap[np.arange(len(grams)) + reach * (1 + np.repeat(np.arange(len(texts)), counts))] = grams
        prints, more = (gap >> np.uint64(48)).astype(np.uint16), gap.astype(np.uint8)
        prints[(gap != 0) & (prints == 0)] = 1
        around = np.arange(2 * reach + 1)
        contexts, width = np.empty((len(keys), 3 * len(around)), np.uint8), 2 * len(around)
        for at in range(0, len(keys), 4096):
            place = (found[at : at + 4096, 0] + reach * owner[at : at + 4096])[:, None] + around
            contexts[at : at + 4096, :width] = prints[place].view(np.uint8)
            contexts[at : at + 4096, width:] = more[place]
        # windows of a document that look alike and lie close go as one
        new = np.ones(len(keys) + 1, bool)
        near = np.flatnonzero((keys[1:] == keys[:-1]) & (owner[1:] == owner[:-1]) & (np.diff(found[:, 0]) <= least)) + 1
        new[near] = (contexts[near] != contexts[near - 1]).any(axis=1)
        starts, lasts = np.flatnonzero(new[:-1]), np.flatnonzero(new[1:])
        text, contexts = owner[starts], np.ascontiguousarray(contexts[starts])
        offsets = np.arange(0, contexts.size + 1, contexts.shape[1], dtype=np.int32)
        return {
            "signature": keys[starts],
            "node": [ids[i]["node"] for i in text.tolist()],
            "doc": [ids[i]["doc"] for i in text.tolist()],
            "centre": found[starts, 0] - first[text],
            "last": found[lasts, 0] - first[text],
            "run_start": found[starts, 1] - first[text],
            "run_end": found[starts, 2] - first[text],
            "context": pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(contexts)]),
        }

    met = map_texts(texts, windows, "signature bigint, node string, doc bigint, centre bigint, last bigint, run_start bigint, run_end bigint, context binary", "id", "text")
    large = F.broadcast(crowded) if crowded.count() <= BROADCAST_KEYS else crowded
    placed = met.join(large, "signature", "left")
    blocks = F.ceil(F.coalesce("documents", F.lit(1)) / _BLOCK).cast("int")
    block = F.pmod(F.xxhash64("node"), blocks).cast("int")
    placed = placed.select("*", block.alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    placed = placed.select("signature", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "node", "doc", "centre", "last", "run_start", "run_end", "context")
    groups = placed.repartition("signature", "x", "y").sortWithinPartitions("signature", "x", "y")
    found = _verify(groups, reach, least, threshold, band, side)
    found = found.groupBy("node", "link_node", "link_at", "start", "end").agg(F.min("doc").alias("doc"))

    whole = several.select("node", F.lit(0).cast("bigint").alias("start"), (F.col("n_words") - n + 1).alias("end"), F.col("first_doc").alias("doc"))
    spans = found.unionByName(whole, allowMissingColumns=True)
    order = Window.partitionBy("node").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(reached.isNull() | (F.col("start") + 1 - n > reached), 1).otherwise(0))
    spans = spans.withColumn("island", F.concat_ws("/", "node", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    spans = written(spans.groupBy("node", "island", "link_node", "link_at").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("doc").alias("doc")))
    islands = spans.groupBy("node", "island").agg(F.min("start").alias("start_word"), (F.max("end") + n - 1).alias("end_word"), F.min("doc").alias("doc"))
    linked = spans.filter("link_node is not null").select("link_node", "link_at", "island")
    least_of = linked.groupBy("link_node", "link_at").agg(F.min("island").alias("b"))
    roots = connected_components(linked.join(least_of, ["link_node", "link_at"]).select(F.col("island").alias("a"), "b").distinct())
    islands = written(islands.join(roots.select(F.col("node").alias("island"), "root"), "island", "left").withColumn("root", F.coalesce("root", "island")))
    islands = islands.join(islands.groupBy("root").agg(F.min("doc").alias("class_id")), "root")
    holders = unique.select("row_key", "doc_id").join(others, "row_key", "left").select("doc_id", F.coalesce("node", "row_key").alias("node"))
    return holders.join(islands, "node").select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "class_id")

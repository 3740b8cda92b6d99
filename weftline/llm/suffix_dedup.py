"""Suffix-array dedup: removes every byte that lies in a string found elsewhere too.

A string of LENGTH bytes contains a k-gram of least hash (its anchor), and equal
strings have it at the same place. Documents are cut to their anchors' contexts (the
windows that an anchor answers for), those whose anchor occurs once are done with,
and equal contexts are counted and kept once. The contexts of an anchor are then
suffix-sorted, rightwards and leftwards: prefix polynomial hashes and binary search
give the common extension of any two, so a comparison in the mergesort costs the
logarithm of the length, and what the hashes found is verified byte by byte.

An anchor with more than GROUP different contexts is not sorted in a task: its
windows are counted by their digests, which spreads and pre-aggregates them.

The same sort also tells passages: strings of PASSAGE bytes (some 50 words of prose, less
than LENGTH) that stand in another document too. They are reported, not removed.

Matches never cross documents; strings are judged on the input. Defined results: a
null text is an empty one, with nothing removed; rows alike in id and text are
documents of their own and so copies of each other; null ids are kept; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import discard, join_one, materialise, modest, row_key, table, trimmed

LENGTH, GRAM = 400, 100
#: k-grams in a window: an anchor lies at most SPAN - 1 bytes behind its windows' starts.
SPAN = LENGTH - GRAM + 1
#: Length of the passages that are reported, and k-grams in one.
PASSAGE = 280
PASSAGE_SPAN = PASSAGE - GRAM + 1
#: Different contexts of an anchor that one task sorts, and contexts sorted together.
GROUP = 8192
#: Anchors with more contexts that are broadcast (16 bytes each); more of them are joined by a shuffle.
BROADCAST_ANCHORS = 1_000_000
#: Window starts of a long text that are handled at once.
SEGMENT = 1 << 19
PLACE = np.uint64((1 << 20) - 1)
BASE = 0x5851F42D4C957F2D


def _powers(of: int) -> np.ndarray:
    p = np.full(1 << 20, of, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


POWERS, INVERSE = _powers(BASE), _powers(pow(BASE, -1, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def _prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P[i]: polynomial hash of data[:i], modulo 2 to the 64."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * POWERS[: len(data)])])


def _least_in(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width keys."""
    n = len(keys)
    padded = np.concatenate([keys, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _answers(keys: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """place of each anchor of windows of so many grams, and the first and last start of the windows it answers for."""
    place = (_least_in(keys, span) & PLACE).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
    return place[first], first, np.append(first[1:], len(place)) - 1


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """place, start and end of its context, hash: of each anchor of a text. The context holds the windows and the passages that the anchor answers for.

    Where a segment ends, an anchor can have a context in both segments; no window is in both.
    """
    found = []
    for at in range(0, len(data) - PASSAGE + 1, SEGMENT):
        part = data[at : at + SEGMENT + LENGTH - 1]
        p = _prefix_hashes(part)
        grams = _mixed((p[GRAM:] - p[:-GRAM]) * INVERSE[: len(part) - GRAM + 1])
        keys = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
        ranges = [(*_answers(keys[: SEGMENT + PASSAGE_SPAN - 1], PASSAGE_SPAN), PASSAGE)]
        if len(part) >= LENGTH:
            ranges.append((*_answers(keys, SPAN), LENGTH))
        place = np.unique(np.concatenate([r[0] for r in ranges]))
        start, end = np.full(len(place), len(part)), np.zeros(len(place), np.int64)
        for own, first, last, length in ranges:
            k = np.searchsorted(place, own)
            start[k], end[k] = np.minimum(start[k], first), np.maximum(end[k], last + length)
        found.append((place + at, start + at, end + at, grams[place].view(np.int64)))
    if not found:
        return (np.empty(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [t or b"" for t in batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()).to_pylist()]


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else [], kind))


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            each = [anchors(np.frombuffer(t, np.uint8)) for t in _texts(batch, "_text")]
            place, start, end, h = zip(*each, strict=True) if each else ([],) * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(list(place), pa.int32()), _lists(list(start), pa.int32()), _lists(list(end), pa.int32()), _lists(list(h), pa.int64())], ["_key", "place", "start", "end", "h"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (_key, alike, _text, found: array of place, start, end, h): a row for each anchor with its context."""
    names = ["_key", "alike", "place", "start", "end", "h", "g", "context"]
    for whole in batches:
        for at in range(0, whole.num_rows, 200):
            batch = whole.slice(at, 200)
            out: list[list] = [[] for _ in names]
            for key, alike, text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _texts(batch, "_text"), batch.column(3).to_pylist(), strict=True):
                for x in found:
                    context = text[x["start"] : x["end"]]
                    g = xxhash.xxh3_128_digest(b"%d %d " % (x["h"], x["place"] - x["start"]) + context)
                    for col, v in zip(out, (key, alike, x["place"], x["start"], x["end"], x["h"], g, context), strict=True):
                        col.append(v)
            kinds = [pa.binary(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names)


class Sorted:
    """Contexts laid over each other at their anchors, grouped by anchor, with prefix hashes by column."""

    WIDTH = SPAN - 1 + LENGTH

    def __init__(self, group: np.ndarray, behind: np.ndarray, contexts: list[bytes], owners: tuple[np.ndarray, np.ndarray] | None = None):
        """behind: bytes of each context before its anchor; owners: least and greatest number of the documents that have it (by default each its own)."""
        self.n, self.group = len(contexts), group
        self.least, self.most = owners or (np.arange(self.n), np.arange(self.n))
        size = np.array([len(c) for c in contexts])
        self.left, self.right = behind, size - behind
        self.bytes = np.zeros((self.n, self.WIDTH), np.uint8)
        rows = np.repeat(np.arange(self.n), size)
        cols = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(SPAN - 1 - behind, size)
        self.bytes[rows, cols] = np.frombuffer(b"".join(contexts), np.uint8)
        self.hashes = np.zeros((self.n, self.WIDTH + 1), np.uint64)
        np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * POWERS[: self.WIDTH], axis=1, out=self.hashes[:, 1:])

    def common(self, i: np.ndarray, j: np.ndarray, rightwards: bool) -> np.ndarray:
        """Length of the common extension of contexts i and j from their anchor."""
        low = np.zeros(len(i), np.int64)
        high = np.minimum(self.right[i], self.right[j]) if rightwards else np.minimum(self.left[i], self.left[j])
        here_i, here_j = self.hashes[i, SPAN - 1], self.hashes[j, SPAN - 1]
        while (low < high).any():
            mid = (low + high + 1) // 2
            col = SPAN - 1 + mid if rightwards else SPAN - 1 - mid
            same = self.hashes[i, col] - here_i == self.hashes[j, col] - here_j
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, i: np.ndarray, j: np.ndarray, rightwards: bool) -> np.ndarray:
        n = self.common(i, j, rightwards)
        size = self.right if rightwards else self.left
        col = np.clip(SPAN - 1 + n if rightwards else SPAN - 2 - n, 0, self.WIDTH - 1)
        inside = (n < size[i]) & (n < size[j])
        return np.where(inside, self.bytes[i, col] < self.bytes[j, col], size[i] < size[j])

    def sort(self, rightwards: bool) -> tuple[np.ndarray, np.ndarray]:
        """Order of the contexts within their groups, and the common extension of each with the one before it (-1: another group).

        A mergesort of all groups at once: an element's place in the merged run is its
        own place plus the number of elements of the other run that go before it.
        """
        order = np.arange(self.n)
        begins = np.concatenate([[True], self.group[1:] != self.group[:-1]])
        start = np.flatnonzero(begins)[np.cumsum(begins) - 1]
        end = np.append(np.flatnonzero(begins)[1:], self.n)[np.cumsum(begins) - 1]
        width, most = 1, int((end - start).max())
        while width < most:
            at = np.flatnonzero(end - start > width)
            own = at - start[at]
            run = own // width
            low = np.minimum(start[at] + (run ^ 1) * width, end[at])
            high = np.minimum(low + width, end[at])
            base, x, odd = low.copy(), order[at], run % 2 == 1
            while (open_ := low < high).any():
                mid = (low + high) // 2
                y = order[np.minimum(mid, self.n - 1)]
                before = np.where(odd, ~self.less(x, y, rightwards), self.less(y, x, rightwards))
                low, high = np.where(open_ & before, mid + 1, low), np.where(open_ & ~before, mid, high)
            to = start[at] + (run & ~1) * width + own % width + (low - base)
            new = order.copy()
            new[to] = x
            order, width = new, width * 2
        extension = np.full(self.n, -1)
        inner = np.flatnonzero(~begins)
        extension[inner] = self.common(order[inner - 1], order[inner], rightwards)
        return order, extension

    def repeated(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Least and greatest distance from a repeated window's start to the anchor, of each context (-1, -1: none); the same of passages of other documents."""
        orders = (*self.sort(True), *self.sort(False))
        return *self._twins(orders, LENGTH, False), *self._twins(orders, PASSAGE, True)

    def _twins(self, orders: tuple, length: int, other: bool) -> tuple[np.ndarray, np.ndarray]:
        """other: only classes of contexts that belong to several documents count."""
        by_right, to_right, by_left, to_left = orders
        low, high = np.full(self.n, -1), np.full(self.n, -1)
        mate_low, mate_high = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        right_class, left_class = np.empty(self.n, np.int64), np.empty(self.n, np.int64)
        for d in range(length - GRAM + 1):
            right_class[by_right] = np.cumsum(to_right < length - d)
            left_class[by_left] = np.cumsum(to_left < d)
            some = np.flatnonzero((np.bincount(right_class, minlength=self.n + 1)[right_class] > 1) & (np.bincount(left_class, minlength=self.n + 1)[left_class] > 1))
            if not len(some):
                continue
            both = right_class[some] * (self.n + 1) + left_class[some]
            order = np.argsort(both, kind="stable")
            some, both = some[order], both[order]
            twin = both[1:] == both[:-1]
            if other:
                begin = np.flatnonzero(np.concatenate([[True], ~twin]))
                several = np.minimum.reduceat(self.least[some], begin) != np.maximum.reduceat(self.most[some], begin)
                twin &= np.repeat(several, np.diff(np.append(begin, len(some))))[1:]
            for x, mate in ((some[1:][twin], some[:-1][twin]), (some[:-1][twin], some[1:][twin])):
                new = low[x] < 0
                low[x[new]], mate_low[x[new]] = d, mate[new]
                high[x], mate_high[x] = d, mate
        for d, mate in ((low, mate_low), (high, mate_high)):
            found = np.flatnonzero(low >= 0)
            for x in found[self._differ(found, mate[found], d[found], length)].tolist():
                low[x], high[x] = self._by_bytes(x, length, other)
        return low, high

    def _differ(self, i: np.ndarray, j: np.ndarray, d: np.ndarray, length: int, at_once: int = 2000) -> np.ndarray:
        """Whether the strings of i and j that start d bytes before the anchor differ in a byte."""
        out = np.zeros(len(i), bool)
        for k in range(0, len(i), at_once):
            cols = (SPAN - 1 - d[k : k + at_once])[:, None] + np.arange(length)
            out[k : k + at_once] = (self.bytes[i[k : k + at_once, None], cols] != self.bytes[j[k : k + at_once, None], cols]).any(axis=1)
        return out

    def _by_bytes(self, x: int, length: int, other: bool) -> tuple[int, int]:
        """As _twins() for one context, without hashes: for a collision."""
        others = np.flatnonzero(self.group == self.group[x])
        others = others[others != x]
        if other:
            others = others[(self.least[others] != self.least[x]) | (self.most[others] != self.most[x]) | (self.least[x] != self.most[x])]
        hits = []
        for d in range(length - GRAM + 1):
            if self.left[x] >= d and self.right[x] >= length - d:
                mates = others[(self.left[others] >= d) & (self.right[others] >= length - d)]
                cols = slice(SPAN - 1 - d, SPAN - 1 - d + length)
                if len(mates) and (self.bytes[mates, cols] == self.bytes[x, cols]).all(axis=1).any():
                    hits.append(d)
        return (hits[0], hits[-1]) if hits else (-1, -1)


JUDGED = "g binary, low int, high int, near int, far int"
WAYS = ["h", "g", "behind", "context", "least", "most"]


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (WAYS) in the order of h: g, low, high, near, far of the contexts with a repeated window (low, high) or passage (near, far)."""
    names = [c.split()[0] for c in JUDGED.split(", ")]
    kinds = [pa.binary(), *[pa.int32()] * 4]

    def done(rows: list[tuple]) -> pa.RecordBatch:
        times = Counter(r[0] for r in rows)
        rows = [r for r in rows if times[r[0]] > 1]
        if not rows:
            return pa.RecordBatch.from_arrays([pa.array([], kind) for kind in kinds], names)
        h, g, behind, contexts, least, most = zip(*rows, strict=True)
        told = Sorted(np.array(h), np.array(behind, np.int64), list(contexts), (np.array(least), np.array(most))).repeated()
        hit = np.flatnonzero((told[0] >= 0) | (told[2] >= 0))
        return pa.RecordBatch.from_arrays([pa.array([g[i] for i in hit], pa.binary()), *(pa.array(x[hit], pa.int32(), mask=x[hit] < 0) for x in told)], names)

    held: list[tuple] = []
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            held += zip(*(batch.column(batch.schema.get_field_index(c)).slice(at, 1000).to_pylist() for c in WAYS), strict=True)
            if len(held) >= GROUP // 2:
                cut = next((i for i in range(len(held) - 1, 0, -1) if held[i][0] != held[i - 1][0]), 0)
                if cut:
                    yield done(held[:cut])
                    held = held[cut:]
    if held:
        yield done(held)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window and passage around the anchor of contexts (WAYS): g, d, size, digest, least, most."""
    for batch in batches:
        for h, g, behind, context, least, most in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in WAYS), strict=True):
            at = [(size, i) for size in (LENGTH, PASSAGE) for i in range(max(0, behind + GRAM - size), min(behind, len(context) - size) + 1)]
            digests = [xxhash.xxh3_128_digest(b"%d %d %d " % (size, h, behind - i) + context[i : i + size]) for size, i in at]
            cols = [pa.array([g] * len(at), pa.binary()), pa.array([behind - i for _, i in at], pa.int32()), pa.array([size for size, _ in at], pa.int32()), pa.array(digests, pa.binary()), pa.array([least] * len(at), pa.int64()), pa.array([most] * len(at), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["g", "d", "size", "w", "least", "most"])


def _merged(found: list[dict] | None) -> list[list[int]]:
    out: list[list[int]] = []
    for x in sorted((c["s"], c["e"]) for c in found or [] if c["s"] is not None):
        if out and x[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x[1])
        else:
            out.append([*x])
    return out


MADE = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans string, n_shared bigint, shared string"


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch, rows = whole.slice(at, 1000), []
            for text, cuts, passages in zip(_texts(batch, "_text"), *(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("cuts", "passages")), strict=True):
                merged, shared = _merged(cuts), _merged(passages)
                digest, end = hashlib.sha256(), 0
                for s, e in merged:
                    digest.update(text[end:s])
                    end = e
                digest.update(text[end:])
                told = [",".join(f"{s}:{e}" for s, e in x) for x in (merged, shared)]
                rows.append((len(text), sum(e - s for s, e in merged), len(merged), digest.hexdigest(), told[0], sum(e - s for s, e in shared), told[1]))
            kinds = {"bigint": pa.int64(), "string": pa.string()}
            cols = [pa.array([r[k] for r in rows], kinds[c.split()[1]]) for k, c in enumerate(MADE.split(", "))]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("_id")), *cols], ["_id", *(c.split()[0] for c in MADE.split(", "))])


def repeated_spans(own: DataFrame) -> DataFrame:
    """_key, cuts, passages (arrays of s, e; not merged, null ones among them) of documents own (_key, _text) that have a repeated string or a passage of another document."""
    found = materialise(own.select("_key", "_text").mapInArrow(trimmed(_anchored), "_key binary, place array<int>, start array<int>, end array<int>, h array<bigint>").where(F.size("h") > 0), "anchors")
    twice = found.select(F.explode("h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    total = materialise(twice, "twice")
    rows = total.agg(F.sum("c")).first()[0] or 0
    each = found.select("_key", F.inline(F.arrays_zip("place", "start", "end", "h")))
    left = join_one(each, total, "h", "c", rows)
    # Rows alike in id and text have one key, and each anchor once a row.
    by_doc = left.groupBy("_key").agg(F.collect_set(F.struct("place", "start", "end", "h")).alias("found"), F.count(F.lit(1)).alias("n")).select("_key", (F.col("n") > F.size("found")).alias("alike"), "found")
    # Written before the texts are moved, so the files of the one shuffle are gone when those of the other are made.
    by_doc = materialise(by_doc, "found")
    discard(found, total)
    met = own.join(by_doc, "_key").select("_key", "alike", "_text", "found")
    cut = materialise(met.mapInArrow(trimmed(_contexts), "_key binary, alike boolean, place int, start int, end int, h bigint, g binary, context binary"), "contexts")
    discard(by_doc)

    # The number of the document; two numbers where there are several of it.
    owner = F.xxhash64("_key")
    first, last = (F.when(F.col("alike"), f(owner, F.bitwise_not(owner))).otherwise(owner) for f in (F.least, F.greatest))
    alike = cut.groupBy("g").agg(F.count(F.lit(1)).alias("c"), F.first("h").alias("h"), F.first(F.col("place") - F.col("start")).alias("behind"), F.first("context").alias("context"), F.min(first).alias("least"), F.max(last).alias("most"))
    kinds = materialise(alike, "kinds")
    # Anchors with too many contexts for a task are few; where there are none, no context is moved for them.
    crowded = materialise(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > GROUP), "crowded")
    n_crowded = crowded.count()
    near = F.broadcast(crowded) if n_crowded <= BROADCAST_ANCHORS else crowded
    small = kinds.join(near, "h", "left_anti") if n_crowded else kinds
    judged = small.select(WAYS).repartition("h").sortWithinPartitions("h").mapInArrow(trimmed(_sorted_groups), JUDGED)
    if n_crowded:
        windows = materialise(kinds.join(near, "h").select(WAYS).mapInArrow(trimmed(_windows), "g binary, d int, size int, w binary, least bigint, most bigint"), "windows")
        again = windows.groupBy("w").agg(F.count(F.lit(1)).alias("c"), F.min("least").alias("l"), F.max("most").alias("m")).where(F.col("c") > 1)
        hit = join_one(windows, materialise(again, "again"), "w", "c", windows.count())
        wide, narrow = F.when(F.col("size") == LENGTH, F.col("d")), F.when((F.col("size") == PASSAGE) & (F.col("l") != F.col("m")), F.col("d"))
        judged = judged.unionByName(hit.groupBy("g").agg(F.min(wide).alias("low"), F.max(wide).alias("high"), F.min(narrow).alias("near"), F.max(narrow).alias("far")))
    # All strings of a context that occurs twice are repeated. Those of one context overlap each other, so together they are one span.
    spans = kinds.select("g", "c", (F.col("least") != F.col("most")).alias("several")).join(judged, "g", "left").where("c > 1 or low is not null or near is not null")
    here = join_one(cut.drop("context", "h", "alike"), materialise(spans, "spans"), "g", "c", cut.count())
    all_wide = (F.col("c") > 1) & (F.col("end") - F.col("start") >= LENGTH)

    def span(whole: Column, low: str, high: str, length: int) -> Column:
        s, e = F.col("place") - F.col(high), F.col("place") - F.col(low) + length
        return F.struct(F.when(whole, F.col("start")).otherwise(s).alias("s"), F.when(whole, F.col("end")).otherwise(e).alias("e"))

    spans = here.select("_key", span(all_wide, "low", "high", LENGTH).alias("cut"), span(F.col("several"), "near", "far", PASSAGE).alias("passage"))
    return spans.groupBy("_key").agg(F.collect_set("cut").alias("cuts"), F.collect_set("passage").alias("passages"))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, n_bytes, n_removed, n_spans, kept_sha256, spans (start:end of removed runs, bytes), n_shared, shared (bytes, and runs of them, in passages of PASSAGE bytes that another document has too)."""
    modest(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.unhex(row_key(id_col, text_col)).alias("_key"), F.col(text_col).alias("_text"))
    out = own.join(repeated_spans(own), "_key", "left").select("_id", "_text", "cuts", "passages").mapInArrow(trimmed(_finish), f"_id bigint, {MADE}")
    return out.withColumnRenamed("_id", id_col)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS t FROM documents),
w AS (SELECT r, i, md5(substr(t, 2 * i + 1, 800)) AS h FROM (SELECT r, t, unnest(range(0, length(t) // 2 - 399)) AS i FROM d WHERE length(t) >= 800)),
k AS (SELECT r, i FROM w JOIN (SELECT h FROM w GROUP BY h HAVING count(*) > 1) USING (h)),
g AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) > 400 AS apart FROM k),
n AS (SELECT r, i, sum(CASE WHEN apart IS NULL OR apart THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS span FROM g),
s AS (SELECT r, min(i) AS a, max(i) + 400 AS b FROM n GROUP BY r, span),
m AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(a || ':' || b, ',' ORDER BY a) AS spans, list(a ORDER BY a) AS sa, list(b ORDER BY a) AS sb FROM s GROUP BY r),
c AS (SELECT d.r, string_agg(substr(t, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS kept FROM d JOIN m USING (r), LATERAL (SELECT unnest(list_concat([0], sb)) AS x, unnest(list_append(sa, length(t) // 2)) AS y) u GROUP BY d.r),
w2 AS (SELECT r, i, md5(substr(t, 2 * i + 1, 560)) AS h FROM (SELECT r, t, unnest(range(0, length(t) // 2 - 279)) AS i FROM d WHERE length(t) >= 560)),
k2 AS (SELECT r, i FROM w2 JOIN (SELECT h FROM w2 GROUP BY h HAVING min(r) <> max(r)) USING (h)),
g2 AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) > 280 AS apart FROM k2),
n2 AS (SELECT r, i, sum(CASE WHEN apart IS NULL OR apart THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS span FROM g2),
p AS (SELECT r, sum(b - a) AS n_shared, string_agg(a || ':' || b, ',' ORDER BY a) AS shared FROM (SELECT r, min(i) AS a, max(i) + 280 AS b FROM n2 GROUP BY r, span) GROUP BY r)
SELECT doc_id, CAST(length(t) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, t))) AS kept_sha256, coalesce(spans, '') AS spans, CAST(coalesce(n_shared, 0) AS BIGINT) AS n_shared, coalesce(shared, '') AS shared FROM d LEFT JOIN m USING (r) LEFT JOIN c USING (r) LEFT JOIN p USING (r)
"""

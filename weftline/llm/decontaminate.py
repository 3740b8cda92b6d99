"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item that share a token seed are compared: the longest
non-overlapping matches are marked again and again, found by running Karp-Rabin
hashes, until none of MIN_TILE tokens is left. The tiles' share of
the item's tokens is its coverage, whatever order its parts stand in; at COVERAGE or
more the document is contaminated by the item.

Tokens are words, A-Z lower-cased. The benchmark is a stated query set: it is held by
the workers in blocks of at most BLOCK_TOKENS tokens, each block against all rows in
one pass without a shuffle. A worker holds one block at a time.

Defined results: null and empty texts, of documents and of items, match nothing; an
item of fewer words than a seed is sought as a whole; rows and items that are alike
are each reported; null ids are reported as null; empty tables give no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import materialise, modest, table, trimmed

SEED, MIN_TILE, COVERAGE = 5, 4, 0.5
BLOCK_TOKENS = 2_000_000
K = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(K), -1, 1 << 64))


def words_of(text: str | bytes | None) -> list[bytes]:
    """bytes.lower and bytes.split treat ASCII alone, as the words are defined."""
    if isinstance(text, str):
        text = text.encode("utf-8", "surrogatepass")
    return (text or b"").lower().split()


def _hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n tokens, a seed's few."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = h * K + ids[k : k + m]
    return h


class Rolled:
    """Prefix hashes of a token sequence: the running Karp-Rabin hash of any run of tokens is a difference, whatever its length."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        self.back = np.full(n + 1, INVERSE, np.uint64)
        power = np.full(n + 1, K, np.uint64)
        self.back[0] = power[0] = 1
        self.back, power = np.cumprod(self.back, dtype=np.uint64), np.cumprod(power, dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ids * power[:n], dtype=np.uint64)])

    def of(self, at: np.ndarray, n: int) -> np.ndarray:
        return (self.sums[at + n] - self.sums[at]) * self.back[at]


def tiles(doc: np.ndarray, item: np.ndarray, least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """(place in the document, place in the item, tokens) of the greedy tiles; 0 in doc matches nothing.

    The longest match of a round is found by halving: where a run of n free tokens
    matches, one of fewer does. Hashes only propose; tokens are compared before a mark.
    """
    doc, item = doc.astype(np.uint64), item.astype(np.uint64)
    least = min(least, max(1, len(item)))
    free_doc, free_item = doc != 0, np.ones(len(item), bool)
    of_doc, of_item = Rolled(doc), Rolled(item)

    def met(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places and hashes of the free runs of n tokens that hash alike on both sides."""
        d, p = _free_runs(free_doc, n), _free_runs(free_item, n)
        h, g = of_doc.of(d, n), of_item.of(p, n)
        both = np.intersect1d(h, g)
        x, y = np.isin(h, both), np.isin(g, both)
        return d[x], h[x], p[y], g[y]

    found, most = [], min(_longest_run(free_doc), len(item))
    while most >= least:
        low, high = least - 1, most
        while low < high:
            mid = (low + high + 1) // 2
            if len(met(mid)[0]):
                low = mid
            else:
                high = mid - 1
        n = low
        if n < least:
            break
        d_at, d_hash, p_at, p_hash = met(n)
        waiting: dict[int, list[int]] = {}
        for p, h in zip(p_at[::-1].tolist(), p_hash[::-1].tolist(), strict=True):
            waiting.setdefault(h, []).append(p)
        end = 0
        for d, h in zip(d_at.tolist(), d_hash.tolist(), strict=True):
            if d < end:
                continue
            # Places of the item in their order, from the end of the list; one that is taken stays so.
            at, passed = waiting[h], []
            while at:
                p = at.pop()
                if not free_item[p : p + n].all():
                    continue
                if (doc[d : d + n] == item[p : p + n]).all():
                    free_doc[d : d + n] = False
                    free_item[p : p + n] = False
                    found.append((d, p, n))
                    end = d + n
                    break
                passed.append(p)  # another run of the same hash
            at.extend(reversed(passed))
        most = min(n - 1, _longest_run(free_doc), _longest_run(free_item))
    return found


def _free_runs(free: np.ndarray, length: int) -> np.ndarray:
    """Places from which so many tokens are free."""
    before = np.concatenate([[0], np.cumsum(free)])
    return np.flatnonzero(before[length:] - before[:-length] == length)


def _longest_run(free: np.ndarray) -> int:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], free.astype(np.int8), [0]])))
    return int((edges[1::2] - edges[::2]).max()) if len(edges) else 0


class Block:
    """A block of items: token ids, and the items of each seed."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], seed: int):
        self.vocab: dict[bytes, int] = {}
        self.ids = [i for i, _ in items]
        self.items = [np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], np.uint64) for _, words in items]
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in {min(seed, len(x)) for x in self.items if len(x)}:
            pairs = [(int(h), k) for k, x in enumerate(self.items) if min(seed, len(x)) == n for h in set(_hashes(x, n).tolist())]
            pairs.sort()
            self.seeds[n] = np.array([h for h, _ in pairs], np.uint64), np.array([k for _, k in pairs])

    def candidates(self, ids: np.ndarray) -> list[int]:
        """Items that share a seed with a document."""
        out: set[int] = set()
        known = np.concatenate([[0], np.cumsum(ids != 0)])
        for n, (hashes, who) in self.seeds.items():
            if len(ids) < n:
                continue
            at = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(at):
                continue
            h = np.zeros(len(at), np.uint64)
            for k in range(n):
                h = h * K + ids[at + k]
            low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            for a, b in set(zip(low[high > low].tolist(), high[high > low].tolist(), strict=True)):
                out.update(who[a:b].tolist())
        return sorted(out)


def _blocks(bench: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list]:
    items, n = [], 0
    for r in bench.select(F.col(id_col), F.col(text_col)).toLocalIterator():
        words = words_of(r[1])
        if items and n + len(words) > most:
            yield items
            items, n = [], 0
        items.append((r[0], words))
        n += len(words)
    if items:
        yield items


SCHEMA = "doc_id bigint, item_id bigint, coverage double, n_tiles bigint, longest bigint, tiles string"


def contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", coverage: float = COVERAGE, seed: int = SEED, least: int = MIN_TILE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """A row for each document and item that contaminates it: doc_id, item_id, coverage, n_tiles, longest, tiles (document:item:tokens)."""
    spark = docs.sparkSession
    modest(spark)
    src, out = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")), None
    for items in _blocks(bench, item_id_col, item_text_col, block_tokens):
        held = spark.sparkContext.broadcast(Block(items, seed))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            block = held.value
            get = block.vocab.get
            for whole in batches:
                for at in range(0, whole.num_rows, 1000):
                    batch, rows = whole.slice(at, 1000), []
                    for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                        words = words_of(text)
                        ids = np.array([get(w, 0) for w in words], np.uint64)
                        for k in block.candidates(ids):
                            got = tiles(ids, block.items[k], least)
                            share = sum(n for _, _, n in got) / len(block.items[k])
                            if share >= coverage:
                                rows.append((i, block.ids[k], round(share, 6), len(got), max(n for _, _, n in got), ",".join(f"{d}:{p}:{n}" for d, p, n in sorted(got))))
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], [c.split()[0] for c in SCHEMA.split(", ")])

        part = src.mapInArrow(trimmed(run), SCHEMA)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def decontaminate(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", coverage: float = COVERAGE, seed: int = SEED, least: int = MIN_TILE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """docs without the contaminated rows: a filter for each block of items, so no row is moved; between blocks the rest is written to the shared folder."""
    names, schema = docs.columns, docs.schema
    at_text = names.index(text_col)
    modest(docs.sparkSession)
    for k, items in enumerate(_blocks(bench, item_id_col, item_text_col, block_tokens)):
        if k:
            docs = materialise(docs, "clean")
        held = docs.sparkSession.sparkContext.broadcast(Block(items, seed))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            block = held.value
            get = block.vocab.get
            for whole in batches:
                for at in range(0, whole.num_rows, 1000):
                    batch, clean = whole.slice(at, 1000), []
                    for text in batch.column(at_text).cast(pa.large_binary()).to_pylist():
                        ids = np.array([get(w, 0) for w in words_of(text)], np.uint64)
                        clean.append(all(sum(n for _, _, n in tiles(ids, block.items[k], least)) < coverage * len(block.items[k]) for k in block.candidates(ids)))
                    yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(trimmed(run), schema)
    return docs


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))

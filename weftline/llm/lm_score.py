"""LM scoring by stupid backoff, computed relationally.

The n-grams of all documents are counted in tables partitioned by hash, the counts
join the n-grams again, and their logarithms are summed per document. Documents are
dealt into chunks; of a chunk every distinct n-gram is one entry with its count, so a
frequent n-gram is one entry a chunk. Entries travel as slices: one row holds a
chunk's entries of one hash range (a partition of the count tables), sorted and as
differences. Where chunks or ranges are so many that slices get short, rows are as
many as entries at most.

A document is scored by the counts of all others: its own are subtracted, otherwise
no n-gram would ever be unseen. For a token the longest n-gram with a count is taken,
times BACKOFF for each order given up: count by context's count, for a single token
count by all tokens, for an unseen one one order more and 1 by all tokens.

Tokens are words, A-Z lower-cased; n-grams do not cross documents; they are told apart
by 64-bit hashes, so two that collide count as one (of 10^9 different n-grams some 0.03
pairs do, of 10^13 some three million, which shifts the scores of the texts that hold them). Defined results: null and empty texts have no tokens and score 0;
rows alike are documents of their own and raise each other's scores; null ids are
kept; a lone document is scored as unseen; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import SPACE_RE, table, trimmed
from weftline.llm.words import word_hashes

ORDER, BACKOFF = 3, 0.4
#: Tokens of a chunk, and entries of a hash range, on average.
CHUNK_TOKENS, RANGE_ENTRIES = 1_600_000, 1_000_000
#: Chunks that rows alike can be dealt to.
SPREAD = 4096
K = np.uint64(0x9E3779B97F4A7C15)


def grams(words: np.ndarray, size: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order: the tokens that end an n-gram of it, and the hashes of these n-grams."""
    at = np.arange(len(words)) - np.repeat(np.cumsum(size) - size, size)
    out, h = [], np.zeros(len(words), np.uint64)
    for n in range(1, order + 1):
        ends = np.flatnonzero(at >= n - 1)
        h = np.zeros(len(ends), np.uint64) + np.uint64(n)
        for k in range(n):
            h = h * K + words[ends - (n - 1) + k]
            h ^= h >> np.uint64(32)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        out.append((ends, h ^ (h >> np.uint64(29))))
    return out


def _planes(values: np.ndarray) -> bytes:
    """The bytes of the values, all first bytes first (equal high bytes then lie together), compressed."""
    return zstandard.compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), 1)


def _values(planes: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(planes), np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _unpacked(chunk: pa.Table) -> tuple[list, list[bytes]]:
    """ids and texts of a chunk, in an order that does not depend on how its rows came."""
    ids, texts = [], []
    packs = sorted(zip(chunk.column("ids").to_pylist(), chunk.column("sizes").to_pylist(), chunk.column("pack").to_pylist(), strict=True), key=lambda x: x[2])
    for own, size, pack in packs:
        whole, at = zstandard.decompress(pack) if pack else b"", 0
        for i, n in zip(own, size, strict=True):
            ids.append(i)
            texts.append(whole[at : at + n])
            at += n
    return ids, texts


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, backoff: float = BACKOFF, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """A row for each document: id, n_tokens, logprob (natural, 4 decimals), n_backed_off, n_unseen."""
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    total = own.agg(F.sum(F.size(F.array_remove(F.split("_text", SPACE_RE), "")).cast("long"))).first()[0] or 0
    n_chunks, n_ranges = total // chunk_tokens + 1, order * total // RANGE_ENTRIES + 1
    # Rows alike in id and text would be one chunk; the row's number in its split parts them, and is the same when a split is read again.
    split = F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD))
    dealt = own.select("_id", "_text", F.pmod(F.xxhash64("_id", "_text", split), F.lit(n_chunks)).alias("chunk"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each chunk that a batch has rows of, with their texts compressed."""
        for batch in batches:
            chunk = np.asarray(batch.column(2))
            by_chunk = np.argsort(chunk, kind="stable")
            edges = np.flatnonzero(np.diff(chunk[by_chunk], prepend=-1, append=-1))
            ids, texts, rows = batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                some = by_chunk[a:b]
                got = [texts[int(i)].as_py() for i in some]
                rows.append((int(chunk[some[0]]), [ids[i] for i in some], [len(t) for t in got], zstandard.compress(b"".join(got), 9)))
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["chunk", "ids", "sizes", "pack"])

    chunks = dealt.mapInArrow(trimmed(packed), "chunk bigint, ids array<bigint>, sizes array<bigint>, pack binary")
    bounds = np.array([(k << 64) // n_ranges for k in range(1, n_ranges)], np.uint64)

    def entries(chunk: pa.Table) -> tuple[list, np.ndarray, list, np.ndarray, np.ndarray]:
        """ids, sizes and n-gram ends of a chunk; its distinct n-grams, sorted, and the place of each n-gram among them."""
        ids, texts = _unpacked(chunk)
        words, size = word_hashes(texts)
        each = grams(words, size, order)
        distinct, place = np.unique(np.concatenate([h for _, h in each]), return_inverse=True)
        return ids, size, [ends for ends, _ in each], distinct, place

    def slices(chunk: pa.Table) -> pa.Table:
        _, _, _, distinct, place = entries(chunk)
        counts = np.bincount(place, minlength=len(distinct)).astype(np.uint32)
        edges = np.concatenate([[0], np.searchsorted(distinct, bounds), [len(distinct)]])
        rows = [(k, a, b) for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if b > a]
        number = chunk.column("chunk")[0].as_py()
        return pa.table({"chunk": pa.array([number] * len(rows), pa.int64()), "part": pa.array([k for k, _, _ in rows], pa.int64()), "grams": pa.array([_planes(np.diff(distinct[a:b], prepend=np.uint64(0))) for _, a, b in rows], pa.binary()), "counts": pa.array([_planes(counts[a:b]) for _, a, b in rows], pa.binary())})

    def counted(part: pa.Table) -> pa.Table:
        """The count table of a hash range, joined to the entries of every chunk."""
        each = [np.cumsum(_values(g, np.uint64), dtype=np.uint64) for g in part.column("grams").to_pylist()]
        own_counts = np.concatenate([_values(c, np.uint32) for c in part.column("counts").to_pylist()])
        distinct, place = np.unique(np.concatenate(each), return_inverse=True)
        counts = np.bincount(place, weights=own_counts, minlength=len(distinct)).astype(np.uint64)[place]
        edges = np.cumsum([0, *map(len, each)])
        return pa.table({"chunk": part.column("chunk"), "part": part.column("part"), "counts": pa.array([_planes(counts[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())})

    def summed(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        ids, size, each, distinct, place = entries(chunk)
        parts = sorted(zip(answers.column("part").to_pylist(), answers.column("counts").to_pylist(), strict=True))
        counts = np.concatenate([_values(c, np.uint64) for _, c in parts]) if parts else np.empty(0, np.uint64)
        assert len(counts) == len(distinct), "a hash range did not answer"
        doc, n = np.repeat(np.arange(len(size)), size), int(size.sum())
        of_doc = np.concatenate([doc[ends] for ends in each])
        _, pair, times = np.unique(of_doc * max(1, len(distinct)) + place, return_inverse=True, return_counts=True)
        others = counts[place].astype(np.int64) - times[pair]
        del of_doc, pair, times, place, counts, distinct
        # seen[k]: count among the other documents of the n-gram of order k + 1 that ends at a token (-1: there is none).
        seen, at = np.full((order, n), -1, np.int64), 0
        for k, ends in enumerate(each):
            seen[k, ends] = others[at : at + len(ends)]
            at += len(ends)
        rest = np.maximum(total - size, 1)[doc].astype(np.float64)
        left = np.concatenate([np.zeros((order, 1), np.int64), seen[:, :-1]], axis=1) if n else seen
        logs, open_, lost = np.zeros(n), np.ones(n, bool), np.zeros(n)
        backed = np.zeros(n, bool)
        for k in range(order - 1, -1, -1):
            hit = open_ & (seen[k] > 0)
            below = left[k - 1, hit] if k else rest[hit]
            logs[hit] = np.log(seen[k, hit] / below) + lost[hit] * np.log(backoff)
            backed |= hit & (lost > 0)
            open_ &= ~hit
            lost += open_ & (seen[k] >= 0)
        logs[open_] = lost[open_] * np.log(backoff) - np.log(rest[open_])
        add = lambda x: np.bincount(doc, weights=x, minlength=len(size))
        return pa.table({"_id": pa.array(ids, pa.int64()), "n_tokens": pa.array(size, pa.int64()), "logprob": pa.array(np.round(add(logs), 4) + 0.0, pa.float64()), "n_backed_off": pa.array(add(backed).astype(np.int64)), "n_unseen": pa.array(add(open_).astype(np.int64))})

    asked = chunks.groupBy("chunk").applyInArrow(slices, "chunk bigint, part bigint, grams binary, counts binary")
    answers = asked.groupBy("part").applyInArrow(counted, "chunk bigint, part bigint, counts binary")
    out = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(summed, "_id bigint, n_tokens bigint, logprob double, n_backed_off bigint, n_unseen bigint")
    return out.withColumnRenamed("_id", id_col)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
t0 AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
t AS (SELECT r, i, w AS c, lag(w) OVER o AS b, lag(w, 2) OVER o AS a FROM t0 WINDOW o AS (PARTITION BY r ORDER BY i)),
s AS (SELECT r, i, b, a,
  count(*) OVER (PARTITION BY c) - count(*) OVER (PARTITION BY r, c) AS n1,
  CASE WHEN b IS NOT NULL THEN count(*) OVER (PARTITION BY b, c) - count(*) OVER (PARTITION BY r, b, c) END AS n2,
  CASE WHEN a IS NOT NULL THEN count(*) OVER (PARTITION BY a, b, c) - count(*) OVER (PARTITION BY r, a, b, c) END AS n3,
  greatest(count(*) OVER () - count(*) OVER (PARTITION BY r), 1) AS rest FROM t),
p AS (SELECT *, lag(n1) OVER o AS p1, lag(n2) OVER o AS p2 FROM s WINDOW o AS (PARTITION BY r ORDER BY i)),
g AS (SELECT r, n1, n2, n3,
  CASE WHEN n3 > 0 THEN ln(n3 / p2)
    WHEN n2 > 0 THEN ln(n2 / p1) + CASE WHEN a IS NOT NULL THEN ln(0.4) ELSE 0 END
    WHEN n1 > 0 THEN ln(n1 / rest) + ln(0.4) * ((CASE WHEN a IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN b IS NOT NULL THEN 1 ELSE 0 END))
    ELSE ln(0.4) * (1 + (CASE WHEN a IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN b IS NOT NULL THEN 1 ELSE 0 END)) - ln(rest) END AS lp,
  CASE WHEN n1 > 0 AND ((n3 = 0) OR (a IS NULL AND n2 = 0)) THEN 1 ELSE 0 END AS backed, CASE WHEN n1 = 0 THEN 1 ELSE 0 END AS unseen FROM p),
f AS (SELECT r, count(*) AS n_tokens, sum(lp) AS lp, sum(backed) AS backed, sum(unseen) AS unseen FROM g GROUP BY r)
SELECT doc_id, CAST(coalesce(n_tokens, 0) AS BIGINT) AS n_tokens, round(coalesce(lp, 0.0), 4) + 0.0 AS logprob, CAST(coalesce(backed, 0) AS BIGINT) AS n_backed_off, CAST(coalesce(unseen, 0) AS BIGINT) AS n_unseen FROM d LEFT JOIN f USING (r)
"""

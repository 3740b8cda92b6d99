"""Substring dedup by sentence, line or paragraph hashing.

Units are normalised (A-Z lower-cased, white space squeezed) and digested; digests are
grouped over the whole corpus with partial aggregates. A unit whose digest occurs more
than once is repeated. Short units recur in clean text, so repeated units count only in
a run: neighbouring repeated units of RUN_WORDS words or more together. Of those, the
occurrence of least rank (document id, then place) of each digest stays and all others
go, with their offsets in the original text kept.

A line is cut into sentences behind each ``.``, ``!`` or ``?`` that white space follows,
so that a passage that starts or ends inside a line shares units with its copies.
A sentence of fewer than MIN_WORDS words is one unit with the next one of its line, or
with the last unit of the line where no longer one follows. Unit ``line`` or
``paragraph`` takes those whole. What has no word is no unit.

Offsets are code points. Defined results: a null or empty text has no units; rows
alike in id and text are one document, so their units do not repeat each other, and
each row gets the result; null ids rank last; a unit repeated in its own document is
repeated; an empty table gives no rows; further columns are passed on by
``substring_dedup`` (its own columns replace theirs).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import join_one, materialise, modest, row_key, table, trimmed, unused

#: Words of a sentence that is a unit by itself, and of a run of repeated units that counts.
MIN_WORDS, RUN_WORDS = 6, 24
BREAKS = {"sentence": r"\n", "line": r"\n", "paragraph": r"\n[\x20\x09\x0B-\x0D]*\n\s*"}
#: The white space after a sentence's end (it stays with the sentence).
ENDS = re.compile(r"(?<=[.!?])[\x20\x09\x0B-\x0D]+")
ENDS_BYTES = re.compile(ENDS.pattern.encode())


def words_of(part: bytes) -> list[bytes]:
    """bytes.lower and bytes.split treat ASCII alone, as the words are defined."""
    return part.lower().split()


def glued(pieces: list[list], min_words: int) -> list[list]:
    """The units of a line: pieces [words, ...] of which short ones are joined to the next, at the end to the one before."""
    units: list[list] = []
    now: list | None = None
    for piece in pieces:
        if not piece[0]:
            continue
        now = piece if now is None else [now[0] + piece[0], now[1], piece[2]]
        if len(piece[0]) >= min_words:
            units.append(now)
            now = None
    if now is not None:
        if units:
            units[-1] = [units[-1][0] + now[0], units[-1][1], now[2]]
        else:
            units.append(now)
    return units


def digests(text: str, unit: str, min_words: int) -> list[bytes]:
    """Digests of the units of a text, in their order."""
    raw = text.encode("utf-8", "surrogatepass")
    out: list[bytes] = []
    for block in re.split(BREAKS[unit].encode(), raw):
        if unit == "sentence":
            units = [u[0] for u in glued([[words_of(p), 0, 0] for p in ENDS_BYTES.split(block)], min_words)]
        else:
            units = [w] if (w := words_of(block)) else []
        out += [xxhash.xxh3_128_digest(b" ".join(w)) for w in units]
    return out


def placed(text: str, unit: str, min_words: int) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int]]]:
    """Of each line or paragraph its units (start, end, number of words), and its own start and the start of the next."""
    breaks = [(m.start(), m.end()) for m in re.finditer(BREAKS[unit], text)]
    blocks, extents = [], list(zip([0, *(e for _, e in breaks)], [*(s for s, _ in breaks), len(text)], strict=True))
    for start, end in extents:
        pieces, at = [], start
        for m in [*(ENDS.finditer(text, start, end) if unit == "sentence" else ()), None]:
            to = m.end() if m else end
            pieces.append([words_of(text[at:to].encode("utf-8", "surrogatepass")), at, to])
            at = to
        blocks.append([(s, e, len(w)) for w, s, e in glued(pieces, min_words if unit == "sentence" else 1)])
    return blocks, extents


def judged(words: list[int], marks: dict[int, bool], run_words: int) -> tuple[set[int], set[int]]:
    """Places of the repeated units in runs that count, and those of them to remove; marks: repeated places, and whether the occurrence is the first."""
    repeated: set[int] = set()
    run: list[int] = []
    for k in range(len(words) + 1):
        if k in marks:
            run.append(k)
        elif run:
            if sum(words[i] for i in run) >= run_words:
                repeated.update(run)
            run = []
    return repeated, {k for k in repeated if not marks[k]}


def cut_units(text: str, marks: dict[int, bool], unit: str, min_words: int, run_words: int) -> tuple[str, int, list[tuple[int, int]]]:
    """The text without the units to remove (a line or paragraph of which all units go goes with the break after it), the number of repeated units, and the offsets of what went."""
    blocks, extents = placed(text, unit, min_words)
    flat = [u for b in blocks for u in b]
    repeated, gone = judged([n for _, _, n in flat], marks, run_words)
    parts, k = [], 0
    for i, (units, (start, end)) in enumerate(zip(blocks, extents, strict=True)):
        own = range(k, k + len(units))
        k += len(units)
        if units and all(j in gone for j in own):
            continue
        kept, at = "", start
        for j in own:
            if j in gone:
                kept += text[at : flat[j][0]]
                at = flat[j][1]
        parts.append((kept + text[at:end], text[end : extents[i + 1][0]] if i + 1 < len(extents) else ""))
    out = "".join(a + b for a, b in parts)
    return out[: len(out) - len(parts[-1][1])] if parts else "", len(repeated), [flat[j][:2] for j in sorted(gone)]


def repeated_units(own: DataFrame, unit: str = "sentence", min_words: int = MIN_WORDS) -> DataFrame:
    """_key, marks (array of place, first: of each repeated unit) of documents own (_id, _key, _text) that have any."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                each = [digests(t or "", unit, min_words) for t in batch.column(2).to_pylist()]
                ends = pa.array(np.cumsum([0, *map(len, each)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array([x for d in each for x in d], pa.binary()))], ["_id", "_key", "digest"])

    listed = materialise(own.select("_id", "_key", "_text").mapInArrow(trimmed(found), "_id bigint, _key binary, digest array<binary>").where(F.size("digest") > 0), "units")
    rank = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_key").alias("key"), F.col("place"))
    each = listed.select("_id", "_key", F.posexplode("digest").alias("place", "digest")).select("digest", rank.alias("rank"))
    first = each.groupBy("digest").agg(F.min("rank").alias("first"), F.max("rank").alias("last"), F.count(F.lit(1)).alias("c")).where("first <> last")
    first = materialise(first.select("digest", "first", "c"), "first")
    total = listed.agg(F.sum(F.size("digest"))).first()[0] or 0
    met = join_one(each, first, "digest", "c", total)
    return met.groupBy(F.col("rank.key").alias("_key")).agg(F.collect_set(F.struct(F.col("rank.place").alias("place"), (F.col("rank") == F.col("first")).alias("first"))).alias("marks"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "sentence", min_words: int = MIN_WORDS, run_words: int = RUN_WORDS, with_text: bool = True) -> DataFrame:
    """docs with n_units, n_repeated (in runs that count, the kept first ones included), n_removed, removed (start:end of each removed unit), kept_sha256, and text_col without them (left out if with_text is False)."""
    modest(docs.sparkSession)
    key = F.unhex(row_key(id_col, text_col))
    own = docs.select(F.col(id_col).cast("long").alias("_id"), key.alias("_key"), F.col(text_col).alias("_text"))
    at_key, at_marks = unused(docs, "_key", "_marks")
    marked = repeated_units(own, unit, min_words).select(F.col("_key").alias(at_key), F.col("marks").alias(at_marks))
    made = T.StructType([*(T.StructField(n, T.LongType()) for n in ("n_units", "n_repeated", "n_removed")), T.StructField("removed", T.StringType()), T.StructField("kept_sha256", T.StringType())])
    carried = [f for f in docs.schema if f.name not in made.names and (with_text or f.name != text_col)]
    names = [f.name for f in carried]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts, marks = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (text_col, at_marks))
                new, rows = [], []
                for text, some in zip(texts, marks, strict=True):
                    kept, n, spans = cut_units(text, {x["place"]: x["first"] for x in some}, unit, min_words, run_words) if some else (text, 0, [])
                    new.append(kept)
                    units = sum(map(len, placed(text, unit, min_words)[0])) if text else 0
                    rows.append((units, n, len(spans), ",".join(f"{s}:{e}" for s, e in spans), hashlib.sha256((kept or "").encode("utf-8", "surrogatepass")).hexdigest()))
                cols = [pa.array(new, pa.string()) if n == text_col else batch.column(batch.schema.get_field_index(n)) for n in names]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())))], [*names, *made.names])

    joined = docs.withColumn(at_key, key).join(marked, at_key, "left").select(*(f"`{c}`" for c in dict.fromkeys([*names, text_col])), at_marks)
    return joined.mapInArrow(trimmed(finish), T.StructType([*carried, *made]))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)


ORACLE = r"""
WITH d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, t, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM d),
b AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id, t ORDER BY k) - length(line) - 1 AS s,
  string_split(regexp_replace(line, '([.!?][\x20\x09\x0B-\x0D]+)', '\1' || chr(10), 'g'), chr(10)) AS ps FROM l),
p AS (SELECT doc_id, t, k, s, unnest(ps) AS piece, generate_subscripts(ps, 1) AS j FROM b),
w AS (SELECT *, trim(regexp_replace(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm, s + sum(length(piece)) OVER (PARTITION BY doc_id, t, k ORDER BY j) - length(piece) AS a FROM p),
c AS (SELECT *, CASE WHEN norm = '' THEN 0 ELSE len(string_split(norm, ' ')) END AS n FROM w),
g AS (SELECT *, count(*) FILTER (WHERE n >= 6) OVER (PARTITION BY doc_id, t, k ORDER BY j) - CASE WHEN n >= 6 THEN 1 ELSE 0 END AS before, count(*) FILTER (WHERE n >= 6) OVER (PARTITION BY doc_id, t, k) AS longs FROM c WHERE n > 0),
u AS (SELECT doc_id, t, k, least(before, greatest(longs - 1, 0)) AS q, min(a) AS a, max(a + length(piece)) AS e, sum(n) AS n, string_agg(norm, ' ' ORDER BY j) AS norm FROM g GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, t ORDER BY a) AS place, count(*) OVER (PARTITION BY norm) > 1 AS twice,
  row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST, md5(concat_ws(chr(0), coalesce(CAST(doc_id AS VARCHAR), chr(1)), t)), a) > 1 AS later FROM u),
i AS (SELECT *, place - row_number() OVER (PARTITION BY doc_id, t, twice ORDER BY place) AS island FROM r),
m AS (SELECT *, twice AND sum(n) OVER (PARTITION BY doc_id, t, twice, island) >= 24 AS counts FROM i),
x AS (SELECT *, counts AND later AS gone FROM m),
f AS (SELECT doc_id, t, count(*) AS n_units, count(*) FILTER (WHERE counts) AS n_repeated, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(CASE WHEN gone THEN a || ':' || e END, ',' ORDER BY a), '') AS removed FROM x GROUP BY doc_id, t),
o AS (SELECT doc_id, t, k, bool_and(gone) AS all_gone, list(a ORDER BY a) FILTER (WHERE gone) AS sa, list(e ORDER BY a) FILTER (WHERE gone) AS se FROM x GROUP BY doc_id, t, k),
y AS (SELECT l.doc_id, l.t, l.k, s, s + length(line) AS z, line, coalesce(all_gone, false) AS all_gone, sa, se FROM b l LEFT JOIN o ON l.doc_id IS NOT DISTINCT FROM o.doc_id AND l.t = o.t AND l.k = o.k),
v AS (SELECT doc_id, t, k, CASE WHEN sa IS NULL THEN line ELSE array_to_string(list_transform(range(0, len(sa) + 1), lambda h: substr(t, CAST(CASE WHEN h = 0 THEN s ELSE se[h] END AS BIGINT) + 1, CAST(CASE WHEN h = len(sa) THEN z ELSE sa[h + 1] END - CASE WHEN h = 0 THEN s ELSE se[h] END AS BIGINT))), '') END AS line FROM y WHERE NOT all_gone),
h AS (SELECT d.doc_id, d.t, sha256(coalesce(string_agg(line, chr(10) ORDER BY k), '')) AS kept_sha256 FROM d LEFT JOIN v ON d.doc_id IS NOT DISTINCT FROM v.doc_id AND d.t = v.t GROUP BY d.doc_id, d.t)
SELECT z.doc_id, CAST(coalesce(n_units, 0) AS BIGINT) AS n_units, CAST(coalesce(n_repeated, 0) AS BIGINT) AS n_repeated, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(removed, '') AS removed, kept_sha256
FROM documents z JOIN h ON z.doc_id IS NOT DISTINCT FROM h.doc_id AND coalesce(z.text, '') = h.t LEFT JOIN f ON z.doc_id IS NOT DISTINCT FROM f.doc_id AND coalesce(z.text, '') = f.t
"""

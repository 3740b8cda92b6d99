"""Quality classifier by co-training of two views.

The text view sees the words of a document and how it is written; the metadata view
sees its source, language, size and layout. Each starts from the labelled rows; over
some rounds each scores all unlabelled documents, and the ADDED ones that it is most
sure of join the other's training rows. On labelled rows that were held out, both views
are calibrated and combined, and the threshold is set so that hardly any good document
falls below it. The combined model then scores all documents in one map.

A document is good when its quality label is 1 and its toxic label is not 1.

Fitting uses at most MAX_LABELLED labelled documents, those of least hash. What the views
need of the unlabelled ones (which of the chosen words, statistics, metadata: documents
alike in these are one) is a table in the shared folder; a round is a map over it and
a top-k. Only the rows that are added reach the driver. The text view is a model of the
MAX_WORDS most telling words. Scoring covers every document and all its words.

Defined results: null and empty texts have no words and are scored by the rest; null
source, language or length are values of their own; rows alike get the same score;
labels that contradict each other or are null are not used; of several documents of a
labelled id the one of least content hash is used; without labels of both
kinds every score is 1 and everything is kept; an empty table gives no rows; further
columns are passed on by ``classify`` unless they bear the name of one that it makes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import discard, materialise, modest, table, trimmed, unused

MAX_LABELLED = 8000
#: Hash buckets of words; words that the text view uses at most, and how far their share must differ between the classes (in standard errors).
BUCKETS, MAX_WORDS, STANDS_OUT = 1 << 18, 400, 4.0
#: Rounds, how sure a view must be, and documents that it labels in a round (good ones and others in the labelled proportion).
ROUNDS, SURE, ADDED = 4, 0.95, 200
#: Share of the held-out good documents that the threshold may reject, and the part of the labelled rows held out.
REJECTED_GOOD, HELD_OUT = 0.002, 4
STATS, META = 10, 160
#: Words whose buckets a worker keeps (about 150 bytes each).
KEPT_WORDS = 100_000


class Words(dict):
    """Bucket of a word without the punctuation around it; forgotten beyond KEPT_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        self[word] = b = zlib.crc32(word.strip(b".,;:!?\"'()[]{}|#$%&*-")) % BUCKETS
        return b


def features(text: str | None, lang: str | None, source: str | None, n_chars: int | None, memo: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word buckets, statistics of the writing, set places of the metadata."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    distinct = set(words)
    buckets = np.unique(np.fromiter(map(memo.__getitem__, distinct), np.int64, len(distinct)))
    n, m = max(1, len(words)), max(1, len(raw))
    lines = [x for x in text.split("\n") if x.strip()]
    marks = sum(raw.count(c) for c in (b"#", b"*", b"$", b"%", b"&"))
    upper = len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    stats = np.array([marks / n, raw.count(b"!") / n, raw.count(b"|") / n, (len(raw) - upper) / m, len(raw.translate(None, b"0123456789")) / m - 1, len(distinct) / n, (m - len(words)) / n / 10, 1 - len(set(lines)) / max(1, len(lines)), math.log1p(len(words)) / 10, raw.count(b"<") / n])
    stats = np.clip(stats, -4, 4)

    def place(value: str | None, at: int, size: int) -> int:
        return at + (zlib.crc32(value.encode("utf-8", "surrogatepass")) % (size - 1) + 1 if value is not None else 0)

    def scale(x: float, size: int) -> int:
        return min(size - 1, int(2 * math.log2(1 + max(0, x))))

    size = n_chars if n_chars is not None else len(text)
    meta = np.array([place(lang, 0, 16), place(source, 16, 48), 64 + scale(size, 40), 104 + scale(len(lines), 24), 128 + scale(size / max(1, len(lines)), 32)])
    return buckets, stats, meta


class Logistic:
    """Ridge logistic regression by Newton steps."""

    def __init__(self, ridge: float = 1.0):
        self.ridge, self.w = ridge, np.zeros(1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        x = np.hstack([x, np.ones((len(x), 1))])
        self.w = np.zeros(x.shape[1])
        penalty = np.full(x.shape[1], self.ridge)
        penalty[-1] = 1e-6
        for _ in range(12):
            p = 1 / (1 + np.exp(-np.clip(x @ self.w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * self.w)
            self.w += step
            if np.abs(step).max() < 1e-4:
                break
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w[:-1] + self.w[-1]


class CoTrained:
    """The two views, their calibration, and the threshold; small enough for every task."""

    def __init__(self, chosen: np.ndarray, text: Logistic, meta: Logistic, joint: list[tuple[float, float]], threshold: float):
        self.text, self.meta, self.joint, self.threshold = text, meta, joint, threshold  # joint: see combined()
        self.words = np.zeros(BUCKETS, np.float64)
        self.words[chosen] = text.w[: len(chosen)]
        self.stats, self.bias = text.w[len(chosen) : len(chosen) + STATS], text.w[-1]

    def score(self, buckets: np.ndarray, stats: np.ndarray, meta: np.ndarray) -> tuple[float, float, float]:
        """Margins of both views and the combined probability."""
        a = float(self.words[buckets].sum() + self.stats @ stats + self.bias)
        b = float(self.meta.w[meta].sum() + self.meta.w[-1])
        return a, b, float(combined(self.joint, np.array([[a, b]]))[0])


def squash(margins: np.ndarray) -> np.ndarray:
    return np.clip(margins, -12, 12)


def calibrated(margins: np.ndarray, y: np.ndarray) -> list[tuple[float, float]]:
    """Slope (not below 0) and offset of each view's log odds, and at last the prior's log odds."""
    prior = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    out = []
    for v in range(margins.shape[1]):
        m = Logistic(0.1).fit(margins[:, v : v + 1], y)
        out.append((float(m.w[0]), float(m.w[1])) if m.w[0] > 0 else (0.0, prior))
    return [*out, (0.0, prior)]


def combined(joint: list[tuple[float, float]], margins: np.ndarray) -> np.ndarray:
    """Probability of good: the views' calibrated log odds, added, the prior counted once."""
    *views, (_, prior) = joint
    m = squash(margins)
    z = sum(slope * m[:, v] + offset for v, (slope, offset) in enumerate(views)) - prior * (len(views) - 1)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _matrix(rows: list, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Design matrices of the two views."""
    at = np.full(BUCKETS, -1)
    at[chosen] = np.arange(len(chosen))
    text, meta = np.zeros((len(rows), len(chosen) + STATS)), np.zeros((len(rows), META))
    for k, (buckets, stats, places) in enumerate(rows):
        here = at[buckets]
        text[k, here[here >= 0]] = 1
        text[k, len(chosen) :] = stats
        meta[k, places] = 1
    return text, meta


def _telling(rows: list, y: np.ndarray) -> np.ndarray:
    """Buckets whose share differs most clearly between good and other documents."""
    seen = [np.bincount(np.concatenate([rows[i][0] for i in np.flatnonzero(y == c)]), minlength=BUCKETS) for c in (0, 1)]
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    share = (seen[0] + seen[1] + 1) / (n.sum() + 2)
    z = np.abs(seen[0] / n[0] - seen[1] / n[1]) / np.sqrt(share * (1 - share) * (1 / n[0] + 1 / n[1]))
    z[seen[0] + seen[1] < 5] = 0
    top = np.argsort(-z, kind="stable")[:MAX_WORDS]
    return np.sort(top[z[top] > STANDS_OUT])


def shares(share: float, added: int) -> tuple[int, int]:
    """Good and other documents that a view labels in a round, one of each at least."""
    good = min(max(1, round(added * share)), max(1, added - 1))
    return good, max(1, added - good)


def co_train(rows: list, y: np.ndarray, most_sure, rounds: int = ROUNDS) -> CoTrained | None:
    """The fitted model, or None without labelled rows of both kinds.

    most_sure(chosen, models, used, n_good, n_bad) gives of each view the unlabelled rows
    (key, words, stats, meta, label) that it is most sure of; used: keys that each view has been given.
    """
    if len(set(y.tolist())) < 2:
        return None
    held = np.arange(len(rows)) % HELD_OUT == 0
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(rows), bool)
    train, check = np.flatnonzero(~held), np.flatnonzero(held) if held.any() else np.arange(len(rows))
    chosen = _telling([rows[i] for i in train], y[train])
    views = _matrix(rows, chosen)
    n_good, n_bad = shares(float(y[train].mean()), ADDED)
    extra: list[dict[int, tuple]] = [{}, {}]
    models = [Logistic(), Logistic()]
    for r in range(rounds + 1):
        for v in (0, 1):
            more = [extra[v][k] for k in sorted(extra[v])]
            x = np.vstack([views[v][train], _matrix([m[:3] for m in more], chosen)[v]])
            models[v].fit(x, np.concatenate([y[train], [m[3] for m in more]]))
        if r == rounds:
            break
        # What a view is sure of is a label for the other.
        for v, found in enumerate(most_sure(chosen, models, [set(e) for e in extra], n_good, n_bad)):
            extra[1 - v] |= {key: (*row, float(label)) for key, *row, label in found if key not in extra[1 - v]}
    both = squash(np.column_stack([models[v].margin(views[v][check]) for v in (0, 1)]))
    joint = calibrated(both, y[check])
    score = combined(joint, both)
    good = np.sort(score[y[check] == 1])
    threshold = min(0.5, float(good[int(REJECTED_GOOD * len(good))]))
    return CoTrained(chosen, models[0], models[1], joint, threshold)


SEEN = "words array<int>, stats array<double>, meta array<int>"


def _featured(df: DataFrame, names: tuple[str, ...], carried: str, chosen: np.ndarray | None = None) -> DataFrame:
    """carried columns of df (text, lang, source, n_chars under names) and its features; of the words the chosen ones alone, if given."""
    kinds = {"bigint": pa.int64(), "int": pa.int32()}
    carry = [(c.split()[0], kinds[c.split()[1]]) for c in carried.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Words()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                d = whole.slice(at, 500).to_pydict()
                each = [features(*x, memo) for x in zip(*(d[n] for n in names), strict=True)]
                words = [e[0] if chosen is None else e[0][np.isin(e[0], chosen, assume_unique=True)] for e in each]
                cols = [pa.array([w.tolist() for w in words], pa.list_(pa.int32())), pa.array([e[1].tolist() for e in each], pa.list_(pa.float64())), pa.array([e[2].tolist() for e in each], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*(pa.array(d[c], kind) for c, kind in carry), *cols], [*(c for c, _ in carry), "words", "stats", "meta"])

    return df.select(*names, *(c for c, _ in carry)).mapInArrow(trimmed(run), f"{carried}, {SEEN}")


def _arrays(words, stats, meta) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.asarray(words, np.int64), np.asarray(stats, np.float64), np.asarray(meta, np.int64)


def sure_rows(seen: DataFrame, chosen: np.ndarray, models: list[Logistic], used: list[set[int]], n_good: int, n_bad: int) -> list[list[tuple]]:
    """Of each view the rows of seen (key, words, stats, meta) that it is most sure of and the other has not been given: a map, and four top-k."""
    lists = [(v, label, n) for v in (0, 1) for label, n in ((1, n_good), (0, n_bad))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                d = whole.slice(at, 2000).to_pydict()
                rows = [_arrays(*x) for x in zip(d["words"], d["stats"], d["meta"], strict=True)]
                p = [1 / (1 + np.exp(-np.clip(m.margin(x), -30, 30))) for m, x in zip(models, _matrix(rows, chosen), strict=True)]
                out = []
                for k, (v, label, n) in enumerate(lists):
                    sure = np.round(p[v] if label else 1 - p[v], 12)
                    able = [i for i in range(len(rows)) if sure[i] >= SURE and d["key"][i] not in used[1 - v]]
                    out += [(k, float(sure[i]), d["key"][i], d["words"][i], d["stats"][i], d["meta"][i]) for i in sorted(able, key=lambda i: (-sure[i], d["key"][i]))[:n]]
                kinds = (pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], kind) for c, kind in enumerate(kinds)], ["list", "sure", "key", "words", "stats", "meta"])

    best = materialise(seen.select("key", "words", "stats", "meta").mapInArrow(trimmed(run), f"list int, sure double, key bigint, {SEEN}"), "sure")
    tops = [best.where(F.col("list") == k).orderBy(F.desc("sure"), "key").limit(n) for k, (_, _, n) in enumerate(lists)]
    got = tops[0].unionByName(tops[1]).unionByName(tops[2]).unionByName(tops[3]).collect()
    return [[(x.key, *_arrays(x.words, x.stats, x.meta), lists[x.list][1]) for x in got if lists[x.list][0] == v] for v in (0, 1)]


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> CoTrained | None:
    """Co-train on documents (doc_id, text, lang, source, n_chars) and labels (doc_id, quality, toxic)."""
    modest(docs.sparkSession)
    good = ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) != 1)).cast("int")
    told = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("id"), good.alias("y")).groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("id", "y")
    rank = F.xxhash64("id", F.lit(6)).alias("rank")
    some = told.select("*", rank).orderBy("rank", "id").limit(max_labelled)
    names = ("text", "lang", "source", "n")
    own, put = _columns(docs)
    own = own.select(*(F.col(put[k]).alias(k) for k in ("id", *names)))
    # One document of each labelled id, the same in every run.
    one = own.join(F.broadcast(some), "id").groupBy("id", "rank", "y").agg(F.min(F.struct(F.xxhash64(*names).alias("h"), *names)).alias("x"))
    got = _featured(one.select("rank", "y", "x.*"), names, "rank bigint, y int").toPandas().sort_values("rank", kind="stable")
    rows, y = [_arrays(*x) for x in zip(got["words"], got["stats"], got["meta"], strict=True)], got["y"].to_numpy(np.int64)
    kept: list[DataFrame] = []

    def most_sure(chosen: np.ndarray, *asked) -> list[list[tuple]]:
        if not kept:
            rest = own.join(F.broadcast(some.select("id")), "id", "left_anti").withColumn("none", F.lit(0))
            seen = _featured(rest, names, "none int", chosen)
            kept.append(materialise(seen.select(F.xxhash64("words", "stats", "meta").alias("key"), "words", "stats", "meta").dropDuplicates(["key"]), "unlabelled"))
        return sure_rows(kept[0], chosen, *asked)

    model = co_train(rows, y, most_sure)
    discard(*kept)
    return model


def _columns(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with what the views read, under names that no column of docs has; the names of id, text, lang, source and n."""
    have, wanted = dict(docs.dtypes), {"id": ("doc_id", "long"), "text": ("text", "string"), "lang": ("lang", "string"), "source": ("source", "string"), "n": ("n_chars", "long")}
    put = dict(zip(wanted, unused(docs, *(f"_wl_{k}" for k in wanted)), strict=True))
    return docs.select("*", *((F.col(f"`{c}`") if c in have else F.lit(None)).cast(kind).alias(put[k]) for k, (c, kind) in wanted.items())), put


def classify(docs: DataFrame, model: CoTrained | None, with_text: bool = True) -> DataFrame:
    """docs with text_margin, meta_margin, score (probability of good) and kept; a map over all rows."""
    modest(docs.sparkSession)
    made = T.StructType([T.StructField("text_margin", T.DoubleType()), T.StructField("meta_margin", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    carried = [f for f in docs.schema if f.name not in made.names and (with_text or f.name != "text")]
    names = [f.name for f in carried]
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, m = Words(), held.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in seen]
                out = [m.score(*features(*x, memo)) if m else (0.0, 0.0, 1.0) for x in zip(*cols, strict=True)]
                kept = [s >= m.threshold if m else True for _, _, s in out]
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), *(pa.array([x[k] for x in out], pa.float64()) for k in range(3)), pa.array(kept, pa.bool_())], [*names, *made.names])

    # What a row brings under its own name is not sent twice.
    kinds, (wide, put) = {f.name: f.dataType for f in carried}, _columns(docs)
    seen = [own if kinds.get(own) == kind else put[k] for own, k, kind in (("text", "text", T.StringType()), ("lang", "lang", T.StringType()), ("source", "source", T.StringType()), ("n_chars", "n", T.LongType()))]
    return wide.select(*(f"`{n}`" for n in dict.fromkeys([*names, *seen]))).mapInArrow(trimmed(run), T.StructType([*carried, *made]))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels")), with_text=False).select("doc_id", "text_margin", "meta_margin", "score", "kept")

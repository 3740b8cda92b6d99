"""Exact n-gram Jaccard join with set-relation skipping.

Texts of equal shingle sets are one class. Classes meet in an inverted index over
the prefixes of their sets (tokens that many sets have are ordered last), whose
lists are skipped by size and position. In short lists each pair is bounded by
bucket counts and then compared. In long lists, which only sets made of common
tokens share, a set's overlaps are derived from those of a highly similar set by
their difference alone, and a set in the largest component is not asked where all
outside it are.

Shingles are 64-bit hashes of word n-grams, classes 64-bit hashes of sorted sets.

Defined results: null and empty texts have an empty set, no links, and their own id
as component; fewer words than n make one shingle of all of them; rows alike in
id and text are each returned; a null id takes part and gets the least id of its
component (null if there is none); an empty table gives no rows; further columns are
ignored. A pair on the threshold is linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import SPACE, join_one, materialise, modest, table, trimmed, unused
from weftline.llm.components import components
from weftline.llm.words import word_hashes

WORDS = 5
#: Similarity in hundredths.
SIMILAR = 80
#: Tokens of more sets than this are ordered last; lists up to SHORT are joined pair by pair.
FREQUENT, SHORT = 128, 384
#: Tokens that two similar sets must share in their prefixes, which are as much longer than what makes them share one.
SHARED = 4
#: Tokens that are ordered last: the most frequent ones, at most so many (8 bytes each); the result is the same for any choice.
COMMON = 1_000_000
#: One token in so many (a power of two) is counted to see what is common; NEAR tokens before and after one that is are counted next, and all between two that are at most GAP apart.
SEEDS, NEAR, GAP = 8, 8, 64
#: Rows of a batch that have a token for it to be counted as well, seed or not (short common lines may have no seed).
OFTEN = 3
#: Passes over the index lists at most: one more each time many sets meet at common tokens that were missed.
TURNS = 3
#: Classes with more copies than this, at most so many of them, are known to the workers, which pass over all copies but one.
COPIES, COPIED = 16, 100_000
#: Shingles (and members) of a long list that are compared in one task.
BLOCK_TOKENS, BLOCK_SETS = 2_000_000, 4096
#: Row keys up to this number are broadcast (8 bytes each), more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: Shingles of rows whose frequent ones are counted together.
TOGETHER = 1_500_000
K = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: list[bytes], n: int = WORDS) -> Iterator[np.ndarray]:
    """Shingle hashes of each text, in its order."""
    h, size = word_hashes(texts)
    s = h[: max(0, len(h) - n + 1)].copy()
    for k in range(1, n):
        s *= K
        s += h[k : len(h) - n + 1 + k]
    s ^= s >> np.uint64(29)
    start = 0
    for m in size.tolist():
        if m >= n:
            yield s[start : start + m - n + 1].view(np.int64)
        else:
            yield np.array([xxhash.xxh64_intdigest(h[start : start + m].tobytes(), m)][:m], np.uint64).view(np.int64)
        start += m


def prefix_len(n: int, similar: int = SIMILAR) -> int:
    """Two sets that are similar share SHARED of the first so many of each, or all that they need to share."""
    return min(n, n - -(-similar * n // 100) + SHARED)


def signature(s: np.ndarray) -> bytes | None:
    """Counts of the set by leading bits: the differences of two such counts bound the symmetric difference from below."""
    bits = max(4, int(len(s) // 2).bit_length())
    counts = np.bincount(((s.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column(batch.schema.get_field_index("_text")).cast(pa.large_binary()).to_pylist()]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int64)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat, pa.int64()))


def _member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    at = np.searchsorted(sorted_values, x)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == x


def _map_sets(docs: DataFrame, schema: str, one, n: int, rows: int = 2000) -> DataFrame:
    """one(id, key, shingles) -> a tuple of the schema's values, or None; over docs (_id, _key, _text, further columns: passed as a tuple)."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                out = []
                for i, k, flow in zip(ids, keys, shingles(_texts(batch), n), strict=True):
                    x = one(i, k, flow)
                    if x is not None:
                        out.append(x)
                cols = list(zip(*out, strict=True)) if out else [[] for _ in names]
                kinds = {"array<bigint>": _lists, "bigint": lambda v: pa.array(v, pa.int64()), "int": lambda v: pa.array(v, pa.int32()), "binary": lambda v: pa.array(v, pa.binary())}
                yield pa.RecordBatch.from_arrays([kinds[c.split()[1]](list(v)) for c, v in zip(schema.split(", "), cols, strict=True)], names)

    return docs.select("_id", "_key", "_text").mapInArrow(trimmed(run), schema)


def _described(words: int):
    """A map over docs (_id, _key, _text): each row's class, size, signature and seeds; and, in a further row for every TOGETHER shingles (n = -1), the tokens that OFTEN of those rows have."""
    names = ["_id", "_key", "sid", "n", "sig", "seeds", "often", "times"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, held = [], 0

        def counted() -> pa.RecordBatch:
            token, times = np.unique(np.concatenate(every), return_counts=True)
            often = times >= OFTEN
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip((None, None, None, -1, None, None, token[often].tolist(), times[often].tolist()), kinds, strict=True)], names)

        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch, rows, seeds = whole.slice(at, 2000), [], []
                for i, k, flow in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shingles(_texts(batch), words), strict=True):
                    s = np.unique(flow)
                    every.append(s)
                    held += len(s)
                    seeds.append(s[s & (SEEDS - 1) == 0])
                    rows.append((i, k, _sid(s), len(s), signature(s)) if len(s) else (i, k, None, 0, None))
                cols = [pa.array([r[c] for r in rows], kinds[c]) for c in range(5)]
                yield pa.RecordBatch.from_arrays([*cols, _lists(seeds), *(pa.array([None] * len(rows), kind) for kind in kinds[6:])], names)
                if held > TOGETHER:
                    yield counted()
                    every, held = [], 0
        if every:
            yield counted()

    return run


def _sid(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _common(tokens: DataFrame) -> pd.DataFrame:
    """Tokens (t, c) of more than FREQUENT rows, the COMMON most frequent at most."""
    return tokens.groupBy("t").agg(F.sum("c").alias("c")).where(F.col("c") > FREQUENT).orderBy(F.desc("c"), "t").limit(COMMON).toPandas()


def _most(*counted: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """The COMMON most frequent tokens of all, with their counts; and these tokens, sorted."""
    whole = pd.concat(counted).sort_values(["c", "t"], ascending=[False, True]).drop_duplicates("t").head(COMMON)
    return whole, np.sort(whole["t"].to_numpy(np.int64))


def _bounded(sig_a: bytes | None, sig_b: bytes | None) -> int:
    """A lower bound of the symmetric difference."""
    if sig_a is None or sig_b is None:
        return 0
    a, b = (np.frombuffer(x, np.uint8).astype(np.int32) for x in (sig_a, sig_b))
    while len(a) > len(b):
        a = a[0::2] + a[1::2]
    while len(b) > len(a):
        b = b[0::2] + b[1::2]
    return int(np.abs(a - b).sum())


def similar_sets(both: int, a: int, b: int, similar: int = SIMILAR) -> bool:
    return 100 * both >= similar * (a + b - both)


class Union:
    def __init__(self, n: int):
        self.up, self.size = list(range(n)), [1] * n

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            if self.size[a] < self.size[b]:
                a, b = b, a
            self.up[b] = a
            self.size[a] += self.size[b]


def connect(sets: list[np.ndarray], ask: list[bool], similar: int) -> list[tuple[int, int]]:
    """Links that connect what is similar among sets, for the pairs of which one is to be asked.

    The overlaps of the first set with all others come from the token lists. Those of a
    later set are derived from them by the tokens in which the two differ. A set in the
    largest component waits: the sets outside it find their links to it. At the end it is
    asked after all if it is no longer in the largest one, or if a set outside that one is
    not to be asked, and so finds no links itself.
    """
    m, size = len(sets), np.array([len(s) for s in sets])
    flat, who = np.concatenate(sets), np.repeat(np.arange(m), size)
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    tokens, starts = np.unique(flat, return_index=True)
    ends = np.append(starts[1:], len(flat))

    def overlaps(s: np.ndarray) -> np.ndarray:
        at = np.searchsorted(tokens, s)
        return np.bincount(np.concatenate([who[starts[i] : ends[i]] for i in at]), minlength=m) if len(at) else np.zeros(m, np.int64)

    # The set whose tokens are the most common ones lies in the middle of the list.
    width = (ends - starts)[np.searchsorted(tokens, flat)]
    middle = np.bincount(who, weights=width, minlength=m) / np.maximum(size, 1)
    turn = np.argsort(-middle, kind="stable")
    first = sets[turn[0]]
    base = overlaps(first)
    union, links, main, waiting = Union(m), [], int(turn[0]), []

    def link(x: int) -> None:
        if x == turn[0]:
            both = base
        elif 2 * base[x] >= size[x]:
            both = base - overlaps(np.setdiff1d(first, sets[x], assume_unique=True)) + overlaps(np.setdiff1d(sets[x], first, assume_unique=True))
        else:
            both = overlaps(sets[x])
        for y in np.flatnonzero(100 * both >= similar * (size[x] + size - both)).tolist():
            if union.find(x) != union.find(y):
                union.join(x, y)
                links.append((x, y))

    for x in turn.tolist():
        if not ask[x]:
            continue
        if union.find(x) == union.find(main) and x != turn[0]:
            waiting.append(x)
            continue
        link(x)
        if union.size[union.find(x)] > union.size[union.find(main)]:
            main = x
    # From here on the largest component stays the same one, so what is passed over in it stays in it.
    told = [x for x in range(m) if not ask[x]]
    for x in waiting:
        while told and union.find(told[-1]) == union.find(main):
            told.pop()
        if told or union.find(x) != union.find(main):
            link(x)
    return links


def _links_in_blocks(rows: DataFrame, keys: list[str], similar: int) -> DataFrame:
    """Links within each group of rows (keys, sid, ask, tokens), a group at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(group: dict[int, tuple[bool, np.ndarray]]) -> list[tuple[int, int]]:
            sid = list(group)
            if len(sid) < 2:
                return []
            return [(sid[x], sid[y]) for x, y in connect([group[i][1] for i in sid], [group[i][0] for i in sid], similar)]

        now, group, out = None, {}, []
        for batch in batches:
            keyed = list(zip(*(batch.column(k).to_pylist() for k in range(len(keys))), strict=True))
            sid, ask = batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist()
            lists = batch.column(len(keys) + 2)
            for k, key in enumerate(keyed):
                if key != now:
                    out += done(group)
                    now, group = key, {}
                if sid[k] not in group or ask[k]:
                    group[sid[k]] = (ask[k], lists[k].values.to_numpy(zero_copy_only=False))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], ["a", "b"])
                out = []
        out += done(group)
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], ["a", "b"])

    return rows.select(*keys, "sid", "ask", "tokens").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(trimmed(run), "a bigint, b bigint")


def _with_tokens(own: DataFrame, asked: DataFrame, words: int) -> DataFrame:
    """asked (rep, further columns) with sid and tokens, the whole sets, from the documents that stand for the classes."""
    asked = materialise(asked.withColumnRenamed("rep", "_key"), "asked")
    keys = asked.select("_key").distinct()
    small = asked.count() <= BROADCAST_KEYS
    chosen = own.join(F.broadcast(keys) if small else keys, "_key", "left_semi")
    sets = _map_sets(chosen, "_key bigint, tokens array<bigint>", lambda i, key, flow: (key, np.unique(flow)), words)
    return sets.join(F.broadcast(asked) if small else asked, "_key")


def _links_in_clusters(own: DataFrame, members: DataFrame, words: int, similar: int) -> DataFrame:
    """Links that connect the similar classes of each cluster: members (t, sid, n, rep).

    A cluster is dealt into blocks of bounded size, each connected in a task. Where it
    has several blocks, every set outside its largest component is then compared with
    all blocks, so no pair is left out but those within that component.
    """
    blocks = F.greatest(F.ceil(F.sum("n") / BLOCK_TOKENS), F.ceil(F.count(F.lit(1)) / BLOCK_SETS)).cast("int")
    sizes = materialise(members.groupBy("t").agg(blocks.alias("k"), F.count(F.lit(1)).alias("c")), "sizes")
    members = materialise(join_one(members, sizes, "t", "c", members.count()).withColumn("block", F.pmod(F.xxhash64("sid", "t"), F.col("k")).cast("int")), "members")
    first = _with_tokens(own, members.select("rep", "sid", "t", "block", F.lit(True).alias("ask")), words)
    links = materialise(_links_in_blocks(first, ["t", "block"], similar), "links")
    parted = members.where("k > 1")
    if parted.isEmpty():
        return links
    label = components(links)
    parted = parted.drop("c").join(label.select(F.col("node").alias("sid"), "component"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    parted = materialise(parted, "parted")
    largest = parted.groupBy("t", "component").agg(F.count(F.lit(1)).alias("m")).groupBy("t").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.sum("m").alias("c"))
    total = parted.count()
    parted = materialise(join_one(parted, materialise(largest, "largest"), "t", "c", total).drop("c"), "sided")
    apart = parted.where("component <> main")
    asked = materialise(apart.groupBy("t").agg(blocks.alias("ku"), F.lit(total).alias("c")), "apart")
    each = join_one(parted, asked, "t", "c", total)
    ask = each.where("component <> main").select("rep", "sid", "t", F.pmod(F.xxhash64("t", "sid"), F.col("ku")).cast("int").alias("u"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("block"), F.lit(True).alias("ask"))
    told = each.select("rep", "sid", "t", F.explode(F.sequence(F.lit(0), F.col("ku") - 1)).alias("u"), "block", F.lit(False).alias("ask"))
    more = _links_in_blocks(_with_tokens(own, ask.unionByName(told), words), ["t", "u", "block"], similar)
    return links.unionByName(materialise(more, "more"))


def _lists_of(own: DataFrame, common: np.ndarray, held, words: int, similar: int) -> DataFrame:
    """Index lists of two members and more: t, sid, n, pos, m (members); common tokens are last in the order of all sets."""
    last = own.sparkSession.sparkContext.broadcast(common)

    def prefixed(i, key, flow):
        s = np.unique(flow)
        if not len(s) or held.value.get(sid := _sid(s), key) != key:
            return None
        hot = _member(last.value, s)
        return sid, len(s), np.concatenate([s[~hot], s[hot]])[: prefix_len(len(s), similar)]

    listed = _map_sets(own, "sid bigint, n int, prefix array<bigint>", prefixed, words).select("sid", "n", F.posexplode("prefix").alias("pos", "t"))
    by_token = listed.repartition("t").dropDuplicates(["t", "sid"])
    return by_token.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("t"))).where("m > 1")


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """A row for each document: id, n_shingles, component_id (least id reachable by links), class_id (equal sets), group_id (linked classes), _key (of the row)."""
    spark = docs.sparkSession
    modest(spark)
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_key"), F.col(text_col).alias("_text"))

    schema = "_id bigint, _key bigint, sid bigint, n int, sig binary, seeds array<bigint>, often array<bigint>, times array<int>"
    told = materialise(own.mapInArrow(trimmed(_described(words)), schema), "sets")
    every = told.where("n >= 0")
    some = every.where("sid is not null")
    classes = materialise(some.groupBy("sid").agg(F.min("_key").alias("rep"), F.count(F.lit(1)).alias("c"), F.min("_id").alias("least"), F.first("n").alias("n")), "classes")
    copied = classes.where(F.col("c") > COPIES).orderBy(F.desc("c"), "sid").limit(COPIED).select("sid", "rep")
    rep = {r.sid: r.rep for r in copied.collect()}
    held = spark.sparkContext.broadcast(rep)

    # Which tokens are common: first among the seeds of all sets, then among all tokens that stand near a common seed.
    first = some.join(F.broadcast(copied), "sid", "left").where("rep is null or rep = _key")
    often = told.where("n < 0").select(F.inline(F.arrays_zip("often", "times"))).select(F.col("often").alias("t"), F.col("times").cast("long").alias("c"))
    counts, common = _most(_common(first.select(F.explode("seeds").alias("t"), F.lit(1).cast("long").alias("c"))), _common(often))
    if len(common):
        seen = spark.sparkContext.broadcast(common)

        def involved(i, key, flow):
            at = np.flatnonzero(_member(seen.value, flow))
            if not len(at) or held.value.get(_sid(np.unique(flow)), key) != key:
                return None
            edge = np.zeros(len(flow) + 1, np.int64)
            gap = np.diff(at, append=len(flow) + GAP + 1)
            np.add.at(edge, np.maximum(at - NEAR, 0), 1)
            np.add.at(edge, np.minimum(at + np.where(gap <= GAP, gap, NEAR) + 1, len(flow)), -1)
            return (np.unique(flow[np.cumsum(edge[:-1]) > 0]),)

        counts, common = _most(counts, _common(_map_sets(own, "s array<bigint>", involved, words).select(F.explode("s").alias("t"), F.lit(1).cast("long").alias("c"))))
    for turn in range(TURNS):
        lists = materialise(_lists_of(own, common, held, words, similar), "lists")
        long = lists.where(F.col("m") > SHORT).groupBy("t").agg(F.first("m").cast("long").alias("c"))
        late = long.where(F.col("c") > SHORT).orderBy(F.desc("c"), "t").limit(COMMON).toPandas()
        late = late[~_member(common, late["t"].to_numpy(np.int64))]
        # Common tokens that were missed are ordered last too, unless they are hardly worth another pass.
        if turn + 1 == TURNS or late["c"].sum() * 20 <= classes.count():
            break
        counts, common = _most(counts, late)

    short = lists.where(F.col("m") <= SHORT)
    a, b = (short.select("t", *[F.col(c).alias(f"{c}_{x}") for c in ("sid", "n", "pos")]) for x in "ab")
    least, most = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    # Even if all before and after the shared token were shared too, the overlap must suffice.
    reach = F.least("pos_a", "pos_b") + 1 + F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) - 1
    met = a.join(b, "t").where((F.col("sid_a") < F.col("sid_b")) & (100 * least >= similar * most) & ((100 + similar) * reach >= similar * (F.col("n_a") + F.col("n_b"))))
    # A token of a long list may be among those they share; then that list brings the two together.
    enough = F.least(F.lit(SHARED), F.ceil(F.greatest("n_a", "n_b") * similar / 100))
    pairs = met.groupBy("sid_a", "sid_b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= enough)
    sig = some.groupBy("sid").agg(F.first("sig").alias("sig"))
    pairs = pairs.join(sig.select(F.col("sid").alias("sid_a"), F.col("sig").alias("sig_a")), "sid_a").join(sig.select(F.col("sid").alias("sid_b"), F.col("sig").alias("sig_b")), "sid_b")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.to_pydict()
            keep = [(100 + similar) * _bounded(x, y) <= (100 - similar) * (m + n) for x, y, m, n in zip(d["sig_a"], d["sig_b"], d["n_a"], d["n_b"], strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in (batch.column(batch.schema.get_field_index(n)) for n in ("sid_a", "sid_b", "n_a", "n_b"))], ["sid_a", "sid_b", "n_a", "n_b"])

    pairs = materialise(pairs.select("sid_a", "sid_b", "n_a", "n_b", "sig_a", "sig_b").mapInArrow(trimmed(bounded), "sid_a bigint, sid_b bigint, n_a int, n_b int"), "pairs")

    # Classes that a pair or a long list brings together form a cluster; its sets are compared whole, each sent once.
    long = lists.where(F.col("m") > SHORT)
    star = join_one(long, materialise(long.groupBy("t").agg(F.min("sid").alias("head"), F.count(F.lit(1)).alias("c")), "heads"), "t", "c", long.count())
    together = components(pairs.select(F.col("sid_a").alias("a"), F.col("sid_b").alias("b")).unionByName(star.select(F.col("head").alias("a"), F.col("sid").alias("b"))))
    members = together.select(F.col("node").alias("sid"), F.col("component").alias("t")).join(classes.select("sid", "n", "rep"), "sid")
    links = _links_in_clusters(own, materialise(members, "clusters"), words, similar)

    label = components(links)
    named = classes.join(label.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    least_id = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialise(named.join(least_id, "component").select("sid", "component_id", "component", "c"), "named")

    got = every.select("_id", "_key", "sid", "n")
    with_set = join_one(got.where("sid is not null"), named, "sid", "c", some.count())
    cols = ["_id", "_key", "n", "component_id", "sid", "component"]
    out = with_set.select(cols).unionByName(got.where("sid is null").select("_id", "_key", "n", F.col("_id").alias("component_id"), "sid", F.lit(None).cast("long").alias("component")))
    return out.select(F.col("_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id", F.col("sid").alias("class_id"), F.col("component").alias("group_id"), "_key")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """docs with one row of each group of linked documents: that of least id (null last). Rows without words are no group and stay."""
    marked = materialise(ngram_join(docs, id_col, text_col, words, similar), "marked")
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("_key").alias("key")))
    chosen = marked.where("group_id is not null").groupBy("group_id").agg(first.alias("x")).select(F.col("x.key").alias("_key"), F.col("x.id").alias("_id"))
    rows = marked.where("group_id is not null").groupBy("_key", F.col(id_col).alias("_id")).agg(F.count(F.lit(1)).alias("c"))
    chosen = materialise(chosen.join(rows, (chosen["_key"] == rows["_key"]) & chosen["_id"].eqNullSafe(rows["_id"])).select(chosen["_key"], chosen["_id"], "c"), "chosen")
    at_key, at_id = unused(docs, "_wl_key", "_wl_id")
    keyed = docs.withColumns({at_key: F.xxhash64(F.col(id_col), F.col(text_col)), at_id: F.col(id_col).cast("long")})
    wordless = keyed.where(F.coalesce(F.length(F.translate(text_col, SPACE, "")), F.lit(0)) == 0)

    def met(keys: DataFrame) -> DataFrame:
        keys = keys.select("_key", "_id")
        keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
        return keyed.join(keys, (keyed[at_key] == keys["_key"]) & keyed[at_id].eqNullSafe(keys["_id"]), "left_semi")

    names = [f"`{c}`" for c in docs.columns]
    single, several = met(chosen.where("c = 1")), met(chosen.where("c > 1")).dropDuplicates([at_key])
    return single.select(names).unionByName(several.select(names)).unionByName(wordless.select(names))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT r, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS sh FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y FROM s a JOIN s b ON a.sh = b.sh AND a.r < b.r JOIN n na ON na.r = a.r JOIN n nb ON nb.r = b.r GROUP BY a.r, b.r, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
e AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
t(r, q) AS (SELECT r, r FROM d UNION SELECT t.r, e.y FROM t JOIN e ON t.q = e.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id FROM d LEFT JOIN n USING (r) JOIN (SELECT t.r, min(d.doc_id) AS component_id FROM t JOIN d ON d.r = t.q GROUP BY t.r) m USING (r)
"""

"""Line dedup, suffix dedup and the n-gram join against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import components, line_dedup, ngram_join, suffix_dedup

SCHEMA = "doc_id bigint, text string"
rnd = random.Random(11)
VOCAB = [f"w{i}" for i in range(400)]


def words(n):
    return [rnd.choice(VOCAB) for _ in range(n)]


def test_lines_keep_the_earliest(spark):
    rows = [(2, "a b c d e\nshort\nA  b c\td e\nz z z z z"), (1, "x y z u v\na b c d e"), (None, "x y z u v\r\nonly here one two"), (3, None), (4, ""), (1, "x y z u v\na b c d e")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("removed", "cut", "_key", "_marks", "_wl_key", "n_repeated")})
    out = line_dedup.substring_dedup(docs, unit="line", run_words=5)
    assert {"_key", "_marks", "_wl_key", "cut"} < set(out.columns)
    assert {r[c] for r in out.collect() for c in ("_key", "_marks", "_wl_key", "cut")} == {"clash"}
    got = sorted(((r.doc_id is None, r.doc_id), r.text, r.n_repeated, r.n_removed, r.removed) for r in out.collect())
    assert [g[1:] for g in got] == [("x y z u v\na b c d e", 2, 0, "")] * 2 + [("short\nz z z z z", 2, 2, "0:9,16:26")] + [(None, 0, 0, "")] + [("", 0, 0, "")] + [("only here one two", 1, 1, "0:10")]
    assert line_dedup.substring_dedup(docs.where("false")).count() == 0


def test_paragraphs(spark):
    docs = spark.createDataFrame([(1, "a b c d e\nf\n\n  g h i j k\n\nl"), (2, "q\n\nA b c d e f")], SCHEMA)
    got = {r.doc_id: r.text for r in line_dedup.substring_dedup(docs, unit="paragraph", run_words=5).collect()}
    assert got == {1: "a b c d e\nf\n\n  g h i j k\n\nl", 2: "q"}


def sentence_truth(rows):
    """Sentences by a scan over the characters: (n_units, n_repeated, removed, text) of each distinct row."""
    space, found = " \t\x0b\x0c\r", {}
    for i, t in dict.fromkeys(rows):
        units = []  # line, start, end, words
        for k, line in enumerate((t or "").split("\n")):
            at = sum(len(x) + 1 for x in (t or "").split("\n")[:k])
            cuts = [0, *(j for j in range(1, len(line)) if line[j - 1] in space and line[j] not in space and line[:j].rstrip(space)[-1:] in {".", "!", "?"}), len(line)]
            own: list = []
            short = None
            for a, b in zip(cuts, cuts[1:], strict=False):
                w = line[a:b].encode().lower().split()
                if not w:
                    continue
                short = [k, at + a, at + b, w] if short is None else [k, short[1], at + b, short[3] + w]
                if len(w) >= line_dedup.MIN_WORDS:
                    own.append(short)
                    short = None
            if short and own:
                own[-1] = [k, own[-1][1], short[2], own[-1][3] + short[3]]
            elif short:
                own.append(short)
            units += own
        found[i, t] = units
    where: dict = {}
    for (i, t), units in found.items():
        for p, u in enumerate(units):
            where.setdefault(tuple(u[3]), []).append((i is None, i or 0, hashlib.md5((("\x01" if i is None else str(i)) + "\0" + ("\x02" if t is None else t)).encode()).hexdigest(), p, (i, t)))
    out = {}
    for (i, t), units in found.items():
        twice = [len(where[tuple(u[3])]) > 1 for u in units]
        counts, gone = set(), set()
        for p in range(len(units)):
            a = b = p
            while twice[p] and a > 0 and twice[a - 1]:
                a -= 1
            while twice[p] and b + 1 < len(units) and twice[b + 1]:
                b += 1
            if twice[p] and sum(len(u[3]) for u in units[a : b + 1]) >= line_dedup.RUN_WORDS:
                counts.add(p)
                if min(where[tuple(units[p][3])])[3:] != (p, (i, t)):
                    gone.add(p)
        text = t
        if gone:
            lines = []
            for k, line in enumerate(t.split("\n")):
                at = sum(len(x) + 1 for x in t.split("\n")[:k])
                own = [p for p, u in enumerate(units) if u[0] == k]
                if own and set(own) <= gone:
                    continue
                lines.append("".join(c for j, c in enumerate(line, at) if not any(p in gone and units[p][1] <= j < units[p][2] for p in own)))
            text = "\n".join(lines)
        out[i, t] = (len(units), len(counts), ",".join(f"{units[p][1]}:{units[p][2]}" for p in sorted(gone)), text)
    return out


def test_sentences(spark):
    sentence = lambda n: " ".join(words(n)).capitalize() + rnd.choice([".", "!", "?..", ". "])
    stock = [sentence(rnd.choice([2, 5, 7, 12])) for _ in range(12)]
    passage = " ".join(sentence(rnd.choice([3, 9, 15])) for _ in range(6))
    rows = [(i, rnd.choice(["", " ", "Ä. "]) + "".join((rnd.choice(stock) if rnd.random() < 0.75 else sentence(rnd.choice([1, 4, 8]))) + rnd.choice([" ", "\n", "  ", "\n\n", ""]) for _ in range(rnd.randint(1, 14)))) for i in range(60)]
    rows += [(100 + i, f"{i} once here. {passage}{' and' * i}.\nEnd {i}") for i in range(4)]
    rows += [(7, rows[7][1]), (200, rows[7][1]), (None, rows[8][1]), (None, None), (201, ""), (202, passage + "\n" + passage), (203, "x." * 200_000)]
    want = sentence_truth(rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = [(r.doc_id, r.n_units, r.n_repeated, r.removed, r.text) for r in line_dedup.substring_dedup(docs.withColumn("was", F.col("text"))).collect()]
    assert sorted(map(str, got)) == sorted(str((i, *want[i, t])) for i, t in rows)
    assert sum(x[2] for x in got) > 60 and sum(":" in x[3] for x in got) > 10


def runs(marks):
    edges = np.diff(np.concatenate([[0], marks.astype(int), [0]]))
    return ",".join(f"{a}:{b}" for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True))


def covered(texts, n=suffix_dedup.LENGTH, m=suffix_dedup.PASSAGE):
    seen, owners = {}, {}
    for k, t in enumerate(texts):
        for i in range(len(t) - n + 1):
            seen[t[i : i + n]] = seen.get(t[i : i + n], 0) + 1
        for i in range(len(t) - m + 1):
            owners.setdefault(t[i : i + m], set()).add(k)
    out = []
    for t in texts:
        mark, shared = np.zeros(len(t), bool), np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                mark[i : i + n] = True
        for i in range(len(t) - m + 1):
            if len(owners[t[i : i + m]]) > 1:
                shared[i : i + m] = True
        spans = runs(mark)
        out.append((len(t), int(mark.sum()), spans.count(":"), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~mark])).hexdigest(), spans, int(shared.sum()), runs(shared)))
    return out


def suffix_texts():
    a, b, c = (" ".join(words(300)) for _ in range(3))
    p = " ".join(words(120))
    return [a, a, b + p[:399], c + p[:399], b[:50] + p[:400], c[:50] + p[:400] + c[:30], p[1:], "é" * 500, "x" * 399, "x" * 1000, "ab" * 300, p + "|" + p, a[:700] + "!" + a[701:], "", "\U0001f600" * 101 + "q" + "\U0001f600" * 101, *(f"{i} " * 60 + p[100:600] + f" {i}" * 40 for i in range(30)), *(f"{i}: " * 90 + c[i : 300 + i] + f" {i}" * 90 for i in range(0, 60, 5)), a[100:379], "q" + a[100:380]]


@pytest.mark.parametrize("group", [suffix_dedup.GROUP, 4])
def test_suffixes(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    texts = suffix_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, None), (None, texts[8])]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("spans", F.lit(0))
    want = covered([(t or "").encode() for _, t in rows])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.spans, r.n_shared, r.shared) for r in suffix_dedup.suffix_dedup(docs).collect() if r.doc_id is not None}
    assert {i: want[i] for i in range(len(texts))} == got
    assert suffix_dedup.suffix_dedup(docs).count() == len(rows)
    assert suffix_dedup.suffix_dedup(docs.where("false")).count() == 0


def test_repeated_rows_are_copies(spark):
    t = " ".join(words(200))
    docs = spark.createDataFrame([(1, t), (1, t), (2, "other")], SCHEMA)
    assert sorted((r.doc_id, r.n_removed, r.n_shared) for r in suffix_dedup.suffix_dedup(docs).collect()) == [(1, len(t), len(t)), (1, len(t), len(t)), (2, 0, 0)]


@pytest.mark.parametrize("segment", [700, 1000, 1 << 19])
def test_every_window_has_an_anchor(monkeypatch, segment):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
    for text in (" ".join(words(900)), "ab" * 1500, " ".join(words(50)), "x" * 279):
        data = np.frombuffer(text.encode(), np.uint8)
        place, start, end, _ = suffix_dedup.anchors(data)
        for length in (suffix_dedup.LENGTH, suffix_dedup.PASSAGE):
            for i in range(len(data) - length + 1):
                at = place[(start <= i) & (end >= i + length) & (place >= i) & (place <= i + length - suffix_dedup.GRAM)].tolist()
                assert at
                if length == suffix_dedup.LENGTH:  # else a window would count twice
                    assert len(at) == len(set(at))


def test_suffix_sort_is_a_sort_and_collisions_are_caught():
    gen = np.random.default_rng(5)
    contexts, behind = [], []
    for _ in range(60):
        left = int(gen.integers(0, suffix_dedup.SPAN))
        right = int(gen.integers(max(suffix_dedup.GRAM, suffix_dedup.LENGTH - left), suffix_dedup.LENGTH + 1))
        copy = len(contexts) > 3 and len(contexts) % 3 == 0
        contexts.append(contexts[-3] if copy else bytes(gen.integers(97, 99, left + right, dtype=np.uint8)) if len(contexts) % 3 else b"a" * (left + right))
        behind.append(behind[-3] if copy else left)
    s = suffix_dedup.Sorted(np.repeat([1, 2], 30), np.array(behind), contexts)
    for rightwards in (True, False):
        order, common = s.sort(rightwards)
        assert sorted(order.tolist()) == list(range(60))
        ext = [c[b:] if rightwards else c[:b][::-1] for c, b in zip(contexts, behind, strict=True)]
        for k in range(1, 60):
            i, j = order[k - 1], order[k]
            if s.group[i] == s.group[j]:
                assert ext[i] <= ext[j]
                assert common[k] == next((n for n, (x, y) in enumerate(zip(ext[i], ext[j], strict=False)) if x != y), min(len(ext[i]), len(ext[j])))
    want = s.repeated()
    s.hashes[:] = 0  # every comparison by hash now says equal
    got = s.repeated()
    assert [x.tolist() for x in got] == [x.tolist() for x in want]


def truth(rows, n=5, similar=80):
    sets = [frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]) for w in ((t or "").encode().lower().split() for _, t in rows)]
    union = ngram_join.Union(len(rows))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= similar * (len(a) + len(sets[j]) - both):
                union.join(i, j)
    least: dict = {}
    for i, (k, _) in enumerate(rows):
        r = union.find(i)
        least[r] = k if least.get(r) is None else least[r] if k is None else min(k, least[r])
    return [(k, len(s), least[union.find(i)]) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))]


def near_rows():
    rows, base = [], words(120)
    for i in range(60):  # one family round the threshold
        w = list(base)
        for _ in range(i % 5):
            w[rnd.randrange(120)] = f"n{i}"
        rows.append((1000 - i, " ".join(w)))
    line = " ".join(words(20))
    rows += [(i, " ".join(words(60)) + "\n" + line) for i in range(40)]  # a common passage is no link
    rows += [(200, None), (201, ""), (202, "a b"), (203, "A  b"), (204, "a b c"), (None, rows[0][1]), (None, "nowhere else is this text seen"), (205, "É b c d e f"), (206, "é b c d e f"), (202, "a b")]
    exact = [f"t{i}" for i in range(13)]  # 9 shingles, and 8 of 10: on the threshold
    rows += [(300, " ".join(exact)), (301, " ".join([*exact[:12], "u"]))]
    return rows


@pytest.mark.parametrize("short,block", [(128, 4096), (3, 4096), (3, 8)])
def test_ngram_join(spark, monkeypatch, short, block):
    monkeypatch.setattr(ngram_join, "SHORT", short)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    rows = near_rows()
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("sid", F.lit("clash"))
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(truth(rows), key=key)


def bridged_rows():
    """A family round one text, and pairs of which one text is similar to that text alone and the other to its partner alone."""
    base = [f"b{i}" for i in range(120)]

    def changed(*places):
        w = list(base)
        for p in places:
            w[p] = f"n{rnd.random()}"
        return " ".join(w)

    spots = [(a, b) for a in range(60, 115, 5) for b in range(a + 5, 115, 5)]
    rows = [" ".join(base)] + [changed(i) for i in range(5, 45)]
    for a, b in spots[:24]:
        x = changed(a, b).split()
        c, d = [p for p in range(60, 115, 5) if p not in (a, b)][:2]
        rows += [" ".join(x), " ".join("far" + str(rnd.random()) if i in (c, d) else w for i, w in enumerate(x))]
    return list(enumerate(rows))


def test_single_bridges_between_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SHORT", 3)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 8)
    rows = bridged_rows()
    want = truth(rows)
    assert {c for _, _, c in want} == {0}
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_join(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got) == sorted(want)


CHAIN = [range(0, 10), range(10, 20), range(2, 14), range(9, 20), range(8, 19), range(8, 18), range(11, 21)]


@pytest.mark.parametrize("share", [1.0, 0.5, 0.2])
def test_connect_asks_what_no_other_set_finds(share):
    gen = random.Random(17)
    cases = [[np.arange(r.start, r.stop) for r in CHAIN]]
    for _ in range(400):
        spans = {(a, a + gen.choice([9, 10, 10, 11, 12])) for a in (gen.randint(0, 14) for _ in range(12))}
        cases.append([np.arange(*x) for x in gen.sample(sorted(spans), len(spans))])
    for sets in cases:
        m, ask = len(sets), [gen.random() < share for _ in sets]
        near = [(a, b) for a in range(m) for b in range(a) if ngram_join.similar_sets(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]))]
        want, got = ngram_join.Union(m), ngram_join.Union(m)
        for a, b in near:
            if ask[a] or ask[b]:
                want.join(a, b)
        for a, b in ngram_join.connect(sets, ask, 80):
            assert (max(a, b), min(a, b)) in near
            got.join(a, b)
        assert all((want.find(a) == want.find(b)) == (got.find(a) == got.find(b)) for a in range(m) for b in range(a))


def test_keep_one(spark):
    rows = near_rows()
    kept = ngram_join.keep_one(spark.createDataFrame(rows, SCHEMA).withColumn("_key", F.lit("clash"))).collect()
    assert {r._key for r in kept} == {"clash"}
    groups = truth(rows)
    alone = [r for r in groups if r[1] == 0]
    assert len(kept) == len(alone) + len({r[2] for r in groups if r[1] and r[2] is not None}) + 1  # one group has no id at all
    assert ngram_join.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0
    assert ngram_join.ngram_join(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(200) if i % 50 != 49] + [(1000 + i, 999) for i in range(300)] + [(7, 7), (5000, 5001), (5001, 5000)]
    got = dict(components.components(spark.createDataFrame(edges, "a bigint, b bigint")).select("node", "component").collect())
    want = {i: i // 50 * 50 for i in range(200)} | {999: 999} | {1000 + i: 999 for i in range(300)} | {5000: 5000, 5001: 5000}
    assert got == want
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_of_odd_edges(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (1, 2), (5, 5), (None, 3), (4, None), (2, 9)], "a bigint, b bigint").withColumn("component", F.lit("clash"))
    assert sorted((r.node, r.component) for r in components.components(edges).collect()) == [(1, 1), (2, 1), (9, 1)]
    assert components.components(edges.where("false")).count() == 0

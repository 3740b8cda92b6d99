"""Tokenizers, language model, tiling, classifier and pipeline."""

from __future__ import annotations

import math
import os
import random
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import decontaminate, lm_score, quality_classifier, spm_codec

SCHEMA = "doc_id bigint, text string"
ODD = [None, "", " ", "   a  b", "\n\n", "<s>hi</s> <unk> <0x0A>", "日本語 テスト", "▁x ▁", "a" * 3000, " " * 37 + "x" + " " * 9, "\x00\t\r\n a\n b\n\nc", "é😀" * 20, "aaaa bbbb abababab " * 50, "\n x", "x\n", "\r\n\r\n", "tail "]
MODEL = pytest.mark.skipif(not os.path.exists(spm_codec.MODEL_PATH), reason="no model file here")


@MODEL
def test_ids_are_the_library_s_and_decode(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=spm_codec.MODEL_PATH)
    docs = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(ODD)] + [(3, ODD[3])], SCHEMA).withColumn("ids", F.lit("clash"))
    got = spm_codec.decode(spm_codec.encode(docs)).collect()
    assert len(got) == len(ODD) + 1
    for r in got:
        text = r.text or ""
        assert r.ids == lib.encode(text) and r.parity and r.n_tokens == len(r.ids)
        assert r.decoded == text.replace(spm_codec.MARK, " ")
        assert r.round_trip == (spm_codec.MARK not in text)
    assert spm_codec.encode(docs.where("false")).count() == 0


@MODEL
def test_small_cache_and_whole_texts_give_the_same(monkeypatch):
    with open(spm_codec.MODEL_PATH, "rb") as f:
        data = f.read()
    texts = [t or "" for t in ODD]
    codec = spm_codec.Codec(data)
    assert codec.by_word
    by_word, _, back = codec.encode(texts)
    codec.by_word = False
    whole, same, whole_back = codec.encode(texts)
    assert all(same) and [x.tolist() for x in by_word] == [x.tolist() for x in whole]
    assert back == whole_back == [spm_codec.MARK not in t for t in texts]
    codec.by_word = True
    monkeypatch.setattr(spm_codec, "KEPT_WORDS", 1)
    assert [codec.encode([t])[0][0].tolist() for t in texts] == [x.tolist() for x in whole]


def field(number: int, value) -> bytes:
    if isinstance(value, float):
        return bytes([number << 3 | 5]) + struct.pack("<f", value)
    if isinstance(value, int):
        tag, out = number << 3, bytearray()
        for n in (tag, value):
            while n > 0x7F:
                out.append(n & 0x7F | 0x80)
                n >>= 7
            out.append(n)
        return bytes(out)
    raw = value.encode() if isinstance(value, str) else value
    size, out, tag = len(raw), bytearray(), number << 3 | 2
    for n in (tag, size):
        while n > 0x7F:
            out.append(n & 0x7F | 0x80)
            n >>= 7
        out.append(n)
    return bytes(out) + raw


def unigram_model() -> bytes:
    """A hand-made unigram model with byte fallback."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", -20.0, 6) for b in range(256)), ("▁", -3.0, 1), ("a", -4.0, 1), ("b", -4.5, 1), ("ab", -5.0, 1), ("▁a", -4.2, 1), ("aba", -6.5, 1), ("ba", -6.1, 1), ("▁ab", -6.0, 1)]
    out = b"".join(field(1, field(1, p) + field(2, s) + (field(3, k) if k != 1 else b"")) for p, s, k in pieces)
    trainer = field(3, 1) + field(35, 1)
    return out + field(2, trainer) + field(3, field(1, "identity") + field(3, 1) + field(4, 0) + field(5, 1))


def test_unigram_scores_are_rebuilt():
    codec = spm_codec.Codec(unigram_model())
    texts = ["abab ab", "aab ba", "c", "", "ab c\nabba", "baaab  b"]
    ids, same, back = codec.encode(texts)
    assert all(same) and all(back)
    assert [x.tolist() for x in ids] == codec.model.encode(texts)
    whole = [e.ids for e in codec.tok.encode_batch(texts, add_special_tokens=False)]
    assert whole == codec.model.encode(texts)


@MODEL
def test_rebuilt_parts_on_whole_texts():
    """Normaliser, marker, byte fallback and decoder of the rebuilt tokenizer, by themselves, against the library."""
    with open(spm_codec.MODEL_PATH, "rb") as f:
        codec = spm_codec.Codec(f.read())
    for t in [t for t in ODD if t]:
        assert codec.tok.normalizer.normalize_str(t) == codec.model.normalize(t)
        got = codec.tok.encode(t, add_special_tokens=False)
        assert got.ids == codec.model.encode(t) and got.tokens == codec.model.encode(t, out_type=str)
        assert codec.tok.decode(got.ids, skip_special_tokens=False) == codec.model.decode(got.ids)
    assert all(codec.bytes[codec.tok.encode("\U0001f9ff", add_special_tokens=False).ids[1:]])


def test_where_the_libraries_differ_the_row_says_so(monkeypatch):
    """Ids are the rebuilt tokenizer's; a text on which it differs gets the library's and is marked."""
    codec = spm_codec.Codec(unigram_model())

    class Other:
        def encode(self, texts, **kw):
            return [[7, 7] if "ba" in t else codec_ids(t) for t in texts]

    real = codec.model
    codec_ids = real.encode
    codec.model, codec.by_word = Other(), False
    ids, same, back = codec.encode(["ab", "ba"])
    assert same == [True, False] and ids[0].tolist() == real.encode("ab") and ids[1].tolist() == [7, 7] and back == [True, False]


def lm_truth(rows, order=3, backoff=0.4):
    docs = [(t or "").encode().lower().split() for _, t in rows]
    grams = lambda w: Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
    whole, total = sum((grams(w) for w in docs), Counter()), sum(map(len, docs))
    out = []
    for (k, _), w in zip(rows, docs, strict=True):
        own, rest, lp = grams(w), max(1, total - len(w)), 0.0
        count = lambda g, own=own: whole[g] - own[g]
        for i in range(len(w)):
            orders = list(range(min(order, i + 1), 0, -1))
            for lost, n in enumerate(orders):
                g = tuple(w[i - n + 1 : i + 1])
                if count(g) > 0:
                    lp += math.log(count(g) / (count(g[:-1]) if n > 1 else rest)) + lost * math.log(backoff)
                    break
            else:
                lp += len(orders) * math.log(backoff) - math.log(rest)
        out.append((k, len(w), round(lp, 3)))
    return out


@pytest.mark.parametrize("chunk,entries", [(1_000_000, 1_000_000), (50, 40)])
def test_lm_scores(spark, monkeypatch, chunk, entries):
    monkeypatch.setattr(lm_score, "RANGE_ENTRIES", entries)
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["a", "B", "c", "d", "É", "e"]) for _ in range(r.randint(0, 30)))) for i in range(40)] + [(None, None), (None, "a b c"), (7, ""), (50, "alone"), (50, "alone")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("chunk", F.lit("clash"))
    got = [(x.doc_id, x.n_tokens, round(x.logprob, 3)) for x in lm_score.lm_score(docs, chunk_tokens=chunk).collect()]
    key = lambda x: tuple(str(v) for v in x)
    for a, b in zip(sorted(got, key=key), sorted(lm_truth(rows), key=key), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=0.002)
    assert lm_score.lm_score(docs.where("false")).count() == 0


def greedy(doc, item, least):
    free_doc, free_item, out = [True] * len(doc), [True] * len(item), []
    least = min(least, len(item))
    while True:
        best, found = 0, []
        for d in range(len(doc)):
            for p in range(len(item)):
                n = 0
                while d + n < len(doc) and p + n < len(item) and doc[d + n] == item[p + n] != 0 and free_doc[d + n] and free_item[p + n]:
                    n += 1
                if n > best:
                    best, found = n, [(d, p)]
                elif n == best and n:
                    found.append((d, p))
        if best < least:
            return sorted(out)
        for d, p in found:
            if all(free_doc[d : d + best]) and all(free_item[p : p + best]):
                free_doc[d : d + best] = [False] * best
                free_item[p : p + best] = [False] * best
                out.append((d, p, best))


def test_tiles_are_the_greedy_ones():
    r = random.Random(3)
    for _ in range(200):
        v = r.choice([2, 3, 6])
        item, doc = [r.randint(1, v) for _ in range(r.randint(1, 14))], [r.randint(0, v) for _ in range(r.randint(0, 30))]
        assert sorted(decontaminate.tiles(np.array(doc, np.uint64), np.array(item, np.uint64), 3)) == greedy(doc, item, 3)


def test_tiling_of_long_items_is_not_cubic():
    import time

    r = np.random.default_rng(6)
    took = []
    for n in (5_000, 10_000, 20_000):
        item, doc = r.integers(1, 1 << 40, n).astype(np.uint64), r.integers(1, 1 << 40, 2 * n).astype(np.uint64)
        doc[50:56], doc[n : n + 9] = item[10:16], item[n // 2 : n // 2 + 9]
        began = time.process_time()
        assert decontaminate.tiles(doc, item) == [(n, n // 2, 9), (50, 10, 6)]
        took.append(time.process_time() - began)
    assert took[2] < 2 and took[2] < 3.5 * took[1] + 0.2
    same = np.ones(20_000, np.uint64)
    assert decontaminate.tiles(same, same[:1000]) == [(0, 0, 1000)]


@pytest.mark.parametrize("block", [2_000_000, 10])
def test_contamination(spark, block):
    r = random.Random(4)
    word = lambda: f"w{r.randrange(5000)}"
    passage, text = [word() for _ in range(40)], [word() for _ in range(300)]
    moved = passage[20:] + text[:7] + passage[:20]
    rows = [(1, " ".join(text)), (2, " ".join(text + passage)), (3, " ".join(text[:50] + moved)), (4, " ".join(text + passage[:12])), (None, " ".join(passage).upper()), (5, None), (6, ""), (7, "tiny item"), (2, " ".join(text + passage))]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([(10, " ".join(passage)), (11, "Tiny  Item"), (12, None), (13, ""), (None, " ".join(passage))], "item_id bigint, text string")
    got = Counter((x.doc_id, x.item_id) for x in decontaminate.contaminated(docs, bench, block_tokens=block).collect())
    assert got == Counter({(2, 10): 2, (2, None): 2, (3, 10): 1, (3, None): 1, (None, 10): 1, (None, None): 1, (7, 11): 1})
    assert sorted(str(x.doc_id) for x in decontaminate.decontaminate(docs, bench, block_tokens=block).collect()) == ["1", "4", "5", "6"]
    assert decontaminate.contaminated(docs, bench.where("false")).count() == 0
    assert decontaminate.decontaminate(docs, bench.where("false")).count() == len(rows)
    assert decontaminate.contaminated(docs.where("false"), bench).count() == 0


def test_classifier_on_held_out_rows(spark):
    r = random.Random(5)
    text = lambda bad: " ".join((f"w{r.randrange(3000)}" + ("###" if bad == 1 and r.random() < 0.5 else "")) if not (bad == 2 and k % 20 == 7) else r.choice(["rude", "nasty"]) for k in range(120))
    kinds = [r.choices([0, 1, 2], [8, 1, 1])[0] for _ in range(900)]
    docs = spark.createDataFrame([(i, text(k), "en", f"s{i % 7}", 900) for i, k in enumerate(kinds)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(i, int(k != 1), int(k == 2)) for i, k in enumerate(kinds) if i % 2 == 0], "doc_id bigint, quality int, toxic int")
    model = quality_classifier.fit(docs, labels)
    got = {x.doc_id: x.kept for x in quality_classifier.classify(docs, model, with_text=False).collect()}
    held = [i for i in range(900) if i % 2]
    good = [got[i] for i in held if kinds[i] == 0]
    bad = [got[i] for i in held if kinds[i] != 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_co_training_is_that_of_lists(spark):
    """The rounds over a table give the model that plain lists of all documents give."""
    r = random.Random(8)
    text = lambda good: " ".join(r.choice(["fine", "neat", "calm", "x", "y", "z"] if good else ["rude", "loud", "x", "y", "z", "##"]) + r.choice(["", "", str(r.randrange(9))]) for _ in range(r.randint(5, 60)))
    rows = [(i, text(i % 3 > 0), r.choice(["en", "de"]), f"s{(i % 3 > 0) + r.randrange(3)}", 100) for i in range(700)]
    rows += [(800 + i, *rows[500][1:]) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumns({"_wl_id": F.lit("clash"), "_wl_text": F.lit("clash")})
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 240)], "doc_id bigint, quality int, toxic int")
    got = quality_classifier.fit(docs, labels)

    memo = quality_classifier.Words()
    feats = {i: quality_classifier.features(*x, memo) for i, *x in rows}
    rank = {x.doc_id: x.r for x in docs.where("doc_id < 240").select("doc_id", F.xxhash64("doc_id", F.lit(6)).alias("r")).collect()}
    order = sorted(rank, key=rank.get)
    pool = list({tuple(map(bytes, feats[i])): feats[i] for i, *_ in rows if i >= 240}.values())
    rounds = []

    def most_sure(chosen, models, used, n_good, n_bad):
        out = []
        x = quality_classifier._matrix(pool, chosen)
        for v in (0, 1):
            p = np.round(1 / (1 + np.exp(-np.clip(models[v].margin(x[v]), -30, 30))), 12)
            found = [(k, *pool[k], label) for label, n in ((1, n_good), (0, n_bad)) for k in [i for i in sorted(range(len(pool)), key=lambda i: -p[i] if label else p[i]) if i not in used[1 - v] and (p[i] if label else 1 - p[i]) >= quality_classifier.SURE][:n]]
            out.append(found)
        rounds.append(sum(map(len, out)))
        return out

    want = quality_classifier.co_train([feats[i] for i in order], np.array([int(i % 3 > 0) for i in order]), most_sure)
    assert sum(rounds) > 50
    assert np.allclose(got.words, want.words, atol=1e-6) and np.allclose(got.meta.w, want.meta.w, atol=1e-6) and got.threshold == pytest.approx(want.threshold, abs=1e-6)
    kept = quality_classifier.classify(docs, got)
    assert {x._wl_id for x in kept.select("_wl_id").collect()} == {"clash"}
    score = {x.doc_id: x.score for x in kept.collect()}
    assert all(score[i] == pytest.approx(want.score(*feats[i])[2], abs=1e-5) for i in feats)


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "x " * 50000, "de", "t", 100000)], "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("score", F.lit("clash")).withColumn("_text", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 0), (None, 1, 0), (2, None, 1)], "doc_id bigint, quality int, toxic int")
    model = quality_classifier.fit(docs, labels)
    assert model is None
    got = quality_classifier.classify(docs, model).collect()
    assert len(got) == 4 and all(x.kept and x.score == 1.0 for x in got)
    assert quality_classifier.classify(docs.where("false"), model).count() == 0


@MODEL
@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no driver tables here")
def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d).cache()
        assert docs.columns == corpus_pipeline.COLUMNS, name
        kept.append(docs.count())
    assert kept == sorted(kept, reverse=True) and kept[-1] == kept[-2] > 0
    from weftline.llm import ngram_join, secret_scan

    assert ngram_join.ngram_join(docs).where("component_id <> doc_id").count() <= 1
    assert decontaminate.contaminated(docs, spark.read.parquet(f"{d}/benchmark.parquet")).count() == 0
    assert secret_scan.scan(docs).where("size(base) > 0").count() == 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert out.count() == kept[-1] and out.where("NOT parity OR NOT round_trip").count() == 0
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, d).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no driver tables here")
@pytest.mark.parametrize("n", range(1, 11))
def test_registered_queries_match_their_sql(spark, n):
    import duckdb

    from weftline.llm import registry

    name = next(q for q in registry.QUERIES if q.startswith(f"op{n}_"))
    d = "/root/testdata/sf0.001"
    df = registry.QUERIES[name](spark, d)
    cols = sorted(df.columns)
    got = df.select(cols).collect()
    assert got
    if name not in registry.ORACLES:
        return
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    want = con.sql(registry.ORACLES[name])
    at = [want.columns.index(c) for c in cols]
    assert sorted(want.columns) == cols
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got)) == sorted(key([r[i] for i in at]) for r in want.fetchall())

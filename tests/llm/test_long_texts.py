"""Texts of some megabytes through every operator, beside short, empty and null ones."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from weftline.llm import decontaminate, line_dedup, lm_score, ngram_join, quality_classifier, quality_rules, secret_scan, spm_codec, suffix_dedup

N = 300_000
WORDS = [f"w{i * 7919 % N}é" for i in range(N)]
LONG = " ".join(w + (".\n" if i % 17 == 0 else "") for i, w in enumerate(WORDS))
ROWS = [(1, LONG), (2, LONG + " and a tail"), (3, "short one"), (4, ""), (None, None), (5, " ".join(WORDS[1000:1040]))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id bigint, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")}).repartition(3).cache()


def by_id(df):
    rows = df.collect()
    assert len(rows) == len(ROWS)
    return {r.doc_id: r for r in rows}


def test_line_dedup(docs):
    got = by_id(line_dedup.substring_dedup(docs))
    units = got[1].n_units
    assert units > 17_000 and (got[1].n_removed, got[1].n_repeated) == (0, units)
    assert got[2].n_removed == units and got[2].text.endswith(" and a tail") and got[5].n_repeated == 0


def test_suffix_dedup(docs):
    got = by_id(suffix_dedup.suffix_dedup(docs))
    n = len(LONG.encode())
    assert got[1].n_bytes == got[1].n_removed == got[1].n_shared == n and got[2].n_bytes - got[2].n_removed == len(" and a tail")
    assert (got[3].n_removed, got[4].n_bytes, got[None].n_bytes) == (0, 0, 0)


def test_ngram_join(docs):
    got = by_id(ngram_join.ngram_join(docs))
    assert got[1].n_shingles == N - 4 and [got[k].component_id for k in (1, 2, 3, 4, 5)] == [1, 1, 3, 4, 5]


def test_scores_rules_and_secrets(docs):
    assert by_id(lm_score.lm_score(docs))[1].n_tokens == N
    assert by_id(quality_rules.ledger(docs))[1].n_words == N
    assert by_id(secret_scan.scan(docs))[1].base == []
    assert {r.doc_id: r.text for r in secret_scan.redact(docs).collect()} == dict(ROWS)


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(7, " ".join(WORDS[1000:1040])), (8, " ".join(WORDS[5:20_005]))], "item_id bigint, text string")
    clean = docs.withColumn("text", F.regexp_replace("text", r"\.\n", ""))
    got = {(r.doc_id, r.item_id): r.coverage for r in decontaminate.contaminated(clean, bench).collect()}
    assert got == {(1, 7): 1.0, (2, 7): 1.0, (5, 7): 1.0, (1, 8): 1.0, (2, 8): 1.0}
    assert sorted(str(r.doc_id) for r in decontaminate.decontaminate(clean, bench).collect()) == ["3", "4", "None"]


def test_classifier(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id bigint, quality int, toxic int")
    got = by_id(quality_classifier.classify(docs, quality_classifier.fit(docs, labels)))
    assert got[1].score == pytest.approx(got[2].score, abs=0.2) and all(0 <= r.score <= 1 for r in got.values())


@pytest.mark.skipif(not os.path.exists(spm_codec.MODEL_PATH), reason="no model file here")
def test_codec(docs):
    got = by_id(spm_codec.encode(docs))
    assert all(r.parity and r.round_trip for r in got.values()) and got[1].n_tokens > N

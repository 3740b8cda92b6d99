"""Queries over whole tables take in every row."""

from __future__ import annotations

from collections import Counter

import pytest

from weftline.plans.catalog import QUERIES

LINES = [(o, o % 7 + 1, (o * 13) % 29, o % 4 + 1, float(o % 50 + 1), 0.01 * (o % 8 + 1), 0.01 * (o % 10)) for o in range(1, 400)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(LINES, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_tax double, l_discount double").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(k, k % 11) for k in range(1, 500) if k % 9], "p_partkey bigint, p_size int").write.parquet(f"{d}/part.parquet")
    return d


def test_throughput(spark, tables):
    got = QUERIES["throughput"](spark, tables).first()
    assert got.ops_per_second == pytest.approx(2 * sum(r[4] for r in LINES) / sum(r[5] for r in LINES), abs=1e-4)
    assert got.mean_latency == pytest.approx(sum(r[6] for r in LINES) / len(LINES), abs=1e-4)


def test_sparse_matmul(spark, tables):
    want = Counter()
    for a in LINES:
        for b in LINES:
            if a[3] == b[3]:
                want[a[0] % 10, b[2] % 10] += int(a[4]) * int(b[4])
    assert {(r.i, r.j): r.v for r in QUERIES["sparse_matmul"](spark, tables).collect()} == want


def test_sorted_values(spark, tables):
    assert [r.v for r in QUERIES["sorted_values"](spark, tables).collect()] == sorted((r[4] for r in LINES), reverse=True)


def test_range_weights_take_the_whole_table(spark, tables):
    assert "<= 60" not in QUERIES["range_weights"](spark, tables)._jdf.queryExecution().optimizedPlan().toString()
    parts = {k: k % 11 for k in range(1, 500) if k % 9}
    want = {(low, low + 3, sum(parts.get(k, 0) for k in range(low, low + 4))) for low in range(1, 500, 3) if any(k in parts for k in range(low, low + 3))}
    assert {tuple(r) for r in QUERIES["range_weights"](spark, tables).collect()} == want

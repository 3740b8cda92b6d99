"""Edge cases of the operators: empty inputs, ties, bounds, malformed rows, golden values."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import arrays, kernels, scalar
from weftline.operators import distribution, graph, intervals, mutations, packets, paging, routing, signal, stats, validation
from weftline.sources import generators, serde


def rows(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]


def test_page_bounds(spark):
    for page, limit in ((0, 10), (1, 0), (1, 101)):
        with pytest.raises(ValueError):
            paging.check_page(page, limit)
    empty = spark.range(0)
    assert paging.page_of(empty, "id", 1, 10).count() == 0
    assert rows(paging.page_meta(empty, 1, 10)) == [(0, 0, 1, 10, False, False)]
    assert rows(paging.page_meta(spark.range(21), 3, 10)) == [(21, 3, 3, 10, False, True)]
    assert [r[0] for r in rows(paging.page_of(spark.range(25), "id", 3, 10))] == [20, 21, 22, 23, 24]


def test_lookup_after_paging_and_missing_keys(spark):
    page = spark.createDataFrame([(1, "a"), (2, "x")], "id int, k string")
    names = spark.createDataFrame([("a", "Ann")], "k string, name string")
    assert sorted(rows(paging.with_lookup(page, names, "k", "name", "Unknown"), "id", "name")) == [(1, "Ann"), (2, "Unknown")]
    asked = spark.createDataFrame([("x",), ("x",), ("a",)], "k string")
    assert rows(paging.missing_keys(asked, names, "k")) == [("x",), ("x",)]
    with pytest.raises(ValueError):
        paging.filtered_page(page, [], "id", "up", "k", 1, 1)


def test_validation(spark):
    df = spark.createDataFrame([("", 1), (" a ", -1), (None, None), ("b", 2)], "t string, n int")
    rules = [(F.length(validation.stripped(F.col("t"))) > 0, "title"), (F.col("n") > 0, "number")]
    got = rows(df, validation.first_failure(rules), validation.all_failures(rules))
    assert got == [("title", "title"), ("number", "number"), ("title", "title, number"), (None, None)]
    keys = spark.createDataFrame([(["b", "zz", "aa"],), (["b"],)], "k array<string>")
    assert rows(keys, validation.unknown_fields(F.col("k"), ["b"])) == [("aa, zz",), (None,)]


def test_patch_null_deletes(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    patches = spark.createDataFrame([(1, True, None), (2, False, "no")], "k int, has_v boolean, new_v string")
    assert sorted(rows(mutations.patch(base, patches, "k", ["v"]))) == [(1, None), (2, "b"), (3, "c")]


def test_prefix_check_skips_malformed_counts_overstock(spark):
    items = spark.createDataFrame([(1, "a", 3), (2, "a", -1), (3, "a", 9), (4, "a", 1), (5, "z", 1)], "idx int, k string, q int")
    stock = spark.createDataFrame([("a", 5)], "k string, copies int")
    got = sorted(rows(mutations.prefix_check(items, stock, "k", ["idx"], "q", "copies"), "idx", "running_qty", "fits"))
    assert got == [(1, 3, True), (3, 12, False), (4, 13, False)]


def test_bulk_order_all_or_nothing(spark):
    items = spark.createDataFrame([(1, "a", 3), (1, "a", 3), (2, "a", 5), (3, "z", 1), (4, "a", 0)] + [(5, "a", 1)] * 51, "b int, k string, q int")
    stock = spark.createDataFrame([("a", 100), ], "k string, copies int").withColumn("copies", F.lit(5))
    got = dict(rows(mutations.bulk_order(items, stock, "b", "k", "q", "copies"), "b", "accepted"))
    assert got == {1: False, 2: True, 3: False, 4: False, 5: False}


def test_bulk_update_and_returns(spark):
    base = spark.createDataFrame([(1, "created"), (2, "returned")], "k int, s string")
    keys = base.select("k")
    assert sorted(rows(mutations.return_orders(base, keys, "k", "s"), "k", "s", "outcome")) == [(1, "returned", 200), (2, "returned", 409)]
    gone = keys.unionByName(spark.createDataFrame([(9,)], "k int"))
    assert sorted(rows(mutations.bulk_update(base, gone, "k", {"s": F.lit("x")}))) == sorted(rows(base))
    assert {r[1] for r in rows(mutations.bulk_update(base, keys, "k", {"s": F.lit("x")}))} == {"x"}


@pytest.mark.parametrize(
    "conf",
    [
        {},
        {"autoBroadcastJoinThreshold": "-1", "adaptive.autoBroadcastJoinThreshold": "10MB", "adaptive.coalescePartitions.enabled": "false"},  # the join of the stock turns out small when it runs
        {"autoBroadcastJoinThreshold": "-1", "adaptive.advisoryPartitionSizeInBytes": "1KB", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB", "adaptive.skewJoin.skewedPartitionFactor": "1.0"},  # large keys are split
    ],
    ids=["plain", "small when run", "split"],
)
def test_place_orders_keeps_keys_whole(spark, conf):
    stock = spark.createDataFrame([("a", 40), ("b", 400), ("n", None)] + [(f"s{k}", 9) for k in range(20)], "k string, copies int")
    made = [(s, "z" if s % 101 == 0 else "n" if s % 103 == 0 else f"s{s % 20}" if s % 10 == 0 else "b" if s % 9 == 0 else "a", None if s % 97 == 0 else s * 7 % 12 - 1) for s in range(4000)]
    held = {r.k: r.copies for r in stock.collect()}
    want = []
    for s, k, q in made:
        if held.get(k) is None:
            want.append((k, s, 404))
        elif q is None or q <= 0:
            want.append((k, s, 400))
        elif q <= held[k]:
            held[k] -= q
            want.append((k, s, 201))
        else:
            want.append((k, s, 409))
    assert {r[2] for r in want} == {201, 400, 404, 409}
    orders = spark.createDataFrame(made, "seq int, k string, q int").repartition(8, "seq")  # each key's rows come from several tasks
    for name, value in conf.items():
        spark.conf.set(f"spark.sql.{name}", value)
    try:
        got = rows(mutations.place_orders(stock, orders, "k", "seq", "q", "copies"), "k", "seq", "outcome")
    finally:
        for name in conf:
            spark.conf.unset(f"spark.sql.{name}")
    assert sorted(got) == sorted(want)


def test_idempotency_first_success(spark):
    log = spark.createDataFrame([("k", 1, 500), ("k", 2, 201), ("k", 3, 200), ("n", 4, 404)], "key string, seq int, status int")
    assert rows(mutations.first_success(log, ["key"], "seq", "status")) == [("k", 2, 201)]


def test_topic_patterns(spark):
    pairs = [("*.b", "a.b", True), ("*.b", "b", False), ("#", "a.b.c", True), ("a.#", "a", True), ("a.#.z", "a.z", True), ("a.#.z", "a.b.c.z", True), ("a.*.z", "a.z", False), ("a.b", "a+b", False), ("a+.b", "aa.b", False)]
    for pattern, key, want in pairs:
        m = spark.createDataFrame([(1, key)], "id int, routing_key string")
        b = spark.createDataFrame([("q", pattern), ("q", pattern)], "queue string, pattern string")
        assert (routing.route_topic(m, b).count() == 1) is want, (pattern, key)


def test_direct_delivers_once(spark):
    m = spark.createDataFrame([(1, "e")], "id int, routing_key string")
    b = spark.createDataFrame([("q", "e"), ("q", "e"), ("r", "e")], "queue string, pattern string")
    assert routing.route_direct(m, b).count() == 2


def test_splits_and_assignment(spark):
    got = [r[0] for r in rows(spark.range(4).orderBy("id"), routing.work_split(F.lit(10), F.lit(4), F.col("id")))]
    assert got == [3, 3, 2, 2]
    players = spark.range(5).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("p"))
    known = spark.createDataFrame([("p0", 4)], "p string, g bigint")
    got = dict(rows(routing.assign_games(players, known, "p", "g"), "p", "g"))
    assert got == {"p0": 4, "p1": 5, "p2": 5, "p3": 6, "p4": 6}


def test_distribution_ties(spark):
    df = spark.createDataFrame([(1, 5.0, 1), (1, 5.0, 2), (1, 1.0, 3)], "g int, v double, s int")
    assert rows(distribution.argmax_first(df, ["g"], "v", "s")) == [(1, 5.0, 1)]
    assert rows(distribution.argmin_first(df, ["g"], "v", "s")) == [(1, 1.0, 3)]
    tied = spark.createDataFrame([(i, v) for i, v in enumerate([4, 4, 3, 3, 3, 1])], "s int, v int")
    got = sorted(rows(distribution.top_values(tied, "v", "s", 4), "s", "v", "coloured"))
    assert got == [(0, 4, True), (1, 4, False), (2, 3, True), (3, 3, False), (4, 3, False)]
    flat = spark.createDataFrame([(1, 1.0)] * 4, "g int, v double")
    assert rows(distribution.entropy(flat, ["g"], "v"))[0][1] == pytest.approx(2.0)


def test_range_weights_with_gaps(spark, monkeypatch):
    monkeypatch.setattr(stats, "PLACES", 4)
    balls = spark.createDataFrame([(1, 2), (5, 3), (5, 4), (9, 1)], "p bigint, w bigint")
    ranges = spark.createDataFrame([(1, 9), (2, 4), (4, 6), (6, 100), (-3, 0)], "low bigint, high bigint")
    assert sorted(rows(stats.range_weights(balls, ranges, "p", "w"))) == [(-3, 0, 0), (1, 9, 10), (2, 4, 0), (4, 6, 7), (6, 100, 1)]


def test_statistics(spark):
    log = spark.createDataFrame([("a", 1.0, True), ("a", 3.0, True), ("a", 9.0, False)], "k string, t double, ok boolean")
    assert rows(stats.request_stats(log, "t", F.col("ok"))) == [(3, 2, 1, 66.6667, 2.0, 1.0, 3.0)]
    assert rows(stats.request_stats(log.where("false"), "t", F.col("ok")))[0][:3] == (0, 0, 0)
    ping = spark.createDataFrame([(0, 0), (3, 2), (8, 8)], "tx int, rx int")
    assert [r[0] for r in rows(ping, stats.loss_percent(F.col("tx"), F.col("rx")))] == [0, 33, 0]


def test_flows_golden(spark):
    got = {r["name"]: r["label"] for r in graph.flow_totals(generators.flow_nodes(spark), generators.flows(spark)).collect()}
    assert got["IEEE"] == "IEEE (n=32)" and got["Tier 3"] == "Tier 3 (n=185)" and len(got) == 8


def test_lattice_golden(spark):
    n = 4
    m, energy, mean, var = rows(graph.lattice_observables(graph.lattice(spark, n, F.lit(1)), n))[0]
    assert (m, energy, mean, var) == (n**3, -3.0 * n**3, 1.0, 0.0)


def test_interval_pairs(spark):
    df = spark.createDataFrame([(1, 0.0, 25.0), (2, 5.0, 6.0), (3, 25.0, 30.0), (4, 5.5, 26.0)], "k int, s double, e double")
    assert sorted(rows(intervals.overlaps(df, "k", "s", "e", 10.0))) == [(1, 2), (1, 4), (2, 4), (3, 4)]


def test_multisets_and_order(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    assert rows(intervals.same_multiset(a, a, ["x"])) == [(0, True)]
    assert rows(intervals.same_multiset(a, a.distinct(), ["x"])) == [(1, False)]
    assert rows(intervals.same_multiset(a.where("false"), a.where("false"), ["x"])) == [(0, True)]
    s = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (2, 1, 1), (2, 2, 1)], "k int, o int, v int")
    assert dict(rows(intervals.is_sorted(s, ["k"], "o", "v"))) == {1: False, 2: True}


def test_trailing_mean_truncates_to_zero(spark):
    df = spark.createDataFrame([(1, 1, -10), (1, 2, -11), (1, 3, -100)], "k int, o int, s bigint")
    assert [r[0] for r in sorted(rows(signal.trailing_mean(df, ["k"], "o", "s"), "mean_signal", "o"), key=lambda r: r[1])] == [-10, -10, -10]


def test_votes(spark):
    v = spark.createDataFrame([(1, True), (1, True), (2, True), (2, False)], "t int, v boolean")
    assert dict(rows(intervals.unanimous(v, "t", F.col("v")))) == {1: "commit", 2: "abort"}


def test_fibonacci_golden(spark):
    got = [int(r[0]) for r in rows(scalar.fibonacci(spark, 183).orderBy("n"), "fib")]
    assert got[:11] == [0, 1, 1, 2, 3, 5, 8, 13, 21, 34, 55] and got[30] == 832040
    assert all(got[i] == got[i - 1] + got[i - 2] for i in range(2, 184))


def test_scalars(spark):
    one = spark.range(1)
    result, error = scalar.calculate(F.lit("divide"), F.lit(1.0), F.lit(0.0))
    assert rows(one, result, error) == [(None, "division by zero")]
    result, error = scalar.calculate(F.lit("mod"), F.lit(1.0), F.lit(2.0))
    assert rows(one, result, error) == [(None, "unknown operation")]
    assert rows(one, scalar.power_by_squaring(F.lit(2), 62), scalar.power_by_squaring(F.lit(2), 64)) == [(1 << 62, None)]
    assert rows(one, scalar.mw_to_dbm(F.lit(0.5)), scalar.mw_to_dbm(F.lit(0.0))) == [(-3, None)]
    assert rows(one, scalar.reversed_bits(F.lit(6).cast("long"), 5)) == [("01100",)]


def test_arrays(spark):
    golden = spark.createDataFrame([([1, 2, 3, 4, 5, 6, 7, 128],)], "a array<int>")
    assert rows(golden, arrays.affine(F.col("a")))[0][0] == [3, 5, 7, 9, 11, 13, 15, 257]
    assert arrays.bit_table(spark, 5).count() == 32
    a = spark.createDataFrame([(1, "x", None)], "k int, p string, q string")
    assert rows(arrays.same_fields(a, a, "k", ["p", "q"])) == [(1, True)]


def test_packet_bytes(spark):
    frame = bytes.fromhex("0a0b0c0d0e0f" "010203040506" "0800" "45000028" "00012003" "4011" "0000" "c0a80001" "08080808" "1388" "0035")
    df = packets.decoded(spark.createDataFrame([(bytearray(frame),)], "d binary"), "d")
    r = df.first()
    assert (r.src_mac, r.src_ip, r.src_port, r.dst_port, r.frag_offset) == ("01:02:03:04:05:06", "192.168.0.1", 5000, 53, 3)
    assert rows(df, packets.is_dns()) == [(False,)]


def checksum(data: bytes) -> int:
    data += b"\0" * (len(data) % 2)
    s = sum(int.from_bytes(data[i : i + 2], "big") for i in range(0, len(data), 2))
    while s >> 16:
        s = (s & 0xFFFF) + (s >> 16)
    return 0xFFFF - s


def test_checksum(spark):
    data = [b"", b"\x01", bytes(range(200)), b"\xff" * 101]
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(data)], "i int, d binary")
    assert dict(rows(df, "i", kernels.internet_checksum(F.col("d")))) == {i: checksum(x) for i, x in enumerate(data)}


def test_kernels():
    bell = kernels.statevector(2, [("h", 0), ("cx", 0, 1)])
    assert np.allclose(np.abs(bell) ** 2, [0.5, 0, 0, 0.5])
    assert kernels.purity(np.outer(bell, bell.conj())) == pytest.approx(1)
    assert kernels.purity(np.eye(2) / 2) == pytest.approx(0.5)
    v = np.random.default_rng(1).normal(size=16)
    v /= np.linalg.norm(v)
    chain, lost = kernels.mps(v, 4)
    assert np.allclose(kernels.contracted(chain), v) and lost == pytest.approx(0) and kernels.mps_norm(chain) == pytest.approx(1)
    assert kernels.mps_z(chain, 0) == pytest.approx(float((v[:8] ** 2).sum() - (v[8:] ** 2).sum()))
    x = np.linspace(-0.999, 0.999, 41)
    assert np.allclose([math.erf(y) for y in kernels.inverse_erf(x)], x)


def test_grover_amplitudes(spark):
    got = spark.range(8).select(arrays.grover(3, F.col("id").cast("int"), 2).alias("a")).collect()
    for k, r in enumerate(got):
        a = np.full(8, 8**-0.5)
        for _ in range(2):
            a[k] *= -1
            a = 2 * a.mean() - a
        assert np.allclose(r.a, a)


@pytest.mark.parametrize("degree,n", [(3, 50), (4, 31), (1, 10), (2, 2)])
def test_random_graph_is_regular(spark, degree, n):
    edges = graph.random_graph(spark.range(n), "id", degree, 5).collect()
    assert len(set(edges)) == len(edges) and all(0 <= r.u < r.v < n for r in edges)
    seen = np.bincount([x for r in edges for x in r], minlength=n)
    assert seen.max() <= degree and seen.sum() >= degree * n - 4 * degree
    assert sorted(edges) == sorted(graph.random_graph(spark.range(n), "id", degree, 5).collect())


def test_cumulated_mass_over_many_ranges(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    values = [(i * 37) % 1009 for i in range(1000)]
    got = {r.v: r.cdf for r in distribution.cdf_desc(spark.createDataFrame([(v, v % 5) for v in values], "v int, m int"), "v", "m").collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {v: sum(x % 5 for x in values if x >= v) for v in values}


def test_entropy_of_zeros_and_units(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 0.0), ("b", 3.0), ("b", 0.0), ("c", 1.0), ("c", -1.0), ("d", 1.0), ("d", 1e-9)], "g string, v double")
    got = {r.g: r.entropy for r in distribution.entropy(df, ["g"], "v").collect()}
    assert got["a"] is None and [got[k] for k in "bcd"] == pytest.approx([0, 1, 0], abs=1e-9)


def test_pages_by_key_are_the_numbered_ones(spark):
    df, last = spark.range(95), None
    for page in range(1, 12):
        got = [r.id for r in paging.page_after(df, "id", last, 10).collect()]
        assert got == [r.id for r in paging.page_of(df, "id", page, 10).collect()]
        last = got[-1] if got else last


def test_transactions_roll_back(spark):
    old, new = spark.range(3), spark.range(5)
    assert mutations.transaction(old, new, new.where("id > 10")).count() == 5
    assert mutations.transaction(old, new, new.where("id > 1")).count() == 3


def test_serde_roundtrip():
    for who in ((7, None, "Nowak", "Jan", [0, 5, 3]), (None, "a@b", "Żak", "", []), (None, None, "", "", [1] * 300)):
        assert serde.from_protobuf(serde.to_protobuf(*who)) == who
        assert serde.from_xdr(serde.to_xdr(*who)) == who


def test_files(spark, tmp_path):
    perf = spark.createDataFrame([(1, 1, 100, 10, 17.2445, 11.6, 171.4244)], "producers INT, consumers INT, items_per_producer INT, capacity INT, total_duration_s DOUBLE, ops_per_second DOUBLE, avg_latency_ms DOUBLE")
    serde.write_csv(perf, str(tmp_path / "p"))
    assert rows(serde.read_performance(spark, str(tmp_path / "p"))) == rows(perf)
    serde.write_csv(perf, str(tmp_path / "q"), header=False, append=True)
    serde.write_csv(perf, str(tmp_path / "q"), header=False, append=True)
    assert spark.read.csv(str(tmp_path / "q")).count() == 2
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "one.bin").write_bytes(serde.to_xdr(7, None, "Nowak", "Jan", [2]))
    assert rows(serde.read_records(spark, str(tmp_path / "r"), "xdr"), "nr_albumu", "nazwisko") == [(7, "Nowak")]


def test_family_by_enumeration(spark):
    from weftline.plans.catalog import QUERIES

    one, tuesday, two = rows(QUERIES["family_prob"](spark, ""), "one_boy", "tuesday_boy", "any_two")[0]
    assert (one, tuesday, two) == (pytest.approx(2 / 3), pytest.approx(14 / 27), pytest.approx(1 / 2))

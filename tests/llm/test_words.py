"""Word hashes against words cut one by one."""

from __future__ import annotations

import random

import numpy as np
import pytest

from weftline.llm import ngram_join, words


@pytest.mark.parametrize("piece", [8, 64, 1 << 18])
def test_equal_words_have_equal_hashes(monkeypatch, piece):
    monkeypatch.setattr(words, "PIECE", piece)
    monkeypatch.setattr(words, "UP", words._powers(words.BASE, piece + 1))
    monkeypatch.setattr(words, "DOWN", words._powers(words.INVERSE, piece + 1))
    r = random.Random(3)
    texts = ["", " ", "one", " Two\tWORDS\r\n", "é É ſ KK", "x" * 500, "a b a\x1cb", *("".join(r.choice("aAbB \n\t\x0b\x0cé") for _ in range(r.randint(0, 200))) for _ in range(60)), ""]
    raw = [t.encode() for t in texts]
    got, size = words.word_hashes(raw)
    want = [w for t in raw for w in t.lower().split()]
    assert size.tolist() == [len(t.lower().split()) for t in raw] and len(got) == len(want)
    by_word = {}
    for w, h in zip(want, got.tolist(), strict=True):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)
    assert words.word_hashes([])[0].size == 0 and words.word_hashes([b"", b""])[1].tolist() == [0, 0]


def test_no_collisions_among_many_words():
    r = np.random.default_rng(1)
    many = {bytes(r.integers(97, 101, n, dtype=np.uint8)) for n in r.integers(1, 14, 200_000)}
    got, _ = words.word_hashes([b" ".join(many)])
    assert len(set(got.tolist())) == len(many)


def test_shingles_do_not_cross_texts():
    each = list(ngram_join.shingles([b"a b c d e f", b"", b"a b", b"b c d e f", b"A  B"], 5))
    assert [len(x) for x in each] == [2, 0, 1, 1, 1]
    assert each[0][1] == each[3][0] and each[2][0] == each[4][0]


def test_workers_drop_what_others_kept(spark):
    """A map finds nothing that a map of another name has kept in its worker."""
    import pyarrow as pa

    from weftline.llm import common

    def keeps(batches):
        from weftline.llm import common

        for b in batches:
            common.KEPT["mine"] = lambda: None
            yield pa.RecordBatch.from_arrays([pa.array([len(common.KEPT)] * b.num_rows, pa.int64())], ["n"])

    def finds(batches):
        from weftline.llm import common

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(common.KEPT)] * b.num_rows, pa.int64())], ["n"])

    rows = spark.range(8).repartition(4)
    assert {r.n for r in rows.mapInArrow(common.trimmed(keeps, "mine"), "n bigint").collect()} == {1}
    assert {r.n for r in rows.mapInArrow(common.trimmed(finds, "other"), "n bigint").collect()} == {0}

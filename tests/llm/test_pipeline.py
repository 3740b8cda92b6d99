"""The whole pipeline against plain Python, stage after stage."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest
from test_dedup_ops import truth
from test_model_ops import greedy
from test_native_ops import base_spans, linked_spans

from weftline.llm import decontaminate, quality_classifier, spm_codec

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def fixture():
    r = random.Random(12)
    good, bad = [f"word{i}" for i in range(300)], ["##$$", "buy", "now!!", "cheap", "%%"]
    prose = lambda n: [r.choice(good) for _ in range(n)]
    item = prose(40)
    texts = []
    for i in range(150):
        words = [r.choice(bad + good[:5]) for _ in range(60)] if i % 5 == 0 else prose(r.randint(60, 90))
        if i % 10 == 3:
            words[20:20] = item[20:] + item[:15]
        if i % 7 == 2:
            words[5:5] = ["token=abcdefgh%d" % i, "user=bob", "pwd=geheim"]
        texts.append(" ".join(words))
    for i in (1, 2, 4, 6):
        texts += [texts[i], texts[i] + " tail", "Start " + texts[i]]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    rows += [(900, "", "de", "s1", 0), (901, None, None, None, None), (902, "é pwd=geheim at http://h/x ▁ 😀", "fr", "s2", 30)]
    labels = [(i, int(i % 5 != 0), 0) for i in range(0, 150, 2)]
    return rows, labels, [(1, " ".join(item)), (2, None)]


@pytest.mark.skipif(not os.path.exists(spm_codec.MODEL_PATH), reason="no model file here")
def test_pipeline_is_that_of_plain_python(spark, tmp_path):
    import corpus_pipeline
    import sentencepiece

    rows, labels, bench = fixture()
    for name, data, schema in (("documents", rows, COLUMNS), ("labels", labels, "doc_id bigint, quality int, toxic int"), ("benchmark", bench, "item_id bigint, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {x.doc_id: (x.lang, x.source, x.n_chars, x.ids) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    model = quality_classifier.fit(spark.createDataFrame(rows, COLUMNS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    memo, sizes = quality_classifier.Words(), [len(rows)]
    rows = [x for x in rows if model.score(*quality_classifier.features(*x[1:], memo))[2] >= model.threshold]
    sizes.append(len(rows))
    first = {i: c for i, _, c in truth([(x[0], x[1]) for x in rows])}
    rows = [x for x in rows if first[x[0]] == x[0]]
    sizes.append(len(rows))

    def leaks(text):
        vocab: dict = {}
        for _, t in bench:
            item = [vocab.setdefault(w, len(vocab) + 1) for w in decontaminate.words_of(t)]
            found = greedy([vocab.get(w, 0) for w in decontaminate.words_of(text)], item, decontaminate.MIN_TILE) if item else []
            if item and sum(n for *_, n in found) >= decontaminate.COVERAGE * len(item):
                return True
        return False

    rows = [x for x in rows if not leaks(x[1])]
    sizes.append(len(rows))
    assert sizes == sorted(set(sizes), reverse=True)  # every stage has something to do
    lib, want, changed = sentencepiece.SentencePieceProcessor(model_file=spm_codec.MODEL_PATH), {}, 0
    for i, t, lang, source, n in rows:
        spans = sorted([*base_spans(t), *linked_spans(t, base_spans(t))])
        out, at = "", 0
        for s, _, e, _ in spans:
            if s >= at:
                out += t[at:s] + "[SECRET]"
            at = max(at, e)
        text = out + t[at:] if spans else t
        changed += bool(spans)
        want[i] = (lang, source, n if text is None else len(text), lib.encode(text or ""))
    assert changed > 3 and got == want
    assert np.all([isinstance(x, int) for ids in got.values() for x in ids[3][:3]])

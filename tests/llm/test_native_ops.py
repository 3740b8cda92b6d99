"""Secret scans, URL filters and quality rules against plain Python."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from weftline.llm import quality_rules, secret_scan, url_filter

SCHEMA = "doc_id bigint, text string"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
WEAK = [(k, re.compile(p), m) for k, _, p, m in secret_scan.WEAK]
HEX = "0123456789abcdef" * 2
KEY = "AKIA" + "ABCD1234" * 2

TEXTS = [
    None,
    "",
    "nothing here at all",
    "token=abc short, token=abcdefgh long",
    "password: token: abcdefghij",
    "pASSWORD = 'hunter2hunter2' and API_KEY:xyzxyzxyz9",
    f"key {KEY} then {HEX} \U0001f600 and {HEX}f",
    f"é\U0001f600 token = \"{HEX}\" 10.1.2.3:8080",
    "visit http://a.example/x only",
    "user=bob login at http://a.example/x with pwd=geheim",
    "pwd=geheim " + "z " * 200 + "user=bob",
    "user=bob " + "pwd=abcd http://h/x " * 50,
    "ſecret=abcdefghij toKen=abcdefghij",
    "key id: login=anna9 Abcdefghij0123456789xyz== at db.x 192.168.7.1:5432 and abcdefghijabcdefghijabc",
    "AKIA" + "A" * 11 + " AKIAAKIA" + "B" * 12,
]


def base_spans(t):
    t = t or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


def linked_spans(t, base, scope=secret_scan.SCOPE):
    t = t or ""
    weak = [(m.start(), secret_scan.ORDER[k], m.end(), k) for k, p, must in WEAK for m in p.finditer(t) if all(re.search(x, m[0]) for x in must)]
    weak = [w for w in weak if not any(b[0] < w[2] and w[0] < b[2] for b in base)]
    cls = secret_scan.CLASS
    out = set()
    for a in [*base, *weak]:
        for b in [*base, *weak]:
            if cls[a[3]] == "secret" != cls[b[3]] and (a[2] <= b[0] or b[2] <= a[0]) and a[0] - b[2] <= scope and b[0] - a[2] <= scope:
                out |= {x for x in (a, b) if x in weak}
    return sorted(out)


def written(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)


def test_secrets_match_brute_force(spark):
    docs = spark.createDataFrame([(i if i != 3 else None, t) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5])], SCHEMA)
    got = secret_scan.scan(docs).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        t = TEXTS[3] if r.doc_id is None else TEXTS[r.doc_id]
        base = base_spans(t)
        assert [tuple(x)[:4] for x in r.base] == base, t
        assert [tuple(x)[:4] for x in r.linked] == linked_spans(t, base), t
    assert secret_scan.scan(docs.where("false")).count() == 0


def test_weak_parts_alone_are_not_reported(spark):
    docs = spark.createDataFrame([(1, TEXTS[8]), (2, TEXTS[9]), (3, TEXTS[10])], SCHEMA)
    got = {r.doc_id: {x.kind for x in r.linked} for r in secret_scan.scan(docs).collect()}
    assert got == {1: set(), 2: {"ident", "weak", "endpoint"}, 3: set()}


def test_redaction_keeps_the_rest(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], SCHEMA).withColumn("_key", F.lit(1)).withColumn("linked", F.lit(2))
    for r in secret_scan.redact(docs).collect():
        t = TEXTS[r.doc_id]
        base = base_spans(t)
        spans, want, at = sorted([*base, *linked_spans(t, base)]), "", 0
        for s, _, e, _ in spans:
            if s >= at:
                want += t[at:s] + "[SECRET]"
            at = max(at, e)
        assert r.text == (want + t[at:] if spans else t) and (r._key, r.linked) == (1, 2)


def test_very_long_text_is_not_quadratic(spark):
    import time

    took, part = [], "é token=abcdefgh1 user=bob pwd=geheim http://h/x word word. "
    for n in (20_000, 40_000, 80_000):
        docs = spark.createDataFrame([(1, part * n)], SCHEMA)
        began = time.time()
        r = secret_scan.redact(docs).collect()[0]
        took.append(time.time() - began)
        assert r.text == "é [SECRET] [SECRET] [SECRET] [SECRET] word word. " * n
    assert took[2] < 3 * took[1] + 2, took


URLS = [None, "", "no scheme", "http://", "HTTP://A.NET/x", "http://net", "http://net/", "http://b.example.net/en/1", "http://xexample.net/en/1", "http://example.com/de/1?x", "http://a.example.com/de", "ftp://org/fr/", "http://o.org/fr/x#y", "a://b.net://c/", "http://example.net:80/en/", "http://net?x/", "http://É.ORG/fr/"]


def judged(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(str.maketrans(url_filter.UPPER, url_filter.LOWER))
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, None, "allow") if not fits else (host, path, max(fits)[1], max(fits)[2])


@pytest.mark.parametrize("broadcast", [True, False])
def test_urls(spark, monkeypatch, broadcast):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 100 if broadcast else 0)
    pages = spark.createDataFrame([(i if i else None, u) for i, u in enumerate(URLS)] + [(2, URLS[2])] * 3, "page_id bigint, url string").withColumn("host", F.lit("clash"))
    got = url_filter.url_filter(pages, url_filter.rule_table(spark, url_filter.RULES)).collect()
    want = [(i if i else None, *judged(u)) for i, u in enumerate(URLS)] + [(2, *judged(URLS[2]))] * 3
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    assert url_filter.url_filter(pages.where("false"), url_filter.rule_table(spark, url_filter.RULES)).count() == 0


def test_no_rules_and_equal_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id bigint, url string")
    rules = url_filter.rule_table(spark, [("block", "a.b", "/c"), ("allow", "a.b", "/c")])
    assert url_filter.url_filter(pages, rules).first().verdict == "block"
    assert url_filter.url_filter(pages, rules.where("false"), default="block").first().verdict == "block"


WORD = re.compile(r"[^\x20\x09-\x0D]+")
RULE_TEXTS = [None, "", " \t\n", "one", "a b c a b c", "a a a a", "x\ny\nx\n \nx", "w " * 60, " ".join(f"w{i}" for i in range(60)), "# * $ % & | < > " * 9, "GROSS " * 20 + "klein", "ä\u00a0b \u2003c", "a b c d " * 5000, "\n".join(["same line here"] * 5)]


def measured(t):
    t = t or ""
    words = WORD.findall(t)
    seen, covered = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {i + k for i in at for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_and_policies(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(RULE_TEXTS)] + [(None, "one")], SCHEMA).withColumn("n_words", F.lit("clash"))
    marked = quality_rules.ledger(docs)
    for r in quality_rules.apply_policy(marked, "base").collect():
        want = measured(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.kept == (not (want[0] < 50 or 100 * want[4] > 50 * want[0]))
    assert quality_rules.ledger(docs.where("false")).count() == 0


def test_ablations_from_bits(spark):
    bits = [0, 1, 1, 3, 2, 64, 65]
    marked = spark.createDataFrame([(b,) for b in bits], "fail_bits bigint")
    got = {r.rule: (r.n_failed, r.n_only, r.n_kept_without, r.n_rows) for r in quality_rules.ablations(marked, "v1").collect()}
    for name, bit in quality_rules.RULE_BITS.items():
        mine = 1 << bit
        assert got[name] == (sum(b & mine > 0 for b in bits), sum(b == mine for b in bits), sum(b & ~mine == 0 for b in bits), len(bits))


def test_hash_of_no_spans():
    assert hashlib.sha256(b"").hexdigest() == hashlib.sha256(written([]).encode()).hexdigest()

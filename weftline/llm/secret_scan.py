"""Secret scans by multipart credential linking.

Strong secrets (assignments, access keys, long hex) are reported wherever they are.
Weak parts (an identifier, a short or unlabelled secret, an endpoint) are common in
clean text, so they are reported only where complementary parts co-occur: a scope is
the SCOPE code points around a secret, and an interval join over (document, position
bucket) finds the identifiers and endpoints in it. All of it is native.

Positions are code points, end exclusive. Defined results: a null text is an empty
one and has no spans; rows alike in id and text are each returned with the same
spans; null ids are kept; an empty table gives no rows; further columns are ignored.
A weak part that overlaps a strong one is part of it and not reported by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import let, materialise, row_key, table, unused

#: Code points between a secret and a part that may complement it.
SCOPE = 200
SPANS = "array<struct<s:int,o:int,e:int,kind:string,bs:int,be:int>>"


def cased(words: str) -> str:
    """A pattern for its letters A-Z in either case (an engine's own option may fold other letters into them)."""
    return "".join(f"[{c}{c.upper()}]" if c.islower() else c for c in words)


SET = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = f"({cased('password|passwd|secret|token|api_?key')}){SET}([A-Za-z0-9+/_.=-]+)"
#: Base kinds in their order: pattern, group that must have so many characters. Longer runs cannot hold a second match, so the length of access and hex is in the pattern.
BASE = [("assign", ASSIGN, 2, 8), ("access", r"AKIA[A-Z0-9]{12,}", 0, 16), ("hex", r"[0-9a-f]{32,}", 0, 32)]
#: Weak parts: kind, class, pattern, what a match must hold somewhere.
WEAK = [
    ("ident", "ident", f"(?:{cased('access_?key_?id|access_?key|client_?id|account_?id|username|user|login')}){SET}[A-Za-z0-9@._-]{{3,}}", []),
    ("weak", "secret", f"(?:{cased('pwd|passphrase|pass|auth|bearer|credential|private_?key')}){SET}[A-Za-z0-9+/_.=-]{{4,}}", []),
    ("blob", "secret", r"[A-Za-z0-9+/]{20,}={0,2}", ["[0-9]", "[A-Z]", "[a-z]"]),
    ("endpoint", "endpoint", r"""(?:https?|ftp|postgresql|postgres|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D"'<>]+|[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{2,5})?""", []),
]
#: Class of each kind for the linking; the order of kinds in spans of equal start.
CLASS = {"assign": "secret", "access": "ident", "hex": "secret"} | {k: c for k, c, *_ in WEAK}
ORDER = {k: i for i, k in enumerate([*(b[0] for b in BASE), *(w[0] for w in WEAK)])}


def running(values: Column, join) -> Column:
    """Running sums (or what join makes of two values) of an array, in rounds that each double the reach: no list is copied for each element."""

    def rounds(a: Column) -> Column:
        reach = F.sequence(F.lit(0), F.ceil(F.log2(F.size(a).cast("double"))).cast("int") - 1)
        return F.aggregate(reach, a, lambda acc, k: F.transform(acc, lambda x, i: F.coalesce(join(x, F.get(acc, i - F.call_function("shiftleft", F.lit(1), k))), x)))

    return let(values, lambda a: F.when(F.size(a) < 2, a).otherwise(rounds(a)))


def _spans(text: Column, kind: str, pattern: str, group: int = 0, least: int = 0, must: list[str] | None = None, in_bytes: bool = False) -> Column:
    """array<struct<s, o, e, kind, bs, be>> of the leftmost non-overlapping matches, without those whose group is too short or lacks what it must hold.

    What lies between the matches comes from split, the matches from regexp_extract_all
    with the same pattern; running sums of their lengths are the positions. bs, be: the
    position in bytes (only in_bytes; else null).
    """
    empty = F.array().cast(SPANS)
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"), (F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.array().cast("array<string>")).alias("val"))
    # The last gap has no match behind it.
    parts = F.filter(parts, lambda x: x["all"].isNotNull())

    def judged(x: Column) -> Column:
        value = x["val"] if group else x["all"]
        ok = F.length(value) >= least
        for m in must or []:
            ok = ok & F.rlike(value, F.lit(m))
        return ok

    def lengths(f) -> Column:
        return F.transform(parts, lambda x: F.struct((f(x["gap"]) + f(x["all"])).alias("to"), f(x["all"]).alias("n")))

    def places(sized: Column) -> Column:
        ends = running(F.transform(sized, lambda x: x["to"]), lambda x, y: x + y)
        return F.arrays_zip(ends.alias("e"), F.transform(sized, lambda x: x["n"]).alias("n"))

    chars = places(lengths(F.length))
    octets = places(lengths(F.octet_length)) if in_bytes else F.transform(parts, lambda x: F.struct(F.lit(None).cast("int").alias("e"), F.lit(0).alias("n")))
    told = F.arrays_zip(chars.alias("c"), octets.alias("b"), F.transform(parts, judged).alias("ok"))
    made = F.transform(F.filter(told, lambda x: x["ok"]), lambda x: F.struct((x["c"]["e"] - x["c"]["n"]).alias("s"), F.lit(ORDER[kind]).alias("o"), x["c"]["e"].alias("e"), F.lit(kind).alias("kind"), (x["b"]["e"] - x["b"]["n"]).alias("bs"), x["b"]["e"].alias("be")))
    return F.when(F.rlike(text, F.lit(pattern)), made).otherwise(empty)


def _written(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def _union(*arrays: Column) -> Column:
    return F.sort_array(F.concat(*arrays))


def _free(weak: Column, base: Column) -> Column:
    """The weak spans that overlap no base span.

    Ends of weak and starts of base spans are laid out in order; before a weak span's end
    the furthest base end so far, a running maximum, tells whether one reaches into it.
    """
    at = lambda x, place, base_end: F.struct(place.alias("at"), base_end.alias("to"), x.alias("x"))
    none = F.lit(None).cast(SPANS[6:-1])
    order = F.sort_array(F.concat(F.transform(weak, lambda x: at(x, x["e"], F.lit(0))), F.transform(base, lambda b: at(none, b["s"], b["e"]))))
    reach = let(order, lambda o: F.arrays_zip(o.alias("p"), running(F.transform(o, lambda p: p["to"]), F.greatest).alias("to")))
    kept = F.filter(reach, lambda z: z["p"]["x"].isNotNull() & (z["to"] <= z["p"]["x"]["s"]))
    return F.sort_array(F.transform(kept, lambda z: z["p"]["x"]))


def base_and_weak(docs: DataFrame, id_col: str, text_col: str, in_bytes: bool = False) -> DataFrame:
    """A row for each document without its text: _id, _key, base (sorted spans), weak (sorted spans that overlap no base span)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.sort_array(F.concat(*[_spans(text, *b, in_bytes=in_bytes) for b in BASE]))
    weak = F.sort_array(F.concat(*[_spans(text, k, p, must=m, in_bytes=in_bytes) for k, _, p, m in WEAK]))
    found = docs.select(F.col(id_col).alias("_id"), row_key(id_col, text_col).alias("_key"), base.alias("base"), weak.alias("weak"))
    return found.withColumn("weak", F.when((F.size("weak") == 0) | (F.size("base") == 0), F.col("weak")).otherwise(_free(F.col("weak"), F.col("base"))))


def link(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """_key, linked: the weak spans that have a complementary part in scope.

    Each secret's scope and each other part is an interval; both are laid over position
    buckets as wide as the scope, joined on (document, bucket) and then compared. What a
    bucket holds is bounded by its width, so no key grows with the corpus.
    """
    cls = F.element_at(F.create_map(*[x for k, c in CLASS.items() for x in (F.lit(k), F.lit(c))]), F.col("p.kind"))
    parts = found.where(F.size("weak") > 0).select("_key", F.explode(F.concat("base", "weak")).alias("p")).distinct().withColumn("cls", cls)

    def over(df: DataFrame, margin: int) -> DataFrame:
        first = F.floor((F.col("p.s") - margin) / F.lit(scope)).cast("int")
        return df.select("_key", "p", F.explode(F.sequence(first, F.floor((F.col("p.e") + margin) / F.lit(scope)).cast("int"))).alias("bucket"))

    secrets = over(parts.where("cls = 'secret'"), scope).withColumnRenamed("p", "a")
    others = over(parts.where("cls <> 'secret'"), 0).withColumnRenamed("p", "b")
    near = (F.col("a.s") - F.col("b.e") <= scope) & (F.col("b.s") - F.col("a.e") <= scope) & ((F.col("a.e") <= F.col("b.s")) | (F.col("b.e") <= F.col("a.s")))
    pairs = secrets.join(others, ["_key", "bucket"]).where(near)
    hit = pairs.select("_key", F.explode(F.array("a", "b")).alias("p")).where(F.col("p.kind").isin(*[k for k, *_ in WEAK]))
    return hit.groupBy("_key").agg(F.sort_array(F.collect_set("p")).alias("linked"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE, in_bytes: bool = False) -> DataFrame:
    """A row for each document: id, base (array of spans s, o, e, kind, bs, be), linked (array), both sorted.

    The texts are read once; what is found goes to the shared folder and is joined from there.
    """
    found = materialise(base_and_weak(docs, id_col, text_col, in_bytes), "secrets")
    linked = link(found, scope)
    # Rows alike in id and text are joined with the one row of their key; those without weak parts have nothing to join.
    bare = found.where("size(weak) = 0").select("_id", "base", F.array().cast(SPANS).alias("linked"), "_key")
    met = found.where("size(weak) > 0").join(linked, "_key", "left").select("_id", "base", F.coalesce("linked", F.array().cast(SPANS)).alias("linked"), "_key")
    return bare.unionByName(met).withColumnRenamed("_id", id_col)


def _cut(text: Column, spans: Column, mark: str) -> Column:
    """The text with each run of overlapping spans (sorted, with bytes) replaced by mark."""
    raw = F.encode(text, "UTF-8")

    def pieces(r: Column, z: Column) -> Column:
        # Up to where the spans before it reach; a span that starts before that belongs to their run.
        before = lambda i: F.coalesce(F.get(z, i - 1)["to"], F.lit(0))
        own = F.transform(z, lambda x, i: F.when(x["x"]["bs"] >= before(i), F.decode(F.substring(r, before(i) + 1, x["x"]["bs"] - before(i)), "UTF-8")))
        last = F.element_at(z, -1)["to"]
        return F.array_join(F.concat(F.filter(own, lambda p: p.isNotNull()), F.array(F.decode(F.substring(r, last + 1, F.length(r)), "UTF-8"))), mark)

    reach = F.arrays_zip(spans.alias("x"), running(F.transform(spans, lambda x: x["be"]), F.greatest).alias("to"))
    return let(raw, lambda r: let(reach, lambda z: pieces(r, z)))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every base span of the text replaced by mark, and the linked weak ones too (columns as they were).

    Overlapping spans are merged first. Spans are joined back by id and text, and only
    documents that have any meet the join; the rest pass straight through.
    """
    at_key, at_spans = unused(docs, "_wl_key", "_wl_spans")
    spans = scan(docs, id_col, text_col, in_bytes=True)
    all_spans = spans.select(F.col("_key").alias(at_key), _union("base", "linked").alias(at_spans)).where(F.size(at_spans) > 0).dropDuplicates([at_key])
    joined = docs.withColumn(at_key, row_key(id_col, text_col)).join(all_spans, at_key, "left")
    new = F.when(F.col(at_spans).isNull(), F.col(text_col)).otherwise(_cut(F.coalesce(F.col(text_col), F.lit("")), F.col(at_spans), mark))
    return joined.withColumn(text_col, new).select(*(f"`{c}`" for c in docs.columns))


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")

    return out.select("doc_id", *[count(k).alias(f"n_{k}") for k, *_ in BASE], F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(_union("base", "linked")).alias("spans"))


def _oracle() -> str:
    """The query in SQL, with the same patterns."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    rows = [(k, p, g, n, []) for k, p, g, n in BASE] + [(k, p, 0, 0, m) for k, _, p, m in WEAK]
    kinds = []
    for k, p, g, n, must in rows:
        keep = " AND ".join([f"length(v) >= {n}", *(f"regexp_matches(v, {q(m)})" for m in must)])
        kinds.append(f"SELECT r, {q(k)} AS kind, {ORDER[k]} AS o, s, e FROM (SELECT r, v, CAST(sum(length(g) + length(m)) OVER (PARTITION BY r ORDER BY i) AS BIGINT) AS e, CAST(sum(length(g) + length(m)) OVER (PARTITION BY r ORDER BY i) - length(m) AS BIGINT) AS s FROM (SELECT r, generate_subscripts(ms, 1) AS i, unnest(ms) AS m, unnest(vs) AS v, unnest(gs[:len(ms)]) AS g FROM (SELECT r, regexp_extract_all(t, {q(p)}) AS ms, regexp_extract_all(t, {q(p)}, {g}) AS vs, string_split_regex(t, {q(p)}) AS gs FROM d) WHERE len(ms) > 0)) WHERE {keep}")
    cls = "CASE kind " + " ".join(f"WHEN {q(k)} THEN {q(c)}" for k, c in CLASS.items()) + " END"
    base = ", ".join(q(b[0]) for b in BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
k AS ({" UNION ALL ".join(kinds)}),
b AS (SELECT * FROM k WHERE kind IN ({base})),
w AS (SELECT * FROM k WHERE kind NOT IN ({base}) AND NOT EXISTS (SELECT 1 FROM b WHERE b.r = k.r AND b.s < k.e AND k.s < b.e)),
p AS (SELECT *, {cls} AS c FROM (SELECT * FROM b UNION ALL SELECT * FROM w)),
l AS (SELECT * FROM w WHERE EXISTS (SELECT 1 FROM p WHERE p.r = w.r AND (p.c = 'secret') <> ({cls.replace("kind", "w.kind")} = 'secret') AND (p.e <= w.s OR w.e <= p.s) AND p.s - w.e <= {SCOPE} AND w.s - p.e <= {SCOPE})),
x AS (SELECT *, true AS base FROM b UNION ALL SELECT *, false FROM l),
f AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  coalesce(string_agg(CASE WHEN base THEN kind || ':' || s || ':' || e END, ',' ORDER BY s, o), '') AS base_text, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans FROM x GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base_text, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN f USING (r)
"""


ORACLE = _oracle()

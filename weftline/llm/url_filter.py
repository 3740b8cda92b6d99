"""URL filters: host-suffix and path-prefix expressions against a hashed rule list.

Every url is expanded into the expressions that a rule could be written as; the
expressions join the rules on a short hash prefix, the full digests are then
compared, and among the rules that fit the longest decides. All of it is native.

Defined results: a null url, or one without ``://``, has an empty host and path and
the default verdict; repeated rows are each returned; an empty table gives no rows;
further columns are ignored; rules of equal length: the longer host wins, then block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import table

#: (verdict, host, path) of the registered query.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Hex digits of the digest that the equi-join uses.
PREFIX_HEX = 8
#: A rule list of at most so many rows is broadcast (about 150 bytes a row); a longer one is shuffled by hash prefix.
BROADCAST_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """verdict, rule_host, rule_path of a list of rules."""
    rows = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("rule_host"), F.lit(p).alias("rule_path")) for v, h, p in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """A row for each page: id, host, path, rule (null if none fits), verdict.

    The shapes of the rules (labels of the host, length of the path) say which
    expressions are worth making: one row with at most 127 label counts by the path
    lengths in use, sent to the urls; none of it reaches the driver or the plan.
    """
    rules = rules.select("verdict", F.translate("rule_host", UPPER, LOWER).alias("rule_host"), "rule_path")
    rules = rules.select("*", F.concat("rule_host", "rule_path").alias("rule"), (F.length("rule_host") - F.length(F.translate("rule_host", ".", "")) + 1).alias("labels"), F.length("rule_path").alias("path_len"))
    shapes = rules.agg(F.sort_array(F.collect_set(F.struct("labels", "path_len"))).alias("_shapes"))
    hashed = rules.select(F.sha2("rule", 256).alias("r_digest"), "rule", "rule_host", F.col("verdict").alias("r_verdict"))
    hashed = hashed.withColumn("prefix", F.left("r_digest", F.lit(PREFIX_HEX)))
    if rules.count() <= BROADCAST_RULES:
        hashed = F.broadcast(hashed)

    # Rows alike in id and url are judged once, and come back as often as they were there.
    own = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")).groupBy("_id", "_url").agg(F.count(F.lit(1)).alias("_n"))
    host, path = host_and_path(F.col("_url"))
    own = own.select("_id", "_url", "_n", host.alias("host"), path.alias("path"))
    labels = F.length("host") - F.length(F.translate("host", ".", "")) + 1
    own = own.crossJoin(F.broadcast(shapes))  # one row
    able = F.filter("_shapes", lambda x: (x["labels"] <= labels) & (x["path_len"] <= F.length("path")))
    digests = F.transform(able, lambda x: F.sha2(F.concat(F.call_function("substring_index", F.col("host"), F.lit("."), -x["labels"]), F.left(F.col("path"), x["path_len"])), 256))
    asked = own.select("_id", "_url", "_n", "host", "path", F.explode_outer(digests).alias("digest")).withColumn("prefix", F.left("digest", F.lit(PREFIX_HEX)))
    met = asked.join(hashed, "prefix", "left")
    fits = F.when(F.col("digest") == F.col("r_digest"), F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("h"), F.col("r_verdict").alias("verdict"), F.col("rule").alias("rule")))
    best = met.groupBy("_id", "_url", "_n", "host", "path").agg(F.max(fits).alias("best"))
    out = best.select(F.col("_id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), "_n")
    return out.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_i")).drop("_n", "_i")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


ORACLE = """
WITH r(verdict_r, rule, rule_host, rule_path) AS (VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'), ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
p0 AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p0),
m AS (SELECT p.*, r.*, row_number() OVER (PARTITION BY n ORDER BY length(rule) DESC NULLS LAST) AS k FROM p LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict_r, 'allow') AS verdict FROM m WHERE k = 1
"""

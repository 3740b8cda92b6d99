"""Quality rules as a bitmask ledger.

``ledger`` measures every text once and stores the measurements with one failure
bit a rule. A policy is a versioned mask over those bits: ``apply_policy`` decides
without reading a text again, and ``ablations`` tells from the bits alone what each
rule of a policy costs. All of it is native.

Words are ``[^\\x20\\x09-\\x0D]+``. Defined results: a null or empty text has no words
and zero measurements and fails ``few_words``; every row is measured by itself, so
null ids, repeated rows and ties need no care; an empty table gives no rows; further
columns are ignored by the query and passed on by ``ledger`` (measurement columns of
the same name are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import SPACE, SPACE_RE, let, table

SYMBOLS = "#*$%&|<>"


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text.

    Windows are compared by their 64-bit hash: sorted with their places, equal ones
    are neighbours, so the work is n log n however often a window repeats.
    """

    def in_text(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.struct(F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)).alias("h"), i.alias("i")))

        def covered(s: Column) -> Column:
            twice = F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
            return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        return F.when(F.size(w) >= 4, let(F.sort_array(windows), covered)).otherwise(0)

    return let(words, in_text).cast("long")


def measurements(text: Column) -> dict[str, Column]:
    """The measured columns of a text column without nulls."""
    words = F.array_remove(F.split(text, SPACE_RE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.translate(text, SPACE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _repeat_words(words),
        "n_upper": (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))).cast("long"),
    }


def _rules() -> dict[str, tuple[int, Column]]:
    """Failure bit of each rule, over the measurements. Bits are never given anew: old ledgers stay readable."""
    c = F.col
    return {
        "few_words": (0, c("n_words") < 50),
        "repeated_words": (1, 100 * c("n_repeat_words") > 50 * c("n_words")),
        "short_words": (2, c("word_chars") < 2 * c("n_words")),
        "long_words": (3, c("word_chars") > 20 * c("n_words")),
        "symbols": (4, c("n_symbols") > F.greatest(F.lit(20), F.lit(0.3) * c("n_words"))),
        "duplicate_lines": (5, (c("n_lines") >= 4) & (2 * c("n_dup_lines") > c("n_lines"))),
        "shouting": (6, 2 * c("n_upper") > c("word_chars")),
    }


RULE_BITS = {"few_words": 0, "repeated_words": 1, "short_words": 2, "long_words": 3, "symbols": 4, "duplicate_lines": 5, "shouting": 6}


def mask(names: list[str]) -> int:
    return sum(1 << RULE_BITS[n] for n in names)


#: Versioned policies: the rules that reject.
POLICIES = {"base": mask(["few_words", "repeated_words"]), "v1": mask(list(RULE_BITS))}


def ledger(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with the measurements and fail_bits (long), each rule evaluated once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = df.withColumns(measurements(text))
    bits = F.lit(0).cast("long")
    for bit, fails in _rules().values():
        bits = bits.bitwiseOR(F.when(fails, F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return out.withColumn("fail_bits", bits)


def failed(bits: Column, policy: str) -> Column:
    return bits.bitwiseAND(F.lit(POLICIES[policy]).cast("long")) != 0


def apply_policy(marked: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger's rows with kept by the policy of that version."""
    return marked.withColumn("kept", ~failed(F.col("fail_bits"), policy))


def ablations(marked: DataFrame, policy: str = "v1", by: list[str] | None = None) -> DataFrame:
    """For each rule of a policy: rows that fail it, rows that only it rejects, rows kept without it, all rows.

    One pass over the ledger: counts by distinct bit pattern (at most 2 to the number
    of rules, whatever the rows), then bitwise arithmetic on the patterns.
    """
    of, by = POLICIES[policy], by or []
    patterns = marked.groupBy(*by, F.col("fail_bits").bitwiseAND(F.lit(of).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << bit).cast("long").alias("bit")) for name, bit in RULE_BITS.items() if of >> bit & 1])
    each = patterns.select(*by, "bits", "n", F.inline(rules))
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    rest = F.col("bits").bitwiseAND(F.lit(of).cast("long").bitwiseXOR(F.col("bit")))
    return each.groupBy(*by, "rule").agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(hit & (rest == 0), F.col("n")).otherwise(0)).alias("n_only"), F.sum(F.when(rest == 0, F.col("n")).otherwise(0)).alias("n_kept_without"), F.sum("n").alias("n_rows"), F.bit_or("bits").alias("any_bits"), F.bit_and("bits").alias("all_bits"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = apply_policy(ledger(docs), "v1")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed(F.col("fail_bits"), "base").alias("base_failed"), "kept", "n_lines", "n_upper", "fail_bits")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
ln AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) > 0 GROUP BY r),
ws AS (SELECT r, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM ws),
g AS (SELECT r, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
t3 AS (SELECT r, i, count(*) OVER (PARTITION BY r, w, w2, w3) AS n FROM g WHERE w3 IS NOT NULL),
rep AS (SELECT r, count(DISTINCT k) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS k FROM t3 WHERE n >= 2) GROUP BY r),
m AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS n_upper
  FROM d JOIN ws USING (r) LEFT JOIN ln USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END) + (CASE WHEN word_chars < 2 * n_words THEN 4 ELSE 0 END) + (CASE WHEN word_chars > 20 * n_words THEN 8 ELSE 0 END)
  + (CASE WHEN n_symbols > greatest(20, 0.3 * n_words) THEN 16 ELSE 0 END) + (CASE WHEN n_lines >= 4 AND 2 * n_dup_lines > n_lines THEN 32 ELSE 0 END) + (CASE WHEN 2 * n_upper > word_chars THEN 64 ELSE 0 END) AS bits FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, bits = 0 AS kept, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_upper AS BIGINT) AS n_upper, CAST(bits AS BIGINT) AS fail_bits FROM b
"""

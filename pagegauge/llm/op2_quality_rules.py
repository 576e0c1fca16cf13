"""Operator 2: quality rules with risk-controlled thresholds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from .shared import join_on_size, let, stored, table, words_of

SYMBOLS = "[#*$%&|<>]"
#: Rules reject where the statistic (per mille, rounded down) is above the cutoff; cutoffs from loose to strict.
CUTOFFS = {
    "symbols": [900, 600, 400, 300, 200, 150, 100, 50],
    "dup_lines": [800, 600, 400, 300, 200, 100],
    "repeat_words": [450, 400, 300, 200, 150, 100],
    "long_words": [40000, 20000, 15000, 12000, 10000, 9000, 8000],
}
#: False rejections of good documents by all rules of a stratum together, and the chance that any bound is missed.
RISK, MISS = 0.05, 0.05


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that are found twice or more in the text.

    Windows stand for their 64-bit hashes. Only texts with a repeated window sort them: repeated windows by position,
    each counting the words up to the next one, three at most.
    """

    def marked(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        again = lambda s: F.filter(s, lambda e, k: e["x"].eqNullSafe(F.get(s, k - 1)["x"]) | e["x"].eqNullSafe(F.get(s, k + 1)["x"]))
        at = let(pairs, lambda s: F.sort_array(F.transform(again(s), lambda e: e["i"])))
        return let(at, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))

    def counted(w: Column) -> Column:
        h = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return let(h, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), marked(h)).otherwise(F.lit(0)))

    return let(words, counted)


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    row = docs.select(
        "doc_id",
        "lang",
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
        let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeat_words(w).cast("long").alias("n_repeat_words"))).alias("w"),
    )
    row = row.select("doc_id", "lang", "w.n_words", "w.word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words")
    return row.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def statistics() -> dict[str, Column]:
    rate = lambda a, b: F.floor(1000 * F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return {"symbols": rate("n_symbols", "n_words"), "dup_lines": rate("n_dup_lines", "n_lines"), "repeat_words": rate("n_repeat_words", "n_words"), "long_words": rate("word_chars", "n_words")}


def _log_factorial(n: Column) -> Column:
    """By Spark's factorial up to 20, beyond by Stirling's series (error below 1e-12)."""
    x = n + 1.0
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(k: Column, n: Column, p: float, terms: int = 5000) -> Column:
    """P(Bin(n, p) <= k) for k < n p (else 1): summed downwards from k in exact ratios. What is left after ``terms``
    terms is bounded by a geometric series and added, so the value is never too small."""
    k, n = k.cast("double"), n.cast("double")
    top = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    ratio = lambda i: i / (n - i + 1.0) * ((1 - p) / p)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    steps = F.when(k >= 1, F.sequence(F.lit(0), (F.least(k, F.lit(float(terms))) - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    step = lambda acc, j: F.struct((acc["term"] * ratio(k - j)).alias("term"), (acc["sum"] + acc["term"] * ratio(k - j)).alias("sum"))
    rest = lambda acc: acc["sum"] + F.when(k > terms, acc["term"] * ratio(k) / (1 - ratio(k))).otherwise(0.0)
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(top) * F.aggregate(steps, start, step, rest)))


def chosen_cutoffs(stats: DataFrame, labels: DataFrame, risk: float = RISK, miss: float = MISS) -> DataFrame:
    """(lang, <rule>...): for each stratum and rule the strictest safe cutoff, null where none is.

    The holdout is every labelled row of good quality that passes the base rules. With R rules, a rule may reject at
    most risk / R of a stratum's good documents. Its cutoffs are tested from loose to strict and testing stops at the
    first that fails (fixed sequence), each at level miss / (strata * R) (Bonferroni), by the exact binomial tail.
    """
    rules = list(CUTOFFS)
    good = labels.groupBy("doc_id").agg(F.max("quality").alias("q"), F.min("quality").alias("q0")).where("q = 1 and q0 = 1")
    held = stats.where("not base_failed").join(good.select("doc_id").hint("merge"), "doc_id")
    n = F.count("*").alias("n")
    rejected = [F.count_if(F.col(r) > c).alias(f"{r}_{i}") for r in rules for i, c in enumerate(CUTOFFS[r])]
    per = held.groupBy("lang").agg(n, *rejected)  # a row per stratum
    cells = per.select("lang", "n", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i).alias("i"), F.lit(c).alias("cutoff"), F.col(f"{r}_{i}").alias("k")) for r in rules for i, c in enumerate(CUTOFFS[r])])).alias("c")).select("lang", "n", "c.*")
    level = F.lit(miss / len(rules)) / F.size(F.collect_set(F.coalesce("lang", F.lit("\0"))).over(W.partitionBy()))
    cells = cells.withColumn("safe", binomial_tail(F.col("k"), F.col("n"), risk / len(rules)) <= level)
    sequence = W.partitionBy("lang", "rule").orderBy("i")
    cells = cells.withColumn("safe", F.min("safe").over(sequence)).where("safe")
    return cells.groupBy("lang").pivot("rule", rules).agg(F.min("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, miss: float = MISS) -> DataFrame:
    """Features of every row of ``docs(doc_id, text, lang)``, base_failed, rejected_by and kept.

    Null, empty and blank texts have no words and fail the base rules. A null lang is a stratum of its own. Labels:
    repeated labels of a document count once, and only if they agree; null qualities don't count; without (enough)
    labels no rule is safe and only the base rules decide. Rows with equal ids are judged each by its own text.
    """
    stats = features(docs)
    stats = stored(stats.select("*", *[x.alias(r) for r, x in statistics().items()]), "features")
    cut = chosen_cutoffs(stats, labels, risk, miss)
    cut = cut.select(F.col("lang").alias("cut_lang"), *[F.col(r).alias(f"cut_{r}") for r in CUTOFFS])
    joined = join_on_size(stats, cut, stats["lang"].eqNullSafe(cut["cut_lang"]), "left")
    by = F.array_compact(F.array(*[F.when(F.col(r) > F.col(f"cut_{r}"), F.lit(r)) for r in CUTOFFS]))
    joined = joined.withColumn("rejected_by", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(by))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"), "rejected_by",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumn("rejected_by", F.array_join("rejected_by", ","))


_GRID = ", ".join(f"('{r}', {i}, {c})" for r, cs in CUTOFFS.items() for i, c in enumerate(cs))
_P = RISK / len(CUTOFFS)
ORACLE = rf"""
WITH w AS (
  SELECT doc_id, lang, row_number() OVER () AS rid, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), tri AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS c FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), rep AS (
  SELECT rid, count(DISTINCT i + d) AS n FROM tri, (VALUES (0), (1), (2)) AS o(d) WHERE c > 1 GROUP BY rid
), ln AS (
  SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w
), f AS (
  SELECT doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '{SYMBOLS}'))::BIGINT AS n_symbols,
    len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w JOIN ln USING (rid) LEFT JOIN rep USING (rid)
), s AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    1000 * n_symbols // greatest(n_words, 1) AS symbols, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines,
    1000 * n_repeat_words // greatest(n_words, 1) AS repeat_words, 1000 * word_chars // greatest(n_words, 1) AS long_words FROM f
), held AS (
  SELECT s.* FROM s JOIN (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1 AND min(quality) = 1) USING (doc_id) WHERE NOT base_failed
), cell AS (
  SELECT lang, rule, i, cutoff, count(*) AS n, count(*) FILTER (CASE rule WHEN 'symbols' THEN symbols WHEN 'dup_lines' THEN dup_lines WHEN 'repeat_words' THEN repeat_words ELSE long_words END > cutoff) AS k
  FROM held, (VALUES {_GRID}) AS g(rule, i, cutoff) GROUP BY ALL
), tested AS (
  SELECT *, k < n * {_P} AND list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - CASE WHEN j > 0 THEN lgamma(j + 1) ELSE 0 END - lgamma(n - j + 1) + j * ln({_P}) + (n - j) * ln(1 - {_P}))))
    <= {MISS / len(CUTOFFS)} / (SELECT count(DISTINCT coalesce(lang, chr(0))) FROM cell) AS safe FROM cell
), cut AS (
  SELECT lang, rule, min(cutoff) AS cutoff FROM (SELECT *, bool_and(safe) OVER (PARTITION BY lang, rule ORDER BY i) AS ok FROM tested) WHERE ok GROUP BY lang, rule
), wide AS (
  SELECT lang, {", ".join(f"max(cutoff) FILTER (rule = '{r}') AS cut_{r}" for r in CUTOFFS)} FROM cut GROUP BY lang
), judged AS (
  SELECT s.*, CASE WHEN base_failed THEN '' ELSE concat_ws(',', {", ".join(f"CASE WHEN {r} > cut_{r} THEN '{r}' END" for r in CUTOFFS)}) END AS rejected_by
  FROM s LEFT JOIN wide ON s.lang IS NOT DISTINCT FROM wide.lang
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rejected_by = '' AS kept, rejected_by FROM judged
"""

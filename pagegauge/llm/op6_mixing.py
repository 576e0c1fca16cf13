"""Operator 6: mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from .shared import WORD, join_on_size, stored, table

WEIGHTS = [3, 1, 2]
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"


def text_size(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))).cast("long")


def source_targets(sizes: DataFrame, weights: list[float] | None = None, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target, rate) from ``sizes(source, size)``.

    Sources by code point, null last, have the given weights in turn, and share ``share`` of all sizes by weight; a
    target stops at ``most`` times its source's size and the excess is shared again. In closed form: by rising
    cap / weight, a source is capped while its cap is at most its share of what the capped ones leave.
    """
    weights = WEIGHTS if weights is None else weights
    per = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    # from here on there is one row per source
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    total = F.lit(float(share)) * F.sum("source_size").over(W.partitionBy())
    per = per.withColumn("level", (total - before) / left)
    free = F.col("cap") / F.col("weight") > F.col("level")
    per = per.withColumn("free_level", F.min(F.when(free, F.struct(F.col("cap") / F.col("weight"), "level"))).over(W.partitionBy()).getField("level"))
    per = per.withColumn("target", F.when(free, F.col("weight") * F.col("free_level")).otherwise(F.col("cap")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return per.select("source", "source_size", "target", rate.alias("rate"))


def row_key(doc_id: Column, text: Column) -> Column:
    """Digest of id and text; nulls count as empty."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows(mix_key, ...)`` with mix_no, the number from 0 of a row among those of equal key, which are alike.

    Only keys that come more than once are counted out; all other rows stay where they are.
    """
    again = rows.groupBy("mix_key").count().where("count > 1").select("mix_key")
    again = stored(again, "again")
    once = join_on_size(rows, again, "mix_key", "left_anti").withColumn("mix_no", F.lit(0).cast("long"))
    several = join_on_size(rows, again, "mix_key", "left_semi")
    # a group may be large: it is numbered in pieces, then pieces are put one behind the other
    several = several.withColumn("mix_piece", F.pmod(F.monotonically_increasing_id(), F.lit(64)))
    sizes = stored(several.groupBy("mix_key", "mix_piece").count(), "pieces")
    before = F.sum("count").over(W.partitionBy("mix_key").orderBy("mix_piece").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select("mix_key", "mix_piece", F.coalesce(before, F.lit(0)).alias("mix_before"))
    several = several.join(sizes.hint("merge"), ["mix_key", "mix_piece"])
    within = F.row_number().over(W.partitionBy("mix_key", "mix_piece").orderBy(F.lit(1))) - 1
    several = several.withColumn("mix_no", (within + F.col("mix_before")).cast("long")).drop("mix_piece", "mix_before")
    return once.unionByName(several.select(*once.columns))


def copies(key: Column, number: Column, rate: Column, seed: str = SEED) -> Column:
    """floor(rate), and one more with the probability of the fraction, by a seeded hash of a row's key and number."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key, F.lit(":"), number.cast("string"))), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    return (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mix_sources(docs: DataFrame, weights: list[float] | None = None, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """Rows of ``docs(doc_id, text, source, ...)``, each as often as the mix takes it; columns as given.

    Only (source, size) is aggregated, map-side first; the per-source rates go back by a broadcast whose size is
    checked, so texts are not shuffled and a hot source is no task of its own. Null sources are one source; null and
    empty texts have size 0; a source of size 0 has rate 0, so its rows go. The draw is by id and text, and among rows
    equal in both by their number, so null and repeated ids don't share one; such rows are alike, so which of them
    comes out doesn't matter, and how many is the same in each run.
    """
    rates = source_targets(docs.select("source", text_size(F.col("text")).alias("size")), weights, share, most)
    rates = rates.selectExpr("source mix_source_key", "rate mix_rate_of")
    rows = numbered(docs.withColumn("mix_key", row_key(F.col("doc_id"), F.col("text"))))
    joined = join_on_size(rows, rates, F.col("source").eqNullSafe(F.col("mix_source_key")))
    taken = joined.withColumn("mix_copies_of", copies(F.col("mix_key"), F.col("mix_no"), F.col("mix_rate_of"), seed)).where("mix_copies_of > 0")
    return taken.withColumn("mix_copy_of", F.explode(F.sequence(F.lit(1), F.col("mix_copies_of")))).select(*docs.columns)


def mixture(docs: DataFrame, weights: list[float] | None = None, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row: what ``mix_sources`` takes, without texts."""
    sizes = stored(docs.select("doc_id", "source", text_size(F.col("text")).alias("size"), row_key(F.col("doc_id"), F.col("text")).alias("mix_key")), "sizes")
    rates = source_targets(sizes, weights, share, most).withColumnRenamed("source", "key")
    joined = join_on_size(numbered(sizes), rates, F.col("source").eqNullSafe(F.col("key")))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * copies(F.col("mix_key"), F.col("mix_no"), F.col("rate"), seed)).alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS k, row_number() OVER (PARTITION BY doc_id, text) - 1 AS no
  FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS cap FROM per
), levels AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), aimed AS (
  SELECT source, source_size, CASE WHEN cap / weight > level
      THEN weight * (SELECT arg_min(level, cap / weight) FROM levels WHERE cap / weight > level) ELSE cap END AS target
  FROM levels
), rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM aimed
)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN ('0x' || substr(md5('{SEED}:' || k || ':' || CAST(no AS VARCHAR)), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source
"""

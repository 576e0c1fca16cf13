"""Operator 12: document fingerprints by consistent weighted sampling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from .shared import let, stored, table, words_of

SAMPLES = 32
SHINGLE = 5


def weighted_terms(text: Column, shingle: int = SHINGLE) -> Column:
    """array<struct<h, w>>: the distinct word shingles of a text as hashes, with the number of times each occurs. A
    text of fewer words has one shingle, a text without words none."""
    hashed = F.transform(words_of(text), lambda x: F.xxhash64(x))
    short = lambda w: F.when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
    full = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - shingle), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(shingle)]))
    shingles = let(hashed, lambda w: F.sort_array(F.when(F.size(w) < shingle, short(w)).otherwise(full(w))))

    def runs(s: Column) -> Column:
        places = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda at: F.transform(at, lambda i, j: F.struct(F.get(s, i).alias("h"), (F.coalesce(F.get(at, j + 1), F.size(s)) - i).alias("w"))))

    return let(shingles, runs)


def sample_value(h: Column, log_weight: Column, k: int) -> Column:
    """Sample ``k`` of one weighted term, as a number whose least one over all terms of a text is the text's slot.

    In Ioffe's scheme r and c are Gamma(2, 1) and beta is uniform, all from hashes of (term, k);
    t = floor(ln w / r + beta) is the same for near weights, ln a = ln c - r (t - beta + 1), and the term of the least
    a is the sample. Here r is the sum of the exponentials -ln u1 and -ln u2, and beta the share of the second, which
    is uniform and independent of the sum; then ln a = ln(c u1) - r t, and terms of weight 1, whose t is 0, take two
    logarithms, which is what costs most. ln a, to 25 binary places, stands in the upper bits and 30 bits of the term's
    hash below, so two slots are equal just where term and t are, but for a chance of about 2**-55.
    """
    h1, h2 = F.xxhash64(h, F.lit(2 * k)), F.xxhash64(h, F.lit(2 * k + 1))

    def uniform(x: Column, low: int) -> Column:
        return (F.shiftrightunsigned(x, low).bitwiseAND(F.lit((1 << 32) - 1).cast("long")) + F.lit(0.5)) / F.lit(float(1 << 32))

    u1, u2, c = uniform(h1, 32), uniform(h1, 0), -F.ln(uniform(h2, 32) * uniform(h2, 0))
    r = -F.ln(u1 * u2)
    log_a = F.ln(c * u1) - F.when(log_weight == 0, F.lit(0.0)).otherwise(r * F.floor((log_weight - F.ln(u2)) / r))
    return F.shiftleft(((log_a + 128) * F.lit(float(1 << 25))).cast("long"), 30).bitwiseOR(h2.bitwiseAND(F.lit((1 << 30) - 1).cast("long")))


def signatures(texts: DataFrame, keys: list[str], samples: int = SAMPLES, shingle: int = SHINGLE) -> DataFrame:
    """(keys, slots): the ``samples`` slots of each row of ``texts(keys, text)``; null for a text without words.

    ``keys`` have to name a row. Where ``texts`` is already partitioned by some of them nothing is shuffled; elsewhere
    a task combines its terms first, so a row of slots per text is what moves.
    """
    terms = texts.select(*keys, F.explode_outer(weighted_terms(F.col("text"), shingle)).alias("term"))
    terms = terms.select(*keys, F.col("term.h").alias("h"), F.ln(F.col("term.w").cast("double")).alias("log_weight"))
    out = terms.groupBy(*keys).agg(*[F.min(sample_value(F.col("h"), F.col("log_weight"), k)).alias(f"slot_{k}") for k in range(samples)])
    slots = F.array(*[F.col(f"slot_{k}") for k in range(samples)])
    return out.select(*keys, F.when(F.col("slot_0").isNotNull(), slots).alias("slots"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal slots, an estimate of the generalised Jaccard similarity; texts without words are alike."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(equal)


def as_text(slots: Column) -> Column:
    """A fingerprint as a string; empty for texts without words."""
    return F.coalesce(F.array_join(F.transform(slots, lambda x: F.lower(F.hex(x))), ""), F.lit(""))


def _order(doc_id: Column, text: Column) -> list[Column]:
    return [doc_id.isNull().alias("none"), F.coalesce(doc_id.cast("long"), F.lit(0).cast("long")).alias("id"), F.xxhash64(text).alias("hash")]


def in_order(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` by ranges of the order (doc_id, text hash, text), null ids last, with the columns
    bucket, guest, place (from 1 in a bucket) and next_text, the following row's text.

    Ranges are cut by Spark's own sample of the keys, so a null or repeated id is split, too. The first row of each
    range is also the last of the range before, as a guest (that of the first range closes the last), so no order over
    all rows in one task is needed. The lowest keys, one for each shuffle partition, are all that the driver sees.
    Rows equal in id and text are one key.
    """
    docs = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keys = stored(docs.select(*_order(F.col("doc_id"), F.col("text"))), "keys")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keys.repartitionByRange(parts, "none", "id", "hash").withColumn("part", F.spark_partition_id())
    lows = sorted(tuple(r.low) for r in ranged.groupBy("part").agg(F.min(F.struct("none", "id", "hash")).alias("low")).collect())
    if not lows:
        return docs.selectExpr("*", "0 bucket", "false guest", "1 place", "text next_text")
    cuts = F.array(*[F.struct(F.lit(a).alias("none"), F.lit(b).cast("long").alias("id"), F.lit(c).cast("long").alias("hash")) for a, b, c in lows])
    steps = [1 << i for i in reversed(range(len(lows).bit_length()))]
    rows = docs.withColumn("key", F.struct(*_order(F.col("doc_id"), F.col("text"))))
    seek = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when((at + s < len(lows)) & (F.get(cuts, at + s) <= F.col("key")), at + s).otherwise(at))
    rows = rows.withColumn("own", seek)
    home, away = F.struct(F.col("own").alias("bucket"), F.lit(False).alias("guest")), F.struct(F.pmod(F.col("own") - 1, F.lit(len(lows))).cast("int").alias("bucket"), F.lit(True).alias("guest"))
    rows = rows.select("doc_id", "text", "key", F.inline(F.when(F.get(cuts, F.col("own")) == F.col("key"), F.array(home, away)).otherwise(F.array(home))))
    window = W.partitionBy("bucket").orderBy("guest", "key", "text")
    return rows.select("doc_id", "text", "bucket", "guest", F.row_number().over(window).alias("place"), F.lead("text").over(window).alias("next_text"))


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last half (rounded down) replaced by as many of the first code points of ``following``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprint_edits(docs: DataFrame, samples: int = SAMPLES, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, slots, edited_slots, near_edited, near_next) of every row of
    ``docs(doc_id, text)``, in which the edited text ends with the beginning of the next row's.

    Null texts are empty. Rows come in the order of (doc_id, text hash, text), null ids last; rows equal in both follow
    each other, and after the last comes the first, itself if it is alone. An empty table gives no rows. Other columns
    are ignored. Texts of any length are read whole: hashes of a text's shingles are an array within its row.
    """
    rows = in_order(docs)
    both = F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("text")), F.struct(F.lit(1).alias("which"), edited(F.col("text"), F.col("next_text")).alias("text")))
    both = F.when(F.col("guest"), F.slice(both, 1, 1)).otherwise(both)
    rows = rows.select("bucket", "place", "guest", "doc_id", F.inline(both))
    rows = rows.select("bucket", "place", "guest", "doc_id", "which", F.length("text").cast("long").alias("n_chars"), F.when(F.col("which") == 1, F.sha2("text", 256)).alias("sha"), "text")
    # partitioned by bucket from the window on: none of what follows is shuffled again
    signed = signatures(rows, ["bucket", "place", "guest", "doc_id", "which", "n_chars", "sha"], samples, shingle)
    window = W.partitionBy("bucket").orderBy("place", "which")
    out = signed.select("*", F.lead("slots").over(window).alias("edited_slots"), F.lead("sha").over(window).alias("edited_sha256"), F.lead("slots", 2).over(window).alias("next_slots"))
    out = out.where("which = 0 and not guest")
    return out.select("doc_id", "n_chars", "edited_sha256", "slots", "edited_slots", likeness(F.col("slots"), F.col("edited_slots")).alias("near_edited"), likeness(F.col("slots"), F.col("next_slots")).alias("near_next"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("slots")).alias("fingerprint"), as_text(F.col("edited_slots")).alias("edited_fingerprint"), "near_edited", "near_next")

"""Corpus pipeline: toxicity, near duplicates, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all that the stage before has kept, and is written as Parquet and
read again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegauge.llm.op1_jaccard_join import jaccard_components
from pagegauge.llm.op4_sharding import assign_shards
from pagegauge.llm.op6_mixing import mix_sources
from pagegauge.llm.op9_decontamination import remove_contaminated
from pagegauge.llm.op10_toxicity import remove_toxic
from pagegauge.llm.shared import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic."""
    return remove_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked texts: one with the smallest id, null ids last. Rows are told apart by a number
    of their own that is stored with them, so null and repeated ids link, stay and go by their own texts."""
    rows = stored(docs.withColumn("row_no", F.monotonically_increasing_id()), "rows")
    groups = stored(jaccard_components(rows.select(F.col("row_no").alias("doc_id"), "text")), "groups")
    named = groups.select(F.col("doc_id").alias("row_no"), F.col("component_id")).join(rows.select("row_no", "doc_id").hint("merge"), "row_no")
    keep = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_no")).alias("first")).select("first.row_no")
    return rows.join(keep.hint("merge"), "row_no", "left_semi").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or thinned out to the weights of their sources."""
    return mix_sources(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with slot and shard."""
    return assign_shards(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("sharding", shard),
]

#: The first stage is a trained classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs

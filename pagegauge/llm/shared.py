"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder of the session.

    ``spark.checkpoint.dir`` is the cluster's shared folder; a folder of our own is set only where the setting is
    missing, as in tests.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        import tempfile

        root = tempfile.mkdtemp(prefix="pagegauge-")
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows with long texts go to Python in batches of about this size, so workers and executors stay small.
_BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(_BATCH[0], None)
    spark.conf.set(*_BATCH)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_BATCH[0]) if before is None else spark.conf.set(_BATCH[0], before)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> DataFrame:
    """``df`` as it is. Spark deletes the shuffle files of a finished job once the driver has collected its plan as
    garbage, which may be late; this asks for it now. It takes two collections, as plans have finalisers. For use after
    steps that shuffle about as much as the input, by callers that hold nothing of their plans."""
    for _ in range(2):
        df.sparkSession._jvm.System.gc()
        time.sleep(0.2)
    return df


def let(value: Column, body) -> Column:
    """Bind ``value`` to a name, so that it is computed once per row however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """All words of a text; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def small(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than one row beyond that."""
    return df.limit(rows + 1).count() <= rows


def join_on_size(left: DataFrame, right: DataFrame, on, how: str = "inner", rows: int = 200_000) -> DataFrame:
    """Broadcast ``right`` after its size is checked; beyond ``rows`` rows, sort-merge (AQE splits hot keys)."""
    return left.join(right.hint("broadcast" if small(right, rows) else "merge"), on, how)

"""Sources: stored captures, contracts, policies, rasters, file trees, telemetry; and sinks."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; a local session without one gets a folder of its own."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        import tempfile

        root = tempfile.mkdtemp(prefix="pagegauge-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return os.path.join(root, f"{name}-{uuid.uuid4().hex}")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Rows written to the shared folder and read back: a short plan, known sizes, and no loss with an executor."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], text: str = "html", most: int = 1 << 20) -> Iterator[list[dict]]:
    """Rows of Arrow batches some at a time, about ``most`` bytes of ``text`` each and at least one row, so that a
    worker holds the results of a few pages and not those of a batch."""
    for batch in batches:
        begin, size = 0, 0
        for i, n in enumerate(pc.binary_length(batch.column(text)).to_pylist()):
            size += (n or 0) + 64
            if size >= most:
                yield batch.slice(begin, i + 1 - begin).to_pylist()
                begin, size = i + 1, 0
        if begin < batch.num_rows:
            yield batch.slice(begin).to_pylist()


#: Arrow types of the columns that workers give.
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "map<string,string>": pa.map_(pa.string(), pa.string()), "array<long>": pa.list_(pa.int64())}


def arrow_schema(ddl: str, **more: pa.DataType) -> pa.Schema:
    """Schema of a DDL text of flat columns, and of further ones."""
    columns = [c.split(" ") for c in ddl.split(", ")]
    return pa.schema([(n, _ARROW[k]) for n, k in columns] + list(more.items()))


def load_pages(spark: SparkSession, path: str) -> DataFrame:
    """Captured pages; where a status is stored, only 2xx captures are admitted."""
    pages = spark.read.parquet(path)
    return pages.where(F.col("status").between(200, 299)) if "status" in pages.columns else pages


CONTRACT = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("viewport", T.StringType()),
        T.StructField("links", T.ArrayType(T.StructType([T.StructField("href", T.StringType()), T.StructField("text", T.StringType())]))),
        T.StructField("axNodes", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("name", T.StringType()), T.StructField("properties", T.MapType(T.StringType(), T.StringType()))]))),
    ]
)


def load_contracts(spark: SparkSession, glob: str, schema: T.StructType = CONTRACT, multi_line: bool = True) -> DataFrame:
    """One row per contract document; a malformed one fails the job."""
    return spark.read.schema(schema).option("multiLine", multi_line).option("mode", "FAILFAST").json(glob)


def load_summaries(spark: SparkSession, glob: str, schema: T.StructType) -> DataFrame:
    """One row per viewport result; a summary without results is an error."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(glob)
    empty = F.raise_error(F.lit("a summary holds no results")).cast("boolean")
    return rows.where(F.when(F.size("results") > 0, True).otherwise(empty)).select(F.explode("results").alias("r")).select("r.*")


def load_policy(spark: SparkSession, path: str, defaults: list[str]) -> tuple[DataFrame, DataFrame]:
    """(gates(viewport, gate, limit), approvals(rule, viewport, category, kind, key, fields, rationale))."""
    approval = "struct<viewport:string,category:string,kind:string,key:string,changeFields:array<string>,rationale:string>"
    kind = f"schemaVersion int, gates map<string,double>, viewports map<string,map<string,double>>, approvedSemanticMismatches array<{approval}>"
    p = spark.read.schema(kind).option("multiLine", True).option("mode", "FAILFAST").json(path)
    base = p.select(F.lit(None).cast("string").alias("viewport"), F.explode("gates").alias("gate", "limit"))
    own = p.select(F.explode("viewports").alias("viewport", "g")).select("viewport", F.explode("g").alias("gate", "limit"))
    rules = p.select(F.posexplode("approvedSemanticMismatches").alias("rule", "a")).select("rule", "a.viewport", "a.category", "a.kind", "a.key", F.col("a.changeFields").alias("fields"), "a.rationale")
    return base.unionByName(own).where(F.col("gate").isin(defaults)), rules


def load_pixels(spark: SparkSession, glob: str) -> DataFrame:
    """(origin, y, x, r, g, b, a) of image files. The JVM decodes; bytes arrive as BGR(A) rows."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                h, w, c = row["height"], row["width"], row["nChannels"]
                data = np.frombuffer(row["data"], np.uint8).reshape(h * w, c)
                b, g, r = (data[:, 0],) * 3 if c == 1 else (data[:, 0], data[:, 1], data[:, 2])
                a = data[:, 3] if c == 4 else np.full(h * w, 255)
                at = np.arange(h * w)
                for s in range(0, h * w, 1 << 18):
                    t = slice(s, s + (1 << 18))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["origin"]] * len(at[t])), *(pa.array(v[t].astype(np.int32)) for v in (at // w, at % w, r, g, b, a))],
                        names=["origin", "y", "x", "r", "g", "b", "a"],
                    )

    images = spark.read.format("image").option("recursiveFileLookup", True).load(glob).select("image.*")
    return images.mapInArrow(unpack, "origin string, y int, x int, r int, g int, b int, a int")


def scan_tree(spark: SparkSession, root: str, max_bytes: int = 5 << 20, skip: tuple[str, ...] = (".git", "node_modules")) -> DataFrame:
    """(path, bytes, content, oversize): files below ``root``; content of oversized files is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    outside = ~F.col("path").rlike("/(" + "|".join(s.replace(".", "[.]") for s in skip) + ")/")
    small = files.where(outside & (F.col("length") <= max_bytes)).select("path", F.col("length").alias("bytes"), "content", F.lit(False).alias("oversize"))
    large = files.where(outside & (F.col("length") > max_bytes)).select("path", F.col("length").alias("bytes"), F.lit(None).cast("binary").alias("content"), F.lit(True).alias("oversize"))
    return small.unionByName(large)


def write_run(df: DataFrame, path: str, run_id: str) -> None:
    """Write the rows of a run once: of several writers of one id, one wins and the others are refused.

    The id is claimed by creating a file that must not exist, rows go to a staged folder that readers of ``path`` skip,
    and one rename makes them visible, so nothing half-written is ever read. A writer that fails gives its claim back;
    one that is lost keeps it, and its id has to be freed by hand, as it may still be writing.
    """
    import uuid

    spark = df.sparkSession
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    final, claim, staged = make(f"{path}/run_id={run_id}"), make(f"{path}/_claims/{run_id}"), make(f"{path}/_staged/{run_id}-{uuid.uuid4().hex}")
    fs = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    refused = ValueError(f"run {run_id} is stored already, or being stored")
    if fs.exists(final):
        raise refused
    try:
        fs.create(claim, False).close()
    except Exception as e:
        if "FileAlreadyExists" in str(e) or fs.exists(claim):
            raise refused from None
        raise
    try:
        df.write.parquet(staged.toString())
        if fs.exists(final) or not fs.rename(staged, final):
            raise refused
    except Exception:
        fs.delete(staged, True)
        fs.delete(claim, False)
        raise

"""Operator 10: toxicity by subword-bag embeddings and a linear softmax."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokensets as ts
from .shared import stored, table

#: Character n-grams (of UTF-8 bytes, within a word and its edges), hash buckets, and width of the embeddings.
LENGTHS, BUCKET_BITS, WIDTH = (3, 4, 5), 18, 8
#: The training sample: at most so many labelled documents of either class, by a hash of their ids.
TOXIC_ROWS, CLEAN_ROWS = 2500, 5000
EPOCHS, RATE, SEED = 8, 0.2, 11
_T = np.random.default_rng(5).integers(1, 2**63, (max(LENGTHS), 256), dtype=np.uint64)
_NORMAL = np.where(ts._SPACE, 0x20, ts._LOWER).astype(np.uint8)


def grams(raw: np.ndarray, offsets: np.ndarray):
    """For each length of n-gram: (bucket, flag of a real n-gram, position) over the padded bytes of all texts; and the
    offsets of the texts in them. Letters A-Z are lowered, white space is one kind of edge."""
    rows = len(offsets) - 1
    padded = np.full(len(raw) + rows + 1, 0x20, np.uint8)
    padded[np.arange(len(raw)) + np.repeat(np.arange(1, rows + 1), np.diff(offsets))] = _NORMAL[raw]
    starts = offsets + np.arange(rows + 1)
    inner = padded != 0x20
    h = _T[0][padded]
    found = []
    clear = inner[1:]
    for n in range(2, max(LENGTHS) + 1):
        h = h[:-1] + _T[n - 1][padded[n - 1 :]]
        if n > 2:
            clear = clear[:-1] & inner[n - 2 : n - 2 + len(clear) - 1] if n > 3 else inner[1 : len(h) + 1]
        if n in LENGTHS:
            found.append(((ts.mix(h) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32), clear[: len(h)]))
    return found, starts


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    at = np.minimum(starts, len(values))
    return total[at[1:]] - total[at[:-1]]


def bags(raw: np.ndarray, offsets: np.ndarray):
    """Distinct buckets and counts of each text."""
    found, starts = grams(raw, offsets)
    for i in range(len(offsets) - 1):
        parts = [b[starts[i] : starts[i + 1]][m[starts[i] : starts[i + 1]]] for b, m in found]
        yield np.unique(np.concatenate(parts), return_counts=True)


def train(labels: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, float]:
    """Embeddings and softmax trained jointly by Adagrad; returns the margin of each bucket and the bias."""
    rng = np.random.default_rng(SEED)
    e = (rng.random((1 << BUCKET_BITS, WIDTH), np.float32) - 0.5) / WIDTH
    u, bias = rng.normal(0, 1, (WIDTH, 2)).astype(np.float32), np.zeros(2, np.float32)
    ge, gu, gb = np.full(1 << BUCKET_BITS, 1e-6, np.float32), np.float32(1e-6) * np.ones_like(u), np.float32(1e-6) * np.ones_like(bias)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(rows)):
            at, count = rows[i]
            if len(at) == 0:
                continue
            share = (count / count.sum()).astype(np.float32)
            h = share @ e[at]
            z = h @ u + bias
            p = np.exp(z - z.max())
            d = (p / p.sum()).astype(np.float32)
            d[labels[i]] -= 1
            to_h = u @ d
            gu += np.outer(h, d) ** 2
            gb += d**2
            u -= rate * np.outer(h, d) / np.sqrt(gu)
            bias -= rate * d / np.sqrt(gb)
            ge[at] += share**2 * float(to_h @ to_h) / WIDTH
            e[at] -= (rate * share / np.sqrt(ge[at]))[:, None] * to_h
    return (e @ (u[:, 1] - u[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def held_out(doc_id):
    """Rows that training never sees: CRC-32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> tuple[np.ndarray, float]:
    """The model from a bounded, documented sample of labelled rows outside the holdout, trained in one task.

    Repeated labels of a document count once (the larger one); null labels don't count.
    """
    rows = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y")).where(~held_out(F.col("doc_id")))
    pick = lambda y, n: rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = stored(pick(1, toxic_rows).union(pick(0, clean_rows)), "sample")

    def featurise(batches):
        for batch in batches:
            raw, offs = ts.flat(batch.column("text"))
            y = batch.column("y")
            for a, b in ts.slices(offs):
                got = list(bags(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), y.slice(a, b - a), pa.array([g[0].astype(np.int32).tobytes() for g in got], pa.binary()), pa.array([g[1].astype(np.int32).tobytes() for g in got], pa.binary())],
                    names=["doc_id", "y", "at", "n"],
                )

    def learn(batches):
        got = [r for b in batches for r in zip(b.column("doc_id").to_pylist(), b.column("y").to_pylist(), b.column("at").to_pylist(), b.column("n").to_pylist(), strict=True)]
        got.sort(key=lambda r: (r[0], r[2], r[3]))  # whatever the order of arrival, the same model
        y = np.array([r[1] for r in got], int)
        margin, bias = train(y, [(np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.int32)) for r in got])
        yield pa.RecordBatch.from_arrays([pa.array([margin.tobytes()], pa.binary()), pa.array([bias])], names=["margin", "bias"])

    # the sample has a fixed number of rows, so its ids may be broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"])
    features = texts.mapInArrow(featurise, "doc_id long, y int, at binary, n binary")
    model = stored(features.repartition(1).mapInArrow(learn, "margin binary, bias double"), "model").first()
    if model is None:
        return np.zeros(1 << BUCKET_BITS, np.float32), -1.0
    # the sample holds the classes in other shares than the labels: correct the odds
    odds = rows.agg(F.count_if(F.col("y") == 1).alias("toxic"), F.count_if(F.col("y") == 0).alias("clean")).first()
    prior = np.log((odds.toxic + 1) / (odds.clean + 1) * (min(odds.clean, clean_rows) + 1) / (min(odds.toxic, toxic_rows) + 1))
    return np.frombuffer(model.margin, np.float32), model.bias + float(prior)


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """``docs`` with a column score: the model's probability of label 1, from the whole text of each row.

    Null and empty texts, and texts without an n-gram, get the score of the bias alone. Texts of any length are read
    whole. The model is broadcast; its size is fixed. A column named score in ``docs`` is replaced.
    """
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        margin, bias = shared.value
        for batch in batches:
            raw, offs = ts.flat(batch.column("text"))
            out = np.zeros(batch.num_rows)
            for a, b in ts.slices(offs):
                found, starts = grams(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                total, count = np.zeros(b - a), np.zeros(b - a)
                for bucket, real in found:
                    total += _sums(np.where(real, margin[bucket], 0), starts)
                    count += _sums(real, starts)
                out[a:b] = total / np.maximum(count, 1) + bias
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(out, -50, 50))))], names=[*batch.schema.names, "score"])

    kinds = [*docs.schema.fields]
    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(work, StructType([*kinds, StructField("score", DoubleType())]))


def remove_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that score below ``threshold``, columns as given."""
    return score(docs, fit(docs, labels)).where(F.col("score") < threshold).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

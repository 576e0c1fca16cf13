"""Operator 8: near-duplicate lines by an exact set-similarity join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import setjoin as sj
from .shared import release, stored, table


#: Pairs of sets whose overlaps are counted at once.
PAIRS = 1 << 16


def overlap_match(flat: np.ndarray, offsets: np.ndarray, groups: list[tuple[int, int, int]], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (asking, held) of the pairs, in any of the groups (begin, first asking, end), whose Jaccard coefficient
    reaches ``percent`` / 100. Groups are worked on some at a time, large ones by a slice of their asking sets."""
    out = [np.zeros((2, 0), np.int64)]
    some, pairs = [], 0
    for begin, middle, end in groups:
        step = max(1, PAIRS // (middle - begin))
        for x in range(middle, end, step):
            some.append((begin, middle, x, min(x + step, end)))
            pairs += (middle - begin) * (some[-1][3] - x)
            if pairs >= PAIRS:
                out.append(_overlaps(flat, offsets, np.array(some), percent))
                some, pairs = [], 0
    if some:
        out.append(_overlaps(flat, offsets, np.array(some), percent))
    return tuple(np.concatenate(out, axis=1))


def _spread(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(range, place) of all places of the ranges begin, begin + 1, ... of the sizes given."""
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + begin[which]


def _overlaps(flat: np.ndarray, offsets: np.ndarray, some: np.ndarray, percent: int) -> np.ndarray:
    n = np.diff(offsets)
    held, asking = some[:, 1] - some[:, 0], some[:, 3] - some[:, 2]
    base = np.append(0, np.cumsum(held * asking))
    # tokens with their group, and the number of their set in it
    h_group, h_row = _spread(some[:, 0], held)
    h_set, h_at = _spread(offsets[h_row], n[h_row])
    a_group, a_row = _spread(some[:, 2], asking)
    a_set, a_at = _spread(offsets[a_row], n[a_row])
    vocabulary, h_token = np.unique(flat[h_at], return_inverse=True)
    a_token = np.searchsorted(vocabulary, flat[a_at])
    a_token[a_token == len(vocabulary)] = 0
    known = np.flatnonzero(vocabulary[a_token] == flat[a_at])
    a_set, a_token = a_set[known], a_token[known]
    h_key, a_key = h_group[h_set] * len(vocabulary) + h_token, a_group[a_set] * len(vocabulary) + a_token
    order = np.argsort(h_key, kind="stable")
    h_key = h_key[order]
    low = np.searchsorted(h_key, a_key, "left")
    at, place = _spread(low, np.searchsorted(h_key, a_key, "right") - low)
    a_set, h_set = a_set[at], h_set[order[place]]
    g = a_group[a_set]
    pair = base[g] + (a_row[a_set] - some[g, 2]) * held[g] + h_row[h_set] - some[g, 0]
    both = np.bincount(pair, minlength=int(base[-1]))
    pair = np.flatnonzero(both)
    g = np.searchsorted(base, pair, "right") - 1
    i, j = (pair - base[g]) // held[g] + some[g, 2], (pair - base[g]) % held[g] + some[g, 0]
    ok = 100 * both[pair] >= percent * (n[i] + n[j] - both[pair])
    return np.stack([i[ok], j[ok]])


def earlier(i: np.ndarray, j: np.ndarray, columns: dict) -> list[np.ndarray]:
    """(sid): the sets that ask and are similar to one of lower rank."""
    r1, r2 = columns["r1"], columns["r2"]
    return [np.unique(columns["sid"][i[(r1[j] < r1[i]) | ((r1[j] == r1[i]) & (r2[j] < r2[i]))]])]


def removed_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, tkey, number) of the lines to remove from the texts of hash ``tkey``: an earlier line has the same words or a Jaccard coefficient of at
    least ``percent`` / 100; earlier by (doc_id, hash of the text, number), null ids last, whether or not it is removed
    itself.

    Lines are the \\n-split parts of a text, their tokens its distinct words, lower-cased in A-Z. Lines without a word
    (and so null and empty texts) match nothing. Rarer words come first in prefixes; candidates pass length, positional
    and bitmap filters before they are verified on their words.
    """
    unit = sj.line_unit()
    docs = docs.select("doc_id", "text")
    profiled = sj.profile(docs, unit)
    order = sj.token_order(profiled)
    # null ids rank behind the largest id; different texts of one id, or without one, by 30 bits of their hash; numbers
    # of lines are below 2**32
    null = F.col("doc_id").isNull().cast("long") * F.lit(1 << 62)
    tie = F.shiftleft(F.col("tkey").bitwiseAND(F.lit((1 << 30) - 1).cast("long")), 32)
    rank = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("r1"), (F.col("number") + tie + null).alias("r2"))
    records = profiled.where("chunk is null and n > 0").select("doc_id", "number", "sid", "n", "tkey", rank.alias("rank"))
    first = records.groupBy("sid", "n").agg(F.min(F.struct("rank", "tkey", "number")).alias("first"), F.count("*").alias("copies"))
    sets = stored(first.selectExpr("sid", "n", "copies", "first.rank.r1", "first.rank.r2", "first.tkey", "first.number"), "distinct")
    shared = release(sj.mates(sj.prefix_entries(docs, unit, order, percent, bitmaps=True), percent, first=True))
    state = sj.clusters(shared, percent).select("sid", "cluster", "cnt").join(sets.hint("merge"), "sid")
    state = stored(state.selectExpr("sid", "n", "cluster", "cnt", "0L label", "r1", "r2", "tkey", "number"), "state")
    tokens = release(sj.set_tokens(docs, state, unit, order))
    columns = ["g", "sid", "n", "label", "r1", "r2"]

    def later(asking: DataFrame, held: DataFrame) -> DataFrame:
        found = sj.compare(asking.select(*columns), held.select(*columns), tokens, percent, overlap_match, earlier, "sid long")
        return stored(found.distinct(), "later")

    # lines that are like the earliest one of a run are settled; only the others meet the clusters of all earlier lines
    hubs = stored(sj.hubs(shared, state, percent, count=False), "hubs")
    held = hubs.select(F.col("g").alias("sid")).distinct().join(state.hint("merge"), "sid").withColumn("g", F.col("sid"))
    gone = release(later(hubs.join(state.hint("merge"), "sid"), held))
    state = stored(state.drop("label").join(gone.withColumn("label", F.lit(1).cast("long")).hint("merge"), "sid", "left").fillna(0, ["label"]), "state")
    asks = stored(sj.waiting(shared, state, percent, other=False), "waiting")
    held = state.join(asks.selectExpr("g cluster").distinct().hint("merge"), "cluster").withColumn("g", F.col("cluster"))
    gone = gone.union(later(asks.join(state.hint("merge"), "sid"), held))

    marked = sets.select("sid", "copies", "r1", "r2").join(gone.withColumn("gone", F.lit(True)).hint("merge"), "sid", "left").where("copies > 1 or gone")
    is_later = (F.col("rank") > F.struct("r1", "r2")) | F.coalesce("gone", F.lit(False))
    return records.select("doc_id", "tkey", "number", "sid", "rank").join(marked.hint("merge"), "sid").where(is_later).select("doc_id", "tkey", "number")


def dedup_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs(doc_id, text, ...)`` with the columns n_lines, n_removed and kept_text.

    Rows are known by id and text: different texts of one id, or without an id, are documents of their own, in the
    order of their hashes. Rows equal in both are one document written twice: they lose the same lines, and none to
    each other. A null text stays null with 0 lines. Columns of these names
    in ``docs`` are replaced.
    """
    docs = docs.drop("n_lines", "n_removed", "kept_text")
    gone = release(stored(removed_lines(docs, percent).groupBy(F.col("doc_id").alias("gone_id"), F.col("tkey").alias("gone_key")).agg(F.collect_set("number").alias("gone_numbers")), "gone"))
    same = docs["doc_id"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_key"])
    joined = docs.join(gone.hint("merge"), same, "left")
    lines = F.split(F.col("text"), "\n")
    left = F.array_except(F.sequence(F.lit(0).cast("long"), F.size(lines).cast("long") - 1), F.coalesce("gone_numbers", F.array().cast("array<bigint>")))
    row = joined.withColumn("line_parts", F.transform(F.array(F.struct(lines.alias("all"), left.alias("left"))), lambda b: F.struct(F.size(b["all"]).cast("long").alias("n"), F.size(b["left"]).cast("long").alias("m"), F.array_join(F.transform(b["left"], lambda i: F.get(b["all"], i.cast("int"))), "\n").alias("text")))[0])
    n = F.when(F.col("text").isNull(), 0).otherwise(F.col("line_parts.n"))
    m = F.when(F.col("text").isNull(), 0).otherwise(F.col("line_parts.n") - F.col("line_parts.m"))
    return row.select(*[docs[c] for c in docs.columns], n.cast("long").alias("n_lines"), m.cast("long").alias("n_removed"), F.when(F.col("text").isNotNull(), F.col("line_parts.text")).alias("kept_text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("kept_text", F.lit(""))).alias("kept_md5"))

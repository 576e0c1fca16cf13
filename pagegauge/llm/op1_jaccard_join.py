"""Operator 1: n-gram Jaccard join with a prefix tree."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import setjoin as sj
from .components import connected_components
from .shared import release, stored, table


class PrefixTree:
    """A path-compressed trie of token sets in one global order, which many probes walk together.

    At each node the probes that are still in hold their overlap with the path so far, so all sequences below a node
    share it. A probe leaves a subtree when what remains of the subtree's sequences and of the probe can't reach the
    least overlap needed.
    """

    #: Tokens of a path between two looks at the bounds; cells of the table of tokens and probes.
    STEP, CELLS = 48, 1 << 24

    def __init__(self, sequences: list[np.ndarray]):
        sizes = np.array([len(s) for s in sequences])
        self.vocabulary, ids = np.unique(np.concatenate(sequences), return_inverse=True)
        parts = np.split(ids.astype(np.int32), np.cumsum(sizes)[:-1])
        self.order = sorted(range(len(sequences)), key=lambda i: parts[i].astype(">i4").tobytes())
        self.paths = [parts[i] for i in self.order]
        self.sizes = sizes[self.order].tolist()
        self.shared = [0]
        for a, b in zip(self.paths, self.paths[1:], strict=False):
            m = min(len(a), len(b))
            differ = a[:m] != b[:m]
            self.shared.append(int(differ.argmax()) if differ.any() else m)
        self.nodes = self._nodes()
        self.bounds = (min(self.sizes), max(self.sizes))

    def _nodes(self) -> list[list[tuple[int, int, int]]]:
        """For each sequence, the inner nodes that it is the first one below: (depth, least and greatest size below)."""
        found, open_ = [], []
        for k in range(len(self.paths) - 1, -1, -1):
            low = high = self.sizes[k]
            own, depth = [], self.shared[k]
            while open_ and open_[-1][0] > depth:
                at, a, b = open_.pop()
                low, high = min(a, low), max(b, high)
                own.append((at, low, high))
            if depth:
                if open_ and open_[-1][0] == depth:
                    low, high = min(open_[-1][1], low), max(open_.pop()[2], high)
                open_.append((depth, low, high))
            found.append(own[::-1])
        return found[::-1]

    def search(self, probes: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(probe, sequence) numbers of all similar pairs."""
        size = np.array([len(p) for p in probes])
        flat = np.concatenate(probes)
        at = np.searchsorted(self.vocabulary, flat)
        at[at == len(self.vocabulary)] = 0
        known = np.flatnonzero(self.vocabulary[at] == flat)
        row, token = np.repeat(np.arange(len(probes)), size)[known], at[known]
        step = max(1, self.CELLS // len(self.vocabulary))
        out = []
        for x in range(0, len(probes), step):
            s = slice(*np.searchsorted(row, [x, x + step]))
            has = np.zeros((len(self.vocabulary), min(step, len(probes) - x)), np.uint8)
            has[token[s], row[s] - x] = 1
            for k, who in self._walk(has, size[x : x + step], percent):
                out.append(np.stack([who + x, np.full(len(who), self.order[k])]))
        return tuple(np.concatenate(out, axis=1)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _walk(self, has: np.ndarray, size: np.ndarray, percent: int):
        def in_reach(depth, overlap, n, low, high):
            best = np.clip(n - overlap + depth, low, high)
            return (100 + percent) * (overlap + np.minimum(best - depth, n - overlap)) >= percent * (n + best)

        everyone = np.arange(len(size))
        nothing = np.zeros(len(size), np.int64)
        everyone = everyone[in_reach(0, nothing, size, *self.bounds)]
        saved = [(0, everyone, nothing[everyone])]
        for k, path in enumerate(self.paths):
            while saved[-1][0] > self.shared[k]:
                saved.pop()
            depth, who, overlap = saved[-1]
            last = self.sizes[k]
            for stop, low, high in [*self.nodes[k], (last, last, last)]:
                while depth < stop and len(who):
                    to = min(stop, depth + self.STEP)
                    part = has[path[depth:to]]
                    overlap = overlap + (part.sum(axis=0, dtype=np.int64) if len(who) == part.shape[1] else part[:, who].sum(axis=0, dtype=np.int64))
                    depth = to
                    near = in_reach(depth, overlap, size[who], low, high)
                    if not near.all():
                        who, overlap = who[near], overlap[near]
                depth = stop
                if stop < last or high > last:
                    saved.append((stop, who, overlap))
            # at the end of a path, being in reach is being similar
            if len(who):
                yield k, who[overlap >= sj._need(size[who], last, percent)]


def tree_match(flat: np.ndarray, offsets: np.ndarray, groups: list[tuple[int, int, int]], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (asking, held) of the similar sets of each group (begin, first asking, end), by a tree of its held sets."""
    out = [np.zeros((2, 0), np.int64)]
    for begin, middle, end in groups:
        sets = [flat[a:b] for a, b in zip(offsets[begin:end], offsets[begin + 1 : end + 1], strict=True)]
        i, j = PrefixTree(sets[: middle - begin]).search(sets[middle - begin :], percent)
        out.append(np.stack([i + middle, j + begin]))
    return tuple(np.concatenate(out, axis=1))


def spanning_links(i: np.ndarray, j: np.ndarray, columns: dict) -> list[np.ndarray]:
    """(a, b): of the similar pairs, as many links as connect what they connect, between different labels only."""
    sid, a, b = columns["sid"], columns["label"][i], columns["label"][j]
    other = np.flatnonzero(a != b)
    _, first = np.unique(np.stack([a[other], b[other]]), axis=1, return_index=True)
    root: dict[int, int] = {}

    def find(x):
        while (y := root.get(x, x)) != x:
            root[x] = x = root.get(y, y)
        return x

    keep = []
    for at in other[first].tolist():
        x, y = find(int(a[at])), find(int(b[at]))
        if x != y:
            root[x] = y
            keep.append(at)
    return [sid[i[keep]], sid[j[keep]]]


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_copies) for every row of ``docs(doc_id, text)``.

    Two documents link when the Jaccard coefficient of their sets of ``k``-word shingles reaches ``percent`` / 100.
    Texts are lower-cased in A-Z; words are runs without ASCII white space; fewer than ``k`` words make one shingle.
    Null, empty and blank texts have an empty set, link with nothing and are their own component. Rows with equal
    sets (repeated rows too) are one set in the search; n_copies is its number of rows. Rows without an id link like
    all others, and get the smallest id of their component, or null if it has none. Extra columns are not read.
    """
    unit = sj.shingle_unit(k)
    docs = docs.select("doc_id", "text")
    profiled = sj.profile(docs, unit)
    order = sj.token_order(profiled)
    records = profiled.where("chunk is null").select("doc_id", "sid", "n", "tkey", "number")
    sets = stored(records.where("n > 0").groupBy("sid", "n").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_copies"), F.min("tkey").alias("tkey")), "distinct")

    shared = release(sj.mates(sj.prefix_entries(docs, unit, order, percent), percent, first=False))
    state = sj.clusters(shared, percent)
    wanted = state.select("sid").join(sets.hint("merge"), "sid").selectExpr("sid", "tkey", "0L number")
    tokens = release(sj.set_tokens(docs, wanted, unit, order))
    plain = state.selectExpr("sid", "n", "cnt", "cluster", "score", "sid label", "0L r1", "0L r2")

    def links(asking: DataFrame, held: DataFrame) -> DataFrame:
        return stored(sj.compare(asking, held, tokens, percent, tree_match, spanning_links, "a long, b long"), "links")

    # first every set with the hubs of its runs: a row for each set links most of a group of near copies
    first = stored(sj.hubs(shared, plain.selectExpr("sid", "-score r1", "sid r2"), percent, count=True), "hubs")
    columns = ["g", "sid", "n", "label", "r1", "r2"]
    asking = first.join(plain.hint("merge"), "sid").select(*columns)
    held = first.select(F.col("g").alias("sid")).distinct().join(plain.hint("merge"), "sid").withColumn("g", F.col("sid")).select(*columns)
    edges = release(links(asking, held))

    # then all that may still be linked, with the clusters that hold a possible partner; small components ask large ones
    parts = connected_components(edges.selectExpr("a x", "b y"))
    crowd = parts.groupBy("component").agg(F.count("*").alias("members"))
    label = stored(parts.join(crowd.hint("merge"), "component").selectExpr("node sid", "component label", "members"), "labels")
    linked = plain.drop("label", "r1", "r2").join(label.hint("merge"), "sid", "left")
    linked = stored(linked.selectExpr("sid", "n", "cnt", "cluster", "coalesce(label, sid) label", "coalesce(members, 1L) r1", "coalesce(label, sid) r2"), "linked")
    asks = stored(sj.waiting(shared, linked, percent, other=True), "waiting")
    held = linked.join(asks.selectExpr("g cluster").distinct().hint("merge"), "cluster").withColumn("g", F.col("cluster")).select(*columns)
    edges = edges.union(links(asks.join(linked.hint("merge"), "sid").select(*columns), held))

    found = connected_components(edges.selectExpr("a x", "b y"))
    sets = sets.join(found.selectExpr("node sid", "component").hint("merge"), "sid", "left").selectExpr("sid", "least", "n_copies", "coalesce(component, sid) component")
    smallest = sets.groupBy("component").agg(F.min("least").alias("component_id"))
    named = sets.join(smallest.hint("merge"), "component").select("sid", "n_copies", "component_id")
    out = records.where("n > 0").join(named.hint("merge"), "sid").selectExpr("doc_id", "n n_shingles", "component_id", "n_copies")
    return out.union(records.where("n = 0").selectExpr("doc_id", "n", "doc_id", "1L"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))

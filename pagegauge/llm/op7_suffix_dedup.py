"""Operator 7: removal of repeated byte strings by hash-compared suffix sorting.

A text's windows of ``length`` bytes are dealt out by *anchors*: of the k-byte strings in a window the one with the
least hash (k = length / 2), so equal windows have equal anchors at equal places. One shuffle groups the anchors.
Where all windows of an anchor together (its hull) occur twice, they are settled by that; other anchors that occur
again are settled by sorting the suffixes that run to the right and to the left of each occurrence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokensets as ts
from .setjoin import runs
from .shared import join_on_size, stored, table

LENGTH = 200
#: Occurrences of one anchor up to which a task sorts their suffixes; beyond, windows are counted by a shuffle.
SORT_ROWS = 50_000
_C = ts._MULT
_B = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base, and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) <= n:
        m = max(n + 1, ts.SLICE + 1)
        up, down = np.full(m, _B, np.uint64), np.full(m, pow(_B, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _powers[0], _powers[1]


def _prefix(raw: np.ndarray) -> np.ndarray:
    """Running sums over all 8-byte strings, each mixed before its power is applied: single bytes would leave sums in
    which patterns of two letters cancel out."""
    n = max(len(raw) - 7, 0)
    up, _ = powers(n)
    prefix = np.zeros(n + 1, np.uint64)
    if n:
        eight = np.ndarray((n,), np.uint64, buffer=np.ascontiguousarray(raw), strides=(1,))
        np.cumsum(ts.mix(eight ^ _C[58]) * up[:n], out=prefix[1:])
    return prefix


def _hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges of at least 8 bytes."""
    _, down = powers(len(prefix))
    return ts.mix((prefix[end - 7] - prefix[start]) * down[start])


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int):
    """(text, place in it, lowest d, highest d, core hash, hull hash) of every anchor; a window starts d before it."""
    k = length // 2
    w = length - k + 1
    windows = len(raw) - length + 1
    empty = np.zeros(0, np.int64)
    if windows <= 0:
        return empty, empty, empty, empty, empty, empty
    prefix = _prefix(raw)
    m = len(raw) - k + 1
    at = np.arange(m)
    bits = np.uint64(max(1, int(m).bit_length()))
    order = (_hash(prefix, at, at + k) >> bits << bits) | at.astype(np.uint64)
    pad = -m % w
    blocks = np.concatenate([order, np.full(pad + w, np.iinfo(np.uint64).max)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    p = np.arange(windows)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:windows]
    inside = p + length <= offsets[text + 1]
    p, text = p[inside], text[inside]
    if len(p) == 0:
        return empty, empty, empty, empty, empty, empty
    chosen = (np.minimum(behind[p], ahead[p + w - 1]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(p), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    a, low, high = chosen[first], p[first], p[last]
    core = _hash(prefix, a, a + k).view(np.int64)
    hull = ts.mix(_hash(prefix, low, high + length) + (a - low).astype(np.uint64) * _C[3] + (a - high).astype(np.uint64) * _C[4]).view(np.int64)
    return text[first], a - offsets[text[first]], a - high, a - low, core, hull


def _anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    """(core, hull, key, loc) of the anchors of all texts(key, text), once per task and key; loc packs place and range."""

    def work(batches):
        seen: set[int] = set()
        for batch in batches:
            raw, offs = ts.flat(batch.column("text"))
            keys = batch.column("key").to_numpy()
            for x, y in ts.slices(offs):
                text, place, low, high, core, hull = anchors(raw[offs[x] : offs[y]], offs[x : y + 1] - offs[x], length)
                fresh = np.zeros(y - x, bool)
                for i, v in enumerate(keys[x:y].tolist()):
                    if v not in seen:
                        seen.add(v)
                        fresh[i] = True
                keep = fresh[text]
                loc = (place << 20) | (high << 10) | low
                yield pa.RecordBatch.from_arrays([pa.array(v[keep]) for v in (core, hull, keys[x:y][text], loc)], names=["core", "hull", "key", "loc"])

    return texts.mapInArrow(work, "core long, hull long, key long, loc long")


def _settled(rows: DataFrame, length: int) -> DataFrame:
    """(kind, core, key, loc): kind 0, the hull occurs twice; kind 1, the anchor has other hulls, and this occurrence
    stands for its hull. Streams over sorted rows with a look at one row on either side."""

    def settle(c, before, final):
        """Rows of all but the last row (all, if final). before: the first row has the hull of the row before it, and
        its hull's first row follows another hull of its core. Returns the same for the last row, too."""
        core, hull, key, loc = c
        n = len(core)
        same_core, same = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        same_core[1:n] = core[1:] == core[:-1]
        same[1:n] = same_core[1:n] & (hull[1:] == hull[:-1])
        same[0] = before[0]
        begin = np.append(True, ~same[1:n])
        lead = same_core[:n].copy()
        lead[0] = before[1]
        lead = lead[np.flatnonzero(begin)][np.cumsum(begin) - 1]
        ends = ~same[1:]
        out = n if final else n - 1
        twice = (same[:-1] | same[1:])[:out]
        stands = (ends & (lead | same_core[1:]))[:out]
        i, j = np.flatnonzero(twice), np.flatnonzero(stands)
        at = np.concatenate([i, j])
        kind = np.repeat([0, 1], [len(i), len(j)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(kind), *(pa.array(v[at]) for v in (core, key, loc))], names=["kind", "core", "key", "loc"]), (bool(same[n - 1]), bool(lead[n - 1]))

    def work(batches):
        held, before = None, (False, False)
        for batch in batches:
            c = [batch.column(x).to_numpy() for x in ("core", "hull", "key", "loc")]
            if held is not None:
                c = [np.concatenate([h, v]) for h, v in zip(held, c, strict=True)]
            if len(c[0]) == 0:
                continue
            fresh = np.append(True, np.logical_or.reduce([v[1:] != v[:-1] for v in c]))
            c = [v[fresh] for v in c]
            out, before = settle(c, before, False)
            yield out
            held = [v[-1:] for v in c]
        if held is not None:
            yield settle(held, before, True)[0]

    dealt = rows.repartition("core").sortWithinPartitions("core", "hull", "key", "loc")
    return stored(dealt.mapInArrow(work, "kind int, core long, key long, loc long"), "settled")


class Suffixes:
    """Suffixes of equal-length byte rows, compared by prefix hashes: the common extension of two rows is found by
    binary search, so a comparison takes a logarithmic number of steps."""

    def __init__(self, rows: np.ndarray, sizes: np.ndarray, groups: np.ndarray):
        self.rows, self.sizes, self.groups = rows, sizes, groups
        n, m = rows.shape
        up, _ = powers(m)
        self.prefix = np.zeros((n, m + 1), np.uint64)
        np.cumsum(_BYTE[rows] * up[:m], axis=1, out=self.prefix[:, 1:])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(a), np.int64), np.minimum(self.sizes[a], self.sizes[b])
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.prefix[a, mid] == self.prefix[b, mid]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """a < b by group, content, size and number."""
        out = self.groups[a] < self.groups[b]
        near = np.flatnonzero(self.groups[a] == self.groups[b])
        if len(near):
            x, y = a[near], b[near]
            c = self.common(x, y)
            end = (c == self.sizes[x]) | (c == self.sizes[y])
            m = self.rows.shape[1] - 1
            at = np.minimum(c, m)
            out[near] = np.where(end, (self.sizes[x] < self.sizes[y]) | ((self.sizes[x] == self.sizes[y]) & (x < y)), self.rows[x, at] < self.rows[y, at])
        return out

    def sort(self) -> np.ndarray:
        """Bottom-up mergesort; all merges of a level at once, each row searching its place in the other half."""
        n = len(self.rows)
        order = np.arange(n)
        width = 1
        while width < n:
            at = np.arange(n)
            block = at // (2 * width) * (2 * width)
            middle, stop = np.minimum(block + width, n), np.minimum(block + 2 * width, n)
            left = at < middle
            low, high = np.where(left, middle, block), np.where(left, stop, middle)
            base = low.copy()
            while True:
                open_ = np.flatnonzero(low < high)
                if len(open_) == 0:
                    break
                mid = (low[open_] + high[open_]) >> 1
                before = self.less(order[mid], order[open_])
                low[open_] = np.where(before, mid + 1, low[open_])
                high[open_] = np.where(before, high[open_], mid)
            place = np.where(left, at, block + at - middle) + low - base
            merged = np.empty(n, np.int64)
            merged[place] = order
            order = merged
            width *= 2
        return order

    def common_with_last(self, order: np.ndarray) -> np.ndarray:
        """Common bytes of each row with the one before in order, from the bytes themselves; -1 across groups.

        This also verifies the order: rows that two equal hashes of different bytes have put wrongly are sorted anew.
        """
        a, b = order[:-1], order[1:]
        size = np.minimum(self.sizes[a], self.sizes[b])
        out = np.full(len(order), -1, np.int64)
        for x in range(0, len(a), 4096):
            s = slice(x, x + 4096)
            differ = self.rows[a[s]] != self.rows[b[s]]
            out[1:][s] = np.where(differ.any(axis=1), differ.argmax(axis=1), differ.shape[1])
        out[1:] = np.minimum(out[1:], size)
        same = self.groups[a] == self.groups[b]
        at = np.minimum(out[1:], self.rows.shape[1] - 1)
        wrong = same & (out[1:] < size) & (self.rows[a, at] > self.rows[b, at])
        if wrong.any():
            right = sorted(range(len(order)), key=lambda i: (self.groups[i], self.rows[i, : self.sizes[i]].tobytes(), i))
            order[:] = right
            return self.common_with_last(order)
        out[1:][~same] = -1
        return out


def repeated_windows(left: np.ndarray, left_sizes, right: np.ndarray, right_sizes, groups, low, high, length: int) -> np.ndarray:
    """Flag for each occurrence and each d: the window that starts d bytes before the anchor occurs again in its group.

    ``left`` holds the bytes before the anchor from right to left, ``right`` those from it on.
    """
    a, b = Suffixes(left, left_sizes, groups), Suffixes(right, right_sizes, groups)
    by_left, by_right = a.sort(), b.sort()
    common_left, common_right = a.common_with_last(by_left), b.common_with_last(by_right)
    n = len(groups)
    flags = np.zeros((n, int(high.max()) + 1 if n else 0), bool)
    left_class, right_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(flags.shape[1]):
        on = np.flatnonzero((low <= d) & (d <= high))
        if len(on) < 2:
            continue
        left_class[by_left] = np.cumsum(common_left < d)
        right_class[by_right] = np.cumsum(common_right < length - d)
        key = left_class[on] * (n + 1) + right_class[on]
        order = np.argsort(key, kind="stable")
        k = key[order]
        same = np.zeros(len(k) + 1, bool)
        same[1:-1] = k[1:] == k[:-1]
        flags[on[order], d] = same[1:] | same[:-1]
    return flags


def _contexts(texts: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """(core, key, place, low, high, left, right) of the occurrences asked for; left is in reading order."""

    def work(batches):
        for batch in batches:
            raw, offs = ts.flat(batch.column("text"))
            lists = batch.column("asked")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            core, loc = flat.field("core").to_numpy(), flat.field("loc").to_numpy()
            row = np.repeat(np.arange(batch.num_rows), sizes)
            key = batch.column("key").to_numpy()[row]
            for x in range(0, len(core), 20_000):
                s = slice(x, x + 20_000)
                place, high, low = loc[s] >> 20, (loc[s] >> 10) & 1023, loc[s] & 1023
                at = offs[row[s]] + place
                view = memoryview(raw)
                before = [bytes(view[p - h : p]) for p, h in zip(at.tolist(), high.tolist(), strict=True)]
                after = [bytes(view[p : p + length - d]) for p, d in zip(at.tolist(), low.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(core[s]), pa.array(key[s]), pa.array(place), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), pa.array(before, pa.binary()), pa.array(after, pa.binary())],
                    names=["core", "key", "place", "low", "high", "left", "right"],
                )

    per = asked.groupBy("key", "rep").agg(F.collect_list(F.struct("core", "loc")).alias("asked")).withColumnRenamed("key", "k")
    kind = "core long, key long, place long, low int, high int, left binary, right binary"
    rows = texts.join(per.hint("merge"), (texts["key"] == per["k"]) & texts["doc_id"].eqNullSafe(per["rep"]))
    return rows.select("key", "text", "asked").mapInArrow(work, kind)


def _matrix(column: pa.Array, width: int, reverse: bool) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    _, o, data = column.buffers()
    offs = np.frombuffer(o, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    sizes = np.diff(offs)
    out = np.zeros((len(column), max(width, 1)), np.uint8)
    row = np.repeat(np.arange(len(column)), sizes)
    col = np.arange(len(row)) - np.repeat(offs[:-1] - offs[0], sizes)
    if reverse:
        col = np.repeat(sizes, sizes) - 1 - col
    out[row, col] = raw[offs[0] : offs[-1]]
    return out, sizes


def _sorted_out(contexts: DataFrame, length: int) -> DataFrame:
    """(key, begin, end): spans of repeated windows among the occurrences of each anchor."""

    def work(batches):
        for t in runs(batches, ["core"]):
            core, key, place, low, high = (t.column(c).to_numpy() for c in ("core", "key", "place", "low", "high"))
            fresh = np.ones(len(core), bool)
            fresh[1:] = (core[1:] != core[:-1]) | (key[1:] != key[:-1]) | (place[1:] != place[:-1])
            t = t.filter(pa.array(fresh))
            core, key, place, low, high = (x[fresh] for x in (core, key, place, low, high))
            cuts = np.flatnonzero(np.concatenate([[True], core[1:] != core[:-1]]))
            stops = np.append(cuts[1:], len(core))
            x = 0
            while x < len(cuts):  # whole groups, about 10,000 occurrences at once
                y = max(x + 1, int(np.searchsorted(stops, cuts[x] + 10_000, "right")))
                s = slice(int(cuts[x]), int(stops[y - 1]))
                part = t.slice(s.start, s.stop - s.start)
                left, ls = _matrix(part.column("left"), int(high[s].max()), True)
                right, rs = _matrix(part.column("right"), length, False)
                groups = np.searchsorted(cuts, np.arange(s.start, s.stop), "right")
                flags = repeated_windows(left, ls, right, rs, groups, low[s], high[s], length)
                edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
                i, first = np.nonzero(edge == 1)
                _, stop = np.nonzero(edge == -1)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (key[s][i], place[s][i] - (stop - 1), place[s][i] - first + length)], names=["key", "begin", "end"])
                x = y

    dealt = contexts.repartition("core").sortWithinPartitions("core", "key", "place")
    return dealt.mapInArrow(work, "key long, begin long, end long")


def _counted(contexts: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many occurrences: every window by its MD5 digest, counted by a shuffle."""
    both = F.concat("left", "right")
    d = F.explode(F.sequence(F.col("low"), F.col("high"))).alias("d")
    rows = contexts.dropDuplicates(["core", "key", "place"]).select("core", "key", "place", "high", both.alias("b"), d)
    rows = rows.select("core", "key", (F.col("place") - F.col("d")).alias("begin"), F.md5(F.substring("b", F.col("high") - F.col("d") + 1, F.lit(length))).alias("w"))
    twice = rows.groupBy("core", "w").agg(F.count("*").alias("n")).where("n > 1").select("core", "w")
    return rows.join(twice.hint("merge"), ["core", "w"]).selectExpr("key", "begin", f"begin + {length} end")


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(texts(doc_id, key, text), spans(key, begin, end)): byte spans covered by a string of ``length`` bytes that
    also starts anywhere else. ``key`` stands for a text's content. ``length`` is 16 to 1,023."""
    if not 16 <= length <= 1023:
        raise ValueError("length must be 16 to 1,023 bytes: halves are hashed by 8 bytes, and places are packed by 10 bits")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("key", F.xxhash64("text"))
    # one row per text that can have a window; copies are repeated as a whole
    size = F.octet_length("text").cast("long")
    per = stored(texts.where(size >= length).groupBy("key", F.md5("text").alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("rep"), F.max(size).alias("size")), "texts")
    settled = _settled(_anchor_rows(texts.select("key", "text"), length), length)
    whole = per.where("n > 1").selectExpr("key", "0L begin", "size end")
    near = settled.where("kind = 0").selectExpr("key", "(loc >> 20) - ((loc >> 10) & 1023) begin", f"(loc >> 20) - (loc & 1023) + {length} end")
    asked = settled.where("kind = 1").join(per.select("key", "rep").hint("merge"), "key").select("key", "rep", "core", "loc")
    large = stored(asked.groupBy("core").agg(F.count("*").alias("n")).where(F.col("n") > SORT_ROWS).select("core"), "large")
    spans = whole.unionByName(near).unionByName(_sorted_out(_contexts(texts, join_on_size(asked, large, "core", "left_anti"), length), length))
    if not large.isEmpty():
        spans = spans.unionByName(_counted(_contexts(texts, join_on_size(asked, large, "core", "left_semi"), length), length))
    return texts, spans


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row of ``docs(doc_id, text)``; kept is binary.

    Every byte is removed that a string of ``length`` bytes covers which also starts anywhere else, same text
    included; strings are judged on the input and don't cross texts. Null and empty texts have no bytes; texts below
    ``length`` bytes keep all. Repeated rows of at least ``length`` bytes lose everything.
    """
    texts, spans = repeated_spans(docs, length)
    per = stored(spans.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("begin", "end"))).alias("spans")), "spans")

    def work(batches):
        for batch in batches:
            raw, offs = ts.flat(batch.column("text"))
            size, removed, count, kept = [], [], [], []
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                own = raw[offs[i] : offs[i + 1]]
                size.append(len(own))
                pieces, at, gone, n = [], 0, 0, 0
                for s in spans or []:
                    if s["begin"] > at or n == 0:
                        pieces.append(own[at : s["begin"]])
                        begin, n = s["begin"], n + 1
                    else:
                        begin = at
                    if s["end"] > at:
                        gone += s["end"] - begin
                        at = s["end"]
                pieces.append(own[at:])
                removed.append(gone)
                count.append(n)
                kept.append(b"".join(p.tobytes() for p in pieces))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    joined = texts.join(per.hint("merge"), "key", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


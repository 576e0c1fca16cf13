"""Exact set-similarity join on Spark: global token order, prefix runs, and comparison in blocks.

A *record* (a document or a line) has a set of 64-bit tokens, and a set is known by a 64-bit id (``sid``). Two sets are
similar when ``100 * |A & B| >= percent * |A | B|``. The steps:

1. ``profile`` reads the texts once for set ids and a count sketch of all tokens; ``token_order`` makes the order of it.
2. ``prefix_entries`` and ``mates``: sets meet in runs of one prefix token; entries without a possible mate go. They
   are shuffled as packed arrays.
3. ``hubs``: in each run every set meets one hub only. That settles most of a group of near copies by a row a set.
4. ``clusters`` and ``waiting``: what is not settled is sent, one row for each cluster, to the clusters that hold a
   possible partner. No pairs are written out: ``compare`` gathers each cluster's sets once and finds the partners.

Runs of a token that very many sets have are dealt out by salts; clusters are cut into blocks of bounded weight.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokensets as ts
from .shared import join_on_size, stored

#: Buckets of the count sketch, as a power of two; one byte each when broadcast.
SKETCH_BITS = 22
_CHUNK = 1 << 16
#: Runs of a token are dealt out to parts of about 2**HOT records; a token counts as hot only if it is also well
#: above the mean of all buckets, else its count may be that of the tokens that share its bucket.
HOT = 15
ABOVE_MEAN = 4
#: Tokens of one block of a cluster, about (a larger set is a block of its own).
BLOCK_TOKENS = 1_000_000
#: Prefix entries that a task packs at once, and that are sorted at once, about.
PACKED = 1 << 19
#: Sets of more tokens than this have a bitmap of 128 bits, others one of 64: that of a long set is full of chance bits.
WIDE = 48

#: unit(raw, offsets) -> (row of each record, number in its row, distinct tokens, offsets)
Unit = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def shingle_unit(k: int) -> Unit:
    def unit(raw, offsets):
        h, record, row, number = ts.words(raw, offsets)
        return row, number, *ts.distinct(*ts.shingles(h, record, k), len(row))

    return unit


def line_unit() -> Unit:
    def unit(raw, offsets):
        h, record, row, number = ts.words(raw, offsets, newline=True)
        return row, number, *ts.distinct(h, record, len(row))

    return unit


def _read(batches: Iterator[pa.RecordBatch], unit: Unit):
    """(batch, first row, row, number, tokens, offsets, set ids) of each slice of text."""
    for batch in batches:
        raw, offs = ts.flat(batch.column("text"))
        for a, b in ts.slices(offs):
            row, number, tokens, offsets = unit(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            yield batch, a, row, number, tokens, offsets, ts.set_ids(tokens, offsets)


def _batch(kinds: dict[str, pa.DataType], **columns) -> pa.RecordBatch:
    rows = max(len(x) for x in columns.values() if x is not None)
    return pa.RecordBatch.from_arrays([pa.nulls(rows, kinds[k]) if x is None else x if isinstance(x, pa.Array) else pa.array(x) for k, x in columns.items()], names=list(columns))


def profile(docs: DataFrame, unit: Unit) -> DataFrame:
    """Records (doc_id, number, sid, n, tkey), and rows (chunk, counts) of the count sketch. ``tkey`` is a hash of the
    whole text: by it texts are found again, so rows without an id or with a repeated one are like all others."""
    kinds = {"chunk": pa.int64(), "counts": pa.binary(), "doc_id": pa.int64(), "number": pa.int64(), "sid": pa.int64(), "n": pa.int64(), "tkey": pa.int64()}

    def work(batches):
        counts, held, size = np.zeros(1 << SKETCH_BITS, np.uint32), [], 0
        any_row = False

        def count():
            if held:
                counts[:] += np.bincount(np.concatenate(held), minlength=len(counts)).astype(np.uint32)

        for batch, a, row, number, tokens, offsets, sid in _read(batches, unit):
            any_row = True
            held.append((tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int32))
            size += len(tokens)
            if size > 1 << 22:
                count()
                held, size = [], 0
            at = pa.array(a + row)
            yield _batch(kinds, doc_id=batch.column("doc_id").take(at), number=number, sid=sid, n=np.diff(offsets), tkey=batch.column("tkey").take(at), chunk=None, counts=None)
        count()
        if any_row:
            m = len(counts) // _CHUNK
            small = np.minimum(counts, 65535).astype(np.uint16).reshape(m, -1)
            yield _batch(kinds, doc_id=None, number=None, sid=None, n=None, tkey=None, chunk=pa.array(range(m), pa.int64()), counts=pa.array([x.tobytes() for x in small], pa.binary()))

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tkey"))
    return stored(keyed.mapInArrow(work, "doc_id long, number long, sid long, n long, tkey long, chunk long, counts binary"), "profile")


def token_order(profiled: DataFrame):
    """The sketch as logarithms of its counts, in steps of an eighth of a doubling: 2**SKETCH_BITS bytes whatever the
    input. Fine steps also tell a token of a few dozen records from the many single ones that share its bucket. Any
    fixed order gives right results; counts only keep frequent tokens out of the prefixes. Broadcast with the size that
    makes a token hot and the number of all tokens."""

    def sums(batches, kind) -> dict[int, np.ndarray]:
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, x in zip(batch.column("chunk").to_pylist(), batch.column("counts"), strict=True):
                total = out.setdefault(c, np.zeros(_CHUNK, np.uint64))
                total += np.frombuffer(x.as_py(), kind)
        return out

    def partial(batches):
        for c, x in sums(batches, np.uint16).items():
            yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([x.tobytes()], pa.binary())], names=["chunk", "counts"])

    def whole(batches):
        for c, x in sums(batches, np.uint64).items():
            levels = np.minimum(np.round(8 * np.log2(x + 1.0)), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([levels.tobytes()], pa.binary()), pa.array([float(x.sum())])], names=["chunk", "levels", "total"])

    # each task of the read adds up what it has; then a chunk's partial sums meet in the task of the chunk
    parts = profiled.where("chunk is not null").select("chunk", "counts").mapInArrow(partial, "chunk long, counts binary")
    rows = parts.repartition("chunk").mapInArrow(whole, "chunk long, levels binary, total double").collect()
    levels = np.zeros(1 << SKETCH_BITS, np.uint8)
    for r in rows:
        levels[r.chunk * _CHUNK : (r.chunk + 1) * _CHUNK] = np.frombuffer(r.levels, np.uint8)
    mean = sum(r.total for r in rows) / len(levels)
    hot = max(HOT, int(np.ceil(np.log2(ABOVE_MEAN * mean + 1))))
    return profiled.sparkSession.sparkContext.broadcast((levels, hot, int(mean * len(levels))))


def in_order(tokens: np.ndarray, offsets: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each record in the global order, rare ones first and then by hash, and their levels."""
    level = levels[tokens >> np.uint64(64 - SKETCH_BITS)]
    key = (np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)) << 8) | level
    order = np.argsort(key, kind="stable")
    return tokens[order], level[order]


def _planes(x: np.ndarray) -> bytes:
    """All first bytes of the values, then all second ones, ...: equal high bytes compress well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _values(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.tobytes(), kind)


_PACK = ["part", "run", "sid", "bits", "wide", "n", "pos", "is_hot", "hot"]


def _pack(held: list[list[np.ndarray]], parts: int) -> pa.RecordBatch:
    """Entries (run, sid, bits, wide, n, pos, is_hot, token) in a row for each of ``parts`` ranges of runs, as sorted arrays."""
    run, *rest = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(run)
    run, (sid, bits, wide, n, pos, is_hot, token) = run[order], (x[order] for x in rest)
    part = ((run >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    begin = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)])
    end = np.append(begin[1:], len(run))[: len(begin)]
    step = np.append(run[:1], np.diff(run))
    step[begin] = run[begin]
    some = bool(bits.any())
    rows = []
    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
        at = slice(a, b)
        long, hot = n[at] > WIDE, is_hot[at]
        data = [x.tobytes() for x in ((bits[at], wide[at][long]) if some else (bits[:0], wide[:0]))]
        rows.append((_planes(step[at]), sid[at].tobytes(), *data, _planes(n[at]), _planes(pos[at]), np.packbits(hot).tobytes() if hot.any() else b"", token[at][hot].tobytes()))
    columns = zip(*rows, strict=True) if rows else [[]] * (len(_PACK) - 1)
    return pa.RecordBatch.from_arrays([pa.array(part[begin].astype(np.int32)), *(pa.array(x, pa.binary()) for x in columns)], names=_PACK)


def _unpack(t: pa.Table) -> list[np.ndarray]:
    """The entries of all rows of ``_pack``, by run."""
    out = []
    for run, sid, bits, wide, n, pos, is_hot, hot in zip(*(t.column(k).to_pylist() for k in _PACK[1:]), strict=True):
        run, n = np.cumsum(_values(run, np.uint64), dtype=np.uint64), _values(n, np.int32)
        m = len(run)
        both = np.zeros((2, m), np.int64)
        if bits:
            both[0] = np.frombuffer(bits, np.int64)
            both[1, n > WIDE] = np.frombuffer(wide, np.int64)
        mask, token = np.zeros(m, bool), np.zeros(m, np.int64)
        if is_hot:
            mask = np.unpackbits(np.frombuffer(is_hot, np.uint8), count=m).astype(bool)
            token[mask] = np.frombuffer(hot, np.int64)
        out.append((run, np.frombuffer(sid, np.int64), *both, n.astype(np.int64), _values(pos, np.int32).astype(np.int64), mask, token))
    run, *rest = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(run, kind="stable")
    return [x[order] for x in (run.view(np.int64), *rest)]


def prefix_entries(docs: DataFrame, unit: Unit, order, percent: int, bitmaps: bool = False) -> DataFrame:
    """The prefix of every set, a set once per task, as packed entries (run, sid, n, pos, bits, wide, hot): a row for
    each task and range of runs, in the partition of the range. ``run`` is the token's hash, or a hash of it and of a
    part for a hot token, which ``hot`` then holds. Two tokens in one run make more candidates only.

    With ``bitmaps``, bits is the parity of the set's tokens over 64 buckets, and wide that of half of them, which
    makes 128 buckets, for sets of more than WIDE tokens: two sets differ in at least as many tokens as their bitmaps do
    in bits. That rules out most pairs that have little more than one token in common; else bits is 0.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tokens_in_all = order.value[2]
    parts = partitions * max(1, -(-tokens_in_all * (110 - percent) // (100 * PACKED * partitions)))

    def work(batches):
        (levels, hot, _), seen, held, size_held = order.value, set(), [], 0
        for _, _, _, _, tokens, offsets, sid in _read(batches, unit):
            tokens, level = in_order(tokens, offsets, levels)
            n = np.diff(offsets)
            fresh = np.zeros(len(n), bool)
            for i, s in enumerate(sid.tolist()):
                if n[i] and s not in seen:
                    seen.add(s)
                    fresh[i] = True
            size = np.where(fresh, n - -(-percent * n // 100) + 1, 0)
            rec = np.repeat(np.arange(len(n)), size)
            pos = np.arange(len(rec)) - np.repeat(np.cumsum(size) - size, size)
            at = offsets[rec] + pos
            salts = 1 << np.maximum(level[at].astype(np.int64) // 8 - hot, 0)
            token, salt = tokens[at], (sid[rec] % salts).astype(np.uint64)
            run = np.where(salts > 1, ts.mix(token ^ ts.mix(salt + np.uint64(1))), token)
            bits, wide = np.zeros((2, len(n)), np.int64)
            if bitmaps and len(tokens):
                some = np.flatnonzero(n)
                bit = np.uint64(1) << (tokens & np.uint64(63))
                bits[some] = np.bitwise_xor.reduceat(bit, offsets[some]).view(np.int64)
                wide[some] = np.bitwise_xor.reduceat(np.where(tokens & np.uint64(64), bit, np.uint64(0)), offsets[some]).view(np.int64)
            held.append([run, sid[rec], bits[rec], wide[rec], n[rec].astype(np.int32), pos.astype(np.int32), salts > 1, token.view(np.int64)])
            size_held += len(rec)
            if size_held >= PACKED:
                yield _pack(held, parts)
                held, size_held = [], 0
        if held:
            yield _pack(held, parts)

    kinds = ", ".join(f"{c} binary" for c in _PACK[1:])
    return docs.select("text").mapInArrow(work, f"part int, {kinds}").repartitionById(partitions, "part")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole runs of equal keys of a sorted stream, many at a time."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        last = [batch.column(k)[-1] for k in keys]
        diff = np.zeros(batch.num_rows, bool)
        for k, x in zip(keys, last, strict=True):
            diff |= batch.column(k).to_numpy(zero_copy_only=False) != x.as_py()
        cut = int(np.flatnonzero(diff)[-1]) + 1 if diff.any() else 0
        if rest and (cut or any(rest[-1].column(k)[-1] != batch.column(k)[0] for k in keys)):
            whole = [*rest, batch.slice(0, cut)] if cut else rest
            yield pa.Table.from_batches(whole)
            rest = [batch.slice(cut)]
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
            rest = [batch.slice(cut)]
        else:
            rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest)


def _columns(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [t.column(k).to_numpy() for k in names]


def _run_of(*keys: np.ndarray) -> np.ndarray:
    """Number of the run of equal keys that each row of a sorted table is in."""
    if len(keys[0]) == 0:
        return np.zeros(0, np.int64)
    return np.cumsum(np.append(False, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])))


def _need(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of similar sets of sizes n and m."""
    return -(-percent * (n + m) // (100 + percent))


def _possible(i, j, n, pos, bits, percent: int) -> np.ndarray:
    """Whether two sets can be similar by their sizes and bitmaps (bits, wide) and, if ``pos`` is given, with this token
    as the first that they have in common: what is left of either set from it on must reach the least overlap."""
    need = _need(n[i], n[j], percent)
    left = np.minimum(n[i], n[j]) if pos is None else np.minimum(n[i] - pos[i], n[j] - pos[j])
    bits, wide = (x[i] ^ x[j] for x in bits)
    wide = np.where((n[i] > WIDE) & (n[j] > WIDE), wide, 0)
    differ = np.bitwise_count(wide.view(np.uint64)) + np.bitwise_count((bits ^ wide).view(np.uint64))
    return (left >= need) & (n[i] + n[j] - 2 * need >= differ)


def _steps(run: np.ndarray, n: np.ndarray, percent: int):
    """Index pairs (i, i + step) within runs sorted by size, for step 1, 2, ..., of sizes that can match; the caller may
    send back a mask of the pairs whose first index is still of interest."""
    i, step = np.arange(len(run) - 1), 1
    while len(i):
        i = i[i + step < len(run)]
        i = i[(run[i] == run[i + step]) & (percent * n[i + step] <= 100 * n[i])]
        if len(i):
            keep = yield i, i + step
            if keep is not None:
                i = i[keep]
        step += 1


def mates(entries: DataFrame, percent: int, first: bool) -> DataFrame:
    """Entries (run, hot, sid, n, pos, bits, wide, size) whose token has a second set that they may be similar to, each
    set once; size is the number of sets in the run. With ``first`` the token must be able to be the first common one.
    Of a hot token all entries stay, as their mates may be in another part."""

    def work(batches):
        for t in runs(batches, ["part"]):
            key, *rest = _unpack(t)
            end = np.append(key[1:] != key[:-1], True)
            several = ~(end & np.append(True, end[:-1])) | rest[-2]  # without runs of one
            key, (sid, bits, wide, n, pos, hot, token) = key[several], (x[several] for x in rest)
            run = _run_of(key)
            order = np.lexsort((sid, run << 32 | n))
            order = order[np.append(True, (run[order][1:] != run[order][:-1]) | (sid[order][1:] != sid[order][:-1]))[: len(order)]]
            if len(order) == 0:
                continue
            key, sid, bits, wide, n, pos, hot, token, run = (x[order] for x in (key, sid, bits, wide, n, pos, hot, token, run))
            mate = hot.copy()
            walk = _steps(run, n, percent)
            pair = next(walk, None)
            while pair is not None:
                i, j = pair
                open_ = ~(mate[i] & mate[j])
                x, y = i[open_], j[open_]
                ok = _possible(x, y, n, pos if first else None, (bits, wide), percent)
                mate[x[ok]] = mate[y[ok]] = True
                # a set that has a mate is only needed for later ones that have none
                waiting = np.bincount(run[~mate], minlength=int(run[-1]) + 1) > 0
                try:
                    pair = walk.send(waiting[run[i]])
                except StopIteration:
                    pair = None
            at = np.flatnonzero(mate)
            size = np.bincount(run[at], minlength=int(run[-1]) + 1)[run[at]].astype(np.int32)
            columns = [key[at], pa.array(token[at], mask=~hot[at]), sid[at], n[at].astype(np.int32), pos[at].astype(np.int32), bits[at], wide[at], size]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=["run", "hot", "sid", "n", "pos", "bits", "wide", "size"])

    # few rows, of many entries each; sets are put in order within their runs only
    kinds = "run long, hot long, sid long, n int, pos int, bits long, wide long, size int"
    return stored(entries.sortWithinPartitions("part").mapInArrow(work, kinds), "mates")


def clusters(shared: DataFrame, percent: int) -> DataFrame:
    """(sid, n, cnt, score, cluster) of every set with a possible mate: the number of its prefix tokens with mates, the
    same per mille, and its largest run. A text that others are copies of has no rare tokens of its own, so
    it scores highest and makes the best hub; texts of one origin have the same largest run."""
    prefix = F.expr(f"n - ({percent} * n + 99) div 100 + 1")
    per = shared.groupBy("sid", "n").agg(F.count("*").alias("cnt"), F.max(F.struct("size", "run")).alias("most"))
    return stored(per.select("sid", "n", "cnt", (1000 * F.col("cnt") / prefix).cast("long").alias("score"), F.col("most.run").alias("cluster")), "clusters")


def _enough(c: str, percent: int) -> Column:
    """Whether sets of sizes an and bn with c common prefix tokens can be similar: besides these, they share at most
    what lies behind the prefix of the set whose prefix ends first."""
    behind = F.expr(f"({percent} * greatest(an, bn) + 99) div 100 - 1")
    return F.col(c) + behind >= F.expr(f"({percent} * (an + bn) + {99 + percent}) div {100 + percent}")


def hubs(shared: DataFrame, rank: DataFrame, percent: int, count: bool) -> DataFrame:
    """(sid, g): each set with the hub g of each of its runs, the first by (r1, r2) of ``rank`` (sid, r1, r2); sets that
    the hub can't match have hubs of their own. With ``count`` (all common prefix tokens are in ``shared``) only pairs
    with enough of them are kept."""

    def work(batches):
        for t in runs(batches, ["run"]):
            key, sid, n, bits, wide, r1, r2 = _columns(t, "run", "sid", "n", "bits", "wide", "r1", "r2")
            n, run = n.astype(np.int64), _run_of(key)
            left = np.lexsort((sid, r2, r1, run))
            for _ in range(4):
                if len(left) == 0:
                    break
                first = np.append(True, run[left][1:] != run[left][:-1])
                hub = left[np.flatnonzero(first)[np.cumsum(first) - 1]]
                near = _possible(hub, left, n, None, (bits, wide), percent)
                at = np.flatnonzero(near & ~first)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (sid[left[at]], n[left[at]], sid[hub[at]], n[hub[at]])], names=["sid", "an", "g", "bn"])
                left = left[~near & ~first]

    rows = shared.select("run", "sid", "n", "bits", "wide").join(rank.select("sid", "r1", "r2").hint("merge"), "sid")
    dealt = rows.select("run", "sid", "n", "bits", "wide", "r1", "r2").repartition("run").sortWithinPartitions("run")
    found = dealt.mapInArrow(work, "sid long, an long, g long, bn long").groupBy("sid", "an", "g", "bn").agg(F.count("*").alias("c"))
    return (found.where(_enough("c", percent)) if count else found).select("sid", "g")


def waiting(shared: DataFrame, state: DataFrame, percent: int, other: bool) -> DataFrame:
    """(sid, g): the clusters g that may hold a partner of a set that is not settled yet.

    ``state`` has (sid, cluster, cnt, label, r1, r2). With ``other``, a pair matters if its labels differ, and its set
    of the smaller (r1, r2) asks; a pair can't have more common tokens than either set has shared ones. Else a pair
    matters if the set of the greater (r1, r2) has the label 0, and that set asks. Pairs within a run are looked at in
    the task of the run; for hot tokens, sets of one part meet the clusters of the others.
    """

    def work(batches):
        for t in runs(batches, ["run"]):
            key, sid, n, pos, bits, wide, cluster, cnt, label, r1, r2 = cols = _columns(t, "run", "sid", "n", "pos", "bits", "wide", "cluster", "cnt", "label", "r1", "r2")
            begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            low, high = np.minimum.reduceat(label, begin), np.maximum.reduceat(label, begin)
            size = np.diff(np.append(begin, len(key)))
            of_use = np.repeat((low < high) if other else (low == 0) & (size > 1), size)
            cols = [x[of_use] for x in cols]
            order = np.lexsort((cols[1], cols[2], _run_of(cols[0])))
            key, sid, n, pos, bits, wide, cluster, cnt, label, r1, r2 = (x[order] for x in cols)
            n, pos, run = n.astype(np.int64), pos.astype(np.int64), _run_of(key)
            found = [np.zeros((2, 0), np.int64)]
            for i, j in _steps(run, n, percent):
                ok = _possible(i, j, n, pos, (bits, wide), percent)
                before = (r1[i] < r1[j]) | ((r1[i] == r1[j]) & (r2[i] < r2[j]))
                if other:
                    behind = -(-percent * np.maximum(n[i], n[j]) // 100) - 1
                    ok &= (label[i] != label[j]) & (np.minimum(cnt[i], cnt[j]) + behind >= _need(n[i], n[j], percent))
                    asks, held = np.where(before, i, j)[ok], np.where(before, j, i)[ok]
                else:
                    asks, held = np.where(before, j, i), np.where(before, i, j)
                    ok &= label[asks] == 0
                    asks, held = asks[ok], held[ok]
                if len(asks):
                    found.append(np.stack([sid[asks], cluster[held]]))
            out = np.unique(np.concatenate(found, axis=1), axis=1)
            if out.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1])], names=["sid", "g"])

    rows = shared.drop("size").join(state.select("sid", "cluster", "cnt", "label", "r1", "r2").hint("merge"), "sid")
    dealt = rows.drop("hot").repartition("run").sortWithinPartitions("run")
    near = dealt.mapInArrow(work, "sid long, g long")
    # of a hot token: one row for each cluster and part, which says whether the cluster can matter to a set
    hot = rows.where("hot is not null")
    parts = hot.groupBy("hot", F.col("run").alias("part"), F.col("cluster").alias("g")).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("label").alias("first"), F.max("label").alias("last"), F.max(F.struct("r1", "r2")).alias("top"), F.min(F.struct("r1", "r2")).alias("least"))
    fits = (F.col("run") != F.col("part")) & (100 * F.col("high") >= percent * F.col("n")) & (percent * F.col("low") <= 100 * F.col("n"))
    own = F.struct("r1", "r2")
    fits &= ((F.col("first") != F.col("label")) | (F.col("last") != F.col("label"))) & (F.col("top") > own) if other else (F.col("label") == 0) & (F.col("least") < own)
    far = hot.join(parts.hint("merge"), "hot").where(fits).select("sid", "g")
    return near.union(far).groupBy("sid", "g").agg(F.count("*").alias("c")).select("sid", "g")


def set_tokens(docs: DataFrame, wanted: DataFrame, unit: Unit, order) -> DataFrame:
    """(sid, tokens) of the wanted sets (sid, tkey, number), read again from their texts; tokens in global order."""

    def work(batches):
        levels = order.value[0]
        seen: set[int] = set()
        for batch, a, row, number, tokens, offsets, sid in _read(batches, unit):
            need = batch.column("numbers").slice(a, int(row.max()) + 1)
            key = (np.repeat(np.arange(len(need)), need.value_lengths().to_numpy(zero_copy_only=False)) << 32) | need.flatten().to_numpy(zero_copy_only=False)
            at = [r for r in np.flatnonzero(np.isin((row.astype(np.int64) << 32) | number, key)).tolist() if sid[r] not in seen and not seen.add(sid[r])]
            tokens, _ = in_order(tokens, offsets, levels)
            data = pa.array([tokens[offsets[r] : offsets[r + 1]].tobytes() for r in at], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(sid[at]), data], names=["sid", "tokens"])

    need = stored(wanted.groupBy("tkey").agg(F.collect_set("number").alias("numbers")), "need")
    texts = docs.select(F.xxhash64("text").alias("tkey"), "text")
    # a text that occurs in several rows is read once a task
    sets = texts.join(need.hint("merge"), "tkey").select("text", "numbers").mapInArrow(work, "sid long, tokens binary")
    return stored(sets.groupBy("sid").agg(F.first("tokens").alias("tokens")), "tokens")


#: matcher(tokens of all sets, offsets, groups (begin, first asking, end), percent) -> rows (asking, held) of similar sets
Matcher = Callable[[np.ndarray, np.ndarray, list[tuple[int, int, int]], int], tuple[np.ndarray, np.ndarray]]
#: answer(asking rows, held rows, columns) -> columns of the result
Answer = Callable[[np.ndarray, np.ndarray, dict], list[np.ndarray]]


def compare(asking: DataFrame, held: DataFrame, tokens: DataFrame, percent: int, matcher: Matcher, answer: Answer, kind: str) -> DataFrame:
    """Similar sets of each group: ``asking`` and ``held`` have (g, sid, n, label, r1, r2), ``tokens`` (sid, tokens).

    The sets of a group that are held, and those that ask, are cut into blocks of about BLOCK_TOKENS; every pair of
    blocks meets once. ``matcher`` finds the similar sets of some groups, and ``answer`` makes the rows of ``kind`` of
    them, which must be few: no pairs are written.
    """
    columns = ["sid", "n", "label", "r1", "r2"]
    names = [c.split(" ")[0] for c in kind.split(", ")]

    def work(batches):
        for t in runs(batches, ["g", "part", "other"]):
            t = t.combine_chunks()
            run, role = _run_of(*_columns(t, "g", "part", "other")), t.column("role").to_numpy()
            data = pa.concat_arrays(t.column("tokens").chunks)
            _, offsets, raw = data.buffers()
            offsets = np.frombuffer(offsets, np.int32)[data.offset : data.offset + len(data) + 1]
            flat = np.frombuffer(raw.slice(offsets[0], offsets[-1] - offsets[0]), np.uint64)
            begin = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
            end = np.append(begin[1:], len(run))
            middle = end - np.add.reduceat(role, begin)
            both = (middle > begin) & (middle < end)
            groups = list(zip(begin[both].tolist(), middle[both].tolist(), end[both].tolist(), strict=True))
            if groups:
                i, j = matcher(flat, (offsets - offsets[0]) // 8, groups, percent)
                made = answer(i, j, dict(zip(columns, _columns(t, *columns), strict=True)))
                if len(made[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in made], names=names)

    blocks = lambda df, name: df.groupBy("g").agg(F.ceil(F.sum("n") / F.lit(BLOCK_TOKENS)).cast("int").alias(name))
    large = stored(blocks(held, "p").join(blocks(asking, "q").hint("merge"), "g").where("p > 1 or q > 1"), "large")

    def dealt(df, role, own, of_other):
        df = join_on_size(df.select("g", *columns), large, "g", "left").withColumn("mine", F.pmod(F.xxhash64("sid"), F.coalesce(own, F.lit(1))).cast("int"))
        df = df.withColumn("theirs", F.explode(F.sequence(F.lit(0), F.coalesce(of_other, F.lit(1)) - 1)))
        part, other = ("mine", "theirs") if role == 0 else ("theirs", "mine")
        return df.select("g", F.col(part).alias("part"), F.col(other).alias("other"), F.lit(role).alias("role"), *columns)

    rows = dealt(held, 0, F.col("p"), F.col("q")).unionByName(dealt(asking, 1, F.col("q"), F.col("p")))
    rows = rows.join(tokens.hint("merge"), "sid").select("g", "part", "other", "role", *columns, "tokens")
    return rows.repartition("g", "part", "other").sortWithinPartitions("g", "part", "other", "role", "sid").mapInArrow(work, kind)

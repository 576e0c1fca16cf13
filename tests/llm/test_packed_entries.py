"""Prefix entries are shuffled as packed arrays, and bitmaps rule out long sets with little in common."""

import random

import numpy as np
import pyarrow as pa

from pagegauge.llm import setjoin as sj


def test_packed_entries_come_back_whole():
    rng = np.random.default_rng(5)
    m = 5000
    run = rng.integers(0, 2**64, m, np.uint64)
    run[:300] = run[300:600]
    run[:2] = 0, 2**64 - 1
    n = rng.integers(1, 70000, m).astype(np.int32)
    n[::2] %= sj.WIDE + 2
    sid, bits, wide, token = rng.integers(-(2**63), 2**63, (4, m))
    hot, pos = rng.random(m) < 0.1, rng.integers(0, 9000, m).astype(np.int32)
    want = sorted(zip(run.view(np.int64).tolist(), sid.tolist(), bits.tolist(), np.where(n > sj.WIDE, wide, 0).tolist(), n.tolist(), pos.tolist(), hot.tolist(), np.where(hot, token, 0).tolist(), strict=True))
    held = [[x[a : a + 1700] for x in (run, sid, bits, wide, n, pos, hot, token)] for a in range(0, m, 1700)]
    for parts in (1, 7, 9000):
        packed = sj._pack(held, parts)
        assert packed.num_rows <= parts
        got = sj._unpack(pa.Table.from_batches([packed]))
        assert sorted(zip(*(x.tolist() for x in got), strict=True)) == want
        assert (np.sort(got[0].view(np.uint64)) == got[0].view(np.uint64)).all()
    none = sj._pack([[x[:0] for x in held[0]]], 3)
    assert none.num_rows == 0


def test_long_sets_with_one_rare_word_in_common_are_no_mates(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(4000)]
    lines, near = [], []
    for i in range(200):
        lines += [" ".join([f"rare{i}", *rng.sample(words, 149)]) for _ in range(2)]
    for i in range(10):
        text = rng.sample(words, 150)
        near += [" ".join(text), " ".join(text[:145] + [f"new{i}-{k}" for k in range(5)])]
    docs = spark.createDataFrame(list(enumerate(lines + near)), "doc_id long, text string").repartition(3, "doc_id")
    unit = sj.line_unit()
    profiled = sj.profile(docs, unit)
    entries = sj.prefix_entries(docs, unit, sj.token_order(profiled), 80, bitmaps=True)
    assert 0 < entries.count() <= 3 * 4  # a row for each task and range, not one for each of some 13,000 prefix words
    shared = sj.mates(entries, 80, first=True)
    sids = {r.doc_id: r.sid for r in profiled.where("chunk is null").collect()}
    found = {r.sid for r in shared.select("sid").distinct().collect()}
    assert found == {sids[i] for i in range(len(lines), len(lines) + len(near))}

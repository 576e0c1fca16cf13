"""Vectorised token sets of texts: Arrow string columns in, 64-bit token hashes out.

Works on whole Arrow batches as flat byte arrays; no loop over words or characters. Hash values stand for words and
shingles. Two different tokens have one value with a probability of about 2**-64 each, whatever bytes they hold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once (a longer single text is taken whole).
SLICE = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULT = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Masks of the first 0 to 8 bytes of a little-endian 64-bit value.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for each byte range: every 8 bytes are mixed with their number in the range before they are added up,
    so no pattern of bytes cancels out, as it does in sums of powers. ``low`` has 8 bytes beyond the last range."""
    size = ends - starts
    parts = (size + 7) >> 3
    first = np.cumsum(parts) - parts
    word = np.repeat(np.arange(len(starts)), parts)
    k = np.arange(len(word)) - first[word]
    eight = np.ndarray((len(low) - 7,), np.uint64, buffer=low, strides=(1,))
    value = eight[starts[word] + 8 * k] & _FIRST[np.minimum(size[word] - 8 * k, 8)]
    value = mix(value ^ mix((k + 1).astype(np.uint64) * _MULT[60]))
    return mix(np.add.reduceat(value, first) + size.astype(np.uint64) * _MULT[59]) if len(starts) else np.zeros(0, np.uint64)


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def slices(offsets: np.ndarray):
    """Row ranges of about SLICE bytes each."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to
        at = to


def words(raw: np.ndarray, offsets: np.ndarray, newline: bool = False):
    """Hash and record of every lower-cased word. With ``newline``, records are the \\n-split lines of the rows.

    Returns (hash, record of the word, row of each record, number of each record in its row).
    """
    n, rows = len(raw), len(offsets) - 1
    edges = offsets[:-1]
    row_of = np.arange(rows)
    number = np.zeros(rows, np.int64)
    if newline:
        cut = np.flatnonzero(raw == 10)
        edges = np.concatenate([offsets[:-1], cut + 1])
        row_of = np.concatenate([np.arange(rows), np.searchsorted(offsets, cut, "right") - 1])
        order = np.lexsort((edges, row_of))
        edges, row_of = edges[order], row_of[order]
        number = np.arange(len(edges)) - np.searchsorted(row_of, row_of, "left")
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), row_of, number
    solid = ~_SPACE[raw]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.concatenate([[False], solid[:-1]]) & ~first[:n]
    starts = np.flatnonzero(solid & ~before)
    after = np.concatenate([solid[1:], [False]]) & ~first[1:]
    ends = np.flatnonzero(solid & ~after) + 1
    low = np.zeros(n + 8, np.uint8)
    low[:n] = _LOWER[raw]
    h = word_hashes(low, starts, ends)
    return h, np.searchsorted(edges, starts, "right") - 1, row_of, number


def shingles(h: np.ndarray, record: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles; a record of fewer words has its whole sequence as its only one."""
    n = len(h)
    if n == 0:
        return h, record
    begin = np.flatnonzero(np.concatenate([[True], record[1:] != record[:-1]]))
    size = np.diff(np.append(begin, n))
    out, rec = [], []
    if n >= k:
        whole = np.flatnonzero(record[: n - k + 1] == record[k - 1 :])
        s = np.zeros(len(whole), np.uint64)
        for j in range(k):
            s += h[whole + j] * _MULT[j]
        out.append(mix(s))
        rec.append(record[whole])
    short = np.flatnonzero(size < k)
    s = size[short].astype(np.uint64) * _MULT[63]
    for j in range(k - 1):
        has = size[short] > j
        s[has] += h[begin[short[has]] + j] * _MULT[j]
    out.append(mix(s))
    rec.append(record[begin[short]])
    return np.concatenate(out), np.concatenate(rec)


def distinct(h: np.ndarray, record: np.ndarray, records: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each record, sorted, and the offsets of the records."""
    bits = np.uint64(max(1, int(records).bit_length()))
    key = (record.astype(np.uint64) << (np.uint64(64) - bits)) | (h >> bits)
    order = np.argsort(key)
    k = key[order]
    if ((k[1:] == k[:-1]) & (h[order[1:]] != h[order[:-1]])).any():  # hashes that differ in their last bits only
        order = np.lexsort((h, record))
    h, record = h[order], record[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (record[1:] != record[:-1])
    h, record = h[keep], record[keep]
    return h, np.searchsorted(record, np.arange(records + 1))


def set_ids(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One 64-bit id for each set; equal sets have equal ids."""
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h ^ _MULT[62]), out=total[1:])
    size = np.diff(offsets).astype(np.uint64)
    return mix(total[offsets[1:]] - total[offsets[:-1]] + size * _MULT[61]).view(np.int64)

"""Operator 13: phrase collocations by weighted acyclic automata.

Sorted n-grams of each shard of the input meet by prefix range, where equal ones are united and their counts summed;
what is frequent in a range goes into count transducers, built word by word in sorted order. A transducer over the phrases gives the counts of all first parts on
its own paths, one over the reversed phrases those of all last parts; the two are composed by phrase.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from .shared import stored, table

MIN_COUNT = 10
MAX_WORDS = 3
TOP = 2000
#: Bytes of text that a shard counts at once; a longer single text is taken whole.
SHARD = 3 << 20
#: Bytes of text for each prefix range, and of the sample that ranges are cut by.
RANGE, SAMPLE = 1 << 20, 4 << 20
#: Entries of a range's runs that are added up at once.
MERGE = 1 << 20
#: Phrases of one transducer.
BLOCK = 4096
#: Between the words of a key: sorts below all else, so a phrase comes right before its own extensions.
SEP = "\x00"
#: A-Z to a-z, tab to space, ends of pieces to newline.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 9 else 10 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))


def _counted(texts: list[bytes], most: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(n-grams, counts), sorted, for n = 1 to ``most``: words are numbered in byte order, so numbers sort as n-grams do."""
    raw = b"\n".join(texts)
    if b"\x00" in raw or b"\x01" in raw:  # keeps order, and SEP free
        raw = raw.replace(b"\x01", b"\x01\x02").replace(b"\x00", b"\x01\x01")
    codes, unique = pd.factorize(np.array(raw.translate(_TABLE).replace(b"\n", b" \n ").split(b" "), object))
    order = np.argsort(unique)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    vocabulary = unique[order]
    words = pa.array(vocabulary, pa.binary()).cast(pa.string())
    at = rank[codes]
    at = at[(vocabulary != b"")[at]]
    inside = (vocabulary != b"\n")[at]
    ids, valid, grams = at, inside, words
    keys, counts = np.unique(ids[valid], return_counts=True)
    yield words.take(pa.array(keys)), counts
    number = np.searchsorted(keys, ids)  # of each place's n-gram among the distinct ones; of no use where not valid
    grams = words.take(pa.array(keys))
    for n in range(2, most + 1):
        valid = valid[:-1] & inside[n - 1 :]
        joint = number[: len(valid)] * len(words) + at[n - 1 :]
        keys, counts = np.unique(joint[valid], return_counts=True)
        grams = pc.binary_join_element_wise(grams.take(pa.array(keys // len(words))), words.take(pa.array(keys % len(words))), SEP)
        yield grams, counts
        number = np.searchsorted(keys, joint)


def _flushed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    """(lang, n-grams, counts) of one shard after another, sorted within a shard, language and n."""
    waiting: dict[str, list[bytes]] = {}
    size = 0

    def flush():
        for lang, texts in sorted(waiting.items()):
            for grams, counts in _counted(texts, most):
                yield lang, grams, counts
        waiting.clear()
        pa.default_memory_pool().release_unused()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            waiting.setdefault(lang, []).append(text)
            size += len(text)
            if size >= SHARD:
                yield from flush()
                size = 0
    yield from flush()


#: A sorted run of n-grams of one shard and prefix range, compressed as one value, so that shuffles move few bytes.
RUN = "part int, lang string, n int, raw long, grams binary, counts binary"
_CODEC = pa.Codec("zstd", compression_level=1)


def _packed(part: int, lang: str, grams: pa.Array, counts: np.ndarray) -> dict:
    text = "\n".join(grams.to_pylist()).encode()  # words hold no newline
    return {"part": part, "lang": lang, "n": len(grams), "raw": len(text), "grams": _CODEC.compress(text).to_pybytes(), "counts": _CODEC.compress(counts.astype("<i8").tobytes()).to_pybytes()}


def _unpacked(n: int, raw: int, grams: bytes, counts: bytes) -> pa.Table:
    text = pa.array([_CODEC.decompress(grams, raw).to_pybytes()], pa.binary()).cast(pa.string())
    return pa.table({"gram": pc.list_flatten(pc.split_pattern(text, "\n")), "f": np.frombuffer(_CODEC.decompress(counts, 8 * n), "<i8")})


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def range_bounds(docs: DataFrame, most: int = MAX_WORDS) -> list[tuple[str, str]]:
    """Lowest (lang, key) of each prefix range but the first, for ranges of about ``RANGE`` bytes of text each.

    Taken from the n-grams of about ``SAMPLE`` bytes of texts, chosen by hash. Bounds decide how even ranges are, not
    what is counted; a hot first word is cut by its second and third. Their number is bounded by the sample's.
    """
    rows = _documents(docs)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = -(-size // RANGE)
    if ranges < 2:
        return []
    some = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(min(1, SAMPLE / size) * (1 << 20)) + 1)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, grams, _ in _flushed(batches, most):
            grams = grams[:: len(grams) // 1000 + 1]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), grams], ["lang", "gram"])

    keys = sorted({(r.lang, r.gram) for r in some.repartition(8).mapInArrow(sampled, "lang string, gram string").collect()})
    return sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []


def shard_counts(docs: DataFrame, bounds: list[tuple[str, str]], most: int = MAX_WORDS) -> DataFrame:
    """Runs (``RUN``): counts of the n-grams of up to ``most`` words in each shard, cut at ``bounds``."""
    shared = docs.sparkSession.sparkContext.broadcast(bounds)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = shared.value
        for lang, grams, counts in _flushed(batches, most):
            first, last = bisect_left(bounds, (lang, "")), bisect_right(bounds, (lang, "\U0010ffff"))
            cuts = [0, *[bisect_left(range(len(grams)), key, key=lambda i: grams[i].as_py()) for _, key in bounds[first:last]], len(grams)]
            rows = [_packed(first + i, lang, grams[a:b], counts[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _arrow_schema())

    return _documents(docs).mapInArrow(work, RUN)


def _arrow_schema() -> pa.Schema:
    return pa.schema([("part", pa.int32()), ("lang", pa.string()), ("n", pa.int32()), ("raw", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary())])


def _summed(least: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, held, size = None, [], 0

        def total() -> pa.Table:
            return pa.concat_tables(held).group_by("gram").aggregate([("f", "sum")]).rename_columns(["gram", "f"])

        def settle() -> pa.RecordBatch:
            part, lang = where
            rows = total()
            words = pc.sum(rows.filter(pc.invert(pc.match_substring(rows["gram"], SEP)))["f"]).as_py() or 0
            rows = pa.concat_tables([rows.filter(pc.greater_equal(rows["f"], least)), pa.table({"gram": [""], "f": pa.array([words], pa.int64())})]).combine_chunks()
            same = [pa.array([lang] * len(rows), pa.string()), rows["gram"].combine_chunks(), rows["f"].combine_chunks(), pa.array([part] * len(rows), pa.int32())]
            return pa.RecordBatch.from_arrays(same, ["lang", "gram", "f", "part"])

        for batch in batches:
            for row in batch.to_pylist():
                if (row["part"], row["lang"]) != where:
                    if held:
                        yield settle()
                    where, held, size = (row["part"], row["lang"]), [], 0
                held.append(_unpacked(row["n"], row["raw"], row["grams"], row["counts"]))
                size += row["n"]
                if size > MERGE:
                    held = [total()]
                    size = 0
                    pa.default_memory_pool().release_unused()
        if held:
            yield settle()

    return add


def frequent_grams(docs: DataFrame, least: int = MIN_COUNT, most: int = MAX_WORDS) -> DataFrame:
    """(lang, gram, f, part): n-grams with a sum of at least ``least``, by prefix range ``part``, words joined by
    ``SEP``; for each range and language also a row with the gram "" and the number of its words. A range's runs arrive
    one by one and are added up whenever ``MERGE`` entries have come."""
    runs = shard_counts(docs, range_bounds(docs, most), most)
    rows = runs.repartition("part").sortWithinPartitions("part", "lang")
    return stored(rows.mapInArrow(_summed(least), "lang string, gram string, f long, part int"), "frequent")


class CountTransducer:
    """Acyclic automaton over words whose final states carry counts; phrases are added in sorted order, and a state
    is shared as soon as nothing more can come below it."""

    def __init__(self):
        self.states: list[tuple[int, tuple]] = []
        self.known: dict[tuple[int, tuple], int] = {}
        self.path: list[list] = [[0, []]]  # of each open state: count, closed arcs
        self.words: list[str] = []

    def _close(self, depth: int) -> None:
        while len(self.words) > depth:
            count, arcs = self.path.pop()
            state = (count, tuple(arcs))
            if (number := self.known.get(state)) is None:
                number = self.known[state] = len(self.states)
                self.states.append(state)
            self.path[-1][1].append((self.words.pop(), number))

    def add(self, words: list[str], count: int) -> None:
        same = 0
        while same < min(len(words), len(self.words)) and words[same] == self.words[same]:
            same += 1
        self._close(same)
        for w in words[same:]:
            self.words.append(w)
            self.path.append([0, []])
        self.path[-1][0] += count

    def data(self) -> str:
        self._close(0)
        return json.dumps([*self.states, (self.path[0][0], self.path[0][1])])


def accepted(data: str) -> Iterator[tuple[list[str], list[int]]]:
    """(words, counts of the first 1, 2, ... of them) of every phrase of a transducer, in sorted order."""
    states = json.loads(data)

    def walk(state: int, words: list[str], counts: list[int]):
        count, arcs = states[state]
        if words:
            counts = [*counts, count]
        if count:
            yield words, counts
        for word, to in arcs:
            yield from walk(to, [*words, word], counts)

    yield from walk(len(states) - 1, [], [])


def _built(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    block, size, where, first, path, counts = CountTransducer(), 0, None, "", [], []

    def done():
        return pd.DataFrame({"lang": [where[1]], "first": [first], "data": [block.data()]})

    for frame in frames:
        for part, lang, key, f, own in zip(frame["part"], frame["lang"], frame["key"], frame["f"], frame["own"]):
            if (part, lang) != where or size >= BLOCK:
                if size:
                    yield done()
                if (part, lang) != where:
                    path, counts = [], []
                block, size, where = CountTransducer(), 0, (part, lang)
            words = key.split(SEP)
            same = 0
            while same < min(len(words), len(path)) and words[same] == path[same]:
                same += 1
            if own and not size:  # the open path comes along, for the counts of first parts
                first = key
                for i in range(1, same + 1):
                    block.add(path[:i], counts[i - 1])
            path, counts = words, [*counts[:same], *[0] * (len(words) - same - 1), f]
            if own:
                block.add(words, f)
                size += 1
    if size:
        yield done()


def transducers(ranged: DataFrame) -> DataFrame:
    """(lang, first, data): count transducers over ``ranged(part, lang, key, f)``, whose parts are ranges of
    (lang, key). ``first`` is the first phrase of a block's own; what is before it are first parts of that phrase.

    The first parts of a range's first phrase may lie in an earlier range; these, at most ``MAX_WORDS`` - 1 for each
    part, are looked up and sent along.
    """
    keys = F.split("low.key", SEP)
    low = ranged.groupBy("part").agg(F.min(F.struct("lang", "key")).alias("low"))
    low = low.select("part", F.col("low.lang").alias("lang"), keys.alias("words"))
    ahead = low.where(F.size("words") > 1).select("part", "lang", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.array_join(F.slice("words", 1, i), SEP))).alias("key"))
    ahead = ahead.join(ranged.select("lang", "key", "f").hint("merge"), ["lang", "key"]).select("part", "lang", "key", "f", F.lit(False).alias("own"))
    rows = ranged.select("part", "lang", "key", "f", F.lit(True).alias("own")).unionByName(ahead).repartition("part").sortWithinPartitions("part", "lang", "key")
    return rows.mapInPandas(_built, "lang string, first string, data string")


def _composed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for lang, first, data in zip(frame["lang"], frame["first"], frame["data"]):
            out = [(lang, SEP.join(words), counts) for words, counts in accepted(data) if len(words) > 1 and SEP.join(words) >= first]
            yield pd.DataFrame(out, columns=["lang", "key", "counts"])


def part_counts(blocks: DataFrame) -> DataFrame:
    """(lang, key, counts): for every phrase of two words or more of the transducers, the counts of its first 1, 2,
    ... words, the whole phrase last."""
    return blocks.mapInPandas(_composed, "lang string, key string, counts array<long>")


def _turned(key) -> F.Column:
    return F.array_join(F.reverse(F.split(key, SEP)), SEP)


def collocations(docs: DataFrame, least: int = MIN_COUNT, most: int = MAX_WORDS, top: int = TOP, covered: int = 50) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of ``docs(lang, text)``: the best ``top`` phrases of each language.

    Words are lower-cased in A-Z; a null language is ``und``, a null text empty; texts without words, and an empty
    table, give nothing. Repeated rows count as often as they are there. Ties go by score, count and phrase in byte
    order, so results don't depend on partitions. Other columns of ``docs`` are ignored.

    No step has a language, a word or a first part in one task: ranges cut anywhere between phrases, a phrase is once
    in each shard at most, and the best phrases are chosen in 64 groups of a language before they meet.
    """
    grams = frequent_grams(docs, least, most)
    n = grams.where("gram = ''").groupBy("lang").agg(F.sum("f").alias("n"))
    grams = grams.where("gram <> ''")
    ahead = part_counts(transducers(grams.withColumnRenamed("gram", "key")))
    turned = grams.select("lang", _turned("gram").alias("key"), "f").repartitionByRange("lang", "key").withColumn("part", F.spark_partition_id())
    behind = part_counts(transducers(stored(turned, "turned"))).select("lang", _turned("key").alias("key"), F.col("counts").alias("last_counts"))
    both = stored(ahead.join(behind.hint("merge"), ["lang", "key"]), "parts")

    wide = lambda c: c.cast("decimal(19,0)")  # noqa: E731  products of two fit 38 digits
    m = F.size("counts")
    a = F.element_at("counts", -1)

    def cut(k):
        l, r = F.get("counts", k - 1), F.get("last_counts", m - k - 1)
        score = (wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"))
        return F.struct(F.call_function("div", score, wide(l) * wide(r)).cast("long").alias("score"), k.alias("k"), l.alias("l"), r.alias("r"))

    scored = both.withColumn("a", a).withColumn("cut", F.array_min(F.transform(F.sequence(F.lit(1), m - 1), cut)))
    words = F.split("key", SEP)
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size(words) - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.array_join(F.slice(words, i, k), SEP))))
    longer = both.where(F.size(words) > 2).select("lang", a.alias("f"), F.explode(inner).alias("key")).groupBy("lang", "key").agg(F.max("f").alias("longest"))
    left = scored.join(longer.hint("merge"), ["lang", "key"], "left").where(f"longest is null or 100 * longest < {int(covered)} * a")
    phrase = F.translate("key", SEP, " ")
    phrase = F.replace(F.replace(phrase, F.lit("\x01\x01"), F.lit("\x00")), F.lit("\x01\x02"), F.lit("\x01"))
    rows = left.select("lang", phrase.alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return rows.join(n.hint("merge"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, 1 AS m, unnest(w) AS phrase FROM worded
  UNION ALL SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM worded
  UNION ALL SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) FROM worded
), counted AS (
  SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE m = 1 GROUP BY lang
), candidates AS (
  SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE m > 1 AND f >= 10
), cuts AS (
  SELECT *, 1 AS k, w[1] AS head, array_to_string(w[2:], ' ') AS tail FROM candidates
  UNION ALL SELECT *, 2, w[1] || ' ' || w[2], w[3] FROM candidates WHERE m = 3
), scored AS (
  SELECT c.lang, c.m, c.phrase, c.a, c.w, c.k, h.f AS l, t.f AS r,
    CAST((1000000::HUGEINT * c.a * c.a) // (h.f::HUGEINT * t.f) AS BIGINT) AS score
  FROM cuts c JOIN counted h ON h.lang = c.lang AND h.phrase = c.head JOIN counted t ON t.lang = c.lang AND t.phrase = c.tail
), least AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, phrase, max(a) AS longest FROM (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM candidates WHERE m = 3
    UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM candidates WHERE m = 3) GROUP BY ALL
), kept AS (
  SELECT l.* FROM least l LEFT JOIN longer g USING (lang, phrase) WHERE g.longest IS NULL OR 100 * g.longest < 50 * l.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""

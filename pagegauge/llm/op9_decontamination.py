"""Operator 9: benchmark decontamination by canonical templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import WORD, small, stored, table

#: Words of a template window (a shorter item is one window), and how many of them must be literal.
WINDOW, LITERAL = 8, 5
#: Benchmark windows up to which they are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 500_000
UNITS = "kg|g|mg|lb|lbs|oz|km|m|cm|mm|mile|miles|feet|inches|l|ml|hours|hour|minutes|minute|seconds|days|years|dollars|euros|percent|mph"

_NAME = r"\p{Lu}[\p{L}'-]*"
_MORE = rf" (?:(?:van|von|der|de|da|di|del|la|bin) ){{0,2}}{_NAME}"
#: In turn: two to four capitalised words that open a sentence, one to four within it, a number, a unit after a number;
#: then any other punctuation goes. A capitalised word alone at the opening is a word. Slots become marked words that
#: carry their value, a name of several words being one; the patterns mean the same in Java and RE2.
STEPS = [
    (rf"(^|[.!?:] |\n)({_NAME}(?:{_MORE}){{1,3}})|([\p{{Ll}}\p{{Nd}},;] )({_NAME}(?:{_MORE}){{0,3}})", "$1$3\x02A\x03$2$4\x04"),
    (r"(^|[^\p{L}\p{Nd}\x03])([0-9]+(?:[.,:/][0-9]+)*)", "$1\x02N\x03$2"),
    (rf"(\x02N\x03[0-9.,:/]+ ?)({UNITS})\b", "$1 \x02U\x03$2"),
]
PUNCTUATION = r"[^\p{L}\p{Nd}\x02-\x04\x20\x09-\x0D]+"
#: After lower-casing.
SLOT_OR_WORD = r"\x02a\x03[^\x04]*\x04|" + WORD


def canonical_words(text: Column) -> Column:
    """Lower-case words without punctuation; a number, name or unit is a marked word with its value."""
    text = F.coalesce(text, F.lit(""))
    for pattern, to in STEPS:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(to))
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, F.lit(PUNCTUATION), F.lit(""))), F.lit(SLOT_OR_WORD), F.lit(0))


def item_words(text: Column) -> Column:
    """Three readings of an item's words: as it stands, as it is read within a sentence, where its first word may be a
    name, and in lower case, where names are words like all others."""
    inside = canonical_words(F.concat(F.lit("x "), text))
    return F.array(canonical_words(text), F.slice(inside, 2, F.greatest(F.size(inside) - 1, F.lit(0))), canonical_words(F.lower(text)))


def _windows(words: Column, length: int, short: bool) -> Column:
    """Array of (place, template hash, slot values) of the windows; with ``short`` a text of fewer words is one."""

    def build(w: Column) -> Column:
        typed = F.transform(w, lambda x: F.when(x.startswith("\x02"), F.substring(x, 1, 2)).otherwise(x))
        some = F.exists(w, lambda x: x.startswith("\x02"))
        # one pass over a bound triple, so that nothing is computed again for each window
        bound = F.array(F.struct(w.alias("w"), typed.alias("t"), some.alias("some")))

        def of(b: Column) -> Column:
            size = F.size(b["w"])
            starts = F.when(size >= length, F.sequence(F.lit(1), size - (length - 1))).otherwise(F.sequence(F.lit(1), F.least(size, F.lit(1))) if short else F.array().cast("array<int>"))
            starts = F.when(size > 0, starts).otherwise(F.array().cast("array<int>"))
            none = F.array().cast("array<string>")
            return F.transform(
                starts,
                lambda i: F.struct(
                    i.alias("place"),
                    F.xxhash64(F.slice(b["t"], i, length)).alias("h"),
                    F.when(b["some"], F.filter(F.slice(b["w"], i, length), lambda x: x.startswith("\x02"))).otherwise(none).alias("slots"),
                ),
            )

        return F.transform(bound, of)[0]

    return F.transform(F.array(words), build)[0]


def template_windows(rows: DataFrame, key: str, length: int = WINDOW, short: bool = False) -> DataFrame:
    """(key, place, h, slots): one row per window; made and used up within a task, texts stay where they are."""
    return rows.select(F.col(key), F.explode(_windows(canonical_words(F.col("text")), length, short)).alias("win")).select(key, "win.place", "win.h", "win.slots")


def consistent(theirs: Column, ours: Column) -> Column:
    """Whether slot values map one to one: equal benchmark values to equal document values, and back."""
    pairs = F.size(F.array_distinct(F.arrays_zip(theirs, ours)))
    return (F.size(theirs) == F.size(ours)) & (pairs == F.size(F.array_distinct(theirs))) & (pairs == F.size(F.array_distinct(ours)))


def benchmark_windows(items: DataFrame, length: int = WINDOW, literal: int = LITERAL) -> DataFrame:
    """(item_id, at, n, h, theirs, verbatim): the windows, from word ``at`` on, of ``items(item_id, w)`` that documents are searched for.

    A window of ``length`` words, or an item of fewer, is a template if at least ``literal`` of its words (of a short
    item: all but one) are outside slots. Another one counts with equal slot values only (verbatim), and a longer one
    takes its place as template: the shortest from the same word on with ``literal`` such words, else the shortest that
    ends with the item, else the whole item. A whole item of slots alone is verbatim.
    """
    size, at = F.size("w"), F.col("i")
    items = items.where(size > 0).withColumn("m", F.least(size, F.lit(length)))
    # how many of the first 0, 1, ... words are literal
    count = F.aggregate("w", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.when(x.startswith("\x02"), 0).otherwise(1))))
    rows = items.withColumn("c", count).withColumn("i", F.explode(F.sequence(F.lit(1), size - F.col("m") + 1)))
    inside = lambda i, e: F.get("c", e) - F.get("c", i - 1)
    enough = inside(at, at + F.col("m") - 1) >= F.least(F.lit(literal), F.greatest(F.lit(1), F.col("m") - 1))
    to = F.array_min(F.filter(F.sequence(at, size), lambda e: inside(at, e) >= literal))
    since = F.coalesce(F.array_max(F.filter(F.sequence(F.lit(1), at), lambda i: inside(i, size) >= literal)), F.lit(1))
    whole = F.struct(since.alias("i"), (size - since + 1).alias("n"), F.lit(False).alias("verbatim"))
    longer = F.when(to.isNotNull() & (size > length), F.struct(at.alias("i"), (to - at + 1).alias("n"), F.lit(False).alias("verbatim"))).otherwise(whole)
    own = lambda verbatim: F.struct(at.alias("i"), F.col("m").alias("n"), F.lit(verbatim).alias("verbatim"))
    rows = rows.select("item_id", "w", F.explode(F.when(enough, F.array(own(False))).otherwise(F.array(own(True), longer))).alias("win"))
    rows = rows.select("item_id", F.col("win.i").alias("at"), F.col("win.n").alias("n"), F.slice("w", F.col("win.i"), F.col("win.n")).alias("w"), "win.verbatim")
    slots = F.filter("w", lambda x: x.startswith("\x02"))
    rows = rows.select("item_id", "at", "n", F.xxhash64(F.transform("w", lambda x: F.when(x.startswith("\x02"), F.substring(x, 1, 2)).otherwise(x))).alias("h"), slots.alias("theirs"), "verbatim")
    return rows.withColumn("verbatim", F.col("verbatim") | (F.size("theirs") == F.col("n"))).distinct()


def agreeing(windows: Column) -> Column:
    """Number of windows, sorted structs (place, n, slots), that count: see ``contamination``."""

    def closed(run: Column) -> Column:
        return run["total"] + F.when(~run["cut"] | run["same"], run["k"]).otherwise(0)

    def step(run: Column, w: Column) -> Column:
        all_slots = F.array_distinct(F.concat(run["slots"], w["slots"]))
        same = F.forall(w["slots"], lambda x: x["theirs"] == x["slots"])
        near = (run["k"] > 0) & (w["place"] <= run["upto"])
        fits = consistent(all_slots["theirs"], all_slots["slots"])
        upto = w["place"] + w["n"]
        longer = F.struct(upto.alias("upto"), all_slots.alias("slots"), (run["k"] + 1).alias("k"), (run["same"] & same).alias("same"), run["cut"].alias("cut"), run["total"].alias("total"))
        # the run that ends at a clash is cut, and so is the one that begins there
        ended = F.struct(run["k"].alias("k"), run["same"].alias("same"), (run["cut"] | near).alias("cut"), run["total"].alias("total"))
        fresh = F.struct(upto.alias("upto"), F.array_distinct(w["slots"]).alias("slots"), F.lit(1).alias("k"), same.alias("same"), near.alias("cut"), closed(ended).alias("total"))
        return F.when(near & fits, longer).otherwise(fresh)

    none = F.lit(0)
    start = F.struct(none.alias("upto"), F.array().cast("array<struct<theirs:string,slots:string>>").alias("slots"), none.alias("k"), F.lit(True).alias("same"), F.lit(False).alias("cut"), none.alias("total"))
    return F.aggregate(windows, start, step, closed)


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")), F.length(text))


def contamination(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW, literal: int = LITERAL) -> DataFrame:
    """(hit_key, n_hits, items): texts, by ``text_key``, with windows of a benchmark item's template.

    Windows that follow one another alike in text and item, each beginning at the end of the one before at the latest,
    are one passage. It counts whole if its slot values map one to one. Otherwise it is cut wherever a window clashes
    with the run before it, and the runs with the item's own values count: a copy in which one number was changed is
    still found by what comes before and after, while other values that don't fit together are another question. Texts without a hit are not listed. Null and empty texts have no windows; nor have
    null and empty items. Repeated items count once each. An item of fewer than ``length`` words is one window,
    compared to document windows of its own length. Windows with few words outside slots count verbatim, and in longer
    windows (``benchmark_windows``); document windows are made for each length that the benchmark's windows have, which
    is one for prose. Only matches are shuffled. Very frequent passages cost one probe per occurrence.
    """
    items = benchmark.where("text is not null").select("item_id", F.explode(item_words(F.col("text"))).alias("w"))
    own = stored(benchmark_windows(items, length, literal), "windows")
    lengths = sorted(r.n for r in own.select("n").distinct().collect())
    texts = docs.select(text_key(F.col("text")).alias("hit_key"), "text")
    hits = None
    for n in lengths:
        some = own.where(F.col("n") == n)
        side = some.hint("broadcast" if small(some, BROADCAST_ROWS) else "merge")
        same = F.when(F.col("verbatim"), F.col("theirs") == F.col("slots")).otherwise(consistent(F.col("theirs"), F.col("slots")))
        found = template_windows(texts, "hit_key", n).join(side, "h").where(same)
        found = found.select("hit_key", "item_id", (F.col("place") - F.col("at")).alias("shift"), "place", "n", F.arrays_zip("theirs", "slots").alias("slots"))
        hits = found if hits is None else hits.union(found)
    if hits is None:
        return docs.select(F.lit(0).cast("long").alias("hit_key"), F.lit(0).cast("long").alias("n_hits"), F.array().cast("array<bigint>").alias("items")).where("false")
    # a passage is at most as long as its item
    windows = F.array_sort(F.collect_list(F.struct("place", "n", "slots")))
    passage = hits.distinct().groupBy("hit_key", "item_id", "shift").agg(windows.alias("windows")).select("hit_key", "item_id", agreeing(F.col("windows")).alias("n")).where("n > 0")
    return passage.groupBy("hit_key").agg(F.sum("n").alias("n_hits"), F.array_sort(F.collect_set("item_id")).alias("items"))


def flag_contaminated(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW, literal: int = LITERAL) -> DataFrame:
    """(doc_id, n_hits, items, contaminated) for every row of ``docs``, each judged by its own text: null and repeated
    ids are like all others. Extra columns are not read."""
    found = contamination(docs, benchmark, length, literal)
    ids = docs.select("doc_id", text_key(F.col("text")).alias("hit_key"))
    out = ids.join(found.hint("merge"), "hit_key", "left")
    none = F.array().cast("array<bigint>")
    return out.select("doc_id", F.coalesce("n_hits", F.lit(0)).cast("long").alias("n_hits"), F.coalesce(F.col("items").cast("array<bigint>"), none).alias("items"), F.col("n_hits").isNotNull().alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW, literal: int = LITERAL) -> DataFrame:
    """Rows of ``docs`` without benchmark passages, columns as given (extra ones too). Each row is judged by its own
    text, whatever its doc_id; repeated rows stay or go together, and null and empty texts stay."""
    found = stored(contamination(docs, benchmark, length, literal).select("hit_key"), "hits")
    side = found.hint("broadcast" if small(found, BROADCAST_ROWS) else "merge")
    return docs.join(side, text_key(docs["text"]) == side["hit_key"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = flag_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.withColumn("items", F.array_join(F.transform("items", lambda x: x.cast("string")), ","))


def _sql_words(text: str) -> str:
    for pattern, to in STEPS:
        to = "".join(f"' || chr({ord(c)}) || '" if ord(c) < 32 else c for c in to.replace("$", "\\"))
        text = f"regexp_replace({text}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to}', 'g')"
    return f"regexp_extract_all(lower(regexp_replace({text}, '{PUNCTUATION}', '', 'g')), '{SLOT_OR_WORD}')"


_TYPED = "list_transform({0}, lambda x: CASE WHEN starts_with(x, chr(2)) THEN x[1:2] ELSE x END)"
_SLOTS = "list_filter({0}, lambda x: starts_with(x, chr(2)))"
ORACLE = f"""
WITH RECURSIVE item AS (
  SELECT item_id, w, least(len(w), {WINDOW}) AS n FROM (
    SELECT item_id, {_sql_words("text")} AS w FROM benchmark WHERE text IS NOT NULL
    UNION ALL SELECT item_id, ({_sql_words("('x ' || text)")})[2:] FROM benchmark WHERE text IS NOT NULL
    UNION ALL SELECT item_id, {_sql_words("lower(text)")} FROM benchmark WHERE text IS NOT NULL
  ) WHERE len(w) > 0
), own AS (
  SELECT DISTINCT item_id, i AS start, n, {_TYPED.format("win")} AS t, {_SLOTS.format("win")} AS theirs
  FROM (SELECT item_id, n, i, w[i:i + n - 1] AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM item))
  WHERE n - len({_SLOTS.format("win")}) >= least({LITERAL}, greatest(1, n - 1))
), doc AS (
  SELECT row_number() OVER () AS rid, doc_id, {_sql_words("coalesce(text, '')")} AS w FROM documents
), win AS (
  SELECT rid, n, i, w[i:i + n - 1] AS win FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM item))
), hit AS (
  SELECT DISTINCT rid, item_id, i - start AS shift, i, own.n, list_zip(theirs, {_SLOTS.format("win")}) AS slots
  FROM win JOIN own ON own.n = win.n AND own.t = {_TYPED.format("win")}
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY rid, item_id, shift ORDER BY i, n, CAST(slots AS VARCHAR)) AS k,
    len(list_filter(slots, lambda x: x[1] <> x[2])) = 0 AS same
  FROM hit
  WHERE len(list_distinct(slots)) = len(list_distinct(list_transform(slots, lambda x: x[1]))) AND len(list_distinct(slots)) = len(list_distinct(list_transform(slots, lambda x: x[2])))
), run AS (
  SELECT rid, item_id, shift, k, i + n AS upto, list_distinct(slots) AS slots, 1 AS r, same, false AS cut, 0 AS total FROM ranked WHERE k = 1
  UNION ALL
  SELECT rid, item_id, shift, k, upto, CASE WHEN near AND fits THEN common ELSE list_distinct(own) END, CASE WHEN near AND fits THEN r + 1 ELSE 1 END,
    CASE WHEN near AND fits THEN was AND same ELSE same END, CASE WHEN near AND fits THEN cut ELSE near END,
    CASE WHEN near AND fits OR (cut OR near) AND NOT was THEN total ELSE total + r END
  FROM (
    SELECT *, len(common) = len(list_distinct(list_transform(common, lambda x: x[1]))) AND len(common) = len(list_distinct(list_transform(common, lambda x: x[2]))) AS fits
    FROM (
      SELECT w.rid, w.item_id, w.shift, w.k, w.i + w.n AS upto, w.i <= run.upto AS near, w.slots AS own, list_distinct(list_concat(run.slots, w.slots)) AS common,
        w.same, run.same AS was, run.cut, run.r, run.total
      FROM run JOIN ranked w ON w.rid = run.rid AND w.item_id = run.item_id AND w.shift = run.shift AND w.k = run.k + 1
    )
  )
), passage AS (
  SELECT rid, item_id, CASE WHEN NOT cut OR same THEN total + r ELSE total END AS n FROM run QUALIFY row_number() OVER (PARTITION BY rid, item_id, shift ORDER BY k DESC) = 1
), ok AS (
  SELECT rid, sum(n)::BIGINT AS n_hits, list_sort(list(DISTINCT item_id)) AS items FROM passage WHERE n > 0 GROUP BY rid
)
SELECT doc_id, coalesce(n_hits, 0)::BIGINT AS n_hits, coalesce(array_to_string(items, ','), '') AS items, n_hits IS NOT NULL AS contaminated
FROM doc LEFT JOIN ok USING (rid)
"""

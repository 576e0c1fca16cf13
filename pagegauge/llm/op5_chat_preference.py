"""Operator 5: chat formatting of preference pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import let, table

BEGIN, END = "<|im_start|>", "<|im_end|>\n"


def conversations_of(turns: DataFrame, key: Column) -> DataFrame:
    """(key, turns): the turns of each conversation as an ordered array of (turn, role, text).

    Repeated turn numbers are ordered by role and text, nulls first. A conversation is one output row, so its turns
    have to meet; nothing else does.
    """
    return turns.groupBy(key.alias("key")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def _header(t: Column) -> Column:
    return F.concat(F.lit(BEGIN), F.coalesce(t["role"], F.lit("")), F.lit("\n"))


def _body(t: Column) -> Column:
    return F.concat(F.coalesce(t["text"], F.lit("")), F.lit(END))


def render(turns: Column) -> Column:
    """Turns as one text; null roles and texts are empty."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _body(t))), "")


def loss_spans(turns: Column, role: str = "assistant") -> Column:
    """Character spans [begin, end) of a rendered completion that a loss counts: bodies of ``role``'s turns."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        head, body = F.length(_header(t)), F.length(_body(t))
        span = F.array(F.struct((acc["at"] + head).alias("begin"), (acc["at"] + head + body).alias("end")))
        return F.struct((acc["at"] + head + body).alias("at"), F.when(t["role"] == role, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def common_turns(a: Column, b: Column) -> Column:
    """Number of leading turns with equal role and text on both sides (nulls equal)."""
    both = F.least(F.size(a), F.size(b))
    differ = F.filter(
        F.when(both > 0, F.sequence(F.lit(1), both)).otherwise(F.array().cast("array<int>")),
        lambda i: ~(F.element_at(a, i)["role"].eqNullSafe(F.element_at(b, i)["role"]) & F.element_at(a, i)["text"].eqNullSafe(F.element_at(b, i)["text"])),
    )
    return F.coalesce(F.element_at(F.when(F.size(differ) > 0, differ), 1) - 1, both)


def format_preferences(pairs: DataFrame) -> DataFrame:
    """``pairs(pair_id, chosen, rejected)`` of turn arrays to prompt and masked completions.

    The longest common prefix of turns is rendered once as prompt; what follows on each side is its completion, with
    the spans that a loss counts. Null sides count as no turns; equal sides leave two empty completions
    (``informative`` is false); an empty table stays empty. Further columns are not kept.
    """
    none = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    pairs = pairs.select("pair_id", F.coalesce("chosen", none).alias("chosen"), F.coalesce("rejected", none).alias("rejected"))
    pairs = pairs.withColumn("cut", let(F.struct("chosen", "rejected"), lambda p: common_turns(p["chosen"], p["rejected"])))
    after = lambda side: F.slice(side, F.col("cut") + 1, F.greatest(F.size(side) - F.col("cut"), F.lit(0)))
    return pairs.select(
        "pair_id",
        F.col("cut").alias("n_prompt_turns"),
        render(F.slice("chosen", F.lit(1), F.col("cut"))).alias("prompt"),
        render(after("chosen")).alias("chosen_completion"),
        loss_spans(after("chosen")).alias("chosen_spans"),
        render(after("rejected")).alias("rejected_completion"),
        loss_spans(after("rejected")).alias("rejected_spans"),
        (~render(after("chosen")).eqNullSafe(render(after("rejected")))).alias("informative"),
    )


def swapped_pairs(turns: DataFrame) -> DataFrame:
    """Preference pairs from a table of conversations: each conversation as chosen, and as rejected the same one with
    its last turn replaced by that of its neighbour (ids 2k and 2k + 1; without a neighbour the last turn is missing)."""
    both = conversations_of(turns.withColumn("turn", F.col("turn").cast("long")).where("conv_id is not null"), F.col("conv_id"))
    meet = both.groupBy(F.floor(F.col("key") / 2).alias("k")).agg(F.array_sort(F.collect_list(F.struct("key", "turns"))).alias("sides"))
    last = lambda t: F.slice(t, -1, 1)
    other = lambda p, i: F.get(p, F.lit(1) - i)
    rows = meet.select(F.explode(F.transform("sides", lambda x, i: F.struct(x["key"].alias("pair_id"), x["turns"].alias("chosen"), other(F.col("sides"), i)["turns"].alias("partner")))).alias("p")).select("p.*")
    rejected = F.concat(F.slice("chosen", F.lit(1), F.size("chosen") - 1), F.coalesce(last(F.col("partner")), F.slice("chosen", 1, 0)))
    return rows.select("pair_id", "chosen", rejected.alias("rejected"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["begin"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    out = format_preferences(swapped_pairs(table(spark, sf_dir, "conversations")))
    return out.withColumn("chosen_spans", spans("chosen_spans")).withColumn("rejected_spans", spans("rejected_spans"))


_HEAD = "'<|im_start|>' || coalesce(t.role, '') || chr(10)"
_TAIL = "coalesce(t.text, '') || '<|im_end|>' || chr(10)"
_RENDER = f"array_to_string(list_transform({{0}}, lambda t: {_HEAD} || {_TAIL}), '')"


def _spans(side: str) -> str:
    return f"""coalesce((SELECT string_agg((e - length({_TAIL})) || '-' || e, ',' ORDER BY i) FROM (
        SELECT t, i, CAST(sum(length({_HEAD} || {_TAIL})) OVER (ORDER BY i) AS BIGINT) AS e
        FROM (SELECT unnest({side}) AS t, generate_subscripts({side}, 1) AS i)) WHERE t.role = 'assistant'), '')"""


ORACLE = f"""
WITH conv AS (
  SELECT conv_id, list({{'turn': turn, 'role': role, 'text': text}} ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), pairs AS (
  SELECT a.conv_id AS pair_id, a.turns AS chosen,
    list_concat(a.turns[1:len(a.turns) - 1], CASE WHEN b.turns IS NULL THEN [] ELSE b.turns[len(b.turns):] END) AS rejected
  FROM conv a LEFT JOIN conv b ON b.conv_id // 2 = a.conv_id // 2 AND b.conv_id <> a.conv_id
), cuts AS (
  SELECT *, coalesce(list_min(list_filter(range(1, least(len(chosen), len(rejected)) + 1),
    lambda i: chosen[i].role IS DISTINCT FROM rejected[i].role OR chosen[i].text IS DISTINCT FROM rejected[i].text)) - 1,
    least(len(chosen), len(rejected))) AS cut FROM pairs
), parts AS (
  SELECT pair_id, cut, chosen[1:cut] AS p, chosen[cut + 1:] AS c, rejected[cut + 1:] AS r FROM cuts
)
SELECT pair_id, CAST(cut AS INTEGER) AS n_prompt_turns, {_RENDER.format("p")} AS prompt,
  {_RENDER.format("c")} AS chosen_completion, {_spans("c")} AS chosen_spans,
  {_RENDER.format("r")} AS rejected_completion, {_spans("r")} AS rejected_spans,
  {_RENDER.format("c")} <> {_RENDER.format("r")} AS informative
FROM parts
"""

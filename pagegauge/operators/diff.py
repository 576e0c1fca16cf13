"""Keyed diffs of two captures, approvals and previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.expressions import changed_fields, col, squeeze

K = ["page_id", "viewport"]
#: Changes of these fields are critical.
IMPORTANT = (
    "required aria_required disabled read_only multiple hidden_attribute aria_hidden tab_index visible checked choice_value_present "
    "choice_value_length choice_value_class value_present value_length value_class accept accessible_name label label_visible_text "
    "label_pseudo_before label_pseudo_after question_text question_visible_text question_pseudo_before question_pseudo_after "
    "selected_option_texts n_options options_hash options text visible_text pseudo_before pseudo_after name type href target rel level "
    "method action enctype n_controls form_method form_action form_enctype hidden_value_present hidden_value_length"
).split()


def assign_keys(records: DataFrame, base: Column, key: str = "key") -> DataFrame:
    """Occurrence keys: base key, ``|#`` and the number of equal base keys before it in document order."""
    n = F.row_number().over(W.partitionBy(*K, "base_key").orderBy("ordinal")) - 1
    return records.withColumn("base_key", base).withColumn(key, F.concat("base_key", F.lit("|#"), n.cast("string"))).drop("base_key")


def control_base() -> Column:
    return F.concat_ws("|", "type", "name")


def link_base() -> Column:
    return F.concat(squeeze("text"), F.lit(""))


def heading_base() -> Column:
    return F.concat(F.lit("h"), F.col("level").cast("string"))


def snapshot_diff(base: DataFrame, cand: DataFrame, props: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys..., key, kind, fields): records that are missing, extra or changed in the candidate. One equi-join."""
    on = [*(keys or K), "key"]
    b = base.select(*on, F.lit(True).alias("in_b"), *[F.col(p).alias(f"b_{p}") for p in props])
    c = cand.select(*on, F.lit(True).alias("in_c"), *[F.col(p).alias(f"c_{p}") for p in props])
    both = b.join(c, on, "full_outer").withColumn("fields", F.when(F.col("in_b") & F.col("in_c"), changed_fields(props)).otherwise(F.array().cast("array<string>")))
    kind = F.when(F.col("in_c").isNull(), "missing").when(F.col("in_b").isNull(), "extra").when(F.size("fields") > 0, "changed")
    return both.withColumn("kind", kind).where("kind is not null").select(*on, "kind", "fields")


def capture_diff(base: DataFrame, cand: DataFrame, base_key: Column, props: list[str]) -> DataFrame:
    """``snapshot_diff`` of two captures with the keys of ``assign_keys``, which are unique in a capture. Both captures
    stay dealt by page throughout: records are numbered, and meet, by groupings that have the page in them. A record
    without a page, viewport or base key meets none."""
    names = [*K, "base_key", "ordinal", "value"]
    sides = [d.withColumn("base_key", base_key).withColumn("value", F.struct(*props)).select(*names, F.lit(i).alias("side")) for i, d in enumerate((base, cand))]
    n = F.row_number().over(W.partitionBy(*K, "base_key", "side").orderBy("ordinal"))
    rows = sides[0].unionByName(sides[1]).withColumn("n", n)
    alone = F.when(F.col("page_id").isNull() | F.col("viewport").isNull() | F.col("base_key").isNull(), F.col("side"))
    of = lambda side: F.first(F.when(F.col("side") == side, F.col("value")), ignorenulls=True)
    both = rows.withColumn("alone", alone).groupBy(*K, "base_key", "n", "alone").agg(of(0).alias("b"), of(1).alias("c"))
    flat = both.select(*K, F.concat("base_key", F.lit("|#"), (F.col("n") - 1).cast("string")).alias("key"), "b", "c", *[F.col(v)[p].alias(f"{v}_{p}") for v in "bc" for p in props])
    fields = F.when(F.col("b").isNotNull() & F.col("c").isNotNull(), changed_fields(props)).otherwise(F.array().cast("array<string>"))
    kind = F.when(F.col("c").isNull(), "missing").when(F.col("b").isNull(), "extra").when(F.size("fields") > 0, "changed")
    return flat.withColumn("fields", fields).withColumn("kind", kind).where("kind is not null").select(*K, "key", "kind", "fields")


def options_diff(base: DataFrame, cand: DataFrame, limit: int = 20) -> DataFrame:
    """(page_id, ordinal, pos, base_length, cand_length): ordered lists compared by index, first
    differences; -1 where a side has no such entry."""
    on = ["page_id", "ordinal", "pos"]
    both = base.select(*on, F.col("option_length").alias("base_length")).join(cand.select(*on, F.col("option_length").alias("cand_length")), on, "full_outer")
    differ = both.where(~F.col("base_length").eqNullSafe(F.col("cand_length")))
    return differ.withColumn("rn", F.row_number().over(W.partitionBy("page_id", "ordinal").orderBy("pos"))).where(F.col("rn") <= limit).drop("rn").fillna(-1)


def mask_diff(base: DataFrame, cand: DataFrame) -> DataFrame:
    """(page_id, kind): selectors whose list of rectangles differs."""
    rect = F.array_sort(F.collect_list(F.struct("n", "x", "y", "w", "h")))
    b, c = (d.groupBy("page_id", "kind").agg(rect.alias(n)) for d, n in ((base, "br"), (cand, "cr")))
    return b.join(c, ["page_id", "kind"], "left").where(~F.col("br").eqNullSafe(F.col("cr"))).select("page_id", "kind", F.size("br").cast("long").alias("n_base"), F.coalesce(F.size("cr"), F.lit(0)).cast("long").alias("n_cand"))


def flatten_mismatches(**categories: DataFrame) -> DataFrame:
    """All diffs as one mismatch table with a category."""
    out = None
    for name, d in categories.items():
        d = d.withColumn("category", F.lit(name))
        out = d if out is None else out.unionByName(d)
    return out


def apply_approvals(mismatches: DataFrame, approvals: DataFrame) -> DataFrame:
    """Mismatches with the first rule that names them exactly (viewport, category, kind, key and set of fields).

    Rules are a policy file, so their size is bounded by its author; AQE picks the join.
    """
    rules = approvals.withColumn("field_set", F.array_sort(F.filter(F.split("fields", ","), lambda x: x != ""))).drop("fields")
    on = ["viewport", "category", "kind", "key", "field_set"]
    first = rules.groupBy(*on).agg(F.min("rule").alias("rule"), F.min_by("rationale", "rule").alias("rationale"))
    out = mismatches.withColumn("field_set", F.array_sort("fields")).join(first, on, "left")
    return out.withColumn("approved", F.col("rule").isNotNull()).drop("field_set")


def mismatch_counts(mismatches: DataFrame, limit: int = 200) -> DataFrame:
    """(page_id, viewport, category, n, n_missing, n_extra, n_changed, truncated) with a total row per page."""
    rows = mismatches.rollup("page_id", "viewport", "category").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("missing", "extra", "changed")]
    )
    return rows.where("viewport is not null").withColumn("category", F.coalesce("category", F.lit("total"))).withColumn("truncated", F.col("n") > limit)


def critical_findings(mismatches: DataFrame, important: list[str] | None = None) -> DataFrame:
    """Missing and extra records, and changes of an important field; accessibility records don't count."""
    names = F.array(*[F.lit(x) for x in important or IMPORTANT])
    return mismatches.where((F.col("category") != "accessibility") & (F.col("kind").isin("missing", "extra") | F.arrays_overlap("fields", names)))


def mismatch_preview(mismatches: DataFrame, changed: int = 20, other: int = 10) -> DataFrame:
    """First mismatches of each page, category and kind by key."""
    rn = F.row_number().over(W.partitionBy(*K, "category", "kind").orderBy("key"))
    return mismatches.withColumn("rn", rn).where(F.col("rn") <= F.when(F.col("kind") == "changed", changed).otherwise(other)).drop("rn")


def retain_details(mismatches: DataFrame, limit: int = 200) -> DataFrame:
    """First ``limit`` mismatches of each category and kind, with the total and a truncation flag."""
    part = W.partitionBy(*K, "category", "kind")
    rows = mismatches.withColumn("rn", F.row_number().over(part.orderBy("key"))).withColumn("total", F.count("*").over(part))
    return rows.where(F.col("rn") <= limit).withColumn("truncated", F.col("total") > limit).drop("rn")


def admit_policy(candidate: DataFrame, least_rationale: int = 12) -> DataFrame:
    """(rule, violations): rules outside the safe families or with too short a rationale.

    Safe families: routing of forms, length or presence of hidden values and placeholders, links made inert.
    """
    safe = ["value_length", "value_length,value_present", "action", "action,method", "href", ""]
    broken = F.array_compact(F.array(
        F.when(~F.col("fields").isin(*safe), F.lit("unsafe_fields")),
        F.when(F.length("rationale") < least_rationale, F.lit("short_rationale")),
        F.when(F.col("kind").isin("missing", "extra") & ~F.col("key").startswith("hidden"), F.lit("unsafe_presence")),
    ))
    return candidate.withColumn("violations", broken).where(F.size("violations") > 0).select("rule", "violations")


def inventory_crosscheck(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, field, a, b) where two independently taken counts differ."""
    names = [c for c in a.columns if c != key and c in b.columns]
    long = lambda d, v: d.unpivot([key], names, "field", v)
    return long(a, "count_a").join(long(b, "count_b"), [key, "field"]).where("count_a <> count_b")


#: Words of a submitting control.
SUBMIT_WORDS = "submit|apply|send|complete|continue"


def primary_action(controls: DataFrame) -> DataFrame:
    """(page_id, ordinal, name): the visible and enabled control whose name has a submit word, else any; the first in
    document order. Without a column ``disabled`` all controls are enabled."""
    score = F.lower("name").rlike(SUBMIT_WORDS).cast("int")
    if "disabled" in controls.columns:
        controls = controls.where("not disabled")
    rn = F.row_number().over(W.partitionBy("page_id").orderBy(score.desc(), "ordinal"))
    return controls.where("visible and type <> 'hidden'").withColumn("rn", rn).where("rn = 1").select("page_id", "ordinal", "name")

"""Queries on mismatches add no shuffle of records to those of the diffs, whose captures stay dealt by page (F20 to F24)."""

import pytest
from pyspark.sql import functions as F

from pagegauge.operators import diff
from pagegauge.plans.fixtures import spark_rows

NAMES = ["mismatch_preview", "retain_details", "critical_findings", "apply_approvals", "admit_policy"]


@pytest.mark.parametrize("name", NAMES)
def test_mismatches_are_worked_on_where_their_pages_are(spark, tmp_path, name):
    lines = spark.range(40).selectExpr("id div 4 l_orderkey", "id % 7 l_partkey", "id % 5 l_suppkey", "cast(id % 4 as int) l_linenumber", "1.5D l_quantity", "2D l_extendedprice", "0.05D l_discount", "0.01D l_tax", "'A' l_returnflag", "'F' l_linestatus", "date'1995-01-01' l_shipdate")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    base, cand, rules = (spark_rows(spark, str(tmp_path), n) for n in ("controls", "controls_cand", "approvals"))
    found = diff.flatten_mismatches(controls=diff.capture_diff(base, cand, diff.control_base(), ["type", "label"]))
    approved = diff.apply_approvals(found, rules)
    out = {
        "mismatch_preview": lambda: diff.mismatch_preview(found),
        "retain_details": lambda: diff.retain_details(found, 2),
        "critical_findings": lambda: diff.critical_findings(found),
        "apply_approvals": lambda: approved,
        "admit_policy": lambda: diff.admit_policy(approved.select("rule", F.concat_ws(",", "fields").alias("fields"), "kind", "key", "rationale")),
    }[name]()
    text = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    # the rules of an approval are few, and grouped and broadcast on their own
    assert text.count("Exchange hashpartitioning(page_id") == 3
    assert text.count("SortMergeJoin") == 0 and found.count() > 0

"""Steps whose cost once grew faster than their input, or with the number of levels."""

import random

from pyspark.sql import functions as F

from pagegauge.operators import corpus, diff, geometry, interaction
from pagegauge.plans.fixtures import spark_rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_long_tokens_meet_blocks_of_a_text_at_every_offset(spark):
    token = "abcdefghijklmnopqrstuvw"
    files = spark.createDataFrame([(i, "." * i + "x" * i + token.upper() + "y") for i in range(30)] + [(99, token[:-1])], "doc_id long, content string")
    got = corpus.contamination_tokens(files, spark.createDataFrame([(1, token), (2, token + "z"), (3, "xxabc")], "token_id long, token string"))
    assert sorted(map(tuple, got.collect())) == sorted([(i, 1) for i in range(30)] + [(i, 3) for i in range(2, 30)])
    text = spark.range(1).select(F.lit("a1b2c3d4e5" * 120).alias("t"))
    assert text.select(F.size(F.regexp_extract_all("t", F.lit("(?s)(.{12})"), F.lit(1)))).first()[0] == 100
    assert text.select(F.size(corpus._grams(F.col("t"), 12, True))).first()[0] == 5


def test_long_lines_are_sought_at_the_begins_of_lines(spark):
    rows = [("a", "x" * 999), ("b", "x" * 1000), ("c", "\n" + "x" * 999 + "\n" + "é" * 1000), ("d", ("x" * 999 + "\n") * 3)]
    scan = corpus.contamination_scan(spark.createDataFrame(rows, "path string, content string"))
    assert {r.kind: r.n_files for r in scan.collect()} == {"long_line": 2}
    assert "(?:^|" in plan(scan)


def test_trees_are_joined_without_broadcasts(spark):
    nodes = spark.range(1, 200).selectExpr("id AS node", "CASE WHEN id > 1 THEN id - 1 END AS parent", "id = 150 AS hidden", "1.0D AS opacity", "0 AS clip_from", "9 AS clip_to")
    seen = geometry.effective_visibility(nodes)
    assert {r.node for r in seen.collect() if r.visible} == set(range(1, 150))
    reached = geometry.css_closure(nodes.where("parent is not null and node <= 40").selectExpr("parent AS src", "node AS dst"), spark.range(1, 2).toDF("node"))
    assert {(r.node, r.depth) for r in reached.collect()} == {(n, n - 1) for n in range(1, 41)}
    for df in (seen, reached):
        assert "Broadcast" not in plan(df) and "RDD" not in plan(df) and "Range" not in plan(df)


def test_logs_are_matched_in_one_shuffle(spark):
    logs = spark.createDataFrame([("s", "p", "u", 3), ("s", "p", "u", 1), (None, "p", None, 7)], "session string, phase string, url string, seq int")
    got = interaction.match_logs(logs, logs.where("seq <> 3"))
    assert set(map(tuple, got.collect())) == {("s", "p", "u", 1, 1, 1), ("s", "p", "u", 2, 3, None), (None, "p", None, 1, 7, 7)}
    assert plan(got).split("== Initial Plan ==")[-1].count("Exchange") == 1


def test_only_pages_that_can_reach_the_alarm_are_swept(spark):
    rects = [(1, 0, 0, 10, 8), (2, 0, 0, 10, 4), (2, 0, 4, 10, 4), (3, 0, 0, 10, 7), (3, 0, 0, 10, 7), (4, 0, 0, 10, 7), (5, 0, 0, 10, 9), (5, 2, 2, -3, 9), (None, 0, 0, 10, 10)]
    df = spark.createDataFrame(rects, "page_id long, x long, y long, w long, h long")
    got = geometry.covered_pages(df, 10, 10)
    assert sorted(got.collect()) == sorted(geometry.union_area(df, 10, 10).where("alarm").collect())
    assert sorted(r.page_id for r in got.collect()) == [1, 2, 5]
    swept = spark.read.parquet(*{f.rsplit("/", 1)[0] for f in got.inputFiles()})
    assert {r.page_id for r in swept.collect()} == {1, 2, 3, 5, None}


def test_captures_are_compared_where_their_pages_are(spark):
    rng = random.Random(3)
    pick = lambda: [(rng.choice([1, 2, 3, None]), rng.choice(["a", "b", None]), i, rng.choice(["x", "y", "x|#0", None]), rng.choice([1, 2, None])) for i in range(120)]
    base, cand = (spark.createDataFrame(pick(), "page_id long, viewport string, ordinal long, name string, size int") for _ in range(2))
    name = F.concat("name", F.lit(""))
    got = diff.capture_diff(base.repartition(3, "page_id"), cand.repartition(3, "page_id"), name, ["name", "size"])
    want = diff.snapshot_diff(diff.assign_keys(base, name), diff.assign_keys(cand, name), ["name", "size"])
    order = lambda d: sorted(map(str, d.collect()))
    assert order(got) == order(want) and {r.kind for r in want.collect()} == {"missing", "extra", "changed"}
    assert plan(got).split("== Initial Plan ==")[-1].count("Exchange") == 2


def test_controls_stay_dealt_by_page(spark, tmp_path):
    lines = spark.range(40).selectExpr("id div 4 l_orderkey", "id % 7 l_partkey", "id % 5 l_suppkey", "cast(id % 4 as int) l_linenumber", "1.5D l_quantity", "2D l_extendedprice", "0.05D l_discount", "0.01D l_tax", "'A' l_returnflag", "'F' l_linestatus", "date'1995-01-01' l_shipdate")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    base, cand = (spark_rows(spark, str(tmp_path), n) for n in ("controls", "controls_cand"))
    found = diff.mismatch_preview(diff.flatten_mismatches(controls=diff.capture_diff(base, cand, diff.control_base(), ["type", "label"])))
    assert plan(found).count("Exchange") == 3 and found.count() > 0

"""Cases in which operators once lost or misplaced rows, lines or passages."""

import random

from pyspark.sql import functions as F

from pagegauge.llm import op3_license_scan as op3
from pagegauge.llm import op4_sharding as op4
from pagegauge.llm import op6_mixing as op6
from pagegauge.llm import op8_line_dedup as op8
from pagegauge.llm import op9_decontamination as op9


def test_wrapped_licence_below_another_notice(spark):
    notice = op3.TEMPLATES["BSD-text"].split()
    text = "All rights reserved.\n\n" + " ".join(notice[:9]) + "\n" + " ".join(notice[9:]) + "\nprint(1)"
    row = op3.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.license, row.passage, row.licenses) == ("BSD-text", -3, "BSD-text,proprietary")


def test_lines_of_other_rows_with_the_same_or_no_id_stay(spark):
    line = lambda seed: " ".join(f"w{random.Random(seed).randrange(10**6)}x{i}" for i in range(8))
    for doc_id in (None, 7):
        rows = [(1, line(1)), (doc_id, f"{line(1)}\n{line(2)}"), (doc_id, f"{line(3)}\n{line(4)}")]
        got = op8.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(r.kept_text for r in got) == sorted([line(1), line(2), f"{line(3)}\n{line(4)}"])


def test_copy_with_one_changed_number_is_found(spark):
    item = "A farmer has 5 fields near the old river and plants 5 rows of corn in every one of them before the spring rain comes down from the hills and then sells the whole harvest for 5 coins"
    copy = item[: -len("5 coins")] + "6 coins"
    rows = [(1, copy), (2, item), (3, item.lower()), (4, "A farmer has 5 fields near the town")]
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    got = {r.doc_id: r for r in op9.flag_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert [got[i].contaminated for i in (1, 2, 3, 4)] == [True, True, True, False]
    assert got[1].n_hits >= 18


def test_lower_case_copy_of_an_item_full_of_names(spark):
    item = "Then Anna met Boris Ivanov and Carla before Dmitri called Elena or Farid and Greta about Hanna Schmidt and Igor"
    rows = [(1, f"note: {item.lower()}"), (2, f"note: {item}"), (3, "then somebody met somebody else and they called others about a thing")]
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    got = {r.doc_id: r.contaminated for r in op9.flag_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {1: True, 2: True, 3: False}


def test_mix_meets_targets_without_ids(spark):
    texts = [(None, f"a b c d e f g h i {i}", "x") for i in range(1000)] + [(None, "same words in all of these rows", "y")] * 1000 + [(5, f"q {i} r s t", "z") for i in range(1000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string").repartition(7)
    got = op6.mixture(docs).withColumn("key", F.round("target")).groupBy("key").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("source_size").alias("size")).collect()
    assert got and all(abs(r.taken - r.target) <= 0.06 * r.target for r in got)
    again = op6.mixture(docs.repartition(3))
    rows = lambda d: sorted(map(tuple, d.select("size", "target", "taken").collect()))
    assert rows(again) == rows(op6.mixture(docs))
    out = op6.mix_sources(docs)
    assert out.columns == docs.columns and out.count() == op6.mixture(docs).where("size > 0").select(F.sum(F.col("taken") / F.col("size"))).first()[0]


def test_rows_without_an_id_spread_over_shards(spark):
    docs = spark.createDataFrame([(None, f"text {i}") for i in range(500)], "doc_id long, text string")
    assert op4.assign_shards(docs).select("shard").distinct().count() == len(op4.SHARDS)

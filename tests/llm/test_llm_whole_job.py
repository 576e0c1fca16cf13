"""Cases that the operators on training data once left out."""

import pytest

from pagegauge.llm import op9_decontamination as op9


def test_items_dense_in_slots(spark):
    quiz = "What is 12 times 37?"
    shop = "Sam bought 12 apples for 3 dollars and 4 pears for 5 dollars and 6 plums for 7 dollars, how much is left"
    sums = "12 37 44 58"
    benchmark = spark.createDataFrame([(1, quiz), (2, shop), (3, sums)], "item_id long, text string")
    change = {"12": "19", "3": "2", "4": "8", "5": "1", "6": "11", "7": "13"}
    other = " ".join(change.get(w, w) for w in shop.split(" "))
    rows = [
        (1, "so: what is 12 times 37? ok"),
        (2, "so: what is 15 times 41? ok"),
        (3, "now " + shop),
        (4, "now " + other + " today"),
        (5, "bought 12 apples for 3 dollars and 4 nuts"),
        (6, "bought 10 apples for 2 dollars and 9 nuts"),
        (7, "list 12 37 44 58 end"),
        (8, "list 13 38 45 59 end"),
        (9, "what is 12 plus 37?"),
    ]
    got = {r.doc_id: r["items"] for r in op9.flag_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    assert got == {1: [1], 2: [1], 3: [2], 4: [2], 5: [2], 6: [], 7: [3], 8: [], 9: []}


def test_windows_of_prose_are_as_before(spark):
    text = "one plain sentence of some words that goes on without any number in it"
    items = spark.createDataFrame([(1, text)], "item_id long, text string").select("item_id", op9.F.explode(op9.item_words(op9.F.col("text"))).alias("w"))
    rows = op9.benchmark_windows(items).collect()
    assert len(rows) == len(text.split()) - 7 and {(r.n, r.verbatim) for r in rows} == {(8, False)}


def test_rows_of_null_and_repeated_ids_go_by_their_own_texts(spark, tmp_path):
    import random

    import corpus_pipeline as p

    rng = random.Random(8)
    make = lambda: " ".join(f"{rng.choice('bcdfglmnprst')}{rng.randrange(10**5)}" for _ in range(60))
    texts = [make() for _ in range(8)]
    item = make()
    near = texts[0].rsplit(" ", 1)[0] + " other"
    rows = [(None, texts[0]), (None, near), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (7, texts[3]), (9, texts[5]), (None, texts[5]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = [(r.doc_id, r.text) for r in p.drop_near_duplicates(spark, docs, "").collect()]
    assert sum(t in (texts[0], near) for _, t in out) == 1
    assert sorted((i or 0, t or "") for i, t in out if t not in (texts[0], near)) == sorted((i or 0, t or "") for i, t in [(None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (9, texts[5]), (None, None)])

    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, texts[6] + " " + item), (None, texts[6]), (None, None), (5, texts[7]), (5, item), (6, item)]
    left = p.drop_contaminated(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in left) == sorted([(0, texts[6]), (0, ""), (5, texts[7])])


def test_lines_of_repeated_rows_keep_their_first(spark):
    from pagegauge.llm import op8_line_dedup as op8

    line = "one two three four five six seven eight nine ten eleven twelve"
    other = line.replace("twelve", "dozen")
    rows = [(1, line + "\nalpha beta"), (1, line + "\nalpha beta"), (2, other), (3, "gamma delta\n" + line), (4, other), (4, other)]
    got = sorted((r.doc_id, r.n_removed, r.kept_text) for r in op8.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert {x for x in got if x[0] in (2, 3, 4)} == {(2, 1, ""), (3, 1, "gamma delta"), (4, 1, "")}
    assert [x for x in got if x[0] == 1] == [(1, 0, line + "\nalpha beta")] * 2

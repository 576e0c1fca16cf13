"""Queries work on all rows that their inventory row asks for."""

import os

import pytest

import __spark_entry__ as entry
from test_oracles import SF, duck, table  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_every_element_meets_its_bands(spark, duck):  # noqa: F811
    sql = entry.oracle_sql()["bands_to_elements"]
    df = entry.queries()["bands_to_elements"](spark, SF)
    res = duck.execute(sql)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    assert len(got) > 0 and got == table([d[0] for d in res.description], res.fetchall())


def test_bands_across_buckets(spark):
    from pagegauge.operators import raster as R

    bands = spark.createDataFrame([(1, "row", 10, 200, 5), (1, "column", 64, 64, 5), (1, "row", 300, 310, 5)], "raster int, axis string, start int, end int, pixels long")
    elements = spark.createDataFrame([(1, i, (i * 37) % 150, (i * 91) % 330, 1 + i % 70, 1 + i % 90) for i in range(120)] + [(1, 500, 60, 0, 10, 400), (2, 501, 0, 0, 400, 400)], "raster int, n long, x int, y int, w int, h int")
    rows = [tuple(r) for r in elements.collect()]
    want = set()
    for r, axis, start, end, _ in [tuple(b) for b in bands.collect()]:
        hits = sorted((w * h, n) for r2, n, x, y, w, h in rows if r2 == r and (y if axis == "row" else x) <= end and (y + h if axis == "row" else x + w) - 1 >= start)
        want |= {(axis, start, n, area, i + 1) for i, (area, n) in enumerate(hits[:8])}
    assert {(r.axis, r.start, r.n, r.area, r["rank"]) for r in R.bands_to_elements(bands, elements).collect()} == want


def test_tokens_are_whole_texts(spark, duck):  # noqa: F811
    sql = entry.oracle_sql()["contamination_tokens"]
    df = entry.queries()["contamination_tokens"](spark, SF)
    res = duck.execute(sql)
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table([d[0] for d in res.description], res.fetchall())


def test_short_and_foreign_tokens_and_paths(spark):
    from pagegauge.operators import corpus as C

    files = [(1, "a/readme.txt", "see ac-me co now"), (2, "sites/acme-co/x.txt", "nothing"), (3, "a/b.txt", "text with \u6771\u4eac\u30bf\u30ef\u30fc\u99c5 inside"), (4, "a/c.txt", "ac me corner"), (None, "a/d.txt", "ACME CO"), (5, None, None), (6, "a/e.txt", "The Quick Brown Fox, jumps over it"), (7, "a/f.txt", "the quick brown fox sleeps")]
    tokens = [(10, "Acme.Co"), (11, "\u6771\u4eac\u30bf\u30ef\u30fc"), (12, "quick brown fox jumps"), (13, "see"), (14, None)]
    out = C.contamination_tokens(spark.createDataFrame(files, "doc_id long, path string, content string"), spark.createDataFrame(tokens, "token_id long, token string"))
    assert sorted((r.doc_id or 0, r.token_id) for r in out.collect()) == [(0, 10), (1, 10), (2, 10), (3, 11), (4, 10), (6, 12)]

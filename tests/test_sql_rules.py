"""Queries and their SQL state one rule on rows where they once differed."""

import duckdb
import pytest

import __spark_entry__ as entry
from test_oracles import table


def both(spark, sf_dir, name, **tables):
    con = duckdb.connect()
    for n, df in tables.items():
        df.coalesce(1).write.parquet(f"{sf_dir}/{n}.parquet")
        con.execute(f"create view {n} as select * from read_parquet('{sf_dir}/{n}.parquet/*.parquet')")
    df = entry.queries()[name](spark, sf_dir)
    res = con.execute(entry.oracle_sql()[name])
    return table(df.columns, [tuple(r) for r in df.collect()]), table([d[0] for d in res.description], res.fetchall())


@pytest.mark.parametrize("name", ["extract_headings", "page_profile"])
def test_entities_without_a_semicolon_are_decoded(spark, tmp_path, name):
    html = '<html lang="en"><head><meta charset="utf-8"><title>{0}</title></head><body><h1>{0}</h1></body></html>'
    rows = [(i, "https://a.example/", html.format(t)) for i, t in enumerate(["und&amp;&amp", "a&am", "&copy b &quot", "x&amp;quot;y"])]
    got, want = both(spark, str(tmp_path), name, pages=spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert got == want
    assert "und&&" in str(got)


def test_a_fill_that_cannot_be_read_leaves_text_to_its_colour(spark, tmp_path):
    part = spark.createDataFrame([(k, 1 + k * 7 % 50) for k in range(2000)], "p_partkey long, p_size int")
    got, want = both(spark, str(tmp_path), "text_contrast", part=part)
    assert got == want

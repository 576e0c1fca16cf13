"""What style sheets pull in, breadth first, under the budgets of a capture."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.readers import cut

#: Kinds of files that a capture keeps.
KEPT_TYPES = r"^(?:text/css$|font/|image/|video/|audio/|application/(?:font|vnd\.ms-fontobject))"
KEPT_NAMES = r"\.(?:avif|css|eot|gif|ico|jpe?g|otf|png|svg|ttf|web[mp]|woff2?)(?:$|\?)"

#: Pages of up to so many rows (seeds, files and addresses in sheets) are read in one go.
HELD = 10_000

ADMISSION = "page_id long, src string, ordinal long, url string, bytes long, css boolean, reason string, seq long, n long, requests long, total long"


def _reasons(max_resources: int, max_requests: int, max_bytes: int, max_total: int):
    def decide(n: int, requests: int, total: int, size: int, kept: bool, failure: str | None) -> tuple[str, int, int, int]:
        """The reason for a dependency that is met, and the counters of its page after it."""
        if n >= max_resources:
            return "resource-count-limit", n, requests, total
        requests += 1
        if requests > max_requests:
            return "network-request-limit", n, requests, total
        if failure is not None:
            return failure, n, requests, total
        if size > max_bytes:
            return "resource-limit", n, requests, total
        if not kept:
            return "unsupported-content-type", n, requests, total
        if total + size > max_total:
            return "aggregate-limit", n, requests, total
        return "admitted", n + 1, requests, total + size

    return decide


def _admission(decide):
    def admit(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One level of pages whose rows follow one another in order; only counters and the addresses that the
        current page has admitted are kept, of which the budget allows few."""
        page = None
        for rows in pages:
            out = []
            for r in rows.itertuples(index=False):
                if r.page_id != page:
                    page, n, requests, total, taken = r.page_id, r.n, r.requests, r.total, set()
                if r.dst in taken:
                    continue
                reason, n, requests, total = decide(n, requests, total, r.bytes, r.kept, r.failure)
                if reason == "admitted":
                    taken.add(r.dst)
                out.append((page, r.src, r.ordinal, r.dst, r.bytes, r.css, reason, n, n, requests, total))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ADMISSION.split(", ")])

    return admit


FOUND = "page_id long, src string, ordinal long, url string, reason string"


#: Kinds of rows of a page; a file is a sum of the last two, or 0.
SEED, EDGE, KEPT, CSS = 4, 8, 1, 2


def _values(column: pa.Array) -> list:
    """Python values; much faster than one scalar at a time, but for integers with nulls."""
    return column.to_pylist() if column.null_count and pa.types.is_integer(column.type) else column.to_numpy(zero_copy_only=False).tolist()


def _whole_pages(decide, held: int):
    def walk(seeds: list, files: dict, edges: dict) -> Iterator[tuple]:
        n, requests, total = len(seeds), 0, sum(size for _, _, size in seeds)
        known, front = {url for url, _, _ in seeds}, [(url, seq) for url, seq, _ in seeds]
        while front:
            met = [(seq is not None, seq, ordinal is not None, ordinal, dst, src) for src, seq in front for ordinal, dst in edges.get(src, ()) if dst not in known]
            front, taken = [], set()
            for *_, ordinal, dst, src in sorted(met):
                for size, kept, css, failure in files.get(dst, [(0, False, False, "dependency-fetch-failed")]):
                    if dst in taken:
                        break
                    reason, n, requests, total = decide(n, requests, total, size, kept, failure)
                    yield src, ordinal, dst, reason
                    if reason == "admitted":
                        taken.add(dst)
                        if css:
                            front.append((dst, n))
            known |= taken

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(page_id, src, ordinal, url, reason) of pages whose rows follow one another; of a page of more than ``held``
        rows only one row without a reason."""
        page, rows, seeds, files, edges = None, 0, [], {}, {}

        def end():
            if rows > held:
                return [(page, None, None, None, None)]
            return [(page, *x) for x in walk(seeds, files, edges)] if seeds and edges else []

        def batch_of(found):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()))], names=["page_id", "src", "ordinal", "url", "reason"])

        for batch in batches:
            found = []
            for page_id, role, url, number, size, name in zip(*map(_values, batch.columns)):
                if page_id != page:
                    found += end()
                    page, rows, seeds, files, edges = page_id, 0, [], {}, {}
                rows += 1
                if rows > held:
                    seeds, files, edges = [], {}, {}
                elif role == SEED:
                    seeds.append((url, number, size))
                elif role == EDGE:
                    edges.setdefault(url, []).append((number, name))
                else:
                    files.setdefault(url, []).append((size, role & KEPT > 0, role & CSS > 0, name))
            if found:
                yield batch_of(found)
        if found := end():
            yield batch_of(found)

    return work


def css_budget_closure(edges: DataFrame, files: DataFrame, seeds: DataFrame, max_resources: int, max_requests: int, max_bytes: int, max_total: int, most: int = 100, held: int = HELD) -> DataFrame:
    """(page_id, src, ordinal, url, reason) of every dependency that is met, admitted or with the reason why not.

    edges (page_id, src, ordinal, dst): addresses in a sheet, in order. files (page_id, url, content_type, bytes,
    failure): what a request gives; without a row it fails. seeds (page_id, url, n, bytes): files already there, in
    order. Sheets are read in the order in which they came in, so a level of the search is read whole before the next;
    counters of a page go from level to level. A file that is there already isn't met again and costs nothing; one that
    was refused is tried again. A refused request still counts, one beyond the number of files doesn't.

    One shuffle brings each page's rows together, and they are streamed page by page; of a page at most ``held`` rows
    are in memory. Larger pages go level by level through joins, to a depth of ``most``: each level is sorted by page
    and streamed, so that no page is gathered, and written before the next begins. Rows without a page are left out. A
    page is in one task: its budget bounds what is admitted, its order is sequential.
    """
    decide = _reasons(max_resources, max_requests, max_bytes, max_total)
    edges = edges.where("page_id is not null and src is not null and dst is not null")
    seeds = seeds.where("page_id is not null")
    kept = F.lower("content_type").rlike(KEPT_TYPES) | F.lower("url").rlike(KEPT_NAMES)
    css = F.coalesce(F.lower("content_type") == "text/css", F.lit(False))
    facts = files.where("page_id is not null and url is not null").select("page_id", "url", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce(kept, F.lit(False)).alias("kept"), css.alias("css"), "failure")
    rows = seeds.selectExpr("page_id", f"{SEED} role", "url", "n number", "coalesce(bytes, 0) size", "cast(null as string) name")
    rows = rows.union(facts.selectExpr("page_id", f"if(kept, {KEPT}, 0) + if(css, {CSS}, 0) role", "url", "0L number", "bytes size", "failure name"))
    rows = rows.union(edges.selectExpr("page_id", f"{EDGE} role", "src url", "ordinal number", "0L size", "dst name"))
    found = cut(rows.repartition("page_id").sortWithinPartitions("page_id").mapInArrow(_whole_pages(decide, held), FOUND), "closure")
    large = found.where("reason is null").select("page_id")
    found = found.where("reason is not null")
    if large.isEmpty():
        return found
    edges, facts, seeds = (cut(d.join(large.hint("merge"), "page_id", "left_semi"), "large") for d in (edges, facts, seeds))
    return found.unionByName(_by_level(edges, facts, seeds, decide, most))


def _by_level(edges: DataFrame, facts: DataFrame, seeds: DataFrame, decide, most: int) -> DataFrame:
    """The closure of pages of any size, a level at a time."""
    facts = facts.withColumnRenamed("url", "dst").withColumn("found", F.lit(True))
    admit = _admission(decide)
    known = seeds.select("page_id", F.col("url").alias("dst"))
    used = seeds.groupBy("page_id").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("requests"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total"))
    front = seeds.select("page_id", F.col("url").alias("src"), F.col("n").alias("seq"))
    levels = []
    for _ in range(most):
        met = front.join(edges.hint("merge"), ["page_id", "src"]).join(known.hint("merge"), ["page_id", "dst"], "left_anti")
        met = met.join(facts.hint("merge"), ["page_id", "dst"], "left").join(used.hint("merge"), "page_id")
        failure = F.when(F.col("found").isNull(), "dependency-fetch-failed").otherwise(F.col("failure"))
        met = met.select("page_id", "src", "ordinal", "dst", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("css", F.lit(False)).alias("css"), F.coalesce("kept", F.lit(False)).alias("kept"), failure.alias("failure"), "n", "requests", "total", "seq")
        ordered = met.repartition("page_id").sortWithinPartitions("page_id", "seq", "ordinal", "dst").drop("seq")
        level = cut(ordered.mapInPandas(admit, ADMISSION), "closure")
        if level.isEmpty():
            break
        levels.append(level)
        taken = level.where("reason = 'admitted'")
        known = known.unionByName(taken.select("page_id", F.col("url").alias("dst")))
        used = level.groupBy("page_id").agg(F.max("n").alias("n"), F.max("requests").alias("requests"), F.max("total").alias("total"))
        front = taken.where("css").select("page_id", F.col("url").alias("src"), "seq")
    else:
        raise ValueError("the closure is deeper than allowed")
    out = ["page_id", "src", "ordinal", "url", "reason"]
    found = (levels or [level])[0].select(*out)
    for level in levels[1:]:
        found = found.unionByName(level.select(*out))
    return found

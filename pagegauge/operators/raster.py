"""Raster comparison: pixel joins, metrics, change histograms and bands."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.expressions import yiq_delta

CHANNELS = ("r", "g", "b", "a")
#: Colour of pixels that one side doesn't have.
PAD = {"r": 1, "g": 2, "b": 3, "a": 255}
#: Largest squared YIQ distance of two colours.
YIQ_MAX = 35215.0
TILE = 64


def pixel_pairs(base: DataFrame, cand: DataFrame) -> DataFrame:
    """(raster, y, x, b_r.., c_r.., padded): both sides of every pixel; colours travel packed in one integer."""
    pack = lambda: (F.shiftleft(F.col("r"), 24) + F.shiftleft(F.col("g"), 16) + F.shiftleft(F.col("b"), 8) + F.col("a")).cast("int")
    on = ["raster", "y", "x"]
    both = base.select(*on, pack().alias("bp")).join(cand.select(*on, pack().alias("cp")), on, "full_outer")
    part = lambda c, i: F.shiftrightunsigned(F.col(c), 24 - 8 * i).bitwiseAND(255)
    sides = [F.coalesce(part(f"{s}p", i), F.lit(PAD[ch])).alias(f"{s}_{ch}") for s in "bc" for i, ch in enumerate(CHANNELS)]
    return both.select(*on, *sides, (F.col("bp").isNull() | F.col("cp").isNull()).alias("padded"))


def changed(pairs: DataFrame) -> DataFrame:
    """Pairs with the flag changed: any channel differs."""
    same = F.lit(True)
    for ch in CHANNELS:
        same = same & (F.col(f"b_{ch}") == F.col(f"c_{ch}"))
    return pairs.withColumn("changed", ~same)


def pixel_metrics(pairs: DataFrame, masked: str = "false") -> DataFrame:
    """(raster, n_pixels, n_padded, n_masked, n_changed, percent) over pixels that aren't masked, at least one."""
    m = F.expr(masked)
    rows = changed(pairs).groupBy("raster").agg(F.count("*").alias("n_pixels"), F.count_if("padded").alias("n_padded"), F.count_if(m).alias("n_masked"), F.count_if(F.col("changed") & ~m).alias("n_changed"))
    return rows.withColumn("percent", 100.0 * F.col("n_changed") / F.greatest(F.lit(1), F.col("n_pixels") - F.col("n_masked")))


def with_yiq(pairs: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Pairs with the flag over: the perceptual distance is above the threshold."""
    d = yiq_delta("b_r", "b_g", "b_b", "c_r", "c_g", "c_b")
    return pairs.withColumn("over", d > F.lit(YIQ_MAX * threshold * threshold))


def pixel_metrics_yiq(pairs: DataFrame, threshold: float = 0.1) -> DataFrame:
    """(raster, n_over, percent_over), anti-aliased pixels included."""
    return with_yiq(pairs, threshold).groupBy("raster").agg(F.count_if("over").alias("n_over"), (100.0 * F.count_if("over") / F.count("*")).alias("percent_over"))


def anti_aliased(img: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Pixels that look like anti-aliasing (after Vysniauskas, 2009): among the eight neighbours at most two are
    equally bright, some are darker and some brighter, and a brightest or darkest one has many equal neighbours in
    both images. ``img`` and ``other`` are (h, w) brightness arrays; outside counts as not there."""
    h, w = img.shape
    pad = np.pad(img.astype(float), 1, constant_values=np.nan)
    shifts = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
    delta = np.stack([pad[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] - img for dy, dx in shifts])
    equal, low, high = (delta == 0).sum(0), np.nan_to_num(delta, nan=0).min(0), np.nan_to_num(delta, nan=0).max(0)

    def crowd(a: np.ndarray) -> np.ndarray:
        p = np.pad(a.astype(float), 1, constant_values=np.nan)
        return sum((p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] == a).astype(int) for dy, dx in shifts) > 2

    many = np.pad(crowd(img) & crowd(other), 1)
    at = lambda pick: np.take_along_axis(np.stack([many[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy, dx in shifts]), pick[None], 0)[0]
    dark, bright = np.nan_to_num(delta, nan=0).argmin(0), np.nan_to_num(delta, nan=0).argmax(0)
    return (equal <= 2) & (low < 0) & (high > 0) & (at(dark) | at(bright))


def pixel_metrics_tolerant(pairs: DataFrame, threshold: float = 0.1) -> DataFrame:
    """(raster, n_over, n_anti_aliased): pixels over the threshold that aren't anti-aliased, and those that are.

    Tiles of TILE rows with a halo of two rows are worked on apart, so no raster has to fit a task.
    """

    def work(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        raster, tile = key
        y0, x0 = frame["y"].min(), frame["x"].min()
        shape = (int(frame["y"].max() - y0) + 1, int(frame["x"].max() - x0) + 1)
        grid = {c: np.full(shape, -1.0) for c in ("b", "c")}
        over = np.zeros(shape, bool)
        at = (frame["y"].to_numpy() - y0, frame["x"].to_numpy() - x0)
        for s in "bc":
            grid[s][at] = frame[f"{s}_r"] * 0.29889531 + frame[f"{s}_g"] * 0.58662247 + frame[f"{s}_b"] * 0.11448223
        over[at] = frame["over"]
        aa = anti_aliased(grid["b"], grid["c"]) | anti_aliased(grid["c"], grid["b"])
        own = ((np.arange(shape[0]) + y0) // TILE == tile)[:, None] & over
        return pd.DataFrame({"raster": [raster], "n_over": [int((own & ~aa).sum())], "n_anti_aliased": [int((own & aa).sum())]})

    rows = with_yiq(pairs, threshold)
    tiles = F.array_distinct(F.transform(F.array(F.lit(-2), F.lit(0), F.lit(2)), lambda d: F.floor((F.col("y") + d) / TILE)))
    parts = rows.withColumn("tile", F.explode(tiles)).where("tile >= 0")
    per = parts.groupBy("raster", "tile").applyInPandas(work, "raster int, n_over long, n_anti_aliased long")
    return per.groupBy("raster").agg(F.sum("n_over").alias("n_over"), F.sum("n_anti_aliased").alias("n_anti_aliased"))


def diff_bbox(pairs: DataFrame) -> DataFrame:
    """(raster, x0, y0, x1, y1) of the changed pixels; rasters without one have no row."""
    return changed(pairs).where("changed").groupBy("raster").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def axis_counts(pairs: DataFrame) -> DataFrame:
    """(raster, axis, pos, n): changed pixels by row and by column, from one pass over the pairs."""
    hit = changed(pairs).where("changed")
    sets = hit.groupingSets([["raster", "y"], ["raster", "x"]], "raster", "y", "x").agg(F.count("*").alias("n"), F.grouping("x").alias("by_row"))
    return sets.select("raster", F.when(F.col("by_row") == 1, "row").otherwise("column").alias("axis"), F.coalesce("y", "x").alias("pos"), "n")


def merge_bands(counts: DataFrame, gap: int = 3) -> DataFrame:
    """(raster, axis, start, end, pixels, peak, size): active positions merged over gaps of at most ``gap``."""
    line = W.partitionBy("raster", "axis").orderBy("pos")
    new = F.coalesce((F.col("pos") - F.lag("pos").over(line) > gap + 1).cast("int"), F.lit(1))
    rows = counts.withColumn("new", new).withColumn("band", F.sum("new").over(line))
    bands = rows.groupBy("raster", "axis", "band").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.sum("n").alias("pixels"), F.max("n").alias("peak"))
    return bands.withColumn("size", F.col("end") - F.col("start") + 1).drop("band")


def top_bands(bands: DataFrame, n: int = 30) -> DataFrame:
    """The ``n`` bands of each axis with most pixels, then the first."""
    rn = F.row_number().over(W.partitionBy("raster", "axis").orderBy(F.desc("pixels"), "start"))
    return bands.withColumn("rank", rn).where(F.col("rank") <= n)


#: Positions of one bucket of the interval join.
BUCKET = 64


def bands_to_elements(bands: DataFrame, elements: DataFrame, k: int = 8) -> DataFrame:
    """(raster, axis, start, end, n, area, rank): elements that overlap a band, both ends included; the ``k`` smallest.

    Raster, axis and bucket of ``BUCKET`` positions are equi-keys, the interval is a residual condition. A pair that
    shares several buckets counts in the first of them only. The limit on the rank is applied before the shuffle too.
    """
    row, size = F.col("axis") == "row", F.lit(BUCKET)
    bucket = lambda c: F.floor(c / size)
    e = elements.select(F.col("raster").alias("r"), "n", "x", "y", "w", "h", F.explode(F.array(F.lit("row"), F.lit("column"))).alias("axis"))
    e = e.select("r", "n", (F.col("w") * F.col("h")).alias("area"), F.when(row, F.lit("row")).otherwise(F.lit("other")).alias("side"), F.when(row, F.col("y")).otherwise(F.col("x")).alias("low"), F.when(row, F.col("y") + F.col("h") - 1).otherwise(F.col("x") + F.col("w") - 1).alias("high"))
    e = e.select("*", F.explode(F.sequence(bucket(F.col("low")), bucket(F.col("high")))).alias("at"))
    b = bands.withColumn("b_side", F.when(row, F.lit("row")).otherwise(F.lit("other"))).withColumn("b_at", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("end")))))
    once = F.col("at") == F.greatest(bucket(F.col("low")), bucket(F.col("start")))
    hit = b.join(e, (F.col("raster") == F.col("r")) & (F.col("b_side") == F.col("side")) & (F.col("b_at") == F.col("at")) & (F.col("low") <= F.col("end")) & (F.col("high") >= F.col("start")) & once)
    rank = F.row_number().over(W.partitionBy("raster", "axis", "start").orderBy("area", "n"))
    return hit.withColumn("rank", rank).where(F.col("rank") <= k).select("raster", "axis", "start", "end", "n", "area", "rank")


def image_sizes(pixels: DataFrame) -> DataFrame:
    """(origin, width, height, n) of scanned images."""
    return pixels.groupBy("origin").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.count("*").alias("n"))


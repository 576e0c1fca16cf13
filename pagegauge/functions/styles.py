"""Computed CSS values as column expressions: colours, clips, filters, transforms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expressions import col

NUMBER = r"-?(?:\d+\.?\d*|\.\d+)"
EXPONENT = rf"-?(?:\d+\.?\d*|\.\d+)(?:e[-+]?\d+)?"
EDGE = r"(-?[\d.]+)(?:px)?"


def plain(c) -> Column:
    """Trimmed, lower-case; null is empty."""
    return F.lower(F.trim(F.coalesce(col(c), F.lit(""))))


def number(c) -> Column:
    """The number a value begins with, whatever its unit; null without one."""
    return F.regexp_extract(col(c), f"^{EXPONENT}", 0).try_cast("double")


def share(c) -> Column:
    """A number, or a percentage as a part of one."""
    return F.when(F.endswith(col(c), F.lit("%")), number(c) / 100).otherwise(number(c))


def color_alpha(c) -> Column:
    """Alpha of a colour of any notation; 1 where none is written."""
    text = plain(c)
    slash = F.regexp_extract(text, rf"/\s*({NUMBER}%?)\s*\)$", 1)
    comma = F.regexp_extract(text, rf"^rgba\([^)]*,\s*({NUMBER}%?)\s*\)$", 1)
    return F.when(text == "transparent", 0.0).when(slash != "", share(slash)).when(comma != "", share(comma)).otherwise(1.0)


def color(c) -> Column:
    """(r, g, b, a) of ``rgb()`` and ``rgba()`` with commas or blanks, numbers or percentages. An empty value is
    transparent black; null for other notations."""
    text = plain(c)
    parts = F.regexp_extract_all(text, F.lit(f"({NUMBER}%?)"), F.lit(1))

    def channel(i: int) -> Column:
        part = F.get(parts, F.lit(i))
        return F.when(F.endswith(part, F.lit("%")), number(part) * 2.55).otherwise(number(part))

    alpha = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(share(F.get(parts, F.lit(3))), F.lit(1.0))))
    known = F.struct(channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b"), alpha.alias("a"))
    clear = F.struct(*[F.lit(0.0).alias(n) for n in "rgba"])
    return F.when(text.isin("", "transparent"), clear).when(F.startswith(text, F.lit("rgb")) & (F.size(parts) >= 3), known)


def inset(clip_path, width, height) -> Column:
    """Top, right, bottom and left of ``inset()`` in pixels; null for anything else."""
    body = F.regexp_extract(plain(clip_path), r"^inset\(([^)]*)\)", 1)
    parts = F.filter(F.split(F.regexp_replace(body, r"\s+round\s.*$", ""), r"\s+"), lambda x: x != "")
    n = F.size(parts)

    def side(i: int, at: Column) -> Column:
        part = F.get(parts, at)
        return F.when(F.endswith(part, F.lit("%")), number(part) / 100 * col(width if i % 2 else height)).otherwise(number(part))

    second = F.when(n > 1, 1).otherwise(0)
    third = F.when(n > 2, 2).otherwise(0)
    fourth = F.when(n > 3, 3).otherwise(second)
    valid = (n > 0) & F.forall(parts, lambda x: F.rlike(x, F.lit(rf"^{NUMBER}(?:px|%)?$")))
    return F.when(valid, F.array(side(0, F.lit(0)), side(1, second), side(2, third), side(3, fourth)))


def zero_clip(clip, clip_path, width, height) -> Column:
    """Whether ``clip`` or ``clip-path`` leaves nothing of a box."""
    rect = rf"^rect\(\s*{EDGE}[,\s]+{EDGE}[,\s]+{EDGE}[,\s]+{EDGE}\s*\)$"
    top, right, bottom, left = (F.regexp_extract(plain(clip), rect, i).try_cast("double") for i in (1, 2, 3, 4))
    path = plain(clip_path)
    sides = inset(clip_path, width, height)
    shape = F.rlike(path, F.lit(r"^(?:circle|ellipse)\(\s*0(?:px|%)?(?:\s+0(?:px|%)?)?(?:\s+at\b|\s*\))"))
    points = F.regexp_extract_all(F.regexp_extract(path, r"^polygon\((.*)\)$", 1), F.lit(r"(-?[\d.]+%?\s+-?[\d.]+%?)"), F.lit(1))
    one = F.size(F.array_distinct(F.transform(points, lambda x: F.regexp_replace(x, r"\s+", " ")))) == 1
    cases = [(right <= left) | (bottom <= top), (sides[1] + sides[3] >= col(width)) | (sides[0] + sides[2] >= col(height)), shape, one]
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in cases])


def filter_opacities(c) -> Column:
    """Arguments of every ``opacity()`` of a filter, in order."""
    return F.transform(F.regexp_extract_all(plain(c), F.lit(rf"opacity\(\s*({NUMBER}%?)\s*\)"), F.lit(1)), share)


def filter_opacity(c) -> Column:
    """Product of a filter's opacities; 1 without any."""
    return F.aggregate(filter_opacities(c), F.lit(1.0), lambda a, x: a * x)


def blur(c) -> Column:
    """Largest ``blur()`` of a filter in pixels; 0 without any."""
    found = F.regexp_extract_all(plain(c), F.lit(rf"blur\(\s*({NUMBER})px\s*\)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(found, number)), F.lit(0.0))


def least_scale(transform) -> Column:
    """The smaller of the horizontal and vertical scale of ``matrix()`` or ``matrix3d()``; 1 for other values."""
    text = plain(transform)
    parts = F.transform(F.regexp_extract_all(F.regexp_extract(text, r"\((.*)\)", 1), F.lit(f"({EXPONENT})"), F.lit(1)), number)

    def length(*at: int) -> Column:
        return F.sqrt(reduce(lambda a, b: a + b, [F.get(parts, F.lit(i)) * F.get(parts, F.lit(i)) for i in at]))

    flat = F.least(length(0, 1), length(2, 3))
    deep = F.least(length(0, 1, 2), length(4, 5, 6))
    return F.when(F.startswith(text, F.lit("matrix3d(")), deep).when(F.startswith(text, F.lit("matrix(")), flat).otherwise(1.0)

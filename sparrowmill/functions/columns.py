"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(c: Column) -> Column:
    """Null to empty, white space around it gone, lower case."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", ""))


def swipe_direction(dx: Column, dy: Column) -> Column:
    """A tie goes to the horizontal; no movement is null."""
    return F.when((dx == 0) & (dy == 0), F.lit(None)).when(F.abs(dx) >= F.abs(dy), F.when(dx > 0, "right").otherwise("left")).otherwise(F.when(dy > 0, "down").otherwise("up"))


def event_direction(dx: Column, dy: Column) -> Column:
    """The collector's rule: a tie goes to the vertical, missing coordinates are up."""
    return F.when(dx.isNull() | dy.isNull(), "Up").when(F.abs(dy) >= F.abs(dx), F.when(dy > 0, "Down").otherwise("Up")).otherwise(F.when(dx > 0, "Right").otherwise("Left"))


def duration_seconds(c: Column, fallback: int = 7200) -> Column:
    """'2h', '120m', '7200s' or a number of seconds; anything else and what isn't positive falls back."""
    text = norm(c)
    number = F.try_to_number(F.regexp_extract(text, r"^([0-9]+)(?:h|m|s)?$", 1), F.lit("9999999999")).cast("bigint")
    unit = F.when(text.endswith("h"), 3600).when(text.endswith("m"), 60).otherwise(1)
    return F.coalesce(F.when(number > 0, number * unit), F.lit(fallback))


def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\|", "")), r"\s+"), lambda x: x != "")


def text_sim(a: Column, b: Column) -> Column:
    """Jaccard of lower-cased words without pipes; both without words are equal, one alone shares nothing."""
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def box(c: Column) -> Column:
    """Signed bounds '[l,t][r,b]' as a struct from the first two bracketed pairs, null if there are fewer."""
    pairs = F.slice(F.regexp_extract_all(c, F.lit(r"\[(-?[0-9]+),(-?[0-9]+)\]"), F.lit(0)), 1, 2)
    n = F.transform(F.regexp_extract_all(F.array_join(pairs, ""), F.lit(r"(-?[0-9]+)"), F.lit(1)), lambda x: x.cast("int"))
    return F.when(F.size(n) >= 4, F.struct(n[0].alias("l"), n[1].alias("t"), n[2].alias("r"), n[3].alias("b")))


def rounded_side(c: Column, factor: int) -> Column:
    """A side rounded half to even to a multiple of ``factor``, one multiple at least."""
    return F.greatest(F.lit(factor), (F.bround(c / factor, 0) * factor).cast("int"))


def vision_tokens(height: Column, width: Column, patch: int = 14, merge: int = 2, least: int = 3136, most: int = 1003520) -> Column:
    """Tokens of an image after both sides are fitted to the patch grid and the area to its limits."""
    f = patch * merge
    h, w = rounded_side(height, f), rounded_side(width, f)
    down, up = F.sqrt(height * width / most), F.sqrt(F.lit(least) / (height * width))
    h2 = F.when(h * w > most, F.floor(height / down / f) * f).when(h * w < least, F.ceil(height * up / f) * f).otherwise(h)
    w2 = F.when(h * w > most, F.floor(width / down / f) * f).when(h * w < least, F.ceil(width * up / f) * f).otherwise(w)
    return ((h2 / patch) * (w2 / patch) / (merge * merge)).cast("bigint")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))

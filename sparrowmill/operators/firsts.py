"""Rows kept unless an earlier kept row has one of their two signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowmill.operators.ordering import held


def either_once(rows: DataFrame, order: list[str], a: str = "a", b: str = "b", kept: DataFrame | None = None) -> DataFrame:
    """(order.., a, b) of the kept rows; a null signature equals none.

    Reading row by row, one is kept if neither of its signatures is that of a row kept before. Here all rows decide at once, again
    and again: a row that comes first of those with its ``a`` and of those with its ``b`` is kept, and then all that share a
    signature with it go. The very first of what is left is always kept, so this ends, mostly after a few rounds; each joins and
    groups by signatures, so that no task reads a session, and is written, so that lineage stays short. ``kept`` (a, b) are rows
    kept earlier, all before these: batches give what one run over all rows gives.
    """
    names = [a, b]
    first = rows.groupBy(*names).agg(F.min(F.struct(*order)).alias("place"))  # of equal pairs only the first can stay
    left = held(first.withColumn("place", F.struct("place.*", *(F.col(c) for c in names))), "firsts")

    def without(df: DataFrame, gone: DataFrame) -> DataFrame:
        for name in names:
            df = df.join(gone.where(F.col(name).isNotNull()).select(name).distinct(), name, "left_anti")
        return df.select(*names, "place")

    if kept is not None:
        left = held(without(left, kept.select(*names)), "firsts")
    found = None
    while True:
        ranked = left
        for name in names:
            least = left.where(F.col(name).isNotNull()).groupBy(name).agg(F.min("place").alias(f"first_{name}"))
            ranked = ranked.join(least, name, "left")
        ahead = [F.coalesce(F.col("place") <= F.col(f"first_{name}"), F.lit(True)) for name in names]
        won = held(ranked.where(ahead[0] & ahead[1]).select(*names, "place"), "firsts")
        found = won if found is None else found.unionByName(won)
        if won.isEmpty():
            return found.select(*(F.col("place")[c].alias(c) for c in order), *names)
        left = held(without(left, won), "firsts")

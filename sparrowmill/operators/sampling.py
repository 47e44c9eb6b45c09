"""Splits, samples and joins by key or by place."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowmill.operators.ordering import numbered, seeded


def random_split(df: DataFrame, key: str, share: float, seed: str) -> DataFrame:
    """(key, train): the first ``share`` of the rows in seeded order are for training."""
    rows = df.select(key, seeded(seed, key).alias("draw"))
    last = int(rows.count() * share)
    return numbered(rows, "draw", key).select(key, (F.col("place") <= last).alias("train"))


def first_drawn(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """The ``n`` rows that come first in seeded order; each task sends ``n`` at most."""
    return df.select(key).orderBy(seeded(seed, key), key).limit(n)


def ratio_mix(parts: dict[str, tuple[DataFrame, str, int]], seed: str) -> DataFrame:
    """(kind, k): of each kind's rows the asked number, drawn by the seed."""
    found = [first_drawn(df, key, n, seed).select(F.lit(kind).alias("kind"), F.col(key).alias("k")) for kind, (df, key, n) in parts.items()]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def shuffled_union(parts: dict[str, tuple[DataFrame, str]], seed: str) -> DataFrame:
    """(k, kind, place): all rows of all kinds in one seeded order."""
    found = [df.select(F.col(key).alias("k"), F.lit(kind).alias("kind")) for kind, (df, key) in parts.items()]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    draw = F.md5(F.concat(F.lit(f"{seed}|"), "kind", F.col("k").cast("string")))
    return numbered(out.withColumn("draw", draw), "draw", "k").drop("draw")


def round_robin(df: DataFrame, key: str, group: str, seed: str) -> DataFrame:
    """(key, place): one row of each group after the other, groups and their rows in seeded order."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(seeded(seed, key)))
    return numbered(df.select(key, seeded(seed, group).alias("draw"), turn.alias("turn")), "turn", "draw", key).select(key, "place")


def excluding(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key isn't among the first column of ``keys``; rows without a key stay."""
    known = keys.select(F.col(keys.columns[0]).alias("__key")).where("__key IS NOT NULL")
    return df.join(known, df[key] == F.col("__key"), "left_anti")


def positional_pairs(truth: DataFrame, predicted: DataFrame, order: str, value: str) -> DataFrame:
    """(row_id, gt, predict, same): rows of two tables at the same place."""
    gt = numbered(truth.select(order, F.col(value).alias("gt")), order, name="row_id").select("row_id", "gt")
    predict = numbered(predicted.select(order, F.col(value).alias("predict")), order, name="row_id").select("row_id", "predict")
    return gt.join(predict, "row_id").withColumn("same", F.col("gt") == F.col("predict"))


def routed(name: Column, pool_key: Column, pools: dict[str, Iterable[int]], default: str = "null") -> Column:
    """The pool of a row by its app; rows whose app has no name, or is in no pool, go to the default."""
    out = F.when(name.isNull() | (F.trim(name) == ""), F.lit(default))
    for pool, keys in pools.items():
        out = out.when(pool_key.isin(*keys), F.lit(pool))
    return out.otherwise(F.lit(default))


def dropped_report(df: DataFrame, value: str, key: str, limit: int) -> DataFrame:
    """Least, most, upper median and number of the values over a limit."""
    over = numbered(df.where(F.col(value) > limit).select(value, key), value, key)
    middle = over.count() // 2 + 1
    at = F.max(F.when(F.col("place") == middle, F.col(value)))
    return over.agg(F.min(value).alias("least"), F.max(value).alias("most"), at.alias("p50"), F.count("*").alias("dropped"))


def untried(allowed: DataFrame, tried: DataFrame) -> DataFrame:
    """Allowed (page, action) rows that no visit has tried; no page meets an action that it doesn't have."""
    return allowed.distinct().join(tried.distinct(), allowed.columns, "left_anti")

"""Quotas dealt to strata, two samples without overlap from one stock, and splits by app with a held-out part."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowmill.operators.ordering import held, numbered, seeded

#: rows of strata or groups up to which they are broadcast; beyond, they are joined by sort and merge
BROADCAST_ROWS = 250_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def largest_remainder(counts: DataFrame, target: int, name: str = "quota") -> DataFrame:
    """``counts`` (stratum, n) with each stratum's share of ``target``: floors first, then one more by largest fraction, equals by name."""
    total = F.sum("n").over(Window.partitionBy())  # one row for each stratum
    shared = counts.withColumn("__total", total).withColumns({"__base": F.expr(f"({target} * n) DIV __total"), "__rest": F.expr(f"({target} * n) % __total")})
    rank = F.row_number().over(Window.orderBy(F.desc("__rest"), "stratum"))
    left = F.lit(target) - F.sum("__base").over(Window.partitionBy())
    return shared.withColumns({"__rank": rank, "__left": left}).withColumn(name, F.col("__base") + F.when(F.col("__rank") <= F.col("__left"), 1).otherwise(0)).drop("__total", "__base", "__rest", "__rank", "__left")


def placed_within(df: DataFrame, by: list[str], order: list[str | Column], name: str) -> DataFrame:
    """``df`` with the place (from 1) within the groups of ``by``: places in one total order less where the group begins, so that no task holds a group."""
    rows = numbered(df, *by, *order, name="__all")
    begin = held(rows.groupBy(*by).agg((F.min("__all") - 1).alias("__begin")), "begins")
    return rows.join(_small(begin), by).withColumn(name, (F.col("__all") - F.col("__begin"))).drop("__all", "__begin")


def round_robin_within(df: DataFrame, stratum: str, group: str, key: str, seed: str, name: str = "rank") -> DataFrame:
    """``df`` with its rank in its stratum: one row of each group after the other, groups and their rows in seeded order."""
    drawn = df.withColumns({"__row": seeded(seed, key), "__group": seeded(seed, group)})
    laps = placed_within(drawn, [stratum, group], ["__row", key], "__lap")
    return placed_within(laps, [stratum], ["__lap", "__group", key], name).drop("__row", "__group", "__lap")


def joint_samples(
    stock: DataFrame, key: str, stratum: str, group: str, targets: tuple[int, int], seed: str, first: tuple[str, str] | None = None, extra: tuple[str, DataFrame, int] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Two samples without a common row, and a report.

    Each target is dealt to the strata by largest remainder; in the order of ``round_robin_within`` a stratum's first rows go to
    sample 1, the next to sample 2. ``first`` (stratum, flag column): in that stratum half of the flagged rows go to either sample
    ahead of others, as far as both quotas allow; other flagged rows stay out. ``extra`` (stratum, rows, n): ``n`` of those rows for
    each sample take places of that stratum's quota. The samples are (key, stratum, sample, origin); the report (stratum, sample,
    quota, taken, short) says what is missing, nothing is filled up from elsewhere.
    """
    flag = F.coalesce(F.col(first[1]), F.lit(False)) & (F.col(stratum) == first[0]) if first else F.lit(False)
    rows = stock.select(F.col(key).alias("key"), F.col(stratum).alias("stratum"), F.col(group).alias("group"), flag.alias("flagged"))
    sized = rows.groupBy("stratum").agg(F.count("*").alias("n"), F.count_if("flagged").alias("flagged"))
    quotas = sized
    for k, target in enumerate(targets, 1):
        quotas = quotas.join(largest_remainder(sized.select("stratum", "n"), target, f"q{k}").select("stratum", f"q{k}"), "stratum")
    ahead = F.least(F.expr("flagged DIV 2"), F.col("q1"), F.col("q2"))
    given = F.when(F.col("stratum") == extra[0], extra[2]).otherwise(0) if extra else F.lit(0)
    quotas = held(quotas.withColumns({"ahead": ahead, "given": given}).drop("n", "flagged"), "quotas")
    ranked = round_robin_within(rows.withColumn("part", F.concat_ws("|", "stratum", "flagged")), "part", "group", "key", seed)
    joined = ranked.join(_small(quotas), "stratum")
    own = lambda k: F.greatest(F.lit(0), F.col(f"q{k}") - F.col("ahead") - F.col("given"))
    end1 = F.when(F.col("flagged"), F.col("ahead")).otherwise(own(1))
    end2 = F.when(F.col("flagged"), 2 * F.col("ahead")).otherwise(own(1) + own(2))
    sample = F.when(F.col("rank") <= end1, 1).when(F.col("rank") <= end2, 2)
    found = joined.select("key", "stratum", sample.alias("sample"), F.when(F.col("flagged"), "first").otherwise("stock").alias("origin")).where("sample IS NOT NULL")
    if extra:
        name, more, n = extra
        drawn = numbered(more.select(F.col(key).alias("key")), seeded(seed, "key"), "key").where(F.col("place") <= 2 * n)
        found = found.unionByName(drawn.select("key", F.lit(name).alias("stratum"), F.when(F.col("place") <= n, 1).otherwise(2).alias("sample"), F.lit("extra").alias("origin")))
    found = held(found, "samples")
    asked = quotas.select("stratum", F.explode(F.array(*(F.struct(F.lit(k).alias("sample"), F.col(f"q{k}").alias("quota")) for k in (1, 2)))).alias("x")).select("stratum", "x.*")
    taken = found.groupBy("stratum", "sample").agg(F.count("*").alias("taken"))
    report = asked.join(taken, ["stratum", "sample"], "left").fillna(0, ["taken"]).withColumn("short", F.greatest(F.lit(0), F.col("quota") - F.col("taken")))
    return found, report


def stratified(df: DataFrame, target: int, seed: str) -> DataFrame:
    """(key, stratum) of ``target`` rows of ``df`` (key, stratum) by largest remainder, all of them where there are no more."""
    sized = held(df.groupBy("stratum").agg(F.count("*").alias("n")), "strata")
    if (sized.agg(F.sum("n")).first()[0] or 0) <= target:
        return df.select("key", "stratum")
    ranked = placed_within(df, ["stratum"], [seeded(seed, "key"), "key"], "rank")
    return ranked.join(_small(largest_remainder(sized, target).select("stratum", "quota")), "stratum").where("rank <= quota").select("key", "stratum")


def drawn(df: DataFrame, target: int, seed: str) -> DataFrame:
    """(key, stratum) of the ``target`` first rows in seeded order."""
    return numbered(df.select("key", "stratum"), seeded(seed, "key"), "key").where(F.col("place") <= target).select("key", "stratum")


def in_and_out(rows: DataFrame, inside: DataFrame, outside: DataFrame, sizes: tuple[int, int, int], seed: int, by_stratum: bool, nulls: bool = True) -> DataFrame:
    """(key, split): training rows, a test of apps that training knows and a test of apps that it doesn't.

    ``rows`` are (key, app, stratum), ``inside`` and ``outside`` lists of apps (app), ``sizes`` those of train, test_id and test_ood.
    The test of known apps is drawn first, by ``seed`` + 1; training takes the rest of them and, with ``nulls``, rows without an app
    or of an app in neither list. Draws follow the strata if ``by_stratum``.
    """
    bare = F.nullif(F.trim("app"), F.lit(""))
    listed = inside.select(F.trim("app").alias("__app"), F.lit("id").alias("pool")).unionByName(outside.select(F.trim("app").alias("__app"), F.lit("ood").alias("pool"))).groupBy("__app").agg(F.min("pool").alias("pool"))
    routed = held(rows.select("key", "stratum", bare.alias("__app")).join(_small(listed), "__app", "left").select("key", "stratum", F.coalesce("pool", F.lit("null")).alias("pool")), "routed")
    pick = stratified if by_stratum else drawn
    pool = lambda *names: routed.where(F.col("pool").isin(*names)).select("key", "stratum")
    test_id = held(pick(pool("id"), sizes[1], str(seed + 1)), "test-id")
    rest = pool("id").join(test_id.select("key"), "key", "left_anti")
    train = pick(rest.unionByName(pool("null")) if nulls else rest, sizes[0], str(seed))
    test_ood = pick(pool("ood"), sizes[2], str(seed + 2))
    named = [df.select("key", F.lit(name).alias("split")) for name, df in (("train", train), ("test_id", test_id), ("test_ood", test_ood))]
    return reduce(DataFrame.unionByName, named)


def mirrored(members: DataFrame, sources: dict[str, DataFrame], side: Column, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Members (in an experiment's coordinates) with the bodies of the source that ``side`` names, and per source how many were found.

    A source whose keys repeat raises an error that names how many do, as either body could be meant. Members keep their own
    columns; those that the source doesn't have drop out and are counted.
    """
    routed = members.withColumn("side", side)
    found = []
    for name, source in sources.items():
        repeated = source.groupBy(*keys).count().where("count > 1").count()
        if repeated:
            raise ValueError(f"{repeated} keys of {name} repeat")
        body = source.select(*keys, F.struct(*(c for c in source.columns if c not in keys)).alias("body"), F.lit(True).alias("matched"))
        found.append(routed.where(F.col("side") == name).join(body, keys, "left"))
    both = held(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found), "mirrored")
    counts = both.groupBy("side").agg(F.count("*").alias("members"), F.count_if(F.coalesce("matched", F.lit(False))).alias("matched"))
    return both.where("matched").drop("matched"), counts.withColumn("dropped", F.col("members") - F.col("matched"))

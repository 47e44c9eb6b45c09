"""What ledgers, logs and sessions are asked for again and again, as functions with their columns as parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: texts that mean yes in a catalog
YES = ("true", "1", "yes", "y", "t")


def said_yes(text: Column) -> Column:
    return F.lower(F.trim(text)).isin(*YES)


def latest(df: DataFrame, keys: list[str], order: str, **columns: str) -> DataFrame:
    """One row for each key with columns (new name = old name) of its row of the largest order."""
    return df.groupBy(*keys).agg(*(F.max_by(old, order).alias(new) for new, old in columns.items()))


def earliest(df: DataFrame, keys: list[str], order: str | Column, **columns: str) -> DataFrame:
    """As ``latest`` with the smallest order."""
    return df.groupBy(*keys).agg(*(F.min_by(old, order).alias(new) for new, old in columns.items()))


def _session(session: str, *order: str):
    return Window.partitionBy(session).orderBy(*order)


def with_next(df: DataFrame, session: str, order: list[str], column: str, name: str, last: int | None = None) -> DataFrame:
    """``df`` with a column's value in the session's next row; ``last`` stands in the last one."""
    return df.withColumn(name, F.lead(column, 1, last).over(_session(session, *order)))


def with_previous(df: DataFrame, session: str, order: list[str], column: str, name: str) -> DataFrame:
    return df.withColumn(name, F.lag(column).over(_session(session, *order)))


def replayed(df: DataFrame, session: str, order: list[str], keep: Column) -> DataFrame:
    """The rows to keep with their place in the session."""
    return df.where(keep).withColumn("place", F.row_number().over(_session(session, *order)))


def moves(df: DataFrame, session: str, order: list[str], page: str) -> DataFrame:
    """``df`` with from_page and to_page where a session goes from one page to another."""
    told = with_previous(df, session, order, page, "from_page").withColumn("to_page", F.col(page))
    return told.where("from_page IS NOT NULL AND from_page <> to_page")


def edges(moved: DataFrame, seq: str, info: str) -> DataFrame:
    """(from_page, to_page, n, first_seen, element_info); the first move describes an edge."""
    return moved.groupBy("from_page", "to_page").agg(F.count("*").alias("n"), F.min(seq).alias("first_seen"), F.min_by(info, seq).alias("element_info"))


def out_degrees(found: DataFrame) -> DataFrame:
    return found.groupBy("from_page").agg(F.count("*").alias("out_degree"), F.max("n").alias("most"))


def nodes(df: DataFrame, page: str, seq: str, session: str) -> DataFrame:
    return df.groupBy(F.col(page).alias("page_key")).agg(F.count("*").alias("visit_count"), F.min(seq).alias("first_seen"), F.count_distinct(session).alias("observation_count"))


def share_over(df: DataFrame, by: str, value: str, limit: float, at_least: float) -> DataFrame:
    """Per group the share of values over a limit, and whether that is a sign of texts cut short."""
    share = F.avg(F.when(F.col(value) > limit, 1.0).otherwise(0.0))
    return df.groupBy(by).agg(share.alias("share"), (share >= at_least).alias("truncated"))


def alignment(df: DataFrame, row: str, setting: str) -> DataFrame:
    """Per row the settings that have it, how their counts spread, and whether all settings of the table have it equally often."""
    counted = df.groupBy(F.col(row).alias("row_id"), setting).agg(F.count("*").alias("n"))
    whole = counted.agg(F.count_distinct(setting).alias("k"))  # one row
    spread = (F.max("n") - F.min("n")).alias("spread")
    each = counted.groupBy("row_id").agg(F.count("*").alias("settings"), spread).crossJoin(F.broadcast(whole))
    return each.select("row_id", "settings", "spread", ((F.col("settings") == F.col("k")) & (F.col("spread") == 0)).alias("aligned"))


def both_observed(df: DataFrame, session: str, order: list[str], page: str, seen: DataFrame) -> DataFrame:
    """Rows whose page and next page were both observed in their session; ``seen`` is (session, page)."""
    pairs = with_next(df, session, order, page, "__next")
    known = seen.select(F.col(session).alias("__s"), F.col(page).alias("__p")).distinct()
    for end in (page, "__next"):
        pairs = pairs.join(known, (F.col(session) == F.col("__s")) & (F.col(end) == F.col("__p")), "left_semi")
    return pairs.drop("__next")


def resolved(df: DataFrame, name: str, aliases: DataFrame, declared: DataFrame, fallback: Column) -> DataFrame:
    """``df`` with ``resolved`` (the alias's target, else the fallback) and whether that is declared; lists hold a name once."""
    known = df.join(aliases.select(F.col("name").alias(name), "target").dropDuplicates([name]), name, "left").withColumn("resolved", F.coalesce("target", fallback)).drop("target")
    listed = declared.select(F.col("name").alias("resolved")).distinct().withColumn("declared", F.lit(True))
    return known.join(listed, "resolved", "left").fillna(False, ["declared"])


def with_metadata(df: DataFrame, facts: DataFrame, key: str, **defaults: str | int) -> DataFrame:
    """``df`` with columns of ``facts`` by key, and defaults where there are none."""
    return df.join(facts.select(key, *defaults), key, "left").fillna(defaults)


def occurrences(df: DataFrame, by: list[str], order: list[str], name: str = "occurrence", start: int = 0) -> DataFrame:
    """``df`` with how many equal rows stand before each, counted from ``start``."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1 + start)


def rounded_means(df: DataFrame, by: str, metrics: dict[str, Column]) -> DataFrame:
    """Per group the mean of each metric where it is defined, four decimals, 0 where it never is."""
    return df.groupBy(by).agg(*(F.coalesce(F.round(F.avg(c), 4), F.lit(0)).alias(n) for n, c in metrics.items()))


def merged(a: DataFrame, b: DataFrame, key: str, total: str = "total") -> DataFrame:
    """Aggregates of two runs by key, with one total and whether the two totals clash."""
    both = a.withColumnRenamed(total, "__a").join(b.withColumnRenamed(total, "__b"), key, "full")
    clash = F.col("__a").isNotNull() & F.col("__b").isNotNull() & (F.col("__a") != F.col("__b"))
    return both.withColumns({total: F.coalesce("__a", "__b"), "clash": clash}).drop("__a", "__b")


def counters(df: DataFrame, by: str, column: str, **values: str) -> DataFrame:
    """Per group how often each value occurs (new name = value), zeros included."""
    return df.groupBy(by).agg(*(F.count_if(F.col(column) == v).alias(n) for n, v in values.items()))


def majority(df: DataFrame, by: str, column: str, seq: str, unless: str) -> DataFrame:
    """Per group the most frequent value, of equals the first; ``unless`` only where there is no other."""
    counted = df.groupBy(by, column).agg(F.count("*").alias("n"), F.min(seq).alias("first_step"))
    rank = F.struct((F.col(column) == unless).cast("int"), -F.col("n"), F.col("first_step"))
    return counted.groupBy(by).agg(F.min_by(F.struct(column, "n"), rank).alias("x")).select(by, F.col(f"x.{column}").alias("primary_app"), "x.n")


def upserted(rows: DataFrame, key: str) -> DataFrame:
    """A ledger's entries (key, first_seen, last_seen, reason) by key: first and last sighting, and the reason of the last."""
    return rows.groupBy(key).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max_by("reason", "last_seen").alias("reason"))


def constant(df: DataFrame, by: str, column: str) -> DataFrame:
    kinds = F.count_distinct(column)
    return df.groupBy(by).agg(kinds.alias("kinds"), (kinds == 1).alias("constant"))


def costs(df: DataFrame, by: str, model: str, units_in: Column, units_out: Column, prices: dict[str, tuple[float, float]]) -> DataFrame:
    """Cost per group at prices for a million units in and out; a model without a price is free."""

    def price(k: int) -> Column:
        out = F.lit(0.0)
        for name, pair in prices.items():
            out = F.when(F.col(model) == name, float(pair[k])).otherwise(out)
        return out

    return df.groupBy(by).agg((F.sum(units_in * price(0) + units_out * price(1)) / 1e6).alias("cost"))


def streaks(df: DataFrame, session: str, order: list[str], page: str) -> DataFrame:
    """``df`` with ``streak``, the length so far of the run of one page."""
    before = F.lag(page).over(_session(session, *order))
    told = df.withColumn("__new", F.coalesce((F.col(page) != before).cast("int"), F.lit(1)))
    told = told.withColumn("__run", F.sum("__new").over(_session(session, *order).rowsBetween(Window.unboundedPreceding, 0)))
    return told.withColumn("streak", F.row_number().over(Window.partitionBy(session, "__run").orderBy(*order))).drop("__new", "__run")


def idle(df: DataFrame, session: str, order: str, page: str, limit: int) -> DataFrame:
    """``df`` with the steps since the session's last new page, and whether that is reason to stop."""
    step, seen = F.row_number().over(_session(session, order)), F.row_number().over(Window.partitionBy(session, page).orderBy(order))
    told = df.withColumns({"__step": step, "__seen": seen})
    last = F.max(F.when(F.col("__seen") == 1, F.col("__step"))).over(_session(session, "__step").rowsBetween(Window.unboundedPreceding, 0))
    told = told.withColumn("idle", F.col("__step") - last)
    return told.withColumn("stop", F.col("idle") >= limit).drop("__step", "__seen")


def held_out(counts: DataFrame, name: str, share: float, seed: str) -> DataFrame:
    """``counts`` (name, n) with ``ood``: whole groups in seeded order until they hold the share of all rows."""
    order = Window.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(name).cast("string"))), name)  # one row for each group
    ahead = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return counts.withColumns({"__ahead": ahead, "__total": F.sum("n").over(Window.partitionBy())}).withColumn("ood", F.col("__ahead") < F.col("__total") * share).drop("__ahead", "__total")


def reconciled(a: DataFrame, b: DataFrame) -> DataFrame:
    """(k, state) of two tables (k, v): orphan, missing, same or diff."""
    both = a.select("k", F.col("v").alias("x"), F.lit(1).alias("in_a")).join(b.select("k", F.col("v").alias("y"), F.lit(1).alias("in_b")), "k", "full")
    state = F.when(F.col("in_a").isNull(), "orphan").when(F.col("in_b").isNull(), "missing").when(F.col("x") == F.col("y"), "same").otherwise("diff")
    return both.select("k", state.alias("state"))


def sides(a: DataFrame, b: DataFrame, line: str) -> DataFrame:
    """(line, side): lines of two sets, left, right or both."""
    told = a.select(line).distinct().withColumn("__a", F.lit(1)).join(b.select(line).distinct().withColumn("__b", F.lit(1)), line, "full")
    return told.select(line, F.when(F.col("__b").isNull(), "left").when(F.col("__a").isNull(), "right").otherwise("both").alias("side"))


def drained(df: DataFrame, session: str, order: str, control: Column) -> DataFrame:
    """Per run of a session that a control signal begins: its last signal and how many there were."""
    run = F.sum(control.cast("int")).over(_session(session, order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("run", run).groupBy(session, "run").agg(F.max(order).alias("last_event"), F.count("*").alias("drained"))


def timed_out(df: DataFrame, session: str, time: str, order: list[str], seconds: int) -> DataFrame:
    """``df`` with whether more than ``seconds`` have gone by since the session's row before."""
    before = F.lag(time).over(_session(session, *order))
    late = F.col(time) > F.timestamp_add("SECOND", F.lit(seconds), before)
    return df.withColumn("timed_out", F.coalesce(late, F.lit(False)))


def once_in_a_row(df: DataFrame, session: str, order: list[str], kind: str, value: str) -> DataFrame:
    """Rows of a kind that don't follow one of that kind."""
    told = with_previous(df, session, order, kind, "__before")
    return told.where((F.col(kind) == value) & ~F.col("__before").eqNullSafe(F.lit(value))).drop("__before")


def first_of(options: list[tuple[Column, str]], default: str) -> Column:
    """The name of the first layer whose condition holds."""
    return reduce(lambda out, o: F.when(o[0], o[1]).otherwise(out), reversed(options), F.lit(default))


def matrix(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts with a row for each ``row`` and a column for each value; null where a cell has none."""
    counted = df.groupBy(row, column).agg(F.count("*").alias("n"))
    return counted.groupBy(row).agg(*(F.max(F.when(F.col(column) == v, F.col("n"))).alias(v) for v in values))


def known_or(column: Column, names: tuple[str, ...], default: str) -> Column:
    """A name in capitals if it is one of those known, else the default."""
    bare = F.upper(F.trim(column))
    return F.when(bare.isin(*names), bare).otherwise(default)

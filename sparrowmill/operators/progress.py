"""What a session's stream of visits tells as it goes: coverage, repeats with resets, steadiness, the best next candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowmill.operators.graph import by_session


def running_coverage(df: DataFrame, session: str, order: str, name: str, declared: tuple[str, ...] = (), own: Column | None = None) -> DataFrame:
    """(session, order, visited, total, coverage) after each visit.

    Without ``own`` only declared names count, and the total is their number. With it every name counts, and the total grows
    by each new name that is the session's own. Coverage is 1 at most and has four decimals.
    """
    known = F.col(name).isin(*declared) if declared else F.lit(False)
    first = F.row_number().over(Window.partitionBy(session, name).orderBy(order)) == 1
    flagged = df.select(session, order, (first & (known if own is None else F.lit(True))).alias("__new"), (first & ~known & (F.lit(False) if own is None else own)).alias("__grows"))
    so_far = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    count = lambda c: F.count_if(c).over(so_far)
    rows = flagged.select(session, order, count(F.col("__new")).alias("visited"), (F.lit(len(declared)) + count(F.col("__grows"))).alias("total"))
    ratio = F.least(F.lit(1.0), F.col("visited") / F.greatest(F.col("total"), F.lit(1)))
    return rows.withColumn("coverage", F.round(ratio, 4))


def repeats(df: DataFrame, session: str, order: str, page: str, *what: str, trip: int = 8) -> DataFrame:
    """(session, seq, repeats): how often a visit's (page, what) came since the last new page; at ``trip`` all counts begin anew.

    A trip resets counts of other visits too, so rows are read in order, with the counts of one session held.
    """

    def start():
        pages, counts = set(), {}

        def step(page, *key):
            if page not in pages:
                pages.add(page)
                counts.clear()
            n = counts[page, key] = counts.get((page, key), 0) + 1
            if n >= trip:
                counts.clear()
            return n

        return step

    rows = df.select(F.col(session).alias("session"), F.col(order).alias("seq"), F.col(page).alias("__page"), *what)
    return by_session(rows, ["seq"], start, "session bigint, seq bigint, value int").withColumnRenamed("value", "repeats")


def steadiness(df: DataFrame, session: str, order: str, change: str, frame: str, below: float = 0.015, run: int = 7, window: int = 10, periods: tuple[int, ...] = (1, 2, 3), times: int = 3) -> DataFrame:
    """(session, order, stable, oscillates) of frames.

    Stable: the last ``run`` changes are all below the limit. Oscillates: among the last ``window`` frames, the last
    ``period * times`` repeat with one of the periods.
    """
    by = Window.partitionBy(session).orderBy(order)
    last = by.rowsBetween(1 - run, 0)
    stable = (F.count(change).over(last) == run) & (F.max(change).over(last) < below)
    seen = F.collect_list(F.coalesce(F.col(frame).cast("string"), F.lit(""))).over(by.rowsBetween(1 - window, 0))  # at most ``window`` entries
    out = df.select(session, order, F.coalesce(stable, F.lit(False)).alias("stable"), seen.alias("__seen"))

    def swings(period: int) -> Column:
        n = period * times
        if n > window:
            return F.lit(False)
        tail = F.slice("__seen", -n, n)
        same = F.forall(F.sequence(F.lit(0), F.lit(n - period - 1)), lambda k: F.get(tail, k) == F.get(tail, k + period))
        return F.when(F.size("__seen") >= n, same).otherwise(False)

    hit = swings(periods[0])
    for p in periods[1:]:
        hit = hit | swings(p)
    return out.select(session, order, "stable", hit.alias("oscillates"))


def best_candidates(df: DataFrame, group: str, candidate: str, scores: list[Column], seed: str = "0") -> DataFrame:
    """(group, candidate): the one with the largest scores, the first score counting most; equals fall by the md5 of seed and candidate."""
    draw = F.md5(F.concat(F.lit(f"{seed}|"), F.col(candidate).cast("string")))
    return df.groupBy(group).agg(F.max_by(candidate, F.struct(*scores, draw)).alias(candidate))

"""Graph and stateful operators over event streams."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparrowmill.operators.ordering import held


def page_edges(events: DataFrame) -> DataFrame:
    """Distinct (src, dst) of consecutive pages of a session, without loops."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    moves = events.select(F.lag("event_type").over(order).alias("src"), F.col("event_type").alias("dst"))
    return moves.where("src IS NOT NULL AND src <> dst").distinct()


def hop_distances(edges: DataFrame, start: str, limit: int | None = None) -> DataFrame:
    """(page, hops) of all pages reached from ``start`` by a frontier join; visited pages leave by an anti-join.

    Each step is written below the session's checkpoint folder and read again, so lineage doesn't grow. With a
    ``limit``, an error tells that pages beyond it remain.
    """
    spark = edges.sparkSession
    edges = held(edges.select("src", "dst").distinct(), "edges")
    reached = front = spark.createDataFrame([(start, 0)], "page string, hops int")
    hop = 0
    while True:
        hop += 1
        new = edges.join(front, edges.src == front.page).select(F.col("dst").alias("page")).distinct().join(reached.select("page"), "page", "left_anti")
        front = held(new.withColumn("hops", F.lit(hop)), "hops")
        if front.isEmpty():
            return reached
        if limit is not None and hop > limit:
            raise ValueError(f"pages beyond {limit} hops from {start}")
        reached = reached.unionByName(front)


def by_session(rows: DataFrame, order: list[str], start: Callable[[], Callable[..., int | None]], schema: str) -> DataFrame:
    """(session, seq, value) of the rows for which a session's step gives a value, read as a stream in order: only the state of one session is held."""

    def run(batches):
        at, step = object(), None
        for batch in batches:
            sessions, others = batch.column(0).to_pylist(), [c.to_pylist() for c in batch.columns[2:]]
            keep, values = [], []
            for k, (session, *row) in enumerate(zip(sessions, *others, strict=True)):
                if step is None or session != at:
                    at, step = session, start()
                value = step(*row)
                if value is not None:
                    keep.append(k)
                    values.append(value)
            took = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(took), batch.column(1).take(took), pa.array(values, pa.int32())], ["session", "seq", "value"])

    rows = rows.withColumns({c: F.col(c).cast("bigint") for c in ("session", "seq")})
    sorted_rows = rows.repartition("session").sortWithinPartitions("session", *(F.col(c).asc_nulls_last() for c in order))
    return sorted_rows.mapInArrow(run, schema)


def matched_pages(lines: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Greedy page identity per session: the first page whose lines are similar enough, else a new one (session, seq, lines)."""

    def start():
        pages: list[frozenset] = []
        known: dict[frozenset, int] = {}  # equal lines meet the same page again

        def step(found):
            own = frozenset(found)
            if own not in known:
                for k, other in enumerate(pages):
                    if (len(own & other) / len(own | other) if own | other else 1.0) >= threshold:
                        break
                else:
                    k = len(pages)
                    pages.append(own)
                known[own] = k
            return known[own]

        return step

    return by_session(lines.select("session", "seq", "lines"), ["seq"], start, "session bigint, seq bigint, value int").withColumnRenamed("value", "page_key")

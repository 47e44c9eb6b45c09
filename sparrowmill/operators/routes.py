"""Moves between pages: where each action leads now, shortest routes, and the next untried action to go for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowmill.operators.ordering import held, seeded

STEPS = "array<struct<page:string,signature:string,action:string>>"


def latest_edges(moves: DataFrame) -> DataFrame:
    """(src, dst, n_actions, signature, action) of moves (src, signature, action, dst, seq).

    An action leads where it was last seen to lead; one that stays on its page makes no edge. The named action is the first
    of the edge's in the order of signature and action.
    """
    now = moves.where("src IS NOT NULL AND dst IS NOT NULL").groupBy("src", "signature", "action").agg(F.max_by("dst", "seq").alias("dst"))
    first = F.min(F.struct("signature", "action")).alias("first")
    return now.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n_actions"), first).select("src", "dst", "n_actions", "first.*")


def shortest_routes(edges: DataFrame, start: str) -> DataFrame:
    """(page, hops, steps) of all pages reached from ``start``: of the shortest routes, the first in the order of their steps.

    One join of the frontier with the edges per hop; each frontier is written, so lineage doesn't grow.
    """
    spark = edges.sparkSession
    edges = held(edges.select("src", "dst", "signature", "action"), "edges")
    front = held(spark.createDataFrame([(start,)], "page string").select("page", F.lit(0).alias("hops"), F.array().cast(STEPS).alias("steps")), "routes")
    reached = front
    while True:
        step = F.struct(F.col("src").alias("page"), "signature", "action")
        steps = F.min(F.concat("steps", F.array(step))).alias("steps")
        new = edges.join(front, edges.src == front.page).groupBy("dst", (F.col("hops") + 1).alias("hops")).agg(steps)
        front = held(new.withColumnRenamed("dst", "page").join(reached.select("page"), "page", "left_anti"), "routes")
        if front.isEmpty():
            return reached
        reached = reached.unionByName(front)


def planned(routes: DataFrame, untried: DataFrame, strategy: str = "greedy", depths: DataFrame | None = None, seed: str = "0") -> DataFrame:
    """One row (page, signature, action, steps): the untried action to go for, with the way there; none if no page of one is reached.

    ``greedy`` takes the shortest way, ``bfs`` and ``dfs`` the page least and most deep (page, hops of ``depths``), then the
    shortest way; pages of unknown depth come last. Ties fall by the seed.
    """
    found = untried.join(routes.select("page", "steps"), "page")
    order = [F.size("steps"), seeded(seed, "page", "signature", "action"), "page", "signature", "action"]
    if strategy in ("bfs", "dfs") and depths is not None:
        found = found.join(depths.select("page", F.col("hops").alias("__depth")), "page", "left")
        order.insert(0, F.asc_nulls_last("__depth") if strategy == "bfs" else F.desc_nulls_last("__depth"))
    own = F.array(F.struct("page", "signature", "action"))
    return found.orderBy(*order).limit(1).select("page", "signature", "action", F.concat("steps", own).alias("steps"))

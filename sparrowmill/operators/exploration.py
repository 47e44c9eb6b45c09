"""What is left to try on known pages, and what the structures tried so far led to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: fixed values: an action that is offered only where the other one can't be tried any more
FOLLOW_UP, FIRST = "long_touch", "touch"
KEY = ["page", "signature", "action"]


def unexplored(states: DataFrame, explored: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """(page, signature, action) of the actions that elements of ``states`` (page, signature, actions array<string>) allow and that
    neither were explored on that page nor failed as a way there.

    A long touch seldom does more than a touch, so it is offered only once the element's touch was explored or failed.
    """
    offered = states.select("page", "signature", F.explode("actions").alias("action")).distinct()
    blocked = explored.select(*KEY) if failed is None else explored.select(*KEY).unionByName(failed.select(*KEY))
    blocked = blocked.distinct()
    touched = blocked.where(F.col("action") == FIRST).select("page", "signature")
    left = offered.join(blocked, KEY, "left_anti")
    return left.where(F.col("action") != FOLLOW_UP).unionByName(left.where(F.col("action") == FOLLOW_UP).join(touched, ["page", "signature"], "left_semi"))


def novel(actions: DataFrame, explored: DataFrame) -> DataFrame:
    """``actions`` with whether their signature and action were explored on any page; failed ways don't count."""
    known = explored.select("signature", "action").distinct().withColumn("explored_anywhere", F.lit(True))
    return actions.join(known, ["signature", "action"], "left").fillna(False, ["explored_anywhere"])


def effects(transitions: DataFrame) -> DataFrame:
    """(page, struct_key, action, fired, destinations): how often elements of one structure were tried on a page and how many pages that led to.

    ``transitions`` are (page, struct_key, action, to_page); elements without a structure don't count.
    """
    known = transitions.where(F.coalesce("struct_key", F.lit("")) != "").where("page IS NOT NULL AND to_page IS NOT NULL")
    return known.groupBy("page", "struct_key", "action").agg(F.count("*").alias("fired"), F.count_distinct("to_page").alias("destinations"))


def effect_summary(found: DataFrame, threshold: int = 3) -> DataFrame:
    """One row: groups, and those that were fired more often than ``threshold`` and only ever led to one page."""
    return found.agg(F.count("*").alias("groups"), F.count_if((F.col("fired") > threshold) & (F.col("destinations") == 1)).alias("would_saturate"))


def busiest(found: DataFrame, top: int = 10) -> DataFrame:
    """The groups fired most often."""
    return found.orderBy(F.desc("fired"), "page", "struct_key", "action").limit(top)

"""Elements of screens packed for display."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowmill.functions import actions as A
from sparrowmill.functions import columns as C
from sparrowmill.operators import trees


def packed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, screen, items): the extent of each row's markup and its elements in order, each with its depth, slot and box.

    The extent (width, height) is the largest right and lower bound, null where none is positive. An element whose bounds can't be
    read keeps them as ``unread``. The rows of one screen meet in one task, as their list is the result; markup without an element
    has no row.
    """
    found = trees.elements(df, key, text).withColumn("box", C.box(F.col("bounds")))
    item = F.struct("pos", "tag", "text", "depth", A.slot(F.col("bounds"), F.col("index").cast("string")).alias("slot"), "box", F.when(F.col("box").isNull(), F.nullif("bounds", F.lit(""))).alias("unread"))
    right, low = F.max("box.r"), F.max("box.b")
    screen = F.when((right > 0) & (low > 0), F.struct(right.alias("width"), low.alias("height")))
    return found.groupBy("key").agg(screen.alias("screen"), F.array_sort(F.collect_list(item)).alias("items"))

"""Numbers in a total order without moving a table through one task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below ``spark.checkpoint.dir`` and read again; on a local master without it, below a temp folder."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by its keys to as many tasks as shuffles have, whatever its size: for rows that take long for their bytes."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *keys)


def numbered(df: DataFrame, *order: str | Column, name: str = "place") -> DataFrame:
    """``df`` with its place (from 1) in a total order.

    Rows are dealt to ranges and sorted there; each row's number within its range is written, as another sampling of the
    ranges would deal rows otherwise. Only the counts of the ranges, one row each, meet in one task and are broadcast.
    """
    at = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = held(dealt.withColumn("__range", F.shiftright(at, 33)).withColumn("__at", at.bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    counts = rows.groupBy("__range").agg(F.count("*").alias("__n"))
    ahead = counts.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__ahead"))
    return rows.join(F.broadcast(ahead), "__range").withColumn(name, F.col("__ahead") + F.col("__at") + 1).drop("__range", "__at", "__ahead")


def seeded(seed: str, *keys: str) -> Column:
    """A draw that any engine repeats: the md5 of seed and keys."""
    return F.md5(F.concat(F.lit(f"{seed}|"), *(F.col(k).cast("string") for k in keys)))

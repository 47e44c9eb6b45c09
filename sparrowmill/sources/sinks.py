"""Sinks: JSON lines, write-once and replacing outputs, appended series, keyed registries, observations as files by page."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowmill.operators.ordering import numbered


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a job has written all of a folder (its _SUCCESS file is there)."""
    return exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def jsonl(df: DataFrame, path: str, order: str | None = None, mode: str = "errorifexists") -> None:
    """JSON lines in the order of a column: files in name order hold ascending ranges of it. Null fields are left out."""
    out = df.repartitionByRange(F.col(order)).sortWithinPartitions(order) if order else df
    out.write.mode(mode).option("ignoreNullFields", True).json(path)


def once(df: DataFrame, path: str) -> bool:
    """Write JSON lines unless a finished folder is there; False if nothing was to do. What a lost job left is replaced."""
    if finished(df.sparkSession, path):
        return False
    df.write.mode("overwrite").json(path)
    return True


def replaced(df: DataFrame, path: str) -> None:
    """Replace a folder that ``df`` may itself read: written beside it first, then put in its place by two renames.

    Readers that begin between the two find no folder; on a store without atomic renames, write to a table format instead.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    fresh, old = (f"{path}.{kind}-{uuid.uuid4().hex[:8]}" for kind in ("new", "old"))
    df.write.json(fresh)
    fs, at = _fs(spark, path)
    to = spark._jvm.org.apache.hadoop.fs.Path
    if fs.exists(at):
        fs.rename(at, to(old))
    fs.rename(to(fresh), at)
    fs.delete(to(old), True)


def series(df: DataFrame, path: str, order: str) -> None:
    """Append rows of a time series as CSV with a header, ordered within each file."""
    df.sortWithinPartitions(order).write.mode("append").option("header", True).csv(path)


def upserted(registry: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; an entry takes the place of the registry's row. Among equal keys of one side any stays whole."""
    new = entries.dropDuplicates([key])
    return registry.dropDuplicates([key]).join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def percentages(metrics: DataFrame) -> DataFrame:
    """Metric columns times 100 with four decimals; other columns stay."""
    kinds = dict(metrics.dtypes)
    return metrics.select(*(F.round(F.col(c) * 100, 4).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in metrics.columns))


def metrics(df: DataFrame, path: str) -> bool:
    """Metrics as JSON lines, replaced each time, and beside them percentages that are written only once."""
    replaced(df, f"{path.rstrip('/')}/metrics")
    return once(percentages(df), f"{path.rstrip('/')}/predict_results")


def observations(df: DataFrame, path: str, page: str = "page_key", number: str = "observation_num") -> None:
    """Forms of screens below page and observation; the rows of one page go to one folder."""
    df.write.mode("append").partitionBy(page, number).parquet(path)


def sidecar(df: DataFrame, path: str, counts: dict[str, Column]) -> DataFrame:
    """One row of counts and settings about a written dataset, put beside it as JSON; returned too."""
    out = df.agg(*(c.alias(n) for n, c in counts.items()))
    replaced(out, f"{path.rstrip('/')}/_meta")
    return out


def event_log(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream of events as JSON lines; each event is written once, also after a restart from the checkpoint."""
    return stream.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).start()


def numbered_frames(events: DataFrame, log: DataFrame, order: str, frame: str = "frame_index") -> DataFrame:
    """New events with frames that go on from the log's largest (from 0 for an empty one), in order."""
    last = log.agg(F.max(frame)).first()[0]
    return numbered(events, order, name="__place").withColumn(frame, F.col("__place") + F.lit(-1 if last is None else last)).drop("__place")

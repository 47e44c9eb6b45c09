"""Exact dedup through a persistent digest index.

The index is a Spark table bucketed and sorted by digest. A batch is hashed, grouped by digest (partial
aggregation first, so that a group of copies leaves each map task as one row), deduplicated against the index by a
sort-merge anti-join, and what is new is appended, as are the row counts of digests met again. Only (doc_id, 32-byte digest)
rows are ever shuffled, never texts. Rows meet their group by sort and merge, but for the largest groups, of over one
hundred-thousandth of the rows: there are 100,000 of these at most, which are broadcast, so that no task gets such a group.

Defined cases: a null text counts as empty; texts are equal when identical after lower-casing A-Z only; of equal texts
in a batch the largest doc_id stays (null ids lose to any id); a digest that is already indexed keeps its indexed id;
rows that repeat a doc_id with the same text are one document and are reported alike; a batch that comes again under its name
counts once; an empty batch gives no rows.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowmill.llm.scratch import Scratch, small_side

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


class DigestIndex:
    """A table (digest, keep_id, n_rows, batch) bucketed and sorted by digest."""

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None):
        self.spark, self.table = spark, table
        self.buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        if not spark.catalog.tableExists(table):
            empty = spark.createDataFrame([], "digest binary, keep_id bigint, n_rows bigint, batch string")
            self._write(empty, "errorifexists")

    def _write(self, df: DataFrame, mode: str) -> None:
        df.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode(mode).saveAsTable(self.table)

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, groups: DataFrame, batch: str) -> None:
        """Add the groups (digest, keep_id, n_rows) whose digest isn't indexed yet, and the counts of the others under the id that is.

        What the index already holds of this batch isn't added again, so a batch may be given again after a failure.
        """
        known = self.rows().groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.bool_or(F.col("batch") == batch).alias("counted"))
        new = groups.hint("merge").join(self.rows().select("digest"), "digest", "left_anti").select("digest", "keep_id", "n_rows")
        again = groups.select("digest", "n_rows").hint("merge").join(known.where("NOT counted"), "digest").select("digest", "keep_id", "n_rows")
        self._write(new.unionByName(again).withColumn("batch", F.lit(batch)).repartition(self.buckets, "digest"), "append")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


#: groups of more than this share of the rows are broadcast
LARGE = 100_000


def grouped(hashed: DataFrame) -> DataFrame:
    return hashed.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n_rows"))


def dedup(docs: DataFrame, index: DigestIndex, batch: str | None = None, largest_first: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256; appends the batch to ``index``.

    ``group_size`` counts the rows of this and all earlier batches. With ``largest_first``, ``docs`` go in as two batches, that with
    the larger half of the range of ids before the other, and are told about once both are in.
    """
    spark, batch = docs.sparkSession, batch or uuid.uuid4().hex
    scratch = Scratch(spark, "exact-dedup")
    hashed = scratch.keep(docs.select("doc_id", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest")), "digests")
    batches = {batch: hashed}
    if largest_first:
        ends = hashed.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
        larger = F.coalesce(F.col("doc_id") > (None if ends.a is None else (ends.a + ends.b) // 2), F.lit(False))
        batches = {f"{batch}-1": hashed.where(larger), f"{batch}-2": hashed.where(~larger)}
    for name, rows in batches.items():
        index.append(scratch.keep(grouped(rows), "groups"), name)
    known = index.rows().groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("n_rows").alias("group_size"), F.every(F.col("batch").isin(*batches)).alias("new"))
    sized = scratch.keep(grouped(hashed).select("digest", "n_rows").hint("merge").join(known, "digest"), "sized")
    large = F.broadcast(sized.where(F.col("n_rows") > max(1000, hashed.count() // LARGE)))
    few = hashed.join(large, "digest")
    rest = hashed.join(large.select("digest"), "digest", "left_anti").join(sized.hint("merge"), "digest")
    return few.unionByName(rest).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("new") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def fresh_index(spark: SparkSession) -> DigestIndex:
    """An index of its own for one run."""
    return DigestIndex(spark, f"digest_index_{uuid.uuid4().hex[:12]}")


def kept_documents(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, with all their columns. Only the ids that go are joined."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    told = scratch.keep(dedup(docs.select("doc_id", "text"), index), "told")
    gone = scratch.keep(told.where("NOT kept").select("doc_id", F.col("text_sha256").alias("digest")).distinct(), "gone")
    repeated = told.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1").limit(1).count()
    marked = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.sha2(normalised(F.col("text")), 256).alias("sha"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("sha") == F.col("digest"))
    stay = marked.join(small_side(gone, gone.count()), same, "left_anti")
    return (stay.dropDuplicates(["id", "sha"]) if repeated else stay).select("row.*")


ORACLE = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

"""BM25 retrieval as joins of query terms with postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparrowmill.functions.columns import words


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("doc"), F.explode(words(F.col(text))).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query, doc, score, place) of the k best documents; a repeated query term counts each time.

    Documents that share no term score 0 and follow in order of their keys: of the first k keys enough are left for any query.
    """
    post = postings(docs, key, text)
    sizes = docs.select(F.col(key).alias("doc"), F.size(words(F.col(text))).alias("size"))
    whole = sizes.agg(F.count("*").alias("n"), F.avg("size").alias("mean"))  # one row
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    asked = queries.select(F.col(query_key).alias("query"), F.explode(words(F.col(query_text))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = F.col("times") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    joined = asked.join(df, "term").join(post, "term").join(sizes, "doc").crossJoin(F.broadcast(whole))
    scored = joined.groupBy("query", "doc").agg(F.round(F.sum(part), 6).alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    best = scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")
    first = [r.doc for r in docs.select(F.col(key).alias("doc")).distinct().orderBy("doc").limit(k).collect()]  # k keys
    spare = queries.select(F.col(query_key).alias("query"), F.explode(F.array(*map(F.lit, first))).alias("doc")).distinct() if first else best.select("query", "doc").limit(0)
    filled = best.unionByName(spare.join(best.select("query", "doc"), ["query", "doc"], "left_anti").withColumn("score", F.lit(0.0)))
    return filled.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)

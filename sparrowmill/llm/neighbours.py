"""Approximate nearest neighbours: NN-descent builds a neighbour graph in iterative joins, queries search it greedily.

Equal vectors share one node that keeps the smallest few of their ids, as many as a result can hold. Nodes carry their
unit vector as 32-bit floats; a similarity is minus the squared length of the difference, which near copies keep to full
precision where a product of the vectors is 1 for all. Results are scored on the original vectors in double precision.

The graph starts from a few random-hyperplane partitions: within a cell (split where it is large) each node takes its
nearest. Each round of NN-descent then joins every node's neighbours and reverse neighbours (a bounded number of either)
with their vectors, compares those of which at least one is new, and offers every pair's ends to each other's lists if
they beat the last entry there. Rounds stop when few lists change. Each node's row in the final graph holds its
neighbours' vectors, bucketed by node, so a search step moves queries to the graph and never the graph.

A query starts from its own node's neighbours. In each step the best unexpanded nodes of its pool of ``pool`` candidates
are expanded, until no pool changes or ``steps`` are done; the best of a pool are scored exactly, and all others that the
rounding of 32-bit floats could have put behind them.

Defined cases: vectors that are null, zero, hold null or non-finite components, or have another length than most take no
part; ties go to the smaller vec_id; with fewer candidates than asked for, all are returned; rows that repeat a vec_id and
vector are one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparrowmill.llm.scratch import Scratch

K, CELL, TREES, ROUNDS, POOL, STEPS = 32, 384, 6, 6, 192, 5
EMPTY = -9.0
ROUNDING = 1e-6  # bound of the error in the length of a difference of two unit vectors of 32-bit floats


def valid(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part, as doubles."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ok = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite & F.exists("embedding", lambda x: x != 0))
    sizes = ok.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    ok = ok.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return ok.where(F.size("v") == (sizes[0].d if sizes else 0))


def runs(batches, key: int = 0) -> Iterator[pa.RecordBatch]:
    """Batches of sorted rows cut anew so that rows of one key are never apart."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        k = batch.column(key).to_numpy()
        last = int(np.searchsorted(k, k[-1])) if (k[:-1] <= k[1:]).all() else 0
        if last:
            yield pa.Table.from_batches([*rest, batch.slice(0, last)]).combine_chunks().to_batches()[0]
            rest = [batch.slice(last)]
        elif rest and rest[-1].column(key)[0].as_py() != k[0]:
            yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
            rest = [batch]
        else:
            rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]


def codes_of(column: pa.Array) -> np.ndarray:
    """Unit vectors from a column of their bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1)


def coded(v: np.ndarray) -> list[bytes]:
    v = v / np.abs(v).max(1, keepdims=True)
    return [r.tobytes() for r in (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)]


def similar(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Minus the squared length of x[i] - x[j], by portions."""
    out = np.empty(len(i), np.float32)
    for at in range(0, len(i), 65_536):
        d = x[i[at : at + 65_536]] - x[j[at : at + 65_536]]
        out[at : at + 65_536] = -np.einsum("ij,ij->i", d, d)
    return out


def roughly(x: np.ndarray) -> tuple[np.ndarray, float]:
    """All similarities by one product, and a bound of their error."""
    x = x - x.mean(0)
    n = np.einsum("ij,ij->i", x, x)
    s = 2 * (x @ x.T) - n[:, None] - n[None, :]
    np.fill_diagonal(s, EMPTY)
    return s, 1e-5 * float(n.max())


def best_of(key: np.ndarray, to: np.ndarray, sim: np.ndarray, new: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best distinct targets of each key, best first; a target already there stays not new."""
    order = np.lexsort([new, to, key])
    key, to, sim, new = key[order], to[order], sim[order], new[order]
    once = np.r_[True, (key[1:] != key[:-1]) | (to[1:] != to[:-1])] if len(key) else np.zeros(0, bool)
    key, to, sim, new = key[once], to[once], sim[once], new[once]
    order = np.lexsort([to, -sim, key])
    key, to, sim, new = key[order], to[order], sim[order], new[order]
    at = np.arange(len(key)) - np.searchsorted(key, key)
    keep = at < k
    return key[keep], to[keep], sim[keep], new[keep]


EDGE = "id bigint, nbr bigint, sim float, new boolean"


def edges(key, to, sim, new) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(to, pa.int64()), pa.array(sim, pa.float32()), pa.array(new.astype(bool))], ["id", "nbr", "sim", "new"])


def merged(found: DataFrame, k: int) -> DataFrame:
    """The k best edges of each node."""

    def run(batches):
        for b in runs(batches):
            yield edges(*best_of(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy(zero_copy_only=False), k))

    return found.repartition("id").sortWithinPartitions("id").mapInArrow(run, EDGE)


class Index:
    """Nodes and neighbour graph of a table of vectors."""

    def __init__(self, embeddings: DataFrame, keep: int, k: int = K, trees: int = TREES, rounds: int = ROUNDS, seed: int = 17):
        self.spark, self.k, self.seed = embeddings.sparkSession, k, seed
        self.scratch = Scratch(self.spark, "neighbours")
        order = Window.partitionBy("v").orderBy("vec_id")
        few = valid(embeddings).distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep)
        self.nodes = self.scratch.keep(self._coded(few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("members"))), "nodes")
        self.n = self.nodes.count()
        self.graph = self._descend(self._start(trees), rounds) if self.n else None

    def _coded(self, df: DataFrame) -> DataFrame:
        def run(batches):
            for b in batches:
                if len(b):
                    v = np.asarray(b.column(0).flatten()).reshape(len(b), -1)
                    members = b.column(1)
                    ids = pa.array(np.asarray(members.flatten())[np.asarray(members.offsets)[:-1] - members.offsets[0].as_py()], pa.int64())
                    yield pa.RecordBatch.from_arrays([ids, members, b.column(0), pa.array(coded(v), pa.binary())], ["id", "members", "v", "code"])

        return df.select("v", "members").mapInArrow(run, "id bigint, members array<bigint>, v array<double>, code binary")

    def _start(self, trees: int) -> DataFrame:
        """Each node's nearest within its cells."""
        planes, seed, k = max(0, math.ceil(math.log2(max(1, self.n / CELL)))), self.seed, self.k

        def cells(batches):
            for b in batches:
                if len(b):
                    x = codes_of(b.column(1))
                    for t in range(trees):
                        w = np.random.default_rng([seed, t]).standard_normal((x.shape[1], max(1, planes)))
                        side = ((x @ w) > 0).astype(np.int64) @ (1 << np.arange(max(1, planes))) if planes else np.zeros(len(x), np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(side * trees + t, pa.int64()), b.column(0), b.column(1)], ["cell", "id", "code"])

        placed = self.nodes.select("id", "code").mapInArrow(cells, "cell bigint, id bigint, code binary")
        placed = self.scratch.keep(placed, "cells")
        sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / (4 * CELL)).alias("parts"))
        part = F.xxhash64("cell", F.pmod(F.xxhash64("cell", "id"), "parts"))  # another split in each tree: parts that never meet stay apart in the graph
        split = placed.join(sizes, "cell").select(part.alias("part"), "id", "code").repartition("part").sortWithinPartitions("part")

        def near(batches):
            for b in runs(batches):
                part, ids, x = b.column(0).to_numpy(), b.column(1).to_numpy(), codes_of(b.column(2))
                cuts = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)]
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                    m = min(k, hi - lo - 1)
                    if m > 0:
                        top = np.argpartition(-roughly(x[lo:hi])[0], m - 1, axis=1)[:, :m].ravel()
                        own = np.repeat(np.arange(hi - lo), m)
                        yield edges(ids[lo:hi][own], ids[lo:hi][top], similar(x[lo:hi], own, top), np.ones((hi - lo) * m, bool))

        return self.scratch.keep(merged(split.mapInArrow(near, EDGE), k), "graph")

    def _descend(self, graph: DataFrame, rounds: int) -> DataFrame:
        k = self.k
        for _ in range(rounds):
            full = graph.groupBy("id").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(F.lit(EMPTY)).alias("bar"))
            about = self.nodes.select("id", "code").join(full, "id", "left").select(F.col("id").alias("member"), "code", F.coalesce("bar", F.lit(EMPTY)).cast("float").alias("bar"))
            few = Window.partitionBy("pivot", "new").orderBy(F.xxhash64("pivot", "member"))
            back = graph.select(F.col("nbr").alias("pivot"), F.col("id").alias("member"), "new").withColumn("n", F.row_number().over(few)).where(F.col("n") <= k // 2).drop("n")
            around = graph.select(F.col("id").alias("pivot"), F.col("nbr").alias("member"), "new").unionByName(back)
            around = around.groupBy("pivot", "member").agg(F.max("new").alias("new"))
            rows = around.join(about, "member").select("pivot", "member", "new", "bar", "code").repartition("pivot").sortWithinPartitions("pivot")

            def local(batches):
                for b in runs(batches):
                    pivot, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
                    new, bar, x = b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(), codes_of(b.column(4))
                    cuts = np.r_[np.flatnonzero(np.r_[True, pivot[1:] != pivot[:-1]]), len(pivot)]
                    held, count = [], 0
                    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                        fresh = new[lo:hi]
                        if not fresh.any():
                            continue
                        s, error = roughly(x[lo:hi])
                        i, j = np.nonzero((s + error > bar[lo:hi, None]) & (fresh[:, None] | fresh[None, :]) & ~np.eye(hi - lo, dtype=bool))
                        s = similar(x[lo:hi], i, j)
                        better = s > bar[lo:hi][i]
                        held.append((ids[lo:hi][i[better]], ids[lo:hi][j[better]], s[better]))
                        count += int(better.sum())
                        if count > 400_000:
                            yield offers(held)
                            held, count = [], 0
                    if held:
                        yield offers(held)

            def offers(held):
                key, to, sim = (np.concatenate(c) for c in zip(*held, strict=True))
                return edges(*best_of(key, to, sim, np.ones(len(key), bool), k))

            old = graph.withColumn("new", F.lit(False))
            after = self.scratch.keep(merged(old.unionByName(rows.mapInArrow(local, EDGE)), k), "graph")
            changed = after.where("new").count()
            self.scratch.drop(graph)
            graph = after
            if changed < 0.02 * self.n * k:
                break
        return graph

    def packed(self, table: str) -> DataFrame:
        """The graph as a table bucketed by node: id, neighbours and their vectors."""
        codes = self.nodes.select(F.col("id").alias("nbr"), "code")
        few = Window.partitionBy("id").orderBy(F.xxhash64("id", "nbr"))
        back = self.graph.select(F.col("nbr").alias("id"), F.col("id").alias("nbr")).where(F.pmod(F.xxhash64("id", "nbr"), F.lit(4)) == 0)
        back = back.withColumn("n", F.row_number().over(few)).where(F.col("n") <= 2 * self.k).drop("n")  # a node that all point to keeps a row of bounded size
        both = self.graph.select("id", "nbr").unionByName(back).distinct()
        rows = both.join(codes, "nbr").groupBy("id").agg(F.collect_list(F.struct("nbr", "code")).alias("near"))
        buckets = max(8, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        rows.repartition(buckets, "id").write.format("parquet").bucketBy(buckets, "id").sortBy("id").saveAsTable(table)
        return self.spark.table(table)

    def search(self, queries: DataFrame, top: int, pool: int = POOL, steps: int = STEPS) -> DataFrame:
        """(query_id, rank, vec_id, score) for rows (query_id, node) of ``queries``; a query isn't its own neighbour."""
        table = f"neighbours_{uuid.uuid4().hex[:12]}"
        graph = self.packed(table)
        state = "query bigint, node bigint, sim float, open boolean"
        first = queries.select("query_id", "node").join(self.graph.select(F.col("id").alias("node"), "nbr", "sim"), "node")
        home = queries.select(F.col("query_id").alias("query"), "node", F.lit(0.0).cast("float").alias("sim"), F.lit(False).alias("open"))
        pools = self.scratch.keep(home.unionByName(first.select(F.col("query_id").alias("query"), F.col("nbr").alias("node"), "sim", F.lit(True).alias("open"))), "pools")
        asked = self.scratch.keep(queries.join(self.nodes.select(F.col("id").alias("node"), "code"), "node").select(F.col("query_id").alias("query"), "code"), "queries")
        for _ in range(steps):
            bar = pools.groupBy("query").agg(F.when(F.count("*") >= pool, F.min("sim")).otherwise(F.lit(EMPTY)).alias("bar"))
            frontier = pools.where("open").select("query", F.col("node").alias("id")).join(asked, "query").join(bar, "query")
            reached = frontier.hint("merge").join(graph, "id").select("query", "bar", "code", F.col("near.nbr").alias("nbrs"), F.col("near.code").alias("codes"))

            def expand(batches):
                for b in batches:
                    if not len(b):
                        continue
                    nbrs = b.column(3)
                    sizes = np.diff(np.asarray(nbrs.offsets))
                    x, q = codes_of(b.column(4).flatten()), codes_of(b.column(2))
                    owner = np.repeat(np.arange(len(b)), sizes)
                    sim = np.concatenate([-np.square(x[at : at + 65_536] - q[owner[at : at + 65_536]]).sum(1) for at in range(0, len(x), 65_536)])
                    query, ids = b.column(0).to_numpy()[owner], np.asarray(nbrs.flatten())
                    keep = sim > b.column(1).to_numpy()[owner]
                    key, to, s, _ = best_of(query[keep], ids[keep], sim[keep], np.ones(keep.sum(), bool), pool)
                    yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(to, pa.int64()), pa.array(s, pa.float32()), pa.array(np.ones(len(key), bool))], ["query", "node", "sim", "open"])

            def settle(batches):
                for b in runs(batches):
                    key, to, s, o = best_of(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy(zero_copy_only=False), pool)
                    yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(to, pa.int64()), pa.array(s, pa.float32()), pa.array(o.astype(bool))], ["query", "node", "sim", "open"])

            closed = pools.withColumn("open", F.lit(False))
            offered = closed.unionByName(reached.mapInArrow(expand, state))
            pools = self.scratch.keep(offered.repartition("query").sortWithinPartitions("query").mapInArrow(settle, state), "pools")
            if not pools.where("open").limit(1).count():
                break
        self.spark.sql(f"DROP TABLE {table}")  # pools hold all that is asked from here on
        return self._ranked(queries, pools, top)

    def _ranked(self, queries: DataFrame, pools: DataFrame, top: int) -> DataFrame:
        """Exact scores of each pool's best, members told apart, the ``top`` best of each query."""
        rank = Window.partitionBy("query").orderBy(F.desc("sim"), "node")
        away = F.sqrt(-F.col("sim"))
        near = F.max(F.when(F.col("n") <= top + 1, away)).over(Window.partitionBy("query")) + 2 * ROUNDING
        placed = pools.withColumn("n", F.row_number().over(rank)).withColumn("near", near)
        best = placed.where((F.col("n") <= 4 * top + 4) | (away <= F.col("near"))).select(F.col("query").alias("query_id"), F.col("node").alias("found"))
        vectors = self.nodes.select("id", "v", "members")
        both = best.join(queries.select("query_id", "node"), "query_id").join(vectors.select(F.col("id").alias("node"), F.col("v").alias("q")), "node").join(vectors.withColumnRenamed("id", "found"), "found")
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        score = dot("q", "v") / (F.sqrt(dot("q", "q")) * F.sqrt(dot("v", "v")))
        told = both.select("query_id", score.alias("score"), F.explode("members").alias("vec_id")).where("vec_id <> query_id")
        final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return told.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def queries_of(index: Index, embeddings: DataFrame, every: int) -> DataFrame:
    """(query_id, node) of the rows whose vec_id is divisible by ``every``; copies that a node doesn't list find it by their vector."""
    asked = valid(embeddings.where(F.col("vec_id") % every == 0)).distinct()
    return asked.join(index.nodes.select("v", F.col("id").alias("node")), "v").select(F.col("vec_id").alias("query_id"), "node")


def nearest(embeddings: DataFrame, top: int = 5, every: int = 50, search: Callable | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for every query's ``top`` nearest."""
    embeddings = embeddings.select("vec_id", "embedding")
    index = Index(embeddings, top + 1)
    if not index.n:
        return embeddings.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    queries = index.scratch.keep(queries_of(index, embeddings, every), "asked")
    return index.search(queries, top)

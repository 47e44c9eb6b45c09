"""Vector code compression: each part of a vector becomes the number of its nearest codebook entry, found in vantage-point trees.

Components become integers floor(1024 * x), vectors are cut into PARTS equal parts, and the codebook of each part position
starts as that part of the first ``entries`` vectors by vec_id. Each round assigns every part to its nearest entry (squared
Euclidean distance, ties to the lower index) and replaces each entry by floor(sum / count) of its parts.

Entries of a part position form a vantage-point tree: a node holds an entry and halves the others by their distance from it,
with the least and the largest distance of either half. A search descends greedily for a first answer, then visits every half
that the triangle inequality doesn't rule out. Those distances are roots, so the bounds are rounded outwards and a half whose
bound equals the best distance is visited too; what decides is the exact squared distance of integers and the index.

Vectors stay where Spark dealt them. A task sends one sum for each entry and part position, which Spark adds up by entry and
component; what reaches the driver is the codebooks alone, ``entries`` vectors in size.

Defined cases: vectors that are null or hold a null or non-finite component take no part; nor do vectors of another length than
most (of equally frequent lengths the smaller counts), as no distance to them is defined; a length that 4 doesn't divide is
filled up with zeros; with fewer vectors than ``entries`` the codebook has as many entries; rows that repeat a vec_id are vectors
of their own, ordered by components, rows without one come last; null labels are one label; components of 2^20 or more raise an
error, as squared distances might pass 64 bits; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowmill.llm.scratch import Scratch, small_side

PARTS, SCALE, LIMIT = 4, 1024, 1 << 20
LEAF, CELLS = 8, 1 << 21
#: far above what the rounding of roots and sums of doubles can be, relative to the distances compared
SLACK = 1e-12


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` from all ``entries``, in portions of bounded size."""
    out = np.empty((len(x), len(entries)), np.int64)
    step = max(1, CELLS // max(1, entries.size))
    for at in range(0, len(x), step):
        gap = x[at : at + step, None, :] - entries[None]
        out[at : at + step] = np.einsum("ijk,ijk->ij", gap, gap)
    return out


@dataclass
class Node:
    """A vantage entry with two halves, each (child, least distance, largest distance); a leaf holds its entries alone."""

    entries: np.ndarray
    halves: tuple[tuple[Node, float, float], ...] = ()
    border: int = 0  # squared distances up to it lie in the first half


class VantageTree:
    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = self._grown(np.arange(len(entries)))

    def _grown(self, own: np.ndarray) -> Node:
        if len(own) <= LEAF:
            return Node(own)
        middle = self.entries[own].mean(0)
        first = int(np.argmax(((self.entries[own] - middle) ** 2).sum(1)))  # entries far out part the others well
        rest = np.delete(own, first)
        far = squared(self.entries[rest], self.entries[own[first : first + 1]])[:, 0]
        order = np.argsort(far, kind="stable")
        cut = len(rest) // 2
        halves = []
        for part in (order[:cut], order[cut:]):
            d = np.sqrt(far[part].astype(np.float64))
            halves.append((self._grown(np.sort(rest[part])), np.nextafter(d.min(), -np.inf), np.nextafter(d.max(), np.inf)))
        return Node(own[first : first + 1], tuple(halves), int(far[order[cut - 1]]))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row, the lower of equals, and its squared distance."""
        best, index = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(self.entries))

        def meet(node: Node, at: np.ndarray) -> np.ndarray:
            d = squared(x[at], self.entries[node.entries])
            k = d.argmin(1)  # entries of a node ascend, so this is the lower of equals
            near, which = d[np.arange(len(at)), k], node.entries[k]
            better = (near < best[at]) | (near == best[at]) & (which < index[at])
            best[at[better]], index[at[better]] = near[better], which[better]
            return d[:, 0]

        def descend(node: Node, at: np.ndarray) -> None:
            if len(at):
                d = meet(node, at)
                for (child, _, _), mine in zip(node.halves, (d <= node.border, d > node.border), strict=False):
                    descend(child, at[mine])

        def visit(node: Node, at: np.ndarray) -> None:
            d = np.sqrt(meet(node, at).astype(np.float64))
            for child, least, largest in node.halves:
                reach = np.sqrt(best[at].astype(np.float64))
                bound = np.maximum(d - largest, least - d)
                open_ = bound <= reach + SLACK * (d + largest + reach)
                if open_.any():
                    visit(child, at[open_])

        everything = np.arange(len(x))
        if len(x):
            descend(self.root, everything)
            visit(self.root, everything)
        return index, best


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v): kept vectors as integers."""
    x = F.col("embedding")
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    large = F.exists(x, lambda c: F.abs(c) >= LIMIT)
    v = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("int"))
    checked = F.when(large, F.raise_error(F.lit(f"a component of {LIMIT} or more"))).otherwise(v)
    return vectors.where(x.isNotNull() & ~odd).select("vec_id", "label", checked.alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as (row, part, component), filled up with zeros."""
    n = len(column)
    flat = column.flatten().to_numpy().astype(np.int64).reshape(n, -1)
    width = -(-flat.shape[1] // PARTS)
    return np.pad(flat, ((0, 0), (0, PARTS * width - flat.shape[1]))).reshape(n, PARTS, width)


def sums(rows: DataFrame, books: np.ndarray) -> pa.Table:
    """(part, entry, n, total) of the parts assigned to each entry."""
    spread = rows.sparkSession.sparkContext.broadcast([VantageTree(b) for b in books])  # the codebooks: PARTS * entries parts

    def run(batches):
        trees = spread.value
        n, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch.column(0))
            for p, tree in enumerate(trees):
                index, _ = tree.nearest(x[:, p])
                order = np.argsort(index, kind="stable")
                used, at = np.unique(index[order], return_index=True)
                total[p, used] += np.add.reduceat(x[order, p], at, axis=0)
                n[p] += np.bincount(index, minlength=books.shape[1])
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    sent = rows.select("v").mapInArrow(run, "part int, entry int, n bigint, total array<bigint>").repartition("part", "entry")
    by_component = sent.select("part", "entry", "n", F.posexplode("total").alias("k", "x")).groupBy("part", "entry", "k").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    by_entry = by_component.groupBy("part", "entry").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("k", "x"))).alias("total"))
    return by_entry.select("part", "entry", "n", F.transform("total", lambda t: t["x"]).alias("total")).toArrow()


def learned(rows: DataFrame, entries: int, rounds: int) -> np.ndarray:
    """The codebooks as (part, entry, component)."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").toArrow()
    books = matrix(first.column(0).combine_chunks()).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        found = sums(rows, books)
        for part, entry, n, total in zip(*(c.to_pylist() for c in found.columns), strict=True):
            books[part, entry] = np.array(total, np.int64) // n
    return books


def digest(books: np.ndarray) -> str:
    return sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, entries: int = 256, rounds: int = 4) -> DataFrame:
    """Per kept vector: vec_id, code (two hex digits a part), error, label_error, codebooks_sha256."""
    scratch = Scratch(vectors.sparkSession, "vector-codes")
    schema = "vec_id bigint, label int, code string, error bigint"
    rows = scratch.keep(whole_numbers(vectors.select(F.col("vec_id").cast("bigint"), F.col("label").cast("int"), "embedding")), "integers")
    most = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    if most is None or most.size == 0:
        return vectors.sparkSession.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    rows = rows.where(F.size("v") == most.size)
    books = learned(rows, entries, rounds)
    spread = vectors.sparkSession.sparkContext.broadcast([VantageTree(b) for b in books])
    digits = np.array([f"{k:02x}" for k in range(256)]) if entries <= 256 else None
    if digits is None:
        raise ValueError("two hex digits tell 256 entries apart")

    def run(batches):
        trees = spread.value
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch.column(2))
            found = [tree.nearest(x[:, p]) for p, tree in enumerate(trees)]
            code = digits[found[0][0]]
            for index, _ in found[1:]:
                code = np.char.add(code, digits[index])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code.tolist(), pa.string()), pa.array(sum(d for _, d in found), pa.int64())], ["vec_id", "label", "code", "error"])

    coded = scratch.keep(rows.select("vec_id", "label", "v").mapInArrow(run, schema), "codes")
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    by_label = by_label.select(F.col("label").alias("of_label"), "label_error")
    told = coded.join(small_side(by_label, by_label.count()), F.col("label").eqNullSafe(F.col("of_label")))
    return told.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle(entries: int = 256, rounds: int = 4) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT x.rid, x.p, min((x.n2 + c.n2 - 2 * list_inner_product(x.w, c.w))::BIGINT * {entries} + c.e) AS best FROM parts x JOIN c{r} c USING (p) GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""m{r} AS MATERIALIZED (SELECT p, e, list(x ORDER BY k) AS w FROM (SELECT p, best % {entries} AS e, k, floor(sum(w[k]) / count(*)) AS x FROM parts JOIN a{r} USING (rid, p), generate_series(1, len(w)) g(k) GROUP BY ALL) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT p, e, w, list_inner_product(w, w) AS n2 FROM (SELECT p, e, coalesce(m.w, c.w) AS w FROM c{r} c LEFT JOIN m{r} m USING (p, e)))""")
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS rid, * FROM v
  WHERE len(v) = (SELECT len(v) FROM v GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)),
parts AS MATERIALIZED (SELECT *, list_inner_product(w, w) AS n2 FROM (SELECT rid, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS w FROM kept, generate_series(0, {PARTS - 1}) g(p))),
c0 AS MATERIALIZED (SELECT p, rid - 1 AS e, w, n2 FROM parts WHERE rid <= {entries}),
{", ".join(steps)},
told AS (SELECT vec_id, label, string_agg(format('{{:02x}}', best % {entries}), '' ORDER BY p) AS code, sum(best // {entries})::BIGINT AS error FROM kept JOIN a{rounds} USING (rid) GROUP BY rid, vec_id, label),
book AS (SELECT sha256(string_agg(x::BIGINT, ',' ORDER BY p, e, k)) AS codebooks_sha256 FROM (SELECT p, e, k, w[k] AS x FROM c{rounds}, generate_series(1, len(w)) g(k)))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM told CROSS JOIN book
"""

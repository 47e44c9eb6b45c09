"""Ranked lexical search by sort-based accumulation.

Terms are runs of letters and figures (all characters beyond ASCII count as such), A-Z read as a-z. A first pass reads whole
texts and leaves, for each document, the number of its terms and the counts of the terms that items ask for. This table is
range-partitioned by document, so that all entries of a document lie in one task. A second pass concatenates, for portions
of documents of bounded size, the arrays of item, document and impact of all terms matched, radix sorts them by the packed key
of item and document, adds equal keys up with ``numpy.add.reduceat``, and keeps the best of each item in a heap. Only these,
``top`` for each item and task, are shuffled and ranked by Spark.

Items are taken in blocks of about PAIRS different (item, term) pairs, as the terms of a block are broadcast; there is one pass
over the documents for each block. A term found by its 64-bit hash is compared byte by byte before it counts.

With N documents of one term or more, L terms in them, df documents that hold a term, n terms in a document and tf occurrences,
a term adds w * ((10^9 * tf) div (1000 * tf + 8 * m)) for each time that the item has it, with
w = floor(1000 * ln((2N + 2) / (2df + 1))) and m = 25 + (75 * n * N) div L.

Defined cases: null texts and texts without terms are no documents; items without terms get no rows; rows that repeat a doc_id
are documents of their own and may both be ranked; rows that repeat an item_id are one item with the terms of all of them; null
ids are ids, a null doc_id comes after others of equal score; texts and terms of any length are read whole; without documents or
items there are no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparrowmill.llm.scratch import Scratch
from sparrowmill.llm.shingles import LOWER, runs, span_hashes, texts

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PAIRS, ENTRIES = 1_000_000, 1 << 21
_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True


def asked(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item, term, times) of all items."""
    terms = F.regexp_extract_all(F.translate(text, UPPER, LOWERED), F.lit(TERM), F.lit(0))
    return items.select(F.col(item).cast("bigint").alias("item"), F.explode(terms).alias("term")).groupBy("item", "term").agg(F.count("*").alias("times"))


class Block:
    """The terms of a block of items with the items that ask for each."""

    def __init__(self, pairs: pa.Table):
        pairs = pairs.sort_by([("term", "ascending"), ("item", "ascending")])
        terms, items = pairs.column("term").combine_chunks(), pairs.column("item").combine_chunks().dictionary_encode(null_encoding="encode")
        codes = terms.dictionary_encode()
        self.terms, self.items = codes.dictionary.to_pylist(), items.dictionary
        self.item = items.indices.to_numpy().astype(np.int64)
        self.times = pairs.column("times").to_numpy()
        self.fan = np.bincount(codes.indices.to_numpy(), minlength=len(self.terms))
        self.first = np.cumsum(self.fan) - self.fan
        raw = [t.encode() for t in self.terms]
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.ends = np.cumsum([len(r) for r in raw]) if raw else np.zeros(0, np.int64)
        self.starts = np.r_[np.int64(0), self.ends[:-1]] if raw else self.ends
        hashes = span_hashes(self.bytes, self.starts, self.ends)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        self.alike = int(np.unique(hashes, return_counts=True)[1].max(initial=0))  # terms of one hash

    def found(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The term of each stretch of lower-case bytes, -1 for none."""
        h = span_hashes(data, starts, ends)
        out = np.full(len(h), -1)
        at = np.searchsorted(self.hashes, h)
        for k in range(self.alike):
            rows = np.flatnonzero((out < 0) & (at + k < len(self.hashes)))
            rows = rows[self.hashes[at[rows] + k] == h[rows]]
            term = self.order[at[rows] + k]
            size = ends[rows] - starts[rows]
            same = size == self.ends[term] - self.starts[term]
            rows, term, size = rows[same], term[same], size[same]
            if not len(rows):
                continue
            begin = np.cumsum(size) - size
            step = np.arange(size.sum()) - np.repeat(begin, size)
            equal = data[np.repeat(starts[rows], size) + step] == self.bytes[np.repeat(self.starts[term], size) + step]
            equal = np.logical_and.reduceat(equal, begin)
            out[rows[equal]] = term[equal]
        return out


def counted(column: pa.Array, block: Block):
    """(first row, terms of each row, row, term, tf) for runs of rows of bounded size; row and term ascend."""
    for first, data, offsets in texts(column):
        n = len(offsets) - 1
        spaced = np.full(len(data) + n, 32, np.uint8)
        row = np.repeat(np.arange(n), np.diff(offsets))
        spaced[np.arange(len(data)) + row] = data
        starts, ends = runs(_INSIDE[spaced])
        owner = np.searchsorted(offsets[1:] + np.arange(n), starts, side="left")
        term = block.found(LOWER[spaced], starts, ends)
        hit = term >= 0
        key, tf = np.unique(owner[hit] * max(1, len(block.terms)) + term[hit], return_counts=True)
        yield first, np.bincount(owner, minlength=n), key // max(1, len(block.terms)), key % max(1, len(block.terms)), tf


def tallied(docs: DataFrame, block) -> DataFrame:
    """(doc_id, n, terms, tfs) of each document; ``block`` is a broadcast Block."""

    def run(batches):
        for batch in batches:
            for first, n, row, term, tf in counted(batch.column(1), block.value):
                cuts = pa.array(np.searchsorted(row, np.arange(len(n) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x, pa.int32())) for x in (term, tf)]
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(n)), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])
                yield out.filter(pa.array(n > 0))

    return docs.mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, tfs array<int>")


def radix_order(key: np.ndarray) -> np.ndarray:
    """The order that sorts non-negative keys, sixteen bits at a time from the lowest (numpy sorts these by radix)."""
    order = np.argsort((key & 0xFFFF).astype(np.uint16), kind="stable")
    shift = 16
    while len(key) and int(key.max()) >> shift:
        order = order[np.argsort((key[order] >> shift & 0xFFFF).astype(np.uint16), kind="stable")]
        shift += 16
    return order


def length_part(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """m of each document, in whole numbers of any size."""
    wide = n.max(initial=0) * 75.0 * documents >= 2.0**62
    return np.array([25 + 75 * int(x) * documents // total for x in n], np.int64) if wide else 25 + 75 * n * documents // total


class Best:
    """The ``top`` best documents of each item so far, in heaps with the worst one first."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.heaps: list[list[tuple[int, bool, int]]] = [[] for _ in range(items)]
        self.bar = np.ones(items, np.int64)

    def offer(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, known: np.ndarray) -> None:
        keep = score >= self.bar[item]
        item, score, doc, known = item[keep], score[keep], doc[keep], known[keep]
        order = np.lexsort([doc, ~known, -score, item])
        item, score, doc, known = item[order], score[order], doc[order], known[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        for k in np.flatnonzero(place < self.top):
            heap, row = self.heaps[item[k]], (int(score[k]), bool(known[k]), -int(doc[k]))
            if len(heap) < self.top:
                heapq.heappush(heap, row)
            elif row > heap[0]:
                heapq.heapreplace(heap, row)
            if len(heap) == self.top:
                self.bar[item[k]] = heap[0][0]


def accumulated(block: Block, weight: np.ndarray, part: np.ndarray, owner: np.ndarray, term: np.ndarray, tf: np.ndarray, documents: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, document, score) from the matched terms of a portion of documents."""
    tf = tf.astype(np.int64)
    impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * part[owner]))
    fan = block.fan[term]
    begin = np.cumsum(fan) - fan
    at = np.repeat(block.first[term] - begin, fan) + np.arange(fan.sum())
    key = block.item[at] * documents + np.repeat(owner, fan)
    value = np.repeat(impact, fan) * block.times[at]
    order = radix_order(key)
    key, value = key[order], value[order]
    heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[heads] // documents, key[heads] % documents, np.add.reduceat(value, heads) if len(heads) else heads


def best_of_tasks(rows: DataFrame, block, weight, documents: int, total: int, top: int) -> DataFrame:
    """(item_id, doc_id, score): the best documents of each item in each task."""

    def run(batches):
        own, w = block.value, weight.value
        best = Best(len(own.items), top)
        for batch in batches:
            if not len(batch):
                continue
            ids, terms = batch.column(0), batch.column(2)
            known, doc = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            part = length_part(batch.column(1).to_numpy(), documents, total)
            sizes = terms.value_lengths().to_numpy(zero_copy_only=False)
            term, tf, owner = terms.flatten().to_numpy(), batch.column(3).flatten().to_numpy(), np.repeat(np.arange(len(batch)), sizes)
            ends, filled = np.cumsum(sizes), np.r_[0, np.cumsum(own.fan[term])]
            at = 0
            while at < len(batch):  # portions of ENTRIES entries, or of one document with more
                low = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(filled[ends], filled[low] + ENTRIES, side="right")))
                cut = slice(low, ends[to - 1])
                item, where, score = accumulated(own, w, part[at:to], owner[cut] - at, term[cut], tf[cut], to - at)
                best.offer(item, score, doc[at:to][where], known[at:to][where])
                at = to
        found = [(k, *row) for k, heap in enumerate(best.heaps) for row in heap]
        if found:
            k, score, known, doc = zip(*found, strict=True)
            docs = pa.array([-d if ok else None for d, ok in zip(doc, known, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([own.items.take(pa.array(k, pa.int64())), docs, pa.array(score, pa.int64())], ["item_id", "doc_id", "score"])

    return rows.mapInArrow(run, "item_id bigint, doc_id bigint, score bigint")


def searched(docs: DataFrame, items: DataFrame, top: int = 10, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """Per item the ``top`` documents of the highest scores above 0: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lexical-search")
    docs = docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    pairs = scratch.keep(asked(items, item, text), "asked")
    blocks = max(1, -(-pairs.count() // PAIRS))
    found, documents, total = [], None, None
    for k in range(blocks):
        own = Block(pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).toArrow())  # about PAIRS pairs, or one item
        if not own.terms:
            continue
        spread = spark.sparkContext.broadcast(own)
        rows = scratch.keep(tallied(docs, spread).repartitionByRange("doc_id", F.xxhash64("terms", "tfs")), "tallies")
        if total is None:
            whole = rows.agg(F.count("*").alias("n"), F.sum("n").alias("total")).first()
            documents, total = whole.n, whole.total
        if not documents:
            break
        df = np.zeros(len(own.terms), np.int64)
        counts = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()  # the block's terms at most
        df[counts.column("term").to_numpy()] = counts.column("df").to_numpy()
        weight = np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)
        found.append(scratch.keep(best_of_tasks(rows, spread, spark.sparkContext.broadcast(weight), documents, total, top), "best"))
        scratch.drop(rows)
    if not found:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


def oracle(top: int = 10) -> str:
    terms = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWERED}'), '{TERM.replace(chr(92), chr(92))}')"
    return f"""
WITH d AS (SELECT rid, doc_id, {terms} AS ts FROM (SELECT row_number() OVER () AS rid, * FROM documents)),
s AS (SELECT rid, doc_id, len(ts)::BIGINT AS n FROM d WHERE len(ts) > 0),
whole AS (SELECT count(*) AS documents, sum(n)::BIGINT AS total FROM s),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({terms}) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * documents + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, whole GROUP BY term, documents),
i AS (SELECT rid, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * documents) // total))) AS impact FROM p JOIN f USING (term) JOIN s USING (rid) CROSS JOIN whole),
a AS (SELECT item_id, rid, sum(times * impact)::BIGINT AS score FROM q JOIN i USING (term) GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank
  FROM a JOIN s USING (rid) WHERE score > 0) WHERE rank <= {top}
"""

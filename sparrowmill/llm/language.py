"""Language identification by prediction by partial matching.

Each language has a variable-order tree of byte contexts up to ORDER bytes, with the counts of the bytes that followed
them in its sample and escape probabilities by the number of distinct followers (method C). A byte costs minus the
logarithm of its probability in the longest context that was seen; where it wasn't seen there, the cost of the escape
is added and the next shorter context asked. Statistics are frozen after training. The language with the shortest code
over all bytes of a text wins; the score is its share of probability among the learned languages.

Trees are sparse: only contexts that were seen are kept, all 256 bytes are told apart, A-Z read as a-z. For scoring, a worker
lays the trees of GROUP languages at a time out as sorted runs of bytes with their costs in each of these languages; up to
HELD groups stay laid out, with more of them groups are laid out anew for each batch, so any number of languages works.

Training reads a bounded sample, ``per_language`` rows of each language with the smallest hash of the id (one row of a
repeated id), their whole texts. Defined cases: null texts and texts without a letter are 'und' with score 0, and so is
every text when nothing was learned; null languages aren't learned; ties go to the name that sorts first; an empty table
gives no rows; repeated rows score alike; only text is read in a prediction.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowmill.llm.scratch import Scratch, small_side
from sparrowmill.llm.shingles import texts

ORDER, GROUP, HELD = 3, 16, 4
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def sample(docs: DataFrame, learn: Column, per_language: int) -> DataFrame:
    """(doc_id, lang) of the rows to learn from: of each language those with the smallest hash of the id.

    Hashes up to a bound from the language's count are cut out first, twice as many as asked for, so ordering a language never
    meets all its rows.
    """
    known = docs.where(learn & F.col("lang").isNotNull()).select("doc_id", "lang", F.xxhash64("doc_id").alias("at"))
    share = F.greatest(F.lit(4.0 * per_language) / F.count("*") - 1, F.lit(-1.0))
    bounds = known.groupBy("lang").agg(F.when(F.count("*") <= 2 * per_language, F.lit(2**63 - 1)).otherwise((share * 2.0**63).cast("bigint")).alias("bound"))
    by = Window.partitionBy("lang").orderBy("at", "doc_id")
    bounds = Scratch(docs.sparkSession, "language").keep(bounds, "bounds")  # a row for each language
    near = known.join(small_side(bounds, bounds.count()), "lang").where("at <= bound").select("doc_id", "lang", "at").distinct()
    return near.withColumn("k", F.row_number().over(by)).where(f"k <= {per_language}").select("doc_id", "lang")


def codes(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of (ORDER + 1 bytes that end at each byte, as a number, start of each row, bytes of each row); rows begin after blanks."""
    for _, data, offsets in texts(column):
        n, gap = len(offsets) - 1, ORDER
        laid = np.full(len(data) + gap * n, 32, np.uint32)
        row = np.repeat(np.arange(1, n + 1), np.diff(offsets))
        laid[np.arange(len(data)) + gap * row] = LOWER[data]
        code = laid.copy()
        for k in range(1, ORDER + 1):
            code[k:] |= laid[:-k] << np.uint32(8 * k)
        yield code, offsets[:-1] + gap * np.arange(1, n + 1), np.diff(offsets)


def rows_of(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of the rows' own bytes, without the blanks before them."""
    return np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())


def counted(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    known, at = np.unique(keys, return_inverse=True)
    return known, np.bincount(at, n, len(known))


def found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in a sorted table, and whether it is there."""
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Group:
    """Costs of some languages: for each order the runs seen in any of them, and the escapes of the contexts seen in any."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]]):
        self.runs, self.costs, self.contexts, self.escapes = [], [], [], []
        width = len(counts)
        for order in range(ORDER + 1):
            mask = np.uint32((1 << (8 * order + 8)) - 1) if order < 3 else np.uint32(0xFFFFFFFF)
            each = [counted(code & mask, n) for code, n in counts]
            heads = [counted(run >> np.uint32(8), n) for run, n in each]
            kinds = [counted(run >> np.uint32(8), np.ones(len(run)))[1] for run, _ in each]
            runs, contexts = np.unique(np.concatenate([r for r, _ in each])), np.unique(np.concatenate([h for h, _ in heads]))
            escape = np.zeros((len(contexts), width), np.float32)
            for k, ((head, total), kind) in enumerate(zip(heads, kinds, strict=True)):
                escape[np.searchsorted(contexts, head), k] = -np.log2(kind / (total + kind))
            cost = escape[np.searchsorted(contexts, runs >> np.uint32(8))] + self._shorter(runs, order)
            for k, ((run, n), (head, total), kind) in enumerate(zip(each, heads, kinds, strict=True)):
                at = np.searchsorted(head, run >> np.uint32(8))
                cost[np.searchsorted(runs, run), k] = -np.log2(n / (total + kind)[at])
            self.runs.append(runs)
            self.costs.append(cost.astype(np.float32))
            self.contexts.append(contexts)
            self.escapes.append(escape)

    def _shorter(self, codes: np.ndarray, order: int) -> np.ndarray:
        """Costs of the last byte of each run in contexts shorter than ``order``, escapes included."""
        if order == 0:
            return np.full((len(codes), 1), 8.0, np.float32)
        return self.cost(codes, order - 1)

    def cost(self, codes: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Bits of the last byte of each run in each language, from contexts of ``order`` bytes down."""
        run = codes if order == 3 else codes & np.uint32((1 << (8 * order + 8)) - 1)
        at, there = found(self.runs[order], run)
        out = self.costs[order][at]
        if not there.all():
            miss = np.flatnonzero(~there)
            context, seen = found(self.contexts[order], run[miss] >> np.uint32(8))
            out[miss] = self._shorter(codes[miss], order) + np.where(seen[:, None], self.escapes[order][context], 0)
        return out


class Trees:
    """Counts of each language's runs of ORDER + 1 bytes."""

    def __init__(self, languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        self.languages, self.counts, self.key = languages, counts, uuid.uuid4().hex

    def groups(self) -> Iterator[Group]:
        for first in range(0, len(self.languages), GROUP):
            key = self.key, first
            if key not in _LAID:
                _LAID[key] = Group(self.counts[first : first + GROUP])
            _LAID.move_to_end(key)
            while len(_LAID) > HELD:
                _LAID.popitem(last=False)
            yield _LAID[key]

    def bits(self, column: pa.Array) -> np.ndarray:
        """Code length of each text in each language."""
        out = []
        for group in self.groups():
            held = []
            for code, starts, sizes in codes(column):
                bits = np.zeros((len(sizes), group.costs[0].shape[1]))
                full = np.flatnonzero(sizes)
                at = rows_of(starts, sizes)
                ends = np.cumsum(sizes)
                for lo in range(0, len(at), STEP):  # a long text takes several steps
                    hi = min(lo + STEP, len(at))
                    first, last = np.searchsorted(ends, lo, side="right"), np.searchsorted(ends, hi, side="left")
                    own = full[(full >= first) & (full <= last)]
                    cuts = np.maximum(ends[own] - sizes[own], lo) - lo
                    bits[own] += np.add.reduceat(group.cost(code[at[lo:hi]]), cuts, axis=0, dtype=np.float64)
                held.append(bits)
            out.append(np.concatenate(held) if held else np.zeros((0, group.costs[0].shape[1])))
        return np.concatenate(out, 1)


STEP = 1 << 18
_LAID: OrderedDict[tuple[str, int], Group] = OrderedDict()


def train(docs: DataFrame, learn: Column, per_language: int = 1200) -> Trees | None:
    spark = docs.sparkSession
    scratch = Scratch(spark, "language")
    picked = scratch.keep(sample(docs, learn, per_language), "picked")
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(small_side(picked, picked.count()), "doc_id")
    rows = scratch.keep(rows.groupBy("doc_id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("lang", "text"), "sample")

    def tally(batches):
        for batch in batches:
            for lang in batch.column(0).unique():
                seen = [code[rows_of(starts, sizes)] for code, starts, sizes in codes(batch.filter(pc.equal(batch.column(0), lang)).column(1))]
                at, n = np.unique(np.concatenate(seen) if seen else np.zeros(0, np.uint32), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(at), pa.string()), pa.array(at.astype(np.int64)), pa.array(n, pa.int64())], ["lang", "code", "n"])

    # rows of a bounded sample: its distinct runs of four bytes
    full = rows.mapInArrow(tally, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow().sort_by([("lang", "ascending"), ("code", "ascending")])
    names = full["lang"].combine_chunks()
    languages = sorted(x for x in names.unique().to_pylist())
    if not languages:
        return None
    code, n, which = full["code"].to_numpy().astype(np.uint32), full["n"].to_numpy().astype(np.float64), pc.index_in(names, pa.array(languages)).to_numpy()
    return Trees(languages, [(code[which == k], n[which == k]) for k in range(len(languages))])


def scored(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row's whole text."""
    spread = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        trees = spread.value
        for batch in batches:
            column = batch.column(1)
            lettered = np.array([trees is not None and t is not None and any(map(str.isalpha, t)) for t in column.to_pylist()], bool)
            names, share = np.full(len(batch), "und", object), np.zeros(len(batch))
            if lettered.any():
                bits = trees.bits(column.filter(pa.array(lettered)))
                names[lettered] = np.array(trees.languages, object)[bits.argmin(1)]
                share[lettered] = 1 / np.exp2(np.minimum(0, bits.min(1, keepdims=True) - bits)).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(share, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def crc_mod(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def predicted(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; rows whose crc32(doc_id) mod 4 is 2 are held out."""
    return scored(docs, train(docs, crc_mod(4) != 2)).select("doc_id", (crc_mod(4) == 2).alias("held_out"), "lang_pred", "score")

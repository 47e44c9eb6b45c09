"""Exact n-gram Jaccard join with a token-group matrix.

Sets are hashes of distinct word shingles. Documents with equal sets share one representative. Tokens are ordered from
rare to frequent by a frequency sketch of fixed size that counts every shingle of the corpus; any fixed order gives the
same links, a good one makes lists short. Of a set of n tokens the first n - ceil(percent * n / 100) + need(n) are its
prefix: two linked sets share at least need tokens of their prefixes, need being that of the smaller one. Only prefix
tokens are shuffled, and only those that two representatives share, of representatives with enough of them, go on.

Representatives that share prefix tokens are partitioned into groups: labels spread for a few rounds between them and
the smallest representatives that hold their tokens, and a label with many documents is split into blocks of bounded
size. The token-group matrix holds for every prefix token the groups it occurs in, with the lengths found there, where
there can be several. The overlap of a representative's prefix with a group's union bounds that with any member, and a group is opened only when bound and lengths allow a link. In an opened
group the overlaps of all members and visitors are one product of their token matrix with itself, exactly, and what
leaves the task is a spanning forest of the links, never all pairs. Visitors come in bounded portions. Components then
follow by label propagation with pointer jumping over tables in the shared folder.

Nothing is sampled or capped: sketch, labels and blocks only decide where a pair is examined.

Defined cases: null and empty texts have an empty set and link with nothing; documents with fewer words than a shingle
count as one shingle of all their words; rows that share a doc_id are one document, and link if any of their texts does;
rows without doc_id get no component; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparrowmill.llm.scratch import Scratch, small_side
from sparrowmill.llm.shingles import MIX, mixed, shingle_sets

SKETCH_BITS, PARTS = 22, 64
BLOCK_DOCS, BLOCK_TOKENS = 500, 500_000
ROUNDS = 3
IDENTITY = ["fp1", "fp2", "n"]


def linked(overlap: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * overlap >= percent * (n + m - overlap)


def need(n):
    """How many tokens the prefixes of two linked sets share at least, for the smaller set of n tokens."""
    return 1 + n // 20


def prefix_size(n: int, percent: int) -> int:
    """Two linked sets share ``need`` tokens among the first ``prefix_size`` of each, in any common order."""
    return min(n, n - -(-percent * n // 100) + need(n))


def sketch(docs: DataFrame, size: int) -> np.ndarray:
    """For each of 2^SKETCH_BITS buckets of hashes how many shingles fell there, up to 65535.

    A task's count of a bucket is cut at 255: the sketch only puts tokens in order, and that far up the order is the same.
    """
    wide = (1 << SKETCH_BITS) // PARTS

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int32)
        held, n = [], 0
        for batch in batches:
            for s in shingle_sets(batch.column(0), size):
                held.append((s >> np.uint64(64 - SKETCH_BITS)).astype(np.int32))
                n += len(s)
                if n > 1 << 19:
                    total += np.bincount(np.concatenate(held), minlength=len(total)).astype(np.int32)
                    held, n = [], 0
        if n:
            total += np.bincount(np.concatenate(held), minlength=len(total)).astype(np.int32)
        if total.any():
            low = np.minimum(total, 255).astype(np.uint8).reshape(PARTS, wide)
            salt = TaskContext.get().partitionId() // 16
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(PARTS), pa.int32()), pa.array([salt] * PARTS, pa.int32()), pa.array([x.tobytes() for x in low], pa.binary())], ["part", "salt", "counts"])

    def summed(kind, to):
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            total = np.zeros(wide, np.int64)
            for x in frame["counts"]:
                total += np.frombuffer(x, kind)
            return pd.DataFrame({"part": [frame["part"].iloc[0]], "salt": [0], "counts": [np.minimum(total, 65535).astype(to).tobytes()]})

        return run

    schema = "part int, salt int, counts binary"
    parts = docs.select("text").mapInArrow(count, schema)
    parts = parts.groupBy("part", "salt").applyInPandas(summed(np.uint8, np.uint16), schema).groupBy("part").applyInPandas(summed(np.uint16, np.uint16), schema)
    total = np.zeros((PARTS, wide), np.uint16)
    for r in parts.toLocalIterator():  # 8 MB whatever the corpus
        total[r.part] = np.frombuffer(r.counts, np.uint16)
    return total.ravel()


def summaries(docs: DataFrame, size: int, percent: int, counts: np.ndarray) -> DataFrame:
    """Per row: doc_id, n, a 128-bit fingerprint of the set, and the prefix tokens in common order."""
    spread = docs.sparkSession.sparkContext.broadcast(counts)  # 8 MB whatever the corpus

    def run(batches):
        count = spread.value
        for batch in batches:
            n, a, b, prefixes = [], [], [], []
            for s in shingle_sets(batch.column(1), size):
                n.append(len(s))
                x = mixed(s + MIX[0])
                a.append(int(np.add.reduce(x)) if len(s) else 0)
                b.append(int(np.bitwise_xor.reduce(mixed(x))) if len(s) else 0)
                order = np.argsort(count[s >> np.uint64(64 - SKETCH_BITS)], kind="stable")  # equal counts by hash
                prefixes.append(s[order[: prefix_size(len(s), percent)]].view(np.int64))
            ints = lambda v: pa.array(np.asarray(v, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), ints(a), ints(b), pa.array(prefixes, pa.list_(pa.int64()))], ["doc_id", "n", "fp1", "fp2", "prefix"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n bigint, fp1 bigint, fp2 bigint, prefix array<bigint>")


def perhaps(rows: DataFrame, key: list[str], wanted: DataFrame, how: str = "left") -> DataFrame:
    """``rows`` (joined inner: those that can be true, at least) with ``maybe``: true for every key of ``wanted`` and few others, by a bit filter of 2^18 rows at most whatever the number of keys."""
    bits = 23
    slot = F.shiftrightunsigned(F.xxhash64(*key), 64 - bits)
    words = wanted.select(slot.alias("slot")).select(F.shiftright("slot", 5).alias("word"), F.expr("shiftleft(1L, cast(slot & 31 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    found = rows.withColumn("slot", slot).withColumn("word", F.shiftright("slot", 5)).join(F.broadcast(words), "word", how)
    return found.withColumn("maybe", F.expr("shiftright(coalesce(bits, 0L), cast(slot & 31 as int)) & 1 = 1")).select(*rows.columns, "maybe")


def representatives(rows: DataFrame, copied: DataFrame) -> DataFrame:
    """(rep, prefix) of the smallest doc_id of every class. Only rows that the bit filter can't tell from those of ``copied`` classes are shuffled."""
    told = perhaps(rows.where("n > 0 AND doc_id IS NOT NULL"), IDENTITY, copied)
    alone = told.where("NOT maybe").select(F.col("doc_id").alias("rep"), "prefix")
    first = told.where("maybe").groupBy(*IDENTITY).agg(F.min(F.struct("doc_id", "prefix")).alias("first"))
    return alone.unionByName(first.select(F.col("first.doc_id").alias("rep"), "first.prefix"))


def enough(percent: int):
    """Tokens that a set of n_low tokens or more shares at least with the prefix of a set that it links with."""
    return F.expr(f"1 + ceil({percent} * n_low / 100) DIV 20")


def grouped(tokens: DataFrame, named: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(rep, home, block, n_low, n_high) of every representative that shares enough tokens: labels along hubs, split into bounded blocks.

    The hub of a token is its smallest representative. Near copies share most of their tokens, so there are far fewer pairs of
    a representative and a hub than tokens, and labels reach over them whom they reach over tokens.
    """
    hubs = scratch.keep(tokens.groupBy("rep", "hub").agg(F.count("*").alias("k")), "hubs")
    sizes = named.where("doc_id = rep AND n > 0").groupBy("rep").agg(F.min("n").alias("n_low"), F.max("n").alias("n_high"))
    able = hubs.groupBy("rep").agg(F.min("hub").alias("home"), F.sum("k").alias("k")).join(sizes, "rep")
    homes = scratch.keep(able.where(F.col("k") >= enough(percent)).drop("k"), "homes")
    hubs = scratch.keep(hubs.join(homes.select("rep"), "rep").select("rep", "hub"), "hubs")
    for _ in range(ROUNDS):
        labels = scratch.keep(hubs.join(homes.select("rep", "home"), "rep").groupBy("hub").agg(F.min("home").alias("label")), "spread")
        better = hubs.join(labels, "hub").groupBy("rep").agg(F.min("label").alias("label"))
        homes = scratch.keep(homes.join(better, "rep").select("rep", F.least("home", "label").alias("home"), "n_low", "n_high"), "homes")
    sizes = homes.groupBy("home").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n_high") / BLOCK_TOKENS)).alias("blocks"))
    return scratch.keep(homes.join(sizes, "home").select("rep", "home", F.pmod(F.xxhash64("rep"), "blocks").cast("int").alias("block"), "n_low", "n_high"), "groups"), hubs


def openings(tokens: DataFrame, groups: DataFrame, hubs: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(home, block, rep, guest): members and visitors of every group to open."""
    group = F.struct("home", "block")
    several = hubs.join(groups, "rep").groupBy("hub").agg(F.min(group).alias("first"), F.max(group).alias("last")).where("first <> last")
    rows = perhaps(tokens, ["hub"], several, "inner").where("maybe").select("rep", "token").join(groups, "rep")  # all tokens of other hubs are in one group
    rows = scratch.keep(rows, "rows")
    matrix = rows.groupBy("token", F.col("home").alias("to_home"), F.col("block").alias("to_block")).agg(F.min("n_low").alias("n_min"), F.max("n_high").alias("n_max"))
    visits = (
        rows.join(matrix, "token")
        .where("home < to_home OR home = to_home AND block < to_block")
        .where(f"n_max * 100 >= {percent} * n_low AND n_high * 100 >= {percent} * n_min")
        .groupBy(F.col("to_home").alias("home"), F.col("to_block").alias("block"), "rep", "n_low")
        .agg(F.count("*").alias("bound"))
        .where(F.col("bound") >= enough(percent))
        .select("home", "block", "rep")
    )
    both = groups.select("home", "block", "rep", F.lit(False).alias("guest")).unionByName(visits.withColumn("guest", F.lit(True)))
    both = scratch.keep(both, "openings")
    busy = both.groupBy("home", "block").agg(F.count("*").alias("k"), F.sum(F.col("guest").cast("int")).alias("guests")).where("k > 1")
    busy = busy.select("home", "block", F.greatest(F.lit(1), F.ceil(F.col("guests") / BLOCK_DOCS)).cast("int").alias("portions"))
    dealt = both.join(busy, ["home", "block"])
    portion = F.when(F.col("guest"), F.array(F.pmod(F.xxhash64("rep"), "portions").cast("int"))).otherwise(F.sequence(F.lit(0), F.col("portions") - 1))
    return scratch.keep(dealt.select("home", "block", "rep", "guest", F.explode(portion).alias("portion")), "portions")


def sets_of(docs: DataFrame, opened: DataFrame, size: int) -> DataFrame:
    """``opened`` with the tokens of each document. The bit filter keeps most other texts out of the shuffle; the join after it is exact."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.view(np.int64) for s in shingle_sets(batch.column(1), size)], pa.list_(pa.int64()))], ["rep", "tokens"])

    rows = perhaps(docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("rep"), "text"), ["rep"], opened, "inner").where("maybe").select("rep", "text")
    return rows.mapInArrow(run, "rep bigint, tokens array<bigint>").join(opened, "rep")


def components(link: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the smallest row that it reaches."""
    label = np.arange(len(link))
    while True:
        least = np.where(link, label[None, :], len(link)).min(1, initial=len(link))
        now = np.minimum(label, least)
        now = now[now]
        if (now == label).all():
            return label
        label = now


def spanned(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Spanning links (a, b) of one opened group: all pairs with a member, by the product of the token matrix with itself."""
    frame = frame.sort_values(["rep", "guest"])
    reps, guest = frame["rep"].to_numpy(), frame["guest"].to_numpy(bool)
    sets = [np.asarray(t, np.int64) for t in frame["tokens"]]
    n = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    keep = count[column] > 1
    column, owner = column[keep], owner[keep]
    renumber = np.cumsum(count > 1) - 1
    column = renumber[column]
    overlap = np.zeros((len(sets), len(sets)))  # doubles add up whole numbers exactly
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        overlap += part @ part.T
    link = linked(overlap.astype(np.int64), n.astype(np.int64)[:, None], n.astype(np.int64)[None, :], percent)
    link[np.ix_(guest, guest)] = False  # two visitors meet in a group of their own
    label = components(link)
    far = label != np.arange(len(sets))
    return pd.DataFrame({"a": reps[label[far]], "b": reps[far]})


def labelled(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label): the smallest node that each node of ``links`` (a, b) reaches."""
    edges = scratch.keep(links.selectExpr("a AS node", "b AS other").unionByName(links.selectExpr("b AS node", "a AS other")).where("node <> other").distinct(), "edges")
    now = scratch.keep(edges.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), "labels")
    while True:
        near = edges.join(now.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        step = now.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        jump = now.select(F.col("node").alias("next"), F.col("label").alias("beyond"))
        new = scratch.keep(step.join(jump, "next", "left").select("node", "label", F.least("next", F.coalesce("beyond", "next")).alias("next")), "labels")
        changed = new.where("label <> next").limit(1).count()
        now = new.select("node", F.col("next").alias("label"))
        if not changed:
            return now


def joined(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links of percent / 100 or more)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    scratch = Scratch(spark, "jaccard")
    rows = scratch.keep(summaries(docs, size, percent, sketch(docs, size)), "sets")
    copied = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy(*IDENTITY).agg(F.min("doc_id").alias("rep"), F.count("*").alias("k")).where("k > 1").drop("k")
    copied = scratch.keep(copied, "copied")
    named = scratch.keep(rows.drop("prefix").join(copied, IDENTITY, "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")), "named")
    same = Window.partitionBy("token")
    tokens = representatives(rows, copied).select("rep", F.explode("prefix").alias("token")).withColumns({"hub": F.min("rep").over(same), "last": F.max("rep").over(same)})
    tokens = scratch.keep(tokens.where("hub < last").drop("last"), "tokens")
    scratch.drop(rows)  # the prefixes of all sets, the largest table here
    groups, hubs = grouped(tokens, named, percent, scratch)
    opened = openings(tokens, groups, hubs, percent, scratch)
    scratch.drop(tokens)
    links = sets_of(docs, opened, size).groupBy("home", "block", "portion").applyInPandas(lambda f: spanned(f, percent), "a bigint, b bigint")
    label = labelled(links, scratch).withColumnsRenamed({"node": "rep", "label": "component"})
    return named.join(label, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component; rows without doc_id stay."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    gone = scratch.keep(joined(docs, size, percent).where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    return docs.join(small_side(gone, gone.count()), "doc_id", "left_anti").select(*docs.columns)

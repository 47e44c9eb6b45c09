"""Line dedup by a deletion-neighbourhood join.

Lines are word sequences (white space apart, A-Z read as a-z); two lines are near when one word put in, taken out or
replaced makes them equal. Lines are ordered by (doc_id, number in the document), and a line goes when an equal or near
line stands before it; lines of fewer than ``MIN_WORDS`` words go only for an equal one.

Equal lines are grouped by a 128-bit digest of their words first. A sieve then spares most lines the neighbourhood: of two near lines of m and m or
m + 1 words, the first or the last m // 2 words agree, so only lines that share such a half with another distinct line go
on. Their first occurrences are found again through a bit filter sized by their count, or beyond ``FILTER_LINES`` of them by
a join with their documents; what a filter lets through besides costs work and changes nothing. They emit their variants
with one word deleted as hashed keys. Lines with the same variant and deleted place are all near to each other, and a line
that equals a variant is near to the line it came from, so the earliest of each group is a minimum and no pairs are ever
listed. Each line's earliest neighbour is verified on the words themselves, whose text is joined to the pairs that met.

Only hashes are shuffled, the text of lines with an earlier neighbour, and at the end the texts of documents to cut them.
Defined cases: null texts have no lines and stay null; blank lines stay; rows without doc_id pass unchanged and are compared
with nothing; rows that share a doc_id are one document and are cut alike; very long lines and texts are read whole; an
empty table gives no rows; columns of documents named n_lines or n_dropped give way to the operator's.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowmill.llm.scratch import Scratch
from sparrowmill.llm.shingles import LOWER, MIX, SPACE, Sums, mixed, texts, word_hashes

MIN_WORDS = 5
#: first occurrences up to which a bit filter (64 MB at most) finds them; 32 bits for each, two of which are set
FILTER_LINES, BITS_PER_LINE = 1 << 24, 32


class Lines:
    """The lines of a run of rows: row, number, word count, and hashes of any part of a line from running sums."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        spaced = np.full(len(data) + n, 10, np.uint8)
        row = np.repeat(np.arange(n), np.diff(offsets))
        spaced[np.arange(len(data)) + row] = data
        ends = np.flatnonzero(spaced == 10)  # each row ends with a line feed of ours
        begins = np.r_[0, ends[:-1] + 1] if len(ends) else ends
        last = offsets[1:] + np.arange(n)  # where ours are
        self.row = np.searchsorted(last, begins, side="left") if n else begins
        number = np.arange(len(begins))
        self.number = number - number[np.searchsorted(self.row, self.row)] if len(begins) else number
        self.row = self.row + first
        self.hashes, starts = word_hashes(spaced)
        self.at = np.searchsorted(starts, begins)
        self.words = np.diff(np.r_[self.at, len(starts)])
        self.begins, self.ends, self.bytes = begins, ends, spaced
        self.sums = Sums(self.hashes)

    def key(self, plain: np.ndarray, n: np.ndarray, kind: int) -> np.ndarray:
        """A key of both remainders of n words; lines that it takes for alike are compared word by word later."""
        both = plain[0] << np.uint64(31) | plain[1]
        return mixed(both + n.astype(np.uint64) * MIX[0] + np.uint64(kind * int(MIX[1]) % (1 << 64))).view(np.int64)

    def own(self) -> np.ndarray:
        return self.key(self.sums.part(self.at, self.at + self.words), self.words, 0)

    def digests(self, lines: np.ndarray) -> np.ndarray:
        """The ``digest`` of each of the lines (with one word or more) as two 64-bit numbers."""
        space = SPACE[self.bytes]
        kept = ~space | np.r_[False, ~space[:-1]]  # words and one byte behind each
        plain, after = np.where(space, np.uint8(32), LOWER[self.bytes])[kept].tobytes(), np.r_[0, np.cumsum(kept)]
        cuts = zip(after[self.begins[lines]].tolist(), after[self.ends[lines] + 1].tolist(), strict=True)
        found = b"".join(blake2b(plain[a:b].strip(b" "), digest_size=16).digest() for a, b in cuts)
        return np.frombuffer(found, np.int64).reshape(-1, 2)

    def halves(self) -> np.ndarray:
        """Four keys for each line: first and last m // 2 and (m - 1) // 2 words."""
        out = []
        for b in (self.words // 2, np.maximum(self.words - 1, 0) // 2):
            out += [self.key(self.sums.part(self.at, self.at + b), b, 1), self.key(self.sums.part(self.at + self.words - b, self.at + self.words), b, 2)]
        return np.column_stack(out)

    def variants(self, line: int) -> np.ndarray:
        """Hashes of the line with each word deleted, equal to ``own`` of a line that reads so."""
        m = self.words[line]
        return self.key(self.sums.without(self.at[line], m), np.full(m, m - 1), 0)

    def text(self, line: int) -> str:
        return self.bytes[self.begins[line] : self.ends[line]].tobytes().decode("utf-8", "replace")


def lines_of(column: pa.Array) -> Iterator[Lines]:
    for first, data, offsets in texts(column):
        yield Lines(first, data, offsets)


def place(doc_id: np.ndarray, number: np.ndarray) -> np.ndarray:
    """One 64-bit value for a line's place."""
    return mixed(doc_id.astype(np.int64).view(np.uint64) * MIX[0] + number.astype(np.uint64)).view(np.int64)


HALVES = ("half0", "half1", "half2", "half3")


def hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, number, h, h2, halves) of each line that isn't blank; h and h2 are its digest, halves are null for fewer than MIN_WORDS words."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for x in lines_of(batch.column(1)):
                keep = np.flatnonzero(x.words > 0)
                own, halves, short = x.digests(keep), x.halves()[keep], x.words[keep] < MIN_WORDS
                doc, number = ids[x.row[keep]], x.number[keep]
                columns = [pa.array(doc, pa.int64()), pa.array(number, pa.int32()), *(pa.array(own[:, k], pa.int64()) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(halves[:, k], pa.int64(), mask=short) for k in range(4)], ["doc_id", "number", "h", "h2", *HALVES])

    return docs.mapInArrow(run, "doc_id bigint, number int, h bigint, h2 bigint, " + ", ".join(f"{c} bigint" for c in HALVES))


class BitFilter:
    """Bits of the places in a table, as many as its counted rows ask for; each sets one by its high and one by its low end."""

    def __init__(self, places: DataFrame, count: int):
        self.size = max(12, (BITS_PER_LINE * count - 1).bit_length())
        slots = places.select(F.explode(F.array(F.shiftrightunsigned("place", 64 - self.size), F.col("place").bitwiseAND(F.lit((1 << self.size) - 1)))).alias("slot"))
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("slot").bitwiseAND(F.lit(63)).cast("int"))
        found = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
        self.bits = np.zeros(1 << (self.size - 6), np.int64)
        self.bits[found["word"].to_numpy()] = found["bits"].to_numpy()

    def has(self, places: np.ndarray) -> np.ndarray:
        high, low = (places.view(np.uint64) >> np.uint64(64 - self.size)).view(np.int64), places & ((1 << self.size) - 1)
        return (self.bits[high >> 6] >> (high & 63)) & (self.bits[low >> 6] >> (low & 63)) & 1 == 1


def neighbourhood(docs: DataFrame, wanted: BitFilter | None) -> DataFrame:
    """(v, i, doc_id, number, text): for each wanted line itself (i = -1, with its text) and its variants without word i.

    Wanted are lines in the filter; without one, ``docs`` has a third column with the sorted numbers of a document's.
    """
    spread = docs.sparkSession.sparkContext.broadcast(wanted)

    def hits(batch, x, ids):
        if spread.value is not None:
            return spread.value.has(place(ids[x.row], x.number))
        asked = batch.column(2)
        cuts, numbers = np.asarray(asked.offsets), asked.values.to_numpy()
        keys = np.repeat(np.arange(len(batch)), np.diff(cuts)) << 32 | numbers[cuts[0] : cuts[-1]]
        return np.isin(x.row << 32 | x.number, keys)

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for x in lines_of(batch.column(1)):
                v, i, doc, number, text = [], [], [], [], []
                own = x.own()
                for k in np.flatnonzero(hits(batch, x, ids) & (x.words >= MIN_WORDS)):
                    m = int(x.words[k])
                    v += [own[k : k + 1], x.variants(k)]
                    i.append(np.arange(-1, m, dtype=np.int32))
                    doc.append(np.full(m + 1, ids[x.row[k]], np.int64))
                    number.append(np.full(m + 1, x.number[k], np.int32))
                    text += [x.text(k)] + [None] * m
                if v:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (v, i, doc, number)] + [pa.array(text, pa.string())], ["v", "i", "doc_id", "number", "text"])

    return docs.mapInArrow(run, "v bigint, i int, doc_id bigint, number int, text string")


def near(a: list[str], b: list[str]) -> bool:
    """Whether at most one word put in, taken out or replaced makes two word lists equal."""
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :] or a == b


def low_words(text: str) -> list[bytes]:
    return text.encode().lower().split()


def digest(words: list[bytes]) -> bytes:
    """128 bits that tell lines apart: of the words with one blank between them."""
    return blake2b(b" ".join(words), digest_size=16).digest()


def wanted_lines(docs: DataFrame, distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """The neighbourhoods of the distinct lines that share a half with another."""
    halves = F.array_distinct(F.array(*HALVES))
    keys = distinct.where("half0 IS NOT NULL").select("place", F.explode(halves).alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key")
    passed = scratch.keep(keys.join(shared, "key", "left_semi").select("place").distinct(), "passed")
    count = passed.count()
    if count <= FILTER_LINES:
        return neighbourhood(docs, BitFilter(passed, count))
    numbers = distinct.join(passed, "place", "left_semi").groupBy("doc_id").agg(F.sort_array(F.collect_list("number")).alias("numbers"))  # the lines of one document
    return neighbourhood(docs.join(numbers, "doc_id").select("doc_id", "text", "numbers"), None)


def dropped(docs: DataFrame) -> DataFrame:
    """(doc_id, number) of every line that goes."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    known = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    lines = scratch.keep(hashed(known), "lines")
    line = F.struct("doc_id", "number")
    distinct = lines.groupBy("h", "h2").agg(F.min(line).alias("first"), F.count("*").alias("k"), *(F.first(c).alias(c) for c in HALVES))
    distinct = scratch.keep(distinct.select("h", "h2", "first.doc_id", "first.number", "k", *HALVES).mapInArrow(placed, "h bigint, h2 bigint, doc_id bigint, number int, k bigint, place bigint, " + ", ".join(f"{c} bigint" for c in HALVES)), "distinct")
    rows = scratch.keep(wanted_lines(known, distinct, scratch), "variants")
    by_place = rows.groupBy("v", "i").agg(F.min(line).alias("e"), F.count("*").alias("k"))
    by_variant = by_place.groupBy("v").agg(F.min(F.when(F.col("i") < 0, F.col("e"))).alias("whole"), F.min(F.when(F.col("i") >= 0, F.col("e"))).alias("cut"), F.sum("k").alias("k")).where("k > 1")
    best = by_place.join(by_variant.drop("k"), "v").select("v", "i", F.when(F.col("i") < 0, F.col("cut")).otherwise(F.least("e", "whole")).alias("best"))
    met = rows.select("v", "i", "doc_id", "number").join(best, ["v", "i"]).where(F.col("best") < line)
    pairs = met.groupBy("doc_id", "number").agg(F.min("best").alias("best")).select("doc_id", "number", F.col("best.doc_id").alias("to_doc"), F.col("best.number").alias("to_number"))
    pairs = scratch.keep(pairs, "pairs")
    words = rows.where("i = -1").groupBy("doc_id", "number").agg(F.min(F.struct("v", "text")).alias("x")).select("doc_id", "number", "x.text")
    theirs = words.select(F.col("doc_id").alias("to_doc"), F.col("number").alias("to_number"), F.col("text").alias("to_text"))
    both = pairs.join(words, ["doc_id", "number"]).join(theirs, ["to_doc", "to_number"])

    def verify(batches):
        for batch in batches:
            pairs = [(low_words(a), low_words(b)) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            ok = [near(a, b) for a, b in pairs]
            found = np.frombuffer(b"".join(digest(a) for (a, _), yes in zip(pairs, ok, strict=True) if yes), np.int64).reshape(-1, 2)
            stay = batch.select(["doc_id", "number"]).filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), *stay.columns], ["h", "h2", "doc_id", "number"])

    told = both.select("doc_id", "number", "text", "to_text").mapInArrow(verify, "h bigint, h2 bigint, doc_id bigint, number int").distinct()
    # a filter may have let later copies through, whose neighbour is their first occurrence: only that one speaks for a line
    late = told.withColumn("late", F.lit(True))
    kept = distinct.select("h", "h2", "doc_id", "number", "k").join(late, ["h", "h2", "doc_id", "number"], "left").where("k > 1 OR late")
    kept = scratch.keep(kept.select("h", "h2", F.col("doc_id").alias("first_doc"), F.col("number").alias("first_number"), "late"), "kept")
    return lines.select("doc_id", "number", "h", "h2").join(kept, ["h", "h2"]).where("late OR NOT (doc_id = first_doc AND number = first_number)").select("doc_id", "number").distinct()


def placed(batches):
    """Rows with the place of their line put in."""
    for batch in batches:
        at = place(batch.column(2).to_numpy(), batch.column(3).to_numpy())
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(at, pa.int64()), *batch.columns[5:]], ["h", "h2", "doc_id", "number", "k", "place", *HALVES])


def cleaned(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` without the lines that go, and n_lines and n_dropped (0 for null texts)."""
    gone = dropped(docs).groupBy(F.col("doc_id").alias("gone_id")).agg(F.sort_array(F.collect_list("number")).alias("gone"))  # the lines of one document
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    held = docs.select(F.struct(*docs.columns).alias("row"))
    split = F.when(F.col("row.text").isNotNull(), F.split("row.text", "\n"))
    joined = held.join(gone, F.col("row.doc_id") == F.col("gone_id"), "left").select("row", "gone", split.alias("lines"))
    # what stays are the stretches between the lines that go
    stay = F.expr("flatten(transform(sequence(0, size(gone)), k -> slice(lines, coalesce(get(gone, k - 1), -1) + 2, coalesce(get(gone, k), size(lines)) - coalesce(get(gone, k - 1), -1) - 1)))")
    text = F.when(F.col("gone").isNull() | F.col("lines").isNull(), F.col("row.text")).otherwise(F.array_join(stay, "\n"))
    return joined.select(
        *(text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in names),
        F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).alias("n_dropped"),
    )


def told(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, text_sha256 of the text that stays (null counts as empty)."""
    return cleaned(docs.select("doc_id", "text")).select("doc_id", F.col("n_lines").cast("bigint"), F.col("n_dropped").cast("bigint"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))

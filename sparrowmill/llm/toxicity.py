"""Toxicity: a subsequence string-kernel support vector machine with Nystroem landmarks, trained on labelled sentences.

Texts are read in a normal form: accents and case apart, figures and signs written for letters as those letters, signs
dropped, also those inside a word ("l.o.s.e.r"), blanks between single letters dropped ("l o s e r"), letters of other
scripts dealt to the 26 by their number. The kernel of two words, blanks around them included, is the gap-weighted count of
the subsequences of four characters that they share, each weighted by LAMBDA to the power of the characters skipped, within a
stretch of six, so that insults with gaps or inserted characters stay close to the plain word; it is divided by a norm that
goes with the words' lengths. Words of over 2 * CELL characters are read as stretches of that length that overlap by half.
A sentence is as toxic as its worst word.

Training reads a bounded sample: at most ``per_class`` labelled rows of each class, those with the smallest hash of the
id. A label holds for all sentences of a document, so words are labelled in rounds: those of clean sentences are negative,
and each toxic document has one witness, at first the word that is most significantly more frequent in toxic documents,
later the one among such words that the machine finds worst; copies of witnesses with an inserted character are added.
Negative words are the frequent ones, a bounded draw, and those the last machine took for toxic. Kernel values against
``landmarks`` words of either side are whitened by the landmarks' own kernel matrix and a linear machine with squared hinge
loss is trained on them. As features of the kernel are explicit here, the machine folds into one weight for each
subsequence, which makes scoring a word a sum of table lookups.

Scoring reads whole texts in tasks, each distinct word of a portion once; a document is judged by the decisions of its three
worst words, by how many of its distinct words lie on the toxic side, and by how many it has, mapped to 0..1 by a logistic
curve fitted on the sample: a long clean text may hold one odd word by chance. Texts of over LONG characters are laid out in
parts, cut between two words alone.

Defined cases: null and empty texts score as a text without any word (the lowest score); labels that are null are not
learned from; a doc_id labelled twice counts as toxic if one label says so; without labelled rows of both classes every
score is 0; an empty table gives no rows; repeated rows score alike; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowmill.llm.scratch import Scratch
from sparrowmill.llm.shingles import runs, span_hashes

LAMBDA, CELL, CHUNK, LONG = 0.6, 16, 1 << 19, 1 << 21
FEATURES = 1 << 20
#: offsets of the second, third and fourth character of a subsequence
STEPS = [(a, b, c) for c in range(3, 6) for b in range(2, c) for a in range(1, b)]
PAD, SIGN, BLANK = 0, 28, 29
#: fixed values: figures and signs written for letters
LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
UNKNOWN = 255
_KIND = np.full(0x110000, UNKNOWN, np.uint8)
_SHOWN = np.frombuffer(b"\0abcdefghijklmnopqrstuvwxyz   ", np.uint8)
_CODES = np.full(256, PAD, np.uint8)
_CODES[97:123], _CODES[32] = np.arange(1, 27), BLANK


def kind(c: str) -> int:
    """1 to 26 for letters, else PAD, SIGN or BLANK."""
    if c == "\0" or c.isspace():
        return BLANK if c != "\0" else PAD
    base = unicodedata.normalize("NFKD", LOOKALIKE[c] if c.isdigit() and c in LOOKALIKE else c)[:1].lower()
    return ord(base) - 96 if "a" <= base <= "z" else 1 + ord(c) * 7 % 26 if c.isalpha() else SIGN


def normal_form(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts, each between blanks, and where each text ends."""
    whole = np.frombuffer("".join(f" {t or ''} \0" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    c = _KIND[whole]
    for x in np.unique(whole[c == UNKNOWN]):
        _KIND[x] = kind(chr(x))
    c = _KIND[whole]
    after = np.r_[c[1:], np.uint8(PAD)]
    for sign in "@$!":  # letters if a letter follows
        c[(whole == ord(sign)) & (after > 0) & (after <= 26)] = ord(LOOKALIKE[sign]) - 96
    ends = np.cumsum([len(t or "") + 3 for t in texts])

    def keep(c, ends, stay):
        kept = np.cumsum(stay)
        return c[stay], kept[ends - 1]

    c, ends = keep(c, ends, c != SIGN)
    c, ends = keep(c, ends, (c != BLANK) | (np.r_[np.uint8(PAD), c[:-1]] != BLANK))
    letter = (c > 0) & (c <= 26)
    alone = letter & np.r_[True, ~letter[:-1]] & np.r_[~letter[1:], True]
    return keep(c, ends, ~((c == BLANK) & np.r_[False, alone[:-1]] & np.r_[alone[1:], False]))


#: a blank between two words of two letters or more, where a cut changes no word
BETWEEN = re.compile(r"[^\W\d_]{2}\s(?=[^\W\d_]{2})")


def parts(text: str) -> Iterator[str]:
    """A very long text in parts of LONG characters or more, cut only where neither a word nor a run of single letters ends."""
    at = 0
    while at < len(text):
        found = BETWEEN.search(text, at + LONG)
        cut = found.end() if found else len(text)
        yield text[at:cut]
        at = cut


def words_of(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each run of letters."""
    starts, ends = runs((c > 0) & (c <= 26))
    return starts, ends, span_hashes(c, starts, ends)


def subsequences(c: np.ndarray) -> Iterator[tuple[np.ndarray, np.float32]]:
    """Number and weight of the subsequences that begin at each code, one pattern of gaps after the other."""
    n = len(c)
    held = np.r_[c.astype(np.int32), np.zeros(5, np.int32)]
    at = held[:n] << 15
    for a, b, d in STEPS:
        yield at | held[a : a + n] << 10 | held[b : b + n] << 5 | held[d : d + n], np.float32(LAMBDA ** (d - 3))


def without_pads(table: np.ndarray) -> np.ndarray:
    """No weight for subsequences that run into a PAD."""
    cube = table.reshape(32, 32, 32, 32)
    cube[0] = cube[:, 0] = cube[:, :, 0] = cube[..., 0] = 0
    return table


def laid(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the given words one after the other, each with the blanks around it and PADs behind, and where each begins."""
    sizes = ends - starts + 7
    begins = np.cumsum(sizes) - sizes
    at = np.arange(sizes.sum()) - np.repeat(begins, sizes)
    size = np.repeat(ends - starts, sizes)
    inside = (at >= 1) & (at <= size)
    source = np.where(inside, np.repeat(starts, sizes) + at - 1, 0)
    return np.where(inside, c[source], np.where((at == 0) | (at == size + 1), BLANK, PAD)).astype(np.uint8), begins


def worst_stretch(value: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per word the highest sum over two cells in a row, divided by the norm of that length."""
    cells = -(-sizes // CELL)
    word = np.repeat(np.arange(len(begins)), cells)
    number = np.arange(len(word)) - np.repeat(np.cumsum(cells) - cells, cells)
    starts = begins[word] + number * CELL
    long = np.minimum(sizes[word] - number * CELL, CELL)
    sums = np.add.reduceat(value, starts, dtype=np.float64)
    more = np.r_[word[1:] == word[:-1], False]
    sums[:-1] += np.where(more[:-1], sums[1:], 0)
    long[:-1] += np.where(more[:-1], long[1:], 0)
    out = np.full(len(begins), -np.inf)
    np.maximum.at(out, word, np.where(more | (number == 0), sums / NORM[long], -np.inf))
    return out


#: length norm: a word of n letters has n + 2 codes with its blanks
NORM = np.sqrt([max(1.0, sum(max(0, n + 2 - d) * LAMBDA ** (2 * (d - 3)) for _, _, d in STEPS)) for n in range(2 * CELL + 1)])


@dataclass
class Machine:
    """Weights of all subsequences, bias, and the logistic curve over what ``summaries`` gives."""

    weights: np.ndarray
    bias: float
    curve: np.ndarray | None = None

    def words(self, c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Decision of each of the given words, by portions."""
        out, cuts = [], np.searchsorted(np.cumsum(ends - starts + 7), np.arange(0, int((ends - starts + 7).sum()) + CHUNK, CHUNK))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi > lo:
                codes, begins = laid(c, starts[lo:hi], ends[lo:hi])
                value = np.zeros(len(codes), np.float32)
                for index, weight in subsequences(codes):
                    value += weight * self.weights[index]
                out.append(worst_stretch(value, begins, ends[lo:hi] - starts[lo:hi]))
        return np.concatenate(out) + self.bias if out else np.zeros(0)

    def summaries(self, texts: list[str | None]) -> np.ndarray:
        """Per text: the three highest decisions, and logarithms of how many are above 0 and of how many there are."""
        out, at = [], 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to] or "") <= CHUNK):
                size += len(texts[to] or "")
                to += 1
            found = [self._distinct(texts[at:to])] if size <= LONG else [self._distinct([x]) for x in parts(texts[at])]
            text, word, f = (np.concatenate(x) for x in zip(*found, strict=True))
            if len(found) > 1:
                word, first = np.unique(word, return_index=True)
                text, f = text[first], f[first]
            out.append(summary(f, text, to - at))
            at = to
        return np.concatenate(out) if out else np.zeros((0, 5))

    def _distinct(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, hash, decision) of the distinct words of each text."""
        c, text_ends = normal_form(texts)
        starts, ends, hashes = words_of(c)
        known, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        n = max(1, len(first))
        text, word = np.divmod(np.unique(np.searchsorted(text_ends, starts, side="right") * n + which), n)
        return text, known[word], self.words(c, starts[first], ends[first])[word]

    def score(self, summaries: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(summaries @ self.curve[:-1] + self.curve[-1], -30, 30)))


NO_WORD = -3.0


def summary(f: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    out = np.full((n, 5), NO_WORD)
    order = np.lexsort([-f, text])
    f, text = np.maximum(f[order], NO_WORD), text[order]
    place = np.arange(len(f)) - np.searchsorted(text, text)
    top = place < 3
    out[text[top], place[top]] = f[top]
    out[:, 3] = np.log1p(np.bincount(text[f > 0], minlength=n))
    out[:, 4] = np.log1p(np.bincount(text, minlength=n))
    return out


def coded(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of words of the normal form, and where each starts and ends."""
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    sizes = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    return _CODES[raw] if len(raw) else np.zeros(1, np.uint8), starts, starts + sizes


def distinct_words(text: str | None) -> list[str]:
    """The distinct words of a text in the normal form; a long word as the stretches that scoring reads."""
    words = _SHOWN[normal_form([text])[0]].tobytes().decode().replace("\0", " ").split()
    return sorted({w[at : at + 2 * CELL] for w in words for at in range(0, max(1, len(w) - CELL), CELL)})


class Landmarks:
    """Explicit features of the landmark words, and the kernel of any strings against them."""

    def __init__(self, words: list[str]):
        codes, _ = laid(*coded(words))
        seen = np.zeros(FEATURES, np.float32)
        for index, _ in subsequences(codes):
            seen[index] = 1
        self.used = np.flatnonzero(without_pads(seen))
        self.slot = np.full(FEATURES, len(self.used), np.int32)
        self.slot[self.used] = np.arange(len(self.used))
        self.marks = self.rows(words)
        values, vectors = np.linalg.eigh((self.marks @ self.marks.T).astype(np.float64))
        keep = values > 1e-6 * values.max()
        self.whiten = vectors[:, keep] / np.sqrt(values[keep])

    def rows(self, words: list[str]) -> np.ndarray:
        """Features of words, those of landmarks only."""
        c, starts, ends = coded(words)
        codes, begins = laid(c, starts, ends)
        owner = np.repeat(np.arange(len(words)), ends - starts + 7)
        width = len(self.used) + 1
        out = np.zeros(len(words) * width, np.float32)
        for index, w in subsequences(codes):
            slot = self.slot[index]
            hit = slot < width - 1
            out += w * np.bincount(owner[hit] * width + slot[hit], minlength=len(out)).astype(np.float32)
        return out.reshape(len(words), width)[:, :-1] / NORM[ends - starts][:, None]

    def kernel(self, strings: list[str]) -> np.ndarray:
        """Whitened kernel values of words."""
        parts = [self.rows(strings[at : at + 200]) @ self.marks.T @ self.whiten for at in range(0, len(strings), 200)]
        return np.concatenate(parts) if parts else np.zeros((0, self.whiten.shape[1]))

    def folded(self, w: np.ndarray) -> Machine:
        table = np.zeros(FEATURES, np.float32)
        table[self.used] = self.marks.T @ (self.whiten @ w[:-1])
        return Machine(without_pads(table), float(w[-1]))


def inserted(word: str) -> list[str]:
    """Two copies with one more character inside."""
    h = zlib.crc32(word.encode())
    out = []
    for k in range(2):
        at = 1 + (h >> (8 * k)) % max(1, len(word) - 1)
        out.append((word[:at] + chr(97 + (h >> (8 * k + 4)) % 26) + word[at:])[: 2 * CELL])
    return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4, rounds: int = 600) -> np.ndarray:
    """Linear machine of least squared hinge loss (accelerated gradient); both classes weigh alike, the last entry is the bias."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    weight = weight / np.where(y > 0, weight[y > 0].sum(), weight[y < 0].sum())
    w, velocity = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    rate = 0.5 / (2 * np.linalg.norm((x * weight[:, None]).T @ x, 2) + ridge)
    for _ in range(rounds):
        ahead = w + 0.9 * velocity
        slack = np.maximum(0.0, 1 - y * (x @ ahead))
        velocity = 0.9 * velocity - rate * (-2 * ((weight * slack * y) @ x) + ridge * np.r_[ahead[:-1], 0.0])
        w = w + velocity
    return w


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Coefficients and offset of a logistic fit with both classes weighing alike; Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    penalty = ridge * np.r_[np.ones(len(w) - 1), 1e-6]
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        w = w - np.clip(np.linalg.solve(h, x.T @ (weight * (p - y)) + penalty * w), -3, 3)
    return w


def sample(labels: DataFrame, label: str, learn: Column, per_class: int) -> DataFrame:
    """(doc_id, y): of each class the ``per_class`` labelled rows with the smallest hash of the id."""
    known = labels.where(learn & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("y"))
    of = lambda y: known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    return of(1).unionByName(of(0))


def _bags(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([distinct_words(x) for x in batch.column(2).to_pylist()], pa.list_(pa.string()))], ["doc_id", "y", "words"])


def with_decision(words: DataFrame, machine: Machine) -> DataFrame:
    """``words`` (word, a, b, z) with the decision f."""
    spread = words.sparkSession.sparkContext.broadcast(machine)  # 4 MB whatever the corpus

    def run(batches):
        for batch in batches:
            f = spread.value.words(*coded(batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(f, pa.float64())], ["word", "a", "b", "z", "f"])

    return words.select("word", "a", "b", "z").mapInArrow(run, "word string, a bigint, b bigint, z double, f double")


def train(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int = 4000, landmarks: int = 192, negatives: int = 4500, mine: int = 2) -> Machine | None:
    """None without labelled rows of both classes. ``per_class``, ``landmarks`` and ``negatives`` bound what the driver gets."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    picked = F.broadcast(sample(labels, label, learn, per_class))
    rows = docs.select(F.col("doc_id").cast("bigint"), "text").join(picked, "doc_id").select("doc_id", F.col("y").cast("int"), "text")
    bags = scratch.keep(rows.mapInArrow(_bags, "doc_id bigint, y int, words array<string>"), "bags")
    bags = scratch.keep(bags.groupBy("doc_id", "y").agg(F.min("words").alias("words")), "sample")  # one row of a repeated id
    counts = {r.y: r["count"] for r in bags.groupBy("y").count().collect()}
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    if not n1 or not n0:
        return None
    flat = bags.select("doc_id", "y", F.explode("words").alias("word"))
    rate = lambda c, n: F.col(c) / F.lit(float(n))
    p = (F.col("a") + F.col("b") + 1) / F.lit(float(n1 + n0 + 2))
    z = (rate("a", n1) - rate("b", n0)) / F.sqrt(p * (1 - p) * F.lit(1 / n1 + 1 / n0))
    words = scratch.keep(flat.groupBy("word").agg(F.sum("y").cast("bigint").alias("a"), F.sum(1 - F.col("y")).cast("bigint").alias("b")).withColumn("z", z), "words")
    clean = words.where(f"b > 0 AND a * {n0 / n1 / 2} <= b")
    suspect = words.where("z > 1.5 AND a * 3 > b")

    def witnesses(by) -> dict[str, float]:
        best = flat.where("y = 1").join(by, "word").groupBy("doc_id").agg(F.max_by("word", F.struct("w", "word")).alias("word"))
        return {r.word: float(r["count"]) for r in best.groupBy("word").count().orderBy(F.desc("count"), "word").limit(2000).collect()}

    positive = witnesses(suspect.select("word", F.col("z").alias("w")))
    if not positive:
        return None
    frequent = clean.orderBy(F.desc("b"), "word").limit(negatives // 3)
    drawn = clean.orderBy(F.xxhash64("word"), "word").limit(2 * negatives // 3)
    negative = {r.word: 1.0 + np.log1p(r.b) for r in frequent.unionByName(drawn).collect()}
    machine = None
    for _ in range(mine + 1):
        if machine is not None:
            judged = scratch.keep(with_decision(words, machine), "judged")
            positive = witnesses(judged.where("z > 1.5 AND a * 3 > b").select("word", (F.least("f", F.lit(1.0)) * F.col("z")).alias("w"))) or positive
            for r in judged.where(f"b > 0 AND a * {n0 / n1 / 2} <= b AND f > -0.7").orderBy(F.desc("f"), "word").limit(2000).collect():
                negative[r.word] = negative.get(r.word, 0.0) + 3.0
        pos = dict(positive)
        for word, n in positive.items():
            for copy in inserted(word):
                pos.setdefault(copy, 0.3 * n)
        neg = {w: n for w, n in negative.items() if w not in pos}
        heaviest = lambda found: sorted(found, key=lambda w: (-found[w], w))[: landmarks // 2]
        marks = Landmarks(list(dict.fromkeys([*heaviest(positive), *heaviest(neg)])))
        y = np.r_[np.ones(len(pos)), -np.ones(len(neg))]
        machine = marks.folded(fit(marks.kernel([*pos, *neg]), y, np.array([*pos.values(), *neg.values()])))

    def judged_bags(batches, now=machine):
        for batch in batches:
            x = now.summaries([" ".join(u) for u in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x.tolist(), pa.list_(pa.float64()))], ["y", "x"])

    found = bags.select("y", "words").mapInArrow(judged_bags, "y int, x array<double>").toPandas()  # a row for each sampled document
    machine.curve = logistic(np.stack(found["x"].to_numpy()), found["y"].to_numpy(float))
    return machine


def scored(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """(doc_id, score) of every row's whole text."""
    spread = docs.sparkSession.sparkContext.broadcast(machine)  # 4 MB of weights whatever the corpus

    def run(batches):
        now = spread.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            score = now.score(now.summaries(texts)) if now else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, score double")


def crc_mod(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def predicted(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted; rows whose crc32(doc_id) mod 5 is 0 are held out."""
    machine = train(docs, labels, label, crc_mod(5) != 0)
    return scored(docs, machine).select("doc_id", (crc_mod(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the machine doesn't reject, with all their columns. The score rides beside each row, so no join is needed."""
    machine = train(docs, labels, "toxic", crc_mod(5) != 0)
    spread = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        now = spread.value
        for batch in batches:
            if now:
                keep = now.score(now.summaries(batch.column(batch.schema.get_field_index("text")).to_pylist())) < 0.5
                batch = batch.filter(pa.array(keep))
            yield batch

    return docs.mapInArrow(run, docs.schema)

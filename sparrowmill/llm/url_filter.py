"""URL filters: rules on host and path, and gradient-boosted trees on lexical features for the URLs that no rule fits.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path follows it up to ``?``,
``#`` or the end. A rule fits its host and all subdomains if the path starts with the rule's; the longest rule wins (of equally
long ones the first by text).

URLs that a rule fits are the labelled ones. Features of a URL: lengths of URL, host, path and query, depth, labels of the host,
shares of digits, hyphens, entropies of the bytes of URL, host and path, number of parameters, scheme, fragment, and statistics
of its suffixes: for the last label of the host, its last two labels and the suffix of the path's last name, the log odds of
block among labelled URLs, and how many there are. These counts cover all labelled rows; a labelled URL's own label is taken out
of its counts when the trees learn. The trees fit the logistic loss by gradient and curvature over histograms of each feature.

Training reads a bounded sample of labelled rows, at most ``per_class`` of each verdict, those with the smallest hash of URL and
page among a share of the rows that is drawn by the same hash, weighted so that the verdicts count as often as in the table. Only numbers reach the driver. Everything else reads all rows.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule and is judged by the trees; with one
verdict among the labels, all others get that one; without labels every URL is allowed; rows that repeat are judged alike; very
long URLs are read whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowmill.llm.scratch import Scratch, small_side
from sparrowmill.llm.shingles import texts

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))
#: the suffixes that have statistics
SUFFIXES = ("top", "site", "name")


def cut(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, path, query and the suffixes) of each row."""
    mark = F.instr("url", "://")
    rest = F.when(mark > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    told = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"))
    told = told.withColumn("rest", rest).withColumn("raw", F.regexp_extract("rest", "^[^/?#]*", 0))
    told = told.withColumn("rest", F.expr("substring(rest, length(raw) + 1)")).withColumns({"host": F.translate("raw", UPPER, LOWER), "path": F.regexp_extract("rest", "^[^?#]*", 0)})
    told = told.withColumn("query", F.regexp_extract(F.expr("substring(rest, length(path) + 1)"), r"^\?([^#]*)", 1))
    name = F.regexp_extract("path", r"[^/]*$", 0)
    return told.select(
        "page_id",
        "url",
        "host",
        "path",
        "query",
        F.substring_index("host", ".", -1).alias("top"),
        F.substring_index("host", ".", -2).alias("site"),
        F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1)).otherwise(F.lit("")).alias("name"),
    )


def ruled(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null where none does. The rules are a parameter; each is one condition."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):  # the last one asked first
        fits = ((F.col("host") == r.host) | F.col("host").endswith(f".{r.host}")) & F.col("path").startswith(r.path)
        rule, verdict = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


def histogram(column: pa.Array) -> np.ndarray:
    """How often each byte occurs in each text."""
    out = np.zeros((len(column), 256))
    for first, data, offsets in texts(column):
        n = len(offsets) - 1
        row = np.repeat(np.arange(n), np.diff(offsets))
        out[first : first + n] = np.bincount(row * 256 + data, minlength=n * 256).reshape(n, 256)
    return out


def entropy(counts: np.ndarray) -> np.ndarray:
    share = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    return -(share * np.log2(np.where(share > 0, share, 1))).sum(1)


#: weight of the overall share among a suffix's labels
PRIOR = 10.0


def odds(block: np.ndarray, labelled: np.ndarray, share: float) -> np.ndarray:
    return np.log((block + PRIOR * share) / (labelled - block + PRIOR * (1 - share)))


def features(url: pa.Array, host: pa.Array, path: pa.Array, query: pa.Array, block: np.ndarray, labelled: np.ndarray, share: float) -> np.ndarray:
    """A row of numbers for each URL; ``block`` and ``labelled`` are the counts of its suffixes, a column for each."""
    u, h, p, q = map(histogram, (url, host, path, query))
    size = lambda x: x.sum(1)
    digits = lambda x: x[:, 48:58].sum(1) / np.maximum(size(x), 1)
    count = lambda x, c: x[:, ord(c)]
    scheme = np.array([bool(x) for x in pa.compute.starts_with(url, "https:").to_pylist()], float)
    return np.column_stack(
        [
            *(size(x) for x in (u, h, p, q)),
            *(entropy(x) for x in (u, h, p)),
            *(digits(x) for x in (u, h, p)),
            count(p, "/"),
            count(h, "."),
            count(h, "-"),
            count(p, "-"),
            np.where(size(q) > 0, count(q, "&") + 1, 0),
            count(u, "#") > 0,
            scheme,
            odds(block, labelled, share),
            np.log1p(labelled),
        ]
    ).astype(np.float64)


@dataclass
class Forest:
    """Complete trees of one depth: node k has the children 2k + 1 and 2k + 2."""

    base: float
    share: float
    depth: int
    feature: list[np.ndarray] = field(default_factory=list)
    above: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, above, value in zip(self.feature, self.above, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > above[node])
            out += value[node - len(feature)]
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def boosted(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, ridge: float = 1.0, least: float = 5.0) -> Forest:
    """Trees by Newton steps on the logistic loss; a split needs the summed weight ``least`` on either side."""
    share = float(np.clip((weight * y).sum() / weight.sum(), 1e-6, 1 - 1e-6))
    out = Forest(float(np.log(share / (1 - share))), share, depth)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
    z, inner, wide = np.full(len(x), out.base), (1 << depth) - 1, x.shape[1]
    for _ in range(trees):
        p = sigmoid(z)
        grad, curve = weight * (p - y), weight * p * (1 - p)
        node, feature, border = np.zeros(len(x), np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            here = (node - first)[:, None] * (wide * bins) + np.arange(wide) * bins + binned
            g, c, n = (np.bincount(here.ravel(), np.repeat(v, wide), width * wide * bins).reshape(width, wide, bins).cumsum(2) for v in (grad, curve, weight))
            total = lambda s: s[..., -1:]
            gain = g**2 / (c + ridge) + (total(g) - g) ** 2 / (total(c) - c + ridge) - total(g) ** 2 / (total(c) + ridge)
            gain[(n < least) | (total(n) - n < least)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-9 and b < len(edges[f]):
                    feature[first + k], border[first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > border[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, grad, 1 << depth) / (np.bincount(leaf, curve, 1 << depth) + ridge)
        z += value[leaf]
        out.feature.append(feature)
        out.above.append(border)
        out.value.append(value)
    return out


def with_counts(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` with block and labelled counts of each suffix over all labelled rows (0 where there are none)."""
    for kind in SUFFIXES:
        blocked = F.sum((F.col("verdict") == "block").cast("bigint"))
        counts = rows.where("verdict IS NOT NULL").groupBy(kind).agg(blocked.alias(f"block_{kind}"), F.count("*").alias(f"labelled_{kind}"))
        counts = scratch.keep(counts, kind)
        rows = rows.join(small_side(counts, counts.count()), kind, "left").fillna(0, [f"block_{kind}", f"labelled_{kind}"])
    return rows


INPUT = ["url", "host", "path", "query", *(f"{c}_{k}" for c in ("block", "labelled") for k in SUFFIXES)]


def counts_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.column_stack([batch.column(f"{c}_{k}").to_numpy(zero_copy_only=False) for k in SUFFIXES]).astype(float) for c in ("block", "labelled")]


def train(rows: DataFrame, per_class: int = 20_000) -> Forest | None:
    """``per_class`` bounds what is collected: some twenty numbers for each row. None without labelled rows."""
    known = rows.where("verdict IS NOT NULL")
    sizes = {r.verdict: r.n for r in known.groupBy("verdict").agg(F.count("*").alias("n")).collect()}  # two verdicts
    if not sizes:
        return None
    share = sizes.get("block", 0) / sum(sizes.values())

    def run(batches):
        for batch in batches:
            y = batch.column("y").to_numpy().astype(float)
            block, labelled = counts_of(batch)
            x = features(*(batch.column(c) for c in INPUT[:4]), block - y[:, None], labelled - 1, share)
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    found = []
    for verdict in sizes:
        drawn, of_million = F.xxhash64("url", "page_id"), min(1_000_000, 1 + 2_000_000 * per_class // sizes[verdict])
        near = known.where((F.col("verdict") == verdict) & (F.pmod(F.shiftright(drawn, 20), F.lit(1_000_000)) < of_million))  # about twice as many, so that no task sends more
        picked = near.orderBy(drawn, "url", "page_id").limit(per_class)
        found.append(picked.select(F.lit(int(verdict == "block")).alias("y"), *INPUT).mapInArrow(run, "y int, x array<double>").toArrow())
    rows_ = pa.concat_tables(found)
    y, x = rows_.column("y").to_numpy().astype(float), np.stack(rows_.column("x").to_pylist())
    order = np.lexsort([*x.T, y])
    x, y = x[order], y[order]
    weight = np.ones(len(y))
    for v, of in ((1.0, "block"), (0.0, "allow")):
        weight[y == v] = sizes.get(of, 0) / max(1, (y == v).sum())
    return boosted(x, y, weight * len(y) / weight.sum())


def scored(rows: DataFrame, forest: Forest | None) -> DataFrame:
    """(page_id, host, path, rule, verdict of the rule, score) with the chance of block by the trees."""
    spread = rows.sparkSession.sparkContext.broadcast(forest)  # some 100 KB

    def run(batches):
        now = spread.value
        for batch in batches:
            score = np.zeros(len(batch))
            if now is not None and len(batch):
                score = sigmoid(now.margin(features(*(batch.column(c) for c in INPUT[:4]), *counts_of(batch), now.share)))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("page_id", "host", "path", "rule", "verdict")] + [pa.array(score, pa.float64())], ["page_id", "host", "path", "rule", "verdict", "score"])

    return rows.select("page_id", "rule", "verdict", *INPUT).mapInArrow(run, "page_id bigint, host string, path string, rule string, verdict string, score double")


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, per_class: int = 20_000) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict (allow or block) and score, the chance of block by the trees."""
    scratch = Scratch(pages.sparkSession, "url-filter")
    rule, verdict = ruled(rules)
    rows = scratch.keep(cut(pages.select("page_id", "url")).withColumns({"rule": rule, "verdict": verdict}), "urls")
    rows = with_counts(rows, scratch)
    out = scored(rows, train(rows, per_class))
    return out.withColumn("verdict", F.coalesce("verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow")))

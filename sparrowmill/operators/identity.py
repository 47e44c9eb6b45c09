"""Screens told apart page by page: a matcher with memory, its memory put back from what it wrote, and why pages were new.

A screen is a row (session, seq, activity, fingerprint, lines, interactable, luma). Within a session screens are decided in the
order of seq, each knowing the pages before it:

1. a fingerprint met before under the same activity is that page again;
2. a screen on which nothing can be touched is pending and belongs to no page;
3. else its lines retrieve the ``top`` pages by BM25 from an inverted index, and the first that is of the same package, has
   similar lines and similar pixels takes it;
4. else it is a new page.

Decisions depend on one another, so a session's rows are read as a sorted stream in one task that holds its pages, never its rows.
With ``split`` the unit is the package within the session: pages of other packages could never take the screen, so a session that
changes between apps isn't one key. A screen without a known package goes with the package before it.

What the matcher remembers comes from its log alone: ``memory_of_log`` gives one row for each page, and these rows go ahead of new
screens in the same stream. A batch that starts so decides as if no one had stopped.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: both parameters of BM25
K1, B = 1.5, 0.75
#: how many pixel fingerprints of a page are compared, the newest
LUMAS = 10
#: fixed values: names of the decisions
STRUCTURAL, PENDING, MERGED, NEW = "STRUCTURAL_IDENTICAL", "PENDING_EMPTY", "BM25_MERGE", "NEW"


@dataclass(frozen=True)
class Gates:
    """Thresholds of the matcher. ``every_visit`` makes each visit an observation of its own."""

    top: int = 5
    criterion: str = "diff"
    diff_below: int = 5
    jaccard_above: float = 0.5
    packages: bool = True
    pixels: bool = True
    pixel_step: int = 10
    page_pixels: float = 0.3
    same_pixels: float = 0.02
    every_visit: bool = False


LUMA = "struct<width int, pixels binary>"
SCREEN = f"session bigint, part string, seq bigint, activity string, fingerprint string, lines array<string>, interactable boolean, luma {LUMA}"
PAGE = "page int, first_activity string, page_lines array<string>, next_observation int, lumas array<struct<observation int, width int, pixels binary>>, prints array<struct<activity string, fingerprint string, observation int>>"
CANDIDATES = "array<struct<page int, activity string, score double, diff int, package_ok boolean, element_ok boolean, pixel_ok boolean, pixel_diff double>>"
LOG = f"{SCREEN}, match_type string, page int, observation int, is_new_observation boolean, candidates {CANDIDATES}"


def package_of(activity: Column) -> Column:
    """The part of an activity's name before the slash, empty if unknown."""
    return F.trim(F.substring_index(F.trim(F.coalesce(activity, F.lit(""))), "/", 1))


def parted(screens: DataFrame, split: bool = True) -> DataFrame:
    """``screens`` with ``part``: the screen's package, or that of the last screen with a known one (of the next if none was)."""
    if not split:
        return screens.withColumn("part", F.lit(""))
    order = Window.partitionBy("session").orderBy("seq")
    known = F.nullif(package_of(F.col("activity")), F.lit(""))
    before = F.last(known, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(known, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    return screens.withColumn("part", F.coalesce(before, after, F.lit("")))


@dataclass
class Page:
    lines: frozenset[str]
    size: int
    first_activity: str
    next_observation: int = 0
    lumas: list[tuple[int, int, bytes]] = field(default_factory=list)


def _package(activity: str) -> str:
    return activity.strip().split("/", 1)[0].strip()


def pixel_difference(a: tuple[int, bytes], b: tuple[int, bytes], step: int) -> float:
    """Share of pixels that differ by more than ``step``; pictures of different sizes differ wholly."""
    if a[0] != b[0] or len(a[1]) != len(b[1]) or not a[1]:
        return 1.0
    x, y = (np.frombuffer(p, np.uint8).astype(np.int16) for p in (a[1], b[1]))
    return float(np.count_nonzero(np.abs(x - y) > step)) / len(x)


class Memory:
    """Pages of one session (or of one package in it) with an inverted index of their lines."""

    def __init__(self, gates: Gates):
        self.gates = gates
        self.pages: dict[int, Page] = {}
        self.postings: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self.prints: dict[tuple[str, str], tuple[int, int]] = {}
        self.length, self.next_page = 0, 0

    def add(self, key: int, lines: list[str], activity: str) -> Page:
        page = self.pages[key] = Page(frozenset(lines), len(lines), activity)
        count: dict[str, int] = defaultdict(int)
        for line in lines:
            count[line] += 1
        for line, n in count.items():
            self.postings[line].append((key, n))
        self.length += len(lines)
        self.next_page = max(self.next_page, key + 1)
        return page

    def put_back(self, key: int, activity: str, lines: list[str], next_observation: int, lumas: list[dict], prints: list[dict]) -> None:
        page = self.add(key, lines or [], activity or "")
        page.next_observation = next_observation
        page.lumas = [(x["observation"], x["width"], x["pixels"]) for x in lumas or []][-LUMAS:]
        for x in prints or []:
            self.prints[x["activity"], x["fingerprint"]] = key, x["observation"]

    def retrieved(self, lines: list[str]) -> list[tuple[int, float]]:
        """The best pages for the lines; pages without a shared line score 0 and follow by number."""
        n, mean = len(self.pages), self.length / len(self.pages)
        scores: dict[int, float] = defaultdict(float)
        for line in lines:
            held = self.postings.get(line, ())
            idf = math.log((n - len(held) + 0.5) / (len(held) + 0.5) + 1)
            for key, tf in held:
                norm = self.pages[key].size / mean if mean else 0.0
                scores[key] += idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * norm))
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[: self.gates.top]
        for key in sorted(self.pages) if len(best) < self.gates.top else ():
            if key not in scores:
                best.append((key, 0.0))
            if len(best) == self.gates.top:
                break
        return best

    def verdict(self, page: Page, key: int, score: float, own: frozenset[str], activity: str, luma: tuple[int, bytes] | None) -> dict:
        """One candidate against all gates."""
        mine, theirs = _package(activity), _package(page.first_activity)
        same = not self.gates.packages or not mine or not theirs or mine == theirs
        shared = len(own & page.lines)
        diff, union = len(own) + len(page.lines) - 2 * shared, len(own) + len(page.lines) - shared
        alike = diff < self.gates.diff_below if self.gates.criterion == "diff" else union > 0 and shared / union > self.gates.jaccard_above
        gap = min((pixel_difference(luma, x[1:], self.gates.pixel_step) for x in page.lumas), default=None) if luma else None
        element_ok = same and alike
        return {"page": key, "activity": page.first_activity, "score": score, "diff": diff, "package_ok": same, "element_ok": element_ok, "pixel_ok": element_ok and (gap is None or gap < self.gates.page_pixels), "pixel_diff": gap}

    def observed(self, page: Page, luma: tuple[int, bytes] | None, remember: bool = True) -> int:
        number = page.next_observation
        page.next_observation += 1
        if luma and remember:
            page.lumas = [*page.lumas, (number, *luma)][-LUMAS:]
        return number

    def decide(self, activity: str | None, fingerprint: str, lines: list[str] | None, interactable: bool, luma: dict | None) -> tuple[str, int | None, int | None, bool, list[dict]]:
        """(match type, page, observation, whether that is new, candidates)."""
        activity, lines = activity or "", lines or []
        shown = (luma["width"], luma["pixels"]) if luma and self.gates.pixels else None
        met = self.prints.get((activity, fingerprint))
        if met:
            if not self.gates.every_visit:
                return STRUCTURAL, *met, False, []
            number = self.observed(self.pages[met[0]], shown, remember=False)
            self.prints[activity, fingerprint] = met[0], number
            return STRUCTURAL, met[0], number, True, []
        if not interactable:
            return PENDING, None, None, False, []
        candidates: list[dict] = []
        if lines and self.pages:
            own = frozenset(lines)
            candidates = [self.verdict(self.pages[k], k, s, own, activity, shown) for k, s in self.retrieved(lines)]
        for c in candidates:
            if c["package_ok"] and c["element_ok"] and c["pixel_ok"]:
                page, number, fresh = self.pages[c["page"]], None, True
                if shown and not self.gates.every_visit:
                    number = next((k for k, *x in page.lumas if pixel_difference(shown, tuple(x), self.gates.pixel_step) < self.gates.same_pixels), None)
                if number is None:
                    number = self.observed(page, shown)
                else:
                    fresh = False
                self.prints[activity, fingerprint] = c["page"], number
                return MERGED, c["page"], number, fresh, candidates
        key = self.next_page
        number = self.observed(self.add(key, lines, activity), shown)
        self.prints[activity, fingerprint] = key, number
        return NEW, key, number, True, candidates


_S, _I, _N, _B, _D = pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.float64()
_CANDIDATE = pa.struct([("page", _I), ("activity", _S), ("score", _D), ("diff", _I), ("package_ok", _B), ("element_ok", _B), ("pixel_ok", _B), ("pixel_diff", _D)])
_LUMA = pa.struct([("width", _I), ("pixels", pa.binary())])
_LOG = pa.schema(
    [("session", _N), ("part", _S), ("seq", _N), ("activity", _S), ("fingerprint", _S), ("lines", pa.list_(_S)), ("interactable", _B), ("luma", _LUMA)]
    + [("match_type", _S), ("page", _I), ("observation", _I), ("is_new_observation", _B), ("candidates", pa.list_(_CANDIDATE))]
)


def decided(screens: DataFrame, gates: Gates = Gates(), memory: DataFrame | None = None, split: bool = True) -> DataFrame:  # noqa: B008
    """The log: each screen with its decision and the candidates that were looked at. ``memory`` has pages of earlier batches."""
    names = [c.split(" ")[0] for c in ("session", "part", "seq", "activity", "fingerprint", "lines", "interactable", "luma")]
    luma = F.col("luma").cast(LUMA) if "luma" in screens.columns else F.lit(None).cast(LUMA)
    rows = screens.withColumn("luma", luma)
    if "part" in screens.columns:
        told = rows  # dealt to parts before
    else:
        told = parted(rows, split) if memory is None or not split else parted_after(rows, memory)
    told = told.select(F.col("session").cast("bigint"), "part", F.col("seq").cast("bigint"), *names[3:])
    first = memory if memory is not None else told.sparkSession.createDataFrame([], f"session bigint, part string, {PAGE}")
    stream = first.withColumn("kind", F.lit(0)).unionByName(told.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    stream = stream.repartition("session", "part").sortWithinPartitions("session", "part", "kind", "page", "seq", "fingerprint")
    pages = ["page", "first_activity", "page_lines", "next_observation", "lumas", "prints"]
    screen = names[3:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, Memory(gates)
        for batch in batches:
            key = list(zip(batch.column("session").to_pylist(), batch.column("part").to_pylist(), strict=True))
            kind = batch.column("kind").to_pylist()
            page = list(zip(*(batch.column(c).to_pylist() for c in pages), strict=True))
            rows = list(zip(*(batch.column(c).to_pylist() for c in screen), strict=True))
            found = []
            for k, unit in enumerate(key):
                if unit != at:
                    at, held = unit, Memory(gates)
                if kind[k] == 0:
                    held.put_back(*page[k])
                else:
                    found.append((k, *held.decide(*rows[k])))
            if found:
                took, *columns = zip(*found, strict=True)
                kept = batch.select(names).take(pa.array(took, pa.int64()))
                more = [pa.array(c, f.type) for c, f in zip(columns, list(_LOG)[len(names) :], strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(kept.columns, _LOG, strict=False)), *more], schema=_LOG)

    return stream.select(*names, "kind", *pages).mapInArrow(run, LOG)


def parted_after(screens: DataFrame, memory: DataFrame) -> DataFrame:
    """As ``parted``; screens before the first known package go with the package that the session had last."""
    last = memory.groupBy("session").agg(F.max_by("part", F.struct("last_seq", "part")).alias("held")) if "last_seq" in memory.columns else memory.groupBy("session").agg(F.max("part").alias("held"))
    rows = parted(screens).join(last, "session", "left")
    order = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    met = F.max((package_of(F.col("activity")) != "").cast("int")).over(order) > 0
    return rows.withColumn("part", F.when(met, F.col("part")).otherwise(F.coalesce("held", "part"))).drop("held")


def memory_of_log(log: DataFrame) -> DataFrame:
    """One row for each page in the log: what a matcher that had decided all of it would remember."""
    known = log.where("page IS NOT NULL").withColumn("first_seq", F.min(F.when(F.col("match_type") == NEW, F.col("seq"))).over(Window.partitionBy("session", "part", "page")))
    key = ["session", "part", "page"]
    prints = known.groupBy(*key, "activity", "fingerprint").agg(F.max_by("observation", "seq").alias("observation"))
    prints = prints.groupBy(*key).agg(F.collect_list(F.struct(F.coalesce("activity", F.lit("")).alias("activity"), "fingerprint", "observation")).alias("prints"))
    pictured = F.when((F.col("match_type") != STRUCTURAL) & F.col("is_new_observation") & F.col("luma").isNotNull(), F.struct("observation", F.col("luma.width").alias("width"), F.col("luma.pixels").alias("pixels")))
    newest = F.row_number().over(Window.partitionBy(*key).orderBy(pictured.isNotNull().desc(), F.desc("observation")))
    ranked = known.withColumns({"picture": pictured, "rank": newest})
    pages = ranked.groupBy(*key).agg(
        F.max(F.when(F.col("match_type") == NEW, F.coalesce("activity", F.lit("")))).alias("first_activity"),
        F.max(F.when(F.col("match_type") == NEW, F.col("lines"))).alias("page_lines"),
        (F.max("observation") + 1).cast("int").alias("next_observation"),
        F.array_sort(F.collect_list(F.when(F.col("rank") <= LUMAS, F.col("picture")))).alias("lumas"),
        F.max("seq").alias("last_seq"),
    )
    return pages.join(prints, key)


def memory_of_pages(pages: DataFrame, observations: DataFrame) -> DataFrame:
    """As ``memory_of_log`` from stored pages (session, part, page, first_activity, page_lines) and their stored observations
    (session, part, page, observation, activity, fingerprint, lines, luma).

    Lines or an activity that a page lacks are those of its first observation; the newest pictures count; a page without
    observations starts with number 0.
    """
    key = ["session", "part", "page"]
    order = F.row_number().over(Window.partitionBy(*key).orderBy((F.col("luma").isNull()).cast("int"), F.desc("observation")))
    picture = F.when(F.col("luma").isNotNull(), F.struct("observation", F.col("luma.width").alias("width"), F.col("luma.pixels").alias("pixels")))
    seen = observations.withColumns({"rank": order, "picture": picture}).groupBy(*key).agg(
        F.min_by("lines", "observation").alias("lines"),
        F.min_by("activity", "observation").alias("activity"),
        (F.max("observation") + 1).cast("int").alias("next_observation"),
        F.array_sort(F.collect_list(F.when(F.col("rank") <= LUMAS, F.col("picture")))).alias("lumas"),
    )
    last = observations.where("fingerprint IS NOT NULL").groupBy("session", "part", F.coalesce("activity", F.lit("")).alias("activity"), "fingerprint").agg(F.max(F.struct("page", "observation")).alias("x"))
    prints = last.groupBy("session", "part", F.col("x.page").alias("page")).agg(F.collect_list(F.struct("activity", "fingerprint", F.col("x.observation").alias("observation"))).alias("prints"))
    filled = lambda own, other, none: F.when(none, F.col(other)).otherwise(F.col(own)).alias(own)
    joined = pages.select(*key, "first_activity", "page_lines").join(seen, key, "left").join(prints, key, "left")
    return joined.select(
        *key,
        filled("first_activity", "activity", F.coalesce("first_activity", F.lit("")) == ""),
        filled("page_lines", "lines", F.coalesce(F.size("page_lines"), F.lit(0)) <= 0),
        F.coalesce("next_observation", F.lit(0)).alias("next_observation"),
        "lumas",
        "prints",
    )


#: fixed values: names of the reasons
MISSED, OTHER_PACKAGE, OTHER_LINES, OTHER_PIXELS, CONTRADICTION = "retrieval-miss", "package-blocked", "element-blocked", "pixel-blocked", "CONTRADICTION"


def reasons(log: DataFrame, watched: Column | None = None) -> DataFrame:
    """Why each new page but the first of its unit wasn't a known one: exactly one of retrieval-miss, package-blocked,
    element-blocked, pixel-blocked and CONTRADICTION (a candidate that passed all gates; never in a log of ``decided``).

    ``watched`` is a condition on a candidate's ``activity``: others count as not retrieved.
    """
    new = log.where(F.col("match_type") == NEW).withColumn("nth", F.row_number().over(Window.partitionBy("session", "part").orderBy("seq"))).where("nth > 1")
    candidates = new.select("session", "part", "seq", F.explode("candidates").alias("c")).select("session", "part", "seq", "c.*")
    if watched is not None:
        candidates = candidates.where(watched)
    passed = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    met = candidates.groupBy("session", "part", "seq").agg(
        F.count("*").alias("n_candidates"),
        passed(F.col("package_ok")).alias("package_ok"),
        passed(F.col("element_ok")).alias("element_ok"),
        passed(F.col("pixel_ok")).alias("pixel_ok"),
        F.min(F.when(F.col("package_ok"), F.col("diff"))).alias("least_diff"),
        F.min(F.when(F.col("element_ok"), F.col("pixel_diff"))).alias("least_pixel_diff"),
    )
    reason = (
        F.when(F.col("n_candidates").isNull(), MISSED)
        .when(~F.col("package_ok"), OTHER_PACKAGE)
        .when(~F.col("element_ok"), OTHER_LINES)
        .when(F.col("pixel_ok"), CONTRADICTION)
        .otherwise(OTHER_PIXELS)
    )
    joined = new.select("session", "part", "seq", "activity", "page").join(met, ["session", "part", "seq"], "left")
    return joined.select("session", "part", "seq", "activity", "page", reason.alias("reason"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), "least_diff", "least_pixel_diff")


def absorbed(log: DataFrame) -> DataFrame:
    """Per page the activities and packages that it took in, and whether these are several packages."""
    seen = log.where("page IS NOT NULL").groupBy("session", "part", "page").agg(
        F.count("*").alias("n_screens"),
        F.array_sort(F.collect_set(F.coalesce("activity", F.lit("")))).alias("activities"),
        F.array_sort(F.collect_set(package_of(F.col("activity")))).alias("packages"),
    )
    return seen.withColumn("crosses", F.size("packages") > 1)


def mismatches(log: DataFrame, live: DataFrame) -> DataFrame:
    """Screens that the log calls new where the live run (session, seq, live_page, live_observation) didn't, or the other way round."""
    both = log.join(live, ["session", "seq"]).withColumn("live_new", F.col("live_observation") == 0).withColumn("is_new", F.col("match_type") == NEW)
    return both.where("live_new <> is_new").select("session", "part", "seq", "activity", "page", "live_page", "live_observation", "live_new", "is_new")


class Shapes:
    """Pages by activity and shape: equal ones, else the first page of a fitting activity whose shape is similar enough.

    Tokens are ordered by a checksum. Two sets of a similarity of t share one of the first n - ceil(t * n) + 1 tokens of each,
    so only pages that share such a token are compared.
    """

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.known: dict[tuple[str, str], int] = {}
        self.activity: list[str] = []
        self.shapes: list[frozenset[str]] = []
        self.index: dict[str, list[int]] = defaultdict(list)
        self.compared = 0

    def prefix(self, shape: frozenset[str]) -> list[str]:
        if not shape:
            return [""]
        n = len(shape) - math.ceil(self.threshold * len(shape) - 1e-9) + 1
        return sorted(shape, key=lambda x: (zlib.crc32(x.encode()), x))[:n]

    def page(self, activity: str, fingerprint: str, tokens: list[str] | None) -> int:
        key, shape = (activity, fingerprint), frozenset(tokens or [])
        if key in self.known:
            return self.known[key]
        prefix = self.prefix(shape)
        for k in sorted({k for token in prefix for k in self.index.get(token, ())}):
            if activity and self.activity[k] and activity != self.activity[k]:
                continue
            self.compared += 1
            other = self.shapes[k]
            shared = len(shape & other)
            if (shared / (len(shape) + len(other) - shared) if shape or other else 1.0) >= self.threshold:
                self.activity[k] = self.activity[k] or activity
                break
        else:
            k = len(self.shapes)
            self.shapes.append(shape)
            self.activity.append(activity)
            for token in prefix:
                self.index[token].append(k)
        self.known[key] = k
        return k


#: fixed value: windows that aren't pages
NOT_PAGES = ("SoftInputWindow",)


def canonical(activity: Column) -> Column:
    """An activity's name, empty for none and for windows that aren't pages."""
    name = F.trim(F.coalesce(activity, F.lit("")))
    return F.when(F.greatest(*(name.contains(x) for x in NOT_PAGES), F.lit(False)), "").otherwise(name)


def shaped(frames: DataFrame, threshold: float = 0.85) -> DataFrame:
    """``frames`` (session, seq, activity, fingerprint, shape array<string>) with ``page``, numbered from 0 in each session."""
    rows = frames.select(F.col("session").cast("bigint"), F.col("seq").cast("bigint"), canonical(F.col("activity")).alias("activity"), "fingerprint", "shape")
    stream = rows.repartition("session").sortWithinPartitions("session", "seq", "activity", "fingerprint")

    def run(batches):
        at, held = object(), Shapes(threshold)
        for batch in batches:
            sessions, *rest = (batch.column(c).to_pylist() for c in ("session", "activity", "fingerprint", "shape"))
            pages = []
            for session, *row in zip(sessions, *rest, strict=True):
                if session != at:
                    at, held = session, Shapes(threshold)
                pages.append(held.page(*row))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("session", "seq", "activity", "fingerprint")), pa.array(pages, pa.int32())], ["session", "seq", "activity", "fingerprint", "page"])

    return stream.mapInArrow(run, "session bigint, seq bigint, activity string, fingerprint string, page int")


def graph_nodes(rows: DataFrame) -> DataFrame:
    """Nodes of the page graph from rows (session, seq, page, activity, fingerprint): the first known activity names a page."""
    known = F.when(F.coalesce("activity", F.lit("")) != "", F.col("seq"))
    return rows.groupBy("session", "page").agg(
        F.coalesce(F.min_by("activity", known), F.lit("")).alias("activity"),
        F.min_by("fingerprint", "seq").alias("fingerprint"),
        F.min("seq").alias("first_seen"),
        F.count("*").alias("visits"),
    )


def _edges(moves: DataFrame) -> DataFrame:
    """Edges from moves (session, seq, src, dst, action, element): loops go, the first of equal moves describes them."""
    found = moves.where("src IS NOT NULL AND src <> dst").groupBy("session", "src", "dst", "action")
    return found.agg(F.min_by("element", "seq").alias("element"), F.min("seq").alias("first_seen"), F.count("*").alias("n"))


def _element(action: Column, index: Column) -> Column:
    return F.when(F.coalesce(index, F.lit(-1)) >= 0, F.concat(F.lit("element_"), index)).otherwise(F.coalesce(action, F.lit("unknown")))


def rebuilt_edges(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Edges of frames (session, seq, page) by the action of the frame before, ``events`` (session, frame, action, element_index).

    Retries without a change and marks that are no transitions must be left out of ``events``; of several of a frame the last counts.
    """
    before = F.lag("page").over(Window.partitionBy("session").orderBy("seq"))
    acts = events.groupBy("session", (F.col("frame") + 1).alias("seq")).agg(F.max_by(F.struct("action", "element_index"), "event").alias("a"))
    moves = rows.select("session", "seq", before.alias("src"), F.col("page").alias("dst")).where("seq > 0")
    moves = moves.join(acts, ["session", "seq"], "left")
    return _edges(moves.select("session", "seq", "src", "dst", F.coalesce("a.action", F.lit("unknown")).alias("action"), _element(F.col("a.action"), F.col("a.element_index")).alias("element")))


def recorded_graph(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges from events that carry their page (session, seq, page_key, observation, activity, action, element_index).

    Pages are numbered by their first visit; an edge is named by the action of the event before. Events without a page don't count.
    """
    rows = events.where("page_key IS NOT NULL AND page_key <> ''")
    nodes = rows.groupBy("session", "page_key").agg(F.min("seq").alias("first_seen"), F.min_by(canonical(F.col("activity")), "seq").alias("activity"), F.count("*").alias("visits"), F.count_distinct("observation").alias("observations"))
    nodes = nodes.withColumn("page", F.row_number().over(Window.partitionBy("session").orderBy("first_seen")) - 1)
    order = Window.partitionBy("session").orderBy("seq")
    lag = lambda c: F.lag(c).over(order)
    moves = rows.select("session", "seq", lag("page_key").alias("src"), F.col("page_key").alias("dst"), F.coalesce(lag("action"), F.lit("unknown")).alias("action"), _element(lag("action"), lag("element_index")).alias("element"))
    number = nodes.select("session", F.col("page_key").alias("k"), "page")
    edges = _edges(moves)
    for end in ("src", "dst"):
        edges = edges.join(number.select("session", F.col("k").alias(end), F.col("page").alias(f"{end}_page")), ["session", end])
    return nodes, edges.select("session", F.col("src_page").alias("src"), F.col("dst_page").alias("dst"), "action", "element", "first_seen", "n")

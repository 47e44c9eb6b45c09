"""Screens told apart, memory put back, reasons and page graphs against plain walks."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparrowmill.operators import identity
from sparrowmill.operators.identity import Gates
from sparrowmill.operators.ordering import held

SCHEMA = f"session bigint, seq bigint, activity string, fingerprint string, lines array<string>, interactable boolean, luma {identity.LUMA}"


def made_screens(n, seed):
    """Sessions of screens that drift away from a few layouts, of two apps, some without a name, a picture or anything to touch."""
    rng = random.Random(seed)
    vocabulary = [f"<p>{k}</p>" for k in range(60)]
    layouts = [rng.choices(vocabulary, k=rng.randrange(3, 25)) for _ in range(12)]
    rows, seen = [], []
    for k in range(n):
        if seen and rng.random() < 0.15:
            lines, fingerprint, activity = rng.choice(seen)
        else:
            lines = list(rng.choice(layouts))
            for _ in range(rng.randrange(0, 5)):
                lines[rng.randrange(len(lines))] = rng.choice(vocabulary)
            lines = [] if rng.random() < 0.02 else lines
            fingerprint, activity = f"f{rng.randrange(n)}", rng.choice(["com.a/x", "com.a/y", "com.b/x", " com.b /z", "", None])
            seen.append((lines, fingerprint, activity))
        shade = rng.choice([0, 9, 20, 200])
        luma = None if rng.random() < 0.3 else {"width": rng.choice([4, 4, 4, 2]), "pixels": bytes(min(255, shade + rng.randrange(12)) for _ in range(8))}
        rows.append((rng.randrange(5), k, activity, fingerprint, lines, rng.random() > 0.05, luma))
    return rows


def walked(rows, gates, split):
    """One decision after the other, every page asked."""
    package = lambda a: (a or "").strip().split("/")[0].strip()
    sessions = {}
    for r in sorted(rows):
        sessions.setdefault(r[0], []).append(r)
    out = []
    for session, screens in sessions.items():
        parts = []
        known = next((package(r[2]) for r in screens if package(r[2])), "")
        for r in screens:
            known = package(r[2]) or known
            parts.append(known if split else "")
        for part in sorted(set(parts)):
            pages, prints = [], {}
            for (_, seq, activity, fingerprint, lines, touch, luma), p in zip(screens, parts):
                if p != part:
                    continue
                activity = activity or ""
                picture = (luma["width"], luma["pixels"]) if luma and gates.pixels else None
                told = None
                if (activity, fingerprint) in prints:
                    k, obs = prints[activity, fingerprint]
                    if gates.every_visit:
                        obs = pages[k]["next"]
                        pages[k]["next"] += 1
                        prints[activity, fingerprint] = k, obs
                    told = ("STRUCTURAL_IDENTICAL", k, obs, gates.every_visit)
                elif not touch:
                    told = ("PENDING_EMPTY", None, None, False)
                else:
                    scored = []
                    n, df = len(pages), {line: sum(line in x["counts"] for x in pages) for line in set(lines)}
                    mean = sum(len(x["lines"]) for x in pages) / n if n else 0
                    for k, page in enumerate(pages):
                        score = 0.0
                        for line in lines:
                            f, d = page["counts"][line], df[line]
                            if f:
                                score += math.log((n - d + 0.5) / (d + 0.5) + 1) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(page["lines"]) / mean))
                        scored.append((-score, k))
                    for _, k in sorted(scored)[: gates.top] if lines else []:
                        page = pages[k]
                        a, b = set(lines), set(page["lines"])
                        mine, theirs = package(activity), package(page["activity"])
                        if gates.packages and mine and theirs and mine != theirs:
                            continue
                        if not (len(a ^ b) < gates.diff_below if gates.criterion == "diff" else len(a & b) / len(a | b) > gates.jaccard_above):
                            continue
                        differ = lambda x, y: 1.0 if x[0] != y[0] or len(x[1]) != len(y[1]) else sum(abs(i - j) > gates.pixel_step for i, j in zip(x[1], y[1])) / len(x[1])
                        if picture and page["lumas"] and min(differ(picture, x[1]) for x in page["lumas"]) >= gates.page_pixels:
                            continue
                        same = [o for o, x in page["lumas"] if picture and not gates.every_visit and differ(picture, x) < gates.same_pixels]
                        obs = same[0] if same else page["next"]
                        if not same:
                            page["next"] += 1
                            page["lumas"] = [*page["lumas"], (obs, picture)][-10:] if picture else page["lumas"]
                        prints[activity, fingerprint] = k, obs
                        told = ("BM25_MERGE", k, obs, not same)
                        break
                    if told is None:
                        pages.append({"lines": lines, "counts": Counter(lines), "activity": activity, "next": 1, "lumas": [(0, picture)] if picture else []})
                        prints[activity, fingerprint] = len(pages) - 1, 0
                        told = ("NEW", len(pages) - 1, 0, True)
                out.append((session, part, seq, *told))
    return sorted(out)


def told(log):
    return sorted(tuple(r) for r in log.select("session", "part", "seq", "match_type", "page", "observation", "is_new_observation").collect())


CASES = [(Gates(), True), (Gates(), False), (Gates(criterion="jaccard", top=2, every_visit=True), True), (Gates(packages=False, pixels=False, diff_below=9), False), (Gates(every_visit=True, pixel_step=3, page_pixels=0.9), False)]


@pytest.mark.parametrize("gates, split", CASES)
def test_matcher_decides_as_a_plain_walk(spark, gates, split):
    rows = made_screens(2000 if gates == Gates() and split else 500, 3)
    want = walked(rows, gates, split)
    assert told(identity.decided(spark.createDataFrame(rows, SCHEMA).repartition(6), gates, split=split)) == want
    assert {w[3] for w in want} == {"NEW", "BM25_MERGE", "PENDING_EMPTY", "STRUCTURAL_IDENTICAL"}


@pytest.mark.parametrize("gates, split", [CASES[0], CASES[2]])
@pytest.mark.parametrize("cuts", [(150,), (1, 40, 41, 300)])
def test_batches_go_on_where_the_log_ends(spark, gates, split, cuts):
    rows = made_screens(400, 5)
    whole = identity.parted(spark.createDataFrame(rows, SCHEMA), split)
    log = None
    for a, b in zip((0, *cuts), (*cuts, 400)):
        memory = None if log is None else identity.memory_of_log(log)
        part = held(identity.decided(whole.where(F.col("seq").between(a, b - 1)), gates, memory, split), "batch")
        log = part if log is None else log.unionByName(part)
    assert told(log) == walked(rows, gates, split)


def test_a_later_batch_finds_its_part(spark):
    rows = [(1, 0, "com.a/x", "f0", ["a"], True, None), (1, 1, "com.b/x", "f1", ["b"], True, None), (1, 2, "", "f2", ["b"], True, None), (1, 3, "com.a/y", "f3", ["a"], True, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    first = held(identity.decided(df.where("seq < 2")), "first")
    later = identity.decided(df.where("seq >= 2"), memory=identity.memory_of_log(first))
    assert told(first.unionByName(later)) == walked(rows, Gates(), True)


def test_memory_of_stored_pages(spark):
    """Counters go on, missing lines and activities come from the first observation, the last ten pictures count."""
    pages = spark.createDataFrame([(1, "", 0, None, None), (1, "", 4, "com.a/x", ["q"]), (1, "", 5, "com.a/z", ["z"])], "session bigint, part string, page int, first_activity string, page_lines array<string>")
    seen = [(1, "", 0, k, "com.b/x" if k == 0 else "com.a/q", f"f{k}", ["a", "b"] if k == 0 else ["c"], {"width": 1, "pixels": bytes([k])}) for k in range(13)] + [(1, "", 4, 2, "com.a/x", "g", ["q"], None)]
    observations = spark.createDataFrame(seen, f"session bigint, part string, page int, observation int, activity string, fingerprint string, lines array<string>, luma {identity.LUMA}")
    memory = {r.page: r for r in identity.memory_of_pages(pages, observations).collect()}
    assert memory[0].first_activity == "com.b/x" and memory[0].page_lines == ["a", "b"] and memory[0].next_observation == 13
    assert [x.observation for x in memory[0].lumas] == list(range(3, 13)) and memory[4].next_observation == 3 and memory[5].next_observation == 0
    new = [(1, 20, "com.a/x", "g", ["q"], True, None), (1, 21, "com.c/n", "h", ["n"] * 9, True, None), (1, 22, "com.b/x", "i", ["a", "b"], True, {"width": 1, "pixels": b"\x0c"})]
    gates = Gates(diff_below=1)
    got = told(identity.decided(spark.createDataFrame(new, SCHEMA), gates, identity.memory_of_pages(pages, observations), split=False))
    assert [g[3:] for g in got] == [("STRUCTURAL_IDENTICAL", 4, 2, False), ("NEW", 6, 0, True), ("BM25_MERGE", 0, 3, False)]


def test_every_reason(spark):
    picture = lambda v: {"width": 2, "pixels": bytes([v] * 4)}
    lines = [f"l{k}" for k in range(12)]
    rows = [
        (1, 0, "com.a/x", "f0", lines, True, picture(0)),
        (1, 1, "com.b/x", "f1", lines, True, picture(0)),  # another app's
        (1, 2, "com.a/x", "f2", [f"m{k}" for k in range(9)], True, picture(0)),  # other lines
        (1, 3, "com.a/x", "f3", lines, True, picture(99)),  # other pixels
        (1, 4, "com.a/x", "f4", [], True, picture(0)),  # nothing to ask with
        (2, 5, "com.a/x", "f0", lines, True, None),
    ]
    log = held(identity.decided(spark.createDataFrame(rows, SCHEMA), split=False), "log")
    found = {(r.session, r.seq): r.reason for r in identity.reasons(log).collect()}
    assert found == {(1, 1): "package-blocked", (1, 2): "element-blocked", (1, 3): "pixel-blocked", (1, 4): "retrieval-miss"}
    assert {r.reason for r in identity.reasons(log, F.col("activity") == "nowhere").collect()} == {"retrieval-miss"}
    false = log.withColumn("candidates", F.transform("candidates", lambda c: c.withField("package_ok", F.lit(True)).withField("element_ok", F.lit(True)).withField("pixel_ok", F.lit(True))))
    assert {r.reason for r in identity.reasons(false).collect()} == {"CONTRADICTION", "retrieval-miss"}
    live = spark.createDataFrame([(1, 0, 7, 0), (1, 1, 7, 1), (1, 2, 8, 0), (2, 5, 9, 1)], "session bigint, seq bigint, live_page int, live_observation int")
    assert sorted((r.session, r.seq, r.live_new, r.is_new) for r in identity.mismatches(log, live).collect()) == [(1, 1, False, True), (2, 5, False, True)]


def test_absorbed(spark):
    rows = [(1, k, a, f"f{k}", ["a", "b"], True, None) for k, a in enumerate(["com.a/x", "com.b/x", None, "com.a/y"])]
    got = identity.absorbed(identity.decided(spark.createDataFrame(rows, SCHEMA), Gates(packages=False), split=False)).collect()
    assert [(r.page, r.n_screens, r.activities, r.packages, r.crosses) for r in got] == [(0, 4, ["", "com.a/x", "com.a/y", "com.b/x"], ["", "com.a", "com.b"], True)]


FRAMES = "session bigint, seq bigint, activity string, fingerprint string, shape array<string>"


def walked_shapes(rows, threshold):
    out, sessions = [], {}
    for session, seq, activity, fingerprint, shape in sorted(rows, key=lambda r: r[:2]):
        nodes, known = sessions.setdefault(session, ([], {}))
        activity = "" if not activity or "SoftInputWindow" in activity else activity.strip()
        key, own = (activity, fingerprint), set(shape)
        if key not in known:
            for k, node in enumerate(nodes):
                if activity and node[0] and node[0] != activity:
                    continue
                if (len(own & node[1]) / len(own | node[1]) if own | node[1] else 1.0) >= threshold:
                    node[0] = node[0] or activity
                    known[key] = k
                    break
            else:
                known[key] = len(nodes)
                nodes.append([activity, own])
        out.append((session, seq, known[key], nodes))
    return [(s, q, p) for s, q, p, _ in out], {s: [n[0] for n in nodes] for s, (nodes, _) in sessions.items()}


@pytest.mark.parametrize("threshold", [0.85, 0.6, 1.0])
def test_shapes_are_told_as_by_a_plain_walk(spark, threshold):
    rng = random.Random(7)
    layouts = [rng.sample(range(200), rng.randrange(0, 40)) for _ in range(25)]
    rows = []
    for k in range(1500):
        shape = [f"t{x}" for x in rng.choice(layouts) if rng.random() > 0.04]
        rows.append((k % 3, k, rng.choice(["a/x", "a/y", "", None, "a/SoftInputWindow", " a/x "]), f"f{rng.randrange(200)}", shape))
    want, names = walked_shapes(rows, threshold)
    frames = identity.shaped(spark.createDataFrame(rows, FRAMES).repartition(5), threshold)
    got = frames.collect()
    assert sorted((r.session, r.seq, r.page) for r in got) == sorted(want)
    nodes = identity.graph_nodes(frames).collect()
    assert {(r.session, r.page): r.activity for r in nodes} == {(s, k): n for s, x in names.items() for k, n in enumerate(x)}
    visits = Counter((s, p) for s, _, p in want)
    assert {(r.session, r.page): r.visits for r in nodes} == dict(visits)


def test_only_candidates_are_compared():
    shapes = identity.Shapes(0.85)
    for k in range(400):  # layouts without a common part
        assert shapes.page("", f"f{k}", [f"{k}-{j}" for j in range(20)]) == k
    assert shapes.compared == 0
    assert shapes.page("", "g", [f"7-{j}" for j in range(20)]) == 7 and shapes.compared == 1


def test_rebuilt_graph(spark):
    frames = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, 2, 0), (1, 3, 1), (1, 4, 1), (1, 5, 2)], "session bigint, seq bigint, page int")
    events = spark.createDataFrame([(1, 0, "tap", 3, 10), (1, 0, "swipe", -1, 11), (1, 2, "swipe", None, 12), (1, 4, "tap", 5, 13)], "session bigint, frame bigint, action string, element_index int, event bigint")
    got = sorted(tuple(r) for r in identity.rebuilt_edges(frames, events).select("src", "dst", "action", "element", "first_seen", "n").collect())
    assert got == [(0, 1, "swipe", "swipe", 1, 2), (1, 0, "unknown", "unknown", 2, 1), (1, 2, "tap", "element_5", 5, 1)]

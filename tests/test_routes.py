"""Routes and progress against plain definitions."""

import numpy as np


from sparrowmill.operators import graph, progress, retrieval, routes


def test_routes_and_plans(spark):
    rng = np.random.default_rng(3)
    moves = [(f"p{a}", f"s{rng.integers(4)}", "tap", f"p{b}", k) for k, (a, b) in enumerate(rng.integers(0, 12, (40, 2)))]
    edges = routes.latest_edges(spark.createDataFrame(moves + [(None, "s", "tap", "p1", 99)], "src string, signature string, action string, dst string, seq int"))
    now = {(a, s): d for a, s, _, d, _ in moves}
    plain = {}
    for (a, s), d in now.items():
        if a != d:
            plain.setdefault((a, d), []).append(s)
    assert {(r.src, r.dst): (r.n_actions, r.signature) for r in edges.collect()} == {k: (len(v), min(v)) for k, v in plain.items()}
    best = {"p0": []}
    for _ in range(12):
        new = {}
        for (a, d), v in plain.items():
            if a in best and d not in best:
                way = [*best[a], (a, min(v), "tap")]
                new[d] = min(new.get(d, way), way)
        best |= new
    found = routes.shortest_routes(edges, "p0")
    got = {r.page: [tuple(s) for s in r.steps] for r in found.collect()}
    assert got == best and len(best) > 3 and all(r.hops == len(r.steps) for r in found.collect())
    far = max(best, key=lambda p: (len(best[p]), p))
    untried = spark.createDataFrame([(far, "x", "tap"), ("p0", "y", "tap"), ("nowhere", "z", "tap")], "page string, signature string, action string")
    depths = graph.hop_distances(edges, "p0")
    plan = lambda *a: [(r.page, len(r.steps)) for r in routes.planned(found, untried, *a).collect()]
    assert plan() == plan("bfs", depths) == [("p0", 1)] and plan("dfs", depths) == [(far, len(best[far]) + 1)]
    assert routes.planned(found, untried.where("page = 'nowhere'")).count() == 0


def test_repeats_reset_at_a_trip(spark):
    rng = np.random.default_rng(6)
    rows = [(int(rng.integers(2)), k, rng.choice(list("abc")), rng.choice(["x", None])) for k in range(200)]
    want = {}
    for session in (0, 1):
        pages, counts = set(), {}
        for s, k, page, what in rows:
            if s == session:
                if page not in pages:
                    pages.add(page)
                    counts = {}
                counts[page, what] = counts.get((page, what), 0) + 1
                want[s, k] = counts[page, what]
                if counts[page, what] == 3:
                    counts = {}
    df = spark.createDataFrame(rows, "u int, k int, page string, what string").repartition(3)
    assert {(r.session, r.seq): r.repeats for r in progress.repeats(df, "u", "k", "page", "what", trip=3).collect()} == want


def test_steadiness(spark):
    frames = "abababcdcdcdxxxabcabcabc"
    df = spark.createDataFrame([(1, k, f, 0.0 if k > 9 else 0.5) for k, f in enumerate(frames)] + [(2, 0, None, None)], "s int, k int, f string, d double")
    got = {(r.s, r.k): r for r in progress.steadiness(df, "s", "k", "d", "f").collect()}
    swings = lambda k: any(k + 1 >= 3 * p and all(frames[i] == frames[i + p] for i in range(k + 1 - 3 * p, k + 1 - p)) for p in (1, 2, 3))
    assert [got[1, k].oscillates for k in range(len(frames))] == [swings(k) for k in range(len(frames))]
    assert [k for k in range(len(frames)) if got[1, k].stable] == list(range(16, len(frames))) and not got[2, 0].stable and not got[2, 0].oscillates


def test_static_coverage(spark):
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(["a", "z", "a", "b"])], "s int, k int, x string")
    got = [(r.visited, r.total, r.coverage) for r in progress.running_coverage(df, "s", "k", "x", ("a", "b", "c")).orderBy("k").collect()]
    assert got == [(1, 3, 0.3333), (1, 3, 0.3333), (1, 3, 0.3333), (2, 3, 0.6667)]
    assert [r.coverage for r in progress.running_coverage(df, "s", "k", "x").collect()] == [0.0] * 4


def test_unmatched_documents_follow(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["a b", "c", "d", "", "a"])], "k bigint, t string")
    asked = spark.createDataFrame([(1, "a"), (2, "nothing"), (3, None)], "q bigint, t string")
    got = {}
    for r in retrieval.bm25(docs, "k", "t", asked, "q", "t", 3).orderBy("query", "place").collect():
        got.setdefault(r["query"], []).append(r.doc)
    assert got == {1: [4, 0, 1], 2: [0, 1, 2], 3: [0, 1, 2]}
    assert retrieval.bm25(docs.limit(0), "k", "t", asked, "q", "t", 3).count() == 0

"""Every query with SQL against DuckDB, and the row helpers against plain definitions."""

import gzip
import itertools
import math
import re
import struct

import duckdb
import numpy as np
import pytest

from sparrowmill.functions import kernels, markup, matching
from sparrowmill.operators import graph, trees
from sparrowmill.plans import catalog
from sparrowmill.sources import readers
from sparrowmill.streaming import coverage

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    return sorted(tuple("NULL" if v is None else f"{float(v):.9g}" if isinstance(v, int | float) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.sql(catalog.ORACLES[name])
    assert sorted(found.columns) == columns
    assert plain(df.select(*columns).collect()) == plain(found.select(*(duckdb.ColumnExpression(c) for c in columns)).fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_others_run(spark, name):
    rows = catalog.QUERIES[name](spark, SF).collect()  # all columns
    assert rows and not any(all(v is None for k, v in r.asDict().items() if k not in ("key", "page_id")) for r in rows)


def test_assignment_is_least():
    rng = np.random.default_rng(1)
    for n in range(1, 7):
        for _ in range(20):
            cost = rng.integers(0, 9, (n, n)).astype(float)
            best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
            got = matching.assign(cost)
            assert sorted(got) == list(range(n)) and sum(cost[i, got[i]] for i in range(n)) == best


def test_text_metrics():
    assert kernels.common_length("a b c d".split(), "b x d".split()) == 2
    assert kernels.bleu4("a b c d e", "a b c d e") == 1 and kernels.bleu4("a b", "a b") == 0
    assert kernels.rouge_n("a b b", "b b c", 1) == pytest.approx(2 / 3)


def plain_sim(a, b):
    """The definition for two texts."""
    if a == "" or b == "":
        return float(a == b)
    x, y = ({w for w in t.lower().replace("|", "").split()} for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_similarity_of_texts():
    one = lambda t: [{"tag": "p", "text": t, "index": 0, "bounds": "", "depth": 0}]
    for a, b in [("", ""), ("a", ""), ("", "|"), ("|", "| |"), ("A b", "a | B c"), ("x", "y")]:
        assert [p[3] for p in matching.pairs(one(a), one(b), limit=9.0)] == [plain_sim(a, b)]


def test_elements_of_both_parsers():
    xml = """<node index="0" bounds="[0,0][10,20]"><RecyclerView><TextView text="Hi " id="a"/><TextView> plain <b>bold</b></TextView></RecyclerView><empty index="x"/></node>"""
    found = markup.elements(xml)
    assert [(e["tag"], e["text"], e["index"], e["bounds"]) for e in found] == [
        ("node", "Hi | a | plain bold", 0, "[0,0][10,20]"),
        ("recyclerview", "Hi | a | plain bold", -1, ""),
        ("textview", "Hi | a", -1, ""),
        ("textview", "plain", -1, ""),
        ("b", "bold", -1, ""),
        ("empty", "", -1, ""),
    ]
    fenced = "```html\n" + xml.replace("<empty", "<br><empty") + "\n```"
    assert [e["tag"] for e in markup.elements(fenced)] == ["node", "recyclerview", "textview", "textview", "b", "br", "empty"]
    page = '<div aria-label="Home"><p></p><img><button index="3"><span>Go</span></button></div><!-- c --><li clickable="true">x</li>'
    assert [(e["tag"], e["text"]) for e in markup.elements(page, "legacy")] == [("button", "Go"), ("span", "Go"), ("li", "x")]
    assert [(e["tag"], e["text"]) for e in markup.elements(page, "legacy", "bounds", aria=True)] == [("div", "Home"), ("button", ""), ("span", "Go"), ("li", "x")]
    assert [e["text"] for e in markup.elements("<div><!-- c --><p>t</p></div>")] == ["c", "t"] and markup.elements(None) == []
    assert [e["text"] for e in markup.elements("<div>\n<p>t</p></div>")] == ["", "t"]  # white space is a text of its own


def states(spark, rows):
    return spark.createDataFrame(rows, "k bigint, current string, truth string, pred string")


def test_scores_and_changes(spark):
    a = '<ul><li id="x">one two</li><li>two three</li><p bounds="[0,0][10,10]" index="7">z</p></ul>'
    b = '<ul><li id="x">one two</li><li>two four</li><i>new</i><p bounds="[0,60][10,70]" index="4">z</p></ul>'
    rows = states(spark, [(1, a, b, a), (2, a, "", ""), (3, None, a, ""), (4, a, a, a)])
    by_index = trees.paired(rows, "k", "current", "truth")
    got = {r.key: r for r in trees.scores(by_index).collect()}
    # ul takes all texts below it: one, two, x / new and four on one side only
    ul, li = len({"one", "two", "x", "three", "z"} & {"one", "two", "x", "four", "new", "z"}) / 7, 1 / 3
    assert got[1].ea == round(4 / 5, 4) and got[1].precision == 1.0 and got[1].recall == 0.8 and got[1].f1 == round(8 / 9, 4)
    assert got[1].text == round((ul + 1 + li + 1) / 4, 4) and got[1].place == 0.75 and got[4].f1 == 1 and got[2].ea == got[3].ea == 0
    where = {r.key: r for r in trees.scores(trees.paired(rows, "k", "current", "truth", place="bounds"), near=50.0).collect()}
    assert where[1].place == 0.0 and where[4].place == 1.0
    counted = {r.key: (r.added, r.modified, r.unchanged, r.deleted) for r in trees.changes(by_index).collect()}
    assert counted == {1: (1, 2, 2, 0), 2: (0, 0, 0, 4), 3: (4, 0, 0, 0), 4: (0, 0, 4, 0)}
    assert {r.key: r.unchanged for r in trees.changes(by_index, "cost").collect()} == {1: 1, 2: 0, 3: 0, 4: 4}  # an index 3 of 7 away costs 0.08571
    assert {r.key: r.deleted for r in trees.changes(by_index, emptied=False).collect()}[2] == 0
    assert {r.key for r in trees.changing(trees.changes(by_index)).collect()} == {1, 3}


def plain_state_diff(current, truth, pred):
    """Changed items by sets of one row."""
    c, g, p = (markup.elements(x) for x in (current, truth, pred))

    def split(next_, claims):
        found = matching.pairs(c, next_)
        same = {r for _, r, _, sim, _ in found if sim >= 1}
        return set(range(len(next_))) - same, set(range(len(c))) - {x[0] for x in found} if next_ or claims else set()

    changed, gone = split(g, True)
    mine, lost = split(p, False)
    hits = [(i, j, sim) for i, j, _, sim, _ in matching.pairs(p, g) if i in mine and j in changed]
    n, m = len(changed) + len(gone), len(mine) + len(lost)
    if not n and not m:
        return None, None, 0, 0
    out = []
    for least in (0.9, 0.0):
        k = sum(sim >= least for *_, sim in hits) + len(gone & lost)
        x, y = k / m if m else 0.0, k / n if n else 0.0
        out.append(round(2 * x * y / (x + y), 4) if x + y else 0.0)
    return *out, n, m


def test_state_diff_against_sets(spark):
    rng = np.random.default_rng(5)
    tree = lambda: "<ul>" + "".join(f"<{t}>{' '.join(rng.choice(list('abcd'), 2))}</{t}>" for t in rng.choice(["li", "p", "b"], rng.integers(1, 7))) + "</ul>"
    rows = [(k, tree(), tree(), tree()) for k in range(40)]
    rows += [(k + 40, a, b, a) for k, a, b, _ in rows[:5]] + [(k + 50, a, b, b) for k, a, b, _ in rows[:5]] + [(60, rows[0][1], rows[0][2], ""), (61, rows[0][1], rows[0][1], rows[0][1]), (62, rows[0][1], "", "")]
    df = states(spark, rows)
    pair = lambda a, b: trees.paired(df, "k", a, b)
    got = {r.key: r for r in trees.state_diff(pair("current", "truth"), pair("current", "pred"), pair("pred", "truth")).collect()}
    assert len(got) == len(rows)
    for k, a, b, p in rows:
        assert (got[k].change_f1_strict, got[k].change_f1_loose, got[k].n_change_true, got[k].n_change_pred) == plain_state_diff(a, b, p)
    copies, perfect = [got[k] for k in range(40, 45)], [got[k] for k in range(50, 55)]
    assert all(r.n_change_pred == 0 and not r.change_f1_strict and r.copy_near and r.copy_rate_pred == 1 for r in copies)
    assert all(r.change_f1_strict == 1 or r.n_change_true == 0 for r in perfect) and all(r.addmod_recall in (1.0, None) for r in perfect)
    assert got[60].parse_fail and got[60].change_f1_strict == 0 and got[61].no_change_right == 1 and got[61].change_f1_strict is None


@pytest.mark.parametrize("name", ["met01_tree_score", "diff02_tree_diff"])
def test_pages_of_any_length_are_paired(spark, tmp_path, name):
    long = "<ul>" + "".join(f"<li>item {k} of the list</li>" for k in range(300)) + "</ul>"
    rows = [(1, "u", long), (2, "u", long), (3, "u", None), (4, "u", "<p>x</p>"), (6, "u", "<p>x</p>")]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.key: r for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 2, 3]
    if name.startswith("met01"):
        assert got[1].f1 == 1 and got[1].text == 1 and got[2].f1 == 0 and got[3].f1 == 0
    else:
        assert got[1].unchanged == 301 and got[2].deleted == 301 and got[3].added == 1


def test_match_costs_least_by_tag(monkeypatch):
    rng = np.random.default_rng(4)
    side = lambda n: [{"tag": "ab"[rng.integers(2)], "text": " ".join(rng.choice(list("uvwx|"), rng.integers(0, 4))), "index": k, "bounds": f"[{k},0][{k + 9},{rng.integers(9)}]" if k % 3 else "", "depth": 0} for k in range(n)]
    for _ in range(30):
        p, t = side(rng.integers(1, 6)), side(rng.integers(1, 6))
        for by_place, limit in ((False, 1.5), (True, 1.7)):
            far, n = max(1, len(p) - 1, len(t) - 1), max(len(p), len(t))
            cost = np.full((n, n), 2 * limit)
            for (i, a), (j, b) in itertools.product(enumerate(p), enumerate(t)):
                x, y = (re.findall(r"-?\d+", e["bounds"]) for e in (a, b))
                middle = lambda v: ((int(v[0]) + int(v[2])) / 2, (int(v[1]) + int(v[3])) / 2)
                away = (0.4 * min(math.dist(middle(x), middle(y)) / 2050, 1) if x and y else 0.0) if by_place else 0.2 * abs(i - j) / far
                cost[i, j] = round(1.5 * (1 - plain_sim(a["text"], b["text"])) + away, 5) if a["tag"] == b["tag"] else 3.0
            least = min(sum(cost[i, c[i]] for i in range(n)) for c in itertools.permutations(range(n)))
            monkeypatch.setattr(matching, "CELLS", int(rng.integers(2)) * 4_000_000)
            pairs = [x[:3] for x in matching.pairs(p, t, "bounds" if by_place else "index")]
            assert all(c == pytest.approx(cost[i, j]) and c < limit for i, j, c in pairs)
            spare = [(i, j) for i in range(n) for j in range(n) if i not in {x for x, _, _ in pairs} and j not in {y for _, y, _ in pairs}]
            rest = sorted({i for i, _ in spare}), sorted({j for _, j in spare})
            left = min(sum(cost[i, j] for i, j in zip(rest[0], c)) for c in itertools.permutations(rest[1]))
            assert sum(c for _, _, c in pairs) + left == pytest.approx(least)


def test_sessions_are_streamed(spark, capsys):
    rng = np.random.default_rng(8)
    pages = [(None if k % 7 == 0 else k % 2, k, sorted(set(rng.choice(list("uvwxyz"), 3)))) for k in range(300)]
    keys = {}
    for session in (None, 0, 1):
        found = []
        for s, k, lines in pages:
            if s != session:
                continue
            own = set(lines)
            hits = [j for j, x in enumerate(found) if len(x & own) / len(x | own) >= 0.5]
            keys[s, k] = hits[0] if hits else len(found)
            if not hits:
                found.append(own)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        matched = graph.matched_pages(spark.createDataFrame(pages, "session bigint, seq bigint, lines array<string>").repartition(3), 0.5)
        assert {(r.session, r.seq): r.page_key for r in matched.collect()} == keys
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    matched.explain()
    assert "InPandas" not in capsys.readouterr().out  # no session in one frame


def field(number, kind, body):
    return bytes([number << 3 | kind]) + (bytes([len(body)]) + body if kind == 2 else body)


def test_tfrecords(spark, tmp_path):
    ints = field(3, 2, field(1, 0, b"\x05") + field(1, 0, b"\xff" * 9 + b"\x01"))
    raw = field(1, 2, field(1, 2, b"png"))
    entries = b"".join(field(1, 2, field(1, 2, k) + field(2, 2, v)) for k, v in ((b"ids", ints), (b"img", raw)))
    payload = field(1, 2, entries)
    record = struct.pack("<Q", len(payload)) + b"0000" + payload + b"0000"
    (tmp_path / "a.tfrecord").write_bytes(gzip.compress(record * 2 + record[:9]))
    rows = readers.tfrecords(spark, str(tmp_path)).orderBy("seq", "name").collect()
    assert [(r.seq, r.name, r.ints, [bytes(x) for x in r.raw]) for r in rows[:2]] == [(0, "ids", [5, -1], []), (0, "img", [], [b"png"])] and len(rows) == 4


def test_jsonl_policies(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nbroken\n{"a": 2}\n')
    assert sorted(r.a for r in readers.jsonl(spark, str(tmp_path), "a int").collect()) == [1, 2]
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.jsonl(spark, str(tmp_path), "a int", strict=True).collect()


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").limit(300)
    events.write.json(str(tmp_path / "in"))
    q = coverage.visits(coverage.event_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("visits").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    columns = coverage.visits(events).columns
    assert spark.table("visits").count() > 0
    assert sorted(spark.table("visits").select(*columns).collect()) == sorted(coverage.visits(events).collect())


def test_hops_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"p{k}", f"p{k + 1}") for k in range(13)] + [("p3", "p0")], "src string, dst string")
    assert {r.page: r.hops for r in graph.hop_distances(edges, "p0").collect()} == {f"p{k}": k for k in range(14)}
    with pytest.raises(ValueError, match="beyond 5"):
        graph.hop_distances(edges, "p0", limit=5)


def test_few_cells_are_assigned_as_many(monkeypatch):
    rng = np.random.default_rng(6)
    side = lambda n: [{"tag": "ab"[rng.integers(2)], "text": " ".join(rng.choice(list("uvwx|"), rng.integers(0, 4))), "index": int(rng.integers(-1, 9)), "bounds": "", "depth": 0} for k in range(n)]
    cases = [(side(rng.integers(0, 20)), side(rng.integers(0, 20))) for _ in range(60)]
    loops = [matching.pairs(p, matching.Tree.of(t)) for p, t in cases]
    monkeypatch.setattr(matching, "FEW", -1)
    assert loops == [matching.pairs(p, t) for p, t in cases]


def test_states_are_read_once(spark, tmp_path):
    rows = [(k, "u", f"<ul><li>{k % 3} a</li><li>b {k % 2}</li>{'<p>c</p>' * (k % 4)}</ul>" if k != 5 else None) for k in range(12)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    texts = {k: html for k, _, html in rows}
    df = states(spark, [(k, texts[k], texts[k + 1], texts[k + 2]) for k in range(10)])
    pair = lambda a, b: trees.paired(df, "k", a, b)
    found = catalog.QUERIES["diff04_state_diff"](spark, str(tmp_path))
    assert sorted(map(str, found.collect())) == sorted(map(str, trees.state_diff(pair("current", "truth"), pair("current", "pred"), pair("pred", "truth")).collect()))
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("MapInArrow") == 1 and "html" not in plan  # all pairings of a row at once, from what was read before


def test_worst_case_orders_as_its_sql(spark, tmp_path):
    import duckdb

    # places of supplier keys beyond four digits, an unknown status, a row without a label, one without a place
    rows = [(1, 5, 50_000, 1, "A", "F"), (1, 6, 1, 1, "R", "F"), (2, 1, 1, 1, "A", None), (2, 1, 1, 2, "R", "F"), (3, 1, 1, 1, None, "F"), (3, 2, 1, 1, "N", "F"), (4, 1, 1, 1, None, "F"), (5, 1, 1, None, "A", "F")]
    df = spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_returnflag string, l_linestatus string")
    df.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = catalog.QUERIES["agg10_worst_case"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(db.execute(catalog.ORACLES["agg10_worst_case"]).fetchall()) and {r.l_orderkey: r.label for r in got}[1] == "R"


def test_copy_baseline_reads_pages_once(spark):
    found = catalog.QUERIES["diff07_copy_baseline"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("MapInArrow") == 1 and "html" not in plan

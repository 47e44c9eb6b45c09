"""Sinks and sources below a folder."""

import json

from pyspark.sql import functions as F

from sparrowmill.sources import readers, sinks, stores


def test_jsonl_keeps_order_and_once(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(k, f"é{k}") for k in range(200)], "seq int, text string").repartition(7)
    sinks.jsonl(df, path, "seq")
    lines = [json.loads(x) for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    assert [x["seq"] for x in lines] == list(range(200)) and lines[3]["text"] == "é3"
    assert not sinks.once(df.limit(1), path) and spark.read.json(path).count() == 200
    (tmp_path / "out" / "_SUCCESS").unlink()
    assert sinks.once(df.limit(1), path) and spark.read.json(path).count() == 1


def test_replaced_reads_itself(spark, tmp_path):
    path = str(tmp_path / "table")
    sinks.replaced(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path)
    sinks.replaced(spark.read.schema("k int, v string").json(path).where("k = 2"), path)
    assert [r.v for r in spark.read.json(path).collect()] == ["b"]
    assert [x.name for x in tmp_path.iterdir()] == ["table"]


def test_upsert_series_metrics_frames(spark, tmp_path):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "name string, n int")
    b = spark.createDataFrame([("y", 3), ("z", 4)], "name string, n int")
    assert sorted(sinks.upserted(a, b, "name").collect()) == [("x", 1), ("y", 3), ("z", 4)]
    for part in (a, b):
        sinks.series(part, str(tmp_path / "s"), "n")
    assert spark.read.csv(str(tmp_path / "s"), header=True).count() == 4
    m = spark.createDataFrame([("base", 0.123456, 3)], "name string, f1 double, n int")
    assert sinks.metrics(m, str(tmp_path / "m")) and not sinks.metrics(m, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m/predict_results")).first().f1 == 12.3456
    assert sinks.sidecar(m, str(tmp_path / "m"), {"rows": F.count("*"), "total": F.sum("n")}).first().total == 3
    log = spark.createDataFrame([(0, 4)], "step int, frame_index int")
    new = spark.createDataFrame([(9,), (7,)], "step int")
    assert sorted((r.step, r.frame_index) for r in sinks.numbered_frames(new, log, "step").collect()) == [(7, 5), (9, 6)]
    assert [r.frame_index for r in sinks.numbered_frames(new, log.limit(0), "step").orderBy("step").collect()] == [0, 1]


def test_event_log(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"step": k}) + "\n")
        stream = readers.jsonl(spark, str(tmp_path / "in"), "step int")
        stream = spark.readStream.schema(stream.schema).json(str(tmp_path / "in"))
        q = sinks.event_log(stream, str(tmp_path / "log"), str(tmp_path / "ck"))
        q.processAllAvailable()
        q.stop()
    assert sorted(r.step for r in spark.read.json(str(tmp_path / "log")).collect()) == [0, 1]


def test_sampled_lines(spark, tmp_path):
    (tmp_path / "rows.jsonl").write_text("".join("\n" if k % 5 == 0 else f'{{"k": {k}}}\n' for k in range(100)))
    got = stores.sampled_lines(spark, str(tmp_path / "rows.jsonl"), 10, "1", "k int").collect()
    assert len({r.line for r in got}) == 10 and all(r.row.k == r.line for r in got)
    assert stores.sampled_lines(spark, str(tmp_path / "rows.jsonl"), 500, "1", "k int").count() == 80


def test_catalog(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"a": {"app_name": "A", "activities": ["x", "y"], "aliases": {"p": "q"}}, "b": {"activities": None}, "c": 3, "d": ["x"]}, indent=1))
    got = {r.package: r for r in stores.activity_catalog(spark, str(path)).collect()}
    assert sorted(got) == ["a", "b"] and got["a"].activities == ["x", "y"] and got["a"].aliases == {"p": "q"} and got["b"].activities == [] and got["b"].aliases == {}
    path.write_text("[1]")
    assert stores.activity_catalog(spark, str(path)).count() == 0
    none = stores.activity_catalog(spark, str(tmp_path / "none.json"))
    assert none.count() == 0 and none.columns == stores.activity_catalog(spark, str(path)).columns


def test_observations_and_variants(spark, tmp_path):
    for name, text in {"pages/10/2/raw.xml": "<a/>", "pages/10/10/raw.xml": "<b/>", "pages/10/10/encoded.xml": "é", "pages/10/page.json": "{}", "pages/9/page.json": "{}", "pages/8/0/screenshot.png": "p"}.items():
        f = tmp_path / "s" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    found = stores.files(spark, str(tmp_path / "s"), content=True)
    assert [r.page_key for r in stores.pages(found).collect()] == ["10", "9"]
    assert [tuple(r) for r in stores.observation_numbers(found).collect()] == [("10", 2), ("10", 10), ("8", 0)]
    got = {(r.page_key, r.observation_num): r for r in stores.observations(found).collect()}
    assert got["10", 10].encoded == "é" and got["10", 2].encoded is None and bytes(got["8", 0].screenshot) == b"p"
    listed = spark.createDataFrame([(p,) for p in ("base/on/p.jsonl", "base/x/on/p.jsonl", "lora/epoch-3/on/p.jsonl", "lora/a/b/on/p.jsonl", "z/on/q.jsonl")], "path string")
    assert [r.variant for r in stores.variants(listed, "on", "p.jsonl").collect()] == ["base", "lora/epoch-3"]


def test_page_graphs(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": 0, "activity": "a", "xml_fingerprint": "f", "first_seen_step": 0, "screenshot_step": 0}], "edges": [{"from_page": 0, "to_page": 1, "action_type": "tap", "first_seen_step": 2, "count": 5}]}, indent=2))
    (tmp_path / "h.json").write_text("{}")
    nodes, edges = stores.page_graphs(spark, str(tmp_path / "*.json"))
    n, e = nodes.first(), edges.first()
    assert (n.threshold, n.visit_count, n.page_key, n.observation_count) == (0.85, 1, "", 0) and (e.element_info, e["count"]) == ("", 5) and nodes.count() == edges.count() == 1


REPORT = """Activity Resolver Table:
  Non-Data Actions:
      android.intent.action.MAIN:
        1a2b com.x/.Main filter 3c
Receiver Resolver Table:
   com.x/.NotThis
Packages:
  Package [com.other] (1):
    activities:
      com.x/.NotMine
  Package [com.x] (2):
    userId=1
    activities:
      com.x/.B exported
      com.x/.A

      com.x/.B
    services:
      com.x/.Service
"""


def test_reports(spark):
    rows = [("com.x", REPORT), ("com.other", REPORT), ("com.x", REPORT.split("Packages:")[0]), ("none", ""), ("com.y", REPORT)]
    df = spark.createDataFrame(rows, "p string, r string")
    got = [r.a for r in df.select(stores.declared_activities(F.col("r"), F.col("p")).alias("a")).collect()]
    assert got == [["com.x/.A", "com.x/.B"], [], ["com.x/.Main"], [], []]
    one = spark.createDataFrame([("  ActivityRecord{c5 u0 com.a/.Main_1} t9", "mShow=1 mInputShown=true x"), ("none", "mInputShown=false")], "a string, k string")
    assert [tuple(r) for r in one.select(stores.current_activity(F.col("a")), stores.keyboard_shown(F.col("k"))).collect()] == [("com.a/.Main_1", True), ("", False)]

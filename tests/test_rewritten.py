"""Typed actions, pictures, features, file sets, forms made anew, moved references and layouts."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from sparrowmill.functions import pictures, prompts, typed
from sparrowmill.operators import contracts, packed, rewrites
from sparrowmill.sources import files

DUMP = '<hierarchy><node class="a.FrameLayout"><node class="a.Button" clickable="true" text="go" bounds="[0,1][20,30]"/><node class="a.TextView" text="é" bounds="[0,40][20,50]"/></node></hierarchy>'


def test_typed_actions(spark):
    cases = {
        '{"action_type":"swipe","x1":3,"junk":1,"x":9}': {"action_type": "swipe", "element_index": -1, "x1": 3, "y1": 0, "x2": 0, "y2": 0, "duration_ms": 300},
        '{"action_type":"long_press","element_index":4}': {"action_type": "long_press", "element_index": 4, "x": 0, "y": 0, "duration_ms": 1000},
        '{"action_type":"shake","x":1}': {"action_type": "shake", "element_index": -1},
        '{"x":1}': {"action_type": "unknown", "element_index": -1},
        '{"action_type":"open_app","package":"a.b"}': {"action_type": "open_app", "element_index": -1, "package": "a.b", "app_name": ""},
        '{"action_type":"tap","x":null}': {"action_type": "tap", "element_index": -1, "x": 0, "y": 0},
        "{}": None, "[1]": None, "no": None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "text string")
    out = {r.text: r.j and json.loads(r.j) for r in df.select("text", typed.as_json(typed.typed(F.try_parse_json("text"))).alias("j")).collect()}
    assert out == cases


def test_features_as_json(spark):
    rows = [([7], []), ([-1, 2], []), ([], [b'a"b']), ([], [b"\xff\xc3\xa9", b"x" * 9]), ([], [b"x" * 9]), ([], []), (None, None), ([], [b""])]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, ints array<bigint>, raw array<binary>")
    found = {r.k: r.v and json.loads(r.v) for r in df.select("k", typed.feature_json(F.col("ints"), F.col("raw"), 8).alias("v")).collect()}
    assert found == {0: 7, 1: [-1, 2], 2: 'a"b', 3: ["�é", "<9 bytes omitted>"], 4: "<9 bytes omitted>", 5: None, 6: None, 7: ""}


def plain_hash(w, h, pixels, grid):
    cw, ch = max(w // grid, 1), max(h // grid, 1)
    out = ""
    for gy in range(grid):
        for gx in range(grid):
            cell = [pixels[y * w + x] for y in range(gy * ch, min(gy * ch + ch, h)) for x in range(gx * cw, min(gx * cw + cw, w))]
            means = [((p >> 16 & 255) + (p >> 8 & 255) + (p & 255)) // 3 for p in cell]
            out += f"{sum(means) // len(means) if means else 0:02x}"
    return out


def test_pictures(spark):
    rng = random.Random(3)
    sizes = [(1, 1), (3, 5), (8, 8), (9, 17), (20, 3), (0, 0)]
    rows = [(k, (w, h, [rng.randrange(-(1 << 31), 1 << 31) for _ in range(w * h)])) for k, (w, h) in enumerate(sizes)]
    df = spark.createDataFrame(rows, "k int, p struct<width:int,height:int,pixels:array<int>>")
    found = {r.k: r.h for r in df.select("k", pictures.frame_hash(F.col("p")).alias("h")).collect()}
    assert found == {k: plain_hash(*p, 8) for k, p in rows}
    pair = lambda a, b: (a and (2, 1, a), b and (len(b), 1, b))
    cases = [pair([0, 0], [0, 0xFFFFFF]), pair([0, 0], [0]), pair([0, 0], [0x202020, 0x212121]), pair(None, [0])]
    both = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, a struct<width:int,height:int,pixels:array<int>>, b struct<width:int,height:int,pixels:array<int>>")
    assert {r.k: r.s for r in both.select("k", pictures.changed_share(F.col("a"), F.col("b"), 32).alias("s")).collect()} == {0: 0.5, 1: 1.0, 2: 0.5, 3: None}


def test_older_prompts(spark):
    good = "system\nS\nuser\n\n## Current State\n<a/>\n\n## Action\n{}\nassistant"
    texts = [good, good + "\n", good + "\n\n", good + "\n\n\n", "x" + good, None, ""]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string").select("k", prompts.older_parts(F.col("x")).alias("p")).select("k", "p.*")
    found = {r.k: tuple(r)[1:] for r in df.collect()}
    assert found == {**{k: ("S", "<a/>", "{}") for k in range(3)}, 3: (texts[3], "", ""), 4: (texts[4], "", ""), 5: (None, None, None), 6: ("", "", "")}


def test_file_sets(spark, tmp_path):
    df = spark.createDataFrame([("a/b/1.txt", "é"), ("a/2.txt", ""), ("c.txt", None)], "path string, content string")
    for _ in range(2):  # again over what is there
        assert files.written(df, str(tmp_path)) == 2
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()) == ["a/2.txt", "a/b/1.txt"]
    assert (tmp_path / "a/b/1.txt").read_text() == "é"
    for bad in (["../x"], ["/x"], ["a/../../x"], ["x/"], ["x", "x"]):
        with pytest.raises(ValueError):
            files.written(spark.createDataFrame([(p, "1") for p in bad], "path string, content string"), str(tmp_path / "new"))
    assert not (tmp_path / "new").exists()
    found = {r.path: r.sha256 for r in files.digests(spark, str(tmp_path)).collect()}
    assert found == {"a/b/1.txt": hashlib.sha256("é".encode()).hexdigest(), "a/2.txt": hashlib.sha256(b"").hexdigest()}


def test_observation_files(spark, tmp_path):
    rows = [("p", "1", 0, b"png", DUMP, ("1", "new")), ("p", "1", 1, None, "broken <", None)]
    df = spark.createDataFrame(rows, "package string, page_key string, observation_num int, screenshot binary, raw string, match struct<page_key:string,match_type:string>")
    files.written(files.observation_files(df), str(tmp_path))
    base = tmp_path / "p/pages/1"
    assert sorted(p.name for p in (base / "0").iterdir()) == ["elements.json", "encoded.xml", "hierarchy.xml", "parsed.xml", "pretty.xml", "raw.xml", "screenshot.png"]
    assert [p.name for p in (base / "1").iterdir()] == ["raw.xml"]
    assert json.loads((base / "0/elements.json").read_text()) == {"page_key": "1", "match_type": "new"}
    assert "bounds" in (base / "0/parsed.xml").read_text() and "bounds" not in (base / "0/encoded.xml").read_text()


def test_forms_made_anew(spark, tmp_path):
    for path, text in {"p/pages/7/0/raw.xml": DUMP, "p/pages/7/1/raw.xml": "broken <", "p/xml/0001.xml": DUMP, "f/xml/0001.xml": DUMP, "f/xml/0001_parsed.xml": "old", "g/notes.txt": "x"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    found = {r.package: (r.regenerated, r.unread) for r in files.regenerated(spark, str(tmp_path)).collect()}
    assert found == {"p": (1, 1), "f": (1, 0)}
    assert sorted(p.name for p in (tmp_path / "p/pages/7/0").iterdir()) == ["encoded.xml", "hierarchy.xml", "parsed.xml", "pretty.xml", "raw.xml"]
    assert sorted(p.name for p in (tmp_path / "f/xml").iterdir()) == ["0001.xml", "0001_encoded.xml", "0001_hierarchy.xml", "0001_parsed.xml", "0001_pretty.xml"]
    assert [p.name for p in (tmp_path / "p/pages/7/1").iterdir()] == ["raw.xml"] and [p.name for p in (tmp_path / "p/xml").iterdir()] == ["0001.xml"]
    assert (tmp_path / "f/xml/0001_encoded.xml").read_text() == (tmp_path / "p/pages/7/0/encoded.xml").read_text()


def test_moved_layout(spark, tmp_path):
    old, new = tmp_path / "old", tmp_path / "new"
    tree = {
        "p/pages/page_7/0003/elements.json": '{"page_key": "page_7", "note": "\\"page_key\\": \\"page_7\\""}',
        "p/pages/page_7/03/raw.xml": "a",
        "p/pages/page_7/page.json": '{"page_key":"page_7"}',
        "p/pages/8/1/raw.xml": "b",
        "p/pages/page_8/2/raw.xml": "c",
        "p/pages/other/0001/raw.xml": "d",
        "p/page_graph.json": '{"nodes":[{"page_key":"page_7"},{"page_key":"8"}]}',
    }
    for path, text in tree.items():
        (old / path).parent.mkdir(parents=True, exist_ok=True)
        (old / path).write_text(text)
    dry = {r.status: (r.files, r.rewritten) for r in files.migrated(spark, str(old)).collect()}
    assert not new.exists() and dry == {"moves": (2, 2), "taken": (2, 0), "stays": (3, 1)}
    files.migrated(spark, str(old), str(new))
    moved = {str(p.relative_to(new)): p.read_text() for p in new.rglob("*") if p.is_file()}
    assert moved == {
        "p/pages/7/3/elements.json": '{"page_key": "7", "note": "\\"page_key\\": \\"page_7\\""}',
        "p/pages/7/03/raw.xml": "a",
        "p/pages/7/page.json": '{"page_key":"7"}',
        "p/pages/8/1/raw.xml": "b",
        "p/pages/page_8/2/raw.xml": "c",
        "p/pages/other/0001/raw.xml": "d",
        "p/page_graph.json": '{"nodes":[{"page_key":"7"},{"page_key":"8"}]}',
    }
    assert {str(p.relative_to(old)) for p in old.rglob("*") if p.is_file()} == set(tree)


def test_moved_references(spark):
    line = lambda images, value="<image>", more="": f'{{"messages":[{{"value":"{value}"}}], "images":{json.dumps(images)}{more}}}'
    texts = {
        1: line(["own/episode_7_step_2.jpg"]), 2: line(["own/episode_1234567_step_02.jpg", "own/home.jpg"], "<image><image>"),
        3: line(["own/x.jpg"]), 4: line(["own/home.jpg"], "<image> own/home.jpg"), 5: line([], "", ', "z":1'), 6: "[1]", 7: "  ", 8: line([]), 9: "{broken",
    }
    df = spark.createDataFrame(list(texts.items()), "k int, line string")
    moved = rewrites.references(df, "line", rewrites.moved_images("pool", "own"))
    found = {r.k: (r.fault, r.new_text) for r in moved.collect()}
    assert found == {
        1: (None, texts[1].replace("own/episode_7_", "pool/episode_000007_")), 2: (None, texts[2].replace("own/", "pool/")),
        3: ("unknown reference", None), 4: ("reference not exactly once", None), 5: ("other keys", None), 6: ("not an object", None), 8: (None, texts[8]), 9: ("not an object", None),
    }
    sound = moved.where("fault IS NULL")
    stored = spark.createDataFrame([("pool/home.jpg",), ("pool/episode_000007_step_2.jpg",)], "path string")
    broken = {name: rows.count() for name, rows in rewrites.reference_rules(3, 4, "own/", stored)(sound).items()}
    assert broken == {"lines lost or too many": 1, "old folder": 0, "marks and images": 1, "images without a file": 1}


def test_jpeg_heads(spark):
    head = bytes.fromhex("ffd8ffe000104a46494600010100000100010000")
    frame = lambda n: bytes.fromhex("ffc0") + (8 + 3 * n).to_bytes(2) + bytes([8, 0, 9, 0, 9, n]) + bytes(3 * n)
    rows = [(1, head + frame(3)), (2, head + frame(1)), (3, b"\x89PNG" + frame(3)), (4, b""), (5, None)]
    df = spark.createDataFrame(rows, "k int, c binary")
    assert {r.k: r.j for r in df.select("k", files.is_jpeg(F.col("c")).alias("j")).collect()} == {1: True, 2: False, 3: False, 4: False, 5: None}


def test_contracts(spark):
    rows = [(1, "state", True, [0.25, 1.0]), (2, "state", True, [0.5]), (3, "action", True, [1.0, 1.0]), (4, "action", False, [0.25]), (5, "state", True, []), (6, "state", True, None)]
    df = spark.createDataFrame(rows, "key bigint, kind string, agrees boolean, token_weights array<double>")
    assert sorted((r.key, r.breach) for r in contracts.breaches(df, "damped", 0.25).collect()) == [(2, "weight of a state"), (4, "images and answer"), (4, "weight of an action")]
    assert contracts.damped_share(df.where("key <= 5"), 0.25).first().asDict() == {"states": 3, "tokens": 3, "low": 1, "share": pytest.approx(1 / 3)}
    assert contracts.damped_share(df.limit(0), 0.25).first().share is None


def test_packed(spark):
    text = '<div index="0"><p index="1" bounds="[0,0][30,40]">a</p><p index="2" bounds="odd">b</p></div>'
    df = spark.createDataFrame([(1, text), (2, None), (3, "<p>x</p>")], "k bigint, x string")
    found = {r.key: r for r in packed.packed(df, "k", "x").collect()}
    assert found[1].screen.asDict() == {"width": 30, "height": 40} and found[3].screen is None and 2 not in found
    a, b = found[1]["items"][1:]
    assert (a.slot, a.box.r, a.unread, a.depth - found[1]["items"][0].depth) == ("b:[0,0][30,40]", 30, None, 1) and (b.box, b.unread) == (None, "odd")

"""Screen dumps through the clean-up, with forms derived by hand."""

import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from sparrowmill.functions import screens as S
from sparrowmill.plans import catalog

DUMP = """<hierarchy rotation="0"><node class="android.widget.FrameLayout" bounds="[0,0][9,9]" package="a.b">
 <node class="android.widget.LinearLayout"><node class="x.TextView" text="Hi &amp; &lt;b&gt;" resource-id="a.b:id/title" bounds="[1,1][2,2]"/></node>
 <node class="RecyclerView" scrollable="true" bounds="[0,2][9,9]" resource-id="a.b:id/list">
  <node class="TextView" text="row" bounds="[0,2][9,3]"/><node class="TextView" text="row" bounds="[0,3][9,4]"/><node class="TextView" text="other" bounds="[0,4][9,5]"/>
  <node class="ImageView" content-desc="pic" bounds="[0,5][9,6]"/><node class="ImageView" bounds="[0,6][9,7]"/>
 </node>
 <node class="EditText" text=" q$ " bounds="[0,0][1,1]" content-desc="find"/>
 <node class="CheckBox" checkable="true" checked="true" clickable="true" text="on" bounds="[0,1][1,2]"/><node class="CheckBox" checkable="true" text="off" bounds="[0,0][0,0]"/>
 <node class="ImageButton" bounds="[3,3][5,5]" content-desc="Go"/><node class="Weird" text="say" bounds="[1,2][3,4]"/><node class="View" text="lost" bounds="[1,2][3,4]"/>
</node></hierarchy>"""

ENCODED = (
    '<div index="0"><p index="1">Hi &amp; &lt;b&gt;</p><div index="2" data-scroll="true"><p index="3">row</p><p index="4">other</p><img alt="pic" index="5" /></div>'
    '<input aria-label="find" type="text" value="q_" index="6" /><input checked="checked" type="checkbox" index="7" /><button aria-label="Go" index="8" /><p index="9">say</p></div>'
)


def attributes(text):
    return [(e.tag, e.attrib, e.text) for e in ET.fromstring(text).iter()]


def test_forms():
    got = S.normalised(DUMP)
    assert attributes(got["encoded"]) == attributes(ENCODED)
    assert [e["bounds"] for e in got["items"]] == ["[0,0][9,9]", "[1,1][2,2]", "[0,2][9,9]", "[0,2][9,3]", "[0,4][9,5]", "[0,5][9,6]", "[0,0][1,1]", "[0,1][1,2]", "[3,3][5,5]", "[1,2][3,4]"]
    assert got["parsed"].count("bounds=") == 10 and "index" not in got["hierarchy"] and "Hi" not in got["hierarchy"] and 'alt="pic"' in got["hierarchy"]
    tree = ET.fromstring(got["parsed"])
    ET.indent(tree, space="  ")
    assert got["pretty"] == ET.tostring(tree, encoding="unicode")
    assert {"tag": "Scroll", "id": "list", "depth": 1} in got["shape"] and len([x for x in got["shape"] if x["depth"] == 2]) == 3


def test_odd_dumps():
    empty = {"parsed": "", "hierarchy": "", "encoded": "", "pretty": "", "items": [], "shape": []}
    assert S.normalised(None) == S.normalised("") == S.normalised("<a><b></a>") == empty
    nothing = S.normalised("<hierarchy/>")
    assert nothing["encoded"] == "" and nothing["shape"] == [{"tag": "hierarchy", "id": "", "depth": 0}]
    one = '<hierarchy><node class="FrameLayout"><node class="Button" clickable="true" text="a&#10;b"/></node></hierarchy>'
    assert S.normalised(one)["encoded"] == '<button index="0">a\nb</button>'
    deep = '<node class="View">' * 20_000 + '<node class="Button" clickable="true" text="x"/>' + "</node>" * 20_000
    assert S.normalised(deep)["encoded"] == '<button index="0">x</button>'
    kept = '<node class="View" content-desc="d">' * 5_000 + "</node>" * 5_000
    assert S.normalised(kept)["encoded"].count("<div") == 5_000
    overlay = '<node class="View"><node class="Button" clickable="true" resource-id="p:id/SnackBar_1" text="x"/><node class="Button" clickable="true" text="y"/></node>'
    assert [x["tag"] for x in S.normalised(overlay)["shape"]] == ["div", "Button"]


def test_columns(spark):
    rows = spark.createDataFrame([(1, DUMP), (2, None), (3, "broken <")], "k int, xml string")
    df = rows.select("k", S.screen("xml").alias("s"), S.raw_elements(F.col("xml")).alias("r"))
    c = F.col("s.items")
    got = df.select(
        "k",
        S.element_lines(c).alias("lines"),
        S.interactable_indexes(c).alias("indexes"),
        S.bounds_of(c, F.lit(8)).alias("bounds"),
        S.acting(c).alias("acting"),
        S.scrollers(F.col("r")).alias("scrollers"),
        F.transform("r", lambda e: e["index"]).alias("raw"),
        F.transform(F.filter("r", S.interactable), S.shown_name).alias("names"),
        S.dialog_button(F.col("r"), ("zz", "ON")).alias("button"),
        S.fingerprint(F.col("s.shape")).alias("f"),
    ).orderBy("k").collect()
    a = got[0]
    scroll = '<div data-scroll="true"></div>'
    assert a.lines == ["<p>Hi & <b></p>", scroll, "<p>row</p>", "<p>other</p>", '<img alt="pic"></img>', '<input aria-label="find" type="text" value="q_"></input>', '<input type="checkbox" checked="checked"></input>', '<button aria-label="Go"></button>', "<p>say</p>"]
    assert a.indexes == [6, 7, 8] and a.bounds == "[3,3][5,5]"
    assert [(e.signature, e.actions) for e in a.acting] == [("div::@2", ["scroll"]), ("input:text:find", ["set_text"]), ("input:checkbox:@7", ["select"]), ("button::Go", ["touch", "long_touch"])]
    assert a.acting[3].struct_key == "button::2x2" and (a.acting[3].middle.x, a.acting[3].short) == (4, "<button>Go</button>")
    assert [(e["index"], e.signature, e.short) for e in a.scrollers] == [(-1, "scroll:a.b:id/list:RecyclerView", "<scroll>list</scroll>")]
    assert a.raw == [0, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 13, 14] and a.names == ["list", "find", "on"] and a.button == 10
    assert got[1].lines == got[2].lines == [] and got[1].button is None and got[1].acting == [] and got[1].f == got[2].f != a.f


def test_repeated_elements_stay_apart(monkeypatch):
    node = '<node class="Button" clickable="true" text="a" bounds="[0,0][{0},9]"/>'
    dump = "<hierarchy><node>" + node.format(1) * 3 + node.format(2) + "</node></hierarchy>"
    monkeypatch.setattr(S, "KNOWN", 2)
    first = S.normalised(dump)
    assert [i["index"] for i in first["items"]] == list(range(5)) and [i["bounds"] for i in first["items"]][1:] == ["[0,0][1,9]"] * 3 + ["[0,0][2,9]"]
    assert S.normalised(dump) == first and len(S._known) <= 2


def test_some_forms_and_attributes(spark):
    df = spark.createDataFrame([(1, DUMP), (2, None), (3, "<a><b></a>")], "k int, xml string")
    got = df.select("k", S.screen("xml").alias("a"), S.screen("xml", "items", "encoded").alias("b"), S.raw_elements(F.col("xml")).alias("r"), S.raw_elements(F.col("xml"), "text").alias("few")).collect()
    for r in got:
        assert r.b.asDict().keys() == {"encoded", "items"} and r.b["items"] == r.a["items"] and r.b.encoded == r.a.encoded == S.normalised(r.k == 1 and DUMP or None)["encoded"]
        assert [(e["index"], e.text, e.box) for e in r.r] == [(e["index"], e.text, e.box) for e in r.few]


def plan(spark, name):
    return catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_dumps_are_read_once(spark):
    for name in ("xml07_regenerated_forms", "fn60_dialog_button"):
        assert plan(spark, name).count("ArrowEvalPython") == 1, name

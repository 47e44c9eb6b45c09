"""Classes of elements by rules applied one after the other."""

from sparrowmill.functions import markup
from sparrowmill.operators import derivable

KEYBOARD = '<ime bounds="[0,1500][1000,2400]">' + "".join(f'<k aria-label="{c}"/>' for c in "qwertyuiopasdfgh") + "<k>Enter key</k>{}</ime>"


def labels(spark, current, following, action=None):
    df = spark.createDataFrame([(1, current, following, action)], "k bigint, c string, n string, a string")
    rows = derivable.classes(df, "k", "c", "n", "a").orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(len(markup.parsed(following).nodes))) and all(r.derivable == (r.label != "NON_DERIVABLE") for r in rows)
    return [r.label for r in rows]


def test_cascade(spark):
    now = '<div><p bounds="[0,0][9,9]">One</p><p index="4">Two</p></div>'
    then = '<div><p bounds="[0,0][9,9]">one</p><p index="5">TWO</p><b>say Hello you</b><i bounds="[20,20][40,40]">new</i><u index="7">other</u><s>lost</s></div>'
    base = ["STRUCTURE", "COPY", "REFLOW"]
    assert labels(spark, now, then) == [*base, *["NON_DERIVABLE"] * 4]
    assert labels(spark, now, then, '{"action":"type","text":" hello "}') == [*base, "ACTION_PAYLOAD", *["NON_DERIVABLE"] * 3]
    assert labels(spark, now, then, '<action>{"action":"click","coordinate":[40,20]}</action>') == [*base, "NON_DERIVABLE", "ACTION_TARGET", "NON_DERIVABLE", "NON_DERIVABLE"]
    assert labels(spark, now, then, '{"action_type":"click","index":7}') == [*base, "NON_DERIVABLE", "NON_DERIVABLE", "ACTION_TARGET", "NON_DERIVABLE"]
    assert labels(spark, None, "<p>x</p>", "no json") == ["NON_DERIVABLE"] and labels(spark, now, None) == []


def test_keyboard(spark):
    plain = '<d bounds="[0,0][1000,2400]"><t>app</t>{}</d>'
    shown = plain.format(KEYBOARD.format(""))
    more = plain.format(KEYBOARD.format("<s>Vegas</s>"))
    first = labels(spark, plain.format(""), more)
    assert first[:2] == ["STRUCTURE", "REFLOW"] and set(first[2:]) == {"SYSTEM_UI"}
    again = labels(spark, shown, more)
    assert set(again[2:-1]) == {"SYSTEM_UI"} and again[-1] == "NON_DERIVABLE"  # new on a keyboard that was there
    high = more.replace("[0,1500]", "[0,100]")
    assert "SYSTEM_UI" not in labels(spark, plain.format(""), high)
    few = more.replace('<k aria-label="q"/><k aria-label="w"/>', "")
    assert "SYSTEM_UI" not in labels(spark, plain.format(""), few)


def test_panel_of_many(spark):
    doc = markup.parsed("<a>" + KEYBOARD.format("") + "<p>word here</p>" * 30 + "</a>")
    assert list(derivable.panel(doc)) == list(range(1, 19))
    assert list(derivable.panel(markup.parsed(""))) == []


def test_reasons(spark):
    now = '<div><p bounds="[0,0][9,9]">One</p><p index="4">Two</p><q index="8">red green</q><q index="8">red blue</q></div>'
    then = '<div><p bounds="[0,0][9,9]">one</p><p index="5">TWO</p><b bounds="[1,1][2,2]">say Hello</b><i bounds="[20,20][40,40]">new</i><u index="8">red black</u><s bounds="[5,5]">lost</s></div>'

    def told(action):
        df = spark.createDataFrame([(1, now, then, action)], "k bigint, c string, n string, a string")
        return derivable.reasons(df, "k", "c", "n", "a")

    got = [(r.rule, r.matched, r.text_sim, r.undecidable) for r in told('{"action":"click","coordinate":[30,30]}').orderBy("pos").collect()]
    assert got == [("no text", None, 0.0, False), ("same slot and text", 1, 1.0, False), ("text elsewhere", 2, 1.0, False), ("none", None, 0.0, False), ("point inside", None, 0.0, False), ("no bounds", None, 0.0, True), ("no bounds", None, 0.0, True)]
    got = [(r.label, r.rule, r.matched, r.text_sim) for r in told('{"action":"open","app_name":"hello"}').orderBy("pos").collect()]
    assert got[3:] == [("ACTION_PAYLOAD", "payload app_name", None, 0.0), ("NON_DERIVABLE", "none", None, 0.0), ("NON_DERIVABLE", "slot with other text", 3, 0.3333), ("NON_DERIVABLE", "none", None, 0.0)]
    total = derivable.totals(told('{"coordinate":[30,30]}'), "key").first()
    assert (total.n, total.underivable, total.own_text, total.own_underivable, total.undecidable) == (7, 3, 6, 3, 2)

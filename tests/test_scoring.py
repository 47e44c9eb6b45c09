"""Action scoring and prompt functions on rows derived by hand."""

import pytest
from pyspark.sql import functions as F

from sparrowmill.functions import prompts as P
from sparrowmill.operators import scoring

SCREEN = """<div bounds="[0,0][100,100]"><p class='x' bounds='[10,10][50,50]'>a</p><b bounds="[10,10][50,50]"/><i bounds="broken"/></div>"""


def verdicts(spark, rows, dialect, screen=SCREEN):
    df = spark.createDataFrame([(k, t, p, screen) for k, (t, p) in enumerate(rows)], "n int, t string, p string, screen string")
    got = scoring.judged(df, "t", "p", dialect, "screen").orderBy("n").select("verdict.*").collect()
    return [(r.kind, r.parsed, r.type_right, r.checked, r.no_bbox, r.step_right) for r in got]


def test_by_point(spark):
    click = '{"action":"click","coordinate":[%s]}'
    rows = [
        (click % "20,20", click % "50,50"),  # on the edge of the smaller box
        (click % "20,20", click % "60,20"),
        (click % "60,60", click % "99.5,1"),
        (click % "200,1", click % "200,1"),
        (click % "20", click % "20,20"),
        (click % "20,20", '{"action":"click"}'),
        ('{"action":"terminate"}', '{"type":"TERMINATE"}'),
        ('{"action":"swipe","coordinate1":[0,0],"coordinate2":[0,0]}', '{"action":"swipe","coordinate1":[0,0],"coordinate2":[0,0]}'),
        ('{"action":"drag"}', '{"action":"drag"}'),
        ('{"action":"open","app_name":null}', '{"action":"open"}'),
        ("{}", "nothing"),
        (None, None),
    ]
    assert verdicts(spark, rows, scoring.BY_POINT) == [
        ("click", True, True, "bbox", False, True),
        ("click", True, True, "bbox", False, False),
        ("click", True, True, "bbox", False, True),
        ("click", True, True, "bbox", True, False),
        ("click", True, True, "bbox", False, False),
        ("click", True, True, "bbox", False, False),
        ("terminate", True, True, None, False, True),
        ("swipe", True, True, "dir", False, False),
        ("drag", True, True, None, False, False),
        ("open", True, True, "app", False, True),
        ("unknown", False, False, None, False, False),
        ("unknown", False, False, None, False, False),
    ]
    assert verdicts(spark, rows[:1], scoring.BY_POINT, None) == [("click", True, True, "bbox", True, False)]


def test_by_index_and_report(spark):
    rows = [('{"action_type":"click","index":3}', "```json\n{\"action_type\":\"click\",\"index\":\"3\"}\n```"), ('{"action_type":"click","index":3}', '{"action_type":"click"}'), ('{"type":"finish"}', '{"type":"wait"}'), ('{"type":"input_text","params":{"text":" A"}}', '{"type":"input_text","text":"a"}')]
    df = spark.createDataFrame(rows, "t string, p string")
    kinds = scoring.by_kind(scoring.judged(df, "t", "p"))
    assert {r.kind: (r.n, r.type_acc, r.step_acc) for r in kinds.collect()} == {"click": (2, 1.0, 0.5), "finish": (1, 0.0, 0.0), "input_text": (1, 1.0, 1.0)}
    r = scoring.report(kinds).first()
    assert (r.total, r.parse_rate, r.type_accuracy, r.step_accuracy, r.macro_step_accuracy, r.cond_index_acc, r.cond_text_acc, r.cond_app_acc) == (4, 1.0, 0.75, 0.5, 0.5, 0.5, 1.0, 0.0)
    none = scoring.report(scoring.by_kind(scoring.judged(df.limit(0), "t", "p"))).first()
    assert none.total == 0 and none.step_accuracy == none.macro_step_accuracy == 0.0


@pytest.mark.parametrize(("points", "warning"), [(["[0.1,0.9]"] * 9 + ["[500,500]"], "unit"), (["[900,10]"] * 5 + ["[5,5]"] * 5, "outside"), (["[5,5]"], None), ([], None)])
def test_point_space(spark, points, warning):
    df = spark.createDataFrame([(f'{{"coordinate":{p}}}',) for p in points] + [("none",)], "p string")
    r = scoring.point_space(df, "p", 840, 1876).first()
    assert (r.n, r.warning) == (len(points), warning)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_sections(spark):
    text = "sys\nuser\nCurrent UI State:\n\nuser\n## Current State\nfirst\n[Full Screenshot]\nassistant\n## Action\n{}\nassistant\nlate"
    got = one(spark, P.sections(F.lit(text)))
    assert got["action"] == "{}" and got["current_state"] == "user"  # the first that isn't blank
    assert one(spark, P.sections(F.lit("no marks"))) == {} and one(spark, P.sections(F.lit(""))) == {}
    long = "## Current State\n" + "<p>line</p>\n" * 200_000 + "## Next State\nx"
    assert one(spark, F.length(P.sections(F.lit(long))["current_state"])) == 12 * 200_000 - 1
    assert one(spark, F.length(P.current_state(F.lit(long)))) == 12 * 200_000 - 1
    assert one(spark, P.current_state(F.lit("a\n\n## Current State"))) == ""


def test_replaced_once(spark):
    assert one(spark, P.replaced_once(F.lit("a.b"), {"a.": "x"})) == "xb" and one(spark, P.replaced_once(F.lit("a.a."), {"a.": "x"})) is None
    assert one(spark, P.replaced_once(F.lit("b"), {"a": "x"})) is None and one(spark, P.bare_number(F.lit("000"))) == "0"

"""Predicted actions against true ones: what was right in each row, and reports over all rows, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowmill.functions import actions as A
from sparrowmill.functions import columns as C

BOUNDS = r"""\bbounds\s*=\s*["'][^"']*?(\[-?[0-9]+,-?[0-9]+\]\[-?[0-9]+,-?[0-9]+\])"""


@dataclass(frozen=True)
class Dialect:
    """Keys that hold an action's type, and how each type is compared; types not named are never right."""

    keys: tuple[str, ...]
    bare: tuple[str, ...]  # right by their type alone
    target: tuple[str, ...]
    target_by: str  # "index" or "bbox"
    move: str
    app: str
    text: str


#: fixed values: the two dialects of actions
BY_INDEX = Dialect(("action_type", "type"), ("navigate_back", "navigate_home", "wait", "finish"), ("click", "long_press"), "index", "scroll", "open_app", "input_text")
BY_POINT = Dialect(("action", "action_type", "type"), ("navigate_back", "navigate_home", "wait", "finish", "terminate"), ("click", "long_press"), "bbox", "swipe", "open", "type")


def boxes(markup: Column) -> Column:
    """The bounds of all elements of a markup text that have some, in page order."""
    return F.transform(F.regexp_extract_all(F.coalesce(markup, F.lit("")), F.lit(BOUNDS), 1), C.box)


def smallest_box(found: Column, point: Column) -> Column:
    """The box of least area that holds a point, edges included; the first of equals, null if none does."""
    at = F.transform(found, lambda b, k: F.struct(((b["r"] - b["l"]).cast("bigint") * (b["b"] - b["t"])).alias("area"), k.alias("k"), b.alias("box")))
    return F.array_min(F.filter(at, lambda x: _holds(x["box"], point)))["box"]


def _holds(box: Column, point: Column) -> Column:
    return (box["l"] <= point[0]) & (point[0] <= box["r"]) & (box["t"] <= point[1]) & (point[1] <= box["b"])


def _kind(action: Column, dialect: Dialect) -> Column:
    return F.lower(F.coalesce(*(A.value(action, f"$.{k}", "string") for k in dialect.keys), F.lit("")))


def _same_param(true: Column, pred: Column, key: str) -> Column:
    return C.norm(A.param(true, key)) == C.norm(A.param(pred, key))


def _direction(action: Column) -> Column:
    a, b = A.point(action, "coordinate1"), A.point(action, "coordinate2")
    return C.swipe_direction(b[0] - a[0], b[1] - a[1])


def judged(df: DataFrame, true: str, pred: str, dialect: Dialect = BY_INDEX, screen: str | None = None) -> DataFrame:
    """The columns of ``df`` with ``verdict``: kind, parsed, type_right, checked ("index", "bbox", "dir", "app", "text"), no_bbox, step_right.

    ``true`` and ``pred`` are texts; ``screen`` is the markup whose smallest box around the true point a predicted point must
    hit. A text without an action isn't parsed and never right; a true point outside all boxes is counted in ``no_bbox``.
    """
    t, p, k = F.col("__true"), F.col("__pred"), F.col("__kind")
    rows = df.withColumns({"__true": A.parsed(F.col(true)), "__pred": A.parsed(F.col(pred))})
    rows = rows.withColumns({"__kind": _kind(t, dialect), "__same": p.isNotNull() & (_kind(t, dialect) == _kind(p, dialect))})
    targeted = k.isin(*dialect.target)
    if dialect.target_by == "bbox":
        a, b = A.point(t, "coordinate"), A.point(p, "coordinate")
        hit = F.when(F.col("__same") & targeted & a.isNotNull(), smallest_box(boxes(F.col(screen)), a))
        rows = rows.withColumn("__box", hit)
        on_target = _holds(F.col("__box"), b)
        no_box = F.col("__same") & targeted & a.isNotNull() & F.col("__box").isNull()
    else:
        on_target = A.value(t, "$.index", "string").eqNullSafe(A.value(p, "$.index", "string"))
        no_box = F.lit(False)
    moved = _direction(t) == _direction(p) if dialect.move == "swipe" else _same_param(t, p, "direction")
    right = (
        F.when(k.isin(*dialect.bare), True)
        .when(targeted, on_target)
        .when(k == dialect.move, moved)
        .when(k == dialect.app, _same_param(t, p, "app_name"))
        .when(k == dialect.text, _same_param(t, p, "text"))
    )
    checked = F.when(targeted, dialect.target_by).when(k == dialect.move, "dir").when(k == dialect.app, "app").when(k == dialect.text, "text")
    verdict = F.struct(
        F.coalesce(F.nullif(k, F.lit("")), F.lit("unknown")).alias("kind"),
        p.isNotNull().alias("parsed"),
        F.col("__same").alias("type_right"),
        F.when(F.col("__same"), checked).alias("checked"),
        no_box.alias("no_bbox"),
        (F.col("__same") & F.coalesce(right, F.lit(False))).alias("step_right"),
    )
    return rows.select(*df.columns, verdict.alias("verdict"))


def _rate(k: Column, n: Column) -> Column:
    return F.round(F.when(n > 0, k / n).otherwise(0.0), 4)


def by_kind(rows: DataFrame) -> DataFrame:
    """(kind, n, type_acc, step_acc) of judged rows, with the counts that a total is made of."""
    v = lambda name: F.col(f"verdict.{name}")
    checks = ("index", "bbox", "dir", "app", "text")
    counted = rows.groupBy(v("kind").alias("kind")).agg(
        F.count("*").alias("n"),
        *(F.count_if(v(c)).alias(f"n_{c}") for c in ("parsed", "type_right", "step_right", "no_bbox")),
        *(F.count_if(v("checked") == c).alias(f"n_{c}") for c in checks),
        *(F.count_if((v("checked") == c) & v("step_right")).alias(f"k_{c}") for c in checks),
    )
    return counted.withColumns({"type_acc": _rate(F.col("n_type_right"), F.col("n")), "step_acc": _rate(F.col("n_step_right"), F.col("n"))})


def report(kinds: DataFrame, dialect: Dialect = BY_INDEX) -> DataFrame:
    """One row over ``by_kind``: rates over all rows, the plain mean of the rounded accuracies of the kinds, accuracies where checked."""
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    checks = (dialect.target_by, "dir", "app", "text")
    extra = [s("n_no_bbox").alias("no_bbox_n")] if dialect.target_by == "bbox" else []
    return kinds.agg(
        s("n").alias("total"),
        _rate(s("n_parsed"), s("n")).alias("parse_rate"),
        _rate(s("n_type_right"), s("n")).alias("type_accuracy"),
        _rate(s("n_step_right"), s("n")).alias("step_accuracy"),
        F.round(F.coalesce(F.avg("step_acc"), F.lit(0.0)), 4).alias("macro_step_accuracy"),
        *(_rate(s(f"k_{c}"), s(f"n_{c}")).alias(f"cond_{c}_acc") for c in checks),
        *extra,
    )


def point_space(df: DataFrame, pred: str, width: int, height: int, unit: float = 0.9, outside: float = 0.5) -> DataFrame:
    """One row: how many predicted points lie in the unit square or off the screen, and ``warning`` ("unit", "outside" or null)."""
    x, y = F.col("p")[0], F.col("p")[1]
    points = df.select(F.explode(A.points(A.parsed(F.col(pred)))).alias("p"))
    counted = points.agg(F.count("*").alias("n"), F.count_if(x.between(0, 1) & y.between(0, 1)).alias("n_unit"), F.count_if(~(x.between(0, width) & y.between(0, height))).alias("n_outside"))
    return counted.withColumn("warning", F.when(F.col("n") == 0, None).when(F.col("n_unit") >= unit * F.col("n"), "unit").when(F.col("n_outside") >= outside * F.col("n"), "outside"))

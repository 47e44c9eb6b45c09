"""Sessions of events made into training examples: what a screen became after an action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowmill.functions.columns import event_direction
from sparrowmill.operators.firsts import either_once

#: fixed values: names of events and of the actions that they become
ACTIONS = {"tap": "Click", "swipe": "Swipe", "input_text": "Input", "press_back": "Back", "long_press": "LongClick", "press_home": "Home"}
AIMED, UNAIMED = ("tap", "long_press"), ("press_back", "press_home")
#: fixed values: what stands before the screen and before the action in an example's question
BEFORE_SCREEN, BEFORE_ACTION = "<image>\n## Current State\n", "\n\n## Action\n"


def transitions(events: DataFrame) -> DataFrame:
    """Each event with the observation of the next one (after_page, after_observation), where that is another observation.

    Marks that are no transitions, retries without a change and events that don't know their frame or observation don't count.
    """
    usable = F.coalesce("transition", F.lit(True)) & ~F.coalesce("no_change_retry", F.lit(False))
    known = events.where(usable & F.col("frame_index").isNotNull() & F.col("page_key").isNotNull() & F.col("observation").isNotNull())
    order = Window.partitionBy("session").orderBy("frame_index")
    moves = known.withColumns({"after_page": F.lead("page_key").over(order), "after_observation": F.lead("observation").over(order)})
    return moves.where("after_page IS NOT NULL AND NOT (page_key = after_page AND observation = after_observation)")


def ascii_only(text: Column) -> Column:
    """Characters beyond ASCII as JSON escapes."""
    code = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def one(c: Column) -> Column:
        n = F.ascii(c)
        pair = F.concat(code(F.lit(0xD800) + F.shiftright(n - 0x10000, 10)), code(F.lit(0xDC00) + (n - 0x10000).bitwiseAND(F.lit(0x3FF))))
        return F.when(n < 128, c).when(n < 0x10000, code(n)).otherwise(pair)

    return F.when(F.col("text").rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(F.split(text, ""), one), "")).otherwise(text)


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    return ascii_only(F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1))


def aim(elements: Column, x: Column, y: Column) -> Column:
    """Index of the smallest of the elements (index, l, t, r, b) around a point, the first of equals; -1 if there is none."""
    around = F.filter(elements, lambda e: x.between(e["l"], e["r"]) & y.between(e["t"], e["b"]))
    sized = F.transform(around, lambda e, k: F.struct(((e["r"] - e["l"]).cast("bigint") * (e["b"] - e["t"])).alias("area"), k.alias("k"), e["index"].alias("index")))
    return F.coalesce(F.array_min(sized)["index"], F.lit(-1))


def action_fields(elements: Column) -> dict[str, Column]:
    """kind, parameter (a JSON object, null without), and index of an event's action; the kind is null for what isn't one."""
    kind = F.col("action_type")
    name = F.lit(None).cast("string")
    for event, action in ACTIONS.items():
        name = F.when(kind == event, action).otherwise(name)
    index = F.coalesce("element_index", F.lit(-1))
    aimed = F.when(kind.isin(*AIMED) & (index < 0), aim(elements, F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0)))).when(kind.isin(*UNAIMED), -1).otherwise(index)
    moved = F.col("x1").isNotNull() & F.col("x2").isNotNull()
    gap = lambda c: F.when(moved, F.coalesce(F.col(f"{c}2"), F.lit(0)) - F.coalesce(F.col(f"{c}1"), F.lit(0)))
    direction = F.concat(F.lit('"direction": "'), event_direction(gap("x"), gap("y")), F.lit('"'))
    said = F.concat(F.lit('"text": '), quoted(F.coalesce("text", F.lit(""))))
    return {"kind": name, "parameter": F.when(kind == "swipe", direction).when(kind == "input_text", said), "index": aimed.cast("int")}


def action_json(event: Column, kind: Column, parameter: Column, index: Column) -> Column:
    """The action on lines of their own, indented by two."""
    params = F.coalesce(F.concat(F.lit("{\n    "), parameter, F.lit("\n  }")), F.lit("{}"))
    default = F.when(event == "tap", "true").otherwise("false")
    return F.concat(F.lit('{\n  "type": "'), kind, F.lit('",\n  "params": '), params, F.lit(',\n  "default": '), default, F.lit(',\n  "index": '), index.cast("string"), F.lit("\n}"))


def candidates(events: DataFrame, observations: DataFrame) -> DataFrame:
    """(session, package, frame_index, page_key, observation, human, gpt, a, b) of all transitions that change the screen by an action.

    ``observations`` are (session, page_key, observation, encoded, elements). ``a`` is the md5 of both texts, ``b`` that of package,
    both pages and the action: pages are numbered anew in each package, texts mean the same in all.
    """
    seen = lambda prefix, *more: observations.select("session", F.col("page_key").alias(f"{prefix}page_key"), F.col("observation").alias(f"{prefix}observation"), F.col("encoded").alias(f"{prefix}encoded"), *more)
    before = seen("", "elements")
    after = observations.select("session", F.col("page_key").alias("after_page"), F.col("observation").alias("after_observation"), F.col("encoded").alias("after"))
    both = transitions(events).join(before, ["session", "page_key", "observation"]).join(after, ["session", "after_page", "after_observation"])
    changed = both.where("encoded <> '' AND after <> '' AND encoded <> after")
    acted = changed.withColumns(action_fields(F.col("elements"))).where("kind IS NOT NULL").withColumn("action", action_json(F.col("action_type"), F.col("kind"), F.col("parameter"), F.col("index")))
    human = F.concat(F.lit(BEFORE_SCREEN), "encoded", F.lit(BEFORE_ACTION), "action")
    out = acted.select("session", "package", "frame_index", "page_key", "observation", "after_page", "action", human.alias("human"), F.col("after").alias("gpt"))
    zero = F.lit("\u0000")
    return out.withColumns({"a": F.md5(F.concat("human", zero, "gpt")), "b": F.md5(F.concat_ws("\u0000", "package", F.col("page_key").cast("string"), "action", F.col("after_page").cast("string")))})


def converted(events: DataFrame, observations: DataFrame, kept: DataFrame | None = None, label: str = "session") -> DataFrame:
    """The examples of all sessions, each transition once: (session, frame_index, image, human, gpt, a, b).

    Sessions are read in the order of ``label`` (a number), their events by frame. One of two signatures met before is enough for an
    example to go, also where it was met in another session; ``kept`` has the signatures of examples of earlier sessions, so sessions
    that come later give the same examples as all at once. Images are numbered within a session by the examples that stay.
    """
    rows = candidates(events, observations)
    stay = either_once(rows.select(label, "frame_index", "a", "b"), [label, "frame_index"], kept=kept)
    chosen = rows.join(stay.select(label, "frame_index", "a", "b"), [label, "frame_index", "a", "b"], "left_semi")
    number = F.row_number().over(Window.partitionBy("session").orderBy("frame_index"))
    image = F.format_string("episode_%06d_step_%04d.png", F.col(label), number)
    return chosen.select("session", "frame_index", image.alias("image"), "human", "gpt", "a", "b")

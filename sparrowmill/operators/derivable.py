"""Whether an element of the next screen could be told from the current one and the action, as joins of long element tables."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from sparrowmill.functions import actions as A
from sparrowmill.functions import columns as C
from sparrowmill.functions import markup
from sparrowmill.functions.matching import CORNER

#: fixed values: what a keyboard's panel is, and where an action's own texts are
KEY = re.compile(r"[A-Za-z0-9+*#]{1,4}")
KEYS, KEY_SHARE, TOP, HEIGHT = 15, 0.40, 0.35, 1876
PAYLOAD = ("text", "app_name")


def own_texts(node: markup.Node) -> list[str]:
    """Texts of an element itself, sorted and distinct."""
    return sorted({x.strip() for x in (*(node.attributes.get(n) or "" for n in markup.NAMING), *node.direct)} - {""})


def panel(doc: markup.Document, height: int = HEIGHT) -> range:
    """Places of the elements of a keyboard: of the subtrees that are mostly keys and don't reach the top of the screen, the one with most keys."""
    nodes = doc.nodes
    leaf = np.array([n.end == k + 1 for k, n in enumerate(nodes)], bool)
    label = [(n.attributes.get("aria-label") or "").strip() or "".join(n.direct).strip() for n in nodes]
    key = leaf & np.array([bool(KEY.fullmatch(x)) for x in label], bool)
    leaves, keys = (np.concatenate([[0], np.cumsum(x)]) for x in (leaf, key))
    boxes = [[int(x) for pair in CORNER.findall(n.attributes.get("bounds") or "")[:2] for x in pair] for n in nodes]
    height = max((b[3] for b in boxes if len(b) >= 4), default=height)
    best, most = range(0), 0
    for k, n in enumerate(nodes):
        has, of = keys[n.end] - keys[k], leaves[n.end] - leaves[k]
        low = len(boxes[k]) < 4 or boxes[k][1] >= TOP * height
        if has >= KEYS and has >= KEY_SHARE * of and low and has > most:
            best, most = range(k, n.end), has
    return best


_OWN = pa.list_(pa.struct([("pos", pa.int32()), ("own", pa.string()), ("bounds", pa.string()), ("index", pa.string()), ("panel", pa.bool_())]))


def _own(text: str | None) -> list[dict]:
    doc = markup.parsed(text)
    keys = panel(doc)
    return [{"pos": k, "own": " | ".join(own_texts(n)), "bounds": n.attributes.get("bounds") or "", "index": n.attributes.get("index") or "", "panel": k in keys} for k, n in enumerate(doc.nodes)]


@F.arrow_udf(from_arrow_type(_OWN))
def own_elements(texts: pa.Array) -> pa.Array:
    """pos, own text, bounds, index of each element, and whether it is of the keyboard's panel."""
    return pa.array([_own(x.as_py()) for x in texts], _OWN)


def _long(df: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    rows = df.select(F.col(key).alias("key"), *more, F.explode(own_elements(text)).alias("e")).select("key", *more, "e.*")
    return rows.withColumns({"low": F.lower("own"), "slot": A.slot(F.col("bounds"), F.col("index"))})


def _acted(action: Column) -> Column:
    return F.coalesce(F.try_parse_json(action), A.last_action(action))


def _judged(df: DataFrame, key: str, current: str, following: str, action: str) -> tuple[DataFrame, DataFrame]:
    """Elements of the next screen with label, rule and what it rests on, and those of the current one that have a text."""
    now = _long(df, key, current)
    told = now.where("own <> ''")
    slots = told.where("slot <> ''").groupBy("key", "slot", "low").agg(F.min("pos").alias("at_slot"))
    texts = told.groupBy("key", "low").agg(F.max("panel").alias("on_panel"), F.min("pos").alias("at_text"))
    panels = now.groupBy("key").agg(F.max("panel").alias("had_panel"))
    a = F.col("act")
    number = lambda k: A.value(a, f"$.coordinate[{k}]", "double").cast("int")
    said = F.array(*(F.struct(F.lit(k).alias("name"), F.lower(F.trim(A.value(a, f"$.{k}", "string"))).alias("said")) for k in PAYLOAD))
    acted = df.select(F.col(key).alias("key"), _acted(F.col(action)).alias("act")).select(
        "key",
        F.filter(said, lambda x: x["said"].isNotNull() & (x["said"] != "")).alias("said"),
        number(0).alias("x"),
        number(1).alias("y"),
        F.nullif(F.trim(A.value(a, "$.index", "string")), F.lit("")).alias("aimed"),
    )
    rows = _long(df, key, following).join(acted, "key").join(panels, "key", "left").join(slots, ["key", "slot", "low"], "left").join(texts, ["key", "low"], "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    suggested = (F.col("own") != "") & yes(F.col("had_panel")) & ~yes(F.col("on_panel"))
    box = C.box(F.col("bounds"))
    inside = F.col("x").between(box["l"], box["r"]) & F.col("y").between(box["t"], box["b"])
    spoken = F.get(F.filter("said", lambda s: F.col("low").contains(s["said"])), 0)["name"]
    pointed = F.col("x").isNotNull() & F.col("y").isNotNull()
    judged = (
        F.when(F.col("panel") & ~suggested, _verdict("SYSTEM_UI", "keyboard"))
        .when(F.col("own") == "", _verdict("STRUCTURE", "no text"))
        .when(F.col("at_slot").isNotNull(), _verdict("COPY", "same slot and text"))
        .when(F.col("at_text").isNotNull(), _verdict("REFLOW", "text elsewhere"))
        .when(spoken.isNotNull(), _verdict("ACTION_PAYLOAD", F.concat(F.lit("payload "), spoken)))
        .when(yes(inside), _verdict("ACTION_TARGET", "point inside"))
        .when(yes(F.col("index") == F.col("aimed")), _verdict("ACTION_TARGET", "same index"))
        .when(pointed & box.isNull(), _verdict("NON_DERIVABLE", UNDECIDABLE))
        .otherwise(_verdict("NON_DERIVABLE", "none"))
    )
    known = F.when(judged["label"] == "COPY", F.col("at_slot")).when(judged["label"] == "REFLOW", F.col("at_text"))
    return rows.withColumns({"judged": judged, "known": known}), told


#: the rule of an element without bounds beside an action at a point: whether it was aimed at can't be told
UNDECIDABLE = "no bounds"


def _verdict(label: str, rule: str | Column) -> Column:
    return F.struct(F.lit(label).alias("label"), (F.lit(rule) if isinstance(rule, str) else rule).alias("rule"))


def classes(df: DataFrame, key: str, current: str, following: str, action: str) -> DataFrame:
    """(key, pos, own, label, derivable) of each element of the next screen; the first that holds gives the label.

    SYSTEM_UI: on a keyboard, but for texts new to a keyboard that was there before. STRUCTURE: no own text. COPY: the same
    text at the same bounds (or index). REFLOW: the same text elsewhere. ACTION_PAYLOAD: holds a text of the action.
    ACTION_TARGET: around the action's point, or of its index. NON_DERIVABLE: all else. Keys are distinct.
    """
    rows, _ = _judged(df, key, current, following, action)
    return rows.select("key", "pos", "own", F.col("judged.label").alias("label")).withColumn("derivable", F.col("label") != "NON_DERIVABLE")


def reasons(df: DataFrame, key: str, current: str, following: str, action: str) -> DataFrame:
    """(key, pos, own, label, rule, matched, text_sim, undecidable) of each element of the next screen.

    ``matched`` is the place of the current element that the label rests on: the first of the same text (at the slot, or anywhere).
    What no rule fits is told as "slot with other text" if its slot had elements with a text, of which the most similar one (of
    equals the first) is matched. ``text_sim`` has four decimals, 0 without a match.
    """
    rows, told = _judged(df, key, current, following, action)
    rows = rows.select("key", "pos", "own", "slot", "judged.label", "judged.rule", "known")
    there = told.select("key", "slot", F.col("pos").alias("other"), F.col("own").alias("text")).where("slot <> ''")
    near = rows.where("rule = 'none'").join(there, ["key", "slot"]).withColumn("sim", C.text_sim(F.col("text"), F.col("own")))
    near = near.groupBy("key", "pos").agg(F.max_by(F.struct("other", "sim"), F.struct("sim", -F.col("other"))).alias("near"))
    texts = told.select("key", F.col("pos").alias("known"), F.col("own").alias("known_text"))
    both = rows.join(near, ["key", "pos"], "left").join(texts, ["key", "known"], "left")
    sim = F.coalesce(F.col("near.sim"), F.when(F.col("known").isNotNull(), C.text_sim(F.col("known_text"), F.col("own"))), F.lit(0.0))
    return both.select(
        "key",
        "pos",
        "own",
        "label",
        F.when(F.col("near").isNotNull(), "slot with other text").otherwise(F.col("rule")).alias("rule"),
        F.coalesce(F.col("near.other"), F.col("known")).alias("matched"),
        F.round(sim, 4).alias("text_sim"),
        (F.col("rule") == UNDECIDABLE).alias("undecidable"),
    )


def totals(found: DataFrame, by: str) -> DataFrame:
    """Per value of ``by``: elements, those not derivable, those with a text of their own, these not derivable, and the undecidable ones."""
    lost, own = F.col("label") == "NON_DERIVABLE", F.col("own") != ""
    return found.groupBy(by).agg(F.count("*").alias("n"), F.count_if(lost).alias("underivable"), F.count_if(own).alias("own_text"), F.count_if(own & lost).alias("own_underivable"), F.count_if("undecidable").alias("undecidable"))


def counts(classified: DataFrame) -> DataFrame:
    """(key, one column for each label) with zeros."""
    labels = ("SYSTEM_UI", "STRUCTURE", "COPY", "REFLOW", "ACTION_PAYLOAD", "ACTION_TARGET", "NON_DERIVABLE")
    return classified.groupBy("key").agg(*(F.count_if(F.col("label") == x).alias(x.lower()) for x in labels))

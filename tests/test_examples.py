"""First rows of two signatures, and sessions made into examples, against plain walks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sparrowmill.operators import examples
from sparrowmill.operators.firsts import either_once


def walked(rows, kept=()):
    a_seen, b_seen, out = {a for a, _ in kept} - {None}, {b for _, b in kept} - {None}, []
    for order, a, b in sorted(rows, key=lambda r: (r[0], r[1] or "", r[2] or "")):
        if a not in a_seen and b not in b_seen:
            out.append((order, a, b))
            a_seen |= {a} - {None}
            b_seen |= {b} - {None}
    return out


SIGNED = "seq bigint, a string, b string"


@pytest.mark.parametrize("seed, n, wide", [(1, 150, 30), (3, 80, 200), (4, 40, 2)])
def test_either_once_is_a_walk(spark, seed, n, wide):
    rng = random.Random(seed)
    sign = lambda p: None if rng.random() < 0.05 else f"{p}{rng.randrange(wide)}"
    rows = [(k, sign("a"), sign("b")) for k in range(n)]
    distinct = []
    for r in rows:  # of equal pairs with a null the first alone can stay as well
        if not any(r[1:] == d[1:] for d in distinct):
            distinct.append(r)
    got = either_once(spark.createDataFrame(rows, SIGNED).repartition(5), ["seq"])
    assert sorted(tuple(r) for r in got.collect()) == sorted(walked(distinct))


def test_chains_and_batches(spark):
    """Each row shares one signature with the next: every second stays, and batches give what one run gives."""
    rows = [(k, f"a{k // 2}", f"b{(k + 1) // 2}") for k in range(12)]
    df = spark.createDataFrame(rows, SIGNED)
    whole = sorted(tuple(r) for r in either_once(df, ["seq"]).collect())
    assert whole == walked(rows)
    first = either_once(df.where("seq < 5"), ["seq"])
    more = either_once(df.where("seq >= 5"), ["seq"], kept=first)
    assert sorted(tuple(r) for r in first.unionByName(more).collect()) == whole
    assert either_once(df.where("false"), ["seq"]).count() == 0


EVENT = "session int, package string, frame_index int, page_key string, observation int, action_type string, element_index int, x int, y int, x1 int, y1 int, x2 int, y2 int, text string, transition boolean, no_change_retry boolean"
ELEMENTS = [(0, 0, 0, 100, 100), (1, 10, 10, 50, 50), (2, 10, 10, 50, 50), (3, 40, 40, 60, 60)]
KINDS = {"tap": "Click", "swipe": "Swipe", "input_text": "Input", "press_back": "Back", "long_press": "LongClick", "press_home": "Home"}


def made_events(seed, sessions=3, n=30):
    rng = random.Random(seed)
    out = []
    for s in range(1, sessions + 1):
        for k in range(n):
            kind = rng.choice([*KINDS, "tap", "open_app"])
            out.append((s, f"app{s % 2}", k, rng.choice(["0", "1", "2", None]), rng.choice([0, 1]), kind, rng.choice([None, -1, -1, 5]), rng.randrange(120), rng.randrange(120), rng.choice([None, 1, 9]), rng.choice([None, 3]), rng.choice([None, 4]), rng.choice([None, 7]), rng.choice([None, 'a "q" é\n', "🙂x"]), rng.choice([None, None, True, False]), rng.choice([None, None, False, True])))
    return out


def action_of(e):
    (_, _, _, _, _, kind, index, x, y, x1, y1, x2, y2, text, *_) = e
    if kind not in KINDS:
        return None
    index = -1 if index is None else index
    if kind in ("tap", "long_press") and index < 0:
        around = [el for el in ELEMENTS if el[1] <= x <= el[3] and el[2] <= y <= el[4]]
        index = min(around, key=lambda el: (el[3] - el[1]) * (el[4] - el[2]))[0] if around else -1
    params = {}
    if kind == "swipe":
        dx, dy = ((x2 or 0) - (x1 or 0), (y2 or 0) - (y1 or 0)) if x1 is not None and x2 is not None else (0, -1)
        params = {"direction": ("Down" if dy > 0 else "Up") if abs(dy) >= abs(dx) else "Right" if dx > 0 else "Left"}
    if kind == "input_text":
        params = {"text": text or ""}
    return {"type": KINDS[kind], "params": params, "default": kind == "tap", "index": -1 if kind in ("press_back", "press_home") else index}


def encoded(page, observation):
    return "" if (page, observation) == ("2", 0) else f"<p>{page}{observation}é</p>" if page != "1" else "<p>one</p>"


def walked_examples(events):
    xml_seen, page_seen, out = set(), set(), []
    for session in sorted({e[0] for e in events}):
        rows = [e for e in sorted(events) if e[0] == session and e[14] is not False and not e[15] and e[3] is not None]
        count = 0
        for e, nxt in zip(rows, rows[1:]):
            if e[3:5] == nxt[3:5] or (e[3], e[4]) == ("0", 1) or (nxt[3], nxt[4]) == ("0", 1):
                continue  # the last one has no observation
            before, after, action = encoded(*e[3:5]), encoded(*nxt[3:5]), action_of(e)
            if not before or not after or before == after or action is None:
                continue
            human = f"<image>\n## Current State\n{before}\n\n## Action\n{json.dumps(action, indent=2)}"
            keys = (human, after), (e[1], e[3], json.dumps(action, sort_keys=True), nxt[3])
            if keys[0] in xml_seen or keys[1] in page_seen:
                continue
            xml_seen.add(keys[0])
            page_seen.add(keys[1])
            count += 1
            out.append((session, e[2], f"episode_{session:06d}_step_{count:04d}.png", human, after))
    return out


def observations(spark, events):
    element = "array<struct<index int, l int, t int, r int, b int>>"
    rows = sorted({(e[0], e[3], e[4], encoded(e[3], e[4]), tuple(ELEMENTS)) for e in events if e[3] is not None and (e[3], e[4]) != ("0", 1)})
    return spark.createDataFrame([(*r[:4], list(r[4])) for r in rows], f"session int, page_key string, observation int, encoded string, elements {element}")


@pytest.mark.parametrize("seed", [1])
def test_sessions_become_examples(spark, seed):
    events = made_events(seed)
    df, seen = spark.createDataFrame(events, EVENT).repartition(4), observations(spark, events)
    plain = lambda d: sorted(tuple(r) for r in d.select("session", "frame_index", "image", "human", "gpt").collect())
    whole = examples.converted(df, seen)
    assert plain(whole) == walked_examples(events)
    first = examples.converted(df.where("session < 3"), seen)
    more = examples.converted(df.where("session >= 3"), seen, kept=first)
    assert plain(first.unionByName(more)) == plain(whole)


def test_json_texts(spark):
    texts = ["", "plain", 'q"\\/', "é\n\t", "中🙂", None]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").select("k", examples.quoted(F.coalesce("text", F.lit(""))).alias("j")).collect()
    assert [r.j for r in sorted(got)] == [json.dumps(t or "") for t in texts]

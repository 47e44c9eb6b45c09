"""Queries over typed actions, older prompts, pictures, features, packed screens, moved references and layouts, and forms made anew."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowmill.functions import pictures, prompts, typed
from sparrowmill.functions import screens as S
from sparrowmill.operators import contracts, packed, rewrites
from sparrowmill.plans.built import sampled
from sparrowmill.plans.registry import query
from sparrowmill.plans.screened import ENCODED, LINES, dumps
from sparrowmill.sources import files

K = "CAST(json_extract_string(props, '$.k') AS INT)"


@query("fn17_typed_actions", f"""SELECT event_id, kind AS action_type, CASE WHEN event_id % 2 = 0 THEN event_id::INT ELSE -1 END AS element_index, CASE WHEN kind = 'tap' THEN k WHEN kind IN ('long_press', 'input_text') THEN 0 END AS x,
  CASE kind WHEN 'swipe' THEN 300 WHEN 'long_press' THEN k END AS duration_ms, CASE kind WHEN 'input_text' THEN event_type END AS text,
  CASE kind WHEN 'tap' THEN '{{"action_type":"tap","element_index":' || CASE WHEN event_id % 2 = 0 THEN event_id ELSE -1 END || ',"x":' || k || ',"y":0}}' END AS tap
  FROM (SELECT *, {K} AS k, ['tap', 'swipe', 'input_text', 'press_back', 'long_press', 'shake', 'unknown'][event_id % 7 + 1] AS kind FROM events) e WHERE event_id % 11 <> 0""")
def fn17(t):
    """Actions with keys of other kinds; every seventh names no kind, every eleventh is an empty object."""
    k, id_ = F.get_json_object("props", "$.k"), F.col("event_id").cast("string")
    kinds = F.array(*(F.lit(f'"action_type":"{n}"') for n in ("tap", "swipe", "input_text", "press_back", "long_press", "shake")), F.lit('"other":1'))
    at = (F.col("event_id") % 7).cast("int")
    own = F.when(at == 0, F.concat(F.lit(',"x":'), k)).when(at == 4, F.concat(F.lit(',"duration_ms":'), k)).otherwise("")
    more = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(',"element_index":'), id_)).otherwise("")
    text = F.when(F.col("event_id") % 11 == 0, "{}").otherwise(F.concat(F.lit("{"), F.get(kinds, at), F.lit(',"text":"'), "event_type", F.lit('"'), own, more, F.lit("}")))
    rows = t["events"].select("event_id", typed.typed(F.try_parse_json(text)).alias("a")).where("a IS NOT NULL")
    return rows.select("event_id", "a.action_type", "a.element_index", "a.x", "a.duration_ms", "a.text", F.when(F.col("a.action_type") == "tap", typed.as_json(F.col("a"))).alias("tap"))


@query("fn21_older_prompt_parts", """SELECT conv_id, turn, md5(CASE WHEN turn % 3 <> 2 THEN role ELSE 'system' || chr(10) || role || chr(10) || 'user' || chr(10) || text END) AS system, md5(CASE WHEN turn % 3 <> 2 THEN text ELSE '' END) AS state,
  CASE WHEN turn % 3 <> 2 THEN 'act ' || turn ELSE '' END AS action FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL AND NOT contains(text, '## Action')""")
def fn21(t):
    """Turns as states of older prompts with their role as system part; every third lacks the marks of state and action."""
    rows = t["conversations"].where("text IS NOT NULL AND role IS NOT NULL AND NOT contains(text, '## Action')")
    act = F.concat(F.lit("act "), F.col("turn").cast("string"))
    full = F.concat(F.lit("system\n"), "role", F.lit("\nuser\n\n## Current State\n"), "text", F.lit("\n\n## Action\n"), act, F.lit("\nassistant"), F.when(F.col("turn") % 2 == 0, "\n").otherwise(""))
    other = F.concat(F.lit("system\n"), "role", F.lit("\nuser\n"), "text")
    p = prompts.older_parts(F.when(F.col("turn") % 3 != 2, full).otherwise(other))
    return rows.select("conv_id", "turn", p.alias("p")).select("conv_id", "turn", F.md5("p.system").alias("system"), F.md5("p.state").alias("state"), "p.action")


PIXELS = """p AS (SELECT vec_id, i - 1 AS pos, v AS r, (v * 3) & 255 AS g, (v * 7) & 255 AS b FROM (SELECT vec_id, unnest(generate_series(1, len(embedding))) AS i, unnest(list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * 1000) AS INT) & 255)) AS v FROM embeddings) e)"""


def drawn(t) -> DataFrame:
    """(vec_id, picture): vectors as pictures of eight rows of pixels."""
    v = lambda x: F.floor(x.cast("double") * 1000).cast("int").bitwiseAND(F.lit(255))
    pixel = lambda x: v(x) * 65536 + (v(x) * 3).bitwiseAND(F.lit(255)) * 256 + (v(x) * 7).bitwiseAND(F.lit(255))
    picture = F.struct(F.floor(F.size("embedding") / 8).cast("int").alias("width"), F.lit(8).alias("height"), F.transform("embedding", pixel).alias("pixels"))
    return t["embeddings"].select("vec_id", picture.alias("picture"))


@query("fn62_changed_share", f"WITH {PIXELS}, y AS (SELECT vec_id, pos, (r * 77 + g * 150 + b * 29) >> 8 AS y FROM p) SELECT a.vec_id, count_if(abs(a.y - b.y) > 40) / count(*) AS share FROM y a JOIN y b ON b.vec_id = a.vec_id + 1 AND a.pos = b.pos GROUP BY a.vec_id")
def fn62(t):
    after = drawn(t).select((F.col("vec_id") - 1).alias("vec_id"), F.col("picture").alias("after"))
    return drawn(t).join(after, "vec_id").select("vec_id", pictures.changed_share(F.col("picture"), F.col("after"), 40).alias("share"))


@query("fn63_frame_hash", f"""WITH {PIXELS}, w AS (SELECT vec_id, len(embedding) // 8 AS width FROM embeddings),
c AS (SELECT vec_id, (pos // width) // 2 AS gy, (pos % width) // (width // 4) AS gx, (sum((r + g + b) // 3))::BIGINT // count(*) AS mean FROM p JOIN w USING (vec_id) WHERE (pos % width) // (width // 4) < 4 GROUP BY ALL)
SELECT vec_id, string_agg(lower(lpad(hex(mean), 2, '0')), '' ORDER BY gy, gx) AS hash FROM c GROUP BY vec_id""")
def fn63(t):
    return drawn(t).select("vec_id", pictures.frame_hash(F.col("picture"), 4).alias("hash"))


@query("msc04_feature_json", f"""SELECT event_id, CASE event_id % 5 WHEN 0 THEN {K}::VARCHAR WHEN 1 THEN '[' || event_id || ',' || {K} || ']' WHEN 2 THEN '"' || event_type || '"' WHEN 3 THEN '["' || event_type || '","<20 bytes omitted>"]' END AS value FROM events""")
def msc04(t):
    """Features of every kind; the fifth has no values, and one of twenty bytes is beyond the limit."""
    k, kind = F.get_json_object("props", "$.k").cast("bigint"), F.col("event_type").cast("binary")
    n = F.col("event_id") % 5
    ints = F.when(n == 0, F.array(k)).when(n == 1, F.array("event_id", k)).otherwise(F.array().cast("array<bigint>"))
    raw = F.when(n == 2, F.array(kind)).when(n == 3, F.array(kind, F.lit("x" * 20).cast("binary"))).otherwise(F.array().cast("array<binary>"))
    return t["events"].select("event_id", typed.feature_json(ints, raw, 19).alias("value"))


@query("msc22_packed_screens", f"SELECT l_orderkey, max(q) AS width, 99 AS height, (count(*) + 1)::INT AS n_items, 1 AS deepest, string_agg(k || ':' || q || ':b:[0,' || l_linenumber || '][' || q || ',99]', '|' ORDER BY k) AS items FROM {LINES} x GROUP BY l_orderkey HAVING count(*) > 1")
def msc22(t):
    """Parsed forms of orders' screens: an unbounded frame around buttons (screens of one button have no frame)."""
    shown = packed.packed(dumps(t).select("l_orderkey", S.screen("xml", "parsed")["parsed"].alias("parsed")), "l_orderkey", "parsed").where(F.size("items") > 2)
    bounded = F.filter("items", lambda i: i["box"].isNotNull())
    text = F.transform(bounded, lambda i: F.concat_ws(":", i["pos"].cast("string"), i["text"], i["slot"]))
    depth = F.array_max(F.transform("items", lambda i: i["depth"])) - F.array_min(F.transform("items", lambda i: i["depth"]))
    return shown.select(F.col("key").alias("l_orderkey"), "screen.width", "screen.height", F.size("items").alias("n_items"), depth.alias("deepest"), F.array_join(text, "|").alias("items"))


REFERENCES = f"""r AS (SELECT event_id, {K} AS k, event_type, CASE WHEN event_id % 90 = 0 THEN 'other keys' WHEN event_id % 70 = 0 THEN 'unknown reference' WHEN event_id % 50 = 0 THEN 'reference not exactly once' END AS fault FROM events)"""
NEW_REF = "CASE WHEN event_id % 9 = 5 THEN 'pool/home.jpg' ELSE 'pool/episode_' || CASE WHEN event_id < 1000000 THEN lpad(event_id::VARCHAR, 6, '0') ELSE event_id::VARCHAR END || '_step_' || k || '.jpg' END"


def referring(t) -> DataFrame:
    """(event_id, line): records with one image; some have an odd key, an odd reference or the reference twice."""
    k, id_ = F.get_json_object("props", "$.k"), F.col("event_id")
    ref = F.when(id_ % 70 == 0, "elsewhere/a.png").when(id_ % 9 == 5, "own/home.jpg").otherwise(F.concat(F.lit("own/episode_"), id_.cast("string"), F.lit("_step_"), k, F.lit(".jpg")))
    again, more = F.when(id_ % 50 == 0, ref).otherwise(""), F.when(id_ % 90 == 0, ',"token_weights":[1.0]').otherwise("")
    line = F.concat(F.lit('{"messages": [{"from":"human","value":"<image> '), "event_type", again, F.lit('"}],  "images":["'), ref, F.lit('"]'), more, F.lit("}"))
    return t["events"].select("event_id", line.alias("line"))


@query("bld03_moved_references", f"WITH {REFERENCES} SELECT event_id, fault, CASE WHEN fault IS NULL THEN md5('{{\"messages\": [{{\"from\":\"human\",\"value\":\"<image> ' || event_type || '\"}}],  \"images\":[\"' || {NEW_REF} || '\"]}}') END AS new_text FROM r")
def bld03(t):
    moved = rewrites.references(referring(t), "line", rewrites.moved_images("pool", "own"))
    return moved.select("event_id", "fault", F.md5("new_text").alias("new_text"))


@query("bld03_reference_rules", f"""WITH {REFERENCES}, s AS (SELECT *, {NEW_REF} AS ref FROM r WHERE fault IS NULL) SELECT * FROM (SELECT 'lines lost or too many' AS rule, (2 * count(fault))::INT AS broken FROM r
  UNION ALL SELECT 'old folder', 0 UNION ALL SELECT 'marks and images', 0 UNION ALL SELECT 'images without a file', count(DISTINCT ref)::INT FROM s WHERE event_id % 13 = 0 AND ref <> 'pool/home.jpg') x""")
def bld03_rules(t):
    """Rules over the sound records; the pictures of every thirteenth aren't stored."""
    moved = rewrites.references(referring(t), "line", rewrites.moved_images("pool", "own"))
    sound = moved.where("fault IS NULL")
    home = F.array_contains("new_images", "pool/home.jpg")
    there = sound.where((F.col("event_id") % 13 != 0) | home).select(F.explode("new_images").alias("path"))
    n = t["events"].count()
    found = rewrites.reference_rules(n, n, "own/", there)(sound)
    return reduce(DataFrame.unionByName, [rows.agg(F.count("*").cast("int").alias("broken")).select(F.lit(rule).alias("rule"), "broken") for rule, rows in found.items()])


LISTED = """l AS (SELECT DISTINCT user_id AS u, event_id % 8 AS n, event_type AS e FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL)"""


def listed(t) -> DataFrame:
    """(path): an old page folder for each user, a new one beside it for users divisible by 5, and a folder that isn't a page's."""
    u, n, e = F.col("user_id").cast("string"), F.col("event_id") % 8, F.col("event_type")
    rows = t["events"].where("user_id IS NOT NULL AND event_type IS NOT NULL").select("user_id", u.alias("u"), n.cast("string").alias("n"), e.alias("e")).distinct()
    old = F.concat(F.lit("app/pages/page_"), "u", F.lit("/000"), "n", F.lit("/"), "e", F.lit(".xml"))
    new = F.when(F.col("user_id") % 5 == 0, F.concat(F.lit("app/pages/"), "u", F.lit("/page.json")))
    odd = F.concat(F.lit("app/pages/misc/000"), "n", F.lit("/"), "u", F.lit(".xml"))
    return rows.select(F.explode(F.array_compact(F.array(old, new, odd))).alias("path")).distinct()


@query("bld08_layout_plan", f"""WITH {LISTED} SELECT DISTINCT 'app/pages/page_' || u || '/000' || n || '/' || e || '.xml' AS path, 'app/pages/' || CASE WHEN u % 5 = 0 THEN 'page_' ELSE '' END || u || '/' || n || '/' || e || '.xml' AS new_path, CASE WHEN u % 5 = 0 THEN 'taken' ELSE 'moves' END AS status FROM l
UNION ALL SELECT DISTINCT 'app/pages/' || u || '/page.json', 'app/pages/' || u || '/page.json', 'stays' FROM l WHERE u % 5 = 0
UNION ALL SELECT DISTINCT 'app/pages/misc/000' || n || '/' || u || '.xml', 'app/pages/misc/000' || n || '/' || u || '.xml', 'stays' FROM l""")
def bld08(t):
    return rewrites.layout_plan(listed(t))


@query("bld08_plan_of_moved", f"WITH {LISTED} SELECT 'stays' AS status, count(DISTINCT u || '|' || n || '|' || e) AS files FROM l WHERE u % 5 <> 0")
def bld08_again(t):
    """The plan of the tree as it is after the moves: nothing is left to do but for what was taken."""
    moved = rewrites.layout_plan(listed(t)).where("status = 'moves'").select(F.col("new_path").alias("path"))
    return rewrites.layout_plan(moved).groupBy("status").agg(F.count("*").alias("files"))


@query("bld02_weight_contract", """SELECT 'images and answer' AS breach, count(*) AS samples FROM pages a WHERE page_id % 10 = 5 AND EXISTS (FROM pages b WHERE b.page_id = a.page_id - 1) HAVING count(*) > 0""")
def bld02(t):
    """Pages weighed the damped way: the samples told as actions by their images alone are the only ones that break the contract."""
    found = contracts.breaches(sampled(t, "uniform"), "damped", 0.25)
    return found.groupBy("breach").agg(F.count("*").alias("samples"))


@query("xml07_regenerated_forms", f"SELECT l_orderkey, CASE WHEN l_orderkey % 3 = 0 THEN 'flat' ELSE 'paged' END AS package, 4 AS forms, md5(encoded) AS encoded FROM {ENCODED} e")
def xml07(t):
    """Dumps in both layouts; a flat dump of a package that has pages, and one that is a form already, don't count."""
    key, flat = F.col("l_orderkey").cast("string"), F.col("l_orderkey") % 3 == 0
    path = F.when(flat, F.concat(F.lit("flat/xml/"), key, F.lit(".xml"))).otherwise(F.concat(F.lit("paged/pages/"), key, F.lit("/0/raw.xml")))
    more = F.when(flat, F.concat(F.lit("flat/xml/"), key, F.lit("_parsed.xml"))).otherwise(F.concat(F.lit("paged/xml/"), key, F.lit(".xml")))
    stored = dumps(t).select(F.explode(F.array(path, more)).alias("path"), F.col("xml").cast("binary").alias("content"))
    made = files.regenerated_forms(stored).withColumn("l_orderkey", F.regexp_extract("source", r"([0-9]+)", 1).cast("bigint"))
    digest = F.max(F.when(F.col("path").endswith("encoded.xml"), F.md5("content")))
    return made.groupBy("l_orderkey", "package").agg(F.count("path").cast("int").alias("forms"), digest.alias("encoded"))

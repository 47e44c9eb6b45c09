"""Queries over sessions of screens: pages told apart, their graph, and examples made from events.

Screens are made from events: four of a user's events in a row are one screen, with a line for each.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparrowmill.operators import examples, identity
from sparrowmill.operators.firsts import either_once
from sparrowmill.operators.ordering import held
from sparrowmill.plans.registry import query


def screens(t):
    e = t["events"].withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = e.withColumn("seq", F.floor(place / 4))
    line = F.concat(F.lit("<"), "event_type", F.lit(">"), (F.col("k") % 3).cast("string"))
    kinds = F.array_join(F.array_sort(F.collect_set("event_type")), ",")
    made = rows.groupBy(F.col("user_id").alias("session"), "seq").agg(
        F.array_sort(F.collect_list(line)).alias("lines"),
        F.array_sort(F.collect_set(F.concat_ws(":", "event_type", (F.col("k") % 4).cast("string")))).alias("shape"),
        F.md5(F.concat(kinds, (F.sum("k") % 5).cast("string"))).alias("fingerprint"),
        F.bool_or(F.col("event_type").isin("click", "view")).alias("interactable"),
        F.min("event_type").alias("first"),
        F.min("event_id").alias("event_id"),
    )
    app = F.concat(F.lit("app"), (F.floor(F.col("seq") / 5) % 2).cast("string"), F.lit("/"), "first")
    picture = F.struct(F.lit(2).alias("width"), F.unhex(F.substring("fingerprint", 1, 8)).alias("pixels"))
    return made.withColumns({"activity": F.when(F.col("seq") % 9 == 0, "").otherwise(app), "luma": F.when(F.col("event_id") % 3 == 0, picture)})


@query("str01_screen_matches")
def str01_matches(t):
    return identity.decided(screens(t)).select("session", "part", "seq", "match_type", "page", "observation", "is_new_observation", F.size("candidates").alias("n_candidates"))


@query("str02_resumed_matches")
def str02(t):
    """The same screens in two batches: the later one starts from the memory that the log of the earlier gives."""
    rows = identity.parted(screens(t))
    early = identity.decided(rows.where("seq < 12"))
    log = held(early, "early")
    late = identity.decided(rows.where("seq >= 12"), memory=identity.memory_of_log(log))
    return log.unionByName(late).select("session", "part", "seq", "match_type", "page", "observation", "is_new_observation", F.size("candidates").alias("n_candidates"))


@query("str03_new_page_reasons")
def str03(t):
    """With the whole session as one unit, so that candidates of other packages show."""
    return identity.reasons(identity.decided(screens(t), split=False)).select("session", "seq", "page", "reason", "n_candidates", "least_diff")


@query("agg22_absorbed_activities")
def agg22(t):
    told = identity.absorbed(identity.decided(screens(t), identity.Gates(packages=False), split=False))
    return told.select("session", "page", "n_screens", F.array_join("activities", ",").alias("activities"), F.array_join("packages", ",").alias("packages"), "crosses")


@query("grf01_shaped_pages")
def grf01(t):
    return identity.shaped(screens(t).select("session", "seq", "activity", "fingerprint", "shape"), 0.6)


RECORDED = """(SELECT user_id AS session, event_id AS seq, CASE WHEN event_id % 13 <> 0 THEN event_type || (event_id % 3) END AS page_key, event_id % 4 AS observation,
  CASE WHEN event_id % 5 = 0 THEN 'x.SoftInputWindow' ELSE ' ' || event_type END AS activity, CASE WHEN event_id % 7 <> 0 THEN event_type END AS action, event_id % 6 - 1 AS element_index FROM events)"""


def recorded(t):
    n = F.col("event_id")
    return t["events"].select(
        F.col("user_id").alias("session"),
        n.alias("seq"),
        F.when(n % 13 != 0, F.concat("event_type", (n % 3).cast("string"))).alias("page_key"),
        (n % 4).alias("observation"),
        F.when(n % 5 == 0, "x.SoftInputWindow").otherwise(F.concat(F.lit(" "), "event_type")).alias("activity"),
        F.when(n % 7 != 0, F.col("event_type")).alias("action"),
        (n % 6 - 1).alias("element_index"),
    )


NODES = f"""nodes AS (SELECT session, page_key, min(seq) AS first_seen, trim(min_by(CASE WHEN activity LIKE '%SoftInputWindow%' THEN '' ELSE activity END, seq)) AS activity, count(*) AS visits,
  count(DISTINCT observation) AS observations FROM r GROUP BY ALL), n AS (SELECT *, (row_number() OVER (PARTITION BY session ORDER BY first_seen) - 1)::INT AS page FROM nodes)"""


@query("grf03_recorded_nodes", f"WITH r AS (SELECT * FROM {RECORDED} x WHERE page_key IS NOT NULL), {NODES} SELECT session, page_key, first_seen, activity, visits, observations, page FROM n")
def grf03_nodes(t):
    return identity.recorded_graph(recorded(t))[0]


@query("grf03_recorded_edges", f"""WITH r AS (SELECT * FROM {RECORDED} x WHERE page_key IS NOT NULL), {NODES},
m AS (SELECT session, seq, lag(page_key) OVER w AS src, page_key AS dst, coalesce(lag(action) OVER w, 'unknown') AS action,
  CASE WHEN coalesce(lag(element_index) OVER w, -1) >= 0 THEN 'element_' || lag(element_index) OVER w ELSE coalesce(lag(action) OVER w, 'unknown') END AS element FROM r WINDOW w AS (PARTITION BY session ORDER BY seq)),
e AS (SELECT session, src, dst, action, min_by(element, seq) AS element, min(seq) AS first_seen, count(*) AS n FROM m WHERE src <> dst GROUP BY session, src, dst, action)
SELECT e.session, a.page AS src, b.page AS dst, e.action, e.element, e.first_seen, e.n FROM e JOIN n a ON e.session = a.session AND e.src = a.page_key JOIN n b ON e.session = b.session AND e.dst = b.page_key""")
def grf03_edges(t):
    return identity.recorded_graph(recorded(t))[1]


@query("grf03_rebuilt_edges")
def grf03_rebuilt(t):
    """Edges between pages told by shape; the action of a frame is that of the event with its number."""
    frames = identity.shaped(screens(t).select("session", "seq", "activity", "fingerprint", "shape"), 0.6)
    acts = t["events"].where("event_id % 4 <> 1").select(F.col("user_id").alias("session"), (F.col("event_id") % 40).alias("frame"), F.col("event_type").alias("action"), (F.col("event_id") % 6 - 1).alias("element_index"), F.col("event_id").alias("event"))
    return identity.rebuilt_edges(frames, acts)


def acted(t):
    """Events as actions on observations of screens: the screen's page is its first event's kind."""
    n, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("int")
    names = F.array(*(F.lit(x) for x in ("tap", "swipe", "input_text", "press_back", "long_press", "press_home", "open_app")))
    return t["events"].select(
        F.col("user_id").alias("session"),
        F.concat(F.lit("app"), (F.col("user_id") % 7).cast("string")).alias("package"),
        n.alias("frame_index"),
        F.col("event_type").alias("page_key"),
        (k % 3).alias("observation"),
        F.get(names, (n % 7).cast("int")).alias("action_type"),
        F.when(n % 4 == 0, (n % 5).cast("int")).alias("element_index"),
        (k % 10).alias("x"),
        (k % 7).alias("y"),
        F.when(n % 3 != 0, k % 5).alias("x1"),
        (k % 4).alias("x2"),
        (k % 3).alias("y1"),
        (k % 6).alias("y2"),
        F.concat(F.lit('é "'), "event_type").alias("text"),
        F.when(n % 11 == 0, False).alias("transition"),
        (n % 17 == 0).alias("no_change_retry"),
    )


def observed(t):
    """An observation for each page and number of a user, with two elements."""
    seen = acted(t).select("session", "page_key", "observation").distinct().where("NOT (page_key = 'error' AND observation = 2)")
    element = lambda i, l, r: F.struct(F.lit(i).alias("index"), F.lit(l).alias("l"), F.lit(0).alias("t"), F.lit(r).alias("r"), F.lit(9).alias("b"))
    return seen.withColumns({"encoded": F.concat(F.lit("<p>"), "page_key", F.least(F.col("observation"), F.lit(1)).cast("string"), F.lit("</p>")), "elements": F.array(element(0, 0, 9), element(1, 2, 5))})


ACTED = """(SELECT *, lead(page_key) OVER w AS after_page, lead(observation) OVER w AS after_observation FROM (
  SELECT user_id AS session, 'app' || (user_id % 7) AS package, event_id AS frame_index, event_type AS page_key, k % 3 AS observation, event_id % 7 AS what,
    CASE WHEN event_id % 4 = 0 THEN event_id % 5 ELSE -1 END AS element_index, k, event_type FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
  WHERE event_id % 11 <> 0 AND event_id % 17 <> 0) WINDOW w AS (PARTITION BY session ORDER BY frame_index))"""


@query("bld07_transitions", f"""WITH m AS (SELECT *, '<p>' || page_key || least(observation, 1) || '</p>' AS before, '<p>' || after_page || least(after_observation, 1) || '</p>' AS after FROM {ACTED} x
  WHERE NOT (page_key = after_page AND observation = after_observation) AND NOT (page_key = 'error' AND observation = 2) AND NOT (after_page = 'error' AND after_observation = 2) AND what <> 6),
a AS (SELECT *, CASE WHEN what IN (3, 5) THEN -1 WHEN what IN (0, 4) AND element_index < 0 THEN CASE WHEN k % 10 BETWEEN 2 AND 5 THEN 1 ELSE 0 END ELSE element_index END AS idx,
  CASE WHEN frame_index % 3 = 0 THEN 'Up' WHEN abs(k % 6 - k % 3) >= abs(k % 4 - k % 5) THEN CASE WHEN k % 6 > k % 3 THEN 'Down' ELSE 'Up' END WHEN k % 4 > k % 5 THEN 'Right' ELSE 'Left' END AS direction FROM m WHERE before <> after),
j AS (SELECT *, '{{' || chr(10) || '  "type": "' || ['Click', 'Swipe', 'Input', 'Back', 'LongClick', 'Home'][what + 1] || '",' || chr(10) || '  "params": ' ||
  CASE what WHEN 1 THEN '{{' || chr(10) || '    "direction": "' || direction || '"' || chr(10) || '  }}' WHEN 2 THEN '{{' || chr(10) || '    "text": "\\u00e9 \\"' || event_type || '"' || chr(10) || '  }}' ELSE '{{}}' END ||
  ',' || chr(10) || '  "default": ' || CASE WHEN what = 0 THEN 'true' ELSE 'false' END || ',' || chr(10) || '  "index": ' || idx || chr(10) || '}}' AS action FROM a)
SELECT session, frame_index, md5('<image>' || chr(10) || '## Current State' || chr(10) || before || chr(10) || chr(10) || '## Action' || chr(10) || action) AS human, md5(after) AS gpt FROM j""")
def bld07_transitions(t):
    return examples.candidates(acted(t), observed(t)).select("session", "frame_index", F.md5("human").alias("human"), F.md5("gpt").alias("gpt"))


@query("bld07_examples")
def bld07(t):
    return examples.converted(acted(t), observed(t)).select("session", "frame_index", "image", F.md5("human").alias("human"), F.md5("gpt").alias("gpt"))


@query("set02_either_signature")
def set02(t):
    """Signatures count within a user."""
    within = lambda c: F.concat(F.col("user_id").cast("string"), F.lit("|"), c)
    rows = t["events"].select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), within("event_type").alias("a"), within("props").alias("b"))
    return either_once(rows, ["session", "seq"]).select("session", "seq")

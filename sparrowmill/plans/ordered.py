"""Queries over orders, splits and exclusions as functions of operators; the SQL beside each is what it is compared with."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparrowmill.operators import exploration, progress, routes, sampling
from sparrowmill.plans.registry import query


@query("jn01_route_by_app", """
SELECT c.c_custkey, CASE WHEN n.n_name IS NULL OR trim(n.n_name) = '' THEN 'null' WHEN n.n_regionkey IN (0, 1, 2) THEN 'id' WHEN n.n_regionkey = 3 THEN 'ood' ELSE 'null' END AS pool
FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def jn01_route_by_app(t):
    joined = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"), "left")
    pools = {"id": (0, 1, 2), "ood": (3,)}
    return joined.select("c_custkey", sampling.routed(F.col("n_name"), F.col("n_regionkey"), pools).alias("pool"))


@query("jn04_positional_pairs", """
WITH g AS (SELECT row_number() OVER (ORDER BY event_id) AS row_id, event_type AS gt FROM events WHERE event_id % 2 = 0),
p AS (SELECT row_number() OVER (ORDER BY event_id) AS row_id, event_type AS predict FROM events WHERE event_id % 2 = 1)
SELECT g.row_id, gt, predict, gt = predict AS same FROM g JOIN p ON g.row_id = p.row_id""")
def jn04_positional_pairs(t):
    events = t["events"]
    return sampling.positional_pairs(events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), "event_id", "event_type")


@query("jn07_test_key_exclusion", """
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'id' WHEN o_orderkey % 10 = 1 THEN 'ood' ELSE 'train' END AS part FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def jn07_test_key_exclusion(t):
    rest = sampling.excluding(t["orders"], "o_custkey", t["customer"].where("c_mktsegment = 'BUILDING'").select("c_custkey"))
    part = F.when(F.col("o_orderkey") % 10 == 0, "id").when(F.col("o_orderkey") % 10 == 1, "ood").otherwise("train")
    return rest.select("o_orderkey", part.alias("part"))


@query("set05_union_shuffle", """
SELECT k, kind, row_number() OVER (ORDER BY md5(concat('5|', kind, CAST(k AS VARCHAR(99)))), k) AS place FROM (SELECT o_orderkey AS k, 'state' AS kind FROM orders UNION ALL SELECT c_custkey, 'action' FROM customer) u""")
def set05_union_shuffle(t):
    return sampling.shuffled_union({"state": (t["orders"], "o_orderkey"), "action": (t["customer"], "c_custkey")}, "5")


@query("smp01_random_split", """
SELECT o_orderkey, rn <= floor(n * 0.9) AS train FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5(concat('1|', CAST(o_orderkey AS VARCHAR(99)))), o_orderkey) AS rn, count(*) OVER () AS n FROM orders) a""")
def smp01_random_split(t):
    return sampling.random_split(t["orders"], "o_orderkey", 0.9, "1")


@query("smp02_random_subsample", """
SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5(concat('2|', CAST(o_orderkey AS VARCHAR(99)))), o_orderkey) AS rn FROM orders) a WHERE rn <= 500""")
def smp02_random_subsample(t):
    return sampling.first_drawn(t["orders"], "o_orderkey", 500, "2")


@query("smp09_ratio_mix", """
WITH s AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY md5(concat('9|', CAST(o_orderkey AS VARCHAR(99)))), o_orderkey) AS rn FROM orders),
a AS (SELECT c_custkey AS k, row_number() OVER (ORDER BY md5(concat('9|', CAST(c_custkey AS VARCHAR(99)))), c_custkey) AS rn FROM customer)
SELECT 'state' AS kind, k FROM s WHERE rn <= 70 UNION ALL SELECT 'action', k FROM a WHERE rn <= 30""")
def smp09_ratio_mix(t):
    return sampling.ratio_mix({"state": (t["orders"], "o_orderkey", 70), "action": (t["customer"], "c_custkey", 30)}, "9")


@query("win11_round_robin", """
SELECT o_orderkey, row_number() OVER (ORDER BY rn, ep_rnd, o_orderkey) AS place FROM (
  SELECT o_orderkey, md5(concat('11|', CAST(o_custkey AS VARCHAR(99)))) AS ep_rnd, row_number() OVER (PARTITION BY o_custkey ORDER BY md5(concat('11|', CAST(o_orderkey AS VARCHAR(99))))) AS rn FROM orders) a""")
def win11_round_robin(t):
    return sampling.round_robin(t["orders"], "o_orderkey", "o_custkey", "11")


@query("flt01_dropped_report", """
SELECT min(n_chars) AS least, max(n_chars) AS most, max(CASE WHEN rn = CAST(floor(n / 2) AS BIGINT) + 1 THEN n_chars END) AS p50, count(*) AS dropped FROM (
  SELECT n_chars, row_number() OVER (ORDER BY n_chars, doc_id) AS rn, count(*) OVER () AS n FROM documents WHERE n_chars > 2000) d""")
def flt01_dropped_report(t):
    return sampling.dropped_report(t["documents"], "n_chars", "doc_id", 2000)


@query("grf08_unexplored_actions", """
SELECT user_id, event_type FROM events EXCEPT SELECT user_id, event_type FROM events WHERE value >= 20""")
def grf08_unexplored_actions(t):
    """A user's page offers the actions seen there; those of value 20 or more count as tried."""
    events = t["events"]
    return sampling.untried(events.select("user_id", "event_type"), events.where("value >= 20").select("user_id", "event_type"))


@query("win05_running_coverage", """
WITH f AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1 AS fresh FROM events),
r AS (SELECT user_id, event_id, count(*) FILTER (fresh) OVER w AS visited, 2 + count(*) FILTER (fresh AND event_type NOT IN ('click', 'view', 'error')) OVER w AS total FROM f WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT user_id, event_id, visited, total, round(least(1.0, visited / greatest(total, 1)), 4) AS coverage FROM r""")
def win05_running_coverage(t):
    """Two names are declared; all others but errors are the session's own and make the total grow."""
    return progress.running_coverage(t["events"], "user_id", "event_id", "event_type", ("click", "view"), F.col("event_type") != "error")


@query("win09_repeats_since_new_page")
def win09_repeats_since_new_page(t):
    rows = t["events"].withColumn("k", F.get_json_object("props", "$.k").cast("bigint") % 2)
    return progress.repeats(rows, "user_id", "event_id", "event_type", "k", trip=4)


@query("win14_stable_frames", """
WITH s AS (SELECT user_id, event_id, value, event_type, count(value) OVER w = 7 AND max(value) OVER w < 50 AS stable, list(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS seen FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
SELECT user_id, event_id, coalesce(stable, false) AS stable, (len(seen) >= 3 AND seen[-1] = seen[-2] AND seen[-2] = seen[-3])
  OR (len(seen) >= 6 AND seen[-1] = seen[-3] AND seen[-3] = seen[-5] AND seen[-2] = seen[-4] AND seen[-4] = seen[-6])
  OR (len(seen) >= 9 AND seen[-3:] = seen[-6:-4] AND seen[-6:-4] = seen[-9:-7]) AS oscillates FROM s""")
def win14_stable_frames(t):
    return progress.steadiness(t["events"], "user_id", "event_id", "value", "event_type", below=50.0)


@query("top03_best_candidate", """
SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY novel DESC, prior DESC, md5(concat('3|', event_type)) DESC) AS rn FROM (
  SELECT user_id, event_type, -count(*) AS novel, CASE event_type WHEN 'click' THEN 3 WHEN 'view' THEN 2 ELSE 0 END AS prior FROM events GROUP BY user_id, event_type) c) r WHERE rn = 1""")
def top03_best_candidate(t):
    """The action that a user has done least, then by the prior of its type."""
    seen = t["events"].groupBy("user_id", "event_type").agg((-F.count("*")).alias("novel"))
    prior = F.when(F.col("event_type") == "click", 3).when(F.col("event_type") == "view", 2).otherwise(0)
    return progress.best_candidates(seen, "user_id", "event_type", [F.col("novel"), prior], "3")


def moves(t):
    """Moves of all users in one order of events: from the page before, by one of five elements."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = t["events"].withColumn("src", before)
    return rows.select("src", (F.col("event_id") % 5).cast("string").alias("signature"), F.lit("tap").alias("action"), F.col("event_type").alias("dst"), F.col("event_id").alias("seq"))


LATEST = """WITH e AS (SELECT event_id, event_type AS dst, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS src, CAST(event_id % 5 AS VARCHAR) AS act FROM events),
l AS (SELECT src, act, max_by(dst, event_id) AS dst FROM e WHERE src IS NOT NULL GROUP BY src, act)"""


@query("grf04_latest_destination", f"{LATEST} SELECT src, dst, count(*) AS n_actions, min(act) AS signature, 'tap' AS action FROM l WHERE src <> dst GROUP BY src, dst")
def grf04_latest_destination(t):
    return routes.latest_edges(moves(t))


@query("grf05_shortest_routes")
def grf05_shortest_routes(t):
    return routes.shortest_routes(routes.latest_edges(moves(t)), "click")


OFFERED = """(SELECT DISTINCT user_id AS page, event_id % 7 AS signature, unnest(CASE WHEN event_id % 2 = 0 THEN ['touch', 'long_touch'] ELSE ['scroll'] END) AS action FROM events)"""
TRIED = "(SELECT DISTINCT user_id AS page, event_id % 7 AS signature, CASE WHEN event_id % 5 = 0 THEN 'touch' WHEN event_id % 5 = 1 THEN 'scroll' ELSE 'long_touch' END AS action FROM events WHERE {})"


def tried(t, condition: str):
    n = F.col("event_id")
    action = F.when(n % 5 == 0, "touch").when(n % 5 == 1, "scroll").otherwise("long_touch")
    return t["events"].where(condition).select(F.col("user_id").alias("page"), (n % 7).alias("signature"), action.alias("action"))


@query("grf08_actions_left", f"""WITH o AS {OFFERED}, b AS (SELECT * FROM {TRIED.format("value < 5")} x UNION SELECT * FROM {TRIED.format("value > 60")} y)
SELECT page, signature, action FROM o WHERE NOT EXISTS (FROM b WHERE b.page = o.page AND b.signature = o.signature AND b.action = o.action)
  AND (action <> 'long_touch' OR EXISTS (FROM b WHERE b.page = o.page AND b.signature = o.signature AND b.action = 'touch'))""")
def grf08_actions_left(t):
    """Small values were explored, large ones failed as a way to the page."""
    n = F.col("event_id")
    states = t["events"].select(F.col("user_id").alias("page"), (n % 7).alias("signature"), F.when(n % 2 == 0, F.array(F.lit("touch"), F.lit("long_touch"))).otherwise(F.array(F.lit("scroll"))).alias("actions"))
    return exploration.unexplored(states, tried(t, "value < 5"), tried(t, "value > 60"))


EFFECTS = """(SELECT src AS page, 'k' || (event_id % 3) AS struct_key, event_id % 2 AS action, count(*) AS fired, count(DISTINCT dst) AS destinations FROM (
  SELECT event_id, event_type AS dst, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS src FROM events) e WHERE src IS NOT NULL AND event_id % 3 <> 2 GROUP BY ALL)"""


def effects(t):
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    n = F.col("event_id")
    return exploration.effects(t["events"].select(before.alias("page"), F.when(n % 3 != 2, F.concat(F.lit("k"), n % 3)).alias("struct_key"), (n % 2).alias("action"), F.col("event_type").alias("to_page")))


@query("msc07_effects_of_structures", f"SELECT * FROM {EFFECTS} x")
def msc07_effects(t):
    return effects(t)


@query("msc07_effect_summary", f"SELECT count(*) AS groups, count_if(fired > 3 AND destinations = 1) AS would_saturate FROM {EFFECTS} x")
def msc07_summary(t):
    return exploration.effect_summary(effects(t))

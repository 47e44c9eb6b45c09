"""Queries over functions and operators that aren't plain SQL text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparrowmill.functions import columns as C
from sparrowmill.operators import graph, retrieval, trees, udfs
from sparrowmill.operators.ordering import spread
from sparrowmill.plans.registry import query
from sparrowmill.streaming import coverage

WORDS = "list_filter(regexp_split_to_array(lower(replace(coalesce({}, ''), '|', '')), '\\s+'), lambda x: x <> '')"
TURNS = "(SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, text) AS before FROM conversations)"


def turns(t):
    return t["conversations"].withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "text")))


@query("fn04_norm", "SELECT conv_id, turn, md5(lower(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'))) AS normed FROM conversations")
def fn04(t):
    return t["conversations"].select("conv_id", "turn", F.md5(C.norm(F.col("text"))).alias("normed"))


@query("fn05_action_type", "SELECT event_id, lower(trim(event_type)) AS action_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def fn05(t):
    return t["events"].select("event_id", F.lower(F.trim("event_type")).alias("action_type"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("fn15_swipe_direction", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN dx = 0 AND dy = 0 THEN NULL WHEN abs(dx) >= abs(dy) THEN CASE WHEN dx > 0 THEN 'right' ELSE 'left' END WHEN dy > 0 THEN 'down' ELSE 'up' END AS direction FROM (SELECT *, l_quantity - 25 AS dx, l_linenumber * 4 - 14 AS dy FROM lineitem) a")
def fn15(t):
    return t["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", C.swipe_direction(F.col("l_quantity") - 25, F.col("l_linenumber") * 4 - 14).alias("direction"))


@query("fn16_event_direction", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN abs(dy) >= abs(dx) THEN CASE WHEN dy > 0 THEN 'Down' ELSE 'Up' END WHEN dx > 0 THEN 'Right' ELSE 'Left' END AS direction FROM (SELECT *, l_quantity - 25 AS dx, l_linenumber * 4 - 14 AS dy FROM lineitem) a")
def fn16(t):
    return t["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", C.event_direction(F.col("l_quantity") - 25, F.col("l_linenumber") * 4 - 14).alias("direction"))


@query("fn32_duration", "SELECT p_partkey, CASE WHEN p_size % 4 = 3 THEN 7200 ELSE p_size * CASE p_size % 4 WHEN 0 THEN 3600 WHEN 1 THEN 60 ELSE 1 END END AS seconds FROM part WHERE p_size > 0")
def fn32(t):
    text = F.concat(F.col("p_size").cast("string"), F.element_at(F.array(*(F.lit(x) for x in ("h", "m", "s", "x"))), F.col("p_size") % 4 + 1))
    return t["part"].where("p_size > 0").select("p_partkey", C.duration_seconds(text).alias("seconds"))


@query("fn43_text_sim", f"SELECT conv_id, turn, CASE WHEN len(list_distinct(a || b)) = 0 THEN 1.0 ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(a || b)) END AS sim FROM (SELECT conv_id, turn, list_distinct({WORDS.format('text')}) AS a, list_distinct({WORDS.format('before')}) AS b FROM {TURNS} t WHERE before IS NOT NULL) x")
def fn43(t):
    return turns(t).where("before IS NOT NULL").select("conv_id", "turn", C.text_sim(F.col("text"), F.col("before")).alias("sim"))


@query("fn42_smallest_box", """SELECT o_orderkey, min_by(l_linenumber, (r - l) * (b - t) * 1000 + l_linenumber) AS box FROM (
  SELECT l_orderkey, l_linenumber, l_linenumber * 3 - 9 AS l, 0 AS t, l_linenumber * 3 + CAST(l_quantity AS INT) AS r, 10 AS b FROM lineitem) x JOIN orders ON l_orderkey = o_orderkey
  WHERE 12 BETWEEN l AND r AND 5 BETWEEN t AND b GROUP BY o_orderkey""")
def fn42(t):
    text = F.concat(F.lit("["), F.col("l_linenumber") * 3 - 9, F.lit(",0]["), F.col("l_linenumber") * 3 + F.col("l_quantity").cast("int"), F.lit(",10]"))
    boxes = t["lineitem"].select("l_orderkey", "l_linenumber", C.box(text).alias("x")).where("12 BETWEEN x.l AND x.r AND 5 BETWEEN x.t AND x.b")
    area = (F.col("x.r") - F.col("x.l")) * (F.col("x.b") - F.col("x.t")) * 1000 + F.col("l_linenumber")
    return boxes.join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(F.min_by("l_linenumber", area).alias("box"))


@query("flt04_vision_tokens")
def flt04(t):
    return t["part"].select("p_partkey", C.vision_tokens(F.col("p_size") * 30 + 10, F.col("p_size") * 50 + 7).alias("tokens"))


@query("met05_exact_match", f"SELECT conv_id, turn, trim(text) = trim(before) AS same FROM {TURNS} t WHERE before IS NOT NULL")
def met05(t):
    return turns(t).where("before IS NOT NULL").select("conv_id", "turn", (F.trim("text") == F.trim("before")).alias("same"))


@query("met06_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def met06(t):
    e = t["embeddings"]
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id").select("vec_id", F.round(C.cosine(F.col("embedding"), F.col("other")), 9).alias("cosine"))


@query("met02_text_metrics")
def met02(t):
    return turns(t).where("before IS NOT NULL").select("conv_id", "turn", udfs.text_metrics("text", "before").alias("m")).select("conv_id", "turn", "m.*")


def page_pairs(t):
    """Each page with the page of the next page_id."""
    later = t["pages"].select((F.col("page_id") - 1).alias("page_id"), F.col("html").alias("following"))
    return t["pages"].join(later, "page_id")


def page_states(t):
    """Each page as a current state, the next page as the true next state and the one after as a predicted one."""
    at = lambda k, name: t["pages"].select((F.col("page_id") - k).alias("page_id"), F.col("html").alias(name))
    return at(0, "current").join(at(1, "truth"), "page_id").join(at(2, "pred"), "page_id")


def _followed(pages, *names):
    """Each row of (page_id, tree) with those of the next page_ids, in tasks of even numbers of rows."""
    at = lambda k, name: spread(pages.select((F.col("page_id") - k).alias("page_id"), F.col("tree").alias(name)), "page_id").hint("merge")
    return reduce(lambda a, b: a.join(b, "page_id"), (at(k, name) for k, name in enumerate(names)))


def stated(t):
    """``trees.states`` of ``page_states``, for which each page is read once."""
    return trees.states(_followed(trees.trees(t["pages"], "page_id", "html"), "current", "truth", "pred"), "page_id", "current", "truth", "pred")


def trees_of_pairs(t):
    """(page_id, current, truth): the trees of ``page_pairs``, for which each page is read once."""
    return _followed(trees.trees(t["pages"], "page_id", "html"), "current", "truth")


@query("fn46_elements")
def fn46(t):
    return trees.elements(t["pages"], "page_id", "html").withColumnRenamed("key", "page_id")


@query("fn47_legacy_elements")
def fn47(t):
    return trees.elements(t["pages"], "page_id", "html", kind="legacy").withColumnRenamed("key", "page_id")


@query("fn48_legacy_elements_by_bounds")
def fn48(t):
    return trees.elements(t["pages"], "page_id", "html", kind="legacy", place="bounds", aria=True).withColumnRenamed("key", "page_id")


@query("mat01_element_pairs")
def mat01(t):
    found = trees.paired(page_pairs(t), "page_id", "html", "following")
    return found.select("key", F.explode("pairs").alias("x")).select("key", "x.*")


@query("met01_tree_score")
def met01(t):
    return trees.scores(trees.paired(page_pairs(t), "page_id", "html", "following"))


@query("met01_tree_score_by_bounds")
def met01_by_bounds(t):
    return trees.scores(trees.paired(page_pairs(t), "page_id", "html", "following", place="bounds"), near=50.0)


@query("diff01_changes_by_cost")
def diff01(t):
    return trees.changes(trees.paired(page_pairs(t), "page_id", "html", "following"), rule="cost")


@query("diff02_tree_diff")
def diff02(t):
    return trees.changes(trees.paired(page_pairs(t), "page_id", "html", "following"))


@query("diff04_state_diff")
def diff04(t):
    return trees.diffed(stated(t))


@query("diff07_copy_baseline")
def diff07(t):
    """The row of a prediction that copies the current state."""
    states = trees_of_pairs(t).withColumn("pred", F.col("current"))
    return trees.diffed(trees.states(states, "page_id", "current", "truth", "pred"))


@query("flt05_copy_bias")
def flt05(t):
    return trees.changing(trees.changes(trees.paired(page_pairs(t), "page_id", "html", "following")))


@query("fn59_element_lines")
def fn59(t):
    return t["pages"].select("page_id", udfs.element_lines("html").alias("lines")).withColumn("n_lines", F.size("lines"))


@query("str01_page_identity")
def str01(t):
    lines = t["events"].groupBy((F.col("user_id") % 50).alias("session"), F.floor(F.col("event_id") / 20).alias("seq")).agg(F.collect_set("event_type").alias("lines"))
    return graph.matched_pages(lines)


@query("grf06_hop_distances", """WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS src, event_type AS dst FROM events) x WHERE src IS NOT NULL AND src <> dst),
  r(page, hops) AS (SELECT 'click', 0 UNION SELECT e.dst, r.hops + 1 FROM r JOIN e ON r.page = e.src WHERE r.hops < 6) SELECT page, min(hops)::INT AS hops FROM r GROUP BY page""")
def grf06(t):
    return graph.hop_distances(graph.page_edges(t["events"]), "click")


@query("agg27_document_frequency", f"SELECT term, count(*) AS df FROM (SELECT DISTINCT item_id, unnest({WORDS.format('text')}) AS term FROM benchmark) x GROUP BY term")
def agg27(t):
    return retrieval.postings(t["benchmark"], "item_id", "text").groupBy("term").agg(F.count("*").alias("df"))


@query("top01_bm25", f"""WITH w AS (SELECT item_id AS doc, {WORDS.format('text')} AS ws FROM benchmark), s AS (SELECT doc, len(ws) AS size FROM w), n AS (SELECT count(*) AS n, avg(size) AS mean FROM s),
  p AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(ws) AS term FROM w) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
  q AS (SELECT query, term, count(*) AS times FROM (SELECT conv_id * 100 + turn AS query, unnest({WORDS.format('text')}) AS term FROM conversations) GROUP BY ALL),
  j AS (SELECT query, p.doc, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean))), 6) AS score FROM q JOIN f USING (term) JOIN p USING (term) JOIN s USING (doc) CROSS JOIN n GROUP BY ALL),
  a AS (SELECT query, doc, coalesce(score, 0.0) AS score FROM (SELECT DISTINCT conv_id * 100 + turn AS query FROM conversations) x CROSS JOIN (SELECT DISTINCT doc FROM s) y LEFT JOIN j USING (query, doc))
  SELECT query, doc, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS place FROM a) WHERE place <= 5""")
def top01(t):
    asked = t["conversations"].select((F.col("conv_id") * 100 + F.col("turn")).alias("q"), "text")
    return retrieval.bm25(t["benchmark"], "item_id", "text", asked, "q", "text", 5)


@query("str08_windowed_visits", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, user_id, event_type, count(*) AS visits, min(event_id) AS first_step FROM events GROUP BY ALL")
def str08(t):
    return coverage.visits(t["events"])

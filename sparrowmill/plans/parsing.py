"""Queries over the parsing of actions, prompts, names and elements. Texts are built from columns, which the SQL reads directly."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparrowmill.functions import actions as A
from sparrowmill.functions import columns as C
from sparrowmill.operators.ordering import numbered
from sparrowmill.plans.registry import query

K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def acts(t):
    """Events with ``body``, their action as JSON text, and k."""
    e = t["events"].withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    kind, k, i = F.col("event_type"), F.col("k").cast("string"), (F.col("event_id") % 100).cast("string")
    return e.withColumn("body", F.concat(F.lit('{"action":"'), kind, F.lit('","coordinate":['), k, F.lit(","), i, F.lit("]}")))


@query("fn01_parse_action", f"SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE event_type END AS kind, CASE WHEN event_id % 4 = 3 THEN NULL ELSE {K} END AS x FROM events")
def fn01(t):
    b = F.col("body")
    text = F.when(F.col("event_id") % 4 == 0, b).when(F.col("event_id") % 4 == 1, F.concat(F.lit("so:\n```json\n"), b, F.lit("\n```"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit("I tap "), b, F.lit(" now"))).otherwise(F.lit("nothing {broken"))
    a = A.parsed(text)
    return acts(t).select("event_id", A.action_type(a).alias("kind"), A.value(a, "$.coordinate[0]", "bigint").alias("x"))


@query("fn02_action_payload", "SELECT event_id, event_type AS kind FROM events")
def fn02(t):
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("<thought>x</thought><action> "), "body", F.lit(" </action>"))).otherwise(F.col("body"))
    return acts(t).select("event_id", A.action_type(A.payload(text)).alias("kind"))


@query("fn03_param", f"SELECT event_id, {K}::VARCHAR AS k FROM events")
def fn03(t):
    k = F.col("k").cast("string")
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"k":'), k, F.lit(',"params":{"k":-1}}'))).otherwise(F.concat(F.lit('{"params":{"k":'), k, F.lit("}}")))
    return acts(t).select("event_id", A.param(F.try_parse_json(text), "k").alias("k"))


@query("fn06_action_type_keys", "SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE event_type END AS kind FROM events")
def fn06(t):
    name = F.element_at(F.array(*(F.lit(x) for x in ('"action":" ","type"', '"action_type"', '"type"', '"other"'))), (F.col("event_id") % 4 + 1).cast("int"))
    text = F.concat(F.lit("{"), name, F.lit(':"'), "event_type", F.lit('"}'))
    return t["events"].select("event_id", A.action_type(F.try_parse_json(text)).alias("kind"))


@query("fn07_aliased_type", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'open_app' ELSE event_type END AS kind FROM events")
def fn07(t):
    kind = F.when(F.col("event_id") % 3 == 0, "open").otherwise(F.col("event_type"))
    body = F.concat(F.lit('{"type":"'), kind, F.lit('"}'))
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("screen\n## Action\n"), body)).otherwise(F.concat(F.lit("<action>"), body, F.lit("</action>")))
    return t["events"].select("event_id", A.aliased(A.action_type(A.last_action(text))).alias("kind"))


@query("fn08_last_action", "SELECT event_id, event_type AS kind FROM events")
def fn08(t):
    text = F.concat(F.lit('Action: {"action":"early"}\nState {"action":"state"}\n## Action\n'), "body", F.lit(' and {"action":"late"}'))
    return acts(t).select("event_id", A.action_type(A.last_action(text)).alias("kind"))


@query("fn11_points", f"SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS n, {K}::DOUBLE AS x FROM events")
def fn11(t):
    more = F.when(F.col("event_id") % 2 == 0, "[3,4]").otherwise("[3]")
    a = F.try_parse_json(F.concat(F.lit('{"coordinate":["a",1],"coordinate1":['), F.col("k").cast("string"), F.lit(',2.5],"coordinate2":'), more, F.lit("}")))
    found = A.points(a)
    return acts(t).select("event_id", F.size(found).alias("n"), F.get(F.get(found, 0), 0).alias("x"))


@query("fn12_tag_count", "SELECT event_id, event_id % 3 AS tags, event_id % 3 = 1 AS valid, event_id % 3 = 1 AND event_type = 'error' AS ends FROM events")
def fn12(t):
    text = F.repeat(F.concat(F.lit("<action>"), "body", F.lit("</action>")), (F.col("event_id") % 3).cast("int"))
    n = F.regexp_count(text, F.lit("<action>"))
    kind = A.action_type(F.try_parse_json(A.tagged(text, "action")))
    return acts(t).select("event_id", n.cast("bigint").alias("tags"), (n == 1).alias("valid"), ((n == 1) & F.coalesce(kind == "error", F.lit(False))).alias("ends"))


@query("fn13_thought", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type END AS thought FROM events")
def fn13(t):
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("a<thought>\n "), "event_type", F.lit(" </thought><thought>b</thought>"))).otherwise("no tag")
    return t["events"].select("event_id", A.tagged(text, "thought").alias("thought"))


@query("fn23_state_block", "SELECT conv_id, turn, md5(trim(text)) AS state FROM conversations WHERE text IS NOT NULL")
def fn23(t):
    text = F.concat(F.lit("Goal\nCurrent UI State:"), "text", F.lit("[Screenshot]\nmore [Screenshot]"))
    return t["conversations"].where("text IS NOT NULL").select("conv_id", "turn", F.md5(A.between(text, "Current UI State:", "[Screenshot]")).alias("state"))


@query("fn25_by_role", """SELECT conv_id, md5(coalesce(min_by(text, turn) FILTER (role = 'assistant'), '')) AS answer, md5(coalesce(min_by(text, turn) FILTER (role = 'system'), '')) AS system FROM conversations GROUP BY conv_id""")
def fn25(t):
    rows = t["conversations"].groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return rows.select("conv_id", F.md5(A.by_role(F.col("m"), "assistant")).alias("answer"), F.md5(A.by_role(F.col("m"), "system")).alias("system"))


@query("fn27_padded_episode", "SELECT o_orderkey, 'img/episode_' || CASE WHEN o_custkey * 37 < 1000000 THEN lpad((o_custkey * 37)::VARCHAR, 6, '0') ELSE (o_custkey * 37)::VARCHAR END || '_step_0003.jpg' AS path FROM orders")
def fn27(t):
    return t["orders"].select("o_orderkey", A.padded_episode(F.concat(F.lit("img/episode_"), (F.col("o_custkey") * 37).cast("string"), F.lit("_step_0003.jpg"))).alias("path"))


@query("fn28_step_key", "SELECT o_orderkey, o_custkey AS episode, (o_orderkey % 50)::INT AS step FROM orders")
def fn28(t):
    name = F.concat(F.lit("episode_"), F.lpad(F.col("o_custkey").cast("string"), 8, "0"), F.lit("_step_"), F.lpad((F.col("o_orderkey") % 50).cast("string"), 4, "0"), F.lit(".jpg"))
    return t["orders"].select("o_orderkey", A.step_key(name).alias("s")).select("o_orderkey", "s.*")


@query("fn30_qualified", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_type || '/' || p_type || '.Main' WHEN 1 THEN p_type || '/x.Main' ELSE p_type END AS activity FROM part")
def fn30(t):
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_type", F.lit("/.Main"))).when(F.col("p_partkey") % 3 == 1, F.concat("p_type", F.lit("/x.Main"))).otherwise(F.col("p_type"))
    return t["part"].select("p_partkey", A.qualified(raw).alias("activity"))


@query("fn31_page_activity", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type ELSE '' END AS activity FROM events")
def fn31(t):
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), "event_type", F.lit(" "))).when(F.col("event_id") % 3 == 1, F.concat("event_type", F.lit(".SoftInputWindow")))
    return t["events"].select("event_id", A.page_activity(raw).alias("activity"))


@query("fn33_ratios", "SELECT p_partkey, CASE WHEN p_size % 5 > 0 THEN 2 END AS pairs, CASE WHEN p_size % 5 > 0 THEN p_size % 5 END AS first FROM part")
def fn33(t):
    found = A.ratios(F.concat((F.col("p_size") % 5).cast("string"), F.lit(":3, 3:7")))
    return t["part"].select("p_partkey", F.when(found.isNotNull(), F.size(found)).alias("pairs"), F.get(F.get(found, 0), 0).alias("first"))


@query("fn34_setting_order", "SELECT p_partkey, row_number() OVER (ORDER BY p_brand, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 1 END, CASE WHEN p_partkey % 4 = 0 THEN 'base' ELSE 'full' END, CASE WHEN p_partkey % 4 = 0 THEN -1.0 ELSE p_size + 0.5 END, p_partkey) AS place FROM part")
def fn34(t):
    path = F.when(F.col("p_partkey") % 4 == 0, "base").otherwise(F.concat(F.lit("full/epoch-"), F.col("p_size").cast("string"), F.lit(".5")))
    key = A.setting_order(F.col("p_brand"), path)
    return numbered(t["part"].select("p_partkey", key.alias("key")), "key", "p_partkey").select("p_partkey", "place")


def boxed(left, top):
    return C.box(F.concat(F.lit("["), left.cast("string"), F.lit(","), top.cast("string"), F.lit("]["), (left + 10).cast("string"), F.lit(","), (top + 20).cast("string"), F.lit("]")))


@query("fn41_centre_distance", "SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber + 2.0 AS x, round(sqrt(pow(l_linenumber - 1, 2) + pow(l_partkey % 9, 2)), 9) AS distance FROM lineitem")
def fn41(t):
    a, b = boxed(F.col("l_linenumber") - 3, F.lit(-4)), boxed(F.lit(-2), F.col("l_partkey") % 9 - 4)
    return t["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", A.centre(a)["x"].alias("x"), F.round(A.distance(a, b), 9).alias("distance"))


LINES = "list_filter(regexp_split_to_array({}, '\\n'), lambda x: x <> '')"
PAIRS = f"(SELECT conv_id, turn, {LINES.format('text')} AS a, lag({LINES.format('text')}) OVER (PARTITION BY conv_id ORDER BY turn, text) AS b FROM conversations WHERE text IS NOT NULL)"


@query("fn45_line_jaccard", f"SELECT conv_id, turn, CASE WHEN len(list_distinct(a || b)) = 0 THEN 0 ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(a || b)) END AS jaccard, len(list_distinct(a || b)) - len(list_intersect(a, b)) AS n_different FROM {PAIRS} p WHERE b IS NOT NULL")
def fn45(t):
    lines = F.array_distinct(F.filter(F.split("text", "\n"), lambda x: x != ""))
    rows = t["conversations"].where("text IS NOT NULL").select("conv_id", "turn", lines.alias("a"), F.lag(lines).over(Window.partitionBy("conv_id").orderBy("turn", "text")).alias("b"))
    a, b = F.col("a"), F.col("b")
    return rows.where("b IS NOT NULL").select("conv_id", "turn", A.jaccard(a, b, 0.0).alias("jaccard"), A.n_different(a, b).cast("bigint").alias("n_different"))


@query("fn52_slot_key", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'b:' || p_name WHEN 1 THEN 'i:' || p_size ELSE '' END AS slot FROM part")
def fn52(t):
    bounds = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name"))
    index = F.when(F.col("p_partkey") % 3 < 2, F.col("p_size").cast("string")).otherwise("")
    return t["part"].select("p_partkey", A.slot(bounds, index).alias("slot"))


@query("fn53_keycap", "SELECT p_partkey, p_partkey % 4 IN (0, 1) AS keycap FROM part")
def fn53(t):
    pick = lambda *x: F.element_at(F.array(*(F.lit(v) for v in x)), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t["part"].select("p_partkey", A.keycap(pick("", "Tab", "Enter", "é"), pick("q", "long text", "a", "b")).alias("keycap"))


@query("fn66_digest", "SELECT event_id, md5(event_type || '|' || coalesce(props, '')) AS digest FROM events WHERE event_type IS NOT NULL")
def fn66(t):
    return t["events"].where("event_type IS NOT NULL").select("event_id", A.digest(F.col("event_type"), F.col("props")).alias("digest"))


@query("flt03_multimodal_length", "SELECT doc_id, 20 + n_chars // 4 + (doc_id % 3) * (256 + 2) AS length FROM documents WHERE n_chars IS NOT NULL AND 20 + n_chars // 4 + (doc_id % 3) * (256 + 2) <= 1000")
def flt03(t):
    length = A.multimodal_length(F.lit(20), F.expr("n_chars DIV 4"), F.col("doc_id") % 3, F.lit(256))
    return t["documents"].select("doc_id", length.alias("length")).where("length <= 1000")


@query("flt08_navigable", "SELECT p_partkey, p_partkey % 5 NOT IN (1, 3) AS navigable FROM part")
def flt08(t):
    name = F.element_at(F.array(*(F.lit(x) for x in ("a/b.Main", "a/com.google.android.gms.X", "com.google.android.gms.X", "a/androidx.car.app.Y", "a/com.google.android.X"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return t["part"].select("p_partkey", A.navigable(name).alias("navigable"))


@query("wgt01_weights", """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 3 WHEN 2 THEN 0.25 ELSE CASE WHEN l_returnflag = 'R' THEN 0.5 ELSE 1.0 END END AS weight FROM lineitem""")
def wgt01(t):
    change = F.element_at(F.array(*(F.lit(x) for x in ("ADDED", "MODIFIED", "UNCHANGED"))), (F.col("l_linenumber") % 3 + 1).cast("int"))
    return t["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", A.token_weight(change, F.when(F.col("l_returnflag") == "R", "NON_DERIVABLE").otherwise("COPY")).alias("weight"))

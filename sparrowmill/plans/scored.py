"""Queries over action scoring and prompts. Texts are built from columns, which the SQL reads directly."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparrowmill.functions import prompts as P
from sparrowmill.operators import scoring
from sparrowmill.plans.registry import query

#: kind of the true and of the predicted action of an event, by k = event_id % 8
KINDS = ("click", "swipe", "open", "type", "wait", "other", "click", "click")
XY = """SELECT event_id, m, k, user_id % 40 AS x, CASE WHEN m = 5 THEN 'other' WHEN m = 1 THEN 'swipe' WHEN m = 2 THEN 'open' WHEN m = 3 THEN 'type' WHEN m = 4 THEN 'wait' ELSE 'click' END AS kind,
  m <> 7 AS parsed, m <> 7 AND k % 5 <> 4 AS type_right, CASE WHEN m IN (0, 6) AND user_id % 40 <= 20 THEN k BETWEEN 0 AND CASE WHEN user_id % 40 <= 10 THEN 10 ELSE 20 END WHEN m = 1 THEN k % 2 = 0 WHEN m IN (2, 3) THEN k % 3 = 0 ELSE m = 4 END AS fit
  FROM (SELECT *, event_id % 8 AS m, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) e"""
JUDGED = f"SELECT event_id, kind, parsed, type_right, CASE WHEN type_right THEN CASE kind WHEN 'click' THEN 'bbox' WHEN 'swipe' THEN 'dir' WHEN 'open' THEN 'app' WHEN 'type' THEN 'text' END END AS checked, type_right AND kind = 'click' AND x > 20 AS no_bbox, type_right AND fit AS step_right FROM ({XY}) j"
RATE = "round(CASE WHEN {1} > 0 THEN {0} / {1} ELSE 0.0 END, 4)"


def by_point(t):
    """Events as true and predicted actions on a screen of two nested boxes, [0,0][10,10] in [0,0][20,20]."""
    k, x = F.get_json_object("props", "$.k").cast("bigint"), F.col("user_id") % 40
    m = F.col("event_id") % 8
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (m + 1).cast("int"))
    said = F.when(k % 5 == 4, F.lit("drag")).otherwise(kind)
    click = lambda a: F.concat(F.lit(',"coordinate":['), a.cast("string"), F.lit(",5]"))
    swipe = lambda a: F.concat(F.lit(',"coordinate1":[0,0],"coordinate2":['), a, F.lit("]"))
    true = F.when(kind == "click", click(x)).when(kind == "swipe", swipe(F.lit("9,9"))).when(kind == "open", ',"params":{"app_name":" Maps "}').when(kind == "type", ',"text":"Hi"').otherwise("")
    pred = (
        F.when(kind == "click", click(k))
        .when(kind == "swipe", swipe(F.when(k % 2 == 0, "7,3").otherwise("3,-7")))
        .when(kind == "open", F.when(k % 3 == 0, ',"app_name":"maps"').otherwise(',"app_name":"mail"'))
        .when(kind == "type", F.when(k % 3 == 0, ',"params":{"text":"hi "}').otherwise(""))
        .otherwise("")
    )
    full = lambda a, rest: F.concat(F.lit('{"action":"'), a, F.lit('"'), rest, F.lit("}"))
    screen = F.lit('<div bounds="[0,0][20,20]"><p>[0,0][1,1]</p><button index="1" bounds="[0,0][10,10]"/></div>')
    return t["events"].select("event_id", full(kind, true).alias("true"), F.when(m == 7, "no action").otherwise(full(said, pred)).alias("pred"), screen.alias("screen"))


def judged(t):
    return scoring.judged(by_point(t), "true", "pred", scoring.BY_POINT, "screen")


@query("met08_action_by_point", JUDGED)
def met08(t):
    return judged(t).select("event_id", "verdict.*")


@query("agg02_action_report_by_point", f"""WITH j AS ({JUDGED}), k AS (SELECT kind, round(count(*) FILTER (step_right) / count(*), 4) AS step_acc FROM j GROUP BY kind),
  s AS (SELECT count(*) AS total, count(*) FILTER (parsed) AS p, count(*) FILTER (type_right) AS ty, count(*) FILTER (step_right) AS st, count(*) FILTER (no_bbox) AS no_bbox_n,
    {', '.join(f"count(*) FILTER (checked = '{c}') AS n_{c}, count(*) FILTER (checked = '{c}' AND step_right) AS k_{c}" for c in ('bbox', 'dir', 'app', 'text'))} FROM j)
  SELECT total, round(p / total, 4) AS parse_rate, round(ty / total, 4) AS type_accuracy, round(st / total, 4) AS step_accuracy, (SELECT round(avg(step_acc), 4) FROM k) AS macro_step_accuracy,
    {', '.join(f"{RATE.format(f'k_{c}', f'n_{c}')} AS cond_{c}_acc" for c in ('bbox', 'dir', 'app', 'text'))}, no_bbox_n FROM s""")
def agg02(t):
    return scoring.report(scoring.by_kind(judged(t)), scoring.BY_POINT)


def by_index(t):
    """Events as actions of the index dialect; a prediction names index k where the true one is user_id % 10."""
    k, m = F.get_json_object("props", "$.k").cast("bigint"), F.col("event_id") % 3
    full = lambda i: F.when(m == 0, F.concat(F.lit('{"action_type":"click","index":'), i.cast("string"), F.lit("}"))).when(m == 1, '{"action_type":"finish"}').otherwise('{"type":"scroll","direction":"down"}')
    return t["events"].select("event_id", full(F.col("user_id") % 10).alias("true"), full(k % 10).alias("pred"))


@query("agg01_action_report_by_index", """WITH j AS (SELECT CASE event_id % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'finish' ELSE 'scroll' END AS kind, event_id % 3 <> 0 OR user_id % 10 = CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS step_right FROM events),
  k AS (SELECT kind, count(*) AS n, round(count(*) FILTER (step_right) / count(*), 4) AS step_acc FROM j GROUP BY kind)
  SELECT count(*) AS total, 1.0 AS parse_rate, 1.0 AS type_accuracy, round(count(*) FILTER (step_right) / count(*), 4) AS step_accuracy, (SELECT round(avg(step_acc), 4) FROM k) AS macro_step_accuracy,
    round(count(*) FILTER (step_right AND kind = 'click') / count(*) FILTER (kind = 'click'), 4) AS cond_index_acc, 1.0 AS cond_dir_acc, 0.0 AS cond_app_acc, 0.0 AS cond_text_acc FROM j""")
def agg01(t):
    return scoring.report(scoring.by_kind(scoring.judged(by_index(t), "true", "pred")))


@query("fn20_prompt_sections", """SELECT conv_id, turn, md5(text) AS current_state, 'tap ' || turn AS action, CASE WHEN turn % 2 = 0 THEN 'go ' || conv_id END AS instruction, CASE WHEN turn % 2 = 0 THEN 2 ELSE 1 END + 1 AS n_sections
  FROM (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS text FROM conversations) c WHERE text <> ''""")
def fn20(t):
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    task = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Task Instruction: \n\ngo "), "conv_id", F.lit("\n"))).otherwise("")
    prompt = F.concat(F.lit("system\nAction:\nnone\nuser\n"), task, F.lit("Current UI State:\n[Home Screenshot]\n"), text, F.lit("\n[Screenshot]\nNext UI State:\n\n## Action \n tap "), "turn", F.lit("\nAction:\nlate\nassistant\nCurrent UI State:\nx\nassistant\n"))
    s = F.col("s")
    rows = t["conversations"].where(text != "").select("conv_id", "turn", P.sections(prompt).alias("s"))
    return rows.select("conv_id", "turn", F.md5(s["current_state"]).alias("current_state"), s["action"].alias("action"), s["instruction"].alias("instruction"), F.size("s").alias("n_sections"))


@query("fn22_current_state", "SELECT conv_id, turn, md5(text || CASE WHEN turn % 2 = 0 THEN chr(10) || 'more' ELSE '' END) AS state FROM (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS text FROM conversations) c WHERE text <> ''")
def fn22(t):
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    headed = F.concat(F.lit("say\n## Current State here\n"), text, F.lit("\n## Action\nCurrent UI State:\nno\n## Current State\nmore\n## x\ny"))
    plain = F.concat(F.lit("## Current State\n\n## Action\nCurrent UI State:\n"), text, F.lit("\n[Screenshot]\nend"))
    return t["conversations"].where(text != "").select("conv_id", "turn", F.md5(P.current_state(F.when(F.col("turn") % 2 == 0, headed).otherwise(plain))).alias("state"))


@query("fn24_chat_prefix", """SELECT conv_id, turn, md5(CASE turn % 3 WHEN 0 THEN '<|im_start|>system' || chr(10) || role || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)
  WHEN 1 THEN '<|begin_of_text|><|start_header_id|>system<|end_header_id|>' || chr(10) || chr(10) || role || '<|eot_id|><|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10) || coalesce(text, '') || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10)
  ELSE '<|system|>' || chr(10) || role || '<|user|>' || chr(10) || coalesce(text, '') || '<|assistant|>' || chr(10) END) AS prefix FROM conversations""")
def fn24(t):
    model = F.element_at(F.array(*map(F.lit, ("Qwen2.5-VL", "Meta-Llama-3-8B", "other"))), (F.col("turn") % 3 + 1).cast("int"))
    return t["conversations"].select("conv_id", "turn", F.md5(P.prefix(P.template_of(model), F.col("role"), F.coalesce("text", F.lit("")))).alias("prefix"))


@query("fn26_without_images", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'see the list then ' || event_type END AS text FROM events""")
def fn26(t):
    """One mark and one image are replaced; two marks, or a mark without an image, give null."""
    body = F.concat(F.lit("see the <image> then "), "event_type", F.when(F.col("event_id") % 3 == 1, " <image>").otherwise(""))
    images = F.when(F.col("event_id") % 3 == 2, F.array().cast("array<string>")).when(F.col("event_id") % 3 == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    messages = F.array(F.struct(F.lit("human").alias("role"), body.alias("text")), F.struct(F.lit("gpt").alias("role"), F.lit("ok").alias("text")))
    done = P.without_images(messages, images, {"human": {"<image>": "list"}})
    return t["events"].select("event_id", done[0]["text"].alias("text"))


@query("fn29_bare_keys", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN user_id::VARCHAR WHEN 1 THEN user_id::VARCHAR ELSE 'page_' || event_type END AS page, CASE event_id % 3 WHEN 2 THEN NULL ELSE user_id::VARCHAR END AS number FROM events")
def fn29(t):
    user = F.col("user_id").cast("string")
    page = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("page_"), user)).when(F.col("event_id") % 3 == 1, user).otherwise(F.concat(F.lit("page_"), "event_type"))
    number = F.when(F.col("event_id") % 3 == 2, F.concat(F.lit("x"), user)).otherwise(F.concat(F.lit("00"), user))
    return t["events"].select("event_id", P.bare_page(page).alias("page"), P.bare_number(number).alias("number"))


@query("fn14_action_line", f"SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type || '  {{\"k\":' || CAST(json_extract_string(props, '$.k') AS BIGINT) || '}}  index=' || event_id WHEN 1 THEN '?' ELSE 'say this' END AS line FROM events")
def fn14(t):
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"type":"'), "event_type", F.lit('","params":'), F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit("}")), F.lit(',"index":'), "event_id", F.lit("}")))
    return t["events"].select("event_id", P.one_line(text.when(F.col("event_id") % 3 == 1, '{"params":{}}').otherwise("say\nthis")).alias("line"))

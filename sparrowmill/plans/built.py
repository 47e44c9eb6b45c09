"""Queries over allocation, splits, mirrors, processed samples, audits of changes, absorbed texts and metrics from word runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowmill.operators import absorbed, allocation, audits, ngrams, samples, trees, weights
from sparrowmill.plans.computed import TURNS, page_states, stated, turns
from sparrowmill.plans.registry import query
from sparrowmill.sources import builds

QUOTAS = """c AS (SELECT o_orderpriority AS stratum, count(*) AS n, count_if(o_orderpriority = '1-URGENT' AND o_orderstatus = 'P') AS flagged FROM orders GROUP BY 1),
q AS (SELECT *, row_number() OVER (ORDER BY (300 * n) % total DESC, stratum) AS r1, row_number() OVER (ORDER BY (500 * n) % total DESC, stratum) AS r2,
  300 - sum((300 * n) // total) OVER () AS s1, 500 - sum((500 * n) // total) OVER () AS s2 FROM (SELECT *, (sum(n) OVER ())::BIGINT AS total FROM c)),
a AS (SELECT stratum, (300 * n) // total + CASE WHEN r1 <= s1 THEN 1 ELSE 0 END AS q1, (500 * n) // total + CASE WHEN r2 <= s2 THEN 1 ELSE 0 END AS q2, flagged FROM q),
b AS (SELECT *, least(flagged // 2, q1, q2) AS ahead, CASE WHEN stratum = '5-LOW' THEN 20 ELSE 0 END AS given FROM a),
l AS (SELECT o_orderkey, o_orderpriority AS stratum, o_custkey, o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' AS flagged FROM orders),
m AS (SELECT *, row_number() OVER (PARTITION BY stratum, flagged, o_custkey ORDER BY md5('5|' || o_orderkey), o_orderkey) AS lap FROM l),
k AS (SELECT *, row_number() OVER (PARTITION BY stratum, flagged ORDER BY lap, md5('5|' || o_custkey), o_orderkey) AS rank FROM m),
z AS (SELECT o_orderkey AS key, k.stratum, CASE WHEN k.flagged THEN CASE WHEN rank <= ahead THEN 1 WHEN rank <= 2 * ahead THEN 2 END
    ELSE CASE WHEN rank <= greatest(0, q1 - ahead - given) THEN 1 WHEN rank <= greatest(0, q1 - ahead - given) + greatest(0, q2 - ahead - given) THEN 2 END END AS sample,
    CASE WHEN k.flagged THEN 'first' ELSE 'stock' END AS origin FROM k JOIN b USING (stratum)),
x AS (SELECT c_custkey, row_number() OVER (ORDER BY md5('5|' || c_custkey), c_custkey) AS place FROM customer),
found AS (SELECT * FROM z WHERE sample IS NOT NULL UNION ALL SELECT c_custkey, '5-LOW', CASE WHEN place <= 20 THEN 1 ELSE 2 END, 'extra' FROM x WHERE place <= 40)"""


def joint(t) -> tuple[DataFrame, DataFrame]:
    stock = t["orders"].withColumn("pending", F.col("o_orderstatus") == "P").withColumnRenamed("o_orderkey", "key")
    more = t["customer"].select(F.col("c_custkey").alias("key"))
    return allocation.joint_samples(stock, "key", "o_orderpriority", "o_custkey", (300, 500), "5", ("1-URGENT", "pending"), ("5-LOW", more, 20))


@query("smp06_joint_samples", f"WITH {QUOTAS} SELECT key, stratum, sample, origin FROM found")
def smp06(t):
    return joint(t)[0]


@query("smp06_joint_report", f"WITH {QUOTAS} SELECT stratum, sample, quota, taken, greatest(0, quota - taken) AS short FROM (SELECT stratum, s AS sample, CASE s WHEN 1 THEN q1 ELSE q2 END AS quota, count(key) AS taken FROM b CROSS JOIN (VALUES (1), (2)) v(s) LEFT JOIN found f USING (stratum) WHERE f.sample = s OR f.sample IS NULL GROUP BY ALL)")
def smp06_report(t):
    return joint(t)[1]


def _stratified_sql(name: str, pool: str, target: int, seed: int) -> str:
    return f"""{name}_c AS (SELECT stratum, count(*) AS n, (sum(count(*)) OVER ())::BIGINT AS total FROM {pool} GROUP BY 1),
{name}_q AS (SELECT *, row_number() OVER (ORDER BY ({target} * n) % total DESC, stratum) AS r, {target} - sum(({target} * n) // total) OVER () AS s FROM {name}_c),
{name} AS (SELECT key FROM (SELECT key, stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5('{seed}|' || key), key) AS rank FROM {pool}) JOIN {name}_q USING (stratum)
  WHERE total <= {target} OR rank <= ({target} * n) // total + CASE WHEN r <= s THEN 1 ELSE 0 END)"""


@query("smp08_in_and_out", f"""WITH r AS (SELECT o_orderkey AS key, CASE WHEN c_custkey % 10 <> 3 THEN n_name END AS app, o_orderstatus AS stratum, n_nationkey AS k FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
p AS (SELECT *, CASE WHEN app IS NULL THEN 'null' WHEN k < 12 THEN 'id' WHEN k < 20 THEN 'ood' ELSE 'null' END AS pool FROM r),
p1 AS (SELECT key, stratum FROM p WHERE pool = 'id'), {_stratified_sql("a", "p1", 150, 8)},
p2 AS (SELECT key, stratum FROM p WHERE pool = 'null' OR (pool = 'id' AND key NOT IN (SELECT key FROM a))), {_stratified_sql("b", "p2", 400, 7)},
p3 AS (SELECT key, stratum FROM p WHERE pool = 'ood'), {_stratified_sql("c", "p3", 100, 9)}
SELECT key, 'test_id' AS split FROM a UNION ALL SELECT key, 'train' FROM b UNION ALL SELECT key, 'test_ood' FROM c""")
def smp08(t):
    app = F.when(F.col("c_custkey") % 10 != 3, F.col("n_name"))
    rows = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select(F.col("o_orderkey").alias("key"), app.alias("app"), F.col("o_orderstatus").alias("stratum"))
    apps = lambda a, b: t["nation"].where(f"n_nationkey >= {a} AND n_nationkey < {b}").select(F.col("n_name").alias("app"))
    return allocation.in_and_out(rows, apps(0, 12), apps(12, 20), (400, 150, 100), 7, by_stratum=True)


def mirror(t) -> tuple[DataFrame, DataFrame]:
    members = t["events"].select("event_id", (F.col("event_id") % 3000).alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.array_repeat("event_type", (F.col("event_id") % 3).cast("int")).alias("images"))
    orders = t["orders"].select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.col("o_orderstatus").alias("text"))
    customers = t["customer"].select(F.col("c_custkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.col("c_name").alias("text"))
    side = F.when(F.size("images") == 2, "action").otherwise("state")
    return allocation.mirrored(members, {"action": orders, "state": customers}, side, ["l_orderkey", "l_linenumber"])


MIRROR = """m AS (SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 'action' ELSE 'state' END AS side, CASE WHEN event_id % 3 = 2 THEN o_orderstatus ELSE c_name END AS text
  FROM events LEFT JOIN orders ON o_orderkey = event_id % 3000 LEFT JOIN customer ON c_custkey = event_id % 3000)"""


@query("jn03_mirrored", f"WITH {MIRROR} SELECT event_id, side, text FROM m WHERE text IS NOT NULL")
def jn03(t):
    return mirror(t)[0].select("event_id", "side", F.col("body.text").alias("text"))


@query("jn03_mirror_counts", f"WITH {MIRROR} SELECT side, count(*) AS members, count(text) AS matched, count(*) - count(text) AS dropped FROM m GROUP BY side")
def jn03_counts(t):
    return mirror(t)[1]


def _grams(n: int, text: str) -> str:
    return f"unnest(list_transform(generate_series(1, len({text}) - {n - 1}), lambda i: array_to_string({text}[i:i + {n - 1}], ' ')))"


def _metric_sql(tokens: str, names: str, select: str) -> str:
    sides = " UNION ALL ".join(f"SELECT key, {n} AS n, {side} AS side, {_grams(n, side)} AS run FROM p" for n in range(1, 5) for side in ("h", "r"))
    sides = sides.replace("h AS side", "'h' AS side").replace("r AS side", "'r' AS side")
    return f"""WITH p AS (SELECT conv_id * 100 + turn AS key, {tokens.replace("{}", "text")} AS h, {tokens.replace("{}", "before")} AS r FROM {TURNS} t WHERE before IS NOT NULL),
g AS (SELECT key, n, run, least(count_if(side = 'h'), count_if(side = 'r')) AS hit FROM ({sides}) x GROUP BY ALL),
w AS (SELECT key, {", ".join(f"coalesce(sum(CASE WHEN n = {n} THEN hit END), 0) AS hit{n}" for n in range(1, 5))} FROM g GROUP BY key),
s AS (SELECT key, len(h) AS sh, len(r) AS sr, {", ".join(f"coalesce(hit{n}, 0)::DOUBLE AS hit{n}" for n in range(1, 5))} FROM p LEFT JOIN w USING (key)),
z AS (SELECT *, CASE WHEN sh > 0 THEN least(1.0, exp(1 - sr / sh)) ELSE 0.0 END AS bp FROM s) SELECT key, {select} FROM z"""


BLANK = "list_filter(regexp_split_to_array(coalesce({}, ''), '\\s+'), lambda x: x <> '')"
OPEN = "' ' || replace(replace(replace(replace(replace(replace(replace(coalesce({}, ''), '<skipped>', ''), '-' || chr(10), ''), chr(10), ' '), '&quot;', '\"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>') || ' '"
SPACED = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({OPEN}, '([\\{{-\\~\\[-\\` -\\&\\(-\\+\\:-\\@\\/])', ' \\1 ', 'g'), '([^0-9])([\\.,])', '\\1 \\2 ', 'g'), '([\\.,])([^0-9])', ' \\1 \\2', 'g'), '([0-9])(-)', '\\1 \\2 ', 'g')"
SPACED = SPACED.replace("\\{{", "\\{")
PARTS = ["ln(CASE WHEN hit{n} = 0 THEN 1 / pow(2, {missed}) ELSE hit{n} END / (sh - {less}))".format(n=n, less=n - 1, missed=" + ".join(f"CASE WHEN hit{m} = 0 THEN 1 ELSE 0 END" for m in range(1, n + 1))) for n in range(1, 5)]
LOGS = " + ".join(f"CASE WHEN sh >= {n} THEN {p} ELSE 0 END" for n, p in enumerate(PARTS, 1))


def _key():
    return (F.col("conv_id") * 100 + F.col("turn")).alias("key")


@query("met02_word_run_metrics", _metric_sql(BLANK, "", """round(CASE WHEN least(hit1, hit2, hit3, hit4) > 0 THEN bp * exp((ln(hit1 / sh) + ln(hit2 / (sh - 1)) + ln(hit3 / (sh - 2)) + ln(hit4 / (sh - 3))) / 4) ELSE 0 END, 6) AS bleu,
  round(CASE WHEN hit1 > 0 THEN 2 * hit1 / (sh + sr) ELSE 0 END, 6) AS rouge1, round(CASE WHEN hit2 > 0 THEN 2 * hit2 / (sh + sr - 2) ELSE 0 END, 6) AS rouge2"""))
def met02_runs(t):
    both = turns(t).where("before IS NOT NULL").select(_key(), "text", "before")
    found = ngrams.matched(both, ["key"], ngrams.blank_tokens(F.col("text")), ngrams.blank_tokens(F.col("before")))
    return found.select("key", *(F.round(c, 6).alias(n) for n, c in (("bleu", ngrams.bleu4()), ("rouge1", ngrams.rouge(1)), ("rouge2", ngrams.rouge(2)))))


@query("met06_sentence_bleu", _metric_sql(f"list_filter(regexp_split_to_array({SPACED}, '\\s+'), lambda x: x <> '')", "", f"round(CASE WHEN hit1 > 0 AND sr > 0 THEN bp * exp(({LOGS}) / least(4, sh)) ELSE 0 END, 6) AS bleu"))
def met06_bleu(t):
    both = turns(t).where("before IS NOT NULL").select(_key(), "text", "before")
    found = ngrams.matched(both, ["key"], ngrams.tokens_13a(F.col("text")), ngrams.tokens_13a(F.col("before")))
    return found.select("key", F.round(ngrams.sentence_bleu(), 6).alias("bleu"))


@query("diff06_change_audit")
def diff06(t):
    return audits.of_states(stated(t)).groupBy("key", "side", "kind", "outcome").agg(F.count("*").alias("n"), F.round(F.avg("sim"), 6).alias("sim"))


@query("diff06_audit_agrees", """SELECT count(*) AS keys, 0 AS differences FROM pages a WHERE EXISTS (FROM pages b WHERE b.page_id = a.page_id + 1) AND EXISTS (FROM pages c WHERE c.page_id = a.page_id + 2)""")
def diff06_agrees(t):
    states = allocation.held(stated(t), "states")
    by_audit = allocation.held(audits.summed(audits.of_states(states), states.select("key", F.col("n_cur").alias("n_left"))), "audit")
    found = audits.differences(by_audit, allocation.held(trees.diffed(states).select("key", *audits.COUNTS, *audits.SCORES), "rows"))
    return by_audit.agg(F.count("*").alias("keys")).crossJoin(F.broadcast(found.agg(F.count("*").alias("differences"))))  # one row each


@query("diff06_marks")
def diff06_marks(t):
    states = page_states(t).select("page_id", "current", "truth")
    true = allocation.held(trees.paired(states, "page_id", "current", "truth"), "pairs")
    return audits.marks(true).groupBy("key", "tree", "mark").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


@query("fn51_absorbed_texts")
def fn51(t):
    return absorbed.full_texts(t["pages"], "page_id", "html").select(F.col("key").alias("page_id"), "pos", "tag", F.md5("text").alias("text"))


def sampled(t, policy: str) -> DataFrame:
    """Pages as states after the page before; every fifth is an action, every seventh has no current state."""
    n = F.col("page_id")
    before = t["pages"].select((n + 1).alias("page_id"), F.col("html").alias("before"))
    rows = t["pages"].join(before, "page_id").select(
        "page_id",
        F.when(n % 5 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("images"),
        F.when(n % 7 != 0, F.col("before")).otherwise("").alias("current"),
        F.when(n % 10 == 0, F.lit("<action>{}</action>")).otherwise(F.col("html")).alias("answer"),
    )
    return samples.processed(rows, "page_id", "images", "current", "answer", weights.word_offsets("answer"), policy)


@query("wgt04_processed_samples", """SELECT status, count(*) AS samples, count_if(agrees = FALSE) AS disagree FROM (SELECT page_id % 5 = 0 AS action, CASE WHEN page_id % 5 = 0 THEN 'action' WHEN page_id % 7 = 0 THEN 'diff_fail' ELSE 'ok' END AS status,
  page_id % 5 <> 0 OR page_id % 10 = 0 AS agrees FROM pages a WHERE EXISTS (FROM pages b WHERE b.page_id = a.page_id - 1)) GROUP BY status""")
def wgt04(t):
    return samples.tally(sampled(t, "uniform")).select("status", "samples", "disagree")


@query("bld04_invariants", "SELECT * FROM (VALUES ('stage1: keys of the test', 0), ('stage1: 300 of 300 rows', 0), ('stage2: keys of the test', 0), ('stage2: 500 of 500 rows', 0)) v(rule, broken) WHERE (SELECT count(*) FROM orders) > 0")
def bld04(t):
    """The rules of a build of both joint samples and a test that leaves their keys out, with the rows that break each."""
    both = joint(t)[0].withColumn("id", F.concat_ws("|", F.when(F.col("origin") == "extra", "c").otherwise("o"), "key"))
    test = t["orders"].select(F.concat_ws("|", F.lit("o"), "o_orderkey").alias("id")).join(both, "id", "left_anti")
    rules = builds.sample_rules({"stage1": ("origin", 300), "stage2": ("origin", 500)}, "test", "id")
    found = rules({"stage1": both.where("sample = 1"), "stage2": both.where("sample = 2"), "test": test})
    counted = [rows.agg(F.count("*").cast("int").alias("broken")).select(F.lit(rule).alias("rule"), "broken") for rule, rows in found.items()]
    return reduce(DataFrame.unionByName, counted)

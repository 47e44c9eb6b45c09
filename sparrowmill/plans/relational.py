"""Joins, filters, aggregates, windows, sampling and builders of the reference, as SQL over the driver's tables.

``events`` stand for the collector's stream (user_id is the session, event_type the page or action), ``orders`` for rows
to split (o_orderpriority is the action type), ``customer`` for episodes, ``nation`` for apps.
Random orders are replaced by the order of md5(seed|key), the same in every engine.
"""

from sparrowmill.plans.registry import sql_query

# --- scans and sinks with semantics that SQL shows ---
sql_query("src11_last_event_per_frame", """
SELECT user_id, frame, max_by(event_type, event_id) AS event_type, max(event_id) AS line_no, count(*) AS n_lines
FROM (SELECT user_id, event_id, event_type, event_id % 7 AS frame FROM {events} WHERE event_type IS NOT NULL) e GROUP BY user_id, frame""")
sql_query("src08_catalog_flags", """
SELECT p_partkey, trim(p_brand) AS package_id, lower(trim(p_type)) AS category, lower(CASE WHEN p_size % 3 = 0 THEN 'Yes' WHEN p_size % 3 = 1 THEN 'n' ELSE 'TRUE' END) IN ('true', '1', 'yes', 'y', 't') AS installed
FROM {part} WHERE p_name IS NOT NULL AND trim(p_name) <> ''""")
sql_query("src20_first_file_wins", """
SELECT k, min_by(v, priority) AS v FROM (
  SELECT p_brand AS k, p_size AS v, p_partkey AS priority FROM {part} UNION ALL SELECT p_type, p_size, p_partkey + 1000000 FROM {part}) f GROUP BY k""")

# --- filters ---
sql_query("flt01_length_filter", """
SELECT doc_id, n_chars FROM {documents} WHERE n_chars IS NULL OR n_chars <= 2000""")
sql_query("flt02_pool_length_filter", """SELECT doc_id, coalesce(n_chars, -1) AS length FROM {documents} WHERE coalesce(n_chars, 1000000000) <= 1500""")
sql_query("flt06_exclude_action_type", """SELECT event_id, event_type FROM {events} WHERE event_type IS DISTINCT FROM 'click'""")
sql_query("flt10_no_op_transitions", """
SELECT event_id, event_type, nxt FROM (SELECT event_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM {events}) e
WHERE nxt IS NOT NULL AND event_type <> nxt""")
sql_query("flt11_completed_sessions", """
SELECT c_custkey, c_name FROM {customer} c LEFT ANTI JOIN (SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'F') o ON c.c_custkey = o.o_custkey""",
"""SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IS NOT NULL)""")
sql_query("flt13_best_build", """
SELECT p_brand, max_by(p_partkey, p_size * 1000000 + p_partkey) AS p_partkey, max(p_size) AS version FROM {part} WHERE p_type IS NOT NULL AND p_name IS NOT NULL GROUP BY p_brand""")
sql_query("flt14_truncated_leaves", """
SELECT source, avg(CAST(CASE WHEN n_chars > 4000 THEN 1 ELSE 0 END AS DOUBLE)) AS share, avg(CASE WHEN n_chars > 4000 THEN 1.0 ELSE 0.0 END) >= 0.05 AS truncated FROM {documents} GROUP BY source""")
sql_query("flt15_coordinate_space", """
SELECT user_id, avg(CASE WHEN abs(value) <= 1 THEN 1.0 ELSE 0.0 END) >= 0.9 AS unit_square, avg(CASE WHEN value < 0 OR value > 840 THEN 1.0 ELSE 0.0 END) >= 0.5 AS outside
FROM {events} WHERE value IS NOT NULL GROUP BY user_id""")

# --- joins ---
sql_query("jn02_app_groups", """
SELECT n.n_name AS app, count(*) AS n_rows, count(DISTINCT c.c_custkey) AS n_episodes FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey LEFT JOIN {nation} n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name""")
sql_query("jn03_mirror", """
SELECT o.o_orderkey, l.l_partkey, l.l_quantity FROM {orders} o JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey AND l.l_linenumber = 1""")
sql_query("jn03_unmatched", """
SELECT count(*) AS n_unmatched FROM {customer} c LEFT JOIN {orders} o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NULL""")
sql_query("jn06_gain", """
SELECT d.source, avg(m.quality - b.toxic) AS gain, count(m.quality - b.toxic) AS n_gain FROM {documents} d JOIN {labels} m ON d.doc_id = m.doc_id JOIN {labels} b ON d.doc_id = b.doc_id GROUP BY d.source""")
sql_query("jn11_activity_fallback", """
SELECT e.event_id, coalesce(nullif(CASE WHEN e.event_id % 3 = 0 THEN '' ELSE e.event_type END, ''), f.fallback, 'unknown') AS activity
FROM {events} e LEFT JOIN (SELECT user_id, max(event_type) AS fallback FROM {events} GROUP BY user_id) f ON e.user_id = f.user_id""")
sql_query("jn13_installed_flags", """
SELECT count(*) AS total, sum(CASE WHEN s.ps IS NOT NULL THEN 1 ELSE 0 END) AS installed, sum(CASE WHEN (s.ps IS NOT NULL) <> (p.p_size > 25) THEN 1 ELSE 0 END) AS changed
FROM {part} p LEFT JOIN (SELECT DISTINCT l_partkey AS ps FROM {lineitem} WHERE l_returnflag = 'R') s ON p.p_partkey = s.ps""")
sql_query("jn15_job_partition", """
SELECT c_custkey, CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'fdroid' WHEN c_mktsegment = 'MACHINERY' THEN 'playstore' ELSE 'system' END AS job FROM {customer} WHERE c_acctbal IS NOT NULL""")
sql_query("jn17_span_occurrence", """
WITH a AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS occ FROM {events}),
b AS (SELECT event_id AS node_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS occ FROM {events} WHERE value IS NOT NULL)
SELECT a.event_id, b.node_id FROM a JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.occ = b.occ""")
sql_query("jn18_interval_overlap", """
WITH s AS (SELECT l_orderkey AS k, l_linenumber AS id, l_linenumber * 10 AS s, CAST(l_linenumber * 10 + l_quantity AS BIGINT) AS e, l_discount AS w FROM {lineitem}),
t AS (SELECT o_orderkey AS k, x.x AS s, x.x + 4 AS e FROM {orders} CROSS JOIN (VALUES (8), (15), (31), (52)) x(x))
SELECT k, s, max(w) AS weight FROM (
  SELECT t.k, t.s, s.w, rank() OVER (PARTITION BY t.k, t.s ORDER BY s.e - s.s) AS r FROM t JOIN s ON t.k = s.k AND t.s < s.e AND t.e > s.s) j WHERE r = 1 GROUP BY k, s""")

# --- aggregates ---
sql_query("agg01_macro_of_rounded", """
WITH p AS (SELECT event_type AS gt, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pred FROM {events}),
t AS (SELECT gt, count(*) AS n, round(sum(CASE WHEN gt = pred THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 4) AS acc FROM p WHERE pred IS NOT NULL GROUP BY gt)
SELECT sum(n) AS n, avg(acc) AS macro FROM t""")
sql_query("agg04_defined_means", """
SELECT d.lang, count(*) AS total, coalesce(avg(l.quality), 0.0) AS avg_quality, count(l.quality) AS n_quality, avg(coalesce(l.toxic, 0)) AS rate_toxic FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY d.lang""")
sql_query("agg06_sections", """
SELECT coalesce(lang, 'overall') AS section, count(*) AS n, avg(n_chars) AS mean_chars FROM {documents} WHERE lang IS NOT NULL GROUP BY GROUPING SETS ((lang), ())""")
sql_query("agg09_fixed_histogram", """
SELECT user_id, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS click, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS view_n, sum(CASE WHEN event_type = 'never' THEN 1 ELSE 0 END) AS never FROM {events} GROUP BY user_id""")
sql_query("agg10_worst_case", """
SELECT l_orderkey, min_by(l_returnflag, (CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1000 END + l_linenumber) * 100000000000 + l_partkey * 10000 + l_suppkey) AS label FROM {lineitem} GROUP BY l_orderkey""")
sql_query("agg11_run_totals", """SELECT o_orderstatus AS status, count(*) AS n, sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) AS n_large FROM {orders} GROUP BY o_orderstatus""")
sql_query("agg12_mean_and_deviation", """
SELECT lang, count(*) AS n, sum(CASE WHEN quality IS NULL THEN 1 ELSE 0 END) AS missing, avg(coalesce(quality, 0)) AS mean, coalesce(stddev_pop(coalesce(quality, 0)), 0.0) AS deviation
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY lang""")
sql_query("agg13_type_distribution", """
SELECT event_type, n, row_number() OVER (ORDER BY n DESC, first_seen) AS place FROM (SELECT event_type, count(*) AS n, min(event_id) AS first_seen FROM {events} GROUP BY event_type) c""")
sql_query("agg14_majority_app", """
WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_step FROM {events} GROUP BY user_id, event_type),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'view' THEN 1 ELSE 0 END, n DESC, first_step) AS rn FROM c)
SELECT user_id, event_type AS primary_app, n FROM r WHERE rn = 1""")
sql_query("agg15_page_nodes", """
SELECT event_type AS page_key, count(*) AS visit_count, min(event_id) AS first_seen, count(DISTINCT user_id) AS observation_count FROM {events} GROUP BY event_type""")
sql_query("agg16_page_edges", """
WITH e AS (SELECT user_id, event_id, event_type AS to_page, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_page, props FROM {events})
SELECT from_page, to_page, count(*) AS n, min(event_id) AS first_seen, min_by(props, event_id) AS element_info FROM e WHERE from_page IS NOT NULL AND from_page <> to_page GROUP BY from_page, to_page""")
sql_query("agg17_graph_summary", """
WITH e AS (SELECT event_type AS to_page, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_page FROM {events}),
g AS (SELECT from_page, to_page, count(*) AS n FROM e WHERE from_page IS NOT NULL AND from_page <> to_page GROUP BY from_page, to_page)
SELECT from_page, count(*) AS out_degree, max(n) AS most FROM g GROUP BY from_page""")
sql_query("agg18_action_effects", """
SELECT page, action, fires, destinations, fires > 4 AND destinations = 1 AS saturated FROM (
  SELECT event_type AS page, event_id % 5 AS action, count(*) AS fires, count(DISTINCT nxt) AS destinations FROM (
    SELECT event_type, event_id, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM {events}) x WHERE nxt IS NOT NULL GROUP BY event_type, event_id % 5) s""")
sql_query("agg19_metadata_counters", """
SELECT user_id, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS external_app, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS open_app, max(event_id) + 1 AS total_steps FROM {events} GROUP BY user_id""")
sql_query("agg20_ledger_upsert", """
SELECT k, min(first_seen) AS first_seen, max(last_seen) AS last_seen, max_by(reason, last_seen) AS reason FROM (
  SELECT o_custkey AS k, o_orderkey AS first_seen, o_orderkey AS last_seen, o_orderstatus AS reason FROM {orders} WHERE o_orderkey % 2 = 0
  UNION ALL SELECT o_custkey, o_orderkey, o_orderkey, 'new' FROM {orders} WHERE o_orderkey % 2 = 1) u GROUP BY k""")
sql_query("agg25_constant_groups", """SELECT p_brand, count(DISTINCT p_type) AS kinds, count(DISTINCT p_type) = 1 AS constant FROM {part} GROUP BY p_brand""")
sql_query("agg26_cost", """
SELECT o.o_custkey, sum(l.l_quantity * coalesce(m.price_in, 0) + l.l_linenumber * coalesce(m.price_out, 0)) / 1e6 AS cost FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
LEFT JOIN (VALUES ('A', 2.5, 10.0), ('N', 0.15, 0.6)) m(model, price_in, price_out) ON l.l_returnflag = m.model GROUP BY o.o_custkey""")

# --- windows ---
sql_query("win01_transition_pairs", """
SELECT user_id, event_id, nxt_id FROM (SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt_id FROM {events}) e WHERE nxt_id IS NOT NULL""")
sql_query("win02_legacy_pairs", """
SELECT user_id, event_id, nxt_id FROM (SELECT user_id, event_id, lead(event_id, 1, 1000000000) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt_id FROM {events}) e WHERE nxt_id > event_id""")
sql_query("win03_edges_from_previous_page", """
SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_page, event_type AS to_page FROM {events} WHERE value IS NOT NULL""")
sql_query("win04_edges_from_frame_before", """
WITH f AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) + CASE WHEN event_id % 11 = 0 THEN 1000 ELSE 0 END AS frame FROM {events})
SELECT a.user_id, a.frame, coalesce(b.event_type, 'unknown') AS action FROM f a LEFT JOIN f b ON a.user_id = b.user_id AND b.frame = a.frame - 1""")
sql_query("win06_running_cost", """
SELECT l_orderkey, l_linenumber, l_partkey, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM {lineitem}""")
sql_query("win07_same_page_streak", """
WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS island FROM {events})
SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, island ORDER BY ts, event_id) AS streak FROM a""")
sql_query("win08_steps_since_new_page", """
WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS seen FROM {events}),
b AS (SELECT *, max(CASE WHEN seen = 1 THEN step END) OVER (PARTITION BY user_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_new FROM a)
SELECT event_id, step - last_new AS idle, step - last_new >= 98 AS stop FROM b""")
sql_query("win10_observation_numbers", """
SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS observation_num, min(event_id) OVER (PARTITION BY event_type) AS first_seen FROM {events}""")
sql_query("win12_app_budget", """
WITH a AS (SELECT c_nationkey AS app, count(*) AS n FROM {customer} GROUP BY c_nationkey),
b AS (SELECT app, n, sum(n) OVER (ORDER BY md5(concat('12|', CAST(app AS VARCHAR(99)))), app ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS ahead, sum(n) OVER () AS total FROM a)
SELECT app, n, ahead < total * 0.2 AS ood FROM b""")

# --- sets, top-k, sampling ---
sql_query("set01_first_of_each_signature", """
SELECT conv_id, turn, signature FROM (SELECT conv_id, turn, md5(concat(role, '|', text)) AS signature, row_number() OVER (PARTITION BY md5(concat(role, '|', text)) ORDER BY conv_id, turn) AS rn FROM {conversations}) s WHERE rn = 1""")
sql_query("set04_disjoint", """SELECT o_orderkey FROM {orders} EXCEPT SELECT o_orderkey FROM {orders} WHERE o_orderkey % 5 = 0""")
sql_query("set06_leakage", """SELECT count(*) AS n_leaked FROM (SELECT text FROM {benchmark} INTERSECT SELECT text FROM {documents}) i""")
sql_query("set08_reconcile", """
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'orphan' WHEN b.k IS NULL THEN 'missing' WHEN a.v = b.v THEN 'same' ELSE 'diff' END AS state
FROM (SELECT s_suppkey AS k, s_nationkey AS v FROM {supplier}) a FULL OUTER JOIN (SELECT c_custkey AS k, c_nationkey AS v FROM {customer}) b ON a.k = b.k""")
sql_query("set10_test_keys", """SELECT o_custkey AS k FROM {orders} WHERE o_orderstatus = 'O' UNION SELECT c_custkey FROM {customer} WHERE c_acctbal < 0""")
sql_query("top02_largest_remainder", """
WITH c AS (SELECT o_orderpriority AS kind, count(*) AS n, sum(count(*)) OVER () AS total FROM {orders} GROUP BY o_orderpriority),
q AS (SELECT kind, n, floor(100.0 * n / total) AS base, 100.0 * n / total - floor(100.0 * n / total) AS frac FROM c),
r AS (SELECT *, row_number() OVER (ORDER BY frac DESC, kind) AS rn, 100 - sum(base) OVER () AS spare FROM q)
SELECT kind, n, CAST(base + CASE WHEN rn <= spare THEN 1 ELSE 0 END AS BIGINT) AS quota FROM r""")
sql_query("top07_capped_list", """SELECT user_id, least(count(*), 100) AS shown, greatest(count(*) - 100, 0) AS more FROM {events} GROUP BY user_id""")
sql_query("smp03_stratified_subsample", """
WITH c AS (SELECT o_orderpriority AS kind, count(*) AS n, sum(count(*)) OVER () AS total FROM {orders} GROUP BY o_orderpriority),
q AS (SELECT kind, floor(300.0 * n / total) AS base, row_number() OVER (ORDER BY 300.0 * n / total - floor(300.0 * n / total) DESC, kind) AS rn, 300 - sum(floor(300.0 * n / total)) OVER () AS spare FROM c),
o AS (SELECT o_orderkey, o_orderpriority AS kind, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(concat('3|', CAST(o_orderkey AS VARCHAR(99)))), o_orderkey) AS rn FROM {orders})
SELECT o.o_orderkey, o.kind FROM o JOIN q ON o.kind = q.kind WHERE o.rn <= q.base + CASE WHEN q.rn <= q.spare THEN 1 ELSE 0 END""")
sql_query("smp06_disjoint_double", """
SELECT o_orderkey, CASE WHEN rn <= 20 THEN 'downstream' ELSE 'state' END AS part FROM (
  SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(concat('6|', CAST(o_orderkey AS VARCHAR(99)))), o_orderkey) AS rn FROM {orders}) a WHERE rn <= 50""")
# --- small operators ---
sql_query("str04_signal_collapse", """
WITH a AS (SELECT *, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM {events})
SELECT user_id, run, max(event_id) AS last_event, count(*) AS drained FROM a GROUP BY user_id, run""")
sql_query("str05_gap_timeouts", """
SELECT event_id, coalesce(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '1' HOUR, false) AS timed_out FROM {events}""")
sql_query("str07_resume_frame", """SELECT user_id, max(event_id) + 1 AS next_frame FROM {events} GROUP BY user_id""")
sql_query("msc01_layout", """
SELECT conv_id, CASE WHEN max(CASE WHEN role = 'system' THEN 1 ELSE 0 END) = 1 THEN 'state' WHEN count(*) > 4 THEN 'stage2' ELSE 'action' END AS layout FROM {conversations} GROUP BY conv_id""")
sql_query("msc05_element_info", """SELECT event_id, CASE WHEN event_id % 4 > 0 THEN concat('element_', CAST(event_id % 4 AS VARCHAR(99))) ELSE event_type END AS info FROM {events}""")
sql_query("msc10_open_app_once", """
SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM {events}) e WHERE event_type = 'view' AND before IS DISTINCT FROM 'view'""")
sql_query("msc12_back_exit_pages", """
SELECT DISTINCT page FROM (SELECT event_type AS page, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM {events}) e WHERE nxt = 'click'""")
sql_query("msc14_config_grid", """
SELECT r.r_name AS dataset, n.n_name AS model, m.m AS mode FROM {region} r CROSS JOIN {nation} n CROSS JOIN (VALUES ('full'), ('lora')) m(m) WHERE n.n_regionkey = r.r_regionkey AND NOT (m.m = 'full' AND n.n_nationkey % 4 = 0)""")
sql_query("msc15_batch_policy", """
SELECT p_partkey, per, procs, CASE WHEN 64 % (per * procs) = 0 THEN CAST(64 / (per * procs) AS BIGINT) ELSE 0 END AS grad_accum FROM (
  SELECT p_partkey, CASE WHEN p_size > 40 THEN 1 WHEN p_size > 20 THEN 2 ELSE 4 END AS per, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 3 END AS procs FROM {part}) a""")
sql_query("msc16_layered_config", """SELECT c_custkey, coalesce(CASE WHEN c_custkey % 7 = 0 THEN 'cli' END, CASE WHEN c_custkey % 3 = 0 THEN 'env' END, CASE WHEN c_custkey % 2 = 0 THEN 'yaml' END, 'default') AS origin FROM {customer}""")
sql_query("msc19_summary_matrix", """
SELECT source, max(CASE WHEN lang = 'en' THEN n END) AS en, max(CASE WHEN lang = 'de' THEN n END) AS de, max(CASE WHEN lang = 'fr' THEN n END) AS fr FROM (SELECT source, lang, count(*) AS n FROM {documents} GROUP BY source, lang) c GROUP BY source""")
sql_query("msc21_base_artifact", """SELECT p_brand, max_by(p_name, p_size * 1000000 + p_partkey) AS artifact FROM {part} GROUP BY p_brand""")
sql_query("msc23_enum_fallback", """SELECT c_custkey, CASE WHEN upper(trim(c_mktsegment)) IN ('AUTOMOBILE', 'BUILDING') THEN upper(trim(c_mktsegment)) ELSE 'GREEDY' END AS strategy FROM {customer}""")

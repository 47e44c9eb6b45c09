"""Joins, audits, ledgers and samples over catalogs and sessions, as SQL over the driver's tables.

``events`` stand for the collector's stream, ``part`` for the app catalog, ``lineitem`` for scored rows, ``orders`` for
rows to split. Random orders are replaced by the order of md5(seed|key).
"""

from sparrowmill.plans.registry import sql_query

# --- scans with semantics that SQL shows ---
sql_query("src09_last_row_wins", """
SELECT package, max_by(size, line) AS size FROM (SELECT trim(p_brand) AS package, p_size AS size, p_partkey AS line FROM {part}) p
WHERE package IS NOT NULL AND package <> '' GROUP BY package""")
sql_query("src12_replay_events", """
SELECT user_id, event_id, event_type AS page_key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place
FROM {events} WHERE event_type IS NOT NULL AND event_id % 7 <> 0""")
sql_query("src13_step_activity", """
SELECT user_id, step, max_by(event_type, event_id) AS activity FROM (
  SELECT user_id, event_id, event_type, TRY_CAST(CASE WHEN event_id % 5 = 0 THEN 'x' ELSE CAST(event_id % 11 AS VARCHAR(99)) END AS INT) AS step FROM {events}) e
WHERE step IS NOT NULL GROUP BY user_id, step""")

# --- filters ---
sql_query("flt07_catalog_filter", """
SELECT p_partkey FROM {part} WHERE lower(trim(p_type)) IN ('economy', 'standard') AND lower(trim(p_brand)) IN ('brand#5', 'brand#13') AND p_size > 5""")
sql_query("flt09_eligible_events", """
SELECT event_id, user_id, event_type FROM {events}
WHERE coalesce(event_id % 6 <> 0, TRUE) AND event_id % 10 <> 3 AND event_type IS NOT NULL AND user_id IS NOT NULL""")
sql_query("flt12_reset_targets", """
SELECT s.s_suppkey FROM {supplier} s LEFT SEMI JOIN (SELECT n_nationkey FROM {nation} WHERE n_regionkey IN (0, 2)) n ON s.s_nationkey = n.n_nationkey""", """
SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (0, 2))""")

# --- joins ---
sql_query("jn05_setting_alignment", """
WITH a AS (SELECT l_orderkey AS row_id, l_returnflag AS setting, count(*) AS n FROM {lineitem} GROUP BY l_orderkey, l_returnflag),
s AS (SELECT count(DISTINCT setting) AS k FROM a)
SELECT row_id, count(*) AS settings, max(n) - min(n) AS spread, count(*) = max(k) AND max(n) = min(n) AS aligned FROM a CROSS JOIN s GROUP BY row_id""")
sql_query("jn09_both_ends_observed", """
WITH o AS (SELECT DISTINCT user_id, event_type FROM {events} WHERE event_id % 2 = 0),
e AS (SELECT event_id, user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type FROM {events})
SELECT e.event_id FROM e JOIN o a ON e.user_id = a.user_id AND e.event_type = a.event_type JOIN o b ON e.user_id = b.user_id AND e.next_type = b.event_type""")
sql_query("jn12_alias_then_member", """
WITH alias AS (SELECT DISTINCT p_type AS name, upper(p_type) AS target FROM {part}), declared AS (SELECT DISTINCT upper(p_type) AS name FROM {part} WHERE p_size > 10)
SELECT p.p_partkey, coalesce(a.target, p.p_brand) AS resolved, d.name IS NOT NULL AS declared
FROM {part} p LEFT JOIN alias a ON CASE WHEN p.p_partkey % 2 = 0 THEN p.p_type ELSE p.p_brand END = a.name LEFT JOIN declared d ON coalesce(a.target, p.p_brand) = d.name""")
sql_query("jn14_manifest_metadata", """
SELECT n.n_nationkey, coalesce(r.r_name, '') AS category, coalesce(r.r_regionkey, -1) AS priority
FROM {nation} n LEFT JOIN (SELECT * FROM {region} WHERE r_regionkey <> 3) r ON n.n_regionkey = r.r_regionkey""")
sql_query("jn16_package_context", """
SELECT c.c_custkey, n.n_name AS context FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey""")

# --- aggregates ---
sql_query("agg03_mean_or_zero", """
SELECT l_returnflag, coalesce(round(avg(CASE WHEN l_quantity > 49 THEN l_discount END), 4), 0) AS discount, coalesce(round(avg(CASE WHEN l_quantity > 99 THEN l_tax END), 4), 0) AS tax FROM {lineitem} GROUP BY l_returnflag""")
sql_query("agg05_merged_aggregates", """
WITH a AS (SELECT l_returnflag AS section, count(*) AS total, round(avg(l_quantity), 4) AS first FROM {lineitem} GROUP BY l_returnflag),
b AS (SELECT l_returnflag AS section, count(*) AS total, round(avg(l_discount), 4) AS second FROM {lineitem} GROUP BY l_returnflag)
SELECT coalesce(a.section, b.section) AS section, coalesce(a.total, b.total) AS total, first, second, a.total IS NOT NULL AND b.total IS NOT NULL AND a.total <> b.total AS clash FROM a FULL JOIN b ON a.section = b.section""")
sql_query("agg08_metric_means", """
SELECT count(*) AS n, round(avg(l_quantity), 4) AS ea, round(avg(l_discount), 4) AS f1, round(avg(l_tax), 4) AS text FROM {lineitem}""")
sql_query("agg21_ledger_report", """
SELECT p_brand AS source, count(*) AS n, array_join(sort_array(collect_set(p_type)), ',') AS packages FROM {part} GROUP BY p_brand""", """
SELECT p_brand AS source, count(*) AS n, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS packages FROM part GROUP BY p_brand""")
sql_query("agg22_replay_audit", """
SELECT event_type AS page, count(DISTINCT user_id) AS sessions, count(DISTINCT user_id % 3) AS packages, count(DISTINCT user_id % 3) > 1 AS crosses FROM {events} GROUP BY event_type""")
sql_query("agg23_derivability_totals", """
SELECT l_linestatus AS kind, count(*) AS n, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS underivable, sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS own_text,
  sum(CASE WHEN l_quantity > 25 AND l_returnflag = 'R' THEN 1 ELSE 0 END) AS own_underivable, sum(CASE WHEN l_returnflag = 'A' AND l_discount = 0 THEN 1 ELSE 0 END) AS undecidable FROM {lineitem} GROUP BY l_linestatus""")
sql_query("agg24_sample_metrics", """
SELECT event_type, count(*) AS rows_in, count(CASE WHEN value > 20 THEN 1 END) AS defined, round(100.0 * avg(CASE WHEN value > 20 THEN CASE WHEN value > 100 THEN 1 ELSE 0 END END), 1) AS percent FROM {events} GROUP BY event_type""")

# --- windows, order ---
sql_query("win13_occurrence_index", """
SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS occurrence FROM {lineitem}""")
sql_query("top04_largest_effects", """
SELECT event_type, user_id, count(*) AS effects FROM {events} GROUP BY event_type, user_id ORDER BY effects DESC, event_type, user_id LIMIT 10""")
sql_query("top05_canonical_metadata", """
SELECT row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS place, c_custkey AS episode_id, c_nationkey AS app, c_mktsegment AS goal FROM {customer}""")
sql_query("top06_foreground_by_layer", """
SELECT o_custkey AS win, max_by(o_orderpriority, o_orderkey) AS package, max(o_orderkey) AS layer FROM {orders} GROUP BY o_custkey""")

# --- sets ---
sql_query("set03_unique_in_order", """
SELECT package, row_number() OVER (ORDER BY first_at) AS place FROM (SELECT p_brand AS package, min(p_partkey) AS first_at FROM {part} GROUP BY p_brand) p""")
sql_query("set07_line_set_difference", """
WITH a AS (SELECT DISTINCT event_type FROM {events} WHERE value > 200), b AS (SELECT DISTINCT event_type FROM {events} WHERE value < 1)
SELECT coalesce(a.event_type, b.event_type) AS line, CASE WHEN b.event_type IS NULL THEN 'left' WHEN a.event_type IS NULL THEN 'right' ELSE 'both' END AS side FROM a FULL JOIN b ON a.event_type = b.event_type""")

# --- sampling ---
sql_query("smp04_allocation", """
WITH c AS (SELECT l_returnflag AS kind, count(*) AS n FROM {lineitem} GROUP BY l_returnflag), s AS (SELECT sum(n) AS total FROM c),
q AS (SELECT kind, n, CAST(floor(n * 1000.0 / total) AS BIGINT) AS base, n * 1000 % total AS rest FROM c CROSS JOIN s),
r AS (SELECT kind, n, base, row_number() OVER (ORDER BY rest DESC, kind) AS rn, 1000 - sum(base) OVER () AS spare FROM q)
SELECT kind, n, base + CASE WHEN rn <= spare THEN 1 ELSE 0 END AS quota FROM r""")
sql_query("smp05_round_robin_strata", """
WITH r AS (SELECT o_orderkey, o_orderpriority AS kind, o_custkey AS episode, row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY md5(concat('5|', CAST(o_orderkey AS VARCHAR(99)))), o_orderkey) AS lap FROM {orders}),
p AS (SELECT o_orderkey, kind, lap, row_number() OVER (PARTITION BY kind ORDER BY lap, md5(concat('5|', CAST(episode AS VARCHAR(99)))), o_orderkey) AS place, count(*) OVER (PARTITION BY kind) AS stock FROM r)
SELECT o_orderkey, kind, lap, stock < 25 AS short FROM p WHERE place <= 25""")
sql_query("smp07_app_disjoint", """
WITH a AS (SELECT c_nationkey AS app, count(*) AS n FROM {customer} GROUP BY c_nationkey),
b AS (SELECT app, sum(n) OVER (ORDER BY md5(concat('7|', CAST(app AS VARCHAR(99)))), app ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS ahead, sum(n) OVER () AS total FROM a)
SELECT c.c_custkey, CASE WHEN b.ahead < b.total * 0.3 THEN 'ood' ELSE 'id' END AS part FROM {customer} c JOIN b ON c.c_nationkey = b.app""")
sql_query("smp11_seeded_sample", """
SELECT o_orderkey, o_orderstatus FROM (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(concat('11|', CAST(o_orderkey AS VARCHAR(99)))), o_orderkey) AS rn FROM {orders}) a WHERE rn <= 40""")

# --- metrics ---
sql_query("met07_index_action", """
SELECT event_id, kind = other AS type_ok, kind = other AND CASE WHEN kind IN ('error', 'signup') THEN TRUE WHEN kind = 'click' THEN CAST(k AS VARCHAR(99)) = CAST(m AS VARCHAR(99)) ELSE FALSE END AS step_ok FROM (
  SELECT event_id, event_type AS kind, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS other, event_id % 3 AS k, user_id % 3 AS m FROM {events}) e WHERE other IS NOT NULL""")

# --- small operators ---
sql_query("msc03_mixed_stamps", """
SELECT l_returnflag AS leaf, count(DISTINCT l_linestatus) AS sets, count(DISTINCT l_linestatus) > 1 AS mixed FROM {lineitem} GROUP BY l_returnflag""")
sql_query("msc06_coverage_activity", """
SELECT e.event_id, CASE WHEN d.name IS NOT NULL THEN e.event_type ELSE concat('device-', CAST(e.user_id AS VARCHAR(99))) END AS activity
FROM {events} e LEFT JOIN (SELECT event_type AS name FROM {events} GROUP BY event_type HAVING count(*) > 100) d ON e.event_type = d.name""")
sql_query("msc13_grant_button", """
WITH k AS (SELECT 1 AS pref, 'large' AS word UNION ALL SELECT 2, 'small' UNION ALL SELECT 3, 'widget')
SELECT p_brand, min_by(p_partkey, CAST(pref AS BIGINT) * 1000000000 + p_partkey) AS button FROM {part} JOIN k ON instr(lower(p_name), word) > 0 WHERE instr(lower(p_name), 'cold') = 0 GROUP BY p_brand""")
sql_query("msc17_ledger_violations", """
SELECT p_partkey, CASE WHEN p_name IS NULL THEN 'no name' WHEN p_size < 3 THEN 'size' ELSE 'price' END AS fault FROM {part} WHERE p_name IS NULL OR p_size < 3 OR p_retailprice > 1000""")
sql_query("msc18_kept_aliases", """
SELECT a.s_suppkey, a.s_nationkey FROM {supplier} a LEFT SEMI JOIN (SELECT c_nationkey FROM {customer} WHERE c_acctbal > 9000) d ON a.s_nationkey = d.c_nationkey""", """
SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)""")
sql_query("msc20_activity_source", """
SELECT n.n_nationkey, CASE WHEN d.total IS NOT NULL THEN 'catalog' ELSE 'device' END AS origin, coalesce(d.total, 0) AS denominator
FROM {nation} n LEFT JOIN (SELECT s_nationkey, count(*) AS total FROM {supplier} GROUP BY s_nationkey) d ON n.n_nationkey = d.s_nationkey""")

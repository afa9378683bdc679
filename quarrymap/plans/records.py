"""Analytics of the request log, votes, lists and change feeds.

The log is the events table: a user asks, the event type is the flow, the value is the duration, ``k`` of the properties is
the table in question. Expressions whose names differ between engines stand in guillemets.
"""

from __future__ import annotations

from quarrymap.plans.shared import plain, spark_query

SPARK = {
    "«pct»": "percentile",
    "«k»": "CAST(get_json_object(props, '$.k') AS BIGINT)",
    "«istanbul»": "from_utc_timestamp(ts, 'Europe/Istanbul')",
    "«json_has»": "get_json_object(props, '$.k') IS NOT NULL",
    "«days»": "explode(sequence(a, b, INTERVAL 1 DAY))",
    "«epoch»": "unix_micros(CAST(ts AS TIMESTAMP)) / CAST(1000000 AS DOUBLE)",
    "«list»": "collect_list",
    "«set»": "array_join(array_sort(collect_set(x)), ',')",
    "«text»": "STRING",
    "«iso»": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")",
    "«at_epoch»": "CAST(unix_seconds(try_to_timestamp(said_at)) AS DOUBLE)",
    "«even»": "bround",
    "«midnight»": "to_utc_timestamp(CAST(CAST(from_utc_timestamp(ts, 'Europe/Istanbul') AS DATE) AS TIMESTAMP), 'Europe/Istanbul')",
    "«seconds_text»": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")",
    "«minutes_text»": "date_format(ts, \"yyyy-MM-dd'T'HH:mm\")",
    "«map_text»": "array_join(array_sort(transform(map_entries(map_filter(map_concat(map_filter(map('status', o_orderstatus, 'origin', 'kept'), (k, v) -> k <> 'status' OR o_orderkey % 3 > 0), map('priority', o_orderpriority)), (k, v) -> k <> 'origin' OR o_orderkey % 2 = 0)), e -> e.key || '=' || e.value)), ',')",
}
DUCK = {
    "«pct»": "quantile_cont",
    "«k»": "CAST(json_extract_string(props, '$.k') AS BIGINT)",
    "«istanbul»": "(ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Istanbul'",
    "«json_has»": "json_extract_string(props, '$.k') IS NOT NULL",
    "«days»": "CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE)",
    "«epoch»": "epoch_us(ts) / CAST(1000000 AS DOUBLE)",
    "«list»": "list",
    "«set»": "array_to_string(list_sort(list(DISTINCT x)), ',')",
    "«text»": "VARCHAR",
    "«iso»": "strftime(ts, '%Y-%m-%dT%H:%M:%S')",
    "«at_epoch»": "floor(epoch(try_cast(said_at AS TIMESTAMP)))",
    "«even»": "round_even",
    "«midnight»": "(CAST(CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Istanbul' AS DATE) AS TIMESTAMP) AT TIME ZONE 'Europe/Istanbul') AT TIME ZONE 'UTC'",
    "«seconds_text»": "strftime(ts, '%Y-%m-%dT%H:%M:%S')",
    "«minutes_text»": "strftime(ts, '%Y-%m-%dT%H:%M')",
    "«map_text»": "array_to_string(list_sort(list_filter(['status=' || CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END, CASE WHEN o_orderkey % 2 = 0 THEN 'origin=kept' END, 'priority=' || o_orderpriority], lambda x: x IS NOT NULL)), ',')",
}

#: Ten questions; a vote was cast on that of its table's last digit, and questions five apart mean the same.
QUESTIONS = """asked AS (SELECT CAST(k AS BIGINT) AS text_key, CAST(k % 5 AS BIGINT) AS meaning_key FROM (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9)) AS q(k))"""
#: Votes on the same words count whole, on the same meaning 0.6, on another dictionary half as much, and half of it after 180 days;
#: a vote of unreadable age counts whole. Each person's latest vote on a table, or on the whole answer since it was written, counts.
VOTES = f"""
WITH {QUESTIONS}, cast_votes AS (
  SELECT event_id, user_id AS voter, «k» % 10 AS text_key, «k» % 5 AS meaning_key, CASE WHEN event_id % 9 = 0 THEN 'answer' ELSE 'object' END AS scope, event_id % 40 AS tbl,
         event_type = 'purchase' AS up, user_id % 4 = 0 AS other_dictionary, CASE WHEN event_id % 97 = 0 THEN 'long ago' ELSE «iso» END AS said_at
  FROM {{events}} WHERE event_type IN ('purchase', 'error') AND «k» IS NOT NULL
), matched AS (
  SELECT a.text_key AS question, v.*, CAST(1 AS DOUBLE) AS said FROM asked a JOIN cast_votes v ON v.text_key = a.text_key
  UNION ALL
  SELECT a.text_key, v.*, CAST(0.6 AS DOUBLE) FROM asked a JOIN cast_votes v ON v.meaning_key = a.meaning_key WHERE v.text_key <> a.text_key
), v AS (
  SELECT question, voter, CASE WHEN scope = 'answer' THEN -1 ELSE tbl END AS tbl, up, said * CASE WHEN other_dictionary THEN 0.5 ELSE 1 END
         * coalesce(pow(CAST(0.5 AS DOUBLE), greatest(CAST(0 AS DOUBLE), (1709251200 - «at_epoch») / CAST(86400 AS DOUBLE)) / CAST(180 AS DOUBLE)), CAST(1 AS DOUBLE)) AS weight,
         row_number() OVER (PARTITION BY question, voter, CASE WHEN scope = 'answer' THEN -1 ELSE tbl END ORDER BY event_id DESC) AS latest
  FROM matched WHERE scope <> 'answer' OR said_at >= '2024-01-10T00:00:00'
), t AS (
  SELECT question, tbl, sum(CASE WHEN up THEN weight ELSE CAST(0 AS DOUBLE) END) AS up, sum(CASE WHEN up THEN CAST(0 AS DOUBLE) ELSE weight END) AS down,
         CAST(sum(CASE WHEN up THEN 1 ELSE 0 END) AS BIGINT) AS people_up, CAST(sum(CASE WHEN up THEN 0 ELSE 1 END) AS BIGINT) AS people_down
  FROM v WHERE latest = 1 GROUP BY question, tbl
), told AS (
  SELECT *, (up - down) / (up + down + 2) AS support, CASE WHEN down >= 1.5 AND (up - down) / (up + down + 2) <= -0.3 THEN 'rejected' WHEN up > 0 AND (up - down) / (up + down + 2) >= 0.2 THEN 'approved'
         WHEN up > 0 AND down > 0 THEN 'disputed' WHEN down > 0 THEN 'doubted' ELSE '' END AS status
  FROM t
)
"""

CHANGES = """
WITH prior AS (
  SELECT o_orderkey AS key, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE o_orderpriority END AS priority
  FROM {orders} WHERE o_orderkey % 7 <> 0
), source AS (SELECT o_orderkey AS key, o_orderstatus AS status, o_orderpriority AS priority FROM {orders} WHERE o_orderkey % 17 <> 0),
merged AS (
  SELECT coalesce(p.key, s.key) AS key, p.key IS NULL AS is_new, s.key IS NULL AS is_gone, p.status AS old_status, s.status AS new_status, p.priority AS old_priority, s.priority AS new_priority
  FROM prior p FULL OUTER JOIN source s ON p.key = s.key
), changes AS (
  SELECT key, 'added' AS kind, '' AS field, '' AS old, '' AS new FROM merged WHERE is_new
  UNION ALL SELECT key, CASE WHEN key % 5 = 0 THEN 'kept' ELSE 'removed' END, '', '', '' FROM merged WHERE is_gone
  UNION ALL SELECT key, 'changed', 'status', old_status, new_status FROM merged WHERE NOT is_new AND NOT is_gone AND old_status <> new_status
  UNION ALL SELECT key, 'changed', 'priority', old_priority, new_priority FROM merged WHERE NOT is_new AND NOT is_gone AND old_priority <> new_priority AND old_priority = ''
)
"""

SQL = {
    "filter_records": """
SELECT event_id, user_id, event_type, value FROM {events}
WHERE event_type IN ('view', 'click') AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00' AND user_id % 2 = 0 AND props LIKE '%1%'""",
    "filter_period_istanbul": """
SELECT CAST(«istanbul» AS DATE) AS day, count(*) AS n FROM {events} WHERE CAST(«istanbul» AS DATE) >= DATE '2024-01-23' GROUP BY 1""",
    "kpi_summary": """
SELECT count(*) AS total, max(ts) AS newest, count(value) AS with_value, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS purchases,
       CAST(sum(coalesce(«k», 0)) AS BIGINT) AS tokens, count(DISTINCT user_id) AS askers FROM {events}""",
    "kpi_flows": """
SELECT f.flow, count(e.event_id) AS n FROM (VALUES ('purchase'), ('view'), ('signup'), ('error'), ('click'), ('refund')) AS f(flow) LEFT JOIN {events} e ON e.event_type = f.flow GROUP BY f.flow""",
    "kpi_quantiles": """
SELECT event_type, round(«pct»(value, 0.5), 6) AS p50, round(«pct»(value, 0.9), 6) AS p90, max(value) AS most FROM {events} GROUP BY event_type""",
    "kpi_phases": """
SELECT phase, round(avg(CASE WHEN v > 0 THEN v END), 6) AS mean, count(CASE WHEN v > 0 THEN 1 END) AS n FROM (
  SELECT 'wait' AS phase, value - 20 AS v FROM {events} UNION ALL SELECT 'model', value FROM {events} WHERE event_type = 'view' UNION ALL SELECT 'none', 0.0 * value FROM {events}
) GROUP BY phase""",
    "kpi_top_askers": """
SELECT user_id, name, n, newest_flow FROM (SELECT user_id, count(*) AS n, max_by(event_type, event_id) AS newest_flow FROM {events} GROUP BY user_id) JOIN (SELECT c_custkey, c_name AS name FROM {customer}) ON c_custkey = user_id ORDER BY n DESC, name LIMIT 10""",
    "kpi_daily": """
WITH d AS (SELECT CAST(«istanbul» AS DATE) AS day, event_type FROM {events}),
days AS (SELECT «days» AS day FROM (SELECT min(day) AS a, DATE '2024-02-05' AS b FROM d))
SELECT days.day, count(d.day) AS n, CAST(coalesce(sum(CASE WHEN d.event_type = 'error' THEN 1 ELSE 0 END), 0) AS BIGINT) AS errors
FROM days LEFT JOIN d ON d.day = days.day GROUP BY days.day""",
    "kpi_latest_average": """
SELECT round(coalesce((SELECT avg(value) FROM (SELECT value FROM {events} WHERE event_type = 'view' ORDER BY ts DESC, event_id DESC LIMIT 200)), 45.0), 6) AS mean""",
    "kpi_histogram": """
SELECT event_type, CAST(least(9, floor(value / 10)) AS INT) AS bucket, count(*) AS n FROM {events} WHERE value IS NOT NULL GROUP BY 1, 2""",
    "page_newest": """
SELECT event_id, ts, (SELECT count(*) FROM {events} WHERE event_type <> 'click') AS total FROM {events} WHERE event_type <> 'click' ORDER BY ts DESC, event_id DESC LIMIT 25 OFFSET 50""",
    "vote_tallies": VOTES + """
SELECT question, tbl, round(up, 6) AS up, round(down, 6) AS down, people_up, people_down, «even»(support, 3) AS support, status FROM told WHERE tbl >= 0""",
    "answer_rejected": VOTES + """
SELECT a.text_key AS question, coalesce(people_up, 0) AS people_up, coalesce(people_down, 0) AS people_down, coalesce(status, '') AS status, coalesce(down >= 1.5 AND down / (up + down) >= 0.6, false) AS answer_rejected
FROM asked a LEFT JOIN told ON told.question = a.text_key AND tbl = -1""",
    # A question's answer is the eight best of its tables by what views were worth; three more are near. Ranks are within a question.
    "vote_overlay": VOTES + """
, viewed AS (
  SELECT «k» % 10 AS question, event_id % 40 AS tbl, least(CAST(0.95 AS DOUBLE), round(avg(value) / 20, 4)) AS score FROM {events} WHERE event_type = 'view' AND «k» IS NOT NULL AND value IS NOT NULL AND event_id % 40 < 36 GROUP BY 1, 2
), ranked AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, tbl) AS was FROM viewed),
answer AS (SELECT *, CASE WHEN was <= 8 THEN 'shown' ELSE 'near' END AS part FROM ranked WHERE was <= 11),
o AS (
  SELECT answer.question, answer.tbl, was, CASE WHEN up + down > 0 THEN «even»(greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), score * (1 + 0.15 * support))), 4) ELSE score END AS score,
         CASE WHEN up + down > 0 THEN score END AS score_before, coalesce(status, '') AS status,
         CASE WHEN status = 'rejected' THEN 'rejected' WHEN part = 'near' AND status = 'approved' THEN 'promoted' ELSE part END AS part
  FROM answer LEFT JOIN told ON told.question = answer.question AND told.tbl = answer.tbl
), placed AS (
  SELECT question, tbl, part, score, score_before, status, CASE WHEN «even»(score, 2) >= 0.8 THEN 'Yüksek' WHEN «even»(score, 2) >= 0.5 THEN 'Orta' ELSE 'Düşük' END AS level,
         CASE WHEN part IN ('shown', 'promoted') THEN row_number() OVER (PARTITION BY question, part IN ('shown', 'promoted') ORDER BY score DESC, CASE WHEN part = 'shown' THEN 0 ELSE 1 END, was) END AS place
  FROM o
)
SELECT * FROM placed
UNION ALL
SELECT question, tbl, 'endorsed', NULL, NULL, status, NULL, NULL FROM told
WHERE status = 'approved' AND tbl >= 0 AND tbl % 2 = 0 AND NOT EXISTS (SELECT 1 FROM answer WHERE answer.question = told.question AND answer.tbl = told.tbl)""",
    "retain_newest": """
SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM {events}) WHERE r <= 5""",
    "retain_recent": """
SELECT event_id FROM {events} WHERE ts >= TIMESTAMP '2024-01-25 00:00:00'""",
    "upsert_newest": """
SELECT user_id, event_type, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM {events}) WHERE r = 1""",
    "join_labels": """
SELECT o.o_orderkey, coalesce(c.c_name, s.s_name, 'unknown') AS label FROM {orders} o LEFT JOIN {customer} c ON o.o_custkey = c.c_custkey AND c.c_nationkey < 15 LEFT JOIN {supplier} s ON o.o_custkey = s.s_suppkey""",
    "join_distinct_chain": """
SELECT DISTINCT r_name, c_mktsegment FROM {region} JOIN {nation} ON n_regionkey = r_regionkey JOIN {customer} ON c_nationkey = n_nationkey JOIN {orders} ON o_custkey = c_custkey""",
    "semi_join_askers": """
SELECT c_custkey, c_name FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""",
    "anti_join_unasked": """
SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""",
    "scalar_subquery": """
SELECT c_custkey, coalesce(n, 0) AS n FROM {customer} LEFT JOIN (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey) ON o_custkey = c_custkey""",
    "table_counts": """
SELECT r_name, n_name, count(c_custkey) AS n_columns FROM {region} JOIN {nation} ON n_regionkey = r_regionkey LEFT JOIN {customer} ON c_nationkey = n_nationkey GROUP BY r_name, n_name""",
    "mode_smallest_name": """
SELECT n_name, c_mktsegment AS mode FROM (
  SELECT n_name, c_mktsegment, row_number() OVER (PARTITION BY n_name ORDER BY count(*) DESC, c_mktsegment) AS r FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name, c_mktsegment) WHERE r = 1""",
    "mode_first_seen": """
SELECT n_name, c_mktsegment AS mode FROM (
  SELECT n_name, c_mktsegment, row_number() OVER (PARTITION BY n_name ORDER BY count(*) DESC, min(c_custkey)) AS r FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name, c_mktsegment) WHERE r = 1""",
    "union_accounts": """
SELECT c_custkey AS id, c_name AS name, 'customer' AS kind FROM {customer} UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM {supplier}""",
    "pool_union": """
SELECT o_custkey AS id FROM {orders} WHERE o_totalprice > 200000 UNION SELECT c_custkey FROM {customer} WHERE c_acctbal > 5000""",
    "change_feed": CHANGES + "SELECT * FROM changes",
    "change_counts": CHANGES + "SELECT kind, count(*) AS n FROM (SELECT DISTINCT kind, key, field FROM changes) GROUP BY kind",
    # A customer stands for a table of the dictionary, its orders for the columns.
    "removal_share": CHANGES + """
, held AS (SELECT o_orderkey AS key, o_custkey AS tbl FROM {orders}),
counted AS (SELECT tbl, count(*) AS n, count(CASE WHEN gone.key IS NOT NULL THEN 1 END) AS n_gone FROM prior JOIN held ON held.key = prior.key LEFT JOIN (SELECT key FROM changes WHERE kind = 'removed') gone ON gone.key = prior.key GROUP BY tbl)
SELECT round(greatest(tables, columns), 6) AS share, greatest(tables, columns) > 0.10 AS waits
FROM (SELECT coalesce(CAST(count(CASE WHEN n = n_gone THEN 1 END) AS DOUBLE) / nullif(count(*), 0), 0) AS tables, coalesce(CAST(sum(n_gone) AS DOUBLE) / nullif(sum(n), 0), 0) AS columns FROM counted)""",
    "has_changes": CHANGES + "SELECT coalesce(bool_or(kind <> 'kept'), false) AS has_changes FROM changes",
    "merged_dictionary": CHANGES + """
SELECT key, CASE WHEN is_gone THEN old_status ELSE new_status END AS status, CASE WHEN is_gone OR (NOT is_new AND old_priority <> '') THEN old_priority ELSE new_priority END AS priority,
       CASE WHEN is_new OR old_priority = '' THEN 'source' ELSE 'kept' END AS origin FROM merged WHERE NOT is_gone OR key % 5 = 0""",
    "call_estimate": """
SELECT n_name, CAST(ceil(count(CASE WHEN c_acctbal < 0 THEN 1 END) / 30.0) AS BIGINT) AS calls, count(CASE WHEN c_acctbal < 0 THEN 1 END) AS empty FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name""",
    "wilson_interval": """
SELECT kind, n, CASE WHEN n = 0 THEN CAST(0 AS DOUBLE) ELSE round(greatest(CAST(0 AS DOUBLE), centre - half), 6) END AS low, CASE WHEN n = 0 THEN CAST(0 AS DOUBLE) ELSE round(least(CAST(1 AS DOUBLE), centre + half), 6) END AS high
FROM (SELECT kind, rows AS n, (p + 1.9208 / n) / (1 + 3.8416 / n) AS centre, 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n) AS half
  FROM (SELECT kind, count(value) AS rows, nullif(count(value), 0) AS n, CAST(count(CASE WHEN value > cut THEN 1 END) AS DOUBLE) / nullif(CAST(count(value) AS DOUBLE), 0) AS p
    FROM (VALUES ('view', 50), ('click', 1000000), ('purchase', -1), ('never seen', 0)) AS kinds(kind, cut) LEFT JOIN {events} ON event_type = kind GROUP BY kind))""",
    "list_progress": """
SELECT conv_id, count(*) AS total, count(CASE WHEN length(text) > 60 THEN 1 END) AS done, round(avg(CASE WHEN length(text) > 60 THEN length(text) END), 6) AS mean,
       round(avg(CASE WHEN length(text) > 60 THEN length(text) END) * count(CASE WHEN length(text) <= 60 THEN 1 END), 6) AS eta FROM {conversations} GROUP BY conv_id""",
    "list_outcomes": """
SELECT count(CASE WHEN role = 'user' THEN 1 END) AS asked, count(CASE WHEN role = 'assistant' THEN 1 END) AS answered, count(CASE WHEN text IS NULL OR text = '' THEN 1 END) AS failed FROM {conversations}""",
    "trace_phases": """
SELECT conv_id, role, CAST(sum(length(text)) AS BIGINT) AS duration, count(*) AS steps, CAST(least(count(*), 500) AS BIGINT) AS stored, count(*) > 500 AS truncated FROM {conversations} GROUP BY conv_id, role""",
    "saved_answers": """
SELECT count(*) AS total, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS usable, max(o_orderdate) AS newest FROM {orders}""",
    "newest_by_two_keys": """
SELECT c.c_custkey, coalesce(a.id, b.id) AS answer, CASE WHEN a.id IS NOT NULL THEN 'text' WHEN b.id IS NOT NULL THEN 'meaning' ELSE 'none' END AS matched FROM {customer} c
LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS id FROM {orders} WHERE o_orderstatus = 'F' GROUP BY o_custkey) a ON a.o_custkey = c.c_custkey
LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS id FROM {orders} GROUP BY o_custkey) b ON b.o_custkey = c.c_custkey""",
    "votes_same_words_or_meaning": """
SELECT id, max(w) AS weight FROM (
  SELECT c_custkey AS id, 1.0 AS w FROM {customer} JOIN {supplier} ON c_custkey = s_suppkey UNION ALL SELECT c_custkey, 0.6 FROM {customer} WHERE EXISTS (SELECT 1 FROM {supplier} WHERE s_nationkey = c_nationkey)) GROUP BY id""",
    "validate_hits": """
SELECT l.quality, count(d.doc_id) AS valid, count(*) - count(d.doc_id) AS dropped FROM {labels} l LEFT JOIN (SELECT doc_id FROM {documents} WHERE lang = 'en') d ON d.doc_id = l.doc_id GROUP BY l.quality""",
    "call_log_filter": """
SELECT event_id, user_id FROM {events} WHERE event_type IN ('view', 'click') AND user_id = 7 AND lower(props) LIKE '%"k": 6%'""",
    "sync_change_filter": """
SELECT o_orderkey FROM {orders} WHERE o_orderstatus = 'F' AND (lower(o_orderpriority) LIKE '%urg%' OR lower(CAST(o_custkey AS «text»)) LIKE '%99%')""",
    "live_rows": """
SELECT o_orderkey, o_custkey FROM (SELECT *, o_orderkey % 7 = 0 AS is_deleted FROM {orders}) WHERE NOT is_deleted""",
    "users_search": """
SELECT c_custkey, c_name FROM {customer} WHERE lower(c_name) LIKE '%#00000001%' OR lower(c_mktsegment) LIKE '%mach%'""",
    "ignored_names": """
SELECT p_partkey, p_name FROM {part} WHERE lower(trim(p_type)) NOT IN ('economy', 'promo') AND lower(trim(p_name)) NOT LIKE 'red%' AND lower(trim(p_name)) NOT LIKE 'small%' AND lower(p_brand) NOT IN ('brand#3')""",
    "lists_with_owners": """
SELECT o_orderkey, coalesce(c_name, s_name) AS owner, n_name FROM {orders} LEFT JOIN {customer} ON o_custkey = c_custkey AND c_acctbal > 0 LEFT JOIN {supplier} ON o_custkey = s_suppkey JOIN {nation} ON n_nationkey = o_orderkey % 25""",
    "max_position": """
SELECT coalesce(max(turn), 0) AS last_position FROM {conversations}""",
    "verdict_counts": """
SELECT count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS found, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS partial, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS not_found,
       count(CASE WHEN o_totalprice < 50000 THEN 1 END) AS unanswered, count(CASE WHEN o_orderpriority = '5-LOW' THEN 1 END) AS failed, count(*) AS terms FROM {orders}""",
    "istanbul_midnights": """
SELECT DISTINCT CAST(«istanbul» AS DATE) AS day, «midnight» AS midnight_utc FROM {events}""",
    "timestamp_texts": """
SELECT event_id, «seconds_text» AS to_seconds, «minutes_text» AS to_minutes FROM {events}""",
    "percent_kpis": """
SELECT kind, CASE WHEN answered = 0 THEN '–' ELSE '%' || CAST(CAST(floor(100.0 * found / answered + 0.5) AS INT) AS «text») END AS share
FROM (SELECT kind, count(value) AS answered, count(CASE WHEN value > 50 THEN 1 END) AS found FROM (VALUES ('view'), ('click'), ('never seen')) AS kinds(kind) LEFT JOIN {events} ON event_type = kind GROUP BY kind)""",
    "merged_maps": """
SELECT o_orderkey, «map_text» AS kept FROM {orders}""",
    "code_point_order": """
SELECT n_name, row_number() OVER (ORDER BY n_name) AS plain, row_number() OVER (ORDER BY lower(n_name), n_name) AS folded FROM (SELECT CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS n_name FROM {nation})""",
    "best_described": """
SELECT p_brand, p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN described = '' THEN 1 ELSE 0 END, p_partkey) AS r FROM (SELECT *, CASE WHEN p_size > 25 THEN p_name ELSE '' END AS described FROM {part})) WHERE r = 1""",
    "corrections": """
SELECT user_id, event_type, CAST(min_by(value, event_id) AS DOUBLE) AS model_text, max_by(value, event_id) AS admin_text, count(*) AS n FROM {events} WHERE value IS NOT NULL GROUP BY user_id, event_type HAVING min_by(value, event_id) <> max_by(value, event_id)""",
    "dictionary_page": """
SELECT p_brand AS key, n AS columns, coalesce(grp, '') AS grp FROM (SELECT p_brand, count(*) AS n FROM {part} GROUP BY p_brand) LEFT JOIN (SELECT DISTINCT 'Brand#' || CAST(n_nationkey AS «text») AS b, n_name AS grp FROM {nation} WHERE n_nationkey % 2 = 0) ON b = p_brand ORDER BY key LIMIT 10 OFFSET 5""",
    "versions_list": """
SELECT v.o_orderkey AS version, v.o_orderdate AS imported_at, c.c_name AS imported_by, CASE WHEN v.o_orderstatus <> 'O' THEN v.o_orderdate + INTERVAL 30 DAY END AS expires_at, v.o_orderstatus = 'P' AS can_restore, run.l AS run
FROM {orders} v LEFT JOIN {customer} c ON c.c_custkey = v.o_custkey AND c.c_nationkey < 20 LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS l FROM {lineitem} WHERE l_linenumber = 1 GROUP BY l_orderkey) run ON run.l_orderkey = v.o_orderkey WHERE v.o_orderstatus IN ('O', 'P')""",
    "explorer_index": """
SELECT name, count(*) AS n_columns, «set» AS groups FROM (SELECT source AS name, lang AS x FROM {documents}) GROUP BY name""",
    "galaxy": """
SELECT n_name, coalesce(min(c_mktsegment), 'Diğer') AS first_group, count(c_custkey) AS n FROM {nation} LEFT JOIN {customer} ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY n_name""",
}

QUERIES = {name: spark_query(sql, SPARK) for name, sql in SQL.items()}
ORACLES = {name: plain(sql, DUCK) for name, sql in SQL.items()}

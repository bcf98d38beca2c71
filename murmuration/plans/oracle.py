"""The queries in DuckDB SQL, over the driver's views."""

from . import payload_queries, planning_queries, review_queries, rule_sql, signal_queries, summary_queries, view_queries

HISTORY = """h AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS account_id, o_orderpriority AS label_key, o_orderstatus = 'F' AS value,
 CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) % 1001 AS confidence_milli, 'reason-' || CAST(o_orderkey % 7 AS VARCHAR) AS reason,
 '1.' || CAST(o_orderkey % 3 AS VARCHAR) || '.0' AS rule_version, o_orderdate AS labeled_at FROM orders)"""
RANKED = HISTORY + """, rk AS (SELECT *, row_number() OVER (PARTITION BY account_id, label_key ORDER BY labeled_at DESC, id DESC) AS rn FROM h), l AS (SELECT * FROM rk WHERE rn = 1)"""
LAGGED = HISTORY + """, g AS (SELECT *, lag(value) OVER w AS was, lag(rule_version) OVER w AS was_version, lag(confidence_milli) OVER w AS was_milli, lag(reason) OVER w AS was_reason FROM h
 WINDOW w AS (PARTITION BY account_id, label_key ORDER BY labeled_at, id))"""
ACCOUNT = """a AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS screen_name, CAST(floor(abs(c_acctbal)) AS BIGINT) AS followers_count, CAST(floor(abs(c_acctbal)) AS BIGINT) % 997 AS following_count,
 c_acctbal > 0 AS is_blue_verified, CASE c_mktsegment WHEN 'BUILDING' THEN 'Business' WHEN 'MACHINERY' THEN 'Government' WHEN 'FURNITURE' THEN 'None' END AS verified_type FROM customer)"""
FOLLOW = """f AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS follower_id, CAST(l_partkey AS VARCHAR) AS followee_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
BLOCK = """b AS (SELECT CAST(l_suppkey AS VARCHAR) AS blocker_id, CAST(l_partkey AS VARCHAR) AS blocked_id, max(l_returnflag) AS flag, max(l_linestatus) AS status, CASE WHEN min(l_linenumber) = 1 THEN 'active' ELSE 'missing' END AS status_before, count(*) AS missing_before FROM lineitem GROUP BY 1, 2)"""
TWEET = """t AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS account_id, epoch_us(ts) AS at_us, event_type IN ('click', 'view', 'error') AS is_reply, event_type = 'view' AS is_retweet,
 event_type = 'purchase' AS is_promoted, json_extract_string(props, '$.k') AS in_reply_to FROM events)"""
RATIOS = TWEET + """, r AS (SELECT account_id, count(*) AS n, count(*) FILTER (is_reply) AS replies, count(*) FILTER (is_retweet) AS retweets, count(*) FILTER (NOT is_reply AND NOT is_retweet) AS originals, bool_or(is_promoted) AS promoted FROM t GROUP BY 1)"""
STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"

ORACLE_SQL = {
    "latest_labels": f"WITH {RANKED} SELECT account_id, label_key, id, value, confidence_milli, rule_version, {STAMP.format('labeled_at')} FROM l",
    "previous_labels": f"WITH {RANKED} SELECT account_id, label_key, id, value FROM rk WHERE rn = 2",
    "compacted_history": f"WITH {LAGGED} SELECT account_id, label_key, id, value, rule_version FROM g WHERE was IS NULL OR value IS DISTINCT FROM was OR rule_version IS DISTINCT FROM was_version",
    "label_changes": f"""WITH {LAGGED}, k AS (SELECT account_id, label_key, id, CASE WHEN was IS NULL THEN CASE WHEN value THEN 'added' END WHEN value AND NOT was THEN 'added' WHEN NOT value AND was THEN 'removed'
 WHEN confidence_milli <> was_milli OR reason <> was_reason THEN 'updated' END AS change_type FROM g) SELECT * FROM k WHERE change_type IS NOT NULL""",
    "label_snapshot": f"""WITH {RANKED}, s AS (SELECT label_key, count(*) AS e, count(*) FILTER (value) AS t, count(*) FILTER (NOT value) AS f, CAST(sum(confidence_milli) FILTER (value) AS BIGINT) AS mt,
 CAST(sum(confidence_milli) FILTER (NOT value) AS BIGINT) AS mf FROM l GROUP BY 1), p AS (SELECT count(*) AS n FROM customer)
 SELECT label_key, e AS evaluated_count, t AS true_count, round(t / e, 6) AS prevalence, round(e / n, 6) AS coverage, greatest(n - e, 0) AS unknown_count,
 round(CASE WHEN t > 0 THEN mt / 1000.0 / t ELSE 0.0 END, 6) AS avg_confidence_true, round(CASE WHEN f > 0 THEN mf / 1000.0 / f ELSE 0.0 END, 6) AS avg_confidence_false FROM s, p""",
    "label_distributions": f"""WITH {RANKED}, x AS (SELECT label_key, confidence_milli, 'value' AS part, CAST(value AS VARCHAR) AS bucket FROM l UNION ALL SELECT label_key, confidence_milli, 'decile', CAST(CAST(least(floor(confidence_milli / 1000.0 * 10), 9) AS INTEGER) AS VARCHAR) FROM l
 UNION ALL SELECT label_key, confidence_milli, 'version', rule_version FROM l UNION ALL SELECT label_key, confidence_milli, 'reason', reason FROM l WHERE value)
 SELECT label_key, part, bucket, count(*) AS n, CAST(sum(confidence_milli) AS BIGINT) AS confidence_milli FROM x GROUP BY ALL""",
    "confidence_diagnostics": f"""WITH {RANKED} SELECT label_key, CAST(round(least(floor(CAST(confidence_milli AS DOUBLE) / 1000 / CAST(0.1 AS DOUBLE)) * CAST(0.1 AS DOUBLE), CAST(0.9 AS DOUBLE)) * 10) AS INTEGER) AS bucket, count(*) AS n, count(*) FILTER (value) AS n_true FROM l GROUP BY 1, 2""",
    "label_freshness": f"""WITH {RANKED}, x AS (SELECT label_key, epoch(TIMESTAMP '2001-08-02 00:00:00') - epoch(labeled_at) AS age FROM l)
 SELECT label_key, count(*) FILTER (age <= 31536000) AS current_count, count(*) FILTER (age > 31536000 AND age <= 86400000) AS delayed_count, count(*) FILTER (age > 86400000) AS stale_count FROM x GROUP BY 1""",
    "account_summary": f"""WITH {RANKED}, x AS (SELECT account_id, coalesce(string_agg(label_key, ',' ORDER BY label_key) FILTER (value), '') AS active_label_keys, count(*) FILTER (value) AS active_label_count, count(*) AS evaluated_label_count, max(labeled_at) AS last_labeled_at FROM l GROUP BY 1)
 SELECT account_id, active_label_keys, active_label_count, evaluated_label_count, {STAMP.format("last_labeled_at")} FROM x""",
    "stale_accounts": f"""WITH {RANKED}, cur(label_key, rule_version) AS (VALUES ('1-URGENT', '1.1.0'), ('2-HIGH', '1.2.0'), ('3-MEDIUM', '1.1.0')), x AS (SELECT account_id, count(*) AS fresh FROM l JOIN cur USING (label_key, rule_version) GROUP BY 1)
 SELECT CAST(c_custkey AS VARCHAR) AS account_id, coalesce(fresh, 0) AS fresh FROM customer LEFT JOIN x ON x.account_id = CAST(c_custkey AS VARCHAR) WHERE coalesce(fresh, 0) < 3""",
    "review_sample": f"""WITH {RANKED}, x AS (SELECT label_key, value, account_id, CAST(row_number() OVER (PARTITION BY label_key, value ORDER BY md5(account_id || ':' || label_key || ':seed-7'), account_id) AS INTEGER) AS n FROM l) SELECT * FROM x WHERE n <= 5""",
    "count_drops": f"""WITH {HISTORY}, m AS (SELECT label_key, strftime(labeled_at, '%Y-%m') AS month, count(*) AS evaluated, count(*) FILTER (value) AS true_count FROM h GROUP BY 1, 2), x AS (SELECT *, lag(true_count) OVER w AS baseline, lag(evaluated) OVER w AS was FROM m WINDOW w AS (PARTITION BY label_key ORDER BY month)),
 y AS (SELECT *, evaluated < 5 OR was < 5 AS missing, CASE WHEN baseline = 0 THEN 0.0 ELSE (baseline - true_count) / baseline END AS dropped FROM x WHERE was IS NOT NULL)
 SELECT label_key, month, true_count, baseline, missing, round(dropped, 6) AS "drop", NOT missing AND dropped >= 0.2::DOUBLE AS exceeded FROM y""",
    "follow_signals": f"""WITH {RANKED}, {FOLLOW}, e AS (SELECT f.follower_id AS account_id, l.label_key, count(*) AS t, count(*) FILTER (l.value) AS n FROM f JOIN l ON l.account_id = f.followee_id GROUP BY 1, 2),
 r AS (SELECT f.followee_id AS account_id, l.label_key, count(*) AS t, count(*) FILTER (l.value) AS n FROM f JOIN l ON l.account_id = f.follower_id GROUP BY 1, 2)
 SELECT coalesce(e.account_id, r.account_id) AS account_id, coalesce(e.label_key, r.label_key) AS label_key, coalesce(e.t, 0) AS followee_total, coalesce(e.n, 0) AS followee_labeled, coalesce(r.t, 0) AS follower_total, coalesce(r.n, 0) AS follower_labeled
 FROM e FULL OUTER JOIN r ON e.account_id = r.account_id AND e.label_key = r.label_key""",
    "block_candidates": f"""WITH {RANKED}, {FOLLOW}, {BLOCK}, x AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY confidence_milli DESC, label_key) AS k FROM l WHERE value AND rule_version = '1.1.0' AND confidence_milli >= 300)
 SELECT account_id, label_key, confidence_milli FROM x WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM f WHERE f.follower_id = '7' AND f.followee_id = x.account_id) AND NOT EXISTS (SELECT 1 FROM f WHERE f.followee_id = '7' AND f.follower_id = x.account_id)
 AND NOT EXISTS (SELECT 1 FROM b WHERE b.blocker_id = '7' AND b.blocked_id = x.account_id) ORDER BY confidence_milli DESC, account_id LIMIT 50""",
    "block_reconciliation": f"""WITH {BLOCK} SELECT blocker_id, blocked_id, CASE WHEN flag = 'N' THEN 'active' WHEN status <> 'O' THEN status_before WHEN missing_before + 1 >= 3 THEN 'resolved' ELSE 'missing' END AS status,
 CASE WHEN flag = 'N' THEN 0 WHEN status <> 'O' THEN missing_before ELSE missing_before + 1 END AS missing_count FROM b""",
    "recent_tweets": f"WITH {TWEET}, x AS (SELECT account_id, id, CAST(row_number() OVER (PARTITION BY account_id ORDER BY at_us DESC, id DESC) AS INTEGER) AS n FROM t) SELECT * FROM x WHERE n <= 20",
    "behaviour_ratios": f"WITH {RATIOS} SELECT *, round(replies / n, 6) AS replies_ratio, round(retweets / n, 6) AS retweets_ratio, round(originals / n, 6) AS originals_ratio FROM r",
    "posting_gaps": f"""WITH {TWEET}, g AS (SELECT account_id, at_us // 1000 - lag(at_us // 1000) OVER (PARTITION BY account_id ORDER BY at_us, id) AS ms FROM t)
 SELECT account_id, count(*) AS gaps, round(CASE WHEN avg(ms) = 0 THEN 0.0 ELSE stddev_pop(ms) / avg(ms) END, 6) AS variation FROM g WHERE ms IS NOT NULL GROUP BY 1""",
    "sliding_targets": f"""WITH {TWEET}, p AS (SELECT account_id, at_us, in_reply_to FROM t WHERE is_reply AND in_reply_to IS NOT NULL),
 x AS (SELECT a.account_id, a.at_us, count(DISTINCT c.in_reply_to) AS targets, count(*) AS replies, max(c.at_us) - a.at_us AS span_us FROM p a JOIN p c ON c.account_id = a.account_id AND c.at_us BETWEEN a.at_us AND a.at_us + 86400000000 GROUP BY a.account_id, a.at_us),
 y AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY targets DESC, replies DESC, span_us) AS k FROM x) SELECT account_id, targets, replies, span_us FROM y WHERE k = 1""",
    "retweet_rule": f"""WITH {RATIOS}, x AS (SELECT account_id, n >= 5 AND retweets / n >= 0.2::DOUBLE AS value, n >= 5 AS evaluable, least(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + (n - 5) * 0.5::DOUBLE / 5)), greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + (retweets / n - 0.2::DOUBLE) * 0.5::DOUBLE / 0.2::DOUBLE))) AS s FROM r)
 SELECT account_id, 'retweet_heavy' AS label_key, value, round(CASE WHEN NOT evaluable THEN 0.5 WHEN value THEN s ELSE 1 - s END, 9) AS confidence, evaluable FROM x""",
    "profile_rules": f"""WITH {ACCOUNT}, v AS (SELECT id AS account_id, 'verified_blue_individual' AS label_key, is_blue_verified AND coalesce(verified_type = 'None', true) AS value, 1.0::DOUBLE AS confidence FROM a
 UNION ALL SELECT id, 'verified_business', coalesce(verified_type = 'Business', false), 1.0 FROM a UNION ALL SELECT id, 'verified_government', coalesce(verified_type = 'Government', false), 1.0 FROM a
 UNION ALL SELECT id, 'verified_blue_creator', is_blue_verified AND coalesce(verified_type = 'None', true) AND CAST(id AS BIGINT) % 2 = 0, 1.0 FROM a UNION ALL SELECT id, 'verified_blue_professional_business', is_blue_verified AND coalesce(verified_type = 'None', true) AND CAST(id AS BIGINT) % 2 <> 0 AND CAST(id AS BIGINT) % 3 = 0, 1.0 FROM a
 UNION ALL SELECT id, 'parody_account', CAST(id AS BIGINT) % 7 = 0, 1.0 FROM a UNION ALL SELECT id, 'commentary_account', CAST(id AS BIGINT) % 7 = 1, 1.0 FROM a UNION ALL SELECT id, 'fan_account', CAST(id AS BIGINT) % 7 = 2, 1.0 FROM a), r AS (SELECT *, 'isBlueVerified=' || is_blue_verified AS b, 'verifiedType=' || coalesce(verified_type, 'null') AS t, 'professionalType=' || CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 'Creator' WHEN CAST(id AS BIGINT) % 3 = 0 THEN 'Business' ELSE 'null' END AS w,
  'parodyCommentaryFanLabel=' || CASE CAST(id AS BIGINT) % 7 WHEN 0 THEN 'Parody' WHEN 1 THEN 'Commentary' WHEN 2 THEN 'Fan' ELSE 'null' END AS l FROM a)
 SELECT v.*, '1.0.0' AS rule_version, true AS evaluable, 'API reported ' || CASE WHEN label_key = 'verified_blue_individual' THEN b || ', ' || t WHEN starts_with(label_key, 'verified_blue') THEN b || ', ' || t || ', ' || w WHEN starts_with(label_key, 'verified') THEN t ELSE l END AS reason FROM v JOIN r ON r.id = account_id""",
    "url_hosts": "WITH x AS (SELECT lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host FROM pages) SELECT host, regexp_matches(host, '(^|\\.)example\\.(com|net)$') AS known, count(*) AS pages FROM x GROUP BY 1, 2",
    "account_page": f"WITH {ACCOUNT} SELECT id, screen_name, followers_count FROM a WHERE followers_count < 5000 OR followers_count = 5000 AND id > '0' ORDER BY followers_count DESC, id LIMIT 26",
    "account_search": f"WITH {ACCOUNT}, x AS (SELECT id, screen_name, CASE WHEN id = '12' THEN 0 WHEN starts_with(screen_name, '12') THEN 1 WHEN contains(lower(screen_name), '12') THEN 2 END AS priority FROM a) SELECT * FROM x WHERE priority IS NOT NULL ORDER BY priority, id LIMIT 5",
    "calibration": """WITH x AS (SELECT quality = 1 AS classifier_value, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS w, CAST(sum(n_chars * n_chars) AS BIGINT) AS w2, CAST(sum(CASE WHEN (quality = 1) = (toxic = 0) THEN n_chars ELSE 0 END) AS BIGINT) AS r FROM labels JOIN documents USING (doc_id) GROUP BY 1)
 SELECT classifier_value, n, round(CAST(w AS DOUBLE) * w / w2, 4) AS n_eff, CASE WHEN CAST(w AS DOUBLE) * w / w2 >= 20 THEN round(r / w, 6) END AS correctness FROM x""",
    "severity_ranks": """WITH x AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' ELSE 'other' END AS severity FROM orders)
 SELECT severity, count(*) AS n, CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 WHEN 'low' THEN 0 ELSE -1 END AS rank FROM x GROUP BY 1""",
    "bigram_similarity": """WITH t AS (SELECT item_id, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'https?://\\S+', '', 'g'), '@\\w+', '', 'g'), '\\s+', ' ', 'g'), '^ | $', '', 'g')) AS x FROM benchmark),
 g AS (SELECT DISTINCT item_id, substring(x, CAST(i AS INTEGER), 2) AS b FROM t, range(1, greatest(length(x), 2)) r(i)),
 n AS (SELECT item_id, count(*) AS n FROM g GROUP BY 1), k AS (SELECT a.item_id, count(*) AS m FROM g a JOIN g c ON c.item_id = a.item_id + 1 AND c.b = a.b GROUP BY 1)
 SELECT a.item_id, a.n AS n_a, c.n AS n_b, round(coalesce(m, 0) / (a.n + c.n - coalesce(m, 0)), 6) AS similarity FROM n a JOIN n c ON c.item_id = a.item_id + 1 LEFT JOIN k ON k.item_id = a.item_id""",
}

ORACLE_SQL["reply_posterior"] = f"WITH {RATIOS} SELECT account_id, n, replies, round({rule_sql.posterior('replies', 'n', '0.5')}, 9) AS posterior FROM r"
_signals = ORACLE_SQL["follow_signals"]
ORACLE_SQL |= rule_sql.queries(HISTORY, RANKED, FOLLOW, f"WITH {_signals[_signals.index('e AS (SELECT f.follower_id'):]}")
ORACLE_SQL |= review_queries.sql(HISTORY, LAGGED, ACCOUNT, FOLLOW, ORACLE_SQL["count_drops"])
ORACLE_SQL |= signal_queries.ORACLE_SQL | summary_queries.ORACLE_SQL
ORACLE_SQL |= planning_queries.sql(ORACLE_SQL["count_drops"])
ORACLE_SQL |= payload_queries.ORACLE_SQL
ORACLE_SQL |= view_queries.ORACLE_SQL

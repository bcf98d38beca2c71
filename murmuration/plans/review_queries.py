"""Queries of the review operators over whole driver tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph, history, review
from ..sources import adapters

BEGIN, END = "1995-01-01 00:00:00", "1996-12-31 00:00:00"
STATUS = ("low", "medium", "high", "critical")


def _rounded(df, **places):
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


def rolling_calibration(spark, d):
    """Orders as judgments, months as runs; the rule's version changes with the year."""
    h = adapters.label_history(spark, d)
    number = F.col("id").cast("long")
    judged = h.select(
        "label_key", "value", F.date_format("labeled_at", "yyyy-MM").alias("run"), number.alias("seq"), F.date_format("labeled_at", "yyyy").alias("rule_version"),
        "confidence_milli", (number % 3 != 0).alias("correct"), (F.col("account_id").cast("long") % 5 + 1).alias("weight"),
    )
    return _rounded(review.rolling_calibration(judged), n_eff=4, correctness=6, brier=6)


def label_risk(spark, d):
    """Risk and completeness of each label, from the rows of two years and its latest rows."""
    h = adapters.label_history(spark, d)
    year = F.year("labeled_at")
    share = lambda y: F.count_if((year == y) & F.col("value")) / F.count_if(year == y)
    people = adapters.account(spark, d).agg(F.count("*").alias("people"))
    by = h.groupBy("label_key").agg(
        F.count_if(F.col("id").cast("long") % 1000 == 1).alias("findings"), F.count_if(year == 1998).alias("recent"), share(1997).alias("now"), share(1996).alias("before"),
        F.count_distinct("account_id").alias("evaluated"), (F.count_if(year < 1993) / F.count("*")).alias("stale"),
    )
    by = by.join(F.broadcast(people)).withColumn("coverage", F.col("evaluated") / F.col("people")).withColumn("shift", review.relative_delta(F.col("now"), F.col("before")))
    score = review.risk_score(F.col("findings"), F.col("recent"), F.col("shift"), F.col("coverage"), F.col("stale"))
    return by.select(
        "label_key", F.round("shift", 6).alias("shift"), score.alias("risk"), review.completeness(F.col("coverage"), F.col("stale"), 0.3, 0.1).alias("completeness"),
        F.round(review.smoothed_rate(F.col("findings"), F.col("recent") + F.col("findings")), 6).alias("finding_rate"),
    )


def account_freshness(spark, d):
    """Accounts by the freshness of their latest label; unknown without any."""
    last = adapters.label_history(spark, d).groupBy("account_id").agg(F.max("labeled_at").alias("last"))
    rows = adapters.account(spark, d).select(F.col("id").alias("account_id")).join(last, "account_id", "left")
    age = F.unix_seconds(F.lit("1998-08-02").cast("timestamp")) - F.unix_seconds(F.col("last").cast("timestamp"))
    return rows.select(review.freshness_status(age, 90 * 86400, 365 * 86400).alias("status")).groupBy("status").agg(F.count("*").alias("accounts"))


def confidence_buckets(spark, d):
    """All rows by label and bucket of their confidence, by the bucket's name."""
    bucket = F.least(F.floor(F.col("confidence_milli") / 100), F.lit(9))
    return adapters.label_history(spark, d).groupBy("label_key", review.bucket_key(bucket).alias("bucket")).agg(F.count("*").alias("n"))


def review_order(spark, d):
    """By label the first five rows in the order of a seeded rank."""
    rows = adapters.label_history(spark, d).select("label_key", "id", review.stable_rank("seed-7", F.col("id")).alias("stable"))
    return review.top_per_key(rows, ("label_key",), [F.col("stable"), F.col("id")], 5)


def common_words_removed(spark, d):
    """Turns of conversations without the words that most turns of their conversation have."""
    rows = adapters.table(spark, d, "conversations").select(F.col("conv_id").alias("grp"), F.col("turn").alias("id"), text.normalize_for_similarity(F.coalesce("text", F.lit(""))).alias("text"))
    return review.without_common_words(rows).select("grp", "id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def exceeded_runs(spark, d):
    return review.exceeded_in_a_row(history.count_drops(history.monthly(adapters.label_history(spark, d)), 5, 0.2))


def active_counts(spark, d):
    return review.active_counts(adapters.label_history(spark, d))


def freshness_buckets(spark, d):
    return review.freshness_buckets(adapters.label_history(spark, d), F.lit("1998-08-02 00:00:00").cast("timestamp_ntz"))


def top_engagement(spark, d):
    """Each account's thirty posts with most engagement; of equal ones the first."""
    rows = adapters.post(spark, d).select("account_id", F.col("id").cast("long").alias("id")).withColumn("engagement", F.col("id") % 97 + F.col("id") % 13)
    return review.top_per_key(rows, ("account_id",), [F.desc("engagement"), F.col("id")], 30)


def newest_two(spark, d):
    return review.top_per_key(adapters.label_history(spark, d).select("label_key", "id", "labeled_at"), ("label_key",), [F.desc("labeled_at"), F.desc("id")], 2).select("label_key", "id", "rank")


def dominant_reasons(spark, d):
    return review.dominant(adapters.label_history(spark, d), "label_key", "reason")


def newest_changes(spark, d):
    return review.newest_changes(adapters.label_history(spark, d), BEGIN, END)


def worst_status(spark, d):
    """Each account's worst priority, as a status."""
    key = F.col("label_key")
    named = F.when(key == "1-URGENT", "critical").when(key == "2-HIGH", "high").when(key == "3-MEDIUM", "medium").when(key == "5-LOW", "low").otherwise("none")
    return review.worst(adapters.label_history(spark, d).select("account_id", named.alias("status")), "account_id", "status", STATUS)


def missing_accounts(spark, d):
    """Accounts that are followed and have no profile, or have one and no edge."""
    edges, own = adapters.follow(spark, d), adapters.account(spark, d).select("id")
    ends = edges.select(F.col("followee_id").alias("id")).unionByName(edges.select(F.col("follower_id").alias("id"))).distinct()
    return ends.join(own, "id", "left_anti").withColumn("state", F.lit("no profile")).unionByName(own.join(ends, "id", "left_anti").withColumn("state", F.lit("no edge")))


def account_offset_page(spark, d):
    """The third page of twenty accounts by followers, with the number of all."""
    rows = adapters.account(spark, d).select("id", "screen_name", "followers_count")
    page = rows.orderBy(F.desc("followers_count"), "id").offset(40).limit(20)
    return page.join(F.broadcast(rows.agg(F.count("*").alias("total"))))


def mutual_follows(spark, d):
    """Labelled accounts by how many of their edges go both ways."""
    edges = graph.edge_sync(adapters.follow(spark, d).select(F.col("follower_id").alias("src"), F.col("followee_id").alias("dst")), adapters.follow(spark, d).select(F.col("followee_id").alias("src"), F.col("follower_id").alias("dst")))
    both = edges.where("state = 'kept'").groupBy(F.col("src").alias("account_id")).agg(F.count("*").alias("mutual"))
    labelled = adapters.label_history(spark, d).where("value").select("account_id")
    return both.join(labelled, "account_id", "left_semi")


QUERIES = {f.__name__: f for f in (
    rolling_calibration, label_risk, account_freshness, confidence_buckets, review_order, common_words_removed, exceeded_runs, active_counts, freshness_buckets, top_engagement,
    newest_two, dominant_reasons, newest_changes, worst_status, missing_accounts, account_offset_page, mutual_follows,
)}


def sql(history: str, lagged: str, account: str, follow: str, count_drops: str) -> dict[str, str]:
    """The queries in SQL, over the definitions that the others use."""
    bin_of = "CAST(round(least(floor(CAST(confidence_milli AS DOUBLE) / 1000 / CAST(0.1 AS DOUBLE)) * CAST(0.1 AS DOUBLE), CAST(0.9 AS DOUBLE)) * 10) AS INTEGER)"
    return {
        "rolling_calibration": f"""WITH {history}, j AS (SELECT label_key, value, strftime(labeled_at, '%Y-%m') AS run, CAST(id AS BIGINT) AS seq, strftime(labeled_at, '%Y') AS rule_version, {bin_of} AS bin,
 confidence_milli - CASE WHEN CAST(id AS BIGINT) % 3 <> 0 THEN 1000 ELSE 0 END AS miss, CAST(id AS BIGINT) % 3 <> 0 AS correct, CAST(account_id AS BIGINT) % 5 + 1 AS w FROM h),
 s AS (SELECT DISTINCT label_key, value, run, rule_version FROM j),
 b AS (SELECT s.label_key, s.value, s.run, s.rule_version, j.bin, count(*) AS n, CAST(sum(w) AS BIGINT) AS w, CAST(sum(w * w) AS BIGINT) AS w2, CAST(coalesce(sum(w) FILTER (correct), 0) AS BIGINT) AS r, CAST(sum(w * miss * miss) AS BIGINT) AS m
 FROM s JOIN j ON j.label_key = s.label_key AND j.value = s.value AND j.rule_version = s.rule_version AND j.run <= s.run GROUP BY ALL)
 SELECT label_key, value, run, rule_version, bin, n, round(CAST(w AS DOUBLE) * w / w2, 4) AS n_eff, CASE WHEN CAST(w AS DOUBLE) * w / w2 >= 20 THEN round(r / w, 6) END AS correctness, CASE WHEN CAST(w AS DOUBLE) * w / w2 >= 20 THEN round(m / 1e6 / w, 6) END AS brier FROM b""",
        "label_risk": f"""WITH {history}, x AS (SELECT label_key, count(*) FILTER (CAST(id AS BIGINT) % 1000 = 1) AS findings, count(*) FILTER (year(labeled_at) = 1998) AS recent,
 count(*) FILTER (year(labeled_at) = 1997 AND value) / count(*) FILTER (year(labeled_at) = 1997) AS p, count(*) FILTER (year(labeled_at) = 1996 AND value) / count(*) FILTER (year(labeled_at) = 1996) AS q,
 count(DISTINCT account_id) / (SELECT count(*) FROM customer) AS coverage, count(*) FILTER (year(labeled_at) < 1993) / count(*) AS stale FROM h GROUP BY 1),
 y AS (SELECT *, CASE WHEN q = 0 THEN CASE WHEN p = 0 THEN 0.0 ELSE 1.0 END ELSE abs(p - q) / abs(q) END AS shift FROM x)
 SELECT label_key, round(shift, 6) AS shift, round(1 + least(4, findings * 2) + CASE WHEN recent > 0 THEN least(3.0::DOUBLE, log2(recent + 1)) ELSE 0 END + CASE WHEN shift >= 0.3 THEN 3 WHEN shift >= 0.1 THEN 1 ELSE 0 END
 + CASE WHEN coverage < 0.8 THEN 2 ELSE 0 END + CASE WHEN stale > 0.1 THEN 2 ELSE 0 END, 3) AS risk, CASE WHEN coverage < 0.3 THEN 'unknown' WHEN stale > 0.1 THEN 'partial' ELSE 'complete' END AS completeness,
 round((findings + 1) / (recent + findings + 2), 6) AS finding_rate FROM y""",
        "account_freshness": f"""WITH {history}, x AS (SELECT c_custkey, epoch(TIMESTAMP '1998-08-02') - epoch(max(labeled_at)) AS age FROM customer LEFT JOIN h ON account_id = CAST(c_custkey AS VARCHAR) GROUP BY 1)
 SELECT CASE WHEN age IS NULL THEN 'unknown' WHEN age >= 31536000 THEN 'stale' WHEN age >= 7776000 THEN 'delayed' ELSE 'current' END AS status, count(*) AS accounts FROM x GROUP BY 1""",
        "confidence_buckets": f"""WITH {history}, x AS (SELECT label_key, least(confidence_milli // 100, 9) AS b FROM h) SELECT label_key, printf('%.1f-%.1f', b / 10, (b + 1) / 10) AS bucket, count(*) AS n FROM x GROUP BY 1, 2""",
        "review_order": f"""WITH {history}, x AS (SELECT label_key, id, sha256('seed-7' || chr(0) || id) AS stable FROM h), y AS (SELECT *, CAST(row_number() OVER (PARTITION BY label_key ORDER BY stable, id) AS INTEGER) AS rank FROM x) SELECT * FROM y WHERE rank <= 5""",
        "common_words_removed": """WITH t AS (SELECT conv_id AS grp, turn AS id, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), 'https?://\\S+', '', 'g'), '@\\w+', '', 'g'), '\\s+', ' ', 'g'), '^ | $', '', 'g')) AS x FROM conversations),
 w AS (SELECT grp, id, unnest(string_split(x, ' ')) AS word, generate_subscripts(string_split(x, ' '), 1) AS pos FROM t), z AS (SELECT grp, count(*) AS size FROM t GROUP BY 1 HAVING count(*) > 1),
 c AS (SELECT grp, word FROM (SELECT grp, word, count(DISTINCT id) AS n FROM w WHERE length(word) >= 2 GROUP BY 1, 2) JOIN z USING (grp) WHERE n >= ceil(size * 0.6::DOUBLE)),
 k AS (SELECT grp, id, string_agg(word, ' ' ORDER BY pos) AS kept FROM w ANTI JOIN c USING (grp, word) WHERE word <> '' GROUP BY 1, 2)
 SELECT grp, id, md5(coalesce(kept, x)) AS text_md5 FROM t LEFT JOIN k USING (grp, id)""",
        "exceeded_runs": f"""WITH o AS ({count_drops}), n AS (SELECT label_key, max(month) FILTER (NOT exceeded) AS normal FROM o WHERE NOT missing GROUP BY 1)
 SELECT label_key, count(*) FILTER (normal IS NULL OR month > normal) AS run FROM o JOIN n USING (label_key) WHERE NOT missing GROUP BY 1""",
        "active_counts": f"""WITH {history}, l AS (SELECT *, row_number() OVER (PARTITION BY account_id, label_key ORDER BY labeled_at DESC, id DESC) AS k FROM h), c AS (SELECT label_key, count(*) FILTER (value) AS active FROM l WHERE k = 1 GROUP BY 1) SELECT * FROM c""",
        "freshness_buckets": f"""WITH {history} SELECT label_key, CASE WHEN date_trunc('minute', labeled_at) < TIMESTAMP '1998-08-02' - INTERVAL 7 DAY THEN '1970-01-01 00:00' ELSE strftime(labeled_at, '%Y-%m-%d %H:%M') END AS bucket, count(*) AS n FROM h GROUP BY 1, 2""",
        "top_engagement": """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS account_id, event_id AS id, event_id % 97 + event_id % 13 AS engagement FROM events), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY account_id ORDER BY engagement DESC, id) AS INTEGER) AS rank FROM e) SELECT * FROM r WHERE rank <= 30""",
        "newest_two": f"""WITH {history}, r AS (SELECT label_key, id, CAST(row_number() OVER (PARTITION BY label_key ORDER BY labeled_at DESC, id DESC) AS INTEGER) AS rank FROM h) SELECT * FROM r WHERE rank <= 2""",
        "dominant_reasons": f"""WITH {history}, c AS (SELECT label_key, reason, count(*) AS n FROM h GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY label_key ORDER BY n DESC, reason) AS k FROM c)
 SELECT label_key, count(*) AS kinds, CAST(sum(n) AS BIGINT) AS rows, max(reason) FILTER (k = 1) AS dominant FROM r GROUP BY 1""",
        "newest_changes": f"""WITH {lagged}, k AS (SELECT account_id, label_key, id, labeled_at, CASE WHEN was IS NULL THEN CASE WHEN value THEN 'added' END WHEN value AND NOT was THEN 'added' WHEN NOT value AND was THEN 'removed'
 WHEN confidence_milli <> was_milli OR reason <> was_reason THEN 'updated' END AS change_type FROM g), w AS (SELECT * FROM k WHERE change_type IS NOT NULL AND labeled_at BETWEEN TIMESTAMP '{BEGIN}' AND TIMESTAMP '{END}')
 SELECT account_id, label_key, id, change_type FROM w WHERE NOT EXISTS (SELECT 1 FROM w v WHERE v.account_id = w.account_id AND v.label_key = w.label_key AND (v.labeled_at > w.labeled_at OR v.labeled_at = w.labeled_at AND v.id > w.id))""",
        "worst_status": """SELECT CAST(o_custkey AS VARCHAR) AS account_id, CASE min(CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '5-LOW' THEN 4 ELSE 5 END)
 WHEN 1 THEN 'critical' WHEN 2 THEN 'high' WHEN 3 THEN 'medium' WHEN 4 THEN 'low' ELSE 'unknown' END AS status FROM orders GROUP BY 1""",
        "missing_accounts": f"""WITH {follow}, e AS (SELECT followee_id AS id FROM f UNION SELECT follower_id FROM f), a AS (SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer)
 SELECT id, 'no profile' AS state FROM (SELECT id FROM e EXCEPT SELECT id FROM a) UNION ALL SELECT id, 'no edge' FROM (SELECT id FROM a EXCEPT SELECT id FROM e)""",
        "account_offset_page": f"WITH {account} SELECT id, screen_name, followers_count, (SELECT count(*) FROM a) AS total FROM a ORDER BY followers_count DESC, id LIMIT 20 OFFSET 40",
        "mutual_follows": f"""WITH {follow} SELECT x.follower_id AS account_id, count(*) AS mutual FROM f x JOIN f y ON y.follower_id = x.followee_id AND y.followee_id = x.follower_id
 WHERE x.follower_id IN (SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'F') GROUP BY 1""",
    }

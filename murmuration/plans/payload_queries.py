"""Queries of raw payloads and of the merges into stored posts, accounts and labels; the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import upserts
from ..sources import adapters, payloads, signals
from .nullable import shown, shown_sql

VIEWER = "3"


def raw_accounts(spark, d):
    return payloads.accounts(signals.raw_users(spark, d))


def raw_posts(spark, d):
    rows = payloads.posts(signals.raw_posts(spark, d), "following", VIEWER)
    return rows.withColumn("expanded_urls", F.array_join("expanded_urls", " "))


def rejected_payloads(spark, d):
    bad = payloads.rejected(signals.raw_users(spark, d), payloads.USER).withColumn("kind", F.lit("user")).unionByName(payloads.rejected(signals.raw_posts(spark, d), payloads.POST).withColumn("kind", F.lit("post")))
    return bad.groupBy("kind", "problem").agg(F.count("*").alias("n"))


def monotone_merge(spark, d):
    """Order lines by part as sightings of a post: of those with the first line number the newest is what is stored, the others are what comes in."""
    line, q = F.col("l_linenumber"), F.col("l_quantity").cast("long")
    rows = adapters.table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("id"), (F.col("l_orderkey") * 10 + line).alias("seq"), line.alias("line"), q.alias("likes"), F.when(line != 5, F.col("l_returnflag") == "R").alias("flagged"), F.when(line != 3, F.array("l_linestatus", "l_returnflag")).alias("tags"),
        F.when(line % 2 == 0, F.col("l_returnflag")).alias("media"), F.when(line % 3 == 0, q % 4).alias("videos"), F.col("l_linestatus").alias("source"),
    )
    columns = ("likes", "flagged", "tags", "media", "videos", "source")
    stored = rows.where("line = 1").groupBy("id").agg(F.max_by(F.struct(*columns), "seq").alias("r")).select("id", "r.*")
    merged = upserts.monotone(stored, rows.where("line > 1"), "id", "seq", ("likes",), ("flagged",), ("tags",), ("media",), ("videos",), ("source",))
    return merged.withColumn("tags", F.array_join(F.array_sort("tags"), ","))


def account_upsert(spark, d):
    """Customers as what is stored, orders as profiles that come in: the last one of each account stands, but for when it was first seen."""
    n, o = F.col("c_custkey"), F.col("o_orderkey")
    stored = adapters.table(spark, d, "customer").where(n % 5 != 0).select(n.cast("string").alias("id"), F.concat(F.lit("b"), (n % 3).cast("string")).alias("bio"), (n % 2).alias("followers"), n.alias("first_seen"), F.lit("old").alias("image"))
    new = adapters.table(spark, d, "orders").where(F.col("o_custkey") % 7 != 0).select(F.col("o_custkey").cast("string").alias("id"), F.when(o % 4 != 0, F.concat(F.lit("b"), (o % 3).cast("string"))).alias("bio"), (o % 2).alias("followers"), (o + 1_000_000).alias("first_seen"), F.lit("new").alias("image"), o.alias("seq"))
    return upserts.replaced(stored, new, "id", "seq", ("first_seen",), ("bio", "followers"))


def label_records(spark, d):
    """The last label of each account and key again, against the one before it as what is stored: what is a no-op, what is history and what becomes the latest."""
    h = adapters.label_history(spark, d).withColumns({"method": F.lit("rule"), "evaluable": F.col("confidence_milli") % 7 != 0, "value": F.col("confidence_milli") % 3 == 0, "rule_version": F.lit("1"), "reason": F.lit("r"), "confidence_milli": F.col("confidence_milli") % 2})
    rank = F.row_number().over(upserts.Window.partitionBy("account_id", "label_key").orderBy(F.desc("labeled_at"), F.desc("id")))
    two = h.withColumn("n", rank)
    late = F.when(F.col("id").cast("long") % 10 == 0, F.lit("1990-01-01").cast("timestamp_ntz")).otherwise(F.col("labeled_at"))
    rows = upserts.recorded(two.where("n = 2").drop("n"), two.where("n = 1").drop("n").withColumn("labeled_at", late), ("account_id", "label_key"), ("value", "rule_version", "confidence_milli", "reason", "method", "evaluable"), "labeled_at")
    return rows.select("account_id", "label_key", "id", "noop", "history", "newest")


#: Columns of the results that hold nulls: numbers, verdicts.
NULLS = {
    "raw_posts": (("foreign_videos",), ("ai_media", "quoted_has_video")),
    "monotone_merge": (("videos",), ()),
}
QUERIES = {f.__name__: f for f in (raw_accounts, raw_posts, rejected_payloads, monotone_merge, account_upsert, label_records)}
QUERIES |= {name: (lambda spark, d, name=name, f=QUERIES[name]: shown(f(spark, d), *NULLS[name])) for name in NULLS}

ORACLE_SQL = {
    "raw_accounts": """WITH n AS (SELECT c_custkey AS n FROM customer WHERE c_custkey % 41 <> 0 AND c_custkey % 43 <> 0 AND c_custkey % 37 <> 0)
 SELECT CAST(n AS VARCHAR) AS id, CASE WHEN n % 2 = 0 THEN 'user' || n ELSE 'old_user' || n END AS screen_name, CASE WHEN n % 2 = 0 THEN 'USER' || n WHEN n % 4 = 1 THEN 'user' || n ELSE '' END AS display_name, CASE WHEN n % 3 <> 0 THEN 'bio é' || chr(10) || n END AS bio, NULL::VARCHAR AS image_url,
 n % 500 AS followers_count, n % 90 AS following_count, n % 7 AS tweet_count, CASE WHEN n % 2 = 0 THEN 1577840400000 + (n % 28) * 86400000 ELSE 1580702706000 END AS created_ms, CASE WHEN n % 5 = 0 THEN 'Tokyo' END AS location, NULL::VARCHAR AS url, n % 6 = 0 AS is_blue_verified,
 CASE WHEN n % 9 = 0 THEN 'Business' END AS verified_type, CASE WHEN n % 8 = 0 THEN 'Creator' END AS professional_type, NULL::VARCHAR AS self_label FROM n""",
    "raw_posts": """WITH n AS (SELECT event_id AS n, CAST(user_id AS VARCHAR) AS u FROM events WHERE event_id % 53 <> 0 AND event_id % 47 <> 0)
 SELECT CAST(n AS VARCHAR) AS id, u AS account_id, 'text ' || n AS text, 1580947201000 AS created_ms, n % 4 AS retweet_count, n % 6 AS like_count, n % 2 AS reply_count, 0 AS quote_count, n % 3 = 1 AS is_reply, CASE WHEN n % 3 = 1 THEN 'p' || (n % 10) END AS in_reply_to, n % 3 = 1 AND u = '3' AS is_author_reply,
 n % 7 = 0 AS is_retweet, CASE WHEN n % 7 = 0 THEN 'r' || (n % 10) END AS retweeted_id, n % 11 = 0 AS is_promoted, false AS is_paid, CASE WHEN n % 2 = 1 THEN '' WHEN n % 3 = 0 THEN 'https://a.example/' || (n % 5) || ' https://t.co/' || (n % 5) ELSE 'https://t.co/' || (n % 5) END AS expanded_urls,
 CASE WHEN n % 13 = 0 THEN n % 2 = 0 END AS ai_media, NULL::VARCHAR AS ai_source, CASE WHEN n % 3 = 1 THEN NULL WHEN n % 6 = 2 THEN 0 ELSE CASE WHEN n % 2 = 0 AND n % 5 <> 0 AND u <> '7' THEN 1 ELSE 0 END END AS foreign_videos,
 CASE WHEN n % 4 >= 2 THEN 'q' || (n % 9) END AS quoted_id, CASE WHEN n % 4 >= 2 AND n % 5 <> 0 THEN '8' END AS quoted_author_id, CASE WHEN n % 4 >= 2 AND n % 3 <> 0 THEN n % 4 = 2 END AS quoted_has_video, 'following' AS source FROM n""",
    "rejected_payloads": """SELECT 'user' AS kind, CASE WHEN c_custkey % 41 = 0 OR c_custkey % 43 = 0 THEN 'malformed' ELSE 'incomplete' END AS problem, count(*) AS n FROM customer WHERE c_custkey % 41 = 0 OR c_custkey % 43 = 0 OR c_custkey % 37 = 0 GROUP BY 2
 UNION ALL SELECT 'post', CASE WHEN event_id % 53 = 0 THEN 'malformed' ELSE 'incomplete' END, count(*) FROM events WHERE event_id % 53 = 0 OR event_id % 47 = 0 GROUP BY 2""",
    "monotone_merge": """WITH r AS (SELECT l_partkey AS id, l_orderkey * 10 + l_linenumber AS seq, l_linenumber AS line, CAST(l_quantity AS BIGINT) AS likes, CASE WHEN l_linenumber <> 5 THEN l_returnflag = 'R' END AS flagged, CASE WHEN l_linenumber <> 3 THEN [l_linestatus, l_returnflag] END AS tags,
  CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS media, CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_quantity AS BIGINT) % 4 END AS videos, l_linestatus AS source FROM lineitem),
 s AS (SELECT * FROM r WHERE line = 1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1),
 b AS (SELECT id, arg_max(likes, seq) AS likes, bool_or(coalesce(flagged, false)) AS flagged, list_distinct(flatten(list(tags) FILTER (tags IS NOT NULL))) AS tags, arg_max(media, seq) FILTER (media IS NOT NULL) AS media, max(videos) AS videos, arg_max(source, seq) AS source FROM r WHERE line > 1 GROUP BY 1),
 m AS (SELECT id, s.id AS sid, b.id AS bid, CASE WHEN b.id IS NULL THEN s.likes ELSE b.likes END AS likes, CASE WHEN b.id IS NULL THEN s.flagged ELSE b.flagged OR coalesce(s.flagged, false) END AS flagged, list_sort(list_distinct(coalesce(b.tags, []) || coalesce(s.tags, []))) AS tags, coalesce(b.media, s.media) AS media,
  greatest(b.videos, s.videos) AS videos, CASE WHEN b.id IS NULL THEN s.source ELSE b.source END AS source, s.likes AS l0, s.flagged AS f0, list_sort(list_distinct(s.tags)) AS t0, s.media AS m0, s.videos AS v0 FROM s FULL JOIN b USING (id))
 SELECT id, likes, flagged, array_to_string(tags, ',') AS tags, media, videos, source, sid IS NULL OR likes IS DISTINCT FROM l0 OR flagged IS DISTINCT FROM f0 OR tags IS DISTINCT FROM t0 OR media IS DISTINCT FROM m0 OR videos IS DISTINCT FROM v0 AS changed FROM m""",
    "account_upsert": """WITH s AS (SELECT CAST(c_custkey AS VARCHAR) AS id, 'b' || (c_custkey % 3) AS bio, c_custkey % 2 AS followers, c_custkey AS first_seen, 'old' AS image FROM customer WHERE c_custkey % 5 <> 0),
 b AS (SELECT CAST(o_custkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 4 <> 0 THEN 'b' || (o_orderkey % 3) END AS bio, o_orderkey % 2 AS followers, o_orderkey + 1000000 AS first_seen, 'new' AS image FROM orders WHERE o_custkey % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
 SELECT id, CASE WHEN b.id IS NULL THEN s.bio ELSE b.bio END AS bio, coalesce(b.followers, s.followers) AS followers, coalesce(s.first_seen, b.first_seen) AS first_seen, coalesce(b.image, s.image) AS image, s.id IS NULL OR (b.id IS NOT NULL AND (s.bio IS DISTINCT FROM b.bio OR s.followers IS DISTINCT FROM b.followers)) AS changed FROM s FULL JOIN b USING (id)""",
    "label_records": """WITH h AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey AS n, CAST(o_custkey AS VARCHAR) AS account_id, o_orderpriority AS label_key, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) % 1001 AS m, o_orderdate AS dt FROM orders),
 k AS (SELECT *, m % 3 = 0 AS v, m % 2 AS c, m % 7 <> 0 AS e, row_number() OVER (PARTITION BY account_id, label_key ORDER BY dt DESC, id DESC) AS place FROM h),
 j AS (SELECT a.*, b.id IS NOT NULL AND a.v = b.v AND a.c = b.c AND a.e = b.e AS noop, b.dt AS was FROM k a LEFT JOIN k b ON b.account_id = a.account_id AND b.label_key = a.label_key AND b.place = 2 WHERE a.place = 1)
 SELECT account_id, label_key, id, noop, NOT noop AS history, NOT noop AND (was IS NULL OR was <= CASE WHEN n % 10 = 0 THEN TIMESTAMP '1990-01-01' ELSE dt END) AS newest FROM j""",
}
ORACLE_SQL |= {name: shown_sql(ORACLE_SQL[name], *NULLS[name]) for name in NULLS}

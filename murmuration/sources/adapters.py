"""Domain tables made of the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def label_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_custkey").cast("string").alias("account_id"),
        F.col("o_orderpriority").alias("label_key"),
        (F.col("o_orderstatus") == "F").alias("value"),
        (F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long") % 1001).alias("confidence_milli"),
        F.concat(F.lit("reason-"), (F.col("o_orderkey") % 7).cast("string")).alias("reason"),
        F.concat(F.lit("1."), (F.col("o_orderkey") % 3).cast("string"), F.lit(".0")).alias("rule_version"),
        F.col("o_orderdate").alias("labeled_at"),
    )


BIOS = (
    "anime and manga every day", "コスメとスキンケア", "リメイク作品の紹介", "long term investing notes", "investigation desk", "株式会社の広報", "資産運用を学ぶ", "workout at dawn", "foodie and chef",
    "ラーメンズのファン", "ラーメン食べ歩き", "gamer", "k-pop idol", "イラスト描きます pixiv", "film / music / books", "cinema lover", "singer in a band", "子育て中", "保護猫と暮らす", "Jリーグ観戦", "eスポーツ",
    "backpacker", "VRC住民", "hololive にじさんじ", "just a person", None,
)


def bio():
    """A profile text by account number."""
    pick = F.lit(None).cast("string")
    for i, text in enumerate(BIOS):
        pick = F.when(F.col("c_custkey") % len(BIOS) == i, F.lit(text)).otherwise(pick)
    return pick


def account(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = F.floor(F.abs("c_acctbal")).cast("long")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("id"),
        F.col("c_name").alias("screen_name"),
        balance.alias("followers_count"),
        (balance % 997).alias("following_count"),
        (balance * 3).alias("tweet_count"),
        (F.col("c_acctbal") > 0).alias("is_blue_verified"),
        bio().alias("bio"),
        (F.col("c_custkey") % 40 + 1).cast("double").alias("age_days"),
        (F.col("c_custkey") % 11 != 0).alias("fetched"),
        F.when(F.col("c_custkey") % 2 == 0, "Creator").when(F.col("c_custkey") % 3 == 0, "Business").alias("professional_type"),
        F.when(F.col("c_custkey") % 7 == 0, "Parody").when(F.col("c_custkey") % 7 == 1, "Commentary").when(F.col("c_custkey") % 7 == 2, "Fan").alias("self_label"),
        F.when(F.col("c_mktsegment") == "BUILDING", "Business").when(F.col("c_mktsegment") == "MACHINERY", "Government").when(F.col("c_mktsegment") == "FURNITURE", "None").alias("verified_type"),
    )


def follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return (
        items.select("l_orderkey", "l_partkey").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(F.col("o_custkey").cast("string").alias("follower_id"), F.col("l_partkey").cast("string").alias("followee_id")).distinct()
    )


def tweet(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").cast("string").alias("account_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"),
        kind.isin("click", "view", "error").alias("is_reply"),
        (kind == "view").alias("is_retweet"),
        (kind == "purchase").alias("is_promoted"),
        F.get_json_object("props", "$.k").alias("in_reply_to"),
        kind.alias("kind"),
    )


def block(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return items.groupBy(F.col("l_suppkey").cast("string").alias("blocker_id"), F.col("l_partkey").cast("string").alias("blocked_id")).agg(
        F.max("l_returnflag").alias("flag"), F.max("l_linestatus").alias("status"), F.when(F.min("l_linenumber") == 1, "active").otherwise("missing").alias("status_before"), F.count("*").alias("missing_before")
    )


def post(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as posts with a text, by the event's number."""
    number, kind = F.col("event_id"), F.col("event_type")
    put = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    texts = (
        put("https://t.co/a", number % 13), put("Limited offer for everyone today, visit the page right now"), put("@user", number % 5, " Limited offer for everyone today, visit the page right now"),
        put("こんにちは、今日はとても良い天気ですね。散歩に行きましょう"), put("see https://www.amazon.co.jp/dp/", number, "?tag=shop-22 for it"), put("new deal https://amzn.to/", number),
        put("#PR 新しい商品のご紹介です"), put("post number ", number % 50, " about the daily walk in the park"), put("https://login.scam.example/", number), put("@user7 free airdrop, claim now ", number % 20),
    )
    text = F.lit(None).cast("string")
    for i, t in enumerate(texts):
        text = F.when(number % 10 == i, t).otherwise(text)
    return table(spark, sf_dir, "events").select(
        number.cast("string").alias("id"), F.col("user_id").cast("string").alias("account_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"),
        kind.isin("click", "error").alias("is_reply"), (kind == "view").alias("is_retweet"), (kind == "purchase").alias("is_promoted"),
        F.when(kind.isin("click", "error") & (number % 4 != 0), F.get_json_object("props", "$.k")).alias("in_reply_to"), text.alias("text"), (number % 17 == 0).alias("foreign_video"), (number % 29 == 0).alias("is_paid"),
    )

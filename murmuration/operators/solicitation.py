"""The spam rule: soliciting bios and posts, beside bait-like timelines and mass following."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import confidence, ramp
from ..functions.text import SPACE, contexts, fixed, nfkc

# Fixed values of the rule: its version, patterns, window and thresholds.
VERSION = "1.11.1"
GAP = f"[^{SPACE}❌🆖✗・、。!！🚫🈲]{{0,10}}"
SOLICITATION = (
    r"(?iu)出会い(系|活)|パパ活|ママ活|裏垢.{0,10}(dm|DM|募集|販売)|自動(フォロー|いいね)|稼げる|副業" + GAP + r"(募集|紹介|稼)|儲かる|不労所得|高収入.{0,10}(バイト|副業)|f4f"
    + f"|follow[{SPACE}]*for[{SPACE}]*follow|dm[{SPACE}]*me.{{0,10}}fun"
)
REJECTION = r"(?i)お断り|お断わり|御断り|拒否|NG|ダメ|禁止|お控え|ご遠慮|しないで|通報|ブロック|スルー|無視|要らん|要りません|要らない|いりません|いらない|不要|結構です|興味(が)?(あり|有り)?ません|対応(は)?していません|受け?付け?(?:は)?(?:して)?(?:い|おり)?ません|🆖|❌|✗"
REJECTION_WINDOW = 60
LEAST_REPEATS, LEAST_SAMPLE = 2, 5
BAIT_RATIO, MASS_FOLLOWING, MASS_RATIO = 0.8, 500, 5


def solicits(text: Column) -> Column:
    """Whether a soliciting phrase stands in the text that no refusal follows within the window; false for null."""
    return F.coalesce(F.exists(contexts(text, SOLICITATION, ahead=REJECTION_WINDOW), lambda m: ~m["after"].rlike(REJECTION)), F.lit(False))


def spam(accounts: DataFrame, posts: DataFrame) -> DataFrame:
    """account_id, label_key, rule_version, value, confidence, evaluable, reason: one row for each account.

    `accounts`: id, bio, followers_count, following_count, fetched (whether the recent posts are known); `posts`: the recent ones, account_id, text, is_retweet.
    A null bio solicits nothing; accounts without posts have a repost ratio of 0.
    """
    clean = posts.select("account_id", "is_retweet", nfkc("text").alias("text"))
    by = clean.groupBy("account_id").agg(F.count("*").alias("n"), F.count_if("is_retweet").alias("reposts"), F.count_if(~F.col("is_retweet") & solicits(F.col("text"))).alias("found"))
    rows = accounts.select(F.col("id").alias("account_id"), nfkc("bio").alias("bio"), "followers_count", "following_count", "fetched").join(by, "account_id", "left").fillna(0, ["n", "reposts", "found"])
    rows = rows.withColumns({"solicits": solicits(F.col("bio")), "posts_found": F.when(F.col("fetched"), F.col("found")).otherwise(0)})
    following, followers, n = F.col("following_count"), F.col("followers_count"), F.col("n")
    ratio = F.when(n > 0, F.col("reposts") / n).otherwise(0.0)
    asks = F.col("solicits") | (F.col("posts_found") >= LEAST_REPEATS)
    bait, mass = (n >= LEAST_SAMPLE) & (ratio >= BAIT_RATIO), (following >= MASS_FOLLOWING) & (following >= followers * MASS_RATIO)
    value = (bait & mass) | (asks & (bait | mass))
    by_repost, by_count = ramp(ratio, BAIT_RATIO, 0.2), ramp(following, MASS_FOLLOWING, 500)
    by_ratio = ramp(F.when(followers > 0, following / followers).otherwise(following.cast("double")), MASS_RATIO, 5)
    gated = F.when(asks, F.greatest(by_repost, F.least(by_count, by_ratio))).otherwise(0.0)
    evidence = F.greatest(gated, F.least(by_repost, by_count, by_ratio))
    reason = F.concat(
        F.lit("bio solicitation="), F.col("solicits").cast("string"), F.lit(", tweetSolicitationCount="), F.col("posts_found").cast("string"), F.lit(", retweetRatio="), fixed(ratio, 2), F.lit(" (n="), n.cast("string"),
        F.lit("), followingCount="), following.cast("string"), F.lit(", followersCount="), followers.cast("string"),
    )
    return rows.select("account_id", F.lit("spam").alias("label_key"), F.lit(VERSION).alias("rule_version"), value.alias("value"), F.round(confidence(value, evidence, F.lit(True)), 6).alias("confidence"), F.lit(True).alias("evaluable"), reason.alias("reason"))

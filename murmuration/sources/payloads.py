"""Posts and accounts from raw JSON lines.

A user comes in two shapes: names and dates under `core`, or under `legacy` as in older payloads. Both are read
with one schema that has the fields of either, and each field is taken from where it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE

# A user's fields, spelled as inside a struct.
_USER = """restId: string, isBlueVerified: boolean, core: struct<screenName: string, name: string, createdAt: string>,
legacy: struct<screenName: string, name: string, description: string, followersCount: long, friendsCount: long, statusesCount: long, createdAt: string, profileImageUrlHttps: string, location: string, url: string>,
verification: struct<verifiedType: string>, professional: struct<professionalType: string>, parodyCommentaryFanLabel: string"""
USER = f"struct<{_USER}>"
POST = f"""struct<restId: string, user: {USER}, legacy: struct<fullText: string, createdAt: string, retweetCount: long, favoriteCount: long, replyCount: long, quoteCount: long, inReplyToStatusIdStr: string, retweetedStatusIdStr: string,
isPromoted: boolean, isPaidPromotion: boolean, hasAiGeneratedMedia: boolean, aiGeneratedDetectionSource: string, entities: struct<urls: array<struct<url: string, expandedUrl: string>>>,
extendedEntities: struct<media: array<struct<type: string, sourceUserIdStr: string>>>,
quotedStatusResult: struct<result: struct<restId: string, legacy: struct<extendedEntities: struct<media: array<struct<type: string>>>>, user: struct<restId: string>>>>>"""
CORRUPT = "_corrupt_record"
VIDEO = ("video", "animated_gif")


def parsed(lines: DataFrame, schema: str, col: str = "value") -> DataFrame:
    """`line` and the fields of a JSON line as struct `raw`, with `problem`: null, malformed (not JSON of this shape, or null) or incomplete (no id, or no `legacy` part, as with withheld posts)."""
    raw = F.from_json(F.col(col), f"{schema[:-1]}, {CORRUPT}: string>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rows = lines.select(F.col(col).alias("line"), raw.alias("raw"))
    problem = F.when(F.col("raw").isNull() | F.col(f"raw.{CORRUPT}").isNotNull(), "malformed").when(F.col("raw.restId").isNull() | F.col("raw.legacy").isNull(), "incomplete")
    return rows.withColumn("problem", problem)


def rejected(lines: DataFrame, schema: str, col: str = "value") -> DataFrame:
    """line and problem of the lines that give no row."""
    return parsed(lines, schema, col).where("problem IS NOT NULL").select("line", "problem")


def stamp_ms(text: Column) -> Column:
    """Milliseconds of `Wed Jan 01 00:00:00 +0000 2020` (the day's name isn't needed) or of an ISO time stamp; null for others."""
    plain = F.try_to_timestamp(F.substring(text, 5, 100), F.lit("MMM dd HH:mm:ss Z yyyy"))
    return F.unix_millis(F.coalesce(plain, F.try_to_timestamp(text)))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+\\z", "")


def _user(at: str) -> dict[str, Column]:
    """The fields of a user in either shape: core first, then legacy, and the empty text where neither has one."""
    c = lambda name: F.col(f"{at}.{name}")
    either = lambda name: F.coalesce(c(f"core.{name}"), c(f"legacy.{name}"), F.lit(""))
    return {
        "id": c("restId"), "screen_name": either("screenName"), "display_name": either("name"), "bio": c("legacy.description"), "image_url": c("legacy.profileImageUrlHttps"), "followers_count": c("legacy.followersCount"),
        "following_count": c("legacy.friendsCount"), "tweet_count": c("legacy.statusesCount"), "created_ms": stamp_ms(either("createdAt")), "location": c("legacy.location"), "url": c("legacy.url"), "is_blue_verified": c("isBlueVerified"),
        "verified_type": c("verification.verifiedType"), "professional_type": c("professional.professionalType"), "self_label": c("parodyCommentaryFanLabel"),
    }


def accounts(lines: DataFrame, col: str = "value") -> DataFrame:
    """One row for each line that holds a user; others are left to `rejected`."""
    return parsed(lines, USER, col).where("problem IS NULL").select(*[v.alias(k) for k, v in _user("raw").items()])


def posts(lines: DataFrame, source: str, viewer: str, col: str = "value") -> DataFrame:
    """One row for each line that holds a post, from the timeline `source` as `viewer` sees it; others are left to `rejected`.

    A post is a reply or a repost where it names the other post. Links are the expanded ones, else the short ones, trimmed, each once. foreign_videos is null without
    media, else the number of videos whose source is someone else; quoted_has_video is null where the quoted post can't be seen.
    """
    rows = parsed(lines, POST, col).where("problem IS NULL AND raw.user.restId IS NOT NULL")
    g = lambda name: F.col(f"raw.legacy.{name}")
    is_video = lambda m: m["type"].isin(*VIDEO)
    author = F.col("raw.user.restId")
    links = F.transform(F.coalesce(g("entities.urls"), F.array().cast("array<struct<url:string,expandedUrl:string>>")), lambda u: F.coalesce(trimmed(u["expandedUrl"]), trimmed(u["url"])))
    foreign = F.filter(F.coalesce(g("extendedEntities.media"), F.array().cast("array<struct<type:string,sourceUserIdStr:string>>")), lambda m: is_video(m) & m["sourceUserIdStr"].isNotNull() & (m["sourceUserIdStr"] != author))
    quoted = F.col("raw.legacy.quotedStatusResult.result")
    seen = F.exists(F.coalesce(quoted["legacy"]["extendedEntities"]["media"], F.array().cast("array<struct<type:string>>")), is_video)
    reply = g("inReplyToStatusIdStr").isNotNull()
    return rows.select(
        F.col("raw.restId").alias("id"), author.alias("account_id"), g("fullText").alias("text"), stamp_ms(g("createdAt")).alias("created_ms"), g("retweetCount").alias("retweet_count"), g("favoriteCount").alias("like_count"), g("replyCount").alias("reply_count"), g("quoteCount").alias("quote_count"),
        reply.alias("is_reply"), g("inReplyToStatusIdStr").alias("in_reply_to"), (reply & (author == viewer)).alias("is_author_reply"), g("retweetedStatusIdStr").isNotNull().alias("is_retweet"), g("retweetedStatusIdStr").alias("retweeted_id"),
        F.coalesce(g("isPromoted"), F.lit(False)).alias("is_promoted"), F.coalesce(g("isPaidPromotion"), F.lit(False)).alias("is_paid"), F.array_distinct(F.filter(links, lambda u: F.length(u) > 0)).alias("expanded_urls"),
        g("hasAiGeneratedMedia").alias("ai_media"), g("aiGeneratedDetectionSource").alias("ai_source"), F.when(g("extendedEntities").isNotNull(), F.size(foreign)).cast("long").alias("foreign_videos"),
        quoted["restId"].alias("quoted_id"), quoted["user"]["restId"].alias("quoted_author_id"), F.when(quoted["legacy"].isNotNull(), seen).alias("quoted_has_video"), F.lit(source).alias("source"),
    )

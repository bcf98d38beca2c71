"""Accounts and posts made of the driver tables in which the rules on bios, replies and swarms hold for some accounts and not for others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .adapters import table

BIOS = (
    "出会い活してます dm me for some fun !", "投資や副業、出会い系といったフォローはお断りです。", "出会い系ﾀﾞﾒ！日常の記録", "副業🆖❌趣味のお友達募集中！", "副業で友だち紹介、高収入なバイト", "ｆ４ｆ！ follow　for　follow", "just here to read the news", None,
    "パパ活お断り。" + "写真と散歩と読書が好きです。" * 5 + "稼げる情報を発信", "裏垢さん達のDM募集は通報します", "不労所得" + "𝒳🎉" * 15 + "NG", "不労所得" + "あ🎉" * 21 + "NG",
)


def pick(values: tuple, by: Column) -> Column:
    """The value at position `by` modulo their number."""
    out = F.lit(None).cast("string")
    for i, v in enumerate(values):
        out = F.when(by % len(values) == i, F.lit(v)).otherwise(out)
    return out


def account(spark: SparkSession, d: str) -> DataFrame:
    """id, bio, followers_count, following_count, fetched."""
    n = F.col("c_custkey")
    return table(spark, d, "customer").select(
        n.cast("string").alias("id"), pick(BIOS, n).alias("bio"), F.when(n % 4 == 0, 10).when(n % 4 == 1, 500).when(n % 4 == 2, 500).otherwise(0).cast("long").alias("followers_count"),
        F.when(n % 4 == 0, 800).when(n % 4 == 1, 400).when(n % 4 == 2, 2000).otherwise(620).cast("long").alias("following_count"), (n % 11 != 0).alias("fetched"),
    )


def _event(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    return table(spark, d, "events").select(n, n.cast("string").alias("id"), F.col("user_id"), F.col("user_id").cast("string").alias("account_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))


def bait(spark: SparkSession, d: str) -> DataFrame:
    """Posts of accounts that repost more or less, with soliciting texts of some: id, account_id, at_us, is_retweet, text."""
    n, u = F.col("event_id"), F.col("user_id")
    asking = F.when(n % 4 == 0, "今だけ稼げる方法").when(n % 4 == 1, "稼げる話は興味ありません").when(n % 4 == 2, "自動フォローで相互に").otherwise("朝ごはん")
    text = F.when(u % 5 == 0, asking).otherwise(F.concat(F.lit("日記 "), n.cast("string")))
    return _event(spark, d).select("id", "account_id", "at_us", F.when(u % 3 == 0, n % 10 != 0).otherwise(n % 3 == 0).alias("is_retweet"), text.alias("text"))


HALF_DAY_US = 12 * 3600 * 1_000_000


def crowd(spark: SparkSession, d: str) -> DataFrame:
    """Replies to a new target each half day, alike or not, or too short, and to some targets that last: id, account_id, at_us, is_reply, target, text."""
    n = F.col("event_id")
    half = F.floor(F.col("at_us") / HALF_DAY_US)
    alike = F.concat(F.lit("@host What a wonderful photo of the old harbour, number "), (n % 7).cast("string"))
    text = F.when(half % 3 == 0, alike).when(half % 3 == 1, F.md5(n.cast("string").cast("binary"))).otherwise(F.concat(F.lit("nice "), n.cast("string")))
    target = F.when(n % 11 == 0, None).when(n % 13 == 0, F.concat(F.lit("long-"), (n % 3).cast("string"))).otherwise(F.concat(F.lit("t"), half.cast("string")))
    return _event(spark, d).select("event_id", "id", "account_id", "at_us", half.alias("half"), (n % 5 != 0).alias("is_reply"), target.alias("target"), text.alias("text"))


def newcomers(spark: SparkSession, d: str) -> DataFrame:
    """Replies that accounts have made besides, to their own half day's target or the next one's, up to two hours earlier."""
    n = F.col("event_id")
    return crowd(spark, d).where(n % 17 == 3).select("id", "account_id", (F.col("at_us") - (n % 3) * 3_600_000_000).alias("at_us"), F.concat(F.lit("t"), (F.col("half") + n % 2).cast("string")).alias("target"), "text")


SINGLES = "山川田木空海花雪月星風火水土石金草竹糸貝"


def flood(spark: SparkSession, d: str) -> DataFrame:
    """Replies to two targets of each account, of even accounts within hours: id, account_id, at_us, is_reply, is_retweet, in_reply_to, text."""
    n, u = F.col("event_id"), F.col("user_id")
    begin = 1_704_067_200_000_000
    at = F.when(u % 2 == 0, begin + F.floor((F.col("at_us") - begin) / 60)).otherwise(F.col("at_us"))
    phrases = ("@star この動画 おもしろすぎて何回も見ちゃった #動画", "@star 何回見ても この動画 おもしろすぎる", "この動画 ほんとにおもしろい https://x.example/a", "@star この動画 は久しぶりに笑った")
    text = F.when(u % 3 == 0, pick(phrases, n)).when(u % 3 == 1, F.substring(F.lit(SINGLES), (n % len(SINGLES)).cast("int") + 1, F.lit(1))).otherwise(F.concat(F.lit("@a reply "), (n % 9).cast("string")))
    target = F.when(n % 10 == 2, None).when(n % 3 == 0, "b").otherwise("a")
    return _event(spark, d).select("id", "account_id", at.alias("at_us"), (n % 7 != 0).alias("is_reply"), (n % 7 == 1).alias("is_retweet"), target.alias("in_reply_to"), text.alias("text"))


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each label and day: id, label_key, at (ms), evaluated, true_count, completeness."""
    day = F.unix_date(F.to_date("o_orderdate"))
    by = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("label_key"), day.alias("day")).agg(F.count("*").alias("evaluated"), F.count_if(F.col("o_orderstatus") == "F").alias("true_count"))
    state = F.when(F.col("day") % 7 == 0, "partial").when(F.col("day") % 11 == 0, "unknown").otherwise("complete")
    at = F.col("day").cast("long") * 86_400_000 + (F.col("day") % 5) * 3_600_000
    return by.select(F.concat("label_key", F.lit("|"), F.col("day").cast("string")).alias("id"), "label_key", "day", at.alias("at"), "evaluated", "true_count", state.alias("completeness"))


def findings(spark: SparkSession, d: str) -> DataFrame:
    """id, label_key, status, severity; labels have findings of more or less weight, and one has none that is open."""
    n = F.col("p_partkey")
    label, step = n % 5, F.floor(n / 5)
    severity = pick(("odd", "low", "medium", "high"), step % (label + 1))
    status = F.when(label == 4, "resolved").otherwise(pick(("active", "dismissed", "recurring", "resolved"), step))
    return table(spark, d, "part").select(n.alias("id"), pick(PRIORITIES, label).alias("label_key"), status.alias("status"), severity.alias("severity"))


SUMMARY_GROUPS = {"profile_at": ("screen_name",), "labels_at": ("labels", "label_count"), "findings_at": ("finding_count", "severity")}


def _summary(key: str, n: Column, prefix: str, spans: tuple[int, int, int], gaps: tuple[int, int]) -> list[Column]:
    text = lambda name, m: F.concat(F.lit(name), (n % m).cast("string"))
    return [
        F.col(key).cast("string").alias("account_id"), text(prefix, 1 << 30).alias("screen_name"), (n % spans[0]).alias("profile_at"), text(f"{prefix}k", 3).alias("labels"), (n % 6).alias("label_count"),
        F.when(n % gaps[0] != 0, n % spans[1]).alias("labels_at"), (n % 5).alias("finding_count"), text(f"{prefix}s", 4).alias("severity"), F.when(n % gaps[1] != 0, n % spans[2]).alias("findings_at"),
    ]


def stored_summaries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(*_summary("c_custkey", F.col("c_custkey"), "s", (50, 60, 40), (7, 3)))


def new_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Batches of summaries, seq in the order they came: often newer in one group of columns and older in another."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), *_summary("o_custkey", F.col("o_orderkey"), "n", (100, 90, 70), (5, 4)))


def month_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each label and month: id, label_key, at (ms), evaluated, true_count."""
    month = F.trunc(F.to_date("o_orderdate"), "month")
    by = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("label_key"), month.alias("month")).agg(F.count("*").alias("evaluated"), F.count_if(F.col("o_orderstatus") == "F").alias("true_count"))
    return by.select(F.concat("label_key", F.lit("|"), F.date_format("month", "yyyy-MM")).alias("id"), "label_key", (F.unix_date("month").cast("long") * 86_400_000).alias("at"), "evaluated", "true_count")


def month_reasons(spark: SparkSession, d: str) -> DataFrame:
    """id, reason, n: the reasons of each month's true rows."""
    rows = table(spark, d, "orders").where("o_orderstatus = 'F'")
    return rows.groupBy(F.concat("o_orderpriority", F.lit("|"), F.date_format("o_orderdate", "yyyy-MM")).alias("id"), F.concat(F.lit("reason-"), (F.col("o_orderkey") % 3).cast("string")).alias("reason")).agg(F.count("*").alias("n"))


def issues(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("s_suppkey")
    severity = F.when(n % 37 == 0, "critical").otherwise(pick(("low", "high", "medium", "odd", "low"), n))
    return table(spark, d, "supplier").select(
        n.cast("string").alias("id"), pick(("crawl_stalled", "outbox_stalled"), n).alias("type"), pick(("active", "resolved", "active"), n).alias("status"), severity.alias("severity"), pick(("crawler", "blocker"), n).alias("component"), (n * 7919 % 1000 * 1000).alias("detected_at"),
    )


def review_findings(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_partkey")
    severity = F.when(n % 401 == 7, "critical").otherwise(pick(("low", "medium", "high", "odd"), n))
    return table(spark, d, "part").select(
        n.cast("string").alias("id"), pick(("label_count_drop", "coverage_gap", "reason_distribution_shift"), n).alias("type"), pick(("active", "recurring", "resolved", "active", "recurring"), n).alias("status"), severity.alias("severity"), F.lit("label").alias("scope_type"),
        pick(PRIORITIES, n).alias("scope_id"), (n * 104_729 % 1000 * 1000).alias("detected_at"),
    )


def occurrences(spark: SparkSession, d: str) -> DataFrame:
    quantity = F.col("l_quantity").cast("long")
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").cast("string").alias("finding_id"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("observed_at"), F.when(F.col("l_orderkey") % 9 != 0, quantity).alias("affected"),
        F.when(F.col("l_linenumber") != 2, quantity + F.col("l_orderkey") % 5).otherwise(0).alias("total"),
    )


def cut_off(raw: Column, n: int) -> Column:
    """The first n characters, or all but the last one where there are no more than n: a line that is cut off is never whole."""
    return F.left(raw, F.least(F.lit(n), F.length(raw) - 1))


def raw_users(spark: SparkSession, d: str) -> DataFrame:
    """Users as JSON lines: new and old shape by turns, some cut off, some without their legacy part."""
    n = F.col("c_custkey")
    when = lambda cond, value: F.when(cond, value)
    name, since = F.concat(F.lit("user"), n.cast("string")), F.concat(F.lit("Wed Jan "), F.lpad((n % 28 + 1).cast("string"), 2, "0"), F.lit(" 10:00:00 +0900 2020"))
    core = when(n % 2 == 0, F.struct(name.alias("screenName"), F.upper(name).alias("name"), since.alias("createdAt")))
    legacy = F.struct(
        when(n % 2 == 1, F.concat(F.lit("old_"), name)).alias("screenName"), when(n % 4 == 1, name).alias("name"), when(n % 3 != 0, F.concat(F.lit("bio é\n"), n.cast("string"))).alias("description"), (n % 500).alias("followersCount"), (n % 90).alias("friendsCount"), (n % 7).alias("statusesCount"),
        when(n % 2 == 1, F.lit("2020-02-03T04:05:06Z")).alias("createdAt"), when(n % 5 == 0, F.lit("Tokyo")).alias("location"),
    )
    raw = F.to_json(F.struct(n.cast("string").alias("restId"), (n % 6 == 0).alias("isBlueVerified"), core.alias("core"), when(n % 37 != 0, legacy).alias("legacy"), when(n % 9 == 0, F.struct(F.lit("Business").alias("verifiedType"))).alias("verification"), when(n % 8 == 0, F.struct(F.lit("Creator").alias("professionalType"))).alias("professional")))
    return table(spark, d, "customer").select(F.when(n % 41 == 0, cut_off(raw, 40)).when(n % 43 == 0, None).otherwise(raw).alias("value"))


def raw_posts(spark: SparkSession, d: str) -> DataFrame:
    """Posts as JSON lines, with links, media and quoted posts, some cut off or withheld."""
    n, u = F.col("event_id"), F.col("user_id").cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    link = lambda short, long: F.struct(short.alias("url"), long.alias("expandedUrl"))
    urls = F.array(link(text("https://t.co/", n % 5), F.when(n % 3 == 0, text("  https://a.example/", n % 5, "　"))), link(text("https://t.co/", n % 5), F.lit(None).cast("string")), link(F.lit(" "), F.lit(None).cast("string")))
    media = F.array(F.struct(F.when(n % 2 == 0, "video").otherwise("photo").alias("type"), F.when(n % 5 != 0, F.lit("7")).alias("sourceUserIdStr")), F.struct(F.lit("animated_gif").alias("type"), u.alias("sourceUserIdStr")))
    quoted = F.struct(F.struct(text("q", n % 9).alias("restId"), F.when(n % 3 != 0, F.struct(F.when(n % 4 == 2, F.struct(F.array(F.struct(F.lit("video").alias("type"))).alias("media"))).alias("extendedEntities"))).alias("legacy"), F.when(n % 5 != 0, F.struct(F.lit("8").alias("restId"))).alias("user")).alias("result"))
    legacy = F.struct(
        text("text ", n).alias("fullText"), F.lit("Thu Feb 06 00:00:01 +0000 2020").alias("createdAt"), (n % 4).alias("retweetCount"), (n % 6).alias("favoriteCount"), (n % 2).alias("replyCount"), F.lit(0).alias("quoteCount"), F.when(n % 3 == 1, text("p", n % 10)).alias("inReplyToStatusIdStr"),
        F.when(n % 7 == 0, text("r", n % 10)).alias("retweetedStatusIdStr"), F.when(n % 11 == 0, F.lit(True)).alias("isPromoted"), F.when(n % 13 == 0, n % 2 == 0).alias("hasAiGeneratedMedia"), F.when(n % 2 == 0, F.struct(urls.alias("urls"))).alias("entities"), F.when(n % 3 != 1, F.struct(F.when(n % 6 != 2, media).alias("media"))).alias("extendedEntities"),
        F.when(n % 4 >= 2, quoted).alias("quotedStatusResult"),
    )
    user = F.struct(u.alias("restId"), F.struct(F.lit("x").alias("screenName")).alias("legacy"))
    raw = F.to_json(F.struct(n.cast("string").alias("restId"), F.when(n % 47 != 0, legacy).alias("legacy"), user.alias("user")))
    return table(spark, d, "events").select(F.when(n % 53 == 0, cut_off(raw, 60)).otherwise(raw).alias("value"))


PERSONAS = 15


def persona_accounts(spark: SparkSession, d: str) -> DataFrame:
    """id, screen_name, tweet_count, age_days, fetched: those of two personas post very much."""
    n = F.col("c_custkey")
    age = 30 + n % 10
    return table(spark, d, "customer").select(n.cast("string").alias("id"), F.concat(F.lit("user"), n.cast("string")).alias("screen_name"), (age * F.when(n % PERSONAS < 2, 190 + n % 7 * 30).otherwise(10)).cast("long").alias("tweet_count"), age.cast("double").alias("age_days"), (n % 11 != 0).alias("fetched"))


def persona_posts(spark: SparkSession, d: str) -> DataFrame:
    """Events as posts of fifteen kinds of accounts, by the account's number and the post's place k in it; each kind is what one rule or another is about, or just isn't."""
    u, e = F.col("user_id"), F.col("event_id")
    order = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, d, "events").select("user_id", "event_id").withColumns({"k": F.row_number().over(order) - 1, "earlier": F.lag("event_id").over(order).cast("string"), "p": u % PERSONAS})
    k, p = F.col("k"), F.col("p")
    put = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    two = ("A story that I tell again and again", "Another story that I tell to everyone")
    texts = (
        put("post number ", k, " about the daily walk"), put("Thanks for sharing, reply number ", k), F.when(k % 4 < 2, two[0]).otherwise(two[1]), F.when(k % 4 < 2, two[0]).otherwise(two[1]), F.lit("@friend Congratulations to everyone here 🎉 follow for more"),
        put("A fixed greeting to all of my friends ", u), F.when(k % 5 != 0, put("https://t.co/a", k, "\nhttps://t.co/b　@x")).otherwise("with a few words https://t.co/c"), F.when(k % 3 != 0, put("@user7 free airdrop, claim  now ", k)).otherwise("nice picture of the sea"),
        F.when(k % 2 == 0, "今日はとても良い天気です").when(k % 4 == 1, put("RT @user", u, ":  @x great work everyone")).otherwise("@x great work everyone"), F.when(k % 6 == 0, "see these #PR").otherwise("see these #PRx"), F.lit("new deal"), F.lit("what a deal"), put("look ", k),
        F.when(k % 3 == 0, "【PR】新しい商品").when(k % 3 == 1, "#PR 応募しました").otherwise("(PR) only in English"), put("clip ", k),
    )
    text = F.lit(None).cast("string")
    for i, t in enumerate(texts):
        text = F.when(p == i, t).otherwise(text)
    links = lambda *xs: F.array(*[F.lit(x) for x in xs])
    decoys = ("https://amazon.com/dp/1#x?tag=a", "https://amazon.com/dp/1?tag=%20", "https://amazon.com/dp/1?tag=&tag=b", "ftp://amazon.com/?tag=a", "https://notamazon.com/?tag=a", "https://amazon.com/?mytag=a", "https://amazon.com/?TAG=a", "https://video.twimg.one.example/", "not a link")
    urls = F.when(p == 6, F.when(k % 5 != 0, links("https://x.example/a")).otherwise(links())).when(p == 9, links("https://a.example/x", "https://WWW.amazon.co.jp:443/dp/1?x=1&tag=%20shop+22#x")).when(p == 10, links("HTTPS://me@AMZN.TO/abc")).when(p == 11, links(*decoys))
    urls = urls.when((p == 12) & (k % 2 == 0), links("https://ok.example/", "http://Sub.1link.jp:8080/x")).otherwise(links().cast("array<string>"))
    reply = p.isin(1, 4, 5, 7) | (p.isin(2, 3) & (k % 2 == 1)) | ((p == 8) & (k % 4 == 3))
    target = F.when(p == 1, put("t", k)).when(p == 2, "t").when(p == 3, F.col("earlier")).when(p == 4, F.when(k % 5 == 4, F.col("earlier")).otherwise(put("t", u, "-", k))).when(p == 5, put("t", k)).when(p == 7, F.when(k % 4 != 1, "t")).when(p == 8, "x")
    minutes = F.when(p == 0, 10).when(p == 1, 15).when(p == 4, 30).when(p == 5, 600).otherwise(120)
    second = 1_000_000
    return rows.select(
        e.cast("string").alias("id"), u.cast("string").alias("account_id"), (F.lit(1_704_067_200 * second) + (k * minutes * 60 + k % 2 * u % 4 * 60) * second).alias("at_us"), text.alias("text"), reply.alias("is_reply"), ((p == 8) & (k % 4 == 1) | (p == 12) & (k % 4 == 0) | (p == 14) & (k % 9 == 0)).alias("is_retweet"),
        ((p == 9) & (k % 3 == 0)).alias("is_promoted"), ((p == 13) & (u % 2 == 0) | (p == 9) & (u % 2 == 0)).alias("is_paid"), F.when(reply, target).alias("in_reply_to"), urls.alias("urls"), F.when(p == 14, F.when(k % 6 == 0, k % 4 + 1).otherwise(0)).alias("foreign_videos"),
        F.when(p == 14, k % 10 == 0).alias("ai_media"), F.when((p == 14) & (u % 3 > 0), F.when(k % 20 == 0, "UserDeclared").otherwise("Novel")).alias("ai_source"), F.when(p == 1, F.when(k % 4 != 0, "全然違う話題の投稿ですよ").otherwise(put("thanks for sharing, reply number ", k))).when(p == 7, put("claim now your picture of the sea ", k)).alias("parent_text"),
    )


TOPIC_BIOS = (
    "アニメanimeが好き", "コスメとスキンケア", "リメイク作品の紹介", "long term investing notes", "investigation desk", "株式会社の広報", "資産運用を学ぶ", "workout at dawn", "foodie and chef", "ラーメンズのファン", "ラーメン食べ歩き", "gamer", "k-pop idol", "イラスト描きます pixiv",
    "film / music / books", "cinema lover", "singer in a band", "子育て中", "保護猫と暮らす", "Jリーグ観戦", "eスポーツ", "backpacker", "VRC住民", "hololive にじさんじ", "just a person", None,
    "civil engineer", "software engineer", "mechanical-engineer", "仮想通貨お断り", "bitcoin and nft", "no nft please, bitcoin fan", "not crypto", "cryptography notes", "映画/ドラマ/本", "/movies/ films", "R-18 NG 絵です", "成人向け作品を描く", "R-183", "アダルトチルドレン", "NSFW creators DNI", "18禁は❌",
    "元 衆議院議員です", "衆議院議員です。", "市議会議員を目指しています、国会議員です", "自民党 所属", "state senator", "former state senator", "生成AIで描いたイラストは全て自作", "生成AI不使用", "生成AI、音楽、旅", "AI generated by AI images", "created with AI portraits", "大学教授、生成AIについて", "生成AI反対", "嫌いなもの: 朝、雨、AI生成の絵を見ること",
    "生成AIアカウントはブロックします", "生成AI情報収集と日々の記録", "AI-generated art every day", "ぶいちゃん", "フルスタック full stack 開発者",
)


def topic_accounts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), pick(TOPIC_BIOS, F.col("c_custkey")).alias("bio"))


def topic_posts(spark: SparkSession, d: str) -> DataFrame:
    """Posts of which some name a topic or say what made them: id, account_id, at_us, is_retweet, text."""
    n, u = F.col("event_id"), F.col("user_id")
    text = F.when((u % 4 == 0) & (n % 3 == 0), "今夜VRChatで").when((u % 3 == 0) & (n % 5 == 0), "As an AI language model I can't").otherwise("hello vrc2 ぶいちゃん")
    return _event(spark, d).select("id", "account_id", "at_us", (n % 2 == 0).alias("is_retweet"), text.alias("text"))

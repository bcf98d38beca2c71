"""Label rules: accounts with their recent posts in; account_id, label_key, rule_version, value, confidence, evaluable, reason out.

An account and its newest posts are one row, a bundle, whose posts are an array of bounded length. Every rule is an
expression on a bundle, so all rules together are one pass after one aggregation by account.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import confidence, posterior_at_least, ramp
from ..functions.text import MENTION, SPACE, URL, contexts, fixed, long_enough, normalize_for_similarity, normalize_reply, once, utf16_length
from ..sources.kept import kept
from .behaviour import duplicate_replies, recent
from .similarity import likeness

DAY_MS = 86_400_000
# Fixed values of the rules: patterns, hosts, topics with their versions.
PITCH = r"(?i)転職(エージェント|活動|相談|しませんか|しよう)|求人|副業|案件情報|PR案件|広告案件|アフィリ|セミナー情報|無料相談|エアドロ(ップ)?|無料配布|プレゼント企画|\bgiveaway\b|\bairdrop\b|\bclaim\s*now\b|\bconnect\s*wallet\b|\bfree\s*mint\b"
PR_TAG = r"(?iu)(?<![\p{L}\p{N}_])#PR(?![\p{L}\p{N}_])"
PR_BRACKET = r"(?i)[【（(\[]\s*PR\s*[】）)\]]"
JAPANESE = r"[\p{IsHiragana}\p{IsKatakana}\p{IsHan}]"
CAMPAIGN = r"(応募し(まし|て)た|当た(りますように|りました)|抽選で.{0,10}(当たり|当選))"
JAPANESE_SCRIPT = r"[\u3040-\u30ff\u4e00-\u9fff]"
AMAZON = (
    "amazon.co.jp", "amazon.com", "amazon.co.uk", "amazon.ca", "amazon.de", "amazon.fr", "amazon.it", "amazon.es", "amazon.in", "amazon.com.au", "amazon.com.br", "amazon.com.mx", "amazon.nl", "amazon.se", "amazon.pl", "amazon.sg", "amazon.ae", "amazon.sa",
    "amazon.com.be",
)
SHORT_LINK = "amzn.to"
SCAM_HOSTS = {
    "1link.jp": "95%", "link-card.online": "near 100%", "shorta.vip": "near 100%", "effectivegatecpm.com": "near 100%", "mavrtracktor.com": "near 100%", "b-short.link": "near 100%", "to-link.click": "near 100%", "cdn-videy.space": "80%+", "cdn-videy.fit": "80%+",
    "video.twimg.one": "near 100%", "ey43.com": "near 100%",
}
AD_PR = r"(?iu)(?:#PR(?![\p{L}\p{N}_])|[【（(\[]\s*PR\s*[】）)\]])"
AI_SOURCES = {"C2paClient": 1.0, "UserDeclared": 0.9, "ContentDisclosureAiGeneratedDisclosure": 0.75}
AI_SOURCE_UNKNOWN = 0.6
TOPICS = {
    "topic_anime": ("1.2.0", r"アニメ|漫画|\b(anime|manga)\b"),
    "topic_beauty": ("1.0.1", r"コスメ|美容|(?<!リ)メイク|スキンケア|\b(cosmetics?|skincare|makeup)\b"),
    "topic_finance": ("1.3.1", r"\b(trading|invest(?!ig)|broker|finance|financial)|証券|株式(?!会社)|資産運用"),
    "topic_fitness": ("1.0.1", r"筋トレ|フィットネス|ボディメイク|ジム通い|パーソナルトレーニング|自重トレ|\b(?:fitness|workout|gym\s*rat)\b"),
    "topic_food": ("1.2.1", r"\b(cooking|foodie|chef)\b|グルメ|料理|食べ歩き|ラーメン(?!ズ)|レシピ"),
    "topic_gaming": ("1.1.1", r"ゲーム|ゲーマー|ソシャゲ|eスポーツ|\b(gamer|gaming|esports)\b"),
    "topic_idol": ("1.2.1", r"アイドル|\bidol\b|k-?pop|ジャニーズ|ハロプロ|坂道"),
    "topic_illustration": ("1.1.1", r"イラスト|絵師|絵描き|\billustrator\b|pixiv"),
    "topic_music": ("1.1.1", r"\b(music|singer|musician|band|guitarist|vocalist|DJ)\b|音楽|バンド|作曲|シンガー|ミュージシャン"),
    "topic_parenting": ("1.1.1", r"\bparenting\b|育児|子育て|ワーママ|ワンオペ育児"),
    "topic_pets": ("1.0.1", r"愛猫|愛犬|飼い猫|飼い犬|保護猫|保護犬|猫好き|犬好き|ねこ好き|いぬ好き|多頭飼い|\bpet\s*(?:lover|parent)\b"),
    "topic_sports": ("1.2.1", r"\b(baseball|soccer|basketball|NBA|MLB|NPB)\b|(?<![eEｅＥ])スポーツ|野球|サッカー|バスケ(ットボール)?|Jリーグ"),
    "topic_travel": ("1.1.1", r"旅行|旅好き|一人旅|旅が好き|温泉巡り|\b(travel|travels|traveling|travelling|traveler|traveller|backpacker)\b"),
    "topic_vrchat": ("1.1.1", r"VRChat|ぶいちゃ(?!ん)|(?<![A-Za-z0-9])VRC(?:(?![A-Za-z0-9])|(?=ID))"),
    "topic_vtuber": ("1.1.1", r"\bvtuber\b|にじさんじ|ホロライブ|hololive"),
}
TOPICS |= {
    "topic_tech": (
        "1.3.1",
        r"\b(developer|(?<!\b(?:civil|mechanical|electrical|chemical|structural|controls?|audio|sound|recording|mixing|mastering|aerospace|industrial|process|petroleum|mining|nuclear|marine|agricultural|biomedical|automotive)[\s-])engineer|software|full[\s-]?stack)|エンジニア|プログラマ|プログラミング|開発者",
    ),
    "topic_crypto": ("1.3.3", r"\b(crypto(?!graph)|bitcoin|nft|web3|blockchain)|仮想通貨|ビットコイン|ブロックチェーン"),
    "topic_movie": ("1.2.0", r"\b(movie|movies|film|cinema|moviegoer|cinephile)\b|映画|ドラマ|洋画|邦画|映画館|映画鑑賞"),
}
CRYPTO_REFUSED, CRYPTO_DENIED = r"🚫|🈲|❌|禁止|お断り|お断わり", r"\bNG\b|\bno\b|\bnot\b"
NSFW_VERSION, NSFW = "1.6.3", r"\bNSFW\b|(?<![A-Za-z])R-?18(?!\d)|18禁|成人向け|アダルト(?!チルドレン)|無修正"
NSFW_REFUSED = (
    r"(?:\bNSFW\b|\bR-?18\b)[^|｜@\n]{0,20}\bDNI\b",
    r"\bDNI\b[^|｜@\n]{0,20}(?:\bNSFW\b|\bR-?18\b)",
    r"\b(?:not|never)\b[^|｜\n]{0,20}\b(?:support|post|do|draw|share)\b[^|｜\n]{0,40}(?:\bNSFW\b|\bR-?18\b)",
    r"(?:NSFW|R-?18|18禁|成人向け|アダルト)(?:の[^|｜\n]{0,6})?は[✖×✗❌]",
    r"(?:NSFW|R-?18|18禁|成人向け|アダルト|無修正)[^\n]{0,20}(?:受け付け(?:ません|ない)|お断り|拒否|禁止|NG|フォロー(?:は)?(?:しません|していません))",
    r"(?:NSFW|R-?18|18禁|成人向け|アダルト|無修正)[^\n]{0,40}報告",
    r"(?:NSFW|R-?18|18禁|成人向け|アダルト|無修正)(?:版)?→@",
)
POLITICS_VERSION = "1.5.0"
OFFICES = (
    r"(?:自民党|立憲民主党|公明党|共産党|日本維新の会|国民民主党|れいわ新選組|参政党)(?:\s*(?:所属|党員|公認|支部長))",
    r"(?:衆議院議員|参議院議員|県議会議員|市議会議員|国会議員)(?:を)?(?:しています|です|として活動|として働いています|[、,｜∣])",
    r"政治家(?:を)?(?:しています|です|として活動|として働いています|[、,])",
    r"\bstate\s+(?:congressman|senator|politician)\b|\b(?:congressman|senator|politician)\s+(?:for|of|district)\b",
)
FORMER, ASPIRING = r"元\s*$|\bformer\s*$", r"夢は|目指(?:し|す)|なりたい|志望"
AI_VERSION, AI_DECLARED = "1.9.7", r"AI(で)?生成|生成AI|generated (by|using) AI|AI-generated|人工知能(で)?生成|created (by|with|using) AI"
AI_NEGATED = r"しません|していません|しておりません|おりません|しない|していない|ではありません|じゃありません|じゃない|不使用|未使用|不要|禁止|厳禁|やめて(ください)?|出来ません|できません|不可|盗用|盗作|盗品|🚫|🈲|❌|✖|\bNG\b|\bnot\b|\bnever\b|\bno\b"
AI_INSTITUTIONS = r"教授|研究者|代表取締役|\bCEO\b|公式(アカウント)?|メディア|事業|コンサル(ティング)?|規制派|反対派|賛成派|推進(派)?|アドバイザー|著書|委員|エンジニア|\bPdM\b|プロダクトマネージャー|プロダクトオーナー|プロダクト開発|CAMP|ウェビナー|セミナー|活用ノウハウ|解説|考察|紹介します|エバンジェリスト|evangelist|お仕事受付中|お仕事募集中|ジャーナリスト|記者|講師"
AI_OWN = r"画像は|イラストは|作品(です|を投稿)|ヘッダーは|アイコンは|投稿して(います|ます)|保管庫|ポートレート|(?:画像|イラスト|作品)を紹介(?:します|しています)|-generated (images?|art|content|portraits?)|images? are AI"
AI_INTEREST = r"情報収集|実?活用|遊び|勉強中|興味|関心|ウォッチ|ウォチ|先端技術|追って|学ぼう|学ぶ|半導体|銘柄|効率化|業務改善|著作権問題|オタク|マニア"
AI_OPPOSED = r"反生成AI|反AI生成|(?:生成AI|AI生成)(?:に|には)?反対|無断生成AI|(?:生成AI|AI生成).{0,15}(?:嫌い|きらい|認めません|認めない|ブロ(?:ック)?|アンチ)|(?:生成AI|AI生成)(?:は)?(?:一切)?(?:不使用|使用していません|使っていません|使いません)|(?:生成AI|AI生成).{0,6}(?:お断り|お断わり)"
AI_OTHERS, AI_ACCOUNTS = r"(?:生成AI|AI生成).{0,10}(?:して(?:る|いる)|使って(?:る|いる))方", r"(?:生成AI|AI生成).{0,4}アカウント"
AI_RESTRICTED = r"DM|リプ(?:ライ)?限定|お断り|お断わり|禁止|ブロック|フォロバ(?:しない|不可)?|遠慮"
AI_LIST_ENDS = r"[/、,・|｜()（）]"
AI_OPPOSITION_HEADER = r"反対(?:して(?:いる|る))?(?:もの|こと)|嫌いなもの|苦手なもの"
AI_BOILERPLATE = r"as an AI language model|AIが生成|AI(が)?作成した"
#: Topics that posts count for as well, and those without a signal from followees.
POSTS_TOO, BIO_ALONE = ("topic_vrchat",), ("topic_nsfw", "topic_politics")


BOUND = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def pattern(text: str, ignore_case: bool = True) -> str:
    """A pattern with ASCII word bounds and all kinds of white space, whatever letters stand around."""
    out, in_class = [], False
    for token in re.findall(r"\\.|.", text, re.DOTALL):
        in_class = token == "[" or (in_class and token != "]")
        out.append({r"\b": BOUND, r"\s": SPACE if in_class else f"[{SPACE}]"}.get(token, token))
    return ("(?iu)" if ignore_case else "") + "".join(out)


def has(text: Column, wanted: str, ignore_case: bool = True) -> Column:
    return text.rlike(pattern(wanted, ignore_case))


POST = {
    "id": "string", "at_us": "bigint", "text": "string", "is_reply": "boolean", "is_retweet": "boolean", "is_promoted": "boolean", "is_paid": "boolean", "in_reply_to": "string", "urls": "array<string>", "foreign_videos": "bigint", "ai_media": "boolean", "ai_source": "string",
    "parent_text": "string",
}


def bundles(accounts: DataFrame, posts: DataFrame, k: int = 20) -> DataFrame:
    """All accounts with `posts`, their k newest ones, newest first; an account without any has an empty array. Fields that `posts` lacks are null, and links missing there are taken from the text."""
    known = {c: F.col(c) for c in posts.columns}
    known.setdefault("urls", F.regexp_extract_all("text", F.lit(URL), F.lit(0)))
    fields = [known.get(c, F.lit(None)).cast(t).alias(c) for c, t in POST.items()]
    newest = recent(posts.select("account_id", *fields), k)
    by = newest.groupBy("account_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.struct(*POST).alias("p")))), lambda x: x["p"]).alias("posts"))  # k at most
    none = F.array().cast("array<struct<" + ",".join(f"{c}:{t}" for c, t in POST.items()) + ">>")
    return accounts.withColumnRenamed("id", "account_id").join(by, "account_id", "left").withColumn("posts", F.coalesce("posts", none))


def listed_host(name: Column, hosts) -> Column:
    """Which of the hosts a host is, or is a subdomain of; the empty text for none."""
    return F.regexp_extract(name, r"(?:^|\.)(" + "|".join(re.escape(h) for h in hosts) + ")$", 1)


def host(url: Column) -> Column:
    """The host of an http or https address in lower case, without user and port; empty for others."""
    return F.lower(F.regexp_extract(url, r"(?i)^https?:/*(?:[^/?#@]*@)?([^/:?#@]+)", 1))


def amazon_kind(url: Column, name: Column | None = None) -> Column:
    """Of an address (with its host, if known): associate-tag (a retail address with a tag that isn't blank), associates-short-link or null."""
    query = F.regexp_extract(F.split_part(url, F.lit("#"), F.lit(1)), r"\?(.*)$", 1)
    raw = F.regexp_extract(query, r"(?:^|&)tag(?:=([^&]*))?(?=&|$)", 1)
    tagged = has(F.coalesce(F.try_url_decode(raw), raw), r"[^\s]")
    kind = lambda base: F.when(base == SHORT_LINK, "associates-short-link").when((base != "") & tagged, "associate-tag")
    return once(listed_host(host(url) if name is None else name, (*AMAZON, SHORT_LINK)), kind)


def scam_risk(url: Column, hosts: dict[str, str], name: Column | None = None) -> Column:
    """The risk that a list of hosts gives an address (with its host, if known); null where it isn't listed."""
    return F.create_map(*[F.lit(x) for pair in hosts.items() for x in pair])[listed_host(host(url) if name is None else name, hosts)]


def linguistic(text: Column) -> Column:
    """Whether text stays without links, mentions and the prefix of a repost."""
    bare = F.regexp_replace(text, f"(?i)^RT @[0-9A-Za-z_]+:[{SPACE}]*", "")
    for sign, wanted in (("://", f"(?i)https?://[^{SPACE}]+"), ("@", MENTION)):
        bare = once(bare, lambda x: F.when(x.contains(sign), F.regexp_replace(x, wanted, "")).otherwise(x))  # noqa: B023 - called here
    return has(bare, r"[^\s]")


def first_link(posts: Column, kind: str) -> Column:
    """Of the posts in order, and the links of each in order, the first one that has a `kind`: id, kind, host, is_paid and text of its post; null without one."""
    found = F.flatten(F.transform(posts, lambda p: F.transform(F.filter(p["links"], lambda u: u[kind].isNotNull()), lambda u: F.struct(p["id"].alias("id"), u[kind].alias("kind"), u["host"].alias("host"), p["is_paid"].alias("is_paid"), p["text"].alias("text")))))
    return F.get(found, 0)


def _judged(x: Column, prefix: Column, scam_hosts: dict[str, str]) -> Column:
    """A post with what the rules ask of its text and links, each found out once."""
    text, none = x["text"], F.array().cast("array<string>")
    links = F.coalesce(x["urls"], none)
    reposted_answer = x["is_retweet"] & text.startswith(prefix) & F.regexp_replace(F.substring(text, F.length(prefix) + 1, F.length(text)), f"^[{SPACE}]+", "").startswith("@")
    more = {
        "ms": F.floor(x["at_us"] / 1000), "words": linguistic(text), "script": text.rlike(JAPANESE_SCRIPT), "answers": x["is_reply"] | reposted_answer, "has_link": (F.size(links) > 0) | (text.contains("://") & text.rlike(f"https?://[^{SPACE}]")), "plain": normalize_reply(text),
        "marked": ((text.contains("#") & text.rlike(PR_TAG)) | (text.rlike(PR_BRACKET) & text.rlike(JAPANESE))) & ~text.rlike(CAMPAIGN), "pitch": x["is_reply"] & has(text, PITCH.removeprefix("(?i)")),
        "links": F.transform(links, lambda u: once(host(u), lambda name: F.struct(name.alias("host"), amazon_kind(u, name).alias("amazon"), scam_risk(u, scam_hosts, name).alias("scam")))),
    }
    return F.struct(*[x[c].alias(c) for c in POST], *[v.alias(k) for k, v in more.items()])


def regularity(ms: Column) -> Column:
    """Of the gaps between times, in milliseconds, the deviation by the mean; 0 where all are the same time, null without gaps."""
    at = F.array_sort(F.transform(ms, lambda x: x.cast("double")))
    gaps = F.zip_with(F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))), lambda b, a: b - a)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    mean = total(gaps) / F.size(gaps)
    spread = F.sqrt(total(F.transform(gaps, lambda g: (g - mean) * (g - mean))) / F.size(gaps))
    return F.when(F.size(gaps) > 0, F.when(mean == 0, 0.0).otherwise(spread / mean))


def sent_away(away: Column) -> Column:
    """text, target and ms of replies that have a normalised text and a target."""
    fit = F.filter(away, lambda p: ~p["is_retweet"] & p["in_reply_to"].isNotNull() & (p["plain"] != ""))
    return F.transform(fit, lambda p: F.struct(p["plain"].alias("text"), p["in_reply_to"].alias("target"), p["ms"].alias("ms")))


def best_template(sent: str, window_ms: int = DAY_MS) -> Column:
    """Of the column `sent`, the text sent to most targets within a window that starts at one of its replies: targets, replies, span_ms, text; then the one with most replies, the shortest span, the least text. Null without any."""
    inside = lambda e: F.filter(sent, lambda x: (x["text"] == e["text"]) & x["ms"].between(e["ms"], e["ms"] + window_ms))
    windows = F.transform(sent, lambda e: F.struct(e.alias("e"), inside(e).alias("w")))
    each = F.transform(windows, lambda v: F.struct((-F.size(F.array_distinct(v["w"]["target"]))).alias("t"), (-F.size(v["w"])).alias("r"), (F.array_max(v["w"]["ms"]) - v["e"]["ms"]).alias("s"), v["e"]["text"].alias("x")))
    best = F.array_min(each)
    return F.when(best.isNotNull(), F.struct((-best["t"]).alias("targets"), (-best["r"]).alias("replies"), best["s"].alias("span_ms"), best["x"].alias("text")))


def sharers(replies: DataFrame) -> DataFrame:
    """By account: the most other accounts that one of its reply texts was posted by. Texts are told apart by their sha256, so none is sent on."""
    text = F.filter(F.array(normalize_for_similarity(F.col("text"))), long_enough)  # exploded, so that it is normalised once
    rows = replies.where("is_reply").select("account_id", F.col("in_reply_to").alias("target"), F.explode(text).alias("text"))
    rows = kept(rows.select("account_id", F.sha2("text", 256).alias("text"), "target"))
    others = duplicate_replies(rows).select("text", "others")
    return rows.select("account_id", "text").distinct().join(others, "text").groupBy("account_id").agg(F.max("others").alias("sharers"))


def irrelevant(rows: DataFrame) -> DataFrame:
    """account_id, replies (those with a known parent, both with words) and apart (those that have next to nothing of their parent's text)."""
    posts = rows.select("account_id", F.explode("posts").alias("p")).where(F.col("p.is_reply") & ~F.col("p.is_retweet") & F.col("p.parent_text").isNotNull())
    own, parent = normalize_for_similarity(F.col("p.text")), normalize_for_similarity(F.col("p.parent_text"))
    fit = posts.where((utf16_length(own) >= 10) & linguistic(F.col("p.text")) & linguistic(F.col("p.parent_text"))).select("account_id", own.alias("a"), parent.alias("b"))
    return fit.groupBy("account_id").agg(F.count("*").alias("replies_known"), F.count_if(likeness("a", "b") < 0.03).alias("apart"))


def rules(accounts: DataFrame, posts: DataFrame, corpus: DataFrame | None = None, scam_hosts: dict[str, str] = SCAM_HOSTS, k: int = 20, only: tuple[str, ...] | None = None) -> DataFrame:
    """All rules on posts, or `only` those named, for every account, in long form.

    Accounts: id, screen_name, tweet_count, age_days, fetched (whether the recent posts are known); posts: fields of POST with account_id, of which the k newest of each account count; corpus: replies of
    all accounts (account_id, text, is_reply, in_reply_to), `posts` if not given.
    """
    rows = bundles(accounts, posts, k)
    # What one rule alone asks of other rows is left out with it.
    bundled, wanted = rows, lambda key: only is None or key in only
    rows = rows.join(sharers(posts if corpus is None else corpus), "account_id", "left") if wanted("templated_reply_network") else rows.withColumn("sharers", F.lit(0).cast("long"))
    rows = rows.join(irrelevant(bundled), "account_id", "left") if wanted("irrelevant_reply") else rows.withColumns({"replies_known": F.lit(0).cast("long"), "apart": F.lit(0).cast("long")})
    rows = rows.fillna(0, ["sharers", "replies_known", "apart"])
    rows = rows.withColumn("posts", F.transform("posts", lambda x: _judged(x, F.concat(F.lit("RT @"), "screen_name", F.lit(":")), scam_hosts)))
    p, c = F.col("posts"), F.col
    count = lambda f: F.size(F.filter(p, f)).cast("long")
    own = lambda x: ~x["is_reply"] & ~x["is_retweet"]
    rows = rows.withColumns({
        "ids": p["id"], "n": F.size(p).cast("long"), "replies": count(lambda x: x["is_reply"]), "own": count(own), "not_rt": count(lambda x: ~x["is_retweet"]), "not_rt_replies": count(lambda x: ~x["is_retweet"] & x["is_reply"]),
        "span_ms": F.array_max(p["ms"]) - F.array_min(p["ms"]), "variation": F.when(F.size(p) >= 5, regularity(p["ms"])), "bare_links": count(lambda x: own(x) & x["has_link"] & ~x["words"]),
        "own_text": count(lambda x: own(x) & x["words"]), "own_script": count(lambda x: own(x) & x["words"] & x["script"]), "reply_text": count(lambda x: x["answers"] & x["words"]), "reply_script": count(lambda x: x["answers"] & x["words"] & x["script"]),
        "promoted": count(lambda x: x["is_promoted"]), "paid": count(lambda x: ~x["is_retweet"] & x["is_paid"]), "pr_marked": count(lambda x: ~x["is_retweet"] & x["marked"]), "videos": count(lambda x: ~x["is_retweet"] & (F.coalesce(x["foreign_videos"], F.lit(0)) > 0)),
        "ai": F.filter(p, lambda x: F.coalesce(x["ai_media"], F.lit(False))), "mine": F.filter(p, lambda x: ~x["is_retweet"]),
    })
    in_thread = lambda x: F.coalesce(F.array_contains(c("ids"), x["in_reply_to"]), F.lit(False))
    rows = rows.withColumns({
        "away": F.filter(p, lambda x: x["is_reply"] & ~in_thread(x)), "said": F.filter("mine", lambda x: ~(x["is_reply"] & in_thread(x)) & (x["plain"] != "")), "amazon": first_link(c("mine"), "amazon"),
        "ad_amazon": first_link(F.filter("mine", lambda x: x["is_promoted"]), "amazon"), "scam": first_link(c("mine"), "scam"),
    })
    texts = lambda reply: F.filter("said", lambda x: x["is_reply"] == reply)["plain"]
    rows = rows.withColumns({"pairs": F.size(F.array_intersect(texts(True), texts(False))).cast("long"), "aways": F.size("away").cast("long"), "pitches": F.size(F.filter("away", lambda x: x["pitch"])).cast("long"), "sent": sent_away(c("away"))})
    rows = rows.withColumn("template", best_template("sent"))
    return long_form(rows, {key: rule for key, rule in _table().items() if wanted(key)})


def _table() -> dict[str, tuple[str, Column, Column, Column, Column]]:
    c, none, one = F.col, F.lit(0.0), F.lit(1.0)
    ratio = lambda a, b, missing: F.when(c(b) > 0, c(a) / c(b)).otherwise(float(missing))
    put = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    n, fetched = c("n"), c("fetched")
    lifetime = c("tweet_count") / F.greatest(c("age_days"), one)
    lately = F.when(n < 2, 0.0).otherwise((n - 1) / F.greatest(c("span_ms") / DAY_MS, F.lit(1 / 24)))
    fast, speed = (lifetime >= 150) & (lately >= 50), F.least(ramp(lifetime, 150, 150), ramp(lately, 50, 50))
    pace = put("tweetsPerDay=", fixed(lifetime, 1), ", recentTweetsPerDay=", fixed(lately, 1))
    answers, originals, asked = ratio("not_rt_replies", "not_rt", 1), ratio("own", "n", 1), ratio("replies", "n", 0)
    bare, pitch = ratio("bare_links", "own", 0), ratio("pitches", "aways", 0)
    mine, theirs = ratio("own_script", "own_text", 0), ratio("reply_script", "reply_text", 0)
    differ, both_sides = F.abs(mine - theirs), (c("own_text") >= 3) & (c("reply_text") >= 3)
    odd = F.greatest(none, F.least(one, 0.5 + (differ - 0.7) * 0.5 / (0.3 * F.sqrt(3 / F.least("own_text", "reply_text")))))
    marked, paid, promoted = c("pr_marked") > 0, c("paid") > 0, c("promoted") > 0
    when = lambda cond, score: F.when(cond, score).otherwise(0.0)
    linked = lambda name, short: F.when(c(f"{name}.kind") == "associate-tag", 1.0).when(c(name).isNotNull(), short).otherwise(0.0)
    evidence = lambda name: put("tweet=", c(f"{name}.id"), ", evidence=", c(f"{name}.kind"), ", host=", c(f"{name}.host"))
    told = lambda reason, otherwise: F.coalesce(reason, F.lit(otherwise))
    template, many = c("template"), F.coalesce(c("template.targets") >= 5, F.lit(False))
    enough_known = fetched & (c("replies_known") >= 5)
    apart = ratio("apart", "replies_known", 0) >= 0.6
    return {
        "bot": ("1.6.0", fast & (c("not_rt") >= 5) & (answers < 0.05) & F.coalesce(c("variation") < 0.2, F.lit(False)), F.least(speed, when(c("not_rt") >= 5, ramp(answers, 0.05, 0.05, above=False)), F.coalesce(ramp(c("variation"), 0.2, 0.2, above=False), none)), (c("not_rt") >= 5) & (n >= 5),
            put(pace, ", replyRatio=", fixed(answers, 2), " (originalPosts=", c("not_rt"), "/", n, "), intervalCoV=", F.coalesce(fixed(c("variation"), 2), F.lit("n/a")))),
        "reply_farming": ("1.4.1", fast & (n >= 5) & (originals <= 0.05) & (asked >= 0.5), F.least(speed, ramp(originals, 0.05, 0.05, above=False), ramp(asked, 0.5, 0.5)), n >= 5, put(pace, ", originalContentRatio=", fixed(originals, 2), ", replyRatio=", fixed(asked, 2), " (n=", n, ")")),
        "self_duplicate_reply": ("1.3.0", c("pairs") >= 2, ramp(c("pairs"), 2, 2), n > 0, put("selfDuplicatePostReplyPairs=", c("pairs"))),
        "templated_reply_network": ("1.3.0", c("sharers") >= 5, ramp(c("sharers"), 5, 5), (c("sharers") >= 5) | fetched, put("templatedReplyNetworkSize=", c("sharers"))),
        "cross_target_templated_reply": ("1.2.0", many, when(many, ramp(c("template.targets"), 5, 5)), many | fetched,
            told(F.when(many, put("targetCount=", template["targets"], ", replies=", template["replies"], ", spanHours=", fixed(template["span_ms"] / 3_600_000, 1), ", textHash=", F.substring(F.sha2(template["text"], 256), 1, 16))), "no cross-target templated reply group found")),
        "bare_link_spam": ("1.0.0", (c("own") >= 5) & (bare >= 0.6), when(c("own") >= 5, posterior_at_least(c("bare_links").cast("int"), c("own").cast("int"), 0.6)), (c("own") >= 5) & fetched, put("bareLinkRatio=", fixed(bare, 2), " (n=", c("bare_links"), "/", c("own"), ")")),
        "ad_reply_hijack": ("1.3.0", (c("aways") >= 3) & (pitch >= 0.5), when(c("aways") >= 3, posterior_at_least(c("pitches").cast("int"), c("aways").cast("int"), 0.5)), c("aways") >= 3, put("adPitchReplies=", c("pitches"), "/", c("aways"), " (ratio=", fixed(pitch, 2), ")")),
        "reply_language_mismatch": ("1.3.0", both_sides & (differ >= 0.7), when(both_sides, odd), both_sides, put("ownJapaneseRatio=", fixed(mine, 2), " (n=", c("own_text"), "), replyJapaneseRatio=", fixed(theirs, 2), " (n=", c("reply_text"), ")")),
        "irrelevant_reply": ("1.0.0", enough_known & apart, when(enough_known, posterior_at_least(c("apart").cast("int"), c("replies_known").cast("int"), 0.6)), enough_known,
            F.when(~fetched, "recentTweets not evaluable").when(~enough_known, put("insufficient reply-with-parent sample (n=", c("replies_known"), ")")).otherwise(put("irrelevantReplies=", c("apart"), "/", c("replies_known")))),
        "ad_promoted": ("1.1.0", promoted, when(promoted, 1.0), promoted | fetched, put("promotedTweetCount=", c("promoted"), " (n=", n, ")")),
        "ad_pr_hashtag": ("1.5.0", marked | paid, F.when(marked & paid, 1.0).when(marked | paid, 0.6).otherwise(none), marked | paid | ((c("not_rt") > 0) & fetched), put("prHashtag=", marked, ", paidPromotionDisclosure=", paid, " (n=", c("not_rt"), ")")),
        "amazon_affiliate_link": ("1.0.1", c("amazon").isNotNull(), linked("amazon", 0.9), F.lit(True), told(evidence("amazon"), "no Amazon affiliate link evidence")),
        "amazon_affiliate_promoted": ("1.1.0", c("ad_amazon").isNotNull(), linked("ad_amazon", 0.95), c("ad_amazon").isNotNull() | fetched,
            told(put(evidence("ad_amazon"), ", paidPromotion=", c("ad_amazon.is_paid"), ", prDisclosure=", c("ad_amazon.text").rlike(AD_PR)), "no promoted original tweet with Amazon affiliate link evidence")),
        "scam_link_domain": ("1.1.0", c("scam").isNotNull(), when(c("scam").isNotNull(), 1.0), c("scam").isNotNull() | fetched, told(put("tweet=", c("scam.id"), ", host=", c("scam.host"), ", sourceRisk=", c("scam.kind")), "no scam link domain evidence")),
        "video_repost": ("2.1.0", c("videos") >= 3, when(c("videos") >= 3, 1.0), (c("videos") >= 3) | fetched, put("foreignVideoPostCount=", c("videos"), " (n=", n, ")")),
        "tweet_ai_generated_media": ("1.0.0", *_ai_media()),
    }


def _ai_media() -> tuple[Column, Column, Column, Column]:
    """A negative has confidence 0 here, not 1; sources are told in the order of the posts."""
    flagged = F.col("ai")
    weight = lambda x: F.coalesce(*[F.when(x["ai_source"] == s, w) for s, w in AI_SOURCES.items()], F.lit(AI_SOURCE_UNKNOWN))
    sources = F.array_join(F.array_distinct(F.transform(flagged, lambda x: F.coalesce(x["ai_source"], F.lit("unknown")))), ",")
    value = F.size(flagged) > 0
    score = F.when(value, F.array_max(F.transform(flagged, weight))).otherwise(1.0)  # 1 less that is 0
    return value, score, F.lit(True), F.concat(F.lit("aiGeneratedMediaTweetCount="), F.size(flagged).cast("string"), F.lit(" (n="), F.col("n").cast("string"), F.lit("), sources="), F.when(sources == "", "none").otherwise(sources))


def long_form(rows: DataFrame, table: dict[str, tuple[str, Column, Column, Column, Column]]) -> DataFrame:
    """Each rule's parts are columns first: what is exploded is worked out without code made for it, and then each part as often as it is named."""
    parts = [c.alias(f"{i}_{name}") for i, rule in enumerate(table.values()) for name, c in zip(("value", "score", "evaluable", "reason"), rule[1:])]
    each = F.explode(F.array(*[
        F.struct(F.lit(key).alias("label_key"), F.lit(rule[0]).alias("rule_version"), *[F.col(f"{i}_{name}").alias(name) for name in ("value", "score", "evaluable", "reason")])
        for i, (key, rule) in enumerate(table.items())
    ]))
    found = rows.select("account_id", *parts).select("account_id", each.alias("r")).select("account_id", "r.*")
    sure = F.round(confidence(F.col("value"), F.col("score"), F.col("evaluable")), 6)
    return found.select("account_id", "label_key", "rule_version", "value", sure.alias("confidence"), "evaluable", "reason")


def crypto_meant(bio: Column) -> Column:
    """Whether a mention stands free of refusals near it, and of denials right beside it."""
    near = contexts(bio, pattern(TOPICS["topic_crypto"][1]), 15, 15)
    beside = contexts(bio, pattern(TOPICS["topic_crypto"][1]), 4, 4)
    refused = F.transform(near, lambda m: m["before"].rlike(CRYPTO_REFUSED) | m["after"].rlike(CRYPTO_REFUSED))
    denied = F.transform(beside, lambda m: has(m["before"], CRYPTO_DENIED) | has(m["after"], CRYPTO_DENIED))
    return has(bio, TOPICS["topic_crypto"][1]) & F.exists(F.zip_with(refused, denied, lambda a, b: ~a & ~b), lambda x: x)


def movie_meant(bio: Column) -> Column:
    """Whether the first mention is no item of a list of tags with two delimiters or more."""
    m = F.get(contexts(bio, pattern(TOPICS["topic_movie"][1]), 1, 1), 0)
    listed = (F.regexp_count(bio, F.lit(r"[/|]")) >= 2) & (m["before"].isin("/", "|") | m["after"].isin("/", "|"))
    return has(bio, TOPICS["topic_movie"][1]) & ~listed


def office_held(bio: Column) -> Column:
    """Whether the first mention of any kind of office is neither a former one nor one to be."""
    out = F.lit(False)
    for office in OFFICES:
        m = F.get(contexts(bio, pattern(office), 15, 0), 0)
        former = has(F.right(m["before"], F.lit(10)), FORMER)
        out = out | (has(bio, office) & ~former & ~m["before"].rlike(ASPIRING))
    return out


def nsfw_meant(bio: Column) -> Column:
    refused = F.lit(False)
    for r in NSFW_REFUSED:
        refused = refused | has(bio, r)
    return has(bio, NSFW) & ~refused


def ai_declared(bio: Column) -> Column:
    """Whether a bio says that its account's own works are generated: not negated or opposed, nor an institution's, an interest, about others, or an item of a list."""
    m = F.get(contexts(bio, pattern(AI_DECLARED), 40, 30), 0)
    near = F.right(m["before"], F.lit(30))
    negated = has(near, AI_NEGATED) | has(m["after"], AI_NEGATED)
    own = has(bio, AI_OWN)
    named = F.get(contexts(bio, pattern(AI_ACCOUNTS, False), 20, 20), 0)
    restricted = F.coalesce(named["before"].rlike(AI_RESTRICTED) | named["after"].rlike(AI_RESTRICTED), F.lit(False))
    about_others = bio.rlike(AI_OTHERS) | restricted
    # What stands right before and behind the first mention, white space aside.
    start, end = m["start"], m["start"] + F.length(m["match"])
    left, right = F.regexp_replace(F.substring(bio, F.lit(1), start), f"[{SPACE}]+\\z", ""), F.regexp_replace(F.substring(bio, end + 1, F.length(bio)), f"^[{SPACE}]+", "")
    item = ((left == "") | F.right(left, F.lit(1)).rlike(AI_LIST_ENDS)) & ((right == "") | F.left(right, F.lit(1)).rlike(AI_LIST_ENDS))
    indirect = has(bio, AI_INSTITUTIONS) | has(bio, AI_INTEREST) | about_others | item
    return F.coalesce(has(bio, AI_DECLARED) & ~negated & ~has(bio, AI_OPPOSED) & ~(indirect & ~own) & ~m["before"].rlike(AI_OPPOSITION_HEADER), F.lit(False))


def topic_rules(accounts: DataFrame, signals: DataFrame, posts: DataFrame, k: int = 20) -> DataFrame:
    """Topics by the bio's words, for some by the own posts' too, or by followees that have the topic (15 or more of them judged, 0.3 of these with it); and the rules on bios alone, ai-generated among them.

    Accounts: id, bio; signals: account_id, label_key, followee_total, followee_labeled; posts: fields of POST with account_id.
    """
    rows = bundles(accounts.select("id", "bio"), posts, k)
    vr = TOPICS["topic_vrchat"][1]
    own = F.filter("posts", lambda x: ~x["is_retweet"])
    rows = rows.select("account_id", "bio", F.exists(own, lambda x: has(x["text"], vr)).alias("in_posts"), (F.size(own) > 0).alias("has_own"), F.exists("posts", lambda x: has(x["text"], AI_BOILERPLATE)).alias("boilerplate"))
    bio, no = F.col("bio"), F.lit(False)
    meant = {"topic_crypto": crypto_meant(bio), "topic_movie": movie_meant(bio), "topic_vrchat": has(bio, vr) | F.col("in_posts"), "topic_nsfw": nsfw_meant(bio), "topic_politics": office_held(bio)}
    versions = {k_: v for k_, (v, _) in TOPICS.items()} | {"topic_nsfw": NSFW_VERSION, "topic_politics": POLITICS_VERSION}
    meant = {k_: F.coalesce(meant.get(k_, has(bio, TOPICS[k_][1]) if k_ in TOPICS else no), no if k_ not in POSTS_TOO else F.col("in_posts")) for k_ in versions}
    table = F.explode(F.array(*[F.struct(F.lit(k_).alias("label_key"), F.lit(v).alias("rule_version"), F.col(f"hit_{k_}").alias("hit")) for k_, v in versions.items()]))
    found = rows.select("account_id", "bio", "has_own", *[c.alias(f"hit_{k_}") for k_, c in meant.items()])  # columns first, as in long_form
    each = found.select("account_id", "bio", "has_own", table.alias("t")).select("account_id", "bio", "has_own", "t.*").join(signals.select("account_id", "label_key", "followee_total", "followee_labeled"), ["account_id", "label_key"], "left")
    alone, too = F.col("label_key").isin(*BIO_ALONE), F.col("label_key").isin(*POSTS_TOO)
    judged, hit = F.coalesce(F.col("followee_total") >= 15, no) & ~alone, F.col("hit")
    matched = judged & (F.col("followee_labeled") / F.col("followee_total") >= 0.3)
    score = F.greatest(F.when(hit, 0.8).otherwise(0.0), F.when(judged, posterior_at_least(F.col("followee_labeled"), F.col("followee_total"), 0.3)).otherwise(0.0))
    evaluable = alone | bio.isNotNull() | judged | (too & F.col("has_own"))
    value = hit | matched
    reason = F.concat(F.when(too, "bio/tweet ").otherwise("bio "), F.substring("label_key", 7, 30), F.lit("-keyword match="), hit.cast("string"), F.when(alone, "").otherwise(F.concat(F.lit(", follow-graph match="), matched.cast("string"))))
    topics = each.select("account_id", "label_key", "rule_version", value.alias("value"), F.round(confidence(value, score, evaluable), 6).alias("confidence"), evaluable.alias("evaluable"), reason.alias("reason"))
    declared = ai_declared(bio)
    sure = F.when(declared, F.when(F.col("boilerplate"), 1.0).otherwise(0.7)).otherwise(0.0)
    told = F.concat(F.lit("bio declaration="), declared.cast("string"), F.lit(", corroborating tweet="), F.col("boilerplate").cast("string"))
    return topics.unionByName(long_form(rows, {"ai-generated": (AI_VERSION, declared, sure, F.lit(True), told)}))

"""The rules' queries in DuckDB SQL, over the driver's views."""


POSTS = """p AS (SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS account_id, epoch_us(ts) AS at_us, event_type IN ('click', 'error') AS is_reply, event_type = 'view' AS is_retweet,
 event_type = 'purchase' AS is_promoted, CASE WHEN event_type IN ('click', 'error') AND event_id % 4 <> 0 THEN json_extract_string(props, '$.k') END AS in_reply_to, event_id % 17 = 0 AS foreign_video, event_id % 29 = 0 AS is_paid,
 CASE event_id % 10 WHEN 0 THEN 'https://t.co/a' || (event_id % 13) WHEN 1 THEN 'Limited offer for everyone today, visit the page right now' WHEN 2 THEN '@user' || (event_id % 5) || ' Limited offer for everyone today, visit the page right now'
 WHEN 3 THEN 'こんにちは、今日はとても良い天気ですね。散歩に行きましょう' WHEN 4 THEN 'see https://www.amazon.co.jp/dp/' || event_id || '?tag=shop-22 for it' WHEN 5 THEN 'new deal https://amzn.to/' || event_id WHEN 6 THEN '#PR 新しい商品のご紹介です'
 WHEN 7 THEN 'post number ' || (event_id % 50) || ' about the daily walk in the park' WHEN 8 THEN 'https://login.scam.example/' || event_id ELSE '@user7 free airdrop, claim now ' || (event_id % 20) END AS text FROM events)"""
NORMAL = """q AS (SELECT *, trim(lower(regexp_replace(regexp_replace(regexp_replace(text, 'https?://\\S+', '', 'g'), '@\\w+', '', 'g'), '\\s+', ' ', 'g'))) AS plain FROM p)"""
SHARED = """g AS (SELECT plain, count(DISTINCT account_id) AS authors, count(DISTINCT in_reply_to) AS targets, count(*) AS n, bool_or(in_reply_to IS NULL) AS unknown_target FROM q WHERE is_reply AND length(plain) >= 20 GROUP BY 1),
 sh AS (SELECT *, CASE WHEN NOT unknown_target AND targets = 1 THEN 0 ELSE authors - 1 END AS others FROM g)"""


def ramp(value: str, at: str, width: str, below: bool = False) -> str:
    gap = f"({at} - ({value}))" if below else f"(({value}) - {at})"
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + {gap} * 0.5::DOUBLE / {width}))"


def posterior(s: str, n: str, rate: str) -> str:
    term = f"exp(lgamma({n} + 2) - lgamma(j + 1) - lgamma({n} - j + 2) + j * ln({rate}::DOUBLE) + ({n} + 1 - j) * ln(1 - {rate}::DOUBLE))"
    return f"list_sum(list_transform(range(0, CAST({s} AS BIGINT) + 1), lambda j: {term}))"


# Fifteen kinds of accounts: what each post is, by the account's number u, its kind p and the post's place k, said by hand.
PERSONAS = """u AS (SELECT user_id AS u, event_id AS e, row_number() OVER w - 1 AS k, lag(event_id) OVER w AS earlier, user_id % 15 AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
 q AS (SELECT *, CAST(u AS VARCHAR) AS account_id, CAST(e AS VARCHAR) AS id, 1704067200000 + (k * CASE p WHEN 0 THEN 10 WHEN 1 THEN 15 WHEN 4 THEN 30 WHEN 5 THEN 600 ELSE 120 END + (k % 2) * u % 4) * 60000 AS ms,
  p IN (1, 4, 5, 7) OR (p IN (2, 3) AND k % 2 = 1) OR (p = 8 AND k % 4 = 3) AS reply, (p = 8 AND k % 4 = 1) OR (p = 12 AND k % 4 = 0) OR (p = 14 AND k % 9 = 0) AS rt,
  CASE WHEN p = 1 OR p = 5 THEN 't' || k WHEN p = 2 AND k % 2 = 1 THEN 't' WHEN p = 3 AND k % 2 = 1 THEN CAST(earlier AS VARCHAR) WHEN p = 4 THEN CASE WHEN k % 5 = 4 THEN CAST(earlier AS VARCHAR) ELSE 't' || u || '-' || k END WHEN p = 7 AND k % 4 <> 1 THEN 't' WHEN p = 8 AND k % 4 = 3 THEN 'x' END AS target,
  CASE WHEN p = 0 THEN 'post number ' || k || ' about the daily walk' WHEN p = 1 THEN 'thanks for sharing, reply number ' || k WHEN p IN (2, 3) THEN CASE WHEN k % 4 < 2 THEN 'a story that i tell again and again' ELSE 'another story that i tell to everyone' END
   WHEN p = 4 THEN 'congratulations to everyone here 🎉 follow for more' WHEN p = 5 THEN 'a fixed greeting to all of my friends ' || u WHEN p = 7 THEN CASE WHEN k % 3 <> 0 THEN 'free airdrop, claim now ' || k ELSE 'nice picture of the sea' END ELSE '' END AS plain,
  NOT (p = 6 AND k % 5 <> 0) AS words, (p = 8 AND k % 2 = 0) OR (p = 13 AND k % 3 < 2) AS script, p = 6 AS link, p = 7 AND k % 3 <> 0 AS pitch, (p = 9 AND k % 6 = 0) OR (p = 13 AND k % 3 = 0) AS marked, p = 9 AND k % 3 = 0 AS promoted, p IN (9, 13) AND u % 2 = 0 AS paid,
  p = 14 AND k % 6 = 0 AS video, p = 14 AND k % 10 = 0 AS ai, CASE WHEN u % 3 > 0 THEN CASE WHEN k % 20 = 0 THEN 'UserDeclared' ELSE 'Novel' END ELSE 'unknown' END AS ai_source FROM u),
 r AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY ms DESC, id DESC) <= 20),
 o AS (SELECT r.*, own.id IS NOT NULL AS thread FROM r LEFT JOIN r own ON own.account_id = r.account_id AND own.id = r.target),
 a AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_custkey % 11 <> 0 AS fetched, 30 + c_custkey % 10 AS age, (30 + c_custkey % 10) * CASE WHEN c_custkey % 15 < 2 THEN 190 + c_custkey % 7 * 30 ELSE 10 END AS tweets FROM customer)"""
FACTS = """g AS (SELECT account_id, CASE WHEN avg(d) = 0 THEN 0 ELSE stddev_pop(d) / avg(d) END AS cov FROM (SELECT account_id, ms - lag(ms) OVER (PARTITION BY account_id ORDER BY ms) AS d FROM r) WHERE d IS NOT NULL GROUP BY 1),
 sd AS (SELECT account_id, count(*) AS pairs FROM (SELECT account_id, plain FROM o WHERE NOT rt AND NOT (reply AND thread) AND plain <> '' GROUP BY 1, 2 HAVING bool_or(reply) AND bool_or(NOT reply)) GROUP BY 1),
 h AS (SELECT plain, CASE WHEN NOT bool_or(target IS NULL) AND count(DISTINCT target) = 1 THEN 0 ELSE count(DISTINCT account_id) - 1 END AS others FROM q WHERE reply AND plain <> '' GROUP BY 1), nw AS (SELECT account_id, max(others) AS sharers FROM q JOIN h USING (plain) WHERE reply GROUP BY 1),
 y AS (SELECT account_id, plain, target, ms FROM o WHERE reply AND NOT rt AND NOT thread AND target IS NOT NULL AND plain <> ''),
 z AS (SELECT account_id, plain, targets, replies, span FROM (SELECT b.account_id, b.plain, b.ms, count(DISTINCT x.target) AS targets, count(*) AS replies, max(x.ms) - b.ms AS span FROM y b JOIN y x ON x.account_id = b.account_id AND x.plain = b.plain AND x.ms BETWEEN b.ms AND b.ms + 86400000 GROUP BY b.account_id, b.plain, b.target, b.ms)
  QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY targets DESC, replies DESC, span, plain) = 1),
 c AS (SELECT account_id, any_value(p) AS p, any_value(u) AS u, count(*) AS n, count(*) FILTER (reply) AS replies, count(*) FILTER (NOT reply AND NOT rt) AS own, count(*) FILTER (NOT rt) AS not_rt, count(*) FILTER (NOT rt AND reply) AS not_rt_replies, max(ms) - min(ms) AS span_ms,
  count(*) FILTER (NOT reply AND NOT rt AND link AND NOT words) AS bare, count(*) FILTER (NOT reply AND NOT rt AND words) AS own_text, count(*) FILTER (NOT reply AND NOT rt AND words AND script) AS own_script, count(*) FILTER (words AND (reply OR (rt AND p = 8))) AS reply_text, count(*) FILTER (words AND script AND (reply OR (rt AND p = 8))) AS reply_script,
  count(*) FILTER (reply AND NOT thread) AS aways, count(*) FILTER (reply AND NOT thread AND pitch) AS pitches, count(*) FILTER (promoted) AS promoted, count(*) FILTER (paid AND NOT rt) AS paid, count(*) FILTER (marked AND NOT rt) AS marked, count(*) FILTER (video AND NOT rt) AS videos, count(*) FILTER (ai) AS ai,
  max(CASE ai_source WHEN 'UserDeclared' THEN 0.9 ELSE 0.6 END) FILTER (ai) AS ai_score, count(DISTINCT ai_source) FILTER (ai) AS ai_kinds, arg_max(ai_source, ms) FILTER (ai) AS ai_first, arg_min(ai_source, ms) FILTER (ai) AS ai_last, arg_max(id, ms) AS newest, arg_max(id, ms) FILTER (promoted) AS newest_ad, arg_max(k, ms) FILTER (promoted) AS ad_k,
  arg_max(id, ms) FILTER (NOT rt AND p = 12 AND k % 2 = 0) AS scam, count(*) FILTER (p IN (1, 7)) AS known, count(*) FILTER (p = 1 AND k % 4 <> 0) AS apart FROM o GROUP BY 1),
 f AS (SELECT a.id AS account_id, fetched, tweets / greatest(age, 1) AS lifetime, coalesce(c.n, 0) AS n, coalesce(p, -1) AS p, coalesce(u, 0) AS u, coalesce(c.replies, 0) AS replies, coalesce(own, 0) AS own, coalesce(not_rt, 0) AS not_rt, coalesce(bare, 0) AS bare, coalesce(own_text, 0) AS own_text, coalesce(reply_text, 0) AS reply_text, coalesce(aways, 0) AS aways,
  coalesce(pitches, 0) AS pitches, coalesce(promoted, 0) AS promoted, coalesce(paid, 0) > 0 AS paid, coalesce(marked, 0) > 0 AS marked, coalesce(videos, 0) AS videos, coalesce(ai, 0) AS ai, ai_score, ai_kinds, ai_first, ai_last, newest, newest_ad, ad_k, scam, coalesce(known, 0) AS known, coalesce(apart, 0) AS apart, coalesce(pairs, 0) AS pairs, coalesce(sharers, 0) AS sharers,
  CASE WHEN coalesce(c.n, 0) < 2 THEN 0 ELSE (c.n - 1) / greatest(span_ms / 86400000, 1 / 24) END AS lately, CASE WHEN not_rt > 0 THEN not_rt_replies / not_rt ELSE 1 END AS answers, CASE WHEN c.n > 0 THEN own / c.n ELSE 1 END AS originals, CASE WHEN c.n > 0 THEN c.replies / c.n ELSE 0 END AS asked, CASE WHEN c.n >= 5 THEN cov END AS cov,
  CASE WHEN own > 0 THEN bare / own ELSE 0 END AS bare_share, CASE WHEN aways > 0 THEN pitches / aways ELSE 0 END AS pitch, CASE WHEN own_text > 0 THEN own_script / own_text ELSE 0 END AS mine, CASE WHEN reply_text > 0 THEN reply_script / reply_text ELSE 0 END AS theirs, CASE WHEN known > 0 THEN apart / known ELSE 0 END AS apart_share,
  CASE WHEN z.targets >= 5 THEN z.targets END AS targets, z.replies AS sent, z.span, z.plain FROM a LEFT JOIN c ON c.account_id = a.id LEFT JOIN g ON g.account_id = a.id LEFT JOIN sd ON sd.account_id = a.id LEFT JOIN nw ON nw.account_id = a.id LEFT JOIN z ON z.account_id = a.id)"""


def fixed(x: str, digits: int) -> str:
    """With so many decimals; printf rounds a half that is stored exactly to the even digit, so those are raised a little."""
    return f"printf('%.{digits}f', ({x}) + CASE WHEN ({x}) * 1024 = floor(({x}) * 1024) THEN 1e-12 ELSE 0 END)"


def rule(key: str, version: str, value: str, score: str, evaluable: str, reason: str) -> str:
    return f"SELECT account_id, '{key}' AS label_key, '{version}' AS rule_version, {value} AS value, {score} AS score, {evaluable} AS evaluable, {reason} AS reason FROM f"


SPEED, FAST = f"least({ramp('lifetime', '150', '150')}, {ramp('lately', '50', '50')})", "(lifetime >= 150 AND lately >= 50)"
PACE = f"'tweetsPerDay=' || {fixed('lifetime', 1)} || ', recentTweetsPerDay=' || {fixed('lately', 1)}"
DIFFER, BOTH = "abs(mine - theirs)", "(own_text >= 3 AND reply_text >= 3)"
RULES = [
    rule("bot", "1.6.0", f"{FAST} AND not_rt >= 5 AND answers < 0.05::DOUBLE AND coalesce(cov < 0.2::DOUBLE, false)", f"least({SPEED}, CASE WHEN not_rt >= 5 THEN {ramp('answers', '0.05::DOUBLE', '0.05::DOUBLE', True)} ELSE 0 END, CASE WHEN cov IS NULL THEN 0 ELSE {ramp('cov', '0.2::DOUBLE', '0.2::DOUBLE', True)} END)", "not_rt >= 5 AND n >= 5",
         f"{PACE} || ', replyRatio=' || {fixed('answers', 2)} || ' (originalPosts=' || not_rt || '/' || n || '), intervalCoV=' || coalesce({fixed('cov', 2)}, 'n/a')"),
    rule("reply_farming", "1.4.1", f"{FAST} AND n >= 5 AND originals <= 0.05::DOUBLE AND asked >= 0.5", f"least({SPEED}, {ramp('originals', '0.05::DOUBLE', '0.05::DOUBLE', True)}, {ramp('asked', '0.5', '0.5::DOUBLE')})", "n >= 5",
         f"{PACE} || ', originalContentRatio=' || {fixed('originals', 2)} || ', replyRatio=' || {fixed('asked', 2)} || ' (n=' || n || ')'"),
    rule("self_duplicate_reply", "1.3.0", "pairs >= 2", ramp("pairs", "2", "2"), "n > 0", "'selfDuplicatePostReplyPairs=' || pairs"),
    rule("templated_reply_network", "1.3.0", "sharers >= 5", ramp("sharers", "5", "5"), "sharers >= 5 OR fetched", "'templatedReplyNetworkSize=' || sharers"),
    rule("cross_target_templated_reply", "1.2.0", "targets IS NOT NULL", f"CASE WHEN targets IS NOT NULL THEN {ramp('targets', '5', '5')} ELSE 0 END", "targets IS NOT NULL OR fetched",
         f"CASE WHEN targets IS NULL THEN 'no cross-target templated reply group found' ELSE 'targetCount=' || targets || ', replies=' || sent || ', spanHours=' || {fixed('span / 3600000', 1)} || ', textHash=' || left(sha256(plain), 16) END"),
    rule("bare_link_spam", "1.0.0", "own >= 5 AND bare_share >= 0.6::DOUBLE", f"CASE WHEN own >= 5 THEN {posterior('bare', 'own', '0.6')} ELSE 0 END", "own >= 5 AND fetched", f"'bareLinkRatio=' || {fixed('bare_share', 2)} || ' (n=' || bare || '/' || own || ')'"),
    rule("ad_reply_hijack", "1.3.0", "aways >= 3 AND pitch >= 0.5", f"CASE WHEN aways >= 3 THEN {posterior('pitches', 'aways', '0.5')} ELSE 0 END", "aways >= 3", f"'adPitchReplies=' || pitches || '/' || aways || ' (ratio=' || {fixed('pitch', 2)} || ')'"),
    rule("reply_language_mismatch", "1.3.0", f"{BOTH} AND {DIFFER} >= 0.7::DOUBLE", f"CASE WHEN {BOTH} THEN {ramp(DIFFER, '0.7::DOUBLE', '(0.3::DOUBLE * sqrt(3.0::DOUBLE / least(own_text, reply_text)))')} ELSE 0 END", BOTH,
         f"'ownJapaneseRatio=' || {fixed('mine', 2)} || ' (n=' || own_text || '), replyJapaneseRatio=' || {fixed('theirs', 2)} || ' (n=' || reply_text || ')'"),
    rule("irrelevant_reply", "1.0.0", "fetched AND known >= 5 AND apart_share >= 0.6::DOUBLE", f"CASE WHEN fetched AND known >= 5 THEN {posterior('apart', 'known', '0.6')} ELSE 0 END", "fetched AND known >= 5",
         "CASE WHEN NOT fetched THEN 'recentTweets not evaluable' WHEN known < 5 THEN 'insufficient reply-with-parent sample (n=' || known || ')' ELSE 'irrelevantReplies=' || apart || '/' || known END"),
    rule("ad_promoted", "1.1.0", "promoted > 0", "CASE WHEN promoted > 0 THEN 1 ELSE 0 END", "promoted > 0 OR fetched", "'promotedTweetCount=' || promoted || ' (n=' || n || ')'"),
    rule("ad_pr_hashtag", "1.5.0", "marked OR paid", "CASE WHEN marked AND paid THEN 1 WHEN marked OR paid THEN 0.6 ELSE 0 END", "marked OR paid OR (not_rt > 0 AND fetched)", "'prHashtag=' || marked || ', paidPromotionDisclosure=' || paid || ' (n=' || not_rt || ')'"),
    rule("amazon_affiliate_link", "1.0.1", "p IN (9, 10)", "CASE p WHEN 9 THEN 1 WHEN 10 THEN 0.9 ELSE 0 END", "true",
         "CASE p WHEN 9 THEN 'tweet=' || newest || ', evidence=associate-tag, host=www.amazon.co.jp' WHEN 10 THEN 'tweet=' || newest || ', evidence=associates-short-link, host=amzn.to' ELSE 'no Amazon affiliate link evidence' END"),
    rule("amazon_affiliate_promoted", "1.1.0", "p = 9 AND newest_ad IS NOT NULL", "CASE WHEN p = 9 AND newest_ad IS NOT NULL THEN 1 ELSE 0 END", "(p = 9 AND newest_ad IS NOT NULL) OR fetched",
         "CASE WHEN p = 9 AND newest_ad IS NOT NULL THEN 'tweet=' || newest_ad || ', evidence=associate-tag, host=www.amazon.co.jp, paidPromotion=' || (u % 2 = 0) || ', prDisclosure=' || (ad_k % 6 = 0) ELSE 'no promoted original tweet with Amazon affiliate link evidence' END"),
    rule("scam_link_domain", "1.1.0", "scam IS NOT NULL", "CASE WHEN scam IS NOT NULL THEN 1 ELSE 0 END", "scam IS NOT NULL OR fetched", "coalesce('tweet=' || scam || ', host=sub.1link.jp, sourceRisk=95%', 'no scam link domain evidence')"),
    rule("video_repost", "2.1.0", "videos >= 3", "CASE WHEN videos >= 3 THEN 1 ELSE 0 END", "videos >= 3 OR fetched", "'foreignVideoPostCount=' || videos || ' (n=' || n || ')'"),
    rule("tweet_ai_generated_media", "1.0.0", "ai > 0", "CASE WHEN ai > 0 THEN ai_score ELSE 1 END", "true", "'aiGeneratedMediaTweetCount=' || ai || ' (n=' || n || '), sources=' || CASE WHEN ai = 0 THEN 'none' WHEN ai_kinds = 1 THEN ai_first ELSE ai_first || ',' || ai_last END"),
]
VERDICT = "SELECT account_id, label_key, rule_version, value, round(CAST(CASE WHEN NOT evaluable THEN 0.5 WHEN value THEN score ELSE 1 - score END AS DOUBLE), 6) AS confidence, evaluable, reason FROM"

# Bios, and what each is about, judged by hand; the versions of the topics.
JUDGED_BIOS = (
    ("アニメanimeが好き", "anime"), ("コスメとスキンケア", "beauty"), ("リメイク作品の紹介", ""), ("long term investing notes", "finance"), ("investigation desk", ""), ("株式会社の広報", ""), ("資産運用を学ぶ", "finance"), ("workout at dawn", "fitness"), ("foodie and chef", "food"), ("ラーメンズのファン", ""), ("ラーメン食べ歩き", "food"), ("gamer", "gaming"),
    ("k-pop idol", "idol"), ("イラスト描きます pixiv", "illustration"), ("film / music / books", "movie music"), ("cinema lover", "movie"), ("singer in a band", "music"), ("子育て中", "parenting"), ("保護猫と暮らす", "pets"), ("Jリーグ観戦", "sports"), ("eスポーツ", "gaming"), ("backpacker", "travel"), ("VRC住民", "vrchat"), ("hololive にじさんじ", "vtuber"),
    ("just a person", ""), (None, ""), ("civil engineer", ""), ("software engineer", "tech"), ("mechanical-engineer", ""), ("仮想通貨お断り", ""), ("bitcoin and nft", "crypto"), ("no nft please, bitcoin fan", "crypto"), ("not crypto", ""), ("cryptography notes", ""), ("映画/ドラマ/本", ""), ("/movies/ films", ""), ("R-18 NG 絵です", ""), ("成人向け作品を描く", "nsfw"), ("R-183", ""),
    ("アダルトチルドレン", ""), ("NSFW creators DNI", ""), ("18禁は❌", ""), ("元 衆議院議員です", ""), ("衆議院議員です。", "politics"), ("市議会議員を目指しています、国会議員です", ""), ("自民党 所属", "politics"), ("state senator", "politics"), ("former state senator", ""), ("生成AIで描いたイラストは全て自作", "illustration ai"), ("生成AI不使用", ""), ("生成AI、音楽、旅", "music"),
    ("AI generated by AI images", "ai"), ("created with AI portraits", "ai"), ("大学教授、生成AIについて", ""), ("生成AI反対", ""), ("嫌いなもの: 朝、雨、AI生成の絵を見ること", ""), ("生成AIアカウントはブロックします", ""), ("生成AI情報収集と日々の記録", ""), ("AI-generated art every day", "ai"), ("ぶいちゃん", ""), ("フルスタック full stack 開発者", "tech"),
)
TOPIC_VERSIONS = {
    "anime": "1.2.0", "beauty": "1.0.1", "crypto": "1.3.3", "finance": "1.3.1", "fitness": "1.0.1", "food": "1.2.1", "gaming": "1.1.1", "idol": "1.2.1", "illustration": "1.1.1", "movie": "1.2.0", "music": "1.1.1", "nsfw": "1.6.3", "parenting": "1.1.1", "pets": "1.0.1", "politics": "1.5.0", "sports": "1.2.1", "tech": "1.3.1", "travel": "1.1.1",
    "vrchat": "1.1.1", "vtuber": "1.1.1",
}


def topics(named: str, signals: str) -> str:
    """The topic rules over `signals`, whose labels stand for topics by `named`."""
    bios = ", ".join(f"({i}, {'NULL' if b is None else chr(39) + b + chr(39)}, '{t}')" for i, (b, t) in enumerate(JUDGED_BIOS))
    kinds = ", ".join(f"('{k}', '{v}')" for k, v in TOPIC_VERSIONS.items())
    return f"""b(i, bio, about) AS (VALUES {bios}), t(topic, version) AS (VALUES {kinds}), a AS (SELECT CAST(c_custkey AS VARCHAR) AS id, bio, string_split(about, ' ') AS about FROM customer JOIN b ON b.i = c_custkey % {len(JUDGED_BIOS)}),
 r AS (SELECT CAST(user_id AS VARCHAR) AS id, event_id % 2 = 0 AS rt, user_id % 4 = 0 AND event_id % 3 = 0 AS vr, NOT (user_id % 4 = 0 AND event_id % 3 = 0) AND user_id % 3 = 0 AND event_id % 5 = 0 AS model FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC) <= 20),
 m AS (SELECT id, bool_or(vr AND NOT rt) AS vr, bool_or(NOT rt) AS own, bool_or(model) AS model FROM r GROUP BY 1), sg AS (SELECT account_id, {named} AS label_key, followee_total AS n, followee_labeled AS s FROM ({signals})),
 x AS (SELECT a.id, a.bio, topic, version, list_contains(about, topic) OR (topic = 'vrchat' AND coalesce(vr, false)) AS hit, coalesce(n >= 15, false) AS judged, s, n, coalesce(own, false) AS own FROM a CROSS JOIN t LEFT JOIN m ON m.id = a.id LEFT JOIN sg ON sg.account_id = a.id AND sg.label_key = 'topic_' || topic),
 y AS (SELECT *, judged AND s / n >= 0.3::DOUBLE AS matched FROM x),
 z AS (SELECT id AS account_id, 'topic_' || topic AS label_key, version AS rule_version, hit OR matched AS value, greatest(CASE WHEN hit THEN 0.8 ELSE 0 END, CASE WHEN judged THEN {posterior('s', 'n', '0.3')} ELSE 0 END) AS score, topic IN ('nsfw', 'politics') OR bio IS NOT NULL OR judged OR (topic = 'vrchat' AND own) AS evaluable,
  'bio' || CASE WHEN topic = 'vrchat' THEN '/tweet' ELSE '' END || ' ' || topic || '-keyword match=' || hit || CASE WHEN topic IN ('nsfw', 'politics') THEN '' ELSE ', follow-graph match=' || matched END AS reason FROM y
  UNION ALL SELECT a.id, 'ai-generated', '1.9.7', list_contains(about, 'ai'), CASE WHEN NOT list_contains(about, 'ai') THEN 0 WHEN model THEN 1 ELSE 0.7 END, true, 'bio declaration=' || list_contains(about, 'ai') || ', corroborating tweet=' || coalesce(model, false) FROM a LEFT JOIN m USING (id))"""


def queries(history: str, ranked: str, follow: str, signals: str) -> dict[str, str]:
    """The SQL by name; `ranked` and `follow` are common table expressions, `signals` a select of follow signals over them, `history` the label history."""
    monthly = f"{history}, m AS (SELECT label_key, strftime(labeled_at, '%Y-%m') AS observed, count(*) AS evaluated, count(*) FILTER (value) AS true_count FROM h GROUP BY 1, 2)"
    named = "CASE label_key WHEN '1-URGENT' THEN 'topic_anime' WHEN '2-HIGH' THEN 'topic_food' WHEN '3-MEDIUM' THEN 'topic_music' WHEN '5-LOW' THEN 'topic_pets' ELSE 'topic_travel' END"
    return {
        "label_rules": f"WITH {PERSONAS}, {FACTS}, v AS ({' UNION ALL '.join(RULES)}) {VERDICT} v",
        "templated_targets": f"WITH {PERSONAS}, {FACTS}, v AS ({RULES[4]}) SELECT account_id, value, reason FROM v",
        "topic_rules": f"WITH {ranked}, {follow}, {topics(named, signals)} {VERDICT} z",
        "duplicate_replies": f"WITH {POSTS}, {NORMAL}, {SHARED} SELECT md5(plain) AS text_md5, authors, targets, n, unknown_target, others FROM sh",
        "as_of_drops": f"""WITH {monthly} SELECT b.label_key, b.observed, b.true_count, x.observed AS baseline_observed, CAST(x.true_count AS DOUBLE) AS baseline_true FROM m b LEFT JOIN LATERAL (SELECT observed, true_count FROM m y WHERE y.label_key = b.label_key AND y.observed < b.observed AND y.evaluated >= 20 ORDER BY observed DESC LIMIT 1) x ON true""",
        "reason_shifts": f"""WITH {history}, b AS (SELECT label_key, reason, count(*) AS was FROM h WHERE value AND year(labeled_at) = 1995 GROUP BY 1, 2), c AS (SELECT label_key, reason, count(*) AS n FROM h WHERE value AND year(labeled_at) = 1996 GROUP BY 1, 2)
 SELECT label_key, reason, was, coalesce(n, 0) AS n, round((was - coalesce(n, 0)) / was, 6) AS "drop", (was - coalesce(n, 0)) / was >= 0.2::DOUBLE AS exceeded FROM b LEFT JOIN c USING (label_key, reason) WHERE was >= 10""",
        "daily_rollup": f"""WITH {history}, s AS (SELECT label_key, labeled_at, count(*) AS evaluated, count(*) FILTER (value) AS true_count FROM h GROUP BY 1, 2 HAVING count(*) >= 2), d AS (SELECT *, row_number() OVER (PARTITION BY label_key, CAST(labeled_at AS DATE) ORDER BY labeled_at DESC) AS k FROM s)
 SELECT label_key, strftime(labeled_at, '%Y-%m-%d') AS day, evaluated, true_count, CAST(true_count - lag(true_count) OVER (PARTITION BY label_key ORDER BY labeled_at) AS DOUBLE) AS change FROM d WHERE k = 1""",
        "account_overview": f"""WITH {ranked}, s AS (SELECT account_id, string_agg(label_key, ',' ORDER BY label_key) FILTER (value) AS keys, count(*) FILTER (value) AS active, strftime(max(labeled_at), '%Y-%m-%d %H:%M:%S') AS last FROM l GROUP BY 1)
 SELECT CAST(c_custkey AS VARCHAR) AS account_id, c_name AS screen_name, coalesce(active, 0) AS active_label_count, coalesce(keys, '') AS active_label_keys, coalesce(last, '1970-01-01 00:00:00') AS last_labeled_at FROM customer LEFT JOIN s ON s.account_id = CAST(c_custkey AS VARCHAR) ORDER BY 3 DESC, 1 LIMIT 50""",
        "shared_labels": f"""WITH {ranked}, s AS (SELECT account_id, string_agg(label_key, ',' ORDER BY label_key) AS active_label_keys, count(*) FILTER (label_key IN ('1-URGENT', '5-LOW')) AS hits FROM l WHERE value GROUP BY 1) SELECT account_id, active_label_keys, CAST(hits AS INTEGER) AS hits FROM s WHERE hits > 0""",
        "edge_sync": """WITH e AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS src, CAST(l_suppkey AS VARCHAR) AS dst, year(o_orderdate) AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE year(o_orderdate) IN (1995, 1996))
 SELECT src, dst, CASE WHEN min(y) = 1996 THEN 'added' WHEN max(y) = 1995 THEN 'removed' ELSE 'kept' END AS state FROM e GROUP BY 1, 2""",
        "guarded_latest": f"WITH {ranked} SELECT account_id, label_key, id, value FROM l",
        "first_claims": f"WITH {history} SELECT account_id, id FROM h WHERE year(labeled_at) = 1997 AND account_id NOT IN (SELECT account_id FROM h WHERE year(labeled_at) < 1997) QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY labeled_at, id) = 1",
        "retained_labels": f"WITH {history} SELECT label_key, count(*) AS n FROM h WHERE labeled_at >= TIMESTAMP '1996-01-01' GROUP BY 1",
    }

"""Lexicon scores of posts, tiers, polarity, market chatter and ingest filters; all as column expressions."""

from __future__ import annotations

from narravane.functions.dialect import operator, rounded

# The terms of each family, matched without regard to case between word boundaries.
FAMILIES = {
    "dehuman": r"vermin|animals|subhuman|parasite|infest|exterminate|filth|scum|plague|locusts|cockroaches|breed like|invaded us|do not belong|no rights|replace us|great replacement|untermensch|deport them all",
    "authority": r"deep state|tyrann|martial law|illegitimate|stolen election|they control|shadow government|traitors in|america\s*first|#americafirst|rigged election|banana republic|dictator|pedo cabal|globalist cabal|uniparty|weaponized (?:doj|fbi|irs)|political persecution",
    "rage": r"!{2,}|wake up|share before|they don't want you|mainstream media won't|you won't believe|destroying our country|hate you|nodaca|no ?daca|open your eyes|before they censor|share if you agree|retweet if|the truth they hide|do your research|sheeple|wake up america",
    "conflict": r"enemy|war on|fight back|blood|revolution|purge|eliminate|don'?t test me|ignorant|civil war|second amendment|molon labe|traitors|hang them|execute|overthrow|by any means",
    "toxic": r"cunt|bitch ass|f+u+c+k+|shit|asshole|motherfucker",
    "stance": r"#semst|lock her up|crooked|witch|benghazi|climate hoax|fake news|illegitimate|tyrant|socialist|communist|radical left|radical right|destroy (?:our|the) (?:country|nation)|america first|maga|ultramaga|woke mob|antifa|blm rioters|stop the steal|pro.?life|pro.?choice extremist",
    "negative": r"hate|destroy|evil|corrupt|lie|liar|fake|invad|deport|illegal|fraud|rigged|stolen|traitor|disgusting|pathetic|scum|garbage human|worst president|clown show|disaster|betray|sellout|grifter|predator|sickening|unhinged|deranged|insane|lunatic",
    "conspiracy": r"false flag|crisis actor|plandemic|great reset|new world order|chemtrails|microchip|bioweapon|population control|they're coming for|agenda 2030|globalist agenda",
    "threat": r"shoot them|bring guns|armed and ready|heads on pikes|string them up|lynch|burn it down|firebomb|assassinate",
}
INSULT = r"bitch"
AFFECTION = r"i love you|ily|ilysm|thank u|thank you|my fave|with my whole heart|spreads love|proud of you|grateful for"  # and the signs ❤ and 💕
# Tickers and words of markets.
TICKERS = (
    "ath binance bitcoin bnb btc call calls coin coinbase crypto defi djt dji doge dow eth ethereum etf etfs fomc futures gld goog iv iwm macd meme memes meta mkt msft "
    "nasdaq ndx nft nfts nvda oi option options pp ppi put puts qqq rsi slv sol spx spy token tokens tsla vix xrp yield"
).split()
# Forms of ticker chatter.
MARKET_FORMS = (r"\$\s?[a-z]{1,5}\b", r"\b\d+(?:\.\d+)?\s*%", r"/(?:10y|2y|30y)[a-z]*", r"\\10y", r"\b(?:open|close|pre|post)market\b", r"\b(?:spx|ndx|dji|qqq|iwm|vix)\b")
# Calls to follow or buy.
PROMO = r"follow(?:\s+me)?|subscribe|sign\s*up|promo|giveaway|dm\s+me|link\s+in\s+bio"
# Words and phrases of a political frame, and the words among them that are weak alone.
POLITICAL = "accountability ballot biden border congress deep democrat election fraud gop immigration midterm republican state trump vote voter wave".split()
WEAKLY_POLITICAL = ("gop", "wave", "state")
PHRASES = ("red wave", "deep state", "election fraud", "vote steal", "stop the steal")
# Least score of a market post, the score below which a political frame rescues it, and weights of families.
MARKET_LEAST, RESCUE_BELOW = "42e-2", "65e-2"
WEIGHTS = {"dehuman": "4e-1", "authority": "35e-2", "rage": "3e-1", "conflict": "35e-2", "toxic": "35e-2", "stance": "28e-2", "conspiracy": "25e-2", "threat": "4e-1"}


def _word(d, terms: str) -> str:
    return f"(?i){d.boundary}(?:{terms}){d.boundary}"


def _ascii_word(terms: str) -> str:
    """For lower-case text without other characters, in which both engines see the same word boundaries, and find them fast."""
    return rf"\b(?:{terms})\b"


def _ascii(d) -> str:
    return f"lower({d.replace('text', '[^' + chr(92) + 'x00-' + chr(92) + 'x7F]', ' ')})"


@operator("posts")
def lexicon_hits(d):
    """Matches of each family in each post, and whether the insult and an affection phrase stand in it."""
    # the terms of one family may start inside a word or after a sign; only their end is a boundary
    shape = lambda name, terms: rf"(?:{terms})\b" if name == "rage" else _ascii_word(terms)
    counts = ", ".join(f"{d.hits('plain', shape(name, terms))} AS {name}" for name, terms in FAMILIES.items())
    return f"""
    WITH t AS (SELECT post_id, text, {_ascii(d)} AS plain FROM posts)
    SELECT post_id, {counts}, {d.like("plain", _ascii_word(INSULT))} AS insult, {d.like("plain", _ascii_word(AFFECTION))} OR ((contains(text, '❤') OR contains(text, '💕')) AND {d.like("text", _word(d, "❤|💕"))}) AS affection,
           CAST(length(text) AS BIGINT) AS chars, CAST(length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS BIGINT) AS capitals, CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS bangs FROM t"""


@operator("hits")
def outrage_scores(d):
    """Components, index, tier and polarity of each post."""
    capped = ", ".join(f"least(1e0, {name} * {w}) AS {name}_s" for name, w in WEIGHTS.items() if name != "toxic")
    families = " + ".join(f"CASE WHEN {name} > 0 THEN 1 ELSE 0 END" for name in WEIGHTS)
    return f"""
    WITH a AS (SELECT *, {capped}, least(1e0, least(1e0, toxic * {WEIGHTS["toxic"]}) + CASE WHEN insult AND NOT affection THEN 2e-1 ELSE 0e0 END) AS toxic_s,
                      {families} + CASE WHEN insult AND NOT affection THEN 1 ELSE 0 END AS families, least(1e0, bangs * 12e-2) AS spike, CAST(capitals AS DOUBLE) / greatest(chars, 1) AS caps FROM hits),
    b AS (SELECT *, CASE WHEN families = 0 THEN 0e0 ELSE least(1e0, 35e-2 + 15e-2 * (families - 1)) END AS strength FROM a),
    c AS (SELECT *, greatest(least(1e0, negative * 22e-2), strength * 85e-2) AS weight FROM b),
    e AS (SELECT *, affection AND weight < 35e-2 AND strength < 25e-2 AS fond FROM c),
    f AS (SELECT *, CASE WHEN fond THEN weight * 5e-1 ELSE weight END AS negativity, CASE WHEN fond THEN 'positive' WHEN weight >= 18e-2 THEN 'negative' ELSE 'neutral' END AS polarity_0 FROM e),
    g AS (SELECT *, CASE WHEN negativity > 15e-2 OR dehuman_s > 0 OR authority_s > 0 OR toxic_s > 0 OR rage_s > 0 OR threat_s > 0 THEN least(2e-1, caps * 12e-1) ELSE least(6e-2, caps * 4e-1) END AS caps_boost FROM f),
    h AS (SELECT *, least(1e0, conflict_s + rage_s * 45e-2 + toxic_s * 5e-1 + caps_boost + conspiracy_s * 2e-1 + threat_s * 35e-2) AS escalation FROM g),
    i AS (SELECT *, least(1e0, 18e-2 * negativity + 2e-1 * dehuman_s + 16e-2 * authority_s + 2e-1 * escalation + 8e-2 * spike + 1e-1 * toxic_s + 8e-2 * stance_s + 1e-1 * conspiracy_s + 12e-2 * threat_s) AS raw FROM h),
    j AS (SELECT *, CASE WHEN affection AND strength < 25e-2 THEN least(raw, raw * 5e-1 + 5e-2) ELSE raw END AS idx FROM i)
    SELECT post_id, {rounded("idx")} AS outrage_index,
           CASE WHEN chars = 0 THEN 'neutral' WHEN idx >= 55e-2 THEN 'high_conflict' WHEN idx >= 32e-2 THEN 'escalating' WHEN strength >= 5e-1 OR dehuman_s >= 35e-2 OR threat_s >= 35e-2 THEN 'escalating'
                WHEN families >= 2 AND escalation >= 2e-1 THEN 'escalating' WHEN strength >= 35e-2 AND escalation >= 15e-2 THEN 'escalating' ELSE 'neutral' END AS tier,
           CASE WHEN affection AND strength < 25e-2 AND polarity_0 = 'negative' AND idx < 2e-1 AND families = 0 THEN 'neutral' ELSE polarity_0 END AS polarity,
           {rounded("negativity")} AS negativity, {rounded("least(1e0, rage_s + spike * 35e-2)")} AS ragebait, {rounded("escalation")} AS escalation, {rounded("strength")} AS strength, CAST(families AS BIGINT) AS families FROM j"""


@operator("posts")
def market_scores(d):
    """Score of ticker chatter, and whether it counts as such.

    A political frame rescues a middling score: one of the phrases, two strong political words, or three of which one is strong.
    """
    tokens = d.all("lower(text)", "[a-z0-9']{2,}")
    alpha = d.keep("tokens", d.like("x", "^[a-z]+$"))
    tickers = d.keep("tokens", "x IN (" + ", ".join(f"'{t}'" for t in TICKERS) + ")")
    forms = " + ".join(f"CASE WHEN {d.like('text', '(?i)' + f)} THEN 1 ELSE 0 END" for f in MARKET_FORMS)
    among = lambda words: d.size(d.distinct(d.keep("tokens", "x IN (" + ", ".join(f"'{w}'" for w in words) + ")")))
    core, strong = among(POLITICAL), among([w for w in POLITICAL if w not in WEAKLY_POLITICAL])
    political = " OR ".join([f"contains(plain, '{p}')" for p in PHRASES] + [f"{strong} >= 2", f"({core} >= 3 AND {strong} >= 1)"])
    emoji = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"
    forms = forms.replace("text", "plain")
    return f"""
    WITH t AS (SELECT post_id, text, {_ascii(d)} AS plain, {tokens} AS tokens FROM posts),
    s AS (SELECT post_id, plain, tokens, CASE WHEN {d.size("tokens")} = 0 THEN 0e0 ELSE least(1e0, 5e-1 * CAST({d.size(tickers)} AS DOUBLE) / greatest({d.size(alpha)}, 1) + 2e-1 * least(1e0, ({forms}) / 2e0)
          + 15e-2 * least(1e0, {d.hits("text", emoji)} / 8e0) + 15e-2 * least(1e0, {d.hits("lower(plain)", "[a-z]{2,5}/[a-z]{2,5}")} / 3e0)) END AS score FROM t)
    SELECT post_id, score AS market_score, score >= {MARKET_LEAST} AND NOT (score < {RESCUE_BELOW} AND ({political})) AS market FROM (SELECT post_id, plain, tokens, {rounded("score")} AS score FROM s) r"""


def _checks(d) -> dict[str, str]:
    words = d.hits("text", r"[^ \t\n\r\f]+")
    ascii_words = d.hits("text", "[a-zA-Z]{3,}")
    return {
        "promo": f"{d.like('text', _word(d, PROMO))} OR ({d.hits('text', '(?i)https?://|www[.]')} >= 2 AND {words} <= 12)",
        "short": f"length(trim({d.replace('text', '[ \\t\\n\\r\\f]+', ' ')})) < 24 OR {d.hits('text', '\\p{L}')} < 8",
        "non_english": f"trim(text) = '' OR ({ascii_words} < 4 AND ({d.hits('text', '[^\\x00-\\x7F]')} >= 3 OR ({ascii_words} <= 1 AND length(text) > 20)))",
    }


@operator("posts", "markets")
def prefilter(d):
    """Why a post is left out of clustering, the first reason that holds, or narrative."""
    c = _checks(d)
    return f"SELECT p.post_id, CASE WHEN m.market THEN 'market' WHEN {c['promo']} THEN 'promo' WHEN {c['short']} THEN 'short' WHEN {c['non_english']} THEN 'non_english' ELSE 'narrative' END AS reason FROM posts p JOIN markets m ON p.post_id = m.post_id"


@operator("reasons", "posts", "keywords")
def ingest_gate(d):
    """Whether a post may enter, and why not; without a keyword in its text it is off topic."""
    return """
    WITH k AS (SELECT p.post_id, count(w.keyword) AS hits FROM posts p LEFT JOIN keywords w ON contains(lower(p.text), lower(trim(w.keyword))) AND trim(w.keyword) <> '' GROUP BY p.post_id)
    SELECT r.post_id, CASE r.reason WHEN 'market' THEN 'market_chatter' WHEN 'narrative' THEN CASE WHEN k.hits = 0 THEN 'off_topic' ELSE 'ok' END ELSE r.reason END AS gate, r.reason = 'narrative' AND k.hits > 0 AS allow, k.hits AS keyword_hits
    FROM reasons r JOIN k ON r.post_id = k.post_id"""


@operator("reasons", "gates", "posts")
def topic_filter(d):
    """Why a post is left out of clustering, off topic included: without a keyword in it, where a quarter of its narrative's posts have one.

    Where fewer have one, the keywords say nothing about the corpus and no post is off topic.
    """
    return f"""
    WITH n AS (SELECT p.narrative, 4 * count_if(g.keyword_hits > 0) >= count(*) AS telling FROM posts p JOIN gates g ON p.post_id = g.post_id GROUP BY p.narrative)
    SELECT r.post_id, CASE WHEN r.reason = 'narrative' AND g.keyword_hits = 0 AND n.telling THEN 'off_topic' ELSE r.reason END AS reason
    FROM reasons r JOIN gates g ON r.post_id = g.post_id JOIN posts p ON r.post_id = p.post_id JOIN n ON n.narrative {"<=>" if d.name == "spark" else "IS NOT DISTINCT FROM"} p.narrative"""


@operator("scores", "posts")
def tier_counts(d):
    """Posts and mean index by narrative and tier."""
    return f"SELECT p.narrative, s.tier, count(*) AS posts, {rounded('CAST(sum(CAST(floor(s.outrage_index * 1e4 + 5e-1) AS BIGINT)) AS DOUBLE) / count(*) / 1e4')} AS mean_index FROM scores s JOIN posts p ON s.post_id = p.post_id GROUP BY p.narrative, s.tier"


@operator("scores", "labels")
def label_calibration(d):
    """Mean index of each label, and the distance of the labels."""
    return f"""
    WITH m AS (SELECT l.quality, l.toxic, count(*) AS n, CAST(sum(CAST(floor(s.outrage_index * 1e4 + 5e-1) AS BIGINT)) AS DOUBLE) / count(*) / 1e4 AS mean_index FROM scores s JOIN labels l ON s.post_id = l.doc_id GROUP BY l.quality, l.toxic)
    SELECT quality, toxic, n, {rounded("mean_index")} AS mean_index, {rounded("max(mean_index) OVER () - min(mean_index) OVER ()")} AS separation FROM m"""

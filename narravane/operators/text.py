"""Text functions as projections: cleaning, tags, tokens, n-grams, HTML, terms."""

from __future__ import annotations

from narravane.functions.dialect import operator, rounded

# Words that never make a topic term.
STOP_WORDS = (
    "a about after all also an and any are as at be because been before being between both but by can could did do does down for from further had has have he her here him his how i if in into is it its just "
    "like me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very "
    "was we were what when where which while who why will with would you your"
).split()
SPACES = r"[ \t\n\r\f]+"


#: Fixed value: terms of a vector.
FEATURES = 384


@operator("posts")
def cleaned(d):
    """Text without links and mentions, tags unwrapped, white space collapsed."""
    t = d.replace("text", r"https?://[^ \t\n\r\f]+", "")
    t = d.replace(d.replace(t, "@[A-Za-z0-9_]+", ""), "#([A-Za-z0-9_]+)", "@1")
    return f"SELECT post_id, trim({d.replace(t, SPACES, ' ')}) AS cleaned FROM posts"


@operator("posts")
def hashtags(d):
    """Tags of a post in order, lower case, joined by a space."""
    return f"SELECT post_id, {d.join_array(d.all('lower(text)', '#[a-z0-9_]+'))} AS tags FROM posts"


@operator("pages")
def stripped_html(d):
    """Length and digest of a page without its tags."""
    t = f"trim({d.replace(d.replace('html', '<[^>]+>', ' '), SPACES, ' ')})"
    return f"SELECT page_id, CAST(length({t}) AS BIGINT) AS chars, {d.sha256(t)} AS digest FROM pages"


@operator("posts")
def topic_tokens(d):
    """Meaningful tokens of a post in order: three characters or more, not digits, no stop word."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    tokens = d.keep(d.all("lower(text)", "[a-z0-9']{2,}"), f"length(x) >= 3 AND NOT {d.like('x', '^[0-9]+$')} AND x NOT IN ({stop})")
    return f"SELECT post_id, narrative, {tokens} AS tokens FROM posts"


@operator("topics")
def token_counts(d):
    """Tokens and distinct tokens of a post."""
    return f"SELECT post_id, {d.size('tokens')} AS tokens, {d.size(d.distinct('tokens'))} AS distinct_tokens FROM topics"


@operator("topics")
def phrase_counts(d):
    """Bigrams and trigrams over the remaining tokens by narrative, those that occur ten times or more."""
    if d.name == "spark":  # one pass over the tokens
        gram = lambda n: f"IF(size(tokens) < {n}, CAST(array() AS ARRAY<STRING>), transform(sequence(0, size(tokens) - {n}), i -> concat_ws(' ', tokens[i], " + ", ".join(f"tokens[i + {k}]" for k in range(1, n)) + ")))"
        return f"SELECT narrative, phrase, count(*) AS n FROM (SELECT narrative, phrase FROM topics LATERAL VIEW explode(concat({gram(2)}, {gram(3)})) p AS phrase) x GROUP BY narrative, phrase HAVING count(*) >= 10"
    two = f"SELECT narrative, phrase FROM topics {d.unnest(d.grams('tokens', 2), 'phrase')}"
    three = f"SELECT narrative, phrase FROM topics {d.unnest(d.grams('tokens', 3), 'phrase')}"
    return f"SELECT narrative, phrase, count(*) AS n FROM ({two} UNION ALL {three}) x GROUP BY narrative, phrase HAVING count(*) >= 10"


@operator("topics")
def top_terms(d):
    """The ten most frequent terms of each narrative; ties by the term."""
    return f"""
    WITH c AS (SELECT narrative, term, count(*) AS n FROM topics {d.unnest("tokens", "term")} GROUP BY narrative, term),
    r AS (SELECT *, row_number() OVER (PARTITION BY narrative ORDER BY n DESC, term) AS k FROM c)
    SELECT narrative, term, n, CAST(k AS BIGINT) AS k FROM r WHERE k <= 10"""


@operator("counts")
def phrase_pmi(d):
    """Pointwise mutual information of a phrase and a narrative, times the log of its count."""
    return f"""
    WITH i AS (SELECT narrative, CAST(sum(n) AS DOUBLE) AS in_narrative FROM counts GROUP BY narrative), p AS (SELECT phrase, CAST(sum(n) AS DOUBLE) AS of_phrase FROM counts GROUP BY phrase), t AS (SELECT sum(in_narrative) AS total FROM i),
    a AS (SELECT c.narrative, c.phrase, c.n, i.in_narrative, p.of_phrase, t.total FROM counts c JOIN i ON c.narrative = i.narrative JOIN p ON c.phrase = p.phrase CROSS JOIN t)
    SELECT narrative, phrase, n, {rounded("log2(n * total / (in_narrative * of_phrase)) * ln(1 + n)", 3)} AS weight FROM a"""


@operator("topics")
def term_lift(d):
    """Lift of a term in a narrative against all other narratives, from one pass of counts."""
    return f"""
    WITH c AS (SELECT narrative, term, count(*) AS n FROM topics {d.unnest("tokens", "term")} GROUP BY narrative, term),
    i AS (SELECT narrative, CAST(sum(n) AS BIGINT) AS own FROM c GROUP BY narrative), e AS (SELECT term, CAST(sum(n) AS BIGINT) AS everywhere FROM c GROUP BY term), t AS (SELECT CAST(sum(own) AS BIGINT) AS total FROM i),
    a AS (SELECT c.narrative, c.term, c.n, i.own, e.everywhere, t.total FROM c JOIN i ON c.narrative = i.narrative JOIN e ON c.term = e.term CROSS JOIN t)
    SELECT narrative, term, n, {rounded("(CAST(n AS DOUBLE) / own) / (CAST(everywhere - n + 1 AS DOUBLE) / (total - own + 1))", 3)} AS lift FROM a WHERE n >= 5"""


def _weighted(d, flat: str) -> str:
    """Tf-idf weights of the 384 most frequent terms of ``flat``, a text that gives (post_id, term) for each occurrence.

    The vocabulary comes first, so other terms never reach the grouping by post.
    """
    return f"""
    WITH v AS (SELECT term, count(*) AS n FROM ({flat}) x GROUP BY term ORDER BY n DESC, term LIMIT {FEATURES}), c AS (SELECT count(*) AS docs FROM topics),
    f AS (SELECT x.post_id, x.term, count(*) AS tf FROM ({flat}) x JOIN v ON x.term = v.term GROUP BY x.post_id, x.term), i AS (SELECT term, count(*) AS df FROM f GROUP BY term),
    w AS (SELECT f.post_id, f.term, (1e0 + ln(f.tf)) * (ln((1e0 + c.docs) / (1e0 + i.df)) + 1e0) AS w FROM f JOIN i ON f.term = i.term CROSS JOIN c)
    SELECT post_id, term, {rounded("w / sqrt(sum(w * w) OVER (PARTITION BY post_id))", 5)} AS weight FROM w"""


@operator("topics")
def tfidf(d):
    """Sublinear tf-idf weights, scaled to unit length, of the 384 most frequent terms."""
    return _weighted(d, f"SELECT post_id, term FROM topics {d.unnest('tokens', 'term')}")


@operator("topics")
def tfidf_bigrams(d):
    """Sublinear tf-idf weights, scaled to unit length, of the 384 most frequent terms and pairs of neighbouring terms."""
    both = f"concat(tokens, {d.grams('tokens', 2)})" if d.name == "spark" else f"list_concat(tokens, {d.grams('tokens', 2)})"
    return _weighted(d, f"SELECT post_id, term FROM topics {d.unnest(both, 'term')}")


@operator("weights")
def tfidf_norms(d):
    """Terms and squared length of each post's vector, a check of the weights."""
    return f"SELECT post_id, count(*) AS terms, {rounded('sum(weight * weight)', 3)} AS norm FROM weights GROUP BY post_id"


@operator("conversations")
def turn_pairs(d):
    """Each turn with the role before it and the characters so far."""
    return """
    SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, CAST(sum(length(coalesce(text, ''))) OVER w AS BIGINT) AS chars_so_far
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


@operator("events")
def json_fields(d):
    """A number read from semi-structured properties, by type."""
    k = f"try_cast({d.json('props', '$.k')} AS BIGINT)"
    return f"SELECT event_type, count({k}) AS present, CAST(sum({k}) AS BIGINT) AS total, max({k}) AS largest FROM events GROUP BY event_type"

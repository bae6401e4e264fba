"""Replies of conversations, with findings planted in both engines: what they disclose, and answers against sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import patterns, replies, text
from .registry import query, table

CANARY, PROMPT = "CANARY_7f3a9", "you are a careful assistant of the reading room"
#: What every eighth reply says besides, by the remainder of 3 conv_id + turn.
PLANTED = {
    0: " My system prompt says so.",
    1: f" The word is {CANARY}.",
    2: " See bGVhayBDQU5BUllfN2YzYTkgbm93 there.",
    3: " We guarantee high returns.",
    4: " About interest rates today.",
    5: " Write to jane.doe@corp.example.org soon, card 4111111111111111.",
    6: " Allison Hill signed CASE-3728-112231 today.",
}
_PICK = "(conv_id * 3 + turn) % 8"
REPLIES = "r AS (SELECT conv_id, turn, coalesce(text, '') || CASE " + _PICK + " " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in PLANTED.items()) + " ELSE '' END AS t FROM conversations WHERE role = 'assistant')"


def planted_replies(spark, sf):
    c = table(spark, sf, "conversations", "conv_id", "turn", "role", "text").where("role = 'assistant'")
    extra = F.lit("")
    for k, v in PLANTED.items():
        extra = F.when(F.expr(_PICK) == k, v).otherwise(extra)
    return c.select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), extra).alias("t"))


_DISCLOSURE_SQL = "|".join(patterns.DISCLOSURE)
_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower({0}), '\s+'), lambda x: x <> ''))"
_SECRET_HEX = CANARY.encode().hex().upper()
_EMAIL, _CARD = patterns.PERSONAL["email"], patterns.PERSONAL["credit_card"]


@query(rf"""
    WITH {REPLIES}, w AS (SELECT *, {_WORDS.format('t')} AS a, {_WORDS.format(f"'{PROMPT}'")} AS b,
        contains(t, '{CANARY}') OR len(list_filter(regexp_extract_all(t, '[A-Za-z0-9+/]{{16,}}={{0,2}}'), lambda x: length(x) % 4 = 0 AND contains(hex(from_base64(CASE WHEN length(x) % 4 = 0 THEN x ELSE '' END)), '{_SECRET_HEX}'))) > 0 AS canary FROM r),
    o AS (SELECT *, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS overlap FROM w),
    s AS (SELECT conv_id, turn, CASE WHEN canary THEN 1.0 ELSE greatest(CASE WHEN overlap > 0.4 THEN overlap * 0.8 ELSE 0 END, CASE WHEN regexp_matches(t, '(?i){_DISCLOSURE_SQL}') THEN 0.9 ELSE 0 END) END AS exfil,
        len(list_filter(regexp_extract_all(t, '{_EMAIL}'), lambda x: NOT list_contains({list(patterns.ROLE_MAILBOXES)}, lower(split_part(x, '@', 1))))) + len(regexp_extract_all(t, '4111111111111111')) AS personal,
        CAST(regexp_matches(lower(t), '\binvestment') AND regexp_matches(lower(t), '\badvice') AND regexp_matches(lower(t), '\bunqualified') AS INT) + CAST(regexp_matches(lower(t), '\bguarantee') AND regexp_matches(lower(t), '\breturns') AS INT)
        + CAST(regexp_matches(lower(t), '\bregulatory') AND regexp_matches(lower(t), '\bviolations') AS INT) + CAST(regexp_matches(lower(t), '\binterest\s+rates\b') AND NOT contains(lower(t), 'rates subject to change. not financial advice.') AS INT)
        + CAST(regexp_matches(lower(t), '\bmedical\s+diagnosis\b') AND NOT contains(lower(t), 'consult a doctor for medical advice.') AS INT) AS policy FROM o)
    SELECT conv_id, turn, round(exfil, 6) AS exfil, personal, policy, round(greatest(exfil, CASE WHEN personal > 0 THEN .55 ELSE 0 END, CASE WHEN policy > 0 THEN .6 ELSE 0 END), 6) AS score,
      CASE WHEN exfil >= .8 THEN 'OUTPUT_EXFILTRATION' WHEN personal > 0 THEN 'PII_LEAK' WHEN policy > 0 THEN 'POLICY_VIOLATION' ELSE 'CLEAN' END AS class,
      round(1 - exp(-(least(6.0, CASE WHEN exfil >= 1 THEN 6.0 ELSE -ln(1 - exfil) END) + least(6.0, personal) + least(6.0, policy))), 6) AS confidence FROM s""")
def replies_scan(spark, sf):
    """Every reply's leak, personal data, policy violations, verdict and confidence in one projection."""
    t = F.col("t")
    r = planted_replies(spark, sf).withColumn("exfil", replies.exfiltration(t, F.lit(PROMPT), F.lit(0.0), CANARY))
    personal = F.size(patterns.personal(t, "email")) + F.size(patterns.personal(t, "credit_card"))
    r = r.withColumn("personal", personal).withColumn("policy", F.size(replies.policy_violations(t)))
    v = replies.verdict(F.col("exfil"), F.col("personal"), F.lit(0), F.col("policy"))
    sure = replies.confidence(F.col("exfil"), F.col("personal"), F.col("policy"), F.lit(0.0))
    return r.select("conv_id", "turn", F.round("exfil", 6).alias("exfil"), F.col("personal").cast("long").alias("personal"), "policy", F.round(v["score"], 6).alias("score"), v["class"].alias("class"), F.round(sure, 6).alias("confidence"))


_FIRST = ", ".join(f"'{x}'" for x in replies.NO_FIRST_NAME)


@query(rf"""
    WITH {REPLIES}, n AS (SELECT conv_id, turn, list_filter(regexp_extract_all(t, '{replies.NAME}'), lambda x: split_part(x, ' ', 1) NOT IN ({_FIRST})) AS names,
        list_filter(list_transform(regexp_extract_all(t, '[A-Za-z0-9][A-Za-z0-9\-_/.]{{2,}}'), lambda x: regexp_replace(x, '[-_/.]+$', '')), lambda x: length(x) >= 12 AND (regexp_matches(x, '[0-9]') OR contains(x, 'CANARY_'))) AS ids FROM r),
    v AS (SELECT DISTINCT conv_id, turn, value FROM (SELECT conv_id, turn, unnest(names || ids) AS value FROM n))
    SELECT conv_id, value, min(turn) AS first_turn, count(*) AS turns, regexp_full_match(value, '{replies.NAME}') AS is_name FROM v GROUP BY conv_id, value""")
def replies_sensitive_values(spark, sf):
    """Names and identifiers that a conversation's replies hold: the values that it tracks, each by its first turn."""
    v = planted_replies(spark, sf).select("conv_id", "turn", F.explode(replies.sensitive_values(F.col("t"))).alias("value"))
    return v.groupBy("conv_id", "value").agg(F.min("turn").alias("first_turn"), F.count("*").alias("turns")).withColumn("is_name", replies.is_name(F.col("value")))


@query(rf"""
    WITH {REPLIES}, ids AS (SELECT conv_id, turn, unnest(list_distinct(list_filter(list_transform(regexp_extract_all(t, '[A-Za-z0-9][A-Za-z0-9\-_/.]{{2,}}'), lambda x: regexp_replace(x, '[-_/.]+$', '')), lambda x: length(x) >= 12 AND (regexp_matches(x, '[0-9]') OR contains(x, 'CANARY_'))))) AS value FROM r),
    f AS (SELECT conv_id, value, min(turn) AS first_turn FROM ids GROUP BY conv_id, value)
    SELECT r.conv_id, r.turn, count(*) AS n_leaked, min(value) AS one FROM r JOIN f ON r.conv_id = f.conv_id AND r.turn > f.first_turn AND contains(lower(r.t), lower(value)) GROUP BY r.conv_id, r.turn""")
def replies_tracked_leaks(spark, sf):
    """Replies that repeat an identifier that an earlier turn of the conversation showed; identifiers match as written.

    A conversation tracks its first MOST_TRACKED values, which go to each of its replies as one array.
    """
    r = planted_replies(spark, sf)
    ids = r.select("conv_id", "turn", F.explode(F.array_distinct(replies.identifiers(F.col("t")))).alias("value"))
    first = ids.groupBy("conv_id", "value").agg(F.min("turn").alias("first_turn"))
    gathered = first.groupBy("conv_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("first_turn", "value"))), 1, replies.MOST_TRACKED).alias("tracked"))
    seen = r.join(gathered, "conv_id").withColumn("low", F.lower("t"))
    found = F.filter("tracked", lambda x: (x["first_turn"] < F.col("turn")) & F.col("low").contains(F.lower(x["value"])))
    seen = seen.withColumn("found", found).where(F.size("found") > 0)
    return seen.select("conv_id", "turn", F.size("found").cast("long").alias("n_leaked"), F.array_min(F.transform("found", lambda x: x["value"])).alias("one"))


@query("""
    WITH s AS (SELECT conv_id, string_agg(coalesce(text, ''), ' ' ORDER BY turn) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id),
    a AS (SELECT conv_id, turn, coalesce(text, '') || ' ' || coalesce((SELECT array_to_string(list_filter(regexp_split_to_array(lower(t), '\\s+'), lambda x: x <> '')[3:10], ' ') FROM s WHERE s.conv_id = c.conv_id), '') AS t FROM conversations c WHERE role = 'assistant'),
    sw AS (SELECT conv_id, list_filter(regexp_split_to_array(lower(t), '\\s+'), lambda x: x <> '') AS w FROM s),
    aw AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(t), '\\s+'), lambda x: x <> '') AS w FROM a),
    ag AS (SELECT DISTINCT conv_id, turn, array_to_string(w[i:i+5], ' ') AS g FROM (SELECT conv_id, turn, w, unnest(range(1, len(w) - 4)) AS i FROM aw WHERE len(w) >= 6)),
    sg AS (SELECT conv_id, i, array_to_string(w[i:i+5], ' ') AS g FROM (SELECT conv_id, w, unnest(range(1, len(w) - 4)) AS i FROM sw WHERE len(w) >= 6))
    SELECT conv_id, turn, count(DISTINCT p) AS copied_words FROM (SELECT ag.conv_id, ag.turn, unnest(range(i, i + 6)) AS p FROM ag JOIN sg USING (conv_id, g)) GROUP BY conv_id, turn""")
def replies_copied_regions(spark, sf):
    """How many words of what the user wrote a reply repeats in runs of six; each reply is given eight such words."""
    c = table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    said = c.where("role = 'user'").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), " ").alias("source"))
    a = c.where("role = 'assistant'").join(said, "conv_id")
    quoted = F.array_join(F.slice(text.words(F.col("source")), 3, 8), " ")
    a = a.withColumn("answer", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), quoted))
    runs = replies.copied_runs(F.col("answer"), F.col("source"), 6)
    a = a.select("conv_id", "turn", F.aggregate(runs, F.lit(0), lambda n, x: n + x["to"] - x["from"]).cast("long").alias("copied_words"))
    return a.where("copied_words > 0")


@query("""
    WITH l AS (SELECT doc_id AS task, source, lang, list_distinct(list_filter(regexp_split_to_array(lower(left(text, 200)), '\\s+'), lambda x: x <> '')) AS w FROM documents WHERE doc_id < 20),
    q AS (SELECT conv_id, list_distinct(list_filter(regexp_split_to_array(lower(left(text, 200)), '\\s+'), lambda x: x <> '')) AS w FROM conversations WHERE turn = 0 AND role = 'user'),
    s AS (SELECT conv_id, task, lang, len(list_intersect(l.w, q.w)) / (len(l.w) + len(q.w) - len(list_intersect(l.w, q.w))) AS sim FROM q, l),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY sim DESC, task) AS k FROM s WHERE sim > 0)
    SELECT conv_id, count(*) AS n, round(sum(CASE WHEN lang = 'en' THEN sim ELSE 0 END) / sum(sim), 6) AS share, sum(CASE WHEN lang = 'en' THEN sim ELSE 0 END) / sum(sim) >= 0.5 AS allowed FROM r WHERE k <= 3 GROUP BY conv_id""")
def replies_library_vote(spark, sf):
    """A request's three most similar library tasks vote by similarity; the library is twenty rows, sent to every request."""
    first = F.array_distinct(text.words(F.substring("text", 1, 200)))
    lib = table(spark, sf, "documents", "doc_id", "text", "lang").where("doc_id < 20").select(F.col("doc_id").alias("task"), "lang", first.alias("lw"))
    req = table(spark, sf, "conversations", "conv_id", "turn", "role", "text").where("turn = 0 and role = 'user'").select("conv_id", first.alias("qw"))
    both = F.size(F.array_intersect("lw", "qw"))
    s = req.crossJoin(F.broadcast(lib)).withColumn("sim", both / (F.size("lw") + F.size("qw") - both)).where("sim > 0")
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("sim"), "task"))
    yes = F.sum(F.when(F.col("lang") == "en", F.col("sim")).otherwise(0.0)) / F.sum("sim")
    top = s.withColumn("k", rank).where("k <= 3").groupBy("conv_id").agg(F.count("*").alias("n"), yes.alias("share"))
    return top.select("conv_id", "n", F.round("share", 6).alias("share"), (F.col("share") >= 0.5).alias("allowed"))

"""Text functions and pattern predicates over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import decode, patterns, signing, text
from .registry import query, table


@query(r"""
    SELECT doc_id, length(t) AS n, md5(t) AS digest FROM (
      SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'),
        '[\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]', ' ', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t
      FROM documents)""")
def text_canonical_whitespace(spark, sf):
    t = text.canonical_whitespace(F.col("text"))
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", F.length(t).alias("n"), F.md5(t).alias("digest"))


@query(f"""
    SELECT doc_id, md5(translate(lower(translate(translate(coalesce(text, ''), '​‌‍﻿', ''), '{text.CONFUSABLES_FROM}', '{text.CONFUSABLES_TO}')), '{text.LEET_FROM}', '{text.LEET_TO}')) AS digest
    FROM documents""")
def text_fold_lookalikes(spark, sf):
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", F.md5(text.fold_lookalikes(F.col("text"))).alias("digest"))


@query()
def text_canonicalize(spark, sf):
    """NFKC included; only rows that hold a character beyond ASCII, which NFKC leaves as it is, pass through the Arrow function."""
    docs = table(spark, sf, "documents", "doc_id", "text")
    needs = F.coalesce(F.col("text").rlike("[^\\x00-\\x7F]"), F.lit(False))
    plain = docs.where(~needs).select("doc_id", F.md5(text.fold_lookalikes(F.col("text"))).alias("digest"))
    return plain.unionAll(docs.where(needs).select("doc_id", F.md5(text.canonicalize(F.col("text"))).alias("digest")))


_TYPE_SQL = r"""
    WITH s AS (
      SELECT page_id AS id, html AS t,
        2 * len(list_filter(regexp_extract_all(html, '(?s)```[^\n]*\n(.*?)```', 1), lambda b: len(list_filter(regexp_split_to_array(b, '\r?\n'), lambda x: trim(x) <> '')) >= 2))
        + least(1, len(regexp_extract_all(html, '=>|::|->|\+=|!==|===')))
        + len(regexp_extract_all(html, '(?m)^\s*(?:def|class|import|from|function|var|let|const|public|private)\s+'))
        + len(regexp_extract_all(html, '(?m)^\s*(?:#include|package|using)\s+'))
        + len(regexp_extract_all(html, '\bif\s*\([^)]*\)\s*\{')) AS code,
        (len(regexp_extract_all(html, '(?m)^\s*\|.*\|\s*$')) >= 3 OR len(regexp_extract_all(html, '(?m)^[^\t\n]+\t[^\t\n]+')) >= 3) AS tabular,
        length(regexp_replace(html, '[^{}\[\]();<>=/\\*&^%$#@~`]', '', 'g')) / length(html) AS ratio,
        len(regexp_extract_all(html, '[.!?][\s"'')\]]')) AS ends
      FROM pages)
    SELECT id, round(ratio, 6) AS ratio, code, CASE WHEN trim(t) = '' THEN 'prose' WHEN code >= 2 THEN 'code' WHEN tabular THEN 'tabular' WHEN ratio > 0.08 THEN 'code'
      WHEN length(t) >= 1200 AND ends >= 5 THEN 'long_form' ELSE 'prose' END AS content_type FROM s"""


@query(_TYPE_SQL)
def text_content_type(spark, sf):
    t = F.col("html")
    return table(spark, sf, "pages", "page_id", "html").select(F.col("page_id").alias("id"), F.round(text.symbol_ratio(t), 6).alias("ratio"), text.code_score(t).cast("long").alias("code"), text.content_type(t).alias("content_type"))


@query(r"""
    SELECT conv_id, turn, md5(regexp_replace(regexp_replace(text, '\b[A-Z][a-z]+(?: [A-Z][a-z]+)+\b', '<NAME>', 'g'), '\b\w*\d\w*\b', '<ID>', 'g')) AS masked,
      md5(regexp_replace(trim(text), '\s+', 'ˆ', 'g')) AS spotlit FROM conversations""")
def text_mask_and_spotlight(spark, sf):
    t = F.col("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(text.mask_request(t)).alias("masked"), F.md5(text.spotlight(t)).alias("spotlit"))


@query(r"""
    SELECT page_id, regexp_replace(f, '[\s\-]+', '', 'g') AS folded FROM (
      SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(url), '^\s*https?://', ''), '\s+', ' ', 'g'), '^[\s"'']+|[\s"'']+$', '', 'g') AS f FROM pages)""")
def text_fold_identifier(spark, sf):
    return table(spark, sf, "pages", "page_id", "url").select("page_id", text.fold_identifier(F.col("url")).alias("folded"))


@query(r"""
    WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS s FROM conversations),
    p AS (SELECT conv_id, turn, s, lag(s) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM w)
    SELECT conv_id, turn, CASE WHEN len(s) = 0 OR len(b) = 0 THEN 0.0 ELSE round(len(list_intersect(s, b)) / (len(s) + len(b) - len(list_intersect(s, b))), 6) END AS jaccard FROM p WHERE b IS NOT NULL""")
def text_jaccard_of_turns(spark, sf):
    from pyspark.sql import Window

    t = table(spark, sf, "conversations", "conv_id", "turn", "text").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return t.where("before is not null").select("conv_id", "turn", F.round(text.jaccard(F.col("text"), F.col("before")), 6).alias("jaccard"))


@query("""
    SELECT doc_id, CAST((('0x' || md5(coalesce(text, '')))::UHUGEINT % 100) AS BIGINT) AS bucket FROM documents""")
def text_md5_split(spark, sf):
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", text.md5_bucket(F.col("text")).alias("bucket"))


@query()
def text_windows(spark, sf):
    w = text.windows(F.col("text"))
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", F.posexplode(w).alias("at", "window")).select("doc_id", "at", F.length("window").alias("n"))


@query()
def text_chunks(spark, sf):
    w = text.chunks(F.col("text"))
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", F.posexplode(w).alias("at", "chunk")).select("doc_id", "at", F.length("chunk").alias("n"))


@query(r"""
    SELECT conv_id, count(*) AS turns, sum(length(text)) AS chars, sum(len(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> ''))) AS words FROM conversations GROUP BY conv_id""")
def text_trivial_statistics(spark, sf):
    t = table(spark, sf, "conversations", "conv_id", "text")
    return t.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"), F.sum(F.size(text.words(F.col("text")))).alias("words"))


_SHIFTED = ", ".join(f"length(t) - length(replace(t, '{x}', ''))" for x in decode.LOWER)


@query(f"""
    WITH c AS (SELECT doc_id, [{_SHIFTED}] AS n FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)),
    s AS (SELECT doc_id, n, list_sum(n) AS total FROM c)
    SELECT doc_id, CASE WHEN total >= 20 THEN round(list_sum(list_transform(list_zip(n, {list(decode.ENGLISH)}), lambda x: power(x[1] - total * (x[2] / 100), 2) / (total * (x[2] / 100)))), 4) END AS chi FROM s""")
def decode_chi_squared(spark, sf):
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", F.round(decode.chi_squared(decode.letter_counts(F.col("text"))), 4).alias("chi"))


@query("""
    SELECT conv_id, turn, md5(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm')) AS rot FROM conversations""")
def decode_rot13(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(decode.rot13(F.col("text"))).alias("rot"))


@query()
def decode_views(spark, sf):
    """All views of every turn: as it is, and hidden in base64, hex and percent escapes within other words."""
    t = table(spark, sf, "conversations", "conv_id", "turn", "text")
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    hidden = lambda x: F.concat(F.lit("see: "), x, F.lit(" ."))
    escaped = F.regexp_replace(F.hex(raw), "(..)", "%$1")
    forms = {"as it is": F.col("text"), "base64": hidden(F.translate(F.base64(raw), "\r\n", "")), "hex": hidden(F.hex(raw)), "percent": hidden(escaped)}
    form = F.explode(F.array(*[F.struct(F.lit(k).alias("form"), x.alias("x")) for k, x in forms.items()]))
    return t.select("conv_id", "turn", form.alias("f")).select("conv_id", "turn", "f.form", decode.decoded_views(F.col("f.x")).alias("views"))


def no_lookbehind(p: str) -> str:
    """The same predicate without look-around, for engines that lack it."""
    p = p.replace(".{0,30}(?<![a-z])(your", r"(?:.{0,29}[^a-z\n])(your").replace("(?![a-z]).{0,20}(system", r"(?:[^a-z\n].{0,19})(system")
    return p.replace("(?<!n't )(?<!not )forget", "forget")


# a "forget" that the look-behinds refuse is spelled otherwise first, at the same length
_INJECTION_SQL = " || ".join(f"CASE WHEN regexp_matches({'allowed' if i == 8 else 'text'}, '(?i){no_lookbehind(p)}') THEN '{i},' ELSE '' END" for i, p in enumerate(patterns.INJECTION))


@query(rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), a AS (SELECT *, regexp_replace(text, '(?i)(n''t |not )forget', '\1f_rget', 'g') AS allowed FROM d)
    SELECT doc_id, {_INJECTION_SQL} AS found FROM a""")
def patterns_injection(spark, sf):
    found = F.transform(patterns.hits(F.col("text"), patterns.INJECTION), lambda i: F.concat(i.cast("string"), F.lit(",")))
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", F.array_join(found, "").alias("found"))


@query()
def patterns_injection_level(spark, sf):
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", patterns.injection_level(F.col("text")).alias("level"))


def count_sql(ps, flags):
    return " + ".join("CAST(regexp_matches(coalesce(text, ''), '" + (flags + p).replace("'", "''") + "') AS INTEGER)" for p in ps)


@query()
def patterns_addressee_cues(spark, sf):
    t = F.col("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", patterns.count_hits(t, patterns.STRONG_CUES).alias("strong"), patterns.count_hits(t, patterns.WEAK_CUES).alias("weak"))


@query(f"SELECT page_id, ({count_sql(patterns.DANGEROUS.values(), '(?i)').replace('text', 'html')}) / 4 AS danger FROM pages")
def patterns_dangerous_code(spark, sf):
    return table(spark, sf, "pages", "page_id", "html").select("page_id", patterns.dangerous_code(F.col("html")).alias("danger"))


@query(f"SELECT conv_id, turn, {count_sql([p for p, _ in patterns.REASONING], '')} AS flags, {count_sql(patterns.DISCLOSURE, '(?i)')} AS disclosures FROM (SELECT conv_id, turn, lower(text) AS text FROM conversations)")
def patterns_reasoning_and_disclosure(spark, sf):
    t = F.lower("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", patterns.count_hits(t, [p for p, _ in patterns.REASONING], "").alias("flags"), patterns.count_hits(t, patterns.DISCLOSURE, "(?i)").alias("disclosures"))


def _numbers(kind: str) -> str:
    """Matches that are no part of a decimal number: marked in the text, with the characters before and after looked at."""
    marked = f"regexp_replace(coalesce(text, ''), '{patterns.PERSONAL[kind]}', chr(1) || '\\0' || chr(2), 'g')"
    around = rf"list_filter(regexp_extract_all({marked}, '(?s).?.?\x01[^\x02]*\x02(?:[.,]\d)?'), lambda x: NOT regexp_matches(x, '^\d[.,]\x01|\x02[.,]\d$'))"
    return rf"list_transform({around}, lambda x: regexp_extract(x, '\x01([^\x02]*)', 1))"


def _whole_numbers(kind: str) -> str:
    return f"len({_numbers(kind)})"


_LUHN_SQL = f"list_filter({_numbers('credit_card')}, lambda x: list_sum(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN i % 2 = 0 THEN CASE WHEN CAST(reverse(x)[i] AS INT) > 4 THEN CAST(reverse(x)[i] AS INT) * 2 - 9 ELSE CAST(reverse(x)[i] AS INT) * 2 END ELSE CAST(reverse(x)[i] AS INT) END)) % 10 = 0)"


@query(rf"""
    SELECT doc_id,
      len(list_filter(regexp_extract_all(coalesce(text, ''), '{patterns.PERSONAL['email']}'), lambda x: NOT list_contains({list(patterns.ROLE_MAILBOXES)}, lower(split_part(x, '@', 1))))) AS email,
      len(list_filter(regexp_extract_all(coalesce(text, ''), '{patterns.PERSONAL['ssn']}'), lambda x: x <> '{patterns.EXAMPLE_SSN}')) AS ssn,
      len({_LUHN_SQL}) AS credit_card,
      len(regexp_extract_all(coalesce(text, ''), '{patterns.PERSONAL['api_key']}')) AS api_key,
      len(regexp_extract_all(coalesce(text, ''), '{patterns.PERSONAL['pan']}')) AS pan,
      len(regexp_extract_all(coalesce(text, ''), '{patterns.PERSONAL['jwt_token']}')) AS jwt_token,
      {_whole_numbers('phone_in')} AS phone_in,
      {_whole_numbers('aadhaar')} AS aadhaar,
      len(list_filter(regexp_extract_all(coalesce(text, ''), '{patterns.PERSONAL['financial_disclosure']}'), lambda x: NOT regexp_matches(regexp_replace(x, '\d{{3,4}}\s*$', ''), '(?:[*xX]{{3,}}[\s-]*|\[REDACTED\]\s*)$'))) AS financial_disclosure
    FROM documents""")
def patterns_personal_data(spark, sf):
    kinds = ("email", "ssn", "credit_card", "api_key", "pan", "jwt_token", "phone_in", "aadhaar", "financial_disclosure")
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", *[F.size(patterns.personal(F.col("text"), k)).cast("long").alias(k) for k in kinds])


@query(r"""
    WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents),
    b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM benchmark),
    dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 6)),
    bg AS (SELECT DISTINCT item_id, array_to_string(w[i:i+5], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 4)) AS i FROM b WHERE len(w) >= 6))
    SELECT doc_id, item_id, count(*) AS shared FROM dg JOIN bg USING (g) GROUP BY doc_id, item_id""")
def provenance_copied_passages(spark, sf):
    """Texts that share runs of six words with a source: an equi-join on the runs."""
    runs = lambda t, key: table(spark, sf, t, key, "text").select(key, F.explode(F.array_distinct(text.ngrams(F.col("text"), 6))).alias("g"))
    return runs("documents", "doc_id").join(runs("benchmark", "item_id"), "g").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'))) AS folded FROM documents")
def signing_folded_digest(spark, sf):
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", signing.folded_digest(F.col("text")).alias("folded"))


@query()
def signing_chunk_signatures(spark, sf):
    """HMAC of id and text, verified again; a changed text no longer verifies."""
    key = b"chunk-signing-key"
    t = table(spark, sf, "documents", "doc_id", "text")
    message = F.concat_ws(":", F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")))
    tampered = F.concat_ws(":", F.col("doc_id").cast("string"), F.concat(F.coalesce("text", F.lit("")), F.lit(" ")))
    signed = t.select("doc_id", signing.hmac_sha256(key, message).alias("signature"), signing.hmac_sha256(key, tampered).alias("other"))
    return signed.select("doc_id", "signature", (F.col("signature") == F.col("other")).alias("tampered_verifies"))

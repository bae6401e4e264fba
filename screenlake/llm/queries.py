"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .embedding_dedup import embedding_dedup
from .exact_dedup import exact_dedup
from .language_id import held_out, identify
from .ngram_join import ngram_join
from .packing import pack_documents
from .pieces import nbest
from .repeats import remove_repeats
from .staging import read_table
from .token_files import token_round_trip
from .tokens import tokenizer_path
from .url_filter import rules_from, url_filter
from .warc import warc_round_trip

#: (verdict, host, path)
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), tokenizer_path(), 2048, 1)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(read_table(spark, sf_dir, "pages", ["page_id", "url"]), rules_from(spark, URL_RULES))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), 100)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]), threshold=0.9)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang"]).withColumn("held_out", held_out())
    found = identify(docs.select("doc_id", "text", "held_out"), docs.where("not held_out").select("doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc_round_trip(read_table(spark, sf_dir, "pages", ["page_id", "url", "html"]))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_round_trip(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), tokenizer_path(), 2)


def op8_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbest(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), tokenizer_path("piece_bpe_32k.model"), 4)


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), 4, 85)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


QUERIES = {f.__name__: f for f in (op1_packing, op2_url_filters, op3_suffix_dedup, op4_embedding_dedup, op5_language_id, op6_warc, op7_token_output, op8_sentencepiece_nbest, op9_ngram_jaccard, op10_exact_dedup)}

_RULES_SQL = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)

ORACLE_SQL = {
    "op2_url_filters": rf"""
        WITH parts AS (
          SELECT page_id,
                 translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
          FROM pages),
        rules(verdict, h, p) AS (VALUES {_RULES_SQL}),
        fits AS (
          SELECT page_id, host, path, h || p AS rule, verdict,
                 row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, length(h) DESC, verdict DESC) AS k
          FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
        SELECT parts.page_id, parts.host, parts.path, fits.rule AS rule, coalesce(fits.verdict, 'allow') AS verdict
        FROM parts LEFT JOIN fits ON parts.page_id = fits.page_id AND fits.k = 1""",
    "op10_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
}

"""The operators' queries with production parameters, and their SQL."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonehour.sources.shared import fresh_path

from . import (bpe, collocations, fingerprints, html_text, licenses, line_dedup, mixing, near_dedup, periodic_runs,
               quality, sharding, token_files, web_archives)
from .common import table

QUERIES = {}
ORACLES = {}

MIX_SEED, SHARD_SEED, SHARDS = 5, 6, 40


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return keep


@query("op1_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_near_dedup")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.class_ids(table(spark, sf_dir, "documents"))


@query("op3_html_text")
def html_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


LINE_DOCS = 10


@query("op4_line_dedup", f"""
    WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
    lines AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM split),
    keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
    often AS (SELECT key AS often_key FROM keyed WHERE length(key) >= 1
              GROUP BY key HAVING count(DISTINCT doc_id) >= {LINE_DOCS})
    SELECT doc_id, count(*) AS n_lines, count(often_key) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE often_key IS NULL), '')) AS kept_sha256
    FROM keyed LEFT JOIN often ON key = often_key GROUP BY doc_id""")
def line_dedup_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(table(spark, sf_dir, "documents"), LINE_DOCS)


@query("op5_pfair_mixing")
def pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.xxhash64("text").alias("text"))
    return mixing.mix(docs, seed=MIX_SEED).drop("text")


@query("op6_stratified_shards")
def stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digests(table(spark, sf_dir, "documents"), SHARDS, seed=SHARD_SEED)


WORDS, END_ID = "word_bpe_49k.json", 1


@query("op7_token_files")
def token_file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.file_digests(table(spark, sf_dir, "documents"), fresh_path(spark, "tokens"),
                                    public_tokenizers.path(WORDS), END_ID, encode_special_tokens=False)


@query("op8_parsing_fingerprints")
def parsing_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_digests(table(spark, sf_dir, "documents"))


RANKS = "byte_bpe_multi_50k.tiktoken"


@query("op9_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS),
                                public_tokenizers.PATTERN)


@query("op10_license_scan")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


PHRASE_COUNT, COVERED_PERCENT, PHRASES = 30, 80, 2000


@query("op11_collocations", f"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(string_split(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?' || chr(11) || chr(12) || chr(13) || chr(9),
            'abcdefghijklmnopqrstuvwxyz' || repeat(chr(10), 9) || ' '), chr(10))) AS piece FROM documents),
    numbered AS (SELECT lang, list_filter(string_split(piece, ' '), lambda x: x != '') AS w,
                        row_number() OVER () AS id FROM pieces),
    words AS (SELECT lang, id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM numbered),
    next AS (SELECT lang, word AS w1, lead(word, 1) OVER p AS w2, lead(word, 2) OVER p AS w3, lead(word, 3) OVER p AS w4
             FROM words WINDOW p AS (PARTITION BY id ORDER BY pos)),
    f AS MATERIALIZED (
        SELECT lang, 1 AS k, w1 AS gram, count(*) AS n FROM next GROUP BY ALL
        UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM next WHERE w2 IS NOT NULL GROUP BY ALL
        UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM next WHERE w3 IS NOT NULL GROUP BY ALL
        UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) FROM next WHERE w4 IS NOT NULL GROUP BY ALL),
    candidates AS MATERIALIZED (SELECT lang, k, gram, n AS a, string_split(gram, ' ') AS w
                                FROM f WHERE k > 1 AND n >= {PHRASE_COUNT}),
    cuts AS (SELECT c.*, cut, array_to_string(w[:cut], ' ') AS first, array_to_string(w[cut + 1:], ' ') AS rest
             FROM candidates c, (VALUES (1), (2), (3)) AS cs(cut) WHERE cut < k),
    begun AS MATERIALIZED (SELECT cuts.*, x.n AS l FROM cuts JOIN f x ON x.lang = cuts.lang AND x.gram = first),
    scored AS (SELECT begun.*, y.n AS r, (2000000::HUGEINT * a) // (l + y.n) AS score
               FROM begun JOIN f y ON y.lang = begun.lang AND y.gram = rest),
    lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, cut) = 1),
    longer AS (SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS gram, max(a) AS longest FROM (
                   SELECT lang, a, w, size, unnest(generate_series(1, k - size + 1)) AS i
                   FROM candidates, (VALUES (2), (3)) AS ss(size) WHERE size < k) GROUP BY ALL),
    kept AS (SELECT lowest.* FROM lowest LEFT JOIN longer USING (lang, gram)
             WHERE longest IS NULL OR 100::HUGEINT * longest < {COVERED_PERCENT}::HUGEINT * a),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, gram) AS place FROM kept)
    SELECT lang, place AS rank, gram AS phrase, a, l, r, words AS n, CAST(score AS BIGINT) AS score
    FROM ranked JOIN (SELECT lang, CAST(sum(n) AS BIGINT) AS words FROM f WHERE k = 1 GROUP BY lang) USING (lang)
    WHERE place <= {PHRASES}""")
def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), PHRASE_COUNT, COVERED_PERCENT, PHRASES)


@query("op12_web_archives", """
    WITH sized AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS size FROM pages),
    kept AS (SELECT *, CASE WHEN size >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS keeper FROM sized)
    SELECT page_id, size AS payload_bytes, sha1(html) AS payload_digest,
           CASE WHEN keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
           nullif(keeper, page_id) AS refers_to
    FROM kept""")
def web_archive_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web_archives.archived_pages(table(spark, sf_dir, "pages"), fresh_path(spark, "archives"))


@query("op13_periodic_runs")
def periodic_run_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(table(spark, sf_dir, "documents"))

"""The queries ``opN_<name>`` over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from allelica.llm.common import crc_part


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rules on host and path that op1 judges by.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from allelica.llm import urls

    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    model = urls.train(pages, URL_RULES)
    return urls.judge(pages, model, URL_RULES).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "ratio")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from allelica.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), capacity=1024).withColumnRenamed("id", "doc_id")


def op3_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from allelica.llm.mixing import mix

    out = mix(_table(spark, sf_dir, "documents"), most_epochs=2.0)
    return out.select("doc_id", "source", "epoch", "place")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from allelica.llm import langid

    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs, crc_part("doc_id", 4) != 2)
    return langid.identify(docs, model).select(F.col("id").alias("doc_id"), _held_out(4, 2), "lang_pred", "score")


def _held_out(modulus: int, rest: int) -> Column:
    """Null ids aren't held out."""
    return F.coalesce(crc_part("id", modulus) == rest, F.lit(False)).alias("held_out")


def _scored(out: DataFrame, modulus: int, rest: int, *more: Column) -> DataFrame:
    return out.select(F.col("id").alias("doc_id"), _held_out(modulus, rest), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *more)


def op6_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from allelica.llm import audio

    return audio.digests(audio.store(_table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op7_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from allelica.llm import quality

    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"), crc_part("doc_id", 3) != 1)
    return _scored(quality.score(docs, model), 3, 1)


def op10_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from allelica.llm import toxicity

    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), crc_part("doc_id", 5) != 0)
    return _scored(toxicity.score(docs, model), 5, 0, F.size("spans").cast("long").alias("n_segments"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from allelica.llm.substring import remove_repeated

    out = remove_repeated(_table(spark, sf_dir, "documents"), window=13)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], chr(10)) AS w
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13)
), least AS (
  SELECT w, min(doc_id) AS lo FROM win GROUP BY w
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN least USING (w) WHERE lo < doc_id
), words AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
), n AS (
  SELECT doc_id, count(*) AS c FROM gone GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(c, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op8_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from allelica.llm.minhash import near_duplicates

    out = near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, percent=80)
    return out.withColumnRenamed("id", "doc_id")


def op9_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from allelica.llm.capfilter import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.98).withColumnRenamed("id", "vec_id")


OP9_SQL = r"""
WITH RECURSIVE e AS MATERIALIZED (
  SELECT vec_id, label, v, list_dot_product(v, v) AS q
  FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
), ok AS MATERIALIZED (
  SELECT * FROM e WHERE label IS NOT NULL AND q > 0 AND isfinite(q) AND len(list_filter(v, lambda x: x IS NULL)) = 0
), link AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / sqrt(a.q * b.q) >= 0.98
), reach(id, r) AS (
  SELECT vec_id, vec_id FROM e UNION SELECT y, r FROM reach JOIN link ON x = id
), comp AS (
  SELECT id, min(r) AS c FROM reach GROUP BY id
), n AS (
  SELECT x, count(*) AS n FROM link GROUP BY x
)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, c AS component_id, c = e.vec_id AS kept
FROM e JOIN comp ON comp.id = e.vec_id LEFT JOIN n ON n.x = e.vec_id
"""

OP8_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], chr(10)) AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM d WHERE len(ws) > 0)
), size AS MATERIALIZED (
  SELECT doc_id, count(*) AS n, sum(hash(s)) AS h FROM sh GROUP BY doc_id
), rep AS MATERIALIZED (
  SELECT h, n, min(doc_id) AS id FROM size GROUP BY h, n
), one AS MATERIALIZED (
  SELECT sh.doc_id AS id, s FROM sh SEMI JOIN (SELECT id AS doc_id FROM rep) USING (doc_id)
), pairs AS (
  SELECT a.id AS x, b.id AS y, count(*) AS common FROM one a JOIN one b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2
), link AS MATERIALIZED (
  SELECT x, y FROM pairs JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * common >= 80 * (p.n + q.n - common)
), edge AS MATERIALIZED (
  SELECT x, y FROM link UNION SELECT y, x FROM link
), reach(id, r) AS (
  SELECT id, id FROM rep UNION SELECT e.y, r FROM reach JOIN edge e ON e.x = reach.id
), comp AS (
  SELECT id, min(r) AS c FROM reach GROUP BY id
)
SELECT d.doc_id, CAST(coalesce(size.n, 0) AS BIGINT) AS n_shingles, coalesce(c, d.doc_id) AS component_id,
       coalesce(c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN size USING (doc_id) LEFT JOIN rep ON rep.h = size.h AND rep.n = size.n LEFT JOIN comp ON comp.id = rep.id
"""

OP3_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source, CAST('0x' || substr(md5('3:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS key,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS t
  FROM documents
), src AS (
  SELECT source, sum(t) AS t FROM d GROUP BY source
), lim AS (
  SELECT CAST(max(t) AS DOUBLE) AS hi, CASE WHEN max(t) / min(t) <= 2 THEN 0.0 ELSE 1 - ln(2.0) / ln(max(t) / min(t)) END AS a FROM src WHERE t > 0
), reads AS (
  SELECT source, t, CASE WHEN t > 0 THEN CASE WHEN abs(e - round(e)) < 1e-9 THEN round(e) ELSE e END ELSE 1.0 END AS e
  FROM (SELECT source, t, pow(t / hi, a - 1) AS e FROM src, lim)
), budget AS (
  SELECT source, CAST(floor(e) AS BIGINT) AS times, CAST(round((e - floor(e)) * t) AS BIGINT) AS rest FROM reads
), unit AS (
  SELECT source, key, sum(sum(t)) OVER (PARTITION BY source ORDER BY key) AS upto FROM d GROUP BY source, key
), n AS (
  SELECT d.doc_id, d.source, d.key, times + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS times
  FROM d JOIN budget b ON d.source IS NOT DISTINCT FROM b.source JOIN unit u ON d.source IS NOT DISTINCT FROM u.source AND d.key = u.key
)
SELECT doc_id, source, CAST(epoch AS INTEGER) AS epoch, CAST('0x' || substr(md5('3:' || epoch || ':' || key), 1, 15) AS BIGINT) AS place
FROM (SELECT *, unnest(range(1, times + 1)) AS epoch FROM n)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_temperature_mixing": op3_temperature_mixing,
    "op4_language_id": op4_language_id,
    "op6_telephony_audio": op6_telephony_audio,
    "op7_quality_nbsvm": op7_quality_nbsvm,
    "op10_toxic_segments": op10_toxic_segments,
    "op5_substring_dedup": op5_substring_dedup,
    "op8_minhash_neardup": op8_minhash_neardup,
    "op9_cap_filters": op9_cap_filters,
}

ORACLES: dict[str, str] = {
    "op3_temperature_mixing": OP3_SQL,
    "op5_substring_dedup": OP5_SQL,
    "op8_minhash_neardup": OP8_SQL,
    "op9_cap_filters": OP9_SQL,
}

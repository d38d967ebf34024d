"""Registered queries of the training-data operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchtrail.llm import (block_ann, html_extract, lexical_rank, merkle, near_dedup, packing, pii, piece_sampling, quality,
                            token_count, toxicity, url_filter, whitening)

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, as ``--py-files`` would."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    target = os.path.join(tempfile.mkdtemp(prefix="batchtrail-ship-"), f"batchtrail-{uuid.uuid4().hex[:8]}")
    spark.sparkContext.addPyFile(shutil.make_archive(target, "zip", root, "batchtrail"))
    _SHIPPED.add(app)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _file(name: str) -> bytes:
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return near_dedup.near_duplicate_classes(_read(spark, sf_dir, "documents"))


# ---- op2: every page is a capture; fetch times and the dated lists follow from the pages themselves

def _hex(text: Column, start: int) -> Column:
    return F.conv(F.substring(F.md5(text), start, 7), 16, 10).cast("long")


def captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch time in 2024 to the second, made from a hash of id and URL (the tables have none)."""
    second = _hex(F.concat_ws("/", F.col("page_id").cast("string"), "url"), 1) % (366 * 86_400)
    return pages.select("page_id", "url", F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + second).alias("fetched_at"))


def dated_lists(pages: DataFrame) -> DataFrame:
    """Dated changes of three lists, made from hashes of every domain, host and first path segment that the pages have."""
    host, path = url_filter.url_host(F.col("url")), url_filter.url_path(F.col("url"))
    patterns = (pages.select(host.alias("h"), path.alias("p")).where("h is not null")
                .select(F.explode(F.array_compact(F.array(
                    F.substring_index("h", ".", -3), F.col("h"),
                    F.when(F.size("p") > 0, F.concat("h", F.lit("/"), F.lower(F.get("p", F.lit(0)))))))).alias("pattern")).distinct())
    change = patterns.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5)))) \
        .withColumn("code", F.concat_ws("#", "pattern", F.col("k").cast("string"))) \
        .where(_hex(F.col("code"), 1) % 3 == 0)
    return change.select(
        F.element_at(F.array(F.lit("allow"), F.lit("malware"), F.lit("spam")), (_hex(F.col("code"), 8) % 3 + 1).cast("int")).alias("list"),
        "pattern",
        F.timestamp_seconds(F.unix_timestamp(F.lit("2023-07-01 00:00:00")) + _hex(F.col("code"), 15) % (549 * 86_400)).alias("at"),
        F.when(_hex(F.col("code"), 22) % 3 > 0, "add").otherwise("remove").alias("action"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the list entries active when it was fetched."""
    pages = _read(spark, sf_dir, "pages")
    judged = url_filter.judge(captures(pages), dated_lists(pages))
    return judged.withColumn("fetched_at", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss"))


OP2_SQL = r"""
WITH parsed AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_seconds(('0x' || substr(md5(concat_ws('/', page_id::VARCHAR, url)), 1, 7))::BIGINT % (366 * 86400)) AS fetched_at,
    nullif(lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '\.$', '')), '') AS h,
    list_filter(string_split(regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1), '/'), lambda s: length(s) > 0) AS p
  FROM pages),
patterns AS (
  SELECT DISTINCT unnest(list_filter([
      array_to_string(string_split(h, '.')[greatest(1, len(string_split(h, '.')) - 2):], '.'), h,
      CASE WHEN len(p) > 0 THEN h || '/' || lower(p[1]) END], lambda x: x IS NOT NULL)) AS pattern
  FROM parsed WHERE h IS NOT NULL),
codes AS (SELECT pattern, md5(pattern || '#' || k::VARCHAR) AS m FROM patterns, range(0, 6) t(k)),
changes AS (
  SELECT ['allow', 'malware', 'spam'][('0x' || substr(m, 8, 7))::BIGINT % 3 + 1] AS list, lower(pattern) AS pattern,
    TIMESTAMP '2023-07-01' + to_seconds(('0x' || substr(m, 15, 7))::BIGINT % (549 * 86400)) AS moment,
    max(CASE WHEN ('0x' || substr(m, 22, 7))::BIGINT % 3 > 0 THEN 'add' ELSE 'remove' END) AS action
  FROM codes WHERE ('0x' || substr(m, 1, 7))::BIGINT % 3 = 0 GROUP BY 1, 2, 3),
spans AS (SELECT * FROM (
  SELECT *, lead(moment) OVER (PARTITION BY list, pattern ORDER BY moment) AS until FROM changes) WHERE action = 'add'),
asked AS (
  SELECT page_id, url, fetched_at, array_to_string(string_split(h, '.')[len(string_split(h, '.')) - k + 1:], '.') AS pattern, k AS specificity
  FROM parsed, range(1, 65) t(k) WHERE h IS NOT NULL AND k <= len(string_split(h, '.')) AND (k <= 5 OR k = len(string_split(h, '.')))
  UNION
  SELECT page_id, url, fetched_at, h || '/' || array_to_string(list_transform(p[1:k], lambda s: lower(s)), '/'), k + 1000
  FROM parsed, range(1, 5) t(k) WHERE h IS NOT NULL AND k <= len(p)),
hits AS (
  SELECT a.page_id, a.url, s.list, s.pattern,
    row_number() OVER (PARTITION BY a.page_id, a.url ORDER BY a.specificity DESC, (s.list = 'allow') DESC, s.moment DESC, s.list DESC, s.pattern DESC) AS n,
    count(*) OVER (PARTITION BY a.page_id, a.url) AS active
  FROM asked a JOIN spans s ON a.pattern = s.pattern AND s.moment <= a.fetched_at AND (s.until IS NULL OR a.fetched_at < s.until))
SELECT c.page_id, c.url, strftime(c.fetched_at, '%Y-%m-%d %H:%M:%S') AS fetched_at,
  CASE WHEN c.h IS NULL THEN 'unknown' WHEN b.list IS NULL THEN 'unlisted' WHEN b.list = 'allow' THEN 'allowed' ELSE 'blocked' END AS verdict,
  b.list, b.pattern, coalesce(b.active, 0) AS active
FROM parsed c LEFT JOIN hits b ON b.n = 1 AND c.page_id = b.page_id AND c.url = b.url
"""


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior quality of every document; its source is the host, source and language the path below it."""
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    scored = quality.with_quality(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang"), out="score")
    return scored.select("doc_id", "source", "lang", "evidence", "score", (F.col("score") >= quality.THRESHOLD).alias("keep"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = html_extract.extract(_read(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of tokens of every document."""
    counts = token_count.token_counts(_read(spark, sf_dir, "documents"), _file("word_bpe_49k.json").decode())
    return counts.withColumn("over_limit", F.col("n_tokens") > token_count.LIMIT)


def op6_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document against its edited text and the next document."""
    return merkle.compared_with_next(_read(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length bucket and batch of every document."""
    return packing.pack(_read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampled segmentation of every document: its size, a digest of its ids and whether they spell the text."""
    rows = piece_sampling.round_trip(_read(spark, sf_dir, "documents"), _file("piece_bpe_32k.model"))
    return rows.withColumnRenamed("key", "doc_id")


def op10_block_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth vector."""
    return block_ann.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP10_SQL = """
WITH good AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
far AS (
  SELECT q.vec_id AS query_id, c.vec_id, min(sqrt(list_sum(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))) AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0 GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank FROM far)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: fixed forms, and identifiers that their context gives away."""
    return pii.personal_data(_read(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sixteen leading whitened components of every vector."""
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


def op13_lexical_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical_rank.ranked(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS doc, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
totals AS (SELECT count(*)::BIGINT AS big_n, sum(len(t))::BIGINT AS big_l FROM words WHERE len(t) > 0),
tf AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(t) AS term FROM words) WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2),
weight AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, totals GROUP BY term, big_n),
scored AS (
  SELECT a.item_id, d.doc_id, d.doc, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(d.t) * big_n) // big_l))))::BIGINT AS score
  FROM asked a JOIN tf USING (term) JOIN weight USING (term) JOIN words d USING (doc), totals GROUP BY 1, 2, 3),
best AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM best WHERE rank <= 10
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over ``documents``."""
    ship(spark)
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_near_dedup, op2_url_filter, op3_quality, op4_html_extract, op5_token_counts, op6_merkle, op7_packing, op8_toxicity,
    op9_piece_sampling, op10_block_ann, op11_pii, op12_whitening, op13_lexical_rank, pipeline)}
ORACLE_SQL: dict[str, str] = {"op2_url_filter": OP2_SQL, "op10_block_ann": OP10_SQL, "op13_lexical_rank": OP13_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL

"""Substring searches over an index of trigrams (O-FLT-2/6/7/12).

``build`` writes two folders: the postings (one row per trigram, column and row,
in folders by trigram) and the texts (in folders by id).  ``find`` reads the
postings of the rarest trigrams of the search text, keeps the rows that have all
of them in one column, fetches their texts and applies the LIKE rule to these
alone, so the result is that of the scan.  A search without three letters, digits
or signs in a row (short or empty, or made of wildcards) has no trigram and scans.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchtrail.functions.text import contains_pattern
from batchtrail.session import stored

FOLDERS = 64
#: Trigrams that a search looks up; the rarest narrow it most.
MOST_GRAMS = 4
#: Most candidate ids that are sent to every task; more are joined by shuffle.
BROADCAST_IDS = 100_000


def _folder(c: str | Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(FOLDERS)).cast("int")


def grams_of(search: str) -> list[str]:
    """Trigrams that every match of the search text holds.

    ``%`` and ``_`` are wildcards and end a run; so do characters beyond ASCII,
    whose lower case may differ between engines.
    """
    runs = re.findall(r"[\x20-\x24\x26-\x5e\x60-\x7e]{3,}", search)
    return sorted({run[i:i + 3].lower() for run in runs for i in range(len(run) - 2)})


def build(df: DataFrame, id_col: str, columns: list[str], path: str) -> None:
    """Write the index of the text columns of ``df`` under ``path``; null texts have no postings."""
    texts = df.select(F.col(id_col).alias("id"), *columns).withColumn("id_folder", _folder("id"))
    texts.repartition("id_folder").write.mode("overwrite").partitionBy("id_folder").parquet(f"{path}/texts")
    each = texts.select("id", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lower(c).alias("text")) for c in columns]))) \
        .where(F.char_length("text") >= 3)
    grams = F.transform(F.sequence(F.lit(1), F.char_length("text") - 2), lambda i: F.substr("text", i, F.lit(3)))
    postings = each.select("id", "column", F.explode(F.array_distinct(grams)).alias("gram"))
    # a common trigram is spread over the ids; inside a file the rows of a trigram lie together and others are skipped
    postings.withColumn("gram_folder", _folder("gram")).repartition("gram_folder", _folder("id")) \
        .sortWithinPartitions("gram_folder", "gram").write.mode("overwrite").partitionBy("gram_folder").parquet(f"{path}/postings")
    counts = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    counts.withColumn("gram_folder", _folder("gram")).write.mode("overwrite").partitionBy("gram_folder").parquet(f"{path}/counts")


def _of_grams(table: DataFrame, grams: list[str]) -> DataFrame:
    folders = table.sparkSession.createDataFrame([(g,) for g in grams], "gram string").select(_folder("gram").alias("f")).distinct()
    return table.where(F.col("gram_folder").isin([r.f for r in folders.collect()]) & F.col("gram").isin(grams))


def candidates(spark: SparkSession, path: str, grams: list[str]) -> DataFrame:
    """Ids of the rows that have all the rarest of ``grams`` in one column."""
    counts = {r.gram: r.n for r in _of_grams(spark.read.parquet(f"{path}/counts"), grams).select("gram", "n").collect()}
    if len(counts) < len(grams):  # a trigram that no text has
        return spark.read.parquet(f"{path}/texts").select("id", "id_folder").limit(0)
    rare = sorted(counts, key=lambda g: (counts[g], g))[:MOST_GRAMS]
    hits = _of_grams(spark.read.parquet(f"{path}/postings"), rare)
    full = hits.groupBy("column", "id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(rare))
    return full.select("id").distinct().withColumn("id_folder", _folder("id"))


def find(spark: SparkSession, path: str, columns: list[str], search: str) -> DataFrame:
    """Rows (id and the columns) with the search text in one of ``columns``, as the scan finds them, case ignored."""
    texts = spark.read.parquet(f"{path}/texts")
    grams = grams_of(search)
    if grams:
        found = stored(candidates(spark, path, grams), "search_candidates")
        if found.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
            # at most FOLDERS numbers; as literals they prune the texts
            texts = texts.where(F.col("id_folder").isin([r.id_folder for r in found.select("id_folder").distinct().collect()]))
            found = F.broadcast(found)
        texts = texts.join(found, ["id_folder", "id"], "left_semi")
    like = contains_pattern(search) if search else "%"
    hit = reduce(lambda a, b: a | b, [F.col(c).ilike(like) for c in columns])
    return texts.where(F.coalesce(hit, F.lit(False))).select("id", *columns)

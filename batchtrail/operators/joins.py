"""Joins of entries to runs and users (O-JOIN-1/5).

Standalone entries carry a NULL run id (T16), and entries may lack an
employee number; hash partitioning sends every NULL key to one reducer.  The
left joins here widen the key with a salt that is non-zero only on NULL-key
rows (they can never match anyway), so those rows spread over all
partitions, however many there are.  The salt is a hash of the row's own id, so a
retried task reproduces exactly the same partitioning.  Catalyst/AQE still
choose a broadcast join when the right side is small at runtime; a hot
non-NULL key is split by AQE's skew-join rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def left_join_spread_nulls(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                           row_id: str) -> DataFrame:
    """``left LEFT JOIN right ON left.left_key = right.right_key`` with NULL left keys spread.

    ``right`` must not have a column named like a left column other than the key.
    """
    salt = F.when(F.col(left_key).isNull(), F.xxhash64(F.col(row_id))).otherwise(F.lit(0))
    lhs = left.withColumn("__salt_l", salt.cast("long"))
    # 0 on every right row, written as a hash expression the optimizer cannot
    # evaluate at plan time: a literal 0 (or isnull(key), once the join implies
    # the key is not null) is folded, the salt leaves the join keys and becomes a
    # post-join filter, and every NULL-key row would go to one partition again
    rhs = right.withColumn("__salt_r", F.pmod(F.xxhash64(F.col(right_key)), F.lit(1)).cast("long"))
    cond = (lhs[left_key] == rhs[right_key]) & (lhs["__salt_l"] == rhs["__salt_r"])
    return lhs.join(rhs, cond, "left").drop("__salt_l", "__salt_r")


def join_runs(df: DataFrame, runs: DataFrame, columns, key: str = "run_id", row_id: str = "id",
              prefix: str = "") -> DataFrame:
    """``df LEFT JOIN runs ON runs.id = df.key``, bringing ``columns`` (renamed with ``prefix``)."""
    picked = runs.select(F.col("id").alias("__run_id"), *[F.col(c).alias(prefix + c) for c in columns])
    return left_join_spread_nulls(df, picked, key, "__run_id", row_id).drop("__run_id")


def join_users(df: DataFrame, users: DataFrame, employee_col: str = "employee", row_id: str = "record_id") -> DataFrame:
    """LEFT JOIN users on employee number (O-JOIN-5), bringing name and initials.

    Users is a dimension; AQE turns this into a broadcast join at runtime when
    the measured side is under the broadcast threshold, else a sort-merge join.
    """
    u = users.select(F.col("employee_number").alias("__emp"), F.col("full_name").alias("employee_name"),
                     F.col("initials").alias("user_initials"))
    rid = row_id if row_id in df.columns else "id"
    return left_join_spread_nulls(df, u, employee_col, "__emp", rid).drop("__emp")


#: Rows of 64 bits that ``sifted`` broadcasts at most.
SIFT_WORDS = 1 << 17


def sifted(rows: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose ``column`` is none of the ``keys``, so that an exact join after it shuffles less.

    Every key sets one bit by its hash, 64 to a row, and these rows are
    broadcast: their number is bounded however many keys there are.  Rows of a
    key always pass, some others pass by chance and are left to the join.  The
    hash is that of a type, so columns of different types are not sifted.
    """
    if rows.schema[column].dataType != keys.schema[key].dataType:
        return rows

    def place(c: str) -> tuple[Column, Column]:
        h = F.xxhash64(c)
        return F.pmod(h, F.lit(SIFT_WORDS)), F.pmod(F.shiftright(h, 32), F.lit(64)).cast("int")

    word, bit = place(key)
    words = (keys.where(F.col(key).isNotNull()).select(word.alias("__word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("__set"))
             .groupBy("__word").agg(F.bit_or("__set").alias("__bits")))
    word, bit = place(column)
    return rows.join(F.broadcast(words), (word == F.col("__word")) & (F.getbit("__bits", bit) == 1), "left_semi")

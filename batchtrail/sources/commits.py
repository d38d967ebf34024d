"""Appends that become visible as a whole (O-SNK-1).

An append writes the rows of every table it touches into a folder of its own
(``{root}/{table}/batch=<token>``) and one commit row last.  Readers take the
folders of committed tokens only, so a job that dies between its parent and its
child rows shows neither.  A token names one append: given again after a
failure it writes the same folders anew, given again after its commit it does
nothing.  The commit row keeps the last id of every table, so numbering goes on
without reading the tables.  One writer appends at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchtrail.functions.time import effective_date
from batchtrail.operators.sequence import assign_ids
from batchtrail.session import stored
from batchtrail.sources.process_tables import ProcessTables
from batchtrail.sources.sinks import read_if_there
from batchtrail.sources.tables import SCHEMAS, reconcile_schema

COMMIT_SCHEMA = T.StructType([
    T.StructField("token", T.StringType()), T.StructField("table", T.StringType()),
    T.StructField("rows", T.LongType()), T.StructField("last_id", T.LongType()),
])


def commits(spark: SparkSession, root: str) -> DataFrame:
    """One row per committed append and table."""
    there = read_if_there(spark.read.schema(COMMIT_SCHEMA).format("parquet"), f"{root}/_commits")
    return there if there is not None else spark.createDataFrame([], COMMIT_SCHEMA)


def committed(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The rows of a table that committed appends wrote, in the table's declared columns."""
    schema = SCHEMAS[table]
    tokens = commits(spark, root).where(F.col("table") == table).select(F.col("token").alias("batch"))
    partitions = T.StructType([*schema.fields, T.StructField("entry_month", T.StringType()), T.StructField("batch", T.StringType())])
    rows = read_if_there(spark.read.schema(partitions).format("parquet"), f"{root}/{table}")
    if rows is None:
        return spark.createDataFrame([], schema)
    # folders of other tokens are pruned by the join
    return rows.join(tokens, "batch", "left_semi").select(*schema.fieldNames())


def committed_tables(spark: SparkSession, root: str) -> ProcessTables:
    """The process tables as the committed appends left them."""
    return ProcessTables(lambda name: committed(spark, root, name))


@dataclass
class Children:
    """Child rows of an append: their table, the column that takes the parent's id, and their order below the parent."""
    table: str
    rows: DataFrame
    parent: str
    order: list[str]


def _numbered(df: DataFrame, order: list[Column], base: int) -> DataFrame:
    return assign_ids(df.drop("id"), order, base, "id")


def append_entries_with_children(spark: SparkSession, root: str, token: str, table: str, entries: DataFrame, children: list[Children] = (),
                                 key: str = "entry_key", order: list[str] = ("created_at",)) -> bool:
    """Append entries and their child rows under one commit (O-SNK-1, O-STATE-6); False where ``token`` is committed already.

    ``key`` names an entry inside the append, for its child rows; it must be
    unique and not null.  Ids follow the last committed ones, entries in ``order``
    (then key), child rows in the order of their entries.  A child row whose key no
    entry has is refused with the whole append.
    """
    done = commits(spark, root)
    if not done.where(F.col("token") == token).isEmpty():
        return False
    last = {r.table: r.last_id for r in done.groupBy("table").agg(F.max("last_id").alias("last_id")).collect()}
    numbered = stored(_numbered(entries, [*[F.col(c) for c in order], F.col(key)], last.get(table) or 0), f"append-{table}")
    ids = numbered.select(key, F.col("id").alias("__parent"))
    if not ids.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull()).isEmpty():
        raise ValueError(f"entries of append {token} don't have one key each")
    # the tables written, with their rows; nothing of them is visible before the commit
    written = {table: _write(numbered, root, table, token, entry_month())}
    for c in children:
        if not c.rows.join(ids, key, "left_anti").isEmpty():
            raise ValueError(f"child rows of append {token} without an entry")
        own = c.rows.join(ids, key).withColumn(c.parent, F.col("__parent"))
        own = stored(_numbered(own, [F.col("__parent"), *[F.col(o) for o in c.order]], last.get(c.table) or 0), f"append-{c.table}")
        written[c.table] = _write(own, root, c.table, token, None)
    _commit(spark, root, token, [(token, name, rows, top if rows else last.get(name) or 0) for name, (rows, top) in written.items()])
    return True


def entry_month() -> Column:
    """Month of an entry, which prunes date-range reads."""
    month = F.substring(effective_date("entry_date", "created_at"), 1, 7)
    return F.coalesce(F.nullif(month, F.lit("")), F.lit("undated"))


def _write(df: DataFrame, root: str, table: str, token: str, month: Column | None) -> tuple[int, int]:
    """Write the rows of one table into the token's folders; (rows, last id)."""
    rows = reconcile_schema(df, table)
    parted = rows.withColumn("entry_month", month if month is not None else F.lit("all"))
    parted.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("entry_month").parquet(f"{root}/{table}/batch={token}")
    n, top = df.agg(F.count(F.lit(1)), F.max("id")).first()
    return n, top


def _commit(spark: SparkSession, root: str, token: str, rows: list[tuple]) -> None:
    """The commit: one file, there as a whole or not at all."""
    spark.createDataFrame(rows, COMMIT_SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/_commits")

"""Sinks: appends, child replacement, packet documents, manifest, high-water mark.

O-SNK-1..7.  Every writer targets a folder on shared storage; writes are
idempotent per partition (dynamic partition overwrite) or append-only logs,
so a retried job never leaves half a result visible as the final state: the
high-water mark is written last, only after the data.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchtrail.functions.time import effective_date

MARK_SCHEMA = T.StructType([
    T.StructField("last_successful_export_at", T.StringType()),
    T.StructField("last_scope", T.StringType()),
    T.StructField("last_scope_label", T.StringType()),
    T.StructField("last_export_name", T.StringType()),
    T.StructField("last_run_count", T.LongType()),
    # where the export lies and who made it: the same row publishes, marks and audits it
    T.StructField("export_path", T.StringType()),
    T.StructField("exported_by", T.StringType()),
])


def append_entries(df: DataFrame, path: str, entry_date: str = "entry_date", created_at: str = "created_at") -> None:
    """Append entries partitioned by entry month (O-SNK-1); the month prunes date-range reads."""
    month = F.substring(effective_date(entry_date, created_at), 1, 7)
    df.withColumn("entry_month", F.coalesce(F.nullif(month, F.lit("")), F.lit("undated"))) \
        .write.mode("append").partitionBy("entry_month").parquet(path)


def replace_children(children: DataFrame, edited_ids: DataFrame, new_children: DataFrame,
                     parent_col: str = "filtration_entry_id") -> DataFrame:
    """Children after an edit: the edited parents' rows are replaced by the submitted set (O-SNK-2)."""
    ids = edited_ids.select(F.col(parent_col)).distinct()
    kept = children.join(ids, parent_col, "left_anti")
    return kept.unionByName(new_children.select(*children.columns))


def append_log(df: DataFrame, path: str) -> None:
    """Append-only log sink (O-SNK-3 audit rows, O-SNK-4 field changes)."""
    df.write.mode("append").parquet(path)


def write_packets(packets: DataFrame, path: str) -> None:
    """One JSON document per run under ``export_month=YYYY-MM`` (O-SNK-5).

    The whole folder is replaced: months of an earlier export of the same name must not be read back and counted.
    """
    packets.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("export_month").json(path)


def write_manifest(manifest: DataFrame, summary: DataFrame, path: str) -> None:
    """Manifest rows as CSV sorted by (date, label), plus a one-row summary (O-SNK-6).

    Sorting is a range-partitioned sort; the files are ordered part by part.
    """
    manifest.orderBy("entry_date", "run_label", "run_id").write.mode("overwrite").option("header", True) \
        .csv(f"{path}/rows")
    summary.write.mode("overwrite").option("header", True).csv(f"{path}/summary")


def read_mark(spark: SparkSession, path: str) -> str:
    """Last successful export time, or '' when no export finished yet (O-SNK-7); any error but a missing folder is raised."""
    marks = read_if_there(spark.read.schema(MARK_SCHEMA).format("json"), path)
    if marks is None:
        return ""
    row = marks.agg(F.max("last_successful_export_at")).first()
    return (row[0] or "") if row else ""


def read_if_there(reader: DataFrameReader, path: str) -> DataFrame | None:
    """The data at ``path``, None only where the path does not exist."""
    try:
        return reader.load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def write_mark(spark: SparkSession, path: str, generated_at: str, scope: str, scope_label: str,
               export_name: str, run_count: int, export_path: str = "", exported_by: str = "") -> None:
    """Record a finished export: a row is added, so a crash never loses the marks before (``read_mark`` takes the latest)."""
    spark.createDataFrame([(generated_at, scope, scope_label, export_name, int(run_count), export_path, exported_by)], MARK_SCHEMA) \
        .coalesce(1).write.mode("append").json(path)


def finished_exports(spark: SparkSession, path: str) -> DataFrame:
    """One row per finished export (``MARK_SCHEMA``); exports that failed on their way have none."""
    there = read_if_there(spark.read.schema(MARK_SCHEMA).format("json"), path)
    return there if there is not None else spark.createDataFrame([], MARK_SCHEMA)

"""Export job (O-STATE-12): run set for a scope -> packets -> manifest -> mark.

One batch job instead of one document per run in a thread pool.  Packets are
nested per run (arrays of at most one element per configured stage), filtration
child rows are a flat table beside them; PDF rendering is not part of this library (see README).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchtrail.functions.labels import export_filename, run_label, scope_label
from batchtrail.functions.time import date_prefix, month_folder
from batchtrail.operators import latest as LT
from batchtrail.operators.runs import runs_in_scope
from batchtrail.sources import sinks
from batchtrail.sources.process_tables import ProcessTables
from batchtrail.sources.stages import EXPORT_BUILT, EXPORT_SCOPES

SCOPE_KEYS = {k for k, _ in EXPORT_SCOPES}


def scoped_runs(t: ProcessTables, scope: str, as_of: str, mark: str = "") -> DataFrame:
    scope = scope if scope in SCOPE_KEYS else "all"
    stage_rows = {"extraction": t.extraction, "filtration": t.filtration,
                  "clarifier": t.sheets.filter(F.col("stage_key") == "clarifier")}.get(scope)
    return runs_in_scope(t.runs, scope, as_of, mark, stage_rows)


def manifest_rows(runs: DataFrame) -> DataFrame:
    """Manifest columns per run: date, label, product, status, file (month folder / name)."""
    prefix = date_prefix("created_at", "updated_at")
    label = run_label()
    name = export_filename(prefix, label, "id")
    return runs.select(F.col("id").alias("run_id"), prefix.alias("entry_date"), label.alias("run_label"),
                       F.coalesce(F.col("product_name"), F.lit("")).alias("product_name"),
                       F.coalesce(F.col("status"), F.lit("")).alias("status"),
                       F.concat(month_folder(prefix), F.lit("/"), name).alias("file"),
                       month_folder(prefix).alias("export_month"))


def scoped_tables(t: ProcessTables, runs: DataFrame, voided: DataFrame) -> dict[str, DataFrame]:
    """The inputs of the packets, reduced to the runs of the scope before anything else is done with them."""
    ids = runs.select(F.col("id").alias("run_id"))
    own = lambda df: df.join(ids, "run_id", "left_semi")
    return {"extraction": own(t.extraction), "filtration": own(t.filtration), "sheets": own(t.sheets), "voided": own(voided)}


def packet_documents(t: ProcessTables, runs: DataFrame, voided: DataFrame) -> DataFrame:
    """One document per run: header, latest extraction and filtration entry, shown sheets, voided stages, all columns.

    The two arrays hold at most one element per configured stage.  Filtration
    child rows have no such bound; they are written flat (``packet_child_rows``).
    """
    part = scoped_tables(t, runs, voided)
    entry = lambda df, name: LT.latest_by(df, ["run_id"]).select(
        "run_id", F.struct(*[c for c in df.columns if c != "run_id"]).alias(name))
    shown = LT.packet_sheets(part["sheets"], part["voided"])
    listed = lambda df, name: df.groupBy("run_id").agg(F.array_sort(F.collect_list(
        F.struct(*[c for c in df.columns if c != "run_id"]))).alias(name))
    return (manifest_rows(runs).join(entry(part["extraction"], "extraction"), "run_id", "left")
            .join(entry(part["filtration"], "filtration"), "run_id", "left")
            .join(listed(shown, "sheets"), "run_id", "left")
            .join(listed(LT.packet_voided(part["voided"], shown), "voided"), "run_id", "left"))


def packet_child_rows(t: ProcessTables, runs: DataFrame) -> DataFrame:
    """Filtration rows of the scope's packets with the month folder of their run."""
    ids = runs.select(F.col("id").alias("run_id"))
    rows = LT.packet_rows(t.filtration.join(ids, "run_id", "left_semi"), t.filtration_rows)
    return rows.join(manifest_rows(runs).select("run_id", "export_month"), "run_id")


def export_audits(exports: DataFrame) -> DataFrame:
    """Audit rows of finished exports (O-STATE-2, O-SNK-3): they follow from the rows that publish them."""
    text = F.concat(F.col("last_export_name"), F.lit(EXPORT_BUILT), F.col("last_run_count").cast("string"), F.lit(" runs"))
    return exports.select(F.lit("production_runs").alias("table_name"), F.lit(0).cast("long").alias("record_id"), F.lit("export").alias("action_type"),
                          F.col("exported_by").alias("changed_by"), F.lit("").alias("old_data"), text.alias("new_data"),
                          F.col("last_successful_export_at").alias("created_at"))


def published_export(spark: SparkSession, root: str, export_name: str) -> str | None:
    """Folder of the newest finished export of that name, None where none has finished."""
    done = sinks.finished_exports(spark, f"{root}/_state").where(F.col("last_export_name") == export_name)
    return done.agg(F.max_by("export_path", F.struct("last_successful_export_at", "export_path"))).first()[0]


def export_scope(spark: SparkSession, t: ProcessTables, voided: DataFrame, scope: str, as_of: str, root: str,
                 export_name: str, exported_by: str = "") -> dict:
    """Run the whole export into a folder of its own and publish it by one row, written last.

    That row is the mark, the audit and the pointer to the folder at once, so a
    failure at any step leaves the exports before as they were: no mark, no
    audit, and readers (``published_export``) still see the earlier one.
    """
    mark_path = f"{root}/_state"
    mark = sinks.read_mark(spark, mark_path)
    runs = scoped_runs(t, scope, as_of, mark)
    docs = packet_documents(t, runs, voided)
    out = f"{root}/{safe_export_name(export_name)}/attempt-{uuid.uuid4().hex}"
    sinks.write_packets(docs, f"{out}/packets")
    sinks.write_packets(packet_child_rows(t, runs), f"{out}/packet_rows")
    # the written documents are the checkpoint: later steps read them, not the lineage
    written = spark.read.schema(docs.schema).json(f"{out}/packets")
    count = written.count()
    label = scope if scope in SCOPE_KEYS else "all"
    summary = spark.createDataFrame([(label, as_of, count)], "scope string, generated string, run_count long") \
        .select(scope_label(F.col("scope")).alias("scope"), "generated", "run_count")
    sinks.write_manifest(written.select("entry_date", "run_label", "product_name", "status", "file", "run_id"),
                         summary, f"{out}/manifest")
    sinks.write_mark(spark, mark_path, as_of, label, dict(EXPORT_SCOPES)[label], export_name, count, out, exported_by)
    return {"export_name": export_name, "run_count": count, "path": out}


def safe_export_name(name: str) -> str:
    import re
    cleaned = re.sub(r"[^A-Za-z0-9._-]+", "_", (name or "").strip()).strip("._-")
    return (cleaned or "export")[:90]


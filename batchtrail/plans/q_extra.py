"""Registered queries: point lookups, stage lookup, ordered points, export manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from batchtrail.operators import readings as R
from batchtrail.operators import reshape as RS
from batchtrail.plans import export as EX
from batchtrail.plans import performance as P
from batchtrail.plans import sqltext as Q
from batchtrail.plans.q_runs import EXPORT_MARK, RUNS_AS_OF
from batchtrail.plans.registry import query
from batchtrail.sources.stages import STAGES

_ENTRY_UNION = """SELECT 'extraction_entries' AS entry_table, id AS record_id, created_at FROM fx_extraction
 UNION ALL SELECT 'filtration_entries', id, created_at FROM fx_filtration
 UNION ALL SELECT 'evaporation_entries', id, created_at FROM fx_evaporation
 UNION ALL SELECT 'sheet_entries', id, created_at FROM fx_sheets"""


@query("point_lookup", f"""SELECT f.id, f.entry_table, f.record_id, e.created_at AS entry_created_at
FROM fx_field_changes f JOIN ({_ENTRY_UNION}) e ON e.entry_table = f.entry_table AND e.record_id = f.record_id""")
def q_point_lookup(spark, t, sf_dir):
    """O-FLT-22: entries fetched by primary key for every correction row - one join, no loop."""
    parts = [t.extraction.select(F.lit("extraction_entries").alias("entry_table"), F.col("id").alias("record_id"), "created_at"),
             t.filtration.select(F.lit("filtration_entries"), F.col("id"), "created_at"),
             t.evaporation.select(F.lit("evaporation_entries"), F.col("id"), "created_at"),
             t.sheets.select(F.lit("sheet_entries"), F.col("id"), "created_at")]
    u = parts[0]
    for p in parts[1:]:
        u = u.union(p)
    u = u.withColumnRenamed("created_at", "entry_created_at")
    return t.field_changes.select("id", "entry_table", "record_id").join(u, ["entry_table", "record_id"]) \
        .select("id", "entry_table", "record_id", "entry_created_at")


_DEFS = ", ".join(f"('{k}', '{title}', {len(tables)})" for k, title, _h, tables in STAGES)


@query("stage_lookup", f"""SELECT s.id, s.stage_key, d.stage_title_cfg, d.table_count FROM fx_sheets s
LEFT JOIN (VALUES {_DEFS}) d(stage_key, stage_title_cfg, table_count) ON d.stage_key = s.stage_key""")
def q_stage_lookup(spark, t, sf_dir):
    """O-JOIN-12: sheets joined to their stage definition (broadcast catalogue)."""
    return RS.stage_lookup(spark, t.sheets).select("id", "stage_key", "stage_title_cfg", "table_count")


@query("points_order", """WITH j AS (SELECT e.id AS entry_id, e.entry_date, e.created_at, r.row_group, r.row_no, r.row_time
 FROM fx_filtration e JOIN fx_filtration_rows r ON r.filtration_entry_id = e.id
 WHERE coalesce(e.entry_date, substr(e.created_at, 1, 10)) BETWEEN '2024-01-05' AND '2024-01-07')
SELECT DISTINCT entry_id, row_group AS table_prefix, CAST(row_no AS INTEGER) AS row_no, """
       + Q.point_time("entry_date", "row_time", "created_at") + """ AS point_time FROM j""")
def q_points_order(spark, t, sf_dir):
    """O-SRT-5/6: chart points in time order (a range-partitioned sort, no cap)."""
    pts = P.performance_points(t, "filtration", "2024-01-05", "2024-01-07")
    return pts.orderBy("point_time", "entry_id", "table_prefix", "row_no").select(
        "entry_id", "table_prefix", "row_no", "point_time")


def _safe(x: str) -> str:
    c = (f"regexp_replace(regexp_replace({Q.clean(x)}, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g')")
    return f"substr(coalesce(nullif({c}, ''), 'run'), 1, 90)"


_PREFIX = f"coalesce(substr({Q.nonblank('created_at')}, 1, 10), substr({Q.nonblank('updated_at')}, 1, 10), 'undated')"
_MONTH = f"CASE WHEN length({_PREFIX}) >= 7 THEN substr({_PREFIX}, 1, 7) ELSE 'undated' END"
_UA, _CA = Q.clean("updated_at"), Q.clean("created_at")


@query("readings_order", """SELECT e.id AS filtration_entry_id, coalesce(e.entry_date, substr(e.created_at, 1, 10)) AS reading_date, e.created_at,
  x.id AS row_id, x.row_group, CAST(x.row_no AS INTEGER) AS row_no, x.row_time, row_number() OVER (ORDER BY coalesce(e.entry_date, substr(e.created_at, 1, 10)) NULLS FIRST,
    x.row_time NULLS FIRST, e.created_at NULLS FIRST, x.row_group NULLS FIRST, x.row_no NULLS FIRST, x.id) AS position
FROM fx_filtration e JOIN fx_filtration_rows x ON x.filtration_entry_id = e.id""")
def q_readings_order(spark, t, sf_dir):
    """O-SRT-5: every filtration reading with its place in the five-key order (no cap)."""
    return R.readings_order(t.filtration, t.filtration_rows)


def _export_audit_sql(scope: str, where: str) -> str:
    return f"""SELECT 'production_runs' AS table_name, CAST(0 AS BIGINT) AS record_id, 'export' AS action_type, 'E7' AS changed_by, '' AS old_data,
  '{scope}_export built with ' || CAST(count(*) AS VARCHAR) || ' runs' AS new_data, '{RUNS_AS_OF}' AS created_at FROM fx_runs WHERE {where}"""


@query("export_audits", " UNION ALL ".join(_export_audit_sql(scope, where) for scope, where in (
    ("all", "TRUE"), ("current_month", f"starts_with({_CA}, '{RUNS_AS_OF[:7]}') OR starts_with({_UA}, '{RUNS_AS_OF[:7]}')"),
    ("since_last", f"({_UA} <> '' AND {_UA} > '{EXPORT_MARK}') OR ({_CA} <> '' AND {_CA} > '{EXPORT_MARK}')"),
    ("filtration", "id <> 0 AND id IN (SELECT run_id FROM fx_filtration)"))))
def q_export_audits(spark, t, sf_dir):
    """O-STATE-2 + O-SNK-3: audit rows of finished exports of four scopes."""
    rows = None
    for scope in ("all", "current_month", "since_last", "filtration"):
        count = EX.scoped_runs(t, scope, RUNS_AS_OF, EXPORT_MARK).agg(F.count(F.lit(1)).alias("last_run_count"))
        one = count.select(F.lit(RUNS_AS_OF).alias("last_successful_export_at"), F.lit(f"{scope}_export").alias("last_export_name"),
                           "last_run_count", F.lit("E7").alias("exported_by"))
        rows = one if rows is None else rows.unionByName(one)
    return EX.export_audits(rows)


@query("export_manifest", f"""SELECT id AS run_id, {_PREFIX} AS entry_date, {Q.run_label()} AS run_label,
 coalesce(product_name, '') AS product_name, coalesce(status, '') AS status,
 {_MONTH} || '/' || {_PREFIX} || '_Run_' || {_safe(Q.run_label())} || '_id-' || CAST(id AS VARCHAR) || '.json' AS file,
 {_MONTH} AS export_month
FROM fx_runs WHERE ({_UA} <> '' AND {_UA} > '{EXPORT_MARK}') OR ({_CA} <> '' AND {_CA} > '{EXPORT_MARK}')""")
def q_export_manifest(spark, t, sf_dir):
    """O-SNK-6 + O-STATE-12: manifest rows of the 'since last export' scope."""
    return EX.manifest_rows(EX.scoped_runs(t, "since_last", RUNS_AS_OF, EXPORT_MARK))

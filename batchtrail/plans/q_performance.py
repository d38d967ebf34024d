"""Registered queries: machine performance (flagship) and its summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from batchtrail.operators import readings as R
from batchtrail.plans import performance as P
from batchtrail.plans import sqltext as Q
from batchtrail.plans.registry import query
from batchtrail.sources.stages import NON_METRIC_FIELDS, stage_columns, stage_columns_sql

START, END = "2024-01-05", "2024-01-20"


def _ranked(src: str, part: str, order: str) -> str:
    return (f"SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {order}) AS rn "
            f"FROM {src} WHERE value IS NOT NULL")


def _desc(*cols: str) -> str:
    return ", ".join(f"{c} DESC NULLS LAST" for c in cols)


_FILT_FIELDS = ["fic1_gpm", "perm_total", "retentate_ri"]
_FILT_SQL = f"""
WITH j AS (
 SELECT e.id AS entry_id, e.entry_date, e.created_at, r.id AS row_id, r.row_group, r.row_no, r.row_time,
        r.fic1_gpm, r.perm_total, r.retentate_ri
 FROM fx_filtration e JOIN fx_filtration_rows r ON r.filtration_entry_id = e.id
 WHERE {Q.date_between(START, END, 'e.entry_date', 'e.created_at')}),
p AS (SELECT *, {Q.point_time('entry_date', 'row_time', 'created_at')} AS point_time,
             {Q.eff_date()} AS eff FROM j),
p2 AS (SELECT *, rtrim(replace(point_time, 'T', ' ') || ' | ' || {Q.title(Q.clean('row_group'))} || ' row '
             || CASE WHEN row_no IS NULL OR row_no = 0 THEN '' ELSE CAST(row_no AS VARCHAR) END) AS point_label
       FROM p WHERE point_time <> ''),
v AS ({Q.unpivot('p2', 'point_time, point_label, entry_id, row_group, row_no, row_id, eff, row_time, created_at', _FILT_FIELDS)}),
w AS (SELECT *, {Q.parse_num('text')} AS value FROM v),
r AS ({_ranked('w', 'point_time, entry_id, row_group, row_no, field',
               _desc('eff', 'row_time', 'created_at', 'row_group', 'row_no', 'entry_id', 'row_id'))})
SELECT 'filtration' AS machine, point_time, point_label, entry_id, row_group AS table_prefix,
       CAST(row_no AS INTEGER) AS row_no, field, value
FROM r WHERE rn = 1
"""


@query("machine_performance", _FILT_SQL)
def q_machine_performance(spark, t, sf_dir):
    """Flagship: filtration readings 2024-01-05..2024-01-20 as merged chart values."""
    return P.machine_performance(t, "filtration", START, END)


_EVAP_FIELDS = ["feed_rate", "row_vacuum"]
_EVAP_SQL = f"""
WITH j AS (
 SELECT e.id AS entry_id, e.entry_date, e.created_at, ru.run_number, r.id AS row_id, r.row_no, r.row_time,
        r.feed_rate, r.row_vacuum
 FROM fx_evaporation e JOIN fx_evaporation_rows r ON r.evaporation_entry_id = e.id
 LEFT JOIN fx_runs ru ON ru.id = e.run_id),
p AS (SELECT *, {Q.point_time('entry_date', 'row_time', 'created_at')} AS point_time, {Q.eff_date()} AS eff FROM j),
p2 AS (SELECT *, replace(point_time, 'T', ' ') || ' | ' || coalesce({Q.nonblank('run_number')}, 'Entry ' || CAST(entry_id AS VARCHAR))
             || ' row ' || CASE WHEN row_no IS NULL OR row_no = 0 THEN '' ELSE CAST(row_no AS VARCHAR) END AS point_label
       FROM p WHERE point_time <> ''),
v AS ({Q.unpivot('p2', 'point_time, point_label, entry_id, row_no, row_id, eff, row_time, created_at', _EVAP_FIELDS)}),
w AS (SELECT *, {Q.parse_num('text')} AS value FROM v),
r AS ({_ranked('w', 'point_time, entry_id, row_no, field',
               _desc('eff', 'row_time', 'created_at', 'row_no', 'entry_id', 'row_id'))})
SELECT 'evaporation' AS machine, point_time, point_label, entry_id, CAST(NULL AS VARCHAR) AS table_prefix,
       CAST(row_no AS INTEGER) AS row_no, field, value
FROM r WHERE rn = 1
"""


@query("machine_performance_evaporation", _EVAP_SQL)
def q_perf_evaporation(spark, t, sf_dir):
    """Evaporation chart values over the whole history."""
    return P.machine_performance(t, "evaporation")


_EXTR_FIELDS = ["psf1_speed", "psf1_load", "press_blowback", "chip_bin_steam"]
_EXTR_SQL = f"""
WITH j AS (
 SELECT e.*, ru.run_number FROM fx_extraction e LEFT JOIN fx_runs ru ON ru.id = e.run_id
 WHERE {Q.date_between('2024-01-10', '', 'e.entry_date', 'e.created_at')}),
p AS (SELECT *, id AS entry_id, {Q.point_time('entry_date', 'entry_time', 'created_at')} AS point_time FROM j),
p2 AS (SELECT *, replace(point_time, 'T', ' ') || ' | ' || coalesce({Q.nonblank('run_number')}, 'Entry ' || CAST(entry_id AS VARCHAR)) AS point_label
       FROM p WHERE point_time <> ''),
v AS ({Q.unpivot('p2', 'point_time, point_label, entry_id', _EXTR_FIELDS)})
SELECT 'extraction' AS machine, point_time, point_label, entry_id, CAST(NULL AS VARCHAR) AS table_prefix,
       CAST(NULL AS INTEGER) AS row_no, field, {Q.parse_num('text')} AS value
FROM v WHERE {Q.parse_num('text')} IS NOT NULL
"""


@query("machine_performance_extraction", _EXTR_SQL)
def q_perf_extraction(spark, t, sf_dir):
    """Extraction chart values from 2024-01-10 on (open end bound)."""
    return P.machine_performance(t, "extraction", "2024-01-10", "")


def _generic_cat(stage: str) -> str:
    excluded = ", ".join(f"'{f}'" for f in NON_METRIC_FIELDS)
    return f"(SELECT * FROM {stage_columns_sql()} c WHERE c.stage_key = '{stage}' AND c.field NOT IN ({excluded}))"


def _sheet_base(stage: str, start: str = "", end: str = "", view: str = "fx_sheets") -> str:
    return f"""s AS (SELECT id AS entry_id, entry_date, created_at, {Q.payload_map()} AS m FROM {view}
        WHERE stage_key = '{stage}' AND {Q.date_between(start, end)}),
s2 AS (SELECT *, coalesce(nullif(m['entry_date'], ''), entry_date) AS date_src, {Q.eff_date()} AS eff FROM s)"""


_CELL = r"^(.+?)_([1-9][0-9]*)_(.+)$"


def _generic_sql(stage: str, start: str = "", end: str = "", view: str = "fx_sheets") -> str:
    return f"""
WITH {_sheet_base(stage, start, end, view)},
cells AS (SELECT entry_id, created_at, date_src, eff, m, unnest(map_keys(m)) AS k, unnest(map_values(m)) AS v FROM s2),
parsed AS (SELECT *, regexp_extract(k, '{_CELL}', 1) AS table_prefix, regexp_extract(k, '{_CELL}', 2) AS row_text,
                  regexp_extract(k, '{_CELL}', 3) AS fld FROM cells),
vals AS (SELECT p.*, CAST(p.row_text AS INTEGER) AS row_no, p.table_prefix || '::' || p.fld AS field,
                {Q.parse_num('p.v')} AS value, c.table_title,
                p.m[p.table_prefix || '_' || p.row_text || '_time'] AS row_time
         FROM parsed p JOIN {_generic_cat(stage)} c ON c.table_prefix = p.table_prefix AND c.field = p.fld
         WHERE p.row_text <> '' AND CAST(p.row_text AS INTEGER) <= c.max_rows),
pts AS (SELECT *, {Q.point_time('date_src', 'row_time', 'created_at')} AS point_time FROM vals),
r AS ({_ranked('pts', 'point_time, table_prefix, row_no, field', _desc('eff', 'created_at', 'entry_id'))})
SELECT '{stage}' AS machine, point_time,
       replace(point_time, 'T', ' ') || ' | ' || table_title || ' ' || CAST(row_no AS VARCHAR) AS point_label,
       CAST(NULL AS BIGINT) AS entry_id, table_prefix, row_no, field, value
FROM r WHERE rn = 1 AND point_time <> ''
"""


@query("machine_performance_concentration", _generic_sql("concentration"))
def q_perf_concentration(spark, t, sf_dir):
    """Generic sheet machine: concentration cells keyed by time + row (T10)."""
    return P.machine_performance(t, "concentration")


def _points_sql(stage: str, view: str = "fx_sheets") -> str:
    return f"""
WITH {_sheet_base(stage, view=view)},
grid AS (SELECT DISTINCT table_prefix, table_title, max_rows FROM {stage_columns_sql()} c WHERE c.stage_key = '{stage}'),
pts AS (SELECT s2.entry_id, s2.created_at, s2.date_src, g.table_prefix, gs.row_no,
               s2.m[g.table_prefix || '_' || CAST(gs.row_no AS VARCHAR) || '_time'] AS row_time
        FROM s2 CROSS JOIN grid g CROSS JOIN LATERAL (SELECT unnest(generate_series(1, g.max_rows)) AS row_no) gs),
x AS (SELECT DISTINCT {Q.point_time('date_src', 'row_time', 'created_at')} AS point_time, table_prefix, row_no FROM pts)
SELECT '{stage}' AS machine, count(*) AS point_count FROM x WHERE point_time <> ''
"""


_POINTS_SQL = _points_sql("concentration")


@query("performance_point_count", _POINTS_SQL)
def q_point_count(spark, t, sf_dir):
    """O-AGG-7: points of the concentration chart, empty rows included (T11), counted exactly
    without listing every configured row."""
    return R.generic_point_count(t.sheets, "concentration")


_FILT_POINTS_SQL = f"""
WITH j AS (
 SELECT e.id AS entry_id, e.entry_date, e.created_at, r.row_group, r.row_no, r.row_time
 FROM fx_filtration e JOIN fx_filtration_rows r ON r.filtration_entry_id = e.id
 WHERE {Q.date_between(START, END, 'e.entry_date', 'e.created_at')}),
x AS (SELECT DISTINCT {Q.point_time('entry_date', 'row_time', 'created_at')} AS point_time, entry_id, row_group, row_no FROM j)
SELECT 'filtration' AS machine, count(*) AS point_count FROM x WHERE point_time <> ''
"""


@query("performance_point_count_filtration", _FILT_POINTS_SQL)
def q_point_count_filtration(spark, t, sf_dir):
    """O-AGG-7 for the flagship range."""
    pts = P.performance_points(t, "filtration", START, END)
    return pts.groupBy("machine").agg(F.count(F.lit(1)).alias("point_count"))


_METRIC_SQL = f"""
WITH mp AS ({_FILT_SQL.strip()})
SELECT machine, field, count(value) AS value_count,
       CASE WHEN min(value) = max(value) THEN min(value) - 1 ELSE min(value) END AS axis_min,
       CASE WHEN min(value) = max(value) THEN max(value) + 1 ELSE max(value) END AS axis_max
FROM mp GROUP BY machine, field
"""


@query("performance_metric_summary", _METRIC_SQL)
def q_metric_summary(spark, t, sf_dir):
    """O-AGG-6 metric counts (zero-count metrics dropped) + O-AGG-8 axis range."""
    return P.performance_summary(t, "filtration", START, END)


_RL_SQL = f"""
WITH v AS ({Q.unpivot('fx_evaporation_rows', 'id AS row_id, evaporation_entry_id', ['feed_rate', 'row_vacuum'])})
SELECT row_id, evaporation_entry_id, field, text, {Q.parse_num('text')} AS value FROM v
"""


@query("readings_long", _RL_SQL)
def q_readings_long(spark, t, sf_dir):
    """O-RSH-7 + O-SCL-6: wide evaporation readings to (field, text, value)."""
    rows = t.evaporation_rows.select(F.col("id").alias("row_id"), "evaporation_entry_id", "feed_rate", "row_vacuum")
    return R.readings_long(rows, ["row_id", "evaporation_entry_id"], ["feed_rate", "row_vacuum"])


_CELLS_SQL = f"""
WITH s AS (SELECT id AS entry_id, stage_key, {Q.payload_map()} AS m FROM fx_sheets),
cells AS (SELECT entry_id, stage_key, unnest(map_keys(m)) AS k, unnest(map_values(m)) AS text FROM s),
parsed AS (SELECT *, regexp_extract(k, '{_CELL}', 1) AS table_prefix, regexp_extract(k, '{_CELL}', 2) AS row_text,
                  regexp_extract(k, '{_CELL}', 3) AS fld FROM cells)
SELECT p.entry_id, p.stage_key, p.table_prefix, c.table_title, CAST(p.row_text AS INTEGER) AS row_no, p.fld AS field,
       c.label, p.k AS key, p.text
FROM parsed p JOIN {stage_columns_sql()} c ON c.stage_key = p.stage_key AND c.table_prefix = p.table_prefix AND c.field = p.fld
WHERE p.row_text <> '' AND CAST(p.row_text AS INTEGER) <= c.max_rows
"""


@query("cells_long", _CELLS_SQL)
def q_cells_long(spark, t, sf_dir):
    """O-RSH-1: sheet payloads exploded to configured table cells."""
    return R.cells_long(t.sheets, stage_columns(spark))


# ---- every sheet machine over sheets carrying cells of all stages ----

def _stage_sheet_tables(spark, sf_dir):
    from batchtrail.sources.fixtures import fixture
    from batchtrail.sources.process_tables import ProcessTables
    from batchtrail.sources.tables import reconcile_schema
    sheets = reconcile_schema(fixture(spark, sf_dir, "fx_stage_sheets"), "sheet_entries")
    return ProcessTables(lambda name: sheets)


def _register_stage_chart(stage: str) -> None:
    def build(spark, t, sf_dir):
        return P.machine_performance(_stage_sheet_tables(spark, sf_dir), stage)
    build.__doc__ = f"O-RSH-8 for the {stage} sheet machine (generic path, T10/T13, rows past the table ignored)."
    query(f"sheet_chart_{stage}", _generic_sql(stage, view="fx_stage_sheets"))(build)


for _stage in ["clarifier", "concentration", "reconcentration", "h2o2_koh_decolorizing", "h2o2_calcium_decolorizing",
               "centrifuge", "anion_exchange", "resistaid_anion_exchange", "carbon_treatment"]:
    _register_stage_chart(_stage)


@query("performance_point_count_clarifier", _points_sql("clarifier", "fx_stage_sheets"))
def q_point_count_clarifier(spark, t, sf_dir):
    """O-AGG-7 for a two-table stage (50 + 50 configured rows), exact count without listing."""
    return R.generic_point_count(_stage_sheet_tables(spark, sf_dir).sheets, "clarifier")

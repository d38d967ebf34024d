"""Registered queries: source rules, form reshapes, sheet detail and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from batchtrail.operators import latest as LT
from batchtrail.operators import readings as R
from batchtrail.operators import reshape as RS
from batchtrail.plans import sqltext as Q
from batchtrail.plans.registry import query
from batchtrail.sources.fixtures import fixture
from batchtrail.sources.stages import stage_columns, stage_columns_sql, stage_header_rows
from batchtrail.sources.tables import backfill_completion_status, form_events, parse_payload, reconcile_schema

# Fixed values of the form and sheet layout, stated for the oracles apart from the engine's lists.
_SQL_EXTRACTION_FIELDS = """entry_date entry_time start_time stop_time psf1_speed psf1_load psf1_blowback psf2_speed psf2_load psf2_blowback
press_speed press_load press_blowback pressate_ri chip_bin_steam chip_chute_temp photo_path""".split()
_SQL_FILTRATION_ROW_FIELDS = """time operator_initials fic1_gpm tit1 tit2 dpt dpm perm_total f12_gpm permeate_ri retentate_ri qic1_ntu_turbidity
pressure_pt1 pressure_pt2 pressure_pt3""".split()
_SQL_SUMMARY_FIELDS = """cycle_number ri_to_sewer total_filtrate_volume cleaning_method""".split()
_SQL_CELL_KEY = "^(.+?)_([1-9][0-9]*)_(.+)$"
_SQL_NOT_NUMERIC = "(initial|operator|comment|note|photo|path|method|status|bed|vessel|name|lot|location|flavor|odor)"
_SQL_NUMERIC = ("(number|no\\.|#|ri|temp|pressure|rate|speed|load|volume|total|weight|density|target|gallon|gal|lb|ppm|ntu|gpm|rpm|psi|vac|level|color|"
                "turbidity|scale|inch|effect|condenser|condensor)")

_FORM_MAP = f"""f AS (SELECT form_id, submitted_at, {Q.payload_map('form_json')} AS raw FROM fx_forms),
fm AS (SELECT form_id, submitted_at, CASE WHEN raw['save_mode'] = 'Complete' THEN 'Complete' ELSE 'Draft' END AS save_mode,
  map_from_entries(list_filter(map_entries(raw), lambda e: NOT starts_with(e.key, '__') AND e.key NOT IN ('correction_reason', 'save_mode'))) AS m
  FROM f)"""


def _forms(spark, sf_dir):
    return form_events(fixture(spark, sf_dir, "fx_forms"))


@query("backfill_completion_status", """SELECT record_id, completion_status AS raw_status,
 coalesce(nullif(completion_status, ''), 'Complete') AS completion_status FROM fx_entries
 WHERE entry_table IN ('filtration_entries', 'sheet_entries')""")
def q_backfill(spark, t, sf_dir):
    """O-SRC-3: NULL / '' status -> Complete on filtration and sheet entries."""
    e = fixture(spark, sf_dir, "fx_entries").filter(F.col("entry_table").isin("filtration_entries", "sheet_entries"))
    return backfill_completion_status(e.select("record_id", F.col("completion_status").alias("raw_status"),
                                               "completion_status"))


@query("parse_payload", f"""SELECT record_id, cardinality({Q.payload_map()}) AS n_keys,
 {Q.payload_map()}['entry_date'] AS payload_entry_date FROM fx_entries""")
def q_parse_payload(spark, t, sf_dir):
    """O-SRC-4 + O-RSH-12/13: safe JSON parse (bad text -> empty map), key count, one field."""
    e = fixture(spark, sf_dir, "fx_entries")
    m = parse_payload("payload_json")
    return e.select("record_id", F.size(m).alias("n_keys"), m.getItem("entry_date").alias("payload_entry_date"))


@query("reconcile_schema", """SELECT id, filtration_entry_id, row_group, CAST(row_no AS INTEGER) AS row_no,
 CAST(NULL AS VARCHAR) AS tit1, CAST(NULL AS VARCHAR) AS pressure_pt3, fic1_gpm FROM fx_filtration_rows""")
def q_reconcile_schema(spark, t, sf_dir):
    """O-SRC-1/2: rows read into the declared schema; absent columns are typed NULLs."""
    rows = reconcile_schema(fixture(spark, sf_dir, "fx_filtration_rows"), "filtration_rows")
    return rows.select("id", "filtration_entry_id", "row_group", "row_no", "tit1", "pressure_pt3", "fic1_gpm")


@query("form_events", f"""WITH {_FORM_MAP}
SELECT form_id, save_mode, CAST(cardinality(m) AS INTEGER) AS n_fields, m['entry_date'] AS entry_date FROM fm""")
def q_form_events(spark, t, sf_dir):
    """O-SRC-5: submitted forms with control keys removed."""
    f = _forms(spark, sf_dir)
    return f.select("form_id", "save_mode", F.size("fields").alias("n_fields"),
                    F.col("fields").getItem("entry_date").alias("entry_date"))


def _g(k: str) -> str:
    return f"coalesce(m['{k}'], '')"


@query("extraction_from_form", f"""WITH {_FORM_MAP}
SELECT form_id, upper({Q.clean("m['operator_initials']")}) AS operator_initials, {', '.join(f"{_g(k)} AS {k}" for k in _SQL_EXTRACTION_FIELDS)},
 CASE WHEN {_g('location')} <> '' THEN {_g('location')} ELSE 'Pile' END AS location,
 CASE WHEN {_g('time_on_pile')} <> '' THEN {_g('time_on_pile')} ELSE {_g('time_on_pipe_or_pile')} END AS time_on_pile,
 CASE WHEN {_g('comments')} <> '' THEN {_g('comments')} ELSE {_g('notes')} END AS comments FROM fm""")
def q_extraction_from_form(spark, t, sf_dir):
    """O-RSH-6: typed extraction entry from a form (Pile / notes / time-on-pile fallbacks)."""
    return RS.extraction_from_form(_forms(spark, sf_dir))


@query("filtration_from_form", f"""WITH {_FORM_MAP}
SELECT fm.form_id, upper({Q.clean("m['operator_initials']")}) AS operator_initials, {_g('entry_date')} AS entry_date,
 {_g('cycle_volume_set_point')} AS cycle_volume_set_point, {_g('clarification_sequential_no')} AS clarification_sequential_no,
 {_g('retentate_flow_set_point')} AS retentate_flow_set_point, {_g('zero_refract')} AS zero_refract, {_g('startup_time')} AS startup_time,
 {_g('shutdown_time')} AS shutdown_time, {_g('start_time')} AS start_time, {_g('stop_time')} AS stop_time, {_g('photo_path')} AS photo_path,
 CASE WHEN {_g('comments')} <> '' THEN {_g('comments')} ELSE {_g('notes')} END AS comments,
 coalesce(f.raw['save_mode'], 'Complete') AS completion_status, {_g('cycle1_cycle_number')} AS cycle1_cycle_number,
 {_g('cycle2_ri_to_sewer')} AS cycle2_ri_to_sewer FROM fm JOIN f ON f.form_id = fm.form_id""")
def q_filtration_from_form(spark, t, sf_dir):
    """O-RSH-6: typed filtration entry from a form, two of its summary keys read back from the payload."""
    e = RS.filtration_from_form(_forms(spark, sf_dir))
    m = parse_payload("payload_json")
    return e.select("*", *[m.getItem(k).alias(k) for k in ("cycle1_cycle_number", "cycle2_ri_to_sewer")]).drop("payload_json")


@query("evaporation_from_form", f"""WITH {_FORM_MAP}
SELECT form_id, upper({Q.clean("m['operator_initials']")}) AS operator_initials, {_g('entry_date')} AS entry_date, {_g('evaporator_no')} AS evaporator_no,
 {_g('startup_time')} AS startup_time, {_g('shutdown_time')} AS shutdown_time, {_g('feed_ri')} AS feed_ri, {_g('concentrate_ri')} AS concentrate_ri,
 {_g('steam_pressure')} AS steam_pressure, {_g('vacuum')} AS vacuum, {_g('sump_level')} AS sump_level, {_g('product_temp')} AS product_temp,
 {_g('photo_path')} AS photo_path, CASE WHEN {_g('comments')} <> '' THEN {_g('comments')} ELSE {_g('notes')} END AS comments FROM fm""")
def q_evaporation_from_form(spark, t, sf_dir):
    """O-RSH-6: typed evaporation entry from a form."""
    return RS.evaporation_from_form(_forms(spark, sf_dir))


_ROW_NAMES = ["row_time" if f == "time" else f for f in _SQL_FILTRATION_ROW_FIELDS]
_PAT = r"^(cycle[1-6])_(0|[1-9][0-9]*)_(.+)$"


@query("filtration_rows_from_form", f"""WITH {_FORM_MAP},
c AS (SELECT form_id, unnest(map_keys(m)) AS k, unnest(map_values(m)) AS v FROM fm),
p AS (SELECT form_id, regexp_extract(k, '{_PAT}', 1) AS row_group, regexp_extract(k, '{_PAT}', 2) AS row_text,
   regexp_extract(k, '{_PAT}', 3) AS field, v FROM c),
g AS (SELECT form_id, row_group, CAST(row_text AS INTEGER) AS row_no,
   {', '.join(f"coalesce(max(CASE WHEN field = '{f}' THEN v END), '') AS {n}" for f, n in zip(_SQL_FILTRATION_ROW_FIELDS, _ROW_NAMES))}
   FROM p WHERE row_group <> '' AND field IN ({', '.join(f"'{f}'" for f in _SQL_FILTRATION_ROW_FIELDS)})
   GROUP BY form_id, row_group, row_text)
SELECT *, '' AS feed_ri, '' AS perm_flow_c, '' AS perm_flow_d FROM g
WHERE {' OR '.join(f"{Q.clean(n)} <> ''" for n in _ROW_NAMES)}""")
def q_filtration_rows_from_form(spark, t, sf_dir):
    """O-RSH-2: dynamic cycle cells regrouped into child rows, blank rows dropped."""
    return RS.filtration_rows_from_form(_forms(spark, sf_dir))


@query("evaporation_rows_from_form", f"""WITH {_FORM_MAP}
{' UNION ALL '.join(f"SELECT form_id, {i} AS row_no, {_g(f'row{i}_time')} AS row_time, {_g(f'row{i}_feed_rate')} AS feed_rate, {_g(f'row{i}_evap_temp')} AS evap_temp, {_g(f'row{i}_vacuum')} AS row_vacuum, {_g(f'row{i}_concentrate_ri')} AS row_concentrate_ri FROM fm" for i in range(1, 4))}""")
def q_evaporation_rows_from_form(spark, t, sf_dir):
    """O-RSH-3: the three evaporation rows, blanks kept, fields renamed."""
    return RS.evaporation_rows_from_form(_forms(spark, sf_dir))


_SUMMARY_KEYS = [(c, f) for c in range(1, 7) for f in _SQL_SUMMARY_FIELDS]


@query("cycle_summaries", f"""WITH {_FORM_MAP},
k AS (SELECT * FROM (VALUES {', '.join(f"({c}, '{f}')" for c, f in _SUMMARY_KEYS)}) v(cycle, field))
SELECT fm.form_id, k.cycle, k.field, coalesce(fm.m['cycle' || CAST(k.cycle AS VARCHAR) || '_' || k.field], '') AS value
FROM fm CROSS JOIN k""")
def q_cycle_summaries(spark, t, sf_dir):
    """O-RSH-4: cycle summary payload written from a form, read back as a long table."""
    payloads = RS.cycle_summary_payload(_forms(spark, sf_dir))
    return RS.cycle_summaries(payloads, "form_id")


@query("cycle_view", f"""WITH g AS (SELECT e.id AS entry_id, e.payload_json, c.cycle FROM fx_filtration e,
   (SELECT unnest(range(1, 7)) AS cycle) c),
n AS (SELECT filtration_entry_id AS entry_id, row_group, count(*) AS n_rows FROM fx_filtration_rows GROUP BY 1, 2),
h AS (SELECT g.*, 'cycle' || CAST(g.cycle AS VARCHAR) AS row_group, {Q.payload_map('g.payload_json')} AS m FROM g),
s AS (SELECT h.*, ({' OR '.join(f"coalesce(m[row_group || '_{f}'], '') <> ''" for f in _SQL_SUMMARY_FIELDS)}) AS has_summary FROM h)
SELECT s.entry_id, CAST(s.cycle AS INTEGER) AS cycle, coalesce(n.n_rows, 0) AS n_rows, s.has_summary FROM s
LEFT JOIN n ON n.entry_id = s.entry_id AND n.row_group = s.row_group WHERE coalesce(n.n_rows, 0) > 0 OR s.has_summary""")
def q_cycle_view(spark, t, sf_dir):
    """O-RSH-15: printable cycles of each filtration entry (rows or a summary)."""
    return RS.cycle_view(t.filtration, t.filtration_rows)


@query("filtration_render_rows", f"""WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY filtration_entry_id, row_group, row_no
   ORDER BY id DESC) AS k FROM fx_filtration_rows) WHERE k = 1),
pop AS (SELECT filtration_entry_id, row_group, row_no FROM l WHERE {Q.clean('row_time')} <> '' OR {Q.clean('fic1_gpm')} <> ''
   OR {Q.clean('perm_total')} <> '' OR {Q.clean('retentate_ri')} <> ''),
per AS (SELECT filtration_entry_id, row_group, max(CASE WHEN row_no = 0 THEN 1 ELSE row_no END) AS top FROM pop GROUP BY 1, 2),
g AS (SELECT e.filtration_entry_id, c.cycle, 'cycle' || CAST(c.cycle AS VARCHAR) AS row_group FROM
   (SELECT id AS filtration_entry_id FROM fx_filtration) e, (SELECT unnest(range(1, 7)) AS cycle) c)
SELECT g.filtration_entry_id, CAST(g.cycle AS INTEGER) AS cycle, CAST(coalesce(per.top, 1) AS INTEGER) AS render_rows
FROM g LEFT JOIN per ON per.filtration_entry_id = g.filtration_entry_id AND per.row_group = g.row_group""")
def q_filtration_render_rows(spark, t, sf_dir):
    """O-AGG-11 (filtration): visible rows per cycle, default 1."""
    return RS.filtration_render_rows(t.filtration, t.filtration_rows)


@query("row_map", """SELECT filtration_entry_id, coalesce(nullif(row_group, ''), 'main') || '_' || CAST(row_no AS VARCHAR) AS key,
 max(id) AS row_id FROM fx_filtration_rows GROUP BY 1, 2""")
def q_row_map(spark, t, sf_dir):
    """O-RSH-14: child rows keyed ``group_row`` per entry (later row wins), shown flat."""
    return LT.row_map(t.filtration_rows).select("filtration_entry_id", "key", F.col("id").alias("row_id"))


_CELLS_CTE = f"""s AS (SELECT id AS entry_id, stage_key, {Q.payload_map()} AS m FROM fx_sheets),
kv AS (SELECT entry_id, stage_key, unnest(map_keys(m)) AS k, unnest(map_values(m)) AS text FROM s),
pc AS (SELECT *, regexp_extract(k, '{_SQL_CELL_KEY}', 1) AS table_prefix, regexp_extract(k, '{_SQL_CELL_KEY}', 2) AS row_text,
   regexp_extract(k, '{_SQL_CELL_KEY}', 3) AS field FROM kv),
cat AS {stage_columns_sql()},
cells AS (SELECT pc.entry_id, pc.stage_key, pc.table_prefix, CAST(pc.row_text AS INTEGER) AS row_no, pc.field, pc.text, cat.label, cat.type
   FROM pc JOIN cat ON cat.stage_key = pc.stage_key AND cat.table_prefix = pc.table_prefix AND cat.field = pc.field
   WHERE pc.row_text <> '' AND CAST(pc.row_text AS INTEGER) <= cat.max_rows)"""


@query("populated_rows", f"""WITH {_CELLS_CTE},
top AS (SELECT entry_id, table_prefix, max(row_no) AS top FROM cells WHERE {Q.clean('text')} <> '' GROUP BY 1, 2),
tabs AS (SELECT DISTINCT stage_key, table_prefix, max_rows, initial_rows FROM cat)
SELECT s.entry_id, s.stage_key, tabs.table_prefix,
  CAST(coalesce(least(top.top, tabs.max_rows), greatest(1, tabs.initial_rows)) AS INTEGER) AS render_rows
FROM s JOIN tabs ON tabs.stage_key = s.stage_key LEFT JOIN top ON top.entry_id = s.entry_id AND top.table_prefix = tabs.table_prefix""")
def q_populated_rows(spark, t, sf_dir):
    """O-AGG-11: rows to show per sheet table."""
    cells = R.cells_long(t.sheets, stage_columns(spark))
    return RS.populated_rows(spark, t.sheets, cells)


@query("sheet_detail_rows", f"""WITH {_CELLS_CTE}
SELECT entry_id, stage_key, table_prefix, row_no, count(*) AS filled_cells FROM cells WHERE coalesce(text, '') <> ''
GROUP BY 1, 2, 3, 4""")
def q_sheet_detail_rows(spark, t, sf_dir):
    """O-RSH-10 + O-JOIN-13: non-empty rows of each sheet table."""
    return RS.sheet_detail_rows(R.cells_long(t.sheets, stage_columns(spark)))


@query("sheet_detail_cells", f"""WITH {_CELLS_CTE}
SELECT entry_id, stage_key, table_prefix, row_no, field, label, text FROM cells WHERE coalesce(text, '') <> ''""")
def q_sheet_detail_cells(spark, t, sf_dir):
    """O-RSH-10: the cell values of each sheet's non-empty rows."""
    return RS.sheet_detail_cells(R.cells_long(t.sheets, stage_columns(spark))).drop("table_title")


def _headers_values() -> str:
    rows = []
    for key, no, field, label, _type, _opts, default in stage_header_rows():
        esc = [x.replace("'", "''") for x in (key, field, label, default)]
        rows.append(f"('{esc[0]}', {no}, '{esc[1]}', '{esc[2]}', '{esc[3]}')")
    return "(SELECT * FROM (VALUES " + ", ".join(rows) + ") v(stage_key, header_no, field, label, dflt))"


@query("sheet_header_values", f"""WITH s AS (SELECT x.id, x.stage_key, {Q.payload_map('x.payload_json')} AS m, r.id AS rid,
   {Q.run_label('r.run_number', 'r.batch_number', 'r.id')} AS rl, r.blend_number FROM fx_sheets x LEFT JOIN fx_runs r ON r.id = x.run_id),
j AS (SELECT s.*, h.header_no, h.field, h.label, h.dflt FROM s JOIN {_headers_values()} h ON h.stage_key = s.stage_key),
d AS (SELECT *, coalesce(nullif(dflt, ''), CASE WHEN field IN ('run_number', 'production_number') THEN CASE WHEN rid IS NOT NULL THEN rl END
   WHEN field = 'run_blend_number' THEN CASE WHEN rid IS NOT NULL THEN coalesce(nullif({Q.clean('blend_number')}, ''), rl) END END, '') AS default_value FROM j)
SELECT id AS entry_id, stage_key, header_no, field, label, coalesce(m[field], '') AS saved_value, default_value,
  coalesce(nullif(m[field], ''), default_value) AS shown_value FROM d""")
def q_sheet_header_values(spark, t, sf_dir):
    """O-RSH-10 + O-SCL-26 + O-JOIN-12: header fields with saved value or default."""
    return RS.sheet_header_values(spark, t.sheets, t.runs)


@query("sheet_field_profile", f"""WITH {_CELLS_CTE}
SELECT stage_key, table_prefix, field, count(*) AS cells, round(avg(CASE WHEN {Q.clean('text')} = '' THEN 1.0 ELSE 0.0 END), 6) AS blank_rate,
  round(avg(CASE WHEN {Q.parse_num('text')} IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS numeric_rate,
  (max(type) IN ('text', 'numeric') AND NOT regexp_matches(lower(field || ' ' || max(label)), '{_SQL_NOT_NUMERIC}')
   AND regexp_matches(lower(field || ' ' || max(label)), '{_SQL_NUMERIC}')) AS numeric_guess
FROM cells GROUP BY stage_key, table_prefix, field""")
def q_sheet_field_profile(spark, t, sf_dir):
    """O-SCL-27/28: per sheet field: blank share, numeric share, numeric-keyboard guess."""
    return RS.sheet_field_profile(spark, R.cells_long(t.sheets, stage_columns(spark)))


@query("union_run_ids", """SELECT DISTINCT id FROM (SELECT source_run_id AS id FROM fx_group_requests
 UNION ALL SELECT run_id FROM fx_finalize_requests) WHERE id > 0""")
def q_union_run_ids(spark, t, sf_dir):
    """O-SET-3: set union of two id sets (selected and target runs)."""
    a = fixture(spark, sf_dir, "fx_group_requests").select(F.col("source_run_id").alias("id"))
    b = fixture(spark, sf_dir, "fx_finalize_requests").select(F.col("run_id").alias("id"))
    return a.union(b).filter(F.col("id") > 0).distinct()


@query("ordered_distinct", """SELECT group_label, source_run_id, CAST(row_number() OVER (PARTITION BY group_label
   ORDER BY first_at, first_req) AS INTEGER) AS first_seen
FROM (SELECT group_label, source_run_id, min(requested_at) AS first_at, arg_min(request_id, requested_at) AS first_req
      FROM (SELECT *, row_number() OVER (PARTITION BY group_label, source_run_id ORDER BY requested_at, request_id) AS k
            FROM fx_group_requests) WHERE k = 1 GROUP BY group_label, source_run_id)""")
def q_ordered_distinct(spark, t, sf_dir):
    """O-SET-4: first-seen distinct source runs per label, numbered in first-seen order."""
    from batchtrail.operators.sequence import sequence_within
    req = fixture(spark, sf_dir, "fx_group_requests")
    firsts = req.groupBy("group_label", "source_run_id").agg(
        F.min_by(F.struct("requested_at", "request_id"), F.struct("requested_at", "request_id")).alias("f"))
    flat = firsts.select("group_label", "source_run_id", F.col("f.requested_at").alias("first_at"),
                         F.col("f.request_id").alias("first_req"))
    seq = sequence_within(flat, ["group_label"], [F.col("first_at"), F.col("first_req")], out="first_seen")
    return seq.select("group_label", "source_run_id", "first_seen")

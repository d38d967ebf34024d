"""Registered queries: activity and media feeds, listings, change history, drafts."""

from __future__ import annotations

from pyspark.sql import functions as F

from batchtrail.functions.time import minus_hours
from batchtrail.operators import feeds as FD
from batchtrail.operators import paging as PG
from batchtrail.plans import sqltext as Q
from batchtrail.plans.registry import query
from batchtrail.sources.fixtures import AS_OF

CUTOFF_12H = minus_hours(AS_OF, 12)
CUTOFF_48H = minus_hours(AS_OF, 48)


def _feed_sql(cutoff: str) -> str:
    return f"""u AS (
 SELECT id AS record_id, run_id AS entry_run_id, 'extraction_entries' AS entry_table, created_at AS activity_time,
        'Extraction' AS section, '' AS stage_key, employee, operator_initials, comments, start_time AS start_label,
        stop_time AS end_label FROM fx_extraction WHERE created_at >= '{cutoff}'
 UNION ALL SELECT id, run_id, 'filtration_entries', created_at, 'Filtration', '', employee, operator_initials, comments,
        startup_time, shutdown_time FROM fx_filtration WHERE created_at >= '{cutoff}'
 UNION ALL SELECT id, run_id, 'evaporation_entries', created_at, 'Evaporation', '', employee, operator_initials, comments,
        startup_time, shutdown_time FROM fx_evaporation WHERE created_at >= '{cutoff}'
 UNION ALL SELECT id, run_id, 'sheet_entries', created_at, stage_title, stage_key, employee, operator_initials, comments,
        '', '' FROM fx_sheets WHERE created_at >= '{cutoff}'),
feed AS (SELECT r.id AS run_id, u.record_id, u.entry_table, u.activity_time, u.section, u.stage_key, u.employee,
        u.operator_initials, r.run_number, r.batch_number, r.blend_number, r.split_batch_number, r.status, u.comments,
        u.start_label, u.end_label FROM u LEFT JOIN fx_runs r ON r.id = u.entry_run_id)"""


_ACTIVE = (f"coalesce(CASE WHEN section IN ('Extraction', 'Filtration', 'Evaporation') THEN {Q.clean('end_label')} = '' "
           f"ELSE {Q.clean('status')} = 'Open' END, FALSE)")


@query("activity_feed", f"WITH {_feed_sql(CUTOFF_12H)} SELECT * FROM feed "
                        "ORDER BY activity_time DESC, entry_table DESC, record_id DESC LIMIT 300")
def q_activity_feed(spark, t, sf_dir):
    """O-SET-1 + O-FLT-9 + O-JOIN-1: last 12 hours across the four tables, newest 300."""
    return FD.activity_feed(t, AS_OF, 12, 300)


@query("process_activity", f"WITH {_feed_sql(CUTOFF_48H)} SELECT record_id, entry_table, section, activity_time FROM feed "
                           "WHERE section IN ('Extraction', 'Filtration') OR stage_key = 'clarifier'")
def q_process_activity(spark, t, sf_dir):
    """O-FLT-10: process-dashboard rows of the 48-hour feed."""
    return FD.process_activity(FD.activity_feed(t, AS_OF, 48, None)).select(
        "record_id", "entry_table", "section", "activity_time")


def _agg_join(c: str) -> str:
    return f"array_to_string(list_sort(list_distinct(list(CASE WHEN coalesce({c}, '') <> '' THEN {c} END))), ', ')"


@query("run_groups", f"""WITH {_feed_sql(CUTOFF_48H)},
k AS (SELECT *, coalesce({Q.nonblank('run_number')}, {Q.nonblank('batch_number')}, CAST(run_id AS VARCHAR)) AS run_key
      FROM feed WHERE run_id IS NOT NULL AND run_id <> 0)
SELECT run_key, max(activity_time) AS latest_time, {_agg_join('blend_number')} AS blend_numbers,
       {_agg_join('split_batch_number')} AS split_numbers, {_agg_join('status')} AS statuses, count(*) AS entry_count
FROM k GROUP BY run_key""")
def q_run_groups(spark, t, sf_dir):
    """O-AGG-5: 48-hour activity grouped by run label (splits included, T7 fixed)."""
    return FD.run_groups(FD.activity_feed(t, AS_OF, 48, None))


@query("run_group_entries", f"""WITH {_feed_sql(CUTOFF_48H)},
k AS (SELECT *, coalesce({Q.nonblank('run_number')}, {Q.nonblank('batch_number')}, CAST(run_id AS VARCHAR)) AS run_key
      FROM feed WHERE run_id IS NOT NULL AND run_id <> 0)
SELECT run_key, entry_table, record_id, activity_time, max(activity_time) OVER (PARTITION BY run_key) AS group_latest_time FROM k""")
def q_run_group_entries(spark, t, sf_dir):
    """O-AGG-5: the entries of every run group of the 48-hour activity."""
    return FD.run_group_entries(FD.activity_feed(t, AS_OF, 48, None)).select(
        "run_key", "entry_table", "record_id", "activity_time", "group_latest_time")


@query("machine_status", f"""WITH {_feed_sql(CUTOFF_12H)},
f2 AS (SELECT *, {_ACTIVE} AS is_active, row_number() OVER (PARTITION BY section
        ORDER BY activity_time DESC, entry_table DESC, record_id DESC) AS rn FROM feed),
l AS (SELECT * FROM f2 WHERE rn = 1),
m AS (SELECT * FROM (VALUES ('Extraction', 'Extraction'), ('Filtration', 'Filtration'), ('Clarifier', 'Clarifier')) v(section, title))
SELECT m.section, m.title,
  CASE WHEN l.section IS NULL THEN 'Not Used' WHEN l.is_active THEN 'In Use' ELSE 'Recently Used' END AS status_label,
  CASE WHEN l.section IS NULL THEN 'Auto-populated as not in use until an operator starts this machine.'
       ELSE concat_ws(' | ', CASE WHEN {Q.run_label('l.run_number', 'l.batch_number', 'l.run_id')} <> ''
            THEN 'Run ' || {Q.run_label('l.run_number', 'l.batch_number', 'l.run_id')} END, nullif(l.activity_time, '')) END AS detail,
  coalesce(l.is_active, FALSE) AS is_active
FROM m LEFT JOIN l ON l.section = m.section""")
def q_machine_status(spark, t, sf_dir):
    """O-WIN-6 + O-SCL-15: home-page machine cards from the 12-hour window."""
    return FD.machine_status(spark, FD.activity_feed(t, AS_OF, 12, None))


@query("in_use_items", f"""WITH {_feed_sql(CUTOFF_48H)},
a AS (SELECT * FROM feed WHERE {_ACTIVE} ORDER BY activity_time DESC, entry_table DESC, record_id DESC LIMIT 10)
SELECT coalesce(nullif(section, ''), CASE entry_table WHEN 'extraction_entries' THEN 'Extraction' WHEN 'filtration_entries'
  THEN 'Filtration' WHEN 'evaporation_entries' THEN 'Evaporation' WHEN 'sheet_entries' THEN 'Run Sheet' END) AS title,
  {Q.run_label('run_number', 'batch_number', 'run_id')} AS run_label, activity_time, {Q.clean('comments')} AS comments,
  'In Use' AS status_label, entry_table, record_id FROM a""")
def q_in_use_items(spark, t, sf_dir):
    """O-WIN-7: first 10 active items of the 48-hour feed (top-k)."""
    return FD.in_use_items(FD.activity_feed(t, AS_OF, 48, None), 10)


# ------------------------------------------------------------------ media

def _has(c: str) -> str:
    return f"trim(coalesce({c}, '')) <> ''"


_MEDIA_SRC = f"""src AS (
 SELECT id AS record_id, 'extraction_entries' AS entry_table, 'Extraction' AS section, '' AS stage_key, created_at,
   entry_date, entry_time, employee, operator_initials, run_id AS entry_run_id,
   CASE WHEN {_has('location')} THEN 'Extraction - ' || location ELSE 'Extraction' END AS machine_label,
   comments, photo_path, '' AS payload_json FROM fx_extraction WHERE {_has('comments')} OR {_has('photo_path')}
 UNION ALL SELECT id, 'filtration_entries', 'Filtration', '', created_at, entry_date, '', employee, operator_initials, run_id,
   'Filtration', comments, photo_path, payload_json FROM fx_filtration WHERE {_has('comments')} OR {_has('photo_path')}
 UNION ALL SELECT id, 'evaporation_entries', 'Evaporation', '', created_at, entry_date, '', employee, operator_initials, run_id,
   CASE WHEN {_has('evaporator_no')} THEN 'Evaporator ' || evaporator_no ELSE 'Evaporation' END, comments, photo_path, ''
   FROM fx_evaporation WHERE {_has('comments')} OR {_has('photo_path')}
 UNION ALL SELECT id, 'sheet_entries', stage_title, stage_key, created_at, entry_date, '', employee, operator_initials, run_id,
   stage_title, comments, '', payload_json FROM fx_sheets
   WHERE {_has('comments')} OR {_has(Q.payload_map() + "['photo_path']")}
      OR len(list_filter(map_entries({Q.payload_map()}), lambda e: strpos(lower(e.key), 'comment') > 0 AND {_has('e.value')})) > 0),
rows AS (SELECT s.*, u.full_name AS employee_name, u.initials AS user_initials, r.id AS run_id, r.run_number, r.batch_number,
   r.blend_number FROM src s LEFT JOIN fx_users u ON u.employee_number = s.employee LEFT JOIN fx_runs r ON r.id = s.entry_run_id)"""

_SHEET_NAME = ("coalesce(nullif(section, ''), CASE entry_table WHEN 'extraction_entries' THEN 'Extraction' WHEN "
               "'filtration_entries' THEN 'Filtration' WHEN 'evaporation_entries' THEN 'Evaporation' WHEN 'sheet_entries' "
               "THEN 'Run Sheet' END)")


def _comment_label_sql(x: str) -> str:
    stem = rf"regexp_replace(regexp_replace(lower({Q.clean(x)}), '_?comments?$', ''), '^_+|_+$', '', 'g')"
    return (f"CASE WHEN {stem} = '' THEN 'Comments' ELSE "
            f"{Q.title('regexp_replace(' + stem + ', ' + chr(39) + '_+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} END")


def _media_sql(search: str = "") -> str:
    ini = f"upper({Q.clean('CASE WHEN coalesce(p.operator_initials, ' + chr(39)*2 + ') <> ' + chr(39)*2 + ' THEN p.operator_initials ELSE p.user_initials END')})"
    emp = Q.clean("p.employee")
    base = f"coalesce({Q.nonblank('p.employee_name')}, nullif({emp}, ''), nullif({ini}, ''), 'Unknown user')"
    with_emp = f"(CASE WHEN {emp} <> '' AND {emp} <> {base} THEN {base} || ' (' || {emp} || ')' ELSE {base} END)"
    user = f"(CASE WHEN {ini} <> '' THEN {with_emp} || ' - ' || {ini} ELSE {with_emp} END)"
    where = "TRUE"
    if search:
        cols = ["run_number", "batch_number", "blend_number", "employee", "operator_initials", "employee_name",
                "section", "machine_label", "comments", "payload_json"]
        where = " OR ".join(f"coalesce({c}, '') ILIKE '%{search}%'" for c in cols)
    photo = (f"CASE WHEN cardinality(p.m) > 0 THEN concat_ws(chr(10), {Q.clean('p.photo_path')}, {Q.clean(chr(112) + '.m[' + chr(39) + 'photo_path' + chr(39) + ']')}) "
             "ELSE p.photo_path END")
    return f"""WITH {_MEDIA_SRC},
p AS (SELECT *, {Q.payload_map()} AS m FROM rows WHERE {where}),
kv AS (SELECT record_id, entry_table, unnest(map_keys(m)) AS k, unnest(map_values(m)) AS v FROM p),
cm AS (SELECT record_id, entry_table, list(struct_pack(t := {Q.clean('v')}, lab := {_comment_label_sql('k')}) ORDER BY k) AS items
       FROM kv WHERE strpos(lower({Q.clean('k')}), 'comment') > 0 GROUP BY record_id, entry_table),
ph AS (SELECT p.record_id, p.entry_table, list_filter(list_transform(string_split_regex({Q.clean(photo)}, '[\r\n,]+'),
         lambda x: CASE WHEN starts_with({Q.clean('x')}, 'static/uploads/') THEN '/' || {Q.clean('x')} ELSE {Q.clean('x')} END),
         lambda x: starts_with(x, '/static/uploads/')) AS refs FROM p),
phu AS (SELECT record_id, entry_table, unnest(refs) AS ref, generate_subscripts(refs, 1) AS pos FROM ph),
phd AS (SELECT record_id, entry_table, string_agg(ref, chr(10) ORDER BY first_pos) AS photo_refs, CAST(count(*) AS INTEGER) AS n_photos
        FROM (SELECT record_id, entry_table, ref, min(pos) AS first_pos FROM phu GROUP BY ALL) GROUP BY record_id, entry_table),
shaped AS (SELECT p.record_id, p.entry_table, p.section, p.stage_key, p.created_at, p.run_id,
  {_SHEET_NAME.replace('section', 'p.section').replace('entry_table', 'p.entry_table')} AS display_section,
  {Q.run_label('p.run_number', 'p.batch_number', 'p.run_id')} AS run_label,
  coalesce({Q.nonblank('p.machine_label')}, {_SHEET_NAME.replace('section', 'p.section').replace('entry_table', 'p.entry_table')}) AS machine_label,
  {Q.clean("concat_ws(' ', " + Q.nonblank('p.entry_date') + ", " + Q.nonblank('p.entry_time') + ")")} AS captured_at,
  {user} AS user_label,
  array_to_string(list_reduce(coalesce(cm.items, []), lambda acc, e: CASE WHEN e.t = '' OR list_contains(acc, e.t) THEN acc
     ELSE list_append(acc, CASE WHEN e.lab = 'Comments' THEN e.t ELSE e.lab || ': ' || e.t END) END,
     CASE WHEN {Q.clean('p.comments')} <> '' THEN [{Q.clean('p.comments')}] ELSE []::VARCHAR[] END), chr(10)) AS comment_text,
  coalesce(phd.photo_refs, '') AS photo_refs, coalesce(phd.n_photos, 0) AS n_photos
  FROM p LEFT JOIN cm ON cm.record_id = p.record_id AND cm.entry_table = p.entry_table
  LEFT JOIN phd ON phd.record_id = p.record_id AND phd.entry_table = p.entry_table)
SELECT * FROM shaped WHERE comment_text <> '' OR n_photos > 0"""


@query("media_entries", _media_sql())
def q_media_entries(spark, t, sf_dir):
    """O-SET-2 + O-RSH-5 + O-JOIN-5 + O-SCL-16/17: all entries with comments or photos, display shape."""
    return FD.media_entries(FD.media_rows(t, ""))


@query("media_search", f"SELECT record_id, entry_table, n_photos, photo_refs FROM ({_media_sql('foam')}) WHERE n_photos > 0")
def q_media_search(spark, t, sf_dir):
    """O-FLT-12 + O-FLT-13: media rows matching 'foam', pictures only."""
    return FD.media_show(FD.media_entries(FD.media_rows(t, "foam")), "pictures").select(
        "record_id", "entry_table", "n_photos", "photo_refs")


@query("media_counts", f"SELECT count(*) AS all_entries, count(*) FILTER (WHERE comment_text <> '') AS with_comments, count(*) FILTER (WHERE n_photos > 0) AS with_pictures FROM ({_media_sql()})")
def q_media_counts(spark, t, sf_dir):
    """O-AGG-10: media totals."""
    return FD.media_counts(FD.media_entries(FD.media_rows(t, "")))


# --------------------------------------------------------------- listings

def _listing_sql(view: str, cols: str, search: str) -> str:
    return f"""SELECT {cols}, r.run_number FROM {view} e LEFT JOIN fx_runs r ON r.id = e.run_id
WHERE coalesce(r.run_number ILIKE '%{search}%' OR e.employee ILIKE '%{search}%' OR e.entry_date ILIKE '%{search}%', FALSE)
ORDER BY e.created_at DESC, e.id DESC LIMIT 300"""


_EXT_COLS = ["id", "run_id", "employee", "operator_initials", "entry_date", "entry_time", "location", "start_time",
             "stop_time", "comments", "created_at"]
_FIL_COLS = ["id", "run_id", "employee", "operator_initials", "entry_date", "startup_time", "shutdown_time",
             "completion_status", "comments", "created_at"]


@query("extraction_listing", _listing_sql("fx_extraction", ", ".join("e." + c for c in _EXT_COLS), "e1"))
def q_extraction_listing(spark, t, sf_dir):
    """O-FLT-6 + O-SRT-4: extraction entries matching 'e1', newest 300."""
    return FD.entry_listing(t.extraction, t.runs, _EXT_COLS, "e1", 300)


@query("filtration_listing", _listing_sql("fx_filtration", ", ".join("e." + c for c in _FIL_COLS), "2024-01-1"))
def q_filtration_listing(spark, t, sf_dir):
    """O-FLT-6 + O-SRT-4: filtration entries matching a date prefix, newest 300."""
    return FD.entry_listing(t.filtration, t.runs, _FIL_COLS, "2024-01-1", 300)


@query("clarifier_listing", f"""SELECT id, employee, operator_initials, entry_date, completion_status, created_at,
 coalesce({Q.payload_map()}['clarification_sequential_no'], '') AS clarification_sequential_no
FROM fx_sheets WHERE stage_key = 'clarifier'
 AND coalesce(operator_initials ILIKE '%op1%' OR employee ILIKE '%op1%' OR entry_date ILIKE '%op1%', FALSE)
ORDER BY created_at DESC, id DESC LIMIT 300""")
def q_clarifier_listing(spark, t, sf_dir):
    """O-FLT-7 + O-RSH-12: clarifier sheets by initials search with a payload field."""
    return FD.clarifier_listing(t.sheets, "op1", 300)


@query("change_history", """SELECT f.id, f.run_id, f.entry_table, f.record_id, f.field_name, f.created_at, r.run_number, r.batch_number,
 CASE f.entry_table WHEN 'extraction_entries' THEN 'Extraction' WHEN 'filtration_entries' THEN 'Filtration'
   WHEN 'evaporation_entries' THEN 'Evaporation' WHEN 'sheet_entries' THEN 'Run Sheet' WHEN 'production_runs' THEN 'Run' END AS display_sheet,
 coalesce(nullif(f.corrected_value, ''), f.field_value) AS shown_value
FROM fx_field_changes f LEFT JOIN fx_runs r ON r.id = f.run_id ORDER BY f.created_at DESC, f.id DESC LIMIT 200""")
def q_change_history(spark, t, sf_dir):
    """O-SRT-8: 200 newest corrections with run columns."""
    return FD.change_history(t.field_changes, t.runs, None, 200)


@query("change_history_run", """SELECT f.id, f.run_id, f.entry_table, f.record_id, f.field_name, f.created_at, r.run_number, r.batch_number,
 CASE f.entry_table WHEN 'extraction_entries' THEN 'Extraction' WHEN 'filtration_entries' THEN 'Filtration'
   WHEN 'evaporation_entries' THEN 'Evaporation' WHEN 'sheet_entries' THEN 'Run Sheet' WHEN 'production_runs' THEN 'Run' END AS display_sheet,
 coalesce(nullif(f.corrected_value, ''), f.field_value) AS shown_value
FROM fx_field_changes f LEFT JOIN fx_runs r ON r.id = f.run_id WHERE f.run_id = 17 ORDER BY f.created_at DESC, f.id DESC LIMIT 200""")
def q_change_history_run(spark, t, sf_dir):
    """O-SRT-8 for one run."""
    return FD.change_history(t.field_changes, t.runs, 17, 200)


@query("correction_counts", """SELECT run_id, count(*) AS corrections, 'run' AS scope FROM fx_field_changes GROUP BY run_id
UNION ALL SELECT NULL, count(*), 'all' FROM fx_field_changes""")
def q_correction_counts(spark, t, sf_dir):
    """O-AGG-13: corrections per run and in total."""
    return FD.correction_counts(t.field_changes)


@query("open_draft_sheets", """SELECT s.id AS entry_id, s.stage_key, s.stage_title, s.run_id, r.run_number, r.batch_number,
 r.blend_number, r.split_batch_number FROM fx_sheets s JOIN fx_runs r ON r.id = s.run_id
WHERE s.completion_status = 'Draft' AND r.status = 'Open' ORDER BY s.id DESC LIMIT 20""")
def q_open_draft_sheets(spark, t, sf_dir):
    """O-JOIN-4 + O-FLT-23: newest 20 draft sheets of open runs."""
    return FD.open_draft_sheets(t.sheets, t.runs, 20)


@query("entries_with_user", """SELECT e.id, e.employee, u.full_name AS employee_name, u.initials AS user_initials
FROM fx_extraction e LEFT JOIN fx_users u ON u.employee_number = e.employee""")
def q_entries_with_user(spark, t, sf_dir):
    """O-JOIN-5: entries LEFT JOIN users on employee number."""
    from batchtrail.operators.joins import join_users
    return join_users(t.extraction.select("id", "employee"), t.users, "employee")


# ------------------------------------------- whole listings in order, compared by position

@query("activity_feed_all", f"""WITH {_feed_sql(CUTOFF_12H)} SELECT *, row_number() OVER (ORDER BY activity_time DESC, entry_table DESC, record_id DESC) AS position FROM feed""")
def q_activity_feed_all(spark, t, sf_dir):
    """O-SET-1 + O-FLT-9: last 12 hours across the four tables without a cap, with each row's place."""
    return PG.positions(FD.activity_feed(t, AS_OF, 12, None), FD.feed_order())


@query("extraction_listing_all", _listing_sql("fx_extraction", ", ".join("e." + c for c in _EXT_COLS), "e1").replace(
    "r.run_number FROM", "r.run_number, row_number() OVER (ORDER BY e.created_at DESC, e.id DESC) AS position FROM").replace("LIMIT 300", ""))
def q_extraction_listing_all(spark, t, sf_dir):
    """O-FLT-6 + O-SRT-4: every extraction entry matching 'e1', with its place in the newest-first order."""
    return PG.positions(FD.entry_listing(t.extraction, t.runs, _EXT_COLS, "e1"), [F.col("created_at").desc(), F.col("id").desc()])


@query("change_history_all", """SELECT f.id, f.run_id, f.created_at, r.run_number, row_number() OVER (ORDER BY f.created_at DESC, f.id DESC) AS position
FROM fx_field_changes f LEFT JOIN fx_runs r ON r.id = f.run_id""")
def q_change_history_all(spark, t, sf_dir):
    """O-SRT-8: every correction with its place in the newest-first order."""
    rows = FD.change_history(t.field_changes, t.runs).select("id", "run_id", "created_at", "run_number")
    return PG.positions(rows, [F.col("created_at").desc(), F.col("id").desc()])

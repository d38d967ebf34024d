"""Registered queries: lifecycle folds, latest entries, packets, checklist."""

from __future__ import annotations

from pyspark.sql import functions as F

from batchtrail.operators import latest as LT
from batchtrail.operators import lifecycle as LC
from batchtrail.operators.runs import stage_checklist
from batchtrail.plans import sqltext as Q
from batchtrail.plans.registry import query
from batchtrail.sources.fixtures import fixture
from batchtrail.sources.stages import RUN_LINKED_STAGES, RUN_STAGE_KEYS, stage_titles
from batchtrail.sources.tables import SCHEMAS, parse_payload, payload_cells, reconcile_schema

_RUN_STAGES = ", ".join(f"'{k}'" for k in RUN_STAGE_KEYS)


def _fold_sql(keys: list[str]) -> str:
    part = ", ".join(keys)
    pby = f"PARTITION BY {part} " if keys else ""
    grp = ", ".join(keys + ["entry_no"])
    return f"""WITH s AS (SELECT *, CASE WHEN save_mode = 'Complete' THEN 1 ELSE 0 END AS c FROM fx_submits),
n AS (SELECT *, CAST(coalesce(sum(c) OVER ({pby}ORDER BY submitted_at, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS entry_no FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY {grp} ORDER BY submitted_at, event_id) AS a,
        row_number() OVER (PARTITION BY {grp} ORDER BY submitted_at DESC, event_id DESC) AS z FROM n)
SELECT {grp}, max(CASE WHEN a = 1 THEN event_id END) AS entry_id, CAST(count(*) AS INTEGER) AS version_no,
  max(CASE WHEN z = 1 THEN save_mode END) AS completion_status, min(submitted_at) AS created_at,
  max(submitted_at) AS updated_at, max(CASE WHEN z = 1 THEN employee END) AS employee
FROM r GROUP BY {grp}"""


@query("fold_drafts", _fold_sql(["run_id", "stage_key"]))
def q_fold_drafts(spark, t, sf_dir):
    """O-STATE-1 + O-WIN-10: run-linked sheet entries (versions) from the submit log."""
    return LC.fold_drafts(fixture(spark, sf_dir, "fx_submits"), ["run_id", "stage_key"])


@query("fold_drafts_standalone", _fold_sql(["stage_key"]))
def q_fold_standalone(spark, t, sf_dir):
    """O-STATE-1 standalone rule: the latest draft per stage (no run)."""
    return LC.fold_drafts(fixture(spark, sf_dir, "fx_submits"), ["stage_key"])


@query("fold_drafts_global", _fold_sql([]))
def q_fold_global(spark, t, sf_dir):
    """O-STATE-1 filtration rule: one global latest draft (minute-bucketed, no single-task window)."""
    return LC.fold_drafts(fixture(spark, sf_dir, "fx_submits"), [])


_TITLES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in stage_titles().items())


@query("audit_entries", f"""WITH s AS (SELECT *, CASE WHEN save_mode = 'Complete' THEN 1 ELSE 0 END AS c FROM fx_submits),
n AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY run_id, stage_key ORDER BY submitted_at, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS entry_no FROM s),
f AS (SELECT *, first_value(event_id) OVER (PARTITION BY run_id, stage_key, entry_no ORDER BY submitted_at, event_id) AS record_id FROM n)
SELECT 'sheet_entries' AS table_name, record_id, CASE WHEN event_id = record_id THEN 'create' ELSE 'update' END AS action_type,
  employee AS changed_by, '' AS old_data,
  coalesce(CASE stage_key {_TITLES} END, stage_key) || CASE WHEN event_id = record_id THEN ' entry created as ' ELSE ' entry saved as ' END
  || lower(save_mode) AS new_data, submitted_at AS created_at, event_id FROM f""")
def q_audit_entries(spark, t, sf_dir):
    """O-STATE-2 + O-SNK-3: audit rows of every submit."""
    return LC.audit_entries(fixture(spark, sf_dir, "fx_submits"))


@query("audit_filtration", """WITH s AS (SELECT *, CASE WHEN save_mode = 'Complete' THEN 1 ELSE 0 END AS c FROM fx_submits),
n AS (SELECT *, coalesce(sum(c) OVER (ORDER BY submitted_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS entry_no FROM s),
f AS (SELECT *, first_value(event_id) OVER (PARTITION BY entry_no ORDER BY submitted_at, event_id) AS record_id FROM n)
SELECT 'filtration_entries' AS table_name, record_id, CASE WHEN event_id = record_id THEN 'create' ELSE 'update' END AS action_type,
  employee AS changed_by, '' AS old_data, CASE WHEN event_id = record_id THEN 'filtration entry created as ' ELSE 'filtration entry saved as ' END
  || lower(save_mode) AS new_data, submitted_at AS created_at, event_id FROM f""")
def q_audit_filtration(spark, t, sf_dir):
    """O-STATE-2 + O-SNK-3: audit rows of filtration saves (one global draft, their own wording)."""
    return LC.audit_entries(fixture(spark, sf_dir, "fx_submits"), [], table="filtration_entries", title="filtration")


def _void_sql(auto: bool) -> str:
    reset = """lastcs AS (SELECT run_id, stage_key, logged_at AS rt, event_id AS re FROM (
   SELECT *, row_number() OVER (PARTITION BY run_id, stage_key ORDER BY logged_at DESC, event_id DESC) AS k
   FROM fx_void_log WHERE action = 'complete_save') WHERE k = 1),"""
    tog = ("SELECT l.* FROM fx_void_log l LEFT JOIN lastcs c ON c.run_id = l.run_id AND c.stage_key = l.stage_key "
           "WHERE l.action = 'toggle' AND (c.rt IS NULL OR l.logged_at > c.rt OR (l.logged_at = c.rt AND l.event_id > c.re))"
           if auto else "SELECT * FROM fx_void_log WHERE action = 'toggle'")
    return f"""{reset if auto else ''}
tg AS ({tog}),
agg AS (SELECT *, count(*) OVER (PARTITION BY run_id, stage_key) AS n,
   row_number() OVER (PARTITION BY run_id, stage_key ORDER BY logged_at DESC, event_id DESC) AS k FROM tg)
SELECT run_id, stage_key, trim(actor) AS voided_by, logged_at AS voided_at FROM agg WHERE k = 1 AND n % 2 = 1"""


VOID_CTE = "vs AS (" + _void_sql(True).replace("lastcs AS", "WITH lastcs AS", 1) + ")"


@query("void_state", "WITH " + _void_sql(True).strip())
def q_void_state(spark, t, sf_dir):
    """O-STATE-3: voided (run, stage) keys, Complete saves un-void (auto-unvoid)."""
    return LC.void_state(fixture(spark, sf_dir, "fx_void_log"), True)


@query("void_state_toggles", "WITH " + _void_sql(False).strip())
def q_void_state_toggles(spark, t, sf_dir):
    """O-STATE-3 without auto-unvoid: toggle parity."""
    return LC.void_state(fixture(spark, sf_dir, "fx_void_log"), False)


_CHANGES_SQL = f"""c AS (SELECT submission_id, field_name, {Q.clean('new_value')} AS field_value, {Q.clean('old_value')} AS original_value,
   {Q.clean('new_value')} AS corrected_value, upper({Q.clean('initials')}) AS change_initials
 FROM fx_corrections WHERE {Q.clean('new_value')} <> {Q.clean('old_value')}),
bad AS (SELECT DISTINCT submission_id FROM c WHERE change_initials = '')"""


@query("field_changes", f"WITH {_CHANGES_SQL} SELECT * FROM c WHERE submission_id NOT IN (SELECT submission_id FROM bad)")
def q_field_changes(spark, t, sf_dir):
    """O-STATE-4 + O-SNK-4: accepted correction rows (T19/T20)."""
    accepted, _missing = LC.field_changes(fixture(spark, sf_dir, "fx_corrections"))
    return accepted


@query("rejected_corrections", f"WITH {_CHANGES_SQL} SELECT submission_id, field_name FROM c WHERE change_initials = ''")
def q_rejected_corrections(spark, t, sf_dir):
    """O-STATE-4: changed fields lacking initials (their submissions are rejected)."""
    _accepted, missing = LC.field_changes(fixture(spark, sf_dir, "fx_corrections"))
    return missing


_RAW_CHANGES_SQL = f"""f AS (SELECT c.*, {Q.payload_map('c.form_json')} AS m, s.run_id, {Q.payload_map('s.payload_json')} AS p, s.comments, s.entry_date,
   s.operator_initials FROM fx_correction_forms c JOIN fx_sheets s ON s.id = c.record_id),
e AS (SELECT *, unnest(map_keys(m)) AS k FROM f),
v AS (SELECT submission_id, run_id, entry_table, record_id, k AS field_name, {Q.clean('m[k]')} AS field_value,
   {Q.clean("(CASE k WHEN 'comments' THEN comments WHEN 'entry_date' THEN entry_date WHEN 'operator_initials' THEN operator_initials ELSE p[k] END)")} AS old_value,
   {Q.clean("m['__original__' || k]")} AS o, {Q.clean("m['__corrected__' || k]")} AS n, upper({Q.clean("m['__change__' || k]")}) AS change_initials,
   {Q.clean("m['correction_reason']")} AS correction_reason, employee AS changed_by_employee, submitted_at AS created_at FROM e
   WHERE k <> 'correction_reason' AND NOT regexp_matches(k, '^__(change|original|corrected)__|^__session_signature_')),
x AS (SELECT * FROM v WHERE field_value <> old_value)"""


@query("corrections_from_forms", f"""WITH {_RAW_CHANGES_SQL}
SELECT submission_id, run_id, entry_table, record_id, field_name, field_value, coalesce(nullif(o, ''), old_value) AS original_value,
  coalesce(nullif(n, ''), field_value) AS corrected_value, change_initials, correction_reason, changed_by_employee, created_at
FROM x WHERE submission_id NOT IN (SELECT submission_id FROM x WHERE change_initials = '')""")
def q_corrections_from_forms(spark, t, sf_dir):
    """O-STATE-4 + O-SNK-4: correction log rows from raw forms against the saved sheets."""
    accepted, _lacking = LC.corrections_from_forms(fixture(spark, sf_dir, "fx_correction_forms"), LC.saved_values(t.sheets))
    return accepted


@query("corrections_lacking_initials", f"WITH {_RAW_CHANGES_SQL} SELECT submission_id, field_name FROM x WHERE change_initials = ''")
def q_corrections_lacking_initials(spark, t, sf_dir):
    """O-STATE-4: changed fields of raw forms that lack initials; their forms are refused."""
    _accepted, lacking = LC.corrections_from_forms(fixture(spark, sf_dir, "fx_correction_forms"), LC.saved_values(t.sheets))
    return lacking


_LATEST_SHEET = f"""ls AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, stage_key ORDER BY id DESC) AS k
   FROM fx_sheets WHERE run_id IS NOT NULL AND stage_key IN ({_RUN_STAGES})) WHERE k = 1)"""


_FINALIZE_CTE = f"""upto AS (SELECT * FROM (SELECT q.request_id, s.completion_status,
    row_number() OVER (PARTITION BY q.request_id, s.stage_key ORDER BY s.id DESC) AS k
  FROM fx_finalize_requests q JOIN fx_sheets s ON s.run_id = q.run_id AND s.created_at <= q.requested_at AND s.stage_key IN ({_RUN_STAGES})) WHERE k = 1),
ok AS (SELECT DISTINCT request_id FROM upto WHERE coalesce(nullif(completion_status, ''), 'Complete') = 'Complete'),
r AS (SELECT q.*, (ru.id IS NOT NULL AND (q.path = 'quick' OR ok.request_id IS NOT NULL)) AS accepted FROM fx_finalize_requests q
  LEFT JOIN ok ON ok.request_id = q.request_id LEFT JOIN fx_runs ru ON ru.id = q.run_id)"""


@query("finalize_runs", f"""WITH {_FINALIZE_CTE},
last AS (SELECT run_id, requested_at, trim(employee) AS employee FROM (SELECT *, row_number() OVER (PARTITION BY run_id
   ORDER BY requested_at DESC, request_id DESC) AS k FROM r WHERE accepted) WHERE k = 1),
agg AS (SELECT run_id, count(*) FILTER (WHERE accepted) AS accepted_requests, count(*) FILTER (WHERE NOT accepted) AS rejected_requests
   FROM r GROUP BY run_id)
SELECT a.run_id, CASE WHEN a.accepted_requests > 0 THEN 'Complete' ELSE ru.status END AS status,
  CASE WHEN a.accepted_requests > 0 THEN l.requested_at END AS finalized_at,
  CASE WHEN a.accepted_requests > 0 THEN l.employee END AS finalized_by, a.accepted_requests, a.rejected_requests
FROM agg a LEFT JOIN fx_runs ru ON ru.id = a.run_id LEFT JOIN last l ON l.run_id = a.run_id""")
def q_finalize_runs(spark, t, sf_dir):
    """O-STATE-5: close runs; the review path needs a sheet Complete at the time of the request."""
    return LC.finalize_runs(t.runs, fixture(spark, sf_dir, "fx_finalize_requests"), t.sheets)


@query("finalize_products", f"""WITH {_FINALIZE_CTE},
p AS (SELECT run_id, product FROM (SELECT r.run_id, {Q.clean("(CASE WHEN event_id % 3 = 0 THEN concat(' P', event_id % 7, ' ') ELSE '' END)")} AS product,
    row_number() OVER (PARTITION BY r.run_id ORDER BY requested_at DESC, request_id DESC) AS k
  FROM r JOIN events e ON e.event_id = r.request_id WHERE accepted AND path <> 'quick' AND event_id % 3 = 0) WHERE k = 1)
SELECT DISTINCT r.run_id, coalesce(p.product, ru.product_name) AS product_name
FROM r LEFT JOIN p ON p.run_id = r.run_id LEFT JOIN fx_runs ru ON ru.id = r.run_id""")
def q_finalize_products(spark, t, sf_dir):
    """O-STATE-5: the product name given on closing a run after review (last one given wins)."""
    log = fixture(spark, sf_dir, "fx_finalize_requests").withColumn("product_name", F.when(
        F.col("request_id") % 3 == 0, F.concat(F.lit(" P"), (F.col("request_id") % 7).cast("string"), F.lit(" "))).otherwise(F.lit("")))
    return LC.finalize_runs(t.runs, log, t.sheets).select("run_id", "product_name")


_CHECKED_SQL = """req AS (SELECT request_id, action, """ + Q.clean("group_label") + """ AS group_label, source_run_id, requested_at, """ + Q.clean("employee") + """ AS actor FROM fx_group_requests),
lbl AS (SELECT DISTINCT group_label AS label FROM req WHERE group_label <> ''),
cand AS (SELECT l.label, r.id, r.status, r.updated_at FROM lbl l JOIN fx_runs r ON r.run_number = l.label OR r.batch_number = l.label),
tgt AS (SELECT label, id AS target_run_id FROM (SELECT *, row_number() OVER (PARTITION BY label
   ORDER BY (status = 'Open') DESC, updated_at DESC NULLS LAST, id DESC) AS k FROM cand) WHERE k = 1),
chk AS (SELECT q.*, t.target_run_id, s.id AS sid, tr.batch_type AS tbt, tr.blend_number AS tb, tr.split_batch_number AS ts
   FROM req q LEFT JOIN fx_runs s ON s.id = q.source_run_id LEFT JOIN tgt t ON t.label = q.group_label
   LEFT JOIN fx_runs tr ON tr.id = t.target_run_id),
seen AS (SELECT request_id, action, group_label, source_run_id, requested_at, actor, target_run_id,
  CASE WHEN group_label = '' THEN 'blank_label' WHEN sid IS NULL THEN 'no_source_run'
       WHEN target_run_id = source_run_id THEN 'label_is_source'
       WHEN target_run_id IS NOT NULL AND NOT (coalesce(""" + Q.clean("tbt") + """ = action, FALSE) AND coalesce((CASE WHEN action = 'blend' THEN """ + Q.clean("tb") + """ ELSE """ + Q.clean("ts") + """ END) = group_label, FALSE))
         THEN 'label_taken' END AS why0 FROM chk),
kinds AS (SELECT group_label, action AS kind FROM (SELECT *, row_number() OVER (PARTITION BY group_label ORDER BY requested_at, request_id) AS k
  FROM seen WHERE why0 IS NULL AND target_run_id IS NULL) WHERE k = 1),
checked AS (SELECT s.request_id, s.action, s.group_label, s.source_run_id, s.requested_at, s.actor, s.target_run_id,
  coalesce(s.why0, CASE WHEN s.target_run_id IS NULL AND s.action <> k.kind THEN 'label_taken' END) AS why
  FROM seen s LEFT JOIN kinds k ON k.group_label = s.group_label)"""


@query("group_label_requests", f"""WITH {_CHECKED_SQL}
SELECT request_id, action, group_label, source_run_id, requested_at, actor, target_run_id,
  CASE WHEN why IS NULL THEN 'accepted' ELSE 'rejected' END AS outcome, coalesce(why, '') AS reason FROM checked""")
def q_group_label_requests(spark, t, sf_dir):
    """O-STATE-7: blend/split requests checked against the runs (reason codes)."""
    return LC.group_label_requests(t.runs, fixture(spark, sf_dir, "fx_group_requests")).drop("source_run_ids")


@query("apply_group_labels", f"""WITH {_CHECKED_SQL},
ok AS (SELECT * FROM checked WHERE why IS NULL),
touched AS (SELECT source_run_id AS run_id, action, group_label, requested_at, request_id, TRUE AS is_source FROM ok
  UNION ALL SELECT target_run_id, action, group_label, requested_at, request_id, FALSE FROM ok WHERE target_run_id IS NOT NULL),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY requested_at DESC, request_id DESC) AS k FROM touched) WHERE k = 1)
SELECT r.id AS run_id, CASE WHEN l.action = 'blend' THEN l.group_label ELSE '' END AS blend_number,
  CASE WHEN l.action = 'split' THEN l.group_label ELSE '' END AS split_batch_number,
  CASE WHEN l.is_source THEN 'standard' ELSE r.batch_type END AS batch_type
FROM fx_runs r JOIN last l ON l.run_id = r.id""")
def q_apply_group_labels(spark, t, sf_dir):
    """O-STATE-7 + T24: label columns after the accepted requests (one group per run)."""
    checked = LC.group_label_requests(t.runs, fixture(spark, sf_dir, "fx_group_requests"))
    return LC.apply_group_labels(t.runs, checked)


_DERIVED_SQL = f"""WITH {_CHECKED_SQL},
new AS (SELECT * FROM checked WHERE why IS NULL AND target_run_id IS NULL),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY action, group_label ORDER BY requested_at, request_id) AS k FROM new) WHERE k = 1),
heads AS (SELECT CAST((SELECT max(id) FROM fx_runs) + row_number() OVER (ORDER BY f.requested_at, f.request_id) AS BIGINT) AS id,
  f.group_label AS batch_number, CASE WHEN f.action = 'split' THEN f.group_label ELSE '' END AS split_batch_number,
  CASE WHEN f.action = 'blend' THEN f.group_label ELSE '' END AS blend_number, f.group_label AS run_number,
  f.action AS batch_type, 1 AS reused_batch, {Q.clean('s.product_name')} AS product_name, '' AS shift_name,
  f.actor AS operator_id, '' AS notes, 'Open' AS status, f.source_run_id, f.requested_at AS created_at,
  f.requested_at AS updated_at
  FROM firsts f LEFT JOIN fx_runs s ON s.id = f.source_run_id)"""


@query("derived_runs", _DERIVED_SQL + "\nSELECT * FROM heads")
def q_derived_runs(spark, t, sf_dir):
    """O-STATE-8 + O-STATE-6: new derived run headers with contiguous ids after the current maximum."""
    checked = LC.group_label_requests(t.runs, fixture(spark, sf_dir, "fx_group_requests"))
    return LC.derived_runs(t.runs, checked, LC.max_id(t.runs))


def _heads(spark, t, sf_dir):
    checked = LC.group_label_requests(t.runs, fixture(spark, sf_dir, "fx_group_requests"))
    return LC.derived_runs(t.runs, checked, LC.max_id(t.runs))


@query("derived_sheet_copies", _DERIVED_SQL + f""",
{_LATEST_SHEET}
SELECT h.id AS target_run_id, ls.id AS source_entry_id, ls.stage_key, ls.stage_title, ls.operator_initials, ls.entry_date,
  ls.comments, ls.completion_status, ls.employee, 1 AS version_no, CAST(NULL AS BIGINT) AS previous_entry_id
FROM ls JOIN heads h ON h.source_run_id = ls.run_id""")
def q_derived_sheet_copies(spark, t, sf_dir):
    """O-STATE-8: latest sheets of each source copied to its derived run (payloads: ``derived_sheet_cells``)."""
    return LC.derived_sheet_copies(t.sheets, _heads(spark, t, sf_dir)).select(
        "target_run_id", "source_entry_id", "stage_key", "stage_title", "operator_initials", "entry_date", "comments",
        "completion_status", "employee", "version_no", "previous_entry_id")


@query("derived_sheet_cells", _DERIVED_SQL + f""",
{_LATEST_SHEET},
c AS (SELECT h.id AS target_run_id, ls.stage_key, h.run_number, h.blend_number,
   unnest(map_entries({Q.payload_map('ls.payload_json')})) AS e FROM ls JOIN heads h ON h.source_run_id = ls.run_id)
SELECT target_run_id, stage_key, e.key AS key, CASE WHEN e.key IN ('run_number', 'production_number') THEN run_number
  WHEN e.key = 'run_blend_number' THEN coalesce(nullif(blend_number, ''), run_number) ELSE e.value END AS value FROM c""")
def q_derived_sheet_cells(spark, t, sf_dir):
    """O-RSH-11: the rewritten payloads of the copied sheets, one row per field."""
    copies = LC.derived_sheet_copies(t.sheets, _heads(spark, t, sf_dir))
    return payload_cells(copies, parse_payload("payload_json"), "target_run_id", "stage_key")


_EXT_COPY = ["employee", "operator_initials", "entry_date", "entry_time", "location", "psf1_speed", "psf1_load", "press_blowback",
             "chip_bin_steam", "comments", "photo_path"]


def _latest_entry_sql(view: str) -> str:
    return f"""le AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY id DESC) AS k
  FROM {view} WHERE run_id IS NOT NULL) WHERE k = 1)"""


@query("derived_extraction_copies", _DERIVED_SQL + f""",
{_latest_entry_sql('fx_extraction')}
SELECT h.id AS target_run_id, le.id AS source_entry_id, {', '.join('le.' + c for c in _EXT_COPY)}, 1 AS version_no
FROM le JOIN heads h ON h.source_run_id = le.run_id""")
def q_derived_extraction_copies(spark, t, sf_dir):
    """O-STATE-8: latest extraction entry of each source copied to its derived run."""
    return LC.derived_entry_copies(t.extraction, _heads(spark, t, sf_dir)).select(
        "target_run_id", "source_entry_id", *_EXT_COPY, "version_no")


@query("derived_filtration_rows", _DERIVED_SQL + f""",
{_latest_entry_sql('fx_filtration')}
SELECT h.id AS target_run_id, le.id AS source_entry_id, x.row_group, CAST(x.row_no AS INTEGER) AS row_no, x.row_time, x.fic1_gpm,
  x.perm_total, x.retentate_ri FROM le JOIN heads h ON h.source_run_id = le.run_id JOIN fx_filtration_rows x ON x.filtration_entry_id = le.id""")
def q_derived_filtration_rows(spark, t, sf_dir):
    """O-STATE-8: child rows of the latest filtration entry of each source, copied to its derived run."""
    copies = LC.derived_entry_copies(t.filtration.select("id", "run_id"), _heads(spark, t, sf_dir))
    return LC.derived_child_rows(copies, t.filtration_rows).select(
        "target_run_id", "source_entry_id", "row_group", "row_no", "row_time", "fic1_gpm", "perm_total", "retentate_ri")


@query("fold_sheet_content", f"""WITH m AS (SELECT *, {Q.payload_map('form_json')} AS raw FROM fx_submit_forms),
n AS (SELECT *, CAST(coalesce(sum(CASE WHEN save_mode = 'Complete' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, stage_key
   ORDER BY submitted_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS entry_no FROM m),
l AS (SELECT *, row_number() OVER (PARTITION BY run_id, stage_key, entry_no ORDER BY submitted_at DESC, event_id DESC) AS z,
   first_value(event_id) OVER (PARTITION BY run_id, stage_key, entry_no ORDER BY submitted_at, event_id) AS entry_id FROM n),
e AS (SELECT run_id, stage_key, entry_id, unnest(map_entries(raw)) AS e FROM l WHERE z = 1)
SELECT run_id, stage_key, entry_id, e.key AS key, e.value AS value FROM e
WHERE NOT starts_with(e.key, '__session_signature_') AND e.key <> 'save_mode'
UNION ALL SELECT run_id, stage_key, entry_id, '=comments', coalesce(raw['comments'], '') FROM l WHERE z = 1
UNION ALL SELECT run_id, stage_key, entry_id, '=entry_date', coalesce(raw['entry_date'], '') FROM l WHERE z = 1""")
def q_fold_sheet_content(spark, t, sf_dir):
    """O-STATE-1: content of the folded sheets: payload fields, comments and entry date of the last submit."""
    s = LC.saved_sheets(fixture(spark, sf_dir, "fx_submit_forms"))
    extra = F.map_from_arrays(F.array(F.lit("=comments"), F.lit("=entry_date")), F.array("comments", "entry_date"))
    return payload_cells(s, F.map_concat(parse_payload("payload_json"), extra), "run_id", "stage_key", "entry_id")


@query("audit_all", f"""{_DERIVED_SQL},
{_FINALIZE_CTE.replace("r AS (", "fr AS (")}
SELECT 'production_runs' AS table_name, h.id AS record_id, 'create' AS action_type, h.operator_id AS changed_by, '' AS old_data,
  h.batch_type || ' run ' || h.run_number || ' copied from run ' || {Q.run_label('s.run_number', 's.batch_number', 's.id')} AS new_data, h.created_at
FROM heads h JOIN fx_runs s ON s.id = h.source_run_id
UNION ALL SELECT 'production_runs', coalesce(c.target_run_id, h.id), c.action, c.actor, '',
  c.action || ' run ' || c.group_label || ' linked to source run(s): ' || {Q.run_label('s.run_number', 's.batch_number', 's.id')}, c.requested_at
FROM checked c JOIN fx_runs s ON s.id = c.source_run_id LEFT JOIN heads h ON h.batch_type = c.action AND h.run_number = c.group_label WHERE c.why IS NULL
UNION ALL SELECT 'production_runs', run_id, 'finalize', {Q.clean('employee')}, '',
  CASE WHEN path = 'quick' THEN 'run closed from quick action' ELSE 'run review completed and run closed' END, requested_at FROM fr WHERE accepted""")
def q_audit_all(spark, t, sf_dir):
    """O-STATE-2 + O-SNK-3: audit rows of copies, blend / split links and closed runs."""
    checked = LC.group_label_requests(t.runs, fixture(spark, sf_dir, "fx_group_requests"))
    heads = LC.derived_runs(t.runs, checked, LC.max_id(t.runs))
    closed = LC.finalize_audits(t.runs, fixture(spark, sf_dir, "fx_finalize_requests"), t.sheets)
    return LC.group_audits(checked, heads, t.runs).unionByName(closed)


# the replay of requests with several sources, as rounds of as-of joins (28 rounds settle every request at sf0.01)
_ROUNDS = 40


def _round_sql(k: int) -> str:
    return f"""hit{k} AS (SELECT run_id, n, action, label, 1 AS src FROM src WHERE request_id IN (SELECT request_id FROM free UNION ALL SELECT request_id FROM d{k - 1} WHERE why IS NULL)
  UNION ALL SELECT d.target_run_id, q.n, q.action, q.group_label, 0 FROM d{k - 1} d JOIN contested q USING (request_id) WHERE d.why IS NULL),
firstsrc{k} AS (SELECT run_id, min(n) AS n FROM hit{k} WHERE src = 1 GROUP BY run_id),
at{k} AS (SELECT q.request_id, q.n, q.action, q.group_label, q.sources, c.id, c.open, greatest(c.updated_at, p.requested_at) AS u, c.batch_type, c.blend_number, c.split_batch_number,
    h.n AS hn, h.action AS ha, h.label AS hl
  FROM contested q JOIN cands c ON c.label = q.group_label ASOF LEFT JOIN hit{k} h ON h.run_id = c.id AND q.n > h.n LEFT JOIN asked p ON p.n = h.n),
tgt{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY open DESC, u DESC NULLS LAST, id DESC) AS k FROM at{k}) WHERE k = 1),
d{k} AS (SELECT t.request_id, t.id AS target_run_id, CASE WHEN list_contains(t.sources, t.id) THEN 'label_is_source'
    WHEN (f.n IS NOT NULL AND f.n < t.n) OR t.batch_type <> t.action
      OR (CASE WHEN t.hn IS NULL THEN CASE WHEN t.action = 'blend' THEN t.blend_number ELSE t.split_batch_number END
               WHEN t.ha = t.action THEN t.hl ELSE '' END) <> t.group_label THEN 'label_taken' END AS why
  FROM tgt{k} t LEFT JOIN firstsrc{k} f ON f.run_id = t.id)"""


_MULTI_SQL = f"""asked AS (SELECT *, row_number() OVER (ORDER BY requested_at, request_id) AS n, CASE WHEN list_contains(sources, given) THEN given ELSE sources[1] END AS source_run_id FROM (
  SELECT request_id, action, {Q.clean('group_label')} AS group_label, requested_at, {Q.clean('employee')} AS actor, source_run_id AS given,
    list_filter(list_transform(string_split(source_ids, ','), lambda x: CAST(x AS BIGINT)), lambda x, i: x > 0
      AND NOT list_contains(string_split(source_ids, ',')[1:i - 1], CAST(x AS VARCHAR))) AS sources FROM fx_multi_requests)),
cands AS (SELECT DISTINCT l.label, r.id, coalesce(r.status = 'Open', FALSE) AS open, r.updated_at, {Q.clean('r.batch_type')} AS batch_type, {Q.clean('r.blend_number')} AS blend_number,
  {Q.clean('r.split_batch_number')} AS split_batch_number
  FROM (SELECT DISTINCT group_label AS label FROM asked WHERE group_label <> '') l JOIN fx_group_runs r ON r.run_number = l.label OR r.batch_number = l.label),
best AS (SELECT label, id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY open DESC, updated_at DESC NULLS LAST, id DESC) AS k FROM cands) WHERE k = 1),
chk AS (SELECT a.*, b.id AS best_id, CASE WHEN a.group_label = '' THEN 'blank_label' WHEN r.id IS NULL THEN 'no_source_run' END AS why0
  FROM asked a LEFT JOIN fx_group_runs r ON r.id = a.source_run_id LEFT JOIN best b ON b.label = a.group_label),
kinds AS (SELECT group_label, arg_min(action, n) AS kind FROM chk WHERE why0 IS NULL AND best_id IS NULL GROUP BY group_label),
free AS (SELECT c.request_id FROM chk c JOIN kinds k ON k.group_label = c.group_label AND k.kind = c.action WHERE c.why0 IS NULL AND c.best_id IS NULL),
contested AS (SELECT * FROM chk WHERE why0 IS NULL AND best_id IS NOT NULL),
src AS (SELECT request_id, n, action, group_label AS label, unnest(sources) AS run_id FROM chk WHERE why0 IS NULL),
d0 AS (SELECT request_id, best_id AS target_run_id, CAST(NULL AS VARCHAR) AS why FROM contested),
{", ".join(_round_sql(k) for k in range(1, _ROUNDS + 1))},
checked AS (SELECT c.request_id, c.action, c.group_label, c.source_run_id, c.sources, c.requested_at, c.actor, coalesce(d.target_run_id, c.best_id) AS target_run_id,
  coalesce(c.why0, d.why, CASE WHEN c.best_id IS NULL AND c.action <> k.kind THEN 'label_taken' END) AS why
  FROM chk c LEFT JOIN d{_ROUNDS} d USING (request_id) LEFT JOIN kinds k ON k.group_label = c.group_label)"""


def _multi_requests(spark, sf_dir):
    ids = F.transform(F.split("source_ids", ","), lambda x: x.cast("bigint"))
    return fixture(spark, sf_dir, "fx_multi_requests").withColumn("source_run_ids", ids)


def _group_runs(spark, sf_dir):
    return reconcile_schema(fixture(spark, sf_dir, "fx_group_runs"), SCHEMAS["production_runs"])


@query("group_requests_of_several", f"""WITH {_MULTI_SQL}
SELECT request_id, action, group_label, source_run_id, array_to_string(sources, ',') AS sources, requested_at, actor, target_run_id,
  CASE WHEN why IS NULL THEN 'accepted' ELSE 'rejected' END AS outcome, coalesce(why, '') AS reason FROM checked""")
def q_group_requests_of_several(spark, t, sf_dir):
    """O-STATE-7: requests of several source runs, one decision each, later ones see what earlier ones did."""
    checked = LC.group_label_requests(_group_runs(spark, sf_dir), _multi_requests(spark, sf_dir))
    return checked.withColumn("sources", F.array_join("source_run_ids", ",")).drop("source_run_ids")


@query("group_labels_of_several", f"""WITH {_MULTI_SQL},
ok AS (SELECT * FROM checked WHERE why IS NULL),
touched AS (SELECT unnest(sources) AS run_id, action, group_label, requested_at, request_id, TRUE AS is_source FROM ok
  UNION ALL SELECT target_run_id, action, group_label, requested_at, request_id, FALSE FROM ok WHERE target_run_id IS NOT NULL),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY requested_at DESC, request_id DESC) AS k FROM touched) WHERE k = 1)
SELECT r.id AS run_id, CASE WHEN l.action = 'blend' THEN l.group_label ELSE '' END AS blend_number,
  CASE WHEN l.action = 'split' THEN l.group_label ELSE '' END AS split_batch_number,
  CASE WHEN l.is_source THEN 'standard' ELSE r.batch_type END AS batch_type FROM fx_group_runs r JOIN last l ON l.run_id = r.id""")
def q_group_labels_of_several(spark, t, sf_dir):
    """O-STATE-7 + T24: label columns of every run after the requests of several sources."""
    runs = _group_runs(spark, sf_dir)
    return LC.apply_group_labels(runs, LC.group_label_requests(runs, _multi_requests(spark, sf_dir)))


@query("group_audits_of_several", f"""WITH {_MULTI_SQL},
new AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_label ORDER BY n) AS k FROM (SELECT c.*, a.n FROM checked c JOIN asked a USING (request_id)
   WHERE c.why IS NULL AND c.target_run_id IS NULL)) WHERE k = 1),
heads AS (SELECT *, CAST((SELECT max(id) FROM fx_group_runs) + row_number() OVER (ORDER BY n) AS BIGINT) AS id FROM new),
named AS (SELECT c.request_id, string_agg({Q.run_label('r.run_number', 'r.batch_number', 'r.id')}, ', ' ORDER BY r.id) AS labels
  FROM (SELECT request_id, unnest(sources) AS s FROM checked WHERE why IS NULL) c JOIN fx_group_runs r ON r.id = c.s GROUP BY c.request_id)
SELECT 'production_runs' AS table_name, h.id AS record_id, 'create' AS action_type, h.actor AS changed_by, '' AS old_data,
  h.action || ' run ' || h.group_label || ' copied from run ' || {Q.run_label('s.run_number', 's.batch_number', 's.id')} AS new_data, h.requested_at AS created_at
FROM heads h JOIN fx_group_runs s ON s.id = h.source_run_id
UNION ALL SELECT 'production_runs', coalesce(c.target_run_id, h.id), c.action, c.actor, '',
  c.action || ' run ' || c.group_label || ' linked to source run(s): ' || n.labels, c.requested_at
FROM checked c JOIN named n USING (request_id) LEFT JOIN heads h ON h.group_label = c.group_label WHERE c.why IS NULL""")
def q_group_audits_of_several(spark, t, sf_dir):
    """O-STATE-2 + O-SNK-3: audit rows of the requests of several sources: one link row with all source labels."""
    runs = _group_runs(spark, sf_dir)
    checked = LC.group_label_requests(runs, _multi_requests(spark, sf_dir))
    return LC.group_audits(checked, LC.derived_runs(runs, checked, LC.max_id(runs)), runs)


@query("touch_runs", """WITH s AS (SELECT run_id, created_at FROM fx_extraction UNION ALL SELECT run_id, created_at FROM fx_filtration
  UNION ALL SELECT run_id, created_at FROM fx_evaporation UNION ALL SELECT run_id, created_at FROM fx_sheets),
m AS (SELECT run_id, max(created_at) AS touched FROM s WHERE run_id IS NOT NULL GROUP BY run_id)
SELECT r.id, CASE WHEN m.touched IS NULL THEN r.updated_at WHEN r.updated_at IS NULL THEN m.touched
  ELSE greatest(r.updated_at, m.touched) END AS updated_at FROM fx_runs r LEFT JOIN m ON m.run_id = r.id""")
def q_touch_runs(spark, t, sf_dir):
    """O-STATE-9: run updated_at bumped by its latest saved entry."""
    return LC.touch_runs(t.runs, t.extraction, t.filtration, t.evaporation, t.sheets)


@query("edit_run_headers", f"""WITH e AS (SELECT *, {Q.clean('run_number')} AS rn, {Q.clean('product_name')} AS pn FROM fx_run_edits),
lastrn AS (SELECT run_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY edited_at DESC, edit_id DESC) AS k
   FROM e WHERE rn <> '') WHERE k = 1),
lastpn AS (SELECT run_id, pn, edited_at, notes, final_edit_initials, final_edit_notes FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY edited_at DESC, edit_id DESC) AS k
   FROM e) WHERE k = 1),
cnt AS (SELECT run_id, count(*) AS edits FROM e GROUP BY run_id)
SELECT r.id AS run_id, coalesce(a.rn, {Q.run_label('r.run_number', 'r.batch_number', 'r.id')}) AS run_number,
  coalesce(a.rn, {Q.run_label('r.run_number', 'r.batch_number', 'r.id')}) AS batch_number, b.pn AS product_name,
  {Q.clean('b.notes')} AS notes, {Q.clean('b.final_edit_initials')} AS final_edit_initials, {Q.clean('b.final_edit_notes')} AS final_edit_notes,
  b.edited_at AS updated_at, c.edits
FROM fx_runs r JOIN cnt c ON c.run_id = r.id LEFT JOIN lastrn a ON a.run_id = r.id LEFT JOIN lastpn b ON b.run_id = r.id""")
def q_edit_run_headers(spark, t, sf_dir):
    """O-STATE-10: run headers after a log of edits."""
    return LC.edit_run_headers(t.runs, fixture(spark, sf_dir, "fx_run_edits"))


_CREATE_SQL = f"""WITH req AS (SELECT request_id, {Q.clean('run_label')} AS label, lower({Q.clean('run_label')}) AS key, requested_at
   FROM fx_run_requests WHERE {Q.clean('run_label')} <> ''),
o AS (SELECT lower({Q.run_label()}) AS key, id, updated_at FROM fx_runs WHERE status = 'Open'),
ex AS (SELECT key, id AS existing_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY updated_at DESC NULLS LAST, id DESC) AS k
   FROM o WHERE key IN (SELECT key FROM req)) WHERE k = 1),
r AS (SELECT q.*, ex.existing_id FROM req q LEFT JOIN ex ON ex.key = q.key),
fr AS (SELECT key, request_id AS creating_request, requested_at FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY requested_at, request_id) AS k
   FROM r WHERE existing_id IS NULL) WHERE k = 1),
fresh AS (SELECT key, creating_request, CAST((SELECT max(id) FROM fx_runs) + row_number() OVER (ORDER BY requested_at, creating_request) AS BIGINT) AS new_id FROM fr)"""


@query("create_or_reuse_runs", _CREATE_SQL + """
SELECT r.request_id, r.label, CASE WHEN r.existing_id IS NOT NULL THEN 'reuse' WHEN r.request_id = f.creating_request THEN 'create' ELSE 'reuse' END AS action,
  coalesce(r.existing_id, f.new_id) AS run_id FROM r LEFT JOIN fresh f ON f.key = r.key""")
def q_create_or_reuse_runs(spark, t, sf_dir):
    """O-STATE-11 + O-STATE-6: create requests resolved to reused or new run ids."""
    return LC.create_or_reuse_runs(t.runs, fixture(spark, sf_dir, "fx_run_requests"), LC.max_id(t.runs))


@query("created_runs", _CREATE_SQL + f"""
SELECT f.new_id AS id, r.label AS batch_number, r.label AS run_number, 'standard' AS batch_type, 0 AS reused_batch,
  {Q.clean('q.product_name')} AS product_name, '' AS operator_id, '' AS split_batch_number, '' AS blend_number, '' AS shift_name,
  '' AS notes, 'Open' AS status, r.requested_at AS created_at, r.requested_at AS updated_at
FROM fresh f JOIN r ON r.request_id = f.creating_request JOIN fx_run_requests q ON q.request_id = r.request_id""")
def q_created_runs(spark, t, sf_dir):
    """O-STATE-11: header rows of the runs that the create requests made."""
    req = fixture(spark, sf_dir, "fx_run_requests")
    return LC.created_runs(req, LC.create_or_reuse_runs(t.runs, req, LC.max_id(t.runs)))


# ----------------------------------------------------------------- latest

@query("latest_extraction", """SELECT run_id, id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY id DESC) AS k
 FROM fx_extraction WHERE run_id IS NOT NULL) WHERE k = 1""")
def q_latest_extraction(spark, t, sf_dir):
    """O-WIN-1: newest extraction entry per run (highest id, T18)."""
    return LT.latest_by(t.extraction, ["run_id"], columns=["id", "created_at"])


@query("latest_filtration_rows", """WITH h AS (SELECT run_id, id FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY id DESC) AS k
 FROM fx_filtration WHERE run_id IS NOT NULL) WHERE k = 1)
SELECT r.filtration_entry_id, r.id, r.row_group, CAST(r.row_no AS INTEGER) AS row_no FROM fx_filtration_rows r WHERE r.filtration_entry_id IN (SELECT id FROM h)""")
def q_latest_filtration_rows(spark, t, sf_dir):
    """O-WIN-2: child rows of each run's newest filtration entry, in (group, row) order."""
    _head, kids = LT.latest_filtration(t.filtration, t.filtration_rows)
    return kids.select("filtration_entry_id", "id", "row_group", "row_no")


@query("latest_sheet_per_stage", f"WITH {_LATEST_SHEET} SELECT run_id, stage_key, id, completion_status FROM ls")
def q_latest_sheet(spark, t, sf_dir):
    """O-WIN-3: newest sheet per (run, stage)."""
    return LT.latest_sheet_per_stage(t.sheets).select("run_id", "stage_key", "id", "completion_status")


@query("latest_drafts", """SELECT 'filtration' AS kind, '' AS stage_key, max(id) AS id FROM fx_filtration
 WHERE coalesce(completion_status, 'Complete') = 'Draft'
UNION ALL SELECT 'standalone', stage_key, max(id) FROM fx_sheets WHERE run_id IS NULL
 AND coalesce(completion_status, 'Complete') = 'Draft' GROUP BY stage_key""")
def q_latest_drafts(spark, t, sf_dir):
    """O-WIN-4: newest filtration draft overall and newest standalone draft per stage."""
    f = LT.latest_filtration_draft(t.filtration).select(F.lit("filtration").alias("kind"), F.lit("").alias("stage_key"), "id")
    s = LT.latest_standalone_drafts(t.sheets).select(F.lit("standalone").alias("kind"), "stage_key", "id")
    return f.unionByName(s)


_PACKET_SQL = f"""WITH {VOID_CTE},
{_LATEST_SHEET},
le AS (SELECT run_id, id FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY id DESC) AS k FROM fx_extraction WHERE run_id IS NOT NULL) WHERE k = 1),
lf AS (SELECT run_id, id, completion_status FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY id DESC) AS k FROM fx_filtration WHERE run_id IS NOT NULL) WHERE k = 1),
saved AS (SELECT ls.run_id, ls.stage_key, ls.id, coalesce(nullif(ls.completion_status, ''), 'Complete') AS st FROM ls
   LEFT JOIN vs ON vs.run_id = ls.run_id AND vs.stage_key = ls.stage_key
   WHERE NOT (vs.run_id IS NOT NULL AND coalesce(nullif(ls.completion_status, ''), 'Complete') <> 'Complete')),
parts AS (
  SELECT run_id, 'extraction' AS part, '' AS stage_key, id AS entry_id, 'Complete' AS completion_status, CAST(NULL AS VARCHAR) AS voided_by FROM le
  UNION ALL SELECT run_id, 'filtration', '', id, coalesce(nullif(completion_status, ''), 'Complete'), NULL FROM lf
  UNION ALL SELECT run_id, 'sheet', stage_key, id, st, NULL FROM saved
  UNION ALL SELECT v.run_id, 'voided', v.stage_key, NULL, NULL, v.voided_by FROM vs v
    WHERE v.stage_key IN ({_RUN_STAGES}) AND NOT EXISTS (SELECT 1 FROM saved s WHERE s.run_id = v.run_id AND s.stage_key = v.stage_key))
SELECT p.* FROM parts p WHERE p.run_id IN (SELECT id FROM fx_runs)"""


def _packets(spark, t, sf_dir):
    voided = LC.void_state(fixture(spark, sf_dir, "fx_void_log"), True)
    return LT.run_packets(t.runs, t.extraction, t.filtration, t.sheets, voided)


@query("run_packets", _PACKET_SQL)
def q_run_packets(spark, t, sf_dir):
    """O-JOIN-8 + O-JOIN-10 (T17): flat review packets of every run in one job."""
    return _packets(spark, t, sf_dir)


_SHOWN_SQL = f"""WITH {VOID_CTE},
{_LATEST_SHEET},
shown AS (SELECT ls.*, coalesce(nullif(ls.completion_status, ''), 'Complete') AS st FROM ls
   LEFT JOIN vs ON vs.run_id = ls.run_id AND vs.stage_key = ls.stage_key
   WHERE vs.run_id IS NULL OR coalesce(nullif(ls.completion_status, ''), 'Complete') = 'Complete')"""


def _shown(spark, t, sf_dir):
    return LT.packet_sheets(t.sheets, LC.void_state(fixture(spark, sf_dir, "fx_void_log"), True))


_TITLES_SQL = "CASE stage_key " + " ".join(
    "WHEN '{}' THEN '{}'".format(k, v.replace("'", "''")) for k, v in stage_titles().items()) + " ELSE stage_key END"


@query("packet_sheets", f"""{_SHOWN_SQL}
SELECT run_id, stage_key, {_TITLES_SQL} AS stage_title, id AS entry_id, employee, operator_initials, entry_date, comments,
  st AS completion_status, created_at FROM shown""")
def q_packet_sheets(spark, t, sf_dir):
    """O-JOIN-8: the sheets of every packet with their header content."""
    return _shown(spark, t, sf_dir).drop("payload_json", "version_no")


@query("packet_cells", f"""{_SHOWN_SQL},
e AS (SELECT run_id, stage_key, id AS entry_id, unnest(map_entries({Q.payload_map()})) AS e FROM shown)
SELECT run_id, stage_key, entry_id, e.key AS key, e.value AS value FROM e""")
def q_packet_cells(spark, t, sf_dir):
    """O-JOIN-8 + O-SNK-5: every payload field of the packets' sheets, one row each."""
    return LT.packet_cells(_shown(spark, t, sf_dir))


@query("packet_voided", f"""{_SHOWN_SQL}
SELECT run_id, stage_key, {_TITLES_SQL} AS stage_title, voided_by, voided_at FROM vs
WHERE stage_key IN ({_RUN_STAGES}) AND NOT EXISTS (SELECT 1 FROM shown s WHERE s.run_id = vs.run_id AND s.stage_key = vs.stage_key)""")
def q_packet_voided(spark, t, sf_dir):
    """O-JOIN-10: the voided stages of every packet with title, author and time."""
    return LT.packet_voided(LC.void_state(fixture(spark, sf_dir, "fx_void_log"), True), _shown(spark, t, sf_dir))


@query("packet_rows", f"""WITH {_latest_entry_sql('fx_filtration')}
SELECT le.run_id, x.filtration_entry_id, x.id, x.row_group, CAST(x.row_no AS INTEGER) AS row_no, x.row_time, x.fic1_gpm, x.perm_total,
  x.retentate_ri FROM fx_filtration_rows x JOIN le ON le.id = x.filtration_entry_id""")
def q_packet_rows(spark, t, sf_dir):
    """O-JOIN-8 + O-SNK-5: filtration rows of every packet, one flat row each."""
    return LT.packet_rows(t.filtration, t.filtration_rows).select(
        "run_id", "filtration_entry_id", "id", "row_group", "row_no", "row_time", "fic1_gpm", "perm_total", "retentate_ri")


@query("review_flags", f"""WITH pk AS ({_PACKET_SQL})
SELECT run_id, TRUE AS has_entries, bool_or(part = 'sheet' AND completion_status = 'Complete') AS has_complete_entries
FROM pk GROUP BY run_id""")
def q_review_flags(spark, t, sf_dir):
    """O-AGG-12: has_entries / has_complete_entries per run."""
    return LT.review_flags(_packets(spark, t, sf_dir))


@query("stage_checklist", f"""WITH {VOID_CTE},
done AS (SELECT DISTINCT run_id, stage_key FROM fx_sheets WHERE run_id IS NOT NULL AND coalesce(completion_status, 'Complete') = 'Complete'),
anyd AS (SELECT DISTINCT run_id FROM done),
g AS (SELECT r.id AS run_id, unnest([{', '.join(f"'{k}'" for k in RUN_LINKED_STAGES)}]) AS stage_key FROM fx_runs r)
SELECT g.run_id, g.stage_key, d.run_id IS NOT NULL AS done, (v.run_id IS NOT NULL AND d.run_id IS NULL) AS voided,
  a.run_id IS NOT NULL AS can_finish
FROM g LEFT JOIN done d ON d.run_id = g.run_id AND d.stage_key = g.stage_key
LEFT JOIN (SELECT DISTINCT run_id, stage_key FROM vs) v ON v.run_id = g.run_id AND v.stage_key = g.stage_key
LEFT JOIN anyd a ON a.run_id = g.run_id""")
def q_stage_checklist(spark, t, sf_dir):
    """O-JOIN-9: run x linked stage checklist (literal stage array exploded, no cross join)."""
    voided = LC.void_state(fixture(spark, sf_dir, "fx_void_log"), True)
    return stage_checklist(t.runs, t.sheets, voided, RUN_LINKED_STAGES)

"""Registered queries: scalar rules (O-SCL-*) applied over whole fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from batchtrail.functions import labels as LB
from batchtrail.functions import text as TX
from batchtrail.functions import time as TM
from batchtrail.operators.sequence import unique_names
from batchtrail.plans import sqltext as Q
from batchtrail.plans.registry import query
from batchtrail.sources.fixtures import AS_OF, fixture
from batchtrail.sources.tables import parse_payload


def _entries(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_entries")


def _wide(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_entries_wide")


@query("clean_value", f"SELECT record_id, {Q.clean('comments')} AS comments_clean, "
                      f"{Q.clean('comments')} = '' AS is_blank FROM fx_entries")
def q_clean_value(spark, t, sf_dir):
    """O-SCL-1/2: trimmed text (NULL -> '') and the blank test."""
    e = _entries(spark, sf_dir)
    return e.select("record_id", TX.clean("comments").alias("comments_clean"), TX.is_blank("comments").alias("is_blank"))


def _stamp_sql(as_of_date: str | None) -> str:
    d = Q.nonblank("entry_date")
    if as_of_date:
        d = f"coalesce({d}, '{as_of_date}')"
    stamp = f"concat_ws(' | ', {d}, nullif(upper({Q.clean('operator_initials')}), ''))"
    return f"CASE WHEN {Q.clean('comments')} = '' THEN {stamp} ELSE {Q.clean('comments')} END"


@query("blank_stamp", f"SELECT record_id, {_stamp_sql(None)} AS shown, {_stamp_sql(AS_OF[:10])} AS shown_as_of "
                      "FROM fx_entries")
def q_blank_stamp(spark, t, sf_dir):
    """O-SCL-3: value, else ``date | INITIALS`` (template form and dated form)."""
    e = _entries(spark, sf_dir)
    return e.select("record_id",
                    LB.blank_stamp_display("comments", "entry_date", "operator_initials").alias("shown"),
                    LB.blank_stamp_display("comments", "entry_date", "operator_initials", AS_OF[:10]).alias("shown_as_of"))


@query("run_label", f"""SELECT id, {Q.run_label()} AS run_label,
 coalesce({Q.nonblank('run_number')}, {Q.nonblank('batch_number')}, '') AS run_number_n,
 coalesce({Q.nonblank('batch_number')}, {Q.nonblank('run_number')}, '') AS batch_number_n,
 coalesce(nullif(trim(batch_type), ''), 'standard') AS batch_type_n,
 CASE WHEN lower({Q.clean('batch_type')}) = 'blend' THEN 'blends' WHEN lower({Q.clean('batch_type')}) = 'split' THEN 'splits' ELSE 'runs' END AS section
FROM fx_runs""")
def q_run_label(spark, t, sf_dir):
    """O-SCL-4/5/12/14: display label, defaulted ids, batch type, admin section."""
    rn, bn = LB.normalized_run_ids()
    return t.runs.select("id", LB.run_label().alias("run_label"), rn.alias("run_number_n"), bn.alias("batch_number_n"),
                         LB.normalize_batch_type().alias("batch_type_n"), LB.section_for_run().alias("section"))


@query("parse_numeric_reading", f"""SELECT id, {Q.parse_num('fic1_gpm')} AS fic1, {Q.parse_num('perm_total')} AS perm_total,
 {Q.parse_num('retentate_ri')} AS retentate FROM fx_filtration_rows""")
def q_parse_numeric(spark, t, sf_dir):
    """O-SCL-6 (T13): first signed decimal after removing commas."""
    r = t.filtration_rows
    return r.select("id", TX.parse_numeric("fic1_gpm").alias("fic1"), TX.parse_numeric("perm_total").alias("perm_total"),
                    TX.parse_numeric("retentate_ri").alias("retentate"))


@query("point_time", f"""SELECT record_id, {Q.point_time('entry_date', 'entry_time', 'created_at')} AS point_time,
 {Q.eff_date()} AS effective_date FROM fx_entries""")
def q_point_time(spark, t, sf_dir):
    """O-SCL-7/8: chart timestamp and effective date (NULL-only fallback, T1)."""
    e = _entries(spark, sf_dir)
    return e.select("record_id", TM.point_time("entry_date", "entry_time", "created_at").alias("point_time"),
                    TM.effective_date().alias("effective_date"))


_MACHINES = "'extraction','filtration','evaporation','clarifier','concentration','reconcentration','h2o2_koh_decolorizing','h2o2_calcium_decolorizing','centrifuge','anion_exchange','resistaid_anion_exchange','carbon_treatment'"


@query("entry_classification", f"""SELECT record_id,
 CASE WHEN lower({Q.clean('section')}) IN ({_MACHINES}) THEN lower({Q.clean('section')}) ELSE 'extraction' END AS machine_key,
 coalesce(nullif(completion_status, ''), 'Complete') AS status_py,
 coalesce(completion_status, 'Complete') AS status_sql,
 coalesce(nullif(stage_title, ''), nullif(section, ''), CASE entry_table WHEN 'extraction_entries' THEN 'Extraction'
   WHEN 'filtration_entries' THEN 'Filtration' WHEN 'evaporation_entries' THEN 'Evaporation' WHEN 'sheet_entries' THEN 'Run Sheet'
   WHEN 'production_runs' THEN 'Run' END, {Q.title("replace(entry_table, '_', ' ')")}) AS sheet_name,
 {Q.clean("concat_ws(' ', " + Q.nonblank('entry_date') + ", " + Q.nonblank('entry_time') + ")")} AS captured_at
FROM fx_entries_wide""")
def q_entry_classification(spark, t, sf_dir):
    """O-SCL-10/11/13/18: machine key, both status rules (T2), sheet name, capture time."""
    e = _wide(spark, sf_dir)
    return e.select("record_id", LB.machine_key("section").alias("machine_key"),
                    LB.completion_status_py().alias("status_py"), LB.completion_status_sql().alias("status_sql"),
                    LB.display_sheet_name("entry_table", "section", "stage_title").alias("sheet_name"),
                    LB.captured_at("entry_date", "entry_time").alias("captured_at"))


@query("user_identity", f"""SELECT id, coalesce(nullif(initials, ''), upper(substr(employee_number, 1, 2))) AS user_initials,
 CASE WHEN active = 0 THEN 'pending' ELSE 'active' END AS state FROM fx_users""")
def q_user_identity(spark, t, sf_dir):
    """O-SCL-24: stored initials, else first two letters of the employee number."""
    u = t.users
    return u.select("id", LB.user_initials().alias("user_initials"),
                    F.when(F.col("active") == 0, "pending").otherwise("active").alias("state"))


def _comment_label_sql(x: str) -> str:
    stem = rf"regexp_replace(regexp_replace(lower({Q.clean(x)}), '_?comments?$', ''), '^_+|_+$', '', 'g')"
    return f"CASE WHEN {stem} = '' THEN 'Comments' ELSE {Q.title(f'regexp_replace({stem}, {chr(39)}_+{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')} END"


@query("comment_label", f"""WITH s AS (SELECT id, {Q.payload_map()} AS m FROM fx_sheets),
k AS (SELECT id, unnest(map_keys(m)) AS key FROM s)
SELECT id, key, {_comment_label_sql('key')} AS label FROM k WHERE strpos(lower({Q.clean('key')}), 'comment') > 0""")
def q_comment_label(spark, t, sf_dir):
    """O-SCL-19: readable labels of the payload's comment keys."""
    s = t.sheets.select("id", F.explode(F.map_keys(parse_payload())).alias("key"))
    return (s.filter(F.lower(TX.clean("key")).contains("comment"))
            .select("id", "key", TX.comment_label("key").alias("label")))


@query("photo_refs", f"""WITH a AS (SELECT record_id,
  list_filter(list_transform(string_split_regex({Q.clean('photo_path')}, '[\\r\\n,]+'), lambda p: CASE WHEN starts_with({Q.clean('p')}, 'static/uploads/') THEN '/' || {Q.clean('p')} ELSE {Q.clean('p')} END),
              lambda p: starts_with(p, '/static/uploads/')) AS refs FROM fx_entries_wide),
u AS (SELECT record_id, unnest(refs) AS ref, generate_subscripts(refs, 1) AS pos FROM a),
f AS (SELECT record_id, ref, min(pos) AS first_pos FROM u GROUP BY record_id, ref)
SELECT record_id, string_agg(ref, chr(10) ORDER BY first_pos) AS refs, CAST(count(*) AS INTEGER) AS n_refs FROM f GROUP BY record_id""")
def q_photo_refs(spark, t, sf_dir):
    """O-SCL-20: upload references in order, distinct, rooted at ``/``."""
    e = _wide(spark, sf_dir).select("record_id", TX.photo_refs("photo_path").alias("r"))
    return (e.filter(F.size("r") > 0)
            .select("record_id", F.array_join("r", "\n").alias("refs"), F.size("r").alias("n_refs")))


def _safe_sql(x: str, fallback: str) -> str:
    c = rf"regexp_replace(regexp_replace({Q.clean(x)}, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g')"
    return f"substr(coalesce(nullif({c}, ''), '{fallback}'), 1, 90)"


_DATE_PREFIX_SQL = ("coalesce(substr(" + Q.nonblank("created_at") + ", 1, 10), substr(" + Q.nonblank("updated_at")
                    + ", 1, 10), 'undated')")


@query("export_names", f"""WITH r AS (SELECT id, {Q.run_label()} AS label, {_DATE_PREFIX_SQL} AS date_prefix FROM fx_runs)
SELECT id, date_prefix, CASE WHEN length(date_prefix) >= 7 THEN substr(date_prefix, 1, 7) ELSE 'undated' END AS export_month,
 date_prefix || '_Run_' || {_safe_sql('label', 'run')} || '_id-' || CAST(id AS VARCHAR) || '.json' AS file_name,
 {_safe_sql('label', 'run')} AS safe_label FROM r""")
def q_export_names(spark, t, sf_dir):
    """O-SCL-21/22/23: safe file name, date prefix, month folder, export file name."""
    r = t.runs
    prefix = TM.date_prefix("created_at", "updated_at")
    label = LB.run_label()
    return r.select("id", prefix.alias("date_prefix"), TM.month_folder(prefix).alias("export_month"),
                    LB.export_filename(prefix, label, "id").alias("file_name"),
                    TX.safe_filename(label, "run").alias("safe_label"))


def _unique_sql(source: str) -> str:
    """Names of ``source(id, base)``: the k-th later holder takes the k-th number that no row holds."""
    return f"""WITH r AS ({source}),
n AS (SELECT id, base, row_number() OVER (PARTITION BY base ORDER BY id) AS k, regexp_extract(base, '^.+([.][^.]+)$', 1) AS ext FROM r),
parts AS (SELECT *, substr(base, 1, length(base) - length(ext)) AS stem FROM n),
c AS (SELECT base, stem, ext, count(*) AS holders FROM parts GROUP BY ALL),
cand AS (SELECT c.*, unnest(range(2, 2 * holders + 1002)) AS no FROM c WHERE holders > 1),
free AS (SELECT base, no, row_number() OVER (PARTITION BY base ORDER BY no) AS k FROM cand
   WHERE stem || '-' || CAST(no AS VARCHAR) || ext NOT IN (SELECT base FROM r WHERE base IS NOT NULL))
SELECT p.id, p.base, CASE WHEN p.k = 1 THEN p.base ELSE p.stem || '-' || CAST(f.no AS VARCHAR) || p.ext END AS unique_name
FROM parts p LEFT JOIN free f ON f.base = p.base AND f.k = p.k - 1"""


@query("unique_name", _unique_sql(f"SELECT id, {_safe_sql(Q.run_label(), 'run')} AS base FROM fx_runs"))
def q_unique_name(spark, t, sf_dir):
    """O-SCL-29: numbered ``-2``, ``-3`` suffixes for names already taken (hot names split)."""
    r = t.runs.select("id", TX.safe_filename(LB.run_label(), "run").alias("base"))
    return unique_names(r, "base", "id").select("id", "base", "unique_name")


@query("unique_file_name", _unique_sql("""SELECT id, concat('E', employee, CASE WHEN id % 40 < 8 THEN '-' || CAST(id % 40 AS VARCHAR) ELSE '' END,
   CASE WHEN id % 3 = 0 THEN '.html' ELSE '' END) AS base FROM fx_extraction"""))
def q_unique_file_name(spark, t, sf_dir):
    """O-SCL-29 where numbered names are already held and the number goes before the extension."""
    number = F.when(F.col("id") % 40 < 8, F.concat(F.lit("-"), (F.col("id") % 40).cast("string"))).otherwise("")
    base = F.concat(F.lit("E"), F.coalesce("employee", F.lit("")), number, F.when(F.col("id") % 3 == 0, ".html").otherwise(""))
    return unique_names(t.extraction.select("id", base.alias("base")), "base", "id").select("id", "base", "unique_name")


@query("scope_label", """SELECT s.scope, coalesce(m.label, 'All Runs') AS label, count(*) AS runs
FROM (SELECT CASE id % 10 WHEN 0 THEN 'today' WHEN 1 THEN 'last_week' WHEN 2 THEN 'since_last' WHEN 3 THEN 'bogus'
        WHEN 4 THEN ' filtration ' ELSE 'all' END AS scope FROM fx_runs) s
LEFT JOIN (VALUES ('all','All Runs'),('today','Today'),('last_week','Last 7 Days'),('current_month','Current Month'),
 ('since_last','Since Last Export'),('extraction','Runs With Extraction'),('filtration','Runs With Filtration'),
 ('clarifier','Runs With Clarifier')) m(k, label) ON m.k = trim(s.scope)
GROUP BY s.scope, m.label""")
def q_scope_label(spark, t, sf_dir):
    """O-SCL-30: scope key -> label, unknown -> All Runs (scopes requested per run)."""
    scope = (F.when(F.col("id") % 10 == 0, "today").when(F.col("id") % 10 == 1, "last_week")
             .when(F.col("id") % 10 == 2, "since_last").when(F.col("id") % 10 == 3, "bogus")
             .when(F.col("id") % 10 == 4, " filtration ").otherwise("all"))
    s = t.runs.select(scope.alias("scope"))
    return s.groupBy("scope").agg(F.count(F.lit(1)).alias("runs")).select(
        "scope", LB.scope_label("scope").alias("label"), "runs")

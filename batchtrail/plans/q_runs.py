"""Registered queries: run listings, searches, paging, counts, labels, lineage."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchtrail.functions.labels import run_label
from batchtrail.operators import paging as PG
from batchtrail.operators import postings as PO
from batchtrail.operators import runs as RU
from batchtrail.plans import sqltext as Q
from batchtrail.plans.registry import query
from batchtrail.session import scratch_table_path
from batchtrail.sources.fixtures import fixture

RUNS_AS_OF = "1998-03-15T12:00:00"
EXPORT_MARK = "2000-06-01T00:00:00"
SEARCH = "r1"

_STAGE_COUNT_SQL = """sc AS (
  SELECT run_id, sum(n) AS stage_count FROM (
    SELECT run_id, count(*) AS n FROM (SELECT DISTINCT run_id, stage_key FROM fx_sheets
      WHERE run_id IS NOT NULL AND coalesce(completion_status, 'Complete') = 'Complete') GROUP BY run_id
    UNION ALL SELECT DISTINCT run_id, 1 FROM fx_extraction WHERE run_id IS NOT NULL
    UNION ALL SELECT DISTINCT run_id, 1 FROM fx_filtration WHERE run_id IS NOT NULL) GROUP BY run_id)"""

_SEARCH_WHERE = (f"coalesce(run_number ILIKE '%{SEARCH}%' OR batch_number ILIKE '%{SEARCH}%' "
                 f"OR product_name ILIKE '%{SEARCH}%', FALSE) AND coalesce(nullif(trim(batch_type), ''), 'standard') = 'standard'")


@query("runs_by_status", "SELECT id, run_number, status, updated_at FROM fx_runs WHERE status = 'Open'")
def q_runs_by_status(spark, t, sf_dir):
    """O-FLT-1: open runs."""
    return RU.runs_by_status(t.runs, "Open").select("id", "run_number", "status", "updated_at")


@query("runs_search", f"""WITH {_STAGE_COUNT_SQL}
SELECT r.id, r.run_number, r.batch_number, r.product_name, CAST(coalesce(sc.stage_count, 0) AS BIGINT) AS stage_count
FROM fx_runs r LEFT JOIN sc ON sc.run_id = r.id WHERE {_SEARCH_WHERE}""")
def q_runs_search(spark, t, sf_dir):
    """O-FLT-2 + O-JOIN-6/11 + O-AGG-3/4: search (ILIKE, T3/T4) with decorrelated stage count."""
    m = RU.runs_search(t.runs, SEARCH, "all", "standard")
    counts = RU.stage_counts(t.sheets, t.extraction, t.filtration)
    return RU.with_stage_count(m, counts).select("id", "run_number", "batch_number", "product_name", "stage_count")


@query("runs_page", f"""WITH {_STAGE_COUNT_SQL},
m AS (SELECT * FROM fx_runs WHERE {_SEARCH_WHERE} ORDER BY updated_at DESC, id DESC LIMIT 25 OFFSET 25)
SELECT m.id, m.run_number, m.updated_at, CAST(coalesce(sc.stage_count, 0) AS BIGINT) AS stage_count
FROM m LEFT JOIN sc ON sc.run_id = m.id""")
def q_runs_page(spark, t, sf_dir):
    """O-SRT-3: page 2 (25 per page) of the search, newest first, id tie-break."""
    page = RU.runs_page(RU.runs_search(t.runs, SEARCH, "all", "standard"), 2, 25)
    counts = RU.stage_counts(t.sheets, t.extraction, t.filtration)
    return RU.with_stage_count(page, counts).select("id", "run_number", "updated_at", "stage_count")


@query("runs_deep_pages", f"""WITH m AS (SELECT id, run_number, updated_at, row_number() OVER (ORDER BY updated_at DESC NULLS LAST, id DESC) AS position FROM fx_runs WHERE {_SEARCH_WHERE})
SELECT id, run_number, updated_at, position FROM m
WHERE (position - 1) // 25 IN (0, 6, (SELECT (max(position) - 1) // 25 FROM m))""")
def q_runs_deep_pages(spark, t, sf_dir):
    """O-SRT-3: first, seventh and last page of the search, read from the numbered listing."""
    numbered = PG.positions(RU.runs_search(t.runs, SEARCH, "all", "standard").select("id", "run_number", "updated_at"), RU.newest_first())
    pages = sorted({1, 7, PG.last_page(numbered, 25)})
    return reduce(DataFrame.unionByName, [PG.page_of(numbered, p, 25) for p in pages])


_INDEXED = ["run_number", "batch_number", "product_name"]


@query("runs_search_indexed", " UNION ALL ".join(
    f"SELECT '{name}' AS search, id, run_number, batch_number, product_name FROM fx_runs "
    f"WHERE coalesce(run_number ILIKE '%{text}%' OR batch_number ILIKE '%{text}%' OR product_name ILIKE '%{text}%', FALSE)"
    for name, text in (("digits", "r12"), ("word", "URGent"), ("wildcard", "b1_5"), ("two", "99"), ("none", "no such text"))))
def q_runs_search_indexed(spark, t, sf_dir):
    """O-FLT-2: searches over the trigram index of the runs' texts: equal to the scan, also for short texts and wildcards."""
    path = scratch_table_path(spark, f"run-postings-{uuid.uuid4().hex}")
    PO.build(t.runs, "id", _INDEXED, path)
    return reduce(DataFrame.unionByName, [PO.find(spark, path, _INDEXED, text).withColumn("search", F.lit(name)) for name, text in (
        ("digits", "r12"), ("word", "URGent"), ("wildcard", "b1_5"), ("two", "99"), ("none", "no such text"))])


@query("search_total", f"""SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 25.0)) AS BIGINT) AS pages
FROM fx_runs WHERE {_SEARCH_WHERE}""")
def q_search_total(spark, t, sf_dir):
    """O-AGG-9: total matches and page count."""
    return RU.search_total(RU.runs_search(t.runs, SEARCH, "all", "standard"), 25)


@query("runs_by_ids", f"""SELECT id, {Q.run_label()} AS run_label, updated_at FROM fx_runs
WHERE id IN (SELECT source_run_id FROM fx_group_requests WHERE source_run_id > 0)""")
def q_runs_by_ids(spark, t, sf_dir):
    """O-FLT-3: runs named by request rows (semi join on the id column)."""
    req = fixture(spark, sf_dir, "fx_group_requests")
    return RU.runs_by_ids(t.runs, req, "source_run_id").select("id", run_label().alias("run_label"), "updated_at")


@query("resolve_labels", f"""WITH w AS (SELECT DISTINCT {Q.clean('run_label')} AS label FROM fx_run_requests WHERE {Q.clean('run_label')} <> ''),
c AS (SELECT w.label, r.id, r.run_number, r.batch_number, r.status, r.updated_at FROM w JOIN fx_runs r
      ON r.run_number = w.label OR r.batch_number = w.label),
k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY (status = 'Open') DESC, updated_at DESC NULLS LAST, id DESC) AS rn FROM c)
SELECT label, id, run_number, batch_number, status, updated_at FROM k WHERE rn = 1""")
def q_resolve_labels(spark, t, sf_dir):
    """O-FLT-4 + O-WIN-5: best run per requested label (Open first, newest)."""
    req = fixture(spark, sf_dir, "fx_run_requests")
    return RU.resolve_labels(t.runs, req, "run_label")


@query("open_run_by_label", f"""WITH w AS (SELECT DISTINCT lower({Q.clean('run_label')}) AS key FROM fx_run_requests),
o AS (SELECT id, updated_at, {Q.run_label()} AS run_label, lower({Q.run_label()}) AS key FROM fx_runs WHERE status = 'Open'),
k AS (SELECT o.*, row_number() OVER (PARTITION BY o.key ORDER BY updated_at DESC NULLS LAST, id DESC) AS rn
      FROM o WHERE o.key IN (SELECT key FROM w WHERE key <> ''))
SELECT key, id, run_label, updated_at FROM k WHERE rn = 1""")
def q_open_run_by_label(spark, t, sf_dir):
    """O-FLT-5: reuse of an open run by display label, case-insensitive (T23)."""
    req = fixture(spark, sf_dir, "fx_run_requests")
    return RU.open_runs_by_display_label(t.runs, req, "run_label")


@query("recent_runs", "SELECT id, run_number, updated_at FROM fx_runs ORDER BY updated_at DESC, id DESC LIMIT 50")
def q_recent_runs(spark, t, sf_dir):
    """O-SRT-1: 50 most recently updated runs (top-k report)."""
    return t.runs.orderBy(*RU.newest_first()).limit(50).select("id", "run_number", "updated_at")


@query("recent_open_runs", "SELECT id, run_number, updated_at FROM fx_runs WHERE status = 'Open' "
                           "ORDER BY updated_at DESC, id DESC LIMIT 50")
def q_recent_open_runs(spark, t, sf_dir):
    """O-SRT-2: 50 most recently updated open runs."""
    return (RU.runs_by_status(t.runs, "Open").orderBy(*RU.newest_first()).limit(50)
            .select("id", "run_number", "updated_at"))


@query("run_stats", """SELECT (SELECT count(*) FROM fx_runs) AS total_runs,
 (SELECT count(*) FROM fx_runs WHERE status = 'Open') AS open_runs,
 (SELECT count(*) FROM fx_runs WHERE status <> 'Open') AS completed_runs,
 (SELECT count(*) FROM fx_users WHERE active = 0) AS pending_users,
 (SELECT count(*) FROM fx_users WHERE active = 1) AS active_users""")
def q_run_stats(spark, t, sf_dir):
    """O-AGG-1: dashboard counts in one pass."""
    return RU.run_stats(t.runs, t.users)


def _labels_sql(col: str) -> str:
    return (f"SELECT {col} AS label, max(updated_at) AS updated_at, count(*) AS run_count FROM fx_runs "
            f"WHERE trim(coalesce({col}, '')) <> '' GROUP BY {col} ORDER BY max(updated_at) DESC, label LIMIT 12")


@query("recent_blend_labels", _labels_sql("blend_number"))
def q_recent_blend_labels(spark, t, sf_dir):
    """O-AGG-2 + O-FLT-19: 12 most recently used blend labels."""
    return RU.recent_group_labels(t.runs, "blend", 12)


@query("recent_split_labels", _labels_sql("split_batch_number"))
def q_recent_split_labels(spark, t, sf_dir):
    """O-AGG-2 for split labels."""
    return RU.recent_group_labels(t.runs, "split", 12)


_LINEAGE_SQL = f"""WITH lab AS (
  SELECT id, {Q.clean('batch_type')} AS bt, {Q.run_label()} AS run_label,
         CASE WHEN {Q.nonblank('blend_number')} IS NOT NULL THEN 'blend' WHEN {Q.nonblank('split_batch_number')} IS NOT NULL THEN 'split' END AS action,
         coalesce({Q.nonblank('blend_number')}, {Q.nonblank('split_batch_number')}) AS group_label FROM fx_runs),
mem AS (
  SELECT id, updated_at, {Q.clean('batch_type')} AS bt, {Q.run_label()} AS run_label, 'blend' AS action, blend_number AS group_label
  FROM fx_runs WHERE trim(coalesce(blend_number, '')) <> ''
  UNION ALL
  SELECT id, updated_at, {Q.clean('batch_type')}, {Q.run_label()}, 'split', split_batch_number
  FROM fx_runs WHERE trim(coalesce(split_batch_number, '')) <> ''),
der AS (SELECT action, group_label, id AS derived_run_id, run_label AS derived_run_label FROM (
  SELECT *, row_number() OVER (PARTITION BY action, group_label ORDER BY updated_at DESC NULLS LAST, id DESC) AS rn
  FROM mem WHERE bt = action) WHERE rn = 1),
src AS (SELECT id, action, group_label,
  row_number() OVER (PARTITION BY action, group_label ORDER BY updated_at DESC NULLS LAST, id DESC) AS source_position,
  count(*) OVER (PARTITION BY action, group_label) AS source_count FROM mem WHERE bt <> action),
cnt AS (SELECT DISTINCT action, group_label, source_count FROM src)
SELECT l.id, l.run_label, l.action, l.group_label, CASE WHEN l.bt = l.action THEN 'derived' ELSE 'source' END AS role,
  d.derived_run_id, d.derived_run_label, CAST(coalesce(c.source_count, 0) AS BIGINT) AS source_count,
  CAST(s.source_position AS BIGINT) AS source_position,
  CASE WHEN l.bt = l.action THEN (CASE WHEN coalesce(c.source_count, 0) > 0 THEN 'Sources' ELSE 'No source runs linked' END)
       WHEN d.derived_run_id IS NOT NULL THEN upper(substr(l.action, 1, 1)) || substr(l.action, 2) || ' run: ' || d.derived_run_label
       ELSE upper(substr(l.action, 1, 1)) || substr(l.action, 2) || ' label: ' || l.group_label END AS summary
FROM lab l LEFT JOIN der d ON d.action = l.action AND d.group_label = l.group_label
LEFT JOIN cnt c ON c.action = l.action AND c.group_label = l.group_label
LEFT JOIN src s ON s.id = l.id AND s.action = l.action AND s.group_label = l.group_label
WHERE l.action IS NOT NULL"""


@query("group_lineage", _LINEAGE_SQL)
def q_group_lineage(spark, t, sf_dir):
    """O-JOIN-7 + O-SRT-9 + O-WIN-8: blend/split groups, derived run and ordered sources."""
    return RU.group_lineage(t.runs)


@query("group_members", f"""WITH m AS (SELECT id, updated_at, {Q.clean('batch_type')} AS bt, {Q.run_label()} AS run_label, 'blend' AS action, blend_number AS group_label
   FROM fx_runs WHERE trim(coalesce(blend_number, '')) <> ''
  UNION ALL SELECT id, updated_at, {Q.clean('batch_type')}, {Q.run_label()}, 'split', split_batch_number FROM fx_runs WHERE trim(coalesce(split_batch_number, '')) <> ''),
r AS (SELECT *, CASE WHEN bt = action THEN 'derived' ELSE 'source' END AS role FROM m)
SELECT action, group_label, id, run_label, role, row_number() OVER (PARTITION BY action, group_label, role ORDER BY updated_at DESC NULLS LAST, id DESC) AS position FROM r""")
def q_group_members(spark, t, sf_dir):
    """O-JOIN-7 + O-SRT-9: labels of the derived and source runs of every group, in order."""
    return RU.group_members(t.runs)


def _scope_sql(where: str) -> str:
    return f"SELECT id, created_at, updated_at FROM fx_runs WHERE {where}"


_CA, _UA = Q.clean("created_at"), Q.clean("updated_at")


@query("runs_scope_today", _scope_sql(f"starts_with({_CA}, '{RUNS_AS_OF[:10]}') OR starts_with({_UA}, '{RUNS_AS_OF[:10]}')"))
def q_scope_today(spark, t, sf_dir):
    """O-FLT-14: created or updated on the as-of day."""
    return RU.runs_in_scope(t.runs, "today", RUNS_AS_OF).select("id", "created_at", "updated_at")


@query("runs_scope_last_week", _scope_sql(f"({_CA} <> '' AND substr({_CA}, 1, 10) >= '1998-03-08') OR "
                                          f"({_UA} <> '' AND substr({_UA}, 1, 10) >= '1998-03-08')"))
def q_scope_last_week(spark, t, sf_dir):
    """O-FLT-15: date part within 7 days of as-of (up to 8 calendar days, T21)."""
    return RU.runs_in_scope(t.runs, "last_week", RUNS_AS_OF).select("id", "created_at", "updated_at")


@query("runs_scope_month", _scope_sql(f"starts_with({_CA}, '{RUNS_AS_OF[:7]}') OR starts_with({_UA}, '{RUNS_AS_OF[:7]}')"))
def q_scope_month(spark, t, sf_dir):
    """O-FLT-16: month prefix."""
    return RU.runs_in_scope(t.runs, "current_month", RUNS_AS_OF).select("id", "created_at", "updated_at")


@query("runs_scope_since_last", _scope_sql(f"({_UA} <> '' AND {_UA} > '{EXPORT_MARK}') OR ({_CA} <> '' AND {_CA} > '{EXPORT_MARK}')"))
def q_scope_since_last(spark, t, sf_dir):
    """O-FLT-17: changed strictly after the last export mark (string compare)."""
    return RU.runs_in_scope(t.runs, "since_last", RUNS_AS_OF, EXPORT_MARK).select("id", "created_at", "updated_at")


@query("runs_scope_has_stage", """SELECT 'filtration' AS scope, id FROM fx_runs WHERE id <> 0 AND id IN (SELECT run_id FROM fx_filtration)
UNION ALL SELECT 'clarifier', id FROM fx_runs WHERE id <> 0 AND id IN (SELECT run_id FROM fx_sheets WHERE stage_key = 'clarifier')""")
def q_scope_has_stage(spark, t, sf_dir):
    """O-FLT-18: runs having a filtration entry / a clarifier sheet (semi joins)."""
    f = RU.runs_in_scope(t.runs, "filtration", RUNS_AS_OF, stage_runs=t.filtration).select(F.lit("filtration").alias("scope"), "id")
    c = RU.runs_in_scope(t.runs, "clarifier", RUNS_AS_OF,
                         stage_runs=t.sheets.filter(F.col("stage_key") == "clarifier")).select(F.lit("clarifier").alias("scope"), "id")
    return f.unionByName(c)


@query("run_locked", f"""SELECT id, {Q.clean('blend_number')} <> '' AS blend_locked,
 {Q.clean('split_batch_number')} <> '' AS split_locked FROM fx_runs""")
def q_run_locked(spark, t, sf_dir):
    """O-FLT-21: runs that already carry a blend / split label."""
    return t.runs.select("id", RU.run_locked(t.runs, "blend").alias("blend_locked"),
                         RU.run_locked(t.runs, "split").alias("split_locked"))


@query("users_by_state", """SELECT id, employee_number, full_name, active, 'pending' AS listing FROM fx_users WHERE active = 0
UNION ALL SELECT id, employee_number, full_name, active, 'active' FROM fx_users WHERE active = 1""")
def q_users_by_state(spark, t, sf_dir):
    """O-FLT-20 + O-SRT-7: pending (by age) and active (by name) user listings."""
    u = t.users
    pending = F.col("active") == 0
    listed = u.filter(F.col("active").isin(0, 1))
    # pending users newest first, then active users by name: one sort of the result
    ordered = listed.orderBy("active", F.when(pending, F.col("created_at")).desc(), F.when(~pending, F.col("full_name")), "id")
    return ordered.select("id", "employee_number", "full_name", "active", F.when(pending, "pending").otherwise("active").alias("listing"))

"""Run listings, searches, counts, label resolution and lineage.

O-FLT-1..5/14..21, O-SRT-1/2/3/9, O-AGG-1..4/9/12, O-JOIN-6/7/9/11, O-WIN-5/8.
Correlated per-run subqueries of the reference become one pre-aggregation per
table joined once; per-label lookups become joins of a label table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchtrail.functions.labels import normalize_batch_type, run_label
from batchtrail.functions.text import clean, contains_pattern, nonblank
from batchtrail.operators.sequence import sequence_within
from batchtrail.sources.stages import LINEAGE_NO_SOURCES, LINEAGE_SOURCES

GROUP_COLUMNS = {"blend": "blend_number", "split": "split_batch_number"}


def newest_first(*extra: str) -> list[Column]:
    """``updated_at DESC`` with the id as tie-break (T8)."""
    return [F.col("updated_at").desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in extra], F.col("id").desc()]


# ----------------------------------------------------------------- filters

def runs_by_status(runs: DataFrame, status: str = "all") -> DataFrame:
    return runs if status == "all" else runs.filter(F.col("status") == status)


def runs_search(runs: DataFrame, search: str = "", status: str = "all", batch_type: str = "all") -> DataFrame:
    """Substring search over run, batch and product, case-insensitive like SQLite LIKE.

    Rows whose three columns are all NULL never match, even with an empty search (T4).
    """
    s = search.strip()
    like = contains_pattern(s) if s else "%"
    hit = F.col("run_number").ilike(like) | F.col("batch_number").ilike(like) | F.col("product_name").ilike(like)
    out = runs.filter(F.coalesce(hit, F.lit(False)))
    if status != "all":
        out = out.filter(F.col("status") == status)
    if batch_type != "all":
        out = out.filter(normalize_batch_type() == batch_type)
    return out


def runs_by_ids(runs: DataFrame, ids: DataFrame, id_col: str = "run_id") -> DataFrame:
    """Runs whose id is in ``ids`` (positive ids only): a semi join, never a driver list."""
    wanted = ids.select(F.col(id_col).alias("__id")).filter(F.col("__id") > 0)
    return runs.join(wanted, runs["id"] == wanted["__id"], "left_semi")


def resolve_labels(runs: DataFrame, labels: DataFrame, label_col: str = "label") -> DataFrame:
    """Best run per exact label (run or batch number): Open first, then newest (O-FLT-4, O-WIN-5).

    The reference's ``run_number = ? OR batch_number = ?`` becomes two
    equi-joins (a disjunctive join would be a nested loop), deduplicated.
    """
    want = labels.select(clean(label_col).alias("label")).filter(F.col("label") != "").distinct()
    cand = runs.select("id", "run_number", "batch_number", "status", "updated_at")
    by_run = want.join(cand, want["label"] == cand["run_number"])
    by_batch = want.join(cand, want["label"] == cand["batch_number"])
    both = by_run.unionByName(by_batch).dropDuplicates(["label", "id"])
    rank = F.struct((F.col("status") == "Open").alias("open"), F.col("updated_at"), F.col("id"))
    return (both.groupBy("label")
            .agg(F.max_by(F.struct("id", "run_number", "batch_number", "status", "updated_at"), rank).alias("r"))
            .select("label", "r.*"))


def open_runs_by_display_label(runs: DataFrame, labels: DataFrame, label_col: str = "label") -> DataFrame:
    """Newest open run whose display label equals the label, ignoring case (O-FLT-5).

    The reference only looks at the 200 most recent open runs; every open run
    is a candidate here (no cap on candidates).
    """
    want = labels.select(F.lower(clean(label_col)).alias("key")).filter(F.col("key") != "").distinct()
    open_runs = runs.filter(F.col("status") == "Open").select(
        "id", "updated_at", F.lower(run_label()).alias("key"), run_label().alias("run_label"))
    best = (open_runs.join(want, "key", "left_semi").groupBy("key")
            .agg(F.max_by(F.struct("id", "run_label", "updated_at"), F.struct("updated_at", "id")).alias("r")))
    return best.select("key", "r.*")


def _day_prefix(c: str) -> Column:
    return F.substring(clean(c), 1, 10)


def runs_in_scope(runs: DataFrame, scope: str, as_of: str, mark: str = "", stage_runs: DataFrame | None = None) -> DataFrame:
    """Export scopes (O-FLT-14..18); ``as_of`` replaces the clock (T21)."""
    scope = (scope or "").strip()
    ca, ua = clean("created_at"), clean("updated_at")
    if scope == "today":
        day = as_of[:10]
        return runs.filter(ca.startswith(day) | ua.startswith(day))
    if scope == "last_week":
        from batchtrail.functions.time import minus_days
        cutoff = minus_days(as_of, 7)
        return runs.filter(((ca != "") & (_day_prefix("created_at") >= cutoff))
                           | ((ua != "") & (_day_prefix("updated_at") >= cutoff)))
    if scope == "current_month":
        month = as_of[:7]
        return runs.filter(ca.startswith(month) | ua.startswith(month))
    if scope == "since_last":
        if not mark.strip():
            return runs
        m = mark.strip()
        return runs.filter(((ua != "") & (ua > m)) | ((ca != "") & (ca > m)))
    if scope in ("extraction", "filtration", "clarifier") and stage_runs is not None:
        has = stage_runs.select(F.col("run_id").alias("__rid")).filter(F.col("__rid").isNotNull())
        return runs.filter(F.col("id") != 0).join(has, runs["id"] == has["__rid"], "left_semi")
    return runs


def run_locked(runs: DataFrame, action: str) -> Column:
    """The run already carries a label of the kind being applied (O-FLT-21)."""
    return clean(GROUP_COLUMNS[action]) != ""


# ----------------------------------------------------------- aggregations

def completed_stages(sheets: DataFrame) -> DataFrame:
    """DISTINCT complete stage keys per run (SQL status rule: NULL is Complete)."""
    done = sheets.filter(F.coalesce(F.col("completion_status"), F.lit("Complete")) == "Complete")
    return done.select("run_id", "stage_key").filter(F.col("run_id").isNotNull()).distinct()


def stage_counts(sheets: DataFrame, extraction: DataFrame, filtration: DataFrame) -> DataFrame:
    """Per run: distinct complete sheet stages + has extraction + has filtration (O-JOIN-6).

    Evaporation is not counted (T6).  One aggregate per table; a run absent
    from all three is absent here and reads as 0 after the left join.
    """
    sheet_part = completed_stages(sheets).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    ext = extraction.select("run_id").filter(F.col("run_id").isNotNull()).distinct().withColumn("n", F.lit(1))
    fil = filtration.select("run_id").filter(F.col("run_id").isNotNull()).distinct().withColumn("n", F.lit(1))
    both = sheet_part.unionByName(ext.select("run_id", F.col("n").cast("long"))) \
                     .unionByName(fil.select("run_id", F.col("n").cast("long")))
    return both.groupBy("run_id").agg(F.sum("n").alias("stage_count"))


def with_stage_count(runs: DataFrame, counts: DataFrame) -> DataFrame:
    c = counts.withColumnRenamed("run_id", "__rid")
    return (runs.join(c, runs["id"] == c["__rid"], "left").drop("__rid")
            .withColumn("stage_count", F.coalesce(F.col("stage_count"), F.lit(0)).cast("long")))


def runs_page(runs: DataFrame, page: int, per_page: int) -> DataFrame:
    """Page ``page`` (1-based) newest first; OFFSET/LIMIT after a total order."""
    page, per_page = max(1, int(page)), max(1, int(per_page))
    return runs.orderBy(*newest_first()).offset((page - 1) * per_page).limit(per_page)


def search_total(matches: DataFrame, per_page: int) -> DataFrame:
    per_page = max(1, int(per_page))
    return matches.agg(F.count(F.lit(1)).alias("total")).withColumn(
        "pages", F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(per_page))).cast("long"))


def run_stats(runs: DataFrame, users: DataFrame) -> DataFrame:
    """Five dashboard counts in one pass over both tables (T25: NULL status in neither)."""
    tagged = (runs.select(F.lit("r").alias("t"), "status", F.lit(None).cast("int").alias("active"))
              .unionByName(users.select(F.lit("u").alias("t"), F.lit(None).cast("string").alias("status"), "active")))
    is_run, is_user = F.col("t") == "r", F.col("t") == "u"
    return tagged.agg(F.count_if(is_run).alias("total_runs"),
                      F.count_if(is_run & (F.col("status") == "Open")).alias("open_runs"),
                      F.count_if(is_run & (F.col("status") != "Open")).alias("completed_runs"),
                      F.count_if(is_user & (F.col("active") == 0)).alias("pending_users"),
                      F.count_if(is_user & (F.col("active") == 1)).alias("active_users"))


def recent_group_labels(runs: DataFrame, action: str, limit: int | None = None) -> DataFrame:
    """Labels in use: newest update and run count, newest first (O-AGG-2)."""
    c = GROUP_COLUMNS[action]
    g = (runs.filter(F.trim(F.coalesce(F.col(c), F.lit(""))) != "")
         .groupBy(F.col(c).alias("label"))
         .agg(F.max("updated_at").alias("updated_at"), F.count(F.lit(1)).alias("run_count")))
    ordered = g.orderBy(F.col("updated_at").desc_nulls_last(), F.col("label"))
    return ordered.limit(limit) if limit else ordered


# ------------------------------------------------------------------ lineage

def _members(runs: DataFrame) -> DataFrame:
    """Runs per group: those whose column for the action equals the label exactly."""
    return (runs.select("id", "updated_at", clean("batch_type").alias("bt"), run_label().alias("run_label"),
                        F.explode(F.array(
                            F.struct(F.lit("blend").alias("action"), F.col("blend_number").alias("group_label")),
                            F.struct(F.lit("split").alias("action"), F.col("split_batch_number").alias("group_label"))
                        )).alias("g"))
            .select("id", "updated_at", "bt", "run_label", "g.action", "g.group_label")
            .filter(F.trim(F.coalesce(F.col("group_label"), F.lit(""))) != ""))


def group_members(runs: DataFrame) -> DataFrame:
    """Every member of every blend / split group, one row per (group, run), sources numbered newest first.

    A run that carries both labels is in both groups.
    """
    members = _members(runs).withColumn("role", F.when(F.col("bt") == F.col("action"), "derived").otherwise("source"))
    keys = ["action", "group_label", "role"]
    ranked = sequence_within(members, keys, [F.col("updated_at"), F.col("id")], out="asc_pos")
    n = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return ranked.join(n, keys).select("action", "group_label", "id", "run_label", "role",
                                       (F.col("__n") - F.col("asc_pos") + 1).cast("long").alias("position"))


def group_lineage(runs: DataFrame) -> DataFrame:
    """Blend/split lineage per labelled run (O-JOIN-7, O-SRT-9, O-WIN-8).

    A run's group is the runs sharing its blend label (else split label).  The
    derived run is the newest group member whose batch type is the action.
    Sources are numbered newest first with the hot-group-safe sequence, one row
    per run; the group is never gathered into one row or task.
    """
    blend, split = nonblank("blend_number"), nonblank("split_batch_number")
    labelled = runs.select(
        "id", "updated_at", clean("batch_type").alias("bt"), run_label().alias("run_label"),
        F.when(blend.isNotNull(), F.lit("blend")).when(split.isNotNull(), F.lit("split")).alias("action"),
        F.coalesce(blend, split).alias("group_label")).filter(F.col("action").isNotNull())
    members = _members(runs)
    role_derived = F.col("bt") == F.col("action")
    derived = (members.filter(role_derived).groupBy("action", "group_label")
               .agg(F.max_by(F.struct(F.col("id").alias("derived_run_id"), F.col("run_label").alias("derived_run_label")),
                             F.struct("updated_at", "id")).alias("d"))
               .select("action", "group_label", "d.*"))
    sources = members.filter(~role_derived)
    ranked = sequence_within(sources, ["action", "group_label"], [F.col("updated_at"), F.col("id")], out="asc_pos")
    n = sources.groupBy("action", "group_label").agg(F.count(F.lit(1)).alias("source_count"))
    src_pos = (ranked.join(n, ["action", "group_label"])
               .select("id", "action", "group_label", (F.col("source_count") - F.col("asc_pos") + 1).alias("source_position")))
    out = (labelled.join(derived, ["action", "group_label"], "left")
           .join(n, ["action", "group_label"], "left")
           .join(src_pos, ["id", "action", "group_label"], "left"))
    title = F.initcap(F.col("action"))
    count = F.coalesce(F.col("source_count"), F.lit(0))
    summary = (F.when(F.col("bt") == F.col("action"),
                      F.when(count > 0, F.lit(LINEAGE_SOURCES)).otherwise(F.lit(LINEAGE_NO_SOURCES)))
               .when(F.col("derived_run_id").isNotNull(), F.concat(title, F.lit(" run: "), F.col("derived_run_label")))
               .otherwise(F.concat(title, F.lit(" label: "), F.col("group_label"))))
    return out.select("id", "run_label", "action", "group_label",
                      F.when(F.col("bt") == F.col("action"), "derived").otherwise("source").alias("role"),
                      "derived_run_id", "derived_run_label", count.cast("long").alias("source_count"),
                      F.col("source_position").cast("long").alias("source_position"), summary.alias("summary"))


# --------------------------------------------------------------- checklist

def stage_checklist(runs: DataFrame, sheets: DataFrame, voided: DataFrame, stage_keys: list[str]) -> DataFrame:
    """Per run x linked stage: done, voided-and-not-done, can_finish (O-JOIN-9).

    What is known of a run's stages is one row of bits, a hash aggregate, and
    meets the run before the literal stage keys are exploded (a bounded fan-out),
    so that neither the grid nor the marks are sorted or shuffled per stage.
    """
    keys = list(dict.fromkeys(stage_keys))
    bit = F.coalesce(*[F.when(F.col("stage_key") == k, F.lit(1 << i)) for i, k in enumerate(keys)], F.lit(0)).cast("long")
    none = F.lit(0).cast("long")
    done = F.coalesce(F.col("completion_status"), F.lit("Complete")) == "Complete"
    marks = (sheets.filter(done & F.col("run_id").isNotNull()).select("run_id", bit.alias("__done"), none.alias("__void"), F.lit(True).alias("__any"))
             .unionByName(voided.filter(F.col("run_id").isNotNull()).select("run_id", none.alias("__done"), bit.alias("__void"), F.lit(False).alias("__any"))))
    known = marks.groupBy("run_id").agg(F.bit_or("__done").alias("__done"), F.bit_or("__void").alias("__void"), F.bool_or("__any").alias("__any"))
    j = runs.select(F.col("id").alias("run_id")).join(known, "run_id", "left")
    stages = F.array(*[F.struct(F.lit(k).alias("stage_key"), F.lit(1 << keys.index(k)).cast("long").alias("__bit")) for k in stage_keys])
    grid = j.select("run_id", F.coalesce("__done", none).alias("__done"), F.coalesce("__void", none).alias("__void"),
                    F.coalesce("__any", F.lit(False)).alias("can_finish"), F.inline(stages))
    d = F.col("__done").bitwiseAND(F.col("__bit")) != 0
    return grid.select("run_id", "stage_key", d.alias("done"), ((F.col("__void").bitwiseAND(F.col("__bit")) != 0) & ~d).alias("voided"), "can_finish")

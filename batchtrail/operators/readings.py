"""Machine readings: date filter, wide -> long, point merge, sheet cells.

O-FLT-8 ``readings_date_range``, O-RSH-1 ``cells_long``, O-RSH-7
``readings_long``, O-WIN-9 ``point_merge``, O-AGG-6/7/8 and the pieces of the
flagship O-RSH-8 ``machine_performance``.

Every step is a narrow projection except the point merge, which is one
hash aggregation (partial aggregation on the map side, so a busy point key
never gathers its rows in one task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchtrail.functions.text import clean, nonblank, parse_numeric, title_case
from batchtrail.functions.time import effective_date, has_point_time, with_point_time
from batchtrail.sources.stages import NON_METRIC_FIELDS, STAGES, stage_columns
from batchtrail.sources.tables import parse_payload, payload_cells

# Cell keys ``{prefix}_{row}_{field}``: the lazy prefix splits every configured
# key correctly; rows are canonical integers (the form never writes ``01``).
CELL_KEY = r"^(.+?)_([1-9][0-9]*)_(.+)$"

POINT_COLUMNS = ["machine", "point_time", "point_label", "entry_id", "table_prefix", "row_no"]


def readings_date_range(df: DataFrame, start: str = "", end: str = "", entry_date: str = "entry_date",
                        created_at: str = "created_at") -> DataFrame:
    """Inclusive optional bounds on ``COALESCE(entry_date, created_at[:10])``.

    Only given bounds become filters.  Each bound also adds an implied predicate
    on the raw column (``entry_date >= start OR entry_date IS NULL``) that
    Parquet can evaluate, so row groups outside the range are skipped.
    """
    eff = effective_date(entry_date, created_at)
    ed = F.col(entry_date)
    if start:
        df = df.filter((ed >= F.lit(start)) | ed.isNull()).filter(eff >= F.lit(start))
    if end:
        df = df.filter((ed <= F.lit(end)) | ed.isNull()).filter(eff <= F.lit(end))
    return df


def readings_long(df: DataFrame, id_cols: list[str], fields: list[str]) -> DataFrame:
    """Wide text readings -> (ids..., field, text, value); NULL text columns are skipped."""
    present = [f for f in fields if f in df.columns]
    long = df.unpivot(id_cols, present, "field", "text")
    return long.withColumn("value", parse_numeric("text"))


def point_merge(values: DataFrame, key_cols: list[str], order_col: str = "ord") -> DataFrame:
    """Per point and field the last non-NULL value in row order wins."""
    return (values.filter(F.col("value").isNotNull())
            .groupBy(*key_cols, "field")
            .agg(F.max_by("value", order_col).alias("value")))


def point_keys(rows: DataFrame) -> list[str]:
    """Columns that tell a typed machine's points apart."""
    return [c for c in ("entry_id", "table_prefix", "row_no", "point_time", "who") if c in rows.columns]


def merge_wide(rows: DataFrame, fields: list[str]) -> DataFrame:
    """The merged numbers of each point, still one column per field: the rows of a point meet once, before the unpivot.

    Rows without ``ord`` are one per point already and are only parsed.
    """
    keys = point_keys(rows)
    present = [f for f in fields if f in rows.columns]
    numbers = [parse_numeric(f).alias(f) for f in present]
    if "ord" not in rows.columns:
        return rows.select(*keys, *numbers)
    parsed = rows.select(*keys, "ord", *numbers)
    return parsed.groupBy(*keys).agg(*[
        F.max_by(f, F.when(F.col(f).isNotNull(), F.col("ord"))).alias(f) for f in present])


def typed_points(points: DataFrame, machine: str) -> DataFrame:
    """Point columns of a typed machine with the label, which is a function of the point's key."""
    at = _label_time(F.col("point_time"))
    if machine == "filtration":
        label = F.rtrim(F.concat(at, F.lit(" | "), _title_of_group("table_prefix"), F.lit(" row "), _row_no_text(F.col("row_no"))))
    elif machine == "evaporation":
        label = F.concat(at, F.lit(" | "), F.col("who"), F.lit(" row "), _row_no_text(F.col("row_no")))
    else:
        label = F.concat(at, F.lit(" | "), F.col("who"))
    absent = {"table_prefix": "string", "row_no": "int"}
    filled = points.select("*", *[F.lit(None).cast(t).alias(c) for c, t in absent.items() if c not in points.columns])
    others = [c for c in filled.columns if c not in (*POINT_COLUMNS, "who")]
    return filled.withColumns({"machine": F.lit(machine), "point_label": label}).select(*POINT_COLUMNS, *others)


def metric_summary(values: DataFrame, by: list[str] | None = None) -> DataFrame:
    """O-AGG-6 and O-AGG-8 in one aggregation: count, then the finite range widened when flat."""
    by = by or []
    v = F.col("value")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    agg = values.filter(v.isNotNull()).groupBy(*by, "field").agg(
        F.count(v).alias("value_count"), F.min(F.when(finite, v)).alias("lo"), F.max(F.when(finite, v)).alias("hi"))
    same = F.col("lo") == F.col("hi")
    return agg.select(*by, "field", "value_count",
                      F.when(same, F.col("lo") - 1).otherwise(F.col("lo")).alias("axis_min"),
                      F.when(same, F.col("hi") + 1).otherwise(F.col("hi")).alias("axis_max"))


# ---------------------------------------------------------------------------
# typed machines
# ---------------------------------------------------------------------------

def _label_time(x: Column) -> Column:
    return F.replace(x, F.lit("T"), F.lit(" "))


def _row_no_text(c: Column) -> Column:
    return F.when(c.isNull() | (c == 0), F.lit("")).otherwise(c.cast("string"))


def _title_of_group(c: str) -> Column:
    # row groups are a handful of distinct values; the title is a literal lookup
    # for the configured ones and the general rule otherwise
    known = F.create_map(*[x for n in range(1, 7) for x in (F.lit(f"cycle{n}"), F.lit(f"Cycle{n}"))])
    g = clean(c)
    return F.coalesce(F.try_element_at(known, g), title_case(g))


def filtration_readings(entries: DataFrame, rows: DataFrame, fields: list[str], start: str = "",
                        end: str = "") -> DataFrame:
    """Filtration entry INNER JOIN child rows (O-JOIN-2) as point-tagged wide rows.

    Within a point all but the row's time text and id is the same, so these two order its rows (``ord``).

    The reference also left-joins the run only to project a column the chart
    never reads; that join cannot change the points, so it is not planned.
    """
    e = readings_date_range(entries, start, end).filter(has_point_time("entry_date", "created_at")).select(
        F.col("id").alias("entry_id"), "entry_date", "created_at")
    r = rows.select(F.col("filtration_entry_id").alias("entry_id"), F.col("id").alias("row_id"),
                    "row_group", "row_no", "row_time", *fields)
    j = with_point_time(e.join(r, "entry_id"), "entry_date", "row_time", "created_at")
    return j.select("point_time", "entry_id", F.col("row_group").alias("table_prefix"), F.col("row_no").cast("int").alias("row_no"),
                    F.struct("row_time", "row_id").alias("ord"), *fields)


def readings_order(entries: DataFrame, rows: DataFrame, start: str = "", end: str = "", limit: int | None = None) -> DataFrame:
    """Filtration readings with their place in the order of the readings table (O-SRT-5): effective date, row time,
    save time, cycle, row number, then row id; NULL first.  Uncapped unless a ``limit`` is given."""
    from batchtrail.operators.sequence import assign_ids
    e = readings_date_range(entries, start, end).select(F.col("id").alias("filtration_entry_id"), effective_date().alias("reading_date"), "created_at")
    j = e.join(rows.select("filtration_entry_id", F.col("id").alias("row_id"), "row_group", "row_no", "row_time"), "filtration_entry_id")
    placed = assign_ids(j, [F.col(c) for c in ("reading_date", "row_time", "created_at", "row_group", "row_no", "row_id")], 0, "position")
    return placed.where(F.col("position") <= limit) if limit else placed


def evaporation_readings(entries: DataFrame, rows: DataFrame, runs: DataFrame, fields: list[str],
                         start: str = "", end: str = "") -> DataFrame:
    """Evaporation entry INNER JOIN rows LEFT JOIN run (O-JOIN-3)."""
    from batchtrail.operators.joins import join_runs
    e = readings_date_range(entries, start, end).filter(has_point_time("entry_date", "created_at")).select(
        "id", "run_id", "entry_date", "created_at")
    e = join_runs(e, runs, ["run_number"]).withColumnRenamed("id", "entry_id")
    r = rows.select(F.col("evaporation_entry_id").alias("entry_id"), F.col("id").alias("row_id"),
                    "row_no", "row_time", *fields)
    j = with_point_time(e.join(r, "entry_id"), "entry_date", "row_time", "created_at")
    who = F.coalesce(nonblank("run_number"), F.concat(F.lit("Entry "), F.col("entry_id").cast("string")))
    return j.select("point_time", "entry_id", who.alias("who"), F.col("row_no").cast("int").alias("row_no"),
                    F.struct("row_time", "row_id").alias("ord"), *fields)


def extraction_readings(entries: DataFrame, runs: DataFrame, fields: list[str], start: str = "",
                        end: str = "") -> DataFrame:
    """Extraction entries LEFT JOIN run; one point per entry."""
    from batchtrail.operators.joins import join_runs
    e = readings_date_range(entries, start, end).filter(has_point_time("entry_date", "created_at")).select(
        "id", "run_id", "entry_date", "entry_time", "created_at", *fields)
    e = join_runs(e, runs, ["run_number"]).withColumnRenamed("id", "entry_id")
    e = with_point_time(e, "entry_date", "entry_time", "created_at")
    who = F.coalesce(nonblank("run_number"), F.concat(F.lit("Entry "), F.col("entry_id").cast("string")))
    return e.select("point_time", "entry_id", who.alias("who"), *fields)


# ---------------------------------------------------------------------------
# generic sheets (JSON payload)
# ---------------------------------------------------------------------------

def stage_tables(stage_key: str) -> list[tuple[str, str, int]]:
    """(prefix, title, max_rows) of one stage, from the catalogue."""
    for key, _title, _headers, tables in STAGES:
        if key == stage_key:
            return [(prefix, title, rows) for title, prefix, rows, _cols in tables]
    return []


def stage_metric_fields(stage_key: str) -> list[tuple[str, str, str, str]]:
    """Chartable fields of a stage: (prefix, field, chart_key, label) (O-RSH-9)."""
    out, seen = [], set()
    for key, _title, _headers, tables in STAGES:
        if key != stage_key:
            continue
        for title, prefix, _rows, columns in tables:
            for field, label, *_rest in columns:
                chart_key = f"{prefix}::{field}"
                if field in NON_METRIC_FIELDS or chart_key in seen:
                    continue
                seen.add(chart_key)
                out.append((prefix, field, chart_key, f"{title} - {label}"))
    return out


def stage_metric_catalog(spark: SparkSession) -> DataFrame:
    """All chartable sheet fields as a DataFrame (stage_key, chart_key, label)."""
    cols = stage_columns(spark).filter(~F.col("field").isin(NON_METRIC_FIELDS))
    keyed = cols.select("stage_key", "table_no", "column_no",
                        F.concat_ws("::", "table_prefix", "field").alias("chart_key"),
                        F.concat_ws(" - ", "table_title", "label").alias("label"))
    return (keyed.groupBy("stage_key", "chart_key")
            .agg(F.min_by("label", F.struct("table_no", "column_no")).alias("label")))


def _sheet_entries(sheets: DataFrame, stage_key: str, start: str, end: str) -> DataFrame:
    s = readings_date_range(sheets.filter(F.col("stage_key") == stage_key), start, end)
    staged = s.select(F.col("id").alias("entry_id"), "entry_date", "created_at", parse_payload("payload_json").alias("payload"))
    date_src = F.coalesce(F.nullif(F.col("payload")["entry_date"], F.lit("")), F.col("entry_date"))
    return staged.select("entry_id", "created_at", date_src.alias("date_src"), "payload",
                         F.struct(effective_date(), F.col("created_at"), F.col("entry_id")).alias("ord"))


def _row_times(payload: Column) -> Column:
    """Map ``prefix_row`` -> row time text, built in one pass over the payload."""
    timed = F.filter(F.map_entries(payload), lambda e: e["key"].endswith("_time"))
    pairs = F.transform(timed, lambda e: F.struct(F.regexp_extract(e["key"], r"^(.+)_time$", 1).alias("k"),
                                                   e["value"].alias("v")))
    return F.map_from_entries(pairs)


def _titles(stage_key: str) -> Column:
    return F.create_map(*[x for p, t, _n in stage_tables(stage_key) for x in (F.lit(p), F.lit(t))])


def _generic_label(stage_key: str) -> Column:
    return F.concat(_label_time(F.col("point_time")), F.lit(" | "), F.try_element_at(_titles(stage_key), F.col("table_prefix")),
                    F.lit(" "), F.col("row_no").cast("string"))


def generic_points(sheets: DataFrame, stage_key: str, start: str = "", end: str = "") -> DataFrame:
    """Every configured row of every entry becomes a point (T11), keyed by time + row (T10).

    Points are deduplicated on their key before the label (a function of the
    key) is built, so the shuffle carries three short columns.
    """
    grid = F.array(*[F.struct(F.lit(p).alias("table_prefix"), F.lit(n).alias("rows")) for p, _t, n in stage_tables(stage_key)])
    e = _sheet_entries(sheets, stage_key, start, end).filter(has_point_time("date_src", "created_at")).select(
        "created_at", "date_src", _row_times(F.col("payload")).alias("times"))
    # two plain explodes (table, then row number) stay in generated code
    per_table = e.select("created_at", "date_src", "times", F.inline(grid))
    exploded = per_table.select("created_at", "date_src", "times", "table_prefix",
                                F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("row_no"))
    row_time = F.try_element_at(F.col("times"), F.concat(F.col("table_prefix"), F.lit("_"), F.col("row_no").cast("string")))
    exploded = exploded.select("created_at", "date_src", "table_prefix", "row_no", row_time.alias("row_time"))
    timed = with_point_time(exploded, "date_src", "row_time", "created_at")
    keys = timed.select("point_time", "table_prefix", F.col("row_no").cast("int").alias("row_no")).distinct()
    return keys.select(F.lit(stage_key).alias("machine"), "point_time", _generic_label(stage_key).alias("point_label"),
                       F.lit(None).cast("long").alias("entry_id"), "table_prefix", "row_no")


def generic_point_count(sheets: DataFrame, stage_key: str, start: str = "", end: str = "") -> DataFrame:
    """Exact number of distinct chart points of a sheet machine without listing them (O-AGG-7).

    A row with a time cell gives point (date T time, row) - set A.  Every other
    configured row of an entry gives (fallback, row), the fallback being the
    entry's created_at (else its date) - set B.  With n(f) entries sharing the
    fallback f, a row r of table p is missing from B only if all n(f) entries
    time it, so |B| = |fallbacks| x (configured rows) - #(f, p, r) timed n(f)
    times, and |A u B| = |A| + |B| - |A n B|.  Only timed rows are ever
    expanded; the plain listing (``generic_points``) grows with every
    configured row of every entry.
    """
    tables = stage_tables(stage_key)
    total_rows = sum(n for _p, _t, n in tables)
    max_rows = F.create_map(*[x for p, _t, n in tables for x in (F.lit(p), F.lit(n))])
    e = _sheet_entries(sheets, stage_key, start, end).filter(has_point_time("date_src", "created_at"))
    e = with_point_time(e.withColumn("__no_time", F.lit("")), "date_src", "__no_time", "created_at", out="fallback")
    pat = r"^(.+)_([1-9][0-9]*)_time$"
    timed = (payload_cells(e, F.col("payload"), "entry_id", "date_src", "created_at", "fallback", names=("key", "t"))
             .filter(F.col("key").rlike(pat))
             .select("entry_id", "date_src", "created_at", "fallback", "t",
                     F.regexp_extract("key", pat, 1).alias("table_prefix"),
                     F.regexp_extract("key", pat, 2).try_cast("int").alias("row_no"))
             .filter((F.col("row_no") <= F.try_element_at(max_rows, F.col("table_prefix"))) & (clean("t") != "")))
    timed = with_point_time(timed, "date_src", "t", "created_at")
    n_f = e.groupBy("fallback").agg(F.count(F.lit(1)).alias("n_f"))
    tc = timed.groupBy("fallback", "table_prefix", "row_no").agg(F.count(F.lit(1)).alias("tc"))
    full = tc.join(n_f, "fallback").filter(F.col("tc") == F.col("n_f")).agg(F.count(F.lit(1)).alias("full"))
    fallbacks = n_f.agg(F.count(F.lit(1)).alias("nf"))
    a = timed.select("point_time", "table_prefix", "row_no").distinct()
    a_in_b = (a.join(n_f, a["point_time"] == n_f["fallback"])
              .join(tc.withColumnRenamed("fallback", "point_time"), ["point_time", "table_prefix", "row_no"], "left")
              .filter(F.coalesce(F.col("tc"), F.lit(0)) < F.col("n_f")).agg(F.count(F.lit(1)).alias("ab")))
    size_a = a.agg(F.count(F.lit(1)).alias("na"))
    # four one-row counts combined by a tagged union and one aggregate (no join)
    tagged = (size_a.select(F.lit("na").alias("t"), F.col("na").alias("v"))
              .unionByName(fallbacks.select(F.lit("nf").alias("t"), F.col("nf").alias("v")))
              .unionByName(full.select(F.lit("full").alias("t"), F.col("full").alias("v")))
              .unionByName(a_in_b.select(F.lit("ab").alias("t"), F.col("ab").alias("v"))))

    def part(tag: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("t") == tag, F.col("v"))), F.lit(0))

    count = part("na") + part("nf") * F.lit(total_rows) - part("full") - part("ab")
    return tagged.agg(count.cast("long").alias("point_count")).select(
        F.lit(stage_key).alias("machine"), "point_count").filter(F.col("point_count") > 0)


def generic_values(sheets: DataFrame, stage_key: str, start: str = "", end: str = "") -> DataFrame:
    """Numeric cells of the stage's chartable fields, tagged with their point.

    Payload cells are exploded once and matched by an equi-join with the
    broadcast table of the stage's chartable cell keys (bounded by
    configuration: rows x columns of its tables), so no regex or array
    function runs per cell; keys past a table's row count never match.
    """
    from batchtrail.sources.stages import stage_cell_keys
    spark = sheets.sparkSession
    e = (_sheet_entries(sheets, stage_key, start, end).filter(has_point_time("date_src", "created_at"))
         .withColumn("times", _row_times(F.col("payload"))))
    cells = payload_cells(e, F.col("payload"), "created_at", "date_src", "ord", "times", names=("key", "text"))
    keys = F.broadcast(stage_cell_keys(spark)
                       .filter((F.col("stage_key") == stage_key) & ~F.col("field").isin(NON_METRIC_FIELDS))
                       .select("key", "table_prefix", F.col("row_no").cast("int").alias("row_no"),
                               F.concat_ws("::", "table_prefix", "field").alias("field")))
    matched = cells.join(keys, "key")
    valued = matched.withColumn("value", parse_numeric("text")).filter(F.col("value").isNotNull())
    row_time = F.try_element_at(F.col("times"), F.concat(F.col("table_prefix"), F.lit("_"), F.col("row_no").cast("string")))
    timed = with_point_time(valued.withColumn("row_time", row_time), "date_src", "row_time", "created_at")
    return timed.select(F.lit(stage_key).alias("machine"), "point_time", _generic_label(stage_key).alias("point_label"),
                        F.lit(None).cast("long").alias("entry_id"), "table_prefix", "row_no", "ord",
                        "field", "value")


def cells_long(sheets: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """Payload cells -> (entry, stage, prefix, row_no, field, text) for configured table cells.

    Payload keys are matched by an equi-join on (stage_key, key) with the
    broadcast table of every configured cell key (bounded by configuration),
    so no regex runs per cell; unknown keys and rows beyond ``max_rows`` drop out.
    """
    from batchtrail.sources.stages import stage_cell_keys
    spark = sheets.sparkSession
    cells = payload_cells(sheets, parse_payload("payload_json"), F.col("id").alias("entry_id"), "stage_key", names=("key", "text"))
    keys = F.broadcast(stage_cell_keys(spark).select("stage_key", "key", "table_prefix", "table_title", "row_no",
                                                     "field", "label"))
    return cells.join(keys, ["stage_key", "key"]).select(
        "entry_id", "stage_key", "table_prefix", "table_title", F.col("row_no").cast("int").alias("row_no"),
        "field", "label", "key", "text")

"""Form and sheet reshapes (O-RSH-2/3/4/6/10/14/15, O-AGG-11, O-SCL-26/27/28, O-JOIN-12/13).

Forms arrive as one map of fields per submission.  Typed entry columns and
the fixed evaporation rows are narrow projections of the map; dynamic
filtration rows are exploded cells regrouped by (form, cycle, row) with one
conditional aggregate per field (a fixed pivot, no discovery pass).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchtrail.functions.labels import run_label
from batchtrail.functions.text import clean, is_blank
from batchtrail.sources.stages import STAGES, stage_columns, stage_headers
from batchtrail.sources.tables import parse_payload, payload_cells

# Column names of the forms and tables.
FILTRATION_FORM_FIELDS = ["entry_date", "cycle_volume_set_point", "clarification_sequential_no", "retentate_flow_set_point",
                          "zero_refract", "startup_time", "shutdown_time", "start_time", "stop_time", "photo_path"]
EVAPORATION_FORM_FIELDS = ["entry_date", "evaporator_no", "startup_time", "shutdown_time", "feed_ri", "concentrate_ri",
                           "steam_pressure", "vacuum", "sump_level", "product_temp", "photo_path"]
FILTRATION_ROW_FIELDS = ["time", "operator_initials", "fic1_gpm", "tit1", "tit2", "dpt", "dpm", "perm_total",
                         "f12_gpm", "permeate_ri", "retentate_ri", "qic1_ntu_turbidity", "pressure_pt1",
                         "pressure_pt2", "pressure_pt3"]
CYCLE_SUMMARY_FIELDS = ["cycle_number", "ri_to_sewer", "total_filtrate_volume", "cleaning_method"]
CYCLES = 6
EXTRACTION_FORM_FIELDS = ["entry_date", "entry_time", "start_time", "stop_time", "psf1_speed", "psf1_load",
                          "psf1_blowback", "psf2_speed", "psf2_load", "psf2_blowback", "press_speed", "press_load",
                          "press_blowback", "pressate_ri", "chip_bin_steam", "chip_chute_temp", "photo_path"]
# The browser's numeric-keyboard rule for a field (name + label, lower case).
NUMERIC_EXCLUDE = r"(initial|operator|comment|note|photo|path|method|status|bed|vessel|name|lot|location|flavor|odor)"
NUMERIC_INCLUDE = (r"(number|no\.|#|ri|temp|pressure|rate|speed|load|volume|total|weight|density|target|gallon|gal|lb|"
                   r"ppm|ntu|gpm|rpm|psi|vac|level|color|turbidity|scale|inch|effect|condenser|condensor)")


def _get(m: Column, key: str) -> Column:
    return F.coalesce(m.getItem(key), F.lit(""))


def _or(m: Column, first: str, second: str) -> Column:
    """Python ``form.get(a, '') or form.get(b, '')``."""
    a = _get(m, first)
    return F.when(a != "", a).otherwise(_get(m, second))


def extraction_from_form(forms: DataFrame, fields: str = "fields") -> DataFrame:
    """Extraction entry columns from a form, with the reference's fallbacks (O-RSH-6)."""
    m = F.col(fields)
    loc = _get(m, "location")
    return forms.select("form_id", _initials(m), *[_get(m, f).alias(f) for f in EXTRACTION_FORM_FIELDS],
                        F.when(loc != "", loc).otherwise(F.lit("Pile")).alias("location"),
                        _or(m, "time_on_pile", "time_on_pipe_or_pile").alias("time_on_pile"),
                        _or(m, "comments", "notes").alias("comments"))


def _initials(m: Column) -> Column:
    return F.upper(clean(m.getItem("operator_initials"))).alias("operator_initials")


def filtration_from_form(forms: DataFrame, fields: str = "fields") -> DataFrame:
    """Filtration entry columns from a form, with its cycle summaries as payload and the form's save mode (O-RSH-6)."""
    m = F.col(fields)
    summary = cycle_summary_payload(forms, fields, ["form_save_mode", fields])
    return summary.select("form_id", _initials(m), *[_get(m, f).alias(f) for f in FILTRATION_FORM_FIELDS],
                          _or(m, "comments", "notes").alias("comments"), "payload_json",
                          F.col("form_save_mode").alias("completion_status"))


def evaporation_from_form(forms: DataFrame, fields: str = "fields") -> DataFrame:
    """Evaporation entry columns from a form (O-RSH-6)."""
    m = F.col(fields)
    return forms.select("form_id", _initials(m), *[_get(m, f).alias(f) for f in EVAPORATION_FORM_FIELDS],
                        _or(m, "comments", "notes").alias("comments"))


def refused_row_keys(forms: DataFrame, fields: str = "fields") -> DataFrame:
    """Keys that look like row cells but whose row number is beyond an int: ``(form_id, key)``."""
    cells = payload_cells(forms, F.col(fields), "form_id")
    number = F.regexp_extract("key", rf"^cycle[1-{CYCLES}]_(0|[1-9][0-9]*)_.+$", 1)
    return cells.filter((number != "") & number.try_cast("int").isNull()).select("form_id", "key")


def filtration_rows_from_form(forms: DataFrame, fields: str = "fields") -> DataFrame:
    """Dynamic ``cycleN_R_field`` cells -> child rows; all-blank rows dropped (O-RSH-2).

    Only canonical row numbers are read, 0 among them (the form's keys for row R
    are ``cycleN_R_*``); a number beyond an int is not a row (see
    ``refused_row_keys``).  ``feed_ri`` and the perm flows are always empty.
    """
    cells = payload_cells(forms, F.col(fields), "form_id")
    pat = rf"^(cycle[1-{CYCLES}])_(0|[1-9][0-9]*)_(.+)$"
    parsed = cells.select("form_id", F.regexp_extract("key", pat, 1).alias("row_group"),
                          F.regexp_extract("key", pat, 2).alias("row_text"),
                          F.regexp_extract("key", pat, 3).alias("field"), "value")
    parsed = parsed.filter((F.col("row_group") != "") & F.col("field").isin(FILTRATION_ROW_FIELDS)
                           & F.col("row_text").try_cast("int").isNotNull())
    grouped = parsed.groupBy("form_id", "row_group", F.col("row_text").try_cast("int").alias("row_no")).agg(
        *[F.max(F.when(F.col("field") == f, F.col("value"))).alias("row_time" if f == "time" else f)
          for f in FILTRATION_ROW_FIELDS])
    names = ["row_time" if f == "time" else f for f in FILTRATION_ROW_FIELDS]
    filled = grouped.select("form_id", "row_group", "row_no", *[F.coalesce(F.col(n), F.lit("")).alias(n) for n in names],
                            F.lit("").alias("feed_ri"), F.lit("").alias("perm_flow_c"), F.lit("").alias("perm_flow_d"))
    any_value = F.lit(False)
    for n in names:
        any_value = any_value | ~is_blank(n)
    return filled.filter(any_value)


def evaporation_rows_from_form(forms: DataFrame, fields: str = "fields") -> DataFrame:
    """Rows 1..3 always, blanks kept; form names ``rowI_vacuum`` etc. renamed (O-RSH-3)."""
    m = F.col(fields)
    rows = F.array(*[F.struct(F.lit(i).alias("row_no"), _get(m, f"row{i}_time").alias("row_time"),
                              _get(m, f"row{i}_feed_rate").alias("feed_rate"), _get(m, f"row{i}_evap_temp").alias("evap_temp"),
                              _get(m, f"row{i}_vacuum").alias("row_vacuum"),
                              _get(m, f"row{i}_concentrate_ri").alias("row_concentrate_ri")) for i in range(1, 4)])
    return forms.select("form_id", F.inline(rows))


def cycle_summary_payload(forms: DataFrame, fields: str = "fields", keep: list[str] | None = None) -> DataFrame:
    """The 6 x 4 cycle summary keys as a JSON object text (O-RSH-4), '' for missing keys."""
    m = F.col(fields)
    keys = [f"cycle{c}_{f}" for c in range(1, CYCLES + 1) for f in CYCLE_SUMMARY_FIELDS]
    pairs = [x for k in keys for x in (F.lit(k), _get(m, k))]
    return forms.select("form_id", *(keep or []), F.to_json(F.create_map(*pairs)).alias("payload_json"))


def cycle_summaries(payloads: DataFrame, id_col: str, payload_col: str = "payload_json") -> DataFrame:
    """Read side of O-RSH-4: (entry, cycle, field, value) for every summary key present.

    The payload's entries are exploded once and matched by pattern, so no map
    is carried along the exploded rows.
    """
    pat = rf"^cycle([1-{CYCLES}])_({'|'.join(CYCLE_SUMMARY_FIELDS)})$"
    cells = payload_cells(payloads, parse_payload(payload_col), id_col)
    hits = cells.filter(F.col("key").rlike(pat) & F.col("value").isNotNull())
    return hits.select(id_col, F.regexp_extract("key", pat, 1).cast("int").alias("cycle"),
                       F.regexp_extract("key", pat, 2).alias("field"), "value")


def cycle_view(entries: DataFrame, rows: DataFrame) -> DataFrame:
    """Cycles 1..6 of each filtration entry that have rows or a non-empty summary (O-RSH-15)."""
    grid = entries.select(F.col("id").alias("entry_id"), "payload_json",
                          F.explode(F.sequence(F.lit(1), F.lit(CYCLES))).alias("cycle"))
    counts = rows.groupBy(F.col("filtration_entry_id").alias("entry_id"), F.col("row_group")).agg(
        F.count(F.lit(1)).alias("n_rows"))
    g = grid.withColumn("row_group", F.concat(F.lit("cycle"), F.col("cycle").cast("string")))
    m = parse_payload("payload_json")
    summary = F.lit(False)
    for f in CYCLE_SUMMARY_FIELDS:
        summary = summary | (F.coalesce(m[F.concat(F.col("row_group"), F.lit("_" + f))], F.lit("")) != "")
    j = g.withColumn("has_summary", summary).join(counts, ["entry_id", "row_group"], "left")
    n = F.coalesce(F.col("n_rows"), F.lit(0))
    return j.filter((n > 0) | F.col("has_summary")).select("entry_id", "cycle", n.alias("n_rows"), "has_summary")


def filtration_render_rows(entries: DataFrame, rows: DataFrame) -> DataFrame:
    """Visible rows per entry and cycle: highest row with a value, default 1 (O-AGG-11).

    Rows are first keyed ``{group}_{row}`` like the row map (a later id replaces
    an earlier one), then the highest populated row per cycle is taken; an entry
    without child rows shows one row in every cycle.
    """
    key_cols = ["filtration_entry_id", "row_group", "row_no"]
    names = ["row_time"] + [f for f in FILTRATION_ROW_FIELDS if f != "time" and f in rows.columns]
    filled = F.lit(False)
    for n in names:
        filled = filled | ~is_blank(n)
    # only the flag of the row that wins its key travels through the shuffle
    pop = rows.groupBy(*key_cols).agg(F.max_by(filled, F.col("id")).alias("populated")).filter("populated")
    shown = F.coalesce(F.nullif(F.col("row_no"), F.lit(0)), F.lit(1))
    cycles = range(1, CYCLES + 1)
    per = pop.groupBy("filtration_entry_id").agg(
        *[F.max(F.when(F.col("row_group") == f"cycle{c}", shown)).alias(f"__c{c}") for c in cycles])
    grid = entries.select(F.col("id").alias("filtration_entry_id")).join(per, "filtration_entry_id", "left")
    return grid.select("filtration_entry_id", F.inline(F.array(*[
        F.struct(F.lit(c).alias("cycle"), F.coalesce(f"__c{c}", F.lit(1)).cast("int").alias("render_rows")) for c in cycles])))


# ------------------------------------------------------------ generic sheets

def _stage_tables(spark: SparkSession) -> DataFrame:
    return stage_columns(spark).select("stage_key", "table_prefix", "table_title", "max_rows", "initial_rows").distinct()


def populated_rows(spark: SparkSession, sheets: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows to show per sheet table: highest row with a non-blank cell, else initial rows (O-AGG-11)."""
    filled = (cells.filter(~is_blank("text")).groupBy("entry_id", "table_prefix").agg(F.max("row_no").alias("top")))
    grid = sheets.select(F.col("id").alias("entry_id"), "stage_key").join(F.broadcast(_stage_tables(spark)), "stage_key")
    j = grid.join(filled, ["entry_id", "table_prefix"], "left")
    shown = F.coalesce(F.least(F.col("top"), F.col("max_rows")), F.greatest(F.lit(1), F.col("initial_rows")))
    return j.select("entry_id", "stage_key", "table_prefix", shown.cast("int").alias("render_rows"))


def sheet_detail_rows(cells: DataFrame) -> DataFrame:
    """Non-empty rows of each sheet table: a row shows when any cell text is non-empty (O-RSH-10, O-JOIN-13)."""
    return (cells.filter(F.coalesce(F.col("text"), F.lit("")) != "")
            .groupBy("entry_id", "stage_key", "table_prefix", "row_no").agg(F.count(F.lit(1)).alias("filled_cells")))


def sheet_detail_cells(cells: DataFrame) -> DataFrame:
    """The non-empty cells of the rows that a sheet's detail page shows, with table title and label (O-RSH-10)."""
    return cells.filter(F.coalesce(F.col("text"), F.lit("")) != "").select(
        "entry_id", "stage_key", "table_prefix", "table_title", "row_no", "field", "label", "text")


def sheet_header_values(spark: SparkSession, sheets: DataFrame, runs: DataFrame) -> DataFrame:
    """Header fields of each sheet with the saved value, else the field default (O-RSH-10, O-SCL-26, O-JOIN-12).

    Defaults: the configured one; else run number / production number -> the
    run label, run / blend number -> blend label or run label.
    """
    from batchtrail.operators.joins import join_runs
    parsed = sheets.select("id", "run_id", "stage_key", parse_payload("payload_json").alias("m"))
    s = join_runs(parsed, runs, ["id", "run_number", "batch_number", "blend_number"], prefix="r_")
    h = F.broadcast(stage_headers(spark).select("stage_key", "header_no", "field", "label", "default"))
    j = s.join(h, "stage_key")
    label = F.when(F.col("r_id").isNotNull(), run_label("r_run_number", "r_batch_number", "r_id"))
    run_default = (F.when(F.col("field").isin("run_number", "production_number"), label)
                   .when(F.col("field") == "run_blend_number",
                         F.when(F.col("r_id").isNotNull(), F.coalesce(F.nullif(clean("r_blend_number"), F.lit("")), label))))
    default = F.coalesce(F.nullif(F.col("default"), F.lit("")), run_default, F.lit(""))
    saved = F.col("m")[F.col("field")]
    return j.select(F.col("id").alias("entry_id"), "stage_key", "header_no", "field", "label",
                    F.coalesce(saved, F.lit("")).alias("saved_value"), default.alias("default_value"),
                    F.coalesce(F.nullif(saved, F.lit("")), default).alias("shown_value"))


def numeric_field_guess(name: Column, label: Column, ftype: Column) -> Column:
    """Would the browser offer a numeric keyboard for this field (O-SCL-27)."""
    text = F.lower(F.concat_ws(" ", name, label))
    text_input = ftype.isin("text", "numeric")
    return text_input & ~text.rlike(NUMERIC_EXCLUDE) & text.rlike(NUMERIC_INCLUDE)


def sheet_field_profile(spark: SparkSession, cells: DataFrame) -> DataFrame:
    """Per configured sheet field: cells seen, blank share, numeric share and the keyboard guess (O-SCL-27/28)."""
    from batchtrail.functions.text import parse_numeric
    cat = F.broadcast(stage_columns(spark).select("stage_key", "table_prefix", "field", "label", "type"))
    prof = cells.groupBy("stage_key", "table_prefix", "field").agg(
        F.count(F.lit(1)).alias("cells"), F.avg(is_blank("text").cast("double")).alias("blank_rate"),
        F.avg(parse_numeric("text").isNotNull().cast("double")).alias("numeric_rate"))
    return prof.join(cat, ["stage_key", "table_prefix", "field"]).select(
        "stage_key", "table_prefix", "field", "cells", F.round("blank_rate", 6).alias("blank_rate"),
        F.round("numeric_rate", 6).alias("numeric_rate"),
        numeric_field_guess(F.col("field"), F.col("label"), F.col("type")).alias("numeric_guess"))


def stage_lookup(spark: SparkSession, sheets: DataFrame) -> DataFrame:
    """Sheets joined to their stage definition (O-JOIN-12): title and table count from the broadcast catalogue."""
    defs = spark.createDataFrame([(k, t, len(tables)) for k, t, _h, tables in STAGES],
                                 "stage_key string, stage_title_cfg string, table_count int")
    return sheets.join(F.broadcast(defs), "stage_key", "left")

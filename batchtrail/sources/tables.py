"""Typed process tables: schemas, scan, schema reconciliation, payload parsing.

O-SRC-1 ``scan_table``, O-SRC-2 ``reconcile_schema``, O-SRC-3
``backfill_completion_status``, O-SRC-4 ``parse_payload``, O-SRC-5
``form_events``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchtrail.functions.text import ColumnOrName, col

S, L, I = T.StringType(), T.LongType(), T.IntegerType()


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


def _strings(*names):
    return [(n, S) for n in names]


_SIGNATURE = _strings("signature_data", "signature_signed_at")
_ENTRY_TAIL = [("version_no", I), ("previous_entry_id", L), ("created_at", S)]

SCHEMAS: dict[str, T.StructType] = {
    # users: the password column is never ingested.
    "users": _schema(("id", L), *_strings("employee_number", "full_name", "role"), ("active", I),
                     *_strings("created_at", "initials")),
    "production_runs": _schema(("id", L), *_strings("batch_number", "split_batch_number", "blend_number",
                                                    "run_number", "batch_type"), ("reused_batch", I),
                               *_strings("product_name", "shift_name", "operator_id", "notes", "status",
                                         "created_at", "updated_at", "final_edit_initials",
                                         "final_edit_notes", "finalized_at", "finalized_by")),
    "extraction_entries": _schema(("id", L), ("run_id", L),
                                  *_strings("employee", "operator_initials", "entry_date", "entry_time",
                                            "location", "time_on_pile", "start_time", "stop_time",
                                            "psf1_speed", "psf1_load", "psf1_blowback", "psf2_speed",
                                            "psf2_load", "psf2_blowback", "press_speed", "press_load",
                                            "press_blowback", "pressate_ri", "chip_bin_steam",
                                            "chip_chute_temp", "comments", "photo_path"),
                                  *_SIGNATURE, *_ENTRY_TAIL),
    "filtration_entries": _schema(("id", L), ("run_id", L),
                                  *_strings("employee", "operator_initials", "entry_date",
                                            "cycle_volume_set_point", "clarification_sequential_no",
                                            "retentate_flow_set_point", "zero_refract", "startup_time",
                                            "shutdown_time", "start_time", "stop_time", "comments",
                                            "photo_path"),
                                  *_SIGNATURE, *_strings("payload_json", "completion_status"), *_ENTRY_TAIL),
    "filtration_rows": _schema(("id", L), ("filtration_entry_id", L), ("row_group", S), ("row_no", I),
                               *_strings("row_time", "operator_initials", "fic1_gpm", "tit1", "tit2", "dpt",
                                         "dpm", "perm_total", "f12_gpm", "feed_ri", "retentate_ri",
                                         "permeate_ri", "perm_flow_c", "perm_flow_d",
                                         "qic1_ntu_turbidity", "pressure_pt1", "pressure_pt2",
                                         "pressure_pt3")),
    "evaporation_entries": _schema(("id", L), ("run_id", L),
                                   *_strings("employee", "operator_initials", "entry_date", "evaporator_no",
                                             "startup_time", "shutdown_time", "feed_ri", "concentrate_ri",
                                             "steam_pressure", "vacuum", "sump_level", "product_temp",
                                             "comments", "photo_path"),
                                   *_SIGNATURE, *_ENTRY_TAIL),
    "evaporation_rows": _schema(("id", L), ("evaporation_entry_id", L), ("row_no", I),
                                *_strings("row_time", "feed_rate", "evap_temp", "row_vacuum",
                                          "row_concentrate_ri")),
    "sheet_entries": _schema(("id", L), ("run_id", L),
                             *_strings("stage_key", "stage_title", "employee", "operator_initials",
                                       "entry_date", "comments"),
                             *_SIGNATURE, *_strings("payload_json", "completion_status"), *_ENTRY_TAIL),
    "voided_stages": _schema(("id", L), ("run_id", L), *_strings("stage_key", "voided_by", "voided_at")),
    "audit_log": _schema(("id", L), ("table_name", S), ("record_id", L),
                         *_strings("action_type", "changed_by", "old_data", "new_data", "created_at")),
    "field_change_log": _schema(("id", L), ("run_id", L), ("entry_table", S), ("record_id", L),
                                *_strings("field_name", "original_value", "corrected_value", "field_value",
                                          "correction_reason", "change_initials", "changed_by_employee",
                                          "created_at")),
}


def scan_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Read one process table with its declared schema (no inference)."""
    return spark.read.schema(SCHEMAS[table]).parquet(path)


def reconcile_schema(df: DataFrame, target: T.StructType | str) -> DataFrame:
    """Add the target's missing columns as typed NULLs, cast, and order like the target.

    Extra columns of ``df`` are dropped.  This is the additive evolution rule: a
    column added later is simply absent (NULL) in older data.
    """
    schema = SCHEMAS[target] if isinstance(target, str) else target
    have = set(df.columns)
    return df.select([
        (F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields])


def backfill_completion_status(df: DataFrame, column: str = "completion_status") -> DataFrame:
    """NULL or '' status -> 'Complete' (applied to filtration and sheet entries)."""
    return df.withColumn(column, F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("Complete")))


PAYLOAD_TYPE = "map<string,string>"


def _last_of_each_key(m: Column) -> Column:
    """The map with the last value of every key (the JSON reader keeps repeated keys)."""
    keys, values = F.reverse(F.map_keys(m)), F.reverse(F.map_values(m))
    distinct = F.array_distinct(keys)
    once = F.map_from_arrays(distinct, F.transform(distinct, lambda k: F.get(values, (F.array_position(keys, k) - 1).cast("int"))))
    return F.when(F.size(distinct) < F.size(keys), once).otherwise(m)


def parse_payload(c: ColumnOrName = "payload_json") -> Column:
    """JSON object text -> map; bad, empty or non-object text -> empty map, the last of a repeated key wins."""
    parsed = F.coalesce(F.from_json(col(c), PAYLOAD_TYPE), F.create_map().cast(PAYLOAD_TYPE))
    # a one-element array binds the parsed map, so that the text is parsed once
    return F.get(F.transform(F.array(parsed), _last_of_each_key), F.lit(0))


def parsed_once(df: DataFrame, payload: Column, out: str) -> DataFrame:
    """``df`` with a parsed payload as a column that is evaluated once per row, however many filters and columns use it.

    The outer generator is what keeps the optimizer from copying the parse into each of them.
    """
    return df.select("*", F.inline_outer(F.array(F.struct(payload.alias(out)))))


def payload_cells(df: DataFrame, payload: Column, *keep: str | Column, names: tuple[str, str] = ("key", "value")) -> DataFrame:
    """One row per entry of a payload, which is parsed once: an inner generator would have it evaluated again in a filter
    on its size.  Rows with an empty payload give none."""
    return df.select(*keep, F.explode_outer(payload).alias(*names)).where(F.col(names[0]).isNotNull())


#: Control keys of a form: kept by a submitted sheet up to the signature, never shown as data.
SIGNATURE_PREFIX, CORRECTION_KEYS = "__session_signature_", ("correction_reason", "save_mode")


def form_fields(form: ColumnOrName) -> Column:
    """Keep the submitted data keys: control keys (prefix ``__``), the save mode and the
    correction reason are dropped."""
    return F.map_filter(col(form), lambda k, _v: ~k.startswith("__") & ~k.isin(*CORRECTION_KEYS))


def submitted_fields(form: ColumnOrName) -> Column:
    """What a saved sheet stores of its form: all but the signature keys and the save mode."""
    return F.map_filter(col(form), lambda k, _v: ~k.startswith(SIGNATURE_PREFIX) & (k != "save_mode"))


def form_events(df: DataFrame, form_col: str = "form_json") -> DataFrame:
    """Submitted forms as input records: JSON text -> map of fields (last duplicate wins).

    ``save_mode`` is Complete only when the form says so, else Draft; ``form_save_mode`` is what
    the form says, Complete where it says nothing (filtration entries store that).
    """
    m = parse_payload(form_col)
    mode = F.when(F.col("__form").getItem("save_mode") == "Complete", F.lit("Complete")).otherwise(F.lit("Draft"))
    return df.withColumn("__form", m).select(*df.columns, mode.alias("save_mode"),
                                                 F.coalesce(F.col("__form").getItem("save_mode"), F.lit("Complete")).alias("form_save_mode"),
                                                 form_fields("__form").alias("fields"))

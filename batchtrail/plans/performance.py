"""Flagship O-RSH-8 ``machine_performance`` and its summaries (O-AGG-6/7/8).

machine -> source rows -> date range (pushed to the scan) -> point time ->
numeric parse -> point merge -> label -> wide-to-long.  Output is long: one row per
(point, metric) with a value; ``performance_points`` lists every point, also
those without a numeric value (the reference's point count).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchtrail.functions.labels import machine_key_py
from batchtrail.operators import readings as R
from batchtrail.sources.process_tables import ProcessTables
from batchtrail.sources.stages import EVAPORATION_FIELDS, EXTRACTION_FIELDS, FILTRATION_FIELDS, stage_titles

OUTPUT_COLUMNS = R.POINT_COLUMNS + ["field", "value"]


def _typed_rows(tables: ProcessTables, machine: str, start: str, end: str) -> tuple[DataFrame, list[str]]:
    if machine == "filtration":
        fields = [f for f, _ in FILTRATION_FIELDS]
        return R.filtration_readings(tables.filtration, tables.filtration_rows, fields, start, end), fields
    if machine == "evaporation":
        fields = [f for f, _ in EVAPORATION_FIELDS]
        return R.evaporation_readings(tables.evaporation, tables.evaporation_rows, tables.runs, fields,
                                      start, end), fields
    fields = [f for f, _ in EXTRACTION_FIELDS]
    return R.extraction_readings(tables.extraction, tables.runs, fields, start, end), fields


def machine_performance(tables: ProcessTables, machine: str, start: str = "", end: str = "") -> DataFrame:
    """Merged chart values of one machine: (point..., field, value)."""
    key = machine_key_py(machine)
    start, end = _date_args(start, end)
    if key in stage_titles():
        values = R.generic_values(tables.sheets, key, start, end)
    else:
        rows, fields = _typed_rows(tables, key, start, end)
        points = R.typed_points(R.merge_wide(rows, fields), key)
        present = [f for f in fields if f in points.columns]
        return points.unpivot(R.POINT_COLUMNS, present, "field", "value").filter(F.col("value").isNotNull())
    return R.point_merge(values, R.POINT_COLUMNS).select(*OUTPUT_COLUMNS)


def performance_points(tables: ProcessTables, machine: str, start: str = "", end: str = "") -> DataFrame:
    """Distinct chart points (x, label, identity) including points without values."""
    key = machine_key_py(machine)
    start, end = _date_args(start, end)
    if key in stage_titles():
        return R.generic_points(tables.sheets, key, start, end).select(*R.POINT_COLUMNS).dropDuplicates(R.POINT_COLUMNS)
    rows, _fields = _typed_rows(tables, key, start, end)
    keys = rows.select(*R.point_keys(rows))
    return R.typed_points(keys.distinct() if "ord" in rows.columns else keys, key).select(*R.POINT_COLUMNS)


def performance_summary(tables: ProcessTables, machine: str, start: str = "", end: str = "") -> DataFrame:
    """One row per metric: non-NULL count and chart axis range."""
    merged = machine_performance(tables, machine, start, end)
    return R.metric_summary(merged, ["machine"])


def _date_args(start: str, end: str) -> tuple[str, str]:
    """Keep only ``YYYY-MM-DD`` arguments, swap reversed bounds (O-SCL-9)."""
    import re
    ok = re.compile(r"^\d{4}-\d{2}-\d{2}$")
    start = (start or "").strip()
    end = (end or "").strip()
    start = start if ok.match(start) else ""
    end = end if ok.match(end) else ""
    if start and end and start > end:
        start, end = end, start
    return start, end

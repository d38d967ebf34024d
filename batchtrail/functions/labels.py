"""Display labels and small classifications (O-SCL-3/4/5/11..18/23..26/29/30)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from batchtrail.functions.text import ColumnOrName, clean, col, is_blank, nonblank, safe_filename, title_case
from batchtrail.sources.stages import ENTRY_TABLE_LABELS, EXPORT_SCOPES, PERFORMANCE_MACHINES


def literal_map(pairs) -> Column:
    """A ``map<string,string>`` literal from (key, value) pairs (small, plan-time)."""
    flat = []
    for k, v in pairs:
        flat += [F.lit(k), F.lit(v)]
    return F.create_map(*flat)


def run_label(run_number: ColumnOrName = "run_number", batch_number: ColumnOrName = "batch_number",
              run_id: ColumnOrName = "id") -> Column:
    """run number, else batch number, else the id, else ''."""
    rid = col(run_id)
    id_text = F.when(rid.isNotNull() & (rid != 0), rid.cast("string"))
    return F.coalesce(nonblank(run_number), nonblank(batch_number), id_text, F.lit(""))


def normalize_batch_type(c: ColumnOrName = "batch_type") -> Column:
    """SQL form: ``COALESCE(NULLIF(TRIM(x), ''), 'standard')`` (spaces only)."""
    return F.coalesce(F.nullif(F.trim(col(c)), F.lit("")), F.lit("standard"))


def normalized_run_ids(run_number: ColumnOrName = "run_number", batch_number: ColumnOrName = "batch_number"):
    """run and batch number default to each other (O-SCL-5)."""
    rn, bn = nonblank(run_number), nonblank(batch_number)
    return F.coalesce(rn, bn, F.lit("")), F.coalesce(bn, rn, F.lit(""))


def completion_status_py(c: ColumnOrName = "completion_status") -> Column:
    """Python rule: falsy ('' or NULL) -> Complete."""
    return F.coalesce(F.nullif(col(c), F.lit("")), F.lit("Complete"))


def completion_status_sql(c: ColumnOrName = "completion_status") -> Column:
    """SQL rule: only NULL -> Complete (T2)."""
    return F.coalesce(col(c), F.lit("Complete"))


def section_for_run(batch_type: ColumnOrName = "batch_type") -> Column:
    bt = F.lower(clean(batch_type))
    return F.when(bt == "blend", "blends").when(bt == "split", "splits").otherwise("runs")


def activity_is_active(section: ColumnOrName = "section", end_label: ColumnOrName = "end_label",
                       status: ColumnOrName = "status") -> Column:
    """Process sheets are active without an end time; others while the run is Open."""
    return (F.when(col(section).isin("Extraction", "Filtration", "Evaporation"), is_blank(end_label))
            .otherwise(clean(status) == "Open"))


def display_sheet_name(entry_table: ColumnOrName, section: ColumnOrName = None,
                       stage_title: ColumnOrName = None) -> Column:
    """stage title, else section, else table label, else title-cased table name."""
    table = col(entry_table)
    parts = []
    if stage_title is not None:
        parts.append(F.nullif(col(stage_title), F.lit("")))
    if section is not None:
        parts.append(F.nullif(col(section), F.lit("")))
    parts.append(F.element_at(literal_map(ENTRY_TABLE_LABELS), table))
    parts.append(title_case(F.replace(table, F.lit("_"), F.lit(" "))))
    return F.coalesce(*parts)


def user_initials(initials: ColumnOrName = "initials", employee: ColumnOrName = "employee_number") -> Column:
    return F.coalesce(F.nullif(col(initials), F.lit("")), F.upper(F.substring(col(employee), 1, 2)))


def user_label(full_name: ColumnOrName, employee: ColumnOrName, initials: ColumnOrName) -> Column:
    """name, else employee, else initials, else 'Unknown user'; '(employee)' and '- INITIALS' added."""
    emp = clean(employee)
    ini = F.upper(clean(initials))
    base = F.coalesce(nonblank(full_name), F.nullif(emp, F.lit("")), F.nullif(ini, F.lit("")), F.lit("Unknown user"))
    with_emp = F.when((emp != "") & (emp != base), F.concat(base, F.lit(" ("), emp, F.lit(")"))).otherwise(base)
    return F.when(ini != "", F.concat(with_emp, F.lit(" - "), ini)).otherwise(with_emp)


def captured_at(entry_date: ColumnOrName, entry_time: ColumnOrName) -> Column:
    """date and time joined by a space, blank parts skipped."""
    return clean(F.concat_ws(" ", nonblank(entry_date), nonblank(entry_time)))


def blank_stamp_display(value: ColumnOrName, entry_date: ColumnOrName, initials: ColumnOrName,
                        as_of_date: str | None = None) -> Column:
    """Saved value, or ``date | INITIALS`` when intentionally left blank.

    ``as_of_date`` plays the role of "today" in the Python form; without it the
    template form applies (no date fallback).
    """
    date_part = nonblank(entry_date)
    if as_of_date:
        date_part = F.coalesce(date_part, F.lit(as_of_date))
    stamp = F.concat_ws(" | ", date_part, F.nullif(F.upper(clean(initials)), F.lit("")))
    return F.when(is_blank(value), stamp).otherwise(clean(value))


def machine_key(c: ColumnOrName) -> Column:
    keys = [k for k, _ in PERFORMANCE_MACHINES]
    norm = F.lower(clean(c))
    return F.when(norm.isin(keys), norm).otherwise(F.lit("extraction"))


def machine_key_py(machine: str) -> str:
    """Plan-time form of :func:`machine_key` for a single argument."""
    norm = (machine or "").strip().lower()
    return norm if norm in {k for k, _ in PERFORMANCE_MACHINES} else "extraction"


def scope_label(c: ColumnOrName) -> Column:
    return F.coalesce(F.element_at(literal_map(EXPORT_SCOPES), clean(c)), F.lit("All Runs"))


def export_filename(date_prefix_col: Column, label: Column, run_id: ColumnOrName, ext: str = "json") -> Column:
    return F.concat(date_prefix_col, F.lit("_Run_"), safe_filename(label, "run"),
                    F.lit("_id-"), col(run_id).cast("string"), F.lit("." + ext))


def machine_label(base: str, suffix: ColumnOrName, sep: str = " - ") -> Column:
    """``base - suffix`` when the suffix is non-blank (spaces-only trim as in SQL)."""
    s = F.trim(F.coalesce(col(suffix), F.lit("")))
    return F.when(s != "", F.concat(F.lit(base + sep), s)).otherwise(F.lit(base))

"""Latest entry per key and the per-run review packet.

O-WIN-1..4 ``latest_*``, O-JOIN-8 ``run_packets``, O-JOIN-10
``voided_not_saved``, O-AGG-12 ``review_flags``, O-RSH-14 ``row_map``.

"Latest" is the highest id (T18), computed with ``max_by`` - a hash
aggregate with map-side partial aggregation, so a run with very many entries
is reduced before the shuffle instead of being sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchtrail.functions.labels import completion_status_py
from batchtrail.session import stored
from batchtrail.sources.stages import RUN_STAGE_KEYS, stage_titles
from batchtrail.sources.tables import parse_payload, payload_cells


def latest_by(df: DataFrame, keys: list[str], order: str = "id", columns: list[str] | None = None) -> DataFrame:
    """One row per key: the row with the greatest ``order`` value."""
    cols = columns or [c for c in df.columns if c not in keys]
    picked = F.max_by(F.struct(*cols), F.col(order)).alias("__l")
    return df.filter(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(picked).select(*keys, "__l.*")


def latest_extraction(extraction: DataFrame) -> DataFrame:
    return latest_by(extraction, ["run_id"])


def latest_filtration(filtration: DataFrame, rows: DataFrame) -> DataFrame:
    """Latest filtration entry per run with its child rows in (row_group, row_no) order."""
    head = latest_by(filtration, ["run_id"], columns=["id", "completion_status", "created_at"])
    kids = rows.join(head.select(F.col("id").alias("filtration_entry_id")), "filtration_entry_id", "left_semi")
    return head, kids.repartition("filtration_entry_id").sortWithinPartitions("filtration_entry_id", "row_group", "row_no", "id")


def latest_sheet_per_stage(sheets: DataFrame) -> DataFrame:
    return latest_by(sheets.filter(F.col("stage_key").isin(RUN_STAGE_KEYS)), ["run_id", "stage_key"])


def latest_filtration_draft(filtration: DataFrame) -> DataFrame:
    """Newest draft filtration entry over the whole table (one row)."""
    drafts = filtration.filter(F.coalesce(F.col("completion_status"), F.lit("Complete")) == "Draft")
    return drafts.agg(F.max_by(F.struct("id", "run_id", "created_at"), F.col("id")).alias("l")).select("l.*") \
        .filter(F.col("id").isNotNull())


def latest_standalone_drafts(sheets: DataFrame) -> DataFrame:
    """Newest draft per stage among sheets saved without a run."""
    drafts = sheets.filter(F.col("run_id").isNull()
                           & (F.coalesce(F.col("completion_status"), F.lit("Complete")) == "Draft"))
    return drafts.groupBy("stage_key").agg(F.max_by(F.struct("id", "created_at"), F.col("id")).alias("l")) \
        .select("stage_key", "l.*")


def run_packets(runs: DataFrame, extraction: DataFrame, filtration: DataFrame, sheets: DataFrame,
                voided: DataFrame) -> DataFrame:
    """Flat review packet: one row per (run, part) for every run with something to show.

    Parts: ``extraction`` and ``filtration`` (latest entry), ``sheet`` (latest per
    stage, unless the stage is voided and that entry is not Complete - T17) and
    ``voided`` (voided stages without a surviving saved sheet).  Evaporation is
    never in a packet (T6).
    """
    ext = latest_by(extraction, ["run_id"], columns=["id"]).select(
        "run_id", F.lit("extraction").alias("part"), F.lit("").alias("stage_key"), F.col("id").alias("entry_id"),
        F.lit("Complete").alias("completion_status"), F.lit(None).cast("string").alias("voided_by"))
    fil = latest_by(filtration, ["run_id"], columns=["id", "completion_status"]).select(
        "run_id", F.lit("filtration").alias("part"), F.lit("").alias("stage_key"), F.col("id").alias("entry_id"),
        completion_status_py().alias("completion_status"), F.lit(None).cast("string").alias("voided_by"))
    # the sheets' content stays out of the aggregation, and marks and kept sheets are computed once for both of their parts
    voided = stored(voided.select("run_id", "stage_key", "voided_by"), "packet_voided")
    latest = latest_by(sheets.filter(F.col("stage_key").isin(RUN_STAGE_KEYS)), ["run_id", "stage_key"], columns=["id", "completion_status"]).select(
        "run_id", "stage_key", "id", completion_status_py().alias("st"))
    v = voided.select("run_id", "stage_key", "voided_by").withColumn("is_void", F.lit(True))
    lv = latest.join(v, ["run_id", "stage_key"], "left")
    saved = stored(lv.filter(~(F.coalesce(F.col("is_void"), F.lit(False)) & (F.col("st") != "Complete"))).drop("voided_by", "is_void"), "packet_saved")
    sheet_part = saved.select("run_id", F.lit("sheet").alias("part"), "stage_key", F.col("id").alias("entry_id"),
                              F.col("st").alias("completion_status"), F.lit(None).cast("string").alias("voided_by"))
    void_part = voided_not_saved(voided, saved.select("run_id", "stage_key")).select(
        "run_id", F.lit("voided").alias("part"), "stage_key", F.lit(None).cast("long").alias("entry_id"),
        F.lit(None).cast("string").alias("completion_status"), "voided_by")
    # written, so that the runs are met once and not in every part; ids compress to next to nothing, so that by their
    # bytes alone far too many would be sorted in one task
    parts = stored(ext.unionByName(fil).unionByName(sheet_part).unionByName(void_part), "packet_parts")
    known = runs.select(F.col("id").alias("run_id")).repartition(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "run_id")
    return parts.join(known, "run_id", "left_semi")


def voided_not_saved(voided: DataFrame, saved_keys: DataFrame) -> DataFrame:
    """Voided run-linked stages with no surviving saved sheet (anti join)."""
    v = voided.filter(F.col("stage_key").isin(RUN_STAGE_KEYS))
    return v.join(saved_keys, ["run_id", "stage_key"], "left_anti")


def review_flags(packets: DataFrame) -> DataFrame:
    """has_entries / has_complete_entries per run (O-AGG-12)."""
    return packets.groupBy("run_id").agg(
        F.lit(True).alias("has_entries"),
        F.bool_or((F.col("part") == "sheet") & (F.col("completion_status") == "Complete")).alias("has_complete_entries"))


def row_map(rows: DataFrame, entry_col: str = "filtration_entry_id") -> DataFrame:
    """Child rows under their key ``{group}_{row_no}`` (O-RSH-14), one flat row per entry and key; the highest id wins."""
    key = F.concat(F.coalesce(F.nullif(F.col("row_group"), F.lit("")), F.lit("main")), F.lit("_"), F.col("row_no").cast("string"))
    others = [c for c in rows.columns if c != entry_col]
    keyed = rows.select(entry_col, key.alias("key"), F.struct(*others).alias("v"))
    return (keyed.groupBy(entry_col, "key").agg(F.max_by("v", F.col("v.id")).alias("v"))
            .select(entry_col, "key", *[F.col(f"v.{c}").alias(c) for c in others]))


# ------------------------------------------------------------ packet content

def _titled(stage: str = "stage_key"):
    titles = F.create_map(*[x for k, t in stage_titles().items() for x in (F.lit(k), F.lit(t))])
    return F.coalesce(F.try_element_at(titles, F.col(stage)), F.col(stage)).alias("stage_title")


SHEET_CONTENT = ["id", "employee", "operator_initials", "entry_date", "comments", "payload_json", "completion_status",
                 "version_no", "created_at"]


def packet_sheets(sheets: DataFrame, voided: DataFrame) -> DataFrame:
    """Content of the sheets shown in a packet: the latest per (run, stage), unless voided and not Complete (T17)."""
    latest = latest_by(sheets.filter(F.col("stage_key").isin(RUN_STAGE_KEYS)), ["run_id", "stage_key"], columns=SHEET_CONTENT)
    marks = voided.select("run_id", "stage_key", F.lit(True).alias("__void"))
    kept = (latest.withColumn("completion_status", completion_status_py()).join(marks, ["run_id", "stage_key"], "left")
            .filter(F.col("__void").isNull() | (F.col("completion_status") == "Complete")))
    return kept.select("run_id", "stage_key", _titled(), F.col("id").alias("entry_id"), *SHEET_CONTENT[1:])


def packet_cells(packet_sheet_rows: DataFrame) -> DataFrame:
    """One row per payload field of the packet's sheets: ``(run_id, stage_key, entry_id, key, value)``."""
    return payload_cells(packet_sheet_rows, parse_payload("payload_json"), "run_id", "stage_key", "entry_id")


def packet_voided(voided: DataFrame, packet_sheet_rows: DataFrame) -> DataFrame:
    """Voided stages without a shown sheet, with title, author and time."""
    return voided_not_saved(voided, packet_sheet_rows.select("run_id", "stage_key")).select(
        "run_id", "stage_key", _titled(), "voided_by", "voided_at")


def packet_rows(filtration: DataFrame, rows: DataFrame) -> DataFrame:
    """All columns of the child rows of each run's newest filtration entry, one flat row each."""
    newest = (filtration.filter(F.col("run_id").isNotNull()).groupBy("run_id")
              .agg(F.max("id").alias("filtration_entry_id")))
    return rows.join(newest, "filtration_entry_id").select("run_id", *rows.columns)

"""Structured Streaming re-aims of the polled dashboards (O-STR-1..3).

The reference re-queries the last N hours on every page view.  Here the
entry tables are streams of appended files:

* ``activity_stream`` (O-STR-1): the four entry streams unioned, each entry of
  any age once (its key is looked up in the state store, no sink is read), a
  left join to runs, written idempotently by month.
* ``machine_status_stream`` (O-STR-2): one state row per machine section; an
  event-time timer turns its card back to "Not Used" after 12 hours.
* ``draft_fold_stream`` (O-STR-3): the state of a key is its open draft and the
  submits that late ones may still precede; closed entries are never read again.

The stateful jobs keep their state in RocksDB.  Sinks are folders with one
subfolder per micro-batch, so a repeated batch replaces what it wrote before;
the readers (``machine_cards``, ``folded_entries``) take the newest row of a
key.  All sinks and checkpoints live under caller-given shared paths.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from batchtrail.functions.labels import activity_is_active, run_label
from batchtrail.functions.time import stamp_to_timestamp
from batchtrail.operators.lifecycle import COMPLETE, fold_drafts
from batchtrail.operators.sequence import sequence_within
from batchtrail.session import ship_package
from batchtrail.sources.sinks import read_if_there
from batchtrail.sources.stages import STATUS_MACHINES, UNUSED_MACHINE
from batchtrail.sources.tables import SCHEMAS

ENTRY_STREAMS = {
    # table -> (section literal or None = stage title, start label column, end label column)
    "extraction_entries": ("Extraction", "start_time", "stop_time"),
    "filtration_entries": ("Filtration", "startup_time", "shutdown_time"),
    "evaporation_entries": ("Evaporation", "startup_time", "shutdown_time"),
    "sheet_entries": (None, None, None),
}

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _rocksdb(spark: SparkSession):
    """A query takes its state store from the settings at its start; its Python workers get this package."""
    ship_package(spark)
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def _add_batch(path: str, *folders: str):
    """A micro-batch into folders of its own below ``folders``."""
    def add(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*folders, "batch_id").parquet(path))
    return add


def _event_ms(stamp: str) -> Column:
    return F.unix_millis(stamp_to_timestamp(stamp).cast("timestamp"))


# ------------------------------------------------------------------- activity

def entry_stream(spark: SparkSession, root: str, table: str, max_files: int | None = None) -> DataFrame:
    """One entry table as a file stream with its declared schema."""
    reader = spark.readStream.schema(SCHEMAS[table])
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(f"{root}/{table}")


def activity_events(spark: SparkSession, root: str, max_files: int | None = None) -> DataFrame:
    """The four entry streams in the feed's shape with an event-time column."""
    parts = []
    for table, (section_name, start, end) in ENTRY_STREAMS.items():
        s = entry_stream(spark, root, table, max_files)
        section = F.lit(section_name) if section_name else F.col("stage_title")
        stage_key = F.lit("") if section_name else F.col("stage_key")
        parts.append(s.select(
            F.col("id").alias("record_id"), F.col("run_id").alias("entry_run_id"), F.lit(table).alias("entry_table"),
            F.col("created_at").alias("activity_time"), section.alias("section"), stage_key.alias("stage_key"),
            "employee", "operator_initials", "comments",
            (F.col(start) if start else F.lit("")).alias("start_label"),
            (F.col(end) if end else F.lit("")).alias("end_label")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    # zoned event time; null for a blank or unreadable stamp
    return u.withColumn("event_ts", stamp_to_timestamp("activity_time").cast("timestamp"))


def activity_stream(spark: SparkSession, root: str, runs: DataFrame, sink: str, checkpoint: str):
    """Start O-STR-1; returns the StreamingQuery (``availableNow`` trigger).

    Entries of any age are delivered, each key once, also where an entry comes
    again with another stamp: the keys delivered so far are state.  Entries
    without a stamp go to the month 'undated'.
    """
    r = runs.select(F.col("id").alias("run_id"), "run_number", "batch_number", "blend_number", "split_batch_number",
                    "status")
    events = activity_events(spark, root).dropDuplicates(["entry_table", "record_id"])
    feed = events.join(r, events["entry_run_id"] == r["run_id"], "left").drop("entry_run_id")
    month = F.coalesce(F.date_format("event_ts", "yyyy-MM"), F.lit("undated"))
    with _rocksdb(spark):
        return (feed.withColumn("feed_month", month).writeStream.foreachBatch(_add_batch(sink, "feed_month"))
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


# ------------------------------------------------------------- machine status

CARD_SCHEMA = "section string, title string, status_label string, detail string, is_active boolean"
_LATEST = ["activity_time", "entry_table", "record_id"]


def _newest_per_section(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each task passes its newest entry of every section on, so that a busy section is no hot key."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        table = pa.Table.from_batches([*kept, batch])
        order = pc.sort_indices(table, sort_keys=[("section", "ascending"), *[(c, "descending") for c in _LATEST]])
        section = table["section"].combine_chunks().take(order).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        first = np.concatenate(([True], section[1:] != section[:-1])) if len(section) else np.zeros(0, dtype=bool)
        kept = table.take(order.filter(pa.array(first))).combine_chunks().to_batches()
    yield from kept


class StatusCards(StatefulProcessor):
    """Card of a section from its newest entry; a timer ends it ``hours`` after that entry."""

    def __init__(self, hours: int):
        self.window_ms = hours * 3_600_000

    def init(self, handle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "activity_time string, entry_table string, record_id bigint, event_ms bigint")

    def _card(self, section: str, label: str | None, at: str | None, active: bool) -> pd.DataFrame:
        detail = UNUSED_MACHINE if at is None else " | ".join(([f"Run {label}"] if label else []) + [at])
        status = "Not Used" if at is None else "In Use" if active else "Recently Used"
        return pd.DataFrame({"section": [section], "title": [dict(STATUS_MACHINES)[section]], "status_label": [status],
                             "detail": [detail], "is_active": [active]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.latest.get() if self.latest.exists() else None
        best = None
        for frame in rows:
            row = frame.sort_values(_LATEST).iloc[-1]
            if best is None or tuple(row[_LATEST]) > tuple(best[_LATEST]):
                best = row
        if best is None or (held is not None and tuple(best[_LATEST]) < tuple(held[:3])):
            return
        ends = int(best["event_ms"]) + self.window_ms
        if ends < timerValues.getCurrentWatermarkInMs():
            return  # over before it arrived
        if held is not None:
            self.handle.deleteTimer(held[3] + self.window_ms + 1)
        self.latest.update((best["activity_time"], best["entry_table"], int(best["record_id"]), int(best["event_ms"])))
        self.handle.registerTimer(ends + 1)
        yield self._card(key[0], best["run_label"], best["activity_time"], bool(best["active"]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.latest.exists() and self.latest.get()[3] + self.window_ms + 1 <= expiredTimerInfo.getExpiryTimeInMs():
            self.latest.clear()
            yield self._card(key[0], None, None, False)

    def close(self) -> None:
        pass


def machine_status_stream(spark: SparkSession, root: str, runs: DataFrame, sink: str, checkpoint: str, hours: int = 12,
                          delay: str = "10 minutes", max_files: int | None = None):
    """Start O-STR-2: status cards of the machines, each change a row of ``sink`` (read them by ``machine_cards``).

    Time is the newest activity seen less ``delay``.  The state is one row per
    section with activity in the last ``hours``; when that time has passed the
    card of the section becomes "Not Used".  Entries without a readable stamp are
    in no window.
    """
    sections = [s for s, _ in STATUS_MACHINES]
    # the watermark column itself is not passed on: no row is dropped for being late
    events = (activity_events(spark, root, max_files).withWatermark("event_ts", delay)
              .select("section", "activity_time", "entry_table", F.coalesce("record_id", F.lit(0)).alias("record_id"), "entry_run_id", "end_label",
                      _event_ms("activity_time").alias("event_ms"))
              .where(F.col("section").isin(sections) & F.col("event_ms").isNotNull()))
    schema = events.schema
    newest = events.mapInArrow(_newest_per_section, schema)
    r = runs.select(F.col("id").alias("run_id"), "run_number", "batch_number", "status")
    known = newest.join(r, newest["entry_run_id"] == r["run_id"], "left").select(
        "section", *_LATEST, "event_ms", run_label("run_number", "batch_number", "run_id").alias("run_label"),
        F.coalesce(activity_is_active(), F.lit(False)).alias("active"))
    cards = known.groupBy("section").transformWithStateInPandas(StatusCards(hours), CARD_SCHEMA, "Update", "eventTime")
    with _rocksdb(spark):
        return (cards.writeStream.outputMode("update").foreachBatch(_add_batch(sink)).option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start())


def machine_cards(spark: SparkSession, sink: str) -> DataFrame:
    """The cards of all machines as the stream left them, in the columns of ``machine_status``; no activity yet is "Not Used"."""
    machines = spark.createDataFrame(STATUS_MACHINES, "section string, title string")
    rows = read_if_there(spark.read.schema(CARD_SCHEMA + ", batch_id long").format("parquet"), sink)
    if rows is None:
        rows = spark.createDataFrame([], CARD_SCHEMA + ", batch_id long")
    # a timer and new entries of one batch: the card with an activity stands
    order = F.struct("batch_id", (F.col("status_label") != "Not Used").alias("used"), "detail")
    last = rows.groupBy("section").agg(F.max_by(F.struct("status_label", "detail", "is_active"), order).alias("c"))
    return machines.join(last, "section", "left").select(
        "section", "title", F.coalesce("c.status_label", F.lit("Not Used")).alias("status_label"),
        F.coalesce("c.detail", F.lit(UNUSED_MACHINE)).alias("detail"), F.coalesce("c.is_active", F.lit(False)).alias("is_active"))


# ------------------------------------------------------------------ draft fold

SUBMIT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("run_id", T.LongType()),
    T.StructField("stage_key", T.StringType()), T.StructField("save_mode", T.StringType()),
    T.StructField("submitted_at", T.StringType()), T.StructField("employee", T.StringType()),
])

_KEYS = ["run_id", "stage_key"]
_ENTRY = ["entry_id", "version_no", "completion_status", "created_at", "updated_at", "employee"]
_CHANGE = ("op string, entry_id long, version_no int, completion_status string, created_at string, updated_at string, "
           "employee string")
FOLD_SCHEMA = "run_id long, stage_key string, " + _CHANGE
#: Stamps whose text order is their time order; others are folded by ``folded_entries``.
_NO_TIME = -(1 << 62)
_PLAIN_STAMP = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d$"


def _text(value) -> str | None:
    return value if isinstance(value, str) else None


def _next_entries(draft: tuple | None, submits: list[tuple]) -> list[tuple]:
    """Entries (``_ENTRY`` and the last submit's id) after ``submits`` (stamp, id, mode, employee) in order."""
    entries = [] if draft is None else [draft]
    for at, event_id, mode, employee in submits:
        if entries and entries[-1][2] != COMPLETE:
            first, version, _, created = entries[-1][:4]
            entries[-1] = (first, version + 1, mode, created, at, employee, event_id)
        else:
            entries.append((event_id, 1, mode, at, at, employee, event_id))
    return entries


class DraftFold(StatefulProcessor):
    """Fold of one key's submits.

    State: the open draft, and the submits after it that are newer than the
    watermark, since a late one may still come before them.  A timer folds these
    into the draft when the watermark has passed them; a Complete leaves nothing
    behind.  A submit older than what is folded already cannot be placed without
    the closed history; it goes out as 'late'.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.draft = handle.getValueState("draft", "entry_id bigint, version_no int, completion_status string, created_at string, "
                                                   "updated_at string, employee string, last_id bigint")
        self.pending = handle.getMapState("pending", "event_id bigint", "submitted_at string, save_mode string, employee string, event_ms bigint")

    def _state(self) -> tuple[tuple | None, dict[int, tuple]]:
        draft = tuple(self.draft.get()) if self.draft.exists() else None
        waiting = {k[0]: tuple(v) for k, v in self.pending.iterator()} if self.pending.exists() else {}
        return draft, waiting

    @staticmethod
    def _ordered(waiting: dict[int, tuple]) -> list[tuple]:
        return sorted((at, event_id, mode, employee) for event_id, (at, mode, employee, _) in waiting.items())

    def _seal(self, draft: tuple | None, waiting: dict[int, tuple], watermark: int) -> None:
        """Folds what the watermark has passed into the draft and asks for a call when it passes the next."""
        passed = {k: v for k, v in waiting.items() if v[3] <= watermark}
        if passed:
            entries = _next_entries(draft, self._ordered(passed))
            if entries[-1][2] == COMPLETE:
                self.draft.clear()
            else:
                self.draft.update(entries[-1])
            for event_id in passed:
                self.pending.removeKey((event_id,))
        rest = [v[3] for k, v in waiting.items() if k not in passed]
        if rest:
            self.handle.registerTimer(min(rest) + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        draft, waiting = self._state()
        before = {e[0]: e[:6] for e in _next_entries(draft, self._ordered(waiting))}
        late = []
        for frame in rows:
            for event_id, mode, at, employee, ms in zip(frame["event_id"], frame["save_mode"], frame["submitted_at"], frame["employee"], frame["event_ms"]):
                submit, event_id = (_text(at), _text(mode), _text(employee), int(ms)), int(event_id)
                if ms == _NO_TIME:
                    late.append((event_id, submit))
                    continue
                place = (submit[0], event_id)
                if draft is not None and place == (draft[4], draft[6]):
                    continue  # the draft's last submit again
                if submit[3] <= watermark and (draft is None or place < (draft[4], draft[6])):
                    late.append((event_id, submit))
                elif event_id not in waiting:
                    waiting[event_id] = submit
                    self.pending.updateValue((event_id,), submit)
        after = {e[0]: e[:6] for e in _next_entries(draft, self._ordered(waiting))}
        out = [("upsert", *e) for i, e in after.items() if before.get(i) != e]
        out += [("remove", *before[i]) for i in before if i not in after]
        out += [("late", event_id, None, mode, at, at, employee) for event_id, (at, mode, employee, _) in late]
        self._seal(draft, waiting, watermark)
        if out:
            frame = pd.DataFrame(out, columns=["op", *_ENTRY])
            frame.insert(0, "fold_key", key[0])
            yield frame.astype({"version_no": "Int32"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._seal(*self._state(), timerValues.getCurrentWatermarkInMs())
        yield from ()

    def close(self) -> None:
        pass


def draft_fold_stream(spark: SparkSession, submits_dir: str, entries_path: str, checkpoint: str, lateness: str = "7 days",
                      max_files_per_trigger: int | None = None):
    """Start O-STR-3: changes of the folded sheet entries as submits arrive (read them by ``folded_entries``).

    Submits may come in any order and repeatedly; those up to ``lateness`` older
    than the newest are folded in place.  No earlier submit or entry is read: the
    state rows are the open drafts and the keys with submits of the last
    ``lateness``.  Rows of ``entries_path`` are folders ``op=upsert`` (an entry as it
    is now), ``op=remove`` (an entry that a late submit joined to another) and
    ``op=late`` (submits older than that, or without a readable stamp or an id).
    """
    reader = spark.readStream.schema(SUBMIT_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    # the watermark column itself is not passed on: late submits reach the fold
    # numbers go to Python without NULLs (a column with NULLs would come as floats), the key as one text
    ms = F.coalesce(F.when(F.col("submitted_at").rlike(_PLAIN_STAMP) & F.col("event_id").isNotNull(), _event_ms("submitted_at")), F.lit(_NO_TIME))
    submits = (reader.parquet(submits_dir).withColumn("event_ts", stamp_to_timestamp("submitted_at").cast("timestamp"))
               .withWatermark("event_ts", lateness)
               .select(F.to_json(F.struct(*_KEYS)).alias("fold_key"), F.coalesce("event_id", F.lit(0)).alias("event_id"), "save_mode",
                       "submitted_at", "employee", ms.alias("event_ms")))
    folded = submits.groupBy("fold_key").transformWithStateInPandas(DraftFold(), "fold_key string, " + _CHANGE, "Update", "eventTime")
    keys = F.from_json("fold_key", "run_id long, stage_key string")
    changes = folded.select(*[keys[k].alias(k) for k in _KEYS], *[c.split()[0] for c in _CHANGE.split(", ")])
    with _rocksdb(spark):
        return (changes.writeStream.outputMode("update").foreachBatch(_add_batch(entries_path, "op"))
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def folded_entries(spark: SparkSession, entries_path: str, submits_dir: str) -> DataFrame:
    """The entries that the stream has folded, in the columns of ``fold_drafts``.

    An entry is its newest row.  Only keys with submits that came too late are
    folded anew, from their own submits.
    """
    rows = spark.read.schema(FOLD_SCHEMA + ", batch_id long").parquet(entries_path)
    changes = rows.where("op <> 'late'").withColumn("at", F.struct("batch_id", (F.col("op") == "upsert").alias("kept")))
    newest = (changes.groupBy(*_KEYS, "entry_id").agg(F.max_by(F.struct("op", *_ENTRY[1:]), F.col("at")).alias("e"))
              .where("e.op = 'upsert'").select(*_KEYS, "entry_id", *[f"e.{c}" for c in _ENTRY[1:]]))
    late = rows.where("op = 'late'").select(*[F.col(k).alias(f"late_{k}") for k in _KEYS]).distinct()
    same = F.lit(True)
    for k in _KEYS:
        same = same & F.col(k).eqNullSafe(F.col(f"late_{k}"))
    kept = newest.join(late, same, "left_anti")
    # a submit delivered twice has one id; submits without an id are all kept
    submits = spark.read.schema(SUBMIT_SCHEMA).parquet(submits_dir).join(late, same, "left_semi")
    once = submits.where("event_id IS NOT NULL").dropDuplicates(["event_id"]).unionByName(submits.where("event_id IS NULL"))
    numbered = sequence_within(kept, _KEYS, [F.col("created_at"), F.col("entry_id")], "entry_no")
    again = fold_drafts(once, _KEYS)
    return numbered.withColumn("entry_no", (F.col("entry_no") - 1).cast("long")).select(*again.columns).unionByName(again)

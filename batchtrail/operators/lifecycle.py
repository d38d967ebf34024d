"""Record lifecycle as folds over append-only logs (O-STATE-1..11).

The reference mutates rows one request at a time.  Here each rule is a
deterministic function of an ordered log, computed with partitioned windows
and aggregations; a hot key is spread over partitions by its order (``running_sum_within``).
Checks that the reference makes against the live database are made against
the snapshot given to the job.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchtrail.functions.labels import run_label
from batchtrail.functions.text import clean, nonblank
from batchtrail.operators.joins import sifted
from batchtrail.operators.latest import latest_by
from batchtrail.operators.sequence import assign_ids, running_max_within, running_sum_within
from batchtrail.session import ship_package, stored
from batchtrail.sources.stages import (CLOSED_BY_REVIEW, CLOSED_QUICKLY, COPIED_FROM, LINKED_TO, RUN_STAGE_KEYS,
                                        stage_titles)
from batchtrail.sources.tables import parse_payload, submitted_fields

COMPLETE, DRAFT = "Complete", "Draft"


# ------------------------------------------------------------- O-STATE-1/2

def submit_islands(submits: DataFrame, keys: list[str], ts: str = "submitted_at", seq: str = "event_id") -> DataFrame:
    """Tag each submit with its entry number: Completes strictly before it in the key (gaps and islands)."""
    is_complete = (F.col("save_mode") == COMPLETE).cast("int")
    return running_sum_within(submits, keys, [F.col(ts), F.col(seq)], is_complete, "entry_no", inclusive=False)


def fold_drafts(submits: DataFrame, keys: list[str] | None = None, ts: str = "submitted_at",
                seq: str = "event_id", content: tuple[str, ...] = ()) -> DataFrame:
    """Sheet entries produced by a submit log (O-STATE-1).

    A submit updates the key's latest entry while it is a Draft, else creates a
    new one; a Complete submit closes the entry.  Version = submits folded in.
    ``keys`` = (run_id, stage_key) for run-linked sheets, (stage_key) for
    standalone sheets, () for the global filtration draft.  The ``content``
    columns are those of the entry's last submit.
    """
    keys = ["run_id", "stage_key"] if keys is None else keys
    tagged = submit_islands(submits, keys, ts, seq)
    order = F.struct(F.col(ts), F.col(seq))
    return tagged.groupBy(*keys, "entry_no").agg(
        F.min_by(F.col(seq), order).alias("entry_id"),
        F.count(F.lit(1)).cast("int").alias("version_no"),
        F.max_by("save_mode", order).alias("completion_status"),
        F.min(ts).alias("created_at"), F.max(ts).alias("updated_at"),
        F.max_by("employee", order).alias("employee"),
        *([F.max_by(F.struct(*content), order).alias("__content")] if content else [])
    ).select("*", *[F.col(f"__content.{c}").alias(c) for c in content]).drop("__content")


SHEET_CONTENT = ("stage_title", "operator_initials", "entry_date", "comments", "payload_json")


def saved_sheets(submits: DataFrame, form: str = "form_json") -> DataFrame:
    """Sheet entries with their content from a log of submitted forms (O-STATE-1).

    ``submits`` are the columns of ``fold_drafts`` and the form's JSON text; the
    stored payload is the form without the signature keys and the save mode.
    """
    fields = [c for c in submits.columns if c != form]
    m = F.col("__m")
    text = lambda key: F.coalesce(m.getItem(key), F.lit("")).alias(key)
    titles = F.create_map(*[x for k, t in stage_titles().items() for x in (F.lit(k), F.lit(t))])
    filled = submits.withColumn("__m", parse_payload(form)).select(
        *fields, F.coalesce(F.try_element_at(titles, F.col("stage_key")), F.lit("")).alias("stage_title"),
        F.upper(F.trim(F.coalesce(m.getItem("operator_initials"), F.lit("")))).alias("operator_initials"),
        text("entry_date"), text("comments"), F.to_json(submitted_fields(m)).alias("payload_json"))
    return fold_drafts(filled, content=SHEET_CONTENT)


def audit_entries(submits: DataFrame, keys: list[str] | None = None, ts: str = "submitted_at",
                  seq: str = "event_id", table: str = "sheet_entries", title: str | None = None) -> DataFrame:
    """Audit rows of a submit log: create / update with the reference's wording (O-STATE-2, O-SNK-3).

    ``table`` and ``title`` name what is saved where it is no stage sheet: filtration
    saves are audited under their own table and by the word 'filtration'.
    """
    keys = ["run_id", "stage_key"] if keys is None else keys
    tagged = submit_islands(submits, keys, ts, seq)
    order = F.struct(F.col(ts), F.col(seq))
    first = tagged.groupBy(*keys, "entry_no").agg(F.min_by(F.col(seq), order).alias("record_id"))
    j = tagged.join(first, [*keys, "entry_no"])
    titles = F.create_map(*[x for k, t in stage_titles().items() for x in (F.lit(k), F.lit(t))])
    title = F.lit(title) if title else F.coalesce(F.try_element_at(titles, F.col("stage_key")), F.col("stage_key"))
    created = F.col(seq) == F.col("record_id")
    mode = F.lower(F.col("save_mode"))
    text = F.when(created, F.concat(title, F.lit(" entry created as "), mode)) \
        .otherwise(F.concat(title, F.lit(" entry saved as "), mode))
    return j.select(F.lit(table).alias("table_name"), "record_id",
                    F.when(created, "create").otherwise("update").alias("action_type"),
                    F.col("employee").alias("changed_by"), F.lit("").alias("old_data"), text.alias("new_data"),
                    F.col(ts).alias("created_at"), F.col(seq).alias("event_id"))


# --------------------------------------------------------------- O-STATE-3

def void_state(log: DataFrame, auto_unvoid: bool = True, ts: str = "logged_at", seq: str = "event_id") -> DataFrame:
    """Voided (run, stage) keys after a log of toggles and Complete saves.

    A toggle flips the mark; a Complete save un-voids (it toggles only when
    voided).  So the state is the parity of toggles after the last Complete
    save; the mark's author/time is the last toggle's.  Two aggregations, no
    per-key sort.
    """
    order = F.struct(F.col(ts), F.col(seq))
    toggles = log.filter(F.col("action") == "toggle")
    if auto_unvoid:
        resets = (log.filter(F.col("action") == "complete_save").groupBy("run_id", "stage_key")
                  .agg(F.max(order).alias("__reset")))
        toggles = (toggles.join(resets, ["run_id", "stage_key"], "left")
                   .filter(F.col("__reset").isNull() | (order > F.col("__reset"))).drop("__reset"))
    agg = toggles.groupBy("run_id", "stage_key").agg(
        F.count(F.lit(1)).alias("__n"), F.max_by(F.struct(F.trim(F.col("actor")).alias("voided_by"),
                                                         F.col(ts).alias("voided_at")), order).alias("__last"))
    return agg.filter(F.col("__n") % 2 == 1).select("run_id", "stage_key", "__last.voided_by", "__last.voided_at")


# --------------------------------------------------------------- O-STATE-4

def field_changes(forms: DataFrame, sub: str = "submission_id") -> tuple[DataFrame, DataFrame]:
    """Diff correction forms against saved values.

    ``forms`` has one row per submitted field: (submission, field_name,
    old_value, new_value, initials[, original, corrected]).  Trimmed equal
    values are no change (T20); a changed field without initials rejects the
    whole submission.  Returns (accepted change rows, missing-initials rows).
    """
    new, old = clean("new_value"), clean("old_value")
    original = F.coalesce(nonblank("original_value"), old) if "original_value" in forms.columns else old
    corrected = F.coalesce(nonblank("corrected_value"), new) if "corrected_value" in forms.columns else new
    changed = forms.filter(new != old).select(
        sub, "field_name", new.alias("field_value"), original.alias("original_value"),
        corrected.alias("corrected_value"), F.upper(clean("initials")).alias("change_initials"))
    missing = changed.filter(F.col("change_initials") == "")
    bad = missing.select(sub).distinct()
    accepted = changed.join(bad, sub, "left_anti")
    return accepted, missing.select(sub, "field_name")


def saved_values(sheets: DataFrame) -> DataFrame:
    """What a sheet's correction form is compared with: its payload, header columns first (``old_values``)."""
    header = ["comments", "entry_date", "operator_initials"]
    payload = F.map_filter(parse_payload("payload_json"), lambda k, _v: ~k.isin(*header))
    columns = F.map_from_arrays(F.array(*[F.lit(h) for h in header]), F.array(*header))
    return sheets.select(F.lit("sheet_entries").alias("entry_table"), F.col("id").alias("record_id"), "run_id",
                         F.map_concat(payload, columns).alias("old_values"))


def corrections_from_forms(forms: DataFrame, saved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Correction log rows of raw correction forms, and the changed fields that lack initials (O-STATE-4, O-SNK-4).

    ``forms``: submission_id, entry_table, record_id, form_json, employee,
    submitted_at; ``saved``: entry_table, record_id, run_id, old_values.  A form
    is compared inside its own row, so only changed fields are exploded and a
    form with a field that lacks initials is refused without a further join.
    Forms of unknown entries give nothing.
    """
    m = F.col("__m")
    control = ("__change__", "__original__", "__corrected__", "__session_signature_")

    def is_data(key: Column) -> Column:
        keep = key != "correction_reason"
        for prefix in control:
            keep = keep & ~key.startswith(prefix)
        return keep

    def side(prefix: str, key: Column) -> Column:
        return clean(F.try_element_at(m, F.concat(F.lit(prefix), key)))

    def change(e: Column) -> Column:
        new, old = clean(e["value"]), clean(F.try_element_at(F.col("old_values"), e["key"]))
        return F.struct(e["key"].alias("field_name"), new.alias("field_value"), old.alias("old_value"),
                        F.coalesce(F.nullif(side("__original__", e["key"]), F.lit("")), old).alias("original_value"),
                        F.coalesce(F.nullif(side("__corrected__", e["key"]), F.lit("")), new).alias("corrected_value"),
                        F.upper(side("__change__", e["key"])).alias("change_initials"))

    j = forms.join(saved, ["entry_table", "record_id"]).withColumn("__m", parse_payload("form_json"))
    cells = F.filter(F.map_entries(m), lambda e: is_data(e["key"]))
    changes = F.filter(F.transform(cells, change), lambda c: c["field_value"] != c["old_value"])
    diff = j.select("submission_id", "run_id", "entry_table", "record_id", clean(F.try_element_at(m, F.lit("correction_reason"))).alias("correction_reason"),
                    F.col("employee").alias("changed_by_employee"), F.col("submitted_at").alias("created_at"), changes.alias("__c"))
    # the outer generators keep the optimizer from evaluating the comparison again in a filter below them
    lacking = lambda c: c["change_initials"] == ""
    complete = F.when(~F.exists("__c", lacking), F.col("__c"))
    accepted = diff.select("*", F.inline_outer(complete)).filter(F.col("field_name").isNotNull()).drop("__c", "old_value")
    names = F.transform(F.filter("__c", lacking), lambda c: c["field_name"])
    return accepted, diff.select("submission_id", F.explode_outer(names).alias("field_name")).filter(F.col("field_name").isNotNull())


# --------------------------------------------------------------- O-STATE-5

def _reviewable(requests: DataFrame, sheets: DataFrame) -> DataFrame:
    """Requests at whose time some stage of the run had a Complete latest sheet (highest id saved until then).

    Requests and sheets never meet in pairs: each stage's latest sheet is a
    running maximum along the save time, a change of its completeness is +1 or
    -1 on the run's number of complete stages, and a request reads the running
    sum of these changes at its own time.
    """
    done = F.coalesce(F.nullif(F.col("completion_status"), F.lit("")), F.lit(COMPLETE)) == COMPLETE
    saved = sheets.filter(F.col("stage_key").isin(RUN_STAGE_KEYS) & F.col("run_id").isNotNull() & F.col("created_at").isNotNull()) \
        .select("run_id", "stage_key", "id", F.col("created_at").alias("at"), done.cast("int").alias("done"))
    state = running_max_within(saved, ["run_id", "stage_key"], [F.col("at"), F.col("id")], F.struct("id", "done"), "__before",
                               inclusive=False)
    newest = state.filter(F.col("__before").isNull() | (F.col("id") > F.col("__before.id")))
    changes = newest.select("run_id", "at", F.lit(0).alias("kind"), "id",
                            (F.col("done") - F.coalesce("__before.done", F.lit(0))).alias("change")).filter("change != 0")
    asked = requests.filter(F.col("requested_at").isNotNull()).select(
        "run_id", F.col("requested_at").alias("at"), F.lit(1).alias("kind"), F.col("request_id").alias("id"), F.lit(0).alias("change"))
    line = running_sum_within(changes.unionByName(asked), ["run_id"], [F.col("at"), F.col("kind"), F.col("id")], F.col("change"), "__complete")
    return line.filter((F.col("kind") == 1) & (F.col("__complete") > 0)).select(F.col("id").alias("request_id"))


def finalize_runs(runs: DataFrame, requests: DataFrame, sheets: DataFrame) -> DataFrame:
    """Close runs from finalize requests (O-STATE-5).

    The review path needs a stage whose latest sheet, of those saved up to the
    request, is Complete; the quick path has no check.  Accepted requests stamp
    status, time and author; the last accepted request's stamp stays.  Requests
    for a run that does not exist are rejected (status NULL).  Where the log has a
    ``product_name``, the last accepted review that gives one names the run's product.
    """
    ok = _reviewable(requests.filter(F.coalesce(F.col("path"), F.lit("")) != "quick"), sheets).withColumn("__ok", F.lit(True))
    known = runs.select(F.col("id").alias("__rid"))
    r = requests.join(ok, "request_id", "left").join(known, requests["run_id"] == known["__rid"], "left")
    accepted = F.col("__rid").isNotNull() & ((F.col("path") == "quick") | F.coalesce(F.col("__ok"), F.lit(False)))
    r = r.withColumn("accepted", accepted)
    order = F.struct("requested_at", "request_id")
    agg = r.groupBy("run_id").agg(
        F.count_if("accepted").alias("accepted_requests"), F.count_if(~F.col("accepted")).alias("rejected_requests"),
        F.max_by(F.struct(F.col("requested_at").alias("finalized_at"), F.trim(F.col("employee")).alias("finalized_by")),
                 F.when(F.col("accepted"), order)).alias("__f"))
    j = agg.join(runs.select("id", "status"), F.col("run_id") == F.col("id"), "left")
    done = F.col("accepted_requests") > 0
    if "product_name" in requests.columns:
        given = clean("product_name")
        named = r.filter(F.col("accepted") & (F.coalesce(F.col("path"), F.lit("")) != "quick") & (given != "")) \
            .groupBy("run_id").agg(F.max_by(given, order).alias("__product"))
        own = runs.select(F.col("id").alias("run_id"), F.col("product_name").alias("__own"))
        j = j.join(named, "run_id", "left").join(own, "run_id", "left")
        product = [F.coalesce("__product", "__own").alias("product_name")]
    else:
        product = []
    return j.select("run_id", F.when(done, F.lit(COMPLETE)).otherwise(F.col("status")).alias("status"),
                    F.when(done, F.col("__f.finalized_at")).alias("finalized_at"),
                    F.when(done, F.col("__f.finalized_by")).alias("finalized_by"),
                    "accepted_requests", "rejected_requests", *product)


# ------------------------------------------------------------- O-STATE-7/8

def _asked(requests: DataFrame) -> DataFrame:
    """Group requests with cleaned texts, all their source runs, and the one whose sheets seed a new run.

    ``source_run_ids`` are the selected runs (positive ids, each once, in the
    order given); the seed is ``source_run_id`` where it is one of them, else the
    first.  Logs with ``source_run_id`` alone have one source per request.
    """
    actor = F.col("employee") if "employee" in requests.columns else F.lit("")
    given = F.col("source_run_id") if "source_run_id" in requests.columns else F.lit(None).cast("long")
    if "source_run_ids" in requests.columns:
        listed = F.array_distinct(F.filter(F.coalesce("source_run_ids", F.array().cast("array<bigint>")), lambda i: i > 0))
        seed = F.when(F.array_contains("__all", given), given).otherwise(F.get("__all", F.lit(0)))
    else:
        listed, seed = F.array(given), given
    return requests.withColumn("__all", listed).select(
        "request_id", "action", clean("group_label").alias("group_label"), seed.alias("source_run_id"), F.col("__all").alias("source_run_ids"),
        "requested_at", clean(actor).alias("actor"))


#: Requests that one replay task decides in order, and those that it holds as Python objects at a time.
REPLAY_ROWS, _REPLAY_STEP = 200_000, 1_000
_RUN = ["id", "open", "updated_at", "batch_type", "blend_number", "split_batch_number", "labels"]


def _newest(r) -> tuple:
    """Order of a label's runs: Open first, newest, highest id."""
    return bool(r["open"]), r["updated_at"] is not None, r["updated_at"] or "", r["id"]


def _refusal(request, run, was_source: bool) -> str | None:
    own = run["blend_number"] if request["action"] == "blend" else run["split_batch_number"]
    if run["id"] in request["source_run_ids"]:
        return "label_is_source"
    fits = not was_source and run["batch_type"] == request["action"] and own == request["group_label"]
    return None if fits else "label_taken"


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rule applied to one slice of requests, which come in order; a row brings its label's best run before the slice.

    Only the newest run of each label met so far and the ids of the sources are held, not the requests.
    """
    best, asked, used = {}, set(), set()
    for batch in batches:
        for start in range(0, len(batch), _REPLAY_STEP):
            out = []
            for r in batch.slice(start, _REPLAY_STEP).to_pylist():
                label, target = r["group_label"], r["best"]
                if target is not None:
                    if label not in asked:
                        # runs of the label that the slice touched before its first request are as good as those touched later
                        asked.add(label)
                        if r["best_was_source"]:
                            used.add(target["id"])
                        if label not in best or _newest(target) > _newest(best[label]):
                            best[label] = target
                    target = best[label]
                why = (None if r["taken_free"] else "label_taken") if target is None else _refusal(r, target, target["id"] in used)
                out.append((r["request_id"], None if target is None else target["id"], why))
                if why is not None:
                    continue
                for run in [*r["from_runs"], *([] if target is None else [target])]:
                    run = {**run, "updated_at": max(run["updated_at"] or "", r["requested_at"] or "") or None}
                    for own in run["labels"]:
                        if own not in best or _newest(run) >= _newest(best[own]):
                            best[own] = run
                used.update(run["id"] for run in r["from_runs"])
            request, run, why = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(request, batch.schema.field("request_id").type), pa.array(run, pa.int64()), pa.array(why, pa.string())],
                                             names=["request_id", "target_run_id", "why"])


def _contested(asked: DataFrame, candidates: DataFrame, free: DataFrame, slice_rows: int) -> DataFrame:
    """Decisions of the requests whose label names existing runs: ``(request_id, target_run_id, why)``.

    Whether such a request is taken depends on which run of the label is the
    newest at its time and whether that run was a source before.  Only the
    requests that have a label's run among their sources change that, or whose
    target is a run of two labels.  These are replayed in order, in slices of
    ``slice_rows`` by time that hand the best run of every label on, so that no
    task holds more, however many hang together.  All others are decided at once
    from the touches of the replay by one prefix scan over the labels.
    """
    ship_package(asked.sparkSession)
    runs = candidates.groupBy("id").agg(F.array_sort(F.collect_set("label")).alias("labels"), *[F.first(c).alias(c) for c in _RUN[1:-1]])
    runs = stored(runs.select(*_RUN), "group_runs")
    twice = runs.where(F.size("labels") > 1).select(F.explode("labels").alias("group_label")).distinct().withColumn("__twice", F.lit(True))
    source = asked.select("request_id", F.explode("source_run_ids").alias("id")).join(runs, "id")
    source = source.groupBy("request_id").agg(F.collect_list(F.struct(*_RUN)).alias("from_runs"))
    critical = (asked.join(source, "request_id", "left").join(twice, "group_label", "left")
                .where(F.col("from_runs").isNotNull() | (F.col("__twice") & F.col("first_best").isNotNull()))
                .join(free.withColumn("taken_free", F.lit(True)), "request_id", "left")
                .select("request_id", "action", "group_label", "source_run_ids", "requested_at", "first_best",
                        F.coalesce("from_runs", F.array().cast(source.schema["from_runs"].dataType)).alias("from_runs"),
                        F.coalesce("taken_free", F.lit(False)).alias("taken_free")))
    critical = running_sum_within(critical, [], [F.col("requested_at"), F.col("request_id")], F.lit(1), "n")
    best = candidates.groupBy("label").agg(F.max(F.struct("open", "updated_at", "id")).alias("b")).select("label", "b")
    touches = used = None
    kind = T.StructType([critical.schema["request_id"], T.StructField("target_run_id", T.LongType()), T.StructField("why", T.StringType())])
    for k in range(-(-critical.count() // slice_rows)):
        part = critical.where(F.floor((F.col("n") - 1) / slice_rows) == k).drop("first_best")
        before = best.join(runs, F.col("b.id") == F.col("id")).select(
            F.col("label").alias("group_label"), F.struct(F.col("id"), F.col("open"), F.col("b.updated_at").alias("updated_at"), *_RUN[3:]).alias("best"))
        # the best runs that an earlier slice used as sources
        was = F.lit(False)
        if used is not None:
            before = before.join(used.withColumn("__used", F.lit(True)), F.col("best.id") == F.col("run_id"), "left")
            was = F.coalesce("__used", F.lit(False))
        part = part.join(before.withColumn("best_was_source", was).select("group_label", "best", "best_was_source"), "group_label", "left")
        decided = stored(part.repartition(1).sortWithinPartitions("n").mapInArrow(_replay, kind), "group_replay")
        taken = critical.join(decided.where("why IS NULL"), "request_id")
        hit = (taken.select("requested_at", "request_id", F.inline("from_runs"), F.lit(True).alias("is_source"))
               .unionByName(taken.join(runs, F.col("target_run_id") == F.col("id")).where(F.size("labels") > 1)
                            .select("requested_at", "request_id", *_RUN, F.lit(False).alias("is_source"))))
        hit = stored(hit.select("requested_at", "request_id", F.explode("labels").alias("label"), "is_source", F.struct(
            F.col("open"), F.greatest("updated_at", "requested_at").alias("updated_at"), F.col("id")).alias("b")), "group_hits")
        touches = hit if touches is None else touches.unionByName(hit)
        used = touches.where("is_source").select(F.col("b.id").alias("run_id")).distinct()
        best = stored(best.unionByName(hit.select("label", "b")).groupBy("label").agg(F.max("b").alias("b")), "group_best")

    contested = asked.where("first_best IS NOT NULL")
    j = contested.withColumn("target", F.col("first_best"))
    first = None
    if touches is not None:
        ask = contested.select(F.col("group_label").alias("label"), "requested_at", "request_id", F.lit(0).alias("kind"))
        line = touches.select("label", "requested_at", "request_id", F.lit(1).alias("kind"), "b").unionByName(ask, allowMissingColumns=True)
        newest = running_max_within(line, ["label"], [F.col("requested_at"), F.col("request_id"), F.col("kind"), F.col("b.id")], F.col("b"), "newest")
        j = contested.join(newest.where("kind = 0").select("request_id", "newest"), "request_id").withColumn("target", F.greatest("first_best", "newest"))
        first = touches.where("is_source").groupBy(F.col("b.id").alias("id")).agg(F.min(F.struct("requested_at", "request_id")).alias("first_source"))
    own = j.join(runs.drop("open", "updated_at"), F.col("target.id") == F.col("id"))
    was_source = F.lit(False)
    if first is not None:
        own = own.join(first, "id", "left")
        was_source = F.coalesce(F.col("first_source") < F.struct("requested_at", "request_id"), F.lit(False))
    label = F.when(F.col("action") == "blend", F.col("blend_number")).otherwise(F.col("split_batch_number"))
    fits = ~was_source & (F.col("batch_type") == F.col("action")) & (label == F.col("group_label"))
    why = F.when(F.array_contains("source_run_ids", F.col("id")), F.lit("label_is_source")).when(~fits, F.lit("label_taken"))
    return own.select("request_id", F.col("id").alias("target_run_id"), why.alias("why"))


def group_label_requests(runs: DataFrame, requests: DataFrame, slice_rows: int = REPLAY_ROWS) -> DataFrame:
    """Blend/split requests decided in order (O-STATE-7): one decision per request, whatever the number of its source runs.

    Target = the run resolved by the label (Open first, newest).  Rejected, with a
    reason code, when the label is blank, when the seeding source run is missing,
    when the target is one of the sources, or when the target is not already a run
    of that kind carrying that label.  A request sees what the accepted ones
    before it did: their sources are standard runs with the new label, their
    target carries it, and all of them are as new as the request; the first of a
    label without a run fixes the kind of that label's new run.  Sources are runs
    of the snapshot; ids that are not in it are kept but stand for no run.
    """
    asked = _asked(requests)
    known = sifted(runs.select(F.col("id").alias("__sid")), "__sid", asked, "source_run_id")
    asked = asked.join(known, F.col("source_run_id") == F.col("__sid"), "left")
    why = F.when(F.col("group_label") == "", F.lit("blank_label")).when(F.col("__sid").isNull(), F.lit("no_source_run"))
    asked = stored(asked.select("*", why.alias("__why")).drop("__sid"), "group_requests")

    labels = asked.where("group_label <> ''").select(F.col("group_label").alias("label")).distinct()
    header = runs.select("id", (F.col("status") == "Open").alias("open"), "updated_at", clean("batch_type").alias("batch_type"),
                         clean("blend_number").alias("blend_number"), clean("split_batch_number").alias("split_batch_number"),
                         F.col("run_number").alias("__n"), F.col("batch_number").alias("__b"))
    found = (labels.join(sifted(header, "__n", labels, "label"), F.col("label") == F.col("__n"))
             .unionByName(labels.join(sifted(header, "__b", labels, "label"), F.col("label") == F.col("__b")))
             .drop("__n", "__b").dropDuplicates(["label", "id"]))
    candidates = stored(found.withColumn("open", F.coalesce("open", F.lit(False))), "group_candidates")
    best = candidates.groupBy("label").agg(F.max(F.struct("open", "updated_at", "id")).alias("first_best"))
    asked = asked.join(best.withColumnRenamed("label", "group_label"), "group_label", "left")

    # a label without a run yet: the first accepted request makes the run, later ones of the other kind find it taken
    open_label = asked.where("__why IS NULL AND first_best IS NULL")
    first = open_label.groupBy("group_label").agg(F.min_by("action", F.struct("requested_at", "request_id")).alias("__kind"))
    free = open_label.join(first, "group_label").where("action = __kind").select("request_id")
    decided = None
    if not asked.where("__why IS NULL AND first_best IS NOT NULL").isEmpty():
        decided = _contested(asked.where("__why IS NULL").drop("__why"), candidates, stored(free, "group_free"), slice_rows)
    out = asked.join(first, "group_label", "left")
    if decided is None:
        out = out.withColumns({"__target": F.lit(None).cast("long"), "__taken": F.lit(None).cast("string")})
    else:
        out = out.join(decided.withColumnsRenamed({"target_run_id": "__target", "why": "__taken"}), "request_id", "left")
    later = F.when(F.col("first_best").isNull() & (F.col("action") != F.col("__kind")), F.lit("label_taken"))
    out = out.withColumn("__reason", F.coalesce("__why", "__taken", later))
    return stored(out.select("request_id", "action", "group_label", "source_run_id", "source_run_ids", "requested_at", "actor",
                             F.coalesce("__target", F.col("first_best.id")).alias("target_run_id"),
                             F.when(F.col("__reason").isNull(), "accepted").otherwise("rejected").alias("outcome"),
                             F.coalesce("__reason", F.lit("")).alias("reason")), "group_checked")


def _sources(checked: DataFrame) -> Column:
    """Source runs of decided requests; logs of requests with one source may have that alone."""
    return F.col("source_run_ids") if "source_run_ids" in checked.columns else F.array("source_run_id")


def apply_group_labels(runs: DataFrame, checked: DataFrame) -> DataFrame:
    """New label columns of every run touched by accepted requests (T24: one group per run).

    Sources become ``standard``; an existing target keeps its batch type.  When
    requests touch the same run, the latest request wins.
    """
    ok = checked.filter(F.col("outcome") == "accepted")
    order = F.struct("requested_at", "request_id")
    touched = (ok.select(F.explode(_sources(ok)).alias("run_id"), "action", "group_label", "requested_at", "request_id",
                         F.lit(True).alias("is_source"))
               .unionByName(ok.filter(F.col("target_run_id").isNotNull())
                            .select(F.col("target_run_id").alias("run_id"), "action", "group_label", "requested_at",
                                    "request_id", F.lit(False).alias("is_source"))))
    last = touched.groupBy("run_id").agg(F.max_by(F.struct("action", "group_label", "is_source"), order).alias("l"))
    j = runs.select("id", "batch_type").join(last, runs["id"] == last["run_id"])
    blend = F.when(F.col("l.action") == "blend", F.col("l.group_label")).otherwise(F.lit(""))
    split = F.when(F.col("l.action") == "split", F.col("l.group_label")).otherwise(F.lit(""))
    bt = F.when(F.col("l.is_source"), F.lit("standard")).otherwise(F.col("batch_type"))
    return j.select(F.col("id").alias("run_id"), blend.alias("blend_number"), split.alias("split_batch_number"),
                    bt.alias("batch_type"))


def derived_runs(runs: DataFrame, checked: DataFrame, base_id: int) -> DataFrame:
    """New derived run headers: one per accepted label without an existing target (O-STATE-8).

    The source is the first request's run; ids continue after ``base_id`` in
    request order.
    """
    new = checked.filter((F.col("outcome") == "accepted") & F.col("target_run_id").isNull())
    order = F.struct("requested_at", "request_id")
    first = new.groupBy("action", "group_label").agg(
        F.min_by(F.struct("request_id", "source_run_id", "requested_at", "actor"), order).alias("f"))
    src = sifted(runs.select(F.col("id").alias("__sid"), "product_name", "shift_name", "operator_id", "notes"), "__sid", new, "source_run_id")
    heads = first.join(src, F.col("f.source_run_id") == src["__sid"], "left")
    heads = assign_ids(heads, [F.col("f.requested_at"), F.col("f.request_id")], base_id, "id")
    lab = F.col("group_label")
    return heads.select(
        "id", lab.alias("batch_number"), F.when(F.col("action") == "split", lab).otherwise(F.lit("")).alias("split_batch_number"),
        F.when(F.col("action") == "blend", lab).otherwise(F.lit("")).alias("blend_number"), lab.alias("run_number"),
        F.col("action").alias("batch_type"), F.lit(1).alias("reused_batch"), clean("product_name").alias("product_name"),
        clean("shift_name").alias("shift_name"),
        F.coalesce(F.nullif(F.col("f.actor"), F.lit("")), clean("operator_id")).alias("operator_id"),
        clean("notes").alias("notes"), F.lit("Open").alias("status"), F.col("f.source_run_id").alias("source_run_id"),
        F.col("f.requested_at").alias("created_at"), F.col("f.requested_at").alias("updated_at"))


PAYLOAD_RUN_FIELDS = ["run_number", "production_number", "run_blend_number"]


def rewrite_payload(payload_json: Column, label: Column, blend: Column) -> Column:
    """Point a copied payload at the derived run (O-RSH-11): run fields present are replaced."""
    m = parse_payload(payload_json)
    repl = F.transform_values(m, lambda k, v: F.when(k.isin("run_number", "production_number"), label)
                              .when(k == "run_blend_number", F.coalesce(F.nullif(blend, F.lit("")), label))
                              .otherwise(v))
    return F.to_json(repl)


def _copied(latest: DataFrame, heads: DataFrame) -> DataFrame:
    """Latest entries of the source runs under the derived runs, as first versions.

    Copies get their ids where they are appended; ``source_entry_id`` names the original.
    """
    h = heads.select(F.col("id").alias("target_run_id"), F.col("source_run_id").alias("run_id"),
                     run_label("run_number", "batch_number", "id").alias("__label"), F.col("blend_number").alias("__blend"))
    first = {"version_no": F.lit(1), "previous_entry_id": F.lit(None).cast("long")}
    j = latest.drop(*first).join(h, "run_id").drop("run_id").withColumnRenamed("id", "source_entry_id")
    return j.withColumns(first)


def derived_sheet_copies(sheets: DataFrame, heads: DataFrame) -> DataFrame:
    """Latest sheet per stage of each source run, copied onto its derived run, version 1, payload repointed."""
    latest = latest_by(sheets.filter(F.col("stage_key").isin(RUN_STAGE_KEYS)), ["run_id", "stage_key"])
    j = _copied(latest, heads)
    return j.withColumn("payload_json", rewrite_payload(F.col("payload_json"), F.col("__label"), F.col("__blend"))) \
        .drop("__label", "__blend")


def derived_entry_copies(entries: DataFrame, heads: DataFrame) -> DataFrame:
    """Latest extraction (or filtration) entry of each source run, copied onto its derived run, version 1."""
    return _copied(latest_by(entries, ["run_id"]), heads).drop("__label", "__blend")


def derived_child_rows(copies: DataFrame, rows: DataFrame, parent: str = "filtration_entry_id") -> DataFrame:
    """Child rows of the copied entries, once per derived run."""
    c = stored(copies.select("target_run_id", F.col("source_entry_id").alias(parent)), "copied_entries")
    return sifted(rows, parent, c, parent).join(c, parent).withColumnRenamed(parent, "source_entry_id")


def group_audits(checked: DataFrame, heads: DataFrame, runs: DataFrame) -> DataFrame:
    """Audit rows of accepted blend / split requests: the copy of a new run, and every link to a source run (O-STATE-2)."""
    labels = runs.select(F.col("id").alias("source_run_id"), run_label().alias("__source"))
    accepted = checked.filter(F.col("outcome") == "accepted")
    # all source labels of a request in one text, by run id
    named = accepted.select("request_id", F.explode(_sources(accepted)).alias("source_run_id")).join(labels, "source_run_id")
    texts = named.groupBy("request_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("source_run_id", "__source"))), lambda x: x["__source"]), ", ").alias("__source"))
    ok = accepted.join(texts, "request_id")
    new = heads.select(F.col("batch_type").alias("action"), F.col("run_number").alias("group_label"), F.col("id").alias("__new"))
    linked = ok.join(new, ["action", "group_label"], "left")
    named = F.concat(F.col("action"), F.lit(" run "), F.col("group_label"))
    first = heads.select("id", "source_run_id", F.col("batch_type").alias("action"), F.col("run_number").alias("group_label"),
                         F.col("operator_id").alias("actor"), "created_at").join(labels, "source_run_id")
    return _audit(first, F.col("id"), F.lit("create"), F.concat(named, F.lit(COPIED_FROM), F.col("__source")), F.col("created_at")).unionByName(
        _audit(linked, F.coalesce("target_run_id", "__new"), F.col("action"), F.concat(named, F.lit(LINKED_TO), F.col("__source")),
               F.col("requested_at")))


def finalize_audits(runs: DataFrame, requests: DataFrame, sheets: DataFrame) -> DataFrame:
    """Audit rows of the finalize requests that closed a run."""
    quick = F.coalesce(F.col("path"), F.lit("")) == "quick"
    ok = requests.filter(quick).unionByName(
        requests.join(_reviewable(requests.filter(~quick), sheets), "request_id", "left_semi"))
    known = ok.join(runs.select(F.col("id").alias("run_id")), "run_id", "left_semi").withColumn("actor", clean("employee"))
    return _audit(known, F.col("run_id"), F.lit("finalize"),
                  F.when(quick, F.lit(CLOSED_QUICKLY)).otherwise(F.lit(CLOSED_BY_REVIEW)), F.col("requested_at"))


def _audit(df: DataFrame, record: Column, action: Column, text: Column, at: Column) -> DataFrame:
    return df.select(F.lit("production_runs").alias("table_name"), record.cast("long").alias("record_id"), action.alias("action_type"),
                     F.col("actor").alias("changed_by"), F.lit("").alias("old_data"), text.alias("new_data"), at.alias("created_at"))


# ------------------------------------------------------------ O-STATE-9/10/11

def touch_runs(runs: DataFrame, *entry_tables: DataFrame) -> DataFrame:
    """Saving an entry bumps its run's updated_at (O-STATE-9)."""
    stamps = None
    for t in entry_tables:
        part = t.select("run_id", "created_at").filter(F.col("run_id").isNotNull())
        stamps = part if stamps is None else stamps.unionByName(part)
    latest = stamps.groupBy("run_id").agg(F.max("created_at").alias("__touched"))
    j = runs.select("id", "updated_at").join(latest, runs["id"] == latest["run_id"], "left")
    return j.select("id", F.greatest(F.col("updated_at"), F.col("__touched")).alias("updated_at"))


def edit_run_headers(runs: DataFrame, edits: DataFrame) -> DataFrame:
    """Header after a log of edits (O-STATE-10).

    A blank run number keeps the current label, so the result is the last
    non-blank run number of the log, else the run's label; product name is the
    latest edit's (trimmed), like notes and the final-edit columns where the log
    has them.  Batch number follows the run number.
    """
    texts = [c for c in ("notes", "final_edit_initials", "final_edit_notes") if c in edits.columns]
    order = F.struct("edited_at", "edit_id")
    agg = edits.groupBy("run_id").agg(
        F.max_by(clean("run_number"), F.when(clean("run_number") != "", order)).alias("__rn"),
        F.max_by(clean("product_name"), order).alias("__pn"), F.max("edited_at").alias("__at"),
        *[F.max_by(clean(c), order).alias(f"__{c}") for c in texts],
        F.count(F.lit(1)).alias("edits"))
    j = runs.join(agg, runs["id"] == agg["run_id"])
    number = F.coalesce(F.col("__rn"), run_label())
    return j.select(F.col("id").alias("run_id"), number.alias("run_number"), number.alias("batch_number"),
                    F.col("__pn").alias("product_name"), *[F.col(f"__{c}").alias(c) for c in texts],
                    F.col("__at").alias("updated_at"), "edits")


def create_or_reuse_runs(runs: DataFrame, requests: DataFrame, base_id: int) -> DataFrame:
    """Run per create request: reuse the newest open run with that label, else one new run per label.

    Labels compare case-insensitively on the display label; the first request
    of a new label creates the run (ids after ``base_id``), later ones reuse it.
    """
    req = requests.select("request_id", clean("run_label").alias("label"), "requested_at").filter(F.col("label") != "")
    req = req.withColumn("key", F.lower("label"))
    open_runs = runs.filter(F.col("status") == "Open").select(F.lower(run_label()).alias("key"), "id", "updated_at")
    existing = open_runs.join(req.select("key").distinct(), "key", "left_semi").groupBy("key").agg(
        F.max_by("id", F.struct("updated_at", "id")).alias("existing_id"))
    r = req.join(existing, "key", "left")
    order = F.struct("requested_at", "request_id")
    fresh = (r.filter(F.col("existing_id").isNull()).groupBy("key")
             .agg(F.min_by(F.struct("request_id", "requested_at"), order).alias("f")))
    fresh = assign_ids(fresh, [F.col("f.requested_at"), F.col("f.request_id")], base_id, "new_id").select("key", "new_id", F.col("f.request_id").alias("creating_request"))
    out = r.join(fresh, "key", "left")
    action = (F.when(F.col("existing_id").isNotNull(), "reuse")
              .when(F.col("request_id") == F.col("creating_request"), "create").otherwise("reuse"))
    return out.select("request_id", "label", action.alias("action"),
                      F.coalesce(F.col("existing_id"), F.col("new_id")).alias("run_id"))


def created_runs(requests: DataFrame, resolved: DataFrame) -> DataFrame:
    """Header rows of the runs that ``create_or_reuse_runs`` created (O-STATE-11)."""
    new = resolved.filter(F.col("action") == "create").select("request_id", F.col("label").alias("run_number"),
                                                              F.col("run_id").alias("id"))
    text = lambda name: clean(name) if name in requests.columns else F.lit("")
    asked = requests.select("request_id", text("product_name").alias("product_name"), text("employee").alias("operator_id"),
                            F.col("requested_at").alias("created_at"))
    empty = [F.lit("").alias(c) for c in ("split_batch_number", "blend_number", "shift_name", "notes")]
    return new.join(asked, "request_id").select(
        "id", F.col("run_number").alias("batch_number"), "run_number", F.lit("standard").alias("batch_type"),
        F.lit(0).alias("reused_batch"), "product_name", "operator_id", *empty, F.lit("Open").alias("status"),
        "created_at", F.col("created_at").alias("updated_at"))


def max_id(df: DataFrame, column: str = "id") -> int:
    """Largest id of a table (one scalar to the driver) for id assignment."""
    value = df.agg(F.max(column)).first()[0]
    return int(value or 0)

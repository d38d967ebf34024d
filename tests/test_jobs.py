"""Streaming jobs vs batch, export round trip, hot-key numbering, payload rewrite."""

import json
import os
import tempfile

from pyspark.sql import Window
from pyspark.sql import functions as F

from batchtrail.operators import latest as LT
from batchtrail.operators import lifecycle as LC
from batchtrail.operators.feeds import entry_union
from batchtrail.operators.readings import stage_metric_catalog, stage_metric_fields
from batchtrail.operators.sequence import assign_ids, sequence_within
from batchtrail.plans import export as EX
from batchtrail.sources.fixtures import fixture
from batchtrail.sources.process_tables import from_fixtures, from_parquet
from batchtrail.streaming import jobs as ST
from tests.conftest import SMALL

TABLES = ["production_runs", "extraction_entries", "filtration_entries", "filtration_rows", "evaporation_entries",
          "evaporation_rows", "sheet_entries", "users", "field_change_log"]


def _scratch() -> str:
    return tempfile.mkdtemp(prefix="batchtrail-test-")


def _write_tables(spark, root):
    t = from_fixtures(spark, SMALL)
    for name in TABLES:
        t.table(name).write.mode("overwrite").parquet(f"{root}/{name}")
    return from_parquet(spark, root)


def test_activity_stream_equals_batch(spark):
    root = _scratch()
    t = _write_tables(spark, root)
    # a duplicate delivery of the extraction table must be dropped
    t.extraction.write.mode("append").parquet(f"{root}/extraction_entries")
    q = ST.activity_stream(spark, root, t.runs, f"{root}/_feed", f"{root}/_ckpt_feed")
    q.awaitTermination(300)
    got = spark.read.parquet(f"{root}/_feed")
    batch = entry_union(from_parquet(spark, root)).dropDuplicates(["entry_table", "record_id"])
    assert got.count() == batch.count()
    key = ["entry_table", "record_id"]
    assert got.select(*key).exceptAll(batch.select(*key)).count() == 0


def test_activity_stream_takes_late_and_undated_entries_once(spark):
    root = _scratch()
    t = _write_tables(spark, root)
    run = lambda: ST.activity_stream(spark, root, t.runs, f"{root}/_feed", f"{root}/_ckpt_feed").awaitTermination(300)
    run()
    before = spark.read.parquet(f"{root}/_feed").count()
    one = t.extraction.limit(1)
    late = one.withColumn("id", F.lit(900001).cast("long")).withColumn("created_at", F.lit("1999-01-01T00:00:00"))
    blank = one.withColumn("id", F.lit(900002).cast("long")).withColumn("created_at", F.lit(""))
    late.unionByName(blank).unionByName(one).write.mode("append").parquet(f"{root}/extraction_entries")
    run()
    rows = spark.read.parquet(f"{root}/_feed")
    assert rows.count() == before + 2
    got = {r.record_id: (str(r.feed_month), r.event_ts) for r in rows.where("record_id > 900000").collect()}
    assert got[900001][0] == "1999-01" and got[900002] == ("undated", None)


def test_a_reused_export_name_counts_only_its_own_runs(spark):
    from batchtrail.sources import sinks
    root = _scratch()
    rows = lambda m: spark.createDataFrame([(1, m)], "run_id long, export_month string")
    sinks.write_packets(rows("2024-01"), f"{root}/p")
    sinks.write_packets(rows("2024-02"), f"{root}/p")
    assert spark.read.json(f"{root}/p").count() == 1


def test_marks_survive_and_storage_errors_are_raised(spark):
    import pytest
    from batchtrail.sources import sinks
    root = _scratch()
    assert sinks.read_mark(spark, f"{root}/none") == ""
    for at in ("2024-01-02T00:00:00", "2024-01-03T00:00:00"):
        sinks.write_mark(spark, f"{root}/m", at, "all", "All", "x", 1)
    assert sinks.read_mark(spark, f"{root}/m") == "2024-01-03T00:00:00"
    with pytest.raises(Exception):
        sinks.read_mark(spark, "nosuchstore://a/b")


def test_search_takes_a_backslash(spark):
    from batchtrail.operators.runs import runs_search
    runs = spark.createDataFrame([("a\\b", None, None, "Open"), ("ab", None, None, "Open"), ("c\\", None, None, "Open")],
                                 "run_number string, batch_number string, product_name string, status string")
    assert [r.run_number for r in runs_search(runs, "a\\\\b").collect()] == []
    assert [r.run_number for r in runs_search(runs, "a\\b").collect()] == ["a\\b"]
    assert [r.run_number for r in runs_search(runs, "c\\").collect()] == ["c\\"]


def test_form_rows_start_at_zero_and_refuse_long_numbers(spark):
    from batchtrail.operators import reshape as RS
    forms = spark.createDataFrame([(1, {"cycle1_0_time": "08:00", "cycle1_99999999999_time": "09:00"})],
                                  "form_id long, fields map<string,string>")
    assert [r.row_no for r in RS.filtration_rows_from_form(forms).collect()] == [0]
    assert [r.key for r in RS.refused_row_keys(forms).collect()] == ["cycle1_99999999999_time"]


def test_newest_entries_are_taken_before_the_run_join(spark):
    from batchtrail.operators import feeds as FD
    t = from_fixtures(spark, SMALL)
    for out in (FD.activity_feed(t, "2024-01-30T23:59:59", 48, 7), FD.change_history(t.field_changes, t.runs, None, 7)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Join") < plan.index("GlobalLimit")  # the limit lies below the join
        assert out.count() <= 7


def test_export_round_trip_and_since_last_is_empty_after(spark):
    root = _scratch()
    t = from_fixtures(spark, SMALL)
    voided = LC.void_state(fixture(spark, SMALL, "fx_void_log"))
    first = EX.export_scope(spark, t, voided, "all", "2100-01-01T00:00:00", root, "first")
    assert first["run_count"] == t.runs.count()
    packets = spark.read.json(f"{first['path']}/packets")
    assert packets.select("run_id").distinct().count() == first["run_count"]
    # the documents hold the content of the entries and sheets, the child rows lie beside them
    newest = LT.latest_by(t.extraction, ["run_id"]).join(t.runs.select(F.col("id").alias("run_id")), "run_id", "left_semi")
    want = {(r.run_id, r.psf1_speed, r.chip_bin_steam, r.comments) for r in newest.collect()}
    got = {(r.run_id, r.extraction.psf1_speed, r.extraction.chip_bin_steam, r.extraction.comments)
           for r in packets.filter("extraction IS NOT NULL").collect()}
    assert {tuple(v or "" for v in g) for g in got} == {tuple(v or "" for v in w) for w in want}
    cells = LT.packet_cells(packets.select("run_id", F.inline("sheets")))
    shown = LT.packet_sheets(t.sheets, voided).join(t.runs.select(F.col("id").alias("run_id")), "run_id", "left_semi")
    assert cells.exceptAll(LT.packet_cells(shown)).count() == 0 and cells.count() == LT.packet_cells(shown).count()
    rows = spark.read.json(f"{first['path']}/packet_rows")
    known = LT.packet_rows(t.filtration, t.filtration_rows).join(t.runs.select(F.col("id").alias("run_id")), "run_id", "left_semi")
    assert rows.count() == known.count()
    manifest = spark.read.option("header", True).csv(f"{first['path']}/manifest/rows")
    assert manifest.count() == first["run_count"]
    second = EX.export_scope(spark, t, voided, "since_last", "2100-01-02T00:00:00", root, "second")
    assert second["run_count"] == 0
    mark = spark.read.json(f"{root}/_state").orderBy(F.desc("last_successful_export_at")).first()
    assert mark.last_scope == "since_last" and mark.last_run_count == 0


def test_sequence_within_hot_key_equals_row_number(spark):
    rows = [(0 if i % 3 == 0 else i % 17, i, f"2024-01-{i % 28 + 1:02d}") for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, id long, day string")
    got = sequence_within(df, ["k"], [F.col("id")], out="seq")
    want = df.withColumn("seq", F.row_number().over(Window.partitionBy("k").orderBy("id")))
    assert got.select("k", "id", "seq").exceptAll(want.select("k", "id", "seq")).count() == 0
    ids = assign_ids(df, [F.col("id")], 1000, "new_id")
    assert sorted(r.new_id for r in ids.collect()) == list(range(1001, 4001))


def test_rewrite_payload(spark):
    df = spark.createDataFrame([('{"run_number":"R1","production_number":"P","run_blend_number":"","x":"1"}',)], "p string")
    out = json.loads(df.select(LC.rewrite_payload(F.col("p"), F.lit("BL7"), F.lit("BL7"))).first()[0])
    assert out == {"run_number": "BL7", "production_number": "BL7", "run_blend_number": "BL7", "x": "1"}


def test_stage_metric_catalog(spark):
    cat = {(r.stage_key, r.chart_key): r.label for r in stage_metric_catalog(spark).collect()}
    for prefix, field, key, label in stage_metric_fields("centrifuge"):
        assert cat[("centrifuge", key)] == label
    assert ("centrifuge", "centrifuge::time") not in cat


def test_scratch_dirs_are_fresh():
    a, b = _scratch(), _scratch()
    assert a != b and os.path.isdir(a)


def test_append_entries_prunes_months_and_replace_children(spark):
    from batchtrail.sources import sinks
    root = _scratch()
    t = from_fixtures(spark, SMALL)
    sinks.append_entries(t.filtration, f"{root}/filtration")
    back = spark.read.parquet(f"{root}/filtration")
    assert back.count() == t.filtration.count()
    jan = back.filter(F.col("entry_month") == "2024-01")
    plan = jan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(entry_month" in plan
    rows = t.filtration_rows
    edited = rows.select("filtration_entry_id").distinct().orderBy("filtration_entry_id").limit(3)
    new = rows.join(edited, "filtration_entry_id", "left_semi").filter("row_no = 1")
    out = sinks.replace_children(rows, edited, new)
    kept = rows.join(edited, "filtration_entry_id", "left_anti").count()
    assert out.count() == kept + new.count()


def test_dashboard_shares_one_feed(spark):
    from batchtrail.plans.dashboard import activity_dashboard
    from batchtrail.operators import feeds as FD
    t = from_fixtures(spark, SMALL)
    d = activity_dashboard(spark, t, "2024-01-30T23:59:59", 48)
    try:
        assert d.feed.is_cached
        assert d.machine_status.count() == 3
        assert d.run_groups.count() == FD.run_groups(FD.activity_feed(t, "2024-01-30T23:59:59", 48, None)).count()
        assert d.in_use.count() <= 10
    finally:
        d.release()


def test_finalize_sees_only_earlier_sheets_and_group_kinds_are_fixed_by_the_first(spark):
    runs = spark.createDataFrame([(1, "R1", "Open"), (2, "R2", "Open")], "id long, run_number string, status string")
    sheets = spark.createDataFrame([(10, 1, "centrifuge", "Complete", "2024-06-01T00:00:00")],
                                   "id long, run_id long, stage_key string, completion_status string, created_at string")
    asked = [(1, 1, "review", "E", "2024-01-01T00:00:00"), (2, 99, "quick", "E", "2024-01-01T00:00:00"), (3, 2, "quick", "E", "2024-01-01T00:00:00")]
    requests = spark.createDataFrame(asked, "request_id long, run_id long, path string, employee string, requested_at string")
    got = {r.run_id: (r.status, r.accepted_requests) for r in LC.finalize_runs(runs, requests, sheets).collect()}
    assert got == {1: ("Open", 0), 99: (None, 0), 2: ("Complete", 1)}
    later = requests.withColumn("requested_at", F.lit("2024-07-01T00:00:00"))
    assert {r.run_id: r.status for r in LC.finalize_runs(runs, later, sheets).collect()}[1] == "Complete"

    full = runs.select("id", "run_number", F.lit("").alias("batch_number"), "status", F.lit("2024-01-01").alias("updated_at"),
                       F.lit("standard").alias("batch_type"), F.lit("").alias("blend_number"), F.lit("").alias("split_batch_number"))
    log = spark.createDataFrame([(1, "blend", "X1", 1, "2024-01-01"), (2, "split", "X1", 2, "2024-01-02"), (3, "blend", "X1", 2, "2024-01-03"),
                                 (4, "blend", "  ", 1, "2024-01-04")],
                                "request_id long, action string, group_label string, source_run_id long, requested_at string")
    got = {r.request_id: (r.outcome, r.reason) for r in LC.group_label_requests(full, log).collect()}
    assert got == {1: ("accepted", ""), 2: ("rejected", "label_taken"), 3: ("accepted", ""), 4: ("rejected", "blank_label")}


def test_derived_heads_take_the_actor_else_the_sources_operator(spark):
    from batchtrail.sources.tables import SCHEMAS, reconcile_schema
    runs = reconcile_schema(spark.createDataFrame([(1, "R1", "Open", " day ", "E9", "n1"), (2, "R2", "Open", None, "E8", None)],
                                                  "id long, run_number string, status string, shift_name string, operator_id string, notes string"),
                            SCHEMAS["production_runs"])
    req = spark.createDataFrame([(1, "blend", "B7", 1, "2024-01-01T00:00:00", " E1 "), (2, "split", "S7", 2, "2024-01-01T00:00:00", "")],
                                "request_id long, action string, group_label string, source_run_id long, requested_at string, employee string")
    heads = LC.derived_runs(runs, LC.group_label_requests(runs, req), 2)
    got = [(r.id, r.run_number, r.shift_name, r.operator_id, r.notes, r.updated_at) for r in heads.orderBy("id").collect()]
    assert got == [(3, "B7", "day", "E1", "n1", "2024-01-01T00:00:00"), (4, "S7", "", "E8", "", "2024-01-01T00:00:00")]


def test_an_entry_without_child_rows_shows_one_row_per_cycle(spark):
    from batchtrail.operators import reshape as RS
    entries = spark.createDataFrame([(1,), (2,)], "id long")
    rows = spark.createDataFrame([(10, 1, "cycle2", 4, "08:00"), (11, 1, "cycle2", 7, " "), (12, 1, "cycle3", 5, "x"), (13, 1, "cycle3", 5, "")],
                                 "id long, filtration_entry_id long, row_group string, row_no int, row_time string")
    got = {(r.filtration_entry_id, r.cycle): r.render_rows for r in RS.filtration_render_rows(entries, rows).collect()}
    assert len(got) == 12 and got[(1, 2)] == 4 and sum(got.values()) == 15


def test_a_key_with_one_stamp_is_numbered_like_row_number(spark):
    from batchtrail.operators.sequence import running_sum_within
    rows = [(None if i % 2 else "k", i * 9000, "2024-01-01T08:00:00" if i % 5 else None, i % 3) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, id long, at string, v int")
    order = [F.col("at"), F.col("id")]
    for keys in (["k"], []):
        got = running_sum_within(df, keys, order, F.col("v"), "s")
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        want = df.withColumn("s", F.sum("v").over(w))
        assert got.count() == 600 and got.exceptAll(want).count() == 0


def test_chart_points_are_merged_before_the_unpivot(spark):
    from batchtrail.plans.performance import machine_performance
    t = from_fixtures(spark, SMALL)
    tree = lambda m: machine_performance(t, m)._jdf.queryExecution().optimizedPlan().toString()
    for machine in ("filtration", "evaporation"):
        plan = tree(machine)
        assert plan.index("Expand") < plan.index("Aggregate")  # printed from the root: the merge lies below
    assert "Aggregate" not in tree("extraction")

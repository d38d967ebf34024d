"""Semantic traps (FIXTURES.md section C) on hand-made tables."""

from pyspark.sql import functions as F

from batchtrail.functions.text import clean, parse_numeric, title_case
from batchtrail.operators import latest as LT
from batchtrail.operators import lifecycle as LC
from batchtrail.operators import readings as R
from batchtrail.operators import runs as RU
from batchtrail.operators.feeds import _comment_parts
from batchtrail.plans.performance import _date_args
from batchtrail.sources.process_tables import ProcessTables
from batchtrail.sources.tables import SCHEMAS, reconcile_schema

RUN_COLS = "id long, run_number string, batch_number string, blend_number string, split_batch_number string, " \
           "batch_type string, product_name string, status string, created_at string, updated_at string"


def tables(spark, **frames):
    return ProcessTables(lambda name: reconcile_schema(frames[name], SCHEMAS[name]))


def sheets_df(spark, rows):
    return spark.createDataFrame(rows, "id long, run_id long, stage_key string, entry_date string, "
                                       "created_at string, payload_json string, completion_status string")


def test_t1_empty_entry_date_fails_start_passes_end(spark):
    df = spark.createDataFrame([("", "2024-05-01T10:00:00")], "entry_date string, created_at string")
    assert R.readings_date_range(df, start="2024-01-01").count() == 0
    assert R.readings_date_range(df, end="2024-12-31").count() == 1


def test_t3_t4_search_case_and_all_null(spark):
    runs = spark.createDataFrame([(1, "Ab1", None, None, None, None, None, "Open", "x", "x"),
                                  (2, None, None, None, None, None, None, "Open", "x", "x")], RUN_COLS)
    assert [r.id for r in RU.runs_search(runs, "AB").collect()] == [1]
    assert [r.id for r in RU.runs_search(runs, "").collect()] == [1]


def test_t9_clean_strips_all_whitespace(spark):
    df = spark.createDataFrame([("\t x \n",)], "v string")
    assert df.select(clean("v")).first()[0] == "x"


def test_t10_points_merge_across_entries(spark):
    p1 = '{"clarifier_filtration_1_time":"08:00","clarifier_filtration_1_feed_ri":"1","clarifier_filtration_1_retentate_ri":""}'
    p2 = '{"clarifier_filtration_1_time":"08:00","clarifier_filtration_1_feed_ri":"","clarifier_filtration_1_retentate_ri":"2"}'
    s = sheets_df(spark, [(1, None, "clarifier", "2024-05-01", "2024-05-01T09:00:00", p1, "Complete"),
                          (2, None, "clarifier", "2024-05-01", "2024-05-01T09:30:00", p2, "Complete")])
    vals = R.point_merge(R.generic_values(s, "clarifier"), R.POINT_COLUMNS)
    got = {r.field: r.value for r in vals.filter(F.col("point_time") == "2024-05-01T08:00:00").collect()}
    assert got == {"clarifier_filtration::feed_ri": 1.0, "clarifier_filtration::retentate_ri": 2.0}


def test_t11_blank_centrifuge_entry_has_50_points_no_metrics(spark):
    s = sheets_df(spark, [(1, 5, "centrifuge", "2024-05-01", "2024-05-01T09:00:00", "{}", "Complete")])
    pts = R.generic_points(s, "centrifuge").select(*R.POINT_COLUMNS).distinct()
    assert pts.count() == 50
    assert R.generic_values(s, "centrifuge").count() == 0


def test_t13_numeric_parse(spark):
    df = spark.createDataFrame([(t,) for t in ["12-15", ".5", "1,234.5 gal", "AUTO", "-3 psi", "2026-05-01"]], "t string")
    assert [r[0] for r in df.select(parse_numeric("t")).collect()] == [12.0, 5.0, 1234.5, None, -3.0, 2026.0]


def test_t17_voided_draft_vs_complete(spark):
    runs = spark.createDataFrame([(1, "R1", "", "", "", "standard", "P", "Open", "x", "x"),
                                  (2, "R2", "", "", "", "standard", "P", "Open", "x", "x")], RUN_COLS)
    s = sheets_df(spark, [(10, 1, "centrifuge", "d", "c", "{}", "Draft"), (11, 2, "centrifuge", "d", "c", "{}", "Complete")])
    voided = spark.createDataFrame([(1, "centrifuge", "E1", "t"), (2, "centrifuge", "E1", "t")],
                                   "run_id long, stage_key string, voided_by string, voided_at string")
    empty = spark.createDataFrame([], "id long, run_id long, created_at string, completion_status string")
    parts = {(r.run_id, r.part) for r in LT.run_packets(runs, empty, empty, s, voided).collect()}
    assert parts == {(1, "voided"), (2, "sheet")}


def test_t18_latest_is_highest_id(spark):
    df = spark.createDataFrame([(5, 1, "2024-05-02"), (9, 1, "2024-05-01")], "id long, run_id long, created_at string")
    assert LT.latest_by(df, ["run_id"]).first().id == 9


def test_t19_t20_correction_diff(spark):
    forms = spark.createDataFrame([(1, "a", "1", " 1 ", "AB"), (1, "b", "3", "2", "")],
                                  "submission_id long, field_name string, old_value string, new_value string, initials string")
    accepted, missing = LC.field_changes(forms)
    assert accepted.count() == 0
    assert [r.field_name for r in missing.collect()] == ["b"]


def test_t21_since_last_is_strict(spark):
    runs = spark.createDataFrame([(1, "R1", "", "", "", "standard", "P", "Open", "2024-04-01T00:00:00",
                                   "2024-05-01T10:00:00")], RUN_COLS)
    assert RU.runs_in_scope(runs, "since_last", "2024-06-01T00:00:00", "2024-05-01T10:00:00").count() == 0


def test_t24_new_label_clears_other_kind(spark):
    runs = spark.createDataFrame([(1, "R1", "B1x", "B1", "", "standard", "P", "Open", "x", "2024-01-01T00:00:00")], RUN_COLS)
    checked = spark.createDataFrame([(7, "split", "S1", 1, "2024-02-01T00:00:00", None, "accepted", "")],
                                    "request_id long, action string, group_label string, source_run_id long, "
                                    "requested_at string, target_run_id long, outcome string, reason string")
    r = LC.apply_group_labels(runs, checked).first()
    assert (r.blend_number, r.split_batch_number, r.batch_type) == ("", "S1", "standard")


def test_t26_comment_dedupe(spark):
    df = spark.createDataFrame([("foam", '{"rinse_comments":"foam","comments":"foam"}')], "c string, p string")
    from batchtrail.sources.tables import parse_payload
    parts = df.select(_comment_parts(F.col("c"), parse_payload("p")).alias("x")).first().x
    assert parts == ["foam"]


def test_t27_title_case(spark):
    df = spark.createDataFrame([("koh h2o2 cycle1a",)], "v string")
    assert df.select(title_case("v")).first()[0] == "Koh H2O2 Cycle1A"


def test_fold_drafts_islands(spark):
    log = spark.createDataFrame([(i, 1, "concentration", m, f"2024-01-01T0{i}:00:00", "E1")
                                 for i, m in enumerate(["Draft", "Draft", "Complete", "Draft"], start=1)],
                                "event_id long, run_id long, stage_key string, save_mode string, submitted_at string, employee string")
    got = sorted((r.version_no, r.completion_status) for r in LC.fold_drafts(log).collect())
    assert got == [(1, "Draft"), (3, "Complete")]


def test_void_state_auto_unvoid(spark):
    acts = ["toggle", "complete_save", "toggle", "toggle", "toggle"]
    log = spark.createDataFrame([(i, 1, "centrifuge", a, "E1", f"2024-01-01T0{i}:00:00") for i, a in enumerate(acts, 1)],
                                "event_id long, run_id long, stage_key string, action string, actor string, logged_at string")
    assert LC.void_state(log).count() == 1
    assert LC.void_state(log.filter("event_id <= 2")).count() == 0


def test_date_args_swap_and_validate():
    assert _date_args("2024-02-01", "2024-01-01") == ("2024-01-01", "2024-02-01")
    assert _date_args("yesterday", "2024-01-01") == ("", "2024-01-01")


def test_exact_point_count_equals_listing(spark):
    # two entries share a created_at (same fallback); row times overlap partly, and one timed
    # point falls exactly on the other entries' fallback time
    rows = [
        (1, 1, "centrifuge", "2024-05-01", "2024-05-01T09:00:00", '{"centrifuge_1_time":"08:00","centrifuge_2_time":" "}', "Complete"),
        (2, 1, "centrifuge", "2024-05-01", "2024-05-01T09:00:00", '{"centrifuge_1_time":"08:00","centrifuge_3_time":"08:30"}', "Complete"),
        (3, 2, "centrifuge", "2024-05-01", "2024-05-01T10:00:00", '{"centrifuge_4_time":"09:00","centrifuge_60_time":"07:00"}', "Complete"),
        (4, 2, "centrifuge", "", "", '{"centrifuge_1_time":"08:00"}', "Complete"),
        (5, 3, "centrifuge", None, "2024-05-02T11:00:00", "not json", "Draft"),
        # its fallback equals entries 1/2's timed point 2024-05-01T08:00:00 on row 1
        (6, 3, "centrifuge", "2024-05-01", "2024-05-01T08:00:00", '{"centrifuge_2_time":"08:00"}', "Complete"),
    ]
    s = sheets_df(spark, rows)
    listed = R.generic_points(s, "centrifuge").count()
    counted = R.generic_point_count(s, "centrifuge").first().point_count
    assert counted == listed


def test_the_last_of_a_repeated_key_wins(spark):
    from batchtrail.sources.tables import form_events, parse_payload, submitted_fields
    df = spark.createDataFrame([('{"a":"1","b":"2","a":"3"}',), ("[]",), (None,), ('{"a":null,"a":"x"}',)], "form_json string")
    maps = [r.m for r in df.select(parse_payload("form_json").alias("m")).collect()]
    assert maps == [{"a": "3", "b": "2"}, {}, {}, {"a": "x"}]
    form = spark.createDataFrame([('{"a":"1","a":"2","save_mode":"Draft","save_mode":"Complete","__change__a":"OP",'
                                   '"__session_signature_x":"s","correction_reason":"r"}',)], "form_json string")
    row = form_events(form).first()
    assert row.save_mode == "Complete" and row.fields == {"a": "2"}
    kept = form.select(submitted_fields(parse_payload("form_json")).alias("f")).first().f
    assert kept == {"a": "2", "__change__a": "OP", "correction_reason": "r"}


def test_a_repeated_time_cell_does_not_stop_the_chart(spark):
    s = sheets_df(spark, [(1, 1, "centrifuge", "2024-05-01", "2024-05-01T09:00:00",
                           '{"centrifuge_1_time":"08:00","centrifuge_1_time":"08:30","centrifuge_1_back_pressure":"4"}', "Complete")])
    assert R.generic_point_count(s, "centrifuge").first().point_count == R.generic_points(s, "centrifuge").count()


def test_numbered_names_are_unique(spark):
    from batchtrail.operators.sequence import unique_names
    names = ["A", "A", "A-2", "A", "A-4", "A-2", "b.pdf", "b.pdf", "b-2.pdf", "b.pdf", ".x", ".x", None, "A-02"]
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    got = [r.unique_name for r in unique_names(df, "name", "id").orderBy("id").collect()]
    assert got == ["A", "A-3", "A-2", "A-5", "A-4", "A-2-2", "b.pdf", "b-3.pdf", "b-2.pdf", "b-4.pdf", ".x", ".x-2", None, "A-02"]

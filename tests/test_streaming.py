"""State of the streaming jobs: expiry, late and repeated deliveries, and what the state holds."""

import json
import random
import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from batchtrail.operators import feeds as FD
from batchtrail.operators import lifecycle as LC
from batchtrail.operators.feeds import entry_union
from batchtrail.sources.fixtures import fixture
from batchtrail.sources.process_tables import from_parquet
from batchtrail.sources.tables import SCHEMAS, reconcile_schema
from batchtrail.streaming import jobs as ST
from tests.conftest import SMALL
from tests.test_jobs import _write_tables


@pytest.fixture(autouse=True)
def few_state_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def _scratch() -> str:
    return tempfile.mkdtemp(prefix="batchtrail-stream-")


def _same(got, want):
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(map(tuple, want.collect()))


# ------------------------------------------------------------------ draft fold

def _submits(spark, rows):
    return spark.createDataFrame([(i, r, s, m, t, "E1") for i, r, s, m, t in rows], ST.SUBMIT_SCHEMA)


def _run_fold(spark, root, lateness="7 days", files=1):
    q = ST.draft_fold_stream(spark, f"{root}/submits", f"{root}/_entries", f"{root}/_ckpt", lateness, files)
    q.awaitTermination(300)
    return q


def _open_drafts(spark, root):
    rows = spark.read.format("statestore").option("stateVarName", "draft").load(f"{root}/_ckpt")
    keys = [json.loads(r.key.fold_key) for r in rows.collect()]
    return {(k.get("run_id"), k["stage_key"]): (r.value.entry_id, r.value.version_no) for k, r in zip(keys, rows.collect())}


def _waiting(spark, root):
    return spark.read.format("statestore").option("stateVarName", "pending").load(f"{root}/_ckpt").count()


def test_draft_fold_stream_equals_batch(spark):
    root = _scratch()
    submits = fixture(spark, SMALL, "fx_submits")
    submits.repartition(3).write.parquet(f"{root}/submits")  # files in no order of time
    q = _run_fold(spark, root, "400 days")
    assert len(q.recentProgress) >= 3  # one micro-batch per file
    assert sum(p["numInputRows"] for p in q.recentProgress) == submits.count()  # and nothing else is read
    _same(ST.folded_entries(spark, f"{root}/_entries", f"{root}/submits"), LC.fold_drafts(submits))
    assert spark.read.parquet(f"{root}/_entries").where("op = 'late'").count() == 0


def test_state_rows_are_the_open_drafts(spark):
    root = _scratch()
    day = lambda d, h: f"2024-01-{d:02d}T{h:02d}:00:00"
    first = [(1, 1, "a", "Draft", day(1, 8)), (2, 1, "a", "Complete", day(1, 9)), (3, 2, "a", "Draft", day(1, 9)), (4, 2, "a", "Draft", day(1, 10)),
             (5, 3, "b", "Complete", day(1, 10)), (6, None, "b", "Draft", day(1, 11))]
    for part in (first, [(7, 9, "z", "Complete", day(20, 0))], [(8, 9, "z", "Complete", day(28, 0))]):  # time passes
        _submits(spark, part).coalesce(1).write.mode("append").parquet(f"{root}/submits")
        _run_fold(spark, root)
    assert _open_drafts(spark, root) == {(2, "a"): (3, 2), (None, "b"): (6, 1)}  # NULL is a key like any other
    assert _waiting(spark, root) == 1  # the last Complete, which a late submit may still precede
    everything = spark.read.schema(ST.SUBMIT_SCHEMA).parquet(f"{root}/submits")
    # a later save of the open draft reads its state alone
    _submits(spark, [(10, 2, "a", "Complete", day(28, 1))]).coalesce(1).write.mode("append").parquet(f"{root}/submits")
    q = _run_fold(spark, root)
    assert sum(p["numInputRows"] for p in q.recentProgress) == 1
    newest = spark.read.parquet(f"{root}/_entries").where("run_id = 2").orderBy(F.desc("batch_id")).first()
    assert (newest.op, newest.entry_id, newest.version_no, newest.completion_status) == ("upsert", 3, 3, "Complete")
    everything = spark.read.schema(ST.SUBMIT_SCHEMA).parquet(f"{root}/submits")
    _same(ST.folded_entries(spark, f"{root}/_entries", f"{root}/submits"), LC.fold_drafts(everything))


def test_late_and_repeated_submits(spark):
    """Late submits that part, join and begin entries; whole batches delivered twice; submits later than the lateness; no stamps."""
    rng = random.Random(5)
    for seed in range(2):
        root = _scratch()
        rows = [(i, rng.randrange(3), rng.choice("ab"), rng.choice(["Draft", "Draft", "Complete", None]),
                 f"2024-01-{rng.randrange(1, 28):02d}T{rng.randrange(24):02d}:00:00") for i in range(60)]
        rows += [(100, 1, "a", "Draft", None), (101, 2, "b", "Complete", "yesterday")]
        rng.shuffle(rows)
        parts = [rows[k::4] for k in range(4)]
        for part in [*parts[:3], parts[1], parts[3], parts[0]]:
            _submits(spark, part).coalesce(1).write.mode("append").parquet(f"{root}/submits")
            _run_fold(spark, root, "3 days" if seed else "30 days")
        once = spark.read.schema(ST.SUBMIT_SCHEMA).parquet(f"{root}/submits").dropDuplicates(["event_id"])
        _same(ST.folded_entries(spark, f"{root}/_entries", f"{root}/submits"), LC.fold_drafts(once))


def test_a_repeated_micro_batch_replaces_its_rows(spark):
    root = _scratch()
    add = ST._add_batch(f"{root}/x", "op")
    rows = spark.createDataFrame([("upsert", 1), ("late", 2)], "op string, v int")
    for _ in range(2):
        add(rows, 7)
    assert spark.read.parquet(f"{root}/x").count() == 2


# -------------------------------------------------------------- machine status

def _entries(spark, root, table, rows, **fixed):
    df = spark.createDataFrame(rows, "id long, run_id long, created_at string")
    for name, value in fixed.items():
        df = df.withColumn(name, F.lit(value))
    reconcile_schema(df, SCHEMAS[table]).coalesce(1).write.mode("append").parquet(f"{root}/{table}")


def _run_status(spark, root, t):
    ST.machine_status_stream(spark, root, t.runs, f"{root}/_cards", f"{root}/_ckpt_status", delay="0 seconds").awaitTermination(300)
    return {r.section: (r.status_label, r.detail, r.is_active) for r in ST.machine_cards(spark, f"{root}/_cards").collect()}


def test_machine_status_stream_equals_batch(spark):
    root = _scratch()
    t = _write_tables(spark, root)
    got = _run_status(spark, root, t)
    u = entry_union(from_parquet(spark, root))
    now = u.agg(F.max("activity_time")).first()[0]
    want = FD.machine_status(spark, FD.activity_feed(from_parquet(spark, root), now, 12, None))
    assert ST.machine_cards(spark, f"{root}/_cards").columns == want.columns
    assert got == {r.section: (r.status_label, r.detail, r.is_active) for r in want.collect()}


def test_a_card_returns_to_not_used_when_time_passes(spark):
    root = _scratch()
    runs = reconcile_schema(spark.createDataFrame([(1, "R1", "Open"), (2, "R2", "Complete")], "id long, run_number string, status string"),
                            SCHEMAS["production_runs"])
    runs.write.parquet(f"{root}/production_runs")
    t = from_parquet(spark, root)
    assert {v[0] for v in _cards_before(spark, root).values()} == {"Not Used"}
    for table in ("filtration_entries", "evaporation_entries"):
        _entries(spark, root, table, [])
    _entries(spark, root, "extraction_entries", [(1, 1, "2024-01-01T08:00:00"), (2, 1, "2024-01-01T06:00:00")], stop_time="")
    _entries(spark, root, "sheet_entries", [(7, 2, "2024-01-01T07:00:00"), (8, None, "")], stage_title="Clarifier", stage_key="clarifier")
    cards = _run_status(spark, root, t)
    assert cards["Extraction"] == ("In Use", "Run R1 | 2024-01-01T08:00:00", True)
    assert cards["Clarifier"] == ("Recently Used", "Run R2 | 2024-01-01T07:00:00", False) and cards["Filtration"][0] == "Not Used"
    # an older entry that comes late changes nothing
    _entries(spark, root, "extraction_entries", [(3, 2, "2024-01-01T07:30:00")], stop_time="09:00")
    assert _run_status(spark, root, t) == cards
    # another machine's activity moves the time on: the clarifier's 12 hours are over, the extraction's end exactly now
    _entries(spark, root, "filtration_entries", [(4, None, "2024-01-01T20:00:00")], shutdown_time="21:00")
    later = _run_status(spark, root, t)
    assert later["Clarifier"][0] == "Not Used" and later["Extraction"] == cards["Extraction"]
    assert later["Filtration"] == ("Recently Used", "2024-01-01T20:00:00", False)
    _entries(spark, root, "filtration_entries", [(5, None, "2024-01-01T20:00:01")], shutdown_time="")
    assert _run_status(spark, root, t)["Extraction"][0] == "Not Used"
    state = spark.read.format("statestore").option("stateVarName", "latest").load(f"{root}/_ckpt_status")
    assert [r.key.section for r in state.collect()] == ["Filtration"]  # expired cards leave no state
    # a machine in use again
    _entries(spark, root, "extraction_entries", [(6, 2, "2024-01-01T21:00:00")], stop_time="")
    assert _run_status(spark, root, t)["Extraction"] == ("In Use", "Run R2 | 2024-01-01T21:00:00", True)


def _cards_before(spark, root):
    return {r.section: (r.status_label, r.detail, r.is_active) for r in ST.machine_cards(spark, f"{root}/_cards").collect()}


# ------------------------------------------------------------------- activity

def test_an_entry_that_comes_again_with_another_stamp_is_one(spark):
    root = _scratch()
    t = _write_tables(spark, root)
    run = lambda: ST.activity_stream(spark, root, t.runs, f"{root}/_feed", f"{root}/_ckpt").awaitTermination(300)
    run()
    before = spark.read.parquet(f"{root}/_feed").count()
    t.extraction.withColumn("created_at", F.lit("2031-05-05T00:00:00")).write.mode("append").parquet(f"{root}/extraction_entries")
    run()
    assert spark.read.parquet(f"{root}/_feed").count() == before

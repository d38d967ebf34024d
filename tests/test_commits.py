"""Appends and exports are visible as a whole or not at all."""

import tempfile

import pytest
from pyspark.sql import functions as F

from batchtrail.operators import lifecycle as LC
from batchtrail.plans import export as EX
from batchtrail.sources import commits as CM
from batchtrail.sources import sinks
from batchtrail.sources.fixtures import fixture
from batchtrail.sources.process_tables import from_fixtures
from tests.conftest import SMALL


def _scratch() -> str:
    return tempfile.mkdtemp(prefix="batchtrail-commit-")


def _batch(spark, names, at="2024-01-05T08:00:00", rows=2):
    entries = spark.createDataFrame([(n, 1, at, at[:10]) for n in names], "entry_key string, run_id long, created_at string, entry_date string")
    kids = spark.createDataFrame([(n, "cycle1", k, f"{n}{k}") for n in names for k in range(rows)],
                                 "entry_key string, row_group string, row_no int, row_time string")
    return entries, [CM.Children("filtration_rows", kids, "filtration_entry_id", ["row_group", "row_no"])]


def _append(spark, root, token, names, **options):
    entries, kids = _batch(spark, names, **options)
    return CM.append_entries_with_children(spark, root, token, "filtration_entries", entries, kids)


def _shown(spark, root):
    t = CM.committed_tables(spark, root)
    j = t.filtration_rows.join(t.filtration.select(F.col("id").alias("e")), F.col("filtration_entry_id") == F.col("e"), "left")
    return ([r.id for r in t.filtration.orderBy("id").collect()],
            [(r.id, r.filtration_entry_id, r.row_time) for r in j.orderBy("id").collect() if r.e is not None], t.filtration_rows.count())


def test_parents_and_children_share_ids_across_appends(spark):
    root = _scratch()
    assert _shown(spark, root) == ([], [], 0)
    assert _append(spark, root, "t1", ["b", "a"]) and _append(spark, root, "t2", ["c"], at="2024-02-01T00:00:00")
    ids, rows, n = _shown(spark, root)
    assert ids == [1, 2, 3] and n == 6
    assert rows == [(1, 1, "a0"), (2, 1, "a1"), (3, 2, "b0"), (4, 2, "b1"), (5, 3, "c0"), (6, 3, "c1")]
    # a token that is committed is not appended again
    assert not _append(spark, root, "t2", ["c"]) and _shown(spark, root)[2] == 6


@pytest.mark.parametrize("step", ["filtration_rows", "commit"])
def test_a_crash_before_the_commit_shows_nothing_and_can_be_repeated(spark, monkeypatch, step):
    root = _scratch()
    _append(spark, root, "t1", ["a"])
    before = _shown(spark, root)
    real_write, real_commit = CM._write, CM._commit

    def write(df, root, table, *rest):
        if table == step:
            raise RuntimeError("lost")
        return real_write(df, root, table, *rest)

    monkeypatch.setattr(CM, "_write", write)
    if step == "commit":
        monkeypatch.setattr(CM, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        _append(spark, root, "t2", ["x", "y"])
    assert _shown(spark, root) == before  # the entries are written, no reader sees them
    monkeypatch.setattr(CM, "_write", real_write)
    monkeypatch.setattr(CM, "_commit", real_commit)
    _append(spark, root, "t2", ["y"])  # the repeated append may differ: what the lost one wrote is replaced
    ids, rows, n = _shown(spark, root)
    assert ids == [1, 2] and n == 4 and rows[2:] == [(3, 2, "y0"), (4, 2, "y1")]


def test_children_without_an_entry_and_repeated_keys_are_refused(spark):
    root = _scratch()
    entries, kids = _batch(spark, ["a", "b"])
    with pytest.raises(ValueError):
        CM.append_entries_with_children(spark, root, "t", "filtration_entries", entries.where("entry_key = 'a'"), kids)
    with pytest.raises(ValueError):
        CM.append_entries_with_children(spark, root, "t", "filtration_entries", entries.unionByName(entries), kids)
    assert _shown(spark, root) == ([], [], 0)
    assert _append(spark, root, "empty", []) and _append(spark, root, "t", ["a"])
    assert _shown(spark, root)[0] == [1]


def test_readings_read_only_committed_batches(spark):
    from batchtrail.plans.performance import machine_performance
    root = _scratch()
    _append(spark, root, "t1", ["a"])
    shown = machine_performance(CM.committed_tables(spark, root), "filtration").count()
    entries, _ = _batch(spark, ["ghost"])
    CM._write(entries.withColumn("id", F.lit(99).cast("long")), root, "filtration_entries", "t9", CM.entry_month())
    assert machine_performance(CM.committed_tables(spark, root), "filtration").count() == shown
    assert [r.id for r in CM.committed(spark, root, "filtration_entries").collect()] == [1]


# --------------------------------------------------------------------- exports

STEPS = ["write_packets", "write_manifest", "write_mark"]


def test_an_export_that_fails_at_any_step_changes_nothing(spark, monkeypatch):
    root = _scratch()
    t = from_fixtures(spark, SMALL)
    voided = LC.void_state(fixture(spark, SMALL, "fx_void_log"))
    run = lambda at, name="weekly": EX.export_scope(spark, t, voided, "since_last", at, root, name, "E3")
    first = run("1998-01-01T00:00:00")
    marks = f"{root}/_state"
    for step in STEPS:
        with monkeypatch.context() as m:
            m.setattr(sinks, step, lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
            with pytest.raises(RuntimeError):
                run("2100-01-01T00:00:00")
        assert sinks.read_mark(spark, marks) == "1998-01-01T00:00:00"
        assert EX.published_export(spark, root, "weekly") == first["path"]
        assert spark.read.json(f"{first['path']}/packets").count() == first["run_count"]
        audits = EX.export_audits(sinks.finished_exports(spark, marks)).collect()
        assert [(a.changed_by, a.new_data, a.action_type, a.record_id) for a in audits] == [("E3", f"weekly built with {first['run_count']} runs", "export", 0)]
    # the next one has everything since the last mark
    second = run("2100-01-01T00:00:00")
    assert second["run_count"] == EX.scoped_runs(t, "since_last", "", "1998-01-01T00:00:00").count() > 0
    assert EX.published_export(spark, root, "weekly") == second["path"] != first["path"]
    assert EX.export_audits(sinks.finished_exports(spark, marks)).count() == 2
    assert EX.published_export(spark, root, "never") is None

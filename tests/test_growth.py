"""What a task holds does not grow with the tables (findings of round 3)."""

import pyarrow as pa
import pytest

from batchtrail.operators import joins as J
from batchtrail.operators import lifecycle as LC
from batchtrail.operators.runs import stage_checklist
from batchtrail.plans.registry import all_queries
from tests.conftest import SMALL

_RUN = pa.struct([("id", pa.int64()), ("open", pa.bool_()), ("updated_at", pa.string()), ("batch_type", pa.string()), ("blend_number", pa.string()),
                  ("split_batch_number", pa.string()), ("labels", pa.list_(pa.string()))])
_SLICE = pa.schema([("request_id", pa.int64()), ("action", pa.string()), ("group_label", pa.string()), ("source_run_ids", pa.list_(pa.int64())),
                    ("requested_at", pa.string()), ("from_runs", pa.list_(_RUN)), ("taken_free", pa.bool_()), ("n", pa.int64()), ("best", _RUN),
                    ("best_was_source", pa.bool_())])


def _plan_without_broadcast(spark, key):
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        return all_queries()[key](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _run(i, label, at):
    return {"id": i, "open": True, "updated_at": at, "batch_type": "blend", "blend_number": label, "split_batch_number": "", "labels": [label]}


@pytest.mark.parametrize("step", [1, 1000])
def test_replay_decides_while_requests_come(monkeypatch, step):
    """A decision is out before the next batch is read; a run touched before its label is asked for is seen all the same."""
    monkeypatch.setattr(LC, "_REPLAY_STEP", step)
    a, b1, b2 = _run(1, "A", "1"), _run(2, "B", "1"), _run(3, "B", "2")
    rows = [(10, "A", [2], [b1], a), (11, "B", [], [], b2), (12, "A", [3], [b2], a), (13, "B", [], [], b2)]
    read = []

    def batches():
        for n, (rid, label, ids, runs, best) in enumerate(rows, 1):
            read.append(rid)
            yield pa.RecordBatch.from_pylist([{"request_id": rid, "action": "blend", "group_label": label, "source_run_ids": ids, "requested_at": str(n + 4),
                                               "from_runs": runs, "taken_free": False, "n": n, "best": best, "best_was_source": False}], schema=_SLICE)

    got = []
    for out in LC._replay(batches()):
        got += [tuple(r.values()) for r in out.to_pylist()]
        assert len(read) == len(got)
    # run 2, a source of request 10, is the newest of B when 11 asks; run 3, a source of 12, is it for 13
    assert got == [(10, 1, None), (11, 2, "label_taken"), (12, 1, None), (13, 3, "label_taken")]


@pytest.mark.parametrize("key", ["run_packets", "review_flags"])
def test_packets_meet_the_runs_once(spark, key):
    """All parts of a run are kept or dropped by one join: no task sorts the run ids once for every part."""
    plan = _plan_without_broadcast(spark, key)
    assert plan.count("SortMergeJoin") == 1 and "LeftSemi" in plan
    assert "payload_json" not in plan


def test_checklist_neither_sorts_nor_shuffles_the_grid(spark):
    plan = _plan_without_broadcast(spark, "stage_checklist")
    assert plan.index("Generate inline") < plan.index("Exchange")
    assert all("stage_key" not in line for line in plan.splitlines() if "Join [" in line and "run_id" in line and "__done" in line)


def test_checklist_of_odd_rows(spark):
    """Unlinked stages let a run finish, marks of no run count nowhere, runs with nothing keep their rows, twice given runs theirs."""
    runs = spark.createDataFrame([(1,), (2,), (3,), (3,), (None,)], "id long")
    sheets = spark.createDataFrame([(1, "a", None), (1, "a", "Complete"), (1, "b", "Draft"), (2, "other", "Complete"), (3, "b", ""), (None, "a", "Complete")],
                                   "run_id long, stage_key string, completion_status string")
    voided = spark.createDataFrame([(1, "a"), (1, "b"), (3, "b"), (3, "other"), (None, "b"), (9, "a"), (2, None)], "run_id long, stage_key string")
    got = sorted((r.run_id or 0, r.stage_key, r.done, r.voided, r.can_finish) for r in stage_checklist(runs, sheets, voided, ["a", "b"]).collect())
    assert got == sorted([(1, "a", True, False, True), (1, "b", False, True, True), (2, "a", False, False, True), (2, "b", False, False, True),
                          *[(3, "a", False, False, False), (3, "b", False, True, False)] * 2, (0, "a", False, False, False), (0, "b", False, False, False)])


@pytest.mark.parametrize("words", [1, 7, J.SIFT_WORDS])
def test_sifted_keeps_every_row_of_a_key(spark, monkeypatch, words):
    """However full the words are, rows of keys pass; NULL keys stand for no row, types that hash differently are left alone."""
    monkeypatch.setattr(J, "SIFT_WORDS", words)
    rows = spark.range(-500, 1500).selectExpr("id", "IF(id % 3 = 0, NULL, concat('k', id)) AS name")
    keys = spark.range(0, 1000, 10).selectExpr("id AS k", "concat('k', id) AS n", "IF(id = 0, NULL, id) AS some", "cast(id AS int) AS i")
    for column, key in (("id", "k"), ("name", "n"), ("id", "some")):
        kept = J.sifted(rows, column, keys, key)
        assert sorted(kept.join(keys, kept[column] == keys[key]).select("id").collect()) == sorted(
            rows.join(keys, rows[column] == keys[key]).select("id").collect())
    assert J.sifted(rows, "id", keys.where("false"), "k").isEmpty()
    assert J.sifted(rows, "id", keys, "i").count() == 2000


def test_sifted_drops_most_other_rows(spark):
    keys = spark.range(0, 100_000, 100)
    assert J.sifted(spark.range(100_000), "id", keys, "id").count() < 1_100


def test_only_child_rows_of_copied_entries_are_shuffled(spark):
    """The bits of the copied entries meet the child rows before their exchange, and no entry's content is aggregated."""
    plan = _plan_without_broadcast(spark, "derived_filtration_rows")
    scan = plan.splitlines()
    at = next(k for k, line in enumerate(scan) if "FileScan" in line and "l_orderkey" in line)
    above = next(k for k in range(at, 0, -1) if "Exchange hashpartitioning" in scan[k])
    assert any("LeftSemi" in line and "getbit" in line for line in scan[above:at])
    assert "payload_json" not in plan

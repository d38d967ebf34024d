"""Property tests: lifecycle folds equal a row-by-row replay of the rules, under any partitioning."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from batchtrail.operators import lifecycle as LC

SUBMIT_SCHEMA = "event_id long, run_id long, stage_key string, save_mode string, submitted_at string, employee string"
VOID_SCHEMA = "event_id long, run_id long, stage_key string, action string, actor string, logged_at string"

events = st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["a", "b"]), st.booleans(), st.integers(0, 40)),
                  min_size=1, max_size=40)


def _stamp(minute: int) -> str:
    return f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:00"


def replay_submits(log):
    """The submit rule applied one event at a time (ordered by time, then id)."""
    entries = {}   # key -> list of [first_id, versions, status]
    for eid, run, stage, complete, minute in sorted(log, key=lambda r: (r[4], r[0])):
        key = (run, stage)
        mode = "Complete" if complete else "Draft"
        current = entries.setdefault(key, [])
        if current and current[-1][2] == "Draft":
            current[-1][1] += 1
            current[-1][2] = mode
        else:
            current.append([eid, 1, mode])
    return sorted((run, stage, first, versions, status)
                  for (run, stage), items in entries.items() for first, versions, status in items)


def replay_voids(log):
    """Toggle flips the mark; a Complete save removes it."""
    voided = {}
    for eid, run, stage, complete_save, minute in sorted(log, key=lambda r: (r[4], r[0])):
        key = (run, stage)
        if complete_save:
            voided.pop(key, None)
        elif key in voided:
            voided.pop(key)
        else:
            voided[key] = eid
    return sorted(voided)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(events, st.integers(1, 5))
def test_fold_drafts_equals_replay(spark, raw, parts):
    log = [(i, run, stage, complete, minute) for i, (run, stage, complete, minute) in enumerate(raw)]
    rows = [(i, run, stage, "Complete" if c else "Draft", _stamp(m), "E1") for i, run, stage, c, m in log]
    df = spark.createDataFrame(rows, SUBMIT_SCHEMA).repartition(parts)
    got = sorted((r.run_id, r.stage_key, r.entry_id, r.version_no, r.completion_status)
                 for r in LC.fold_drafts(df).collect())
    assert got == replay_submits(log)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(events, st.integers(1, 5))
def test_void_state_equals_replay(spark, raw, parts):
    log = [(i, run, stage, complete, minute) for i, (run, stage, complete, minute) in enumerate(raw)]
    rows = [(i, run, stage, "complete_save" if c else "toggle", "E1", _stamp(m)) for i, run, stage, c, m in log]
    df = spark.createDataFrame(rows, VOID_SCHEMA).repartition(parts)
    got = sorted((r.run_id, r.stage_key) for r in LC.void_state(df).collect())
    assert got == replay_voids(log)


SHEET_SCHEMA = ("id long, run_id long, stage_key string, entry_date string, created_at string, payload_json string, "
                "completion_status string")
cells = st.lists(st.tuples(st.sampled_from(["clarifier_filtration", "clarifier_dia"]), st.integers(1, 55),
                           st.sampled_from(["08:00", "09:30", " ", "", "08:00:00"])), max_size=5)
sheets = st.lists(st.tuples(st.sampled_from(["", "2024-05-01", "2024-05-02"]),
                            st.sampled_from(["2024-05-01T08:00:00", "2024-05-01T09:30:00", "2024-05-02T08:00:00", ""]),
                            cells), min_size=1, max_size=12)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(sheets)
def test_exact_point_count_equals_listing(spark, raw):
    """The aggregation-only count equals the number of listed points on any sheets."""
    import json
    from batchtrail.operators import readings as R
    rows = []
    for i, (date, created, cs) in enumerate(raw):
        payload = {f"{p}_{r}_time": t for p, r, t in cs}
        rows.append((i, 1, "clarifier", date, created, json.dumps(payload), "Complete"))
    df = spark.createDataFrame(rows, SHEET_SCHEMA)
    listed = R.generic_points(df, "clarifier").count()
    counted = R.generic_point_count(df, "clarifier").collect()
    assert (counted[0].point_count if counted else 0) == listed


def replay_groups(runs, requests):
    """The rule applied one request at a time: (outcomes by request, runs afterwards).  Runs: id -> header; ids are given in request order."""
    runs = {i: dict(r) for i, r in runs.items()}
    known, out = set(runs), {}
    for rid, action, label, sources, given, at in sorted(requests, key=lambda r: (r[5], r[0])):
        label = label.strip()
        sources = list(dict.fromkeys(s for s in sources if s > 0))
        seed = given if given in sources else sources[0] if sources else None
        field = "blend" if action == "blend" else "split"
        found = sorted((i for i, r in runs.items() if label and label in (r["number"], r["batch"])),
                       key=lambda i: (runs[i]["open"], runs[i]["at"], i))
        target = found[-1] if found else None
        shown = target if target in known else None
        if not label:
            why = "blank_label"
        elif seed not in known:
            why = "no_source_run"
        elif target in sources:
            why = "label_is_source"
        elif target is not None and (runs[target]["type"] != action or runs[target][field] != label):
            why = "label_taken"
        else:
            why = ""
        out[rid] = (why, seed, shown)
        if why:
            continue
        if target is None:
            target = -rid
            runs[target] = {"number": label, "batch": label, "open": True, "at": at, "type": action, "blend": "", "split": ""}
        for i in [s for s in sources if s in known]:
            runs[i]["type"] = "standard"
        for i in {*(s for s in sources if s in known), target}:
            runs[i].update(blend="", split="", at=max(at, runs[i]["at"]))
            runs[i][field] = label
    return out, {i: r for i, r in runs.items() if i in known}


def _groups(seed, n):
    rng = random.Random(seed)
    runs = {}
    for i in range(1, 13):
        kind = rng.choice(["blend", "split", "standard"])
        label = rng.choice("ABCDE")
        runs[i] = {"number": label if i % 2 else f"R{i}", "batch": rng.choice(["", "", label]), "open": rng.random() < 0.6, "at": _stamp(rng.randrange(5)),
                   "type": kind, "blend": label if kind == "blend" else "", "split": label if kind == "split" else ""}
    requests = [(100 + k, rng.choice(["blend", "split"]), rng.choice(["A", "B", "C", " D ", "E", "N1", "N2", " "]),
                 [rng.choice([*range(1, 15), 0, -2]) for _ in range(rng.randrange(4))], rng.choice([None, 3, 5]), _stamp(10 + rng.randrange(n)))
                for k in range(n)]
    return runs, requests


@pytest.mark.parametrize("seed, n, slice_rows", [(1, 40, LC.REPLAY_ROWS), (2, 120, 25)])
def test_group_requests_equal_a_replay_in_order(spark, seed, n, slice_rows):
    """Several sources, chains of requests that undo each other's targets, labels of several runs, unknown and repeated ids."""
    runs, requests = _groups(seed, n)
    table = spark.createDataFrame([(i, r["number"], r["batch"], "Open" if r["open"] else "Complete", r["at"], r["type"], r["blend"], r["split"])
                                   for i, r in runs.items()], "id long, run_number string, batch_number string, status string, updated_at string, "
                                                              "batch_type string, blend_number string, split_batch_number string")
    log = spark.createDataFrame(requests, "request_id long, action string, group_label string, source_run_ids array<long>, source_run_id long, "
                                          "requested_at string").repartition(3)
    checked = LC.group_label_requests(table, log, slice_rows)
    want, after = replay_groups(runs, requests)
    rows = checked.collect()
    assert {r.request_id: (r.reason, r.source_run_id) for r in rows} == {i: (why, s) for i, (why, s, _) in want.items()}
    assert {r.request_id: r.target_run_id for r in rows if r.reason in ("", "label_is_source", "label_taken")} == {
        i: t for i, (why, _, t) in want.items() if why in ("", "label_is_source", "label_taken")}
    got = {r.run_id: (r.blend_number, r.split_batch_number, r.batch_type) for r in LC.apply_group_labels(table, checked).collect()}
    assert got == {i: (r["blend"], r["split"], r["type"]) for i, r in after.items() if i in got}
    assert all(runs[i] == r for i, r in after.items() if i not in got)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(1, 2), st.sampled_from(["centrifuge", "clarifier"]), st.integers(0, 6),
                          st.sampled_from(["Draft", "Complete", "", None])), max_size=14),
       st.lists(st.tuples(st.integers(1, 3), st.integers(0, 6), st.sampled_from(["review", "quick"])), min_size=1, max_size=8))
def test_finalize_equals_replay(spark, saves, asks):
    """Ids and save times are independent, so a later save may carry a lower id."""
    at = lambda h: f"2024-01-01T{h:02d}:00:00"
    sheets = [(i, r, s, at(h), c) for i, (r, s, h, c) in enumerate(saves, 1)]
    requests = [(i, r, p, "E1", at(h)) for i, (r, h, p) in enumerate(asks, 1)]
    runs = spark.createDataFrame([(1, "Open"), (2, "Open")], "id long, status string")
    got = {r.run_id: r.accepted_requests for r in LC.finalize_runs(
        runs, spark.createDataFrame(requests, "request_id long, run_id long, path string, employee string, requested_at string"),
        spark.createDataFrame(sheets, "id long, run_id long, stage_key string, created_at string, completion_status string")).collect()}
    want = {}
    for _i, run, path, _e, when in requests:
        latest = {}
        for sheet in sheets:  # ids ascend
            if sheet[1] == run and sheet[3] <= when:
                latest[sheet[2]] = sheet[4] or "Complete"
        fine = run in (1, 2) and (path == "quick" or "Complete" in latest.values())
        want[run] = want.get(run, 0) + fine
    assert got == want

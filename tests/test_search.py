"""Trigram searches equal the scan; pages equal the sorted listing."""

import tempfile

import pytest
from pyspark.sql import functions as F

from batchtrail.operators import paging as PG
from batchtrail.operators import postings as PO
from batchtrail.operators import runs as RU

COLUMNS = ["run_number", "batch_number", "product_name"]


@pytest.fixture(scope="module")
def runs(spark):
    rows = [(i, f"R{i}", "" if i % 7 == 0 else f"B{i % 50}", ["Plain 100%", "a\\b_c", "İstanbul straße", None][i % 4]) for i in range(600)]
    rows += [(1000, None, None, None), (1001, "ab", "", ""), (1002, "", "", ""), (1003, "xyzxyzxyz", None, "under_score"), (1004, "UNDER-SCORE", "r 1", "100 %")]
    return spark.createDataFrame(rows, "id long, run_number string, batch_number string, product_name string").repartition(4)


@pytest.fixture(scope="module")
def index(runs):
    path = tempfile.mkdtemp(prefix="batchtrail-postings-") + "/index"
    PO.build(runs, "id", COLUMNS, path)
    return path


@pytest.mark.parametrize("search", ["", "r1", "R12", "r 1", "plain", "100%", "1_0", "der_sco", "a\\b", "\\b_c", "stanbul", "straße", "zxyzx", "%", "___", "nothing",
                                    "PLAIN 10", "B4", "in 100"])
def test_search_equals_the_scan(spark, runs, index, search):
    want = {r.id for r in RU.runs_search(runs.withColumn("status", F.lit("Open")), search).collect()}
    got = [r.id for r in PO.find(spark, index, COLUMNS, search).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_a_search_reads_the_folders_of_its_trigrams(spark, index):
    plan = PO.candidates(spark, index, ["r12"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "gram_folder" in plan.split("PartitionFilters: [")[1].split("]")[0] and "EqualTo(gram,r12)" in plan.replace("In(gram, [r12])", "EqualTo(gram,r12)")
    found = PO.find(spark, index, COLUMNS, "R123")
    filters = found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1:]
    assert any("id_folder" in f.split("]")[0] for f in filters)
    assert PO.grams_of("ab%c_defg") == ["def", "efg"] and PO.grams_of("aéb") == []


def test_pages_equal_the_sorted_listing(spark):
    rows = [(i, f"R{i}", None if i % 9 == 0 else f"2024-01-{1 + i % 5:02d}") for i in range(503)]  # many ties
    runs = spark.createDataFrame(rows, "id long, run_number string, updated_at string").repartition(5)
    ordered = [r.id for r in runs.orderBy(*RU.newest_first()).collect()]
    numbered = PG.positions(runs, RU.newest_first())
    assert PG.last_page(numbered, 25) == 21 and PG.last_page(numbered.limit(0), 25) == 1
    for page in (1, 2, 11, 21, 22):
        assert [r.id for r in PG.page_of(numbered, page, 25).collect()] == ordered[25 * (page - 1):25 * page]
        assert [r.id for r in RU.runs_page(runs, page, 25).collect()] == ordered[25 * (page - 1):25 * page]
    assert "GreaterThan(position,250)" in PG.page_of(numbered, 11, 25)._jdf.queryExecution().executedPlan().toString()


def test_a_cursor_walks_through_the_listing(spark):
    rows = [(i, None if i % 9 == 0 else f"2024-01-{1 + i % 3:02d}") for i in range(60)]
    runs = spark.createDataFrame(rows, "id long, updated_at string")
    ordered = [r.id for r in runs.orderBy(*RU.newest_first()).collect()]
    seen, at, last = [], None, None
    while page := PG.page_after(runs, 25, at, last).collect():
        seen += [r.id for r in page]
        at, last = page[-1].updated_at, page[-1].id
    assert seen == ordered

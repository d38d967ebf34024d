"""Extra columns may be called like anything the operators use; fits don't depend on the order of the rows."""

from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from batchtrail.llm import near_dedup, quality, url_filter
from tests.llm import cases

NAMES = ["list", "verdict", "pattern", "active", "best", "evidence", "q", "score", "prior", "n", "s", "ss", "__n", "__p", "__row", "__of", "__all", "__host", "__path",
         "__quality", "host", "sha", "node", "class_id", "representative"]


def crowded(df):
    """``df`` with a column of every name that it doesn't have yet."""
    return df.select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES if n not in df.columns])


def own(rows, columns, replaced):
    extra = [n for n in NAMES if n in columns and n not in replaced]
    return all(r[n] == f"own {n}" for r in rows for n in extra)


def test_url_filter_keeps_the_columns_of_its_captures(spark, tmp_path):
    at = datetime(2024, 1, 2)
    captures = crowded(spark.createDataFrame([(1, "http://a.b.com/x", at), (2, "http://c.com", at), (None, None, None)], "page_id long, url string, fetched_at timestamp"))
    entries = spark.createDataFrame([("spam", "b.com", datetime(2024, 1, 1), "add")], "list string, pattern string, at timestamp, action string")
    judged = url_filter.judge(captures, entries)
    results = ["verdict", "list", "pattern", "active"]
    assert len(judged.columns) == len(set(judged.columns)) and set(judged.columns) == {*captures.columns, *results}
    rows = judged.collect()
    assert {(r.page_id, r.verdict, r.list, r.pattern, r.active) for r in rows} == {
        (1, "blocked", "spam", "b.com", 1), (2, "unlisted", None, None, 0), (None, "unknown", None, None, 0)}
    assert own(rows, judged.columns, results)
    judged.write.parquet(str(tmp_path / "judged"))


def test_a_long_active_entry_is_written_for_asked_days_only(spark):
    captures = spark.createDataFrame([(1, "http://a.com/", datetime(2001, 1, 1)), (2, "http://a.com/", datetime(2023, 1, 1)), (3, "http://a.com/", datetime(1999, 1, 1))],
                                     "page_id long, url string, fetched_at timestamp")
    entries = spark.createDataFrame([("spam", "a.com", datetime(2000, 1, 1), "add")], "list string, pattern string, at timestamp, action string")
    found = url_filter.matches(captures, entries, "page_id")
    assert {r.page_id for r in found.collect()} == {1, 2}
    # no row per day of the entry's life
    assert "valid_to" in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and "interval" not in plan.lower()


def test_quality_keeps_the_columns_of_its_documents(spark, tmp_path):
    docs = crowded(cases.docs(spark).drop("score", "node", "sha", "row", "key"))
    labels = cases.labels(spark, [(1, 1, 0), (6, 1, 0), (9, 0, 0), (5, 0, 0)])
    scored = quality.with_quality(docs, labels, F.col("source"), F.col("lang"), out="q")
    assert len(scored.columns) == len(set(scored.columns)) and set(scored.columns) == set(docs.columns)
    rows = scored.collect()
    assert len(rows) == 13 and own(rows, scored.columns, ["q", "evidence"]) and all(0 <= r.q <= 1 and 0 <= r.evidence <= 1 for r in rows)
    scored.write.parquet(str(tmp_path / "scored"))
    kept = quality.good_documents(docs, labels, F.col("source"), F.col("lang"), threshold=0.0)
    assert kept.columns == docs.columns and kept.count() == 13 and own(kept.collect(), kept.columns, [])
    best = near_dedup.one_per_class(docs)
    assert best.columns == docs.columns and own(best.collect(), best.columns, [])


def test_the_fit_does_not_depend_on_the_order_of_the_rows(spark, small_docs, small_labels):
    twice = small_docs.unionByName(small_docs.withColumn("text", F.concat(F.lit("b "), "text")))  # several texts of an id
    models = [quality.train(d, small_labels) for d in (twice, twice.orderBy(F.rand(3)).repartition(7))]
    assert all(np.array_equal(np.asarray(a), np.asarray(b)) for a, b in zip(*models))

"""Activity dashboard (SURVEY lifecycle B): one feed, four consumers.

The reference re-runs the union query for every widget.  Here the feed of the
window is computed once and persisted (memory, spilling to disk) because four
outputs read it; everything downstream is a narrow filter or a small
aggregation.  The caller unpersists with ``release``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from batchtrail.operators import feeds as FD
from batchtrail.sources.process_tables import ProcessTables


@dataclass
class Dashboard:
    feed: DataFrame
    run_groups: DataFrame
    machine_status: DataFrame
    in_use: DataFrame
    process_rows: DataFrame

    def release(self) -> None:
        self.feed.unpersist()


def activity_dashboard(spark: SparkSession, t: ProcessTables, as_of: str, hours: int = 12) -> Dashboard:
    feed = FD.activity_feed(t, as_of, hours, None).persist(StorageLevel.MEMORY_AND_DISK)
    return Dashboard(feed=feed, run_groups=FD.run_groups(feed), machine_status=FD.machine_status(spark, feed),
                     in_use=FD.in_use_items(feed, 10), process_rows=FD.process_activity(feed))

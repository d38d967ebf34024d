"""Pages of a listing without sorting all rows before them (O-SRT-3).

``positions`` numbers the rows of a listing once by a range-partitioned scan; its
files hold ranges of positions, so page n reads the row groups of its range
alone.  ``page_after`` goes on from the last row shown (a keyset cursor).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchtrail.operators.sequence import assign_ids
from batchtrail.session import stored


def positions(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` with the 1-based ``position`` of each row in ``order`` (which must be total), stored in ranges of positions."""
    return stored(assign_ids(df, order, 0, "position"), "positions")


def page_of(numbered: DataFrame, page: int, per_page: int) -> DataFrame:
    """Page ``page`` (1-based) of a numbered listing; pages past its end are empty."""
    page, per_page = max(1, int(page)), max(1, int(per_page))
    first = (page - 1) * per_page
    return numbered.where((F.col("position") > first) & (F.col("position") <= first + per_page)).orderBy("position")


def last_page(numbered: DataFrame, per_page: int) -> int:
    """Number of the last page, 1 for an empty listing."""
    n = numbered.agg(F.max("position")).first()[0] or 0
    return max(1, -(-n // max(1, int(per_page))))


def page_after(runs: DataFrame, per_page: int, updated_at: str | None = None, last_id: int | None = None) -> DataFrame:
    """The ``per_page`` runs after the one with this stamp and id, newest first; the first page without ``last_id``."""
    at, key = F.col("updated_at"), F.col("id")
    if last_id is not None:
        same = at.isNull() if updated_at is None else at == F.lit(updated_at)
        later = F.lit(False) if updated_at is None else (at < F.lit(updated_at)) | at.isNull()
        runs = runs.where(later | (same & (key < F.lit(last_id))))
    return runs.orderBy(at.desc_nulls_last(), key.desc()).limit(max(1, int(per_page)))

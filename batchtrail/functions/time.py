"""Date/time text rules (O-SCL-7/8/22, T1, T15, T21).

Stored stamps are local ``YYYY-MM-DDTHH:MM:SS`` text; string order is time
order, so comparisons stay on the text and are pushed down as string
predicates.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchtrail.functions.text import ColumnOrName, clean, col, nonblank


def effective_date(entry_date: ColumnOrName = "entry_date", created_at: ColumnOrName = "created_at") -> Column:
    """``COALESCE(entry_date, substr(created_at, 1, 10))`` - NULL only, '' stays (T1)."""
    return F.coalesce(col(entry_date), F.substring(col(created_at), 1, 10))


def point_time(entry_date: ColumnOrName, entry_time: ColumnOrName, created_at: ColumnOrName) -> Column:
    """Chart timestamp text from saved date/time pieces.

    date = entry_date else created_at[:10]; ``HH:MM`` gets ``:00``; both present ->
    ``dateTtime``; otherwise created_at, else the date.
    """
    created = clean(created_at)
    date_text = F.coalesce(nonblank(entry_date), F.substring(created, 1, 10))
    t = clean(entry_time)
    time_text = F.when(F.length(t) == 5, F.concat(t, F.lit(":00"))).otherwise(t)
    return (F.when((date_text != "") & (time_text != ""), F.concat(date_text, F.lit("T"), time_text))
            .otherwise(F.coalesce(F.nullif(created, F.lit("")), date_text)))


def with_point_time(df: DataFrame, entry_date: ColumnOrName, entry_time: ColumnOrName, created_at: ColumnOrName,
                    out: str = "point_time") -> DataFrame:
    """``point_time`` as staged columns: each cleaned piece is computed once per row.

    Catalyst keeps a projection separate when its result is used more than
    once, so the staged form avoids re-evaluating the nested pieces.
    """
    staged = (df.withColumn("__pt_c", clean(created_at))
              .withColumn("__pt_d", F.coalesce(nonblank(entry_date), F.substring(F.col("__pt_c"), 1, 10)))
              .withColumn("__pt_t0", clean(entry_time))
              .withColumn("__pt_t", F.when(F.length("__pt_t0") == 5, F.concat(F.col("__pt_t0"), F.lit(":00")))
                          .otherwise(F.col("__pt_t0"))))
    value = (F.when((F.col("__pt_d") != "") & (F.col("__pt_t") != ""),
                    F.concat(F.col("__pt_d"), F.lit("T"), F.col("__pt_t")))
             .otherwise(F.coalesce(F.nullif(F.col("__pt_c"), F.lit("")), F.col("__pt_d"))))
    return staged.withColumn(out, value).drop("__pt_c", "__pt_d", "__pt_t0", "__pt_t")


def has_point_time(entry_date: ColumnOrName, created_at: ColumnOrName) -> Column:
    """``point_time(...) != ''`` for any time value: false only when both the date and
    ``created_at`` are blank.  Entry-level, so it filters before rows are exploded."""
    return (clean(created_at) != "") | (clean(entry_date) != "")


def date_prefix(*cols: ColumnOrName) -> Column:
    """First non-blank of the columns, cut to 10 chars; ``undated`` if none."""
    return F.coalesce(*[F.substring(nonblank(c), 1, 10) for c in cols], F.lit("undated"))


def month_folder(prefix: Column) -> Column:
    return F.when(F.length(prefix) >= 7, F.substring(prefix, 1, 7)).otherwise(F.lit("undated"))


def minus_hours(as_of: str, hours: int) -> str:
    """``as_of`` minus N hours as stamp text, computed at plan time.

    ``as_of`` is in the data's own zone (T5), so the cutoff is a plain string
    literal and the filter reaches the Parquet scan as a string predicate.
    """
    moment = datetime.strptime(as_of, "%Y-%m-%dT%H:%M:%S") - timedelta(hours=max(1, int(hours)))
    return moment.strftime("%Y-%m-%dT%H:%M:%S")


def minus_days(as_of: str, days: int) -> str:
    day = datetime.strptime(as_of[:10], "%Y-%m-%d") - timedelta(days=days)
    return day.strftime("%Y-%m-%d")


def stamp_to_timestamp(c: ColumnOrName) -> Column:
    """Parsed timestamp of a stamp text; NULL when unparseable."""
    return F.try_to_timestamp(F.replace(col(c), F.lit("T"), F.lit(" ")))

"""Positions and running sums within groups that may be hot (O-SCL-29, O-WIN-10, O-STATE-1/6).

``row_number().over(partitionBy(key))`` numbers a whole group in one task.
Here a running value is a segmented prefix scan: the rows are range-partitioned
by (key, order), so a hot key takes as many partitions as it needs; each
partition is scanned once in its order; what the key at a partition's end has
come to is carried to the rows of the same key at the start of the next one.
The rows move once and are written once, the carries are one number per
partition.  Results equal the plain window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchtrail.session import ship_package, stored


def _ordered(value):
    """Sort key of a value or struct with NULL first."""
    if isinstance(value, dict):
        return tuple((v is not None, _ordered(v) if v is not None else 0) for v in value.values())
    return value


def _summed(value: pa.Array, new: np.ndarray, before):
    """(inclusive running sums, exclusive ones) of one batch; segments begin where ``new``, the first goes on from ``before``."""
    v = pc.fill_null(value, 0).to_numpy(zero_copy_only=False)
    total, starts = np.cumsum(v), np.flatnonzero(new)
    run = total - np.concatenate(([-(before or 0)], total[starts] - v[starts]))[np.cumsum(new)]
    return run, run - v


def _largest(value: pa.Array, new: np.ndarray, before):
    """(inclusive running maxima, exclusive ones) of one batch, NULL before the first value."""
    run, earlier = [], []
    for v, begins in zip(value.to_pylist(), new):
        if begins:
            before = None
        earlier.append(before)
        if v is not None and (before is None or _ordered(v) > _ordered(before)):
            before = v
        run.append(before)
    return run, earlier


def _scan(df: DataFrame, keys: list[str], order: list[Column | str], value: Column, out: str, inclusive: bool, local, total: str) -> DataFrame:
    """Running value of ``value`` inside each ``keys`` group along ``order`` (which must be total), see the module's text.

    ``local`` scans a batch (``_summed``, ``_largest``); ``total`` combines a carry with it ('sum' or 'max').
    With ``inclusive=False`` the current row is not counted.  NULL is a key like any other.
    """
    spark = df.sparkSession
    ship_package(spark)
    key = F.to_json(F.struct(*keys)) if keys else F.lit("")
    by = [F.col(k).asc_nulls_first() for k in keys] + list(order)
    ranged = df.withColumn("__v", value).withColumn("__key", key).repartitionByRange(*by).sortWithinPartitions(*by)
    kind = ranged.schema["__v"].dataType
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields] + [
        T.StructField("__run", kind), T.StructField("__part", T.IntegerType()), T.StructField("__head", T.BooleanType()),
        T.StructField("__first", T.StringType()), T.StructField("__last", T.StringType()), T.StructField("__one", T.BooleanType())])
    own = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = held = None
        one, part, fields = True, TaskContext.get().partitionId(), None
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            key, fields = batch.column("__key"), batch.schema
            new = np.zeros(n, dtype=bool)
            new[1:] = pc.not_equal(key.slice(1), key.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            if first is None:
                first = key[0].as_py()
            else:
                new[0] = key[0].as_py() != last
            upto, before = local(batch.column("__v"), new, held)
            last, held = key[n - 1].as_py(), upto[-1]
            inside = np.cumsum(new) == 0 if one else np.zeros(n, dtype=bool)
            one = one and not new.any()
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in own], pa.array(upto if inclusive else before, fields.field("__v").type), pa.array(np.full(n, part), pa.int32()),
                 pa.array(inside), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.bool_())], names=schema.names)
        if first is not None:  # one row about the partition
            held = held.item() if isinstance(held, np.generic) else held
            yield pa.RecordBatch.from_arrays(
                [*[pa.nulls(1, fields.field(c).type) for c in own], pa.array([held], fields.field("__v").type), pa.array([part], pa.int32()),
                 pa.nulls(1, pa.bool_()), pa.array([first]), pa.array([last]), pa.array([one])], names=schema.names)

    written = stored(ranged.mapInArrow(run, schema), "scan")
    carries, carry, before = [], None, None
    # one row per shuffle partition
    for p in sorted(written.where("__first IS NOT NULL").select("__part", "__first", "__last", "__one", "__run").collect(), key=lambda r: r["__part"]):
        into = carry if p["__first"] == before else None
        if into is not None:
            carries.append((p["__part"], into))
        carry, before = p["__run"], p["__last"]
        if p["__one"] and into is not None:
            carry = into + (carry or 0) if total == "sum" else into if carry is None or tuple(into) > tuple(carry) else carry
    rows = written.where("__first IS NULL")
    if carries:
        given = spark.createDataFrame(carries, T.StructType([T.StructField("__of", T.IntegerType()), T.StructField("__carry", kind)]))
        rows = rows.join(F.broadcast(given), F.col("__head") & (F.col("__part") == F.col("__of")), "left")
    else:
        rows = rows.withColumn("__carry", F.lit(None).cast(kind))
    whole = F.coalesce("__run", F.lit(0)) + F.coalesce("__carry", F.lit(0)) if total == "sum" else F.greatest("__run", "__carry")
    return rows.select(*own, whole.alias(out))


def running_sum_within(df: DataFrame, keys: list[str], order: list[Column | str], value: Column, out: str, inclusive: bool = True) -> DataFrame:
    """Running sum of ``value`` (0 where no row counts), see ``_scan``."""
    return _scan(df, keys, order, value.cast("long"), out, inclusive, _summed, "sum")


def running_max_within(df: DataFrame, keys: list[str], order: list[Column | str], value: Column, out: str, inclusive: bool = True) -> DataFrame:
    """Running maximum of ``value``, a struct (NULL where no row counts), see ``_scan``."""
    return _scan(df, keys, order, value, out, inclusive, _largest, "max")


def sequence_within(df: DataFrame, keys: list[str], order: list[Column | str], out: str = "seq") -> DataFrame:
    """1-based position of each row inside its ``keys`` group in ``order``."""
    return running_sum_within(df, keys, order, F.lit(1), out).withColumn(out, F.col(out).cast("int"))


def unique_names(df: DataFrame, name_col: str, id_col: str) -> DataFrame:
    """The first holder of a name (lowest id) keeps it; the others get the free numbers ``-2``, ``-3`` ... in id order.

    A number is free unless some row holds the numbered name already; it goes
    before the extension (``a.pdf`` -> ``a-2.pdf``).  Numbered names of two
    different names never meet, so the result is unique after one pass: with
    the taken numbers of a name sorted, ``free`` numbers lie below each, and the
    k-th later holder skips those with ``free < k``, a running count along k.
    NULL names stay NULL.
    """
    named = df.filter(F.col(name_col).isNotNull())
    seq = sequence_within(named, [name_col], [F.col(id_col)], out="__seq")
    numbered = r"^(.+)-([2-9]|[1-9][0-9]+)(\.[^.]+)?$"
    plain = F.concat(F.regexp_extract("__name", numbered, 1), F.regexp_extract("__name", numbered, 3))
    number = F.regexp_extract("__name", numbered, 2).try_cast("long")
    held = (named.select(F.col(name_col).alias("__name")).distinct()
            .select(plain.alias(name_col), number.alias("__n")).filter(F.col("__n").isNotNull()))
    order = sequence_within(held, [name_col], [F.col("__n")], out="__i")
    taken = order.select(name_col, (F.col("__n") - F.col("__i") - 1).alias("__free"))
    later = seq.filter(F.col("__seq") > 1)
    # taken numbers count for every later holder k = seq - 1 with free < k
    line = (later.select(name_col, F.col(id_col).alias("__id"), (F.col("__seq") - 1).cast("long").alias("__k"), F.lit(0).alias("__t"))
            .unionByName(taken.select(name_col, F.lit(None).cast(df.schema[id_col].dataType).alias("__id"),
                                      (F.col("__free") + 1).alias("__k"), F.lit(1).alias("__t"))))
    skipped = running_sum_within(line, [name_col], [F.col("__k"), F.col("__t").desc(), F.col("__id")], F.col("__t"), "__skip")
    suffix = skipped.filter(F.col("__t") == 0).select("__id", (F.col("__k") + 1 + F.col("__skip")).alias("__number"))
    joined = df.join(suffix, df[id_col] == suffix["__id"], "left")
    ext = F.regexp_extract(F.col(name_col), r"^.+(\.[^.]+)$", 1)
    stem = F.substr(F.col(name_col), F.lit(1), F.char_length(name_col) - F.char_length(ext))
    name = F.when(F.col("__number").isNull(), F.col(name_col)).otherwise(
        F.concat(stem, F.lit("-"), F.col("__number").cast("string"), ext))
    return joined.withColumn("unique_name", name).drop("__id", "__number")


def assign_ids(df: DataFrame, order: list[Column | str], base: int, out: str = "id") -> DataFrame:
    """Contiguous ids ``base+1, base+2, ...`` in ``order`` (O-STATE-6)."""
    seq = running_sum_within(df, [], order, F.lit(1), "__seq")
    return seq.withColumn(out, (F.col("__seq") + F.lit(int(base))).cast("long")).drop("__seq")

"""Shared pieces of the training-data operators: scratch tables, checked broadcasts, array hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows a side may have to be broadcast; above it the plain shuffled join is used.
BROADCAST_ROWS = 100_000
#: Text bytes that one numpy pass inside a task works on.
SLICE_BYTES = 2 << 20

_U = np.uint64


# ------------------------------------------------------------------ tables

def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where it is unset: a fresh temporary folder for a local master (tests), the
    warehouse folder otherwise, since that one is shared on a cluster.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        configured = tempfile.mkdtemp(prefix="batchtrail-scratch-")
    else:
        configured = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: its lineage is cut, and a
    lost executor costs a re-read, not the work before."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/batchtrail/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def text_of(column: str = "text") -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def kept_columns(columns: list[str], *results: str) -> list[Column]:
    """The columns of a row kept in the struct ``__all``, without those that a result replaces."""
    return [F.col("__all").getField(c).alias(c) for c in columns if c not in results]


# ------------------------------------------------------------------ arrays

def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of the splitmix generator on uint64 values."""
    x = np.asarray(x, dtype=_U)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def unit_floats(x: np.ndarray) -> np.ndarray:
    """uint64 hashes as floats in [0, 1)."""
    return (x >> _U(11)).astype(np.float64) * 2.0 ** -53


def slices(texts: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``max_bytes`` of text (a longer text is a range of its own)."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start, n = 0, len(sizes)
    while start < n:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
        yield start, stop
        start = stop


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(code of every word, first word of every text with a closing entry, distinct words)."""
    lists = pc.utf8_split_whitespace(texts)
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    some = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # the kernel gives an empty word at either end
    if not some.all():
        offsets = np.concatenate(([0], np.cumsum(some)))[offsets]
        words = words.filter(pa.array(some))
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), offsets, coded.dictionary


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(start, start + count)``."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return np.arange(total, dtype=np.int64) + shift

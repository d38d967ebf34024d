"""Packing: length buckets of least padding, and token-budget batches inside each bucket.

1. One grouped count gives the exact number of texts of each length.  ``n``
   different lengths need texts of at least ``n * n / 2`` tokens together, so the
   driver gets few rows: under 1.5 million for 10^12 tokens.
2. Dynamic programming over the lengths chooses the bucket edges with the least
   padding in total (every text is padded to the edge of its bucket).
3. Inside a bucket of edge ``e`` a batch holds ``budget // e`` texts (one, if the
   edge exceeds the budget).  Places are counted per slice of the bucket, and
   slices are chained by their totals, so no task sees a whole bucket.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchtrail.llm.common import stored

BUCKETS = 12
BUDGET = 65_536
#: Texts of a bucket that one slice holds, about.
SLICE_ROWS = 20_000


def grid_edge(length: Column) -> Column:
    """Upper edge of the length's bin: the length itself up to 32, then sixteen bins between powers of two.

    At most 32 + 16 per further power of two: under 1,000 bins for any 63-bit length.  ``pack`` doesn't round lengths.
    """
    step = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.floor(F.log2(F.greatest(length - 1, F.lit(1)) + 0.5)) - 4))
    return F.when(length <= 32, length).otherwise((F.ceil(length / step) * step).cast("long")).cast("long")


def optimal_edges(edges: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Bucket edges (a subset of ``edges``, ascending, the largest among them) that minimise the sum of edge x count."""
    order = np.argsort(edges)
    edges, counts = np.asarray(edges)[order].tolist(), np.asarray(counts)[order].tolist()  # whole numbers without bounds
    n = len(edges)
    if n <= buckets:
        return edges
    before = [0, *accumulate(counts)]
    # cost of the first j lengths in k + 1 buckets, the last of which holds lengths i..j-1, without the part edge x before
    # that all i share: a line in the edge with slope -before[i]; the lowest line moves only forward as edges rise
    cost: list[int] = [e * b for e, b in zip([0, *edges], before)]
    choice = np.zeros((buckets, n + 1), dtype=np.int32)
    for k in range(1, buckets):
        now, hull, at = [0] * (n + 1), [], 0
        for j in range(k + 1, n + 1):
            i = j - 1
            while len(hull) - at >= 2:
                p, q = hull[-2], hull[-1]
                # q is nowhere the only lowest line between p and i
                if (cost[i] - cost[p]) * (before[q] - before[p]) > (cost[q] - cost[p]) * (before[i] - before[p]):
                    break
                hull.pop()
            hull.append(i)
            edge = edges[j - 1]
            while at + 1 < len(hull) and cost[hull[at + 1]] - before[hull[at + 1]] * edge < cost[hull[at]] - before[hull[at]] * edge:
                at += 1
            best = hull[at]
            choice[k, j] = best
            now[j] = cost[best] + (before[j] - before[best]) * edge
        cost = now
    out, j = [], n
    for k in range(buckets - 1, -1, -1):
        out.append(edges[j - 1])
        j = int(choice[k, j])
    return out[::-1]


def word_length(column: str = "text") -> Column:
    """Number of tokens of a text, here its white-space separated words; null is 0."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(r"[^ \t\n\r\f]+")), F.lit(0)).cast("long")


def pack(docs: DataFrame, length: Column | None = None, id_col: str = "doc_id", buckets: int = BUCKETS,
         budget: int = BUDGET) -> DataFrame:
    """``(doc_id, length, bucket, edge, batch, place, padding)`` for every row of ``docs``.

    ``length`` defaults to the number of words of ``text``; a null length is 0.
    ``bucket`` counts from 1 by rising ``edge``; ``batch`` counts from 0 inside the
    bucket and ``place`` from 0 inside the batch; ``padding`` is edge - length.  A
    batch's padded size, edge x texts, is within ``budget`` unless a single text
    exceeds it.  Texts of length 0 have an edge of their own, 0, if the buckets
    allow, and ``budget`` of them are one batch.  Texts of a bucket are taken in
    hash order of id and length; repeated rows are places of their own.  An empty
    table gives no rows.
    """
    length = word_length() if length is None else F.coalesce(length, F.lit(0)).cast("long")
    sized = docs.select(F.col(id_col).alias("doc_id"), length.alias("length"))
    sized = stored(sized, "lengths")
    histogram = sized.groupBy("length").agg(F.count(F.lit(1)).alias("n")).toArrow()  # few rows, see above
    lengths, counts = (histogram.column(c).to_numpy() for c in ("length", "n"))
    edges = optimal_edges(lengths, counts, buckets)
    if not edges:
        edges = [0]
    sums = np.bincount(np.searchsorted(edges, lengths), counts, minlength=len(edges))
    inside = {e: int(n) for e, n in zip(edges, sums)}
    bucket, slots, room = F.lit(None).cast("int"), F.lit(1), F.lit(1).cast("long")
    for k in range(len(edges), 0, -1):
        here = F.col("length") <= edges[k - 1]
        bucket = F.when(here, k).otherwise(bucket)
        slots = F.when(here, max(1, -(-inside[edges[k - 1]] // SLICE_ROWS))).otherwise(slots)
        room = F.when(here, max(1, budget // max(1, edges[k - 1]))).otherwise(room)
    edge = F.element_at(F.array(*[F.lit(e).cast("long") for e in edges]), F.col("bucket"))
    at = (sized.withColumn("bucket", bucket).withColumn("edge", edge)
          .withColumn("mix", F.xxhash64("doc_id", "length"))
          .withColumn("slice", F.pmod("mix", slots)).withColumn("room", room))
    totals = at.groupBy("bucket", "slice").agg(F.count(F.lit(1)).alias("n"))
    chained = totals.select("bucket", "slice", (F.sum("n").over(Window.partitionBy("bucket").orderBy("slice")) - F.col("n"))
                            .alias("before"))
    within = Window.partitionBy("bucket", "slice").orderBy("mix", "doc_id", "length")
    placed = (at.withColumn("own", F.row_number().over(within)).join(chained, ["bucket", "slice"])
              .withColumn("nth", F.col("before") + F.col("own") - 1))
    return placed.select("doc_id", "length", "bucket", "edge", F.floor(F.col("nth") / F.col("room")).cast("long").alias("batch"),
                         F.pmod("nth", "room").cast("long").alias("place"), (F.col("edge") - F.col("length")).alias("padding"))

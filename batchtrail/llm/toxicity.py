"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its hashed character n-grams.  For each n-gram the
log-count ratio of the two classes scales the feature, and a logistic
regression with a penalty is fitted on the scaled features.  Ratios and weights
come from a bounded sample of labelled rows (``SAMPLE``, a parameter); scoring
reads every whole text.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from batchtrail.llm.common import mix64, slices, stored, text_of

#: Most labelled rows that the classifier is fitted on, taken in hash order of their id.
SAMPLE = 6_000
SIZES = (4, 5)
BITS = 20
#: Least number of sample texts that hold an n-gram for it to be a feature.
LEAST_TEXTS = 3
#: Features kept: the n-grams whose log-count ratio, weighted by the root of their number of texts, is largest.
FEATURES = 1 << 13
#: Text bytes whose n-grams are held at once.
_SLICE = 1 << 19
PENALTY = 1e-4
STEPS = 120

_U = np.uint64
_BASE = _U(0x100000001B3)


def ngram_features(texts: list[str], sizes: tuple[int, ...] = SIZES, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text index, bucket) of every character n-gram; texts are case-folded, white space is one space."""
    joined = [" " + " ".join(t.casefold().split()) + " " for t in texts]
    chars = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter(map(len, joined), dtype=np.int64, count=len(joined))
    row = np.repeat(np.arange(len(joined), dtype=np.int32), lengths)
    x = mix64(chars.astype(_U) + _U(1))
    rows, buckets = [], []
    for n in sizes:
        if len(x) < n:
            continue
        h = x[:len(x) - n + 1].copy()
        for j in range(1, n):
            h *= _BASE
            h += x[j:len(x) - n + 1 + j]
        inside = row[:len(h)] == row[n - 1:]
        rows.append(row[:len(h)][inside])
        buckets.append((mix64(h[inside] + _U(n)) >> _U(64 - bits)).astype(np.int32))
    if not rows:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(rows), np.concatenate(buckets)


def _once(row: np.ndarray, bucket: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Each bucket once per text."""
    key = np.unique((row.astype(np.int64) << bits) | bucket)
    return (key >> bits).astype(np.int32), (key & ((1 << bits) - 1)).astype(np.int32)


def fit(texts: list[str], toxic: np.ndarray, sizes: tuple[int, ...] = SIZES, bits: int = BITS) -> dict:
    """Bucket weights (naive Bayes ratio times regression weight) and intercept; see ``score_texts``."""
    toxic = np.asarray(toxic, dtype=np.float64)
    if not len(toxic) or toxic.min() == toxic.max():
        rate = float(np.clip(toxic.mean() if len(toxic) else 0.0, 1e-6, 1 - 1e-6))
        return {"weight": np.zeros(1 << bits, np.float32), "intercept": float(np.log(rate / (1 - rate))),
                "sizes": sizes, "bits": bits}
    held, p = np.zeros(1 << bits), np.zeros(1 << bits)
    chunks = list(slices(pa.array(texts, pa.string()), _SLICE))
    for start, stop in chunks:
        r, b = _once(*ngram_features(texts[start:stop], sizes, bits), bits)
        held += np.bincount(b, minlength=1 << bits)
        p += np.bincount(b, toxic[r + start], minlength=1 << bits)
    q = held - p + 1.0
    p += 1.0
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    strength = np.where(held >= LEAST_TEXTS, np.abs(ratio) * np.sqrt(held), 0.0)
    if np.count_nonzero(strength) > FEATURES:
        strength[strength < np.partition(strength, -FEATURES)[-FEATURES]] = 0.0
    ratio = np.where(strength > 0, ratio, 0.0)
    rows, buckets = [], []
    for start, stop in chunks:  # a second reading, so that only the kept features are held
        r, b = ngram_features(texts[start:stop], sizes, bits)
        kept = ratio[b] != 0
        r, b = _once(r[kept], b[kept], bits)
        rows.append(r + np.int32(start))
        buckets.append(b)
    row, bucket = np.concatenate(rows), np.concatenate(buckets)
    value = ratio[bucket].astype(np.float32)
    # a text's features have unit length, so that long texts don't outweigh short ones
    size = np.sqrt(np.bincount(row, value.astype(np.float64) ** 2, minlength=len(texts)))
    value /= np.maximum(size, 1e-9)[row].astype(np.float32)
    kept = np.flatnonzero(np.bincount(bucket, minlength=1 << bits))
    place = np.zeros(1 << bits, dtype=np.int32)
    place[kept] = np.arange(len(kept), dtype=np.int32)
    found, intercept = _logistic(row, place[bucket], value, toxic, len(kept))
    weight = np.zeros(1 << bits)
    weight[kept] = found
    return {"weight": (weight * ratio).astype(np.float32), "ratio": ratio.astype(np.float32),
            "intercept": intercept, "sizes": sizes, "bits": bits}


def _logistic(row: np.ndarray, col: np.ndarray, value: np.ndarray, y: np.ndarray, dims: int) -> tuple[np.ndarray, float]:
    """Penalised logistic regression by accelerated gradient steps on coordinate-form features of unit length."""
    n = len(y)
    w, b = np.zeros(dims), float(np.log(y.mean() / (1 - y.mean())))
    v, c = w.copy(), b
    rate = 1.0 / (0.25 * 2 + PENALTY)  # features have unit length, plus the constant
    parts = [slice(k, k + (1 << 20)) for k in range(0, len(row), 1 << 20)]  # so that no copy of all features is made
    for k in range(STEPS):
        z = np.full(n, c)
        for part in parts:
            z += np.bincount(row[part], value[part] * v[col[part]], minlength=n)
        miss = 1 / (1 + np.exp(-z)) - y
        step = PENALTY * v
        for part in parts:
            step += np.bincount(col[part], value[part] * miss[row[part]], minlength=dims) / n
        w2, b2 = v - rate * step, c - rate * miss.mean()
        pull = k / (k + 3)
        v, c = w2 + pull * (w2 - w), b2 + pull * (b2 - b)
        w, b = w2, b2
    return w, b


def score_texts(model: dict, texts: list[str]) -> np.ndarray:
    """Probability of label 1; the empty text gets that of the intercept alone."""
    row, bucket = ngram_features(texts, model["sizes"], model["bits"])
    ratio = model.get("ratio")
    if ratio is None:
        return np.full(len(texts), 1 / (1 + np.exp(-model["intercept"])))
    some = ratio[bucket] != 0
    row, bucket = _once(row[some], bucket[some], model["bits"])
    size = np.sqrt(np.bincount(row, ratio[bucket].astype(np.float64) ** 2, minlength=len(texts)))
    z = np.bincount(row, model["weight"][bucket], minlength=len(texts)) / np.maximum(size, 1e-9)
    return 1 / (1 + np.exp(-(z + model["intercept"])))


def held_out(id_col: Column | str) -> Column:
    """Whether crc32 of the id as text is divisible by 5; a null id is not held out."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          sample: int = SAMPLE) -> dict:
    """Fit on at most ``sample`` labelled rows that are not held out.

    An id labelled more than once counts as toxic if any of its labels is 1;
    null labels are no labels; of several texts of an id the first in text order
    counts, so that the fit does not depend on the order of the rows.  Without labelled rows the score is a constant.
    """
    marked = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
              .groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("__y")))
    chosen = marked.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), text_of(text_col).alias("__text"))
    # the chosen ids are at most ``sample`` rows, whatever the size of the tables
    rows = texts.join(F.broadcast(chosen), "__id").groupBy("__id").agg(F.min("__text").alias("__text"), F.min("__y").alias("__y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by("__id")
        model = fit(table.column("__text").to_pylist(), table.column("__y").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # one task fits: it holds the sample, whose size is a parameter
    found = stored(rows, "toxicity_sample").coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit([], np.zeros(0))


def scored(docs: DataFrame, model: dict, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text; null text is empty.  All columns are kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        parts = [score_texts(shared.value, texts.iloc[a:b].tolist()) for a, b in slices(pa.array(texts, pa.string()), _SLICE)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(out, score(text_of(text_col)))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row of ``docs``: score in [0, 1], predicted 1 from 0.5 on.

    Ties, repeated rows and null ids keep their rows; an empty table gives none.
    """
    model = train(docs, labels, sample=sample)
    slim = docs.select("doc_id", "text")
    return scored(slim, model).select("doc_id", held_out("doc_id").alias("held_out"), "score",
                                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with all their columns."""
    model = train(docs, labels, sample=sample)
    return scored(docs, model, out="__toxicity").where("__toxicity < 0.5").drop("__toxicity")

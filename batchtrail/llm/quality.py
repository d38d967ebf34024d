"""Quality: document evidence with host and path posteriors by hierarchical empirical Bayes.

A logistic regression on a few text measures, fitted on a bounded sample of
labelled rows, gives each document's evidence.  Grouped sums of that evidence
over *all* documents give the rates of every host and of every path below it.
Sparse sites shrink: a host's rate toward the global rate and a path's toward
its host's, with a strength estimated from the data (variance within sites over
variance between them).  A document's own evidence is left out of the rates it
is judged by, so no document vouches for itself.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchtrail.llm.common import kept_columns, small_side, stored, text_of

#: Most labelled rows that the document classifier is fitted on, taken in hash order of their id.
SAMPLE = 20_000
PENALTY = 1e-3
THRESHOLD = 0.5


def measures(text: Column) -> list[Column]:
    """Length-free measures of a text, all 0 for the empty text."""
    size = F.greatest(F.length(text), F.lit(1)).cast("double")
    words = F.split(text, " ")
    n = F.greatest(F.size(words), F.lit(1)).cast("double")

    def share(chars: str) -> Column:
        return F.regexp_count(text, F.lit(chars)) / size

    odd, loud, bars, upper = share(r"[#$%&*@^~<>{}\[\]\\=_+]"), share("[!?]"), share("[|]"), share(r"\p{Lu}")
    distinct = F.size(F.array_distinct(words)) / n
    return [
        odd, loud, bars, share("[0-9]"), share("[ \t\n\r]"), upper, share("[.,;:]"), distinct, F.log1p(n) / 10.0,
        F.log1p(size / n) / 5.0, F.sqrt(odd), F.sqrt(loud), F.sqrt(bars), F.sqrt(upper), distinct * F.log1p(n) / 10.0,
    ]


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """(weights, intercept, mean, scale) by Newton steps with a ridge penalty; constant where one class is missing."""
    d = x.shape[1]
    if not len(y) or y.min() == y.max():
        rate = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        return np.zeros(d), math.log(rate / (1 - rate)), np.zeros(d), np.ones(d)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    ridge = np.eye(d + 1) * penalty * len(y)
    ridge[d, d] = 1e-9
    w = np.zeros(d + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:d], float(w[d]), mean, scale


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          sample: int = SAMPLE) -> tuple:
    """Document classifier from at most ``sample`` labelled rows; an id with several labels takes the lowest, null is none.

    An id with several texts takes the first of them in text order, so that the fit does not depend on the order of the rows.
    """
    marked = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
              .groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.min(F.col(label_col).cast("double")).alias("__y")))
    chosen = marked.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    # at most ``sample`` rows, whatever the size of the tables
    rows = (docs.select(F.col(id_col).cast("long").alias("__id"), text_of(text_col).alias("__text"))
            .join(F.broadcast(chosen), "__id").groupBy("__id").agg(F.min("__text").alias("__text"), F.min("__y").alias("__y"))
            .orderBy("__id").select("__y", F.array(*measures(F.col("__text"))).alias("x")).toArrow())
    if not rows.num_rows:
        return fit_logistic(np.zeros((0, len(measures(F.lit(""))))), np.zeros(0))
    x = np.array(rows.column("x").to_pylist(), dtype=np.float64)
    return fit_logistic(x, rows.column("__y").to_numpy())


def evidence(text: Column, model: tuple) -> Column:
    """Probability of good quality by the text alone."""
    weights, intercept, mean, scale = model
    z = F.lit(float(intercept - (weights * mean / scale).sum()))
    for w, m in zip(weights / scale, measures(text)):
        z = z + F.lit(float(w)) * m
    return F.lit(1.0) / (1.0 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def strength(groups: DataFrame) -> float:
    """Pseudo-documents of the prior: variance within groups over variance between groups.

    ``groups(n, s, ss, prior)``: number, sum and sum of squares of the evidence and
    the rate a group shrinks to.  Without spread between groups they shrink fully.
    """
    row = groups.agg(F.sum("n"), F.count(F.lit(1)), F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("n")),
                     F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("prior"), 2)),
                     F.sum(F.col("n") * F.col("n"))).first()
    n, k, inner, outer, squares = (float(v or 0.0) for v in row)
    if n <= k or k < 2:
        return 1e9
    within = max(inner / (n - k), 1e-12)
    between = (outer - (k - 1) * within) / max(n - squares / n, 1e-12)
    return min(1e9, within / between) if between > 0 else 1e9


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    return F.log(p / (1 - p))


def with_quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, text_col: str = "text",
                 out: str = "quality_score", sample: int = SAMPLE) -> DataFrame:
    """``docs`` with the posterior probability of good quality, ``out``, and ``evidence``, that of the text alone.

    All rows are kept, and all columns but those of these two names, which are
    replaced; see ``_posteriors``.
    """
    return _posteriors(docs, labels, host, path, text_col, sample).select(
        *kept_columns(docs.columns, out, "evidence"), F.col("__quality").alias(out), F.col("__p").alias("evidence"))


def _posteriors(docs: DataFrame, labels: DataFrame, host: Column, path: Column, text_col: str, sample: int) -> DataFrame:
    """Rows of ``docs`` (``__all``) with the posterior probability of good quality and the evidence of the text (``__quality, __p``).

    The log odds of the text alone are moved by the log odds of the site's rate
    against the global rate.  Null text is empty, null host or path is a site of
    its own.  A site seen once has its parent's rate.  Without labels the
    evidence is 1/2 for all.  An empty table gives no rows.
    """
    model = train(docs, labels, text_col=text_col, sample=sample)
    host, path = F.coalesce(host.cast("string"), F.lit("\0")), F.coalesce(path.cast("string"), F.lit("\0"))
    # the columns of a document travel in one struct, so that none can clash with those of the work
    judged = docs.select(F.struct("*").alias("__all"), evidence(text_of(text_col), model).alias("__p"), host.alias("__host"), path.alias("__path"))
    paths = judged.groupBy("__host", "__path").agg(F.count(F.lit(1)).alias("n"), F.sum("__p").alias("s"),
                                                   F.sum(F.col("__p") * F.col("__p")).alias("ss"))
    paths = stored(paths, "sites")
    hosts = paths.groupBy("__host").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")])
    total = hosts.agg(F.sum("n"), F.sum("s")).first()
    rate = float(total[1] / total[0]) if total[0] else 0.5
    k_host = strength(hosts.withColumn("prior", F.lit(rate)))
    shrunk = hosts.select("__host", F.col("n").alias("host_n"), F.col("s").alias("host_s"),
                          ((F.col("s") + k_host * rate) / (F.col("n") + k_host)).alias("prior"))
    sites = paths.join(shrunk, "__host")
    k_path = strength(sites)
    sites = sites.select("__host", "__path", F.col("n").alias("__n"), F.col("s").alias("__s"),
                         F.col("host_n").alias("__hn"), F.col("host_s").alias("__hs"))
    placed = judged.join(small_side(sites), ["__host", "__path"])
    # the document itself is left out at both levels
    host_rate = (F.col("__hs") - F.col("__p") + k_host * rate) / (F.col("__hn") - 1 + k_host)
    path_rate = (F.col("__s") - F.col("__p") + k_path * host_rate) / (F.col("__n") - 1 + k_path)
    odds = _logit(F.col("__p")) + _logit(path_rate) - _logit(F.lit(rate))
    return placed.select("__all", (1.0 / (1.0 + F.exp(-odds))).alias("__quality"), "__p")


def good_documents(docs: DataFrame, labels: DataFrame, host: Column, path: Column, threshold: float = THRESHOLD,
                   sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` whose posterior is at least ``threshold``, with all their columns."""
    scored = _posteriors(docs, labels, host, path, "text", sample)
    return scored.where(F.col("__quality") >= threshold).select(*kept_columns(docs.columns))

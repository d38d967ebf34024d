"""Near-duplicate classes by ProbMinHash signatures, banding and exact verification.

Shingles are five successive lower-case words (a shorter text is one shingle);
the weight of a shingle is its share of the text's shingles.  Each shingle is
a Poisson process whose rate is its weight: every arrival falls on a random
register, a register keeps its earliest arrival, and a shingle stops as soon as
its next arrival is later than all registers.  Two registers agree with the
probability Jaccard similarity of the texts.  A text whose shingles differ in
weight has a second signature with equal weights, whose registers agree with the
set Jaccard similarity; for all other texts the two are the same.

Work on copies is avoided by construction: equal texts become one node first;
nodes that share a band bucket are compared with the bucket's most central
node; only then are members of *different* components compared, by signature
tiles of bounded size, and what the tiles let through is verified on the texts.
"""

from __future__ import annotations

from collections import Counter, OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from batchtrail.llm.common import kept_columns, mix64, ranges, slices, split_words, stored, text_of, unit_floats
from batchtrail.llm.components import components

WORDS = 5
SIMILARITY = 0.8
BANDS = 36
ROWS = 7
#: Registers added to the signatures of texts that share a bucket, so that fewer pairs need their texts.
REFINED = 768
#: A pair is out if its signatures agree this much less than the threshold: 4 standard deviations of the
#: estimate from the band registers alone, and from all registers.
MARGIN = 0.1
REFINED_MARGIN = 0.05
#: Members of a bucket that one tile holds on a side.
TILE = 1024

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_BASE = _U(0x100000001B3)


# ------------------------------------------------------------------ signatures

def weighted_shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, shingle hash, weight) of the distinct shingles of each text, weights adding to 1."""
    codes, offsets, distinct = split_words(pc.utf8_lower(texts))
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0)
    table = np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct.to_pylist()), dtype=_U, count=len(distinct))
    hashes = table[codes]
    counts = np.diff(offsets)
    long = np.flatnonzero(counts >= words)
    at = ranges(offsets[long], counts[long] - words + 1)
    rolled = hashes[at]
    for j in range(1, words):
        rolled = rolled * _BASE + hashes[at + j]
    short = np.flatnonzero((counts > 0) & (counts < words))
    brief = hashes[offsets[short]]
    for j in range(1, words - 1):
        more = counts[short] > j
        brief = np.where(more, brief * _BASE + hashes[np.where(more, offsets[short] + j, 0)], brief)
    group = np.concatenate((np.repeat(long, counts[long] - words + 1), short))
    shingle = mix64(np.concatenate((rolled, brief + counts[short].astype(_U))))
    order = np.lexsort((shingle, group))
    group, shingle = group[order], shingle[order]
    first = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (shingle[1:] != shingle[:-1]))))
    times = np.diff(np.concatenate((first, [len(group)])))
    group, shingle = group[first], shingle[first]
    return group, shingle, times / np.bincount(group, times, minlength=len(texts))[group]


def prob_minhash(group: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """Registers (n x m, the winning shingle of each) of ``n`` weighted sets given as flat arrays."""
    times = np.full(n * m, np.inf)
    won = np.zeros(n * m, dtype=_U)
    latest = np.full(n, np.inf)
    at = np.zeros(len(group))
    k = 0
    while len(group):
        draws = int(min(64, max(1, 4 * n * m // len(group))))
        noise = mix64(shingle[:, None] + (np.arange(k + 1, k + draws + 1, dtype=_U) * _STEP)[None, :])
        arrive = at[:, None] + np.cumsum(-np.log1p(-unit_floats(noise)) / weight[:, None], axis=1)
        row, col = np.nonzero(arrive <= latest[group][:, None])
        when = arrive[row, col]
        slot = group[row] * m + (mix64(noise[row, col] ^ _STEP) % _U(m)).astype(np.int64)
        np.minimum.at(times, slot, when)
        first = times[slot] == when
        won[slot[first]] = shingle[row[first]]
        latest = times.reshape(n, m).max(axis=1)
        at = arrive[:, -1]
        on = at < latest[group]  # early termination: later arrivals cannot win
        group, shingle, weight, at = group[on], shingle[on], weight[on], at[on]
        k += draws
    return won.reshape(n, m)


def _blocks(sizes: np.ndarray, most: int = 100_000, texts: int = 512) -> Iterator[np.ndarray]:
    """Texts of like size together, so that a block needs about as many rounds as each of its texts."""
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    start = 0
    while start < len(order):
        stop = start + max(1, int(np.searchsorted(np.cumsum(sizes[order[start:start + texts]]), most)))
        yield order[start:stop]
        start = stop


def _registers(group: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """Registers (n x m) of ``n`` texts, block by block; 0 for a text without shingles."""
    sizes = np.bincount(group, minlength=n)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    out = np.zeros((n, m), dtype=_U)
    for block in _blocks(sizes):
        pick = ranges(starts[block], sizes[block])
        local = np.repeat(np.arange(len(block)), sizes[block])
        out[block] = prob_minhash(local, shingle[pick], weight[pick], len(block), m)
    return out


def text_registers(texts: pa.Array, m: int, words: int = WORDS, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(registers, whether the text has any shingle); another ``salt`` gives independent registers."""
    group, shingle, weight = weighted_shingles(texts, words)
    shingle = mix64(shingle ^ _U(salt)) if salt else shingle
    return _registers(group, shingle, weight, len(texts), m), np.bincount(group, minlength=len(texts)) > 0


def both_registers(texts: pa.Array, m: int, words: int = WORDS, salt: int = 0) -> tuple[np.ndarray, ...]:
    """(registers, whether the text has any shingle, texts of unequal weights, registers of those with equal weights)."""
    group, shingle, weight = weighted_shingles(texts, words)
    shingle = mix64(shingle ^ _U(salt)) if salt else shingle
    n = len(texts)
    sizes = np.bincount(group, minlength=n)
    equal = 1 / sizes[group]
    uneven = np.bincount(group, weight != equal, minlength=n) > 0
    pick = uneven[group]
    plain = _registers((np.cumsum(uneven) - 1)[group[pick]], shingle[pick], equal[pick], int(uneven.sum()), m)
    return _registers(group, shingle, weight, n, m), sizes > 0, np.flatnonzero(uneven), plain


def band_keys(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band, different between bands."""
    by = registers.reshape(len(registers), bands, rows)
    key = by[:, :, 0]
    for j in range(1, rows):
        key = key * _BASE + by[:, :, j]
    return mix64(key + np.arange(1, bands + 1, dtype=_U) * _STEP).view(np.int64)


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, words: int = WORDS) -> DataFrame:
    """``docs(id, sha, text)`` -> ``(id, sha, sig, keys)``: a byte per register and the band keys (none without words).

    A text of unequal weights has the bytes and keys of its equal weights too.  Keys of both kinds are one space, so that
    it meets by set Jaccard also the texts whose two signatures are the same.
    """
    m = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for start, stop in slices(texts):
                part = batch.slice(start, stop - start)
                coded = part.column("sha").dictionary_encode()
                index = coded.indices.to_numpy(zero_copy_only=False)
                _, first = np.unique(index, return_index=True)  # equal texts of the slice once
                regs, has, uneven, plain = both_registers(part.column("text").take(pa.array(first)), m, words)
                sigs = [s.tobytes() for s in (regs >> _U(56)).astype(np.uint8)]
                keys = list(band_keys(regs, bands, rows))
                for i, s, k in zip(uneven.tolist(), (plain >> _U(56)).astype(np.uint8), band_keys(plain, bands, rows)):
                    sigs[i] += s.tobytes()
                    keys[i] = np.union1d(keys[i], k)
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), part.column("sha"),
                    pa.array([sigs[i] if has[i] else None for i in index], pa.binary()),
                    pa.array([keys[i] if has[i] else [] for i in index], pa.list_(pa.int64())),
                ], names=["id", "sha", "sig", "keys"])

    return docs.select("id", "sha", "text").mapInArrow(run, "id long, sha binary, sig binary, keys array<long>")


def refined(rows: DataFrame, words: int = WORDS, more: int = REFINED, m: int = BANDS * ROWS) -> DataFrame:
    """``rows(node, text, sig)`` with ``more`` registers added to the ``m`` of each signature in ``sig``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column("text")):
                part = batch.slice(start, stop - start)
                regs, _, uneven, plain = both_registers(part.column("text"), more, words, salt=1)
                old = part.column("sig").to_pylist()
                sigs = [s[:m] + r.tobytes() for s, r in zip(old, (regs >> _U(56)).astype(np.uint8))]
                for i, r in zip(uneven.tolist(), (plain >> _U(56)).astype(np.uint8)):
                    sigs[i] += old[i][m:] + r.tobytes()
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("text"), pa.array(sigs, pa.binary())],
                                                 names=["node", "text", "sig"])

    return rows.select("node", "text", "sig").mapInArrow(run, "node long, text string, sig binary")


# ------------------------------------------------------------------ similarity

def shingle_counts(text: str, words: int = WORDS) -> Counter:
    parts = text.lower().split()
    if not parts:
        return Counter()
    return Counter(zip(*(parts[j:] for j in range(min(words, len(parts))))))


def similarity(a: Counter, b: Counter) -> float:
    """The larger of probability Jaccard (weights are shares) and set Jaccard of two shingle counts."""
    if not a or not b:
        return float(not a and not b)
    both = a.keys() & b.keys()
    if not both:
        return 0.0
    plain = len(both) / (len(a) + len(b) - len(both))
    na, nb = a.total(), b.total()
    if len(a) == na and len(b) == nb:  # no repeated shingle: both measures are the same
        return plain
    keys = list(a.keys() | b.keys())
    pa_, pb_ = np.array([a[k] / na for k in keys]), np.array([b[k] / nb for k in keys])
    with np.errstate(divide="ignore"):
        ratio = pa_ / pb_
    order = np.argsort(ratio)
    above = np.concatenate((np.cumsum(pa_[order][::-1])[::-1], [0.0]))
    below = np.concatenate(([0.0], np.cumsum(pb_[order])))
    shared = (pa_ > 0) & (pb_ > 0)
    place = np.searchsorted(ratio[order], ratio[shared])
    weighted = float((1 / (above[place] / pa_[shared] + below[place] / pb_[shared])).sum())
    return max(plain, weighted)


def _bytes(sigs, size: int, plain: bool) -> np.ndarray:
    """Register bytes (n x ``size``) of the weighted signatures or, if ``plain``, of those with equal weights."""
    return np.frombuffer(b"".join([s[-size:] if plain else s[:size] for s in sigs]), np.uint8).reshape(-1, size)


def _verified(pairs: DataFrame, sigs: DataFrame, texts: DataFrame, least: float, words: int, size: int) -> DataFrame:
    """The pairs ``(a, b)`` whose texts are similar; those whose signatures of ``size`` registers differ by far, both the
    weighted ones and those with equal weights, are dropped first."""

    @pandas_udf("double")
    def agreement(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        share = (_bytes(x, size, False) == _bytes(y, size, False)).mean(axis=1)
        uneven = np.flatnonzero((x.str.len() > size) | (y.str.len() > size))
        if len(uneven):
            x, y = x.iloc[uneven], y.iloc[uneven]
            share[uneven] = np.maximum(share[uneven], (_bytes(x, size, True) == _bytes(y, size, True)).mean(axis=1))
        return pd.Series(_agreement(share))

    @pandas_udf("boolean")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        seen: OrderedDict[str, Counter] = OrderedDict()

        def counts(text: str) -> Counter:
            if text not in seen:
                seen[text] = shingle_counts(text, words)
                if len(seen) > 256:
                    seen.popitem(last=False)
            return seen[text]

        return pd.Series([similarity(counts(p), counts(q)) >= least for p, q in zip(x, y)], dtype=bool)

    def both(frame: DataFrame, column: str) -> DataFrame:
        left = frame.select(F.col("node").alias("a"), F.col(column).alias("x"))
        right = frame.select(F.col("node").alias("b"), F.col(column).alias("y"))
        return left, right

    left, right = both(sigs, "sig")
    near = (pairs.join(left, "a").join(right, "b")
            .where(agreement("x", "y") >= F.lit(least - REFINED_MARGIN)).select("a", "b"))
    left, right = both(texts, "text")
    return near.join(left, "a").join(right, "b").where(alike("x", "y")).select("a", "b")


def _agreement(share: np.ndarray) -> np.ndarray:
    """Similarity from the share of equal register bytes; one in 256 agrees by chance."""
    return (share - 1 / 256) / (1 - 1 / 256)


# ------------------------------------------------------------------ candidates

def _central_pairs(shared: DataFrame) -> DataFrame:
    """Each bucket's members with its most central one: that with the most company over all its buckets."""
    company = shared.groupBy("node").agg(F.sum("n").alias("company"))
    centre = (shared.join(company, "node").groupBy("key")
              .agg(F.max(F.struct("company", (-F.col("node")).alias("node"))).alias("best"))
              .select("key", (-F.col("best.node")).alias("centre")))
    return (shared.join(centre, "key").where("node <> centre")
            .select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct())


def _tile_pairs(shared: DataFrame, labels: DataFrame, sigs: DataFrame, least: float, m: int, size: int, every: bool) -> DataFrame:
    """Pairs of one bucket in different components whose signatures agree.

    A bucket is cut into blocks of about ``TILE`` members, and two blocks meet in
    one tile; the ``m`` band registers of all pairs are compared, all ``size`` registers of those that pass.  The larger
    agreement of the weighted signatures and of those with equal weights counts.  ``every=False`` gives each component
    its best pair of the tile (linear output), ``every=True`` all pairs.
    """
    now = (shared.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    mixed = now.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"),
                                   F.count(F.lit(1)).alias("size")).where("lo <> hi")
    blocks = F.ceil(F.col("size") / F.lit(TILE)).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = (now.join(mixed.select("key", blocks.alias("blocks")), "key")
            .withColumn("block", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                    "block", "node", "label")
            .join(sigs.select("node", "sig"), "node"))

    def matched(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        agree = np.zeros((len(x), len(y)), dtype=np.int32)
        for k in range(0, m, 36):
            agree += (x[:, None, k:min(m, k + 36)] == y[None, :, k:min(m, k + 36)]).sum(axis=2, dtype=np.int32)
        return agree

    def tile(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        sig, plain = _bytes(part["sig"], size, False), _bytes(part["sig"], size, True)
        uneven = (part["sig"].str.len() > size).to_numpy()
        node, label, block = part["node"].to_numpy(), part["label"].to_numpy(), part["block"].to_numpy()
        if (label == label[0]).all():
            return
        split = part["i"].iat[0] != part["j"].iat[0]
        left = np.flatnonzero(block == part["i"].iat[0])
        right = np.flatnonzero(block == part["j"].iat[0])
        for start in range(0, len(left), 64):
            rows_ = left[start:start + 64]
            agree = matched(sig[rows_], sig[right])
            # where neither text is uneven, the signatures with equal weights are the same
            for p, q in ((uneven[rows_], np.ones(len(right), dtype=bool)), (~uneven[rows_], uneven[right])):
                if p.any() and q.any():
                    agree[np.ix_(p, q)] = np.maximum(agree[np.ix_(p, q)], matched(plain[rows_[p]], plain[right[q]]))
            ok = (_agreement(agree / m) >= least - MARGIN) & (label[rows_][:, None] != label[right][None, :])
            if not split:
                ok &= node[rows_][:, None] < node[right][None, :]
            x, y = np.nonzero(ok)
            near = np.zeros(len(x))
            for k in range(0, len(x), 4096):
                p, q = rows_[x[k:k + 4096]], right[y[k:k + 4096]]
                share, odd = (sig[p] == sig[q]).mean(axis=1), uneven[p] | uneven[q]
                share[odd] = np.maximum(share[odd], (plain[p[odd]] == plain[q[odd]]).mean(axis=1))
                near[k:k + 4096] = _agreement(share)
            fine = near >= least - REFINED_MARGIN
            x, y, near = x[fine], y[fine], near[fine]
            if not len(x):
                continue
            found = pd.DataFrame({"p": label[rows_[x]], "q": label[right[y]], "s": near,
                                  "a": node[rows_[x]], "b": node[right[y]]})
            if not every:
                one = found.sort_values("s", ascending=False).drop_duplicates("p")
                two = found.sort_values("s", ascending=False).drop_duplicates("q")
                found = pd.concat([one, two]).drop_duplicates(["a", "b"])
            yield pd.DataFrame({"a": np.minimum(found["a"], found["b"]), "b": np.maximum(found["a"], found["b"])})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            if not len(frame):
                continue
            same = (frame["key"].diff().ne(0) | frame["i"].diff().ne(0) | frame["j"].diff().ne(0)).cumsum()
            last = same.iat[-1]
            for g, part in frame.groupby(same, sort=False):
                if g != last:
                    yield from tile(part)
            rest = frame[same == last]
        if rest is not None and len(rest):
            yield from tile(rest)

    tiles = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return tiles.mapInPandas(run, "a long, b long").distinct()


# ------------------------------------------------------------------ operator

def _row_key(sha: Column | str, id_col: Column | str) -> Column:
    """Text hash and id as one join key, ``row``; rows equal in both are repeated rows."""
    return F.concat_ws("/", F.hex(sha), F.col(id_col).cast("string") if isinstance(id_col, str) else id_col).alias("row")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                           least: float = SIMILARITY, words: int = WORDS, bands: int = BANDS,
                           rows: int = ROWS) -> DataFrame:
    """One row ``(doc_id, sha, node, class_id, representative)`` per row of ``docs``.

    A class is a connected component of the links "similarity >= ``least``";
    ``class_id`` is its smallest node, a node the smallest id among the rows of
    one text.  A text whose rows all lack an id, or whose smallest id belongs to
    several texts, gets a negative number made from its hash instead.
    ``representative`` marks the rows of the class's smallest node (repeated rows
    are all marked; ``sha`` and ``doc_id`` tell them apart).  Null text is the
    empty text; empty texts are equal, hence one class.  Texts shorter than a
    shingle are one shingle.  An empty table gives no rows.  Extra columns are
    ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    base = base.withColumn("sha", F.unhex(F.sha2("text", 256)))
    raw = (signatures(base, bands, rows, words).groupBy("sha")
           .agg(F.min("id").alias("id"), F.first("sig").alias("sig"), F.first("keys").alias("keys")))
    raw = stored(raw, "signatures")
    holder = raw.groupBy("id").agg(F.min("sha").alias("holder"))
    made = -F.lit(2) - F.shiftrightunsigned(F.xxhash64("sha"), 2)
    nodes = (raw.join(holder, "id", "left")
             .withColumn("node", F.when(F.col("holder") == F.col("sha"), F.col("id")).otherwise(made)))
    nodes = stored(nodes.select("node", "sha", raw["id"], "sig", "keys"), "nodes")

    members = nodes.select(F.explode("keys").alias("key"), "node")
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(members.join(sizes, "key"), "shared")
    wanted = (nodes.join(shared.select("node").distinct(), "node", "left_semi")
              .select("node", "sig", _row_key("sha", "id")))
    m, size = bands * rows, bands * rows + REFINED
    full = stored(refined(base.select("text", _row_key("sha", "id")).join(wanted, "row").dropDuplicates(["row"]), words, REFINED, m),
                  "full")
    sigs, texts = full.select("node", "sig"), full.select("node", "text")

    pairs = stored(_central_pairs(shared), "pairs")
    links = stored(_verified(pairs, sigs, texts, least, words, size), "links")
    labels = components(links)
    tried = pairs
    for every in (False, True):
        more = stored(_tile_pairs(shared, labels, sigs, least, m, size, every).join(tried, ["a", "b"], "left_anti"), "pairs")
        if more.isEmpty():
            if every:
                break
            continue
        found = stored(_verified(more, sigs, texts, least, words, size), "links")
        tried = tried.unionByName(more)
        if not found.isEmpty():
            links = labels.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")) \
                .unionByName(found)
            labels = components(links)
    classes = (nodes.select("node", "sha").join(labels, "node", "left")
               .select("sha", "node", F.coalesce("label", "node").alias("class_id")))
    return (base.select(F.col("id").alias("doc_id"), "sha").join(classes, "sha")
            .select("doc_id", F.lower(F.hex("sha")).alias("sha"), "node", "class_id",
                    (F.col("node") == F.col("class_id")).alias("representative")))


def one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row of each near-duplicate class: the representative with the
    smallest id, one of equal rows.  All columns of ``docs`` are kept."""
    classes = near_duplicate_classes(docs, id_col, text_col)
    kept = (classes.where("representative").groupBy("class_id", "sha").agg(F.min("doc_id").alias("id"))
            .select(_row_key(F.unhex("sha"), "id").alias("__row")))
    sha = F.unhex(F.sha2(text_of(text_col), 256))
    # the columns of a document travel in one struct, so that none can clash with the key
    keyed = docs.select(F.struct("*").alias("__all"), _row_key(sha, F.col(id_col).cast("long")).alias("__row"))
    return keyed.join(kept, "__row", "left_semi").dropDuplicates(["__row"]).select(*kept_columns(docs.columns))

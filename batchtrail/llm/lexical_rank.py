"""Ranked lexical search by branch and bound over document tries.

1. The items' distinct terms are the vocabulary.  One pass over the texts keeps,
   per document, the number of its terms and its vector of vocabulary terms.
2. Document frequencies order the vocabulary, most frequent first.  A task turns
   its documents into tries (``Trie``): term vectors in that order, documents that
   share a beginning share the path.  Every node knows the largest occurrence count
   of each term below it and the smallest length measure ``m`` below it.
3. A score rises with the count and falls with ``m``, so the score of a node's
   maxima is a bound of every document below.  Each item goes depth first, best
   child first, and leaves out subtrees whose bound is below its k-th score so far.
4. Each task passes at most ``k`` documents per item on; they are merged in two steps.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchtrail.llm.common import ranges, slices, stored, text_of

NEAREST = 10
#: (item, term) pairs of one block of items; a block's vocabulary is what a task holds.
BLOCK_PAIRS = 200_000
#: Documents below which a subtree is scored instead of divided, and documents of one trie.
LEAF, TRIE_DOCS = 32, 4096
#: Entries of a trie's table of maxima (node x term).
TRIE_CELLS = 8 << 20

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FOLD = bytes(ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))


# ------------------------------------------------------------------- terms

def terms_of(text: Column) -> Column:
    """Distinct terms of a text column."""
    return F.array_distinct(F.regexp_extract_all(F.translate(text, _UPPER, _UPPER.lower()), F.lit(TERM), F.lit(0)))


def folded(texts: pa.Array) -> pa.Array:
    """Texts with A-Z lower-cased and every ASCII separator as a space; bytes of other characters stay."""
    _, offsets, data = texts.buffers()
    if data is None:
        return texts
    return pa.Array.from_buffers(pa.string(), len(texts), [None, offsets, pa.py_buffer(data.to_pybytes().translate(_FOLD))],
                                 offset=texts.offset)


def term_vectors(texts: pa.Array, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms of each text, first entry of each text with a closing one, code in ``names``, occurrences) of folded texts."""
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    some = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # the kernel gives an empty word at either end
    total = np.diff(np.concatenate(([0], np.cumsum(some)))[offsets])
    coded = words.dictionary_encode()
    place = pc.index_in(coded.dictionary, names).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    code = place[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))[code >= 0]
    key, times = np.unique(row * len(names) + code[code >= 0], return_counts=True)
    of, code = np.divmod(key, len(names))
    return total, np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(texts))))), code, times


# -------------------------------------------------------------------- trie

class Trie:
    """Documents in the order of their term vectors, cut into nodes that share a beginning.

    ``first``: first entry of each document with a closing one; ``term`` (rising
    within a document) and ``times``: its entries, at least one a document;
    ``m``: length measures; ``weight``: weights by term.  Documents below a node
    are a range; a chain of nodes with one child is one node, and neighbouring
    small children share a leaf.
    """

    def __init__(self, first: np.ndarray, term: np.ndarray, times: np.ndarray, m: np.ndarray, weight: np.ndarray, leaf: int = LEAF):
        sizes = np.diff(first)
        raw = term.astype(">u4").tobytes()
        keys = [raw[4 * a:4 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
        self.order = np.array(sorted(range(len(keys)), key=keys.__getitem__), dtype=np.int64)
        picked = ranges(first[:-1][self.order], sizes[self.order])
        self.first = np.concatenate(([0], np.cumsum(sizes[self.order])))
        self.term, times, self.m = term[picked], times[picked], m[self.order]
        self.gain = weight[self.term] * gain(times, np.repeat(self.m, sizes[self.order]))
        self._divide(leaf)
        self._bound(times, weight)

    def _divide(self, leaf: int) -> None:
        first, term = self.first, self.term
        sizes = np.diff(first)
        self.low, self.high, self.parent, self.is_leaf = [], [], [], []
        todo = [(0, len(sizes), 0, -1)]
        while todo:
            low, high, depth, parent = todo.pop()
            node = len(self.low)
            self.low.append(low), self.high.append(high), self.parent.append(parent), self.is_leaf.append(high - low <= leaf)
            if high - low <= leaf:
                continue
            # what the first and the last document of a sorted range share, all of them share
            a, b = term[first[low] + depth:first[low + 1]], term[first[high - 1] + depth:first[high]]
            both = min(len(a), len(b))
            differ = np.flatnonzero(a[:both] != b[:both])
            depth += int(differ[0]) if len(differ) else both
            longer = sizes[low:high] > depth
            head = np.where(longer, term[np.minimum(first[low:high] + depth, len(term) - 1)], -1)
            cuts = [low, *(np.flatnonzero(head[1:] != head[:-1]) + low + 1).tolist(), high]
            start = low
            for x, y in zip(cuts, cuts[1:]):
                if y - x > leaf and longer[x - low]:
                    if x > start:
                        todo.append((start, x, depth, node))
                    todo.append((x, y, depth + 1, node))
                    start = y
                    continue
                if y - start > leaf and x > start:
                    todo.append((start, x, depth, node))
                    start = x
                while y - start > leaf:  # documents of one vector
                    todo.append((start, start + leaf, depth, node))
                    start += leaf
            if start < high:
                todo.append((start, high, depth, node))

    def _bound(self, times: np.ndarray, weight: np.ndarray) -> None:
        """Bound of what each term can add to a document's score below each node."""
        leaves = np.flatnonzero(self.is_leaf)
        by_place = leaves[np.argsort(np.array(self.low)[leaves])]
        of_doc = np.repeat(by_place, np.array(self.high)[by_place] - np.array(self.low)[by_place])
        self.terms = np.unique(self.term)
        most = np.zeros((len(self.low), len(self.terms)), dtype=np.int64)
        np.maximum.at(most, (np.repeat(of_doc, np.diff(self.first)), np.searchsorted(self.terms, self.term)), times)
        least = np.full(len(self.low), np.iinfo(np.int64).max)
        np.minimum.at(least, of_doc, self.m)
        self.kids: list[list[int]] = [[] for _ in self.low]
        for node in range(len(self.low) - 1, 0, -1):  # a child comes after its parent
            above = self.parent[node]
            np.maximum(most[above], most[node], out=most[above])
            least[above] = min(least[above], least[node])
            self.kids[above].append(node)
        self.most_gain = weight[self.terms] * gain(most, least[:, None])

    def search(self, wanted: np.ndarray, member: np.ndarray, ids: list, best: list, k: int) -> int:
        """Adds the documents that belong to the item's ``k`` best to the heap ``best``; returns the leaves scored.

        ``wanted``: the item's terms, ``member``: the same as marks by term;
        ``ids``: sort keys of the documents.
        """
        place = np.searchsorted(self.terms, wanted)
        place = place[place < len(self.terms)]
        place = place[member[self.terms[place]]]
        place = np.unique(place)
        bound = self.most_gain[:, place].sum(axis=1).tolist()
        todo, scored = [0], 0
        while todo:
            node = todo.pop()
            floor = best[0][0] if len(best) == k else 1
            if bound[node] < floor:
                continue
            if not self.is_leaf[node]:
                todo.extend(sorted(self.kids[node], key=bound.__getitem__))
                continue
            scored += 1
            low, high = self.low[node], self.high[node]
            start, stop = self.first[low], self.first[high]
            part = np.where(member[self.term[start:stop]], self.gain[start:stop], 0)
            score = np.add.reduceat(part, self.first[low:high] - start)
            for d in np.flatnonzero(score >= floor).tolist():
                entry = (int(score[d]), ids[self.order[low + d]])
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return scored


def gain(times: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What ``times`` occurrences add to a score, before the term's weight; rises with ``times``, falls with ``m``."""
    return (1_000_000_000 * times) // (1000 * times + 8 * m)


def weights(n: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)


# ------------------------------------------------------------------ search

def _vectors(docs: DataFrame, names: list[str]) -> DataFrame:
    """``(doc_id, n, terms, times)`` of every document, with codes of the vocabulary ``names``."""
    known = docs.sparkSession.sparkContext.broadcast(pa.array(names, pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = folded(batch.column("text"))
            for start, stop in slices(texts):
                total, first, code, times = term_vectors(texts.slice(start, stop - start), known.value)
                first = pa.array(first, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, stop - start), pa.array(total, pa.int64()),
                     pa.ListArray.from_arrays(first, pa.array(code, pa.int32())),
                     pa.ListArray.from_arrays(first, pa.array(times, pa.int32()))], names=["doc_id", "n", "terms", "times"])

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, times array<int>")


def _document_frequencies(vectors: DataFrame, size: int) -> np.ndarray:
    """Number of documents of each term code, summed per task before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, dtype=np.int64)
        for batch in batches:
            df += np.bincount(batch.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=size)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(df[some], pa.int64())], names=["term", "n"])

    counted = vectors.select("terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(size, dtype=np.int64)
    df[counted.column("term").to_numpy()] = counted.column("n").to_numpy()
    return df


def _tries(batch: pa.RecordBatch, rank: np.ndarray, weight: np.ndarray, n: int, length: int) -> Iterator[tuple[Trie, list]]:
    """Tries of a batch of vectors, each with the sort keys of its documents."""
    per_trie = max(LEAF, min(TRIE_DOCS, LEAF * TRIE_CELLS // (2 * max(len(rank), 1))))
    for start in range(0, len(batch), per_trie):
        part = batch.slice(start, per_trie)
        first = part.column("terms").offsets.to_numpy().astype(np.int64)
        sizes = np.diff(first)
        term = rank[part.column("terms").flatten().to_numpy(zero_copy_only=False)]
        times = part.column("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.lexsort((term, np.repeat(np.arange(len(part)), sizes)))
        m = 10 + (90 * part.column("n").to_numpy().astype(np.int64) * n) // length
        # smaller ids are better, no id is worst
        ids = [(0, 0) if i is None else (1, -i) for i in part.column("doc_id").to_pylist()]
        yield Trie(first - first[0], term[order], times[order], m, weight), ids


def _block_found(docs: DataFrame, pairs: list, k: int) -> DataFrame:
    """Each task's ``k`` best documents of every item of one block: ``(item_id, doc_id, score)``."""
    sc = docs.sparkSession.sparkContext
    names = sorted({p.term for p in pairs})
    code = {t: c for c, t in enumerate(names)}
    items: dict = {}
    for p in pairs:
        items.setdefault(p.item_id, []).append(code[p.term])
    vectors = stored(_vectors(docs, names), "term_vectors")
    n, length = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = _document_frequencies(vectors, len(names))
    by_frequency = np.lexsort((np.arange(len(df)), -df))
    rank = np.empty(len(df), dtype=np.int64)
    rank[by_frequency] = np.arange(len(df))
    given = sc.broadcast((rank, weights(n, df[by_frequency]), [(i, np.sort(rank[c])) for i, c in items.items()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, weight, asked = given.value
        best: list[list] = [[] for _ in asked]
        member = np.zeros(len(rank), dtype=bool)
        for batch in batches:
            for trie, ids in _tries(batch, rank, weight, n, length):
                for (_, wanted), heap in zip(asked, best):
                    member[wanted] = True
                    trie.search(wanted, member, ids, heap, k)
                    member[wanted] = False
        rows = [(item, -d if has else None, score) for (item, _), heap in zip(asked, best) for score, (has, d) in heap]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 3,
                                         names=["item_id", "doc_id", "score"])

    return vectors.where(F.size("terms") > 0).mapInArrow(run, "item_id long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = NEAREST, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text", block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` highest-scoring documents of every item, equal scores by smaller id.

    Ids are integers.  Null and empty texts have no terms; only scores above 0
    appear.  Every row of ``docs`` is a document, also a repeated one and one
    without an id (last among equal scores).  The rows of one item id (null is
    one too) are one item with the terms of all.  Empty input gives no rows;
    extra columns are ignored.  Items are searched in blocks of about
    ``block_pairs`` (item, term) pairs, all against every document.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    pairs = stored(items.select(F.col(item_col).cast("long").alias("item_id"), F.explode(terms_of(text_of(item_text))).alias("term"))
                   .distinct(), "item_terms")
    blocks = -(-pairs.count() // block_pairs)
    if not blocks:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    of = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    found = reduce(DataFrame.unionByName, [_block_found(texts, pairs.where(of == b).collect(), k) for b in range(blocks)])
    # two steps, so that no task holds what all tasks found for an item
    best = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    some = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(64)))
    for keys in (["item_id", "salt"], ["item_id"]):
        some = some.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).where(F.col("rank") <= k)
    return some.select("item_id", "rank", "doc_id", "score")

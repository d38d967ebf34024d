"""Document fingerprints: a Merkle tree over paragraphs and sections, written as one string.

Leaves are paragraphs (the lines that hold text), sections are runs of
paragraphs, and the root hashes the sections.  A section ends after a paragraph
whose own hash is divisible by ``SECTION``, so an edit moves no boundary beyond
its own paragraphs.  A leaf also carries a small sketch of its character
4-grams, which tells how much of a differing paragraph is left.

``root/section:leaf,leaf/section:leaf...`` with a leaf ``hash.sketch.length``.
Equal texts have equal strings.  Two roots test equality; where they differ,
equal sections are skipped and only the leaves of differing ones are compared.
"""

from __future__ import annotations

import hashlib
from collections import Counter, OrderedDict
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from batchtrail.llm.common import mix64, slices, stored, text_of

SECTION = 8
SKETCH = 32
_U = np.uint64
_HEX = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)
_SEEDS = mix64(np.arange(1, SKETCH + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


def _digest(data: str, chars: int) -> str:
    return hashlib.sha256(data.encode("utf-8", "surrogatepass")).hexdigest()[:chars]


def sketch(paragraph: str) -> str:
    """One hex digit per minimum of a hash family over the character 4-grams, those before the first character included."""
    chars = np.frombuffer(("   " + paragraph).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(_U)
    n = max(1, len(chars) - 3)
    grams = chars[:n].copy()
    for j in range(1, min(4, len(chars))):
        grams = grams * _U(0x100000001B3) + chars[j:j + n]
    grams = mix64(grams)  # a repeated gram changes no minimum
    least = np.full(SKETCH, np.iinfo(np.uint64).max, dtype=_U)
    for start in range(0, len(grams), 4096):
        part = grams[start:start + 4096, None] * _SEEDS[None, :]
        least = np.minimum(least, (part ^ (part >> _U(29))).min(axis=0))
    return _HEX[(mix64(least) & _U(15)).astype(np.intp)].tobytes().decode()


class Fingerprinter:
    """Fingerprints of texts; leaves of recent paragraphs are kept, since texts of one task share them."""

    def __init__(self, keep: int = 20_000):
        self._leaves: OrderedDict[str, str] = OrderedDict()
        self._keep = keep

    def leaf(self, paragraph: str) -> str:
        found = self._leaves.get(paragraph)
        if found is None:
            found = f"{_digest(paragraph, 12)}.{sketch(paragraph)}.{len(paragraph)}"
            if len(paragraph) <= 4096:
                self._leaves[paragraph] = found
                if len(self._leaves) > self._keep:
                    self._leaves.popitem(last=False)
        return found

    def fingerprint(self, text: str) -> str:
        """The empty text has the root of nothing and no section.

        The root covers the text itself, so texts that differ only in white
        space between paragraphs have other roots over equal sections.
        """
        leaves = [self.leaf(p) for p in text.split("\n") if p.strip()]
        sections, run = [], []
        for one in leaves:
            run.append(one)
            if int(one[:12], 16) % SECTION == 0:
                sections.append(run)
                run = []
        if run:
            sections.append(run)
        marked = [f"{_digest(','.join(s), 12)}:{','.join(s)}" for s in sections]
        root = _digest(" ".join(m[:12] for m in marked) + "\n" + _digest(text, 64), 32)
        return "/".join([root, *marked])


def sections_of(fingerprint: str) -> tuple[str, list[tuple[str, list[str]]]]:
    """(root, [(section hash, leaves)])."""
    root, *rest = fingerprint.split("/")
    return root, [(s[:12], s[13:].split(",")) for s in rest]


def _weight(leaf: str) -> int:
    return int(leaf.rsplit(".", 1)[1])


def differing(a: str, b: str) -> tuple[list[str], list[str]]:
    """Leaves of the differing branches: those of ``a`` and of ``b`` that the other lacks, equal sections skipped."""
    (root_a, in_a), (root_b, in_b) = sections_of(a), sections_of(b)
    if root_a == root_b:
        return [], []
    same = Counter(h for h, _ in in_a) & Counter(h for h, _ in in_b)

    def open_branches(sections: list[tuple[str, list[str]]]) -> list[str]:
        left, out = Counter(same), []
        for h, leaves in sections:
            if left[h]:
                left[h] -= 1
            else:
                out += leaves
        return out

    one, two = open_branches(in_a), open_branches(in_b)
    both = Counter(one) & Counter(two)

    def rest(leaves: list[str]) -> list[str]:
        left, out = Counter(both), []
        for x in leaves:
            if left[x]:
                left[x] -= 1
            else:
                out.append(x)
        return out

    return rest(one), rest(two)


def _digits(leaves: list[str]) -> np.ndarray:
    """The sketches of leaves, a row each."""
    return np.frombuffer("".join(leaf.split(".")[1] for leaf in leaves).encode(), dtype=np.uint8).reshape(-1, SKETCH)


def likeness(a: str, b: str) -> float:
    """0 to 1: the share of the larger text that equal paragraphs cover, plus what sketches find in the differing ones.

    Equal roots give 1; below that at most 0.9999.  A differing paragraph counts
    with the best estimate among the differing paragraphs of the other side,
    taken from both sides and the smaller sum kept.
    """
    (root_a, in_a), (root_b, in_b) = sections_of(a), sections_of(b)
    if root_a == root_b:
        return 1.0
    size_a = sum(_weight(x) for _, s in in_a for x in s)
    size_b = sum(_weight(x) for _, s in in_b for x in s)
    if not size_a or not size_b:
        return 0.0 if size_a or size_b else 0.9999
    one, two = differing(a, b)
    equal = size_a - sum(map(_weight, one))
    partly = 0.0
    if one and two:
        x, y = _digits(one), _digits(two)
        wx, wy = np.array(list(map(_weight, one))), np.array(list(map(_weight, two)))
        best_x, best_y = np.zeros(len(x)), np.zeros(len(y))
        for start in range(0, len(x), 256):
            same = np.count_nonzero(x[start:start + 256, None, :] == y[None, :, :], axis=2) / SKETCH
            best_x[start:start + 256] = same.max(axis=1)
            best_y = np.maximum(best_y, same.max(axis=0))
        # fewer than seven of the 32 digits agreeing is taken for chance
        clean = lambda s: np.where(s >= 7 / SKETCH, (s - 1 / 16) / (1 - 1 / 16), 0.0)
        partly = min(float((wx * clean(best_x)).sum()), float((wy * clean(best_y)).sum()))
    return float(min(0.9999, (equal + partly) / max(size_a, size_b)))


def changed_paragraphs(a: str, b: str) -> list[tuple[int, int, int, int]]:
    """Where ``b`` was edited: (from, to) paragraphs of ``a`` replaced by (from, to) of ``b``."""
    x = [leaf for _, s in sections_of(a)[1] for leaf in s]
    y = [leaf for _, s in sections_of(b)[1] for leaf in s]
    return [(i, j, k, m) for op, i, j, k, m in SequenceMatcher(None, x, y, autojunk=False).get_opcodes() if op != "equal"]


# ------------------------------------------------------------------ Spark

def fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of every whole text; null text is empty.  All columns are kept."""
    @pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        made = Fingerprinter()
        return texts.map(made.fingerprint).astype(object)

    return docs.withColumn(out, of(text_of(text_col)))


def edited_text(text: str, following: str) -> str:
    """The last third (rounded down) of the code points replaced by the first as many, or all, of the following text."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


#: Of the edited text's fingerprint only the root and what follows the beginning it shares are written between the steps.
_ROW = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_root string, shared int, edited_rest string, "
        "near_edited double, near_next double")
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.float64()]
_ROOT = 32


def _shared(a: str, b: str) -> int:
    """Length of the common beginning, by halving."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


class _Compared:
    """Result rows of successive texts, whose fingerprints are computed once."""

    def __init__(self):
        self._made = Fingerprinter()
        self._last: tuple[str, str] = ("", self._made.fingerprint(""))

    def _print(self, text: str) -> str:
        if text != self._last[0]:
            self._last = (text, self._made.fingerprint(text))
        return self._last[1]

    def row(self, doc_id: int | None, text: str, following: str) -> tuple:
        own = self._print(text)
        changed = edited_text(text, following)
        after = own if changed == text else self._made.fingerprint(changed)
        same = _shared(own[_ROOT:], after[_ROOT:])
        return (doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own,
                after[:_ROOT], same, after[_ROOT + same:], likeness(own, after), likeness(own, self._print(following)))


def compared_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text against its edited text and against the next document, by fingerprints.

    The next document is that of the next smaller id; after the last the first
    follows.  Null ids come last, repeated ids by the hash of their text.  Null
    text is empty.  A table of one row is its own next; an empty one gives no
    rows.  Texts move once, into ranges of the id; only the first and last text
    of each range are met again, to close the gaps between ranges.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    order = [F.desc_nulls_last("doc_id"), F.asc("tie")]
    ranged = base.withColumn("tie", F.sha2("text", 256)).repartitionByRange(*order).sortWithinPartitions(*order)
    names = [f.split()[0] for f in _ROW.split(", ")]
    schema = f"part int, role string, text string, {_ROW}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, compared, held = TaskContext.get().partitionId(), _Compared(), None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), pa.string(), pa.string(), *_TYPES])],
                names=["part", "role", "text", *names])

        none = (None,) * (len(names) - 1)
        for batch in batches:
            for start, stop in slices(batch.column("text")):
                rows = []
                for doc_id, text in zip(batch.column("doc_id").slice(start, stop - start).to_pylist(),
                                        batch.column("text").slice(start, stop - start).to_pylist()):
                    if held is None:
                        rows.append((part, "first", text, doc_id, *none))
                    else:
                        rows.append((part, "row", None, *compared.row(*held, text)))
                    held = (doc_id, text)
                yield batch_of(rows)
        if held is not None:
            yield batch_of([(part, "last", held[1], held[0], *none)])

    done = stored(ranged.select("doc_id", "text").mapInArrow(run, schema), "fingerprints", "zstd")
    # one number per range goes through the driver
    parts = sorted(r["part"] for r in done.where("role = 'first'").select("part").collect())
    if not parts:
        return _whole(done)
    follows = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next int")
    firsts = done.where("role = 'first'").select(F.col("part").alias("next"), F.col("text").alias("following"))
    lasts = (done.where("role = 'last'").select("part", "doc_id", "text").join(follows, "part").join(firsts, "next")
             .select("doc_id", "text", "following"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_Compared().row(*r.values()) for r in batch.to_pylist()]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=names)

    return _whole(done.where("role = 'row'").select(*names).unionByName(lasts.mapInArrow(close, _ROW)))


def _whole(rows: DataFrame) -> DataFrame:
    edited = F.concat("edited_root", F.substring("fingerprint", F.lit(_ROOT + 1), F.col("shared")), "edited_rest")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", edited.alias("edited_fingerprint"), "near_edited", "near_next")

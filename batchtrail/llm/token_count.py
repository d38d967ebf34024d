"""Token counts without token ids: pieces are counted once per distinct pre-token.

1. One pass over the texts.  Each is cut at ASCII white space (which the tokenizer
   drops); the distinct words of a slice of texts go once through the tokenizer's
   own normalizer and pre-tokenizer.  A part (a few slices) leaves the list of its
   distinct pre-tokens, and for each document their places in that list and
   frequencies.
2. The lists meet by pre-token: each distinct pre-token of the corpus is encoded
   once, and its number of pieces goes back to every part that has it.
3. Per part, frequencies meet the numbers of pieces and are summed by document.
   A pre-token is one row per part, however frequent it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from batchtrail.llm.common import ranges, slices, stored, text_of

LIMIT = 2048
#: Text bytes of one slice.
SLICE = 6 << 20
#: Slices of a task that share one list of pre-tokens.
PART_SLICES = 4


@lru_cache(maxsize=2)
def _tokenizer(spec: str) -> Tokenizer:
    return Tokenizer.from_str(spec)


def _special(tokenizer: Tokenizer) -> list[str]:
    return [t.content for t in tokenizer.get_added_tokens_decoder().values()]


def _pre_tokens(tokenizer: Tokenizer, special: list[str], word: str) -> list[str]:
    """Pre-tokens of a word; a special token inside it stands for itself."""
    for token in special:
        if token in word:
            head, _, tail = word.partition(token)
            return _pre_tokens(tokenizer, special, head) + [token] + _pre_tokens(tokenizer, special, tail)
    if tokenizer.normalizer is not None:
        word = tokenizer.normalizer.normalize_str(word)
    return [p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(word)]


def _all_pre_tokens(tokenizer: Tokenizer, words: list[str]) -> tuple[list[str], np.ndarray]:
    """(pre-tokens of all words in order, number of pre-tokens of each).

    Words are joined by a space and cut together, which saves a call per word; a chunk
    in which that would not keep the words apart (special tokens, rarer white space
    inside a word, another number of words after normalising) is cut word by word.
    """
    special = _special(tokenizer)
    flat: list[str] = []
    sizes = np.zeros(len(words), dtype=np.int64)
    for start in range(0, len(words), 2048):
        chunk = words[start:start + 2048]
        joined = " ".join(chunk)
        if tokenizer.normalizer is not None:
            joined = tokenizer.normalizer.normalize_str(joined)
        parts = joined.split(" ")
        found = None
        if len(parts) == len(chunk) and "" not in parts and not any(t in joined or t in " ".join(chunk) for t in special):
            found = tokenizer.pre_tokenizer.pre_tokenize_str(joined)
            begin = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts])))
            first = np.fromiter((o[0] for _, o in found), dtype=np.int64, count=len(found))
            last = np.fromiter((o[1] for _, o in found), dtype=np.int64, count=len(found))
            of = np.searchsorted(begin, first, side="right") - 1
            if (last < begin[of + 1]).all():
                flat.extend(p for p, _ in found)
                sizes[start:start + len(chunk)] = np.bincount(of, minlength=len(chunk))
                continue
        for k, word in enumerate(chunk, start):
            own = _pre_tokens(tokenizer, special, word) if word else []
            flat.extend(own)
            sizes[k] = len(own)
    return flat, sizes


class _PreTokens:
    """Distinct pre-tokens of some texts and, per text, which of them stand where."""

    def __init__(self, spec: str, texts: pa.Array):
        lists = pc.ascii_split_whitespace(texts)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        words = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        offsets = offsets - offsets[0]
        flat, sizes = _all_pre_tokens(_tokenizer(spec), words.dictionary.to_pylist())
        coded = pa.array(flat, pa.string()).dictionary_encode()
        codes = words.indices.to_numpy(zero_copy_only=False)
        starts = np.cumsum(sizes) - sizes
        self.names = coded.dictionary
        self.code = coded.indices.to_numpy(zero_copy_only=False)[ranges(starts[codes], sizes[codes])].astype(np.int64)
        per_word = np.concatenate(([0], np.cumsum(sizes[codes])))
        self.offsets = per_word[offsets]


def _packed(code: np.ndarray, times: np.ndarray) -> tuple[bytes, bytes, bool]:
    """Rising codes as their steps and the frequencies: two bytes and one byte each, four and four where these don't do."""
    step = np.diff(code, prepend=0)
    wide = bool(len(step)) and (int(step.max()) > 0xFFFF or int(times.max()) > 0xFF)
    return step.astype("<u4" if wide else "<u2").tobytes(), times.astype("<u4" if wide else "u1").tobytes(), wide


def _unpacked(codes: bytes, times: bytes, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(np.frombuffer(codes, "<u4" if wide else "<u2"), dtype=np.int64), np.frombuffer(times, "<u4" if wide else "u1").astype(np.int64)


_DOC = ["part", "doc_id", "n_bytes", "codes", "times", "wide"]


def frequencies(docs: DataFrame, spec: str, slice_bytes: int = SLICE) -> DataFrame:
    """``docs(doc_id, n_bytes, text)`` -> rows of documents (``codes``, ``times``) and one row per part with its pre-tokens (``names``).

    A part is a few slices of texts of one task; its codes are places in ``names``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done, size, known, types = TaskContext.get().partitionId() << 32, 0, 0, {}, None

        def names_row() -> pa.RecordBatch:
            names = pa.array(list(known), pa.string())
            return pa.RecordBatch.from_arrays(
                [pa.array([task + done], pa.int64()), pa.nulls(1, types["doc_id"]), *[pa.nulls(1, t) for t in (pa.int64(), pa.binary(), pa.binary(), pa.bool_())],
                 pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names)], names=[*_DOC, "names"])

        for batch in batches:
            types = {f.name: f.type for f in batch.schema}
            for start, stop in slices(batch.column("text"), slice_bytes):
                part = batch.slice(start, stop - start)
                got = _PreTokens(spec, part.column("text"))
                own = np.fromiter((known.setdefault(name, len(known)) for name in got.names.to_pylist()), dtype=np.int64, count=len(got.names))
                row = np.repeat(np.arange(len(part)), np.diff(got.offsets))
                key, times = np.unique(row * max(len(known), 1) + own[got.code], return_counts=True)
                of, code = np.divmod(key, max(len(known), 1))
                ends = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(part))))).tolist()
                packed = [_packed(code[a:b], times[a:b]) for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), task + done), pa.int64()), part.column("doc_id"), part.column("n_bytes"),
                     *[pa.array(column, kind) for column, kind in zip(zip(*packed), (pa.binary(), pa.binary(), pa.bool_()))],
                     pa.nulls(len(part), pa.list_(pa.string()))], names=[*_DOC, "names"])
                size += int(pc.sum(part.column("n_bytes")).as_py())
                if size >= PART_SLICES * slice_bytes:
                    yield names_row()
                    done, size, known = done + 1, 0, {}
        if known:
            yield names_row()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"part long, doc_id {kind}, n_bytes long, codes binary, times binary, wide boolean, names array<string>")


def piece_counts(pre_tokens: DataFrame, spec: str) -> DataFrame:
    """``(part, code, pre_token)`` -> ``(part, code, pieces)`` as lists: each distinct pre-token is encoded once, by the BPE model alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _tokenizer(spec).model
        special = set(_special(_tokenizer(spec)))
        for batch in batches:
            coded = batch.column("pre_token").dictionary_encode()
            pieces = pa.array([1 if p in special else len(model.tokenize(p)) for p in coded.dictionary.to_pylist()], pa.int32()).take(coded.indices)
            part = batch.column("part").to_numpy()
            order = np.argsort(part, kind="stable")
            parts, first = np.unique(part[order], return_index=True)
            ends = pa.array(np.append(first, len(part)), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(parts), *[pa.ListArray.from_arrays(ends, c.take(pa.array(order))) for c in (batch.column("code"), pieces)]],
                                             names=["part", "code", "pieces"])

    # sorted, so that the rows of a pre-token lie side by side
    return pre_tokens.repartition("pre_token").sortWithinPartitions("pre_token").mapInArrow(run, "part long, code array<int>, pieces array<int>")


def token_counts(docs: DataFrame, spec: str, text_col: str = "text", id_col: str = "doc_id",
                 slice_bytes: int = SLICE) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)`` for every row of ``docs``.

    ``spec`` is the text of a tokenizers JSON file.  Null text is empty: 0 bytes,
    0 tokens.  Repeated rows and null ids keep their rows.  An empty table gives
    no rows; extra columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"),
                       text_of(text_col).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    # written once: the numbers of the parts hold for both readers
    written = stored(frequencies(base, spec, slice_bytes), "frequencies", "zstd")
    counted = piece_counts(written.where("names IS NOT NULL").select("part", F.posexplode("names").alias("code", "pre_token")), spec)

    def summed(rows: pa.Table, counts: pa.Table) -> pa.Table:
        code = counts["code"].combine_chunks().flatten().to_numpy()
        pieces = np.zeros(len(code) + 1, dtype=np.int64)
        pieces[code] = counts["pieces"].combine_chunks().flatten().to_numpy()
        tokens = []
        for packed in zip(rows["codes"].to_pylist(), rows["times"].to_pylist(), rows["wide"].to_pylist()):
            code, times = _unpacked(*packed)
            tokens.append(int(pieces[code] @ times))
        return pa.table({"doc_id": rows["doc_id"], "n_bytes": rows["n_bytes"], "n_tokens": pa.array(tokens, pa.int64())})

    return (written.where("names IS NULL").select(*_DOC).groupBy("part").cogroup(counted.groupBy("part"))
            .applyInArrow(summed, f"doc_id {kind}, n_bytes long, n_tokens long"))

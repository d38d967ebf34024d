"""Sampled segmentations into sentence pieces, and lossless decoding.

Forward filtering: over the lattice of all pieces that fit a unit (a run of
spaces and the text up to the next space), the summed weight of all paths up to every
position.  Backward sampling: from the end, one incoming piece is drawn in
proportion to weight times what was filtered before it.  The draws are hashes
of the row key, the unit's number and the step, so a row is always cut the same
way, wherever it is computed.

Pieces don't cross units, so the lattice is filtered once per distinct unit of
a slice, and all occurrences are sampled together.  A character without a piece
of its own, and a literal word marker, become byte pieces; nothing is
normalised, so decoding gives back the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from sentencepiece import SentencePieceProcessor

from batchtrail.llm.common import mix64, ranges, slices, text_of, unit_floats

MARK = "▁"
#: Exponent of the piece weights: 0 draws all segmentations alike, large values tend to the best one.
ALPHA = 1.0
_U = np.uint64
_BASE = _U(0x100000001B3)
_SLOTS = 18  # bits of a hash that lead to its place in a table
_BYTE = 0x110000  # symbols from here on are bytes
_SLICE = 4 << 20


class Pieces:
    """The piece table as arrays: hash of the symbols of each piece, its id and its log weight."""

    def __init__(self, model: bytes, alpha: float = ALPHA):
        sp = SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        self.bytes: list[bytes] = [b""] * size
        plain, self.byte_id = [], np.full(256, -1, dtype=np.int64)
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) and MARK not in piece.lstrip(MARK):
                plain.append((piece, i, max(sp.get_score(i), -float(size))))
                self.bytes[i] = piece.replace(MARK, " ").encode()
        if (self.byte_id < 0).any() or MARK not in {p for p, _, _ in plain}:
            raise ValueError("the model lacks byte pieces or the word marker, so not every text can be written")
        self.longest = max(len(p) for p, _, _ in plain)
        self.single = np.zeros(_BYTE, dtype=bool)
        for p, _, _ in plain:
            if len(p) == 1:
                self.single[ord(p)] = True
        symbols = [np.array([ord(c) for c in p], dtype=_U) for p, _, _ in plain] + [np.array([_BYTE + b], dtype=_U) for b in range(256)]
        ids = np.array([i for _, i, _ in plain] + self.byte_id.tolist(), dtype=np.int64)
        # scores of a merge table are ranks: as weights, 1 / (1 + rank) to the power alpha
        logs = np.array([-alpha * np.log1p(max(0.0, -s)) for _, _, s in plain] + [0.0] * 256)
        mixed = {}
        for symbol in {int(x) for one in symbols for x in one}:
            mixed[symbol] = int(mix64(np.array([symbol + 1], dtype=_U))[0])
        hashes, begun = np.zeros(len(symbols), dtype=_U), set()
        for k, one in enumerate(symbols):
            h = 0
            for x in one:
                h = (h * int(_BASE) + mixed[int(x)]) & 0xFFFFFFFFFFFFFFFF
                begun.add(h)  # beginnings of pieces: a substring that begins no piece is not grown further
            hashes[k] = h
        self.table = np.array(self.bytes, dtype=object)
        order = np.argsort(hashes)
        self.hashes, self.ids, self.logs = hashes[order], ids[order].astype(np.int32), logs[order].astype(np.float32)
        self.begun, self._slots = np.array(sorted(begun), dtype=_U), {}
        for name, table in (("begun", self.begun), ("hashes", self.hashes)):
            self._slots[name] = np.searchsorted(table, np.arange((1 << _SLOTS) + 1, dtype=np.float64) * 2.0 ** (64 - _SLOTS)).astype(np.int32)

    def find(self, name: str, h: np.ndarray) -> np.ndarray:
        """Place of each hash in the table ``hashes`` or ``begun``, -1 where it isn't there."""
        table, slots = getattr(self, name), self._slots[name]
        slot = (h >> _U(64 - _SLOTS)).astype(np.int64)
        at, stop = slots[slot], slots[slot + 1]
        out = np.full(len(h), -1, dtype=np.int32)
        left = np.flatnonzero(at < stop)
        while len(left):
            hit = table[at[left]] == h[left]
            out[left[hit]] = at[left[hit]]
            at[left] += 1
            left = left[~hit]
            left = left[at[left] < stop[left]]
        return out

    def symbols(self, units: list[str], marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of all units, number of symbols of each): ``marked`` markers first, bytes where there is no piece."""
        text = "".join(units)
        chars = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        odd = ~self.single[chars] | (chars == ord(MARK))
        width = np.ones(len(chars), dtype=np.int64)
        width[odd] = 1 + (chars[odd] > 0x7F) + (chars[odd] > 0x7FF) + (chars[odd] > 0xFFFF)
        unit = np.repeat(np.arange(len(units)), lengths)
        total = np.bincount(unit, width, minlength=len(units)).astype(np.int64) + marked
        starts = np.concatenate(([0], np.cumsum(total)[:-1]))
        out = np.empty(int(total.sum()), dtype=np.int64)
        out[ranges(starts, marked)] = ord(MARK)
        before = np.cumsum(width) - width + np.cumsum(marked)[unit]
        out[before[~odd]] = chars[~odd]
        c, at, w = chars[odd], before[odd], width[odd]
        for k in range(4):  # byte k of the UTF-8 form
            has = w > k
            shift = 6 * (w[has] - 1 - k)
            lead = np.select([w[has] == 1, w[has] == 2, w[has] == 3], [0, 0xC0, 0xE0], 0xF0)
            value = (lead | (c[has] >> shift)) if k == 0 else (0x80 | ((c[has] >> shift) & 0x3F))
            out[at[has] + k] = _BYTE + value
        return out, total


_LOADED: dict[tuple[bytes, float], Pieces] = {}


def _pieces(model: bytes, alpha: float) -> Pieces:
    """The table of a model, built once per worker process."""
    if (model, alpha) not in _LOADED:
        _LOADED[model, alpha] = Pieces(model, alpha)
    return _LOADED[model, alpha]


class Lattice:
    """Edges of the lattices of many units, with the forward weights filtered."""

    def __init__(self, pieces: Pieces, symbols: np.ndarray, lengths: np.ndarray):
        self.states = np.concatenate(([0], np.cumsum(lengths + 1))).astype(np.int32)  # state of (unit, 0)
        starts = np.cumsum(lengths) - lengths
        place = (np.arange(len(symbols)) - np.repeat(starts, lengths)).astype(np.int32)
        state = place + np.repeat(self.states[:-1], lengths)
        left = np.repeat(lengths, lengths).astype(np.int32) - place
        mixed = mix64(symbols.astype(_U) + _U(1))
        h = np.zeros(len(symbols), dtype=_U)
        source, target, end, ids, logs = [], [], [], [], []
        alive = np.arange(len(symbols), dtype=np.int32)
        for n in range(1, pieces.longest + 1):
            alive = alive[left[alive] >= n]
            if not len(alive):
                break
            grown = h[alive] * _BASE + mixed[alive + (n - 1)]
            h[alive] = grown
            at = pieces.find("hashes", grown)
            hit = np.flatnonzero(at >= 0)
            at, begin = at[hit], alive[hit]
            source.append(state[begin])
            target.append(source[-1] + np.int32(n))
            end.append(place[begin] + np.int32(n))
            ids.append(pieces.ids[at])
            logs.append(pieces.logs[at])
            alive = alive[pieces.find("begun", grown) >= 0]
        source, target, end, ids, logs = (np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(
            (source, target, end, ids, logs), (np.int32, np.int32, np.int32, np.int32, np.float32)))
        order = np.argsort(target, kind="stable")  # incoming edges of a state side by side
        self.source, self.ids, into, end, logs = source[order], ids[order], target[order], end[order], logs[order]
        # all units advance together, position by position
        turn = np.argsort(end.astype(np.uint16) if end.max(initial=0) < 1 << 16 else end, kind="stable")
        source, target, end, logs = self.source[turn], into[turn], end[turn], logs[turn]
        forward = np.full(int(self.states[-1]), -np.inf)
        forward[self.states[:-1]] = 0.0
        chance = np.zeros(len(source))
        cuts = np.searchsorted(end, np.arange(1, int(lengths.max(initial=0)) + 2))
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            weight = forward[source[a:b]] + logs[a:b]
            first = np.flatnonzero(np.concatenate(([True], target[a + 1:b] != target[a:b - 1])))
            width = np.diff(np.concatenate((first, [b - a])))
            top = np.maximum.reduceat(weight, first)
            grown = np.exp(weight - np.repeat(top, width))
            total = np.add.reduceat(grown, first)
            forward[target[a:b][first]] = top + np.log(total)
            chance[a:b] = grown / np.repeat(total, width)
        # the chances of a state's incoming edges, cumulated; the last one is reached by any draw
        cumulated = np.empty(len(chance))
        cumulated[turn] = chance
        self.first = np.searchsorted(into, np.arange(len(forward) + 1, dtype=np.int32)).astype(np.int32)
        run = np.concatenate(([0.0], np.cumsum(cumulated)))
        self.ceiling = (run[1:] - run[self.first[into]]).astype(np.float32)
        self.ceiling[self.first[1:][np.diff(self.first) > 0] - 1] = 2.0

    def sample(self, units: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids of all occurrences in order, number of pieces of each) for occurrences of ``units``."""
        order = np.argsort(units, kind="stable")  # occurrences of a unit side by side: neighbours in memory
        floor = self.states[units[order]]
        state = self.states[units[order] + 1] - 1
        seeds = seeds[order]
        on = np.flatnonzero(state > floor)
        count = np.zeros(len(units), dtype=np.int64)
        who, drawn, step = [], [], 0
        while len(on):
            u = unit_floats(mix64(seeds[on] + _U((step + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))).astype(np.float32)
            edge = self.first[state[on]]
            more = np.flatnonzero(self.ceiling[edge] <= u)
            while len(more):
                edge[more] += 1
                more = more[self.ceiling[edge[more]] <= u[more]]
            rows = order[on]
            who.append(rows.astype(np.int32))
            drawn.append(self.ids[edge])
            count[rows] += 1
            state[on] = self.source[edge]
            on = on[state[on] > floor[on]]
            step += 1
        ends = np.cumsum(count)
        out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.int32)
        for k, (rows, ids) in enumerate(zip(who, drawn)):
            out[ends[rows] - 1 - k] = ids
        return out, count


def sampled_ids(pieces: Pieces, texts: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece ids of all texts, number of pieces of each); ``keys`` are the 64-bit seeds of the rows."""
    lists = pc.split_pattern(texts, " ")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    coded = flat.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    marked = np.ones(len(code), dtype=bool)
    marked[offsets[:-1][np.diff(offsets) > 0]] = False
    sizes = np.diff(offsets)
    ends = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # a run of spaces goes with the word after it
    ends[offsets[1:][sizes > 0] - 1] = True
    ends = np.flatnonzero(ends)
    marks = np.diff(np.concatenate(([0], np.cumsum(marked)[ends])))
    most = int(marks.max(initial=0)) + 1
    unit, code = np.unique(code[ends] * most + marks, return_inverse=True)
    words = coded.dictionary.to_pylist()
    symbols, lengths = pieces.symbols([words[u // most] for u in unit], unit % most)
    lattice = Lattice(pieces, symbols, lengths)
    row = np.repeat(np.arange(len(sizes)), sizes)[ends]
    nth = ends - offsets[:-1][row]
    seeds = mix64(keys[row] + (nth.astype(_U) + _U(1)) * _U(0xD1342543DE82EF95))
    ids, count = lattice.sample(code, seeds)
    return ids, np.bincount(row, count, minlength=len(sizes)).astype(np.int64)


def _keyed(docs: DataFrame, key_col: str, text_col: str, seed: int) -> DataFrame:
    return docs.select(F.col(key_col).alias("key"), F.xxhash64(F.col(key_col), F.lit(seed)).alias("seed"),
                       text_of(text_col).alias("text"))


def encode(docs: DataFrame, model: bytes, key_col: str = "doc_id", text_col: str = "text", seed: int = 0,
           alpha: float = ALPHA) -> DataFrame:
    """``(key, text, ids)`` per row of ``docs``: one sampled segmentation of the whole text.

    Rows with the same key and text are cut alike; a null key has a seed of its own.  Null
    text is empty and has no pieces.  An empty table gives no rows; other columns are dropped.
    """
    kind = docs.schema[key_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model, alpha)
        for batch in batches:
            for start, stop in slices(batch.column("text"), _SLICE):
                part = batch.slice(start, stop - start)
                keys = part.column("seed").to_numpy(zero_copy_only=False).view(_U)
                ids, sizes = sampled_ids(pieces, part.column("text"), keys)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("text"), lists], names=["key", "text", "ids"])

    return _keyed(docs, key_col, text_col, seed).mapInArrow(run, f"key {kind}, text string, ids array<int>")


def spelled(pieces: Pieces, ids: np.ndarray) -> str:
    """The text of a run of ids; bytes that are no UTF-8 become U+FFFD."""
    return b"".join(pieces.table[ids].tolist()).decode("utf-8", "replace")


def round_trip(docs: DataFrame, model: bytes, key_col: str = "doc_id", text_col: str = "text", seed: int = 0,
               alpha: float = ALPHA) -> DataFrame:
    """``(key, n_pieces, ids_sha256, lossless)`` per row: size and digest (little-endian 32-bit ids) of what ``encode``
    gives, and whether decoding spells the text.  The ids are decoded where they are sampled and don't leave the task."""
    kind = docs.schema[key_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model, alpha)
        for batch in batches:
            for start, stop in slices(batch.column("text"), _SLICE):
                part = batch.slice(start, stop - start)
                keys = part.column("seed").to_numpy(zero_copy_only=False).view(_U)
                ids, sizes = sampled_ids(pieces, part.column("text"), keys)
                digests, lossless, at = [], [], 0
                for n, text in zip(sizes.tolist(), part.column("text")):
                    own = ids[at:at + n]
                    digests.append(hashlib.sha256(own.astype("<i4").tobytes()).hexdigest())
                    lossless.append(spelled(pieces, own) == text.as_py())
                    at += n
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()),
                                                  pa.array(lossless, pa.bool_())],
                                                 names=["key", "n_pieces", "ids_sha256", "lossless"])

    return _keyed(docs, key_col, text_col, seed).mapInArrow(run, f"key {kind}, n_pieces long, ids_sha256 string, lossless boolean")


def decode(rows: DataFrame, model: bytes, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text that the ids spell, ``out``; null ids are none.  Bytes that are no UTF-8 become U+FFFD."""
    kept = rows.drop(out)
    schema = StructType([*kept.schema.fields, StructField(out, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model, ALPHA)
        for whole in batches:
            for start in range(0, len(whole), 1024):
                batch = whole.slice(start, 1024)
                texts = []
                for ids in batch.column(ids_col):
                    ids = np.zeros(0, np.int32) if not ids.is_valid else ids.values.to_numpy()
                    texts.append(spelled(pieces, ids))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return kept.mapInArrow(run, schema)

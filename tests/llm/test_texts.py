"""Token counts, fingerprints, piece sampling, packing."""

import hashlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from batchtrail.llm import merkle, packing, piece_sampling, token_count
from tests.llm import cases


@pytest.fixture(scope="module")
def spec():
    return open(public_tokenizers.path("word_bpe_49k.json")).read()


@pytest.fixture(scope="module")
def model():
    return open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()


@pytest.mark.parametrize("size", [500, token_count.SLICE])
def test_counts_equal_the_library(spark, small_docs, spec, size):
    tokenizer = Tokenizer.from_str(spec)
    for docs in (cases.docs(spark), small_docs):
        want = sorted((repr(r.doc_id), len((r.text or "").encode()), len(tokenizer.encode(r.text or "", add_special_tokens=False).ids))
                      for r in docs.collect())
        assert sorted((repr(r.doc_id), r.n_bytes, r.n_tokens) for r in token_count.token_counts(docs, spec, slice_bytes=size).collect()) == want
    assert token_count.token_counts(cases.empty(spark), spec).count() == 0


def test_special_tokens_and_spaces_count_as_in_the_library(spark, spec):
    texts = ["<|startoftext|>a<|endoftext|><|endoftext|> b", "İstanbul Σας ﬁ", "a b\x1cc\u0085d", "it's I'LL 12345 ###!!", "é ́x"]
    tokenizer = Tokenizer.from_str(spec)
    got = token_count.token_counts(cases.docs(spark, list(enumerate(texts))), spec).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


# ---- fingerprints

def test_fingerprints_find_equal_and_edited_texts():
    make = merkle.Fingerprinter()
    text = "\n".join(f"paragraph number {i} says something of its own, {i * i}" for i in range(40))
    edited = text.replace("number 17 says", "number 17 denies")
    a, b = make.fingerprint(text), merkle.Fingerprinter(keep=1).fingerprint(edited)
    assert make.fingerprint(text) == a != b
    assert merkle.likeness(a, a) == 1.0 and 0.9 < merkle.likeness(a, b) < 1.0 and merkle.likeness(a, b) == pytest.approx(merkle.likeness(b, a))
    assert merkle.changed_paragraphs(a, b) == [(17, 18, 17, 18)]
    assert [len(x) for x in merkle.differing(a, b)] == [1, 1]
    assert make.fingerprint("a\n\nb") != make.fingerprint("a\nb") and merkle.likeness(make.fingerprint("a\n\nb"), make.fingerprint("a\nb")) == 0.9999
    assert merkle.likeness(make.fingerprint(""), a) == 0.0 and merkle.likeness(make.fingerprint(""), make.fingerprint("")) == 1.0


def brute_next(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.sha256(r[1].encode()).hexdigest()))
    out = []
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        n = len(t) // 3
        e = t[:len(t) - n] + following[:n]
        make = merkle.Fingerprinter()
        fp, fe = make.fingerprint(t), make.fingerprint(e)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), fp, fe, merkle.likeness(fp, fe), merkle.likeness(fp, make.fingerprint(following))))
    return sorted(out, key=repr)


def test_every_text_is_compared_with_the_next(spark, small_docs):
    for docs in (cases.docs(spark), small_docs.repartition(7), cases.docs(spark, [(1, "alone")])):
        want = brute_next([(r.doc_id, r.text or "") for r in docs.collect()])
        assert sorted((tuple(r) for r in merkle.compared_with_next(docs).collect()), key=repr) == want
    assert merkle.compared_with_next(cases.empty(spark)).count() == 0


def test_edited_texts_are_nearer_than_the_next(spark, small_docs):
    rows = merkle.compared_with_next(small_docs).where("n_chars >= 3").collect()
    assert sum(r.near_edited > r.near_next for r in rows) >= 0.98 * len(rows)
    assert merkle.fingerprints(cases.docs(spark)).select("fingerprint").where("fingerprint is null").count() == 0


# ---- piece sampling

def test_round_trip_is_lossless_and_reproducible(spark, small_docs, model):
    for docs in (cases.docs(spark), small_docs):
        rows = piece_sampling.round_trip(docs, model).collect()
        assert len(rows) == docs.count() and all(r.lossless for r in rows)
        again = piece_sampling.round_trip(docs.repartition(5), model).collect()
        assert sorted(map(repr, rows)) == sorted(map(repr, again))
    coded = piece_sampling.encode(cases.docs(spark), model)
    assert piece_sampling.decode(coded, model).where("decoded <> text").count() == 0
    assert {r.key: r.ids for r in coded.collect()}[4] == []
    assert piece_sampling.round_trip(cases.empty(spark), model).count() == 0
    assert piece_sampling.decode(coded.withColumn("ids", F.lit(None).cast("array<int>")), model).where("decoded <> ''").count() == 0


def test_segmentations_are_drawn_by_weight(model):
    pieces = piece_sampling.Pieces(model)
    word = "thing"
    weights = defaultdict(float)
    by = {bytes(pieces.bytes[i]): w for i, w in zip(pieces.ids, pieces.logs) if len(pieces.bytes[i])}
    for k in range(len(word)):
        for cuts in combinations(range(1, len(word)), k):
            parts = [word[a:b].encode() for a, b in zip((0, *cuts), (*cuts, len(word)))]
            if all(p in by for p in parts):
                weights[tuple(parts)] = float(np.exp(sum(by[p] for p in parts)))
    n = 40_000
    ids, sizes = piece_sampling.sampled_ids(pieces, pa.array([word] * n), np.arange(n, dtype=np.uint64) * np.uint64(7919))
    seen, at = defaultdict(int), 0
    for s in sizes:
        seen[tuple(pieces.bytes[i] for i in ids[at:at + s])] += 1
        at += s
    total = sum(weights.values())
    assert set(seen) <= set(weights)
    for parts, w in weights.items():
        assert abs(seen[parts] / n - w / total) < 0.01


def test_runs_of_spaces_are_cut_into_all_their_pieces(model):
    pieces = piece_sampling.Pieces(model)
    texts = ["a    b", "    x", "  ", "", " y z ", "a b", "   ", "\n        def f"] * 500
    ids, sizes = piece_sampling.sampled_ids(pieces, pa.array(texts), np.arange(len(texts), dtype=np.uint64) * np.uint64(7919))
    at = np.concatenate(([0], np.cumsum(sizes)))
    assert [piece_sampling.spelled(pieces, ids[a:b]) for a, b in zip(at[:-1], at[1:])] == texts
    assert {b"  ", b"   ", b"    "} <= {pieces.bytes[i] for i in ids.tolist()}


# ---- packing

def test_edges_equal_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(20):
        edges = np.sort(rng.choice(np.arange(1, 200), 9, replace=False))
        counts = rng.integers(1, 50, 9)
        for k in (1, 2, 3, 4, 9, 12):
            def cost(chosen):
                return sum(c * min(e for e in chosen if e >= x) for x, c in zip(edges, counts))
            best = min(cost((*some, edges[-1])) for r in range(min(k, 9)) for some in combinations(edges[:-1], r))
            assert cost(packing.optimal_edges(edges, counts, k)) == best


def test_padding_is_minimal_over_exact_lengths(spark):
    def packed(lengths, **more):
        rows = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, n long")
        return packing.pack(rows, F.col("n"), **more).collect()

    alike = packed([1000] * 130)
    assert {r.edge for r in alike} == {1000} and not any(r.padding for r in alike)
    assert sorted(r.place for r in alike if r.batch == 0) == list(range(65))
    rng = np.random.default_rng(3)
    lengths = rng.choice([0, 7, 40, 33, 1000, 1001, 1023, 1025, 5000, 5003, 70_000], 200).tolist()
    for buckets in (1, 3, 4):
        def cost(chosen):
            return sum(min(e for e in chosen if e >= x) for x in lengths) - sum(lengths)
        apart = sorted(set(lengths))
        best = min(cost((*some, apart[-1])) for some in combinations(apart[:-1], buckets - 1))
        assert sum(r.padding for r in packed(lengths, buckets=buckets)) == best


def test_edges_of_many_lengths_equal_a_plain_program():
    rng = np.random.default_rng(5)
    for n, top in ((150, 400), (150, 10**12), (150, 2**62)):
        edges = np.unique(rng.integers(1, top, n))
        counts = rng.integers(1, 1000, len(edges))
        for buckets in (1, 2, 5, 12):
            e, c = edges.tolist(), counts.tolist()
            least = {0: 0}
            for _ in range(buckets):
                least = {j: min(v + sum(c[i:j]) * e[j - 1] for i, v in least.items() if i < j) for j in range(1, len(e) + 1)
                         if any(i < j for i in least)}
            chosen = packing.optimal_edges(edges, counts, buckets)
            assert len(chosen) == buckets and sum(k * min(x for x in chosen if x >= v) for v, k in zip(e, c)) == least[len(e)]


@pytest.mark.parametrize("slice_rows", [3, packing.SLICE_ROWS])
def test_batches_keep_the_budget_and_every_row(spark, small_docs, monkeypatch, slice_rows):
    monkeypatch.setattr(packing, "SLICE_ROWS", slice_rows)
    for docs in (small_docs, cases.docs(spark)):
        rows = packing.pack(docs, buckets=4, budget=2000).collect()
        want = sorted((repr(r.doc_id), len((r.text or "").replace(" ", "_").split())) for r in docs.collect())
        assert sorted((repr(r.doc_id), r.length) for r in rows) == want
        groups = defaultdict(list)
        for r in rows:
            assert r.length <= r.edge and r.padding == r.edge - r.length
            groups[r.bucket, r.batch].append(r)
        for (bucket, batch), members in groups.items():
            room = max(1, 2000 // max(1, members[0].edge))
            assert sorted(r.place for r in members) == list(range(len(members))) and len(members) <= room
            last = max(b for k, b in groups if k == bucket)
            assert batch == last or len(members) == room  # only the last batch of a bucket has room
    assert packing.pack(cases.empty(spark)).count() == 0


def test_grid_is_fine_and_bounded(spark):
    rows = spark.range(1, 200_000, 37).select(F.col("id"), packing.grid_edge(F.col("id")).alias("e")).collect()
    assert all(r.id <= r.e <= r.id * 17 / 16 + 1 for r in rows) and len({r.e for r in rows}) < 300

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from batchtrail.llm import near_dedup as N
from batchtrail.llm.components import components
from tests.llm import cases


def brute_classes(texts):
    """class of every distinct text by comparing all pairs."""
    counts = {k: N.shingle_counts(t) for k, t in texts.items()}
    label = {k: k for k in texts}

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for a, b in combinations(sorted(texts), 2):
        if N.similarity(counts[a], counts[b]) >= N.SIMILARITY:
            x, y = find(a), find(b)
            label[max(x, y)] = min(x, y)
    return {k: find(k) for k in texts}


def near_copies(n, seed=5):
    rng = np.random.default_rng(seed)
    base = [f"w{rng.integers(500)}" for _ in range(120)]
    out = []
    for _ in range(n):
        words = list(base)
        for at in rng.integers(0, len(words), rng.integers(0, 7)):
            words[at] = f"e{rng.integers(10_000)}"
        out.append(" ".join(words))
    return out


def test_registers_estimate_probability_jaccard():
    a = "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3
    b = "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 2 + "0 1 2 3 4 5 6 7 8 9"
    regs, has = N.text_registers(pa.array([a, b, "", "one"]), 4096)
    x, y = N.shingle_counts(a), N.shingle_counts(b)
    assert has.tolist() == [True, True, False, True]
    shares = [{k: v / c.total() for k, v in c.items()} for c in (x, y)]
    exact = sum(1 / sum(max(shares[0].get(e, 0) / shares[0][d], shares[1].get(e, 0) / shares[1][d]) for e in x.keys() | y.keys())
                for d in x.keys() & y.keys())
    assert abs((regs[0] == regs[1]).mean() - exact) < 0.03
    assert (regs[3] == regs[3][0]).all()


def test_similarity_measures():
    assert N.similarity(Counter("ab"), Counter("ab")) == 1.0
    assert N.similarity(Counter(), Counter()) == 1.0 and N.similarity(Counter(), Counter("a")) == 0.0
    assert N.similarity(Counter("aab"), Counter("aaaabb")) == pytest.approx(1.0)  # equal shares


def test_classes_equal_brute_force(spark):
    texts = near_copies(60) + near_copies(30, seed=9) + ["short one", "short one two", "x " * 300, "x " * 500]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[0]) for i in range(40)]
    got = {(r.node, r.class_id) for r in N.near_duplicate_classes(cases.docs(spark, rows)).collect()}
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    assert got == set(brute_classes({i: t for t, i in first.items()}).items())


def repeated_lines(n, seed):
    """Texts of about the same shingles, which differ in how often their last words repeat."""
    rng = np.random.default_rng(seed)
    words = [f"r{seed}x{i}" for i in range(200)]
    return [" ".join(words[rng.integers(3):] + words[-10:] * int(k)) for k in range(0, 20 * n, 20)]


def test_links_by_set_jaccard_alone_are_found(spark, monkeypatch):
    a, b = (N.shingle_counts(t) for t in repeated_lines(4, 1)[::3])
    both, shares = a.keys() & b.keys(), [{k: v / c.total() for k, v in c.items()} for c in (a, b)]
    weighted = sum(min(s[k] for s in shares) for k in both)  # probability Jaccard is at most the shared weight
    assert weighted < 0.5 and len(both) / len(a.keys() | b.keys()) > 0.9
    texts = [t for s in range(6) for t in repeated_lines(4, s)] + near_copies(10)
    want = set(brute_classes(dict(enumerate(texts))).items())
    assert len({c for n, c in want if n < 24}) == 6
    for tile in (N.TILE, 2):
        monkeypatch.setattr(N, "TILE", tile)
        assert {(r.node, r.class_id) for r in N.near_duplicate_classes(cases.docs(spark, list(enumerate(texts)))).collect()} == want


def test_equal_weights_estimate_set_jaccard():
    texts = [*repeated_lines(4, 1)[::3], " ".join(f"r1x{i}" for i in range(200)), "", "a b " * 50]
    regs, has, uneven, plain = N.both_registers(pa.array(texts), 4096)
    assert has.tolist() == [True, True, True, False, True] and uneven.tolist() == [1]
    a, b = set(N.shingle_counts(texts[1])), set(N.shingle_counts(texts[2]))
    assert abs((plain[0] == regs[2]).mean() - len(a & b) / len(a | b)) < 0.03
    assert (regs == N.text_registers(pa.array(texts), 4096)[0]).all()


def test_small_tiles_give_the_same_classes(spark, monkeypatch):
    rows = list(enumerate(near_copies(80, seed=3)))
    whole = {(r.doc_id, r.class_id) for r in N.near_duplicate_classes(cases.docs(spark, rows)).collect()}
    monkeypatch.setattr(N, "TILE", 8)
    assert {(r.doc_id, r.class_id) for r in N.near_duplicate_classes(cases.docs(spark, rows)).collect()} == whole


def test_odd_rows(spark):
    rows = N.near_duplicate_classes(cases.docs(spark)).collect()
    assert len(rows) == 13
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert {r.class_id for i in (1, 2) for r in by[1] + by[2]} == {1}
    assert {r.class_id for r in by[3] + by[4]} == {3} and by[6][0].class_id == by[7][0].class_id == 6
    assert len({r.class_id for r in by[9]}) == 2  # one id, two texts
    assert sorted(r.class_id == 3 for r in by[None]) == [False, True]  # null text equals empty text
    assert min(r.class_id for r in by[None]) < 0
    assert N.near_duplicate_classes(cases.empty(spark)).count() == 0


def test_one_row_of_each_class_stays(spark):
    docs = cases.docs(spark)
    kept = N.one_per_class(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect()) == [-1, 1, 3, 5, 6, 8, 9, 9]
    assert N.one_per_class(cases.empty(spark)).count() == 0


def test_components_of_a_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)]
    got = {(r.node, r.label) for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(i, 100) for i in range(100, 150)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

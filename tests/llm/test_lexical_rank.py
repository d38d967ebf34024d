"""Ranked lexical search against a plain scoring of every document."""

import math
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from batchtrail.llm import lexical_rank as lr
from tests.llm import cases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(docs, items, k=10):
    """Every document scored for every item, without tries or bounds."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scored = []
        for i, c in counts:
            m = 100 - 90 + ((90 * sum(c.values()) * n) // length)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in wanted if t in c)
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


def key(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def run(docs, items, **options):
    return key([tuple(r) for r in lr.ranked(docs, items, **options).collect()])


def test_equals_plain_scoring(spark, small_docs):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = plain([(r.doc_id, r.text) for r in small_docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert run(small_docs, items) == key(want)
    assert run(small_docs, items, block_pairs=800) == key(want)  # several blocks of items


def test_odd_rows(spark):
    items = [(1, "one two THREE"), (2, None), (3, ""), (None, "x another"), (4, "漢字 😀 ß"), (4, "word1"), (4, "word1"), (5, "nowhere")]
    asked = spark.createDataFrame([(i, t, 1, 2, "d") for i, t in items], "item_id long, text string, doc_id int, rank int, term string")
    docs = cases.docs(spark)
    assert run(docs, asked) == key(plain([(r.doc_id, r.text) for r in docs.collect()], items))
    assert run(cases.empty(spark), asked) == [] and run(docs, asked.limit(0)) == []


def test_ties_go_to_the_smaller_id(spark):
    docs = cases.docs(spark, [(i, "same words here") for i in range(200, 0, -1)] + [(None, "same words here")] + [(7, "other")] * 300)
    items = spark.createDataFrame([(1, "Words, same!")], "item_id long, text string")
    assert [r[2] for r in run(docs, items)] == list(range(1, 11))


def test_folding_keeps_other_characters():
    import pyarrow as pa
    texts = ["Ab-9_z Q é", "", "ÀB\x7fc\x00D", "😀x"]
    got = lr.folded(pa.array(texts)).to_pylist()
    assert [t.split(" ") if t else [] for t in got][0] == ["ab", "9", "z q é"]
    assert [[w for w in t.split(" ") if w] for t in got] == [terms(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 11), st.integers(1, 5), min_size=1), min_size=1, max_size=60), st.integers(1, 5),
       st.sets(st.integers(0, 12), min_size=1), st.integers(1, 6), st.randoms())
def test_branch_and_bound_loses_nothing(docs, leaf, wanted, k, random):
    weight = np.array([random.randint(1, 50) for _ in range(13)])
    m = np.array([random.randint(10, 400) for _ in docs])
    first = np.cumsum([0] + [len(d) for d in docs])
    term = np.array([t for d in docs for t in sorted(d)])
    times = np.array([d[t] for d in docs for t in sorted(d)])
    trie = lr.Trie(first, term, times, m, weight, leaf)
    member = np.zeros(13, dtype=bool)
    member[sorted(wanted)] = True
    best = []
    trie.search(np.array(sorted(wanted)), member, [(1, -i) for i in range(len(docs))], best, k)
    scores = [sum(int(weight[t] * lr.gain(d[t], m[i])) for t in wanted if t in d) for i, d in enumerate(docs)]
    assert sorted(best, reverse=True) == sorted(((s, (1, -i)) for i, s in enumerate(scores) if s > 0), reverse=True)[:k]


def test_bounds_leave_leaves_out(spark):
    """Documents that share nothing with an item are not scored."""
    rng = np.random.default_rng(1)
    sets = [np.sort(rng.choice(np.arange(100 * (i % 4), 100 * (i % 4) + 100), 12, replace=False)) for i in range(2000)]
    trie = lr.Trie(np.arange(2001) * 12, np.concatenate(sets), np.ones(24000, np.int64), np.full(2000, 100), np.full(400, 9), 16)
    member = np.zeros(400, dtype=bool)
    member[sets[0]] = True
    scored = trie.search(sets[0], member, [(1, -i) for i in range(2000)], best := [], 3)
    assert best and max(best)[1] == (1, 0) and scored < sum(trie.is_leaf) / 3

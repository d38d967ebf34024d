"""Fingerprints and toxicity scores against plain versions that share no code with the operators."""

import hashlib
import math

import numpy as np
import pytest

from batchtrail.llm import merkle, toxicity

M = (1 << 64) - 1


def mix(x):
    x &= M
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M
    return x ^ (x >> 31)


# ---------------------------------------------------------------- Merkle tree

def sha(text, n):
    return hashlib.sha256(text.encode()).hexdigest()[:n]


def plain_sketch(paragraph):
    chars = [ord(c) for c in "   " + paragraph]
    grams = set()
    for i in range(max(1, len(chars) - 3)):
        h = 0
        for k, c in enumerate(chars[i:i + 4]):
            h = c if not k else (h * 0x100000001B3 + c) & M
        grams.add(mix(h))
    digits = []
    for s in range(1, 33):
        seed = mix(s * 0x9E3779B97F4A7C15) | 1
        least = min((p := g * seed & M) ^ (p >> 29) for g in grams)
        digits.append(f"{mix(least) & 15:x}")
    return "".join(digits)


def plain_tree(text):
    """(root, [[leaf, ...], ...]); a leaf is (hash, sketch, length)."""
    sections, run = [], []
    for line in text.split("\n"):
        if not line.strip():
            continue
        run.append((sha(line, 12), plain_sketch(line), len(line)))
        if int(run[-1][0], 16) % 8 == 0:
            sections.append(run)
            run = []
    if run:
        sections.append(run)
    named = [sha(",".join(".".join(map(str, leaf)) for leaf in s), 12) for s in sections]
    return sha(" ".join(named) + "\n" + sha(text, 64), 32), list(zip(named, sections))


def as_text(tree):
    root, sections = tree
    return "/".join([root, *(f"{h}:" + ",".join(".".join(map(str, leaf)) for leaf in s) for h, s in sections)])


def without(mine, other):
    """Items of ``mine`` beyond their number in ``other``, the later ones."""
    left, out = list(other), []
    for x in mine:
        if x in left:
            left.remove(x)
        else:
            out.append(x)
    return out


def plain_likeness(a, b):
    if a[0] == b[0]:
        return 1.0
    size = [sum(leaf[2] for _, s in t[1] for leaf in s) for t in (a, b)]
    if not all(size):
        return 0.0 if any(size) else 0.9999
    one = [leaf for _, s in without(a[1], b[1]) for leaf in s]
    two = [leaf for _, s in without(b[1], a[1]) for leaf in s]
    one, two = without(one, two), without(two, one)
    equal = size[0] - sum(leaf[2] for leaf in one)

    def found(mine, others):
        total = 0.0
        for leaf in mine:
            best = max((sum(x == y for x, y in zip(leaf[1], o[1])) / 32 for o in others), default=0.0)
            total += leaf[2] * ((best - 1 / 16) / (1 - 1 / 16) if best >= 7 / 32 else 0.0)
        return total

    return min(0.9999, (equal + min(found(one, two), found(two, one))) / max(size))


TEXTS = ["", "one", "one\n", "a\nb\n\nc", "   \n\t", "é漢😀\nx"] + ["\n".join(f"line {i * k % 23} of text {k} with words" for i in range(n)) for k, n in ((1, 30), (3, 30), (7, 12))]
TEXTS += [TEXTS[6].replace("line 5", "line five"), TEXTS[6] + "\nmore", TEXTS[6].replace("\n", "\n\n")]


def test_the_tree_equals_a_plain_one():
    made = merkle.Fingerprinter(keep=3)
    assert [made.fingerprint(t) for t in TEXTS] == [as_text(plain_tree(t)) for t in TEXTS]


def test_likeness_equals_a_plain_comparison():
    trees = [plain_tree(t) for t in TEXTS]
    for a in trees:
        for b in trees:
            assert merkle.likeness(as_text(a), as_text(b)) == pytest.approx(plain_likeness(a, b), abs=1e-12)


# ------------------------------------------------------------------- toxicity

def plain_grams(text, sizes, bits):
    """Buckets of the character n-grams of a text."""
    text = " " + " ".join(text.casefold().split()) + " "
    out = set()
    for n in sizes:
        for i in range(len(text) - n + 1):
            h = 0
            for k, c in enumerate(text[i:i + n]):
                h = mix(ord(c) + 1) if not k else (h * 0x100000001B3 + mix(ord(c) + 1)) & M
            out.add(mix(h + n) >> (64 - bits))
    return out


def plain_scores(texts, y, asked, sizes, bits):
    """Naive-Bayes-scaled logistic regression on dense rows."""
    grams = [plain_grams(t, sizes, bits) for t in texts]
    held = {b: [k for k, g in enumerate(grams) if b in g] for b in set().union(*grams)}
    p = np.ones(1 << bits)
    q = np.ones(1 << bits)
    for b, ks in held.items():
        p[b] += sum(y[k] for k in ks)
        q[b] += sum(1 - y[k] for k in ks)
    ratio = {b: math.log(p[b] / p.sum()) - math.log(q[b] / q.sum()) for b, ks in held.items() if len(ks) >= toxicity.LEAST_TEXTS}
    kept = [b for b in sorted(ratio) if ratio[b] != 0]

    def row(g):
        x = np.array([ratio[b] if b in g else 0.0 for b in kept])
        return x / max(np.sqrt((x ** 2).sum()), 1e-9)

    x, y = np.array([row(g) for g in grams]), np.asarray(y, dtype=float)
    w, b = np.zeros(len(kept)), math.log(y.mean() / (1 - y.mean()))
    v, c = w, b
    rate = 1 / (0.5 + toxicity.PENALTY)
    for k in range(toxicity.STEPS):
        miss = 1 / (1 + np.exp(-(x @ v + c))) - y
        w2, b2 = v - rate * (x.T @ miss / len(y) + toxicity.PENALTY * v), c - rate * miss.mean()
        v, c = w2 + k / (k + 3) * (w2 - w), b2 + k / (k + 3) * (b2 - b)
        w, b = w2, b2
    return [float(1 / (1 + np.exp(-(row(plain_grams(t, sizes, bits)) @ w + b)))) for t in asked]


def test_toxicity_equals_a_dense_version():
    texts = ["you are a vile rotten fool", "what a vile thing to say, fool", "rotten vile words again", "a calm day by the river", "the river runs calm today",
             "today we walk by the water", "fool of a vile kind", "water and river and day", "", "Vile  FOOL\nrotten"]
    y = [1, 1, 1, 0, 0, 0, 1, 0, 0, 1]
    asked = [*texts, "vile", "river", "ß İ 漢字", "x" * 5000]
    for sizes, bits in (((2, 3), 12), (toxicity.SIZES, 14)):
        model = toxicity.fit(texts, np.array(y), sizes, bits)
        assert toxicity.score_texts(model, asked) == pytest.approx(plain_scores(texts, y, asked, sizes, bits), abs=2e-4)

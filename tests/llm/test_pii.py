"""Personal data against plain regular expressions and a plain bootstrap over dictionaries."""

import hashlib
import math
import re
import time
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from batchtrail.llm import pii
from tests.llm import cases

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_luhn(digits):
    odd = [int(c) for c in digits[::-1][::2]]
    even = [sum(divmod(2 * int(c), 10)) for c in digits[::-1][1::2]]
    return (sum(odd) + sum(even)) % 10 == 0


def plain_spans(text):
    out = [(0, m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and plain_luhn(digits):
            out.append((2, m.start(), m.end()))
    return out + [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def joined(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="ab@.%-+ ()0129é\n", max_size=60))
def test_base_spans_equal_the_expressions(text):
    assert pii.base_spans(text) == plain_spans(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a.b@c.de", "@", "1.2.3.4", "1.2.3.4.5.6.7.8.9", "256.1.1.1", "001.0002.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112",
                                 "+1 (234) 555-0199", "+12", ".", " ", "x", "+", "%", "00000000000000000000", "é"]), max_size=12))
def test_base_spans_of_glued_forms(parts):
    assert pii.base_spans("".join(parts)) == plain_spans("".join(parts))


def test_long_runs_take_linear_time():
    start = time.time()
    for text in ("1" * 10 ** 6, "a" * 10 ** 6, "a@" * 500_000, "1." * 500_000, "1 " * 500_000, "+1 " * 300_000, "a.b@c" * 200_000, "(1" * 400_000):
        pii.base_spans(text), sum(1 for _ in pii.marked_words(text))
    assert time.time() - start < 30


def planted():
    """Contexts that give phones and cards away, contexts that hold anything, and copies."""
    rows = [f"Please call our desk at +1 (555) 010-{i:04d} during opening hours." for i in range(8)]
    rows += ["Please call our desk at 555-0199-77 during opening hours.", "Write to number 555-0199-77 instead of calling them."]
    rows += [f"Host was seen {10 + i}.0.0.{i} yesterday night again." for i in range(8)] + ["Host was seen fe80::1:2 yesterday night again."]
    rows += [f"Order code {w} was shipped to you." for w in ("10.0.0.1", "10.0.0.2", "77.1.1.9", "9.9.9.9", "8.8.8.8", "1234567", "7654321", "9876543", "55-66-77-88")]
    rows += [f"mail me {n}@example.org or stop" for n in ("ann", "bob", "cem", "dan", "eva", "fay")] + ["mail me güther(at)example or stop"]
    rows += ["Please call our desk at room 12 during opening hours."]
    return rows + rows[:3] * 20


def plain_bootstrap(texts, rounds=pii.ROUNDS):
    """Patterns and instances in dictionaries, all texts at once."""
    known, loose, by_pattern = defaultdict(set), {}, defaultdict(set)
    for text in texts:
        base = plain_spans(text)
        rest = text
        for _, a, b in base:
            rest = rest[:a] + " " * (b - a) + rest[b:]
        for a, b in {(a, b) for _, a, b in base} | set(pii.marked_words(rest)):
            word = text[a:b].lower()
            known[word] |= {k for k, x, y in base if (x, y) == (a, b)}
            loose[word] = {k for k in range(4) if pii.loose_kinds(text[a:b]) >> k & 1}
            for p in pii.patterns(text, a, b):
                by_pattern[p].add(word)
    score = {(w, k): 1.0 for w, ks in known.items() for k in ks}
    found = {}
    for _ in range(rounds):
        share = {}
        for p, words in by_pattern.items():
            for k in range(4):
                support = sum(score.get((w, k), 0) for w in words)
                if support >= pii.MIN_SUPPORT and support / len(words) >= pii.MIN_SHARE:
                    share[p, k] = support / len(words)
        got = {}
        for w in known:
            if known[w]:
                continue
            for k in loose[w]:
                value = 1 - math.prod(1 - pii.TRUST * s for (p, kk), s in share.items() if kk == k and w in by_pattern[p])
                if value >= pii.MIN_SCORE and value > got.get(w, (0, 0))[0]:
                    got[w] = (value, k)
        found = {w: k for w, (_, k) in got.items()}
        score = {x: v for x, v in score.items() if known[x[0]]} | {(w, k): v for w, (v, k) in got.items()}
    return found


def plain_rows(texts):
    found = plain_bootstrap(texts)
    out = []
    for text in texts:
        base = plain_spans(text)
        rest = text
        for _, a, b in base:
            rest = rest[:a] + " " * (b - a) + rest[b:]
        added = [(found[text[a:b].lower()], a, b) for a, b in pii.marked_words(rest) if text[a:b].lower() in found]
        counts = [sum(k == kind for k, _, _ in base) for kind in range(4)]
        out.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + added)), len(added)))
    return out


def test_contexts_find_unseen_identifiers(spark):
    texts = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = {r.doc_id: tuple(r)[1:] for r in pii.personal_data(docs).collect()}
    assert [rows[i] for i in range(len(texts))] == plain_rows(texts)
    spans = {texts[i]: r[5] for i, r in rows.items()}
    assert spans["Please call our desk at 555-0199-77 during opening hours."] == "phone:24:35"
    assert spans["Write to number 555-0199-77 instead of calling them."] == "phone:16:27"  # known from elsewhere
    assert spans["Host was seen fe80::1:2 yesterday night again."] == "ip:14:23"
    assert spans["mail me güther(at)example or stop"] == "email:8:25"
    assert not any(spans[t] for t in texts if t.startswith("Order code") and "." not in t.split()[2])
    assert spans["Please call our desk at room 12 during opening hours."] == ""


def test_copies_do_not_count_twice(spark):
    texts = ["call our desk at +1 (555) 010-0000 during hours"] * 50 + ["call our desk at 5550199777 during hours"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert pii.personal_data(docs).agg({"n_added": "sum"}).first()[0] == 0


def test_small_table_equals_plain(spark, small_docs):
    texts = [(r.doc_id, r.text or "") for r in small_docs.orderBy("doc_id").collect()]
    rows = [tuple(r)[1:] for r in pii.personal_data(small_docs).orderBy("doc_id").collect()]
    assert rows == plain_rows([t for _, t in texts])


def test_odd_rows(spark):
    rows = pii.personal_data(cases.docs(spark)).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(rows) == 13 and sum(r.doc_id is None for r in rows) == 2
    assert all(r.base_sha256 == empty and r.spans == "" and r.n_added == 0 for r in rows if r.doc_id != 6)
    long = spark.createDataFrame([(1, "x" * 300_000 + " 4111 1111 1111 1111 " + "9" * 300_000, 1, 2)], "doc_id long, text string, row int, base int")
    assert pii.personal_data(long).first().n_card == 0  # one run of digits with what follows
    assert pii.personal_data(cases.empty(spark)).count() == 0

"""Personal data in texts: fixed forms, and identifiers that only their context gives away.

1. One pass over the texts finds the spans of the fixed forms (``base_spans``) and
   every other word with a digit or an at sign, each with the lexical patterns
   around it: two words before, two words after, one word on either side.
2. The spans of the fixed forms are the seeds of a graph of patterns and instances
   (each pair once, however often it occurs).  Spark scores it in rounds: a pattern
   is worth the share of its distinct instances that are known to be of a kind, an
   instance that is not known yet takes its score from the patterns it occurs in,
   and the instances found join the seeds of the next round.
3. Every occurrence of a found instance is a further span of its document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchtrail.llm.common import stored, text_of

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: A pattern counts for a kind with this many distinct known instances and this share of all its instances.
MIN_SUPPORT, MIN_SHARE = 5, 0.8
#: An instance is found with this score; shares are discounted, so that one pattern alone does only if it is clean.
MIN_SCORE, TRUST = 0.85, 0.9
#: Context: words in so many characters on either side, each cut to so many.
WINDOW, WORD = 100, 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARKED = re.compile(r"(?:[0-9@]|[(\[][Aa][Tt][)\]])\S*+")
_NUMERIC = re.compile(r"[(+]?[0-9][0-9().+/-]*[,.;:!?]*")
_NUMBER = re.compile(r"[0-9]+")

# forms that an identifier of a kind may have beyond the fixed one
_LOOSE = (
    re.compile(r"[^\s@]+(?:@|\(at\)|\[at\])[^\s@]+", re.I),
    re.compile(r"[0-9]{1,3}(?:[.:-][0-9]{1,3}){3}(?:[:/][0-9]+)?|[0-9a-f]{0,4}(?::[0-9a-f]{0,4}){2,7}", re.I),
    re.compile(r"[0-9](?:[\x20./-]*[0-9]){11,18}"),
    re.compile(r"\(?[0-9](?:[\x20()./-]*[0-9]){6,14}"),
)


# ------------------------------------------------------------- inside one text

def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each at sign to the left and right: linear in the text, however long a run is."""
    last, at = 0, text.find("@")
    while at >= 0:
        start, end = at, at + 1
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = last = m.end()
            yield start, end
        at = text.find("@", end)


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Four parts at a time of every chain of numbers with single dots."""
    for chain in _DOTTED.finditer(text):
        parts = list(_NUMBER.finditer(text, chain.start(), chain.end()))
        for k in range(0, len(parts) - 3, 4):
            if all(len(v := p[0].lstrip("0")) < 4 and int(v or 0) <= 255 for p in parts[k:k + 4]):
                yield parts[k].start(), parts[k + 3].end()


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if k % 2 == 0 else 2 * v - 9 * (v > 4)
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed forms, by kind, then start; ends are exclusive."""
    return [(k, start, end) for k, find in enumerate((emails, ips, cards, phones)) for start, end in find(text)]


def marked_words(text: str) -> Iterator[tuple[int, int]]:
    """Words with a digit or an at sign (also spelt out in brackets), without punctuation at their ends; numeric words one space apart are one."""
    words: list[tuple[int, int]] = []
    last, numeric = 0, False
    for m in _MARKED.finditer(text):
        start, end = m.start(), m.end()
        while start > last and not text[start - 1].isspace():
            start -= 1
        before, numeric = numeric, _NUMERIC.fullmatch(text, start, end) is not None
        if before and numeric and start == last + 1 and text[last] == " ":
            words[-1] = (words[-1][0], end)
        else:
            words.append((start, end))
        last = end
    for start, end in words:
        keep = "+(" if ")" in text[start:end] else "+"
        while start < end and not (text[start].isalnum() or text[start] in keep):
            start += 1
        while end > start and not text[end - 1].isalnum():
            end -= 1
        if start < end:
            yield start, end


def patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a span: digits in them are one sign, and a pattern without any letter is none."""
    before = [_NUMBER.sub("#", w[-WORD:].lower()) for w in text[max(0, start - WINDOW):start].split()[-2:]]
    after = [_NUMBER.sub("#", w[:WORD].lower()) for w in text[end:end + WINDOW].split()[:2]]
    found = (("<", before), (">", after), ("<>", before[-1:] + ["_"] + after[:1]))
    return [f"{side} {' '.join(words)}" for side, words in found if any(c.isalpha() for w in words for c in w)]


def loose_kinds(word: str) -> int:
    """Kinds, as bits, that an instance may turn out to be."""
    return sum(1 << k for k, form in enumerate(_LOOSE) if form.fullmatch(word))


def instance(word: str) -> int:
    """Key of an instance: equal up to case."""
    return xxhash.xxh64_intdigest(word.lower().encode("utf-8", "surrogatepass")) - (1 << 63)


# -------------------------------------------------------------------- on Spark

_SPAN = "struct<kind:int,start:int,end:int>"
_SEEN = "struct<start:int,end:int,instance:bigint,known:int,loose:int,patterns:array<string>>"


def occurrences(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, base, seen)``: spans of the fixed forms, and every identifier with its context."""
    span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
    seen_type = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("instance", pa.int64()), ("known", pa.int32()),
                           ("loose", pa.int32()), ("patterns", pa.list_(pa.string()))])

    def one(text: str) -> tuple[list, list]:
        base = base_spans(text)
        if not base and _MARKED.search(text) is None:
            return [], []
        known: dict[tuple[int, int], int] = {}
        rest = text
        for kind, start, end in base:
            known[start, end] = known.get((start, end), 0) | 1 << kind
            rest = rest[:start] + " " * (end - start) + rest[end:]
        seen = [(*span, bits) for span, bits in known.items()] + [(*span, 0) for span in marked_words(rest)]
        rows = [{"start": start, "end": end, "instance": instance(text[start:end]), "known": bits,
                 "loose": 0 if bits else loose_kinds(text[start:end]), "patterns": patterns(text, start, end)} for start, end, bits in seen]
        return [{"kind": kind, "start": start, "end": end} for kind, start, end in base], rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([b for b, _ in found], pa.list_(span)),
                                              pa.array([s for _, s in found], pa.list_(seen_type))], names=["doc_id", "base", "seen"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, base array<{_SPAN}>, seen array<{_SEEN}>")


def pattern_graph(found: DataFrame) -> DataFrame:
    """``(pattern, instance, known, loose)``: every pair of a pattern and an instance once."""
    each = found.select(F.explode("seen").alias("s")).select("s.instance", "s.known", "s.loose", F.explode("s.patterns").alias("pattern"))
    return each.groupBy("pattern", "instance").agg(F.bit_or("known").alias("known"), F.bit_or("loose").alias("loose"))


def _per_kind(bits: Column) -> Column:
    return F.filter(F.array(*[F.lit(k) for k in range(len(KINDS))]), lambda k: F.getbit(bits, k) == 1)


def scored_patterns(graph: DataFrame, scores: DataFrame) -> DataFrame:
    """``(pattern, kind, support, share)`` of the patterns that count: known instances, and their share of all instances."""
    size = graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("size"))
    support = graph.select("pattern", "instance").join(scores, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("support"))
    return (support.where(F.col("support") >= MIN_SUPPORT).join(size, "pattern").withColumn("share", F.col("support") / F.col("size"))
            .where(F.col("share") >= MIN_SHARE).select("pattern", "kind", "support", "share"))


def scored_instances(graph: DataFrame, counted: DataFrame) -> DataFrame:
    """``(instance, kind, score)`` of instances not in a fixed form, from the patterns that count: one kind each, the best."""
    missed = F.sum(F.log1p(-F.lit(TRUST) * F.col("share")))
    score = (graph.where((F.col("known") == 0) & (F.col("loose") != 0)).join(counted, "pattern")
             .where(F.getbit("loose", F.col("kind")) == 1).groupBy("instance", "kind").agg((1 - F.exp(missed)).alias("score"))
             .where(F.col("score") >= MIN_SCORE))
    best = F.max(F.struct(F.col("score"), (-F.col("kind")).alias("k"))).alias("b")
    return score.groupBy("instance").agg(best).select("instance", (-F.col("b.k")).alias("kind"), F.col("b.score").alias("score"))


def bootstrapped(graph: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(patterns that count, instances found) after the given number of rounds."""
    seeds = (graph.where("known != 0").select("instance", F.explode(_per_kind(F.col("known"))).alias("kind")).distinct()
             .withColumn("score", F.lit(1.0)))
    scores, counted, found = seeds, None, None
    for n in range(rounds):
        counted = stored(scored_patterns(graph, scores), f"patterns{n}")
        found = stored(scored_instances(graph, counted), f"instances{n}")
        scores = seeds.unionByName(found)
    return counted, found


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added)`` for every row of ``docs``.

    The counts and the digest are of the fixed forms (``base_spans``); ``spans``
    lists ``kind:start:end`` of these and of the ``n_added`` identifiers found by
    context, by kind as in ``KINDS``, then start.  Positions are code points.
    Null and empty texts have none (the digest is that of the empty text).
    Repeated rows, rows of one id and null ids keep their rows; an instance that
    occurs often counts once.  Empty input gives no rows; extra columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    # the row numbers are written with the rows, so no recomputation can change them
    found = stored(occurrences(base).withColumn("row", F.monotonically_increasing_id()), "occurrences")
    graph = stored(pattern_graph(found), "pattern_graph")
    _, instances = bootstrapped(graph, rounds)
    added = (found.select("row", F.explode("seen").alias("s")).where((F.col("s.known") == 0) & (F.col("s.loose") != 0))
             .select("row", "s.start", "s.end", "s.instance").join(instances.select("instance", "kind"), "instance")
             .groupBy("row").agg(F.collect_list(F.struct(F.col("kind").cast("int").alias("kind"), "start", "end")).alias("added")))
    names = F.array(*[F.lit(k) for k in KINDS])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    extra = F.coalesce("added", F.array().cast(f"array<{_SPAN}>"))
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k))
    count = [of_kind(k).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return (found.select("row", "doc_id", "base").join(added, "row", "left")
            .select("doc_id", *count, F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
                    listed(F.array_sort(F.concat("base", extra))).alias("spans"), F.size(extra).cast("long").alias("n_added")))

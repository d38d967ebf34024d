"""Toxicity, quality, URL lists, HTML text, nearest neighbours, pipeline."""

import time
import zlib
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from batchtrail.llm import block_ann, html_extract, near_dedup, quality, queries, toxicity, url_filter
from batchtrail.llm.common import stored
from tests.conftest import SMALL
from tests.llm import cases
from tests.util import canon

MIDDLE = "/root/testdata/sf0.01"


# ---- toxicity

def test_held_out_texts_are_judged_well(spark):
    docs, labels = spark.read.parquet(f"{MIDDLE}/documents.parquet"), spark.read.parquet(f"{MIDDLE}/labels.parquet")
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").collect()
    assert {r.held_out for r in rows} == {True, False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in rows)
    right = [r.predicted == r.toxic for r in rows if r.held_out]
    assert sum(right) >= 0.9 * len(right) and not any(r.predicted for r in rows if not r.toxic)


def test_held_out_labels_are_not_learnt(spark, small_docs, small_labels):
    flipped = small_labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    plain = toxicity.toxicity(small_docs, small_labels).collect()
    assert sorted(plain) == sorted(toxicity.toxicity(small_docs, flipped).collect())


def test_toxicity_takes_odd_rows(spark):
    marks = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, None), (None, 1, 1), (6, 1, 1), (9, 0, 0)]
    for labels in (cases.labels(spark, marks), cases.labels(spark, [])):
        rows = toxicity.toxicity(cases.docs(spark), labels).collect()
        assert len(rows) == 13 and all(0 <= r.score <= 1 for r in rows)
        kept = toxicity.without_toxic(cases.docs(spark), labels)
        assert kept.columns == cases.docs(spark).columns and kept.count() <= 13
        assert toxicity.toxicity(cases.empty(spark), labels).count() == 0


def test_ngrams_stay_inside_a_text():
    row, bucket = toxicity.ngram_features(["abc", "", "ABC  def"])
    alone = [toxicity.ngram_features([t]) for t in ("abc", "", "ABC  def")]
    for k, (_, b) in enumerate(alone):
        assert sorted(bucket[row == k]) == sorted(b)
    assert set(alone[0][1]) & set(alone[2][1])  # case is folded


# ---- quality

def test_quality_separates_the_labels(spark):
    docs, labels = spark.read.parquet(f"{MIDDLE}/documents.parquet"), spark.read.parquet(f"{MIDDLE}/labels.parquet")
    rows = queries.op3_quality(spark, MIDDLE).join(labels, "doc_id").collect()
    assert sum(r.keep == bool(r.quality) for r in rows) >= 0.98 * len(rows)
    kept = quality.good_documents(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang"))
    assert kept.columns == docs.columns and kept.join(labels.where("quality = 1"), "doc_id").count() == labels.where("quality = 1").count()


def test_rates_equal_a_plain_computation(spark, small_docs, small_labels):
    rows = quality.with_quality(small_docs, small_labels, F.col("source"), F.concat_ws("/", "source", "lang")).collect()
    p = {r.doc_id: r.evidence for r in rows}
    host, path = {r.doc_id: r.source for r in rows}, {r.doc_id: (r.source, r.lang) for r in rows}
    rate = np.mean(list(p.values()))

    def groups(of):
        out = {}
        for i, g in of.items():
            out.setdefault(g, []).append(p[i])
        return out

    def strength(members, prior):
        n, k = sum(map(len, members.values())), len(members)
        within = max(sum(len(v) * np.var(v) for v in members.values()) / (n - k), 1e-12)
        outer = sum(len(v) * (np.mean(v) - prior(g)) ** 2 for g, v in members.items())
        between = (outer - (k - 1) * within) / (n - sum(len(v) ** 2 for v in members.values()) / n)
        return min(1e9, within / between) if between > 0 else 1e9

    hosts, paths = groups(host), groups(path)
    kh = strength(hosts, lambda g: rate)
    kp = strength(paths, lambda g: (sum(hosts[g[0]]) + kh * rate) / (len(hosts[g[0]]) + kh))
    for r in rows:
        h, q = hosts[r.source], paths[r.source, r.lang]
        m = (sum(h) - r.evidence + kh * rate) / (len(h) - 1 + kh)
        m = (sum(q) - r.evidence + kp * m) / (len(q) - 1 + kp)
        odds = sum(s * np.log(x / (1 - x)) for s, x in ((1, np.clip(r.evidence, 1e-9, 1 - 1e-9)), (1, m), (-1, rate)))
        assert r.quality_score == pytest.approx(1 / (1 + np.exp(-odds)), abs=1e-6)


def test_sparse_sites_shrink(spark):
    rows = [("a", 1000.0, 900.0), ("b", 1000.0, 500.0), ("c", 1.0, 0.0)]
    groups = spark.createDataFrame([(n, s, s * 0.9 + (n - s) * 0.0, 0.7) for _, n, s in rows], "n double, s double, ss double, prior double")
    k = quality.strength(groups)
    assert 0 < k < 100
    assert quality.strength(groups.limit(0)) == 1e9


def test_quality_takes_odd_rows(spark):
    for labels in (cases.labels(spark, [(1, 1, 0), (4, 0, 0), (6, 1, 1), (9, None, 0)]), cases.labels(spark, [])):
        rows = quality.with_quality(cases.docs(spark), labels, F.col("source"), F.col("lang"), out="q").collect()
        assert len(rows) == 13 and all(0 <= r.q <= 1 for r in rows)
        assert quality.good_documents(cases.empty(spark), labels, F.col("source"), F.col("lang")).count() == 0


# ---- URL lists

def at(text):
    return datetime.strptime(text, "%Y-%m-%d %H:%M")


def test_entries_active_at_fetch_time_decide(spark):
    entries = spark.createDataFrame([
        ("spam", "example.com", at("2024-01-10 00:00"), "add"), ("spam", "Example.com", at("2024-02-10 12:00"), "remove"),
        ("spam", "example.com", at("2024-03-01 00:00"), "add"), ("allow", "good.example.com", at("2024-01-01 00:00"), "add"),
        ("malware", "good.example.com/bad", at("2024-01-20 00:00"), "add"), ("allow", "tie.org", at("2024-01-01 00:00"), "add"),
        ("spam", "tie.org", at("2024-01-01 00:00"), "add"), ("spam", "same.org", at("2024-01-01 00:00"), "add"),
        ("spam", "same.org", at("2024-01-01 00:00"), "remove"), (None, "x.com", at("2024-01-01 00:00"), "add"),
        ("spam", None, at("2024-01-01 00:00"), "add"), ("spam", "x.com", None, "add")],
        "list string, pattern string, at timestamp, action string")
    asked = [
        (1, "http://a.EXAMPLE.com/x", at("2024-01-09 23:59"), "unlisted"), (2, "http://a.example.com/x", at("2024-01-10 00:00"), "blocked"),
        (3, "http://a.example.com/x", at("2024-02-10 12:00"), "unlisted"), (4, "https://u:p@example.com:8080?q", at("2024-06-01 00:00"), "blocked"),
        (5, "http://good.example.com/fine", at("2024-01-25 00:00"), "allowed"), (6, "http://good.example.com/bad/page", at("2024-01-25 00:00"), "blocked"),
        (7, "http://good.example.com/badly", at("2024-01-25 00:00"), "allowed"), (8, "//tie.org/", at("2024-05-05 05:05"), "allowed"),
        (9, "http://same.org", at("2024-05-05 05:05"), "unlisted"), (10, "no url", at("2024-05-05 05:05"), "unknown"),
        (11, None, at("2024-05-05 05:05"), "unknown"), (12, "http://example.com", None, "unknown"), (None, "http://example.com/", at("2024-01-15 00:00"), "blocked"),
        (4, "https://u:p@example.com:8080?q", at("2024-06-01 00:00"), "blocked"), (14, "http://notexample.com", at("2024-01-15 00:00"), "unlisted"),
        (15, "http://" + "a." * 40 + "example.com", at("2024-01-15 00:00"), "blocked"), (16, "", at("2024-01-15 00:00"), "unknown")]
    captures = spark.createDataFrame(asked, "page_id long, url string, fetched_at timestamp, want string").withColumn("label", F.lit(1))
    rows = url_filter.judge(captures, entries).collect()
    assert len(rows) == len(asked) and all(r.verdict == r.want for r in rows), [r for r in rows if r.verdict != r.want]
    assert url_filter.judge(captures.limit(0), entries).count() == 0
    assert {r.verdict for r in url_filter.judge(captures, entries.limit(0)).collect()} == {"unlisted", "unknown"}


def test_entries_match_at_any_depth(spark):
    deep = "a.b.c.d.e.example.com"
    entries = spark.createDataFrame([("spam", deep[2:], at("2024-01-01 00:00"), "add"), ("spam", "x.org/1/2/3/4/5/6", at("2024-01-01 00:00"), "add")],
                                    "list string, pattern string, at timestamp, action string")
    asked = [(1, f"http://{deep}/", "blocked"), (2, "http://z.d.e.example.com/", "unlisted"), (3, "http://x.org/1/2/3/4/5/6/7", "blocked"),
             (4, "http://x.org/1/2/3/4/5", "unlisted")]
    captures = spark.createDataFrame([(i, u, at("2024-05-05 05:05"), w) for i, u, w in asked], "page_id long, url string, fetched_at timestamp, want string")
    rows = url_filter.judge(captures, entries).collect()
    assert [(r.page_id, r.verdict) for r in rows if r.verdict != r.want] == [] and len(rows) == 4


@pytest.mark.parametrize("key", sorted(k for k, v in queries.ORACLE_SQL.items() if v))
def test_queries_equal_their_sql(spark, duck, key):
    assert queries.ORACLE_SQL[key] == entry.oracle_sql()[key]
    df = entry.queries()[key](spark, SMALL)
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(queries.ORACLE_SQL[key])
    assert got == canon([d[0] for d in cur.description], cur.fetchall())


# ---- HTML text

ARTICLE = "<h1>Ti&euml;tle  here</h1><p>First   <b>bold</b>\n paragraph of the article, long enough &amp; plain.<p>Short.</p><ul><li>item one<li>item two</ul>"
WANT = "Tiëtle here\nFirst bold paragraph of the article, long enough & plain.\nShort.\nitem one\nitem two"


@pytest.mark.parametrize("html", [
    f"<html><head><title>t</title><style>p{{}}</style><script>var a='<p>x</p>';</script></head><body><nav><a href=x>Menu</a></nav>"
    f"<div class='ad'>Buy it</div><article>{ARTICLE}</article><footer>&copy; all</footer></body></html>",
    f"<body><header>Site name</header><aside>Side links</aside><main>{ARTICLE}<form>Name <input></form><div id=comments><p>I like it very much, a long "
    f"comment that goes on and on for several words to be dense text</p></div></main></body>",
    f"<body><div class=menu>one two</div><div id='content'>{ARTICLE}</div><div class='cookie-notice'>We use cookies on this page for many long reasons "
    f"that nobody reads</div><div class=sidebar>Other things</div></body>",
    f"<article>{ARTICLE}<section class=comments><article class=comment>Reader says a lot of words here</article></section><footer>by me</footer></article>",
    ARTICLE])
def test_main_text_is_the_article(html):
    assert html_extract.main_text(html) == WANT


LONG_TEXT = "The long text of this page goes on for many words without any markup in between them, line after line of it. " * 6


@pytest.mark.parametrize("kind", ["main", "div", "section"])
def test_teaser_articles_do_not_displace_the_text(kind):
    teaser = "<article><h3>Related</h3><p>One line of a teaser that is as dense as the text itself is</p></article>"
    long_text = LONG_TEXT.strip()
    text = html_extract.main_text(f"<body><nav>Menu</nav><{kind}><div><h1>Head</h1><p>{LONG_TEXT}</p><p>{LONG_TEXT}</p></div>{teaser * 2}</{kind}></body>")
    assert text.startswith(f"Head\n{long_text}\n{long_text}")
    # an article that holds most of the text is still the region
    assert html_extract.main_text(f"<body><{kind}><article><p>{LONG_TEXT}</p></article><div>by line</div></{kind}></body>") == long_text


@pytest.mark.parametrize("page", [
    "<body><nav>Menu</nav><div id=post><div><p>{intro}</p></div><div><p>{body}</p><p>{body}</p></div></div></body>",
    "<body><section><p>{intro}</p></section><section><p>{body}</p><p>{body}</p></section></body>",
    "<body><table><tr><td>{intro}</td><td><p>{body}</p><p>{body}</p></td></tr></table></body>",
    "<body><main><div><p>{intro}</p></div><article><p>{body}</p><p>{body}</p></article></main></body>",
    "<body><div><p>{intro}</p></div><main><p>{body}</p><p>{body}</p></main></body>",
    "<div><p>{intro}</p></div><div><p>{body}</p><p>{body}</p></div>"])
def test_no_content_cluster_is_dropped(page):
    intro, body = LONG_TEXT[:len(LONG_TEXT) // 3].strip(), LONG_TEXT.strip()
    assert html_extract.main_text(page.format(intro=intro, body=body)) == f"{intro}\n{body}\n{body}"


def test_short_neighbours_outside_the_region_are_no_content():
    assert html_extract.main_text(f"<body><div>by line</div><article><p>{LONG_TEXT}</p><p>{LONG_TEXT}</p></article><div>links</div></body>") \
        == f"{LONG_TEXT.strip()}\n{LONG_TEXT.strip()}"


def test_clusters_are_runs_of_one_container():
    page = html_extract.parse_lines("<div><p>a<p>b<nav>n</nav><p>c<section><p>d<p>e</section></div>")
    lines = page.lines
    assert html_extract.clusters(lines, [1.0] * 6, 1.0) == [[0, 1], [3], [4, 5]]
    assert html_extract.clusters(lines, [1.0, 0.0, 1.0, 1.0, 0.0, 1.0], 1.0) == [[0], [3], [5]]


@pytest.mark.parametrize("odd", ["<![ foo ]>", "<![foo x]>", "<![>", "<![ foo", "<![", "<![!]>", "<![if x]>"])
def test_malformed_sections_are_comments(odd):
    text = html_extract.main_text(f"<nav>Menu</nav><article><p>One</p>{odd}<p>Two</p><script>x()</script><p>Three</p></article>")
    assert text.split("\n")[0] == "One" and text.split("\n")[-1] == "Three" and text.count("One") == 1
    assert "<" not in text and "x()" not in text and "Menu" not in text
    assert text == "One\nTwo\nThree" or ">" not in odd  # an open one ends with the next tag
    assert html_extract.main_text(f"<article><p>One</p>{odd}").startswith("One")


@pytest.mark.parametrize("wrapper", ['div class="content has-sidebar"', 'div class="layout no-sidebar"', 'div class="post comments-open"', 'div class="with-ads"',
                                     'form id="aspnetForm"', 'div class="widget"', 'section class="modal-free page"'])
def test_a_wrapper_of_the_page_is_no_furniture(wrapper):
    page = f"<body><{wrapper}><nav>Menu</nav><div class=sidebar><p>Side text of some length, and more of it.</p></div>" \
           f"<div><p>{LONG_TEXT}</p><p>{LONG_TEXT}</p></div><div class='comments'><p>{LONG_TEXT}</p></div><footer>Foot</footer></{wrapper.split()[0]}></body>"
    want = " ".join(LONG_TEXT.split())
    assert html_extract.main_text(page) == f"{want}\n{want}"


def test_a_form_around_the_article_and_the_main_element():
    want = " ".join(LONG_TEXT.split())
    assert html_extract.main_text(f"<p>top</p><form><article><p>{LONG_TEXT}</p></article><aside>x</aside></form>").endswith(want)
    assert html_extract.main_text(f"<div class=modal><main><p>{LONG_TEXT}</p></main></div><p>z</p>").startswith(want)
    assert LONG_TEXT not in html_extract.main_text(f"<article><p>{LONG_TEXT[:200]}</p></article><form><p>{LONG_TEXT}</p><input></form>")


def test_furniture_inside_a_line_does_not_part_it():
    line = "<p>See <label>this</label> and <button>that</button> <span class=share>Share</span>word<script>x()</script>s, <b>all</b>.</p>"
    assert html_extract.main_text(f"<article>{line}<p>Next</p></article>") == "See and words, all.\nNext"
    assert html_extract.main_text("<article><p>a <button><div>b</div></button> c</p><p>d</p></article>").replace("\n", " ") == "a c d"
    assert html_extract.main_text("<head><title>T</title><body><p>text without a closed head</p>") == "text without a closed head"


def test_deep_and_unclosed_pages_take_linear_time():
    start = time.time()
    for part in ("<div>x ", "<div class=a><p>some text of a line", "<ul><li>y", "<form><b>z", "<span>", "</p><td>q", "<main><article>t "):
        html_extract.main_text(part * (1_000_000 // len(part)))
    assert time.time() - start < 90


def test_html_takes_odd_pages(spark):
    pages = spark.createDataFrame([(1, "u", None, "old"), (2, "u", "", "old"), (2, "u", "", "old"), (None, None, "plain words", "old"), (5, "u", "<p>", "old"),
                                   (6, "u", "<![if x]><p>kept</p>", "old"), (7, "u", "<b>a<i>b</b>c</i> &#x41;&nbsp;&bogus;", "old"),
                                   (8, "u", "<div>" * 3000 + "deep" + "</div>" * 10, "old"), (9, "u", "<nav>only a menu</nav>", "old"),
                                   (10, "u", "<p>" + "word " * 200_000 + "</p>", "old")], "page_id long, url string, html string, text string")
    rows = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert html_extract.extract(pages).count() == 10 and html_extract.extract(pages).columns == pages.columns
    assert rows[1] == rows[2] == rows[5] == rows[9] == "" and rows[None] == "plain words" and "kept" in rows[6] and rows[7] == "abc A &bogus;"
    assert rows[8] == "deep" and len(rows[10]) == 999_999
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_given_pages(spark):
    import html
    import re
    for r in html_extract.extract(spark.read.parquet(f"{SMALL}/pages.parquet")).collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?p>|</?h1>", body)]
        assert r.text == "\n".join(b for b in blocks if b)


# ---- nearest neighbours

def brute_nearest(rows, k):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = []
    for q in sorted({i for i, _ in good if i % 100 == 0}):
        best = {}
        for i, v in good:
            for j, w in good:
                if i == q and j != q and len(v) == len(w):
                    d = float(block_ann.exact_distance(np.array([v]), np.array([w]))[0])
                    best[j] = min(d, best.get(j, np.inf))
        out += [(q, n + 1, j, d) for n, (d, j) in enumerate(sorted((d, j) for j, d in best.items())[:k])]
    return out


@pytest.mark.parametrize("block", [7, 4096])
def test_nearest_equal_brute_force(spark, block):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(20, 8))
    rows = [(i, (base[i % 20] + rng.normal(size=8) * (0.0 if i % 7 == 0 else 1e-3)).astype(np.float32).astype(float).tolist()) for i in range(300)]
    rows += [(300, rows[0][1]), (300, rows[0][1]), (400, None), (500, []), (600, [0.0] * 8), (700, [1.0, None] * 4), (800, [float("nan")] * 8),
             (900, [float("inf")] * 8), (None, rows[0][1]), (1000, [1.0, 2.0]), (1001, [2.0, 2.0]), (301, [1e-320] + [0.0] * 7), (1100, [3.0])]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, rank int, score double")
    got = sorted(tuple(r) for r in block_ann.nearest(df, F.col("vec_id") % 100 == 0, candidate_block=block, query_block=2).collect())
    assert got == brute_nearest(rows, 10)
    assert block_ann.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_an_id_with_several_vectors_takes_one_place(spark):
    rng = np.random.default_rng(6)
    at = rng.normal(size=8)
    # ten near vectors of one id before all others, a candidate and a query that hold many of the rows
    rows = [(0, at.tolist())] + [(1, (at + rng.normal(size=8) * 1e-3).tolist()) for _ in range(10)]
    rows += [(i, (at + rng.normal(size=8) * 0.1).tolist()) for i in range(2, 90)]
    rows += [(95, (at + rng.normal(size=8) * 0.2).tolist()) for _ in range(60)] + [(100, (at + rng.normal(size=8) * 0.3).tolist()) for _ in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block in (16, 4096):
        got = sorted(tuple(r) for r in block_ann.nearest(df, F.col("vec_id") % 100 == 0, candidate_block=block, query_block=8).collect())
        assert got == brute_nearest(rows, 10)
    qid, q = np.zeros(1, dtype=np.int64), at[None, :]
    found = block_ann.nearest_in_tile(qid, q, np.array([i for i, _ in rows[1:]]), np.array([v for _, v in rows[1:]]), 10)
    assert len(set(found[1])) == len(found[1]) == 10


def test_bounds_hold():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(40, 64)) * 10.0 ** rng.integers(-3, 3, (40, 1)), rng.normal(size=(50, 64))
    lower, upper = block_ann.tile_bounds(block_ann.quantized(x), block_ann.quantized(y))
    exact = np.sqrt(((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2))
    assert (lower <= exact + 1e-12).all() and (exact <= upper + 1e-12).all()


# ---- pipeline

def test_stages_keep_the_columns_and_pass_on_what_they_keep(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, seen, SMALL), "test")
        assert out.columns == columns and not Counter(out.collect()) - Counter(seen.collect())
        seen = out
    ids = sorted(r.doc_id for r in seen.collect())
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SMALL).collect()) == ids
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    clean = docs.join(labels.where("quality = 1 and toxic = 0"), "doc_id", "left_semi")
    classes = near_dedup.near_duplicate_classes(docs)
    lost = clean.join(seen, "doc_id", "left_anti").join(classes, "doc_id").where("doc_id = class_id")
    assert lost.count() <= 1  # clean documents go only as copies


def test_stages_take_odd_rows(spark):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (cases.docs(spark), cases.empty(spark)):
            out = stage(spark, docs, SMALL)
            assert out.count() <= docs.count()

"""Sharding, mixing, quality rules, metric search and HTML extraction against brute force and edge cases."""

import random
import re
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pytest

from glossa.llm import common, html_extract, metric_search, mixing, quality, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# ---- sharding


@pytest.mark.parametrize("n", [1, 2, 3, 10, 16, 17, 1000, 12345])
def test_permutation(n):
    p = sharding.permute(np.arange(n), n)
    assert sorted(p.tolist()) == list(range(n))
    assert sharding.invert(p, n).tolist() == list(range(n))
    assert n < 100 or (p != sharding.permute(np.arange(n), n, seed=1)).any()


def test_permutation_of_a_huge_range_is_computed_row_by_row():
    n = 10**13 + 7
    rows = np.random.default_rng(1).integers(0, n, 2000)
    p = sharding.permute(rows, n)
    assert (p < n).all() and (sharding.invert(p, n) == rows).all()
    assert abs(np.corrcoef(rows, p)[0, 1]) < 0.1


def test_shards(spark):
    rows = [(i, "t" * (i % 5), None, "s", 0) for i in range(300)] + [(5, "same", None, "s", 0)] * 150 + [(None, "n", None, None, 0), (400, None, None, None, 0), (401, "é", None, None, 0)]
    df = spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "shard").repartition(5)
    got = sharding.shard(df).collect()
    counts = Counter(r.shard for r in got)
    assert len(got) == len(rows) and set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    place = lambda rs: Counter((r.doc_id, r.size, r.shard, r.slot) for r in rs)
    assert place(got) == place(sharding.shard(df.repartition(3)).collect())
    n = len(rows)
    order = {r.row_no: r for r in got}
    for r in got[:50]:
        assert order[int(sharding.invert(np.array([r.slot * 16 + r.shard]), n)[0])] is r
    assert sharding.shard(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sharding.shard(df, 0)


# ---- mixing


def test_mix(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(1, 40), None, rng.choice(["a", "a", "a", "b", "c", "d", None]), 0) for i in range(3000)]
    rows += [(9000, None, None, "empty", 0), (None, "x y", None, "a", 0), (7, "w w", None, "b", 0), (7, "w w", None, "b", 0)]
    df = spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "target").repartition(4)
    got = mixing.mix(df).collect()
    size = Counter()
    for _, t, _, s, _ in rows:
        size[s] += len((t or "").split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(size.values())
    while True:  # pour out, cap, pour the rest again
        lam = left / sum(w[s] for s in free)
        full = {s for s in free if w[s] * lam >= 2 * size[s]}
        if not full:
            break
        for s in full:
            target[s] = 2.0 * size[s]
            left -= target[s]
        free -= full
    target |= {s: w[s] * lam for s in free}
    assert len(got) == len(rows) and all(r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source] and r.taken <= 2 * r.size for r in got)
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.08 * target[s] for s in names)
    key = lambda r: (str(r.doc_id), r.size, r.copies)
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix(df.repartition(7)).collect()))
    out = mixing.expand(df)
    assert out.columns == df.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({i: n for i in {r.doc_id for r in got} if (n := sum(r.copies for r in got if r.doc_id == i))})
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.expand(df.limit(0)).count() == 0
    odd = df.selectExpr("*", "1 AS _rate", "2 AS _copy", "3 AS _key", "4 AS _salt")
    assert mixing.expand(odd).columns == odd.columns and mixing.expand(odd).count() == out.count()


def test_sized_join_with_salts_equals_the_broadcast_one(spark):
    left = spark.createDataFrame([(i, ["hot", "hot", "b", None, "nowhere"][i % 5]) for i in range(200)], "i int, k string")
    right = spark.createDataFrame([("hot", 1), ("b", 2), (None, 3)], "k string, v int")
    a, b = (sorted(map(str, common.sized_join(left, right, "k", "left", 64, limit).collect())) for limit in (1 << 20, 1))
    assert a == b and len(a) == 200


# ---- quality


def brute_quality(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines, seen, dup = (t or "").split("\n"), set(), 0
    for x in lines:
        if re.findall(r"[^\x20\x09-\x0D]+", x):
            dup += x in seen
            seen.add(x)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    cover = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(cover)


def test_quality_figures():
    rng = random.Random(2)
    for _ in range(600):
        t = "".join(rng.choice(["a ", "b ", "c ", "é", "#", "\n", "\t", "\x1c", " ", ". ", "|"]) for _ in range(rng.randrange(60)))
        j = quality.judge(t)
        assert (j["n_words"], j["word_chars"], j["n_symbols"], j["n_dup_lines"], j["n_repeat_words"]) == brute_quality(t), repr(t)
        assert j["base_failed"] == (j["n_words"] < 50 or 100 * j["n_repeat_words"] > 50 * j["n_words"])


def test_lines_and_verdicts(spark):
    prose = " ".join(f"word{i}" for i in range(60)) + "."
    assert [quality.line_fails(x, len(x.split())) for x in (prose, "Home", "a | b | c | d", "no end here at all", "We use cookies. OK.", "THIS IS ALL LOUD AND BAD YES OH NO.", "", "ok then.")] == ["", "navigation", "symbols", "punctuation", "boilerplate", "shouting", "", ""]
    nav = "\n".join(["Home", "About us", "Contact"] * 5)
    assert quality.judge(prose + "\n" + nav)["kept"] and quality.judge(prose + "\n" + nav)["cleaned"] == prose
    assert not quality.judge(prose + "\n" + nav * 20)["kept"]
    rows = [(1, prose, None, "s", 1), (2, None, None, "s", 1), (3, "", None, "s", 1), (3, prose.replace(" ", "### "), None, "s", 1), (None, prose, None, "s", 1), (4, prose + "\nx" * 50_000, None, "s", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "kept")
    got = sorted((str(r.doc_id), r.kept, r.base_failed) for r in quality.assess(df).collect())
    assert got == [("1", True, False), ("2", False, True), ("3", False, False), ("3", False, True), ("4", False, True), ("None", True, False)]
    kept = quality.keep_clean(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "None"]
    assert {r.doc_id: r.cleaned for r in quality.assess(df, True).collect()}[1] == prose and quality.assess(df.limit(0)).count() == 0


# ---- metric search


def brute_top(rows, k, every):
    v = {}
    own = [(i, np.floor(256 * np.array(x, np.float64)).astype(np.int64)) for i, x in rows if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)]
    for i, q in own:
        if i % every == 0:
            s = sorted((-int(q @ y), j) for j, y in own if j != i and len(y) == len(q))[:k]
            v[i] = [(r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return v


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] + rng.normal(size=8) * rng.choice([0.01, 1.0])]) for i in range(900)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)]  # a hot spot of copies, which tie
    rows += [(2000, None), (2001, [1.0, None] + [0.0] * 6), (2002, [float("nan")] * 8), (2003, [float("inf")] + [0.0] * 7), (2010, [1.0, 2.0]), (2020, [3.0, 1.0]), (None, [1.0] * 8), (2030, [0.0] * 8)]
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "vec_id long, embedding array<double>, score int").repartition(4)
    for how in ({"page_rows": 16, "regions": 5, "query_block": 7}, {}):
        got = {}
        for r in metric_search.top_k(df, 5, 10, **how).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        assert {q: sorted(x) for q, x in got.items()} == {q: x for q, x in brute_top(rows, 5, 10).items() if x}
    few = metric_search.top_k(df.where("vec_id IN (2010, 2020)"), 5, 10)
    assert sorted(map(tuple, few.select("query_id", "rank", "vec_id").collect())) == [(2010, 1, 2020), (2020, 1, 2010)]
    assert metric_search.top_k(df.limit(0)).count() == 0 and metric_search.top_k(df.where("vec_id = 3")).count() == 0


def clustered_vectors(n, seed=4):
    rng = np.random.default_rng(seed)
    return np.floor(256 * (rng.normal(size=(8, 6))[np.arange(n) % 8] * 3 + rng.normal(size=(n, 6)) * 0.02)).astype(np.int64)


def best_of(v, q, k=5):
    return sorted((-int(v[q] @ v[j]), j) for j in range(len(v)) if j != q)[:k]


def test_pages_are_skipped_where_data_are_clustered():
    v = clustered_vectors(4000)
    m2 = float((v * v).sum(1).max())
    hub = metric_search._lift(v[:1].astype(float), m2)[0]
    count = {}
    i, vec, score = metric_search.search_pages(metric_search.build_pages(np.arange(4000), v, m2, 64, hub), np.arange(8), v[:8], m2, 5, hub, None, count)
    assert count["scored"] < 0.6 * 8 * 4000
    for q in range(8):
        assert sorted((-int(s), int(j)) for a, j, s in zip(i, vec, score) if a == q) == best_of(v, q)


def test_regions_beyond_the_reach_are_skipped():
    v = clustered_vectors(4000)
    m2 = float((v * v).sum(1).max())
    top = metric_search.Regions.fit(v[:400].tolist(), m2, 40, 1)
    region, far = top.assign(pd.Series(list(v)), True)
    top.radii[6] = np.array([far[region == (6 << 20) + i].max(initial=-np.inf) for i in range(len(top.hubs[6]))])
    q = v[:80]
    reach = np.array([np.sqrt(max(float(x @ x) + m2 + 2 * best_of(v, i)[-1][0], 0)) for i, x in enumerate(q)])
    near = top.within(pd.Series(list(q)), reach)
    assert sum(map(len, near)) < 0.7 * len(q) * len(top.hubs[6])
    for i in range(len(q)):  # and no answer lies in one that is
        assert {int(region[j]) for _, j in best_of(v, i)} <= set(near[i])


def test_products_beyond_floating_point(spark):
    rows = [(0, [8000001.0, 8000003.0]), (50, [8000000.0, 8000004.0]), (1, [8000002.0, 8000002.0]), (2, [-8000001.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = {i: [int(256 * c) for c in x] for i, x in rows}
    want = {q: sorted((-sum(a * b for a, b in zip(v[q], v[j])), j) for j in v if j != q) for q in (0, 50)}
    got = {}
    for r in metric_search.top_k(df).collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert {q: sorted(x) for q, x in got.items()} == want
    with pytest.raises(ValueError, match="exceed"):
        metric_search.top_k(spark.createDataFrame([(0, [1e9, 1e9]), (1, [1e300, 0.0])], df.schema))


def test_vectors_of_lengths_that_the_sample_lacks(spark):
    rng = random.Random(6)
    rows = [(i, [rng.random() for _ in range(1 + i % 40)]) for i in range(800)]
    df = spark.createDataFrame([(i, x) for i, x in rows], "vec_id long, embedding array<double>")
    got = {}
    for r in metric_search.top_k(df, 5, 10, sample_rows=10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert {q: sorted(x) for q, x in got.items()} == {q: x for q, x in brute_top(rows, 5, 10).items() if x}


# ---- HTML


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="no-sidebar"><header><h1>Site</h1><nav><a href="/">Home</a></nav></header>
<div class="cookie-notice">We use cookies on this site, and more of them on others.</div><div class="wrap">%s<aside>An aside that is long enough to look like a paragraph.</aside>
<form><label>Your mail, please, so that we can write to you</label></form><section id="comments"><p>I have read this article with great interest, thank you.</p></section></div>
<footer>&copy; someone</footer></body></html>"""
BODY = "<h1>Title &amp; more</h1><p>First  paragraph,\n long enough.<p>Second <b>bo</b>ld &lt;x&gt; one, also long enough.<br>Third.<script>no()</script><!-- no --><div class='share-links'>Share</div><p class=ad>Buy</p><ul><li>One</li><li>Two</li></ul>"
WANT = "Title & more First paragraph, long enough. Second bold <x> one, also long enough. Third. One Two"


@pytest.mark.parametrize("container", ["<article>%s</article>", "<main>%s</main>", '<div class="post-content">%s</div>', '<div id="entry-1">%s</div>', '<div role="main">%s</div>'])
def test_main_text(container):
    assert html_extract.extract_one(PAGE % (container % BODY)) == WANT


@pytest.mark.parametrize("wrapper", ['div class="overflow-hidden"', 'div class="elementor-widget"', 'section class="content-with-sidebar"', 'div class="modal-open page"', 'div class="hidden-xs"', 'div class="promo"', 'div class="related-wrap"'])
def test_a_wrapper_of_the_article_is_not_junk(wrapper):
    assert html_extract.extract_one(PAGE % f"<{wrapper}><article>{BODY}</article></{wrapper.split()[0]}>") == WANT


def test_junk_by_class_stays_out_beside_an_article():
    story = "The story of the day is told here, in a few words."
    for junk in ("comments", "related-posts", "cookie-consent"):
        assert html_extract.extract_one(f'<div><p>{story}</p><div class="{junk}"><p>{"It is longer than what it stands beside. " * 9}</p></div></div>') == story
    for junk in ("widget", "hidden", "sidebar-left"):
        assert html_extract.extract_one(f'<div><p>{story}</p><div class="{junk}"><p>It is shorter than what it stands by.</p></div></div>') == story


def test_short_blocks_are_kept():
    intro = "This is how it begins, with a paragraph that is long enough to be taken for running text by all means."
    items = "".join(f"<li>Item of number {i:04}</li>" for i in range(30))
    plain = " ".join(f"Item of number {i:04}" for i in range(30))
    links = re.sub("<li>(.*?)</li>", r"<li><a href=x>\1</a></li>", items)
    for h, want in (
        ('<article><p>Sold out.</p></article><div id="root"></div>', "Sold out."),
        ("<div>Sold out</div><div>Back soon</div>", "Sold out Back soon"),
        (f"<div><div><p>{intro}</p></div><div><ul>{items}</ul></div></div>", f"{intro} {plain}"),
        (f"<div><div><p>{intro}</p></div><ul>{items}</ul></div>", f"{intro} {plain}"),
        (f"<div><div><div>{intro}</div></div><div>By Ann</div></div><div>{items.replace('li>', 'p>')}</div>", f"{intro} By Ann {plain}"),
        (f"<div><div><p>{intro}</p></div><div><ul>{links}</ul></div></div>", intro),
    ):
        assert html_extract.extract_one(h) == want, h
    assert html_extract.extract_one(f'<div class="a"><div class="b"><p>{intro}</p></div><ul>{items}</ul></div>', ["html>div.a>div.b"]) == f"{intro} {plain}"


def test_formulas_and_fallback_text_are_kept():
    for h, want in (
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> holds", "so x=1 holds"),
        ("<p>a <object data=x><p>the text instead</p></object>b", "a the text instead b"),
        ("<p>a <noscript>the text instead</noscript> b", "a the text instead b"),
        ("<p>a <svg> b <select> c <template> d", "a b c d"),
        ("<p>a <svg><text>no</text></svg> b <script> c", "a b"),
    ):
        assert html_extract.extract_one(h) == want, h
    assert len(html_extract.extract_one("<svg>" * 100_000 + "x")) == 1


def test_broken_pages():
    for h, want in ((None, ""), ("", ""), ("plain text", "plain text"), ("a < b", "a < b"), ("<p>x", "x"), ("<p>x<p", "x"), ("x <!-- open", "x"), ("<div>", ""), ("&amp;&am", "&&am"), ("<script>x", ""), ("</div></p>x", "x")):
        assert html_extract.extract_one(h) == want, h
    assert len(html_extract.extract_one("<div>" * 5000 + "x")) == 1
    assert html_extract.extract_one("<p>" + "word " * 300_000 + "</p>") == ("word " * 300_000).strip()


def test_hosts_agree_on_a_path(spark):
    """A page whose longest container is a link-free digression follows the path that its host elected."""
    usual = PAGE % '<div class="left">%s</div><div class="right-9">%s</div>'
    text = "The story of the day is told here at some length, and it goes on."
    rows = [(i, f"https://Example.org:80/{i}", usual % ("short", f"<p>{text} {i}</p>"), "x") for i in range(20)]
    rows.append((20, "https://example.org/20", usual % ("<p>It is a digression and not the story.</p>", f"<p>{text}</p>"), "x"))
    rows += [(21, None, "<p>alone</p>", "x"), (22, "https://other.org", None, "x"), (None, "https://other.org", "", "x"), (20, "https://example.org/20", "<p>again</p>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    got = [(r.page_id, r.text) for r in html_extract.extract(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [*((i, f"{text} {i}") for i in range(20)), (20, text), (21, "alone"), (22, ""), (None, ""), (20, "again")]))
    assert html_extract.extract(df).columns == ["page_id", "url", "text", "n_chars"] and html_extract.extract(df.limit(0)).count() == 0


class Brute(HTMLParser):
    """The blocks of the article by the standard library's parser: an independent version for pages whose junk is marked plainly."""

    BLOCK = frozenset("p h1 h2 h3 ul ol li div section blockquote article aside nav footer header form table tr td th pre figure figcaption br hr".split())
    VOID = frozenset("br hr img".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.blocks, self.text = [], [], []

    def flush(self):
        if s := " ".join("".join(self.text).split()):
            self.blocks.append(s)
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCK:
            self.flush()
        if tag not in self.VOID:
            self.stack.append((tag, dict(attrs).get("class") or ""))

    def handle_endtag(self, tag):
        if tag in self.BLOCK:
            self.flush()
        while self.stack and self.stack.pop()[0] != tag:
            pass

    def handle_data(self, data):
        tags = {t for t, _ in self.stack}
        if "article" in tags and not tags & {"script", "style", "aside", "nav", "footer", "form"} and not any(c in ("share-links", "ad", "comments", "related-posts") for _, c in self.stack):
            self.text.append(data)


def random_page(rng):
    word = lambda: rng.choice(["alpha", "béta", "&amp;", "g&eacute;n", "x &lt; y", "&#8212;", "del\nta", "&nbsp;", "o<b>me</b>ga", "<i>kap</i>pa", "<a href='/x'>rho</a>", "<!-- no -->", "<span title=\"class=ad\">tau</span>", "1 < 2", "AT&T"])
    text = lambda n: " ".join(["Sentences of running text, long enough."] + [word() for _ in range(rng.randrange(1, n))])

    def block(depth):
        kind = rng.choice(["p", "p", "p", "h2", "ul", "quote", "div", "junk", "script", "named"])
        if kind in ("p", "h2"):
            return f"<{kind}>{text(12)}</{kind}>"
        if kind == "ul":
            return "<ul>" + "".join(f"<li>{word()}</li>" for _ in range(rng.randrange(1, 5))) + "</ul>"
        if kind == "quote":
            return f"<blockquote><p>{text(8)}</p></blockquote>"
        if kind == "div" and depth < 5:
            return f"<div class='part-{rng.randrange(9)}' data-hidden='true' data-role=\"menu\">{''.join(block(depth + 1) for _ in range(rng.randrange(1, 4)))}</div>"
        if kind == "junk":
            return rng.choice(["<aside><p>%s</p></aside>", "<div class='share-links'><a href=/>%s</a></div>", "<div class=ad>%s</div>", "<nav><a href=/>%s</a></nav>", "<form><p>%s</p></form>", "<div class='related-posts'><a href=/>%s</a></div>"]) % text(4)
        if kind == "script":
            return "<script>var a = '<p>no</p>';</script>"
        name = rng.choice(["share-price", "side-effects", "related-work", "search-algorithms", "widget-factory", "overflow-hidden"])
        return f"<div class='{name}'><p>{text(10)}</p></div>"

    body = "".join(block(0) for _ in range(rng.randrange(3, 9)))
    return f"<html><head><title>T</title></head><body><nav><a href=/>Home</a> <a href=/a>About</a></nav><article><h1>{text(3)}</h1><p>{text(30)}</p>{body}</article><footer>Some footer text, all rights reserved.</footer></body></html>"


def test_extraction_equals_a_brute_force_version():
    rng = random.Random(21)
    for _ in range(400):
        page = random_page(rng)
        b = Brute()
        b.feed(page)
        b.close()
        b.flush()
        assert html_extract.extract_one(page) == " ".join(b.blocks), page


@pytest.mark.parametrize("name", ["share-price", "side-effects", "related-work", "search-algorithms", "widget-factory"])
def test_classes_that_begin_like_junk(name):
    page = f"<body><article><p>{'A first paragraph of running text. ' * 9}</p><div class='{name}'><p>And a part of the same article.</p></div></article></body>"
    assert html_extract.extract_one(page).endswith("And a part of the same article.")


def test_stray_tags_and_depth_take_linear_time():
    import time

    body = "<p>" + "A paragraph of running text. " * 20 + "</p>"
    for page in ("<div>" * 20_000 + body + "</section>" * 20_000, "<div class=a>" * 20_000 + body, "<p><b>" * 20_000 + body + "</i></article></td>" * 20_000):
        start = time.process_time()
        assert "A paragraph of running text." in html_extract.extract_one(page)
        assert time.process_time() - start < 8
    deep = [html_extract.Page("<div>" * 100 + f"<div class={c}>" + body).paths[-1] for c in "ab"]
    assert deep[0] != deep[1] and max(map(len, deep)) < 40

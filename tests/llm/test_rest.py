from __future__ import annotations

import os
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from driftline.llm import common, decontaminate, embedding_dedup, html_text, mixing, queries
from driftline.llm.common import table

from . import plain

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS FROM '{SF}/{f}'")
    df, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE_SQL[name])
    names = sorted(df.columns)
    at = [want.columns.index(c) for c in names]
    assert sorted(repr(tuple(r[c] for c in names)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_mixing(spark):
    r = random.Random(4)
    rows = [(i, "w " * r.randint(0, 40), "ab"[i % 2] if i % 9 else None) for i in range(300)] + [(1, "x y", "c"), (1, "x y", "c"), (None, None, None), (5, "", "empty")]
    df = spark.createDataFrame([(*x, 7, "keep") for x in rows], "doc_id long, text string, source string, size int, _size string")
    report = mixing.mixing_report(df).collect()
    assert len(report) == len(rows)
    total = sum(x.size for x in report)
    by_source = defaultdict(list)
    for x in report:
        by_source[x.source_size, round(x.target, 6)].append(x)
    assert abs(sum(k[1] for k in by_source) - 1.5 * total) < 1e-3
    for (size, target), own in by_source.items():
        assert target <= 2 * size + 1e-9 and abs(sum(x.taken for x in own) - target) <= max(x.size for x in own)
    assert all(x.taken in (0, x.size, 2 * x.size) for x in report)
    again = mixing.mixing_report(df.repartition(7)).collect()
    assert sorted(map(str, report)) == sorted(map(str, again))
    out = mixing.mixed(df)
    assert out.columns == df.columns and {x._size for x in out.collect()} == {"keep"}
    assert sum(len((x.text or "").split()) for x in out.collect()) == sum(x.taken for x in report)
    assert mixing.mixing_report(df.limit(0)).count() == 0 and mixing.mixed(df.limit(0)).count() == 0


def test_targets(spark):
    def waterfill(sizes, weights):
        left, open_, out = 1.5 * sum(sizes), set(range(len(sizes))), {}
        while open_:
            w = sum(weights[i] for i in open_)
            full = {i for i in open_ if left * weights[i] / w > 2 * sizes[i]}
            if not full:
                return [out.get(i, left * weights[i] / w) for i in range(len(sizes))]
            for i in full:
                out[i] = 2.0 * sizes[i]
            left, open_ = left - sum(2 * sizes[i] for i in full), open_ - full
        return [out[i] for i in range(len(sizes))]

    r = random.Random(8)
    for n in (1, 2, 3, 7, 12):
        sizes = [r.choice([0, 1, 10, 1000, 50]) for _ in range(n)]
        df = spark.createDataFrame([(f"s{i:02}", s) for i, s in enumerate(sizes)], "source string, size long")
        got = [x.target for x in mixing.source_targets(df).orderBy("source").collect()]
        assert np.allclose(got, waterfill(sizes, [mixing.WEIGHTS[i % 3] for i in range(n)]))


def test_decontamination(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 3)))
    items = {i: " ".join(word() for _ in range(r.choice([1, 3, 5, 8, 20, 60, 150]))) for i in range(60)} | {90: None, 91: " "}
    docs = {}
    for i in range(150):
        w = [word() for _ in range(r.randint(0, 400))]
        if i % 3 == 0:
            part = items[r.randrange(60)].split()
            for _ in range(i % 9 // 3):
                part[r.randrange(len(part))] = word()
            at = r.randint(0, len(w))
            w[at:at] = [x.upper() for x in part]
        docs[i] = " ".join(w)
    docs |= {200: None, 201: ""}
    df = spark.createDataFrame([(i, t, "s") for i, t in docs.items()] + [(None, docs[0], "s")], "doc_id long, text string, score string")
    bench = spark.createDataFrame(list(items.items()) + [(None, "a b")], "item_id long, text string")
    got = {(x.doc_id, x.item_id): (x.n_item, x.n_shared) for x in decontaminate.contaminated_pairs(df, bench).collect() if x.doc_id is not None}
    want = {}
    for i, t in docs.items():
        for j, text in items.items():
            w = plain.words(text)
            if w:
                k = min(5, len(w))
                own = plain.shingles(text, k)
                shared = len(own & plain.shingles(t, k)) if len(plain.words(t)) >= k else 0
                if 100 * shared >= 80 * len(own):
                    want[i, j] = (len(own), shared)
    assert got == want and len(want) > 40
    clean = decontaminate.drop_contaminated(df, bench)
    assert clean.columns == df.columns
    assert {x.doc_id for x in clean.collect()} - {None} == set(docs) - {i for i, _ in want}
    assert decontaminate.contaminated_pairs(df.limit(0), bench).count() == 0
    assert decontaminate.contaminated_pairs(df, bench.limit(0)).count() == 0


def test_wand_finds_all(spark):
    r = random.Random(2)
    texts = [" ".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 12))) for _ in range(40)] + ["a b c d", "q", " "]
    (path,) = decontaminate.indexes(spark.createDataFrame(list(enumerate(texts)), "item_id long, text string"))
    index = decontaminate._read(path)
    assert sorted(index.ids) == list(range(42))
    dense = np.zeros((len(index.dense_of), len(index.ids)))
    for t in range(len(dense)):
        a, b = index.posts[index.lists[t]], index.posts[index.lists[t + 1]]
        dense[t, index.items[a:b]] = index.impacts[a:b]
    assert np.allclose(dense.sum(axis=0), 1) and {-1} < set(index.dense_of.tolist())
    for _ in range(30):
        terms = np.array(sorted(r.sample(range(len(dense)), 6)))
        got = dict(decontaminate.block_max_wand(index, terms, np.arange(index.blocks), 0.4))
        score = dense[terms].sum(axis=0)
        assert set(got) == set(np.flatnonzero(score >= 0.4).tolist())
        assert all(abs(score[i] - s) < 1e-9 for i, s in got.items())
        (open_,) = decontaminate._open_blocks(index, terms, np.array([0, 6]), 0.4)
        assert set(np.unique(np.flatnonzero(score >= 0.4) // decontaminate.ITEM_BLOCK)) <= set(np.flatnonzero(open_))


def test_shards_agree(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 3)))
    items = [(i, " ".join(word() for _ in range(r.randint(6, 60)))) for i in range(200)]
    docs = []
    for i in range(120):
        part = items[r.randrange(200)][1].split()
        w = [word() for _ in range(200)]
        for _ in range(i % 5):
            part[r.randrange(len(part))] = word()
        w[i:i] = part
        docs.append((i, " ".join(w)))
    docs.append((200, " ".join([*["pad"] * 600_000, items[7][1], *["pad"] * 10])))  # longer than a window
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    shards = decontaminate.indexes(bench, 400)
    assert len(shards) >= 12
    one, many = (sorted(map(tuple, decontaminate.contaminated_pairs(df, bench, shard=n).collect())) for n in (1 << 20, 400))
    assert len(one) > 40 and any(x[0] == 200 and x[1] == 7 for x in one)
    assert [x[:4] + x[5:] for x in one] == [x[:4] + x[5:] for x in many] and np.allclose([x[4] for x in one], [x[4] for x in many], rtol=0, atol=1e-9)
    # Not only what survives the overlap: all that is retrieved.
    texts = [t.encode() for _, t in docs[:60]]
    found = [sorted((t, int(index.ids[i]), round(s, 9)) for path in paths for index in [decontaminate._read(path)] for t, i, s, *_ in decontaminate.search(index, texts)) for paths in (decontaminate.indexes(bench), shards)]
    assert found[0] == found[1]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/x">menu</a></ul></nav><!-- c --><div class="ad-box">advert</div><article><header><h1>Head&amp;line</h1></header>
<p><b>One<br>two&nbsp;three <p>fo<i>u</i>r &lt;5&gt;<ul><li>a<li>b</ul><aside>side</aside><form>f</form><div id="comments">no</div></article><footer>&copy; foot</footer>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Head&line One two three four <5> a b"
    for odd in ("", "<", "<p", "</p></p>x", "<p>a</b>b</p", "<!-- x", "<script>x", "&amp", "<a href='x>y'>z</a>", "<div>" * 5000 + "deep"):
        assert isinstance(html_text.main_text(odd), str)
    assert html_text.main_text("<div>" * 5000 + "deep") == "deep"
    assert html_text.main_text("a < b &amp; c") == "a < b & c"
    assert len(html_text.main_text("<p>word</p>" * 200_000)) == 5 * 200_000 - 1


@pytest.mark.parametrize(("html", "text"), [
    ('<div class="has-sidebar"><article><p>Body text', "Body text"),
    ('<div class="page-with-ads"><main><p>Body', "Body"),
    ('<div class="sidebar"><main><p>Body', "Body"),
    ('<form><article><p>Body</article><p>x</form>', "Body"),
    ('<div id="social-history"><p>Of towns', "Of towns"),
    ('<article><div class="post-header"><h1>Headline</h1></div><p>Body', "Headline Body"),
    ('<p class="notice-period">Three months<p>x', "Three months x"),
    ('<table class="related-data"><tr><td>1<td>2', "1 2"),
    ('<p>x<div class="wide Notice">gone</div><div id="comments">gone</div><aside><article>teaser</article></aside>', "x"),
    # Teasers, comments and adverts are judged before an article in them counts.
    ('<div class="related-posts"><article><h3>Other teaser</h3></article></div><div class="entry"><p>Real body', "Real body"),
    ('<article><p>Story</p></article><div id="comments"><ol class="comment-list"><li><article class="comment-body"><p>reader says hi</article></ol></div>', "Story"),
    ('<article><p>Story</p></article><article class="comment"><p>hi</article>', "Story"),
    ('<article><p>Story</p><section class="comments-section"><article><p>hi</article></section></article>', "Story"),
    ('<main><p>Story</p><div class="user-comments"><article><p>hi</article></div></main>', "Story"),
    ('<article><p>One</p><div class="inline-ad">Buy</div><p>two</p><div class="promo-box">Now</div></article>', "One two"),
    ('<main><p>One</p><div class="widget-area"><p>w</p></div></main>', "One"),
    ('<article><p>Story</p></article><section class="recommended"><article><h3>Next</h3></article></section>', "Story"),
    ('<main><div class="teaser-list"><article>T</article></div><article><p>Story</article></main>', "Story"),
    ('<div class="overlay"><article><p>All there is</article></div>', "All there is"),
    ('<div><article><h3>One</h3></article><article><h3>Two</h3></article></div><div><p>' + "Real body. " * 30 + "</div>", ("Real body. " * 30).strip()),
    ('<article><p>Short.</article><div><a href="/">' + "Link " * 60 + "</a></div>", "Short."),
])
def test_names(html, text):
    assert html_text.main_text(html) == text


def _plain_article(html: str) -> str:
    """The text of a page of the test tables, by patterns: they have one article
    of headings and paragraphs."""
    from html import unescape

    inner = re.search("<article>(.*?)</article>", html, re.S)[1]
    inner = re.sub(r"<!--.*?-->|<script.*?</script>", "", inner, flags=re.S)
    return " ".join(unescape(re.sub("</?(?:b|i|em|a|span)(?: [^>]*)?>", "", re.sub("</?(?:h1|h2|p|br|div|ul|li)(?: [^>]*)?>", " ", inner))).split())


def test_whole_extraction_against_patterns(spark):
    """All pages as they are, and with neither articles nor names, where site
    blocks in plain divs go by the vote alone."""
    rows = table(spark, SF, "pages").collect()
    got = {r.page_id: r.text for r in html_text.extract_text(table(spark, SF, "pages")).collect()}
    assert got == {r.page_id: _plain_article(r.html) for r in rows}
    top, end = "<div><div><p>Daily of the <b>town</b></div><p>All stories</p></div>", "<div><p>Imprint and so on, the same on every page of this site, at some length</div>"
    bare = [(r.page_id, f"http://h{r.page_id % 2}.example/{r.page_id}", f"<body>{top}<div>{re.search('<article>(.*?)</article>', r.html, re.S)[1]}</div>{end}") for r in rows]
    out = html_text.extract_text(spark.createDataFrame(bare, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in out} == got
    assert all(r.n_template >= 2 for r in out)
    unvoted = {i: html_text.main_text(h) for i, _, h in bare}
    assert sum(unvoted[i] != got[i] for i in got) == len(rows)


def test_templates(spark):
    page = lambda i: f"<body><div class=x1>Site {'name' * 2}</div><div class=x2><p>text {i} of page</p><p>more {i}</p></div><div>Imprint</div></body>"
    rows = [(i, f"http://h.example/{i}", page(i), "t") for i in range(20)]
    rows += [(50, "http://other.example/", page(50), "t"), (51, None, None, None), (51, "nonsense", "<p>x", "t"), (None, "", "", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract_text(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got if r.page_id is not None and r.page_id < 51}
    assert all(by[i] == f"text {i} of page more {i}" for i in range(20))
    assert by[50] == "Site namename text 50 of page more 50 Imprint"
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract_text(df.limit(0)).count() == 0
    assert sum(r.n_template for r in got) == 40
    assert sorted(map(str, html_text.extract_text(df, table=0).collect())) == sorted(map(str, got))


def test_votes_against_a_plain_count(spark):
    """Templates of all pages of sf0.001 counted by dictionaries, and by the
    vote alone; no page is changed by it where the article is declared."""
    import re
    from collections import Counter

    rows = [r for r in table(spark, SF, "pages").collect()]
    # Pages of three hosts, so that there is something to vote on.
    pages = [(r.page_id, f"http://h{r.page_id % 3}.example/{r.page_id}", re.sub("</?article>", "", r.html) if r.page_id % 2 else r.html) for r in rows]
    shared = "<section><h2>Most read</h2><ul><li>One<li>Two</ul></section>"
    pages = [(i, u, h.replace("<footer>", shared + "<footer>") if i % 3 else h) for i, u, h in pages]
    seen, size, digests = Counter(), Counter(), {}
    for i, url, html in pages:
        host = url[7:].split("/")[0]
        root, content = html_text.tree(html)
        text = html_text._text(content or [root], set())[0]
        if (host, text) in digests:
            continue
        digests[host, text] = i
        size[host] += 1

        def walk(n, inside, content=content, host=host, own=None):
            """Spelled out: (tag, texts and children) as nested tuples."""
            kids = [x for x in (walk(c, inside or n in content, own=own) if not isinstance(c, str) else " ".join(c.split()) for c in n.children) if x]
            if kids and not n.holds and n.tag not in ("#root", "html", "body") and (not inside or n.tag in html_text.CONTAINERS):
                own.add((n.tag, *kids))
            return (n.tag, *kids) if kids else None

        own: set = set()
        walk(root, False, own=own)
        seen.update((host, x) for x in own)
    want = Counter(host for (host, _), n in seen.items() if n >= max(4, min(0.1 * size[host], 50)))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    with_host = df.selectExpr("split(url, '/')[2] as host", "html")
    got = Counter(r.host for r in html_text.host_templates(with_host).collect())
    assert got == want and sum(want.values()) > 3
    out = {r.page_id: r for r in html_text.extract_text(df).collect()}
    assert all("Most read" not in out[i].text for i, _, _ in pages) and sum(out[i].n_template > 0 for i, _, _ in pages if i % 3) > 20


def test_vectors(spark):
    r = np.random.RandomState(3)
    rows, centre = [], r.normal(size=16)
    rows += [(i, (centre + r.normal(size=16) * 0.08).tolist()) for i in range(300)]
    rows += [(1000 + i, r.normal(size=16).tolist()) for i in range(200)] + [(2000 + i, [1.0] + [0.0] * 15) for i in range(40)] + [(2100, [3.0] + [0.0] * 15)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0]]
    rows += [(3000 + i, v) for i, v in enumerate(odd)]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "vec_id long, embedding array<double>, component long, v int")
    got = {x.vec_id: x for x in embedding_dedup.near_vectors(df).collect()}
    good = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if i < 3000}
    ids = sorted(good)
    x = np.array([good[i] for i in ids])
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    union = plain.Union(dict(rows))
    for a, b in zip(*np.nonzero(linked), strict=True):
        union.join(ids[a], ids[b])
    assert {i: c.component_id for i, c in got.items()} == {i: union.root(i) for i, _ in rows}
    want = dict(zip(ids, linked.sum(axis=1).tolist(), strict=True))
    recall = sum(got[i].n_links for i in ids) / sum(want.values())
    assert 0.9 <= recall <= 1 and all(got[i].n_links <= want[i] for i in ids)
    assert all(got[3000 + i].n_links == 0 for i in range(len(odd)))
    # Rows without an id, and rows that share one, are vectors of their own.
    more = spark.createDataFrame([(None, [2.0, 1.0]), (None, [2.0, 1.0]), (7, [4.0, 2.0]), (7, [0.0, 1.0]), (9, [0.0, 2.0]), (None, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted(map(str, (tuple(x) for x in embedding_dedup.near_vectors(more).collect()))) == sorted(map(str, [
        (None, 2, 7, False), (None, 2, 7, False), (7, 2, 7, True), (7, 1, 7, True), (9, 1, 7, False), (None, 0, None, True)]))
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_copies_are_no_template(spark):
    def page(i: int, story: str) -> tuple:
        return (i, f"http://h.example/{i}", f"<body><div><p>Home of all</p></div><section><p>{story}</p></section></body>")

    # Nine copies of one page, where nothing declares the article.
    rows = [page(i, "The same story.") for i in range(9)] + [page(i, f"Story number {i}.") for i in range(9, 15)]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "The same story." if i < 9 else f"Story number {i}." for i in range(15)}


@pytest.mark.parametrize("at_once", [1 << 24, 30_000])
def test_vectors_of_a_hot_region(spark, monkeypatch, at_once):
    """A third of the vectors at pairwise cosines of 0.8 to 0.9, pairs at 0.955 among them."""
    monkeypatch.setattr(embedding_dedup, "ROWS_AT_ONCE", at_once)
    r = np.random.RandomState(11)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    noise = lambda n: unit(r.normal(size=(n, 64)))
    hot = unit(unit(r.normal(size=64)) * 0.925 + noise(4000) * 0.38)
    off = noise(300)
    off = unit(off - (off * hot[:300]).sum(axis=1, keepdims=True) * hot[:300])
    x = np.concatenate([hot, hot[:300] * 0.955 + off * np.sqrt(1 - 0.955**2), noise(6000)])
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    assert linked.sum() >= 600 and 0.8 < np.median(hot[:500] @ hot[500:1000].T) < 0.9
    union = plain.Union(range(len(x)))
    for a, b in zip(*np.nonzero(linked), strict=True):
        union.join(int(a), int(b))
    window, passes = embedding_dedup.plan(len(x), [x[:: len(x) // 1000]])
    assert window <= len(x) // 8 and passes > 1
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    got = {g.vec_id: (g.n_links, g.component_id, g.kept) for g in embedding_dedup.near_vectors(df).collect()}
    want = {i: (int(linked[i].sum()), union.root(i), union.root(i) == i) for i in range(len(x))}
    missed = sum(want[i][0] - got[i][0] for i in want)
    assert 0 <= missed <= 0.01 * linked.sum() and sum(got[i] != want[i] for i in want) <= 2 * missed


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_windows_over_ranges(spark, ranges):
    """The same links however the sorted vectors are cut into ranges."""
    r = np.random.RandomState(2)
    x = np.concatenate([b := r.normal(size=(120, 16)), b + r.normal(size=b.shape) * 0.08, r.normal(size=(160, 16))])
    rows = [(0, p, i, x[i].tolist()) for p in range(2) for i in np.lexsort((x @ embedding_dedup.planes(p, 4, 16) > 0).T[::-1]).tolist()]
    df = spark.createDataFrame([(16, p, i, n, v) for n, (_, p, i, v) in enumerate(rows)], "dim int, pass int, id long, n long, v array<double>")
    want = set()
    for p in range(2):
        ids = [i for _, q, i, _ in rows if q == p]
        u = x[ids] / np.linalg.norm(x[ids], axis=1, keepdims=True)
        want |= {tuple(sorted((ids[a], ids[b]))) for a, b in zip(*np.nonzero(u @ u.T >= 0.95), strict=True) if 0 < b - a <= 30}
    found = embedding_dedup.range_links(df.repartitionByRange(ranges, "n").sortWithinPartitions("n").select("dim", "pass", "id", "v"), "array<double>", 30, 0.95, common.materialize)
    union, whole = plain.Union(range(len(x))), plain.Union(range(len(x)))
    for f in found:
        for a, b in f.collect():
            union.join(a, b)
    for a, b in want:
        whole.join(a, b)
    assert want and [union.root(i) for i in range(len(x))] == [whole.root(i) for i in range(len(x))]


def test_large_components(spark, monkeypatch):
    """Components of many tiles: some settled by angles, some not."""
    monkeypatch.setattr(embedding_dedup, "TILE", 40)
    r = np.random.RandomState(4)
    spread = r.normal(size=(700, 3)) * np.linspace(0.02, 0.5, 700)[:, None] + [1.0, 0, 0]
    far = r.normal(size=(300, 3)) * 0.03 - [1.0, 0, 0]
    x = np.concatenate([spread, far, far[:50]])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    got = {g.vec_id: g.n_links for g in embedding_dedup.near_vectors(df).collect()}
    assert got == dict(enumerate(linked.sum(axis=1).tolist()))


def test_vectors_of_two_lengths(spark):
    r = np.random.RandomState(5)
    rows = []
    for n, length in ((60, 16), (40, 8)):
        base = r.normal(size=(n // 4, length))
        rows += np.concatenate([base, base * 2, base + r.normal(size=base.shape) * 0.05, r.normal(size=base.shape)]).tolist()
    rows.append([1.0, 2.0])
    cosine = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) if len(a) == len(b) else 0.0
    linked = np.array([[i != j and cosine(a, b) >= 0.95 for j, b in enumerate(rows)] for i, a in enumerate(rows)])
    union = plain.Union(range(len(rows)))
    for a, b in zip(*np.nonzero(linked), strict=True):
        union.join(int(a), int(b))
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    got = {g.vec_id: (g.n_links, g.component_id) for g in embedding_dedup.near_vectors(df).collect()}
    assert linked[60:].sum() > 0
    assert got == {i: (int(linked[i].sum()), union.root(i)) for i in range(len(rows))}


def test_passes_are_measured_over_all_vectors(spark, monkeypatch):
    """No sample decides: what each row needs is taken from the sorted order."""
    r = np.random.RandomState(6)
    bits = r.randint(0, 2, (300, 126))
    bits[:200, :5] = 0
    bits = bits[np.lexsort(bits.T[::-1])]
    weights = np.int64(1) << np.arange(63, dtype=np.int64)[::-1]
    shared = lambda a, b: int(np.append(np.flatnonzero(bits[a] != bits[b]), 126)[0])
    group = np.where(np.arange(300) // 40 % 2, 40, np.arange(300))  # stretches of one group between rows of their own
    for root in (np.arange(300), group):
        got = embedding_dedup.signs_needed(bits[:, :63] @ weights, bits[:, 63:] @ weights, root, [10, 400])
        for i in range(300):
            beyond = [next((j for j in side if root[j] != root[i] or root[i] == i), None) for side in (range(i + 11, 300), range(i - 11, -1, -1))]
            assert got[i].tolist() == [max((shared(i, j) + 1 for j in beyond if j is not None), default=0), 0]
    monkeypatch.setattr(embedding_dedup, "plan", None)
    x = r.normal(size=(400, 32))
    off = r.normal(size=(200, 32))
    off -= (off * x[:200]).sum(axis=1, keepdims=True) / (x[:200] ** 2).sum(axis=1, keepdims=True) * x[:200]
    off *= np.linalg.norm(x[:200], axis=1, keepdims=True) / np.linalg.norm(off, axis=1, keepdims=True)
    rows = np.concatenate([x, x[:200] * 0.952 + off * np.sqrt(1 - 0.952**2)])
    df = spark.createDataFrame(list(enumerate(rows.tolist())), "vec_id long, embedding array<double>")
    got = {g.vec_id: (g.n_links, g.component_id) for g in embedding_dedup.near_vectors(df).collect()}
    assert sum(got[400 + i] == (1, i) for i in range(200)) >= 198

"""Main text of web pages by removing site templates.

1. A page is parsed into a tree, without what has no text to read (scripts,
   styles, pictures, controls).
2. Every element subtree of the body is hashed by tag and text, and Spark
   counts for each host on how many of its pages each hash occurs. Subtrees that
   recur on many pages are the site's template and are deleted, whatever they
   are called. Where a page declares its content by ``article`` or ``main``,
   only containers within it (lists, tables, sections, divs) are put to the
   vote: a paragraph or heading that many articles share is still theirs. What
   holds declared content is never deleted.
3. What the vote can't see, as a host of few pages, an advert that is on one
   page only or readers' comments, goes by name: by tag, by role, or by a class
   or id that is a known name, or one made of known names and words for places
   only (``inline-ad``, but not ``notice-period``). An article in such a block is
   a teaser or a comment and declares nothing; a block that holds the declared
   content stays whatever its name.
4. Where what is declared by ``article`` is small beside the text around it that
   is neither template nor named nor a link, it's a teaser and goes, and the text
   around it is the content.

Blocks are joined in page order by one space, white space within a block is one
space, character references are decoded.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import batch_of, kept, map_batches, materialize, open_read

#: A subtree is template when it's on ``MIN_PAGES`` pages of its host at least,
#: and on ``MIN_SHARE`` of them or on ``MANY``, whichever is less.
MIN_PAGES, MIN_SHARE, MANY = 4, 0.1, 50
#: Template hashes that each Python worker reads at most (8 bytes each).
TABLE = 2_000_000

# Fixed values of the HTML standard: element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
NO_TEXT = frozenset("head script style noscript template title textarea iframe object embed svg canvas audio video math select button input".split())
CUT_TAGS = frozenset("nav footer aside menu dialog search".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar".split())
#: Classes and ids that as a whole name what isn't the article.
CUT_NAMES = frozenset(
    "ad ads ad-box adbox ad-slot ad-container ad-banner advert adverts advertisement advertising banner sponsor sponsored promo promotion "
    "nav navbar nav-bar navigation main-nav site-nav menu menubar main-menu breadcrumb breadcrumbs sidebar side-bar sidenav masthead topbar top-bar site-header page-header "
    "footer site-footer page-footer bottombar comment comments comment-list comments-area comment-section disqus disqus_thread reply replies respond "
    "cookie cookies cookie-notice cookie-banner cookie-consent consent gdpr notice notices newsletter newsletter-signup subscribe subscription signup sign-up login popup modal overlay "
    "share sharing share-buttons social social-links social-share related related-posts related-articles recommended toolbar pagination pager widget widgets skip skip-link".split()
)
#: Words that make up such a name, and words that may stand beside them.
CUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promos promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar sidenav masthead "
    "comment comments disqus reply replies respond cookie cookies consent gdpr notice notices newsletter subscribe subscription signup login popup modal overlay "
    "share sharing social related recommended recommendation recommendations toolbar pagination pager widget widgets skip banner teaser teasers".split()
)
PLACE_WORDS = frozenset(
    "area bar block body bottom box container content first footer group header inline inner item items last left list main outer panel post posts article articles reader readers right "
    "row section sections slot top unit user users wrap wrapper zone form thread links buttons stories story".split()
)
#: Text around declared articles that makes them teasers: so many times theirs, and characters.
AROUND, AROUND_CHARS = 2, 200
#: What is put to the vote inside declared content.
CONTAINERS = frozenset("aside center details div dl fieldset figure footer form header menu nav ol section table ul".split())
_P_CLOSERS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
_IMPLIED = {
    "li": ("li", {"ul", "ol", "menu", "dir"}),
    "dt": ("dt dd", {"dl"}),
    "dd": ("dt dd", {"dl"}),
    "tr": ("tr td th", {"table", "tbody", "thead", "tfoot"}),
    "td": ("td th", {"tr", "table"}),
    "th": ("td th", {"tr", "table"}),
    "option": ("option", {"select", "datalist", "optgroup"}),
}
_TOKEN = re.compile(r"<(?:!--(.*?)(?:--!?>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|[!?/][^>]*(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")


class Node:
    __slots__ = ("attributes", "children", "holds", "tag")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag, self.attributes = tag, attributes
        self.children: list[Node | str] = []
        self.holds = False  # declared content, or is it


def parse(html: str) -> Node:
    """A tree of elements and decoded texts; never fails, whatever the input."""
    root = Node("#root")
    stack, at = [root], 0

    def text(upto: int) -> None:
        if upto > at:
            stack[-1].children.append(unescape(html[at:upto]))

    size = len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        if m is None:
            text(size)
            break
        text(m.start())
        at = m.end()
        if not m[3]:
            continue
        tag = m[3].lower()
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in _P_CLOSERS:
            _close(stack, {"p"}, _SCOPE)
        if tag in _IMPLIED:
            names, stop = _IMPLIED[tag]
            _close(stack, set(names.split()), stop)
        node = Node(tag, m[4])
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(html, at)
            stop_ = end.start() if end else size
            node.children.append(html[at:stop_])
            at = min(size, html.find(">", stop_) + 1 or size) if end else size
        elif tag not in VOID and not m[4].endswith("/"):
            stack.append(node)
    return root


_SCOPE = frozenset("article aside blockquote body button div dd details dialog fieldset figure footer form header html li main nav section table td th #root".split())


def _close(stack: list[Node], names: set[str], stop) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in names:
            del stack[k:]
            return
        if stack[k].tag in stop:
            return


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)}


def _hidden(node: Node) -> bool:
    if not node.attributes:
        return False
    a = _attributes(node.attributes)
    return "hidden" in a or a.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none", a.get("style", ""), re.I))


def _cut_name(name: str) -> bool:
    words_ = re.split(r"[-_]+", name)
    return name in CUT_NAMES or any(w in CUT_WORDS for w in words_) and all(w in CUT_WORDS or w in PLACE_WORDS for w in words_)


def _other_block(node: Node) -> bool:
    """By role, class or id something else than the article, whatever it holds."""
    if not node.attributes or node.tag in ("html", "body", "main"):
        return False
    a = _attributes(node.attributes)
    return a.get("role", "").lower() in CUT_ROLES or any(map(_cut_name, f"{a.get('class', '')} {a.get('id', '')}".lower().split()))


def _is_named(node: Node, inside: bool) -> bool:
    """Named as something else than the article."""
    tag = node.tag
    if tag in CUT_TAGS or _hidden(node):
        return True
    if node.holds or tag in ("html", "body", "article", "main"):
        return False
    if tag == "form" or tag == "header" and not inside:  # an article's own header has its headline
        return True
    if not node.attributes:
        return False
    a = _attributes(node.attributes)
    return _other_block(node) or not inside and "header" in f"{a.get('class', '')} {a.get('id', '')}".lower().split()


def tree(html: str) -> tuple[Node, list[Node]]:
    """The page without what has no text, and its declared content: outermost
    article and main elements, but for those of asides, menus and the like, and
    but for articles of blocks whose name says that they are something else,
    unless the page has no other text."""
    root = parse(html)
    content: list[Node] = []
    doubtful: list[tuple[Node, tuple]] = []
    elsewhere = False
    todo: list[tuple[Node, tuple | None, bool, bool]] = [(root, (), False, False)]

    def declare(node: Node, above: tuple) -> None:
        # Every ancestor of declared content is marked, once.
        content.append(node)
        node.holds = True
        while above and not above[0].holds:
            above[0].holds = True
            above = above[1]

    while todo:
        node, above, other, doubted = todo.pop()
        node.children = [c for c in node.children if isinstance(c, str) or c.tag not in NO_TEXT]
        if above is not None and node.tag in ("article", "main"):
            if node.tag == "main" or not other:
                declare(node, above)
                above = None  # what is inside is content already
            elif not doubted:
                doubtful.append((node, above))
                doubted = True
        elsewhere = elsewhere or above is not None and not other and any(isinstance(c, str) and not c.isspace() for c in node.children)
        for c in reversed(node.children):
            if isinstance(c, Node):
                out = above is None or c.tag in CUT_TAGS or _hidden(c)
                todo.append((c, None if out else (node, above), other or _other_block(c), doubted))
                if above is not None and out and c.tag in ("article", "main"):
                    c.tag = "section"
    for node, above in doubtful:
        if content or elsewhere:
            node.tag = "section"  # so that names decide on it
        else:
            declare(node, above)
    return root, content


def subtree_hashes(root: Node, content: list[Node], seed: int = 0) -> list[tuple[Node, int]]:
    """The elements that are put to the vote, with a hash of tag, text and
    children: all that have text and hold no declared content, and within it the
    containers. Iterative: a page may be as deep as it likes."""
    out: list[tuple[Node, int]] = []
    value: dict[int, int | None] = {}
    inner = {id(c) for c in content}
    todo: list[tuple[Node, bool, bool]] = [(root, False, False)]
    while todo:
        node, inside, done = todo.pop()
        if not done:
            todo.append((node, inside, True))
            within = inside or id(node) in inner
            todo += [(c, within, False) for c in node.children if isinstance(c, Node)]
            continue
        h = xxhash.xxh64(node.tag, seed=seed)
        some = False
        for c in node.children:
            if isinstance(c, Node):
                v = value[id(c)]
                if v is not None:
                    some = True
                    h.update(v.to_bytes(8, "little"))
            elif text := " ".join(c.split()):
                some = True
                h.update(text)
        value[id(node)] = h.intdigest() if some else None
        if some and not node.holds and node.tag not in ("#root", "html", "body") and (not inside or node.tag in CONTAINERS):
            out.append((node, value[id(node)] - (1 << 63)))
    return out


def _text(roots: list[Node], gone: set[int], named: bool = True) -> tuple[str, int, int]:
    """The text below the roots without the elements in ``gone``, and without
    those that are named; how many of either were met."""
    parts: list[str] = []
    voted = cut = 0
    todo: list[tuple[Node | str, bool]] = [(r, False) for r in reversed(roots)]
    while todo:
        n, inside = todo.pop()
        if isinstance(n, str):
            parts.append(n)
        elif id(n) in gone:
            voted += 1
        elif named and _is_named(n, inside):
            cut += 1
        else:
            if n.tag in BLOCK:
                parts.append(" ")
                todo.append((" ", inside))
            inside = inside or n.tag in ("article", "main")
            todo += [(c, inside) for c in reversed(n.children)]
    return " ".join("".join(parts).split()), voted, cut


def _around(root: Node, content: list[Node], gone: set[int]) -> int:
    """Characters of text outside the declared content, but for links and for
    what the vote or its name deletes."""
    inner, size = {id(c) for c in content}, 0
    todo: list[Node] = [root]
    while todo:
        n = todo.pop()
        if id(n) in inner or id(n) in gone or n.tag == "a" or _is_named(n, False):
            continue
        for c in n.children:
            if isinstance(c, Node):
                todo.append(c)
            else:
                size += len(" ".join(c.split()))
    return size


def extract(html: str, is_template: Callable[[np.ndarray], np.ndarray], seed: int = 0, named: bool = True) -> tuple[str, int, int]:
    """The article's text, the template elements deleted from the page by the
    vote (outermost ones), and the elements of what was left that went by name."""
    root, content = tree(html)
    voted = subtree_hashes(root, content, seed)
    hit = is_template(np.array([h for _, h in voted], dtype=np.int64))
    gone = {id(n) for (n, _), t in zip(voted, hit.tolist(), strict=True) if t}
    text, _, cut = _text(content or [root], gone, named)
    if content and all(c.tag == "article" for c in content):
        around = _around(root, content, gone)
        if around >= AROUND_CHARS and around > AROUND * len(text):
            text, _, cut = _text([root], gone | {id(c) for c in content}, named)
    outer, todo = 0, [root]
    while todo:
        n = todo.pop()
        if id(n) in gone:
            outer += 1
        else:
            todo += [c for c in n.children if isinstance(c, Node)]
    return text, outer, cut


def main_text(html: str, template: Iterable[int] = ()) -> str:
    """The text of one page, given its host's template hashes."""
    known = np.array(sorted(template), dtype=np.int64)
    return extract(html, lambda h: np.isin(h, known))[0]


def host_seed(host: str) -> int:
    return xxhash.xxh64(host).intdigest()


_HASHES = pa.schema([("host", pa.string()), ("page", pa.int64()), ("hash", pa.int64())])
_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_template", pa.int32()), ("n_named", pa.int32())])


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The subtrees of every page, beside a digest of what may be its article;
    a row without a hash stands for the page itself."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            hosts, pages, hashes = [], [], []
            part = batch.slice(start, 256)
            for host, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                root, content = tree(html or "")
                own = [None, *{h for _, h in subtree_hashes(root, content, host_seed(host))}]
                text = _text(content or [root], set())[0]
                hosts += [host] * len(own)
                pages += [xxhash.xxh64(text).intdigest() - (1 << 63)] * len(own)
                hashes += own
            yield batch_of(_HASHES, [hosts, pages, hashes])


def _read_table(files: tuple[str, ...]) -> np.ndarray:
    out = [np.zeros(0, np.int64)]
    for f in files:
        with open_read(f) as stream:
            out.append(pq.ParquetFile(stream).read(["hash"])["hash"].to_numpy())
    return np.sort(np.concatenate(out))


def _among(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(hashes), dtype=bool)
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


def _rows(part: pa.RecordBatch, tests: Iterable) -> pa.RecordBatch:
    hosts, html = part.column(0).to_pylist(), part.column(3).to_pylist()
    got = [extract(x or "", test, host_seed(host)) for host, x, test in zip(hosts, html, tests, strict=True)]
    text, voted, named = zip(*got, strict=True)
    return batch_of(_OUT, [part.column(1), part.column(2), text, [len(t) for t in text], voted, named])


def _extract(files: tuple[str, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page_id, url, html) by one table for all hosts."""
    known = kept(files, partial(_read_table, files))
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            yield _rows(part, [partial(_among, known)] * part.num_rows)


def _extract_by_host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows with their host's hashes; rows of a host follow one another."""
    host = known = None
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            if host is None or row.column(0)[0].as_py() != host:
                host = row.column(0)[0].as_py()
                known = np.sort(np.array(row.column(4)[0].as_py() or [], dtype=np.int64))
            yield _rows(row, [partial(_among, known)])


def host_templates(pages: DataFrame) -> DataFrame:
    """(host, hash): subtrees that recur on a host's pages.

    Pages with the same content, as a page and its print version or a mirrored
    path, are one page here: copies don't make an article a template.
    """
    hashes = map_batches(pages.select("host", "html"), _subtrees, "host string, page long, hash long").distinct()
    counted = materialize(hashes.groupBy("host", "hash").agg(F.count("*").alias("pages")).where(F.col("hash").isNull() | (F.col("pages") >= MIN_PAGES)), "html-counts")
    sizes = counted.where("hash is null").select("host", F.col("pages").alias("size"))
    enough = F.col("pages") >= F.least(F.lit(MIN_SHARE) * F.col("size"), F.lit(MANY))
    return materialize(counted.where("hash is not null").join(sizes, "host").where(enough).select("host", "hash"), "html-templates")


def extract_text(pages: DataFrame, table: int = TABLE) -> DataFrame:
    """Per row: page_id, url, text (empty if none), n_chars, n_template and
    n_named (elements deleted by the vote, and then by name).

    Null html is empty; pages without a url or host vote together as one host;
    null and repeated ids are kept row for row; other columns are ignored;
    very long pages are parsed whole; broken markup is read as browsers read
    it, as far as text goes; an empty table stays empty.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.select(host.alias("host"), "page_id", "url", "html")
    templates = host_templates(rows)
    out = "page_id long, url string, text string, n_chars long, n_template int, n_named int"
    if templates.count() <= table:
        return map_batches(rows, partial(_extract, tuple(sorted(templates.inputFiles()))), out)
    # Beyond the bound pages meet their own host's hashes, hot hosts in parts.
    by_host = templates.groupBy("host").agg(F.collect_list("hash").alias("template"))
    salted = by_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
    joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(32)).cast("int")).join(salted, ["host", "salt"], "left")
    joined = joined.sortWithinPartitions("host").select("host", "page_id", "url", "html", "template")
    return map_batches(joined, _extract_by_host, out)

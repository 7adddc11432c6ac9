"""Main text of web pages: removal of subtrees that a host's pages share, and a few structural rules.

Pass 1 parses every page and hashes its block subtrees twice.

* By content: tags, attributes and text. Spark counts per host in how many different pages a hash occurs (pages with
  equal main text count once, so copies of an article do not make it a template, whatever menus and adverts they have),
  apart for subtrees inside the page's main element and beside it. Beside it a subtree is a template from `beside_pages`
  different pages and a share of `beside_share` of the host's on; inside it, where near copies of an article share
  paragraphs, only from `min_pages` and `share` on.
* By shape: tags, class and id without digits, names of attributes, and where there is text, runs of like children as one.
  So a menu or an advert that says something else on every page recurs. A shape is a template of a host from `min_pages`
  different pages on if it stands beside the main element on a share of `share` of them, is itself that element on few of
  them, and holds little of their text on average. A class or id that as a whole names what is not the article is a hint:
  then two pages of the host, or three of all hosts, are enough, and inside the main element too.

The main element is what is marked as article body or main, else the longest article, else what holds most of the text.
Pass 2 parses again and takes out the host's template subtrees; those by shape before the main element is looked for,
so an advert longer than its article is not taken for it. Further it takes out

* elements that are never text: scripts, styles, forms, menus and so on, by tag or role (never one that holds the main
  element). On hosts of fewer than `min_pages` different pages, which cannot tell a shape from chance, a hint is enough
  by itself (within an article, paragraphs, headings, lists and the like go only under a plain name such as `ad`);

then takes the article: the elements marked as article body, else `article`, else `main`, else the body.

Text is decoded; white space within the text becomes one blank; blocks are joined by one blank. Pages are walked
without recursion, so the depth of nesting has no bound.

Cases: null html is an empty page; a null or odd url belongs to the host ''; broken markup is closed as
browsers do; a page without text gives ''; repeated rows are pages of their own, counted once as templates;
an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import extended, materialize

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks whose start ends an open paragraph.
ENDS_P = BLOCK - frozenset("body br head html legend option caption tbody td tfoot th thead title tr".split())
#: An element of the key ends an open one of the value, up to the nearest of SCOPE.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "thead", "tbody"), "body": ("head",)}
SCOPE = frozenset("html body table ul ol dl select article section main div".split())
DROP_TAGS = frozenset("head nav aside form button select datalist input dialog menu svg canvas object applet audio video map math script style textarea noscript iframe template noembed noframes".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: Words of a class or id that mark what is not the article.
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion promoted banner banners sidebar sidebars aside nav navbar navigation menu menus breadcrumb breadcrumbs footer masthead comment comments commentlist disqus respond reply replies cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations teaser teasers widget widgets pagination pager toolbar copyright disclaimer skip hidden".split()
)
#: Words that may stand beside them in one class or id: `ad-slot` is an advert, `has-sidebar` is no sidebar.
LAYOUT_WORDS = frozenset("area bar block body bottom box button buttons center col column container content form group header holder icon icons inner item items layer left link links list main message outer page panel post posts region right row section site slot small space text title top unit wrap wrapper x".split())
KEEP_TAGS = frozenset("html body main article".split())
#: Elements that hold the whole page.
FRAME = frozenset("#root html body".split())
#: In an article a class or id drops one of these only if it is one of the plain names.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li td th tr table figure span a b i em strong code".split())
PLAIN_NAMES = frozenset("ad ads advert advertisement advertisements advertising adsense sponsored promo comment comments cookie-notice newsletter breadcrumb breadcrumbs".split())
#: Subtrees that are hashed.
HASHED = frozenset("div section p ul ol dl table blockquote figure header footer nav aside form h1 h2 h3 h4 h5 h6 details main pre address span li".split())

TOKEN = re.compile(
    r"""<(?:!--(?:.*?)(?:--!?>|\Z)|[!?][^>]*(?:>|\Z)|/([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z))""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
DIGITS = re.compile(r"\d+")
INLINE = frozenset("span a b i em strong code".split())
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Element:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.attrs, self.children = tag, attrs, []

    def attributes(self) -> dict[str, str]:
        return {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(self.attrs)}


def parse(source: str) -> Element:
    root = Element("#root", "")
    stack = [root]
    is_open: Counter[str] = Counter()  # open elements by tag, so that nothing is looked for in vain
    at, end = 0, len(source)

    def close_from(i: int) -> None:
        is_open.subtract(x.tag for x in stack[i:])
        del stack[i:]

    def close_to(tags: tuple[str, ...], scope: frozenset[str]) -> None:
        if not any(is_open[t] for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                close_from(i)
                return
            if stack[i].tag in scope:
                return

    while at < end:
        m = TOKEN.search(source, at)
        stop = m.start() if m else end
        if stop > at:
            stack[-1].children.append(source[at:stop])
        if not m:
            break
        at = m.end()
        closing, tag, attrs = m[1], m[2] or m[4], m[3] if m[2] else m[5]
        if closing:
            closing = closing.lower()
            if closing == "br":
                stack[-1].children.append(Element("br", ""))
            elif is_open[closing]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == closing:
                        close_from(i)
                        break
                    if closing not in BLOCK and stack[i].tag in BLOCK:
                        break  # a stray inline end tag
        elif tag:
            tag = tag.lower()
            if tag in ENDS_P:
                close_to(("p",), SCOPE)
            if tag in ENDS:
                # td and th may stand inside an open tr of the same table
                close_to(ENDS[tag], SCOPE - {tag})
                if tag in ("tr", "tbody", "tfoot"):
                    close_to(ENDS[tag], SCOPE)
            node = Element(tag, attrs or "")
            stack[-1].children.append(node)
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                if tag == "title":
                    node.children.append(source[at : close.start() if close else end])
                at = close.end() if close else end
            elif tag not in VOID and not (attrs or "").endswith("/") or tag in BLOCK - VOID:
                stack.append(node)
                is_open[tag] += 1
    return root


def _is_main(node: Element) -> bool:
    return node.tag == "main" or "main" in node.attrs and node.attributes().get("role") == "main" or "articleBody" in node.attrs and node.attributes().get("itemprop") == "articleBody"


def kept_elements(root: Element) -> frozenset[int]:
    """Elements that no rule drops: those that hold a main element or article body, else the longest article, else most of the text."""
    order: list[tuple[Element, int]] = [(root, -1)]
    sizes: list[int] = []
    for i, (node, _) in enumerate(order):  # order grows meanwhile
        sizes.append(0)
        for child in node.children:
            if isinstance(child, str):
                sizes[i] += len(child.strip())
            else:
                order.append((child, i))
    for i in range(len(order) - 1, 0, -1):
        node, parent = order[i]
        if node.tag not in DROP_TAGS or node.tag == "form":
            sizes[parent] += sizes[i]
    held = [i for i, (node, _) in enumerate(order) if _is_main(node)] or sorted((i for i, (node, _) in enumerate(order) if node.tag == "article"), key=lambda i: -sizes[i])[:1]
    if not held:
        return frozenset(id(node) for (node, _), n in zip(order, sizes, strict=True) if 2 * n > sizes[0] and (node.tag not in DROP_TAGS or node.tag == "form"))
    kept = set()
    for i in held:
        while i >= 0 and id(order[i][0]) not in kept:
            kept.add(id(order[i][0]))
            i = order[i][1]
    return frozenset(kept)


def _names_boilerplate(names: str, in_article: bool) -> bool:
    """Whether a class or id, taken as a whole, names what is not the article."""
    parts = {w.lower() for w in NAME_PART.findall(names)}
    marks = DROP_WORDS if in_article else DROP_WORDS | {"header"}
    return bool(parts & marks) and parts <= marks | LAYOUT_WORDS


def is_hinted(node: Element, in_article: bool) -> bool:
    """Whether a class or id says that the element is not of the article."""
    if not node.attrs or node.tag in KEEP_TAGS and node.tag != "article":
        return False
    attrs = node.attributes()
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}".split()
    if node.tag in PROSE and in_article:
        return any(name.lower() in PLAIN_NAMES for name in names)
    return any(_names_boilerplate(name, in_article) for name in names)


def is_boilerplate(node: Element, in_article: bool, kept: frozenset[int] = frozenset(), hints: bool = True) -> bool:
    if id(node) in kept:
        return False
    tag = node.tag
    if tag in KEEP_TAGS and tag != "article":
        return False
    if tag in DROP_TAGS:
        return True
    if tag == "footer":
        return True
    if tag == "header":
        return not in_article
    if not node.attrs:
        return False
    attrs = node.attributes()
    if attrs.get("role", "").lower() in DROP_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return True
    return hints and is_hinted(node, in_article)


def _text_into(top: Element, out: list[str], drop: frozenset[int], kept: frozenset[int], in_article: bool, hints: bool) -> None:
    """Appends the text below `top`, in order, without what is dropped. Of a header only headings count."""
    todo: list[tuple[Element | str, bool, bool]] = [(c, in_article, False) for c in reversed(top.children)]
    while todo:
        child, inside, headings_only = todo.pop()
        if isinstance(child, str):
            if not headings_only:
                out.append(html.unescape(child))
            continue
        if not child.tag:  # the end of a block
            out.append(" ")
            continue
        if is_boilerplate(child, inside, kept, hints) or id(child) in drop:
            continue
        if child.tag in BLOCK:
            out.append(" ")
            todo.append((_END, inside, False))
        only = id(child) not in kept and (headings_only and child.tag not in HEADINGS or child.tag == "header")
        todo += [(c, inside or child.tag == "article", only) for c in reversed(child.children)]


_END = Element("", "")


def _find(top: Element, wanted, drop: frozenset[int], kept: frozenset[int], out: list[Element], hints: bool) -> None:
    todo = list(reversed(top.children))
    while todo:
        child = todo.pop()
        if isinstance(child, str) or is_boilerplate(child, False, kept, hints) and child.tag != "article" or id(child) in drop:
            continue
        if wanted(child):
            if not is_boilerplate(child, True, kept, hints):
                out.append(child)
        else:
            todo += reversed(child.children)


def main_text(root: Element, drop: frozenset[int] = frozenset(), kept: frozenset[int] | None = None, hints: bool = True) -> str:
    kept = kept_elements(root) if kept is None else kept
    for wanted in (
        lambda n: "articleBody" in n.attrs and n.attributes().get("itemprop") == "articleBody",
        lambda n: n.tag == "article",
        lambda n: n.tag == "main" or "main" in n.attrs and n.attributes().get("role") == "main",
        lambda n: n.tag == "body",
        lambda n: n.tag == "#root",
    ):
        found: list[Element] = []
        _find(root, wanted, drop, kept, found, hints)
        if wanted(root):
            found = [root]
        if found:
            out: list[str] = []
            for node in found:
                out.append(" ")
                _text_into(node, out, drop, kept, node.tag in ("article", "main"), hints)
            text = " ".join("".join(out).split())
            if text or found == [root]:
                return text
    return ""


def subtree_hashes(root: Element, kept: frozenset[int]) -> list[tuple[int, bool, Element]]:
    """(hash, inside, element) of the page's block subtrees with text; inside: a kept element other than the page's frame holds it.

    The hash covers tags, attributes and text of the whole subtree. Elements kept by their markup are no templates; one
    kept only as it holds most of the text may be one, and counts as inside.
    """
    todo: list[tuple[Element, bool, bool]] = [(root, False, False)]
    done: dict[int, tuple[bytes, int]] = {}
    found, marked = [], False
    while todo:
        node, inside, entered = todo.pop()
        if not entered:
            todo.append((node, inside, True))
            within = inside or id(node) in kept and node.tag not in FRAME
            todo += [(c, within, False) for c in node.children if not isinstance(c, str) and c.tag not in RAW]
            continue
        h, size = xxhash.xxh64(f"{node.tag} {node.attrs.strip()}".encode("utf-8", "surrogatepass")), 0
        for child in node.children:
            if isinstance(child, str):
                text = " ".join(child.split())
                if text:
                    h.update(b"\x00" + text.encode("utf-8", "surrogatepass"))
                    size += len(text)
            elif child.tag not in RAW:
                inner, n = done.pop(id(child))
                h.update(b"\x01" + inner)
                size += n
        done[id(node)] = h.digest(), size
        marked = marked or id(node) in kept and (node.tag == "article" or _is_main(node))
        if size and node.tag in HASHED:
            found.append((_signed(h.intdigest()), inside or id(node) in kept, node))
    return [x for x in found if id(x[2]) not in kept] if marked else found


def _shape_of(node: Element) -> str:
    attrs = node.attributes() if node.attrs else {}
    names = " ".join(sorted(f"{attrs.get('class', '')} {attrs.get('id', '')}".split()))
    return f"{node.tag} {DIGITS.sub('', names)} {' '.join(sorted(attrs))}"


#: Where a shaped subtree stands: beside the main element, inside it, or it is that element.
BESIDE, INSIDE, MAIN = 0, 1, 2


def subtree_shapes(root: Element, kept: frozenset[int]) -> list[tuple[int, int, bool, int, Element]]:
    """(shape, place, hinted, characters, element) of the page's block subtrees with text. Inline elements are text to a shape."""
    todo: list[tuple[Element, bool, bool, bool]] = [(root, False, False, False)]
    done: dict[int, tuple[bytes, int]] = {}
    found = []
    while todo:
        node, inside, in_article, entered = todo.pop()
        if not entered:
            todo.append((node, inside, in_article, True))
            within = inside or id(node) in kept and node.tag not in FRAME
            article = in_article or node.tag in ("article", "main")
            todo += [(c, within, article, False) for c in node.children if not isinstance(c, str) and c.tag not in RAW]
            continue
        parts, size = [], 0
        for child in node.children:
            if isinstance(child, str):
                n = len(child) if child and not child.isspace() else 0
                part = b"T" if n else b""
            elif child.tag in RAW:
                continue
            else:
                part, n = done.pop(id(child))
            size += n
            if part and (not parts or parts[-1] != part):
                parts.append(part)
        block = node.tag in BLOCK or node.tag in HASHED - INLINE
        if not size:
            done[id(node)] = b"", 0
        elif not block and all(p == b"T" for p in parts):
            done[id(node)] = b"T", size
        else:
            h = xxhash.xxh64(_shape_of(node))
            for part in parts:
                h.update(b"\x01" + part)
            done[id(node)] = h.digest(), size
            if block and node.tag not in FRAME:
                place = MAIN if id(node) in kept else INSIDE if inside else BESIDE
                found.append((_signed(h.intdigest()), place, is_hinted(node, in_article), size, node))
    return found


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


SHAPE = "shape: long, place: int, hinted: boolean, part: double"


def _emit_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("shape", pa.int64()), ("place", pa.int32()), ("hinted", pa.bool_()), ("part", pa.float64())]))
    for batch in batches:
        keys, beside, within, shapes = [], [], [], []
        for source in batch.column("html").to_pylist():
            root = parse(source or "")
            kept = kept_elements(root)
            found = subtree_hashes(root, kept)
            keys.append(_signed(xxhash.xxh64_intdigest(main_text(root, kept=kept).encode("utf-8", "surrogatepass"))))
            within.append(sorted({h for h, inside, _ in found if inside}))
            beside.append(sorted({h for h, inside, _ in found if not inside}))
            shaped = subtree_shapes(root, kept)
            whole = max((size for *_, size, _ in shaped), default=1) or 1
            held: dict[tuple, float] = {}
            for shape, place, hinted, size, _ in shaped:
                if place != INSIDE or hinted:
                    held[shape, place, hinted] = held.get((shape, place, hinted), 0.0) + size / whole
            shapes.append([{"shape": a, "place": b, "hinted": c, "part": n} for (a, b, c), n in held.items()])
        lists = [pa.array(x, pa.list_(pa.int64())) for x in (beside, within)]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(keys, pa.int64()), *lists, pa.array(shapes, kind)], ["host", "page_key", "beside", "inside", "shapes"])


def site_templates(
    pages: DataFrame, *, share: float = 0.6, min_pages: int = 10, beside_share: float = 0.02, beside_pages: int = 3, most_part: float = 0.5, hint_pages: int = 2, hint_all: int = 3
) -> DataFrame:
    """host, templates, inner, shapes, hints: what recurs across a host's pages, and whether hints are enough there.

    templates, inner: hashes by content of subtrees beside and inside the main element; shapes: hashes by shape. Of any
    kind there are at most (subtrees a page) / share of them a host, and of hinted shapes those that the host has.
    """
    seen = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_emit_hashes, f"host string, page_key long, beside array<long>, inside array<long>, shapes array<struct<{SHAPE}>>")
    seen = materialize(seen, "page-hashes")
    sizes = seen.select("host", "page_key").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"))
    # Copies of a page have one key but may have blocks of their own.
    places = F.concat(F.transform("beside", lambda h: F.struct(h.alias("hash"), F.lit(False).alias("inside"))), F.transform("inside", lambda h: F.struct(h.alias("hash"), F.lit(True).alias("inside"))))
    held = seen.select("host", "page_key", F.inline(places)).distinct()
    counts = held.groupBy("host", "hash", "inside").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(min_pages, beside_pages))
    known = counts.join(sizes, "host").where(
        F.when(F.col("inside"), (F.col("n") >= min_pages) & (F.col("n") >= share * F.col("n_pages"))).otherwise((F.col("n") >= beside_pages) & (F.col("n") >= beside_share * F.col("n_pages")))
    )
    known = known.groupBy("host").agg(F.collect_list(F.when(~F.col("inside"), F.col("hash"))).alias("templates"), F.collect_list(F.when(F.col("inside"), F.col("hash"))).alias("inner"))
    one = seen.select("host", "page_key", F.inline("shapes")).groupBy("host", "page_key", "shape").agg(F.max((F.col("place") == MAIN).cast("int")).alias("main"), F.max("hinted").alias("hinted"), F.max("part").alias("part"))
    shaped = one.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.sum("main").alias("n_main"), F.max("hinted").alias("hinted"), F.avg("part").alias("part"))
    everywhere = shaped.where("hinted").groupBy("shape").agg(F.sum("n").alias("n_all"))
    rare, regular = F.col("n_main") <= 0.1 * F.col("n"), (F.col("n") >= min_pages) & (F.col("n") >= share * F.col("n_pages"))
    hinted = F.col("hinted") & ((F.col("n") >= hint_pages) | (F.col("n_all") >= hint_all))
    chosen = shaped.join(sizes, "host").where(F.col("n_pages") >= min_pages).join(everywhere, "shape", "left").where(hinted | (regular & rare & (F.col("part") <= most_part)))
    chosen = chosen.groupBy("host").agg(F.collect_list("shape").alias("shapes"))
    return sizes.join(known, "host", "left").join(chosen, "host", "left").select("host", "templates", "inner", "shapes", (F.col("n_pages") < min_pages).alias("hints"))


def _without(root: Element, gone: frozenset[int]) -> None:
    todo = [root]
    while todo:
        node = todo.pop()
        if any(id(c) in gone for c in node.children):
            node.children = [c if id(c) not in gone else " " for c in node.children]
        todo += [c for c in node.children if not isinstance(c, str)]


def clean_page(source: str, templates: set[int], inner: set[int], shapes: set[int] | frozenset[int] = frozenset(), hints: bool = True) -> tuple[str, int]:
    """The main text of a page, and how many template subtrees were taken out of it."""
    root = parse(source)
    kept, drop, n = kept_elements(root), frozenset(), 0
    if shapes:
        marked = any(x.tag == "article" or _is_main(x) for x in _elements(root) if id(x) in kept)
        gone = [x for shape, place, _, _, x in subtree_shapes(root, kept) if shape in shapes and not (marked and place == MAIN)]
        if gone:
            held = frozenset(map(id, gone))
            _without(root, held)
            kept, n = kept_elements(root), len(held)
    if templates or inner:
        drop = frozenset(id(node) for h, inside, node in subtree_hashes(root, kept) if h in (inner if inside else templates))
    return main_text(root, drop, kept, hints), len(drop) + n


def _elements(root: Element) -> Iterator[Element]:
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo += [c for c in node.children if not isinstance(c, str)]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("html", "_templates", "_inner", "_shapes", "_hints")
    for batch in batches:
        texts, counts = [], []
        for source, templates, inner, shapes, hints in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
            text, n = clean_page(source or "", set(templates or ()), set(inner or ()), set(shapes or ()), hints is not False)
            texts.append(text)
            counts.append(n)
        columns = {n: batch.column(n) for n in batch.schema.names if n not in names}
        columns |= {"text": pa.array(texts, pa.string()), "n_templates": pa.array(counts, pa.int64())}
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def extract_text(pages: DataFrame, **options) -> DataFrame:
    """pages with `html` replaced by `text` and `n_templates`, the subtrees taken out as templates.

    Other columns stay as they are, `_host`, `_templates`, `_inner`, `_shapes` and `_hints` excepted; a former `text` or `n_templates` is replaced.
    """
    pages = pages.drop("text", "n_templates", "_host", "_templates", "_inner", "_shapes", "_hints")
    known = materialize(site_templates(pages, **options), "site-templates")
    # A host may own most pages: the join is left to the optimizer, which broadcasts a small list and splits a skewed host.
    known = known.withColumnsRenamed({c: f"_{c}" for c in known.columns})
    joined = pages.withColumn("_host", host_of(F.col("url"))).join(known, "_host", "left").drop("_host")
    return joined.mapInArrow(_extract, extended(pages.drop("html"), text="string", n_templates="long"))

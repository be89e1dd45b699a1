"""Main text of web pages, with the template of each site removed.

A page is parsed into elements, and block subtrees are hashed twice: over their text, and over
their shape (tags, classes and ids, without text; equal neighbours count as one). Spark counts
for each host on how many pages a hash occurs; pages of equal main text count as one, so that
copies of a page don't vote its body out. Then, on the pages of a host that was counted:

* a subtree whose text recurs on many of its host's pages is template and goes, in the article
  too. There, headings, lists, tables and whatever holds more than half of the text are spared, and
  a paragraph goes only if its class or id names it a notice: articles share lines and passages;
* a subtree whose shape recurs, whatever its text, goes if it is mostly links (outside an
  article) or if its class or id names boilerplate. A name alone deletes nothing there.

On hosts of too few pages names decide alone. What is none of the text by its very element,
role or being hidden (scripts, forms, menus, footers, noscript, ``display:none`` ...) and
containers of reader comments by their class or id go on every page. But what only surrounds the
text stays: an element that holds all articles of the page (a form or a sidebar around them) or,
menus and footers aside, more than half of its text outside links. The text is that of all
articles left, with what else a ``main`` element around them says, in page order, or of the page
where none is marked.

The recurring subtrees of a host are bounded: each stands on at least ``min_share`` of the
host's pages, so there are at most (subtrees on a page) / ``min_share`` of them.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.urls import host_and_path
from tessera.session import durable, small_batches

#: A subtree is template from so many pages of a host, and such a share of the host's pages.
MIN_PAGES = 4
MIN_SHARE = 0.1
#: Recurring subtrees that may be broadcast, 8 bytes each beside their host's name.
BROADCAST_ROWS = 500_000

# Fixed values of the HTML standard, and names in common use.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title plaintext".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li "
    "main menu nav noscript ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li ul ol dl dt dd figure figcaption table thead tbody tfoot tr td th caption".split())
CELLS = frozenset(["td", "th"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: In an article these and all within them are prose, whatever their name; lists may be menus.
NAMELESS = HEADINGS | frozenset("p blockquote pre figure figcaption table dl".split())
#: First words of a class that tells of a page's layout and not of the element ("no-sidebar").
LAYOUT = frozenset("no not has have with without hide hides is".split())
#: Whole names of what holds readers' comments, and words that may stand beside them.
COMMENTS = frozenset("comment comments commentlist disqus respond replies".split())
AROUND = frozenset("list area section thread threads wrap wrapper container box block form reader readers user users post article page entry view".split())
#: Elements whose content never is text of the page, and those that only surround links and imprints.
NEVER = frozenset("head script style noscript template title button input select textarea option svg canvas iframe object embed applet audio video map noembed noframes xmp".split())
LINKING = frozenset("nav menu footer".split())
LINKING_ROLES = frozenset("navigation contentinfo menu menubar toolbar tablist".split())
DROPPED = frozenset("head script style noscript template title nav menu footer aside form button input select textarea option svg canvas iframe object embed applet audio video map dialog noembed noframes xmp search fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion promotions banner cookie cookies consent gdpr notice notices notification notifications alert popup popups modal overlay "
    "newsletter subscribe subscription signup sidebar sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead toolbar topbar login comment comments commentlist disqus respond replies reply "
    "social share sharing sharebar related recommended recommendations pagination pager skip skiplink".split()
)
CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]), "tbody": frozenset(["thead", "tbody", "tr", "td", "th"]), "thead": frozenset(["thead", "tbody", "tr", "td", "th"]), "tfoot": frozenset(["thead", "tbody", "tr", "td", "th"]),
}
#: An implied end does not reach beyond these.
SCOPES = frozenset("ul ol dl table select".split())

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']++)(?:\s*=\s*(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++)))?""")
_NAME = re.compile(r"[a-z0-9]+")


class Element:
    """An element with its children (elements and strings) in page order.

    ``block`` and ``scope`` are the nearest block and scope around its content; a scope counts
    its open elements by tag. ``key`` and ``shape`` are the hashes, ``size`` counts the characters of
    text, ``shown`` those outside boilerplate, ``linked`` those in links and ``prose`` those in
    neither links nor what never is text. ``articles`` counts those inside, ``seen`` those of them
    outside other boilerplate; ``kept`` says that the element only surrounds the text.
    """

    __slots__ = ("tag", "attributes", "children", "parent", "block", "scope", "open", "key", "shape", "size", "shown", "linked", "prose", "articles", "seen", "kept")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None) -> None:
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Element | str] = []
        self.block = self if parent is None or tag in BLOCKS else parent.block
        self.scope, self.open = (self, {}) if parent is None or tag in SCOPES else (parent.scope, None)
        self.key = self.shape = self.size = self.shown = self.linked = self.prose = self.articles = self.seen = 0
        self.kept = False


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), html.unescape(a or b or c))
    return found


class _Stack:
    """The open elements. Each step takes time in proportion to what it closes."""

    def __init__(self) -> None:
        self.root = self.at = Element("#root", {}, None)
        self.count: dict[str, int] = {}

    def start(self, child: Element) -> None:
        inside = self.at.scope.open
        inside[child.tag] = inside.get(child.tag, 0) + 1
        self.count[child.tag] = self.count.get(child.tag, 0) + 1
        self.at = child

    def close(self, e: Element) -> None:
        """End ``e`` and what is open in it."""
        stop = e.parent
        while self.at is not stop:
            self.count[self.at.tag] -= 1
            self.at.parent.scope.open[self.at.tag] -= 1
            self.at = self.at.parent

    def end(self, tag: str) -> bool:
        """End the innermost open element of a tag; whether there was one."""
        if not self.count.get(tag):
            return False
        e = self.at
        while e.tag != tag:
            e = e.parent
        self.close(e)
        return True

    def imply(self, tag: str) -> None:
        """The ends that a start tag implies: of what it can't stand in, within the scope, or of an open paragraph."""
        ends = CLOSED_BY.get(tag)
        if ends is None:
            if self.at.block.tag == "p":
                self.close(self.at.block)
            return
        scope = self.at.scope
        left = sum(scope.open.get(t, 0) for t in ends)
        e, outer = self.at, None
        while left and e is not scope:
            if e.tag in ends:
                outer, left = e, left - 1
            e = e.parent
        if outer is not None:
            self.close(outer)


def parse(page: str) -> Element:
    """The element tree of a page. Unknown, unclosed and stray tags are forgiven; no page fails."""
    stack = _Stack()
    pos, end = 0, len(page)
    while pos < end:
        lt = page.find("<", pos)
        if lt < 0:
            stack.at.children.append(html.unescape(page[pos:]))
            break
        if lt > pos:
            stack.at.children.append(html.unescape(page[pos:lt]))
        if page.startswith("<!--", lt):
            close = page.find("-->", lt + 2)
            pos = end if close < 0 else close + 3
            continue
        follow = page[lt + 1 : lt + 2]
        if follow in ("!", "?"):
            close = page.find(">", lt)
            pos = end if close < 0 else close + 1
            continue
        m = _TAG.match(page, lt) or _LOOSE.match(page, lt)
        if m is None:
            if follow == "/" or follow.isalpha():  # a tag that the page's end cuts off
                close = page.find(">", lt)
                if close < 0:
                    break
                pos = close + 1
            else:
                stack.at.children.append("<")
                pos = lt + 1
            continue
        pos, tag = m.end(), m[2].lower()
        if m[1]:
            if not stack.end(tag) and tag == "p":
                stack.at.children.append(Element("p", {}, stack.at))
            continue
        if tag in BLOCKS or tag in CLOSED_BY:
            stack.imply(tag)
        child = Element(tag, _attributes(m[3]) if m[3].strip() else {}, stack.at)
        stack.at.children.append(child)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, pos)
            stop = close.start() if close else end
            child.children.append(page[pos:stop])
            gt = page.find(">", stop) if close else -1
            pos = gt + 1 if gt >= 0 else end
        elif tag not in VOID and (tag in BLOCKS or not m[3].endswith("/")):  # "/" means nothing on an HTML block
            stack.start(child)
    return stack.root


def _named(e: Element, inside: bool) -> bool:
    """Whether class or id name boilerplate. In an article an id is often a heading's slug, so all its words must be names."""
    for a in ("class", "id"):
        for token in e.attributes.get(a, "").lower().split():
            words = _NAME.findall(token)
            if not words or words[0] in LAYOUT:
                continue
            if NAMES.issuperset(words) or not (a == "id" and inside) and not NAMES.isdisjoint(words):
                return True
    return False


def _comments(e: Element) -> bool:
    """Whether class or id say that a block holds readers' comments, and nothing else."""
    if e.tag not in BLOCKS or e.tag in NAMELESS or e.tag in HEADINGS:
        return False
    for a in ("class", "id"):
        for token in e.attributes.get(a, "").lower().split():
            words = _NAME.findall(token)
            if not COMMENTS.isdisjoint(words) and words[0] not in LAYOUT and all(w in COMMENTS or w in AROUND for w in words):
                return True
    return False


def boilerplate(e: Element, inside: bool) -> bool:
    """Whether the element is none of the main text by its tag, role, being hidden or holding comments; ``inside``: within an article."""
    if e.kept:
        return False
    if e.tag in DROPPED or (e.tag == "header" and not inside):
        return True
    a = e.attributes
    if not a or e.tag in ("html", "body", "main"):
        return False
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        return True
    return a.get("role", "").lower() in ROLES or _comments(e)


def _is_article(e: Element) -> bool:
    return e.tag == "article" or e.attributes.get("itemprop") == "articleBody"


def measure(root: Element) -> None:
    """Set the hashes and text sizes of every subtree."""
    around = _sizes(root)
    if _keep(root, around):
        _show(root)


def _sizes(root: Element) -> list[Element]:
    """Set the hashes and sizes; the boilerplate that might surround the text."""
    stack: list[tuple[Element, bool, bool]] = [(root, False, False)]
    around = []
    while stack:
        x, done, inside = stack.pop()
        if not done:
            inside = inside or x.tag == "article"
            stack.append((x, True, inside))
            if x.tag not in RAW:
                stack.extend((c, False, inside) for c in x.children if not isinstance(c, str))
            continue
        a = x.attributes
        digest, size, shown, linked, prose, articles, seen, last = xxhash.xxh64(x.tag, seed=1), 0, 0, 0, 0, 0, 0, None
        shape = xxhash.xxh64(f"{x.tag}\0{a.get('class', '')}\0{a.get('id', '')}" if a else x.tag, seed=2)
        for c in x.children:
            if isinstance(c, str):
                if t := " ".join(c.split()):
                    digest.update("\0t" + t)
                    size += len(t)
                    shown += len(t)
                    prose += len(t)
            else:
                digest.update(c.key.to_bytes(8, "little"))
                size += c.size
                shown += c.shown
                linked += c.linked
                prose += c.prose
                articles += c.articles
                seen += c.seen if c.shown else 0
                if c.shape != last:
                    shape.update(c.shape.to_bytes(8, "little"))
                    last = c.shape
        x.key, x.shape, x.size = digest.intdigest(), shape.intdigest(), size
        dropped = boilerplate(x, inside)
        x.shown = 0 if dropped else shown
        x.linked = size if x.tag == "a" else linked
        x.prose = 0 if x.tag == "a" or x.tag in NEVER else prose
        own = prose > 0 and _is_article(x) and not _comments(x)
        x.articles, x.seen = articles + own, seen + (own and shown > 0)
        if dropped and x.tag not in NEVER and x.prose:
            around.append(x)
    return around


def _keep(root: Element, around: list[Element]) -> bool:
    """Say which boilerplate only surrounds the text; whether any does."""
    for e in around:
        if e.tag not in LINKING and e.attributes.get("role", "").lower() not in LINKING_ROLES:
            e.kept = e.prose == root.prose if _comments(e) else 2 * e.prose > root.prose
    if not root.seen and not any(e.kept and e.seen for e in around):  # all articles lie in boilerplate: open what holds them, no deeper than it takes
        stack = [root]
        while stack:
            e = stack.pop()
            if boilerplate(e, False) and e.tag not in NEVER:
                e.kept = True
                if e.seen:
                    continue
            stack.extend(c for c in e.children if not isinstance(c, str) and c.articles)
    return any(e.kept for e in around)


def _show(root: Element) -> None:
    """Set the shown sizes anew."""
    stack: list[tuple[Element, bool, bool]] = [(root, False, False)]
    while stack:
        x, done, inside = stack.pop()
        if not done:
            inside = inside or x.tag == "article"
            stack.append((x, True, inside))
            if x.tag not in RAW:
                stack.extend((c, False, inside) for c in x.children if not isinstance(c, str))
            continue
        x.shown = 0 if boilerplate(x, inside) else sum(len(" ".join(c.split())) if isinstance(c, str) else c.shown for c in x.children)


def _spared(e: Element, inside: bool, whole: int) -> bool:
    """What no name and no shape deletes: what holds more than half of the text, headings, an article's prose."""
    return 2 * e.shown > whole or e.tag in (NAMELESS if inside else HEADINGS)


def _suspect(e: Element, inside: bool, whole: int) -> bool:
    """Whether the recurrence of its shape would make the element template."""
    if _spared(e, inside, whole):
        return False
    a = e.attributes
    return ("class" in a or "id" in a) and _named(e, inside) or not inside and e.tag in BLOCKS and 0 < e.size < 2 * e.linked


def _votes(e: Element, inside: bool, whole: int) -> bool:
    """Whether the recurrence of its text would make the element template."""
    if e.tag not in BLOCKS or e.tag in ("html", "body", "main") or not e.size:
        return False
    if not inside:
        return True
    return 2 * e.size <= whole and (e.tag not in PROSE or e.tag == "p" and _named(e, inside))


def _is_template(e: Element, inside: bool, whole: int, template: frozenset[int] | None) -> bool:
    if template is None:  # a host that can't be counted
        return _suspect(e, inside, whole) and _named(e, inside)
    return e.key in template and _votes(e, inside, whole) or e.shape in template and _suspect(e, inside, whole)


def main_elements(root: Element, template: frozenset[int] | None = None, marks: bool = True) -> tuple[list[Element], bool]:
    """The elements that hold the main text in page order, and whether they are marked as such.

    Marked elements within template or in what is named as boilerplate are taken only if there
    are no others, and of several articles those that are mostly links are not.
    """
    for strict in (True, False) if marks else ():
        articles, others = [], []
        stack = [root]
        while stack:
            e = stack.pop()
            if e is not root:
                if _is_article(e):
                    if e.shown and not (strict and _is_template(e, True, root.shown, template)):
                        articles.append(e)
                    continue
                if e.shown and (e.tag == "main" or e.attributes.get("role") == "main"):
                    others.append(e)
            stack.extend(c for c in reversed(e.children) if not isinstance(c, str) and c.shown and not boilerplate(c, False) and not (strict and _is_template(c, False, root.shown, template)))
        if articles:
            plain = [e for e in articles if 2 * e.linked <= e.size]
            return plain or articles, True
        if others:
            return [max(others, key=lambda e: e.shown)], True
    return [root], False


def _each(mains: list[Element], marked: bool, root: Element) -> Iterator[tuple[Element, bool, int]]:
    """Elements that may be template, with whether they lie in a marked main element and the text size around."""
    holders, inner = set(), {id(e): e for e in mains if marked}
    for e in mains:
        up: Element | None = e
        while up is not None and id(up) not in holders:
            holders.add(id(up))
            up = up.parent
    stack: list[tuple[Element, Element | None]] = [(root, None)]
    while stack:
        e, around = stack.pop()
        around = around or inner.get(id(e))
        for c in e.children:
            if isinstance(c, str) or c.tag in RAW or c.tag in DROPPED and not c.kept:
                continue
            if id(c) not in holders:
                yield c, around is not None, (around or root).shown
            stack.append((c, around))


def subtree_keys(page: str | None, marks: bool = True) -> tuple[int, set[int]]:
    """Hash of the page's main text, and distinct hashes of its subtrees that may be template."""
    if not page:
        return 0, set()
    root = parse(page)
    measure(root)
    mains, marked = main_elements(root, None, marks)
    keys = set()
    for e, inside, whole in _each(mains, marked, root):
        if _votes(e, inside, whole):
            keys.add(e.key)
        if _suspect(e, inside, whole):
            keys.add(e.shape)
    return xxhash.xxh64_intdigest(_text(mains, marked, None)), keys


def main_text(page: str | None, template: frozenset[int] | None = None, marks: bool = True) -> str:
    """Text of the main blocks, white space made single, joined by a line break.

    ``template`` is what recurs on the page's host; None where the host has too few pages to tell.
    """
    if not page:
        return ""
    root = parse(page)
    measure(root)
    return _text(*main_elements(root, template, marks), template)


def _text(mains: list[Element], marked: bool, template: frozenset[int] | None) -> str:
    """Text of the blocks of the main elements without boilerplate and template."""
    blocks: list[str] = []
    words: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(words).split()):
            blocks.append(text)
        words.clear()

    chosen = {id(e) for e in mains} if marked else set()
    for main in _regions(mains) if marked else mains:
        # Within a main element the text around its articles is like any other text of the page.
        stack: list[tuple[Element | str, bool, bool, bool, int]] = [(main, False, False, id(main) in chosen, main.shown)]
        while stack:
            x, closing, prose, inside, whole = stack.pop()
            if isinstance(x, str):
                words.append(x)
                continue
            block = x.tag in BLOCKS and x.tag not in CELLS
            if closing:
                flush() if block else words.append(" " if x.tag in CELLS else "")
                continue
            enters = not inside and id(x) in chosen
            if enters:
                inside, whole = True, x.shown
            elif x is not main and (boilerplate(x, inside) or marked and not inside and _is_article(x) or not prose and not _holds(x, chosen, inside) and _is_template(x, inside, whole, template)):
                if block:
                    flush()
                continue
            if block:
                flush()
            elif x.tag in CELLS or x.tag == "br":
                words.append(" ")
            stack.append((x, True, prose, inside, whole))
            prose = prose or (inside and x is not main and not enters and x.tag in NAMELESS)
            stack.extend((c, False, prose, inside, whole) for c in reversed(x.children))
        flush()
    return "\n".join(blocks)


def _holds(e: Element, chosen: set[int], inside: bool) -> bool:
    """Whether an element around the text's articles holds one of them."""
    return not inside and bool(chosen) and e.articles > 0


def _regions(mains: list[Element]) -> list[Element]:
    """The articles, or the main element around them instead."""
    out: dict[int, Element] = {}
    for e in mains:
        up = e.parent
        while up is not None and up.tag != "main" and up.attributes.get("role") != "main":
            up = up.parent
        out.setdefault(id(up or e), up or e)
    return list(out.values())


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, marks: bool = True, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(host, keys)`` for each host of ``min_pages`` pages: the hashes that recur on its pages."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [subtree_keys(page.as_py(), marks) for page in batch.column(1)]
            content = pa.array([_signed(c) for c, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), content, pa.array([[_signed(k) for k in keys] for _, keys in found], pa.list_(pa.int64()))], ["host", "content", "keys"])

    small_batches(pages.sparkSession)
    host, _ = host_and_path(F.col(url_col).cast("string"))
    seen = pages.select(host.alias("host"), F.col(html_col).cast("string").alias("html")).where("host <> ''").mapInArrow(per_batch, "host string, content bigint, keys array<bigint>")
    # The null key counts the pages themselves, in the same pass; pages of equal content are one.
    once = seen.select("host", "content", F.explode(F.concat(F.array(F.lit(None).cast("bigint")), "keys")).alias("key")).distinct()
    often = durable(once.groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages))
    totals = often.where("key is null").select("host", F.col("n").alias("all"))
    kept = often.join(totals, "host").where((F.col("n") >= min_share * F.col("all")) | F.col("key").isNull())
    return kept.groupBy("host").agg(F.collect_list("key").alias("keys"))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, marks: bool = True, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, url, text, n_chars, n_template)`` for every row of ``pages``.

    Null and empty html give an empty text. Pages without a host, and of hosts of fewer than
    ``min_pages`` different pages, are cleaned by element and name. Rows of equal main text count as one page.
    ``n_template`` counts the hashes that the page's host has as template, null if it wasn't counted.
    Without ``marks`` no article element is looked for. An empty table gives an empty result.
    """
    found = durable(templates(pages, min_pages, min_share, marks=marks, url_col=url_col, html_col=html_col))
    n = found.agg(F.sum(F.size("keys") + 4)).first()[0] or 0
    host, _ = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"))
    rows = rows.join(F.broadcast(found) if n <= BROADCAST_ROWS else found, "host", "left").select("id", "url", "html", "keys")

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: dict[bytes | None, frozenset[int] | None] = {None: None}
            texts, sizes = [], []
            for page, keys in zip(batch.column(2), batch.column(3), strict=True):
                own = keys.values.to_numpy() if keys.is_valid else None
                mark = None if own is None else own.tobytes()
                if mark not in sets:
                    sets[mark] = frozenset(k & 0xFFFFFFFFFFFFFFFF for k in own.tolist())
                texts.append(main_text(page.as_py(), sets[mark], marks))
                sizes.append(None if own is None else len(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(sizes, pa.int64())], ["id", "url", "text", "n_chars", "n_template"])

    id_type = pages.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(per_batch, f"id {id_type}, url string, text string, n_chars bigint, n_template bigint")


def query(spark, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumnRenamed("id", "page_id")

"""Main-text extraction by wrapper induction.

A host's pages are dealt to parts of about ``group_pages``, alike in size whatever
their number and the cluster's settings.  A part induces a wrapper: the DOM trees are aligned, one after another, to a
growing template by simple tree matching (ordered, same-label nodes, largest number of matched nodes; Yang 1991), with a
run of like siblings taken as one repeated node.  A template node remembers in how many different pages a text stood at
it: text that stays is template, text that varies fills a slot and is content.  The slots tell the articles that vary
from teasers that stand on every page, and what belongs to the text beside them in ``main``; an article that varies is
kept whole, with the headings that repeat in it.  Without such elements, the element with nearly all varying text is
read, and what stays in it goes.  What alignment can't tell, varying furniture such as adverts and comments, is told by
the element and by the words of its class, id and role.  A host of fewer than four different pages has no template.

A large host is many parts, and no task holds more than one.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stage

GROUP_PAGES = 48
#: Hosts of several parts that are broadcast, at most.
MAX_HOSTS = 200_000
#: Nesting beyond which trees are no longer aligned (they are still read).
ALIGN_DEPTH = 60

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option select optgroup".split())
CLOSES_P = BLOCKS - frozenset("body html caption tbody td tfoot th thead tr option select optgroup legend".split())
#: A start tag on the left ends an open element on the right, up to the nearest of the stop elements.
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody", "tfoot"), "thead": ("tr", "td", "th", "tbody"), "tfoot": ("tr", "td", "th", "tbody", "thead")}
STOPS = frozenset("ul ol dl menu table select article section div body nav aside main header footer form blockquote td th".split())

DROPPED = frozenset("head nav footer aside form script style noscript template iframe object embed button select textarea input svg canvas audio video map dialog menu title noembed noframes xmp".split())
FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|sidebar\w*|side|nav\w*|menu\w*|breadcrumb\w*|footer\w*|masthead|topbar|toolbar|header|comments?|commentlist|disqus\w*|replies|respond"
    r"|cookie\w*|consent|gdpr|notice\w*|alert|popup|modal|overlay|newsletter|subscribe\w*|signup|login|share\w*|sharing|social\w*|related\w*|recommend\w*|widget\w*|pagination|pager|skip\w*|legal|copyright|disclaimer|search\w*|tags?|toc)(?=$|[\s_-])",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|</([a-zA-Z][^\s/>]*+)[^>]*+>?|<([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+'|[\"'])*?)>", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*+>?", re.I) for t in RAW}


class Node:
    __slots__ = ("tag", "key", "kids", "hint", "hidden", "template")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.kids, self.template = tag, [], None
        cls, ident, role = (attrs or {}).get("class", ""), (attrs or {}).get("id", ""), (attrs or {}).get("role", "").lower()
        self.key = f"{tag}.{' '.join(cls.split())}" if cls else tag
        self.hint = role or bool((cls or ident) and FURNITURE.search(f"{cls} {ident}"))
        self.hidden = bool(attrs) and ("hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower())


def parse(html: str | None) -> Node:
    """A tree for any text; tags that are not closed are closed by what follows, as browsers do for the common elements."""
    root = Node("#root")
    stack, at, html = [root], 0, html or ""
    while m := _TOKEN.search(html, at):
        if m.start() > at:
            stack[-1].kids.append(html[at : m.start()])
        at = m.end()
        if close := m[1]:
            close = close.lower()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == close:
                    del stack[i:]
                    break
        elif tag := m[2]:
            tag, raw = tag.lower(), m[3]
            attrs = {a.lower(): unescape(b or c or d) for a, b, c, d in _ATTR.findall(raw)} if raw and not raw.isspace() else None
            if tag in CLOSES_P or tag in IMPLIED:
                ends = IMPLIED.get(tag, ())
                for i in range(len(stack) - 1, 0, -1):
                    t = stack[i].tag
                    if t == "p" and tag in CLOSES_P or t in ends:
                        del stack[i:]
                        if t not in ("td", "th", "tr", "option") or tag not in ("tr", "tbody", "thead", "tfoot", "optgroup"):
                            break
                    elif t in STOPS and t not in ends or t in BLOCKS and tag in CLOSES_P and t != "li":
                        break
            node = Node(tag, attrs)
            stack[-1].kids.append(node)
            if tag in RAW:
                end = _RAW_END[tag].search(html, at)
                node.kids.append(html[at : end.start() if end else len(html)])
                at = end.end() if end else len(html)
            elif tag not in VOID and not (raw and raw.endswith("/")):
                stack.append(node)
    if at < len(html):
        stack[-1].kids.append(html[at:])
    return root


def furniture(node: Node, inside: bool) -> bool:
    """``inside``: in the article.  A header there may hold its title; elsewhere it is the page's."""
    if node.tag in DROPPED or node.hidden:
        return True
    if node.tag == "header":
        return not inside
    if node.tag in ("article", "main", "body", "html", "h1", "h2", "h3", "h4", "h5", "h6", "p") and node.hint is True:
        return node.tag in ("p",) or bool(re.search(r"comment|respond|related|sidebar", node.key, re.I)) and node.tag not in ("body", "html")
    return node.hint is True or node.hint in ROLES


def squeeze(parts: list[str]) -> str:
    return " ".join(unescape("".join(parts)).split())


def blocks(root: Node, inside: bool = False) -> list[tuple[str, Node]]:
    """(text, element) of each block in page order; a block's text is what stands in it outside inner blocks and furniture."""
    out: list[tuple[str, Node]] = []
    held: list[str] = []

    def flush(node: Node) -> None:
        if held:
            if text := squeeze(held):
                out.append((text, node))
            held.clear()

    # (node, place among its children, element that the block belongs to, in the article)
    stack: list[list] = [[root, 0, root, inside]]
    while stack:
        node, i, block, within = top = stack[-1]
        if i == len(node.kids):
            stack.pop()
            if node is block:
                flush(node)
            continue
        top[1] += 1
        kid = node.kids[i]
        if isinstance(kid, str):
            held.append(kid)
        elif kid.tag == "br" or kid.tag == "wbr":
            held.append(" " if kid.tag == "br" else "")
        elif kid is not root and furniture(kid, within):
            if kid.tag in BLOCKS:
                flush(block)
        elif kid.tag in BLOCKS:
            flush(block)
            stack.append([kid, 0, kid, within or kid.tag in ("article", "main")])
        else:
            stack.append([kid, 0, block, within])
    return out


# --- wrapper induction ---------------------------------------------------------------------------------


class Slot:
    """A template node: its label, its children, and in how many different pages each text stood at it."""

    __slots__ = ("key", "kids", "texts", "pages")

    def __init__(self, key: str):
        self.key, self.kids, self.texts, self.pages = key, [], Counter(), 0


def elements(node: Node) -> list[list[Node]]:
    """Element children, like neighbours together."""
    out: list[list[Node]] = []
    for k in node.kids:
        if isinstance(k, Node) and k.tag not in VOID:
            if out and out[-1][0].key == k.key:
                out[-1].append(k)
            else:
                out.append([k])
    return out


def match(slot: Slot, node: Node, depth: int, memo: dict) -> tuple[int, list]:
    """Simple tree matching of a template node and an element of its label: matched nodes, and the pairs below."""
    at = (id(slot), id(node))
    if at in memo:
        return memo[at]
    best: tuple[int, list] = (1, [])
    if depth < ALIGN_DEPTH:
        a, b = slot.kids, elements(node)
        if a and b:
            rows = [[(0, None)] * (len(b) + 1)]
            for i, s in enumerate(a, 1):
                row = [(0, None)]
                for j, run in enumerate(b, 1):
                    pick = max((rows[i - 1][j][0], 1), (row[j - 1][0], 2))
                    if s.key == run[0].key:
                        n = rows[i - 1][j - 1][0] + match(s, run[0], depth + 1, memo)[0]
                        if n >= pick[0]:
                            pick = (n, 0)
                    row.append(pick)
                rows.append(row)
            i, j, pairs = len(a), len(b), []
            while i and j:
                step = rows[i][j][1]
                if step == 0:
                    i, j = i - 1, j - 1
                    pairs.append((a[i], b[j], j))
                elif step == 1:
                    i -= 1
                else:
                    j -= 1
            best = (1 + rows[-1][-1][0], pairs[::-1])
    memo[at] = best
    return best


def align(slot: Slot, node: Node) -> None:
    """Align a page to the template, growing the template by what had no partner; nodes get their slot."""
    memo: dict = {}
    todo = [(slot, node, 0)]
    while todo:
        s, n, depth = todo.pop()
        n.template = s
        if depth >= ALIGN_DEPTH:
            continue
        runs_, paired = elements(n), {}
        for kid, _, j in match(s, n, depth, memo)[1]:
            paired[j] = kid
        place = 0
        for j, run in enumerate(runs_):
            kid = paired.get(j)
            if kid is None:
                kid = Slot(run[0].key)
                s.kids.insert(place, kid)
            place = s.kids.index(kid) + 1
            for k in run:
                todo.append((kid, k, depth + 1))


def induce(pages: list[Node]) -> tuple[Slot, list[list[tuple[str, Node]]]]:
    """The template of a group of pages, and each page's blocks."""
    template, seen, all_blocks = Slot("#root"), set(), []
    for root in pages:
        align(template, root)
        found = blocks(root)
        all_blocks.append(found)
        whole = hash(tuple(t for t, _ in found))
        if whole in seen:  # copies of a page are one witness
            continue
        seen.add(whole)
        template.pages += 1
        for text, slot_id in {(t, id(n.template)): n.template for t, n in found if n.template}.items():
            slot_id.texts[text[0]] += 1
    return template, all_blocks


def outermost(root: Node, wanted) -> list[Node]:
    """The wanted nodes outside furniture that lie in no other one, in page order."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        if wanted(n):
            out.append(n)
        else:
            stack += [k for k in reversed(n.kids) if isinstance(k, Node) and not furniture(k, False)]
    return out


def below(nodes: list[Node]) -> set[int]:
    """The nodes and all elements inside them."""
    inside, stack = set(), list(nodes)
    while stack:
        n = stack.pop()
        inside.add(id(n))
        stack += [k for k in n.kids if isinstance(k, Node)]
    return inside


def article_blocks(root: Node, constant) -> list[tuple[str, Node]]:
    """The blocks of the page's articles, whole, and what varies beside them in a ``main``; without articles, the ``main``, whole; none without both.

    Slots decide between articles: one in which nothing varies from page to page is a teaser of the template, unless all are
    so.  Inside an article nothing is taken for template, however often a heading or a closing line repeats.
    """
    articles = outermost(root, lambda n: n.tag == "article")
    mains = outermost(root, lambda n: n.tag == "main" or n.hint == "main")
    varying = [n for n in articles if any(not constant(t, e) for t, e in blocks(n, True))]
    gone = below([n for n in articles if n not in varying]) if varying else set()
    own = varying or articles
    if not mains or not own:
        return [x for n in mains or own for x in blocks(n, True)]
    inside = below(own)
    found = [x for n in mains for x in blocks(n, True)]
    if not any(id(n) in inside for _, n in found):
        return [x for n in own for x in blocks(n, True)]
    return [(t, n) for t, n in found if id(n) in inside or id(n) not in gone and not constant(t, n)]


def dense(root: Node, constant) -> Node:
    """Without an article element: the deepest element that holds nine tenths of the varying text in blocks that aren't mostly links."""

    def mass(n: Node) -> int:
        return sum(len(t) for t, e in blocks(n) if not constant(t, e) and links(e) * 2 < len(t))

    def links(n: Node) -> int:
        total, stack = 0, [(n, False)]
        while stack:
            x, a = stack.pop()
            for k in x.kids:
                if isinstance(k, str):
                    total += len(k) if a else 0
                else:
                    stack.append((k, a or k.tag == "a"))
        return total

    at, all_mass = root, mass(root)
    while all_mass:
        inner = [k for k in at.kids if isinstance(k, Node) and k.tag in BLOCKS and not furniture(k, False)]
        best = max(((mass(k), -i, k) for i, k in enumerate(inner)), default=(0, 0, None), key=lambda x: x[:2])
        if best[2] is None or best[0] < 0.9 * all_mass or best[2].tag in ("p", "li", "tr", "td"):
            break
        at = best[2]
    return at


def extract_group(htmls: list[str | None], least: int = 4, share: float = 0.5) -> list[str]:
    """The main text of each page of one host."""
    pages = [parse(h) for h in htmls]
    template, all_blocks = induce(pages)

    def constant(text: str, node: Node) -> bool:
        s = node.template
        return template.pages >= least and s is not None and s.texts.get(text, 0) >= max(3, share * template.pages)

    out = []
    for root in pages:
        if found := article_blocks(root, constant):
            out.append("\n\n".join(t for t, _ in found))
            continue
        found = blocks(dense(root, constant))
        varying = [t for t, n in found if not constant(t, n)]
        # a page whose text mostly stands on the others too is a copy of them, not template
        kept = varying if 2 * sum(map(len, varying)) > sum(len(t) for t, _ in found) else [t for t, _ in found]
        out.append("\n\n".join(kept))
    return out


def grouped(pages: DataFrame, group_pages: int = GROUP_PAGES) -> DataFrame:
    """``pages`` (with ``host``, page_id, url) and their ``part``: a host of n pages has ceil(n / group_pages) parts, alike in size, dealt by a hash of the page.

    Only hosts of several parts are looked up; their list is broadcast up to ``MAX_HOSTS`` rows and joined by a shuffle beyond.
    """
    many = pages.groupBy("host").agg(F.ceil(F.count("*") / group_pages).alias("parts")).where("parts > 1")
    many = stage(many, "hosts")
    many = F.broadcast(many) if many.count() <= MAX_HOSTS else many
    part = F.pmod(F.xxhash64("page_id", "url"), F.coalesce("parts", F.lit(1)))
    return pages.join(many, "host", "left").withColumn("part", part).drop("parts")


def main_text(pages: DataFrame, group_pages: int = GROUP_PAGES) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): (page_id, url, text, n_chars).

    Null and empty html give an empty text; a null url is a host of its own; repeated rows are separate pages; an empty
    table gives no rows.  Character references are decoded, white space in a block becomes one space, blocks are joined
    by an empty line in page order.
    """
    small_batches(pages.sparkSession, 1000)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    # a large host is dealt over many tasks, part by part; pages are shuffled once
    dealt = grouped(rows, group_pages).select("page_id", "url", "html", "host", "part").repartition("host", "part").sortWithinPartitions("host", "part", "page_id", "url", F.xxhash64("html"))
    kind = dict(pages.dtypes)["page_id"]

    def extract(batches):
        held: list[pa.RecordBatch] = []  # pages of one part of a host

        def done() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            texts = extract_group(table.column("html").to_pylist())
            out = {"page_id": table.column("page_id"), "url": table.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
            return pa.table(out).combine_chunks().to_batches()[0]

        current = None
        for batch in batches:
            parts, start = list(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)), 0
            for i, h in enumerate(parts):
                if h != current:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    if held:
                        yield done()
                    start, current = i, h
            if len(parts) > start:
                held.append(batch.slice(start))
        if held:
            yield done()

    return dealt.mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")

"""Main text of web pages by tag-path ratios.

Every text node has a root-to-leaf tag path (containers with their class).
Text length and punctuation are averaged over the nodes of a path, smoothed
along the page, fused to one score per path and thresholded; the nodes of the
paths that pass are content.  From the root the extraction goes down to the
element that still holds nearly all content, and takes it whole, so that its
headings, lists, links and short paragraphs stay; an article or main element
on that way ends it.  Marked furniture (navigation, adverts, forms, comments
...) inside it goes.  Words of a class or id are only evidence of furniture,
which the content an element holds can overrule.

Parsing and scoring are linear in the page, also for broken or deeply nested
markup: paths are interned as (path above, tag), an element knows its parent,
and open tags are found by their places on the stack.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The HTML vocabulary.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
# Elements whose text isn't shown, if they end before the next one of their kind begins.
UNSEEN = frozenset("template svg audio video canvas select datalist annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article body center div main section td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# an element of the key ends an open element of the values, unless one of the barrier stands between
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "thead": "tr", "tbody": "tr thead", "tfoot": "tr tbody"}
BARRIER = frozenset("ul ol dl table menu body article section div".split())

# Elements, roles and words in class or id that mark page furniture.
FURNITURE = frozenset("nav footer aside form button dialog menu search head".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies "
    "disclaimer discussion disqus footer gdpr login masthead modal nav navbar navigation newsletter overlay pager "
    "pagination popup promo promoted promotion recommendations recommended replies respond sharing sidebar signup "
    "responses sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets".split()
)
# Words that also name subjects; they count if the whole name consists of them and of layout.
WEAK_WORDS = frozenset("alert banner copyright hidden legal menu notice notification related reply search share skip social".split())
LAYOUT_WORDS = frozenset("bar block bottom box button buttons container content inner item items left link links list main outer panel right row section side site top wrap wrapper".split())
# First and last words of a class that only says that there is such a thing elsewhere (has-sidebar, comments-open).
SAYS_FIRST, SAYS_LAST = frozenset("has with without no".split()), frozenset("open closed enabled disabled on off".split())
MAIN_ROLES = frozenset(("main", "article"))
# Classes of what readers wrote; only these, as a whole class, mark an article.
COMMENTS = frozenset("comment comments commentlist discussion disqus replies reply respond responses".split())
# Names that also head a part of a text, such as a paper's discussion.
SUBJECTS = frozenset("discussion recommendations responses".split())
#: What keeps its text whatever its class or id says.
UNMARKABLE = HEADINGS | frozenset("html body main p li dd dt td th tr table tbody thead tfoot caption blockquote pre figure figcaption".split())
#: An element that holds this share of the content found so far is entered.
ENTERED = 0.9

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_READ = frozenset("class id role hidden aria-hidden style".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?。，、！？；：…]")


@dataclass
class Node:
    """A text node."""

    path: int
    text: str
    block: int
    element: int  # the innermost element that holds it
    furniture: bool
    linked: bool

    def plain(self) -> bool:
        return not self.furniture and not self.linked and not self.text.isspace()


@dataclass
class Page:
    """Text nodes in page order, and the elements by number; a parent has the smaller number, 0 is the page itself."""

    nodes: list[Node] = field(default_factory=list)
    parent: list[int] = field(default_factory=lambda: [0])
    container: list[bool] = field(default_factory=lambda: [True])
    main: list[bool] = field(default_factory=lambda: [False])
    named: dict[int, bool] = field(default_factory=dict)  # furniture by its class or id: whether for comments
    subject: set[int] = field(default_factory=set)  # those of them whose name is one of SUBJECTS
    headed: set[int] = field(default_factory=set)  # elements with a heading of their own
    answered: set[int] = field(default_factory=set)  # elements that hold a form or article, or what is named for comments
    body: int = 0

    def held(self, own: dict[int, float]) -> list[float]:
        """For each element what it and all elements below it hold, given what each holds itself."""
        out = [own.get(e, 0.0) for e in range(len(self.parent))]
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out

    def below(self, elements: set[int] | dict[int, bool]) -> list[bool]:
        """For each element whether it is one of ``elements`` or below one."""
        out = [0 in elements] * len(self.parent)
        for e in range(1, len(out)):
            out[e] = out[self.parent[e]] or e in elements
        return out


def _names_furniture(name: str) -> bool:
    words = [w.lower() for w in _WORD.findall(name)]
    if not words or words[0] in SAYS_FIRST or words[-1] in SAYS_LAST:
        return False
    if any(w in FURNITURE_WORDS or w.rstrip("s") in FURNITURE_WORDS for w in words):
        return True
    return any(w in WEAK_WORDS for w in words) and all(w in WEAK_WORDS or w in LAYOUT_WORDS for w in words)


def _is_furniture(tag: str, attributes: list[tuple[str, str]], in_main: bool) -> bool:
    if tag in FURNITURE or (tag == "header" and not in_main):
        return True
    for name, value in attributes:
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if (name == "style" and _UNSEEN.search(value)) or (name == "role" and value.lower() in FURNITURE_ROLES):
            return True
    return False


def _is_named_furniture(tag: str, attributes: list[tuple[str, str]], is_main: bool) -> bool:
    """By words of its class or id, which :func:`_overruled` may set aside; inline elements keep their text."""
    if tag not in BLOCK or tag in UNMARKABLE:
        return False
    names = [n for name, value in attributes if name in ("class", "id") for n in value.split()]
    return any(n.lower() in COMMENTS for n in names) if is_main else any(map(_names_furniture, names))


class _Tags:
    """Where tags begin and end; each part of the page is looked at a bounded number of times."""

    def __init__(self, page: str) -> None:
        self.page, self.last = page, page.rfind(">")
        self.broken = -1  # up to here quotes don't count, since one that was opened never closes
        self.no_cdata = len(page)  # from here on no CDATA section closes

    def next(self, at: int) -> tuple[int, int, str, str, bool, str] | None:
        """(begin, end, name or "", attributes, whether an end tag, CDATA text) of the next tag from ``at``."""
        page = self.page
        while (begin := page.find("<", at)) >= 0:
            at = begin + 1
            if page.startswith("!--", at):
                end = page.find("-->", at + 3)
                return begin, len(page) if end < 0 else end + 3, "", "", False, ""
            if page.startswith("![CDATA[", at) and begin < self.no_cdata:
                if (end := page.find("]]>", at + 8)) >= 0:
                    return begin, end + 3, "", "", False, page[at + 8 : end]
                self.no_cdata = begin
            if at > self.last:
                return None  # no tag closes any more: the rest is text
            if page.startswith(("!", "?"), at):
                return begin, page.index(">", at) + 1, "", "", False, ""
            closing = page.startswith("/", at)
            if name := _NAME.match(page, at + closing):
                end = self._end(name.end())
                return begin, end + 1, name[0].lower(), page[name.end() : end], closing, ""
        return None

    def _end(self, at: int) -> int:
        """Place of the > that ends a tag; one in quotes doesn't, unless the quotes or the tag never close."""
        first = self.page.index(">", at)
        while at > self.broken and (stop := _STOP.search(self.page, at)):
            if stop[0] == ">":
                return stop.start()
            if not (at := self.page.find(stop[0], stop.end()) + 1):
                self.broken = stop.start()
        self.broken = max(self.broken, at)
        return first


def parse(page: str) -> Page:
    """The page's text nodes and elements; what isn't shown (scripts, comments ...) is left out."""
    out = Page()
    nodes, parent = out.nodes, out.parent
    paths: dict[tuple[int, str], int] = {}
    # of each element: its path, and whether it is in furniture, a header, a link, a heading, an article or main element
    path_of, furniture, header, linked, heading, in_main, coded = [0], [False], [False], [False], [False], [False], [False]
    stack: list[tuple[str, int]] = []
    places: dict[str, list[int]] = defaultdict(list)  # tag -> its places on the stack
    ends: dict[str, re.Pattern[str]] = {}
    nexts: dict[str, re.Pattern[str]] = {}
    tags = _Tags(page)
    unended: dict[str, int] = {}  # from here on no element of the tag begins or ends
    block = at = 0

    def add(text: str) -> None:
        if text and (nodes or text.strip()):
            e = stack[-1][1] if stack else 0
            # of a header only the headings count
            nodes.append(Node(path_of[e], html.unescape(text), block, e, furniture[e] or (header[e] and not heading[e]), linked[e]))

    def close(wanted: str, barrier: frozenset[str]) -> None:
        place = max((places[t][-1] for t in wanted.split() if places[t]), default=-1)
        if place < 0 or any(places[t] and places[t][-1] > place for t in barrier):
            return
        while len(stack) > place:
            places[stack.pop()[0]].pop()

    while found := tags.next(at):
        begin, end, tag, attrs, closing, data = found
        add(page[at:begin] + data)
        at = end
        if not tag:
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCK:
            block += 1
        if closing:
            close(tag, frozenset())
            continue
        if tag in RAW and not attrs.endswith("/"):
            if tag not in ends:
                ends[tag] = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I)
            rest = ends[tag].search(page, at)
            if tag == "xmp":
                block += 1
                add(html.escape(page[at : rest.start() if rest else len(page)]))
                block += 1
            at = rest.end() if rest else len(page)
            continue
        if tag in UNSEEN and not attrs.endswith("/"):
            if tag not in nexts:
                nexts[tag] = re.compile(rf"<(/?){re.escape(tag)}(?![\w-])[^>]*>", re.I)
            if at < unended.get(tag, len(page) + 1):
                after = nexts[tag].search(page, at)
                if after is None:
                    unended[tag] = at
                elif after[1]:
                    at = after.end()
            continue
        if tag in BLOCK:
            close("p", BARRIER | {"li", "td", "th", "blockquote"})
        if tag in CLOSES:
            close(CLOSES[tag], frozenset(("ul", "ol", "dl", "table", "menu")))
        if tag in VOID or attrs.endswith("/"):
            continue
        above, e = stack[-1][1] if stack else 0, len(parent)
        attributes = [(n.lower(), a or b or c) for n, a, b, c in _ATTRIBUTE.findall(attrs) if n.lower() in _READ] if attrs else []
        out.body = out.body or (e if tag == "body" else 0)
        is_main = tag in ("article", "main") or any(n == "role" and v.lower() in MAIN_ROLES for n, v in attributes)
        own = _is_furniture(tag, attributes, in_main[above])
        coded.append(coded[above] or tag in ("pre", "code"))
        if not own and not coded[e] and _is_named_furniture(tag, attributes, is_main):
            words = [w.lower() for n, v in attributes if n in ("class", "id") for w in _WORD.findall(v)]
            out.named[e] = any(w in COMMENTS for w in words)
            if tag in ("section", "div") and SUBJECTS.issuperset(words):
                out.subject.add(e)
        if tag in HEADINGS:
            out.headed.add(above)
        if tag in ("form", "article") or (out.named.get(e) and e not in out.subject):
            out.answered.add(e)
        classes = ".".join(v for n, v in attributes if n == "class") if tag in CONTAINERS else ""
        path_of.append(paths.setdefault((path_of[above], f"{tag}.{classes}"), len(paths) + 1))
        parent.append(above)
        out.container.append(tag in CONTAINERS)
        out.main.append(is_main)
        furniture.append(own or furniture[above])
        header.append(header[above] or tag == "header")
        linked.append(linked[above] or tag == "a")
        heading.append(heading[above] or tag in HEADINGS)
        in_main.append(in_main[above] or (is_main and not furniture[e]))
        places[tag].append(len(stack))
        stack.append((tag, e))
    add(page[at:])
    return out


def path_scores(nodes: list[Node], sigma: float = 0.5) -> dict[int, float]:
    """Fused, smoothed ratio of text length and punctuation of every path without furniture.

    A path's ratios are text length and punctuation marks by text node.  Along
    the page they are smoothed with a Gaussian kernel and averaged again by
    path; the score is length times log2(2 + marks).
    """
    sums: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
    plain = [n for n in nodes if n.plain()]
    for n in plain:
        s = sums[n.path]
        s[0] += 1
        s[1] += len(n.text.strip())
        s[2] += len(_PUNCTUATION.findall(n.text))
    ratio = {p: (length / count, marks / count) for p, (count, length, marks) in sums.items()}
    reach = math.ceil(3 * sigma)
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    smooth: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
    series = [ratio[n.path] for n in plain]
    for i, n in enumerate(plain):
        lo, hi = max(0, i - reach), min(len(series), i + reach + 1)
        weights = kernel[lo - i + reach : hi - i + reach]
        total = sum(weights)
        s = smooth[n.path]
        s[0] += 1
        s[1] += sum(w * r[0] for w, r in zip(weights, series[lo:hi])) / total
        s[2] += sum(w * r[1] for w, r in zip(weights, series[lo:hi])) / total
    return {p: length / count * math.log2(2 + marks / count) for p, (count, length, marks) in smooth.items()}


def content_paths(scores: dict[int, float], strictness: float = 0.5) -> set[int]:
    """Paths whose score reaches ``strictness`` standard deviations, all of them if there is no spread."""
    if not scores:
        return set()
    mean = sum(scores.values()) / len(scores)
    spread = math.sqrt(sum((v - mean) ** 2 for v in scores.values()) / len(scores))
    return {p for p, v in scores.items() if v >= strictness * spread}


def _content(page: Page) -> dict[int, float]:
    """Content by the element that holds it: text of the nodes whose path passes, weighted by the path's score."""
    scores = path_scores(page.nodes)
    chosen = content_paths(scores)
    out: dict[int, float] = defaultdict(float)
    for n in page.nodes:
        if n.path in chosen and n.plain():
            out[n.element] += len(n.text.strip()) * scores[n.path]
    return out


def _overruled(page: Page) -> set[int]:
    """Elements of ``named`` that the content they hold shows to be no furniture.

    Those that hold more than half of the content of the article or main
    element around them, and those around the largest of these.  Outside of
    such elements, and for readers' comments, half of the page's content counts
    only if no article or main element has content beside named furniture.  A
    discussion (see ``SUBJECTS``) with a heading and content of its own, and
    without forms, articles and comments, is a part of the text around it.
    """
    own = _content(page)
    held, inside = page.held(own), page.below(page.named)
    beside = page.held({e: n for e, n in own.items() if not inside[e]})
    free = any(main and n for main, n in zip(page.main, beside))
    around = [0] * len(held)  # the innermost article or main element around each
    for e in range(1, len(held)):
        around[e] = page.parent[e] if page.main[page.parent[e]] else around[page.parent[e]]
    out = {e for e, comments in page.named.items() if 2 * held[e] > held[around[e]] and not (free and (comments or not around[e]))}
    answered = page.held(dict.fromkeys(page.answered, 1.0)) if page.subject else []
    out |= {e for e in page.subject if e in page.headed and held[e] and not answered[e] and (around[e] or not free)}
    longest = max((e for e, main in enumerate(page.main) if main and held[e] and e not in page.named), key=lambda e: (held[e], -e), default=0)
    while longest := page.parent[longest]:
        if longest in page.named:
            out.add(longest)
    return out


def _regions(page: Page) -> set[int]:
    """The elements that hold the content, to be taken whole.

    From the page down into whatever element holds ``ENTERED`` of the content,
    up to the first article or main element or the innermost container.  A body
    whose content lies in several containers (articles, say) and hardly beside
    them is these containers.
    """
    own = _content(page)
    held = page.held(own)
    below: dict[int, list[int]] = defaultdict(list)
    for e in range(1, len(held)):
        if held[e]:
            below[page.parent[e]].append(e)
    region = entered = 0
    wanted = ENTERED * held[0]
    while not page.main[region] and (step := max(below[region], key=held.__getitem__, default=0)) and held[step] >= wanted:
        region = step
        entered = region if page.container[region] else entered
    if entered not in (0, page.body):
        return {entered}
    containers, beside, todo = set(), 0, [entered]
    while todo:
        e = todo.pop()
        if e != entered and page.container[e] and e != page.body:
            containers.add(e)
        else:
            beside += own.get(e, 0)
            todo += below[e]
    return containers if containers and beside < held[0] - wanted else {entered}


def main_text(page: str | None) -> str:
    """The page's main text: blocks in page order, joined by two line feeds.

    Character references are decoded and white space inside a block (line
    breaks too) becomes one space.  Null, empty and text-free pages give an
    empty text; a page without tags is one block.
    """
    parsed = parse(page or "")
    nodes = parsed.nodes
    if parsed.named:
        left = parsed.below(parsed.named.keys() - _overruled(parsed))
        for n in nodes:
            n.furniture = n.furniture or left[n.element]
    regions = _regions(parsed)
    inside = parsed.below(regions)
    out: dict[int, list[Node]] = defaultdict(list)
    for n in nodes:
        if inside[n.element] and not n.furniture:
            out[n.block].append(n)
    blocks = sorted((b, " ".join("".join(n.text for n in out[b]).split())) for b in out)
    blocks = [(b, text) for b, text in blocks if text]
    if regions <= {0, parsed.body}:
        blocks = _without_menu(blocks, out)
    return "\n\n".join(text for _, text in blocks)


def _without_menu(blocks: list[tuple[int, str]], nodes: dict[int, list[Node]]) -> list[tuple[int, str]]:
    """Blocks of the whole page without a run of several blocks that are links only before all other text; a list of links at its end stays."""
    menu = [all(n.linked or n.text.isspace() for n in nodes[b]) for b, _ in blocks]
    if all(menu):
        return blocks
    first = menu.index(False)
    return blocks[first if first > 1 else 0 :]


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", carry: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per page: id, the ``carry`` columns, text, n_chars (code points).

    Works page by page where the pages lie; nothing is shuffled, and a page is
    never cut.  A null page has an empty text, rows that repeat are each
    returned, an empty table gives no rows, and columns that are neither the id,
    the page nor carried are not read, whatever their names.
    """
    names = (id_col, *carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch.column(len(names)).to_pylist()]
            columns = {n: batch.column(i) for i, n in enumerate(names)}
            yield pa.RecordBatch.from_pydict(columns | {"text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    schema = ", ".join(f"`{n}` {pages.schema[n].dataType.simpleString()}" for n in names)
    return pages.select(*names, F.col(html_col)).mapInArrow(run, f"{schema}, text string, n_chars bigint")

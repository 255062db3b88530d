"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element (and every inline element with a class or id) is a binary variable: does its subtree hold article
text? Parent-child potentials connect the variables along the tree, observed features hang on each; sum-product messages
go up and then down the tree, and text whose element has a content marginal of a half or more is kept. Potentials are
frequencies counted on labelled pages.
"""

import functools
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.words import slices

# Fixed values of HTML: element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style template noscript iframe svg math object canvas audio video select option textarea button title head".split())
RAW = frozenset("script style textarea title noscript iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("tr",), "tbody": ("thead", "tbody", "tr")}
SCOPES = frozenset("ul ol dl table article section div main body html nav aside td th".split())
# Words in class, id and role that hint at an element's part in the page.
HINTS = {
    "content": frozenset("article articlebody content entry post story main body text copy prose".split()),
    "boiler": frozenset("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer form gdpr header login masthead menu meta modal nav navbar navigation newsletter notice pagination popup promo recommended related reply replies respond search share sharing sidebar signup social sponsor sponsored sponsors subscribe tags toolbar widget".split())}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(!\[CDATA\[)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)(?:((?:[^<>"']++|"[^"<>]*"|'[^'<>]*')*+)>)?""", re.S)
_STOP = re.compile("[>\"']")
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|style|hidden|aria-hidden|data-y)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I | re.S)
_END_RAW = {t: re.compile(rf"</{t}\s*/?>", re.I) for t in RAW}
_WORD = re.compile(r"[a-z]+")


class Page:
    """Nodes in page order (a parent before its children), and the text runs with the node that each belongs to."""

    def __init__(self, html: str):
        self.tag, self.parent, self.hint, self.label = ["#"], [-1], ["none"], [None]
        self.runs: list[tuple[int, str]] = []  # "\n" marks a break between blocks
        self.chars, self.links, self.stops = [0], [0], [0]
        self.skip = 0  # open elements whose text doesn't count
        self._read(html)

    def _read(self, html: str) -> None:
        stack = [("#", 0, True)]  # element, node, is a node of its own
        self.places: dict[str, list[int]] = defaultdict(list)  # in the stack, of each kind of element
        self.blocks = [0]  # places of elements that aren't inline
        self.ends: dict[int, int] = {}  # of tags, by the quotes that open within them
        cdata = True  # a section may still end
        at = 0
        while at < len(html):
            m = _TAG.search(html, at)
            end = m.start() if m else len(html)
            if end > at and not self.skip:
                self._text(stack[-1][1], html[at:end], len(self.places["a"]))
            if not m:
                break
            at = m.end()
            if m[1]:
                end = html.find("]]>", at) if cdata else -1
                cdata = end >= 0
                at = end + 3 if cdata else html.find(">", at) + 1 or len(html)
            if m[3] is None:
                continue
            shut, name, attrs = m[2], m[3].lower(), m[4]
            if attrs is None:  # quotes that hold angle brackets, or don't close
                end = self._tag_end(html, at)
                attrs, at = html[at:end], end + 1
            if shut:
                place = self._last(name)
                if place and (name not in INLINE or place > self.blocks[-1]):
                    self._pop(stack, place, True)
                continue
            if name in RAW and not attrs.endswith("/"):
                done = _END_RAW[name].search(html, at)
                at = done.end() if done else len(html)
                continue
            if name not in INLINE:
                self.runs.append((stack[-1][1], "\n"))
            if name in VOID:
                continue
            self._close(stack, name)
            hint, label = self._hint(attrs)
            own = name not in INLINE or hint != "none" or label is not None
            node = stack[-1][1]
            if own and not self.skip and name not in DROPPED:
                node = len(self.tag)
                self.tag.append(name if name not in INLINE else "inline")
                self.parent.append(stack[-1][1])
                self.hint.append(hint)
                self.label.append(label)
                for x in (self.chars, self.links, self.stops):
                    x.append(0)
            if not attrs.endswith("/") or name not in ("path", "use", "g"):
                self.places[name].append(len(stack))
                if name not in INLINE:
                    self.blocks.append(len(stack))
                stack.append((name, node, own))
                self.skip += name in DROPPED

    def _tag_end(self, html: str, at: int) -> int:
        """Place of the ">" that ends the tag whose attributes begin there: the first outside of quotes, else the first.

        From an opening quote on, all tags end alike, so each quote is followed once.
        """
        opened, here, end = [], at, -1
        while m := _STOP.search(html, here):
            if m[0] == ">":
                end = m.start()
                break
            if m.start() in self.ends:
                end = self.ends[m.start()]
                break
            opened.append(m.start())
            here = html.find(m[0], m.end()) + 1
            if not here:
                break
        self.ends.update(dict.fromkeys(opened, end))
        if end < 0:
            end = html.find(">", at)
        return end if end >= 0 else len(html)

    def _last(self, *names: str) -> int:
        """Place in the stack of the innermost open element of these kinds; 0 if there is none."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def _pop(self, stack: list, to: int, breaks: bool = False) -> None:
        """Close the elements from the top of the stack to that place."""
        while len(stack) > to:
            name, node, _ = stack.pop()
            self.places[name].pop()
            self.skip -= name in DROPPED
            if name not in INLINE:
                self.blocks.pop()
                if breaks:
                    self.runs.append((node, "\n"))

    def _close(self, stack: list, name: str) -> None:
        """Close what the start of `name` implies."""
        wanted = ("p",) if name in CLOSES_P else ("head",) if name == "body" else CLOSED_BY.get(name, ())
        stops = ("td", "th", "table", *(SCOPES if name in CLOSED_BY else ()))
        while (place := self._last(*wanted)) and place >= self._last(*stops):
            self._pop(stack, place)
            if name in CLOSES_P:
                return

    def _hint(self, attrs: str) -> tuple[str, str | None]:
        found, label = set(), None
        if "=" not in attrs and "hidden" not in attrs.lower():
            return "none", None
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), (a or b or c).lower()
            if name == "data-y":
                label = value
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                found.add("hidden")
            elif name in ("class", "id", "role"):
                words = set(_WORD.findall(value))
                found |= {k for k, known in HINTS.items() if words & known}
        return "hidden" if "hidden" in found else "boiler" if "boiler" in found else "content" if found else "none", label

    def _text(self, node: int, text: str, linked: int) -> None:
        if "&" in text:
            text = unescape(text)
        self.runs.append((node, text))
        n = len(text) - text.count(" ") - text.count("\n")
        self.chars[node] += n
        self.links[node] += n * (linked > 0)
        self.stops[node] += text.count(".") + text.count(",") + text.count("!") + text.count("?")

    def features(self) -> list[tuple]:
        """Of each node: its own text, links, sentence marks and text in its subtree, in steps."""
        chars, links, stops = list(self.chars), list(self.links), list(self.stops)
        for i in range(len(self.tag) - 1, 0, -1):
            p = self.parent[i]
            chars[p] += chars[i]
            links[p] += links[i]
            stops[p] += stops[i]
        out = []
        for i in range(len(self.tag)):
            n = chars[i]
            out.append((("own", min(5, self.chars[i].bit_length() // 2)), ("links", 4 * links[i] // n if n else -1),
                        ("stops", min(4, 200 * stops[i] // n) if n else -1), ("all", min(5, n.bit_length() // 2))))
        return out

    def text(self, keep: list[bool]) -> str:
        """Kept runs, white space as one space, blocks joined by one space."""
        return " ".join("".join(t if keep[k] or t == "\n" else "" for k, t in self.runs).split())


# Elements by the part that they usually play.
GROUPS = {t: g for g, tags in {
    "text": "p pre blockquote dd dt figcaption address", "heading": "h1 h2 h3 h4 h5 h6", "list": "ul ol dl li", "table": "table thead tbody tfoot tr td th caption",
    "box": "div section figure fieldset hgroup center", "article": "article", "main": "main", "top": "# html body", "inline": "inline"}.items() for t in tags.split()}


class TreeModel:
    """Log potentials: of a child given its parent (by the kinds of both), and of each feature's value given the variable.

    A kind is an element's group and hint. Potentials of rare pairs of kinds lean on those of the child's kind, and these
    on the overall ones. Features of one element depend on each other, so their evidence is weighted.
    """

    def __init__(self, pages: list[Page], smoothing: float = 0.5, backing: float = 3.0, weight: float = 0.4):
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        total, self.weight = [0, 0], weight
        moves: list[Counter] = [Counter(), Counter(), Counter()]
        for page in pages:
            labels = [x == "1" for x in page.label]
            for i in range(len(labels) - 1, 0, -1):
                labels[page.parent[i]] |= labels[i]
            kinds = self.kinds(page)
            for i, feats in enumerate(page.features()):
                y, p = labels[i], page.parent[i]
                total[y] += 1
                seen[y].update(feats)
                if i:
                    for counts, key in zip(moves, ((), (kinds[i],), (kinds[p], kinds[i])), strict=True):
                        counts[(*key, labels[p], y)] += 1
        known = Counter(k for k, _ in set(seen[0]) | set(seen[1]))
        self.odds = {f: weight * (math.log((seen[1][f] + smoothing) / (total[1] + smoothing * known[f[0]])) - math.log((seen[0][f] + smoothing) / (total[0] + smoothing * known[f[0]]))) for f in set(seen[0]) | set(seen[1])}
        self.moves: dict[tuple, tuple] = {}
        for level, counts in enumerate(moves):
            for key in {k[:-2] for k in counts}:
                rows = []
                for a in (False, True):
                    n0, n1 = counts[(*key, a, False)], counts[(*key, a, True)]
                    back = math.exp(self.moves[key[1:]][a][1]) if level else 0.5
                    share = (n1 + backing * back) / (n0 + n1 + backing)
                    share = min(max(share, 1e-6), 1 - 1e-6)
                    rows.append((math.log(1 - share), math.log(share)))
                self.moves[key] = tuple(rows)

    @staticmethod
    def kinds(page: Page) -> list[tuple[str, str]]:
        return [(GROUPS.get(t, t), h) for t, h in zip(page.tag, page.hint, strict=True)]

    def marginals(self, page: Page) -> list[float]:
        """Content marginal of every node, by messages up and down the tree."""
        n, kinds, moves, odds = len(page.tag), self.kinds(page), self.moves, self.odds
        move = [((0.0, 0.0), (0.0, 0.0))] + [moves.get((kinds[page.parent[i]], kinds[i])) or moves.get((kinds[i],)) or moves[()] for i in range(1, n)]
        belief = [sum(odds.get(f, 0.0) for f in feats) for feats in page.features()]  # log odds, children's messages added
        up = [0.0] * n
        for i in range(n - 1, 0, -1):
            (a0, a1), (b0, b1) = move[i]
            up[i] = _add(b0, b1 + belief[i]) - _add(a0, a1 + belief[i])
            belief[page.parent[i]] += up[i]
        for i in range(1, n):  # a parent's belief is final before its children's
            (a0, a1), (b0, b1) = move[i]
            rest = belief[page.parent[i]] - up[i]
            belief[i] += _add(a1, b1 + rest) - _add(a0, b0 + rest)
        return [1 / (1 + math.exp(-max(-500.0, min(500.0, b)))) for b in belief]


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a)) if a - b < 700 else a


# ---------------------------------------------------------------- labelled pages


def labelled_page(rng: random.Random) -> str:
    """A made-up page whose article text stands in elements with data-y="1"."""
    def words(n: int) -> str:
        return " ".join("".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(n))

    def sentences(n: int) -> str:
        out = []
        for _ in range(n):
            w = words(rng.randint(1, 14)).capitalize()
            out.append(w.replace(" ", ", ", rng.randint(0, 2)) + rng.choice("...!?"))
        return " ".join(out)

    def y(tag: str, inner: str) -> str:
        return f'<{tag} data-y="1">{inner}' + (f"</{tag}>" if tag != "p" or rng.random() < 0.85 else "")

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{k}">{words(rng.randint(1, 3))}</a></li>' for k in range(n)) + "</ul>"

    def paragraph() -> str:
        size = rng.choice((1, 1, 2, 4, 8, 15, 60))
        text = sentences(size) if rng.random() < 0.85 else words(8 * size) if rng.random() < 0.5 else " ".join([words(1)] * (8 * size))
        if rng.random() < 0.3:
            text = rng.choice(("<b>", "<em>")) + text + rng.choice(("", "<br>"))
        if rng.random() < 0.2:
            text += f' <a href="/x">{words(2)}</a> ' + sentences(1)
        return y("p", text)

    def boiler(k: str) -> str:
        line = rng.choice((words(rng.randint(1, 8)), sentences(rng.randint(1, 4))))
        cls = lambda *names: rng.choice(("class", "id")) + f'="{rng.choice(names)}"'
        return {
            "nav": lambda: f"<nav {cls('menu', 'x', 'navbar')}>{links(rng.randint(2, 8))}</nav>",
            "menu": lambda: f"<div {cls('menu', 'navbar', 'top-nav', 'breadcrumbs')}>{links(rng.randint(2, 8))}</div>",
            "header": lambda: f"<header {cls('site', 'header', 'masthead')}><{rng.choice(('h1', 'div', 'p', 'h2'))}>{words(3)}</header>",
            "ad": lambda: f"<div {cls('ad', 'ads', 'advert', 'sponsored', 'banner', 'promo')}>{rng.choice((line, '<p>' + line + '</p>'))}</div>",
            "aside": lambda: f"<aside {cls('sidebar', 'related', 'widget')}><h3>{words(2)}</h3>{rng.choice((links(4), '<p>' + line + '</p>'))}</aside>",
            "side": lambda: f"<div {cls('sidebar', 'related', 'widget', 'recommended')}><h3>{words(2)}</h3>{rng.choice((links(4), '<p>' + line + '</p>'))}</div>",
            "notice": lambda: f"<div {cls('cookie-notice', 'consent', 'notice', 'cookie banner', 'gdpr')}><p>{line}</p></div>",
            "form": lambda: f"<form {cls('search', 'login', 'f', 'newsletter')}><label>{words(2)}</label><p>{line}</p><input><button>{words(1)}</button></form>",
            "signup": lambda: f"<div {cls('newsletter', 'subscribe', 'signup')}><p>{line}</p></div>",
            "share": lambda: f"<div {cls('share', 'social', 'tags')}>{links(3)}</div>",
            "comments": lambda: f"<{(t := rng.choice(('section', 'div')))} {cls('comments', 'comment-list', 'replies', 'disqus')}><h3>{words(2)}</h3>" + "".join(f"<div class=\"{rng.choice(('comment', 'reply', 'c'))}\"><p>{sentences(rng.randint(1, 6))}</p></div>" for _ in range(rng.randint(1, 5))) + f"</{t}>",
            "footer": lambda: f"<footer>{rng.choice(('&copy; ', ''))}{line}{rng.choice(('', links(3)))}</footer>",
            "foot": lambda: f"<div {cls('footer', 'copyright')}><p>{line}</p></div>",
            "hidden": lambda: f"<div {rng.choice(('hidden', 'style=\"display:none\"', 'aria-hidden=\"true\"'))}><p>{line}</p></div>",
        }[k]()

    inside = []
    for _ in range(rng.choice((0, 1, 1, 2, 3, 5, 9, 16))):
        kind = rng.random()
        if kind < 0.78:
            inside.append(paragraph())
        elif kind < 0.86:
            inside.append(y("h2", words(rng.randint(1, 6))))
        elif kind < 0.91:
            inside.append("<ul>" + "".join(y("li", sentences(1)) for _ in range(3)) + "</ul>")
        elif kind < 0.94:
            inside.append(f"<blockquote>{paragraph()}</blockquote>")
        elif kind < 0.96:
            inside.append("<table><tr>" + y("td", words(3)) + y("td", words(2)) + "</tr></table>")
        else:
            inside.append(y("pre", words(12)))
    if rng.random() < 0.05:  # an article of very many short paragraphs
        inside += [y("p", rng.choice((sentences(1), words(rng.randint(1, 4))))) for _ in range(rng.randint(40, 200))]
    if rng.random() < 0.85:
        inside.insert(0, y("h1", rng.choice((words(rng.randint(1, 9)), sentences(1)))))
    for k in ("ad", "share", "comments", "signup", "form", "side", "aside", "notice", "hidden"):
        if inside and rng.random() < 0.12:
            inside.insert(rng.randint(1, len(inside)), boiler(k))
    body = "".join(inside)
    if rng.random() < 0.25:
        body = f"<div class=\"{rng.choice(('content', 'entry-content', 'text', 'wrap', 'article-body'))}\">{body}</div>"
    shell = rng.random()
    if shell < 0.05:
        pass  # straight into what is around it
    elif shell < 0.6:
        body = f"<article>{body}</article>"
    elif shell < 0.8:
        body = f"<div class=\"{rng.choice(('content', 'post', 'story', 'entry', 'article'))}\">{body}</div>"
    else:
        body = f"<main>{body}</main>"
    if rng.random() < 0.3:
        body = f"<{(t := rng.choice(('main', 'div', 'section')))}>{body}</{t}>"
    before = [boiler(k) for k in ("header", "nav", "menu", "notice", "ad", "form", "hidden") if rng.random() < 0.4]
    after = [boiler(k) for k in ("aside", "side", "comments", "ad", "signup", "notice", "foot", "footer", "hidden") if rng.random() < 0.35]
    rng.shuffle(before)
    page = "".join([*before, body, *after])
    return f"<!DOCTYPE html><html><head><title>{words(4)}</title></head><body>{page}" + rng.choice(("</body></html>", ""))


_SECTION = re.compile(r"<(/?)(?:article|aside|footer|header|main|nav|section)\b[^>]*>")
_NAMED = re.compile(r' (?:class|id)="[^"]*"')


def plain_page(rng: random.Random) -> str:
    """A labelled page that names nothing: no class, no id, and plain boxes or layout tables for its sections."""
    start, end = ("<table><tr><td>", "</td></tr></table>") if rng.random() < 0.3 else ("<div>", "</div>")
    return _SECTION.sub(lambda m: end if m[1] else start, _NAMED.sub("", labelled_page(rng)))


@functools.cache
def trained_model(pages: int = 1000, plain: int = 300, seed: int = 7) -> TreeModel:
    """Trained on made-up pages, most with names that hint at an element's part and some (`plain`) without any."""
    rng = random.Random(seed)
    named = [Page(labelled_page(rng)) for _ in range(pages)]
    return TreeModel(named + [Page(plain_page(rng)) for _ in range(plain)])


def extract(html: str | None, model: TreeModel) -> str:
    if not html:
        return ""
    page = Page(html)
    if len(page.tag) == 1:  # no element at all: plain text
        return page.text([True])
    return page.text([m >= 0.5 for m in model.marginals(page)])


def extract_pages(pages: DataFrame, model: TreeModel | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row of pages.

    A null or empty html gives an empty text. Malformed markup is read as far as it goes: what looks like no tag is text,
    a page without elements is all text,
    unclosed elements end with their parent. Repeated rows give repeated results; further columns are dropped.
    """
    model = model or trained_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, urls, htmls in slices(b, 2):
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array([extract(x, model) for x in htmls], pa.string())], ["page_id", "url", "text"])

    return (pages.select(F.col(id_col).cast("long"), F.col(url_col), F.col(html_col)).mapInArrow(run, "page_id long, url string, text string")
            .withColumn("n_chars", F.length("text").cast("long")))

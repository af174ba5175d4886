"""A small block tree of a web page, its node features, and the decoding of node decisions.

Only block elements are nodes; inline ones belong to the text around them. Text directly in
an element that also has block children becomes a child of its own (tag ``#text``), so that
every leaf is one block of text and each decision is about whole blocks.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import numpy as np

# Fixed values of HTML: elements by what they are for.
DROPPED = "script style noscript template textarea svg iframe object canvas math title select audio video datalist".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
BLOCK = (
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption nav header footer aside "
    "form fieldset legend button label details summary address center menu dialog search hgroup ins hr input"
).split()
#: A start tag of the key closes open elements of these tags, up to the nearest of the barriers.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
KINDS = [["article", "main"], ["section"], ["div", "center"], ["p"], ["h1", "h2", "h3", "h4", "h5", "h6"], ["ul", "ol", "menu", "dl"], ["li", "dt", "dd"], ["nav"], ["header"], ["footer", "address"], ["aside"], ["form", "fieldset", "button", "label", "legend", "input", "search", "dialog"], ["table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"], ["blockquote", "pre", "figure", "figcaption"], ["body", "html"], ["#text"]]
#: Words in class, id, role and similar attributes by what they speak for.
WORDS = [
    "article content post entry story body text main maincontent articlebody blog page news prose read",
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager links toc skip tabs dropdown topbar",
    "footer foot copyright colophon legal bottom credits contentinfo",
    "header head masthead banner logo brand top hero title",
    "sidebar side aside widget widgets related recommended recommendations more popular trending complementary rail teaser also",
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted adsense dfp banner offer deal outbrain taboola",
    "comment comments reply replies discussion respond disqus commentlist thread feedback reader",
    "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup paywall message warning dialog toast announcement",
    "form search login signin register contact input poll survey",
    "share sharing social tags tag meta author byline follow print tools date categories category",
    "hidden none invisible offscreen",
]
_KIND = {t: i for i, names in enumerate(KINDS) for t in names}
_WORD = {}
for _i, _names in enumerate(WORDS):
    for _w in _names.split():
        _WORD.setdefault(_w, []).append(_i)
_BLOCK, _VOID = set(BLOCK), set(VOID)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(DROPPED) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>(?:(?<=/>)|.*?(?:</(?P=raw)\s*>|\Z))|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role|itemprop|aria-label|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SENTENCE = re.compile(r"[.!?,;:]")


def _attribute_words(attrs: str) -> tuple[int, ...]:
    found = []
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("hidden", "aria-hidden", "style"):
            if name == "hidden" or name == "aria-hidden" and value == "true" or "display:none" in value.replace(" ", "").lower():
                found.append(len(WORDS) - 1)
            continue
        for w in _SPLIT.findall(value):
            found += _WORD.get(w.lower(), ())
    return tuple(found)


class Page:
    """Nodes in document order (a node stands before its descendants) and the text of the leaves."""

    __slots__ = ("tags", "parents", "words", "texts", "links", "marks")

    def __init__(self, source: str):
        self.tags, self.parents, self.words = ["html"], [-1], [()]
        self.texts: list[str] = [""]
        self.links: list[int] = [0]
        self.marks: list[str] = [""]
        self._parse(source)

    def _add(self, tag: str, parent: int, words: tuple[int, ...], text: str = "", links: int = 0, mark: str = "") -> int:
        self.tags.append(tag)
        self.parents.append(parent)
        self.words.append(words)
        self.texts.append(text)
        self.links.append(links)
        self.marks.append(mark)
        return len(self.tags) - 1

    def _parse(self, source: str) -> None:
        stack, run, linked, in_link, at = [0], [], 0, False, 0
        known: dict[str, tuple[int, ...]] = {}

        def flush() -> None:
            nonlocal linked
            if run:
                text = " ".join(html.unescape("".join(run)).split())
                if text:
                    self._add("#text", stack[-1], (), text, min(linked, len(text)))
                run.clear()
            linked = 0

        for m in _TOKEN.finditer(source):
            if m.start() > at:
                piece = source[at : m.start()]
                run.append(piece)
                if in_link:
                    linked += len(piece)
            at = m.end()
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if tag == "a":
                in_link = not m["end"]
                continue
            if tag == "br":
                run.append(" ")
                continue
            if tag not in _BLOCK:
                continue
            flush()
            if m["end"]:
                if tag in self._open(stack):
                    while self.tags[stack.pop()] != tag:
                        pass
                    if not stack:
                        stack.append(0)
                continue
            if tag in ("html", "body"):
                if tag == "body" and len(stack) > 1:
                    continue
                if tag == "html":
                    continue
            if "p" in self._open(stack) and tag not in ("button", "label", "ins", "input"):
                i = max(k for k, n in enumerate(stack) if self.tags[n] == "p")
                if not any(self.tags[n] in ("button", "td", "th", "caption", "li") for n in stack[i:]):
                    del stack[i:]
            if tag in CLOSES:
                closed, barrier = CLOSES[tag]
                for k in range(len(stack) - 1, 0, -1):
                    name = self.tags[stack[k]]
                    if name in barrier:
                        break
                    if name in closed:
                        del stack[k:]
            attrs = m["attrs"]
            words = ()
            if attrs:
                words = known.get(attrs)
                if words is None:
                    words = known[attrs] = _attribute_words(attrs)
            node = self._add(tag, stack[-1], words, "", 0, attrs if "data-main" in attrs else "")
            if tag not in _VOID and not attrs.endswith("/"):
                stack.append(node)
        if at < len(source):
            run.append(source[at:])
        flush()

    def _open(self, stack: list[int]) -> list[str]:
        return [self.tags[n] for n in stack[1:]]


N_FEATURES = 2 * len(KINDS) + 3 * len(WORDS) + 36


def features(page: Page) -> np.ndarray:
    """A row per node: tag, attribute words of itself, its parent and all ancestors, subtree sizes and densities, depth,
    place, siblings; how much text it has beside its largest and its earlier siblings, on the way to the root too; the
    main heading; and what the page as a whole tells by its tags and attributes."""
    n = len(page.tags)
    parent = page.parents
    x = np.zeros((n, N_FEATURES), np.float32)
    kind = [_KIND.get(t, 2) for t in page.tags]
    chars, links, count = [len(t) for t in page.texts], list(page.links), [1] * n
    words = [t.count(" ") + 1 if t else 0 for t in page.texts]
    marks = [len(_SENTENCE.findall(t)) for t in page.texts]
    runs = [1 if t else 0 for t in page.texts]
    longest = list(words)
    paragraphs, items, heads, inputs = [int(k == 3) for k in kind], [int(k == 6) for k in kind], [int(k == 4) for k in kind], [int(k == 11) for k in kind]
    depth, before = [0] * n, [0] * n
    children: list[list[int]] = [[] for _ in range(n)]
    seen = 0
    for i in range(n):
        before[i] = seen
        seen += chars[i]
        if i:
            depth[i] = depth[parent[i]] + 1
            children[parent[i]].append(i)
    for i in range(n - 1, 0, -1):
        p = parent[i]
        for v in (chars, links, count, words, marks, runs, paragraphs, items, heads, inputs):
            v[p] += v[i]
        longest[p] = max(longest[p], longest[i])
    total = max(1, seen)
    a, w = len(KINDS), len(WORDS)
    for i in range(n):
        x[i, kind[i]] = 1
        for k in page.words[i]:
            x[i, 2 * a + k] += 1
        p = parent[i]
        if p >= 0:
            x[i, a : 2 * a] = x[p, a : 2 * a]
            x[i, a + kind[p]] = 1  # kinds of all ancestors
            x[i, 2 * a + w : 2 * a + 2 * w] = x[p, 2 * a : 2 * a + w]
            x[i, 2 * a + 2 * w : 2 * a + 3 * w] = np.maximum(x[p, 2 * a + 2 * w : 2 * a + 3 * w], x[p, 2 * a : 2 * a + w])
    log = math.log1p
    first = [int(t == "h1") for t in page.tags]
    for i in range(n - 1, 0, -1):
        first[parent[i]] += first[i]
    share, least, earlier, most_before, near_head = [1.0] * n, [1.0] * n, [0.0] * n, [0.0] * n, [0] * n
    for p, c in enumerate(children):
        largest, so_far = max((chars[i] for i in c), default=0), 0
        for i in c:
            share[i] = chars[i] / max(1, largest)
            least[i] = min(least[p], share[i])
            earlier[i] = log(so_far) - log(chars[i])
            most_before[i] = max(most_before[p], earlier[i]) if p else earlier[i]
            so_far = max(so_far, chars[i])
            near_head[i] = near_head[p] + 1 if first[i] else 0  # levels on which it has the main heading in it
    in_head = [0] * n
    for i in range(1, n):
        in_head[i] = max(in_head[parent[i]], near_head[i])
    told = sum(map(len, page.words))
    whole = (log(told), sum(k == 0 for k in kind), log(total), log(sum(t == "h1" for t in page.tags)))
    rows = []
    place = [0] * n
    alike = []  # for each parent, its children of each kind
    for c in children:
        for k, i in enumerate(c):
            place[i] = k
        alike.append(Counter(kind[i] for i in c))
    for i in range(n):
        p = max(parent[i], 0)
        sib = children[p] if i else [0]
        k = place[i]
        same = alike[p][kind[i]] if i else 1
        prev, nxt = sib[k - 1] if k else -1, sib[k + 1] if k + 1 < len(sib) else -1
        rows.append((
            log(chars[i]), log(words[i]), links[i] / max(1, chars[i]), log(count[i]), chars[i] / count[i] / 100, marks[i] / max(1, words[i]), log(paragraphs[i]), log(items[i]), log(heads[i]), log(inputs[i]),
            words[i] / max(1, runs[i]), log(longest[i]), depth[i], before[i] / total, chars[i] / total, chars[i] / max(1, chars[p]), k, len(sib), k / len(sib), same / len(sib),
            log(chars[prev]) if prev >= 0 else -1, log(chars[nxt]) if nxt >= 0 else -1, kind[prev] if prev >= 0 else -1, kind[nxt] if nxt >= 0 else -1, links[p] / max(1, chars[p]), log(paragraphs[p]), log(chars[p]),
            share[i], least[i], earlier[i], most_before[i], in_head[i], *whole,
        ))
    x[:, 2 * a + 3 * w :] = rows
    return x


def decode(parents: list[int], p: np.ndarray) -> np.ndarray:
    """The likeliest decisions of all nodes together such that a node is kept only if its parent is.

    One pass up takes for each node the best score of its subtree if it is kept and if not (then
    nothing below it is); one pass down reads the choice.
    """
    p = np.clip(p, 1e-4, 1 - 1e-4)
    keep, drop = np.log(p).tolist(), np.log(1 - p).tolist()
    for i in range(len(parents) - 1, 0, -1):
        keep[parents[i]] += max(keep[i], drop[i])
        drop[parents[i]] += drop[i]
    kept = np.zeros(len(parents), bool)
    for i, up in enumerate(parents):
        kept[i] = keep[i] > drop[i] and (up < 0 or kept[up])
    return kept

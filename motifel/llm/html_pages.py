"""Labelled pages to train the extractor on, written by a seeded generator.

Every page is a random layout: an article in one of many kinds of wrapper, with or without
telling tags and attributes, among menus, headers, sidebars, notices, adverts, forms, share
bars, reader comments and footers in any order and number. ``data-main`` marks what is article
(1) and what is not (0); the extractor never sees that attribute.
"""

from __future__ import annotations

import random

_PARTS = "ba ce di fo gu la me ni ro su ta ve xi za chor stin tion ment able er ing ed ou ré ön ía ß qua pre sta".split()


class Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(_PARTS) for _ in range(self.r.choice((1, 1, 2, 2, 3, 4))))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def prose(self, sentences: int) -> str:
        out = []
        for _ in range(sentences):
            s = self.words(1, 24).capitalize()
            if self.r.random() < 0.08:
                s += f' <a href="/{self.word()}">{self.words(1, 4)}</a> {self.word()}'
            if self.r.random() < 0.05:
                s = f"<b>{s}</b>"
            out.append(s + self.r.choice((".", ".", ".", "!", "?", ",", "", "%%% &amp;", "*** #")))
        return " ".join(out)

    def one(self, *of):
        return self.r.choice(of)

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def tag(self, name: str, inner: str, attrs: str = "", main: int | None = None) -> str:
        mark = "" if main is None else f' data-main="{main}"'
        return f"<{name}{attrs}{mark}>{inner}</{name}>"

    def attr(self, *names: str) -> str:
        return f' {self.one("class", "class", "id")}="{self.one(*names)}"' if names else ""

    # what is not article

    def links(self, low: int, high: int) -> str:
        item = [f'<a href="/{self.word()}">{self.words(1, 3)}</a>' for _ in range(self.r.randint(low, high))]
        form = self.r.random()
        if form < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in item) + "</ul>"
        return (" | " if form < 0.7 else " ").join(item) if form < 0.85 else "".join(f"<div>{x}</div>" for x in item)

    def menu(self) -> str:
        name, attrs = self.one(("nav", ""), ("nav", ""), ("nav", self.attr("nav", "main-nav", "navbar")), ("div", self.attr("nav", "menu", "navigation", "top-menu", "navbar-collapse")), ("div", ' role="navigation"'), ("div", ""), ("ul", self.attr("menu", "nav", "breadcrumbs")))
        inner = self.links(3, 12)
        return self.tag(name, inner.removeprefix("<ul>").removesuffix("</ul>") if name == "ul" else inner, attrs, 0)

    def banner(self) -> str:
        inner = self.tag(self.one("h1", "div", "p", "h2"), f'<a href="/">{self.words(1, 4)}</a>' if self.chance(0.5) else self.words(1, 6))
        if self.chance(0.5):
            inner += self.tag("p", self.words(2, 9))
        if self.chance(0.4):
            inner += self.menu()
        name, attrs = self.one(("header", ""), ("header", self.attr("header", "site-header")), ("div", self.attr("header", "masthead", "banner", "top", "site-header")))
        return self.tag(name, inner, attrs, 0)

    def advert(self) -> str:
        inner = self.one(self.prose(1), self.prose(2), self.words(2, 9), f'<a href="/{self.word()}">{self.words(2, 8)}</a>', self.tag("p", self.prose(2)))
        name, attrs = self.one(("div", self.attr("ad", "ads", "advert", "ad-slot", "sponsored", "promo", "banner-ad", "advertisement")), ("aside", self.attr("ad", "promo", "sponsor")), ("div", self.attr("ad", "ad-box")), ("section", self.attr("advertisement", "sponsored")), ("ins", self.attr("adsbygoogle ad")))
        return self.tag(name, inner, attrs, 0)

    def notice(self) -> str:
        inner = self.tag("p", self.prose(self.r.randint(1, 3))) + (self.tag("button", self.words(1, 2)) if self.chance(0.6) else "")
        name, attrs = self.one(("div", self.attr("cookie-banner", "cookie-notice", "consent", "gdpr", "alert", "notice", "newsletter", "popup", "modal", "subscribe-box")), ("section", self.attr("newsletter", "notice", "cookies")), ("aside", self.attr("newsletter", "notice")), ("dialog", ""))
        return self.tag(name, self.one(inner, self.prose(2)), attrs, 0)

    def form(self) -> str:
        fields = "".join(f'<label>{self.words(1, 3)}</label><input type="text" name="{self.word()}">' for _ in range(self.r.randint(1, 4)))
        return self.tag("form", f"{self.one('', self.tag('p', self.prose(1)))}{fields}<button>{self.words(1, 2)}</button>", self.one("", self.attr("search", "login", "contact")), 0)

    def sidebar(self) -> str:
        inner = "".join(self.one(self.tag(self.one("h2", "h3", "h4"), self.words(1, 4)) + self.links(3, 9), self.tag("p", self.prose(self.r.randint(1, 4))), self.advert(), self.tag("div", self.tag("h4", self.words(1, 3)) + self.tag("p", self.prose(2)), self.attr("widget"))) for _ in range(self.r.randint(1, 4)))
        name, attrs = self.one(("aside", ""), ("aside", self.attr("sidebar", "side")), ("div", self.attr("sidebar", "side-col", "widgets", "rail", "sidebar-right", "related", "related-posts", "more-stories")), ("section", self.attr("related", "sidebar", "recommended")))
        return self.tag(name, inner, attrs, 0)

    def share(self) -> str:
        return self.tag(self.one("div", "ul", "p"), " ".join(f'<a href="/{self.word()}">{self.word()}</a>' for _ in range(self.r.randint(2, 6))), self.attr("share", "social", "share-bar", "tags", "post-tags"), 0)

    def comments(self) -> str:
        each = []
        name = self.one("div", "li", "article", "section")
        for _ in range(self.r.randint(1, 6)):
            body = "".join(self.tag("p", self.prose(self.r.randint(1, 4))) for _ in range(self.r.randint(1, 2))) if self.chance(0.7) else self.prose(2)
            who = self.tag(self.one("div", "h4", "b", "p"), self.words(1, 3), self.one("", self.attr("author", "comment-author", "meta")))
            each.append(self.tag(name, (who if self.chance(0.8) else "") + body, self.one("", self.attr("comment", "reply", "comment-body"))))
        inner = "".join(each)
        if name == "li":
            inner = self.tag("ol", inner, self.one("", self.attr("comment-list", "commentlist")))
        head = self.tag(self.one("h2", "h3"), self.words(1, 3)) if self.chance(0.7) else ""
        name, attrs = self.one(("section", self.attr("comments", "discussion")), ("div", self.attr("comments", "comment-section", "comment-thread", "disqus_thread", "replies", "reader-comments", "responses comments")))
        return self.tag(name, head + inner + (self.form() if self.chance(0.4) else ""), attrs, 0)

    def footer(self) -> str:
        inner = self.one(f"&copy; {self.word()}.example.com &middot; {self.prose(1)}", self.tag("p", f"&copy; {self.prose(self.r.randint(1, 3))}"), self.links(3, 10) + self.tag("p", self.words(2, 12)), f"&copy; {self.words(1, 6)}")
        name, attrs = self.one(("footer", ""), ("footer", ""), ("footer", self.attr("footer", "site-footer")), ("div", self.attr("footer", "site-footer", "copyright", "bottom", "legal")))
        return self.tag(name, inner, attrs, 0)

    # what is

    def article(self) -> str:
        out = []
        if self.chance(0.85):
            out.append(self.tag(self.one("h1", "h1", "h2"), self.words(2, 12)))
        for _ in range(self.one(1, 2, 3, 4, 5, 6, 8, 12)):
            form = self.r.random()
            if form < 0.76:
                text = self.prose(self.one(1, 1, 2, 3, 5, 9)) if self.chance(0.9) else self.words(1, 3) + "."
                if self.chance(0.06):
                    text = " ".join([self.word()] * self.r.randint(10, 60))  # monotonous, but article all the same
                out.append(self.one(f"<p>{text}", self.tag("p", text), self.tag("p", text), self.tag("p", text), self.tag("p", f"<b>{text}<br>"), f"<p><b>{text}<br>"))
            elif form < 0.82:
                out.append(self.tag(self.one("h2", "h3"), self.words(1, 8)))
            elif form < 0.87:
                out.append(self.tag(self.one("ul", "ol"), "".join(self.tag("li", self.prose(1)) for _ in range(self.r.randint(2, 6)))))
            elif form < 0.9:
                out.append(self.tag("blockquote", self.one(self.prose(2), self.tag("p", self.prose(2)))))
            elif form < 0.93:
                rows = "".join("<tr>" + "".join(self.tag("td", self.words(1, 3)) for _ in range(3)) + "</tr>" for _ in range(self.r.randint(2, 5)))
                out.append(self.tag("table", rows))
            elif form < 0.95:
                out.append(self.tag("figure", f'<img src="x.png">{self.tag("figcaption", self.words(3, 12))}'))
            elif form < 0.97:
                out.append(self.tag("pre", self.words(5, 30)))
            else:
                out.append(self.tag("div", self.prose(3)))
        for extra in (self.advert, self.share, self.notice, self.sidebar, self.form):
            if self.chance(0.08):
                out.insert(self.r.randint(1, len(out)), extra())
        body = "".join(out)
        if self.chance(0.08):
            body = self.prose(4) + "<br><br>" + self.prose(3)  # text without paragraphs
        for _ in range(self.one(0, 0, 1)):
            body = self.tag("div", body, self.one("", self.attr("content", "entry-content", "post-body", "text", "article-body", "row", "col-8", "inner")))
        name, attrs = self.one(("article", ""), ("article", ""), ("article", self.attr("post", "article")), ("main", ""), ("div", self.attr("content", "post", "article", "main", "entry", "story", "main-content", "page-content", "body-text")), ("section", self.attr("content", "article")), ("div", ""), ("div", self.attr("c1", "x9", "box", "col")))
        if self.chance(0.3):
            return self.tag(self.one("main", "div"), self.tag(name, body, attrs), self.one("", self.attr("main", "wrapper", "container", "content")), 1)
        return self.tag(name, body, attrs, 1)

    def page(self) -> str:
        top = [f() for f, p in ((self.notice, 0.2), (self.banner, 0.45), (self.menu, 0.65), (self.form, 0.15), (self.advert, 0.35)) if self.chance(p)]
        self.r.shuffle(top)
        side = [self.sidebar()] if self.chance(0.35) else []
        after = [f() for f, p in ((self.share, 0.15), (self.comments, 0.4), (self.advert, 0.2), (self.sidebar, 0.15), (self.notice, 0.12)) if self.chance(p)]
        middle = [*side, self.article()] if self.chance(0.4) else [self.article(), *side]
        body = middle + after
        for _ in range(self.one(0, 0, 1, 2)):
            body = [self.tag(self.one("div", "div", "section", "main"), "".join(body), self.one("", self.attr("wrapper", "container", "page", "site", "row", "layout")))]
        body = top + body + ([self.footer()] if self.chance(0.8) else [])
        gap = self.one("", "", "\n", "\n  ", "<!-- ad -->")
        head = f"<head><meta charset=\"utf-8\"><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style><script>var a=\"</p>\";</script></head>"
        end = self.one("</body></html>", "</body></html>", "")
        return f"<!DOCTYPE html><html>{head}<body>{gap.join(body)}{end}"


def pages(n: int, seed: int = 11) -> list[str]:
    return [Writer(seed * 1_000_003 + i).page() for i in range(n)]

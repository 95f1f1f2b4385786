"""Labelled web pages to learn extraction from: made from a grammar of page parts, since no table of pages has labels.

A page is a random choice of layout, tags, class names and markup habits. What belongs to its main text lies in elements with
the attribute MARK; users can mark pages of their own in the same way.
"""

from __future__ import annotations

import random

#: An element with MARK="1" holds main text, one with MARK="0" doesn't; the innermost one counts.
MARK = "data-main"

#: Names in use on the web for the parts of a page: tags, and words of class or id.
CONTENT = (("article", ""), ("main", ""), ("div", "content"), ("div", "article body"), ("section", "post"), ("div", "entry content"), ("div", "story text"), ("main", "page content"), ("article", "post"))
MENU = (("nav", ""), ("nav", "menu"), ("ul", "menu"), ("div", "navbar"), ("div", "nav"), ("ol", "breadcrumb"), ("div", "navigation"))
HEADER = (("header", ""), ("header", "site header"), ("div", "header"), ("div", "masthead"), ("div", "top bar"))
FOOTER = (("footer", ""), ("footer", "site footer"), ("div", "footer"), ("div", "copyright"), ("div", "legal"))
SIDEBAR = (("aside", ""), ("aside", "sidebar"), ("div", "sidebar"), ("div", "widget"), ("div", "related"), ("div", "recommended"), ("section", "most read"))
NOTICE = (("div", "cookie notice"), ("div", "cookie"), ("div", "consent"), ("div", "notice"), ("div", "alert"), ("div", "newsletter"), ("div", "paywall"), ("dialog", ""), ("section", "subscribe"), ("div", "popup"), ("div", "banner"))
ADVERT = (("div", "ad"), ("div", "ads"), ("aside", "ad"), ("div", "advert"), ("div", "advertisement"), ("div", "sponsored"), ("section", "promo"), ("ins", "adsbygoogle"), ("div", "ad slot"), ("p", "ad"))
FORM = (("form", ""), ("form", "search"), ("form", "signup"), ("div", "login form"))
COMMENTS = (("section", "comments"), ("div", "comments"), ("div", "comment list"), ("ol", "comments"), ("div", "disqus"), ("section", "responses"), ("div", "discussion comments"))
SHARE = (("div", "share"), ("div", "social"), ("ul", "tags"), ("div", "author meta"), ("div", "pagination"))
SYLLABLES = ("ta", "ren", "o", "vi", "sel", "mar", "é", "ko", "ung", "li", "st", "er", "pa", "ño", "ch", "ü", "de", "al", "qu", "in")


class Page:
    """One page drawn from the grammar."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.open_ends = self.rng.random() < 0.4  # leaves out closing tags as many pages do
        self.plain_names = self.rng.random() < 0.25  # names that say nothing
        self.junk = self.rng.choice(("### ", "&amp;&amp;&amp; ", "*** ", " | ", "%%% ", "$ ")) if self.rng.random() < 0.15 else ""  # between words
        self.capital = self.rng.choice((0.05, 0.3, 0.6, 0.95))  # share of links with a capital

    def word(self) -> str:
        return "".join(self.rng.choice(SYLLABLES) for _ in range(self.rng.choice((1, 1, 2, 2, 3, 4))))

    def words(self, least: int, most: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(least, most)))

    def prose(self, least: int, most: int) -> str:
        """Sentences, at times with inline markup, junk marks or one word alone."""
        left, out = self.rng.randint(least, most), []
        while left > 0:
            n = min(left, self.rng.randint(1, 18))
            out.append(self.words(n, n).capitalize() + self.rng.choice("....?!"))
            left -= n
        if self.rng.random() < 0.15:
            at = self.rng.randrange(len(out))
            out[at] = self.rng.choice((f"<b>{out[at]}</b>", f'<a href="/x">{out[at]}</a>', f"<em>{out[at]}</em>", f"<b>{out[at]}"))
        return " ".join(s.replace(" ", self.junk) if self.junk and "<a" not in s else s for s in out)

    def label(self, least: int, most: int) -> str:
        """Words of a link, a heading or a button."""
        text = self.words(least, most)
        return text.capitalize() if self.rng.random() < self.capital else text.title() if self.rng.random() < 0.1 else text

    def names(self, names: str) -> str:
        if not names or (self.plain_names and self.rng.random() < 0.8):
            return self.rng.choice(("", ' class="c7"', ' id="x1"'))
        return f' {self.rng.choice(("class", "class", "id"))}="{names.replace(" ", self.rng.choice((" ", "-", "_")))}"'

    def inside(self, kind: tuple, html: str, mark: str = "") -> str:
        tag, names = self.rng.choice(kind)
        return f"<{tag}{self.names(names)}{mark}>{html}</{tag}>"

    def item(self, tag: str, html: str) -> str:
        return f"<{tag}>{html}" + ("" if self.open_ends and self.rng.random() < 0.5 else f"</{tag}>")

    def links(self, least: int = 2, most: int = 9) -> str:
        items = "".join(self.item("li", f'<a href="/{i}">{self.label(1, 4)}{self.rng.choice(("", "", "", "", ",", "."))}</a>') for i in range(self.rng.randint(least, most)))
        return f"<ul>{items}</ul>" if self.rng.random() < 0.8 else " | ".join(f'<a href="/{i}">{self.label(1, 3)}</a>' for i in range(4))

    def block(self) -> str:
        """A piece of main text."""
        x = self.rng.random()
        if x < 0.72:
            return self.item("p", self.prose(1, self.rng.choice((2, 20, 60, 90))) + self.rng.choice(("", "", "", "<br>")))
        if x < 0.8:
            return f"<h{n}>{self.label(1, 9)}</h{n}>" if (n := self.rng.randint(2, 4)) else ""
        if x < 0.87:
            return "<ul>" + "".join(self.item("li", self.prose(2, 25)) for _ in range(self.rng.randint(2, 5))) + "</ul>"
        if x < 0.91:
            return f"<blockquote>{self.prose(5, 40)}</blockquote>"
        if x < 0.94:
            return f"<pre>{self.words(3, 30)}</pre>"
        if x < 0.97:
            return "<table>" + "".join("<tr>" + "".join(self.item("td", self.words(1, 3)) for _ in range(3)) for _ in range(self.rng.randint(1, 4))) + "</table>"
        return f"<div>{self.prose(3, 60)}</div>"

    def aside(self) -> str:
        """Something else inside the main text."""
        return self.rng.choice((self.advert, self.share, self.sidebar, self.notice))()

    def main(self) -> str:
        title = f"<h1>{self.label(1, 12) if self.rng.random() < 0.5 else self.prose(1, 12)}</h1>"
        if self.rng.random() < 0.15:
            title = f"<header>{title}</header>"
        parts = [self.block() for _ in range(self.rng.choice((1, 2, 4, 8, 14)))]
        if self.rng.random() < 0.3:
            parts.insert(self.rng.randrange(len(parts) + 1), self.aside())
        body = (title if self.rng.random() < 0.85 else "") + "".join(parts)
        mark = f' {MARK}="1"'
        if self.rng.random() < 0.1:
            return f"<div{mark}>{body}</div>"
        return self.inside(CONTENT, body, mark) if self.rng.random() < 0.8 else self.inside(CONTENT, self.inside(CONTENT, body), mark)

    def other(self, kind: tuple, html: str) -> str:
        return self.inside(kind, html, f' {MARK}="0"')

    def menu(self) -> str:
        return self.other(MENU, self.links())

    def header(self) -> str:
        return self.other(HEADER, self.rng.choice((f"<h1>{self.label(1, 3)}</h1>", f"<p>{self.words(1, 6)}</p>", f'<a href="/">{self.label(1, 2)}</a>')) + self.rng.choice(("", self.links(), f"<p>{self.prose(3, 9)}</p>")))

    def footer(self) -> str:
        return self.other(FOOTER, self.rng.choice(("&copy; 2020 ", "", "&copy; ")) + self.words(1, 3) + self.rng.choice((" &middot; ", " | ", " ")) + self.prose(1, 14) + self.rng.choice(("", self.links(1, 4))))

    def sidebar(self) -> str:
        return self.other(SIDEBAR, f"<h3>{self.label(1, 4)}</h3>" + self.rng.choice((self.links(), f"<p>{self.prose(4, 30)}</p>")))

    def notice(self) -> str:
        return self.other(NOTICE, self.rng.choice((f"<p>{self.prose(4, 40)}</p>", self.prose(4, 30))) + self.rng.choice(("", f"<button>{self.label(1, 2)}</button>")))

    def advert(self) -> str:
        return self.other(ADVERT, self.rng.choice((self.prose(2, 25), self.prose(2, 25), f'<a href="/a">{self.label(2, 9)}</a>')))

    def form(self) -> str:
        return self.other(FORM, f"<label>{self.label(1, 3)}</label><input name=q>" + self.rng.choice((f"<p>{self.prose(3, 20)}</p>", "")) + f"<select><option>{self.word()}<option>{self.word()}</select><button>{self.label(1, 2)}</button>")

    def comments(self) -> str:
        each = [f'<div{self.names("comment")}><b>{self.label(1, 2)}</b><p>{self.prose(1, 60)}</p><a href="#">{self.word()}</a></div>' for _ in range(self.rng.randint(1, 5))]
        return self.other(COMMENTS, f"<h3>{self.label(1, 3)}</h3>" + "".join(each))

    def share(self) -> str:
        return self.other(SHARE, self.links(1, 5))

    def html(self) -> str:
        likely = lambda part, share: part() if self.rng.random() < share else ""
        top = [likely(self.header, 0.5), likely(self.menu, 0.8), likely(self.notice, 0.3), likely(self.advert, 0.5), likely(self.form, 0.2), likely(self.sidebar, 0.2)]
        end = [likely(self.share, 0.3), likely(self.comments, 0.35), likely(self.sidebar, 0.4), likely(self.advert, 0.3), likely(self.form, 0.2), likely(self.notice, 0.2), likely(self.footer, 0.85)]
        if self.rng.random() < 0.3:
            self.rng.shuffle(top)
        body = "".join(top) + self.main() + "".join(end)
        if self.rng.random() < 0.3:
            body = f'<div{self.names("wrapper")}>{body}</div>'
        return f"<html><head><title>{self.words(1, 5)}</title><style>p{{}}</style></head><body>{body}</body></html>"


def pages(number: int, seed: int = 0) -> list[str]:
    """number pages, the same for the same seed."""
    return [Page(seed * 1_000_003 + i).html() for i in range(number)]

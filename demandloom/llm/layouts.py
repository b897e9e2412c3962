"""Labelled pages to learn from: known layouts filled with the words of a corpus.

Each page is written from parts whose role is known, so every one of its blocks has its label. Layouts
differ in elements, class names, nesting, order and in what authors leave out; a share of
them has no class names or no elements of HTML 5 at all, so that no single sign decides.
"""

from __future__ import annotations

import random
from html import escape

# Names that authors give to parts of a page.
MAIN = "content main-content article-body articleBody post post-content entry-content story-text body-copy page-content blog-post text prose".split()
WRAP = "wrapper container row col-md-8 page site layout inner grid outer column left center".split()
MENU = "menu nav navbar main-menu topnav site-nav breadcrumb breadcrumbs pagination toc skip-links dropdown".split()
HEAD = "header site-header masthead top topbar branding logo banner-top".split()
SIDE = "sidebar side right-column widget widget-area rail secondary related related-posts recommended trending recent-posts tags tag-cloud share social author-bio more-stories".split()
ADVERT = "ad ads advert advertisement ad-slot adsbygoogle sponsor sponsored promo promotion banner teaser-ad commercial".split()
NOTICE = "notice cookie cookie-banner cookie-consent gdpr alert popup modal newsletter newsletter-signup subscribe paywall disclaimer overlay".split()
COMMENT = "comments comment comment-list commentlist comment-body reader-comments discussion disqus_thread responses replies".split()
FOOT = "footer site-footer bottom copyright colophon legal foot".split()
FORM = "search search-form login contact-form signup feedback".split()
NEUTRAL = "Box -box Wrap -wrap -area Block -item __inner Section".split()


class _Writer:
    def __init__(self, words: list[str], seed: int):
        self.rng = random.Random(seed)
        self.words = words
        self.labels: list[bool] = []
        self.named = self.rng.random() < 0.8  # class names
        self.modern = self.rng.random() < 0.8  # elements of HTML 5
        self.loose = self.rng.random() < 0.4  # end tags left out

    def chance(self, share: float) -> bool:
        return self.rng.random() < share

    def some(self, low: int, high: int) -> str:
        return escape(" ".join(self.rng.choice(self.words) for _ in range(self.rng.randint(low, high))))

    def sentence(self, low: int, high: int) -> str:
        text = self.some(low, high)
        return text[:1].upper() + text[1:].rstrip(".,") + self.rng.choice("....?!")

    def prose(self) -> str:
        size = self.rng.choice((1, 1, 2, 3, 5, 9))
        parts = [self.sentence(1, 4) if self.chance(0.15) else self.sentence(3, 22) for _ in range(size)]
        if self.chance(0.2):
            parts.insert(self.rng.randrange(len(parts) + 1), f'<a href="#">{self.some(1, 4)}</a>')
        if self.chance(0.2):
            at = self.rng.randrange(len(parts))
            parts[at] = f"<b>{parts[at]}" + ("" if self.loose else "</b>")
        return self.rng.choice((" ", "\n", " <br> ")).join(parts)

    def block(self, tag: str, text: str, main: bool, end: bool = True, more: str = "") -> str:
        self.labels.append(main)
        return f"<{tag}{more}>{text}" + (f"</{tag}>" if end else "")

    def one_of(self, names: list[str]) -> str:
        """A name, now and then with a neutral part behind it."""
        name = self.rng.choice(names)
        return name + self.rng.choice(NEUTRAL) if self.chance(0.3) else name

    def around(self, tag: str, names: list[str], inside: str, share: float = 0.85) -> str:
        if not self.modern and tag in ("article", "main", "nav", "aside", "footer", "header", "section"):
            tag = "div"
        more = ""
        if self.named and self.chance(share):
            name = self.one_of(names)
            more = self.rng.choice((f' class="{name}"', f' id="{name}"', f' class="{name} {self.rng.choice("abcd")}{self.rng.randrange(99)}"'))
        return f"<{tag}{more}>\n{inside}</{tag}>"

    def links(self, low: int, high: int) -> str:
        items = [self.block("li", f'<a href="/{i}">{self.some(1, 5)}</a>', False, not self.loose) for i in range(self.rng.randint(low, high))]
        return "<ul>" + "".join(items) + "</ul>"

    def article(self, insert: bool) -> str:
        """Main text; with ``insert``, parts of others between its paragraphs."""
        parts = []
        if self.chance(0.9):
            title = self.block("h1", self.sentence(2, 14) if self.chance(0.5) else self.some(2, 14), True)
            parts.append(f"<header>{title}</header>" if self.modern and self.chance(0.15) else title)
        for _ in range(self.rng.choice((1, 2, 4, 7, 12, 20))):
            kind = self.rng.random()
            if kind < 0.74:
                tag = "p" if self.chance(0.95) else "div"
                parts.append(self.block(tag, self.prose(), True, tag == "div" or not self.loose))
            elif kind < 0.82:
                parts.append(self.block(self.rng.choice(("h2", "h3")), self.some(1, 8), True))
            elif kind < 0.9:
                items = [self.block("li", self.sentence(2, 15), True, not self.loose) for _ in range(self.rng.randint(2, 5))]
                parts.append("<ul>" + "".join(items) + "</ul>")
            elif kind < 0.94:
                parts.append(self.block("blockquote", self.prose(), True))
            elif kind < 0.97:
                parts.append("<table><tr>" + "".join(self.block("td", self.some(1, 5), True) for _ in range(4)) + "</tr></table>")
            else:
                parts.append("<figure><img src=x>" + self.block("figcaption", self.sentence(3, 12), True) + "</figure>")
            if insert and self.chance(0.25):
                parts.append(self.rng.choice((self.advert, self.related, self.notice, self.form))())
        return "\n".join(parts)

    def menu(self) -> str:
        return self.around("nav", MENU, self.links(2, 9))

    def head(self) -> str:
        inside = self.block(self.rng.choice(("div", "p", "h2")), self.some(1, 4), False)
        if self.chance(0.4):
            inside += self.block("p", self.sentence(2, 8), False)
        return self.around("header", HEAD, inside + (self.links(2, 6) if self.chance(0.5) else ""), 1.0 if not self.modern else 0.7)

    def advert(self) -> str:
        if self.chance(0.5):
            more = f' class="{self.one_of(ADVERT)}"'
            return self.block("div", " ".join(self.sentence(2, 14) for _ in range(self.rng.randint(1, 3))), False, True, more)
        inside = self.block("p", self.sentence(3, 14), False) + (self.block("p", f'<a href="#">{self.some(1, 5)}</a>', False) if self.chance(0.4) else "")
        return f'<div class="{self.one_of(ADVERT)}">{inside}</div>'

    def notice(self) -> str:
        inside = self.block("p", " ".join(self.sentence(3, 16) for _ in range(self.rng.randint(1, 3))), False)
        if self.chance(0.6):
            inside += self.block("button", self.some(1, 3), False)
        return f'<div class="{self.one_of(NOTICE)}">{inside}</div>'

    def related(self) -> str:
        inside = self.block(self.rng.choice(("h2", "h3", "h4")), self.some(1, 3), False) + self.links(2, 7)
        if self.chance(0.4):
            inside += self.block("p", self.sentence(4, 25), False)
        return self.around("aside", SIDE, inside, 1.0)

    def form(self) -> str:
        inside = self.block("label", self.some(1, 3), False) + "<input name=q>"
        if self.chance(0.3):
            inside += "<select>" + "".join(self.block("option", self.some(1, 2), False) for _ in range(3)) + "</select>"
        if self.chance(0.3):
            inside = self.block("p", self.sentence(3, 14), False) + inside
        return self.around("form", FORM, inside + self.block("button", self.some(1, 2), False), 0.6)

    def comments(self) -> str:
        inside = self.block(self.rng.choice(("h2", "h3")), self.some(1, 3), False)
        tag = self.rng.choice(("div", "li", "article" if self.modern else "div"))
        for _ in range(self.rng.randint(1, 5)):
            one = self.block("p", self.prose(), False, not self.loose)
            if self.chance(0.5):
                one = self.block("div", self.some(1, 3), False, True, ' class="author"') + one
            inside += f'<{tag} class="{self.one_of(COMMENT)}">{one}</{tag}>'
        return f'<{"section" if self.modern else "div"} id="{self.one_of(COMMENT)}">{inside}</{"section" if self.modern else "div"}>'

    def foot(self) -> str:
        text = self.rng.choice(("&copy; ", "© ", "&copy; 2024 ", "")) + self.some(1, 3) + self.rng.choice((" &middot; ", " | ", " ")) + self.sentence(2, 14)
        if self.chance(0.6):
            self.labels.append(False)
            inside = text
        else:
            inside = self.links(1, 6) + self.block("p", text, False)
        return self.around("footer", FOOT, inside, 1.0 if not self.modern else 0.5)

    def page(self) -> str:
        body, bare = [], self.chance(0.12)  # bare: nothing but the article
        for part, share in ((self.notice, 0.15), (self.head, 0.4), (self.menu, 0.8), (self.advert, 0.35), (self.form, 0.15), (self.related, 0.2)):
            if not bare and self.chance(share):
                body.append(part())
        inside = self.article(not bare and self.chance(0.6))
        if not bare and self.chance(0.15):
            inside += self.comments()
        wraps = self.rng.choice(("article", "article", "article", "main", "div", "div", "section", "both", "none"))
        if wraps == "both":
            inside = self.around("main", MAIN, self.around("article", MAIN, inside, 0.3), 0.3)
        elif wraps != "none":
            inside = self.around(wraps, MAIN, inside, 0.4 if wraps in ("article", "main") else 0.95)
        body.append(inside)
        for part, share in ((self.comments, 0.25), (self.related, 0.25), (self.form, 0.15), (self.advert, 0.2), (self.notice, 0.15), (self.foot, 0.85)):
            if not bare and self.chance(share):
                body.append(part())
        whole = "\n".join(body) if self.chance(0.5) else "".join(body)
        for _ in range(self.rng.choice((0, 0, 1, 2))):
            whole = self.around("div", WRAP, whole)
        lead = f"<!DOCTYPE html><html><head><title>{self.some(2, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>"
        return lead + "<!-- x -->" + whole + ("" if self.chance(0.2) else "</body></html>")


def labelled_page(words: list[str], seed: int) -> tuple[str, list[bool]]:
    """A page, and for each of its leaf blocks whether it is main text. The same for the same words and seed."""
    writer = _Writer(words, seed)
    # labels come in the order of writing, which is page order but for parts written inside out
    page = writer.page()
    return page, writer.labels

"""Labelled pages to train the extractor on: made from random words and the page layouts that are common on the web.

Each page is a list of (html, label) pieces in page order; label is 1 for a block of the article, 0 for a block of anything
else, None for markup without text.
"""

from __future__ import annotations

import random

# Words that layouts are named by, and that notices, forms and footers are written in.
ARTICLE_NAMES = ("content", "post", "entry", "article", "body", "story", "text", "main", "page")
SIDE_NAMES = ("sidebar", "side", "widget", "related", "aside", "promo", "recommended", "rail")
AD_NAMES = ("ad", "ads", "advert", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo")
MENU_NAMES = ("nav", "menu", "navbar", "breadcrumb", "breadcrumbs", "links", "topbar", "pagination", "tags", "share", "social")
NOTICE_NAMES = ("cookie", "notice", "consent", "popup", "modal", "newsletter", "subscribe", "alert", "banner", "gdpr", "overlay", "paywall")
COMMENT_NAMES = ("comment", "comments", "reply", "replies", "discussion", "disqus", "respond", "response", "responses")
HEADER_NAMES = ("header", "masthead", "top", "logo", "branding")
FOOTER_NAMES = ("footer", "copyright", "bottom", "legal", "colophon")
OTHER_NAMES = ("user", "reader", "thread", "slot", "posts", "signup", "articles", "block", "section", "container", "item", "site", "top", "left", "right")
SUFFIXES = ("", "", "", "-box", "-list", "-main", "_inner", "-wrapper", "1", "Area")
NOTICES = ("We use cookies to improve your experience.", "By continuing you accept our privacy policy.", "Subscribe to our newsletter.", "Sign up to read more.", "Please enable JavaScript.")
COMMON = ("rights", "terms", "share", "comment", "comments", "reply", "login", "privacy", "copyright", "newsletter", "subscribe", "cookies")
FOOTERS = ("All rights reserved.", "&copy; 2024", "Terms of use", "Privacy policy", "Contact us", "Powered by")


class Pages:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        syllables = [a + b for a in ("b", "d", "er", "f", "k", "l", "m", "n", "r", "st", "th", "v", "é", "ü", "") for b in ("a", "e", "i", "o", "u", "en", "on", "er")]
        self.vocabulary = ["".join(self.r.choice(syllables) for _ in range(self.r.randint(1, 4))) for _ in range(3000)]

    def words(self, low: int, high: int) -> list[str]:
        return [self.r.choice(self.vocabulary) for _ in range(self.r.randint(low, high))]

    def sentences(self, low: int, high: int) -> str:
        out = []
        for _ in range(self.r.randint(low, high)):
            w = self.words(3, 18)
            if len(w) > 6 and self.r.random() < 0.4:
                w[len(w) // 2] += ","
            out.append(" ".join(w).capitalize() + self.r.choice([".", ".", ".", "!", "?", ""]))
        text = " ".join(out)
        style = self.r.random()
        return text.upper() if style < 0.05 else text.replace(" ", "!! ") if style < 0.08 else text.replace("e ", "e### ") if style < 0.11 else text

    def named(self, names: tuple[str, ...], tag: str = "div") -> tuple[str, str]:
        name = self.r.choice(names) + self.r.choice(SUFFIXES)
        if self.r.random() < 0.25:
            other = self.r.choice([*OTHER_NAMES, self.r.choice(self.vocabulary)])
            name = self.r.choice([f"{other}-{name}", f"{name}-{other}", f"{name}_{other}"])
        how = self.r.random()
        attribute = f' class="{name}"' if how < 0.6 else f' id="{name}"' if how < 0.85 else f' class="{self.r.choice(self.vocabulary)} {name}"'
        return f"<{tag}{attribute}>", f"</{tag}>"

    def inside(self, opened: tuple[str, str], pieces: list) -> list:
        return [(opened[0], None), *pieces, (opened[1], None)]

    def links(self) -> list:
        items = [(f'<li><a href="/{w}">{w}</a></li>', 0) for w in (" ".join(self.words(1, 3)) for _ in range(self.r.randint(3, 9)))]
        return [("<ul>", None), *items, ("</ul>", None)]

    def plain(self) -> list:
        """Text like an article's: only what it stands in tells what it is."""
        return [(f"<p>{self.sentences(1, self.r.choice([1, 3]))}</p>", 0) for _ in range(self.r.randint(1, 2))]

    def menu(self) -> list:
        kind = self.r.random()
        if kind < 0.24:
            return self.inside(("<nav>", "</nav>") if kind < 0.12 else self.named(MENU_NAMES), self.plain())
        return self.inside(("<nav>", "</nav>") if kind < 0.6 else self.named(MENU_NAMES), self.links())

    def header(self) -> list:
        title = [(f"<{t}>{' '.join(self.words(1, 6))}</{t}>", 0) for t in [self.r.choice(["h1", "h2", "p", "div", "a"])]]
        pieces = title + (self.menu() if self.r.random() < 0.5 else [])
        return self.inside(("<header>", "</header>") if self.r.random() < 0.7 else self.named(HEADER_NAMES), pieces)

    def footer(self) -> list:
        line = f"{self.r.choice(FOOTERS)} {self.r.choice(['', '&middot; '])}{self.sentences(0, 3)}"
        pieces = [(line if self.r.random() < 0.5 else f"<p>{line}</p>", 0)] + (self.links() if self.r.random() < 0.4 else [])
        return self.inside(("<footer>", "</footer>") if self.r.random() < 0.7 else self.named(FOOTER_NAMES), pieces)

    def advert(self) -> list:
        text = self.sentences(1, 4)
        return self.inside(self.named(AD_NAMES, self.r.choice(["div", "div", "section", "aside"])), [(text if self.r.random() < 0.6 else f"<p>{text}</p>", 0)])

    def side(self) -> list:
        if self.r.random() < 0.4:
            return self.inside(("<aside>", "</aside>") if self.r.random() < 0.5 else self.named(SIDE_NAMES), self.plain())
        pieces = [(f"<h3>{' '.join(self.words(1, 4))}</h3>", 0), *(self.links() if self.r.random() < 0.5 else [(f"<p>{self.sentences(1, 4)}</p>", 0)])]
        return self.inside(("<aside>", "</aside>") if self.r.random() < 0.6 else self.named(SIDE_NAMES), pieces)

    def notice(self) -> list:
        if self.r.random() < 0.25:
            return self.inside(self.named(NOTICE_NAMES, self.r.choice(["div", "div", "section"])), self.plain())
        text = f"{self.r.choice(NOTICES)} {self.sentences(0, 2)}"
        if self.r.random() < 0.15:  # a long one that says what it is only at its end
            text = f"{self.sentences(5, 15)} {self.r.choice(NOTICES)}"
        button = [("<button>OK</button>", 0)] if self.r.random() < 0.4 else []
        return self.inside(self.named(NOTICE_NAMES, self.r.choice(["div", "div", "section"])), [(f"<p>{text}</p>", 0), *button])

    def form(self) -> list:
        return [("<form>", None), (f"<label>{' '.join(self.words(1, 3))}</label>", 0), ('<input name="q">', None), (f"<p>{self.sentences(1, 2)}</p>", 0), ("<button>Send</button>", 0), ("</form>", None)]

    def comments(self) -> list:
        each = []
        if self.r.random() < 0.3:  # no more than the text of one or two
            return self.inside(self.named(COMMENT_NAMES, self.r.choice(["div", "div", "section", "ol"])), self.plain())
        for _ in range(self.r.randint(1, 4)):
            body = [(f"<h4>{' '.join(self.words(1, 2))}</h4>", 0)] * (self.r.random() < 0.5) + [(f"<p>{self.sentences(1, 5) if self.r.random() < 0.85 else self.sentences(8, 25)}</p>", 0)]
            each += self.inside(self.named(COMMENT_NAMES, self.r.choice(["div", "li", "div", "li", "div", "article"])), body)
        head = [(f"<h3>{self.r.choice(['Comments', 'Replies', 'Discussion'])}</h3>", 0)]
        return self.inside(self.named(COMMENT_NAMES, self.r.choice(["div", "section", "ol"])), head + each)

    def article(self) -> list:
        pieces = [(f"<h1>{' '.join(self.words(2, 10))}</h1>", 1)] if self.r.random() < 0.8 else []
        for _ in range(self.r.choice([1, 1, 2, 2, 3, 5, 8, 12])):
            kind = self.r.random()
            text = self.sentences(1, self.r.choice([1, 3, 8])) if kind < 0.85 else self.sentences(1, 1)
            if self.r.random() < 0.1:  # articles use the words of notices too
                w = text.split(" ")
                w[self.r.randrange(len(w))] = self.r.choice(COMMON)
                text = " ".join(w)
            if kind < 0.7:
                bold = self.r.random()
                pieces.append((f"<p><b>{text}</b></p>" if bold < 0.1 else f"<p><b>{text}<br>" if bold < 0.2 else f"<p>{text}", 1) if bold < 0.3 else (f"<p>{text}</p>", 1))
            elif kind < 0.78:
                pieces.append((f"<h2>{' '.join(self.words(1, 6))}</h2>", 1))
            elif kind < 0.86:
                pieces += [("<ul>", None), *[(f"<li>{self.sentences(1, 1)}</li>", 1) for _ in range(self.r.randint(2, 5))], ("</ul>", None)]
            elif kind < 0.9:
                pieces += [("<blockquote>", None), (f"<p>{text}</p>", 1), ("</blockquote>", None)]
            elif kind < 0.94:
                pieces += [("<table><tr>", None), *[(f"<td>{' '.join(self.words(1, 4))}</td>", 1) for _ in range(4)], ("</tr></table>", None)]
            elif kind < 0.97:
                pieces += [("<figure>", None), ("<img>", None), (f"<figcaption>{text}</figcaption>", 1), ("</figure>", None)]
            else:
                pieces.append((f"<pre>{text}</pre>", 1))
        for extra in (self.advert, self.side, self.comments, self.form, self.notice, self.menu):  # what isn't the article stands inside it too, at any place
            if self.r.random() < 0.2:
                places, depth = [], 0
                for i, (tag, label) in enumerate([*pieces, ("", 1)]):
                    if not depth:
                        places.append(i)
                    if label is None:
                        depth += sum(tag.count(f"<{t}>") - tag.count(f"</{t}>") for t in ("ul", "table", "blockquote", "figure"))
                at = self.r.choice(places)
                pieces[at:at] = extra()
        kind = self.r.random()
        if kind < 0.45:
            return self.inside(("<article>", "</article>"), pieces)
        if kind < 0.6:
            return self.inside(("<main>", "</main>"), pieces)
        if kind < 0.85:
            return self.inside(self.named(ARTICLE_NAMES, self.r.choice(["div", "div", "section"])), pieces)
        if kind < 0.95:
            return self.inside((f'<div class="{self.r.choice(self.vocabulary)}">', "</div>"), pieces)
        return pieces

    def page(self) -> list:
        before, after = [self.header, self.menu, self.advert, self.notice, self.form], [self.side, self.advert, self.comments, self.footer, self.notice, self.form, self.menu]
        # many pages have nothing before the article, or nothing after it
        often = [self.r.choice([0.0, 0.4, 0.4]) for _ in range(2)]
        pieces = [x for f in before if self.r.random() < often[0] for x in f()] + self.article()
        return pieces + [x for f in after if self.r.random() < often[1] for x in f()]


def labelled_pages(n: int, seed: int = 3) -> list[list[tuple[str, int | None]]]:
    made = Pages(seed)
    return [made.page() for _ in range(n)]

"""Pages with known articles to train the block labeller on, made by rule from a seed.

Each page is a random choice of parts around an article: menus, headers, sidebars, notices,
adverts, forms, share links, reader comments, footers. Parts are marked up with elements of
their own or with plain ones under telling class names, nested in wrappers, sometimes
unclosed. ``data-keep`` on an element says whether it is article; the parser passes that on as
the label and it is no feature. Words are made from syllables, so that only the short
phrases below, the markup and the shape of the text tell parts apart.
"""

from __future__ import annotations

import numpy as np

#: Class names by part, and phrases that such parts show.
CLASSES = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs topnav tabs links toolbar",
    "header": "header masthead top site-header branding logo topbar page-header",
    "footer": "footer bottom site-footer copyright legal colophon page-footer",
    "sidebar": "sidebar aside widget related recommended trending popular secondary rail more",
    "notice": "cookie cookies consent notice alert popup modal gdpr banner message overlay",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner-ad adbox",
    "form": "form search login signup subscribe newsletter contact search-form",
    "comments": "comments comment discussion replies responses respond comment-list thread",
    "share": "share social follow sharing share-buttons social-links tags meta-links",
    "article": "article content post entry story main body text post-content entry-content "
    "article-body main-content page-content",
    "wrapper": "wrapper container page site row inner layout outer grid col",
}
PHRASES = {
    "menu": ["Home", "About", "Contact", "News", "Blog", "Products", "Menu", "Log in", "Sign up"],
    "header": ["Welcome", "The daily", "Official site", "Skip to content"],
    "footer": ["All rights reserved", "Privacy", "Terms of use", "Imprint", "Contact us", "Sitemap"],
    "sidebar": ["Related", "Most read", "Popular posts", "See also", "Archives", "Read more"],
    "notice": ["We use cookies", "Accept", "Accept all", "Manage settings", "This site uses cookies"],
    "ad": ["Advertisement", "Sponsored", "Buy now", "Special offer", "Shop now"],
    "form": ["Search", "Subscribe", "Your email", "Send", "Name", "Password", "Sign up for our newsletter"],
    "comments": ["Comments", "Reply", "Leave a comment", "says:", "2 replies", "Log in to reply"],
    "share": ["Share", "Tweet", "Follow us", "Print", "Email", "Tags:"],
}
TAGS = {
    "menu": ["nav", "nav", "div", "ul", "menu"],
    "header": ["header", "header", "div"],
    "footer": ["footer", "footer", "div", "section"],
    "sidebar": ["aside", "aside", "div", "section"],
    "notice": ["div", "section", "aside", "dialog"],
    "ad": ["div", "div", "aside", "section"],
    "form": ["form", "form", "div"],
    "comments": ["section", "div", "ol", "ul"],
    "share": ["div", "ul", "p"],
    "article": ["article", "article", "main", "div", "section"],
}
OWN_TAGS = frozenset(["nav", "menu", "header", "footer", "aside", "form", "article", "main"])

_SYLLABLES = (
    "an be ci do en er fe ga ho in ja ka le mi no or pe que re sch ti un ve wo xi ya zu ß é ñ ü "
    "на то при 日 本"
).split()


class PageMaker:
    def __init__(self, seed: int):
        self.draw = np.random.default_rng(seed)

    def chance(self, share: float) -> bool:
        return self.draw.random() < share

    def pick(self, items):
        return items[int(self.draw.integers(len(items)))]

    def word(self) -> str:
        return "".join(self.pick(_SYLLABLES) for _ in range(self.draw.integers(1, 5)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.draw.integers(low, high + 1)))

    def sentence(self) -> str:
        text = self.words(3, 14).capitalize()
        if self.chance(0.4):
            text = text.replace(" ", ", ", 1)
        return text + self.pick([".", ".", ".", "?", "!"])

    def prose(self, low: int = 1, high: int = 7) -> str:
        return " ".join(self.sentence() for _ in range(self.draw.integers(low, high + 1)))

    def phrase(self, part: str, share: float = 0.4) -> str:
        return self.pick(PHRASES[part]) if self.chance(share) else self.words(1, 4)

    def link(self, text: str) -> str:
        return f'<a href="/{self.word()}">{text}</a>'

    def element(self, part: str, inside: str, keep: int | None = None) -> str:
        tag = self.pick(TAGS[part])
        named = "" if tag in OWN_TAGS and self.chance(0.6) else self.pick(CLASSES[part].split())
        attribute = f' {self.pick(["class", "class", "id"])}="{named}"' if named else ""
        label = "" if keep is None else f' data-keep="{keep}"'
        return f"<{tag}{attribute}{label}>{inside}</{tag}>"

    def items(self, part: str, low: int, high: int) -> str:
        found = [self.link(self.phrase(part, 0.2)) for _ in range(self.draw.integers(low, high + 1))]
        shape = self.pick(["li", "li", "p", "a", "div"])
        if shape == "li":
            return "<ul>" + "".join(f"<li>{x}</li>" for x in found) + "</ul>"
        return " ".join(found) if shape == "a" else "".join(f"<{shape}>{x}</{shape}>" for x in found)

    def part(self, part: str) -> str:
        p = self.pick(["p", "div", "span", "p"])
        if part == "menu":
            inside = self.items(part, 3, 9)
        elif part == "header":
            name = self.link(self.phrase(part)) if self.chance(0.5) else self.phrase(part)
            inside = f"<{p}>{name}</{p}>"
            inside += f"<p>{self.words(2, 8)}</p>" if self.chance(0.4) else ""
            inside += self.part("menu") if self.chance(0.4) else ""
        elif part == "footer":
            text = self.prose(1, 2) if self.chance(0.6) else self.phrase(part)
            inside = f"&copy; {self.word()} &middot; {text}" if self.chance(0.6) else f"<p>{text}</p>"
            inside += self.items(part, 2, 6) if self.chance(0.4) else ""
        elif part == "sidebar":
            inside = f"<h3>{self.phrase(part)}</h3>" if self.chance(0.7) else ""
            inside += self.items(part, 2, 6) if self.chance(0.6) else f"<p>{self.prose(1, 3)}</p>"
        elif part == "notice":
            inside = f"<{p}>{self.phrase(part, 0.6)} {self.prose(0, 2)}</{p}>"
            inside += f"<button>{self.phrase(part)}</button>" if self.chance(0.6) else ""
        elif part == "ad":
            text = self.prose(1, 3) if self.chance(0.7) else self.phrase(part)
            inside = text if self.chance(0.5) else f"<p>{text}</p>"
            inside = self.link(inside) if self.chance(0.2) else inside
        elif part == "form":
            inside = f"<label>{self.phrase(part, 0.7)}</label><input name='q'>"
            inside = (f"<p>{self.prose(1, 2)}</p>" if self.chance(0.3) else "") + inside
            inside += f"<button type='submit'>{self.phrase(part, 0.7)}</button>"
        elif part == "comments":
            title = f"<h3>{self.phrase(part, 0.7)}</h3>" if self.chance(0.7) else ""
            one = self.pick(["div", "li", "article", "p"])
            named = f' class="{self.pick(["comment", "reply", "comment-body"])}"' if self.chance(0.7) else ""
            inside = title
            for _ in range(self.draw.integers(1, 6)):
                who = f"<b>{self.words(1, 2)}</b> " if self.chance(0.6) else ""
                reply = self.link("Reply") if self.chance(0.4) else ""
                inside += f"<{one}{named}>{who}<p>{self.prose(1, 4)}</p>{reply}</{one}>"
            inside += self.part("form") if self.chance(0.3) else ""
        else:
            inside = self.items(part, 2, 5)
        return self.element(part, inside, 0)

    def article(self) -> str:
        title = self.words(3, 9).capitalize()
        if self.chance(0.3):
            title = self.sentence() + " " + self.words(1, 6)
        top = f"<h1>{title}</h1>" if self.chance(0.85) else ""
        if top and self.chance(0.15):
            top = f"<header>{top}</header>"
        body = [top]
        for _ in range(self.draw.integers(0 if top else 1, 14)):
            shape = self.draw.random()
            if shape < 0.62:
                body.append(f"<p>{self.prose()}</p>")
            elif shape < 0.72:
                body.append(f"<p><b>{self.prose()}<br>")
            elif shape < 0.80:
                body.append(f"<h2>{self.words(2, 8).capitalize()}</h2>")
            elif shape < 0.86:
                rows = "".join(f"<li>{self.words(1, 12)}</li>" for _ in range(self.draw.integers(2, 6)))
                body.append(f"<ul>{rows}</ul>")
            elif shape < 0.90:
                body.append(f"<blockquote><p>{self.prose(1, 3)}</p></blockquote>")
            elif shape < 0.92:
                cells = "".join(f"<tr><td>{self.words(1, 3)}<td>{self.words(1, 3)}" for _ in range(3))
                body.append(f"<table>{cells}</table>")
            elif shape < 0.95:
                body.append(f"<p>{self.prose(1, 3)} {self.link(self.words(1, 3))} {self.prose(1, 2)}</p>")
            elif shape < 0.98:
                body.append(self.part(self.pick(["ad", "share", "sidebar", "ad"])))
            else:
                body.append(f"<div>{self.prose()}</div>")
        if self.chance(0.15):
            body.append(self.part("share"))
        return self.element("article", "".join(body), 1)

    def page(self) -> str:
        before = [p for p, s in (("notice", 0.2), ("header", 0.5), ("menu", 0.6), ("ad", 0.4), ("form", 0.15)) if self.chance(s)]
        after = [p for p, s in (("share", 0.2), ("comments", 0.4), ("sidebar", 0.4), ("ad", 0.25), ("form", 0.2), ("menu", 0.15), ("footer", 0.75), ("notice", 0.15)) if self.chance(s)]
        if self.chance(0.2):
            before.append("sidebar")
        if self.chance(0.2):
            self.draw.shuffle(before)
        parts = [self.part(p) for p in before] + [self.article()] + [self.part(p) for p in after]
        body = "".join(parts)
        for _ in range(self.draw.integers(0, 3)):
            body = f'<div class="{self.pick(CLASSES["wrapper"].split())}">{body}</div>'
        head = f"<head><title>{self.words(2, 6)}</title><style>p{{margin:0}}</style></head>"
        return f"<!DOCTYPE html><html>{head}<body>{body}</body></html>"

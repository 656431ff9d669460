"""Labelled pages for the page model: layouts drawn from a seed, whose elements say what they are.

No table labels pages, so these stand in for pages labelled by hand. Each element may carry ``data-label``
(content or boilerplate), which holds for all in it. Real labelled pages of that form can be used as well.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

# Fixed names of parts that sites use.
CONTENT_NAMES = ("content", "main-content", "article-body", "post", "entry-content", "story", "post-body", "text", "body-text", "main", "article")
WRAPPERS = ("page", "wrapper", "container", "row", "col", "layout", "inner", "site", "grid", "outer")
PARTS = {
    "menu": ("nav", "menu", "navbar", "main-menu", "navigation", "topnav", "breadcrumb", "breadcrumbs", "toc-menu", "pagination", "pager"),
    "header": ("header", "site-header", "masthead", "banner", "top-bar", "branding", "logo"),
    "footer": ("footer", "site-footer", "bottom", "copyright", "legal", "colophon", "imprint"),
    "sidebar": ("sidebar", "side", "aside", "widget", "related", "related-posts", "popular", "recent", "tags", "trending", "more-stories", "recommended"),
    "notice": ("cookie", "cookie-banner", "notice", "consent", "gdpr", "alert", "popup", "modal", "newsletter", "subscribe", "overlay", "message", "privacy", "paywall", "promo-message"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "sponsor", "banner-ad", "adsbox", "promotion"),
    "form": ("form", "search-form", "login", "signup", "contact-form", "search", "register"),
    "share": ("share", "social", "share-buttons", "follow", "social-links"),
    "comments": ("comments", "comment-list", "discussion", "responses", "comment", "replies", "reply", "reader-comments", "feedback", "disqus"),
}
SUFFIXES = ("content", "text", "body", "inner", "box", "list", "area", "item", "wrapper", "block", "main", "section")
PREFIXES = ("user", "site", "page", "main", "my", "top", "left", "right", "post", "article", "content")
SYLLABLES = "an ber co del en fi go har in jo ka lu ma ne or pe qui ra si ta un ve wo xi yo zu st ch th ing".split()


class _Writer:
    def __init__(self, seed: int) -> None:
        self.random = random.Random(seed)

    def word(self) -> str:
        return "".join(self.random.choices(SYLLABLES, k=self.random.randint(1, 3)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.random.randint(low, high)))

    def sentence(self) -> str:
        return self.words(3, 18).capitalize() + self.random.choice((".", ".", ".", "?", "!"))

    def prose(self, low: int, high: int) -> str:
        out = [self.sentence() for _ in range(self.random.randint(low, high))]
        if self.random.random() < 0.25:
            at = self.random.randrange(len(out))
            out[at] = f'{self.words(1, 4)} <a href="/x">{self.words(1, 3)}</a> {out[at]}'
        if self.random.random() < 0.2:
            out[0] = f"<b>{out[0]}</b>"
        return " ".join(out)

    def maybe(self, share: float) -> bool:
        return self.random.random() < share

    def named(self, names: tuple[str, ...], bare: float = 0.0) -> str:
        if self.maybe(bare):
            return ""
        name = self.random.choice(names)
        if self.maybe(0.25):
            name = f"{name}-{self.random.choice(SUFFIXES)}" if self.maybe(0.7) else f"{self.random.choice(PREFIXES)}-{name}"
        if self.maybe(0.2):
            name = f"{name} {self.random.choice(('x', 'js', 'clearfix', 'block', 'section'))}"
        return f' {self.random.choice(("class", "class", "id"))}="{name}"'

    def element(self, tag: str, inside: str, attributes: str = "", label: str = "") -> str:
        mark = f' data-label="{label}"' if label else ""
        return f"<{tag}{attributes}{mark}>{inside}</{tag}>"

    # --- parts -----------------------------------------------------------------------------------

    def links(self, low: int, high: int) -> str:
        items = "".join(f'<li><a href="/{self.word()}">{self.words(1, 4)}</a></li>' for _ in range(self.random.randint(low, high)))
        return f"<ul>{items}</ul>" if self.maybe(0.8) else items.replace("<li>", "").replace("</li>", " | ")

    def boilerplate(self, kind: str) -> str:
        pick = self.random.choice
        names = self.named(PARTS[kind])
        if kind == "menu":
            return self.element(pick(("nav", "nav", "div", "ul")), self.links(3, 9), pick(("", names, names)), "boilerplate") if self.maybe(0.5) \
                else self.element("div", self.links(3, 9), names, "boilerplate")
        if kind == "header":
            inside = pick((
                f"<div>{self.words(1, 4)}</div><p>{self.words(3, 8)}</p>", f"<h2>{self.words(1, 3)}</h2>{self.links(2, 5)}",
                f"<h1>{self.words(1, 4)}</h1>", f"<h2>{self.words(1, 5)}</h2>", f"<h1>{self.words(1, 4)}</h1><p>{self.sentence()}</p>", self.words(1, 4),
                f'<h1><a href="/">{self.words(1, 3)}</a></h1>',
            ))
            tag = pick(("header", "header", "div"))
            return self.element(tag, inside, "" if tag == "header" and self.maybe(0.6) else names, "boilerplate")
        if kind == "footer":
            inside = f"&copy; {self.word()}.example &middot; {self.sentence()}" if self.maybe(0.6) else self.links(2, 6) + f"<p>{self.sentence()}</p>"
            tag = pick(("footer", "footer", "div"))
            return self.element(tag, inside, "" if tag == "footer" and self.maybe(0.6) else names, "boilerplate")
        if kind == "sidebar":
            inside = pick((
                f"<h3>{self.words(1, 3)}</h3>{self.links(2, 6)}", f"<h3>{self.words(1, 3)}</h3><p>{self.prose(1, 3)}</p>",
                f"<p>{self.prose(1, 3)}</p>", self.prose(1, 3), f"<h2>{self.words(1, 3)}</h2><p>{self.sentence()}</p>",
            ))
            tag = pick(("aside", "aside", "div", "section"))
            return self.element(tag, inside, "" if tag == "aside" and self.maybe(0.7) else names, "boilerplate")
        if kind == "notice":
            inside = f"<p>{self.prose(1, 3)}</p>" if self.maybe(0.6) else self.prose(1, 2)
            if self.maybe(0.5):
                inside += f"<button>{self.words(1, 2)}</button>"
            hidden = pick(("", "", ' role="alert"', ' role="dialog"', ' style="display:none"'))
            tag = pick(("div", "div", "section", "aside")) if "<p>" in inside or self.maybe(0.7) else "p"
            return self.element(tag, inside, names + hidden, "boilerplate")
        if kind == "ad":
            inside = pick((self.sentence(), self.prose(1, 3), f"<p>{self.prose(1, 2)}</p>", f'<a href="/buy">{self.words(2, 6)}</a>'))
            return self.element(pick(("div", "div", "aside", "section")), inside, names, "boilerplate")
        if kind == "form":
            inside = f"<label>{self.words(1, 3)}</label><input><select><option>{self.word()}<option>{self.word()}</select><button>{self.word()}</button>"
            inside = pick((inside, f"<p>{self.sentence()}</p>" + inside, f"<input><p>{self.sentence()}</p>", f"<h3>{self.words(1, 3)}</h3><p>{self.prose(1, 2)}</p><input>"))
            return self.element("form", inside, names if self.maybe(0.6) else "", "boilerplate")
        if kind == "share":
            return self.element(pick(("div", "ul", "p")), " ".join(f'<a href="#">{self.word()}</a>' for _ in range(self.random.randint(2, 5))), names, "boilerplate")
        if self.maybe(0.3):
            inside = "".join(f"<p>{self.prose(1, 5)}</p>" for _ in range(self.random.randint(1, 5)))
            return self.element(pick(("section", "div", "div", "aside")), inside, names, "boilerplate")
        items = "".join(
            self.element(pick(("div", "li", "article")), f"<p>{self.words(1, 2)}</p><p>{self.prose(1, 4)}</p>", self.named(("comment", "reply", "response", "comment-body"), 0.2))
            for _ in range(self.random.randint(1, 5))
        )
        return self.element(pick(("section", "div", "ol", "aside")), f"<h3>{self.words(1, 2)}</h3>{items}", names, "boilerplate")

    def article(self) -> str:
        pick = self.random.choice
        parts = [f"<h1>{self.words(3, 12)}</h1>"] if self.maybe(0.85) else []
        for _ in range(self.random.choice((1, 2, self.random.randint(1, 14), self.random.randint(3, 14)))):
            draw = self.random.random()
            if draw < 0.72:
                parts.append(f"<p>{self.prose(1, 6)}" + ("" if self.maybe(0.1) else "</p>"))
            elif draw < 0.78:
                parts.append(f"<h2>{self.words(1, 6)}</h2>")
            elif draw < 0.83:
                parts.append("<ul>" + "".join(f"<li>{self.words(2, 14)}</li>" for _ in range(self.random.randint(2, 5))) + "</ul>")
            elif draw < 0.86:
                parts.append(f"<blockquote><p>{self.prose(1, 3)}</p></blockquote>")
            elif draw < 0.89:
                parts.append(f"<pre>{self.words(4, 20)}</pre>")
            elif draw < 0.92:
                rows = "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr>" for _ in range(self.random.randint(2, 4)))
                parts.append(f"<table>{rows}</table>")
            elif draw < 0.95:
                parts.append(f"<figure><img src=x><figcaption>{self.sentence()}</figcaption></figure>")
            elif draw < 0.97:
                parts.append(self.words(2, 6) + ".")
            else:
                parts.append(f"<p>{self.words(1, 2)}.</p>")
        for kind in ("ad", "share", "form", "notice", "sidebar", "menu", "header", "footer", "comments"):
            if self.maybe(0.15 if kind not in ("header", "footer", "comments") else 0.06):
                parts.insert(self.random.randint(1, len(parts)), self.boilerplate(kind))
        if self.maybe(0.2):
            parts.append(self.boilerplate("comments"))
        inside = "".join(parts)
        tag = pick(("article", "article", "main", "div", "section"))
        names = self.named(CONTENT_NAMES, 0.5 if tag in ("article", "main") else 0.15)
        body = self.element(tag, inside, names, "content")
        if self.maybe(0.25):
            body = self.element(pick(("main", "div")), body, self.named(CONTENT_NAMES, 0.4))
        return body

    def page(self) -> str:
        top = [k for k, share in (("notice", 0.25), ("header", 0.45), ("menu", 0.6), ("ad", 0.4), ("form", 0.2), ("sidebar", 0.2)) if self.maybe(share)]
        under = [k for k, share in (("share", 0.2), ("comments", 0.35), ("sidebar", 0.35), ("ad", 0.3), ("form", 0.2), ("notice", 0.15), ("menu", 0.1), ("footer", 0.7)) if self.maybe(share)]
        if self.maybe(0.3):
            self.random.shuffle(top)
        if self.maybe(0.08):
            top, under = top[:1], []
        inside = "".join(map(self.boilerplate, top)) + self.article() + "".join(map(self.boilerplate, under))
        for _ in range(self.random.choice((0, 0, 1, 2))):
            inside = self.element("div", inside, self.named(WRAPPERS, 0.2))
        return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{self.words(2, 8)}</title></head><body>{inside}</body></html>'


def labelled_pages(spark: SparkSession, count: int = 800, seed: int = 11) -> DataFrame:
    """(html) of ``count`` labelled pages, always the same for a seed."""
    return spark.createDataFrame([(_Writer(seed * 100_003 + k).page(),) for k in range(count)], "html string").repartition(4)

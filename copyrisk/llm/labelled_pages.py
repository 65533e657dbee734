"""Labelled pages for the main-text model: invented pages of many layouts, each block labelled."""

from __future__ import annotations

import random

#: Starts each article block of an invented page; :func:`training_blocks` takes it off again.
MARK = "\ue000"

_SYLLABLES = "an ba ci de el fo ga he in jo ka le mi no or pa que ra si te un va wo xi ye zo ér ün ño ça the ing ed er st ch".split()


class PageWriter:
    """Writes one page; the layout, class names and nesting are drawn at random."""

    def __init__(self, rng: random.Random):
        self.rng = rng

    def word(self) -> str:
        return "".join(self.rng.choice(_SYLLABLES) for _ in range(self.rng.choice((1, 1, 2, 2, 3, 4))))

    def words(self, n: int) -> str:
        return " ".join(self.word() for _ in range(n))

    def sentence(self) -> str:
        rng = self.rng
        w = [self.word() + ("," if rng.random() < 0.1 else "") for _ in range(rng.choice((1, 3, 6, 9, 12, 18, 25)))]
        glue = " | " if rng.random() < 0.04 else " "
        return glue.join(w).capitalize() + rng.choice(("...", ".", ".", ".", "!", "?"))

    def prose(self, most: int = 6) -> str:
        text = " ".join(self.sentence() for _ in range(self.rng.randint(1, most)))
        return text.replace(" ", "\n", 1) if self.rng.random() < 0.2 else text

    def links(self, n: int) -> str:
        rng = self.rng
        sep = rng.choice(("", " | ", " "))
        items = [f'<a href="/{self.word()}">{self.words(rng.randint(1, 3))}</a>' for _ in range(n)]
        return "<ul>" + "".join(f"<li>{x}" + rng.choice(("</li>", "</li>", "")) for x in items) + "</ul>" if rng.random() < 0.7 else sep.join(items)

    def named(self, tags: str, names: str, inner: str) -> str:
        rng = self.rng
        tag, name = rng.choice(tags.split()), rng.choice(names.split())
        attr = rng.choice(("class", "id", "class")) if rng.random() < 0.9 or tag == "div" else ""
        suffix = rng.choice(("", "", "-box", "-1", "_wrap", " clearfix"))
        return f'<{tag} {attr}="{name}{suffix}">{inner}</{tag}>' if attr else f"<{tag}>{inner}</{tag}>"

    def clutter(self, kind: str) -> str:
        rng = self.rng
        if kind == "menu":
            return self.named("nav nav div ul", "nav menu navbar topnav navigation breadcrumb breadcrumbs main-menu", self.links(rng.randint(2, 9)))
        if kind == "header":
            inner = rng.choice((f"<h1>{self.words(2)}</h1><p>{self.sentence()}</p>", f"<div>{self.words(3)}</div>", f"<a href=/>{self.words(2)}</a>"))
            return self.named("header header div", "header site-header masthead top banner logo", inner)
        if kind == "ad":
            inner = rng.choice((self.prose(2), f"<p>{self.prose(2)}</p>", f"<a href=#>{self.words(5)}</a>"))
            return self.named("div div aside section ins", "ad ads advert advertisement sponsored sponsor promo promotion banner-ad adsbox", inner)
        if kind == "sidebar":
            inner = f"<h3>{self.words(2)}</h3>" + rng.choice((self.links(5), f"<p>{self.prose(2)}</p>"))
            return self.named("aside aside div section", "sidebar side related widget recommended trending popular most-read more-stories", inner)
        if kind == "notice":
            inner = rng.choice((f"<p>{self.prose(2)}</p><button>{self.word()}</button>", self.sentence(), f"<span>{self.prose(2)}</span>"))
            return self.named("div div section aside", "cookie cookies cookie-notice consent gdpr notice alert newsletter popup modal paywall disclaimer", inner)
        if kind == "form":
            field = rng.choice((f"<label>{self.words(2)}</label><input name=q>", f"<select><option>{self.word()}<option>{self.word()}</select>", f"<p>{self.sentence()}</p><input type=email>", f"<textarea>{self.words(3)}</textarea>"))
            return rng.choice(("<form action=/s>", '<form class="search">', '<form id="subscribe">')) + field + f"<button>{self.word()}</button></form>"
        if kind == "comments":
            one = "".join(self.named("div li article section", "comment comment-body reply user-comment", f"<b>{self.word()}</b><p>{self.prose(2)}</p>") for _ in range(rng.randint(1, 4)))
            return self.named("section div div ol", "comments comment-list discussion disqus responses reader-comments", f"<h3>{self.words(2)}</h3>" * rng.randint(0, 1) + one)
        if kind == "share":
            return self.named("div ul div", "share social social-share tags byline-share toolbar", self.links(3))
        inner = rng.choice((f"&copy; {self.words(2)}", f"&copy; 2020 {self.words(2)} &middot; {self.prose(2)}", self.prose(2), self.links(4), f"<p>{self.sentence()}</p>"))
        return self.named("footer footer div", "footer site-footer foot copyright bottom legal", inner)

    def article(self) -> str:
        rng, m = self.rng, MARK
        out = []
        if rng.random() < 0.85:
            out.append(f"<h1>{m}{self.words(rng.randint(2, 12))}</h1>")
        for _ in range(rng.choice((1, 1, 2, 3, 5, 8, 12))):
            kind = rng.random()
            if kind < 0.7:
                body = rng.choice((self.prose(), self.prose(12), self.sentence(), f"<b>{self.prose()}", f'{self.prose(2)} <a href="/{self.word()}">{self.words(2)}</a> {self.prose(2)}'))
                out.append(f"<p>{m}{body}" + rng.choice(("</p>", "</p>", "</p>", "", "<br>")))
            elif kind < 0.78:
                out.append(f"<h{rng.choice('2234')}>{m}{self.words(4)}</h2>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{m}{self.sentence()}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
            elif kind < 0.91:
                out.append(f"<blockquote><p>{m}{self.prose(3)}</p></blockquote>")
            elif kind < 0.94:
                out.append(f"<table><tr><td>{m}{self.words(2)}</td><td>{m}{self.word()}</td></tr></table>")
            elif kind < 0.97:
                out.append(f"<div>{m}{self.prose()}</div>")
            else:
                out.append(f"<pre>{m}{self.words(8)}</pre>")
            if rng.random() < 0.08:
                out.append(self.clutter(rng.choice(("ad", "share", "form", "sidebar", "notice"))))
        body = "".join(out)
        style = rng.random()
        if style < 0.55:
            return rng.choice(("<article>{}</article>", '<article class="post">{}</article>', "<main><article>{}</article></main>", '<div class="page"><article>{}</article></div>')).format(body)
        if style < 0.7:
            return rng.choice(("<main>{}</main>", '<main id="content">{}</main>', '<div role="main">{}</div>')).format(body)
        name = rng.choice(("content", "post-content", "entry-content", "article-body", "story", "story-body", "main-content", "text", "post", "articleText"))
        return f'<div {rng.choice(("class", "id"))}="{name}">{body}</div>'

    def page(self) -> str:
        rng = self.rng
        before = [self.clutter(k) for k in ("menu", "header", "notice", "ad", "form", "sidebar", "share") if rng.random() < 0.45]
        after = [self.clutter(k) for k in ("ad", "share", "form", "comments", "sidebar", "notice", "menu") if rng.random() < 0.35]
        rng.shuffle(before), rng.shuffle(after)
        if rng.random() < 0.85:
            after.append(self.clutter("footer"))
        head = f'<head><meta charset="utf-8"><title>{self.words(5)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head>'
        body = "".join(before) + (self.article() if rng.random() < 0.98 else "") + "".join(after)
        if rng.random() < 0.4:
            body = rng.choice(('<div id="page">{}</div>', '<div class="wrapper"><div class="container">{}</div></div>', '<div class="site">{}</div>')).format(body)
        return f"<!DOCTYPE html><html>{head}<body>{body}</body></html>"


def labelled_pages(n: int, seed: int = 1) -> list[str]:
    """Pages whose article blocks start with MARK."""
    rng = random.Random(seed)
    return [PageWriter(rng).page() for _ in range(n)]

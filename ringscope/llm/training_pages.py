"""Labelled pages for the main-text field, written from a fixed seed.

No labelled pages come with the corpus, so these stand in: nine kinds of page after
public habits of writing HTML (weblog, newspaper, reference work, manual, table layout of
the nineties, forum, shop, bare text, paragraphs alone), each with its own frame, class names and way of
nesting. Texts are made of random syllables, so that only structure and the form of a
text can be learnt. A kind can be left out, to test the field on a kind it has not seen.
"""

from __future__ import annotations

import random

KINDS = ("weblog", "news", "reference", "manual", "tables", "forum", "shop", "bare", "plain")


class Writer:
    """Writes one page; main holds the texts of its main blocks, all different."""

    def __init__(self, rng: random.Random):
        self.rng, self.main, self.serial = rng, set(), 0

    def words(self, a: int, b: int) -> str:
        self.serial += 1
        made = ["".join(self.rng.choice("bdfgklmnprstvz") + self.rng.choice("aeiouäé") for _ in range(self.rng.randint(1, 4))) for _ in range(self.rng.randint(a, b))]
        return " ".join([f"{made[0].title()}{self.serial}", *made[1:]])

    def prose(self, most: int = 6) -> str:
        ends = [".", ".", ".", ".", "?", "!", ":", "", " ..."]
        return " ".join(self.words(2, 28) + self.rng.choice(ends) for _ in range(self.rng.randint(1, most)))

    def own(self, text: str) -> str:
        self.main.add(text)
        return text

    def link(self, a: int = 1, b: int = 4) -> str:
        return f"<a href='?p={self.rng.randint(1, 99)}'>{self.words(a, b)}</a>"

    def some(self, make, a: int, b: int, glue: str = "") -> str:
        return glue.join(make() for _ in range(self.rng.randint(a, b)))

    def maybe(self, share: float, make) -> str:
        return make() if self.rng.random() < share else ""

    def links(self, wrap: str = "ul") -> str:
        if wrap == "ul":
            return f"<ul>{self.some(lambda: f'<li>{self.link()}', 3, 9)}</ul>"
        return self.some(self.link, 3, 8, self.rng.choice([" | ", " &raquo; ", " "]))

    def body(self, extra=()) -> str:
        """Headings, paragraphs, lists and quotations of an article."""
        def piece() -> str:
            kind = self.rng.random()
            if kind < 0.54:
                text = self.prose()
                self.own(text)
                first, _, rest = text.partition(" ")
                return self.rng.choice([f"<p>{text}</p>", f"<p>{text}\n", f"<p class=txt><em>{first}</em> {rest}</p>", f"<p><strong>{first} {rest}</strong></p>", f"<div>{text}</div>", f"<p><b>{text}<br/>"])
            if kind < 0.65:
                return f"<h{self.rng.choice('234')}>{self.own(self.words(1, 9))}</h2>"
            if kind < 0.74:
                return f"<{(t := self.rng.choice(['ul', 'ol']))}>{self.some(lambda: f'<li>{self.own(self.prose(2))}', 2, 6)}</{t}>"
            if kind < 0.79:
                return f"<blockquote><p>{self.own(self.prose(2))}</blockquote>"
            if kind < 0.83:
                return f"<pre>{self.own(self.words(2, 14))}</pre>"
            if kind < 0.87:
                return f"<p>{self.own(self.words(1, 3))}</p>"
            return self.rng.choice(extra)() if extra else ""

        return self.some(piece, 1, 12)

    def head(self) -> str:
        return f"<!doctype html>\n<html><head><title>{self.words(2, 8)}</title><link rel=stylesheet href=a.css></head>"

    def box(self, names: str, inner=None) -> str:
        """A box beside the text, named in one of the ways given."""
        name = self.rng.choice(names.split())
        inner = inner or (lambda: self.rng.choice([f"<p>{self.prose(2)}</p>", self.words(2, 18), self.link(2, 9), f"<h4>{self.words(1, 4)}</h4>{self.links()}"]))
        return f"<div {self.rng.choice(['class', 'id'])}=\"{name}\">{inner()}</div>"

    def advert(self) -> str:
        return self.box("ad ads ad-slot advert advertisement sponsored sponsor-box promo promotion banner-ad")

    def notice(self) -> str:
        return self.box("cookie-bar consent alert notice gdpr-popup modal")

    def form(self) -> str:
        name = self.rng.choice(["search", "login", "newsletter", "signup", "subscribe"])
        return f"<form action=/{name} class={name}><label>{self.words(1, 4)}</label><input name=q>{self.maybe(0.5, lambda: f'<p>{self.words(3, 15)}</p>')}<button>ok</button></form>"

    def replies(self) -> str:
        one = lambda: self.rng.choice([f"<p>{self.prose(2)}</p>", f"<div>{self.prose(2)}</div>", f"<li class=comment><cite>{self.words(1, 2)}</cite><p>{self.prose(3)}</p></li>", f"<div class='comment reply'><span>{self.words(1, 3)}</span><div>{self.prose(3)}</div></div>"])
        return f"<{(t := self.rng.choice(['section', 'div', 'ol']))} id=comments>{self.maybe(0.6, lambda: f'<h3>{self.words(1, 4)}</h3>')}{self.some(one, 1, self.rng.choice([1, 6]))}{self.maybe(0.4, self.form)}</{t}>"

    def legal(self) -> str:
        return self.rng.choice(["&copy; ", "© ", "Copyright ", "", ""]) + self.words(1, 14) + self.rng.choice(["", ".", " " + self.link(1, 2)])

    def weblog(self) -> str:
        top = f"<div class=site-header><p class=site-title>{self.link()}</p>{self.maybe(0.5, lambda: f'<p>{self.words(3, 9)}</p>')}</div><div id=access role=navigation>{self.links(self.rng.choice(['ul', 'line']))}</div>"
        post = f"<div class=hentry><h2 class=entry-title>{self.own(self.words(2, 10))}</h2><div class=entry-content>{self.body([self.advert])}</div></div>"
        side = f"<div id=secondary class=widget-area>{self.some(lambda: self.box('widget widget_recent tags recommended'), 1, 4)}</div>"
        return f"{self.head()}<body>{top}<div id=wrap>{self.maybe(0.3, self.notice)}{post}{self.maybe(0.5, self.replies)}{self.maybe(0.7, lambda: side)}</div><div id=colophon class=footer>{self.legal()}</div>"

    def news(self) -> str:
        top = f"<header role=banner>{self.link()}<nav>{self.links()}</nav>{self.maybe(0.4, self.form)}</header>"
        figure = lambda: f"<figure><img src=a.jpg><figcaption>{self.own(self.words(3, 18))}</figcaption></figure>"
        story = f"<article><h1>{self.own(self.words(3, 14))}</h1>{self.maybe(0.4, figure)}{self.body([self.advert, self.notice])}</article>"
        if self.rng.random() < 0.4:
            story = f"<main>{story}{self.maybe(0.5, lambda: self.box('related share social recommended'))}</main>"
        foot = f"<footer><p>{self.legal()}</p>{self.maybe(0.4, self.links)}</footer>" if self.rng.random() < 0.6 else f"<footer>{self.legal()}</footer>"
        return f"{self.head()}<body>{self.maybe(0.3, self.notice)}{top}{self.maybe(0.4, self.advert)}{story}{self.maybe(0.5, lambda: f'<aside>{self.links()}{self.maybe(0.5, self.prose)}</aside>')}{self.maybe(0.4, self.replies)}{foot}</body></html>"

    def reference(self) -> str:
        cells = lambda: f"<tr><th>{self.own(self.words(1, 2))}<td>{self.own(self.words(1, 6))}"
        infobox = f"<table class=infobox>{self.some(cells, 2, 5)}</table>"
        toc = f"<div id=toc>{self.links()}</div>"
        text = f"<h1>{self.own(self.words(1, 5))}</h1>{self.maybe(0.4, lambda: infobox)}{self.maybe(0.5, lambda: toc)}{self.body()}"
        return f"{self.head()}<body><div id=content role=main>{text}</div><div id=panel class=menu>{self.some(self.links, 1, 3)}</div>{self.maybe(0.5, lambda: f'<div id=catlinks class=tags>{self.links()}</div>')}<div id=footer><ul><li>{self.words(4, 16)}.</li><li>{self.link()}</li></ul></div></body>"

    def manual(self) -> str:
        entries = lambda: f"<dl>{self.some(lambda: f'<dt>{self.own(self.words(1, 2))}<dd>{self.own(self.prose(2))}', 1, 4)}</dl>"
        page = f"<main><section><h1>{self.own(self.words(1, 6))}</h1>{self.body([entries])}</section></main>"
        return f"{self.head()}<body><nav class=sidebar>{self.maybe(0.4, self.form)}{self.some(self.links, 1, 3)}</nav><div class=breadcrumbs>{self.links('line')}</div>{page}<div class=pager>{self.link()} {self.link()}</div>{self.maybe(0.7, lambda: f'<footer>{self.legal()}</footer>')}"

    def tables(self) -> str:
        text = "".join(f"</p>{self.own(self.prose())}<p>" if self.rng.random() < 0.6 else f"<p align=left>{self.own(self.prose())}" for _ in range(self.rng.randint(1, 8)))
        return f"<HTML><BODY><TABLE><TR><TD CLASS=menu>{self.links('line')}</TD></TR><TR><TD CLASS=content><H1>{self.own(self.words(1, 7))}</H1>{text}</TD>{self.maybe(0.5, lambda: f'<TD CLASS=sidebar>{self.links()}</TD>')}</TR></TABLE><HR><CENTER CLASS=footer>{self.legal()}</CENTER>"

    def forum(self) -> str:
        first = f"<div class=post><h1>{self.own(self.words(2, 9))}</h1><div class=content>{self.body()}</div></div>"
        return f"{self.head()}<body><div class=navbar>{self.links('line')}</div>{self.maybe(0.4, self.advert)}<div id=page>{first}</div>{self.replies()}{self.maybe(0.4, lambda: self.box('pagination pager'))}<div class=copyright>{self.legal()}</div></body>"

    def shop(self) -> str:
        item = f"<section id=main><h1>{self.own(self.words(2, 7))}</h1>{self.body([self.advert])}</section>"
        return f"{self.head()}<body><div class=topbar>{self.maybe(0.6, self.form)}{self.links('line')}</div>{self.maybe(0.5, lambda: self.box('banner promo'))}{item}{self.box('related popular recommended', self.links)}{self.maybe(0.4, self.replies)}{self.maybe(0.4, self.notice)}<div id=bottom class=legal><p>{self.legal()}</p></div></body>"

    def bare(self) -> str:
        text = f"{self.maybe(0.5, lambda: f'<h1>{self.own(self.words(1, 8))}</h1>')}{self.body()}"
        return self.rng.choice([f"<html><body>{text}</body></html>", text, f"<body><article>{text}</article>", f"<main>{text}</main>"])

    def plain(self) -> str:
        """Paragraphs and nothing else, or next to nothing."""
        wrap = self.rng.choice(["{}", *["<html><body>{}</body></html>", "<body>{}"] * 3, "<div>{}</div>", "<table><tr><td>{}</td></tr></table>", "<article>{}</article>", "<html><head><title>t</title></head><body>{}</body></html>"])
        tag = self.rng.choice(["p", "p", "p", "div"])
        text = self.some(lambda: f"<{tag}>{self.own(self.prose())}</{tag}>", 1, self.rng.choice([1, 1, 2, 4, 12, 30]))
        after = self.rng.choice([lambda: "", lambda: "", lambda: f"<footer>{self.legal()}</footer>", self.replies, lambda: f"<nav>{self.links('line')}</nav>"])
        return wrap.format(self.maybe(0.3, lambda: f"<h1>{self.own(self.words(1, 8))}</h1>") + text) + after()


def written(n: int, seed: int, kinds: tuple[str, ...] = KINDS) -> list[tuple[str, set[str]]]:
    """n pages and the texts of their main blocks, the kinds by turns."""
    rng, out = random.Random(seed), []
    for k in range(n):
        writer = Writer(rng)
        page = getattr(writer, kinds[k % len(kinds)])()
        out.append((page, {" ".join(t.split()) for t in writer.main}))
    return out

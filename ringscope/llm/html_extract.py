"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is cut into its DOM leaf blocks: stretches of text between block-level tags,
each with the tags, class names and ids of its ancestors. The field gives each block a
score for main text and for other matter from features of its ancestors and its text,
and a score for each pair of neighbouring labels; Viterbi decoding picks the labels of
a page together.

The corpus has no page labels, so the field is trained on PAGES labelled pages of nine
kinds (training_pages). The fitted weights, a few hundred numbers, travel with the task.

A page is read once from left to right, in time that grows with its length, whatever
its markup. Elements without end tags end where HTML implies it. A tag whose quotes don't
close is read to the next >; after TRIES such tags quotes count no more on that page.
Character references are decoded in each piece of text, so none arises across a tag.
Elements with a hidden attribute or display: none are left out like scripts.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import training_pages
from .common import bounded_batches, read

PAGES = 324
SEED = 7
#: Tags of a page whose quotes are searched for to its end in vain.
TRIES = 16

#: HTML's elements by how they shape text.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template textarea svg math iframe object canvas audio video head title select button".split())
RAW = frozenset("script style noscript template textarea svg math iframe title".split())
#: Elements that end an open element of the given kinds when they begin.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th", "caption", "colgroup"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "optgroup": {"option", "optgroup"}, "thead": {"caption", "colgroup"},
} | dict.fromkeys(("tbody", "tfoot"), {"tr", "td", "th", "thead", "tbody", "caption", "colgroup"})
#: What may stand in an open head; anything else ends it, as text does.
IN_HEAD = frozenset("html head base basefont bgsound link meta title script style noscript noframes template".split())
#: Hidden elements that an open one ends at when these begin, within the elements of SCOPE. HTML lets all other content stay in them.
ENDS = {"button": ("button",), "select": ("select",), "input": ("select",), "textarea": ("select",), "keygen": ("select",)}
SCOPE = frozenset("applet caption html table td th marquee object template".split())
#: Elements that end an open svg or math when they begin outside its integration points.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
INTEGRATION = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
ANCESTORS = "nav header footer aside form article main table ul ol li p blockquote pre figure section h1 h2 h3 dl body".split()

#: Words in class names and ids, by what they usually mean.
HINTS = {
    "menu": "nav navbar menu breadcrumb breadcrumbs toc tabs pagination pager skip",
    "frame": "header masthead topbar footer foot bottom copyright legal colophon",
    "side": "sidebar side aside widget related recommended popular trending share social tags rail",
    "ad": "ad ads adv advert advertisement sponsor sponsored promo promotion banner outbrain taboola",
    "notice": "cookie consent notice alert popup modal overlay gdpr paywall warning",
    "form": "form login signup subscribe newsletter search contact register",
    "comment": "comment comments reply replies respond discussion disqus thread",
    "main": "article content main post entry story text body copy prose page",
}
_hint = {w: k for k, words in HINTS.items() for w in words.split()}
_loose = re.compile(r"</?([a-zA-Z][^\s/>]*)([^>]*)>")
_tag = re.compile(r"</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_attr = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_unseen = re.compile(r"(?:^|[\s\"'])hidden(?=[\s=/]|$)|\bstyle\s*=\s*(?:\"[^\"]*\bdisplay\s*:\s*none\b|'[^']*\bdisplay\s*:\s*none\b|display:none)", re.I)
_quoted = re.compile(r"\"[^\"]*\"|'[^']*'")
_name = re.compile(r"[a-z]+")


def unseen(attributes: str) -> bool:
    """Whether an element of these attributes is hidden by hidden or display: none."""
    found = _unseen.search(attributes)
    return bool(found) and (not found[0].lower().endswith("hidden") or bool(_unseen.search(_quoted.sub('""', attributes))))


def foreign_end(page: str, at: int, name: str) -> int:
    """Where an svg or math that begins before at ends: after its end tag, or at the first
    element that HTML does not allow in it."""
    inside: list[str] = []
    open_ = Counter()
    for m in _tag.finditer(page, at):
        tag = m[1].lower()
        if page[m.start() + 1] == "/":
            if tag == name:
                return m.end()
            while open_[tag]:
                open_[gone := inside.pop()] -= 1
                if gone == tag:
                    break
        elif tag in INTEGRATION and not m[2].endswith("/"):
            inside.append(tag)
            open_[tag] += 1
        elif tag in BREAKOUT and not inside:
            return m.start()
    return len(page)


@dataclass
class Block:
    text: str
    marks: frozenset
    linked: int = 0


def leaf_blocks(page: str) -> list[Block]:
    """The page's visible leaf blocks in order, text decoded and white space folded."""
    found: list[Block] = []
    # of each open element: name, marks, whether hidden, the block element it is or lies in
    stack: list[tuple[str, frozenset, bool, str]] = [("", frozenset(), False, "")]
    opened: Counter = Counter()
    # places in the stack of open elements that bound ENDS, and of those that ENDS may end
    scopes: list[int] = []
    ended: dict[str, list[int]] = {"select": [], "button": []}
    parts: list[str] = []
    linked = 0
    at, n, last, vain = 0, len(page), page.rfind(">"), 0

    def close_block() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            found.append(Block(text, stack[-1][1] | {"tag:" + stack[-1][3]}, linked))
        parts.clear()
        linked = 0

    def pop() -> str:
        name = stack.pop()[0]
        opened[name] -= 1
        for places in (scopes, ended.get(name, ())):
            if places and places[-1] == len(stack):
                places.pop()
        return name

    def end_ended_by(name: str) -> bool:
        """Ends a select or button that name ends; whether it was a select in a select."""
        place = max((ended[x][-1] for x in ENDS[name] if ended[x]), default=0)
        if not place or scopes and scopes[-1] > place:
            return False
        while len(stack) > place:
            pop()
        return name == "select"

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and stack[-1][0] == "head" and not page[at:lt].isspace():
            pop()
        if lt > at and not stack[-1][2]:
            piece = entities.unescape(page[at:lt])
            parts.append(piece)
            if opened["a"]:
                linked += len(piece)
        if lt == n:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        begins = page[lt + 1 : lt + 2].isalpha() or page[lt + 1 : lt + 2] == "/" and page[lt + 2 : lt + 3].isalpha()
        m = _tag.match(page, lt) if begins and lt < last and vain < TRIES else None
        if m is None and begins and lt < last:  # quotes that don't close: each try reads to the end
            vain += 1
            m = _loose.match(page, lt)
        if m is None:
            if not stack[-1][2]:
                parts.append("<")
            at = lt + 1
            continue
        at, name = m.end(), m[1].lower()
        if name in BLOCK:
            close_block()
        elif name == "br":
            parts.append(" ")
        if page[lt + 1] == "/":
            while opened[name]:
                if pop() == name:
                    break
            continue
        if stack[-1][0] == "head" and name not in IN_HEAD:
            pop()
        if name in ENDS and end_ended_by(name):  # a select in a select only ends it
            continue
        if name in ("svg", "math") and not m[2].endswith("/"):
            at = foreign_end(page, at, name)
            continue
        if name in RAW and not m[2].endswith("/"):
            end = re.compile(f"</{re.escape(name)}\\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name in VOID:  # HTML takes no notice of a slash at the end of other elements
            continue
        if name in BLOCK and opened["p"] and stack[-1][3] == "p":  # also from within inline elements
            while pop() != "p":
                pass
        while stack[-1][0] in CLOSES.get(name, ()):
            pop()
        words = {w for a in _attr.findall(m[2]) for w in _name.findall("".join(a).lower())} if m[2] else ()
        marks = stack[-1][1]
        own = {f"in:{name}"} if name in ANCESTORS else set()
        own |= {f"hint:{_hint[w]}" for w in words if w in _hint}
        for places in ((scopes,) if name in SCOPE else ()) + ((ended[name],) if name in ended else ()):
            places.append(len(stack))
        out_of_sight = stack[-1][2] or name in HIDDEN or bool(m[2]) and unseen(m[2])
        stack.append((name, marks | own if own else marks, out_of_sight, name if name in BLOCK else stack[-1][3]))
        opened[name] += 1
    close_block()
    return found


#: Marks of elements that pages put their main text in.
ROOM = frozenset(("in:article", "in:main", "hint:main"))


def features(blocks: list[Block]) -> list[list[str]]:
    out = []
    rooms = [bool(ROOM & b.marks) for b in blocks]
    somewhere = any(rooms)
    for k, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        share = b.linked / max(1, len(b.text))
        out.append([
            "bias", *sorted(b.marks), f"room:{'here' if rooms[k] else 'elsewhere' if somewhere else 'none'}", f"words:{sum(words > x for x in (3, 10, 30))}", f"links:{sum(share > x for x in (0, 0.3, 0.7))}",
            f"stop:{b.text[-1] in '.!?…:;。'}", f"sign:{b.text[0] in '©®|»›•'}", f"first:{k == 0}", f"last:{k == len(blocks) - 1}",
        ])
    return out


@dataclass
class Field:
    """Weights of the conditional random field: unary by feature (other, main),
    transition by pair of labels."""

    unary: dict[str, tuple[float, float]]
    step: np.ndarray

    def scores(self, blocks: list[Block]) -> np.ndarray:
        none = (0.0, 0.0)
        return np.array([[sum(self.unary.get(f, none)[y] for f in fs) for y in (0, 1)] for fs in features(blocks)]).reshape(-1, 2)

    def decode(self, blocks: list[Block]) -> list[int]:
        """Viterbi labels; of equal paths, the one of other matter."""
        u, step, back = self.scores(blocks), self.step.tolist(), []
        if not len(u):
            return []
        best = u[0].tolist()
        for row in u[1:].tolist():
            came = [max((0, 1), key=lambda a, y=y: (best[a] + step[a][y], -a)) for y in (0, 1)]
            best = [best[came[y]] + step[came[y]][y] + row[y] for y in (0, 1)]
            back.append(came)
        label = int(best[1] > best[0])
        path = [label]
        for came in reversed(back):
            label = came[label]
            path.append(label)
        return path[::-1]

    def main_text(self, page: str | None) -> str:
        blocks = leaf_blocks(page or "")
        return "\n\n".join(b.text for b, y in zip(blocks, self.decode(blocks), strict=True) if y)


def labelled_pages(n: int = PAGES, seed: int = SEED, kinds: tuple[str, ...] = training_pages.KINDS) -> list[tuple[list[Block], list[int]]]:
    out = []
    for page, main in training_pages.written(n, seed, kinds):
        blocks = leaf_blocks(page)
        out.append((blocks, [int(b.text in main) for b in blocks]))
    return out


def likelihood(theta: np.ndarray, x: np.ndarray, gold: np.ndarray, mask: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """Mean log-likelihood of the pages' labels less the prior, and its gradient. x has a
    row of features for each page and block, padded to the longest page; gold the labels
    as unit vectors, zero where mask is."""
    m, longest = mask.shape
    log_sum = lambda z, axis: np.logaddexp.reduce(z, axis=axis)
    w, step = theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2)
    u = x @ w
    alpha, beta = np.zeros((m, longest, 2)), np.zeros((m, longest, 2))
    alpha[:, 0] = u[:, 0]
    for k in range(1, longest):
        new = log_sum(alpha[:, k - 1, :, None] + step, 1) + u[:, k]
        alpha[:, k] = np.where(mask[:, k, None] > 0, new, alpha[:, k - 1])
    for k in range(longest - 2, -1, -1):
        new = log_sum(step + (u[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
        beta[:, k] = np.where(mask[:, k + 1, None] > 0, new, 0)
    total = log_sum(alpha[:, -1], 1)
    p1 = np.exp(np.minimum(alpha + beta - total[:, None, None], 0)) * mask[..., None]
    pair = alpha[:, :-1, :, None] + step + (u[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]
    pairs = (np.exp(np.minimum(pair, 0)) * mask[:, 1:, None, None]).sum((0, 1))
    gold_step = np.einsum("pka,pkb->ab", gold[:, :-1], gold[:, 1:])
    value = ((u * gold).sum() + (gold_step * step).sum() - total.sum()) / m - l2 / 2 * theta @ theta
    return value, np.concatenate([np.einsum("pkf,pky->fy", x, gold - p1).ravel(), (gold_step - pairs).ravel()]) / m - l2 * theta


def fit(pages: list[tuple[list[Block], list[int]]], steps: int = 150, l2: float = 0.02, rate: float = 0.3) -> Field:
    """Maximum likelihood with a Gaussian prior. Adam steps from zero, so the fit is
    deterministic."""
    names = {f: k for k, f in enumerate(sorted({f for blocks, _ in pages for fs in features(blocks) for f in fs}))}
    m, longest = len(pages), max(len(y) for _, y in pages)
    x = np.zeros((m, longest, len(names)), dtype=np.float32)
    y = np.zeros((m, longest), dtype=int)
    mask = np.zeros((m, longest))
    for p, (blocks, labels) in enumerate(pages):
        for k, fs in enumerate(features(blocks)):
            x[p, k, [names[f] for f in fs]] = 1
        y[p, : len(labels)] = labels
        mask[p, : len(labels)] = 1
    theta = np.zeros(2 * len(names) + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    gold = np.eye(2)[y] * mask[..., None]
    for t in range(1, steps + 1):
        grad = likelihood(theta, x, gold, mask, l2)[1]
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        theta += rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    w = theta[:-4].reshape(-1, 2)
    return Field({f: (float(w[k, 0]), float(w[k, 1])) for f, k in names.items()}, theta[-4:].reshape(2, 2))


@cache
def trained() -> Field:
    return fit(labelled_pages())


def extract_text(pages: DataFrame, html_col: str = "html", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """pages with text_col, the main text. Null, empty and textless pages give an empty
    text; broken markup is read as far as it goes; whole pages are read. A column of
    that name is replaced, other columns stay as they are."""
    field = field or trained()

    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages_ in batches:
            yield pd.Series([field.main_text(p) for p in pages_], dtype=object)

    return bounded_batches(pages).withColumn(text_col, extracted(F.col(html_col)))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

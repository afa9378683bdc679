"""Main text of web pages by a linear-chain conditional random field over leaf blocks of the DOM.

A block is a run of text with no block element's border inside. Its features are the tags, classes and ids of its ancestors
and a few properties of its text; the field has two labels, main text or not, and weights for going from one to the other,
and is trained on labelled pages, here those of ``labelled_pages``: a generator of layouts whose parts are known. Viterbi
decoding labels the blocks of a page together.

Null and empty pages, and pages without main text, give the empty text; of equally likely labellings the one with less main
text counts. Comments and declarations are never text, closed or not. Repeated rows are treated alike; other columns pass
through, columns of the result's names are replaced; an empty table gives an empty one. Nothing of a page is dropped but by
its label; no length is capped, and parsing takes time in proportion to it, however deep elements are nested.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from functools import cache
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymap.llm.arrow import with_python
from quarrymap.session import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i kbd label mark q s samp small span strike strong sub sup time tt u var ins del".split())
#: Their content is never text of a page.
SILENT = frozenset("script style noscript template head title svg iframe object canvas select textarea button option datalist".split())
#: What an opening tag closes if it is the innermost open block.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
#: Block elements that features name; all others are one.
KNOWN = SILENT | frozenset("html body div section article main header footer nav aside p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption form fieldset legend address details summary dialog search hgroup center".split())
#: Ancestors that say nothing about what a block is.
BARE = frozenset(("<html", "<body", "<p", "<h1", "<h2", "<h3"))
_COMMENT_END = re.compile("--!?>")
_SPACE = re.compile(r"[ \t-\r\x1c-\x1f\x85\xa0  -     　]+")
_TOKEN = re.compile(r"[a-z]+")
#: Tokens of classes and ids that a block's features can name.
NAMED = frozenset(
    "ad ads adv advert advertisement banner sponsor sponsored promo nav navbar menu breadcrumb breadcrumbs header masthead top footer bottom copyright legal sidebar side widget related recommended "
    "share social comment comments reply replies discussion respond disqus cookie consent notice alert gdpr popup modal newsletter subscribe signup login search form pagination pager tag tags meta "
    "article content main body post entry story text page container wrapper row title headline byline author lead summary".split()
)


class _Node:
    __slots__ = ("tag", "features", "silent", "link")

    def __init__(self, tag, features, silent, link):
        self.tag, self.features, self.silent, self.link = tag, features, silent, link


class _Blocks(HTMLParser):
    """The blocks of a page in order: (text, features of the ancestors, characters that are links).

    The whole page is fed at once, so a declaration or comment without an end goes to the end of the page.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = [_Node("", frozenset(), False, False)]
        #: Where in the stack each tag is open, and where block elements are; the innermost last.
        self.open: defaultdict[str, list[int]] = defaultdict(list)
        self.block_at = [0]
        self.blocks: list[tuple[str, frozenset, int]] = []
        self.parts: list[str] = []
        self.linked = 0
        self.features = frozenset()

    def flush(self):
        text = _SPACE.sub(" ", "".join(self.parts)).strip(" ")
        if text:
            self.blocks.append((text, self.features, self.linked))
        self.parts, self.linked = [], 0

    def push(self, node):
        if node.tag not in INLINE:
            self.block_at.append(len(self.stack))
        self.open[node.tag].append(len(self.stack))
        self.stack.append(node)

    def cut(self, at):
        """Closes what is open from a place in the stack on."""
        while len(self.stack) > at:
            self.open[self.stack.pop().tag].pop()
        while self.block_at[-1] >= at:
            self.block_at.pop()

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            elif tag == "hr":
                self.flush()
            return
        if tag not in INLINE:
            self.flush()
            # A new block ends an open paragraph and whatever inline elements are open in it.
            inner = self.block_at[-1]
            if inner and self.stack[inner].tag in CLOSES.get(tag, ("p",)) or inner and self.stack[inner].tag == "p" and tag not in SILENT:
                self.cut(inner)
        parent = self.stack[-1]
        own = set()
        if tag not in INLINE:
            name = tag if tag in KNOWN else "other"
            own.add("<" + name)
            for key, value in attrs:
                if key in ("class", "id", "role") and value:
                    own.update("." + t for t in _TOKEN.findall(value.lower()) if t in NAMED)
            if "<article" in parent.features or "<main" in parent.features:
                own.add("in:" + name)
        own -= parent.features
        self.push(_Node(tag, parent.features | own if own else parent.features, parent.silent or tag in SILENT, parent.link or tag == "a"))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "br":
            self.parts.append(" ")
        if not tag or not self.open[tag]:
            return
        at = self.open[tag][-1]
        if tag not in INLINE:
            self.flush()
        elif at < self.block_at[-1]:
            return
        self.cut(at)

    def handle_data(self, data):
        top = self.stack[-1]
        if top.silent:
            return
        if not self.parts or not self.features:
            self.features = top.features
        if top.link:
            self.linked += len(data.strip())
        self.parts.append(data)

    def _after(self, end, i):
        at = self.rawdata.find(end, i)
        return len(self.rawdata) if at < 0 else at + len(end)

    def parse_html_declaration(self, i):
        return self._after(">", i)

    def parse_pi(self, i):
        return self._after(">", i)

    def parse_comment(self, i, report=True):
        for short in ("<!-->", "<!--->"):
            if self.rawdata.startswith(short, i):
                return i + len(short)
        end = _COMMENT_END.search(self.rawdata, i + 4)
        return end.end() if end else len(self.rawdata)

    def parse_starttag(self, i):
        k = super().parse_starttag(i)
        return k if k >= 0 else self._after(">", i)

    def parse_endtag(self, i):
        k = super().parse_endtag(i)
        return k if k >= 0 else self._after(">", i)


def blocks(html: str | None) -> list[tuple[str, list[str]]]:
    """(text, features) of the leaf blocks of a page."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    out = []
    for text, ancestors, linked in parser.blocks:
        n = text.count(" ") + 1
        share = linked / len(text)
        features = [*ancestors, f"words:{min(6, n.bit_length())}", f"links:{0 if not linked else 1 if share < 0.5 else 2}"]
        if text[-1] in ".!?…":
            features.append("ends")
        if "©" in text:
            features.append("copyright")
        if not ancestors - BARE:
            features.append("bare")
        out.append((text, features))
    return out


class Field:
    """Weights of a two-label linear-chain conditional random field: 1 is main text."""

    def __init__(self, names: list[str]):
        self.names = {n: i for i, n in enumerate(names)}
        self.weights = np.zeros(len(names) + 1)
        self.moves = np.zeros((2, 2))
        self.first = np.zeros(2)

    def emission(self, features: list[str]) -> float:
        """The score of label 1 over label 0; features that training never saw count nothing."""
        names, weights = self.names, self.weights
        return float(weights[-1] + sum(weights[names[f]] for f in features if f in names))

    def fit(self, pages: list[tuple[list[list[str]], list[int]]], steps: int = 200, rate: float = 0.1, decay: float = 1e-3) -> Field:
        """Adam on the log-likelihood of whole pages; forward and backward sums go through all pages side by side."""
        count, length = len(pages), max(len(labels) for _, labels in pages)
        x = np.zeros((count, length, len(self.weights)), dtype=np.float32)
        y, there = np.zeros((count, length), dtype=int), np.zeros((count, length), dtype=bool)
        for i, (rows, labels) in enumerate(pages):
            there[i, : len(labels)] = True
            y[i, : len(labels)] = labels
            for j, features in enumerate(rows):
                x[i, j, [self.names[f] for f in features]] = 1
                x[i, j, -1] = 1
        values = [self.weights, self.moves, self.first]
        first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
        rows = np.arange(count)
        for step in range(1, steps + 1):
            e = np.zeros((count, length, 2))
            e[..., 1] = x @ self.weights
            forward, backward = np.zeros_like(e), np.zeros_like(e)
            forward[:, 0] = self.first + e[:, 0]
            for t in range(1, length):
                into = np.logaddexp(forward[:, t - 1, 0, None] + self.moves[0], forward[:, t - 1, 1, None] + self.moves[1]) + e[:, t]
                forward[:, t] = np.where(there[:, t, None], into, forward[:, t - 1])
            whole = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
            slope_moves = -2 * decay * self.moves * count
            for t in range(length - 1, 0, -1):
                after = e[:, t] + backward[:, t]
                back = np.logaddexp(self.moves[:, 0] + after[:, 0, None], self.moves[:, 1] + after[:, 1, None])
                backward[:, t - 1] = np.where(there[:, t, None], back, backward[:, t])
                pair = np.exp(forward[:, t - 1, :, None] + self.moves + after[:, None, :] - whole[:, None, None])
                slope_moves -= (pair * there[:, t, None, None]).sum(0)
                np.add.at(slope_moves, (y[there[:, t], t - 1], y[there[:, t], t]), 1)
            chance = np.exp(forward[..., 1] + backward[..., 1] - whole[:, None])
            error = (y - chance) * there
            slope = np.einsum("ij,ijk->k", error, x) - 2 * decay * self.weights * count
            start = np.bincount(y[rows, 0], minlength=2) - np.stack([1 - chance[:, 0], chance[:, 0]]).sum(1)
            for k, (v, s) in enumerate(zip(values, (slope, slope_moves, start), strict=True)):
                s = s / count
                first[k] = 0.9 * first[k] + 0.1 * s
                second[k] = 0.99 * second[k] + 0.01 * s * s
                v += rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def viterbi(self, rows: list[list[str]]) -> list[int]:
        """The likeliest labels of a page's blocks."""
        (a, b), (c, d) = self.moves.tolist()
        zero, one = self.first.tolist()
        back = []
        for t, features in enumerate(rows):
            e = self.emission(features)
            if t:
                back.append((int(one + c > zero + a), int(one + d > zero + b)))
                zero, one = max(zero + a, one + c), max(zero + b, one + d)
            one += e
        if not rows:
            return []
        label = int(one > zero)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


#: Parts of a page that are not main text: opening tag, closing tag, kind of content.
BOILERPLATE = [
    ('<nav>', '</nav>', "links"), ('<nav class="navbar">', '</nav>', "links"), ('<div class="menu">', '</div>', "links"), ('<ul class="breadcrumbs">', '</ul>', "links"), ('<div id="nav">', '</div>', "links"),
    ('<header>', '</header>', "short"), ('<div class="header">', '</div>', "short"), ('<div id="masthead">', '</div>', "short"), ('<header class="top">', '</header>', "links"),
    ('<footer>', '</footer>', "copyright"), ('<div class="footer">', '</div>', "copyright"), ('<div id="bottom" class="legal">', '</div>', "prose"), ('<footer>', '</footer>', "links"), ('<footer>', '</footer>', "prose"),
    ('<aside>', '</aside>', "prose"), ('<aside class="related">', '</aside>', "links"), ('<div class="sidebar">', '</div>', "prose"), ('<div id="sidebar">', '</div>', "links"), ('<div class="widget">', '</div>', "short"), ('<aside>', '</aside>', "long"),
    ('<div class="ad">', '</div>', "prose"), ('<div class="advert">', '</div>', "prose"), ('<div class="ads banner">', '</div>', "long"), ('<section class="sponsored promo">', '</section>', "prose"), ('<div class="advertisement">', '</div>', "prose"),
    ('<div class="cookie">', '</div>', "prose"), ('<div id="consent" class="notice">', '</div>', "prose"), ('<div class="gdpr popup">', '</div>', "long"), ('<div role="alert" class="alert">', '</div>', "short"), ('<div class="notice">', '</div>', "prose"),
    ('<form>', '</form>', "form"), ('<form class="search">', '</form>', "form"), ('<div class="newsletter subscribe"><form>', '</form></div>', "form"), ('<form id="login">', '</form>', "form"),
    ('<div class="share social">', '</div>', "links"), ('<div class="pagination">', '</div>', "links"), ('<div class="tags">', '</div>', "links"),
]
COMMENTS = [
    ('<section class="comments">', '</section>'), ('<div id="comments">', '</div>'), ('<div class="comment">', '</div>'), ('<ol class="replies discussion">', '</ol>'), ('<div id="disqus" class="respond">', '</div>'), ('<section id="comments">', '</section>'),
]
MAIN = [
    ('<article>', '</article>'), ('<main>', '</main>'), ('<main><article>', '</article></main>'), ('<div class="content">', '</div>'), ('<div id="main" class="post">', '</div>'), ('<article class="entry">', '</article>'),
    ('<div class="article body">', '</div>'), ('<div class="story text">', '</div>'), ('<article>', '</article>'), ('<section class="post entry">', '</section>'), ('', ''),
]


def labelled_pages(count: int = 400, seed: int = 11) -> list[tuple[str, list[str]]]:
    """(html, main text blocks in order) of made-up pages in many layouts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    prose = lambda a, b: words(a, b).capitalize() + "."

    def filler(kind: str) -> str:
        if kind == "links":
            items = [f'<a href="/{word()}">{words(1, 3)}</a>' for _ in range(rng.randint(2, 7))]
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if rng.random() < 0.6 else " ".join(items)
        if kind == "copyright":
            return f"&copy; {word()}.example &middot; {prose(2, 8)}"
        if kind == "form":
            return f"<label>{words(1, 3)}</label><input name=q><p>{prose(3, 12)}</p>" if rng.random() < 0.5 else f"{words(1, 5)} <input type=submit>"
        text = prose(*{"short": (1, 6), "prose": (4, 18), "long": (20, 60)}[kind])
        return f"<p>{text}</p>" if rng.random() < 0.4 else text

    def boilerplate(n: int) -> list[str]:
        return [f"{a}{filler(k)}{b}" for a, b, k in rng.choices(BOILERPLATE, k=n)]

    out = []
    for _ in range(count):
        kept, body = [], []
        opening, closing = rng.choice(MAIN)

        def keep(text: str, form: str) -> None:
            kept.append(text)
            body.append(form.format(text))

        if rng.random() < 0.8:
            keep(words(2, 9), rng.choice(["<h1>{}</h1>", "<header><h1>{}</h1></header>", '<h1 class="title">{}</h1>', "<h2>{}</h2>"]))
        if rng.random() < 0.15:
            keep(words(2, 6), '<p class="byline author">{}</p>')
        for _ in range(rng.randint(0, 12)):
            roll = rng.random()
            if roll < 0.7:
                keep(prose(*rng.choice([(1, 4), (8, 30), (20, 90)])), rng.choice(["<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<div>{}</div>"]))
            elif roll < 0.78:
                keep(words(2, 6), "<h2>{}</h2>")
            elif roll < 0.86:
                keep(prose(2, 12), "<ul><li>{}</li></ul>")
            elif roll < 0.9:
                keep(prose(8, 30), "<blockquote>{}</blockquote>")
            elif roll < 0.93:
                keep(words(1, 4), "<table><tr><td>{}</td></tr></table>")
            else:
                body += boilerplate(1)
        tail = []
        if rng.random() < 0.35:
            a, b = rng.choice(COMMENTS)
            tail.append(a + "".join(f"<p>{prose(3, 40)}</p>" for _ in range(rng.randint(1, 5))) + b)
        inside = tail and rng.random() < 0.4
        page = ["<html><head><title>", words(2, 6), "</title></head><body>", *boilerplate(rng.randint(1, 5)), opening, *body, *(tail if inside else []), closing]
        page += ([] if inside else tail) + boilerplate(rng.randint(1, 4)) + ["</body></html>"]
        out.append(("".join(page), kept))
    return out


def labels_of(rows: list[tuple[str, list[str]]], kept: list[str]) -> list[int]:
    """1 for the blocks that are, in order, the kept texts."""
    out, at = [], 0
    for text, _ in rows:
        out.append(int(at < len(kept) and text == kept[at]))
        at += out[-1]
    return out


@cache
def trained(count: int = 400, seed: int = 11) -> Field:
    """The field of the labelled pages; fitted once in a driver."""
    pages = []
    for html, kept in labelled_pages(count, seed):
        if rows := blocks(html):
            pages.append(([f for _, f in rows], labels_of(rows, kept)))
    return Field(sorted({f for rows, _ in pages for features in rows for f in features})).fit(pages)


def main_text(html: str | None, field: Field) -> str:
    """The main text of one page."""
    rows = blocks(html)
    return " ".join(text for (text, _), label in zip(rows, field.viterbi([f for _, f in rows]), strict=True) if label)


def extract(df: DataFrame, html: str = "html", out: str = "text", field: Field | None = None) -> DataFrame:
    """``df`` with the main text of the pages."""
    field = field or trained()

    def run(pages):
        return [[main_text(p, field) for p in pages]]

    return with_python(df, run, [html], [T.StructField(out, T.StringType(), False)])


def op5_extract(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

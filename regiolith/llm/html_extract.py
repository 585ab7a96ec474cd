"""Main text of web pages: a linear-chain conditional random field over leaf blocks.

Each block (see ``html_blocks``) is labelled article or not, by features of its
ancestors' tags and names and of its text, and by the label of the block before
it.  The field is trained on labelled pages: a fixed number of pages drawn from
``labelled_page``, which knows many ways in which sites mark up menus, headers,
footers, side bars, notices, adverts, forms and comments around an article.
Training maximises the penalised likelihood by forward-backward sums; pages are
decoded by Viterbi, one at a time, whatever their length.

Rows: a null or empty html has no text: "" and 0.  Rows stand for themselves, so
repeats, ties, null ids and other columns have no influence.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from regiolith.llm.common import lean, prepare
from regiolith.llm.html_blocks import Block, blocks

TRAIN_PAGES = 600
ROUNDS = 200
PENALTY = 0.02

# Names that sites give to their parts.
PARTS = {
    "menu": "nav menu navbar navigation topnav breadcrumb breadcrumbs links toc toolbar".split(),
    "header": "header masthead banner top logo brand site-header".split(),
    "footer": "footer site-footer bottom copyright colophon legal".split(),
    "side": "sidebar aside side widget related popular recommended trending more-stories rail".split(),
    "notice": "cookie notice consent gdpr alert popup modal newsletter subscribe paywall overlay".split(),
    "advert": "ad ads advert advertisement sponsored promo banner-ad adsense sponsor dfp".split(),
    "share": "share social sharing follow tags meta byline-links".split(),
    "comments": "comments comment discussion replies reply respond thread responses disqus".split(),
}
# Names of the article.
BODY = "content article post entry story main body text post-content article-body entry-content story-body".split()
SYLLABLES = "an ber con de el en er ge ho in ja ka la men no or pa qui re sch te un ver wi za ou ia".split()


# ---------------------------------------------------------------- labelled pages


def labelled_page(rng: random.Random) -> tuple[str, list[str]]:
    """A page and the texts of its article's blocks.

    Words of the article and of everything else come from one vocabulary, so
    that only markup and shape can tell them apart.
    """
    article: list[str] = []
    word = lambda: "".join(rng.choices(SYLLABLES, k=rng.randint(1, 4)))

    def phrase(lo: int, hi: int) -> str:
        return " ".join(word() for _ in range(rng.randint(lo, hi))).capitalize()

    def sentences(lo: int, hi: int) -> str:
        return " ".join(phrase(3, 18) + rng.choice(".....!?") for _ in range(rng.randint(lo, hi)))

    def named(part: str) -> str:
        name = rng.choice(PARTS[part] if part in PARTS else BODY)
        return rng.choice([f' class="{name}"', f' id="{name}"', f' class="{word()} {name}"', f' class="{name}-{word()}"'])

    def link(text: str) -> str:
        return f'<a href="/{word()}">{text}</a>'

    def menu() -> str:
        items = "".join(f"<li>{link(phrase(1, 3))}" + rng.choice(["", "</li>"]) for _ in range(rng.randint(2, 9)))
        return rng.choice([f"<nav><ul>{items}</ul></nav>", f"<div{named('menu')}><ul>{items}</ul></div>", f"<nav{named('menu')}>{' '.join(link(word()) for _ in range(5))}</nav>", f"<ul{named('menu')}>{items}</ul>"])

    def header() -> str:
        inside = rng.choice([link(phrase(1, 3)), f"<p>{phrase(2, 6)}</p>", f"<div>{phrase(1, 3)}</div>{menu()}"])
        return rng.choice([f"<header>{inside}</header>", f"<div{named('header')}>{inside}</div>"])

    def footer() -> str:
        inside = rng.choice([f"&copy; {phrase(1, 3)} &middot; {sentences(1, 3)}", f"<p>&copy; 20{rng.randint(10, 25)} {phrase(1, 3)}</p>", f"<p>{sentences(1, 3)}</p>{menu()}", sentences(1, 2)])
        return rng.choice([f"<footer>{inside}</footer>", f"<footer{named('footer')}>{inside}</footer>", f"<div{named('footer')}>{inside}</div>"])

    def side(part: str) -> str:
        inside = rng.choice([f"<h3>{phrase(1, 3)}</h3><p>{sentences(1, 3)}</p>", f"<h2>{phrase(1, 4)}</h2><ul>" + "".join(f"<li>{link(phrase(2, 8))}</li>" for _ in range(rng.randint(2, 6))) + "</ul>", sentences(1, 2), phrase(2, 9), f"<p>{sentences(1, 4)}</p>"])
        if part == "side" and rng.random() < 0.5:
            return f"<aside>{inside}</aside>"
        return f"<div{named(part)}>{inside}</div>"

    def form() -> str:
        return f"<form action='/{word()}'><label>{phrase(1, 3)}</label><input type=text><p>{sentences(1, 2)}</p><button>{word()}</button></form>"

    def comments() -> str:
        one = lambda: rng.choice([f"<div class=\"comment\"><b>{word()}</b><p>{sentences(1, 4)}</p></div>", f"<li><p>{phrase(1, 2)}</p><p>{sentences(1, 3)}</p></li>", f"<p>{sentences(1, 4)}</p>"])
        tag = rng.choice(["div", "section", "ol", "ul"])
        return f"<{tag}{named('comments')}><h3>{phrase(1, 3)}</h3>" + "".join(one() for _ in range(rng.randint(1, 6))) + f"</{tag}>"

    def body() -> str:
        def keep(text: str) -> str:
            article.append(text)
            return text

        out = [f"<h1>{keep(phrase(2, 12))}</h1>"] if rng.random() < 0.85 else []
        for _ in range(rng.randint(1, 14)):
            k = rng.random()
            if k < 0.72:
                text = keep(sentences(1, 9) if rng.random() < 0.8 else phrase(1, 6))
                words = text.split(" ")
                if rng.random() < 0.2:
                    i = rng.randrange(len(words))
                    words[i] = rng.choice([f"<b>{words[i]}</b>", link(words[i]), f"<i>{words[i]}</i>"])
                elif rng.random() < 0.08:
                    words = ["<b>" + words[0], *words[1:]]
                out.append("<p>" + " ".join(words) + rng.choice(["</p>", "</p>", "</p>\n", "<br>", "</p>"]))
                if not out[-1].endswith(("</p>", "</p>\n")) and rng.random() < 0.5:
                    out.append("</p>")
            elif k < 0.82:
                out.append(f"<h{rng.randint(2, 4)}>{keep(phrase(1, 8))}</h2>".replace("</h2>", f"</h{out[-1][2] if out and out[-1][:2] == '<h' else 2}>"))
            elif k < 0.89:
                out.append("<ul>" + "".join(f"<li>{keep(rng.choice([phrase(2, 12), sentences(1, 2)]))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif k < 0.93:
                out.append(f"<blockquote>{keep(sentences(1, 3))}</blockquote>")
            elif k < 0.96:
                out.append("<table><tr>" + "".join(f"<td>{keep(phrase(1, 4))}</td>" for _ in range(3)) + "</tr></table>")
            else:
                out.append(side(rng.choice(["advert", "share", "notice"])))
        inside = "".join(out)
        kind = rng.random()
        if kind < 0.5:
            return f"<article>{inside}</article>"
        if kind < 0.65:
            return f"<main>{inside}</main>"
        if kind < 0.75:
            return f"<main><article{named('body')}>{inside}</article></main>"
        return f"<div{named('body')}>{inside}</div>"

    parts = [f"<script>var t = '</p>{word()}';</script>" if rng.random() < 0.2 else ""]
    before = [menu, header, lambda: side("advert"), lambda: side("notice"), lambda: side("side"), form]
    after = [footer, comments, lambda: side("side"), lambda: side("advert"), lambda: side("share"), form, lambda: side("notice"), menu]
    parts += [rng.choice(before)() for _ in range(rng.randint(0, 4))]
    parts.append(body())
    parts += [rng.choice(after)() for _ in range(rng.randint(0, 4))] + ([footer()] if rng.random() < 0.7 else [])
    inside = "".join(p + rng.choice(["", "\n"]) for p in parts)
    if rng.random() < 0.3:
        inside = f'<div class="{rng.choice(["wrapper", "page", "container", "site"])}">{inside}</div>'
    return f"<!DOCTYPE html><html><head><title>{phrase(2, 8)}</title><style>p{{margin:0}}</style></head><body>{inside}" + rng.choice(["</body></html>", ""]), article


# ---------------------------------------------------------------- features


def describe(page: list[Block]) -> list[list[str]]:
    """The features of each block."""
    out, seen_h1 = [], False
    first = next((i for i, b in enumerate(page) if b.tag == "h1"), None)
    for i, b in enumerate(page):
        n = len(b.text.split())
        f = ["bias", f"tag={b.tag}", *{f"in={t}" for t in b.path}, *{f"name={x}" for x in b.names}]
        f.append(f"words={min(6, n.bit_length())}")
        f.append(f"linked={min(4, 4 * b.linked // max(1, len(b.text)))}")
        f.append("stop" if b.text[-1] in ".!?…:;\"”»" else "no-stop")
        f.append("nested" if b.depth > 4 else "shallow")
        f.append("before-h1" if first is not None and i < first else "after-h1" if seen_h1 else "at-h1" if b.tag == "h1" else "no-h1")
        f.append("framed" if {"article", "main"} & b.path else "unframed")
        if b.text[0] in "©®":
            f.append("sign")
        seen_h1 |= b.tag == "h1"
        if i:
            f.append("sibling" if b.parent == page[i - 1].parent else "stranger")
        out.append(f)
    return out


class Field:
    """Weights of features by label, and of a label after a label, for siblings and for others."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, follow: np.ndarray) -> None:
        self.index, self.emit, self.follow = index, emit, follow
        self.known = {x.split("=", 1)[1] for x in index if x.startswith(("in=", "name="))} | {"article", "main"}

    def viterbi(self, page: list[Block]) -> list[bool]:
        if not page:
            return []
        emit = [self.emit[[self.index[x] for x in f if x in self.index]].sum(axis=0) for f in describe(page)]
        best, back = emit[0], []
        for i in range(1, len(page)):
            through = best[:, None] + self.follow[int(page[i].parent == page[i - 1].parent)]
            back.append(through.argmax(axis=0))
            best = through.max(axis=0) + emit[i]
        label = [int(best.argmax())]
        for step in reversed(back):
            label.append(int(step[label[-1]]))
        return [x == 1 for x in reversed(label)]

    @classmethod
    def fit(cls, pages: list[list[Block]], labels: list[list[bool]]) -> Field:
        described = [describe(p) for p in pages]
        count: dict[str, int] = {}
        for f in (x for p in described for x in p):
            for x in f:
                count[x] = count.get(x, 0) + 1
        index = {x: i for i, x in enumerate(sorted(x for x, c in count.items() if c >= 4))}
        n, longest = len(pages), max(map(len, pages))
        y, sibling, inside = (np.zeros((n, longest), int) for _ in range(3))
        rows, cols = [], []
        for p, (page, fs) in enumerate(zip(pages, described)):
            for i, f in enumerate(fs):
                y[p, i], inside[p, i] = labels[p][i], 1
                sibling[p, i] = i > 0 and page[i].parent == page[i - 1].parent
                have = [index[x] for x in f if x in index]
                rows += [p * longest + i] * len(have)
                cols += have
        rows, cols, every = np.array(rows), np.array(cols), np.arange(n)
        emit, follow = np.zeros((len(index), 2)), np.zeros((2, 2, 2))
        state = [np.zeros_like(emit), np.zeros_like(follow)]
        lengths = inside.sum(axis=1)
        for _ in range(ROUNDS):
            e = np.stack([np.bincount(rows, emit[cols, k], n * longest) for k in (0, 1)], axis=1).reshape(n, longest, 2)
            forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
            forward[:, 0] = e[:, 0]
            for i in range(1, longest):
                forward[:, i] = np.logaddexp.reduce(forward[:, i - 1, :, None] + follow[sibling[:, i]], axis=1) + e[:, i]
            for i in range(longest - 2, -1, -1):
                step = np.logaddexp.reduce(follow[sibling[:, i + 1]] + (e[:, i + 1] + backward[:, i + 1])[:, None, :], axis=2)
                backward[:, i] = np.where((i + 1 < lengths)[:, None], step, 0)
            total = np.logaddexp.reduce(forward[every, lengths - 1], axis=1)
            wrong = (y[:, :, None] == [0, 1]) - np.exp(forward + backward - total[:, None, None])
            wrong[inside == 0] = 0
            flat = wrong.reshape(-1, 2)
            d_emit = np.stack([np.bincount(cols, flat[rows, k], len(index)) for k in (0, 1)], axis=1) - PENALTY * n * emit / 10
            d_follow = -PENALTY * n * follow / 10
            for i in range(1, longest):
                on = i < lengths
                pair = np.exp(forward[on, i - 1, :, None] + follow[sibling[on, i]] + (e[on, i] + backward[on, i])[:, None, :] - total[on, None, None])
                np.add.at(d_follow, (sibling[on, i], y[on, i - 1], y[on, i]), 1)
                np.add.at(d_follow, sibling[on, i], -pair)
            for w, d, s in ((emit, d_emit, state[0]), (follow, d_follow, state[1])):
                s *= 0.9
                s += 0.1 * d * d
                w += 0.05 * d / (np.sqrt(s) + 1e-6)
        return cls(index, emit, follow)


@lru_cache(maxsize=1)
def trained(n_pages: int = TRAIN_PAGES, seed: int = 11) -> Field:
    rng, pages, labels = random.Random(seed), [], []
    for _ in range(n_pages):
        text, article = labelled_page(rng)
        page, at, own = blocks(text), 0, []
        for b in page:  # the article's blocks stand in page order
            hit = at < len(article) and b.text == article[at]
            own.append(hit)
            at += hit
        if page:
            pages.append(page)
            labels.append(own)
    return Field.fit(pages, labels)


def extract(field: Field, page: str) -> str:
    leaves = blocks(page, field.known.__contains__)
    return "\n\n".join(b.text for b, keep in zip(leaves, field.viterbi(leaves)) if keep)


def main_text(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    prepare(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(field or trained())  # a few hundred weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            texts = [extract(own, h or "") for h in b["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id AS long) AS page_id", "url", "html").mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")

"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

The field has two labels, main text and the rest. Its weights are fitted by maximum
likelihood on labelled pages, which a fixed rule lays out in the ways pages are built
(the given tables hold no labelled pages). A page is decoded by Viterbi.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.html_blocks import NAMES, blocks, described
from gradeloom.llm.shared import whole_text

#: Labelled pages for training, at most so many blocks of each, and rounds of ascent.
TRAINING_PAGES, TRAINING_BLOCKS, ROUNDS, PENALTY = 500, 120, 120, 0.02


class _Layout:
    """One labelled page: its HTML and which of its blocks are main text."""

    def __init__(self, seed: int):
        self.draw = random.Random(seed)
        self.labels: list[int] = []

    def words(self, low: int, high: int) -> str:
        n = self.draw.randint(low, high)
        made = ["".join(self.draw.choice("abcdeghilmnoprstu") for _ in range(self.draw.randint(2, 8))) for _ in range(n)]
        return " ".join(made)

    def sentence(self, low=4, high=20) -> str:
        text = self.words(low, high).capitalize()
        return text.replace(" ", ", ", 1) + "." if self.draw.random() < 0.4 else text + self.draw.choice(".......!?")

    def block(self, html: str, main: int) -> str:
        self.labels.append(main)
        return html

    def paragraphs(self, low: int, high: int) -> str:
        out = []
        for _ in range(self.draw.randint(low, high)):
            kind = self.draw.random()
            text = " ".join(self.sentence() for _ in range(self.draw.choice([1, 1, 2, 3, 5, 9])))
            if kind < 0.62:
                if kind < 0.1:
                    first, _, others = text.partition(" ")
                    text = f'{first} <a href="/{self.words(1, 1)}">{self.words(1, 3)}</a> {others}'
                out.append(self.block(self.draw.choice([f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<div>{text}</div>"]), 1))
            elif kind < 0.72:
                out.append(self.block(f"<h{self.draw.randint(2, 4)}>{self.words(1, 8)}</h2>".replace("</h2>", ""), 1))
                out[-1] += "</h2></h3></h4>"
            elif kind < 0.8:
                items = "".join(self.block(f"<li>{self.sentence(1, 12)}</li>", 1) for _ in range(self.draw.randint(2, 4)))
                out.append(f"<ul>{items}</ul>")
            elif kind < 0.86:
                out.append(self.block(f"<blockquote>{text}</blockquote>", 1))
            elif kind < 0.9:
                out.append(self.block(f"<pre>{text}</pre>", 1))
            elif kind < 0.94:
                out.append("<figure><img src=x>" + self.block(f"<figcaption>{self.sentence(2, 8)}</figcaption>", 1) + "</figure>")
            elif kind < 0.97:
                cells = "".join(self.block(f"<td>{self.words(1, 3)}</td>", 1) for _ in range(self.draw.randint(2, 4)))
                out.append(f"<table><tr>{cells}</tr></table>")
            else:
                out.append(self.block(f"<p>{self.words(1, 3).capitalize()}.</p>", 1))
            if self.draw.random() < 0.07:
                out.append(self.intruder())
        return "".join(out)

    def links(self, low: int, high: int) -> str:
        return "".join(
            self.block(f'<li><a href="/{self.words(1, 1)}">{self.words(1, 4)}</a></li>', 0)
            for _ in range(self.draw.randint(low, high))
        )

    def boiler(self, holder: str) -> str:
        """Some text that is not the article, within ``holder`` ("%s")."""
        text = self.block(self.draw.choice(["<p>%s</p>", "%s", "<div>%s</div>", "<span>%s</span>"]) % " ".join(self.sentence() for _ in range(self.draw.choice([1, 1, 2, 4]))), 0)
        return holder % text

    def intruder(self) -> str:
        return self.draw.choice([
            lambda: self.boiler('<div class="%s">%%s</div>' % self.draw.choice(["ad", "ads", "advert", "ad-slot", "sponsored", "promo-box"])),
            lambda: self.boiler('<aside>%s</aside>'),
            lambda: self.boiler('<div class="%s">%%s</div>' % self.draw.choice(["newsletter-signup", "related-posts", "share-buttons", "social"])),
            lambda: "<form>" + self.block(f"<label>{self.words(1, 3)}</label>", 0) + "<input name=q>" + self.block(f"<button>{self.words(1, 2)}</button>", 0) + "</form>",
            lambda: self.boiler('<div class="%s">%%s</div>' % self.draw.choice(["cookie-notice", "notice", "alert", "consent", "popup"])),
            lambda: '<nav class="toc"><ul>' + self.links(2, 4) + "</ul></nav>",
        ])()

    def comments(self) -> str:
        name = self.draw.choice(["comments", "comment-list", "discussion", "reader-comments", "responses"])
        inner = self.block(f"<h{self.draw.choice('23')}>{self.words(1, 3)}</h3></h2>", 0) if self.draw.random() < 0.6 else ""
        for _ in range(self.draw.randint(1, 5)):
            who = self.block(f"<span>{self.words(1, 2)}</span>", 0) if self.draw.random() < 0.0 else ""
            text = self.block(f"<p>{' '.join(self.sentence() for _ in range(self.draw.randint(1, 4)))}</p>", 0)
            inner += self.draw.choice([f'<div class="comment">{who}{text}</div>', f"<li>{who}{text}</li>", f"<article class='comment'>{who}{text}</article>", text])
        return f'<{(t := self.draw.choice(["section", "div", "aside"]))} {self.draw.choice(["class", "id"])}="{name}">{inner}</{t}>'

    def article(self) -> str:
        title = self.block(f"<h1>{self.words(2, 12).capitalize()}</h1>", 1)
        if self.draw.random() < 0.2:
            title = f"<header>{title}</header>"
        body = self.paragraphs(1, 14)
        end = ""
        if self.draw.random() < 0.12:
            end += self.boiler("<footer>%s</footer>")
        if self.draw.random() < 0.15:
            end += self.comments()
        inner = title + body + end
        holder = self.draw.random()
        if holder < 0.5:
            return f"<article>{inner}</article>"
        if holder < 0.65:
            return f"<main>{inner}</main>"
        if holder < 0.9:
            name = self.draw.choice(["content", "post-body", "entry-content", "article-body", "story", "main-content", "post", "page-text"])
            return f'<div {self.draw.choice(["class", "id"])}="{name}">{inner}</div>'
        return f"<div>{inner}</div>"

    def page(self) -> str:
        chance = self.draw.random
        if chance() < 0.06:
            # Bare pages: nothing but text.
            if chance() < 0.5:
                return self.draw.choice(["%s", "<div>%s</div>"]) % self.paragraphs(1, 5)
            return self.block(self.draw.choice(["%s", "<div>%s</div>", "<body>%s"]) % self.sentence(1, 30), 1)
        top, rest = "", ""
        if chance() < 0.4:
            top += "<header>" + self.boiler("%s") + (f"<nav><ul>{self.links(1, 4)}</ul></nav>" if chance() < 0.4 else "") + "</header>"
        elif chance() < 0.3:
            top += self.boiler('<div class="%s">%%s</div>' % self.draw.choice(["site-header", "masthead", "banner", "topbar"]))
        if chance() < 0.6:
            top += f"<nav><ul>{self.links(2, 8)}</ul></nav>"
        elif chance() < 0.5:
            top += f'<div class="{self.draw.choice(["menu", "navbar", "breadcrumbs", "main-nav"])}"><ul>{self.links(2, 6)}</ul></div>'
        for _ in range(self.draw.choice([0, 0, 1, 1, 2])):
            top += self.intruder()
        if chance() < 0.3:
            top += self.sidebar()
        body = self.article()
        if chance() < 0.25:
            rest += self.comments()
        if chance() < 0.3:
            rest += self.sidebar()
        for _ in range(self.draw.choice([0, 0, 0, 1, 2])):
            rest += self.intruder()
        if chance() < 0.75:
            rest += "<footer>" + self.block(self.draw.choice(["&copy; %s", "%s &middot; &copy;", "%s"]) % self.sentence(2, 12), 0) + "</footer>"
        elif chance() < 0.5:
            rest += self.boiler('<div id="%s">%%s</div>' % self.draw.choice(["footer", "page-footer", "bottom", "copyright"]))
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 5)}</title></head><body>{top}{body}{rest}</body></html>"

    def sidebar(self) -> str:
        parts = ""
        for _ in range(self.draw.randint(1, 3)):
            parts += self.block(f"<h3>{self.words(1, 3)}</h3>", 0) + (f"<ul>{self.links(2, 4)}</ul>" if self.draw.random() < 0.6 else self.boiler("%s"))
        return self.draw.choice(["<aside>%s</aside>", '<div class="sidebar">%s</div>', '<div id="right-rail" class="widget-area side">%s</div>']) % parts


def labelled_page(seed: int) -> tuple[str, list[int]]:
    """HTML of a training page and the labels of its blocks, 1 for main text."""
    layout = _Layout(seed)
    html = layout.page()
    return html, layout.labels


class Field:
    """Weights of the two labels' features and of the steps between labels."""

    def __init__(self, emission: np.ndarray, step: np.ndarray):
        self.emission, self.step = emission, step

    def decoded(self, features: list[list[int]]) -> list[int]:
        """The most likely labels of a page."""
        if not features:
            return []
        best, back = self.emission[:, features[0]].sum(axis=1), []
        for row in features[1:]:
            reached = best[:, None] + self.step
            back.append(reached.argmax(axis=0))
            best = reached.max(axis=0) + self.emission[:, row].sum(axis=1)
        labels = [int(best.argmax())]
        for came in reversed(back):
            labels.append(int(came[labels[-1]]))
        return labels[::-1]


def trained(pages: int = TRAINING_PAGES, first_seed: int = 0) -> Field:
    """The field fitted on ``pages`` labelled pages, by gradient ascent with AdaGrad steps."""
    data = []
    for seed in range(first_seed, first_seed + pages):
        html, labels = labelled_page(seed)
        features = described(blocks(html))
        # A layout whose blocks do not come out one to one has no labels to learn from.
        if len(features) == len(labels):
            data.append((features[:TRAINING_BLOCKS], labels[:TRAINING_BLOCKS]))
    longest, n, width = max(len(f) for f, _ in data), len(data), len(NAMES)
    x = np.zeros((n, longest, width), dtype=np.float32)
    y = np.zeros((n, longest), dtype=int)
    mask = np.zeros((n, longest), dtype=bool)
    for i, (features, labels) in enumerate(data):
        for t, row in enumerate(features):
            x[i, t, row] = 1
        y[i, : len(labels)], mask[i, : len(labels)] = labels, True
    truth = np.eye(2)[y] * mask[:, :, None]
    pairs = mask[:, 1:] & mask[:, :-1]
    true_steps = np.einsum("nti,ntj->ij", truth[:, :-1] * pairs[:, :, None], truth[:, 1:])
    emission, step = np.zeros((2, width)), np.zeros((2, 2))
    sum_e, sum_s = np.full_like(emission, 1e-8), np.full_like(step, 1e-8)
    for _ in range(ROUNDS):
        score = x @ emission.T.astype(np.float32)
        ahead, behind = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        ahead[:, 0] = score[:, 0]
        for t in range(1, longest):
            move = np.logaddexp.reduce(ahead[:, t - 1, :, None] + step, axis=1) + score[:, t]
            ahead[:, t] = np.where(mask[:, t, None], move, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            move = np.logaddexp.reduce(step + (score[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where(mask[:, t + 1, None], move, 0)
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        at = np.exp(ahead + behind - total[:, None, None]) * mask[:, :, None]
        both = np.exp(
            ahead[:, :-1, :, None] + step + (score[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]
        ) * pairs[:, :, None, None]
        slope_e = np.einsum("ntk,ntw->kw", truth - at, x) / n - PENALTY * emission / 10
        slope_s = (true_steps - both.sum(axis=(0, 1))) / n - PENALTY * step / 10
        sum_e += slope_e**2
        sum_s += slope_s**2
        emission += 0.5 * slope_e / np.sqrt(sum_e)
        step += 0.5 * slope_s / np.sqrt(sum_s)
    return Field(emission, step)


def main_text(html: str, field: Field) -> str:
    found = blocks(html)
    keep = field.decoded(described(found))
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extracted(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page: its main text.

    Character references are decoded, white space within a block becomes one space, and
    blocks are joined in page order by a line feed. A null or empty page, and one without
    main text, gives an empty text. Unclosed and stray tags are read as browsers do for
    blocks. Null ids and urls are kept, repeated pages give repeated rows, other columns
    are ignored, an empty table gives no rows. Pages of any length and depth are read whole,
    in time and memory linear in the page, one at a time, in one pass without a shuffle; the
    field is fitted on the driver from a fixed number of
    labelled pages.
    """
    field = field or trained()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), field) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        whole_text("html").alias("html"),
    )
    return rows.mapInArrow(read, "page_id long, url string, text string, n_chars long")

"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A block's features are the tags and names of its ancestors and plain facts about its text; neighbouring labels are linked
by transition weights, and Viterbi picks the best labelling of a page as a whole.  The field is trained here, on labelled
pages that a seeded generator lays out: articles in several kinds of markup between menus, headers, footers, sidebars,
notices, adverts, forms and comments, every block with its label.

Defined cases: null, empty or text-free html gives an empty text; repeated rows and nulls in other columns come back as they
are; broken markup is read as far as it goes; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislemetrics.llm.blocks import Block, leaf_blocks
from aislemetrics.llm.common import Memo, map_rows

# Labelled pages to train on, passes over them, and the weight of the penalty on large weights.
PAGES, PASSES, PENALTY = 400, 120, 1e-4

_TOKEN = re.compile(r"[a-z]+")


def path_features(path: tuple[tuple[str, str], ...]) -> list[str]:
    """Features of the ancestors: their tags, the two innermost, and the words in their class, id and role.

    Words count by their first seven letters, so that forms of one word (comment, comments) are one feature.
    """
    tags = [tag for tag, _ in path if tag not in ("html", "body")]
    features = {f"in:{tag}" for tag in tags}
    features.add(f"parent:{tags[-1] if tags else ''}")
    features.add(f"pair:{'>'.join(tags[-2:])}")
    for _, names in path:
        features.update(f"name:{token[:7]}" for token in _TOKEN.findall(names))
    return sorted(features)


def text_features(block: Block, place: int, count: int) -> list[str]:
    """Features of the text: its length, ending, links, signs, and where it stands on the page."""
    text = block.text
    linked = block.linked / len(text)
    return [
        "any",
        f"size:{min(10, int(math.log2(len(text))))}",
        f"links:{0 if not linked else 1 if linked < 0.5 else 2}",
        f"end:{text[-1] if text[-1] in '.!?:' else ''}",
        f"copyright:{'©' in text or '(c)' in text}",
        f"bars:{'|' in text}",
        f"place:{5 * place // count}",
    ]


@dataclass
class Field:
    """Weights of features by label (0 other, 1 main text), of neighbouring labels, and of the first label."""

    weights: dict[str, tuple[float, float]]
    moves: np.ndarray
    first: np.ndarray

    def labels(self, blocks: list[Block], known: Memo) -> list[int]:
        """Viterbi labels of a page; ``known`` keeps the sums over ancestors' features by path."""
        (a00, a01), (a10, a11) = self.moves.tolist()
        zero, back = (0.0, 0.0), []
        best0, best1 = self.first.tolist()
        for place, block in enumerate(blocks):
            own0, own1 = known[block.path]
            for feature in text_features(block, place, len(blocks)):
                w0, w1 = self.weights.get(feature, zero)
                own0, own1 = own0 + w0, own1 + w1
            if place:
                from0, from1 = best1 + a10 > best0 + a00, best1 + a11 > best0 + a01
                back.append((int(from0), int(from1)))
                best0, best1 = max(best0 + a00, best1 + a10) + own0, max(best0 + a01, best1 + a11) + own1
            else:
                best0, best1 = best0 + own0, best1 + own1
        if not blocks:
            return []
        found = [int(best1 > best0)]
        for step in reversed(back):
            found.append(step[found[-1]])
        return found[::-1]

    def by_path(self) -> Memo:
        def total(path: tuple) -> tuple[float, float]:
            pairs = [self.weights[f] for f in path_features(path) if f in self.weights]
            return sum(p[0] for p in pairs), sum(p[1] for p in pairs)

        return Memo(total)


def main_text(page: str | None, field: Field, known: Memo) -> str:
    blocks = leaf_blocks(page)
    return "\n".join(block.text for block, label in zip(blocks, field.labels(blocks, known)) if label)


# ---- labelled pages ----

# Names that sites give to parts of a page.
_PARTS = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav pagination pager toc tabs skip",
    "header": "header masthead branding logo site-header top banner tagline byline meta",
    "footer": "footer site-footer copyright bottom credits legal colophon",
    "aside": "sidebar aside widget related recommended trending popular rail tags archive categories bio",
    "notice": "cookie notice consent alert gdpr popup modal newsletter subscribe paywall toast dialog announcement",
    "advert": "ad ads advert advertisement sponsored promo promotion adsense dfp ad-slot commercial sponsor",
    "form": "search login signup contact-form poll form",
    "share": "share social sharing follow buttons toolbar actions",
    "comments": "comments comment commentlist comment-list replies discussion disqus responses respond",
}
_BODIES = [
    "<article>", "<article class='post'>", "<main>", "<main id='main'><article>", "<div class='content'>", "<div id='content'>",
    "<div class='entry-content'>", "<section class='article-body'>", "<div class='post-body'>", "<div role='main'>",
    "<article><div class='text'>", "<div class='story'>", "<body-part>",
]


class _Writer:
    """Writes a page and keeps the label of every block's text."""

    def __init__(self, rng: random.Random):
        self.rng, self.out, self.gold = rng, [], []

    def words(self, low: int, high: int) -> str:
        rng = self.rng
        words = ["".join(rng.choice("aeiourstlnmdhéüñ") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(low, high))]
        for i in range(0, len(words), rng.randint(6, 14)):
            words[i] = words[i].capitalize()
        return " ".join(words)

    def block(self, before: str, text: str, after: str, label: int) -> None:
        """One block; its label is kept under its text as it will be read."""
        self.out += [before, text, after]
        shown = leaf_blocks(f"<p>{text}</p>")
        self.gold += [(block.text, label) for block in shown]

    def prose(self) -> str:
        rng = self.rng
        end = rng.choice([".", ".", ".", ".", "!", "?", "", ":", "###", "%%% $$$"])
        text = self.words(*rng.choice([(1, 3), (4, 20), (10, 60), (40, 150)])) + end
        if rng.random() < 0.15:
            text += f" <a href='/x'>{self.words(1, 3)}</a> {self.words(2, 9)}."
        if rng.random() < 0.1:
            text = f"<b>{text}</b>"
        if rng.random() < 0.1:
            text += " &amp; " + self.words(1, 4) + "&nbsp;|"
        return text

    def part(self, kind: str) -> None:
        """A part that is not main text."""
        rng = self.rng
        name = rng.choice(_PARTS[kind].split())
        bare = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
        plain = bare and rng.random() < 0.45
        tag = bare if plain else rng.choice(["div", "div", "section", "ul" if kind == "nav" else "div", "aside" if kind == "aside" else "div"])
        named = rng.choice([f" class='{name}'", f" id='{name}'", f' class="{name} {name}-{rng.choice(["box", "area", "inner", "1"])}"'])
        self.out.append(f"<{tag}{'' if plain and rng.random() < 0.7 else named}>")
        if rng.random() < 0.3 and tag != "ul":
            head = rng.choice(["h2", "h3", "h4", "strong", "p", "span", "div"])
            self.block(f"<{head}>", self.words(1, 4), f"</{head}>" + ("<div></div>" if head in ("strong", "span") else ""), 0)
        if kind in ("nav", "share") or kind in ("aside", "footer") and rng.random() < 0.4:
            wrap = "" if tag == "ul" else rng.choice(["ul", "ol", "ul"])
            self.out.append(f"<{wrap}>" if wrap else "")
            for _ in range(rng.randint(2, 8)):
                self.block("<li>", f"<a href='/{rng.randint(1, 99)}'>{self.words(1, 3)}</a>", rng.choice(["</li>", "</li>", ""]), 0)
            self.out.append(f"</{wrap}>" if wrap else "")
        elif kind == "form":
            for _ in range(rng.randint(1, 4)):
                self.block(rng.choice(["<label>", "<p>", "<div>", "<fieldset><legend>"]), self.words(1, 4), "<input name='q'><div></div>", 0)
            self.block("<button>", self.words(1, 2), "</button>", 0)
        elif kind == "comments":
            self.out.append(rng.choice(["", "<ol>", "<ul>"]))
            for _ in range(rng.randint(1, 6)):
                self.out.append(rng.choice(["<li>", "<div class='comment'>", "<article class='comment'>", ""]))
                if rng.random() < 0.5:
                    self.block("<div class='author'>", self.words(1, 3), "</div>", 0)
                self.block("<p>", self.prose(), "</p>", 0)
            self.out.append("</div></article></li></ol></ul>")
        else:
            for _ in range(rng.randint(1, 3)):
                text = ("&copy; " if kind == "footer" and rng.random() < 0.6 else "") + self.prose()
                before, after = rng.choice([("<p>", "</p>"), ("<div>", "</div>"), ("<p>", "</p>"), ("", "<div></div>")])
                self.block(before, text, after, 0)
        self.out.append(f"</{tag}>")

    def article(self) -> None:
        rng = self.rng
        body = rng.choice(_BODIES)
        self.out.append("" if body == "<body-part>" else body)
        if rng.random() < 0.85:
            self.block("<h1>", self.words(2, 10), "</h1>", 1)
        for _ in range(rng.randint(2, 14)):
            kind = rng.random()
            if kind < 0.62:
                self.block("<p>", self.prose(), rng.choice(["</p>", "</p>", "</p>", ""]), 1)
            elif kind < 0.7:
                self.block("<p><b>", self.prose(), "<br>", 1)
            elif kind < 0.78:
                head = rng.choice(["h2", "h2", "h3", "h4"])
                self.block(f"<{head}>", self.words(1, 7), f"</{head}>", 1)
            elif kind < 0.84:
                wrap = rng.choice(["ul", "ol"])
                self.out.append(f"<{wrap}>")
                for _ in range(rng.randint(2, 6)):
                    self.block("<li>", self.words(1, 15) + rng.choice([".", ""]), "</li>", 1)
                self.out.append(f"</{wrap}>")
            elif kind < 0.88:
                self.block("<blockquote><p>", self.prose(), "</p></blockquote>", 1)
            elif kind < 0.9:
                self.block("<pre>", self.words(3, 20), "</pre>", 1)
            elif kind < 0.92:
                self.out.append("<table><tr>")
                for _ in range(rng.randint(2, 4)):
                    self.block("<td>", self.words(1, 5), "</td>", 1)
                self.out.append("</tr></table>")
            elif kind < 0.94:
                self.block("<figure><img src='x'><figcaption>", self.words(3, 12), "</figcaption></figure>", 1)
            elif kind < 0.96:
                self.block("<div>", self.prose(), "</div>", 1)
            else:
                self.part(rng.choice(["advert", "share", "aside", "notice", "form"]))
        if rng.random() < 0.2:
            self.part(rng.choice(["comments", "share", "aside"]))
        tags = [x for x in ("article", "main", "section", "div") if f"<{x}" in body]
        order = sorted(tags, key=lambda x: -body.rindex(f"<{x}"))
        self.out.append("".join(f"</{x}>" for x in order))


def labelled_page(rng: random.Random) -> tuple[list[Block], list[int]]:
    """A page's blocks and their labels."""
    page = _Writer(rng)
    page.out.append("<!DOCTYPE html><html><head><meta charset='utf-8'>")
    page.block("<title>", page.words(2, 10), "</title>", 0)
    page.out.append("<style>p{margin:0}</style><script>var t='</p>';</script></head><body>")
    around = ["nav", "header", "notice", "advert", "aside", "form", "share"]
    for kind in rng.sample(around, rng.randint(0, 4)):
        page.part(kind)
    page.article()
    if rng.random() < 0.45:
        page.part("comments")
    for kind in rng.sample([*around, "footer", "footer", "footer"], rng.randint(0, 4)):
        page.part(kind)
    if rng.random() < 0.9:
        page.out.append("</body></html>")
    blocks = leaf_blocks("".join(page.out))
    if [block.text for block in blocks] != [text for text, _ in page.gold]:
        raise AssertionError("a labelled page reads otherwise than it was written")
    return blocks, [label for _, label in page.gold]


# ---- training ----


def train(pages: int = PAGES, passes: int = PASSES, seed: int = 3) -> Field:
    """Maximise the likelihood of the labelled pages by Adam, all pages at once."""
    rng = random.Random(seed)
    data = [labelled_page(rng) for _ in range(pages)]
    seen: dict[str, int] = {}
    rows, columns, row = [], [], 0
    steps = max(len(blocks) for blocks, _ in data)
    place_of = np.zeros((len(data), steps), np.int64)
    valid = np.zeros((len(data), steps), bool)
    gold = np.zeros((len(data), steps), np.int64)
    for i, (blocks, labels) in enumerate(data):
        valid[i, : len(blocks)], gold[i, : len(blocks)] = True, labels
        for place, block in enumerate(blocks):
            place_of[i, place] = row
            for feature in path_features(block.path) + text_features(block, place, len(blocks)):
                rows.append(row)
                columns.append(seen.setdefault(feature, len(seen)))
            row += 1
    facts = np.zeros((row, len(seen)), np.float32)
    facts[rows, columns] = 1
    truth = np.eye(2)[gold[valid]]
    parameters = [np.zeros((len(seen), 2)), np.zeros((2, 2)), np.zeros(2)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    for count in range(1, passes + 1):
        weights, moves, first = parameters
        emit = np.zeros((len(data), steps, 2))
        emit[valid] = facts @ weights.astype(np.float32)
        alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
        alpha[:, 0] = emit[:, 0] + first
        for t in range(1, steps):
            new = np.logaddexp(alpha[:, t - 1, :1] + moves[0], alpha[:, t - 1, 1:] + moves[1]) + emit[:, t]
            alpha[:, t] = np.where(valid[:, t, None], new, alpha[:, t - 1])
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])[:, None]
        for t in range(steps - 2, -1, -1):
            ahead = beta[:, t + 1] + emit[:, t + 1]
            new = np.logaddexp(ahead[:, :1] + moves[:, 0], ahead[:, 1:] + moves[:, 1])
            beta[:, t] = np.where(valid[:, t + 1, None], new, 0)
        share = np.exp(alpha + beta - z[:, None])
        by_moves = np.zeros((2, 2))
        both = valid[:, 1:]
        for a in (0, 1):
            for b in (0, 1):
                joint = np.exp(alpha[:, :-1, a] + moves[a, b] + emit[:, 1:, b] + beta[:, 1:, b] - z)
                seen_pairs = (gold[:, :-1] == a) & (gold[:, 1:] == b)
                by_moves[a, b] = (joint - seen_pairs)[both].sum()
        by_first = (share[:, 0] - np.eye(2)[gold[:, 0]]).sum(axis=0)
        grads = [facts.T @ (share[valid] - truth).astype(np.float32), by_moves, by_first]
        for p, g, (m, v) in zip(parameters, grads, moments):
            g = g / len(data) + PENALTY * p
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= 0.1 * (m / (1 - 0.9**count)) / (np.sqrt(v / (1 - 0.999**count)) + 1e-8)
    weights, moves, first = parameters
    return Field({f: (float(weights[i, 0]), float(weights[i, 1])) for f, i in seen.items()}, moves, first)


def extract(pages: DataFrame, field: Field, html_col: str = "html", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``carry``, and text: the main text of the whole ``html_col``, one line a block."""

    def start():
        known = field.by_path()
        return lambda htmls: [[main_text(page, field, known) for page in htmls]]

    return map_rows(pages, "text string", [html_col], start, carry)


def with_length(extracted: DataFrame) -> DataFrame:
    return extracted.withColumn("n_chars", F.length("text").cast("long"))

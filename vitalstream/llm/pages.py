"""Main text of web pages by a linear-chain conditional random field.

A page becomes the sequence of its DOM leaf blocks: runs of text between tags
that open or close a block. A block's features are the tags, classes, ids and
roles of its ancestors and what its text looks like. Two labels, content and
other, form a chain; the field is trained on labelled pages and decoded by
Viterbi. The labelled pages are written by a seeded generator, which knows for
every block whether it belongs to the article.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML by how they lay out.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = frozenset("script style noscript template svg math iframe object canvas audio video title textarea head".split())
CLOSED_BY = {"p": BLOCK_TAGS, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "option": frozenset({"option"})}

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[a-z]+")


@dataclass(slots=True, eq=False)
class Element:
    tag: str
    names: tuple[str, ...]
    parent: Element | None


@dataclass(slots=True)
class Block:
    text: str
    inside: Element | None
    linked: int = 0

    def ancestors(self) -> Iterator[Element]:
        at = self.inside
        while at is not None:
            yield at
            at = at.parent


def _names(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    found = []
    for m in _ATTR.finditer(attributes):
        found += _NAME.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", m[2] or m[3] or m[4] or "").lower())
    return tuple(dict.fromkeys(found))


def leaf_blocks(source: str) -> list[Block]:
    """Text blocks in page order. Broken markup is read as far as it makes sense; nothing fails."""
    out: list[Block] = []
    stack: list[Element] = []
    open_tags: Counter[str] = Counter()
    parts: list[str] = []
    state = {"link": 0, "linked": 0}

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, stack[-1] if stack else None, state["linked"]))
            parts.clear()
        state["linked"] = 0

    at, n = 0, len(source)
    while at < n:
        m = _MARKUP.search(source, at)
        start = m.start() if m else n
        if start > at:
            piece = source[at:start]
            parts.append(piece)
            if state["link"]:
                state["linked"] += len(piece)
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                state["link"] = max(0, state["link"] - 1)
            elif tag in BLOCK_TAGS:
                flush()
                if tag == "body" or tag == "html":
                    continue
                while open_tags[tag]:
                    gone = stack.pop().tag
                    open_tags[gone] -= 1
                    if gone == tag:
                        break
                state["link"] = 0
            continue
        if tag in SILENT_TAGS:
            if m[3].endswith("/"):
                continue
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
            if tag == "head":
                continue
            at = end.end() if end else n
            if tag in ("iframe", "object", "video", "audio", "canvas", "textarea"):
                parts.append(" ")
            continue
        if tag == "br" or tag == "hr":
            if tag == "hr":
                flush()
            else:
                parts.append(" ")
        elif tag == "a":
            state["link"] += 1
        elif tag in BLOCK_TAGS:
            flush()
            while stack and tag in CLOSED_BY.get(stack[-1].tag, ()):
                open_tags[stack.pop().tag] -= 1
            state["link"] = 0
            if tag not in VOID_TAGS:
                stack.append(Element(tag, _names(m[3]), stack[-1] if stack else None))
                open_tags[tag] += 1
    flush()
    return out


# Names that pages give their parts; the generator draws from them.
OTHER_NAMES = {
    "nav": "nav navbar menu navigation topnav mainmenu breadcrumb breadcrumbs crumbs toc pagination pager skip links sitemap language",
    "header": "header masthead banner top topbar branding logo site tagline hero",
    "footer": "footer bottom copyright legal colophon imprint credits",
    "aside": "sidebar aside related recommended recommendations popular trending widget widgets more also teaser rail",
    "ad": "ad ads adv advert advertisement advertising sponsor sponsored promo promotion promoted commercial adsense dfp banner",
    "notice": "notice cookie cookies consent gdpr privacy alert warning popup modal overlay announcement paywall disclaimer message",
    "form": "form newsletter subscribe subscription signup login search searchbox contact poll survey",
    "comments": "comments comment commentlist replies reply respond discussion disqus feedback reader responses thread",
    "share": "share sharing social follow buttons toolbar tags meta byline author date",
}
MAIN_NAMES = "content post entry article story main body text page primary maincontent articlebody postbody single copy wrapper container".split()
PLAIN_NAMES = "row col inner box block section lead intro wide left right clearfix group item grid center".split()
#: The kinds of part that a name is used for: names seldom seen in training share the weight of their kind.
KIND_OF = {name: [k for k, names in OTHER_NAMES.items() if name in names.split()] for names in OTHER_NAMES.values() for name in names.split()}


def _element(tag: str, names: tuple[str, ...]) -> list[str]:
    kinds = {k for x in names for k in KIND_OF.get(x, ())}
    return [f"in={tag}", *(f"name={x}" for x in names), *(f"kind={k}" for k in sorted(kinds)), *(["other"] if kinds and not any(x in MAIN_NAMES for x in names) else [])]


def _text_features(block: Block) -> list[str]:
    words = block.text.count(" ") + 1
    share = min(4, int(4 * block.linked / max(1, len(block.text))))
    leaf = block.inside.tag if block.inside else "none"
    above = block.inside.parent if block.inside else None
    core = any(e.tag in ("article", "main") for e in block.ancestors())
    out = [f"leaf={leaf}", f"up={above.tag if above else 'none'}", f"up={above.tag if above else 'none'}>{leaf}", f"{'core' if core else 'outer'}:{above.tag if above else 'none'}", "named" if any(x.names for x in (block.inside, above) if x) else "unnamed", f"words={min(7, words.bit_length())}", f"links={share}", "stop" if block.text[-1] in ".!?:;\"'”»)" else "open", "bias"]
    if block.text[0] in "©®" or "©" in block.text or "copyright" in block.text.lower():
        out.append("rights")
    return out


@dataclass
class ChainField:
    """Two-label chain: the weight of a feature for content over other, and of label pairs."""

    weights: dict[str, float] = field(default_factory=dict)
    pairs: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def emissions(self, blocks: list[Block]) -> list[float]:
        known, sums, out = self.weights.get, {None: 0.0}, []
        for b in blocks:
            new = []
            for at in b.ancestors():
                if at in sums:
                    break
                new.append(at)
            for at in reversed(new):
                sums[at] = sums[at.parent] + sum(known(f, 0.0) for f in _element(at.tag, at.names))
            out.append(sums[b.inside] + sum(known(f, 0.0) for f in _text_features(b)))
        return out

    def decode(self, blocks: list[Block]) -> list[bool]:
        """Viterbi: the best labelling of the whole sequence."""
        if not blocks:
            return []
        (p00, p01), (p10, p11) = self.pairs.tolist()
        back, a, b = [], 0.0, None
        for e in self.emissions(blocks):
            if b is None:
                a, b = 0.0, e
                continue
            x, y = a + p00, b + p10
            u, v = a + p01, b + p11
            back.append((y > x, v > u))
            a, b = max(x, y), max(u, v) + e
        state = b > a
        out = [state]
        for zero, one in reversed(back):
            state = one if state else zero
            out.append(state)
        return out[::-1]


def train(pages: list[tuple[list[Block], list[bool]]], rounds: int = 250, rate: float = 0.3, ridge: float = 5e-5) -> ChainField:
    """Maximum likelihood by Adam, with forward-backward over all pages side by side."""
    rows = [[*(f for at in b.ancestors() for f in _element(at.tag, at.names)), *_text_features(b)] for blocks, _ in pages for b in blocks]
    index = {f: i for i, f in enumerate(sorted({f for r in rows for f in r}))}
    x = np.zeros((len(rows), len(index)), np.float32)
    for i, r in enumerate(rows):
        for f in r:
            x[i, index[f]] += 1
    longest, count = max(len(b) for b, _ in pages), len(pages)
    place = np.full((count, longest), -1)
    gold = np.zeros((count, longest), np.int64)
    k = 0
    for p, (blocks, labels) in enumerate(pages):
        place[p, : len(blocks)] = np.arange(k, k + len(blocks))
        gold[p, : len(blocks)] = labels
        k += len(blocks)
    real = place >= 0
    theta, m, v = (np.zeros(len(index) + 4) for _ in range(3))
    seen = np.zeros((2, 2))
    np.add.at(seen, (gold[:, :-1][real[:, 1:]], gold[:, 1:][real[:, 1:]]), 1)
    y = gold[real].astype(np.float64)
    for t in range(1, rounds + 1):
        w, pairs = theta[:-4], theta[-4:].reshape(2, 2)
        e = np.zeros((count, longest, 2))
        e[real, 1] = (x @ w.astype(np.float32))[place[real]]
        f, b = np.zeros_like(e), np.zeros_like(e)
        f[:, 0] = e[:, 0]
        for i in range(1, longest):
            step = np.logaddexp(f[:, i - 1, :1] + pairs[0], f[:, i - 1, 1:] + pairs[1]) + e[:, i]
            f[:, i] = np.where(real[:, i, None], step, f[:, i - 1])
        for i in range(longest - 2, -1, -1):
            after = e[:, i + 1] + b[:, i + 1]
            step = np.logaddexp(pairs[None, :, 0] + after[:, :1], pairs[None, :, 1] + after[:, 1:])
            b[:, i] = np.where(real[:, i + 1, None], step, 0)
        total = np.logaddexp(f[:, -1, 0], f[:, -1, 1])
        p1 = np.exp(f[..., 1] + b[..., 1] - total[:, None])[real]
        both = np.exp(f[:, :-1, :, None] + pairs + (e + b)[:, 1:, None, :] - total[:, None, None, None])
        expected = (both * real[:, 1:, None, None]).sum((0, 1))
        g = np.concatenate([x.T @ (p1 - y)[np.argsort(place[real])].astype(np.float32), (expected - seen).ravel()]) / len(rows) + ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= rate / (1 + t / 60) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return ChainField({f: float(theta[i]) for f, i in index.items() if abs(theta[i]) > 1e-4}, theta[-4:].reshape(2, 2).copy())


class PageWriter:
    """Writes pages whose blocks are labelled, for training and for tests."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.serial = 0

    def words(self, lo: int, hi: int, stop: bool = True) -> str:
        out = " ".join("".join(self.r.choice(("an", "be", "co", "der", "en", "is", "lo", "mi", "ou", "ter")) for _ in range(self.r.randint(1, 3))) for _ in range(self.r.randint(lo, hi)))
        return out.capitalize() + (self.r.choice("....!?") if stop else "")

    def block(self, tag: str, text: str, content: bool) -> str:
        """A leaf whose label rides in its text as a mark that read() takes off again."""
        return f"<{tag}>{'\x01' if content else '\x02'}{text}</{tag}>"

    def other(self, inside: bool) -> str:
        r = self.r
        kind = r.choice(list(OTHER_NAMES))
        name = r.choice(OTHER_NAMES[kind].split())
        if r.random() < 0.3:
            name += r.choice(["-", "_", " "]) + r.choice([*PLAIN_NAMES, *OTHER_NAMES[kind].split()])
        tag = kind if kind in ("nav", "header", "footer", "aside", "form") and r.random() < 0.6 else r.choice(["div", "div", "section", "ul" if kind in ("nav", "share") else "div"])
        if tag == "header" and inside:
            tag = "div"
        attribute = "" if tag not in ("div", "section", "ul") and r.random() < 0.5 else f' {r.choice(["class", "class", "id"])}="{name}"'
        if tag != "ul" and r.random() < 0.3:  # text straight inside
            mark = "\x02" + r.choice(["© ", "", ""]) * (kind == "footer")
            links = r.random() < 0.3 and kind in ("nav", "share", "footer", "header")
            text = " ".join(f'<a href="/{k}">{self.words(1, 2, False)}</a>' for k in range(r.randint(1, 4))) if links else self.words(1, 25, r.random() < 0.7)
            return f"<{tag}{attribute}>{mark}{text}</{tag}>"
        items = []
        for _ in range(r.randint(1, 6 if kind in ("nav", "aside", "comments") else 3)):
            if tag == "ul" or kind in ("nav", "share", "aside") and r.random() < 0.7:
                items.append(self.block("li", f'<a href="/{r.randint(1, 99)}">{self.words(1, 4, False)}</a>', False))
            elif kind == "form":
                items.append(r.choice([f"<label>\x02{self.words(1, 3, False)}</label><input>", self.block("button", self.words(1, 2, False), False), self.block("p", self.words(4, 20), False)]))
            elif kind == "comments":
                items.append(f'<div class="{r.choice(["comment", "reply", "item", "body"])}">{self.block("p", self.words(3, 50), False)}</div>')
            else:
                items.append(self.block(r.choice(["h1", "h2", "p"] if kind == "header" else ["p", "p", "div", "p", "h3"]), r.choice(["© ", "", ""]) * (kind == "footer") + self.words(2, 35, r.random() < 0.8), False))
        body = "".join(items)
        if tag != "ul" and "<li>" in body:
            body = body.replace("<li>", "<ul><li>", 1)[::-1].replace("</li>"[::-1], "</li></ul>"[::-1], 1)[::-1]
        return f"<{tag}{attribute}>{body}</{tag}>"

    def paragraph(self) -> str:
        r = self.r
        k = r.random()
        if k < 0.72:
            return self.block("p", self.words(1, 80), True)
        if k < 0.8:
            return self.block(r.choice(["h2", "h3"]), self.words(1, 7, False), True)
        if k < 0.87:
            return "<ul>" + "".join(self.block("li", self.words(2, 15, r.random() < 0.5), True) for _ in range(r.randint(2, 4))) + "</ul>"
        if k < 0.91:
            return f"<blockquote>{self.block('p', self.words(5, 40), True)}</blockquote>"
        if k < 0.94:
            return "<table><tr>" + "".join(self.block("td", self.words(1, 4, False), True) for _ in range(r.randint(2, 4))) + "</tr></table>"
        if k < 0.955:
            return f"<figure>{self.block('figcaption', self.words(3, 15), True)}</figure>"
        if k < 0.97:
            return self.block("pre", self.words(3, 20, False), True)
        return self.block("p", f'{self.words(3, 20)} <a href="#">{self.words(1, 5, False)}</a> {self.words(1, 20)}', True)

    def page(self) -> str:
        r = self.r
        inner = [self.block("h1", self.words(2, 9, r.random() < 0.3), True)] if r.random() < 0.85 else []
        if inner and r.random() < 0.25:
            inner = [f"<header>{inner[0]}</header>"]
        for _ in range(r.randint(1, 12)):
            inner.append(self.paragraph())
            if r.random() < 0.18:
                inner.append(self.other(True))
        if r.random() < 0.25:
            inner.append(self.other(True))
        body = "".join(inner)
        for _ in range(r.randint(0, 2)):
            if r.random() < 0.5:
                body = f'<div class="{r.choice(PLAIN_NAMES)}">{body}</div>'
        k = r.random()
        if k < 0.45:
            body = f"<article{r.choice(['', f' class=\"{r.choice(MAIN_NAMES)}\"'])}>{body}</article>"
        elif k < 0.6:
            body = f"<main>{body}</main>"
        elif k < 0.9:
            tag = r.choice(["div", "div", "section"])
            body = f'<{tag} {r.choice(["class", "id"])}="{r.choice(MAIN_NAMES)}{r.choice([" ", "-"])}{r.choice(["", *PLAIN_NAMES, *MAIN_NAMES])}">{body}</{tag}>'
        if r.random() < 0.25:
            body = f"<main>{body}</main>"
        elif r.random() < 0.1:
            body = f"<section>{body}</section>"
        before = "".join(self.other(False) for _ in range(r.randint(0, 4)))
        after = "".join(self.other(False) for _ in range(r.randint(0, 4)))
        return f"<!DOCTYPE html><html><head><title>x</title></head><body>{before}{body}{after}</body></html>"

    def labelled(self) -> tuple[list[Block], list[bool]]:
        blocks = leaf_blocks(self.page())
        labels = ["\x01" in b.text for b in blocks]  # a mark rides in each block's text
        for b in blocks:
            b.text = b.text.replace("\x01", "").replace("\x02", "").strip() or "x"
        return blocks, labels


@lru_cache(maxsize=4)
def default_field(pages: int = 500, seed: int = 3) -> ChainField:
    """Trained once in a process."""
    writer = PageWriter(seed)
    return train([p for p in (writer.labelled() for _ in range(pages)) if p[0]])


def main_text(source: str | None, model: ChainField) -> str:
    blocks = leaf_blocks(source or "")
    return "\n".join(b.text for b, keep in zip(blocks, model.decode(blocks), strict=True) if keep)


def extract(pages: DataFrame, model: ChainField | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``.

    Null and empty pages, and pages with no article, give an empty text.
    Repeated rows are read each; an empty table gives an empty result. Pages
    are read whole, in a map over Arrow batches with no shuffle.
    """
    model = model or default_field()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(s, model) for s in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return slim.mapInArrow(each, "page_id long, url string, text string, n_chars long")

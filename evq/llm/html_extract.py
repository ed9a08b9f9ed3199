"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the page.

A leaf block is a run of text under the same innermost block element. Its features come from its ancestors (tags and
the words of their class, id and role) and its text. The field is trained on labelled pages, whose articles stand in
holders of telling names, in others or in none, and decoded by Viterbi: nothing but the field decides. A page's time
and memory grow in proportion to its length, however deep its elements nest.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hashed features: so many that words which training never met rarely share the weight of one it did.
WIDTH = 1 << 17
#: Elements that don't end a block.
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't text of the page; all but title are raw text in which tags don't count.
RAW = frozenset("script style noscript template textarea title iframe svg xmp".split())
#: Opening one of these closes an open one of the same group up to the next container.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CONTAINERS = frozenset("table ul ol dl div article section main body aside nav form".split())
#: Names of ancestors that a block knows: the nearest different ones, so many.
NEAREST = 64
PARAGRAPH_ENDERS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[a-zA-Z]+")
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]  # different names, innermost first: tag, or tag.word for a class, id or role; shared by blocks
    linked: int  # characters inside links


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order with references decoded and white space made one; blank ones are left out.

    Markup that is never closed or never opened is borne as browsers do: an unknown end tag is skipped, p, li and
    table cells end where the next one starts, text after a cut comment or tag is lost with it.
    """
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    places: dict[str, list[int]] = {}  # where in the stack a tag is
    held: list[int] = []  # where a container is
    parts: list[str] = []
    linked = link = at = 0

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        if text:
            out.append(Block(text, stack[-1][1] if stack else (), min(linked, len(text))))
        parts.clear()
        linked = 0

    def cut(to: int) -> None:
        while len(stack) > to:
            tag, _ = stack.pop()
            places[tag].pop()
            if tag in CONTAINERS:
                held.pop()

    def said(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if link:
            linked += len(text)

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            said(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in INLINE:
                link -= tag == "a" and link > 0
                continue
            if places.get(tag):
                flush()
                cut(places[tag][-1])
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            if tag not in ("title",) and tag not in INLINE:
                flush()
            continue
        if tag in INLINE:
            link += tag == "a"
            if tag in ("br", "wbr"):
                parts.append(" ")
            continue
        flush()
        for closed in (*(("p",) if tag in PARAGRAPH_ENDERS else ()), *CLOSES.get(tag, ())):
            if places.get(closed) and places[closed][-1] > (held[-1] if held else -1):
                cut(places[closed][-1])
        if tag not in VOID:
            names = (tag, *(f"{tag}.{w.lower()}" for n in _NAMES.findall(m[3]) for w in _PARTS.findall("".join(n))))
            near = tuple(dict.fromkeys((*names[::-1], *(stack[-1][1] if stack else ()))))[:NEAREST]
            stack.append((tag, near))
            places.setdefault(tag, []).append(len(stack) - 1)
            if tag in CONTAINERS:
                held.append(len(stack) - 1)
    if at < len(page):
        said(page[at:])
    flush()
    return out


def features(found: Sequence[Block]) -> list[np.ndarray]:
    """Hashed binary features of each block, with those of its neighbours' paths."""
    own: list[list[str]] = []
    for i, b in enumerate(found):
        path = [p for p in b.path if p not in ("html", "body")]
        n, text = len(b.text), b.text
        words = [w.lower() for w in _PARTS.findall(text)[:2]] if n < 80 else []
        marks = sum(text.count(c) for c in ".,;:!?")
        own.append(
            ["bias", f"in:{path[0] if path else ''}", f"len:{int(np.log2(n + 1))}", f"link:{int(4 * b.linked / n)}", f"marks:{min(5, int(40 * marks / n))}", f"ends:{text[-1] if text[-1] in '.!?:' else ''}", f"first:{i == 0}", f"last:{i == len(found) - 1}"]
            + [f"up:{p}" for p in path] + [f"part:{p.partition('.')[2]}" for p in path if "." in p]
            + [f"copy:{text[0] == chr(169)}"] * (text[0] == chr(169)) + [f"w:{w}" for w in words]
        )
    out = []
    for i, names in enumerate(own):
        near = [f"{s}:{x}" for s, j in (("p", i - 1), ("n", i + 1)) for x in (own[j] if 0 <= j < len(own) else ["none"]) if x.startswith(("in:", "none"))]
        out.append(np.unique(np.array([xxhash.xxh32_intdigest(x) % WIDTH for x in names + near])))
    return out


@dataclass
class Field:
    """States 0 (left out) and 1 (main text)."""

    emit: np.ndarray  # WIDTH x 2
    step: np.ndarray  # 2 x 2
    start: np.ndarray  # 2

    def scores(self, xs: Sequence[np.ndarray]) -> np.ndarray:
        return np.array([self.emit[x].sum(0) for x in xs])

    def decode(self, xs: Sequence[np.ndarray]) -> list[int]:
        if not xs:
            return []
        e = self.scores(xs)
        best, back = self.start + e[0], []
        for row in e[1:]:
            through = best[:, None] + self.step
            back.append(through.argmax(0))
            best = through.max(0) + row
        state = int(best.argmax())
        states = [state]
        for b in reversed(back):
            state = int(b[state])
            states.append(state)
        return states[::-1]


def fit(pages: Sequence[tuple[Sequence[np.ndarray], Sequence[int]]], rounds: int = 12, rate: float = 0.2, ridge: float = 1e-4) -> Field:
    """Maximum likelihood by stochastic gradients with AdaGrad steps; expectations by forward and backward passes."""
    f = Field(np.zeros((WIDTH, 2)), np.zeros((2, 2)), np.zeros(2))
    seen = Field(np.full((WIDTH, 2), 1e-6), np.full((2, 2), 1e-6), np.full(2, 1e-6))
    for _ in range(rounds):
        for xs, ys in pages:
            if not xs:
                continue
            e, n = f.scores(xs), len(xs)
            fw, bw = np.zeros((n, 2)), np.zeros((n, 2))
            fw[0] = f.start + e[0]
            for i in range(1, n):
                fw[i] = np.logaddexp.reduce(fw[i - 1][:, None] + f.step, 0) + e[i]
            for i in range(n - 2, -1, -1):
                bw[i] = np.logaddexp.reduce(f.step + (e[i + 1] + bw[i + 1])[None], 1)
            z = np.logaddexp.reduce(fw[-1])
            node = -np.exp(fw + bw - z)
            step = np.zeros((2, 2))
            for i in range(1, n):
                step -= np.exp(fw[i - 1][:, None] + f.step + (e[i] + bw[i])[None] - z)
                step[ys[i - 1], ys[i]] += 1
            node[np.arange(n), ys] += 1
            start = node[0]
            for x, g in zip(xs, node):
                g = g[None] - ridge * f.emit[x]
                seen.emit[x] += g**2
                f.emit[x] += rate * g / np.sqrt(seen.emit[x])
            for w, s, g in ((f.step, seen.step, step), (f.start, seen.start, start)):
                s += g**2
                w += rate * g / np.sqrt(s)
    return f


def labelled_pages(n: int = 480, seed: int = 11) -> list[tuple[str, list[str]]]:
    """Made-up pages with the texts of their main blocks: varied layouts of articles among everything to be left out."""
    rng = np.random.default_rng(seed)
    syllables = "ba re ti lo mun der sha est ion al que ou en pra vi".split()

    def word() -> str:
        return "".join(rng.choice(syllables, rng.integers(1, 4)))

    def pick(*xs: str) -> str:
        return str(rng.choice(xs))

    def phrase(low: int, high: int) -> str:
        return " ".join(word() for _ in range(rng.integers(low, high + 1)))

    def sentence() -> str:
        style = rng.random()
        if style < 0.12:
            return " ".join(w + rng.choice(["###", "%%%", "***", "$$$"]) for w in phrase(3, 20).split())
        if style < 0.24:
            return " | ".join(w + pick("", "", ",", ".") for w in phrase(2, 9).split()) + " |"
        if style < 0.3:
            return phrase(2, 12).upper() + "!!"
        return phrase(1, 24).capitalize() + "."

    def item(tag: str, text: str) -> str:
        return f"<{tag}>{text}</{tag}>"

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{phrase(1, 2)}</a></li>' for _ in range(k)) + "</ul>"

    pages = []
    for _ in range(n):
        main: list[str] = []
        body = ""
        title = sentence()
        inner = ""
        if rng.random() < 0.9:
            main.append(title)
            inner += item("h1", title) if rng.random() < 0.8 else f"<header>{item('h1', title)}</header>"
        for k in range(rng.integers(1, 9)):
            text = " ".join(sentence() for _ in range(rng.integers(1, 6)))
            kind = rng.random()
            if kind < 0.6:
                main.append(text)
                inner += item("p", text)
            elif kind < 0.72:
                main.append(text)
                inner += f"<p><b>{text}<br>"
            elif kind < 0.8:
                main.append(t := phrase(2, 5).capitalize())
                inner += item(pick("h2", "h3"), t)
            elif kind < 0.86:
                rows = [phrase(1, 6) for _ in range(rng.integers(2, 5))]
                main += rows
                inner += item(pick("ul", "ol"), "".join(item("li", r) for r in rows))
            elif kind < 0.91:
                main.append(text)
                inner += item("blockquote", item("p", text))
            elif kind < 0.94:
                cells = [phrase(1, 3) for _ in range(4)]
                main += cells
                inner += f"<table><tr><td>{cells[0]}</td><td>{cells[1]}</td></tr><tr><td>{cells[2]}</td><td>{cells[3]}</td></tr></table>"
            else:
                inner += f'<div class="{pick("ad", "ads", "advert", "sponsored", "promo banner", "newsletter", "share social", "related")}">{sentence()}</div>'
        if rng.random() < 0.12:  # a page that is nothing but text
            lines = [" ".join(sentence() for _ in range(rng.integers(1, 4))) for _ in range(rng.integers(1, 3))]
            pages.append(("\n".join(lines), [" ".join(lines)]))
            continue
        holder = pick("article", "article", "article", "main", 'div class="content"', 'div id="article body"', 'div class="post entry"', "", "div", f'div id="{word()}"', f'section class="{word()} {word()}"', "table><tr><td")
        tag = holder.split()[0] if holder else ""
        if holder.startswith("table"):
            inner, tag = inner + "</td></tr>", "table"
        ad = f'<div class="{pick("ad", "ads", "advert", "advertisement", "sponsor", "banner", "promo")}">{sentence()}</div>'
        notice = f'<div class="{pick("cookie notice", "notice", "consent", "cookie-banner", "alert")}">{item("p", sentence()) if rng.random() < 0.5 else sentence()}</div>'
        comments = f'<{(c := pick("section", "div"))} class="{pick("comments", "comment-list", "reader comments", "disqus")}">' + item("h2", "Comments") + "".join(f'<div class="comment">{item("p", sentence())}</div>' for _ in range(rng.integers(1, 4))) + f"</{c}>"
        menu = pick("nav", "nav", 'div class="menu"', 'ul class="navigation"')
        if rng.random() < 0.9:
            body += f"<{menu}>{links(rng.integers(2, 8))}</{menu.split()[0]}>"
        if rng.random() < 0.5:
            top = f"<header>{item(pick('h1', 'div', 'p', 'span'), phrase(1, 4))}</header>" if rng.random() < 0.7 else f'<div class="header site">{phrase(1, 4)}</div>'
            body = top + body if rng.random() < 0.5 else body + top
        body += f"<!-- ad {rng.integers(9)} -->" + ad if rng.random() < 0.6 else ""
        body += notice if rng.random() < 0.3 else ""
        body += f"<{holder}>{inner}</{tag}>" if holder else inner
        body += comments if rng.random() < 0.35 else ""
        body += f"<aside>{item('h3', phrase(1, 3))}{links(3) if rng.random() < 0.5 else item('p', sentence())}</aside>" if rng.random() < 0.4 else ""
        body += f'<div class="{pick("sidebar", "side", "related", "widget")}">{item("p", sentence())}{links(2)}</div>' if rng.random() < 0.3 else ""
        body += f'<form action="/s"><label>{phrase(1, 3)}</label><input name="q"><button>{phrase(1, 2)}</button>{item("p", sentence()) if rng.random() < 0.3 else ""}</form>' if rng.random() < 0.3 else ""
        body += ad if rng.random() < 0.2 else ""
        foot = pick("footer", "footer", "footer", 'div class="footer"', 'div id="copyright"')
        body += f"<{foot}>&copy; {word()}.example &middot; {sentence()}</{foot.split()[0]}>" if rng.random() < 0.85 else ""
        pages.append((f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>{body}</body></html>', main))
    return pages


def train(pages: Sequence[tuple[str, Sequence[str]]] | None = None) -> Field:
    """A field from labelled pages: html and the texts of its main blocks (each counts for one block, in order)."""
    rows = []
    for page, main in pages if pages is not None else labelled_pages():
        found, wanted, at = blocks(page), [" ".join(t.split()) for t in main], 0
        ys = []
        for b in found:
            hit = at < len(wanted) and b.text == wanted[at]
            at += hit
            ys.append(int(hit))
        rows.append((features(found), ys))
    return fit(rows)


def extract(page: str | None, field: Field) -> str:
    """The main text: blocks the field takes, joined by line feeds; empty for null, empty or unmarked-up nothing."""
    found = blocks(page)
    return "\n".join(b.text for b, y in zip(found, field.decode(features(found))) if y)


def extract_all(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages; other columns aren't read and repeated rows give equal rows."""
    field = field or train()
    kinds = {f.name: f.dataType.simpleString() for f in pages.select("page_id", "url").schema}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h, field) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.col("html")).mapInArrow(rows, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")

"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A leaf block is the text between two borders of block elements. Its features are the tags, class and
id words of its ancestors and simple facts about its text; the chain has the states main and other.
The field is trained on labelled pages and decoded by Viterbi. Labelled pages are of two kinds:
pages built by a rule below in many layouts, with a label for every block, and a bounded sample
(``MAX_TRAINING_PAGES``, those with the smallest hash) of the given pages that mark their article.
Training pages are read whole and cut into runs of ``TRAINING_BLOCKS`` blocks; at most
``MAX_TRAINING_RUNS`` runs of given pages, those with the smallest hash, are used.

Scripts, styles, templates, titles and the contents of form fields are no blocks; text inside
formulas, drawings and frames is text. Character references are decoded piece by piece between
tags, white space in a block becomes one space, blocks are joined by one line break. Null, empty and
text-free pages give an empty text; unclosed scripts, styles and comments end with the page, other
tags without an end cost nothing. Repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.store import whole_texts

MAX_TRAINING_PAGES, MAX_TRAINING_RUNS, TRAINING_BLOCKS = 200, 200, 120

# Element names of HTML.
RAW = frozenset(("script", "style", "template", "title", "select", "textarea"))
VOID = frozenset(("meta", "link", "img", "input", "hr", "source", "track", "area", "base", "col", "embed",
                  "param", "wbr"))
BLOCKS = (
    "html", "head", "body", "main", "article", "section", "nav", "header", "footer", "aside", "div", "form",
    "fieldset", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead",
    "tbody", "tr", "td", "th", "blockquote", "pre", "figure", "figcaption", "address", "button", "label",
    "dialog", "menu", "details", "summary", "hr", "center", "caption", "legend", "noscript")
# What class and id words say about a part of a page.
GROUPS = {
    "advert": "ad ads advert advertisement adverts promo promoted sponsor sponsored banner",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar pagination pager",
    "side": "sidebar side aside widget related recommended trending popular more",
    "notice": "cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe",
    "comment": "comment comments reply replies respond disqus discussion thread",
    "foot": "footer foot copyright legal bottom colophon credits",
    "head": "header masthead head logo brand top",
    "share": "share social follow tags tag byline author meta",
    "body": "content article post entry story main text body",
}
_GROUP_OF = {w: g for g, words in GROUPS.items() for w in words.split()}
TEXT = ["words<3", "words<8", "words<20", "words<60", "words>=60", "sentence", "links", "all links",
        "copyright", "question", "first", "bars", "capital"]
NAMES = [f"in {t}" for t in BLOCKS] + [f"at {t}" for t in BLOCKS] + \
    [f"has {g}" for g in GROUPS] + ["plain", "bias"] + TEXT
_AT = {name: k for k, name in enumerate(NAMES)}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<[/!?A-Za-z][^<>]*+\Z|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_CLASSES = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORDS = re.compile(r"[a-z]+")
_CLOSES = {  # an open element of these ends where another of these begins
    "p": frozenset(BLOCKS) - {"html", "head", "body"}, "li": frozenset(("li",)),
    "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "tr": frozenset(("tr",)),
    "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd"))}
_BLOCK_SET = frozenset(BLOCKS)


def leaf_blocks(page: str) -> list[tuple[str, tuple, float]]:
    """Text, path and share of link text of each leaf block in page order.

    A path is a tuple of (tag, groups of class words), from the root down.
    """
    out: list[tuple[str, tuple, float]] = []
    path: tuple = ()
    parts: list[str] = []
    linked, in_link, at, size = 0, 0, 0, len(page)

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(map(html.unescape, parts)).split())
            if text:
                out.append((text, path, linked / max(1, sum(map(len, parts)))))
            parts.clear()
            linked = 0

    while at < size:
        mark = _TOKEN.search(page, at)
        text = page[at: mark.start()] if mark else page[at:]
        if text:
            parts.append(text)
            linked += len(text) if in_link else 0
        if not mark:
            break
        at = mark.end()
        name = mark[2]
        if not name:
            continue
        name, end = name.lower(), bool(mark[1])
        if name in RAW:
            if not end and not mark[3].endswith("/"):
                stop = re.compile(rf"</{name}[^>]*>", re.I).search(page, at)
                if stop:
                    at = stop.end()
                elif name in ("script", "style"):
                    at = size
            parts.append(" ")
        elif name == "a":
            in_link = 0 if end else 1
        elif name == "br":
            parts.append(" ")
        elif name in _BLOCK_SET:
            close()
            if end:
                depth = next((k for k in range(len(path) - 1, -1, -1) if path[k][0] == name), None)
                if depth is not None:
                    path = path[:depth]
                in_link = 0
            elif name not in VOID:
                while path and name in _CLOSES.get(path[-1][0], ()):
                    path = path[:-1]
                groups = frozenset(
                    _GROUP_OF[w] for v in _CLASSES.findall(mark[3]) for w in _WORDS.findall(v.lower())
                    if w in _GROUP_OF) if mark[3] else frozenset()
                if name == "noscript":  # what to do without scripts is a notice
                    groups |= {"notice"}
                path += ((name, groups),)
    close()
    return out


def path_features(path: tuple) -> list[int]:
    found = {f"in {t}" for t, _ in path} | {f"has {g}" for _, groups in path for g in groups}
    found.add(f"at {path[-1][0]}" if path else "plain")
    return sorted(_AT[f] for f in found)


def text_features(text: str, links: float, first: bool) -> list[int]:
    words = text.count(" ") + 1
    limits = next((k for k, n in enumerate((3, 8, 20, 60)) if words < n), 4)
    flags = {
        "sentence": text[-1] in ".!?\"'”…", "links": links > 0.3, "all links": links > 0.9,
        "copyright": "©" in text, "question": "?" in text, "first": first,
        "bars": text.count("|") > 2, "capital": text[:1].isupper()}
    return [_AT["bias"], _AT[TEXT[limits]], *(_AT[f] for f, on in flags.items() if on)]


class Field:
    """Weights of a two-state chain: emissions [feature, state], moves [from, to] and start."""

    def __init__(self, emit: np.ndarray, move: np.ndarray, start: np.ndarray):
        self.emit, self.move, self.start = emit, move, start
        self._paths: dict = {}

    def __getstate__(self):
        return self.emit, self.move, self.start

    def __setstate__(self, state):
        self.__init__(*state)

    def _path_score(self, path: tuple) -> tuple[float, float]:
        score = self._paths.get(path)
        if score is None:
            if len(self._paths) > 20_000:
                self._paths.clear()
            score = self._paths[path] = tuple(self.emit[path_features(path)].sum(0).tolist())
        return score

    def main_text(self, page: str | None) -> str:
        blocks = leaf_blocks(page or "")
        if not blocks:
            return ""
        emit = self.emit.tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        best, back = self.start.tolist(), []
        for k, (text, path, links) in enumerate(blocks):
            e0, e1 = self._path_score(path)
            for f in text_features(text, links, k == 0):
                e0 += emit[f][0]
                e1 += emit[f][1]
            if k:
                s0, s1 = best[0] + m00, best[1] + m10
                t0, t1 = best[0] + m01, best[1] + m11
                back.append((0 if s0 >= s1 else 1, 0 if t0 >= t1 else 1))
                best = [max(s0, s1) + e0, max(t0, t1) + e1]
            else:
                best = [best[0] + e0, best[1] + e1]
        state = int(best[1] > best[0])
        states = [state]
        for step in reversed(back):
            state = step[state]
            states.append(state)
        states.reverse()
        return "\n".join(b[0] for b, s in zip(blocks, states, strict=True) if s)


def runs(page: tuple[list, list[int]]) -> list[tuple[list, list[int], bool]]:
    """A labelled page in runs of blocks, and whether a run is the first of its page."""
    x, y = page
    return [(x[k: k + TRAINING_BLOCKS], y[k: k + TRAINING_BLOCKS], k == 0)
            for k in range(0, len(y), TRAINING_BLOCKS)]


def fit(pages: list[tuple[list, list[int], bool]], rounds: int = 250, penalty: float = 0.0005) -> Field:
    """Field of greatest penalised likelihood for runs (feature lists, states, is first) of labelled pages."""
    count, length = len(pages), max(len(y) for _, y, _ in pages)
    opens = np.array([float(first) for _, _, first in pages])
    x = np.zeros((count, length, len(NAMES)), np.float32)
    y = np.zeros((count, length, 2), np.float32)
    there = np.zeros((count, length), np.float32)
    for k, (rows, states, _) in enumerate(pages):
        for t, (features, state) in enumerate(zip(rows, states, strict=True)):
            x[k, t, features], y[k, t, state], there[k, t] = 1, 1, 1
    weights = [np.zeros((len(NAMES), 2)), np.zeros((2, 2)), np.zeros(2)]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    pairs_seen = np.einsum("kti,ktj->ij", y[:, :-1], y[:, 1:])

    def lse(a: np.ndarray, axis: int) -> np.ndarray:
        top = a.max(axis, keepdims=True)
        return (np.log(np.exp(a - top).sum(axis, keepdims=True)) + top).squeeze(axis)

    for turn in range(1, rounds + 1):
        emit, move, start = weights
        e = x @ emit
        forth, back = np.zeros((count, length, 2)), np.zeros((count, length, 2))
        forth[:, 0] = start * opens[:, None] + e[:, 0]
        for t in range(1, length):
            on = lse(forth[:, t - 1, :, None] + move, 1) + e[:, t]
            forth[:, t] = np.where(there[:, t, None] > 0, on, forth[:, t - 1])
        for t in range(length - 2, -1, -1):
            on = lse(move + (e[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            back[:, t] = np.where(there[:, t + 1, None] > 0, on, back[:, t + 1])
        total = lse(forth[:, -1], 1)
        single = np.exp(forth + back - total[:, None, None]) * there[..., None]
        joint = np.exp(forth[:, :-1, :, None] + move + (e[:, 1:] + back[:, 1:])[:, :, None, :]
                       - total[:, None, None, None]) * there[:, 1:, None, None]
        slopes = [np.einsum("ktf,kts->fs", x, y - single) - penalty * emit * count,
                  pairs_seen - joint.sum((0, 1)) - penalty * move * count,
                  ((y[:, 0] - single[:, 0]) * opens[:, None]).sum(0) - penalty * start * count]
        for k, slope in enumerate(slopes):  # Adam
            m, v = moments[k]
            m, v = 0.9 * m + 0.1 * slope / count, 0.99 * v + 0.01 * (slope / count) ** 2
            moments[k] = m, v
            weights[k] = weights[k] + 0.15 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return Field(*weights)


def made_pages(count: int = 240, seed: int = 5) -> list[str]:
    """Pages in many layouts; a block that belongs to the main text starts with the mark \x01."""
    rng = random.Random(seed)
    sounds = "the an or er in on at es re ti ha of to and is it was for by be".split()

    def words(n: int) -> str:
        text = " ".join("".join(rng.choices(sounds, k=rng.randint(1, 3))) for _ in range(n))
        return text.capitalize()

    def sentences(n: int) -> str:
        return " ".join(words(rng.randint(3, 22)) + rng.choice([".", ".", ".", "?", "!"]) for _ in range(n))

    def links(n: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="#">{words(rng.randint(1, 4))}</a></{tag}>' for _ in range(n))

    def box(tag: str, name: str | None, inside: str) -> str:
        attribute = "" if not name else f' {rng.choice(["class", "id"])}="{name}"'
        return f"<{tag}{attribute}>{inside}</{tag}>"

    def pick(group: str) -> str:
        name = rng.choice(GROUPS[group].split())
        return name if rng.random() < 0.6 else f"{name}-{rng.choice(['box', 'wrap', 'area', 'list', 'inner'])}"

    def other() -> str:
        kind = rng.choice(["menu", "advert", "side", "notice", "comment", "share", "form", "aside", "links"])
        if kind == "menu":
            return box("nav", None, box("ul", None, links(rng.randint(2, 8)))) if rng.random() < 0.6 else \
                box(rng.choice(["div", "ul"]), pick("menu"), links(rng.randint(2, 8)))
        if kind == "comment":
            entries = "".join(box("div", pick("comment"), f"<p>{words(2)}</p><p>{sentences(rng.randint(1, 4))}</p>")
                              for _ in range(rng.randint(1, 5)))
            return box(rng.choice(["section", "div", "ul"]), pick("comment"), f"<h3>{words(1)}</h3>{entries}")
        if kind == "form":
            return f"<form><label>{words(2)}</label><input name=q><button>{words(1)}</button><p>{words(6)}.</p></form>"
        if kind == "aside":
            return box("aside", rng.choice([None, pick("side")]),
                       f"<h3>{words(2)}</h3><p>{sentences(2)}</p>{box('ul', None, links(3))}")
        if kind == "links":
            return box("div", rng.choice([None, pick("side")]), f"<h4>{words(2)}</h4>{box('ul', None, links(4))}")
        return box("div", pick(kind), rng.choice(["", "<p>"]) + sentences(rng.randint(1, 3)))

    def article() -> str:
        tag, name = rng.choice([("article", None), ("main", None), ("article", pick("body")),
                                ("div", pick("body")), ("section", pick("body")), ("div", "article-body")])
        inside = rng.choice(["", f"<h1>\x01{words(6)}</h1>", f"<header><h1>\x01{words(6)}</h1></header>"])
        for _ in range(rng.randint(1, 14)):
            kind = rng.random()
            if kind < 0.7:
                inside += rng.choice(["<p>", "<p><b>"]) + f"\x01{sentences(rng.randint(1, 8))}" + rng.choice(["</p>", "<br>", "</p>"])
            elif kind < 0.78:
                inside += f"<h2>\x01{words(rng.randint(1, 6))}</h2>"
            elif kind < 0.84:
                inside += "<ul>" + "".join(f"<li>\x01{words(rng.randint(2, 14))}</li>" for _ in range(3)) + "</ul>"
            elif kind < 0.88:
                inside += f"<blockquote><p>\x01{sentences(2)}</p></blockquote>"
            elif kind < 0.92:
                inside += "<table><tr>" + "".join(f"<td>\x01{words(2)}</td>" for _ in range(3)) + "</tr></table>"
            elif kind < 0.96:
                inside += f"<p>\x01{' | '.join(words(1) for _ in range(12))}</p>"
            else:
                inside += other()
        return box(tag, name, inside)

    out = []
    for _ in range(count):
        before = "".join(other() for _ in range(rng.randint(0, 3)))
        after = "".join(other() for _ in range(rng.randint(0, 3)))
        top = rng.choice(["", f"<header><p>{words(3)}</p>{box('nav', None, links(4, 'span'))}</header>",
                          box("div", pick("head"), words(3))])
        foot = rng.choice([f"<footer>© {words(5)}.</footer>", box("div", pick("foot"), f"<p>© {words(4)}</p>{links(3, 'p')}"),
                           f"<footer><p>{sentences(2)}</p></footer>", ""])
        body = article()
        if rng.random() < 0.3:
            body = box("div", rng.choice(["wrapper", "page", "container"]), before + body)
            before = ""
        out.append(f"<html><body>{top}{before}{body}{after}{foot}</body></html>")
    return out


def labelled(page: str) -> tuple[list, list[int]]:
    """Features and states of a page with marks."""
    blocks = leaf_blocks(page)
    states = [int("\x01" in t) for t, _, _ in blocks]
    return [path_features(p) + text_features(t.replace("\x01", "") or ".", w, k == 0)
            for k, (t, p, w) in enumerate(blocks)], states


def marked_up(page: str | None) -> tuple[list, list[int]] | None:
    """Features and states of a page that marks one article; other marks inside it are not main."""
    if len(re.findall(r"<article[\s>]", page or "", re.I)) != 1:
        return None
    blocks = leaf_blocks(page)
    inner = frozenset(("nav", "aside", "footer", "form"))
    states = []
    for _, path, _ in blocks:
        tags = [t for t, _ in path]
        inside = "article" in tags and not inner & set(tags[tags.index("article"):])
        states.append(int(inside and not any(g & {"advert", "comment", "notice"} for _, g in path)))
    return [path_features(p) + text_features(t, w, k == 0) for k, (t, p, w) in enumerate(blocks)], states


def train(pages: DataFrame, limit: int = MAX_TRAINING_PAGES) -> Field:
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.col("html").cast("string").alias("html"))
    key = F.xxhash64("page_id", "url")
    picked = pages.where(F.col("html").isNotNull()).select("page_id", "url").orderBy(
        key, "page_id", "url").limit(limit)
    chosen = pages.join(F.broadcast(picked), ["page_id", "url"], "left_semi").select("page_id", "url", "html")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page_id, url, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = runs(marked_up(page) or ([], []))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([page_id] * len(found), pa.int64()), pa.array([url] * len(found), pa.string()),
                         pa.array(range(len(found)), pa.int32()),
                         pa.array([x for x, _, _ in found], pa.list_(pa.list_(pa.int32()))),
                         pa.array([y for _, y, _ in found], pa.list_(pa.int32()))],
                        ["page_id", "url", "run", "features", "states"])

    # Cut where the pages are; MAX_TRAINING_RUNS runs come to the driver.
    own = chosen.mapInArrow(
        cut, "page_id long, url string, run int, features array<array<int>>, states array<int>"
    ).orderBy(F.xxhash64("page_id", "url", "run"), "page_id", "url", "run").limit(MAX_TRAINING_RUNS).collect()
    taught = [run for page in made_pages() for run in runs(labelled(page))]
    return fit(taught + [(r.features, r.states, r.run == 0) for r in own])


def extract(pages: DataFrame, limit: int = MAX_TRAINING_PAGES) -> DataFrame:
    """page_id, url and text of every page."""
    whole_texts(pages.sparkSession)
    field = train(pages, limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [field.main_text(p) for p in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string())],
                    ["page_id", "url", "text"])

    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string")

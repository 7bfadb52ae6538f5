"""Main text of web pages: a recurrent labeller over the sequence of text blocks.

A page is cut into leaf blocks of text, each with the path of open elements.
Path tokens (tags, words of class and id) and words are hashed into vectors; a
bidirectional LSTM reads the blocks of the whole page and says of each whether it
is content.  The network is trained here, in numpy, on a bounded sample of pages:
blocks of pages whose elements tell content apart, and blocks of pages laid out
anew from the sample's texts in many ways, so that it does not hang on one layout.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commitlens.llm.common import fresh, prepared


@dataclass(frozen=True)
class Settings:
    """``sample``: pages the labeller is fitted on at most; all pages are labelled by it."""

    sample: int = 128
    layouts: int = 384
    path_bits: int = 96
    word_bits: int = 32
    hidden: int = 24
    rounds: int = 12
    batch: int = 32
    rate: float = 0.01
    seed: int = 11


#: Elements of HTML by how they break a text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol "
    "optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul "
    "button label".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe".split())
#: Elements in which a trailing slash closes a tag; blocks of a page end them, but for what lies in the second.
FOREIGN = ("svg", "math")
INTEGRATED = ("foreignobject", "annotation-xml", "desc")
#: Elements that an opening tag of the same kind closes.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS_P = BLOCKS - {"p", "button", "label", "option", "optgroup", "legend", "caption", "summary"}

TAG = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPACE = re.compile(r"\s+")
PART = re.compile(r"[a-z]+|[0-9]+")


def blocks(page: str) -> list[tuple[tuple[str, ...], str]]:
    """(path, text) of every block with text, in page order.

    A path has an entry for each open element: its tag and the words of its
    class, id and role.  Comments, scripts and styles give no block.  Only raw
    text (``RAW``) is passed over up to its closing tag.
    """
    out, path, tags, text, at = [], [], [], [], 0

    def end() -> None:
        if text:
            whole = SPACE.sub(" ", entities.unescape("".join(text))).strip()
            if whole:
                out.append((tuple(path), whole))
            text.clear()

    def close(name: str, stop: frozenset | tuple = ()) -> None:
        for i in range(len(tags) - 1, -1, -1):
            if tags[i] == name:
                del tags[i:], path[i:]
                return
            if tags[i] in stop:
                return

    while at < len(page):
        found = TAG.search(page, at)
        stop = found.start() if found else len(page)
        if stop > at:
            text.append(page[at:stop])
        if not found:
            break
        at, (slash, name, rest) = found.end(), found.groups()
        if name is None:
            continue
        name = name.lower()
        inside = next((t for t in reversed(tags) if t in FOREIGN or t in INTEGRATED), None)
        if rest.endswith("/") and not slash and (name in FOREIGN or inside in FOREIGN):
            continue
        if inside in FOREIGN and not slash and name in BLOCKS and name != "title":
            while any(t in FOREIGN for t in tags) and inside in FOREIGN:
                close(inside)
                inside = next((t for t in reversed(tags) if t in FOREIGN or t in INTEGRATED), None)
        if name in RAW and not slash:
            end()
            last = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = last.end() if last else len(page)
            continue
        if name in BLOCKS:
            end()
        elif name == "br":
            text.append(" ")
        if slash:
            close(name)
        elif name not in VOID:
            for other in CLOSES.get(name, ()):
                close(other, ("ul", "ol", "dl", "table", "div", "article", "section", "select"))
            if name in ENDS_P:
                close("p", ("div", "article", "section", "table", "td", "li", "aside", "main", "body"))
            words = [name]
            for _, a, b, c in ATTRIBUTE.findall(rest):
                words += PART.findall((a or b or c).lower())
            tags.append(name)
            path.append(" ".join(dict.fromkeys(words)))
    end()
    return out


def _bucket(token: str, size: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % size


def features(page: list[tuple[tuple[str, ...], str]], s: Settings) -> np.ndarray:
    """One row per block: hashed path, hashed words, and a few measures."""
    out = np.zeros((len(page), s.path_bits + s.word_bits + 5), np.float32)
    for i, (path, text) in enumerate(page):
        for depth, element in enumerate(path):
            tag, *names = element.split(" ")
            out[i, _bucket(f"t:{tag}", s.path_bits)] = 1
            for word in names:
                out[i, _bucket(f"n:{word}", s.path_bits)] = 1
            if depth == len(path) - 1:
                out[i, _bucket(f"l:{tag}", s.path_bits)] = 1
        words = text.split(" ")
        hashed = np.bincount([_bucket(w.lower(), s.word_bits) for w in words], minlength=s.word_bits)
        out[i, s.path_bits : s.path_bits + s.word_bits] = 0.2 * hashed / np.sqrt((hashed**2).sum())
        out[i, -5:] = (
            min(np.log1p(len(words)) / 5, 2),
            any(e.split(" ")[0] == "a" for e in path),
            i / len(page),
            text[-1:] in ".!?",
            1,
        )
    return out


#: What element and class names say of a part of a page (weak labels for training).
CONTENT = frozenset("article main story post entry content body text".split())
OTHER = frozenset(
    "nav menu header head footer sidebar aside side notice cookie consent banner ad ads advert advertisement sponsor "
    "promo form subscribe newsletter login search comment comments disqus reply replies discussion share social "
    "related breadcrumb breadcrumbs widget popup modal copyright skip toolbar pagination pager tags author bio button "
    "label select title".split()
)


def weak_label(path: tuple[str, ...]) -> bool:
    words = [w for element in path for w in element.split(" ")]
    inside = any(e.split(" ")[0] in ("article", "main") for e in path)
    return inside and not any(w in OTHER for w in words)


def laid_out(texts: list[str], rng: np.random.Generator) -> str:
    """A page with texts as content and as everything else, in a random layout."""
    some = lambda a, b: [texts[i] for i in rng.integers(0, len(texts), rng.integers(a, b + 1))]
    pick = lambda *x: x[rng.integers(0, len(x))]
    short = lambda n=4: entities.escape(" ".join(pick(*texts).split(" ")[: rng.integers(1, n + 1)]))
    para = lambda t: f"<p>{entities.escape(t)}</p>"
    links = lambda n: "<ul>" + "".join(f'<li><a href="/x">{short(3)}</a></li>' for _ in range(rng.integers(2, n))) + "</ul>"
    wrap = lambda tag, name, inner: f'<{tag}{f" {pick("class", "id")}={chr(34)}{name}{chr(34)}" if name else ""}>{inner}</{tag}>'
    lines = lambda a, b: "".join(pick(para(t), wrap("div", "", entities.escape(t))) for t in some(a, b))
    comment = lambda: wrap(pick("div", "li", "article"), pick("comment", "reply", ""), f"<b>{short(2)}</b>" * pick(0, 1) + lines(1, 2))
    comments = lambda: wrap(pick("section", "div", "ol"), pick("comments", "comment-list", "discussion", "replies", "disqus"), pick("", f"<h2>{short()}</h2>") + "".join(comment() for _ in range(rng.integers(1, 5))))
    ad = lambda: wrap(pick("div", "aside", "section", "p"), pick("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad-box"), entities.escape(pick(*some(1, 1))))
    form = lambda: wrap("form", pick("", "search", "subscribe", "newsletter", "login"), pick(f"<label>{short()}</label><input>", lines(1, 1) + f"<button>{short(2)}</button>"))
    side = lambda: wrap(pick("aside", "div"), pick("sidebar", "side", "widget", "related", "sidebar-right"), pick(links(5), lines(1, 2), f"<h3>{short()}</h3>" + links(5)))
    notice = lambda: wrap(pick("div", "section", "p"), pick("notice", "cookie-notice", "cookie", "consent", "alert notice", "banner"), entities.escape(pick(*some(1, 1))))
    menu = lambda: pick(wrap("nav", pick("", "menu"), links(7)), wrap(pick("div", "ul"), pick("menu", "nav", "navbar menu"), links(7)))
    head = lambda: wrap(pick("header", "div"), pick("header", "site-header", "top header"), pick(f"<h1>{short()}</h1>", lines(1, 1), menu()))
    foot = lambda: wrap(pick("footer", "div"), pick("footer", "site-footer", "copyright footer"), pick(f"&copy; {short(8)}", lines(1, 2), links(4)))
    inner = [f"<h1>{short(8)}</h1>"] * pick(0, 1)
    for t in some(2, 9):
        inner.append(pick(para(t), para(t), para(t), f"<h2>{short(6)}</h2>" + para(t), f"<p><b>{entities.escape(t)}<br>", wrap("blockquote", "", para(t)), f"<ul><li>{entities.escape(t)}</li><li>{short(8)}</li></ul>", wrap("div", "", entities.escape(t))))
        if rng.random() < 0.12:
            inner.append(pick(ad, form, notice, lambda: wrap("div", pick("share", "social", "related"), links(4)))())
    plain = rng.random() < 0.5
    tag, name = (pick("article", "main"), pick("", "", "post", "content")) if plain else (pick("div", "section"), pick("content", "post", "entry-content", "article-body", "story", "main", "post-content", "article"))
    body = f"<{tag}" + (f' {pick("class", "id")}="{name}"' if name else "") + f' data-main="1">{"".join(inner)}' + (comments() if rng.random() < 0.15 else "") + f"</{tag}>"
    if rng.random() < 0.3:
        body = wrap(pick("main", "div"), pick("", "container", "wrapper", "page"), pick("", ad(), notice()) + body + pick("", side()))
    before = [f() for f in (notice, head, menu, ad, side, form) if rng.random() < 0.45]
    after = [f() for f in (ad, side, comments, form, notice, foot) if rng.random() < 0.45]
    rng.shuffle(before)
    return f"<html><head><title>{short()}</title></head><body>{''.join(before)}{body}{''.join(after)}</body></html>"


def layout_label(path: tuple[str, ...], tags_of_main: tuple[str, ...]) -> bool:
    """Whether a block of a laid-out page lies in its main part and in nothing else within it."""
    if path[: len(tags_of_main)] != tags_of_main:
        return False
    return not any(w in OTHER for e in path[len(tags_of_main) :] for w in e.split(" "))


def training_set(pages: list[str], s: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    rng = np.random.default_rng(s.seed)
    parsed = [blocks(p) for p in pages]
    out = [(features(p, s), np.array([weak_label(path) for path, _ in p], np.float32)) for p in parsed if p]
    out = [(x, y) for x, y in out if y.any()]
    texts = sorted({t for p in parsed for _, t in p if len(t) > 20}) or ["some words of a plain text that is read here"]
    texts = [texts[i] for i in rng.permutation(len(texts))[:4096]]
    for _ in range(s.layouts):
        page = laid_out(texts, rng)
        opening = page.index(" data-main=")
        main = len(_open_path(page[: page.index(">", opening) + 1]))
        p = blocks(page)
        start = _open_path(page[: page.index(">", opening) + 1])
        out.append((features(p, s), np.array([layout_label(path, start) and len(path) >= main for path, _ in p], np.float32)))
    return out


def _open_path(start: str) -> tuple[str, ...]:
    """Path of what follows the start of a page."""
    return blocks(start + "x")[-1][0]


class Labeller:
    """Bidirectional LSTM with a logistic output for each block."""

    def __init__(self, size: int, s: Settings):
        rng = np.random.default_rng(s.seed)
        h = self.hidden = s.hidden
        self.p = {}
        for side in "fb":
            self.p[f"w{side}"] = (rng.standard_normal((size + h, 4 * h)) / np.sqrt(size / 8 + h)).astype(np.float32) * 0.5
            bias = np.zeros(4 * h, np.float32)
            bias[h : 2 * h] = 1  # forget gates start open
            self.p[f"b{side}"] = bias
        self.p["v"] = (rng.standard_normal(2 * h) * 0.1).astype(np.float32)
        self.p["c"] = np.zeros(1, np.float32)

    def _pass(self, side: str, x: np.ndarray) -> tuple[np.ndarray, list]:
        """States of (page, step, feature) input in step order, and what the way back needs."""
        n, steps, _ = x.shape
        h, state, cell, kept = self.hidden, np.zeros((n, self.hidden), np.float32), np.zeros((n, self.hidden), np.float32), []
        out = np.zeros((n, steps, h), np.float32)
        w, b = self.p[f"w{side}"], self.p[f"b{side}"]
        seen = x @ w[: x.shape[2]] + b
        for t in range(steps):
            z = seen[:, t] + state @ w[x.shape[2] :]
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * h], -30, 30)))
            i, f, o, g = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :], np.tanh(z[:, 3 * h :])
            before = cell
            cell = f * cell + i * g
            squashed = np.tanh(cell)
            kept.append((state, before, i, f, o, g, squashed))
            state = o * squashed
            out[:, t] = state
        return out, kept

    @staticmethod
    def _turn(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each page's steps backward, padding left at the end."""
        at = np.arange(x.shape[1])[None, :]
        back = np.where(at < lengths[:, None], lengths[:, None] - 1 - at, at)
        return np.take_along_axis(x, back[:, :, None], axis=1)

    def score(self, x: np.ndarray, lengths: np.ndarray):
        forward, kf = self._pass("f", x)
        turned = self._turn(x, lengths)
        backward, kb = self._pass("b", turned)
        states = np.concatenate([forward, self._turn(backward, lengths)], axis=2)
        return states @ self.p["v"] + self.p["c"], (states, turned, kf, kb)

    def _back(self, side: str, x: np.ndarray, kept: list, d_out: np.ndarray, grads: dict) -> None:
        h, width, w = self.hidden, x.shape[2], self.p[f"w{side}"]
        d_state, d_cell = np.zeros_like(d_out[:, 0]), np.zeros_like(d_out[:, 0])
        d_z = np.zeros((*d_out.shape[:2], 4 * h), np.float32)
        recur = np.zeros((h, 4 * h), np.float32)
        for t in range(x.shape[1] - 1, -1, -1):
            state, before, i, f, o, g, squashed = kept[t]
            d_h = d_out[:, t] + d_state
            d_cell = d_cell + d_h * o * (1 - squashed**2)
            z = d_z[:, t]
            z[:, :h] = d_cell * g * i * (1 - i)
            z[:, h : 2 * h] = d_cell * before * f * (1 - f)
            z[:, 2 * h : 3 * h] = d_h * squashed * o * (1 - o)
            z[:, 3 * h :] = d_cell * i * (1 - g**2)
            recur += state.T @ z
            d_state, d_cell = z @ w[width:].T, d_cell * f
        flat = d_z.reshape(-1, 4 * h)
        grads[f"w{side}"] = np.concatenate([x.reshape(-1, width).T @ flat, recur])
        grads[f"b{side}"] = flat.sum(axis=0)

    def gradients(self, x: np.ndarray, y: np.ndarray, lengths: np.ndarray) -> tuple[float, dict]:
        z, (states, turned, kf, kb) = self.score(x, lengths)
        mask = np.arange(x.shape[1])[None, :] < lengths[:, None]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        total = mask.sum()
        loss = -(mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / total
        d = ((p - y) * mask / total).astype(np.float32)
        grads = {"v": np.einsum("ij,ijk->k", d, states), "c": d.sum(keepdims=True).reshape(1)}
        d_states = d[:, :, None] * self.p["v"]
        self._back("f", x, kf, d_states[:, :, : self.hidden], grads)
        self._back("b", turned, kb, self._turn(d_states[:, :, self.hidden :], lengths), grads)
        return float(loss), grads


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in pages])
    out = np.zeros((len(pages), int(lengths.max()), pages[0].shape[1]), np.float32)
    for i, p in enumerate(pages):
        out[i, : len(p)] = p
    return out, lengths


def train(pages: list[str], s: Settings | None = None) -> Labeller:
    """A labeller fitted on pages (Adam, clipped gradients); the same pages give the same labeller."""
    s = s or Settings()
    examples = sorted(training_set(pages, s), key=lambda e: len(e[0]))
    net, rng = Labeller(examples[0][0].shape[1], s), np.random.default_rng(s.seed)
    groups = [examples[i : i + s.batch] for i in range(0, len(examples), s.batch)]
    mean, square, step = {k: 0.0 for k in net.p}, {k: 0.0 for k in net.p}, 0
    for _ in range(s.rounds):
        for g in rng.permutation(len(groups)):
            x, lengths = padded([e[0] for e in groups[g]])
            y = padded([e[1][:, None] for e in groups[g]])[0][:, :, 0]
            _, grads = net.gradients(x, y, lengths)
            norm = np.sqrt(sum(float((v**2).sum()) for v in grads.values()))
            step += 1
            for k, v in grads.items():
                v = v / max(1.0, norm)
                mean[k] = 0.9 * mean[k] + 0.1 * v
                square[k] = 0.99 * square[k] + 0.01 * v**2
                net.p[k] -= (s.rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def label(net: Labeller, pages: list[list[tuple]], s: Settings) -> list[list[bool]]:
    """Whether each block is content; pages of like length are read together."""
    out: list[list[bool]] = [[] for _ in pages]
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        rows = max(1, min(s.batch, 20_000 // len(pages[order[min(at + s.batch, len(order)) - 1]])))
        part = order[at : at + rows]
        x, lengths = padded([features(pages[i], s) for i in part])
        z, _ = net.score(x, lengths)
        for row, i in enumerate(part):
            out[i] = (z[row, : lengths[row]] > 0).tolist()
        at += rows
    return out


def sample_of(pages: DataFrame, id_col: str, html_col: str, size: int) -> list[str]:
    """The ``size`` pages with the smallest hashes of id and html, equal ones once.

    Tasks send hashes only; then the pages up to the last of them are fetched,
    so what reaches the driver is that many pages however many tasks there are.
    """
    key = F.struct(F.xxhash64(id_col), F.xxhash64(html_col))
    full = pages.filter(F.length(html_col) > 0).select(key.alias("key"), F.col(html_col).alias("html"))
    keys = [r.key for r in full.select("key").distinct().orderBy("key").limit(size).collect()]
    if not keys:
        return []
    last = F.struct(*(F.lit(x) for x in keys[-1]))
    found = full.filter(F.col("key") <= last).dropDuplicates(["key"]).collect()
    return [r.html for r in sorted(found, key=lambda r: r.key)]


def main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", settings: Settings | None = None) -> DataFrame:
    """``pages`` without the html, with text and n_chars, appended last.

    The labeller is fitted on at most ``settings.sample`` pages (those with the
    smallest hashes of id and html); every page is read whole.  A null or empty page
    has an empty text, as has a page without a block of content; equal pages give
    equal texts; an empty table gives none.  New columns whose names ``pages``
    already has get an underscore.
    """
    s, _ = settings or Settings(), prepared(pages.sparkSession)
    text, n_chars = fresh(pages, "text", "n_chars")
    net = train(sample_of(pages, id_col, html_col, s.sample), s)
    given = [c for c in pages.columns if c != html_col]

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            parsed = [blocks(p or "") for p in batch.column(len(given)).to_pylist()]
            marks = label(net, parsed, s)
            texts = ["\n".join(t for (_, t), keep in zip(p, m, strict=True) if keep) for p, m in zip(parsed, marks, strict=True)]
            columns = [*batch.columns[: len(given)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*given, text, n_chars])

    more = [T.StructField(text, T.StringType()), T.StructField(n_chars, T.LongType())]
    schema = T.StructType([*(pages.schema[c] for c in given), *more])
    return pages.select(*given, html_col).mapInArrow(batches, schema)

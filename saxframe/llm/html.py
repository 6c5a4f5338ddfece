"""HTML extraction: a bidirectional LSTM labels the leaf blocks of a page as main text or not."""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saxframe.llm.common import mixed, prefix_sums, range_hashes, sample_texts, slices, table, texts

PATH, WORDS, PLAIN = 192, 48, 6
HIDDEN = 24
#: Pages of the corpus that the model is fitted on, and made-up pages beside them.
SAMPLE_PAGES, MADE_PAGES = 160, 320
EPOCHS = 6

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_SAID = re.compile(r"[^<]+")
_MARK = re.compile("[>\"']")
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Za-z][a-z]*|[0-9]+")
#: Elements whose content is not text.
SILENT = frozenset("script style noscript template svg select option datalist textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul button label".split()
)
#: A new one ends an open one of these, up to the nearest of the scopes.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPES = frozenset("html body table td th ul ol dl div article section main nav aside header footer form blockquote figure".split())


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    links: int = 0


@dataclass
class _Open:
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def end(self, path: tuple[str, ...]) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(Block(text, path, self.linked))
            self.parts, self.linked = [], 0


class _Scan:
    """Where tokens of a page end. What is looked for in vain is remembered: broken markup costs no more than whole."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.marks = [m.start() for m in _MARK.finditer(page)]
        self.last = {c: page.rfind(c) for c in ("\"", "'", ">", "-->", "]]>")}
        self.dead: set[int] = set()

    def find(self, what: str, at: int) -> int:
        return self.page.find(what, at) if at <= self.last[what] else -1

    def tag_end(self, at: int) -> int:
        """The place of the > that ends a tag, -1 if none does; those in quotes don't."""
        seen = []
        while True:
            k = bisect_left(self.marks, at)
            if k == len(self.marks) or self.marks[k] in self.dead:
                break
            mark = self.marks[k]
            seen.append(mark)
            if self.page[mark] == ">":
                return mark
            close = self.find(self.page[mark], mark + 1)
            if close < 0:
                break
            at = close + 1
        self.dead.update(seen)
        return -1

    def next(self, at: int) -> tuple[int, re.Match | None]:
        """(end, the match of a tag's beginning or None) of the token at a place."""
        page = self.page
        if page[at] != "<":
            return _SAID.match(page, at).end(), None
        for begin, until in (("<!--", "-->"), ("<![CDATA[", "]]>")):
            if page.startswith(begin, at) and (end := self.find(until, at + len(begin))) >= 0:
                return end + 3, None
        if page[at + 1 : at + 2] in ("!", "?") and (end := self.find(">", at)) >= 0:
            return end + 1, None
        m = _OPEN.match(page, at)
        if m and (end := self.tag_end(m.end())) >= 0:
            return end + 1, m
        return at + 1, None


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order: text with character references decoded and single spaces, and the path of elements above it.

    Broken markup is read as browsers do, roughly: an end tag without its start is ignored, an unclosed
    paragraph ends where a block begins, the content of scripts and the like is skipped to its end tag.
    """
    out, stack, shown = _Open(), [], []
    at, n, scan = 0, len(page), _Scan(page)
    while at < n:
        begin = at
        at, m = scan.next(at)
        if m is None:
            raw = page[begin:at]
            if raw[0] != "<" or raw == "<":
                raw = entities.unescape(raw) if "&" in raw else raw
                out.parts.append(raw)
                if "a" in stack:
                    out.linked += len(raw)
            elif raw.startswith("<![CDATA["):
                out.parts.append(raw[9:-3])
            continue
        name, rest = m[2].lower(), page[m.end() : at - 1]
        if m[1]:
            if name in stack:
                k = len(stack) - 1 - stack[::-1].index(name)
                if any(t in BLOCK for t in stack[k:]):
                    out.end(tuple(shown))
                del stack[k:], shown[k:]
            continue
        if name in SILENT and not rest.endswith("/"):
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            out.parts.append(" ")
            continue
        if name == "br":
            out.parts.append(" ")
            continue
        if name in BLOCK:
            out.end(tuple(shown))
            if "p" in stack and (k := len(stack) - 1 - stack[::-1].index("p")) >= 0 and not any(t in SCOPES for t in stack[k:]):
                del stack[k:], shown[k:]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k] in ENDS.get(name, ()):
                    del stack[k:], shown[k:]
                    break
                if stack[k] in SCOPES:
                    break
        if name in VOID or rest.endswith("/") and name not in BLOCK:
            continue
        stack.append(name)
        words = [w for g in _NAMED.findall(rest) for w in _PART.findall("".join(g))] if rest else []
        shown.append(".".join([name, *words]).lower())
    out.end(tuple(shown))
    return out.blocks


_PATHS: dict[tuple[str, ...], np.ndarray] = {}


def _spot(word: str) -> int:
    h = 0x811C9DC5
    for c in word.encode():
        h = (h ^ c) * 0x01000193 & 0xFFFFFFFF
    return (h ^ h >> 15) % PATH


def path_vector(path: tuple[str, ...]) -> np.ndarray:
    """A hashed bag of the path's elements and of the words of their class, id and role, and of the last element with its place."""
    got = _PATHS.get(path)
    if got is None:
        got = np.zeros(PATH, np.float32)
        for k, step in enumerate(path):
            tag, *words = step.split(".")
            if tag not in ("html", "body"):
                got[_spot("<" + tag)] = 1
            for w in words:
                got[_spot(w)] = 1
        if path:
            got[_spot("leaf " + path[-1].split(".")[0])] = 1
        if len(_PATHS) > 20_000:
            _PATHS.clear()
        _PATHS[path] = got
    return got


def features(items: list[Block]) -> np.ndarray:
    """A row per block: tag path, hashed words, and length, links, sentence ends, digits, depth and capitals."""
    out = np.zeros((len(items), PATH + WORDS + PLAIN), np.float32)
    if not items:
        return out
    coded = [b.text.encode("utf-8", "replace") for b in items]
    data = np.frombuffer(b" ".join([*coded, b""]), np.uint8)
    space = data == 32
    begin = np.flatnonzero(np.concatenate([[True], space[:-1]]) & ~space)
    end = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    owner = np.searchsorted(np.cumsum([len(c) + 1 for c in coded]), begin, side="right")
    spot = (mixed(range_hashes(prefix_sums(data + np.uint8(1)), begin, end)) >> np.uint64(40)).astype(np.int64) % WORDS
    bag = np.bincount(owner * WORDS + spot, minlength=len(items) * WORDS).reshape(-1, WORDS)
    n = np.maximum(1, bag.sum(axis=1))
    out[:, PATH : PATH + WORDS] = bag / np.sqrt(n)[:, None] / 4
    for k, b in enumerate(items):
        out[k, :PATH] = path_vector(b.path)
        size = len(b.text)
        out[k, PATH + WORDS :] = (np.log1p(n[k]) / 5, min(1.0, b.links / size), min(2.0, 10 * sum(map(b.text.count, ".!?")) / n[k]), b.text[:1].isdigit(), len(b.path) / 10, b.text[:1].isupper())
    return out


class Labeller:
    """A one-layer bidirectional LSTM with a logistic output for each step, in numpy."""

    def __init__(self, inputs: int = PATH + WORDS + PLAIN, hidden: int = HIDDEN, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.w: dict[str, np.ndarray] = {}
        for d in "fb":
            self.w["x" + d] = (rng.standard_normal((inputs, 4 * hidden)) / np.sqrt(24)).astype(np.float32)
            self.w["h" + d] = (rng.standard_normal((hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
            self.w["c" + d] = np.repeat(np.array([0, 1, 0, 0], np.float32), hidden)
        self.w["o"] = (rng.standard_normal(2 * hidden) / np.sqrt(2 * hidden)).astype(np.float32)
        self.w["oc"] = np.zeros(1, np.float32)

    @staticmethod
    def _flip(x: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Each sequence of a batch (time, sequence, ...) back to front, padding left at the end."""
        t = np.arange(len(x))[:, None]
        return x[np.where(t < size, size - 1 - t, t), np.arange(x.shape[1])]

    def _run(self, x: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        w, steps, many = self.w, len(x), x.shape[1]
        n = w["h" + d].shape[0]
        given = x.reshape(-1, x.shape[2]) @ w["x" + d] + w["c" + d]
        given = given.reshape(steps, many, 4 * n)
        h, c = np.zeros((many, n), np.float32), np.zeros((many, n), np.float32)
        out = np.empty((steps, many, n), np.float32)
        for t in range(steps):
            z = given[t] + h @ w["h" + d]
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * n], -30, 30)))
            i, f, o, g = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :], np.tanh(z[:, 3 * n :])
            was, c = c, f * c + i * g
            bent = np.tanh(c)
            if keep is not None:
                keep.append((h, was, i, f, o, g, bent))
            h = o * bent
            out[t] = h
        return out

    def _logits(self, x: np.ndarray, size: np.ndarray, keep: dict | None = None) -> np.ndarray:
        flipped = self._flip(x, size)
        forth, back = ([], []) if keep is not None else (None, None)
        both = np.concatenate([self._run(x, "f", forth), self._flip(self._run(flipped, "b", back), size)], axis=2)
        if keep is not None:
            keep |= {"f": (x, forth), "b": (flipped, back), "both": both}
        return both @ self.w["o"] + self.w["oc"][0]

    def _back(self, d: str, x: np.ndarray, kept: list, grad: np.ndarray, into: dict) -> None:
        w, n = self.w, self.w["h" + d].shape[0]
        dz = np.empty((len(x), x.shape[1], 4 * n), np.float32)
        dh, dc = np.zeros_like(grad[0]), np.zeros_like(grad[0])
        into["h" + d] = np.zeros_like(w["h" + d])
        for t in range(len(x) - 1, -1, -1):
            h, was, i, f, o, g, bent = kept[t]
            dh = dh + grad[t]
            dc = dc + dh * o * (1 - bent * bent)
            z = np.concatenate([dc * g * i * (1 - i), dc * was * f * (1 - f), dh * bent * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            dz[t] = z
            into["h" + d] += h.T @ z
            dh, dc = z @ w["h" + d].T, dc * f
        flat = dz.reshape(-1, 4 * n)
        into["x" + d] = x.reshape(-1, x.shape[2]).T @ flat
        into["c" + d] = flat.sum(axis=0)

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, batch: int = 16, rate: float = 0.01, seed: int = 6) -> Labeller:
        """Adam on the cross entropy over the known labels (1, 0; -1 is unknown) of (features, labels) of pages."""
        rng, first, second, step = np.random.default_rng(seed), {}, {}, 0
        pages = [p for p in pages if len(p[0])]
        for _ in range(epochs):
            order = sorted(rng.permutation(len(pages)), key=lambda k: len(pages[k][0]) // 8)
            groups = [order[k : k + batch] for k in range(0, len(order), batch)]
            for k in rng.permutation(len(groups)):
                x, size = padded([pages[p][0] for p in groups[k]])
                y = np.full(x.shape[:2], -1.0, np.float32)
                for s, p in enumerate(groups[k]):
                    y[: len(pages[p][1]), s] = pages[p][1]
                keep: dict = {}
                p = 1 / (1 + np.exp(-np.clip(self._logits(x, size, keep), -30, 30)))
                dlogit = np.where(y >= 0, p - y, 0).astype(np.float32) / max(1, (y >= 0).sum())
                grads = {"o": np.einsum("tsn,ts->n", keep["both"], dlogit), "oc": dlogit.sum(keepdims=True).reshape(1)}
                dboth = dlogit[:, :, None] * self.w["o"]
                n = dboth.shape[2] // 2
                self._back("f", *keep["f"], np.ascontiguousarray(dboth[:, :, :n]), grads)
                self._back("b", *keep["b"], self._flip(dboth[:, :, n:], size), grads)
                step += 1
                for name, g in grads.items():
                    first[name] = 0.9 * first.get(name, 0) + 0.1 * g
                    second[name] = 0.99 * second.get(name, 0) + 0.01 * g * g
                    self.w[name] -= (rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def label(self, pages: list[list[Block]], most: int = 4096) -> list[np.ndarray]:
        """For each page, which of its blocks are main text; pages of like length are read together, most steps at a time."""
        out = [np.zeros(len(p), bool) for p in pages]
        order = sorted((k for k, p in enumerate(pages) if p), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end + 1 - at) * len(pages[order[end]]) <= most:
                end += 1
            group = order[at:end]
            x = features([b for k in group for b in pages[k]])
            cuts = np.cumsum([len(pages[k]) for k in group])[:-1]
            logits = self._logits(*padded(np.split(x, cuts)))
            for s, k in enumerate(group):
                out[k] = logits[: len(pages[k]), s] > 0
            at = end
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(p) for p in pages])
    x = np.zeros((size.max(), len(pages), pages[0].shape[1]), np.float32)
    for s, p in enumerate(pages):
        x[: len(p), s] = p
    return x, size


#: Words of class, id and role that name what isn't main text, and those that name main text.
ASIDE = "ad ads advert advertisement banner promo sponsor sponsored menu nav navbar navigation breadcrumb breadcrumbs pagination sidebar side widget related share social footer header masthead topbar cookie consent notice alert popup modal comment comments reply replies disqus form login signup subscribe newsletter search copyright legal tags toolbar skip".split()
MAIN = "article content post entry story main body text".split()
ASIDE_TAGS = "nav header footer aside form title button menu label dialog search".split()


def weak_labels(items: list[Block]) -> np.ndarray:
    """1, 0 or -1 (unknown) for each block, from the elements and names above it: how the sample pages are labelled."""
    out = []
    for b in items:
        tags = [s.split(".")[0] for s in b.path]
        words = {w for s in b.path for w in s.split(".")[1:]}
        aside = bool(words & set(ASIDE)) or any(t in ASIDE_TAGS for t in tags)
        main = bool(words & set(MAIN)) or "article" in tags or "main" in tags
        out.append(0 if aside else 1 if main else -1)
    return np.array(out, np.float32)


def made_page(rng: np.random.Generator, words: list[str]) -> tuple[list[Block], np.ndarray]:
    """A page of a random layout over the given words, with its true labels: menus, notices and the like around and inside an article."""

    def say(least: int, most: int) -> str:
        some = [words[k] for k in rng.integers(0, len(words), rng.integers(least, most))]
        return " ".join(some).capitalize() + ("." if rng.random() < 0.8 else "")

    out: list[tuple[Block, int]] = []

    def put(path: tuple[str, ...], text: str, label: int, linked: bool = False) -> None:
        out.append((Block(text, ("html", *path), len(text) if linked else 0), label))

    name = lambda tag, pool: ".".join([tag, pool[rng.integers(len(pool))], *([pool[rng.integers(len(pool))]] if rng.random() < 0.3 else [])])
    outer = ("body", *[f"div.{rng.choice(['wrap', 'page', 'container', 'site', 'layout', 'outer', 'root'])}" for _ in range(rng.integers(0, 3))])

    def aside(within: tuple[str, ...]) -> None:
        kind = rng.integers(6)
        tag = str(rng.choice(ASIDE_TAGS[:5])) if rng.random() < 0.5 else name(str(rng.choice(["div", "section", "ul", "p", "span"])), ASIDE)
        if rng.random() < 0.25 and "." not in tag:
            tag = name(tag, ASIDE)
        inner = (*within, tag)
        if kind <= 1:
            for _ in range(rng.integers(2, 9)):
                put((*inner, "ul", "li", "a"), say(1, 4), 0, True)
        elif kind == 2:
            put(inner, say(3, 30), 0)
        elif kind == 3:
            for _ in range(rng.integers(1, 6)):
                put((*inner, str(rng.choice(["p", "div", "li", "h2", "h3"]))), say(2, 60), 0)
        elif kind == 4:
            put((*inner, "p"), say(10, 80), 0)
            put((*inner, "a"), say(1, 5), 0, True)
        else:
            put((*inner, str(rng.choice(["label", "button", "span", "h3"]))), say(1, 8), 0)

    put(("head", "title"), say(3, 10), 0)
    for _ in range(rng.integers(1, 4)):
        aside(outer)
    kind = rng.integers(4)
    main = (*outer, *((["article"], ["main", "article"], [name("div", MAIN)], [name("section", MAIN)])[kind]))
    if rng.random() < 0.3:
        main = (*main, name("div", MAIN))
    if rng.random() < 0.85:
        put((*main, str(rng.choice(["h1", "h2"]))), say(2, 12), 1)
    for _ in range(rng.integers(1, 25)):
        what = rng.random()
        if what < 0.06:
            aside(main)
        elif what < 0.12:
            put((*main, str(rng.choice(["h2", "h3", "blockquote", "pre"]))), say(1, 20), 1)
        elif what < 0.2:
            for _ in range(rng.integers(1, 5)):
                put((*main, str(rng.choice(["ul", "ol"])), "li"), say(1, 25), 1)
        elif what < 0.24:
            put((*main, "table", "tr", "td"), say(1, 6), 1)
        else:
            put((*main, "p", *(["b"] if rng.random() < 0.1 else [])), say(1, 140), 1)
    for _ in range(rng.integers(1, 5)):
        aside(outer if rng.random() < 0.8 else main)
    return [b for b, _ in out], np.array([y for _, y in out], np.float32)


def fitted(pages: list[str], seed: int = 9) -> Labeller:
    """The labeller, fitted on sample pages with weak labels and on made-up pages over the sample's words."""
    rng = np.random.default_rng(seed)
    read = [b for b in map(blocks, pages) if b]
    words = [w for b in read for x in b for w in x.text.split()][:200_000] or ["word"]
    rows = [(features(b), weak_labels(b)) for b in read]
    rows += [(features(b), y) for b, y in (made_page(rng, words) for _ in range(MADE_PAGES))]
    return Labeller().fit(rows)


def main_text(items: list[Block], keep: np.ndarray) -> str:
    return "\n".join(b.text for b, k in zip(items, keep, strict=True) if k)


def _extract(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    labeller = model.value
    for batch in slices(batches, "html"):
        out = []
        pages = texts(batch["html"])
        for at in range(0, len(pages), 256):
            read = [blocks(p.decode()) for p in pages[at : at + 256]]
            out += [main_text(b, keep) for b, keep in zip(read, labeller.label(read), strict=True)]
        yield pa.RecordBatch.from_pydict({name: batch[name] for name in batch.schema.names if name != "html"} | {"text": pa.array(out, pa.string()), "n_chars": pa.array([len(t) for t in out], pa.int64())})


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of pages (page_id, url, html; others are not read): page_id, url, text and n_chars.

    text is the page's main text: the blocks that the labeller keeps, in order, joined by line feeds;
    empty for a null or empty page. Nothing else is dropped or cut. Rows with equal or null ids are
    pages like any other. The labeller is fitted on SAMPLE_PAGES different pages, those of the least
    hashes, and on MADE_PAGES made-up ones. An empty table has no rows.
    """
    read = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    model = fitted(sample_texts(read, "html", SAMPLE_PAGES))
    kind = {f.name: f.dataType.simpleString() for f in read.schema.fields}
    return read.mapInArrow(partial(_extract, model=pages.sparkSession.sparkContext.broadcast(model)), f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))

"""Main text of web pages by a recurrent block labeller.

A page becomes a sequence of leaf blocks; each block is a vector of hashed tag-path tokens (tags and the words of
their class, id and role), hashed words and a few sizes. A bidirectional LSTM in numpy reads the whole sequence and
labels every block as main text or not, so a block is judged by what surrounds it anywhere in the page.

The model is fitted here, on at most SAMPLE pages chosen by hash, against labels that page structure suggests
(articles and main parts against navigation, footers, adverts and the like). Each sampled page also appears in
altered forms: with strange blocks of the kinds that these pages lack, and with its main part under other tags.
"""

from __future__ import annotations

import pickle
import random
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import small_batches

#: Pages to fit on (met in expectation), hashed sizes of the input, hidden units of each direction, rounds.
SAMPLE, PATH, WORDS, HIDDEN, ROUNDS = 250, 96, 32, 16, 12
#: Blocks of a sampled page that are fitted on (labelling reads all).
FIT_BLOCKS = 400
#: Blocks in one batch of pages.
LOAD = 40_000
#: Tags that end a block, that hold no text of the page, and that have no end.
BLOCK_TAGS = set("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = set("script style noscript template head title textarea select button svg iframe object math canvas audio video".split())
#: Tags that may stand in a head; any other tag, or text, ends one that was left open.
HEAD_TAGS = set("html head base basefont bgsound link meta title noscript noframes script style template".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Words of tags, classes, ids and roles that suggest the one label or the other.
OUTSIDE = set("nav footer header aside form ad ads advert advertisement advertising banner cookie cookies consent sidebar comment comments menu promo promotion notice related share sharing social subscribe newsletter breadcrumb breadcrumbs widget popup modal login search sponsor sponsored pagination toolbar copyright disclaimer reply replies".split())
INSIDE = set("article main content post entry story articlebody".split())
#: Tags of short blocks that the altered pages add to main text.
SHORT_KINDS = [("<ul", "<li"), ("<ol", "<li"), ("<table", "<tr", "<td"), ("<pre",), ("<h1",), ("<h2",), ("<h3",), ("<p",)]
HEADINGS = {f"<h{k}" for k in range(1, 7)}
_WORD = re.compile(r"[^\W_]+")


class _Blocks(HTMLParser):
    """Leaf blocks of a page: (path tokens, text, characters inside links)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, tuple[str, ...]]] = []
        self.path: dict[str, int] = {}  # tokens of all open tags, outermost first, with how often each is open
        self.out: list[tuple[tuple[str, ...], str, int]] = []
        self.text: list[str] = []
        self.linked = 0
        self.hidden = 0
        self.links = 0

    def flush(self):
        text = " ".join("".join(self.text).split())
        if text:
            self.out.append((tuple(self.path), text, self.linked))
        self.text, self.linked = [], 0

    def _count(self, tag, by):
        if tag in DROPPED:
            self.hidden += by
        elif tag == "a":
            self.links += by

    def _end_head(self):
        """Closes a head whose end tag was left out."""
        if self.open and self.open[-1][0] == "head":
            self._close("head")

    def handle_starttag(self, tag, attrs):
        if tag == "body":
            self._close("head")
        elif tag not in HEAD_TAGS:
            self._end_head()
        if tag in BLOCK_TAGS:
            self.flush()
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):  # these end an open one of their kind
                self._close(tag, upto=("table", "ul", "ol", "dl", "div", "article", "section", "main", "body", "nav", "aside", "footer", "form", "blockquote"))
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        words = [w.lower() for k, v in attrs if k in ("class", "id", "role", "itemprop") and v for w in _WORD.findall(v)]
        self.open.append((tag, (f"<{tag}", *words)))
        for token in self.open[-1][1]:
            self.path[token] = self.path.get(token, 0) + 1
        self._count(tag, 1)

    def _close(self, tag, upto=()):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                for gone, tokens in self.open[i:]:
                    self._count(gone, -1)
                    for token in tokens:
                        self.path[token] -= 1
                        if not self.path[token]:
                            del self.path[token]
                del self.open[i:]
                return
            if self.open[i][0] in upto:
                return

    def handle_endtag(self, tag):
        if tag in BLOCK_TAGS:
            self.flush()
        self._close(tag)

    def handle_data(self, data):
        if data.strip():
            self._end_head()
        if not self.hidden:
            self.text.append(data)
            if self.links:
                self.linked += len(data)


def parse(html: str | None):
    """Leaf blocks of a page; whatever ends it, nothing is lost."""
    p = _Blocks()
    p.feed(html or "")
    p.close()
    p.flush()
    return p.out


def told(path) -> int | None:
    """What the innermost telling token says: 1 main text, 0 not; None where no token tells."""
    for token in reversed(path):
        word = token.lstrip("<")
        if word in OUTSIDE:
            return 0
        if word in INSIDE:
            return 1
    return None


def suggest(path, text: str, linked: int) -> int:
    """Label that structure suggests: the innermost telling token decides, else a heading is kept, else size and links decide."""
    few_links = linked < 0.3 * len(text)
    own = told(path)
    return int(few_links and (len(text) > 60 or not HEADINGS.isdisjoint(path))) if own is None else own


def _slot(token: str, size: int) -> int:
    return zlib.crc32(token.encode()) % size


def features(blocks) -> np.ndarray:
    """One row a block."""
    x = np.zeros((len(blocks), PATH + WORDS + 5), np.float32)
    for i, (path, text, linked) in enumerate(blocks):
        for token in path:
            word = token.lstrip("<")
            x[i, _slot(token, PATH - 2)] = 1
            x[i, PATH - 2] += word in OUTSIDE
            x[i, PATH - 1] += word in INSIDE
        words = text.split(" ")
        np.add.at(x[i, PATH:PATH + WORDS], [_slot(w, WORDS) for w in words], 1 / len(words))
        x[i, -5:] = np.log1p(len(text)) / 8, np.log1p(len(words)) / 6, min(1, linked / len(text)), text[-1] in ".!?", i / len(blocks)
    return x


class Labeller:
    """Bidirectional LSTM with a logistic output for each block."""

    def __init__(self, size: int, rnd: np.random.RandomState):
        h = HIDDEN
        self.w = {f"{d}{n}": (rnd.randn(*s) / np.sqrt(s[0])).astype(np.float32) for d in "fb" for n, s in (("x", (size, 4 * h)), ("h", (h, 4 * h)))}
        self.w |= {f"{d}c": np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]).astype(np.float32) for d in "fb"}
        self.w |= {"o": (rnd.randn(2 * h) / 6).astype(np.float32), "oc": np.zeros(1, np.float32)}

    @staticmethod
    def _back(x, n):
        """Each sequence of a padded batch turned round within its length."""
        at = np.arange(x.shape[1])
        turn = np.where(at < n[:, None], n[:, None] - 1 - at, at)
        return np.take_along_axis(x, turn.reshape(turn.shape + (1,) * (x.ndim - 2)), 1)

    def _run(self, x, d):
        """Hidden states (and what training needs) of one direction over (pages, blocks, inputs)."""
        h, w = HIDDEN, self.w
        z = x @ w[f"{d}x"] + w[f"{d}c"]
        s, c = np.zeros((len(x), h), np.float32), np.zeros((len(x), h), np.float32)
        out, gates, cells = np.zeros((*x.shape[:2], h), np.float32), [], []
        for t in range(x.shape[1]):
            a = z[:, t] + s @ w[f"{d}h"]
            g = 1 / (1 + np.exp(-np.clip(a[:, :3 * h], -30, 30)))
            new = np.tanh(a[:, 3 * h:])
            c = g[:, h:2 * h] * c + g[:, :h] * new
            s = g[:, 2 * h:] * np.tanh(c)
            out[:, t] = s
            gates.append((g, new))
            cells.append(c)
        return out, gates, cells

    def forward(self, x, n):
        f = self._run(x, "f")
        xb = self._back(x, n)
        b = self._run(xb, "b")
        both = np.concatenate([f[0], self._back(b[0], n)], 2)
        return 1 / (1 + np.exp(-np.clip(both @ self.w["o"] + self.w["oc"], -30, 30))), both, f, xb, b

    def gradients(self, x, n, y):
        h, w = HIDDEN, self.w
        p, both, f, xb, b = self.forward(x, n)
        real = np.arange(x.shape[1]) < n[:, None]
        d = ((p - y) * real / real.sum()).astype(np.float32)
        grad = {"o": np.einsum("bt,bth->h", d, both), "oc": d.sum(keepdims=True).reshape(1)}
        into = d[:, :, None] * w["o"]
        for name, xs, (out, gates, cells), ds in (("f", x, f, into[:, :, :h]), ("b", xb, b, self._back(into[:, :, h:], n))):
            da = np.zeros((*x.shape[:2], 4 * h), np.float32)
            dh, dc = np.zeros((len(x), h), np.float32), np.zeros((len(x), h), np.float32)
            for t in range(x.shape[1] - 1, -1, -1):
                g, new = gates[t]
                tc = np.tanh(cells[t])
                dh = dh + ds[:, t]
                dc = dc + dh * g[:, 2 * h:] * (1 - tc * tc)
                old = cells[t - 1] if t else np.zeros_like(tc)
                dg = np.concatenate([dc * new, dc * old, dh * tc], 1) * g * (1 - g)
                da[:, t] = np.concatenate([dg, dc * g[:, :h] * (1 - new * new)], 1)
                dh = da[:, t] @ w[f"{name}h"].T
                dc = dc * g[:, h:2 * h]
            before = np.concatenate([np.zeros((len(x), 1, h), np.float32), out[:, :-1]], 1)
            flat = da.reshape(-1, 4 * h)
            grad[f"{name}x"] = xs.reshape(len(flat), -1).T @ flat
            grad[f"{name}h"] = before.reshape(-1, h).T @ flat
            grad[f"{name}c"] = flat.sum(0)
        return grad

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Whether each block of each page is main text."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = [i for i in np.argsort([len(p) for p in pages], kind="stable").tolist() if len(pages[i])]
        while order:
            take = [order.pop()]
            longest = len(pages[take[0]])
            while order and (len(take) + 1) * longest <= LOAD:
                take.append(order.pop())
            n = np.array([len(pages[i]) for i in take])
            p = self.forward(_padded([pages[i] for i in take], longest), n)[0]
            for row, i in enumerate(take):
                out[i] = p[row, :n[row]] >= 0.5
        return out


def _padded(pages, longest):
    x = np.zeros((len(pages), longest, pages[0].shape[1] if pages[0].ndim > 1 else 1), np.float32)
    for i, p in enumerate(pages):
        x[i, :len(p)] = p.reshape(len(p), -1)
    return x


def _altered(blocks, rnd: random.Random):
    """A page with its labels after changes: strange blocks put in, the main part under other tags."""
    labelled = [(b, suggest(*b)) for b in blocks]
    holder = rnd.choice([("<article",), ("<main",), ("<div", "content"), ("<div", "post", "body"), ("<section", "story"), ("<div",)])
    plain = holder == ("<div",)
    out = []
    for (path, text, linked), y in labelled:
        if y and not plain:
            path = tuple(t for t in path if t.lstrip("<") not in INSIDE)
            path = (*path[:-1], *holder, *path[-1:])
        out.append(((path, text, linked), y))
        if y and rnd.random() < 0.25:  # short lists, tables, code and headings belong to the text around them
            few = " ".join(text.split(" ")[:rnd.randint(1, 6)])
            out += [(((*path[:-1], *rnd.choice(SHORT_KINDS)), few, 0), 1)] * rnd.randint(1, 3)
    texts = [b[1] for b, _ in out] or ["a"]
    for _ in range(rnd.randint(1, 6)):
        word, tag = rnd.choice(sorted(OUTSIDE)), rnd.choice(["<div", "<section", "<ul", "<aside", "<p", "<form", "<header"])
        text = rnd.choice(texts)
        text = " ".join(text.split(" ")[:rnd.randint(1, 60)])
        inner = rnd.choice(["<p", "<li", "<div", "<h3", "<span"])
        many = [((("<html", "<body", tag, word, inner), text, rnd.choice([0, 0, len(text)])), 0)] * rnd.randint(1, 3)
        at = rnd.choice([0, len(out), rnd.randint(0, len(out))])
        out[at:at] = many
    return out


def _examples(batches):
    for batch in batches:
        packed = []
        for html in batch.column("html").to_pylist():
            blocks = parse(html)[:FIT_BLOCKS]
            rnd = random.Random(zlib.crc32((html or "").encode()))
            for variant in ([(b, suggest(*b)) for b in blocks], _altered(blocks, rnd), _altered(blocks, rnd)):
                if variant:
                    packed.append(pickle.dumps((features([b for b, _ in variant]).astype(np.float16), np.array([y for _, y in variant], np.float32))))
        yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], ["example"])


def learn(pages: DataFrame) -> dict[str, np.ndarray] | None:
    """Weights fitted on about SAMPLE pages; None where there is no block at all."""
    n = pages.count()
    share = min(1.0, SAMPLE / max(1, n))
    some = pages.select(F.col("html").cast("string").alias("html")).where(F.pmod(F.xxhash64("html"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    rows = some.dropDuplicates(["html"]).mapInArrow(_examples, "example binary").collect()
    data = sorted((pickle.loads(r.example) for r in rows), key=lambda e: (len(e[1]), e[1].sum(), float(e[0].sum())))
    if not data:
        return None
    net = Labeller(PATH + WORDS + 5, np.random.RandomState(5))
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v = {k: np.zeros_like(w) for k, w in net.w.items()}
    groups, rnd, step = [data[i:i + 24] for i in range(0, len(data), 24)], random.Random(5), 0
    for _ in range(ROUNDS):
        rnd.shuffle(groups)
        for group in groups:
            size = np.array([len(y) for _, y in group])
            x, y = _padded([a.astype(np.float32) for a, _ in group], size.max()), _padded([b for _, b in group], size.max())[:, :, 0]
            step += 1
            for k, g in net.gradients(x, size, y).items():
                g = np.clip(g, -1, 1)
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                net.w[k] = (net.w[k] - 0.02 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
    return net.w


def _extract(weights):
    def run(batches):
        net = Labeller(PATH + WORDS + 5, np.random.RandomState(5))
        if weights is not None:
            net.w = weights
        for batch in batches:
            pages = [parse(h) for h in batch.column("html").to_pylist()]
            kept = net.label([features(p) for p in pages])
            # where a tag, class or role says what a block is, that stands; the network decides the others by their context
            kept = [[bool(k) if (own := told(b[0])) is None else bool(own) for b, k in zip(p, keep, strict=True)] for p, keep in zip(pages, kept, strict=True)]
            text = ["\n".join(b[1] for b, k in zip(p, keep, strict=True) if k) for p, keep in zip(pages, kept, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string())], ["page_id", "url", "text"])
    return run


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row: blocks labelled main text, in page order, one a line.

    Null and empty pages and pages without main text give the empty text; repeated rows and null ids stay.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract(learn(rows)), "page_id long, url string, text string")

"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the DOM.

A page is cut into leaf blocks (runs of text without a block-level tag inside). Each block gets features of its
ancestors (tags, words of class and id), of its text (length, links, signs) and of its place; the field scores
the two labels of every block and the change of label between neighbours, and Viterbi picks the best sequence.
It is trained by maximum likelihood on labelled pages, with all pages of a training step in one array. Labelled
pages come from ``labelled_pages``: ``PAGES`` random layouts (the documented bound of the training set) of
articles among menus, headers, footers, sidebars, notices, adverts, forms and comments, with invented words, so
that nothing depends on the words of one site.

Defined cases: null or empty html, or a page without content blocks, gives an empty text; markup may be cut off
or unclosed; pages of any length are read whole; repeated rows each get a row; other columns are not read.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read

SIZE = 4096  # hashed features
PAGES = 500  # labelled pages
STEPS = 120

# fixed values: element kinds of the HTML standard
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style title noscript template iframe object svg math canvas audio video select textarea head".split())
RAW = frozenset("script style title textarea iframe noscript".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
                     "h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "thead": {"tr", "td", "th"}}

MARKUP = re.compile(r"""<!--.*?(?:-->|--!>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)""", re.S)
ATTR = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[a-z]+")
CUES = re.compile(r"(?i)cookie|copyright|©|subscrib|newsletter|sign ?up|log ?in|comment|repl(?:y|ies)|share|advert|sponsor|privacy|rights")


class Block:
    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: tuple, linked: int):
        self.text, self.path, self.linked = text, path, linked


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order: text, ((tag, attribute words), ...) from the root, linked characters."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    links = linked = at = 0

    def flush() -> None:
        nonlocal linked
        if text:
            t = " ".join(entities.unescape("".join(text)).split())
            if t and not any(tag in UNSEEN for tag, _ in stack):
                out.append(Block(t, tuple(stack), linked))
            text.clear()
        linked = 0

    def close(tags: set[str] | frozenset[str], until: frozenset[str] = frozenset(["table", "ul", "ol", "dl", "body"])) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                del stack[i:]
                return
            if stack[i][0] in until:
                return

    def more(piece: str) -> None:
        nonlocal linked
        text.append(piece)
        if links > 0:
            linked += len(piece)

    while True:
        m = MARKUP.search(page, at)
        if m is None:
            more(page[at:])
            break
        if m.start() > at:
            more(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, ends = m[2].lower(), bool(m[1])
        if tag in INLINE:
            if tag == "br":
                more(" ")
            elif tag == "a":
                links = 0 if ends else 1
            continue
        flush()
        if ends:
            links = 0
            if tag == "p" or any(t == tag for t, _ in stack):
                close({tag}, frozenset())
            continue
        if tag in CLOSES_P:
            close({"p"}, frozenset(["table", "div", "article", "section", "li", "body", "td"]))
        if tag in CLOSES:
            close(CLOSES[tag])
        if tag in RAW and not m[3].endswith("/"):
            found = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = found.end() if found else len(page)
            continue
        if tag not in VOID:
            words: list[str] = []
            for a in ATTR.finditer(m[3]):
                words += PART.findall((a[2] or a[3] or a[4] or "").lower())
            if tag == "body":  # a body closes an open head
                stack[:] = [x for x in stack if x[0] == "html"]
            stack.append((tag, tuple(words)))
    flush()
    return out


def _number(feature: str) -> int:
    return zlib.crc32(feature.encode()) % SIZE


@lru_cache(200_000)
def path_features(path: tuple) -> tuple[int, ...]:
    tags = [t for t, _ in path]
    out = {f"own {tags[-1]}" if tags else "own none", f"parent {tags[-2]}" if len(tags) > 1 else "parent none"}
    out |= {f"in {t}" for t in tags}
    out |= {f"word {w}" for _, words in path for w in words}
    out |= {f"near {w}" for w in (path[-1][1] if path else ())}
    return tuple(_number(f) for f in sorted(out))


@lru_cache(4096)
def text_features(size: int, linked: int, ends: bool, cue: str, place: str) -> tuple[int, ...]:
    return tuple(_number(f) for f in (f"size {size}", f"linked {linked}", f"ends {ends}", f"cue {cue} {size if cue else ''}", f"place {place}", "any",
                                      f"size {size} linked {linked}"))


def features(page: list[Block]) -> list[tuple[int, ...]]:
    out = []
    for i, b in enumerate(page):
        n = len(b.text)
        cue = CUES.search(b.text)
        out.append(path_features(b.path) + text_features(
            n.bit_length(), min(4, 4 * b.linked // n), b.text[-1] in ".!?:;\"'”»…", cue[0].lower() if cue else "",
            "first" if i == 0 else "last" if i == len(page) - 1 else "middle"))
    return out


def viterbi(score: np.ndarray, change: np.ndarray) -> list[int]:
    """Best labels for scores (blocks, 2) and label changes (2, 2)."""
    (c00, c01), (c10, c11) = change.tolist()
    back, (x, y) = [], score[0].tolist()
    for s0, s1 in score[1:].tolist():
        a, b = x + c00 >= y + c10, x + c01 >= y + c11
        back.append((0 if a else 1, 0 if b else 1))
        x, y = s0 + (x + c00 if a else y + c10), s1 + (x + c01 if b else y + c11)
    label = [0 if x >= y else 1]
    for step in reversed(back):
        label.append(step[label[-1]])
    return label[::-1]


class Field:
    """Weights of the field: (SIZE + 1, 2) for features, (2, 2) for changes; the last feature is padding."""

    def __init__(self):
        self.weight, self.change = np.zeros((SIZE + 1, 2)), np.zeros((2, 2))

    def label(self, page: list[Block]) -> list[int]:
        f = features(page)
        size = np.array([len(x) for x in f])
        flat = self.weight[np.fromiter((i for x in f for i in x), np.int64, int(size.sum()))]
        return viterbi(np.add.reduceat(flat, np.cumsum(size) - size), self.change)

    def fit(self, pages: list[tuple[list[Block], list[int]]], steps: int = STEPS, decay: float = 2.0, rate: float = 0.15) -> Field:
        """Maximum likelihood with a squared penalty, by Adam; forward and backward sums run over all pages at once."""
        n, longest = len(pages), max(len(b) for b, _ in pages)
        feats = [features(b) for b, _ in pages]
        width = max(len(f) for page in feats for f in page)
        index = np.full((longest, n, width), SIZE)
        gold, real = np.zeros((longest, n), np.int64), np.zeros((longest, n), bool)
        for k, (page, (_, labels)) in enumerate(zip(feats, pages, strict=True)):
            for t, (f, y) in enumerate(zip(page, labels, strict=True)):
                index[t, k, :len(f)], gold[t, k], real[t, k] = f, y, True
        params = np.zeros((SIZE + 1) * 2 + 4)
        m, v, both = np.zeros_like(params), np.zeros_like(params), real[1:] & real[:-1]
        flat = index.reshape(-1)
        for step in range(1, steps + 1):
            w, c = params[:-4].reshape(-1, 2), params[-4:].reshape(2, 2)
            e = np.where(real[..., None], w[index].sum(axis=2), 0.0)
            fore, back = np.zeros_like(e), np.zeros_like(e)
            fore[0] = e[0]
            for t in range(1, longest):
                f = np.logaddexp.reduce(fore[t - 1][:, :, None] + c, axis=1) + e[t]
                fore[t] = np.where(real[t][:, None], f, fore[t - 1])
            for t in range(longest - 2, -1, -1):
                b = np.logaddexp.reduce(c + (back[t + 1] + e[t + 1])[:, None, :], axis=2)
                back[t] = np.where(real[t + 1][:, None], b, 0.0)
            z = np.logaddexp.reduce(fore[-1], axis=1)
            p = np.where(real[..., None], np.exp(fore + back - z[:, None]), 0.0)
            d = p - np.where(real[..., None], np.eye(2)[gold], 0.0)
            pair = np.exp(fore[:-1][..., None] + c + (e[1:] + back[1:])[:, :, None, :] - z[:, None, None])
            dc = (np.where(both[..., None, None], pair, 0.0).sum(axis=(0, 1))
                  - np.array([[(both & (gold[:-1] == i) & (gold[1:] == j)).sum() for j in (0, 1)] for i in (0, 1)]))
            g = np.stack([np.bincount(flat, np.repeat(d[..., y].reshape(-1), width), SIZE + 1) for y in (0, 1)], axis=1)
            g[SIZE] = 0
            grad = np.concatenate([g.reshape(-1), dc.reshape(-1)]) + decay * params
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            params = params - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        self.weight, self.change = params[:-4].reshape(-1, 2), params[-4:].reshape(2, 2)
        return self


def labelled_pages(n: int = PAGES, seed: int = 11) -> list[tuple[str, str]]:
    """(html, main text) of random layouts."""
    rng = random.Random(seed)
    pick, chance = rng.choice, lambda p: rng.random() < p
    syllables = [a + b for a in "bcdfglmnprstv" for b in ("a", "e", "i", "o", "u", "an", "er", "in", "on", "th")]
    word = lambda: "".join(pick(syllables) for _ in range(rng.randrange(1, 4)))
    main_words = "article content post entry story main body text page single blog news markdown prose".split()
    other = {"nav": "nav menu navbar navigation breadcrumb breadcrumbs links toc topbar pagination tags".split(),
             "header": "header masthead banner logo branding top site".split(),
             "footer": "footer colophon copyright bottom legal credits".split(),
             "aside": "sidebar aside widget related recommended trending side popular rail".split(),
             "div": "ad ads advert advertisement sponsored promo sponsor cookie consent notice alert popup modal banner share social newsletter "
                    "subscribe signup paywall".split(),
             "form": "search form login subscribe contact newsletter comment".split(),
             "section": "comments comment replies discussion respond reviews thread disqus".split()}

    def sentence(lo: int = 2, hi: int = 25) -> str:
        t = " ".join(word() for _ in range(rng.randrange(lo, hi)))
        return (t[:1].upper() + t[1:]) + pick([".", ".", ".", "!", "?", ""]) if chance(.85) else t.upper()

    def prose(hi: int = 6) -> str:
        return " ".join(sentence() for _ in range(rng.randrange(1, hi)))

    def dress(t: str) -> str:
        """Inline markup, breaks and references inside a block."""
        parts = t.split(" ")
        for i in range(len(parts)):
            r = rng.random()
            if r < .02:
                parts[i] = f"<{(tag := pick(['b', 'i', 'em', 'strong', 'span', 'code']))}>{parts[i]}</{tag}>"
            elif r < .03:
                parts[i] = f'<a href="/{word()}">{parts[i]}</a>'
            elif r < .035:
                parts[i] += "<br>"
        return ("<b>" if chance(.05) else "") + " ".join(parts) + ("<br>" if chance(.05) else "")

    def junk(tag: str | None = None) -> str:
        kind = tag or pick(list(other))
        words = " ".join(rng.sample(other[kind], rng.randrange(1, 3)))
        name = kind if chance(.6) else "div"
        attr = f' {pick(["class", "class", "id"])}="{words}"' if name == "div" or chance(.5) else ""
        item = lambda: f'<a href="/{word()}">{sentence(1, 4)}</a>' if chance(.8) else sentence(1, 4)
        if kind == "nav" or chance(.15):
            inner = "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(rng.randrange(1, 8))) + "</ul>" if chance(.8) else " ".join(
                item() for _ in range(rng.randrange(1, 6)))
        elif kind == "form":
            inner = f"<label>{sentence(1, 4)}</label><input name=q><button>{word()}</button>" + (f"<p>{prose(3)}</p>" if chance(.4) else "")
        elif kind == "header":
            inner = f"<{(h := pick(['div', 'h1', 'h2', 'p']))}>{sentence(1, 5)}</{h}>" + (f"<p>{sentence()}</p>" if chance(.5) else "")
        elif kind == "footer":
            inner = pick(["&copy; ", "", "Copyright "]) + sentence(1, 8) + (f" &middot; {prose(3)}" if chance(.5) else "") + (
                "\n" + prose(3) if chance(.4) else "")
        else:
            inner = "".join(pick([f"<p>{prose()}</p>", f"<div>{prose(4)}</div>", f"<h3>{sentence(1, 6)}</h3>", prose(3)])
                            for _ in range(rng.randrange(1, 5)))
        return f"<{name}{attr}>{inner}</{name}>"

    out = []
    for _ in range(n):
        truth: list[str] = []

        def say(truth: list[str] = truth) -> str:
            t = sentence(1, 3) if chance(.12) else prose(pick([2, 6, 10]))
            truth.append(t)
            return dress(t)

        body = []
        if chance(.85):
            t = sentence(1, 9)
            truth.append(t)
            body.append(f"<h1>{t}</h1>")
        for _ in range(rng.randrange(1, 12)):
            r = rng.random()
            if r < .7:
                body.append(f"<p>{say()}" + ("</p>" if chance(.85) else ""))
            elif r < .76:
                t = sentence(1, 7)
                truth.append(t)
                body.append(f"<{(h := pick(['h2', 'h3', 'h4']))}>{t}</{h}>")
            elif r < .82:
                body.append("<ul>" + "".join(f"<li>{say()}</li>" for _ in range(rng.randrange(1, 4))) + "</ul>")
            elif r < .86:
                body.append(f"<blockquote><p>{say()}</p></blockquote>")
            elif r < .9:
                body.append(f"<div>{say()}</div>")
            else:
                body.append(junk(pick(["div", "aside", "form", "section"])))
        wrap, words = pick(["article", "article", "article", "main", "div", "section"]), " ".join(rng.sample(main_words, rng.randrange(1, 3)))
        attr = f' {pick(["class", "class", "id"])}="{words}"' if wrap in ("div", "section") or chance(.4) else ""
        middle = f"<{wrap}{attr}>{''.join(body)}</{wrap}>"
        if chance(.25):
            middle = f"<main>{middle}</main>" if chance(.5) else f'<div class="{pick(["container", "wrapper", "row", "layout", "page"])}">{middle}</div>'
        top = "".join(junk(pick(["nav", "header", "div", "form", "div", "aside"])) for _ in range(rng.randrange(0, 5)))
        end = "".join(junk(pick(["footer", "section", "aside", "div", "nav", "form", "footer"])) for _ in range(rng.randrange(0, 5)))
        page = (f"<!DOCTYPE html><html><head><title>{sentence(1, 6)}</title><style>p{{}}</style><script>var x='</p>';</script></head>"
                f"<body>{top}<!-- {word()} -->{middle}{end}</body></html>")
        out.append((page[:-14] if chance(.1) else page, "\n\n".join(truth)))
    return out


def labels_of(page: str, text: str) -> tuple[list[Block], list[int]]:
    """Blocks and their labels: the blocks of the main text occur in order."""
    found, want, labels = blocks(page), text.split("\n\n"), []
    for b in found:
        hit = bool(want) and b.text == want[0]
        labels.append(int(hit))
        want = want[1:] if hit else want
    return found, labels


@lru_cache(1)
def trained(pages: int = PAGES) -> Field:
    rows = [labels_of(*p) for p in labelled_pages(pages)]
    return Field().fit([r for r in rows if r[0]])


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page) if page else []
    return "\n\n".join(b.text for b, y in zip(found, field.label(found), strict=True) if y) if found else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", field: Field | None = None) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars."""
    model = field or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py(), model) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], names=out.names)

    rows = pages.select(id_col, url_col, html_col)
    out = rows.select(id_col, url_col).schema.add("text", "string").add("n_chars", "long")
    return rows.mapInArrow(run, out)


def op5_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


QUERIES = {"op5_html_crf": op5_html_crf}
ORACLES: dict[str, str] = {}

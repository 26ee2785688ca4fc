"""Main text of web pages: a bidirectional LSTM reads a page's leaf blocks in order and labels each of them."""

from __future__ import annotations

import functools
import html
import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import PATHS, Block, blocks, path_bucket
from .common import text_of

#: Number of hash buckets of words in texts, and of plain figures per block.
WORDS, FIGURES = 2048, 9
#: Most blocks that are read at a time.
STRETCH = 1 << 14
#: A private character that marks the main text of pages that are made up for training.
MARK = ""

#: Elements that say by their name or role that they hold the main text, or that they do not.
MAIN = ("t:article", "t:main", "c:main", "c:article")
BESIDE = tuple("t:nav t:aside t:footer t:form t:button t:select t:dialog t:menu t:textarea t:label".split())

#: Words by which pages name their parts.
NAMES: dict[str, tuple[str, ...]] = {
    "main": tuple("article post content entry story article-body post-content entry-content main-content articleBody text body-copy page-content blog-post news-item markdown prose detail single".split()),
    "nav": tuple("nav navbar menu main-menu navigation topnav breadcrumb breadcrumbs site-nav tabs links pagination pager toc sitemap".split()),
    "head": tuple("header site-header masthead top banner logo branding topbar page-header hero".split()),
    "foot": tuple("footer site-footer bottom copyright legal colophon credits imprint foot".split()),
    "side": tuple("sidebar aside widget widgets related related-posts rail secondary recommended popular trending also-read more-stories teaser tags tagcloud author-box".split()),
    "notice": tuple("cookie cookie-banner consent notice alert notification gdpr privacy popup modal overlay message warning paywall subscribe-notice".split()),
    "ad": tuple("ad ads advert advertisement adbox sponsor sponsored promo promotion banner-ad dfp partner-content ad-slot outbrain taboola".split()),
    "form": tuple("form search search-form newsletter subscribe signup login contact-form feedback poll survey".split()),
    "comments": tuple("comments comment-list comment commentlist responses discussion replies reply reader-comments disqus feedback-list guestbook thread reviews user-comments kommentare comentarios commentaires".split()),
    "share": tuple("share social sharing share-buttons follow sharebar byline meta post-meta".split()),
}
#: What such parts often say, in the languages of the web pages.
PHRASES: dict[str, tuple[str, ...]] = {
    "nav": tuple("Home;About;Contact;News;Blog;Login;Next page;Previous;Start;Über uns;Kontakt;Accueil;À propos;Inicio;Noticias;Sign in;Archive;Shop;Help;FAQ".split(";")),
    "head": tuple("Skip to content;Welcome to our site;The daily news;Your source of news".split(";")),
    "foot": tuple("© 2024 All rights reserved.;Terms of use;Privacy policy;Impressum;Datenschutz;Mentions légales;Aviso legal;Powered by;Copyright ©".split(";")),
    "side": tuple("Related articles;Read more;Most popular;You may also like;Tags;Categories;Recent posts;About the author".split(";")),
    "notice": tuple("We use cookies to improve your experience.;This site uses cookies. Accept;Wir verwenden Cookies.;Nous utilisons des cookies.;Usamos cookies.;Please enable JavaScript.;Subscribe to continue reading.".split(";")),
    "ad": tuple("Advertisement;Sponsored;Anzeige;Publicité;Publicidad;Buy now;Limited offer: 50% off;Ad".split(";")),
    "form": tuple("Search;Your email;Submit;Sign up for our newsletter;Name;Password;Suche;Rechercher;Buscar".split(";")),
    "comments": tuple("Comments;3 comments;Leave a reply;Reply;says:;Kommentare;Commentaires;Comentarios;Posted by guest;Report".split(";")),
    "share": tuple("Share;Tweet;Share on Facebook;Print;Email this;5 min read".split(";")),
}


class Bags(NamedTuple):
    """Hash buckets of all blocks one after the other, and how many each block has."""

    ids: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, lists: Sequence[Sequence[int]]) -> Bags:
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return cls(np.fromiter((i for x in lists for i in x), np.int32, int(sizes.sum())), sizes)

    @classmethod
    def joined(cls, bags: Sequence[Bags]) -> Bags:
        return cls(np.concatenate([b.ids for b in bags]), np.concatenate([b.sizes for b in bags]))

    def cut(self, a: int, b: int) -> Bags:
        start = int(self.sizes[:a].sum())
        return Bags(self.ids[start : start + int(self.sizes[a:b].sum())], self.sizes[a:b])

    def thinned(self, kept: np.ndarray) -> Bags:
        ends = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], np.cumsum(self.sizes)])]
        return Bags(self.ids[kept], np.diff(ends))

    def means(self, table: np.ndarray) -> np.ndarray:
        """Mean of the table's rows for each block; zero for a block without any."""
        out = np.zeros((len(self.sizes), table.shape[1]), np.float32)
        some = np.flatnonzero(self.sizes)
        if len(some):
            starts = np.concatenate([[0], np.cumsum(self.sizes[some])])
            for a in range(0, len(some), 2048):  # a bounded piece of the gathered rows at a time
                b = min(a + 2048, len(some))
                sums = np.add.reduceat(table[self.ids[starts[a] : starts[b]]], starts[a:b] - starts[a], axis=0)
                out[some[a:b]] = sums / self.sizes[some[a:b], None]
        return out

    def gradient(self, due: np.ndarray, rows: int) -> np.ndarray:
        """Gradient of the table, given that of the means."""
        share = np.repeat(due / np.maximum(self.sizes, 1)[:, None], self.sizes, axis=0)
        return np.stack([np.bincount(self.ids, share[:, k], rows) for k in range(due.shape[1])], axis=1).astype(np.float32)


class Page(NamedTuple):
    paths: Bags
    words: Bags
    figures: np.ndarray

    def cut(self, a: int, b: int) -> Page:
        return Page(self.paths.cut(a, b), self.words.cut(a, b), self.figures[a:b])


@functools.lru_cache(1 << 18)
def word_bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORDS


def described(found: Sequence[Block]) -> Page:
    """Path buckets, word buckets of the whole text, and plain figures of each block: sizes, links, stops, place."""
    words = Bags.of([[word_bucket(w) for w in b.text.lower().split(" ")] for b in found])
    figures = np.empty((len(found), FIGURES), np.float32)
    for i, b in enumerate(found):
        n = len(b.text)
        stops = sum(map(b.text.count, ".,;:!?"))
        figures[i] = (
            np.log1p(n) / 5,
            np.log1p(words.sizes[i]) / 4,
            b.linked / n,
            min(1.0, 10 * stops / n),
            b.text[-1] in ".!?…",
            (i + 1) / len(found),
            min(b.depth, 20) / 10,
            "©" in b.text,
            sum(map(str.isdigit, b.text)) / n,
        )
    return Page(Bags.of([b.path for b in found]), words, figures)


class Lstm:
    """One direction of the network, over padded sequences (time, page, feature); padding leaves the state as it is."""

    def __init__(self, inputs: int, hidden: int, rng: np.random.Generator) -> None:
        self.weights = {"x": rng.normal(0, inputs**-0.5, (inputs, 4 * hidden)), "h": rng.normal(0, hidden**-0.5, (hidden, 4 * hidden)), "b": np.zeros(4 * hidden)}
        self.weights["b"][hidden : 2 * hidden] = 1  # remembers at first
        self.weights = {k: v.astype(np.float32) for k, v in self.weights.items()}
        self.hidden = hidden

    def start(self, pages: int) -> tuple[np.ndarray, np.ndarray]:
        return (np.zeros((pages, self.hidden), np.float32),) * 2

    def forward(self, x: np.ndarray, mask: np.ndarray, state: tuple[np.ndarray, np.ndarray], kept: list | None = None) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Outputs and the state after them; ``kept`` gets what ``backward`` needs."""
        steps, pages, _ = x.shape
        fed = x @ self.weights["x"] + self.weights["b"]
        h, c = state
        out = np.empty((steps, pages, self.hidden), np.float32)
        for t in range(steps):
            gates = fed[t] + h @ self.weights["h"]
            i, f, o = np.split(1 / (1 + np.exp(-gates[:, : 3 * self.hidden])), 3, axis=1)
            g = np.tanh(gates[:, 3 * self.hidden :])
            m = mask[t][:, None]
            new = f * c + i * g
            tan = np.tanh(new)
            if kept is not None:
                kept.append((h, c, i, f, o, g, tan, m))
            h, c = np.where(m, o * tan, h), np.where(m, new, c)
            out[t] = h
        return out, (h, c)

    def backward(self, x: np.ndarray, kept: list, due: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the weights and of the input, given those of the output."""
        gates = np.empty((*x.shape[:2], 4 * self.hidden), np.float32)
        dh = dc = np.zeros((x.shape[1], self.hidden), np.float32)
        for t in range(len(x) - 1, -1, -1):
            _, c, i, f, o, g, tan, m = kept[t]
            dh = dh + due[t]
            dn = dc + dh * o * (1 - tan**2)
            gates[t] = np.concatenate([dn * g * i * (1 - i), dn * c * f * (1 - f), dh * tan * o * (1 - o), dn * i * (1 - g**2)], axis=1) * m
            dh, dc = np.where(m, gates[t] @ self.weights["h"].T, dh), np.where(m, dn * f, dc)
        grads = {"x": np.tensordot(x, gates, ((0, 1), (0, 1))), "h": np.tensordot(np.stack([k[0] for k in kept]), gates, ((0, 1), (0, 1))), "b": gates.sum(axis=(0, 1))}
        return grads, gates @ self.weights["x"].T


class Labeller:
    """Embeddings of hashed path and text words, an LSTM in each direction of the page, and one logistic unit a block."""

    def __init__(self, *, hidden: int = 32, path_size: int = 20, word_size: int = 8, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.paths = rng.normal(0, 0.5, (PATHS, path_size)).astype(np.float32)
        self.words = rng.normal(0, 0.5, (WORDS, word_size)).astype(np.float32)
        size = path_size + word_size + FIGURES
        self.ways = (Lstm(size, hidden, rng), Lstm(size, hidden, rng))
        self.out = rng.normal(0, 0.2, 2 * hidden).astype(np.float32)
        self.bias = np.zeros(1, np.float32)

    def _inputs(self, pages: Sequence[Page]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(p.figures) for p in pages])
        mask = np.arange(sizes.max())[:, None] < sizes
        paths, words = Bags.joined([p.paths for p in pages]), Bags.joined([p.words for p in pages])
        flat = np.concatenate([paths.means(self.paths), words.means(self.words), np.concatenate([p.figures for p in pages])], axis=1)
        x = np.zeros((len(pages), len(mask), flat.shape[1]), np.float32)
        x[mask.T] = flat
        return x.transpose(1, 0, 2), mask

    def scores(self, pages: Sequence[Page]) -> list[np.ndarray]:
        """Log odds of being main text for every block of every page.

        Pages of like lengths are read together; long ones in stretches in each direction, with only the state and a
        number per block carried on.
        """
        out = [np.full(len(p.figures), self.bias[0], np.float32) for p in pages]
        order = sorted((k for k in range(len(pages)) if len(out[k])), key=lambda k: len(out[k]))
        while order:
            group = [order.pop()]
            most = len(out[group[0]])
            while order and most * (len(group) + 1) <= STRETCH and 2 * len(out[order[-1]]) >= most:
                group.append(order.pop())
            stretches = range(0, most, STRETCH)
            half = len(self.out) // 2
            for way, part, turn, order_of in ((self.ways[0], self.out[:half], 1, stretches), (self.ways[1], self.out[half:], -1, reversed(stretches))):
                state = way.start(len(group))
                for a in order_of:
                    cut = [pages[k] for k in group] if most <= STRETCH else [pages[group[0]].cut(a, a + STRETCH)]
                    x, mask = self._inputs(cut)
                    seen, state = way.forward(x[::turn], mask[::turn], state)
                    score = (seen @ part)[::turn]
                    for j, k in enumerate(group):
                        out[k][a : a + STRETCH] += score[: len(out[k]) - a, j]
        return out

    def fit(self, pages: Sequence[Page], labels: Sequence[np.ndarray], *, rounds: int = 12, batch: int = 24, rate: float = 0.01, dropped: float = 0.05, seed: int = 11) -> Labeller:
        """Adam on the logistic loss; in each step half of the pages go without some of the path words, so that no single name decides."""
        rng = np.random.default_rng(seed)
        tensors = {"paths": self.paths, "words": self.words, "out": self.out, "bias": self.bias} | {f"{k}{n}": w for k, way in enumerate(self.ways) for n, w in way.weights.items()}
        first, second = ({k: np.zeros_like(v) for k, v in tensors.items()} for _ in range(2))
        order = sorted(range(len(pages)), key=lambda k: len(pages[k].paths))
        groups = [order[a : a + batch] for a in range(0, len(order), batch)]
        step = 0
        for turn in range(rounds):
            for g in rng.permutation(len(groups)):
                chosen = [pages[k]._replace(paths=pages[k].paths.thinned((rng.random(PATHS) > dropped * (rng.random() < 0.5))[pages[k].paths.ids])) for k in groups[g]]
                grads = self._gradients(chosen, [labels[k] for k in groups[g]])
                step += 1
                scale = min(1.0, 5 / (sum(float((v**2).sum()) for v in grads.values()) ** 0.5 + 1e-9))
                now = rate * (1 - turn / rounds)
                for k, v in grads.items():
                    first[k] += 0.1 * (v * scale - first[k])
                    second[k] += 0.01 * ((v * scale) ** 2 - second[k])
                    tensors[k] -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def _gradients(self, pages: Sequence[Page], labels: Sequence[np.ndarray]) -> dict[str, np.ndarray]:
        x, mask = self._inputs(pages)
        kept: tuple[list, list] = ([], [])
        ahead = self.ways[0].forward(x, mask, self.ways[0].start(len(pages)), kept[0])[0]
        back = self.ways[1].forward(x[::-1], mask[::-1], self.ways[1].start(len(pages)), kept[1])[0][::-1]
        joined = np.concatenate([ahead, back], axis=2)
        wanted = np.zeros(mask.shape, np.float32)
        for k, label in enumerate(labels):
            wanted[: len(label), k] = label
        miss = np.where(mask, 1 / (1 + np.exp(-(joined @ self.out + self.bias))) - wanted, 0).astype(np.float32) / np.float32(mask.sum())
        due = miss[:, :, None] * self.out
        half = len(self.out) // 2
        one, into = self.ways[0].backward(x, kept[0], due[:, :, :half])
        two, onto = self.ways[1].backward(x[::-1], kept[1], due[::-1, :, half:])
        flat = (into + onto[::-1]).transpose(1, 0, 2)[mask.T]
        grads = {"out": np.tensordot(miss, joined, 2), "bias": np.array([miss.sum()], np.float32)} | {f"0{k}": v for k, v in one.items()} | {f"1{k}": v for k, v in two.items()}
        n = self.paths.shape[1]
        grads["paths"] = Bags.joined([p.paths for p in pages]).gradient(flat[:, :n], len(self.paths))
        grads["words"] = Bags.joined([p.words for p in pages]).gradient(flat[:, n : n + self.words.shape[1]], len(self.words))
        return grads


def declared(found: Sequence[Block]) -> np.ndarray | None:
    """Labels that a page gives itself: main text is inside an article or main element and not beside it; None if there is no such element."""
    main, beside = ({path_bucket(w) for w in words} for words in (MAIN[:2], (*BESIDE, *(f"c:{w}" for k in ("comments", "ad", "notice", "form") for w in NAMES[k] if "-" not in w))))
    labels = np.array([bool(main & set(b.path)) and not beside & set(b.path) for b in found])
    return labels if labels.any() else None


class Maker:
    """Makes up pages of many layouts for training; main text starts with a mark. Words come from the given texts."""

    def __init__(self, texts: Sequence[str], seed: int) -> None:
        self.rng = np.random.default_rng(seed)
        self.sentences = [s for t in texts for s in t.replace("\n", " ").split(". ") if 1 <= len(s.split()) <= 60] or ["One two three four five six seven"]
        self.vocabulary = sorted({w for s in self.sentences for w in s.split()})

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def pick(self, among: Sequence[str]) -> str:
        return among[int(self.rng.integers(len(among)))]

    def between(self, a: int, b: int) -> int:
        return int(self.rng.integers(a, b + 1))

    def said(self, low: int, high: int) -> str:
        return html.escape(". ".join(self.pick(self.sentences).rstrip(".") for _ in range(self.between(low, high))) + ".")

    def short(self) -> str:
        return html.escape(" ".join(self.pick(self.vocabulary) for _ in range(self.between(1, 4))))

    def phrase(self, kind: str) -> str:
        return html.escape(self.pick(PHRASES[kind])) if self.chance(0.6) else self.short()

    def named(self, tag: str, kind: str, inner: str, sure: bool = False) -> str:
        """An element that is named by its kind in class or id, by some other word, or not at all."""
        name = self.pick(NAMES[kind])
        if not sure and self.chance(0.25):
            name = "".join(self.pick("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) if self.chance(0.5) else ""
        more = self.pick(["", "", " clearfix", " col", " block", " inner", " section", " wrap"])
        said = f' {self.pick(["class", "class", "id"])}="{name}{more}"' if name else ""
        return f"<{tag}{said}>{inner}</{tag}>"

    def links(self, kind: str, n: int) -> str:
        items = [f'<a href="/{k}">{self.phrase(kind) if self.chance(0.8) else self.said(1, 1)}</a>' for k in range(n)]
        form = self.between(0, 3)
        if form == 0:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        if form == 1:
            return "".join(f"<div>{x}</div>" for x in items)
        return " | ".join(items) if form == 2 else "<table><tr>" + "".join(f"<td>{x}</td>" for x in items) + "</tr></table>"

    def beside(self, kind: str) -> str:
        """A part that is no main text."""
        if kind == "nav":
            return self.named(self.pick(["nav", "nav", "div", "ul"]), kind, self.links(kind, self.between(3, 10)))
        if kind == "head":
            inner = self.pick(["<h1>{}</h1>", "<a href='/'>{}</a>", "<p>{}</p>", "<div>{}</div>"]).format(self.phrase(kind)) + (self.links("nav", 4) if self.chance(0.4) else "")
            return self.named(self.pick(["header", "header", "div"]), kind, inner)
        if kind == "foot":
            return self.named(self.pick(["footer", "footer", "div"]), kind, f"<p>{self.phrase(kind)} &middot; {self.said(1, 2)}</p>" if self.chance(0.5) else f"&copy; {self.phrase(kind)} {self.said(1, 2)}" + (self.links(kind, 4) if self.chance(0.5) else ""))
        if kind == "side":
            inner = "".join(f"<h3>{self.phrase(kind)}</h3>" + (self.links(kind, self.between(2, 6)) if self.chance(0.7) else f"<p>{self.said(1, 2)}</p>") for _ in range(self.between(1, 3)))
            return self.named(self.pick(["aside", "aside", "div"]), kind, inner, True)
        if kind == "notice":
            return self.named(self.pick(["div", "div", "section", "dialog", "p"]), kind, f"{self.phrase(kind)} {self.said(1, 2) if self.chance(0.5) else ''}" + ("<button>OK</button>" if self.chance(0.5) else ""), True)
        if kind == "ad":
            return self.named(self.pick(["div", "div", "aside", "section", "ins"]), kind, self.pick(["{}", "<p>{}</p>", "<a href='/x'>{}</a>", "<div>{}</div>"]).format(self.said(1, 3) if self.chance(0.7) else self.phrase(kind)), True)
        if kind == "form":
            return self.named("form" if self.chance(0.8) else "div", kind, f"<label>{self.phrase(kind)}</label><input name=q><button>{self.phrase(kind)}</button>" + (f"<p>{self.said(1, 1)}</p>" if self.chance(0.4) else ""), True)
        if kind == "share":
            return self.named(self.pick(["div", "ul", "p"]), kind, self.links(kind, self.between(2, 4)), True)
        n, tag = self.between(1, 8), self.pick(["div", "li", "article", "section", "p"])
        items = "".join(self.named(tag, "comments", (f"<b>{self.short()}</b> " if tag == "p" else f"<{self.pick(['h4', 'div', 'span', 'cite', 'header'])}>{self.short()}</{self.pick(['h4', 'div', 'span', 'cite', 'header'])}>") + (self.said(1, 3) if tag == "p" else f"<p>{self.said(1, 4)}</p>")) for _ in range(n))
        return self.named(self.pick(["div", "section", "ol"]), kind, (f"<h3>{self.phrase(kind)}</h3>" if self.chance(0.7) else "") + items + (self.beside("form") if self.chance(0.3) else ""), True)

    def main(self) -> str:
        parts = []
        for _ in range(self.between(0, 12) if self.chance(0.9) else self.between(12, 40)):
            body = self.said(1, 7) if self.chance(0.85) else self.said(1, 1) if self.chance(0.5) else self.short() + "."
            if self.chance(0.15):
                body += f' <a href="/y">{self.short()}</a> {self.said(1, 1)}'
            kind = self.rng.random()
            if kind < 0.7:
                parts.append(f"<p>{MARK}{body}</p>")
            elif kind < 0.78:
                parts.append(f"<{(h := self.pick(['h2', 'h3']))}>{MARK}{self.short()}</{h}>")
            elif kind < 0.84:
                parts.append("<ul>" + "".join(f"<li>{MARK}{self.said(1, 1) if self.chance(0.5) else self.short()}</li>" for _ in range(self.between(1, 5))) + "</ul>")
            elif kind < 0.88:
                parts.append(f"<blockquote><p>{MARK}{body}</p></blockquote>")
            elif kind < 0.92:
                parts.append(f"<div>{MARK}{body}</div>")
            elif kind < 0.95:
                parts.append(f"<figure><img src=x><figcaption>{MARK}{self.said(1, 1)}</figcaption></figure>")
            elif kind < 0.97:
                parts.append(f"<pre>{MARK}{body}</pre>")
            else:
                parts.append("<table>" + "".join(f"<tr><td>{MARK}{self.short()}</td><td>{MARK}{self.short()}</td></tr>" for _ in range(self.between(1, 4))) + "</table>")
            if self.chance(0.18):
                parts.append(self.beside(self.pick(["ad", "ad", "side", "form", "share", "notice"])))
            if self.chance(0.02):  # a line that is said over and over
                parts += [f"<p>{MARK}{self.said(1, 1)}</p>"] * self.between(3, 30)
            if self.chance(0.1):
                parts.append(f"<p><b>{MARK}{self.said(1, 1)}<br><p>{MARK}{self.said(1, 2)}")
        return "".join(parts)

    def page(self) -> str:
        title = self.said(1, 1)[:60]
        head = f"<h1>{MARK}{title}</h1>" if self.chance(0.85) else ""
        form = self.between(0, 9)
        if form <= 4:
            core = self.named("article", "main", head + self.main()) if form else f"<article>{head}{self.main()}</article>"
        elif form <= 5:
            core = self.named("main", "main", head + self.main())
        else:
            core = self.named(self.pick(["div", "div", "section", "td"]), "main", head + self.main(), self.chance(0.7))
        if self.chance(0.15):
            core = f"<main>{core}</main>"
        before = [self.beside(k) for k in ("notice", "head", "nav", "nav", "form", "ad", "side", "ad") if self.chance(0.35 if k != "nav" else 0.5)]
        after = [self.beside(k) for k in ("share", "ad", "side", "comments", "side", "form", "nav", "notice") if self.chance(0.3 if k != "comments" else 0.5)]
        if self.chance(0.85):
            after.append(self.beside("foot"))
        inner = "".join(before) + core + "".join(after)
        for _ in range(self.between(0, 2)):
            inner = f'<div class="{self.pick(["wrapper", "container", "page", "site", "layout", "row", "outer", "q7x"])}">{inner}</div>'
        return f"<!DOCTYPE html><html><head><title>{title}</title><script>var a='</p>';</script></head><body>{inner}" + ("</body></html>" if self.chance(0.9) else "")

    def labelled(self) -> tuple[list[Block], np.ndarray]:
        found = blocks(self.page())
        labels = np.array([MARK in b.text for b in found])
        return [b._replace(text=b.text.replace(MARK, "") or "x") for b in found], labels


def trained(sample: Sequence[str], *, made: int = 800, seed: int = 5) -> Labeller:
    """A labeller fitted on the sampled pages that declare their main text, and on ``made`` pages of other layouts with their words."""
    own = [(found, labels) for found in map(blocks, sample) if found and (labels := declared(found)) is not None]
    maker = Maker([b.text for found, labels in own for b, main in zip(found, labels, strict=True) if main], seed)
    rows = 2 * own + [row for _ in range(made) if (row := maker.labelled())[0]]
    return Labeller().fit([described(found) for found, _ in rows], [labels for _, labels in rows])


def extracted(labeller: Labeller, pages: Sequence[str]) -> list[str]:
    """Main text of each page: blocks with odds over one, in page order, joined by a space."""
    found = [blocks(page) for page in pages]
    scores = labeller.scores([described(f) for f in found])
    return [" ".join(b.text for b, s in zip(f, score, strict=True) if s > 0) for f, score in zip(found, scores, strict=True)]


def extract(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", sample: int = 512, sample_chars: int = 200_000, made: int = 800) -> DataFrame:
    """One row per page: id, url, text (main text, empty if none), n_chars.

    The labeller is trained here, on those of ``sample`` different pages of the table at most (the smallest hashes of their html,
    of up to ``sample_chars`` code points) that declare their main text by an article or main element, and on ``made``
    pages of other layouts that are put together from their words. It then reads every page whole. Only pages with a hash
    below a bound, some more than ``sample``, are ordered to find these.

    Null or empty html, or a page without text: empty text. Null ids and urls pass through. Repeated rows: a row each.
    Broken markup is read as far as it goes. Long pages: a state and a vector per block. Empty table: empty result.
    Other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), text_of(html_col).alias("html"))
    fit = F.length("html").between(1, sample_chars)
    share = (4 * sample + 100) / max(1, rows.where(fit).count())
    draw = F.pmod(F.xxhash64("html"), F.lit(1 << 32))
    drawn = rows.where(fit & (draw < int(min(1.0, share) * 2**32))).select(draw.alias("draw"), "html").distinct()
    labeller = trained([r["html"] for r in drawn.orderBy("draw", "html").limit(sample).collect()], made=made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            held: list[str] = []
            for page in batch.column("html"):
                held.append(page.as_py())
                if sum(map(len, held)) > 1 << 20 or len(texts) + len(held) == batch.num_rows:
                    texts += extracted(labeller, held)
                    held = []
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], names=["id", "url", "text"])

    kind = pages.select(id_col).schema[0].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))

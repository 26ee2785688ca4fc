"""HTML extraction: tag soup, gradients of the network, accuracy on held-out pages, and edge rows."""

import html
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm.test_operators import CLASH
from tidemark.llm import labeller
from tidemark.llm.blocks import blocks


@pytest.fixture(scope="module")
def pages():
    return pd.read_parquet(f"{SF}/pages.parquet")


@pytest.fixture(scope="module")
def fitted(pages):
    return labeller.trained(list(pages.html[: len(pages) // 2]), made=1000)


def texts(page):
    return [b.text for b in blocks(page)]


def test_blocks_of_broken_pages():
    assert texts("<p>a<b>b</b> c<br>d&nbsp;&lt;x&gt; &amp e<p>f") == ["ab c d\xa0<x> & e", "f"]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table>d") == ["a", "b", "c", "d"]
    assert texts('<script>var a="<p>no</p>"</script><style>p{}</style>x<!-- <p>no --> y<!--z') == ["x y"]
    assert texts("<head><title>t</title><p>in a head that isn't closed</head>") == ["in a head that isn't closed"]
    assert texts('<a title="a > b">in</a> < 3 <3 <a') == ["in < 3 <3"]
    assert texts("<textarea><b>raw</b></textarea>") == ["<b>raw</b>"]
    assert texts("</div></p>\x00<div \t\n") == ["\x00"]
    assert texts("") == texts("<") [:0] == texts("<!-- ") == []


@pytest.mark.parametrize("page", ["<div>" * 30_000 + "x" + "</b>" * 30_000, '<a "' * 50_000, '<a "x>' * 50_000, "<" * 200_000, "<ul>" + "<li>x" * 30_000, "".join(f"<div class=k{i}>x" for i in range(3000))])
def test_blocks_take_linear_time(page):
    assert isinstance(blocks(page), list)


def test_gradients_are_those_of_the_loss():
    maker = labeller.Maker(["One two. Three four five. Six seven eight nine ten"], 1)
    rows = [maker.labelled() for _ in range(3)]
    described, labels = [labeller.described(f) for f, _ in rows], [y.astype(np.float32) for _, y in rows]
    net = labeller.Labeller(hidden=5)

    def loss():
        scores = np.concatenate(net.scores(described)).astype(float)
        y = np.concatenate(labels)
        return float(np.mean(np.log1p(np.exp(-np.where(y > 0, scores, -scores)))))

    grads = net._gradients(described, labels)
    for name, tensor in (("out", net.out), ("0x", net.ways[0].weights["x"]), ("1h", net.ways[1].weights["h"]), ("paths", net.paths), ("words", net.words)):
        at = np.unravel_index(np.abs(grads[name]).argmax(), tensor.shape)
        old = tensor[at]
        tensor[at] = old + 0.02
        up = loss()
        tensor[at] = old - 0.02
        assert (up - loss()) / 0.04 == pytest.approx(float(grads[name][at]), rel=0.05, abs=1e-4)
        tensor[at] = old


def test_stretches_of_long_pages_are_read_as_one(fitted, monkeypatch):
    maker = labeller.Maker(["One two three four. Five six seven"], 2)
    one = labeller.described(blocks("".join(maker.page() for _ in range(20))))
    whole = fitted.scores([one])[0]
    monkeypatch.setattr(labeller, "STRETCH", 64)
    assert len(whole) > 200 and np.allclose(fitted.scores([one])[0], whole, atol=1e-3)


def main_text(page):
    """What stands in the article element of the synthetic pages, by a plain pattern."""
    inner = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
    parts = [html.unescape(re.sub(r"</?b>", "", p)) for p in re.split(r"<(?!/?b>)[^>]*>", inner)]
    return " ".join(q for p in parts if (q := re.sub(r"[\x20\x09-\x0D]+", " ", p).strip(" ")))


def test_held_out_pages_of_the_table_are_extracted_whole(pages, fitted):
    held = list(pages.html[len(pages) // 2 :])
    assert labeller.extracted(fitted, held) == [main_text(p) for p in held]


def test_held_out_pages_of_other_layouts(pages, fitted):
    maker = labeller.Maker([main_text(p) for p in pages.html], 77)
    rows = [maker.labelled() for _ in range(150)]
    wrong = sum(int(((s > 0) != y).sum()) for s, (_, y) in zip(fitted.scores([labeller.described(f) for f, _ in rows]), rows))
    assert wrong <= 0.02 * sum(len(y) for _, y in rows)


def test_a_page_with_everything_beside_the_article(fitted):
    beside = {
        "menu": '<nav class="main-menu"><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav>',
        "notice": '<div class="cookie-notice">We use cookies to improve your experience. <button>Accept</button></div>',
        "advert": '<div class="advertisement"><p>Buy our fine things today, for less than ever before.</p></div>',
        "form": '<form class="newsletter"><label>Your email</label><input><button>Subscribe</button></form>',
        "sidebar": '<aside class="sidebar"><h3>Most popular</h3><ul><li><a href=/a>Another story</a></li></ul></aside>',
        "comments": '<section class="comments"><h3>2 comments</h3><div class="comment"><b>Ann</b><p>I read this with joy, and I agree.</p></div><div class="comment"><b>Bob</b><p>I do not agree at all.</p></div></section>',
        "footer": "<footer>&copy; 2024 All rights reserved.</footer>",
    }
    body = ["The title of the story", "It was a long day, and nobody had seen the sun. Then it came.", "People went out, and they said that it was warm.", "In the end they went home."]
    article = f'<article class="post"><h1>{body[0]}</h1><p>{body[1]}</p>{beside["advert"]}<p>{body[2]}</p><p>{body[3]}</p></article>'
    page = f'<html><head><title>x</title></head><body><header class="site-header"><a href=/>The paper</a></header>{beside["menu"]}{beside["notice"]}{article}{beside["form"]}{beside["comments"]}{beside["sidebar"]}{beside["footer"]}</body></html>'
    assert labeller.extracted(fitted, [page]) == [" ".join(body)]


def test_edge_rows(spark, pages):
    rows = [(i, "u", p) for i, p in enumerate(pages.html[:40])] + [(50, None, None), (51, "u", ""), (None, "u", pages.html[0]), (0, "u", pages.html[0]), (52, "u", "<p>" * 4000), (53, "u", "<article>" + "<p>A sentence of it.</p>" * 9000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit("x").alias(c) for c in CLASH])
    out = labeller.extract(df, made=150, sample=30).collect()
    assert sorted(str(r.page_id) for r in out) == sorted(str(r[0]) for r in rows)
    found = {r.page_id: r for r in out}
    assert [(found[k].text, found[k].n_chars) for k in (50, 51, 52)] == [("", 0)] * 3
    assert found[50].url is None and found[None].text == found[0].text != ""
    assert all(r.n_chars == len(r.text) for r in out)
    assert labeller.extract(df.limit(0), made=5).count() == 0

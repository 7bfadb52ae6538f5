import html as entities
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from commitlens.llm import html
from commitlens.llm.html import Labeller, Settings, blocks, label, laid_out, layout_label, main_text, padded, train
from commitlens.llm.q_html import op8_html

from .helpers import FOLDER

S = Settings()


@pytest.fixture(scope="module")
def pages(spark):
    return {r.page_id: r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}


@pytest.fixture(scope="module")
def net(pages):
    return train([pages[i] for i in sorted(pages)], S)


def article(page):
    """Text of the one article of a generated page, cut by regular expressions."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:h1|p)\b[^>]*>", inner)
    flat = [" ".join(entities.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", p))).split()) for p in parts]
    return "\n".join(p for p in flat if p)


def test_blocks():
    page = "<!DOCTYPE html><head><title>T</title><style>p{}</style></head><body class='a b-c'><!-- no <p>x</p> --><p>one <b>two\n&amp;&nbsp;3<br>4<p>five</b><div id=x>six<script>var s='</p>'</script> seven</div>a < b"
    assert [t for _, t in blocks(page)] == ["one two & 3 4", "five", "six", "seven", "a < b"]
    assert blocks(page)[0][0] == ("body a b c", "p", "b")
    assert blocks("") == [] and blocks("<p>") == [] and blocks("plain") == [((), "plain")]
    assert [t for _, t in blocks("<p>x<script>never ends")] == ["x"]


@pytest.mark.parametrize(
    "page,texts",
    [
        ("<p>a</p><svg class='i'/><p>b</p><svg><path d='x'/></svg><p>c</p>", ["a", "b", "c"]),
        ("<p>a <math/> b</p><p>c</p>", ["a b", "c"]),
        ("<p>a</p><object data=x><p>b</p>", ["a", "b"]),
        ("<p>a</p><template><p>b</p><template><p>c</p></template><p>d</p></template><p>e</p>", ["a", "b", "c", "d", "e"]),
        ("<p>a</p><template><p>b</p>", ["a", "b"]),
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><p>b</p>", ["so x=2 holds", "b"]),
        ("<svg><title/><rect/><p>a</p><svg><svg><g></svg><p>b</p>", ["a", "b"]),
        ("<svg><foreignObject><p>a</p></foreignObject></svg><p>b</p>", ["a", "b"]),
        ("<p>a</p><noscript><p>b</p></noscript><textarea><p>no</p></textarea><iframe><p>no</p></iframe><p>c</p>", ["a", "b", "c"]),
    ],
)
def test_no_element_but_raw_text_is_passed_over(page, texts):
    found = blocks(page)
    assert [t for _, t in found] == texts
    assert not {"svg", "math"} & {e.split(" ")[0] for e in found[-1][0]}


def test_gradients_against_differences():
    s = Settings(hidden=3, path_bits=4, word_bits=2)
    net = Labeller(6, s)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(1)
    x, lengths = padded([rng.standard_normal((n, 6)) for n in (4, 2, 1)])
    y = rng.integers(0, 2, x.shape[:2]).astype(float)
    _, grads = net.gradients(x, y, lengths)
    for k, at in [("wf", (2, 5)), ("wb", (7, 3)), ("bf", (4,)), ("bb", (1,)), ("v", (2,)), ("c", (0,)), ("wf", (6, 1))]:
        change = []
        for d in (1e-3, -1e-3):
            net.p[k][at] += d
            change.append(net.gradients(x, y, lengths)[0])
            net.p[k][at] -= d
        assert grads[k][at] == pytest.approx((change[0] - change[1]) / 2e-3, abs=2e-3)


def test_held_out_layouts(net, pages):
    rng = np.random.default_rng(99)
    texts = [t for i in sorted(pages) for _, t in blocks(pages[i]) if len(t) > 20]
    right = total = 0
    for _ in range(150):
        page = laid_out(texts, rng)
        start = html._open_path(page[: page.index(">", page.index(" data-main=")) + 1])
        p = blocks(page)
        want = [layout_label(path, start) for path, _ in p]
        right += sum(a == b for a, b in zip(label(net, [p], S)[0], want, strict=True))
        total += len(want)
    assert right / total >= 0.95, right / total


def test_query_finds_the_article_of_every_page(spark, pages):
    rows = op8_html(spark, FOLDER).collect()
    assert {r.page_id: r.text for r in rows} == {i: article(p) for i, p in pages.items()}
    assert all(r.n_chars == len(r.text) for r in rows)


def test_fitted_on_other_pages(spark, net):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    parsed = [blocks(r.html) for r in rows]
    texts = ["\n".join(t for (_, t), m in zip(p, ms, strict=True) if m) for p, ms in zip(parsed, label(net, parsed, S), strict=True)]
    assert texts == [article(r.html) for r in rows]


def test_nulls_repeats_and_clashing_columns(spark, pages):
    rows = [(1, pages[0]), (1, pages[0]), (2, None), (3, ""), (None, "<nav>x</nav>"), (4, "<article>" + "<p>word and more.</p>" * 3000 + "</article>")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("own"))
    small = Settings(layouts=64, rounds=4)
    found = main_text(df, settings=small)
    assert found.columns == ["page_id", "text", "text_", "n_chars"]
    by = {r.page_id: r for r in found.collect()}
    assert by[2].text_ == by[3].text_ == "" and by[2].n_chars == 0 and found.count() == 6
    assert main_text(df.limit(0), settings=small).count() == 0

import itertools
import math
import random

from parchment.llm import html_extract as H
from parchment.llm.html_pages import labelled_pages


def test_marginals_against_enumeration():
    rng = random.Random(1)
    for _ in range(20):
        page = H.Page()
        page.add(-1, ("", ()))
        for k in range(1, 7):
            page.add(rng.randrange(k), ("div", ()))
        model = H.TreeModel(psi=[[0.3, rng.uniform(-2, 2)], [rng.uniform(-2, 2), rng.uniform(-2, 2)]])
        own = [rng.uniform(-2, 2) for _ in page.parent]
        model.own = lambda _, k, own=own: own[k]
        full = model.messages(page)[2]
        mass = [[0.0, 0.0] for _ in own]
        for y in itertools.product((0, 1), repeat=len(own)):
            w = math.exp(sum(o * v for o, v in zip(own, y)) + sum(model.psi[y[page.parent[k]]][y[k]] for k in range(1, len(y))))
            for k, v in enumerate(y):
                mass[k][v] += w
        assert all(abs(math.log(m[1] / m[0]) - f) < 1e-9 for m, f in zip(mass, full))


def test_held_out_accuracy():
    model, right, total = H.default_model(), 0, 0
    for s in labelled_pages(150, seed=12345):
        p = H.parse(s)
        for g, t, f in zip(p.gold, p.texts, model.messages(p)[2]):
            if t is not None:
                total += 1
                right += g == (f >= 0)
    assert right / total > 0.97


def text(source):
    return H.default_model().extract(H.parse(source))


def test_extraction():
    page = (
        '<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";if(a<b){x="\'"}</script></head><body><nav><ul><li><a href="/a">A</a></li></ul></nav>'
        '<!-- ad --><div class="ad">Buy this now.</div><article><h1>A &amp; B&nbsp;c</h1><p><b>One   two\nthree.<br>four<p title=it\'s>Fish &lt;3 &eacute;</p>'
        '<script>document.write("<p>no</p><script>")</script></article><aside class="sidebar"><p>Other things to see here.</p></aside><section class="comments"><p>I like this.</p></section><footer>&copy; x</footer>'
    )
    assert text(page) == "A & B c\n\nOne two three. four\n\nFish <3 é"
    assert text(page + "</body></ht") == text(page)
    assert text("just words") == "just words"
    assert text(None) == text("") == text("<") .replace("<", "") == ""
    assert H.parse("<p a='" + "x" * 100_000).texts.count(None) >= 1
    assert text("<article>" + "<p>long text of words. " * 5000).count("\n\n") == 4999


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<article><h1>Hello there</h1><p>The story goes on for long.</p></article>"), (3, "u", "<article><h1>Hello there</h1><p>The story goes on for long.</p></article>")], "page_id bigint, url string, html string")
    got = sorted((r.page_id, r.text) for r in H.extract_text(df).collect())
    assert got == [(1, ""), (2, "")] + [(3, "Hello there\n\nThe story goes on for long.")] * 2
    assert H.extract_text(df.limit(0)).count() == 0

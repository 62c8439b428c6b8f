"""The queries of the trained models against plain versions of what the models say."""

import itertools
import math
import random
import zlib

import numpy as np

from parchment.llm import html_extract as H
from parchment.llm import queries as Q
from parchment.llm import toxicity as T


def pairwise(model, text):
    """The machine's formula as it is written: every term, and every pair of terms."""
    place = {int(t): k for k, t in enumerate(model.terms)}
    at = sorted({place[t] for w in T.text_words(text) for t in T.word_terms(w) if t in place})
    z = model.w0 + sum(float(model.w[i]) for i in at)
    z += sum(float(np.dot(model.v[i].astype(float), model.v[j].astype(float))) for i, j in itertools.combinations(at, 2))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def test_toxicity_query_equals_the_pairwise_sum(spark, tmp_path):
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdefghik") for _ in range(rng.randint(3, 7))) for _ in range(200)]
    rows, labels = [], []
    for d in range(240):
        words = [rng.choice(vocab) for _ in range(rng.randint(3, 30))]
        toxic = d % 3 == 0
        if toxic:
            words += ["Vermin", "those"] if d % 2 else ["scum", "those"]
        elif d % 5 == 0:
            words += ["those"]
        rows.append((d, " ".join(words)))
        labels.append((d, int(toxic)))
    rows += [(900, None), (901, ""), (902, "vermin those " * 20_000), (903, rows[3][1]), (903, rows[3][1]), (None, "scum those")]
    labels += [(5, None), (7, 0), (7, 1)]  # no label, and one of each
    docs = spark.createDataFrame([(d, t, "zz", 0.5, 1) for d, t in rows], "doc_id bigint, text string, lang string, score double, predicted int")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    known = spark.createDataFrame([(d, 0, y) for d, y in labels], "doc_id bigint, quality int, toxic int")
    known.write.parquet(f"{tmp_path}/labels.parquet")
    model = T.train(docs, known.select("doc_id", "toxic").filter(~T.held_out()))
    got = Q.QUERIES["op2_toxicity"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and len(model.terms) > 2
    texts = {}
    for d, t in rows:
        texts.setdefault(d, t)
    for r in got:
        assert abs(r.score - pairwise(model, texts[r.doc_id])) < 1e-5
        assert r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    assert all(r.predicted for r in got if r.doc_id == 902) and sum(r.predicted for r in got) > 60


def test_counted_terms_are_those_of_all_rows_in_memory(spark):
    """What Spark chooses by its counts is what the same rows give in one place."""
    rng = random.Random(7)
    rows = [(d, " ".join(rng.choice(["aa", "bb", "cc", "dd", "ee", "ff"]) for _ in range(5)) + (" bad" if d % 2 else " good")) for d in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(d, d % 2) for d, _ in rows], "doc_id bigint, toxic int")
    data = [(np.unique(np.array([t for w in T.text_words(x) for t in T.word_terms(w)], np.uint64)), d % 2) for d, x in rows]
    for most in (20_000, 3):
        model = T.train(docs, labels, max_terms=most)
        assert model.terms.tolist() == T.chosen(data, most, T.MIN_CHI2).tolist() and len(model.terms)


def best_text(page, model):
    """The text runs whose content is the likelier state, over all labellings of the tree."""
    n = len(page.parent)
    own = [model.own(page, k) for k in range(n)]
    mass = [[0.0, 0.0] for _ in range(n)]
    for y in itertools.product((0, 1), repeat=n):
        w = math.exp(sum(o * v for o, v in zip(own, y)) + sum(model.psi[y[page.parent[k]]][y[k]] for k in range(1, n)))
        for k, v in enumerate(y):
            mass[k][v] += w
    return "\n\n".join(t for t, m in zip(page.texts, mass) if t is not None and m[1] >= m[0])


def test_html_query_equals_enumeration(spark, tmp_path):
    rng = random.Random(8)
    parts = ["<p>A story that goes on for a good while, as stories do.</p>", "<nav><a href=x>Home</a></nav>", "<div class=ad>Buy now</div>", "<h1>Title &amp; more</h1>", "<footer>c 2020</footer>", "<article><p>One  more\nline of it here.</p></article>", "<form>Name</form>", "loose words"]
    rows = [(i, f"http://u/{i}", "".join(rng.choice(parts) for _ in range(rng.randint(0, 4)))) for i in range(40)] + [(90, None, None), (91, "u", ""), (91, "u", "<p>x"), (None, "u", "<p>y z</p>")]
    spark.createDataFrame([(*r, "old") for r in rows], "page_id bigint, url string, html string, text string").write.parquet(f"{tmp_path}/pages.parquet")
    model = H.default_model()
    want = [(i, u, t := best_text(H.parse(h or ""), model), len(t)) for i, u, h in rows]
    got = Q.QUERIES["op8_html_extract"](spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and sum(n > 0 for *_, n in want) > 20

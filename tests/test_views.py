"""Marks, places, lists, caches and folds against plain Python."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from parchment.functions import fold as folding, nearest as N
from parchment.operators import highlights as H, keywords as K, result_list as R
from parchment.operators.keyword_cache import KeywordCache, toggled


def find_in_context(context, token, start, end):
    low, own = context.lower(), token.lower()
    inside = start >= 0 and end <= len(context) and start < end
    if inside and low[start:end] == own:
        return start, end
    places = [i for i in range(len(low)) if own and low.startswith(own, i)]
    if places:
        best = min(places, key=lambda i: (abs(i - start), i))
        return best, best + len(token)
    return (start, end) if inside else None


def find_in_span(text, token, hint):
    low, own = text.lower(), token.lower()
    places = [i for i in range(len(low)) if own and low.startswith(own, i)]
    if places:
        best = min(places, key=lambda i: (abs(i - hint), i))
        return best, best + len(token)
    keep = [i for i, c in enumerate(low) if not c.isspace()]
    bare, want = "".join(low[i] for i in keep), re.sub(r"\s", "", own)
    if want and want in bare:
        at = bare.index(want)
        return keep[at], keep[at + len(want) - 1] + 1
    return (hint, hint + len(token)) if hint >= 0 and hint + len(token) <= len(text) else None


def test_places_equal_the_plain_rules(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(400):
        text = "".join(rng.choice("abA \n") for _ in range(rng.randint(0, 14)))
        token = "".join(rng.choice("ab A") for _ in range(rng.randint(0, 3)))
        start = rng.randint(-3, 16)
        rows.append((text, token, start, start + rng.randint(-1, 4)))
    df = spark.createDataFrame(rows, "t string, k string, s int, e int")
    got = df.select("t", "k", "s", "e", N.match_in_context(*map(F.col, "tkse")).alias("a"), N.token_in_span(F.col("t"), F.col("k"), F.col("s")).alias("b")).collect()
    for r in got:
        assert (tuple(r.a) if r.a else None) == find_in_context(r.t, r.k, r.s, r.e), r
        assert (tuple(r.b) if r.b else None) == find_in_span(r.t, r.k, r.s), r


def test_keyword_spans(spark):
    docs = spark.createDataFrame([(1, "The model of a Model-based model\nmodels of the of the of the end\nof  the"), (2, "nothing"), (3, None), (4, "İx the model")], "doc_id bigint, text string")
    active = spark.createDataFrame([(1, "model"), (1, "Model"), (1, "of the"), (1, "the of the"), (1, None), (2, "zz"), (4, "model"), (4, "")], "doc_id bigint, term string")
    got = sorted(tuple(r) for r in H.keyword_spans(docs, active).collect())
    want = [(1, 1, 0, 4, 9, "model"), (1, 1, 0, 27, 32, "model"), (1, 1, 1, 7, 13, "of the"), (1, 1, 1, 14, 20, "of the"), (1, 1, 1, 21, 27, "of the"), (1, 1, 1, 10, 20, "the of the"), (4, 1, 0, 7, 12, "model")]
    assert got == sorted(want)
    assert H.keyword_spans(docs, active.limit(0)).count() == 0


def plain_list(matches):
    pages = {}
    for g, (page, name) in enumerate(matches):
        pages.setdefault(page, []).append((g, name))
    rows, top = [], 0
    for page, found in pages.items():
        rows.append(("header", page, len(found), None, None, top, 28))
        top += 28
        for g, name in found:
            rows.append(("result", page, None, g, name, top, 56))
            top += 56
    return rows


def plain_view(rows, top, view):
    start = next((i for i, r in enumerate(rows) if r[5] + r[6] > top), 0)
    start = max(0, start - 10)
    end = next((i for i in range(start, len(rows)) if rows[i][5] > top + view), len(rows))
    return rows[start : min(len(rows), end + 10)]


def test_lists_and_windows(spark):
    rng = random.Random(3)
    data, every = {}, []
    for d in range(6):
        pages = sorted(rng.randint(1, 9) for _ in range(d * 12))
        data[d] = [(p, f"{p}-{k}") for k, p in enumerate(pages)]
        every += [(d, p, k, 0, 0, 0, name, "x") for k, (p, name) in enumerate(data[d])]
    df = spark.createDataFrame(every, "doc_id bigint, page int, item_index int, term_ord int, tier int, char_start int, id string, label string").repartition(4)
    cols = ["kind", "page", "n", "global_index", "id", "top", "height"]
    lists = R.list_rows(df).orderBy("doc_id", "row_no").collect()
    for d, matches in data.items():
        assert [tuple(r[c] for c in cols) for r in lists if r.doc_id == d] == plain_list(matches)
    for top, view in ((0, 0), (0, 300), (500, 300), (2000, 1000), (99_999, 10)):
        got = R.visible(R.list_rows(df), top, view).orderBy("doc_id", "row_no").collect()
        for d, matches in data.items():
            assert [tuple(r[c] for c in cols) for r in got if r.doc_id == d] == plain_view(plain_list(matches), top, view)
    now = spark.createDataFrame([(0, -1, 0), (1, 2, 5), (2, 2, 99), (3, 0, -4), (9, -1, 3)], "doc_id bigint, at bigint, wanted bigint")
    assert {r.doc_id: (r.at, r.page) for r in R.go_to(df, now).collect()} == {0: (-1, None), 1: (5, data[1][5][0]), 2: (2, data[2][2][0]), 3: (0, data[3][0][0]), 9: (-1, None)}


def test_kept_index(spark):
    before = spark.createDataFrame([(1, "a,b", 5, 4), (2, "a,b", 5, 4), (3, "a", 5, 4), (4, "a,b", 0, -1), (5, "a,b", 3, -1)], "doc_id bigint, terms string, n bigint, at bigint")
    after = spark.createDataFrame([(1, "a,b", 9), (2, "a,b", 3), (3, "a,b", 9), (4, "a,b", 2), (5, "a,b", 0), (6, "a,b", 2)], "doc_id bigint, terms string, n bigint")
    got = {r.doc_id: (r.again, r["at"]) for r in R.kept_index(before, after).collect()}
    assert got == {1: (True, 4), 2: (True, 0), 3: (False, 0), 4: (False, 0), 5: (True, -1), 6: (False, 0)}


def test_fold_map_leads_back(spark):
    texts = ["Café ﬁle ½", "각가 힣", "ǅ İx ﷺ", "", "éá", "ＡＢＣ ㎏", "plain"]
    got = {r.t: r.m for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", folding.fold_map(F.col("t")).alias("m")).collect()}
    for t in texts:
        pieces = ["".join(x for x in unicodedata.normalize("NFD", unicodedata.normalize("NFKC", c)) if not "̀" <= x <= "ͯ") for c in t]
        raw = "".join(pieces)
        assert len(got[t].at) == len(got[t].folded) and got[t].folded == raw.lower() or "İ" in t
        if "İ" not in t:
            assert got[t].at == [i for i, p in enumerate(pieces) for _ in p]


def test_cached_keywords(spark, tmp_path):
    rng = random.Random(5)
    vocab = ["model", "graph", "network", "learning", "neural", "token", "search"]
    text = lambda: "\n".join(" ".join(rng.choice(vocab) for _ in range(8)) for _ in range(4))
    rows = {i: text() for i in range(6)} | {7: None}
    frame = lambda: spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
    cache, algorithms = KeywordCache(spark, str(tmp_path / "kw")), ("tfidf", "ngram")
    same = lambda: sorted(map(str, map(tuple, cache.lists(algorithms).collect()))) == sorted(map(str, map(tuple, K.keywords(frame(), algorithms).collect())))
    assert cache.refresh(frame(), algorithms) == 14 and same()
    assert cache.refresh(frame(), algorithms) == 0
    rows[2], rows[9] = text(), text()
    del rows[4]
    assert cache.refresh(frame(), algorithms) == 6 and same()  # one changed, one new, one gone
    made = spark.read.parquet(str(tmp_path / "kw/lists/run=2")).select("doc_id").distinct().collect()
    assert {r.doc_id for r in made} == {2, 9}
    rows[4] = text()
    assert cache.refresh(frame(), algorithms) == 2 and same()
    on = spark.createDataFrame([(1, "a"), (1, "b")], "doc_id bigint, term string")
    flip = spark.createDataFrame([(1, "a"), (1, "c"), (2, "d"), (2, "d"), (1, "b"), (1, "b")], "doc_id bigint, term string")
    assert sorted(map(tuple, toggled(on, flip).collect())) == [(1, "b"), (1, "c")]


def test_matches_by_page_are_headers_and_their_matches(spark):
    """Every match has its row and global index, not only its page's count."""
    import __spark_entry__

    d = "/root/testdata/sf0.001"
    rows = __spark_entry__.queries()["matches_by_page"](spark, d).collect()
    matches = {(r.doc_id, r.page, r.id, r.label) for r in __spark_entry__.queries()["search_terms"](spark, d).select("doc_id", "page", "id", "label").collect()}
    results = [r for r in rows if r.kind == "result"]
    assert len(results) == len(matches) and {(r.doc_id, r.page, r.id, r.label) for r in results} == matches
    by_doc: dict = {}
    for r in sorted(results, key=lambda r: r.global_index):
        by_doc.setdefault(r.doc_id, []).append(r)
    for own in by_doc.values():
        assert [r.global_index for r in own] == list(range(len(own)))
        assert [r.header for r in own] == sorted(r.header for r in own)
    for h in (r for r in rows if r.kind == "header"):
        assert h.n == sum(r.page == h.page for r in by_doc[h.doc_id]) and h.first_page == (h.header == 1)


def test_keyword_spans_hold_few_pages_at_a_time():
    """A batch of pages gives its rows in pieces, each from a hundred pages."""
    import pyarrow as pa

    n = 1050
    items = pa.array([[{"item_index": 0, "text": "a graph", "start": 0, "end": 7}]] * n)
    cols = [pa.array(range(n), pa.int64()), pa.array([1] * n, pa.int32()), items, pa.array([[0, 2]] * n, pa.list_(pa.int32())), pa.array([[1, 7]] * n, pa.list_(pa.int32())), pa.array([["graph"]] * n)]
    out = list(H._run(iter([pa.RecordBatch.from_arrays(cols, names=["doc_id", "page", "items", "starts", "ends", "terms"])])))
    assert max(b.num_rows for b in out) <= 100 and sum(b.num_rows for b in out) == n
    assert out[0].slice(0, 1).to_pylist() == [{"doc_id": 0, "page": 1, "item_index": 0, "start": 2, "end": 7, "term": "graph"}]

"""Terms are found over batches as the expressions of single tiers find them, in one pass over the documents."""

import unicodedata

from pyspark.sql import functions as F

from parchment.functions import fold as folding
from parchment.functions import text as T
from parchment.operators import search as S
from parchment.operators import token_hits as H
from parchment.sources.tables import pages

TEXTS = [
    "The thing, things and THINGS of the think-tank; thinging\nthin king of\nthe ﬁne thíng", "Çedilla çedillas cedilla's ǅ Straße İstanbul Σίσυφος", "각하 가하 각각 ｆｕｌｌ １２ ½",
    "t hing th-ing\nno match", "𐐀𐐨 thing 𝔘x '-thing-'s", "", None, "bies dies does passes boxes red bred sing king", "thing " * 300, "of\n\n\n\n\nthe\nof the of the",
]
TERMS = ["thing", "of the", "cedilla", "box", "king", "fine", "각하"]


def frame(spark):
    return spark.createDataFrame([(None if k == 4 else k, t) for k, t in enumerate(TEXTS)], "doc_id bigint, text string")


def rows(df):
    return sorted(map(str, map(tuple, df.select("doc_id", "page", "start", "matched", "char_start", "char_end", "spans").collect())))


def test_each_tier_as_its_expressions(spark):
    pg = S.with_tokens(pages(frame(spark))).cache()
    plain = pg.drop("toks")
    stem = lambda t: folding.stem(folding.fold(t))
    for q in TERMS[:4]:
        got = S.token_tiers(plain, [(0, q)]).cache()
        assert rows(got) == rows(S.token_tiers(pg, [(0, q)]))
        words = q.split()
        assert rows(got.filter("tier = 1")) == rows(S.match_runs(pg, words, folding.fold)) and got.count()
        assert rows(got.filter("tier = 2")) == rows(S.match_runs(pg, [H.stem(w) for w in words], stem))
        assert rows(got.filter("tier = 0")) == rows(S.exact(pg, q))
        k = folding.hangul_grown(folding.fold(F.col("t.token")))
        close = pg.select("doc_id", "page", F.explode("toks").alias("t")).filter((k != q) & (F.levenshtein(k, F.lit(q)) <= (1 if len(q) <= 7 else 2))).count()
        assert len(words) > 1 or len(q) < 4 or got.filter("tier = 3").count() == close


def test_fallback_only_without_an_exact_hit(spark):
    got = {(r.doc_id, r.start) for r in S.search_document(frame(spark), "thing").filter("tier = 0").collect()}
    texts = {None if k == 4 else k: (t or "").lower() for k, t in enumerate(TEXTS)}
    assert (3, 0) in got and (3, 7) in got  # t hing, th-ing
    assert (0, 4) in got and not any(texts[d][s : s + 5] != "thing" for d, s in got if d == 0)


def test_one_scan_and_one_exchange(spark, tmp_path):
    frame(spark).write.parquet(f"{tmp_path}/d")
    found = S.search_terms(spark.read.parquet(f"{tmp_path}/d"), [(t, "", t) for t in TERMS[:6]])
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Scan parquet") == 1 and plan.count("Exchange ") == 1 and plan.count("MapInArrow") == 1


def test_texts_fold_as_the_expressions_do(spark):
    words = sorted({w for t in TEXTS if t for w in t.split()} | {chr(n) for n in range(0xA0, 0x3400, 7) if unicodedata.category(chr(n))[0] in "LN"})
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r.w: (r.k, r.g) for r in df.select("w", folding.fold(F.col("w")).alias("k"), F.length(folding.hangul_grown(folding.fold(F.col("w")))).alias("g")).collect()}
    assert got == {w: (folding.fold_text(w), len(folding.hangul_grown_text(folding.fold_text(w)))) for w in words}
    low = {r.w: r.k for r in df.select("w", F.lower("w").alias("k")).collect()}
    assert low == {w: w.lower() for w in words}


def test_placed_tokens(spark):
    df = frame(spark).filter("text is not null")
    assert df.filter(H.placed_tokens(F.col("text")) == T.tokens(F.col("text"))).count() == df.count()


def test_fold_map_takes_no_character_alone_through_expressions(spark):
    odd = "aÉﬁ½각가İΣ𐐀́ǅ"
    texts = [odd * 20_000, "", None, odd]
    m = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", folding.fold_map(F.col("t")).alias("m")).select("k", "m.folded", "m.at")
    assert "lambda" not in m._jdf.queryExecution().optimizedPlan().toString()
    own = [folding.fold_char(c).lower() for c in odd]
    got = {r.k: (r.folded, r.at) for r in m.collect()}
    assert got[1] == ("", []) and got[2] == (None, None)
    assert got[3] == ("".join(own), [i for i, f in enumerate(own) for _ in f])
    assert got[0][0] == "".join(own) * 20_000 and got[0][1][-1] == len(odd) * 20_000 - 1

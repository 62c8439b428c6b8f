"""Tiered lexical search over pages.

All matching is done inside a page's row by array functions, after a cheap test that drops
pages without the needle, so no tier shuffles the corpus; only matches are exchanged, for the
two rules that look further than a page (the fallback, which needs a document without an
exact hit, and the removal of doubles).

Tiers: 0 exact (for CJK or special characters a substring search), 1 folded, 2 stemmed,
3 fuzzy. A match is (doc_id, page, item_index, start, matched, context, char_start,
char_end, spans, tier); ``start`` counts in the page, char_start in the item (for CJK in the
context).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from parchment.functions import fold as folding
from parchment.functions import text as T
from parchment.functions.fixed_values import PALETTE
from parchment.operators import token_hits
from parchment.sources.tables import pages

CONTEXT = 80
TOKEN = re.compile(r"(?:(?!_)\w)+(?:[-'](?:(?!_)\w)+)*")
FIELDS = ["doc_id", "page", "item_index", "start", "matched", "context", "char_start", "char_end", "spans"]


def query_tokens(q: str) -> list[str]:
    """Tokens of a query. The lookahead form of the token pattern, without marks, which end tokens."""
    import unicodedata

    kept = "".join(c if unicodedata.category(c)[0] in "LN" or c in "-'" else " " for c in q)
    return [t for t in re.findall(r"[^\s\-']+(?:[-'][^\s\-']+)*", kept)]


def query_kind(q: str) -> str:
    """empty, cjk, special or tokens."""
    t = re.sub(f"^{T.BLANK}+|{T.BLANK}+$", "", q)
    return "empty" if not t else "cjk" if re.search(T.CJK, t) else "special" if re.search(T.SPECIAL, t) else "tokens"


def _located(df: DataFrame, start: Column, end: Column, matched: Column | None = None, spans: bool = True) -> DataFrame:
    """Rows of pages with a match from start to end -> FIELDS."""
    hit = T.item_at(F.col("items"), start)
    matched = F.substring("concat", start + 1, end - start) if matched is None else matched
    df = df.withColumn("hit", hit).withColumn("matched", matched)
    size = F.col("hit.end") - F.col("hit.start")
    return df.select(
        "doc_id", "page", F.col("hit.item_index").alias("item_index"), start.cast("int").alias("start"), "matched", F.col("hit.text").alias("context"),
        F.greatest(start - F.col("hit.start"), F.lit(0)).cast("int").alias("char_start"), F.least(size, end - F.col("hit.start")).cast("int").alias("char_end"),
        (T.spans(F.col("items"), start, end) if spans else F.lit(None).cast("array<struct<item_index:int,char_start:int,char_end:int>>")).alias("spans"),
    )


def with_tokens(pg: DataFrame) -> DataFrame:
    """pages with toks, array<struct<token, start, end>>; stored pages have them (``sources.token_store``)."""
    return pg if "toks" in pg.columns else pg.withColumn("toks", T.tokens(F.col("concat")))


def match_runs(pg: DataFrame, keys: list[str], key_of, spans: bool = True) -> DataFrame:
    """Runs of consecutive tokens of a page whose keys equal ``keys``; pg has toks."""
    if not keys:
        keys, pg = [""], pg.limit(0)
    k = len(keys)
    df = pg.withColumn("ks", F.transform("toks", lambda t: key_of(t["token"])))
    n = F.size("ks")
    first = F.when(F.array_contains("ks", keys[0]) & (n >= k), F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))

    def same(i: Column) -> Column:
        out = F.get("ks", i) == keys[0]
        for j in range(1, k):
            out = out & (F.get("ks", i + j) == keys[j])
        return out

    df = df.select("doc_id", "page", "items", "concat", "toks", F.explode(F.filter(first, same)).alias("i"))
    df = df.select("doc_id", "page", "items", "concat", F.get("toks", F.col("i"))["start"].alias("s"), F.get("toks", F.col("i") + k - 1)["end"].alias("e"))
    return _located(df, F.col("s"), F.col("e"), spans=spans)


def special(pg: DataFrame, q: str, case_sensitive: bool = False) -> DataFrame:
    """Substring search in the page text for queries with special characters."""
    hay = F.col("concat") if case_sensitive else F.lower("concat")
    needle = q if case_sensitive else q.lower()
    df = pg.filter(F.contains(hay, F.lit(needle))).select("doc_id", "page", "items", "concat", F.explode(T.places(hay, needle)).alias("s"))
    return _located(df, F.col("s"), F.col("s") + len(needle))


def _stripped_places(pg: DataFrame, needle: str, case_sensitive: bool) -> DataFrame:
    """Places s, e in the page text of the needle in the text without anything but letters and digits."""
    hay = F.col("concat") if case_sensitive else F.lower("concat")
    df = pg.filter(F.contains(T.stripped(hay), F.lit(needle))).withColumn("map", T.stripped_map(hay))
    df = df.withColumn("p", F.explode(T.places(T.stripped(hay), needle)))
    return df.withColumn("s", F.get("map", F.col("p"))).withColumn("e", F.get("map", F.col("p") + len(needle) - 1) + 1).drop("map", "p")


def fallback(pg: DataFrame, q: str, exact: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """Words split by spaces or hyphens, in documents without an exact hit of the single-word query."""
    needle = q if case_sensitive else q.lower()
    df = _stripped_places(pg, needle, case_sensitive).join(exact.select("doc_id").distinct(), "doc_id", "left_anti")
    return _located(df, F.col("s"), F.col("e"))


def broad_context(df: DataFrame) -> DataFrame:
    """Adds first and last, the items around [s, e) grown left then right in turn to CONTEXT characters."""
    sizes = F.transform("items", lambda o: F.length(o["text"]))
    n = F.size("items")
    lo = F.size(F.filter("items", lambda o: o["end"] <= F.col("s")))
    hi = n - 1 - F.size(F.filter("items", lambda o: o["start"] >= F.col("e")))
    lo, hi = F.when(lo >= n, 0).otherwise(lo), F.when(hi < 0, n - 1).otherwise(hi)
    state = lambda a, b, c: F.struct(a.alias("a"), b.alias("b"), c.alias("c"))

    def grow(st: Column, _: Column) -> Column:
        left = F.when((st["c"] < CONTEXT) & (st["a"] > 0), st["a"] - 1).otherwise(st["a"])
        c1 = F.when(left < st["a"], st["c"] + F.get(sizes, left)).otherwise(st["c"])
        right = F.when((c1 < CONTEXT) & (st["b"] < n - 1), st["b"] + 1).otherwise(st["b"])
        return state(left, right, F.when(right > st["b"], c1 + F.get(sizes, right)).otherwise(c1))

    df = df.withColumn("lo", lo.cast("int")).withColumn("hi", hi.cast("int"))
    covered = F.aggregate(F.slice(sizes, F.col("lo") + 1, F.greatest(F.col("hi") - F.col("lo") + 1, F.lit(0))), F.lit(0), T.add)
    grown = F.aggregate(F.sequence(F.lit(1), n), state(F.col("lo"), F.col("hi"), covered), grow)
    return df.withColumn("grown", grown).withColumn("first", F.col("grown.a")).withColumn("last", F.col("grown.b")).drop("lo", "hi", "grown")


def cjk(pg_joined: DataFrame, q: str, case_sensitive: bool = False) -> DataFrame:
    """Substring search without spaces and signs; pg_joined: pages with the empty separator."""
    needle = T_strip(q) if case_sensitive else T_strip(q).lower()
    if not needle:
        needle, pg_joined = "-", pg_joined.limit(0)
    df = broad_context(_stripped_places(pg_joined, needle, case_sensitive))
    part = F.slice("items", F.col("first") + 1, F.col("last") - F.col("first") + 1)
    origin = F.get("items", F.col("first"))["start"]
    return df.select(
        "doc_id", "page", T.item_at(F.col("items"), F.col("s"))["item_index"].alias("item_index"), F.col("s").cast("int").alias("start"), F.substring("concat", F.col("s") + 1, F.col("e") - F.col("s")).alias("matched"),
        F.array_join(F.transform(part, lambda o: o["text"]), "").alias("context"), (F.col("s") - origin).cast("int").alias("char_start"), (F.col("e") - origin).cast("int").alias("char_end"), T.spans(F.col("items"), F.col("s"), F.col("e")).alias("spans"),
    )


def T_strip(q: str) -> str:
    import unicodedata

    return "".join(c for c in q if unicodedata.category(c)[0] in "LN")


def exact(pg: DataFrame, q: str, case_sensitive: bool = False) -> DataFrame:
    """Token search: a single word must equal the whole query, several words a run of tokens. pg has toks."""
    compare = q if case_sensitive else q.lower()
    ts = query_tokens(compare)
    key_of = (lambda t: t) if case_sensitive else F.lower
    return match_runs(pg, [compare] if len(ts) == 1 else ts, key_of, spans=len(ts) != 1)


def fuzzy(pg: DataFrame, folded: str, case_sensitive: bool = False) -> DataFrame:
    """Single words within edit distance 1 (up to 7 characters) or 2 of the folded query, equal ones left out."""
    if len(folded) < 4 or not re.search("[a-zA-Z]", folded):
        pg = pg.limit(0)
    return _at_hits(pg, [(0, 3, [folded], False)], [], case_sensitive).select(*FIELDS)


def _fold_py(t: str, lower: bool) -> str:
    out = "".join(folding.fold_char(c) for c in t)
    return out.lower() if lower else out


_stem_py = token_hits.stem


def _at_hits(pg: DataFrame, wanted: list[tuple[int, int, list[str], bool]], falls: list[tuple[int, str]], case_sensitive: bool, stored: bool = False) -> DataFrame:
    """FIELDS, tier, term_ord and fall of what ``token_hits`` finds in pages; their tokens are taken if they are there."""
    toks = F.col("toks") if "toks" in pg.columns else F.regexp_extract_all("concat", F.lit(T.TOKEN), F.lit(0))
    df = token_hits.with_hits(pg, toks, token_hits.hits(wanted, falls, not case_sensitive), stored).select("doc_id", "page", "items", "concat", F.explode("hits").alias("h"))
    df = df.withColumn("hit", T.item_at(F.col("items"), F.col("h.s")))
    s, e = F.col("h.s"), F.col("h.e")
    several = F.col("h.many") & (e > F.col("hit.end"))  # only these reach into another item
    return df.select(
        "doc_id", "page", F.col("hit.item_index").alias("item_index"), s.alias("start"), F.substring("concat", s + 1, e - s).alias("matched"), F.col("hit.text").alias("context"),
        F.greatest(s - F.col("hit.start"), F.lit(0)).cast("int").alias("char_start"), F.least(F.col("hit.end") - F.col("hit.start"), e - F.col("hit.start")).cast("int").alias("char_end"),
        F.when(several, T.spans(F.col("items"), s, e)).alias("spans"), F.col("h.tier").alias("tier"), F.col("h.term_ord").alias("term_ord"), F.col("h.fall").alias("fall"),
    )


def _wanted(terms: list[tuple[int, str]], low: bool) -> list[tuple[int, int, list[str], bool]]:
    """What tiers 0 to 3 ask for (see ``token_hits.hits``)."""
    out = []
    for n, q in terms:
        compare = q.lower() if low else q
        exact_keys, folded = query_tokens(compare), [_fold_py(t, low) for t in query_tokens(q)]
        one = len(folded) == 1
        out += [(n, 0, [compare] if one else exact_keys, not one), (n, 1, folded, True), (n, 2, [_stem_py(f) for f in folded], True)]
        if one and len(folded[0]) >= 4 and re.search("[a-zA-Z]", folded[0]):
            out.append((n, 3, folded, False))
    return out


def token_tiers(pg: DataFrame, terms: list[tuple[int, str]], case_sensitive: bool = False) -> DataFrame:
    """FIELDS, tier and term_ord of tiers 0 to 3 (without the fallback) for several token queries, in one pass over pages."""
    return _at_hits(pg, _wanted(terms, not case_sensitive), [], case_sensitive).drop("fall")


def _tiers_and_fallback(pg: DataFrame, terms: list[tuple[int, str]], case_sensitive: bool, stored: bool) -> DataFrame:
    """The same with the fallback of single words, in documents without an exact hit."""
    low = not case_sensitive
    falls = [(n, q.lower() if low else q) for n, q in terms if len(query_tokens(q)) == 1]
    found = _at_hits(pg, _wanted(terms, low), falls, case_sensitive, stored)
    if not falls:
        return found.drop("fall")
    # by document alone, so that all that follows within documents needs no further exchange
    exact_terms = F.collect_set(F.when((F.col("tier") == 0) & ~F.col("fall"), F.col("term_ord"))).over(Window.partitionBy("doc_id"))
    found = found.withColumn("exact_terms", exact_terms)
    return found.filter(~F.col("fall") | F.col("doc_id").isNull() | ~F.array_contains("exact_terms", F.col("term_ord"))).drop("fall", "exact_terms")


def search_terms(docs: DataFrame, terms: list[tuple[str, str, str]], case_sensitive: bool = False) -> DataFrame:
    """docs: documents or stored pages. terms: (term, color, label). FIELDS, tier, term_ord, color, label and id: each term by itself, doubles at one
    (page, item, char_start) keeping the lowest tier, then one row for each id and label."""
    pg, joined, parts, plain = pages(docs), None, [], []
    for n, (term, _, _) in enumerate(terms):
        q = re.sub(f"^{T.BLANK}+|{T.BLANK}+$", "", term)
        kind, ts = query_kind(q), query_tokens(q)
        if kind == "cjk":
            joined = pages(docs, "") if joined is None else joined
            parts.append(cjk(joined, q, case_sensitive).withColumns({"tier": F.lit(0), "term_ord": F.lit(n)}))
        elif kind == "special":
            parts.append(special(pg, q, case_sensitive).withColumns({"tier": F.lit(0), "term_ord": F.lit(n)}))
        elif ts:
            plain.append((n, q))
    if plain:
        parts.append(_tiers_and_fallback(pg, plain, case_sensitive, not isinstance(docs, DataFrame)))
    if not parts:
        parts.append(special(pg.limit(0), "-").withColumns({"tier": F.lit(0), "term_ord": F.lit(0)}))
    # a term is in one part, so doubles go before the parts are put together, where a stored table's buckets still count
    w = Window.partitionBy("doc_id", "page", "item_index", "char_start", "term_ord").orderBy("tier", "start")
    parts = [p.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n") for p in parts]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    tags = F.array(*(F.struct(F.lit(c).alias("color"), F.lit(label).alias("label")) for _, c, label in terms)) if terms else F.array(F.struct(F.lit("").alias("color"), F.lit("").alias("label")))
    out = out.withColumn("tag", F.get(tags, F.col("term_ord"))).withColumns({"color": F.col("tag.color"), "label": F.col("tag.label"), "id": F.concat_ws("-", "page", "item_index", "start")}).drop("tag")
    w = Window.partitionBy("doc_id", "id", "label").orderBy("term_ord", "tier", "char_start")
    return out.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def search_document(docs: DataFrame, q: str, case_sensitive: bool = False) -> DataFrame:
    """FIELDS and tier for one query; doubles at one (page, item, char_start) keep the lowest tier."""
    return search_terms(docs, [(q, "", "")], case_sensitive).drop("term_ord", "color", "label", "id")


def term_list(added: DataFrame, list_col: str, case_sensitive: bool = False) -> DataFrame:
    """added (list_col, at, t), terms in the order of at -> (list_col, term, color): trimmed, blank ones and doubles refused, colors in turn."""
    rows = added.select(list_col, "at", T.strip(F.col("t")).alias("term")).filter("term <> ''")
    key = F.col("term") if case_sensitive else F.lower("term")
    one = rows.withColumn("n", F.row_number().over(Window.partitionBy(list_col, key).orderBy("at"))).filter("n = 1")
    place = (F.row_number().over(Window.partitionBy(list_col).orderBy("at")) - 1) % len(PALETTE)
    return one.select(list_col, "term", F.get(F.array(*map(F.lit, PALETTE)), place).alias("color"))

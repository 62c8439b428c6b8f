"""Stored pages give what documents give, without tokenising or dealing them out again."""

import random

import pytest

from parchment.operators import keywords as K
from parchment.operators import search as S
from parchment.sources import token_store as TS

TERMS = [("of the", "a", "of the"), ("onthe", "b", "onthe"), ("model", "c", "model"), ("인공지능", "d", "cjk"), ("C++", "e", "C++")]


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    rng = random.Random(8)
    lines = ["the model of the network", "models on the graph", "", "인공 지능 C++", "a graph network, modelled", "network model graph network", "on-the spot"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 30)))) for i in range(40)] + [(50, None), (51, ""), (None, "the model")]
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    return docs, TS.stored(docs, 4)


def rows(df):
    return sorted(map(str, map(tuple, df.collect())))


def test_search_and_keywords_over_stored_pages(both):
    docs, store = both
    assert rows(S.search_terms(store, TERMS)) == rows(S.search_terms(docs, TERMS))
    assert rows(K.keywords(store)) == rows(K.keywords(docs))


def exchanges(df):
    df.collect()  # adaptive plans are final once they have run
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return plan.count("Exchange ") - plan.count("BroadcastExchange ")


def test_work_within_documents_needs_no_exchange(both):
    docs, store = both
    for f in (K.tf_df, K.sequence, K.totals, K.cooccurrence):
        assert exchanges(f(store)) == 0 and exchanges(f(docs)) > 0
    assert exchanges(S.search_terms(store, TERMS)) < exchanges(S.search_terms(docs, TERMS)) or exchanges(S.search_terms(store, TERMS)) == 0


def test_the_table_is_kept_for_the_same_files_only(spark, both, tmp_path):
    docs, store = both
    assert TS.stored(docs, 4).name == store.name
    spark.createDataFrame([(1, "x")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/d")
    first = TS.stored(spark.read.parquet(f"{tmp_path}/d"), 2)
    spark.createDataFrame([(2, "y z")], "doc_id bigint, text string").write.mode("append").parquet(f"{tmp_path}/d")
    second = TS.stored(spark.read.parquet(f"{tmp_path}/d"), 2)
    assert second.name != first.name and second.pages.count() == 2
    TS.drop_store(first)
    assert not spark.catalog.tableExists(first.name) and spark.catalog.tableExists(second.name)

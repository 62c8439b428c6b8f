import random
import zlib

import pytest
import sentencepiece
from pyspark.sql import functions as F

from parchment.llm import token_counts as C, toxicity as T

TEXTS = ["", " ", "  ", "a", " a", "a ", "Hello  world ", "été déjà\n\nvu\t x", "<s> </s> <unk>", "▁ a▁ b ▁▁", "日本語 テキスト 😀", "x" * 3000, "a b", "ﬁn", "▁", "a▁", "\n", " \n "]


@pytest.fixture(scope="module")
def counter():
    return C.PrefixCounter(C.default_model())


def test_counts_and_every_prefix(counter):
    sp = sentencepiece.SentencePieceProcessor(model_file=C.default_model())
    rng = random.Random(8)
    texts = TEXTS + ["".join(rng.choice("ab  ▁é\nTthe ,😀") for _ in range(30)) for _ in range(150)]
    for t in texts:
        ends, counts = counter.table(t)
        assert (int(counts[-1]) if len(counts) else 0) == len(sp.encode(t)), t
        if len(t) < 100:
            want = [len(sp.encode(t[:k])) for k in range(len(t) + 1)]
            assert list(counter.every(t)) == want, t
            assert [want[e] for e in ends] == list(counts)
            for budget in (0, 1, 3, 7):
                assert counter.longest(t, budget) == max(k for k, n in enumerate(want) if n <= budget), (t, budget)


def test_rows(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=C.default_model())
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)] + [(99, None), (None, "a"), (0, "")], "doc_id bigint, text string")
    got = sorted(tuple(r) for r in C.over_budget(df, 10).filter("doc_id is not null").collect())
    want = sorted([(k, len(t.encode()), len(sp.encode(t)), len(sp.encode(t)) > 10) for k, t in enumerate(TEXTS)] + [(99, 0, 0, False), (0, 0, 0, False)])
    assert got == want and C.over_budget(df.limit(0)).count() == 0
    cut = C.truncate(df.filter("doc_id in (11, 99, 6)"), 2)
    assert {r.doc_id: r.text if r.text is None else len(sp.encode(r.text)) <= 2 for r in cut.collect()} == {11: True, 99: None, 6: True}
    stored = C.prefix_counts(df.filter("doc_id = 6")).first()
    assert stored.ends[-1] == len(TEXTS[6]) and stored.counts[-1] == stored.n_tokens


def labelled(n, seed):
    """Harm only where an insult meets a group: neither alone says anything."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ws = ["w%d" % rng.randrange(300) for _ in range(rng.randint(0, 60))]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        ws += ["vermin"] * insult + ["neighbours"] * group
        rng.shuffle(ws)
        rows.append((i, " ".join(ws), int(insult and group)))
    return rows


def test_pairs_are_learnt(spark):
    rows = labelled(1500, 9)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in T.judge(docs, labels).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i in got if got[i].held_out} == set(held)
    right = sum(got[i].predicted == rows[i][2] for i in held)
    assert right / len(held) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    kept = T.drop_toxic(docs.withColumn("score", F.lit("x")), labels)
    assert kept.columns == ["doc_id", "text", "score"]
    assert {r.doc_id for r in kept.collect()} == {i for i in got if got[i].score < 0.7}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "words here"), (3, "a b"), (3, "a b")], "doc_id bigint, text string")
    none = spark.createDataFrame([(1, None)], "doc_id bigint, toxic int")
    got = T.judge(docs, none).collect()
    assert len(got) == 5 and {r.score for r in got} == {0.5} and not any(r.held_out is None for r in got)
    assert T.judge(docs.limit(0), none).count() == 0

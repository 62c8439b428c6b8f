import random

from parchment.llm import substring_dedup as S


def brute(rows):
    """Plain restatement of the contract: rows (doc_id, text) with distinct ids -> doc_id -> text."""
    every, cut = {}, {}
    for d, t in rows:
        ps = S.sentences(t or "")
        cut[d] = ps
        ws = [p.lower().split() for p in ps]
        for i in range(len(ps)):
            if len(ws[i]) >= S.ALONE_WORDS:
                every.setdefault(tuple(ws[i]), []).append((d, i, 1))
                continue
            for n in range(S.MIN_SENTENCES, len(ps) - i + 1):
                run = sum(ws[i : i + n], [])
                if len(run) >= S.MIN_WORDS:
                    if ws[i]:
                        every.setdefault(tuple(run), []).append((d, i, n))
                    break
    gone = {}
    for occ in every.values():
        for d, i, n in sorted(occ)[1:]:
            gone.setdefault(d, set()).update(range(i, i + n))
    return {d: t if d not in gone else "".join(p for k, p in enumerate(cut[d]) if k not in gone[d]).rstrip() for d, t in rows}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1.5) for i, t in rows], "doc_id bigint, text string, n double")


def test_against_brute_force(spark):
    rng = random.Random(6)
    word = lambda: rng.choice("ab cd ef gh ij kl mn".split())
    sentence = lambda n: (" ".join(word() for _ in range(n)) + rng.choice([". ", "! ", ".\n", "\n"]))
    passages = ["".join(sentence(rng.choice([3, 9, 25, 40])) for _ in range(4)) for _ in range(5)]
    rows = []
    for d in range(80):
        t = "".join(sentence(rng.choice([1, 4, 12])) for _ in range(rng.randint(0, 6)))
        if d % 2:
            t += rng.choice(passages).replace(" ", rng.choice([" ", "  "]))
        if d % 5 == 0:
            t += "Is it. " * 40
        rows.append((d, t + sentence(5)))
    rows += [(100, None), (101, ""), (102, "  "), (103, "x" * 5000)]
    out = S.dedup_spans(frame(spark, rows).repartition(4), counts=True, covering=False)
    got = {r.doc_id: r.text for r in out.collect()}
    want = brute(rows)
    assert got == want and any(got[d] != t for d, t in rows) and out.columns == ["doc_id", "text", "n", "n_sentences", "n_removed"]


def test_pieces_are_the_text():
    rng = random.Random(7)
    for _ in range(300):
        t = "".join(rng.choice(["a", "B ", ". ", ".", "\n", "!)", "\t", "3.5", "。", "é? "]) for _ in range(rng.randint(0, 40)))
        assert "".join(S.sentences(t)) == t


def test_odd_rows(spark):
    p = "one two three four five six. seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty."
    rows = [(None, p), (4, p.upper()), (9, "x. " + p), (9, "x. " + p)]
    got = sorted((r.doc_id or 0, r.text) for r in S.dedup_spans(frame(spark, rows)).collect())
    assert got == [(0, ""), (4, p.upper()), (9, "x."), (9, "x.")]
    assert S.dedup_spans(frame(spark, [])).count() == 0

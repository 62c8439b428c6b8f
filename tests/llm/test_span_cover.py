import random

from test_substring_dedup import frame

from parchment.llm import substring_dedup as S


def brute(rows):
    """Sentences that a non-first occurrence of any run of enough sentences and words covers, whatever its length."""
    every, cut = {}, {}
    for d, t in rows:
        ps = cut[d] = S.sentences(t)
        ws = [p.lower().split() for p in ps]
        for i in range(len(ps)):
            for n in range(1, len(ps) - i + 1):
                run = sum(ws[i : i + n], [])
                if n >= S.MIN_SENTENCES and len(run) >= S.MIN_WORDS or n == 1 and len(run) >= S.ALONE_WORDS:
                    every.setdefault(tuple(map(tuple, ws[i : i + n])), []).append((d, i, n))
    gone = {}
    for occ in every.values():
        for d, i, n in sorted(occ)[1:]:
            gone.setdefault(d, set()).update(range(i, i + n))
    return {d: t if d not in gone else "".join(p for k, p in enumerate(cut[d]) if k not in gone[d]).rstrip() for d, t in rows}


def test_every_sentence_of_a_repeated_run_goes(spark):
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(900))
    passage = lambda sizes: "".join(" ".join(word() for _ in range(n)) + ". " for n in sizes)
    rows = []
    for k, sizes in enumerate([(35, 29), (40, 25), (60, 19), (25, 20, 9, 8), (3, 40, 2, 1), (9, 9, 9, 9, 40, 5)]):
        p = passage(sizes)
        rows += [(10 * k, passage((6,)) + p + passage((7,))), (10 * k + 1, p), (10 * k + 2, passage((4, 33)) + p + "End. ")]
    many = [passage(rng.choice([2, 6, 21, 35]) for _ in range(4)) for _ in range(4)]
    rows += [(100 + d, passage(rng.choice([1, 5, 31]) for _ in range(rng.randint(0, 3))) + rng.choice(many) + passage((5,)) + rng.choice(many)) for d in range(30)]
    got = {r.doc_id: r.text for r in S.dedup_spans(frame(spark, rows).repartition(4), covering=True).collect()}
    assert got == brute(rows)
    assert all(got[10 * k + 1] == "" for k in range(6))

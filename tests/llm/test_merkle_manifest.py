import hashlib
import zlib

from parchment.llm import merkle_manifest as M
from parchment.llm import queries as Q

FIELDS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """All levels, plainly."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H(*last[i : i + 16]) for i in range(0, len(last), 16)])
    return levels


def path(levels, i):
    out = []
    for nodes in levels[:-1]:
        first = i // 16 * 16
        run = nodes[first : first + 16]
        out.append((i - first, run[: i - first] + run[i - first + 1 :]))
        i //= 16
    return out


def fold(h, steps):
    for at, rest in steps:
        h = H(*rest[:at], h, *rest[at:])
    return h


def leaf(row, text):
    f = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H(*map(f, (row[0], row[1], row[2], row[3], text)))


def lowered(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s, rs in by.items():
        rs.sort(key=lambda r: (r[0] is None, r[0] or 0, leaf(r, r[4])))
        trees[s] = tree([leaf(r, r[4]) for r in rs])
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(by[s]):
            steps = path(trees[s], i) + path(top, k)
            own = leaf(r, r[4])
            odd = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            end = fold(leaf(r, lowered(r[4])) if odd else own, steps)
            assert fold(own, steps) == top[-1][0]
            out.append((r[0], own, trees[s][-1][0], top[-1][0], H(*(x for _, rest in steps for x in rest)), end, end == top[-1][0]))
    return out


def test_walk_gives_every_path():
    for n in (1, 2, 15, 16, 17, 31, 33, 256, 257, 271, 273, 300, 4095, 4096):
        nodes = [H(str(i)) for i in range(n)]
        levels, high = tree(nodes), M.height(n)
        assert len(levels) == high + 1 and M.subtree([x.encode() for x in nodes], high).decode() == levels[-1][0]
        held = 0
        for i, steps in enumerate(M.walk([x.encode() for x in nodes], high)):
            want = path(levels, i)
            assert [(p, M.others(p, run).decode()) for p, run in steps] == [(p, "".join(rest)) for p, rest in want]
            assert M.opened(M.packed_path(steps)) == [(p, "".join(rest).encode()) for p, rest in want]
            held = max(held, sum(len(run) for _, run in steps))
        assert held <= 16 * 64 * max(1, high)


def rows():
    out = [(i, "big", "en", i * 2, f"Text {i} É") for i in range(300)]
    out += [(1000 + i, f"s{i}", None, None, None if i % 4 == 0 else "ABC def") for i in range(40)]
    out += [(2000 + i, None, "de", 1, "") for i in range(5)]
    out += [(None, "big", "en", 3, "No id"), (None, "nil", None, None, None), (7, "big", "en", 14, "Again"), (7, "big", "en", 14, "Again"), (5, "é", "x", 0, "W" * 100_000), (6, "z", "x", 0, "plain")]
    return out


def test_query_equals_brute_force(spark, tmp_path):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows()], "doc_id bigint, source string, lang string, n_chars bigint, text string, digest string, pos int")
    docs.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = Q.QUERIES["op11_merkle_manifest"](spark, str(tmp_path)).select(*FIELDS).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows())))
    assert any(not r.verified for r in got) and sum(r.verified for r in got) > 250


def test_several_blocks_and_no_rows(spark, tmp_path):
    many = [(i, "one" if i % 97 else f"s{i}", "en", 1, "Aa") for i in range(9000)]
    docs = spark.createDataFrame(many, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    docs.repartition(7).write.parquet(str(tmp_path / "documents.parquet"))
    got = Q.QUERIES["op11_merkle_manifest"](spark, str(tmp_path)).select(*FIELDS).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(many)))
    assert M.manifest(docs.limit(0), ["doc_id", "text"], "source").count() == 0

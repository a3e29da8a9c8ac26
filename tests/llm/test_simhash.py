import random

import numpy as np
import pytest
import xxhash
from helpers import plain_components, texts_frame

from emberfall.llm import simhash
from emberfall.llm.components import components


def plain_print(text, k):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def texts():
    rng = random.Random(7)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(30, 300))] for _ in range(25)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i, b in enumerate(base):
        for n in range(4):
            c = list(b)
            for _ in range(n):
                c[rng.randrange(len(c))] = "Éx"
            rows.append((100 + 10 * i + n, " ".join(c)))
    rows += [(900, None), (901, ""), (902, " \t\n"), (None, rows[0][1]), (None, "alone here"), (3, rows[3][1]), (3, "same id, other text")]
    return rows + [(903, "one"), (904, "one two"), (905, "x y z"), (906, "long " * 30000)]


@pytest.mark.parametrize("upper", [1024, 3])
@pytest.mark.parametrize("kw", [dict(), dict(radius=12, blocks=4), dict(shingle=5, bits=128, radius=25, blocks=8)])
def test_against_brute_force(spark, kw, upper, monkeypatch):
    monkeypatch.setattr(simhash, "CODES_IN_GROUP", 10)
    monkeypatch.setattr(simhash, "UPPER_NODES", upper)
    rows = texts()
    got = simhash.near_duplicates(texts_frame(spark, rows), **kw).collect()
    assert len(got) == len(rows)
    k, radius, bits = kw.get("shingle", 3), kw.get("radius", 3), kw.get("bits", 64)
    if bits == 64:
        assert {r.fingerprint for r in got} == {f"{plain_print(t, k):016x}" for _, t in rows}
    codes = sorted({int(r.fingerprint, 16) for r in got})
    roots = dict(zip(codes, plain_components(codes, lambda a, b: (a ^ b).bit_count() <= radius)))
    ids = {}
    for r in got:
        root = roots[int(r.fingerprint, 16)]
        ids[root] = min([x for x in (ids.get(root), r.doc_id) if x is not None], default=None)
    assert all(r.component_id == ids[roots[int(r.fingerprint, 16)]] for r in got)


def test_one_of_each_stays(spark):
    rows = [(5, "a b c d e f g"), (4, "a b c d e f g"), (4, "a b c d e f g"), (None, "q r s t u v"), (None, "q r s t u v"), (9, "z " * 9)]
    docs = texts_frame(spark, rows)
    kept = simhash.keep_one(docs, simhash.near_duplicates(docs))
    assert kept.columns == docs.columns
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=str) == sorted([rows[1], rows[3], rows[5]], key=str)


def test_empty(spark):
    assert simhash.near_duplicates(texts_frame(spark, [])).collect() == []


def test_tree_pairs_and_gray_order():
    rng = np.random.default_rng(8)
    codes = rng.integers(0, 1 << 12, 300, dtype=np.uint64) << np.uint64(52)
    order = simhash.gray_rank(codes).argsort()
    codes = codes[order]
    tree = simhash.GrayTree(codes)
    found = {(int(a), int(b)) for i, j in simhash.near_pairs(tree, tree, 2, True) for a, b in zip(i, j)}
    want = {(a, b) for a in range(300) for b in range(a, 300) if int(codes[a] ^ codes[b]).bit_count() <= 2}
    assert found == want
    rank = simhash.gray_rank(np.arange(16, dtype=np.uint64))
    by_rank = [c for _, c in sorted(zip(rank.tolist(), range(16)))]
    assert all((a ^ b).bit_count() == 1 for a, b in zip(by_rank, by_rank[1:]))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(components(spark.createDataFrame(links, "u long, v long")).collect())
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 130)) and got[201] == 200
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_groups_that_differ_in_the_top_bit(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CODES_IN_GROUP", 4)
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 63, 120, dtype=np.uint64)
    top = np.uint64(1 << 63)
    codes = np.unique(np.concatenate([base, base ^ top ^ (np.uint64(1) << rng.integers(20, 60, 120).astype(np.uint64))]))
    prints = spark.createDataFrame([(x,) for x in simhash.hexed(codes.reshape(-1, 1))], "print string")
    got = {tuple(sorted((int(r.u, 16), int(r.v, 16)))) for r in simhash.near_links(prints, 64, 3, 1).collect()}
    whole = [int(c) for c in codes]
    want = {(a, b) for k, a in enumerate(whole) for b in whole[k + 1 :] if (a ^ b).bit_count() <= 3}
    assert len(want) >= 120 and got == want


def test_components_that_share_an_id_stay_apart(spark):
    words = lambda c: [f"{c}{i}" for i in range(90)]
    near = lambda c: " ".join([w.upper() for w in words(c)])
    rows = [(5, " ".join(words("a"))), (9, near("a")), (5, " ".join(words("b"))), (12, near("b"))]
    rows += [(None, " ".join(words("c"))), (None, near("c"))]
    docs = texts_frame(spark, rows)
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(docs, simhash.near_duplicates(docs)).collect()]
    assert len(kept) == 3 and {rows[0], rows[2]} < set(kept) and len(set(kept) & set(rows[4:])) == 1


def test_clashing_names(spark):
    rows = [(1, "a b c d e", "x", "y"), (2, "a b c d e", "x", "y"), (3, None, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Key_Id string, _key_text string")
    kept = simhash.keep_one(docs, simhash.near_duplicates(docs))
    assert sorted(map(tuple, kept.collect())) == [rows[0], rows[2]] and kept.columns == docs.columns

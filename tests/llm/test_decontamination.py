import random

import pytest
from helpers import texts_frame, words

from emberfall.llm import decontamination


def plain(docs, items, window=10):
    wins = []
    for item, text in items:
        w = words(text)
        size = min(window, len(w))
        for s in range(len(w) - size + 1) if w else []:
            wins.append((item, w[s : s + size]))
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, win in wins:
            for s in range(len(w) - len(win) + 1):
                if w[s : s + len(win)] == win:
                    hit |= set(range(s, s + len(win)))
                    found |= {str(item)} if item is not None else set()
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def run(spark, docs, items, window=10):
    frame = texts_frame(spark, docs)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.decontaminate(frame, bench, window).collect()
    return sorted([(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got], key=str), frame, bench


def test_against_brute_force(spark):
    rng = random.Random(1)
    vocab = ["a", "b", "Ça", "9"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 7, 9, 10, 11, 14, 25]))) for i in range(12)]
    items = [x for x in items if len(x[1].split()) > 5] + [(90, "zz"), (91, "q r s t"), (92, None), (93, ""), (None, text(12)), (90, "zz")]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(60)]
    docs += [(100, items[0][1]), (101, "x ZZ, zz y"), (101, "q-R.s"), (102, "q r s t q r s t"), (103, None), (None, items[1][1])]
    docs += docs[:2] + [(104, " ".join(t for _, t in items if t) * 3)]
    got, frame, bench = run(spark, docs, items)
    assert got == plain(docs, items)
    kept = decontamination.keep_clean(frame, bench)
    assert kept.columns == frame.columns
    clean = sorted([r[0] for r in plain(docs, items) if r[2] == 0], key=str)
    assert sorted([r.doc_id for r in kept.collect()], key=str) == clean


@pytest.mark.parametrize("window", [1, 2, 3])
def test_other_windows(spark, window):
    rng = random.Random(window)
    text = lambda n: " ".join(rng.choice("abcdefgh") * 2 for _ in range(n))
    docs, items = [(i, text(rng.randrange(8))) for i in range(20)], [(i, text(rng.randrange(5))) for i in range(4)]
    assert run(spark, docs, items, window)[0] == plain(docs, items, window)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b c")])[0] == []
    assert run(spark, [(1, "a b c"), (2, None)], [])[0] == [(1, 3, 0, []), (2, 0, 0, [])]


def test_every_long_shared_span_is_found(spark):
    rng = random.Random(2)
    item = [f"w{rng.randrange(50)}" for _ in range(40)]
    docs = []
    for s in range(31):
        before = [f"b{rng.randrange(9)}" for _ in range(s % 7)]
        docs.append((s, " ".join(before + item[s : s + 10] + ["end"])))
    got, _, _ = run(spark, docs, [(1, " ".join(item))])
    assert all(n_hit == 10 for _, _, n_hit, _ in got)


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "q r s t", "x", "y"), (2, "other", "x", "y")], "doc_id long, text string, KEY_ID string, _key_id string")
    bench = spark.createDataFrame([(1, "q r s t")], "item_id long, text string")
    kept = decontamination.keep_clean(docs, bench)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [2]


def test_long_text(spark):
    item = " ".join(f"w{i}" for i in range(12))
    docs = [(1, "word " * 200_000 + item + " word" * 50_000), (2, "word " * 200_000)]
    assert run(spark, docs, [(7, item)])[0] == [(1, 250_012, 12, ["7"]), (2, 200_000, 0, [])]

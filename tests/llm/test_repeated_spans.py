import hashlib
import random

import numpy as np
import pytest
from helpers import texts_frame

from emberfall.llm import repeated_spans

VOID = 1 << 62


def plain(rows, w=50):
    first = {}
    for i, t in rows:
        b, i = (t or "").encode(), VOID if i is None else i
        for s in range(len(b) - w + 1):
            first[b[s : s + w]] = min(first.get(b[s : s + w], VOID), i)
    out = []
    for i, t in rows:
        b, me = (t or "").encode(), VOID if i is None else i
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - w + 1):
            if first[b[s : s + w]] < me:
                gone[s : s + w] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    got = repeated_spans.remove_repeats(texts_frame(spark, rows), **kw).collect()
    return sorted(
        [
            (r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest())
            for r in got
        ],
        key=str,
    )


def corpus():
    rng = random.Random(10)
    word = lambda: rng.choice(["alpha", "é", "beta gamma", "x", "delta"]) + rng.choice(["", "s", "42"])
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(40)
    rows = [(i, text(rng.randrange(0, 120))) for i in range(60)]
    rows += [(100 + i, text(i % 9) + passage[i % 30 :] + text(i % 7)) for i in range(40)]
    rows += [(200 + i, rows[i][1]) for i in range(10)] + [(300, "ab" * 400), (301, "ab" * 300), (302, "b" * 49), (303, "b" * 49)]
    rows += [(None, passage), (None, passage + "!"), (5, passage), (5, rows[7][1]), (5, passage), (304, None), (305, "")]
    return rows + [(306, passage[:50]), (307, passage[:49]), (-4, passage[3:90])]


@pytest.mark.parametrize("kw", [{}, {"slice_bytes": 2000, "bucket_bytes": 1500}, {"slice_bytes": 3000, "bucket_bytes": 900, "hot_from": 4}])
def test_against_brute_force(spark, kw):
    rows = corpus()
    assert run(spark, rows, **kw) == plain(rows)


def test_long_text_over_several_pieces(spark, monkeypatch):
    rng = random.Random(11)
    long_ = "".join(rng.choice("abcdefgh ") for _ in range(300_000))
    rows = [(1, long_), (2, "zz" + long_[700:200_000]), (3, long_[2000:2300])]
    texts = [t.encode() for _, t in rows]
    want = {(t, s) for t in range(3) for s in range(len(texts[t]) - 49)}
    monkeypatch.setattr(repeated_spans, "PIECE", 1024)  # on the driver only
    found = [x for a in repeated_spans.anchors(texts) for x in zip(a[0].tolist(), a[2].tolist(), a[3].tolist())]
    assert {(t, s) for t, a, b in found for s in range(a, b + 1)} == want
    assert run(spark, rows) == plain(rows)


def test_hashes_do_not_depend_on_the_place():
    data = np.frombuffer(b"xy" + b"abcdefgh" * 20 + b"z" + b"abcdefgh" * 20, np.uint8)
    found = repeated_spans.string_hashes(data, np.array([2, 10, 163, 3]), np.array([62, 70, 223, 63]))
    assert found[0] == found[1] == found[2] != found[3]
    grams = repeated_spans.gram_hashes(data)
    assert grams[2] == grams[10] == grams[163] != grams[3]


@pytest.mark.parametrize("seed", range(5))
def test_longest_previous_factors(seed):
    """Lengths against a plain search over all pairs, ids repeated and in any order."""
    rng = np.random.default_rng(seed)
    letters = rng.integers(97, 97 + [1, 2, 2, 3, 26][seed], 400, dtype=np.uint8)
    letters[200:330] = letters[20:150]
    raw = letters.tobytes()
    starts = np.arange(len(raw) - repeated_spans.WINDOW + 1)
    eight = np.ndarray((len(raw) - 7,), ">u8", raw, 0, (1,))
    words = [eight[starts + c].astype(np.uint64) for c in repeated_spans.WORD_AT]
    ids = rng.integers(-3, 9, len(starts))
    suffixes = [raw[s : s + repeated_spans.WINDOW] for s in starts]
    shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    want = [max((shared(s, t) for t, j in zip(suffixes, ids) if j < i), default=0) for s, i in zip(suffixes, ids)]
    assert repeated_spans.longest_previous_factors(words, ids).tolist() == want
    assert repeated_spans.previous_factors(words, ids).tolist() == [w == repeated_spans.WINDOW for w in want]


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 0, 0, 0, hashlib.sha256(b"").hexdigest())]

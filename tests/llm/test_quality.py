import random
import zlib

import numpy as np
from helpers import texts_frame
from pyspark.sql import functions as F

from emberfall.llm import quality


def corpus(n=300):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(5, 60))]
        good = i % 4 != 0
        rows.append((i, " ".join(words).capitalize() + "." if good else " ".join(w.upper() + "!!" for w in words)))
        labels.append((i, int(good), "x"))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = texts_frame(spark, rows + [(None, None), (900, ""), (901, "ok " * 50000), (1, rows[1][1])])
    marks = spark.createDataFrame(labels + [(2, None, "x"), (9999, 1, "x"), (4, 7, "y")], "doc_id long, quality int, text string")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = quality.fit_quality(docs, marks.filter(~held), sample_rows=150)
    got = quality.score_texts(docs.select("doc_id", "text", quality.held_out(F.col("doc_id")).alias("out")), model).collect()
    assert len(got) == len(rows) + 4
    truth = {i: q for i, q, _ in labels}
    for r in got:
        assert 0 <= r.score <= 1
        assert r.out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    tested = [r for r in got if r.out and r.doc_id in truth]
    assert len(tested) > 60
    assert np.mean([(r.score >= 0.5) == (truth[r.doc_id] == 1) for r in tested]) > 0.97


def test_labels_of_one_class_or_none(spark):
    docs = texts_frame(spark, [(1, "a"), (2, None)])
    for labels, share in (([(1, 1)], 1.0), ([], 0.5), ([(1, None), (7, 0)], 0.5)):
        model = quality.fit_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        scores = [r.score for r in quality.score_texts(docs, model).collect()]
        assert all(abs(s - share) < 1e-5 for s in scores)
    assert quality.score_texts(texts_frame(spark, []), model).collect() == []


def test_fit_separates_and_marks_repeats():
    assert quality.shape("Ab12cd!!") == "Aa0a!!"
    assert set(quality.features("x x x")) != set(quality.features("x y z"))
    rows = [quality.features("A! " * 9 + "b"), quality.features("a b c")] * 5
    model = quality.fit_rows(rows, [0, 1] * 5)
    assert model.score(rows[0]) < 0.5 < model.score(rows[1])


def test_long_tokens_count_to_their_end():
    head = "漢字1、" * 300
    ends = [head + "Latin,9.", head + "漢字字!?"]
    assert set(quality.features(ends[0])) != set(quality.features(ends[1]))
    assert quality.pieces(ends[0])[0] == "漢字1、漢字1、漢字1" and "".join(quality.pieces(ends[0])) == ends[0]
    assert quality.pieces("Ab12cd!!") == ["Ab12cd!!"] and quality.tokens_of("a b,c,d,e,f,g") == ["a", "b,c,d,e,", "f,g"]


def plain_svm(texts, labels, cost=quality.COST):
    """Naive Bayes ratios and the hinge loss by plain cyclic dual coordinate descent, over dicts."""
    from math import log, sqrt

    found = [set(quality.features(t).tolist()) for t in texts]
    size = {c: labels.count(c) for c in (0, 1)}
    share = lambda f, c: (sum(f in x for x, y in zip(found, labels) if y == c) + 1) / (size[c] + 2)
    ratio = {f: log(share(f, 1) / share(f, 0)) for f in set().union(*found)}
    rows = [{f: ratio[f] / sqrt(len(x)) for f in x} for x in found]
    most = [cost * len(rows) / (2 * size[y]) for y in labels]
    w, b, alpha = dict.fromkeys(ratio, 0.0), 0.0, [0.0] * len(rows)
    for _ in range(400):
        for i, (x, y) in enumerate(zip(rows, labels)):
            sign = 1 if y else -1
            gradient = sign * (sum(w[f] * v for f, v in x.items()) + b) - 1
            new = min(max(alpha[i] - gradient / (sum(v * v for v in x.values()) + 1), 0), most[i])
            step, alpha[i] = (new - alpha[i]) * sign, new
            b += step
            for f, v in x.items():
                w[f] += step * v
    return ratio, rows, most, w, b


def test_against_a_plain_solver(monkeypatch):
    """The same ratios, and the same least loss, as a plain version finds."""
    monkeypatch.setattr(quality, "DRAWN", 1.0)
    monkeypatch.setattr(quality, "EPOCHS", 400)
    rows, labels = corpus(40)
    rng = random.Random(2)
    texts = [" ".join(rng.sample(t.split(), min(6, len(t.split()))) + [rng.choice(["a", "B!!"])]) for _, t in rows]
    marks = [q for _, q, _ in labels]
    ratio, scaled, most, w, b = plain_svm(texts, marks)
    found = [quality.features(t) for t in texts]
    ratios = quality.log_count_ratios(found, np.array(marks) == 1)
    assert all(abs(ratios[f] - r) < 1e-12 for f, r in ratio.items())
    model = quality.fit_rows(found, marks)

    def loss(weight, bias):
        margins = [(1 if y else -1) * (sum(weight[f] * v for f, v in x.items()) + bias) for x, y in zip(scaled, marks)]
        return (sum(v * v for v in weight.values()) + bias * bias) / 2 + sum(c * max(0, 1 - m) for c, m in zip(most, margins))

    mine = {f: model.weights[f] / ratios[f] if ratios[f] else 0.0 for f in ratio}
    assert loss(mine, model.bias) <= loss(w, b) * 1.001 + 1e-9
    for x, f in zip(scaled, found):
        plain = 1 / (1 + np.exp(-quality.STEEPNESS * (sum(w[k] * v for k, v in x.items()) + b)))
        assert abs(plain - model.score(f)) < 0.01

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberfall.llm import hard_negatives

LONG = 2**63


def plain(rows, positives=5, negatives=5, anchor=lambda i: i % 10 == 0):
    whole = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (i, label, tuple(math.floor(256 * x) for x in v))
        if row not in whole:
            whole.append(row)
    score = lambda a, b: max(min(sum(x * y for x, y in zip(a, b)), LONG - 1), 1 - LONG)
    out = []
    for i, label, v in whole:
        if not anchor(i):
            continue
        scored = sorted((-score(v, w), j, m) for j, m, w in whole)
        for p, j, _ in [x for x in scored if x[2] == label and x[1] != i][:positives]:
            near = [(s, k) for s, k, m in scored if m != label and 80 * -p <= 100 * -s <= 100 * -p][:negatives]
            out += [(i, j, r + 1, k, -p, -s) for r, (s, k) in enumerate(near)]
    return sorted(out)


def run(spark, rows, **kw):
    schema = "vec_id long, embedding array<double>, label int, number string, v int, asks string, positives string, bucket int"
    frame = spark.createDataFrame([(*r, "x", 1, "x", "x", 1) for r in rows], schema)
    got = hard_negatives.hard_negatives(frame, F.col("vec_id") % 10 == 0, F.col("label"), **kw).collect()
    return sorted(tuple(r) for r in got)


def test_strassen_is_exact():
    rng = np.random.default_rng(1)
    for shape in [(1, 1, 1), (5, 7, 3), (33, 17, 64), (100, 65, 130)]:
        a, b = rng.integers(-(2**20), 2**20, shape[:2]), rng.integers(-(2**20), 2**20, shape[1:])
        assert (hard_negatives.strassen(a, b, leaf=4) == a @ b).all()
    # Sums on the way leave 64 bits, the product does not.
    a = np.full((16, 16), 2**61)
    assert (hard_negatives.strassen(a, np.eye(16, dtype=np.int64), leaf=2) == a).all()
    assert hard_negatives.strassen(np.zeros((0, 8), np.int64), np.zeros((8, 9), np.int64)).shape == (0, 9)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHORS_IN_BLOCK", 7)
    monkeypatch.setattr(hard_negatives, "ROWS_IN_SLICE", 50)
    monkeypatch.setattr(hard_negatives, "COLUMNS_AT_ONCE", 4)
    monkeypatch.setattr(hard_negatives, "LABEL_BUCKETS", 3)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(3, 6))
    rows = [(i, (centres[i % 3] + 0.4 * rng.normal(size=6)).tolist(), int(rng.choice([0, 0, 1, 2, 7]))) for i in range(280)]
    rows += [(300 + i, rows[0][1], i % 2) for i in range(40)]  # one vector, many times
    rows += [(500, None, 1), (510, [1.0, None], 1), (520, [float("nan")] * 6, 1), (530, [float("inf")], 0), (None, rows[1][1], 0)]
    rows += [(540, rows[3][1], None), (550, [], 1), (560, [0.5], 0), rows[10], rows[10], (20, rows[4][1], 2), (570, [-0.001] * 6, 1)]
    got = run(spark, rows)
    assert got == plain(rows) and len(got) > 200


def test_few_rows_large_values_and_none(spark):
    assert run(spark, []) == [] and run(spark, [(0, [1.0], 1)]) == [] and run(spark, [(0, [1.0], 1), (1, [1.0], 1)]) == []
    rows = [(0, [1e12, 1.0], 1), (1, [1e12, 0.0], 1), (2, [9e11, 0.0], 2), (3, [1e3, 0.0], 2), (4, [1e300, 0.0], 2), (5, [1e12, 9.0], 3)]
    assert run(spark, rows) == plain(rows)


@pytest.mark.parametrize("value", [0.0, -1.0])
def test_windows_of_zero_and_below(spark, value):
    """A positive that scores zero takes negatives of zero, one below zero takes none."""
    rows = [(0, [1.0], 1), (1, [value], 1), (2, [0.0], 2), (3, [-1.0], 2)]
    assert run(spark, rows) == plain(rows)
    assert len(run(spark, rows)) == (1 if value == 0 else 0)

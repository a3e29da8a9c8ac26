import numpy as np
import pytest
from pyspark.sql import functions as F

from emberfall.llm import voronoi_topk


def plain(rows, k, asks):
    import math

    whole = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.setdefault(i, []).append([math.floor(256 * x) for x in v])
    out = []
    for q in whole:
        if asks(q):
            scores = [
                (-max(sum(int(a) * int(b) for a, b in zip(x, y)) for x in whole[q] for y in whole[o]), o)
                for o in whole
                if o != q
            ]
            out += [(q, r + 1, o, -s) for r, (s, o) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def run(spark, rows, k=5, **kw):
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, v string, asks int")
    got = voronoi_topk.top_k(frame, F.col("vec_id") % 7 == 0, k, **kw).collect()
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got)


@pytest.mark.parametrize("kw", [{}, {"pivots": 3}])
def test_against_brute_force(spark, kw, monkeypatch):
    monkeypatch.setattr(voronoi_topk, "QUERIES_IN_BLOCK", 9)
    monkeypatch.setattr(voronoi_topk, "ROWS_IN_SLICE", 40)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(4, 6))
    rows = [(i, (centres[i % 4] + 0.1 * rng.normal(size=6)).tolist()) for i in range(300)]
    rows += [(400 + i, rows[0][1]) for i in range(60)]
    rows += [(700, None), (701, [1.0, None]), (702, [float("nan")] * 6), (703, [float("inf")]), (None, rows[1][1])]
    rows += [(704, []), (705, [1.0]), (0, rows[9][1]), (7, rows[7][1]), (706, [0.01171875] * 6), (707, [-0.001] * 6)]
    assert run(spark, rows, **kw) == plain(rows, 5, lambda i: i % 7 == 0)


def sent_share(spark, rows, k=5):
    """Of all pairs of a vector and a group of queries, how many are sent."""
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    cells, _ = voronoi_topk.routed(frame, F.col("vec_id") % 7 == 0, k)
    cells = cells.filter("block = 0").collect()
    sent = sum(len(voronoi_topk.blobs.unpack(c.cell)[0]) for c in cells if c.side == 1)
    return sent / (len(rows) * len({c.grp for c in cells if c.side == 0}))


def test_clustered_vectors_are_pruned(spark):
    """Less than half of all vectors reach a group where vectors lie in clusters, and the
    result is that of all."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(24, 32))
    rows = [(i, (centres[i % 24] + 0.05 * rng.normal(size=32)).tolist()) for i in range(1500)]
    assert sent_share(spark, rows) < 0.5
    assert run(spark, rows[:400]) == plain(rows[:400], 5, lambda i: i % 7 == 0)


def test_few_rows_large_values_and_none(spark):
    rows = [(0, [1e15, 1.0]), (1, [1e15, -1.0]), (2, [3.0, 4.0])]
    got = run(spark, rows)
    assert [r[2] for r in got] == [1, 2] and got[0][3] == 2**63 - 1
    assert run(spark, []) == [] and run(spark, [(1, [1.0])]) == [] and run(spark, [(0, [1.0])]) == []

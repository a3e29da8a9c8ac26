import random
import zlib
from collections import defaultdict

import pytest
from helpers import texts_frame

from emberfall.llm import sharding


def check(rows, got, n_shards=8):
    want = sorted([(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows], key=str)
    assert sorted([(r.doc_id, r.size, r.text_crc32) for r in got], key=str) == want
    shard_of, slots = defaultdict(set), defaultdict(list)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < n_shards
        shard_of[(r.text_crc32, r.size)].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in shard_of.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(n_shards)]
    return sizes


@pytest.mark.parametrize("large_part", [sharding.LARGE_PART, 1, 20])
def test_near_equal_bytes(spark, large_part):
    rng = random.Random(3)
    rows = [(i, "ä" * rng.randrange(0, 300)) for i in range(1500)]
    rows += [(2000 + i, "copy" * 20) for i in range(300)] + [(5, None), (5, None), (None, "x"), (6, "")]
    got = sharding.shard_documents(texts_frame(spark, rows), large_part=large_part).collect()
    sizes = check(rows, got)
    assert max(sizes) - min(sizes) <= max(sizes) // 20


def test_few_rows_and_none(spark):
    rows = [(1, "a" * 100), (2, "b")]
    check(rows, sharding.shard_documents(texts_frame(spark, rows)).collect())
    assert sharding.shard_documents(texts_frame(spark, [])).collect() == []


def test_tree_is_best_fit():
    rng = random.Random(4)
    rooms = [rng.randrange(50, 200) for _ in range(40)]
    sizes = sorted((rng.randrange(1, 60) for _ in range(300)), reverse=True)
    left, want = list(rooms), []
    for size in sizes:
        fit = [(r, s) for s, r in enumerate(left) if r >= size]
        room, shard = min(fit) if fit else max((r, s) for s, r in enumerate(left))
        left[shard] -= size
        want.append(shard)
    assert sharding.best_fit(sizes, rooms) == want
    tree = sharding.CapacityTree([(r, s) for s, r in enumerate(rooms)], width=2)
    for size, shard in zip(sizes, want):
        room, found = tree.tightest(size)
        assert found == shard
        tree.put(room - size, found)


def test_long_text(spark):
    rows = [(1, "long ä " * 400_000), (2, "b"), (3, None), (4, "long ä " * 400_000)] + [(10 + i, "x" * i) for i in range(90)]
    check(rows, sharding.shard_documents(texts_frame(spark, rows)).collect())

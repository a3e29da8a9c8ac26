"""Plain versions of the operators, and small tables full of edge cases."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def texts_frame(spark, rows, id_type="long"):
    """(doc_id, text) with extra columns whose names operators use inside."""
    clash = ["key_id", "key_text", "words", "n", "row_id", "print", "block", "id", "label", "spans", "start"]
    schema = f"doc_id {id_type}, text string, " + ", ".join(f"{c} string" for c in clash)
    return spark.createDataFrame([(i, t, *["x"] * len(clash)) for i, t in rows], schema)


def plain_components(ids, near):
    """Smallest reachable position of each of ``ids`` under ``near(a, b)``."""
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if near(ids[a], ids[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(ids))]

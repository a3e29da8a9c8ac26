import time

from helpers import texts_frame, words

from emberfall.llm import license_scan

ROWS = [
    (1, "Released under the MIT license. Under the mit license!"),
    (2, "Apache License, Version 2.0 and CC-BY-NC 4.0; cc by nc cc by nc"),
    (2, "nothing here"),
    (3, None),
    (None, "under the mit license"),
    (4, ""),
    (5, "spdx-license-identifier: gpl-3.0"),
    (6, "under the GNU Lesser General Public License version 3 and mit"),
    (7, "cc by nc sa 4 0 license " * 50),
    (8, "le mit und mit der apache"),
    (1, "Released under the MIT license. Under the mit license!"),
    (9, "ü" * 1000 + " under the mit licenseé"),
]


def plain(text):
    found, labels = [], set()
    w = words(text)
    for phrase, label in license_scan.BASE_PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        found += at
        labels |= {label} if at else set()
    return len(w), len(found), min(found, default=None), max(found, default=None), ",".join(sorted(labels))


def test_base_against_plain(spark):
    got = license_scan.scan_licenses(texts_frame(spark, ROWS)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([tuple(r)[:6] for r in got], key=key) == sorted([(i, *plain(t)) for i, t in ROWS], key=key)
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score > 0) == (r.labels != "")


def test_rules_and_suppression(spark):
    got = {r.doc_id: r for r in license_scan.scan_licenses(texts_frame(spark, ROWS)).collect()}
    assert got[5].labels == "gpl-3" and got[5].score == 1.0
    # The longer name hides the shorter one that it contains.
    assert got[6].labels == "lgpl-3"
    assert got[8].labels == ""
    assert "cc-by-nc-sa" in got[7].labels.split(",")
    assert len(license_scan.signature_rules()) > 200


def test_resolve(spark):
    cols = "key_id long, key_text long, start int, end int, priority int, number int, label string, score double"
    rows = [
        (1, 1, 0, 5, 3, 1, "long", 0.5),
        (1, 1, 1, 4, 1, 2, "inside", 0.5),
        (1, 1, 4, 8, 2, 3, "overlaps, better", 0.5),
        (1, 1, 8, 9, 4, 4, "same, weaker", 0.5),
        (1, 1, 8, 9, 2, 5, "same, better", 0.5),
        (2, 1, 1, 4, 5, 6, "other row", 0.5),
    ]
    kept = license_scan.resolve(spark.createDataFrame(rows, cols)).collect()
    assert {r.label for r in kept} == {"overlaps, better", "same, better", "other row"}


def test_empty(spark):
    assert license_scan.scan_licenses(texts_frame(spark, [])).collect() == []


def test_bodies(spark):
    rows = [
        (1, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software ... sublicense"),
        (2, "Redistribution and use in source and binary forms, with or without modification, are permitted. Redistributions"),
        (3, "redistribution of apples is permitted"),
    ]
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.scan_licenses(texts_frame(spark, rows)).collect()}
    assert got == {1: ("mit", 1.0), 2: ("bsd-2", 1.0), 3: ("", 0.0)}


def test_many_phrases_and_long_texts(spark):
    """Fifty thousand phrases in one text, and a text of many words without any, in seconds."""
    start = time.time()
    rows = [(1, "under the MIT license, " * 50_000), (2, "word " * 300_000 + "cc by nc")]
    got = {r.doc_id: tuple(r)[1:6] for r in license_scan.scan_licenses(texts_frame(spark, rows)).collect()}
    assert got == {1: (200_000, 50_000, 0, 199_996, "mit"), 2: (300_003, 1, 300_000, 300_000, "cc-by-nc")}
    assert time.time() - start < 20

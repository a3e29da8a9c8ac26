import re
import time

import duckdb
import pytest
from helpers import texts_frame
from pyspark.sql import functions as F

from emberfall.llm import pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (x * 2 if x < 5 else x * 2 - 9) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def plain(text):
    spans = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda: 12 <= len(d) <= 19 and luhn(d),
                "phone": lambda: 9 <= len(d) <= 15,
            }[kind]()
            if ok:
                spans.append((m.start(), rank, m.end(), kind))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)]


TEXTS = [
    "mail a.b+c@d.example.com, x@y, a@b.c+d@e.f @g.h z@1.2.3.4",
    "1.2.3.4 256.1.1.1 1.2.3.4.5 001.002.003.0255 1.2.3.999 1.2.3",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112 5500000000000004 1234567890123456789012",
    "call +49 (30) 1234-5678. +1 23 +123456789012345678 +1.2",
    "é😀 a@b.cd 😀 +43 664 1234567",
    "IBAN DE89 3704 0044 0532 0130 00. GB82WEST12345698765432 DE89370400440532013001",
    "",
    None,
    "a@b" + ".c" * 20000,
    "a" * 30000,
    "1" * 60000 + " " + "1." * 3000,
    "a@b.cd " * 300,
]


def test_base_against_plain(spark):
    frame = texts_frame(spark, list(enumerate(TEXTS)) + [(None, TEXTS[0]), (0, TEXTS[0])])
    got = pii.find_spans(frame, into="spans")
    assert got.columns == frame.columns
    base = pii.listed(F.filter("spans", lambda s: s["rank"] < 4))
    for r in got.select("doc_id", "text", base.alias("base"), "spans").collect():
        assert r.base == ",".join(plain(r.text))
        assert all(0 < s.score <= 1 for s in r.spans)


def test_iban_context_and_redaction(spark):
    frame = spark.createDataFrame([(TEXTS[5],), ("server ip 1.2.3.4",), ("word 1.2.3.4",)], "text string")
    rows = pii.find_spans(frame).select("text", "pii", pii.redact("text", "pii").alias("hidden")).collect()
    assert [s.kind for s in rows[0].pii if s.kind == "iban"] == ["iban"] * 2
    assert rows[0].hidden.startswith("IBAN <iban>. <iban> DE89")
    assert rows[1].pii[0].score > rows[2].pii[0].score
    assert rows[2].hidden == "word <ip>"


def test_overlapping_spans_are_hidden_once(spark):
    frame = spark.createDataFrame([("x 1.2.3.4@5.6.7.8 y",)], "text string")
    hidden = pii.find_spans(frame).select(pii.redact("text", "pii").alias("h")).first().h
    assert hidden == "x <email> y"


def test_empty(spark):
    assert pii.find_spans(texts_frame(spark, [])).collect() == []


def test_account_numbers_end_where_their_country_says(spark):
    texts = ["BE68 5390 0754 7034 EUR", "pay BE68539007547034EUR now", "DE89 3704 0044 0532 0130 00 7", "DE893704004405320130001234"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    found = pii.find_spans(frame, kinds=pii.METHOD)
    hidden = [r.h for r in found.select(pii.redact("text", "pii").alias("h")).collect()]
    assert hidden == ["<iban> EUR", "pay <iban>EUR now", "<iban> 7", "<iban>1234"]


def test_context_decides(spark):
    """A word nearby makes a number of three groups a span, and lifts every score."""
    texts = ["my SSN is 123-45-6789.", "order 123-45-6789 came", "ssn 000-45-6789, 666-45-6789, 912-45-6789, 123-00-6789, 1123-45-6789, 123-45-67890"]
    texts += ["ssn " + "x" * 60 + " 123-45-6789", "1.2.3.4 " * 8 + "5.6.7.8", "ip " + "1.2.3.4 " * 8]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.pii for r in pii.find_spans(frame).collect()}
    assert [(s.kind, s.start, s.end, s.score) for s in got[0]] == [("ssn", 10, 21, 0.5)]
    assert got[1] == [] and got[2] == [] and got[3] == []
    assert {s.score for s in got[4]} == {0.5}
    assert [s.score for s in got[5]] == [0.75] * 5 + [0.5] * 3


def test_against_sql(spark, tmp_path):
    texts = [t for t in TEXTS if t is None or len(t) < 3000]
    texts += ["pay BE68 5390 0754 7034 EUR now", "x BE685390075470349999 y", "tax id 123-45-6789", "123-45-6789 123-45-6789", "Ssn:123-45-6789-1 (219-09-9999)"]
    texts += ["Bank DE89 3704 0044 0532 0130 00, card 4111111111111111 " + "1.2.3.4 2.3.4.5 " * 5 + " Phone +49 30 1234567"]
    rows = [(i % 17, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op7(spark, str(tmp_path))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = con.execute(queries.PII_SQL)
        names = [d[0] for d in want.description]
        assert sorted(map(str, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(str, want.fetchall()))


@pytest.mark.parametrize("unit", ["10.0.0.1, ", "a@b.cd ", "4111111111111111, ", "+4930123456, "])
def test_many_matches_in_one_text(spark, unit):
    """Fifty thousand matches in one text: found, and hidden, in seconds."""
    n = 50_000
    start = time.time()
    found = pii.find_spans(spark.createDataFrame([(unit * n,)], "text string"))
    row = found.select(F.size("pii").alias("n"), F.element_at("pii", -1).alias("last"), pii.redact("text", "pii").alias("h")).first()
    assert row.n == n and row.last["start"] == len(unit) * (n - 1) and row.h.count("<") == n
    assert time.time() - start < 20

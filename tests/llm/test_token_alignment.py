import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from helpers import texts_frame
from tokenizers import Tokenizer

from emberfall.llm import bpe_codec, token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "Hello world, it's 42 tests of tokenizers!",
    "",
    None,
    "a<|endoftext|>b <s>x</s> <unk> <0x41>",
    "  \n\t x y  ",
    "日本語 😀👩‍👩‍👧 ١٢٣ é क्षि ﬁn é",
    "a▁b",
    "tab\there \x00 null",
    " leading and trailing ",
    "a" * 3000,
    "Élan vital, déjà vu. " * 300,
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(libraries, text):
    """[(id, start, end)] of A and of B, or nothing."""
    a, b = libraries
    if not text:
        return [], []
    letters = bpe_codec.byte_alphabet()
    raw_a = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    raw_b = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        raw_b.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    out = []
    for raw in (raw_a, raw_b):
        if b"".join(x for _, x in raw) != (" " + text).encode():
            return [], []
        at, spans = 0, []
        for i, x in raw:
            spans.append((i, at, at + len(x)))
            at += len(x)
        out.append(spans)
    return out


def plain(libraries, texts):
    cut = [tokens(libraries, t) for t in texts]
    links = []
    for a, b in cut:
        found, j = [], 0
        for i, s, e in a:
            while j < len(b) and b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                found.append((i, b[k][0]))
                k += 1
        links.append(found)
    held = Counter(p for found in links for p in set(found))
    most = {}
    for (a, _), n in held.items():
        most[a] = max(n, most.get(a, 0))
    rows = []
    for (a, b), found in zip(cut, links):
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, low = [], 0
        for e in ends:
            sides = [",".join(str(i) for i, s, _ in side if low <= s < e) for side in (a, b)]
            groups.append("|".join(sides))
            low = e
        rows.append((len(a), len(b), len(ends), len(found), sum(held[p] == most[p[0]] for p in found), sum(held[p] for p in found), ";".join(groups)))
    return rows, {(*p, n, n == most[p[0]]) for p, n in held.items()}


def test_gallop_finds_ranks():
    rng = np.random.default_rng(3)
    for n, m in [(0, 5), (5, 0), (1, 1), (3, 400), (400, 3), (200, 260)]:
        short, long = (np.unique(rng.integers(0, 600, k)) for k in (n, m))
        assert token_alignment.gallop(short, long).tolist() == np.searchsorted(long, short).tolist()


def test_against_the_libraries(spark, libraries, monkeypatch):
    monkeypatch.setattr(token_alignment, "BYTES_IN_BATCH", 2000)
    rng = random.Random(4)
    letters = "ab eëñ ß\n1 .'sTH日​̀   \xa0\x1c\x85\u2003\u180e\u3000"
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randrange(90))) for _ in range(60)]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, texts[3])]
    frame = texts_frame(spark, rows).repartition(3).withColumn("groups", token_alignment.F.lit("x"))
    docs, pairs = token_alignment.align_tokenizers(frame, A, B)
    want, held = plain(libraries, [t for _, t in rows])
    got = sorted([tuple(r) for r in docs.collect()], key=str)
    assert got == sorted([(i, *w) for (i, _), w in zip(rows, want)], key=str)
    assert {tuple(r) for r in pairs.select("a_id", "b_id", "n_docs", "best").collect()} == held


def test_digest_empty_table_and_other_ids(spark):
    docs, pairs = token_alignment.align_tokenizers(texts_frame(spark, []), A, B)
    assert docs.collect() == [] and pairs.collect() == []
    frame = texts_frame(spark, [("x", "one two"), ("y", None)], "string")
    text = {r.doc_id: r.groups for r in token_alignment.align_tokenizers(frame, A, B)[0].collect()}
    told = {r.doc_id: r.groups for r in token_alignment.align_tokenizers(frame, A, B, digest=True)[0].collect()}
    assert told == {"x": hashlib.sha256(text["x"].encode()).hexdigest(), "y": ""}


def same(x, y):
    return x[:2] == y[:2] and dict(zip(*map(list, x[2:]))) == dict(zip(*map(list, y[2:])))


def test_long_texts_in_pieces(monkeypatch):
    """Pieces of a long text give what the whole gives, chunks what the text gives as one run."""
    rng = random.Random(5)
    words = ["plain", "wörter", "x1", "don't", "  ", "\n", "日本", "end.", "And", "'s", "\xa0x", "́y", "\x1cz"]
    text = " ".join(rng.choice(words) for _ in range(4000))
    aligner = token_alignment.Aligner(bpe_codec.read_vocabulary(A), token_alignment.read_model(B))
    (want,) = aligner.align([text], False)
    seam, aligner.seam = aligner.seam, None
    aligner.forget()
    assert same(aligner.align([text], False)[0], want)
    aligner.seam = seam
    monkeypatch.setattr(token_alignment, "TEXT_IN_PIECE", 50)
    monkeypatch.setattr(token_alignment, "CACHED_CHUNKS", 5)
    assert len(list(aligner.cut(text))) > 100
    got = aligner.align([text, None, text + " a▁b", "a▁b c d e f g", text], False)
    assert same(got[0], want) and same(got[4], want)
    # A text that fails in one place has no tokens at all.
    assert [g[0] for g in got[1:4]] == [[0, 0, 0, 0]] * 3

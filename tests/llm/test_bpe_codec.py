import random

import public_tokenizers
import pytest
from helpers import texts_frame
from tokenizers import Tokenizer

from emberfall.llm import bpe_codec

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "Hello world, it's 42 tests!",
    "",
    None,
    "a<|endoftext|>b <|endoftext|>",
    "  \n\t x y  ",
    "日本語 😀👩‍👩‍👧 ١٢٣ é क्षि",
    "a" * 3000,
    "abc " * 20000,
    "\x00\x1f\x7f don't I'LL we've",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_against_the_library(spark, library):
    rows = list(enumerate(TEXTS)) + [(0, TEXTS[0]), (None, TEXTS[3])]
    frame = texts_frame(spark, rows).withColumnRenamed("label", "coded")
    got = bpe_codec.encode_decode(frame, PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.coded.ids == ",".join(map(str, ids)) and r.coded.n_tokens == len(ids)
        assert r.coded.decoded == library.decode(ids, skip_special_tokens=False) == (r.text or "")
    assert bpe_codec.encode_decode(texts_frame(spark, []), PATH).collect() == []


def test_random_texts_and_merging(library):
    rng = random.Random(6)
    codec = bpe_codec.Codec(bpe_codec.read_vocabulary(PATH))
    alphabet = "ab eëñ ß\n1 .'sTH日​̀"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(400)]
    for text, (ids, n, decoded) in zip(texts, codec.run(texts)):
        assert ids == ",".join(map(str, library.encode(text, add_special_tokens=False).ids))
        assert decoded == text
    for word in (b"understanding", b"aaaa" * 90, b" internationalisation"):
        exact = codec._merged_long([word[i : i + 1] for i in range(len(word))])
        assert exact == library.encode(word.decode(), add_special_tokens=False).ids
        if len(word) <= 256:
            assert codec.merged(word) == exact


def test_full_caches_lose_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe_codec, "CACHED_WORDS", 5)
    monkeypatch.setattr(bpe_codec, "TEXT_AT_ONCE", 10)
    codec = bpe_codec.Codec(bpe_codec.read_vocabulary(PATH))
    texts = [f"word{i} and word{i // 2} again" for i in range(40)]
    for text, (ids, _, _) in zip(texts, codec.run(texts)):
        assert ids == ",".join(map(str, library.encode(text, add_special_tokens=False).ids))

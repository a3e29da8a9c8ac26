"""Byte-level BPE: greedy proposals, pair checks on arrays, exact merging where they fail.

A sequence of tokens is the one that merging yields if every adjacent pair of it is:
if merging the bytes of two neighbours on their own gives these two tokens back. So a
word is first cut greedily into the longest tokens; all adjacent pairs of all new words
of a batch are checked at once as an array of pair keys, of which only unseen ones are
worked out; words with a failing pair are merged exactly. Words repeat, so each
worker keeps what it has found (a cache only, in two generations; nothing is lost).

Texts are worked on row by row inside Arrow batches: no shuffle, no state between rows,
and a lost task repeats its rows alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberfall.llm.words import bound_batches

MAX_VOCABULARY_BYTES = 64 << 20
CACHED_WORDS = 200_000
#: Longer words are worked out anew each time, so that the cache is bounded in bytes too.
CACHED_LETTERS = 256
CACHED_PAIRS = 1_000_000
TEXT_AT_ONCE = 500_000
ID_BITS = 24
ID_MASK = (1 << ID_BITS) - 1
NEVER = 1 << 62
# The cutting pattern of byte-level vocabularies.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The printable character of each byte: itself where it prints, else 256 and up."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary given as the JSON text of its file."""

    def __init__(self, vocabulary: str) -> None:
        spec = json.loads(vocabulary)
        letters = byte_alphabet()
        raw = lambda s: bytes(letters[c] for c in s)
        model = spec["model"]
        self.ids = {raw(token): i for token, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: token for token, i in self.ids.items()}
        self.bytes_of.update({i: s.encode() for s, i in self.special.items()})
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.merges = {(raw(a), raw(b)): rank for rank, (a, b) in enumerate(pairs)}
        #: the longest token by its first three bytes
        self.longest: dict[bytes, int] = {}
        for token in self.ids:
            self.longest[token[:3]] = max(len(token), self.longest.get(token[:3], 0))
        self.size = max(self.bytes_of, default=0) + 1
        self.byte_ids = [self.ids.get(bytes([b])) for b in range(256)]
        #: rank and result of each merge, by the pair of ids
        self.steps = {
            self.ids[a] * self.size + self.ids[b]: rank << ID_BITS | self.ids[a + b]
            for (a, b), rank in self.merges.items()
        }
        self.pair_fits: dict[int, bool] = {}
        #: ids of each word, comma-joined
        self.words: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.long: list[str] = []
        #: what the ids of a word decode to, where that is not the word
        self.odd: dict[str, str] = {}
        self.cut = regex.compile(WORD_PATTERN).findall
        named = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, named)) + ")") if named else None

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: the best-ranked adjacent pair first, the leftmost of equals."""
        if len(word) > 256:
            return self._merged_long([word[i : i + 1] for i in range(len(word))])
        ids, n, rank_of = [self.byte_ids[b] for b in word], self.size, self.steps.get
        ranks = [rank_of(a * n + b, NEVER) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != NEVER:
            i = ranks.index(best)
            ids[i] = best & ID_MASK
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of(ids[i - 1] * n + ids[i], NEVER)
            if i < len(ranks):
                ranks[i] = rank_of(ids[i] * n + ids[i + 1], NEVER)
        return ids

    def _merged_long(self, parts: list[bytes]) -> list[int]:
        """The same with a heap over a linked list, for words of any length."""
        import heapq

        n = len(parts)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        rank_of, alive = self.merges.get, [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank_of((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = a + b, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if right < n and (r := rank_of((parts[left], parts[right]))) is not None:
                    heapq.heappush(heap, (r, left, parts[left], parts[right]))
        return [self.ids[p] for p, live in zip(parts, alive) if live]

    def proposed(self, word: bytes) -> list[int]:
        """Greedy cut into the longest tokens."""
        found, at, n, ids = [], 0, len(word), self.ids
        while at < n:
            start = word[at : at + 3]
            # Without a token of three bytes or more, two bytes and one are left.
            for end in range(min(n, at + self.longest.get(start, 2)), at, -1):
                if (token := ids.get(word[at:end])) is not None:
                    break
            found.append(token)
            at = end
        return found

    def learn(self, words: list[str]) -> None:
        """Encode words not seen before: propose, check every pair, merge what fails."""
        raw = [w.encode() for w in words]
        cuts = [self.proposed(w) for w in raw]
        sizes = np.fromiter(map(len, cuts), np.int64, len(cuts))
        flat = np.fromiter((t for c in cuts for t in c), np.int64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        keys = flat[:-1] * self.size + flat[1:]
        inside = np.ones(len(keys), bool)
        inside[ends[:-1] - 1] = False
        owner = np.repeat(np.arange(len(cuts)), sizes)[:-1][inside]
        pairs, where = np.unique(keys[inside], return_inverse=True)
        fits = np.ones(len(pairs), bool)
        known = self.pair_fits
        if len(known) > CACHED_PAIRS:
            known.clear()
        for i, key in enumerate(pairs.tolist()):
            if (fit := known.get(key)) is None:
                a, b = divmod(key, self.size)
                fit = known[key] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
            fits[i] = fit
        failing = set(owner[~fits[where]].tolist())
        alone = sizes == 1
        for i, (word, cut) in enumerate(zip(words, cuts)):
            if i in failing or (alone[i] and len(raw[i]) > 1 and not self._own(cut[0])):
                cut = self.merged(raw[i])
            self.words[word] = ",".join(map(str, cut))
            if (back := self.decode(cut)) != raw[i]:
                self.odd[word] = back.decode("utf-8", "replace")

    def _own(self, token: int) -> bool:
        """Whether merging a token's own bytes gives the token."""
        key = -1 - token
        if (fit := self.pair_fits.get(key)) is None:
            fit = self.pair_fits[key] = self.merged(self.bytes_of[token]) == [token]
        return fit

    def decode(self, ids: list[int]) -> bytes:
        """The bytes behind token ids."""
        return b"".join(self.bytes_of[i] for i in ids)

    def pieces(self, text: str) -> list[str]:
        """Words of a text; special tokens stand for themselves."""
        if self.marks is None or not any(s in text for s in self.special):
            return self.cut(text)
        found = []
        for part in self.marks.split(text):
            found += [part] if part in self.special else self.cut(part)
        return found

    def _know(self, cut: list[list[str]]) -> None:
        """See to it that the cache holds every word of ``cut``."""
        for w in self.long:
            self.words.pop(w, None)
            self.odd.pop(w, None)
        fresh = {w for words in cut for w in words if w not in self.words}
        if len(self.words) + len(fresh) > CACHED_WORDS and self.words:
            self.older, self.words = self.words, {}
            fresh = {w for words in cut for w in words}
        self.long = [w for w in fresh if len(w) > CACHED_LETTERS]
        for w in [w for w in fresh if w in self.older]:
            self.words[w] = self.older[w]
            fresh.discard(w)
        for mark in fresh & self.special.keys():
            self.words[mark] = str(self.special[mark])
            fresh.discard(mark)
        if fresh:
            self.learn(sorted(fresh))

    def run(self, texts: list[str]) -> Iterator[tuple[str, int, str]]:
        """(ids joined by commas, their number, decoded text) of each text."""
        at = 0
        while at < len(texts):
            end, held = at, 0
            while end < len(texts) and (end == at or held + len(texts[end]) <= TEXT_AT_ONCE):
                held += len(texts[end])
                end += 1
            cut = [self.pieces(text) for text in texts[at:end]]
            self._know(cut)
            at, words, odd = end, self.words, self.odd
            for pieces in cut:
                ids = ",".join([words[w] for w in pieces])
                back = "".join([odd.get(w, w) for w in pieces] if odd else pieces)
                yield ids, ids.count(",") + 1 if ids else 0, back


_CODECS: dict[int, Codec] = {}


def _codec(vocabulary: str) -> Codec:
    key = hash(vocabulary)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(vocabulary)
    return _CODECS[key]


def read_vocabulary(path: str) -> str:
    """The vocabulary file as text, on the driver; its size is checked before it is sent."""
    with open(path, encoding="utf-8") as file:
        text = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(text) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than a vocabulary may be")
    return text


CODED = T.StructType(
    [
        T.StructField("ids", T.StringType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("decoded", T.StringType()),
    ]
)


def encode_decode(docs: DataFrame, vocabulary_path: str, text_col: str = "text", into: str = "coded") -> DataFrame:
    """``docs`` with a struct column ``into``: ids (decimal, comma-joined), n_tokens, decoded.

    A NULL text counts as empty: no ids, zero tokens, empty decoded text. Every other
    column stays as it is; a column named as ``into`` is replaced. Rows are independent,
    so repeated rows and ids need nothing special, and an empty table stays empty.
    """
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    @F.pandas_udf(CODED)
    def coded(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(sent.value)
        for texts in parts:
            done = list(codec.run(["" if t is None else t for t in texts]))
            yield pd.DataFrame(done, columns=["ids", "n_tokens", "decoded"])

    return docs.withColumn(into, coded(F.col(text_col)))

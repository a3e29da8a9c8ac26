"""Alignment of two tokenizers over the same texts.

Both tokenizers cut the bytes of a text; where tokens of both end, the text falls into
groups. The shorter list of token ends gallops through the longer one: every end starts
at its proportional place, brackets its rank by steps that double, and closes the bracket by
bisection, all ends in lockstep. Ends found are common and slice the groups; the ranks
before and after a token give the range of tokens of the other side that it overlaps.

A single space between marks starts a token on both sides, whatever stands before it: texts
fall into chunks there, and equal chunks are aligned alike. Each worker keeps what it knows
of chunks (a cache of bounded size; nothing is lost with it) and aligns the new ones of some
texts as one run.

Texts become batches of bounded bytes, one row per batch: the links of its documents as a
sparse matrix over the pairs of ids that the batch holds, and how many of its documents hold
each. Those counts are summed over all batches by pair, and every batch asks for those of its
own pairs by a join: one row per batch and pair, so that a common pair weighs no more than the
number of batches, and nothing whose size follows the corpus is sent to all tasks.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberfall.llm import blobs
from emberfall.llm.bpe_codec import WORD_PATTERN, byte_alphabet, read_vocabulary
from emberfall.llm.words import bound_batches
from emberfall.workspace import materialise

MAX_MODEL_BYTES = 64 << 20
BYTES_IN_BATCH = 6 << 20
TEXT_IN_PIECE = 1 << 19
CACHED_CHUNKS = 300_000
CACHED_LETTERS = 8 << 20
PAIRS_AT_ONCE = 2_000_000
NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """How many of ``long`` are smaller than each of ``short``; both ascend."""
    n, m = len(long), len(short)
    if not n or not m:
        return np.zeros(m, np.int64)
    start = np.arange(m) * n // m
    up = long[start] < short
    # Invariant: everything before ``low`` is smaller, nothing from ``high`` on is.
    low = np.where(up, start + 1, 0)
    high = np.where(up, n, start)
    open_, step = np.arange(m), 1
    while len(open_):
        rising = up[open_]
        probe = np.where(rising, start[open_] + step, start[open_] - step)
        inside = (probe >= 0) & (probe < n)
        open_, probe, rising = open_[inside], probe[inside], rising[inside]
        smaller = long[probe] < short[open_]
        low[open_[smaller]] = probe[smaller] + 1
        high[open_[~smaller]] = probe[~smaller]
        open_, step = open_[smaller == rising], step * 2
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        smaller = long[middle] < short[open_]
        low[open_[smaller]] = middle[smaller] + 1
        high[open_[~smaller]] = middle[~smaller]
        open_ = open_[low[open_] < high[open_]]
    return low


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Common ends (their indices in a and in b), and all overlapping (a, b) as two arrays
    of indices, by token of the shorter list."""
    flip = len(ends_b) < len(ends_a)
    short, long = (ends_b, ends_a) if flip else (ends_a, ends_b)
    below = gallop(short, long)
    common = long[np.minimum(below, len(long) - 1)] == short
    first = np.concatenate([[0], (below + common)[:-1]])
    counts = below - first + 1
    of_short = np.repeat(np.arange(len(short)), counts)
    of_long = np.arange(len(of_short)) + np.repeat(first - np.cumsum(counts) + counts, counts)
    at_short, at_long = np.flatnonzero(common), below[common]
    if flip:
        return at_long, at_short, of_long, of_short
    return at_short, at_long, of_short, of_long


class Aligner:
    """Two tokenizers: a byte-level vocabulary (JSON text) and a piece model (bytes)."""

    def __init__(self, vocabulary: str, model: bytes) -> None:
        spec = json.loads(vocabulary)
        letters = byte_alphabet()
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if set(token) <= letters.keys()}
        marks = {t["content"].encode() for t in spec.get("added_tokens", [])}
        ranks = {token: i for token, i in ranks.items() if token not in marks or len(token) == 1}
        self.a = tiktoken.Encoding("a", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        size_a, self.size_b = max(ranks.values()) + 1, self.b.get_piece_size()
        self.bytes_a = [b""] * size_a
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.bytes_b = []
        pieces = [self.b.id_to_piece(i) for i in range(self.size_b)]
        for i, piece in enumerate(pieces):
            is_byte = self.b.is_byte(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if is_byte else piece.replace("▁", " ").encode())
        self.len_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.len_b = np.array([len(x) for x in self.bytes_b], np.int64)
        #: decimal ids, each with the separators that may follow
        self.said = [f"{i}{sep}" for i in range(max(size_a, self.size_b)) for sep in ",|;"]
        # No piece goes on across a space, and no pattern of the other side does.
        self.seam = None if any(re.search("[^▁]▁", p) for p in pieces) else re.compile(r"(?<=\S) (?=\S)")
        self.forget()

    def forget(self) -> None:
        """Empty the table of chunks: their numbers, counts, pairs and groups."""
        self.known: dict[str, int] = {}
        self.letters = 0
        self.groups: list[str] = []
        self.counts = np.zeros((0, 4), np.int64)
        self.fine = np.zeros(0, bool)
        #: pairs of each chunk, one after the other, by their number in ``codes``
        self.n_pairs, self.pairs = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pair_of: dict[int, int] = {}
        self.codes = np.zeros(0, np.int64)

    def cut(self, text: str) -> Iterator[str]:
        """A long text in pieces that are aligned on their own, each after its space."""
        at = 0
        while self.seam is not None and len(text) - at > 2 * TEXT_IN_PIECE:
            seam = self.seam.search(text, at + TEXT_IN_PIECE)
            if seam is None:
                break
            yield text[at : seam.start()]
            at = seam.end()
        yield text[at:]

    def learn(self, chunks: list[str]) -> None:
        """Put chunks into the table. Those with blanks at an end are aligned one by one."""
        inner = [c for c in chunks if not c[0].isspace() and not c[-1].isspace()]
        self.fresh: list[tuple[np.ndarray, ...]] = []
        self.new_codes, self.n_codes = [self.codes], len(self.codes)
        for run in [inner, *[[c] for c in chunks if c[0].isspace() or c[-1].isspace()]]:
            while run:
                run = self._run(run)
        table = [(self.counts, self.fine, self.n_pairs, self.pairs), *self.fresh]
        self.counts, self.fine, self.n_pairs, self.pairs = (np.concatenate(x) for x in zip(*table))
        self.codes = np.concatenate(self.new_codes)
        self.letters += sum(map(len, chunks))

    def _run(self, chunks: list[str]) -> list[str]:
        """Align chunks as one text; those that are left for another run. Where the tokens of
        a run do not join to its text, it is halved until the chunk to blame is alone."""
        text = " ".join(chunks)
        raw = b" " + text.encode()
        ids_a, ids_b = self.a.encode_ordinary(" " + text), self.b.encode(text)
        if not b"".join(map(self.bytes_a.__getitem__, ids_a)) == raw == b"".join(map(self.bytes_b.__getitem__, ids_b)):
            if len(chunks) == 1:
                self._add(chunks, np.zeros((1, 4), np.int64), False, np.zeros(1, np.int64), np.zeros(0, np.int64), [""])
                return []
            rest = chunks[: len(chunks) // 2]
            while rest:
                rest = self._run(rest)
            return chunks[len(chunks) // 2 :]
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        ends_a = np.cumsum(self.len_a[a])
        at_a, at_b, of_a, of_b = overlaps(ends_a, np.cumsum(self.len_b[b]))
        ends = np.cumsum([len(c.encode()) + 1 for c in chunks])
        last = np.searchsorted(ends_a[at_a], ends)
        # Where each token goes in the list of groups, and which separator follows it.
        sizes_a, sizes_b = np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1)
        out = np.zeros(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + np.repeat(at_b + 1 - sizes_b, sizes_a)] = a * 3
        out[np.arange(len(b)) + np.repeat(at_a + 1, sizes_b)] = b * 3
        closes = at_a + at_b + 1
        out[closes] += 2
        out[closes - sizes_b] += 1
        told = list(map(self.said.__getitem__, out.tolist()))
        n_a, n_b = np.diff(at_a[last], prepend=-1), np.diff(at_b[last], prepend=-1)
        owner = np.searchsorted(at_a[last], of_a)
        order = np.argsort(owner, kind="stable")
        n_links = np.bincount(owner, minlength=len(chunks))
        stops = np.cumsum(n_a + n_b)
        groups = ["".join(told[x:y])[:-1] for x, y in zip((stops - n_a - n_b).tolist(), stops.tolist())]
        codes, where = np.unique((a[of_a] * self.size_b + b[of_b])[order], return_inverse=True)
        number = np.array([self.pair_of.setdefault(c, len(self.pair_of)) for c in codes.tolist()], np.int64)
        if len(self.pair_of) > self.n_codes:
            self.new_codes.append(codes[number >= self.n_codes])
            self.n_codes = len(self.pair_of)
        counts = np.stack([n_a, n_b, np.diff(last, prepend=-1), n_links], axis=1)
        self._add(chunks, counts, True, n_links, number[where], groups)
        return []

    def _add(self, chunks: list[str], counts: np.ndarray, fine: bool, n_pairs: np.ndarray, pairs: np.ndarray, groups: list[str]) -> None:
        self.known.update(zip(chunks, range(len(self.known), len(self.known) + len(chunks))))
        self.groups += groups
        self.fresh.append((counts, np.full(len(chunks), fine), n_pairs, pairs))

    def parts(self, texts: list[str]) -> Iterator[tuple[np.ndarray | None, str, np.ndarray, np.ndarray]]:
        """(counts, groups, codes, times linked) of texts that are not empty; counts None if
        the tokens of one side do not join to the text."""
        if len(self.known) > CACHED_CHUNKS or self.letters > CACHED_LETTERS:
            self.forget()
        cut = [self.seam.split(t) if self.seam else [t] for t in texts]
        flat = [c for chunks in cut for c in chunks]
        if fresh := [c for c in dict.fromkeys(flat) if c not in self.known]:
            self.learn(fresh)
        ids = [self.known[c] for c in flat]
        at = np.array(ids, np.int64)
        sizes = np.array(list(map(len, cut)), np.int64)
        stops = np.cumsum(sizes)
        counts = np.add.reduceat(self.counts[at], stops - sizes, axis=0)
        fine = np.logical_and.reduceat(self.fine[at], stops - sizes)
        # Distinct chunks of each text, then distinct pairs of those.
        owner = np.repeat(np.arange(len(texts)), sizes)
        keys, times = np.unique(owner << 32 | at, return_counts=True)
        owner, at = keys >> 32, keys & ((1 << 32) - 1)
        n = self.n_pairs[at]
        first = (np.cumsum(self.n_pairs) - self.n_pairs)[at]
        pair = self.pairs[np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)]
        keys, where = np.unique(np.repeat(owner, n) << 32 | pair, return_inverse=True)
        times = np.bincount(where, np.repeat(times, n)).astype(np.int64)
        codes = self.codes[keys & ((1 << 32) - 1)]
        ends = np.searchsorted(keys >> 32, np.arange(len(texts)), side="right")
        low = 0
        for i, (stop, end) in enumerate(zip(stops.tolist(), ends.tolist())):
            groups = ";".join(map(self.groups.__getitem__, ids[stop - len(cut[i]) : stop]))
            yield (counts[i] if fine[i] else None), groups, codes[low:end], times[low:end]
            low = end

    def align(self, texts: list[str | None], digest: bool) -> list[tuple[list[int], str, np.ndarray, np.ndarray]]:
        """([n_a, n_b, n_groups, n_links], groups, codes of distinct pairs, times each is
        linked) of each text."""
        done = [[np.zeros(4, np.int64), hashlib.sha256(), [], [], True] for _ in texts]
        waiting: list[tuple[int, str]] = []

        def work() -> None:
            for (i, _), (counts, groups, codes, times) in zip(waiting, self.parts([t for _, t in waiting])):
                one = done[i]
                if counts is None or not one[4]:
                    one[4] = False
                    continue
                said = (";" if one[0][0] else "") + groups
                one[1].update(said.encode())
                one[0] += counts
                if not digest:
                    one[2].append(said)
                one[3].append((codes, times))
            waiting.clear()

        held = 0
        for i, text in enumerate(texts):
            for part in self.cut(text) if text else ():
                waiting.append((i, part))
                held += len(part)
                if held > TEXT_IN_PIECE:
                    work()
                    held = 0
        if waiting:
            work()
        out = []
        for n, seen, said, pairs, fine in done:
            if not fine or not n[0]:
                out.append(([0, 0, 0, 0], "", np.empty(0, np.int64), np.empty(0, np.int64)))
                continue
            codes, times = pairs[0]
            if len(pairs) > 1:
                codes, where = np.unique(np.concatenate([c for c, _ in pairs]), return_inverse=True)
                times = np.bincount(where, np.concatenate([t for _, t in pairs])).astype(np.int64)
            out.append((n.tolist(), seen.hexdigest() if digest else "".join(said), codes, times))
        return out


_ALIGNERS: dict[int, Aligner] = {}


def _aligner(vocabulary: str, model: bytes) -> Aligner:
    key = hash((vocabulary, model))
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(vocabulary, model)
    return _ALIGNERS[key]


def read_model(path: str) -> bytes:
    """The model file, on the driver; its size is checked before it is sent."""
    with open(path, "rb") as file:
        model = file.read(MAX_MODEL_BYTES + 1)
    if len(model) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} is larger than a model may be")
    return model


def packed(numbers: np.ndarray) -> np.ndarray:
    """Whole numbers that are not negative, in the narrowest type that holds them."""
    return numbers.astype(np.min_scalar_type(int(numbers.max()) if len(numbers) else 0))


def packed_batch(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[bytes, bytes]:
    """Links of a batch's documents: (matrix, pairs) as cells. The matrix holds, document by
    document, steps between the numbers of its pairs and how often each is linked; the
    pairs are steps between the codes, and how many documents hold each."""
    sizes = np.array([len(codes) for codes, _ in found], np.int64)
    codes = np.concatenate([codes for codes, _ in found])
    pairs, at, holders = np.unique(codes, return_inverse=True, return_counts=True)
    order = np.lexsort((at, np.repeat(np.arange(len(sizes)), sizes)))
    at = at[order]
    steps = np.diff(at, prepend=0)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    steps[starts] = at[starts]
    times = np.concatenate([times for _, times in found])[order]
    matrix = blobs.pack(packed(sizes), packed(steps), packed(times))
    return matrix, blobs.pack(packed(np.diff(pairs, prepend=0)), packed(holders))


def unpacked_pairs(cell: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, holders = blobs.unpack(cell)
    return np.cumsum(steps, dtype=np.int64), holders.astype(np.int64)


def weighed(matrix: bytes, counts: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n_best, count_sum) of a batch's documents, from count and flag of each of its pairs."""
    sizes, steps, times = (x.astype(np.int64) for x in blobs.unpack(matrix))
    ends = np.cumsum(sizes)
    total = np.cumsum(steps)
    # Steps restart with each document.
    before = np.concatenate([[0], total])[ends - sizes]
    at = total - np.repeat(before, sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    n_best, count_sum = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    np.add.at(n_best, owner, times * best[at])
    np.add.at(count_sum, owner, times * counts[at])
    return n_best, count_sum


def _weighed_table(batch: dict, counts: np.ndarray, best: np.ndarray, schema: pa.Schema) -> pa.Table:
    n_best, count_sum = weighed(batch["matrix"], counts, best)
    columns = {**{c: batch[c] for c in ("row_id", *NUMBERS, "groups")}, "n_best": n_best, "count_sum": count_sum}
    return pa.table({f.name: pa.array(columns[f.name], f.type) for f in schema}, schema=schema)


def align_tokenizers(
    docs: DataFrame,
    vocabulary_path: str,
    model_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): tokens A of space + text by a byte-level vocabulary, against tokens B
    of the text by a piece model that puts the space before it.

    documents: one row per row of ``docs``: its id, n_a and n_b (tokens), n_groups, n_links
    (overlapping token occurrences), n_best (links whose pair is held by as many documents as
    any of its A id), count_sum (documents that hold the pair, summed over links), groups: ids as
    ``a1,a2|b1;a3|b2,b3``, or their SHA-256 with ``digest``. pairs: (a_id, b_id, n_docs, best),
    for the whole table.

    Texts that are NULL or empty, or whose tokens of either side do not join to space + text,
    have no tokens: zeros and empty groups. Strings of special tokens are plain text. Rows
    that repeat count each; NULL ids keep their rows; an empty table gives empty results; other
    columns are not carried.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    sent = spark.sparkContext.broadcast((read_vocabulary(vocabulary_path), read_model(model_path)))
    id_type = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).cast("string").alias("text"))
    lists = [T.StructField(c, T.ArrayType(kind)) for c, kind in [("row_id", id_type), *[(c, T.LongType()) for c in NUMBERS], ("groups", T.StringType())]]
    batch_type = T.StructType([T.StructField("batch", T.LongType()), *lists, T.StructField("matrix", T.BinaryType()), T.StructField("pairs", T.BinaryType())])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*sent.value)
        task, number, ids, texts, held = TaskContext.get().partitionId(), 0, [], [], 0

        def batch() -> pa.RecordBatch:
            found = aligner.align(texts, digest)
            matrix, pairs = packed_batch([x[2:] for x in found])
            row_id = pa.concat_arrays(ids)
            columns = {
                "batch": pa.array([task << 32 | number]),
                "row_id": pa.ListArray.from_arrays(pa.array([0, len(row_id)], pa.int32()), row_id),
                **{c: pa.array([[x[0][k] for x in found]], pa.list_(pa.int64())) for k, c in enumerate(NUMBERS)},
                "groups": pa.array([[x[1] for x in found]], pa.list_(pa.string())),
                "matrix": pa.array([matrix], pa.binary()),
                "pairs": pa.array([pairs], pa.binary()),
            }
            return pa.RecordBatch.from_pydict(columns)

        for part in parts:
            start = 0
            for i, text in enumerate(part["text"].to_pylist()):
                texts.append(text)
                held += len(text or "") + 64
                if held > BYTES_IN_BATCH:
                    ids.append(part["row_id"].slice(start, i + 1 - start))
                    yield batch()
                    start, number, ids, texts, held = i + 1, number + 1, [], [], 0
            if start < part.num_rows:
                ids.append(part["row_id"].slice(start))
        if texts:
            yield batch()

    held = materialise(rows.mapInArrow(batches, batch_type), "aligned")
    size_b = sentencepiece.SentencePieceProcessor(model_proto=sent.value[1]).get_piece_size()

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, holders, waiting = [], [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            code, at = np.unique(np.concatenate(codes), return_inverse=True)
            return code, np.bincount(at, np.concatenate(holders)).astype(np.int64)

        for part in parts:
            for cell in part["pairs"]:
                code, n = unpacked_pairs(cell.as_py())
                codes.append(code)
                holders.append(n)
                waiting += len(code)
                if waiting > PAIRS_AT_ONCE:
                    code, n = summed()
                    codes, holders, waiting = [code], [n], len(code)
                    if waiting > PAIRS_AT_ONCE // 2:
                        yield pa.RecordBatch.from_arrays([code, n], ["code", "n_docs"])
                        codes, holders, waiting = [], [], 0
        if codes:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in summed()], ["code", "n_docs"])

    counts = held.select("pairs").mapInArrow(counted, "code long, n_docs long").groupBy("code").agg(F.sum("n_docs").alias("n_docs"))
    counts = materialise(counts.withColumn("a_id", F.floor(F.col("code") / F.lit(size_b)).cast("long")), "pair-counts")
    highest = counts.groupBy("a_id").agg(F.max("n_docs").alias("most"))  # at most a row per id of A
    pairs = counts.join(highest, "a_id").select("code", "a_id", F.pmod("code", F.lit(size_b)).alias("b_id"), "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))
    pairs = materialise(pairs, "pairs")

    out = T.StructType([T.StructField("row_id", id_type), *[T.StructField(c, T.LongType()) for c in [*NUMBERS, "n_best", "count_sum"]], T.StructField("groups", T.StringType())])

    def out_schema(of: pa.DataType) -> pa.Schema:
        return pa.schema([("row_id", of), *[(c, pa.int64()) for c in [*NUMBERS, "n_best", "count_sum"]], ("groups", pa.string())])

    done = _weigh(held, pairs, out, out_schema)
    documents = done.select(F.col("row_id").alias(id_col), *NUMBERS, "n_best", "count_sum", "groups")
    return documents, pairs.drop("code")


def _weigh(held: DataFrame, pairs: DataFrame, out: T.StructType, out_schema) -> DataFrame:
    """Each batch asks for its own pairs, and gets them back in order."""

    def asked(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for batch, cell in zip(part["batch"].to_pylist(), part["pairs"]):
                code, _ = unpacked_pairs(cell.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), batch)), pa.array(code)], ["asker", "code"])

    answers = held.select("batch", "pairs").mapInArrow(asked, "asker long, code long").join(pairs, "code")
    answers = answers.select("asker", "code", "n_docs", "best")

    def told(batch: pa.Table, answer: pa.Table) -> pa.Table:
        schema = out_schema(batch.schema.field("row_id").type.value_type)
        answer = answer.sort_by("code")
        n_docs, best = answer["n_docs"].to_numpy(), answer["best"].to_numpy(zero_copy_only=False)
        return pa.concat_tables([schema.empty_table(), *[_weighed_table(x, n_docs, best, schema) for x in batch.to_pylist()]])

    return held.drop("pairs").groupBy("batch").cogroup(answers.groupBy("asker")).applyInArrow(told, out)

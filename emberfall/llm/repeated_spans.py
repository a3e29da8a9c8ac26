"""Removal of repeated byte strings: longest previous factors over suffixes, on a cluster.

A byte goes if it lies in a string of ``WINDOW`` bytes that also starts in a document with
a smaller id: where the longest previous factor of a position, counted in earlier
documents, is ``WINDOW`` or more. Suffixes are put in order, with the lengths of the common
prefixes of neighbours. Of a suffix, the nearest one before it and the nearest one after it
that belong to a smaller id are the places where its longest earlier match can start: the
shortest common prefix on the way to either is the length shared with it, and the longer
of both is the factor. Later copies go, the first stays.

Sorting all suffixes of a corpus would move ``WINDOW`` times its bytes. So only suffixes
that can have a partner are sorted:

1. Every window keeps its smallest hash of GRAM bytes (leftmost of equals). Equal
   windows keep the same gram at the same place, so a window whose gram occurs in one
   document only has no partner. Grams are compared bucket by bucket of their hash.
2. The windows that share a gram's place in a text are one string somewhat longer than
   a window. These strings, for grams of several documents, meet in buckets of the gram,
   where their suffixes are sorted and matched byte by byte. Grams so common that a
   bucket could not hold them are dealt by the window's own bytes instead.
3. What was found returns to the texts as intervals.

Work is packed: a row is a batch of numbers or texts for one bucket or one slice of
documents. What a batch can decide alone it does (a gram that two of its documents have,
a string that it holds twice), so a string that a third of all documents share
leaves each batch once. Buckets and slices are bounded in bytes and their number grows
with the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberfall.llm import blobs
from emberfall.llm.words import bound_batches
from emberfall.workspace import materialise

WINDOW = 50
GRAM = 24
# A window eight bytes at a time; the last ones overlap the ones before.
WORD_AT = (*range(0, WINDOW - 7, 8), WINDOW - 8)
SLICE_BYTES = 8 << 20
BUCKET_BYTES = 4 << 20
MOST_TASKS = 20_000
HOT_SHARE = 100_000
HOT_LEAST = 1000
PLACE_BITS = 17
PIECE = (1 << PLACE_BITS) - WINDOW
VOID = np.iinfo(np.int64).max
_BASE = 0xD1342543DE82EF95
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS = np.cumprod(np.append(np.ones(1, np.uint64), np.full(PIECE, _BASE, np.uint64)))
_INVERSES = np.cumprod(np.append(np.ones(1, np.uint64), np.full(PIECE, pow(_BASE, -1, 1 << 64), np.uint64)))
ROUTED = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("cell", pa.binary())])


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from every place on; meaningless at the last places."""
    made, whole, length, size, left = _TABLE[data], None, 0, 1, GRAM
    while True:
        if left & 1:
            if whole is None:
                whole, length = made, size
            else:
                # Both are shorter than the data by what no longer fits.
                n = len(data) - length - size + 1
                whole = whole[:n] * _power(size)
                whole += made[length : length + n]
                length += size
        left >>= 1
        if not left:
            break
        n = len(made) - size
        grown = made[:n] * _power(size)
        grown += made[size:]
        made, size = grown, size * 2
    whole ^= whole >> np.uint64(29)
    whole *= _MIX
    whole ^= whole >> np.uint64(32)
    return np.append(whole, np.zeros(len(data) - len(whole), np.uint64))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def string_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes from each start to its end that does not depend on the place."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * _POWERS[: len(data)], out=sums[1:])
    found = (sums[end] - sums[start]) * _INVERSES[start]
    found ^= found >> np.uint64(31)
    found *= _MIX
    return found ^ (found >> np.uint64(29)) ^ (end - start).astype(np.uint64)


def least_of(keys: np.ndarray, span: int) -> np.ndarray:
    """The smallest of the ``span`` keys from every place on."""
    made, whole, length, size, left = keys, None, 0, 1, span
    while True:
        if left & 1:
            if whole is None:
                whole, length = made.copy(), size
            else:
                np.minimum(whole[: len(made) - length], made[length:], out=whole[: len(made) - length])
                length += size
        left >>= 1
        if not left:
            return whole
        grown = made.copy()
        np.minimum(made[:-size], made[size:], out=grown[:-size])
        made, size = grown, size * 2


def anchors(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, gram hash, first window, last window, piece's bytes, place of the first window
    in them), by batches of pieces.

    Windows first to last, all of one text, have their smallest gram at the same place.
    Texts longer than a piece are cut into overlapping ones at fixed places.
    """
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        for at in range(0, max(len(text) - WINDOW + 1, 0), PIECE - WINDOW):
            piece = text[at : at + PIECE - 1]
            if len(piece) < WINDOW:
                continue
            if size + len(piece) > PIECE:
                yield _anchors(held)
                held, size = [], 0
            held.append((i, at, piece))
            size += len(piece)
    if held:
        yield _anchors(held)


def _anchors(held: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
    lengths = np.array([len(p) for _, _, p in held])
    starts = np.cumsum(lengths) - lengths
    hashes = gram_hashes(data)
    low = np.uint64((1 << PLACE_BITS) - 1)
    places = (least_of((hashes & ~low) | np.arange(len(data), dtype=np.uint64), WINDOW - GRAM + 1) & low).astype(np.int64)
    valid = np.ones(len(data), bool)
    for back in range(1, WINDOW):
        valid[starts + lengths - back] = False
    windows = np.flatnonzero(valid)
    at = places[windows]
    fresh = np.ones(len(windows), bool)
    fresh[1:] = (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(windows)) - 1
    piece = np.searchsorted(starts, windows[first], side="right") - 1
    shift = np.array([a for _, a, _ in held])[piece] - starts[piece]
    text = np.array([i for i, _, _ in held])[piece]
    return text, hashes[at[first]], windows[first] + shift, windows[last] + shift, data, windows[first]


def slice_of(ids: np.ndarray, slices: int) -> np.ndarray:
    mixed = ids.astype(np.uint64) * _MIX
    return ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(slices)).astype(np.int64)


def runs(sorted_values: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each value of a sorted array with its range."""
    if len(sorted_values):
        edges = np.flatnonzero(np.diff(sorted_values)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(sorted_values)]):
            yield int(sorted_values[a]), slice(a, b)


def routed(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[], [], []]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, ROUTED)], schema=ROUTED)


def rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """ids (NULL as the largest number), text keys, texts as bytes."""
    ids = batch.column(0).fill_null(VOID).to_numpy(zero_copy_only=False).astype(np.int64)
    keys = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
    return ids, keys, [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]


def pack_texts(batch: pa.RecordBatch, slices: int) -> list[tuple[int, int, bytes]]:
    """One cell per slice: id, text key, whether the id is NULL, repeats, length, bytes."""
    ids, keys, texts = rows_of(batch)
    void = np.array(batch.column(0).is_null())
    _, first, copies = np.unique(np.stack([ids, keys, void], axis=1), axis=0, return_index=True, return_counts=True)
    own = slice_of(ids[first], slices)
    order = np.argsort(own, kind="stable")
    out = []
    for part, at in runs(own[order]):
        chosen = first[order[at]]
        body = np.frombuffer(b"".join(texts[i] for i in chosen), np.uint8)
        sizes = np.array([len(texts[i]) for i in chosen], np.int64)
        cell = blobs.pack(ids[chosen], keys[chosen], void[chosen].astype(np.int64), copies[order[at]], sizes, body)
        out.append((0, part, cell))
    return out


def unpack_texts(cells: list[bytes]) -> tuple[np.ndarray, ...]:
    """ids, keys, void, copies as arrays over all cells, and the texts."""
    parts, texts = [], []
    for cell in cells:
        *numbers, sizes, body = blobs.unpack(cell)
        parts.append(numbers)
        raw, ends = body.tobytes(), np.cumsum(sizes)
        texts += [raw[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist())]
    ids, keys, void, copies = (np.concatenate(x) for x in zip(*parts))
    return ids, keys, void, copies, texts


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold a slice's bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= SLICE_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def ask_grams(batch: pa.RecordBatch, slices: int, buckets: int) -> list[tuple[int, int, bytes]]:
    """Kind 0: grams of a bucket that one id of the batch has, and how often the others
    occur. Kind 1: places of grams that several ids of the batch have, by slice."""
    ids, _, texts = rows_of(batch)
    by_id = np.argsort(ids, kind="stable")
    ids, texts = ids[by_id], [texts[i] for i in by_id]
    found = [(t, h, f) for t, h, f, *_ in anchors(texts)]
    if not found:
        return []
    text, gram, first = (np.concatenate(x) for x in zip(*found))
    # Places come by id, then by place, and stay so below.
    owner = ids[text]
    bucket = (gram % np.uint64(buckets)).astype(np.int64)
    short = (gram // np.uint64(buckets)).astype(np.uint32)
    key = bucket.astype(np.uint64) << np.uint64(32) | short
    order = np.argsort(key)
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[order][1:] != key[order][:-1]
    starts = np.flatnonzero(fresh)
    sorted_owner = owner[order]
    several = np.maximum.reduceat(sorted_owner, starts) != np.minimum.reduceat(sorted_owner, starts)
    counts = np.diff(np.append(starts, len(key)))
    shared = np.zeros(len(key), bool)
    shared[order] = several[np.cumsum(fresh) - 1]
    told, known = key[order[starts[several]]], counts[several]
    tell = {b: at for b, at in runs((told >> np.uint64(32)).astype(np.int64))}
    single = np.flatnonzero(~shared)
    single = single[np.argsort(bucket[single].astype(np.uint16 if buckets < 65536 else np.int64), kind="stable")]
    ask = {b: at for b, at in runs(bucket[single])}
    out = []
    for b in sorted(tell.keys() | ask.keys()):
        one, more = single[ask.get(b, slice(0, 0))], tell.get(b, slice(0, 0))
        steps = np.diff(owner[one], prepend=np.int64(0))
        cell = blobs.pack(
            short[one], steps, first[one].astype(np.uint32), told[more].astype(np.uint32), known[more].astype(np.uint32)
        )
        out.append((0, b, cell))
    return out + to_slices(owner[shared], first[shared], slices)


def to_slices(ids: np.ndarray, first: np.ndarray, slices: int) -> list[tuple[int, int, bytes]]:
    own = slice_of(ids, slices)
    order = np.lexsort((first, ids, own))
    return [
        (1, part, blobs.pack(np.diff(ids[order[at]], prepend=np.int64(0)), first[order[at]].astype(np.uint32)))
        for part, at in runs(own[order])
    ]


def answer_grams(cells: pa.Table, slices: int, hot_from: int) -> pa.Table:
    """Places, by slice, of grams that several ids have; kind 2 names the very common ones."""
    kind, part = cells["kind"][0].as_py(), cells["part"][0].as_py()
    if kind == 1:
        return cells
    parts = [blobs.unpack(c) for c in cells["cell"].to_pylist()]
    short = np.concatenate([p[0] for p in parts])
    owner = np.concatenate([np.cumsum(p[1]) for p in parts])
    first = np.concatenate([p[2] for p in parts]).astype(np.int64)
    told, known = (np.concatenate([p[i] for p in parts]) for i in (3, 4))
    names, place = np.unique(np.concatenate([short, told]), return_inverse=True)
    mine, theirs = place[: len(short)], place[len(short) :]
    low, high = np.full(len(names), VOID), np.full(len(names), -VOID)
    np.minimum.at(low, mine, owner)
    np.maximum.at(high, mine, owner)
    several = low < high
    several[theirs] = True
    total = np.bincount(mine, minlength=len(names)) + np.bincount(theirs, known, minlength=len(names)).astype(np.int64)
    out = to_slices(owner[several[mine]], first[several[mine]], slices)
    hot = names[total >= hot_from]
    if len(hot):
        out.append((2, part, blobs.pack(hot)))
    return routed(out)


def ask_windows(
    left: pa.Table, right: pa.Table, slices: int, buckets: int, hot: dict[int, np.ndarray]
) -> pa.Table:
    """Kind 0: strings of windows, each once with its smallest id here, by bucket of the
    gram (very common grams: window by window, by bucket of the bytes). Kind 1: intervals
    that are repeats within this slice."""
    if not left.num_rows or not right.num_rows:
        return ROUTED.empty_table()
    ids, keys, _, _, texts = unpack_texts(left["cell"].to_pylist())
    by_id = np.argsort(ids, kind="stable")
    ids, keys, texts = ids[by_id], keys[by_id], [texts[i] for i in by_id]
    asked = [blobs.unpack(c) for c in right["cell"].to_pylist()]
    wanted_ids = np.concatenate([np.cumsum(a[0]) for a in asked])
    wanted_first = np.concatenate([a[1] for a in asked]).astype(np.int64)
    known = np.unique(wanted_ids)
    wanted = np.unique(np.searchsorted(known, wanted_ids) << 32 | wanted_first)
    found = []
    for text, gram, first, last, data, place in anchors(texts):
        at = np.searchsorted(known, ids[text])
        at[at == len(known)] = 0
        code = at << 32 | first
        spot = np.searchsorted(wanted, code)
        spot[spot == len(wanted)] = 0
        chosen = np.flatnonzero((known[at] == ids[text]) & (wanted[spot] == code))
        text, gram, first, last, place = (x[chosen] for x in (text, gram, first, last, place))
        bucket = (gram % np.uint64(buckets)).astype(np.int64)
        common = np.zeros(len(chosen), bool)
        for b in np.intersect1d(bucket, list(hot)).tolist() if hot else []:
            common |= (bucket == b) & np.isin((gram // np.uint64(buckets)).astype(np.uint32), hot[b])
        size = last - first + WINDOW
        if common.any():
            # One string per window instead, each to the bucket of its own bytes.
            times = np.where(common, size - WINDOW + 1, 1)
            of = np.repeat(np.arange(len(chosen)), times)
            step = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
            text, bucket, split = text[of], bucket[of], common[of]
            first, place, size = first[of] + step, place[of] + step, np.where(split, WINDOW, size[of])
            mark = string_hashes(data, place, place + size)
            bucket = np.where(split, (mark % np.uint64(buckets)).astype(np.int64), bucket)
        else:
            mark = string_hashes(data, place, place + size)
        found.append((text, first, size, bucket, mark))
    text, first, size, bucket, mark = (np.concatenate(x) for x in zip(*found))
    if not len(text):
        return ROUTED.empty_table()
    body = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    start = (np.cumsum(lengths) - lengths)[text] + first
    owner = ids[text]
    # Places come by id, then by place; so the head of equal strings has the smallest id.
    order = np.argsort(mark, kind="stable")
    text, first, size, bucket, mark, start, owner = (x[order] for x in (text, first, size, bucket, mark, start, owner))
    fresh = np.ones(len(text), bool)
    fresh[1:] = mark[1:] != mark[:-1]
    head = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    # Equal hashes may hide other bytes; such a string stands for itself.
    same = (size == size[head]) & (bucket == bucket[head])
    check = np.flatnonzero(same & ~fresh)
    for c in range(2 * WINDOW - GRAM):
        inside = check[c < size[check]]
        same[inside] &= body[start[inside] + c] == body[start[head[inside]] + c]
    late = same & (owner > owner[head])
    heads = np.flatnonzero(~same | fresh)
    heads = heads[np.argsort(bucket[heads], kind="stable")]
    number = np.zeros(len(text), np.int64)
    number[heads] = np.arange(len(heads))
    open_ = np.flatnonzero(~late)
    of_entry = np.where(same[open_], number[head[open_]], number[open_])
    by_entry = np.argsort(of_entry, kind="stable")
    open_, of_entry = open_[by_entry], of_entry[by_entry]
    out = []
    for part, at in runs(bucket[heads]):
        mine = heads[at]
        total = np.cumsum(size[mine])
        bytes_at = np.repeat(start[mine] - (total - size[mine]), size[mine]) + np.arange(total[-1])
        low, high = np.searchsorted(of_entry, [at.start, at.stop])
        spots = open_[low:high]
        cell = blobs.pack(
            body[bytes_at],
            size[mine].astype(np.int32),
            owner[mine],
            (of_entry[low:high] - at.start).astype(np.int32),
            keys[text[spots]],
            first[spots].astype(np.uint32),
        )
        out.append((0, part, cell))
    gone = np.flatnonzero(late)
    if len(gone):
        out += spans_to_slices(owner[gone], keys[text[gone]], first[gone], first[gone] + size[gone], slices)
    return routed(out)


def spans_to_slices(ids: np.ndarray, keys: np.ndarray, start: np.ndarray, end: np.ndarray, slices: int) -> list:
    """Intervals by slice; those of a row that touch are one."""
    own = slice_of(ids, slices)
    order = np.lexsort((start, keys, ids, own))
    own, ids, keys, start, end = (x[order] for x in (own, ids, keys, start, end))
    row = np.zeros(len(ids), np.int64)
    row[1:] = np.cumsum((ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]) | (own[1:] != own[:-1]))
    # The furthest end so far within the row: rows are set far apart on one line.
    far = np.int64(1) << 32
    reach = np.maximum.accumulate(end + row * far)
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (start + row * far)[1:] > reach[:-1]
    head = np.flatnonzero(fresh)
    last = reach[np.append(head[1:], len(ids)) - 1] - row[head] * far
    own, ids, keys, start = own[head], ids[head], keys[head], start[head]
    return [
        (1, part, blobs.pack(ids[at], keys[at], start[at].astype(np.uint32), last[at].astype(np.uint32)))
        for part, at in runs(own)
    ]


def common_prefixes(words: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Bytes that each suffix in ``order`` shares with the one before it; 0 for the first.

    ``words``: the bytes as big-endian numbers at the places of ``WORD_AT``.
    """
    shared = np.full(len(order), WINDOW, np.int64)
    open_ = np.arange(1, len(order))
    for at, word in zip(WORD_AT, words):
        differ = word[order[open_]] ^ word[order[open_ - 1]]
        apart = differ != 0
        some, differ = open_[apart], differ[apart]
        equal = sum((differ < np.uint64(1 << (64 - 8 * k))).astype(np.int64) for k in range(1, 8))
        shared[some] = at + equal
        open_ = open_[~apart]
    shared[:1] = 0
    return shared


def nearest_smaller(ids: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Bytes that each suffix shares with the nearest one before it of a smaller id; 0 if none.

    Each looks at the suffix before it; while that one's id is not smaller, it goes on to
    where that one has got to, all at once, and keeps the shortest common prefix.
    """
    n = len(ids)
    # One place before all others, of an id smaller than all.
    ids = np.append(ids, np.iinfo(np.int64).min)
    to, least = np.append(np.arange(-1, n - 1), n), np.append(shared, 0)
    to[:1] = n
    open_ = np.flatnonzero((to[:n] < n) & (ids[to[:n]] >= ids[:n]))
    while len(open_):
        over = to[open_]
        least[open_] = np.minimum(least[open_], least[over])
        to[open_] = to[over]
        open_ = open_[ids[to[open_]] >= ids[open_]]
    return np.where(to[:n] < n, least[:n], 0)


def longest_previous_factors(words: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
    """For suffixes cut after a window, how many bytes each shares at most with one of a
    smaller id: by the previous and the next such suffix in order."""
    order = np.lexsort(words[::-1])
    shared, ids = common_prefixes(words, order), ids[order]
    before = nearest_smaller(ids, shared)
    # Seen from the other end, a suffix shares with its neighbour what that one shares with it.
    after = nearest_smaller(ids[::-1], np.append(shared[1:], 0)[::-1])[::-1]
    factors = np.zeros(len(ids), np.int64)
    factors[order] = np.maximum(before, after)
    return factors


def previous_factors(words: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
    """Whether the longest previous factor of each suffix is a window.

    A suffix whose hash is alone has none of that length and is left out of the order.
    """
    found = np.zeros(len(ids), bool)
    mark = words[0] * _MIX
    for i, word in enumerate(words[1:], 2):
        mark ^= mark >> np.uint64(32)
        mark += word * _power(i)
    by_mark = np.argsort(mark)
    equal = mark[by_mark][1:] == mark[by_mark][:-1]
    some = by_mark[np.append(equal, False) | np.append(False, equal)]
    found[some] = longest_previous_factors([w[some] for w in words], ids[some]) >= WINDOW
    return found


def answer_windows(cells: pa.Table, slices: int) -> pa.Table:
    """Intervals, by slice, whose windows also start in a document of a smaller id."""
    if cells["kind"][0].as_py() == 1:
        return cells
    data, lengths, owners, entry, key, at = [], [], [], [], [], []
    n = 0
    for cell in cells["cell"].to_pylist():
        body, size, owner, of, k, a = blobs.unpack(cell)
        data.append(body)
        lengths.append(size)
        owners.append(owner)
        entry.append(of.astype(np.int64) + n)
        key.append(k)
        at.append(a.astype(np.int64))
        n += len(size)
    data, lengths, owners, entry, key, at = (np.concatenate(x) for x in (data, lengths, owners, entry, key, at))
    windows = lengths.astype(np.int64) - WINDOW + 1
    begin = np.cumsum(lengths) - lengths
    of_entry = np.repeat(np.arange(n), windows)
    offset = np.arange(len(of_entry)) - np.repeat(np.cumsum(windows) - windows, windows)
    first = begin[of_entry] + offset
    raw = data.tobytes()
    eight = np.ndarray((max(len(raw) - 7, 0),), ">u8", raw, 0, (1,))
    words = [eight[first + c].astype(np.uint64) for c in WORD_AT]
    repeated = previous_factors(words, owners[of_entry])
    hit = np.flatnonzero(repeated)
    if not len(hit):
        return ROUTED.empty_table()
    fresh = np.ones(len(hit), bool)
    fresh[1:] = (np.diff(hit) != 1) | (np.diff(of_entry[hit]) != 0)
    head = np.flatnonzero(fresh)
    tail = np.append(head[1:], len(hit)) - 1
    run_entry, run_from, run_to = of_entry[hit[head]], offset[hit[head]], offset[hit[tail]] + WINDOW
    # Every place of an entry has the entry's runs.
    order = np.argsort(entry, kind="stable")
    count = np.bincount(entry, minlength=n)
    place_of = np.cumsum(count) - count
    times = count[run_entry]
    run = np.repeat(np.arange(len(head)), times)
    step = np.arange(len(run)) - np.repeat(np.cumsum(times) - times, times)
    spot = order[place_of[run_entry[run]] + step]
    return routed(
        spans_to_slices(
            owners[run_entry[run]], key[spot], at[spot] + run_from[run], at[spot] + run_to[run], slices
        )
    )


def cut_texts(left: pa.Table, right: pa.Table) -> pa.Table:
    """Every text with its removed spans and what is left."""
    if not left.num_rows:
        return CUT.empty_table()
    ids, keys, void, copies, texts = unpack_texts(left["cell"].to_pylist())
    spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for cell in right["cell"].to_pylist():
        for i, k, a, b in zip(*(x.tolist() for x in blobs.unpack(cell))):
            spans.setdefault((i, k), []).append((a, b))
    columns: list[list] = [[], [], [], []]
    for i, k, v, n, text in zip(ids.tolist(), keys.tolist(), void.tolist(), copies.tolist(), texts):
        merged: list[list[int]] = []
        for a, b in sorted(spans.get((i, k), [])):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        at, kept = 0, []
        for a, b in merged:
            kept.append(text[at:a])
            at = b
        kept.append(text[at:])
        for _ in range(n):
            for column, value in zip(
                columns, (None if v else i, len(text), b"".join(kept), [{"start": a, "end": b} for a, b in merged])
            ):
                column.append(value)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, CUT)], schema=CUT)


CUT = pa.schema(
    [
        ("id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("kept", pa.binary()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]
)


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    slice_bytes: int = SLICE_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
    hot_from: int | None = None,
) -> DataFrame:
    """(doc_id, n_bytes, kept, spans), one row per row of ``docs``.

    ``spans``: the maximal removed runs of bytes, in order; ``kept``: the bytes that are
    left, which may cut a character. A NULL text is empty; texts shorter than a window lose
    nothing. Rows that share an id never remove each other's bytes; a NULL id counts as
    larger than any other. Repeated rows keep a row each. An empty table gives no rows.
    Other columns are not carried. The ids must be whole numbers.
    """
    bound_batches(docs.sparkSession)
    texts = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.xxhash64(F.col(text_col), F.col(text_col).isNull()).alias("key"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    (total,) = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    slices, buckets = max(1, -(-total // slice_bytes)), max(1, -(-total // bucket_bytes))
    hot_least = max(HOT_LEAST, total // HOT_SHARE) if hot_from is None else hot_from
    schema = "kind int, part long, cell binary"
    # As many tasks as slices and buckets, so that a task's share does not follow the input.
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(slices + buckets, MOST_TASKS))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            yield from routed(pack_texts(batch, slices)).to_batches()

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            yield from routed(ask_grams(batch, slices, buckets)).to_batches()

    def answered(cells: pa.Table) -> pa.Table:
        return answer_grams(cells, slices, hot_least)

    grams = texts.mapInArrow(asked, schema).repartition(tasks, "kind", "part").groupBy("kind", "part")
    grams = materialise(grams.applyInArrow(answered, schema), "shared-grams")
    # Bounded: a common gram has at least total / HOT_SHARE places.
    hot = {r.part: blobs.unpack(bytes(r.cell))[0] for r in grams.filter("kind = 2").collect()}

    def strings(left: pa.Table, right: pa.Table) -> pa.Table:
        return ask_windows(left, right, slices, buckets, hot)

    def matched(cells: pa.Table) -> pa.Table:
        return answer_windows(cells, slices)

    by_slice = texts.mapInArrow(packed, schema).repartition(tasks, "part").groupBy("part")
    spans = (
        by_slice.cogroup(grams.filter("kind = 1").repartition(tasks, "part").groupBy("part"))
        .applyInArrow(strings, schema)
        .repartition(tasks, "kind", "part")
        .groupBy("kind", "part")
        .applyInArrow(matched, schema)
    )
    spans = materialise(spans, "repeated-spans")
    cut = by_slice.cogroup(spans.repartition(tasks, "part").groupBy("part")).applyInArrow(
        cut_texts, "id long, n_bytes long, kept binary, spans array<struct<start:long,end:long>>"
    )
    return cut.withColumnRenamed("id", id_col)

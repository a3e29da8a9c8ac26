"""Running sums and maxima along arrays, and pieces of long texts, as SQL expressions.

A fold that appends to its array copies it at every step, and a substring counts the
characters before it: both are quadratic in a text with many matches. Here a running value
is that of the blocks before plus that within the block, with blocks of about the square
root of the length, and a text is cut once into blocks of characters.

The functions take and give SQL text: such expressions have many small parts, and one parse
is much cheaper than a call to the driver's JVM for each. Names of lambda variables are
given by the caller or start with ``run_``.
"""

from __future__ import annotations

CHARS_IN_BLOCK = 1024


def let(name: str, value: str, body: str) -> str:
    """``body``, in which ``name`` stands for a value that is worked out once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _running(values: str, merge: str) -> str:
    """For each value of an array of ints the merge of those before it; 0 for the first.
    ``merge``: SQL over run_x and run_y."""
    fold = lambda part: f"aggregate({part}, 0, (run_x, run_y) -> {merge})"
    block = "CAST(run_i DIV run_w AS INT)"
    whole = f"transform(sequence(0, CAST((size(run_v) - 1) DIV run_w AS INT)), run_b -> {fold('slice(run_v, run_b * run_w + 1, run_w)')})"
    heads = f"transform(run_s, (run_q, run_b) -> {fold('slice(run_s, 1, run_b)')})"
    own = fold(f"slice(run_v, {block} * run_w + 1, run_i - {block} * run_w)")
    both = merge.replace("run_x", f"get(run_h, {block})").replace("run_y", own)
    body = let("run_s", whole, let("run_h", heads, f"transform(run_v, (run_q, run_i) -> {both})"))
    body = let("run_w", "CAST(ceil(sqrt(size(run_v))) AS INT)", body)
    return let("run_v", values, f"IF(size(run_v) > 0, {body}, CAST(array() AS ARRAY<INT>))")


def sums_before(sizes: str) -> str:
    """For each of an array of ints the sum of those before it."""
    return _running(sizes, "(run_x + run_y)")


def most_before(values: str) -> str:
    """For each of an array of ints the greatest of those before it, at least 0."""
    return _running(values, "greatest(run_x, run_y)")


def blocks_of(text: str) -> str:
    """A text as an array of blocks of CHARS_IN_BLOCK characters."""
    return f"regexp_extract_all({text}, r'(?s).{{1,{CHARS_IN_BLOCK}}}', 0)"


def between(blocks: str, start: str, end: str) -> str:
    """The characters from ``start`` to before ``end`` of a text in blocks."""
    first = f"CAST({start} DIV {CHARS_IN_BLOCK} AS INT)"
    last = f"CAST(({end} - 1) DIV {CHARS_IN_BLOCK} AS INT)"
    near = f"array_join(slice({blocks}, {first} + 1, {last} - {first} + 1), '')"
    return f"IF({end} > {start}, substring({near}, {start} - {first} * {CHARS_IN_BLOCK} + 1, {end} - {start}), '')"

"""Benchmark decontamination by winnowing.

Texts are hashed in k-grams of words; of every window of consecutive k-grams the
smallest hash is kept. Two texts that share ``window`` words share the k-grams of one
window and so its smallest hash: joining the kept hashes of documents and items
misses no shared span of that length. What meets is then extended: the windows of the
document that carry the shared hash are compared word by word with those of the items.
Items shorter than a window are one window of their own length, hashed whole.

All of it is column functions. A document leaves one row per change of its smallest
hash, so the join sees a fraction of its words, and the item side is written down
first, so that Spark knows its size and broadcasts it only while it is small. Texts move
only for documents that share a hash. Rows are keyed by id and text, so that rows that
repeat an id with another text stay apart and repeated rows are worked out once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfall.llm.words import KEYS, row_key, spare_names, word_count, words_of
from emberfall.workspace import materialise

WINDOW = 10
EVENT = "array<struct<print:long,first:int,last:int,size:int>>"


def gram_hashes(hashes: Column, n: Column, size: int, tag: int | None = None) -> Column:
    """The hash of every ``size`` consecutive word hashes; needs n >= size."""
    tags = [] if tag is None else [F.lit(tag)]
    return F.transform(
        F.slice(hashes, F.lit(1), n - (size - 1)),
        lambda x, i: F.xxhash64(*tags, x, *[F.get(hashes, i + j) for j in range(1, size)]),
    )


def smallest(values: Column, n: Column, span: int) -> Column:
    """The smallest of every ``span`` consecutive values; needs n >= span."""
    if span == 1:
        return values
    return F.transform(
        F.slice(values, F.lit(1), n - (span - 1)),
        lambda x, i: F.least(x, *[F.get(values, i + j) for j in range(1, span)]),
    )


def fingerprints(texts: DataFrame, window: int, short: list[int]) -> DataFrame:
    """Rows with ``words`` become rows with (print, first, last, size): windows that start
    at ``first`` to ``last`` have the smallest hash ``print``. ``short``: sizes of whole
    short items, of which every place is hashed."""
    k = max(window // 2, 1)
    span = window - k + 1
    carried = [F.col(c) for c in texts.columns if c != "words"]
    hashed = texts.select(
        *carried, F.size("words").alias("n"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes")
    )
    n, hashes = F.col("n"), F.col("hashes")
    grams = F.when(n >= window, gram_hashes(hashes, n, k)).otherwise(F.array().cast("array<long>"))
    whole = F.array().cast(EVENT)
    for size in short:
        whole = F.concat(whole, F.when(n >= size, _places(hashes, n, size)).otherwise(F.array().cast(EVENT)))
    gramed = hashed.select(*carried, "n", grams.alias("grams"), whole.alias("whole"))
    winnowed = gramed.select(
        *carried,
        "n",
        "whole",
        F.when(n >= window, smallest(F.col("grams"), F.size("grams"), span))
        .otherwise(F.array().cast("array<long>"))
        .alias("mins"),
    )
    mins = F.col("mins")
    changes = F.when(
        n >= window,
        F.filter(F.sequence(F.lit(0), n - window), lambda s: (s == 0) | (F.get(mins, s) != F.get(mins, s - 1))),
    ).otherwise(F.array().cast("array<int>"))
    changed = winnowed.select(*carried, "n", "whole", "mins", changes.alias("changes"))
    events = F.transform(
        "changes",
        lambda s, i: F.struct(
            F.get(mins, s).alias("print"),
            s.alias("first"),
            F.coalesce(F.get("changes", i + 1) - 1, n - window).alias("last"),
            F.lit(window).alias("size"),
        ),
    ).cast(EVENT)
    return changed.select(*carried, F.inline(F.concat(events, F.col("whole"))))


def _places(hashes: Column, n: Column, size: int) -> Column:
    return F.transform(
        gram_hashes(hashes, n, size, size),
        lambda h, i: F.struct(h.alias("print"), i.alias("first"), i.alias("last"), F.lit(size).alias("size")),
    ).cast(EVENT)


def window_text(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start + 1, size), " ")


def hit_words(starts: Column) -> Column:
    """How many words the windows (first, size), sorted by start, cover."""
    state = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        starts,
        state,
        lambda done, x: F.struct(
            F.greatest(done["end"], x["first"] + x["size"]).alias("end"),
            (done["n"] + F.greatest(F.lit(0), x["first"] + x["size"] - F.greatest(done["end"], x["first"])))
            .cast("long")
            .alias("n"),
        ),
        lambda done: done["n"],
    )


def marked_windows(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(key_id, key_text, n_hit, items) of the documents with a hit, written down."""
    items = materialise(
        benchmark.select(
            F.col(item_col).cast("string").alias("item"), words_of(F.col(item_text_col)).alias("words")
        ).filter(F.size("words") > 0),
        "items",
    )
    # At most ``window - 1`` distinct sizes.
    short = sorted(
        r.size
        for r in items.filter(F.size("words") < window).select(F.size("words").alias("size")).distinct().collect()
    )
    own = F.least(F.size("words"), F.lit(window))
    windows = materialise(
        items.select("item", "words", own.alias("size"), F.explode(F.sequence(F.lit(0), F.size("words") - own)).alias("s"))
        .groupBy(window_text(F.col("words"), F.col("s"), F.col("size")).alias("passage"))
        .agg(F.collect_set("item").alias("passage_items")),
        "item-windows",
    )
    whole = F.size("words") < window
    prints = materialise(
        fingerprints(items.filter(~whole).select("words"), window, [])
        .unionByName(fingerprints(items.filter(whole).select("words"), window, short).filter(F.col("size") < window))
        .select(F.col("print").alias("item_print"), F.col("size").alias("item_size"))
        .distinct(),
        "item-prints",
    )
    texts = docs.select(F.col(text_col).alias("row_text"), *row_key(id_col, text_col))
    met = (
        fingerprints(texts.select(*KEYS, words_of(F.col("row_text")).alias("words")), window, short)
        .join(prints, (F.col("print") == F.col("item_print")) & (F.col("size") == F.col("item_size")))
        .groupBy(*KEYS)
        .agg(F.collect_set(F.struct("first", "last", "size")).alias("met"))
    )
    met = materialise(met, "met")
    places = F.flatten(
        F.transform(
            "met",
            lambda m: F.transform(
                F.sequence(m["first"], m["last"]), lambda s: F.struct(s.alias("first"), m["size"].alias("size"))
            ),
        )
    )
    tried = (
        # Texts and what met move once, by key, at every size alike.
        texts.hint("merge")
        .join(met, KEYS)
        .groupBy(*KEYS)
        .agg(F.any_value("row_text").alias("row_text"), F.any_value("met").alias("met"))
        .select(*KEYS, words_of(F.col("row_text")).alias("words"), places.alias("places"))
    )
    passages = tried.select(
        *KEYS,
        F.inline(
            F.transform(
                "places",
                lambda p: F.struct(
                    p["first"].alias("first"),
                    p["size"].alias("size"),
                    window_text(F.col("words"), p["first"], p["size"]).alias("passage"),
                ),
            )
        ),
    )
    hits = (
        passages.join(windows, "passage")
        .groupBy(*KEYS)
        .agg(
            F.collect_set(F.struct("first", "size")).alias("starts"),
            F.collect_set("passage_items").alias("hit_items"),
        )
        .select(
            *KEYS,
            hit_words(F.array_sort("starts")).alias("n_hit"),
            F.array_sort(F.array_distinct(F.flatten("hit_items"))).alias("items"),
        )
    )
    return materialise(hits, "hits")


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_words, n_hit, items), one row per row of ``docs``.

    ``n_hit``: words inside any occurrence of a window of an item; ``items``: sorted ids,
    as strings, of the items with such a window. NULL and empty texts have no words and
    no windows; items without words count for nothing; items without an id mark words but
    are not listed. Repeated rows and ids keep a row each; repeated items count once. Empty
    tables give no rows (no documents) or no hits (no items). Other columns are not carried.
    """
    hits = marked_windows(docs, benchmark, window, id_col, text_col, item_col, item_text_col)
    rows = docs.select(
        F.col(id_col).alias("row_id"),
        *row_key(id_col, text_col),
        word_count(F.col(text_col)).alias("n_words"),
    )
    return rows.join(hits, KEYS, "left").select(
        F.col("row_id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def keep_clean(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` without a hit, all columns as they are."""
    hits = marked_windows(docs, benchmark, window, id_col, text_col)
    own = spare_names(docs.columns, KEYS)
    keyed = docs.select("*", *[k.alias(name) for k, name in zip(row_key(id_col, text_col), own)])
    hits = hits.select(*[F.col(k).alias(name) for k, name in zip(KEYS, own)])
    return keyed.join(hits, own, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])

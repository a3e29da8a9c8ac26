"""License scans: ordered signature rules, gated by keywords, overlaps resolved.

Texts are normalised to words between single spaces. A rule is a priority, a label, a
keyword and a pattern of words; the rules come from a table of licence bodies, and from
one of names and one of wordings. A text is tried only against rules whose keyword is among its words.
Of the places found, one that lies inside a longer one (or takes the same place with
less priority) is suppressed; of two neighbours that still overlap, the one with the
better priority stays, the earlier one if they are equal. The three base phrases are
counted apart, over every text, and their labels always stay.

All of it is column functions. Rules are literals of the plan. The text is not shuffled:
only the places found are, keyed by the row's id and text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberfall.llm.runs import let, sums_before
from emberfall.llm.words import KEYS, row_key, words_of
from emberfall.workspace import materialise

# The base phrases and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
BASE_SCORE = 0.9

# Licence names: label, keyword every mention has, pattern of the name in normalised words.
NAMES = [
    ("mit", "mit", "mit"),
    ("mit-0", "mit", "mit (?:0|no attribution)"),
    ("x11", "x11", "x11"),
    ("apache-1", "apache", "apache(?: software)?(?: licen[sc]e)?(?: version| v)? 1(?: [01])?"),
    ("apache-2", "apache", "apache(?: software)?(?: licen[sc]e)?(?: version| v)? 2(?: 0)?"),
    ("gpl-1", "gnu", "gnu general public licen[sc]e(?: version| v)? 1(?: 0)?"),
    ("gpl-2", "gnu", "gnu general public licen[sc]e(?: version| v)? 2(?: 0)?"),
    ("gpl-3", "gnu", "gnu general public licen[sc]e(?: version| v)? 3(?: 0)?"),
    ("gpl-2", "gpl", "gpl(?: version| v)? 2(?: 0)?"),
    ("gpl-3", "gpl", "gpl(?: version| v)? 3(?: 0)?"),
    ("gpl-2", "gplv2", "gplv2"),
    ("gpl-3", "gplv3", "gplv3"),
    ("lgpl-2.1", "gnu", "gnu (?:lesser|library) general public licen[sc]e(?: version| v)? 2(?: [01])?"),
    ("lgpl-3", "gnu", "gnu lesser general public licen[sc]e(?: version| v)? 3(?: 0)?"),
    ("lgpl-2.1", "lgpl", "lgpl(?: version| v)? 2(?: 1)?"),
    ("lgpl-3", "lgpl", "lgpl(?: version| v)? 3(?: 0)?"),
    ("agpl-3", "affero", "(?:gnu )?affero general public licen[sc]e(?: version| v)? 3(?: 0)?"),
    ("agpl-3", "agpl", "agpl(?: version| v)? 3(?: 0)?"),
    ("gfdl-1", "gnu", "gnu free documentation licen[sc]e(?: version| v)? 1(?: [0-3])?"),
    ("mpl-1.1", "mozilla", "mozilla public licen[sc]e(?: version| v)? 1(?: [01])?"),
    ("mpl-2", "mozilla", "mozilla public licen[sc]e(?: version| v)? 2(?: 0)?"),
    ("mpl-2", "mpl", "mpl(?: version| v)? 2(?: 0)?"),
    ("bsd-2", "bsd", "(?:bsd 2 clause|2 clause bsd|simplified bsd)"),
    ("bsd-3", "bsd", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)"),
    ("bsd-4", "bsd", "(?:bsd 4 clause|4 clause bsd|original bsd)"),
    ("bsd-0", "0bsd", "0bsd"),
    ("isc", "isc", "isc"),
    ("epl-1", "eclipse", "eclipse public licen[sc]e(?: version| v)? 1(?: 0)?"),
    ("epl-2", "eclipse", "eclipse public licen[sc]e(?: version| v)? 2(?: 0)?"),
    ("edl-1", "eclipse", "eclipse distribution licen[sc]e(?: version| v)? 1(?: 0)?"),
    ("cc-by", "cc", "cc by(?: [1-4] [05])?"),
    ("cc-by-sa", "cc", "cc by sa(?: [1-4] [05])?"),
    ("cc-by-nd", "cc", "cc by nd(?: [1-4] [05])?"),
    ("cc-by-nc", "cc", "cc by nc(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc", "cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "cc", "cc by nc nd(?: [1-4] [05])?"),
    ("cc-by", "creative", "creative commons attribution(?: [1-4] [05])?"),
    ("cc-by-sa", "creative", "creative commons attribution share(?: )?alike(?: [1-4] [05])?"),
    ("cc-by-nc", "creative", "creative commons attribution non(?: )?commercial(?: [1-4] [05])?"),
    ("cc0", "cc0", "cc0(?: 1 0)?"),
    ("cc0", "creative", "creative commons zero(?: 1 0)?"),
    ("unlicense", "unlicense", "(?:the )?unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("zlib", "zlib", "zlib(?: libpng)?"),
    ("bsl-1", "boost", "boost software licen[sc]e(?: version| v)? 1(?: 0)?"),
    ("artistic-2", "artistic", "artistic licen[sc]e(?: version| v)? 2(?: 0)?"),
    ("artistic-1", "artistic", "artistic licen[sc]e(?: version| v)? 1(?: 0)?"),
    ("psf", "python", "python software foundation"),
    ("ofl-1", "sil", "sil open font licen[sc]e(?: version| v)? 1(?: [01])?"),
    ("eupl-1", "european", "european union public licen[sc]e(?: version| v)? 1(?: [012])?"),
    ("cddl-1", "cddl", "cddl(?: version| v)? 1(?: [01])?"),
    ("osl-3", "osl", "osl(?: version| v)? 3(?: 0)?"),
    ("ms-pl", "microsoft", "microsoft public"),
    ("ms-rl", "microsoft", "microsoft reciprocal"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa"),
    ("postgresql", "postgresql", "postgresql"),
    ("openssl", "openssl", "openssl"),
    ("odbl-1", "odbl", "odbl(?: 1 0)?"),
    ("odc-by-1", "odc", "odc by(?: 1 0)?"),
    ("pddl-1", "pddl", "pddl(?: 1 0)?"),
    ("lppl-1", "lppl", "lppl(?: version| v)? 1(?: [0-3])?"),
    ("sspl-1", "sspl", "sspl(?: version| v)? 1(?: 0)?"),
    ("busl-1", "business", "business source licen[sc]e(?: version| v)? 1(?: 1)?"),
    ("elastic-2", "elastic", "elastic licen[sc]e(?: version| v)? 2(?: 0)?"),
    ("upl-1", "upl", "upl(?: version| v)? 1(?: 0)?"),
]
# Wordings: priority (lower is stronger), score, pattern around a name.
WORDINGS = [
    (1, 1.0, "spdx licen[sc]e identifier {name}"),
    (
        2,
        0.95,
        "(?:licen[sc]ed|released|distributed|available|published|provided|redistributed) under (?:the )?"
        "(?:terms (?:and conditions )?of (?:the )?)?{name}(?: (?:international|unported))?(?: licen[sc]e)?",
    ),
    (3, 0.85, "{name}(?: (?:international|unported|public))? licen[sc]e"),
    (4, 0.7, "under (?:the )?{name}"),
]


# Bodies: label, keyword, words that stand in the licence's own text and in no other's. They
# come before all wordings, since a text that quotes the licence has it whatever it is called.
BODIES = [
    ("mit", "sublicense", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit-0", "sublicense", "publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided"),
    ("bsd-2", "redistributions", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3", "endorse", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4", "advertising", "all advertising materials mentioning features or use of this software must display"),
    ("isc", "granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("apache-2", "perpetual", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable"),
    ("gpl-2", "redistribute", "gnu general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-3", "redistribute", "gnu general public license as published by the free software foundation either version 3 of the license"),
    ("lgpl-3", "redistribute", "gnu lesser general public license as published by the free software foundation either version 3 of the license"),
    ("agpl-3", "affero", "gnu affero general public license as published by the free software foundation"),
    ("mpl-2", "mozilla", "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "unencumbered", "free and unencumbered software released into the public domain"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented"),
    ("cc0", "waives", "affirmer hereby overtly fully permanently irrevocably and unconditionally waives"),
    ("bsl-1", "executables", "machine executable object code generated by a source language processor"),
    ("ofl-1", "reserved", "no modified version of the font software may use the reserved font name"),
]


@dataclass(frozen=True)
class Rule:
    """One signature: a pattern of whole words, tried where its keyword occurs."""

    priority: int
    label: str
    keyword: str
    pattern: str
    score: float


def signature_rules() -> list[Rule]:
    """Bodies, then all wordings of all names, strongest wording first."""
    rules = [Rule(0, label, keyword, body, 1.0) for label, keyword, body in BODIES]
    rules += [
        Rule(priority, label, keyword, wording.format(name=name), score)
        for priority, score, wording in WORDINGS
        for label, keyword, name in NAMES
    ]
    return rules + [Rule(5, label, phrase.split(" ")[-3], phrase, BASE_SCORE) for phrase, label in BASE_PHRASES.items()]


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """Rules as literals of the plan; their order breaks ties of priority."""
    values = ", ".join(f"(:k{i}, :p{i}, :l{i}, {r.priority}, {i}, {float(r.score)}D)" for i, r in enumerate(rules))
    named = {}
    for i, r in enumerate(rules):
        named |= {f"k{i}": r.keyword, f"p{i}": f"(?<= ){r.pattern}(?= )", f"l{i}": r.label}
    return spark.sql(
        f"SELECT * FROM VALUES {values} AS t(keyword, pattern, label, priority, number, score)", args=named
    )


def spaced(words: Column) -> Column:
    """Words between single spaces, one before the first and one after the last."""
    return F.concat(F.lit(" "), F.array_join(words, " "), F.when(F.size(words) > 0, F.lit(" ")).otherwise(F.lit("")))


def places(text: str, pattern: str) -> Column:
    """(start, end) in words of the matches of a pattern in a spaced text, both as SQL."""
    kind = "ARRAY<STRUCT<start: INT, end: INT>>"
    spaces = lambda c: f"(length({c}) - length(replace({c}, ' ', '')))"
    pieces = f"slice(split({text}, {pattern}, -1), 1, size(l_m))"
    sizes = f"transform(arrays_zip({pieces}, l_m), x -> struct({spaces('x.`0`')} AS before, {spaces('x.`l_m`')} AS own))"
    start = "(x.l_at + x.l_n.before - 1)"
    found = f"transform(arrays_zip(l_at, l_n), x -> struct({start} AS start, ({start} + x.l_n.own + 1) AS end))"
    placed = let("l_n", sizes, let("l_at", sums_before("transform(l_n, x -> x.before + x.own)"), found))
    none = f"CAST(array() AS {kind})"
    matches = f"regexp_extract_all({text}, {pattern}, 0)"
    return F.expr(let("l_m", matches, f"IF(size(l_m) > 0, CAST({placed} AS {kind}), {none})"))


def detections(texts: DataFrame, rules: DataFrame, keywords: list[str]) -> DataFrame:
    """Rows (keys, ``words``) become (keys, start, end, priority, number, label, score)."""
    present = F.array_intersect("words", F.array(*[F.lit(k) for k in keywords]))
    tried = texts.withColumn("present", present).filter(F.size("present") > 0)
    tried = tried.select(*KEYS, spaced(F.col("words")).alias("spaced"), "present")
    return (
        tried.select(*KEYS, "spaced", F.explode("present").alias("keyword"))
        .join(rules, "keyword")
        .select(*KEYS, "priority", "number", "label", "score", F.inline(places("spaced", "pattern")))
    )


def resolve(found: DataFrame) -> DataFrame:
    """Drop detections inside another one, then the weaker of overlapping neighbours."""
    order = Window.partitionBy(*KEYS).orderBy(F.col("start"), F.col("end").desc(), "priority", "number")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    outer = found.withColumn("reach", reach).filter(F.col("reach").isNull() | (F.col("end") > F.col("reach")))
    along = Window.partitionBy(*KEYS).orderBy("start")
    near = outer.select(
        "*",
        F.lag("end").over(along).alias("left_end"),
        F.lag("priority").over(along).alias("left_priority"),
        F.lead("start").over(along).alias("right_start"),
        F.lead("priority").over(along).alias("right_priority"),
    )
    beaten = F.coalesce(
        (F.col("left_end") > F.col("start")) & (F.col("left_priority") <= F.col("priority")), F.lit(False)
    ) | F.coalesce((F.col("right_start") < F.col("end")) & (F.col("right_priority") < F.col("priority")), F.lit(False))
    return near.filter(~beaten).select(*found.columns)


def scan_licenses(
    docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row
    per row of ``docs``.

    ``n_base``: all places of the base phrases; ``first_word`` and ``last_word``: their
    smallest and largest start, else NULL. ``labels``: the base labels and those of the
    detections that stay. ``score``: the strongest of them, 0 without any. NULL and empty
    texts have no words and empty labels. Repeated rows and ids keep a row each; an empty
    table gives no rows; other columns are not carried.
    """
    rules = signature_rules() if rules is None else rules
    spark = docs.sparkSession
    texts = docs.select(*row_key(id_col, text_col), words_of(F.col(text_col)).alias("words"))
    found = detections(texts, rules_frame(spark, rules), sorted({r.keyword for r in rules})).distinct()
    kept = materialise(
        resolve(found)
        .groupBy(*KEYS)
        .agg(F.collect_set("label").alias("method_labels"), F.max("score").alias("method_score")),
        "licenses",
    )
    rows = docs.select(
        F.col(id_col).alias("row_id"), *row_key(id_col, text_col), words_of(F.col(text_col)).alias("words")
    ).select("row_id", *KEYS, F.size("words").cast("long").alias("n_words"), spaced(F.col("words")).alias("spaced"))
    starts = []
    for phrase in BASE_PHRASES:
        own = F.transform(places("spaced", f"r'(?<= ){phrase}(?= )'"), lambda p: p["start"])
        none = F.array().cast("array<int>")
        starts.append(F.when(F.contains("spaced", F.lit(f" {phrase} ")), own).otherwise(none))
    based = rows.select("row_id", *KEYS, "n_words", F.array(*starts).alias("starts"))
    all_starts = F.flatten("starts")
    base = F.array_compact(
        F.array(*[F.when(F.size(F.get("starts", i)) > 0, F.lit(x)) for i, x in enumerate(BASE_PHRASES.values())])
    )
    told = based.select(
        "row_id",
        *KEYS,
        "n_words",
        F.size(all_starts).cast("long").alias("n_base"),
        F.array_min(all_starts).cast("long").alias("first_word"),
        F.array_max(all_starts).cast("long").alias("last_word"),
        F.array_sort(base).alias("base"),
    )
    every = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("method_labels", F.array().cast("array<string>")))))
    return told.join(kept, KEYS, "left").select(
        F.col("row_id").alias(id_col),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.greatest(
            F.coalesce("method_score", F.lit(0.0)), F.when(F.col("n_base") > 0, BASE_SCORE).otherwise(0.0)
        ).alias("score"),
    )

"""A corpus pipeline: five stages over ``documents``, each on all that the last one kept.

Each stage takes (spark, docs, sf_dir), calls one operator of ``emberfall.llm`` and
returns the documents it keeps, changed where the stage changes them; the last returns
one row per document with its tokens. Between stages the documents are written as
Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberfall.llm import bpe_codec, decontamination, pii, quality, simhash
from emberfall.workspace import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# SQL cannot express a fitted classifier, fingerprints of hashes or byte-pair merging.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that score below one half go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit_quality(docs, labels.filter(~quality.held_out(F.col("doc_id"))))
    return quality.score_texts(docs, model, into="quality_score").filter("quality_score >= 0.5").select(*COLUMNS)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: the smallest id of every group of near copies stays."""
    # Three-word shingles, at most 3 of 64 bits apart: what op8_simhash_near_dedup links.
    found = simhash.near_duplicates(docs, shingle=3, bits=64, radius=3, blocks=1)
    found = materialise(found, "near-duplicates")
    return simhash.keep_one(docs, found).select(*COLUMNS)


def keep_unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with words of a benchmark window go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.keep_clean(docs, benchmark).select(*COLUMNS)


def hide_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: every span is replaced by its kind; ``n_chars`` follows the text."""
    found = pii.find_spans(docs, into="spans")
    hidden = found.withColumn("text", pii.redact("text", "spans"))
    n_chars = F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return hidden.withColumn("n_chars", n_chars).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE: token ids of every text, and the digest of what they decode to."""
    coded = bpe_codec.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id",
        "lang",
        "source",
        F.col("coded.n_tokens").alias("n_tokens"),
        F.col("coded.ids").alias("ids"),
        F.sha2("coded.decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", keep_good),
    ("simhash near-dedup", keep_distinct),
    ("benchmark decontamination", keep_unseen),
    ("pii", hide_personal),
    ("bpe encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

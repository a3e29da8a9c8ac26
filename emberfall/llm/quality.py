"""Quality classifier: naive Bayes features under a linear hinge-loss model.

A text is a set of n-grams (one to four in a row) of token shapes: what kinds of letters,
digits and marks a token is made of, and whether it repeats the token before it. Tokens of
more than eight runs of letters, digits or marks count as successive tokens of eight. Shapes
say how a text is written, not what it is about, so that few labels suffice. Each n-gram
indicator is scaled by its log-count ratio between the classes; rows are scaled to
length one; a linear model with hinge loss is fitted by dual coordinate descent, and its
weights are drawn towards their mean size, as naive Bayes has them.

The model is fitted on a bounded sample of labelled rows (``SAMPLE_ROWS``, by hash order
of the id), which come as lists of feature numbers. Every text is then scored whole, row
by row, without a shuffle; what is sent along is one weight per feature, of fixed size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfall.llm.words import bound_batches

SAMPLE_ROWS = 4000
FEATURE_BITS = 18
N_GRAM = 4
EPOCHS = 40
COST = 1.0
SMOOTHING = 1.0
DRAWN = 0.25
STEEPNESS = 4.0
CACHED_SHAPES = 150_000
RUNS_IN_TOKEN = 8
CACHED_LENGTH = 64
_MIX = np.uint64(0x9E3779B97F4A7C15)
_RUNS = re.compile(r"[^\W\d_]+|\d+|(.)\1*", re.S)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned; a NULL id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def shape(token: str) -> str:
    """Letters by case, digits and marks of a token, each run cut to what tells it apart."""
    parts = []
    for run in _RUNS.finditer(token):
        text = run.group()
        if text[0].isdigit():
            parts.append("0")
        elif run.group(1) is None:
            if len(text) > 1 and text.isupper():
                parts.append("AA")
            elif text[0].isupper():
                parts.append("Aa" if len(text) > 1 else "A")
            else:
                parts.append("a")
        else:
            parts.append(text[:3])
    return "".join(parts)


def pieces(token: str) -> list[str]:
    """A token cut after every ``RUNS_IN_TOKEN`` runs."""
    cuts, end = [], 0
    for n, run in enumerate(_RUNS.finditer(token), 1):
        if n % RUNS_IN_TOKEN == 0:
            cuts.append(token[end : run.end()])
            end = run.end()
    return cuts if end == len(token) else [*cuts, token[end:]]


_known_pieces = lru_cache(CACHED_SHAPES)(pieces)


def tokens_of(text: str) -> list[str]:
    """All blank-separated tokens of a text, long ones in pieces."""
    tokens = text.split()
    if max(map(len, tokens), default=0) <= RUNS_IN_TOKEN:
        return tokens
    cut: list[str] = []
    for token in tokens:
        if len(token) <= RUNS_IN_TOKEN:
            cut.append(token)
        else:
            cut += _known_pieces(token) if len(token) <= CACHED_LENGTH else pieces(token)
    return cut


_SHAPES: dict[str, int] = {}


def _code(token: str) -> int:
    number = 1469598103934665603
    for b in shape(token).encode():
        number = (number ^ b) * 1099511628211 % (1 << 64)
    if len(_SHAPES) >= CACHED_SHAPES:
        _SHAPES.clear()
    _SHAPES[token] = number
    return number


def features(text: str | None) -> np.ndarray:
    """The distinct feature numbers of a whole text, sorted; NULL counts as empty."""
    tokens = tokens_of(text or "")
    if not tokens:
        return np.empty(0, np.int32)
    get = _SHAPES.get
    codes = np.array([c if (c := get(t)) is not None else _code(t) for t in tokens], np.uint64)
    same = np.fromiter(map(str.__eq__, tokens[1:], tokens), bool, len(tokens) - 1)
    codes[1:][same] ^= _MIX
    found, gram = [], codes
    for n in range(1, N_GRAM + 1):
        if n > 1:
            if len(gram) < 2:
                break
            gram = gram[:-1] * _MIX + codes[n - 1 :] + np.uint64(n)
        mixed = gram * _MIX
        found.append((mixed ^ (mixed >> np.uint64(29))) * _MIX >> np.uint64(64 - FEATURE_BITS))
    return np.unique(np.concatenate(found)).astype(np.int32)


@dataclass(frozen=True)
class QualityModel:
    """One weight per feature and a bias; scores are steepened margins through a sigmoid."""

    weights: np.ndarray
    bias: float

    def score(self, found: np.ndarray) -> float:
        margin = self.bias
        if len(found):
            margin += float(self.weights[found].sum()) / np.sqrt(len(found))
        return float(1 / (1 + np.exp(-np.clip(STEEPNESS * margin, -500, 500))))


def constant_model(share: float) -> QualityModel:
    """For labels of one class or none: every text has the same score."""
    share = min(max(share, 1e-6), 1 - 1e-6)
    return QualityModel(np.zeros(1 << FEATURE_BITS), float(np.log(share / (1 - share)) / STEEPNESS))


def log_count_ratios(rows: list[np.ndarray], positive: np.ndarray) -> np.ndarray:
    """log of the smoothed share of each feature in class 1 over that in class 0."""
    counts = np.full((2, 1 << FEATURE_BITS), SMOOTHING)
    for found, label in zip(rows, positive):
        counts[int(label), found] += 1
    shares = counts / (np.bincount(positive.astype(int), minlength=2) + 2 * SMOOTHING)[:, None]
    return np.log(shares[1] / shares[0])


def fit_rows(rows: list[np.ndarray], labels: list[int]) -> QualityModel:
    """Dual coordinate descent for the hinge loss on scaled indicators.

    Each class has the same total cost, so that the rarer one counts.
    """
    positive = np.array(labels) == 1
    if not len(rows) or positive.all() or not positive.any():
        return constant_model(float(positive.mean()) if len(rows) else 0.5)
    ratios = log_count_ratios(rows, positive)
    signs = np.where(positive, 1.0, -1.0)
    most = COST * len(rows) / (2 * np.bincount(positive.astype(int), minlength=2))[positive.astype(int)]
    values = [ratios[found] / np.sqrt(max(len(found), 1)) for found in rows]
    norms = np.array([v @ v + 1.0 for v in values])
    weights, bias, alpha = np.zeros(1 << FEATURE_BITS), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in order.permutation(len(rows)):
            gradient = signs[i] * (weights[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), most[i])
            if (step := (new - alpha[i]) * signs[i]) != 0.0:
                weights[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-4:
            break
    used = weights != 0
    mean = np.abs(weights[used]).mean() if used.any() else 0.0
    drawn = np.where(used, (1 - DRAWN) * mean * np.sign(weights) + DRAWN * weights, 0.0)
    # The drawing changes the margins' size, so it is applied where it keeps the fit.
    plain, pulled = weights * ratios, drawn * ratios
    scored = [
        np.array([w[f].sum() / np.sqrt(max(len(f), 1)) for f in rows]) + bias for w in (plain, pulled)
    ]
    right = [((s >= 0) == positive).mean() for s in scored]
    return QualityModel(plain if right[0] >= right[1] else pulled, float(bias))


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    sample_rows: int = SAMPLE_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> QualityModel:
    """Fit on at most ``sample_rows`` labelled documents.

    Labels other than 0 and 1, NULL labels and labels without a document are left out;
    of several labels of an id the smallest counts. Without labels of both classes all
    texts score alike: the share of ones, or one half without any label.
    """
    bound_batches(docs.sparkSession)
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    order = F.xxhash64("label_id", F.lit(7))
    picked = (
        known.groupBy(F.col(id_col).alias("label_id"))
        .agg(F.min(label_col).cast("int").alias("label"))
        .orderBy(order, "label_id")
        .limit(sample_rows)
    )
    texts = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("row_text"))

    @F.pandas_udf("array<int>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts])

    # The picked side has at most ``sample_rows`` rows of two numbers.
    joined = texts.join(F.broadcast(picked), F.col("row_id") == F.col("label_id"))
    sample = (
        joined.select("label_id", "label", found("row_text").alias("found"))
        .orderBy(order, "label_id", F.xxhash64("found"))
        .limit(sample_rows)
        .collect()
    )
    return fit_rows([np.array(r.found, np.int64) for r in sample], [r.label for r in sample])


def score_texts(docs: DataFrame, model: QualityModel, text_col: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with a double column ``into``: 0 to 1, higher where label 1 is likelier.

    NULL and empty texts score by the bias alone. Rows are independent, so repeated rows
    and ids need nothing special; an empty table stays empty; other columns stay, and a
    column named as ``into`` is replaced.
    """
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([sent.value.score(features(t)) for t in texts], dtype="float64")

    return docs.withColumn(into, scored(F.col(text_col)))

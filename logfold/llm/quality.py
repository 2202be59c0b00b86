"""Quality rules (10): fixed base rules, then gradient-boosted trees over document statistics.

The trees are fitted on at most ``train_rows`` labelled documents (chosen by a hash of doc_id, a fixed bound), flattened
into numpy node arrays and scored for whole Arrow batches at once. Constrained features can only lower the verdict as they
grow: share of symbols, of repeated lines, of repeated word windows, of capitals and of exclamation marks.

Nulls and empty texts have no words: base_failed, not kept. Very long texts are read whole. Tied or repeated rows are
scored alike, each row on its own. Columns besides the id and the text are ignored, or passed through by keep_documents.
With no labels (or labels of one class only) the trees are a constant and only the base rules decide. A labelled row
with a null id or null quality is not used.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from logfold.llm import gbt
from logfold.llm.common import arrow_map, table, texts

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "capital_share", "shout_share", "digit_share", "distinct_share", "line_words")
MONOTONE = np.array([0, 0, -1, -1, -1, -1, -1, 0, 0, 0])
#: Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
TRAIN_ROWS = 4000
THRESHOLD = 0.5

_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ]+")
_DIGIT = re.compile(r"[0-9]+")


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base counts and the features of one whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    repeat = 0
    if n >= 3:
        first, pair = np.unique(seq[:-1] * len(ids) + seq[1:], return_inverse=True)
        _, key, count = np.unique(pair[:-1] * len(ids) + seq[2:], return_inverse=True, return_counts=True)
        again = count[key] > 1
        covered = np.zeros(n, bool)
        for shift in range(3):
            covered[shift : n - 2 + shift] |= again
        repeat = int(covered.sum())
    capitals = sum(map(len, _CAPITAL.findall(text)))
    digits = sum(map(len, _DIGIT.findall(text)))
    some, any_line, any_char = max(n, 1), max(len(lines), 1), max(chars, 1)
    features = [np.log1p(n), chars / some, symbols / any_char, dup / any_line, repeat / some, capitals / any_char, text.count("!") / any_char, digits / any_char, len(ids) / some, n / any_line]
    return [n, chars, symbols, dup, repeat], features


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > 50 * counts[:, 0])


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts and the features as an array."""

    def run(batch: pa.RecordBatch) -> dict:
        both = [statistics(x) for x in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "counts": [x[0] for x in both], "features": [x[1] for x in both]}

    return arrow_map(texts(docs), run, "doc_id long, counts array<long>, features array<double>")


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> gbt.Forest:
    """Fits the trees on at most train_rows labelled documents."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).dropna()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(train_rows)
    )
    rows = document_statistics(texts(docs).join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "features").limit(train_rows)  # the same where ids repeat
    known: dict[int, list[float]] = {}
    for r in chosen.collect():
        known.setdefault(r.doc_id, []).append(r.quality)
    found = sorted(rows.select("doc_id", "features").collect(), key=lambda r: (r.doc_id, r.features))
    x = np.array([r.features for r in found]).reshape(-1, len(FEATURES))
    y = np.array([float(np.mean(known[r.doc_id]) >= 0.5) for r in found])
    return gbt.fit(x, y, MONOTONE)


def judge(docs: DataFrame, forest: gbt.Forest, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base counts, base_failed, quality (the trees' probability) and kept, a row for every row of docs."""

    def run(batch: pa.RecordBatch) -> dict:
        both = [statistics(x) for x in batch.column("text").to_pylist()]
        counts = np.array([x[0] for x in both], np.int64)
        quality = 1 / (1 + np.exp(-forest.score(np.array([x[1] for x in both]))))
        failed = base_failed(counts)
        return {"doc_id": batch.column("doc_id"), "base_failed": failed, "kept": ~failed & (quality >= threshold), "quality": quality} | {k: counts[:, i] for i, k in enumerate(BASE)}

    return arrow_map(texts(docs), run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality double")


def keep_documents(docs: DataFrame, forest: gbt.Forest, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    names = list(docs.columns)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            both = [statistics(x) for x in batch.column("text").to_pylist()]
            quality = 1 / (1 + np.exp(-forest.score(np.array([x[1] for x in both]))))
            kept = ~base_failed(np.array([x[0] for x in both], np.int64)) & (quality >= threshold)
            yield batch.filter(pa.array(kept))

    from logfold.llm.common import prepare

    prepare(docs.sparkSession)
    return docs.select(*names).mapInArrow(run, docs.schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))

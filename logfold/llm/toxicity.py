"""Toxicity (8): cumulative-link ordinal regression on sparse text features.

Severity has GRADES grades. Labels only say toxic or not, so a toxic training document's grade, 1 and up, is the third
of the toxic documents that its amount of toxic-typical features falls into. Features are words and their beginnings that
tell toxic from clean beyond chance. One weight per feature is shared by all ordered thresholds:
P(grade > k) = sigmoid(w x - theta_k). The output is the probability of each threshold and the expected severity, their sum.

Fitted on at most ``train_rows`` labelled documents (chosen by a hash of doc_id, a fixed bound), so the features are
bounded too; every document is then scored from its whole text. Null and empty texts have no features and get the
intercepts' severity. Without toxic or without clean labels all documents get grade 0. Labels that are null are not used;
repeated rows are scored alike; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from logfold.llm.common import arrow_map, table, texts

GRADES = 4
TRAIN_ROWS = 6000
#: Words in fewer training documents are not features; the most that are tried and taken.
MIN_DOCS = 4
POOL = 1500
MAX_FEATURES = 300
#: Least likelihood-ratio statistic of a feature against the toxic label; below it a feature is noise.
MIN_G = 20.0
#: Beginnings of words are features beside the words, so that a stem counts in all its forms.
STEMS = (4, 5, 6)
_WORD = re.compile(r"[^\W_]+")


def features(text: str | None) -> Counter:
    """Words and their beginnings (ending in *) with the number of times they occur."""
    out = Counter(_WORD.findall((text or "").lower()))
    for w, k in list(out.items()):
        for n in STEMS:
            if len(w) > n:
                out[w[:n] + "*"] += k
    return out


def value(count):
    """A feature's value: it grows ever more slowly with its number of occurrences."""
    return np.log2(1 + count)


@dataclass
class Model:
    weights: dict[str, float]
    thresholds: np.ndarray  # ascending, one between any two grades

    def exceed(self, text: str | None) -> np.ndarray:
        """P(grade > k) for every threshold."""
        w = self.weights
        x = sum(w[f] * value(k) for f, k in features(text).items() if f in w)
        return 1 / (1 + np.exp(np.clip(self.thresholds - x, -30, 30)))


def _grades(amount: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """0 for clean documents; 1 and up for toxic ones, by thirds of the amount of toxic-typical features; ties together."""
    grade = np.zeros(len(toxic), np.int64)
    cuts = np.quantile(amount[toxic], np.arange(1, GRADES - 1) / (GRADES - 1))
    grade[toxic] = 1 + np.searchsorted(cuts, amount[toxic], side="left")
    return grade


def _chosen(found: list[Counter], toxic: np.ndarray) -> list[str]:
    """Features that speak for toxic, by falling G; one that mostly lies within a chosen one's documents adds nothing."""
    seen, bad = Counter(w for c in found for w in c), Counter(w for c, t in zip(found, toxic) if t for w in c)
    n1, n = toxic.sum(), len(found)
    many = [w for w, k in seen.items() if k >= MIN_DOCS and bad[w] * n > k * n1]
    g = _likelihood_ratio(np.array([bad[w] for w in many], float), np.array([seen[w] for w in many], float), n1, n)
    pool = [w for _, _, w in sorted((-x, len(w), w) for x, w in zip(g, many) if x >= MIN_G)][:POOL]
    taken = np.zeros((0, n), bool)
    out: list[str] = []
    for w in pool:
        has = np.array([w in c for c in found])
        if not len(taken) or (taken & has).sum(axis=1).max() < 0.7 * has.sum():
            taken = np.vstack((taken, has))
            out.append(w)
            if len(out) == MAX_FEATURES:
                break
    return out


def _sketch(text: str | None) -> tuple[int, ...]:
    """The least hashes of a text's words, mostly the same for near copies."""
    return tuple(sorted(xxhash.xxh64_intdigest(w) for w in set(_WORD.findall((text or "").lower())))[:3])


def _likelihood_ratio(k1: np.ndarray, k: np.ndarray, n1: int, n: int) -> np.ndarray:
    """G of presence against label: k1 of k documents with a feature are toxic, n1 of all n."""
    seen = np.stack((k1, k - k1, n1 - k1, n - k - n1 + k1))
    due = np.stack((k * n1, k * (n - n1), (n - k) * n1, (n - k) * (n - n1))) / n
    return 2 * np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(due, 1e-9)), 0).sum(axis=0)


def fit(rows: list[tuple[str | None, bool]], steps: int = 2000, l2: float = 1e-5) -> Model:
    """Full-batch gradient steps with momentum on the cumulative-link likelihood; thresholds stay in order."""
    rows = list({(_sketch(x), t): (x, t) for x, t in rows}.values())  # copies would make chance words look typical
    toxic = np.array([t for _, t in rows], bool)
    if not toxic.any() or toxic.all():
        return Model({}, np.full(GRADES - 1, 30.0))
    found = [features(t) for t, _ in rows]
    vocabulary = _chosen(found, toxic)
    at = {w: k for k, w in enumerate(vocabulary)}
    doc = np.array([d for d, c in enumerate(found) for w in c if w in at], np.int64)
    col = np.array([at[w] for c in found for w in c if w in at], np.int64)
    val = np.array([value(k) for c in found for w, k in c.items() if w in at])
    n = len(rows)
    grade = _grades(np.bincount(doc, val, n), toxic)
    n, over = len(rows), grade[:, None] > np.arange(GRADES - 1)
    w, gaps = np.zeros(len(vocabulary)), np.zeros(GRADES - 1)  # first threshold, then logs of the steps up
    gaps[0] = 2.0
    m, v = np.zeros(len(w) + len(gaps)), np.zeros(len(w) + len(gaps))
    for t in range(1, steps + 1):
        theta = np.cumsum(np.concatenate(([gaps[0]], np.exp(gaps[1:]))))
        x = np.bincount(doc, w[col] * val, n)
        p = 1 / (1 + np.exp(np.clip(theta - x[:, None], -30, 30)))
        g = (p - over) / n  # of the sum of the thresholds' log losses, by w x - theta
        gx, gt = g.sum(axis=1), -g.sum(axis=0)
        gw = np.bincount(col, gx[doc] * val, len(w)) + l2 * w / max(len(w), 1)
        back = np.cumsum(gt[::-1])[::-1]
        grad = np.concatenate((gw, [back[0]], back[1:] * np.exp(gaps[1:])))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, gaps = w - step[: len(w)], gaps - step[len(w) :]
    theta = np.cumsum(np.concatenate(([gaps[0]], np.exp(gaps[1:]))))
    return Model({k: float(x) for k, x in zip(vocabulary, w) if abs(x) > 1e-3}, theta)


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).alias("toxic")).dropna()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(train_rows)
    )
    known: dict[int, bool] = {}
    for r in chosen.collect():
        known[r.doc_id] = known.get(r.doc_id, False) or r.toxic
    rows = texts(docs).join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(train_rows)  # the same where ids repeat
    return fit([(t, known[d]) for d, t in sorted(((r.doc_id, r.text or "") for r in rows.toLocalIterator()))])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity (expected grade), grade (the most likely), p_toxic and toxic."""

    def run(batch: pa.RecordBatch) -> dict:
        p = np.array([model.exceed(x) for x in batch.column("text").to_pylist()])
        edge = np.concatenate((np.ones((len(p), 1)), p, np.zeros((len(p), 1))), axis=1)
        return {"doc_id": batch.column("doc_id"), "severity": p.sum(axis=1), "grade": (edge[:, :-1] - edge[:, 1:]).argmax(axis=1), "p_toxic": p[:, 0], "toxic": p[:, 0] >= 0.5}

    return arrow_map(texts(docs), run, "doc_id long, severity double, grade int, p_toxic double, toxic boolean")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))

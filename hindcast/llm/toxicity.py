"""Toxicity by non-negative positive-unlabelled learning.

The classifier sees confirmed toxic documents (positive) and other documents whose
marks it does not look at (unlabelled).  With the share of toxic documents pi known,
the risk on negatives is R_u- minus pi R_p-; that difference is not let below zero
(steps that would push it there go back instead), so rare toxic documents among the
unlabelled do not count as clean ones.  pi is the share of toxic marks among the
training rows.

Features are the words of the whole text (letters only, A-Z lower-cased), hashed to
``BUCKETS`` and counted up to ``OFTEN``; only words whose share of toxic documents differs from their
share of unlabelled ones by ``APART`` standard errors carry weight.  At the end the scores are shifted so that TOXIC lies
where the same risk, with zero-one loss, is least (in the widest gap of such places).  The fit uses a bounded sample: ``POSITIVE`` toxic and ``UNLABELLED`` other
training documents drawn by hash.  Every document is scored.

Null and empty texts have no words and get the score of the bias.  Without toxic
training rows every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm import arrays, labelled

POSITIVE, UNLABELLED = 5000, 12000
FOLDS, HELD = 3, 1
BUCKETS = 1 << 32
APART = 5.0
OFTEN = 4
TOXIC = 0.7
_GAP = ~(np.isin(np.arange(256), np.r_[65:91, 97:123]) | (np.arange(256) > 127))


def buckets(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word buckets of the texts one after the other, each up to OFTEN times, and their number before each text."""
    starts, ends, before = arrays.spans(buf, offsets, _GAP)
    key = arrays.hashes(arrays.LOWER[buf], starts, ends) % np.uint64(BUCKETS)
    both = np.sort(arrays.of_text(before) * BUCKETS + key.astype(np.int64))
    few = np.ones(len(both), bool)
    few[OFTEN:] = both[OFTEN:] != both[:-OFTEN]
    both = both[few]
    return both % BUCKETS, np.searchsorted(both, np.arange(len(offsets)) * BUCKETS)


def _empty() -> dict:
    return {"names": np.empty(0, np.int64), "weight": np.empty(0), "bias": -30.0}


def _pooled(weight: np.ndarray, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return arrays.sums(weight[words].astype(np.float64), bounds)


def fit(words: np.ndarray, bounds: np.ndarray, positive: np.ndarray, prior: float, steps: int = 800, decay: float = 3e-5) -> dict:
    """Weights of a linear classifier under the non-negative risk with logistic loss."""
    size = np.diff(bounds)
    home = np.repeat(np.arange(len(size)), size)
    fresh = np.ones(len(words), bool)
    fresh[1:] = (words[1:] != words[:-1]) | (home[1:] != home[:-1])  # a text counts once for a word
    toxic_home = positive[home]
    n_toxic, n_other = max(int(positive.sum()), 1), max(int((~positive).sum()), 1)
    every, place = np.unique(words, return_inverse=True)
    a = np.bincount(place[toxic_home & fresh], minlength=len(every)) / n_toxic
    b = np.bincount(place[~toxic_home & fresh], minlength=len(every)) / n_other
    middle = (a * n_toxic + b * n_other) / (n_toxic + n_other)
    error = np.sqrt(middle * (1 - middle) * (1 / n_toxic + 1 / n_other)) + 1e-12
    apart = np.abs(a - b) > APART * error
    names, use = every[apart], apart[place]
    local = np.searchsorted(names, words[use])
    bounds = np.concatenate([[0], np.cumsum(np.bincount(home[use], minlength=len(size)))])
    p, u = np.flatnonzero(positive), np.flatnonzero(~positive)
    if not len(p) or not len(u) or not len(names):
        return _empty()
    theta = np.zeros(len(names) + 1)
    theta[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    doc = np.repeat(np.arange(len(size)), np.diff(bounds))
    for step in range(1, steps + 1):
        s = 1 / (1 + np.exp(-np.clip(_pooled(theta[:-1], local, bounds) + theta[-1], -30, 30)))
        # loss(+) = -log s, loss(-) = -log(1 - s); the risk on negatives stops counting at zero.
        negative = prior * np.log1p(-s[p] + 1e-12).mean() - np.log1p(-s[u] + 1e-12).mean()
        pull = np.zeros(len(s))
        pull[p] = prior * (s[p] - 1) / len(p)
        if negative > 0:
            pull[u] = s[u] / len(u)
            pull[p] -= prior * s[p] / len(p)
        g = np.append(np.bincount(local, pull[doc], len(names)) + decay * theta[:-1], pull.sum())
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g**2
        theta -= 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    f = _pooled(theta[:-1], local, bounds)
    edge = _edge(np.sort(f[p]), np.sort(f[u]), prior)
    return {"names": names, "weight": theta[:-1], "bias": float(np.log(TOXIC / (1 - TOXIC)) - edge)}


def _edge(toxic: np.ndarray, other: np.ndarray, prior: float) -> float:
    values = np.unique(np.concatenate([toxic, other]))
    if len(values) < 2:
        return float(values[0]) + 1.0
    places = (values[1:] + values[:-1]) / 2
    found = 1 - np.searchsorted(toxic, places) / len(toxic)
    flagged = 1 - np.searchsorted(other, places) / len(other)
    risk = prior * (1 - found) + np.maximum(flagged - prior * found, 0)
    return float(places[np.argmax(np.where(risk <= risk.min() + 0.01 * prior, np.diff(values), -1.0))])


def score(model: dict, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    words, bounds = buckets(buf, offsets)
    names = np.append(model["names"], BUCKETS)
    at = np.searchsorted(names, words)
    weight = np.where(names[at] == words, np.append(model["weight"], 0.0)[at], 0.0)
    return 1 / (1 + np.exp(-np.clip(arrays.sums(weight, bounds) + model["bias"], -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, positive: int = POSITIVE, unlabelled: int = UNLABELLED) -> dict:
    """Fit on a bounded sample of the training rows of ``labels`` and ``docs``."""
    marks = labelled.marks(labels, "toxic", FOLDS, HELD)
    counts = {r["mark"]: r["count"] for r in marks.groupBy("mark").count().collect()}
    toxic, marked = counts.get(1, 0), sum(counts.values())
    if not toxic:
        return _empty()
    chosen = F.broadcast(marks.where((F.col("mark") == 1) & labelled.drawn(positive / toxic, 1)))  # about ``positive`` ids at most
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & ~labelled.held_out(FOLDS, HELD))
    total = slim.count()
    slim = slim.join(chosen, "doc_id", "left").where(F.col("mark").isNotNull() | labelled.drawn(unlabelled / max(total, 1), 2))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, buf, offsets in arrays.slices(batch.column("text")):
                words, bounds = buckets(buf, offsets)
                words = words.astype(np.uint32)
                rows += [words[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(rows, pa.binary())], ["doc_id", "mark", "words"])

    got = slim.mapInArrow(distinct, "doc_id long, mark int, words binary").toPandas().sort_values(["doc_id", "words"])
    got = got.drop_duplicates("words")  # copies of one text count once
    words = np.frombuffer(b"".join(got["words"]), np.uint32).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(got["words"].map(len).to_numpy(np.int64) // 4)])
    return fit(words, bounds, got["mark"].notna().to_numpy(bool), toxic / marked)


def scores(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with its toxicity score; ``score`` replaces a column of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # words that stand apart in a bounded sample
    columns = [c for c in docs.columns if c != "score"]
    schema = docs.select(*[F.col(f"`{c}`") for c in columns]).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [score(shared.value, buf, offsets) for _, buf, offsets in arrays.slices(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [pa.array(np.concatenate([np.empty(0), *out]))], [*columns, "score"])

    return docs.mapInArrow(run, schema)

"""Quality by Bradley-Terry ranking of documents.

Every document has a strength w . x; a document marked good is preferred to one
marked bad with probability sigmoid(w . (x_good - x_bad)).  w is fitted by logistic
loss on the feature differences of drawn pairs.  Strengths become scores in (0, 1)
by a logistic curve fitted to the marks of the same sample, and documents fall to a
threshold that is a quantile of the scores.

Features look at the whole text and at nothing else: shares of each ASCII sign, of
upper case and of other bytes, word lengths, repeated words, lines and word
windows.  The classifier is fitted on a bounded sample (``PER_MARK`` documents of
each mark); every document is scored.

Null and empty texts have all-zero shares and get the score of that point.  Without
documents of both marks every score is the share of good marks (0.5 without marks).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm import arrays, labelled

PER_MARK = 8000
FOLDS, HELD = 4, 2
GOOD = 0.7
STEPS, GOOD_WEIGHT = 10_000, 10
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_LETTER = np.isin(np.arange(256), np.r_[65:91, 97:123]) | (np.arange(256) > 127)
_TAIL = np.isin(np.arange(256), np.frombuffer(b".,!?;:", np.uint8))
_CHARACTERS = np.arange(256) & 0xC0 != 0x80


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def features(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of numbers per text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    text_of = np.repeat(np.arange(n), size)
    ascii_ = np.bincount(text_of * 129 + np.minimum(buf, 128), minlength=n * 129).reshape(n, 129)
    starts, ends, before = arrays.spans(buf, offsets)
    words = np.diff(before)
    key = arrays.hashes(arrays.LOWER[buf], starts, ends)
    home = arrays.of_text(before)
    count = arrays.sums
    order = np.lexsort((key, home))
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[order][1:] != key[order][:-1]) | (home[order][1:] != home[order][:-1])
    distinct = count(fresh, before)
    again = np.zeros(len(key), bool)
    again[1:] = (key[1:] == key[:-1]) & (home[1:] == home[:-1])
    window, _, windows = arrays.grams(key, before, 3)
    window_home = arrays.of_text(windows)
    order = np.lexsort((window, window_home))
    seen = np.zeros(len(window), bool)
    seen[1:] = (window[order][1:] == window[order][:-1]) & (window_home[order][1:] == window_home[order][:-1])
    line_start, line_end, lines = arrays.lines(buf, offsets)
    line_key = arrays.hashes(buf, line_start, line_end)
    line_home = arrays.of_text(lines)
    order = np.lexsort((line_key, line_home))
    same = np.zeros(len(line_key), bool)
    same[1:] = (line_key[order][1:] == line_key[order][:-1]) & (line_home[order][1:] == line_home[order][:-1])
    width = ends - starts
    last = buf[ends - 1] if len(ends) else buf[:0]
    extra = [
        _share(count(width, before), words) / 10,
        _share(count(width > 12, before), words),
        _share(distinct, words),
        np.log1p(words) / 10,
        np.log1p(words) * _share(distinct, words) / 10,
        _share(count(again, before), words),
        _share(count(seen, windows), np.diff(windows)),
        _share(count(same, lines), np.diff(lines)),
        _share(count(_UPPER[buf], offsets), count(_LETTER[buf], offsets)),
        _share(count(_TAIL[last], before), words),
        _share(count(~_LETTER[buf] & ~arrays.SPACE[buf], offsets), size),
        _share(count(_CHARACTERS[buf], offsets), size),
        _share(words, np.diff(lines)) / 100,
    ]
    shares = np.sqrt(ascii_[:, 32:] / np.maximum(size, 1)[:, None])
    return np.concatenate([shares, np.stack(extra, axis=1)], axis=1).astype(np.float32)


WIDTH = features(np.empty(0, np.uint8), np.zeros(1, np.int64)).shape[1]


def fit(x: np.ndarray, mark: np.ndarray, pairs: int = 4096, steps: int = 400, decay: float = 1e-4, seed: int = 5) -> dict:
    """Weights of the strength and the curve from strength to score."""
    good, bad = np.flatnonzero(mark == 1), np.flatnonzero(mark == 0)
    if not len(good) or not len(bad):
        share = float(mark.mean()) if len(mark) else 0.5
        odds = np.log((share + 1e-3) / (1 - share + 1e-3))
        return {"mean": np.zeros(x.shape[1]), "weight": np.zeros(x.shape[1]), "curve": (0.0, float(odds))}
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = ((x - mean) / scale).astype(np.float64)
    rng = np.random.default_rng(seed)
    w, first, second = np.zeros(z.shape[1]), np.zeros(z.shape[1]), np.zeros(z.shape[1])
    for step in range(1, steps + 1):
        difference = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
        wrong = 1 / (1 + np.exp(np.clip(difference @ w, -30, 30)))
        slope = decay * w - difference.T @ wrong / pairs
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        w -= 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    strength = z @ w
    a, b = _curve(strength, mark)
    return {"mean": mean, "weight": w / scale, "curve": (a, b)}


def _curve(strength: np.ndarray, mark: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic curve of the marks, each mark weighing the same in all."""
    weight = np.where(mark == 1, 0.5 / max((mark == 1).sum(), 1), 0.5 / max((mark == 0).sum(), 1))
    top = strength.std() + 1e-9
    design = np.stack([strength / top, np.ones(len(strength))], axis=1)
    target = np.where(mark == 1, 0.999, 0.001)
    theta = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        slope = design.T @ (weight * (p - target)) + 1e-4 * theta
        bend = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-4 * np.eye(2)
        theta = theta - np.linalg.solve(bend, slope)
    return float(theta[0] / top), float(theta[1])


def score(model: dict, x: np.ndarray) -> np.ndarray:
    a, b = model["curve"]
    return 1 / (1 + np.exp(-np.clip(a * ((x - model["mean"]) @ model["weight"]) + b, -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, per_mark: int = PER_MARK) -> dict:
    """Fit on at most about ``per_mark`` training documents of each mark, drawn by hash."""
    marks = labelled.marks(labels, "quality", FOLDS, HELD)
    counts = {r["mark"]: r["count"] for r in marks.groupBy("mark").count().collect()}
    share = F.when(F.col("mark") == 1, labelled.drawn(per_mark / max(counts.get(1, 0), 1), 1)).otherwise(labelled.drawn(per_mark / max(counts.get(0, 0), 1), 1))
    chosen = F.broadcast(marks.where(share))  # 2 x per_mark ids at most, up to the draw

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x.tobytes() for _, buf, offsets in arrays.slices(batch.column("text")) for x in features(buf, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(rows, pa.binary())], ["doc_id", "mark", "x"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id")
    got = slim.mapInArrow(arrays.tidy(numbers), "doc_id long, mark int, x binary").toPandas().sort_values(["doc_id", "x"])
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(len(got), WIDTH)
    return fit(x, got["mark"].to_numpy())


def scores(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score of every document, with its other columns untouched; ``score`` replaces such a column."""
    slim = {k: model[k] for k in ("mean", "weight", "curve")}
    columns = [c for c in docs.columns if c != "score"]
    schema = docs.select(*[F.col(f"`{c}`") for c in columns]).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [score(slim, features(buf, offsets)) for _, buf, offsets in arrays.slices(batch.column("text"))]
            made = pa.array(np.concatenate([np.empty(0), *out]))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [made], [*columns, "score"])

    return docs.mapInArrow(arrays.tidy(run), schema)


def cutoff(scored: DataFrame, labels: DataFrame) -> float:
    """The score below which a document is rejected, from the scores (doc_id, score) of all training rows.

    Counts per mark and score (in steps of 1 / ``STEPS``) give both errors at every level; the level with the
    least ``GOOD_WEIGHT`` x share of good ones lost + share of bad ones kept is taken, the middle
    one of equal ones.  0 (nothing goes) where a mark has no rows.
    """
    marks = labelled.marks(labels, "quality", FOLDS, HELD)
    marked = scored.select(F.col("doc_id").cast("long").alias("doc_id"), "score").join(marks, "doc_id")
    step = F.floor(F.col("score") * STEPS).cast("int").alias("step")
    rows = marked.groupBy("mark", step).count().collect()  # 2 x (STEPS + 1) rows at most
    counts = np.zeros((2, STEPS + 2))
    for r in rows:
        counts[r["mark"], r["step"] + 1] += r["count"]
    if not counts.sum(axis=1).all():
        return 0.0
    below = np.cumsum(counts, axis=1)[:, :-1] / counts.sum(axis=1, keepdims=True)
    error = np.round(GOOD_WEIGHT * below[1] + 1 - below[0], 12)
    levels = np.flatnonzero(error == error.min())
    return float(levels[len(levels) // 2]) / STEPS

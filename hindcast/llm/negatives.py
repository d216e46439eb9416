"""Hard negatives by segment summaries: exact top lists without scoring every pair.

Every vector is cut into segments, coarsely and then finely (``LEVELS``), and the mean and
deviation (root of the summed squared differences from the mean) of each segment are stored once beside it.  For two
vectors the products of the means, plus or minus the products of the deviations (Cauchy and Schwarz),
bound the inner product.  Pairs whose bounds cannot reach an anchor's list are dropped at the coarse level,
the rest at the fine one, and only what remains is scored.  A list that is full raises what the next pairs must reach.

Two passes over cells of an anchor block and a row lot, both of bounded size: the first finds the anchors' positives,
the second the negatives of each positive inside its band.  A cell returns its best few, and a window
takes the best of all cells, so every row is compared with every anchor and the result is exact.  Only counts reach the driver.

Defined cases: rows with a null id, label, vector or component, or one that is not finite, take no part; rows of one vec_id
count once, the one of the least label and vector; shorter vectors end in zeros; scores beyond a
long count as its largest or smallest value; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hindcast.llm.scratch import kept

LEVELS = (4, 16)
ANCHORS, ROWS, CELLS = 4096, 8192, 1 << 20
EVERY, POSITIVES, NEGATIVES = 100, 5, 10
#: Band of negative scores in tenths of the positive score.
LOW, HIGH = 3, 9
DENSE = 0.2
_LONG = np.iinfo(np.int64)
_SLACK = 1e-6  # squared: allowance for rounding, relative to the vectors' lengths


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, label (moved on where vec_id is divisible by 7) and embedding of the rows that take part, once per vec_id."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = embeddings.where("vec_id is not null and label is not null and embedding is not null").where(fine)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(label.alias("label"), F.col("embedding").cast("array<double>").alias("embedding")).alias("row"))
    return rows.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", "row.embedding")


def segments(q: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean times the root of the length, and deviation, of each segment of each vector; the last deviation column is the rounding allowance."""
    means, devs = [], []
    for part in np.array_split(q, min(parts, max(q.shape[1], 1)), axis=1):
        mean = part.mean(axis=1, keepdims=True) if part.shape[1] else np.zeros((len(q), 1))
        means.append(mean * np.sqrt(part.shape[1]))
        devs.append(np.sqrt(((part - mean) ** 2).sum(axis=1, keepdims=True)))
    return np.hstack(means), np.hstack([*devs, _SLACK * np.sqrt((q * q).sum(axis=1, keepdims=True))])


def summarised(rows: DataFrame, width: int) -> DataFrame:
    """vec_id, label, whole components (floor of 256 x) and the summaries of all levels, as bytes of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                q = np.zeros((part.num_rows, width))
                for i, x in enumerate(part.column("embedding")):
                    own = x.values.to_numpy(zero_copy_only=False)
                    q[i, : len(own)] = np.floor(256 * own)
                sums = np.hstack([x for n in LEVELS for x in segments(q, n)])
                made = [pa.array([x.tobytes() for x in m], pa.binary()) for m in (q, sums)]
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), *made], ["vec_id", "label", "q", "sums"])

    return rows.mapInArrow(run, "vec_id long, label long, q binary, sums binary")


class Vectors:
    """Ids, labels, components and summaries of some rows, by id."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, sums: np.ndarray):
        self.ids, self.labels, self.q, self.sums = ids, labels, q, sums
        self.levels = []
        at = 0
        for n in LEVELS:
            n = min(n, max(q.shape[1], 1))
            self.levels.append((sums[:, at : at + n], sums[:, at + n : at + 2 * n + 1]))
            at += 2 * n + 1

    @classmethod
    def read(cls, table: pa.Table) -> Vectors:
        matrix = lambda name: np.array([np.frombuffer(x.as_buffer(), np.float64) for c in table.column(name).chunks for x in c])
        return cls(table.column("vec_id").to_numpy(), table.column("label").to_numpy(), matrix("q"), matrix("sums"))

    def take(self, at: np.ndarray) -> Vectors:
        return Vectors(self.ids[at], self.labels[at], self.q[at], self.sums[at])


def scores(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact inner products of rows i of a and j of b as longs."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        if len(i) > DENSE * len(a) * len(b):
            return (a @ b.T)[i, j].astype(np.int64)
        return np.concatenate([np.zeros(0), *[np.einsum("ij,ij->i", a[i[k : k + 65536]], b[j[k : k + 65536]]) for k in range(0, len(i), 65536)]]).astype(np.int64)
    whole = lambda m: [[int(x) for x in row] for row in m.tolist()]
    left, right = whole(a), whole(b)
    exact = (sum(x * y for x, y in zip(left[u], right[v])) for u, v in zip(i.tolist(), j.tolist()))
    return np.array([min(max(x, _LONG.min), _LONG.max) for x in exact], np.int64)


def search(anchors: Vectors, rows: Vectors, low: np.ndarray, high: np.ndarray, most: int, same: bool) -> tuple[np.ndarray, ...]:
    """Anchor, list, row and score of the best ``most`` rows of each anchor and list.

    List p of anchor a takes scores from low[a, p] to high[a, p] of rows with the same label (other than itself) or of those with another one.
    """
    n, lists = low.shape
    need = low.copy()
    best = tuple(np.zeros(0, np.int64) for _ in range(4))
    step = max(1, CELLS // max(n, 1))
    for start in range(0, len(rows.ids), step):
        part = rows.take(np.arange(start, min(start + step, len(rows.ids))))
        # Scores are cut to longs, bounds are not.
        least, top = need.min(axis=1), high.max(axis=1)
        least, top = np.where(least == _LONG.min, -np.inf, least), np.where(top == _LONG.max, np.inf, top)
        if same:
            mask = (anchors.labels[:, None] == part.labels) & (anchors.ids[:, None] != part.ids)
        else:
            mask = anchors.labels[:, None] != part.labels
        a, c = np.nonzero(mask)
        for (means, devs), (means2, devs2) in zip(anchors.levels, part.levels):
            if len(a) > DENSE * mask.size:
                middle, spread = (means @ means2.T)[a, c], (devs @ devs2.T)[a, c]
            else:
                middle, spread = np.einsum("ij,ij->i", means[a], means2[c]), np.einsum("ij,ij->i", devs[a], devs2[c])
            near = (middle + spread >= least[a]) & (middle - spread <= top[a])
            a, c = a[near], c[near]
        s = scores(anchors.q, part.q, a, c)
        found = []
        for p in range(lists):
            fits = (s >= need[a, p]) & (s <= high[a, p])
            found.append((a[fits], np.full(int(fits.sum()), p), c[fits] + start, s[fits]))
        best = tuple(np.concatenate([old, *[f[k] for f in found]]) for k, old in enumerate(best))
        group = best[0] * lists + best[1]
        order = np.lexsort((rows.ids[best[2]], ~best[3], group))
        group = group[order]
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
        rank = np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)]))
        best = tuple(x[order[rank < most]] for x in best)
        full = order[rank == most - 1]
        if len(full):
            last = rank == most - 1
            need.reshape(-1)[group[last]] = best[3][np.flatnonzero(rank[rank < most] == most - 1)]
    return best


def _positives(rows: pa.Table, anchors: pa.Table) -> pa.Table:
    names = ["anchor_id", "other_id", "score"]
    if not rows.num_rows or not anchors.num_rows:
        return pa.table([pa.array([], pa.int64())] * 3, names=names)
    rows, anchors = Vectors.read(rows), Vectors.read(anchors)
    out = [[], [], []]
    for label in np.unique(anchors.labels):
        own, others = anchors.take(anchors.labels == label), rows.take(rows.labels == label)
        n = len(own.ids)
        a, _, c, s = search(own, others, np.full((n, 1), _LONG.min), np.full((n, 1), _LONG.max), POSITIVES, True)
        for column, x in zip(out, (own.ids[a], others.ids[c], s)):
            column.append(x)
    return pa.table([pa.array(np.concatenate(x)) for x in out], names=names)


def band(score: int) -> tuple[int, int]:
    """Least and largest negative score beside a positive score."""
    return -(-LOW * score // 10), HIGH * score // 10


def _negatives(rows: pa.Table, anchors: pa.Table) -> pa.Table:
    names = ["anchor_id", "place", "negative_id", "negative_score"]
    if not rows.num_rows or not anchors.num_rows:
        return pa.table([pa.array([], pa.int64())] * 4, names=names)
    wanted = anchors.column("positive_scores").to_pylist()
    rows, anchors = Vectors.read(rows), Vectors.read(anchors)
    low, high = np.ones((len(wanted), POSITIVES), np.int64), np.zeros((len(wanted), POSITIVES), np.int64)
    for i, own in enumerate(wanted):
        for p, score in enumerate(own):
            low[i, p], high[i, p] = band(score)
    a, p, c, s = search(anchors, rows, low, high, NEGATIVES, False)
    return pa.table([pa.array(x) for x in (anchors.ids[a], p, rows.ids[c], s)], names=names)


def _cells(rows: DataFrame, anchors: DataFrame, blocks: int, lots: int):
    """Rows and anchors grouped by (block, lot): rows go to every block, anchors to every lot."""
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("lot", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(lots)).cast("int")).withColumn("block", each(blocks))
    right = anchors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("lot", each(lots))
    return left.groupBy("block", "lot").cogroup(right.groupBy("block", "lot"))


def _best(found: DataFrame, keys: list[str], score: str, other: str, most: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), other))
    return found.withColumn("rank", place).where(F.col("rank") <= most)


def positives(rows: DataFrame, anchors: DataFrame, blocks: int, lots: int) -> DataFrame:
    """anchor_id, other_id, score and rank (from 1) of the best rows of the anchor's label."""
    found = _cells(rows, anchors, blocks, lots).applyInArrow(_positives, "anchor_id long, other_id long, score long")
    return _best(found, ["anchor_id"], "score", "other_id", POSITIVES)


def mine(embeddings: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for every anchor (vec_id divisible by 100)."""
    slim = embeddings.select("vec_id", "embedding", "label")
    width = slim.agg(F.max(F.size("embedding"))).first()[0] or 0
    rows = kept(summarised(usable(slim), max(int(width), 0)), "vectors")
    anchors = kept(rows.where(F.col("vec_id") % EVERY == 0), "anchors")
    blocks, lots = max(1, -(-anchors.count() // ANCHORS)), max(1, -(-rows.count() // ROWS))
    near = kept(positives(rows, anchors, blocks, lots), "positives")
    lists = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "other_id", "score"))).alias("near"))
    wanted = anchors.join(lists, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "q", "sums", F.col("near.score").alias("positive_scores"))
    found = _cells(rows, wanted, blocks, lots).applyInArrow(_negatives, "anchor_id long, place long, negative_id long, negative_score long")
    best = _best(found, ["anchor_id", "place"], "negative_score", "negative_id", NEGATIVES)
    named = near.select("anchor_id", (F.col("rank") - 1).cast("long").alias("place"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return best.join(named, ["anchor_id", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")

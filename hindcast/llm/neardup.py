"""Near-duplicate documents by HyperMinHash sketches and exact confirmation.

1. ``sketches``: one pass over the texts gives the number of shingles, a 128-bit
   fingerprint of the shingle set and ``BUCKETS`` registers.  A register holds the
   leading zeros (6 bits) and ``MANTISSA`` more bits of the smallest hash in its
   bucket; empty buckets borrow from a fixed order of other buckets, so short texts
   agree as often as their sets do.  Bands of registers become hashes; the threshold
   gives their size (``shape``).
2. Documents with equal sets form a class, represented by its smallest doc_id.
3. Classes sharing a band are joined to the band's smallest class; the components of
   these candidate links are clusters, outside which no link can lie.
4. Inside a cluster the registers' agreement, corrected for chance collisions, drops
   hopeless pairs, and the full sets decide on the others.  Small clusters are decided
   in one place.  Large ones are tested against their best-connected members first;
   only what these do not join is compared with the whole cluster, block by block.
5. The components of the confirmed links give every document its component.

A link whose similarity is at the threshold is missed by all bands with probability
below 1 in 20,000: 4.9e-5 at 0.80 (25 bands of 5), 4.8e-5 at 0.85 (21 bands of 6).  Null and empty texts have no shingles and link with
nothing; rows of one doc_id are one document, which all texts of that doc_id link with others (``repeated``);
a null doc_id links with nothing and gets a null component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm import arrays
from hindcast.llm.components import components
from hindcast.llm.scratch import kept

BUCKET_BITS, MANTISSA = 7, 10
BUCKETS = 1 << BUCKET_BITS
MISSED = 1 / 20_000
BLOCK, BLOCK_SHINGLES = 1024, 4_000_000
HUBS = 3
_REST = 64 - BUCKET_BITS
# The order in which an empty bucket asks the others: a fixed permutation per bucket.
_ASK = np.argsort(arrays.mixed(np.arange(BUCKETS * BUCKETS, dtype=np.uint64) + np.uint64(77)).reshape(BUCKETS, BUCKETS), axis=1)


def shingles(buf: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, one text after the other, and their number before each text.

    A text of fewer than ``k`` words has its whole word sequence as one shingle.
    """
    buf = arrays.LOWER[buf]
    starts, ends, before = arrays.spans(buf, offsets)
    words = arrays.hashes(buf, starts, ends)
    got, _, bounds = arrays.grams(words, before, k)
    short = np.diff(before)
    if ((short > 0) & (short < k)).any():
        parts = [got[bounds[i] : bounds[i + 1]] for i in range(len(short))]
        for i in np.flatnonzero((short > 0) & (short < k)):
            parts[i] = arrays.grams(words[before[i] : before[i + 1]], np.array([0, short[i]]), int(short[i]))[0]
        got = np.concatenate(parts)
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        got[a:b].sort()
    fresh = np.ones(len(got), bool)
    fresh[1:] = got[1:] != got[:-1]
    inner = bounds[(bounds > 0) & (bounds < len(got))]
    fresh[inner] = True
    return got[fresh], np.concatenate([[0], np.cumsum(fresh)])[bounds]


def registers(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Registers of each text: leading zeros and mantissa of the smallest hash of each bucket, none left empty."""
    n = len(bounds) - 1
    home = arrays.of_text(bounds)
    bucket = (sets >> np.uint64(_REST)).astype(np.int64)
    place = home * BUCKETS + bucket
    least = np.ones(len(sets), bool)
    least[1:] = place[1:] != place[:-1]  # sets are ascending, so the first of a bucket is its smallest
    rest = sets[least] & np.uint64((1 << _REST) - 1)
    _, length = np.frexp((rest >> np.uint64(8)).astype(np.float64))
    zeros = (_REST - 8 - length).astype(np.uint64)
    mantissa = ((rest << (zeros + np.uint64(1))) & np.uint64((1 << _REST) - 1)) >> np.uint64(_REST - MANTISSA)
    out = np.zeros((n, BUCKETS), np.uint16)
    out.reshape(-1)[place[least]] = ((zeros + np.uint64(1)) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    full = out.copy()
    row, at = np.nonzero((out == 0) & (np.diff(bounds) > 0)[:, None])
    for turn in range(BUCKETS):
        if not len(row):
            break
        asked = out[row, _ASK[at, turn]]
        full[row, at] = asked
        row, at = row[asked == 0], at[asked == 0]
    return full


def shape(percent: int) -> tuple[int, int]:
    """Bands and registers a band: the largest bands that all miss a link at the threshold with probability ``MISSED`` at most."""
    sizes = [(BUCKETS // rows, rows) for rows in range(1, BUCKETS + 1)]
    return max((x for x in sizes if (1 - (percent / 100) ** x[1]) ** x[0] <= MISSED), key=lambda x: x[1], default=sizes[0])


def bands(regs: np.ndarray, percent: int) -> np.ndarray:
    """One hash per text and band."""
    n, rows = shape(percent)
    part = regs[:, : n * rows].reshape(len(regs), n, rows).astype(np.uint64)
    total = np.zeros(part.shape[:2], np.uint64)
    for i in range(rows):
        total = arrays.mixed(total + part[:, :, i] + np.uint64(0x9E3779B97F4A7C15))
    return arrays.mixed(total + np.arange(n, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimate from the number of equal registers, without the collisions expected by chance.

    ``n`` and ``m`` are the set sizes; the expectation is that of the HyperMinHash paper.
    """
    large, small = np.maximum(n, m).astype(float), np.minimum(n, m).astype(float)
    chance = 0.169919487159739093975 * 2.0 ** (BUCKET_BITS - MANTISSA) * 4 * (large / np.maximum(small, 1)) / ((1 + large) / np.maximum(small, 1)) ** 2
    return (equal - np.minimum(chance, equal)) / BUCKETS


def sketches(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, fp1, fp2 and bands of every row; fingerprints and bands are null without shingles."""
    n = shape(percent)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, fps, keys = [np.empty(0, np.int64)], [np.empty((0, 2), np.int64)], [np.empty((0, n), np.int64)]
            for _, buf, offsets in arrays.slices(batch.column("text")):
                sets, bounds = shingles(buf, offsets, k)
                one = _sums(sets, bounds)
                two = _sums(arrays.mixed(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5)), bounds)
                sizes.append(np.diff(bounds))
                fps.append(np.stack([one, two], axis=1).view(np.int64))
                keys.append(bands(registers(sets, bounds), percent))
            size, fp, key = np.concatenate(sizes), np.concatenate(fps), np.concatenate(keys)
            none = size == 0
            lists = pa.FixedSizeListArray.from_arrays(pa.array(key.reshape(-1)), n).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size), pa.array(fp[:, 0].copy(), mask=none), pa.array(fp[:, 1].copy(), mask=none), lists],
                ["doc_id", "n_shingles", "fp1", "fp2", "bands"],
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(arrays.tidy(run), "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>")


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _with_sets(docs: DataFrame, k: int) -> DataFrame:
    """Replace text by n, regs and the ascending shingle set (bytes); other columns: root, node, block."""
    schema = "root long, node long, part long, hub int, n long, regs binary, shingles binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, buf, offsets in arrays.slices(batch.column("text")):
                sets, bounds = shingles(buf, offsets, k)
                regs = registers(sets, bounds)
                own = batch.slice(row, len(offsets) - 1)
                made = [pa.array(np.diff(bounds)), pa.array([r.tobytes() for r in regs], pa.binary()), pa.array([sets[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())]
                yield pa.RecordBatch.from_arrays([own.column(c) for c in ("root", "node", "part", "hub")] + made, ["root", "node", "part", "hub", "n", "regs", "shingles"])

    return docs.select("root", "node", "part", "hub", "text").mapInArrow(arrays.tidy(run), schema)


class _Groups:
    """Sets and registers of some members, and who is joined already."""

    def __init__(self, table: pa.Table, percent: int):
        self.node = table.column("node").to_numpy()
        self.n = table.column("n").to_numpy()
        self.sets = [np.frombuffer(x.as_buffer(), np.uint64) for c in table.column("shingles").chunks for x in c]
        self.regs = np.stack([np.frombuffer(x.as_buffer(), np.uint16) for c in table.column("regs").chunks for x in c])
        self.percent = percent
        self.up = list(range(len(self.node)))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def linked(self, i: int, j: int) -> bool:
        return linked(self.sets[i], self.sets[j], self.percent)

    def candidates(self, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
        """Pairs of ``left`` and ``right`` that may be linked, the likeliest first."""
        found = []
        for i in left.tolist():
            n, m = self.n[i], self.n[right]
            of = right[(100 * np.minimum(n, m) >= self.percent * np.maximum(n, m)) & (right != i)]
            if len(of):
                guess = estimate((self.regs[of] == self.regs[i]).sum(axis=1), np.full(len(of), n), self.n[of])
                share = self.percent / 100
                slack = 4.5 * np.sqrt(share * (1 - share) / np.minimum(BUCKETS, np.maximum(n, self.n[of])))
                near = guess >= share - slack
                found.append(np.stack([np.full(near.sum(), i), of[near], -np.rint(guess[near] * 1e6).astype(np.int64)]))
        if not found:
            return iter(())
        every = np.concatenate(found, axis=1)
        every = every[:, np.argsort(every[2], kind="stable")]
        return zip(every[0].tolist(), every[1].tolist())

    def join(self, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
        links = []
        for i, j in self.candidates(left, right):
            a, b = self.find(i), self.find(j)
            if a != b and self.linked(i, j):
                self.up[max(a, b)] = min(a, b)
                links.append((i, j))
        return links


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 x intersection >= percent x union of two ascending sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of neighbouring rows with equal keys."""
    waiting: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        key = np.stack([table.column(k).to_numpy() for k in keys], axis=1)
        edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
        for a, b in zip(edges[:-1], edges[1:]):
            part = table.slice(a, b - a)
            if waiting and any(waiting[-1].column(k)[0].as_py() != part.column(k)[0].as_py() for k in keys):
                yield pa.concat_tables(waiting)
                waiting = []
            waiting.append(part)
    if waiting:
        yield pa.concat_tables(waiting)


LINKS = "a long, b long"


def _decide(percent: int, keys: list[str]):
    """Links that join members of one key; with a column ``rest``, only pairs with a member that has rest = 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, keys):
            if table.num_rows < 2:
                continue
            group = _Groups(table, percent)
            every = np.arange(table.num_rows)
            if "rest" in table.column_names:
                rest = table.column("rest").to_numpy()
                label = table.column("joined").to_numpy()
                for one in np.unique(label):
                    same = np.flatnonzero(label == one)
                    for i in same:
                        group.up[i] = int(same[0])
                links = group.join(every[rest == 1], every[rest == 0])
            else:
                order = np.argsort(group.n, kind="stable")
                links = [x for at in range(len(order) - 1) for x in group.join(order[at : at + 1], order[at + 1 :])] if len(order) <= 3 else group.join(every, every)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(group.node[np.array(side)]) for side in zip(*links)], ["a", "b"])

    return run


def _tested(percent: int):
    """Rows whose two sets are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [[np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(c)] for c in ("shingles", "hub_shingles")]
            keep = np.array([linked(x, y, percent) for x, y in zip(*sides)], bool)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"])

    return run


def links(docs: DataFrame, sketched: DataFrame, k: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) that connect exactly the documents that all confirmed links connect."""
    # Rows of one class have the same bands.
    classes = sketched.where(F.col("fp1").isNotNull() & F.col("doc_id").isNotNull()).groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"))
    rows = classes.select("node", "n_shingles", F.explode("bands").alias("key"))
    heads = rows.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("met")).where("met > 1")
    met = kept(rows.join(heads, "key").select("node", "n_shingles", "head", "met"), "met")
    clusters = components(met.select(F.col("node").alias("a"), F.col("head").alias("b")))
    degree = met.groupBy("node").agg(F.sum("met").alias("degree"), F.max("n_shingles").alias("n"))
    members = kept(clusters.join(degree, "node"), "members")
    size = members.groupBy("root").agg(F.count("*").alias("size"), F.sum("n").alias("weight"))
    # Parts of a cluster; only large clusters have more than one.
    parts = F.ceil(F.greatest(F.col("size") / F.lit(BLOCK), F.col("weight") / F.lit(BLOCK_SHINGLES)))
    size = kept(size.select("root", parts.alias("parts")), "clusters")
    large = size.where("parts > 1")
    # The HUBS best-connected members of each large cluster, by repeated aggregation.
    hubs, left = None, members.join(large, "root").select("root", "node", "degree")
    for turn in range(HUBS):
        best = left.groupBy("root").agg(F.max(F.struct("degree", "node")).alias("best")).select("root", F.col("best.node").alias("node"))
        best = kept(best.withColumn("hub", F.lit(turn)), "hubs")
        hubs = best if hubs is None else hubs.unionByName(best)
        left = left.join(best.select("root", "node"), ["root", "node"], "left_anti")
    placed = members.join(size, "root").select("root", "node", "parts", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"))
    placed = placed.join(hubs, ["root", "node"], "left")
    placed = placed.select("root", "node", F.when(F.col("parts") > 1, F.col("part")).otherwise(F.lit(-1)).alias("part"), "hub")
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    sets = kept(_with_sets(texts.join(placed, "node"), k), "sets")

    near = sets.where("part < 0").repartition("root").sortWithinPartitions("root").select("root", "node", "n", "regs", "shingles")
    found = kept(near.mapInArrow(arrays.tidy(_decide(percent, ["root"])), LINKS), "found")
    if large.isEmpty():
        return found

    many = sets.where("part >= 0")
    hub = many.where("hub is not null").select("root", F.col("node").alias("b"), F.col("shingles").alias("hub_shingles")).join(large, "root")
    hub = hub.select("root", "b", "hub_shingles", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs = many.select("root", "part", F.col("node").alias("a"), "shingles").join(hub, ["root", "part"]).where("a <> b")
    joined = kept(pairs.select("a", "b", "shingles", "hub_shingles").mapInArrow(arrays.tidy(_tested(percent)), LINKS), "joined")

    # What the hubs leave apart is the rest: members outside the component of the best hub.
    label = components(joined)
    state = members.join(large, "root").join(label.withColumnRenamed("root", "joined"), "node", "left")
    state = state.select("root", "node", "parts", F.coalesce("joined", "node").alias("joined"))
    main = state.join(hubs.where("hub = 0").select("root", "node"), ["root", "node"]).select("root", F.col("joined").alias("main"))
    state = kept(state.join(main, "root").withColumn("rest", (F.col("joined") != F.col("main")).cast("int")), "state")
    rests = state.groupBy("root").agg(F.sum("rest").alias("rests"), F.max("parts").alias("parts")).where("rests > 0")
    rests = rests.select("root", "parts", F.ceil(F.col("rests") / F.lit(BLOCK)).alias("rest_parts"))
    many = many.select("root", "node", "part", "n", "regs", "shingles").join(state.select("node", "joined", "rest"), "node").join(rests, "root")
    columns = ["root", "i", "j", "rest", "joined", "node", "n", "regs", "shingles"]
    one = many.where("rest = 1").withColumn("i", F.pmod(F.xxhash64("node", F.lit(1)), F.col("rest_parts"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    all_ = many.withColumn("j", F.col("part")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("rest_parts") - 1))).withColumn("rest", F.lit(0))
    both = one.select(*columns).unionByName(all_.select(*columns))
    both = both.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    late = both.mapInArrow(_decide(percent, ["root", "i", "j"]), LINKS)
    return found.unionByName(joined).unionByName(kept(late, "late"))


def repeated(rows: DataFrame, node: str, marks: list[str]) -> DataFrame:
    """Ids in column ``node`` whose rows differ in ``marks`` (content fingerprints, null for none)."""
    content = F.struct(*marks)
    seen = rows.where(F.col(node).isNotNull()).groupBy(node).agg(F.min(content).alias("low"), F.max(content).alias("high"))
    return seen.where("low <> high").select(node)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs`` (columns doc_id, text)."""
    marks = ["fp1", "fp2", "n_shingles"]
    sketched = kept(sketches(docs, k, percent), "sketches")
    confirmed = links(docs, sketched, k, percent)
    classes = sketched.where(F.col("fp1").isNotNull()).groupBy(*marks).agg(F.min("doc_id").alias("node"))
    # A document with several texts holds their classes together.
    many = kept(repeated(sketched, "doc_id", marks), "repeated")
    own = sketched.join(many, "doc_id").join(classes, marks).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    found = components(confirmed.unionByName(own))
    roots = classes.join(found, "node", "left").select(*marks, F.coalesce("root", "node").alias("root"))
    rows = sketched.select("doc_id", *marks).join(roots, marks, "left")
    home = found.join(many, F.col("node") == F.col("doc_id")).select("doc_id", F.col("root").alias("home"))
    rows = rows.join(home, "doc_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "home", "doc_id")).alias("component_id")
    return rows.select("doc_id", "n_shingles", component).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

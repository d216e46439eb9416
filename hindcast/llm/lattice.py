"""Language-model scores from a lattice of existing subword pieces.

A word is a path of pieces from an existing unigram vocabulary; its probability is
the sum over all segmentations (forward recursion in log space), ending with a stop
symbol so that the probabilities of all words sum to 1.  Piece probabilities start
from the vocabulary's own scores and are re-estimated from the training words by
expectation steps.  Two kinds of longer arcs lie over the pieces: every training word,
and every line of two words or more that the training texts have at least twice, each
with a discounted relative frequency; the discounted mass goes to the finer paths.
The recursion runs over pieces, words and lines, so a text's probability is the sum
over all its segmentations into known lines, known words and pieces, and one end.

Words and pieces have shares of their own in each of ``CLASSES`` classes of training
documents (the most frequent languages, and one class for the rest); a text is scored
without its language, as the sum over the classes weighed by their share.

Training counts cover every training document.  The work is cut into blocks of text;
a block carries the list of its distinct words, so vocabulary and texts meet in one
join on distinct words per block instead of one on all words.

Null texts count as empty (their end is still a token).  Repeated rows count as often
as they occur.  Without training documents N and V are 0 and all mass is on the pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm import arrays, labelled
from hindcast.llm.scratch import kept

FOLDS, HELD = 10, 0
ROUNDS = 1
BLOCK_BYTES = 24 << 20
LINE_DISCOUNT = 0.75
CLASSES = 6
LOG10 = np.log(10.0)


# -- pieces ---------------------------------------------------------------------------------------


def read_pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes (a space for the word mark) with the log of their prior share.

    Files whose scores are negative ranks give shares falling as 1 / (rank + 3); files
    with log probabilities give these.  All single bytes are pieces.
    """
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    score: dict[bytes, float] = {bytes([b]): -np.inf for b in range(256)}
    usual = [i for i in range(library.get_piece_size()) if not (library.is_control(i) or library.is_unknown(i) or library.is_unused(i) or library.is_byte(i))]
    given = np.array([library.get_score(i) for i in usual])
    logs = -np.log(3.0 - given) if given.min() < -100 else given
    for i, log in zip(usual, logs.tolist()):
        piece = library.id_to_piece(i).encode().replace("▁".encode(), b" ")
        if b" " not in piece[1:] and piece != b" ":
            score[piece] = max(score.get(piece, -np.inf), log)
    floor = min(v for v in score.values() if v > -np.inf)
    pieces = sorted(score)
    share = np.array([score[p] if score[p] > -np.inf else floor for p in pieces])
    return pieces, share - np.logaddexp.reduce(share)


#: Words of so many bytes have probabilities that double precision holds; longer ones stay in log space.
LINEAR = 40
Arcs = list[tuple[int, int, np.ndarray, np.ndarray]]


class Lattice:
    """All segmentations of words into pieces."""

    def __init__(self, pieces: list[bytes]):
        joined = np.frombuffer(b"".join(pieces), np.uint8)
        edge = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        key = arrays.hashes(joined, edge[:-1], edge[1:])
        self.order = np.argsort(key)
        self.keys = key[self.order]
        self.lengths = sorted({len(p) for p in pieces})
        self.maybe = np.zeros(1 << 20, bool)  # most substrings are no piece; this says so at once
        self.maybe[key >> np.uint64(44)] = True

    def arcs(self, words: np.ndarray) -> Arcs:
        """(i, j, rows, pieces): in these of the words (equal length, one per row) bytes [i, j) are a piece."""
        n, width = words.shape
        flat = np.ascontiguousarray(words).reshape(-1)
        found = []
        for size in self.lengths:
            if size > width:
                break
            starts = (np.arange(n)[:, None] * width + np.arange(width - size + 1)).reshape(-1)
            key = arrays.hashes(flat, starts, starts + size)
            hit = np.flatnonzero(self.maybe[key >> np.uint64(44)])
            key = key[hit]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            true = self.keys[at] == key
            hit, piece = hit[true], self.order[at[true]]
            row, i = np.divmod(hit, width - size + 1)
            order = np.argsort(i, kind="stable")
            row, piece, i = row[order], piece[order], i[order]
            edges = np.flatnonzero(np.diff(i)) + 1
            found += [(int(f[0]), int(f[0]) + size, r, p) for f, r, p in zip(np.split(i, edges), np.split(row, edges), np.split(piece, edges)) if len(f)]
        return found

    def forward(self, arcs: Arcs, n: int, width: int, logs: np.ndarray) -> np.ndarray:
        """Log probability of the words in each class, without the stop symbol.

        ``logs`` has a row for each piece and a column for each class.
        """
        return self._log(self._paths(arcs, n, width, logs, True)[width], width)

    @staticmethod
    def _log(x: np.ndarray, width: int) -> np.ndarray:
        if width > LINEAR:
            return x
        with np.errstate(divide="ignore"):
            return np.log(x)

    @staticmethod
    def _paths(arcs: Arcs, n: int, width: int, logs: np.ndarray, ahead: bool) -> np.ndarray:
        """Weight of all paths from the start to each place (or from each place to the end)."""
        linear = width <= LINEAR
        weight = np.exp(logs) if linear else logs
        paths = np.full((width + 1, n, logs.shape[1]), 0.0 if linear else -np.inf)
        paths[0 if ahead else width] = 1.0 if linear else 0.0
        for i, j, rows, piece in sorted(arcs, key=(lambda a: (a[1], a[0])) if ahead else (lambda a: (-a[0], a[1]))):
            old, new = (i, j) if ahead else (j, i)
            if linear:
                paths[new][rows] += paths[old][rows] * weight[piece]
            else:
                paths[new][rows] = np.logaddexp(paths[new][rows], paths[old][rows] + weight[piece])
        return paths

    def expected(self, arcs: Arcs, n: int, width: int, logs: np.ndarray, own: np.ndarray, total: np.ndarray) -> None:
        """Add how often each piece is used, on average over the segmentations of the words of each class (``own``)."""
        alpha, beta = self._paths(arcs, n, width, logs, True), self._paths(arcs, n, width, logs, False)
        linear = width <= LINEAR
        weight = np.exp(logs) if linear else logs
        shares = []
        for i, j, rows, piece in arcs:
            if linear:
                share = alpha[i][rows] * weight[piece] * beta[j][rows] / alpha[width][rows]
            else:
                share = np.exp(alpha[i][rows] + weight[piece] + beta[j][rows] - alpha[width][rows])
            shares.append(share * own[rows])
        if arcs:
            piece, share = np.concatenate([a[3] for a in arcs]), np.concatenate(shares)
            for k in range(share.shape[1]):
                total[:, k] += np.bincount(piece, share[:, k], len(total))


def by_width(words: pa.Array, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and bytes (word mark in front) of words of equal length, a bounded number of bytes at a time."""
    words = words.cast(pa.large_binary())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    size = np.diff(offsets)
    order = np.argsort(size, kind="stable")
    edges = np.flatnonzero(np.diff(size[order])) + 1
    for part in np.split(order, edges):
        width = int(size[part[0]]) if len(part) else 0
        if width:
            step = max(1, most // width)
            for a in range(0, len(part), step):
                rows = part[a : a + step]
                text = data[offsets[rows][:, None] + np.arange(width)]
                yield rows, np.concatenate([np.full((len(rows), 1), 32, np.uint8), text], axis=1)


# -- blocks ---------------------------------------------------------------------------------------


def pack(values: np.ndarray) -> bytes:
    """Small non-negative numbers in 7-bit groups, the smallest group first."""
    x = values.astype(np.uint32)
    wide = 1 + (x >= 1 << 7) + (x >= 1 << 14).astype(int) + (x >= 1 << 21)
    out = np.zeros(int(wide.sum()), np.uint8)
    at = np.cumsum(wide) - wide
    for k in range(4):
        own = wide > k
        out[at[own] + k] = (x[own] >> (7 * k) & 127) | ((wide[own] > k + 1).astype(np.uint32) << 7)
    return out.tobytes()


def unpack(data: np.ndarray) -> np.ndarray:
    """The numbers that ``pack`` wrote."""
    if not len(data):
        return np.empty(0, np.int64)
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), starts)


PARTS = "block long, doc_id long, held_out boolean, words binary, lines binary, word binary, place int, size int, times array<int>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as places in their block's word list, and the word lists with their training counts."""
    from pyspark import TaskContext

    task, number, waiting, size = TaskContext.get().partitionId(), 0, [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal number, waiting, size
        if waiting:
            yield from _block((task << 32) + number, waiting)
        number, waiting, size = number + 1, [], 0

    for batch in batches:
        doc_id, of = batch.column("doc_id"), batch.column("class").to_numpy()
        for row, buf, offsets in arrays.slices(batch.column("text")):
            n = len(offsets) - 1
            starts, ends, before = arrays.spans(buf, offsets)
            low = arrays.LOWER[buf]
            own = arrays.hashes(low, starts, ends)
            key, first, back = np.unique(own, return_index=True, return_inverse=True)
            raw = low.tobytes()
            spelled = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
            line_start, line_end, lines = arrays.lines(buf, offsets)
            a, b = np.searchsorted(starts, line_start), np.searchsorted(starts, line_end)
            wide = b - a
            line = np.where(wide > 1, arrays.sequences(own, a, b), np.uint64(0))
            waiting.append((doc_id.slice(row, n), of[row : row + n], before, key, back, spelled, lines, line, wide))
            size += len(buf)
            if size >= BLOCK_BYTES:
                yield from flush()
    yield from flush()


def _block(block: int, slices: list) -> Iterator[pa.RecordBatch]:
    every, at = np.unique(np.concatenate([s[3] for s in slices]), return_index=True)
    spelled = np.array([w for s in slices for w in s[5]], object)[at] if len(every) else np.empty(0, object)
    long = np.concatenate([s[7] for s in slices])
    line, first = np.unique(long, return_index=True)
    wide = np.concatenate([s[8] for s in slices])[first]
    first, line, wide = first[line > 0], line[line > 0], wide[line > 0]
    # A line's key: no word has a line break in it.
    keys = [b"\n" + h.tobytes() + w.tobytes() for h, w in zip(line, wide)]
    spelled = np.concatenate([spelled, np.array([*keys, None], object)[:-1]])
    size = np.concatenate([np.ones(len(every), np.int64), wide])
    times, total = np.zeros((len(size), CLASSES), np.int32), np.zeros(len(size), np.int64)
    numbered = []
    for s in slices:
        words = np.searchsorted(every, s[3])[s[4]]
        lines = np.where(s[7] > 0, len(every) + np.searchsorted(line, s[7]), -1)
        for x, home in ((words, arrays.of_text(s[2])), (lines, arrays.of_text(s[6]))):
            use = x >= 0
            total += np.bincount(x[use], minlength=len(size))
            for k in np.unique(s[1][s[1] >= 0]).tolist():
                times[:, k] += np.bincount(x[use & (s[1] == k)[home]], minlength=len(size)).astype(np.int32)
        numbered.append((words, lines))
    place = np.empty(len(size) + 1, np.int64)
    place[np.argsort(-total, kind="stable")] = np.arange(len(size))  # frequent words get short numbers
    place[-1] = -1
    names = ["block", "doc_id", "held_out", "words", "lines", "word", "place", "size", "times"]
    for s, (words, lines) in zip(slices, numbered):
        n = len(s[0])
        packed = pa.array([pack(place[words[a:b]]) for a, b in zip(s[2][:-1], s[2][1:])], pa.binary())
        # For each line its place plus one (0: none), then its number of words.
        pairs = np.stack([place[lines] + 1, s[8]], axis=1)
        layout = pa.array([pack(pairs[a:b].reshape(-1)) for a, b in zip(s[6][:-1], s[6][1:])], pa.binary())
        columns = [pa.array(np.full(n, block)), s[0], pa.array(s[1] < 0), packed, layout, pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, names)
    for a in range(0, len(size), 10_000):
        b = min(a + 10_000, len(size))
        none = [pa.nulls(b - a, t) for t in (pa.int64(), pa.bool_(), pa.binary(), pa.binary())]
        columns = [pa.array(np.full(b - a, block)), *none, pa.array(spelled[a:b], pa.binary()), pa.array(place[a:b].astype(np.int32)), pa.array(size[a:b].astype(np.int32)), pa.FixedSizeListArray.from_arrays(pa.array(times[a:b].reshape(-1)), CLASSES).cast(pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, names)


# -- the model ------------------------------------------------------------------------------------


def score(docs: DataFrame, path: str, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row (log10)."""
    spark = docs.sparkSession
    held = labelled.held_out(FOLDS, HELD)
    # Class -1: held out, not learned from.  The languages are a top list, not the table's.
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    often = docs.where(~held).groupBy(lang.alias("lang")).count().where("lang is not null").orderBy(F.desc("count"), "lang").limit(CLASSES - 1).collect()
    of = F.lit(CLASSES - 1)
    for k, r in enumerate(often):
        of = F.when(lang == r["lang"], k).otherwise(of)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(held, -1).otherwise(of).alias("class"), "text")
    parts = kept(slim.mapInArrow(_blocks, PARTS), "lm-parts")
    texts = parts.where("word is null")
    # One exchange by word serves the counts and the way back to the blocks.
    listed = parts.where("word is not null").select("block", "word", "place", "size", *[F.col("times")[k].alias(f"c{k}") for k in range(CLASSES)]).repartition("word")
    counted = listed.groupBy("word").agg(F.max("size").alias("size"), *[F.sum(f"c{k}").alias(f"c{k}") for k in range(CLASSES)])
    c = sum((F.col(f"c{k}") for k in range(1, CLASSES)), F.col("c0"))
    counts = kept(counted.withColumn("c", c), "lm-counts")
    word, arc = F.col("size") == 1, (F.col("size") > 1) & (F.col("c") > 1)
    asked = {f"{name}{k}": F.count(F.when(word & x, 1)) for k in (*range(CLASSES), "") for name, x in (("v", F.col(f"c{k}") > 0), ("once", F.col(f"c{k}") == 1), ("twice", F.col(f"c{k}") == 2))}
    asked |= {f"n{k}": F.coalesce(F.sum(F.when(word, F.col(f"c{k}"))), F.lit(0)) for k in (*range(CLASSES), "")}
    asked |= {name: F.coalesce(F.sum(F.when(arc, x)), F.lit(0)) for name, x in (("line_uses", F.col("c")), ("line_words", F.col("c") * F.col("size")), ("lines", F.lit(1)))}
    one = counts.agg(*[x.alias(name) for name, x in asked.items()]).first().asDict()
    ends = np.zeros(CLASSES, np.int64)
    for r in slim.where("class >= 0").groupBy("class").count().collect():
        ends[r["class"]] = r["count"]
    model = _model(one, ends)

    pieces, first = read_pieces(path)
    given = spark.sparkContext.broadcast(pieces)  # the vocabulary file's size
    v = np.array([one[f"v{k}"] for k in range(CLASSES)], float)
    logs, stop = np.repeat((first + np.log(0.8))[:, None], CLASSES, axis=1), np.full(CLASSES, np.log(0.2))
    for _ in range(rounds if v.sum() else 0):
        use = _expected(counts.where("c > 0 and size = 1"), given, logs, np.flatnonzero(v)) + 1e-3
        # A class leans on all classes where it has little to say.
        use = use + 50 * use.sum(axis=1, keepdims=True) / use.sum()
        words = v + 10
        logs, stop = np.log(use / (use.sum(axis=0) + words)), np.log(words / (use.sum(axis=0) + words))
    back = listed.select("block", "word", "place").join(_valued(counts, given, logs, stop, model), "word").select("block", "place", "c", "logs")
    both = texts.select("block", "doc_id", "held_out", "words", "lines", *_nothing("place int, c long, logs binary")).unionByName(
        back.select("block", "place", "c", "logs", *_nothing("doc_id long, held_out boolean, words binary, lines binary"))
    )
    both = both.repartition("block").sortWithinPartitions("block", F.col("place").asc_nulls_last())
    return both.mapInArrow(_scored(model), SCORED)


def _model(one: dict, ends: np.ndarray) -> dict:
    """Totals and discounts of the training words; an end counts as a word."""

    def discount(k) -> float:
        return one[f"once{k}"] / (one[f"once{k}"] + 2 * one[f"twice{k}"]) if one[f"once{k}"] and one[f"twice{k}"] else 0.5

    n = int(one["n"]) + int(ends.sum())
    own = np.array([one[f"n{k}"] for k in range(CLASSES)]) + ends
    units = n - int(one["line_words"]) + int(one["line_uses"])
    with np.errstate(divide="ignore", invalid="ignore"):
        discounts = np.array([discount(k) for k in range(CLASSES)])
        types = np.array([one[f"v{k}"] for k in range(CLASSES)]) + (ends > 0)
        rest = np.where(own > 0, np.log(discounts * types / np.maximum(own, 1)), 0.0)
        share = np.log(ends / ends.sum()) if ends.sum() else np.append(np.full(CLASSES - 1, -np.inf), 0.0)
        finer = np.log((units - int(one["line_uses"]) + LINE_DISCOUNT * int(one["lines"])) / units) if units else 0.0
        last = np.log(np.maximum(ends - discounts, 0) / np.maximum(own, 1)) + finer
    used = np.flatnonzero(own > 0) if own.any() else np.array([CLASSES - 1])
    return {"used": used, "n": n, "v": int(one["v"]) + bool(ends.sum()), "ends": int(ends.sum()), "own": own, "discounts": discounts, "rest": rest, "share": share, "units": units, "finer": finer, "last": last}


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
SCORED_NAMES = [c.split()[0] for c in SCORED.split(", ")]


def _nothing(columns: str) -> list:
    return [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in columns.split(", ")]


def _expected(words: DataFrame, given, logs: np.ndarray, used: np.ndarray) -> np.ndarray:
    """How often the training words of each class use each piece on average; one row per piece comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, total, part = None, np.zeros(logs.shape), np.zeros((len(logs), len(used)))
        for batch in batches:
            lattice = lattice or Lattice(given.value)
            own = np.stack([batch.column(f"c{k}").to_numpy() > 0 for k in used], axis=1)
            for rows, text in by_width(batch.column("word")):
                lattice.expected(lattice.arcs(text), *text.shape, logs[:, used], own[rows], part)
        total[:, used] = part
        at = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *[pa.array(total[at, k]) for k in range(CLASSES)]], ["piece", *[f"t{k}" for k in range(CLASSES)]])

    names = [f"t{k}" for k in range(CLASSES)]
    got = words.mapInArrow(run, "piece int, " + ", ".join(f"{c} double" for c in names)).groupBy("piece").agg(*[F.sum(c).alias(c) for c in names]).toPandas()
    out = np.zeros(logs.shape)
    out[got["piece"]] = got[names]
    return out


def _valued(counts: DataFrame, given, logs: np.ndarray, stop: np.ndarray, model: dict) -> DataFrame:
    """word, c and logs: training count, and the log probability in each class that has training texts (32-bit floats)."""
    shared = counts.sparkSession.sparkContext.broadcast(logs)
    used = model["used"]
    ending = stop - np.log1p(-np.exp(stop)) + model["rest"] + model["finer"]  # no empty words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = None
        for batch in batches:
            lattice = lattice or Lattice(given.value)
            c, word = batch.column("c").to_numpy(), batch.column("size").to_numpy() == 1
            own = np.stack([batch.column(f"c{k}").to_numpy() for k in range(CLASSES)], axis=1)
            log = np.zeros(own.shape)  # classes without training texts have no share in the sum
            spelled = np.flatnonzero(word)
            for rows, text in by_width(batch.column("word").take(pa.array(spelled))):
                log[np.ix_(spelled[rows], used)] = lattice.forward(lattice.arcs(text), *text.shape, shared.value[:, used])
            log += ending
            with np.errstate(divide="ignore"):
                whole = np.log(np.maximum(own - model["discounts"], 0) / np.maximum(model["own"], 1)) + model["finer"]
                log[word] = np.logaddexp(log[word], whole[word])
                log[~word] = np.log(np.where(c > 1, c - LINE_DISCOUNT, 0) / max(model["units"], 1))[~word, None]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(c), pa.array([x.tobytes() for x in log[:, used].astype(np.float32)], pa.binary())], ["word", "c", "logs"])

    return counts.mapInArrow(run, "word binary, c long, logs binary")


def _scored(model: dict):
    n, v, ends, width = model["n"], model["v"], model["ends"], len(model["used"])
    share, last = model["share"][model["used"]], model["last"][model["used"]]

    def plain(c):
        return np.log10((c + 0.1) / (n + 0.1 * (v + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Each block: its word list in order of place, then its texts.
        block, table, lists = None, None, []
        for batch in batches:
            of = batch.column("block").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for a, b in zip(edges[:-1], edges[1:]):
                part = batch.slice(a, b - a)
                if not part.num_rows:
                    continue
                if of[a] != block:
                    block, table, lists = of[a], None, []
                rows = len(part) - part.column("place").null_count
                if rows:
                    logs = np.frombuffer(b"".join(part.column("logs").slice(0, rows).to_pylist()), np.float32).reshape(rows, width)
                    lists.append((part.column("c").slice(0, rows).to_numpy(), logs))
                texts = part.slice(rows)
                if not texts.num_rows:
                    continue
                if table is None:
                    counts = np.concatenate([np.empty(0, np.int64), *[x[0] for x in lists]])
                    logs = np.concatenate([np.empty((0, width), np.float32), *[x[1] for x in lists], np.full((1, width), -np.inf, np.float32)])
                    table, lists = (counts > 0, plain(counts), logs), []
                out: tuple[list, list, list, list] = ([], [], [], [])
                for words, lines in zip(texts.column("words"), texts.column("lines")):
                    place = unpack(np.frombuffer(words.as_buffer(), np.uint8))
                    line, wide = unpack(np.frombuffer(lines.as_buffer(), np.uint8)).reshape(-1, 2).T
                    edge = np.concatenate([[0], np.cumsum(wide)])
                    total = np.concatenate([np.zeros((1, width)), np.cumsum(table[2][place], axis=0, dtype=np.float64)])
                    paths = total[edge[1:]] - total[edge[:-1]]
                    by_class = np.logaddexp(paths, table[2][line - 1].astype(np.float64)).sum(axis=0)
                    value = np.logaddexp.reduce(share + by_class + last) if ends else by_class[-1]
                    for x, made in zip((len(place) + 1, int(table[0][place].sum()) + (ends > 0), float(table[1][place].sum() + plain(ends)) if n else 0.0, float(value / LOG10)), out):
                        made.append(x)
                made = [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
                made.insert(2, pa.array(np.full(texts.num_rows, n, np.int64)))
                yield pa.RecordBatch.from_arrays([texts.column("doc_id"), texts.column("held_out"), *made], SCORED_NAMES)

    return run

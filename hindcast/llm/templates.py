"""Line dedup with a log-template tree.

Lines are parsed by a tree of fixed depth: token count first, then the ``DEPTH`` leading
tokens; tokens with a digit count as a variable field everywhere.  Inside a leaf, lines
that agree on at least ``ALIKE`` of their positions fall under one template; where they
differ the template has a field.  A template that occurs in ``DOCS`` documents or more,
or in ``TWO`` if it has ``LONG`` tokens or more, is boilerplate: its first occurrence (smallest doc_id, then first line) stays and all
others are dropped.

Lines travel as hashes.  Equal lines are counted by partial aggregation before anything
else; only leaves with several different lines need their tokens, and only one
occurrence of each such line sends them.  Leaves with more than ``BLOCK`` different lines
get the same templates by joins: lines that are alike agree on one whole piece of their
positions, if there is one piece more than positions they may differ in.  Texts meet line numbers by merge joins at every size, as both grow with the corpus; so the
texts are dealt out twice, once for the wanted tokens and once for the result.

Lines of fewer than ``TOKENS`` tokens stay.  Null texts count as empty.  Rows of one
doc_id are one document; rows without a doc_id pass unchanged.  An empty table gives an
empty result; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.llm import arrays
from hindcast.llm.neardup import _runs
from hindcast.llm.scratch import kept

DEPTH = 3
TOKENS = 3
DOCS = 3
LONG, TWO = 20, 2
ALIKE = 0.8
BLOCK = 2048
_DIGIT = np.isin(np.arange(256), np.arange(48, 58))
_FIELD = np.uint64(0x5BD1E9955BD1E995)


class Lines:
    """Lines of a slice of texts: tokens (fields masked), their runs, leaf and line hashes."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        starts, ends, _ = arrays.spans(buf, offsets)
        self.tokens = arrays.hashes(arrays.LOWER[buf], starts, ends)
        digits = np.concatenate([[0], np.cumsum(_DIGIT[buf])])
        self.tokens[digits[ends] > digits[starts]] = _FIELD
        self.starts, self.ends, self.before = arrays.lines(buf, offsets)
        self.first, self.last = np.searchsorted(starts, self.starts), np.searchsorted(starts, self.ends)
        self.width = self.last - self.first
        self.line = arrays.sequences(self.tokens, self.first, self.last).view(np.int64)
        head = arrays.sequences(self.tokens, self.first, np.minimum(self.first + DEPTH, self.last))
        self.leaf = arrays.mixed(head + self.width.astype(np.uint64)).view(np.int64)
        self.number = np.arange(len(self.starts)) - np.repeat(self.before[:-1], np.diff(self.before))


OCCURRENCE = "doc_id long, number int, leaf long, line long, width int"


def occurrences(docs: DataFrame) -> DataFrame:
    """One row per line of ``TOKENS`` tokens or more: doc_id, number in its text, leaf, line and width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id = batch.column("doc_id").to_numpy()
            for row, buf, offsets in arrays.slices(batch.column("text")):
                x = Lines(buf, offsets)
                use = x.width >= TOKENS
                home = row + arrays.of_text(x.before)[use]
                made = [doc_id[home], x.number[use].astype(np.int32), x.leaf[use], x.line[use], x.width[use].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(m) for m in made], ["doc_id", "number", "leaf", "line", "width"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    return slim.mapInArrow(arrays.tidy(run), OCCURRENCE)


def _tokens(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """leaf, line and tokens (32 bits each) of the wanted occurrences (doc_id, number, leaf, line)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column("asked").to_pylist()
            leaf, line, tokens = [], [], []
            for row, buf, offsets in arrays.slices(batch.column("text")):
                x = Lines(buf, offsets)
                for i in range(len(offsets) - 1):
                    for a in asked[row + i]:
                        at = x.before[i] + a["number"]
                        if at < x.before[i + 1] and x.line[at] == a["line"]:
                            leaf.append(a["leaf"])
                            line.append(a["line"])
                            tokens.append(x.tokens[x.first[at] : x.last[at]].astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), pa.array(line, pa.int64()), pa.array(tokens, pa.binary())], ["leaf", "line", "tokens"])

    asked = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("number", "leaf", "line")).alias("asked"))  # lines of one text
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(asked.hint("merge"), "doc_id")
    return slim.mapInArrow(arrays.tidy(run), "leaf long, line long, tokens binary").dropDuplicates(["leaf", "line"])


def _lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each line of a leaf, the line that leads its template (the commonest comes first)."""
    for table in _runs(batches, ["leaf"]):
        line, weight = table.column("line").to_numpy(), table.column("docs").to_numpy()
        tokens = np.stack([np.frombuffer(x.as_buffer(), np.uint32) for c in table.column("tokens").chunks for x in c])
        order = np.lexsort((line, -weight))
        lead = np.empty(len(line), np.int64)
        leaders = np.empty(len(line), np.int64)
        n = 0
        for i in order:
            if n:
                same = (tokens[leaders[:n]] == tokens[i]).mean(axis=1)
                best = int(same.argmax())
                if same[best] >= ALIKE:
                    lead[i] = line[leaders[best]]
                    continue
            leaders[n], lead[i], n = i, line[i], n + 1
        yield pa.RecordBatch.from_arrays([pa.array(table.column("leaf").to_numpy()), pa.array(line), pa.array(lead)], ["leaf", "line", "lead"])


PIECES = "leaf long, key long, line long, docs long, tokens binary"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per line and piece of the positions past the leading tokens, one piece more than two alike lines may differ in."""
    for batch in batches:
        home, keys = [], []
        for row, raw in enumerate(batch.column("tokens")):
            t = np.frombuffer(raw.as_buffer(), np.uint32).astype(np.uint64)
            n = 1 + np.count_nonzero(np.arange(len(t)) / len(t) >= ALIKE)
            edges = DEPTH + np.arange(n + 1) * (len(t) - DEPTH) // n
            keys.append(arrays.mixed(arrays.sequences(t, edges[:-1], edges[1:]) + np.arange(n, dtype=np.uint64)).view(np.int64))
            home += [row] * n
        key = np.concatenate(keys) if keys else np.empty(0, np.int64)
        own = batch.take(pa.array(home, pa.int64()))
        yield pa.RecordBatch.from_arrays([own.column("leaf"), pa.array(key), own.column("line"), own.column("docs"), own.column("tokens")], ["leaf", "key", "line", "docs", "tokens"])


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each asking line the answer before it that agrees best, the first of equals."""
    for table in _runs(batches, ["leaf", "key", "i", "j"]):
        asks = table.column("asks").to_numpy() == 1
        if asks.all() or not asks.any():
            continue
        line, docs = table.column("line").to_numpy(), table.column("docs").to_numpy()
        tokens = np.stack([np.frombuffer(x.as_buffer(), np.uint32) for c in table.column("tokens").chunks for x in c])
        own, own_line, own_docs = tokens[asks], line[asks], docs[asks]
        best, lead = np.zeros(len(own)), np.full(len(own), -1)
        order = np.lexsort((line, -docs))
        for i in order[~asks[order]]:
            same = (own == tokens[i]).mean(axis=1)
            after = (own_docs < docs[i]) | (own_docs == docs[i]) & (own_line > line[i])
            better = after & (same >= ALIKE) & (same > best)
            best[better], lead[better] = same[better], i
        hit = lead >= 0
        made = [table.column("leaf").to_numpy()[asks][hit], own_line[hit], line[lead[hit]], docs[lead[hit]], best[hit]]
        yield pa.RecordBatch.from_arrays([pa.array(m) for m in made], ["leaf", "line", "lead", "docs", "same"])


def _best(asking: DataFrame, answers: DataFrame) -> DataFrame:
    """leaf, line and lead: for lines of ``asking`` the alike line of ``answers`` that comes before it and agrees best.

    Both come in pieces.  Lines that share a piece meet in squares of ``BLOCK`` by ``BLOCK`` lines.
    """
    parts = lambda x, name: x.groupBy("leaf", "key").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias(name))
    size = parts(asking, "rows").join(parts(answers, "columns"), ["leaf", "key"])
    own = lambda name: F.pmod(F.xxhash64("line"), F.col(name))
    each = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(name) - 1))
    columns = ["leaf", "key", "i", "j", "line", "docs", "tokens", "asks"]
    one = asking.join(size, ["leaf", "key"]).withColumn("i", own("rows")).withColumn("j", each("columns")).withColumn("asks", F.lit(1))
    two = answers.join(size, ["leaf", "key"]).withColumn("j", own("columns")).withColumn("i", each("rows")).withColumn("asks", F.lit(0))
    met = one.select(*columns).unionByName(two.select(*columns)).repartition("leaf", "key", "i", "j").sortWithinPartitions("leaf", "key", "i", "j")
    found = met.mapInArrow(_nearest, "leaf long, line long, lead long, docs long, same double")
    best = found.groupBy("leaf", "line").agg(F.min(F.struct((-F.col("same")).alias("same"), (-F.col("docs")).alias("docs"), "lead")).alias("best"))
    return best.select("leaf", "line", "best.lead")


def _led(lines: DataFrame) -> DataFrame:
    """What ``_lead`` finds, without the leaders themselves, for leaves of any size.

    A line leads if no leader before it is alike.  In each round the open lines without
    an alike open line before them become leaders and close all lines alike to them; the
    first open line of a leaf always is one, so the rounds end.  Most lines are alike to
    the first line of one of their pieces; only the others are held against whole pieces.
    """
    on = ["leaf", "line"]
    every = kept(lines.mapInArrow(_pieces, PIECES), "pieces")
    left, leaders = every, None
    while True:
        first = F.min(F.struct((-F.col("docs")).alias("docs"), "line", "tokens")).alias("first")
        heads = left.groupBy("leaf", "key").agg(first, F.count("*").alias("n")).where("n > 1")
        heads = heads.select("leaf", "key", "first.line", (-F.col("first.docs")).alias("docs"), "first.tokens")
        rest = kept(left.join(_best(left, heads), on, "left_anti"), "rest")
        fresh = kept(rest.join(_best(rest, left), on, "left_anti"), "fresh")
        leaders = fresh if leaders is None else leaders.unionByName(fresh)
        others = kept(left.join(fresh.select(*on).distinct(), on, "left_anti"), "others")
        left = kept(others.join(_best(others, fresh), on, "left_anti"), "left")
        if left.isEmpty():
            break
    return _best(every.join(leaders.select(*on).distinct(), on, "left_anti"), leaders)


def _enough(least: int) -> Column:
    """The number of documents from which lines of this width are boilerplate."""
    return F.when(F.col("width") >= LONG, F.lit(min(least, TWO))).otherwise(F.lit(least))


def templates(docs: DataFrame, found: DataFrame, least: int = DOCS) -> DataFrame:
    """leaf, line and template of the lines that share a template with other lines."""
    pairs = found.select("leaf", "line", "doc_id").distinct()
    lines = pairs.groupBy("leaf", "line").agg(F.count("*").alias("docs"))
    lines = lines.join(found.groupBy("leaf", "line").agg(F.min(F.struct("doc_id", "number")).alias("one"), F.max("width").alias("width")), ["leaf", "line"])
    lines = kept(lines.select("leaf", "line", "docs", "width", "one.doc_id", "one.number"), "lines")
    # A leaf matters if it has several lines and enough documents.
    leaves = lines.groupBy("leaf").agg(F.count("*").alias("n"), F.sum("docs").alias("all"), F.max("width").alias("width")).where((F.col("n") > 1) & (F.col("all") >= _enough(least)))
    active = kept(lines.join(leaves.select("leaf", (F.col("n") > BLOCK).alias("large")), "leaf"), "active")
    tokens = _tokens(docs, active.select("doc_id", "number", "leaf", "line"))
    left = kept(active.select("leaf", "line", "docs", "large").join(tokens, ["leaf", "line"]), "tokens")
    small = left.where("not large").select("leaf", "line", "docs", "tokens").repartition("leaf").sortWithinPartitions("leaf")
    chain = kept(small.mapInArrow(arrays.tidy(_lead), "leaf long, line long, lead long"), "lead").where("line <> lead")
    many = left.where("large").select("leaf", "line", "docs", "tokens")
    if not many.isEmpty():
        chain = chain.unionByName(kept(_led(many), "led"))
    return chain.select("leaf", "line", F.col("lead").alias("template"))


def drops(docs: DataFrame, least: int = DOCS) -> DataFrame:
    """doc_id, number and line of every occurrence that goes."""
    found = kept(occurrences(docs), "occurrences")
    under = templates(docs, found, least)
    rows = found.join(under, ["leaf", "line"], "left").select("doc_id", "number", "line", "leaf", "width", F.coalesce("template", "line").alias("template"))
    pairs = rows.groupBy("leaf", "template", "doc_id").agg(F.min("number").alias("number"), F.max("width").alias("width"))
    many = pairs.groupBy("leaf", "template").agg(F.count("*").alias("docs"), F.min(F.struct("doc_id", "number")).alias("first"), F.max("width").alias("width")).where(F.col("docs") >= _enough(least))
    met = rows.join(many.select("leaf", "template", F.col("first.doc_id").alias("first_doc"), F.col("first.number").alias("first_number")), ["leaf", "template"])
    return met.where("doc_id <> first_doc or number <> first_number").select("doc_id", "number", "line")


def dedup(docs: DataFrame, least: int = DOCS, text_col: str = "text") -> DataFrame:
    """``docs`` without the dropped lines, and n_lines and n_dropped (replacing columns of these names)."""
    if text_col != "text":
        raise ValueError("the text column is called text")
    gone = drops(docs, least).groupBy("doc_id").agg(F.collect_list(F.struct("number", "line")).alias("__gone"))
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    joined = docs.select(*[F.col(f"`{c}`") for c in columns], F.col("doc_id").cast("long").alias("__doc")).join(gone.withColumnRenamed("doc_id", "__of").hint("merge"), F.col("__doc") == F.col("__of"), "left")
    joined = joined.select(*[F.col(f"`{c}`") for c in columns], "__gone")
    schema = docs.select(*[F.col(f"`{c}`") for c in columns]).schema.add("n_lines", "long").add("n_dropped", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, texts = batch.column("__gone").to_pylist(), batch.column("text").to_pylist()
            n, dropped = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for row, buf, offsets in arrays.slices(batch.column("text")):
                own = gone[row : row + len(offsets) - 1]
                x = Lines(buf, offsets) if any(own) else None
                n[row : row + len(own)] = np.diff(arrays.lines(buf, offsets)[2])
                for i, out in enumerate(own):
                    if out:
                        number = np.array([g["number"] for g in out])
                        fits = number < x.before[i + 1] - x.before[i]
                        at = x.before[i] + number[fits]
                        at = at[x.line[at] == np.array([g["line"] for g in out])[fits]]
                        keep = np.ones(x.before[i + 1] - x.before[i], bool)
                        keep[at - x.before[i]] = False
                        raw = texts[row + i].split("\n")
                        texts[row + i] = "\n".join(line for line, k in zip(raw, keep.tolist()) if k)
                        dropped[row + i] = len(at)
            made = {"text": pa.array(texts, batch.column("text").type), "n_lines": pa.array(n), "n_dropped": pa.array(dropped)}
            names = [*columns, "n_lines", "n_dropped"]
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in names], names)

    return joined.mapInArrow(arrays.tidy(run), schema)

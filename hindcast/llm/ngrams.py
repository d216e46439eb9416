"""Quality rules by hashed n-gram likelihood ratio between trusted and raw text.

Two multinomials over hash buckets are counted: one from trusted documents (quality
mark 1), one from all documents.  A text's value is the mean over its n-grams (one
and two words, A-Z lower-cased) of log p_trusted - log p_raw, so length does not
matter.  Texts whose value lies below ``LEAST`` fail; there is no draw.  The plain
rules beside it (too few words, repeated word windows) fail texts as well.

Counts cover every document; what moves is one vector of ``BUCKETS`` numbers per task,
summed by Spark.  Null and empty texts have no n-grams, value 0, and fail the plain
rule on word count.  Without trusted documents both multinomials are the raw one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm import arrays

BUCKETS = 1 << 14
SMOOTH = 0.5
LEAST = -0.2
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_CHARACTER = np.arange(256) & 0xC0 != 0x80


def buckets(words: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram (single words, then pairs of words) and its text."""
    parts, homes = [], []
    for k in (1, 2):
        key, _, bounds = arrays.grams(words, before, k)
        parts.append((key % np.uint64(BUCKETS)).astype(np.int64))
        homes.append(arrays.of_text(bounds))
    return np.concatenate(parts), np.concatenate(homes)


def _again(key: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether its text has it more than once, and whether it had it before."""
    order = np.lexsort((np.arange(len(key)), key, home))
    same = np.zeros(len(key), bool)
    same[1:] = (key[order][1:] == key[order][:-1]) & (home[order][1:] == home[order][:-1])
    more = same.copy()
    more[:-1] |= same[1:]
    out = np.zeros((2, len(key)), bool)
    out[0, order], out[1, order] = more, same
    return out[0], out[1]


def rules(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of the plain rules for each text."""
    starts, ends, before = arrays.spans(buf, offsets)
    words = arrays.hashes(buf, starts, ends)
    solid = ~arrays.SPACE[buf]
    window, at, bounds = arrays.grams(words, before, 5)
    often, _ = _again(window, arrays.of_text(bounds))
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at[often], 1)
    np.add.at(cover, at[often] + 5, -1)
    line_start, line_end, lines = arrays.lines(buf, offsets)
    _, copied = _again(arrays.hashes(buf, line_start, line_end), arrays.of_text(lines))
    worded = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    return {
        "n_words": np.diff(before),
        "word_chars": arrays.sums(solid & _CHARACTER[buf], offsets),
        "n_symbols": arrays.sums(_SYMBOL[buf], offsets),
        "n_dup_lines": arrays.sums(copied & worded, lines),
        "n_repeat_words": arrays.sums(np.cumsum(cover)[:-1] > 0, before),
    }


def counts(docs: DataFrame) -> DataFrame:
    """bucket, trusted and raw: n-gram counts over all rows of ``docs`` (text, trusted boolean)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            trusted = batch.column("trusted").fill_null(False).to_numpy(zero_copy_only=False)
            for row, buf, offsets in arrays.slices(batch.column("text")):
                buf = arrays.LOWER[buf]
                starts, ends, before = arrays.spans(buf, offsets)
                key, home = buckets(arrays.hashes(buf, starts, ends), before)
                total[1] += np.bincount(key, minlength=BUCKETS)
                total[0] += np.bincount(key[trusted[row + home]], minlength=BUCKETS)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS, dtype=np.int32)), pa.array(total[0]), pa.array(total[1])], ["bucket", "trusted", "raw"])

    made = docs.select("text", "trusted").mapInArrow(run, "bucket int, trusted long, raw long")
    return made.groupBy("bucket").agg(F.sum("trusted").alias("trusted"), F.sum("raw").alias("raw"))


def ratios(counted: DataFrame) -> np.ndarray:
    """log p_trusted - log p_raw of every bucket; BUCKETS rows come to the driver."""
    got = counted.toPandas()
    table = np.zeros((2, BUCKETS))
    table[:, got["bucket"]] = got[["trusted", "raw"]].to_numpy().T
    if not table[0].any():
        return np.zeros(BUCKETS)
    share = (table + SMOOTH) / (table + SMOOTH).sum(axis=1, keepdims=True)
    return np.log(share[0]) - np.log(share[1])


def judge(docs: DataFrame, trusted_ids: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, the counts of the plain rules, ratio, base_failed and kept of every row.

    ``trusted_ids`` has one column doc_id; repeated and null ids are harmless.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # The ids grow with the corpus: one plan, a merge join, at every size.
    known = trusted_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("trusted", F.lit(True))
    shared = docs.sparkSession.sparkContext.broadcast(ratios(counts(slim.join(known.hint("merge"), "doc_id", "left"))))  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
            parts: dict[str, list] = {name: [np.empty(0, np.int64)] for name in names}
            values = [np.empty(0)]
            for _, buf, offsets in arrays.slices(batch.column("text")):
                for name, x in rules(buf, offsets).items():
                    parts[name].append(x)
                buf = arrays.LOWER[buf]
                starts, ends, before = arrays.spans(buf, offsets)
                key, home = buckets(arrays.hashes(buf, starts, ends), before)
                n = len(offsets) - 1
                values.append(np.bincount(home, shared.value[key], n) / np.maximum(np.bincount(home, minlength=n), 1))
            made = [pa.array(np.concatenate(parts[name])) for name in names] + [pa.array(np.concatenate(values))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], ["doc_id", *names, "ratio"])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double"
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return slim.mapInArrow(run, schema).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= least))

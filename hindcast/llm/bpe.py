"""Byte-level BPE: encode whole texts to token ids with offsets, and decode ids to bytes.

A rank file gives the vocabulary as bytes; the tokenizers library wants characters.
Every byte stands for one printable character (``byte_characters``), as byte-level
vocabularies do, and the merges are all splits of a token into two other tokens,
in rank order.  Texts are cut into pre-tokens by the usual pattern
(contractions, letters, digits, other signs - each with one space before it - and
white space); the cut works on Arrow buffers with a class per code point.  Distinct
pre-tokens go through the library once per worker, so a text costs a look-up per
pre-token.  Decoding concatenates token bytes; characters that tokens split come
together again, and every text is checked against its round trip.

Null and empty texts have no tokens.  Lone surrogates cannot occur in Arrow text.
Repeated rows are encoded row by row; clashing extra columns are not touched.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import os
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from hindcast.llm import arrays

CACHE = 1_500_000  # distinct pre-tokens a worker remembers, about 60 bytes each
# Beside columns of ids and offsets less is remembered, and slices are shorter.
BESIDE_LISTS, SHORT = 400_000, arrays.SLICE // 4
LETTER, DIGIT, WHITE, OTHER = 0, 1, 2, 3
APOSTROPHE = 39


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, others above U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(printable))
    places = {b: b for b in printable} | {b: 256 + i for i, b in enumerate(rest)}
    return [chr(places[b]) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by id from a rank file (base64 token, space, rank); ids without a token are empty."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * (1 + max(int(rank) for _, rank in pairs))
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


@functools.cache
def classes() -> np.ndarray:
    """LETTER, DIGIT, WHITE or OTHER for every code point."""
    white = {*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
    first = {"L": LETTER, "N": DIGIT}
    table = np.array([first.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)], np.uint8)
    table[list(white)] = WHITE
    return table


def cuts(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where pre-tokens start among the code points of texts that start at ``edges``."""
    n = len(points)
    if not n:
        return np.empty(0, np.int64)
    kind = classes()[points]
    begins = np.ones(n, bool)
    begins[1:] = kind[1:] != kind[:-1]
    begins[edges[edges < n]] = True
    text_start = np.zeros(n, bool)
    text_start[edges[edges < n]] = True
    last_of_run = np.ones(n, bool)
    last_of_run[:-1] = begins[1:]
    ends_text = np.ones(n, bool)
    ends_text[:-1] = text_start[1:]
    # The last sign of white space before other signs stands alone, or opens the next pre-token if it is a space.
    alone = np.flatnonzero((kind == WHITE) & last_of_run & ~ends_text)
    start = begins.copy()
    start[alone] = True
    joins = alone[points[alone] == 32]
    start[joins + 1] = False
    # A lone apostrophe that opens a pre-token takes s, t, m, d, re, ve or ll from the letters behind it.
    mark = np.flatnonzero((points == APOSTROPHE) & start & last_of_run & ~ends_text)
    mark = mark[kind[mark + 1] == LETTER]
    one = points[mark + 1]
    second = np.where(mark + 2 < n, points[np.minimum(mark + 2, n - 1)], 0)
    second = np.where((mark + 2 < n) & ~text_start[np.minimum(mark + 2, n - 1)], second, 0)
    take = np.select([np.isin(one, [ord(c) for c in "stmd"]), (second == ord("e")) & np.isin(one, [ord("r"), ord("v")]), (one == ord("l")) & (second == ord("l"))], [1, 2, 2], 0)
    mark, take = mark[take > 0], take[take > 0]
    start[mark + 1] = False
    rest = mark + take + 1
    inside = rest < n
    start[rest[inside]] = True
    return np.flatnonzero(start)


class Coder:
    """Encoder and decoder of one vocabulary for one worker."""

    def __init__(self, tokens: list[bytes]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core already
        from tokenizers import Tokenizer, models, pre_tokenizers

        character = byte_characters()
        spelled = ["".join(character[b] for b in t) for t in tokens]
        ids = {t: i for i, t in enumerate(tokens) if t}
        merges = [
            (spelled[ids[t[:k]]], spelled[ids[t[k:]]])
            for t in tokens
            for k in range(1, len(t))
            if t[:k] in ids and t[k:] in ids
        ]
        model = models.BPE(vocab={s: i for i, s in enumerate(spelled) if s}, merges=merges, ignore_merges=True)
        self.library = Tokenizer(model)
        self.library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.bounds = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        self.most = CACHE
        self._forget()

    def _forget(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.places = np.empty(0, np.int64)
        self.counts = np.empty(0, np.int64)
        self.ids = np.empty(0, np.int32)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        found = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        places = len(self.ids) + np.concatenate([[0], np.cumsum(counts)[:-1]])
        ids = np.fromiter(itertools.chain.from_iterable(found), np.int32, int(counts.sum()))
        self.ids = np.concatenate([self.ids, ids])
        at = np.searchsorted(self.keys, keys)  # both are sorted
        self.keys, self.places, self.counts = (np.insert(a, at, b) for a, b in ((self.keys, keys), (self.places, places), (self.counts, counts)))

    def encode(self, buf: np.ndarray, offsets: np.ndarray, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in ``buf`` one after the other, and the number of ids before each text.

        Equal pre-tokens are told by their hash, with ``exact`` by their bytes and without memory.
        """
        raw = buf.tobytes()
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((buf & 0xC0) != 0x80)
        edges = np.searchsorted(lead, offsets)
        begin = cuts(points, edges[:-1])
        starts = lead[begin] if len(begin) else begin
        ends = np.append(starts[1:], len(buf)) if len(starts) else starts
        if exact:
            self._forget()
            seen: dict[bytes, int] = {}
            back = np.fromiter((seen.setdefault(raw[s:e], len(seen)) for s, e in zip(starts.tolist(), ends.tolist())), np.int64, len(starts))
            key, at = np.unique(back, return_index=True)
            key = key.astype(np.uint64)
        else:
            key, at, back = np.unique(arrays.hashes(buf, starts, ends), return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, key)
        new = (place == len(self.keys)) | (self.keys[np.minimum(place, max(len(self.keys) - 1, 0))] != key) if len(self.keys) else np.ones(len(key), bool)
        if new.any():
            if len(self.keys) > self.most:
                self._forget()
                new[:] = True
            self._learn(key[new], [raw[s:e].decode("utf-8") for s, e in zip(starts[at[new]].tolist(), ends[at[new]].tolist())])
            place = np.searchsorted(self.keys, key)
        if not len(key):
            return np.empty(0, np.int32), np.zeros(len(offsets), np.int64)
        places, counts, every = self.places[place][back], self.counts[place][back], self.ids
        if exact:
            self._forget()
        before = np.concatenate([[0], np.cumsum(counts)])
        ids = every[np.arange(before[-1]) + np.repeat(places - before[:-1], counts)]
        return ids, before[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids one after the other, and the number of bytes before each id."""
        counts = self.bounds[ids + 1] - self.bounds[ids]
        before = np.concatenate([[0], np.cumsum(counts)])
        return self.bytes[np.arange(before[-1]) + np.repeat(self.bounds[ids] - before[:-1], counts)], before

    def round_trip(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, ids before each text, bytes decoded from them and bytes before each id."""
        for exact in (False, True):  # two pre-tokens may share a hash: the bytes tell, and then decide
            ids, per = self.encode(buf, offsets, exact)
            out, before = self.decode(ids)
            if np.array_equal(before[per], offsets) and np.array_equal(out, buf):
                return ids, per, out, before
        raise ValueError("the vocabulary does not cover a byte of the text")


_coders: dict[str, Coder] = {}


def _coder(name: str, tokens: list[bytes]) -> Coder:
    if name not in _coders:
        _coders.clear()
        _coders[name] = Coder(tokens)
    return _coders[name]


def _vocabulary(docs: DataFrame, path: str):
    tokens = read_ranks(path)
    name = hashlib.sha256(b"\0".join(tokens)).hexdigest()
    return name, docs.sparkSession.sparkContext.broadcast(tokens)  # bounded by the vocabulary file


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ids, starts and ends (offsets in characters) of the tokens of each text.

    The offsets of a token that holds part of a character cover the whole character.
    New columns replace columns of the same name.
    """
    name, shared = _vocabulary(docs, path)
    kept_columns = [c for c in docs.columns if c not in ("ids", "starts", "ends")]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept_columns]).schema
    for c in ("ids", "starts", "ends"):
        schema = schema.add(c, ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(name, shared.value)
        coder.most = BESIDE_LISTS
        for batch in batches:
            for row, buf, offsets in arrays.slices(batch.column(text_col), SHORT):  # a batch of bounded bytes for each slice
                ids, per, _, before = coder.round_trip(buf, offsets)
                characters = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
                own = np.repeat(characters[offsets[:-1]], np.diff(per))
                # A start inside a character belongs to the character that began before it.
                begun = np.where((buf[before[:-1]] & 0xC0) == 0x80, 1, 0) if len(ids) else 0
                bounds = pa.array(per.astype(np.int32))
                parts = (ids, characters[before[:-1]] - begun - own, characters[before[1:]] - own)
                made = [pa.ListArray.from_arrays(bounds, pa.array(p.astype(np.int32))) for p in parts]
                rows = batch.slice(row, len(offsets) - 1)
                yield pa.RecordBatch.from_arrays([rows.column(c) for c in kept_columns] + made, [*kept_columns, "ids", "starts", "ends"])

    return docs.mapInArrow(arrays.tidy(run), schema)


def decode(docs: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``docs`` with the bytes of its ids as binary column decoded; null ids give null."""
    name, shared = _vocabulary(docs, path)
    kept_columns = [c for c in docs.columns if c != "decoded"]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept_columns]).schema.add("decoded", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(name, shared.value)
        for batch in batches:
            made = [None if x is None else coder.decode(np.array(x, np.int64))[0].tobytes() for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept_columns] + [pa.array(made, pa.binary())], [*kept_columns, "decoded"])

    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, n_bytes and SHA-256 of ids (little-endian, 32 bits each) and of the decoded bytes."""
    name, shared = _vocabulary(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(name, shared.value)
        for batch in batches:
            n = batch.num_rows
            counts, sizes, first, second = np.zeros(n, np.int64), np.zeros(n, np.int64), [""] * n, [""] * n
            for row, buf, offsets in arrays.slices(batch.column("text")):
                ids, per, out, before = coder.round_trip(buf, offsets)
                ids, at = ids.astype("<u4").data.cast("B") if len(ids) else b"", before[per]
                out = out.data if len(out) else b""
                counts[row : row + len(per) - 1], sizes[row : row + len(per) - 1] = np.diff(per), np.diff(at)
                for i in range(len(per) - 1):
                    first[row + i] = hashlib.sha256(ids[4 * per[i] : 4 * per[i + 1]]).hexdigest()
                    second[row + i] = hashlib.sha256(out[at[i] : at[i + 1]]).hexdigest()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), pa.array(sizes), pa.array(first), pa.array(second)], ["doc_id", "n_tokens", "n_bytes", "ids_sha256", "decoded_sha256"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(run, "doc_id long, n_tokens long, n_bytes long, ids_sha256 string, decoded_sha256 string")

"""A quality classifier: hashed word and character n-gram vectors, averaged for a document, and a softmax over two labels.

Training is stochastic gradient descent in numpy over a bounded sample of labelled rows, whose whole texts are counted
in many tasks; the one that trains gets a vector for each, which no text makes longer than there are buckets.  Scoring
needs, for each bucket, only the difference of its two logits, so a document's score is one gather and one mean over its
features.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from functools import partial
from tempfile import SpooledTemporaryFile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm.common import prepare
from stratalens.llm.tokens import in_batches, rows_of

#: Labelled rows that are learned from at most: those with the least hashes.
SAMPLE = 4096
#: Characters of sampled texts that are counted at once; no bound on what is learned from: all of each text is counted.
LEARNED_CHARS = 100_000
#: Bytes of the sample's vectors that the training task holds in memory; more are in a file on its disk.
HELD_BYTES = 1 << 28
BITS = 18
DIM = 16
GRAMS = (3, 4)
SPACE = re.compile("[\x20\x09-\x0D]")
EPOCHS = 6
#: Characters of a text whose features are made at once.
PART = 1 << 20
RATE = 0.1
#: The rate of the vectors of buckets over that of the output: each has a small share of a document.
BOOST = 100.0


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature the buckets, text after text, and the number of them up to the end of each text.

    The kinds: words; pairs of neighbouring words, by the difference of their hashes, so that all repeated words share
    a bucket; and the n-grams of bytes within a word and the white space at its sides.
    """
    coded = [t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"".join(b"\n%b\n" % c for c in coded) + b" " * max(GRAMS), np.uint8)
    ends = np.cumsum([len(c) + 2 for c in coded])
    n = int(ends[-1])
    space = (data == 32) | ((data >= 9) & (data <= 13))
    table = np.random.default_rng(11).integers(1, 1 << 32, 256, dtype=np.uint32) | np.uint32(1)
    table[[9, 10, 11, 12, 13]] = table[32]
    value = table[data]

    def bucket(h: np.ndarray) -> np.ndarray:
        h = h ^ (h >> np.uint32(15))
        h *= np.uint32(0x2C1B3C6D)
        return h >> np.uint32(32 - BITS)

    out = []
    at = np.flatnonzero(~space[:n] & np.concatenate([[True], space[: n - 1]]))
    if len(at):
        length = np.diff(at, append=n)
        place = np.arange(at[0], n) - np.repeat(at, length)
        powers = np.cumprod(np.full(int(length.max()), 0x01000193, np.uint32), dtype=np.uint32)
        letters = value[at[0] : n] * powers[place]
        letters[space[at[0] : n]] = 0
        word = np.add.reduceat(letters, at - at[0], dtype=np.uint32)
        upto = np.searchsorted(at, ends)
        out.append((bucket(word), upto))
        pair = word[1:] - word[:-1]
        pair *= np.uint32(0x9E3779B1)
        within = np.ones(len(pair), bool)
        within[np.clip(upto[:-1] - 1, 0, max(0, len(pair) - 1))[(upto[:-1] > 0) & (upto[:-1] < len(word))]] = False
        kept = np.flatnonzero(within)
        out.append((bucket(pair[kept] + np.uint32(77)), np.searchsorted(kept, np.maximum(upto - 1, 0))))
    h, inside = value[:n].copy(), np.ones(n, bool)
    for size in range(2, max(GRAMS) + 1):
        if size > 2:
            inside &= ~space[size - 2 : n + size - 2]
        h *= np.uint32(0x85EBCA6B)
        h += value[size - 1 : n + size - 1]
        if size in GRAMS:
            at = np.flatnonzero(inside)
            out.append((bucket(h[at] + np.uint32(size)), np.searchsorted(at, ends)))
    return out


def parts_of(text: str) -> list[str]:
    """A text in parts of about PART characters, cut before white space if there is some within so many more."""
    out, at = [], 0
    while len(text) - at > PART:
        m = SPACE.search(text, at + PART, at + 2 * PART)
        end = m.start() if m else at + 2 * PART
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def in_parts(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Indexes of texts, and these texts: those of one part together, then the parts of each other text one by one."""
    parts = [parts_of(t) for t in texts]
    if whole := [i for i, p in enumerate(parts) if len(p) == 1]:
        yield whole, [texts[i] for i in whole]
    yield from (([i], [p]) for i, ps in enumerate(parts) if len(ps) > 1 for p in ps)


def counted(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The buckets of each whole text, ascending, and how often each occurs; parts are as in `score`."""
    out = [(np.zeros(0, np.uint32), np.zeros(0, np.int64))] * len(texts)
    for rows, given in in_parts(texts):
        kinds = features(given)
        for k, i in enumerate(rows):
            at, n = np.unique(np.concatenate([b[u[k - 1] if k else 0 : u[k]] for b, u in kinds]), return_counts=True)
            if len(out[i][0]):
                at, place = np.unique(np.concatenate([out[i][0], at]), return_inverse=True)
                n = np.bincount(place, np.concatenate([out[i][1], n])).astype(np.int64)
            out[i] = at, n
    return out


def train(vector: Callable[[int], tuple[np.ndarray, np.ndarray]], labels: list[int], *, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 5) -> np.ndarray:
    """The logit of label 1 over label 0 of each bucket, and last the bias; vector(i) gives the buckets of row i and the
    share of each of them."""
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((1 << BITS, dim), np.float32) - 0.5) / dim).astype(np.float32)
    out, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    steps, done = max(1, epochs * len(labels)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(labels)):
            at, share = vector(i)
            pace = np.float32(rate * (1 - done / steps))
            mean = share @ vectors[at] if len(at) else np.zeros(dim, np.float32)
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            if len(at):
                vectors[at] -= np.outer(share * pace, p @ out) * np.float32(BOOST)
            out -= pace * np.outer(p, mean)
            bias -= pace * np.float32(0.1) * p
            done += 1
    return np.append(vectors @ (out[1] - out[0]), bias[1] - bias[0]).astype(np.float32)


def score(texts: list[str], model: np.ndarray) -> np.ndarray:
    """The score of each text.  A pair of words or n-gram over the cut of a part of a huge text isn't counted."""
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for rows, given in in_parts(texts):
        for buckets, upto in features(given):
            sums = np.concatenate([[0], np.cumsum(model[buckets], dtype=np.float64)])[upto]
            total[rows] += np.diff(sums, prepend=0)
            count[rows] += np.diff(upto, prepend=0)
    z = total / np.maximum(count, 1) + float(model[-1])
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def packed(at: np.ndarray, n: np.ndarray) -> bytes:
    """Buckets as the steps between them, and counts; all lowest bytes come first, so that Spark compresses the rest."""
    return np.stack([np.diff(at.astype(np.int64), prepend=0), n]).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, n = np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(2, -1)
    return np.cumsum(steps, dtype=np.int32), n


def _counted(batches: Iterator[pa.RecordBatch], at_once: int) -> Iterator[pa.RecordBatch]:
    for rows in in_batches(rows_of(batches), 1, at_once):
        keys = [hashlib.sha256(t.encode("utf-8", "replace")).digest() for _, t in rows]
        found = [packed(*x) for x in counted([t for _, t in rows])]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([y for y, _ in rows], pa.int32()), pa.array(found, pa.binary())], ["key", "label", "vector"])


def _train(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[pa.RecordBatch]:
    rows = []
    with SpooledTemporaryFile(held, dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None) as file:
        for b in batches:
            for key, label, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                at, n = unpacked(data.as_py())
                rows.append((key, label, file.tell(), len(at)))
                file.write(at.tobytes() + (n / max(1, n.sum(dtype=np.int64))).astype(np.float32).tobytes())
        rows.sort()

        def vector(i: int) -> tuple[np.ndarray, np.ndarray]:
            _, _, start, n = rows[i]
            file.seek(start)
            data = file.read(8 * n)
            return np.frombuffer(data, np.int32, n), np.frombuffer(data, np.float32, n, 4 * n)

        model = train(vector, [label for _, label, _, _ in rows])
    yield pa.RecordBatch.from_arrays([pa.array([model.tobytes()], pa.binary())], ["model"])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, fold: int = 5) -> np.ndarray:
    """Learn from at most `sample` labelled ids whose crc32(id as text) isn't divisible by `fold`, a row of each, its whole
    text: of rows that share the id the one whose text is least.

    The ids of the sample, `sample` at most, are broadcast; their texts are counted in parallel, and one task trains on a
    vector for each, of 2 MB at most.  Labels other than 0 and 1 are left out, and of several labels of a document the
    largest counts.  Without any label every score is 0.5.
    """
    prepare(docs.sparkSession)
    key = F.col(id_col).cast("string")
    known = labels.filter(F.col(label_col).isin(0, 1) & (F.crc32(key.cast("binary")) % fold != 0)).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__label"))
    chosen = known.orderBy(F.xxhash64(F.lit(3), "__id"), "__id").limit(sample)
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(chosen), "__id").groupBy("__id", "__label").agg(F.min("text").alias("text")).select("__label", "text")
    vectors = rows.mapInArrow(partial(_counted, at_once=LEARNED_CHARS), "key binary, label int, vector binary")
    got = vectors.repartition(1).mapInArrow(partial(_train, held=HELD_BYTES), "model binary").collect()
    return np.frombuffer(got[0][0], np.float32) if got else np.zeros((1 << BITS) + 1, np.float32)


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for rows in in_batches(rows_of(batches), 1):
        found = score([t for _, t in rows], model.value)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(found)], ["doc_id", "score"])


def quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, fold: int = 5, **options) -> DataFrame:
    """A row per document: doc_id, held_out, score and predicted (1 from `threshold`).

    Only the text is an input of the score.  A null or empty text has the score of the bias; a very long one is scored
    whole, part by part; a null id is held in (held_out false); repeated rows are scored each; other columns are
    dropped, whatever their names; an empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col=id_col, text_col=text_col, fold=fold, **options))
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold == 0, F.lit(False))
    return rows.mapInArrow(partial(_score, model=model), "doc_id long, score double").select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def _keep(batches: Iterator[pa.RecordBatch], model, at: int, threshold: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep: list[bool] = []
        for rows in in_batches(((t.as_py() or "",) for t in b.column(at)), 0):
            keep += (score([r[0] for r in rows], model.value) >= threshold).tolist()
        yield b.filter(pa.array(keep, pa.bool_()))


def accepted(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", threshold: float = 0.3, **options) -> DataFrame:
    """The rows of `docs` that aren't rejected, with all their columns; a null or empty text has the score of the bias."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, text_col=text_col, **options))
    return docs.mapInArrow(partial(_keep, model=model, at=docs.columns.index(text_col), threshold=threshold), docs.schema)

"""Packing documents into sequences of bounded length by hierarchical best fit.

Each partition of the scan encodes its documents, cuts long ones, and packs the pieces best-fit decreasing.  Sequences
that are nearly full are final, and so are those that the shortest of the others doesn't fit into.  The rest become
items of the next round, in which fewer tasks pack them again best fit, until one task has packed all that was left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm.common import Workspace
from stratalens.llm.tokens import LONG_CHARS, Encoder, cached, in_batches, rows_of

#: A sequence with no more room than this is final.
SLACK = 4
#: Items that one task packs in the rounds after the first.
ROUND_ITEMS = 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, bin_length long"


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin and offset, and each bin's length.

    Open bins are kept by room; a bit mask of the rooms there are gives the least that an item fits into.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled: list[int] = []
    mask = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = open_at[room].pop()
            if not open_at[room]:
                mask &= ~(1 << room)
        else:
            room, b = capacity, len(filled)
            filled.append(0)
        bins[i], offsets[i] = b, filled[b]
        filled[b] += size
        if room > size:
            open_at[room - size].append(b)
            mask |= 1 << (room - size)
    return bins, offsets, np.array(filled, np.int64)


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: all but the first are full."""
    first = length - (length - 1) // capacity * capacity
    return [(0, first), *((at, capacity) for at in range(first, length, capacity))]


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int, long_chars: int) -> Iterator[pa.RecordBatch]:
    enc = cached(Encoder, path)
    ids_in, pieces, starts, sizes, sums = [], [], [], [], []
    for rows in in_batches(rows_of(batches), 1):
        easy = [i for i, (_, t) in enumerate(rows) if len(t) < long_chars and enc.sure(t)]
        got = dict(zip(easy, enc.ids_of([rows[i][1] for i in easy]), strict=True)) if easy else {}
        for i, (doc_id, text) in enumerate(rows):
            ids = got.get(i)
            if ids is None:
                ids = np.concatenate(list(enc.spliced(text))) if len(text) >= long_chars else enc.ids(text)
            ids = np.append(ids, end_id).astype("<u4")
            for k, (at, n) in enumerate(cut(len(ids), capacity)):
                ids_in.append(doc_id)
                pieces.append(k)
                starts.append(at)
                sizes.append(n)
                sums.append(zlib.crc32(ids[at : at + n].tobytes()))
    if not sizes:
        return
    lengths = np.array(sizes, np.int64)
    bins, offsets, filled = best_fit(lengths, capacity)
    names = bins + (_task() << 32)
    for a in range(0, len(sizes), 10_000):
        b = slice(a, a + 10_000)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids_in[b], pa.int64()), pa.array(pieces[b], pa.int32()), pa.array(starts[b], pa.int64()), pa.array(lengths[b]), pa.array(sums[b], pa.int64()), pa.array(names[b]), pa.array(offsets[b]), pa.array(filled[bins[b]])],
            [x.split()[0] for x in PIECES.split(", ")],
        )


def _merge(batches: Iterator[pa.RecordBatch], capacity: int, turn: int) -> Iterator[pa.RecordBatch]:
    """Pack (bin, bin_length) rows; in an order of their own, so that a task that runs again gives the same."""
    rows = sorted((-n, b) for x in batches for b, n in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True))
    if rows:
        lengths = np.array([-n for n, _ in rows], np.int64)
        bins, offsets, filled = best_fit(lengths, capacity)
        names = bins + (_task() << 32) + (turn << 56)
        yield pa.RecordBatch.from_arrays(
            [pa.array([b for _, b in rows], pa.int64()), pa.array(names), pa.array(offsets), pa.array(filled[bins])], ["bin", "into", "shift", "into_length"]
        )


def _joinable(items: DataFrame, capacity: int, slack: int) -> tuple[int, int]:
    """The length up to which sequences may still take the shortest one, and how many there are.

    The driver gets a count for each length, `capacity` rows at most."""
    counts = {n: k for n, k in items.filter(F.col("bin_length") < capacity - slack).groupBy("bin_length").agg(F.count("*")).collect()}
    most = min(capacity - slack - 1, capacity - min(counts, default=capacity))
    return most, sum(k for n, k in counts.items() if n <= most)


def pack(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, slack: int = SLACK, round_items: int = ROUND_ITEMS
) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    A null or empty text is the end id alone; a very long one is encoded from chunks and cut.  A null id stays null,
    repeated rows are packed each, other columns are dropped, whatever their names, an empty table gives an empty
    result.  Sequences are gapless from 0 and hold at most `capacity` ids.  Pieces don't move for packing; only
    unfinished sequences, a row each, go to the next round.
    """
    space = Workspace(docs.sparkSession, "packing", docs)
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    packed = space.write(rows.mapInArrow(partial(_pieces, path=tokenizer, capacity=capacity, end_id=end_id, long_chars=LONG_CHARS), PIECES), "pieces")
    items = packed.filter("offset = 0").select("bin", "bin_length")
    most, left = _joinable(items, capacity, slack)
    moved, turn, tasks = None, 1, -(-left // round_items)
    while left > 1:
        taken = items.filter(F.col("bin_length") <= most)
        merged = taken.repartition(tasks, F.xxhash64(F.lit(turn), "bin")).mapInArrow(partial(_merge, capacity=capacity, turn=turn), "bin long, into long, shift long, into_length long")
        merged = space.write(merged, f"round-{turn}")
        step = merged.select("bin", "into", "shift")
        if moved is None:
            moved = step
        else:
            on = step.select(F.col("bin").alias("into"), F.col("into").alias("next"), F.col("shift").alias("more"))
            moved = moved.join(on.hint("merge"), "into", "left").select("bin", F.coalesce("next", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
            moved = space.write(moved, f"moved-{turn}")
        if tasks == 1:
            break
        items = merged.filter("shift = 0").select(F.col("into").alias("bin"), F.col("into_length").alias("bin_length"))
        before = left
        most, left = _joinable(items, capacity, slack)
        # Where a round merges few, more of them must meet in one task.
        tasks = min(-(-left // round_items), tasks if left <= 0.95 * before else max(1, tasks // 4))
        turn += 1
    out = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if moved is None:
        return packed.select(*out, F.col("bin").alias("sequence_id"), "offset")
    return packed.join(moved, "bin", "left").select(
        *out, F.coalesce("into", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")
    )

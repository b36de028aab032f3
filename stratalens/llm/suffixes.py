"""Removal of repeated byte strings with a sparse, distributed suffix sort.

Every string of LENGTH bytes selects an anchor, the GRAM-byte string in it with the least hash; equal strings select the
same one.  Neighbouring strings with one anchor form a region.  Only anchors whose gram occurs twice can belong to
repeats, and only their suffixes are sorted: from the anchor to the right end of its region, then what the region has
left of the anchor, backwards.  Tasks exchange sorted, front-coded runs by ranges of keys; a loser tree, which keeps for
each run how much its head shares with the last winner, merges them without comparing a known prefix again.

A string that holds its anchor at offset x is the anchor's next LENGTH - x bytes and the x bytes before it.  Two are
equal if the suffixes share that many bytes to the right, which the merge knows, and their left parts share x, which a
sort of the left parts tells: so all repeats come from common prefixes, and nothing is hashed to be told apart.  A gram
that fills several ranges is cut inside; strings that lie on such a cut go on, one for each range, and are grouped as
bytes.  Beyond RANGES ranges are dealt in two levels, the second by cuts that tasks find.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm.common import Workspace, on_group, rekeyed, text_key
from stratalens.llm.tokens import in_batches

LENGTH, GRAM = 100, 40
#: Suffix bytes that a task sorts at once, and those of a range of keys on average.
RUN_BYTES, RANGE_BYTES = 24 << 20, 8 << 20
#: Ranges of a level at most.
RANGES = 4096
#: One of so many anchors carries its key; of those about so many for a range tell the cuts.
SAMPLED, SAMPLE_OF_RANGE = 64, 32
#: Regions whose strings are compared together, if no gram has more.
TOGETHER = 20_000
#: Window starts that are looked at together.
SPAN = 1 << 20


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` bytes from each position, by doubling."""
    factor, whole = 0x9E3779B97F4A7C15, 1 << 64
    h, length, out, have = np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64)[data], 1, None, 0
    while size:
        if size & 1:
            if out is None:
                out, have = h.copy(), length
            else:
                n = len(data) - have - length + 1
                out, have = out[:n] * np.uint64(pow(factor, length, whole)) + h[have : have + n], have + length
        size >>= 1
        if size:
            n = len(data) - 2 * length + 1
            h, length = h[:n] * np.uint64(pow(factor, length, whole)) + h[length : length + n], 2 * length
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def sliding_minimum(a: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        a, have = np.minimum(a[:-have], a[have:]), 2 * have
    return a if have == width else np.minimum(a[: len(a) - width + have], a[width - have :])


def regions(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(first text, owners, anchors, first windows, last windows, hashes), positions counted in their text, part by part."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    begins = ends - [len(t) for t in texts]
    low = np.uint64((1 << 24) - 1)
    for at in range(0, max(0, len(data) - length + 1), SPAN):
        part = data[at : at + SPAN + length - 1]
        hashes = gram_hashes(part, gram)
        keys = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        chosen = (sliding_minimum(keys, length - gram + 1) & low).astype(np.int64)
        starts = np.arange(at, at + len(chosen))
        owner = np.searchsorted(ends, starts, "right")
        ok = starts + length <= ends[owner]
        starts, owner, chosen = starts[ok], owner[ok], chosen[ok]
        if len(starts):
            new = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(starts)) - 1
            o = owner[first]
            yield o, chosen[first] + at - begins[o], starts[first] - begins[o], starts[last] - begins[o], hashes[chosen[first]]


def _keys(batches: Iterator[pa.RecordBatch], more: tuple[str, ...] = ()) -> Iterator[tuple]:
    """(doc, version, text as bytes, ...) of each row."""
    for b in batches:
        for row in zip(b.column("doc").to_pylist(), b.column("version").to_pylist(), b.column("text"), *(b.column(k).to_pylist() for k in more), strict=True):
            yield row[0], row[1], (row[2].as_py() or "").encode("utf-8", "replace"), *row[3:]


def _anchors(batches: Iterator[pa.RecordBatch], length: int, gram: int, sampled: int) -> Iterator[pa.RecordBatch]:
    for rows in in_batches(_keys(batches, ("row",)), 2):
        texts = [r[2] for r in rows]
        keys = np.array([r[3] for r in rows], np.int64)
        for owner, anchor, first, last, hashes in regions(texts, length, gram):
            chosen = ((hashes ^ keys[owner].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(sampled) == 0
            shown: list[bytes | None] = [None] * len(owner)
            for i in np.flatnonzero(chosen).tolist():
                shown[i] = _key(texts[owner[i]], int(anchor[i]), int(first[i]), int(last[i]) + length)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes.view(np.int64)), pa.array(keys[owner]), pa.array(anchor, pa.int64()), pa.array(shown, pa.binary())],
                ["h", "row", "at", "key"],
            )


def _key(text: bytes, anchor: int, begin: int, end: int) -> bytes:
    """The suffix from the anchor to the end of its region, and backwards what the region has left of it."""
    return text[anchor:end] + text[begin:anchor][::-1]


# An item of a run: (key, right, doc, version, at, windows).  Right is the length of the key's first part; version is a
# hash of the text, for rows that repeat an id; at is the place of the first window.


def shared_lengths(keys: list[bytes]) -> np.ndarray:
    """How much each key shares with the one before."""
    if len(keys) < 2:
        return np.zeros(len(keys), np.int64)
    sizes = np.fromiter(map(len, keys), np.int64, len(keys))
    out = np.zeros(len(keys), np.int64)
    data = np.frombuffer(b"".join(keys), np.uint8)
    begins = np.cumsum(sizes) - sizes
    going = np.arange(1, len(keys))
    while len(going):
        most = np.minimum(sizes[going], sizes[going - 1])
        going = going[out[going] < most]
        same = data[begins[going] + out[going]] == data[begins[going - 1] + out[going]]
        going = going[same]
        out[going] += 1
    return out


def collapsed(items: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """Of sorted items the first of each equal region, and (doc, version, at, windows) of the others, which repeat it.

    Rows that repeat an id and a text give the same item again, which is no repeat of itself."""
    kept, repeats, last = [], [], None
    for x in items:
        if last is not None and x[0] == last[0] and x[1] == last[1]:
            if x[2:] != last[2:]:
                repeats.append(x[2:])
        else:
            kept.append(x)
            last = x
    return kept, repeats


def pack_run(items: list[tuple], repeats: list[tuple]) -> bytes:
    """A sorted run, front-coded: of each key only what it doesn't share with the one before."""
    keys = [x[0] for x in items]
    shared = shared_lengths(keys)
    rests = [k[s:] for k, s in zip(keys, shared.tolist(), strict=True)]
    numbers = [shared, [len(r) for r in rests], [x[1] for x in items], [x[-1] for x in items]]
    places = [x[2:-1] for x in items]
    width = len((places or [x[:-1] for x in repeats[:1]] or [()])[0])
    return b"".join([
        np.array([len(items), len(repeats), width], "<i8").tobytes(),
        *(np.asarray(n, "<i4").tobytes() for n in numbers),
        np.array(places, "<i8").tobytes(),
        np.array(repeats, "<i8").tobytes(),
        *rests,
    ])


class Run:
    """The keys of a front-coded run in turn; `shared` is what the head shares with the key before it."""

    def __init__(self, data: bytes):
        n, m, width = np.frombuffer(data, "<i8", 3).tolist()
        at = 24
        columns = []
        for _ in range(4):
            columns.append(np.frombuffer(data, "<i4", n, at).tolist())
            at += 4 * n
        self.shares, self.sizes, self.rights, self.windows = columns
        self.places = np.frombuffer(data, "<i8", width * n, at).reshape(n, width).tolist()
        at += 8 * width * n
        self.repeats = np.frombuffer(data, "<i8", (width + 1) * m, at).reshape(m, width + 1)
        self.data, self.at, self.i, self.n = data, at + 8 * (width + 1) * m, -1, n
        self.key: bytes | None = b""
        self.shared = 0
        self.next()

    def next(self) -> None:
        self.i += 1
        if self.i >= self.n:
            self.key, self.shared = None, -1
            return
        self.shared, size = self.shares[self.i], self.sizes[self.i]
        self.key = self.key[: self.shared] + self.data[self.at : self.at + size]
        self.at += size

    def item(self) -> tuple:
        return (self.key, self.rights[self.i], *self.places[self.i], self.windows[self.i])


def common(a: bytes, b: bytes, known: int) -> int:
    """How much a and b share, at least `known`."""
    most = min(len(a), len(b))
    if a[known:most] == b[known:most]:
        return most
    low, step = known, 8
    while a[low : low + step] == b[low : low + step]:
        low += step
        step *= 2
    high = min(most, low + step)
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def merged(runs: list[Run]) -> Iterator[tuple[int, tuple]]:
    """(shared with the item before, item) of all runs in order, by a loser tree.

    A loser keeps what it shares with the winner it lost to.  Of two that meet, the one that shares more with the last
    winner is less; only if both share as much are bytes compared, from there on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    losers, shares = [-1] * size, [0] * size
    heads = runs + [None] * (size - len(runs))

    def play(a: int, sa: int, b: int, sb: int) -> tuple[int, int, int, int]:
        """(winner, what it shares with the last winner, loser, what it shares with the winner)."""
        x = heads[a] and heads[a].key
        y = heads[b] and heads[b].key
        if y is None:
            return a, sa, b, -1
        if x is None:
            return b, sb, a, -1
        if sa != sb:
            return (a, sa, b, sb) if sa > sb else (b, sb, a, sa)
        n = common(x, y, sa)
        if n == len(x) or n < len(y) and x[n] < y[n]:
            return a, sa, b, n
        return b, sb, a, n

    def build(node: int) -> tuple[int, int]:
        if node >= size:
            return node - size, 0
        a, sa = build(2 * node)
        b, sb = build(2 * node + 1)
        w, sw, losers[node], shares[node] = play(a, sa, b, sb)
        return w, sw

    winner, share = build(1)
    while heads[winner] is not None and heads[winner].key is not None:
        run = heads[winner]
        yield share, run.item()
        run.next()
        share, node = run.shared, (winner + size) // 2
        while node:
            winner, share, losers[node], shares[node] = play(winner, share, losers[node], shares[node])
            node //= 2


def window_repeats(items: list[tuple], shares: list[int], near: list[bytes], length: int, gram: int) -> tuple[np.ndarray, list[tuple]]:
    """items in order of their keys, with what each shares with the one before: (doc, version, at, windows) of the windows
    that equal one at an earlier place, and (window, doc, version, at) of the first of each kind whose part from the
    anchor on a cut shares that this range is `near`: others may lie beyond it.
    """
    right, doc, version, at, windows = (np.array([x[i] for x in items], np.int64) for i in range(1, 6))
    left = np.array([len(x[0]) for x in items], np.int64) - right
    behind = [x[0][x[1] :] for x in items]
    back = sorted(range(len(items)), key=behind.__getitem__)
    shared_back = shared_lengths([behind[i] for i in back])
    share = np.array(shares, np.int64)
    open_from = np.array([max((common(x[0], c, 0) for c in near if c[:gram] == x[0][:gram]), default=0) for x in items]) if near else np.zeros(len(items), np.int64)
    anchor = at + left
    order = np.lexsort((anchor, version, doc))
    new = np.concatenate([[True], (np.diff(doc[order]) != 0) | (np.diff(version[order]) != 0) | (np.diff(anchor[order]) != 0)])
    place = np.cumsum(new)
    back_at = np.empty(len(items), np.int64)
    back_at[back] = np.arange(len(items))
    back_at = back_at[order]
    lo, hi, open_from = (left - windows + 1)[order], left[order], open_from[order]
    most = length - gram
    again = np.zeros((len(items), most + 3), bool)
    going: list[tuple] = []
    for x in range(most + 1):
        i = np.flatnonzero((lo <= x) & (x <= hi))
        if not len(i):
            continue
        kind = np.cumsum(share < length - x)[order[i]] * len(items) + np.cumsum(shared_back < x)[back_at[i]]
        _, first, inverse = np.unique(kind, return_index=True, return_inverse=True)
        again[i, most + 1 - x] = place[i] != place[i[first]][inverse]
        for k in i[first][open_from[i[first]] >= length - x].tolist():
            key, r, d, v, a, _ = items[order[k]]
            going.append((key[r : r + x][::-1] + key[: length - x], d, v, a + len(key) - r - x))
    edge = np.diff(again.astype(np.int8), axis=1)
    row, begin = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    i = order[row]
    return np.stack([doc[i], version[i], anchor[i] - most + begin, end - begin], axis=1), going


PIECE = "range int, low binary, high binary, run binary"
PART = "range int, part int, low binary, high binary, run binary"
FOUND = "doc long, version long, at long, windows long, window binary"


def _pieces(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[k]) for i, k in enumerate(kinds)], list(names))


def sides(cuts: list[bytes], inner: list[bool], at: int) -> tuple[bytes | None, bytes | None]:
    """The cuts below and above a range, if they lie inside a gram."""
    return tuple(cuts[i] if 0 <= i < len(cuts) and inner[i] else None for i in (at - 1, at))


def _runs(batches: Iterator[pa.RecordBatch], cuts, length: int, gram: int, run_bytes: int) -> Iterator[pa.RecordBatch]:
    """Sorted runs of the wanted suffixes, a front-coded piece for each range of keys."""
    held: list[tuple] = []
    size, (limits, inner) = 0, cuts.value

    def pieces():
        held.sort()
        at = 0
        out = []
        while at < len(held):
            b = bisect_right(limits, held[at][0])
            end = bisect_left(held, limits[b], at, key=lambda x: x[0]) if b < len(limits) else len(held)
            out.append((b, *sides(limits, inner, b), pack_run(*collapsed(held[at:end]))))
            at = end
        return _pieces(out, PIECE)

    for rows in in_batches(_keys(batches, ("places",)), 2):
        texts = [r[2] for r in rows]
        wanted = np.sort(np.concatenate([np.array(r[3], np.int64) + (i << 40) for i, r in enumerate(rows)]))
        for owner, anchor, first, last, _ in regions(texts, length, gram):
            code = anchor + (owner << 40)
            kept = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)] == code)
            for o, a, s, e in zip(owner[kept].tolist(), anchor[kept].tolist(), first[kept].tolist(), last[kept].tolist(), strict=True):
                key = _key(texts[o], a, s, e + length)
                held.append((key, e + length - a, rows[o][0], rows[o][1], s, e - s + 1))
                size += len(key)
            if size >= run_bytes:
                yield pieces()
                held, size = [], 0
    if held:
        yield pieces()


def _ranges(batches: Iterator[pa.RecordBatch], cuts) -> Iterator[pa.RecordBatch]:
    """(range, key) of sampled keys."""
    for b in batches:
        keys = b.column("key").to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([bisect_right(cuts.value[0], k) for k in keys], pa.int32()), b.column("key")], ["range", "key"])


def _cut_range(table: pa.Table, n: int, gram: int) -> pa.Table:
    """The cuts of one range into about n parts."""
    cuts, inner = cut_points(table.column("key").to_pylist(), n, gram)
    return pa.table({"range": table.column("range")[:1].cast(pa.int32()), "cuts": pa.array([cuts], pa.list_(pa.binary())), "inner": pa.array([inner], pa.list_(pa.bool_()))})


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a range, split by the cuts of its parts."""
    for batch in batches:
        for row in batch.to_pylist():
            known = [(c, i) for c, i in zip(row["cuts"] or (), row["inner"] or (), strict=True) if row["low"] is None or c > row["low"]]
            cuts, inner = [c for c, _ in known], [i for _, i in known]
            run, parts, begun = Run(row["run"]), [], False
            while run.key is not None or not begun:
                at, items = bisect_right(cuts, run.key) if run.key is not None else 0, []
                while run.key is not None and (at == len(cuts) or run.key < cuts[at]):
                    items.append(run.item())
                    run.next()
                low, high = sides(cuts, inner, at)
                low, high = row["low"] if at == 0 else low, row["high"] if at == len(cuts) else high
                parts.append((row["range"], at, low, high, pack_run(items, [] if begun else run.repeats.tolist())))
                begun = True
            yield _pieces(parts, PART)


def _merge(table: pa.Table, length: int, gram: int) -> pa.Table:
    """Repeats as (doc, version, at, windows), and windows that others in the next ranges may equal, with windows 0."""
    runs = [Run(x.as_py()) for x in table.column("run")]
    near = [x for x in (table.column(k)[0].as_py() for k in ("low", "high")) if x is not None]
    found = [np.zeros((0, 4), np.int64), *(r.repeats for r in runs if len(r.repeats))]
    going: list[tuple] = []
    items: list[tuple] = []
    shares: list[int] = []

    def end():
        rows, more = window_repeats(items, shares, near, length, gram)
        found.append(rows)
        going.extend(more)
        items.clear()
        shares.clear()

    for share, item in merged(runs):
        if share < gram and len(items) >= TOGETHER:
            end()
        items.append(item)
        shares.append(share)
    if items:
        end()
    rows = np.concatenate(found)
    column = lambda i: np.concatenate([rows[:, i], np.array([x[i + 1] for x in going], np.int64)])
    windows = np.concatenate([rows[:, 3], np.zeros(len(going), np.int64)])
    return pa.table({"doc": column(0), "version": column(1), "at": column(2), "windows": windows, "window": pa.array([None] * len(rows) + [x[0] for x in going], pa.binary())})


def cut_points(sample: list[bytes], n: int, gram: int) -> tuple[list[bytes], list[bool]]:
    """Keys that cut all into about n ranges, and which of them lie inside a gram: only where it fills whole ranges."""
    sample = sorted(sample)
    points = [sample[i * len(sample) // n] for i in range(1, n)] if sample else []
    count: dict[bytes, int] = {}
    for p in points:
        count[p[:gram]] = count.get(p[:gram], 0) + 1
    cuts = {p[:gram]: False for p in points} | {p: True for p in points if count[p[:gram]] > 1 and len(p) > gram}
    return sorted(cuts), [cuts[p] for p in sorted(cuts)]


def removed_spans(places: list[tuple[int, int]], length: int) -> list[list[int]]:
    """[begin, end) of what the windows cover, in order and apart."""
    out: list[list[int]] = []
    for at, windows in sorted(places):
        end = at + windows - 1 + length
        if out and at <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([at, end])
    return out


def kept_bytes(text: bytes, spans: list[list[int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))


def _report(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc_id, text, ats, windows in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("ats").to_pylist(), b.column("windows").to_pylist(), strict=True):
            data = (text.as_py() or "").encode("utf-8", "replace")
            spans = removed_spans(list(zip(ats or (), windows or (), strict=True)), length)
            kept = kept_bytes(data, spans)
            rows.append((doc_id, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeats(
    docs: DataFrame, space: Workspace, *, length: int = LENGTH, gram: int = GRAM, run_bytes: int = RUN_BYTES, range_bytes: int = RANGE_BYTES, sampled: int = SAMPLED
) -> DataFrame:
    """docs (doc, version, text): (doc, version, ats, windows), the repeated strings of each text that has any.

    Anchors carry one key for a document and its version.  Should two have the same, more of their suffixes are sorted,
    with the same result: what repeats is told by the document and its version themselves.  The driver gets a sample
    of keys, of bounded number and length, for the cuts of one level of ranges; if those don't suffice, each range is cut
    again where its part of a larger sample meets.
    """
    docs = docs.withColumn("row", F.xxhash64("doc", "version"))
    anchors = space.write(docs.mapInArrow(partial(_anchors, length=length, gram=gram, sampled=sampled), "h long, row long, at long, key binary"), "anchors")
    twice = anchors.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select(rekeyed(F.col("h")).alias("k"))
    wanted = anchors.withColumn("k", rekeyed(F.col("h"))).join(twice.hint("merge"), "k").select("row", "at", "key")
    wanted = space.write(wanted, "wanted")
    space.drop("anchors")
    total = wanted.count()
    n = max(1, total * 130 // range_bytes)
    level = min(n, RANGES)

    def shown(ranges: int) -> DataFrame:
        part = min(1.0, SAMPLE_OF_RANGE * ranges / max(1, total / sampled))
        return wanted.filter(F.col("key").isNotNull() & (F.pmod(F.xxhash64("row", "at"), F.lit(1 << 30)) < int(part * (1 << 30)))).select("key")

    cuts = docs.sparkSession.sparkContext.broadcast(cut_points([bytes(r.key) for r in shown(level).collect()], level, gram) if level > 1 else ([], []))
    by_row = wanted.groupBy("row").agg(F.collect_set("at").alias("places"))  # rows that repeat an id and a text have the same
    runs = docs.join(by_row.hint("merge"), "row").select("doc", "version", "text", "places")
    runs = runs.mapInArrow(partial(_runs, cuts=cuts, length=length, gram=gram, run_bytes=run_bytes), PIECE)
    keys = ["range"]
    if n > level:
        keys = ["range", "part"]
        again = shown(n).mapInArrow(partial(_ranges, cuts=cuts), "range int, key binary").groupBy("range")
        parts = again.applyInArrow(on_group(_cut_range, n=-(-n // level), gram=gram), "range int, cuts array<binary>, inner array<boolean>")
        parts = parts.withColumn("k", rekeyed(F.col("range").cast("long"))).drop("range")
        runs = runs.withColumn("k", rekeyed(F.col("range").cast("long"))).join(parts.hint("merge"), "k", "left").drop("k").mapInArrow(_split, PART)
    found = runs.groupBy(*keys).applyInArrow(on_group(_merge, length=length, gram=gram), FOUND)
    found = space.write(found, "found")
    space.drop("wanted")
    place = F.struct("doc", "version", "at")
    going = found.filter("windows = 0").select("window", "doc", "version", "at")
    first = going.groupBy("window").agg(F.min(place).alias("first"))
    again = going.join(first.hint("merge"), "window").filter(place != F.col("first")).select("doc", "version", "at", F.lit(1).cast("long").alias("windows"))
    every = found.filter("windows > 0").select("doc", "version", "at", "windows").unionByName(again)
    return every.groupBy("doc", "version").agg(F.collect_list(F.struct("at", "windows")).alias("p")).select("doc", "version", F.col("p.at").alias("ats"), F.col("p.windows").alias("windows"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("doc"), text_key(text).alias("version"), text.alias("text"))


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans and kept_sha256, when each byte goes that a string of
    `length` bytes covers which also starts earlier: in a document of smaller id, or earlier in the same one.

    Texts are judged as they came in, as UTF-8, the longest in bounded parts.  A null or empty text has no bytes.
    Documents without an id come last.  Rows that repeat an id and a text are one document, each with the same result;
    rows that repeat only the id are told apart and ordered by a 64-bit hash of their texts' SHA-256.  Other columns
    are dropped, whatever their names; an empty table gives an empty result.
    """
    space = Workspace(docs.sparkSession, "suffixes", docs)
    keyed = _keyed(docs, id_col, text_col)
    found = space.write(repeats(keyed.drop("doc_id"), space, length=length, **options), "repeats")
    space.drop("found")
    rows = keyed.join(found.hint("merge"), ["doc", "version"], "left").select("doc_id", "text", "ats", "windows")
    return rows.mapInArrow(partial(_report, length=length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

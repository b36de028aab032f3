"""Similarity join of texts by the Jaccard index of their word n-grams, with Bayesian pruning of candidates.

Texts with one set of n-grams are one node.  Nodes that share a band of MinHash values are linked to the least node of
the bucket, and the components of these links hold all candidates.  Each node's set then travels to its component, which
is dealt to tiles if it is large; but where the buckets of a large component are the cheaper way, as in a long chain, it
travels to its buckets, at most BANDS of them, and a pair is compared in the first that it shares.  In a tile pairs are
compared value by value of their MinHash signatures; a pair goes as soon as the posterior probability that it reaches the
threshold falls below a tolerance, and what is left is verified on whole sets.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.llm.common import Workspace, on_group, rekeyed, text_key
from stratalens.llm.components import connected_components, forest
from stratalens.llm.tokens import cached, in_batches

WORDS = 5
THRESHOLD = 0.8
#: A pair of similarity 0.8 shares no band with a probability of (1 - 0.8**6)**48, which is 5e-7.
BANDS, BAND = 48, 6
HASHES = BANDS * BAND
#: Values that are compared between two looks at the posterior, and the probability below which a pair goes.
STEP = 32
TOLERANCE = 1e-9
#: Nodes and n-grams of a tile on average.
TILE_NODES, TILE_GRAMS = 1024, 1_000_000
#: Stands for a null id, after all others.
NO_ID = (1 << 63) - 1
#: Members of small components that are verified together.
BUNDLE = 512
#: Bytes of a text that are split into words at once; distinct words whose hashes are remembered, and their longest.
PART, REMEMBERED, LONGEST = 1 << 18, 300_000, 64
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Hashes(dict):
    """64-bit BLAKE2 hashes of words, remembered while they are few and short."""

    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= LONGEST and len(self) < REMEMBERED:
            self[word] = h
        return h


def word_hashes(text: bytes, known: Hashes) -> np.ndarray:
    """The hash of each word, part by part of the text."""
    parts, at = [], 0
    while at < len(text):
        end = m.start() if (m := SPACE.search(text, at + PART)) else len(text)
        words = text[at:end].split()
        parts.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def word_set(text: bytes, known: Hashes, n: int = WORDS) -> np.ndarray:
    """The distinct 64-bit hashes of a text's runs of n words, in order; a text of fewer words has one of them all."""
    words = word_hashes(text, known)
    few = len(words) < n
    run = np.full(min(1, len(words)) if few else len(words) - n + 1, len(words) if few else 0, np.uint64)
    for k, factor in enumerate(_factors(n)[: len(words)]):
        run += words[k : k + len(run)] * factor
    return np.unique(_mix(run))


@lru_cache(4)
def _factors(n: int) -> np.ndarray:
    return np.random.default_rng(19).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_sets(texts: list[str], n: int = WORDS) -> list[np.ndarray]:
    known = cached(Hashes)
    if len(known) >= REMEMBERED:
        known.clear()
    return [word_set(t.encode("utf-8", "replace"), known, n) for t in texts]


@lru_cache(1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(23)
    return rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def signature(grams: np.ndarray) -> np.ndarray:
    """The low 16 bits of the least value of each hash function."""
    a, b = _functions()
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    x = (grams >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 512):
        h = x[i : i + 512, None] * a
        h += b
        np.minimum(low, h.min(axis=0), out=low)
    return low.astype(np.uint16)


def node_of(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


@lru_cache(16)
def least_matches(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """(values compared, matches that a pair needs to stay): with k of m matching and a flat prior the posterior of the
    similarity is Beta(k + 1, m - k + 1), whose part above t is the probability of at most k successes of m + 1."""
    out = []
    for m in range(STEP, HASHES + 1, STEP):
        total, k = 0.0, -1
        while total < tolerance:
            k += 1
            total += math.comb(m + 1, k) * threshold**k * (1 - threshold) ** (m + 1 - k)
        out.append((m, k))
    return out


def surviving(a: np.ndarray, b: np.ndarray, same: bool, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of signatures that pruning leaves; if same, only i < j."""
    needs = least_matches(threshold, tolerance)
    left, right = [], []
    for at in range(0, len(a), 64):
        matches = np.zeros((len(a[at : at + 64]), len(b)), np.int32)
        for h in range(STEP):
            matches += a[at : at + 64, h, None] == b[None, :, h]
        i, j = np.nonzero(matches >= needs[0][1])
        count = matches[i, j]
        i += at
        if same:
            kept = i < j
            i, j, count = i[kept], j[kept], count[kept]
        for m, least in needs[1:]:
            kept = []
            for k in range(0, len(i), 1 << 15):
                s = slice(k, k + (1 << 15))
                count[s] += (a[i[s], m - STEP : m] == b[j[s], m - STEP : m]).sum(axis=1)
            kept = count >= least
            i, j, count = i[kept], j[kept], count[kept]
        left.append(i)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def verified(i: np.ndarray, j: np.ndarray, a: list[np.ndarray], b: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which of the pairs really reach the threshold."""
    hit = np.zeros(len(i), bool)
    if not len(i):
        return hit
    sizes = np.array([len(x) for x in b])
    ids = np.unique(np.concatenate([*a, *b]))
    numbered = np.searchsorted(ids, np.concatenate(b))
    ends = np.cumsum(sizes)
    flag = np.zeros(len(ids), np.int32)
    order = np.argsort(i, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(i[order])) + 1):
        mine = np.searchsorted(ids, a[i[part[0]]])
        flag[mine] = 1
        js = j[part]
        if len(js) * 8 > len(b):
            shared = np.add.reduceat(flag[numbered], ends - sizes)[js]
        else:
            shared = np.array([flag[numbered[ends[k] - sizes[k] : ends[k]]].sum() for k in js.tolist()])
        flag[mine] = 0
        hit[part] = shared >= threshold * (len(mine) + sizes[js] - shared) - 1e-9
    return hit


def first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first band that each pair of signatures shares."""
    return (a.reshape(-1, BANDS, BAND) == b.reshape(-1, BANDS, BAND)).all(axis=2).argmax(axis=1)


def _tile(nodes, copies, sides, sets, signatures, band, threshold, tolerance) -> list[tuple]:
    left, right = np.flatnonzero(sides != 1), np.flatnonzero(sides != 0)
    if not len(left) or not len(right):
        return []
    same = not (sides != 2).any()
    i, j = surviving(signatures[left], signatures[right], same, threshold, tolerance)
    if band >= 0:
        mine = [first_shared(signatures[left[i[k : k + 4096]]], signatures[right[j[k : k + 4096]]]) == band for k in range(0, len(i), 4096)]
        mine = np.concatenate(mine) if mine else np.zeros(0, bool)
        i, j = i[mine], j[mine]
    hit = verified(i, j, [sets[k] for k in left], [sets[k] for k in right], threshold)
    p, q = left[i[hit]], right[j[hit]]
    links = np.bincount(p, copies[q], len(nodes)) + np.bincount(q, copies[p], len(nodes))
    some = np.flatnonzero(links)
    found = forest(list(zip(nodes[p].tolist(), nodes[q].tolist(), strict=True)))
    return [(a, None, n) for a, n in zip(nodes[some].tolist(), links[some].astype(np.int64).tolist(), strict=True)] + [(a, b, 0) for a, b in found]


def _compare(table: pa.Table, threshold: float, tolerance: float) -> pa.Table:
    column = lambda k: np.asarray(table.column(k))
    group, nodes, copies, sides, bands = map(column, ("group", "node", "copies", "side", "band"))
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("grams")]
    signatures = np.frombuffer(b"".join(x.as_py() for x in table.column("signature")), np.uint16).reshape(len(nodes), HASHES)
    order = np.lexsort((bands, group))
    rows = []
    for part in np.split(order, np.flatnonzero(np.diff(group[order]) | np.diff(bands[order])) + 1):
        part = part[np.unique(nodes[part], return_index=True)[1]]  # rows that repeat an id and a text
        rows += _tile(nodes[part], copies[part], sides[part], [sets[k] for k in part], signatures[part], bands[part[0]], threshold, tolerance)
    return pa.table({k: pa.array([r[i] for r in rows], pa.int64()) for i, k in enumerate(("a", "b", "links"))})


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    every = ((doc, t.as_py() or "", h) for b in batches for doc, t, h in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True))
    for rows in in_batches(every, 1):
        sets = word_sets([r[1] for r in rows])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.int64()),
                pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
            ],
            ["doc", "hash", "node", "grams", "signature"],
        )


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, ...) with the sets of the texts; of texts with a repeated id only the one that is the node."""
    for b in batches:
        names = b.schema.names
        at = names.index("text")
        nodes, done = b.column(names.index("node")).to_pylist(), 0
        for rows in in_batches(((t.as_py() or "",) for t in b.column(at)), 0):
            sets = word_sets([r[0] for r in rows])
            part = b.slice(done, len(rows))
            keep = [node_of(s) == k for s, k in zip(sets, nodes[done : done + len(rows)], strict=True)]
            done += len(rows)
            part = part.set_column(at, "grams", pa.array([s.tobytes() for s in sets], pa.binary()))
            yield part.filter(pa.array(keep, pa.bool_()))


def _texts_key(id_col: str, text_col: str) -> tuple[Column, Column]:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), text_key(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("hash")


def bands_of(nodes: DataFrame, *more: str) -> DataFrame:
    """(node, band, key): the buckets of each node, BANDS rows each."""
    keys = f"transform(sequence(0, {BANDS - 1}), b -> xxhash64(b, substring(signature, b * {2 * BAND} + 1, {2 * BAND})))"
    return nodes.select("node", *more, F.posexplode(F.expr(keys)).alias("band", "key"))


def _dealt(nodes: DataFrame, coarse: DataFrame, space: Workspace) -> DataFrame:
    """(node, places): where each candidate goes, structs (group, place, tiles, mine, band).

    A component of more than one tile is compared whole (band -1) or by its buckets, whichever sends sets less often.
    All joins on components and buckets meet a summed side that is shuffled anew, so Spark can split the heavy ones.
    """
    n_tiles = lambda size, total: F.greatest(F.ceil(F.col(size) / TILE_NODES), F.ceil(F.col(total) / TILE_GRAMS)).cast("int")
    members = space.write(coarse.join(nodes.select("node", "n"), "node"), "members")
    sizes = members.groupBy("component").agg(F.count("*").alias("size"), F.sum("n").alias("total")).withColumn("tiles", n_tiles("size", "total"))
    members = members.withColumn("k", rekeyed(F.col("component"))).join(sizes.select(rekeyed(F.col("component")).alias("k"), "size", "tiles").hint("merge"), "k").drop("k")
    members = space.write(members, "sized")
    spread = lambda tiles: F.pmod(F.xxhash64("node"), F.col(tiles)).cast("int")
    place = lambda group, n, tiles, band: F.struct(
        F.col(group).alias("group"), F.when(F.col(tiles) == 1, F.pmod(F.xxhash64(group), F.lit(n))).otherwise(F.col(group)).alias("place"),
        F.col(tiles).alias("tiles"), spread(tiles).alias("mine"), band.alias("band"),
    )
    bundles = lambda n: max(1, (n or 0) // BUNDLE)
    whole = members.withColumn("p", place("component", bundles(members.count()), "tiles", F.lit(-1)))
    large = members.filter("tiles > 1").select("node", "component", "size", "tiles")
    if large.isEmpty():
        return whole.select("node", F.array("p").alias("places"))
    inside = bands_of(nodes.join(large.hint("merge"), "node"), "component", "size", "tiles", "n").withColumn("k", rekeyed(F.col("key")))
    filled = inside.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("total"), F.first("component").alias("component"), F.first("size").alias("size"), F.first("tiles").alias("whole"))
    filled = space.write(filled.filter("m > 1").withColumn("parts", n_tiles("m", "total")), "filled")
    cheaper = filled.groupBy("component", "size", "whole").agg(F.sum(F.col("m") * F.col("parts")).alias("cost")).filter(F.col("cost") < F.col("size") * F.col("whole")).select("component")
    by_bucket = filled.join(cheaper.hint("merge"), "component").select(rekeyed(F.col("key")).alias("k"), "parts", "m")
    n = by_bucket.agg(F.sum("m")).first()[0]
    in_buckets = inside.join(by_bucket.hint("merge"), "k").select("node", place("key", bundles(n), "parts", F.col("band")).alias("p"))
    chosen = cheaper.select(rekeyed(F.col("component")).alias("k"), F.lit(True).alias("bucketed"))
    whole = whole.withColumn("k", rekeyed(F.col("component"))).join(chosen.hint("merge"), "k", "left").filter("bucketed is null")
    return whole.select("node", "p").unionByName(in_buckets).groupBy("node").agg(F.collect_list("p").alias("places"))


def _classes(docs: DataFrame, space: Workspace, id_col: str, text_col: str, threshold: float, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """(doc, hash, node) of each row, and (node, doc, hash, n_links): the least document of each node's class."""
    doc, key = _texts_key(id_col, text_col)
    texts = docs.select(doc, F.col(text_col).cast("string").alias("text"), key)
    sig = space.write(texts.mapInArrow(_signatures, "doc long, hash long, node long, grams long, signature binary"), "signatures")
    nodes = (
        sig.filter("node is not null")
        .groupBy("node")
        .agg(F.min(F.struct("doc", "hash")).alias("least"), F.count("*").alias("copies"), F.first("grams").alias("n"), F.first("signature").alias("signature"))
        .select("node", "least.*", "copies", "n", "signature")
    )
    nodes = space.write(nodes, "nodes")
    bands = bands_of(nodes)
    buckets = bands.groupBy("key").agg(F.min("node").alias("low"), F.count("*").alias("size")).filter("size > 1").select(rekeyed(F.col("key")).alias("k"), "low")
    edges = bands.withColumn("k", rekeyed(F.col("key"))).join(buckets.hint("merge"), "k").filter("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    coarse = connected_components(edges, space, "coarse").withColumnRenamed("id", "node")
    dealt = space.write(nodes.join(_dealt(nodes, coarse, space).hint("merge"), "node").select("doc", "hash", "node", "copies", "signature", "places"), "dealt")
    space.drop("members", "sized", "filled")
    sent = texts.join(dealt.hint("merge"), ["doc", "hash"]).drop("doc", "hash")
    place = "places array<struct<`group`:bigint,place:bigint,tiles:int,mine:int,band:int>>"
    sent = sent.mapInArrow(_grams, f"grams binary, node long, copies long, signature binary, {place}")
    sent = sent.select("grams", "node", "copies", "signature", F.inline("places"))
    sent = sent.select("*", F.explode(F.expr("sequence(0, tiles - 1)")).alias("other")).select(
        "grams", "node", "copies", "signature", "group", "place", "band", (F.col("tiles") > 1).alias("large"),
        F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
        F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"),
    )
    found = sent.groupBy("place", "large", F.col("band") >= 0, "i", "j").applyInArrow(on_group(_compare, threshold=threshold, tolerance=tolerance), "a long, b long, links long")
    found = space.write(found, "found")
    space.drop("dealt")
    links = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    comps = connected_components(found.filter("b is not null").select("a", "b"), space, "classes").withColumnRenamed("id", "node")
    named = comps.join(nodes.select("node", F.struct("doc", "hash").alias("least")), "node").groupBy("component").agg(F.min("least").alias("least")).select(rekeyed(F.col("component")).alias("k"), "least")
    member = comps.withColumn("k", rekeyed(F.col("component"))).join(named.hint("merge"), "k").select("node", "least")
    known = (
        nodes.select("node", "copies", F.struct("doc", "hash").alias("own"))
        .join(links, "node", "left")
        .join(member, "node", "left")
        .select("node", F.coalesce("least", "own").alias("least"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
        .select("node", "least.*", "n_links")
    )
    known = space.write(known, "known")
    space.drop("found", "nodes")
    return sig.select("doc", "hash", "node"), known


def similar(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE
) -> DataFrame:
    """A row per document: doc_id, class_id (the least id that links reach) and n_links (documents linked directly).

    Documents link if the Jaccard index of their sets of five-word runs is `threshold` or more; words are runs of
    anything but ASCII white space, compared as they are, and runs are compared by 64-bit hashes made of BLAKE2 hashes
    of the words.  A text of one to four words has one run of them all.  Texts without words (null, empty) link with
    nothing.  A very long text is read part by part; its set of hashes is held whole.  A null id stays null and takes
    the class of its group.  Repeated rows link with each other.  Other columns are dropped, whatever their names; an
    empty table gives an empty result.

    Copies are summed up before anything else, so a group of copies is one node however many rows it has.  Its links
    count all its copies.  No pair leaves a tile: only counts and the edges of a spanning forest do.
    """
    sig, known = _classes(docs, Workspace(docs.sparkSession, "jaccard", docs), id_col, text_col, threshold, tolerance)
    known = known.select(rekeyed(F.col("node")).alias("k"), F.col("doc").alias("class_id"), "n_links")
    out = sig.withColumn("k", rekeyed(F.col("node"))).join(known.hint("merge"), "k", "left")
    own = F.when(F.col("node").isNull(), F.col("doc")).otherwise(F.col("class_id"))
    given = lambda c: F.nullif(c, F.lit(NO_ID))
    return out.select(given(F.col("doc")).alias("doc_id"), given(own).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """`docs` with one row of each class: the one of smallest id, rows without an id last; all columns stay.

    Of rows that share that id the one stays whose text has the least hash, of rows that share the text too the one
    whose other columns have the least hash.  Texts without words are classes of their own by id and text.
    """
    space = Workspace(docs.sparkSession, "jaccard", docs)
    sig, known = _classes(docs, space, id_col, text_col, threshold, tolerance)
    kept = known.select("doc", "hash").unionByName(sig.filter("node is null").select("doc", "hash")).distinct()
    rest = [F.col(f"`{c}`") for c, t in docs.dtypes if c != text_col and "map<" not in t]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(F.lit(1), *rest).alias("rest"), *_texts_key(id_col, text_col))
    rows = rows.join(kept.hint("merge"), ["doc", "hash"])
    again = Window.partitionBy("doc", "hash").orderBy("rest")
    return rows.withColumn("n", F.row_number().over(again)).filter("n = 1").select("row.*")

"""Near-duplicate embeddings: int8 tile products with error bounds, and full precision where a pair may be near enough.

Vectors of a label that are the same are one node with a number of copies, so a group of copies is compared once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.llm.common import Workspace, on_group, rekeyed
from stratalens.llm.components import connected_components, forest

#: Vectors of a tile on average.
TILE = 2048
#: Rows of a product that are looked at together.
STRIP = 512


def valid(vector: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors in int8, with each one's scale and the length of what the rounding left out."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(x - q * scale[:, None], axis=1)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of int8 rows; in float32, which holds sums over 1,024 dimensions exactly."""
    out = np.zeros((len(a), len(b)))
    for d in range(0, a.shape[1], 1024):
        out += a[:, d : d + 1024].astype(np.float32) @ b[:, d : d + 1024].astype(np.float32).T
    return out


def near_pairs(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a and b (raw, float64) whose cosine is at least `threshold`; if same, only pairs i < j.

    With x = x^ + e, x.y = x^.y^ + e.y^ + x.f, so x^.y^ differs from the cosine by at most |e||y^| + |f|.
    """
    unit = lambda x: (y := x / np.abs(x).max(axis=1, keepdims=True)) / np.linalg.norm(y, axis=1, keepdims=True)
    ua, ub = unit(a), unit(b)
    (qa, sa, ea), (qb, sb, eb) = quantised(ua), quantised(ub)
    reach = np.linalg.norm(qb * sb[:, None], axis=1)
    for at in range(0, len(a), STRIP):
        s = slice(at, at + STRIP)
        about = _product(qa[s], qb) * sa[s, None] * sb[None]
        bound = ea[s, None] * reach[None] + eb[None] + 1e-9
        i, j = np.nonzero(about + bound >= threshold)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 1 << 16):
            p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            x, y = ua[p], ub[q]
            hit = np.einsum("ij,ij->i", x, y) >= threshold
            yield p[hit], q[hit]


def _tile(columns: dict, threshold: float) -> list[tuple]:
    uid, side, copies = columns["uid"], columns["side"], columns["copies"]
    x = columns["vector"]
    left, right = side != 1, side != 0
    same = not (side != 2).any()
    ids, others = uid[left], uid[right]
    links = [np.zeros(left.sum(), np.int64), np.zeros(right.sum(), np.int64)]
    found: list[tuple[int, int]] = []
    a, b = x[left], x[right]
    if len(a) and len(b):
        for i, j in near_pairs(a, b, threshold, same):
            links[0] += np.bincount(i, copies[right][j], len(ids)).astype(np.int64)
            links[1] += np.bincount(j, copies[left][i], len(others)).astype(np.int64)
            found = forest(found + list(zip(ids[i].tolist(), others[j].tolist(), strict=True)))
    linked = [(u, None, n) for u, ns in zip((ids, others), links, strict=True) for u, n in zip(u.tolist(), ns.tolist(), strict=True) if n]
    return linked + [(p, q, 0) for p, q in found]


def _compare(table: pa.Table, threshold: float) -> pa.Table:
    vectors = table.column("vector").combine_chunks()
    values = np.asarray(vectors.flatten(), np.float64).reshape(len(vectors), -1)
    rows = _tile({k: np.asarray(table.column(k)) for k in ("uid", "side", "copies")} | {"vector": values}, threshold)
    return pa.table({k: pa.array([r[i] for r in rows], pa.int64()) for i, k in enumerate(("a", "b", "links"))})


def near_duplicates(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, tile: int = TILE
) -> DataFrame:
    """A row per vector: vec_id, n_links, component_id (least vec_id that links reach) and kept.

    Only vectors of one label (not null) and one length are compared, each pair once: the vectors of a label are dealt
    to tiles by hash, and each pair of tiles is a group of its own, so a label with a third of all rows becomes many
    groups of bounded size.  Vectors that are null, empty, zero or not finite link with nothing.  Repeated rows are
    vectors of their own, which link with each other.  A null id takes part and gives a null component if its group
    has no other.  Other columns are dropped, whatever their names; an empty table gives an empty result.

    The work grows with the square of a label's distinct vectors, as each pair is looked at; what is sent grows with
    their square over the tile's size.
    """
    space = Workspace(vectors.sparkSession, "neardup", vectors)
    rows = vectors.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast("array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>").alias("vector"),
    )
    rows = space.write(rows.withColumn("good", valid(F.col("vector")) & F.col("label").isNotNull()), "rows")
    kinds = rows.filter("good").groupBy("label", "vector").agg(F.min("uid").alias("uid"), F.count("*").alias("copies"), F.min("vec_id").alias("vec_id")).withColumn("dims", F.size("vector"))
    kinds = space.write(kinds.select("*", *_keys()), "kinds")
    key = rekeyed(F.xxhash64("label", "dims")).alias("k")
    sizes = kinds.groupBy("label", "dims").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")).select(key, "label", "dims", "tiles")
    dealt = (
        kinds.select("*", key)
        .join(sizes, ["k", "label", "dims"])  # no hint: few labels are sent to all tasks, many are shuffled and split
        .withColumn("mine", F.pmod(F.xxhash64("uid"), F.col("tiles")).cast("int"))
        .select("uid", "copies", "vector", "label", "dims", "mine", F.explode(F.expr("sequence(0, tiles - 1)")).alias("other"))
        .select(
            "uid",
            "copies",
            "vector",
            "label",
            "dims",
            F.least("mine", "other").alias("i"),
            F.greatest("mine", "other").alias("j"),
            F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"),
        )
    )
    found = dealt.groupBy("label", "dims", "i", "j").applyInArrow(on_group(_compare, threshold=threshold), "a long, b long, links long")
    found = space.write(found, "found")
    links = found.filter("b is null").groupBy(F.col("a").alias("uid")).agg(F.sum("links").alias("links"))
    comps = connected_components(found.filter("b is not null").select("a", "b"), space, "components").withColumnRenamed("id", "uid")
    named = comps.join(kinds.select("uid", "vec_id"), "uid").groupBy("component").agg(F.min("vec_id").alias("component_id")).select(rekeyed(F.col("component")).alias("k"), "component_id")
    member = comps.withColumn("k", rekeyed(F.col("component"))).join(named.hint("merge"), "k").select("uid", "component_id")
    known = kinds.join(links, "uid", "left").join(member, "uid", "left")
    itself = F.col("copies") - 1 if threshold <= 1 else F.lit(0)
    # Rows meet their kind by two hashes, if no two kinds share both; else by the vector itself.
    apart = kinds.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    on = ["h1", "h2"] if apart else ["h1", "h2", "label", "vector"]
    known = known.select(*on, (F.coalesce("links", F.lit(0)) + itself).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    known = space.write(known, "known")
    space.drop("kinds", "found")
    out = rows.filter("good").select("vec_id", "label", "vector", *_keys()).select("vec_id", *on).join(known.hint("merge"), on).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = out.unionByName(alone)
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _keys() -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), "label", "vector").alias("h1"), F.xxhash64(F.lit(2), "vector", "label").alias("h2")

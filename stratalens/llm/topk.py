"""Exact top-k by integer inner product: columnar branch and bound.

Queries first meet a bounded sample of the rows; the k-th score there is a lower bound that they take to all blocks, so
the bounds of a block don't start from nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalens.llm.common import Workspace, on_group

#: Rows of a block of queries and of a block of candidates, on average.
QUERY_BLOCK = 1024
ROW_BLOCK = 16_384
#: Dimensions that are added between two looks at the bounds.
DIMS = 16
#: A score below all, and the place of a null id after all others.
NONE, NO_ID = -(1 << 63), (1 << 63) - 1


def _exact_type(q: np.ndarray, c: np.ndarray):
    """The fastest type whose sums of products are exact here."""
    most = q.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0))
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object


def best(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, dims: int = DIMS, floors: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the places of its k best rows, without those that are its own, and their scores.

    Rows lie in columns.  After each block of dimensions a row's score is known up to the product of the lengths of
    what remains of it and of the query; rows that can't reach the k-th best lower bound, or a score that the query is
    known to reach k times (its floor), are dropped.
    """
    kind = _exact_type(queries, rows)
    if kind is object:
        out = []
        big = [[int(x) for x in r] for r in rows]
        for n, q in enumerate(queries):
            score = [max(-(1 << 63), min((1 << 63) - 1, sum(int(a) * b for a, b in zip(q, r, strict=True)))) for r in big]
            order = sorted((i for i in range(len(big)) if i != own[n]), key=lambda i: (-score[i], ids[i]))[:k]
            out.append((np.array(order, np.int64), np.array([score[i] for i in order], np.int64)))
        return out
    columns = np.ascontiguousarray(rows.T.astype(kind))
    starts = list(range(0, rows.shape[1], dims))
    square = np.add.reduceat(columns.astype(np.float64) ** 2, starts, axis=0) if starts else np.zeros((0, len(rows)))
    rest = np.sqrt(np.concatenate([np.cumsum(square[::-1], axis=0)[::-1], np.zeros((1, len(rows)))]))
    out = []
    for n, q in enumerate(queries.astype(kind)):
        alive, score = None, None
        for b, at in enumerate(starts):
            block = columns[at : at + dims] if alive is None else columns[at : at + dims, alive]
            part = q[at : at + dims] @ block
            score = part if score is None else score + part
            if alive is None and own[n] >= 0:
                alive = np.delete(np.arange(len(rows)), own[n])
                score = score[alive]
            if len(score) > (k if floors is None else 0) and at + dims < rows.shape[1]:
                room = np.sqrt(float(np.sum(q[at + dims :].astype(np.float64) ** 2))) * (rest[b + 1] if alive is None else rest[b + 1][alive]) * (1 + 1e-6) + 1e-3
                low = score - room
                least = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
                keep = np.flatnonzero(score + room >= (least if floors is None else max(least, float(floors[n]))))
                if len(keep) < 0.8 * len(score):
                    alive, score = (keep if alive is None else alive[keep]), score[keep]
        if score is None:
            alive = np.delete(np.arange(len(rows)), own[n]) if own[n] >= 0 else None
            score = np.zeros(len(rows) - (own[n] >= 0))
        alive = np.arange(len(rows)) if alive is None else alive
        order = np.lexsort((ids[alive], -score))[:k]
        out.append((alive[order], score[order].astype(np.int64)))
    return out


def _search(table: pa.Table, k: int) -> pa.Table:
    vectors = table.column("vector").combine_chunks()
    values, ends = np.asarray(vectors.flatten(), np.float64), np.asarray(vectors.offsets)
    sizes = np.diff(ends)
    wide = int(sizes.max(initial=0))
    full = np.zeros((len(vectors), wide))  # a shorter vector has zeros at its end
    full[np.repeat(np.arange(len(vectors)), sizes), np.arange(len(values)) - np.repeat(ends[:-1] - ends[0], sizes)] = values
    asks = np.asarray(table.column("asks"))
    uid, ids = np.asarray(table.column("uid")), np.asarray(table.column("vec_id"))
    q, c = np.flatnonzero(asks), np.flatnonzero(~asks)
    place = {u: i for i, u in enumerate(uid[c].tolist())}
    own = np.array([place.get(u, -1) for u in uid[q].tolist()], np.int64)
    got = best(full[q], full[c], ids[c], own, k, floors=np.asarray(table.column("floor"))[q]) if len(q) and len(c) else []
    n = [len(a) for a, _ in got]
    take = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return pa.table({
        "quid": np.repeat(uid[q][: len(n)], n),
        "query_id": np.repeat(ids[q][: len(n)], n),
        "vec_id": take([ids[c][a] for a, _ in got]),
        "score": take([s for _, s in got]),
    })


def top_k(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, scale: int = 256, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """For each row whose id is divisible by `every` its k best others: query_id, rank, vec_id and score.

    Components become floor(scale * x) and the score is the integer inner product, ties going to the smaller id; a
    score beyond 64 bits stops at their end.  Vectors that are null or hold null or non-finite components take no part;
    an empty vector scores 0, and a shorter one counts as ending in zeros.  A row without an id is a candidate like any
    other, after all ids in a tie, and comes back with a null vec_id.  A query isn't compared with its own row; a
    repeated row is another one.  Other columns are dropped, whatever their names; an empty table gives an empty result.

    Queries and rows are dealt to blocks by hash and each pair of blocks is a group, so no table is broadcast and no
    group grows with the data; from each only k rows for a query go on.
    """
    space = Workspace(vectors.sparkSession, "topk", vectors)
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.filter(F.coalesce(x.isNotNull() & finite, F.lit(False))).select(
        F.monotonically_increasing_id().alias("uid"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("vec_id"), F.expr(f"transform(cast(`{vector_col}` as array<double>), v -> cast(floor(v * {scale}D) as double))").alias("vector")
    )
    rows = space.write(rows, "rows")
    asking = (F.col("vec_id") % every == 0) & (F.col("vec_id") != NO_ID)
    total, asked = rows.agg(F.count("*"), F.count_if(asking)).first()
    n_rows, n_asked = max(1, -(-total // row_block)), max(1, -(-asked // query_block))
    spread = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "uid"), F.lit(n)).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asks = rows.filter(asking).select("*", F.lit(True).alias("asks"), spread(n_asked, 1).alias("qb"), F.lit(float(NONE)).alias("floor"))
    cands = rows.select("*", F.lit(False).alias("asks"), spread(n_rows, 2).alias("rb"), F.lit(float(NONE)).alias("floor")).select("*", others(n_asked).alias("qb"))

    def meet(queries: DataFrame, candidates: DataFrame) -> DataFrame:
        return queries.unionByName(candidates).groupBy("qb", "rb").applyInArrow(on_group(_search, k=k), "quid long, query_id long, vec_id long, score long")

    if n_rows > 1:
        first = meet(asks.withColumn("rb", F.lit(0)), cands.filter("rb = 0"))
        floors = first.groupBy("quid").agg(F.min("score").alias("low"), F.count("*").alias("n")).filter(F.col("n") >= k).select(F.col("quid").alias("uid"), F.col("low").cast("double").alias("low"))
        asks = space.write(asks.join(floors, "uid", "left").withColumn("floor", F.coalesce("low", "floor")).drop("low"), "asks")
    near = meet(asks.select("*", others(n_rows).alias("rb")), cands)
    order = Window.partitionBy("quid").orderBy(F.desc("score"), "vec_id")
    top = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return top.select("query_id", "rank", F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score")

"""WARC archives, embeddings and components against brute force."""

import gzip
import hashlib
import io
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from stratalens.llm import components, neardup, topk, warc
from stratalens.llm.common import Workspace

PAGES = "page_id long, url string, html string, digest string, payload string"


def pages(spark):
    long = "<p>é</p>" * 40_000
    same = "x" * 100
    rows = [(1, "http://a/ b\r\nc", "short"), (2, None, "short"), (3, "http://a/3", same), (9, "http://a/9", same), (4, "http://a/4", same), (5, "u", None), (6, "u", ""), (7, "u", long), (8, "u", long), (8, "u", long), (7, "v", long), (None, "n", same), (None, "n", "y" * 200)]
    rows += [(100 + i, "h", "h" * 500 + str(i % 3)) for i in range(200)]
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES).repartition(4)


def expected(rows):
    low = {}
    for r in rows:
        p = (r.html or "").encode()
        if len(p) >= 100 and r.page_id is not None:
            low[p] = min(low.get(p, r.page_id), r.page_id)
    out = Counter()
    for r in rows:
        p = (r.html or "").encode()
        first = low.get(p)
        visit = first is not None and r.page_id != first
        out[(r.page_id, len(p), hashlib.sha256(p).hexdigest(), "revisit" if visit else "response", first if visit else None)] += 1
    return out


@pytest.mark.parametrize("size", [1 << 26, 20_000])
def test_warc_round_trip(spark, size):
    rows = pages(spark)
    got = warc.round_trip(rows, archive_bytes=size).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert Counter(map(tuple, got)) == expected(rows.collect())
    assert warc.round_trip(rows.limit(0)).count() == 0


def test_normalised_members(spark):
    space = Workspace(spark, "test-warc")
    index = warc.normalise(warc.write_archives(pages(spark), space), space).collect()
    for x in index:
        data = open(x.archive.removeprefix("file://"), "rb").read()
        places = [tuple(map(int, y.split())) for y in open(x["index"].removeprefix("file://"))]
        assert len(places) == x.records and sum(n for _, n in places) == len(data)
        whole = gzip.decompress(data)
        assert b"".join(gzip.decompress(data[a : a + n]) for a, n in places) == whole
        assert all(gzip.decompress(data[a : a + n]).startswith(b"WARC/1.1\r\n") for a, n in places)


def test_inflating_any_archive():
    r = [warc.record(i, "u", b"p" * i * 1000, "d" * 64, None, "2020-01-01T00:00:00Z") for i in range(5)]
    for data in (b"".join(r), gzip.compress(b"".join(r)), b"".join(map(gzip.compress, r))):
        got = [h + b"".join(rest) for h, rest in warc.records(warc.inflated(io.BytesIO(data)))]
        assert got == r
    with pytest.raises(ValueError):
        [b"".join(rest) for _, rest in warc.records(iter([r[3][:-900]]))]


VECTORS = "vec_id long, embedding array<float>, label int, uid long, side int, tiles int, component long"


def vectors(seed=1, n=150):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = r.normal(size=12)
        if rows and i % 3:
            v = np.array(rows[r.integers(len(rows))][1]) + r.normal(size=12) * r.choice([0.05, 0.3])
        rows.append((i, [float(np.float32(x)) for x in v], int(r.integers(3))))
    odd = [None, [], [0.0] * 12, [float("nan")] * 12, [float("inf")] + [1.0] * 11, [None] + [1.0] * 11, [1.0, 2.0], [2.0, 4.0], [1e30] * 12, [1e-30] * 12]
    rows += [(n + i, v, 1) for i, v in enumerate(odd)] + [(n + 50, rows[0][1], None), (n + 51, rows[0][1], rows[0][2])]
    return rows


def good(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("tile", [2048, 20])
def test_embeddings_equal_brute_force(spark, tile):
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, 1, 1, 1) for r in rows], VECTORS).repartition(3)
    unit = [np.array(v) / max(map(abs, v)) if good(v) else None for _, v, _ in rows]
    root, links = list(range(len(rows))), Counter()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = unit[i], unit[j]
            if a is not None and b is not None and len(a) == len(b) and rows[i][2] == rows[j][2] and rows[i][2] is not None and a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= 0.93:
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(df, tile=tile).collect()}
    assert got == {rows[i][0]: (links[i], rows[find(i)][0], find(i) == i) for i in range(len(rows))}
    assert sum(links.values()) > 50


def test_embeddings_of_many_copies(spark):
    """Thousands of copies of a few vectors: as many links as rows, from as many comparisons as there are vectors."""
    base = [[1.0, 0.0, 0.0], [0.99, 0.05, 0.0], [0.0, 1.0, 0.0], [0.0, -1.0, 0.0]]
    counts = [3000, 2000, 500, 1]
    rows = [(k * 10_000 + i + 1, base[k], 0) for k in range(4) for i in range(counts[k])]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4), tile=2)
    got = Counter((r.vec_id // 10_000, r.n_links, r.component_id) for r in got.collect())
    assert got == {(0, 4999, 1): 3000, (1, 4999, 1): 2000, (2, 499, 20001): 500, (3, 0, 30001): 1}


def test_top_k_keeps_rows_without_an_id(spark):
    rows = [(0, [1.0]), (None, [9.0]), (1, [1.0]), (None, [1.0]), (2, None)]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("rank").collect()]
    assert got == [(0, 1, None, 9 * 256 * 256), (0, 2, 1, 256 * 256), (0, 3, None, 256 * 256)]


def test_top_k_floors_drop_no_tie():
    r = np.random.default_rng(5)
    rows, ids = r.integers(-9, 9, (400, 40)).astype(float), np.arange(400)
    queries = rows[:10]
    own = np.arange(10)
    want = topk.best(queries, rows, ids, own, 5)
    floors = np.array([s.min() for _, s in want], float)
    got = topk.best(queries, rows, ids, own, 5, floors=floors)
    assert all(np.array_equal(a, x) and np.array_equal(b, y) for (a, b), (x, y) in zip(want, got, strict=True))
    assert sum(len(a) for a, _ in topk.best(queries, rows, ids, own, 5, floors=floors + 1e6)) == 0
    few = topk.best(queries, rows[:3], ids[:3], np.full(10, -1), 5, floors=np.full(10, -1e18))
    assert all(np.array_equal(s, np.sort(rows[:3] @ q)[::-1]) for q, (_, s) in zip(queries, few, strict=True))


def test_embeddings_repeated_and_empty(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 0)] * 3 + [(None, [1.0, 2.0], 0), (4, [-1.0, 2.0], 0)], "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, neardup.near_duplicates(df).select("n_links", "component_id").collect()))
    assert got == [(0, 4), (3, 1), (3, 1), (3, 1), (3, 1)]
    assert neardup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("blocks", [{}, {"query_block": 3, "row_block": 30}])
def test_top_k_equals_brute_force(spark, blocks):
    rows = vectors(2, 200)
    df = spark.createDataFrame([(*r, 1, 1, 1, 1) for r in rows], VECTORS).repartition(3)
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    clip = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    want = set()
    for q, a in whole:
        if q % 10 == 0:
            scores = sorted((-clip(sum(x * y for x, y in zip(a, b, strict=False))), c) for c, b in whole if c != q)[:5]
            want |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(scores)}
    small = {x for x in want if abs(x[3]) < 1 << 50}
    got = set(map(tuple, topk.top_k(df, every=10, **blocks).collect()))
    assert {x for x in got if abs(x[3]) < 1 << 50} == small and len(got) == len(want)
    assert topk.top_k(df.limit(0)).count() == 0


def test_branch_and_bound_drops_rows():
    r = np.random.default_rng(0)
    rows = np.floor(256 * r.normal(size=(500, 64)) * np.linspace(2, 0.01, 64))
    q = rows[:3]
    got = topk.best(q, rows, np.arange(500), np.array([0, 1, -1]), 5)
    for n, (at, s) in enumerate(got):
        score = rows @ q[n]
        order = [i for i in np.lexsort((np.arange(500), -score)).tolist() if n == 2 or i != n][:5]
        assert at.tolist() == order and s.tolist() == score[order].astype(int).tolist()


def test_components(spark):
    r = random.Random(2)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(40)] + [(None, 3), (7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(pairs, "a long, b long")
    got = dict(map(tuple, components.connected_components(df, Workspace(spark, "test"), "c").collect()))
    assert got == {x: find(x) for x in root}
    assert components.connected_components(df.limit(0), Workspace(spark, "test"), "c").count() == 0
    groups = defaultdict(set)
    for a, b in components.forest([(1, 2), (2, 3), (1, 3), (4, 5)]):
        groups[a].add(b)
    assert sum(map(len, groups.values())) == 3

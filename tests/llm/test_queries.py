"""The registered queries on small tables: their columns, and their rows where there is SQL."""

import random
from collections import Counter

import duckdb
import pytest

from stratalens.llm.queries import oracle_sql, queries

COLUMNS = {
    "op1_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op2_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op3_jaccard": {"doc_id": "bigint", "class_id": "bigint", "n_links": "bigint"},
    "op4_secrets": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op5_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op6_embeddings": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op7_topk": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op8_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op9_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op10_suffixes": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("llm"))
    r = random.Random(9)
    words = [f"wörd{i}" for i in range(90)]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(1, 80))) for _ in range(50)]
    texts += [texts[3], texts[4] + " end", texts[5] + "\n" + texts[3], None, ""]
    docs = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(i, f"http://h/{i}", t) for i, t in enumerate(texts)], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    vectors = [[r.gauss(0, 1) for _ in range(8)] for _ in range(60)]
    vectors += [[x + r.gauss(0, 0.1) for x in v] for v in vectors[:40]] + [None, [0.0] * 8]
    spark.createDataFrame([(i, v, i % 3 if i % 10 else None) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


def test_all_are_registered():
    assert set(queries()) == set(COLUMNS)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, folder, name):
    got = queries()[name](spark, folder)
    assert COLUMNS[name].items() <= dict(got.dtypes).items()
    rows = got.collect()
    assert rows
    if name in oracle_sql():
        con = duckdb.connect()
        for t in ("documents", "pages", "embeddings"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
        want = con.sql(oracle_sql()[name])
        assert sorted(want.columns) == sorted(got.columns)
        assert Counter(tuple(r[c] for c in want.columns) for r in rows) == Counter(map(tuple, want.fetchall()))


def test_shuffles_start_from_as_many_partitions_as_the_input_asks_for(spark, folder, monkeypatch):
    from stratalens.llm import common

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert 1000 < common.input_bytes(docs) < 10**6 and common.Workspace(spark, "t", docs).partitions == 0
    assert common.input_bytes(docs.limit(3).mapInArrow(lambda b: b, docs.schema)) > 1000 and common.input_bytes(spark.createDataFrame([(1, "x")]).repartition(2)) < 10**6
    assert common.input_bytes(spark.createDataFrame(spark.sparkContext.parallelize([(1, "x")]))) == 0
    monkeypatch.setattr(common, "INPUT_BYTES", 300)
    space, usual, seen = common.Workspace(spark, "t", docs.filter("doc_id > 3")), spark.conf.get(common.INITIAL, None), []
    frame = type("Frame", (), {"write": property(lambda self: self), "parquet": lambda self, path: seen.append(spark.conf.get(common.INITIAL)), "schema": docs.schema})()
    with pytest.raises(Exception, match="(?i)path"):
        space.write(frame, "x").count()
    assert int(seen[0]) == space.partitions > 10 and spark.conf.get(common.INITIAL, None) == usual


def test_workspace_tables_and_shuffles(spark):
    from stratalens.llm.common import CLEANUP, Workspace

    space = Workspace(spark, "test")
    before = spark.conf.get(CLEANUP)
    table = space.write(spark.range(10).repartition(3), "t")
    assert table.count() == 10 and spark.conf.get(CLEANUP) == before and space.root.startswith("file:///")
    space.close()
    with pytest.raises(Exception, match="(?i)path|file"):
        spark.read.parquet(space.path("t"))

"""Changes of tables, as new tables (K1-K20), and partitioned upserts."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator, Sequence
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.operators.ordering import merged
from stratalens.session import shared_dir, with_package


def upsert(rows: DataFrame, path: str, key: str = "project_id") -> None:
    """K1: replace the partitions of the keys that `rows` has, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def updated(rows: DataFrame, where: Column, changes: dict[str, Column]) -> DataFrame:
    """K2, K3: rows that fulfil the condition get the values; 'a.b' sets a field of a struct."""
    for name, value in changes.items():
        top, _, field = name.partition(".")
        new = F.col(top).withField(field, value) if field else value
        rows = rows.withColumn(top, F.when(where, new).otherwise(F.col(top)))
    return rows


def inserted(rows: DataFrame, new: DataFrame) -> DataFrame:
    """K4."""
    return rows.unionByName(new, allowMissingColumns=True)


def deleted(rows: DataFrame, where: Column) -> tuple[DataFrame, DataFrame]:
    """K5: what is left, and a row with the count of what went."""
    hit = F.coalesce(where, F.lit(False))
    return rows.filter(~hit), rows.agg(F.count_if(hit).alias("deleted"))


def with_member(members: Column, member: Column) -> Column:
    """K6."""
    return F.array_append(members, member)


def without_member(members: Column | str, user: Column) -> Column:
    """K6: the owner can't be removed."""
    return F.filter(members, lambda m: (m["user"] != user) | (m["role"] == "owner"))


def section_added(sections: Column, section: Column) -> Column:
    """K7: the sections in their order; the caller raises the version."""
    return in_order(F.array_append(sections, section))


def section_changed(sections: Column | str, field: str, value: Column, change: dict[str, Column]) -> Column:
    """K7, K8: the sections with an equal field get new values."""

    def one(s: Column) -> Column:
        out = s
        for k, v in change.items():
            out = out.withField(k, v)
        return F.when(s[field] == value, out).otherwise(s)

    return F.transform(sections, one)


def section_removed(sections: Column | str, section_id: Column) -> Column:
    return F.filter(sections, lambda s: s["id"] != section_id)


def in_order(sections: Column | str) -> Column:
    """By order, then id."""
    return F.array_sort(sections, lambda a, b: F.when(a["order"] < b["order"], -1).when(a["order"] > b["order"], 1).when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0))


def section_titled(sections: Column | str, title: str) -> Column:
    return F.get(F.filter(sections, lambda s: s["title"] == title), 0)


def published(documents: DataFrame, on: bool, now: Column) -> DataFrame:
    """K8."""
    return documents.withColumn("is_published", F.lit(on)).withColumn("published_at", F.when(F.lit(on), now))


def reset_if_any_missing(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """K9: a row that lacks one of the fields gets all defaults, over values that it has."""
    missing = F.lit(False)
    for c in defaults:
        missing = missing | F.col(c).isNull()
    rows = rows.withColumn("__missing", missing)
    for c, v in defaults.items():
        rows = rows.withColumn(c, F.when(F.col("__missing"), F.lit(v)).otherwise(F.col(c)))
    return rows.drop("__missing")


def fill_missing(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """The gentle form of K9: only what is missing."""
    return rows.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


# Old provider names.
PROVIDERS = {"oracle": "oracle_cloud", "s3": "aws_s3", "azure": "azure_blob", "gcp": "google_cloud", "local": "local"}


def migrated_provider(old: Column, new: Column) -> Column:
    """The new field if it is set, else the old one renamed, else local."""
    names = F.create_map(*[F.lit(x) for kv in PROVIDERS.items() for x in kv])
    return F.coalesce(new, F.try_element_at(names, old), F.lit("local"))


def rolled_back(rows: DataFrame) -> DataFrame:
    """K11."""
    return rows.withColumn("provider", F.lit("local"))


# ---- stored objects

OBJECTS = "key string, content binary, metadata map<string,string>"
SIDECAR = ".meta.json"


def document_set(documents: DataFrame) -> DataFrame:
    """(doc_id, name, content) texts of documents, a few each, as objects: <doc_id>/<name>.md, an archive of them and
    .metadata.json with their names and sizes."""

    def bundle(rows: pd.DataFrame) -> pd.DataFrame:
        rows, key = rows.sort_values("name"), str(rows["doc_id"].iloc[0])
        files = [(f"{n}.md", c.encode()) for n, c in zip(rows["name"], rows["content"], strict=True)]
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
            for name, content in files:
                z.writestr(zipfile.ZipInfo(name), content)
        about = {"doc_id": key, "files": [n for n, _ in files], "total_size": sum(len(c) for _, c in files)}
        every = [*files, (f"{key}_documentation.zip", packed.getvalue()), (".metadata.json", json.dumps(about).encode())]
        return pd.DataFrame({"key": [f"{key}/{n}" for n, _ in every], "content": [c for _, c in every], "metadata": [{"doc_id": key}] * len(every)})

    with_package(documents.sparkSession)
    return documents.select("doc_id", "name", "content").groupBy("doc_id").applyInPandas(bundle, OBJECTS)


def put_objects(objects: DataFrame, root: str) -> DataFrame:
    """Write (key, content, metadata) below the root, each with its sidecar; (key, size) of what was written.

    Objects are written by the tasks through Arrow's file systems and replace those of the same key, so a task that
    runs again leaves the same."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for key, content, metadata in zip(batch["key"], batch["content"], batch["metadata"], strict=True):
                store, path = fs.FileSystem.from_uri(f"{root.rstrip('/')}/{quote(key)}")
                path = unquote(path)
                store.create_dir(path.rpartition("/")[0], recursive=True)
                for name, data in ((path, content), (path + SIDECAR, json.dumps(dict(metadata), sort_keys=True).encode() if metadata else None)):
                    if data is not None:
                        with store.open_output_stream(name, compression=None) as f:
                            f.write(data)
            yield pd.DataFrame({"key": batch["key"], "size": batch["content"].map(len)})

    with_package(objects.sparkSession)
    shared_dir(objects.sparkSession)
    return objects.select("key", "content", "metadata").mapInPandas(run, "key string, size long").checkpoint()


def merged_metadata(objects: DataFrame, more: DataFrame) -> DataFrame:
    """(key, metadata) with those of `more`, whose values win."""
    new = more.select("key", F.col("metadata").alias("__more"))
    return objects.join(new, "key", "left").withColumn("metadata", merged(F.col("metadata"), F.col("__more"))).drop("__more")


def copied(spark: SparkSession, source: str, target: str) -> None:
    """Through the file system of the paths, with the sidecar if there is one."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for end in ("", SIDECAR):
        a, b = (jvm.org.apache.hadoop.fs.Path(p + end) for p in (source, target))
        if not end or a.getFileSystem(conf).exists(a):
            jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf)


def moved(spark: SparkSession, source: str, target: str) -> None:
    """A copy, then the source goes."""
    copied(spark, source, target)
    removed(spark, source, source + SIDECAR)


def removed(spark: SparkSession, *paths: str) -> int:
    """Delete paths; how many there were."""
    jvm, n = spark._jvm, 0
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        n += bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True))
    return n


def retention(objects: DataFrame, cutoff: Column) -> DataFrame:
    """How many objects are older, and their bytes."""
    return objects.filter(F.col("last_modified") < cutoff).agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("freed"))


def swept(objects: DataFrame, root: str, cutoff: Column) -> DataFrame:
    """(key, size, last_modified) of stored objects: sessions, the first two folders of a key, without anything
    newer than the cutoff are deleted by the tasks; a row with their number and their bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for session in batch["session"]:
                store, path = fs.FileSystem.from_uri(f"{root.rstrip('/')}/{quote(session)}")
                if store.get_file_info(unquote(path)).type != fs.FileType.NotFound:
                    store.delete_dir(unquote(path))
            yield batch[["freed"]]

    with_package(objects.sparkSession)
    shared_dir(objects.sparkSession)
    session = F.array_join(F.slice(F.split("key", "/"), 1, 2), "/").alias("session")
    old = objects.filter(F.size(F.split("key", "/")) > 2).groupBy(session).agg(F.max("last_modified").alias("last"), F.sum("size").alias("freed")).filter(F.col("last") < cutoff)
    gone = old.select("session", "freed").checkpoint().mapInPandas(run, "freed long").checkpoint()
    return gone.agg(F.count("*").alias("sessions"), F.coalesce(F.sum("freed"), F.lit(0)).alias("freed"))


def envelope(success: Column, data: Column, message: Column) -> Column:
    """K20."""
    return F.to_json(F.struct(success.alias("success"), data.alias("data"), message.alias("message")))


def html_page(title: Column, markdown: Column) -> Column:
    """Headings, bold, list items and paragraphs of a Markdown text, without a UDF."""
    out = markdown
    for n in (3, 2, 1):
        out = F.regexp_replace(out, rf"(?m)^{'#' * n} (.+)$", f"<h{n}>$1</h{n}>")
    out = F.regexp_replace(out, r"\*\*(.+?)\*\*", "<strong>$1</strong>")
    out = F.regexp_replace(out, r"(?m)^- (.+)$", "<li>$1</li>")
    return F.concat(F.lit("<html><head><title>"), title, F.lit("</title></head><body>"), out, F.lit("</body></html>"))



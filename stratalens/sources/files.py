"""Scans of source trees, archives, manifests and stored objects."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens import schemas
from stratalens.functions import paths
from stratalens.functions import text as texts
from stratalens.operators import filters
from stratalens.session import with_package


#: Bytes of an archive's entries that are handed on together.
TOGETHER = 8 << 20


def binary(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(root)


def below(path: Column, root: str) -> Column:
    """The part of a file URI after the root."""
    clean = root.rstrip("/").removeprefix("file://")
    return F.regexp_replace(path, "^.*?" + "\\Q" + clean + "\\E/?", "")


def source_files(spark: SparkSession, root: str, project_id: str, includes=(), excludes=filters.DEFAULT_EXCLUDES, extensions=schemas.SOURCE_EXTENSIONS) -> DataFrame:
    """Source files below the root as text; folders and junk are skipped by path, before content is read."""
    path = below(F.col("path"), root)
    rows = binary(spark, root).withColumn("path", path).filter(paths.extension(F.col("path")).isin(*extensions))
    rows = rows.filter(~filters.excluded_directory(F.col("path"), excludes) & filters.included_file(F.col("path"), includes, excludes))
    return rows.select(F.lit(project_id).alias("project_id"), "path", F.decode("content", "UTF-8").alias("content"), F.col("length").alias("size"))


def profiled(files: DataFrame) -> DataFrame:
    """(project_id, path, content bytes): name, extension, language, size and lines of each file, and a row for
    each folder; lines only for known languages."""
    kept = files.filter(~filters.ignored_upload(F.col("path")))
    language = paths.detect_language(F.col("path"))
    rows = kept.select(
        "project_id", "path", paths.basename(F.col("path")).alias("name"), paths.extension(F.col("path")).alias("extension"), language.alias("language"),
        F.octet_length("content").cast("long").alias("size"),
        F.when(language != "unknown", texts.line_count(F.decode("content", "UTF-8"))).otherwise(0).alias("lines"), F.lit(False).alias("is_directory"),
    )
    parts = F.split("path", "/")
    folders = kept.select("project_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n - 1), "/"))).alias("path")).filter("path <> ''").distinct()
    folders = folders.select("project_id", "path", paths.basename(F.col("path")).alias("name"), F.lit("").alias("extension"), F.lit("directory").alias("language"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("lines"), F.lit(True).alias("is_directory"))
    return rows.unionByName(folders)


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for project, content in zip(batch["project_id"], batch["content"], strict=True):
            rows, size = [], 0
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        parts = info.filename.replace("\\", "/").split("/")
                        if not info.is_dir() and ".." not in parts and not info.filename.startswith("/"):
                            rows.append((project, "/".join(p for p in parts if p not in ("", ".")), z.read(info)))
                            size += info.file_size
                        if size >= TOGETHER:
                            yield pd.DataFrame(rows, columns=["project_id", "path", "content"])
                            rows, size = [], 0
            except zipfile.BadZipFile:
                pass
            if rows:
                yield pd.DataFrame(rows, columns=["project_id", "path", "content"])


def archive_entries(archives: DataFrame) -> DataFrame:
    """(project_id, content) of ZIP files: a row for each entry; entries that would leave the folder are refused,
    and a file that isn't an archive has none."""
    with_package(archives.sparkSession)
    return archives.select("project_id", "content").mapInPandas(_entries, "project_id string, path string, content binary")


def ingest_archive(archives: DataFrame) -> DataFrame:
    """The profile of all entries."""
    return profiled(archive_entries(archives))


def manifests(files: DataFrame) -> DataFrame:
    """The dependency maps of each project's package manifest, the one at its root."""
    m = texts.manifest(F.col("content"))
    return files.filter(F.col("path") == "package.json").select("project_id", m["dependencies"].alias("dependencies"), m["devDependencies"].alias("dev_dependencies"))


def root_manifest(spark: SparkSession, root: str, project_id: str) -> DataFrame:
    """The manifest of a folder itself; no row without one, null maps if it doesn't parse."""
    rows = binary(spark, root, "package.json").select(F.lit(project_id).alias("project_id"), below(F.col("path"), root).alias("path"), F.decode("content", "UTF-8").alias("content"))
    return manifests(rows)


def stored(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """All stored objects below a prefix, without sidecars; Spark's scan leaves out those without content."""
    rows = binary(spark, root).select(below(F.col("path"), root).alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"))
    rows = rows.filter(F.col("key").startswith(prefix) & ~F.col("key").endswith(".meta.json"))
    return rows.withColumn("content_type", paths.content_type(F.col("key")))


def listing(spark: SparkSession, root: str, prefix: str = "", most: int = 1000) -> DataFrame:
    """The first stored objects below a prefix in order of their keys, without sidecars.

    The order is the limit's, so Spark keeps no more than `most` rows of a task."""
    return stored(spark, root, prefix).orderBy("key").limit(most)


def object_bytes(spark: SparkSession, root: str, key: str) -> DataFrame:
    """The content of one object; no row if there is none."""
    return binary(spark, f"{root.rstrip('/')}/{key}").select(F.lit(key).alias("key"), "content")


def object_metadata(spark: SparkSession, root: str) -> DataFrame:
    """All objects with the maps of their sidecars."""
    side = binary(spark, root, "*.meta.json").select(F.regexp_replace(below(F.col("path"), root), r"\.meta\.json$", "").alias("key"), F.from_json(F.decode("content", "UTF-8"), "map<string,string>").alias("metadata"))
    return stored(spark, root).join(side, "key", "left")


def latest_files(files: DataFrame, project_id: str) -> DataFrame:
    """S16."""
    return files.filter((F.col("project_id") == project_id) & ~F.col("is_directory")).select("path", "name", "language", "size", "lines")


def answered(rows: DataFrame, prompt: str, schema: str, call: Callable[[pd.Series], pd.Series] | None, fallback: Column) -> DataFrame:
    """A model's answer as a struct; without a model, or where it doesn't parse, the rule's."""
    if call is None:
        return rows.withColumn("answer", fallback)
    ask = F.pandas_udf(call, "string")
    return rows.withColumn("answer", F.coalesce(texts.fenced_json(ask(F.col(prompt)), schema), fallback))


# Providers and the schemes of their Hadoop file systems.
SCHEMES = {"local": "file", "oracle_cloud": "oci", "aws_s3": "s3a", "azure_blob": "abfss", "google_cloud": "gs"}


def provider_root(provider: str, place: str, fallback: bool = True) -> str:
    """The root URI of a provider; an unknown one fails, or falls back to local."""
    if provider not in SCHEMES and not fallback:
        raise ValueError(f"no storage provider {provider}")
    return f"{SCHEMES.get(provider, 'file')}://{place}"

"""Matching of tables (J1-J11); dictionaries are in functions.paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolved_edges(deps: DataFrame, nodes: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Dependencies whose source and target are nodes; repeated ones stay."""
    key = key or []
    ids = nodes.select(*key, F.col("id").alias("__id"))
    for side in ("source", "target"):
        deps = deps.join(ids.withColumnRenamed("__id", side), [*key, side], "left_semi")
    return deps


def library_versions(libraries: DataFrame, manifests: DataFrame) -> DataFrame:
    """Version from dependencies, else from devDependencies, and whether it is one of those.

    Should a project have several manifests, the least version counts, so a use stays one row."""
    entries = lambda c, v: manifests.select("project_id", F.explode(c).alias("library", v)).groupBy("project_id", "library").agg(F.min(v).alias(v))
    out = libraries.join(entries("dependencies", "__dep"), ["project_id", "library"], "left").join(entries("dev_dependencies", "__dev"), ["project_id", "library"], "left")
    return out.withColumn("version", F.coalesce("__dep", "__dev")).withColumn("is_dev", F.col("__dev").isNotNull()).drop("__dep", "__dev")


def populated(rows: DataFrame, key: str, others: DataFrame, other_key: str, columns: list[str], prefix: str) -> DataFrame:
    """Left lookup of some columns; a reference without a match gives nulls."""
    right = others.select(F.col(other_key).alias("__k"), *[F.col(c).alias(prefix + c) for c in columns])
    return rows.join(right, F.col(key) == F.col("__k"), "left").drop("__k")


def populated_array(rows: DataFrame, id_col: str, array: str, field: str, others: DataFrame, other_key: str, columns: list[str]) -> DataFrame:
    """J4 for references in an array of structs: each element gets a struct of the found row, order kept."""
    found = F.when(F.col("__k").isNotNull(), F.struct(*[F.col(f"__o_{c}").alias(c) for c in columns]))
    flat = rows.select(id_col, F.posexplode(array).alias("__pos", "__m"))
    right = others.select(F.col(other_key).alias("__k"), *[F.col(c).alias(f"__o_{c}") for c in columns])
    flat = flat.join(right, F.col(f"__m.{field}") == F.col("__k"), "left")
    nested = flat.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("__pos", "__m", found.alias("found")))), lambda x: F.struct(x["__m"].alias("member"), x["found"].alias("found"))).alias(array))
    return rows.drop(array).join(nested, id_col, "left")


def with_reverse_count(rows: DataFrame, key: str, children: DataFrame, foreign: str, name: str) -> DataFrame:
    """How many children refer to each row."""
    counts = children.groupBy(F.col(foreign).alias("__k")).agg(F.count("*").alias("__n"))
    return rows.join(counts, F.col(key) == F.col("__k"), "left").withColumn(name, F.coalesce("__n", F.lit(0))).drop("__k", "__n")


def visible_to(rows: DataFrame, key: str, grants: DataFrame, user: Column) -> DataFrame:
    """Rows for which `grants` (key, user) has the user."""
    return rows.join(grants.filter(F.col("user") == user), key, "left_semi")


def without_match(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that no other row equals in the keys."""
    return rows.join(others, keys, "left_anti")


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """J8."""
    return left.join(right, key)


def mutual(edges: DataFrame) -> DataFrame:
    """Pairs that depend on each other, each once, the smaller id first."""
    e = edges.select("source", "target").distinct()
    back = e.select(F.col("target").alias("source"), F.col("source").alias("target"))
    return e.join(back, ["source", "target"], "left_semi").filter("source < target")


def cycle_complexity(cycles: DataFrame, nodes: DataFrame) -> DataFrame:
    """The complexity of each cycle's members, the first counted again at the end."""
    flat = cycles.select("id", F.explode("cycle").alias("node"), F.size("cycle").alias("length"))
    right = nodes.select(F.col("id").alias("node"), "complexity")
    return flat.join(right, "node", "left").groupBy("id").agg(F.sum(F.coalesce("complexity", F.lit(0))).alias("complexity"), F.max("length").alias("length"))


def neighbours(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """The targets of a frontier's nodes, a step of a traversal."""
    return frontier.join(edges, frontier["node"] == edges["source"]).select("target").distinct()

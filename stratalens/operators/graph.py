"""Dependency graphs (G1-G15): edges, cycles, strongly connected components, layers, degrees, all by project.

A project whose edges fit one task is solved there by a plain walk.  Larger ones take rounds of joins, as many as their
longest path; every round's table is checkpointed.  Edges and nodes are dealt out to as many partitions as the input's
bytes ask for, whatever the session says.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens import schemas
from stratalens.functions import paths, scores
from stratalens.operators import walks
from stratalens.operators.joins import resolved_edges
from stratalens.session import parts, shared_dir, with_package

#: Edges of a project that one task solves, and rows of a batch that it gives.
ONE_TASK, BATCH = 500_000, 5_000

# What is suggested for each cycle.
SUGGESTIONS = (
    "Consider extracting shared functionality into a separate module",
    "Use dependency injection to break the circular dependency",
    "Refactor one of the modules to remove the circular reference",
    "Consider using interfaces or abstract classes to decouple dependencies",
)


def cut(df: DataFrame) -> DataFrame:
    """The table without its lineage, in the shared folder."""
    shared_dir(df.sparkSession)
    with_package(df.sparkSession)
    return df.checkpoint()


def dependencies(imports: DataFrame, *more: Column | str) -> DataFrame:
    """A dependency for each import, its target resolved; ids count the imports of a file.  `more` columns of the
    imports come last."""
    external = paths.is_external(F.col("source"))
    return imports.select(
        "project_id", F.concat_ws("_", F.lit("import"), "path", "ord").alias("id"), F.col("path").alias("source"),
        paths.resolve_import(F.col("path"), F.col("source")).alias("target"), F.col("source").alias("specifier"), "import_type",
        F.when(F.col("is_dynamic"), "dynamic_import").otherwise("import").alias("type"), external.alias("is_external"), (~external).alias("is_internal"), "line", *more,
    )


def probed(deps: DataFrame, files: DataFrame, extensions: tuple[str, ...] = schemas.SOURCE_EXTENSIONS) -> DataFrame:
    """The corrected resolution: also with an extension, or as a folder's index; the first that exists counts."""
    tries = [F.lit(""), *map(F.lit, extensions), *[F.lit("/index" + e) for e in extensions]]
    tried = deps.select("*", F.posexplode(F.array(*tries)).alias("__try", "__end")).withColumn("__path", F.concat("target", "__end"))
    hit = tried.join(files.select("project_id", F.col("path").alias("__path")), ["project_id", "__path"])
    best = hit.groupBy("project_id", "id").agg(F.min_by("__path", "__try").alias("__found"))
    return deps.join(best, ["project_id", "id"], "left").withColumn("target", F.coalesce("__found", "target")).drop("__found")


def edges(deps: DataFrame, files: DataFrame) -> DataFrame:
    """Dependencies between parsed files; parallel ones stay."""
    nodes = files.select("project_id", F.col("path").alias("id"))
    return resolved_edges(deps.select("project_id", "id", "source", "target", "type"), nodes, ["project_id"]).withColumn("weight", F.lit(1))


def degrees(edge: DataFrame, nodes: DataFrame) -> DataFrame:
    """Fan-out, fan-in, and whether a node is an entry (no dependents) or a leaf (no dependencies)."""
    n, key = parts(edge, nodes), ["project_id", "id"]
    end = lambda c, o, i: F.struct(F.col(c).alias("id"), F.lit(o).alias("o"), F.lit(i).alias("i"))
    ends = edge.select("project_id", F.inline(F.array(end("source", 1, 0), end("target", 0, 1))))
    sums = ends.repartition(n, *key).groupBy(*key).agg(F.sum("o").alias("fan_out"), F.sum("i").alias("fan_in"))
    out = _distinct(nodes.select(*key), n).join(sums, key, "left")
    out = out.withColumn("fan_out", F.coalesce("fan_out", F.lit(0))).withColumn("fan_in", F.coalesce("fan_in", F.lit(0)))
    return out.withColumn("is_entry", F.col("fan_in") == 0).withColumn("is_leaf", F.col("fan_out") == 0)


def adjacency(edge: DataFrame) -> DataFrame:
    return edge.groupBy("project_id", "source").agg(F.array_sort(F.collect_set("target")).alias("dependencies"))


def _distinct(rows: DataFrame, n: int) -> DataFrame:
    return rows.repartition(n, *rows.columns).distinct()


def _by_size(edge: DataFrame, most: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Distinct edges of the projects that one task can solve, and of the others; None where there are none."""
    n = parts(edge)
    e = cut(_distinct(edge.select("project_id", "source", "target"), n))
    sizes = e.repartition(n, "project_id").groupBy("project_id").agg(F.count("*").alias("n"))
    large = cut(sizes.filter(F.col("n") > most).select("project_id"))
    if large.isEmpty():
        return e, None
    return e.join(large, "project_id", "left_anti"), cut(e.join(large, "project_id", "left_semi"))


def _solved(edge: DataFrame, n: int, f: Callable[[list[tuple[str, str]]], Iterable[tuple]], schema: str) -> DataFrame:
    """f(edges) of each project, whose edges fit one task; rows come out batch by batch."""
    names = [c.split()[0] for c in schema.split(", ")]
    with_package(edge.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graphs = ((p, f([(x["source"], x["target"]) for x in pairs])) for b in batches for p, pairs in zip(b["project_id"], b["pairs"], strict=True))
        rows = ((project, *r) for project, found in graphs for r in found)
        while part := list(islice(rows, BATCH)):
            yield pd.DataFrame(part, columns=["project_id", *names])

    whole = edge.repartition(n, "project_id").groupBy("project_id").agg(F.collect_list(F.struct("source", "target")).alias("pairs"))
    return whole.mapInPandas(run, f"project_id string, {schema}")


def strong_components(edge: DataFrame, most: int = ONE_TASK) -> DataFrame:
    """(project_id, id, component): nodes of a project that reach each other, named by the least of them.

    A project of up to `most` edges is solved in one task.  In larger ones least labels spread forward, then back from
    each label's own node; what both reach is a component; rounds go with the longest path.
    """
    small, large = _by_size(edge, most)
    out = _solved(small, parts(edge), walks.components, "id string, component string")
    return out if large is None else out.unionByName(_spread_components(large))


def within_components(edge: DataFrame, most: int = ONE_TASK) -> DataFrame:
    """Edges with is_circular: whether their ends are in one strong component, so that a cycle has them."""
    comp = cut(strong_components(edge, most))
    a, b = (comp.select("project_id", F.col("id").alias(k), F.col("component").alias(f"__{k}")) for k in ("source", "target"))
    out = edge.join(a, ["project_id", "source"]).join(b, ["project_id", "target"]).withColumn("is_circular", F.col("__source") == F.col("__target"))
    return out.select(*[c for c in edge.columns if c != "is_circular"], "is_circular")


def simple_cycles(edge: DataFrame, longest: int | None = None, most: int = ONE_TASK) -> DataFrame:
    """All simple cycles of each project, or those of at most `longest` nodes, from their least node, closed; self
    imports are [a, a].

    A project of up to `most` edges is searched in one task, cycle by cycle.  In larger ones paths grow within strong
    components, only over nodes greater than their first, so each cycle is found once.
    """
    small, large = _by_size(edge, most)
    found = _solved(small, parts(edge), partial(walks.cycles, longest=longest), "cycle array<string>")
    if large is not None:
        found = found.unionByName(_grown_cycles(large, longest))
    size = F.size("cycle")
    return found.select("project_id", "cycle", size.alias("length"), scores.cycle_severity(size).alias("severity"), F.array(*map(F.lit, SUGGESTIONS)).alias("suggestions"))


def layers(edge: DataFrame, nodes: DataFrame, most: int = ONE_TASK) -> DataFrame:
    """0 for a node without dependencies, else one more than the highest of them; nodes of a cycle share a layer."""
    small, large = _by_size(edge.filter("source <> target"), most)
    found = _solved(small, parts(edge), walks.layers, "id string, layer int")
    if large is not None:
        found = found.unionByName(_raised_layers(large))
    n, key = parts(edge, nodes), ["project_id", "id"]
    return _distinct(nodes.select(*key), n).join(found.repartition(n, *key), key, "left").select("project_id", "id", F.coalesce("layer", F.lit(0)).alias("layer"))


# ---- the same for projects that are too large for one task


def _grown_cycles(edge: DataFrame, longest: int | None) -> DataFrame:
    e = cut(within_components(edge, 0).filter("is_circular").select("project_id", "source", "target"))
    found = e.filter("source = target").select("project_id", F.array("source", "target").alias("cycle"))
    grown = e.filter("source < target").select("project_id", F.col("source").alias("first"), F.array("source", "target").alias("nodes"), F.col("target").alias("last"))
    size = 1
    while longest is None or size < longest:
        size += 1
        step = cut(grown.withColumnRenamed("last", "source").join(e, ["project_id", "source"]).filter("target >= first"))
        if step.isEmpty():
            break
        closed, open_ = step.filter("target = first"), step.filter("target > first and not array_contains(nodes, target)")
        found = found.unionByName(closed.select("project_id", F.array_append("nodes", F.col("target")).alias("cycle")))
        grown = open_.select("project_id", "first", F.array_append("nodes", F.col("target")).alias("nodes"), F.col("target").alias("last"))
    return found


def _spread(labels: DataFrame, edge: DataFrame) -> DataFrame:
    """Each node's least label over all paths that lead to it."""
    while True:
        near = labels.withColumnRenamed("id", "source").join(edge, ["project_id", "source"]).select("project_id", F.col("target").alias("id"), "label")
        nxt = cut(labels.unionByName(near).groupBy("project_id", "id").agg(F.min("label").alias("label")))
        if nxt.join(labels.withColumnRenamed("label", "__was"), ["project_id", "id"]).filter("label <> __was").isEmpty():
            return nxt
        labels = nxt


def _spread_components(e: DataFrame) -> DataFrame:
    node = ["project_id", "id"]
    left = cut(e.select("project_id", F.col("source").alias("id")).unionByName(e.select("project_id", F.col("target").alias("id"))).distinct())
    done = left.limit(0).withColumn("component", F.col("id"))
    while not left.isEmpty():
        colour = _spread(left.withColumn("label", F.col("id")), e)
        a, b = (colour.select("project_id", F.col("id").alias(k), F.col("label").alias(f"__{k}")) for k in ("source", "target"))
        within = e.join(a, ["project_id", "source"]).join(b, ["project_id", "target"]).filter("__source = __target")
        back = cut(within.select("project_id", F.col("target").alias("id"), F.col("source").alias("to")))
        reached = front = colour.filter("id = label").select("project_id", "id", "label")
        while True:
            more = front.join(back, node).select("project_id", F.col("to").alias("id"), "label").distinct().join(reached.select(*node), node, "left_anti")
            front = cut(more)
            if front.isEmpty():
                break
            reached = cut(reached.unionByName(front))
        done = cut(done.unionByName(reached.select("project_id", "id", F.col("label").alias("component"))))
        left = cut(left.join(reached.select(*node), node, "left_anti"))
        ends = [left.withColumnRenamed("id", side) for side in ("source", "target")]
        e = cut(e.join(ends[0], ["project_id", "source"], "left_semi").join(ends[1], ["project_id", "target"], "left_semi"))
    return done


def _raised_layers(e: DataFrame) -> DataFrame:
    comp = cut(_spread_components(e))
    a, b = (comp.select("project_id", F.col("id").alias(k), F.col("component").alias(f"__{k}")) for k in ("source", "target"))
    dag = e.join(a, ["project_id", "source"]).join(b, ["project_id", "target"]).filter("__source <> __target")
    dag = cut(dag.select("project_id", F.col("__source").alias("source"), F.col("__target").alias("id")).distinct())
    layer = cut(comp.select("project_id", F.col("component").alias("id")).distinct().withColumn("layer", F.lit(0)))
    while True:
        up = dag.join(layer, ["project_id", "id"]).groupBy("project_id", F.col("source").alias("id")).agg((F.max("layer") + 1).alias("up"))
        nxt = cut(layer.join(up, ["project_id", "id"], "left").select("project_id", "id", F.coalesce("up", F.lit(0)).alias("layer"), F.col("layer").alias("was")))
        layer = nxt.drop("was")
        if nxt.filter("layer <> was").isEmpty():
            break
    return comp.join(layer.withColumnRenamed("id", "component"), ["project_id", "component"]).select("project_id", "id", "layer")


def metrics(edge: DataFrame, nodes: DataFrame) -> DataFrame:
    """Counts, edges per node and coupling of each project that has nodes."""
    counts = nodes.groupBy("project_id").agg(F.countDistinct("id").alias("nodes"))
    out = counts.join(edge.groupBy("project_id").agg(F.count("*").alias("edges")), "project_id", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    return out.select(
        "project_id", "nodes", "edges", F.try_divide(F.col("edges").cast("double"), F.col("nodes")).alias("avg_dependencies"),
        scores.coupling(F.col("edges"), F.col("nodes")).alias("coupling"), F.lit(0.8).alias("cohesion"), F.lit(0.5).alias("instability"), F.lit(0.3).alias("abstractness"),
    )


def relationships(spark) -> DataFrame:
    """None are derived; the table has their schema."""
    return spark.createDataFrame([], schemas.RELATIONSHIPS)


def interactions(components: DataFrame, most: int = 10) -> DataFrame:
    """Internal dependencies of components, the first in order of names."""
    rows = components.select(F.col("name").alias("source"), F.explode("dependencies").alias("target")).filter(~paths.is_external_report(F.col("target")))
    return rows.withColumn("relationship", F.lit("depends on")).orderBy("source", "target").limit(most)


def depth_formula(n):
    """G15."""
    return F.least(n / 10, F.lit(8.0))

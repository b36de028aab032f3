"""The Spark session that the library expects: ANSI, UTC, adaptive execution, last key wins in maps."""

from __future__ import annotations

import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: What Spark takes for the size of a table that it knows nothing of is more than this.
UNKNOWN = 1 << 60
#: Bytes of input for which `parts` gives a partition; a file of short rows takes some 50 times as much in a task's memory.
PART_BYTES, MOST_PARTS = 4 << 20, 100_000


def session(app: str = "stratalens", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.  Where it is unset, one of our own if
    everything runs in this process; on a cluster that is an error."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "stratalens-shared")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", whole).rstrip("/")


def with_package(spark: SparkSession) -> None:
    """Let Python workers import this package."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def input_bytes(table: DataFrame) -> int:
    """The bytes of what a table is read from, as Spark's plan knows them, or an eighth of a checkpoint's, whose rows are
    written as they are in memory; what has no size there counts as none."""
    spark = table.sparkSession
    leaves = table._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = []
    for leaf in (leaves.apply(i) for i in range(leaves.size())):
        if leaf.nodeName() != "LogicalRDD":
            sizes.append(int(str(leaf.stats().sizeInBytes())))
        elif (file := leaf.rdd().getCheckpointFile()).isDefined():  # its estimated size may be a product of joined tables
            path = spark._jvm.org.apache.hadoop.fs.Path(file.get())
            sizes.append(path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength() // 8)
    return sum(n for n in sizes if n < UNKNOWN)


def parts(*tables: DataFrame) -> int:
    """In how many partitions tables are dealt out, so that the memory of a task doesn't grow with them."""
    return max(tables[0].sparkSession.sparkContext.defaultParallelism, min(MOST_PARTS, sum(map(input_bytes, tables)) // PART_BYTES))

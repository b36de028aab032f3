"""What the operators share: tables, the shared work folder, written intermediate tables."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.session import input_bytes, shared_dir, with_package

#: Has Spark remove the shuffles of an execution at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: From how many partitions adaptive execution puts a shuffle together; one for so many bytes of input, in these bounds.
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
INPUT_BYTES, MOST_PARTITIONS = 32 << 20, 100_000
#: Rows in an Arrow batch at most; texts may be long, so the default of 10,000 is too many.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, and keep Arrow batches small."""
    with_package(spark)
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


class Workspace:
    """Written intermediate tables of one query, in the shared folder.

    A written table cuts the lineage and survives the loss of any executor.  What a result isn't read from is dropped;
    the rest stays until `close`, or until the shared folder is cleaned.
    """

    def __init__(self, spark: SparkSession, label: str, *inputs: DataFrame):
        prepare(spark)
        self.spark = spark
        self.partitions = min(MOST_PARTITIONS, sum(map(input_bytes, inputs)) // INPUT_BYTES)
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table.  Its shuffles start from as many partitions as the inputs of the query ask for, if that is more
        than the session says, and go as soon as the table is there."""
        conf = self.spark.conf
        usual = int(conf.get(INITIAL, None) or conf.get("spark.sql.shuffle.partitions"))
        settings = {CLEANUP: "true"} | ({INITIAL: str(self.partitions)} if self.partitions > usual else {})
        before = {k: conf.get(k, None) for k in settings}
        for k, v in settings.items():
            conf.set(k, v)
        try:
            df.write.parquet(self.path(name))
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def close(self) -> None:
        """Delete all tables, when the result has been used."""
        self.drop("")


def text_key(text: Column) -> Column:
    """64 bits of a text's SHA-256, by which rows that repeat an id are told apart."""
    return F.xxhash64(F.sha2(text, 256))


def rekeyed(key: Column) -> Column:
    """A long key in another form, by which a join shuffles even a side that was summed by the key.

    Spark splits the heavy partitions of a join only if each side comes straight from a shuffle of its own.
    """
    return key.bitwiseXOR(F.lit(1 << 40))


def on_group(f, **options):
    """f(table, **options) as a function of a group's Arrow table, with the types that Spark reads."""

    def run(table: pa.Table) -> pa.Table:
        return f(table, **options)

    return run

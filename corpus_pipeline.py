"""From raw documents to packed sequences: each stage reads what the one before it wrote.

Every stage but the last returns the columns of its input, whatever their names, and gives an empty table for an empty
one.  A document is a row: rows that repeat an id, and rows without one, are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm import jaccard, mixing, packing, quality, secrets
from stratalens.llm.common import Workspace, table
from stratalens.llm.queries import tokenizer_path, tokenizer_pattern


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    It learns from the labels of ids, whichever rows have them; null ids have no label.  A null or empty text is scored
    by the bias alone, a very long one part by part; rows of equal text share their fate.  Without any label all stay.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of smallest id stays.

    Documents without an id come after all others, rows that share the id go by a hash of their texts, rows that share
    the text too by a hash of their other columns, so one row stays of exact copies.  Null and empty texts have no near
    copies; one stays for each id.  A very long text is compared whole.
    """
    return jaccard.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; n_chars follows.

    A null text stays null, and its n_chars becomes null; an empty one stays empty; words of any length are scanned.
    """
    clean = secrets.redact(docs, tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_pattern())
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, whole, shuffled within the output shards.

    A null source is a source, the last one.  Documents without words, as null and empty texts are, have nothing that
    could be drawn and aren't in the mix.  Ties in the order of a block go by the other columns, so reruns agree.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences.

    A null or empty text is the end id alone; a very long one is cut into many pieces; a null id stays null.
    """
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", drop_low_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: A trained classifier and a tokenizer aren't SQL; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; each one's result is written and read again."""
    space = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = space.write(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs

"""Helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.storage import stage, workers_import_us

__all__ = ["BLANKS", "NO_ID", "UPPER", "ascii_lower", "documents", "fresh", "id_and_text", "pii_key", "spread", "stage", "workers_import_us"]

#: The white space that the operators' contracts name: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Stands for a null document id, so that null sorts last and joins like any other id.
NO_ID = 9223372036854775807


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just (doc_id, text), null text as empty; whatever else the table carries cannot clash with ours."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def fresh(df: DataFrame, *names: str) -> list[str]:
    """names, each with as many underscores after it as it takes to be no column of df."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        found.append(name)
    return found


def pii_key(spark: SparkSession) -> bytes:
    """The secret of spark.ledgerline.pii.key. Where that is unset, a local session gets a public one, which protects nobody: for trials and tests."""
    key = spark.conf.get("spark.ledgerline.pii.key", None)
    if key is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.ledgerline.pii.key must hold the secret that surrogates depend on")
    return (key or "public key for trials").encode()


def spread(docs: DataFrame) -> DataFrame:
    """docs, dealt over the cores where the table has fewer files and parts than there are, else as it is.

    A small file is one row group, which one task would read and work on alone.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    few = docs.rdd.getNumPartitions() <= cores and len(docs.inputFiles()) < cores
    return docs.repartition(cores) if few else docs

"""CSV imports and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.scalars import normalize_key
from ledgerline.storage import shared_path


def export_csv(df: DataFrame, label: str, *, read: bool = True) -> DataFrame | str:
    """Df as CSV with header in a new folder; the folder's path, or the file read back as text columns."""
    path = shared_path(df.sparkSession, f"csv-{label}")
    df.write.csv(path, header=True)
    return df.sparkSession.read.csv(path, header=True) if read else path


def import_keys(spark: SparkSession, path: str, column: str) -> DataFrame:
    """The distinct keys in a CSV column; what is no number of ten digits at most is left out."""
    keys = spark.read.csv(path, header=True).select(normalize_key(F.col(column)).alias("krs"))
    return keys.filter("krs is not null").distinct()


def subset(by_key: dict[str, DataFrame], by_report: dict[str, DataFrame], keys: DataFrame, reports: DataFrame) -> dict[str, DataFrame]:
    """Tables with a krs cut to keys, tables with a report_id through the reports of keys."""
    own = reports.join(keys, "krs", "left_semi").select(F.col("id").alias("report_id"))
    return {n: df.join(keys, "krs", "left_semi") for n, df in by_key.items()} | {n: df.join(own, "report_id", "left_semi") for n, df in by_report.items()}

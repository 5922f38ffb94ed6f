"""One layout for items, features and whatever else is asked for by report: tables bucketed by key.

Rows are dealt by the hash of the key once, when they are written, a file a bucket and sorted within. What is then done
by that key - windows of the latest version, pivots, aggregations, joins of tables with as many buckets - runs where the
buckets lie, without an exchange. New rows are appended bucket by bucket, which leaves the files that are there alone;
compact() writes each bucket as one file again.

The catalogue holds the bucketing, so a table is found by its name; its files are in the shared folder or at path.
Defined cases: rows whose key is null are one bucket; an empty table is a table of no files; columns beyond the key may
have any name. A key with very many rows makes one large bucket, so a layout is for keys of bounded size, like reports.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

from ledgerline.storage import shared_path


@dataclass(frozen=True)
class Layout:
    """The name of a bucketed table, its key, the number of its buckets and its folder; these stay as they are for its life."""

    name: str
    keys: tuple[str, ...]
    buckets: int
    path: str

    def _writer(self, df: DataFrame, mode: str) -> DataFrameWriter:
        """A task a bucket: dealing by the key into as many parts as there are buckets is how the table is bucketed."""
        return df.repartition(self.buckets, *self.keys).write.mode(mode).format("parquet").bucketBy(self.buckets, *self.keys).sortBy(*self.keys)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.name)

    def append(self, new: DataFrame) -> None:
        """The table and new, whose columns may come in any order; only new is dealt and written."""
        self._writer(new.select(*self.read(new.sparkSession).columns), "append").saveAsTable(self.name)

    def compact(self, spark: SparkSession) -> Layout:
        """A layout of the same rows with one file a bucket. The old table stays until it is dropped, so whoever reads it may go on."""
        # The folder is read, not the table: of rows that are dealt already Spark would leave out the dealing.
        rows = spark.read.schema(self.read(spark).schema).parquet(self.path)
        return create(rows, self.keys, buckets=self.buckets)

    def drop(self, spark: SparkSession) -> None:
        """Forget the table. Its files go with the shared folder."""
        spark.sql(f"DROP TABLE IF EXISTS `{self.name}`")


def create(df: DataFrame, keys: Sequence[str], *, name: str | None = None, path: str | None = None, buckets: int | None = None) -> Layout:
    """A layout with the rows of df. buckets: as many as shuffles have parts, unless said otherwise; of large tables, so many that one is a few hundred MB."""
    spark = df.sparkSession
    name = name or f"ledgerline_layout_{uuid.uuid4().hex}"
    layout = Layout(name, tuple(keys), buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), path or shared_path(spark, "layout"))
    layout._writer(df, "errorifexists").option("path", layout.path).saveAsTable(name)
    return layout

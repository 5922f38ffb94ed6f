"""Tables that merges change in place (S9, S11, S12): only the buckets that a merge touches are read and written.

A store is a folder of Parquet, partitioned by a bucket of the key's hash. A merge finds the buckets of its new rows,
prunes the store to them, merges as versions.py does for whole frames, and overwrites just these partitions. The merged
rows are staged first, so nothing reads what is being replaced. Overwriting goes bucket by bucket: a merge that was broken
off is run again, which S11 and S12 stand, as they change nothing the second time; for S9 the caller checks beforehand.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import versions
from ledgerline.storage import shared_path, stage

_BUCKET = "_bucket"


@dataclass(frozen=True)
class Store:
    """Where a keyed table is, what its key is, and how many buckets it has; these stay as they are for its life."""

    path: str
    keys: tuple[str, ...]
    buckets: int = 64

    def _dealt(self, df: DataFrame) -> DataFrame:
        return df.withColumn(_BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _write(self, df: DataFrame) -> None:
        """A file a bucket: rows are dealt by bucket before they are written."""
        df.repartition(_BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_BUCKET).parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path).drop(_BUCKET)

    def change(self, new: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """how(rows of the touched buckets, new rows) takes the place of those buckets. Returns which they are, at most as many as there are buckets."""
        spark, new = new.sparkSession, stage(self._dealt(new), "store-new")
        touched = sorted(r[0] for r in new.select(_BUCKET).distinct().collect())
        if touched:
            old = spark.read.parquet(self.path).filter(F.col(_BUCKET).isin(touched)).drop(_BUCKET)
            self._write(stage(self._dealt(how(old, new.drop(_BUCKET))), "store-merged"))
        return touched

    def merge_coalesce(self, new: DataFrame) -> list[int]:
        """S11 in place."""
        return self.change(new, lambda old, rows: versions.merge_coalesce(old, rows, self.keys))

    def merge_overwrite(self, new: DataFrame) -> list[int]:
        """S12 in place."""
        return self.change(new, lambda old, rows: versions.merge_overwrite(old, rows, self.keys))

    def append_versioned(self, new: DataFrame, version: str, unique: Sequence[str] = ()) -> list[int]:
        """S9 in place."""
        return self.change(new, lambda old, rows: versions.append_versioned(old, rows, self.keys, version, unique))


def create(df: DataFrame, keys: Sequence[str], *, path: str | None = None, buckets: int = 64) -> Store:
    """A store with the rows of df."""
    store = Store(path or shared_path(df.sparkSession, "store"), tuple(keys), buckets)
    store._write(store._dealt(df))
    return store

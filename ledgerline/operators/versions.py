"""Versioned facts: the latest row of a key, appends at the next version, merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order (W1-W6, W13). Spark limits the window per task before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def latest_reports(reports: DataFrame) -> DataFrame:
    """Newest version of each logical key."""
    return latest(reports, ["logical_key"], [F.desc("report_version"), F.desc("created_at"), F.desc("id")])


def latest_successful_reports(reports: DataFrame) -> DataFrame:
    """Newest completed version; a failed correction falls back to the one before."""
    return latest_reports(reports.filter("ingestion_status = 'completed'"))


def latest_line_items(items: DataFrame) -> DataFrame:
    """Newest extraction of each (report, section, tag)."""
    return latest(items, ["report_id", "section", "tag_path"], [F.desc("extraction_version")])


def latest_raw(raw: DataFrame) -> DataFrame:
    """Newest extraction of each (report, section)."""
    return latest(raw, ["report_id", "section"], [F.desc("extraction_version"), F.desc("created_at")])


def latest_features(features: DataFrame) -> DataFrame:
    """Newest computation of each (report, feature)."""
    return latest(features, ["report_id", "feature_definition_id"], [F.desc("computation_version"), F.desc("computed_at")])


def append_versioned(existing: DataFrame, new: DataFrame, keys: Sequence[str], version: str, unique: Sequence[str] = ()) -> DataFrame:
    """Existing plus new at version max + 1 of its key; of new rows that repeat keys and unique, the first stays."""
    top = existing.groupBy(*keys).agg(F.max(version).alias("_top"))
    rows = new.dropDuplicates([*keys, *unique]).join(top, list(keys), "left").withColumn(version, (F.coalesce("_top", F.lit(0)) + 1).cast(existing.schema[version].dataType)).drop("_top")
    return existing.unionByName(rows.select(*existing.columns))


def insert_ignore(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Existing plus the new rows whose key is not there, the first of those that repeat one."""
    return existing.unionByName(latest(new, keys, order).join(existing.select(*keys), list(keys), "left_anti").select(*existing.columns))


def _merged(old: DataFrame, new: DataFrame, keys: Sequence[str], pick) -> DataFrame:
    n = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in new.columns if c not in keys], F.lit(True).alias("_there"))
    both = old.join(n, list(keys), "full_outer")
    return both.select(*[F.col(c) if c in keys or c not in new.columns else pick(c).alias(c) for c in old.columns])


def merge_coalesce(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Upsert in which a new value wins unless it is null."""
    return _merged(old, new, keys, lambda c: F.coalesce(f"_new_{c}", c))


def merge_overwrite(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Upsert in which the new row wins, nulls too."""
    return _merged(old, new, keys, lambda c: F.when(F.col("_there"), F.col(f"_new_{c}")).otherwise(F.col(c)))


def assign_report_version(filings: DataFrame, existing: DataFrame) -> DataFrame:
    """report_version and supersedes_report_id of filings (id, logical_key, arrived).

    A filing whose id exists keeps its row; others follow the newest version of their logical key in order of arrival.
    """
    heads = latest(existing, ["logical_key"], [F.desc("report_version"), F.desc("id")]).select("logical_key", F.col("report_version").alias("_top"), F.col("id").alias("_head"))
    same = existing.select(F.col("id"), F.col("report_version").alias("_own"), F.lit(True).alias("_known"))
    w = W.partitionBy("logical_key", "_known").orderBy("arrived", "id")
    rows = filings.join(same, "id", "left").join(heads, "logical_key", "left")
    fresh = F.coalesce("_top", F.lit(0)) + F.row_number().over(w)
    return rows.select(
        "id", "logical_key", F.when(F.col("_known"), F.col("_own")).otherwise(fresh).cast("int").alias("report_version"),
        F.when(F.col("_known"), F.lit(None)).otherwise(F.coalesce(F.lag("id").over(w), F.col("_head"))).alias("supersedes_report_id"),
    )


def purge(parents: DataFrame, child: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """Child without the rows of parents."""
    return child.join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, name: str) -> DataFrame:
    """(check, violations): rows of child whose key is set but not in parent."""
    lost = child.filter(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")
    return lost.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check_name"), "violations")


def with_element(list_: Column, element: str) -> Column:
    """A list with element at its end if it is not in it; null counts as empty."""
    given = F.coalesce(list_, F.array().cast("array<string>"))
    return F.when(F.array_contains(given, element), given).otherwise(F.array_append(given, element))

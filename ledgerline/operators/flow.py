"""Ingestion, features and scores of what is new, for all companies at once, and the assessment that chains them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import catalog
from ledgerline.functions import scalars as sc
from ledgerline.operators import features as fe
from ledgerline.operators import versions as ve
from ledgerline.sources import statements as st
from ledgerline.storage import stage


@dataclass(frozen=True)
class Ingested:
    """What ingestion writes: companies and all other tables as they are to be after it, and a ledger row per document."""

    companies: DataFrame
    reports: DataFrame
    raw_sections: DataFrame
    items: DataFrame
    attempts: DataFrame


def ingest_documents(documents: DataFrame, archives: DataFrame, companies: DataFrame, reports: DataFrame, items: DataFrame, *, only_ledger: bool = False) -> Ingested:
    """The statements of documents (document_id, krs, is_downloaded, storage_path, arrived) in archives (path, content).

    companies (krs, nip, pkd_code), reports (id, logical_key, report_version) and items (report_id, extraction_version)
    are what there is. Companies come back merged, a new fact winning unless it is null; of reports, raw sections and
    items the new rows come back, with the next version of their key. attempts: status and reason_code of each document,
    completed, failed, or skipped where it is not downloaded or has no path. No document stops another.
    only_ledger: raw sections and items are not asked for and come back empty, so no rows of elements are made.
    """
    there = F.coalesce("is_downloaded", F.lit(False)) & F.col("storage_path").isNotNull()
    asked = documents.filter(there).select(F.col("storage_path").alias("path")).distinct()
    tree, found, ledger = st.ingest(archives.join(asked, "path", "left_semi"), staged=not only_ledger, only_ledger=only_ledger)
    read = documents.join(ledger.drop("krs").withColumnRenamed("path", "storage_path").withColumnRenamed("status", "_read").withColumnRenamed("reason_code", "_reason"), "storage_path", "left")
    reason = F.when(~F.coalesce("is_downloaded", F.lit(False)), "not_downloaded").when(F.col("storage_path").isNull(), "no_storage_path").when(F.col("_read").isNull(), "no_xml_found").otherwise(F.col("_reason"))
    read = read.withColumn("reason_code", reason).withColumn("status", F.when(F.col("reason_code").isNull(), "completed").when(F.col("reason_code").isin("not_downloaded", "no_storage_path"), "skipped").otherwise("failed"))
    read = stage(read, "flow-read")
    good = read.filter("status = 'completed'")

    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("arrived", "document_id")))
    facts = good.withColumnRenamed("pkd", "pkd_code").groupBy("krs").agg(newest("nip").alias("nip"), newest("pkd_code").alias("pkd_code"))
    merged = ve.merge_coalesce(companies.select("krs", "nip", "pkd_code"), facts, ["krs"])

    key = sc.logical_key("krs", F.lit("KRS"), F.lit("annual"), F.col("fiscal_year").cast("string"), F.col("period_end"))
    filings = good.select(F.col("document_id").alias("id"), key.alias("logical_key"), "arrived")
    versions = ve.assign_report_version(filings, reports.select("id", "logical_key", "report_version"))
    new = good.select(F.col("document_id").alias("id"), "krs", "fiscal_year", "period_start", "period_end", "schema_code", F.col("document_id").alias("source_document_id"), F.col("full_name").alias("source_file_path"), F.lit("completed").alias("ingestion_status"), F.col("arrived").alias("created_at"))
    new = new.join(versions, "id")

    top = items.groupBy("report_id").agg(F.max("extraction_version").alias("_top"))
    version = good.select(F.col("storage_path").alias("doc_id"), F.col("document_id").alias("report_id")).join(top, "report_id", "left")
    version = version.select("doc_id", "report_id", (F.coalesce("_top", F.lit(0)) + 1).cast("int").alias("extraction_version"))
    raw = st.raw_sections(tree).join(version, "doc_id").drop("doc_id")
    return Ingested(merged, new, raw, found.join(version, "doc_id").drop("doc_id"), read.select("document_id", "krs", "status", "reason_code"))


def compute_new_features(items: DataFrame, stored: DataFrame, definitions: Sequence[tuple] | None = None, *, dealt: bool = False) -> DataFrame:
    """Feature rows of the reports of items, with the extraction they come from and the next computation version.

    stored (report_id, feature_definition_id, computation_version) is what there is of such rows. dealt: both are of
    layouts by report with as many buckets, so nothing is exchanged.
    """
    # What is stored is gathered by report, so it is wide rows that are joined.
    top = stored.select("report_id", "feature_definition_id", "computation_version")
    top = (top if dealt else top.repartition("report_id")).groupBy("report_id", "feature_definition_id").agg(F.max("computation_version").alias("v"))
    top = top.groupBy("report_id").agg(F.map_from_entries(F.collect_list(F.struct("feature_definition_id", "v"))).alias("_top"))
    wide = fe.report_values(items, source="source_extraction_version", dealt=dealt).join(top, "report_id", "left")
    rows = fe.compute_features(wide, definitions, by=("report_id", "source_extraction_version", "_top"))
    version = F.coalesce(F.col("_top")[F.col("feature_definition_id")], F.lit(0)) + 1
    return rows.withColumn("computation_version", version.cast("int")).drop("_top")


def score_reports(features: DataFrame, reports: DataFrame, scored: DataFrame, requests: DataFrame | None = None, models: Sequence[catalog.LinearModel] | None = None) -> DataFrame:
    """Scores of all models from stored features: model_id, report_id, krs, the score's columns, and code.

    Without requests (report_id), what is scored is U1: reports with all of a model's features valid that it has not
    scored. With them, each model answers for each report, and code says why it did not: missing_report or
    missing_feature. The newest valid computation of a feature counts.
    """
    models = list(models or catalog.MODELS.values())
    ids = sorted({f for m in models for f in m.coefficients})
    valid = features.filter(F.col("is_valid") & F.col("feature_definition_id").isin(ids))
    at = lambda i: F.max_by(F.when(F.col("feature_definition_id") == i, F.col("value")), F.when(F.col("feature_definition_id") == i, F.col("computation_version")))
    wide = valid.groupBy("report_id").agg(*[at(i).alias(i) for i in ids])
    done = fe.score_all(wide, models).join(reports.select(F.col("id").alias("report_id"), "krs"), "report_id", "left")
    if requests is None:
        new = done.join(scored.select("model_id", "report_id").distinct(), ["model_id", "report_id"], "left_anti")
        return new.withColumn("code", F.when(F.col("krs").isNull(), "missing_report"))
    asked = requests.select("report_id").distinct().select("report_id", F.explode(F.array(*[F.lit(m.model_id) for m in models])).alias("model_id"))
    known = reports.select(F.col("id").alias("report_id"), F.col("krs").alias("_krs"))
    rows = asked.join(done.drop("krs"), ["model_id", "report_id"], "left").join(known, "report_id", "left").withColumnRenamed("_krs", "krs")
    return rows.withColumn("code", F.when(F.col("krs").isNull(), "missing_report").when(F.col("raw_score").isNull(), "missing_feature"))


def run_summary(answers: DataFrame) -> DataFrame:
    """Per model, how many answers of score_reports are scores, and the others by code; the text is cut to 500 characters."""
    by = answers.groupBy("model_id", "code").agg(F.count(F.lit(1)).alias("n"))
    text = F.array_join(F.array_sort(F.collect_list(F.when(F.col("code").isNotNull(), F.concat("code", F.lit(":"), F.col("n").cast("string"))))), ",")
    rows = by.groupBy("model_id").agg(F.sum(F.when(F.col("code").isNull(), F.col("n")).otherwise(0)).alias("scored"), F.sum(F.when(F.col("code").isNotNull(), F.col("n")).otherwise(0)).alias("skipped"), text.alias("errors"))
    status = F.when((F.col("scored") == 0) & (F.col("skipped") > 0), "failed").when(F.col("skipped") > 0, "completed_with_errors").otherwise("completed")
    return rows.select("model_id", "scored", "skipped", status.alias("status"), F.substring("errors", 1, 500).alias("errors"))


def assess(documents: DataFrame, archives: DataFrame, companies: DataFrame, reports: DataFrame, items: DataFrame, scored: DataFrame, ready: DataFrame) -> DataFrame:
    """All companies that are not ready (krs, is_ready), in one job: ingest what is pending, compute, score, close the gaps.

    Per company: attempted and ingested documents, features computed and scores made for them, scores repaired for
    reports that were there, and gaps that are left (pairs of a model and a completed report without a score).
    """
    stale = stage(ready.filter(~F.coalesce("is_ready", F.lit(False))).select("krs"), "flow-stale")
    done = reports.filter("ingestion_status = 'completed'")
    own = documents.join(stale, "krs", "left_semi").filter(F.coalesce("is_downloaded", F.lit(False)))
    pending = own.join(done.select(F.col("source_document_id").alias("document_id")), "document_id", "left_anti")
    got = ingest_documents(pending, archives, companies, reports, items)
    got = replace(got, reports=stage(got.reports, "flow-reports"))
    computed = stage(compute_new_features(got.items, items.limit(0).select("report_id", F.lit("").alias("feature_definition_id"), F.lit(0).alias("computation_version"))), "flow-features")
    scores = score_reports(computed, got.reports, scored)
    before = done.join(stale, "krs", "left_semi")
    pairs = stage(scored.filter(F.col("model_id").isin(list(catalog.MODELS))).select("model_id", "report_id").distinct().join(before.select(F.col("id").alias("report_id"), "krs"), "report_id"), "flow-pairs")
    # Only reports that some model has not scored are looked at, and their features stay in one row.
    all_scored = pairs.groupBy("report_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= len(catalog.MODELS)).select("report_id")
    missing = before.select(F.col("id").alias("report_id"), "krs").join(all_scored, "report_id", "left_anti")
    ids = sorted({f for m in catalog.MODELS.values() for f in m.coefficients})
    wide = fe.features_wide(fe.report_values(items.join(missing.select("report_id"), "report_id", "left_semi")), ids)
    repaired = fe.score_all(wide).select("model_id", "report_id").join(pairs.select("model_id", "report_id"), ["model_id", "report_id"], "left_anti").join(missing, "report_id")
    n = lambda name: F.count(F.lit(1)).alias(name)
    by_report = computed.groupBy("report_id").agg(n("_k")).join(got.reports.select(F.col("id").alias("report_id"), "krs"), "report_id")
    out = stale
    for part in (
        got.attempts.groupBy("krs").agg(n("attempted"), F.count_if(F.col("status") == "completed").alias("ingested")), by_report.groupBy("krs").agg(F.sum("_k").alias("features")), scores.groupBy("krs").agg(n("scored")),
        repaired.groupBy("krs").agg(n("repaired")), before.groupBy("krs").agg(n("_reports")), pairs.groupBy("krs").agg(n("_pairs")),
    ):
        out = out.join(part, "krs", "left")
    out = out.fillna(0, ["attempted", "ingested", "features", "scored", "repaired", "_reports", "_pairs"])
    left = (F.col("_reports") + F.col("ingested")) * len(catalog.MODELS) - F.col("_pairs") - F.col("scored") - F.col("repaired")
    return out.select("krs", "attempted", "ingested", "features", "scored", "repaired", left.alias("gaps"))

"""Series, yearly metrics, datasets, readiness and prediction detail, for all companies at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions import catalog
from ledgerline.functions import scalars as sc
from ledgerline.operators import features as fe
from ledgerline.operators.versions import latest, latest_line_items, latest_successful_reports


def score_history(predictions: DataFrame, reports: DataFrame) -> DataFrame:
    """The newest score of each company, model and year, with its details."""
    rows = predictions.join(reports.select(F.col("id").alias("report_id"), "krs", "fiscal_year", "report_version"), "report_id")
    return latest(rows, ["krs", "model_id", "fiscal_year"], [F.desc_nulls_last("scored_at"), F.desc("report_version"), F.desc("id")])


def canonical_reports(reports: DataFrame) -> DataFrame:
    """One completed report a company and year."""
    return latest(latest_successful_reports(reports), ["krs", "fiscal_year"], [F.desc("report_version"), F.desc("created_at"), F.desc("id")])


#: The tags that yearly metrics need.
METRIC_TAGS = ["Aktywa", "Aktywa_B", "Pasywa_A", "Pasywa_B_III", "RZiS.A", "RZiS.F", "RZiS.L", "RZiS.N"]


def yearly_values(reports: DataFrame, items: DataFrame) -> DataFrame:
    """A10 over W8: krs, fiscal_year and a column per metric tag; net is N where there is one, else L."""
    wide = fe.pivot_tags(latest_line_items(items), METRIC_TAGS)
    rows = canonical_reports(reports).select(F.col("id").alias("report_id"), "krs", "fiscal_year").join(wide, "report_id")
    return rows.withColumn("net", F.coalesce("`RZiS.N`", "`RZiS.L`"))


def health_metrics(values: DataFrame) -> DataFrame:
    """Yearly metrics in per cent to two places; growth is against the company's year before that has a report."""
    part = lambda a, b, k=100: F.round(F.try_divide(F.col(a), F.nullif(F.col(b), F.lit(0.0))) * k, 2)
    prev = F.lag("`RZiS.A`").over(W.partitionBy("krs").orderBy("fiscal_year"))
    return values.select(
        "krs", "fiscal_year", part("Pasywa_A", "Aktywa").alias("equity_ratio"), part("Aktywa_B", "Pasywa_B_III", 1).alias("current_ratio"),
        part("`RZiS.F`", "`RZiS.A`").alias("operating_margin"), part("net", "`RZiS.A`").alias("net_margin"), sc.pct_change(F.col("`RZiS.A`"), prev).alias("revenue_growth"),
    )


def latest_metric_labels(metrics: DataFrame) -> DataFrame:
    """Of each company's last year, the label of each metric."""
    last = metrics.groupBy("krs").agg(*[F.max_by(m, "fiscal_year").alias(m) for m in catalog.METRIC_LABELS])
    return last.select("krs", *[sc.threshold_label(F.col(m), floors).alias(m) for m, floors in catalog.METRIC_LABELS.items()])


def series(reports: DataFrame, items: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Krs, period_end, tag_path, value, change and pct, for every company period and tag, values or not.

    The oldest statement's prior column gives one period more, a year before it.
    """
    grid = canonical_reports(reports).select(F.col("id").alias("report_id"), "krs", "period_end", F.explode(F.array(*map(F.lit, tags))).alias("tag_path"))
    own = latest_line_items(items).filter(F.col("tag_path").isin(list(tags))).select("report_id", "tag_path", "value_current", "value_previous")
    w = W.partitionBy("krs", "tag_path").orderBy("period_end")
    rows = grid.join(own, ["report_id", "tag_path"], "left").withColumn("_k", F.row_number().over(w))
    here, prior = F.struct("period_end", F.col("value_current").alias("value")), F.struct(F.add_months("period_end", -12).alias("period_end"), F.col("value_previous").alias("value"))
    rows = rows.select("krs", "tag_path", F.explode(F.when(F.col("_k") == 1, F.array(prior, here)).otherwise(F.array(here))).alias("p")).select("krs", "tag_path", "p.*")
    before = F.lag("value").over(w)
    return rows.select("krs", "period_end", "tag_path", "value", F.round(F.col("value") - before, 2).alias("change"), sc.pct_change(F.col("value"), before).alias("pct"))


def prediction_detail(scores: DataFrame, features: DataFrame, reports: DataFrame, items: DataFrame) -> DataFrame:
    """Scores (id, report_id, krs, model_id, fiscal_year, raw_score, risk_category, scored_at, snapshot) by feature and tag."""
    from ledgerline.operators.register import prior_year_report, resolved_snapshots

    spark = scores.sparkSession
    bounds = F.broadcast(catalog.threshold_table(spark).select("model_id", F.col("label").alias("risk_category"), "min_score", "max_score"))
    found = resolved_snapshots(features, scores.select(F.col("id").alias("prediction_id"), "report_id", "scored_at", "snapshot", "krs", "model_id", "fiscal_year", "raw_score", "risk_category"))
    # A prediction's features and a report's amounts are one row each until all has met; they are unfolded last. Tags are numbers on the way.
    tags = sorted({t for d in catalog.FEATURES for t in d[4]})
    place = F.array_position(F.array(*map(F.lit, tags)), F.col("tag_path")).cast("int")
    # Dealt as short rows before they are put together, which would sort and spill whatever a task reads.
    every = items.filter(F.col("tag_path").isin(tags)).select("report_id", "section", place.alias("tag"), F.col("extraction_version").cast("long").alias("version"), "value_current").repartition("report_id")
    every = every.groupBy("report_id").agg(F.sort_array(F.collect_list(F.struct("tag", "section", "version", "value_current"))).alias("_v"))
    same = lambda v, w: v["tag"].eqNullSafe(w["tag"]) & v["section"].eqNullSafe(w["section"])
    newest = F.filter("_v", lambda v, i: (i == F.size("_v") - 1) | ~same(v, F.get("_v", i + 1)))
    amounts = every.select("report_id", F.transform(newest, lambda v: F.struct(v["tag"].alias("tag"), v["section"].alias("section"), v["value_current"].alias("value_current"))).alias("_now"))
    prior = prior_year_report(reports).filter("prior_id is not null").select(F.col("id").alias("report_id"), "prior_id")
    then = prior.join(amounts.toDF("prior_id", "_then"), "prior_id").select("report_id", "_then")
    rows = found.drop("prediction_id", "scored_at", "snapshot").join(amounts, "report_id", "left").join(then, "report_id", "left")
    rows = rows.join(bounds, ["model_id", "risk_category"], "left").select("*", F.explode("found").alias("_f")).select("*", "_f.*").join(F.broadcast(catalog.tag_table(spark)), "feature_definition_id").withColumn("_tag", place)
    own = lambda column: F.explode_outer(F.filter(column, lambda x: x["tag"] == F.col("_tag")))
    rows = rows.select("*", own("_now").alias("_n")).select("*", own("_then").alias("_p"))
    return rows.select(
        "krs", "model_id", "fiscal_year", "raw_score", "risk_category", "min_score", "max_score", "feature_definition_id", "value", "source", "tag_path", F.coalesce("_n.section", "_p.section").alias("section"),
        F.col("_n.value_current").alias("value_current"), F.col("_p.value_current").alias("value_prior"), sc.tag_direction(F.col("tag_path")).alias("higher_is_better"),
    )


def split_discovery_state(versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Text rows (document_id, version, rodzaj, okres, status, file_type) to typed documents and their state, the newest of each."""
    rows = latest(versions, ["document_id"], [F.desc("version")])
    documents = rows.select("document_id", F.col("rodzaj").try_cast("short").alias("rodzaj"), F.nullif("okres", F.lit("")).try_cast("date").alias("okres_end"))
    return documents, rows.select("document_id", (F.col("status") == "downloaded").alias("is_downloaded"), "file_type")


def pivot_features(features: DataFrame, ids: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Features as columns; the list is given, so no pass is spent to find it."""
    return features.groupBy(*by).pivot("feature_definition_id", list(ids)).agg(F.first("value", ignorenulls=True))


def training_dataset(features: DataFrame, reports: DataFrame, extra: DataFrame, events: DataFrame, ids: Sequence[str], years: int, first_year: int, last_year: int) -> DataFrame:
    """A row per latest completed report: features, company data and whether an event follows within years."""
    from ledgerline.operators.register import confirmed_events, label_events
    from ledgerline.operators.versions import latest_features

    base = latest_successful_reports(reports.filter(F.col("fiscal_year").between(first_year, last_year))).select("id", "krs", "fiscal_year", "period_end")
    valid = latest_features(features.filter(F.col("is_valid") & F.col("feature_definition_id").isin(list(ids))))
    wide = pivot_features(valid, ids, ["report_id"]).withColumnRenamed("report_id", "id")
    rows = base.join(wide, "id").join(extra, "krs", "left")
    return label_events(rows, confirmed_events(events), years).withColumnRenamed("label", f"is_bankrupt_within_{years}y")


def readiness(documents: DataFrame, downloads: DataFrame, reports: DataFrame, features: DataFrame, predictions: DataFrame, models: DataFrame) -> DataFrame:
    """Per company, what is there and whether all steps are done. Everything is grouped by krs before it is joined."""
    n = F.count(F.lit(1))
    docs = documents.join(downloads, "document_id", "left").groupBy("krs").agg(n.alias("documents_total"), F.count_if("is_downloaded").alias("documents_downloaded"))
    done = reports.filter("ingestion_status = 'completed'")
    newest = latest(done, ["krs"], [F.desc("period_end"), F.desc("report_version"), F.desc("created_at"), F.desc("id")]).select("krs", F.col("id").alias("report_id"), F.col("fiscal_year").alias("latest_fiscal_year"))
    has = newest.join(features.filter("is_valid").select("report_id").distinct().withColumn("_f", F.lit(True)), "report_id", "left").select("krs", "latest_fiscal_year", F.col("_f").isNotNull().alias("features_computed"))
    active = models.filter("is_active").select(F.col("id").alias("model_id"))
    scored = predictions.join(F.broadcast(active), "model_id").join(done.select(F.col("id").alias("report_id"), "krs"), "report_id").groupBy("krs").agg(F.countDistinct("model_id").alias("models_scored"), F.countDistinct("model_id", "report_id").alias("_pairs"))
    total = active.agg(n.alias("models_total"))  # one row
    all_ = docs.join(done.groupBy("krs").agg(n.alias("reports_ingested")), "krs", "left").join(has, "krs", "left").join(scored, "krs", "left").crossJoin(F.broadcast(total))
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = all_.select(
        "krs", "documents_total", "documents_downloaded", zero("reports_ingested").alias("reports_ingested"), F.coalesce("features_computed", F.lit(False)).alias("features_computed"),
        zero("models_scored").alias("models_scored"), (zero("reports_ingested") * F.col("models_total") - zero("_pairs")).alias("scoring_gaps"), "latest_fiscal_year", "models_total",
    )
    ready = (F.col("documents_downloaded") == F.col("documents_total")) & (F.col("reports_ingested") > 0) & F.col("features_computed") & (F.col("models_total") > 0) & (F.col("models_scored") == F.col("models_total"))
    return rows.withColumn("is_ready", ready)


def no_score_reason(documents: DataFrame, downloads: DataFrame, reports: DataFrame, items: DataFrame, scored_keys: DataFrame) -> DataFrame:
    """Why companies without scores have none. The empty set is a subset of any, as the checks read."""
    within = lambda s, *of: F.size(F.array_except(s, F.array(*map(F.lit, of)))) == 0
    empty = F.array().cast("array<string>")
    kinds = documents.join(downloads, "document_id", "left").filter("rodzaj = 18").groupBy("krs").agg(F.collect_set(F.coalesce("file_type", F.lit("unknown"))).alias("kinds"))
    done = reports.filter("ingestion_status = 'completed'")
    schemas = done.groupBy("krs").agg(F.collect_set("schema_code").alias("schemas"))
    standard = done.join(items.filter("tag_path = 'RZiS.A'").select(F.col("report_id").alias("id")).distinct(), "id", "left_semi").select("krs").distinct().withColumn("_std", F.lit(True))
    keys = documents.select("krs").distinct().join(scored_keys, "krs", "left_anti")
    rows = keys.join(kinds, "krs", "left").join(schemas, "krs", "left").join(standard, "krs", "left")
    found = F.coalesce("kinds", empty)
    none = F.when(within(found, "other", "unknown", "xhtml"), "ifrs_xhtml").when(within(found, "pdf", "unknown"), "pdf_only").otherwise("ingestion_failed")
    some = F.when(within(F.col("schemas"), "SFJMIZ"), "micro_entity").when(within(F.col("schemas"), "SFZURT"), "insurance_entity").when(F.col("_std").isNull(), "missing_standard_tags").otherwise("scoring_failed")
    return rows.select("krs", F.when(F.col("schemas").isNull(), none).otherwise(some).alias("reason"))


def version_amplification(facts: DataFrame, key: str, version: str, state: Sequence[str]) -> DataFrame:
    """Q3: one row: versions a key, and the share of versions that change nothing but the version."""
    same = F.lit(True)
    w = W.partitionBy(key).orderBy(version)
    for c in state:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    rows = facts.withColumn("_same", same & (F.row_number().over(w) > 1))
    return rows.agg(F.count(F.lit(1)).alias("versions"), F.countDistinct(key).alias("keys"), F.round(F.count(F.lit(1)) / F.countDistinct(key), 4).alias("per_key"), F.count_if("_same").alias("unchanged"))

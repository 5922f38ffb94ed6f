"""Queries over the register, joins, aggregations, orderings and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.fixtures import AS_OF, Tables
from ledgerline.functions import catalog
from ledgerline.operators import register as rg
from ledgerline.operators import versions as ve
from ledgerline.plans.registry import query
from ledgerline.storage import stage

N = F.count
NOW = lambda: F.lit(AS_OF).cast("timestamp")
CURRENT = "(SELECT d.*, s.is_downloaded, s.file_type, s.download_error, s.metadata_fetched_at FROM fx_documents d LEFT JOIN fx_downloads s USING (document_id)) c"


def _current(t: Tables) -> DataFrame:
    return rg.documents_current(t.fx_documents, t.fx_downloads)


@query("SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_quantity>45 AND l_returnflag='R'")
def scan_table(t: Tables) -> DataFrame:
    """Columns and predicates reach the parquet scan."""
    return t.lineitem.filter("l_quantity > 45 and l_returnflag = 'R'").select("l_orderkey", "l_extendedprice")


@query("SELECT lpad(CAST(c_custkey AS VARCHAR),10,'0') AS krs, min(c_custkey) AS first_key FROM customer WHERE c_custkey BETWEEN 100 AND 900 GROUP BY 1")
def import_key_range(t: Tables) -> DataFrame:
    """S3: a dense range of keys, those that are customers."""
    keys = t.spark.range(100, 901).select(F.lpad(F.col("id").cast("string"), 10, "0").alias("krs"))
    own = t.customer.select(F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("krs"), "c_custkey")
    return own.join(keys, "krs").groupBy("krs").agg(F.min("c_custkey").alias("first_key"))


@query(f"SELECT document_id, krs, rodzaj, is_downloaded, file_type, download_error FROM {CURRENT}")
def documents_current(t: Tables) -> DataFrame:
    return _current(t).select("document_id", "krs", "rodzaj", "is_downloaded", "file_type", "download_error")


@query(f"SELECT document_id FROM {CURRENT} WHERE NOT coalesce(is_downloaded,false)")
def pending_downloads(t: Tables) -> DataFrame:
    return rg.pending_downloads(_current(t)).select("document_id")


@query(f"SELECT document_id FROM {CURRENT} WHERE NOT coalesce(is_downloaded,false) AND download_error IS NULL")
def pending_downloads_no_error(t: Tables) -> DataFrame:
    return rg.pending_downloads(_current(t), without_error=True).select("document_id")


_ORDERS = {"priority": "check_priority DESC, last_checked_on ASC NULLS FIRST, krs", "oldest": "last_checked_on ASC NULLS FIRST, krs", "newest": "first_seen_on DESC, krs", "sequential": "krs", "random": "md5(concat(krs,'|42')), krs"}
_READY = f"fx_companies WHERE is_active AND NOT (check_error_count>=5 AND coalesce(CAST(last_checked_on AS TIMESTAMP)>TIMESTAMP '{AS_OF}'-INTERVAL 240 HOUR,false))"


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT '{name}' AS strategy, krs, row_number() OVER (ORDER BY {order}) AS pos FROM {_READY}) {name}_ WHERE pos<=50" for name, order in _ORDERS.items()))
def crawl_queue(t: Tables) -> DataFrame:
    """The first fifty of each of the five orders."""
    out = None
    for name in _ORDERS:
        top = rg.crawl_queue(t.fx_companies, NOW(), strategy=name, limit=50, backoff_hours=240)
        top = top.select(F.lit(name).alias("strategy"), "krs", F.row_number().over(W.orderBy(*rg.CRAWL_ORDERS[name]())).alias("pos"))  # fifty rows
        out = top if out is None else out.unionByName(top)
    return out


@query("SELECT krs, 'new_only' AS mode FROM fx_companies WHERE last_checked_on IS NULL UNION ALL SELECT krs, 'retry_errors' FROM fx_companies WHERE check_error_count>0 UNION ALL SELECT krs, 'specific_keys' FROM fx_companies WHERE krs IN ('0000000007','0000000011')")
def crawl_modes(t: Tables) -> DataFrame:
    one = lambda m, *k: rg.crawl_mode(t.fx_companies, m, k).select("krs", F.lit(m).alias("mode"))
    return one("new_only").unionByName(one("retry_errors")).unionByName(one("specific_keys", "0000000007", "0000000011"))


@query("SELECT krs, last_checked_on FROM fx_companies WHERE last_checked_on<DATE '2023-12-20' ORDER BY last_checked_on, krs")
def stale_entities(t: Tables) -> DataFrame:
    return t.fx_companies.filter("last_checked_on < date'2023-12-20'").select("krs", "last_checked_on").orderBy("last_checked_on", "krs")


@query("SELECT krs FROM fx_companies WHERE is_active AND source='rdf_batch' ORDER BY check_priority DESC, first_seen_on, krs LIMIT 40")
def undiscovered_entities(t: Tables) -> DataFrame:
    return t.fx_companies.filter("is_active and source = 'rdf_batch'").orderBy(F.desc("check_priority"), "first_seen_on", "krs").limit(40).select("krs")


def _budget_sql(batch: int) -> str:
    new = max(1, batch // 2)
    n = f"(SELECT krs FROM fx_companies WHERE krs NOT IN (SELECT krs FROM fx_companies_extra) ORDER BY check_priority DESC, krs LIMIT {new})"
    stale = f"(SELECT krs FROM fx_companies WHERE last_checked_on<DATE '2023-12-20' AND krs NOT IN (SELECT krs FROM {n} n{batch}) ORDER BY last_checked_on, krs LIMIT {batch}-(SELECT count(*) FROM {n} c{batch}))"
    return f"SELECT {batch} AS batch, krs, 'new' AS why FROM {n} a{batch} UNION ALL SELECT {batch}, krs, 'stale' FROM {stale} s{batch}"


@query(f"{_budget_sql(60)} UNION ALL {_budget_sql(1)}")
def sync_budget(t: Tables) -> DataFrame:
    """Batches of 60 and of 1."""
    one = lambda n: rg.sync_budget(t.fx_companies, t.fx_companies_extra, F.lit("2023-12-20").cast("date"), n).select(F.lit(n).alias("batch"), "krs", "why")
    return one(60).unionByName(one(1))


PERIODS = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY krs, okres_end ORDER BY is_correction DESC, discovered_at, document_id) rn FROM fx_documents WHERE rodzaj=18 AND NOT is_deleted AND NOT coalesce(is_ifrs,true) AND okres_end IS NOT NULL) x WHERE rn=1)"


@query(f"SELECT krs, okres_end, document_id, is_correction FROM {PERIODS} p")
def statement_periods(t: Tables) -> DataFrame:
    return rg.statement_periods(t.fx_documents).select("krs", "okres_end", "document_id", "is_correction")


@query(f"""WITH p AS (SELECT krs, okres_end AS period_end, 'upstream' AS source, is_correction FROM {PERIODS} p),
d AS (SELECT krs, period_end, 'db' AS source, report_version>1 AS is_correction FROM (SELECT *, row_number() OVER (PARTITION BY krs, period_end ORDER BY report_version DESC, id DESC) rn FROM fx_reports WHERE ingestion_status='completed') x WHERE rn=1)
SELECT * FROM p UNION ALL SELECT d.* FROM d LEFT JOIN p USING (krs, period_end) WHERE p.krs IS NULL""")
def supplement_periods(t: Tables) -> DataFrame:
    periods = rg.statement_periods(t.fx_documents).select("krs", F.col("okres_end").alias("period_end"), F.lit("upstream").alias("source"), "is_correction")
    return rg.supplement_periods(periods, t.fx_reports)


@query(f"SELECT krs, max(okres_end) AS okres_end, max_by(document_id, okres_end) AS document_id FROM {PERIODS} p GROUP BY krs")
def period_lookup(t: Tables) -> DataFrame:
    """The latest statement of each company (a given period is a filter on statement_periods)."""
    return rg.statement_periods(t.fx_documents).groupBy("krs").agg(F.max("okres_end").alias("okres_end"), F.max_by("document_id", "okres_end").alias("document_id"))


@query(f"SELECT document_id FROM {CURRENT} WHERE is_downloaded AND NOT EXISTS (SELECT 1 FROM fx_reports r WHERE r.ingestion_status='completed' AND r.source_document_id=c.document_id)")
def pending_etl(t: Tables) -> DataFrame:
    done = t.fx_reports.filter("ingestion_status = 'completed' and source_document_id is not null").select(F.col("source_document_id").alias("document_id"))
    return _current(t).filter("is_downloaded").join(done, "document_id", "left_anti").select("document_id")


@query("SELECT d.document_id FROM fx_documents d WHERE d.document_id NOT IN (SELECT source_document_id FROM fx_reports WHERE ingestion_status='completed') AND d.document_id NOT IN (SELECT document_id FROM fx_downloads WHERE NOT is_downloaded)")
def ingest_candidates(t: Tables) -> DataFrame:
    done = t.fx_reports.filter("ingestion_status = 'completed'").select(F.col("source_document_id").alias("document_id"))
    return t.fx_documents.join(done, "document_id", "left_anti").join(t.fx_downloads.filter("not is_downloaded"), "document_id", "left_anti").select("document_id")


# ---- joins

@query("SELECT p.id, p.run_id, m.name AS model_name, r.krs, r.fiscal_year, p.raw_score FROM fx_predictions p JOIN fx_models m ON m.id=p.model_id JOIN fx_reports r ON r.id=p.report_id JOIN (SELECT DISTINCT run_id FROM fx_predictions) u ON u.run_id=p.run_id")
def score_detail(t: Tables) -> DataFrame:
    runs = t.fx_predictions.select("run_id").distinct()
    models = F.broadcast(t.fx_models.select(F.col("id").alias("model_id"), F.col("name").alias("model_name")))
    reports = t.fx_reports.select(F.col("id").alias("report_id"), "krs", "fiscal_year")
    return t.fx_predictions.join(runs, "run_id").join(models, "model_id").join(reports, "report_id").select("id", "run_id", "model_name", "krs", "fiscal_year", "raw_score")


_MEMBERS = ", ".join(f"('{s}','{f}',{i + 1})" for s, fs in catalog.FEATURE_SETS.items() for i, f in enumerate(fs))


@query(f"SELECT f.report_id, f.computation_version, m.feature_set_id, m.ordinal, f.feature_definition_id, f.value FROM fx_features f JOIN (VALUES {_MEMBERS}) m(feature_set_id,feature_definition_id,ordinal) ON m.feature_definition_id=f.feature_definition_id")
def report_features(t: Tables) -> DataFrame:
    """Stored features with the sets that hold them and their place there."""
    members = catalog.feature_catalog(t.spark).filter("feature_set_id is not null").select("feature_set_id", F.col("id").alias("feature_definition_id"), "ordinal")
    return t.fx_features.join(F.broadcast(members), "feature_definition_id").select("report_id", "computation_version", "feature_set_id", "ordinal", "feature_definition_id", "value")


PRIOR = "(SELECT r.id, r.krs, r.fiscal_year, p.id AS prior_id FROM fx_reports r LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY krs, data_source_id, report_type, fiscal_year ORDER BY report_version DESC, created_at DESC, id DESC) rn FROM fx_reports WHERE ingestion_status='completed') p ON p.rn=1 AND p.krs=r.krs AND p.data_source_id=r.data_source_id AND p.report_type=r.report_type AND p.fiscal_year=r.fiscal_year-1)"


@query(f"SELECT id, prior_id FROM {PRIOR} x")
def prior_year_report(t: Tables) -> DataFrame:
    return rg.prior_year_report(t.fx_reports).select("id", "prior_id")


@query(f"""WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY report_id, section, tag_path ORDER BY extraction_version DESC) rn FROM fx_line_items) x WHERE rn=1)
SELECT q.id AS report_id, g.tag_path, coalesce(c.section,p.section) AS section, c.value_current, p.value_current AS value_prior FROM {PRIOR} q CROSS JOIN (VALUES ('Aktywa'),('RZiS.L')) g(tag_path)
LEFT JOIN l c ON c.report_id=q.id AND c.tag_path=g.tag_path LEFT JOIN l p ON p.report_id=q.prior_id AND p.tag_path=g.tag_path""")
def source_items_prior(t: Tables) -> DataFrame:
    items = ve.latest_line_items(t.fx_line_items).filter("tag_path in ('Aktywa','RZiS.L')")
    ask = rg.prior_year_report(t.fx_reports).select(F.col("id").alias("report_id"), "prior_id", F.explode(F.array(F.lit("Aktywa"), F.lit("RZiS.L"))).alias("tag_path"))
    now = items.select("report_id", "tag_path", "section", "value_current")
    old = items.select(F.col("report_id").alias("prior_id"), "tag_path", F.col("section").alias("_s"), F.col("value_current").alias("value_prior"))
    return ask.join(now, ["report_id", "tag_path"], "left").join(old, ["prior_id", "tag_path"], "left").select("report_id", "tag_path", F.coalesce("section", "_s").alias("section"), "value_current", "value_prior")


def _requests(t: Tables) -> DataFrame:
    snap = F.create_map(F.lit("roa"), F.col("snapshot_version"), F.lit("roe"), F.when(F.col("report_id").endswith("3"), 9).otherwise(F.col("snapshot_version")))
    return t.fx_predictions.select(F.col("id").alias("prediction_id"), "report_id", "scored_at", snap.alias("snapshot"))


REQ = "req AS (SELECT id AS prediction_id, report_id, scored_at, snapshot_version AS va, CASE WHEN report_id LIKE '%3' THEN 9 ELSE snapshot_version END AS vb FROM fx_predictions)"
EXACT = "ex AS (SELECT q.prediction_id, f.feature_definition_id, f.computation_version, f.value FROM req q JOIN fx_features f ON f.report_id=q.report_id AND f.is_valid AND ((f.feature_definition_id='roa' AND f.computation_version=q.va) OR (f.feature_definition_id='roe' AND f.computation_version=q.vb)))"
ASOF = "(SELECT * FROM (SELECT q.prediction_id, f.feature_definition_id, f.computation_version, f.value, row_number() OVER (PARTITION BY q.prediction_id, f.feature_definition_id ORDER BY f.computed_at DESC, f.computation_version DESC) rn FROM {req} q JOIN fx_features f ON f.report_id=q.report_id AND f.is_valid AND {when}) x WHERE rn=1)"
BY_THEN = "(q.scored_at IS NULL OR f.computed_at<=q.scored_at)"


@query(f"WITH {REQ}, {EXACT} SELECT * FROM ex")
def features_at_version(t: Tables) -> DataFrame:
    return rg.features_at_version(t.fx_features, _requests(t)).select("prediction_id", "feature_definition_id", "computation_version", "value")


@query(f"WITH {REQ} SELECT prediction_id, feature_definition_id, computation_version, value FROM {ASOF.format(req='req', when=BY_THEN)} y")
def features_as_of(t: Tables) -> DataFrame:
    return rg.features_as_of(t.fx_features, _requests(t)).select("prediction_id", "feature_definition_id", "computation_version", "value")


@query(f"""WITH {REQ}, {EXACT}, fu AS (SELECT prediction_id FROM ex GROUP BY 1 HAVING count(*)=2), rest AS (SELECT * FROM req WHERE prediction_id NOT IN (SELECT prediction_id FROM fu)),
a AS (SELECT * FROM {ASOF.format(req='rest', when=BY_THEN)} y), la AS (SELECT * FROM rest WHERE prediction_id NOT IN (SELECT prediction_id FROM a))
SELECT prediction_id, feature_definition_id, computation_version, value, 'snapshot' AS source FROM ex WHERE prediction_id IN (SELECT prediction_id FROM fu)
UNION ALL SELECT prediction_id, feature_definition_id, computation_version, value, 'as_of' FROM a
UNION ALL SELECT prediction_id, feature_definition_id, computation_version, value, 'latest' FROM {ASOF.format(req='la', when='true')} z""")
def feature_snapshot_resolve(t: Tables) -> DataFrame:
    return rg.feature_snapshot_resolve(t.fx_features, _requests(t))


LABEL = "CASE WHEN EXISTS (SELECT 1 FROM fx_bankruptcy_events e WHERE e.krs=r.krs AND {c}e.event_date>r.period_end AND e.event_date<=r.period_end+INTERVAL 2 YEAR) THEN 1 ELSE 0 END"


@query(f"SELECT r.id, {LABEL.format(c='')} AS label FROM fx_reports r")
def event_interval_label(t: Tables) -> DataFrame:
    return rg.label_events(t.fx_reports, t.fx_bankruptcy_events, 2).select("id", "label")


@query("SELECT id, krs, event_date FROM fx_bankruptcy_events WHERE krs IN (SELECT krs FROM fx_reports WHERE fiscal_year=1998)")
def label_scope(t: Tables) -> DataFrame:
    return t.fx_bankruptcy_events.join(t.fx_reports.filter("fiscal_year = 1998"), "krs", "left_semi").select("id", "krs", "event_date")


@query("SELECT r.id, r.krs, e.pkd_code, e.incorporation_date FROM fx_reports r LEFT JOIN fx_companies_extra e USING (krs)")
def company_enrich(t: Tables) -> DataFrame:
    return t.fx_reports.join(t.fx_companies_extra, "krs", "left").select("id", "krs", "pkd_code", "incorporation_date")


@query("SELECT c.c_custkey AS key FROM customer c JOIN fx_companies k ON k.krs=lpad(CAST(c.c_custkey AS VARCHAR),10,'0') WHERE k.krs NOT IN (SELECT krs FROM fx_companies WHERE last_checked_on IS NOT NULL) AND c.c_custkey%4=1 AND k.legal_form IN ('BUILDING','MACHINERY')")
def pending_discovery(t: Tables) -> DataFrame:
    """One shard of the found keys of these legal forms that no check has processed."""
    found = t.customer.filter("pmod(c_custkey, 4) = 1").select(F.col("c_custkey").alias("key"), F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("krs"))
    return found.join(t.fx_companies.filter("legal_form in ('BUILDING','MACHINERY')"), "krs", "left_semi").join(t.fx_companies.filter("last_checked_on is not null"), "krs", "left_anti").select("key")


@query(f"SELECT DISTINCT krs FROM {CURRENT} WHERE NOT coalesce(is_downloaded,false) AND krs IN (SELECT krs FROM fx_companies WHERE is_active)")
def needs_download_keys(t: Tables) -> DataFrame:
    return rg.pending_downloads(_current(t)).join(t.fx_companies.filter("is_active"), "krs", "left_semi").select("krs").distinct()


@query("SELECT krs, EXISTS (SELECT 1 FROM fx_predictions p JOIN fx_reports r ON r.id=p.report_id WHERE r.krs=c.krs) AS has_predictions FROM fx_companies c")
def has_predictions_flag(t: Tables) -> DataFrame:
    keys = t.fx_predictions.join(t.fx_reports.select(F.col("id").alias("report_id"), "krs"), "report_id").select("krs").distinct().withColumn("_has", F.lit(True))
    return t.fx_companies.join(keys, "krs", "left").select("krs", F.col("_has").isNotNull().alias("has_predictions"))


@query("SELECT a.id, a.action, u.email FROM fx_activity a LEFT JOIN fx_users u ON u.id=a.user_id WHERE a.krs_number='0000000014' ORDER BY a.created_at DESC, a.id DESC LIMIT 20")
def activity_with_user(t: Tables) -> DataFrame:
    top = t.fx_activity.filter("krs_number = '0000000014'").orderBy(F.desc("created_at"), F.desc("id")).limit(20)
    return top.join(t.fx_users.select(F.col("id").alias("user_id"), "email"), "user_id", "left").select("id", "action", "email")


@query("SELECT u.id, u.email, coalesce(s.n,0) AS n_actions, coalesce(s.k,0) AS n_keys FROM fx_users u LEFT JOIN (SELECT user_id, count(*) AS n, count(DISTINCT krs_number) AS k FROM fx_activity WHERE action='click' GROUP BY 1) s ON s.user_id=u.id")
def users_with_stats(t: Tables) -> DataFrame:
    stats = t.fx_activity.filter("action = 'click'").groupBy(F.col("user_id").alias("id")).agg(N(F.lit(1)).alias("n"), F.countDistinct("krs_number").alias("k"))
    return t.fx_users.join(stats, "id", "left").select("id", "email", F.coalesce("n", F.lit(0)).alias("n_actions"), F.coalesce("k", F.lit(0)).alias("n_keys"))


#: Check, child, its key, parent, its key.
ORPHANS = [
    ("items_without_report", "fx_line_items", "report_id", "fx_reports", "id"), ("reports_without_company", "fx_reports", "krs", "fx_companies_extra", "krs"), ("downloads_without_document", "fx_downloads", "document_id", "fx_documents", "document_id"),
    ("predictions_without_report", "fx_predictions", "report_id", "fx_reports", "id"), ("predictions_without_model", "fx_predictions", "model_id", "fx_models", "id"), ("features_without_report", "fx_features", "report_id", "fx_reports", "id"), ("events_without_company", "fx_bankruptcy_events", "krs", "fx_companies_extra", "krs"),
]
ORPHANS_SQL = " UNION ALL ".join(f"SELECT '{n}' AS check_name, count(*) AS violations FROM {c} x WHERE x.{k} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} y WHERE y.{q}=x.{k})" for n, c, k, p, q in ORPHANS)


@query(ORPHANS_SQL)
def orphan_check(t: Tables) -> DataFrame:
    """All seven pairs."""
    out = None
    for name, child, key, parent, parent_key in ORPHANS:
        found = ve.orphans(getattr(t, child), getattr(t, parent), key, parent_key, name)
        out = found if out is None else out.unionByName(found)
    return out


@query("SELECT m.id AS model_id, r.id AS report_id FROM fx_models m CROSS JOIN fx_reports r WHERE m.is_active AND r.ingestion_status='completed' AND NOT EXISTS (SELECT 1 FROM fx_predictions p WHERE p.model_id=m.id AND p.report_id=r.id)")
def scoring_gaps(t: Tables) -> DataFrame:
    return rg.scoring_gaps(t.fx_models, t.fx_reports, t.fx_predictions)


@query("SELECT d.document_id, r.id AS report_id, r.ingestion_status FROM fx_documents d LEFT JOIN fx_reports r ON r.source_document_id=d.document_id")
def doc_coverage_join(t: Tables) -> DataFrame:
    reports = t.fx_reports.select(F.col("source_document_id").alias("document_id"), F.col("id").alias("report_id"), "ingestion_status")
    return t.fx_documents.join(reports, "document_id", "left").select("document_id", "report_id", "ingestion_status")


@query("SELECT u.id AS user_id, r.id AS report_id, u.has_full_access FROM fx_users u JOIN fx_grants g ON g.user_id=u.id JOIN fx_reports r ON r.krs=g.krs WHERE u.is_active AND NOT u.has_full_access UNION ALL SELECT id, NULL, true FROM fx_users WHERE has_full_access")
def access_filter(t: Tables) -> DataFrame:
    """The rows that each user may see: an equi join over grants, and for users with full access, who see all, one row that says so."""
    rows = t.fx_reports.select(F.col("id").alias("report_id"), "krs")
    granted = t.fx_grants.join(t.fx_users.filter("is_active and not has_full_access").select(F.col("id").alias("user_id"), "has_full_access"), "user_id").join(rows, "krs").select("user_id", "report_id", "has_full_access")
    return granted.unionByName(t.fx_users.filter("has_full_access").select(F.col("id").alias("user_id"), F.lit(None).cast("string").alias("report_id"), "has_full_access"))


@query("SELECT u.id AS user_id, r.id AS report_id FROM (SELECT min(id) AS id FROM fx_users WHERE has_full_access AND is_active) u CROSS JOIN fx_reports r WHERE u.id IS NOT NULL")
def access_full(t: Tables) -> DataFrame:
    """The rows that a user with full access sees, here the one with the smallest id: all."""
    user = t.fx_users.filter("has_full_access and is_active").agg(F.min("id").alias("id")).first()["id"]
    return rg.visible_reports(t.fx_users, t.fx_grants, t.fx_reports, user).select(F.lit(user).cast("long").alias("user_id"), F.col("id").alias("report_id"))


@query("SELECT u.id AS user_id, r.id AS report_id FROM (SELECT min(u.id) AS id FROM fx_users u JOIN fx_grants g ON g.user_id=u.id WHERE NOT u.has_full_access AND u.is_active) u JOIN fx_grants g ON g.user_id=u.id JOIN fx_reports r ON r.krs=g.krs")
def access_granted(t: Tables) -> DataFrame:
    """The rows that a user with grants sees, here the one with the smallest id."""
    user = t.fx_users.filter("not has_full_access and is_active").join(t.fx_grants.select(F.col("user_id").alias("id")), "id", "left_semi").agg(F.min("id").alias("id")).first()["id"]
    return rg.visible_reports(t.fx_users, t.fx_grants, t.fx_reports, user).select(F.lit(user).cast("long").alias("user_id"), F.col("id").alias("report_id"))


# ---- aggregations

@query("SELECT count(*) AS companies, count(*) FILTER (is_active) AS active, count(*) FILTER (check_error_count>0) AS with_errors, count(*) FILTER (last_checked_on IS NULL) AS never_checked, coalesce(sum(total_documents),0)::BIGINT AS documents, coalesce(sum(total_downloaded),0)::BIGINT AS downloaded FROM fx_companies")
def crawl_stats(t: Tables) -> DataFrame:
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return t.fx_companies.agg(N(F.lit(1)).alias("companies"), F.count_if("is_active").alias("active"), F.count_if(F.col("check_error_count") > 0).alias("with_errors"), F.count_if(F.col("last_checked_on").isNull()).alias("never_checked"), zero("total_documents").alias("documents"), zero("total_downloaded").alias("downloaded"))


@query(f"""SELECT (SELECT count(*) FROM fx_companies) AS entities, (SELECT count(DISTINCT krs) FROM fx_documents) AS keys_with_docs, (SELECT count(*) FROM fx_documents WHERE rodzaj=18) AS statements,
(SELECT count(*) FROM fx_activity WHERE created_at>TIMESTAMP '{AS_OF}'-INTERVAL 24 HOUR AND created_at<=TIMESTAMP '{AS_OF}') AS actions_24h, (SELECT count(*) FROM fx_activity WHERE created_at>TIMESTAMP '{AS_OF}'-INTERVAL 7 DAY AND created_at<=TIMESTAMP '{AS_OF}') AS actions_7d,
(SELECT count(DISTINCT r.krs) FROM fx_predictions p JOIN fx_reports r ON r.id=p.report_id) AS scored_companies, (SELECT count(*) FROM fx_users WHERE is_active) AS active_users""")
def overview(t: Tables) -> DataFrame:
    ago = lambda d: F.count_if((F.col("created_at") > F.expr(f"timestamp_ntz'{AS_OF}' - interval {d}")) & (F.col("created_at") <= F.expr(f"timestamp_ntz'{AS_OF}'")))
    parts = [
        t.fx_companies.agg(N(F.lit(1)).alias("entities")), t.fx_documents.agg(F.countDistinct("krs").alias("keys_with_docs"), F.count_if(F.col("rodzaj") == 18).alias("statements")),
        t.fx_activity.agg(ago("24 hours").alias("actions_24h"), ago("7 days").alias("actions_7d")),
        t.fx_predictions.join(t.fx_reports.select(F.col("id").alias("report_id"), "krs"), "report_id").agg(F.countDistinct("krs").alias("scored_companies")), t.fx_users.agg(F.count_if("is_active").alias("active_users")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out


_COVERAGE = f"""(SELECT krs, count(*) AS n_docs, count(DISTINCT rodzaj) AS n_types, string_agg(DISTINCT CAST(rodzaj AS VARCHAR), ',' ORDER BY CAST(rodzaj AS VARCHAR)) AS types, count(DISTINCT CASE WHEN rodzaj=18 THEN okres_end END) AS n_periods,
count(download_error) AS n_errors, CAST(floor((epoch(TIMESTAMP '{AS_OF}')-epoch(max(discovered_at)))/86400) AS INT) AS freshness_days FROM {CURRENT} GROUP BY krs)"""
_HAVING = {"missing_docs": "n_docs<5", "stale": "freshness_days>30", "errors": "n_errors>0"}


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT '{name}' AS having_filter, *, count(*) OVER () AS total FROM {_COVERAGE} c WHERE {having} ORDER BY n_docs DESC, krs LIMIT 50 OFFSET 10) {name}_" for name, having in _HAVING.items()))
def coverage_by_company(t: Tables) -> DataFrame:
    """A3: a page of companies, with the total, under each of the three filters on groups."""
    from ledgerline.functions.scalars import freshness_days

    types = F.array_join(F.array_sort(F.collect_set(F.col("rodzaj").cast("string"))), ",")
    by = _current(t).groupBy("krs").agg(
        N(F.lit(1)).alias("n_docs"), F.countDistinct("rodzaj").alias("n_types"), types.alias("types"), F.countDistinct(F.when(F.col("rodzaj") == 18, F.col("okres_end"))).alias("n_periods"),
        N("download_error").alias("n_errors"), freshness_days(F.max("discovered_at"), F.lit(AS_OF)).alias("freshness_days"),
    )
    by, out = stage(by, "coverage"), None
    totals = by.agg(*[F.count_if(F.expr(having)).alias(name) for name, having in _HAVING.items()]).first()
    for name, having in _HAVING.items():
        page = by.filter(having).orderBy(F.desc("n_docs"), "krs").offset(10).limit(50).select(F.lit(name).alias("having_filter"), "*", F.lit(totals[name]).cast("long").alias("total"))
        out = page if out is None else out.unionByName(page)
    return out


@query("SELECT CASE WHEN check_error_count>=5 THEN 'error' WHEN last_checked_on IS NULL THEN 'pending' ELSE 'done' END AS status, count(*) AS n, sum(total_documents)::BIGINT AS documents FROM fx_companies GROUP BY 1")
def progress_summary(t: Tables) -> DataFrame:
    """A4: companies and their documents by how far their check has come."""
    status = F.when(F.col("check_error_count") >= 5, "error").when(F.col("last_checked_on").isNull(), "pending").otherwise("done")
    return t.fx_companies.groupBy(status.alias("status")).agg(N(F.lit(1)).alias("n"), F.sum("total_documents").alias("documents"))


@query("SELECT user_id, count(*) AS n, count(DISTINCT krs_number) AS n_keys, max(created_at) AS last_seen FROM fx_activity GROUP BY 1")
def user_activity_stats(t: Tables) -> DataFrame:
    return t.fx_activity.groupBy("user_id").agg(N(F.lit(1)).alias("n"), F.countDistinct("krs_number").alias("n_keys"), F.max("created_at").alias("last_seen"))


@query("SELECT user_id, krs_number, n FROM (SELECT user_id, krs_number, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, krs_number) rn FROM fx_activity WHERE krs_number IS NOT NULL GROUP BY 1,2) x WHERE rn<=10")
def user_key_breakdown(t: Tables) -> DataFrame:
    """The ten keys that each user looked at most."""
    by = t.fx_activity.filter("krs_number is not null").groupBy("user_id", "krs_number").agg(N(F.lit(1)).alias("n"))
    return by.withColumn("rn", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("n"), "krs_number"))).filter("rn <= 10").drop("rn")


@query(f"SELECT a.krs_number, c.name, count(*) AS clicks FROM fx_activity a JOIN fx_companies c ON c.krs=a.krs_number WHERE a.action='click' AND a.created_at>=TIMESTAMP '{AS_OF}'-INTERVAL 30 DAY AND a.created_at<=TIMESTAMP '{AS_OF}' GROUP BY 1,2 ORDER BY clicks DESC, a.krs_number LIMIT 10")
def popular_clicks(t: Tables) -> DataFrame:
    span = F.col("created_at").between(F.expr(f"timestamp_ntz'{AS_OF}' - interval 30 days"), F.expr(f"timestamp_ntz'{AS_OF}'"))
    top = t.fx_activity.filter(F.col("action") == "click").filter(span).filter("krs_number is not null")
    named = top.join(t.fx_companies.select(F.col("krs").alias("krs_number"), "name"), "krs_number")
    return named.groupBy("krs_number", "name").agg(N(F.lit(1)).alias("clicks")).orderBy(F.desc("clicks"), "krs_number").limit(10)


@query(f"SELECT coalesce(year(okres_end),year(discovered_at)) AS doc_year, coalesce(file_type,'unknown') AS file_type, count(*) AS n, bool_or(r.id IS NOT NULL) AS parsed FROM {CURRENT} LEFT JOIN fx_reports r ON r.source_document_id=c.document_id AND r.ingestion_status='completed' GROUP BY 1,2")
def doc_coverage(t: Tables) -> DataFrame:
    done = t.fx_reports.filter("ingestion_status = 'completed'").select(F.col("source_document_id").alias("document_id"), F.col("id").alias("_r"))
    year = F.coalesce(F.year("okres_end"), F.year("discovered_at"))
    return _current(t).join(done, "document_id", "left").groupBy(year.cast("long").alias("doc_year"), F.coalesce("file_type", F.lit("unknown")).alias("file_type")).agg(N(F.lit(1)).alias("n"), F.bool_or(F.col("_r").isNotNull()).alias("parsed"))


@query(f"""WITH y AS (SELECT c.krs, CAST(year(c.okres_end) AS VARCHAR) AS y, c.file_type, r.id IS NOT NULL AS parsed FROM {CURRENT} LEFT JOIN fx_reports r ON r.source_document_id=c.document_id AND r.ingestion_status='completed' WHERE c.okres_end IS NOT NULL),
a AS (SELECT krs, min(y) AS earliest_document_year, list_sort(list_distinct(list(y) FILTER (file_type='xml' AND parsed))) AS x, list_sort(list_distinct(list(y) FILTER (file_type='pdf'))) AS p FROM y GROUP BY krs)
SELECT krs, coalesce(array_to_string(x,','),'') AS xml_years, coalesce(array_to_string(list_filter(p, lambda v: NOT list_contains(coalesce(x,[]),v)),','),'') AS pdf_only_years, x[1] AS earliest_xml_year, earliest_document_year FROM a""")
def coverage_summary(t: Tables) -> DataFrame:
    """Years with parsed statements, years with PDFs alone, and the earliest of each kind."""
    year = F.year("okres_end").cast("string")
    done = t.fx_reports.filter("ingestion_status = 'completed'").select(F.col("source_document_id").alias("document_id"), F.lit(True).alias("_parsed"))
    rows = _current(t).filter("okres_end is not null").join(done, "document_id", "left")
    by = rows.groupBy("krs").agg(F.min(year).alias("earliest_document_year"), F.array_sort(F.collect_set(F.when((F.col("file_type") == "xml") & F.col("_parsed"), year))).alias("x"), F.collect_set(F.when(F.col("file_type") == "pdf", year)).alias("p"))
    return by.select("krs", F.array_join("x", ",").alias("xml_years"), F.array_join(F.array_sort(F.array_except("p", "x")), ",").alias("pdf_only_years"), F.array_min("x").alias("earliest_xml_year"), "earliest_document_year")


@query("SELECT report_id FROM fx_features WHERE feature_definition_id IN ('roa','roe','debt_ratio') AND is_valid GROUP BY 1 HAVING count(DISTINCT feature_definition_id)=3")
def having_all_present(t: Tables) -> DataFrame:
    by = t.fx_features.filter("is_valid and feature_definition_id in ('roa','roe','debt_ratio')").groupBy("report_id")
    return by.agg(F.countDistinct("feature_definition_id").alias("n")).filter("n = 3").select("report_id")


@query("SELECT report_id, max(v) AS top FROM (SELECT report_id, extraction_version AS v FROM fx_line_items UNION ALL SELECT report_id, computation_version FROM fx_features) x GROUP BY 1")
def max_version(t: Tables) -> DataFrame:
    both = t.fx_line_items.select("report_id", F.col("extraction_version").alias("v")).unionByName(t.fx_features.select("report_id", F.col("computation_version").alias("v")))
    return both.groupBy("report_id").agg(F.max("v").alias("top"))


CALLS = """SELECT source, count(*) AS total, round(avg(CASE WHEN error IS NULL THEN 0.0 ELSE 1.0 END),4) AS error_rate, round(avg(CASE WHEN cached THEN 1.0 ELSE 0.0 END),4) AS cache_hit_rate,
max(CASE WHEN i=least(floor(n*50/100),n-1) THEN latency_ms END) AS p50, max(CASE WHEN i=least(floor(n*95/100),n-1) THEN latency_ms END) AS p95
FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY latency_ms, event_id)-1 AS i, count(*) OVER (PARTITION BY source) AS n FROM {calls} c) x GROUP BY 1"""


@query(CALLS.format(calls="fx_api_calls"))
def api_call_stats(t: Tables) -> DataFrame:
    return rg.api_call_stats(t.fx_api_calls)


@query(CALLS.format(calls="(SELECT * FROM fx_api_calls ORDER BY ts DESC, event_id DESC LIMIT 1000)"))
def call_stats_window(t: Tables) -> DataFrame:
    """The same over the last 1000 calls."""
    return rg.api_call_stats(t.fx_api_calls, last=1000)


@query("SELECT krs, fiscal_year, count(*) AS n FROM fx_reports WHERE ingestion_status='completed' GROUP BY 1,2 HAVING count(*)>1")
def multi_current_check(t: Tables) -> DataFrame:
    return t.fx_reports.filter("ingestion_status = 'completed'").groupBy("krs", "fiscal_year").agg(N(F.lit(1)).alias("n")).filter("n > 1")


@query("SELECT DISTINCT model_id, report_id FROM fx_predictions")
def scored_models(t: Tables) -> DataFrame:
    """The reports that each model has scored, a row each: a model's list would not fit one row."""
    return t.fx_predictions.select("model_id", "report_id").distinct()


# ---- orders and pages

@query("SELECT krs, max_by(document_id, (discovered_at, document_id)) AS document_id FROM fx_documents GROUP BY 1")
def latest_by_key(t: Tables) -> DataFrame:
    return t.fx_documents.groupBy("krs").agg(F.max_by("document_id", F.struct("discovered_at", "document_id")).alias("document_id"))


@query("SELECT document_id, discovered_at FROM fx_documents ORDER BY discovered_at DESC, document_id LIMIT 25")
def top_k(t: Tables) -> DataFrame:
    return t.fx_documents.select("document_id", "discovered_at").orderBy(F.desc("discovered_at"), "document_id").limit(25)


@query("SELECT id, created_at, (SELECT count(*) FROM fx_activity) AS total FROM fx_activity ORDER BY created_at DESC, id LIMIT 20 OFFSET 40")
def page_offset(t: Tables) -> DataFrame:
    total = t.fx_activity.agg(N(F.lit(1)).alias("total"))
    return t.fx_activity.select("id", "created_at").orderBy(F.desc("created_at"), "id").offset(40).limit(20).crossJoin(F.broadcast(total))


@query("SELECT krs, document_id FROM fx_documents WHERE krs>'0000000500' OR (krs='0000000500' AND document_id>'doc-5') ORDER BY krs, document_id LIMIT 30")
def page_keyset(t: Tables) -> DataFrame:
    after = F.struct("krs", "document_id") > F.struct(F.lit("0000000500").alias("krs"), F.lit("doc-5").alias("document_id"))
    return t.fx_documents.select("krs", "document_id").filter(after).orderBy("krs", "document_id").limit(30)


@query("SELECT c_custkey FROM customer WHERE c_custkey%8=3")
def shard_modulo(t: Tables) -> DataFrame:
    return t.customer.filter(F.pmod("c_custkey", F.lit(8)) == 3).select("c_custkey")


@query("SELECT krs, ('0x'||substr(md5(krs),1,8))::BIGINT%8 AS shard FROM fx_companies")
def shard_hash(t: Tables) -> DataFrame:
    """The one of eight shards that each key is in."""
    return t.fx_companies.select("krs", F.pmod(F.conv(F.substring(F.md5(F.col("krs").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(8)).alias("shard"))


@query("SELECT krs, row_number() OVER (ORDER BY last_checked_on ASC NULLS LAST, krs) AS pos FROM fx_companies ORDER BY last_checked_on ASC NULLS LAST, krs LIMIT 100")
def nulls_order(t: Tables) -> DataFrame:
    top = t.fx_companies.orderBy(F.asc_nulls_last("last_checked_on"), "krs").limit(100)
    return top.select("krs", F.row_number().over(W.orderBy(F.asc_nulls_last("last_checked_on"), "krs")).alias("pos"))  # a hundred rows


NAMED = "(SELECT c.*, krs IN (SELECT krs FROM fx_documents WHERE rodzaj=18) AS has_data FROM fx_companies c)"


def _named(t: Tables) -> DataFrame:
    keys = t.fx_documents.filter("rodzaj = 18").select("krs").distinct().withColumn("_d", F.lit(True))
    return t.fx_companies.join(keys, "krs", "left").withColumn("has_data", F.col("_d").isNotNull()).drop("_d")


@query(f"SELECT krs, name FROM {NAMED} c WHERE name ILIKE '%0001%' ORDER BY has_data DESC, name LIKE 'Customer#00%' DESC, name, krs LIMIT 20")
def multi_key_rank(t: Tables) -> DataFrame:
    return _named(t).filter(F.col("name").contains("0001")).orderBy(F.desc("has_data"), F.desc(F.col("name").startswith("Customer#00")), "name", "krs").limit(20).select("krs", "name")


@query("SELECT id, krs FROM fx_reports WHERE krs='0000000007' ORDER BY period_end DESC, report_version DESC, created_at DESC")
def reports_of_company(t: Tables) -> DataFrame:
    return t.fx_reports.filter("krs = '0000000007'").orderBy(F.desc("period_end"), F.desc("report_version"), F.desc("created_at")).select("id", "krs")


# ---- sets

@query("SELECT document_id FROM fx_documents EXCEPT SELECT document_id FROM fx_downloads")
def new_documents(t: Tables) -> DataFrame:
    return t.fx_documents.join(t.fx_downloads, "document_id", "left_anti").select("document_id")


@query("SELECT krs, max(v) AS v FROM (SELECT krs, fiscal_year AS v FROM fx_reports UNION ALL SELECT krs, CAST(year(discovered_at) AS INT) FROM fx_documents) x GROUP BY 1")
def union_versions(t: Tables) -> DataFrame:
    both = t.fx_reports.select("krs", F.col("fiscal_year").alias("v")).unionByName(t.fx_documents.select("krs", F.year("discovered_at").alias("v")))
    return both.groupBy("krs").agg(F.max("v").alias("v"))


@query(f"""WITH y AS (SELECT krs, list_distinct(list(CAST(year(okres_end) AS VARCHAR)) FILTER (file_type='xml' AND okres_end IS NOT NULL)) AS x, list_distinct(list(CAST(year(okres_end) AS VARCHAR)) FILTER (file_type='pdf' AND okres_end IS NOT NULL)) AS p FROM {CURRENT} GROUP BY krs)
SELECT krs, coalesce(array_to_string(list_sort(list_filter(p, lambda v: NOT list_contains(coalesce(x,[]),v))),','),'') AS pdf_only, coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(x,[]),coalesce(p,[])))),','),'') AS either FROM y""")
def year_sets(t: Tables) -> DataFrame:
    """U4: years with PDFs less those with XML, and the union of both."""
    of = lambda kind: F.collect_set(F.when(F.col("file_type") == kind, F.year("okres_end").cast("string")))
    text = lambda years: F.array_join(F.array_sort(years), ",")
    by = _current(t).groupBy("krs").agg(of("xml").alias("x"), of("pdf").alias("p"))
    return by.select("krs", text(F.array_except("p", "x")).alias("pdf_only"), text(F.array_union("x", "p")).alias("either"))


@query(f"SELECT krs, coalesce(bool_and(file_type IN ('pdf','unknown')) FILTER (rodzaj=18 AND file_type IS NOT NULL),true) AS pdf_only FROM {CURRENT} GROUP BY krs")
def subset_test(t: Tables) -> DataFrame:
    """The empty set is a subset of everything."""
    kinds = F.collect_set(F.when(F.col("rodzaj") == 18, F.col("file_type")))
    return _current(t).groupBy("krs").agg(kinds.alias("s")).select("krs", (F.size(F.array_except("s", F.array(F.lit("pdf"), F.lit("unknown")))) == 0).alias("pdf_only"))


# ---- search

@query("SELECT '00000012' AS query, krs FROM fx_companies WHERE krs LIKE '00000012%' UNION ALL SELECT '123', krs FROM fx_companies WHERE krs='0000000123' UNION ALL SELECT '0000000077999', krs FROM fx_companies WHERE krs='0000000077'")
def key_search(t: Tables) -> DataFrame:
    """a prefix with leading zeros, a short number, and more than ten digits."""
    one = lambda q: rg.key_search(t.fx_companies, q).select(F.lit(q).alias("query"), "krs")
    return one("00000012").unionByName(one("123")).unionByName(one("0000000077999"))


@query(f"SELECT krs, name, (SELECT count(*) FROM fx_companies WHERE name ILIKE '%er#00000001%') AS total FROM {NAMED} c WHERE name ILIKE '%er#00000001%' ORDER BY has_data DESC, lower(name) LIKE 'er#00000001%' DESC, name, krs LIMIT 15")
def name_search(t: Tables) -> DataFrame:
    return rg.name_search(_named(t), "ER#00000001", 15).select("krs", "name", "total")


def _fuzzy_sql(*queries: str) -> str:
    return f"""(WITH q(query) AS (VALUES {", ".join(f"('{q}')" for q in queries)}), n AS (SELECT p_partkey, p_name, flatten(list_transform(string_split(lower(p_name),' '), lambda w: list_transform(range(1,length(w)+2), lambda i: substr('  '||w||' ', i, 3)))) AS r FROM part),
t AS (SELECT query, list_distinct(flatten(list_transform(string_split(query,' '), lambda w: list_transform(range(1,length(w)+2), lambda i: substr('  '||w||' ', i, 3))))) AS s FROM q),
d AS (SELECT DISTINCT p_name, r FROM n), g AS (SELECT d.p_name, d.r, t.query, t.s, unnest(range(1,len(d.r)+1)) AS a FROM d, t), h AS (SELECT *, unnest(range(a,len(r)+1)) AS b FROM g),
m AS (SELECT p_name, query, max(len(list_intersect(s, r[a:b]))/len(list_distinct(list_concat(s, r[a:b])))) AS similarity FROM h GROUP BY 1,2)
SELECT m.query, n.p_partkey, round(m.similarity,6) AS similarity FROM m JOIN n USING (p_name) WHERE m.similarity>0.15 AND NOT contains(lower(n.p_name), m.query))"""


@query(f"SELECT * FROM {_fuzzy_sql('rad widgt', 'colt bolt')} f")
def fuzzy_search(t: Tables) -> DataFrame:
    return rg.fuzzy_search(t.part, t.spark.createDataFrame([("rad widgt",), ("colt bolt",)], "query string"), key="p_partkey", name="p_name")


@query(f"SELECT p_partkey, 0 AS part, 1.0::DOUBLE AS similarity FROM part WHERE contains(lower(p_name),'red widget') UNION ALL SELECT p_partkey, 1, similarity FROM {_fuzzy_sql('red widget')} f ORDER BY part, similarity DESC, p_partkey LIMIT 500")
def fuzzy_union(t: Tables) -> DataFrame:
    """Exact hits first, then fuzzy ones by similarity, up to the limit of the search."""
    exact = t.part.filter(F.lower("p_name").contains("red widget")).select("p_partkey", F.lit(0).alias("part"), F.lit(1.0).alias("similarity"))
    fuzzy = rg.fuzzy_search(t.part, t.spark.createDataFrame([("red widget",)], "query string"), key="p_partkey", name="p_name").select("p_partkey", F.lit(1).alias("part"), "similarity")
    return exact.unionByName(fuzzy).orderBy("part", F.desc("similarity"), "p_partkey").limit(500)

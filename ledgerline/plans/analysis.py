"""Queries: series, metrics, datasets, readiness, quality, imports and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.fixtures import Tables
from ledgerline.functions import catalog
from ledgerline.operators import analysis as an
from ledgerline.operators import register as rg
from ledgerline.operators import versions as ve
from ledgerline.plans.core import SUCCESSFUL
from ledgerline.plans.registry import query
from ledgerline.plans.reports import ASOF, BY_THEN, EXACT, ORPHANS_SQL, PRIOR, orphan_check
from ledgerline.sources import files

N = F.count
HISTORY = "(SELECT * FROM (SELECT p.*, r.krs, r.fiscal_year, r.report_version, row_number() OVER (PARTITION BY r.krs, p.model_id, r.fiscal_year ORDER BY p.scored_at DESC NULLS LAST, r.report_version DESC, p.id DESC) rn FROM fx_predictions p JOIN fx_reports r ON r.id=p.report_id) x WHERE rn=1)"


@query(f"SELECT krs, model_id, fiscal_year, raw_score FROM {HISTORY} h")
def score_history(t: Tables) -> DataFrame:
    return an.score_history(t.fx_predictions, t.fx_reports).select("krs", "model_id", "fiscal_year", "raw_score")


@query(f"SELECT krs, model_id, fiscal_year, id, run_id, report_id, risk_category, scored_at FROM {HISTORY} h")
def score_latest_per_year(t: Tables) -> DataFrame:
    return an.score_history(t.fx_predictions, t.fx_reports).select("krs", "model_id", "fiscal_year", "id", "run_id", "report_id", "risk_category", "scored_at")


CANON = f"(SELECT * FROM (SELECT s.id, s.krs, s.fiscal_year, s.period_end, row_number() OVER (PARTITION BY s.krs, s.fiscal_year ORDER BY s.report_version DESC, s.created_at DESC, s.id DESC) k FROM ({SUCCESSFUL}) s) y WHERE k=1)"


@query(f"SELECT krs, fiscal_year, id FROM {CANON} c")
def canonical_report_per_year(t: Tables) -> DataFrame:
    return an.canonical_reports(t.fx_reports).select("krs", "fiscal_year", "id")


_ITEMS = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY report_id, section, tag_path ORDER BY extraction_version DESC) rn FROM fx_line_items) x WHERE rn=1)"
_P = ", ".join(f"""max(CASE WHEN l.tag_path='{x}' THEN l.value_current END) AS "{x}\"""" for x in an.METRIC_TAGS)
YEARLY = f"(SELECT c.krs, c.fiscal_year, {_P} FROM {CANON} c JOIN {_ITEMS} l ON l.report_id=c.id AND l.tag_path IN ({', '.join(repr(x) for x in an.METRIC_TAGS)}) GROUP BY c.id, c.krs, c.fiscal_year)"


@query(f'SELECT krs, fiscal_year, "Aktywa" AS assets, "RZiS.A" AS revenue, coalesce("RZiS.N","RZiS.L") AS net FROM {YEARLY} y')
def pivot_tags(t: Tables) -> DataFrame:
    return an.yearly_values(t.fx_reports, t.fx_line_items).select("krs", "fiscal_year", F.col("Aktywa").alias("assets"), F.col("`RZiS.A`").alias("revenue"), "net")


METRICS = f"""(SELECT krs, fiscal_year, round("Pasywa_A"/nullif("Aktywa",0)*100,2) AS equity_ratio, round("Aktywa_B"/nullif("Pasywa_B_III",0),2) AS current_ratio, round("RZiS.F"/nullif("RZiS.A",0)*100,2) AS operating_margin,
round(coalesce("RZiS.N","RZiS.L")/nullif("RZiS.A",0)*100,2) AS net_margin, round(("RZiS.A"-lag("RZiS.A") OVER w)/nullif(abs(lag("RZiS.A") OVER w),0)*100,2) AS revenue_growth FROM {YEARLY} y WINDOW w AS (PARTITION BY krs ORDER BY fiscal_year))"""


@query(f"SELECT * FROM {METRICS} m")
def health_metrics(t: Tables) -> DataFrame:
    return an.health_metrics(an.yearly_values(t.fx_reports, t.fx_line_items))


@query(f"SELECT krs, fiscal_year, revenue_growth FROM {METRICS} m")
def revenue_growth(t: Tables) -> DataFrame:
    return health_metrics(t).select("krs", "fiscal_year", "revenue_growth")


def _label(m: str) -> str:
    floors = catalog.METRIC_LABELS[m]
    return f"CASE WHEN {m} IS NULL THEN NULL" + "".join(f" WHEN {m}>={f} THEN '{x}'" for f, x in floors[:-1]) + f" ELSE '{floors[-1][1]}' END AS {m}"


@query(f"SELECT krs, {', '.join(map(_label, catalog.METRIC_LABELS))} FROM (SELECT *, row_number() OVER (PARTITION BY krs ORDER BY fiscal_year DESC) rn FROM {METRICS} m) x WHERE rn=1")
def latest_metric_label(t: Tables) -> DataFrame:
    return an.latest_metric_labels(health_metrics(t))


SERIES = f"""(SELECT krs, period_end, tag_path, v AS value, round(v-lag(v) OVER w,2) AS change, round((v-lag(v) OVER w)/nullif(abs(lag(v) OVER w),0)*100,2) AS pct
FROM (WITH b AS (SELECT c.krs, c.period_end, g.tag_path, l.value_current AS v, l.value_previous AS u, row_number() OVER (PARTITION BY c.krs, g.tag_path ORDER BY c.period_end) AS k FROM {CANON} c CROSS JOIN (VALUES ('Aktywa'),('RZiS.A')) g(tag_path) LEFT JOIN {_ITEMS} l ON l.report_id=c.id AND l.tag_path=g.tag_path)
SELECT krs, period_end, tag_path, v FROM b UNION ALL SELECT krs, CAST(period_end-INTERVAL 1 YEAR AS DATE), tag_path, u FROM b WHERE k=1) s WINDOW w AS (PARTITION BY krs, tag_path ORDER BY period_end))"""


@query(f"SELECT * FROM {SERIES} s")
def time_series(t: Tables) -> DataFrame:
    return an.series(t.fx_reports, t.fx_line_items, ["Aktywa", "RZiS.A"])


@query(f"SELECT krs, tag_path, count(pct) AS n_changes, max(change) AS top_change FROM {SERIES} s GROUP BY 1,2")
def series_changes(t: Tables) -> DataFrame:
    return time_series(t).groupBy("krs", "tag_path").agg(N("pct").alias("n_changes"), F.max("change").alias("top_change"))


IDS = ["roa", "roe", "debt_ratio"]
_PIVOT = ", ".join(f"max(CASE WHEN feature_definition_id='{i}' THEN value END) AS {i}" for i in IDS)


@query(f"SELECT report_id, computation_version, {_PIVOT} FROM fx_features GROUP BY 1,2")
def pivot_features(t: Tables) -> DataFrame:
    return an.pivot_features(t.fx_features, IDS, ["report_id", "computation_version"])


MATRIX = f"""(WITH v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY report_id, feature_definition_id ORDER BY computation_version DESC, computed_at DESC) rn FROM fx_features WHERE is_valid AND feature_definition_id IN ('roa','roe','debt_ratio')) x WHERE rn=1),
w AS (SELECT report_id, {_PIVOT} FROM v GROUP BY 1), s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY logical_key ORDER BY report_version DESC, created_at DESC, id DESC) rn FROM fx_reports WHERE ingestion_status='completed' AND fiscal_year BETWEEN 1996 AND 2000) x WHERE rn=1)
SELECT s.id, s.krs, s.fiscal_year, w.roa, w.roe, w.debt_ratio, e.pkd_code, CASE WHEN EXISTS (SELECT 1 FROM fx_bankruptcy_events b WHERE b.krs=s.krs AND (b.is_confirmed OR b.event_type IN ('bankruptcy','restructuring')) AND b.event_date>s.period_end AND b.event_date<=s.period_end+INTERVAL 2 YEAR) THEN 1 ELSE 0 END AS is_bankrupt_within_2y
FROM s JOIN w ON w.report_id=s.id LEFT JOIN fx_companies_extra e ON e.krs=s.krs)"""


def _matrix(t: Tables) -> DataFrame:
    return an.training_dataset(t.fx_features, t.fx_reports, t.fx_companies_extra, t.fx_bankruptcy_events, IDS, 2, 1996, 2000).select("id", "krs", "fiscal_year", *IDS, "pkd_code", "is_bankrupt_within_2y")


@query(f"SELECT * FROM {MATRIX} m")
def training_dataset(t: Tables) -> DataFrame:
    return _matrix(t)


_MISSING = ", ".join(f"round(avg(CASE WHEN {i} IS NULL THEN 1.0 ELSE 0.0 END)*100,1) AS missing_{i}" for i in IDS)


@query(f"""WITH m AS (SELECT * FROM {MATRIX} q) SELECT count(*) AS n_rows, sum(is_bankrupt_within_2y)::BIGINT AS positives, count(DISTINCT krs) AS companies, min(fiscal_year) AS first_year, max(fiscal_year) AS last_year, {_MISSING}, 0 AS mostly_missing,
(SELECT count(*) FROM (SELECT krs FROM m GROUP BY krs HAVING count(DISTINCT fiscal_year)=1) z) AS single_year_companies FROM m""")
def dataset_stats(t: Tables) -> DataFrame:
    return rg.dataset_stats(_matrix(t), IDS, "is_bankrupt_within_2y")


@query(f"SELECT count(*) AS n_rows, count(roa) AS n_roa, sum(is_bankrupt_within_2y)::BIGINT AS positives FROM {MATRIX} m")
def export_csv(t: Tables) -> DataFrame:
    """The matrix as CSV with header, read back."""
    back = files.export_csv(_matrix(t), "matrix")
    return back.agg(N(F.lit(1)).alias("n_rows"), N("roa").alias("n_roa"), F.sum(F.col("is_bankrupt_within_2y").cast("long")).alias("positives"))


@query("SELECT 'fx_reports' AS table_name, count(*) AS n FROM fx_reports WHERE krs IN (SELECT krs FROM fx_companies WHERE legal_form='BUILDING') UNION ALL SELECT 'fx_line_items', count(*) FROM fx_line_items i JOIN fx_reports r ON r.id=i.report_id WHERE r.krs IN (SELECT krs FROM fx_companies WHERE legal_form='BUILDING') UNION ALL SELECT 'fx_documents', count(*) FROM fx_documents WHERE krs IN (SELECT krs FROM fx_companies WHERE legal_form='BUILDING')")
def export_subset(t: Tables) -> DataFrame:
    """Tables cut to a list of keys, children through their report, as CSV."""
    keys = t.fx_companies.filter("legal_form = 'BUILDING'").select("krs")
    cut = files.subset({"fx_reports": t.fx_reports, "fx_documents": t.fx_documents}, {"fx_line_items": t.fx_line_items}, keys, t.fx_reports)
    parts = [files.export_csv(df, name).agg(N(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in cut.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT lpad(CAST(c_custkey AS VARCHAR),10,'0') AS krs FROM customer WHERE c_custkey%5<>0")
def import_keys_csv(t: Tables) -> DataFrame:
    """Keys from a CSV column, trimmed and padded; what is no key is left out."""
    raw = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("bad-"), F.col("c_custkey").cast("string"))).otherwise(F.concat(F.lit(" "), F.col("c_custkey").cast("string")))
    path = files.export_csv(t.customer.select(raw.alias("key"), "c_name"), "keys", read=False)
    return files.import_keys(t.spark, path, "key")


_PRED_OF = "SELECT DISTINCT r.krs FROM fx_predictions p JOIN fx_reports r ON r.id=p.report_id"


READINESS = """WITH d AS (SELECT krs, count(*) AS documents_total, count(*) FILTER (is_downloaded) AS documents_downloaded FROM fx_documents LEFT JOIN fx_downloads USING (document_id) GROUP BY krs), done AS (SELECT * FROM fx_reports WHERE ingestion_status='completed'),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY krs ORDER BY period_end DESC, report_version DESC, created_at DESC, id DESC) rn FROM done) x WHERE rn=1), i AS (SELECT krs, count(*) AS k FROM done GROUP BY krs),
s AS (SELECT r.krs, count(DISTINCT p.model_id) AS m, count(DISTINCT (p.model_id, p.report_id)) AS pairs FROM fx_predictions p JOIN fx_models o ON o.id=p.model_id AND o.is_active JOIN done r ON r.id=p.report_id GROUP BY 1),
a AS (SELECT d.krs, documents_total, documents_downloaded, coalesce(i.k,0) AS reports_ingested, EXISTS (SELECT 1 FROM fx_features f WHERE f.report_id=n.id AND f.is_valid) AS features_computed, coalesce(s.m,0) AS models_scored, coalesce(i.k,0)*(SELECT count(*) FROM fx_models WHERE is_active)-coalesce(s.pairs,0) AS scoring_gaps, n.fiscal_year AS latest_fiscal_year, (SELECT count(*) FROM fx_models WHERE is_active) AS models_total
FROM d LEFT JOIN i USING (krs) LEFT JOIN n ON n.krs=d.krs LEFT JOIN s ON s.krs=d.krs)
SELECT *, documents_downloaded=documents_total AND reports_ingested>0 AND features_computed AND models_total>0 AND models_scored=models_total AS is_ready FROM a"""


@query(READINESS)
def readiness(t: Tables) -> DataFrame:
    return an.readiness(t.fx_documents, t.fx_downloads, t.fx_reports, t.fx_features, t.fx_predictions, t.fx_models)


_SCORED = "SELECT DISTINCT r.krs FROM fx_predictions p JOIN fx_reports r ON r.id=p.report_id"


@query(f"""WITH k AS (SELECT d.krs, list(DISTINCT coalesce(s.file_type,'unknown')) AS kinds FROM fx_documents d LEFT JOIN fx_downloads s USING (document_id) WHERE d.rodzaj=18 GROUP BY 1), c AS (SELECT krs, list(DISTINCT schema_code) AS schemas FROM fx_reports WHERE ingestion_status='completed' GROUP BY 1),
z AS (SELECT DISTINCT r.krs FROM fx_reports r JOIN fx_line_items i ON i.report_id=r.id AND i.tag_path='RZiS.A' WHERE r.ingestion_status='completed'), u AS (SELECT DISTINCT krs FROM fx_documents WHERE krs NOT IN ({_SCORED}))
SELECT u.krs, CASE WHEN c.schemas IS NULL THEN CASE WHEN len(list_filter(coalesce(k.kinds,[]), lambda x: x NOT IN ('other','unknown','xhtml')))=0 THEN 'ifrs_xhtml' WHEN len(list_filter(k.kinds, lambda x: x NOT IN ('pdf','unknown')))=0 THEN 'pdf_only' ELSE 'ingestion_failed' END
WHEN len(list_filter(c.schemas, lambda x: x<>'SFJMIZ'))=0 THEN 'micro_entity' WHEN len(list_filter(c.schemas, lambda x: x<>'SFZURT'))=0 THEN 'insurance_entity' WHEN z.krs IS NULL THEN 'missing_standard_tags' ELSE 'scoring_failed' END AS reason
FROM u LEFT JOIN k USING (krs) LEFT JOIN c ON c.krs=u.krs LEFT JOIN z ON z.krs=u.krs""")
def no_score_reason(t: Tables) -> DataFrame:
    scored = t.fx_predictions.join(t.fx_reports.select(F.col("id").alias("report_id"), "krs"), "report_id").select("krs").distinct()
    return an.no_score_reason(t.fx_documents, t.fx_downloads, t.fx_reports, t.fx_line_items, scored)


_BOUNDS = ", ".join(f"('{m.model_id}','{name}',{'NULL' if low is None else f'{float(low)}::DOUBLE'},{'NULL' if high is None else f'{float(high)}::DOUBLE'},{i})" for m in catalog.MODELS.values() for i, (low, (high, name, _)) in enumerate(zip([None, *[c[0] for c in m.cutoffs[:-1]]], m.cutoffs, strict=True)))


@query(f"SELECT m.id, m.name, m.version, m.is_baseline, row_number() OVER (ORDER BY m.is_baseline DESC, m.idx DESC, b.ord) AS pos, (SELECT count(*) FROM fx_predictions p WHERE p.model_id=m.id) AS n_scores, b.label, b.lo AS min_score, b.hi AS max_score FROM fx_models m LEFT JOIN (VALUES {_BOUNDS}) b(id,label,lo,hi,ord) ON b.id=m.id WHERE m.is_active")
def model_catalog(t: Tables) -> DataFrame:
    """Active models, baselines first, newest first, with how many scores each has and its thresholds."""
    from pyspark.sql import Window as W

    n = t.fx_predictions.groupBy(F.col("model_id").alias("id")).agg(N(F.lit(1)).alias("n_scores"))
    rows = t.fx_models.filter("is_active").join(F.broadcast(catalog.threshold_table(t.spark).withColumnRenamed("model_id", "id")), "id", "left").join(n, "id", "left")
    pos = F.row_number().over(W.orderBy(F.desc("is_baseline"), F.desc("idx"), "ordinal"))  # a few registry rows
    return rows.withColumn("pos", pos).select("id", "name", "version", "is_baseline", "pos", F.coalesce("n_scores", F.lit(0)).alias("n_scores"), "label", "min_score", "max_score")


_TAGS_OF = ", ".join(f"('{i}','{tag}')" for i, _, _, _, required in catalog.FEATURES for tag in required)
_DIRECTION = "CASE" + "".join(f" WHEN tag_path='{x}' THEN {str(up).lower()}" for x, up in catalog.TAG_DIRECTION.items()) + " END"


@query(f"""WITH req AS (SELECT id AS prediction_id, report_id, scored_at, snapshot_version AS va, CASE WHEN report_id LIKE '%3' THEN 9 ELSE snapshot_version END AS vb FROM {HISTORY} h), {EXACT},
fu AS (SELECT prediction_id FROM ex GROUP BY 1 HAVING count(*)=2), rest AS (SELECT * FROM req WHERE prediction_id NOT IN (SELECT prediction_id FROM fu)), a AS (SELECT * FROM {ASOF.format(req='rest', when=BY_THEN)} y), la AS (SELECT * FROM rest WHERE prediction_id NOT IN (SELECT prediction_id FROM a)),
f AS (SELECT prediction_id, feature_definition_id, value, 'snapshot' AS source FROM ex WHERE prediction_id IN (SELECT prediction_id FROM fu) UNION ALL SELECT prediction_id, feature_definition_id, value, 'as_of' FROM a UNION ALL SELECT prediction_id, feature_definition_id, value, 'latest' FROM {ASOF.format(req='la', when='true')} z),
i AS (SELECT report_id, tag_path, section, value_current FROM {_ITEMS} x), q AS (SELECT id, prior_id FROM {PRIOR} y)
SELECT h.krs, h.model_id, h.fiscal_year, h.raw_score, h.risk_category, b.lo AS min_score, b.hi AS max_score, f.feature_definition_id, f.value, f.source, g.tag_path, coalesce(c.section,p.section) AS section, c.value_current, p.value_current AS value_prior, {_DIRECTION.replace('tag_path', 'g.tag_path')} AS higher_is_better
FROM {HISTORY} h JOIN f ON f.prediction_id=h.id JOIN (VALUES {_TAGS_OF}) g(feature_definition_id,tag_path) ON g.feature_definition_id=f.feature_definition_id LEFT JOIN (VALUES {_BOUNDS}) b(model_id,label,lo,hi,ord) ON b.model_id=h.model_id AND b.label=h.risk_category
LEFT JOIN q ON q.id=h.report_id LEFT JOIN i c ON c.report_id=h.report_id AND c.tag_path=g.tag_path LEFT JOIN i p ON p.report_id=q.prior_id AND p.tag_path=g.tag_path""")
def prediction_detail(t: Tables) -> DataFrame:
    """The newest score of each company, model and year with its threshold, the features it stands on, and their tags.

    Features are those of its snapshot, else as of scoring, else the newest; each tag comes with its amount in the
    report and in the one of the year before, and with its direction.
    """
    snap = F.create_map(F.lit("roa"), F.col("snapshot_version"), F.lit("roe"), F.when(F.col("report_id").endswith("3"), 9).otherwise(F.col("snapshot_version")))
    return an.prediction_detail(an.score_history(t.fx_predictions, t.fx_reports).withColumn("snapshot", snap), t.fx_features, t.fx_reports, t.fx_line_items)


@query("SELECT id, krs, event_type FROM fx_bankruptcy_events WHERE is_confirmed OR event_type IN ('bankruptcy','restructuring')")
def confirmed_events(t: Tables) -> DataFrame:
    return rg.confirmed_events(t.fx_bankruptcy_events).select("id", "krs", "event_type")


@query(f"""{ORPHANS_SQL} UNION ALL SELECT 'reports_year_out_of_range', count(*) FROM fx_reports WHERE fiscal_year NOT BETWEEN 1990 AND 2100 UNION ALL SELECT 'key_format', count(*) FROM fx_companies WHERE NOT regexp_full_match(krs,'[0-9]{{10}}')
UNION ALL SELECT 'several_current', count(*) FROM (SELECT krs, fiscal_year FROM fx_reports WHERE ingestion_status='completed' GROUP BY 1,2 HAVING count(*)>1) x""")
def fk_report(t: Tables) -> DataFrame:
    """Q1: all pairs of J16, years from 1990 to 2100, keys of ten digits, and years with several current reports."""
    count = lambda df, name: df.agg(N(F.lit(1)).alias("violations")).select(F.lit(name).alias("check_name"), "violations")
    several = t.fx_reports.filter("ingestion_status = 'completed'").groupBy("krs", "fiscal_year").count().filter("count > 1")
    years, keys = t.fx_reports.filter("fiscal_year not between 1990 and 2100"), t.fx_companies.filter("not krs rlike '^[0-9]{10}$'")
    return orphan_check(t).unionByName(count(years, "reports_year_out_of_range")).unionByName(count(keys, "key_format")).unionByName(count(several, "several_current"))


@query("SELECT status, min(key) AS first, max(key) AS last, count(*) AS n FROM (SELECT key, status, key-row_number() OVER (PARTITION BY status ORDER BY key) AS g FROM (SELECT o_orderkey AS key, CASE WHEN o_orderkey%13<4 THEN 'not_found' ELSE 'found' END AS status FROM orders) k) x GROUP BY status, g")
def not_found_ranges(t: Tables) -> DataFrame:
    return rg.not_found_ranges(t.orders.select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 13 < 4, "not_found").otherwise("found").alias("status")))


@query("WITH v AS (SELECT logical_key, report_version, ingestion_status, schema_code, lag(ingestion_status) OVER w AS a, lag(schema_code) OVER w AS b, row_number() OVER w AS n FROM fx_reports WINDOW w AS (PARTITION BY logical_key ORDER BY report_version)) SELECT count(*) AS versions, count(DISTINCT logical_key) AS keys, round(count(*)/count(DISTINCT logical_key),4) AS per_key, count(*) FILTER (n>1 AND a=ingestion_status AND b=schema_code) AS unchanged FROM v")
def version_amplification(t: Tables) -> DataFrame:
    return an.version_amplification(t.fx_reports, "logical_key", "report_version", ["ingestion_status", "schema_code"])


@query("""WITH v AS (SELECT d.document_id, CAST(d.rodzaj AS VARCHAR) AS rodzaj, CASE WHEN d.okres_end IS NULL THEN '' ELSE CAST(d.okres_end AS VARCHAR) END AS okres, g.version, CASE WHEN g.version=2 AND s.is_downloaded THEN 'downloaded' WHEN s.document_id IS NULL THEN 'unknown' ELSE 'pending' END AS status, s.file_type
FROM fx_documents d LEFT JOIN fx_downloads s USING (document_id) CROSS JOIN (VALUES (1),(2)) g(version) WHERE g.version=1 OR s.document_id IS NOT NULL), c AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY version DESC) rn FROM v)
SELECT document_id, TRY_CAST(rodzaj AS SMALLINT) AS rodzaj, TRY_CAST(nullif(okres,'') AS DATE) AS okres_end, status='downloaded' AS is_downloaded, file_type FROM c WHERE rn=1""")
def split_discovery_state(t: Tables) -> DataFrame:
    """A versioned table of text columns split in documents and their state, each from the newest row of a document, and joined again."""
    state = t.fx_downloads.select("document_id", F.col("is_downloaded").alias("_d"), "file_type")
    found = t.fx_documents.select("document_id", F.col("rodzaj").cast("string"), F.coalesce(F.col("okres_end").cast("string"), F.lit("")).alias("okres")).join(state, "document_id", "left")
    versions = found.withColumn("version", F.explode(F.when(F.col("_d").isNull(), F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))))
    status = F.when((F.col("version") == 2) & F.col("_d"), "downloaded").when(F.col("_d").isNull(), "unknown").otherwise("pending")
    documents, states = an.split_discovery_state(versions.withColumn("status", status).drop("_d"))
    return documents.join(states, "document_id")


@query("""WITH e AS (SELECT krs, name, legal_form FROM fx_companies WHERE check_priority<>2), r AS (SELECT krs, nip FROM fx_companies_extra)
SELECT e.krs, e.name, coalesce(r.nip,'none') AS nip FROM e LEFT JOIN r USING (krs) UNION ALL SELECT r.krs, NULL, r.nip FROM r WHERE r.krs NOT IN (SELECT krs FROM e)""")
def collapse_registry(t: Tables) -> DataFrame:
    """Entities with their registry data, then registry rows without an entity."""
    e, r = t.fx_companies.filter("check_priority <> 2").select("krs", "name"), t.fx_companies_extra.select("krs", "nip")
    both = e.join(r, "krs", "left").select("krs", "name", F.coalesce("nip", F.lit("none")).alias("nip"))
    return both.unionByName(r.join(e, "krs", "left_anti").select("krs", F.lit(None).cast("string").alias("name"), "nip"))


@query("SELECT user_id, event_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) rn, count(*) OVER (PARTITION BY user_id, event_type) n FROM events) x WHERE n>1 AND rn=1")
def token_dedup(t: Tables) -> DataFrame:
    """Of keys that occur more than once, the newest row; counted and picked by one aggregation, no window over a hot key."""
    by = t.events.groupBy("user_id", "event_type").agg(N(F.lit(1)).alias("n"), F.max(F.struct("ts", "event_id")).alias("m"))
    return by.filter("n > 1").select("user_id", F.col("m.event_id").alias("event_id"))

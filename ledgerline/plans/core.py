"""Queries: latest views, versions, features, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.fixtures import Tables
from ledgerline.functions import catalog
from ledgerline.operators import features as fe
from ledgerline.operators import flow
from ledgerline.operators import layout
from ledgerline.operators import stores
from ledgerline.operators import versions as ve
from ledgerline.plans.registry import query

REPORT = ("id", "logical_key", "report_version", "krs", "fiscal_year", "ingestion_status", "schema_code")
LATEST = "SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM {table}) x WHERE rn=1"


def _latest_sql(cols, table, keys, order):
    return LATEST.format(cols=", ".join(cols), table=table, keys=", ".join(keys), order=order)


@query(_latest_sql(REPORT, "fx_reports", ["logical_key"], "report_version DESC, created_at DESC, id DESC"))
def latest_reports(t: Tables) -> DataFrame:
    return ve.latest_reports(t.fx_reports).select(*REPORT)


RAW = "(SELECT i.report_id, i.section, i.extraction_version, r.created_at, count(*) AS n_items FROM fx_line_items i JOIN fx_reports r ON r.id=i.report_id GROUP BY i.report_id, i.section, i.extraction_version, r.created_at) raw"


@query(_latest_sql(["report_id", "section", "extraction_version", "n_items"], RAW, ["report_id", "section"], "extraction_version DESC, created_at DESC"))
def latest_raw(t: Tables) -> DataFrame:
    raw = t.fx_line_items.join(t.fx_reports.select(F.col("id").alias("report_id"), "created_at"), "report_id").groupBy("report_id", "section", "extraction_version", "created_at").agg(F.count(F.lit(1)).alias("n_items"))
    return ve.latest_raw(raw).drop("created_at")


@query(_latest_sql(["report_id", "section", "tag_path", "extraction_version", "value_current"], "fx_line_items", ["report_id", "section", "tag_path"], "extraction_version DESC"))
def latest_line_items(t: Tables) -> DataFrame:
    return ve.latest_line_items(t.fx_line_items).select("report_id", "section", "tag_path", "extraction_version", "value_current")


@query(_latest_sql(["report_id", "feature_definition_id", "computation_version", "value"], "fx_features", ["report_id", "feature_definition_id"], "computation_version DESC, computed_at DESC"))
def latest_features(t: Tables) -> DataFrame:
    return ve.latest_features(t.fx_features).select("report_id", "feature_definition_id", "computation_version", "value")


SUCCESSFUL = _latest_sql(["*"], "(SELECT * FROM fx_reports WHERE ingestion_status='completed') c", ["logical_key"], "report_version DESC, created_at DESC, id DESC")


@query(_latest_sql(REPORT, "(SELECT * FROM fx_reports WHERE ingestion_status='completed') c", ["logical_key"], "report_version DESC, created_at DESC, id DESC"))
def latest_successful_reports(t: Tables) -> DataFrame:
    return ve.latest_successful_reports(t.fx_reports).select(*REPORT)


@query("SELECT krs, document_id, discovered_at FROM (SELECT *, row_number() OVER (PARTITION BY krs ORDER BY discovered_at DESC, document_id) rn FROM fx_documents) x WHERE rn=1")
def distinct_on(t: Tables) -> DataFrame:
    return ve.latest(t.fx_documents, ["krs"], [F.desc("discovered_at"), F.asc("document_id")]).select("krs", "document_id", "discovered_at")


APPENDED = """WITH e AS (SELECT report_id, feature_definition_id, computation_version, value FROM fx_features), n AS (SELECT report_id, feature_definition_id, value FROM fx_features WHERE computation_version=1 AND report_id LIKE '%7'),
m AS (SELECT report_id, feature_definition_id, max(computation_version) AS top FROM fx_features GROUP BY 1,2)
SELECT * FROM e UNION ALL SELECT n.report_id, n.feature_definition_id, CAST(coalesce(m.top,0)+1 AS INT), n.value FROM n LEFT JOIN m USING (report_id, feature_definition_id)"""


@query(APPENDED)
def append_versioned(t: Tables) -> DataFrame:
    cols = ["report_id", "feature_definition_id", "computation_version", "value"]
    new = t.fx_features.filter("computation_version = 1 AND report_id LIKE '%7'").select("report_id", "feature_definition_id", "value")
    return ve.append_versioned(t.fx_features.select(*cols), new, ["report_id", "feature_definition_id"], "computation_version")


@query("""WITH o AS (SELECT document_id, krs, rodzaj FROM fx_documents WHERE rodzaj=18), n AS (SELECT document_id, krs, rodzaj FROM fx_documents)
SELECT * FROM o UNION ALL SELECT * FROM n WHERE document_id NOT IN (SELECT document_id FROM o)""")
def insert_ignore(t: Tables) -> DataFrame:
    new = t.fx_documents.select("document_id", "krs", "rodzaj")
    return ve.insert_ignore(new.filter("rodzaj = 18"), new.unionByName(new), ["document_id"], [F.asc("rodzaj")])


COALESCED = """WITH o AS (SELECT krs, name, legal_form FROM fx_companies WHERE check_priority<3), n AS (SELECT e.krs, CASE WHEN e.pkd_code LIKE '1%' THEN NULL ELSE upper(e.pkd_code) END AS name, 'NEW' AS legal_form FROM fx_companies_extra e)
SELECT coalesce(o.krs,n.krs) AS krs, coalesce(n.name,o.name) AS name, coalesce(n.legal_form,o.legal_form) AS legal_form FROM o FULL JOIN n ON o.krs=n.krs"""


@query(COALESCED)
def merge_coalesce(t: Tables) -> DataFrame:
    new = t.fx_companies_extra.select("krs", F.when(~F.col("pkd_code").like("1%"), F.upper("pkd_code")).alias("name"), F.lit("NEW").alias("legal_form"))
    return ve.merge_coalesce(t.fx_companies.filter("check_priority < 3").select("krs", "name", "legal_form"), new, ["krs"])


OVERWRITTEN = """WITH o AS (SELECT krs, name, legal_form FROM fx_companies WHERE check_priority<3), n AS (SELECT e.krs, CASE WHEN e.pkd_code LIKE '1%' THEN NULL ELSE upper(e.pkd_code) END AS name FROM fx_companies_extra e)
SELECT coalesce(o.krs,n.krs) AS krs, CASE WHEN n.krs IS NOT NULL THEN n.name ELSE o.name END AS name, o.legal_form FROM o FULL JOIN n ON o.krs=n.krs"""


@query(OVERWRITTEN)
def merge_overwrite(t: Tables) -> DataFrame:
    new = t.fx_companies_extra.select("krs", F.when(~F.col("pkd_code").like("1%"), F.upper("pkd_code")).alias("name"))
    return ve.merge_overwrite(t.fx_companies.filter("check_priority < 3").select("krs", "name", "legal_form"), new, ["krs"])


@query(APPENDED)
def store_append_versioned(t: Tables) -> DataFrame:
    """S9 into a store: only the buckets of the new rows are rewritten."""
    cols = ["report_id", "feature_definition_id", "computation_version", "value"]
    store = stores.create(t.fx_features.select(*cols), ["report_id", "feature_definition_id"])
    store.append_versioned(t.fx_features.filter("computation_version = 1 AND report_id LIKE '%7'").select("report_id", "feature_definition_id", "value"), "computation_version")
    return store.read(t.spark)


@query(COALESCED)
def store_merge_coalesce(t: Tables) -> DataFrame:
    """S11 into a store."""
    store = stores.create(t.fx_companies.filter("check_priority < 3").select("krs", "name", "legal_form"), ["krs"])
    store.merge_coalesce(t.fx_companies_extra.select("krs", F.when(~F.col("pkd_code").like("1%"), F.upper("pkd_code")).alias("name"), F.lit("NEW").alias("legal_form")))
    return store.read(t.spark)


@query(OVERWRITTEN)
def store_merge_overwrite(t: Tables) -> DataFrame:
    """S12 into a store."""
    store = stores.create(t.fx_companies.filter("check_priority < 3").select("krs", "name", "legal_form"), ["krs"])
    store.merge_overwrite(t.fx_companies_extra.select("krs", F.when(~F.col("pkd_code").like("1%"), F.upper("pkd_code")).alias("name")))
    return store.read(t.spark)


@query("""WITH e AS (SELECT * FROM fx_reports WHERE report_version=1), f AS (SELECT * FROM fx_reports WHERE report_version>1 OR src%5=0),
h AS (SELECT logical_key, report_version AS top, id AS head FROM e),
n AS (SELECT f.id, f.logical_key, f.created_at, h.top, h.head FROM f LEFT JOIN h USING (logical_key) WHERE f.id NOT IN (SELECT id FROM e))
SELECT f.id, f.logical_key, e.report_version, CAST(NULL AS VARCHAR) AS supersedes_report_id FROM f JOIN e ON e.id=f.id
UNION ALL SELECT id, logical_key, CAST(coalesce(top,0)+row_number() OVER w AS INT), coalesce(lag(id) OVER w, head) FROM n WINDOW w AS (PARTITION BY logical_key ORDER BY created_at, id)""")
def assign_report_version(t: Tables) -> DataFrame:
    filings = t.fx_reports.filter("report_version > 1 OR src % 5 = 0").select("id", "logical_key", F.col("created_at").alias("arrived"))
    return ve.assign_report_version(filings, t.fx_reports.filter("report_version = 1").select("id", "logical_key", "report_version"))


@query("SELECT report_id, tag_path, value_current FROM fx_line_items WHERE report_id NOT IN (SELECT id FROM fx_reports WHERE fiscal_year=1996)")
def purge_sentinels(t: Tables) -> DataFrame:
    return ve.purge(t.fx_reports.filter("fiscal_year = 1996"), t.fx_line_items, "id", "report_id").select("report_id", "tag_path", "value_current")


@query(f"""SELECT r.id AS id, coalesce(CASE WHEN r.schema_code='SFZURT' THEN NULL ELSE r.schema_code END, 'SFJINZ') AS schema_code, CASE WHEN n.has IS NULL THEN coalesce(g.tags||',','')||'CF.A_II_1' ELSE g.tags END AS tags FROM fx_reports r
LEFT JOIN (SELECT report_id, string_agg(DISTINCT tag_path, ',' ORDER BY tag_path) AS tags FROM fx_line_items WHERE tag_path IN ('RZiS.I','CF.A_II_1','Pasywa_B') GROUP BY 1) g ON g.report_id=r.id LEFT JOIN (SELECT DISTINCT report_id, true AS has FROM fx_line_items WHERE tag_path='CF.A_II_1') n ON n.report_id=r.id""")
def backfill_default(t: Tables) -> DataFrame:
    """A default for null codes, and a tag added to the lists that lack it."""
    tags = t.fx_line_items.filter("tag_path in ('RZiS.I','CF.A_II_1','Pasywa_B')").groupBy(F.col("report_id").alias("id")).agg(F.array_sort(F.collect_set("tag_path")).alias("tags"))
    rows = t.fx_reports.select("id", F.nullif("schema_code", F.lit("SFZURT")).alias("schema_code")).fillna({"schema_code": "SFJINZ"}).join(tags, "id", "left")
    return rows.select("id", "schema_code", F.array_join(ve.with_element(F.col("tags"), "CF.A_II_1"), ",").alias("tags"))


_WIDE = "SELECT report_id, " + ", ".join(f"""MAX(CASE WHEN tag_path='{x}' THEN value_current END) AS "{x}\"""" for x in catalog.TAGS) + " FROM (" + _latest_sql(["*"], "fx_line_items", ["report_id", "section", "tag_path"], "extraction_version DESC") + ") l GROUP BY report_id"


def _feature_sql(d) -> tuple[str, str]:
    """Value and error of a definition in SQL, written apart from the operator."""
    i, logic, top, bottom, required = d
    q = lambda x: f'"{x}"'
    miss = lambda xs: "".join(f" WHEN {q(x)} IS NULL THEN 'missing_tag:{x}'" for x in xs)
    if logic == "ratio":
        return f"round({q(top)}/nullif({q(bottom)},0),6)", f"CASE{miss([top, bottom])} WHEN {q(bottom)}=0 THEN 'division_by_zero' END"
    zero = lambda x: f"coalesce({q(x)},0)"
    raw = {
        "quick_ratio": f"({q('Aktywa_B')}-{zero('Aktywa_B_I')})/nullif({q('Pasywa_B_III')},0)",
        "log_total_assets": f"CASE WHEN {q('Aktywa')}>0 THEN ln({q('Aktywa')}) END",
        "log_revenue": f"CASE WHEN {q('RZiS.A')}>0 THEN ln({q('RZiS.A')}) END",
        "x1_maczynska": f"({q('RZiS.I')}+{zero('CF.A_II_1')})/nullif({q('Pasywa_B')},0)",
        "w3_maczynska2006": f"({q('RZiS.L')}+{zero('CF.A_II_1')})/nullif({q('Pasywa_B')},0)",
        "x3_poznanski": f"({q('Pasywa_A')}+{zero('Pasywa_B_II')})/nullif({q('Aktywa')},0)",
        "x1_poznan": f"({q('Aktywa_B')}-{q('Pasywa_B_III')})/nullif({q('Aktywa')},0)",
    }
    raw |= {"x2_poznanski": raw["quick_ratio"], "x3_poznan": raw["w3_maczynska2006"]}
    return f"round({raw[i]},6)", f"CASE WHEN ({raw[i]}) IS NOT NULL THEN NULL{miss(required)} ELSE 'computation_returned_null' END"


def _features_sql(ids=None) -> str:
    parts = []
    for d in catalog.FEATURES:
        if ids is None or d[0] in ids:
            v, e = _feature_sql(d)
            parts.append(f"SELECT report_id, '{d[0]}' AS feature_definition_id, {v} AS value, ({e}) IS NULL AS is_valid, {e} AS error_message FROM wide")
    return f"WITH wide AS ({_WIDE}) " + " UNION ALL ".join(parts)


COMPUTED = f"WITH v AS ({_features_sql()}) SELECT v.*, i.version AS source_extraction_version, CAST(coalesce(f.top,0)+1 AS INT) AS computation_version FROM v JOIN (SELECT report_id, CAST(max(extraction_version) AS INT) AS version FROM fx_line_items GROUP BY 1) i USING (report_id) LEFT JOIN (SELECT report_id, feature_definition_id, max(computation_version) AS top FROM fx_features GROUP BY 1,2) f USING (report_id, feature_definition_id)"


@query(COMPUTED)
def compute_features(t: Tables) -> DataFrame:
    """All features of all reports as the next computation over those stored."""
    return flow.compute_new_features(t.fx_line_items, t.fx_features)


def _item_layout(t: Tables) -> layout.Layout:
    """Items by report: those of first extractions laid out, later ones appended."""
    items = layout.create(t.fx_line_items.filter("extraction_version = 1"), ["report_id"])
    items.append(t.fx_line_items.filter("extraction_version > 1"))
    return items


@query(_latest_sql(["report_id", "section", "tag_path", "extraction_version", "value_current"], "fx_line_items", ["report_id", "section", "tag_path"], "extraction_version DESC"))
def layout_line_items(t: Tables) -> DataFrame:
    """W3 on items laid out by report: no exchange."""
    return ve.latest_line_items(_item_layout(t).read(t.spark)).select("report_id", "section", "tag_path", "extraction_version", "value_current")


@query(_WIDE)
def layout_pivot(t: Tables) -> DataFrame:
    """A10 of all catalogue tags on items laid out by report: no exchange."""
    return fe.report_values(_item_layout(t).read(t.spark), dealt=True)


@query(COMPUTED)
def layout_features(t: Tables) -> DataFrame:
    """X5 on items and stored features that are laid out by report: no exchange."""
    return flow.compute_new_features(_item_layout(t).read(t.spark), layout.create(t.fx_features, ["report_id"]).read(t.spark), dealt=True)


@query(_features_sql([f[0] for f in catalog.FEATURES if f[1] == "ratio"]).replace("UNION ALL", "UNION ALL"))
def feature_ratio(t: Tables) -> DataFrame:
    return fe.compute_features(fe.report_values(t.fx_line_items), [f for f in catalog.FEATURES if f[1] == "ratio"])


@query(_features_sql([f[0] for f in catalog.FEATURES if f[1] == "custom"]))
def feature_custom(t: Tables) -> DataFrame:
    return fe.compute_features(fe.report_values(t.fx_line_items), [f for f in catalog.FEATURES if f[1] == "custom"])


@query(f"""WITH wide AS ({_WIDE}) SELECT report_id, 'working_capital' AS feature_definition_id, round("Aktywa_B"-"Pasywa_B_III",6) AS value, "Aktywa_B" IS NOT NULL AND "Pasywa_B_III" IS NOT NULL AS is_valid,
CASE WHEN "Aktywa_B" IS NULL THEN 'missing_tag:Aktywa_B' WHEN "Pasywa_B_III" IS NULL THEN 'missing_tag:Pasywa_B_III' END AS error_message FROM wide""")
def feature_difference(t: Tables) -> DataFrame:
    return fe.compute_features(fe.report_values(t.fx_line_items), [("working_capital", "difference", "Aktywa_B", "Pasywa_B_III", [])])


@query(f"""WITH wide AS ({_WIDE}) SELECT report_id, 'net_profit' AS feature_definition_id, round("RZiS.L",6) AS value, "RZiS.L" IS NOT NULL AS is_valid, CASE WHEN "RZiS.L" IS NULL THEN 'missing_tag:RZiS.L' END AS error_message FROM wide
UNION ALL SELECT report_id, 'nothing', NULL, false, 'missing_formula' FROM wide""")
def feature_raw(t: Tables) -> DataFrame:
    return fe.compute_features(fe.report_values(t.fx_line_items), [("net_profit", "raw_value", "RZiS.L", None, []), ("nothing", "raw_value", None, None, [])])


def _scores_sql(models) -> str:
    parts = []
    of = {d[0]: d for d in catalog.FEATURES}
    ids = sorted({f for m in models for f in m.coefficients})
    f = ", ".join(f"{_feature_sql(of[i])[0]} AS {i}" for i in ids)
    for m in models:
        total = f"{m.intercept or 0.0}" + "".join(f"+{c}*{i}" for i, c in m.coefficients.items())
        case = "CASE" + "".join(f" WHEN raw_score<{b} THEN {{}}" for b, _, _ in m.cutoffs[:-1]) + " ELSE {} END"
        label, cls = case.format(*[f"'{n}'" for _, n, _ in m.cutoffs]), case.format(*[c for _, _, c in m.cutoffs])
        warned = "false"
        if m.warning:
            w, above, _, low, to = m.warning
            warned = f"{w}>{above}"
            label = f"CASE WHEN {warned} AND ({label})='{low}' THEN '{to}' ELSE {label} END"
        have = " AND ".join(f"{i} IS NOT NULL" for i in m.coefficients)
        parts.append(f"SELECT report_id, '{m.model_id}' AS model_id, raw_score, {cls} AS classification, {label} AS risk_category, {warned} AS warned FROM (SELECT *, floor(({total})*1000000+0.5)/1000000 AS raw_score FROM feats WHERE {have}) s")
    return f"WITH wide AS ({_WIDE}), feats AS (SELECT report_id, {f} FROM wide) " + " UNION ALL ".join(parts)


def _scores(t: Tables, *ids: str) -> DataFrame:
    models = [catalog.MODELS[i] for i in ids]
    wide = fe.features_wide(fe.report_values(t.fx_line_items), sorted({f for m in models for f in m.coefficients}))
    return fe.score_all(wide, models).select("report_id", "model_id", "raw_score", "classification", "risk_category", (F.size("warnings") > 0).alias("warned"))


for _name, _model in (("score_m94", "maczynska_1994_v1"), ("score_p04", "poznanski_2004_v1"), ("score_m06", "maczynska_2006_v1"), ("score_prusak", "prusak_p1_v1"), ("score_p00", "poznan_2000_v1")):
    query(_scores_sql([catalog.MODELS[_model]]), _name)(lambda t, m=_model: _scores(t, m))


@query(_scores_sql(list(catalog.MODELS.values())))
def score_batch(t: Tables) -> DataFrame:
    """All models in one job over one wide table."""
    return _scores(t, *list(catalog.MODELS))


_M94 = catalog.MODELS["maczynska_1994_v1"]
_P04 = catalog.MODELS["poznanski_2004_v1"]


@query(
    f"WITH wide AS ({_WIDE}), feats AS (SELECT report_id, "
    + ", ".join(f"{_feature_sql(next(d for d in catalog.FEATURES if d[0] == i))[0]} AS {i}" for i in _P04.coefficients)
    + " FROM wide), ok AS (SELECT * FROM feats WHERE " + " AND ".join(f"{i} IS NOT NULL" for i in _P04.coefficients) + ") "
    + f"SELECT report_id, '_intercept' AS feature, CAST({_P04.intercept} AS DOUBLE) AS contribution FROM ok"
    + "".join(f" UNION ALL SELECT report_id, '{i}', round({c}*{i},6) FROM ok" for i, c in _P04.coefficients.items())
)
def contributions(t: Tables) -> DataFrame:
    wide = fe.features_wide(fe.report_values(t.fx_line_items), list(_P04.coefficients))
    return fe.score(wide, _P04).select("report_id", F.explode("feature_contributions").alias("feature", "contribution"))


#: The flagship: latest completed reports, latest items, pivot, features, score, risk class.
M94_SQL = f"WITH s AS ({_scores_sql([_M94])}), r AS ({SUCCESSFUL}) SELECT r.id AS report_id, r.krs, r.fiscal_year, s.raw_score, s.classification, s.risk_category FROM s JOIN r ON r.id=s.report_id"


@query(M94_SQL)
def scored_companies(t: Tables) -> DataFrame:
    reports = ve.latest_successful_reports(t.fx_reports).select(F.col("id").alias("report_id"), "krs", "fiscal_year")
    wide = fe.features_wide(fe.report_values(t.fx_line_items), list(_M94.coefficients))
    return fe.score(wide, _M94).join(reports, "report_id").select("report_id", "krs", "fiscal_year", "raw_score", "classification", "risk_category")


@query("""WITH f AS (SELECT report_id, feature_definition_id, computation_version, row_number() OVER (PARTITION BY report_id, feature_definition_id ORDER BY computation_version DESC) rn FROM fx_features WHERE is_valid)
SELECT report_id, count(*) AS n, string_agg(feature_definition_id || ':' || computation_version, ',' ORDER BY feature_definition_id) AS snapshot FROM f WHERE rn=1 GROUP BY report_id""")
def feature_snapshot(t: Tables) -> DataFrame:
    """Which version of each feature a score would use, as a map (shown here as text)."""
    snap = ve.latest_features(t.fx_features.filter("is_valid")).groupBy("report_id").agg(F.map_from_entries(F.collect_list(F.struct("feature_definition_id", "computation_version"))).alias("m"))
    text = F.array_join(F.transform(F.array_sort(F.map_keys("m")), lambda k: F.concat(k, F.lit(":"), F.col("m")[k].cast("string"))), ",")
    return snap.select("report_id", F.size("m").cast("long").alias("n"), text.alias("snapshot"))


@query(f"""WITH i AS (SELECT report_id, max(extraction_version) AS v FROM fx_line_items GROUP BY 1), f AS (SELECT report_id, max(computation_version) AS v FROM fx_features WHERE report_id NOT LIKE '%0' GROUP BY 1)
SELECT r.id AS report_id, i.v AS item_version, coalesce(f.v,0) AS feature_version FROM ({SUCCESSFUL}) r JOIN i ON i.report_id=r.id LEFT JOIN f ON f.report_id=r.id WHERE i.v>coalesce(f.v,0)""")
def pending_features(t: Tables) -> DataFrame:
    """Latest completed reports whose items are newer than their features."""
    items = t.fx_line_items.groupBy("report_id").agg(F.max("extraction_version").alias("item_version"))
    done = t.fx_features.filter("report_id NOT LIKE '%0'").groupBy("report_id").agg(F.max("computation_version").alias("v"))
    reports = ve.latest_successful_reports(t.fx_reports).select(F.col("id").alias("report_id"))
    return reports.join(items, "report_id").join(done, "report_id", "left").select("report_id", "item_version", F.coalesce("v", F.lit(0)).alias("feature_version")).filter("item_version > feature_version")


_CATALOG = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in (i, logic, top, bottom, ",".join(required))) + ")" for i, logic, top, bottom, required in catalog.FEATURES)
_SETS = ", ".join(f"('{s}','{f}',{i + 1})" for s, fs in catalog.FEATURE_SETS.items() for i, f in enumerate(fs))


@query(f"""SELECT d.*, m.feature_set_id, m.ordinal, coalesce(n.n,0) AS n_stored FROM (VALUES {_CATALOG}) d(id,computation_logic,formula_numerator,formula_denominator,required_tags) LEFT JOIN (VALUES {_SETS}) m(feature_set_id,id,ordinal) ON m.id=d.id
LEFT JOIN (SELECT feature_definition_id AS id, count(*) AS n FROM fx_features GROUP BY 1) n ON n.id=d.id""")
def feature_catalog(t: Tables) -> DataFrame:
    """All definitions with the sets that hold them and how many values of each are stored."""
    stored = t.fx_features.groupBy(F.col("feature_definition_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    rows = catalog.feature_catalog(t.spark).join(stored, "id", "left")
    return rows.select("id", "computation_logic", "formula_numerator", "formula_denominator", F.array_join("required_tags", ",").alias("required_tags"), "feature_set_id", "ordinal", F.coalesce("n", F.lit(0)).alias("n_stored"))

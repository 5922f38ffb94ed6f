"""Queries that apply the scalar functions to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.fixtures import AS_OF, Tables
from ledgerline.functions import catalog
from ledgerline.functions import scalars as sc
from ledgerline.plans.registry import query

_CODES = "CASE WHEN src%7=0 THEN ' sfjint (2) ' WHEN src%7=1 THEN 'SFJMAZ(1)' WHEN src%7=2 THEN 'SFZURZ' WHEN src%7=3 THEN '' WHEN src%7=4 THEN 'ABC1' ELSE schema_code END"
_ROOT = "CASE WHEN src%3=0 THEN 'JednostkaInnaWTysiacach' WHEN src%3=1 THEN 'JednostkaMalaWZlotych' ELSE 'Inna' END"
_KNOWN = "CASE code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in catalog.HEADER_CODES.items()) + " END"


def _coded(t: Tables) -> DataFrame:
    return t.fx_reports.select("id", sc.header_code(F.expr(_CODES)).alias("code"), F.expr(_ROOT).alias("root"))


@query("SELECT id, coalesce(TRY_CAST(replace(trim(raw),',','.') AS DOUBLE),0) AS amount FROM (SELECT id, CASE WHEN src%5=0 THEN ' '||CAST(src AS VARCHAR)||',5 ' WHEN src%5=1 THEN 'n/a' WHEN src%5=2 THEN NULL ELSE CAST(src AS VARCHAR) END AS raw FROM fx_reports) x")
def parse_amount(t: Tables) -> DataFrame:
    raw = F.expr("CASE WHEN src%5=0 THEN ' '||CAST(src AS STRING)||',5 ' WHEN src%5=1 THEN 'n/a' WHEN src%5=2 THEN NULL ELSE CAST(src AS STRING) END")
    return t.fx_reports.select("id", sc.parse_amount(raw).alias("amount"))


_CODE_SQL = f"(SELECT id, nullif(regexp_extract(upper(trim({_CODES})),'^([A-Z0-9]+)',1),'') AS code, {_ROOT} AS root FROM fx_reports) x"


@query(f"SELECT id, code FROM {_CODE_SQL}")
def header_code(t: Tables) -> DataFrame:
    return _coded(t).select("id", "code")


@query(f"SELECT id, CASE WHEN code LIKE '%T' THEN 1000 WHEN code LIKE '%Z' THEN 1 WHEN upper(root) LIKE '%WTYS%' THEN 1000 WHEN upper(root) LIKE '%WZLOT%' THEN 1 ELSE 7 END AS multiplier FROM {_CODE_SQL}")
def unit_multiplier(t: Tables) -> DataFrame:
    return _coded(t).select("id", sc.unit_multiplier(F.col("code"), F.col("root"), F.lit(7)).alias("multiplier"))


@query(f"SELECT id, coalesce({_KNOWN}, CASE WHEN root LIKE '%Mala%' THEN 'SFJMAZ' END, 'SFJINZ') AS schema_code FROM {_CODE_SQL}")
def detect_schema(t: Tables) -> DataFrame:
    return _coded(t).select("id", sc.detect_schema(F.col("code"), F.when(F.col("root").contains("Mala"), "SFJMAZ")).alias("schema_code"))


@query("SELECT i.report_id, i.extraction_version, i.tag_path, coalesce(a.label, b.label, i.tag_path) AS label FROM fx_line_items i LEFT JOIN (SELECT tag_path, 'full '||section AS label FROM fx_tags WHERE idx<8) a ON a.tag_path=i.tag_path LEFT JOIN (SELECT tag_path, 'raw '||section AS label FROM fx_tags WHERE idx<12 AND idx>9) b ON b.tag_path=i.tag_path")
def label_lookup(t: Tables) -> DataFrame:
    """label by full tag, by raw tag, else the tag itself; the label tables are small and fixed."""
    full = F.broadcast(t.fx_tags.filter("idx < 8").select("tag_path", F.concat(F.lit("full "), "section").alias("a")))
    raw = F.broadcast(t.fx_tags.filter("idx < 12 AND idx > 9").select("tag_path", F.concat(F.lit("raw "), "section").alias("b")))
    items = t.fx_line_items.select("report_id", "extraction_version", "tag_path")
    return items.join(full, "tag_path", "left").join(raw, "tag_path", "left").select("report_id", "extraction_version", "tag_path", F.coalesce("a", "b", "tag_path").alias("label"))


@query("SELECT p_partkey, left(CASE WHEN p_size%2=0 THEN '('||p_name||')' ELSE p_name END,1)='(' AS is_component FROM part")
def is_component(t: Tables) -> DataFrame:
    label = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("("), "p_name", F.lit(")"))).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", sc.is_component(label).alias("is_component"))


@query("SELECT CASE WHEN tag_path LIKE 'CF.%' THEN 'cash_flow' WHEN tag_path LIKE 'RZiS.%' THEN 'rzis' ELSE 'bilans' END AS section_name, count(*) AS n FROM fx_line_items GROUP BY 1")
def section_of_tag(t: Tables) -> DataFrame:
    return t.fx_line_items.groupBy(sc.section_of_tag(F.col("tag_path")).alias("section_name")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT document_id, TRY_CAST(substr(coalesce(CAST(okres_end AS VARCHAR),'none'),1,4) AS INT) AS fiscal_year, CASE WHEN okres_end IS NULL THEN 'invalid_period_end' END AS reason_code FROM fx_documents")
def fiscal_year(t: Tables) -> DataFrame:
    year = sc.fiscal_year(F.coalesce(F.col("okres_end").cast("string"), F.lit("none")))
    return t.fx_documents.select("document_id", year.alias("fiscal_year"), F.when(year.isNull(), "invalid_period_end").alias("reason_code"))


@query("SELECT id, krs||'|'||data_source_id||'|'||report_type||'|'||CAST(fiscal_year AS VARCHAR)||'|'||CAST(period_end AS VARCHAR) AS logical_key FROM fx_reports")
def logical_key(t: Tables) -> DataFrame:
    return t.fx_reports.select("id", sc.logical_key("krs", "data_source_id", "report_type", F.col("fiscal_year").cast("string"), F.col("period_end").cast("string")).alias("logical_key"))


@query("SELECT report_id, extraction_version, tag_path, CASE WHEN value_previous<>0 THEN round((value_current-value_previous)/abs(value_previous)*100,2) END AS pct FROM fx_line_items")
def pct_change(t: Tables) -> DataFrame:
    return t.fx_line_items.select("report_id", "extraction_version", "tag_path", sc.pct_change(F.col("value_current"), F.col("value_previous")).alias("pct"))


@query("SELECT report_id, version, CASE WHEN revenue<>0 THEN round(net/revenue*100,4) END AS share FROM fx_wide")
def share_of_parent(t: Tables) -> DataFrame:
    return t.fx_wide.select("report_id", "version", sc.share_of_parent(F.col("net"), F.col("revenue")).alias("share"))


@query("SELECT report_id, version, CASE WHEN abs(aktywa)>=0.000001 THEN round(net/aktywa,4) END AS ratio FROM fx_wide")
def ratio_eps(t: Tables) -> DataFrame:
    return t.fx_wide.select("report_id", "version", sc.ratio_eps(F.col("net"), F.col("aktywa")).alias("ratio"))


@query("SELECT report_id, version, CASE WHEN v IS NULL THEN NULL WHEN v>=10 THEN 'Zyskowna' WHEN v>=0 THEN 'Umiarkowana' ELSE 'Strata' END AS label FROM (SELECT report_id, version, net/nullif(revenue,0)*100 AS v FROM fx_wide) x")
def threshold_label(t: Tables) -> DataFrame:
    value = F.try_divide(F.col("net"), F.nullif("revenue", F.lit(0.0))) * 100
    return t.fx_wide.select("report_id", "version", sc.threshold_label(value, catalog.METRIC_LABELS["net_margin"]).alias("label"))


@query("SELECT id, array_to_string(list_distinct_ordered, ',') AS tags FROM (SELECT id, CASE WHEN src%2=0 THEN ['RZiS.L','Pasywa_B_III','Aktywa'] ELSE ['Aktywa'] END AS list_distinct_ordered FROM fx_reports) x")
def formula_tags(t: Tables) -> DataFrame:
    formula = F.when(F.col("src") % 2 == 0, "RZiS.L / (Pasywa_B_III + Aktywa) - RZiS.L").otherwise("Aktywa / 2")
    return t.fx_reports.select("id", F.array_join(sc.formula_tags(formula, F.array(F.lit("Aktywa"))), ",").alias("tags"))


@query("SELECT report_id, extraction_version, tag_path, CASE WHEN tag_path IN ('RZiS.A','RZiS.C','RZiS.F','RZiS.I','RZiS.L','CF.A_II_1','Pasywa_A') THEN true WHEN tag_path IN ('Pasywa_B','Aktywa_B_I') THEN false END AS higher_is_better FROM fx_line_items")
def tag_direction(t: Tables) -> DataFrame:
    return t.fx_line_items.select("report_id", "extraction_version", "tag_path", sc.tag_direction(F.col("tag_path")).alias("higher_is_better"))


@query("SELECT id, s.label, s.lo AS min_score, s.hi AS max_score, s.label=risk_category AS is_current FROM fx_predictions, (VALUES ('critical',NULL,0.0),('medium',0.0,1.0),('low',1.0,NULL)) s(label,lo,hi)")
def interpretation(t: Tables) -> DataFrame:
    steps = sc.interpretation(F.col("risk_category"), catalog.MODELS["poznanski_2004_v1"].cutoffs)
    return t.fx_predictions.select("id", F.explode(steps).alias("s")).select("id", "s.label", F.col("s.min").alias("min_score"), F.col("s.max").alias("max_score"), "s.is_current")


@query(f"SELECT document_id, CAST(floor((epoch(TIMESTAMP '{AS_OF}')-epoch(discovered_at))/86400) AS INT) AS days FROM fx_documents")
def freshness_days(t: Tables) -> DataFrame:
    return t.fx_documents.select("document_id", sc.freshness_days(F.col("discovered_at"), F.lit(AS_OF)).alias("days"))


@query("SELECT id, lpad(CAST(CAST(substr(CAST(period_end AS VARCHAR),1,4) AS INT)-1 AS VARCHAR),4,'0')||substr(CAST(period_end AS VARCHAR),5) AS prior_period FROM fx_reports")
def shift_period(t: Tables) -> DataFrame:
    return t.fx_reports.select("id", sc.shift_period(F.col("period_end").cast("string")).alias("prior_period"))


_CONCEPTS = ", ".join(f"('{c}','{s}','{tag}')" for c, of in catalog.CONCEPT_TAGS.items() for s, tag in of.items())


@query(f"SELECT r.id, k.concept, c.tag_path FROM fx_reports r CROSS JOIN (VALUES ('revenue'),('net_profit'),('current_assets')) k(concept) LEFT JOIN (VALUES {_CONCEPTS}) c(concept,schema_code,tag_path) ON c.concept=k.concept AND c.schema_code=r.schema_code")
def concept_tag(t: Tables) -> DataFrame:
    wanted = t.fx_reports.select("id", "schema_code", F.explode(F.array(*map(F.lit, ("revenue", "net_profit", "current_assets")))).alias("concept"))
    return wanted.join(F.broadcast(catalog.concept_table(t.spark)), ["concept", "schema_code"], "left").select("id", "concept", "tag_path")


@query("SELECT raw, CASE WHEN regexp_full_match(trim(raw),'[0-9]{1,10}') THEN lpad(trim(raw),10,'0') END AS krs FROM (SELECT CASE WHEN c_custkey%4=0 THEN ' '||CAST(c_custkey AS VARCHAR)||' ' WHEN c_custkey%4=1 THEN 'X'||CAST(c_custkey AS VARCHAR) WHEN c_custkey%4=2 THEN '12345678901' ELSE CAST(c_custkey AS VARCHAR) END AS raw FROM customer) x")
def normalize_key(t: Tables) -> DataFrame:
    raw = F.expr("CASE WHEN c_custkey%4=0 THEN ' '||CAST(c_custkey AS STRING)||' ' WHEN c_custkey%4=1 THEN 'X'||CAST(c_custkey AS STRING) WHEN c_custkey%4=2 THEN '12345678901' ELSE CAST(c_custkey AS STRING) END")
    return t.customer.select(raw.alias("raw"), sc.normalize_key(raw).alias("krs"))


@query("SELECT document_id, CASE WHEN n%4=0 THEN 'xml' WHEN n%4=1 THEN 'pdf' WHEN n%4=2 THEN 'other' ELSE 'unknown' END AS file_class FROM (SELECT document_id, CAST(substr(document_id,5) AS BIGINT) AS n FROM fx_downloads) x")
def file_type_class(t: Tables) -> DataFrame:
    n = F.substring("document_id", 5, 20).cast("long") % 4
    types = F.when(n == 0, "pdf, XML").when(n == 1, "other,pdf").when(n == 2, "unknown,other")
    return t.fx_downloads.select("document_id", sc.file_type_class(types).alias("file_class"))


@query("""SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR),10,'0') AS krs, c_name AS name, CASE WHEN c_custkey%3=0 THEN 'Seat' ELSE 'Town' END AS city,
CASE WHEN c_custkey%2=0 THEN make_date(2020,1+c_custkey%12,1+c_custkey%28) END AS registered_on FROM customer""")
def entity_from_json(t: Tables) -> DataFrame:
    """Registry JSON to entity columns; the seat's city, else the post's; invalid dates are null."""
    seat = F.when(F.col("c_custkey") % 3 == 0, F.lit("Seat"))
    day = F.when(F.col("c_custkey") % 2 == 0, F.date_format(F.make_date(F.lit(2020), (1 + F.col("c_custkey") % 12).cast("int"), (1 + F.col("c_custkey") % 28).cast("int")), "dd.MM.yyyy")).otherwise("31.02.2020")
    raw = t.customer.select("c_custkey", F.to_json(F.struct(F.col("c_custkey").cast("string").alias("numerKRS"), F.col("c_name").alias("nazwa"), F.struct(seat.alias("miejscowosc")).alias("siedziba"), F.struct(F.lit("Town").alias("miejscowosc")).alias("adres"), day.alias("dataRejestracji"))).alias("js"))
    got = raw.select("c_custkey", F.from_json("js", "numerKRS string, nazwa string, siedziba struct<miejscowosc string>, adres struct<miejscowosc string>, dataRejestracji string").alias("e"))
    return got.select("c_custkey", sc.normalize_key(F.col("e.numerKRS")).alias("krs"), F.col("e.nazwa").alias("name"), F.coalesce("e.siedziba.miejscowosc", "e.adres.miejscowosc").alias("city"), F.expr("try_to_date(e.dataRejestracji, 'dd.MM.yyyy')").alias("registered_on"))

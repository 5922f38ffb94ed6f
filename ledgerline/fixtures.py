"""Domain tables derived from the driver tables, in SQL that Spark and DuckDB both take."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-31 00:00:00"

FIXTURES = {
    "fx_tags": """SELECT * FROM (VALUES (0,'Aktywa','Bilans'),(1,'Aktywa_B','Bilans'),(2,'Aktywa_B_I','Bilans'),
 (3,'Aktywa_B_II','Bilans'),(4,'Aktywa_B_III','Bilans'),(5,'Pasywa_A','Bilans'),(6,'Pasywa_B','Bilans'),
 (7,'Pasywa_B_II','Bilans'),(8,'Pasywa_B_III','Bilans'),(9,'RZiS.A','RZiS'),(10,'RZiS.B','RZiS'),
 (11,'RZiS.C','RZiS'),(12,'RZiS.F','RZiS'),(13,'RZiS.I','RZiS'),(14,'RZiS.L','RZiS'),
 (15,'RZiS.N','RZiS'),(16,'CF.A_II_1','CF')) AS t(idx, tag_path, section)""",
    "fx_reports": """SELECT concat('rpt-', CAST(o_orderkey AS VARCHAR(20))) AS id,
 concat_ws('|', lpad(CAST(o_custkey AS VARCHAR(20)),10,'0'),'KRS','annual',
   CAST(year(o_orderdate) AS VARCHAR(20)), concat(CAST(year(o_orderdate) AS VARCHAR(20)),'-12-31')) AS logical_key,
 CAST(row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate, o_orderkey) AS INT) AS report_version,
 lpad(CAST(o_custkey AS VARCHAR(20)),10,'0') AS krs, 'KRS' AS data_source_id, 'annual' AS report_type,
 CAST(year(o_orderdate) AS INT) AS fiscal_year, make_date(year(o_orderdate),1,1) AS period_start,
 make_date(year(o_orderdate),12,31) AS period_end, concat('doc-', CAST(o_orderkey AS VARCHAR(20))) AS source_document_id,
 CASE WHEN o_orderstatus='P' THEN 'failed' ELSE 'completed' END AS ingestion_status,
 CASE WHEN o_orderkey%15=0 THEN 'SFJMIZ' WHEN o_orderkey%16=0 THEN 'SFZURT' ELSE 'SFJINZ' END AS schema_code,
 o_orderdate AS created_at, o_orderkey AS src FROM orders""",
    "fx_line_items": """SELECT r.id AS report_id, t.section, t.tag_path, v.extraction_version, r.schema_code,
 CASE WHEN (r.src*3+t.idx)%53=0 THEN CAST(0 AS DOUBLE)
      WHEN t.idx BETWEEN 11 AND 15 THEN (((r.src*7+t.idx*13)%97)-30)*CAST(1000 AS DOUBLE)*v.extraction_version
      ELSE (((r.src*7+t.idx*13)%97)+1)*CAST(1000 AS DOUBLE)*v.extraction_version END AS value_current,
 (((r.src*5+t.idx*11)%89)+1)*CAST(1000 AS DOUBLE) AS value_previous
FROM fx_reports r CROSS JOIN fx_tags t CROSS JOIN (VALUES (1),(2)) AS v(extraction_version)
WHERE (r.src+t.idx)%11<>0 AND (v.extraction_version=1 OR r.src%10=0)""",
    "fx_companies": """SELECT lpad(CAST(c_custkey AS VARCHAR(20)),10,'0') AS krs, c_name AS name, c_mktsegment AS legal_form,
 c_custkey%17<>0 AS is_active, CASE WHEN c_custkey%5=0 THEN 'rdf_batch' ELSE 'ms_gov' END AS source,
 make_date(2023,1,1)+CAST(c_custkey%365 AS INT) AS first_seen_on,
 CASE WHEN c_custkey%7=0 THEN NULL ELSE make_date(2023,12,1)+CAST(c_custkey%60 AS INT) END AS last_checked_on,
 CAST(c_custkey%4 AS INT) AS check_priority, CAST(CASE WHEN c_custkey%11=0 THEN 6 ELSE c_custkey%3 END AS INT) AS check_error_count,
 CAST(c_custkey%40 AS BIGINT) AS total_documents, CAST(c_custkey%40 - c_custkey%4 AS BIGINT) AS total_downloaded FROM customer""",
    "fx_companies_extra": """SELECT lpad(CAST(c_custkey AS VARCHAR(20)),10,'0') AS krs, concat('7',lpad(CAST(c_custkey AS VARCHAR(20)),9,'0')) AS nip,
 concat(CAST(c_nationkey AS VARCHAR(20)),'.01.Z') AS pkd_code, make_date(1980+CAST(c_custkey%20 AS INT),6,1) AS incorporation_date
FROM customer WHERE c_custkey%3<>0""",
    "fx_documents": """SELECT concat('doc-', CAST(o_orderkey AS VARCHAR(20))) AS document_id, lpad(CAST(o_custkey AS VARCHAR(20)),10,'0') AS krs,
 CAST(CASE substr(o_orderpriority,1,1) WHEN '1' THEN 18 WHEN '2' THEN 18 WHEN '3' THEN 3 WHEN '4' THEN 19 ELSE 20 END AS INT) AS rodzaj,
 CASE WHEN o_orderkey%31=0 THEN NULL ELSE make_date(year(o_orderdate),12,31) END AS okres_end,
 o_orderkey%19=0 AS is_ifrs, o_orderkey%9=0 AS is_correction, o_orderkey%23=0 AS is_deleted, o_orderdate AS discovered_at FROM orders""",
    "fx_downloads": """SELECT concat('doc-', CAST(o_orderkey AS VARCHAR(20))) AS document_id, o_orderkey%4<>0 AS is_downloaded,
 CASE o_orderkey%5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'other' WHEN 2 THEN 'unknown' ELSE 'xml' END AS file_type,
 CASE WHEN o_orderkey%29=0 THEN 'download_failed' END AS download_error,
 CASE WHEN o_orderkey%6=0 THEN NULL ELSE o_orderdate END AS metadata_fetched_at FROM orders WHERE o_orderkey%13<>0""",
    "fx_bankruptcy_events": """SELECT concat('ev-', CAST(c_custkey AS VARCHAR(20))) AS id, lpad(CAST(c_custkey AS VARCHAR(20)),10,'0') AS krs,
 CASE c_custkey%4 WHEN 0 THEN 'bankruptcy' WHEN 1 THEN 'restructuring' WHEN 2 THEN 'liquidation' ELSE 'deregistration' END AS event_type,
 make_date(1996+CAST(c_custkey%6 AS INT),1+CAST(c_custkey%12 AS INT),15) AS event_date, c_custkey%3=0 AS is_confirmed
FROM customer WHERE c_custkey%8 IN (0,2,5)""",
    "fx_activity": """SELECT event_id AS id, user_id, event_type AS action, ts AS created_at,
 CASE WHEN event_id%9=0 THEN NULL ELSE lpad(CAST((user_id*7)%150 AS VARCHAR(20)),10,'0') END AS krs_number FROM events""",
    "fx_auth_events": "SELECT event_id, user_id AS auth_key, ts, event_type='error' AS is_failure FROM events WHERE event_type IN ('error','purchase')",
    "fx_api_calls": """SELECT event_id, concat('src', CAST(event_id%3 AS VARCHAR(20))) AS source, CAST(floor(value*10) AS INT) AS latency_ms,
 event_id%4=0 AS cached, CASE WHEN event_type='error' THEN 'http_500' END AS error, ts FROM events""",
    # Ours: statement nodes, stored features, models, predictions, users and grants.
    "fx_nodes": """SELECT n.report_id AS doc_id, n.section, n.tag_path AS tag, CAST(t.idx AS INT) AS ord, n.value_current AS kwota_a, n.value_previous AS kwota_b,
 p.tag_path AS parent_tag FROM (SELECT *, CASE WHEN strpos(tag_path,'_')>0 THEN substr(tag_path,1,length(tag_path)-strpos(reverse(tag_path),'_')) END AS up
  FROM fx_line_items WHERE extraction_version=1) n JOIN fx_tags t ON t.tag_path=n.tag_path
 LEFT JOIN (SELECT report_id, section, tag_path FROM fx_line_items WHERE extraction_version=1) p ON p.report_id=n.report_id AND p.section=n.section AND p.tag_path=n.up""",
    "fx_tree": """SELECT doc_id, section, tag, ord, kwota_a, kwota_b, CAST(CASE WHEN up='Aktywa' AND has_a=1 THEN 0 WHEN up='Aktywa_B' AND has_ab=1 THEN 1 WHEN up='Pasywa_B' AND has_pb=1 THEN 6 END AS INT) AS parent_ord,
 CAST(CASE WHEN up='Aktywa' THEN has_a WHEN up='Aktywa_B' THEN has_ab*(1+has_a) WHEN up='Pasywa_B' THEN has_pb ELSE 0 END AS INT) AS depth
FROM (SELECT l.report_id AS doc_id, l.section, l.tag_path AS tag, CAST(t.idx AS INT) AS ord, l.value_current AS kwota_a, l.value_previous AS kwota_b,
  CASE WHEN t.idx=1 THEN 'Aktywa' WHEN t.idx BETWEEN 2 AND 4 THEN 'Aktywa_B' WHEN t.idx BETWEEN 7 AND 8 THEN 'Pasywa_B' END AS up,
  MAX(CASE WHEN t.idx=0 THEN 1 ELSE 0 END) OVER (PARTITION BY l.report_id) AS has_a, MAX(CASE WHEN t.idx=1 THEN 1 ELSE 0 END) OVER (PARTITION BY l.report_id) AS has_ab,
  MAX(CASE WHEN t.idx=6 THEN 1 ELSE 0 END) OVER (PARTITION BY l.report_id) AS has_pb
 FROM fx_line_items l JOIN fx_tags t ON t.tag_path=l.tag_path WHERE l.extraction_version=1) x""",
    "fx_wide": """SELECT report_id, CAST(extraction_version AS INT) AS version, MAX(CASE WHEN tag_path='Aktywa' THEN value_current END) AS aktywa,
 MAX(CASE WHEN tag_path='Aktywa_B' THEN value_current END) AS aktywa_b, MAX(CASE WHEN tag_path='Pasywa_A' THEN value_current END) AS pasywa_a,
 MAX(CASE WHEN tag_path='Pasywa_B' THEN value_current END) AS pasywa_b, MAX(CASE WHEN tag_path='RZiS.A' THEN value_current END) AS revenue,
 MAX(CASE WHEN tag_path='RZiS.L' THEN value_current END) AS net FROM fx_line_items GROUP BY report_id, extraction_version""",
    "fx_features": """SELECT w.report_id, d.feature_id AS feature_definition_id, w.version AS computation_version,
 CASE d.feature_id WHEN 'roa' THEN w.net/nullif(w.aktywa,0) WHEN 'roe' THEN w.net/nullif(w.pasywa_a,0) WHEN 'ros' THEN w.net/nullif(w.revenue,0)
  WHEN 'debt_ratio' THEN w.pasywa_b/nullif(w.aktywa,0) ELSE w.revenue/nullif(w.aktywa,0) END AS value,
 CASE d.feature_id WHEN 'roa' THEN w.net/nullif(w.aktywa,0) WHEN 'roe' THEN w.net/nullif(w.pasywa_a,0) WHEN 'ros' THEN w.net/nullif(w.revenue,0)
  WHEN 'debt_ratio' THEN w.pasywa_b/nullif(w.aktywa,0) ELSE w.revenue/nullif(w.aktywa,0) END IS NOT NULL AS is_valid,
 CASE WHEN w.version=1 THEN r.created_at + INTERVAL 1 DAY ELSE r.created_at + INTERVAL 30 DAY END AS computed_at
FROM fx_wide w JOIN fx_reports r ON r.id=w.report_id CROSS JOIN (VALUES ('roa'),('roe'),('ros'),('debt_ratio'),('asset_turnover')) AS d(feature_id)""",
    "fx_models": """SELECT * FROM (VALUES (0,'maczynska_1994_v1','maczynska','1.0',true,true,CAST(2.0 AS DOUBLE)),(1,'poznanski_2004_v1','poznanski','1.0',true,true,CAST(3.0 AS DOUBLE)),
 (2,'trial_v1','trial','0.1',false,true,CAST(5.0 AS DOUBLE)),(3,'retired_v1','retired','0.9',false,false,CAST(7.0 AS DOUBLE))) AS m(idx, id, name, version, is_baseline, is_active, weight)""",
    "fx_predictions": """SELECT concat('pr-', CAST(r.src AS VARCHAR(20)), '-', m.id, '-', CAST(f.computation_version AS VARCHAR(20))) AS id,
 concat('run-', m.id, '-', CAST(f.computation_version AS VARCHAR(20))) AS run_id, m.id AS model_id, r.id AS report_id, f.value*m.weight AS raw_score,
 CASE WHEN f.value*m.weight<0 THEN 'critical' WHEN f.value*m.weight<1 THEN 'medium' ELSE 'low' END AS risk_category,
 CASE WHEN r.src%7=0 THEN NULL ELSE f.computed_at + INTERVAL 2 DAY END AS scored_at, f.computation_version AS snapshot_version
FROM fx_features f JOIN fx_reports r ON r.id=f.report_id CROSS JOIN fx_models m
WHERE f.feature_definition_id='roa' AND f.value IS NOT NULL AND r.ingestion_status='completed' AND (r.src+m.idx)%3<>0""",
    "fx_users": """SELECT DISTINCT user_id AS id, concat('user', CAST(user_id AS VARCHAR(20)), '@example.com') AS email, user_id%10<>0 AS is_active,
 user_id%25=0 AS is_admin, user_id%25=0 AS has_full_access FROM events""",
    "fx_grants": "SELECT DISTINCT user_id, lpad(CAST((user_id*7)%150 AS VARCHAR(20)),10,'0') AS krs FROM events WHERE user_id%3=0",
}


def needed(sql: str) -> list[str]:
    """The fixtures that sql uses, each after those that it is made of."""
    found: list[str] = []
    for name in dict.fromkeys(re.findall(r"\bfx_\w+", sql)):
        if name in FIXTURES:
            for inner in [*needed(FIXTURES[name]), name]:
                if inner not in found:
                    found.append(inner)
    return found


def with_fixtures(sql: str) -> str:
    """sql for DuckDB with the fixtures that it uses in front."""
    views = ", ".join(f"{n} AS ({FIXTURES[n]})" for n in needed(sql))
    if not views:
        return sql
    sql = sql.strip()
    return f"WITH {views}, {sql[5:]}" if sql[:5].upper() == "WITH " else f"WITH {views} {sql}"


class Tables:
    """Driver tables and fixtures of one folder as DataFrames, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in FIXTURES:
            sql = FIXTURES[name]
            for inner in set(re.findall(r"\b(?:fx_\w+|orders|customer|events|part|lineitem)\b", sql)):
                if inner in FIXTURES or re.search(rf"(?i)(?:from|join)\s+{inner}\b", sql):
                    getattr(self, inner).createOrReplaceTempView(inner)
            found = self.spark.sql(re.sub(r"strpos\(", "instr(", sql))  # Spark's name for it
        else:
            found = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        self.__dict__[name] = found
        return found

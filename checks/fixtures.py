"""Operator inputs derived from the driver's tables, as SQL both engines run.

Spark text; ``duckdb_sql`` swaps the type name. All of them read whole tables,
so their size follows the scale factor. CASE ... % n varies the values of rows,
it never drops rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.spec import RecordSpec

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
#: Tables whose rows are dealt out, and by what: lineitem by the key that its joins use.
SPREAD = {"pages": [], "documents": [], "conversations": [], "lineitem": ["l_orderkey"]}
DEALT_BYTES = 8 << 20

SQL: dict[str, str] = {}

SQL["fx_targets"] = """
SELECT c_custkey AS target_id,
 CASE c_custkey % 6 WHEN 0 THEN '  ' || n_name WHEN 1 THEN n_name || ' '
  WHEN 2 THEN CASE WHEN c_custkey % 50 = 2 THEN '   ' ELSE n_name END ELSE n_name END AS university_name,
 CASE c_custkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN 'None'
  ELSE c_mktsegment || ' ' || CAST(c_custkey AS STRING) END AS department_name,
 CASE c_custkey % 4 WHEN 0 THEN ' https://' || lower(replace(n_name, '_', '-')) || '.example.edu/' || lower(c_mktsegment)
  WHEN 1 THEN 'nan' WHEN 2 THEN 'ftp://x' ELSE NULL END AS link,
 CASE (c_custkey + c_nationkey) % 8 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'completed' WHEN 3 THEN 'Skipped'
  WHEN 4 THEN 'failed: LLM returned non-JSON response' WHEN 5 THEN ' NaN '
  WHEN 6 THEN 'url-found' ELSE 'Completed' END AS status
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""

SQL["fx_updates"] = """
SELECT o_orderkey AS seq, n_name AS university,
 CASE WHEN c_custkey % 9 < 3 THEN NULL ELSE c_mktsegment || ' ' || CAST(c_custkey AS STRING) END AS department,
 CASE o_orderstatus WHEN 'O' THEN 'completed' WHEN 'F' THEN 'failed: timeout' ELSE 'Skipped' END AS status,
 CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN NULL
  ELSE 'https://found.example.edu/' || CAST(o_orderkey AS STRING) END AS link
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""

SQL["fx_records"] = """
SELECT c_custkey AS ord, n_name AS university, c_mktsegment AS department,
 CASE c_custkey % 3 WHEN 0 THEN 'Ann ' || c_name WHEN 1 THEN c_name || ' von Berg' ELSE c_name END AS full_name,
 CASE c_custkey % 4 WHEN 0 THEN 'Prof.' WHEN 1 THEN 'Dr.' WHEN 2 THEN '' ELSE NULL END AS title,
 CASE c_custkey % 5 WHEN 0 THEN 'Professor' WHEN 1 THEN 'Associate Professor'
  WHEN 2 THEN CASE c_custkey % 3 WHEN 0 THEN 'Professor of Finance' WHEN 1 THEN 'HR Director' ELSE 'Postdoctoral Fellow' END
  WHEN 3 THEN CASE c_custkey % 4 WHEN 0 THEN 'Lecturers in HR and Finance' ELSE 'Senior Lecturer' END
  ELSE CASE c_custkey % 4 WHEN 0 THEN 'Finance Officer, Dean for IT support' ELSE 'Teaching Assistant' END END AS position,
 CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 11 = 1 THEN ''
  WHEN c_custkey % 11 = 2 THEN 'not-an-email'
  ELSE 'u' || CAST(c_custkey % 13 AS STRING) || '@' || lower(replace(n_name, '_', '-')) || '.edu' END AS email,
 CASE c_custkey % 7 WHEN 0 THEN 'www.example.org' WHEN 1 THEN 'HTTP://example.org/' || CAST(c_custkey AS STRING)
  WHEN 2 THEN NULL ELSE '' END AS homepage,
 CASE c_custkey % 5 WHEN 0 THEN '王' || CAST(c_custkey AS STRING) WHEN 1 THEN 'Wang' WHEN 2 THEN NULL ELSE '' END AS local_name,
 CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE ' Dept of ' || c_mktsegment END AS department_name,
 CASE c_custkey % 6 WHEN 0 THEN 'first issue' WHEN 1 THEN '' ELSE NULL END AS remark,
 'https://' || lower(replace(n_name, '_', '-')) || '.example.edu/' || lower(c_mktsegment) AS listing_url,
 CASE WHEN c_custkey % 9 = 0 THEN NULL
  ELSE 'https://people.example.edu/' || CAST(c_custkey AS STRING) END AS profile_url
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""

SQL["fx_details"] = """
SELECT 'https://people.example.edu/' || CAST(c_custkey AS STRING) AS profile_url,
 n_name AS university, c_mktsegment AS department,
 c_custkey % 10 = 3 AS blocked, c_custkey % 10 = 4 AS failed,
 CASE c_custkey % 3 WHEN 0 THEN 'Dr.' WHEN 1 THEN '' ELSE NULL END AS title,
 CASE c_custkey % 4 WHEN 0 THEN NULL ELSE 'd' || CAST(c_custkey AS STRING) || '@detail.edu' END AS email,
 'https://home.example.org/' || CAST(c_custkey AS STRING) AS homepage
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""

SQL["fx_detail_responses"] = """
SELECT p_partkey, 'https://people.example.edu/' || CAST(p_partkey AS STRING) AS profile_url,
 CASE p_partkey % 7 WHEN 0 THEN 'no data' WHEN 1 THEN '{"error": "not a profile", "email": "x"}'
  WHEN 2 THEN '{"title": ["Dr.", "", null, "' || p_name || '"], "email": null}'
  WHEN 3 THEN 'ok {"title": {"k":"' || p_brand || '"}, "position": true, "error": null}'
  WHEN 4 THEN '{"title": "[' || p_name || ']", "position": ' || CAST(p_size AS STRING) || '}'
  WHEN 5 THEN '{"title": "a"} and {"title": "b"}'
  ELSE '{"email": "' || lower(p_type) || '@x.edu", "title": "", "position": []}' END AS response
FROM part
"""

SQL["fx_snapshots"] = """
SELECT url, CAST(1 AS BIGINT) AS run_no, html FROM pages
UNION ALL
SELECT CASE page_id % 10 WHEN 9 THEN url || '/moved' ELSE url END AS url, CAST(2 AS BIGINT) AS run_no,
 CASE page_id % 4 WHEN 0 THEN html
 WHEN 1 THEN replace(replace(html, 'class="ad"', 'class="ad-17"'), 'track(', 'track(9')
 WHEN 2 THEN replace(html, '</article>', '<p>new entry</p></article>')
 ELSE replace(html, '<ul>', '<ul id="x9">') END AS html
FROM pages
"""

SQL["fx_page_kinds"] = """
SELECT url, CAST(page_id % 12 AS BIGINT) AS run_no, CASE page_id % 12
 WHEN 0 THEN replace(html, '</article>', '<ul><li>Prof. Ann Lee, +1 555 403 1234</li><li>Dr. Bo Day, +1 555 403 1235</li></ul></article>')
 WHEN 1 THEN replace(html, '</article>', '<p>Parking is forbidden. It takes just a moment.</p></article>')
 WHEN 2 THEN regexp_replace(html, '<title>', '<title>403 Forbidden ')
 WHEN 3 THEN regexp_replace(html, '<h1>', '<H1 class="x">Just a Moment ')
 WHEN 4 THEN concat('<html><body><p>Access FORBIDDEN</p><script>', repeat('var a = "403";', 100), '</script></body></html>')
 WHEN 5 THEN concat('<html><body><p>Welcome</p><script>', repeat('var a = "forbidden 403";', 100), '</script></body></html>')
 WHEN 6 THEN replace(html, '</article>', '<pre><code>{{ name }}</code></pre><p>Use <code>v-bind</code> or <textarea rows="2">ng-app</textarea></p></article>')
 WHEN 7 THEN replace(html, '</article>', '<div>{{ name }}</div></article>')
 WHEN 8 THEN replace(html, '</article>', '<pre>{{ name }}</pre><script>fetch("/api/staff")</script></article>')
 WHEN 9 THEN concat(html, '<i>cf-browser-verification</i>')
 WHEN 10 THEN concat('<p>', repeat('lorem ', 59), 'forbidden</p>', repeat(' ', 1000))
 ELSE concat('<p>', repeat('lorem ', 60), 'forbidden</p>', repeat(' ', 1000)) END AS html
FROM pages
"""

SQL["fx_links"] = """
SELECT 'https://d/r' || CAST(n_regionkey AS STRING) AS src, 'https://d/n' || CAST(n_nationkey AS STRING) AS dst,
 'child' AS kind, CAST(n_nationkey AS BIGINT) AS pos FROM nation
UNION ALL
SELECT 'https://d/n' || CAST(n_nationkey AS STRING), 'https://d/n' || CAST(following AS STRING), 'next', CAST(0 AS BIGINT)
FROM (SELECT n_nationkey, lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS following FROM nation) t
WHERE following IS NOT NULL
UNION ALL
SELECT 'https://d/n' || CAST(c_nationkey AS STRING), 'https://d/c' || CAST(c_custkey AS STRING), 'child', c_custkey FROM customer
UNION ALL
SELECT 'https://d/c' || CAST(c_custkey AS STRING), 'https://d/c' || CAST(following AS STRING), 'next', CAST(0 AS BIGINT)
FROM (SELECT c_custkey, lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS following FROM customer) t
WHERE following IS NOT NULL
UNION ALL
SELECT 'https://d/c' || CAST(c_custkey AS STRING), 'https://d/r' || CAST(c_custkey % 5 AS STRING), 'child', CAST(0 AS BIGINT) FROM customer
"""

SQL["fx_sightings"] = """
SELECT CAST((year(o_orderdate) - 1995) * 2 + (CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 2 END) AS BIGINT) AS run_no,
 n_name AS university, c_mktsegment AS department, c_custkey AS rec_key
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""

SQL["fx_responses"] = """
SELECT page_id, url, CASE page_id % 6
 WHEN 0 THEN 'Sorry, I cannot parse this.'
 WHEN 1 THEN '{"records":[{"field_1": broken' || url
 WHEN 2 THEN '{"records":[],"error":"Cloudflare challenge","next_page_url":"","child_page_urls":[]}'
 ELSE 'Here you go: {"static_values":{"field_4":"Unit ' || CAST(page_id AS STRING)
  || '"},"records":[{"field_1":"Prof","field_2":"P' || CAST(page_id AS STRING)
  || '","field_3":null,"profile_url":"' || url || '"},{"title":"Dr","title_x":"n","field_2":"Q' || CAST(page_id AS STRING)
  || '","field_3":"","Email":"kept@x.edu"}],"error":null,"next_page_url":" https://d/' || CAST(page_id + 1 AS STRING)
  || ' ","child_page_urls":' || CASE WHEN page_id % 2 = 0 THEN 'null' ELSE '["https://d/a","/rel"]' END || '} thanks' END AS response
FROM pages
"""



def _run_responses(run_no: int, kind: str) -> str:
    """Responses of one run: of kinds 0 to 2 all fail. Even pages name no further page."""
    return f"""
SELECT CAST({run_no} AS BIGINT) AS run_no, page_id, url, CASE {kind}
 WHEN 0 THEN 'Sorry, I cannot parse this.'
 WHEN 1 THEN '{{"records":[{{"field_1": broken' || url
 WHEN 2 THEN '{{"records":[],"error":"Cloudflare challenge","next_page_url":"","child_page_urls":[]}}'
 ELSE 'Run {run_no}: {{"static_values":{{"field_4":"Unit {run_no}"}},"records":[{{"field_1":"Prof","field_2":"P' || CAST(page_id AS STRING)
  || '.{run_no}","field_3":null,"profile_url":"' || url || '"}},{{"title":"Dr","field_2":"Q' || CAST(page_id AS STRING)
  || '","Email":"kept@x.edu"}}],"error":null,"next_page_url":"' || CASE page_id % 2 WHEN 0 THEN '' ELSE 'https://d/none' END
  || '","child_page_urls":null}}' END AS response
FROM pages"""


SQL["fx_run_responses"] = "\nUNION ALL".join(
    [_run_responses(1, "page_id % 6"), _run_responses(2, "(page_id + 1) % 6"), _run_responses(3, "3")]
)

SQL["fx_hits"] = """
SELECT l_orderkey AS query_id, o_custkey AS target_id, o_orderkey % 5 AS query_no, CAST(l_linenumber AS BIGINT) AS rank,
 lower(replace(n_name, '_', '-')) || '.edu' AS domain, lower(c_mktsegment) AS department,
 CASE l_suppkey % 7 WHEN 0 THEN 'https://www.linkedin.com/in/' || CAST(l_partkey AS STRING)
  WHEN 1 THEN 'https://phoenix.com/people/' || CAST(l_partkey AS STRING)
  WHEN 2 THEN 'https://' || lower(replace(n_name, '_', '-')) || '.edu/'
  WHEN 3 THEN 'https://' || lower(c_mktsegment) || '.' || lower(replace(n_name, '_', '-')) || '.edu/people?p=' || CAST(l_partkey % 50 AS STRING)
  WHEN 4 THEN 'https://www.' || lower(replace(n_name, '_', '-')) || '.edu/staff/'
  WHEN 5 THEN 'https://x.com/' || lower(replace(n_name, '_', '-')) || '.edu/faculty'
  ELSE 'https://' || lower(replace(n_name, '_', '-')) || '.edu/news/' || CAST(l_partkey AS STRING) END AS url
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
 JOIN nation ON c_nationkey = n_nationkey
"""

SQL["fx_page_results"] = """
SELECT o_custkey AS target_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS page_no,
 o_orderkey % 40 AS n_records,
 CASE o_orderkey % 11 WHEN 0 THEN 'Cloudflare challenge' WHEN 1 THEN '' ELSE NULL END AS page_error,
 o_custkey % 13 = 0 AS skipped,
 CASE WHEN o_custkey % 17 = 0 THEN repeat('timeout ', 20) || CAST(o_custkey AS STRING) ELSE NULL END AS exception
FROM orders
"""

SQL["fx_job_events"] = """
SELECT user_id AS job_id, event_id AS seq, ts,
 CASE event_type WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'pending' END AS status,
 CASE event_type WHEN 'error' THEN 'E' || CAST(event_id AS STRING) ELSE NULL END AS error,
 CASE event_id % 3 WHEN 0 THEN 'https://jobs.example.edu/' || CAST(event_id AS STRING) ELSE NULL END AS listing_url
FROM events
"""

SQL["fx_run_events"] = """
SELECT event_id AS run_id, ts AS started_at, CAST(NULL AS TIMESTAMP) AS finished_at,
 CAST(NULL AS BIGINT) AS total_jobs, CAST(NULL AS BIGINT) AS successful, CAST(NULL AS BIGINT) AS failed FROM events
UNION ALL
SELECT event_id, CAST(NULL AS TIMESTAMP), CASE event_type WHEN 'error' THEN NULL ELSE ts END,
 CASE event_type WHEN 'error' THEN NULL ELSE user_id + 2 END, user_id, CAST(2 AS BIGINT) FROM events
"""
SQL["fx_stored"] = """
SELECT 'r' || CAST(c_custkey AS STRING) AS record_id, n_name AS university, c_mktsegment AS department,
 CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS first_seen, CAST('2024-02-01 00:00:00' AS TIMESTAMP) AS last_seen,
 CASE c_custkey % 5 WHEN 0 THEN 'not_found' ELSE 'active' END AS status,
 CASE c_custkey % 5 WHEN 0 THEN c_custkey % 3 + 1 ELSE 0 END AS runs_not_found,
 c_name AS data,
 CASE c_custkey % 2 WHEN 0 THEN 'https://people.example.edu/' || CAST(c_custkey AS STRING) ELSE NULL END AS profile_url
FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL
SELECT 's' || CAST(s_suppkey AS STRING), n_name, CASE s_suppkey % 3 WHEN 0 THEN 'NEVER SCRAPED' ELSE 'FURNITURE' END,
 CAST('2024-01-01 00:00:00' AS TIMESTAMP), CAST('2024-02-01 00:00:00' AS TIMESTAMP),
 CASE s_suppkey % 2 WHEN 0 THEN 'not_found' ELSE 'active' END, CASE s_suppkey % 2 WHEN 0 THEN s_suppkey % 3 + 1 ELSE 0 END,
 s_name, NULL
FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""

SQL["fx_seen"] = """
SELECT CASE o_orderkey % 20 WHEN 0 THEN 'new' || CAST(c_custkey AS STRING) ELSE 'r' || CAST(c_custkey AS STRING) END AS record_id,
 n_name AS university, c_mktsegment AS department, o_orderkey AS ord,
 c_name || ' / ' || o_orderpriority AS data,
 CASE o_orderkey % 3 WHEN 0 THEN 'https://new.example.edu/' || CAST(o_orderkey AS STRING) ELSE NULL END AS profile_url
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""

SQL["fx_archive"] = """
SELECT CASE WHEN c_acctbal < 3000 THEN 'r' ELSE 's' END || CAST(c_custkey AS STRING) AS record_id,
 n_name AS university, c_mktsegment AS department, CAST('2023-01-01 00:00:00' AS TIMESTAMP) AS first_seen, CAST('2023-06-01 00:00:00' AS TIMESTAMP) AS last_seen,
 'old ' || c_name AS data, CAST('2023-07-01 00:00:00' AS TIMESTAMP) AS archived_at
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""

SQL["fx_departments"] = """
SELECT p_partkey AS ord, p_brand AS university,
 CASE p_partkey % 6 WHEN 0 THEN 'Department of ' || p_name WHEN 1 THEN p_name || ', Department of'
  WHEN 2 THEN '  ' || upper(p_name) WHEN 3 THEN 'School of ' || p_name WHEN 4 THEN 'Applied ' || p_name
  ELSE CASE p_size % 6 WHEN 0 THEN 'Finance' WHEN 1 THEN 'University Library' WHEN 2 THEN ' ' WHEN 3 THEN NULL
   WHEN 4 THEN 'Centre for ' || p_name ELSE p_name END END AS name
FROM part
"""

SQL["fx_unit_names"] = """
SELECT p_brand AS university, CASE p_partkey % 5 WHEN 0 THEN 'Applied ' || p_name || ' studies ' || CAST(p_size AS STRING)
 WHEN 1 THEN p_name || ' studies ' || CAST(p_size AS STRING) || ', Department of' WHEN 2 THEN upper(p_name) || '  Study ' || CAST(p_size AS STRING)
 WHEN 3 THEN CASE WHEN p_size % 9 = 0 THEN NULL WHEN p_size % 9 = 1 THEN ' ' ELSE 'School of ' || p_name || ' & ' || CAST(p_size AS STRING) END
 ELSE p_name || ' studies ' || CAST(p_size AS STRING) END AS name
FROM part
"""

SQL["fx_department_lists"] = """
SELECT p_partkey AS ord, p_brand AS university,
 CASE p_partkey % 5 WHEN 0 THEN 'nothing found' WHEN 1 THEN '{"departments": [broken'
  WHEN 2 THEN 'Found: {"departments": ["Department of ' || p_name || '", " ' || p_name || ' ", "Finance"], "next_page_url": ""}'
  WHEN 3 THEN '{"departments": null}'
  ELSE '{"departments": ["' || upper(p_name) || '", "' || p_type || ' ' || CAST(p_size AS STRING) || ', School of", ""]}' END AS response
FROM part
"""

SQL["fx_contacts"] = """
SELECT doc_id, text || CASE doc_id % 5 WHEN 0 THEN ' contact: u' || CAST(doc_id AS STRING) || ' [at] ' || lang || '.example.edu'
 WHEN 1 THEN ' mailto:U' || CAST(doc_id AS STRING) || '@x.edu, U' || CAST(doc_id AS STRING) || '@x.edu'
 WHEN 2 THEN ' v' || CAST(doc_id AS STRING) || '[@]' || source || '.example.org.' ELSE ' no contact' END AS text
FROM documents
"""

SQL["fx_answers"] = """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'NONE' WHEN 1 THEN 'The best page is ' || url || '.'
 WHEN 2 THEN '(see ' || url || ').' ELSE url || ' and https://other.example.org/x' END AS answer
FROM pages
"""

SQL["fx_series"] = """
SELECT 'https://list.example.edu/o' || CAST(l_orderkey AS STRING) || '?page=' || CAST(l_linenumber AS STRING) || '&ref=x' AS url FROM lineitem
UNION ALL
SELECT 'https://all.example.edu/people/page/' || CAST(o_orderkey * 3 AS STRING) FROM orders
UNION ALL
SELECT 'https://az.example.edu/' || CAST(n_nationkey AS STRING) || '/' || substr(n_name, 1, 1) || '.html' FROM nation
UNION ALL
SELECT url FROM pages
"""

DEPENDS = {
    name: [t for t in TABLES if f" {t} " in f" {sql} ".replace("\n", " ").replace(")", " ").replace(",", " ")]
    for name, sql in SQL.items()
}

SPEC = RecordSpec.from_dict(
    {
        "columns": [
            {"name": "title", "type": "extracted", "hint": "title before the name",
             "validation": {"min_length": 4}},
            {"name": "full_name", "type": "extracted", "hint": "name as printed", "required": True},
            {"name": "position", "type": "extracted", "validation": {"max_length": 18}},
            {"name": "email", "type": "extracted", "required": True,
             "validation": {"regex": "[a-z0-9]+@[a-z0-9.-]+\\.[a-z]{2,}", "case_insensitive": True}},
            {"name": "homepage", "type": "extracted", "validation": {"url_like": True}},
            {"name": "local_name", "type": "extracted",
             "validation": {"contains_cjk": True, "min_length": 3}},
            {"name": "department_name", "type": "fallback", "value_from": "department"},
            {"name": "institution", "type": "static", "value_from": "university_name"},
            {"name": "listing", "type": "static", "value_from": "listing_url"},
            {"name": "source", "type": "static", "value": "crawl"},
            {"name": "remark", "type": "extracted"},
            {"name": "last_name", "type": "formula",
             "formula": "CASE WHEN instr([@[full_name]], ' ') > 0 THEN "
                        "substring([@[full_name]], instr([@[full_name]], ' ') + 1) ELSE '' END"},
        ],
        "dedup_keys": ["email"],
    }
)

LISTING_SPEC = RecordSpec.from_dict(
    {
        "columns": [
            {"name": "Title", "type": "extracted", "hint": "title"},
            {"name": "Full Name", "type": "extracted"},
            {"name": "Email", "type": "extracted", "required": True},
            {"name": "Unit", "type": "fallback", "value_from": "department"},
            {"name": "Institution", "type": "static", "value_from": "university_name"},
        ]
    }
)

DETAIL_SPEC = RecordSpec.from_dict(
    {"columns": [{"name": n, "type": "extracted"} for n in ("title", "position", "email")]}
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    df = spark.read.parquet(path)
    if name not in SPREAD:
        return df
    # a file of the test data is one split: deal its rows out to all cores, those of large tables to more tasks
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    return df.repartition(max(spark.sparkContext.defaultParallelism, math.ceil(size / DEALT_BYTES)), *SPREAD[name])


def fx(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for t in DEPENDS[name]:
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(SQL[name])


def duckdb_sql(name: str) -> str:
    return SQL[name].replace("AS STRING)", "AS VARCHAR)").strip()


def with_fixtures(query: str, *names: str) -> str:
    """``query`` with the named fixtures as CTEs in front of its own."""
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({duckdb_sql(n)})" for n in names)
    query = query.strip()
    if not ctes:
        return query
    recursive = ""
    if query.upper().startswith("WITH RECURSIVE"):
        recursive, query = "RECURSIVE ", query[len("WITH RECURSIVE") :].lstrip()
        return f"WITH {recursive}{ctes},\n{query}"
    if query.upper().startswith("WITH "):
        return f"WITH {ctes},\n{query[5:]}"
    return f"WITH {ctes}\n{query}"

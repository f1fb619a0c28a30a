"""DuckDB SQL for the registered queries, written apart from the Spark code.

RE2 has no look-behind and no back-references, so patterns are spelled out
again here. Queries without an entry are checked by rows only (and by tests).
"""

from __future__ import annotations

from .fixtures import with_fixtures

ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str, *fixtures: str) -> None:
    ORACLES[name] = with_fixtures(sql, *fixtures)


NULLS = "('', 'none', 'null', 'nan')"

# Normalised targets, used by many queries below.
N_TARGETS = f"""
n_targets AS (
 SELECT target_id, trim(university_name) AS university,
  CASE WHEN lower(trim(department_name)) NOT IN {NULLS} THEN trim(department_name) END AS department,
  CASE WHEN lower(trim(link)) NOT IN {NULLS} AND starts_with(trim(link), 'http') THEN trim(link) END AS link,
  CASE WHEN lower(trim(status)) NOT IN {NULLS} THEN trim(status) END AS status
 FROM fx_targets WHERE trim(university_name) <> '')
"""


def targets_oracle(name: str, sql: str, *fixtures: str) -> None:
    sql = sql.strip()
    if sql.upper().startswith("WITH "):
        sql = f"WITH {N_TARGETS.strip()}, {sql[5:]}"
    else:
        sql = f"WITH {N_TARGETS.strip()} {sql}"
    oracle(name, sql, "fx_targets", *fixtures)


# --- sources and sinks ------------------------------------------------------

targets_oracle("targets_normalized", "SELECT university, department, link, status, target_id FROM n_targets")

oracle("pages_latest", """
SELECT url, run_no, sha256(html) AS html_sha
FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY run_no DESC, html DESC) AS rn FROM fx_snapshots)
WHERE rn = 1
""", "fx_snapshots")

oracle("snapshots_live", """
SELECT event_id, ttl_sec FROM (
 SELECT event_id, ts, CASE WHEN event_id % 3 <> 0 THEN user_id * 36000 END AS ttl_sec FROM events)
WHERE ttl_sec IS NULL OR epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(ts) < ttl_sec * 1000000
""")

SYNC = """
WITH fresh AS (
 SELECT university, department, link, status FROM (
  SELECT *, row_number() OVER (PARTITION BY university, department ORDER BY target_id DESC) AS rn FROM n_targets)
 WHERE rn = 1),
stored AS (SELECT DISTINCT university, department FROM fx_updates),
actions AS (
 SELECT f.university, f.department, f.link, f.status,
  CASE WHEN EXISTS (SELECT 1 FROM stored s WHERE s.university = f.university AND s.department IS NOT DISTINCT FROM f.department)
   THEN 'update' ELSE 'insert' END AS action
 FROM fresh f
 UNION ALL
 SELECT s.university, s.department, NULL, NULL, 'delete' FROM stored s
 WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.university = s.university AND f.department IS NOT DISTINCT FROM s.department))
"""
targets_oracle("target_sync_actions", SYNC + "SELECT * FROM actions", "fx_updates")
targets_oracle("target_sync_counts", SYNC + """
SELECT (SELECT count(*) FROM fresh) AS n_kept, count(*) FILTER (WHERE action = 'delete') AS n_deleted FROM actions
""", "fx_updates")

targets_oracle("targets_appended", """
WITH extra AS (
 SELECT DISTINCT 'NATION_' || CAST(ord % 25 AS VARCHAR) AS university, 'BUILDING ' || CAST(ord AS VARCHAR) AS department
 FROM fx_departments)
SELECT university, department, link, status FROM n_targets
UNION ALL
SELECT university, department, NULL, NULL FROM extra e
WHERE NOT EXISTS (SELECT 1 FROM n_targets t WHERE t.university = e.university AND t.department IS NOT DISTINCT FROM e.department)
""", "fx_departments")

LAST_NAME = "CASE WHEN instr(full_name, ' ') > 0 THEN substr(full_name, instr(full_name, ' ') + 1) ELSE '' END"

oracle("export_rows", f"""
SELECT department || '/' || university AS _source_key, coalesce(title, '') AS title, coalesce(full_name, '') AS full_name,
 coalesce(position, '') AS position, coalesce(email, '') AS email, coalesce(homepage, '') AS homepage,
 coalesce(local_name, '') AS local_name,
 CASE WHEN trim(coalesce(department_name, '')) = '' THEN department ELSE department_name END AS department_name,
 university AS institution, listing_url AS listing, 'crawl' AS source, coalesce(remark, '') AS remark,
 {LAST_NAME} AS last_name
FROM fx_records
""", "fx_records")

oracle("export_json", """
SELECT '{"ord":' || CAST(ord AS VARCHAR)
 || coalesce(',"full_name":' || CAST(to_json(full_name) AS VARCHAR), '')
 || coalesce(',"title":' || CAST(to_json(title) AS VARCHAR), '')
 || coalesce(',"email":' || CAST(to_json(email) AS VARCHAR), '') || '}' AS json
FROM fx_records
""", "fx_records")

oracle("merge_by_source_key", """
WITH batch AS (SELECT DISTINCT department || '/' || university AS k FROM fx_records WHERE department IN ('BUILDING', 'MACHINERY'))
SELECT department || '/' || university AS _source_key, full_name, email FROM fx_records
WHERE department || '/' || university NOT IN (SELECT k FROM batch)
UNION ALL
SELECT department || '/' || university, NULL, email FROM fx_details WHERE department = 'BUILDING'
""", "fx_records", "fx_details")

oracle("generation_table", """
SELECT department || '/' || university AS _source_key,
 CAST(CASE WHEN department = 'BUILDING' THEN 2 ELSE 1 END AS BIGINT) AS run_no,
 CASE WHEN department = 'BUILDING' THEN upper(full_name) ELSE full_name END AS full_name, email
FROM fx_records WHERE department <> 'MACHINERY'
""", "fx_records")

oracle("run_log", """
SELECT run_id, epoch_us(min(started_at)) AS started_us, epoch_us(max(finished_at)) AS finished_us,
 arg_max(total_jobs, finished_at) AS total_jobs, arg_max(successful, finished_at) AS successful, arg_max(failed, finished_at) AS failed
FROM fx_run_events GROUP BY run_id
""", "fx_run_events")

# --- pages ------------------------------------------------------------------

NOISE = "|".join(
    f"<{t}[^>]*>.*?</{t}>"
    for t in ("script", "style", "svg", "noscript", "head", "meta", "link", "iframe")
)
ATTRIBUTE = (
    r"\s([\p{L}\p{N}_][\p{L}\p{N}_-]*)(?:\s*=\s*(?:\"([^\"]*)\"|''([^'']*)''|(\S+)))?".replace('\\"', '"')
)
KEPT = "('href','class','id','src','alt','title','name','type','value','target')"
ATTRS = f"""
list_transform(
 list_filter(regexp_extract_all(tag, '{ATTRIBUTE}'), lambda a: lower(regexp_extract(a, '{ATTRIBUTE}', 1)) IN {KEPT}),
 lambda a: ' ' || regexp_extract(a, '{ATTRIBUTE}', 1)
  || CASE WHEN regexp_extract(a, '{ATTRIBUTE}', 2) || regexp_extract(a, '{ATTRIBUTE}', 3) || regexp_extract(a, '{ATTRIBUTE}', 4) = '' THEN ''
   ELSE '="' || regexp_extract(a, '{ATTRIBUTE}', 2) || regexp_extract(a, '{ATTRIBUTE}', 3) || regexp_extract(a, '{ATTRIBUTE}', 4) || '"' END)
"""
PAGE_CLEANING = rf"""
stripped AS (
 SELECT page_id, url,
  regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '{NOISE}', '', 'gsi'),
   '<(?:meta|link|input|br|hr|img)[^>]*>', '', 'gi') AS h
 FROM cleaning_source),
parts AS (
 SELECT page_id, url, string_split_regex(h, '<[\p{{L}}\p{{N}}_]+[^>]*>') AS texts,
  list_transform(regexp_extract_all(h, '<[\p{{L}}\p{{N}}_]+[^>]*>'),
   lambda tag: regexp_extract(tag, '^<[\p{{L}}\p{{N}}_]+') || array_to_string({ATTRS}, '') || '>') AS tags
 FROM stripped),
joined AS (
 SELECT page_id, url, regexp_replace(
  array_to_string(list_transform(list_zip(texts, tags), lambda p: p[1] || coalesce(p[2], '')), ''),
  '\s{{3,}}', ' ', 'g') AS h
 FROM parts),
cleaned AS (
 SELECT page_id, url,
  array_to_string(list_filter(string_split_regex(h, '\r\n|[\n\r\x0b\f\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda l: regexp_matches(l, '\S')), chr(10)) AS html
 FROM joined)
"""
CLEANED = f"cleaning_source AS (SELECT * FROM pages), {PAGE_CLEANING}"
oracle("pages_clean", f"WITH {CLEANED} SELECT page_id, html FROM cleaned")

EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
TEXT = "regexp_replace(html, '<[^>]+>', ' ', 'g')"
MARKERS = [
    "{{", "v-bind", "v-if", "v-for", "v-model", "ng-app", "ng-controller", "ng-repeat", "__vue__",
    "__vue_app__", "_reactRootContainer", "data-reactroot", "data-reactid",
    '<div id="root">', '<div id="app">',
]
APIS = [
    "/api/", "fetch(", "ajax(", "xmlhttp", "staff_data", "faculty_data", "person_data",
    "load_people", "get_people", "member_data",
]
WORDS = [
    "professor", "associate", "lecturer", "faculty", "academic staff", "teaching staff",
    "staff directory",
]


def _any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _without(text: str, *elements: str) -> str:
    for name in elements:
        text = f"regexp_replace({text}, '(?is)<{name}([ \\t\\n\\f\\r][^>]*)?>.*?</{name}>', ' ', 'g')"
    return text


SHOWN = f"regexp_replace({_without('html', 'script', 'style')}, '<[^>]+>', ' ', 'g')"
REFUSED = "'(?i)403|forbidden|just a moment'"
PAGE_FLAGS = rf"""
WITH f AS (
 SELECT url, run_no, html, length(html) AS n_chars,
  length(regexp_replace({TEXT}, '^\s+|\s+$', '', 'g')) > 200 AS has_content,
  {_any(_without("html", "pre", "code", "textarea"), MARKERS)}
   OR len(list_filter(regexp_extract_all(html, '(?is)<script[^>]*>.*?</script>'),
       lambda s: {_any("lower(s)", APIS)})) > 0
   OR ({_any(f"lower({TEXT})", WORDS)} AND length(html) > 15000
       AND len(list_distinct(regexp_extract_all(html, '{EMAIL}'))) < 3
       AND NOT regexp_matches(html, '(?is)<li[^>]*>\s*(?:Prof\.|Dr\.|Professor)\s*[A-Z]')
       AND NOT regexp_matches(html, '(?is)<table[^>]*>.*?<t[rd][^>]*>\s*(?:Prof\.|Dr\.|Professor)\s+[A-Z].*?</table>')) AS is_template,
  length(html) < 1000
   OR regexp_matches(regexp_extract(html, '(?is)<title([ \t\n\f\r][^>]*)?>(.*?)</title>', 2), {REFUSED})
   OR regexp_matches(regexp_extract(html, '(?is)<h1([ \t\n\f\r][^>]*)?>(.*?)</h1>', 2), {REFUSED})
   OR len(regexp_extract_all({SHOWN}, '[^ \t\n\f\r]+')) <= 60 AND regexp_matches({SHOWN}, {REFUSED})
   OR contains(html, 'cf-browser-verification') AS is_blocked,
  len(list_distinct(regexp_extract_all(html, '{EMAIL}'))) AS n_emails
 FROM fx_snapshots)
SELECT url, run_no, n_chars, has_content, is_template, is_blocked, n_emails,
 CASE WHEN has_content AND NOT is_template AND n_chars >= 5000 THEN 'accept' WHEN is_blocked THEN 'blocked' ELSE 'render' END AS page_route
FROM f
"""
oracle("page_flags", PAGE_FLAGS, "fx_snapshots")
oracle("page_flags_kinds", PAGE_FLAGS.replace("fx_snapshots", "fx_page_kinds"), "fx_page_kinds")

REWRITES = [
    (r'\bid=(?:"|&quot;)[^"&]*(?:"|&quot;)', "", "g"),
    (r'\bfor=(?:"|&quot;)[^"&]*(?:"|&quot;)', "", "g"),
    (r'\bclass=(?:"|&quot;)[^"&]*(?:"|&quot;)', "", "g"),
    (r'\bname="[0-9a-f]{32}"', 'name=""', "g"),
    (r"<script\b.*?</script>", "", "gs"),
    (r'\bnonce="[^"]*"', "", "g"),
    (r'\b_csrf[^=]*="[^"]*"', "", "g"),
    (r'"csrf\.token":\s*"[^"]*"', "", "g"),
    (r"<meta\b[^>]*>", "", "g"),
    (r'data-[\p{L}\p{N}_-]+="[^"]*"', "", "g"),
    (r'href="([^"]*)\?[^"]*"', r'href="\1"', "g"),
    (r'([^\s"<>?]+\.css)(\?[^\s"<>]*)', r"\1", "g"),
    (r"_wpnonce[a-zA-Z0-9_]*", "_wpnonce", "g"),
    (r'([^\s"<>?]+\.js)(\?[^\s"<>]*)', r"\1", "g"),
    (r'(https?://[^\s"<>]*?)(\?[^\s"<>]*)', r"\1", "g"),
    (r"-\p{Nd}{10,}", "-0", "g"),
    (r'<a\s[^>]*href="mailto:[^"]*"[^>]*>[^\n]*?</a>', "", "g"),
    (r"\n{2,}", "\n", "g"),
    (r"[ \t]+\n", "\n", "g"),
    (r"\n[ \t]+", "\n", "g"),
    (r"^\s+|\s+$", "", "g"),
]


def _rewritten(column: str) -> str:
    sql = f"replace(replace({column}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    for pattern, replacement, flags in REWRITES:
        to = "chr(10)" if replacement == "\n" else f"'{replacement}'"
        sql = f"regexp_replace({sql}, '{pattern}', {to}, '{flags}')"
    return sql


FINGERPRINTS = f"fp AS (SELECT url, run_no, sha256({_rewritten('html')}) AS fingerprint FROM fx_snapshots)"
oracle("page_fingerprint", f"WITH {FINGERPRINTS} SELECT * FROM fp", "fx_snapshots")

CHANGES = f"""
{FINGERPRINTS},
changes AS (
 SELECT coalesce(o.url, n.url) AS url, o.fingerprint AS old_fingerprint, n.fingerprint AS new_fingerprint,
  CASE WHEN n.url IS NULL THEN 'gone' WHEN o.url IS NULL THEN 'new'
   WHEN o.fingerprint = n.fingerprint THEN 'unchanged' ELSE 'changed' END AS status
 FROM (SELECT * FROM fp WHERE run_no = 1) o FULL JOIN (SELECT * FROM fp WHERE run_no = 2) n ON o.url = n.url)
"""
oracle("page_changes", f"WITH {CHANGES} SELECT * FROM changes", "fx_snapshots")

oracle("subtree_changes", f"""
WITH {CHANGES},
edges AS (
 SELECT p.url AS src, c.url AS dst FROM pages p JOIN pages c ON c.page_id IN (p.page_id * 2 + 1, p.page_id * 2 + 2)),
kids AS (
 SELECT e.src, count(*) AS n, count(*) FILTER (WHERE c.status IS DISTINCT FROM 'unchanged') AS bad
 FROM edges e LEFT JOIN changes c ON c.url = e.dst GROUP BY e.src)
SELECT c.url, c.status, coalesce(k.n, 0) AS n_children, coalesce(k.bad, 0) AS n_children_changed,
 c.status = 'unchanged' AND coalesce(k.bad, 0) = 0 AS can_skip
FROM changes c LEFT JOIN kids k ON k.src = c.url
""", "fx_snapshots")

oracle("subtree_changes_deep", f"""
WITH RECURSIVE {CHANGES},
edges AS (
 SELECT p.url AS src, c.url AS dst FROM pages p JOIN pages c ON c.page_id IN (p.page_id * 2 + 1, p.page_id * 2 + 2)
  OR (p.page_id % 4 = 0 AND p.page_id > 0 AND c.page_id = (p.page_id - 1) // 2)),
marked AS (
 SELECT url, 0 AS d FROM changes WHERE status <> 'unchanged'
 UNION SELECT e.dst, 0 FROM edges e ANTI JOIN changes c ON c.url = e.dst
 UNION -- a tree of pages, with links back up: no shortest way is longer than 60
 SELECT e.src, m.d + 1 FROM marked m JOIN edges e ON e.dst = m.url WHERE m.d < 60),
nearest AS (SELECT url, min(d) AS d FROM marked GROUP BY url)
SELECT c.url, c.status, CAST(n.d AS BIGINT) AS links_to_change, n.d IS NULL AS can_skip
FROM changes c LEFT JOIN nearest n ON n.url = c.url
""", "fx_snapshots")


def _emails(source: str, key: str, column: str) -> str:
    return f"""
SELECT {key}, min(i) - 1 AS first_at, email FROM (
 SELECT {key}, unnest(regexp_extract_all({column}, '{EMAIL}')) AS email,
  generate_subscripts(regexp_extract_all({column}, '{EMAIL}'), 1) AS i FROM {source})
GROUP BY {key}, email"""


def _numbered_emails(source: str, key: str, column: str) -> str:
    return f"""
SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY first_at) - 1 AS pos, email
FROM ({_emails(source, key, column)})"""


DEOBFUSCATED = r"regexp_replace(regexp_replace(text, '(?i)\s*\[\s*(?:@|at)\s*\]\s*', '@', 'g'), '(?i)mailto:', '', 'g')"
oracle("page_emails", _numbered_emails("fx_contacts", "doc_id", "text"), "fx_contacts")
oracle("page_emails_html", _numbered_emails("pages", "url", "html"))
oracle("emails_deobfuscated", _numbered_emails(
    f"(SELECT doc_id, {DEOBFUSCATED} AS text FROM fx_contacts)", "doc_id", "text"), "fx_contacts")

oracle("title_prefix", r"""
SELECT ord, nullif(regexp_extract(trim(concat_ws(' ', title, full_name)), '^(Prof\.|Dr\.|Mr\.|Ms\.|Professor)', 1), '') AS prefix
FROM fx_records
""", "fx_records")

ROLE_IN = "professor|lecturer|head of department|department head|dean|director"
ROLE_OUT = (
    "postdoc|research fellow|research assistant|research staff|scientific staff|teaching support"
    "|teaching assistant|technician|administrative|secretary|it support|hr|finance|phd student"
    "|graduate student|intern|postdoctoral"
)


def _words(words: str) -> str:
    return f"(?i)(?:^|[^a-z])(?:{words})s?(?:$|[^a-z])"


def _role(column: str) -> str:
    field = f"(?is)((?:^|[^a-z])(?:{ROLE_IN})s?,?)\\s+(?:of|in|for)[^a-z].*"
    own = f"regexp_replace({column}, '{field}', '\\1')"
    return f"(regexp_matches({column}, '{_words(ROLE_IN)}') AND NOT regexp_matches({own}, '{_words(ROLE_OUT)}'))"


LISTING_ROWS = rf"""
blocks AS (
 SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:li(?:\s[^>]*)?>(.*?)</li|tr(?:\s[^>]*)?>(.*?)</tr)>', 0)) AS whole,
  generate_subscripts(regexp_extract_all(html, '(?is)<(?:li(?:\s[^>]*)?>(.*?)</li|tr(?:\s[^>]*)?>(.*?)</tr)>', 0), 1) - 1 AS pos
 FROM cleaned),
bodies AS (SELECT url, pos, regexp_replace(whole, '(?i)^<(?:li|tr)(?:\s[^>]*)?>|</(?:li|tr)>$', '', 'g') AS body FROM blocks),
fields AS (
 SELECT url, pos, regexp_extract(body, '(?i)<a\s[^>]*href="([^"]*)"', 1) AS href,
  trim(regexp_replace(regexp_extract(body, '(?is)<a(?:\s[^>]*)?>(.*?)</a>', 1), '<[^>]+>', ' ', 'g')) AS name,
  trim(regexp_replace(body, '<[^>]+>', ' ', 'g')) AS text
 FROM bodies)
SELECT url, CAST(pos AS BIGINT) AS pos, name,
 regexp_extract(url, '^(https?://[^/?#]+)', 1) || nullif(href, '') AS profile_url,
 nullif(regexp_extract({DEOBFUSCATED}, '{EMAIL}'), '') AS email,
 nullif(regexp_extract(text, '^(Prof\.|Dr\.|Mr\.|Ms\.|Professor)', 1), '') AS title,
 {_role("text")} AS is_academic_role
FROM fields WHERE href <> '' OR regexp_matches({DEOBFUSCATED}, '{EMAIL}')
"""
oracle("listing_rows", f"WITH {CLEANED}, {LISTING_ROWS}")
oracle("stream_listing_rows", f"""
WITH cleaning_source AS (
 SELECT 0 AS page_id, url, html FROM (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY run_no DESC) AS rn FROM fx_snapshots) WHERE rn = 1),
{PAGE_CLEANING}, {LISTING_ROWS.replace("SELECT url, CAST(pos AS BIGINT)", "SELECT url AS _source_key, CAST(pos AS BIGINT)")}
""", "fx_snapshots")

ANCHOR = r'<a\s[^>]*href="([^"]*)"[^>]*>([^<]*)</a>'
oracle("records_extracted", f"""
SELECT url, i - 1 AS pos, CAST(NULL AS VARCHAR) AS "Title", names[i] AS "Full Name", CAST(NULL AS VARCHAR) AS "Email",
 CAST(NULL AS VARCHAR) AS "Unit", links[i] AS profile_url
FROM (SELECT url, regexp_extract_all(html, '{ANCHOR}', 1) AS links, regexp_extract_all(html, '{ANCHOR}', 2) AS names,
 unnest(range(1, len(regexp_extract_all(html, '{ANCHOR}', 1)) + 1)) AS i FROM pages)
""")

oracle("records_mined", """
SELECT 'https://d.edu/people/' || CAST(c_custkey // 40 AS VARCHAR) AS url, CAST(c_custkey % 40 AS BIGINT) AS pos, c_name AS name,
 CASE WHEN c_custkey // 40 % 2 = 0 THEN 'https://d.edu/p/' || CAST(c_custkey AS VARCHAR) END AS profile_url,
 CASE WHEN c_custkey // 40 % 4 <> 2 THEN 'm' || CAST(c_custkey AS VARCHAR) || '@d.edu' END AS email
FROM customer
""")

DEPT_OUT = (
    "hr|human resources|finance|it|library|registrar|centre|center|lab|laboratory|graduate school"
    "|continuing education|professional studies"
)
UNIT = "(?:department|dept\\.?|school|faculty|division|institute) of"

# --- links ------------------------------------------------------------------

HREF = r'(?i)<a\s[^>]*href="([^"]*)"[^>]*>'
oracle("page_links", f"""
SELECT src, pos, href,
 CASE WHEN starts_with(href, '/') THEN regexp_extract(src, '^(https?://[^/?#]+)', 1) || href ELSE href END AS dst
FROM (SELECT url AS src, unnest(regexp_extract_all(html, '{HREF}', 1)) AS href,
 generate_subscripts(regexp_extract_all(html, '{HREF}', 1), 1) - 1 AS pos FROM pages)
""")

oracle("url_from_text", r"""
SELECT page_id, nullif(regexp_replace(regexp_extract(answer, 'https?://\S+'), '[.)]+$', ''), '') AS url FROM fx_answers
""", "fx_answers")

oracle("url_canonical", r"""
SELECT url, split_part(url, '?', 1) AS canonical, lower(split_part(regexp_replace(split_part(url, '://', 2), '[/?#].*$', ''), ':', 1)) AS host FROM pages
""")

HOSTS = [
    "linkedin.com", "facebook.com", "wikipedia.org", "youtube.com", "twitter.com", "x.com",
    "instagram.com", "reddit.com", "glassdoor.com", "indeed.com", "topuniversities.com",
    "usnews.com", "timeshighereducation.com",
]
HOST = "regexp_extract(url, '^https?://([^/?#:]+)', 1)"
BLOCKED = "(" + " OR ".join(f"{HOST} = '{h}' OR ends_with({HOST}, '.{h}')" for h in HOSTS) + ")"
oracle("urls_allowed", f"SELECT query_id, rank, url FROM fx_hits WHERE NOT {BLOCKED}", "fx_hits")
oracle(
    "urls_allowed_substring",
    f"SELECT query_id, rank, url FROM fx_hits WHERE NOT {_any('url', HOSTS)}",
    "fx_hits",
)

oracle("pagination_series", r"""
WITH u AS (SELECT DISTINCT url FROM fx_series),
s AS (
 SELECT url, CASE
   WHEN regexp_matches(url, '^[^#]*[?&]page=\d{1,18}(?:[&#].*)?$') THEN 1
   WHEN regexp_matches(url, '^[^?#]*/page/\d{1,18}(?:[/?#].*)?$') THEN 2
   WHEN regexp_matches(url, '^[^?#]*/\d{1,18}(?:/|\.html)?(?:[?#].*)?$') THEN 3
   WHEN regexp_matches(url, '^[^?#]*/[A-Z](?:/|\.html)(?:[?#].*)?$') THEN 4 END AS kind
 FROM u),
k AS (
 SELECT url, CASE kind
   WHEN 1 THEN regexp_replace(url, '^([^#]*[?&]page=)\d{1,18}((?:[&#].*)?)$', '\1{}\2')
   WHEN 2 THEN regexp_replace(url, '^([^?#]*/page/)\d{1,18}((?:[/?#].*)?)$', '\1{}\2')
   WHEN 3 THEN regexp_replace(url, '^([^?#]*/)\d{1,18}((?:/|\.html)?(?:[?#].*)?)$', '\1{}\2')
   ELSE regexp_replace(url, '^([^?#]*/)[A-Z]((?:/|\.html)(?:[?#].*)?)$', '\1{}\2') END AS template,
  CASE kind
   WHEN 1 THEN CAST(regexp_extract(url, '[?&]page=(\d{1,18})(?:[&#].*)?$', 1) AS BIGINT)
   WHEN 2 THEN CAST(regexp_extract(url, '/page/(\d{1,18})(?:[/?#].*)?$', 1) AS BIGINT)
   WHEN 3 THEN CAST(regexp_extract(url, '^[^?#]*/(\d{1,18})(?:/|\.html)?(?:[?#].*)?$', 1) AS BIGINT)
   ELSE CAST(ascii(regexp_extract(url, '/([A-Z])(?:/|\.html)(?:[?#].*)?$', 1)) - 64 AS BIGINT) END AS seq
 FROM s WHERE kind IS NOT NULL)
SELECT url, template, seq, lead(url) OVER w AS next_url, lead(seq) OVER w - seq - 1 AS gap,
 lead(url) OVER w IS NULL AS is_last
FROM k WINDOW w AS (PARTITION BY template ORDER BY seq, url)
""", "fx_series")

targets_oracle("search_queries", """
SELECT university, department, CAST(q.n AS BIGINT) AS query_no,
 CASE WHEN department IS NULL THEN CASE q.n WHEN 0 THEN university || ' faculty' WHEN 1 THEN university || ' academic staff'
   WHEN 2 THEN university || ' staff' ELSE university || ' professors' END
  ELSE CASE q.n WHEN 0 THEN university || ' ' || department || ' faculty'
   WHEN 1 THEN university || ' ' || department || ' academic staff'
   WHEN 2 THEN university || ' department of ' || department || ' faculty'
   WHEN 3 THEN university || ' ' || department || ' staff' ELSE university || ' ' || department || ' professors' END END AS query
FROM n_targets JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS n) q ON q.n < 4 OR department IS NOT NULL
""")

oracle("hits_topn", """
SELECT query_id, rank, url FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, url) AS rn FROM fx_hits) WHERE rn <= 5
""", "fx_hits")

oracle("hits_combined", f"""
SELECT target_id, url, query_no, rank FROM (
 SELECT *, row_number() OVER (PARTITION BY target_id, url ORDER BY query_no, rank) AS rn FROM fx_hits WHERE NOT {BLOCKED})
WHERE rn = 1
""", "fx_hits")

oracle("listing_url_best", f"""
WITH scored AS (
 SELECT target_id, rank, url, 4 + CASE WHEN starts_with({HOST}, department || '.') THEN 2 ELSE 0 END
  + CASE WHEN regexp_matches(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/people|/staff|/faculty|/academic-staff') THEN 1 ELSE 0 END AS score
 FROM fx_hits
 WHERE ({HOST} = domain OR ends_with({HOST}, '.' || domain)) AND NOT {BLOCKED}
  AND NOT regexp_matches(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '^/?$'))
SELECT target_id, url AS listing_url, CAST(score AS BIGINT) AS score FROM (
 SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, rank, url) AS rn FROM scored) WHERE rn = 1
""", "fx_hits")

# --- traversal --------------------------------------------------------------

oracle("crawl_closure", """
WITH RECURSIVE walk AS (
 SELECT DISTINCT 'https://d/r' || CAST(r_regionkey AS VARCHAR) AS root, 'https://d/r' || CAST(r_regionkey AS VARCHAR) AS url, 0 AS depth FROM region
 UNION -- every page is within five links of a root: regions, nations, customers, regions, ...
 SELECT w.root, l.dst, w.depth + 1 FROM walk w JOIN fx_links l ON l.src = w.url WHERE w.depth < 9)
SELECT root, url, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY root, url
""", "fx_links")

oracle("crawl_ancestors", """
WITH RECURSIVE walk AS (
 SELECT 'https://d/r' || CAST(r_regionkey AS VARCHAR) AS root, 'https://d/r' || CAST(r_regionkey AS VARCHAR) AS url, 0 AS depth,
  '' AS steps, '' AS chain FROM region
 UNION ALL -- of each level the first path to a page
 SELECT root, url, depth, steps, chain FROM (
  SELECT *, row_number() OVER (PARTITION BY root, url ORDER BY steps, chain) AS rn FROM (
   SELECT w.root, l.dst AS url, w.depth + 1 AS depth,
    w.steps || CASE kind WHEN 'next' THEN '0' ELSE '1' END || lpad(CAST(l.pos AS VARCHAR), 20, '0') AS steps,
    CASE WHEN w.depth = 0 THEN w.url ELSE w.chain || ' > ' || w.url END AS chain
   FROM walk w JOIN fx_links l ON l.src = w.url WHERE w.depth < 9)) WHERE rn = 1)
SELECT root, url, chain AS ancestors FROM (
 SELECT *, row_number() OVER (PARTITION BY root, url ORDER BY depth, steps, chain) AS rn FROM walk) WHERE rn = 1
""", "fx_links")

oracle("pagination_walk", """
WITH RECURSIVE walk AS (
 SELECT DISTINCT src AS root, src AS url, CAST(1 AS BIGINT) AS page_no FROM fx_links
 WHERE kind = 'next' AND src NOT IN (SELECT dst FROM fx_links WHERE kind = 'next')
 UNION ALL
 SELECT w.root, l.dst, w.page_no + 1 FROM walk w JOIN fx_links l ON l.src = w.url AND l.kind = 'next')
SELECT root, url, page_no FROM walk
""", "fx_links")

oracle("crawl_order", """
WITH RECURSIVE
nexts AS (SELECT src, arg_min(dst, (pos, dst)) AS nxt FROM fx_links WHERE kind = 'next' GROUP BY src),
kids AS (
 SELECT src, list(dst ORDER BY pos, dst) AS kids
 FROM (SELECT src, dst, min(pos) AS pos FROM fx_links WHERE kind = 'child' GROUP BY src, dst) GROUP BY src),
walk AS ( -- a row for each step of each root: its queue of pages with the way to them, and all pages queued so far
 SELECT 'https://d/n' || CAST(n_nationkey AS VARCHAR) AS root, CAST(0 AS BIGINT) AS visit_no, CAST(NULL AS VARCHAR) AS url,
  CAST(0 AS BIGINT) AS depth, CAST('' AS VARCHAR) AS ancestors,
  [{'u': 'https://d/n' || CAST(n_nationkey AS VARCHAR), 'c': CAST('' AS VARCHAR), 'd': CAST(0 AS BIGINT)}] AS queue,
  ['https://d/n' || CAST(n_nationkey AS VARCHAR)] AS known FROM nation
 UNION ALL
 SELECT root, visit_no + 1, page.u, page.d, page.c,
  list_transform(ahead, lambda u: {'u': u, 'c': onward, 'd': page.d + 1}) || rest
   || list_transform(list_filter(children, lambda u: NOT list_contains(known || ahead, u)), lambda u: {'u': u, 'c': onward, 'd': page.d + 1}),
  known || ahead || list_filter(children, lambda u: NOT list_contains(known || ahead, u))
 FROM (
  SELECT w.root, w.visit_no, w.known, w.queue[1] AS page, w.queue[2:] AS rest, coalesce(k.kids, []) AS children,
   CASE WHEN x.nxt IS NULL OR list_contains(w.known, x.nxt) THEN [] ELSE [x.nxt] END AS ahead,
   CASE WHEN w.queue[1].d = 0 THEN w.queue[1].u ELSE w.queue[1].c || ' > ' || w.queue[1].u END AS onward
  FROM walk w LEFT JOIN nexts x ON x.src = w.queue[1].u LEFT JOIN kids k ON k.src = w.queue[1].u
  WHERE len(w.queue) > 0 AND w.visit_no < 30))
SELECT root, visit_no, url, depth, ancestors FROM walk WHERE visit_no > 0
""", "fx_links")

oracle("crawl_order_full", """
WITH RECURSIVE
urls AS (SELECT url, row_number() OVER (ORDER BY url) AS no FROM (
 SELECT src AS url FROM fx_links UNION SELECT dst FROM fx_links UNION SELECT 'https://d/n' || CAST(n_nationkey AS VARCHAR) FROM nation)),
steps AS (SELECT s.no AS src, d.no AS dst, kind, pos, l.dst AS name FROM fx_links l JOIN urls s ON s.url = l.src JOIN urls d ON d.url = l.dst),
nexts AS (SELECT src, arg_min(dst, (pos, name)) AS nxt FROM steps WHERE kind = 'next' GROUP BY src),
kids AS (
 SELECT src, list(dst ORDER BY pos, name) AS kids
 FROM (SELECT src, dst, name, min(pos) AS pos FROM steps WHERE kind = 'child' GROUP BY src, dst, name) GROUP BY src),
walk USING KEY (root) AS ( -- the state of each root, which a step replaces: its queue, all pages queued so far and by whom, all visits
 SELECT no AS root, [no] AS queue, [no] AS known, [CAST(0 AS BIGINT)] AS parents, CAST([] AS BIGINT[]) AS visits
 FROM urls JOIN nation ON url = 'https://d/n' || CAST(n_nationkey AS VARCHAR)
 UNION
 SELECT root, ahead || rest || children, known || ahead || children,
  parents || list_transform(ahead || children, lambda u: page), list_append(visits, page)
 FROM (
  SELECT root, known, parents, visits, page, rest, ahead, CASE WHEN len(kids) = 0 THEN kids
    WHEN len(kids) = 1 THEN CASE WHEN list_contains(known, kids[1]) OR list_contains(ahead, kids[1]) THEN [] ELSE kids END
    ELSE list_filter(kids, lambda u: NOT list_contains(known, u) AND NOT list_contains(ahead, u)) END AS children
  FROM (
   SELECT w.root, w.known, w.parents, w.visits, w.queue[1] AS page, w.queue[2:] AS rest, coalesce(k.kids, []) AS kids,
    CASE WHEN x.nxt IS NULL OR list_contains(w.known, x.nxt) THEN [] ELSE [x.nxt] END AS ahead
   FROM walk w LEFT JOIN nexts x ON x.src = w.queue[1] LEFT JOIN kids k ON k.src = w.queue[1]
   WHERE len(w.queue) > 0))),
visited AS (SELECT root, generate_subscripts(visits, 1) AS visit_no, unnest(visits) AS page FROM walk),
offered AS (SELECT root, unnest(known) AS page, unnest(parents) AS parent FROM walk),
deep AS (
 SELECT root, page, CAST(0 AS BIGINT) AS depth FROM offered WHERE parent = 0
 UNION ALL SELECT o.root, o.page, d.depth + 1 FROM deep d JOIN offered o ON o.root = d.root AND o.parent = d.page)
SELECT r.url AS root, CAST(visit_no AS BIGINT) AS visit_no, u.url, depth, p.url AS parent
FROM visited v JOIN offered o USING (root, page) JOIN deep USING (root, page)
JOIN urls r ON r.no = root JOIN urls u ON u.no = page LEFT JOIN urls p ON p.no = parent
""", "fx_links")

oracle("closure_delta", """
WITH RECURSIVE
numbered AS (SELECT *, CAST(regexp_extract(dst, '([0-9]+)$', 1) AS BIGINT) AS number FROM fx_links),
changed AS (
 SELECT src, dst FROM numbered WHERE NOT CASE kind WHEN 'next' THEN number % 13 = 5 ELSE number % 11 = 3 END
 UNION
 SELECT src, regexp_replace(dst, '[0-9]+$', '') || CAST(number + 2 AS VARCHAR) FROM numbered WHERE kind = 'next' AND number % 7 = 2),
walk AS (
 SELECT DISTINCT 'https://d/r' || CAST(r_regionkey AS VARCHAR) AS root, 'https://d/r' || CAST(r_regionkey AS VARCHAR) AS url, 0 AS depth FROM region
 UNION -- no chain of links that are left is longer
 SELECT w.root, l.dst, w.depth + 1 FROM walk w JOIN changed l ON l.src = w.url WHERE w.depth < 40)
SELECT root, url, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY root, url
""", "fx_links")

oracle("frontier_pruned", """
WITH full_pages AS (
 SELECT url FROM (SELECT 'https://d/r' || CAST(o_custkey % 2 AS VARCHAR) AS url FROM orders) GROUP BY url HAVING count(*) >= 40)
SELECT src, dst, kind, pos FROM fx_links WHERE src NOT IN (SELECT url FROM full_pages)
""", "fx_links")

# --- responses --------------------------------------------------------------

PARSED = r"""
blocks AS (SELECT page_id, url, nullif(regexp_extract(response, '(?s)\{.*\}'), '') AS b FROM fx_responses),
parsed AS (
 SELECT page_id, url, CASE WHEN b IS NULL THEN 'no_json' WHEN NOT json_valid(b) THEN 'invalid_json'
  WHEN coalesce(json_extract_string(b, '$.error'), '') <> '' THEN 'reported_error' ELSE 'ok' END AS parse_status,
  CASE WHEN json_valid(b) THEN CAST(b AS JSON) END AS j
 FROM blocks)
"""
oracle("responses_parsed", f"""
WITH {PARSED}
SELECT page_id, parse_status,
 CASE parse_status WHEN 'no_json' THEN 'response holds no JSON' WHEN 'invalid_json' THEN 'response holds invalid JSON'
  ELSE j->>'$.error' END AS page_error,
 CAST(json_array_length(j, '$.records') AS BIGINT) AS n_records,
 CASE WHEN j IS NOT NULL THEN trim(coalesce(j->>'$.next_page_url', '')) END AS next_page_url,
 CASE WHEN j IS NOT NULL THEN coalesce(array_to_string(from_json(nullif(CAST(j->'$.child_page_urls' AS VARCHAR), 'null'), '["VARCHAR"]'), ' '), '') END AS child_page_urls
FROM parsed
""", "fx_responses")

oracle("response_links", f"""
WITH {PARSED},
kids AS (
 SELECT url, unnest(from_json(nullif(CAST(j->'$.child_page_urls' AS VARCHAR), 'null'), '["VARCHAR"]')) AS dst,
  generate_subscripts(from_json(nullif(CAST(j->'$.child_page_urls' AS VARCHAR), 'null'), '["VARCHAR"]'), 1) - 1 AS pos
 FROM parsed WHERE parse_status = 'ok')
SELECT url AS src, trim(j->>'$.next_page_url') AS dst, 'next' AS kind, CAST(0 AS BIGINT) AS pos FROM parsed
WHERE parse_status = 'ok' AND starts_with(trim(j->>'$.next_page_url'), 'http')
UNION ALL
SELECT url, trim(dst), 'child', CAST(pos AS BIGINT) FROM kids WHERE starts_with(trim(dst), 'http')
""", "fx_responses")

oracle("records_from_responses", f"""
WITH {PARSED},
recs AS (
 SELECT url, j, unnest(from_json(j->'$.records', '["JSON"]')) AS r,
  generate_subscripts(from_json(j->'$.records', '["JSON"]'), 1) - 1 AS pos
 FROM parsed WHERE parse_status = 'ok')
SELECT url, CAST(pos AS BIGINT) AS pos,
 coalesce(r->>'$.title', r->>'$.field_1', r->>'$.Title') AS "Title",
 coalesce(r->>'$.field_2', r->>'$."Full Name"') AS "Full Name",
 CASE WHEN json_exists(r, '$.field_3') THEN r->>'$.field_3' ELSE r->>'$.Email' END AS "Email",
 coalesce(r->>'$.field_4', j->>'$.static_values.field_4') AS "Unit",
 r->>'$.profile_url' AS profile_url
FROM recs
""", "fx_responses")

oracle("values_coerced", r"""
WITH b AS (SELECT profile_url, nullif(regexp_extract(response, '(?s)\{.*\}'), '') AS b FROM fx_detail_responses),
p AS (SELECT profile_url, CASE WHEN json_valid(b) THEN CAST(b AS JSON) END AS j FROM b),
f AS (SELECT profile_url, j, j IS NULL OR coalesce(j->>'$.error', '') <> '' AS failed FROM p)
SELECT profile_url, failed,
 CASE WHEN failed THEN NULL WHEN json_type(j, '$.title') = 'ARRAY'
   THEN array_to_string(list_filter(from_json(j->'$.title', '["VARCHAR"]'), lambda x: x IS NOT NULL AND x <> ''), '; ')
  ELSE j->>'$.title' END AS title,
 CASE WHEN failed THEN NULL WHEN json_type(j, '$.position') = 'ARRAY' THEN '' WHEN json_type(j, '$.position') = 'BOOLEAN' THEN 'True'
  ELSE j->>'$.position' END AS position,
 CASE WHEN NOT failed THEN j->>'$.email' END AS email
FROM f
""", "fx_detail_responses")

LISTED = r"""
listed AS (
 SELECT ord, university, b, from_json(nullif(CAST(json_extract(b, '$.departments') AS VARCHAR), 'null'), '["VARCHAR"]') AS names FROM (
  SELECT ord, university, nullif(regexp_extract(response, '(?s)\{.*\}'), '') AS b FROM fx_department_lists)
 WHERE json_valid(b)),
names AS (SELECT ord, university, generate_subscripts(names, 1) - 1 AS pos, unnest(names) AS name FROM listed)
"""
oracle("departments_parsed", f"WITH {LISTED} SELECT ord, university, pos, name FROM names", "fx_department_lists")

oracle("departments_discovered", rf"""
WITH {LISTED},
firsts AS (
 SELECT university, trim(name) AS name FROM (
  SELECT *, row_number() OVER (PARTITION BY university, lower(trim(name)) ORDER BY ord, pos) AS rn FROM names WHERE trim(name) <> '')
 WHERE rn = 1 AND NOT regexp_matches(name, '{_words(DEPT_OUT)}')),
keyed AS (
 SELECT university, name, regexp_replace(regexp_replace(lower(name), ', {UNIT}$', ''), '^{UNIT} ', '') AS k FROM firsts),
found AS (
 SELECT university, name FROM (SELECT *, row_number() OVER (PARTITION BY university, k ORDER BY length(name), name) AS rn FROM keyed) WHERE rn = 1)
SELECT university, CAST(NULL AS VARCHAR) AS department, CAST(NULL AS VARCHAR) AS link,
 CASE WHEN university IN (SELECT university FROM found) THEN 'completed' WHEN ord % 3 = 0 THEN 'Skipped' END AS status
FROM fx_department_lists
UNION ALL SELECT university, name, NULL, NULL FROM found
""", "fx_department_lists")

oracle("listing_urls_found", f"""
WITH firsts AS (SELECT * FROM fx_hits WHERE NOT {BLOCKED}),
scored AS (
 SELECT target_id, department, rank, url, CASE WHEN starts_with({HOST}, department || '.') THEN 2 ELSE 0 END
  + CASE WHEN regexp_matches(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/people|/staff|/faculty|/academic-staff') THEN 1 ELSE 0 END AS score
 FROM firsts WHERE ({HOST} = domain OR ends_with({HOST}, '.' || domain))
  AND NOT regexp_matches(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '^/?$')),
best AS (
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id, department ORDER BY score DESC, rank, url) AS rn FROM scored) WHERE rn = 1)
SELECT CAST(t.target_id AS VARCHAR) AS university, t.department, coalesce(b.url, 'ftp://none') AS link,
 CASE WHEN b.url IS NULL THEN 'nan' ELSE 'url-found' END AS status
FROM (SELECT DISTINCT target_id, department FROM fx_hits) t
LEFT JOIN best b ON b.target_id = t.target_id AND b.department = t.department
""", "fx_hits")

oracle("extraction_requests", f"""
WITH {CLEANED},
links AS (SELECT p.url, list_transform(regexp_extract_all(p.html, '{HREF}', 1),
  lambda h: regexp_extract(p.url, '^(https?://[^/?#]+)', 1) || h) AS known FROM pages p),
made AS (
 SELECT c.url, 'Page: ' || c.url || '
Fields:
field_1: Title (title)
field_2: Full Name (no hint)
field_3: Email (no hint)
field_4: Unit (no hint)
Filled elsewhere:
Institution: from university_name
Reached by:
' || regexp_extract(c.url, '^(https?://[^/?#]+)', 1) || '
Already known:
' || array_to_string(list_sort(list_distinct(list_filter(l.known, lambda k: k <> c.url))), chr(10)) || '
HTML:
' || c.html AS prompt
 FROM cleaned c JOIN links l ON l.url = c.url)
SELECT url, length(prompt) AS n_chars, sha256(prompt) AS prompt_hash FROM made
""")

FIELDS = ["title", "full_name", "position", "email", "homepage", "local_name", "department_name", "remark"]
PLAN = f"""
stats AS (
 SELECT department || '/' || university AS _source_key, count(*) AS n_records,
  count(*) FILTER (WHERE profile_url LIKE 'http%') AS n_with_profile,
  bool_or(coalesce(full_name, '') = '') OR bool_or(coalesce(email, '') = '') AS gate,
  concat_ws(',', {", ".join(f"CASE WHEN bool_or(coalesce({f}, '''') = '''') THEN '{f}' END".replace("''''", "''") for f in FIELDS)}) AS fields
 FROM fx_records GROUP BY 1),
plan AS (SELECT _source_key, n_records, n_with_profile, gate AND n_with_profile > 0 AS needs_detail, fields FROM stats)
"""
oracle("enrichment_plan", f"WITH {PLAN} SELECT * FROM plan", "fx_records")

oracle("detail_requests", f"""
WITH {PLAN},
r AS (SELECT DISTINCT department || '/' || university AS _source_key, profile_url FROM fx_records WHERE profile_url LIKE 'http%'),
made AS (
 SELECT r._source_key, r.profile_url, 'Profile: ' || r.profile_url || '
Missing fields:
' || array_to_string(list_transform(string_split(p.fields, ','), lambda f: f || ': ' || CASE f WHEN 'title' THEN 'title before the name'
   WHEN 'full_name' THEN 'name as printed' ELSE 'no hint' END), chr(10)) AS prompt
 FROM r JOIN plan p ON p._source_key = r._source_key WHERE p.needs_detail)
SELECT _source_key, profile_url, prompt, sha256(prompt) AS prompt_hash FROM made
""", "fx_records")

# --- record columns ---------------------------------------------------------

oracle("records_validated", r"""
SELECT ord, CASE WHEN title <> '' AND length(title) < 4 THEN '' ELSE coalesce(title, '') END AS title,
 coalesce(full_name, '') AS full_name,
 CASE WHEN length(position) > 18 THEN '' ELSE coalesce(position, '') END AS position,
 CASE WHEN regexp_matches(email, '^(?i:[a-z0-9]+@[a-z0-9.-]+\.[a-z]{2,})') THEN email ELSE '' END AS email,
 CASE WHEN regexp_matches(homepage, '^(?i)https?://') THEN homepage ELSE '' END AS homepage,
 CASE WHEN length(local_name) >= 3 AND regexp_matches(local_name, '[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]') THEN local_name ELSE '' END AS local_name,
 coalesce(department_name, '') AS department_name, coalesce(remark, '') AS remark
FROM fx_records
""", "fx_records")

oracle("validation_report", r"""
SELECT 'title' AS "column", 'min_length' AS rule, count(*) AS n_violations FROM fx_records WHERE title <> '' AND length(title) < 4
UNION ALL SELECT 'position', 'max_length', count(*) FROM fx_records WHERE length(position) > 18
UNION ALL SELECT 'email', 'regex', count(*) FROM fx_records WHERE email <> '' AND NOT regexp_matches(email, '^(?i:[a-z0-9]+@[a-z0-9.-]+\.[a-z]{2,})')
UNION ALL SELECT 'homepage', 'url_like', count(*) FROM fx_records WHERE homepage <> '' AND NOT regexp_matches(homepage, '^(?i)https?://')
UNION ALL SELECT 'local_name', 'min_length', count(*) FROM fx_records WHERE local_name <> '' AND length(local_name) < 3
UNION ALL SELECT 'local_name', 'contains_cjk', count(*) FROM fx_records WHERE length(local_name) >= 3
 AND NOT regexp_matches(local_name, '[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]')
""", "fx_records")

oracle("records_filled", """
SELECT ord, CASE WHEN trim(coalesce(department_name, '')) = '' THEN department ELSE department_name END AS department_name,
 university AS institution, listing_url AS listing, 'crawl' AS source FROM fx_records
""", "fx_records")

oracle("records_formula", f"SELECT ord, {LAST_NAME} AS last_name FROM fx_records", "fx_records")
oracle("records_role_filtered", f"SELECT ord, position FROM fx_records WHERE {_role('position')}", "fx_records")

oracle("departments_filtered", f"""
SELECT ord, university, name FROM fx_departments
WHERE trim(coalesce(name, '')) <> '' AND NOT regexp_matches(name, '{_words(DEPT_OUT)}')
""", "fx_departments")

oracle("stable_ids", """
SELECT ord, department || '/' || university AS source_key,
 substr(sha256(university || '::' || department), 1, 32) AS job_id,
 substr(sha256(profile_url), 1, 40) AS url_key,
 substr(sha256(university || chr(31) || department || chr(31) ||
  CASE WHEN coalesce(email, '') = '' AND coalesce(title, '') = '' THEN 'content=' || full_name
   ELSE concat_ws(chr(31), 'email=' || nullif(email, ''), 'title=' || nullif(title, '')) END), 1, 32) AS record_id
FROM fx_records
""", "fx_records")

oracle("records_enriched", """
SELECT r.ord,
 CASE WHEN coalesce(r.title, '') <> '' THEN r.title WHEN d.ok THEN coalesce(nullif(d.title, ''), r.title) ELSE r.title END AS title,
 CASE WHEN coalesce(r.email, '') <> '' THEN r.email WHEN d.ok THEN coalesce(nullif(d.email, ''), r.email) ELSE r.email END AS email,
 CASE WHEN coalesce(r.homepage, '') <> '' THEN r.homepage WHEN d.ok THEN coalesce(nullif(d.homepage, ''), r.homepage) ELSE r.homepage END AS homepage,
 r.position,
 CASE WHEN d.blocked OR d.failed THEN CASE WHEN coalesce(r.remark, '') <> '' THEN r.remark || '; ' ELSE '' END
   || CASE WHEN d.blocked THEN 'Detail page unreachable: ' ELSE 'LLM extraction failed for: ' END || r.profile_url
  ELSE r.remark END AS remark
FROM fx_records r LEFT JOIN (SELECT *, NOT blocked AND NOT failed AS ok FROM fx_details) d ON d.profile_url = r.profile_url
""", "fx_records", "fx_details")

oracle("field_null_counts", " UNION ALL ".join(
    f"SELECT '{f}' AS field, count(*) - count({f}) AS n_null FROM fx_records" for f in FIELDS), "fx_records")
oracle("field_empty_any", " UNION ALL ".join(
    f"SELECT department || '/' || university AS _source_key, '{f}' AS field, bool_or(coalesce({f}, '') = '') AS any_empty FROM fx_records GROUP BY 1"
    for f in FIELDS), "fx_records")

oracle("error_budget", """
SELECT department || '/' || university AS _source_key, count(*) AS n_pages,
 count(*) FILTER (WHERE blocked OR failed) AS n_errors, count(*) FILTER (WHERE blocked OR failed) >= 5 AS over_budget
FROM fx_details GROUP BY 1
""", "fx_details")

MERGED = ["full_name", "title", "position", "email", "homepage", "local_name", "department_name", "remark",
          "listing_url", "profile_url"]


def _deduped(scope: list[str]) -> str:
    values = MERGED + [c for c in ("university", "department") if c not in scope]
    first = ",\n ".join(
        f"coalesce(arg_min({c}, ord) FILTER (WHERE trim(coalesce({c}, '')) <> ''), arg_min_null({c}, ord)) AS {c}"
        for c in values
    )
    keys = ", ".join([*scope, "k", "apart"])
    head = "".join(f"{c}, " for c in scope)
    return f"""
WITH r AS (SELECT *, trim(coalesce(email, '')) AS k, CASE WHEN trim(coalesce(email, '')) = '' THEN ord END AS apart FROM fx_records)
SELECT {head} min(ord) AS ord, {first} FROM r GROUP BY {keys}"""


oracle("records_deduped", _deduped(["university", "department"]), "fx_records")
oracle("records_deduped_global", _deduped([]), "fx_records")

oracle("dedup_report", """
SELECT university, department, count(*) AS n_before,
 count(DISTINCT CASE WHEN coalesce(email, '') = '' THEN 'row ' || CAST(ord AS VARCHAR) ELSE 'key ' || email END) AS n_after
FROM fx_records GROUP BY university, department
""", "fx_records")

oracle("departments_distinct", """
SELECT university, arg_min(trim(name), ord) AS name, min(ord) AS ord FROM fx_departments
WHERE trim(coalesce(name, '')) <> '' GROUP BY university, lower(trim(name))
""", "fx_departments")

_UNITS = "(department|dept[.]?|school|faculty|division|institute) of"
oracle("departments_similar", rf"""
WITH keys AS ( -- all pairs of one university, by brute force
 SELECT DISTINCT university, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(name)), '[ \t]+', ' ', 'g'),
  ', {_UNITS}$', ''), '^{_UNITS} ', '')) AS key FROM fx_unit_names WHERE trim(coalesce(name, '')) <> ''),
sets AS (
 SELECT *, list_distinct(list_transform(range(1, length(key) + 3), lambda i: substr('  ' || key || '  ', i, 3))) AS grams,
  list_transform(['applied', 'clinical', 'computational', 'experimental', 'theoretical'],
   lambda w: list_contains(string_split_regex(key, '[^a-z0-9]+'), w)) AS marks FROM keys WHERE key <> ''),
pairs AS (
 SELECT a.university, a.key, b.key AS other, CAST(len(list_intersect(a.grams, b.grams)) AS BIGINT) AS n_common, len(a.grams) + len(b.grams) AS n
 FROM sets a JOIN sets b ON a.university = b.university AND a.key < b.key AND a.marks = b.marks)
SELECT university, key, other, n_common, CAST(n - n_common AS BIGINT) AS n_either FROM pairs
WHERE n_common * 1000000 >= (n - n_common) * 700000
""", "fx_unit_names")

oracle("departments_canonical", rf"""
WITH k AS (
 SELECT university, trim(name) AS name, regexp_replace(regexp_replace(regexp_replace(lower(trim(name)), '[ \t]+', ' ', 'g'),
   ', {UNIT}$', ''), '^{UNIT} ', '') AS name_key
 FROM fx_departments WHERE trim(coalesce(name, '')) <> '')
SELECT university, name_key, name, n_spellings FROM (
 SELECT *, row_number() OVER (PARTITION BY university, name_key ORDER BY length(name), name) AS rn,
  count(*) OVER (PARTITION BY university, name_key) AS n_spellings FROM k) WHERE rn = 1
""", "fx_departments")

oracle("results_filtered", """
SELECT CAST(ord AS VARCHAR) AS ord, nullif(email, '') AS email,
 CAST(4 + CASE WHEN coalesce(email, '') <> '' THEN 1 ELSE 0 END AS BIGINT) AS n_fields
FROM fx_records WHERE lower(university) = 'nation_3' AND lower(department) = 'building'
""", "fx_records")

# --- targets ----------------------------------------------------------------

OPEN = "lower(coalesce(status, '')) IN ('', 'none', 'null', 'nan', 'skipped')"
COLS = "university, department, link, status, target_id"
targets_oracle("targets_pending", f"SELECT {COLS} FROM n_targets WHERE department IS NOT NULL AND {OPEN}")
targets_oracle("targets_discovery", f"SELECT {COLS} FROM n_targets WHERE department IS NULL AND lower(coalesce(status, '')) IN ('', 'skipped')")
targets_oracle("targets_missing_link", f"""
SELECT {COLS} FROM n_targets WHERE department IS NOT NULL AND NOT coalesce(starts_with(link, 'http'), false) AND {OPEN}""")
targets_oracle("targets_cleared", """
SELECT count(status) AS n_cleared, CAST(0 AS BIGINT) AS n_left FROM n_targets UNION ALL SELECT 0, 0""")
targets_oracle("targets_forced", """
WITH stored AS (SELECT DISTINCT coalesce(department, '') || '/' || university AS k FROM fx_updates WHERE status = 'completed')
SELECT target_id, coalesce(department, '') || '/' || university NOT IN (SELECT k FROM stored) AS forced FROM n_targets
""", "fx_updates")
targets_oracle("targets_status_applied", """
WITH u AS (
 SELECT university, department, arg_max(status, seq) AS status, arg_max(link, seq) FILTER (WHERE coalesce(link, '') <> '') AS link
 FROM fx_updates GROUP BY university, department)
SELECT t.university, t.department, coalesce(u.link, t.link) AS link, coalesce(u.status, t.status) AS status, t.target_id
FROM n_targets t LEFT JOIN u ON u.university = t.university AND u.department IS NOT DISTINCT FROM t.department
""", "fx_updates")
targets_oracle("target_status_counts", "SELECT coalesce(status, 'pending') AS status, count(*) AS n FROM n_targets GROUP BY 1")
targets_oracle("target_summary", """
WITH b AS (SELECT CASE WHEN lower(status) LIKE '%failed%' OR lower(status) LIKE '%error%' THEN 'f'
  WHEN lower(status) = 'skipped' THEN 's' WHEN lower(status) = 'completed' THEN 'c' ELSE 'p' END AS b FROM n_targets)
SELECT count(*) FILTER (WHERE b = 'c') AS completed, count(*) FILTER (WHERE b = 'f') AS failed,
 count(*) FILTER (WHERE b = 's') AS skipped, count(*) FILTER (WHERE b = 'p') AS pending, count(*) AS total FROM b
""")
targets_oracle("targets_failed", """
SELECT university, department, lower(status) AS error FROM n_targets
WHERE lower(status) LIKE '%failed%' OR lower(status) LIKE '%error%'""")

OUTCOMES = """
WITH per AS (
 SELECT target_id, bool_or(skipped) AS skipped, min(exception) AS exception,
  min(nullif(page_error, '')) FILTER (WHERE page_no = 1) AS first_error,
  coalesce(sum(n_records) FILTER (WHERE nullif(page_error, '') IS NULL), 0) AS n,
  count(*) FILTER (WHERE nullif(page_error, '') IS NOT NULL) AS n_error_pages
 FROM fx_page_results GROUP BY target_id),
outcomes AS (
 SELECT t.target_id, t.university, t.department, t.link,
  CASE WHEN p.skipped THEN 'Skipped' WHEN p.exception IS NOT NULL THEN 'failed: ' || p.exception
   WHEN p.first_error IS NOT NULL THEN 'failed: Listing page issue: ' || p.first_error
   WHEN p.target_id IS NULL THEN 'failed: No page HTML available for scraping.' ELSE 'completed' END AS status,
  CASE WHEN p.exception IS NOT NULL OR p.first_error IS NOT NULL THEN 0 ELSE CAST(coalesce(p.n, 0) AS BIGINT) END AS n_records,
  coalesce(p.n_error_pages, 0) AS n_error_pages
 FROM n_targets t LEFT JOIN per p ON p.target_id = t.target_id)
"""
targets_oracle("target_outcomes", OUTCOMES + "SELECT * FROM outcomes", "fx_page_results")
targets_oracle("run_summary", OUTCOMES + """
SELECT university, count(*) AS total, count(*) FILTER (WHERE lower(status) = 'completed') AS successful,
 count(*) FILTER (WHERE lower(status) LIKE 'failed%') AS failed, count(*) FILTER (WHERE lower(status) = 'skipped') AS skipped
FROM outcomes GROUP BY university
""", "fx_page_results")

# --- lifecycle --------------------------------------------------------------

AFTER_RUN = """
seen AS (
 SELECT record_id, university, department, data, profile_url FROM (
  SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY ord DESC) AS rn FROM fx_seen) WHERE rn = 1),
scopes AS (SELECT DISTINCT university, department FROM fx_seen),
after_run AS (
 SELECT s.record_id, s.university, s.department, s.first_seen,
  CASE WHEN n.record_id IS NOT NULL OR c.university IS NOT NULL THEN TIMESTAMP '2024-03-01 00:00:00' ELSE s.last_seen END AS last_seen,
  CASE WHEN n.record_id IS NOT NULL THEN 'active' WHEN c.university IS NOT NULL THEN 'not_found' ELSE s.status END AS status,
  CASE WHEN n.record_id IS NOT NULL THEN 0 WHEN c.university IS NOT NULL THEN s.runs_not_found + 1 ELSE s.runs_not_found END AS runs_not_found,
  coalesce(n.data, s.data) AS data, coalesce(n.profile_url, s.profile_url) AS profile_url
 FROM fx_stored s LEFT JOIN seen n ON n.record_id = s.record_id
  LEFT JOIN scopes c ON c.university = s.university AND c.department IS NOT DISTINCT FROM s.department
 UNION ALL
 SELECT n.record_id, n.university, n.department, TIMESTAMP '2024-03-01 00:00:00', TIMESTAMP '2024-03-01 00:00:00', 'active', 0,
  n.data, n.profile_url FROM seen n WHERE n.record_id NOT IN (SELECT record_id FROM fx_stored))
"""
FMT = "'%Y-%m-%d %H:%M:%S'"
oracle("lifecycle_after_run", f"""
WITH {AFTER_RUN}
SELECT record_id, university, department, strftime(first_seen, {FMT}) AS first_seen, strftime(last_seen, {FMT}) AS last_seen,
 status, runs_not_found, data, profile_url FROM after_run
""", "fx_stored", "fx_seen")

oracle("lifecycle_archived", f"""
WITH {AFTER_RUN},
moved AS (SELECT * FROM after_run WHERE status = 'not_found' AND runs_not_found >= 2)
SELECT coalesce(a.record_id, m.record_id) AS record_id, coalesce(a.university, m.university) AS university,
 coalesce(a.department, m.department) AS department, strftime(coalesce(a.first_seen, m.first_seen), {FMT}) AS first_seen,
 strftime(coalesce(m.last_seen, a.last_seen), {FMT}) AS last_seen, coalesce(m.data, a.data) AS data,
 strftime(CASE WHEN m.record_id IS NOT NULL THEN TIMESTAMP '2024-03-02 00:00:00' ELSE a.archived_at END, {FMT}) AS archived_at
FROM fx_archive a FULL JOIN moved m ON m.record_id = a.record_id
""", "fx_stored", "fx_seen", "fx_archive")

oracle("lifecycle_live", f"""
WITH {AFTER_RUN}
SELECT record_id, status, runs_not_found FROM after_run WHERE NOT (status = 'not_found' AND runs_not_found >= 2)
""", "fx_stored", "fx_seen")

oracle("records_active", """
SELECT record_id, data FROM fx_stored WHERE status = 'active' AND university = 'NATION_3' AND department = 'BUILDING'
""", "fx_stored")

PLACED = """
seen AS (SELECT DISTINCT run_no, university, department, rec_key FROM fx_sightings),
runs AS (SELECT DISTINCT run_no, university, department FROM fx_sightings),
g AS (
 SELECT s.*, (SELECT count(*) FROM runs r WHERE r.university = s.university AND r.department = s.department
   AND r.run_no < s.run_no AND r.run_no > s.prev) AS gap,
  (SELECT min(r.run_no) FROM runs r WHERE r.university = s.university AND r.department = s.department AND r.run_no > s.run_no) AS after_run
 FROM (SELECT *, lag(run_no) OVER w AS prev, lead(run_no) OVER w AS following FROM seen
  WINDOW w AS (PARTITION BY university, department, rec_key ORDER BY run_no)) s)
"""
oracle("lifecycle_history", f"""
WITH {PLACED},
h AS (
 SELECT university, department, rec_key, max(run_no) FILTER (WHERE prev IS NULL OR gap >= 2) AS first_run, max(run_no) AS last_run,
  count(*) AS n_runs_seen, count(*) FILTER (WHERE prev IS NULL OR gap >= 2) AS n_lives,
  count(*) FILTER (WHERE prev IS NOT NULL AND gap > 0) AS n_returns
 FROM g GROUP BY university, department, rec_key),
m AS (
 SELECT h.*, (SELECT count(*) FROM runs r WHERE r.university = h.university AND r.department = h.department AND r.run_no > h.last_run) AS misses
 FROM h)
SELECT *, CASE WHEN misses = 0 THEN 'active' WHEN misses >= 2 THEN 'archived' ELSE 'not_found' END AS status FROM m
""", "fx_sightings")

oracle("records_as_of", """
WITH seen AS (SELECT DISTINCT * FROM fx_sightings),
runs AS (
 SELECT *, row_number() OVER (PARTITION BY university, department ORDER BY run_no) AS place
 FROM (SELECT DISTINCT university, department, run_no FROM seen)),
placed AS (
 SELECT s.*, r.place, r.place - lag(r.place) OVER (PARTITION BY s.university, s.department, s.rec_key ORDER BY s.run_no) - 1 AS gap
 FROM seen s JOIN runs r USING (university, department, run_no)),
asking AS (SELECT DISTINCT unnest([run_no - 1, run_no, run_no + 1]) AS asked FROM seen),
latest AS (SELECT asked, university, department, max(place) AS now FROM asking JOIN runs ON run_no <= asked GROUP BY ALL),
held AS ( -- every run looks through all sightings up to it
 SELECT asked, university, department, rec_key, max(place) AS place, max(run_no) AS last_run,
  max(run_no) FILTER (WHERE gap IS NULL OR gap >= 2) AS first_run
 FROM asking JOIN placed ON run_no <= asked GROUP BY asked, university, department, rec_key)
SELECT asked AS run_no, university, department, rec_key, first_run, last_run,
 CASE now - place WHEN 0 THEN 'active' WHEN 1 THEN 'not_found' ELSE 'archived' END AS status
FROM held JOIN latest USING (asked, university, department)
""", "fx_sightings")

oracle("lifecycle_run_counts", f"""
WITH {PLACED},
a AS (SELECT run_no, count(*) FILTER (WHERE prev IS NULL) AS arrivals, count(*) FILTER (WHERE prev IS NOT NULL AND gap > 0) AS returns,
 count(*) AS seen FROM g GROUP BY run_no),
d AS (SELECT after_run AS run_no, count(*) AS departures FROM g WHERE after_run IS NOT NULL AND following IS DISTINCT FROM after_run GROUP BY 1)
SELECT a.run_no, arrivals, returns, coalesce(departures, 0) AS departures, seen FROM a LEFT JOIN d ON d.run_no = a.run_no
""", "fx_sightings")

JOBS = """
jobs AS (
 SELECT job_id, arg_max(status, seq) AS status, arg_max_null(error, seq) AS error,
  arg_max(listing_url, seq) FILTER (WHERE listing_url IS NOT NULL) AS listing_url,
  epoch_us(max(ts) FILTER (WHERE status = 'running')) AS last_attempted_us,
  epoch_us(max(ts) FILTER (WHERE status = 'completed')) AS completed_us
 FROM fx_job_events GROUP BY job_id)
"""
oracle("job_state", f"WITH {JOBS} SELECT * FROM jobs", "fx_job_events")
oracle("jobs_by_status", f"WITH {JOBS} SELECT job_id, error FROM jobs WHERE status = 'failed'", "fx_job_events")
oracle("jobs_recent", f"""
WITH {JOBS} SELECT job_id, last_attempted_us FROM jobs ORDER BY last_attempted_us DESC NULLS LAST, job_id""", "fx_job_events")

oracle("records_ordered", """
SELECT university, department, record_id FROM fx_stored ORDER BY university, department, record_id""", "fx_stored")

oracle("rows_numbered", """
SELECT ord, university, department, row_number() OVER (PARTITION BY university, department ORDER BY ord) AS row_no FROM fx_records
""", "fx_records")

# --- a whole run ------------------------------------------------------------

RUN_PARSED = PARSED.replace("page_id, url", "run_no, page_id, url").replace("fx_responses", "fx_run_responses")
oracle("full_run", f"""
WITH {RUN_PARSED},
first AS (SELECT page_id, page_id % 4 >= 2 AS changed, page_id % 2 = 0 AS leaf, page_id % 6 >= 3 AS ok1 FROM pages),
second AS (
 SELECT *, page_id % 7 <> 0 AND NOT (ok1 AND leaf AND NOT changed) AND (page_id + 1) % 6 >= 3 AS ok2 FROM first),
third AS (
 SELECT page_id, CASE WHEN NOT ((ok1 OR ok2) AND leaf AND (ok2 OR NOT changed)) THEN 3 WHEN ok2 THEN 2 ELSE 1 END AS run_no FROM second),
recs AS (
 SELECT p.page_id, url, j, unnest(from_json(j->'$.records', '["JSON"]')) AS r
 FROM parsed p JOIN third t ON t.page_id = p.page_id AND t.run_no = p.run_no WHERE parse_status = 'ok'),
named AS (SELECT *, lower(split_part(regexp_replace(split_part(url, '://', 2), '[/?#].*$', ''), ':', 1)) AS host FROM recs)
SELECT 'P' || CAST(page_id AS VARCHAR) || '/' || host AS _source_key,
 coalesce(r->>'$.title', r->>'$.field_1', r->>'$.Title', '') AS "Title", coalesce(r->>'$.field_2', '') AS "Full Name",
 coalesce(CASE WHEN json_exists(r, '$.field_3') THEN r->>'$.field_3' ELSE r->>'$.Email' END, '') AS "Email",
 j->>'$.static_values.field_4' AS "Unit", host AS "Institution"
FROM named
""", "fx_run_responses")

# --- streams ----------------------------------------------------------------

oracle("stream_page_changes", f"""
WITH {CHANGES}
SELECT url, 'new' AS status, 0 AS batch_id FROM fp WHERE run_no = 1
UNION ALL SELECT url, status, 1 FROM changes WHERE new_fingerprint IS NOT NULL
""", "fx_snapshots")
oracle("stream_dedup", "SELECT event_id, user_id FROM events")

"""The same answers as :mod:`rawharbor.plans.table_queries`, in plain SQL."""

from __future__ import annotations

from rawharbor.plans.table_queries import CATALOG_QUERIES, LINK_QUERIES

# Fixed values, stated here once more so that these answers do not depend on the package.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null",
)


def text_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def numbered(queries) -> str:
    rows = ", ".join(f"({i}, '{q}')" for i, q in enumerate(queries))
    return f"(SELECT CAST(query_id AS BIGINT) AS query_id, query FROM (VALUES {rows}) AS v(query_id, query))"


LABELLED = "(SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"

VERDICTS = f"""(
  SELECT source, rows, nulls, CAST(2 AS BIGINT) AS columns, nulls / (rows * 2.0::DOUBLE) AS density,
    CASE WHEN nulls / (rows * 2.0::DOUBLE) > 0.6 THEN 'rejected' ELSE 'passed' END AS status,
    CASE WHEN nulls / (rows * 2.0::DOUBLE) > 0.6
      THEN 'null density exceeds 60% (' || printf('%.2f%%', nulls / (rows * 2.0::DOUBLE) * 100) || ')' END AS message
  FROM (SELECT source, CAST(count(*) AS BIGINT) AS rows,
               CAST(2 * count(*) - count(quality) - count(toxic) AS BIGINT) AS nulls
        FROM {LABELLED} GROUP BY source))"""


def dictionary(frame: str, columns, where: str = "") -> str:
    parts = [
        f"SELECT {where}CAST({i} AS BIGINT) AS ordinal, '{c}' AS \"column\", "
        f"CAST(count(*) - count({c}) AS BIGINT) AS nulls, CAST(count(*) AS BIGINT) AS rows, "
        f"CAST({len(columns)} AS BIGINT) AS columns FROM {frame}" + (" GROUP BY lang" if where else "")
        for i, c in enumerate(columns, 1)
    ]
    return " UNION ALL ".join(parts)


def width(ordinal: int, column: str, frame: str, shown: str, missing: int, extra: int = 0) -> str:
    """Longest shown value or header, plus 2."""
    return f"""SELECT CAST({ordinal} AS BIGINT) AS ordinal, '{column}' AS "column", CAST(least(100, 2 + greatest({len(column)},
        CASE WHEN count(*) = 0 THEN 0 WHEN count({column}) = 0 THEN 4
             WHEN count({column}) < count(*) THEN greatest(max(length({shown})) + {extra}, {missing})
             ELSE max(length({shown})) END)) AS BIGINT) AS width FROM {frame}"""


EVENTS_TEXT = """(SELECT
    CASE WHEN event_type = 'error' THEN 'N/A' ELSE CAST(event_id AS VARCHAR) END AS event_id,
    strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts,
    CASE WHEN event_type = 'error' THEN 'N/A' ELSE printf('%.2f', value) END AS value,
    CASE event_type WHEN 'click' THEN 'True' WHEN 'view' THEN 'FALSE' ELSE 'None' END AS clicked,
    CASE WHEN event_type = 'error' THEN 'N/A' ELSE event_type END AS event_type,
    'nan' AS nothing FROM events)"""


def na(column: str) -> str:
    return f"CASE WHEN {column} IN ({text_list(NA_TOKENS)}) THEN NULL ELSE {column} END"


def inferred(columns) -> str:
    parts = []
    for i, c in enumerate(columns, 1):
        parts.append(f"""SELECT CAST({i} AS BIGINT) AS ordinal, '{c}' AS "column", CASE
            WHEN count(v) = 0 THEN 'string'
            WHEN count(v) = count(CASE WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN 1 END) THEN 'bigint'
            WHEN count(v) = count(TRY_CAST(v AS DOUBLE)) THEN 'double'
            WHEN count(v) = count(CASE WHEN lower(v) IN ('true', 'false') THEN 1 END) THEN 'boolean'
            ELSE 'string' END AS type FROM (SELECT {na(c)} AS v FROM {EVENTS_TEXT})""")
    return " UNION ALL ".join(parts)


LINKS = r"""(SELECT page_id, CAST(unnest(range(len(hrefs))) AS BIGINT) AS position, unnest(hrefs) AS href
  FROM (SELECT page_id, regexp_extract_all(
    regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g'),
    '(?is)<a\s[^>]*?\bhref\s*=\s*"([^"]*)"', 1) AS hrefs FROM pages))"""


def best_match(requests: str) -> str:
    return f"""SELECT query_id, query, did, name, size_info FROM {requests} LEFT JOIN (
      SELECT query AS q, p_partkey AS did, p_name AS name,
             printf('%d rows, %d columns', p_size, length(p_type)) AS size_info
      FROM (SELECT DISTINCT query FROM {requests}) r JOIN part ON regexp_matches(p_name, query, 'i')
      QUALIFY row_number() OVER (PARTITION BY query ORDER BY p_size DESC NULLS LAST, p_partkey) = 1) ON q = query"""


def link_match(requests: str) -> str:
    return f"""WITH links AS MATERIALIZED (SELECT * FROM {LINKS} WHERE href LIKE '%n')
      SELECT query_id, query, page_id, position, href FROM {requests} LEFT JOIN (
        SELECT query AS q, page_id, position, href
        FROM (SELECT DISTINCT query FROM {requests}) r JOIN links ON contains(lower(href), lower(query))
        QUALIFY row_number() OVER (PARTITION BY query ORDER BY page_id, position) = 1) ON q = query"""


BULK_CATALOG = r"""(SELECT DISTINCT query AS query_id, query FROM (SELECT unnest([upper(n), f, l, '^' || f, l || '$',
    '(' || f || '|' || l || ')$', f || '.*' || l, '[' || left(f, 2) || ']+ ' || l]) AS query
  FROM (SELECT DISTINCT p_name AS n, split_part(p_name, ' ', 1) AS f, split_part(p_name, ' ', -1) AS l FROM part)))"""

# An opened bracket is no pattern.
BROKEN_CATALOG = "(SELECT DISTINCT '(' || split_part(p_name, ' ', 1) AS query FROM part)"

BULK_LINKS = r"""(SELECT DISTINCT query AS query_id, query FROM (
  SELECT unnest(regexp_extract_all(text, '\p{L}+')) AS query FROM benchmark))"""

REQUESTS = """(SELECT p_partkey AS request_id, CASE p_type WHEN 'ECONOMY' THEN 'all' WHEN 'SMALL' THEN ' SEC , kaggle'
    WHEN 'MEDIUM' THEN 'sec' WHEN 'PROMO' THEN ' ' WHEN 'STANDARD' THEN 'myspace,fred' WHEN 'LARGE' THEN 'yfinance' END AS sources,
    CASE WHEN p_size < 10 THEN p_name || ' Video Game' WHEN p_size = 25 THEN '  ' ELSE p_name END AS topic FROM part)"""

PARSED = f"""(SELECT request_id, CASE WHEN trim(topic) = '' THEN 'finance' ELSE trim(topic) END AS topic,
    CASE WHEN trim(sources) = '' THEN ['kaggle'] ELSE list_transform(string_split(lower(sources), ','), lambda x: trim(x)) END AS sources
    FROM {REQUESTS})"""

WARNED = f"""(SELECT *, list_contains(sources, 'sec') AND regexp_matches(lower(topic), 'movie|game|sports|anime') AS warned FROM {PARSED})"""

DROPPED = f"""(SELECT * REPLACE (CASE WHEN NOT warned THEN sources WHEN len(list_filter(sources, lambda x: x <> 'sec')) = 0 THEN ['kaggle']
    ELSE list_filter(sources, lambda x: x <> 'sec') END AS sources) FROM {WARNED})"""


def fan_out(parsed: str) -> str:
    return f"""(SELECT request_id, topic, warned, CAST(unnest(range(len(s))) AS BIGINT) AS position, unnest(s) AS source
      FROM (SELECT *, flatten(list_transform(sources, lambda x: CASE WHEN x = 'all' THEN ['kaggle', 'openml'] ELSE [x] END)) AS s
            FROM {parsed}))"""


REGISTRY = """(VALUES ('airbnb', 'airbnb', '{}'), ('fred', 'fred', 'https://fred.stlouisfed.org/series/{}'),
  ('kaggle', 'kaggle', 'https://www.kaggle.com/datasets/{}'), ('openml', 'openml', 'https://www.openml.org/d/{}'),
  ('sec', 'sec', 'https://data.sec.gov/api/xbrl/companyfacts/CIK{}.json'),
  ('yfinance', 'yahoofinance', 'https://finance.yahoo.com/quote/{}')) AS registry(source, dir_name, url_template)"""

ITEM_COLUMNS = (
    "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, "
    "l_returnflag, l_linestatus, l_shipdate"
)
SLUG = "lower(regexp_replace({}, '[^a-zA-Z0-9_-]+', '_', 'g'))"
STEM = "lower(replace(trim(regexp_replace({}, '[^\\p{{L}}\\p{{N}} _-]', '', 'g')), ' ', '_')) || '_raw.csv'"

SQL = {
    "data_dictionary": dictionary(LABELLED, ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]),
    "description_text": f"""SELECT lang, 'Dataset Topic: Corpus ' || lang || chr(10) || 'Total Rows: ' || any_value(rows) || chr(10)
        || 'Total Columns: ' || any_value(columns) || chr(10) || 'Format: Raw CSV' || chr(10) || chr(10) || 'Columns present:' || chr(10)
        || string_agg('- ' || "column" || ' (Nulls: ' || nulls || ')', chr(10) ORDER BY ordinal) AS value
        FROM ({dictionary(LABELLED, ["doc_id", "text", "source", "n_chars", "quality", "toxic"], "lang, ")}) GROUP BY lang""",
    "null_density_gate": f"SELECT * REPLACE (round(density, 9) AS density) FROM {VERDICTS}",
    "gate_threshold_edges": """
        WITH d AS (SELECT o_orderpriority AS dataset, CAST(count(*) AS BIGINT) AS rows, CAST(sum(
            CASE o_orderpriority WHEN '3-MEDIUM' THEN 0 WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 4 + CAST(o_orderstatus = 'F' AS INT)
            ELSE 5 END) AS BIGINT) AS nulls FROM orders GROUP BY 1)
        SELECT dataset, rows, nulls, CASE WHEN nulls / (rows * 5.0::DOUBLE) > 0.8 THEN 'rejected' ELSE 'passed' END AS status,
            CASE WHEN nulls / (rows * 5.0::DOUBLE) > 0.8
              THEN 'null density exceeds 80% (' || printf('%.2f%%', nulls / (rows * 5.0::DOUBLE) * 100) || ')' END AS message FROM d
        UNION ALL SELECT r_name, 0, 0, 'empty', 'dataset is completely empty' FROM region""",
    "passed_rows_only": f"""SELECT doc_id, source, quality, toxic FROM {LABELLED}
        WHERE source IN (SELECT source FROM {VERDICTS} WHERE status = 'passed')""",
    "batch_outcome": f"""SELECT CAST(count(*) AS BIGINT) AS datasets, CAST(count(*) FILTER (status = 'passed') AS BIGINT) AS passed,
        CAST(count(*) FILTER (status = 'rejected') AS BIGINT) AS rejected, CAST(0 AS BIGINT) AS empty FROM {VERDICTS}""",
    "column_widths": " UNION ALL ".join(
        width(i, c, "customer", f"CAST({c} AS VARCHAR)", 4)
        for i, c in enumerate(["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], 1)
    ),
    "column_widths_missing": " UNION ALL ".join(
        width(i, c, f"(SELECT doc_id, source, quality, CASE WHEN quality = 1 THEN lang END AS lang, NULL AS nothing FROM {LABELLED})",
              f"CAST({c} AS VARCHAR)", missing, extra)
        for i, (c, missing, extra) in enumerate(
            [("doc_id", 3, 2), ("source", 4, 0), ("quality", 3, 2), ("lang", 4, 0), ("nothing", 4, 0)], 1)
    ),
    "infer_types": inferred(["event_id", "ts", "value", "clicked", "event_type", "nothing"]),
    "na_tokens": "SELECT " + ", ".join(f"{na(c)} AS {c}" for c in ("event_id", "value", "clicked", "event_type", "nothing"))
        + f" FROM {EVENTS_TEXT}",
    "facts_flatten": """SELECT user_id, event_type AS taxonomy, strftime(ts, '%Y-%m-%d') AS concept,
        'unit-' || CAST(json_extract(props, '$.k') AS VARCHAR) AS unit, value AS val, CAST(year(ts) AS BIGINT) AS fy,
        'Q' || quarter(ts) AS fp, event_type AS form, strftime(ts, '%Y-%m-%d') AS filed,
        strftime(ts, '%Y-%m-%d %H:%M:%S') AS "end" FROM events""",
    "observations_flatten": "SELECT user_id, strftime(ts, '%Y-%m-%d') AS date, printf('%.2f', value) AS value FROM events",
    "observation_rejects": """SELECT user_id, CAST(event_id // 1024 AS BIGINT) AS block, 'no observations returned' AS reason
        FROM events GROUP BY 1, 2 HAVING count(*) FILTER (event_type = 'purchase') = 0""",
    "keyed_object_scan": """SELECT c_custkey AS ordinal, CAST(c_custkey AS VARCHAR) AS cik_str,
        c_mktsegment || '-' || c_nationkey AS ticker, c_name AS title FROM customer""",
    "id_index_lookup": """
        WITH r AS (SELECT s_suppkey AS query_id, CASE WHEN s_acctbal > 8000 THEN 'BUILDING' WHEN s_acctbal > 1000 THEN 'machinery'
              ELSE 'Absent' END || '-' || s_nationkey AS query FROM supplier),
          f AS (SELECT lower(c_mktsegment || '-' || c_nationkey) AS ticker, min(c_custkey) AS cik, arg_min(c_name, c_custkey) AS title
              FROM customer GROUP BY 1)
        SELECT query_id, query, lpad(CAST(cik AS VARCHAR), 10, '0') AS cik, title FROM r LEFT JOIN f ON ticker = lower(query)""",
    "page_links": f"SELECT * FROM {LINKS}",
    "html_table_rows": """SELECT CAST(p_partkey // 1024 AS BIGINT) AS block, p_partkey, p_name,
        CASE WHEN p_size > 10 THEN p_brand END AS brand FROM part""",
    "catalog_best_match": best_match(numbered(CATALOG_QUERIES)),
    "catalog_match_bulk": f"""SELECT *, false AS rejected FROM ({best_match(BULK_CATALOG)})
        UNION ALL SELECT query, query, NULL, NULL, NULL, true FROM {BROKEN_CATALOG}""",
    "first_link_match": link_match(numbered(LINK_QUERIES)),
    "link_match_bulk": link_match(BULK_LINKS),
    "known_sources": f"""SELECT request_id, source, dir_name, url_template FROM (
        SELECT request_id, lower(sources) AS source FROM {REQUESTS}) JOIN {REGISTRY} USING (source)""",
    "unknown_sources": f"""SELECT request_id, lower(sources) AS source FROM {REQUESTS}
        WHERE lower(sources) NOT IN (SELECT source FROM {REGISTRY})""",
    "largest_member": """SELECT source, doc_id, n_chars FROM documents
        QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) = 1""",
    "file_tree_largest": """SELECT source AS archive, lang AS key, size FROM (
        SELECT source, lang, CAST(11 * count(*) AS BIGINT) AS size FROM documents GROUP BY source, lang)
        QUALIFY row_number() OVER (PARTITION BY source ORDER BY size DESC, lang) = 1""",
    "active_keys_history": """WITH p AS (SELECT user_id, event_id, ts, value FROM events)
        SELECT * FROM p WHERE user_id IN (SELECT user_id FROM p WHERE ts > (SELECT max(ts) FROM p) - INTERVAL 5 DAY)""",
    "append_target": "SELECT doc_id, lang, n_chars, quality FROM documents LEFT JOIN labels USING (doc_id)",
    "outer_concat_target": """SELECT doc_id, lang, n_chars, quality, toxic
        FROM (SELECT doc_id, lang, n_chars FROM documents) FULL OUTER JOIN labels USING (doc_id)""",
    "outer_concat_rows": """SELECT * FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS position, doc_id, n_chars FROM documents)
        FULL OUTER JOIN (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS position, doc_id AS doc_id_target, quality, toxic FROM labels)
        USING (position)""",
    "topic_slug": f"SELECT doc_id, {SLUG.format('text')} AS slug FROM documents",
    "safe_stem": f"SELECT doc_id, {STEM.format('text')} AS file_name FROM documents",
    "host_key": r"""SELECT page_id, lower(regexp_replace(split_part(regexp_replace(regexp_replace(url, '^https?://', '', 'i'),
        '^www\.', '', 'i'), '/', 1), '[<>:"/|?* ]+', '_', 'g')) AS host FROM pages""",
    "dataset_name": r"""
        WITH n AS (SELECT page_id, split_part(regexp_replace(url, '[?#].*$', '') || '_raw_v1.raw_raw.csv', '/', -1) AS a,
            split_part(url, '/', -1) AS b FROM pages)
        SELECT page_id, replace(regexp_replace(a, '^(\.*[^.].*)\.[^.]*$', '\1'), '_raw', '') AS name,
            replace(regexp_replace(b, '^(\.*[^.].*)\.[^.]*$', '\1'), '_raw', '') AS url_name FROM n""",
    "sheet_name": "SELECT c_custkey, left(c_name || '_' || c_mktsegment || '_çé_export', 31) AS sheet FROM customer",
    "slug_collisions": f"""SELECT {SLUG.format('q')} AS slug, CAST(count(DISTINCT q) AS BIGINT) AS queries, min(q) AS first_query,
        max(q) AS last_query FROM (SELECT CASE WHEN p_size > 25 THEN upper(p_name) ELSE replace(p_name, ' ', '! ') END AS q FROM part)
        GROUP BY 1 HAVING count(DISTINCT q) > 1""",
    "row_limit_parse": """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'all' WHEN '2-HIGH' THEN 'all' WHEN '3-MEDIUM'
        THEN 'abort' WHEN '4-NOT SPECIFIED' THEN 'invalid' ELSE 'limit' END AS action,
        CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 0 WHEN '5-LOW' THEN o_orderkey END AS row_limit FROM orders""",
    "zero_padded_ids": """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '123456789012' || o_custkey
        WHEN 'P' THEN CASE WHEN o_custkey = 0 THEN '0000000000' ELSE '-' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END
        ELSE lpad(CAST(o_custkey AS VARCHAR), 10, '0') END AS padded FROM orders""",
    "source_urls": """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'https://fred.stlouisfed.org/series/' || c_name
        WHEN 'MACHINERY' THEN 'https://data.sec.gov/api/xbrl/companyfacts/CIK' || c_name || '.json'
        WHEN 'FURNITURE' THEN 'https://finance.yahoo.com/quote/' || c_name
        WHEN 'HOUSEHOLD' THEN 'https://www.kaggle.com/datasets/' || c_name END AS url FROM customer""",
    "size_texts": "SELECT p_partkey, (p_partkey * 1000) || ' rows, ' || p_size || ' columns' AS size_info FROM part",
    "list_parse": "SELECT c_custkey, lower(c_mktsegment) || '|' || lower(c_name) || '||x' AS parsed FROM customer",
    "agent_identity": """SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN c_mktsegment || '@example.org'
        ELSE 'rawharbor/1.0 (' || c_name || ')' END AS agent FROM customer""",
    "float_texts": """SELECT o_orderkey, CAST(o_totalprice AS VARCHAR) AS plain, CAST(o_totalprice * 1024.0::DOUBLE AS VARCHAR) AS large,
        CAST(o_totalprice * -0.0078125::DOUBLE AS VARCHAR) AS negative FROM orders""",
    "percent_texts": "SELECT l_orderkey, l_linenumber, printf('%.2f%%', l_discount * 100) AS discount FROM lineitem",
    "row_limited": f"""SELECT * FROM lineitem ORDER BY l_shipdate, {ITEM_COLUMNS} LIMIT 5000""",
    "row_limited_short": f"SELECT * FROM lineitem ORDER BY {ITEM_COLUMNS} LIMIT 500",
    "capped_export": f"""SELECT *, (SELECT count(*) FROM lineitem) > 20000 AS truncated FROM lineitem
        ORDER BY {ITEM_COLUMNS} LIMIT 20000""",
    "key_page": "SELECT * FROM orders WHERE o_orderkey > 4000 ORDER BY o_orderkey LIMIT 750",
    "raw_preservation_check": """SELECT event_type, value, CAST(sum(s) AS BIGINT) AS surplus FROM (
        SELECT event_type, value, 1 AS s FROM events UNION ALL
        SELECT event_type, CASE WHEN event_type = 'signup' THEN value + 1 ELSE value END, -1 FROM events WHERE event_type <> 'error')
        GROUP BY 1, 2 HAVING sum(s) <> 0""",
    "csv_roundtrip": "SELECT * FROM events",
    "csv_text_roundtrip": "SELECT * FROM documents",
    "csv_splitting_scan": "SELECT * FROM documents",
    "csv_stray_quotes": """SELECT doc_id, n_chars || '" wide' AS size, text, lang || '"a' AS mark, 'b' AS more FROM documents""",
    "csv_roundtrip_diff": "SELECT *, CAST(1 AS BIGINT) AS surplus FROM events WHERE event_id IS NULL",
    "gzip_csv_scan": "SELECT * FROM orders",
    "csv_inferred_scan": f"""SELECT TRY_CAST(event_id AS BIGINT) AS event_id, ts, TRY_CAST(value AS DOUBLE) AS value,
        TRY_CAST(nullif(clicked, 'None') AS BOOLEAN) AS clicked, nullif(event_type, 'N/A') AS event_type,
        CAST(NULL AS VARCHAR) AS nothing FROM {EVENTS_TEXT}""",
    "raw_layout": """SELECT lower(source) AS source, 'CSV' AS format, 'topic_' || lang AS topic, CAST(count(*) AS BIGINT) AS rows,
        CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY ALL""",
    "export_all_sheets": """SELECT *, CAST((row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
        l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1) // 25000 + 1 AS BIGINT) AS sheet FROM lineitem""",
    "ingest_literal": """SELECT '1234567890' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS id,
        '00' || o_custkey AS code, o_custkey || '.500' AS price FROM orders""",
    "key_pages_all": f"""SELECT *, rank // ((SELECT count(*) + 3 FROM lineitem) // 4) AS page
        FROM (SELECT *, row_number() OVER (ORDER BY {ITEM_COLUMNS}) - 1 AS rank FROM lineitem)""",
    "key_page_index": f"""SELECT rank // 1000 AS page, {ITEM_COLUMNS}, least(1000, (SELECT count(*) FROM lineitem) - rank) AS rows
        FROM (SELECT *, row_number() OVER (ORDER BY {ITEM_COLUMNS}) - 1 AS rank FROM lineitem) WHERE rank % 1000 = 0""",
    "key_page_far": f"SELECT * FROM lineitem ORDER BY {ITEM_COLUMNS} LIMIT 1000 OFFSET 37000",
    "facts_literal": """SELECT event_id, '12345678901234567890' || lpad(CAST(event_id AS VARCHAR), 8, '0') || '.5' AS val,
        CASE event_id % 4 WHEN 0 THEN 'FY' || year(ts) WHEN 1 THEN CAST(year(ts) AS VARCHAR) WHEN 2 THEN CAST(year(ts) AS VARCHAR) END AS fy,
        CAST(NULL AS VARCHAR) AS fp FROM events""",
    "ingest_batch": """SELECT * FROM (VALUES (0::BIGINT, 'orders', 'passed', (SELECT count(*) FROM orders)),
        (1, 'customer', 'passed', (SELECT count(*) FROM customer)), (2, 'part', 'passed', (SELECT count(*) FROM part)),
        (3, 'sparse', 'failed', NULL), (4, 'absent', 'failed', NULL)) AS v(number, topic, status, rows)""",
    "ingest_run": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 3000",
    "export_sheet": """SELECT *, (SELECT count(*) FROM customer) > 1200 AS truncated FROM customer
        ORDER BY c_custkey LIMIT 1200""",
    "published_table": "SELECT * FROM part",
    "publish_run": """SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice,
        CAST(1 AS BIGINT) AS sheet, p_name AS exported FROM part""",
    "chunked_table_load": "SELECT * FROM events",
    "chunk_verdicts": "SELECT 'passed' AS status, CAST(count(*) AS BIGINT) AS rows, CAST(3 AS BIGINT) AS batches FROM events",
    "rate_audit_hourly": """SELECT date_trunc('hour', ts) AS window_start, CAST(count(*) AS BIGINT) AS requests FROM events
        GROUP BY 1 HAVING count(*) > 17""",
    "rate_audit_by_key": """SELECT date_trunc('minute', ts) AS window_start, event_type, CAST(count(*) AS BIGINT) AS requests FROM events
        GROUP BY 1, 2 HAVING count(*) > 1""",
    "rolling_rate_all": """SELECT DISTINCT ts, requests FROM (SELECT ts, count(*) OVER (ORDER BY ts
        RANGE BETWEEN INTERVAL 599999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS requests FROM events) WHERE requests > 4""",
    "rolling_rate_by_key": """SELECT DISTINCT ts, event_type, requests FROM (SELECT ts, event_type, count(*) OVER (PARTITION BY event_type ORDER BY ts
        RANGE BETWEEN INTERVAL 59999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS requests FROM events) WHERE requests > 1""",
    "request_plan": f"""SELECT request_id, position, source, topic, warned,
        CASE WHEN dir_name IS NULL THEN 'unknown source' ELSE 'planned' END AS status, dir_name AS folder,
        {SLUG.format('topic')} AS slug, {STEM.format('topic')} AS file_name
        FROM {fan_out(WARNED)} LEFT JOIN {REGISTRY} USING (source)""",
    "request_plan_dropped": f"""SELECT source, warned, CASE WHEN dir_name IS NULL THEN 'unknown source' ELSE 'planned' END AS status,
        CAST(count(*) AS BIGINT) AS requests FROM {fan_out(DROPPED)} LEFT JOIN {REGISTRY} USING (source) GROUP BY ALL""",
    "data_paths": r"""SELECT * FROM (SELECT doc_id, source || CASE lang WHEN 'en' THEN '/data/' WHEN 'fr' THEN '/src/' ELSE '/raw/' END
        || doc_id || CASE WHEN n_chars > 2000 THEN '.csv' WHEN n_chars > 1000 THEN '.xlsx' ELSE '.py' END AS path FROM documents)
        WHERE path NOT LIKE '%/src/%' AND path NOT LIKE '%.py'""",
    "user_tables": "SELECT p_partkey, 'Dolt_' || replace(p_name, ' ', '_') AS name FROM part WHERE p_size >= 20",
    "missing_columns": """SELECT DISTINCT c AS "column" FROM (SELECT 'p_' || lang AS c FROM documents
        UNION ALL SELECT 'p_' || split_part(p_name, ' ', 1) FROM part)""",
}

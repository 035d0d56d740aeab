"""DuckDB spellings of the derived views (see ``quire.sources.fixtures``).

Used only to build the oracle SQL strings of ``__spark_entry__.oracle_sql``;
the driver tables are pre-registered views in the oracle's database.
"""

from __future__ import annotations

VIEWS = {
    "companies": """
SELECT n_name AS company_name, concat('T', lpad(cast(n_nationkey AS varchar), 2, '0')) AS ticker, cast(n_nationkey AS bigint) AS load_seq FROM nation
UNION ALL SELECT n_name, concat('X', lpad(cast(n_nationkey AS varchar), 2, '0')), cast(n_nationkey + 100 AS bigint) FROM nation WHERE n_nationkey < 2
UNION ALL SELECT concat(n_name, ' (Holdings)'), concat('H', lpad(cast(n_nationkey AS varchar), 2, '0')), cast(n_nationkey + 200 AS bigint) FROM nation WHERE n_nationkey = 3""",
    "announcements": """
SELECT concat('T', lpad(cast(c.c_nationkey AS varchar), 2, '0')) AS ticker,
  concat('https://example.invalid/', cast(o.o_orderkey AS varchar)) AS url,
  concat('T', lpad(cast(c.c_nationkey AS varchar), 2, '0'), '_', cast(cast(o.o_orderdate AS date) AS varchar), '_', cast(o.o_orderkey AS varchar), '.md') AS key,
  CASE o.o_orderkey % 12 WHEN 0 THEN 'Quarterly Cashflow Report' WHEN 1 THEN 'Appendix 3B' WHEN 2 THEN 'Appendix 2A'
    WHEN 3 THEN 'Placement' WHEN 4 THEN 'Trading Halt' WHEN 5 THEN 'Investor Presentation' WHEN 6 THEN 'Pre-Feasibility Study (PFS)'
    WHEN 7 THEN 'JORC Resource Update' WHEN 8 THEN 'Renounceable Issue' WHEN 9 THEN 'Annual Report'
    WHEN 11 THEN 'Appendix 3G, Security Purchase Plan' END AS announcement_types,
  cast(o.o_orderdate AS date) AS date, o.o_orderstatus = 'F' AS is_price_sensitive
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
UNION ALL
SELECT concat('T', lpad(cast(c.c_nationkey AS varchar), 2, '0')), concat('https://example.invalid/', cast(o.o_orderkey AS varchar)),
  concat('T', lpad(cast(c.c_nationkey AS varchar), 2, '0'), '_', cast(cast(o.o_orderdate AS date) AS varchar), '_', cast(o.o_orderkey AS varchar), '.md'),
  'Trading Halt', cast(o.o_orderdate AS date) + 40, NOT (o.o_orderstatus = 'F')
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderkey % 20 = 3""",
    "requests": """
SELECT event_id AS request_id, user_id AS session_id, ts,
  CASE WHEN event_id % 97 = 0 THEN NULL ELSE concat('T', lpad(cast((user_id + event_id % 3) % 25 AS varchar), 2, '0')) END AS ticker,
  CASE WHEN event_id % 4 = 0 THEN DATE '1996-01-01' ELSE DATE '1998-01-01' END AS date_from,
  CASE WHEN event_id % 5 = 0 THEN DATE '1998-12-31' ELSE DATE '2001-12-31' END AS date_to,
  value > 20 AS price_sensitive,
  list_filter(string_split(CASE WHEN event_id % 11 = 0 THEN 'Mining studies/resources' WHEN event_id % 13 = 0 THEN 'Unknown label'
    WHEN event_type = 'view' THEN 'Placements' WHEN event_type = 'signup' THEN 'Placements|Shares 3B''s, 2A''s'
    WHEN event_type = 'error' THEN 'Presentations' WHEN event_type = 'purchase' THEN 'Cashflow Reports' ELSE '' END, '|'), lambda x: x <> '') AS types,
  event_type
FROM events""",
    "filings": """
SELECT ticker, concat('https://example.invalid/', name) AS url, concat(name, '.md') AS key,
  unnest(CASE WHEN again THEN ['Trading Halt'] ELSE [types] END) AS announcement_types,
  CASE WHEN again THEN day + 40 ELSE day END AS date, CASE WHEN again THEN NOT sensitive ELSE sensitive END AS is_price_sensitive
FROM (SELECT CASE WHEN o_custkey % 20 = 0 THEN 'C000000' ELSE concat('C', lpad(cast(o_custkey // 10 + 1 AS varchar), 6, '0')) END AS ticker,
    concat(cast(l_orderkey AS varchar), '_', cast(l_linenumber AS varchar)) AS name,
    CASE l_partkey % 12 WHEN 0 THEN 'Quarterly Cashflow Report' WHEN 1 THEN 'Appendix 3B' WHEN 2 THEN 'Appendix 2A'
      WHEN 3 THEN 'Placement' WHEN 4 THEN 'Trading Halt' WHEN 5 THEN 'Investor Presentation' WHEN 6 THEN 'Pre-Feasibility Study (PFS)'
      WHEN 7 THEN 'JORC Resource Update' WHEN 8 THEN 'Renounceable Issue' WHEN 9 THEN 'Annual Report'
      WHEN 11 THEN 'Appendix 3G, Security Purchase Plan' END AS types,
    cast(l_shipdate AS date) AS day, l_returnflag = 'R' AS sensitive,
    unnest(CASE WHEN l_orderkey % 20 = 3 AND l_linenumber = 1 THEN [false, true] ELSE [false] END) AS again
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "market_requests": """
SELECT o_orderkey AS request_id, o_custkey AS session_id, cast(o_orderdate AS timestamp) + to_seconds(o_orderkey % 86400) AS ts,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN asked % 20 = 0 THEN 'C000000'
    ELSE concat('C', lpad(cast(asked // 10 + 1 AS varchar), 6, '0')) END AS ticker,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE as_of - cast(20 + (o_orderkey * 7) % 500 AS int) END AS date_from,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE as_of - cast((o_orderkey % 9) * 10 AS int) END AS date_to,
  o_totalprice > 150000 AS price_sensitive,
  CASE WHEN o_orderkey % 11 = 0 THEN ['Mining studies/resources'] WHEN o_orderkey % 13 = 0 THEN ['Unknown label']
    WHEN o_orderkey % 3 = 0 THEN ['Placements', 'Cashflow Reports'] WHEN o_orderkey % 3 = 1 THEN ['Shares 3B''s, 2A''s'] ELSE [] END AS types,
  as_of, o_orderkey % 6 <> 0 AS ack
FROM (SELECT *, cast(o_orderdate AS date) AS as_of, o_custkey + CASE WHEN o_orderkey % 4 = 0 THEN 10 ELSE 0 END AS asked FROM orders)""",
    "response_events": """
SELECT c.conv_id * 1000 + c.turn AS response_id, cast(g.i * 10 AS bigint) AS seq, 'response.output_text.delta' AS type,
  substring(c.text, cast(g.i * 16 + 1 AS int), 16) AS delta, cast(NULL AS varchar) AS ann_type, cast(NULL AS varchar) AS filename,
  cast(NULL AS varchar) AS url, cast(NULL AS varchar) AS title, cast(NULL AS boolean) AS is_object
FROM (SELECT conv_id, turn, role, CASE WHEN conv_id % 3 = 0 THEN text || chr(10) || '- Source: T' || cast(conv_id AS varchar) || '.md' || chr(10)
  || 'Confidence Score: ' || CASE WHEN conv_id % 10 = 0 THEN '1.0' ELSE '0.' || cast(conv_id % 10 AS varchar) END ELSE text END AS text
  FROM conversations) c, unnest(range(0, cast(ceil(length(c.text) / 16.0) AS bigint))) AS g(i) WHERE c.role = 'assistant'
UNION ALL
SELECT c.conv_id * 1000 + c.turn, cast(g.i * 10 + 1 AS bigint), 'response.output_text.annotation.added', NULL, 'file_citation',
  CASE WHEN (c.conv_id + g.i) % 5 = 0 THEN 'malformed.pdf' ELSE concat('T', cast(c.conv_id % 3 AS varchar), '_x_', cast((c.conv_id + g.i) % 2 AS varchar), '.v1.pdf') END, NULL, NULL, c.conv_id % 3 = 1
FROM conversations c, unnest(range(0, 4)) AS g(i) WHERE c.role = 'assistant' AND c.turn >= 1 AND c.conv_id % 4 <> 3
UNION ALL
SELECT c.conv_id * 1000 + c.turn, cast(g.i * 10 + 2 AS bigint), 'response.output_text.annotation.added', NULL,
  CASE WHEN c.conv_id % 3 = 1 THEN 'url_citation' ELSE 'web_citation' END, NULL,
  concat('https://example.invalid/w', cast(c.conv_id % 6 AS varchar)), CASE WHEN g.i = 0 THEN 'Some title' END, c.conv_id % 3 = 1
FROM conversations c, unnest(range(0, 2)) AS g(i) WHERE c.role = 'assistant' AND c.turn >= 1 AND c.conv_id % 2 = 0
UNION ALL
SELECT c.conv_id * 1000 + c.turn, cast(CASE WHEN c.conv_id % 7 < 3 THEN 25 ELSE 1000000 END AS bigint),
  CASE c.conv_id % 7 WHEN 0 THEN 'response.failed' WHEN 1 THEN 'response.cancelled' WHEN 2 THEN 'response.incomplete' ELSE 'response.completed' END,
  NULL, NULL, NULL, NULL, NULL, NULL
FROM conversations c WHERE c.role = 'assistant'""",
    "hits": """
SELECT doc_id % 20 AS query_id, doc_id, concat(cast(doc_id AS varchar), '_', source, '.md') AS filename,
  cast((doc_id * 37) % 101 AS double) / 100 AS score,
  CASE WHEN doc_id % 4 = 0 THEN '## Report **' || cast(doc_id AS varchar) || '**' || chr(10) || text ELSE text END AS text FROM documents""",
    "summaries": """
SELECT conv_id AS session_id, turn, concat('T', lpad(cast((conv_id + CASE WHEN conv_id % 4 = 0 THEN 0 ELSE cast(floor(turn / 3) AS bigint) END) % 25 AS varchar), 2, '0')) AS ticker,
  CASE WHEN role = 'user' OR conv_id % 4 = 0 THEN concat('User asked about ', text) END AS summary FROM conversations""",
    "text_queries": """
SELECT item_id AS query_id, text AS query FROM benchmark""",
    "store_activity": """
SELECT concat('S', cast(user_id AS varchar)) AS ticker, ts FROM events""",
}


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the named views as CTEs (in the given order)."""
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
    return f"WITH {ctes}\n{body.strip()}"

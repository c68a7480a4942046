"""The catalog's views as DuckDB SQL, written apart from the Spark code, for the oracle queries."""

VIEWS = r"""
organization AS (SELECT CAST(n_nationkey AS VARCHAR) AS id, lower(n_name) AS name, n_name AS title,
    CASE WHEN n_nationkey = 24 THEN 'deleted' ELSE 'active' END AS state FROM nation),
grp AS (SELECT CAST(r_regionkey AS VARCHAR) AS id, lower(r_name) AS name, r_name AS title, 'active' AS state FROM region),
package_core AS (SELECT CAST(c_custkey AS VARCHAR) AS id, replace(lower(c_name), '#', '-') AS name, c_mktsegment || ' ' || c_name AS title,
    c_mktsegment AS license_id, CAST(c_nationkey AS VARCHAR) AS owner_org, c_acctbal < 0 AS private,
    CAST(c_custkey % 7 AS VARCHAR) AS creator_user_id, CASE WHEN c_custkey % 50 = 0 THEN 'deleted' ELSE 'active' END AS state FROM customer),
package AS (SELECT p.*, d.created, d.updated FROM package_core p LEFT JOIN
    (SELECT CAST(o_custkey AS VARCHAR) AS id, min(o_orderdate) AS created, max(o_orderdate) AS updated FROM orders GROUP BY 1) d ON p.id = d.id),
package_notes AS (SELECT p.*, t.text AS notes FROM package p LEFT JOIN documents t ON t.doc_id = CAST(p.id AS BIGINT) % (SELECT count(*) FROM documents)),
resource AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS package_id, 'order-' || o_orderkey AS name, o_orderpriority AS description,
    CASE left(o_orderpriority, 1) WHEN '1' THEN 'csv' WHEN '2' THEN 'CSV' WHEN '3' THEN 'json' WHEN '4' THEN '' END AS format,
    CASE WHEN o_orderstatus = 'P' THEN 'deleted' ELSE 'active' END AS state, CAST(floor(o_totalprice) AS BIGINT) AS size, o_orderdate AS updated,
    CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'error' END AS health_status,
    CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS health_checked_at FROM orders),
resource_positions AS (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY updated, CAST(id AS BIGINT)) - 1 AS position FROM resource),
package_tag AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS package_id, p_brand AS tag FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
package_group AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS package_id, CAST(n_regionkey AS VARCHAR) AS group_id
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN orders ON l_orderkey = o_orderkey),
membership AS (SELECT CAST(s_suppkey % 7 AS VARCHAR) AS user_id, CAST(s_nationkey AS VARCHAR) AS organization_id,
    ['member', 'editor', 'admin'][max(s_suppkey % 3) + 1] AS role FROM supplier GROUP BY 1, 2),
users AS (SELECT DISTINCT CAST(s_suppkey % 7 AS VARCHAR) AS id, 'user-' || (s_suppkey % 7) AS name, 'user-' || (s_suppkey % 7) || '@example.org' AS email,
    CASE WHEN s_suppkey % 7 = 0 THEN 'sysadmin' ELSE 'user' END AS role, CASE WHEN s_suppkey % 7 = 6 THEN 'deleted' ELSE 'active' END AS state FROM supplier),
pipeline AS (SELECT CAST(event_id AS VARCHAR) AS resource_id, CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'processing'
    WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'complete' ELSE 'error' END AS status, ts AS updated, props AS metadata,
    CASE WHEN event_type = 'error' THEN 'failed at ' || CAST(value AS VARCHAR) END AS error FROM events),
content AS (SELECT CAST(doc_id AS VARCHAR) AS resource_id, source AS package_id, text AS extracted_text, 'text' AS content_type, 0 AS chunk_index,
    CAST(strlen(text) AS INTEGER) AS chunk_size FROM documents),
active_formats AS (SELECT DISTINCT package_id, upper(format) AS format FROM resource WHERE state = 'active' AND format <> '')
"""


def query(sql: str, more: str = "") -> str:
    """``sql`` over the views, with further views if given."""
    return f"WITH {VIEWS.strip()}{',' + more if more else ''} {sql}"

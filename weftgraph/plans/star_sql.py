"""SQL text of the definitions in ``star``, for a second engine."""

NODES = """nodes AS (
  SELECT 'region::' || r_regionkey AS id, 'file' AS kind, r_name AS name, r_name AS qualified, r_name AS file,
         'region' AS language, 0 AS start_line, '' AS signature FROM region
  UNION ALL SELECT 'nation::' || n_nationkey, 'interface', n_name, '', 'nation', 'nation', 0, '' FROM nation
  UNION ALL SELECT 'customer::' || c_custkey, 'class', c_name, '', c_mktsegment, 'customer', c_nationkey + 1, '' FROM customer
  UNION ALL SELECT 'supplier::' || s_suppkey, 'class', s_name, '', 'supplier', 'supplier', s_nationkey + 1, '' FROM supplier
  UNION ALL SELECT 'part::' || p_partkey, 'type', p_name, p_brand || '.' || p_name, p_brand, 'part', p_size, p_type FROM part
  UNION ALL SELECT 'order::' || o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'endpoint' ELSE 'method' END,
         'order ' || o_orderkey, 'order ' || o_orderkey, 'orders/' || o_orderstatus, 'orders', o_custkey + 1, '' FROM orders)"""

EDGES = """edges AS (
  SELECT 'region::' || n_regionkey AS from_id, 'nation::' || n_nationkey AS to_id, 'defines' AS kind FROM nation
  UNION ALL SELECT 'customer::' || c_custkey, 'nation::' || c_nationkey, 'implements' FROM customer
  UNION ALL SELECT 'supplier::' || s_suppkey, 'nation::' || s_nationkey, 'implements' FROM supplier
  UNION ALL SELECT 'order::' || o_orderkey, 'customer::' || o_custkey, 'calls' FROM orders
  UNION ALL SELECT 'order::' || l_orderkey, 'part::' || l_partkey, 'calls' FROM lineitem
  UNION ALL SELECT 'part::' || l_partkey, 'supplier::' || l_suppkey, 'instantiates' FROM lineitem)"""

ORDERED_EDGES = """ordered AS (
  SELECT 'region::' || n_regionkey AS from_id, 'nation::' || n_nationkey AS to_id, 'defines' AS kind,
         struct_pack(p := 0, s := n_nationkey, l := 0, c := 0, o := 0) AS spot FROM nation
  UNION ALL SELECT 'customer::' || c_custkey, 'nation::' || c_nationkey, 'implements', struct_pack(p := 2, s := c_custkey, l := 0, c := 0, o := 0) FROM customer
  UNION ALL SELECT 'supplier::' || s_suppkey, 'nation::' || s_nationkey, 'implements', struct_pack(p := 2, s := s_suppkey, l := 0, c := 0, o := 0) FROM supplier
  UNION ALL SELECT 'order::' || o_orderkey, 'customer::' || o_custkey, 'calls', struct_pack(p := 3, s := o_orderkey, l := 0, c := 0, o := 0) FROM orders
  UNION ALL SELECT 'order::' || l_orderkey, 'part::' || l_partkey, 'calls', struct_pack(p := 3, s := l_orderkey, l := l_linenumber, c := 0, o := l_partkey) FROM lineitem
  UNION ALL SELECT 'part::' || l_partkey, 'supplier::' || l_suppkey, 'instantiates', struct_pack(p := 3, s := l_partkey, l := l_orderkey, c := 1, o := l_linenumber) FROM lineitem)"""

EVENT_EDGES = """edges AS (
  SELECT CASE WHEN value < 10 THEN 'type::' || event_type ELSE 'user::' || user_id END AS from_id,
         CASE WHEN value < 10 THEN 'user::' || user_id ELSE 'type::' || event_type END AS to_id,
         CASE WHEN value < 10 THEN 'references' ELSE 'calls' END AS kind, event_id FROM events)"""

NAME_BAG = """names AS (
  SELECT p_name AS name, 'symbol::' || p_brand || '::' || p_name AS id, p_brand AS file_key, p_partkey AS sym_ord FROM part
  UNION ALL SELECT p_brand || '.' || p_size, 'symbol::' || p_type || '::' || p_brand || '.' || p_size, p_type, p_partkey FROM part
  UNION ALL SELECT c_name, 'symbol::customers::' || c_name, 'customers', c_custkey FROM customer)"""

BARE_REFS = """refs AS (
  SELECT 'symbol::' || u.p_brand || '::' || u.p_name AS from_id, t.p_name AS name
  FROM lineitem JOIN part u ON u.p_partkey = l_partkey JOIN part t ON t.p_partkey = l_suppkey
  UNION ALL SELECT 'symbol::orders::' || o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey)"""

TYPE_BAG = """types AS (
  SELECT p_name || '/' || p_size AS name, 'symbol::' || p_brand || '::' || p_name || '/' || p_size AS id FROM part)"""

CREATE_REFS = """refs AS (
  SELECT 'symbol::' || u.p_brand || '::' || u.p_name || '/' || u.p_size AS from_id, t.p_name || '/' || t.p_size AS name
  FROM lineitem JOIN part u ON u.p_partkey = l_suppkey JOIN part t ON t.p_partkey = l_partkey)"""

VARIABLES = """vars AS (
  SELECT s_name AS name, p_brand AS type_name FROM supplier JOIN part ON p_partkey = s_suppkey
  UNION ALL SELECT 'nation_' || s_nationkey, p_brand FROM supplier JOIN part ON p_partkey = s_suppkey)"""

VARIABLE_CALLS = """calls AS (
  SELECT 'symbol::orders::' || l_orderkey AS from_id, CAST(l_linenumber AS VARCHAR) AS name, s_name AS receiver_var
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
  UNION ALL SELECT 'symbol::orders::' || l_orderkey, CAST(l_linenumber AS VARCHAR), 'nation_' || s_nationkey
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)"""

TYPED = """kinds AS (
  SELECT 'symbol::nations::' || n_name AS id, 'interface' AS kind, n_name AS name FROM nation
  UNION ALL SELECT DISTINCT 'symbol::brands::' || p_brand, 'class', p_brand FROM part),
implements AS (
  SELECT 'symbol::brands::' || p_brand AS from_id, 'symbol::nations::' || n_name AS to_id
  FROM supplier JOIN part ON p_partkey = s_suppkey JOIN nation ON n_nationkey = s_nationkey),
calls AS (
  SELECT from_id, name, receiver_type, count(*) AS times FROM (
    SELECT 'symbol::' || p_type || '::' || p_brand || '.' || p_size AS from_id, CAST(p_size AS VARCHAR) AS name,
           unnest([n_name, p_brand]) AS receiver_type
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
    JOIN part ON p_partkey = o_custkey) GROUP BY ALL)"""

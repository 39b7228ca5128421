"""Queries over the driver's tables that together use every read operator, with the same in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .session import GraphSession
from .sources.trade import trade_graph
from .surface import SURFACE

#: name: (query, SQL)
PAIRS: dict[str, tuple[str, str]] = {}


def _pair(name: str, cypher: str, sql: str) -> None:
    PAIRS[name] = (cypher, sql)


NEXT = "(SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_id FROM events)"

# Scans and seeks.
_pair("segment_customers_by_nation", "MATCH (c:Customer)-[:IN_NATION]->(n:Nation) WHERE c.mktsegment = 'BUILDING' RETURN n.name AS nation, count(*) AS customers ORDER BY customers DESC, nation LIMIT 10", "SELECT n_name AS nation, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
_pair("label_scan_filter", "MATCH (c:Customer) WHERE c.acctbal > 5000 RETURN c.name AS name, c.acctbal AS bal", "SELECT c_name AS name, c_acctbal AS bal FROM customer WHERE c_acctbal > 5000")
_pair("all_nodes_count", "MATCH (n) RETURN count(*) AS c", "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) + (SELECT count(DISTINCT user_id) FROM events) + (SELECT count(*) FROM events) + (SELECT count(*) FROM documents) AS c")
_pair("label_predicate", "MATCH (n) WHERE n:Nation OR n:Region RETURN n.name AS name, labels(n)[0] AS label", "SELECT n_name AS name, 'Nation' AS label FROM nation UNION ALL SELECT r_name, 'Region' FROM region")
_pair("property_seek", "MATCH (c:Customer {mktsegment: 'MACHINERY'}) RETURN c.custkey AS k", "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'MACHINERY'")
_pair("property_range", "MATCH (p:Part) WHERE p.retailprice >= 900 AND p.retailprice < 950 RETURN p.partkey AS k, p.size AS size", "SELECT p_partkey AS k, p_size::BIGINT AS size FROM part WHERE p_retailprice >= 900 AND p_retailprice < 950")
_pair("prefix_range", "MATCH (c:Customer) WHERE c.name STARTS WITH 'Customer#00000001' RETURN c.name AS name", "SELECT c_name AS name FROM customer WHERE c_name LIKE 'Customer#00000001%'")
_pair("rel_property_seek", "MATCH (o:Order)-[l:CONTAINS {returnflag: 'R'}]->(p:Part) RETURN p.brand AS brand, count(*) AS n", "SELECT p_brand AS brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY 1")
_pair("rel_range_seek", "MATCH ()-[l:CONTAINS]->(p:Part) WHERE l.quantity > 45 AND l.discount < 0.02 RETURN count(*) AS n, count(DISTINCT p) AS parts", "SELECT count(*) AS n, count(DISTINCT l_partkey) AS parts FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.02")

# Expansion.
_pair("expand_out", "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.orderstatus = 'O' RETURN c.custkey AS c, o.orderkey AS o", "SELECT o_custkey AS c, o_orderkey AS o FROM orders WHERE o_orderstatus = 'O'")
_pair("expand_in", "MATCH (n:Nation)<-[:IN_NATION]-(s:Supplier) RETURN n.name AS nation, s.name AS supplier", "SELECT n_name AS nation, s_name AS supplier FROM supplier JOIN nation ON s_nationkey = n_nationkey")
_pair("expand_both", "MATCH (a:Event)-[:NEXT]-(b:Event) RETURN a.event_type AS a, b.event_type AS b, count(*) AS n", f"WITH x AS (SELECT event_id AS p, next_id AS q FROM {NEXT} WHERE next_id IS NOT NULL), y AS (SELECT p, q FROM x UNION ALL SELECT q, p FROM x) SELECT a.event_type AS a, b.event_type AS b, count(*) AS n FROM y JOIN events a ON a.event_id = p JOIN events b ON b.event_id = q GROUP BY ALL")
_pair("expand_multi_type", "MATCH (n:Nation)-[r:IN_NATION|IN_REGION]-(x) RETURN type(r) AS t, labels(x)[0] AS l, count(*) AS n", "SELECT 'IN_REGION' AS t, 'Region' AS l, count(*) AS n FROM nation UNION ALL SELECT 'IN_NATION', 'Customer', count(*) FROM customer UNION ALL SELECT 'IN_NATION', 'Supplier', count(*) FROM supplier")
_pair("expand_any_type", "MATCH (o:Order)-[r]->(x) RETURN type(r) AS t, count(*) AS n", "SELECT unnest(['CONTAINS', 'SUPPLIED_BY']) AS t, (SELECT count(*) FROM lineitem) AS n")
_pair("expand_two_hop", "MATCH (c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS region, count(*) AS customers, round(sum(c.acctbal)) AS bal", "SELECT r_name AS region, count(*) AS customers, floor(sum(c_acctbal) + 0.5)::DOUBLE AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
_pair("expand_three_hop", "MATCH (c:Customer)-[:PLACED]->(o:Order)-[l:CONTAINS]->(p:Part) WHERE c.mktsegment = 'BUILDING' AND p.size = 10 RETURN c.custkey AS c, count(*) AS lines, sum(l.quantity) AS qty", "SELECT c_custkey AS c, count(*) AS lines, sum(l_quantity) AS qty FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE c_mktsegment = 'BUILDING' AND p_size = 10 GROUP BY 1")
_pair("expand_into_cycle", "MATCH (c:Customer)-[:IN_NATION]->(n:Nation)<-[:IN_NATION]-(s:Supplier), (c)-[:PLACED]->(o:Order)-[:SUPPLIED_BY]->(s) RETURN n.name AS nation, count(*) AS n", "SELECT n_name AS nation, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
_pair("revenue_by_region", "MATCH (r:Region)<-[:IN_REGION]-(:Nation)<-[:IN_NATION]-(:Customer)-[:PLACED]->(:Order)-[l:CONTAINS]->(:Part) RETURN r.name AS region, round(sum(l.extendedprice * (1 - l.discount))) AS revenue, count(*) AS lines", "SELECT r_name AS region, floor(sum(l_extendedprice * (1 - l_discount)) + 0.5)::DOUBLE AS revenue, count(*) AS lines FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")

# Variable length and shortest paths.
_pair("varlen_bounded", "MATCH (a:Event {event_type: 'signup'})-[:NEXT*1..3]->(b:Event) RETURN b.event_type AS t, count(*) AS n", f"WITH x AS (SELECT event_id AS p, next_id AS q FROM {NEXT} WHERE next_id IS NOT NULL), h1 AS (SELECT x.p, x.q FROM x JOIN events ON event_id = p WHERE event_type = 'signup'), h2 AS (SELECT h1.p, x.q FROM h1 JOIN x ON x.p = h1.q), h3 AS (SELECT h2.p, x.q FROM h2 JOIN x ON x.p = h2.q) SELECT event_type AS t, count(*) AS n FROM (SELECT q FROM h1 UNION ALL SELECT q FROM h2 UNION ALL SELECT q FROM h3) JOIN events ON event_id = q GROUP BY 1")
_pair("varlen_zero", "MATCH (n:Nation)-[:IN_REGION*0..1]->(x) RETURN labels(x)[0] AS l, count(*) AS n", "SELECT unnest(['Nation', 'Region']) AS l, (SELECT count(*) FROM nation) AS n")
_pair("varlen_exact", "MATCH (a:Event)-[r:NEXT*2]->(b:Event) RETURN a.event_id AS a, b.event_id AS b, size(r) AS hops", f"WITH x AS (SELECT event_id AS p, next_id AS q FROM {NEXT} WHERE next_id IS NOT NULL) SELECT x.p AS a, y.q AS b, 2::BIGINT AS hops FROM x JOIN x y ON x.q = y.p")
_pair("varlen_unbounded", "MATCH (s:Supplier)-[*]->(x) RETURN labels(x)[0] AS l, count(*) AS n", "SELECT unnest(['Nation', 'Region']) AS l, (SELECT count(*) FROM supplier) AS n")
_pair("varlen_undirected", "MATCH (a:Region {name: 'ASIA'})-[:IN_REGION*1..2]-(b) RETURN labels(b)[0] AS l, count(*) AS n", "SELECT 'Nation' AS l, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
_pair("varlen_rel_list", "MATCH (o:Order)-[r:CONTAINS*1..1]->(p) UNWIND [x IN r | x.quantity] AS q RETURN o.orderkey AS o, count(q) AS n, sum(q) AS qty", "SELECT l_orderkey AS o, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY 1")
_pair("shortest_path_len", "MATCH (s:Supplier), (r:Region), p = shortestPath((s)-[*..4]->(r)) RETURN s.suppkey AS s, r.name AS r, length(p) AS hops", "SELECT s_suppkey AS s, r_name AS r, 2::BIGINT AS hops FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
_pair("shortest_path_nodes", "MATCH (s:Supplier), (r:Region), p = shortestPath((s)-[:IN_NATION|IN_REGION*]->(r)) RETURN s.suppkey AS s, [n IN nodes(p) | n.name][1] AS via, size(relationships(p)) AS hops", "SELECT s_suppkey AS s, n_name AS via, 2::BIGINT AS hops FROM supplier JOIN nation ON s_nationkey = n_nationkey")
_pair("all_shortest_count", "MATCH (a:Nation), (b:Nation), p = allShortestPaths((a)-[:IN_REGION*..2]-(b)) WHERE a.name < b.name RETURN a.name AS a, b.name AS b, length(p) AS hops", "SELECT a.n_name AS a, b.n_name AS b, 2::BIGINT AS hops FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_name < b.n_name")

# OPTIONAL MATCH and correlation.
_pair("optional_match", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) RETURN c.custkey AS c, count(o) AS n", "SELECT c_custkey AS c, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
_pair("optional_where", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 400000 RETURN c.custkey AS c, o.orderkey AS o", "SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000")
_pair("optional_chain", "MATCH (n:Nation) OPTIONAL MATCH (n)<-[:IN_NATION]-(s:Supplier)<-[l:SUPPLIED_BY]-(o:Order) WHERE l.quantity > 49 RETURN n.name AS nation, count(l) AS n", "SELECT n_name AS nation, count(l_orderkey) AS n FROM nation LEFT JOIN (supplier JOIN lineitem ON l_suppkey = s_suppkey AND l_quantity > 49) ON s_nationkey = n_nationkey GROUP BY 1")
_pair("anti_pattern", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 300000 WITH c, o WHERE o IS NULL RETURN c.custkey AS c", "SELECT c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
_pair("correlated_unwind", "UNWIND [3, 7, 7, 99] AS k MATCH (n:Nation {nationkey: k}) RETURN k, n.name AS name", "SELECT k::BIGINT AS k, n_name AS name FROM (SELECT unnest([3, 7, 7, 99]) AS k) JOIN nation ON n_nationkey = k")
_pair("correlated_match", "MATCH (s:Supplier) WHERE s.acctbal > 8000 MATCH (n:Nation {nationkey: s.nationkey}) RETURN s.name AS s, n.name AS n", "SELECT s_name AS s, n_name AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal > 8000")
_pair("cartesian_theta", "MATCH (a:Nation), (b:Nation) WHERE a.nationkey < b.nationkey AND a.regionkey = b.regionkey RETURN a.name AS a, b.name AS b", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
_pair("equi_join_props", "MATCH (c:Customer), (s:Supplier) WHERE s.nationkey = c.nationkey AND s.acctbal > c.acctbal RETURN s.suppkey AS s, count(*) AS n", "SELECT s_suppkey AS s, count(*) AS n FROM customer JOIN supplier ON s_nationkey = c_nationkey AND s_acctbal > c_acctbal GROUP BY 1")

# Aggregation.
_pair("agg_all", "MATCH (o:Order) RETURN count(*) AS n, count(DISTINCT o.orderstatus) AS statuses, min(o.totalprice) AS low, max(o.totalprice) AS high, round(avg(o.totalprice)) AS mean", "SELECT count(*) AS n, count(DISTINCT o_orderstatus) AS statuses, min(o_totalprice) AS low, max(o_totalprice) AS high, floor(avg(o_totalprice) + 0.5)::DOUBLE AS mean FROM orders")
_pair("agg_grouped", "MATCH ()-[l:CONTAINS]->() RETURN l.returnflag AS f, l.linestatus AS s, sum(l.quantity) AS qty, round(sum(l.extendedprice * (1 - l.discount) * (1 + l.tax))) AS charge, round(avg(l.discount) * 1000000) AS disc, count(*) AS n", "SELECT l_returnflag AS f, l_linestatus AS s, sum(l_quantity) AS qty, floor(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) + 0.5)::DOUBLE AS charge, floor(avg(l_discount) * 1000000 + 0.5)::DOUBLE AS disc, count(*) AS n FROM lineitem GROUP BY 1, 2")
_pair("agg_distinct", "MATCH (e:Event) RETURN e.event_type AS t, count(DISTINCT e.props) AS kinds, count(DISTINCT round(e.value)) AS v", "SELECT event_type AS t, count(DISTINCT props) AS kinds, count(DISTINCT floor(value + 0.5)) AS v FROM events GROUP BY 1")
_pair("agg_empty", "MATCH (x:Nobody) RETURN count(x) AS n, sum(x.v) AS s, avg(x.v) IS NULL AS a, size(collect(x.v)) AS c", "SELECT 0::BIGINT AS n, 0::BIGINT AS s, true AS a, 0::BIGINT AS c")
_pair("collect_sorted", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r, n ORDER BY n.name DESC WITH r.name AS region, collect(n.name) AS names RETURN region, names[0] AS first, names[-1] AS last, size(names) AS n", "SELECT r_name AS region, max(n_name) AS first, min(n_name) AS last, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
_pair("group_by_node", "MATCH (n:Nation)<-[:IN_NATION]-(c:Customer) WITH n, count(*) AS c, sum(c.acctbal) AS b WHERE c > 3 RETURN n.name AS name, c, round(b) AS b", "SELECT n_name AS name, count(*) AS c, floor(sum(c_acctbal) + 0.5)::DOUBLE AS b FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(*) > 3")
_pair("sum_empty_zero", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice < 0 RETURN c.custkey AS c, sum(o.totalprice) AS s", "SELECT c_custkey AS c, 0::DOUBLE AS s FROM customer")

# Order, paging, DISTINCT, WITH, UNION.
_pair("order_projected", "MATCH (p:Part) RETURN p.partkey AS k, p.retailprice AS price ORDER BY price DESC, k LIMIT 20", "SELECT p_partkey AS k, p_retailprice AS price FROM part ORDER BY 2 DESC, 1 LIMIT 20")
_pair("order_nonprojected", "MATCH (p:Part) RETURN p.partkey AS k ORDER BY p.retailprice, p.partkey LIMIT 15", "SELECT p_partkey AS k FROM part ORDER BY p_retailprice, p_partkey LIMIT 15")
_pair("order_skip_limit", "MATCH (c:Customer) RETURN c.custkey AS k, c.acctbal AS b ORDER BY b, k SKIP 10 LIMIT 10", "SELECT c_custkey AS k, c_acctbal AS b FROM customer ORDER BY 2, 1 LIMIT 10 OFFSET 10")
_pair("top_k", "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, sum(o.totalprice) AS spent ORDER BY spent DESC, c.custkey LIMIT 10 RETURN c.name AS name, round(spent) AS spent", "SELECT c_name AS name, floor(sum(o_totalprice) + 0.5)::DOUBLE AS spent FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_name, c_custkey ORDER BY sum(o_totalprice) DESC, c_custkey LIMIT 10")
_pair("nulls_in_order", "MATCH (d:Document) RETURN d.doc_id AS d, d.quality AS q ORDER BY d.quality DESC, d.doc_id LIMIT 25", "SELECT doc_id AS d, quality::BIGINT AS q FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality DESC NULLS FIRST, doc_id LIMIT 25")
_pair("distinct", "MATCH (p:Part) RETURN DISTINCT p.brand AS brand, p.size AS size", "SELECT DISTINCT p_brand AS brand, p_size::BIGINT AS size FROM part")
_pair("with_chain", "MATCH (e:Event) WITH e.event_type AS t, e.value AS v WHERE v > 50 WITH t, count(*) AS n WHERE n > 10 RETURN t, n * 2 AS twice", "SELECT event_type AS t, count(*) * 2 AS twice FROM events WHERE value > 50 GROUP BY 1 HAVING count(*) > 10")
_pair("return_star", "MATCH (r:Region) WITH r.name AS name, r.regionkey AS k RETURN *", "SELECT r_name AS name, r_regionkey::BIGINT AS k FROM region")
_pair("union", "MATCH (c:Customer) RETURN c.nationkey AS k UNION MATCH (s:Supplier) RETURN s.nationkey AS k", "SELECT c_nationkey::BIGINT AS k FROM customer UNION SELECT s_nationkey FROM supplier")
_pair("union_all", "MATCH (n:Nation) RETURN n.name AS name, 1 AS x UNION ALL MATCH (r:Region) RETURN r.name AS name, 2.5 AS x", "SELECT n_name AS name, 1::DOUBLE AS x FROM nation UNION ALL SELECT r_name, 2.5 FROM region")

# Lists, maps, logic.
_pair("unwind", "UNWIND [1, 2, null, 3] AS x RETURN x, x * x AS y", "SELECT x::BIGINT AS x, (x * x)::BIGINT AS y FROM (SELECT unnest([1, 2, NULL, 3]) AS x)")
_pair("unwind_nested", "UNWIND [[1, 2], [], [3]] AS l UNWIND l AS x RETURN size(l) AS n, x", "SELECT * FROM (VALUES (2::BIGINT, 1::BIGINT), (2, 2), (1, 3)) t(n, x)")
_pair("list_comprehension", "MATCH (n:Nation) WITH n.regionkey AS r, collect(n.nationkey) AS ks RETURN r, size([k IN ks WHERE k % 2 = 0 | k * 10]) AS even", "SELECT n_regionkey::BIGINT AS r, count(*) FILTER (WHERE n_nationkey % 2 = 0) AS even FROM nation GROUP BY 1")
_pair("quantifiers", "MATCH (n:Nation) WITH n.regionkey AS r, collect(n.nationkey) AS ks RETURN r, any(k IN ks WHERE k > 20) AS a, all(k IN ks WHERE k > 1) AS b, none(k IN ks WHERE k = 5) AS c, single(k IN ks WHERE k > 20) AS d", "SELECT n_regionkey::BIGINT AS r, bool_or(n_nationkey > 20) AS a, bool_and(n_nationkey > 1) AS b, NOT bool_or(n_nationkey = 5) AS c, count(*) FILTER (WHERE n_nationkey > 20) = 1 AS d FROM nation GROUP BY 1")
_pair("list_slice", "RETURN [1, 2, 3, 4][1..3][0] AS a, size([1, 2, 3][-2..]) AS b, size([1, 2, 3][5..9]) AS c, [1, 2][0..null] IS NULL AS d", "SELECT 2::BIGINT AS a, 2::BIGINT AS b, 0::BIGINT AS c, true AS d")
_pair("list_subscript", "RETURN [10, 20, 30][1] AS a, [10, 20, 30][-1] AS b, [10][5] AS c, {k: 'v'}['k'] AS d, {k: 'v'}.x IS NULL AS e", "SELECT 20::BIGINT AS a, 30::BIGINT AS b, NULL::BIGINT AS c, 'v' AS d, true AS e")
_pair("list_concat", "RETURN size([1, 2] + [3] + 4) AS a, ([1] + 2)[1] AS b, 'x' + 'y' AS c", "SELECT 4::BIGINT AS a, 2::BIGINT AS b, 'xy' AS c")
_pair("case_simple", "MATCH (o:Order) RETURN CASE o.orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'other' END AS s, count(*) AS n", "SELECT CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'other' END AS s, count(*) AS n FROM orders GROUP BY 1")
_pair("case_searched", "MATCH (p:Part) RETURN CASE WHEN p.size < 10 THEN 'small' WHEN p.size < 30 THEN 'middle' END AS s, count(*) AS n", "SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' END AS s, count(*) AS n FROM part GROUP BY 1")
_pair("null_logic", "MATCH (d:Document) RETURN d.quality = 1 OR d.toxic = 1 AS a, d.quality = 1 AND NOT d.toxic = 1 AS b, d.quality IS NULL AS c, count(*) AS n", "SELECT quality = 1 OR toxic = 1 AS a, quality = 1 AND NOT toxic = 1 AS b, quality IS NULL AS c, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
_pair("in_list", "MATCH (p:Part) WHERE p.size IN [1, 5, 9] AND NOT p.brand IN ['Brand#11', 'Brand#12'] RETURN p.partkey AS k", "SELECT p_partkey AS k FROM part WHERE p_size IN (1, 5, 9) AND p_brand NOT IN ('Brand#11', 'Brand#12')")
_pair("three_valued_equality", "RETURN [1, null] = [1, null] AS a, [1, 2] = [1, 3] AS b, 1 = 'a' AS c, 1 = 1.0 AS d, null IN [] AS e, 2 IN [1, null] AS f, 1 < 'a' AS g", "SELECT NULL::BOOLEAN AS a, false AS b, false AS c, true AS d, false AS e, NULL::BOOLEAN AS f, NULL::BOOLEAN AS g")
_pair("string_predicates", "MATCH (p:Part) WHERE p.name CONTAINS 'a' AND p.name ENDS WITH 'e' AND NOT p.type STARTS WITH 'S' RETURN p.partkey AS k", "SELECT p_partkey AS k FROM part WHERE contains(p_name, 'a') AND ends_with(p_name, 'e') AND NOT starts_with(p_type, 'S')")
_pair("regex_match", "MATCH (c:Customer) WHERE c.name =~ 'Customer#0*[1-9]5' RETURN c.custkey AS k", "SELECT c_custkey AS k FROM customer WHERE regexp_full_match(c_name, 'Customer#0*[1-9]5')")

# Functions.
_pair("fn_string", "MATCH (n:Nation) RETURN toLower(n.name) AS a, substring(n.name, 1, 3) AS b, replace(n.name, 'A', '-') AS c, size(split(n.name, 'A')) AS d, trim('  x ') AS e, size(n.name) AS f, toUpper('ab') AS g", "SELECT lower(n_name) AS a, substr(n_name, 2, 3) AS b, replace(n_name, 'A', '-') AS c, len(string_split(n_name, 'A')) AS d, 'x' AS e, length(n_name) AS f, 'AB' AS g FROM nation")
_pair("fn_math", "MATCH (e:Event) RETURN e.event_id AS k, abs(-e.event_id) AS a, floor(e.value) AS b, ceil(e.value) AS c, round(e.value) AS d, sign(e.value - 50) AS e, e.event_id % 7 AS f, e.event_id / 7 AS g", "SELECT event_id AS k, event_id AS a, floor(value)::DOUBLE AS b, ceil(value)::DOUBLE AS c, floor(value + 0.5)::DOUBLE AS d, sign(value - 50)::BIGINT AS e, event_id % 7 AS f, event_id // 7 AS g FROM events")
_pair("fn_list", "RETURN head([1, 2]) AS a, last([1, 2]) AS b, size(tail([1, 2, 3])) AS c, size(range(1, 10, 3)) AS d, range(5, 1, -2)[2] AS e, size(range(3, 1)) AS f", "SELECT 1::BIGINT AS a, 2::BIGINT AS b, 2::BIGINT AS c, 4::BIGINT AS d, 1::BIGINT AS e, 0::BIGINT AS f")
_pair("fn_convert", "RETURN toInteger('12') AS a, toInteger('1.5') AS b, toInteger(2.9) AS c, toFloat('2.5') AS d, toString(3.0) AS e, toString(1e6) AS f, toString(true) AS g, toInteger(true) AS h", "SELECT 12::BIGINT AS a, NULL::BIGINT AS b, 2::BIGINT AS c, 2.5::DOUBLE AS d, '3' AS e, '1e+06' AS f, 'true' AS g, 1::BIGINT AS h")
_pair("fn_entity", "MATCH (n:Nation)-[r:IN_REGION]->(x:Region) RETURN n.name AS n, startNode(r).name AS a, endNode(r).name AS b, type(r) AS t, size(keys(n)) AS k, properties(x).name AS p, id(n) = id(startNode(r)) AS same", "SELECT n_name AS n, n_name AS a, r_name AS b, 'IN_REGION' AS t, 3::BIGINT AS k, r_name AS p, true AS same FROM nation JOIN region ON n_regionkey = r_regionkey")
_pair("fn_coalesce", "MATCH (d:Document) RETURN coalesce(d.quality, -1) AS q, count(*) AS n", "SELECT coalesce(quality, -1)::BIGINT AS q, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
_pair("integer_division", "RETURN 7 / 2 AS a, -7 / 2 AS b, -7 % 3 AS c, 7.0 / 2 AS d, 2 * 3 + 4 AS e, 2 + 3 * 4 AS f", "SELECT 3::BIGINT AS a, -3::BIGINT AS b, -1::BIGINT AS c, 3.5::DOUBLE AS d, 10::BIGINT AS e, 14::BIGINT AS f")

_graphs: dict[tuple[int, str], object] = {}


def session(spark: SparkSession, sf_dir: str) -> GraphSession:
    """A session on the graph of sf_dir, which is only put together once."""
    key = (id(spark), sf_dir)
    if key not in _graphs:
        _graphs[key] = trade_graph(spark, sf_dir)
    return GraphSession(spark, _graphs[key])


def _reader(cypher: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: session(spark, sf_dir).query(cypher)


FLAGSHIP = "segment_customers_by_nation"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _reader(c) for name, (c, _) in PAIRS.items()}
SQL: dict[str, str] = {name: s for name, (_, s) in PAIRS.items()}


# Writes and live queries: each builds a store of its own and returns what is in it.


def _import(g: GraphSession, spark: SparkSession, sf_dir: str, table: str, cypher: str) -> None:
    g.import_rows(cypher, spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def _places(spark: SparkSession, sf_dir: str) -> GraphSession:
    """Nations and regions as a written graph."""
    g = GraphSession(spark)

    def build(tx):
        for table, cypher in (("region", "UNWIND $rows AS r CREATE (:R {k: r.r_regionkey, name: r.r_name})"), ("nation", "UNWIND $rows AS r CREATE (:N {k: r.n_nationkey, name: r.n_name, r: r.n_regionkey})")):
            tx.query(cypher, {"rows": spark.read.parquet(f"{sf_dir}/{table}.parquet")})
        tx.query("MATCH (n:N), (r:R {k: n.r}) CREATE (n)-[:IN {w: n.k * 2}]->(r)")

    g.update(build)
    return g


def create_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = GraphSession(spark)
    _import(g, spark, sf_dir, "customer", "UNWIND $rows AS r CREATE (:C {k: r.c_custkey, name: r.c_name, bal: r.c_acctbal})")
    return g.query("MATCH (c:C) RETURN c.k AS k, c.name AS name, c.bal AS bal")


def create_rels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(spark, sf_dir).query("MATCH (n:N)-[x:IN]->(r:R) RETURN n.name AS n, r.name AS r, x.w AS w, type(x) AS t")


def merge_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = GraphSession(spark)
    _import(g, spark, sf_dir, "customer", "UNWIND $rows AS r MERGE (s:Segment {name: r.c_mktsegment}) ON CREATE SET s.made = 1 ON MATCH SET s.met = true")
    return g.query("MATCH (s:Segment) RETURN s.name AS name, s.made AS made, s.met AS met")


def merge_rel(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _places(spark, sf_dir)
    g.query("MATCH (n:N), (r:R {k: n.r}) MERGE (n)-[x:IN]->(r) ON MATCH SET x.again = true ON CREATE SET x.again = false")
    g.query("MATCH (n:N) WHERE n.k < 5 MERGE (n)-[x:NEAR]->(s:Sea {name: 'sea of ' + n.name})")
    return g.query("MATCH (n:N)-[x:IN]->(r:R) OPTIONAL MATCH (n)-[:NEAR]->(s:Sea) RETURN n.name AS n, x.again AS again, s.name AS sea")


def set_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _places(spark, sf_dir)
    g.query("MATCH (n:N)-[x:IN]->(r:R) WHERE n.k < 10 SET n.twice = n.k * 2, n:Low, x.w = null")
    g.query("MATCH (n:N) WHERE n.k >= 20 SET n = {k: n.k, only: 'k'}")
    g.query("MATCH (n:N {k: 3}) SET n += {name: 'three', r: null}")
    return g.query("MATCH (n:N)-[x:IN]->(r) RETURN n.k AS k, n.name AS name, n.twice AS twice, n.r AS r, n.only AS only, n:Low AS low, x.w AS w")


def remove_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _places(spark, sf_dir)
    g.query("MATCH (n:N) WHERE n.k % 2 = 0 SET n:Even REMOVE n.name")
    g.query("MATCH (n:Even) WHERE n.k > 10 REMOVE n:N")
    return g.query("MATCH (n) WHERE n:N OR n:Even RETURN n.k AS k, n.name AS name, n:N AS n, n:Even AS even")


def detach_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _places(spark, sf_dir)
    g.query("MATCH (r:R {name: 'ASIA'}) DETACH DELETE r")
    g.query("MATCH (n:N)-[x:IN]->(r:R {name: 'EUROPE'}) DELETE x")
    return g.query("MATCH (n:N) OPTIONAL MATCH (n)-[:IN]->(r:R) RETURN n.name AS n, r.name AS r")


def unique_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .errors import ConstraintViolation

    g = _places(spark, sf_dir)
    g.query("CREATE CONSTRAINT FOR (n:N) REQUIRE n.k IS UNIQUE")
    try:
        g.query("CREATE (:N {k: 7})")
        violated = False
    except ConstraintViolation:
        violated = True
    return g.query("MATCH (n:N) RETURN count(*) AS n, $v AS violated", {"v": violated})


def show_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = GraphSession(spark)
    for q in ("CREATE INDEX FOR (n:N) ON (n.k)", "CREATE INDEX by_w FOR ()-[x:IN]-() ON (x.w)", "CREATE INDEX FOR (n:N) ON (n.name)", "DROP INDEX index_N_name"):
        g.query(q)
    return g.query("SHOW INDEXES")


def show_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = GraphSession(spark)
    for q in ("CREATE CONSTRAINT one FOR (n:N) REQUIRE n.k IS UNIQUE", "CREATE CONSTRAINT FOR (r:R) REQUIRE r.k IS UNIQUE", "DROP CONSTRAINT one"):
        g.query(q)
    return g.query("SHOW CONSTRAINTS")


def _followed(spark: SparkSession, sf_dir: str, cypher: str, changes: list[str]) -> DataFrame:
    from pyspark.sql import functions as F

    g = _places(spark, sf_dir)
    live = g.subscribe(cypher)
    live.poll()
    for q in changes:
        g.query(q)
    c = live.poll()
    return c.added.withColumn("change", F.lit("added")).unionByName(c.removed.withColumn("change", F.lit("removed"))).withColumn("mode", F.lit(live.mode))


CHANGED = ["MATCH (n:N) WHERE n.k < 3 SET n.name = 'x' + n.name", "MATCH (n:N {k: 5}) DETACH DELETE n"]


def live_full_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _followed(spark, sf_dir, "MATCH (n:N)-[:IN]->(r:R) RETURN r.name AS r, min(n.name) AS low, count(*) AS n", CHANGED)


def live_anchored_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _followed(spark, sf_dir, "MATCH (n:N)-[:IN]->(r:R) WHERE n.k < 100 RETURN n.name AS n, r.name AS r", CHANGED)


def parity_seed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _places(spark, sf_dir)
    q = "MATCH (n:N)-[:IN]->(r:R) WHERE n.k > 5 AND n.k < 20 RETURN n.name AS n, r.name AS r"
    before = g.query(q)
    g.query("CREATE INDEX FOR (n:N) ON (n.k)")
    after = g.query(q)
    return before.intersectAll(after)


_OLD = "SELECT n_nationkey AS k, n_name AS name, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey"
_NEW = "SELECT n_nationkey AS k, CASE WHEN n_nationkey < 3 THEN 'x' || n_name ELSE n_name END AS name, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 5"

WRITES = {
    create_nodes: "SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal FROM customer",
    create_rels: "SELECT n_name AS n, r_name AS r, (n_nationkey * 2)::BIGINT AS w, 'IN' AS t FROM nation JOIN region ON n_regionkey = r_regionkey",
    merge_node: "SELECT c_mktsegment AS name, 1::BIGINT AS made, CASE WHEN count(*) > 1 THEN true END AS met FROM customer GROUP BY 1",
    merge_rel: "SELECT n_name AS n, true AS again, CASE WHEN n_nationkey < 5 THEN 'sea of ' || n_name END AS sea FROM nation",
    set_variants: "SELECT n_nationkey::BIGINT AS k, CASE WHEN n_nationkey = 3 THEN 'three' WHEN n_nationkey < 20 THEN n_name END AS name, CASE WHEN n_nationkey < 10 THEN n_nationkey * 2 END::BIGINT AS twice, CASE WHEN n_nationkey < 20 AND n_nationkey <> 3 THEN n_regionkey END::BIGINT AS r, CASE WHEN n_nationkey >= 20 THEN 'k' END AS only, n_nationkey < 10 AS low, CASE WHEN n_nationkey >= 10 THEN n_nationkey * 2 END::BIGINT AS w FROM nation",
    remove_props: "SELECT n_nationkey::BIGINT AS k, CASE WHEN n_nationkey % 2 = 1 THEN n_name END AS name, n_nationkey % 2 = 1 OR n_nationkey <= 10 AS n, n_nationkey % 2 = 0 AS even FROM nation",
    detach_delete: "SELECT n_name AS n, CASE WHEN r_name NOT IN ('ASIA', 'EUROPE') THEN r_name END AS r FROM nation JOIN region ON n_regionkey = r_regionkey",
    unique_violation: "SELECT count(*) AS n, true AS violated FROM nation",
    show_indexes: "SELECT * FROM (VALUES ('by_w', 'IN', 'w', 'RELATIONSHIP'), ('index_N_k', 'N', 'k', 'NODE')) t(name, label, property, entity)",
    show_constraints: "SELECT 'constraint_R_k' AS name, 'R' AS label, 'k' AS property, 'UNIQUE' AS type",
    live_full_diff: f"WITH a AS (SELECT r, min(name) AS low, count(*) AS n FROM ({_OLD}) GROUP BY r), b AS (SELECT r, min(name) AS low, count(*) AS n FROM ({_NEW}) GROUP BY r) SELECT *, 'added' AS change, 'full' AS mode FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) UNION ALL SELECT *, 'removed', 'full' FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)",
    live_anchored_diff: f"WITH a AS (SELECT name AS n, r FROM ({_OLD})), b AS (SELECT name AS n, r FROM ({_NEW})) SELECT *, 'added' AS change, 'anchored' AS mode FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) UNION ALL SELECT *, 'removed', 'anchored' FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)",
    parity_seed_index: "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey > 5 AND n_nationkey < 20",
}
QUERIES |= {f.__name__: f for f in WRITES}
SQL |= {f.__name__: s for f, s in WRITES.items()}
QUERIES |= {f.__name__: f for f in SURFACE}
SQL |= {f.__name__: s for f, s in SURFACE.items()}

"""Registered queries over the driver's tables as a graph, each with equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork import fluent as Q
from knotwork.engine import Engine
from knotwork.operators import algorithms as A
from knotwork.operators import idsets, traversal, writes
from knotwork.plans.compiler import Config
from knotwork.sources import metrics
from knotwork.sources.mapping import SHIFT, TAGS, TURNS, events_dynamic, ident, table_graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Query texts by name, for the formatter and the plan corpus.
TEXTS: dict[str, str] = {}

TT = "tt AS (SELECT s, e FROM (SELECT c_nationkey s, s_nationkey e, row_number() OVER (PARTITION BY c_nationkey ORDER BY sum(l_extendedprice * (1 - l_discount)) DESC, s_nationkey) r FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) WHERE r <= 2)"
NX = "nx AS (SELECT s, e FROM (SELECT event_id s, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) e FROM events) WHERE e IS NOT NULL)"


def trails(n: int, table: str = "tt", big: int = 100) -> str:
    """SQL for the trails of up to n edges: w(root, nxt, depth, path)."""
    cte = TT if table == "tt" else NX
    return f"{cte}, w AS (SELECT s root, e nxt, 1 depth, [s * {big} + e] path, s = e lp FROM {table} UNION ALL SELECT root, t.e, depth + 1, list_append(path, t.s * {big} + t.e), false FROM w JOIN {table} t ON w.nxt = t.s WHERE depth < {n} AND NOT lp AND NOT list_contains(path, t.s * {big} + t.e))"


REACHED = f"{TT}, bf AS (SELECT s root, e nxt, 1 depth FROM tt UNION SELECT root, tt.e, depth + 1 FROM bf JOIN tt ON bf.nxt = tt.s WHERE depth < 25), rc AS (SELECT root, nxt, min(depth) depth FROM bf GROUP BY 1, 2)"


def num(kind: str, key: str) -> str:
    return f"({TAGS[kind] * SHIFT} + {key})"


def cypher(name: str, text: str, sql: str | None = None, post: Callable[[DataFrame], DataFrame] | None = None, config: Config | None = None, dynamic: bool = False, **params) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        graph = (events_dynamic if dynamic else table_graph)(spark, sf_dir)
        out = Engine(graph, config).query(text, **params)
        return post(out) if post else out

    QUERIES[name] = run
    TEXTS[name] = text
    if sql:
        ORACLE_SQL[name] = sql


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def rounded(*cols: str):
    return lambda df: df.withColumns({c: F.round(c, 2) for c in cols})


def joined(*cols: str):
    return lambda df: df.withColumns({c: F.array_join(F.array_sort(F.col(c).cast("array<string>")), ",") for c in cols})


def in_order(*cols: str):
    return lambda df: df.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in cols})


# patterns and clauses

cypher("entry", "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE c.c_mktsegment = 'BUILDING' RETURN o.o_orderstatus AS s, count(o) AS n ORDER BY n DESC", "SELECT o_orderstatus AS s, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
cypher("node_scan", "MATCH (n) RETURN count(n) AS n", "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) + (SELECT count(DISTINCT user_id) FROM events) + (SELECT count(*) FROM events) + (SELECT count(*) FROM documents) + (SELECT count(*) FROM conversations) AS n")
cypher("label_scan", "MATCH (n:Supplier) RETURN id(n) AS id, n.s_name AS name", f"SELECT {num('Supplier', 's_suppkey')} AS id, s_name AS name FROM supplier")
cypher("multi_label", "MATCH (n:Customer:Party) WHERE n.c_acctbal > 5000 RETURN count(n) AS n", "SELECT count(*) AS n FROM customer WHERE c_acctbal > 5000")
cypher("label_any", "MATCH (n:Party) RETURN size(labels(n)) AS k, count(*) AS n", "SELECT 2::BIGINT AS k, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n")
cypher("label_or", "MATCH (n) WHERE n:Region OR n:Nation RETURN coalesce(n.r_name, n.n_name) AS name", "SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation")
cypher("inline_props", "MATCH (n:Nation {n_regionkey: 2})-[:IN_REGION]->(r:Region {r_regionkey: 2}) RETURN n.n_name AS n, r.r_name AS r", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = 2")
cypher("param_props", "MATCH (n:Nation $p) WHERE n.n_nationkey >= $low RETURN n.n_name AS n", "SELECT n_name AS n FROM nation WHERE n_regionkey = 1 AND n_nationkey >= 6", p={"n_regionkey": 1}, low=6)
cypher("rel_scan", "MATCH (o:Order)-[r:CONTAINS]->(p:Part) WHERE r.quantity >= 49 RETURN o.o_orderkey AS o, p.p_partkey AS p, r.lines AS n", "SELECT l_orderkey AS o, l_partkey AS p, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING sum(l_quantity) >= 49")
cypher("rel_types", "MATCH (a)-[r:PLACED|IN_NATION]->(b) RETURN type(r) AS t, count(*) AS n", "SELECT 'PLACED' AS t, count(*) AS n FROM orders UNION ALL SELECT 'IN_NATION', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)")
cypher("inbound", "MATCH (r:Region)<-[:IN_REGION]-(n:Nation) RETURN r.r_name AS r, count(n) AS n", "SELECT r_name AS r, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
cypher("undirected", "MATCH (a:Nation)-[:TOP_TRADE]-(b:Nation) RETURN a.n_nationkey AS a, b.n_nationkey AS b", f"WITH {TT} SELECT s AS a, e AS b FROM tt WHERE s <> e UNION ALL SELECT e, s FROM tt WHERE s <> e")
cypher("two_hop", "MATCH (c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN r.r_name AS r, count(c) AS n", "SELECT r_name AS r, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
cypher("three_hop", "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o:Order) WHERE o.o_orderpriority = '1-URGENT' RETURN r.r_name AS r, count(o) AS n", "SELECT r_name AS r, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1")
cypher("cycle_two_hop", "MATCH (a:Nation)-[:TOP_TRADE]->(b:Nation)-[:TOP_TRADE]->(a) RETURN a.n_nationkey AS a, b.n_nationkey AS b", f"WITH {TT} SELECT x.s AS a, x.e AS b FROM tt x JOIN tt y ON x.e = y.s AND y.e = x.s WHERE x.s <> x.e OR y.s <> x.s")
cypher("edge_unique", "MATCH (a)-[r:TOP_TRADE]-(b)-[q:TOP_TRADE]-(c) RETURN count(*) AS n", f"WITH {TT}, u AS (SELECT s a, e b, s * 100 + e i FROM tt WHERE s <> e UNION ALL SELECT e, s, s * 100 + e FROM tt WHERE s <> e) SELECT count(*) AS n FROM u x JOIN u y ON x.b = y.a AND x.i <> y.i")
cypher("cross_theta", "MATCH (a:Nation), (s:Supplier) WHERE a.n_nationkey = s.s_nationkey AND s.s_acctbal > a.n_nationkey * 100 RETURN count(*) AS n", "SELECT count(*) AS n FROM nation, supplier WHERE n_nationkey = s_nationkey AND s_acctbal > n_nationkey * 100")
cypher("entity_neq", "MATCH (a:Nation)-[:IN_REGION]->(r)<-[:IN_REGION]-(b:Nation) WHERE a <> b RETURN r.r_regionkey AS r, count(*) AS n", "SELECT a.n_regionkey AS r, count(*) AS n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey GROUP BY 1")
cypher("bound_pair", "MATCH (a:Nation)-[r:TOP_TRADE]->(b:Nation) MATCH (a)-[:IN_REGION]->(x)<-[:IN_REGION]-(b) RETURN a.n_nationkey AS a, b.n_nationkey AS b", f"WITH {TT} SELECT s AS a, e AS b FROM tt JOIN nation x ON s = x.n_nationkey JOIN nation y ON e = y.n_nationkey WHERE x.n_regionkey = y.n_regionkey AND s <> e")
cypher("optional_match", "MATCH (n:Nation) OPTIONAL MATCH (n)<-[:IN_NATION]-(s:Supplier) WHERE s.s_acctbal > 9000 RETURN n.n_name AS n, s.s_name AS s", "SELECT n_name AS n, s_name AS s FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000")
cypher("optional_chain", "MATCH (n:Nation) OPTIONAL MATCH (n)<-[:IN_NATION]-(s:Supplier) WHERE s.s_acctbal > 9500 OPTIONAL MATCH (s)<-[:SUPPLIED_BY]-(o:Order) RETURN n.n_name AS n, count(DISTINCT s) AS s, count(o) AS o", "SELECT n_name AS n, count(DISTINCT s_suppkey) AS s, count(l_orderkey) AS o FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9500 LEFT JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) ON l_suppkey = s_suppkey GROUP BY 1")
cypher("optional_count_zero", "MATCH (c:Customer) OPTIONAL MATCH (c)-[r:PLACED]->(o:Order) WHERE o.o_totalprice > 400000 WITH c, count(r) AS k WHERE k = 0 RETURN count(c) AS n", "SELECT count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
cypher("with_having", "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(o) AS k WHERE k > 15 RETURN c.c_name AS c, k", "SELECT c_name AS c, count(*) AS k FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name HAVING count(*) > 15")
cypher("with_distinct", "MATCH (o:Order) WITH DISTINCT o.o_orderstatus AS s, o.o_orderpriority AS p RETURN s, p", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders")
cypher("return_star", "MATCH (r:Region) WITH r.r_name AS name, r.r_regionkey AS key RETURN *", "SELECT r_name AS name, r_regionkey AS key FROM region")
cypher("skip_limit", "MATCH (c:Customer) RETURN c.c_custkey AS k, c.c_acctbal AS b ORDER BY b DESC, k SKIP 5 LIMIT 10", "SELECT c_custkey AS k, c_acctbal AS b FROM customer ORDER BY b DESC, k LIMIT 10 OFFSET 5")
cypher("topk", "MATCH (o:Order) RETURN o.o_orderkey AS k, o.o_totalprice AS p ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 20", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY p DESC, k LIMIT 20")
cypher("null_order", "MATCH (n:Place) WITH n.n_nationkey AS k, n.r_name AS r ORDER BY k, r LIMIT 27 RETURN k, r", "SELECT n_nationkey AS k, r_name AS r FROM (SELECT n_nationkey, NULL::VARCHAR r_name FROM nation UNION ALL SELECT NULL, r_name FROM region) ORDER BY k ASC NULLS LAST, r ASC NULLS LAST LIMIT 27")
cypher("unwind_list", "UNWIND [3, 1, 2] AS x UNWIND ['a', 'b'] AS y RETURN x * 10 AS x, y", "SELECT x * 10 AS x, y FROM (SELECT unnest([3::BIGINT, 1, 2]) x), (SELECT unnest(['a', 'b']) y)")
cypher("unwind_labels", "MATCH (n:Party) UNWIND labels(n) AS l RETURN l, count(*) AS n", "SELECT 'Customer' AS l, count(*) AS n FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Party', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)")
cypher("multipart", "MATCH (n:Nation)<-[:IN_NATION]-(s:Supplier) WITH n, count(s) AS k ORDER BY k DESC, n.n_nationkey LIMIT 5 MATCH (n)<-[:IN_NATION]-(c:Customer) RETURN n.n_name AS n, k, count(c) AS c", "WITH t AS (SELECT n_nationkey, n_name, count(*) k FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2 ORDER BY k DESC, n_nationkey LIMIT 5) SELECT n_name AS n, k, count(*) AS c FROM t JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
cypher("union_all", "MATCH (n:Nation) RETURN n.n_name AS x UNION ALL MATCH (r:Region) RETURN r.r_name AS x", "SELECT n_name AS x FROM nation UNION ALL SELECT r_name FROM region")
cypher("quoted_names", "MATCH (`a b`:Region) RETURN `a b`.`r_name` AS `the name`", 'SELECT r_name AS "the name" FROM region')

# predicates and operators

cypher("starts_with", "MATCH (p:Part) WHERE p.p_name STARTS WITH 'hot' RETURN count(p) AS n", "SELECT count(*) AS n FROM part WHERE starts_with(p_name, 'hot')")
cypher("ends_with", "MATCH (p:Part) WHERE p.p_name ENDS WITH 'bolt' RETURN count(p) AS n", "SELECT count(*) AS n FROM part WHERE ends_with(p_name, 'bolt')")
cypher("contains", "MATCH (d:Document) WHERE d.text CONTAINS 'the' RETURN d.lang AS lang, count(d) AS n", "SELECT lang, count(*) AS n FROM documents WHERE contains(text, 'the') GROUP BY 1")
cypher("literal_wildcards", "MATCH (p:Part) WHERE p.p_name CONTAINS '%' OR p.p_brand CONTAINS '#1' RETURN count(p) AS n", "SELECT count(*) AS n FROM part WHERE contains(p_name, '%') OR contains(p_brand, '#1')")
cypher("not_contains_missing", "MATCH (n:Place) WHERE NOT n.r_name CONTAINS 'A' RETURN count(n) AS n", "SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM region WHERE NOT contains(r_name, 'A')) AS n")
cypher("regex", "MATCH (p:Part) WHERE p.p_type =~ 'S.*L' RETURN p.p_type AS t, count(p) AS n", "SELECT p_type AS t, count(*) AS n FROM part WHERE regexp_matches(p_type, 'S.*L') GROUP BY 1")
cypher("in_list", "MATCH (n:Nation) WHERE n.n_nationkey IN [1, 3, 5] AND NOT n.n_name IN ['NATION_3'] RETURN n.n_name AS n", "SELECT n_name AS n FROM nation WHERE n_nationkey IN (1, 3, 5) AND n_name <> 'NATION_3'")
cypher("in_array", "MATCH (n:Place) WHERE 'Region' IN labels(n) RETURN n.r_name AS n", "SELECT r_name AS n FROM region")
cypher("is_null", "MATCH (n:Place) WHERE n.n_name IS NULL AND n.r_name IS NOT NULL RETURN count(n) AS n", "SELECT count(*) AS n FROM region")
cypher("xor", "MATCH (c:Customer) WHERE c.c_acctbal > 5000 XOR c.c_mktsegment = 'BUILDING' RETURN count(c) AS n", "SELECT count(*) AS n FROM customer WHERE (c_acctbal > 5000) <> (c_mktsegment = 'BUILDING')")
cypher("comparison_chain", "MATCH (p:Part) WHERE 10 <= p.p_size < 20 RETURN count(p) AS n", "SELECT count(*) AS n FROM part WHERE p_size >= 10 AND p_size < 20")
cypher("arith_intdiv", "MATCH (n:Nation) RETURN n.n_nationkey AS k, n.n_nationkey / 4 AS q, n.n_nationkey % 4 AS r, -n.n_nationkey + 2 ^ 3 AS e", "SELECT n_nationkey AS k, (n_nationkey // 4)::BIGINT AS q, (n_nationkey % 4)::BIGINT AS r, (-n_nationkey + 8)::DOUBLE AS e FROM nation")
cypher("concat", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.n_name + '/' + r.r_name AS x", "SELECT n_name || '/' || r_name AS x FROM nation JOIN region ON n_regionkey = r_regionkey")
cypher("case_when", "MATCH (c:Customer) RETURN CASE WHEN c.c_acctbal < 0 THEN 'debt' WHEN c.c_acctbal > 5000 THEN 'rich' ELSE 'mid' END AS k, count(c) AS n", "SELECT CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal > 5000 THEN 'rich' ELSE 'mid' END AS k, count(*) AS n FROM customer GROUP BY 1")
for _kind, _sql in (("any", "count(*) FILTER (l_quantity > 45) > 0"), ("all", "count(*) FILTER (l_quantity > 10) = count(*)"), ("none", "count(*) FILTER (l_quantity > 45) = 0"), ("single", "count(*) FILTER (l_quantity > 45) = 1")):
    cypher(_kind, f"MATCH (o:Order)-[r:CONTAINS]->(p:Part) WITH o, collect(r.quantity) AS qs WHERE {_kind}(q IN qs WHERE q > {10 if _kind == 'all' else 45}) RETURN count(o) AS n", f"SELECT count(*) AS n FROM (SELECT l_orderkey FROM (SELECT l_orderkey, l_partkey, sum(l_quantity) l_quantity FROM lineitem GROUP BY 1, 2) GROUP BY 1 HAVING {_sql})")
cypher("list_index", "MATCH (d:Document) RETURN split(d.source, 'c')[1] AS x, count(d) AS n", "SELECT split_part(source, 'c', 2) AS x, count(*) AS n FROM documents GROUP BY 1")
cypher("comprehension", "UNWIND [[1, 2, 3], [4, 5]] AS xs RETURN [x IN xs WHERE x > 1 | x * 2] AS ys", "SELECT * FROM (VALUES ('4,6'), ('8,10')) t(ys)", in_order("ys"))

# aggregation and functions

cypher("count_distinct", "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN count(*) AS n, count(DISTINCT c) AS c, count(DISTINCT o.o_orderpriority) AS p", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS c, count(DISTINCT o_orderpriority) AS p FROM orders")
cypher("sum_avg", "MATCH (o:Order) RETURN o.o_orderstatus AS s, sum(o.o_totalprice) AS t, avg(o.o_totalprice) AS a", "SELECT o_orderstatus AS s, round(sum(o_totalprice), 2) AS t, round(avg(o_totalprice), 2) AS a FROM orders GROUP BY 1", rounded("t", "a"))
cypher("min_max", "MATCH (p:Part) RETURN p.p_brand AS b, min(p.p_name) AS lo, max(p.p_retailprice) AS hi", "SELECT p_brand AS b, min(p_name) AS lo, max(p_retailprice) AS hi FROM part GROUP BY 1")
cypher("collect", "MATCH (r:Region)<-[:IN_REGION]-(n:Nation) RETURN r.r_name AS r, collect(n.n_name) AS ns", "SELECT r_name AS r, string_agg(n_name, ',' ORDER BY n_name) AS ns FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1", joined("ns"))
cypher("collect_distinct", "MATCH (c:Customer) RETURN c.c_nationkey AS k, collect(DISTINCT c.c_mktsegment) AS s", "SELECT c_nationkey AS k, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS s FROM customer GROUP BY 1", joined("s"))
cypher("collect_size", "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, size(collect(o)) AS k RETURN k, count(c) AS n", "SELECT k, count(*) AS n FROM (SELECT count(*) k FROM orders GROUP BY o_custkey) GROUP BY 1")
cypher("membership_collect", "MATCH (s:Supplier) WHERE s.s_acctbal > 9000 WITH collect(s) AS rich MATCH (o:Order)-[:SUPPLIED_BY]->(x:Supplier) WHERE x IN rich RETURN count(DISTINCT o) AS n", "SELECT count(DISTINCT l_orderkey) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 9000")
cypher("agg_arith", "MATCH (n:Nation)<-[:IN_NATION]-(c:Customer) RETURN toInteger(n.n_regionkey) + count(c) AS x, count(c) * 2 AS y", "SELECT n_regionkey + count(*) AS x, count(*) * 2 AS y FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_regionkey")
cypher("labels", "MATCH (n:Place) RETURN labels(n) AS l, count(n) AS n", "SELECT 'Region,Place' AS l, count(*) AS n FROM region UNION ALL SELECT 'Nation,Place', count(*) FROM nation", in_order("l"))
cypher("type", "MATCH (n:Nation)-[r]->(m) RETURN type(r) AS t, count(*) AS n", f"WITH {TT} SELECT 'IN_REGION' AS t, count(*) AS n FROM nation UNION ALL SELECT 'TOP_TRADE', count(*) FROM tt")
cypher("start_end_node", "MATCH ()-[r:TOP_TRADE]->() RETURN startNode(r).n_name AS a, endNode(r).n_name AS b", f"WITH {TT} SELECT x.n_name AS a, y.n_name AS b FROM tt JOIN nation x ON s = x.n_nationkey JOIN nation y ON e = y.n_nationkey")
cypher("path_nodes", "MATCH p = (n:Nation)-[:TOP_TRADE]->(m:Nation)-[:IN_REGION]->(r:Region) RETURN [x IN nodes(p) | coalesce(x.n_name, x.r_name)] AS ns, length(p) AS l", f"WITH {TT} SELECT x.n_name || ',' || y.n_name || ',' || r_name AS ns, 2::BIGINT AS l FROM tt JOIN nation x ON s = x.n_nationkey JOIN nation y ON e = y.n_nationkey JOIN region ON y.n_regionkey = r_regionkey", in_order("ns"))
cypher("path_inbound", "MATCH p = (r:Region)<-[:IN_REGION]-(n:Nation) RETURN [x IN nodes(p) | coalesce(x.n_name, x.r_name)] AS ns, [e IN relationships(p) | type(e)] AS ts", "SELECT r_name || ',' || n_name AS ns, 'IN_REGION' AS ts FROM nation JOIN region ON n_regionkey = r_regionkey", in_order("ns", "ts"))
cypher("path_rels", "MATCH p = (a:Nation)-[:TOP_TRADE*2..2]->(b) WHERE all(r IN relationships(p) WHERE type(r) = 'TOP_TRADE') RETURN count(p) AS n, count(DISTINCT a) AS a", f"WITH {trails(2).replace('WITH ', '')} SELECT count(*) AS n, count(DISTINCT root) AS a FROM w WHERE depth = 2".replace("WITH tt", "WITH RECURSIVE tt"))
cypher("single_node_path", "MATCH p = (r:Region) RETURN size(nodes(p)) AS n, size(relationships(p)) AS m, count(*) AS c", "SELECT 1::BIGINT AS n, 0::BIGINT AS m, count(*) AS c FROM region")
cypher("head_tail", "MATCH (r:Region)<-[:IN_REGION]-(n:Nation) WITH r, n ORDER BY n.n_nationkey WITH r, collect(n.n_name) AS ns RETURN r.r_name AS r, size(tail(ns)) AS t, head([r.r_regionkey, 7]) AS h, last(['a', r.r_name]) AS l", "SELECT r_name AS r, count(*) - 1 AS t, r_regionkey AS h, r_name AS l FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name, r_regionkey")
cypher("coalesce", "MATCH (n:Party) RETURN coalesce(n.c_name, n.s_name) AS x, coalesce(n.c_acctbal, n.s_acctbal, 0.0) AS b", "SELECT c_name AS x, c_acctbal AS b FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier")
cypher("split", "MATCH (n:Nation) RETURN size(split(n.n_name, '_')) AS k, head(split(n.n_name, '_')) AS h, count(*) AS n", "SELECT 2::BIGINT AS k, 'NATION' AS h, count(*) AS n FROM nation")
cypher("case_functions", "MATCH (r:Region) RETURN toLower(r.r_name) AS a, toUpper(toLower(r.r_name)) AS b", "SELECT lower(r_name) AS a, upper(r_name) AS b FROM region")
cypher("to_string", "MATCH (n:Nation) RETURN 'k' + toString(n.n_nationkey) AS x", "SELECT 'k' || n_nationkey AS x FROM nation")
cypher("to_integer", "MATCH (n:Nation) RETURN sum(toInteger(last(split(n.n_name, '_')))) AS x", "SELECT sum(split_part(n_name, '_', 2)::DOUBLE) AS x FROM nation")
cypher("date_arith", "MATCH (o:Order) WHERE o.o_orderdate >= localdatetime('1995-01-01T00:00:00') AND o.o_orderdate < localdatetime('1995-01-01T00:00:00') + duration('P1M10DT12H') RETURN count(o) AS n", "SELECT count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-01-01' + INTERVAL 1 MONTH + INTERVAL 10 DAY + INTERVAL 12 HOUR")
cypher("epoch_seconds", "MATCH (r:Region) WHERE datetime().epochseconds > 1000000000 AND datetime().epochmillis > 1000000000000 AND date('2020-01-31') < date() RETURN count(r) AS n", "SELECT count(*) AS n FROM region")

# pattern predicates

cypher("pattern_pred", "MATCH (c:Customer) WHERE (c)-[:PLACED]->(:Order {o_orderstatus: 'P'}) RETURN count(c) AS n", "SELECT count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
cypher("not_pattern_pred", "MATCH (p:Part) WHERE NOT (p)<-[:CONTAINS]-() RETURN count(p) AS n", "SELECT count(*) AS n FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)")
cypher("pattern_pred_or", "MATCH (n:Nation) WHERE (n)-[:TOP_TRADE]->(n) OR n.n_nationkey < 3 RETURN n.n_nationkey AS k", f"WITH {TT} SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 3 OR EXISTS (SELECT 1 FROM tt WHERE s = e AND s = n_nationkey)")
cypher("multi_step_pred", "MATCH (s:Supplier) WHERE (s)<-[:SUPPLIED_BY]-(:Order)<-[:PLACED]-(:Customer {c_mktsegment: 'MACHINERY'}) RETURN count(s) AS n", "SELECT count(*) AS n FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_suppkey = s_suppkey AND c_mktsegment = 'MACHINERY')")
cypher("undirected_pred", "MATCH (a:Nation), (b:Nation) WHERE a.n_nationkey < b.n_nationkey AND (a)-[:TOP_TRADE]-(b) RETURN a.n_nationkey AS a, b.n_nationkey AS b", f"WITH {TT} SELECT DISTINCT least(s, e) AS a, greatest(s, e) AS b FROM tt WHERE s <> e")

# expansion and shortest paths

_R = "WITH RECURSIVE "
cypher("varlen_1_3", "MATCH (a:Nation)-[:TOP_TRADE*1..3]->(b:Nation) RETURN a.n_nationkey AS a, b.n_nationkey AS b, count(*) AS n", f"{_R}{trails(3)} SELECT root AS a, nxt AS b, count(*) AS n FROM w GROUP BY 1, 2")
cypher("varlen_min", "MATCH (a:Nation)-[:TOP_TRADE*3..5]->(b:Nation) WHERE a.n_nationkey < 5 RETURN a.n_nationkey AS a, count(*) AS n", f"{_R}{trails(5)} SELECT root AS a, count(*) AS n FROM w WHERE depth >= 3 AND root < 5 GROUP BY 1")
cypher("varlen_zero", "MATCH (a:Nation)-[:TOP_TRADE*0..2]->(b:Nation) RETURN a.n_nationkey AS a, b.n_nationkey AS b, count(*) AS n", f"{_R}{trails(2)} SELECT a, b, count(*) AS n FROM (SELECT root AS a, nxt AS b FROM w UNION ALL SELECT n_nationkey, n_nationkey FROM nation) GROUP BY 1, 2")
cypher("varlen_selfloop", "MATCH (a:Nation)-[:TOP_TRADE*1..4]->(a) RETURN a.n_nationkey AS a, count(*) AS n", f"{_R}{trails(4)} SELECT root AS a, count(*) AS n FROM w WHERE root = nxt GROUP BY 1")
cypher("varlen_path", "MATCH p = (a:Nation)-[:TOP_TRADE*1..3]->(b:Nation) WHERE a.n_nationkey = 2 RETURN [x IN nodes(p) | x.n_nationkey] AS ks", f"{_R}{trails(3)} SELECT '2,' || array_to_string(list_transform(path, lambda x: x % 100), ',') AS ks FROM w WHERE root = 2", in_order("ks"))
cypher("varlen_rel_list", "MATCH (a:Nation {n_nationkey: 1})-[r:TOP_TRADE*1..2]->(b) RETURN size(r) AS k, count(*) AS n", f"{_R}{trails(2)} SELECT depth::BIGINT AS k, count(*) AS n FROM w WHERE root = 1 GROUP BY 1")
cypher("varlen_long", "MATCH (a:Event)-[:NEXT*..6]->(b:Event) WHERE a.event_type = 'click' RETURN count(*) AS n", f"{_R}{trails(6, 'nx', 100000000)} SELECT count(*) AS n FROM w JOIN events ON root = event_id WHERE event_type = 'click'")
cypher("varlen_distinct", "MATCH (a:Nation)-[:TOP_TRADE*]->(b:Nation) WHERE a.n_nationkey = 0 RETURN DISTINCT b.n_nationkey AS b", f"{_R}{REACHED} SELECT nxt AS b FROM rc WHERE root = 0 AND depth <= 15")
cypher("varlen_inbound_path", "MATCH p = (a:Nation)<-[:TOP_TRADE*1..2]-(b:Nation {n_nationkey: 7}) RETURN [x IN nodes(p) | x.n_nationkey] AS ks", f"{_R}{trails(2)} SELECT array_to_string(list_reverse(list_transform(path, lambda x: x % 100)), ',') || ',7' AS ks FROM w WHERE root = 7", in_order("ks"))
cypher("shortest_path", "MATCH p = shortestPath((a:Nation)-[:TOP_TRADE*]->(b:Nation)) WHERE a.n_nationkey <> b.n_nationkey RETURN a.n_nationkey AS a, b.n_nationkey AS b, length(p) AS l", f"{_R}{REACHED} SELECT root AS a, nxt AS b, depth::BIGINT AS l FROM rc WHERE root <> nxt AND depth <= 15")
cypher("all_shortest", "MATCH p = allShortestPaths((a:Nation {n_nationkey: 3})-[:TOP_TRADE*..6]->(b:Nation)) WHERE a <> b RETURN b.n_nationkey AS b, count(p) AS n", f"{_R}{trails(6)} SELECT b, count(*) AS n FROM (SELECT nxt AS b, rank() OVER (PARTITION BY nxt ORDER BY depth) r FROM w WHERE root = 3 AND nxt <> 3) WHERE r = 1 GROUP BY 1")

# property bags

cypher("dynamic_equal", "MATCH (e:Event) WHERE e.type = 'click' AND e.k > 50 RETURN count(e) AS n, min(e.k) AS lo", "SELECT count(*) AS n, min((props::JSON->>'k')::INT)::VARCHAR AS lo FROM events WHERE event_type = 'click' AND (props::JSON->>'k')::INT > 50", dynamic=True)
cypher("dynamic_types", "MATCH (e:Event) WHERE e.k <> '7' AND e.k = 7 RETURN count(e) AS n", "SELECT count(*) AS n FROM events WHERE (props::JSON->>'k')::INT = 7", dynamic=True)
cypher("dynamic_order", "MATCH (u:User)-[:PERFORMED]->(e:Event) WHERE e.k IS NOT NULL RETURN u.user_id AS u, max(e.k) AS hi ORDER BY u LIMIT 10", "SELECT user_id::VARCHAR AS u, max((props::JSON->>'k')::INT)::VARCHAR AS hi FROM events GROUP BY user_id ORDER BY user_id LIMIT 10", dynamic=True)
cypher("events_per_user", "MATCH (u:User)-[:PERFORMED]->(e:Event) RETURN e.event_type AS t, count(DISTINCT u) AS u, count(e) AS n", "SELECT event_type AS t, count(DISTINCT user_id) AS u, count(*) AS n FROM events GROUP BY 1")
cypher("replies", "MATCH (a:Message)-[:REPLIES]->(b:Message) WHERE a.role = 'user' RETURN b.role AS r, count(*) AS n", "SELECT r, count(*) AS n FROM (SELECT role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) r FROM conversations) WHERE role = 'user' AND r IS NOT NULL GROUP BY 1")


# algorithms

def _trade(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nation nodes and TOP_TRADE edges with nation keys as ids."""
    g = table_graph(spark, sf_dir)
    cut = TAGS["Nation"] * SHIFT
    nodes = g.node_scan(["Nation"])[0].select((F.col("id") - cut).alias("id"))
    edges = g.edge_scan(["TOP_TRADE"])[0].select("id", (F.col("start_id") - cut).alias("start_id"), (F.col("end_id") - cut).alias("end_id"))
    from knotwork.scratch import Scratch

    return nodes, Scratch(spark, "trade").write(edges)


def _roots(nodes: DataFrame, *keys: int) -> DataFrame:
    return nodes.where(F.col("id").isin(list(keys))).select(F.col("id").alias("root"))


_SCC = f"{REACHED}, sc AS (SELECT n_nationkey::BIGINT AS id, least(n_nationkey, coalesce((SELECT min(x.nxt) FROM rc x JOIN rc y ON x.root = y.nxt AND x.nxt = y.root WHERE x.root = n_nationkey), n_nationkey))::BIGINT AS component FROM nation)"


@query("reach", f"{_R}{REACHED} SELECT root::BIGINT AS root, nxt::BIGINT AS next FROM rc WHERE root IN (0, 9)")
def _reach(spark, sf_dir):
    nodes, edges = _trade(spark, sf_dir)
    return A.reach(edges, _roots(nodes, 0, 9), "out").select("root", "next")


@query("bfs_tree", f"{_R}{REACHED} SELECT root::BIGINT AS root, nxt::BIGINT AS next, depth FROM rc WHERE root = 5")
def _bfs_tree(spark, sf_dir):
    nodes, edges = _trade(spark, sf_dir)
    return A.bfs_tree(edges, _roots(nodes, 5))


@query("degrees", f"WITH {TT} SELECT n_nationkey::BIGINT AS id, (SELECT count(*) FROM tt WHERE e = n_nationkey) AS degree FROM nation")
def _degrees(spark, sf_dir):
    nodes, edges = _trade(spark, sf_dir)
    return A.degrees(nodes, edges, "in")


@query("dimensions", f"WITH {TT} SELECT 25::BIGINT AS nodes, max(c) AS max_degree FROM (SELECT count(*) c FROM tt GROUP BY e)")
def _dimensions(spark, sf_dir):
    return A.dimensions(*_trade(spark, sf_dir), "in")


@query("adjacent", f"WITH {TT} SELECT DISTINCT x::BIGINT AS neighbour FROM (SELECT e x FROM tt WHERE s = 6 UNION SELECT s FROM tt WHERE e = 6)")
def _adjacent(spark, sf_dir):
    return A.adjacent(_trade(spark, sf_dir)[1], 6, "both")


@query("dense_ids", "SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS dense FROM orders")
def _dense(spark, sf_dir):
    return A.dense_ids(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id")))


@query("scc", f"{_R}{_SCC} SELECT id, component FROM sc")
def _scc(spark, sf_dir):
    return A.strong_components(*_trade(spark, sf_dir))


@query("scc_colouring", f"{_R}{_SCC} SELECT id, component FROM sc")
def _scc_colouring(spark, sf_dir):
    return A.strong_components(*_trade(spark, sf_dir), small=0)


@query("condensation", f"{_R}{_SCC} SELECT DISTINCT a.component AS start_id, b.component AS end_id FROM tt JOIN sc a ON s = a.id JOIN sc b ON e = b.id WHERE a.component <> b.component")
def _condensation(spark, sf_dir):
    nodes, edges = _trade(spark, sf_dir)
    return A.condensation(A.strong_components(nodes, edges), edges)


@query("component_histogram", f"{_R}{_SCC} SELECT component, count(*) AS members FROM sc GROUP BY 1")
def _histogram(spark, sf_dir):
    return A.component_histogram(A.strong_components(*_trade(spark, sf_dir)))


_PAIRS = "(SELECT x.n_nationkey::BIGINT AS a, y.n_nationkey::BIGINT AS b FROM nation x, nation y WHERE x.n_nationkey < 6 AND y.n_nationkey > 17)"


@query("can_reach", f"{_R}{REACHED} SELECT a, b, (a = b OR EXISTS (SELECT 1 FROM rc WHERE root = a AND nxt = b)) AS reachable FROM {_PAIRS}")
def _can_reach(spark, sf_dir):
    nodes, edges = _trade(spark, sf_dir)
    pairs = nodes.where("id < 6").select(F.col("id").alias("a")).crossJoin(nodes.where("id > 17").select(F.col("id").alias("b")))
    return A.Reachability(nodes, edges).can_reach(pairs)


@query("or_reach", f"{_R}{REACHED} SELECT DISTINCT nxt::BIGINT AS id FROM rc WHERE root IN (0, 1) AND root <> nxt")
def _or_reach(spark, sf_dir):
    nodes, edges = _trade(spark, sf_dir)
    return A.Reachability(nodes, edges).or_reach(nodes.where("id < 2"))


@query("xor_reach", f"{_R}{REACHED} SELECT nxt::BIGINT AS id FROM rc WHERE root IN (0, 1, 2) AND root <> nxt GROUP BY 1 HAVING count(*) % 2 = 1")
def _xor_reach(spark, sf_dir):
    nodes, edges = _trade(spark, sf_dir)
    return A.Reachability(nodes, edges).xor_reach(nodes.where("id < 3"))


@query("triple_projection", f"WITH {TT} SELECT s::BIGINT AS start_id, e::BIGINT AS end_id FROM tt WHERE s >= 5 AND e >= 5")
def _projection(spark, sf_dir):
    nodes, edges = _trade(spark, sf_dir)
    return A.project_triples(edges, nodes.where("id < 5")).select("start_id", "end_id")


_WALKS = f"{_R}{TT}, w AS (SELECT s root, e nxt, 1 depth FROM tt WHERE s IN (0, 1) UNION ALL SELECT root, tt.e, depth + 1 FROM w JOIN tt ON w.nxt = tt.s WHERE depth < 4)"


@query("walks", f"{_WALKS} SELECT root::BIGINT AS root, nxt::BIGINT AS next, count(*) AS n FROM w WHERE depth = 4 AND nxt IN (SELECT s FROM tt) GROUP BY 1, 2")
def _walks(spark, sf_dir):
    nodes, edges = _trade(spark, sf_dir)
    return A.walks(edges, _roots(nodes, 0, 1), "out", 4)[1].groupBy("root", "next").agg(F.count("*").alias("n"))


def _message_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    g, cut = table_graph(spark, sf_dir), TAGS["Message"] * SHIFT
    nodes = g.node_scan(["Message"])[0].select((F.col("id") - cut).alias("id"))
    return nodes, g.edge_scan(["REPLIES"])[0].select("id", (F.col("start_id") - cut).alias("start_id"), (F.col("end_id") - cut).alias("end_id"))


@query("weighted_terminals", f"SELECT c * {TURNS} AS root, c * {TURNS} + k AS next, pow(0.5, k) AS weight FROM (SELECT conv_id c, max(turn) k FROM conversations GROUP BY 1) WHERE k > 0")
def _weighted(spark, sf_dir):
    nodes, edges = _message_edges(spark, sf_dir)
    roots = nodes.where(f"id % {TURNS} = 0").select(F.col("id").alias("root"))
    return A.weighted_terminals(edges.withColumn("w", F.lit(0.5)), roots, "w", "out")


# traversals

@query("traverse_paths", f"SELECT c * {TURNS} AS root, c * {TURNS} + k AS next, k AS l FROM (SELECT conv_id c, max(turn) k FROM conversations GROUP BY 1) WHERE k > 0")
def _traverse(spark, sf_dir):
    nodes, edges = _message_edges(spark, sf_dir)
    roots = nodes.where(f"id % {TURNS} = 0").select(F.col("id").alias("root"))
    return traversal.paths(edges, roots)[0].select("root", "next", F.size("edge_ids").cast("long").alias("l"))


@query("intermediary_paths", f"SELECT conv_id * {TURNS} AS root, conv_id * {TURNS} + turn AS next FROM conversations WHERE turn > 0 AND role = 'assistant'")
def _intermediary(spark, sf_dir):
    nodes, edges = _message_edges(spark, sf_dir)
    g = Engine(table_graph(spark, sf_dir))
    ends = Q.Nodes(g).filter(Q.kind(Q.NODE, "Message"), Q.equals(Q.prop(Q.NODE, "role"), "assistant")).fetch_ids().select((F.col("id") - TAGS["Message"] * SHIFT).alias("id"))
    roots = nodes.where(f"id % {TURNS} = 0").select(F.col("id").alias("root"))
    return traversal.intermediary_paths(edges, roots, ends).select("root", "next")


@query("acyclic_nodes", f"{_R}{REACHED} SELECT DISTINCT nxt::BIGINT AS id FROM rc WHERE root = 2 UNION SELECT 2")
def _acyclic(spark, sf_dir):
    nodes, edges = _trade(spark, sf_dir)
    return traversal.acyclic_nodes(edges, _roots(nodes, 2)).select("id")


@query("terminals", f"{_R}{REACHED}, lv AS (SELECT nxt id, depth FROM rc WHERE root = 2 AND nxt <> 2 UNION ALL SELECT 2, 0), pa AS (SELECT l.id, min(s) p FROM lv l JOIN tt ON e = l.id JOIN lv q ON q.id = s AND q.depth = l.depth - 1 GROUP BY 1) SELECT id::BIGINT AS id FROM lv WHERE id NOT IN (SELECT p FROM pa)")
def _terminals(spark, sf_dir):
    nodes, edges = _trade(spark, sf_dir)
    return traversal.acyclic_terminals(edges, _roots(nodes, 2)).select("id")


@query("continuation", f"SELECT DISTINCT {num('Order', 'o_orderkey')} AS root, {num('Nation', 'c_nationkey')} AS next FROM orders JOIN customer ON o_custkey = c_custkey")
def _continuation_all(spark, sf_dir):
    g = table_graph(spark, sf_dir)
    roots = g.node_scan(["Order"])[0].select(F.col("id").alias("root"))
    return traversal.Continuation().inbound(1, 1, ["PLACED"]).outbound(1, 1, ["IN_NATION"]).run(g, roots).select("root", "next").distinct()


# id sets

@query("bitmap_ops", "WITH a AS (SELECT DISTINCT o_custkey id FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey id FROM orders WHERE o_orderpriority = '1-URGENT') SELECT (SELECT count(*) FROM (SELECT id FROM a UNION SELECT id FROM b)) AS u, (SELECT count(*) FROM (SELECT id FROM a INTERSECT SELECT id FROM b)) AS i, (SELECT count(*) FROM (SELECT id FROM a EXCEPT SELECT id FROM b)) AS d, (SELECT count(*) FROM (SELECT id FROM a UNION SELECT id FROM b)) - (SELECT count(*) FROM (SELECT id FROM a INTERSECT SELECT id FROM b)) AS x")
def _bitmap(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    a, b = (idsets.IdSet.of(o.where(c), "o_custkey") for c in ("o_orderstatus = 'F'", "o_orderpriority = '1-URGENT'"))
    n = lambda s, name: s.df.agg(F.count("*").alias(name))
    return n(a | b, "u").crossJoin(n(a & b, "i")).crossJoin(n(a - b, "d")).crossJoin(n(a ^ b, "x"))


@query("bitmap_sketch", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1")
def _bitmap_sketch(spark, sf_dir):
    return idsets.bitmap_cardinality(idsets.bitmaps(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderstatus", "o_custkey"), "o_orderstatus")


@query("membership_any_all", "SELECT c_custkey AS id FROM customer WHERE (c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')) AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')")
def _membership(spark, sf_dir):
    o, c = spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"))
    s = lambda cond: idsets.IdSet.of(o.where(cond), "o_custkey")
    return idsets.in_all(idsets.in_any(c, [s("o_orderstatus = 'P'"), s("o_orderstatus = 'F'")]), [s("o_orderpriority = '5-LOW'")])


# fluent API

@query("fluent_nodes", f"SELECT {num('Customer', 'c_custkey')} AS id FROM customer WHERE c_acctbal > 9000 AND contains(lower(c_name), lower('customer#'))")
def _fluent_nodes(spark, sf_dir):
    e = Engine(table_graph(spark, sf_dir))
    return Q.Nodes(e).filter(Q.kind(Q.NODE, "Customer"), Q.greater(Q.prop(Q.NODE, "c_acctbal"), 9000), Q.contains_folded(Q.prop(Q.NODE, "c_name"), "Customer#")).fetch_ids()


@query("fluent_triples", f"WITH {TT} SELECT {num('Nation', 's')} AS start_id, {num('Nation', 'e')} AS end_id FROM tt WHERE s < 10")
def _fluent_triples(spark, sf_dir):
    e = Engine(table_graph(spark, sf_dir))
    return Q.Relationships(e).filter(Q.kind(Q.REL, "TOP_TRADE"), Q.less(Q.prop(Q.START, "n_nationkey"), 10)).fetch_triples().select("start_id", "end_id")


@query("fluent_has_relationships", "SELECT count(*) AS c FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)")
def _fluent_has(spark, sf_dir):
    e = Engine(table_graph(spark, sf_dir))
    return Q.Query(e).where(Q.kind(Q.NODE, "Part"), Q.has_relationships()).returns(Q.as_(Q.count(Q.NODE), "c")).fetch()


# updates

def _after(spark: SparkSession, sf_dir: str, *updates: str) -> Engine:
    e = Engine(table_graph(spark, sf_dir))
    for u in updates:
        e = e.update(u)
    return e


@query("create_node", "SELECT 'Hub' AS k, r_name || '!' AS name FROM region")
def _create_node(spark, sf_dir):
    return _after(spark, sf_dir, "MATCH (r:Region) CREATE (h:Hub {name: r.r_name + '!', size: 3})").query("MATCH (h:Hub) WHERE h.size = 3 RETURN head(labels(h)) AS k, h.name AS name")


@query("create_edge", "SELECT n_name AS a, r_name AS b, 1::BIGINT AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 5")
def _create_edge(spark, sf_dir):
    make = "MATCH (n:Nation)-[:IN_REGION]->(r:Region) WHERE n.n_nationkey < 5 CREATE (r)-[:HOLDS {w: 1}]->(n)"
    return _after(spark, sf_dir, make, make).query("MATCH (r:Region)-[h:HOLDS]->(n:Nation) RETURN n.n_name AS a, r.r_name AS b, count(h) AS n")


@query("set_prop", "SELECT n_nationkey AS k, CASE WHEN n_regionkey = 1 THEN 'x' || n_name ELSE n_name END AS name, CASE WHEN n_regionkey = 1 THEN 7::BIGINT END AS z FROM nation")
def _set_prop(spark, sf_dir):
    return _after(spark, sf_dir, "MATCH (n:Nation {n_regionkey: 1}) SET n.n_name = 'x' + n.n_name, n.z = 7").query("MATCH (n:Nation) RETURN n.n_nationkey AS k, n.n_name AS name, n.z AS z")


@query("set_kind", "SELECT 'Big,Nation,Place' AS l, n_name AS n FROM nation WHERE n_nationkey > 20")
def _set_kind(spark, sf_dir):
    return in_order("l")(_after(spark, sf_dir, "MATCH (n:Nation) WHERE n.n_nationkey > 20 SET n:Big").query("MATCH (n:Big) RETURN labels(n) AS l, n.n_name AS n"))


@query("remove_kind", "SELECT count(*) FILTER (n_nationkey <= 20) AS a, count(*) AS b FROM nation")
def _remove_kind(spark, sf_dir):
    e = _after(spark, sf_dir, "MATCH (n:Nation) WHERE n.n_nationkey > 20 REMOVE n:Place, n.n_regionkey")
    return e.query("MATCH (n:Nation) WHERE n:Place AND n.n_regionkey IS NOT NULL RETURN count(n) AS a").crossJoin(e.query("MATCH (n:Nation) RETURN count(n) AS b"))


@query("delete_detach", "SELECT (SELECT count(*) FROM nation WHERE n_regionkey <> 0) AS n, (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 0) + (SELECT count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 0) AS m")
def _delete(spark, sf_dir):
    e = _after(spark, sf_dir, "MATCH (n:Nation {n_regionkey: 0}) DETACH DELETE n")
    return e.query("MATCH (n:Nation) RETURN count(n) AS n").crossJoin(e.query("MATCH (a)-[r:IN_NATION]->(n) RETURN count(r) AS m"))


@query("delete_edge", f"WITH {TT} SELECT s AS a, e AS b FROM tt WHERE s <> e AND s > 3")
def _delete_edge(spark, sf_dir):
    return _after(spark, sf_dir, "MATCH (a:Nation)-[r:TOP_TRADE]->(b:Nation) WHERE a = b OR a.n_nationkey <= 3 DELETE r").query("MATCH (a:Nation)-[:TOP_TRADE]->(b:Nation) RETURN a.n_nationkey AS a, b.n_nationkey AS b")


@query("delete_by_kind", "SELECT (SELECT count(*) FROM customer) AS n")
def _delete_by_kind(spark, sf_dir):
    g = writes.delete_by_kinds(table_graph(spark, sf_dir), include=["Party"], exclude=["Customer"])
    return Engine(g).query("MATCH (n:Party) RETURN count(n) AS n")


@query("upsert_node", "SELECT n_nationkey AS k, CASE WHEN n_nationkey < 3 THEN 'up' || n_nationkey ELSE n_name END AS name FROM nation UNION ALL SELECT 100, 'new'")
def _upsert_node(spark, sf_dir):
    rows = spark.range(3).select(F.col("id").cast("int").alias("n_nationkey"), F.concat(F.lit("up"), F.col("id")).alias("n_name")).union(spark.sql("select 100, 'new'"))
    g = writes.upsert_nodes(table_graph(spark, sf_dir), rows, ["Nation", "Place"], ["n_nationkey"])
    return Engine(g).query("MATCH (n:Nation) RETURN n.n_nationkey AS k, n.n_name AS name")


@query("upsert_edge", "SELECT count(*) + 1 AS n, 1::BIGINT AS w FROM nation")
def _upsert_edge(spark, sf_dir):
    g = table_graph(spark, sf_dir)
    new = spark.range(2).select((F.col("id") + 5).alias("id"), ident("Nation", "id").alias("start_id"), ident("Region", F.col("id") * 0).alias("end_id"), F.lit("y").alias("p:w"))
    g = writes.upsert_edges(g, new, "IN_REGION", {"w": "p:w"})
    e = Engine(g)
    made = e.query("MATCH (n:Nation)-[r:IN_REGION]->(m) WHERE r.w = 'y' AND n.n_nationkey = 0 RETURN count(r) AS w")
    return e.query("MATCH (n)-[r:IN_REGION]->(m) RETURN count(r) AS n").crossJoin(made)


# documents, metrics, scrubbing

_M = "SELECT {} AS histogram, {}::VARCHAR AS key, count(*) AS count FROM {} GROUP BY 1, 2"


@query(
    "metrics_histograms",
    f"WITH {TT}, d AS (SELECT n_nationkey, (SELECT count(*) FROM tt WHERE e = n_nationkey) i, (SELECT count(*) FROM tt WHERE s = n_nationkey) o FROM nation) SELECT 'node_kind' AS histogram, '6:Nation+5:Place' AS key, count(*) AS count FROM nation UNION ALL SELECT 'edge_kind', '9:TOP_TRADE', count(*) FROM tt UNION ALL {_M.format(chr(39) + 'in_degree' + chr(39), 'i', 'd')} UNION ALL {_M.format(chr(39) + 'out_degree' + chr(39), 'o', 'd')} UNION ALL {_M.format(chr(39) + 'total_degree' + chr(39), '(i + o)', 'd')} UNION ALL SELECT 'endpoint_kind', '16:6:Nation+5:Place|11:9:TOP_TRADE|16:6:Nation+5:Place', count(*) FROM tt",
)
def _metrics(spark, sf_dir):
    g = table_graph(spark, sf_dir)
    return metrics.histograms(type(g)(spark, [s for s in g.nodes if "Nation" in s.static], [s for s in g.edges if "TOP_TRADE" in s.static]))


@query("plain_sql", "SELECT 'TOP_TRADE' AS kind, count(*) AS n FROM (WITH " + TT + " SELECT * FROM tt)")
def _plain_sql(spark, sf_dir):
    return Engine(table_graph(spark, sf_dir)).sql("SELECT kind, count(*) AS n FROM edges WHERE kind = 'TOP_TRADE' GROUP BY 1")


# set-level operations

@query("hydrate", f"SELECT {num('Nation', 'n_nationkey')} AS id, n_name, n_regionkey FROM nation WHERE n_nationkey < 4")
def _hydrate(spark, sf_dir):
    from knotwork.operators import sets

    return sets.hydrate(table_graph(spark, sf_dir), spark.range(4).select(ident("Nation", "id").alias("id")), ["n_name", "n_regionkey"])


@query("node_relationships", f"WITH {TT} SELECT {num('Nation', 's')} AS start_id, {num('Nation', 'e')} AS end_id, 'TOP_TRADE' AS kind FROM tt WHERE s < 3 OR e < 3")
def _relationships(spark, sf_dir):
    from knotwork.operators import sets

    ids = spark.range(3).select(ident("Nation", "id").alias("id"))
    return sets.relationships(table_graph(spark, sf_dir), ids, "both", ["TOP_TRADE"]).drop("id")


@query("far_nodes", f"SELECT DISTINCT {num('Part', 'l_partkey')} AS id FROM lineitem")
def _far_all(spark, sf_dir):
    from knotwork.operators import sets

    g = table_graph(spark, sf_dir)
    return sets.far_nodes(g, g.node_scan(["Order"])[0], "out", ["CONTAINS"])


@query("wipe_retain", "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) AS n")
def _wipe(spark, sf_dir):
    from knotwork.operators import sets

    g = sets.wipe(table_graph(spark, sf_dir), F.array_contains("kinds", "Place"))
    return Engine(g).query("MATCH (n) RETURN count(n) AS n")


@query("upsert_relationship", "SELECT n_name AS a, 'R' || n_nationkey AS b, n_nationkey * 2 AS w FROM nation WHERE n_nationkey < 3 UNION ALL SELECT 'N9', 'R9', 18")
def _upsert_relationship(spark, sf_dir):
    from knotwork.operators import sets

    g = table_graph(spark, sf_dir)
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_nationkey < 3").select(F.col("n_name").alias("start_n_name"), F.concat(F.lit("R"), "n_nationkey").alias("end_title"), (F.col("n_nationkey") * 2).alias("w")).union(spark.sql("select 'N9', 'R9', 18"))
    for _ in range(2):  # the second time changes nothing
        g = sets.upsert_relationships(g, rows, "RULED_BY", (["Nation"], ["n_name"]), (["Ruler"], ["title"]))
    return Engine(g).query("MATCH (a:Nation)-[r:RULED_BY]->(b:Ruler) RETURN a.n_name AS a, b.title AS b, r.w AS w")


@query("schema_faults", "SELECT 'node kind' AS fault, 'Place' AS name, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) AS count UNION ALL SELECT 'unique', 'Nation.n_regionkey', (SELECT count(DISTINCT n_regionkey) FROM nation)")
def _schema(spark, sf_dir):
    from knotwork.operators import sets

    g = table_graph(spark, sf_dir)
    nodes = [s for s in g.nodes if "Place" in s.static]
    edges = [s for s in g.edges if "IN_REGION" in s.static]
    schema = sets.Schema(frozenset(["Region", "Nation"]), frozenset(["IN_REGION"]), {"Nation": "n_regionkey", "Region": "r_name"})
    return schema.faults(type(g)(spark, nodes, edges))


@query("zones", f"{_R}{REACHED} SELECT {num('Nation', 'root')} AS root, {num('Nation', 'nxt')} AS next, depth FROM rc WHERE root < 2")
def _zones(spark, sf_dir):
    from knotwork.operators import sets
    from knotwork.scratch import Scratch

    roots = spark.range(2).select(ident("Nation", "id").alias("root"))
    return sets.write_zones(table_graph(spark, sf_dir), roots, Scratch(spark, "zones").root, "out", ["TOP_TRADE"])


def plan_corpus(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Planner notes and formatted plan of every query text."""
    engines = {d: Engine((events_dynamic if d else table_graph)(spark, sf_dir)) for d in (False, True)}
    return {name: engines[name.startswith("dynamic")].explain(text, **({"p": {"n_regionkey": 1}, "low": 6} if name == "param_props" else {})) for name, text in TEXTS.items()}


from knotwork import catalog_more  # noqa: E402, F401  registers further queries

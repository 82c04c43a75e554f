"""Further registered queries: rarer clauses and types, the builder, larger graphs, documents, dumps, diagnostics."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork import fluent as Q
from knotwork.catalog import NX, ORACLE_SQL, QUERIES, REACHED, TEXTS, TT, _message_edges, _roots, _trade, cypher, num, query, trails
from knotwork.engine import Engine
from knotwork.operators import algorithms as A
from knotwork.operators import idsets, sets, traversal
from knotwork.plans.formatter import complexity
from knotwork.plans.formatter import query as format_query
from knotwork.plans.parser import QueryError, parse
from knotwork.scratch import Scratch
from knotwork.sources import documents, dump, metrics
from knotwork.sources import scrub as scrubbing
from knotwork.sources.mapping import TURNS, events_dynamic, ident, table_graph

_R = "WITH RECURSIVE "

# patterns

#: Undirected trade: each edge both ways, self-edges left out; x tells the edge.
_UT = f"{TT}, ut AS (SELECT s, e, s * 100 + e x FROM tt WHERE s <> e UNION ALL SELECT e, s, s * 100 + e FROM tt WHERE s <> e)"
cypher("varlen_undirected", "MATCH (a:Nation {n_nationkey: 1})-[:TOP_TRADE*1..2]-(b) RETURN b.n_nationkey AS b, count(*) AS n", f"WITH {_UT} SELECT e AS b, count(*) AS n FROM (SELECT e FROM ut WHERE s = 1 UNION ALL SELECT y.e FROM ut z JOIN ut y ON z.e = y.s AND z.x <> y.x WHERE z.s = 1) GROUP BY 1")
cypher("varlen_pred", "MATCH (a:Nation) WHERE (a)-[:TOP_TRADE*2..3]->(:Nation {n_nationkey: 3}) RETURN a.n_nationkey AS a", f"{_R}{trails(3)} SELECT DISTINCT root AS a FROM w WHERE depth >= 2 AND nxt = 3")
cypher("varlen_region", "MATCH (a:Nation {n_nationkey: 4})-[:TOP_TRADE*1..3]->(b:Nation)-[:IN_REGION]->(r:Region) RETURN r.r_name AS r, b.n_name AS b, count(*) AS n", f"{_R}{trails(3)} SELECT r_name AS r, n_name AS b, count(*) AS n FROM w JOIN nation ON nxt = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE root = 4 GROUP BY 1, 2")
cypher("step_after_expansion", "MATCH (a:Nation)-[:TOP_TRADE*1..2]->(b)-[:TOP_TRADE]->(c) WHERE a.n_nationkey < 6 RETURN a.n_nationkey AS a, c.n_nationkey AS c, count(*) AS n", f"{_R}{trails(2)} SELECT root AS a, t.e AS c, count(*) AS n FROM w JOIN tt t ON t.s = w.nxt WHERE root < 6 AND NOT list_contains(path, t.s * 100 + t.e) GROUP BY 1, 2")
cypher("shortest_bound_pairs", "MATCH (a:Nation), (b:Nation) WHERE a.n_nationkey < 4 AND b.n_nationkey > 20 MATCH p = shortestPath((a)-[:TOP_TRADE*]->(b)) RETURN a.n_nationkey AS a, b.n_nationkey AS b, length(p) AS l", f"{_R}{REACHED} SELECT root AS a, nxt AS b, depth::BIGINT AS l FROM rc WHERE root < 4 AND nxt > 20 AND depth <= 15")
cypher("shortest_replies", "MATCH p = shortestPath((a:Message {turn: 0})-[:REPLIES*]->(b:Message {role: 'assistant'})) WHERE a <> b RETURN length(p) AS l, count(*) AS n", "SELECT (b.k - a.k)::BIGINT AS l, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) k FROM conversations) a JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) k FROM conversations) b USING (conv_id) WHERE a.turn = 0 AND b.role = 'assistant' AND b.k > a.k AND b.k - a.k <= 15 GROUP BY 1")


def _raised(spark: SparkSession, kind: type[Exception], run) -> DataFrame:
    try:
        run()
    except kind:
        return spark.range(1).select(F.lit(True).alias("raised"))
    return spark.range(1).select(F.lit(False).alias("raised"))


@query("shortest_self_endpoint", "SELECT true AS raised")
def _self_endpoint(spark, sf_dir):
    e = Engine(table_graph(spark, sf_dir))
    return _raised(spark, QueryError, lambda: e.query("MATCH p = shortestPath((a:Nation {n_regionkey: 1})-[:TOP_TRADE*]->(b:Nation)) RETURN length(p) AS l"))


# expressions and types

cypher("string_escapes", r"MATCH (r:Region {r_regionkey: 0}) RETURN 'it\'s \\ a \"b\"\tc' AS s, size(split('a\\b', '\\')) AS n", "SELECT 'it''s \\ a \"b\"' || chr(9) || 'c' AS s, 2::BIGINT AS n")
cypher("property_vs_property", "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.o_totalprice < c.c_acctbal RETURN count(o) AS n", "SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice < c_acctbal")
cypher("collect_lists", "MATCH (n:Nation) WITH n.n_regionkey AS r, collect(labels(n)) AS ls RETURN r AS r, size(ls) AS n, size(head(ls)) AS k", "SELECT n_regionkey AS r, count(*) AS n, 2::BIGINT AS k FROM nation GROUP BY 1")
cypher("local_times", "MATCH (r:Region {r_regionkey: 0}) RETURN toString(localdatetime('2024-01-02T03:04:05')) AS a, toString(localdatetime('2024-01-02T03:04:05') + duration('P1DT2H')) AS b, localtime('03:04:05') AS c", "SELECT '2024-01-02 03:04:05' AS a, '2024-01-03 05:04:05' AS b, '03:04:05.000000' AS c")


def _updated(graph, *texts: str) -> Engine:
    e = Engine(graph)
    for t in texts:
        e = e.update(t)
    return e


@query("bare_boolean", "SELECT n_nationkey AS k FROM nation WHERE n_nationkey % 2 = 0")
def _bare(spark, sf_dir):
    return _updated(table_graph(spark, sf_dir), "MATCH (n:Nation) SET n.even = (n.n_nationkey % 2 = 0)").query("MATCH (n:Nation) WHERE n.even RETURN n.n_nationkey AS k")


@query("empty_list_property", "SELECT (SELECT count(*) FROM nation WHERE n_regionkey = 2) AS a, (SELECT count(*) FROM nation WHERE n_regionkey = 3) AS b")
def _empty_list(spark, sf_dir):
    e = _updated(table_graph(spark, sf_dir), "MATCH (n:Nation {n_regionkey: 2}) SET n.tags = tail(['x'])", "MATCH (n:Nation {n_regionkey: 3}) SET n.tags = ['y']")
    return e.query("MATCH (n:Nation) WHERE n.tags = [] RETURN count(n) AS a").crossJoin(e.query("MATCH (n:Nation) WHERE n.tags <> [] RETURN count(n) AS b"))


@query("mixed_min_max", "SELECT '\"x\"' AS lo, (SELECT max((props::JSON->>'k')::INT)::VARCHAR FROM events WHERE event_type <> 'click') AS hi, (SELECT count(*) FROM events WHERE event_type = 'click') AS n")
def _mixed(spark, sf_dir):
    e = _updated(events_dynamic(spark, sf_dir), "MATCH (e:Event) WHERE e.type = 'click' SET e.k = 'x'")
    return e.query("MATCH (e:Event) RETURN min(e.k) AS lo, max(e.k) AS hi").crossJoin(e.query("MATCH (e:Event) WHERE e.k = 'x' RETURN count(e) AS n"))


# builder

@query("fluent_writes", "SELECT n_nationkey AS k, CASE WHEN n_nationkey < 3 THEN 'x' END AS note, CASE WHEN n_nationkey < 3 THEN 3 ELSE 2 END::BIGINT AS kinds FROM nation WHERE n_nationkey <> 24")
def _fluent_writes(spark, sf_dir):
    e = Engine(table_graph(spark, sf_dir))
    nation, few = Q.kind(Q.NODE, "Nation"), Q.less(Q.prop(Q.NODE, "n_nationkey"), 3)
    e = Q.Query(e).where(nation, few).set(Q.NODE, note="x").apply()
    e = Q.Query(e).where(nation, few).add_kinds(Q.NODE, "Few").apply()
    e = Q.Query(e).where(nation, Q.equals(Q.prop(Q.NODE, "n_nationkey"), 24)).delete(Q.NODE).apply()
    return e.query("MATCH (n:Nation) RETURN n.n_nationkey AS k, n.note AS note, size(labels(n)) AS kinds")


@query("fluent_inference", "SELECT true AS raised")
def _inference(spark, sf_dir):
    e = Engine(table_graph(spark, sf_dir))
    return _raised(spark, QueryError, lambda: Q.Query(e).where(Q.exists(Q.prop(Q.NODE, "n_name")), Q.exists(Q.prop(Q.REL, "quantity"))).returns(Q.NODE).build())


@query("fluent_depth", f"{_R}{trails(2)} SELECT count(*) AS c FROM w WHERE root = 1 AND depth BETWEEN 1 AND 2")
def _depth(spark, sf_dir):
    e = Engine(table_graph(spark, sf_dir))
    return Q.Query(e).where(Q.equals(Q.prop(Q.START, "n_nationkey"), 1), Q.kind(Q.START, "Nation")).over("TOP_TRADE", depth=Q.Depth.range(1, 2)).returns(Q.as_(Q.count(Q.END), "c")).scope(s="origin").fetch()


@query("fluent_pages", f"SELECT {num('Customer', 'c_custkey')} AS id FROM customer WHERE c_acctbal > 5000 ORDER BY c_custkey DESC LIMIT 10 OFFSET 5")
def _pages(spark, sf_dir):
    n = Q.Nodes(Engine(table_graph(spark, sf_dir))).filter(Q.kind(Q.NODE, "Customer"), Q.greater(Q.prop(Q.NODE, "c_acctbal"), 5000))
    return n.order_by(Q.identity(Q.NODE), True).offset(5).limit(10).fetch_ids()


@query("fetch_by_ids", "SELECT p_name AS name FROM part WHERE p_partkey % 50 = 0")
def _fetch_ids(spark, sf_dir):
    g = table_graph(spark, sf_dir)
    ids = g.node_scan(["Part"], ["p_partkey"])[0].where("`p:p_partkey` % 50 = 0").select("id")
    return sets.hydrate(g, ids, ["p_name"]).select(F.col("p_name").alias("name"))


# larger graphs: all lineitems, orders, events and messages

@query("degrees_contains", "SELECT degree, count(*) AS n FROM (SELECT p_partkey, count(DISTINCT l_orderkey) AS degree FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1) GROUP BY 1")
def _degrees_contains(spark, sf_dir):
    g = table_graph(spark, sf_dir)
    return A.degrees(g.node_scan(["Part"])[0], g.edge_scan(["CONTAINS"])[0], "in").groupBy("degree").agg(F.count("*").alias("n"))


@query("dimensions_placed", "SELECT (SELECT count(*) FROM customer) AS nodes, (SELECT max(n) FROM (SELECT count(*) n FROM orders GROUP BY o_custkey)) AS max_degree")
def _dimensions_placed(spark, sf_dir):
    g = table_graph(spark, sf_dir)
    return A.dimensions(g.node_scan(["Customer"])[0], g.edge_scan(["PLACED"])[0])


_TURN = f"(SELECT conv_id * {TURNS} + turn AS id, conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations)"


@query("bfs_messages", f"SELECT a.id AS root, b.id AS next, (b.k - a.k)::INT AS depth FROM {_TURN} a JOIN {_TURN} b USING (conv_id) WHERE a.k = 0 AND b.k > 0")
def _bfs_messages(spark, sf_dir):
    nodes, edges = _message_edges(spark, sf_dir)
    firsts = nodes.join(edges.select(F.col("end_id").alias("id")), "id", "left_anti")
    return A.bfs_tree(edges, firsts.select(F.col("id").alias("root")))


@query("scc_messages", f"SELECT id, id AS component FROM {_TURN}")
def _scc_messages(spark, sf_dir):
    return A.strong_components(*_message_edges(spark, sf_dir), small=0)


@query("scc_rings", f"SELECT id, min(id) OVER (PARTITION BY conv_id) AS component FROM {_TURN}")
def _scc_rings(spark, sf_dir):
    """Each conversation closed to a ring by an edge from its last message to its first: one component each."""
    nodes, edges = _message_edges(spark, sf_dir)
    ends = nodes.select("id", F.floor(F.col("id") / TURNS).alias("c")).groupBy("c").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    back = ends.select(F.lit(0).cast("long").alias("id"), F.col("hi").alias("start_id"), F.col("lo").alias("end_id"))
    return A.strong_components(nodes, edges.union(back), small=0)


@query("can_reach_messages", f"SELECT a.id AS a, b.id AS b, a.conv_id = b.conv_id AND b.k >= a.k AS reachable FROM {_TURN} a JOIN {_TURN} b ON b.conv_id BETWEEN a.conv_id AND a.conv_id + 1 WHERE a.k = 1")
def _can_reach_messages(spark, sf_dir):
    nodes, edges = _message_edges(spark, sf_dir)
    placed = nodes.select("id", F.floor(F.col("id") / TURNS).alias("c"))
    second = edges.join(edges.select(F.col("end_id").alias("start_id")).hint("merge"), "start_id", "left_anti").select(F.col("end_id").alias("a")).withColumn("c", F.floor(F.col("a") / TURNS))
    near = second.withColumn("c", F.explode(F.array("c", F.col("c") + 1)))
    return A.Reachability(nodes, edges).can_reach(near.join(placed.select(F.col("id").alias("b"), "c").hint("merge"), "c").select("a", "b"))


@query("next_pairs", f"WITH {NX} SELECT count(*) AS n FROM nx a JOIN nx b ON a.e = b.s")
def _next_pairs(spark, sf_dir):
    return Engine(table_graph(spark, sf_dir)).query("MATCH (:Event)-[:NEXT]->(:Event)-[:NEXT]->(:Event) RETURN count(*) AS n")


@query("undirected_reach", f"WITH RECURSIVE {_UT}, ur AS (SELECT s root, e nxt FROM ut UNION SELECT root, ut.e FROM ur JOIN ut ON ur.nxt = ut.s) SELECT {num('Nation', 'root')} AS id, {num('Nation', 'nxt')} AS reached FROM (SELECT * FROM ur WHERE root < 2 UNION SELECT n_nationkey, n_nationkey FROM nation WHERE n_nationkey < 2)")
def _undirected_reach(spark, sf_dir):
    g = table_graph(spark, sf_dir)
    ids = spark.range(2).select(ident("Nation", "id").alias("id"))
    return A.Reachability(g.node_scan(["Nation"])[0], g.edge_scan(["TOP_TRADE"])[0]).of(ids, "both")


@query("component_reach", f"{_R}{REACHED} SELECT DISTINCT 0::BIGINT AS id, nxt::BIGINT AS reached FROM rc WHERE root = 0 UNION SELECT 0, 0")
def _component_reach(spark, sf_dir):
    nodes, edges = _trade(spark, sf_dir)
    return A.Reachability(nodes, edges).of(nodes.where("id = 0"))


@query("reach_cache", "SELECT 1::BIGINT AS walked, true AS same")
def _reach_cache(spark, sf_dir):
    nodes, edges = _trade(spark, sf_dir)
    far = A.Reachability(nodes, edges)
    a, b = (far.of(nodes.where("id < 4")) for _ in range(2))
    return spark.createDataFrame([(far.computed, not a.exceptAll(b).head(1) and not b.exceptAll(a).head(1))], "walked long, same boolean")


@query("maximal_traversal", f"SELECT conv_id * {TURNS} + min(turn) AS root, conv_id * {TURNS} + max(turn) AS next FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def _maximal(spark, sf_dir):
    nodes, edges = _message_edges(spark, sf_dir)
    firsts = nodes.join(edges.select(F.col("end_id").alias("id")), "id", "left_anti")
    return traversal.paths(edges, firsts.select(F.col("id").alias("root")), acyclic=False)[0].select("root", "next")


@query("traversal_row_limit", "SELECT true AS raised")
def _row_limit(spark, sf_dir):
    nodes, edges = _trade(spark, sf_dir)
    return _raised(spark, MemoryError, lambda: traversal.paths(edges, _roots(nodes, 0), most_rows=1))


@query("hll", "SELECT l_returnflag, true AS near FROM lineitem GROUP BY 1 UNION ALL SELECT 'all', true")
def _hll_error(spark, sf_dir):
    """Estimates of single and of merged sketches within five hundredths of the count: three times the error of sketches of 2^12 buckets."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    sketches = idsets.sketches(line, "l_returnflag", "l_partkey")
    exact = line.groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("n"))
    near = lambda est, n: (F.abs(est - n) <= 0.05 * n).alias("near")
    one = sketches.select("l_returnflag", F.hll_sketch_estimate("sketch").alias("est")).join(exact, "l_returnflag").select("l_returnflag", near(F.col("est"), F.col("n")))
    merged = idsets.merged_estimate(sketches).toDF("est").crossJoin(line.agg(F.countDistinct("l_partkey").alias("n")))
    return one.union(merged.select(F.lit("all"), near(F.col("est"), F.col("n"))))


# documents, dumps, scrubbing

def _places(spark, sf_dir):
    g = table_graph(spark, sf_dir)
    return type(g)(spark, [s for s in g.nodes if "Place" in s.static], [s for s in g.edges if s.static & {"IN_REGION", "TOP_TRADE"}])


_TRIPS = f"WITH {TT} SELECT 'IN_REGION' AS k, '\"' || n_name || '\"' AS a, '\"' || r_name || '\"' AS b FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'TOP_TRADE', '\"' || x.n_name || '\"', '\"' || y.n_name || '\"' FROM tt JOIN nation x ON s = x.n_nationkey JOIN nation y ON e = y.n_nationkey"
_ASK = "MATCH (a)-[r]->(b) RETURN type(r) AS k, a.n_name AS a, coalesce(b.r_name, b.n_name) AS b"


@query("document_round_trip", _TRIPS)
def _document(spark, sf_dir):
    """A graph with its edges exported to one file, read, checked and loaded."""
    path = documents.export_to(_places(spark, sf_dir), f"{Scratch(spark, 'document').root}/graph.json")
    return Engine(documents.load(spark, *documents.read_documents(spark, path)).graph).query(_ASK)


@query("orders_round_trip", "SELECT o_orderstatus AS s, count(*) AS n, count(DISTINCT o_custkey) AS c FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def _orders_document(spark, sf_dir):
    """All customers and orders and the edges between them, through a document."""
    g = table_graph(spark, sf_dir)
    g = type(g)(spark, [s for s in g.nodes if s.static & {"Customer", "Order"}], [s for s in g.edges if "PLACED" in s.static])
    path = documents.export_to(g, f"{Scratch(spark, 'document').root}/orders.json")
    loaded = Engine(documents.load(spark, *documents.read_documents(spark, path)).graph)
    return loaded.query("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN o.o_orderstatus AS s, count(o) AS n, count(DISTINCT c) AS c").withColumn("s", F.replace("s", F.lit('"'), F.lit("")))


@query("document_faults", "SELECT * FROM (VALUES ('1 edges without a kind'), ('1 edges with an unknown end_id')) t(fault)")
def _faults(spark, sf_dir):
    doc = {"graph": {"nodes": [{"id": "a", "kinds": []}, {"id": "b", "kinds": ["X"]}], "edges": [{"start_id": "a", "end_id": "z", "kind": "K"}, {"start_id": "a", "end_id": "b", "kind": ""}]}}
    path = Scratch(spark, "faulty").root
    spark.createDataFrame([(json.dumps(doc),)], "value string").coalesce(1).write.text(path)
    return spark.createDataFrame([(f,) for f in documents.check(*documents.read_documents(spark, path))], "fault string")


@query("dump_round_trip", _TRIPS)
def _dump(spark, sf_dir):
    """Dumped as compressed lines with checksums, checked and loaded."""
    path = Scratch(spark, "dump").root
    dump.dump(_places(spark, sf_dir), path)
    return Engine(dump.load_dump(spark, path).graph).query(_ASK)


@query("dump_checksums", "SELECT true AS raised")
def _dump_checksums(spark, sf_dir):
    """A file that was changed is found by its checksum."""
    path = Scratch(spark, "dump").root
    dump.dump(_places(spark, sf_dir), path, compression="none", partitions=1)
    lines = spark.read.text(f"{path}/nodes").select(F.replace("value", F.lit("CANADA"), F.lit("CANADB")).alias("value"))
    changed = Scratch(spark, "changed").write(lines)
    changed.coalesce(1).write.mode("overwrite").text(f"{path}/nodes")
    return _raised(spark, dump.DumpError, lambda: dump.load_dump(spark, path))


@query("metrics_all", "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS nodes, (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS edges")
def _metrics_all(spark, sf_dir):
    g = table_graph(spark, sf_dir)
    g = type(g)(spark, [s for s in g.nodes if s.static & {"Place", "Party"}], [s for s in g.edges if s.static & {"IN_REGION", "IN_NATION"}])
    m = metrics.graph_metrics(g)
    return spark.createDataFrame([(sum(m["node_kind_histogram"].values()), sum(m["edge_kind_histogram"].values()))], "nodes long, edges long")


@query("scrub", "SELECT count(DISTINCT event_type) AS types, true AS shaped, true AS kept FROM events")
def _scrub_shapes(spark, sf_dir):
    """Texts become pseudonyms, as many as there were texts; numbers stay."""
    g, s = events_dynamic(spark, sf_dir), scrubbing.scrub(events_dynamic(spark, sf_dir), scrubbing.Rules(salt="s"))
    of = lambda graph: graph.nodes[0].df.where(F.array_contains("kinds", "Event")).select("id", "props")
    both = of(s).join(of(g).select("id", F.col("props").alias("old")), "id")
    return both.agg(F.countDistinct(F.col("props")["type"]).alias("types"), F.bool_and(F.col("props")["type"].rlike('^"value-[0-9a-f]{16}"$')).alias("shaped"), F.bool_and(F.col("props")["value"].eqNullSafe(F.col("old")["value"])).alias("kept"))


@query("scrub_actions", "SELECT 'node' AS element, 'preserve' AS action, (SELECT count(*) FROM nation) * 2 AS count UNION ALL SELECT 'node', 'pseudonymize', (SELECT count(*) FROM nation)")
def _scrub_actions(spark, sf_dir):
    g = table_graph(spark, sf_dir)
    return scrubbing.action_counts(type(g)(spark, [s for s in g.nodes if "Nation" in s.static], []), scrubbing.Rules(salt="s"))


# diagnostics

@query("report_notes", "SELECT true AS noted")
def _report(spark, sf_dir):
    e = Engine(table_graph(spark, sf_dir))
    text = "MATCH (a:Nation)-[:TOP_TRADE*1..3]->(b:Nation {n_nationkey: 3}) RETURN count(*) AS n"
    return spark.createDataFrame([({"edges written once", "exact or short range"} <= {rule for rule, _ in e.report(text).steps} and "Physical Plan" in e.explain(text),)], "noted boolean")


def _formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every query text, formatted and parsed again, is the same tree, and as complex."""
    rows = [(name, (again := parse(format_query(tree := parse(text)))) == tree and complexity(again) == complexity(tree)) for name, text in sorted(TEXTS.items())]
    return spark.createDataFrame(rows, "name string, same boolean").groupBy("same").agg(F.count("*").alias("n"))


QUERIES["formatted_texts"] = _formatted
ORACLE_SQL["formatted_texts"] = f"SELECT true AS same, {len(TEXTS)}::BIGINT AS n"

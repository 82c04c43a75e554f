import random

import pytest
from pyspark.sql import functions as F

from knotwork import fluent as Q
from knotwork.engine import Engine
from knotwork.graph import PropertyGraph
from knotwork.operators import algorithms as A
from knotwork.operators import expand as X
from knotwork.operators import idsets, sets, traversal, writes
from knotwork.plans.parser import QueryError
from knotwork.scratch import Scratch
from tests.graphs import engine, plain, rows


def random_graph(spark, n=30, m=60, seed=1):
    rng = random.Random(seed)
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    nodes = spark.range(n)
    edges = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id long, start_id long, end_id long")
    follow = {i: {b for a, b in pairs if a == i} for i in range(n)}
    return nodes, edges, pairs, follow


def closure(follow):
    out = {}
    for r in follow:
        seen, front, depth, found = set(), {r}, 0, {}
        while front:
            depth += 1
            front = set().union(*[follow[x] for x in front]) - seen
            seen |= front
            found |= dict.fromkeys(front, depth)
        out[r] = found
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_reach_and_components(spark, seed):
    nodes, edges, pairs, follow = random_graph(spark, seed=seed)
    reach = closure(follow)
    roots = nodes.select(nodes["id"].alias("root"))
    assert rows(A.bfs_tree(edges, roots)) == sorted(((r, x, d) for r in reach for x, d in reach[r].items()), key=repr)
    want = {i: min([i, *[x for x in reach[i] if i in reach[x]]]) for i in follow}
    assert dict(rows(A.strong_components(nodes, edges))) == want
    if seed == 1:
        assert dict(rows(A.strong_components(nodes, edges, small=0))) == want
    comps = A.strong_components(nodes, edges)
    assert set(rows(A.condensation(comps, edges))) == {(want[a], want[b]) for a, b in pairs if want[a] != want[b]}
    far = A.Reachability(nodes, edges)
    ask = spark.createDataFrame([(0, 5), (5, 0), (7, 7), (0, 999), (999, 999)], "a long, b long")
    assert {(r["a"], r["b"]): r["reachable"] for r in far.can_reach(ask).collect()} == {(0, 5): 5 in reach[0], (5, 0): 0 in reach[5], (7, 7): True, (0, 999): False, (999, 999): False}
    one = spark.createDataFrame([(0,), (1,)], "id long")
    a, b = (set(reach[i]) - {i} for i in (0, 1))
    assert {r[0] for r in far.or_reach(one).collect()} == a | b and {r[0] for r in far.xor_reach(one).collect()} == a ^ b


@pytest.mark.parametrize("direction", ["out", "in", "both"])
def test_reach_between_components_and_its_cache(spark, direction):
    nodes, edges, pairs, follow = random_graph(spark, 24, 26, 5)
    turned = {i: {a for a, b in pairs if b == i} for i in follow}
    way = {"out": follow, "in": turned, "both": {i: follow[i] | turned[i] for i in follow}}[direction]
    reach = closure(way)
    far = A.Reachability(nodes, edges)
    ask = spark.createDataFrame([(a, b) for a in range(24) for b in range(24)] + [(0, 999), (999, 0)], "a long, b long")
    got = {(r["a"], r["b"]): r["reachable"] for r in far.can_reach(ask, direction).collect()}
    assert got == {(a, b): a < 24 and b < 24 and (a == b or b in reach[a]) for a, b in got}
    ids = spark.createDataFrame([(3,), (4,)], "id long")
    want = sorted((i, x) for i in (3, 4) for x in {i, *reach[i]})
    assert sorted(tuple(r) for r in far.of(ids, direction).collect()) == want and far.computed == 1
    assert sorted(tuple(r) for r in far.of(ids.where("id = 3"), direction).collect()) == [w for w in want if w[0] == 3] and far.computed == 1  # read again, not walked again
    far.of(spark.createDataFrame([(3,), (9,)], "id long"), direction).collect()
    assert far.computed <= 2


def all_shortest(pairs, root, end, high):
    """All shortest paths as lists of edge numbers, by going through all paths by length."""
    front = [([], root, {root})]
    for _ in range(high):
        front = [([*es, i], b, seen | {b}) for es, at, seen in front for i, (a, b) in enumerate(pairs) if a == at and b not in seen]
        if done := sorted(es for es, at, _ in front if at == end):
            return done
    return []


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shortest_paths_from_both_sides(spark, seed):
    nodes, edges, pairs, _ = random_graph(spark, 14, 26, seed)
    roots, ends = spark.createDataFrame([(i,) for i in (0, 1, 5)], "root long"), spark.createDataFrame([(i,) for i in (1, 7, 9, 13)], "next long")
    some = spark.createDataFrame([(0, 7), (1, 9), (5, 5), (0, 99)], "root long, next long")
    for high in (2, 15):
        for kept, of in (((None, None), [(r, t) for r in (0, 1, 5) for t in range(14)]), ((ends, None), [(r, t) for r in (0, 1, 5) for t in (1, 7, 9, 13)]), ((None, some), [(0, 7), (1, 9)])):
            want = {(r, t): all_shortest(pairs, r, t, high) for r, t in of if r != t}
            every = X.shortest(edges, roots, "out", high, True, *kept).collect()
            assert sorted((r["root"], r["next"], r["edge_ids"]) for r in every) == sorted((r, t, es) for (r, t), found in want.items() for es in found)
            assert all([pairs[e][1] for e in r["edge_ids"]] == r["node_ids"] for r in every)
            one = X.shortest(edges, roots, "out", high, False, *kept).collect()
            assert sorted((r["root"], r["next"], r["edge_ids"]) for r in one) == sorted((r, t, found[0]) for (r, t), found in want.items() if found)


def test_walking_stops_when_all_pairs_have_met(spark):
    names = [f"n{i}" for i in range(40)]
    edges = spark.createDataFrame([(i, i, i + 1) for i in range(39)], "id long, start_id long, end_id long")
    roots, ends = spark.createDataFrame([(0,)], "root long"), spark.createDataFrame([(3,)], "next long")
    levels, write = [], Scratch.write
    with pytest.MonkeyPatch.context() as m:
        m.setattr(Scratch, "write", lambda self, df: levels.append(1) or write(self, df))
        assert [r["edge_ids"] for r in X.shortest(edges, roots, "out", 39, True, ends).collect()] == [[0, 1, 2]]
    assert len(levels) < 15 and len(names) == 40


def test_derived_edges_are_written_once(spark):
    nodes = spark.range(6)
    derived = spark.createDataFrame([(i, i, (i + 1) % 6) for i in range(6)] * 2, "id long, start_id long, end_id long").groupBy("start_id", "end_id").agg({"id": "min"}).withColumnRenamed("min(id)", "id")
    g = PropertyGraph.empty(spark).with_nodes(nodes, ["N"]).with_edges(derived, "E")
    e = Engine(g)
    one = e.explain("MATCH (a)-[:E]->(b) RETURN count(*) AS n")
    assert "edges written once" not in one and "HashAggregate" in one
    text = "MATCH (a)-[:E*1..3]->(b) RETURN a.id AS a, count(*) AS n"
    assert "edges written once: E" in e.explain(text) and not g.edges[0].derived()
    assert rows(e.query("MATCH (a)-[:E]->()-[:E]->(c) RETURN count(*) AS n")) == [(6,)]


def test_degrees(spark):
    nodes, edges, pairs, follow = random_graph(spark)
    assert dict(rows(A.degrees(nodes, edges))) == {i: len(v) for i, v in follow.items()}
    assert rows(A.dimensions(nodes, edges)) == [(30, max(map(len, follow.values())))]
    assert [r["dense"] for r in A.dense_ids(nodes.selectExpr("id * 7 as id")).orderBy("id").collect()] == list(range(30))


def test_walks_and_weights(spark):
    edges = spark.createDataFrame([(1, 0, 1, 0.5), (2, 0, 2, 0.5), (3, 1, 3, 0.4), (4, 2, 3, 0.2), (5, 3, 3, 1.0), (6, 1, 4, 1.0)], "id long, start_id long, end_id long, w double")
    root = spark.createDataFrame([(0,)], "root long")
    ended, cut = A.walks(edges, root, "out", 3)
    assert sorted((r["next"], len(r["edge_ids"])) for r in ended.collect()) == [(4, 2)] and cut.count() == 2
    got = A.weighted_terminals(edges.where("id <> 5"), root, "w", "out", 9).collect()
    assert {r["next"]: round(r["weight"], 6) for r in got} == {3: 0.3, 4: 0.5}


def test_traversals(spark):
    nodes, edges = plain("abcd", ("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"))
    e = engine(spark, nodes, edges).graph.all_edges()
    root = spark.createDataFrame([(1,)], "root long")
    maximal, every = traversal.paths(e, root)
    assert sorted(r["node_ids"] for r in maximal.collect()) == [[1, 2, 3], [1, 2, 4]] and every.count() == 3
    loose, _ = traversal.paths(e, root, acyclic=False)
    assert sorted(r["node_ids"] for r in loose.collect()) == [[1, 2, 3, 1], [1, 2, 4]]
    assert sorted(r["id"] for r in traversal.acyclic_nodes(e, root).collect()) == [1, 2, 3, 4]
    assert sorted(r["id"] for r in traversal.acyclic_terminals(e, root).collect()) == [3, 4]
    assert sorted(r["next"] for r in traversal.intermediary_paths(e, root, spark.createDataFrame([(2,), (1,)], "id long")).collect()) == [1, 2]
    with pytest.raises(MemoryError):
        traversal.paths(e, root, most_rows=1)
    g = engine(spark, nodes, edges).graph
    steps = traversal.Continuation().outbound(1, 2, ["E"]).outbound(0, 1, ["E"])
    assert sorted(r["node_ids"] for r in steps.run(g, root).collect()) == [[1, 2, 3], [1, 2, 4]]


def test_traversals_have_no_depth_of_their_own(spark):
    names = [f"n{i}" for i in range(24)]
    nodes, edges = plain(names, *zip(names, names[1:], strict=False))
    g = engine(spark, nodes, edges).graph
    e, root = g.all_edges(), spark.createDataFrame([(1,)], "root long")
    maximal, every = traversal.paths(e, root)
    assert [r["node_ids"] for r in maximal.collect()] == [list(range(1, 25))] and every.count() == 23
    cut, some = traversal.paths(e, root, max_depth=5)
    assert cut.count() == 0 and some.count() == 5  # a path that could go on is not maximal
    assert traversal.intermediary_paths(e, root, spark.createDataFrame([(24,)], "id long")).count() == 1
    assert [r["next"] for r in traversal.Continuation().outbound(1, 0, ["E"]).run(g, root).collect()] == [24]
    halves = e.selectExpr("*", "0.5D as w")
    assert [(r["next"], r["weight"]) for r in A.weighted_terminals(halves, root, "w", "out").collect()] == [(24, 0.5**23)]
    ring = spark.createDataFrame([(1, 0, 1, 1.0), (2, 1, 0, 1.0)], "id long, start_id long, end_id long, w double")
    with pytest.raises(ValueError):
        A.weighted_terminals(ring, spark.createDataFrame([(0,)], "root long"), "w", "out")


def test_id_sets(spark):
    a, b = idsets.IdSet.values(spark, [1, 2, 3]), idsets.IdSet.values(spark, [3, 4])
    ids = lambda s: sorted(r[0] for r in s.df.collect())
    assert (ids(a | b), ids(a & b), ids(a - b), ids(a ^ b)) == ([1, 2, 3, 4], [3], [1, 2], [1, 2, 4])
    assert a.contains(2) and not a.contains(9) and ids(a.add(9).remove(1)) == [2, 3, 9] and a.cardinality() == 3 and a.estimate() == 3
    assert [r[0] for r in a.slice(1, 1).collect()] == [2]
    both = spark.range(6)
    assert [r[0] for r in idsets.in_any(both, [a, b]).orderBy("id").collect()] == [1, 2, 3, 4] and [r[0] for r in idsets.in_all(both, [a, b]).collect()] == [3]


@pytest.fixture
def small(spark):
    return engine(spark, {"a": (["A"], {"v": 1}), "b": (["B"], {"v": 2}), "c": (["A", "B"], {})}, [("a", "R", "b", {"w": 1}), ("b", "R", "c", None)])


def test_updates(small):
    e = small.update("MATCH (n:A) SET n.v = 9, n:New REMOVE n:A")
    assert rows(e.query("MATCH (n:New) RETURN n.name AS n, n.v AS v, size(labels(n)) AS k")) == [('"a"', "9", 1), ('"c"', "9", 2)]
    assert rows(small.query("MATCH (n:A) RETURN count(n) AS n")) == [(2,)]  # the old graph is as it was
    e = small.update("MATCH (n {name: 'a'}) REMOVE n.v")
    assert rows(e.query("MATCH (n) WHERE n.v IS NOT NULL RETURN n.name AS n")) == [('"b"',)]
    e = small.update("MATCH (n {name: 'b'}) DETACH DELETE n")
    assert rows(e.query("MATCH (n) RETURN count(n) AS n")) == [(2,)] and rows(e.query("MATCH ()-[r]->() RETURN count(r) AS n")) == [(0,)]
    e = small.update("MATCH (a {name: 'a'}), (c {name: 'c'}) CREATE (a)-[:S {w: 5}]->(c)-[:S]->(d:D {name: 'd'})")
    assert rows(e.query("MATCH (x)-[r:S]->(y) RETURN x.name AS x, r.w AS w, y.name AS y")) == [('"a"', "5", '"c"'), ('"c"', None, '"d"')]
    e2 = e.update("MATCH (a {name: 'a'}), (c {name: 'c'}) CREATE (a)-[:S {w: 6}]->(c)")  # the same edge again: an upsert
    assert rows(e2.query("MATCH (x {name: 'a'})-[r:S]->(y) RETURN r.w AS w")) == [("6",)]
    out, _ = small.update_and_return("CREATE (n:Z {k: 3}) RETURN n.k AS k")
    assert rows(out) == [(3,)]


def test_upserts_and_kind_deletes(spark, small):
    rows_in = spark.createDataFrame([(1, "x"), (5, "y")], "v long, note string")
    g = writes.upsert_nodes(small.graph, rows_in, ["A"], ["v"])
    assert rows(Engine(g).query("MATCH (n:A) WHERE n.note IS NOT NULL RETURN n.v AS v, n.note AS t")) == [("1", '"x"'), ("5", '"y"')]
    assert rows(Engine(writes.delete_by_kinds(small.graph, ["A"], ["B"])).query("MATCH (n) RETURN count(n) AS n")) == [(2,)]
    assert rows(Engine(writes.delete_by_kinds(small.graph, ["Nope"])).query("MATCH (n) RETURN count(n) AS n")) == [(3,)]
    with pytest.raises(ValueError):
        writes.delete_by_kinds(small.graph, [], ["Nope"])


def test_upserts_do_not_depend_on_the_order_of_rows(spark, small):
    values = [(5, "y", 2), (5, "z", 1), (5, None, 3), (6, "a", None)]
    for order in (values, values[::-1]):
        for parts in (1, 4):
            df = spark.createDataFrame(order, "v long, note string, k long").repartition(parts)
            g = writes.upsert_nodes(small.graph, df, ["A"], ["v"])
            assert rows(Engine(g).query("MATCH (n:A) WHERE n.note IS NOT NULL RETURN n.v AS v, n.note AS t, n.k AS k")) == [("5", '"z"', "3"), ("6", '"a"', None)]


def test_ends_of_shortest_paths_differ_pair_by_pair(spark):
    nodes, edges = plain("abc", ("a", "b"), ("b", "a"), ("b", "c"))
    e = engine(spark, nodes, edges)
    lengths = lambda text, of=e: rows(of.query(f"MATCH p = {text} RETURN x.name AS x, y.name AS y, length(p) AS l"))
    for bad in ("shortestPath((x {name: 'a'})-[*]->(y {name: 'a'}))", "shortestPath((x:N)-[*]->(y:N))", "allShortestPaths((x:N)-[*]->(y {name: 'c'}))"):
        with pytest.raises(QueryError):
            lengths(bad)
    want = [('"a"', '"b"', 1), ('"a"', '"c"', 2), ('"b"', '"a"', 1), ('"b"', '"c"', 1)]
    assert lengths("shortestPath((x:N)-[*]->(y:N)) WHERE x.name <> y.name") == want and lengths("shortestPath((x:N)-[*]->(y:N)) WHERE x <> y") == want
    assert lengths("shortestPath((x:N)-[*]->(y:N))", engine(spark, nodes, edges, self_endpoint="skip")) == want
    with pytest.raises(QueryError):
        rows(e.query("MATCH (x:N), (y:N) WHERE x.name <> 'c' MATCH p = shortestPath((x)-[*]->(y)) RETURN length(p) AS l"))
    assert rows(e.query("MATCH (x:N), (y:N) WHERE x <> y MATCH p = shortestPath((x)-[*]->(y)) RETURN x.name AS x, y.name AS y, length(p) AS l")) == want


def test_edges_whose_ids_collide_are_told_apart_by_their_ends(spark):
    """Ids may be hashes: here all are one and the same."""
    nodes = spark.range(1, 6).selectExpr("id", "concat('n', id) name")
    edges = spark.createDataFrame([(7, 1, 2, "a"), (7, 2, 3, "b"), (7, 3, 4, "c"), (7, 4, 1, "d"), (7, 1, 5, "e")], "id long, start_id long, end_id long, w string")
    e = Engine(PropertyGraph.empty(spark).with_nodes(nodes, ["N"]).with_edges(edges, "E", ["w"]))
    assert rows(e.query("MATCH (a)-[:E]->(b)-[:E]->(c) RETURN count(*) AS n")) == [(5,)]
    assert rows(e.query("MATCH (a {name: 'n1'})-[:E*3..4]->(b) RETURN b.name AS b")) == [("n1",), ("n4",)]
    assert rows(e.query("MATCH p = (a {name: 'n2'})-[:E*2..2]->(b) RETURN [r IN relationships(p) | r.w] AS ws")) == [(["b", "c"],)]
    assert rows(e.query("MATCH p = shortestPath((a {name: 'n2'})-[:E*]->(b {name: 'n5'})) RETURN [r IN relationships(p) | r.w] AS ws")) == [(["b", "c", "d", "e"],)]
    assert rows(e.update("MATCH ({name: 'n1'})-[r:E]->({name: 'n5'}) DELETE r").query("MATCH ()-[r:E]->() RETURN r.w AS w")) == [("a",), ("b",), ("c",), ("d",)]
    changed = e.update("MATCH ({name: 'n1'})-[r:E]->({name: 'n5'}) SET r.w = 'z'")
    assert rows(changed.query("MATCH ()-[r:E]->() RETURN r.w AS w")) == [("a",), ("b",), ("c",), ("d",), ("z",)]
    assert rows(e.query("MATCH ()-[r:E]->() RETURN count(DISTINCT r) AS n")) == [(5,)] and e.query("MATCH ()-[r:E]->() RETURN DISTINCT r").count() == 5
    assert rows(e.query("MATCH ()-[r:E]->() WITH r, count(*) AS n RETURN r.w AS w, n")) == [(w, 1) for w in "abcde"]
    root = spark.createDataFrame([(2,)], "root long")
    assert [r["node_ids"] for r in traversal.paths(edges, root, acyclic=False)[0].orderBy("node_ids").collect()] == [[2, 3, 4, 1, 2], [2, 3, 4, 1, 5]]
    both = sets.relationships(e.graph, spark.createDataFrame([(1,)], "id long"), "both")
    assert sorted((r["start_id"], r["end_id"]) for r in both.collect()) == [(1, 2), (1, 5), (4, 1)]


def test_fluent(small):
    n = Q.Nodes(small)
    assert n.filter(Q.kind(Q.NODE, "A")).count() == 2 and n.filter(Q.kind(Q.NODE, "A", "B")).count() == 3 and n.filter(Q.kind(Q.NODE)).count() == 0
    assert n.filter(Q.equals_folded(Q.prop(Q.NODE, "name"), "C")).fetch_ids().first()["id"] == 3
    assert [r["id"] for r in n.order_by(Q.identity(Q.NODE), True).offset(1).limit(1).fetch_ids().collect()] == [2]
    assert n.filter(Q.is_null(Q.prop(Q.NODE, "v"))).first()["n"]["id"] == 3
    r = Q.Relationships(small)
    assert r.count() == 2 and r.filter(Q.equals(Q.prop(Q.REL, "w"), 1)).fetch_triples().first().asDict() == {"start_id": 1, "id": 100, "end_id": 2}
    assert sorted(x["n"]["id"] for x in r.fetch_direction("in").collect()) == [2, 3]
    assert r.filter(Q.equals(Q.identity(Q.START), 1), Q.equals(Q.identity(Q.END), 3)).fetch_all_shortest_paths().count() == 1
    assert Q.Nodes(n.filter(Q.in_ids(Q.NODE, [1])).update(v=7)).filter(Q.equals(Q.prop(Q.NODE, "v"), 7)).count() == 1
    assert Q.Nodes(n.filter(Q.has_relationships()).delete()).count() == 0
    text = Q.Query(small).where(Q.equals(Q.identity(Q.START), 1)).over("R", depth=Q.Depth.range(1, 2)).returns(Q.as_(Q.count(Q.END), "c")).scope(s="from_here")
    assert text.fetch().first()["c"] == 2
    with pytest.raises(QueryError):
        Q.Query(small).where(Q.exists(Q.prop(Q.NODE, "v")), Q.exists(Q.prop(Q.REL, "w"))).returns(Q.NODE).build()
    with pytest.raises(QueryError):
        Q.Depth(3, 1)


def test_empty_graph(spark):
    e = Engine(PropertyGraph.empty(spark))
    assert rows(e.query("MATCH (n)-[r:X*1..3]->(m) RETURN n, m")) == [] and rows(e.query("MATCH (n) RETURN count(n) AS n")) == [(0,)]
    assert rows(e.update("CREATE (a:K {x: 1})-[:R]->(b)").query("MATCH (a)-[:R]->(b) RETURN a.x AS x")) == [(1,)]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_long_rows_are_folded(spark, seed, monkeypatch):
    """Rings, rows between and off components, and loops off one node: the same components and reach, in rounds that do not follow the rows' length."""
    rng = random.Random(seed)
    pairs = [(i, i + 1) for i in range(100, 170)] + [(i, i + 1) for i in range(200, 240)] + [(240, 200)] + [(rng.randrange(8), rng.randrange(8)) for _ in range(9)]
    at = 300
    for _ in range(6):
        a, b, n = rng.randrange(8), rng.randrange(8), rng.randrange(1, 6)
        row = [a, *range(at, at + n), b]
        pairs += list(zip(row, row[1:]))
        at += n
    pairs += [(3, 100), (400, 401), (401, 400)]
    ids = sorted({x for p in pairs for x in p} | {999})
    follow = {i: {b for a, b in pairs if a == i} for i in ids}
    nodes = spark.createDataFrame([(i,) for i in ids], "id long")
    edges = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id long, start_id long, end_id long")
    far = closure(follow)
    written, write = [], Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df: (written.append(1), write(self, df))[1])
    assert dict(rows(A.strong_components(nodes, edges, small=0))) == {i: min([i, *[x for x in far[i] if i in far[x]]]) for i in ids}
    reach = A.Reachability(nodes, edges)
    ask = [(rng.choice(ids), rng.choice(ids)) for _ in range(150)] + [(3, 170), (101, 169), (169, 101), (150, 150)]
    back = {i: {a for a, b in pairs if b == i} for i in ids}
    for direction, way in (("out", far), ("in", closure(back)), ("both", closure({i: follow[i] | back[i] for i in ids}))):
        got = {(r["a"], r["b"]): r["reachable"] for r in reach.can_reach(spark.createDataFrame(ask, "a long, b long"), direction).collect()}
        assert got == {(a, b): a == b or b in way[a] for a, b in ask}
    assert len(written) < 140


def test_wipe_filters_sources_where_they_are(spark):
    """No join for the nodes, and nothing written; edges are those among the nodes that stay."""
    from knotwork.sources.mapping import table_graph

    g = sets.wipe(table_graph(spark, "/root/testdata/sf0.001"), F.array_contains("kinds", "Place"))
    plan = g.node_scan()[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "orders.parquet" not in plan and "Aggregate" not in plan
    e = engine(spark, {"a": (["X"], {}), "b": (["X"], {}), "c": (["Y"], {}), "d": ([], {})}, [("a", "R", "b", None), ("b", "R", "c", None), ("c", "R", "a", None), ("d", "R", "d", None)])
    left = sets.wipe(e.graph, F.when(F.array_contains("kinds", "X"), True))
    assert left.node_scan()[0].count() == 2 and left.edge_scan()[0].count() == 1

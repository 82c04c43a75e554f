import pytest

from knotwork.plans.parser import QueryError
from tests.graphs import engine, plain, rows


@pytest.fixture(scope="module")
def ring(spark):
    """y0 -> y1 -> y2 -> y0, and y1 -> out."""
    return engine(spark, *plain(["y0", "y1", "y2", "out"], ("y0", "y1"), ("y1", "y2"), ("y2", "y0"), ("y1", "out")))


@pytest.fixture(scope="module")
def diamond(spark):
    return engine(spark, *plain(["a", "b1", "b2", "b3", "z", "lone"], ("a", "b1"), ("a", "b2"), ("a", "b3"), ("b1", "z"), ("b2", "z"), ("b3", "z")))


@pytest.fixture(scope="module")
def mixed(spark):
    nodes = {
        "s": (["A", "B"], {"v": "1", "tags": ["x", "y"], "on": True}),
        "n": (["A"], {"v": 1, "tags": [], "on": False}),
        "f": (["A"], {"v": 1.0, "tags": None}),
        "l": (["B"], {"v": [1, 2], "w": "50%_"}),
        "z": (["B"], {"v": None}),
        "m": ([], {}),
    }
    return engine(spark, nodes, [("s", "R", "n", {"w": 1}), ("s", "R", "s", None), ("n", "Q", "l", None)])


def names(e, text, **params):
    return rows(e.query(text, **params))


def test_ring_trails(ring):
    assert rows(ring.query("MATCH (a {name: 'y0'})-[*1..4]->(b) RETURN b.name AS b")) == [('"out"',), ('"y0"',), ('"y1"',), ('"y2"',)]
    assert rows(ring.query("MATCH (n)-[*..]->(n) RETURN n.name AS n")) == [('"y0"',), ('"y1"',), ('"y2"',)]


def test_fan_and_chain_counts(spark):
    fan = engine(spark, *plain([f"n{i}" for i in range(16)], *[("n0", f"n{i}") for i in (1, 2, 3)], *[(f"n{1 + (i - 4) // 2}", f"n{i}") for i in range(4, 10)], *[(f"n{i - 6}", f"n{i}") for i in range(10, 16)]))
    assert rows(fan.query("MATCH (a {name: 'n0'})-[:E*1..3]->(b) RETURN count(*) AS n")) == [(15,)]
    chain = engine(spark, *plain([f"c{i}" for i in range(20)], *[(f"c{i}", f"c{i + 1}") for i in range(19)]))
    assert rows(chain.query("MATCH (a {name: 'c0'})-[:E*1..10]->(b) RETURN count(*) AS n")) == [(10,)]
    assert rows(chain.query("MATCH (a {name: 'c0'})-[:E*]->(b) RETURN count(*) AS n")) == [(15,)]  # the depth cap
    assert rows(chain.query("MATCH p = (a {name: 'c0'})-[:E*2..2]->(b) RETURN length(p) AS n")) == [(2,)]


def test_edges_are_unique_within_a_part(spark):
    e = engine(spark, *plain("ab", ("a", "b")))
    assert rows(e.query("MATCH (x {name: 'a'})-[:E*1..2]->(y)-[:E]-(z) RETURN z")) == []
    assert rows(e.query("MATCH (x)-[r]-(y)-[q]-(z) RETURN z")) == []
    assert len(rows(e.query("MATCH (x)-[r]->(y), (y)<-[q]-(z) RETURN z.name AS z"))) == 1


def test_self_edge(spark):
    e = engine(spark, *plain("ab", ("a", "a"), ("a", "b")))
    assert rows(e.query("MATCH (x {name: 'a'})-[:E*1..3]->(y) RETURN y.name AS y")) == [('"a"',), ('"b"',)]
    assert rows(e.query("MATCH (x)-[:E]-(y) RETURN x.name AS x, y.name AS y")) == [('"a"', '"b"'), ('"b"', '"a"')]


def test_shortest_paths(diamond):
    assert len(rows(diamond.query("MATCH p = allShortestPaths((x {name: 'a'})-[:E*]->(y {name: 'z'})) RETURN p"))) == 3
    one = diamond.query("MATCH p = shortestPath((x {name: 'a'})-[:E*]->(y {name: 'z'})) RETURN [n IN nodes(p) | n.name] AS ns, length(p) AS l").collect()
    assert [(r["ns"], r["l"]) for r in one] == [(['"a"', '"b1"', '"z"'], 2)]  # ties: the smallest edge ids
    assert rows(diamond.query("MATCH p = shortestPath((x {name: 'a'})-[:E*]->(y {name: 'lone'})) RETURN p")) == []
    with pytest.raises(QueryError):
        diamond.query("MATCH p = shortestPath((x {name: 'a'})-[:E*]->(y {name: 'a'})) RETURN p")


def test_strings_and_numbers_never_match(mixed):
    assert names(mixed, "MATCH (n) WHERE n.v = '1' RETURN n.name AS n") == [('"s"',)]
    assert names(mixed, "MATCH (n) WHERE n.v = 1 RETURN n.name AS n") == [('"f"',), ('"n"',)]
    assert names(mixed, "MATCH (n) WHERE n.v <> '1' RETURN n.name AS n") == [('"f"',), ('"l"',), ('"n"',)]
    assert names(mixed, "MATCH (n) WHERE n.v = $v RETURN n.name AS n", v=1) == [('"f"',), ('"n"',)]


def test_nulls_and_lists(mixed):
    assert names(mixed, "MATCH (n) WHERE n.v IS NULL RETURN n.name AS n") == [('"m"',), ('"z"',)]
    assert names(mixed, "MATCH (n) WHERE n.tags = [] RETURN n.name AS n") == [('"n"',)]
    assert names(mixed, "MATCH (n) WHERE NOT n.tags <> [] RETURN n.name AS n") == [('"n"',)]
    assert names(mixed, "MATCH (n) WHERE 'x' IN n.tags RETURN n.name AS n") == [('"s"',)]
    assert names(mixed, "MATCH (n) WHERE n.on RETURN n.name AS n") == [('"s"',)]
    assert names(mixed, "MATCH (n:A) RETURN n.name AS n, size(coalesce(n.tags, [])) AS k") == [('"f"', 0), ('"n"', 0), ('"s"', 2)]
    assert names(mixed, "MATCH (n:A) UNWIND coalesce(n.tags, []) AS t RETURN n.name AS n, t") == [('"s"', "x"), ('"s"', "y")]


def test_min_max_and_order_of_mixed_values(mixed):
    assert names(mixed, "MATCH (n) RETURN min(n.v) AS lo, max(n.v) AS hi") == [("[1,2]", "1")]
    got = [r["x"] for r in mixed.query("MATCH (n) WHERE n.v IS NOT NULL RETURN n.name AS x ORDER BY n.v, x").collect()]
    assert got == ['"s"', '"f"', '"n"', '"l"']


def test_string_search(mixed):
    assert names(mixed, "MATCH (n) WHERE n.w CONTAINS '%' AND n.w STARTS WITH '50' AND n.w ENDS WITH '_' RETURN n.name AS n") == [('"l"',)]
    assert len(names(mixed, "MATCH (n) WHERE NOT n.w CONTAINS '%' RETURN n.name AS n")) == 5  # a missing text holds nothing
    assert names(mixed, "MATCH (n) WHERE n.w =~ '0.' RETURN n.name AS n") == [('"l"',)]


def test_kinds(mixed):
    assert names(mixed, "MATCH (n:A:B) RETURN n.name AS n") == [('"s"',)]
    assert len(names(mixed, "MATCH (n) WHERE n:A OR n:B RETURN n.name AS n")) == 5
    assert names(mixed, "MATCH ()-[r:R|Q]->(m) RETURN type(r) AS t, m.name AS m") == [("Q", '"l"'), ("R", '"n"'), ("R", '"s"')]


def test_quantifiers(mixed):
    q = "MATCH (n {name: 's'}) WHERE %s RETURN n.name AS n"
    for text, hit in (("all(x IN [] WHERE x = 1)", 1), ("none(x IN n.missing WHERE x = 'a')", 0), ("any(x IN n.missing WHERE x = 'a')", 0), ("single(x IN n.tags WHERE x = 'x')", 1), ("single(x IN ['a', 'a'] WHERE x = 'a')", 0), ("none(x IN n.tags WHERE x = 'q')", 1), ("all(x IN n.tags WHERE x = 'x')", 0), ("any(x IN labels(n) WHERE x = 'B')", 1)):
        assert len(names(mixed, q % text)) == hit, text


def test_optional_chain_keeps_rows(mixed):
    got = names(mixed, "MATCH (n:B) OPTIONAL MATCH (n)-[:Q]->(x) OPTIONAL MATCH (x)-[:R]->(y) RETURN n.name AS n, x.name AS x, y.name AS y")
    assert got == [('"l"', None, None), ('"s"', None, None), ('"z"', None, None)]
    assert names(mixed, "MATCH (n) OPTIONAL MATCH (n)-[r:R]->(x) WITH n, count(r) AS k WHERE k = 0 RETURN count(n) AS n") == [(5,)]


def test_paths_from_left_to_right(diamond):
    got = rows(diamond.query("MATCH p = (x {name: 'z'})<-[:E]-(y)<-[:E]-(w) RETURN [n IN nodes(p) | n.name] AS ns"))
    assert all(r[0][0] == '"z"' and r[0][2] == '"a"' for r in got) and len(got) == 3
    assert rows(diamond.query("MATCH p = (x {name: 'lone'}) RETURN size(nodes(p)) AS n, size(relationships(p)) AS m")) == [(1, 0)]


def test_expressions(mixed):
    one = lambda e, **p: mixed.query(f"UNWIND [1] AS i RETURN {e} AS x", **p).first()["x"]
    assert one("2 / 3") == 0 and one("7 / 2") == 3 and one("7.0 / 2") == 3.5 and one("-7 % 3") == -1 and one("2 ^ 3") == 8
    assert one("head(tail([1, 2, 3]))") == 2 and one("tail([1])") == [] and one("last([1, 2])") == 2 and one("head([])") is None
    assert one("split('a.b.c', '.')") == ["a", "b", "c"] and one("toUpper('a') + toLower('B')") == "Ab"
    assert one("1 < 2 < 3 AND NOT 1 < 3 < 2") is True and one("true XOR true") is False and one("null = 1") is None
    assert one("1 IN [1, 2]") is True and one("1 IN []") is False and one("[1, 2] + 3") == [1, 2, 3]
    assert one("CASE WHEN 1 > 2 THEN 'a' ELSE 'b' END") == "b" and one("[x IN [1, 2, 3] WHERE x > 1 | x * x]") == [4, 9]
    assert one("$a", a="q") == "q" and one("'it\\'s\\n'") == "it's\n"
    assert str(one("date('2020-01-31') + duration('P1M')"))[:10] == "2020-02-29"


def test_with_limit_before_where(spark):
    e = engine(spark, {f"n{i}": (["N"], {"v": i}) for i in range(6)}, [])
    assert rows(e.query("MATCH (n:N) WITH toInteger(n.v) AS v ORDER BY v LIMIT 3 WHERE v > 0 RETURN v")) == [(1,), (2,)]


@pytest.mark.parametrize("text", ["MATCH (n)", "MATCH (n) RETURN", "RETURN 'a\\q'", "MERGE (n) RETURN n", "MATCH (n) SET n += {a: 1} RETURN n", "MATCH (n) RETURN n LIMIT $x", "MATCH (n RETURN n", "CALL x() RETURN 1"])
def test_texts_that_do_not_parse(mixed, text):
    with pytest.raises(QueryError):
        mixed.query(text)


@pytest.mark.parametrize("text", ["MATCH (n) RETURN q", "MATCH (n) RETURN nothing(n)", "MATCH (n)-[r*]->(m) RETURN r.x", "MATCH (n) WITH n MATCH (m) UNWIND [1] AS n RETURN n", "MATCH (n) RETURN n.a AS x, n.b AS x", "MATCH (n) RETURN size('abc') AS x", "MATCH (n) RETURN [1, 'a'] AS x", "MATCH (n) RETURN $missing AS x", "MATCH p=(n) MATCH q=(n) WHERE p = q RETURN n"])
def test_queries_that_do_not_plan(mixed, text):
    with pytest.raises(QueryError):
        mixed.query(text)


METAMORPHIC = [
    ("MATCH (a)-[:E*1..1]->(b) RETURN a.name AS a, b.name AS b", "MATCH (a)-[:E]->(b) RETURN a.name AS a, b.name AS b"),
    ("MATCH (a)-[:E]->(b) RETURN a.name AS a, b.name AS b", "MATCH (b)<-[:E]-(a) RETURN a.name AS a, b.name AS b"),
    ("MATCH (a)-[:E]->(b)-[:E]->(c) RETURN a.name AS a, c.name AS c", "MATCH (a)-[:E*2..2]->(c) RETURN a.name AS a, c.name AS c"),
    ("MATCH (a) WHERE (a)-[:E]->() RETURN a.name AS a", "MATCH (a)-[:E]->(b) RETURN DISTINCT a.name AS a"),
    ("MATCH (a) WHERE NOT (a)-[:E]->() RETURN a.name AS a", "MATCH (a) OPTIONAL MATCH (a)-[r:E]->() WITH a, count(r) AS k WHERE k = 0 RETURN a.name AS a"),
    ("MATCH (a)-[:E*1..3]->(b) RETURN DISTINCT a.name AS a, b.name AS b", "MATCH (a)-[:E*1..3]->(b) RETURN a.name AS a, b.name AS b, count(*) AS n"),
    ("MATCH (a)-[:E*]->(b) RETURN DISTINCT a.name AS a, b.name AS b", "MATCH p = (a)-[:E*]->(b) WITH a, b, length(p) AS l RETURN DISTINCT a.name AS a, b.name AS b"),
    ("MATCH (a)-[:E]->(b) MATCH (b)-[:E]->(c) WHERE a.name <> 'q' RETURN a.name AS a, c.name AS c", "MATCH (a)-[:E]->(b)-[:E]->(c) RETURN a.name AS a, c.name AS c"),
]


@pytest.mark.parametrize("one,two", METAMORPHIC)
def test_queries_that_must_agree(ring, diamond, one, two):
    for e in (ring, diamond):
        a, b = rows(e.query(one)), [r[:2] for r in rows(e.query(two))]
        assert a == sorted(b, key=repr)


def test_plans_and_reports(spark, ring):
    from knotwork.engine import Engine
    from knotwork.sources.mapping import table_graph

    e = Engine(table_graph(spark, "/root/testdata/sf0.001"))
    text = "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE c.c_mktsegment = 'BUILDING' RETURN count(o) AS n"
    plan = e.explain(text)
    assert "PushedFilters: [IsNotNull(c_mktsegment), EqualTo(c_mktsegment,BUILDING)" in plan and "o_totalprice" not in plan and "Python" not in plan
    assert ("node join left out", "o") in e.report(text).steps  # its edges say that it is an Order
    assert "kind check by semi-join" in dict(e.report("MATCH (n:Nation:Place)-[:IN_REGION]->(r:Region:Odd) RETURN count(n) AS n").steps)
    assert ("entered by its edges", "o") in e.report("MATCH (o:Order)-[r:CONTAINS]->(p:Part) RETURN sum(r.quantity) AS q").steps
    assert ("count fast path", "edges") in e.report("MATCH (a)-[r:PLACED]->(b) RETURN count(r) AS n").steps
    assert any(rule == "reach instead of paths" for rule, _ in ring.report("MATCH (a)-[:E*]->(b) RETURN DISTINCT b.name AS b").steps)
    assert any(rule == "traversal direction" for rule, _ in e.report("MATCH (a)-[:PLACED]->(o:Order {o_orderkey: 3}) RETURN a").steps)


def test_kinds_known_from_edges_follow_updates(spark):
    from knotwork.engine import Engine
    from knotwork.sources.mapping import table_graph

    e = Engine(table_graph(spark, "/root/testdata/sf0.001"))
    count = "MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN count(*) AS n"
    assert rows(e.query(count)) == [(25,)]
    changed = e.update("MATCH (r:Region {r_regionkey: 0}) REMOVE r:Region")
    assert rows(changed.query(count)) == [(20,)] and rows(e.query(count)) == [(25,)]
    assert rows(e.update("MATCH (n:Nation) WHERE n.n_nationkey < 5 DETACH DELETE n").query(count)) == [(20,)]
    assert rows(e.query("MATCH (a:Nation)-[:TOP_TRADE]->(b:Supplier) RETURN count(*) AS n")) == [(0,)]
    assert rows(e.query("MATCH (a:Region)-[:TOP_TRADE*0..1]->(b:Nation) RETURN count(*) AS n")) == [(0,)]
    assert rows(e.query("MATCH (a)<-[:PLACED]-(c:Customer)-[:IN_NATION]->(n) WHERE id(c) = id(c) RETURN count(*) AS n")) == rows(e.query("MATCH ()-[:PLACED]->() RETURN count(*) AS n"))


def test_lists_that_are_only_asked_for_members(spark):
    nodes, edges = plain("abcd", ("a", "b"), ("b", "c"), ("c", "d"), ("a", "d"))
    e = engine(spark, nodes, edges)
    one = "MATCH (x:N) WHERE x.name IN ['b', 'd'] WITH collect(x) AS xs MATCH (a)-[:E]->(y) WHERE y IN xs AND a.name <> 'c' RETURN a.name AS a, y.name AS y"
    assert "membership by a semi-join" in e.explain(one) and rows(e.query(one)) == [('"a"', '"b"'), ('"a"', '"d"')]
    other = one.replace("RETURN", "RETURN size(xs) AS n,")  # the list itself is asked for
    assert "membership by a semi-join" not in e.explain(other) and rows(e.query(other)) == [(2, '"a"', '"b"'), (2, '"a"', '"d"')]
    assert rows(e.query(one.replace("['b', 'd']", "['z']"))) == []
    not_in = one.replace("y IN xs", "NOT y IN xs")
    assert rows(e.query(not_in)) == [('"b"', '"c"')]

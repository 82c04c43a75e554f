import pytest

from knotwork.catalog import TEXTS
from knotwork.plans import syntax as S
from knotwork.plans.formatter import complexity, query
from knotwork.plans.parser import parse

MORE = [
    "MATCH (a:X:`odd name` {k: 1, s: 'it\\'s'})<-[r:A|B*2..5 {w: $w}]-(b) WHERE NOT (a)--(b) AND (a.x + 1) * 2 > 3 OR a:Y RETURN a, b.`p q` AS c ORDER BY c DESC SKIP 1 LIMIT 2",
    "MATCH p = allShortestPaths((a)-[*..4]->(b)) RETURN nodes(p)[0], [x IN relationships(p) WHERE x.w IS NOT NULL | x.w]",
    "UNWIND $xs AS x WITH DISTINCT x, count(*) AS n WHERE n > 1 RETURN CASE WHEN x = 1 THEN 'a' ELSE null END AS y UNION ALL RETURN 1 AS y",
    "MATCH (a) SET a.x = 1, a:K REMOVE a.y, a:L DETACH DELETE a",
    "CREATE (a:K {x: [1, 2.5, true]})-[:R]->(b)",
    "MATCH (a) WHERE any(x IN a.xs WHERE x STARTS WITH 'q') XOR NOT a.b =~ '.*' RETURN -a.x ^ 2",
]


@pytest.mark.parametrize("text", [*TEXTS.values(), *MORE])
def test_round_trip(text):
    tree = parse(text)
    again = query(tree)
    assert query(parse(again)) == again
    assert [type(c) for c in parse(again).clauses] == [type(c) for c in tree.clauses]


def test_trees():
    tree = parse("MATCH (a)-[*2]->(b)-[r:X*]-(c) RETURN a").clauses[0].parts[0]
    assert (tree.rels[0].low, tree.rels[0].high, tree.rels[0].direction) == (2, 2, "out")
    assert (tree.rels[1].low, tree.rels[1].high, tree.rels[1].direction) == (None, None, "both")
    assert parse("RETURN 1 + 2 * 3 = 7 AND true AS x").clauses[0].items[0].expr == S.Bin("and", S.Bin("=", S.Bin("+", S.Lit(1), S.Bin("*", S.Lit(2), S.Lit(3))), S.Lit(7)), S.Lit(True))


def test_complexity():
    easy, hard = complexity(parse("MATCH (a:X {k: 1})-[:R]->(b) RETURN b")), complexity(parse("MATCH (a)-[*]->(b), (c) RETURN b"))
    assert easy.fitness > hard.fitness and hard.unbounded == 1 and hard.cross == 1

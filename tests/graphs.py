"""Tiny graphs with values of our own."""

from knotwork.engine import Engine
from knotwork.graph import PropertyGraph
from knotwork.plans.compiler import Config
from knotwork.plans.expressions import canonical


def engine(spark, nodes, edges, **config):
    """nodes: {name: (kinds, props)}; edges: [(start, kind, end, props)]. Ids are 1, 2, ... in order."""
    ids = {n: i + 1 for i, n in enumerate(nodes)}
    n = [(ids[k], list(kinds), {"name": canonical(k), **{p: canonical(v) for p, v in props.items()}}) for k, (kinds, props) in nodes.items()]
    e = [(100 + i, ids[a], ids[b], kind, {p: canonical(v) for p, v in (props or {}).items()}) for i, (a, kind, b, props) in enumerate(edges)]
    ndf = spark.createDataFrame(n, "id long, kinds array<string>, props map<string,string>")
    edf = spark.createDataFrame(e, "id long, start_id long, end_id long, kind string, props map<string,string>")
    return Engine(PropertyGraph.dynamic(spark, ndf, edf), Config(**config))


def plain(names, *pairs):
    """Nodes of kind N and edges of kind E."""
    return {n: (["N"], {}) for n in names}, [(a, "E", b, None) for a, b in pairs]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)

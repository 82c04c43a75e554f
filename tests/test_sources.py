import json

import pytest

from knotwork.engine import Engine
from knotwork.scratch import Scratch
from knotwork.sources import documents, dump, metrics, scrub
from tests.graphs import engine, rows

DOC = {
    "graph": {
        "nodes": [
            {"id": "a", "kinds": ["X", "Y"], "properties": {"n": 1.0, "s": "1", "l": [1, "q"], "b": True, "z": None, "o": {"k": 2}}},
            {"id": "b", "kinds": []},
            {"id": "c", "kinds": ["Y"], "properties": {"s": "ü\"\\"}},
        ],
        "edges": [{"start_id": "a", "end_id": "b", "kind": "R", "properties": {"w": 1}}, {"start_id": "a", "end_id": "b", "kind": "R", "properties": {"v": 2, "w": 3}}, {"start_id": "b", "end_id": "c", "kind": "S"}],
    }
}


def written(tmp_path, doc):
    p = tmp_path / "doc.json"
    p.write_text(json.dumps(doc, indent=1))
    return str(p)


def test_load_and_export(spark, tmp_path):
    got = documents.load(spark, *documents.read_documents(spark, written(tmp_path, DOC)))
    e = Engine(got.graph)
    assert rows(e.query("MATCH (n:X) WHERE n.n = 1 AND n.s = '1' AND n.b RETURN n.l AS l, n.n AS n")) == [('[1,"q"]', "1")]
    assert rows(e.query("MATCH (x)-[r:R]->(y) RETURN r.w AS w, r.v AS v")) == [("3", "2")]  # repeated edges merge
    doc = json.loads(documents.export(got.graph))
    assert len(doc["graph"]["nodes"]) == 3 and len(doc["graph"]["edges"]) == 2
    assert [n["properties"] for n in doc["graph"]["nodes"] if "X" in n["kinds"]][0]["l"] == [1, "q"]
    assert rows(got.ids.select("id")) == [("a",), ("b",), ("c",)]


@pytest.mark.parametrize("change,text", [(lambda g: g["nodes"].append({"id": "a", "kinds": []}), "repeated"), (lambda g: g["nodes"].append({"id": "", "kinds": []}), "without an id"), (lambda g: g["edges"].append({"start_id": "a", "end_id": "q", "kind": ""}), "without a kind; 1 edges with an unknown end_id")])
def test_faults(spark, tmp_path, change, text):
    doc = json.loads(json.dumps(DOC))
    change(doc["graph"])
    with pytest.raises(documents.DocumentError, match=text):
        documents.load(spark, *documents.read_documents(spark, written(tmp_path, doc)))


def test_dump_and_load(spark, tmp_path):
    g = documents.load(spark, *documents.read_documents(spark, written(tmp_path, DOC))).graph
    path = Scratch(spark, "dump").root
    for codec in ("gzip", "none"):
        m = dump.dump(g, path, compression=codec, partitions=2)
        assert m["graphs"][0]["node_count"] == 3 and m["graphs"][0]["edge_count"] == 2
        again = dump.load_dump(spark, path).graph
        assert metrics.graph_metrics(again) == metrics.graph_metrics(g) == m["metrics"]
    assert dump.dump(g, path, compression="none", partitions=2, resume=True)["graphs"] == m["graphs"]
    with pytest.raises(dump.DumpError):
        dump.load_dump(spark, path, into=g)
    with pytest.raises(dump.DumpError):
        dump.load_dump(spark, path, kinds={"X"})
    spark.createDataFrame([('{"id":"9","kinds":[]}',)], "value string").write.mode("append").text(f"{path}/nodes")
    with pytest.raises(dump.DumpError):
        dump.load_dump(spark, path)


def test_metrics(spark):
    nodes = {"a": (["B", "A"], {}), "b": ([], {}), "c": (["é"], {})}
    e = engine(spark, nodes, [("a", "R", "b", None), ("a", "R", "b", None), ("a", "S", "c", None)])
    m = metrics.graph_metrics(e.graph)
    assert m["node_kind_histogram"] == {"1:A+1:B": 1, "0:": 1, "2:é": 1} and m["edge_kind_histogram"] == {"1:R": 2, "1:S": 1}
    assert m["out_degree_histogram"] == {"3": 1, "0": 2} and m["in_degree_histogram"] == {"0": 1, "2": 1, "1": 1} and m["total_degree_histogram"] == {"3": 1, "2": 1, "1": 1}
    assert m["endpoint_kind_histogram"] == {"7:1:A+1:B|3:1:R|2:0:": 2, "7:1:A+1:B|3:1:S|4:2:é": 1}
    other = metrics.graph_metrics(engine(spark, nodes, [("a", "R", "b", None)]).graph)
    assert m["fingerprint"] != other["fingerprint"] and metrics.compare(m, m) == [] and "edge_count: 3 and 1" in metrics.compare(m, other)
    from knotwork.operators.writes import delete_nodes

    with pytest.raises(metrics.MetricsError):
        g = e.graph
        metrics.graph_metrics(type(g)(spark, delete_nodes(g, spark.createDataFrame([(1,)], "id long")).nodes, g.edges))


def test_scrub(spark):
    import hashlib
    import hmac

    digest = lambda t: hmac.new(b"pepper", t.encode(), hashlib.sha256).hexdigest()
    props = {
        "objectid": "S-1-5-21-1-2-3-500", "kind": "keep me", "Last-Seen_At": 1000, "created": "2020-01-01T00:00:00Z", "updated": "not a time", "description": "free", "home dir path": "/x", "api_key": "k", "big": "q" * 600,
        "mailbox": "a@b.co", "u": "0f8fad5b-d9cb-469f-a165-70867728950e", "ip": "1.2.3.4", "host": "a.b.c", "flag": True, "count": 5, "title": "Boss", "xs": ["a", "b"], "blank": "  ", "nothing": None,
    }
    out = scrub.scrub(engine(spark, {"n": (["N"], props)}, []).graph, scrub.Rules(salt="pepper"))
    got = {k: json.loads(v) for k, v in out.nodes[0].df.first()["props"].items()}
    assert got["kind"] == "keep me" and got["flag"] is True and got["count"] == 5 and got["blank"] == "  " and got["nothing"] is None
    assert got["Last-Seen_At"] == 1000 + 17 * 86400 and got["created"] == "2020-01-18T00:00:00Z" and got["updated"] == "value-" + digest("not a time")[:16]
    assert got["description"] == got["api_key"] == got["big"] == "[REDACTED]" and got["home dir path"] == "value-" + digest("/x")[:16]
    assert got["mailbox"] == f"user-{digest('a@b.co')[:12]}@example.invalid" and got["host"] == f"host-{digest('a.b.c')[:12]}.example.invalid"
    d = digest("1.2.3.4")
    assert got["ip"] == f"10.{int(d[:2], 16)}.{int(d[2:4], 16)}.{int(d[4:6], 16)}"
    d = digest(props["u"])
    assert got["u"] == f"{d[:8]}-{d[8:12]}-{d[12:16]}-{d[16:20]}-{d[20:32]}"
    d = digest("S-1-5-21-1-2-3")
    assert got["objectid"] == "S-1-5-21-" + "-".join(f"{int(d[i : i + 8], 16) % 10**9:09d}" for i in (0, 8, 16)) + "-500"
    assert got["xs"] == ["value-" + digest(x)[:16] for x in ("a", "b")] and got["title"] == "value-" + digest("Boss")[:16]


def test_scrub_goes_into_objects(spark):
    import hashlib
    import hmac

    digest = lambda t: hmac.new(b"pepper", t.encode(), hashlib.sha256).hexdigest()
    props = {
        "owner": {"email": "a@b.co", "count": 3, "note": "free", "objectid": 7, "inner": {"title": "Boss", "deeper": {"x": "y", "deepest": {"z": "w"}}}},
        "people": [{"title": "Boss"}, {"n": 1}], "secret": {"a": "b"}, "kind": {"a": "b"}, "title": {"a": "b{c}"}, "xs": ["{a}", "b"],
    }
    graph = engine(spark, {"n": (["N"], props)}, []).graph
    got = {k: json.loads(v) for k, v in scrub.scrub(graph, scrub.Rules(salt="pepper", depth=2)).nodes[0].df.first()["props"].items()}
    assert got["owner"]["email"] == f"user-{digest('a@b.co')[:12]}@example.invalid" and got["owner"]["count"] == 3 and got["owner"]["note"] == "[REDACTED]" and got["owner"]["objectid"] == 7
    assert got["owner"]["inner"]["title"] == "value-" + digest("Boss")[:16] and got["owner"]["inner"]["deeper"] == "[REDACTED]"
    assert got["people"] == [{"title": "value-" + digest("Boss")[:16]}, {"n": 1}] and got["secret"] == "[REDACTED]" and got["kind"] == {"a": "b"}
    assert got["title"] == {"a": "value-" + digest("b{c}")[:16]} and got["xs"] == ["value-" + digest(x)[:16] for x in ("{a}", "b")]
    assert "b@" not in json.dumps(got)


def test_scrub_settings(spark):
    rules = scrub.Rules.of({"salt": "s", "preserve": ["title"], "organisation": ["count"], "marker": "-", "shift_days": 1})
    graph = engine(spark, {"n": (["N"], {"title": "Boss", "description": "x", "created": 0})}, []).graph
    got = {k: json.loads(v) for k, v in scrub.scrub(graph, rules).nodes[0].df.first()["props"].items()}
    assert got["title"] == "Boss" and got["description"] == "-" and got["created"] == 86400
    counts = {(r["element"], r["action"]): r["count"] for r in scrub.action_counts(graph, rules).collect()}
    assert counts == {("node", "preserve"): 1, ("node", "redact"): 1, ("node", "shift_timestamp"): 1, ("node", "pseudonymize"): 1}
    assert scrub.metadata(rules)["preserve"] == ("title",) and "salt" not in scrub.metadata(rules)
    with pytest.raises(ValueError):
        scrub.Rules.of({"salt": "s", "nope": 1})


def test_export_to_a_file(spark, tmp_path):
    g = documents.load(spark, *documents.read_documents(spark, written(tmp_path, DOC))).graph
    path = documents.export_to(g, str(tmp_path / "out.json"))
    want, got = json.loads(documents.export(g)), json.loads(open(path).read())
    assert got == want
    empty = documents.export_to(type(g)(spark, [], []), str(tmp_path / "none.json"))
    assert json.loads(open(empty).read()) == {"graph": {"nodes": [], "edges": []}}


def test_checksums_are_of_the_files(spark, tmp_path):
    import glob
    import hashlib

    g = documents.load(spark, *documents.read_documents(spark, written(tmp_path, DOC))).graph
    m = dump.dump(g, str(tmp_path / "d"), partitions=2)
    files = {(f["phase"], f["file"]): (f["sha256"], f["bytes"]) for f in m["graphs"][0]["files"]}
    there = {(phase, p.rsplit("/", 1)[1]): open(p, "rb").read() for phase in ("nodes", "edges") for p in glob.glob(str(tmp_path / "d" / phase / "part-*"))}
    assert files == {k: (hashlib.sha256(v).hexdigest(), len(v)) for k, v in there.items()}


def test_repeated_edges_merge_in_file_order(spark, tmp_path):
    """Later ones on top, whatever the partitions."""
    doc = {"graph": {"nodes": [{"id": x, "kinds": []} for x in "ab"], "edges": [{"start_id": "a", "end_id": "b", "kind": "R", "properties": {"w": w}} for w in (5, 9, 7)]}}
    nodes, edges = documents.read_documents(spark, written(tmp_path, doc))
    for parts in (1, 5):
        assert rows(Engine(documents.load(spark, nodes, edges.repartition(parts)).graph).query("MATCH ()-[r:R]->() RETURN r.w AS w")) == [("7",)]


def test_keys_beyond_their_range_are_an_error(spark):
    from pyspark.sql import functions as F

    from knotwork.sources.mapping import SHIFT, TURNS, ident, message_key

    df = spark.createDataFrame([(SHIFT - 1, 3), (None, 4)], "conv_id long, turn long")
    assert [r[0] for r in df.select(ident("Order", "conv_id")).collect()] == [7 * SHIFT - 1, None]
    for bad in (spark.createDataFrame([(SHIFT, 1)], "conv_id long, turn long").select(ident("Order", "conv_id")), spark.createDataFrame([(1, TURNS)], "conv_id long, turn long").select(F.max(message_key()))):
        with pytest.raises(Exception, match="not below"):
            bad.collect()


def test_edge_stream(spark, tmp_path):
    from knotwork.streaming.edges import degree_counts, kind_counts, unique_edges

    rows_in = [(1, 2, "R", "2024-01-01 00:00:00"), (1, 2, "R", "2024-01-01 00:01:00"), (2, 3, "S", "2024-01-01 02:00:00")]
    df = spark.createDataFrame(rows_in, "start_id long, end_id long, kind string, ts string").selectExpr("start_id", "end_id", "kind", "cast(ts as timestamp) ts")
    assert rows(degree_counts(unique_edges(df))) == [(1, 1, 0), (2, 1, 1), (3, 0, 1)] and kind_counts(df).count() == 2
    df.write.parquet(str(tmp_path / "s"))
    stream = unique_edges(spark.readStream.schema(df.schema).parquet(str(tmp_path / "s")))
    q = degree_counts(stream).writeStream.outputMode("complete").format("memory").queryName("deg").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.sql("select * from deg")) == [(1, 1, 0), (2, 1, 1), (3, 0, 1)]


def test_documents_are_read_in_pieces(spark, tmp_path):
    """No task reads a file whole: any layout, braces and quotes in texts, other keys, elements over many blocks."""
    odd = ['}"{', "\\", '\\"}', "]],[[", "é}" * 40, '","nodes":[{']
    nodes = [{"id": f"n{i}", "kinds": ["X"] * (i % 3), "properties": {"t": odd[i % 6], "o": {"a": [{"b": {}}, "}"]}}} for i in range(60)]
    edges = [{"start_id": f"n{i}", "end_id": f"n{(i * 7) % 60}", "kind": "R}", "properties": {"w": i}} for i in range(60)]
    graph = {"edges": edges, "note": [{"nodes": [{"id": "no"}]}], "nodes": nodes, "more": {"edges": [{"kind": "no"}]}}
    doc = {"nodes": [{"id": "no"}], "graph": graph, "meta": {"nodes": [{"id": "no"}], "graph": {"x": 1}}}
    want = sorted((n["id"], len(n["kinds"]), json.dumps(n["properties"]["t"], ensure_ascii=False)) for n in nodes)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size, text in ((old, json.dumps(doc)), ("999b", json.dumps(doc)), ("999b", json.dumps(doc, indent=3, ensure_ascii=False) + "\n \n")):
            (tmp_path / "p.json").write_text(text)
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            n, e = documents.read_documents(spark, str(tmp_path / "p.json"))
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
            assert rows(n.selectExpr("id", "size(kinds)", "props['t']")) == want
            assert [(r["start_id"], r["end_id"], r["kind"], r["w"]) for r in e.orderBy("at").selectExpr("*", "props['w'] w").collect()] == [(x["start_id"], x["end_id"], x["kind"], str(x["properties"]["w"])) for x in edges]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for bad in (json.dumps(doc)[:-1], json.dumps(doc)[:-30], json.dumps(doc) + "}"):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(documents.DocumentError, match="brackets"):
            documents.read_documents(spark, str(tmp_path / "bad.json"))


def test_derived_edges_of_a_dump_are_made_once(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    nodes = spark.range(4).select("id", F.lit("x").alias("name"))
    edges = spark.range(40).selectExpr("id % 4 as start_id", "id % 3 as end_id").groupBy("start_id", "end_id").count().select(F.monotonically_increasing_id().alias("id"), "start_id", "end_id")
    g = documents.PropertyGraph.empty(spark).with_nodes(nodes, ["N"]).with_edges(edges, "E")
    scans, scan = [], type(g).edge_scan
    monkeypatch.setattr(type(g), "edge_scan", lambda self, *a, **k: (scans.append([s.derived() for s in self.edges]), scan(self, *a, **k))[1])
    m = dump.dump(g, str(tmp_path / "d"), partitions=2)
    documents.export_to(g, str(tmp_path / "g.json"))
    assert m["graphs"][0]["edge_count"] == 12 and scans and not any(map(any, scans)) and g.edges[0].derived()

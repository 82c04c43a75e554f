"""Relational tables as a typed property graph.

Ids are kind tag * 2^48 + key, so that they are unique and the same in any engine. Each table keeps its
columns as properties; nothing is read before a query asks for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from knotwork.graph import PropertyGraph

#: The number of each node kind within ids.
TAGS = {"Region": 1, "Nation": 2, "Customer": 3, "Supplier": 4, "Part": 5, "Order": 6, "User": 7, "Event": 8, "Document": 9, "Message": 10}
SHIFT = 1 << 48
#: Turns of a conversation that have keys of their own.
TURNS = 1 << 20


def ident(kind: str, key: Column | str) -> Column:
    return F.lit(TAGS[kind] * SHIFT) + _below((F.col(key) if isinstance(key, str) else key).cast("long"), SHIFT)


def _below(key: Column, limit: int) -> Column:
    """The key; one that would run into another's number ends the query. Null stays null."""
    return F.when((key >= limit) | (key < 0), F.raise_error(F.lit(f"a key that is not below {limit}")).cast("long")).otherwise(key)


def message_key(conv: str = "conv_id", turn: str = "turn") -> Column:
    return F.col(conv).cast("long") * TURNS + _below(F.col(turn).cast("long"), TURNS)


def _edge(df: DataFrame, start: Column, end: Column, tag: int, *props: str) -> DataFrame:
    """Edges with an id from their ends: parallel edges of a kind are one edge, the first properties count."""
    out = df.select(start.alias("start_id"), end.alias("end_id"), *props).where("start_id is not null and end_id is not null")
    return out.withColumn("id", F.xxhash64(F.lit(tag), "start_id", "end_id"))


_SCHEMAS: dict[tuple, StructType] = {}
_GRAPHS: dict[tuple, tuple[tuple, PropertyGraph]] = {}


def _changed(spark: SparkSession, path: str) -> int:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).getModificationTime()


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; its schema is looked up once for each state of the file or folder, which saves a job."""
    key = (spark.sparkContext.applicationId, path, _changed(spark, path))
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")


def table_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The tables of a folder as a graph. Its plans are made once for each session and state of the tables; nothing is kept of the data."""
    key, state = (spark.sparkContext.applicationId, id(spark), sf_dir), tuple(_changed(spark, f"{sf_dir}/{t}.parquet") for t in TABLES)
    if key not in _GRAPHS or _GRAPHS[key][0] != state or _GRAPHS[key][1].spark is not spark:
        _GRAPHS[key] = (state, _table_graph(spark, sf_dir))
    graph = _GRAPHS[key][1]
    return PropertyGraph(spark, [*graph.nodes], [*graph.edges])


def _table_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    t = lambda name: read_table(spark, f"{sf_dir}/{name}.parquet")
    region, nation, customer, supplier = t("region"), t("nation"), t("customer"), t("supplier")
    part, orders, line, events, docs, turns = t("part"), t("orders"), t("lineitem"), t("events"), t("documents"), t("conversations")
    g = PropertyGraph.empty(spark)
    for df, kinds, key in (
        (region, ("Region", "Place"), "r_regionkey"),
        (nation, ("Nation", "Place"), "n_nationkey"),
        (customer, ("Customer", "Party"), "c_custkey"),
        (supplier, ("Supplier", "Party"), "s_suppkey"),
        (part, ("Part",), "p_partkey"),
        (orders, ("Order",), "o_orderkey"),
        (events, ("Event",), "event_id"),
        (docs, ("Document",), "doc_id"),
    ):
        g = g.with_nodes(df.withColumn("id", ident(kinds[0], key)), kinds, "id")
    g = g.with_nodes(events.select("user_id").distinct().withColumn("id", ident("User", "user_id")), ["User"], "id")
    g = g.with_nodes(turns.withColumn("id", ident("Message", message_key())), ["Message"], "id")

    g = g.with_edges(_edge(nation, ident("Nation", "n_nationkey"), ident("Region", "n_regionkey"), 1), "IN_REGION", (), ["Nation", "Place"], ["Region", "Place"])
    homes = customer.select(ident("Customer", "c_custkey").alias("s"), ident("Nation", "c_nationkey").alias("e")).union(supplier.select(ident("Supplier", "s_suppkey"), ident("Nation", "s_nationkey")))
    g = g.with_edges(_edge(homes, F.col("s"), F.col("e"), 2), "IN_NATION", (), ["Party"], ["Nation", "Place"])
    g = g.with_edges(_edge(orders, ident("Customer", "o_custkey"), ident("Order", "o_orderkey"), 3), "PLACED", (), ["Customer", "Party"], ["Order"])
    pairs = line.groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("lines"))
    g = g.with_edges(_edge(pairs, ident("Order", "l_orderkey"), ident("Part", "l_partkey"), 4, "quantity", "lines"), "CONTAINS", ["quantity", "lines"], ["Order"], ["Part"])
    pairs = line.select("l_orderkey", "l_suppkey").distinct()
    g = g.with_edges(_edge(pairs, ident("Order", "l_orderkey"), ident("Supplier", "l_suppkey"), 5), "SUPPLIED_BY", (), ["Order"], ["Supplier", "Party"])
    g = g.with_edges(_edge(events, ident("User", "user_id"), ident("Event", "event_id"), 6), "PERFORMED", (), ["User"], ["Event"])
    after = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    g = g.with_edges(_edge(events.withColumn("after", after), ident("Event", "event_id"), ident("Event", "after"), 7), "NEXT", (), ["Event"], ["Event"])
    key = message_key()
    g = g.with_edges(_edge(turns.withColumn("after", F.lead(key).over(Window.partitionBy("conv_id").orderBy("turn"))), ident("Message", key), ident("Message", F.col("after")), 8), "REPLIES", (), ["Message"], ["Message"])
    return g.with_edges(_edge(top_trade(customer, orders, line, supplier), F.col("s"), F.col("e"), 9), "TOP_TRADE", (), ["Nation", "Place"], ["Nation", "Place"])


def top_trade(customer: DataFrame, orders: DataFrame, line: DataFrame, supplier: DataFrame, best: int = 2) -> DataFrame:
    """(s, e): each customer nation with the nations of its two best suppliers by revenue, ties to the smaller key."""
    # Line items are dealt out once, by order; suppliers are joined to sums. Orders and customers grow with them, so no broadcast.
    buyers = orders.select("o_orderkey", "o_custkey").join(customer.select("c_custkey", "c_nationkey").hint("merge"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    revenue = (
        line.select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
        .join(buyers.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("c_nationkey", "l_suppkey")
        .agg(F.sum("v").alias("v"))
        .join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("c_nationkey", "s_nationkey")
        .agg(F.sum("v").alias("v"))
    )
    place = Window.partitionBy("c_nationkey").orderBy(F.desc("v"), "s_nationkey")
    return revenue.withColumn("r", F.row_number().over(place)).where(F.col("r") <= best).select(ident("Nation", "c_nationkey").alias("s"), ident("Nation", "s_nationkey").alias("e"))


def events_dynamic(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Events as a graph with property bags: the JSON column's keys, and type and value."""
    from knotwork.functions.types import FLOAT, as_json

    e = read_table(spark, f"{sf_dir}/events.parquet")
    bag = F.from_json("props", "map<string,string>")
    # from_json gives texts; numbers keep their look, all else becomes a JSON string.
    as_fragment = lambda k, v: F.when(v.rlike(r"^-?(0|[1-9]\d*)(\.\d+)?$") | v.isin("true", "false"), v).when(v.startswith("["), v).otherwise(F.to_json(F.array(v)).substr(F.lit(2), F.length(F.to_json(F.array(v))) - 2))
    more = F.create_map(F.lit("type"), F.concat(F.lit('"'), "event_type", F.lit('"')), F.lit("value"), as_json(F.col("value"), FLOAT))
    nodes = e.select(ident("Event", "event_id").alias("id"), F.array(F.lit("Event"), F.initcap("event_type")).alias("kinds"), F.map_concat(more, F.coalesce(F.transform_values(bag, as_fragment), F.create_map().cast("map<string,string>"))).alias("props"))
    users = e.select("user_id").distinct().select(ident("User", "user_id").alias("id"), F.array(F.lit("User")).alias("kinds"), F.create_map(F.lit("user_id"), F.col("user_id").cast("string")).alias("props"))
    edges = e.select(F.xxhash64(F.lit(6), ident("User", "user_id"), ident("Event", "event_id")).alias("id"), ident("User", "user_id").alias("start_id"), ident("Event", "event_id").alias("end_id"), F.lit("PERFORMED").alias("kind"), F.create_map().cast("map<string,string>").alias("props"))
    return PropertyGraph.dynamic(spark, nodes.unionByName(users), edges)

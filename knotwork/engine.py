"""The entry point: a graph and the queries over it."""

from __future__ import annotations

from pyspark.sql import DataFrame

from knotwork.graph import PropertyGraph
from knotwork.plans import syntax as S
from knotwork.plans.compiler import Config, Planner, Report
from knotwork.plans.parser import QueryError, parse


class Engine:
    """Runs query texts and syntax trees. Reads give lazy DataFrames; updates give another Engine."""

    def __init__(self, graph: PropertyGraph, config: Config | None = None):
        self.graph, self.config = graph, config or Config()

    def query(self, text: str | S.Query, **params) -> DataFrame:
        result, _, _ = self._run(text, params)
        if result is None:
            raise QueryError("the query returns nothing; use update()")
        return result

    def update(self, text: str | S.Query, **params) -> Engine:
        """The engine over the changed graph."""
        return Engine(self._run(text, params)[1], self.config)

    def update_and_return(self, text: str | S.Query, **params) -> tuple[DataFrame | None, Engine]:
        result, graph, _ = self._run(text, params)
        return result, Engine(graph, self.config)

    def report(self, text: str | S.Query, **params) -> Report:
        """What the planner decides for a query."""
        return self._run(text, params)[2]

    def explain(self, text: str | S.Query, **params) -> str:
        """The planner's notes and Spark's formatted plan."""
        result, _, report = self._run(text, params)
        notes = "\n".join(f"- {rule}: {why}" for rule, why in report.steps)
        plan = result._jdf.queryExecution().explainString(result.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")) if result is not None else ""
        return f"{notes}\n{plan}"

    def sql(self, text: str) -> DataFrame:
        """Plain SQL over the views nodes (id, kinds, props) and edges (id, start_id, end_id, kind, props)."""
        self.graph.all_nodes().createOrReplaceTempView("nodes")
        self.graph.all_edges().createOrReplaceTempView("edges")
        return self.graph.spark.sql(text)

    def _run(self, text, params):
        planner = Planner(self.graph, params, self.config)
        result, graph = planner.run(parse(text) if isinstance(text, str) else text)
        return result, graph, planner.report

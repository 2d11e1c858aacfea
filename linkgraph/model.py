"""The property graph: a DataFrame for each label and one for each edge type."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EdgeType:
    """src, dst and properties of the edges of one type, and the labels that its ends are known to have (None: any).

    closed: every end exists as a node of that label, so a query that needs only the key can do without the nodes.
    """

    df: DataFrame
    src_label: str | None = None
    dst_label: str | None = None
    closed: bool = False
    derived: bool = False
    rule: str | None = None


@dataclass(frozen=True)
class PropertyGraph:
    """Nodes by label (key, then properties) and edges by type. Values are never changed in place: methods give new graphs."""

    spark: SparkSession
    nodes: dict[str, DataFrame] = field(default_factory=dict)
    edges: dict[str, EdgeType] = field(default_factory=dict)
    indexes: tuple = ()
    constraints: tuple = ()

    # -- building
    def with_nodes(self, label: str, df: DataFrame, key: Column | str = "key") -> PropertyGraph:
        df = df if isinstance(key, str) and key == "key" else df.select((F.col(key) if isinstance(key, str) else key).cast("string").alias("key"), *[F.col(f"`{c}`") for c in df.columns if c != "key"])
        return replace(self, nodes=self.nodes | {label: df})

    def with_edges(self, etype: str, df: DataFrame, src_label: str | None = None, dst_label: str | None = None, closed: bool = False, unique: bool = False, derived: bool = False, rule: str | None = None) -> PropertyGraph:
        """An edge is its type and its ends: of rows with the same ends one stays, unless the caller knows them unique."""
        if not unique:
            df = df.dropDuplicates(["src", "dst"])
        return replace(self, edges=self.edges | {etype: EdgeType(df, src_label, dst_label, closed, derived, rule)})

    def without_edges(self, etype: str) -> PropertyGraph:
        return replace(self, edges={k: v for k, v in self.edges.items() if k != etype})

    # -- plain views
    def all_edges(self, types: Iterable[str] | None = None) -> DataFrame:
        """etype, src, dst of all edges or of some types."""
        out = None
        for name in sorted(self.edges if types is None else [t for t in types if t in self.edges]):
            e = self.edges[name].df.select(F.lit(name).alias("etype"), "src", "dst")
            out = e if out is None else out.unionAll(e)
        return out if out is not None else self.spark.createDataFrame([], "etype string, src string, dst string")

    def all_nodes(self, labels: Iterable[str] | None = None) -> DataFrame:
        """key and label of all nodes or of some labels."""
        out = None
        for name in sorted(self.nodes if labels is None else [x for x in labels if x in self.nodes]):
            n = self.nodes[name].select("key", F.lit(name).alias("label"))
            out = n if out is None else out.unionAll(n)
        return out if out is not None else self.spark.createDataFrame([], "key string, label string")

    # -- queries
    def query(self, text: str, params: dict | None = None) -> DataFrame:
        from .plans.compiler import run

        return run(self, text, params or {})

    def explain(self, text: str, params: dict | None = None) -> str:
        return self.query(text, params)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def stats(self) -> DataFrame:
        """kind, name, count of nodes by label and edges by type."""
        n = self.all_nodes().groupBy("label").count().select(F.lit("node").alias("kind"), F.col("label").alias("name"), "count")
        e = self.all_edges().groupBy("etype").count().select(F.lit("edge").alias("kind"), F.col("etype").alias("name"), "count")
        return n.unionAll(e)

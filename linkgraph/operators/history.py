"""Time: an append-only commit log, the graph as of a commit, and the history of nodes and edges.

The log is a table of changes: commit, at, op (put_node, drop_node, put_edge, drop_edge), key, label,
props (JSON), etype, src, dst, rule. Each commit is written once as its own partition of the folder.
State at a commit is, for each key or edge, its last change up to then.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import PropertyGraph

SCHEMA = "commit bigint, at timestamp_ntz, op string, key string, label string, props string, etype string, src string, dst string, rule string"


class Conflict(RuntimeError):
    pass


class CommitLog:
    """A folder of commits. A commit names the one it builds on, and is refused if another came in between.

    A commit first claims its number by creating a file of that name, which the file system lets one
    writer do; a claim whose writer fails is given back.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def changes(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], SCHEMA)
            raise

    def head(self) -> int:
        return self.changes().agg(F.coalesce(F.max("commit"), F.lit(0))).first()[0]

    def append(self, changes: DataFrame, at: dt.datetime, base: int | None = None) -> int:
        head = self.head()
        if base is not None and base != head:
            raise Conflict(f"commit {head} came after {base}")
        n = head + 1
        have = set(changes.columns)
        cols = [F.lit(n).cast("bigint").alias("commit"), F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz").alias("at")]
        cols += [(F.col(c) if c in have else F.lit(None).cast("string")).alias(c) for c in ("op", "key", "label", "props", "etype", "src", "dst", "rule")]
        fs, claim = self._claim(n)
        try:
            changes.select(*cols).write.mode("append").parquet(self.path)
        except Exception:
            fs.delete(claim, False)
            raise
        return n

    def _claim(self, n: int):
        jvm = self.spark.sparkContext._jvm
        claim = jvm.org.apache.hadoop.fs.Path(f"{self.path.rstrip('/')}-claims/{n}")
        fs = claim.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            made = fs.createNewFile(claim)
        except Exception as e:
            raise Conflict(f"commit {n} can't be claimed: {e}") from e
        if not made:
            raise Conflict(f"another writer makes commit {n}")
        return fs, claim

    def commit_at(self, when: dt.datetime) -> int:
        """The last commit at or before an instant, 0 if there is none."""
        at = F.lit(when.isoformat(sep=" ")).cast("timestamp_ntz")
        return self.changes().where(F.col("at") <= at).agg(F.coalesce(F.max("commit"), F.lit(0))).first()[0]


def nodes_at(log: DataFrame, commit: int) -> DataFrame:
    """key, label, props of the nodes that exist after the commit."""
    n = log.where(F.col("op").isin("put_node", "drop_node") & (F.col("commit") <= commit))
    last = n.groupBy("key").agg(F.max_by(F.struct("op", "label", "props"), "commit").alias("x"))
    return last.where("x.op = 'put_node'").select("key", "x.label", "x.props")


def edges_at(log: DataFrame, commit: int, key: str | None = None) -> DataFrame:
    """etype, src, dst, rule of the edges that exist after the commit; key: only those at this node."""
    e = log.where(F.col("op").isin("put_edge", "drop_edge") & (F.col("commit") <= commit))
    if key is not None:
        e = e.where((F.col("src") == key) | (F.col("dst") == key))
    last = e.groupBy("etype", "src", "dst").agg(F.max_by(F.struct("op", "rule"), "commit").alias("x"))
    return last.where("x.op = 'put_edge'").select("etype", "src", "dst", "x.rule")


def graph_at(log: CommitLog, commit: int, schemas: dict[str, str], horizon: int = 0) -> PropertyGraph:
    """The graph as of a commit; schemas: the properties of each label, as a DDL string."""
    head = log.head()
    if not horizon <= commit <= head:
        raise ValueError(f"commit {commit} is outside {horizon} to {head}")
    nodes, edges = nodes_at(log.changes(), commit), edges_at(log.changes(), commit)
    g = PropertyGraph(log.spark)
    for label, ddl in schemas.items():
        df = nodes.where(F.col("label") == label).select("key", F.from_json("props", ddl).alias("p"))
        g = g.with_nodes(label, df.select("key", "p.*"))
    for row in edges.select("etype").distinct().orderBy("etype").collect():
        g = g.with_edges(row["etype"], edges.where(F.col("etype") == row["etype"]).select("src", "dst"), unique=True)
    return g


def node_history(log: DataFrame, key: str) -> DataFrame:
    """commit, at, op, label, props of every change of a node."""
    return log.where((F.col("key") == key) & F.col("op").isin("put_node", "drop_node")).select("commit", "at", "op", "label", "props").orderBy("commit")


def edge_history(log: DataFrame, src: str | None = None, dst: str | None = None) -> DataFrame:
    """etype, src, dst, rule, since, until (null: still there) of each time an edge was there."""
    e = log.where(F.col("op").isin("put_edge", "drop_edge"))
    if src is not None:
        e = e.where(F.col("src") == src)
    if dst is not None:
        e = e.where(F.col("dst") == dst)
    w = W.partitionBy("etype", "src", "dst").orderBy("commit")
    e = e.withColumn("was", F.lag("op").over(w)).where((F.col("op") == "put_edge") & (F.coalesce("was", F.lit("drop_edge")) == "drop_edge") | (F.col("op") == "drop_edge") & (F.col("was") == "put_edge"))
    return e.withColumn("until", F.lead("commit").over(w)).where("op = 'put_edge'").select("etype", "src", "dst", "rule", F.col("commit").alias("since"), "until")


def was_linked(log: DataFrame, a: str, b: str, etype: str, commit: int) -> bool:
    return edges_at(log, commit, a).where((F.col("src") == a) & (F.col("dst") == b) & (F.col("etype") == etype)).limit(1).count() > 0


def last_changed(log: DataFrame) -> DataFrame:
    """key, commit of the last change of each node."""
    return log.where("key is not null").groupBy("key").agg(F.max("commit").alias("commit"))


def diff_edges(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes that lead from one set of edges (etype, src, dst, rule) to another."""
    cols = ["etype", "src", "dst", "rule"]
    gone = before.select(*cols).exceptAll(after.select(*cols)).select(F.lit("drop_edge").alias("op"), *cols)
    return gone.unionByName(after.select(*cols).exceptAll(before.select(*cols)).select(F.lit("put_edge").alias("op"), *cols))

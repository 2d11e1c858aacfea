"""Change streams: the commit log as a stream of events, and the differences of rules and queries batch by batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import PropertyGraph
from ..operators.history import SCHEMA, edges_at, nodes_at
from ..operators.rules import All, Any, Predicate, RuleDef, derive, leaves, pairs, plain, score_of
from ..storage import materialize

EVENTS = {"put_node": "NodeInserted", "drop_node": "NodeRemoved", "put_edge": "EdgeInserted", "drop_edge": "EdgeRemoved"}


class NotAllowed(ValueError):
    pass


def write_events(spark: SparkSession, path: str, files_a_batch: int | None = None) -> DataFrame:
    """A stream of event, commit, key, label, etype, src, dst from a commit log's folder; files_a_batch bounds what a batch reads."""
    r = spark.readStream.schema(SCHEMA)
    if files_a_batch:
        r = r.option("maxFilesPerTrigger", files_a_batch)
    kind = F.create_map(*[F.lit(x) for kv in EVENTS.items() for x in kv])
    return r.parquet(path).select(F.try_element_at(kind, F.col("op")).alias("event"), "commit", "key", "label", "etype", "src", "dst")


def snapshot(log: DataFrame, schemas: dict[str, str], spark: SparkSession) -> PropertyGraph:
    """The graph after all changes of a log."""
    last = log.agg(F.coalesce(F.max("commit"), F.lit(0))).first()[0]
    nodes, edges = nodes_at(log, last), edges_at(log, last)
    g = PropertyGraph(spark)
    for label, ddl in schemas.items():
        g = g.with_nodes(label, nodes.where(F.col("label") == label).select("key", F.from_json("props", ddl).alias("p")).select("key", "p.*"))
    for row in edges.select("etype").distinct().orderBy("etype").collect():
        g = g.with_edges(row["etype"], edges.where(F.col("etype") == row["etype"]).select("src", "dst"), unique=True)
    return g


def _diffs(spark: SparkSession, log_path: str, out_path: str, checkpoint: str, current: Callable[[DataFrame], DataFrame], names: tuple[str, str], differ: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]] | None = None):
    """Starts a stream that, for each batch of commits, appends what came and went in current(log) to out_path, and ends when all is read.

    Both states are computed from the log up to the batch's first and last commit, so a batch that is run again writes the same;
    it is written to a folder of its own by number. differ: what came and went between two logs, where both results need not be compared.
    """

    def each(batch: DataFrame, number: int) -> None:
        low, high = batch.agg(F.min("commit"), F.max("commit")).first()
        if low is None:
            return
        log = spark.read.schema(SCHEMA).parquet(log_path)
        logs = log.where(F.col("commit") < low), log.where(F.col("commit") <= high)
        if differ is not None:
            came, went = differ(*logs)
        else:
            before, after = map(current, logs)
            came, went = after.exceptAll(before), before.exceptAll(after)
        came = came.select(F.lit(names[0]).alias("event"), F.lit(high).alias("commit"), "*")
        went = went.select(F.lit(names[1]).alias("event"), F.lit(high).alias("commit"), "*")
        came.unionByName(went).write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1000).parquet(log_path)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rule_events(spark: SparkSession, log_path: str, out_path: str, checkpoint: str, rules: list[RuleDef], schemas: dict[str, str]):
    """EdgeFired and EdgeRetracted of the rules, with their weight."""

    def current(log: DataFrame) -> DataFrame:
        g = derive(snapshot(log, schemas, spark), rules)
        out = None
        for etype in dict.fromkeys(r.edge_type for r in rules):
            e = g.edges[etype].df
            e = e.where("rule is not null").select("rule", F.lit(etype).alias("etype"), "src", "dst", F.col("score").alias("weight"))
            out = e if out is None else out.unionByName(e)
        return out

    def differ(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
        sides = [snapshot(log, schemas, spark) for log in (old, new)]
        if any(r.edge_type in x.edges for x in sides for r in rules):  # edges that were put by hand are no rule's
            x, y = current(old), current(new)
            return y.exceptAll(x), x.exceptAll(y)
        both = [_rule_diff(r, *(x.nodes for x in sides)) for r in rules]
        return tuple(reduce(DataFrame.unionByName, x) for x in zip(*both, strict=True))

    # pairs of fields alone can be told from the two states of both nodes
    alone = len({r.edge_type for r in rules}) == len(rules) and all(plain(r.predicate) and r.max_edges is None and not r.via_edge and r.namespace is None and {r.src_label, r.dst_label} <= set(schemas) for r in rules)
    return _diffs(spark, log_path, out_path, checkpoint, current, ("EdgeFired", "EdgeRetracted"), differ if rules and alone else None)


def _renamed(p: Predicate, prefix: str) -> Predicate:
    return replace(p, parts=tuple(_renamed(x, prefix) for x in p.parts)) if isinstance(p, (All, Any)) else replace(p, field=f"{prefix}{p.field}")


def _rule_diff(rule: RuleDef, before: dict[str, DataFrame], after: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The edges of a rule that came and went: pairs with a changed node that hold in one state, and not with the same weight in the other."""
    rule.validate()

    def states(label: str) -> DataFrame:
        """key, each field before (o_) and after (n_), and whether any changed."""
        fields = [f for f in dict.fromkeys(x.field for x in leaves(rule.predicate)) if f in after[label].columns]
        side = lambda nodes, prefix: nodes[label].select("key", *[F.col(f"`{f}`").alias(f"{prefix}{f}") for f in fields])
        same = F.lit(True)
        for f in fields:
            same = same & F.col(f"`o_{f}`").eqNullSafe(F.col(f"`n_{f}`"))
        return materialize(side(before, "o_").join(side(after, "n_"), "key", "full_outer").withColumn("_moved", ~same), "rule-states")

    src = states(rule.src_label)
    dst = src if rule.src_label == rule.dst_label else states(rule.dst_label)
    out = []
    for here, there in (("n_", "o_"), ("o_", "n_")):
        p, q = _renamed(rule.predicate, here), _renamed(rule.predicate, there)

        def keep(s, d, a, b, score, q=q):
            other = score_of(q, s, d, a, b)
            return other.isNull() | (other != score)

        found = None
        for x, y in ((src.where("_moved"), dst), (src.where("not _moved"), dst.where("_moved"))):
            if x.isEmpty() or y.isEmpty():
                continue
            one = pairs(p, x, y, rule.approximate, also=tuple(leaves(q)), keep=keep)
            found = one if found is None else found.unionByName(one)
        if found is None:
            found = pairs(p, src.limit(0), dst.limit(0), rule.approximate)
        out.append(found.where("s != d").select(F.lit(rule.name).alias("rule"), F.lit(rule.edge_type).alias("etype"), F.col("s").alias("src"), F.col("d").alias("dst"), F.col("score").alias("weight")))
    return tuple(out)


def check_query(text: str) -> None:
    """Only queries of one MATCH with one relationship at most and plain columns can be followed."""
    from ..plans import syntax as S

    q = S.parse(text)
    if not isinstance(q, S.Query) or len(q.parts) != 1:
        raise NotAllowed("one query without UNION")
    part = q.parts[0]
    if len(part) != 2 or not isinstance(part[0], S.Match) or part[0].optional or not isinstance(part[1], S.Project):
        raise NotAllowed("one MATCH and RETURN")
    rels = [r for p in part[0].paths for r in p.rels]
    ret = part[1]
    if len(rels) > 1 or any(r.many for r in rels) or any(p.shortest for p in part[0].paths):
        raise NotAllowed("one relationship at most, of fixed length")
    if ret.order or ret.skip is not None or ret.distinct or any(S.has_aggregate(i.expr) for i in ret.items):
        raise NotAllowed("no ORDER BY, SKIP, DISTINCT or aggregates")


def query_events(spark: SparkSession, log_path: str, out_path: str, checkpoint: str, text: str, schemas: dict[str, str], params: dict | None = None):
    """QueryRowAdded and QueryRowRemoved of a query's result."""
    check_query(text)
    return _diffs(spark, log_path, out_path, checkpoint, lambda log: snapshot(log, schemas, spark).query(text, params), ("QueryRowAdded", "QueryRowRemoved"))

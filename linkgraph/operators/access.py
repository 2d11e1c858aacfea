"""Visibility: masks, roles and namespaces. A hidden node is absent, and no edge at it is seen or walked."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import PropertyGraph


@dataclass(frozen=True)
class Role:
    """What a role sees: these keys, and of these labels the nodes whose properties are as asked; within its namespaces."""

    name: str
    keys: tuple[str, ...] = ()
    labels: tuple[str, ...] = ()
    where: tuple = ()  # of (property, value or list of values)
    namespaces: tuple[str, ...] | None = None
    write_labels: tuple[str, ...] | None = None

    def sees(self, label: str, df: DataFrame) -> Column:
        by_key = F.col("key").isin(*self.keys) if self.keys else F.lit(False)
        by_label = F.lit(label in self.labels)
        for prop, value in self.where:
            c = F.col(f"`{prop}`") if prop in df.columns else F.lit(None)
            by_label = by_label & (c.isin(*value) if isinstance(value, (list, tuple)) else c == value)
        out = F.coalesce(by_key | by_label, F.lit(False))
        return out & in_namespaces(df, self.namespaces) if self.namespaces is not None else out


def in_namespaces(df: DataFrame, namespaces) -> Column:
    ns = F.coalesce(F.col("ns"), F.lit("default")) if "ns" in df.columns else F.lit("default")
    return ns.isin(*namespaces)


def _limit(g: PropertyGraph, nodes: dict[str, DataFrame]) -> PropertyGraph:
    """The graph with these nodes only, and the edges between them."""
    out = replace(g, nodes=nodes)
    for name, e in g.edges.items():
        df = e.df
        for end, label in (("src", e.src_label), ("dst", e.dst_label)):
            seen = out.all_nodes([label] if label else None).select(F.col("key").alias(end))
            df = df.join(seen, end, "left_semi")
        out = replace(out, edges=out.edges | {name: replace(e, df=df)})
    return out


def masked(g: PropertyGraph, visible: DataFrame) -> PropertyGraph:
    """Only nodes whose key is in visible (key)."""
    keys = visible.select("key").distinct()
    return _limit(g, {label: df.join(keys, "key", "left_semi") for label, df in g.nodes.items()})


def as_role(g: PropertyGraph, role: Role) -> PropertyGraph:
    return _limit(g, {label: df.where(role.sees(label, df)) for label, df in g.nodes.items()})


def in_namespace(g: PropertyGraph, *names: str) -> PropertyGraph:
    return _limit(g, {label: df.where(in_namespaces(df, names)) for label, df in g.nodes.items()})


def scoped(g: PropertyGraph, role: Role | None = None, namespace: str | None = None, keys: list[str] | None = None) -> PropertyGraph:
    """What all of these allow."""
    nodes = {}
    for label, df in g.nodes.items():
        c = F.lit(True)
        if role is not None:
            c = c & role.sees(label, df)
        if namespace is not None:
            c = c & in_namespaces(df, (namespace,))
        if keys is not None:
            c = c & F.col("key").isin(*keys)
        nodes[label] = df.where(c)
    return _limit(g, nodes)


def check_write(role: Role, label: str | None) -> None:
    if role.write_labels is not None and label not in role.write_labels:
        raise PermissionError(f"{role.name} may not write {label}")

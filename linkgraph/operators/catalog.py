"""Indexes and constraints as metadata, SHOW, and the CALL procedures."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import PropertyGraph


@dataclass(frozen=True)
class Entry:
    name: str
    label: str
    field: str


class ConstraintError(ValueError):
    pass


def duplicates(g: PropertyGraph, label: str, field: str) -> DataFrame:
    """Values that more than one node of the label has, and how many."""
    df = g.nodes[label]
    return df.where(F.col(f"`{field}`").isNotNull()).groupBy(F.col(f"`{field}`").alias("value")).agg(F.count("*").alias("nodes")).where("nodes > 1")


def execute(g: PropertyGraph, text: str) -> PropertyGraph:
    """The graph after CREATE or DROP of an index or constraint. Spark needs no index; the entry says what is expected to be looked up."""
    from ..plans.syntax import Command, QueryError, parse

    c = parse(text)
    if not isinstance(c, Command) or c.kind in ("show", "call"):
        raise QueryError("not a CREATE or DROP of an index or constraint")
    a = c.args
    verb, kind = c.kind.split("_")
    entries = {e.name: e for e in (g.indexes if kind == "index" else g.constraints)}
    if verb == "create":
        name = a["name"] or f"{kind}_{a['label']}_{a['field']}"
        if name in entries:
            if a["quiet"]:
                return g
            raise ConstraintError(f"{kind} {name} exists")
        if kind == "constraint" and a["label"] in g.nodes and duplicates(g, a["label"], a["field"]).limit(1).count():
            raise ConstraintError(f"{a['label']}.{a['field']} is not unique")
        entries[name] = Entry(name, a["label"], a["field"])
    elif a["name"] in entries:
        del entries[a["name"]]
    elif not a["quiet"]:
        raise ConstraintError(f"no {kind} {a['name']}")
    return replace(g, **{"indexes" if kind == "index" else "constraints": tuple(entries.values())})


def command(g: PropertyGraph, c) -> DataFrame:
    """SHOW and CALL as DataFrames."""
    from ..plans.syntax import QueryError

    spark = g.spark
    if c.kind == "show":
        kind = c.args["what"]
        rows = g.indexes if kind.startswith("ind") else g.constraints if kind.startswith("constraint") else None
        if rows is None:
            raise QueryError(f"nothing to show: {kind}")
        return spark.createDataFrame([(e.name, e.label, e.field) for e in rows], "name string, label string, field string")
    if c.kind != "call":
        raise QueryError("this statement changes the catalog; use operators.catalog.execute")
    proc = c.args["proc"]
    if proc == "db.labels":
        return spark.createDataFrame([(x,) for x in sorted(g.nodes)], "label string")
    if proc == "db.relationshiptypes":
        return spark.createDataFrame([(x,) for x in sorted(g.edges)], "relationshipType string")
    if proc == "db.propertykeys":
        names = {c for df in g.nodes.values() for c in df.columns if c != "key"} | {c for e in g.edges.values() for c in e.df.columns if c not in ("src", "dst")}
        return spark.createDataFrame([(x,) for x in sorted(names)], "propertyKey string")
    if proc in ("db.indexes", "db.constraints"):
        rows = g.indexes if proc == "db.indexes" else g.constraints
        return spark.createDataFrame([(e.name, e.label, e.field) for e in rows], "name string, label string, field string")
    if proc == "db.schema.visualization":
        return spark.createDataFrame([(e.src_label, t, e.dst_label) for t, e in sorted(g.edges.items())], "source string, type string, target string")
    if proc == "db.ping":
        return spark.createDataFrame([(True,)], "success boolean")
    if proc == "dbms.components":
        return spark.createDataFrame([("linkgraph", spark.version)], "name string, version string")
    raise QueryError(f"no procedure {proc}")

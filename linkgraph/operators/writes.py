"""Writing statements: CREATE, MERGE, SET, REMOVE and DELETE give a new graph; nothing is changed in place.

The reading part is a DataFrame of rows on the graph before the statement; each writing clause turns
the rows into deltas, which are joined into the tables by key. Where rows set the same property of a
node to different values, the greatest stays, so that the result doesn't depend on the rows' order.
"""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import V, as_type, common, entity, is_null, lit, normal
from ..model import EdgeType, PropertyGraph
from ..plans import syntax as S
from ..plans.compiler import Compiler
from ..storage import materialize
from .catalog import ConstraintError, duplicates


@dataclass
class Written:
    graph: PropertyGraph
    counters: dict[str, int] = field(default_factory=dict)
    rows: DataFrame | None = None


def execute(g: PropertyGraph, text: str, params: dict | None = None) -> Written:
    q = S.parse(text)
    if not isinstance(q, S.Query) or len(q.parts) != 1:
        raise S.QueryError("one statement without UNION")
    part = q.parts[0]
    first = next((k for k, c in enumerate(part) if isinstance(c, S.Write)), None)
    if first is None:
        raise S.QueryError("this statement writes nothing")
    w = Writer(g, params or {}, q)
    df, scope = w.compiler.clauses(part[:first], part[first:])
    if w.compiler.mode == "set":  # equal rows write the same: only what is written from is kept, once
        df = w.compiler.compact(df, scope, w.compiler.later)
    w.df, w.scope = w.compiler.one(df), scope
    if first:
        w.pin()
    for k, c in enumerate(part[first:]):
        if isinstance(c, S.Write):
            getattr(w, c.kind)(c)
        elif isinstance(c, S.Project) and c.final and first + k == len(part) - 1:
            w.compiler.graph = w.graph
            rows, _ = w.compiler.returned(w.df, w.scope, c)
            return w.done(rows)
        else:
            raise S.QueryError("only RETURN follows a writing clause")
    return w.done(None)


class Writer:
    def __init__(self, g: PropertyGraph, params: dict, q: S.Query) -> None:
        self.graph, self.compiler = g, Compiler(g, params, q)
        self.df: DataFrame
        self.scope: dict[str, V] = {}
        self.counters: Counter = Counter()

    def done(self, rows: DataFrame | None) -> Written:
        for c in self.graph.constraints:
            if c.label in self.graph.nodes and c.field in self.graph.nodes[c.label].columns and duplicates(self.graph, c.label, c.field).limit(1).count():
                raise ConstraintError(f"{c.label}.{c.field} is not unique")
        return Written(self.graph, dict(self.counters), rows)

    def pin(self) -> None:
        """Rows that later deltas share are written once: generated keys must not be drawn again."""
        self.df = materialize(self.df, "write-rows") if self.df.columns else self.df

    # -- tables
    def put_nodes(self, label: str, new: DataFrame) -> None:
        old = self.graph.nodes.get(label)
        if old is not None:
            types = {f.name: f.dataType for f in old.schema.fields}
            cols = []
            for f in new.schema.fields:
                if f.name in types and types[f.name].simpleString() != f.dataType.simpleString():
                    cols.append(as_type(V(F.col(f"`{f.name}`"), f.dataType), common([normal(types[f.name]), f.dataType])).alias(f.name))
                else:
                    cols.append(F.col(f"`{f.name}`"))
            new = new.select(*cols)
            wide = {f.name: f.dataType for f in new.schema.fields}
            old = old.select(*[as_type(V(F.col(f"`{f.name}`"), f.dataType), wide[f.name]).alias(f.name) if f.name in wide and wide[f.name].simpleString() != f.dataType.simpleString() else F.col(f"`{f.name}`") for f in old.schema.fields])
            new = old.unionByName(new, allowMissingColumns=True)
        self.graph = replace(self.graph, nodes=self.graph.nodes | {label: new})

    def put_edges(self, etype: str, new: DataFrame) -> None:
        old = self.graph.edges.get(etype)
        new = new.dropDuplicates(["src", "dst"])
        if old is not None:
            new = old.df.unionByName(new.join(old.df.select("src", "dst"), ["src", "dst"], "left_anti"), allowMissingColumns=True)
        self.graph = replace(self.graph, edges=self.graph.edges | {etype: EdgeType(new)})

    def label_of(self, v: V) -> str:
        if not v.labels or len(v.labels) != 1:
            raise S.QueryError("a node that is written needs its label in the pattern")
        return v.labels[0]

    # -- create and merge
    def new_node(self, n: S.NodeP, keyed: bool = True) -> tuple[Column, dict[str, V]]:
        if not n.label:
            raise S.QueryError("a new node needs a label")
        props: dict[str, V] = {}
        for k, e in n.props:
            v = entity(self.compiler.expr(e, self.scope))
            if not is_null(v.type):
                props[k] = v
        own = props.get("id")
        if own is not None and isinstance(own.type, T.StringType):
            return own.col, {k: v for k, v in props.items() if k != "id"}
        salt = uuid.uuid4().hex
        return F.concat(F.lit("_:"), F.md5(F.concat_ws("|", F.lit(salt), F.monotonically_increasing_id().cast("string")))), props

    def create(self, c: S.Write) -> None:
        made: list[tuple[str, str]] = []
        edges = []
        for p in c.paths:
            names = []
            for n in p.nodes:
                if n.var and n.var in self.scope:
                    if n.label or n.props:
                        raise S.QueryError(f"{n.var} is bound already")
                    names.append(n.var)
                    continue
                name = n.var or f"_new{uuid.uuid4().hex[:8]}"
                key, props = self.new_node(n)
                col = f"_w{uuid.uuid4().hex[:8]}"
                self.df = self.df.withColumn(col, F.struct(key.alias("key"), F.lit(n.label).alias("label"), *[v.col.alias(f"p_{k}") for k, v in props.items()]))
                self.scope[name] = V(F.col(col), kind="node", props={k: v.type for k, v in props.items()}, labels=(n.label,))
                made.append((name, n.label))
                names.append(name)
            for k, r in enumerate(p.rels):
                if len(r.types) != 1 or r.direction == "both" or r.many:
                    raise S.QueryError("a new relationship has one type and a direction")
                a, b = (names[k], names[k + 1]) if r.direction == "out" else (names[k + 1], names[k])
                edges.append((r, a, b, {x: entity(self.compiler.expr(e, self.scope)) for x, e in r.props}))
        self.pin()
        for name, label in made:
            v = self.scope[name]
            new = self.df.select(v.col["key"].alias("key"), *[v.col[f"p_{k}"].alias(k) for k in v.props])
            self.refuse_known(new)
            self.counters["nodes_created"] += new.count()
            self.counters["properties_set"] += sum(new.where(F.col(f"`{k}`").isNotNull()).count() for k in v.props)
            self.put_nodes(label, new)
        for r, a, b, props in edges:
            rows = self.df.select(self.scope[a].col["key"].alias("src"), self.scope[b].col["key"].alias("dst"), *[v.col.alias(k) for k, v in props.items()])
            self.add_edges(r, rows)

    def add_edges(self, r: S.RelP, rows: DataFrame) -> None:
        rows = rows.dropDuplicates(["src", "dst"])
        old = self.graph.edges.get(r.types[0])
        fresh = rows if old is None else rows.join(old.df.select("src", "dst"), ["src", "dst"], "left_anti")
        self.counters["relationships_created"] += fresh.count()
        self.put_edges(r.types[0], rows)

    def refuse_known(self, new: DataFrame) -> None:
        twice = new.groupBy("key").count().where("count > 1").limit(1).collect()
        known = new.join(self.graph.all_nodes().select("key"), "key", "left_semi").limit(1).collect()
        if twice or known:
            raise ConstraintError(f"a node with key {(twice or known)[0]['key']} exists")

    def merge(self, c: S.Write) -> None:
        p = c.paths[0]
        if not p.rels:
            return self.merge_node(c, p.nodes[0])
        if len(p.rels) != 1 or len(p.rels[0].types) != 1 or p.rels[0].many:
            raise S.QueryError("MERGE takes a node, or one relationship of one type")
        for n in p.nodes:
            if not (n.var and n.var in self.scope):
                self.merge_node(S.Write("merge", [S.PathP(None, (n,), ())]), n)
        r = p.rels[0]
        a, b = (0, 1) if r.direction != "in" else (1, 0)
        rows = self.df.select(self.scope[p.nodes[a].var].col["key"].alias("src"), self.scope[p.nodes[b].var].col["key"].alias("dst"), *[entity(self.compiler.expr(e, self.scope)).col.alias(k) for k, e in r.props])
        if r.direction == "both" and r.types[0] in self.graph.edges:
            back = self.graph.edges[r.types[0]].df.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
            rows = rows.join(back, ["src", "dst"], "left_anti")
        self.add_edges(r, rows)

    def merge_node(self, c: S.Write, n: S.NodeP) -> None:
        if n.var in self.scope:
            raise S.QueryError(f"{n.var} is bound already")
        if not n.label or not n.props:
            raise S.QueryError("MERGE needs a label and properties")
        values = {k: entity(self.compiler.expr(e, self.scope)) for k, e in n.props}
        cols = {f"_m{k}": v.col for k, v in values.items()}
        df = self.df.withColumns(cols)
        old = self.graph.nodes.get(n.label)
        wanted = df.select(*[F.col(f"_m{k}").alias(k) for k in values]).distinct()
        same = lambda k: F.col("key") if k == "id" and (old is None or "id" not in old.columns) else F.col(f"`{k}`")
        if old is not None and all(k in old.columns or k == "id" for k in values):
            have = old.select("key", *[same(k).alias(f"_h{k}") for k in values])
            on = None
            for k in values:
                t = F.col(k) == F.col(f"_h{k}")
                on = t if on is None else on & t
            found = wanted.join(have, on, "left").select("key", *values)
        else:
            found = wanted.withColumn("key", F.lit(None).cast("string")).select("key", *values)
        found = found.withColumn("created", F.col("key").isNull())
        fresh_key = F.col("id").cast("string") if "id" in values else F.concat(F.lit("_:"), F.md5(F.concat_ws("|", F.lit(n.label), *[F.col(k).cast("string") for k in values])))
        found = materialize(found.withColumn("key", F.coalesce("key", fresh_key)), "merge")
        new = found.where("created").select("key", *[k for k in values if k != "id"])
        count = new.count()
        self.counters["nodes_created"] += count
        self.counters["properties_set"] += count * len([k for k in values if k != "id"])
        if count:
            self.refuse_known(new)
            self.put_nodes(n.label, new)
        var = n.var or f"_new{uuid.uuid4().hex[:8]}"
        col = f"_w{uuid.uuid4().hex[:8]}"
        f = found.select(F.struct(F.col("key"), F.lit(n.label).alias("label")).alias(col), F.col("created").alias(f"{col}c"), *[F.col(k).alias(f"{col}{k}") for k in values])
        on = None
        for k in values:
            t = F.col(f"_m{k}").eqNullSafe(F.col(f"{col}{k}"))
            on = t if on is None else on & t
        self.df = df.join(f, on).drop(*cols, *[f"{col}{k}" for k in values])
        self.scope[var] = V(F.col(col), kind="node", props={}, labels=(n.label,))
        self.pin()
        everything = self.df
        for sets, created in ((c.on_create, True), (c.on_match, False)):
            if sets:
                self.df = everything.where(F.col(f"{col}c") == created)
                self.set(S.Write("set", sets=sets))
        self.df = everything

    # -- set, remove, delete
    def set(self, c: S.Write) -> None:
        by: dict[str, list[tuple[str, V]]] = {}
        for target, how, e in c.sets:
            if isinstance(target, S.Prop) and isinstance(target.of, S.Var):
                by.setdefault(target.of.name, []).append((target.name, entity(self.compiler.expr(e, self.scope))))
                continue
            if not isinstance(target, S.Var):
                raise S.QueryError("SET takes a property or a node")
            v = self.compiler.expr(e, self.scope)
            if not isinstance(v.type, T.StructType):
                raise S.QueryError("SET of a node takes a map")
            pairs = [(f.name, V(v.col[f.name], f.dataType)) for f in v.type.fields]
            node = self.scope[target.name]
            if how == "=" and node.kind == "node":
                pairs += [(k, lit(None)) for k in self.graph.nodes[self.label_of(node)].columns if k not in ("key", *[p for p, _ in pairs])]
            by.setdefault(target.name, []).extend(pairs)
        for name, pairs in by.items():
            v = self.scope.get(name)
            if v is None or v.kind not in ("node", "rel"):
                raise S.QueryError(f"{name} is no node or relationship")
            if v.kind == "rel":
                self.set_edge(v, pairs)
            else:
                self.set_node(v, pairs)

    def changes(self, pairs, ids: list[Column]) -> DataFrame:
        return self.df.select(*ids, *[(p.col if not is_null(p.type) else F.lit(None).cast("string")).alias(f"_s{i}") for i, (_, p) in enumerate(pairs)]).groupBy(*[f"_i{k}" for k in range(len(ids))]).agg(*[F.max(f"_s{i}").alias(f"_s{i}") for i in range(len(pairs))], F.lit(True).alias("_hit"))

    def changed(self, df: DataFrame, pairs) -> DataFrame:
        have = {f.name: f.dataType for f in df.schema.fields}
        cols = {}
        for i, (k, p) in enumerate(pairs):
            old = have.get(k)
            t = p.type if old is None else old if is_null(p.type) or old.simpleString() == p.type.simpleString() else common([normal(old), p.type])
            t = T.StringType() if is_null(t) else t
            new = as_type(V(F.col(f"_s{i}"), p.type if not is_null(p.type) else T.StringType()), t)
            cols[k] = F.when(F.col("_hit"), new).otherwise(as_type(V(F.col(f"`{k}`"), old), t) if old is not None else F.lit(None).cast(t))
        return df.withColumns(cols).drop("_hit", *[f"_s{i}" for i in range(len(pairs))])

    def set_node(self, v: V, pairs) -> None:
        if any(k == "key" for k, _ in pairs):
            raise S.QueryError("a key can't be set; use rename")
        label = self.label_of(v)
        d = self.changes(pairs, [v.col["key"].alias("_i0")])
        self.counters["properties_set"] += d.where("_i0 is not null").count() * len(pairs)
        df = self.graph.nodes[label]
        self.graph = replace(self.graph, nodes=self.graph.nodes | {label: self.changed(df.join(d, df["key"] == d["_i0"], "left").drop("_i0"), pairs)})

    def set_edge(self, v: V, pairs) -> None:
        for etype, e in list(self.graph.edges.items()):
            rows = Writer.__new__(Writer)
            rows.df = self.df.where(v.col["etype"] == etype)
            d = Writer.changes(rows, pairs, [v.col["src"].alias("_i0"), v.col["dst"].alias("_i1")])
            n = d.count()
            if n:
                self.counters["properties_set"] += n * len(pairs)
                df = e.df.join(d, (e.df["src"] == d["_i0"]) & (e.df["dst"] == d["_i1"]), "left").drop("_i0", "_i1")
                self.graph = replace(self.graph, edges=self.graph.edges | {etype: replace(e, df=self.changed(df, pairs))})

    def remove(self, c: S.Write) -> None:
        if not all(isinstance(x, S.Prop) and isinstance(x.of, S.Var) for x in c.names):
            raise S.QueryError("REMOVE takes properties")
        self.set(S.Write("set", sets=[(x, "=", S.Lit(None)) for x in c.names]))

    def delete(self, c: S.Write) -> None:
        for name in c.names:
            v = self.scope.get(name)
            if v is None or v.kind not in ("node", "rel"):
                raise S.QueryError(f"{name} is no node or relationship")
            if v.kind == "rel":
                gone = materialize(self.df.select(v.col["etype"].alias("etype"), v.col["src"].alias("src"), v.col["dst"].alias("dst")).where("src is not null").distinct(), "delete")
                for etype, e in list(self.graph.edges.items()):
                    mine = gone.where(F.col("etype") == etype).select("src", "dst")
                    if n := mine.count():
                        if e.derived:
                            raise S.QueryError(f"{etype} is derived; delete its rule instead")
                        self.counters["relationships_deleted"] += n
                        self.graph = replace(self.graph, edges=self.graph.edges | {etype: replace(e, df=e.df.join(mine, ["src", "dst"], "left_anti"))})
                continue
            label = self.label_of(v)
            gone = materialize(self.df.select(v.col["key"].alias("key")).where("key is not null").distinct(), "delete")
            self.counters["nodes_deleted"] += gone.count()
            for etype, e in list(self.graph.edges.items()):
                left = e.df.join(gone.select(F.col("key").alias("src")), "src", "left_anti").join(gone.select(F.col("key").alias("dst")), "dst", "left_anti")
                lost = e.df.count() - left.count()
                if lost and not c.detach and not e.derived:
                    raise ConstraintError("a node with relationships is deleted by DETACH DELETE only")
                if lost:
                    self.counters["relationships_deleted"] += lost
                    self.graph = replace(self.graph, edges=self.graph.edges | {etype: replace(e, df=left)})
            self.graph = replace(self.graph, nodes=self.graph.nodes | {label: self.graph.nodes[label].join(gone, "key", "left_anti")})


def ingest_batch(g: PropertyGraph, label: str, rows: DataFrame, on_conflict: str = "error") -> PropertyGraph:
    """Adds nodes (key, properties); keys that are there raise, stay as they are (skip), or are replaced."""
    old = g.nodes.get(label)
    rows = rows.dropDuplicates(["key"]) if on_conflict != "error" else rows
    if on_conflict == "error":
        twice = rows.groupBy("key").count().where("count > 1").limit(1).count()
        if twice or old is not None and rows.join(old.select("key"), "key", "left_semi").limit(1).count():
            raise ConstraintError("a key exists")
    elif old is not None and on_conflict == "skip":
        rows = rows.join(old.select("key"), "key", "left_anti")
    elif old is not None:
        old = old.join(rows.select("key"), "key", "left_anti")
    return g.with_nodes(label, rows if old is None else old.unionByName(rows, allowMissingColumns=True))


def rename_node(g: PropertyGraph, label: str, old: str, new: str) -> PropertyGraph:
    if g.all_nodes().where(F.col("key") == new).limit(1).count():
        raise ConstraintError(f"a node with key {new} exists")
    to = lambda c: F.when(F.col(c) == old, F.lit(new)).otherwise(F.col(c))
    nodes = g.nodes | {label: g.nodes[label].withColumn("key", to("key"))}
    edges = {t: replace(e, df=e.df.withColumns({"src": to("src"), "dst": to("dst")})) for t, e in g.edges.items()}
    return replace(g, nodes=nodes, edges=edges)


def set_props_many(g: PropertyGraph, label: str, values: DataFrame) -> PropertyGraph:
    """Sets the columns of values (key, ...) on the nodes with these keys; nulls leave what is there."""
    df = g.nodes[label]
    names = [c for c in values.columns if c != "key"]
    v = values.select("key", *[F.col(c).alias(f"_new_{c}") for c in names])
    out = df.join(v, "key", "left")
    cols = {c: F.coalesce(f"_new_{c}", F.col(c)) if c in df.columns else F.col(f"_new_{c}") for c in names}
    return g.with_nodes(label, out.withColumns(cols).drop(*[f"_new_{c}" for c in names]))

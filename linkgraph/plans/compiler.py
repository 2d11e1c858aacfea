"""Compiles read queries to DataFrames.

A variable is one column of the rows: a node a struct of key, label and the properties that the query
mentions, a relationship a struct of etype, src, dst and properties. What Catalyst can't know is
decided here: which node tables a pattern can do without, which relationships could coincide, how a
variable length unrolls, and when an optional match is an anti-join.
"""

from __future__ import annotations

import itertools
import json
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar
from ..functions.values import NULL, PATH, REL, V, arithmetic, as_type, common, compare, entity, is_bool, is_int, is_list, is_map, is_null, is_num, list_of, lit, map_of, member, normal, sort_keys, truth
from ..storage import Scratch, ship
from . import syntax as S
from .syntax import QueryError

_ids = itertools.count()


def _new(prefix: str) -> str:
    return f"_{prefix}{next(_ids)}"


def run(graph, text: str, params: dict) -> DataFrame:
    q = S.parse(text)
    if isinstance(q, S.Command):
        from ..operators.catalog import command

        return command(graph, q)
    if any(isinstance(c, S.Write) for part in q.parts for c in part):
        raise QueryError("this query writes; use operators.writes.execute")
    c = Compiler(graph, params, q)
    try:
        df = c.query(q)
    except (ValueError, TypeError) as e:
        raise e if isinstance(e, QueryError) else QueryError(str(e)) from e
    if q.explain:
        mode = graph.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        plan = json.dumps({"operators": c.ops, "spark": df._jdf.queryExecution().explainString(mode)})
        return graph.spark.createDataFrame([(plan,)], "plan string")
    return df


class Compiler:
    def __init__(self, graph, params: dict, q: S.Query | None = None) -> None:
        self.graph, self.spark, self.params = graph, graph.spark, params
        self.ops: list[str] = []
        self.wanted: set[str] | None = set()
        #: How often a row stands counts not at all (set), only as a number (bag), or by the row itself (None); and what later clauses mention.
        self.mode: str | None = None
        self.later: set[str] = set()
        self.whole: set[str] = set()  # nodes of which a MATCH of its own asks for all
        if q:
            self._collect(q)

    # -- which properties the query mentions ----------------------------------------------------
    def _collect(self, q: S.Query) -> None:
        for e in _expressions(q):
            for x in S.walk(e):
                if isinstance(x, S.Prop):
                    self.wanted.add(x.name)
                elif isinstance(x, S.Index) and isinstance(x.at, S.Lit) and isinstance(x.at.value, str):
                    self.wanted.add(x.at.value)
                elif isinstance(x, S.Call) and x.name in ("properties", "keys"):
                    self.wanted = None
                    return
        for p in _patterns(q):
            for part in (*p.nodes, *p.rels):
                self.wanted |= {k for k, _ in part.props}

    def _fields(self, df: DataFrame, reserved: tuple = ("key", "label", "src", "dst", "etype")) -> dict[str, T.DataType]:
        keep = lambda n: n not in ("src", "dst", "etype") if "src" in reserved and "src" in df.columns else n != "key" or df.schema["key"].dataType.simpleString() != "string"
        return {f.name: normal(f.dataType) for f in df.schema.fields if keep(f.name) and f.name not in ("_ns",) and (self.wanted is None or f.name in self.wanted)}

    # -- queries ---------------------------------------------------------------------------------
    def query(self, q: S.Query) -> DataFrame:
        out, names = None, None
        for k, part in enumerate(q.parts):
            df, columns = self.part(part)
            if out is None:
                out, names = df, columns
                continue
            if columns != names:
                raise QueryError("the parts of a UNION return the same columns")
            out = out.unionByName(df)
            if not q.union_all[k - 1]:
                out = out.distinct()
            self.ops.append("UnionAll" if q.union_all[k - 1] else "Union")
        return out

    def part(self, clauses: list) -> tuple[DataFrame, list[str]]:
        if not clauses or not isinstance(clauses[-1], S.Project) or not clauses[-1].final:
            raise QueryError("a query ends with RETURN")
        df, scope = self.clauses(clauses[:-1], clauses[-1:])
        return self.returned(df, scope, clauses[-1])

    def clauses(self, clauses: list, then: list = ()) -> tuple[DataFrame | None, dict[str, V]]:
        """The rows of reading clauses; then: what follows them."""
        df: DataFrame | None = None
        scope: dict[str, V] = {}
        clauses = _folded(clauses, self.whole)
        for k, c in enumerate(clauses):
            self.mode, self.later = _use_of_rows([*clauses[k + 1 :], *then]) if isinstance(c, S.Match) and not c.optional else (None, set())
            if isinstance(c, S.Match):
                follow = clauses[k + 1] if k + 1 < len(clauses) else None
                df, scope = (self.optional if c.optional else self.match)(df, scope, c, *([follow] if c.optional else []))
            elif isinstance(c, S.Unwind):
                df, scope = self.unwind(df, scope, c)
            elif isinstance(c, S.Project):
                df, scope, _ = self.project(df, scope, c)
            else:
                raise QueryError(f"no such clause in a read query: {type(c).__name__}")
        return df, scope

    def compact(self, df: DataFrame, scope: dict[str, V], needed: set[str]) -> DataFrame:
        """Rows that differ only in what nobody reads any more become one, with their number in _mult if it counts; scope loses the rest."""
        keep = {n: v for n, v in scope.items() if n in needed}
        if not keep or len(keep) == len(scope):
            return df
        for n in set(scope) - set(keep):
            del scope[n]
        self.ops.append("Compact")
        columns = list(dict.fromkeys(df.select(*[v.col for v in keep.values()]).columns))
        if self.mode == "set":
            return df.select(*columns).distinct()
        return df.groupBy(*columns).agg((F.sum("_mult") if "_mult" in df.columns else F.count(F.lit(1))).alias("_mult"))

    def one(self, df: DataFrame | None) -> DataFrame:
        return self.spark.range(1).select() if df is None else df

    # -- scans -----------------------------------------------------------------------------------
    def empty_node(self) -> DataFrame:
        return self.spark.createDataFrame([], "key string")

    def nodes(self, labels: list[str] | None) -> tuple[DataFrame, dict[str, T.DataType]]:
        """All nodes of the labels (None: all) as a struct column n, and their properties."""
        names = [x for x in (sorted(self.graph.nodes) if labels is None else labels) if x in self.graph.nodes]
        tables = [(x, self.graph.nodes[x]) for x in names] or [(None, self.empty_node())]
        props: dict[str, T.DataType] = {}
        for _, df in tables:
            for name, t in self._fields(df).items():
                props[name] = common([props[name], t]) if name in props else t
        out = None
        for label, df in tables:
            have = {f.name: f.dataType for f in df.schema.fields}
            cols = [F.col("key").cast("string").alias("key"), F.lit(label).cast("string").alias("label")]
            for name, t in props.items():
                cols.append((as_type(V(F.col(f"`{name}`").cast(normal(have[name])), normal(have[name])), t) if name in have else F.lit(None).cast(t)).alias(f"p_{name}"))
            part = df.select(F.struct(*cols).alias("n"))
            out = part if out is None else out.unionAll(part)
        return out, props

    def scan(self, label: str | None, name: str) -> tuple[DataFrame, V]:
        self.ops.append(f"ScanLabel({label or '*'})")
        df, props = self.nodes(None if label is None else [label])
        return df.withColumnRenamed("n", name), V(F.col(name), kind="node", props=props, labels=(label,) if label else None)

    def edge_table(self, types: tuple, direction: str) -> tuple[DataFrame, dict[str, T.DataType], list[str]]:
        """Columns f (from), t (to) and r (struct) of the edges of the types."""
        names = [t for t in (types or sorted(self.graph.edges)) if t in self.graph.edges]
        tables = [(t, self.graph.edges[t].df) for t in dict.fromkeys(names)] or [(None, self.spark.createDataFrame([], "src string, dst string"))]
        props: dict[str, T.DataType] = {}
        for _, df in tables:
            for name, t in self._fields(df, ("src",)).items():
                props[name] = common([props[name], t]) if name in props else t
        out = None
        for etype, df in tables:
            have = {f.name: f.dataType for f in df.schema.fields}
            cols = [F.lit(etype).cast("string").alias("etype"), F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")]
            cols += [(as_type(V(F.col(f"`{n}`").cast(normal(have[n])), normal(have[n])), t) if n in have else F.lit(None).cast(t)).alias(f"p_{n}") for n, t in props.items()]
            r = F.struct(*cols).alias("r")
            ways = [("src", "dst")] if direction == "out" else [("dst", "src")] if direction == "in" else [("src", "dst"), ("dst", "src")]
            for k, (f, t) in enumerate(ways):
                part = df if k == 0 else df.where("src != dst")  # a loop is one relationship
                part = part.select(F.col(f).alias("f"), F.col(t).alias("t"), r)
                out = part if out is None else out.unionAll(part)
        return out, props, names

    def end_labels(self, names: list[str], direction: str) -> tuple[list[str] | None, bool]:
        """Labels that the far end of such edges can have (None: any), and whether it surely exists as a node."""
        labels: set[str] = set()
        closed = bool(names)
        for n in names:
            e = self.graph.edges[n]
            ends = [e.dst_label] if direction == "out" else [e.src_label] if direction == "in" else [e.src_label, e.dst_label]
            if None in ends:
                return None, False
            labels |= set(ends)
            closed &= e.closed
        return sorted(labels), closed

    # -- patterns --------------------------------------------------------------------------------
    def match(self, df: DataFrame | None, scope: dict[str, V], m: S.Match) -> tuple[DataFrame, dict[str, V]]:
        scope = dict(scope)
        single: list[tuple[str, set, V]] = []
        todo = list(m.paths)
        while todo:  # paths that touch what is bound come first
            path = next((p for p in todo if any(n.var in scope for n in p.nodes)), todo[0])
            todo.remove(path)
            needed = self.later | _names(S.Match(todo, m.where)) if self.mode and _disjoint(m) else None
            df = self.path(df, scope, path, single, needed)
        df = self.unique(df, single)
        if m.where is not None:
            df = df.where(self.condition(m.where, scope))
            self.ops.append("Filter")
        return df, scope

    def unique(self, df: DataFrame, rels: list) -> DataFrame:
        """No two relationships of one MATCH are the same; only those are compared that could be."""
        key = lambda c: F.struct(c["etype"].alias("type"), c["src"].alias("start"), c["dst"].alias("end"))
        for (ka, ta, a), (kb, tb, b) in itertools.combinations(rels, 2):
            if ta and tb and not ta & tb:
                continue
            if ka == kb == "rel":
                df = df.where(~((a.col["etype"] == b.col["etype"]) & (a.col["src"] == b.col["src"]) & (a.col["dst"] == b.col["dst"])))
            elif ka == kb == "rels":
                df = df.where(~F.arrays_overlap(a.col, b.col))
            else:
                one, many = (a, b) if ka == "rel" else (b, a)
                df = df.where(~F.array_contains(many.col, key(one.col)))
        return df

    def path(self, df, scope, path: S.PathP, rels: list, needed: set | None) -> DataFrame:
        """needed: names that are read after this path, where rows may be compacted; None: they may not."""
        nodes = list(path.nodes)
        names = [n.var or _new("anon") for n in nodes]
        if path.shortest:
            return self.shortest(df, scope, path, names)
        start = next((k for k, n in enumerate(nodes) if n.var and n.var in scope), None)
        if start is None:
            start = next((k for k, n in enumerate(nodes) if n.props), None)
        if start is None:
            start = next((k for k, n in enumerate(nodes) if n.label), 0)
        df = self.bind_start(df, scope, nodes[start], names[start])
        found: dict[int, V] = {}
        todo = [*range(start, len(path.rels)), *range(start - 1, -1, -1)]

        def less(df: DataFrame, k: int) -> DataFrame:
            """Before a step that can lead from one node to many, rows are compacted."""
            if needed is None or path.rels[k].direction == ("out" if k >= start else "in"):
                return df
            left = todo[todo.index(k) :]
            names_left = {names[i] for j in left for i in (j, j + 1)} | {path.rels[j].var for j in left}
            return self.compact(df, scope, needed | names_left | _mentioned(path))

        for k in range(start, len(path.rels)):
            df = less(df, k)
            df, found[k] = self.expand(df, scope, names[k], path.rels[k], nodes[k + 1], names[k + 1], False, rels, path.var)
        for k in range(start - 1, -1, -1):
            df = less(df, k)
            df, found[k] = self.expand(df, scope, names[k + 1], path.rels[k], nodes[k], names[k], True, rels, path.var)
        if path.var:
            df = self.bind_path(df, scope, path, names, found)
        return df

    def bind_start(self, df, scope, n: S.NodeP, name: str) -> DataFrame:
        if name in scope:
            v = scope[name]
            if v.kind != "node":
                raise QueryError(f"{name} is no node")
            df = self.one(df)
            return self.check_node(df, scope, v, n, labelled=False)
        col = _new("n")
        nodes, v = self.scan(n.label, col)
        scope[name] = v
        nodes = self.inline(nodes, v, n.props, scope if df is None else {}, only_const=df is not None)
        if df is None:
            return nodes
        df = df.crossJoin(nodes)
        return self.inline(df, v, n.props, scope, skip_const=True)

    def inline(self, df, v: V, props: tuple, scope, only_const: bool = False, skip_const: bool = False) -> DataFrame:
        for name, e in props:
            const = isinstance(e, (S.Lit, S.Param))
            if only_const and not const or skip_const and const:
                continue
            df = df.where(compare("=", self.property(v, name), self.expr(e, scope)).col)
        return df

    def check_node(self, df, scope, v: V, n: S.NodeP, labelled: bool) -> DataFrame:
        if n.label and not labelled and v.labels != (n.label,):
            df = df.where(v.col["label"] == n.label)
        return self.inline(df, v, n.props, scope)

    def expand(self, df, scope, at: str, rel: S.RelP, to: S.NodeP, to_name: str, backward: bool, rels: list, path_var) -> tuple[DataFrame, V]:
        direction = rel.direction if not backward or rel.direction == "both" else {"out": "in", "in": "out"}[rel.direction]
        edges, props, names = self.edge_table(rel.types, direction)
        source = scope[at]
        self.ops.append(f"{'VarExpand' if rel.many else 'Expand'}({direction},{'|'.join(rel.types) or '*'})")
        far, known = scope.get(to_name), to_name in scope
        if known and far.kind != "node":
            raise QueryError(f"{to_name} is no node")
        bound, own = rel.var in scope if rel.var else False, False
        rcol, key = _new("r"), _new("k")
        if rel.many:
            if bound:
                raise QueryError("a relationship of variable length can't be bound twice")
            if rel.props:
                edges = edges.where(self._all_equal(V(F.col("r"), kind="rel", props=props), rel.props, scope))
            df = self.walk(df, source, edges, rel, rcol, key, backward)
            r = V(F.col(rcol), T.ArrayType(REL), kind="rels")
        else:
            e = edges.select(F.col("f").alias(f"{key}f"), F.col("t").alias(key), F.col("r").alias(rcol))
            r = V(F.col(rcol), kind="rel", props=props)
            on = source.col["key"] == F.col(f"{key}f")
            if known:
                on = on & (far.col["key"] == F.col(key))
            if bound:
                old = scope[rel.var]
                on = on & (old.col["etype"] == r.col["etype"]) & (old.col["src"] == r.col["src"]) & (old.col["dst"] == r.col["dst"])
            own = to_name in self.whole and not (known or bound or rel.props)
            df = df if own else df.join(e, on)  # else the far nodes meet their edges first
            if rel.props:
                df = self.inline(df, r, rel.props, scope)
        if rel.var and not bound:
            scope[rel.var] = r
        rels.append((r.kind, set(rel.types), r))
        if known:
            if rel.many:
                df = df.where(far.col["key"] == F.col(key))
            return self.check_node(df, scope, far, to, labelled=False), r
        labels, closed = self.end_labels(names, direction)
        if rel.many and labels is not None and rel.high > 1:
            closed = closed and len(labels) == 1
        if to.label:
            closed = closed and labels == [to.label]
            labels = [to.label]
        name = _new("n")
        table_props = {} if labels is None else {p for x in labels if x in self.graph.nodes for p in self._fields(self.graph.nodes[x])}
        if closed and len(labels) == 1 and not table_props and not to.props:
            # only the key is needed, and the node is known to exist: no join
            df = df.join(e, on) if own else df
            df = df.withColumn(name, F.struct(F.col(key).alias("key"), F.lit(labels[0]).alias("label")))
            v = V(F.col(name), kind="node", props={}, labels=(labels[0],))
        else:
            nodes, node_props = self.nodes(labels)
            v = V(F.col(name), kind="node", props=node_props, labels=tuple(labels) if labels and len(labels) == 1 else None)
            nodes = self.inline(nodes.withColumnRenamed("n", name), v, to.props, {}, only_const=True)
            if own:
                df = df.join(e.join(nodes, F.col(key) == v.col["key"]), on)
            else:
                df = df.join(nodes, F.col(key) == v.col["key"])
            df = self.inline(df, v, to.props, scope, skip_const=True)
        scope[to_name] = v
        return df, r

    def _all_equal(self, v: V, props: tuple, scope) -> Column:
        out = F.lit(True)
        for name, e in props:
            out = out & compare("=", self.property(v, name), self.expr(e, scope)).col
        return out

    def walk(self, df, source: V, edges: DataFrame, rel: S.RelP, rcol: str, key: str, backward: bool) -> DataFrame:
        """Walks of low to high edges without an edge twice: the edges in rcol, in the pattern's order, the end in key, and in key + 'w' the nodes passed."""
        step = F.struct(F.col("_e")["etype"].alias("type"), F.col("_e")["src"].alias("start"), F.col("_e")["dst"].alias("end"))
        e = edges.select(F.col("f").alias("_f"), F.col("t").alias("_t"), F.col("r").alias("_e"))
        rows = df.withColumns({rcol: F.array().cast(T.ArrayType(REL)), key: source.col["key"], f"{key}w": F.array(source.col["key"])})
        keep = rows.columns
        out = None
        for hop in range(1, rel.high + 1):
            rows = rows.join(e, F.col(key) == F.col("_f"))
            if hop > 1:
                rows = rows.where(~F.array_contains(rcol, step))
            join = (lambda a, b: F.concat(b, a)) if backward else (lambda a, b: F.concat(a, b))
            rows = rows.withColumns({rcol: join(F.col(rcol), F.array(step)), f"{key}w": join(F.col(f"{key}w"), F.array(F.col("_t"))), key: F.col("_t")}).select(*keep)
            if hop >= rel.low:
                out = rows if out is None else out.unionAll(rows)
        return out

    def bind_path(self, df, scope, path: S.PathP, names: list[str], found: dict[int, V]) -> DataFrame:
        one = lambda r: F.struct(r.col["etype"].alias("type"), r.col["src"].alias("start"), r.col["dst"].alias("end"))
        edges = [F.array(one(found[k])) if found[k].kind == "rel" else found[k].col for k in range(len(path.rels))]
        nodes = [F.array(scope[names[0]].col["key"])]
        for k in range(len(path.rels)):
            if found[k].kind == "rel":
                nodes.append(F.array(scope[names[k + 1]].col["key"]))
            else:  # follow the edges from the node before
                nodes.append(F.slice(F.aggregate(found[k].col, F.array(scope[names[k]].col["key"]), lambda acc, e: F.array_append(acc, F.when(F.try_element_at(acc, F.lit(-1)) == e["start"], e["end"]).otherwise(e["start"]))), F.lit(2), F.size(found[k].col)))
        rel_list = F.concat(*edges) if edges else F.array().cast(T.ArrayType(REL))
        col = _new("p")
        df = df.withColumn(col, F.struct(F.concat(*nodes).alias("nodes"), rel_list.alias("relationships"), F.size(rel_list).cast("bigint").alias("length")))
        scope[path.var] = V(F.col(col), PATH, kind="path")
        self.ops.append("BindPath")
        return df

    def shortest(self, df, scope, path: S.PathP, names: list[str]) -> DataFrame:
        """Breadth first, level by level; of equally short paths the one whose nodes sort first."""
        a, b = path.nodes
        for n, name in zip((a, b), names, strict=True):
            df = self.bind_start(df, scope, n, name)
        rel = path.rels[0]
        edges, _, _ = self.edge_table(rel.types, rel.direction)
        va, vb = scope[names[0]], scope[names[1]]
        self.ops.append("ShortestPath")
        step = F.struct(F.col("r")["etype"].alias("type"), F.col("r")["src"].alias("start"), F.col("r")["dst"].alias("end"))
        pairs = df.select(va.col["key"].alias("_a"), vb.col["key"].alias("_b")).where("_a != _b").distinct()
        front = pairs.select("_a").distinct().select("_a", F.col("_a").alias("_c"), F.array("_a").alias("_w"), F.array().cast(T.ArrayType(REL)).alias("_r"))
        seen = front.select("_a", "_c")
        # each level is written: the next ones use it twice, and its rows tell when to stop
        ship(self.spark)
        scratch = Scratch()
        pairs = scratch(pairs, "path-pairs")
        found = None
        for hop in range(1, rel.high + 1):
            front = front.join(edges.select("f", "t", "r"), F.col("_c") == F.col("f")).select("_a", F.col("t").alias("_c"), F.concat("_w", F.array("t")).alias("_w"), F.concat("_r", F.array(step)).alias("_r"))
            front = front.groupBy("_a", "_c").agg(F.min(F.struct("_w", "_r")).alias("m")).select("_a", "_c", "m._w", "m._r")
            front = scratch(front.join(seen, ["_a", "_c"], "left_anti"), "path-level")
            here = front.join(pairs, (front["_c"] == pairs["_b"]) & (front["_a"] == pairs["_a"]), "left_semi")
            found = here if found is None else found.unionAll(here)
            # a start is done when all of its ends are reached
            left = pairs.join(found.select(F.col("_a"), F.col("_c").alias("_b")), ["_a", "_b"], "left_anti").select("_a").distinct()
            if hop == rel.high or front.isEmpty() or left.isEmpty():
                break
            seen = seen.unionAll(front.select("_a", "_c"))
            front = front.join(left, "_a", "left_semi")
        rcol, pcol = _new("r"), _new("p")
        f = found.select(F.col("_a").alias("_sa"), F.col("_c").alias("_sb"), F.col("_r").alias(rcol), F.struct(F.col("_w").alias("nodes"), F.col("_r").alias("relationships"), F.size("_r").cast("bigint").alias("length")).alias(pcol))
        df = df.join(f, (va.col["key"] == F.col("_sa")) & (vb.col["key"] == F.col("_sb"))).drop("_sa", "_sb")
        if path.var:
            scope[path.var] = V(F.col(pcol), PATH, kind="path")
        if rel.var:
            scope[rel.var] = V(F.col(rcol), T.ArrayType(REL), kind="rels")
        return df

    def optional(self, df, scope, m: S.Match, follow) -> tuple[DataFrame, dict[str, V]]:
        """A left outer apply: the pattern from the distinct values of what it shares with the rows, joined back to them."""
        self.ops.append("LeftOuterApply")
        outer = self.one(df)
        used = _names(m)
        shared = {n: v for n, v in scope.items() if n in used}
        seeds_scope, renames, on = {}, [], []
        for n, v in shared.items():
            name = _new("s")
            renames.append(v.col.alias(name))
            seeds_scope[n] = V(F.col(name), v.type, v.kind, v.props, v.labels)
            mine, theirs = v.col, F.col(name)
            on.append(mine["key"] == theirs["key"] if v.kind == "node" else mine.eqNullSafe(theirs))
        seeds = outer.select(*renames).distinct() if renames else None
        for n, v in seeds_scope.items():
            if v.kind == "node" and any(p.var == n for path in m.paths for p in path.nodes):
                seeds = seeds.where(v.col.isNotNull())
        inner, inner_scope = self.match(seeds, seeds_scope, S.Match(m.paths, m.where))
        new = {n: v for n, v in inner_scope.items() if n not in scope and not n.startswith("_anon")}
        cond = None
        for c in on:
            cond = c if cond is None else cond & c
        if new and cond is not None and _asks_absent(follow, set(new)):
            self.ops.append("AntiJoin")
            out = outer.join(inner.select(*[v.col for v in seeds_scope.values()]), cond, "left_anti")
            scope = dict(scope)
            for n, v in new.items():
                name = _new("o")
                out = out.withColumn(name, F.lit(None).cast(inner.select(v.col.alias("x")).schema["x"].dataType))
                scope[n] = V(F.col(name), v.type, v.kind, v.props, v.labels)
            return out, scope
        names = {n: _new("o") for n in new}
        right = inner.select(*[v.col for v in seeds_scope.values()], *[v.col.alias(names[n]) for n, v in new.items()])
        out = outer.join(right, cond if cond is not None else F.lit(True), "left")
        return out, dict(scope) | {n: V(F.col(names[n]), v.type, v.kind, v.props, v.labels) for n, v in new.items()}

    # -- other clauses ---------------------------------------------------------------------------
    def unwind(self, df, scope, c: S.Unwind) -> tuple[DataFrame, dict[str, V]]:
        self.ops.append("Unwind")
        v = self.expr(c.source, scope)
        df = self.one(df)
        name = _new("u")
        if is_null(v.type):
            return df.where(F.lit(False)).withColumn(name, F.lit(None).cast("string")), scope | {c.var: V(F.col(name), T.StringType())}
        if v.kind == "rels":
            v = V(v.col, T.ArrayType(REL))
        if not is_list(v.type):
            raise QueryError("UNWIND takes a list")
        element = T.StringType() if is_null(v.type.elementType) else v.type.elementType
        return df.select("*", F.explode(v.col.cast(T.ArrayType(element)) if is_null(v.type.elementType) else v.col).alias(name)), scope | {c.var: V(F.col(name), element)}

    def items(self, p: S.Project, scope) -> list[S.Item]:
        items = [S.Item(S.Var(n), n) for n in sorted(scope) if not n.startswith("_anon")] if p.star else []
        items += p.items
        names = [i.alias for i in items]
        if len(set(names)) < len(names):
            raise QueryError("a column is returned twice")
        return items

    def project(self, df, scope, p: S.Project) -> tuple[DataFrame, dict[str, V], list[str]]:
        """The rows of a WITH or RETURN: one internal column for each item."""
        df = self.one(df)
        items = self.items(p, scope)
        if not items:
            raise QueryError("nothing to return")
        aggregated = any(S.has_aggregate(i.expr) for i in items)
        if aggregated:
            if p.distinct:
                raise QueryError("RETURN DISTINCT with an aggregate is not supported")
            df, out = self.aggregate(df, scope, items)
        else:
            out, cols = {}, {}
            for i in items:
                v = self.expr(i.expr, scope)
                name = _new("c")
                cols[name] = v.col if not is_null(v.type) or v.kind != "value" else v.col.cast("string")
                out[i.alias] = V(F.col(name), v.type if not (is_null(v.type) and v.kind == "value") else T.StringType(), v.kind, v.props, v.labels)
            df = df.withColumns(cols)
            self.ops.append("Project")
        if p.distinct:
            df = df.select(*[entity(v).col.alias(n) if v.kind == "never" else v.col for n, v in out.items()]).distinct()
            self.ops.append("Distinct")
        if p.order:
            visible = out if aggregated or p.distinct else scope | out
            keys: list[Column] = []
            for e, down in p.order:
                same = next((out[i.alias] for i in items if i.expr == e), None)
                keys += sort_keys(same if same is not None else self.expr(e, visible), down)
            df = df.orderBy(*keys)
            self.ops.append("OrderBy")
        if p.skip is not None:
            df = df.offset(self.count_of(p.skip))
            self.ops.append("Skip")
        if p.limit is not None:
            df = df.limit(self.count_of(p.limit))
            self.ops.append("Limit")
        if p.where is not None:
            df = df.where(self.condition(p.where, (out if aggregated else scope | out)))
            self.ops.append("Filter")
        return df, out, [i.alias for i in items]

    def returned(self, df, scope, p: S.Project) -> tuple[DataFrame, list[str]]:
        df, out, names = self.project(df, scope, p)
        return df.select(*[entity(out[n]).col.alias(n) for n in names]), names

    def count_of(self, e) -> int:
        v = self.expr(e, {})
        if not v.is_const or not isinstance(v.const, int) or v.const < 0:
            raise QueryError("SKIP and LIMIT take a whole number")
        return v.const

    def aggregate(self, df, scope, items: list[S.Item]) -> tuple[DataFrame, dict[str, V]]:
        keys, aggs, out, pre = [], [], {}, {}
        times = F.col("_mult") if df is not None and "_mult" in df.columns else None
        for i in items:
            e = i.expr
            if isinstance(e, S.Call) and e.name in S.AGGREGATES:
                name = _new("g")
                col, t = self.aggregate_column(e, scope, pre, times)
                aggs.append(col.alias(name))
                out[i.alias] = V(F.col(name), t)
            elif S.has_aggregate(e):
                raise QueryError("an aggregate stands alone; use WITH to compute with it")
            else:
                v = self.expr(e, scope)
                name = _new("k")
                pre[name] = v.col if not (is_null(v.type) and v.kind == "value") else v.col.cast("string")
                keys.append(name)
                out[i.alias] = V(F.col(name), v.type, v.kind, v.props, v.labels)
        df = df.withColumns(pre) if pre else df
        self.ops.append("GroupAggregate" if keys else "Aggregate")
        return (df.groupBy(*keys) if keys else df).agg(*aggs), out

    def aggregate_column(self, e: S.Call, scope, pre: dict, times: Column | None = None) -> tuple[Column, T.DataType]:
        if e.name == "count" and not e.args:
            return F.count(F.lit(1)) if times is None else F.coalesce(F.sum(times), F.lit(0)).cast("bigint"), T.LongType()
        if len(e.args) != (2 if e.name.startswith("percentile") else 1):
            raise QueryError(f"{e.text or e.name}() takes {'two arguments' if e.name.startswith('percentile') else 'one argument'}")
        raw = self.expr(e.args[0], scope)
        v = entity(raw)
        if e.name == "count" and raw.kind == "rel":
            v = V(F.when(raw.col.isNotNull(), F.struct(raw.col["etype"], raw.col["src"], raw.col["dst"])), REL)
        name = _new("a")
        numeric = e.name in ("sum", "avg", "stdev", "stdevp") or e.name.startswith("percentile")
        if numeric and not is_num(v.type):
            if e.name.startswith("std") and not is_null(v.type):
                raise QueryError(f"{e.text}() takes numbers")
            v = V(F.lit(None).cast("bigint"), T.LongType())
        if is_null(v.type):
            v = V(v.col.cast("string"), T.StringType())
        pre[name] = v.col
        c, distinct = F.col(name), "DISTINCT " if e.distinct else ""
        if e.name == "count" and times is not None and not e.distinct:
            return F.coalesce(F.sum(F.when(c.isNotNull(), times)), F.lit(0)).cast("bigint"), T.LongType()
        if e.name == "count":
            return (F.count_distinct(c) if e.distinct else F.count(c)), T.LongType()
        if e.name == "sum":
            zero = F.lit(0).cast("bigint") if is_int(v.type) else F.lit(0.0)
            return F.coalesce(F.sum_distinct(c) if e.distinct else F.sum(c), zero), T.LongType() if is_int(v.type) else T.DoubleType()
        if e.name == "collect":
            return F.collect_set(c) if e.distinct else F.collect_list(c), T.ArrayType(v.type)
        if e.name in ("min", "max"):
            return getattr(F, e.name)(c), v.type
        if e.name == "avg":
            return F.expr(f"avg({distinct}cast({name} as double))"), T.DoubleType()
        if e.name in ("stdev", "stdevp"):
            f = "stddev_samp" if e.name == "stdev" else "stddev_pop"
            return F.coalesce(F.expr(f"{f}({distinct}cast({name} as double))"), F.lit(0.0)), T.DoubleType()
        at = self.expr(e.args[1], scope)
        if not at.is_const or not isinstance(at.const, (int, float)) or not 0 <= at.const <= 1:
            raise QueryError("a percentile lies between 0 and 1")
        if e.name == "percentilecont":
            return F.expr(f"percentile({distinct}{name}, {float(at.const)!r}D)").cast("double"), T.DoubleType()
        return F.expr(f"percentile_disc({float(at.const)!r}D) WITHIN GROUP (ORDER BY {name})").cast(v.type), v.type

    # -- expressions -----------------------------------------------------------------------------
    def condition(self, e, scope) -> Column:
        return truth(self.expr(e, scope))

    def property(self, v: V, name: str) -> V:
        if v.kind == "node":
            if name in v.props:
                own = V(v.col[f"p_{name}"], v.props[name])
                if name in ("key", "id"):
                    return V(F.coalesce(own.col.cast("string"), v.col["key"]), T.StringType()) if not isinstance(own.type, T.StringType) else V(F.coalesce(own.col, v.col["key"]), T.StringType())
                return own
            if name in ("key", "id"):
                return V(v.col["key"], T.StringType())
            return V(v.col["label"], T.StringType()) if name == "label" else NULL
        if v.kind == "rel":
            return V(v.col[f"p_{name}"], v.props[name]) if name in v.props else NULL
        if v.kind in ("rels", "path"):
            return scalar.call("length", [v]) if name == "length" else NULL
        if isinstance(v.type, T.StructType) and is_map(v.type):
            return V(v.col[name], v.type[name].dataType) if name in v.type.fieldNames() else NULL
        if isinstance(v.type, T.MapType):
            return V(F.try_element_at(v.col, F.lit(name)), v.type.valueType)
        return NULL

    def expr(self, e: Any, scope: dict[str, V]) -> V:
        if isinstance(e, S.Lit):
            return lit(e.value)
        if isinstance(e, S.Param):
            if e.name not in self.params:
                raise QueryError(f"no parameter ${e.name}")
            return lit(self.params[e.name])
        if isinstance(e, S.Var):
            if e.name not in scope:
                raise QueryError(f"no variable {e.name}")
            return scope[e.name]
        if isinstance(e, S.Prop):
            return self.const_item(e, scope, e.name) or self.property(self.expr(e.of, scope), e.name)
        if isinstance(e, S.Index):
            return self.index(e, scope)
        if isinstance(e, S.ListOf):
            items = [self.expr(x, scope) for x in e.items]
            out = list_of([entity(x) for x in items])
            if all(x.is_const for x in items):
                out.const, out.is_const = [x.const for x in items], True
            return out
        if isinstance(e, S.MapOf):
            items = {k: self.expr(x, scope) for k, x in e.items}
            out = map_of(items)
            if all(x.is_const for x in items.values()):
                out.const, out.is_const = {k: x.const for k, x in items.items()}, True
            return out
        if isinstance(e, S.HasLabel):
            v = self.expr(e.of, scope)
            if v.kind not in ("node", "rel"):
                raise QueryError("only nodes and relationships have labels")
            return V(v.col["label" if v.kind == "node" else "etype"] == e.label, T.BooleanType())
        if isinstance(e, S.Case):
            values = [entity(self.expr(x, scope)) for _, x in e.whens] + [entity(self.expr(e.other, scope))]
            t = common([v.type for v in values])
            out = None
            for (c, _), v in zip(e.whens, values, strict=False):
                test = self.condition(c, scope)
                out = F.when(test, as_type(v, t)) if out is None else out.when(test, as_type(v, t))
            return V(out.otherwise(as_type(values[-1], t)), t)
        if isinstance(e, S.Comprehension):
            return self.comprehension(e, scope)
        if isinstance(e, S.Quantifier):
            return self.quantifier(e, scope)
        if isinstance(e, S.Reduce):
            source = self.list_source(e.source, scope)
            init = entity(self.expr(e.init, scope))
            body = lambda acc, t, x: self.expr(e.value, scope | {e.acc: V(acc, t), e.var: V(x, source.type.elementType)})
            t = common([init.type, body(F.lit(None).cast(init.type) if not is_null(init.type) else F.lit(None), init.type, F.lit(None).cast(source.type.elementType)).type])
            return V(F.aggregate(source.col, as_type(init, t), lambda acc, x: as_type(body(acc, t, x), t)), t)
        if isinstance(e, S.Call):
            if e.name in S.AGGREGATES:
                raise QueryError(f"{e.text or e.name}() stands alone in WITH or RETURN")
            return scalar.call(e.name, [self.expr(a, scope) for a in e.args])
        if isinstance(e, S.Op):
            return self.operation(e, scope)
        raise QueryError(f"not an expression: {e!r}")

    def const_item(self, e, scope, name) -> V | None:
        """$p.f and $p['f'] as the constants they are."""
        if isinstance(e.of, S.Param):
            v = self.expr(e.of, scope)
            if isinstance(v.const, dict):
                return lit(v.const.get(name))
        return None

    def index(self, e: S.Index, scope) -> V:
        at = self.expr(e.at, scope)
        if isinstance(at.const, str) and (found := self.const_item(e, scope, at.const)):
            return found
        v = self.expr(e.of, scope)
        if isinstance(at.const, str):
            return self.property(v, at.const)
        if v.kind == "rels":
            v = V(v.col, T.ArrayType(REL))
        if is_list(v.type) and is_int(at.type):
            i = at.col.cast("int")
            return V(F.when(i >= 0, F.get(v.col, i)).when(i < 0, F.try_element_at(v.col, i)), v.type.elementType)
        if isinstance(v.type, T.MapType):
            return V(F.try_element_at(v.col, at.col), v.type.valueType)
        return NULL

    def list_source(self, e, scope) -> V:
        v = self.expr(e, scope)
        if v.kind == "rels":
            v = V(v.col, T.ArrayType(REL))
        if is_null(v.type):
            return V(F.lit(None).cast("array<string>"), T.ArrayType(T.StringType()))
        if not is_list(v.type):
            raise QueryError("a list is needed here")
        if is_null(v.type.elementType):
            return V(v.col.cast("array<string>"), T.ArrayType(T.StringType()))
        return v

    def comprehension(self, e: S.Comprehension, scope) -> V:
        source = self.list_source(e.source, scope)
        inner = lambda x: scope | {e.var: V(x, source.type.elementType)}
        col = source.col
        if e.where is not None:
            col = F.filter(col, lambda x: self.condition(e.where, inner(x)))
        if e.value is None:
            return V(col, source.type)
        t = entity(self.expr(e.value, inner(F.lit(None).cast(source.type.elementType)))).type
        return V(F.transform(col, lambda x: entity(self.expr(e.value, inner(x))).col), T.ArrayType(t))

    def quantifier(self, e: S.Quantifier, scope) -> V:
        source = self.list_source(e.source, scope)
        test = lambda x: self.condition(e.where, scope | {e.var: V(x, source.type.elementType)})
        if e.kind == "all":
            return V(F.forall(source.col, test), T.BooleanType())
        if e.kind in ("any", "none"):
            found = F.exists(source.col, test)
            return V(found if e.kind == "any" else ~found, T.BooleanType())
        counts = F.aggregate(source.col, F.struct(F.lit(0).alias("yes"), F.lit(0).alias("unknown")), lambda acc, x: F.struct((acc["yes"] + F.when(test(x), 1).otherwise(0)).alias("yes"), (acc["unknown"] + F.when(test(x).isNull(), 1).otherwise(0)).alias("unknown")))
        return V(F.when(counts["yes"] > 1, F.lit(False)).when(counts["unknown"] > 0, F.lit(None).cast("boolean")).otherwise(counts["yes"] == 1), T.BooleanType())

    def operation(self, e: S.Op, scope) -> V:
        op, args = e.op, e.args
        if op in ("and", "or", "xor"):
            a, b = (self.condition(x, scope) for x in args)
            return V(a & b if op == "and" else a | b if op == "or" else a != b, T.BooleanType())
        if op == "not":
            return V(~self.condition(args[0], scope), T.BooleanType())
        vs = [self.expr(x, scope) for x in args]
        if op in ("is null", "is not null"):
            c = entity(vs[0]).col
            return V(c.isNull() if op == "is null" else c.isNotNull(), T.BooleanType())
        if op == "in":
            if not is_list(vs[1].type) and not is_null(vs[1].type):
                raise QueryError("IN takes a list")
            return member(*vs)
        if op in ("starts with", "ends with", "contains"):
            out = scalar.call(op.replace(" ", "").replace("swith", "swith"), vs)
            return out if is_bool(out.type) else V(F.lit(None).cast("boolean"), T.BooleanType())
        if op in ("=", "<>", "<", "<=", ">", ">="):
            return compare(op, *vs)
        if op == "neg":
            v = entity(vs[0])
            return arithmetic("-", lit(0), v) if is_int(v.type) else V(-v.col, v.type) if is_num(v.type) else NULL
        return arithmetic(op, *vs)


def _expressions(q: S.Query):
    for part in q.parts:
        for c in part:
            if isinstance(c, S.Match):
                yield from [c.where] if c.where is not None else []
            elif isinstance(c, S.Unwind):
                yield c.source
            elif isinstance(c, S.Project):
                yield from (i.expr for i in c.items)
                yield from (e for e, _ in c.order)
                yield from [c.where] if c.where is not None else []
            elif isinstance(c, S.Write):
                yield from c.names
                yield from (x for t, _, e in c.sets + c.on_create + c.on_match for x in (t, e))
    for p in _patterns(q):
        for n in (*p.nodes, *p.rels):
            yield from (e for _, e in n.props)


def _patterns(q: S.Query):
    for part in q.parts:
        for c in part:
            if isinstance(c, (S.Match, S.Write)):
                yield from c.paths


def _names(m: S.Match) -> set[str]:
    """All variables that a MATCH mentions."""
    out = set()
    exprs = [m.where] if m.where is not None else []
    for p in m.paths:
        for n in (*p.nodes, *p.rels):
            out |= {n.var} - {None}
            exprs += [e for _, e in n.props]
    return out | {x.name for e in exprs for x in S.walk(e) if isinstance(x, S.Var)}


def _mentioned(p: S.PathP) -> set[str]:
    """Variables in the property values of a pattern."""
    return {x.name for n in (*p.nodes, *p.rels) for _, e in n.props for x in S.walk(e) if isinstance(x, S.Var)}


def _disjoint(m: S.Match) -> bool:
    """Whether no two relationships of a MATCH could be the same one, and none is part of a path that is kept."""
    rels = [r for p in m.paths for r in p.rels]
    types = [t for r in rels for t in set(r.types)]
    return all(r.types and not r.many for r in rels) and len(set(types)) == len(types) and not any(p.var or p.shortest for p in m.paths)


def _use_of_rows(after: list) -> tuple[str | None, set[str]]:
    """How the clauses after a MATCH use how often a row stands, and the variables that they mention.

    set: not at all (DISTINCT, or writing that is the same for equal rows); bag: as a number (counts, least and greatest).
    """
    names: set[str] = set()
    say = lambda e: {x.name for x in S.walk(e) if isinstance(x, S.Var)}
    for k, c in enumerate(after):
        if isinstance(c, S.Match) and not c.optional and not any(p.shortest for p in c.paths):
            names |= _names(c) | {p.var for p in c.paths}
        elif isinstance(c, S.Project) and not c.star:
            for e in [i.expr for i in c.items] + [e for e, _ in c.order] + ([c.where] if c.where is not None else []):
                names |= say(e)
            calls = [x for i in c.items for x in S.walk(i.expr) if isinstance(x, S.Call) and x.name in S.AGGREGATES]
            if not calls:
                return ("set" if c.distinct else None), names
            return ("bag" if all(x.name in ("count", "min", "max") for x in calls) else None), names
        elif isinstance(c, S.Write) and all(isinstance(x, S.Write) and x.kind != "create" for x in after[k:]):
            for x in after[k:]:
                names |= _names(S.Match(x.paths))
                names |= {e for e in x.names if isinstance(e, str)}
                for e in [*(e for e in x.names if not isinstance(e, str)), *(e for t, _, v in x.sets + x.on_create + x.on_match for e in (t, v))]:
                    names |= say(e)
            return "set", names
        else:
            break
    return None, set()


def _folded(clauses: list, whole: set[str]) -> list:
    """A MATCH of one node alone is read where the next MATCH leads to it from what is bound, so that no cross product arises; whole: such nodes."""
    out: list = []
    for c in clauses:
        if out and all(isinstance(x, S.Match) and not x.optional for x in (*out, c)) and out[-1].where is None and len(out[-1].paths) == 1:
            lone, bound = out[-1].paths[0], set().union(*map(_names, out[:-1]))
            n = lone.nodes[0]
            same = lambda x: n.var is not None and x.var == n.var  # noqa: B023, E731
            leads = [k for k, p in enumerate(c.paths) if not p.shortest and any(map(same, p.nodes)) and any(x.var in bound for x in p.nodes)]
            if leads and not (lone.rels or lone.var or n.var in bound) and all(x.label in (None, n.label) for p in c.paths for x in p.nodes if same(x)):
                k = leads[0]
                nodes = tuple(replace(x, label=n.label, props=(*n.props, *x.props)) if same(x) else x for x in c.paths[k].nodes)
                whole.add(n.var)
                out[-1] = S.Match([replace(p, nodes=nodes) if i == k else p for i, p in enumerate(c.paths)], c.where)
                continue
        out.append(c)
    return out


def _asks_absent(follow, new: set[str]) -> bool:
    """Whether the next clause keeps only rows without the new variables: WITH ... WHERE b IS NULL."""
    if not isinstance(follow, S.Project) or follow.where is None or any(S.has_aggregate(i.expr) for i in follow.items):
        return False
    if follow.skip is not None or follow.limit is not None:
        return False
    parts = [follow.where]
    while any(isinstance(p, S.Op) and p.op == "and" for p in parts):
        parts = [y for p in parts for y in (p.args if isinstance(p, S.Op) and p.op == "and" else [p])]
    names = {i.alias: i.expr for i in follow.items}
    for p in parts:
        if isinstance(p, S.Op) and p.op == "is null" and isinstance(p.args[0], S.Var):
            name = p.args[0].name
            e = names.get(name, p.args[0])
            if isinstance(e, S.Var) and e.name in new:
                return True
    return False



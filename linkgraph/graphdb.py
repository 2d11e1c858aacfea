"""A handle on one graph that changes: the calls of an embedded graph database over the functions of this package.

The handle holds an immutable PropertyGraph, rules and declarations, and puts a new graph in its place
at each write, so that what was read before stays as it was. Sets of rows come back as DataFrames,
single facts as plain values. Derived edges are made from the rules when they are read. Each write adds
to the plan of the tables it touches; many rows go in by ingest_batch, batch_edges or set_props_many,
and `compact` writes what has piled up. A transaction works on a copy, and takes effect only if nothing
else was written since it began.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from collections.abc import Iterable, Sequence
from contextlib import contextmanager
from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .model import PropertyGraph
from .operators import access, algo, catalog, history, rules, search, traverse, writes
from .operators.rules import RuleDef, RuleError
from .sources import files
from .storage import materialize

PROVISIONAL_MOST = 20
#: Derived edges of all rules together, unless the handle is opened with another budget.
EDGE_BUDGET = 50_000_000
_PREDICATES = {c.__name__: c for c in (rules.KeyMatch, rules.FieldEqual, rules.Overlap, rules.NumericWithin, rules.GeoRadius, rules.VectorSimilar)}


class KeyNotFound(KeyError):
    pass


class DuplicateKey(catalog.ConstraintError):
    pass


class RuleOwned(ValueError):
    pass


class Conflict(history.Conflict):
    pass


class Denied(PermissionError):
    pass


def predicate_of(spec: dict) -> rules.Predicate:
    """A predicate from {"kind": ..., fields}, All and Any with "parts"."""
    kind = spec["kind"]
    if kind in ("All", "Any"):
        return {"All": rules.All, "Any": rules.Any}[kind](tuple(predicate_of(x) for x in spec["parts"]))
    if kind not in _PREDICATES:
        raise RuleError(f"no predicate {kind}")
    return _PREDICATES[kind](**{k: v for k, v in spec.items() if k != "kind"})


def spec_of(p: rules.Predicate) -> dict:
    if isinstance(p, (rules.All, rules.Any)):
        return {"kind": type(p).__name__, "parts": [spec_of(x) for x in p.parts]}
    return {"kind": type(p).__name__, **asdict(p)}


def rule_of(spec: dict) -> RuleDef:
    return RuleDef(**{**spec, "predicate": predicate_of(spec["predicate"])}).validate()


class GraphDb:
    def __init__(self, graph: PropertyGraph, rule_defs: Iterable[RuleDef] = (), read_only: bool = False, log: history.CommitLog | None = None, edge_budget: int = EDGE_BUDGET) -> None:
        self.base, self._rules, self.read_only, self.log, self.edge_budget = graph, {r.name: r for r in rule_defs}, read_only, log, edge_budget
        self.version, self.role, self._fulltext, self._tripped = 0, None, set(), set()

    # -- opening, copies
    @staticmethod
    def open(spark: SparkSession, path: str, read_only: bool = False) -> GraphDb:
        """The graph that snapshot wrote at the path, with its rules."""
        about = json.loads(spark.read.text(f"{path}/about", wholetext=True).first()[0])
        g = files.read_parquet(spark, path, about["labels"], {t: tuple(ends) for t, ends in about["edges"].items()})
        db = GraphDb(g, [rule_of(r) for r in about["rules"]], read_only)
        db._fulltext = {tuple(x) for x in about["fulltext"]}
        return db

    def snapshot(self, path: str) -> None:
        """Nodes and edges as Parquet, and the rules, declarations and ends of edge types beside them."""
        files.write_parquet(self.base, path)
        about = {"labels": sorted(self.base.nodes), "edges": {t: [e.src_label, e.dst_label] for t, e in self.base.edges.items()}, "rules": self.rules(), "fulltext": sorted(self._fulltext)}
        self.spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @staticmethod
    def restore(spark: SparkSession, src: str, dst: str) -> dict:
        db = GraphDb.open(spark, src)
        db.snapshot(dst)
        return {"nodes": db.base.all_nodes().count(), "edges": db.base.all_edges().count()}

    def scoped(self, role: access.Role | None = None, namespace: str | None = None, keys: Sequence[str] | None = None) -> GraphDb:
        """A handle that only reads, and sees a part: what a role may see, a namespace, some keys."""
        return GraphDb(access.scoped(self.graph, role, namespace, list(keys) if keys is not None else None), read_only=True)

    @contextmanager
    def writing_as(self, role: access.Role):
        """Within the block only labels that the role may write are written; edges need a role without such a limit."""
        before, self.role = self.role, role
        try:
            yield self
        finally:
            self.role = before

    def compact(self) -> None:
        """Writes all tables to the shared folder, so that plans start afresh."""
        g = self.base
        nodes = {k: materialize(v, "nodes") for k, v in g.nodes.items()}
        self.base = replace(g, nodes=nodes, edges={t: replace(e, df=materialize(e.df, "edges")) for t, e in g.edges.items()})

    @property
    def spark(self) -> SparkSession:
        return self.base.spark

    @property
    def graph(self) -> PropertyGraph:
        """The graph with the edges of its rules."""
        live = [r for r in self._rules.values() if r.name not in self._tripped]
        return rules.derive(self.base, live) if live else self.base

    def _put(self, g: PropertyGraph, *labels: str | None) -> None:
        if self.read_only:
            raise Denied("this handle only reads")
        if self.role is not None:
            for label in labels or (None,):
                access.check_write(self.role, label)
        self.base, self.version = g, self.version + 1

    def close(self) -> None:
        self.read_only = True

    def __enter__(self) -> GraphDb:
        return self

    def __exit__(self, *_) -> bool:
        self.close()
        return False

    # -- transactions
    @contextmanager
    def transaction(self):
        """A copy to write to. What it wrote takes effect at the end, all of it, unless the block fails or the handle changed meanwhile."""
        tx = GraphDb(self.base, self._rules.values(), self.read_only, self.log, self.edge_budget)
        tx.role, tx._fulltext, began = self.role, set(self._fulltext), self.version
        yield tx
        if not tx.version and tx._rules == self._rules:
            return
        if self.version != began:
            raise Conflict(f"version {self.version} came after {began}")
        if self.read_only:
            raise Denied("this handle only reads")
        self.base, self._rules, self._fulltext, self.version = tx.base, tx._rules, tx._fulltext, began + 1

    # -- nodes and edges
    def label_of(self, key: str) -> str | None:
        row = self.base.all_nodes().where(F.col("key") == key).first()
        return row["label"] if row else None

    def _found(self, key: str) -> str:
        label = self.label_of(key)
        if label is None:
            raise KeyNotFound(key)
        return label

    def _rows(self, label: str, rows: Sequence[tuple[str, dict]]) -> DataFrame:
        """key and properties of new nodes, typed as the label's columns where it has them."""
        have = {f.name: f.dataType for f in self.base.nodes[label].schema.fields} if label in self.base.nodes else {}
        names = list(dict.fromkeys(k for _, p in rows for k in p))

        def kind(name: str) -> T.DataType:
            v = next((p[name] for _, p in rows if p.get(name) is not None), None)
            return have.get(name) or (T.StringType() if v is None else T._infer_type(v))

        schema = T.StructType([T.StructField("key", T.StringType())] + [T.StructField(n, kind(n)) for n in names])
        return self.spark.createDataFrame([(k, *(p.get(n) for n in names)) for k, p in rows], schema)

    def insert_node(self, label: str, key: str, props: dict, namespace: str | None = None) -> None:
        if self.label_of(key) is not None:
            raise DuplicateKey(key)
        props = {**props, **({"ns": namespace} if namespace is not None else {})}
        self._put(writes.ingest_batch(self.base, label, self._rows(label, [(key, props)]), "skip"), label)

    def upsert_node(self, label: str, key: str, props: dict) -> str:
        """inserted or updated; an update sets the properties given and leaves the others."""
        if self.label_of(key) is None:
            self.insert_node(label, key, props)
            return "inserted"
        self.set_props_many([(key, props)])
        return "updated"

    def set_props_many(self, rows: Sequence[tuple[str, dict]]) -> dict[str, int]:
        """Sets properties of many nodes, None removes one; one pass over each label concerned."""
        labels = {r["key"]: r["label"] for r in self.base.all_nodes().where(F.col("key").isin([k for k, _ in rows])).collect()}  # as many as rows
        if missing := [k for k, _ in rows if k not in labels]:
            raise KeyNotFound(missing[0])
        g, n = self.base, 0
        for label in sorted(set(labels.values())):
            mine = [(k, p) for k, p in rows if labels[k] == label]
            values = self._rows(label, mine)
            names = [c for c in values.columns if c != "key"]
            given = self.spark.createDataFrame([(k, sorted(p)) for k, p in mine], "_k string, _given array<string>")
            new = values.select(F.col("key").alias("_k"), *[F.col(f"`{c}`").alias(f"_v_{c}") for c in names]).join(given, "_k")
            df = g.nodes[label]
            out = df.join(F.broadcast(new), df["key"] == new["_k"], "left")
            cols = [F.when(F.array_contains("_given", c), F.col(f"`_v_{c}`")).otherwise(F.col(f"`{c}`") if c in df.columns else F.lit(None)).alias(c) if c in names else F.col(f"`{c}`") for c in [*df.columns, *[x for x in names if x not in df.columns]]]
            g, n = g.with_nodes(label, out.select(*cols)), n + sum(len(p) for _, p in mine)
        self._put(g, *set(labels.values()))
        return {"nodes": len(labels), "properties": n}

    def set_prop(self, key: str, field: str, value) -> None:
        self.set_props_many([(key, {field: value})])

    def remove_prop(self, key: str, field: str) -> bool:
        df = self.base.nodes[self._found(key)]
        had = field in df.columns and df.where((F.col("key") == key) & F.col(f"`{field}`").isNotNull()).limit(1).count() > 0
        if had:
            self.set_prop(key, field, None)
        return had

    def rename_node(self, old: str, new: str) -> None:
        label = self._found(old)
        self._put(writes.rename_node(self.base, label, old, new), label)

    def delete_node(self, key: str) -> dict[str, int]:
        """Removes a node and its edges; how many of them were written by hand and how many derived."""
        label = self._found(key)
        at = (F.col("src") == key) | (F.col("dst") == key)
        made = self.graph.all_edges().where(at).count()
        manual = self.base.all_edges().where(at).count()
        g = self.base
        edges = {t: replace(e, df=e.df.where(~at)) for t, e in g.edges.items()}
        self._put(replace(g, edges=edges, nodes=g.nodes | {label: g.nodes[label].where(F.col("key") != key)}), label)
        return {"manual_edges": manual, "derived_edges": made - manual}

    def batch_edges(self, inserts: Sequence[dict] | None = None, deletes: Sequence[dict] | None = None) -> dict[str, int]:
        """Inserts and deletes of edges {edge_type, src, dst} in one step; an edge that is there is no new one, ends must exist."""
        g, done = self.base, {"edges_inserted": 0, "edges_deleted": 0}
        schema = "edge_type string, src string, dst string"
        rows = {k: self.spark.createDataFrame([(x["edge_type"], x["src"], x["dst"]) for x in v or []], schema).distinct() for k, v in (("in", inserts), ("out", deletes))}
        ends = rows["in"].select(F.explode(F.array("src", "dst")).alias("key")).distinct()
        if (lost := ends.join(g.all_nodes().select("key"), "key", "left_anti").orderBy("key").first()) is not None:
            raise KeyNotFound(lost["key"])
        for etype in sorted({x["edge_type"] for x in [*(inserts or []), *(deletes or [])]}):
            e = g.edges.get(etype)
            old = e.df if e is not None else self.spark.createDataFrame([], "src string, dst string")
            gone, new = (rows[k].where(F.col("edge_type") == etype).select("src", "dst") for k in ("out", "in"))
            new = new.join(old.select("src", "dst"), ["src", "dst"], "left_anti")
            done["edges_deleted"] += old.join(gone, ["src", "dst"], "left_semi").count()
            done["edges_inserted"] += new.count()
            df = old.unionByName(new, allowMissingColumns=True).join(gone, ["src", "dst"], "left_anti")
            g = g.with_edges(etype, df, unique=True)
        self._put(g)
        return done

    def insert_edge(self, edge_type: str, src: str, dst: str) -> bool:
        return self.batch_edges([{"edge_type": edge_type, "src": src, "dst": dst}])["edges_inserted"] > 0

    def insert_edge_upsert(self, edge_type: str, src: str, dst: str, placeholder_label: str) -> dict:
        """Inserts an edge; ends that don't exist become bare nodes of the label."""
        new = [k for k in dict.fromkeys((src, dst)) if self.label_of(k) is None]
        for k in new:
            self.insert_node(placeholder_label, k, {})
        return {"nodes_created": len(new), "edge_inserted": self.insert_edge(edge_type, src, dst)}

    def delete_edge(self, edge_type: str, src: str, dst: str) -> bool:
        at = (F.col("src") == src) & (F.col("dst") == dst)
        if edge_type in self.base.edges and self.base.edges[edge_type].df.where(at).limit(1).count():
            return self.batch_edges(deletes=[{"edge_type": edge_type, "src": src, "dst": dst}])["edges_deleted"] > 0
        e = self.graph.edges.get(edge_type)
        owner = e.df.where(at).first() if e is not None else None
        if owner is not None:
            raise RuleOwned(f"{edge_type} from {src} to {dst} is derived by the rule {owner['rule']}")
        return False

    def get_edge_prop(self, edge_type: str, src_key: str, dst_key: str, field: str):
        e = self.graph.edges.get(edge_type)
        row = e.df.where((F.col("src") == src_key) & (F.col("dst") == dst_key)).first() if e is not None and field in e.df.columns else None
        return row[field] if row else None

    def ingest_batch(self, nodes: Sequence[dict], edges: Sequence[dict] | None = None, on_conflict: str = "error") -> dict:
        """Nodes {label, key, props} and edges {edge_type, src, dst} in one step. Keys that are there: error, skip, or replace all properties."""
        if on_conflict not in ("error", "skip", "replace"):
            raise ValueError("on_conflict is error, skip or replace")
        keys = [n["key"] for n in nodes]
        there = {r["key"]: r["label"] for r in self.base.all_nodes().where(F.col("key").isin(keys)).collect()}  # as many as nodes
        report = {"inserted": 0, "edges_inserted": 0, "skipped": 0, "replaced": 0, "row_errors": []}
        seen: dict[str, str] = dict(there)
        batches: dict[str, list] = {}
        for i, n in enumerate(nodes):
            label = seen.get(n["key"])
            if label is not None and on_conflict == "error":
                raise DuplicateKey(n["key"])
            if label is not None and on_conflict == "skip":
                report["skipped"] += 1
                continue
            if label is not None and label != n["label"]:
                report["row_errors"].append((i, f"{n['key']} has the label {label}"))
                continue
            report["inserted" if label is None else "replaced"] += 1
            seen[n["key"]] = n["label"]
            batches.setdefault(n["label"], []).append((n["key"], n.get("props", {})))
        with self.transaction() as tx:
            for label, rows in sorted(batches.items()):
                tx._put(writes.ingest_batch(tx.base, label, tx._rows(label, list(dict(rows).items())), "replace"), label)
            if edges:
                report["edges_inserted"] = tx.batch_edges(edges)["edges_inserted"]
        return report

    # -- queries
    def query(self, cypher: str, params: dict | None = None, role: access.Role | None = None, namespace: str | None = None) -> DataFrame:
        g = self.graph
        return (access.scoped(g, role, namespace) if role or namespace else g).query(cypher, params)

    def query_with_params(self, cypher: str, params: Sequence[tuple]) -> DataFrame:
        return self.query(cypher, dict(params))

    def query_write(self, cypher: str, params: dict | None = None) -> writes.Written:
        """Runs a writing statement on the graph as its rules have it; derived edges stay derived."""
        done = writes.execute(self.base, cypher, params)
        self._put(done.graph, *[x for x, df in done.graph.nodes.items() if df is not self.base.nodes.get(x)])
        return done

    def query_at(self, commit: int, cypher: str, schemas: dict[str, str], params: dict | None = None) -> DataFrame:
        return history.graph_at(self._log(), commit, schemas).query(cypher, params)

    def node_info(self, key: str) -> dict | None:
        label = self.label_of(key)
        if label is None:
            return None
        row = self.base.nodes[label].where(F.col("key") == key).first().asDict()
        return {"key": key, "label": label, "props": {k: v for k, v in row.items() if k != "key" and v is not None}}

    def neighbors(self, key: str, edge_type: str, direction: str) -> DataFrame:
        return traverse.neighbors(self.graph, key, edge_type, direction)

    def node_edges(self, key: str) -> DataFrame:
        return traverse.node_edges(self.graph, key)

    def to_arrow_tables(self) -> dict:
        nodes, edges = files.arrow_tables(self.graph)
        return {"nodes": nodes.toArrow(), "edges": edges.toArrow()}

    # -- rules
    def create_rule(self, rule: dict | RuleDef, if_not_exists: bool = False) -> bool:
        """Registers a rule, with the default cap for its predicate if it has none. False if it is there and if_not_exists."""
        r = rule.validate() if isinstance(rule, RuleDef) else rule_of(rule)
        if r.name in self._rules:
            if if_not_exists:
                return False
            raise RuleError(f"a rule {r.name} exists")
        r = replace(r, max_edges=r.max_edges or rules.default_cap(r.predicate))
        before = dict(self._rules)
        self._rules[r.name] = r
        try:
            rules.order(list(self._rules.values()))
            self._put(self.base)
        except Exception:
            self._rules = before
            raise
        return True

    def rules(self) -> list[dict]:
        return [{**{k: v for k, v in r.__dict__.items() if k != "predicate"}, "predicate": spec_of(r.predicate)} for r in self._rules.values()]

    def delete_rule(self, name: str) -> None:
        """Removes a rule and with it the edges it owns."""
        if name not in self._rules:
            raise RuleError(f"no rule {name}")
        self._rules = {k: r for k, r in self._rules.items() if k != name}
        self._tripped.discard(name)
        self._put(self.base)

    def check_budget(self) -> list[str]:
        """Counts each rule's edges; rules with which the sum exceeds the budget stop firing until they are rebuilt. Their names."""
        counts = {r["rule"]: r["n"] for t in {r.edge_type for r in self._rules.values()} if (e := self.graph.edges.get(t)) is not None and "rule" in e.df.columns for r in e.df.where("rule is not null").groupBy("rule").agg(F.count("*").alias("n")).collect()}
        spent = 0
        for name in self._rules:
            spent += counts.get(name, 0)
            if spent > self.edge_budget:
                self._tripped.add(name)
        return sorted(self._tripped)

    def rebuild_rule(self, name: str) -> DataFrame:
        self._tripped.discard(name)
        return rules.rebuild(self.base, list(self._rules.values()), name)

    def suggest_rules(self) -> dict:
        found = [x for x in rules.suggest(self.base) if x["rule"].name not in self._rules]
        return {"suggestions": [{**x, "create_rule_args": {**{k: v for k, v in x["rule"].__dict__.items() if k != "predicate"}, "predicate": spec_of(x["rule"].predicate)}} for x in found], "total": len(found)}

    def explain(self, a: str, b: str) -> DataFrame:
        return rules.explain(self.base, list(self._rules.values()), a, b)

    def what_if_set_prop(self, key: str, field: str, value) -> DataFrame:
        return rules.what_if(self.base, list(self._rules.values()), self._found(key), key, field, value)

    # -- search
    def enable_fulltext(self, label: str, field: str, if_not_exists: bool = False) -> bool:
        if (label, field) in self._fulltext:
            if if_not_exists:
                return False
            raise ValueError(f"{label}.{field} is declared")
        self._fulltext.add((label, field))
        return True

    def disable_fulltext(self, label: str, field: str) -> None:
        self._fulltext.discard((label, field))

    def is_fulltext_enabled(self, label: str, field: str) -> bool:
        return (label, field) in self._fulltext

    def fulltext_pairs(self) -> list[tuple[str, str]]:
        return sorted(self._fulltext)

    def search(self, field: str, query: str, k: int = 0) -> DataFrame:
        return search.search(self.base, field, query, k or None, stem=True)

    def search_hybrid(self, text_field: str, query_text: str, vector_field: str, vector: Sequence[float], label: str | None = None, k: int = 10) -> DataFrame:
        return search.search_hybrid(self.base, text_field, query_text, vector_field, list(vector), k, label, stem=True)

    def find_similar(self, field: str, vector: Sequence[float], label: str | None = None, k: int = 10, min: float = 0.8, mask: Sequence[str] | None = None, where: dict | None = None, exact: bool = False) -> DataFrame:
        """The k nodes of the greatest cosine; mask: only these keys, where: only nodes with these properties. Always exact."""
        cond = None
        for c in ([F.col("key").isin(list(mask))] if mask is not None else []) + [F.col(f"`{f}`").eqNullSafe(F.lit(v)) for f, v in (where or {}).items()]:
            cond = c if cond is None else cond & c
        return search.find_similar(self.base, field, list(vector), label, k, min, cond)

    def pairwise_similar(self, keys: Sequence[str], field: str, k: int = 10, min: float = 0.0) -> DataFrame:
        return search.pairwise_similar(self.base, keys, field, k, min)

    def identity_clusters(self, floor: float = 0.6, label: str = "Entity", field: str = "name", aliases: str | None = None) -> DataFrame:
        return search.identity_clusters(self.base, label, field, aliases, floor)

    # -- degrees and algorithms
    def degree(self, key: str, edge_type: str | None = None, direction: str = "both") -> int:
        return algo.degree(self.graph, key, [edge_type] if edge_type else None, direction)

    def degrees(self, keys: Sequence[str] | None = None, label: str | None = None, where: dict | None = None, edge_type: str | None = None, direction: str = "both", limit: int | None = None) -> DataFrame:
        if where:
            df = self.base.nodes[label] if label else None
            if df is None:
                raise ValueError("where needs a label")
            for f, v in where.items():
                df = df.where(F.col(f"`{f}`").eqNullSafe(F.lit(v)))
            out = algo.degrees(self.graph, keys, label, [edge_type] if edge_type else None, direction).join(df.select("key"), "key", "left_semi").orderBy(F.col("degree").desc(), "key")
            return out.limit(limit) if limit is not None else out
        return algo.degrees(self.graph, keys, label, [edge_type] if edge_type else None, direction, limit)

    def pagerank(self, damping: float = 0.85, max_iters: int = 50, tol: float = 1e-06, edge_type: str | None = None, direction: str = "out", weight_prop: str | None = None, min_weight: float | None = None) -> DataFrame:
        return algo.pagerank(self.graph, [edge_type] if edge_type else None, damping, max_iters, tol, direction, weight_prop, min_weight)

    def connected_components(self, edge_type: str | None = None) -> DataFrame:
        return algo.connected_components(self.graph, [edge_type] if edge_type else None)

    def degree_centrality(self, edge_type: str | None = None, direction: str = "both", weight_prop: str | None = None, min_weight: float | None = None) -> DataFrame:
        return algo.degree_centrality(self.graph, [edge_type] if edge_type else None, direction, None, weight_prop, min_weight)

    def communities(self, edge_types: Sequence[str] | None = None, weight_prop: str | None = None, resolution: float = 1.0) -> DataFrame:
        return algo.communities(self.graph, edge_types, resolution, weight_prop)

    # -- time
    def _log(self) -> history.CommitLog:
        if self.log is None:
            raise ValueError("this handle has no commit log")
        return self.log

    def node_history(self, key: str) -> DataFrame:
        return history.node_history(self._log().changes(), key)

    def edge_history(self, a: str, b: str) -> DataFrame:
        return history.edge_history(self._log().changes(), a, b)

    def edges_at(self, key: str, commit: int | str) -> DataFrame:
        return history.edges_at(self._log().changes(), self.resolve_date(commit) if isinstance(commit, str) else commit, key)

    def was_linked(self, a: str, b: str, edge_type: str, at_commit: int | str) -> bool:
        return history.was_linked(self._log().changes(), a, b, edge_type, self.resolve_date(at_commit) if isinstance(at_commit, str) else at_commit)

    def resolve_date(self, date: str) -> int:
        """The last commit up to an instant; a date without time means its end."""
        when = dt.datetime.fromisoformat(date)
        return self._log().commit_at(when + dt.timedelta(days=1, microseconds=-1) if len(date) == 10 else when)

    def wal_total_commits(self) -> int:
        return self._log().head()

    # -- memory
    def upsert_entity(self, key: str, props: dict, label: str | None = None, aliases: Sequence[str] | None = None, namespace: str | None = None) -> dict:
        """Creates or updates an entity. aliases come from its key and name at each call; alias_keys gather what is given. A label never changes."""
        if not key.strip() or {"aliases", "alias_keys"} & set(props):
            raise ValueError("an entity needs a key, and its aliases aren't properties to set")
        old = self.node_info(key)
        if old is None and not label or old is not None and label and label != old["label"]:
            raise ValueError("a new entity needs a label, and an old one keeps its own")
        if old is not None and namespace is not None and namespace != old["props"].get("ns"):
            raise ValueError("a node stays in its namespace")
        had = old["props"] if old else {}
        name = props.get("name", had.get("name"))
        words = list(dict.fromkeys(search.words_of(f"{key} {name or ''}")))
        known = list(dict.fromkeys([*(had.get("alias_keys") or []), *(aliases or [])]))
        new = {**props, "id": key, "aliases": words, **({"alias_keys": known} if known else {}), **({"ns": namespace} if namespace is not None else {})}
        if old is None:
            self.insert_node(label, key, new)
        else:
            self.set_props_many([(key, {**new, **({"provisional": None} if had.get("provisional") else {})})])
        return {"key": key, "label": label or old["label"], "created": old is None, "updated_fields": sorted(k for k, v in props.items() if had.get(k) != v)}

    def remember(self, text: str, about: Sequence[str] | None = None, kind: str = "note", ts: int | None = None, source: str | None = None, entities: Sequence[dict] | None = None, facts: Sequence[dict] | None = None) -> dict:
        """Writes a note, the entities it names and facts among them, all or nothing. The same text at the same ts is the same note."""
        if kind not in ("note", "decision", "todo"):
            raise ValueError("kind is note, decision or todo")
        ts = int(dt.datetime.now(dt.UTC).timestamp()) if ts is None else ts
        note = "note:" + hashlib.sha256(f"{ts}\n{text}".encode()).hexdigest()[:16]
        report: dict = {"note": note, "created": [], "matched": [], "provisional": [], "provisional_capped": [], "labels_not_applied": [], "fulltext_declared": self.enable_fulltext("Note", "text", True)}
        with self.transaction() as tx:
            for e in entities or []:
                have = tx.label_of(e["key"])
                if have is not None and e.get("label") not in (None, have):
                    report["labels_not_applied"].append({"key": e["key"], "requested": e["label"], "stored": have})
                tx.upsert_entity(e["key"], e.get("props", {}), e["label"] if have is None else None, e.get("aliases"))
                report["matched" if have is not None else "created"].append(e["key"])
            for k in dict.fromkeys([*(about or []), *(x[w] for x in facts or [] for w in ("subject", "object"))]):
                if tx.label_of(k) is not None:
                    continue
                if len(report["provisional"]) == PROVISIONAL_MOST:
                    report["provisional_capped"].append(k)
                else:
                    tx.insert_node("Entity", k, {"id": k, "provisional": True})
                    report["provisional"].append(k)
            tx.upsert_node("Note", note, {"text": text, "kind": kind, "ts": ts, "source": source or "agent"})
            links = [{"edge_type": "ABOUT", "src": note, "dst": k} for k in dict.fromkeys(about or [])] + [{"edge_type": x["predicate"], "src": x["subject"], "dst": x["object"]} for x in facts or []]
            left = set(report["provisional_capped"])
            tx.batch_edges([x for x in links if x["src"] not in left and x["dst"] not in left])
        return report

    def recall(self, topic: str, k: int = 6) -> dict:
        """Nodes that hold at least half of the topic's terms in a declared text field, best first: key, label, summary, covered, score."""
        fields = sorted({f for _, f in self._fulltext})
        terms = list(dict.fromkeys(search.words_of(topic)))
        if not fields or not terms:
            return {"indexed": bool(fields), "terms": len(terms), "hits": self.spark.createDataFrame([], "key string, label string, summary string, covered bigint, score double")}
        found = search.recall(self.base, topic, fields, k).withColumnRenamed("coverage", "covered")
        said = None
        for label, df in sorted(self.base.nodes.items()):
            texts = [F.col(f"`{c}`").cast("string") for c in ("text", "summary", "name") if c in df.columns]
            one = df.select("key", F.lit(label).alias("label"), (F.substring(F.coalesce(*texts), 1, 120) if texts else F.lit(None).cast("string")).alias("summary"))
            said = one if said is None else said.unionAll(one)
        hits = said.join(F.broadcast(found), "key").select("key", "label", "summary", "covered", "score")
        return {"indexed": True, "terms": len(terms), "hits": hits.orderBy(F.col("covered").desc(), F.col("score").desc(), "key")}

    def forget(self, key: str | None = None, prop: str | None = None, fact: dict | None = None) -> dict:
        """Forgets a node, one of its properties, or a fact: one of the three. The commit log still has it."""
        if (key is None) == (fact is None) or prop is not None and key is None:
            raise ValueError("a key, a key with prop, or a fact")
        if fact is not None:
            for k in (fact["subject"], fact["object"]):
                self._found(k)
            return {"mode": "fact", "target": fact, "changed": self.delete_edge(fact["predicate"], fact["subject"], fact["object"])}
        if prop is not None:
            changed = self.remove_prop(key, prop)
            if changed and prop == "name" and "aliases" in self.node_info(key)["props"]:
                self.set_prop(key, "aliases", search.words_of(key))
            return {"mode": "prop", "target": key, "prop": prop, "changed": changed}
        self._found(key)
        about = self.base.edges.get("ABOUT")
        notes = [r["src"] for r in about.df.where(F.col("dst") == key).select("src").orderBy("src").limit(10).collect()] if about is not None else []
        return {"mode": "node", "target": key, "changed": True, **self.delete_node(key), "notes": notes}

    def schema_report(self) -> dict:
        """Counts by label and edge type, their fields and ends, rules, declarations, and nodes that are only named."""
        counts = {(r["kind"], r["name"]): r["count"] for r in self.graph.stats().collect()}  # labels and edge types
        entity = self.base.nodes.get("Entity")
        bare = entity.where("provisional") if entity is not None and "provisional" in entity.columns else None
        labels = [{"label": x, "nodes": counts.get(("node", x), 0), "fields": [c for c in df.columns if c != "key"]} for x, df in sorted(self.base.nodes.items())]
        edges = [{"edge_type": t, "edges": counts.get(("edge", t), 0), "src": e.src_label, "dst": e.dst_label, "derived": e.derived} for t, e in sorted(self.graph.edges.items())]
        brief = {"nodes": sum(x["nodes"] for x in labels), "edges": sum(x["edges"] for x in edges), "labels": labels, "edge_types": edges}
        return {"brief": brief, "rules": self.rules(), "fulltext": self.fulltext_pairs(), "indexes": [(i.label, i.field) for i in self.base.indexes], "provisional": bare.count() if bare is not None else 0, "provisional_sample": [r["key"] for r in bare.orderBy("key").limit(10).collect()] if bare is not None else []}

    def stats(self) -> dict:
        """Nodes, edges and, for each rule, its edges and whether it stopped firing."""
        g, by = self.graph, {}
        for t in {r.edge_type for r in self._rules.values()}:
            e = g.edges.get(t)
            if e is not None and "rule" in e.df.columns:
                by |= {r["rule"]: r["n"] for r in e.df.where("rule is not null").groupBy("rule").agg(F.count("*").alias("n")).collect()}
        return {"nodes": self.base.all_nodes().count(), "edges": g.all_edges().count(), "rules": [{"name": n, "edges": by.get(n, 0), "tripped": n in self._tripped} for n in self._rules]}

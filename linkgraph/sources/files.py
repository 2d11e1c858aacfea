"""Import from CSV and JSON lines, and export to JSON lines, CSV, statements, Parquet, GraphML and Arrow tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import PropertyGraph

_TYPES = {"int": "bigint", "long": "bigint", "float": "double", "double": "double", "bool": "boolean", "boolean": "boolean", "string": "string", "date": "date", "localdatetime": "timestamp_ntz", "datetime": "timestamp_ntz"}


class ImportFailed(ValueError):
    pass


def _header(name: str) -> tuple[str, str, bool]:
    """(property, type, is a list) of a header cell."""
    m = re.fullmatch(r"(.*?)(?::(\w+))?(\[\])?", name)
    kind = (m[2] or "string").lower()
    if kind not in _TYPES and kind != "json":
        raise ImportFailed(f"no such type: {name}")
    return m[1], kind, bool(m[3])


def _cell(name: str, array_delimiter: str) -> Column:
    prop, kind, many = _header(name)
    c = F.col(f"`{name}`")
    if many:
        return F.when(c != "", F.split(c, re.escape(array_delimiter))).cast(f"array<{_TYPES[kind]}>").alias(prop)
    return (c if kind in ("string", "json") else F.when(c != "", F.trim(c)).cast(_TYPES[kind])).alias(prop)


def read_nodes_csv(g: PropertyGraph, path: str, label: str | None = None, delimiter: str = ",", array_delimiter: str = ";") -> PropertyGraph:
    """Nodes of a CSV with a header of :ID (or name:ID, :KEY), :LABEL and prop[:type[[]]]."""
    df = g.spark.read.option("header", True).option("delimiter", delimiter).option("escape", '"').option("multiLine", True).csv(path)
    ids = [c for c in df.columns if c.upper().endswith((":ID", ":KEY"))]
    labels = [c for c in df.columns if c.upper() == ":LABEL"]
    if len(ids) != 1 or not labels and label is None:
        raise ImportFailed("a node file has one :ID column, and :LABEL or a label given")
    cols = [_cell(c, array_delimiter) for c in df.columns if c not in ids + labels]
    named = ids[0].rsplit(":", 1)[0]
    if named and named not in ("key",):
        cols.append(F.col(f"`{ids[0]}`").alias(named))
    found = [label] if not labels else [r[0] for r in df.select(F.col(f"`{labels[0]}`")).distinct().orderBy(F.col(f"`{labels[0]}`")).collect()]  # labels are few: the graph has a table for each
    for x in found:
        part = df if not labels else df.where(F.col(f"`{labels[0]}`") == x)
        new = part.select(F.col(f"`{ids[0]}`").alias("key"), *cols)
        g = g.with_nodes(x, new if x not in g.nodes else g.nodes[x].unionByName(new, allowMissingColumns=True))
    return g


def read_edges_csv(g: PropertyGraph, path: str, etype: str | None = None, delimiter: str = ",", array_delimiter: str = ";") -> PropertyGraph:
    """Edges of a CSV with a header of :START_ID, :END_ID, :TYPE and prop[:type[[]]]."""
    df = g.spark.read.option("header", True).option("delimiter", delimiter).option("escape", '"').option("multiLine", True).csv(path)
    by = {c.upper(): c for c in df.columns}
    if ":START_ID" not in by or ":END_ID" not in by or ":TYPE" not in by and etype is None:
        raise ImportFailed("an edge file has :START_ID, :END_ID, and :TYPE or a type given")
    special = [by[k] for k in (":START_ID", ":END_ID", ":TYPE") if k in by]
    cols = [_cell(c, array_delimiter) for c in df.columns if c not in special]
    kind = F.col(f"`{by[':TYPE']}`") if ":TYPE" in by else F.lit(etype)
    for x in [r[0] for r in df.select(kind.alias("t")).distinct().orderBy("t").collect()]:
        new = df.where(kind == x).select(F.col(f"`{by[':START_ID']}`").alias("src"), F.col(f"`{by[':END_ID']}`").alias("dst"), *cols)
        g = g.with_edges(x, new if x not in g.edges else g.edges[x].df.unionByName(new, allowMissingColumns=True))
    return g


def ingest_json(spark: SparkSession, lines: DataFrame, ddl: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, errors) of JSON rows in column value: a row needs a text key and fits the schema; a list with a null is dropped."""
    schema = T._parse_datatype_string(ddl)
    read = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    p = lines.select("value", F.from_json("value", read, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}).alias("p"))
    bad = F.col("p").isNull() | F.col("p._corrupt").isNotNull() | F.col(f"p.{key}").isNull()
    clean = [(F.when(F.forall(F.col(f"p.{f.name}"), lambda x: x.isNotNull()), F.col(f"p.{f.name}")) if isinstance(f.dataType, T.ArrayType) else F.col(f"p.{f.name}")).alias(f.name) for f in schema.fields if f.name != key]
    nodes = p.where(~bad).select(F.col(f"p.{key}").cast("string").alias("key"), *clean)
    errors = p.where(bad).select("value", F.when(F.col("p").isNull() | F.col("p._corrupt").isNotNull(), F.lit("no valid row")).otherwise(F.lit("no key")).alias("error"))
    return nodes, errors


def _props(df: DataFrame, skip: tuple) -> Column:
    names = sorted(c for c in df.columns if c not in skip)
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in names])) if names else F.lit("{}")


def arrow_tables(g: PropertyGraph) -> tuple[DataFrame, DataFrame]:
    """nodes (key, label, properties) and edges (source, type, target, derived, rule, weight, properties); toArrow() gives the tables."""
    nodes = edges = None
    for label, df in sorted(g.nodes.items()):
        x = df.select("key", F.lit(label).alias("label"), _props(df, ("key",)).alias("properties"))
        nodes = x if nodes is None else nodes.unionAll(x)
    for name, e in sorted(g.edges.items()):
        rule = F.col("rule") if "rule" in e.df.columns else F.lit(None).cast("string")
        weight = F.col("score") if "score" in e.df.columns else F.lit(None).cast("double")
        x = e.df.select(F.col("src").alias("source"), F.lit(name).alias("type"), F.col("dst").alias("target"), rule.isNotNull().alias("derived"), rule.alias("rule"), weight.alias("weight"), _props(e.df, ("src", "dst", "rule", "score")).alias("properties"))
        edges = x if edges is None else edges.unionAll(x)
    empty = g.spark.createDataFrame([], "source string, type string, target string, derived boolean, rule string, weight double, properties string")
    return (nodes if nodes is not None else g.spark.createDataFrame([], "key string, label string, properties string")), (edges if edges is not None else empty)


def write_jsonl(g: PropertyGraph, path: str) -> None:
    """Lines of nodes, then edges, sorted within each file; read_jsonl reads them again."""
    n, e = arrow_tables(g)
    lines = n.select(F.lit(0).alias("k"), F.col("key").alias("a"), F.lit("").alias("b"), F.to_json(F.struct(F.lit("node").alias("type"), "key", "label", F.col("properties").alias("$props"))).alias("value"))
    lines = lines.unionAll(e.where("not derived").select(F.lit(1), F.concat_ws("|", "type", "source"), "target", F.to_json(F.struct(F.lit("edge").alias("type"), F.col("type").alias("etype"), "source", "target", F.col("properties").alias("$props")))))
    lines.orderBy("k", "a", "b").select("value").write.mode("overwrite").text(path)


def read_jsonl(spark: SparkSession, path: str, schemas: dict[str, str], edge_schemas: dict[str, str] | None = None) -> PropertyGraph:
    """schemas: the properties of each label as DDL; edge_schemas: those of edge types, which also names the types to read."""
    row = F.from_json("value", "type string, key string, label string, etype string, source string, target string, `$props` string").alias("r")
    lines = spark.read.text(path).select(row).select("r.*")
    g = PropertyGraph(spark)
    for label, ddl in schemas.items():
        x = lines.where((F.col("type") == "node") & (F.col("label") == label)).select("key", F.from_json(F.col("`$props`"), ddl).alias("p"))
        g = g.with_nodes(label, x.select("key", "p.*") if ddl else x.select("key"))
    for etype, ddl in (edge_schemas or {}).items():
        x = lines.where((F.col("type") == "edge") & (F.col("etype") == etype))
        x = x.select(F.col("source").alias("src"), F.col("target").alias("dst"), F.from_json(F.col("`$props`"), ddl).alias("p")).select("src", "dst", "p.*") if ddl else x.select(F.col("source").alias("src"), F.col("target").alias("dst"))
        g = g.with_edges(etype, x, unique=True)
    return g


def _typed_header(f: T.StructField) -> str:
    t = f.dataType
    many = isinstance(t, T.ArrayType)
    t = t.elementType if many else t
    name = {"LongType": "int", "IntegerType": "int", "ShortType": "int", "DoubleType": "float", "FloatType": "float", "BooleanType": "bool", "DateType": "date", "TimestampNTZType": "localdatetime", "TimestampType": "localdatetime"}.get(type(t).__name__, "string")
    return f"{f.name}:{name}{'[]' if many else ''}"


def write_csv(g: PropertyGraph, path: str, array_delimiter: str = ";") -> None:
    """path/nodes/<label> and path/edges/<type>, with headers that the readers above take."""
    for kind, tables in (("nodes", {k: v for k, v in g.nodes.items()}), ("edges", {k: e.df for k, e in g.edges.items() if not e.derived})):
        for name, df in tables.items():
            fixed = {"key": ":ID"} if kind == "nodes" else {"src": ":START_ID", "dst": ":END_ID"}
            cols = [F.col(a).alias(b) for a, b in fixed.items()] + [F.lit(name).alias(":LABEL" if kind == "nodes" else ":TYPE")]
            for f in df.schema.fields:
                if f.name not in fixed:
                    c = F.col(f"`{f.name}`")
                    cols.append((F.array_join(c.cast("array<string>"), array_delimiter) if isinstance(f.dataType, T.ArrayType) else c.cast("string")).alias(_typed_header(f)))
            df.select(*cols).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/{kind}/{name}")


def _literal(c: Column, t: T.DataType) -> Column:
    if isinstance(t, T.StringType):
        return F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    if isinstance(t, T.ArrayType):
        return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.coalesce(_literal(x, t.elementType), F.lit("null"))), ", "), F.lit("]"))
    if isinstance(t, T.DateType):
        return F.concat(F.lit("date('"), c.cast("string"), F.lit("')"))
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return F.concat(F.lit("localdatetime('"), F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("')"))
    return c.cast("string")


def statements(g: PropertyGraph) -> DataFrame:
    """One CREATE statement a line in column value, nodes before edges."""
    out = None
    for label, df in sorted(g.nodes.items()):
        parts = [F.concat(F.lit("id: "), _literal(F.col("key"), T.StringType()))]
        parts += [F.concat(F.lit(f"{f.name}: "), _literal(F.col(f"`{f.name}`"), f.dataType)) for f in df.schema.fields if f.name != "key"]
        x = df.select(F.lit(0).alias("k"), F.concat(F.lit(f"CREATE (:{label} {{"), F.concat_ws(", ", *parts), F.lit("})")).alias("value"))
        out = x if out is None else out.unionAll(x)
    for etype, e in sorted(g.edges.items()):
        if not e.derived:
            x = e.df.select(F.lit(1).alias("k"), F.concat(F.lit("MATCH (a {id: "), _literal(F.col("src"), T.StringType()), F.lit("}), (b {id: "), _literal(F.col("dst"), T.StringType()), F.lit(f"}}) CREATE (a)-[:{etype}]->(b)")).alias("value"))
            out = x if out is None else out.unionAll(x)
    return out.orderBy("k", "value").select("value")


def write_parquet(g: PropertyGraph, path: str) -> None:
    """path/nodes/<label> and path/edges/<type>: the layout to query from."""
    for label, df in g.nodes.items():
        df.write.mode("overwrite").parquet(f"{path}/nodes/{label}")
    for etype, e in g.edges.items():
        e.df.write.mode("overwrite").parquet(f"{path}/edges/{etype}")


def read_parquet(spark: SparkSession, path: str, labels: list[str], edges: dict[str, tuple[str | None, str | None]]) -> PropertyGraph:
    g = PropertyGraph(spark)
    for label in labels:
        g = g.with_nodes(label, spark.read.parquet(f"{path}/nodes/{label}"))
    for etype, (a, b) in edges.items():
        g = g.with_edges(etype, spark.read.parquet(f"{path}/edges/{etype}"), a, b, closed=a is not None and b is not None, unique=True)
    return g


def graphml(g: PropertyGraph) -> DataFrame:
    """Lines of a GraphML document in column value, in order of k."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    n, e = arrow_tables(g)
    head = g.spark.createDataFrame([(0, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">')], "k int, value string")
    nodes = n.select(F.lit(1).alias("k"), F.concat(F.lit('<node id="'), esc(F.col("key")), F.lit('"><data key="label">'), esc(F.col("label")), F.lit('</data><data key="properties">'), esc(F.col("properties")), F.lit("</data></node>")).alias("value"))
    edges = e.select(F.lit(2).alias("k"), F.concat(F.lit('<edge source="'), esc(F.col("source")), F.lit('" target="'), esc(F.col("target")), F.lit('"><data key="type">'), esc(F.col("type")), F.lit("</data></edge>")).alias("value"))
    tail = g.spark.createDataFrame([(3, "</graph></graphml>")], "k int, value string")
    return head.unionAll(nodes).unionAll(edges).unionAll(tail)

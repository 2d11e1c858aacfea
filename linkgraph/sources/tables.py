"""The star-schema tables as a property graph. Nothing is read before a query needs it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import PropertyGraph

#: label -> (table, key prefix, key column)
NODES = {"Region": ("region", "region", "r_regionkey"), "Nation": ("nation", "nation", "n_nationkey"), "Customer": ("customer", "customer", "c_custkey"), "Supplier": ("supplier", "supplier", "s_suppkey"), "Part": ("part", "part", "p_partkey"), "Order": ("orders", "order", "o_orderkey"), "Event": ("events", "event", "event_id"), "Doc": ("documents", "doc", "doc_id"), "Vec": ("embeddings", "vec", "vec_id"), "Page": ("pages", "page", "page_id"), "Item": ("lineitem", "item", None), "Message": ("conversations", "msg", None)}
#: etype -> (table, source prefix, source column, source label, target prefix, target column, target label)
EDGES = {"IN_REGION": ("nation", "nation", "n_nationkey", "Nation", "region", "n_regionkey", "Region"), "IN_NATION": ("customer", "customer", "c_custkey", "Customer", "nation", "c_nationkey", "Nation"), "SUPPLIER_IN": ("supplier", "supplier", "s_suppkey", "Supplier", "nation", "s_nationkey", "Nation"), "PLACED_BY": ("orders", "order", "o_orderkey", "Order", "customer", "o_custkey", "Customer"), "BY_USER": ("events", "event", "event_id", "Event", "customer", "user_id", "Customer"), "CONTAINS": ("lineitem", "order", "l_orderkey", "Order", "part", "l_partkey", "Part"), "SOLD": ("lineitem", "supplier", "l_suppkey", "Supplier", "part", "l_partkey", "Part"), "OF_ORDER": ("lineitem", "item", None, "Item", "order", "l_orderkey", "Order"), "OF_PART": ("lineitem", "item", None, "Item", "part", "l_partkey", "Part"), "FROM_SUPPLIER": ("lineitem", "item", None, "Item", "supplier", "l_suppkey", "Supplier")}
#: These repeat their ends: one edge each, with how often in count.
MULTIPLE = {"CONTAINS", "SOLD"}


def _key(prefix: str, column: str | None, table: str, df: DataFrame):
    if column:
        return F.concat(F.lit(f"{prefix}:"), F.col(column).cast("string"))
    if table == "conversations":
        return F.concat_ws(":", F.lit(prefix), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    # lineitem has no key of its own; its whole rows are distinct
    return F.concat(F.lit(f"{prefix}:"), F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in df.columns])))


def load(spark: SparkSession, sf_dir: str, labels: Iterable[str] | None = None) -> PropertyGraph:
    """The graph of the tables in a folder; labels: only these and the edges between them."""
    g = PropertyGraph(spark)
    wanted = set(NODES if labels is None else labels)
    tables: dict[str, DataFrame] = {}

    def table(name: str) -> DataFrame:
        if name not in tables:
            tables[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return tables[name]

    for label, (name, prefix, column) in NODES.items():
        if label in wanted:
            df = table(name)
            g = g.with_nodes(label, df, _key(prefix, column, name, df))
    for etype, (name, sp, sc, sl, tp, tc, tl) in EDGES.items():
        if sl in wanted and tl in wanted:
            df = table(name)
            if etype in MULTIPLE:
                df = df.groupBy(sc, tc).agg(F.count("*").alias("count"))
                e = df.select(_key(sp, sc, name, df).alias("src"), _key(tp, tc, name, df).alias("dst"), "count")
            else:
                e = df.where(F.col(tc).isNotNull()).select(_key(sp, sc, name, df).alias("src"), _key(tp, tc, name, df).alias("dst"))
            g = g.with_edges(etype, e, sl, tl, closed=True, unique=True)
    return g

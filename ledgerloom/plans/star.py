"""The star schema as a typed property graph: orders, customers, suppliers, nations, regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def node(kind: str, key: Column) -> Column:
    return F.concat(F.lit(kind), key.cast("string"))


#: Edge types: table, kinds and keys of source and target.
TYPES = {"PLACED_BY": ("orders", "o", "o_orderkey", "c", "o_custkey"), "LIVES_IN": ("customer", "c", "c_custkey", "n", "c_nationkey"), "BASED_IN": ("supplier", "s", "s_suppkey", "n", "s_nationkey"), "PART_OF": ("nation", "n", "n_nationkey", "r", "n_regionkey")}


def edges(spark: SparkSession, d: str, *types: str) -> DataFrame:
    """(src, dst, type, id) of the named edge types, or of all."""
    out: DataFrame | None = None
    for name in types or TYPES:
        source, kind, key, other, foreign = TYPES[name]
        part = spark.read.parquet(f"{d}/{source}.parquet").select(node(kind, F.col(key)).alias("src"), node(other, F.col(foreign)).alias("dst"), F.lit(name).alias("type"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("id", F.concat_ws(">", "src", "dst"))


def nodes(e: DataFrame) -> DataFrame:
    return e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def kind(n: Column) -> Column:
    first = F.substring(n, 1, 1)
    return F.when(first == "o", "order").when(first == "c", "customer").when(first == "s", "supplier").when(first == "n", "nation").otherwise("region")


def seeds(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "node string")


def nearest_binding(spark: SparkSession, d: str) -> DataFrame:
    """For each customer the innermost scope that binds its segment: itself, its nation, or its region.

    Scopes are (customer, nation, region) by depth; a reference joins the
    bindings of its ancestors, and the smallest depth wins.
    """
    customer, nation = spark.read.parquet(f"{d}/customer.parquet"), spark.read.parquet(f"{d}/nation.parquet")
    segments = customer.select(F.col("c_mktsegment").alias("name")).distinct()
    own = customer.where("c_acctbal > 5000").select(node("c", F.col("c_custkey")).alias("scope"), F.col("c_mktsegment").alias("name"))
    national = nation.where("n_nationkey % 2 = 0").select(node("n", F.col("n_nationkey")).alias("scope"), F.explode(F.array(F.lit("BUILDING"), F.lit("MACHINERY"))).alias("name"))
    regional = nation.select(node("r", F.col("n_regionkey")).alias("scope")).distinct().join(segments)  # a few names in a few regions
    bindings = own.unionByName(national).unionByName(regional)
    up = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    scopes = F.posexplode(F.array(node("c", F.col("c_custkey")), node("n", F.col("n_nationkey")), node("r", F.col("n_regionkey")))).alias("depth", "scope")
    refs = up.select("c_custkey", F.col("c_mktsegment").alias("name"), scopes)
    nearest = refs.join(bindings, ["scope", "name"]).groupBy("c_custkey", "name").agg(F.min(F.struct("depth", "scope")).alias("b"))
    return nearest.select("c_custkey", "name", F.col("b.depth").alias("depth"), F.col("b.scope").alias("scope"))


def resolve_modules(pages: DataFrame) -> DataFrame:
    """(page_id, n_found, resolved): candidate files of a page's path; resolved only where exactly one file exists."""
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    path = F.regexp_extract("url", "^[a-z]+://[^/?#]*/([^?#]*)", 1)
    p = pages.select("page_id", host.alias("host"), path.alias("path"))
    files = p.groupBy(F.concat_ws("/", "host", "path").alias("file")).agg(F.count("*").alias("n"))
    candidates = F.array(F.concat_ws("/", "host", "path"), F.concat_ws("/", "host", F.substring_index("path", "/", 1)), F.concat_ws("/", "host", "path", F.lit("index")))
    found = p.select("page_id", F.explode(candidates).alias("file")).join(files, "file")
    out = found.groupBy("page_id").agg(F.countDistinct("file").alias("n_found"), F.min("file").alias("file"), F.sum("n").alias("n_files"))
    return out.select("page_id", "n_found", F.when((F.col("n_found") == 1) & (F.col("n_files") == 1), F.col("file")).alias("resolved"))

"""Graphs derived from relational tables, so that every graph operator runs on them too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def geo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and loc of a file tree: region/nation/customer or supplier."""
    t = lambda n: table(spark, sf_dir, n)
    place = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat_ws("/", "r_name", "n_name").alias("dir"))
    side = lambda who, key, nation, money: t(who).select(F.concat(F.lit(f"{who}-"), F.col(key)).alias("file"), F.col(nation).alias("n_nationkey"), F.floor(F.abs(money)).alias("loc"))
    files = side("customer", "c_custkey", "c_nationkey", "c_acctbal").unionByName(side("supplier", "s_suppkey", "s_nationkey", "s_acctbal"))
    return files.join(F.broadcast(place), "n_nationkey").select(F.concat_ws("/", "dir", "file").alias("path"), "loc")


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src imports dst: a customer's file imports each supplier it has bought from."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    bought = items.select("l_orderkey", "l_suppkey").distinct().join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return bought.select(F.concat(F.lit("f:c"), F.col("o_custkey")).alias("src"), F.concat(F.lit("f:s"), F.col("l_suppkey")).alias("dst")).distinct().withColumn("kind", F.lit("imports"))


def trade_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of trade_edges() with their nation as module."""
    side = lambda who, p: table(spark, sf_dir, who).select(F.concat(F.lit(f"f:{p}"), F.col(f"{p}_{'cust' if p == 'c' else 'supp'}key")).alias("id"), F.lit("File").alias("kind"), F.col(f"{p}_nationkey").cast("long").alias("module"))
    return side("customer", "c").unionByName(side("supplier", "s"))


def step_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: each customer to those who ordered right after the customer's first and last order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("who"))
    ends = orders.groupBy("who").agg(F.explode(F.array(F.min("o_orderkey"), F.max("o_orderkey"))).alias("k")).select(F.col("who").alias("src"), (F.col("k") + 1).alias("o_orderkey"))
    steps = ends.join(orders.withColumnRenamed("who", "dst"), "o_orderkey").filter("src <> dst")
    return steps.select("src", "dst").distinct().withColumn("kind", F.lit("imports"))


def part_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, path and name of symbols: parts defined in their brand."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("path"), F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("name"))


def order_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, src_path, name and line of call sites: the first part of an order calls the others."""
    parts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("line"))
    lead = parts.groupBy("l_orderkey").agg(F.min(F.struct("line", "l_partkey")).alias("lead")).select("l_orderkey", F.col("lead.l_partkey").alias("src"))
    symbols = part_symbols(spark, sf_dir)
    refs = parts.join(lead, "l_orderkey").filter("l_partkey <> src")
    named = refs.join(symbols.select(F.col("id").alias("l_partkey"), "name", F.col("path").alias("dst_path")), "l_partkey")
    return named.join(symbols.select(F.col("id").alias("src"), F.col("path").alias("src_path")), "src").select("src", "src_path", "name", "line", "dst_path")


def brand_imports(calls: DataFrame, top: int = 3) -> DataFrame:
    """path imports dep: each brand its most-called other brands."""
    counted = calls.filter("src_path <> dst_path").groupBy("src_path", "dst_path").agg(F.count(F.lit(1)).alias("n"))
    ranked = counted.withColumn("r", F.row_number().over(Window.partitionBy("src_path").orderBy(F.desc("n"), "dst_path")))
    return ranked.filter(F.col("r") <= top).select(F.col("src_path").alias("path"), F.col("dst_path").alias("dep"))


def page_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and raw of imports: the links of each page without their leading slash."""
    pages = table(spark, sf_dir, "pages")
    links = F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1)))
    return pages.select(F.col("url").alias("path"), links.alias("href")).select("path", F.regexp_replace("href", "^/", "").alias("raw"))


def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src and dst event type of each user's consecutive events."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(order).alias("dst")).filter("dst is not null")

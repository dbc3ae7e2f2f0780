"""Plain relational queries over the star schema: extensions, for the engine's throughput."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= '2001-06-01' GROUP BY ALL")
def q1_pricing(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        table(spark, d, "lineitem")
        .where(F.col("l_shipdate") <= "2001-06-01")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 4).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))
    )


@query("SELECT l_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < '1998-03-15' AND l_shipdate > '1998-03-15' GROUP BY ALL")
def q3_shipping(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = table(spark, d, "orders").where(F.col("o_orderdate") < "1998-03-15").select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") > "1998-03-15").select("l_orderkey", "l_extendedprice", "l_discount")
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").join(li, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("l_orderkey", "o_orderdate").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"))


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name")
def q5_local_suppliers(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    joined = (
        t("lineitem")
        .join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer"), (F.col("o_custkey") == F.col("c_custkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
        .join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"))


@query("SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def q6_forecast(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where("l_discount between 0.05 and 0.07 and l_quantity < 24").agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 4).alias("revenue"))


@query("SELECT p_brand, p_type, count(*) AS n, round(avg(p_retailprice), 4) AS price FROM part GROUP BY CUBE (p_brand, p_type)")
def q_cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").cube("p_brand", "p_type").agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("price"))

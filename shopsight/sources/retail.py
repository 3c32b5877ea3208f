"""The retail tables as projections of the order-and-part test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopsight.sources.files import read_table


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", *columns)


_ROWS_PER_TASK = 500_000


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per unit sold, with exact copies and price conflicts mixed in.

    The copies are unrolled after the joins from a per-row array, so every table is read once. The last join
    deals the lines out by the receipt as it is named in the result, over as many tasks as their number needs:
    what groups by receipt and other columns afterwards needs no shuffle, and a task's rows fit its memory.
    """
    lines = _table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                   "l_extendedprice", "l_discount", "l_returnflag")
    orders = _table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    parts = _table(spark, sf_dir, "part", "p_partkey", "p_brand")
    tasks = max(spark.sparkContext.defaultParallelism, -(-lines.count() // _ROWS_PER_TASK))
    receipt, ordered = (F.col(c).cast("string") for c in ("l_orderkey", "o_orderkey"))
    known = lines.withColumn("returned", F.expr("l_returnflag = 'R'")).drop("l_returnflag").join(
        parts, lines.l_partkey == parts.p_partkey).drop("p_partkey")
    joined = (
        known.repartition(tasks, receipt)
        .join(orders.repartition(tasks, ordered), receipt == ordered)
        # ten digits before the point keep the products within a long
        .withColumn("gross", F.expr("cast(l_extendedprice as decimal(12,2))"))
        .withColumn("rate", F.expr("cast(l_discount as decimal(4,2))"))
        .withColumn("extra", F.expr("""
            explode(case when l_orderkey % 50 = 0 and l_orderkey % 97 = 0 and l_linenumber = 1 then array(0, 0, 1)
                         when l_orderkey % 50 = 0 then array(0, 0)
                         when l_orderkey % 97 = 0 and l_linenumber = 1 then array(0, 1)
                         else array(0) end)"""))
    )
    return joined.select(
        F.col("l_orderkey").cast("string").alias("ID_SCONTRINO"),
        F.col("o_custkey").alias("ID_CLI"),
        F.col("l_suppkey").alias("ID_NEG"),
        F.col("l_partkey").alias("ID_ARTICOLO"),
        F.expr("cast(substr(p_brand, 7) as int)").alias("COD_REPARTO"),
        F.expr("if(returned and l_linenumber in (2, 4), -1, 1)").alias("DIREZIONE"),
        F.expr("cast(gross + extra as decimal(18,2))").alias("IMPORTO_LORDO"),
        F.expr("""
            cast(round(case when l_linenumber = 7 and rate >= 0.09 then gross * cast(1.1 as decimal(4,2))
                            when l_linenumber = 7 and rate = 0.08 then gross
                            else gross * rate end, 2) as decimal(18,2))""").alias("SCONTO"),
        F.expr("""
            o_orderdate + make_dt_interval(0, cast(l_orderkey % 13 + 8 as int),
                                           cast(l_orderkey * 7 % 60 as int), 0)""").alias("DATETIME"),
    )


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transactions as they stand in a raw file: money and time as text."""
    df = transactions(spark, sf_dir)
    for money in ("IMPORTO_LORDO", "SCONTO"):
        df = df.withColumn(money, F.regexp_replace(F.col(money).cast("string"), r"\.", ","))
    return df.withColumn("DATETIME", F.date_format("DATETIME", "yyyy-MM-dd HH:mm:ss"))


def loyalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority",
                    "o_orderstatus", "o_orderdate")
    # cards of every 13th client carry an id without an account, so that joins lose rows
    return orders.selectExpr(
        "if(o_custkey % 13 = 0, -o_custkey, o_custkey) as ID_CLI", "o_orderkey as ID_FID", "o_orderkey % 100 as ID_NEG",
        "o_orderpriority as COD_FID", "cast(o_orderkey % 3 as int) as TYP_CLI_FID",
        "if(o_orderstatus = 'F', 0, 1) as STATUS_FID",
        "cast(trunc(o_orderdate, 'year') as timestamp_ntz) as DT_ACTIVE",
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = _table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    return customer.selectExpr(
        "c_custkey as ID_CLI",
        "if(c_custkey % 11 = 0, null, concat('prov_', c_nationkey)) as EMAIL_PROVIDER",
        "if(c_custkey % 3 = 0, null, 1) as W_PHONE", "c_custkey as ID_ADDRESS",
        "cast(c_custkey % 4 as int) as TYP_CLI_ACCOUNT",
        "if(c_acctbal < 0, null, c_mktsegment) as TYP_JOB",
    )


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = _table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    return customer.selectExpr(
        "if(c_custkey % 10 = 0, -c_custkey, c_custkey) as ID_ADDRESS",
        "if(c_custkey % 17 = 0, null, cast(20100 + c_nationkey as string)) as CAP",
        "explode(if(c_custkey % 5 = 0, array(0, 1), array(0))) as copy",
    ).drop("copy")


def privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = _table(spark, sf_dir, "customer", "c_custkey", "c_acctbal")
    return customer.selectExpr(
        "c_custkey as ID_CLI", "cast(c_custkey % 2 as int) as FLAG_PRIVACY_1",
        "if(c_custkey % 3 = 0, 1, 0) as FLAG_PRIVACY_2", "if(c_acctbal > 0, 1, 0) as FLAG_DIRECT_MKT",
    )

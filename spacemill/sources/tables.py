"""Input views of the operators, from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

EPOCH = "1995-01-01"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(ts: str):
    """Days since the epoch of the views, as a long."""
    return F.datediff(F.col(ts).cast("date"), F.lit(EPOCH).cast("date")).cast("long")


def intervals(spark: SparkSession, sf_dir: str, most: int = 20) -> DataFrame:
    """k, start, len: a supplier's shipments as day intervals, of at most ``most`` days."""
    li = read(spark, sf_dir, "lineitem").where(F.col("l_quantity") <= most)
    return li.select(F.col("l_suppkey").alias("k"), day("l_shipdate").alias("start"), F.col("l_quantity").cast("long").alias("len"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, k, addr: an order's day, put to one of the suppliers."""
    n = read(spark, sf_dir, "supplier").count()
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.pmod("o_custkey", F.lit(n)).alias("k"), day("o_orderdate").alias("addr"))


def fit_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, n: the distinct sizes asked of each supplier's free extents."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_quantity").cast("long").alias("n")).distinct()


def size_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ok, ln, pk, size: bytes asked by each lineitem."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("pk"), (F.col("l_quantity").cast("long") * 4096).alias("size"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """g, seq, size: an order's lines as the files of a group. Lines of one size are alike, so size orders them."""
    from pyspark.sql import Window as W

    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_quantity").cast("long").alias("size"))
    return li.withColumn("seq", F.row_number().over(W.partitionBy("g").orderBy("size")))


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, nbooks, i: the books of each supplier's file."""
    s = read(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("file"), (F.pmod("s_suppkey", F.lit(16)) + 1).alias("nbooks")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nbooks") - 1)))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """map, bit: the parts that each supplier ships, as bit positions."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("map"), F.col("l_partkey").alias("bit"))


def alloc_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """heap, seq, op, n, ts: events as a log of allocations ('A') and frees of the oldest live extent ('F')."""
    e = read(spark, sf_dir, "events")
    op = F.when(F.col("event_type").isin("signup", "purchase"), "A").when(F.col("event_type") == "error", "F")
    return e.select(F.col("user_id").alias("heap"), F.col("event_id").alias("seq"), op.alias("op"), (1 + F.pmod(F.floor("value"), F.lit(16))).cast("long").alias("n"), "ts").where("op is not null")

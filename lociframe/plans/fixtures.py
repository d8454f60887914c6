"""Allele counts and phenotypes made from the supplied order tables.

A locus is a part, a pool the customer's region or nation, an allele the line's return flag
and status, and a count the number of lines.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.model import ALLELES
from lociframe.operators.association import Phenotypes

# The allele of each return flag and line status.
ALLELE_OF = {"AF": "A", "AO": "T", "NF": "C", "NO": "G", "RF": "D", "RO": "N"}
KEY = {"region": "n_regionkey", "nation": "n_nationkey"}
POOLS = {"region": 5, "nation": 25}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def loci(spark: SparkSession, sf_dir: str, by: str = "region") -> DataFrame:
    """One aggregation: a cell of counts for each pool and allele."""
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey")).select("c_custkey", F.col(KEY[by]).alias("pool"))
    orders = table(spark, sf_dir, "orders").join(customers, F.expr("o_custkey = c_custkey")).select("o_orderkey", "pool")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.concat("l_returnflag", "l_linestatus").alias("kind"))
    kinds = {a: k for k, a in ALLELE_OF.items()}
    cells = [F.count(F.when((F.col("pool") == i) & (F.col("kind") == kinds[a]), 1)).alias(f"n{i}_{a}") for i in range(POOLS[by]) for a in ALLELES]
    counted = lines.join(orders, F.expr("l_orderkey = o_orderkey")).groupBy("l_partkey").agg(*cells)
    return counted.select(
        F.concat(F.lit("chr"), (F.col("l_partkey") % 5).cast("string")).alias("chr"), F.col("l_partkey").alias("pos"), F.lit("A").alias("ref"),
        F.array(*[F.lit(a) for a in ALLELES]).alias("alleles"), F.array(*[F.array(*[F.col(f"n{i}_{a}") for a in ALLELES]) for i in range(POOLS[by])]).alias("counts"),
    )


def phenotypes(spark: SparkSession, sf_dir: str, by: str = "region") -> Phenotypes:
    """Pool sizes and two traits: mean balance of customers, mean price of orders."""
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey")).withColumn("pool", F.col(KEY[by]))
    one = customers.groupBy("pool").agg(F.count("*").alias("size"), F.round(F.avg("c_acctbal"), 6).alias("trait0"))
    two = table(spark, sf_dir, "orders").join(customers, F.expr("o_custkey = c_custkey")).groupBy("pool").agg(F.round(F.avg("o_totalprice"), 6).alias("trait1"))
    got = {r.pool: r for r in one.join(two, "pool", "left").collect()}  # one row a pool
    rows = [got.get(i) for i in range(POOLS[by])]
    value = lambda r, c: float("nan") if r is None or r[c] is None else float(r[c])
    return Phenotypes(tuple(f"pool_{i}" for i in range(POOLS[by])), np.array([0.0 if r is None else float(r.size) for r in rows]), np.array([[value(r, "trait0"), value(r, "trait1")] for r in rows]))

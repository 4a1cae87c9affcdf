"""Connected components of a link table, by alternating large and small stars.

Links stay in tables throughout: each half step is a minimum per node (combined before the
shuffle) and a join, which adaptive execution splits where a node has very many links. Every round
is written to shared storage, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadledger.session import shared_dir, written


def _large_star(links: DataFrame) -> DataFrame:
    """Every node hands its smallest neighbour (or itself) to its larger neighbours."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every node hands its smallest neighbour to its smaller neighbours and to itself."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    handed = links.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return handed.unionByName(least.select("u", F.col("m").alias("v")))


def _settled(links: DataFrame) -> bool:
    """Does every linked node hang on one root, and no root on another node?"""
    ends = links.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        links.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    ends = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.filter((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1))).isEmpty()


def roots(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node that is not its component's smallest.

    ``links`` has columns a and b (numbers, a != b); repeated links and both directions are fine.
    """
    folder, step = shared_dir(links.sparkSession, "components"), 0
    now = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{folder}/0")
    while not _settled(now):
        step += 1
        now = written(_small_star(_large_star(now)).distinct(), f"{folder}/{step}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))

"""Connected components of a table of links, by alternating stars.

Large stars tie the greater neighbours of a node to its least neighbour, small
stars the lesser ones; a few rounds leave each node tied to the least node of
its component. The least neighbour of each node is aggregated before the
shuffle and staged, so a node with very many links is one row there, and the
join with the links can be split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaflow.plans.scratch import stage_table


def _least(pairs: DataFrame) -> DataFrame:
    return stage_table(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")


def _mark(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node in ``links`` (a, b bigint) but the roots themselves."""
    now = stage_table(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        both = now.selectExpr("a AS u", "b AS v").unionByName(now.selectExpr("b AS u", "a AS v"))
        large = both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stage_table(large, "links")
        tied = large.join(_least(large), "u")
        small = tied.selectExpr("v AS a", "m AS b").unionByName(tied.selectExpr("u AS a", "m AS b")).filter("a <> b").distinct()
        now, old = stage_table(small, "links"), mark
        mark = _mark(now)
        if mark == old:
            break
    return now.selectExpr("a AS node", "b AS root")

"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credtrace.llm.common import written


def heads(links: DataFrame, by_id: bool) -> DataFrame:
    """(node, head): of each linked node and its neighbours the first, by id or by a hash of the id."""
    order = lambda c: F.struct(F.lit(0).cast("long") if by_id else F.xxhash64(c), F.col(c).alias("id"))
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy(F.col("a").alias("node")).agg(F.min(order("b")).alias("m")).select(
        "node", F.least("m", order("node"))["id"].alias("head"))


def ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each linked node reaches; ``links`` has longs (a, b), nulls are ignored.

    Links are contracted: every node goes to the first of its neighbours and itself, the links that remain are those
    between different heads, and the next round sees these only. The first round goes by id, which settles groups around
    their smallest member at once, later ones by hash, which leaves a fixed share of the nodes on average, whatever their
    order. Every round is written to the shared folder, which ends its lineage. Minimums combine before the shuffle.
    """
    links = written(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(*ordered(F.col("a"), F.col("b"))).distinct())
    steps = []
    while not links.isEmpty():
        step = written(heads(links, not steps))
        steps.append(step)
        one, two = (step.select(F.col("node").alias(c), F.col("head").alias(f"to_{c}")) for c in "ab")
        links = written(links.join(one, "a").join(two, "b").where("to_a <> to_b").select(*ordered(F.col("to_a"), F.col("to_b"))).distinct())
    if not steps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = steps.pop()
    while steps:  # where a head went later, its nodes went as well
        labels = steps.pop().join(labels.select(F.col("node").alias("head"), F.col("head").alias("last")), "head", "left").select(
            "node", F.coalesce("last", "head").alias("head"))
    labels = written(labels)
    return labels.join(labels.groupBy("head").agg(F.min("node").alias("label")), "head").select("node", "label")

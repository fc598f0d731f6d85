"""Connected components of a link table, without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component) for every end of `edges` (a long, b long); component is the smallest id reachable.

    Each round takes the smallest label among the neighbours and then jumps to that label's own label, so the
    number of rounds grows with the logarithm of the longest path. Minima are combined before the shuffle, so a
    node with very many links is no large task.
    """
    both = scratch.keep(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b"), f"{name}-links")
    labels = scratch.keep(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("component")), f"{name}-0")
    step = 0
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "id").select("id", "component", F.least("component", "near").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("component").alias("root"))
        fresh = lower.join(jump, "low").select("id", "component", F.least("low", "root").alias("next"))
        step += 1
        fresh = fresh.select("id", F.col("next").alias("component"), (F.col("next") != F.col("component")).alias("moved"))
        fresh = scratch.keep(fresh, f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        moved = not fresh.where("moved").isEmpty()
        labels = fresh.drop("moved")
        if not moved:
            return labels

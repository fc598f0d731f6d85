"""Total ownership without a bound: strongly connected parts of the giving graph, and sums of products over what joins them.

A simple path runs inside one part, leaves it for good by one edge, runs inside the next, and so on. So the sum over all
simple paths is a product-sum over the graph of parts, which has no cycles, and single paths are only followed inside parts,
where those that hold the same nodes and end at the same one go on together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.sources.shared import Steps


def on_cycles(links: DataFrame, steps: Steps) -> DataFrame:
    """The links (cycle, src, dst) left when those that begin where none ends, or end where none begins, are taken away again and again.

    What is left lies on cycles or between them.
    """
    held = links.count()
    while held:
        ends, begins = links.select("cycle", F.col("dst").alias("src")).distinct(), links.select("cycle", F.col("src").alias("dst")).distinct()
        links = steps.keep(links.join(ends, ["cycle", "src"], "left_semi").join(begins, ["cycle", "dst"], "left_semi"))
        left = links.count()
        if left == held:
            break
        held = left
    return links


def _spread(links: DataFrame, labels: DataFrame, steps: Steps) -> DataFrame:
    """(cycle, id, label): the largest label of all nodes from which a node can be reached, its own included."""
    while True:
        given = links.join(labels.withColumnRenamed("id", "src"), ["cycle", "src"]).groupBy("cycle", F.col("dst").alias("id")).agg(F.max("label").alias("given"))
        made = labels.join(given, ["cycle", "id"], "left").select("cycle", "id", F.greatest("label", "given").alias("label"), (F.col("given") > F.col("label")).alias("moved"))
        made = steps.keep(made)
        labels = made.drop("moved")
        if made.where("moved").isEmpty():
            return labels


def strong_parts(links: DataFrame, steps: Steps) -> DataFrame:
    """(cycle, id, part) of the nodes that lie on a cycle; part is the largest id of the nodes that reach each other.

    Each round gives a node the largest id that reaches it. Among nodes of one such id, those that reach the node of that id
    are its part. Parts are taken out, and the round begins anew with what is left.
    """
    links, found = on_cycles(links, steps), []
    while not links.isEmpty():
        nodes = links.select("cycle", F.col("src").alias("id")).union(links.select("cycle", "dst")).distinct()
        colour = _spread(links, nodes.withColumn("label", F.col("id")), steps)
        source, target = colour.select("cycle", F.col("id").alias("src"), F.col("label").alias("a")), colour.select("cycle", F.col("id").alias("dst"), F.col("label").alias("b"))
        alike = steps.keep(links.join(source, ["cycle", "src"]).join(target, ["cycle", "dst"]).where("a = b").select("cycle", "src", "dst", "a"))
        members = steps.keep(colour.where("id = label").select("cycle", "id", F.col("label").alias("part")))
        front = members
        while not front.isEmpty():
            back = alike.join(front.select("cycle", F.col("id").alias("dst")), ["cycle", "dst"]).select("cycle", F.col("src").alias("id"), F.col("a").alias("part")).distinct()
            front = steps.keep(back.join(members, ["cycle", "id"], "left_anti"))
            members = steps.keep(members.union(front))
        found.append(members)
        # A part of one node is a node between cycles.
        links = steps.keep(links.join(members.select("cycle", F.col("id").alias("src")), ["cycle", "src"], "left_anti").join(members.select("cycle", F.col("id").alias("dst")), ["cycle", "dst"], "left_anti"))
        links = on_cycles(links, steps)
    if not found:
        return links.select("cycle", F.col("src").alias("id"), F.col("dst").alias("part"))
    made = reduce(DataFrame.union, found)
    sizes = made.groupBy("cycle", "part").agg(F.count("*").alias("n")).where("n > 1")
    return steps.keep(made.join(sizes.select("cycle", "part"), ["cycle", "part"], "left_semi").select("cycle", "id", "part"))


def inside(links: DataFrame, parts: DataFrame, steps: Steps) -> DataFrame:
    """(cycle, src, dst, weight, paths): over the simple paths within a part, the empty one included, the sums of their products."""
    a = parts.select("cycle", F.col("id").alias("src"), F.col("part").alias("a"))
    b = parts.select("cycle", F.col("id").alias("dst"), F.col("part").alias("b"))
    within = steps.keep(links.join(a, ["cycle", "src"]).join(b, ["cycle", "dst"]).where("a = b").select("cycle", F.col("src").alias("at"), "dst", F.col("weight").alias("next")))
    paths = parts.select("cycle", F.col("id").alias("src"), F.col("id").alias("at"), F.array("id").alias("nodes"), F.lit(1.0).alias("weight"), F.lit(1).cast("long").alias("paths"))
    found = []
    while True:
        paths = steps.keep(paths)
        if found and paths.isEmpty():
            break
        found.append(paths.groupBy("cycle", "src", F.col("at").alias("dst")).agg(F.sum("weight").alias("weight"), F.sum("paths").alias("paths")))
        grown = paths.join(within, ["cycle", "at"]).where(~F.array_contains("nodes", F.col("dst")))
        grown = grown.select("cycle", "src", F.col("dst").alias("at"), F.array_sort(F.concat("nodes", F.array("dst"))).alias("nodes"), (F.col("weight") * F.col("next")).alias("weight"), "paths")
        paths = grown.groupBy("cycle", "src", "at", "nodes").agg(F.sum("weight").alias("weight"), F.sum("paths").alias("paths"))
    return steps.keep(reduce(DataFrame.union, found).groupBy("cycle", "src", "dst").agg(F.sum("weight").alias("weight"), F.sum("paths").alias("paths")))


def total_ownership(weighted: DataFrame, sources: DataFrame) -> DataFrame:
    """(cycle, source, target, pct, paths): over all simple paths of edges (cycle, src, dst, weight), the sum of their products of weights.

    pct is rounded to nine places, so that it doesn't depend on the order in which sums are made. Rows grow with the
    pairs of nodes that reach each other; inside a part, with its sets of nodes, which no formulation of this sum escapes.
    """
    with Steps(weighted.sparkSession, "ownership") as steps:
        links = steps.keep(weighted.where("src <> dst").select("cycle", "src", "dst", "weight"))
        parts = strong_parts(links.select("cycle", "src", "dst").distinct(), steps)
        within = inside(links, parts, steps)
        a = parts.select("cycle", F.col("id").alias("src"), F.col("part").alias("a"))
        b = parts.select("cycle", F.col("id").alias("dst"), F.col("part").alias("b"))
        across = links.join(a, ["cycle", "src"], "left").join(b, ["cycle", "dst"], "left").where("a is null or b is null or a <> b")
        across = steps.keep(across.select("cycle", F.col("src").alias("at"), "dst", F.col("weight").alias("next")))
        # `front` has what enters a part; the sums within carry it on to the part's other nodes.
        front = sources.select("cycle", "source", F.col("source").alias("at"), F.lit(1.0).alias("pct"), F.lit(1).cast("long").alias("paths"))
        found = []
        while True:
            inner = within.select("cycle", F.col("src").alias("at"), F.col("dst").alias("to"), F.col("weight").alias("w"), F.col("paths").alias("n"))
            there = front.join(inner, ["cycle", "at"], "left").select("cycle", "source", F.coalesce("to", "at").alias("at"), (F.col("pct") * F.coalesce("w", F.lit(1.0))).alias("pct"), (F.col("paths") * F.coalesce("n", F.lit(1))).alias("paths"))
            there = steps.keep(there.groupBy("cycle", "source", "at").agg(F.sum("pct").alias("pct"), F.sum("paths").alias("paths")))
            if found and there.isEmpty():
                break
            found.append(there)
            front = there.join(across, ["cycle", "at"]).groupBy("cycle", "source", F.col("dst").alias("at")).agg(F.sum(F.col("pct") * F.col("next")).alias("pct"), F.sum("paths").alias("paths"))
        reached = reduce(DataFrame.union, found).where("source <> at")
        made = reached.groupBy("cycle", "source", F.col("at").alias("target")).agg(F.round(F.sum("pct"), 9).alias("pct"), F.sum("paths").alias("paths"))
        return steps.result(made)

"""Money paths: shares of ownership, weighted edges, and what can be reached."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.expressions import entity_bucket, ratio
from sluice.operators.ownership import total_ownership
from sluice.sources.shared import BucketedTables, written


def shares(all_edges: DataFrame, totals: DataFrame) -> DataFrame:
    """(cycle, src, dst, weight): what each giver's money is of a committee's contributions; committees without any have no shares."""
    given = all_edges.where("list_name in ('top_indv_contributors', 'top_cmte_contributors')").select("cycle", F.col("cp_id").alias("src"), F.col("owner_id").alias("dst"), "amt")
    into = totals.where("contributions_amt <> 0").select("cycle", F.col("cmte_id").alias("dst"), "contributions_amt")
    return given.join(into, ["cycle", "dst"]).select("cycle", "src", "dst", ratio(F.col("amt"), F.col("contributions_amt")).alias("weight"))


def total_share(weighted: DataFrame, sources: DataFrame, hops: int | None = None) -> DataFrame:
    """(cycle, source, target, pct, paths, max_hops): over simple paths, the sum of their products of shares.

    Without `hops`, see ownership.total_ownership; max_hops is null. With it, paths are followed up to so many edges. Weighted edges beyond the first hop go from committee to committee. Paths
    of one length that hold the same nodes and end at the same one are extended together.
    """
    if hops is None:
        return total_ownership(weighted, sources).withColumn("max_hops", F.lit(None).cast("int"))
    first = weighted.join(sources.select("cycle", F.col("source").alias("src")), ["cycle", "src"]).where("src <> dst")
    paths = first.select("cycle", F.col("src").alias("source"), F.col("dst").alias("target"), F.array("src", "dst").alias("path"), "weight", F.lit(1).cast("long").alias("n"))
    between = written(weighted.where(entity_bucket(F.col("src")) == "committee").select("cycle", F.col("src").alias("target"), "dst", F.col("weight").alias("next")), "between")
    found, hop = None, 1
    while True:
        paths = written(paths, f"paths-{hop}")
        # Rounded terms are added as decimals, so that the order of the paths doesn't matter.
        part = paths.groupBy("cycle", "source", "target").agg(F.sum(F.round("weight", 12).cast("decimal(28,12)")).alias("pct"), F.sum("n").alias("paths"))
        found = part if found is None else found.union(part)
        if hop == hops:
            break
        hop += 1
        merged = paths.groupBy("cycle", "source", "target", F.array_sort("path").alias("path")).agg(F.sum(F.col("weight").cast("decimal(38,24)")).cast("double").alias("sum"), F.min("weight").alias("only"), F.sum("n").alias("n"), F.count("*").alias("rows"))
        merged = merged.withColumn("weight", F.when(F.col("rows") == 1, F.col("only")).otherwise(F.col("sum")))
        paths = merged.join(between, ["cycle", "target"]).where(~F.array_contains("path", F.col("dst")))
        paths = paths.select("cycle", "source", F.col("dst").alias("target"), F.concat("path", F.array("dst")).alias("path"), (F.col("weight") * F.col("next")).alias("weight"), "n")
    return found.groupBy("cycle", "source", "target").agg(F.sum("pct").cast("double").alias("pct"), F.sum("paths").alias("paths")).withColumn("max_hops", F.lit(hops).cast("int"))


#: Type of the edges that each list of counterparties makes. Money leaves the owner in the first three, and comes to the owner in the others.
EDGE_TYPES = {
    "indv_recipients": "donor_out", "transfer_recipients": "cmte_out", "top_exp_recipients": "exp_out",
    "top_indv_contributors": "donor_in", "top_cmte_contributors": "cmte_in", "cand_senders": "cand_in",
}
OUTWARD = ("indv_recipients", "transfer_recipients", "top_exp_recipients")


def flows(all_edges: DataFrame) -> DataFrame:
    """(cycle, src, dst, edge_type, amt): money out of donors and committees, and money into committees and candidates, as each side lists it."""
    kind = F.element_at(F.create_map(*(F.lit(x) for pair in EDGE_TYPES.items() for x in pair)), F.col("list_name"))
    out = F.col("list_name").isin(*OUTWARD)
    src, dst = F.when(out, F.col("owner_id")).otherwise(F.col("cp_id")), F.when(out, F.col("cp_id")).otherwise(F.col("owner_id"))
    return all_edges.where(F.col("list_name").isin(*EDGE_TYPES)).select("cycle", src.alias("src"), dst.alias("dst"), kind.alias("edge_type"), "amt")


def received(committees: DataFrame, individuals: DataFrame, candidates: DataFrame) -> DataFrame:
    """(cycle, dst, received): all money that came to an entity, by the totals of each kind; one that files and is paid as well has both."""
    rows = (
        committees.select("cycle", F.col("cmte_id").alias("dst"), F.col("total_in_amt").alias("amt"))
        .union(individuals.select("cycle", "indv_id", "in_amt"))
        .union(candidates.select("cycle", "cand_id", "in_amt"))
    )
    return rows.groupBy("cycle", "dst").agg(F.sum(F.col("amt").cast("decimal(28,2)")).alias("received"))


def flow_edges(all_edges: DataFrame, incoming: DataFrame) -> DataFrame:
    """(cycle, src, dst, edge_type, weight): flows as parts of all that their receiver has received; 0 where that is nothing."""
    made = flows(all_edges).join(incoming, ["cycle", "dst"], "left")
    return made.select("cycle", "src", "dst", "edge_type", ratio(F.col("amt"), F.col("received")).alias("weight"))


def nodes(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id, node_type): indv, cand, pac, or pcc for a candidate's principal committee."""
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    own = candidates.where("pcc <> ''").select(F.col("pcc").alias("id")).distinct().withColumn("own", F.lit(True))
    kind = entity_bucket(F.col("id"))
    made = F.when(kind == "individual", "indv").when(kind == "candidate", "cand").when(F.col("own"), "pcc").otherwise("pac")
    return ids.join(own, "id", "left").select("id", made.alias("node_type"))


def reach(edges: DataFrame, roots: Sequence[str], hops: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """(*keys, id, hop): all nodes that can be reached from the roots, each with its first hop; edges of all given types are followed.

    Rows that differ in `keys` (such as the cycle) are graphs of their own. The search ends where a hop finds nothing
    new, or after `hops` if given. Links are stored in buckets of their source and what is found in buckets of its id, in the shared
    folder, so a hop joins both as they lie and shuffles only the nodes that it meets.
    """
    spark = edges.sparkSession
    with BucketedTables(spark, "reach") as tables:
        links = tables.append("links", edges.select(*keys, "src", "dst"), [*keys, "src"], distinct=True)
        if keys:
            start = links.select(*keys).distinct().withColumn("id", F.explode(F.array(*map(F.lit, dict.fromkeys(roots)))))
        else:
            start = spark.createDataFrame([(r,) for r in dict.fromkeys(roots)], "id string")
        seen = tables.append("seen", start.withColumn("hop", F.lit(0)), [*keys, "id"])
        hop = 0
        while hops is None or hop < hops:
            front = seen.where(F.col("hop") == hop).select(*keys, F.col("id").alias("src"))
            hop += 1
            met = tables.dealt(links.join(front, [*keys, "src"]).select(*keys, F.col("dst").alias("id")), [*keys, "id"]).distinct()
            fresh = met.join(seen.select(*keys, "id"), [*keys, "id"], "left_anti")
            seen = tables.append("seen", fresh.withColumn("hop", F.lit(hop)), [*keys, "id"])
            if seen.where(F.col("hop") == hop).isEmpty():
                break
        return tables.rows("seen", [*keys, "id", "hop"])

"""Ownership over all simple paths and weights of edges, against brute force and by hand."""

import random
from decimal import Decimal

import pytest

from sluice.operators import edges, graph, ledger, ownership, totals
from sluice.sources.shared import Steps


def simple_paths(share):
    """(source, target): (sum of products, paths), by walking every simple path."""
    out, onward = {}, {}
    for (a, b), w in share.items():
        if a != b:
            onward.setdefault(a, []).append((b, w))

    def walk(start, at, seen, product):
        for b, w in onward.get(at, []):
            if b not in seen:
                pct, n = out.get((start, b), (0.0, 0))
                out[start, b] = (pct + product * w, n + 1)
                walk(start, b, seen | {b}, product * w)

    for a in onward:
        walk(a, a, {a}, 1.0)
    return out


def graphs():
    rnd = random.Random(11)
    two = {(a, b): rnd.random() for part in ("ABCD", "WXYZ") for a in part for b in part if a != b and rnd.random() < 0.8}
    yield two | {("D", "W"): 0.5, ("C", "Y"): 0.25, ("Y", "s1"): 0.1, ("A", "s1"): 0.2, ("i", "A"): 0.3, ("s1", "s2"): 0.9, ("A", "A"): 5.0}
    yield {(f"n{a}", f"n{b}"): rnd.random() for a in range(9) for b in range(9) if rnd.random() < 0.25}
    yield {("a", "b"): 0.5, ("b", "c"): 0.5, ("a", "c"): 0.25}
    yield {("a", "a"): 1.0}


def test_ownership_is_that_of_all_simple_paths(spark):
    found, rows = {}, []
    for cycle, share in enumerate(graphs()):
        rows += [(cycle, a, b, w) for (a, b), w in share.items()]
        found |= {(cycle, *pair): value for pair, value in simple_paths(share).items()}
    weighted = spark.createDataFrame(rows, "cycle int, src string, dst string, weight double")
    sources = weighted.selectExpr("cycle", "src AS source").distinct()
    got = {(r.cycle, r.source, r.target): (r.pct, r.paths) for r in ownership.total_ownership(weighted, sources).collect()}
    assert {k: n for k, (_, n) in got.items()} == {k: n for k, (_, n) in found.items()}
    assert all(got[k][0] == pytest.approx(found[k][0], abs=2e-9) for k in found)
    assert ownership.total_ownership(weighted.limit(0), sources).collect() == []
    assert {r.target for r in ownership.total_ownership(weighted, sources.where("cycle = 2 and source = 'a'")).collect()} == {"b", "c"}


def test_strong_parts_are_the_nodes_that_reach_each_other(spark):
    for share in graphs():
        reach = {}
        for a, b in simple_paths(share):
            reach.setdefault(a, set()).add(b)
        nodes = {x for pair in share for x in pair}
        parts = {v: max(u for u in nodes if u == v or (u in reach.get(v, ()) and v in reach.get(u, ()))) for v in nodes}
        wanted = sorted((v, p) for v, p in parts.items() if sum(q == p for q in parts.values()) > 1)
        links = spark.createDataFrame([(1, a, b) for a, b in share if a != b], "cycle int, src string, dst string")
        with Steps(spark, "test") as steps:
            assert sorted((r.id, r.part) for r in ownership.strong_parts(links, steps).collect()) == wanted


def test_weights_are_parts_of_all_that_the_receiver_has(spark):
    """Committee C1 receives 60 from a person, 30 from C2 and 10 as another receipt; it pays 25 to candidate H1, who has 50, and 5 to a shop, which has 20."""
    c1, c2, h1 = "C00000001", "C00000002", "H00000001"
    columns = "cycle int, filer_id string, tx_type string, memo_code string, other_id string, name string, employer string, occupation string, zip string, tx_amt decimal(18,2), tx_id string"
    given = [(c1, "15", "", 60), (c1, "15", c2, 30), (c1, "17R", c2, 10), (c1, "24K", h1, 25), (c2, "24K", h1, 25), (c2, "24K", c1, 40)]
    rows = [(2000, filer, kind, "", other, "ANN", "", "", "1", amount, str(k)) for k, (filer, kind, other, amount) in enumerate(given)]
    book = ledger.classify(ledger.normalize(spark.createDataFrame([(*r[:9], Decimal(r[9]), r[10]) for r in rows], columns)))
    paid = ledger.expense_ledger(spark.createDataFrame([(2000, c1, "SHOP", "9", 5, "a"), (2000, c2, "SHOP", "9", 15, "b")], "cycle int, cmte_id string, name string, zip string, tx_amt int, sub_id string").selectExpr("cycle", "cmte_id", "name", "zip", "cast(tx_amt AS decimal(18,2)) AS tx_amt", "sub_id"))
    incoming = graph.received(totals.committee_totals(totals.committee_postings(book, paid)), totals.individual_totals(book, paid), totals.candidate_totals(book))
    got = {(r.src[:9] if len(r.src) == 9 else "person", r.dst[:9] if len(r.dst) == 9 else "shop", r.edge_type): round(r.weight, 6) for r in graph.flow_edges(edges.edges(book, paid), incoming).collect()}
    assert got == {
        ("person", c1, "donor_out"): 0.6, ("person", c1, "donor_in"): 0.6, (c2, c1, "cmte_in"): 0.4, (c2, c1, "cmte_out"): 0.4,
        (c1, h1, "cmte_out"): 0.5, (c2, h1, "cmte_out"): 0.5, (c1, h1, "cand_in"): 0.5, (c2, h1, "cand_in"): 0.5, (c1, "shop", "exp_out"): 0.25, (c2, "shop", "exp_out"): 0.75,
    }

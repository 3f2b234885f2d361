"""Components by contraction in blocks, and by star steps where there are several."""

import random

import pytest

from matchlake.operators import graph


def plain(edges):
    least = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for x, y in edges:
            low = min(least[x], least[y])
            changed |= least[x] != low or least[y] != low
            least[x] = least[y] = low
    return {(x, r) for x, r in least.items() if x != r}


@pytest.mark.parametrize("kind", ["bigint", "string", "binary"])
@pytest.mark.parametrize("most", [None, 60])
def test_components_of_chains_and_trees(spark, monkeypatch, kind, most):
    if most:
        monkeypatch.setattr(graph, "EDGES", most)
    pick = random.Random(3)
    edges = [(i, i + 1) for i in range(1, 90)] + [(i, pick.randrange(200, i)) for i in range(201, 300)] + [(400, 400), (500, 501), (501, 500), (500, 501)]
    name = {"bigint": lambda x: x, "string": lambda x: f"é{x}", "binary": lambda x: (x * 7919 % 65521).to_bytes(2, "big")}[kind]
    edges = [(name(x), name(y)) for x, y in edges]
    found = graph.smallest_member(spark.createDataFrame([*edges, (None, name(1))], f"x {kind}, y {kind}"), "x", "y").collect()
    assert {(bytes(a), bytes(b)) if kind == "binary" else (a, b) for a, b in found} == plain(edges)
    assert len(found) == len(plain(edges))


def test_components_of_no_edges(spark):
    assert graph.smallest_member(spark.createDataFrame([], "x bigint, y bigint"), "x", "y").collect() == []


def test_few_edges_take_a_few_jobs(spark):
    edges = spark.range(2000).selectExpr("id as x", "id + 1 as y")
    context = spark.sparkContext
    context.setJobGroup("components", "a chain")
    try:
        found = graph.smallest_member(edges, "x", "y").collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert {tuple(r) for r in found} == {(i, 0) for i in range(1, 2001)}
    assert len(context.statusTracker().getJobIdsForGroup("components")) <= 8

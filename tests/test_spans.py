"""Overlapping spans and contained names against all pairs, and plans without products."""

import datetime
import random

import pytest

from matchlake.operators import spans
from matchlake.plans import evidence, events

SF = "/root/testdata/sf0.001"


def rows(pick, n):
    start = datetime.date(1999, 1, 1)
    out = []
    for i in range(n):
        low = start + datetime.timedelta(pick.randrange(-200, 400))
        out.append((i, pick.randrange(6), low, low + datetime.timedelta(pick.choice([0, 1, 5, 30, 300]))))
    return out


@pytest.mark.parametrize(("days", "least"), [(64, 0), (7, 2), (1, 0), (1000, 30)])
def test_overlapping(spark, days, least):
    pick = random.Random(days)
    left, right = rows(pick, 60), rows(pick, 70)
    schema = "{0} int, k int, {0}lo date, {0}hi date"
    found = [(r.x, r.y) for r in spans.overlapping(spark.createDataFrame(left, schema.format("x")), spark.createDataFrame(right, schema.format("y")), ["k"], days, least).collect()]
    want = [(a[0], b[0]) for a in left for b in right if a[1] == b[1] and (min(a[3], b[3]) - max(a[2], b[2])).days >= least]
    assert sorted(found) == sorted(want) and want


def test_containing(spark):
    pick = random.Random(2)
    word = lambda n: "".join(pick.choice("abé ") for _ in range(n))
    texts = ["paris open", "open", "a", "", None, "paris", *[word(pick.randrange(1, 20)) for _ in range(80)]]
    parts = ["paris", "op", "n", "", None, "open paris", "paris open", *[word(pick.randrange(1, 6)) for _ in range(80)]]
    frames = [spark.createDataFrame([(x,) for x in v] * 2, f"{c} string") for v, c in ((texts, "text"), (parts, "part"))]
    found = [tuple(r) for r in spans.containing(frames[0], "text", frames[1], "part").collect()]
    want = {(t, p) for t in texts for p in parts if t and p and p in t}
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 100


@pytest.mark.parametrize("query", [evidence.event_attributes, evidence.surface_cache_lookup, events.event_resolve_unique])
def test_names_meet_by_equality(spark, query):
    plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Join" in plan


@pytest.mark.parametrize(("query", "who"), [(evidence.draw_identity, "abp"), (evidence.merged_candidates, "ab"), (evidence.gate_split_identity, "p"), (events.event_coalesce, "ab")])
def test_spans_meet_by_bins(spark, query, who):
    """No two groups are joined on players or pairs alone."""
    plan = query(spark, SF)._jdf.queryExecution().analyzed().toString()
    joins = [line for line in plan.splitlines() if " Join " in line and any(f"({c}#" in line for c in who)]
    assert all("_bin#" in line for line in joins)

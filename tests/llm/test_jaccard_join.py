"""The join through a token-group matrix against all pairs."""

import random
from collections import defaultdict

import pytest

from matchlake.llm import jaccard_join
from tests.llm import brute


def expected(rows, size, percent):
    component, ids = brute.groups([t for _, t in rows], size, percent), defaultdict(list)
    for (i, _), c in zip(rows, component, strict=True):
        ids[c].append(i)
    least = {c: min((i for i in x if i is not None), default=None) for c, x in ids.items()}
    return sorted(((i, len(brute.shingles(t, size)), least[c] if brute.words(t) else i) for (i, t), c in zip(rows, component, strict=True)), key=repr)


def families(count, pick):
    """Chains of edited copies, near copies of one text that link across groups, unlike texts around one passage, short texts."""
    text = lambda n, words=400: [f"w{pick.randrange(words)}" for _ in range(n)]
    out, passage = [], text(40)
    for _ in range(count):
        base = text(pick.choice([5, 9, 30, 70, 200]))
        out.append(base)
        for _ in range(pick.randrange(5)):
            base = [*base]
            for _ in range(pick.randrange(1, 3)):
                base[pick.randrange(len(base))] = f"n{pick.randrange(99)}"
            out.append(base)
        out.append(text(pick.randrange(60)) + passage + text(pick.randrange(20)))
        out.append(passage[: pick.randrange(1, 40)])
    return [(pick.randrange(10**6), " ".join(x)) for x in out]


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (2, 60), (1, 90)])
def test_jaccard_on_odd_rows(docs, rows, size, percent):
    found = sorted(map(tuple, jaccard_join.jaccard_components(docs, size, percent).collect()), key=repr)
    assert found == expected(rows, size, percent)


@pytest.mark.parametrize(("group", "block", "part", "percent"), [(64, 4 << 20, 2_000_000, 85), (2, 3000, 500, 85), (3, 1000, 100, 70)])
def test_jaccard_on_families(spark, monkeypatch, group, block, part, percent):
    """In one block and group, and in many small ones."""
    for name, value in (("GROUP", group), ("BLOCK", block), ("PART", part)):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = families(60, random.Random(group + percent))
    found = sorted(map(tuple, jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), 4, percent).collect()), key=repr)
    want = expected(rows, 4, percent)
    assert found == want
    assert len({c for _, _, c in want}) < len(rows) - 40


def test_links_across_groups_are_bounded_first(spark, monkeypatch):
    """Near copies whose smallest tokens differ are joined by queries of groups, and unlike texts open none."""
    monkeypatch.setattr(jaccard_join, "GROUP", 4)
    pick = random.Random(1)
    base = [f"b{i}" for i in range(300)]
    rows = [(i, " ".join([*base[:k], f"x{i}", *base[k + 1 :]])) for i, k in enumerate(pick.sample(range(300), 60))]
    rows += [(100 + i, " ".join([*base[:100], *[f"y{i}-{j}" for j in range(200)]])) for i in range(20)]
    found = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(i, 0 if i < 100 else i) for i, _ in rows}


def test_a_family_is_few_groups(spark, monkeypatch):
    """Near copies with many different smallest tokens share a group, so pairs of groups don't grow with the square of a family."""
    seen, meeting = [], jaccard_join.meeting
    monkeypatch.setattr(jaccard_join, "meeting", lambda *x: seen.append(meeting(*x)) or seen[-1])
    pick = random.Random(2)
    base = [f"b{i}" for i in range(80)]
    edit = lambda i: " ".join(f"x{i}-{k}" if k in spots else word for k, word in enumerate(base)) if (spots := set(pick.sample(range(80), 3))) else ""
    rows = [(i, edit(i)) for i in range(120)]
    found = sorted(map(tuple, jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), 4, 85).collect()), key=repr)
    assert found == expected(rows, 4, 85)
    assert sum(x.count() for x in seen) <= 3


def test_pairs_of_groups_cross_few_at_a_time(spark):
    """Rows of two whole groups come to Python in batches of bounded bytes."""
    from matchlake.llm import blocks

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    blocks.narrow_batches(spark)
    wide = spark.range(64, numPartitions=1).selectExpr("cast(repeat('x', 1000000) as binary) as tokens")
    found = [r.n for r in wide.mapInArrow(sizes, "n long").collect()]
    assert sum(found) == 64 and max(found) <= 10

"""Names of draws matched to participants, against the plain greedy loop."""

import difflib
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from matchlake.operators import assign


def key(name):
    plain = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)).lower()
    return re.sub(r"\s+", " ", re.sub(r"[-.'`]", " ", plain)).strip()


def plain(slots, pool):
    """Exact keys, then pairs sorted by shared words and similarity (stable), each side once."""
    slots, pool = list(dict.fromkeys(s for s in slots if s)), list(dict.fromkeys(p for p in pool if p))
    own = {}
    for p in pool:
        own.setdefault(key(p), p)
    out = {s: (own[key(s)], "key") for s in slots if key(s) in own}
    matched = {key(s) for s in out}
    pairs = [(len(set(key(s).split()) & set(key(p).split())), difflib.SequenceMatcher(None, key(s), key(p)).ratio(), s, p) for s in slots if s not in out for p in pool if key(p) not in matched]
    used = set()
    for n, _, s, p in sorted(pairs, key=lambda x: (x[0], x[1]), reverse=True):
        if n and s not in out and p not in used:
            out[s] = (p, "similar")
            used.add(p)
    return {s: out.get(s, (s, "none")) for s in slots}


EVENTS = {
    "one": (["Alexander Shevchenko", "Daniel Vallejo", "Kwon Soon-woo", "Ana Ivanović", "Nobody Known", None, "Ana Ivanović"], ["Aleksandr Shevchenko", "Adolfo Daniel Vallejo", "SoonWoo Kwon", "Ana Ivanovic", "Daniel Evans"]),
    "ties": (["A Smith", "B Smith", "C Smith", ""], ["X Smith", "Y Smith", None, "X Smith", "Z Smith", "W Jones"]),
    "chain": (["Maria Lopez Garcia", "Lopez Garcia", "Garcia"], ["Lopez Garcia Ruiz", "Garcia Ruiz", "Maria Lopez"]),
    "empty": ([], ["Someone"]),
}


def check(spark, events):
    slots = spark.createDataFrame([(e, i, s) for e, (x, _) in events.items() for i, s in enumerate(x)], "event string, place int, raw string").repartition(3)
    pool = spark.createDataFrame([(e, i, p) for e, (_, x) in events.items() for i, p in enumerate(x)], "event string, place int, player string").repartition(3)
    found = {(r.event, r.raw): (r.player, r.how) for r in assign.draw_names(slots, pool).collect()}
    assert found == {(e, s): v for e, (x, y) in events.items() for s, v in plain(x, y).items()}
    return found


def test_draw_names(spark):
    found = check(spark, EVENTS)
    assert found["one", "Kwon Soon-woo"] == ("SoonWoo Kwon", "similar") and found["one", "Ana Ivanović"] == ("Ana Ivanovic", "key") and found["one", "Nobody Known"][1] == "none"


@pytest.mark.parametrize("seed", [1, 2])
def test_draw_names_at_random(spark, seed):
    pick = random.Random(seed)
    words = ["Ann", "Anna", "Lee", "Li", "Kim", "Park", "Smith", "Smyth", "De", "La", "Cruz", "Cruiz"]
    name = lambda: " ".join(pick.choice(words) for _ in range(pick.randint(1, 4)))
    check(spark, {f"e{k}": ([name() for _ in range(pick.randint(0, 25))], [name() for _ in range(pick.randint(0, 25))]) for k in range(8)})


def test_greedy_takes_each_side_once(spark):
    pick = random.Random(4)
    rows = [(1, a, b, pick.randint(0, 3), k) for k, (a, b) in enumerate((a, b) for a in range(20) for b in range(20) if pick.random() < 0.4)]
    found = {(r.a, r.b) for r in assign.greedy(spark.createDataFrame(rows, "g int, a int, b int, cost int, k int"), "g", "a", "b", [F.col("cost"), F.col("k")]).collect()}
    want, left, right = set(), set(), set()
    for _, a, b, _, _ in sorted(rows, key=lambda r: (r[3], r[4])):
        if a not in left and b not in right:
            want.add((a, b))
            left.add(a)
            right.add(b)
    assert found == want


def test_registered_draw_names(spark):
    """The registered query against the loop, over the names that it made."""
    from matchlake.plans import evidence

    kept = {}

    def keep(slots, pool):
        kept["frames"] = slots, pool
        return assign.draw_names(slots, pool)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(evidence, "draw_names", keep)
        found = {(r.event, r.raw): (r.player, r.how) for r in evidence.draw_names_reconciled(spark, "/root/testdata/sf0.01").collect()}
    slots, pool = ({} for _ in range(2))
    for frame, column, out in zip(kept["frames"], ("raw", "player"), (slots, pool), strict=True):
        for r in sorted(frame.collect(), key=lambda r: r.place):
            out.setdefault(r.event, []).append(r[column])
    assert found == {(e, s): v for e in slots for s, v in plain(slots[e], pool[e]).items()} and {h for _, h in found.values()} >= {"key", "similar"}

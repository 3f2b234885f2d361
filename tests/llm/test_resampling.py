"""Importance resampling and fill-in-the-middle forms against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from matchlake.llm import fill_in_middle, resampling

TARGET = [(1, "w1 w2 The w3"), (2, "ÄÖ naïve don't"), (3, None), (4, ""), (5, "w1 w2 w9 w1 w2")]


def grams(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return own, [" ".join(own[i : i + k]) for k in (1, 2, 3) for i in range(len(own) - k + 1)]


def resampled(rows, target, buckets=10000, percent=5, least=20):
    place = lambda x: zlib.crc32(x.encode()) % buckets
    each = [(i, *grams(t)) for i, t in rows]
    s, t = (Counter(place(x) for g in found for x in g) for found in ([g for _, _, g in each], [grams(x)[1] for _, x in target]))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for i, own, g in each:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(place(x)) for x in g)
        out.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(own)])
    enough = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(enough[: percent * len(enough) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


@pytest.mark.parametrize(("percent", "buckets"), [(5, 10000), (60, 50)])
def test_resampling(spark, docs, rows, percent, buckets):
    target = spark.createDataFrame(TARGET, "item_id bigint, text string")
    want = resampled(rows, TARGET, buckets, percent)
    found = [tuple(r) for r in resampling.resample(docs, target, percent=percent, buckets=buckets).collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert sum(r[4] is not None for r in want) >= (1 if percent == 5 else 10)


def test_ranks_over_many_partitions(spark):
    pick = np.random.default_rng(3)
    values = [(int(x), i) for i, x in enumerate(pick.integers(0, 50, 5000))]
    df = spark.createDataFrame(values, "score bigint, id bigint").repartition(9)
    from pyspark.sql import functions as F

    found = sorted((r.rank, r.score, r.id) for r in resampling.ranked(df, [F.desc("score"), F.asc("id")]).collect())
    assert found == [(k + 1, x, i) for k, (x, i) in enumerate(sorted(values, key=lambda v: (-v[0], v[1])))]


def test_resampling_on_an_empty_target(spark, docs, rows):
    found = [tuple(r) for r in resampling.resample(docs, spark.createDataFrame([], "item_id bigint, text string")).collect()]
    assert sorted(found, key=repr) == sorted(resampled(rows, []), key=repr)


def middles(rows):
    out = []
    for i, text in rows:
        text = text or ""
        hexes = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(hexes[8 * k : 8 * k + 8], 16) for k in range(4))
        n = len(text)
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
            out.append((i, n, "plain", None, None, text))
        elif h4 % 100 < 20:
            out.append((i, n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"))
        else:
            out.append((i, n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"))
    return out


ODD = [(900 + k, t) for k, t in enumerate(["a <P> b", "<S", "<<S>M>", "x<M>", "<P<S<M< >", "日本語テキスト" * 90, "😀é" * 700, "a" * 2_000_000 + "ß" * 9, "<M<M<M"] * 3)]


@pytest.mark.parametrize("crowd", [500, 1])
def test_fill_in_middle(spark, rows, docs, monkeypatch, crowd):
    """With texts of one row each, and with every repeated text dealt to parts."""
    monkeypatch.setattr(fill_in_middle, "CROWD", crowd)
    df = docs.select("doc_id", "text", "class").unionByName(spark.createDataFrame([(*r, "c") for r in ODD], "doc_id bigint, text string, class string"))
    want = middles([*rows, *ODD])
    assert sorted(map(tuple, fill_in_middle.transform(df).collect()), key=repr) == sorted(want, key=repr)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    digests = sorted(((*r[:5], sha(r[5]), sha(t or "")) for r, (_, t) in zip(want, [*rows, *ODD], strict=True)), key=repr)
    assert sorted(map(tuple, fill_in_middle.form_digests(df).collect()), key=repr) == digests
    assert {r[2] for r in want} == {"plain", "psm", "spm"}


def test_boundary_lists():
    pick = np.random.default_rng(5)
    for size in (0, 1, 7, 255, 256, 257, 3000):
        for alphabet in ("a", "aé", "日本", "😀", "aé日😀"):
            text = "".join(pick.choice(list(alphabet), size)) if size else ""
            index = fill_in_middle.Boundaries(fill_in_middle.boundaries(text.encode()))
            assert index.n == size
            assert [index[i] for i in range(size + 1)] == [len(text[:i].encode()) for i in range(size + 1)]

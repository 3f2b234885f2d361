"""The ten operators against plain versions, on a table with nulls, copies, ties, odd texts and clashing columns."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from matchlake.llm import bpe, fingerprints, lm_scoring, media, minhash, packing, quality, sharding, substring_dedup, toxicity
from matchlake.llm.queries import remainder
from tests.llm import brute


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def ordered(found, rows):
    """Results and inputs as comparable lists of (doc_id, ...)."""
    return sorted(found, key=repr), sorted(rows, key=repr)


def test_fingerprints(docs, rows):
    inputs = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    want = Counter()
    exact = defaultdict(list)
    for k, (i, text) in enumerate(inputs):
        other = inputs[(k + 1) % len(inputs)][1]
        edited = text[: len(text) - len(text) // 2] + other[: len(text) // 2]
        want[i, len(text), sha(edited.encode())] += 1
        a, b = brute.shingles(text, 5), brute.shingles(other, 5)
        if len(a | b) <= fingerprints.SIZE:
            exact[i].append(len(a & b) / len(a | b) if a | b else 1.0)
    found = fingerprints.edited_fingerprints(docs).collect()
    prints = {i: fingerprints.text_form(fingerprints.sketches(pa.array([t.encode()], pa.large_binary()))[0]) for i, t in inputs if [j for j, _ in inputs].count(i) == 1}
    follows = {i: inputs[(k + 1) % len(inputs)][1] for k, (i, _) in enumerate(inputs)}
    for r in found:
        if r.doc_id in prints:
            text, other = dict(inputs)[r.doc_id], follows[r.doc_id]
            edited = text[: len(text) - len(text) // 2] + other[: len(text) // 2]
            a, b, c = (set(fingerprints.sketches(pa.array([x.encode()], pa.large_binary()))[0].tolist()) for x in (text, edited, other))
            near = [float(not x | y) if not x or not y else len((least := set(sorted(x | y)[: fingerprints.SIZE])) & x & y) / len(least) for x, y in ((a, b), (a, c))]
            assert r.fingerprint == prints[r.doc_id] and from_hex(r.edited_fingerprint) == sorted(b)
            assert math.isclose(r.near_edited, near[0]) and math.isclose(r.near_next, near[1])
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in found) == want
    for r in found:
        if r.doc_id is not None and len(exact[r.doc_id]) == 1 and want[r.doc_id, r.n_chars, r.edited_sha256] == 1:
            assert any(math.isclose(r.near_next, x) for x in exact[r.doc_id]), r.doc_id
    prints = fingerprints.fingerprint(docs).collect()
    assert len(prints) == len(rows)
    whole = fingerprints.merge_fingerprints(fingerprints.fingerprint(docs).withColumn("all", F.lit(1)), "all").first().fingerprint
    union = np.unique(np.concatenate([fingerprints.from_text(r.fingerprint) for r in prints]))[: fingerprints.SIZE]
    assert whole == fingerprints.text_form(union)


def from_hex(form):
    return [int(form[i : i + 16], 16) for i in range(0, len(form), 16)]


def test_merging_fingerprints_by_key(spark):
    """Keys with many rows and null keys, however the rows are dealt."""
    rng = np.random.default_rng(7)
    parts = [(int(k) if k < 4 else None, np.unique(rng.integers(0, 1 << 62, 60, dtype=np.uint64))) for k in rng.integers(0, 5, 300)]
    df = spark.createDataFrame([(k, fingerprints.text_form(x)) for k, x in parts] + [(9, None), (9, "")], "k int, fingerprint string").repartition(7)
    want = {k: fingerprints.text_form(np.unique(np.concatenate([x for j, x in parts if j == k]))[: fingerprints.SIZE]) for k in {k for k, _ in parts}}
    assert {r.k: r.fingerprint for r in fingerprints.merge_fingerprints(df, "k").collect()} == want | {9: ""}


def test_fingerprint_estimates():
    a = " ".join(f"a{i}" for i in range(4004))
    b = " ".join(f"a{i}" for i in range(2002))
    x, y = fingerprints.sketches(pa.array([a.encode(), b.encode()], pa.large_binary()))
    assert 0.35 < fingerprints.resemblance(x, y) < 0.65
    assert fingerprints.containment(y, x) > 0.8
    assert 3000 < fingerprints.distinct(x) < 5200


@pytest.mark.parametrize(("blocks", "fan"), [(None, 64), (7, 2)])
def test_lm_scoring(docs, rows, monkeypatch, blocks, fan):
    """In one block, and in several whose counts meet in groups of ``fan``."""
    if blocks:
        monkeypatch.setattr(lm_scoring, "block_count", lambda _: blocks)
    monkeypatch.setattr(lm_scoring, "FAN", fan)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = [(t or "").encode() for i, t in rows if not held(i)]
    model = brute.Contexts(train)
    tokens = Counter(x for t in train for x in brute.words(t.decode()))
    n, v = sum(tokens.values()) + len(train), len(tokens) + 1
    want = []
    for i, t in rows:
        own = brute.words(t)
        base = sum(math.log10((tokens[x] + 1) / (n + v + 1)) for x in own) + math.log10((len(train) + 1) / (n + v + 1))
        want.append((i, held(i), len(own) + 1, sum(tokens[x] > 0 for x in own) + 1, n, round(base, 3), round(model.score((t or "").encode()), 2)))
    found = lm_scoring.score(docs, held_out=F.coalesce(remainder(7) == 2, F.lit(False))).collect()
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found]
    got.sort(key=lambda r: (repr(r[0]), r[2], r[6]))
    want.sort(key=lambda r: (repr(r[0]), r[2], r[6]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-3, atol=0.02)


@pytest.mark.parametrize(("block", "crowd"), [(1 << 24, 4096), (2000, 4096), (2000, 1), (300, 0)])
def test_substring_dedup(docs, rows, monkeypatch, block, crowd):
    """In one block, in many, and with seeds so crowded that windows are looked up one by one."""
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(substring_dedup, "CROWD", crowd)
    each = [brute.words(t, low=False) for _, t in rows]
    want, covers = [], brute.repeats([t for _, t in rows])
    for (i, _), own, covered in zip(rows, each, covers, strict=True):
        want.append((i, len(own), sum(covered), sha(b" ".join(x for x, c in zip(own, covered, strict=True) if not c))))
    found = [tuple(r) for r in substring_dedup.removal_digests(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert sum(r[2] for r in want) > 200
    if block < 1 << 20:
        return
    # factors: 35 words or more, all of them what the removed words are, and equal to those of their source
    once = {i: (own, covered) for (i, _), own, covered in zip(rows, each, covers, strict=True) if [j for j, _ in rows].count(i) == 1 and i is not None}
    factors = [r for r in substring_dedup.factors(docs).collect() if r.doc_id in once]
    marked = {i: [False] * len(own) for i, (own, _) in once.items()}
    for r in factors:
        assert r.n_words >= 35 and (r.source_doc_id, r.source_word) != (r.doc_id, r.first_word)
        marked[r.doc_id][r.first_word : r.first_word + r.n_words] = [True] * r.n_words
        if r.source_doc_id in once:
            source = once[r.source_doc_id][0][r.source_word : r.source_word + r.n_words]
            assert source == once[r.doc_id][0][r.first_word : r.first_word + r.n_words]
    assert marked == {i: covered for i, (_, covered) in once.items()}
    cut = substring_dedup.without_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)


def test_parse_takes_the_longest_match():
    """Places in a reference block against all pairs of places; long words and digests among them."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    regions = [" ".join(rng.choice(["a", "b", "y" * 90], rng.integers(3, 30))).encode() + b" " for _ in range(40)]
    index = substring_dedup.Reference(pa.array(regions, pa.large_binary()), 3)
    each = [r.split() for r in regions]
    places = [(r, i) for r, own in enumerate(each) for i in range(len(own) - 2)]

    def common(x, y):
        n = 0
        for p, q in zip(each[x[0]][x[1] :], each[y[0]][y[1] :], strict=False):
            if p != q:
                break
            n += 1
        return n

    length, source = index.longest()
    base = {int(index.first[r]) + i: (r, i) for r, i in places}
    for k, place in enumerate(places):
        best = max(common(place, other) for other in places if other != place)
        assert length[k] == best and (not best or common(place, base[int(source[k])]) == best)


def test_hashes_are_not_linear():
    """Thue-Morse words collide under any polynomial modulo 2**64; equal words hash alike wherever they lie."""
    import pyarrow as pa

    from matchlake.llm import words as w

    one = "a"
    for _ in range(11):
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    text = f"{one} {other} x{'y' * 20} b {one} x{'y' * 20}"
    found = w.split(pa.array([text.encode(), " ".join(one).encode(), " ".join(other).encode()], pa.large_binary()))
    hashes = found.hashes()
    assert len(set(hashes[:6].tolist())) == 4 and hashes[0] == hashes[4] and hashes[2] == hashes[5]
    assert len(set(w.runs(hashes[6:], 2048)[[0, 2048]].tolist())) == 2 == len(set(w.spans(hashes, np.array([6, 2054]), np.array([2054, 4102])).tolist()))
    for n in (1, 2, 5, 35):
        runs, alike = w.runs(hashes[6:], n), {}
        for i, x in enumerate(runs.tolist()):
            assert alike.setdefault(x, hashes[6 + i : 6 + i + n].tolist()) == hashes[6 + i : 6 + i + n].tolist()


@pytest.mark.parametrize(("size", "percent"), [(2, 80), (5, 80)])
def test_minhash(docs, rows, size, percent):
    component = brute.groups([t for _, t in rows], size, percent)
    ids = defaultdict(list)
    for (i, _), c in zip(rows, component, strict=True):
        ids[c].append(i)
    least = {c: min((i for i in x if i is not None), default=None) for c, x in ids.items()}
    want = [(i, len(brute.shingles(t, size)), i if not brute.words(t) else least[c]) for (i, t), c in zip(rows, component, strict=True)]
    found = [tuple(r) for r in minhash.near_duplicates(docs, size, percent).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert len({c for _, _, c in want}) < len(rows) - 8
    kept = minhash.keep_one(docs, size, percent).collect()
    assert len(kept) == len({c for c, (_, t) in zip(component, rows, strict=True) if brute.words(t)}) + sum(not brute.words(t) for _, t in rows)


def test_minhash_many_near_copies_in_one_bucket(spark):
    """A bucket with several components is joined by exact counts, also when it is cut into blocks."""
    base = [f"b{i}" for i in range(200)]
    texts = []
    for i in range(60):
        own = [*base]
        for j in range(15):
            own[(7 * i + 13 * j) % 200] = f"u{i % 12}_{j}"
        texts.append(" ".join(own))
    want = brute.groups(texts, 2, 80)
    was, minhash.TOGETHER = minhash.TOGETHER, 3000
    try:
        found = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), 2, 80).collect()
    finally:
        minhash.TOGETHER = was
    assert sorted((r.doc_id, r.component_id) for r in found) == list(enumerate(want))


def test_texts_longer_than_a_slice(spark):
    """A text of 1.5 MiB, its near copy and a text that holds a passage of it, beside short ones."""
    from matchlake.llm import words as w

    own = [f"t{(i * 7919) % 60_013}" for i in range(250_000)]
    near = own[:100_000] + ["other"] + own[100_001:]
    texts = [" ".join(own), "short text here", " ".join(near), " ".join(["before", *own[70:120], "behind"]), "short text here"]
    assert len(texts[0]) > w.SLICE_BYTES
    found = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    removed = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.removal_digests(found).collect()}
    assert removed == {i: (len(brute.words(t, low=False)), sum(c)) for i, (t, c) in enumerate(zip(texts, brute.repeats(texts), strict=True))}
    linked = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(found, 2, 80).collect()}
    assert linked == {i: (len(brute.shingles(t, 2)), c) for i, (t, c) in enumerate(zip(texts, brute.groups(texts, 2, 80), strict=True))}
    assert {r.doc_id: r.payload_sha256 for r in media.media_digests(found).collect()} == {i: sha(media.payload(t.encode())) for i, t in enumerate(texts)}
    prints = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(found).collect()}
    assert prints[1] == prints[4] and 0.9 < fingerprints.resemblance(*map(fingerprints.from_text, (prints[0], prints[2]))) < 1.01


def test_sharding(docs, rows, monkeypatch):
    for part, fan in ((20_000, 512), (8, 2)):
        monkeypatch.setattr(sharding, "PART", part)
        monkeypatch.setattr(sharding, "FAN", fan)
        found = sharding.shard(docs, 5).collect()
        assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in found) == sorted((repr(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
        assert {r.law for r in found} == {"bytes"} and {r.grown_shard for r in found} == {None}
        shards = defaultdict(list)
        for r in found:
            shards[r.shard].append(r.slot)
        assert all(sorted(x) == list(range(len(x))) for x in shards.values())
        assert len({(r.text_crc32, r.size, r.shard) for r in found}) == len({(r.text_crc32, r.size) for r in found})


def test_differencing_is_balanced():
    weights = np.random.default_rng(1).integers(1, 1000, 400)
    lone = np.zeros((400, 7), np.int64)
    lone[:, 0] = weights
    place = sharding.difference(lone)[:, 0]
    sums = np.bincount(place, weights, 7)
    assert sums.max() - sums.min() <= 20


def test_media(docs, rows):
    found = media.media_digests(docs).collect()
    want = []
    for i, t in rows:
        data = (t or "").encode()
        padded = data + bytes(64 * max(1, -(-len(data) // 64)) - len(data))
        want.append((i, len(data), len(padded), sha(padded), zlib.crc32(padded[-64:])))
    assert sorted([tuple(r)[:5] for r in found], key=repr) == sorted(want, key=repr)
    plain = {}
    for r in media.to_media(docs).collect():
        image = np.frombuffer(r.payload, np.uint8).reshape(-1, 64)
        plain[r.doc_id, sha(r.media)] = brute.cosine_hash(image)
    assert all(plain[r.doc_id, r.media_sha256] == r.feature for r in found)
    assert len(set(plain.values())) > 20
    whole = media.to_media(docs).collect()
    assert Counter((r.doc_id, sha(r.media), r.feature, len(r.media)) for r in whole) == Counter((r.doc_id, r.media_sha256, r.feature, r.media_bytes) for r in found)


def test_png_filters_and_checksums():
    import struct

    image = np.random.default_rng(2).integers(0, 256, (10, 64), dtype=np.uint8)
    lines = []
    for i, row in enumerate(image.astype(int)):
        up = image[i - 1].astype(int) if i else np.zeros(64, int)
        left, corner = np.append(0, row[:-1]), np.append(0, up[:-1])
        guess = left + up - corner
        paeth = np.select([(abs(guess - left) <= abs(guess - up)) & (abs(guess - left) <= abs(guess - corner)), abs(guess - up) <= abs(guess - corner)], [left, up], corner)
        by = [np.zeros(64, int), left, up, (left + up) // 2, paeth][i % 5]
        lines.append(bytes([i % 5]) + ((row - by) % 256).astype(np.uint8).tobytes())
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    packed = zlib.compress(b"".join(lines))
    png = media.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 64, 10, 8, 0, 0, 0, 0)) + chunk(b"IDAT", packed[:30]) + chunk(b"IDAT", packed[30:]) + chunk(b"IEND", b"")
    assert (media.read_png(png) == image).all()
    # what the writer makes: rows of three filters, read back as they were
    text = np.frombuffer(("plain words in a row " * 40 + "".join(chr(33 + (7 * i) % 90) for i in range(3000)) + "\0" * 600).encode()[: 64 * 60], np.uint8).reshape(-1, 64)
    ramp = np.concatenate([text, np.repeat(np.arange(64, dtype=np.uint8)[None] * 3, 9, axis=0), image])
    made = media.write_png(ramp)
    assert (media.read_png(made) == ramp).all()
    kinds = np.frombuffer(zlib.decompress(made[41:-16]), np.uint8).reshape(-1, 65)[:, 0]
    assert set(kinds.tolist()) == {0, 1, 2}
    for at in (3, 20, 45, len(png) - 20):
        broken = bytearray(png)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            media.read_png(bytes(broken))


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths, want = [], []
    for i, t in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        at, to, piece = 0, (len(ids) - 1) % 256 + 1, 0
        while at < len(ids):
            want.append((i, piece, at, to - at, zlib.crc32(np.array(ids[at:to], "<u4").tobytes())))
            lengths.append(to - at)
            at, to, piece = to, to + 256, piece + 1
    found = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 256, 2, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    assert sorted([tuple(r)[:5] for r in found], key=repr) == sorted(want, key=repr)
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 256
    assert len(bins) == brute.best_fit_bins(lengths, 256)


def test_bpe(docs, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    plain.no_truncation()
    plain.no_padding()
    want = []
    for i, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha(plain.decode(ids, skip_special_tokens=False).encode())))
    found = [tuple(r) for r in bpe.coding_digests(docs, path).collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)


def test_maximal_segments():
    """Against the definition: no better or longer segment inside or around, by all starts and ends."""
    rng = np.random.default_rng(3)

    def recursive(s, a, b):
        best = max(((s[i:j].sum(), -(j - i), -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        if best[0] <= 0:
            return []
        i, n = -best[2], -best[1]
        return recursive(s, a, i) + [(i, i + n)] + recursive(s, i + n, b)

    for _ in range(40):
        scores = rng.integers(-4, 5, 14) + rng.random(14) / 100
        assert [x[:2] for x in toxicity.maximal_segments(scores)] == recursive(scores, 0, 14)


def test_maximal_segments_in_linear_time():
    """Rising and alternating scores, where a scan that walks back over all candidates takes squares of their number."""
    import time

    def took(n):
        least = 9.0
        for kind in ("alternating", "rising"):
            scores = np.tile([1.0, -1.0 - 1e-9], n) if kind == "alternating" else np.stack([np.full(n, 1.0), -np.linspace(2, 3, n)], axis=1).ravel()
            began = time.process_time()
            assert len(toxicity.maximal_segments(scores)) == n
            least = min(least, time.process_time() - began)
        return least

    took(1000)
    assert took(160_000) < 40 * took(10_000)


def test_toxicity_against_a_plain_version(spark, docs, rows):
    """Evidence and probability of every text, from all its segments found by definition."""
    labels = spark.createDataFrame([(i, int("w1" in (t or "").split())) for i, t in rows if i is not None], "doc_id bigint, toxic int")
    everything = F.lit(True)
    model = toxicity.fit(docs, labels, everything)
    model.rate = 0.2
    texts = [t or "" for _, t in rows]
    got = toxicity.evidence(pa.array([t.encode() for t in texts], pa.large_binary()), model)
    weight = dict(zip(model.tokens.tolist(), model.weights.tolist(), strict=True))

    def forms(word):
        found = toxicity.w.split(pa.array([word], pa.large_binary()), toxicity._NO_LETTER)
        return [int(found.hashes(k, True, k or 0)[0]) for k in (None, *toxicity.STEMS)]

    for text, value in zip(texts, got, strict=True):
        if len(text) > 1000:
            continue
        own = []
        for word in brute.letters(text):
            best = max((weight.get(x, 0.0) for x in forms(word)), key=abs, default=0.0)
            own.append(best or -toxicity.DRIFT)
        total = 0.0
        for a, b in brute.segments(own):
            score = sum(own[a:b])
            if 1 - math.exp(-model.rate * len(own) * math.exp(-model.decay * score)) <= toxicity.CHANCE:
                total += model.decay * score - math.log(model.rate * len(own))
        assert math.isclose(value, math.log1p(max(0.0, total)), abs_tol=1e-9)


def test_highest_passages_give_the_rate(spark):
    """K is one over the mean of n exp(-lambda M) of the clean rows that gave no weights."""
    docs, labels = labelled(spark, "/root/testdata/sf0.01")
    model = toxicity.fit(docs, labels, remainder(3) != 1)
    rows = toxicity.sample(docs, labels, remainder(3) != 1).filter("fold = 0 and toxic = 0").collect()
    value = toxicity.exponential(pa.array([bytes(r.text or b"") for r in rows], pa.large_binary()), model)
    assert math.isclose(model.rate, np.clip(1 / value[value > 0].mean(), *toxicity.RATES), rel_tol=1e-9)


def test_quality_against_a_plain_version(spark, docs, rows):
    """Posteriors by hand from each document's own probability; ties, repeated rows and null sites among them."""
    places = [(r.doc_id, r.text, r.source or "", r.lang or "") for r in docs.collect()]
    labels = spark.createDataFrame([(i, k % 3 > 0) for k, (i, _) in enumerate(rows)], "doc_id bigint, quality boolean")
    model = quality.fit(docs, labels, F.lit(True))
    p = [float(model.probability(quality.shapes(pa.array([(t or "").encode()], pa.large_binary())))[0]) for _, t, _, _ in places]
    shift = brute.shifts([x[2:] for x in places], p)
    want = []
    for (i, _, site, path), own in zip(places, p, strict=True):
        own = min(max(own, 1e-9), 1 - 1e-9)
        want.append((repr(i), round(1 / (1 + math.exp(-(math.log(own / (1 - own)) + shift[site, path]))), 7)))
    found = quality.score(docs, labels, F.lit(True)).collect()
    assert sorted((repr(r.doc_id), round(r.quality_score, 7)) for r in found) == sorted(want)
    kept = quality.accepted(docs, labels, F.lit(True))
    assert kept.columns == docs.columns
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(repr(tuple(r)[:-3]) for r in quality.score(docs.toDF(*docs.columns), labels, F.lit(True)).select(*docs.columns, "evidence", "quality_score", "quality_kept").collect() if r.quality_kept)


def test_stages_keep_columns_of_any_name(spark):
    """Columns named as results, with values of their own, pass through all four filtering stages."""
    import corpus_pipeline

    extra = ["score", "predicted", "evidence", "quality_score", "quality_kept", "value", "c0", "site", "path", "row", "root", "block", "own", "shift", "p", "final"]
    docs, labels = labelled(spark, "/root/testdata/sf0.01")
    some = docs.filter("doc_id < 400")
    for name in extra:
        some = some.withColumn(name, F.concat(F.lit(f"{name} of "), F.col("doc_id")))
    some = some.withColumn("a.b", F.col("doc_id") + 1).withColumn("tags", F.create_map(F.lit("id"), F.col("doc_id")))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, some, "/root/testdata/sf0.01")
        assert out.columns == some.columns and [t for _, t in out.dtypes] == [t for _, t in some.dtypes], name
        rows = out.collect()
        assert rows and all(r[x] == f"{x} of {r.doc_id}" for r in rows for x in extra), name
        assert all(r["a.b"] == r.doc_id + 1 and r.tags == {"id": r.doc_id} for r in rows), name


def labelled(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def auc(score, label):
    rank = np.argsort(np.argsort(score)) + 1
    good = label.sum()
    return (rank[label == 1].sum() - good * (good + 1) / 2) / (good * (len(label) - good))


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark, "/root/testdata/sf0.1")
    scored = toxicity.score(docs.select("doc_id", "text"), labels, learn=remainder(3) != 1)
    held = scored.filter(remainder(3) == 1).join(labels.filter("toxic is not null"), "doc_id").toPandas()
    assert auc(held["score"].to_numpy(), held["toxic"].to_numpy()) > 0.9
    assert (held["predicted"] == held["toxic"]).mean() > 0.9
    assert scored.select("score").filter("score < 0 or score > 1 or score is null").count() == 0


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled(spark, "/root/testdata/sf0.1")
    scored = quality.score(docs, labels, learn=remainder(3) != 1)
    held = scored.filter(remainder(3) == 1).join(labels.filter("quality is not null"), "doc_id").toPandas()
    assert (held["quality_kept"].astype(int) == held["quality"]).mean() > 0.85
    assert auc(held["quality_score"].to_numpy(), held["quality"].to_numpy()) > 0.9


def test_sparse_sites_shrink(spark):
    """A site of one document moves it less than a site of many alike."""
    rows = [("big", "x", 0.9)] * 200 + [("bad", "x", 0.1)] * 200 + [("one", "x", 0.9)]
    shift = {r.site: r["shift"] for r in quality.posteriors(spark.createDataFrame(rows, "site string, path string, p double")).collect()}
    assert shift["big"] > shift["one"] > 0 > shift["bad"]


def test_scores_keep_rows_and_columns(docs, spark, rows):
    labels = spark.createDataFrame([(i, k % 2, k % 3 == 0 and 1 or 0) for k, (i, _) in enumerate(rows)], "doc_id bigint, quality int, toxic int")
    for module, column in ((quality, "quality_score"), (toxicity, "score")):
        found = module.score(docs, labels, learn=remainder(3) != 1)
        assert set(docs.columns) - {"score"} <= set(found.columns) and found.count() == len(rows)
        assert found.filter(F.col(column).isNull()).count() == 0

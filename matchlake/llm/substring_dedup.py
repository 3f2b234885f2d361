"""Substring deduplication by relative Lempel-Ziv parsing against indexed reference blocks.

A document is parsed greedily into factors: the longest stretch of words that also starts elsewhere in the corpus, if it
has WINDOW words or more, else a literal word. The words of its factors go, the literal words stay.

1. Routing. In each window of WINDOW words the run of SEED words with the smallest hash is its seed, so equal windows
   have equal seeds at equal places. The windows next to each other that chose one seed span a region of at most
   2 * WINDOW - SEED words. Seeds that occur once have no match anywhere and go no further.
2. Reference blocks. The words of all regions whose seeds repeat are dealt to reference blocks by seed, so a region meets
   just the block that holds every possible match of its windows; a document meets as many blocks as its regions need.
   A block is indexed by a suffix array over numbered words (built by naming runs of 1, 2, 4, ... words), so matches are
   compared word by word, not by hash.
3. Parse. The longest match of a place is that with its neighbours in the suffix array. A factor runs as far as its match;
   at its boundary the parse goes on with the first window that reaches beyond it, so a match that lies across two
   factors is found as well. Factors that go on in the next region with the same source are joined in the document.
4. A seed with more than CROWD different regions would make one block large. Its windows are looked up one by one, by two
   independent 64-bit hashes of the whole window, wherever they lie; these factors have no source.

Tasks hold a block of documents (BLOCK_BYTES) or a reference block (REFERENCE_BYTES). What blocks send are plain rows, one
for each distinct seed, region or window of the block, so traffic is in proportion to the input, and a text in any number
of places is one row for each block.

Words are runs of bytes other than ASCII white space, unchanged. Edge cases: a null text has no words; texts shorter than
a window are kept; repeated rows are occurrences of their own, so their windows are removed from all of them; rows with
null ids take part; an empty table gives an empty result; other columns are not read by the digest query.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from matchlake.llm import words as w
from matchlake.llm.blocks import BLOCK_BYTES, block_count, groups, staged, with_block

#: Words in a window that counts as repeated, and in its seed; a region must fit 64 words.
WINDOW, SEED = 35, 8
#: Rows of regions of one seed that a reference block takes, and about how many bytes of words in all.
CROWD, REFERENCE_BYTES = 4096, 4 << 20
#: Words of more bytes are sent as digests.
LONG = 64

_U = np.uint64
_NONE = np.iinfo(np.int64).min
_REGIONS = pa.schema([("block", pa.int32()), ("hot", pa.bool_()), ("seed", pa.int64()), ("low", pa.int64()), ("times", pa.int64()), ("words", pa.binary()), ("doc", pa.int64()), ("word", pa.int64()), ("other_doc", pa.int64()), ("other_word", pa.int64())])
_REGION_ROWS = "block int, hot boolean, seed bigint, low bigint, times bigint, words binary, doc bigint, word bigint, other_doc bigint, other_word bigint"
_FOUND = pa.schema([("block", pa.int32()), ("hot", pa.bool_()), ("seed", pa.int64()), ("low", pa.int64()), ("mask", pa.int64()), ("factors", pa.binary())])
_FOUND_ROWS = "block int, hot boolean, seed bigint, low bigint, mask bigint, factors binary"


class Parsed:
    """Windows of some texts and the seeds and regions that they belong to."""

    def __init__(self, column: pa.Array, window: int, seed: int):
        self.words = w.split(column)
        first, last = self.words.first[:-1], self.words.first[1:]
        self.hashes = self.words.hashes()
        lengths = np.maximum(last - first - window + 1, 0)
        begin = np.repeat(first - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
        self.window = window
        self.starts = begin + np.arange(lengths.sum())  # of whole windows, by their first word
        text = np.repeat(np.arange(len(first)), lengths)
        if not len(self.starts):
            self.seed, self.low = np.zeros(0, _U), np.zeros(0, _U)
            self.seed_of, self.text, self.region = np.zeros(0, np.int64), text, np.zeros((0, 2), np.int64)
            return
        runs = w.runs(self.hashes, seed)
        seeds = self._smallest(runs, window - seed + 1)[self.starts]
        new = np.ones(len(seeds), bool)
        new[1:] = (seeds[1:] != seeds[:-1]) | (text[1:] != text[:-1])
        self.seed_of = np.cumsum(new) - 1
        self.seed, self.text = runs[seeds[new]], text[new]
        edge = np.flatnonzero(new)
        self.region = np.stack([self.starts[edge], self.starts[np.append(edge[1:], len(seeds)) - 1] + window], axis=1)
        self.low = w.spans(self.hashes, self.region[:, 0], self.region[:, 1])

    @staticmethod
    def _smallest(runs: np.ndarray, wide: int) -> np.ndarray:
        """For each place, where the smallest of the next ``wide`` values is (the first of those equal in 32 bits)."""
        n = len(runs)
        key = runs >> _U(32) << _U(32) | np.arange(n, dtype=_U)
        whole = np.full(-(-n // wide) * wide + wide, ~_U(0), _U)
        whole[:n] = key
        rows = whole.reshape(-1, wide)
        ahead = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        behind = np.minimum.accumulate(rows, axis=1).ravel()
        return (np.minimum(ahead[:n], behind[wide - 1 : n + wide - 1]) & _U(0xFFFFFFFF)).astype(np.int64)

    def windows(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each window in question, from two hashes of each word."""
        return tuple(w.runs(h, self.window)[self.starts[asked]] for h in (self.hashes, self.words.hashes(seed=1)))

    def regions(self, wanted: np.ndarray) -> list[bytes]:
        """The words of the given regions, a space behind each."""
        data, out = self.words.data.tobytes(), []
        long = np.concatenate([[0], np.cumsum(self.words.end - self.words.start > LONG)])
        first, last = self.region[wanted].T
        for a, b, few in zip(self.words.start[first].tolist(), self.words.end[last - 1].tolist(), (long[last] > long[first]).tolist(), strict=True):
            each = data[a:b].split()
            if few:  # UTF-8 has no byte 255, so a digest is no other word
                each = [x if len(x) <= LONG else b"\xff" + hashlib.blake2b(x, digest_size=32).hexdigest().encode() for x in each]
            out.append(b" ".join(each) + b" ")
        return out


def _parsed(table: pa.Table, window: int, seed: int) -> Iterator[tuple[pa.Table, Parsed]]:
    column = w.binary(table.column("text"))
    for a, b in w.slices(len(column), w.raw(column)[1]):
        yield table.slice(a, b - a), Parsed(column.slice(a, b - a), window, seed)


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().view(_U)


def _merged(keys: list[tuple[np.ndarray, ...]], width: int = 2) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate([np.zeros(0, _U), *[k[i] for k in keys]]) for i in range(width))


class Pairs:
    """Where each of some pairs of 64-bit keys is among known ones (all different)."""

    def __init__(self, high: np.ndarray, low: np.ndarray):
        key = self._key(high, low)
        self.order = np.argsort(key, kind="stable")
        self.key, self.high, self.low = key[self.order], high[self.order], low[self.order]

    @staticmethod
    def _key(high: np.ndarray, low: np.ndarray) -> np.ndarray:
        return w.mix(high ^ low * _U(0x9E3779B97F4A7C15))

    def find(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Their places, -1 for pairs that are not known."""
        out, key = np.full(len(high), -1), self._key(high, low)
        place, left = np.searchsorted(self.key, key), np.arange(len(high))
        while len(left):
            left = left[place[left] < len(self.key)]
            left = left[self.key[place[left]] == key[left]]
            own = (self.high[place[left]] == high[left]) & (self.low[place[left]] == low[left])
            out[left[own]] = self.order[place[left[own]]]
            left = left[~own]
            place[left] += 1
        return out


class Reference:
    """A block of reference regions, indexed by a suffix array over numbered words."""

    def __init__(self, regions: pa.Array, window: int):
        found = w.split(regions)
        every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(found), [None, pa.py_buffer(np.append(found.start, len(found.data)).astype(np.int64)), pa.py_buffer(found.data.tobytes())])
        number = every.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
        self.window, self.first = window, found.first
        self.size = np.diff(found.first)
        self.end = np.repeat(found.first[1:], self.size)
        self.names, length = [number], 1  # names[k]: of the 2**k words from each place on, or as many as the region has
        while 2 * length <= self.size.max(initial=0):
            self.names.append(self._named(self.names[-1], np.arange(len(number)), length))
            length *= 2
        windows = np.maximum(self.size - window + 1, 0)
        self.region = np.repeat(np.arange(len(self.size)), windows)
        self.start = np.repeat(found.first[:-1] - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows) + np.arange(windows.sum())
        self.suffixes = np.argsort(self._named(self.names[-1], self.start, length), kind="stable")

    def _named(self, names: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
        """Numbers of pairs of names, in order; 0 stands for what lies behind a region."""
        ahead = np.where(at + length < self.end[at], names[np.minimum(at + length, len(names) - 1)], 0) if len(at) else at
        return np.unique(names[at] << 32 | ahead, return_inverse=True)[1] + 1

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes at a and at b have in common from the start."""
        out, room = np.zeros(len(a), np.int64), np.minimum(self.end[a], self.end[b]) if len(a) else a
        room = np.minimum(self.end[a] - a, self.end[b] - b)
        for k in reversed(range(len(self.names))):
            more = out < room
            x, y = np.where(more, a + out, a), np.where(more, b + out, b)
            out += np.where(more & (self.names[k][x] == self.names[k][y]), 1 << k, 0)
        return np.minimum(out, room)

    def longest(self) -> tuple[np.ndarray, np.ndarray]:
        """For each window's place the length of its longest match with another place, and where that is."""
        place = self.start[self.suffixes]
        next_to = self._common(place[:-1], place[1:])
        before, behind = np.append([0], next_to)[: len(place)], np.append(next_to, [0])[: len(place)]
        length, source = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        other = np.where(before >= behind, np.roll(place, 1), np.roll(place, -1))
        length[self.suffixes], source[self.suffixes] = np.maximum(before, behind), other
        return length, source

    def factors(self, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Region, first word in it, words and place of the source (-1: the region itself, elsewhere) of every factor.

        times: how often each region occurs in the documents that sent it. All regions are parsed side by side.
        """
        length, source = self.longest()
        alike = times[self.region] > 1
        length[alike] = self.end[self.start[alike]] - self.start[alike]
        source[alike] = -1
        windows = np.maximum(self.size - self.window + 1, 0)
        base = np.concatenate([[0], np.cumsum(windows)[:-1]])
        left, at, out = np.flatnonzero(windows), np.zeros(len(windows), np.int64), []
        while len(left):
            here = base[left] + at[left]
            hit = length[here] >= self.window
            out.append((left[hit], at[left[hit]], length[here[hit]], source[here[hit]]))
            at[left] += np.where(hit, length[here] - self.window + 1, 1)
            left = left[at[left] < windows[left]]
        return tuple(np.concatenate([np.zeros(0, np.int64), *[x[i] for x in out]]) for i in range(4))


def _parse_block(window: int):
    def run(table: pa.Table) -> pa.Table:
        reference = Reference(w.binary(table.column("words")), window)
        doc, word, other_doc, other_word = (table.column(c).fill_null(_NONE).to_numpy() for c in ("doc", "word", "other_doc", "other_word"))
        region, at, size, source = reference.factors(table.column("times").to_numpy())
        order = np.lexsort((at, region))
        region, at, size, source = region[order], at[order], size[order], source[order]
        mask = np.zeros(table.num_rows, _U)
        np.bitwise_or.at(mask, region, (~_U(0) >> (_U(64) - size.astype(_U))) << at.astype(_U))
        own = source < 0
        of = np.where(own, region, np.searchsorted(reference.first, source, "right") - 1)
        ahead = np.where(own, at, source - reference.first[of])
        packed = np.stack([at, size, np.where(own, other_doc[region], doc[of]), np.where(own, other_word[region], word[of]) + ahead, doc[region], word[region] + at], axis=1)
        some = np.flatnonzero(mask)
        edges = np.searchsorted(region, np.append(some, table.num_rows))
        rows = table.select(["block", "hot", "seed", "low"]).take(pa.array(some))
        return rows.append_column("mask", pa.array(mask[some].view(np.int64))).append_column("factors", pa.array([packed[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.binary()))

    return run


def _sent(block: int, hot: bool, **columns: object) -> pa.Table:
    n = len(columns["seed"])
    rows = {"block": pa.array(np.full(n, block, np.int32)), "hot": pa.array(np.full(n, hot))}
    for field in _REGIONS:
        if field.name not in rows:
            rows[field.name] = pa.array(columns[field.name], field.type) if field.name in columns else pa.nulls(n, field.type)
    return pa.table(rows, _REGIONS)


def _seeds(window: int, seed: int):
    """The distinct seeds of a block, how many different regions they have in it and how often they occur."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        high, low = _merged([(p.seed, p.low) for _, p in _parsed(table, window, seed)])
        order, start = groups(high, low)
        seeds = high[order][start]
        first = np.flatnonzero(np.append(True, seeds[1:] != seeds[:-1])) if len(seeds) else start
        kinds = np.diff(np.append(first, len(seeds)))
        times = np.diff(np.append(start[first], len(high)))
        return pa.table({"block": pa.array(np.full(len(first), key[0].as_py(), np.int32)), "seed": seeds[first].view(np.int64), "kinds": kinds, "times": times})

    return run


def _regions(window: int, seed: int):
    """The distinct regions of a block whose seeds repeat; in their place the distinct windows, where the seed is hot."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _REGIONS.empty_table()
        block, order = key[0].as_py(), np.argsort(_numbers(right.column("seed")))
        known, hot = _numbers(right.column("seed"))[order], right.column("hot").to_numpy()[order]
        kept: dict[tuple[int, int], list] = {}
        windows = []
        for part, parsed in _parsed(left, window, seed):
            place = np.minimum(np.searchsorted(known, parsed.seed), len(known) - 1)
            repeated = known[place] == parsed.seed
            if (asked := (repeated & hot[place])[parsed.seed_of]).any():
                windows.append(parsed.windows(asked))
            mine = np.flatnonzero(repeated & ~hot[place])
            order, start = groups(parsed.seed[mine], parsed.low[mine])
            mine, size = mine[order], np.diff(np.append(start, len(order)))
            one, two = mine[start], mine[np.minimum(start + 1, len(mine) - 1)] if len(mine) else mine
            ids = part.column("doc_id").to_pylist() if "doc_id" in part.column_names else [None] * part.num_rows
            places = [[(ids[t], int(a)) for t, a in zip(parsed.text[x].tolist(), (parsed.region[x, 0] - parsed.words.first[parsed.text[x]]).tolist(), strict=True)] for x in (one, two)]
            fresh = []
            for i, (pair, n, a, b) in enumerate(zip(zip(parsed.seed[one].tolist(), parsed.low[one].tolist(), strict=True), size.tolist(), *places, strict=True)):
                if (row := kept.get(pair)) is None:
                    kept[pair] = [None, n, *a, *(b if n > 1 else (None, None))]
                    fresh.append(i)
                else:
                    if row[1] == 1:
                        row[4:] = a
                    row[1] += n
            pairs = list(zip(parsed.seed[one].tolist(), parsed.low[one].tolist(), strict=True))
            for i, text in zip(fresh, parsed.regions(one[fresh]), strict=True):
                kept[pairs[i]][0] = text
        seeds, lows = np.array([k[0] for k in kept], _U), np.array([k[1] for k in kept], _U)
        columns = dict(zip(("words", "times", "doc", "word", "other_doc", "other_word"), zip(*kept.values(), strict=True), strict=True)) if kept else {}
        high, low = _merged(windows)
        order, start = groups(high, low)
        single = _sent(block, True, seed=high[order][start].view(np.int64), low=low[order][start].view(np.int64), times=np.diff(np.append(start, len(order))))
        return pa.concat_tables([_sent(block, False, seed=seeds.view(np.int64), low=lows.view(np.int64), **columns), single])

    return run


def parse(docs: DataFrame, columns: str | T.StructType, emit, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Parse every text; ``emit(rows, words, covered, factors)`` makes the result of a slice.

    docs: any columns with ``text``, and ``doc_id`` if factors are to name their sources; ``columns`` is the schema of
    what emit returns. covered: for each word whether it lies in a factor; factors: a function that gives text, first
    word, words, source document and its first word of each.
    """
    if 2 * window - seed > 64:
        raise ValueError("a region must fit 64 words")
    rows = docs.withColumn("text", F.coalesce(F.col("text").cast("binary"), F.unhex(F.lit(""))))
    blocks = block_count(rows, most=BLOCK_BYTES)
    rows = with_block(rows, blocks, *[F.to_json(F.col(c)) if "map<" in kind else F.col(c) for c, kind in rows.dtypes])  # maps have no hash
    texts = rows.select("block", "text", *(c for c in ("doc_id",) if c in rows.columns))
    seeds = texts.select("block", "text").groupBy("block").applyInArrow(_seeds(window, seed), "block int, seed bigint, kinds bigint, times bigint")
    of_seed = W.partitionBy("seed")
    counted = seeds.select("block", "seed", F.sum("times").over(of_seed).alias("times"), F.sum("kinds").over(of_seed).alias("kinds"))
    index = staged(counted.filter("times > 1").select("block", "seed", (F.col("kinds") > CROWD).alias("hot")))
    sent = staged(texts.groupBy("block").cogroup(index.groupBy("block")).applyInArrow(_regions(window, seed), _REGION_ROWS))
    references = sent.filter(~F.col("hot"))
    parts = block_count(references, "words", REFERENCE_BYTES)
    parsed = references.withColumn("part", F.pmod(F.xxhash64("seed"), F.lit(parts))).groupBy("part").applyInArrow(_parse_block(window), _FOUND_ROWS)
    often = F.sum("times").over(W.partitionBy("seed", "low"))
    single = sent.filter("hot").withColumn("often", often).filter("often > 1").select("block", "hot", "seed", "low", F.lit(None).cast("bigint").alias("mask"), F.lit(None).cast("binary").alias("factors"))
    found = parsed.unionByName(single)

    def cover(left: pa.Table, right: pa.Table) -> pa.Table:
        hot = pa.compute.equal(right.column("hot"), True)
        single, table = right.filter(hot), right.filter(pa.compute.invert(hot))
        windows, regions = (Pairs(_numbers(x.column("seed")), _numbers(x.column("low"))) for x in (single, table))
        masks, packed, out = table.column("mask").to_numpy().view(_U), table.column("factors"), []
        for part, parsed in _parsed(left, window, seed) if left.num_rows else []:
            covered = np.zeros(len(parsed.words), bool)
            place = regions.find(parsed.seed, parsed.low)
            own = np.flatnonzero(place >= 0)
            mask, begin = masks[place[own]], parsed.region[own, 0]
            for bit in range(2 * window - seed):
                covered[begin[(mask >> _U(bit) & _U(1)) > 0] + bit] = True
            hits = np.zeros(0, np.int64)
            if single.num_rows and len(parsed.starts):
                hits = parsed.starts[windows.find(*parsed.windows(np.ones(len(parsed.starts), bool))) >= 0]
                change = np.zeros(len(parsed.words) + 1, np.int64)
                change[hits] += 1
                change[hits + window] -= 1  # windows start, and so end, at different words
                covered |= np.cumsum(change)[:-1] > 0

            def factors(parsed: Parsed = parsed, own: np.ndarray = own, place: np.ndarray = place, hits: np.ndarray = hits, part: pa.Table = part) -> list[tuple]:
                return _joined_factors(parsed, [(r, packed[int(place[r])].as_py()) for r in own.tolist()], hits, part.column("doc_id").to_pylist())

            out.append(emit(part, parsed.words, covered, factors))
        return pa.concat_tables(out) if out else empty

    empty = emit(pa.table({c: pa.array([], pa.binary() if c == "text" else pa.int64()) for c in rows.columns if c != "block"}), w.split(pa.array([], pa.large_binary())), np.zeros(0, bool), list)
    return rows.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(cover, columns)


def _joined_factors(parsed: Parsed, regions: list[tuple[int, bytes]], hits: np.ndarray, ids: list) -> list[tuple]:
    """text, first word, words, source document and first word there of the factors of some texts; those of one source
    that meet or overlap, in regions next to each other, are one."""
    owner, out = parsed.words.owner(), []
    for i in hits.tolist():
        text = int(owner[i])
        out.append((text, i - int(parsed.words.first[text]), parsed.window, None, None))
    for r, packed in regions:
        text = int(parsed.text[r])
        begin = int(parsed.region[r, 0] - parsed.words.first[text])
        for at, size, doc, word, other_doc, other_word in np.frombuffer(packed, np.int64).reshape(-1, 6).tolist():
            if (doc, word) == (_NONE if ids[text] is None else ids[text], begin + at):
                doc, word = other_doc, other_word
            out.append((text, begin + at, size, None if doc == _NONE else doc, word))
    joined: list[tuple] = []
    for text, at, size, doc, word in sorted(out, key=lambda x: (x[0], x[1], -x[2])):
        if joined:
            t, a, n, d, o = joined[-1]
            if (t, d) == (text, doc) and at <= a + n and (o is None) == (word is None) and (o is None or word - o == at - a):
                joined[-1] = (t, a, max(n, at + size - a), d, o)
                continue
        joined.append((text, at, size, doc, word))
    return joined


def kept_words(table: pa.Table, found: w.Words, covered: np.ndarray) -> list[bytes]:
    """Each text's words that no repeated window covers, joined by one space."""
    removed = np.concatenate([[0], np.cumsum(covered)])
    out = []
    for text, a, b in zip(w.binary(table.column("text")).to_pylist(), found.first[:-1].tolist(), found.first[1:].tolist(), strict=True):
        each = text.split()
        out.append(b" ".join(compress(each, (~covered[a:b]).tolist()) if removed[b] > removed[a] else each))
    return out


def removal_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""

    def emit(table: pa.Table, found: w.Words, covered: np.ndarray, _) -> pa.Table:
        removed = np.concatenate([[0], np.cumsum(covered)])
        a, b = found.first[:-1], found.first[1:]
        return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(b - a), "n_removed": pa.array(removed[b] - removed[a]), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept_words(table, found, covered)], pa.string())})

    return parse(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string", emit)


def factors(docs: DataFrame) -> DataFrame:
    """doc_id, first_word, n_words, source_doc_id, source_word: every factor of every row and where its words start elsewhere.

    Factors with different sources may overlap. The source is null where single windows of a crowded seed were looked up.
    """
    names = ["doc_id", "first_word", "n_words", "source_doc_id", "source_word"]

    def emit(table: pa.Table, found: w.Words, covered: np.ndarray, factors) -> pa.Table:
        ids, rows = table.column("doc_id").to_pylist(), [(x[0], *x[1:]) for x in factors()]
        columns = list(zip(*[(ids[t], a, n, d, o) for t, a, n, d, o in rows], strict=True)) or [[]] * 5
        return pa.table({k: pa.array(v, pa.int64()) for k, v in zip(names, columns, strict=True)})

    return parse(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ", ".join(f"{x} bigint" for x in names), emit)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The same rows and columns with the kept words as text; rows of which nothing is removed keep their text as it is."""
    numbered = docs.withColumn("text", F.col("text").cast("binary"))
    names = [c for c in docs.columns if c != "text"]
    packed = numbered.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("row"), "text", F.col("text").isNull().alias("absent"))

    def emit(table: pa.Table, found: w.Words, covered: np.ndarray, _) -> pa.Table:
        removed = np.concatenate([[0], np.cumsum(covered)])
        some = removed[found.first[1:]] > removed[found.first[:-1]]
        texts = [None if gone else k if s else t for gone, s, t, k in zip(table.column("absent").to_pylist(), some, w.binary(table.column("text")).to_pylist(), kept_words(table, found, covered), strict=True)]
        return pa.table({"row": table.column("row"), "text": pa.array(texts, pa.binary())})

    out = parse(packed, T.StructType([packed.schema["row"], T.StructField("text", T.BinaryType())]), emit)
    place = {c: f"c{i}" for i, c in enumerate(names)}
    return out.select(*[F.col("row")[place[c]].alias(c) if c != "text" else F.col("text").cast("string").alias("text") for c in docs.columns])

"""Best-fit-decreasing packing of tokenised documents into sequences of fixed length.

Pieces of the same length are interchangeable, so the packing is decided on the histogram of lengths: at most
``capacity`` numbers, whatever the corpus. Lengths are placed in decreasing order, each piece into the tightest open
sequence, found by a segment tree over remaining capacities in logarithmic time; equal sequences are handled as one
class with a count. Every piece then finds its place from its global rank among pieces of its length. The result is
the packing that best-fit decreasing gives on all pieces at once, with no task that sees them all.

Edge cases: a null text is empty and still has its end token; repeated rows are packed once each; a document longer
than the capacity is cut into whole pieces from the back, so only its first piece may be shorter; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.blocks import narrow_batches, staged, totals

#: Distinct stretches of text whose ids a worker remembers.
REMEMBERED = 100_000

#: Fixed value: how byte-level tokenizers of this kind cut a text into pre-tokens.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A space after white space (as any of the libraries sees it) starts no stretch of its own.
_LOOSE = re.compile(r"[\s\x1c-\x1f\x85᠎​﻿] ")
_STRETCH = re.compile(r"(?<=[^\s\x1c-\x1f\x85᠎​﻿]) ")
_encoders: dict[tuple[str, str | None], Encoder] = {}


class Encoder:
    """Token ids of whole texts. A space behind a visible character always starts a new pre-token of a byte-level
    tokenizer, so the stretches between such spaces are encoded apart and remembered. With ``ranks`` (the same
    vocabulary as ranked tokens) stretches of Latin letters without special tokens go to the faster library."""

    def __init__(self, path: str, ranks: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.ranked = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                vocabulary = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self.ranked = tiktoken.Encoding("ranked", pat_str=PRE_TOKEN, mergeable_ranks=vocabulary, special_tokens={})
            self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
            self.sizes[list(vocabulary.values())] = [len(token) for token in vocabulary]

    def ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        plain = text.isascii()
        if "  " in text or "\n " in text or not plain or _LOOSE.search(text):
            first, *rest = _STRETCH.split(text)
        else:
            first, *rest = text.split(" ")
        ends = [first] if not rest else [first, " " + rest.pop()]  # only the last may end in white space
        if new := set(rest).difference(self.known):
            if len(self.known) > REMEMBERED:
                self.known, self.before = {}, self.known
                new = set(rest)
            self._learn(new, bool(self.ranked) and plain and "<|" not in text)
        ends = self._alone(ends)
        return b"".join([ends[0], *map(self.known.__getitem__, rest), *ends[1:]])

    def _latin(self, stretch: str) -> bool:
        return bool(self.ranked) and (stretch.isascii() or max(stretch) < "\u0250") and "<|" not in stretch

    def _alone(self, stretches: list[str]) -> list[bytes]:
        """Ids of each stretch, its space included."""
        out = [np.array(self.ranked.encode_ordinary(x), "<u4").tobytes() if x and self._latin(x) else b"" for x in stretches]
        others = [i for i, x in enumerate(stretches) if x and not self._latin(x)]
        if others:
            for i, found in zip(others, self.library.encode_batch([stretches[i] for i in others], add_special_tokens=False), strict=True):
                out[i] = np.array(found.ids, "<u4").tobytes()
        return out

    def _learn(self, new: set[str], plain: bool) -> None:
        """Remember stretches that end visibly, given without the space before them. Latin ones are encoded as one text, which no
        pre-token crosses from one to the next, and their ids are told apart by the bytes of each token."""
        known, before = self.known, self.before
        known.update([(x, before[x]) for x in new if x in before])
        latin = [x for x in new if x not in before and (plain or self._latin(x))]
        if latin:
            joined = " " + " ".join(latin)
            ids = np.array(self.ranked.encode_ordinary(joined), "<u4")
            ends = np.cumsum([len(x) + 1 for x in latin] if joined.isascii() else [len(x.encode()) + 1 for x in latin])
            cuts = (4 * np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 4).tolist()
            held = ids.tobytes()
            known.update(zip(latin, [held[at:to] for at, to in zip([0, *cuts[:-1]], cuts, strict=True)], strict=True))
        if not plain and (others := [x for x in new if x not in known]):
            known.update(zip(others, self._alone([" " + x for x in others]), strict=True))


def encoder(path: str, ranks: str | None = None) -> Encoder:
    """The worker's own encoder, kept between tasks."""
    if (path, ranks) not in _encoders:
        _encoders[path, ranks] = Encoder(path, ranks)
    return _encoders[path, ranks]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end: int = 2, ranks: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and the piece's rank among those of its length in its part."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer, ranks).ids, TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        tail = int(end).to_bytes(4, "little")
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "rank")}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + tail
                n = len(ids) // 4
                at, to, piece = 0, (n - 1) % capacity + 1, 0
                while at < n:
                    length = to - at
                    out["doc_id"].append(doc)
                    out["piece"].append(piece)
                    out["start"].append(at)
                    out["length"].append(length)
                    out["ids_crc32"].append(zlib.crc32(ids[4 * at : 4 * to]))
                    out["rank"].append(seen[length])
                    seen[length] += 1
                    at, to, piece = to, to + capacity, piece + 1
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k == "piece" else pa.int64()) for k, v in out.items()} | {"part": pa.array([part] * len(out["piece"]), pa.int32())})

    narrow_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, rank bigint, part int")


class OpenSequences:
    """Counts of open sequences by remaining capacity, as a segment tree of sums."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.sums = [0] * (2 * self.size)
        self.classes: dict[int, list[tuple[int, int, int]]] = {}

    def _add(self, remaining: int, count: int) -> None:
        at = self.size + remaining
        while at:
            self.sums[at] += count
            at //= 2

    def put(self, remaining: int, base: int, count: int, filled: int) -> None:
        if count and remaining:
            self.classes.setdefault(remaining, []).append((base, count, filled))
            self._add(remaining, count)

    def take(self, remaining: int) -> tuple[int, int, int]:
        found = self.classes[remaining].pop()
        self._add(remaining, -found[1])
        return found

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of at least ``length`` that some open sequence has."""
        at = self.size + length
        while not self.sums[at]:
            while at & 1:  # a right child: what follows is to the right of its parent
                at //= 2
            if at == 0:
                return None
            at += 1
        while at < self.size:
            at = 2 * at if self.sums[2 * at] else 2 * at + 1
        return at - self.size


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths.

    Returns placements (length, first rank, pieces in each sequence, first sequence, offset), ordered by length and
    first rank: the ranks from there on fill one sequence after another.
    """
    trees, made, placed = OpenSequences(capacity), 0, []
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            if (room := trees.tightest(length)) is None:
                room, (base, count, filled) = capacity, (made, -(-left // (capacity // length)), 0)
                made += count
            else:
                base, count, filled = trees.take(room)
            each = room // length
            whole = min(count, left // each)
            if whole:
                placed.append((length, rank, each, base, filled))
                trees.put(room - each * length, base, whole, filled + each * length)
                rank, left = rank + whole * each, left - whole * each
            if left and whole < count:  # fewer than fill one more sequence
                placed.append((length, rank, left, base + whole, filled))
                trees.put(room - left * length, base + whole, 1, filled + left * length)
                rank, left, whole = rank + left, 0, whole + 1
            trees.put(room, base + whole, count - whole, filled)
    return sorted(placed)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end: int = 2, ranks: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece.

    The driver receives one count for each length; the table of placements that tasks get has a few entries for
    each length, whatever the number of documents.
    """
    cut = staged(pieces(docs, tokenizer, capacity, end, ranks))
    counts = staged(cut.groupBy("length", "part").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placed = best_fit(histogram, capacity)
    keys = [(p[0], p[1]) for p in placed]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = [], []
            for key in zip(batch.column("length").to_pylist(), batch.column("place").to_pylist(), strict=True):
                length, rank, each, base, filled = placed[bisect_right(keys, key) - 1]
                in_bin = (key[1] - rank) % each
                sequence.append(base + (key[1] - rank) // each)
                offset.append(filled + in_bin * length)
            kept = {k: batch.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            yield pa.RecordBatch.from_pydict(kept | {"sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64())})

    before = totals(counts, ["length"], "part", "n", "before").select("length", "part", "before")
    # ``before`` grows with the parts, so it is never broadcast
    ranked = cut.join(before.hint("merge"), ["length", "part"]).withColumn("place", F.col("rank") + F.col("before"))
    return ranked.mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")

"""Fill-in-the-middle forms of documents: prefix, middle and suffix, cut at seeded code points and put in another order.

A distinct-text index is made first: rows are grouped by a 256-bit digest, and a group's smallest and largest text are
compared, so equal content is verified and not assumed. The index meets the documents again by digest, in its order: with
the first row of a text an Elias-Fano list of the byte offsets of its code points is made, once - upper bits in unary with the
place of every 256th, lower bits packed, so that any boundary is found in constant time - and every row of the text selects its
two cuts from it.

Texts are shuffled once, compressed, one for each map task and different text; the rows that meet them are an id and a digest,
and come to where the index is. (An index that held the lists was tried first; a Python column loses the index' partitioning, so all texts
were shuffled again.) A text with more than CROWD copies (or a 100,000th of all rows, so that the table of such texts stays small enough
to broadcast at any size) is dealt to as many parts as its rows ask for, each with the index entry.

Edge cases: a null text is an empty one; an empty text, or one that contains a marker, stays plain; a null id counts as an
empty one; repeated rows give repeated results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.llm import words as w
from matchlake.llm.blocks import narrow_batches, staged

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Rows of one text that are cut in one task; the text is dealt to more tasks beyond.
CROWD = 500
#: Most texts that may have so many rows, whatever the table's size.
CROWDS = 100_000
#: Every so many boundaries the place of one in the upper bits is kept.
STEP = 256

_HEADER = struct.Struct("<QB")
_LENGTH = struct.Struct("<Q")


def boundaries(text: bytes) -> bytes:
    """Elias-Fano list of the offsets at which code points start, and of the text's end."""
    data = np.frombuffer(text, np.uint8)
    ends = np.append(np.flatnonzero(data & 0xC0 != 0x80), len(data))
    low = max(0, (len(data) // len(ends)).bit_length() - 1)
    place = (ends >> low) + np.arange(len(ends))
    upper = np.zeros(int(place[-1]) + 1, np.uint8)
    upper[place] = 1
    lower = (ends[:, None] >> np.arange(low) & 1).astype(np.uint8)
    return _HEADER.pack(len(ends) - 1, low) + place[::STEP].astype("<u8").tobytes() + np.packbits(lower, bitorder="little").tobytes() + np.packbits(upper, bitorder="little").tobytes()


class Boundaries:
    """Reads offsets from the list that ``boundaries`` makes."""

    def __init__(self, form: bytes):
        self.n, self.low = _HEADER.unpack_from(form)
        at = _HEADER.size + 8 * (self.n // STEP + 1)
        self.places = np.frombuffer(form, "<u8", self.n // STEP + 1, _HEADER.size)
        self.lower = np.frombuffer(form, np.uint8, -(-(self.n + 1) * self.low // 8), at)
        self.upper = np.frombuffer(form, np.uint8, offset=at + len(self.lower))

    def __getitem__(self, i: int) -> int:
        """The offset of code point i (of the end for i = n). Code points have four bytes at most, so STEP of them end
        within 5 * STEP bits of the place that is kept."""
        start = int(self.places[i // STEP])
        bits = np.unpackbits(self.upper[start // 8 : start // 8 + 5 * STEP // 8 + 2], bitorder="little")[start % 8 :]
        high = start + int(np.flatnonzero(bits)[i % STEP]) - i
        own = 0
        for k in range(i * self.low, (i + 1) * self.low):
            own |= int(self.lower[k // 8] >> k % 8 & 1) << (k - i * self.low)
        return high << self.low | own


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as their length and compressed bytes."""
    codec = pa.Codec("zstd")
    for batch in batches:
        each = [_LENGTH.pack(len(x)) + codec.compress(x, asbytes=True) for x in w.binary(batch.column(1)).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(each, pa.binary())], names=["digest", "packed"])


def _unpacked(packed: bytes) -> bytes:
    return pa.Codec("zstd").decompress(packed[_LENGTH.size :], _LENGTH.unpack_from(packed)[0], asbytes=True)


def indexed(texts: DataFrame) -> DataFrame:
    """digest and packed (compressed text) of each different text; fails where one digest has two texts."""
    same = texts.mapInArrow(_packed, "digest binary, packed binary").groupBy("digest").agg(F.min("packed").alias("packed"), F.max("packed").alias("other"))
    return same.select("digest", F.when(F.col("packed") == F.col("other"), F.col("packed")).otherwise(F.raise_error(F.lit("two texts of one digest"))).alias("packed"))


def _cut(seed: int, plain_from: int, spm_below: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, text, index = None, b"", Boundaries(boundaries(b""))
        for batch in batches:
            out = []
            for doc_id, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if packed != own:
                    own, text = packed, _unpacked(packed)
                    index = Boundaries(boundaries(text))
                h = struct.unpack(">4I", hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()[:16])
                a, b = sorted((h[0] % (index.n + 1), h[1] % (index.n + 1)))
                if not text or h[2] % 100 >= plain_from or any(m.encode() in text for m in (PREFIX, SUFFIX, MIDDLE)):
                    out.append((doc_id, index.n, "plain", None, None, text))
                    continue
                i, j = index[a], index[b]
                parts = {PREFIX: text[:i], MIDDLE: text[i:j], SUFFIX: text[j:]}
                form, order = ("spm", (SUFFIX, PREFIX, MIDDLE)) if h[3] % 100 < spm_below else ("psm", (PREFIX, SUFFIX, MIDDLE))
                out.append((doc_id, index.n, form, a, b - a, b"".join(m.encode() + parts[m] for m in order)))
            each = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            arrays = [pa.array(x, kind) for x, kind in zip(each, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays[:5], arrays[5].cast(pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def transform(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """doc_id, n (code points), form (plain, psm or spm), prefix_chars, middle_chars and output (the text in its new order)
    of every row."""
    narrow_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text.alias("text"))
    rows = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")))
    most = max(CROWD, rows.count() // CROWDS)
    crowds = staged(rows.groupBy("digest").agg(F.count("*").alias("copies")).filter(F.col("copies") > most).select("digest", F.expr(f"cast(copies div {most} as int)").alias("parts")))
    few = F.broadcast(crowds)  # CROWDS rows at most
    met = rows.join(few, "digest", "left_anti").join(indexed(texts.join(few, "digest", "left_anti")), "digest").select("doc_id", "packed")
    part = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.col("parts") + 1).cast("int")
    crowded = indexed(texts.join(few, "digest", "left_semi")).join(few, "digest").withColumn("part", F.explode(F.sequence(F.lit(0), "parts")))
    dealt = rows.join(few, "digest").select("doc_id", "digest", part.alias("part"))
    met = met.unionByName(dealt.join(crowded, ["digest", "part"]).select("doc_id", "packed"))
    return met.mapInArrow(_cut(seed, 100 - plain_percent, spm_percent), "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text from its output and form. No marker can arise where two parts meet, since only their first character is
    a bracket."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def form_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the digests of the output and of the text rebuilt from it."""
    made = transform(docs)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))

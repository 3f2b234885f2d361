"""Byte-pair encoding by backtracking over longest token matches, and decoding by an offset table.

For each pre-token an Aho-Corasick automaton finds every vocabulary entry at every place. The encoder takes the longest
token at each place whose neighbour it is compatible with and steps back where none fits; the compatibility of a pair
(that merging never crosses their border) is decided from the merge ranks and remembered in a table. The result equals
applying the merges by rank, in time linear in the text. Vocabulary and merges are read from a tokenizer file whose
pre-tokens never hold white space, so pieces between white space are encoded once and remembered.

Edge cases: a null text is empty and has no tokens; special tokens found in a text keep their own ids; repeated rows and
null ids are kept; an empty table gives an empty result; other columns are not read. Memory follows the longest text
and the bounded memory of pieces; no row leaves its partition.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct pieces between white space that a worker remembers.
REMEMBERED = 300_000

_SPACE = regex.compile(r"\p{White_Space}+")
#: Characters that Python's split() drops though they are no Unicode white space.
_SEPARATORS = regex.compile(r"[\x1c-\x1f]")
_coders: dict[str, Coder] = {}


def byte_letters() -> list[str]:
    """The visible letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest
    for the code points from 256 on, in order."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b if b in shown else 256 + hidden.index(b)) for b in range(256)]


class Coder:
    """Encoder and decoder of one tokenizer file (byte-level BPE with an end-of-word mark)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.mark = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"].replace(r"[^\s", r"[^\p{White_Space}"))
        # symbols: a letter, or a letter with the end-of-word mark, written as one character beyond the letters
        self.letters = byte_letters()
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for i, (a, b) in enumerate(x.split(" ") if isinstance(x, str) else x for x in model["merges"]):
            if (pair := (self.vocab[a], self.vocab[b])) not in self.merged:
                token = self.vocab[a + b]
                self.merged[pair] = i
                if token not in self.parts:
                    self.parts[token], self.rank[token] = pair, i
        self.compatible: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in self.vocab.items():
            symbols = self._symbols(token)
            if symbols and self._stands(i):
                self.automaton.add_word(symbols, (i, len(symbols)))
        self.automaton.make_automaton()
        names = sorted([*self.vocab.items(), *self.special.items()], key=lambda x: x[1])
        blob = [name.encode() for _, name in sorted({i: name for name, i in names}.items())]
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in blob])]).tolist()
        self.blob = b"".join(blob)
        self.places = {i: k for k, i in enumerate(sorted({i for _, i in names}))}
        self.pieces: dict[str, tuple[str, str]] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def _symbols(self, token: str) -> str:
        """A vocabulary entry as symbols; the end-of-word mark is part of the last one."""
        if self.mark and token.endswith(self.mark) and token != self.mark:
            plain = token[: -len(self.mark)]
            return plain[:-1] + chr(ord(plain[-1]) + 0x1000)
        return token

    def _stands(self, token: int) -> bool:
        """Whether merging a token's own symbols gives that token."""
        if token not in self.parts:
            return True
        left, right = self.parts[token]
        return self._stands(left) and self._stands(right) and self._border(left, right, self.rank[token])

    def _border(self, left: int, right: int, limit: float) -> bool:
        """Whether no merge across the border comes before both sides are whole, among merges of rank under limit.

        Walks back in time: of the two tokens that touch, the one made later is taken apart. A pair that would have
        merged before that moment breaks the border; at the same rank the merge further left comes first.
        """
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < limit:
                return False
            a, b = self.rank.get(left, -1), self.rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                left, limit = self.parts[left][1], min(limit, a)
            else:
                right, limit = self.parts[right][0], min(limit, b + 1)

    def fits(self, left: int, right: int) -> bool:
        pair = (left, right)
        if (known := self.compatible.get(pair)) is None:
            if len(self.compatible) > REMEMBERED:
                self.compatible.clear()
            known = self.compatible[pair] = self._border(left, right, float("inf"))
        return known

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of a pre-token (its text, not yet in byte letters)."""
        if (known := self.words.get(word)) is not None:
            return known
        text = "".join([self.letters[b] for b in word.encode()])
        if self.mark:
            text = text[:-1] + chr(ord(text[-1]) + 0x1000)
        starts: list[list[tuple[int, int]]] = [[] for _ in text]
        for end, found in self.automaton.iter(text):
            starts[end + 1 - found[1]].append(found)  # shorter ones first
        n, at, ids, taken = len(text), 0, [], []
        dead = [False] * (n + 1)
        choice = len(starts[0]) - 1
        while at < n:
            options = starts[at]
            while choice >= 0:
                token, length = options[choice]
                if not dead[at + length] and (not ids or self.fits(ids[-1], token)):
                    break
                choice -= 1
            if choice >= 0:
                ids.append(token)
                taken.append((at, choice))
                at += length
                choice = len(starts[at]) - 1 if at < n else 0
            else:  # nothing leads on from here: try a shorter token before
                dead[at] = True
                if not taken:
                    raise ValueError("a byte has no token")
                ids.pop()
                at, choice = taken.pop()
                choice -= 1
        if len(self.words) > REMEMBERED:
            self.words.clear()
        self.words[word] = out = tuple(ids)
        return out

    def _plain(self, text: str) -> list[int]:
        if not text.isascii():
            text = "".join([c.lower() for c in unicodedata.normalize("NFC", text)])
        else:
            text = text.lower()
        return [i for word in self.pattern.findall(text) for i in self.word(word)]

    def piece(self, piece: str) -> tuple[str, str]:
        """Ids and decoded text of a piece without white space."""
        if (known := self.pieces.get(piece)) is not None:
            return known
        ids: list[int] = []
        at = 0
        if self.special_pattern and "<" in piece:
            for m in self.special_pattern.finditer(piece):
                ids += self._plain(piece[at : m.start()])
                ids.append(self.special[m[0]])
                at = m.end()
        ids += self._plain(piece[at:])
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        self.pieces[piece] = out = (" ".join(map(str, ids)), self.decode(ids))
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for piece in self.split(text) for i in self.piece(piece)[0].split()]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space, each cut from the table of token bytes; unknown ids give nothing."""
        at = [k for i in ids if (k := self.places.get(i)) is not None]
        return " ".join([self.blob[self.offsets[k] : self.offsets[k + 1]].decode() for k in at])

    @staticmethod
    def split(text: str) -> list[str]:
        return [x for x in _SPACE.split(text) if x] if _SEPARATORS.search(text) else text.split()

    def both(self, text: str) -> tuple[str, str]:
        """Ids joined by one space, and the decoded text."""
        pieces = self.split(text)
        if not pieces:
            return "", ""
        known = self.pieces.get
        found = [known(x) or self.piece(x) for x in pieces]
        ids, decoded = zip(*found, strict=True)
        return " ".join(ids), " ".join(decoded)


def coder(path: str) -> Coder:
    """The worker's own coder, kept between tasks."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids array<int>, decoded string of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(tokenizer)
        for batch in batches:
            ids = [code.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array([code.decode(x) for x in ids], pa.string())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")


def coding_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(tokenizer)
        for batch in batches:
            n, a, b = [], [], []
            for text in batch.column(1):
                ids, decoded = code.both(text.as_py() or "")
                n.append(ids.count(" ") + bool(ids))
                a.append(hashlib.sha256(ids.encode()).hexdigest())
                b.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")

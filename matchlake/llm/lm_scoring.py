"""Prediction by partial matching over bytes: a context trie with escape estimation and symbol exclusion.

The trie of all contexts of up to ``ORDER`` bytes is held as counts of (context, next byte), gathered from the training
documents. A byte is predicted from the longest known context; where that has never been followed by the byte, the
model escapes to the context one byte shorter, from which the bytes already offered are excluded, down to a uniform
guess. Every text starts in a context of its own and ends with an end symbol that is predicted like a byte.

The corpus is cut into blocks. A block sends the distinct byte runs (a full context and the next byte) and word hashes
of its texts to parts; a part holds every context that ends with its bytes, so it can escape without other parts. It sums
the training counts, computes each run's probability once, and returns to each block those of its own runs. A block then
adds up its documents' code lengths. Nothing but the 65,536 counts of byte pairs and two totals passes the driver.

Words for the base score are runs of bytes other than ASCII white space with A-Z in lower case, counted by 63-bit hash.

Edge cases: a null text is empty: its tokens are the end alone. A row with null id trains the model. Repeated rows count
each time. With no training text at all every byte is guessed uniformly. An empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm import words as w
from matchlake.llm.blocks import block_count, groups, staged, with_block

#: Bytes of context; a run of context and next byte must fit 48 bits.
ORDER = 5
#: Marks that UTF-8 never holds: before a text, and its end symbol.
BEFORE, END = 0xFE, 0xFF
#: Symbols that can be predicted: all bytes but BEFORE.
SYMBOLS = 255
#: Blocks whose rows meet in one task.
FAN = 64
RUNS, WORDS, PAIRS = 0, 1, 2

_U = np.uint64
_LINK = bytes([END] + [BEFORE] * ORDER)
_TABLE = "kind int, part int, salt int, block int, keys binary, counts binary"


def byte_runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each predicted symbol with the ORDER bytes before it as one number, and where each text's runs begin."""
    data = np.frombuffer(_LINK[1:] + _LINK.join(texts) + _LINK[:1], np.uint8)
    n = len(data) - ORDER
    run = np.zeros(n, _U)
    for j in range(ORDER + 1):
        run <<= _U(8)
        run |= data[j : j + n]
    run = run[data[ORDER:] != BEFORE]
    return run, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])


def counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    order, start = groups(keys)
    return keys[order][start], np.add.reduceat(counts[order], start) if len(start) else counts[:0]


def _of(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in 4 bytes each where they fit, else in 8."""
    return counts.astype(np.uint32 if counts.max(initial=0) < 1 << 32 else np.int64).tobytes()


def _wide(keys: bytes, counts: bytes) -> np.ndarray:
    return np.frombuffer(counts, np.uint32 if 2 * len(counts) == len(keys) else np.int64).astype(np.int64)


def _joined(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of all rows, summed by key."""
    keys, counts = table.column("keys").to_pylist(), table.column("counts").to_pylist()
    return counted(np.concatenate(_of(table.column("keys"), _U)), np.concatenate([_wide(k, c) for k, c in zip(keys, counts, strict=True)]))


def _packed(kind: int, part: int, salt: int, block: int, keys: np.ndarray, counts: np.ndarray) -> dict:
    return {"kind": kind, "part": part, "salt": salt, "block": block, "keys": keys.tobytes(), "counts": _narrow(counts)}


_SCHEMA = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("salt", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def _order(kind: int, keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of keys by part, and where each part's begin: runs by the last two bytes of context, words by hash."""
    part = (w.mix(keys >> _U(8) & _U(0xFFFF) if kind == RUNS else keys) % _U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _dealt(kind: int, block: int, keys: np.ndarray, counts: np.ndarray, parts: int) -> list[dict]:
    """One row for each part."""
    order, edges = _order(kind, keys, parts)
    keys, counts = keys[order], counts[order]
    return [_packed(kind, p, block // FAN, block, keys[a:b], counts[a:b]) for p, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]


def _sliced(table: pa.Table) -> list[pa.Table]:
    column = w.binary(table.column("text"))
    return [table.slice(a, b - a) for a, b in w.slices(len(column), w.raw(column)[1])]


def distinct(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The distinct runs and words of a block in order, with their training counts (0: only in other texts)."""
    found: dict[int, list] = {RUNS: [], WORDS: []}
    for part in _sliced(table):
        column = w.binary(part.column("text"))
        train = part.column("train").to_numpy().astype(_U)
        run, first = byte_runs(column.to_pylist())
        split = w.split(column)
        own = (run << _U(1) | np.repeat(train, np.diff(first)), split.hashes(lower=True) & ~_U(1) | np.repeat(train, np.diff(split.first)))
        for kind, values in zip(found, own, strict=True):
            values, counts = np.unique(values, return_counts=True)
            keys = values >> _U(1) if kind == RUNS else values & ~_U(1)
            each = found[kind]
            each.append(counted(keys, counts * (values & _U(1)).astype(np.int64)))
            while len(each) > 1 and 2 * len(each[-1][0]) > len(each[-2][0]):  # few slices' keys are held apart
                (k, n), (keys, counts) = each.pop(), each.pop()
                each.append(counted(np.concatenate([k, keys]), np.concatenate([n, counts])))
    return {kind: counted(np.concatenate([k for k, _ in each]), np.concatenate([c for _, c in each])) for kind, each in found.items()}


def gather(docs: DataFrame, parts: int) -> DataFrame:
    """Distinct runs and words of each block with their training counts, dealt to parts."""

    def block(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        at, rows = key[0].as_py(), []
        for kind, (keys, counts) in distinct(table).items():
            rows += _dealt(kind, at, keys, counts, parts)
            if kind == RUNS:
                seen = counts > 0
                rows.append(_packed(PAIRS, 0, at // FAN, at, *counted(keys[seen] & _U(0xFFFF), counts[seen])))
        return pa.Table.from_pylist(rows, _SCHEMA)

    return docs.groupBy("block").applyInArrow(block, _TABLE)


def summed(table: DataFrame, *keys: str) -> DataFrame:
    """Add up the counts of rows with the same keys; at most FAN blocks, or their sums, meet in a task."""

    def add(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist([_packed(*(table.column(c)[0].as_py() for c in ("kind", "part", "salt")), -1, *_joined(table))], _SCHEMA)

    return table.groupBy(*keys).applyInArrow(add, _TABLE)


def _lookup(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted table, and which are there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def log_probabilities(runs: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 probability of each run's symbol after its context.

    runs: distinct, with all those that share their last two context bytes; counts: theirs in training; pairs: the
    training counts of (last context byte, symbol). Escapes follow method D: half a count of each symbol goes to them.
    """
    trained = counts > 0
    out, left = np.zeros(len(runs)), np.arange(len(runs))
    offered_total, offered_kinds = np.zeros(len(runs)), np.zeros(len(runs))
    single = pairs.sum(axis=0)
    for order in range(ORDER, -1, -1):
        mask = _U((1 << 8 * (order + 1)) - 1)
        if order >= 2:
            grams, n = counted(runs[trained] & mask, counts[trained])
            start = groups(grams >> _U(8))[1]  # in order already
            contexts = (grams >> _U(8))[start]
            total, kinds = (np.add.reduceat(n, start), np.diff(np.append(start, len(grams)))) if len(start) else (n, n)
        elif order == 1:
            grams, n = np.flatnonzero(pairs.ravel()).astype(_U), pairs.ravel()[np.flatnonzero(pairs.ravel())]
            contexts, total, kinds = np.arange(256).astype(_U), pairs.sum(axis=1), (pairs > 0).sum(axis=1)
        else:
            grams, n = np.flatnonzero(single).astype(_U), single[np.flatnonzero(single)]
            contexts, total, kinds = np.zeros(1, _U), single.sum(keepdims=True), np.array([(single > 0).sum()])
        # the shorter context's counts of the symbols that this one offers
        if order:
            shorter = (1 << 8 * order) - 1
            if order > 2:
                below, m = counted(runs[trained] & _U(shorter), counts[trained])
                shared = m[_lookup(below, grams & _U(shorter))[0]] if len(below) else n[:0]
            elif order == 2:
                shared = pairs.ravel()[(grams & _U(0xFFFF)).astype(np.int64)]
            else:
                shared = single[(grams & _U(0xFF)).astype(np.int64)]
            where = _lookup(contexts, grams >> _U(8))[0]
            covered = np.bincount(where, shared, len(contexts)) if len(contexts) else np.zeros(0)
        gram = runs[left] & mask
        at, known = _lookup(contexts, gram >> _U(8))
        known &= (total[at] > 0) if len(total) else False
        place, found = _lookup(grams, gram)
        free = (total[at] if len(total) else 0) - offered_total[left]
        fresh = (kinds[at] if len(kinds) else 0) - offered_kinds[left]
        found &= known
        with np.errstate(divide="ignore", invalid="ignore"):
            hit = np.log10((2 * n[place] - 1) / (2 * free)) if len(n) else np.zeros(len(left))
            escape = np.where(known & (free > 0), np.log10(fresh / (2 * free)), 0.0)
        out[left] += np.where(found, hit, escape)
        if order and len(contexts):
            offered_total[left] = np.where(known, covered[at], 0)
            offered_kinds[left] = np.where(known, kinds[at], 0)
        elif order == 0:
            offered_kinds[left] = np.where(known, kinds[at], 0)
        left = left[~found]
    out[left] -= np.log10(np.maximum(1, SYMBOLS - offered_kinds[left]))
    return out


def valued(sums: DataFrame, pairs: np.ndarray) -> DataFrame:
    """Each part's keys with their values: log10 probabilities of runs, counts of words; and the parts' totals."""

    def part(table: pa.Table) -> pa.Table:
        kind, keys, counts = table.column("kind")[0].as_py(), *_joined(table)
        values = log_probabilities(keys, counts, pairs).astype(np.float32).tobytes() if kind == RUNS else _narrow(counts)
        row = {"kind": kind, "part": table.column("part")[0].as_py(), "keys": keys.tobytes(), "values": values, "total": int(counts.sum()), "known": int((counts > 0).sum())}
        return pa.Table.from_pylist([row], pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("values", pa.binary()), ("total", pa.int64()), ("known", pa.int64())]))

    return sums.groupBy("kind", "part").applyInArrow(part, "kind int, part int, keys binary, values binary, total bigint, known bigint")


def _values(kind: int, count: int, values: bytes) -> np.ndarray:
    """log10 probabilities of runs in 4 bytes each, counts of words in 4 or 8."""
    return np.frombuffer(values, np.int64 if len(values) == 8 * count else np.float32 if kind == RUNS else np.uint32)


def returned(sent: DataFrame, values: DataFrame) -> DataFrame:
    """To each block the values of the keys that it sent, in its order of keys."""

    def give(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows:
            kind, part = (left.column(c)[0].as_py() for c in ("kind", "part"))
            table = np.frombuffer(right.column("keys")[0].as_py(), _U)
            value = _values(kind, len(table), right.column("values")[0].as_py())
            for block, keys in zip(left.column("block").to_pylist(), left.column("keys").to_pylist(), strict=True):
                rows.append({"block": block, "kind": kind, "part": part, "values": value[np.searchsorted(table, np.frombuffer(keys, _U))].tobytes()})
        return pa.Table.from_pylist(rows, pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("part", pa.int32()), ("values", pa.binary())]))

    keys = ["kind", "part", "salt"]
    return sent.groupBy(*keys).cogroup(values.groupBy(*keys)).applyInArrow(give, "block int, kind int, part int, values binary")


def score(docs: DataFrame, held_out: F.Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    held_out marks the rows that the model doesn't learn from.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.unhex(F.lit(""))).alias("text"), held_out.alias("held_out"))
    blocks = block_count(rows)
    rows = with_block(rows, blocks, "doc_id", "text").withColumn("train", (~F.col("held_out")).cast("int"))
    sent = staged(gather(rows.select("block", "text", "train"), blocks))
    pairs = np.zeros(1 << 16, np.int64)
    few = summed(summed(sent.filter(F.col("kind") == PAIRS), "salt"), "kind").collect()  # at most 65,536 counts
    for row in few:
        pairs[np.frombuffer(row["keys"], _U).astype(np.int64)] = _wide(row["keys"], row["counts"])
    sent = sent.filter(F.col("kind") != PAIRS)
    sums = summed(sent, "kind", "part", "salt") if blocks > FAN else sent
    values = staged(valued(sums, pairs.reshape(256, 256)))
    ends = rows.agg(F.sum("train")).first()[0] or 0
    words, kinds = values.filter(F.col("kind") == WORDS).agg(F.sum("total"), F.sum("known")).first()
    tokens, vocabulary = (words or 0) + ends, (kinds or 0) + bool(ends)
    salts = F.explode(F.sequence(F.lit(0), F.lit((blocks - 1) // FAN))).alias("salt")
    back = returned(sent, values.select("kind", "part", "keys", "values", salts))

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = {}
        known = distinct(left) if left.num_rows else {}
        for kind in [*known]:
            keys, _ = known.pop(kind)
            order, edges = _order(kind, keys, blocks)
            own = {p: v for k, p, v in zip(*(right.column(c).to_pylist() for c in ("kind", "part", "values")), strict=True) if k == kind}
            value = [_values(kind, b - a, own[p]) for p, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if b > a]
            tables[kind] = w.Table(keys[order], np.concatenate([np.zeros(0, np.float32 if kind == RUNS else np.uint32), *value]))
        out = []
        for part in _sliced(left) if left.num_rows else []:
            column = w.binary(part.column("text"))
            run, first = byte_runs(column.to_pylist())
            total = np.add.reduceat(tables[RUNS][run].astype(np.float64), first[:-1])
            split = w.split(column)
            count = tables[WORDS][split.hashes(lower=True) & ~_U(1)].astype(np.float64)
            each = np.concatenate([[0], np.cumsum(np.log10((count + 1) / (tokens + vocabulary + 1)))])
            known = np.concatenate([[0], np.cumsum(count > 0)])
            a, b = split.first[:-1], split.first[1:]
            out.append(pa.table({
                "doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "n_tokens": pa.array(b - a + 1), "n_known": pa.array(known[b] - known[a] + (ends > 0)), "train_tokens": pa.array(np.full(len(a), tokens)),
                "base_score": each[b] - each[a] + np.log10((ends + 1) / (tokens + vocabulary + 1)), "score": total,
            }).cast(result))
        return pa.concat_tables(out) if out else result.empty_table()

    result = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    documents = rows.select("block", "doc_id", "text", "held_out", "train")
    return documents.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(block, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")

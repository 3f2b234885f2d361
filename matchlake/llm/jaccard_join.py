"""Similarity join on sets of word n-grams through a token-group matrix, without missing a link.

Equal sets are one class from the start. Two sets that are similar enough share many of the tokens that come first in any
fixed order, and the rarest of those: with d(n) = n * (100 - percent) / 100 and k(n) = d(n) / 2 + 1, rounded down, the first
d + k tokens by hash (``low``) of two such sets have k of the smaller set in common at least, so some token is among each
one's rarest d(n) + k(n) - k(m) + 1 of them, m being the least size of a partner. How many classes hold a token is counted exactly:
blocks of classes send their distinct tokens to parts by value, and parts send back those that occur more than once. Tokens
of one class only can link nothing and go no further, which leaves few rows of most corpora.

Classes that are left are put in groups by the smallest class that shares a rare token, of bounded size, so near copies share groups. A group's union
of tokens is its row of the token-group matrix, with the members as places in it. Links within a group are found when its row
is made. Two groups meet if a rare token of members is in both: first every group with one other, the smallest that it can, so that large
families of near copies become one component; then all that hold different components still, each two in a task. There every
member of one group is a query: its overlap with the other's whole union bounds that with any member, and only if the bound
reaches percent of the query are that group's members counted, all at once and exactly. Texts of a family meet as groups, so
neither rows nor shuffled bytes are pairs of members.

Words are runs of bytes other than ASCII white space, A-Z in lower case; tokens are 64-bit hashes of runs of words. Edge
cases: a null text or one without words has an empty set and is its own component; fewer words than a run are one token;
repeated rows are one class; a null id never names a component unless all ids in it are null; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from matchlake.llm import words as w
from matchlake.llm.blocks import narrow_batches, staged
from matchlake.llm.minhash import components, representatives, same_text, shingle_sets

#: Bytes of first tokens in a block, and tokens in a part, that one task holds.
BLOCK, PART = 4 << 20, 2_000_000
#: Classes and tokens of a group.
GROUP, TOGETHER = 512, 300_000

_U = np.uint64


def missing(n, percent: int):
    """Tokens of a set of n that a similar set may lack."""
    return n * (100 - percent) // 100


def spare(n: int, percent: int) -> int:
    """First tokens by hash that a set of n shares at least with a similar set that isn't smaller."""
    return missing(n, percent) // 2 + 1


def described(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, row, n_shingles, class (digest of the set; null if empty) and low (its first tokens) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for values, first in shingle_sets(batch.column(2), size):
                sizes, classes, low = np.diff(first), [], []
                for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    classes.append(hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() if b > a else None)
                    low.append(values[a : min(b, a + missing(b - a, percent) + spare(b - a, percent))].tobytes())
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(at, len(sizes)), "row": batch.column(1).slice(at, len(sizes)), "n_shingles": pa.array(sizes, pa.int64()), "class": pa.array(classes, pa.binary()), "low": pa.array(low, pa.binary())})
                at += len(sizes)

    return rows.mapInArrow(run, "doc_id bigint, row binary, n_shingles bigint, class binary, low binary")


def _parts(tokens: np.ndarray, parts: int) -> np.ndarray:
    return (tokens >> _U(32)) * _U(parts) >> _U(32)


def _keys(part: np.ndarray, own: np.ndarray) -> np.ndarray:
    return part.astype(_U) << _U(32) | own.astype(_U)


def rare_tokens(classes: DataFrame, percent: int) -> DataFrame:
    """token, a (class), n: for each class the rarest of its first tokens, those that other classes have too.

    Within a part a token is told by its low 32 bits; should two meet, both count as more frequent, which changes an order
    and no result.
    """
    held = classes.agg(F.sum(F.length("low"))).first()[0] or 0
    blocks, parts = 1 + held // BLOCK, 1 + held // 8 // PART
    blocked = classes.select("class", "n", "low", F.pmod(F.xxhash64("class"), F.lit(blocks)).alias("block"))

    def ask(table: pa.Table) -> pa.Table:
        tokens, count = np.unique(np.frombuffer(b"".join(table.column("low").to_pylist()), _U), return_counts=True)
        cuts = np.searchsorted(_parts(tokens, parts), np.arange(parts + 1, dtype=_U)).tolist()
        own = [(p, tokens[a:b].astype(np.uint32).tobytes(), count[a:b].astype(np.uint32).tobytes()) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        return pa.table({"part": pa.array([x[0] for x in own], pa.int64()), "block": pa.array([table.column("block")[0].as_py()] * len(own), pa.int64()), "own": pa.array([x[1] for x in own], pa.binary()), "count": pa.array([x[2] for x in own], pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        each = [np.frombuffer(x, np.uint32) for x in table.column("own").to_pylist()]
        every, at = np.unique(np.concatenate(each), return_inverse=True)
        total = np.bincount(at, np.frombuffer(b"".join(table.column("count").to_pylist()), np.uint32)).astype(np.int64)
        more = total[at] > 1
        cut = np.cumsum([0, *map(len, each)])
        rows = [(at[a:b][more[a:b]]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        return pa.table({"block": table.column("block"), "part": table.column("part"), "own": pa.array([every[x].tobytes() for x in rows], pa.binary()), "total": pa.array([np.minimum(total[x], 2**32 - 1).astype(np.uint32).tobytes() for x in rows], pa.binary())})

    def choose(own: pa.Table, told: pa.Table) -> pa.Table:
        known = told.to_pylist()
        keys = np.concatenate([np.zeros(0, _U), *[_keys(np.full(len(x["own"]) // 4, x["part"]), np.frombuffer(x["own"], np.uint32)) for x in known]])
        total = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(x["total"], np.uint32).astype(np.int64) for x in known]])
        order = np.argsort(keys)
        keys, total = np.append(keys[order], ~_U(0)), np.append(total[order], 1)
        out, owner = [np.zeros(0, _U)], []
        names, sizes = own.column("class").to_pylist(), own.column("n").to_pylist()
        for i, (low, n) in enumerate(zip(own.column("low").to_pylist(), sizes, strict=True)):
            tokens = np.frombuffer(low, _U)
            key = _keys(_parts(tokens, parts), tokens.astype(np.uint32))
            at = np.searchsorted(keys, key)
            often = np.where(keys[at] == key, total[at], 1)
            least = -(-n * percent // 100)
            first = np.lexsort((tokens, often))[: missing(n, percent) + spare(n, percent) - spare(least, percent) + 1]
            some = tokens[first[often[first] > 1]]
            out.append(some)
            owner += [i] * len(some)
        return pa.table({"token": pa.array(np.concatenate(out).view(np.int64)), "a": pa.array([names[i] for i in owner], pa.binary()), "n": pa.array([sizes[i] for i in owner], pa.int64())})

    told = blocked.groupBy("block").applyInArrow(ask, "part bigint, block bigint, own binary, count binary").groupBy("part").applyInArrow(answer, "block bigint, part bigint, own binary, total binary")
    return blocked.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(choose, "token bigint, a binary, n bigint")


def grouped(classes: DataFrame, rare: DataFrame) -> DataFrame:
    """a, n, g: classes dealt to groups of GROUP classes and TOGETHER tokens, about. Classes go together by the smallest class (by
    hash) that any of their rare tokens is in, so a family of near copies is as few groups as its size asks for; too many are
    dealt by their smallest token, then one by one."""
    centre = rare.select("a", F.min(F.xxhash64("a")).over(W.partitionBy("token")).alias("key")).groupBy("a").agg(F.min("key").alias("key"))
    keyed = classes.select(F.col("class").alias("a"), "n", F.xxhash64(F.substring("low", 1, 8)).alias("first")).join(centre, "a")
    needed = lambda most: (F.greatest(F.expr(f"count(*) div {most * GROUP}"), F.expr(f"sum(n) div {most * TOGETHER}")) + 1).alias("groups")
    keyed = keyed.join(keyed.groupBy("key").agg(needed(1)), "key").withColumn("first", F.pmod("first", F.col("groups"))).drop("groups")
    size = keyed.groupBy("key", "first").agg(needed(2))
    return keyed.join(size, ["key", "first"]).select("a", "n", F.xxhash64("key", "first", F.pmod(F.xxhash64("a"), F.col("groups"))).alias("g"))


_ROW = "g bigint, tokens binary, names binary, sizes binary, places binary, links array<struct<a: binary, b: binary>>"


class Joined:
    """Names joined to components as links are found; ``links`` are those that joined two."""

    def __init__(self, names: list[bytes]):
        self.names, self.part, self.links = names, np.arange(len(names)), []

    def add(self, i: int, others: np.ndarray) -> None:
        for j in others.tolist():
            x, y = self.part[i], self.part[j]
            if x != y:
                self.part[self.part == x] = y
                self.links.append({"a": max(self.names[i], self.names[j]), "b": min(self.names[i], self.names[j])})


def matrix(members: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """A row for each group g: tokens (union of the members' sets), the members' names, sizes and places in the union, and
    links enough to join the members that are linked."""

    def row(table: pa.Table) -> pa.Table:
        names, each = table.column("a").to_pylist(), []
        for values, first in shingle_sets(table.column("text").combine_chunks(), size):
            each += [values[x:y] for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        union, at = np.unique(np.concatenate(each), return_inverse=True)
        sizes, joined = np.array([len(x) for x in each]), Joined(names)
        first = np.concatenate([[0], np.cumsum(sizes)])
        inside = np.zeros(len(union), bool)
        for i in range(1, len(each)):  # a member and those before it, at once
            mine = at[first[i] : first[i + 1]]
            inside[mine] = True
            shared = np.add.reduceat(inside[at[: first[i]]], first[:i], dtype=np.int64)
            inside[mine] = False
            joined.add(i, np.flatnonzero(100 * shared >= percent * (sizes[i] + sizes[:i] - shared)))
        own = (table.column("g")[0].as_py(), union.tobytes(), b"".join(names), sizes.astype(np.uint32).tobytes(), at.astype(np.uint32).tobytes())
        kind = pa.list_(pa.struct([("a", pa.binary()), ("b", pa.binary())]))
        columns = {k: pa.array([x], pa.int64() if k == "g" else pa.binary()) for k, x in zip(("g", "tokens", "names", "sizes", "places"), own, strict=True)}
        return pa.table(columns | {"links": pa.array([joined.links], kind)})

    own = members.select("a", "g").join(texts.withColumnRenamed("class", "a"), "a")
    return own.groupBy("g").applyInArrow(row, _ROW)


def compared(pairs: DataFrame, table: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of the groups x and y, enough to join all that are linked."""

    def split(names: bytes) -> list[bytes]:
        return [names[i : i + 16] for i in range(0, len(names), 16)]

    def open_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):  # two groups at a time
                asking, asked = ({k: np.frombuffer(x[f"{k}_{side}"], kind) for k, kind in (("tokens", _U), ("sizes", np.uint32), ("places", np.uint32))} for side in "xy")
                at = np.minimum(np.searchsorted(asked["tokens"], asking["tokens"]), len(asked["tokens"]) - 1)
                at = np.where(asked["tokens"][at] == asking["tokens"], at, -1)  # where the one union's tokens are in the other
                n, m = asking["sizes"].astype(np.int64), asked["sizes"].astype(np.int64)
                first, begin = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(m)])[:-1]
                inside = np.zeros(len(asked["tokens"]), bool)
                hits = at[asking["places"]]
                bound = np.add.reduceat(hits >= 0, first[:-1], dtype=np.int64)
                fits = (100 * bound >= percent * n) & (100 * m.max() >= percent * n) & (100 * n >= percent * m.min())
                names = split(x["names_x"]), split(x["names_y"])
                joined = Joined([*names[0], *names[1]])
                for i in np.flatnonzero(fits).tolist():
                    own = hits[first[i] : first[i + 1]]
                    own = own[own >= 0]
                    inside[own] = True
                    shared = np.add.reduceat(inside[asked["places"]], begin, dtype=np.int64)
                    inside[own] = False
                    joined.add(i, len(n) + np.flatnonzero(100 * shared >= percent * (n[i] + m - shared)))
                found += joined.links
            yield pa.RecordBatch.from_pydict({k: pa.array([x[k] for x in found], pa.binary()) for k in "ab"})

    side = lambda x: table.select(F.col("g").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("tokens", "names", "sizes", "places")])
    return pairs.join(side("x"), "x").join(side("y"), "y").drop("x", "y").mapInArrow(open_groups, "a binary, b binary")


def held(rare: DataFrame, members: DataFrame, links: DataFrame) -> DataFrame:
    """token, g, low and high (sizes), least and most (roots): of the members of each group with a token."""
    roots = members.select("a", "g").join(components(links), "a", "left").withColumn("root", F.coalesce("root", "a"))
    return rare.join(roots, "a").groupBy("token", "g").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("root").alias("least"), F.max("root").alias("most"))


def meeting(tokens: DataFrame, others: DataFrame, percent: int) -> DataFrame:
    """x, y: groups with a token in common, of fitting sizes and not yet one component as far as they have the token."""
    side = lambda df, x: df.select("token", *[F.col(c).alias(x if c == "g" else f"{c}_{x}") for c in ("g", "low", "high", "least", "most")])
    apart = (F.col("least_x") != F.col("most_x")) | (F.col("least_y") != F.col("most_y")) | (F.col("least_x") != F.col("least_y"))
    fits = (100 * F.col("high_x") >= percent * F.col("low_y")) & (100 * F.col("high_y") >= percent * F.col("low_x"))
    return side(tokens, "x").join(side(others, "y"), "token").filter((F.col("x") < F.col("y")) & apart & fits).select("x", "y").distinct()


def jaccard_links(classes: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between classes, enough to join all that are linked."""
    rare = staged(rare_tokens(classes, percent))
    members = staged(grouped(classes, rare))
    table = staged(matrix(members, representatives(rows, classes, rare), size, percent))
    links = table.select(F.explode("links").alias("x")).select("x.a", "x.b")
    tokens = staged(held(rare, members, links))
    smallest = tokens.groupBy("token").agg(F.min("g").alias("g"))
    star = meeting(tokens.join(smallest, ["token", "g"], "left_semi"), tokens, percent).groupBy("y").agg(F.min("x").alias("x")).select("x", "y")
    star = staged(star)
    links = staged(links.unionByName(compared(star, table, percent)))
    tokens = staged(held(rare, members, links))
    mixed = tokens.groupBy("token").agg(F.min("least").alias("l"), F.max("most").alias("m")).filter("l <> m").select("token")
    tokens = tokens.join(mixed, "token", "left_semi")
    rest = staged(meeting(tokens, tokens, percent).join(star, ["x", "y"], "left_anti"))
    return staged(links.unionByName(compared(rest, table, percent)))


def jaccard_components(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of every row."""
    narrow_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), same_text().alias("row"), F.col("text").cast("binary").alias("text"))
    each = staged(described(rows, size, percent))
    some = each.filter(F.col("n_shingles") > 0)
    classes = staged(some.groupBy("class").agg(F.min("doc_id").alias("first"), F.min("row").alias("row"), F.max("n_shingles").alias("n"), F.max("low").alias("low")))
    roots = components(jaccard_links(classes, rows, size, percent)).withColumnRenamed("a", "class")
    named = classes.join(roots, "class", "left").select("class", "first", F.coalesce("root", "class").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    found = some.select("doc_id", "n_shingles", "class").join(named.join(smallest, "root").select("class", "component_id"), "class")
    return found.select("doc_id", "n_shingles", "component_id").unionByName(each.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))

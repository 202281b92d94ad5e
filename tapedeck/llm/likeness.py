"""Near-duplicates by SimHash and the grid join of ``simhash``, decided by exact Jaccard likeness
of word shingles and completed by MinHash where fingerprints can't reach.

Rows with equal shingle sets become one node. Equal fingerprints, and those that the grid join
of the embedded fingerprints links (at most four differing bits), propose the first pairs;
the sets decide on each in whole numbers, and what is alike becomes one component. At a
likeness of 0.8 some 10 of 64 bits differ, which no grid finds. So between different components
MinHash goes on: each set has 50 bands of five minima; sets that share a band meet in a cell. A
pair at the limit of 0.8 misses every band with a chance of (1 - 0.8 ** 5) ** 50 = 2e-9,
likelier pairs with less. As in ``simhash``, the members of a cell are first compared with
its smallest member, then, while that finds many links, with another one, which contracts
groups of copies without listing their pairs. The members of cells that still hold several
components are then joined by their rarest shingles where bitmaps of their sets differ
little enough, so variants of one text that are not alike are not listed pair by pair.

Defined results: null and empty texts have the empty set and are alike; a text of fewer
words than a shingle has one shingle, all its words; a set of fewer than four shingles is
like its equals alone (the next likeness, 3 of 4, is below the limit); rows equal in id and
text are one; an empty table gives an empty one; a text of any length is hashed whole, in
blocks; columns of any other names stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import simhash
from .common import chunks, small, stored, utf8, without
from .components import components

SEED = 42
#: Bits of the bitmap of a set: the parity of the number of its hashes of each remainder.
MARKS = 512
BANDS, ROWS = 50, 5
_random = np.random.default_rng(SEED)
_TIMES = _random.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
_PLUS = _random.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_MIX = _random.integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | np.uint64(1)


def hashes(text: bytes, size: int = 5) -> np.ndarray:
    """XXH64 hashes of the shingles in their order (words: runs of non-blank bytes, A-Z lower-cased)."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(b" ".join(words[i : i + size]), SEED) for i in range(max(1, len(words) - size + 1))], np.uint64)


def shingles(text: bytes, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes."""
    return np.unique(hashes(text, size))


def marks(h: np.ndarray) -> np.ndarray:
    """The bitmap of a set. Two bitmaps differ in no more bits than the sets in hashes."""
    odd = np.bincount((h % np.uint64(MARKS)).astype(np.int64), minlength=MARKS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def bands(h: np.ndarray) -> np.ndarray:
    """The cells of a set, one for each band."""
    if len(h) < 4:
        return np.empty(0, np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 1024):
        np.minimum(least, (_TIMES[:, None] * h[None, i : i + 1024] + _PLUS[:, None]).min(1), out=least)
    return (least.reshape(BANDS, ROWS) * _MIX).sum(1, dtype=np.uint64)


def _longs(parts: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(flat))


def _set_of(text: Column, shingle: int, cells: bool) -> Column:
    """key (of the set), its fingerprint, and either the cells or the set itself with its bitmap."""

    @arrow_udf("struct<key:binary,fp:bigint,h:array<bigint>,marks:array<bigint>>")
    def of(texts: pa.Array) -> pa.Array:
        keys, prints, out, maps = [], [], [], []
        for a, b in chunks(texts):
            for t in utf8(texts[a:b]):
                every = hashes(t, shingle)
                h = np.unique(every)
                keys.append(xxhash.xxh3_128_digest(h.tobytes()))
                prints.append(simhash.of_hashes(every) if cells else 0)
                out.append(bands(h) if cells else h)
                maps.append(np.empty(0, np.uint64) if cells else marks(h))
        fp = pa.array(np.array(prints, np.uint64).view(np.int64))
        return pa.StructArray.from_arrays([pa.array(keys, pa.binary()), fp, _longs(out), _longs(maps)], ["key", "fp", "h", "marks"])

    return of.asNondeterministic()(text)


def _held(ids: DataFrame, docs: DataFrame, sets: DataFrame, shingle: int) -> DataFrame:
    """(id, h, marks): the sets of these ids, made again from one text each. Texts stay where
    they are while the ids are few enough for a broadcast; then only the sets are shuffled."""
    wanted = stored(ids.distinct().join(sets, "id").select("id", F.col("least.doc_id").alias("doc_id"), F.col("least.t").alias("t")), "wanted")
    one = docs.join(small(wanted), ["t", "doc_id"])
    found = one.select("id", _set_of(F.col("text"), shingle, False).alias("s")).select("id", F.col("s.h").alias("h"), F.col("s.marks").alias("marks"))
    return stored(found.groupBy("id").agg(F.first("h").alias("h"), F.first("marks").alias("marks")), "sets")


def _alike(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of set ids whose likeness is 0.8 or more."""
    x, y = held.select(F.col("id").alias("a"), F.col("h").alias("x")), held.select(F.col("id").alias("b"), F.col("h").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(x, "a").join(y, "b").where(9 * both >= 4 * (F.size("x") + F.size("y"))).select("a", "b")


def _across(held: DataFrame, placed: DataFrame) -> DataFrame:
    """Pairs of different components that can be alike, none left out, by prefixes.

    With each set's shingles from the rarest to the commonest, sets of likeness 0.8 share one
    of their first fifths (and one more), and from the first shared on enough must remain.
    They differ in a ninth of their shingles together at most, and so do their bitmaps.
    """
    tokens = held.select("id", F.explode("h").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("k"))
    ordered = tokens.join(often, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("k", "token"))).alias("o"))
    ordered = ordered.withColumn("n", F.size("o")).join(placed.select("id", "root").distinct(), "id").join(held.select("id", "marks"), "id")
    prefix = F.slice("o", F.lit(1), F.expr("n - (4 * n + 4) div 5 + 1").cast("int"))
    first = stored(ordered.select("id", "root", "n", "marks", F.posexplode(prefix).alias("i", "s")).where("s.k > 1").select("id", "root", "n", "i", "marks", F.col("s.token").alias("token")), "prefixes")
    x, y = (first.select("token", *[F.col(c).alias(c + e) for c in ("id", "root", "n", "i", "marks")]) for e in "xy")
    enough = 9 * F.least(F.col("nx") - F.col("ix"), F.col("ny") - F.col("iy")) >= 4 * (F.col("nx") + F.col("ny"))
    differ = sum(F.bit_count(F.get("marksx", F.lit(i)).bitwiseXOR(F.get("marksy", F.lit(i)))) for i in range(MARKS // 64))
    enough &= 9 * differ <= F.col("nx") + F.col("ny")
    return x.join(y, (x["token"] == y["token"]) & (F.col("rootx") < F.col("rooty")) & enough).select(F.col("idx").alias("a"), F.col("idy").alias("b")).distinct()


def _by_fingerprint(docs: DataFrame, sets: DataFrame, shingle: int) -> DataFrame:
    """(a, b): the links of ``simhash`` between sets, and of equal fingerprints, that are alike."""
    prints = stored(sets.groupBy("fp").agg(F.min("id").alias("id")), "prints")
    a, b = (prints.select(F.col("fp").alias(c), F.col("id").alias(f"id_{c}")) for c in "ab")
    near = simhash.links(prints, "fp").join(a, "a").join(b, "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    same = sets.select("fp", F.col("id").alias("b")).join(a.withColumnsRenamed({"a": "fp", "id_a": "a"}), "fp").where("a <> b").select("a", "b")
    pairs = stored(near.union(same).distinct(), "pairs")
    return stored(_alike(pairs, _held(pairs.select(F.explode(F.array("a", "b")).alias("id")), docs, sets, shingle)), "links")


def _rooted(rows: DataFrame, roots: DataFrame, *keep: str) -> DataFrame:
    """``rows`` (id, keep...) with the root of each id."""
    r = rows.select("id", *keep)
    return r.join(roots, r["id"] == roots["node"], "left").select("id", *keep, F.coalesce("root", "id").alias("root"))


def _merged(roots: DataFrame, more: DataFrame) -> DataFrame:
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more.select("a", "b")), "a", "b")


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, cell, root) in the cells of several components."""
    placed = _rooted(members, roots, "cell")
    mixed = placed.groupBy("cell").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("cell")
    return stored(placed.join(mixed, "cell"), "mixed")


def groups(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """Distinct (doc_id, t) of the rows that don't stay: all of a group but its smallest;
    docs: (doc_id, text, t)."""
    rows = docs.select("doc_id", "t", _set_of(F.col("text"), shingle, True).alias("s"))
    one = stored(rows.select(F.col("s.key").alias("key"), F.struct("doc_id", "t").alias("least"), F.col("s.fp").alias("fp"), F.col("s.h").alias("cells")), "rows")
    least = one.groupBy("key").agg(F.min("least").alias("least"), F.min("fp").alias("fp"), F.first("cells").alias("cells"))
    sets = stored(least.withColumn("id", F.monotonically_increasing_id()), "sets")
    roots = components(_by_fingerprint(docs, sets, shingle), "a", "b")
    # Between the components: bands.
    cells = _rooted(sets, roots, "cells").select("id", "root", F.explode("cells").alias("cell"))
    shared = cells.groupBy("cell").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("k"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    shared = stored(shared.where("k > 1 and lo < hi").drop("lo", "hi"), "cells")
    two = shared.where("k = 2").select(F.col("first").alias("a"), F.col("last").alias("b"))
    members = stored(cells.join(shared.where("k > 2").select("cell", "first"), "cell"), "members")
    star = members.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    pairs = stored(two.union(star).distinct(), "pairs")
    near = stored(_alike(pairs, _held(pairs.select(F.explode(F.array("a", "b")).alias("id")), docs, sets, shingle)), "links")
    roots = _merged(roots, near)
    # What is left: cells whose members are of several components. Each gets another centre.
    placed = _mixed(members, roots)
    held, found, turn = _held(placed.select("id"), docs, sets, shingle), None, 0
    while found is None or 8 * found > placed.count():
        turn += 1
        centre = F.min(F.struct(F.xxhash64(F.lit(turn), "cell", "id").alias("by"), "id", "root")).alias("c")
        star = placed.join(placed.groupBy("cell").agg(centre), "cell").where("root <> c.root")
        star = stored(star.select(F.least("id", "c.id").alias("a"), F.greatest("id", "c.id").alias("b")).distinct(), "pairs")
        near = stored(_alike(star, held), "links")
        found = near.count()
        if found:
            roots = _merged(roots, near)
            placed = _mixed(placed, roots)
    placed = placed.select("id", "root").distinct()
    more = _alike(stored(_across(held.join(placed.select("id"), "id"), placed), "across"), held)
    roots = _merged(roots, more)
    placed = sets.join(roots, sets["id"] == roots["node"], "left").select("key", "least", F.coalesce("root", "id").alias("root"))
    first = placed.groupBy("root").agg(F.min("least").alias("first"))
    of_key = placed.join(first, "root").select("key", "first")
    return stored(one.join(of_key, "key").where("least <> first").select("least.doc_id", "least.t").distinct(), "dropped")


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """One row of each group of near-duplicates, columns as given: that of its smallest id.

    Of rows with that id and the same text one stays; rows that share an id but no likeness
    stay all. Rows without an id stay: nothing names them.
    """
    named = docs.where(F.col(doc_id).isNotNull())
    of_text = F.xxhash64(F.col(text))  # tells apart rows that share an id
    dropped = groups(named.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), of_text.alias("t")), shingle)
    return without(named, dropped, {"doc_id": F.col(doc_id), "t": of_text}).unionByName(docs.where(F.col(doc_id).isNull()))

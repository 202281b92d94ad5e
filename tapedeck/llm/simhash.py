"""SimHash near-duplicates by a segment-popcount embedding and a grid range-join.

A 64-bit fingerprint is embedded as the bit counts of its 32 two-bit segments. The
Manhattan distance of two embeddings never exceeds the Hamming distance of the
fingerprints. The counts are kept in unary code (0: 00, 1: 01, 2: 11), so a Manhattan
distance is the bit count of an XOR.

Grid: the segments form blocks. Four differing bits touch at most four blocks, so two linked
fingerprints have equal counts, and equal bits, in all segments of all other blocks. Each
choice of blocks to keep gives one grid; a fingerprint lies in one cell of each. The number of
blocks is chosen from the number of distinct fingerprints: few, coarse grids for small tables,
more and finer ones for large ones. A cell of counts is cut by the kept bits, which linked
fingerprints share as well, so few meet in it by chance. The bits fix the counts, so they alone
are hashed.
Only cells that hold several distinct fingerprints go on. In these the members are first
compared with the cell's smallest member, which contracts groups of copies without listing
their pairs. Where a cell still holds a group of one component and others, rounds follow while
they find many links: the members are compared with a few other ones of the cell. Then only
pairs of different components within a cell are compared, so no link between components is
lost and no cell of one component is expanded. Cells with more than ``CROWD`` such pairs a member are cut again,
by the bits of finer grids.

Defined results: null and empty texts have fingerprint zero and link like any other;
a null doc_id is never a component's id unless all of its ids are null; repeated rows are each
reported; a text of any length is hashed whole; an empty table gives an empty one; columns of
any other names are not read (``keep_one``: stay as they are).
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import chunks, stored, utf8, without
from .components import components

SEED = 42
#: Distinct fingerprints from which a kept bit is taken to tell as much apart as a random one.
DEEP = 1 << 20
#: Pairs of different components for each member of a cell, from which the cell is cut again
#: (into as many pieces for each member).
CROWD = 70
#: Members of one component in a cell of several, from which rounds of ``CENTRES`` centres follow.
GROUP, CENTRES = 8, 4
_LOW = 0x5555555555555555


def simhash(text: bytes, shingle: int = 4) -> int:
    """Unsigned fingerprint of one text (words: runs of non-blank bytes, A-Z lower-cased)."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        h = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        stop = np.cumsum(size + 1) - 1
        start = stop - size
        digest = xxhash.xxh64_intdigest
        h = [digest(joined[a:b], SEED) for a, b in zip(start[: -shingle + 1 or None].tolist(), stop[shingle - 1 :].tolist())]
    return of_hashes(np.array(h, np.uint64))


def of_hashes(h: np.ndarray) -> int:
    """The fingerprint of shingles by their hashes, repeats included; of none: zero."""
    bits = np.unpackbits(h.astype("<u8", copy=False).view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little")
    return int.from_bytes(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(h), bitorder="little").tobytes(), "little")


def fingerprint(text: Column, shingle: int = 4) -> Column:
    """The fingerprint as a signed long."""

    @arrow_udf("bigint")
    def of(texts: pa.Array) -> pa.Array:
        out = [simhash(t, shingle) for a, b in chunks(texts) for t in utf8(texts[a:b])]
        return pa.array(np.array(out, "<u8").view("<i8"), pa.int64())

    return of.asNondeterministic()(text)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def embedding(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, each in unary code in its own two bits."""
    shifted, low = F.shiftrightunsigned(fp, 1), F.lit(_LOW)
    some = fp.bitwiseOR(shifted).bitwiseAND(low)
    both = fp.bitwiseAND(shifted).bitwiseAND(low)
    return some.bitwiseOR(F.shiftleft(both, 1))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def grids(bits: int = 4, blocks: int = 8, within: int = -1) -> list[int]:
    """Masks of the choices of ``blocks - bits`` of the blocks that the 32 segments form, or
    those that lie in the mask ``within``."""
    segments = [i for i in range(32) if within >> (2 * i) & 3 == 3]
    cut = [round(i * len(segments) / blocks) for i in range(blocks + 1)]
    block = [sum(3 << (2 * i) for i in segments[a:b]) for a, b in zip(cut, cut[1:])]
    return [_signed(sum(block[i] for i in kept)) for kept in combinations(range(blocks), blocks - bits)]


def blocks_for(n: int, bits: int = 4) -> int:
    """The blocks with the least work for n fingerprints: cells to deal out and pairs by chance."""
    kept = 1.0 if n >= DEEP else 0.7  # bits of entropy that a kept bit has

    def work(blocks: int) -> float:
        return math.comb(blocks, bits) * (n + n * n / 2 ** (64 * kept * (blocks - bits) / blocks) / 16)

    return min(range(bits + 1, 2 * bits + 5), key=work)


def _cells(p: DataFrame, masks: list[int], *keep: str) -> DataFrame:
    """(cell, fp, keep...) for each mask; a cell is a hash (of equal hashes, two cells are one
    larger one), and inside the cell that a row may be in already."""
    within = [F.col("cell")] if "cell" in p.columns else []
    each = [F.xxhash64(F.lit(i), *within, F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)]
    return p.select("fp", *keep, F.explode(F.array(*each)).alias("cell"))


def _placed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(cell, fp, root) of the members; roots: (node, root) of those that have links."""
    m = members.select("cell", "fp")
    return m.join(roots, m["fp"] == roots["node"], "left").select("cell", "fp", F.coalesce("root", "fp").alias("root"))


def _mixed(members: DataFrame, roots: DataFrame, crowd: float) -> DataFrame:
    """(cell, fp, root, crowded, grouped) in the cells of several components; grouped: one of
    these has many members there."""
    placed = _placed(members, roots)
    of = placed.groupBy("cell", "root").agg(F.count("*").alias("k"))
    of = of.groupBy("cell").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("own"), F.count("*").alias("roots"), F.max("k").alias("most"))
    pairs = (F.col("n") * F.col("n") - F.col("own")) / 2  # of different components
    mixed = of.where("roots > 1").select("cell", (pairs > crowd * F.col("n")).alias("crowded"), (F.col("most") >= GROUP).alias("grouped"))
    return stored(placed.join(mixed, "cell"), "mixed")


def links(prints: DataFrame, fp: str, bits: int = 4, blocks: int | None = None, crowd: int = CROWD) -> DataFrame:
    """(a, b): links that connect what is connected; ``prints`` holds distinct fingerprints."""
    n = prints.count()
    masks = grids(bits, blocks or blocks_for(n, bits))
    spread = max(prints.sparkSession.sparkContext.defaultParallelism, math.ceil(n * len(masks) / 2_000_000))
    p = prints.select(F.col(fp).alias("fp")).repartition(spread, "fp")
    cells = stored(_cells(p, masks), "cells")
    shared = cells.groupBy("cell").agg(F.min("fp").alias("first"), F.max("fp").alias("last"), F.count("*").alias("n")).where("n > 1")
    shared = stored(shared, "shared")
    close = lambda a, b: distance(embedding(F.col(a)), embedding(F.col(b))) <= bits
    exact = lambda a, b: distance(F.col(a), F.col(b)) <= bits
    two = shared.where(close("first", "last") & exact("first", "last")).select(F.col("first").alias("a"), F.col("last").alias("b"))
    members = stored(cells.join(shared.where("n > 2").select("cell", "first"), "cell"), "members")
    star = members.where("fp <> first").where(close("fp", "first") & exact("fp", "first")).select(F.col("fp").alias("a"), F.col("first").alias("b"))
    near = stored(two.union(star).distinct(), "links")
    roots = components(near, "a", "b")
    # What is left: cells whose members are of several components.
    placed = _mixed(members, roots, crowd)
    grouped, turns, found, rounds = placed.where("grouped"), np.random.default_rng(SEED), None, 0
    while found is None or 8 * found > grouped.count():
        turn = [F.lit(int(t)) for t in turns.integers(-(1 << 63), 1 << 63, CENTRES)]
        least = [F.min(F.struct(F.col("fp").bitwiseXOR(t).alias("by"), "root")).alias(f"c{i}") for i, t in enumerate(turn)]
        centres = F.array(*[F.struct(F.col(f"c{i}.by").bitwiseXOR(t).alias("fp"), F.col(f"c{i}.root")) for i, t in enumerate(turn)])
        of = grouped.groupBy("cell").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), *least).where("lo < hi").select("cell", centres.alias("centres"))
        other = F.filter("centres", lambda c: (c["root"] != F.col("root")) & (distance(c["fp"], F.col("fp")) <= bits))
        star = stored(grouped.join(of, "cell").select(F.col("fp").alias("a"), F.explode(other).alias("c")).select("a", F.col("c.fp").alias("b")).distinct(), "links")
        found = star.count()
        if found:
            rounds += 1
            near = near.union(star)
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(star), "a", "b")
            grouped = stored(_placed(grouped, roots), "grouped")
    if rounds:
        placed = _mixed(placed, roots, crowd)
    # In a crowded cell the grid is laid once more, finer.
    crowded = placed.where("crowded")
    again = _cells(crowded, grids(bits, 2 * bits), "root")
    some = again.groupBy("cell").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("cell")
    placed = stored(placed.where("not crowded").select("cell", "fp", "root").unionByName(again.join(some, "cell")), "pieces")
    x = placed.select("cell", F.col("fp").alias("a"), F.col("root").alias("ra"))
    y = placed.select("cell", F.col("fp").alias("b"), F.col("root").alias("rb"))
    across = x.join(y, (x["cell"] == y["cell"]) & (F.col("ra") < F.col("rb")) & close("a", "b") & exact("a", "b"))
    return near.union(across.select("a", "b"))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, bits: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``."""
    rows = stored(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), shingle).alias("fp")), "fingerprints")
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    edges = links(prints, "fp", bits)
    roots = components(edges, "a", "b")
    grouped = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = grouped.join(smallest, "root").select("fp", "component_id")
    return rows.join(of_print, "fp").select("doc_id", "fp", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def report(docs: DataFrame, **options) -> DataFrame:
    r = near_duplicates(docs, **options)
    return r.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each group of near-duplicates, columns as given: that of its smallest id.

    Of rows with that id and the same text one stays; rows that share an id but are in no
    group stay all. Rows without an id stay: nothing names them.
    """
    named = docs.where(F.col(doc_id).isNotNull())
    of_text = F.xxhash64(F.col(text))
    rows = stored(named.select(F.struct(F.col(doc_id).alias("doc_id"), of_text.alias("t")).alias("row"), fingerprint(F.col(text), options.get("shingle", 4)).alias("fp")), "fingerprints")
    least = stored(rows.groupBy("fp").agg(F.min("row").alias("least")), "prints")
    roots = components(links(least, "fp", options.get("bits", 4)), "a", "b")
    placed = least.join(roots, least["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    first = placed.groupBy("root").agg(F.min("least").alias("first"))
    stays = placed.join(first, "root").select("fp", "first")
    dropped = stored(rows.join(stays, "fp").where("row <> first").select("row.doc_id", "row.t").distinct(), "dropped")
    return without(named, dropped, {"doc_id": F.col(doc_id), "t": of_text}).unionByName(docs.where(F.col(doc_id).isNull()))

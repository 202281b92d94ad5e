"""Shared helpers: reading, shared-folder tables, bounds and small Column idioms."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes that a driver-built structure may hold before it is broadcast.
BROADCAST_LIMIT = 64 << 20
#: Most rows, of a few longs each, of a table that is broadcast for a join.
BROADCAST_ROWS = 2_000_000
#: Bytes of text that a vectorised kernel works on at once.
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session, as in tests, may name none: its one machine then gets one. On a
    cluster that is an error, since executors would write to their own disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tapedeck-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: cuts the lineage, so a
    lost executor costs a re-read and never a recomputation of what came before."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tapedeck/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a stored table of a few longs a row) marked for broadcast if it has no more than
    ``rows`` rows, else as it is: then the join shuffles both sides."""
    return F.broadcast(df) if df.count() <= rows else df


def without(docs: DataFrame, dropped: DataFrame, keys: dict[str, Column], rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` less the rows whose ``keys`` (named as in ``dropped``) are in it; of several rows
    of the same keys one stays. Texts are moved only for keys that occur more than once."""
    names = fresh(docs, *keys)
    rename = dict(zip(keys, names))
    keyed = docs.withColumns(dict(zip(names, keys.values())))
    gone = dropped.select(*[F.col(k).alias(rename[k]) for k in keys])
    left = keyed.join(small(gone, rows), names, "left_anti")
    often = stored(left.groupBy(*names).agg(F.count("*").alias("times")).where("times > 1").drop("times"), "often")
    if often.isEmpty():
        return left.select(*docs.columns)
    repeated = small(often, rows)
    once = left.join(repeated, names, "left_semi").dropDuplicates(names)
    return left.join(repeated, names, "left_anti").unionByName(once).select(*docs.columns)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that clash with no column of ``df`` (case-insensitive)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, even where body uses it in lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def doc_crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as ''."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % modulus


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each (a longer text is alone in its range)."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, n in enumerate(size.tolist()):
        if held and held + n > limit:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(texts):
        yield begin, len(texts)


def utf8(texts: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    import pyarrow.compute as pc

    kind = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
    return pc.fill_null(texts.cast(kind), b"").to_pylist()


def blocks(rows: Iterable, size: Callable, limit: int = BROADCAST_LIMIT) -> Iterator[list]:
    """Lists of rows of at most ``limit`` bytes in all (one larger row is alone)."""
    held, total = [], 0
    for row in rows:
        n = size(row)
        if held and total + n > limit:
            yield held
            held, total = [], 0
        held.append(row)
        total += n
    yield held


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[i] .. starts[i]+counts[i]-1`` for all i, one after another."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(before - starts, counts)

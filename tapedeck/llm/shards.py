"""Proportional stratified interleaving into shards (law ``rows``).

Rows of each source are ranked in a seeded pseudo-random order (MD5 of seed and id); the
rank as a fraction of the source's size gives every row a place in [0, 1); the rows sorted
by place are cut into shards whose counts differ by one at most. So each stretch of the
order, and each shard, holds every source in proportion, to within a row or two.

Both ranks are computed from counts by (source, bucket) and by place bucket, and the rows
are only ever ordered within a bucket, of about ``BUCKET`` rows whatever the table's size: no
source, however hot, is sorted by one task. Texts are not shuffled, only ids, sizes and
digests.

Defined results: a null source is a source of its own; rows that are equal in every column
share the places that they have between them; fewer rows than shards leave shards empty; an
empty table gives an empty one; a text of any length counts by its bytes alone; the rows' own
columns stay, and added ones take names that clash with none of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stored

SEED = 17
#: Rows that a bucket of the order holds on average, and the fewest hex digits of a bucket.
BUCKET, DIGITS = 50_000, 2


def _ranked(df: DataFrame, keys: list[str], order: list, rank: str, of: str) -> DataFrame:
    """``df`` with the 0-based rank of each row in the order (keys[-1], *order) within
    keys[:-1], and the number of rows there.

    keys[-1] is a coarse bucket of the order; its counts are summed up over the buckets.
    """
    n, before, own, *copies = fresh(df, "n", "before", "own", *[f"{k}_k" for k in keys])
    counts = df.groupBy(*keys).agg(F.count("*").alias(n))
    sofar = Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys[:-1])
    counts = counts.select(*[F.col(k).alias(c) for k, c in zip(keys, copies)], F.coalesce(F.sum(n).over(sofar), F.lit(0)).alias(before), F.sum(n).over(whole).alias(of))
    on = F.lit(True)
    for k, c in zip(keys, copies):
        on = on & df[k].eqNullSafe(F.col(c))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn(own, place).join(counts, on).withColumn(rank, F.col(before) + F.col(own)).drop(own, before, *copies)


def seeded(key: Column, seed: int = SEED) -> Column:
    """32 lowercase hex digits: the seeded order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))


def interleave(rows: DataFrame, *, doc_id: str, source: str, tie: list[str], shards: int = 8, seed: int = SEED, bucket_rows: int = BUCKET) -> tuple[DataFrame, str, str]:
    """``rows`` with a shard and a slot (gapless from 0 in each shard), and the two names."""
    digits, n = DIGITS, rows.count()
    while n > bucket_rows * 16**digits:
        digits += 1
    order, bucket, stratum, rank, of, place, every, stretch, position, total, shard, slot = fresh(rows, "order", "bucket", "stratum", "rank", "rank_of", "place", "every", "stretch", "position", "total", "shard", "slot")
    one = rows.withColumn(order, seeded(F.col(doc_id), seed)).withColumn(bucket, F.substring(order, 1, digits)).withColumn(stratum, F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")))
    one = _ranked(one, [stratum, bucket], [order, doc_id, *tie], rank, of).drop(bucket)
    one = stored(one.withColumn(place, (2 * F.col(rank) + 1) / (2 * F.col(of))), "strata")
    two = one.withColumn(every, F.lit(0)).withColumn(stretch, F.floor(F.col(place) * 16**digits))
    two = _ranked(two, [every, stretch], [place, stratum, rank], position, total)
    two = two.withColumn(shard, F.expr(f"`{position}` * {shards} div `{total}`"))
    two = two.withColumn(slot, F.col(position) - F.expr(f"(`{shard}` * `{total}` + {shards - 1}) div {shards}"))
    return two.select(*rows.columns, shard, slot), shard, slot


def report(docs: DataFrame, *, shards: int = 8, seed: int = SEED) -> DataFrame:
    t = F.col("text")
    rows = docs.select("doc_id", "source", (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("text_crc32"))
    out, shard, slot = interleave(rows, doc_id="doc_id", source="source", tie=["text_crc32", "size"], shards=shards, seed=seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col(shard).cast("int").alias("shard"), F.col(slot).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "source")


def sql(shards: int = 8, seed: int = SEED) -> str:
    return f"""
    WITH RECURSIVE steps AS (
      SELECT range AS i, cast(range AS bigint) AS t, 0 AS k FROM range(256)
      UNION ALL SELECT i, CASE WHEN t & 1 = 1 THEN xor(t >> 1, 3988292384) ELSE t >> 1 END, k + 1 FROM steps WHERE k < 8),
    tab AS (SELECT list(t ORDER BY i) AS tab FROM steps WHERE k = 8),
    r AS (
      SELECT doc_id, source, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: cast('0x' || h AS bigint)),
               lambda c, b: xor(c >> 8, list_extract(tab, cast(xor(c & 255, b) + 1 AS int))), 4294967295::bigint), 4294967295) AS text_crc32, coalesce(strlen(text), 0) + 1 AS size, md5('{seed}:' || coalesce(cast(doc_id AS varchar), '')) AS shuffled FROM documents, tab),
    a AS (
      SELECT *, row_number() OVER (PARTITION BY source ORDER BY shuffled, doc_id) - 1 AS rank, count(*) OVER (PARTITION BY source) AS rank_of FROM r),
    b AS (
      SELECT *, row_number() OVER (ORDER BY (2 * rank + 1) / cast(2 * rank_of AS double), source NULLS FIRST, rank) - 1 AS position, count(*) OVER () AS n FROM a),
    c AS (SELECT *, position * {shards} // n AS shard FROM b)
    SELECT doc_id, cast(size AS bigint) AS size, text_crc32, cast(shard AS int) AS shard,
           cast(position - (shard * n + {shards - 1}) // {shards} AS bigint) AS slot, 'rows' AS law, source, cast(NULL AS int) AS grown_shard
    FROM c"""

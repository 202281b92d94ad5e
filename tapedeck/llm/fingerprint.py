"""Bottom-k sketches of word-shingle hashes, in DataFrame functions alone.

A sketch is the sorted array of the k smallest 32-bit hashes of a text's five-word
shingles (hashes are XXH64, upper half). Sketches of parts merge by union; resemblance,
containment and the number of distinct shingles are estimated from sketches alone.

Defined results: a null text counts as empty; a text of no words has an empty sketch; one
of fewer than five words has one shingle, the whole; two empty sketches resemble fully; rows of
one id follow each other by a hash of what else they hold, rows without an id come last; a text
of any length is hashed whole; an empty table gives an empty one; columns of any other names
are not read (``with_next``: stay as they are, the added one takes a name that is free).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, let, text_of

K = 128
SHINGLE = 5
_BLANKS = "[ \\t\\n\\x0B\\f\\r]+"


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """array<bigint>: the k smallest distinct shingle hashes (0 to 2^32-1), ascending."""
    words = F.filter(F.split(text, _BLANKS), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    upper = lambda h: F.shiftrightunsigned(h, 32)

    def shingles(h: Column) -> Column:
        last = F.size(h) - shingle
        whole = F.when(F.size(h) > 0, F.array(upper(F.xxhash64(h)))).otherwise(F.array().cast("array<bigint>"))
        each = F.transform(F.sequence(F.lit(0), last), lambda i: upper(F.xxhash64(*[F.get(h, i + j) for j in range(shingle)])))
        return F.when(last < 0, whole).otherwise(each)

    return F.slice(F.sort_array(F.array_distinct(let(hashed, shingles))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together (shingles across the cut are in neither)."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_groups(df: DataFrame, key: str, column: str, k: int = K) -> DataFrame:
    """The merged sketch of each key's rows: k smallest hashes of all, without gathering a group.

    Hashes are rows here; the k-th smallest of a key is found from per-key windows that
    Spark limits map-side, so a key with a third of all rows sends k rows a task.
    """
    h = df.select(key, F.explode(column).alias("h")).distinct()
    ranked = h.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("h"))).where(F.col("r") <= k)
    return ranked.groupBy(key).agg(F.sort_array(F.collect_list("h")).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of the two shingle sets."""

    def of(both: Column) -> Column:
        common = F.size(F.array_intersect(F.array_intersect(both, a), b))
        return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(common / F.size(both))

    return let(merge(a, b, k), of)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / ((F.element_at(a, k) + 0.5) / float(1 << 32)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated part of a's shingles that b has too."""
    both = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 8, "0"))), "")


def _place(cuts: list, value: Column, inclusive: bool) -> Column:
    """How many of the sorted ``cuts`` are less than the value (or equal to it): by halving."""
    if not cuts:
        return F.lit(0)
    array, n = F.lit(cuts), len(cuts)

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        at = F.get(array, middle)
        below = (at <= value) if inclusive else (at < value)
        open_ = acc["low"] < acc["high"]
        return F.struct(F.when(open_ & below, middle + 1).otherwise(acc["low"]).alias("low"), F.when(open_ & ~below, middle).otherwise(acc["high"]).alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.lit(n).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length())), start, halve, lambda acc: acc["low"])


def with_next(docs: DataFrame, key: str, derive: dict[str, Column], parts: int) -> tuple[DataFrame, str]:
    """``docs``, the columns of ``derive`` and a struct, whose name is returned: the following
    row by descending key, after the last row the first.

    The key's range is cut into ``parts`` (its quantiles: ``parts`` numbers reach the
    driver). A key that several quantiles fall on, and the rows without a key, are cut further
    by a hash of the row, which also orders rows of one key: no part holds much more than its
    share. Each part also gets a copy of the first row of the part that follows it, so the next
    row is always in the same part: one shuffle, no global sort and no single task.
    """
    n, none, cuts = docs.agg(F.count("*"), F.count_if(F.col(key).isNull()), F.percentile_approx(key, [i / parts for i in range(1, parts)], 10_000)).first()
    cuts, without = sorted(cuts or []), max(1, round(parts * none / max(1, n)))
    columns = docs.columns
    part_, guest, top, row, mark, next_ = fresh(docs.withColumns(derive), "part", "guest", "top", "row", "mark", "next")
    hashed = F.xxhash64(*[c for c in columns if c != key])
    share = F.least((hashed / float(1 << 63) + 1) / 2, F.lit(0.9999999999))
    low, high = _place(cuts, F.col(key), False), _place(cuts, F.col(key), True)
    part = F.when(F.col(key).isNull(), F.floor(share * without) - without).otherwise(low + F.floor(share * (high - low + 1)))
    placed = docs.withColumn(mark, hashed).withColumn(part_, part)
    # The first row of each part: of its largest key and hash, and there the smallest row. At most
    # ``parts`` and a few rows, so they may be broadcast and ordered in one task.
    largest = F.struct(F.col(key).isNotNull(), F.col(key), F.col(mark))
    tops = placed.groupBy(part_).agg(F.max(largest).alias(top)).withColumnRenamed(part_, guest)
    heads = placed.join(F.broadcast(tops), (F.col(part_) == F.col(guest)) & largest.eqNullSafe(F.col(top)))
    heads = heads.groupBy(part_).agg(F.min(F.struct(*columns)).alias(row))
    down = Window.orderBy(F.desc(part_))
    every = Window.orderBy(F.desc(part_)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    guests = heads.select(f"{row}.*", F.coalesce(F.lag(part_).over(down), F.min(part_).over(every)).alias(part_), F.lit(1).alias(guest))
    rows = placed.withColumn(guest, F.lit(0)).unionByName(guests.withColumn(mark, F.lit(0).cast("long"))).withColumns(derive)
    by = Window.partitionBy(part_).orderBy(guest, F.desc_nulls_last(key), F.desc(mark), *[c for c in columns if c != key])
    return rows.withColumn(next_, F.lead(F.struct(*columns, *derive)).over(by)).where(F.col(guest) == 0).drop(part_, guest, mark), next_


def report(docs: DataFrame, *, k: int = K, parts: int | None = None) -> DataFrame:
    """Sketches of every whole text and of its edited text: the last third of its code
    points replaced by as many of the next document's first."""
    parts = parts or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", text_of("text").alias("text"))
    n, _ = with_next(rows, "doc_id", {"a": sketch(F.col("text"), k)}, parts)
    n = n.withColumn("n_chars", F.length("text").cast("long")).withColumn("moved", F.floor(F.col("n_chars") / 3).cast("int"))
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars as int) - moved)"), F.expr("substring(next.text, 1, moved)"))
    n = n.select("doc_id", "n_chars", "a", F.col("next.a").alias("c"), edited.alias("edited"))
    n = n.select("doc_id", "n_chars", "a", "c", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), sketch(F.col("edited"), k).alias("b"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return n.select(
        "doc_id", "n_chars", "edited_sha256", as_text(a).alias("fingerprint"), as_text(b).alias("edited_fingerprint"),
        resemblance(a, b, k).alias("near_edited"), resemblance(a, c, k).alias("near_next"),
        distinct_shingles(a, k).alias("distinct_shingles"), containment(b, a, k).alias("edited_in_text"),
    )

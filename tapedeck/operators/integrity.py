"""Verification, corruption, determinism and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import WARNINGS
from ..functions.fields import Options
from ..plans.layout import Layout
from . import records


# --- byte predicates ----------------------------------------------------------------------


def printable_ascii(raw: Column) -> Column:
    return F.hex(raw).rlike("^([2-6][0-9A-F]|7[0-9A-E])*$")


def likely_corrupt_ebcdic(raw: Column) -> Column:
    """Holds a byte of 00-1F or 7F-9F."""
    return F.hex(raw).rlike("^(..)*([01].|7F|[89].)")


#: Nibbles that the corruption scan takes for digits gone wrong. C, D and F may be signs that
#: have slipped, so the usual rule leaves them out; ``EVERY`` flags all that are no digits.
USUAL, EVERY = "ABE", "A-F"


def bad_packed(raw: Column, nibbles: str = EVERY) -> Column:
    """A digit nibble that is one of ``nibbles``, or a sign nibble below A."""
    return F.hex(raw).rlike(f"^[0-9A-F]*[{nibbles}][0-9A-F]") | ~F.hex(raw).rlike("[A-F]$")


def rdw_like_text(header: Column) -> Column:
    return F.hex(header).rlike("^3[0-9]3[0-9]")


def _positions(raw: Column, pattern: str) -> Column:
    """0-based positions of the bytes whose two digits match."""
    pairs = F.regexp_extract_all(F.hex(raw), F.lit("(..)"), F.lit(1))
    marked = F.transform(pairs, lambda x, i: F.when(x.rlike(pattern), i))
    return F.filter(marked, lambda i: i.isNotNull())


def corruption(df: DataFrame, *, payload: str, index: str, ebcdic: list[tuple[str, int, int]] = (), packed: list[tuple[str, int, int]] = (), nibbles: str = USUAL) -> DataFrame:
    """(index, field, offset, kind) of each fault of the named (field, offset, size) ranges:
    ebcdic, packed_high, packed_low (a digit nibble that is one of ``nibbles``), packed_sign."""
    found = []

    def fault(name: str, offset: Column, kind: str) -> Column:
        return F.struct(F.lit(name).alias("field"), offset.cast("int").alias("offset"), F.lit(kind).alias("kind"))

    def each(name: str, start: int, kind: str):
        return lambda i: fault(name, i + start, kind)

    def before(last: int):
        return lambda i: i < last

    for name, a, n in ebcdic:
        found.append(F.transform(_positions(F.col(payload).substr(a + 1, n), "^([01].|7F|[89].)$"), each(name, a, "ebcdic")))
    for name, a, n in packed:
        raw = F.col(payload).substr(a + 1, n)
        found.append(F.transform(_positions(raw, f"^[{nibbles}]"), each(name, a, "packed_high")))
        found.append(F.transform(F.filter(_positions(raw, f"[{nibbles}]$"), before(n - 1)), each(name, a, "packed_low")))
        found.append(F.transform(F.filter(_positions(raw, "[0-9]$"), _at(n - 1)), each(name, a, "packed_sign")))
    return df.select(index, F.explode(F.concat(*found)).alias("f")).select(index, "f.*")


def _at(last: int):
    return lambda i: i == last


def rdw_corruption(df: DataFrame, *, header: str, payload: str) -> Column:
    """Why a descriptor looks wrong, or null."""
    h = F.hex(F.col(header))
    n = F.conv(F.substring(h, 1, 4), 16, 10).cast("int")
    return F.when(rdw_like_text(F.col(header)), F.lit("text_digits")).when(printable_ascii(F.col(header)) & (F.length(header) == 4), F.lit("printable")).when(n != F.length(payload), F.lit("length"))


# --- verify and summaries ------------------------------------------------------------------


def verify(df: DataFrame, layout: Layout, *, payload: str = "payload", index: str = "record_index", options: Options | None = None, around: int = 16) -> DataFrame:
    """One row for each error: code, field, place and the bytes around it in hex."""
    d = records.decode(df, layout, payload=payload, options=options, keep=[index, payload])
    e = d.select(index, payload, F.explode("_errors").alias("e")).where(~F.col("e.code").isin(*WARNINGS))
    start = F.greatest(F.col("e.byte_offset") - around, F.lit(0))
    window = F.hex(F.col(payload).substr(start + 1, F.col("e.byte_offset") - start + around))
    return e.select(index, "e.code", "e.field_path", "e.byte_offset", window.alias("hex"))


def verify_report(df: DataFrame, layout: Layout, *, payload: str = "payload", index: str = "record_index", options: Options | None = None, record_format: str = "fixed", file: str = "", max_errors: int = 100, sample: int = 5, sample_bytes: int = 256) -> DataFrame:
    """One row: what was verified, totals, the first ``max_errors`` errors (``truncated`` tells
    of more) and the first ``sample`` records in hex, by record."""
    faults = verify(df, layout, payload=payload, index=index, options=options)
    order = [F.col(index), F.col("byte_offset"), F.col("field_path")]
    first = faults.orderBy(*order).limit(max_errors).agg(F.sort_array(F.collect_list(F.struct(F.col(index).alias("index"), F.col("byte_offset").alias("offset"), F.col("field_path").alias("field"), "code", "hex"))).alias("errors"))
    head = df.orderBy(index).limit(sample).agg(F.sort_array(F.collect_list(F.struct(F.col(index).alias("index"), F.hex(F.col(payload).substr(1, sample_bytes)).alias("hex")))).alias("sample"))
    totals = df.agg(F.count("*").alias("records_total"), F.coalesce(F.sum(F.length(payload)), F.lit(0)).alias("file_size_bytes"))
    bad = faults.agg(F.count("*").alias("errors_total"))
    one = lambda d: d.withColumn("_one", F.lit(1))
    r = one(totals).join(one(bad), "_one").join(one(first), "_one").join(one(head), "_one")
    o = options or Options(layout.codepage)
    return r.select(
        F.lit(1).alias("report_version"), F.lit(layout.fingerprint).alias("schema_fingerprint"), F.lit(record_format).alias("record_format"), F.lit(file).alias("file"), "file_size_bytes",
        F.struct(F.lit(o.codepage).alias("codepage"), F.lit(max_errors).alias("max_errors"), F.lit(sample).alias("sample")).alias("cli_opts"),
        "records_total", "errors_total", (F.col("errors_total") > max_errors).alias("truncated"), "errors", "sample",
    )


def stop_after(errors: DataFrame, max_errors: int) -> DataFrame:
    """``errors`` as they are; reading them raises if there are more than ``max_errors``: only
    the first ``max_errors`` + 1 are counted."""
    many = errors.limit(max_errors + 1).agg(F.count("*").alias("_n")).withColumn("_one", F.lit(1))
    stop = F.when(F.col("_n") > max_errors, F.raise_error(F.lit(f"more than {max_errors} errors")).cast("boolean")).otherwise(F.lit(True))
    return errors.withColumn("_one", F.lit(1)).join(F.broadcast(many), "_one").where(stop).drop("_one", "_n")


def summary(df: DataFrame, layout: Layout, *, payload: str = "payload", options: Options | None = None) -> DataFrame:
    """One row: records, bytes, records with errors, warnings, success rate."""
    d = records.decode(df, layout, payload=payload, options=options, keep=[payload])
    bad = F.size(F.filter("_errors", lambda e: ~e["code"].isin(*WARNINGS)))
    warn = F.size(F.filter("_errors", lambda e: e["code"].isin(*WARNINGS)))
    one = d.select(F.length(payload).alias("n"), bad.alias("bad"), warn.alias("warn"))
    return one.agg(
        F.count("*").alias("records"), F.coalesce(F.sum("n"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.when(F.col("bad") > 0, 1).otherwise(0)), F.lit(0)).alias("records_with_errors"),
        F.coalesce(F.sum("warn"), F.lit(0)).alias("warnings"), F.try_divide(F.sum(F.when(F.col("bad") == 0, 1.0).otherwise(0.0)), F.count("*")).alias("success_rate"),
    )


def error_summary(errors: DataFrame, *, code: str = "code") -> DataFrame:
    level = F.when(F.col(code).isin(*WARNINGS), "warning").when(F.substring(code, 1, 4).isin("CBKI", "CBKP", "CBKS"), "fatal").otherwise("error")
    return errors.groupBy(code, level.alias("severity")).agg(F.count("*").alias("n"))


def size_warnings(files: DataFrame, lrecl: int) -> DataFrame:
    return files.select("path", "length", (F.col("length") % lrecl).alias("tail")).where("tail <> 0")


# --- determinism -----------------------------------------------------------------------------


def differences(left: DataFrame, right: DataFrame, *, key: str, value: str, limit: int = 100) -> DataFrame:
    """(key, offset, left, right): bytes that differ, position by position; the shorter side is
    padded with zero bytes. ``limit`` is a feature of the report."""
    a, b = left.select(key, F.col(value).alias("a")), right.select(key, F.col(value).alias("b"))
    pad = lambda x, y: F.rpad(F.hex(F.coalesce(F.col(x), F.lit(b""))), F.greatest(F.length(x), F.length(y), F.lit(0)) * 2, "0")
    j = a.join(b, key, "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    bytes_of = lambda c: F.regexp_extract_all(c, F.lit("(..)"), F.lit(1))
    both = F.arrays_zip(bytes_of(pad("a", "b")).alias("a"), bytes_of(pad("b", "a")).alias("b"))
    d = j.select(key, F.posexplode(both).alias("offset", "v")).where("v.a <> v.b")
    return d.select(key, "offset", F.col("v.a").alias("left"), F.col("v.b").alias("right")).orderBy(key, "offset").limit(limit)


def is_deterministic(first: DataFrame, second: DataFrame) -> bool:
    """Whether two runs give the same rows, in any order."""
    return first.exceptAll(second).isEmpty() and second.exceptAll(first).isEmpty()


def digest(df: DataFrame, value: str, keep: list[str] | None = None) -> DataFrame:
    return df.select(*(keep or []), F.sha2(value, 256).alias("sha256"), F.md5(value).alias("md5"))


def in_sequence(df: DataFrame, index: str) -> DataFrame:
    """Records by number, as they were read, whatever the tasks that worked on them."""
    return df.orderBy(index)


def gaps(df: DataFrame, index: str, stretch: int = 1_000_000) -> DataFrame:
    """(first, last) of the numbers that are missing between the least and the largest.

    Numbers are looked at by stretches; of each only the ends go into one task."""
    part = F.floor(F.col(index) / stretch)
    w = Window.partitionBy("_part").orderBy("_i")
    rows = df.select(part.alias("_part"), F.col(index).alias("_i"))
    inside = rows.select(F.lag("_i").over(w).alias("a"), F.col("_i").alias("b"))
    ends = rows.groupBy("_part").agg(F.min("_i").alias("lo"), F.max("_i").alias("hi"))
    between = ends.select(F.lag("hi").over(Window.orderBy("_part")).alias("a"), F.col("lo").alias("b"))
    return inside.union(between).where("b > a + 1").select((F.col("a") + 1).alias("first"), (F.col("b") - 1).alias("last"))


def round_trip(df: DataFrame, layout: Layout, *, payload: str = "payload", options: Options | None = None) -> DataFrame:
    """Records whose bytes differ after decoding and encoding: (payload, again)."""
    d = records.decode(df, layout, payload=payload, options=options, keep=[payload])
    again = records.encode(d.where(F.size("_errors") == 0).withColumnRenamed(payload, "_before"), layout, options=options, out="again", keep=["_before"])
    return again.where(F.col("_before") != F.col("again")).select(F.col("_before").alias(payload), "again")


def _texts(df: DataFrame, layout: Layout, payload: str, options: Options | None, keep: list[str]) -> DataFrame:
    d = records.decode(df, layout, payload=payload, options=options, keep=keep, lossless=True)
    fields = [F.col(f"`{c}`") for c in d.columns if c not in [*keep, "_errors"]]
    return d.select(*keep, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("said"), F.size("_errors").alias("faults"))


def determinism(df: DataFrame, layout: Layout, *, mode: str, payload: str = "payload", index: str = "record_index", options: Options | None = None) -> DataFrame:
    """One row: mode, records, how many differ and where the first one is.

    ``decode`` and ``encode`` do the same twice; ``round_trip`` compares what is decoded from
    a record and from its encoding. Records with faults are compared in ``decode`` alone."""
    first = _texts(df, layout, payload, options, [index])
    if mode == "decode":
        second = _texts(df, layout, payload, options, [index])
    else:
        again = _encoded(df, layout, payload, index, options)
        if mode == "encode":
            first = again.select(index, F.hex("again").alias("said"))
            second = _encoded(df, layout, payload, index, options).select(index, F.hex("again").alias("said"))
        elif mode == "round_trip":
            first, second = first.where("faults = 0"), _texts(again, layout, "again", options, [index])
        else:
            raise ValueError(f"mode {mode}")
    j = first.select(index, F.col("said").alias("a")).join(second.select(index, F.col("said").alias("b")), index, "full_outer")
    differs = ~F.col("a").eqNullSafe(F.col("b"))
    return j.agg(F.lit(mode).alias("mode"), F.count("*").alias("records"), F.count_if(differs).alias("differences"), F.min(F.when(differs, F.col(index))).alias("first_difference"))


def _encoded(df: DataFrame, layout: Layout, payload: str, index: str, options: Options | None) -> DataFrame:
    d = records.decode(df, layout, payload=payload, options=options, keep=[index, payload])
    whole = d.where(F.size("_errors") == 0).drop("_errors").withColumnRenamed(payload, "_before")
    return records.encode(whole, layout, options=options, out="again", keep=[index, "_before"])


def fidelity(df: DataFrame, layout: Layout, *, payload: str = "payload", index: str = "record_index", options: Options | None = None) -> DataFrame:
    """One row: records, those decoded without a fault, of these the ones whose bytes come back
    the same, and whose values do; the shares of the first and of the last."""
    again = _encoded(df, layout, payload, index, options).select(index, "_before", "again")
    a, b = _texts(again, layout, "_before", options, [index]), _texts(again, layout, "again", options, [index])
    same = a.select(index, F.col("said").alias("a")).join(b.select(index, F.col("said").alias("b")), index)
    j = df.select(index).join(again, index, "left").join(same, index, "left")
    n, sound, bytes_, values = F.count("*"), F.count("again"), F.count_if(F.col("_before") == F.col("again")), F.count_if(F.col("a") == F.col("b"))
    return j.agg(n.alias("records"), sound.alias("sound"), bytes_.alias("same_bytes"), values.alias("same_values"), F.try_divide(bytes_, n).alias("lossless"), F.try_divide(values, n).alias("faithful"))


def throughput(summary_row: DataFrame, seconds: float) -> DataFrame:
    """A run summary with MiB a second and the share of records with errors."""
    return summary_row.withColumn("mib_per_second", F.col("bytes") / F.lit(float(1 << 20)) / F.lit(float(seconds))).withColumn("error_rate", F.try_divide(F.col("records_with_errors"), F.col("records")))

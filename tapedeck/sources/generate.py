"""Made-up layouts and records, for tests: the same seed gives the same ones, on any cluster."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import Options
from ..operators import records
from ..plans.layout import Field, Layout

STRATEGIES = ("random", "edge", "corrupt")
#: Declarations that must be refused, by code.
INVALID = {
    "CBKP001": "01 R. 05 A PIC X(3)", "CBKP011": "01 R. 05 A PIC X(3) COMP-3.", "CBKP021": "01 R. 05 N PIC 9. 05 A PIC X OCCURS 1 TO 5 DEPENDING ON N. 05 B PIC X.",
    "CBKP101": "01 R. 05 A PIC X(0).", "CBKS121": "01 R. 05 A PIC X OCCURS 1 TO 5 DEPENDING ON N.", "CBKS601": "01 R. 05 A PIC X. 66 Z RENAMES Q.",
}


def layout_text(seed: int, fields: int = 8) -> str:
    """A declaration of ``fields`` fields of all kinds."""
    r = random.Random(seed)
    kinds = [
        lambda: f"PIC X({r.randint(1, 30)})", lambda: f"PIC 9({r.randint(1, 9)})", lambda: f"PIC S9({r.randint(1, 9)})V9({r.randint(1, 4)})",
        lambda: f"PIC S9({r.randint(1, 9)})V99 COMP-3", lambda: f"PIC S9({r.randint(1, 9)}) COMP", lambda: f"PIC S9({r.randint(1, 9)}) SIGN {r.choice(['LEADING', 'TRAILING'])} SEPARATE",
    ]
    return "01 MADE.\n" + "".join(f"   05 F{i:03d} {r.choice(kinds)()}.\n" for i in range(fields))


def _value(f: Field, seed: int, strategy: str) -> Column:
    hashed = F.xxhash64(F.col("id"), F.lit(f.path), F.lit(seed))
    if f.kind == "text":
        letters = F.substring(F.upper(F.md5(hashed.cast("string").cast("binary"))), 1, min(f.size, 32))
        return F.when(F.col("id") % 3 == 0, F.lit("")).otherwise(letters) if strategy == "edge" else letters
    digits = min(f.digits, 15)
    top = 10**digits
    whole = F.pmod(hashed, F.lit(top))
    if strategy == "edge":
        whole = F.when(F.col("id") % 3 == 0, F.lit(0)).when(F.col("id") % 3 == 1, F.lit(top - 1)).otherwise(F.lit(1))
    if f.kind == "binary":
        whole = whole % F.lit(1 << (f.bits - 1))
    signed = F.when(F.pmod(F.shiftright(hashed, 7), F.lit(2)) == 0, -whole).otherwise(whole) if f.signed else whole
    return (signed.cast("decimal(20,0)") * F.lit(f"{10 ** -f.scale:.{f.scale}f}").cast(f"decimal({f.scale + 1},{f.scale})")).cast(f"decimal(30,{f.scale})") if f.scale else signed


def generated(spark: SparkSession, layout: Layout, n: int, *, seed: int = 1, strategy: str = "random", options: Options | None = None) -> DataFrame:
    """(record_index from 1, payload, spoilt): records of a layout of single fields. ``edge``:
    least, largest and zero values; ``corrupt``: in every fifth record all bits of one byte
    are turned, at a place that the seed tells (``spoilt``, from 0)."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy {strategy}")
    rows = spark.range(1, n + 1).select("id", *[_value(f, seed, strategy).alias(f.name) for f in layout.top()])
    made = records.encode(rows, layout, options=options, keep=["id"]).select(F.col("id").alias("record_index"), "payload")
    place = F.pmod(F.xxhash64("record_index", F.lit(seed)), F.lit(layout.lrecl)).cast("int")
    spoilt = F.when((F.col("record_index") % 5 == 0) & F.lit(strategy == "corrupt"), place)
    byte = F.col("payload").substr(F.col("spoilt") + 1, F.lit(1))
    turned = F.unhex(F.translate(F.hex(byte), "0123456789ABCDEF", "FEDCBA9876543210"))
    whole = F.concat(F.col("payload").substr(F.lit(1), F.col("spoilt")), turned, F.col("payload").substr(F.col("spoilt") + 2, F.length("payload")))
    return made.withColumn("spoilt", spoilt).withColumn("payload", F.when(F.col("spoilt").isNull(), F.col("payload")).otherwise(whole))

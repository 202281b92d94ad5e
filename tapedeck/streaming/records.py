"""Records as streams: decoding is stateless, so the batch expressions serve as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import Options
from ..operators import records
from ..plans.layout import Layout
from ..sources.frames import rdw_records

_FILES = "path string, modificationTime timestamp, length long, content binary"


def fixed_stream(spark: SparkSession, path: str, lrecl: int) -> DataFrame:
    """New files (each below 2 GB) of fixed-length records below ``path``."""
    f = spark.readStream.format("binaryFile").schema(_FILES).load(path)
    i = F.explode(F.expr(f"if(length >= {lrecl}, sequence(0, cast(length div {lrecl} as int) - 1), array())"))
    return f.select("path", "content", i.alias("i")).select("path", (F.col("i") + 1).cast("bigint").alias("record_index"), F.col("content").substr(F.col("i") * lrecl + 1, F.lit(lrecl)).alias("payload"))


def rdw_stream(spark: SparkSession, path: str) -> DataFrame:
    return rdw_records(spark.readStream.format("binaryFile").schema(_FILES).load(path))


def decode_stream(stream: DataFrame, layout: Layout, *, options: Options | None = None, keep: list[str] | None = None, mode: str = "drop") -> DataFrame:
    return records.decode(stream, layout, options=options, keep=keep or [], mode=mode)


def failures_by_window(events: DataFrame, *, ts: str, user: str, failed: Column, late: str = "10 minutes", size: str = "5 minutes", least: int = 3) -> DataFrame:
    """Users with ``least`` failures or more in a window; rows later than ``late`` are left out."""
    w = events.withWatermark(ts, late).where(failed).groupBy(F.window(ts, size).alias("window"), user)
    return w.agg(F.count("*").alias("failures")).where(F.col("failures") >= least)

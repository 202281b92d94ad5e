"""Files of records: fixed length, and with record descriptor words (RDW).

A fixed file is cut by Spark's own fixed-length input format at multiples of the record
length, in the JVM: one large file is read by many tasks, from any store that Spark reads, and
no record passes through Python. Record numbers follow from the place of the split.

In an RDW file the lengths form a chain, so one task reads a file. The data source
``rdw_records`` reads it as a stream of ``CHUNK`` bytes and hands on Arrow batches, in memory
that the file's size doesn't change; it opens paths that pyarrow can open. For other stores
``whole=True`` takes the bytes from Spark's ``binaryFile`` (files below 2 GB).
"""

from __future__ import annotations

import io
import re
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..errors import LayoutError

RDW_MAX = 65535
RDW_SCHEMA = "record_index bigint, header binary, payload binary, error string"
#: Bytes that are read at once, and records of a batch.
CHUNK, BATCH = 8 << 20, 4096


def scratch(spark: SparkSession) -> str:
    """A folder that all executors share: below ``spark.checkpoint.dir``; in a local session
    that names none, one of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tapedeck-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def read_records(spark: SparkSession, path: str, kind: str, *, lrecl: int | None = None, strict: bool = True) -> DataFrame:
    """(record_index, payload) of a file of either format: ``fixed`` or ``rdw``."""
    if kind == "fixed":
        if lrecl is None:
            raise LayoutError("CBKI001", "fixed records need a record length")
        return read_fixed_indexed(spark, path, lrecl, strict=strict).select("record_index", "payload")
    if kind != "rdw":
        raise LayoutError("CBKI001", f"no record format {kind}")
    return read_rdw(spark, path, strict=strict).select("record_index", "payload")


def read_fixed(spark: SparkSession, path: str, lrecl: int, *, strict: bool = True) -> DataFrame:
    """(payload) of each whole record, split at multiples of ``lrecl``.

    ``strict`` first lists the files (no bytes are read) and refuses partial tails (CBKF221).
    """
    if lrecl <= 0:
        raise LayoutError("CBKF102", f"record length {lrecl}")
    if strict:
        bad = partial_files(spark, path, lrecl).first()
        if bad:
            raise LayoutError("CBKF221", f"{bad['path']}: {bad['tail']} bytes after the last record")
    # The public binaryRecords of the JVM, made a Dataset there: Python's would move each record
    # to a worker and back.
    records = spark.sparkContext._jsc.binaryRecords(path, lrecl)
    encoder = spark.sparkContext._jvm.org.apache.spark.sql.Encoders.BINARY()
    return DataFrame(spark._jsparkSession.createDataset(records.rdd(), encoder).toDF(), spark).withColumnRenamed("value", "payload")


def read_fixed_indexed(spark: SparkSession, path: str, lrecl: int, *, strict: bool = True) -> DataFrame:
    """(path, record_index from 1 in each file, payload). A split begins at a multiple of the
    record length, and is one partition: the number is arithmetic, without a shuffle."""
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    place = F.expr(f"input_file_block_start() div {lrecl}")
    return read_fixed(spark, path, lrecl, strict=strict).select(F.input_file_name().alias("path"), (place + row + 1).alias("record_index"), "payload")


def partial_files(spark: SparkSession, path: str, lrecl: int) -> DataFrame:
    """Files whose size is no multiple of the record length; only metadata is read."""
    f = spark.read.format("binaryFile").load(path).select("path", "length")
    return f.select("path", "length", (F.col("length") % lrecl).alias("tail")).where("tail > 0")


def split_rdw(stream: io.BufferedIOBase, strict: bool = False) -> Iterator[tuple[int, bytes, bytes, str | None]]:
    """(index, header, payload, error code) of a stream. A length counts the payload alone.

    A header is judged before its payload is read: reserved bytes (strict: CBKR211 comes
    first), then whether it looks like text, then whether the payload is there."""
    index = 0
    while header := stream.read(4):
        index += 1
        if len(header) < 4:
            if strict:
                yield index, header, b"", "CBKF221"
            return
        (n,) = struct.unpack(">H", header[:2])
        payload = stream.read(n) if n else b""
        reserved = header[2:] != b"\0\0"
        if reserved and strict:
            error = "CBKR211"
        elif looks_like_text(header):
            error = "CBKF104"
        else:
            error = "CBKF102" if len(payload) < n else "CBKR211" if reserved else None
        yield index, header, payload, error


def looks_like_text(header: bytes) -> bool:
    return header[:2].isdigit()


def _batches(stream, strict: bool) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for row in split_rdw(stream, strict):
        rows.append(row)
        held += len(row[2])
        if len(rows) == BATCH or held > CHUNK:
            yield _batch(rows)
            rows, held = [], 0
    yield _batch(rows)


def _batch(rows: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["record_index", "header", "payload", "error"])


def rdw_records(files: DataFrame, *, content: str = "content", strict: bool = False) -> DataFrame:
    """Records of each row's bytes, a batch of records at a time."""

    def run(batches):
        for batch in batches:
            for value in batch.column(0):
                yield from _batches(io.BytesIO(value.as_buffer() or b"") if value.is_valid else io.BytesIO(), strict)

    return files.select(content).mapInArrow(run, RDW_SCHEMA)


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _RdwReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.strict = options["path"], options.get("strict", "false") == "true"

    def partitions(self):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        info = system.get_file_info(path)
        if info.type == fs.FileType.Directory:
            found = [f.path for f in system.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and f.base_name[:1] not in "._"]
        elif info.type == fs.FileType.File:
            found = [path]
        else:
            raise FileNotFoundError(self.path)
        return [_File(f) for f in sorted(found)]

    def read(self, partition):
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        with system.open_input_stream(partition.path, buffer_size=CHUNK) as stream:
            yield from _batches(stream, self.strict)


class RdwSource(DataSource):
    @classmethod
    def name(cls):
        return "rdw_records"

    def schema(self):
        return RDW_SCHEMA

    def reader(self, schema):
        return _RdwReader(self.options)


def read_rdw(spark: SparkSession, path: str, *, strict: bool = False, whole: bool = False) -> DataFrame:
    if whole:
        records = rdw_records(spark.read.format("binaryFile").load(path), strict=strict)
    else:
        spark.dataSource.register(RdwSource)
        records = spark.read.format("rdw_records").option("strict", str(strict).lower()).load(path)
    if strict:
        bad = F.col("error").isin("CBKF102", "CBKF104", "CBKF221", "CBKR211")
        records = records.where(F.when(bad, F.raise_error(F.col("error")).cast("boolean")).otherwise(F.lit(True)))
    return records


def short_payloads(records: DataFrame, lrecl: int, *, least: int | None = None, payload: str = "payload") -> DataFrame:
    """``records`` with the column ``short``: CBKF221 where the payload ends before the record
    does, by ``least`` (for records with an array of varying length at the end) or ``lrecl``."""
    return records.withColumn("short", F.when(F.length(payload) < (lrecl if least is None else least), F.lit("CBKF221")))


def empty_records(records: DataFrame, prefix: int, *, payload: str = "payload") -> DataFrame:
    """Empty records of a layout whose fixed part has ``prefix`` bytes: an error unless that is none."""
    return records.where(F.length(payload) == 0).withColumn("error", F.when(F.lit(prefix) > 0, F.lit("CBKF221")))


def raw_records(records: DataFrame, *, payload: str = "payload") -> DataFrame:
    """(record_index, length, bytes in hex): records as they are, undecoded."""
    return records.select("record_index", F.length(payload).alias("length"), F.hex(payload).alias("hex"))


def rdw_of(payload: Column) -> Column:
    """Header and payload as one value; more than 65535 bytes raise."""
    n = F.length(payload)
    fits = F.when(n <= RDW_MAX, n).otherwise(F.raise_error(F.lit("CBKF102: payload too long")).cast("int"))
    return F.concat(F.unhex(F.lpad(F.hex(fits.cast("bigint")), 4, "0")), F.lit(b"\0\0"), payload)


def fixed_of(payload: Column, lrecl: int) -> Column:
    """Zero bytes to the record length; a longer payload raises."""
    ok = F.length(payload) <= lrecl
    padded = F.concat(payload, F.lit(b"\0" * lrecl)).substr(1, lrecl)
    return F.when(ok, padded).otherwise(F.raise_error(F.lit("CBKF102: record too long")).cast("binary"))


class _Message(WriterCommitMessage):
    def __init__(self, name, rows):
        self.name, self.rows = name, rows


class _BytesWriter(DataSourceWriter):
    def __init__(self, options):
        self.uri = options["path"] if "://" in options["path"] else f"file://{options['path']}"

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri)

    def write(self, rows):
        import base64
        import uuid

        from pyspark import TaskContext

        system, path = self._system()
        system.create_dir(f"{path}/_temporary")
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.bin"
        n = 0
        with system.open_output_stream(f"{path}/_temporary/{name}") as out:
            for row in rows:
                out.write(base64.b64decode(row[0]))
                n += 1
        return _Message(name, n)

    def commit(self, messages):
        system, path = self._system()
        for m in messages:
            if m is not None and m.rows:
                system.move(f"{path}/_temporary/{m.name}", f"{path}/{m.name}")
        self._clean()

    def abort(self, messages):
        self._clean()

    def _clean(self):
        system, path = self._system()
        from pyarrow import fs

        if system.get_file_info(f"{path}/_temporary").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/_temporary")


class RecordBytes(DataSource):
    @classmethod
    def name(cls):
        return "record_bytes"

    def schema(self):
        return "value string"

    def writer(self, schema, overwrite):
        return _BytesWriter(self.options)


def write_bytes(df: DataFrame, column: str, path: str) -> None:
    """The rows' bytes one after another, a file for each partition that has rows. Files are
    moved into place when all tasks are done. ``path`` is in a store that pyarrow opens on all
    executors: Spark has no public writer of bare bytes."""
    df.sparkSession.dataSource.register(RecordBytes)
    df.select(F.base64(column).alias("value")).write.format("record_bytes").mode("append").save(path)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "")


def write_parquet(df: DataFrame, path: str, *, compression: str = "snappy", row_group: int | None = None) -> None:
    w = df.write.option("compression", compression)
    (w.option("parquet.block.size", row_group) if row_group else w).parquet(path)


def described(df: DataFrame, layout) -> DataFrame:
    """``df`` with each field's place and picture as metadata of its column; Parquet files keep
    it in their footer."""
    of = {f.name.lower(): f for f in layout.top()}
    out = []
    for c in df.columns:
        f = of.get(c.lower())
        known = {"offset": f.offset, "size": f.size, "kind": f.kind, "pic": f.pic, "scale": f.scale, "fingerprint": layout.fingerprint} if f else {}
        out.append(F.col(f"`{c}`").alias(c, metadata=known))
    return df.select(*out)


def write_arrow(df: DataFrame, path: str, *, most: int = 5_000_000) -> None:
    """One Arrow IPC file of at most ``most`` rows: they come through the driver."""
    if df.limit(most + 1).count() > most:
        raise LayoutError("CBKW004", f"more than {most} rows for one Arrow file")
    t = df.toArrow()
    with pa.OSFile(path, "wb") as sink, pa.ipc.new_file(sink, t.schema) as writer:
        writer.write_table(t)


def legacy_table(lines: DataFrame, sample: str, *, column: str = "value") -> DataFrame:
    """Columns of JSON lines whose types are inferred from one ``sample`` line."""
    kind = lines.sparkSession.range(1).select(F.schema_of_json(F.lit(sample)).alias("s")).first().s
    return lines.select(F.from_json(column, kind).alias("r")).select("r.*")

"""Further queries: layouts, files, conversions, checks and audit analytics over the tables."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from .errors import LayoutError
from .functions import fields
from .functions.fields import Options
from .operators import audit, integrity, records
from .plans import features
from .plans.layout import parse
from .queries import LINES, ORDERS, broken_lines, cents, event_bytes, order_lines, orders_bytes, query, table
from .sources import frames, generate
from .streaming import records as streaming

# --- layouts: declarations made from rows of a small table ------------------------------------


def nations(spark, sf_dir) -> list[int]:
    """Keys of the smallest table (25 rows), from which declarations are made on the driver."""
    return sorted(r[0] for r in table(spark, sf_dir, "nation").select("n_nationkey").limit(1000).collect())


@query("""SELECT n_nationkey AS k, unnest(['A', 'B', 'C', 'D']) AS name, unnest([0, b, b + 4, b + 4 + c]) AS "offset", unnest([n_nationkey + 1, 4, c, 2]) AS size, b + 4 + c + 2 * (n_nationkey + 1) AS lrecl
FROM (SELECT n_nationkey, (n_nationkey + 4) // 4 * 4 AS b, (n_nationkey % 18 + 1) // 2 + 1 AS c FROM nation)""")
def layout_offsets(spark, sf_dir):
    """Sizes, alignment and arrays."""
    rows = []
    for k in nations(spark, sf_dir):
        layout = parse(f"01 R. 05 A PIC X({k + 1}). 05 B PIC 9(9) COMP SYNC. 05 C PIC S9({k % 18 + 1}) COMP-3. 05 D PIC 9(2) OCCURS {k + 1} TIMES.")
        rows += [(k, f.name, f.offset, f.size, layout.lrecl) for f in layout.top()]
    return spark.createDataFrame(rows, "k int, name string, offset int, size int, lrecl int")


@query("""SELECT n_nationkey AS k, unnest(list_concat(list_transform(range(1, r + 1), lambda i: CASE WHEN i = 1 THEN 'A' ELSE 'A__dup' || i END), ['_filler_' || lpad(cast(r AS varchar), 6, '0'), 'B', '_filler_' || lpad(cast(r + 3 AS varchar), 6, '0')])) AS name
FROM (SELECT n_nationkey, n_nationkey % 4 + 1 AS r FROM nation)""")
def layout_names(spark, sf_dir):
    """Repeated names and fillers."""
    rows = []
    for k in nations(spark, sf_dir):
        layout = parse("01 R. " + "05 A PIC X VALUE 'x'. " * (k % 4 + 1) + "05 FILLER PIC X(2). 05 B PIC X. 05 FILLER PIC X(3).", emit_filler=True)
        rows += [(k, f.name) for f in layout.top()]
    return spark.createDataFrame(rows, "k int, name string")


_BAD = [
    ("", "01 R. 05 A PIC X."), ("CBKP021", "01 R. 05 N PIC 9. 05 A PIC X OCCURS 1 TO 5 DEPENDING ON N. 05 B PIC X."),
    ("CBKP022", "01 R. 05 N PIC 9. 05 G OCCURS 2. 10 A PIC X OCCURS 1 TO 5 DEPENDING ON N."), ("CBKS121", "01 R. 05 N PIC X. 05 A PIC X OCCURS 1 TO 5 DEPENDING ON N."),
    ("CBKS141", "01 R. 05 A PIC X(9000) OCCURS 9000."), ("CBKS601", "01 R. 05 A PIC X. 66 Z RENAMES Q."), ("CBKS607", "01 R. 05 A PIC X OCCURS 3. 66 Z RENAMES A."),
    ("CBKS609", "01 R. 05 A PIC X. 05 B REDEFINES A PIC X. 66 Z RENAMES A THRU B."), ("CBKS612", "01 R. 05 N PIC 9. 05 A PIC X OCCURS 1 TO 3 DEPENDING ON N. 66 Z RENAMES N THRU A."),
    ("CBKP011", "01 R. 05 A PIC X(3) COMP-3."),
]


@query(f"SELECT n_nationkey AS k, list_extract({[c for c, _ in _BAD]}, n_nationkey % {len(_BAD)} + 1) AS code FROM nation")
def layout_codes(spark, sf_dir):
    """The code that each of several faulty declarations is refused with."""
    def code(text: str) -> str:
        try:
            parse(text)
        except LayoutError as e:
            return e.code
        return ""

    return spark.createDataFrame([(k, code(_BAD[k % len(_BAD)][1])) for k in nations(spark, sf_dir)], "k int, code string")


@query("SELECT n_nationkey AS k, true AS same, 14 + n_nationkey + 1 AS lrecl FROM nation")
def layout_forms(spark, sf_dir):
    """Columns 8 to 72 with comments, a continued line and remarks, against the free form."""
    rows = []
    for k in nations(spark, sf_dir):
        free = f"01 R.\n 05 AMOUNT PIC S9(9)V99 COMP-3.\n 05 T PIC X({k + 1}). *> remark\n 05 D PIC 9(8).\n"
        lines = ["01 R.", "* a comment", "   05 AMOUNT PIC S9(9)V99 CO", "-MP-3.", f"   05 T PIC X({k + 1}).", "   05 D PIC 9(8)."]
        fixed = "".join(f"{i:06d}{x[0]}{x[1:]}\n" if x[0] in "*-" else f"{i:06d} {x:<65}IGNORED\n" if not x.endswith("CO") else f"{i:06d} {x}\n" for i, x in enumerate(lines, 1))
        a, b = parse(free), parse(fixed)
        rows.append((k, a.fingerprint == b.fingerprint, b.lrecl))
    return spark.createDataFrame(rows, "k int, same boolean, lrecl int")


@query("SELECT n_nationkey AS k, n_nationkey % 7 AS normative, 0 AS zero, greatest(1, n_nationkey % 7) AS one FROM nation")
def dialect_counts(spark, sf_dir):
    rows = []
    for k in nations(spark, sf_dir):
        l = [parse(f"01 R. 05 N PIC 9. 05 A PIC X OCCURS {k % 7} TO 9 TIMES DEPENDING ON N.", dialect=d) for d in ("normative", "zero", "one")]
        rows.append((k, *[x.least(x.tail_array) for x in l]))
    return spark.createDataFrame(rows, "k int, normative int, zero int, one int")


@query("SELECT * FROM (VALUES ('level-88', 'supported', 0, 0, true), ('level-66-renames', 'partial', 1, 1, false), ('occurs-depending', 'partial', 0, 0, true), ('edited-pic', 'supported', 0, 0, true), ('comp-1-comp-2', 'supported', 2, 1, false), ('sign-separate', 'supported', 1, 0, true), ('nested-odo', 'partial', 0, 0, true)) t(feature, status, needed, missing, available)")
def support_matrix(spark, sf_dir):
    """Features joined to the flags that they need, with one flag off."""
    return features.support_matrix(spark, {"comp_2": False})


@query("SELECT * FROM (VALUES ('experimental', 4, 3), ('enterprise', 6, 1), ('performance', 4, 1), ('debug', 4, 0), ('testing', 4, 0)) t(category, flags, enabled)")
def feature_flags(spark, sf_dir):
    t = features.flag_table(spark, {"sox_compliance": True})
    return t.groupBy("category").agg(F.count("*").cast("int").alias("flags"), F.count_if("enabled").cast("int").alias("enabled"))


# --- files ------------------------------------------------------------------------------------------


def folder(spark, name: str) -> str:
    return f"{frames.scratch(spark)}/tapedeck/{name}-{uuid.uuid4().hex}"


CUSTOMER = "01 R.\n 05 K PIC 9(9) COMP.\n 05 NAME PIC X(25).\n 05 BAL PIC S9(7)V99 COMP-3.\n"


def customer_bytes(spark, sf_dir):
    layout = parse(CUSTOMER)
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("K"), F.col("c_name").alias("NAME"), cents("c_acctbal").alias("BAL"))
    return layout, records.encode(c, layout, keep=["c_custkey"])


def customer_file(spark, sf_dir):
    layout, d = customer_bytes(spark, sf_dir)
    path = folder(spark, "fixed")
    frames.write_bytes(d.select(frames.fixed_of(F.col("payload"), layout.lrecl).alias("b")), "b", path)
    return layout, path


_BAL = "cast(round(c_acctbal * 100) AS bigint)"


@query(f"SELECT c_custkey, c_name AS name, {_BAL} AS cents FROM customer")
def fixed_file(spark, sf_dir):
    """Written as fixed-length records, read in splits and decoded."""
    layout, path = customer_file(spark, sf_dir)
    r = records.decode(frames.read_fixed(spark, path, layout.lrecl), layout, mode="drop", options=Options(trim=True))
    return r.select(F.col("K").cast("bigint").alias("c_custkey"), F.col("NAME").alias("name"), (F.col("BAL") * 100).cast("bigint").alias("cents"))


@query("SELECT count(*) AS records, count(*) AS numbers, count(*) AS last_numbers, 0 AS below_one FROM customer")
def fixed_numbers(spark, sf_dir):
    """Records are numbered from 1 without gaps in each file."""
    layout, path = customer_file(spark, sf_dir)
    one = frames.read_fixed_indexed(spark, path, layout.lrecl).groupBy("path").agg(F.count("*").alias("n"), F.count_distinct("record_index").alias("d"), F.max("record_index").alias("m"), F.min("record_index").alias("least"))
    return one.agg(F.sum("n").alias("records"), F.sum("d").alias("numbers"), F.sum("m").alias("last_numbers"), F.count_if(F.col("least") < 1).cast("int").alias("below_one"))


@query(f"SELECT count(*) AS records, cast(sum({_BAL}) AS bigint) AS cents, 'decimal(9,2)' AS kind FROM customer")
def typed_scan(spark, sf_dir):
    layout, path = customer_file(spark, sf_dir)
    r = records.decode(frames.read_records(spark, path, "fixed", lrecl=layout.lrecl), layout, mode="off", select=["BAL"])
    return r.agg(F.count("*").alias("records"), (F.sum("BAL") * 100).cast("bigint").alias("cents"), F.max(F.typeof("BAL")).alias("kind"))


@query("SELECT 10 * count(*) AS length, 10 * count(*) % 7 AS tail FROM customer HAVING 10 * count(*) % 7 > 0")
def partial_tail(spark, sf_dir):
    """A file whose size is no multiple of the record length."""
    path = folder(spark, "partial")
    frames.write_bytes(table(spark, sf_dir, "customer").select(F.lit(b"0123456789").alias("b")).coalesce(1), "b", path)
    return frames.partial_files(spark, path, 7).select("length", "tail")


@query("SELECT c_custkey, c_name AS name, cast(strlen(c_custkey || ':' || c_name) AS int) AS n, '' AS code FROM customer")
def rdw_file(spark, sf_dir):
    """Records with descriptors, written, and read as a stream."""
    path = folder(spark, "rdw")
    p = table(spark, sf_dir, "customer").select(F.concat_ws(":", "c_custkey", "c_name").cast("binary").alias("payload"))
    frames.write_bytes(p.select(frames.rdw_of(F.col("payload")).alias("b")), "b", path)
    r = frames.read_rdw(spark, path)
    s = F.split(F.decode("payload", "UTF-8"), ":", 2)
    return r.select(s[0].cast("bigint").alias("c_custkey"), s[1].alias("name"), F.conv(F.hex(F.substring("header", 1, 2)), 16, 10).cast("int").alias("n"), F.coalesce("error", F.lit("")).alias("code"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 1 THEN 'CBKR211' WHEN 2 THEN 'CBKF102' WHEN 3 THEN 'CBKF104' ELSE '' END AS code FROM customer")
def rdw_faults(spark, sf_dir):
    """Reserved bytes, cut payloads and descriptors that look like text."""
    p = F.col("c_custkey").cast("string").cast("binary")
    size = F.unhex(F.lpad(F.hex(F.length(p).cast("bigint")), 4, "0"))
    k = F.col("c_custkey") % 4
    header = F.when(k == 1, F.concat(size, F.lit(b"\0\1"))).when(k == 2, F.lit(b"\0\x32\0\0")).when(k == 3, F.lit(b"12\0\0")).otherwise(F.concat(size, F.lit(b"\0\0")))
    r = frames.rdw_records(table(spark, sf_dir, "customer").select(F.concat(header, p).alias("content")))
    return r.select(F.decode("payload", "UTF-8").cast("bigint").alias("c_custkey"), F.coalesce("error", F.lit("")).alias("code"))


@query("SELECT unnest(['', 'CBKF221']) AS code, count(*) AS n FROM customer")
def rdw_cut_header(spark, sf_dir):
    """Two bytes after the last record: an error in strict reading."""
    p = F.col("c_name").cast("binary")
    r = frames.rdw_records(table(spark, sf_dir, "customer").select(F.concat(frames.rdw_of(p), F.lit(b"\0\1")).alias("content")), strict=True)
    return r.groupBy(F.coalesce("error", F.lit("")).alias("code")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 9 < 5 THEN 'CBKF221' ELSE '' END AS short, CASE WHEN c_custkey % 9 = 0 THEN 'CBKF221' ELSE '' END AS nothing FROM customer")
def rdw_short(spark, sf_dir):
    """Payloads below the record length, and empty ones."""
    r = table(spark, sf_dir, "customer").select("c_custkey", F.repeat(F.lit("x"), (F.col("c_custkey") % 9).cast("int")).cast("binary").alias("payload"))
    none = frames.empty_records(r, 5).select("c_custkey", F.col("error").alias("nothing"))
    out = frames.short_payloads(r, 5).join(none, "c_custkey", "left")
    return out.select("c_custkey", F.coalesce("short", F.lit("")).alias("short"), F.coalesce("nothing", F.lit("")).alias("nothing"))


@query("SELECT c_custkey AS record_index, 34 AS length, upper(printf('%08x', c_custkey)) AS head FROM customer")
def raw_records(spark, sf_dir):
    _, d = customer_bytes(spark, sf_dir)
    r = frames.raw_records(d.withColumnRenamed("c_custkey", "record_index"))
    return r.select("record_index", "length", F.substring("hex", 1, 8).alias("head"))


@query("SELECT c_custkey, c_name AS name FROM customer")
def jsonl_scan(spark, sf_dir):
    """A file of JSON lines, some blank, read and parsed."""
    path = folder(spark, "jsonl")
    line = F.to_json(F.struct(F.col("c_custkey").cast("string").alias("K"), F.col("c_name").alias("NAME")))
    lines = table(spark, sf_dir, "customer").select(F.explode(F.array(line, F.lit("  "))).alias("value"))
    lines.write.text(path)
    r = records.from_json(frames.read_jsonl(spark, path), parse(CUSTOMER), "K string, NAME string")
    return r.select(F.col("K").cast("bigint").alias("c_custkey"), F.col("NAME").alias("name"))


@query("SELECT n_nationkey, n_name FROM nation")
def arrow_file(spark, sf_dir):
    """Written as one Arrow file (a small table: it goes through the driver) and read again."""
    import tempfile

    with tempfile.NamedTemporaryFile(suffix=".arrow") as f:
        frames.write_arrow(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), f.name, most=10_000)
        with pa.memory_map(f.name) as source:
            return spark.createDataFrame(pa.ipc.open_file(source).read_all())


@query("""SELECT * FROM (VALUES ('O-ORDERKEY', 0, 4, '999999999'), ('O-CUSTKEY', 4, 4, '999999999'), ('O-STATUS', 8, 1, 'X'), ('O-TOTAL', 9, 7, 'S99999999999V99'), ('O-DATE', 16, 8, '99999999'), ('O-PRIORITY', 24, 15, 'XXXXXXXXXXXXXXX')) t(name, "offset", size, pic)""")
def parquet_metadata(spark, sf_dir):
    """Places and pictures travel with the columns of a Parquet file."""
    data, layout = orders_bytes(spark, sf_dir)
    path = folder(spark, "parquet")
    d = records.decode(data, layout, mode="off").drop("IS-OPEN", "IS-DONE")
    frames.write_parquet(frames.described(d, layout), path, compression="zstd", row_group=1 << 20)
    got = spark.read.parquet(path).schema
    return spark.createDataFrame([(f.name, f.metadata["offset"], f.metadata["size"], f.metadata["pic"]) for f in got], "name string, offset int, size int, pic string")


@query("SELECT n_nationkey AS k, n_name AS name FROM nation")
def legacy_json(spark, sf_dir):
    """Columns inferred from one line."""
    lines = table(spark, sf_dir, "nation").select(F.to_json(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))).alias("value"))
    return frames.legacy_table(lines, '{"k": 1, "name": "x"}').select(F.col("k").cast("int").alias("k"), "name")


@query("SELECT * FROM (VALUES ('random', 600, 0), ('edge', 600, 0), ('corrupt', 600, 120)) t(strategy, records, spoilt)")
def generated_records(spark, sf_dir):
    """Made-up records decode without a fault unless spoilt."""
    layout = parse(generate.layout_text(3, 10))
    out = None
    for s in generate.STRATEGIES:
        d = generate.generated(spark, layout, 600, seed=5, strategy=s)
        r = records.decode(d, layout, keep=["spoilt"]).where((F.size("_errors") == 0) | F.col("spoilt").isNotNull())
        one = r.agg(F.lit(s).alias("strategy"), F.count("*").cast("int").alias("records"), F.count("spoilt").cast("int").alias("spoilt"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT n_nationkey AS seed, n_nationkey % 9 + 1 AS fields, true AS gapless FROM nation")
def generated_layouts(spark, sf_dir):
    rows = []
    for k in nations(spark, sf_dir):
        layout = parse(generate.layout_text(k, k % 9 + 1))
        top = layout.top()
        rows.append((k, len(top), all(a.offset + a.extent == b.offset for a, b in zip(top, top[1:])) and top[-1].offset + top[-1].extent == layout.lrecl))
    return spark.createDataFrame(rows, "seed int, fields int, gapless boolean")


# --- projection ----------------------------------------------------------------------------------------


@query(f"SELECT c_custkey, c_name AS name, {_BAL} AS cents FROM customer")
def projection_group(spark, sf_dir):
    """A group stands for its parts."""
    layout = parse("01 R.\n 05 K PIC 9(9) COMP.\n 05 G.\n 10 NAME PIC X(25).\n 10 BAL PIC S9(7)V99 COMP-3.")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("K"), F.struct(F.col("c_name").alias("NAME"), cents("c_acctbal").alias("BAL")).alias("G"))
    r = records.decode(records.encode(c, layout, keep=["c_custkey"]), layout, keep=["c_custkey"], select=["g"], mode="off", options=Options(trim=True))
    return r.select("c_custkey", "G.*").select("c_custkey", F.col("NAME").alias("name"), (F.col("BAL") * 100).cast("bigint").alias("cents"))


@query("SELECT event_id, event_type AS kind, 'E-TYPE,E-DATA,E-NUM,E-ALL' AS columns FROM events")
def projection_alias(spark, sf_dir):
    """An alias brings its members."""
    data, layout = event_bytes(spark, sf_dir)
    r = records.decode(data, layout, keep=["event_id"], select=["E-ALL"], mode="off")
    names = ",".join(c for c in r.columns if c not in ("event_id", "IS-BUY"))
    return r.select("event_id", F.rtrim("E-TYPE").alias("kind"), F.lit(names).alias("columns"))


@query("SELECT l_orderkey, count(*) AS n, 'N,LINES' AS columns FROM lineitem GROUP BY 1")
def projection_counter(spark, sf_dir):
    """An array brings its counter."""
    layout = parse(LINES)
    r = records.decode(records.encode(order_lines(spark, sf_dir), layout, keep=["l_orderkey"]), layout, keep=["l_orderkey"], select=["LINES"], mode="off")
    return r.select("l_orderkey", F.size("LINES").cast("bigint").alias("n"), F.lit(",".join(c for c in r.columns if c != "l_orderkey")).alias("columns"))


# --- values --------------------------------------------------------------------------------------------


def decoded(spark, sf_dir, clause: str, raw, options: Options, **more):
    """Customers' made-up bytes in a record of one field."""
    c = table(spark, sf_dir, "customer").select("c_custkey", raw.alias("payload"))
    return records.decode(c, parse(f"01 R.\n 05 V {clause}.", codepage=options.codepage), options=options, keep=["c_custkey"], **more)


def first_code(errors: str = "_errors"):
    return F.coalesce(F.try_element_at(errors, F.lit(1))["code"], F.lit(""))


def _k():
    return F.col("c_custkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'CBKC301' ELSE '' END AS code, CASE WHEN c_custkey % 3 = 0 THEN 'AB' || chr(65533) ELSE 'ABC' END AS replaced, CASE WHEN c_custkey % 3 = 0 THEN 'AB' ELSE 'ABC' END AS skipped FROM customer")
def charset_controls(spark, sf_dir):
    raw = F.when(_k() % 3 == 0, F.lit(b"\xc1\xc2\x01")).otherwise(F.lit(b"\xc1\xc2\xc3"))
    of = lambda policy: decoded(spark, sf_dir, "PIC X(3)", raw, Options(unmappable=policy))
    a, b, c = of("error").select("c_custkey", first_code().alias("code")), of("replace").select("c_custkey", F.col("V").alias("replaced")), of("skip").select("c_custkey", F.col("V").alias("skipped"))
    return a.join(b, "c_custkey").join(c, "c_custkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 123 END AS plain, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'CBKD411' END AS code, 123 AS signed FROM customer")
def ascii_zones(spark, sf_dir):
    """The last byte of an unsigned number must be a plain digit."""
    raw = F.when(_k() % 2 == 0, F.lit(b"123")).otherwise(F.lit(b"12C"))
    a = decoded(spark, sf_dir, "PIC 9(3)", raw, Options("ascii")).select("c_custkey", F.col("V").cast("int").alias("plain"), first_code().alias("code"))
    b = decoded(spark, sf_dir, "PIC S9(3)", raw, Options("ascii")).select("c_custkey", F.col("V").cast("int").alias("signed"))
    return a.join(b, "c_custkey")


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN -123 WHEN 1 THEN -121 END AS v, CASE c_custkey % 4 WHEN 2 THEN 'CBKD414' WHEN 3 THEN 'CBKD414' ELSE '' END AS code, CASE c_custkey % 4 WHEN 0 THEN 'ebcdic' WHEN 1 THEN 'ascii' ELSE '' END AS encoding FROM customer")
def zoned_detection(spark, sf_dir):
    """Numbers in either encoding, mixed ones and ones without zones."""
    k = _k() % 4
    raw = F.when(k == 0, F.lit(b"\xf1\xf2\xd3")).when(k == 1, F.lit(b"12J")).when(k == 2, F.lit(b"1\xf23")).otherwise(F.lit(b"\x01\x02\x03"))
    r = decoded(spark, sf_dir, "PIC S9(3)", raw, Options(detect_zones=True), zone_metadata=True)
    return r.select("c_custkey", F.col("V").cast("int").alias("v"), first_code().alias("code"), F.coalesce(F.try_element_at("_encoding_metadata", F.lit("V")), F.lit("")).alias("encoding"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN -123 WHEN 1 THEN 123 END AS cents, CASE c_custkey % 4 WHEN 2 THEN 'CBKD422' WHEN 3 THEN 'CBKD421' ELSE '' END AS code FROM customer")
def edited_faults(spark, sf_dir):
    k = _k() % 4
    raw = F.when(k == 0, F.lit(b"  1.23-")).when(k == 1, F.lit(b"  1.23 ")).when(k == 2, F.lit(b"  1.23x")).otherwise(F.lit(b"  x.23-"))
    return decoded(spark, sf_dir, "PIC ZZ9.99-", raw, Options("ascii")).select("c_custkey", (F.col("V") * 100).cast("int").alias("cents"), first_code().alias("code"))


@query("SELECT n_nationkey, to_base64(encode(rpad(n_name, 25, ' '))) AS raw, to_base64('\\x00\\x19\\x00\\x00'::blob || encode(rpad(n_name, 25, ' '))) AS framed FROM nation")
def raw_capture(spark, sf_dir):
    """The bytes of records and of fields beside what they say."""
    o = Options("ascii")
    layout = parse("01 R.\n 05 V PIC X(25).", codepage="ascii")
    d = records.encode(table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("V")), layout, options=o, keep=["n_nationkey"])
    d = d.withColumn("header", F.lit(b"\0\x19\0\0"))
    a = records.envelope(d, layout, index="n_nationkey", options=o, raw="field").select(F.get_json_object("value", "$.record_index").cast("int").alias("n_nationkey"), F.get_json_object("value", "$.V_raw_b64").alias("raw"))
    b = records.envelope(d, layout, index="n_nationkey", options=o, raw="record+rdw").select(F.get_json_object("value", "$.record_index").cast("int").alias("n_nationkey"), F.get_json_object("value", "$.raw_b64").alias("framed"))
    return a.join(b, "n_nationkey")


@query(f"SELECT c_custkey, CASE WHEN {_BAL} % 10 = 0 THEN {_BAL} // 10 END AS tenths, CASE WHEN {_BAL} % 10 = 0 THEN '' ELSE 'CBKE505' END AS code FROM customer")
def text_numbers(spark, sf_dir):
    """Numbers from text with one digit after the point at most."""
    text = cents("c_acctbal").cast("string")
    value, error = fields.with_scale(text, 1)
    return table(spark, sf_dir, "customer").select("c_custkey", (value * 10).cast("bigint").alias("tenths"), F.coalesce(error, F.lit("")).alias("code"))


@query("SELECT cast(b AS int) AS byte, b BETWEEN 48 AND 57 OR b IN (123, 125) OR b BETWEEN 65 AND 82 AS ascii, b // 16 IN (12, 13, 15) AND b % 16 <= 9 AS ebcdic FROM (SELECT unnest(range(256)) AS b)")
def overpunch_bytes(spark, sf_dir):
    b = spark.range(256).select(F.col("id").cast("int").alias("byte"), F.unhex(F.lpad(F.hex("id"), 2, "0")).alias("b"))
    return b.select("byte", fields.overpunched(F.col("b"), "ascii").alias("ascii"), fields.overpunched(F.col("b"), "cp037").alias("ebcdic"))


# --- encoding ------------------------------------------------------------------------------------------


_V = "(c_custkey % 5 - 2)"


@query(f"""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN hex('00' || CASE WHEN {_V} < 0 THEN substr('}}JKLMNOPQR', 1 - {_V}, 1) ELSE substr('{{ABCDEFGHI', {_V} + 1, 1) END)
  ELSE 'F0F0' || CASE WHEN {_V} < 0 THEN 'D' WHEN {_V} = 0 THEN 'F' ELSE 'C' END || abs({_V}) END AS h FROM customer""")
def zoned_metadata(spark, sf_dir):
    """Numbers written in the encoding that the record's metadata names; zero keeps its policy."""
    layout = parse("01 R.\n 05 V PIC S9(3).")
    said = F.when(_k() % 3 == 0, F.create_map(F.lit("V"), F.lit("ascii"))).when(_k() % 3 == 1, F.create_map(F.lit("V"), F.lit("ebcdic")))
    c = table(spark, sf_dir, "customer").select("c_custkey", (_k() % 5 - 2).alias("V"), said.alias("said"))
    return records.encode(c, layout, keep=["c_custkey"], zone_metadata="said").select("c_custkey", F.hex("payload").alias("h"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'RAWS' ELSE 'TEXT' END AS t, 'TEXT' AS checked FROM customer")
def raw_replay(spark, sf_dir):
    """Kept bytes are written again, with the descriptor left off; checked: only if they agree."""
    o = Options("ascii")
    layout = parse("01 R.\n 05 V PIC X(4).", codepage="ascii")
    raw = F.when(_k() % 2 == 0, F.base64(F.lit(b"\0\x04\0\0RAWS")))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.lit("TEXT").alias("V"), raw.alias("raw"))
    a = records.encode(c, layout, options=o, keep=["c_custkey"], raw="raw", raw_header=True)
    b = records.encode(c, layout, options=o, keep=["c_custkey"], raw="raw", raw_header=True, verified=True)
    return a.select("c_custkey", F.decode("payload", "UTF-8").alias("t")).join(b.select("c_custkey", F.decode("payload", "UTF-8").alias("checked")), "c_custkey")


@query("SELECT c_custkey, repeat(' ', 8 - strlen(cast(c_custkey AS varchar))) AS pad, cast(c_custkey AS varchar) AS t, 'CBKE501' AS code FROM customer")
def coerced_numbers(spark, sf_dir):
    """A number in a text field: written as text, or refused."""
    o = Options("ascii")
    layout = parse("01 R.\n 05 V PIC X(8).", codepage="ascii")
    c = table(spark, sf_dir, "customer").select("c_custkey", _k().alias("V"))
    a = records.encode(c, layout, options=o, keep=["c_custkey"]).select("c_custkey", F.decode("payload", "UTF-8").alias("x"))
    b = records.encode(c, layout, options=o, keep=["c_custkey"], coerce=False).select("c_custkey", first_code().alias("code"))
    t = F.rtrim("x")
    return a.join(b, "c_custkey").select("c_custkey", F.substring("x", F.length(t) + 1, F.lit(8)).alias("pad"), t.alias("t"), "code")


@query("SELECT l_orderkey, CASE WHEN count(*) > 2 THEN 'CBKE521' ELSE '' END AS code FROM lineitem GROUP BY 1")
def array_bounds(spark, sf_dir):
    """More elements than the declaration allows."""
    layout = parse(LINES.replace("0 TO 50", "0 TO 2"))
    return records.encode(order_lines(spark, sf_dir), layout, keep=["l_orderkey"]).select("l_orderkey", first_code().alias("code"))


@query("SELECT n_nationkey, '0000' || hex(left(n_name, 2)) || '00000000' AS h FROM nation")
def missing_fields(spark, sf_dir):
    """Fields without a column are zero bytes."""
    layout = parse("01 R.\n 05 A PIC 9(4) COMP.\n 05 T PIC X(2).\n 05 Z PIC S9(7) COMP-3.", codepage="ascii")
    d = table(spark, sf_dir, "nation").select("n_nationkey", F.substring("n_name", 1, 2).alias("T"))
    return records.encode(d, layout, options=Options("ascii"), keep=["n_nationkey"]).select("n_nationkey", F.hex("payload").alias("h"))


@query("SELECT c_custkey, array_to_string(list_transform(range(6), lambda i: cast((c_custkey + i) % 10 AS varchar)), '') AS digits FROM customer")
def nested_arrays(spark, sf_dir):
    """An array in the elements of an array."""
    layout = parse("01 R.\n 05 G OCCURS 2 TIMES.\n 10 T PIC X(1).\n 10 B PIC 9 OCCURS 3 TIMES.", codepage="ascii")
    digit = lambda i: ((_k() + i) % 10).cast("string")
    text = F.concat(*[F.concat(F.lit("x"), *[digit(3 * g + i) for i in range(3)]) for g in range(2)])
    c = table(spark, sf_dir, "customer").select("c_custkey", text.cast("binary").alias("payload"))
    r = records.decode(c, layout, options=Options("ascii"), keep=["c_custkey"], mode="drop")
    return r.select("c_custkey", F.array_join(F.transform(F.flatten("G.B"), lambda v: v.cast("int").cast("string")), "").alias("digits"))


@query("SELECT c_custkey, cast(least(3, c_custkey % 5) AS int) AS n, CASE WHEN c_custkey % 5 < 3 THEN 'CBKD301' ELSE '' END AS code FROM customer")
def array_beyond_record(spark, sf_dir):
    """A record that ends before its array does."""
    layout = parse("01 R.\n 05 N PIC 9.\n 05 A PIC X OCCURS 0 TO 9 TIMES DEPENDING ON N.", codepage="ascii")
    raw = F.concat(F.lit("3"), F.repeat(F.lit("x"), (_k() % 5).cast("int"))).cast("binary")
    c = table(spark, sf_dir, "customer").select("c_custkey", raw.alias("payload"))
    r = records.decode(c, layout, options=Options("ascii"), keep=["c_custkey"])
    return r.select("c_custkey", F.size("A").alias("n"), first_code().alias("code"))


# --- checks --------------------------------------------------------------------------------------------


_IDX = "l_orderkey || ':' || l_linenumber"
_ISBAD = "(l_partkey % 97 = 0 OR l_partkey % 89 = 0)"


@query(f"SELECT count(*) AS records_total, count(*) * 6 AS file_size_bytes, count(*) FILTER ({_ISBAD}) AS errors_total, count(*) FILTER ({_ISBAD}) > 10 AS truncated, cast(least(10, count(*) FILTER ({_ISBAD})) AS int) AS errors, 3 AS sample, min({_IDX}) FILTER ({_ISBAD}) AS first_error, min({_IDX}) AS first_sample FROM lineitem")
def verify_summary(spark, sf_dir):
    """The report of a verification, its errors and its sample cut short."""
    layout, d = broken_lines(spark, sf_dir)
    r = integrity.verify_report(d, layout, max_errors=10, sample=3)
    return r.select("records_total", "file_size_bytes", "errors_total", "truncated", F.size("errors").alias("errors"), F.size("sample").alias("sample"), F.col("errors")[0]["index"].alias("first_error"), F.col("sample")[0]["index"].alias("first_sample"))


@query(f"SELECT 'CBKD401' AS code, 'error' AS severity, count(*) AS n FROM lineitem WHERE {_ISBAD}")
def error_classes(spark, sf_dir):
    layout, d = broken_lines(spark, sf_dir)
    return integrity.error_summary(integrity.stop_after(integrity.verify(d, layout).select("code"), 10_000_000))


def broken_orders(spark, sf_dir):
    data, layout = orders_bytes(spark, sf_dir)
    k = F.conv(F.hex(F.substring("payload", 1, 4)), 16, 10).cast("bigint")
    bad = F.concat(F.substring("payload", 1, 15), F.lit(b"\0"), F.substring("payload", 17, 100))
    return layout, data.select(k.alias("record_index"), F.when(k % 97 == 0, bad).otherwise(F.col("payload")).alias("payload"))


@query("SELECT unnest(['decode', 'encode', 'round_trip']) AS mode, unnest([count(*), count(*) FILTER (o_orderkey % 97 <> 0), count(*) FILTER (o_orderkey % 97 <> 0)]) AS records, 0 AS differences FROM orders")
def determinism_report(spark, sf_dir):
    layout, d = broken_orders(spark, sf_dir)
    one = lambda m: integrity.determinism(d, layout, mode=m).select("mode", "records", F.col("differences").cast("int").alias("differences"))
    return one("decode").union(one("encode")).union(one("round_trip"))


@query("SELECT count(*) AS records, count(*) FILTER (o_orderkey % 97 <> 0) AS sound, count(*) FILTER (o_orderkey % 97 <> 0) AS same_bytes, count(*) FILTER (o_orderkey % 97 <> 0) AS same_values, round(count(*) FILTER (o_orderkey % 97 <> 0) / cast(count(*) AS double), 9) AS lossless FROM orders")
def fidelity(spark, sf_dir):
    layout, d = broken_orders(spark, sf_dir)
    return integrity.fidelity(d, layout).select("records", "sound", "same_bytes", "same_values", F.round("lossless", 9).alias("lossless"))


@query("SELECT c_custkey, cast(c_custkey % 5 AS int) AS \"offset\", 'ebcdic' AS kind FROM customer WHERE c_custkey % 7 = 0")
def ebcdic_corruption(spark, sf_dir):
    """Control bytes in text."""
    place = (_k() % 5).cast("int")
    raw = F.concat(F.repeat(F.lit("A"), place).cast("binary"), F.when(_k() % 7 == 0, F.lit(b"\x07")).otherwise(F.lit(b"A")), F.repeat(F.lit("A"), 4 - place).cast("binary"))
    c = table(spark, sf_dir, "customer").select("c_custkey", raw.alias("payload"))
    return integrity.corruption(c, payload="payload", index="c_custkey", ebcdic=[("N", 0, 5)]).select("c_custkey", "offset", "kind")


@query("SELECT cast(s + 1 AS bigint) AS first, cast(e - 1 AS bigint) AS last FROM (SELECT lag(event_id) OVER (ORDER BY event_id) AS s, event_id AS e FROM events WHERE event_id % 50 NOT IN (7, 8)) WHERE e > s + 1")
def sequence_gaps(spark, sf_dir):
    """Records that are missing from a numbered run."""
    e = table(spark, sf_dir, "events").where((~(F.col("event_id") % 50).isin(7, 8))).repartition(7, "value")
    return integrity.gaps(e, "event_id")


@query("SELECT n_nationkey, sha256(n_name) AS sha256, md5(n_name) AS md5 FROM nation")
def file_digests(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").cast("binary").alias("b"))
    return integrity.digest(n, "b", keep=["n_nationkey"])


@query("SELECT event_type AS kind, count(*) AS records, cast(sum(strlen(props)) AS bigint) AS bytes, count(*) FILTER (value <= 0.1) AS quick, count(*) FILTER (value <= 10) AS slow FROM events GROUP BY 1")
def telemetry(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.octet_length("props").alias("size"), "value")
    return audit.telemetry(e, kind="event_type", size="size", seconds="value").select(F.col("event_type").alias("kind"), "records", "bytes", F.col("le_0_1").alias("quick"), F.col("le_10_0").alias("slow"))


# --- audit ---------------------------------------------------------------------------------------------


@query("SELECT user_id, count(*) FILTER (value < 20) AS failures, CASE WHEN count(*) FILTER (value < 20) >= 10 THEN 'critical' WHEN count(*) FILTER (value < 20) >= 5 THEN 'high' WHEN count(*) FILTER (value < 20) >= 3 THEN 'medium' ELSE 'low' END AS level FROM events GROUP BY 1")
def threat_levels(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("value") < 20).alias("failures"))
    return n.withColumn("level", audit.threat_level(F.col("failures")))


@query("SELECT o_orderpriority AS priority, CASE WHEN count(*) >= 300 THEN 'pass' ELSE 'fail' END AS status FROM orders GROUP BY 1")
def slo_status(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))
    return n.select("priority", audit.slo(F.col("n"), 300).alias("status"))


_MONTHS = "SELECT year(o_orderdate) AS y, strftime(o_orderdate, '%m') AS month, count(*) AS v FROM orders GROUP BY 1, 2"


@query(f"""WITH m AS ({_MONTHS}), j AS (SELECT (b.v - a.v) / cast(b.v AS double) AS change FROM m a JOIN m b USING (month) WHERE a.y = 1997 AND b.y = 1996), s AS (SELECT avg(change) AS c, count(*) FILTER (change > 0.05) AS fallen, count(*) AS metrics FROM j)
SELECT round(c, 9) AS mean_change, fallen, metrics, CASE WHEN c < 0.02 THEN 'none' WHEN c < 0.05 THEN 'minor' WHEN c < 0.15 THEN 'major' ELSE 'critical' END AS status FROM s""")
def metric_drift(spark, sf_dir):
    m = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y"), F.date_format("o_orderdate", "MM").alias("month")).agg(F.count("*").alias("v"))
    d = audit.drift(audit.regressions(m.where("y = 1997"), m.where("y = 1996"), metric="month", value="v"))
    return d.select(F.round("mean_change", 9).alias("mean_change"), "fallen", "metrics", "status")


@query("""WITH x AS (SELECT event_type AS g, value AS v FROM events WHERE event_type IN ('click', 'purchase')),
s AS (SELECT avg(v) FILTER (g = 'click') AS m1, avg(v) FILTER (g = 'purchase') AS m2, var_samp(v) FILTER (g = 'click') AS v1, var_samp(v) FILTER (g = 'purchase') AS v2, count(*) FILTER (g = 'click') AS n1, count(*) FILTER (g = 'purchase') AS n2 FROM x),
r AS (SELECT sum(rk) AS r FROM (SELECT g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rk FROM x) WHERE g = 'click')
SELECT round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 6) AS d, round(r - n1 * (n1 + 1) / 2.0, 1) AS u FROM s, r""")
def group_tests(spark, sf_dir):
    """Welch's t, Cohen's d and Mann and Whitney's U of two groups."""
    e = table(spark, sf_dir, "events")
    by = {"group": "event_type", "value": "value", "first": "click", "second": "purchase"}
    parts = [audit.t_statistic(e, **by), audit.effect_size(e, **by), audit.rank_sum(e, **by)]
    one = [p.withColumn("_one", F.lit(1)) for p in parts]
    j = one[0].join(one[1], "_one").join(one[2], "_one")
    return j.select(F.round("t", 6).alias("t"), F.round("d", 6).alias("d"), F.round("u", 1).alias("u"))


@query("SELECT o_orderpriority AS metric, arg_max(v, day) AS v, max(day) AS day FROM (SELECT o_orderpriority, cast(o_orderdate AS date) AS day, cast(round(max(o_totalprice) * 100) AS bigint) AS v FROM orders GROUP BY 1, 2) WHERE day >= date '1997-06-30' - 90 GROUP BY 1")
def baseline_runs(spark, sf_dir):
    """The latest run of each metric within the days that baselines are kept."""
    runs = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("metric"), F.col("o_orderdate").cast("date").alias("day")).agg(F.round(F.max("o_totalprice") * 100).cast("bigint").alias("v"))
    return audit.promoted(runs, metric="metric", value="v", day="day", today="1997-06-30")


@query("SELECT event_id FROM (SELECT event_id, event_type AS s, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b <> s")
def lineage_chain(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("source"), F.col("event_type").alias("target"))
    return audit.broken_lineage(e, sequence="event_id", partition=["user_id"]).select("event_id")


@query("SELECT * FROM (VALUES ('ORDER-RECORD.O-ORDERKEY', 'direct', 1.0), ('ORDER-RECORD.O-CUSTKEY', 'conversion', 0.75), ('ORDER-RECORD.O-STATUS', 'direct', 1.0), ('ORDER-RECORD.O-TOTAL', 'calculation', 0.75)) t(source, transformation, confidence)")
def lineage_fields(spark, sf_dir):
    """Fields of two layouts by position."""
    old = parse(ORDERS).table(spark)
    new = parse("01 ORDER-RECORD. 05 O-ORDERKEY PIC 9(9) COMP. 05 O-CUSTKEY PIC 9(9). 05 O-STATUS PIC X(1). 88 A VALUE 'O'. 88 B VALUE 'F'. 05 O-SUM PIC S9(11)V99 COMP-3.").table(spark)
    leaf = lambda t: t.where(~F.col("kind").isin("group", "condition"))
    return audit.lineage(leaf(old).where("position < 7"), leaf(new)).select("source", "transformation", F.col("confidence").cast("decimal(3,2)").alias("confidence"))


_NOTES = "CASE c_custkey % 3 WHEN 0 THEN 'stores_full_pan' WHEN 1 THEN 'processing_purpose' ELSE 'transmits_cardholder_data' END"


@query(f"""WITH c AS (SELECT c_custkey AS k, {_NOTES} AS note, c_custkey % 2 = 0 AS even, c_custkey % 5 = 0 AS fifth FROM customer), p AS (SELECT * FROM c WHERE note <> 'processing_purpose'), r AS (
SELECT 'SOX-302-001' AS rule, count(*) FILTER (NOT (even AND fifth)) AS n FROM c UNION ALL SELECT 'SOX-404-001', count(*) FILTER (NOT even) FROM c UNION ALL
SELECT 'GDPR-ART5-001', count(*) FILTER (note <> 'processing_purpose') FROM c UNION ALL SELECT 'GDPR-ART25-001', count(*) FROM c UNION ALL
SELECT 'HIPAA-ADMIN-001', count(*) FILTER (NOT fifth) FROM c UNION ALL SELECT 'HIPAA-TECH-001', count(*) FILTER (NOT fifth) FROM c UNION ALL
SELECT 'PCI-3.1-001', count(*) FILTER (note = 'stores_full_pan') FROM p UNION ALL SELECT 'PCI-3.2-001', count(*) FILTER (NOT fifth) FROM p UNION ALL SELECT 'PCI-3.5-001', count(*) FILTER (fifth) FROM p UNION ALL
SELECT 'PCI-4.1-001', count(*) FILTER (note = 'transmits_cardholder_data') FROM p UNION ALL SELECT 'PCI-7.1-001', count(*) FILTER (NOT even) FROM p UNION ALL SELECT 'PCI-8.2-001', count(*) FROM p UNION ALL
SELECT 'PCI-10.1-001', count(*) FROM p UNION ALL SELECT 'PCI-10.5.1-001', count(*) FILTER (NOT even) FROM p)
SELECT rule, n FROM r WHERE n > 0""")
def compliance(spark, sf_dir):
    """Broken rules of four standards, by operation."""
    note = F.when(_k() % 3 == 0, "stores_full_pan").when(_k() % 3 == 1, "processing_purpose").otherwise("transmits_cardholder_data")
    even, fifth = _k() % 2 == 0, _k() % 5 == 0
    context = {
        "integrity_protection": even, "segregation_of_duties": even, "role_based_access": even, "at_rest_encrypted": fifth,
        "classification": F.when(fifth, "material").otherwise("PHI"), "notes": F.create_map(note, F.lit("yes")),
    }
    found = audit.violations(context, ("SOX", "HIPAA", "GDPR", "PCI"))
    return table(spark, sf_dir, "customer").select(F.explode(found).alias("v")).groupBy("v.rule").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS total_events, CASE WHEN count(*) FILTER (event_id % 3 = 0 AND value < 1) > 0 THEN 'Non-Compliant' ELSE 'Compliant' END AS compliance_status, CASE WHEN count(*) FILTER (event_id % 3 = 1 AND value < 1) > 0 THEN 'Issues Detected' ELSE 'Secure' END AS security_status, 'Not Evaluated' AS performance_status FROM events")
def audit_report(spark, sf_dir):
    kind = F.when(F.col("event_id") % 3 == 0, "compliance").when(F.col("event_id") % 3 == 1, "security").otherwise("other")
    e = table(spark, sf_dir, "events").select(kind.alias("kind"), "value")
    return audit.report(e, kind="kind", failed=F.col("value") < 1)


@query("""SELECT n_nationkey AS k, '{"n":' || n_nationkey || ',"name":"<' || n_name || '>"}' AS json, n_nationkey || ',<' || n_name || '>' AS csv, '<row><n>' || n_nationkey || '</n><name>&lt;' || n_name || '&gt;</name></row>' AS xml, '<tr><td>' || n_nationkey || '</td><td>&lt;' || n_name || '&gt;</td></tr>' AS html FROM nation""")
def report_forms(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), F.concat(F.lit("<"), "n_name", F.lit(">")).alias("name"))
    key = F.regexp_extract("value", "([0-9]+)", 1).cast("int").alias("k")
    out = None
    for form in ("json", "csv", "xml", "html"):
        one = audit.formatted(n, form).select(key, F.col("value").alias(form))
        out = one if out is None else out.join(one, "k")
    return out


_NAMES = ["CUST-SSN", "ROUTING-NO", "TAX-ID", "TAXES", "PIN-CODE", "NAME", "Secret-Key", "PHONE"]


@query(f"SELECT c_custkey, n AS field, n IN ('CUST-SSN', 'ROUTING-NO', 'TAX-ID', 'PIN-CODE', 'Secret-Key') AS sensitive FROM (SELECT c_custkey, list_extract({_NAMES}, cast(c_custkey % {len(_NAMES)} + 1 AS int)) AS n FROM customer)")
def sensitive_fields(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (_k() % len(_NAMES) + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", name.alias("field"), audit.sensitive(name).alias("sensitive"))


@query("SELECT event_id, CASE WHEN value < 20 THEN 'failed_access' ELSE '' END || '/' || CASE WHEN user_id % 10 = 3 THEN 'suspicious_address' ELSE '' END AS access, CASE WHEN event_id % 3 = 0 THEN 'weak_cipher,' ELSE '' END || CASE WHEN event_id % 4 = 0 THEN 'old_tls,' ELSE '' END || CASE WHEN event_id % 100 > 90 THEN 'stale_key,' ELSE '' END AS encryption FROM events")
def access_and_encryption(spark, sf_dir):
    ip = F.concat(F.lit("10.0.0."), (F.col("user_id") % 10).cast("string"))
    found = audit.access_findings(F.col("value") >= 20, ip, ["10.0.0.3"])
    has = lambda x: F.when(F.array_contains(found, x), x).otherwise("")
    enc = audit.encryption_findings(F.when(F.col("event_id") % 3 == 0, "AES-128").otherwise("aes-256"), F.when(F.col("event_id") % 4 == 0, 1.1).otherwise(1.2), F.col("event_id") % 100)
    return table(spark, sf_dir, "events").select("event_id", F.concat(has("failed_access"), F.lit("/"), has("suspicious_address")).alias("access"), F.array_join(F.transform(enc, lambda x: F.concat(x, F.lit(","))), "").alias("encryption"))


@query("SELECT event_id, sha256(event_type || coalesce(md5(cast(b AS varchar)), '')) AS hash FROM (SELECT event_id, event_type, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)")
def chain_hashes(spark, sf_dir):
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    e = table(spark, sf_dir, "events").withColumn("p", F.md5(before.cast("string").cast("binary")))
    return e.select("event_id", audit.chain_hash(F.col("event_type"), F.col("p")).alias("hash"))


@query("SELECT event_id, cast(coalesce(sum(strlen(event_type) + 1) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 40 AS bigint) AS file FROM events")
def log_rotation(spark, sf_dir):
    e = audit.rotated(table(spark, sf_dir, "events"), line=F.col("event_type"), order=["event_id"], partition=["user_id"], most=40)
    return e.select("event_id", "file")


@query("""WITH x AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 100 = 0 THEN '' ELSE md5(cast(event_id AS varchar)) END AS hash, md5(cast(lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS varchar)) AS previous, event_id % 70 = 0 AS odd FROM events),
y AS (SELECT *, lag(hash) OVER w AS h, lag(CASE WHEN odd THEN NULL ELSE ts END) OVER w AS t FROM x WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT count(*) AS events, count(*) FILTER (h IS NOT NULL AND h IS DISTINCT FROM previous) AS broken_links, count(*) FILTER (hash = '') AS missing_hashes, count(*) FILTER (NOT odd AND ts < t) AS steps_back, count(*) FILTER (odd) AS unreadable_times, count(*) FILTER (NOT odd AND ts < timestamp '2024-01-10 00:00:00') AS past_retention FROM y""")
def log_health(spark, sf_dir):
    """Links, hashes, times (some can't be read) and retention of a log."""
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    md5 = lambda c: F.md5(c.cast("string").cast("binary"))
    e = table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.when(F.col("event_id") % 70 == 0, "no time").otherwise(F.col("ts").cast("string")).alias("ts"),
        F.when(F.col("event_id") % 100 == 0, "").otherwise(md5(F.col("event_id"))).alias("hash"), md5(before).alias("previous_hash"),
    )
    import datetime

    return audit.health(e, sequence="event_id", ts="ts", partition=["user_id"], oldest=datetime.datetime(2024, 1, 10)).select("events", "broken_links", "missing_hashes", "steps_back", "unreadable_times", "past_retention")


@query("SELECT coalesce(CASE WHEN event_id % 7 <> 0 THEN event_type END, 'bad') AS kind, sum(CASE WHEN event_id % 7 <> 0 AND event_id % 10 = 0 THEN 2 ELSE 1 END)::bigint AS n FROM events GROUP BY 1")
def event_log(spark, sf_dir):
    """A log of JSON lines, some of them arrays and some broken."""
    one = F.to_json(F.struct("event_id", "event_type"))
    line = F.when(F.col("event_id") % 7 == 0, '{"event_id": ').when(F.col("event_id") % 10 == 0, F.concat(F.lit(" ["), one, F.lit(","), one, F.lit("]"))).otherwise(one)
    lines = table(spark, sf_dir, "events").select(F.explode(F.array(line, F.lit(""))).alias("value"))
    e = audit.parse_events(lines, "event_id bigint, event_type string")
    return e.groupBy(F.when(F.col("_bad").isNotNull(), "bad").otherwise(F.col("event_type")).alias("kind")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, 'CEF:0|tapes|audit|1|' || event_type || '|access|' || (user_id % 10) || '|user=' || user_id || ' id=' || event_id AS cef, 'LEEF:2.0|tapes|audit|1|' || event_type || '|user=' || user_id || chr(9) || 'id=' || event_id AS leef,
'<134>1 ' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || ' host app - - - ' || event_type AS syslog, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS line FROM events""")
def log_formats(spark, sf_dir):
    more = {"user": F.col("user_id"), "id": F.col("event_id")}
    e = table(spark, sf_dir, "events")
    line = F.to_json(F.struct("event_id", "event_type"))
    return e.select("event_id", audit.cef("tapes", "audit", "1", F.col("event_type"), F.lit("access"), F.col("user_id") % 10, **more).alias("cef"), audit.leef("tapes", "audit", "1", F.col("event_type"), **more).alias("leef"), audit.syslog(134, F.col("ts"), "host", "app", F.col("event_type")).alias("syslog"), line.alias("line"))


@query("SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS failures FROM events WHERE value < 50 GROUP BY 1, 2 HAVING count(*) >= 2")
def stream_failures(spark, sf_dir):
    """A file stream, run until what is there has been read: failures by user and day."""
    kind = table(spark, sf_dir, "events").schema
    e = spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet*").parquet(sf_dir)
    e = e.withColumn("time", F.col("ts").cast("timestamp"))
    w = streaming.failures_by_window(e, ts="time", user="user_id", failed=F.col("value") < 50, size="1 day", least=2)
    name = f"failures_{uuid.uuid4().hex}"
    run = w.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", folder(spark, "stream")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name).select("user_id", F.col("window.start").cast("timestamp_ntz").alias("day"), "failures")


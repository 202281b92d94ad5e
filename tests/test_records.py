"""Byte vectors, errors, arrays, files and streams."""

import math
import struct
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapedeck.functions import codepages
from tapedeck.functions.fields import Options
from tapedeck.operators import audit, integrity, records
from tapedeck.plans.layout import parse
from tapedeck.sources import frames
from tapedeck.streaming import records as streaming

VECTORS = [
    ("S9(5) COMP-3", "01234C", 1234, None), ("S9(5) COMP-3", "01234D", -1234, None), ("S9(5) COMP-3", "00000D", 0, None),
    ("9(3) COMP-3", "123F", 123, None), ("9(3) COMP-3", "123C", None, "CBKD401"), ("S9(4) COMP-3", "11234C", None, "CBKD401"), ("S9(5) COMP-3", "0A234C", None, "CBKD401"),
    ("S9(3)", "F1F2C3", 123, None), ("S9(3)", "F1F2D3", -123, None), ("S9(3)", "F1F2F3", 123, None), ("S9(3)", "F1F2A3", None, "CBKD411"), ("9(3)", "F1F2C3", None, "CBKD411"),
    ("9(4) COMP", "FFFE", 65534, None), ("S9(4) COMP", "FFFE", -2, None), ("S9(18) COMP", "8000000000000000", -(1 << 63), None), ("9(18) COMP", "8000000000000000", None, "CBKD301"),
    ("S9(5) LEADING SEPARATE", "60F0F0F1F2F3", -123, None), ("S9(5) SIGN TRAILING SEPARATE", "F0F0F1F2F34E", 123, None), ("S9(5) LEADING SEPARATE", "61F0F0F1F2F3", None, "CBKD411"),
    ("9(3) BLANK WHEN ZERO", "404040", 0, "CBKD412"), ("9(3)", "404040", None, "CBKD411"), ("9(3)", "F1F2", None, "CBKD301"),
    ("S9(3)V99 COMP-3", "12345C", Decimal("123.45"), None), ("ZZ9.99-", "40404BF1F2", None, "CBKD301"), ("ZZ9.99-", "4040F14BF2F360", Decimal("-1.23"), None), ("ZZ9.99", "40C1F14BF2F3", None, "CBKD421"),
    ("9(3)", "00F1F2", None, "CBKD411"), ("9(3)", "F1F200", None, "CBKD411"), ("9(3)", "F115F2", None, "CBKD411"), ("S9(3)", "40F1C2", None, "CBKD411"), ("S9(3)", "4EF1C2", None, "CBKD411"),
    ("S9(2) LEADING SEPARATE", "4E01F1", None, "CBKD411"), ("S9(2) LEADING SEPARATE", "4EF140", None, "CBKD411"), ("S9(2) TRAILING SEPARATE", "00F14E", None, "CBKD411"),
    ("9(20)", "F0" * 19 + "F7", 7, None), ("9(20)", "F0" * 19 + "C7", None, "CBKD411"), ("S9(20)", "F0" * 19 + "D7", -7, None), ("S9(20) COMP-3", "0" * 19 + "12D", -12, None), ("S9(20) COMP-3", "0" * 18 + "E12D", None, "CBKD401"),
    ("ZZ9.99-", "4040F14BF2F3F0", None, "CBKD422"), ("ZZ9.99CR", "4040F14BF2F3C3D9", Decimal("-1.23"), None), ("+ZZ9", "604040F1", -1, None), ("+ZZ9", "404040F1", 1, None),
]


def test_vectors(spark):
    for clause, raw, value, code in VECTORS:
        r = records.decode(spark.createDataFrame([(bytearray(bytes.fromhex(raw)),)], "payload binary"), parse(f"01 R. 05 V PIC {clause}.")).first()
        assert (None if r.V is None else Decimal(str(r.V))) == (None if value is None else Decimal(value)), (clause, raw, r)
        assert [e.code for e in r._errors][:1] == ([code] if code else []), (clause, raw, r)


def test_ascii_overpunch(spark):
    for raw, value in ((b"12{", 120), (b"12J", -121), (b"12C", 123), (b"12}", -120), (b"129", 129)):
        r = records.decode(spark.createDataFrame([(bytearray(raw),)], "payload binary"), parse("01 R. 05 V PIC S9(3)."), options=Options("ascii")).first()
        assert r.V == value and not r._errors


def test_lossless_texts(spark):
    layout = parse("01 R. 05 A PIC 9(4). 05 B PIC S9(5) LEADING SEPARATE. 05 C PIC S9(3)V99 COMP-3. 05 Z PIC 9(4).")
    raw = bytes.fromhex("F0F0F4F2" + "60F0F0F1F2F3" + "00123C" + "F0F0F0F0")
    r = records.decode(spark.createDataFrame([(bytearray(raw),)], "payload binary"), layout, lossless=True).first()
    assert (r.A, r.B, r.C, r.Z) == ("0042", "-00123", "1.23", "0")


def test_floats(spark):
    values = [0.0, 1.0, -1.5, 3.140625, 1e300, -2.5e-300, 5e-324, 1.7976931348623157e308, 2.0**-1022]
    layout = parse("01 R. 05 V COMP-2.")
    df = spark.createDataFrame([(v,) for v in values], "V double")
    enc = records.encode(df, layout, keep=["V"]).collect()
    assert [bytes(r.payload) for r in enc] == [struct.pack(">d", r.V) for r in enc]
    back = records.decode(spark.createDataFrame([(bytearray(struct.pack(">d", v)),) for v in values], "payload binary"), layout).collect()
    assert [r.V for r in back] == values
    single = records.decode(spark.createDataFrame([(bytearray(bytes.fromhex("3F800000")),)], "payload binary"), parse("01 R. 05 V COMP-1.")).first()
    ibm = records.decode(spark.createDataFrame([(bytearray(bytes.fromhex("41100000")),)], "payload binary"), parse("01 R. 05 V COMP-1."), options=Options(floats="ibm")).first()
    assert single.V == 1.0 == ibm.V
    for raw, code in ((struct.pack(">d", math.inf), "CBKD432"), (struct.pack(">d", math.nan), "CBKD431")):
        r = records.decode(spark.createDataFrame([(bytearray(raw),)], "payload binary"), layout).first()
        assert r.V is None and r._errors[0].code == code
    o = Options(floats="ibm")
    some = [v for v in values if v == 0 or 1e-70 < abs(v) < 1e70] + [1 / 3, 123456.789, 0.0625, 16.0]
    ibm = records.decode(records.encode(spark.createDataFrame([(v,) for v in some], "V double"), layout, options=o), layout, options=o).collect()
    assert [r.V for r in ibm] == some
    bad = records.encode(spark.createDataFrame([(1e300,)], "V double"), layout, options=o).first()
    assert bad._errors[0].code == "CBKE531"


def test_encode_errors(spark):
    for clause, value, code in (("S9(3) COMP-3", 1234, "CBKE510"), ("9(3) COMP-3", -1, "CBKE501"), ("S9(3)V9 COMP-3", Decimal("1.25"), "CBKE505"), ("9(4) COMP", 70000, "CBKE501"), ("X(3)", "abcd", "CBKE515"), ("X(3)", "日", "CBKC301")):
        kind = "string" if isinstance(value, str) else "decimal(20,2)"
        r = records.encode(spark.createDataFrame([(value if isinstance(value, str) else Decimal(value),)], f"V {kind}"), parse(f"01 R. 05 V PIC {clause}.")).first()
        assert [e.code for e in r._errors] == [code], (clause, r)


def test_separate_signs_cut_and_overflow(spark):
    l = parse("01 R. 05 V PIC S9(2)V9 SIGN TRAILING SEPARATE.")
    r = records.encode(spark.createDataFrame([(Decimal("1.29"),), (Decimal("-1.29"),), (Decimal("123.4"),)], "V decimal(10,2)"), l).collect()
    assert [bytes(x.payload).decode("cp037") for x in r[:2]] == ["012+", "012-"] and [[e.code for e in x._errors] for x in r] == [[], [], ["CBKE530"]]


def test_detected_zones_and_their_metadata(spark):
    l = parse("01 R. 05 A PIC S9(3). 05 B PIC 9(3).")
    rows = [b"\xf1\xf2\xd3" + b"123", b"12J" + b"\xf1\xf2\xf3", b"1\xf23" + b"123", b"\xf1\xf2\xf3" + b"12C", b"\xf1\xc2\xf3" + b"\x00\x00\x00"]
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(rows)], "i int, payload binary")
    o = Options(detect_zones=True)
    r = records.decode(df, l, options=o, keep=["i"], zone_metadata=True).orderBy("i").collect()
    assert [(x.A, x.B) for x in r] == [(-123, 123), (-121, 123), (None, 123), (123, None), (None, None)]
    assert [[e.code for e in x._errors] for x in r] == [[], [], ["CBKD414"], ["CBKD413"], ["CBKD411", "CBKD414"]]
    assert r[0]._encoding_metadata == {"A": "ebcdic", "B": "ascii"} and r[2]._encoding_metadata == {"B": "ascii"}
    good = records.decode(df.where("i < 2"), l, options=o, keep=["i"], zone_metadata=True)
    again = records.encode(good, l, keep=["i"], zone_metadata="_encoding_metadata").orderBy("i").collect()
    assert [bytes(x.payload) for x in again] == rows[:2]
    forced = records.encode(good, l, keep=["i"], zone_metadata="_encoding_metadata", options=Options(zoned_override="ascii")).orderBy("i").collect()
    assert [bytes(x.payload) for x in forced] == [b"12L123", b"12J123"]


@pytest.mark.parametrize("page", ["cp037", "cp273", "cp500", "cp1047", "cp1140"])
def test_code_pages(spark, page):
    chars = codepages.page(page)
    assert len(set(chars)) >= 255
    d = spark.createDataFrame([(bytearray(range(256)),)], "b binary").select(codepages.to_text(F.col("b"), page).alias("t"), codepages.to_text(F.col("b"), page, "replace").alias("r"), codepages.to_text(F.col("b"), page, "skip").alias("s")).first()
    assert d.t.replace(codepages.NUL, "\0") == chars and "�" in d.r and len(d.s) < len(d.t)
    back = spark.createDataFrame([(chars[0x40:],)], "t string").select(codepages.to_bytes(F.col("t"), page).alias("b")).first()
    assert codepages.page(page)[back.b[5]] == chars[0x45]
    assert (codepages.page("cp1140")[0xFF], codepages.page("cp273")[0x59], codepages.page("cp1047")[0xAD]) == ("€", "ß", "[")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(-(10**9) + 1, 10**9 - 1), st.integers(0, 9999), st.text("ABCxyz 019.-", max_size=8), st.lists(st.integers(-99, 99), max_size=3)), min_size=1, max_size=20))
def test_round_trip(spark, rows):
    layout = parse("01 R. 05 P PIC S9(9) COMP-3. 05 Z PIC 9(4). 05 T PIC X(8). 05 S PIC S9(9) SIGN TRAILING SEPARATE. 05 N PIC 9. 05 A PIC S9(2) OCCURS 0 TO 3 DEPENDING ON N.")
    df = spark.createDataFrame([(i, p, z, t, p, len(a), a) for i, (p, z, t, a) in enumerate(rows)], "i int, P long, Z int, T string, S long, N int, A array<int>")
    r = records.decode(records.encode(df, layout, keep=["i"]), layout, keep=["i"], options=Options(trim=True)).orderBy("i").collect()
    assert [(int(x.P), int(x.Z), x["T"], int(x.S), [int(v) for v in x.A]) for x in r] == [(p, z, t.rstrip(), p, a) for p, z, t, a in rows]
    assert not any(x._errors for x in r) and integrity.round_trip(records.encode(df, layout), layout).isEmpty()


def test_arrays_nested_and_faulty(spark):
    layout = parse("01 R. 05 N PIC 9. 05 G OCCURS 1 TO 3 DEPENDING ON N. 10 A PIC X. 10 B PIC 9 OCCURS 2.")
    make = lambda t: spark.createDataFrame([(bytearray(t.encode("cp037")),)], "payload binary")
    r = records.decode(make("2a12b34"), layout).first()
    assert [(g.A, [int(x) for x in g.B]) for g in r.G] == [("a", [1, 2]), ("b", [3, 4])] and not r._errors
    r = records.decode(make("2a12bx4"), layout).first()
    assert [(e.code, e.byte_offset) for e in r._errors] == [("CBKD411", 5)] and r.G[1].B[0] is None
    for text, codes, n in (("9a12b34c56", ["CBKS301"], 3), ("0a12", ["CBKS302"], 1), ("3a12b34", ["CBKD301"], 2)):
        r = records.decode(make(text), layout).first()
        assert [e.code for e in r._errors] == codes and len(r.G) == n
    assert records.decode(make("0"), parse("01 R. 05 N PIC 9. 05 G PIC X OCCURS 1 TO 3 DEPENDING ON N.", dialect="zero")).first().G == []


def test_modes(spark):
    layout = parse("01 R. 05 V PIC 9(2).")
    df = spark.createDataFrame([(bytearray(b"\xf1\xf2"),), (bytearray(b"\xc1\xc2"),), (None,)], "payload binary")
    assert records.decode(df, layout, mode="drop").count() == 1
    with pytest.raises(Exception, match="CBKD"):
        records.decode(df, layout, mode="fail").collect()
    s = integrity.summary(df, layout).first()
    assert (s.records, s.records_with_errors) == (3, 2)


def test_one_view_is_written(spark):
    layout = parse("01 R. 05 A PIC X(4). 05 B REDEFINES A PIC 9(2).")
    df = spark.createDataFrame([("abcd", None), (None, 12), ("abcd", 12), (None, None)], "A string, B int")
    r = records.encode(df, layout).collect()
    assert [bytes(x.payload) for x in r[:2]] == ["abcd".encode("cp037"), b"\xf1\xf2\0\0"] and bytes(r[3].payload) == b"\0" * 4
    assert [e.code for e in r[2]._errors] == ["CBKE501"] and not r[0]._errors


def test_files(spark, tmp_path):
    (tmp_path / "fixed.bin").write_bytes(b"aaaabbbbcccc")
    assert [bytes(r.payload) for r in frames.read_fixed(spark, str(tmp_path / "fixed.bin"), 4).collect()] == [b"aaaa", b"bbbb", b"cccc"]
    i = frames.read_fixed_indexed(spark, str(tmp_path / "fixed.bin"), 4).orderBy("record_index").collect()
    assert [(r.record_index, bytes(r.payload)) for r in i] == [(1, b"aaaa"), (2, b"bbbb"), (3, b"cccc")]
    (tmp_path / "bad.bin").write_bytes(b"aaaab")
    with pytest.raises(Exception, match="CBKF221"):
        frames.read_fixed(spark, str(tmp_path / "bad.bin"), 4)
    rdw = bytes.fromhex("00040000") + b"TEST" + bytes.fromhex("00000000") + bytes.fromhex("00020001") + b"ab"
    (tmp_path / "v.rdw").write_bytes(rdw)
    got = frames.read_rdw(spark, str(tmp_path / "v.rdw")).orderBy("record_index").collect()
    assert [(bytes(r.payload), r.error) for r in got] == [(b"TEST", None), (b"", None), (b"ab", "CBKR211")]
    (tmp_path / "t.rdw").write_bytes(b"1234abc")
    assert frames.read_rdw(spark, str(tmp_path / "t.rdw")).first().error == "CBKF104"  # before the payload is looked at
    with pytest.raises(Exception, match="CBKR211"):  # strict: reserved bytes come first ("34")
        frames.read_rdw(spark, str(tmp_path / "t.rdw"), strict=True).collect()
    (tmp_path / "u.rdw").write_bytes(bytes.fromhex("00090000") + b"abc")
    assert frames.read_rdw(spark, str(tmp_path / "u.rdw")).first().error == "CBKF102"
    (tmp_path / "w.rdw").write_bytes(bytes.fromhex("00010000") + b"a" + b"\0\1")
    assert frames.read_rdw(spark, str(tmp_path / "w.rdw")).count() == 1
    with pytest.raises(Exception, match="CBKF221"):
        frames.read_rdw(spark, str(tmp_path / "w.rdw"), strict=True).collect()
    assert [tuple(r) for r in frames.read_rdw(spark, str(tmp_path / "v.rdw"), whole=True).collect()] == [tuple(r) for r in frames.read_rdw(spark, str(tmp_path / "v.rdw")).collect()]
    df = spark.createDataFrame([(bytearray(b"x" * n),) for n in (3, 0, 5)], "payload binary").coalesce(1)
    frames.write_bytes(df.select(frames.rdw_of(F.col("payload")).alias("b")), "b", f"file://{tmp_path}/out")
    assert sorted(len(r.payload) for r in frames.read_rdw(spark, f"{tmp_path}/out").collect()) == [0, 3, 5]
    frames.write_bytes(df.select(frames.fixed_of(F.col("payload"), 5).alias("b")), "b", f"file://{tmp_path}/fixed_out")
    assert frames.read_fixed(spark, f"{tmp_path}/fixed_out", 5).count() == 3


def test_a_large_fixed_file_is_read_by_many_tasks(spark, tmp_path):
    n, lrecl = 400_000, 40
    (tmp_path / "a.bin").write_bytes(b"".join(b"%040d" % i for i in range(1, n + 1)))
    (tmp_path / "b.bin").write_bytes(b"%040d" % 7)
    spark.sparkContext._jsc.hadoopConfiguration().set("mapreduce.input.fileinputformat.split.maxsize", str(1 << 20))
    try:
        got = frames.read_fixed_indexed(spark, str(tmp_path), lrecl)
        assert got.rdd.getNumPartitions() > 8
        one = got.where(F.col("path").endswith("a.bin")).select("record_index", F.decode("payload", "UTF-8").cast("bigint").alias("v"))
        r = one.agg(F.count("*"), F.count_distinct("record_index"), F.min("record_index"), F.max("record_index"), F.count_if(F.col("record_index") != F.col("v"))).first()
        assert tuple(r) == (n, n, 1, n, 0) and got.count() == n + 1
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset("mapreduce.input.fileinputformat.split.maxsize")


def test_an_rdw_file_is_a_stream_of_bounded_batches(tmp_path):
    record = struct.pack(">HH", 60_000, 0) + b"x" * 60_000

    class Endless:
        left = 2000  # 120 MB

        def read(self, n):
            if not self.left:
                return b""
            if n == 4:
                return record[:4]
            self.left -= 1
            return record[4 : 4 + n]

    sizes = [b.nbytes for b in frames._batches(Endless(), False)]
    assert len(sizes) > 10 and max(sizes) < 2 * frames.CHUNK


def test_json_round_trip(spark):
    layout = parse("01 R. 05 A PIC 9(3). 05 B PIC X(2).")
    data = records.encode(spark.createDataFrame([(7, "xy")], "A int, B string"), layout).withColumn("record_index", F.lit(1))
    line = records.envelope(data, layout, raw="record").select("value")
    assert '"A":"007"' in line.first().value and '"schema"' in line.first().value and '"raw_b64"' in line.first().value
    back = records.from_json(line.union(spark.createDataFrame([(" ",), ('{"A":"5","B":"q"}',)], "value string")), layout, "A string, B string")
    assert sorted((r.A, r.B) for r in back.collect()) == [("007", "xy"), ("5", "q")]


def test_stream(spark, tmp_path):
    layout = parse("01 R. 05 A PIC 9(3).")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.bin").write_bytes("001002xyz".encode("cp037"))
    s = streaming.decode_stream(streaming.fixed_stream(spark, str(tmp_path / "in"), 3), layout, keep=["record_index"])
    q = s.writeStream.format("memory").queryName("decoded").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.record_index, int(r.A)) for r in spark.sql("select * from decoded").collect()) == [(1, 1), (2, 2)]


def test_audit_rules(spark):
    d = spark.createDataFrame([("AES-128", 1.1, 120, False, "1.2.3.4"), ("AES-256", 1.3, 30, True, "9.9.9.9")], "c string, t double, r int, ok boolean, ip string")
    r = d.select(audit.encryption_findings(F.col("c"), F.col("t"), F.col("r")).alias("e"), audit.access_findings(F.col("ok"), F.col("ip"), ["9.9.9.9"]).alias("a"), audit.violations({"segregation_of_duties": F.col("ok"), "at_rest_encrypted": F.lit(True)}).alias("v"), audit.sensitive(F.lit("R.CARD-NO")).alias("s")).collect()
    assert r[0].e == ["weak_cipher", "old_tls", "stale_key"] and r[1].e == [] and r[0].a == ["failed_access"] and r[1].a == ["suspicious_address"]
    assert [x.rule for x in r[0].v] == ["SOX-302-001", "SOX-404-001"] and [x.rule for x in r[1].v] == ["SOX-302-001"] and r[0].s
    a, b = parse("01 R. 05 A PIC X. 05 B PIC 9."), parse("01 R. 05 A PIC 9. 05 B PIC 9.")
    l = {x.source: (x.transformation, x.confidence) for x in audit.lineage(a.table(spark), b.table(spark)).collect()}
    assert l["R.A"] == ("conversion", 0.75) and l["R.B"] == ("direct", 1.0)


def test_unmappable_bytes_of_each_page(spark):
    """A byte is unmappable if its character is a control other than tab, LF and CR; NUL is one."""
    rows = spark.createDataFrame([(i, bytes([0xC1, i])) for i in range(256)], "i int, b binary")
    for name in codepages.PAGES:
        if name == "ascii":
            continue
        want = {i for i, c in enumerate(codepages.page(name)) if ord(c) < 0x20 and c not in "\t\n\r"}
        got = {r.i for r in rows.where(codepages.unmappable(F.col("b"), name)).collect()}
        assert got == want and 0 in got
        kept = {r.i for r in rows.where(F.length(codepages.to_text(F.col("b"), name, "skip")) == 1).collect()}
        assert kept == want

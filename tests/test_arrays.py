"""Arrays: their elements have codecs of their own, which must agree with those of single fields."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tapedeck import queries
from tapedeck.functions.fields import Options
from tapedeck.operators import records
from tapedeck.plans.layout import parse
from tests.test_records import VECTORS

CLAUSES = ["9(3)", "S9(3)", "S9(3)V99", "9(2)V9(3)", "SV99", "S9(4)V99 COMP-3", "9(3) COMP-3", "S9(3) COMP-3", "9(3) BLANK WHEN ZERO", "S9(3) SIGN TRAILING SEPARATE"]
NUMBERS = ["0", "1", "-1", "9.5", "0.05", "-0.05", "12.34", "99.99", "999", "-999", "1000", "-1000", "9999.99", "-10000", "123456789"]


@pytest.mark.parametrize("kind", ["int", "bigint", "smallint", "decimal(20,2)", "decimal(5,2)", "decimal(3,1)", "decimal(12,3)", "decimal(20,0)", "double"])
@pytest.mark.parametrize("page", ["cp037", "ascii"])
def test_elements_are_encoded_as_single_fields(spark, kind, page):
    df = spark.createDataFrame([(x,) for x in [*NUMBERS, None]], "x string").select("x", F.expr(f"try_cast(cast(x AS decimal(20,3)) AS {kind})").alias("V"))
    df = df.select("x", "V", F.array("V", "V").alias("A"), F.array(F.struct(F.col("V").alias("B"))).alias("G"))
    for clause in CLAUSES:
        if page == "ascii" and "COMP" in clause:
            continue
        layout = parse(f"01 R. 05 V PIC {clause}. 05 A PIC {clause} OCCURS 2. 05 G OCCURS 1. 10 B PIC {clause}.", codepage=page)
        for o in (Options(page), Options(page, zoned_override="ebcdic")):
            for r in records.encode(df, layout, options=o, keep=["x"]).collect():
                size = len(r.payload) // 4
                assert r.payload == r.payload[:size] * 4, (clause, kind, r)


def test_elements_are_decoded_as_single_fields(spark):
    for clause, raw, value, code in VECTORS:
        size = parse(f"01 R. 05 V PIC {clause}.").lrecl
        if 2 * size != len(raw):
            continue
        df = spark.createDataFrame([(bytearray(bytes.fromhex("40" + raw)),)], "payload binary")
        r = records.decode(df, parse(f"01 R. 05 H PIC X. 05 A PIC {clause} OCCURS 1 TIMES.")).first()
        assert (None if r.A[0] is None else Decimal(str(r.A[0]))) == (None if value is None else Decimal(value)), (clause, raw, r)
        assert [(e.code, e.byte_offset) for e in r._errors][:1] == ([(code, 1)] if code else []), (clause, raw, r)


def test_a_null_record_has_no_elements(spark):
    df = spark.createDataFrame([(None,)], "payload binary")
    assert records.decode(df, parse("01 R. 05 N PIC 9. 05 A PIC 9 OCCURS 0 TO 3 DEPENDING ON N.")).first().A == []


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_f1_elements_are_decoded_once_for_value_and_faults(spark, sf_dir):
    assert "forall(transform(" not in plan(queries.odo_clamp(spark, sf_dir))


def test_f2_no_filter_decodes_a_second_time(spark, sf_dir):
    for name in ("odo_tail", "occurs_fixed", "occurs_group"):
        assert "Filter (size(" not in plan(queries.QUERIES[name](spark, sf_dir)), name


def test_elements_leave_out_empty_and_null_arrays(spark):
    df = spark.createDataFrame([(1, [5, 6]), (2, []), (3, None)], "i int, a array<int>")
    assert [tuple(r) for r in records.elements(df, "a", "x", keep=["i"]).collect()] == [(1, 5), (1, 6)]

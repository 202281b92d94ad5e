"""The engine's own queries: tables are encoded to bytes, and the bytes decoded and queried.

Money columns are doubles: both sides take round(x * 100) as the digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import codepages
from .functions.fields import Options
from .operators import audit, integrity, records
from .plans.layout import parse
from .sources import frames

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(column: str):
    """round(x * 100) / 100 as an exact decimal."""
    return (F.round(F.col(column) * 100).cast("bigint").cast("decimal(20,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(20,2)")


ORDERS = """
01 ORDER-RECORD.
   05 O-ORDERKEY PIC 9(9) COMP.
   05 O-CUSTKEY  PIC 9(9) COMP.
   05 O-STATUS   PIC X(1).
      88 IS-OPEN VALUE 'O'.
      88 IS-DONE VALUE 'F' THRU 'F'.
   05 O-TOTAL    PIC S9(11)V99 COMP-3.
   05 O-DATE     PIC 9(8).
   05 O-PRIORITY PIC X(15).
"""


def orders_bytes(spark, sf_dir) -> tuple[DataFrame, object]:
    layout = parse(ORDERS)
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("O-ORDERKEY"), F.col("o_custkey").alias("O-CUSTKEY"), F.col("o_orderstatus").alias("O-STATUS"),
        cents("o_totalprice").alias("O-TOTAL"), F.date_format("o_orderdate", "yyyyMMdd").cast("bigint").alias("O-DATE"), F.col("o_orderpriority").alias("O-PRIORITY"),
    )
    return records.encode(o, layout), layout


@query("SELECT o_orderstatus AS status, count(*) AS n, cast(sum(cast(round(o_totalprice * 100) AS bigint)) AS bigint) AS total_cents, cast(min(strftime(o_orderdate, '%Y%m%d')) AS bigint) AS first_day FROM orders GROUP BY 1")
def orders_by_status(spark, sf_dir):
    """The flagship: encode, decode, aggregate."""
    data, layout = orders_bytes(spark, sf_dir)
    d = records.decode(data, layout, mode="drop", select=["O-STATUS", "O-TOTAL", "O-DATE"])
    return d.groupBy(F.col("O-STATUS").alias("status")).agg(F.count("*").alias("n"), (F.sum("O-TOTAL") * 100).cast("bigint").alias("total_cents"), F.min("O-DATE").cast("bigint").alias("first_day"))


def one_field(spark, sf_dir, name, clause, value, key, options=None):
    """(layout, frame of key and payload) of a table's column in a record of one field."""
    layout = parse(f"01 R.\n 05 V {clause}.", codepage=(options or Options()).codepage)
    d = table(spark, sf_dir, name).select(*[F.col(k) for k in key], value.alias("V"))
    return layout, records.encode(d, layout, options=options, keep=key)


def hexes(spark, sf_dir, name, clause, value, key, options=None):
    _, d = one_field(spark, sf_dir, name, clause, value, key, options)
    return d.select(*key, F.hex("payload").alias("h"))


def again(spark, sf_dir, name, clause, value, key, options=None):
    layout, d = one_field(spark, sf_dir, name, clause, value, key, options)
    return records.decode(d, layout, options=options, keep=key)


_C = "cast(round(c_acctbal * 100) AS bigint)"
_D = f"lpad(cast(abs({_C}) AS varchar), 9, '0')"


@query("SELECT l_orderkey, l_linenumber, lpad(cast(cast(round(l_extendedprice * 100) AS bigint) AS varchar), 11, '0') || 'C' AS h FROM lineitem")
def comp3_encode_hex(spark, sf_dir):
    return hexes(spark, sf_dir, "lineitem", "PIC S9(9)V99 COMP-3", cents("l_extendedprice"), ["l_orderkey", "l_linenumber"])


@query("SELECT l_returnflag, cast(sum(cast(round(l_extendedprice * 100) AS bigint)) AS bigint) AS cents, count(*) AS n FROM lineitem GROUP BY 1")
def comp3_roundtrip(spark, sf_dir):
    d = again(spark, sf_dir, "lineitem", "PIC S9(9)V99 COMP-3", cents("l_extendedprice"), ["l_returnflag"]).where(F.size("_errors") == 0)
    return d.groupBy("l_returnflag").agg((F.sum("V") * 100).cast("bigint").alias("cents"), F.count("*").alias("n"))


@query(f"SELECT c_custkey, regexp_replace(left({_D}, 8), '(.)', 'F\\1', 'g') || CASE WHEN {_C} < 0 THEN 'D' WHEN {_C} = 0 THEN 'F' ELSE 'C' END || right({_D}, 1) AS h FROM customer")
def zoned_ebcdic_signed(spark, sf_dir):
    return hexes(spark, sf_dir, "customer", "PIC S9(7)V99", cents("c_acctbal"), ["c_custkey"])


_OVER = "CASE WHEN {c} < 0 THEN translate(right({d}, 1), '0123456789', '}}JKLMNOPQR') ELSE translate(right({d}, 1), '0123456789', '{{ABCDEFGHI') END".format(c=_C, d=_D)


@query(f"SELECT c_custkey, left({_D}, 8) || {_OVER} AS t, {_C} AS cents FROM customer")
def zoned_ascii_overpunch(spark, sf_dir):
    o = Options("ascii")
    layout, d = one_field(spark, sf_dir, "customer", "PIC S9(7)V99", cents("c_acctbal"), ["c_custkey"], o)
    r = records.decode(d, layout, options=o, keep=["c_custkey", "payload"])
    return r.select("c_custkey", F.decode("payload", "UTF-8").alias("t"), (F.col("V") * 100).cast("bigint").alias("cents"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '40404040' ELSE regexp_replace(lpad(cast(c_custkey % 3 AS varchar), 4, '0'), '(.)', 'F\\1', 'g') END AS h, cast(c_custkey % 3 AS bigint) AS v, CASE WHEN c_custkey % 3 = 0 THEN 'CBKD412' ELSE '' END AS warning FROM customer")
def zoned_bwz(spark, sf_dir):
    layout, d = one_field(spark, sf_dir, "customer", "PIC 9(4) BLANK WHEN ZERO", F.col("c_custkey") % 3, ["c_custkey"])
    r = records.decode(d, layout, keep=["c_custkey", "payload"])
    return r.select("c_custkey", F.hex("payload").alias("h"), F.col("V").cast("bigint").alias("v"), F.coalesce(F.try_element_at("_errors", F.lit(1))["code"], F.lit("")).alias("warning"))


@query("SELECT o_orderkey, lower(printf('%08x', o_orderkey % 2147483648)) || lower(printf('%016x', o_custkey)) AS h, o_orderkey % 2147483648 AS k, o_custkey AS c, -(o_orderkey % 30000) AS s FROM orders")
def binary_int_roundtrip(spark, sf_dir):
    layout = parse("01 R.\n 05 K PIC 9(9) COMP.\n 05 C PIC S9(18) COMP.\n 05 S PIC S9(4) COMP.")
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % (1 << 31)).alias("K"), F.col("o_custkey").alias("C"), (-(F.col("o_orderkey") % 30000)).alias("S"))
    r = records.decode(records.encode(o, layout, keep=["o_orderkey"]), layout, keep=["o_orderkey", "payload"])
    return r.select("o_orderkey", F.lower(F.hex(F.substring("payload", 1, 12))).alias("h"), F.col("K").cast("bigint").alias("k"), F.col("C").alias("c"), F.col("S").cast("bigint").alias("s"))


_S = "cast(round(s_acctbal * 100) AS bigint)"
_SD = f"lpad(cast(abs({_S}) AS varchar), 9, '0')"


@query(f"SELECT s_suppkey, CASE WHEN {_S} < 0 THEN '60' ELSE '4E' END || regexp_replace({_SD}, '(.)', 'F\\1', 'g') AS h, {_S} AS cents FROM supplier")
def sign_separate_leading(spark, sf_dir):
    layout, d = one_field(spark, sf_dir, "supplier", "PIC S9(7)V99 SIGN IS LEADING SEPARATE", cents("s_acctbal"), ["s_suppkey"])
    return records.decode(d, layout, keep=["s_suppkey", "payload"]).select("s_suppkey", F.hex("payload").alias("h"), (F.col("V") * 100).cast("bigint").alias("cents"))


@query(f"SELECT s_suppkey, {_SD} || CASE WHEN {_S} < 0 THEN '-' ELSE '+' END AS t, {_S} AS cents FROM supplier")
def sign_separate_trailing(spark, sf_dir):
    o = Options("ascii")
    layout, d = one_field(spark, sf_dir, "supplier", "PIC S9(7)V99 SIGN TRAILING SEPARATE", cents("s_acctbal"), ["s_suppkey"], o)
    return records.decode(d, layout, options=o, keep=["s_suppkey", "payload"]).select("s_suppkey", F.decode("payload", "UTF-8").alias("t"), (F.col("V") * 100).cast("bigint").alias("cents"))


def _charset(page: str):
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789 #-_."
    codes = [f"{codepages.page(page).index(c):02X}" for c in chars]
    sql = f"""SELECT n_nationkey, rpad(array_to_string(list_transform(string_split(n_name, ''), lambda c: list_extract({codes}, cast(strpos('{chars}', c) AS int))), ''), 50, '40') AS h, n_name AS name FROM nation"""

    def run(spark, sf_dir):
        o = Options(page, trim=True)
        layout, d = one_field(spark, sf_dir, "nation", "PIC X(25)", F.col("n_name"), ["n_nationkey"], o)
        return records.decode(d, layout, options=o, keep=["n_nationkey", "payload"]).select("n_nationkey", F.hex("payload").alias("h"), F.col("V").alias("name"))

    run.__name__ = f"charset_{page}"
    query(sql)(run)


for _page in ("cp037", "cp273", "cp500", "cp1047", "cp1140"):
    _charset(_page)


@query("SELECT vec_id, cast(embedding[1] AS float) AS v, cast(embedding[2] AS double) AS w FROM embeddings")
def float_ieee(spark, sf_dir):
    layout = parse("01 R.\n 05 V COMP-1.\n 05 W COMP-2.")
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].alias("V"), F.col("embedding")[1].cast("double").alias("W"))
    return records.decode(records.encode(e, layout, keep=["vec_id"]), layout, keep=["vec_id"], mode="drop").select("vec_id", F.col("V").alias("v"), F.col("W").alias("w"))


@query("SELECT p_partkey, p_retailprice AS w, cast(p_size AS double) AS v FROM part")
def float_ibm_hex(spark, sf_dir):
    o = Options(floats="ibm")
    layout = parse("01 R.\n 05 V COMP-1.\n 05 W COMP-2.")
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("float").alias("V"), F.col("p_retailprice").alias("W"))
    return records.decode(records.encode(p, layout, options=o, keep=["p_partkey"]), layout, options=o, keep=["p_partkey"], mode="drop").select("p_partkey", F.col("W").alias("w"), F.col("V").cast("double").alias("v"))


_T = "lpad(cast(cast(round(o_totalprice * 100) AS bigint) AS varchar), 11, '0')"


@query(f"SELECT o_orderkey, '$' || left({_T}, 3) || ',' || substr({_T}, 4, 3) || ',' || substr({_T}, 7, 3) || '.' || right({_T}, 2) AS t, cast(round(o_totalprice * 100) AS bigint) AS cents FROM orders")
def edited_pic_currency(spark, sf_dir):
    o = Options("ascii")
    layout, d = one_field(spark, sf_dir, "orders", "PIC $ZZZ,ZZZ,ZZ9.99", cents("o_totalprice"), ["o_orderkey"], o)
    return records.decode(d, layout, options=o, keep=["o_orderkey", "payload"]).select("o_orderkey", F.decode("payload", "UTF-8").alias("t"), (F.col("V") * 100).cast("bigint").alias("cents"))


@query(f"SELECT c_custkey, left({_D}, 7) || '.' || right({_D}, 2) || CASE WHEN {_C} < 0 THEN 'CR' ELSE '  ' END AS t, {_C} AS cents FROM customer")
def edited_pic_crdb(spark, sf_dir):
    o = Options("ascii")
    layout, d = one_field(spark, sf_dir, "customer", "PIC Z(6)9.99CR", cents("c_acctbal"), ["c_custkey"], o)
    return records.decode(d, layout, options=o, keep=["c_custkey", "payload"]).select("c_custkey", F.decode("payload", "UTF-8").alias("t"), (F.col("V") * 100).cast("bigint").alias("cents"))


LINES = """
01 R.
   05 K PIC 9(9) COMP.
   05 N PIC 9(3).
   05 LINES OCCURS 0 TO 50 TIMES DEPENDING ON N.
      10 LN PIC 9(2).
      10 P  PIC S9(9)V99 COMP-3.
"""


def order_lines(spark, sf_dir):
    """Orders with their lines as arrays: a group has as many rows as an order has lines."""
    one = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(F.col("l_linenumber").cast("int").alias("LN"), cents("l_extendedprice").alias("P")).alias("line"))
    # Dealt out first: an order's lines lie apart, so lists made before would have one line each.
    g = one.repartition("l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("line")).alias("LINES"))
    return g.select(F.col("l_orderkey"), (F.col("l_orderkey") % 1_000_000_000).alias("K"), F.size("LINES").alias("N"), "LINES")


@query("SELECT l_orderkey, cast(l_linenumber AS bigint) AS line, cast(round(l_extendedprice * 100) AS bigint) AS cents FROM lineitem")
def odo_tail(spark, sf_dir):
    layout = parse(LINES)
    r = records.decode(records.encode(order_lines(spark, sf_dir), layout, keep=["l_orderkey"]), layout, keep=["l_orderkey"])
    x = records.elements(r, "LINES", "l", keep=["l_orderkey"])
    return x.select("l_orderkey", F.col("l.LN").cast("bigint").alias("line"), (F.col("l.P") * 100).cast("bigint").alias("cents"))


@query("SELECT l_orderkey, least(count(*), 2) AS kept, CASE WHEN count(*) > 2 THEN 'CBKS301' ELSE '' END AS code FROM lineitem GROUP BY 1")
def odo_clamp(spark, sf_dir):
    wide, narrow = parse(LINES), parse(LINES.replace("0 TO 50", "0 TO 2"))
    r = records.decode(records.encode(order_lines(spark, sf_dir), wide, keep=["l_orderkey"]), narrow, keep=["l_orderkey"])
    return r.select("l_orderkey", F.size("LINES").cast("bigint").alias("kept"), F.coalesce(F.try_element_at("_errors", F.lit(1))["code"], F.lit("")).alias("code"))


@query("SELECT l_orderkey, array_to_string(list_transform(range(1, 4), lambda i: coalesce(list_extract(list(cast(cast(l_quantity AS int) AS varchar) ORDER BY l_linenumber, cast(l_quantity AS int)), i), '0')), ',') AS quantities FROM lineitem GROUP BY 1")
def occurs_fixed(spark, sf_dir):
    layout = parse("01 R.\n 05 Q PIC 9(5) OCCURS 3 TIMES.")
    one = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q")))).alias("x"))
    q = one.select("l_orderkey", F.transform(F.array(*[F.lit(i) for i in range(3)]), lambda i: F.coalesce(F.get(F.col("x")["q"], i), F.lit(0))).alias("Q"))
    r = records.decode(records.encode(q, layout, keep=["l_orderkey"]), layout, keep=["l_orderkey"], mode="drop")
    return r.select("l_orderkey", F.array_join(F.transform("Q", lambda v: v.cast("int").cast("string")), ",").alias("quantities"))


@query("SELECT l_orderkey, cast(sum(CASE WHEN r <= 2 THEN cents * r END) AS bigint) AS weighted FROM (SELECT l_orderkey, cast(round(l_extendedprice * 100) AS bigint) AS cents, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) AS r FROM lineitem) GROUP BY 1")
def occurs_group(spark, sf_dir):
    """Parts of a group array lie relative to their own element."""
    layout = parse("01 R.\n 05 H PIC X(2).\n 05 L OCCURS 2 TIMES.\n 10 LN PIC 9(2).\n 10 P PIC S9(9)V99 COMP-3.")
    o = order_lines(spark, sf_dir).select("l_orderkey", F.lit("H").alias("H"), F.slice("LINES", 1, 2).alias("L"))
    padded = o.withColumn("L", F.transform(F.array(F.lit(0), F.lit(1)), lambda i: F.coalesce(F.get("L", i), F.struct(F.lit(0).alias("LN"), F.lit(0).cast("decimal(20,2)").alias("P")))))
    r = records.decode(records.encode(padded, layout, keep=["l_orderkey"]), layout, keep=["l_orderkey"], mode="drop")
    return r.select("l_orderkey", ((F.col("L")[0]["P"] + F.col("L")[1]["P"] * 2) * 100).cast("bigint").alias("weighted"))


EVENTS = """
01 R.
   05 E-TYPE PIC X(12).
      88 IS-BUY VALUE 'purchase' 'buy'.
   05 E-DATA PIC X(20).
   05 E-NUM REDEFINES E-DATA.
      10 E-VALUE PIC S9(9)V9(4) SIGN LEADING SEPARATE.
      10 FILLER PIC X(6).
   66 E-ALL RENAMES E-TYPE THRU E-DATA.
"""


def event_bytes(spark, sf_dir):
    layout = parse(EVENTS, deep_aliases=True)
    v = (F.round(F.col("value") * 10000).cast("bigint").cast("decimal(20,0)") * F.lit("0.0001").cast("decimal(5,4)")).cast("decimal(20,4)")
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("E-TYPE"), F.lit(None).cast("string").alias("E-DATA"), F.struct(v.alias("E-VALUE")).alias("E-NUM"))
    return records.encode(e, layout, keep=["event_id"]), layout


@query("SELECT event_id, cast(round(value * 10000) AS bigint) AS v, event_type IN ('purchase', 'buy') AS is_buy, rpad(event_type, 12, ' ') AS head FROM events")
def redefines_views(spark, sf_dir):
    data, layout = event_bytes(spark, sf_dir)
    r = records.decode(data, layout, keep=["event_id"])
    return r.select("event_id", (F.col("E-NUM")["E-VALUE"] * 10000).cast("bigint").alias("v"), F.col("IS-BUY").alias("is_buy"), F.substring("E-ALL", 1, 12).alias("head"))


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('purchase', 'buy') GROUP BY 1")
def level88_predicate(spark, sf_dir):
    data, layout = event_bytes(spark, sf_dir)
    r = records.decode(data, layout, select=["E-TYPE"], mode="off").where(F.col("IS-BUY"))
    return r.groupBy(F.rtrim("E-TYPE").alias("event_type")).agg(F.count("*").alias("n"))


@query("SELECT event_id, rpad(event_type, 12, ' ') || CASE WHEN value < 0 THEN '-' ELSE '+' END || lpad(cast(abs(cast(round(value * 10000) AS bigint)) AS varchar), 13, '0') AS head FROM events")
def renames_alias(spark, sf_dir):
    data, layout = event_bytes(spark, sf_dir)
    return records.decode(data, layout, keep=["event_id"], mode="off").select("event_id", F.substring("E-ALL", 1, 26).alias("head"))


@query("SELECT c_custkey, c_mktsegment AS segment, cast(round(c_acctbal * 100) AS bigint) AS cents FROM customer")
def projection_select(spark, sf_dir):
    layout = parse("01 R.\n 05 K PIC 9(9) COMP.\n 05 G.\n 10 NAME PIC X(25).\n 10 BAL PIC S9(7)V99 SIGN TRAILING SEPARATE.\n 05 SEG PIC X(10).")
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 1_000_000_000).alias("K"), F.struct(F.col("c_name").alias("NAME"), cents("c_acctbal").alias("BAL")).alias("G"), F.col("c_mktsegment").alias("SEG"))
    r = records.decode(records.encode(c, layout, keep=["c_custkey"]), layout, keep=["c_custkey"], select=["BAL,SEG"], mode="drop", options=Options(trim=True))
    return r.select("c_custkey", F.col("SEG").alias("segment"), (F.col("G")["BAL"] * 100).cast("bigint").alias("cents"))


@query("""SELECT * FROM (VALUES (0, 'ORDER-RECORD', 'group', 0, 39), (1, 'O-ORDERKEY', 'binary', 0, 4), (2, 'O-CUSTKEY', 'binary', 4, 4), (3, 'O-STATUS', 'text', 8, 1), (4, 'IS-OPEN', 'condition', 8, 0), (5, 'IS-DONE', 'condition', 8, 0), (6, 'O-TOTAL', 'packed', 9, 7), (7, 'O-DATE', 'zoned', 16, 8), (8, 'O-PRIORITY', 'text', 24, 15)) t(position, name, kind, "offset", size)""")
def layout_table(spark, sf_dir):
    return parse(ORDERS).table(spark).select("position", "name", "kind", "offset", "size")


@query("SELECT * FROM (VALUES (24, 7, 8, 39)) t(display_bytes, packed_bytes, binary_bytes, total_bytes)")
def layout_byte_mix(spark, sf_dir):
    m = audit.byte_mix(parse(ORDERS).table(spark))
    return m.select(*[F.col(c).cast("int").alias(c) for c in m.columns])


_PIECES = "SELECT doc_id, i, substr(coalesce(text, ''), cast(i AS bigint) * 15000 + 1, 15000) AS piece FROM (SELECT doc_id, text, unnest(range(0, length(coalesce(text, '')) // 15000 + 1)) AS i FROM documents)"


@query(f"""SELECT doc_id, cast(i AS bigint) AS i, cast(n AS bigint) AS n, '0000' AS reserved, h,
  CASE WHEN size // 256 BETWEEN 48 AND 57 AND size % 256 BETWEEN 48 AND 57 THEN 'CBKF104' ELSE '' END AS code
FROM (SELECT doc_id, i, strlen(piece) AS n, md5(piece) AS h, strlen(doc_id || ':' || i || ':' || piece) AS size FROM ({_PIECES}))""")
def rdw_roundtrip(spark, sf_dir):
    """Whole texts as chains of variable records, split again by their descriptors. A length
    whose two bytes are digits makes a descriptor look like text; the record is there."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    p = d.select("doc_id", F.posexplode(F.expr("transform(sequence(0, cast(length(text) div 15000 as int)), i -> substring(text, i * 15000 + 1, 15000))")).alias("i", "piece"))
    p = p.select(F.concat(F.encode(F.concat_ws(":", "doc_id", "i", F.lit("")), "UTF-8"), F.encode("piece", "UTF-8")).alias("payload"))
    r = frames.rdw_records(p.select(frames.rdw_of(F.col("payload")).alias("content")))
    r = r.select(F.split(F.decode("payload", "UTF-8"), ":", 3).alias("s"), "header", "error")
    return r.select(F.col("s")[0].cast("bigint").alias("doc_id"), F.col("s")[1].cast("bigint").alias("i"), F.octet_length(F.col("s")[2]).cast("bigint").alias("n"), F.hex(F.substring("header", 3, 2)).alias("reserved"), F.md5(F.col("s")[2].cast("binary")).alias("h"), F.coalesce("error", F.lit("")).alias("code"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'text_digits' WHEN 1 THEN 'printable' WHEN 2 THEN 'length' ELSE '' END AS reason FROM customer")
def rdw_corruption(spark, sf_dir):
    k = F.col("c_custkey") % 4
    header = F.when(k == 0, F.lit(b"1234")).when(k == 1, F.lit(b"AB  ")).when(k == 2, F.lit(b"\x00\x09\0\0")).otherwise(F.lit(b"\x00\x04\0\0"))
    c = table(spark, sf_dir, "customer").select("c_custkey", header.alias("header"), F.lit(b"TEST").alias("payload"))
    return c.select("c_custkey", F.coalesce(integrity.rdw_corruption(c, header="header", payload="payload"), F.lit("")).alias("reason"))


@query("SELECT o_orderkey, cast(o_orderkey AS varchar) AS k, o_orderstatus AS s, printf('%d.%02d', cast(round(o_totalprice * 100) AS bigint) // 100, cast(round(o_totalprice * 100) AS bigint) % 100) AS total, '39' AS n, 'cp037' AS page FROM orders")
def jsonl_envelope(spark, sf_dir):
    data, layout = orders_bytes(spark, sf_dir)
    e = records.envelope(data.withColumn("record_index", F.lit(1)), layout)
    j = F.from_json("value", "fields struct<`O-ORDERKEY`:string,`O-STATUS`:string,`O-TOTAL`:string>, `O-ORDERKEY` string, length string, codepage string")
    e = e.select(j.alias("j")).select("j.*")
    f = F.col("fields")
    return e.select(f["O-ORDERKEY"].cast("bigint").alias("o_orderkey"), F.col("`O-ORDERKEY`").alias("k"), f["O-STATUS"].alias("s"), f["O-TOTAL"].alias("total"), F.col("length").alias("n"), F.col("codepage").alias("page"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN '0' ELSE lpad(cast(c_custkey % 50 AS varchar), 6, '0') END AS t FROM customer")
def lossless_zoned(spark, sf_dir):
    layout, d = one_field(spark, sf_dir, "customer", "PIC 9(6)", F.col("c_custkey") % 50, ["c_custkey"])
    return records.decode(d, layout, keep=["c_custkey"], lossless=True).select("c_custkey", F.col("V").alias("t"))


def broken_lines(spark, sf_dir):
    """Line prices as packed numbers; every 97th line's last byte and every 89th's first is bad."""
    layout, d = one_field(spark, sf_dir, "lineitem", "PIC S9(9)V99 COMP-3", cents("l_extendedprice"), ["l_orderkey", "l_linenumber", "l_partkey"])
    p = F.col("payload")
    bad = F.when(F.col("l_partkey") % 97 == 0, F.concat(F.substring(p, 1, 5), F.lit(b"\x11"))).when(F.col("l_partkey") % 89 == 0, F.concat(F.lit(b"\xaa"), F.substring(p, 2, 5))).otherwise(p)
    return layout, d.withColumn("payload", bad).withColumn("record_index", F.concat_ws(":", "l_orderkey", "l_linenumber"))


_X = "lpad(cast(cast(round(l_extendedprice * 100) AS bigint) AS varchar), 11, '0') || 'C'"


@query(f"SELECT l_orderkey || ':' || l_linenumber AS record_index, 'CBKD401' AS code, 'R.V' AS field_path, 0 AS byte_offset, CASE WHEN l_partkey % 97 = 0 THEN left({_X}, 10) || '11' ELSE 'AA' || substr({_X}, 3) END AS hex FROM lineitem WHERE l_partkey % 97 = 0 OR l_partkey % 89 = 0")
def verify_report(spark, sf_dir):
    layout, d = broken_lines(spark, sf_dir)
    return integrity.verify(d, layout)


@query("SELECT kind, count(*) AS n FROM (SELECT unnest(CASE WHEN l_partkey % 97 = 0 THEN ['packed_sign'] WHEN l_partkey % 89 = 0 THEN ['packed_high', 'packed_low'] ELSE [] END) AS kind FROM lineitem) GROUP BY 1")
def corruption_scan(spark, sf_dir):
    _, d = broken_lines(spark, sf_dir)
    return integrity.corruption(d, payload="payload", index="record_index", packed=[("V", 0, 6)]).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS records, cast(count(*) * 6 AS bigint) AS bytes, count(*) FILTER (l_partkey % 97 = 0 OR l_partkey % 89 = 0) AS records_with_errors, 0 AS warnings, round(cast(count(*) FILTER (NOT (l_partkey % 97 = 0 OR l_partkey % 89 = 0)) AS double) / count(*), 9) AS success_rate FROM lineitem")
def run_summary(spark, sf_dir):
    layout, d = broken_lines(spark, sf_dir)
    s = integrity.summary(d, layout)
    return s.select(*[F.col(c).cast("bigint").alias(c) for c in s.columns[:3]], F.col("warnings").cast("int").alias("warnings"), F.round("success_rate", 9).alias("success_rate"))


@query(f"SELECT l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey || ':' || cast(round(l_extendedprice * 100) AS bigint) AS k, 5 AS \"offset\", right({_X}, 2) AS \"left\", '11' AS \"right\" FROM lineitem WHERE l_partkey % 97 = 0 AND right({_X}, 2) <> '11' ORDER BY 1, 2 LIMIT 100")
def determinism_diff(spark, sf_dir):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "c"]
    d = table(spark, sf_dir, "lineitem").withColumn("c", F.round(F.col("l_extendedprice") * 100).cast("bigint"))
    layout = parse("01 R.\n 05 V PIC S9(9)V99 COMP-3.")
    good = records.encode(d.withColumn("V", cents("l_extendedprice")), layout, keep=keys)
    broken = F.concat(F.substring("payload", 1, 5), F.lit(b"\x11"))
    bad = good.withColumn("payload", F.when(F.col("l_partkey") % 97 == 0, broken).otherwise(F.col("payload")))
    key = F.concat_ws(":", *keys).alias("k")
    return integrity.differences(good.select(key, "payload"), bad.select(key, "payload"), key="k", value="payload")


@query("SELECT user_id, count(*) FILTER (value < 20) AS failures, CASE WHEN count(*) FILTER (value < 20) >= 5 THEN 'high' ELSE 'medium' END AS severity FROM events GROUP BY 1 HAVING count(*) FILTER (value < 20) >= 3")
def audit_bruteforce(spark, sf_dir):
    return audit.brute_force(table(spark, sf_dir, "events"), user="user_id", failed=F.col("value") < 20)


@query("SELECT user_id, count(*) AS events, count(DISTINCT event_type) AS resources FROM events GROUP BY 1 HAVING count(*) > 10 OR count(DISTINCT event_type) > 5")
def audit_anomaly(spark, sf_dir):
    return audit.anomalies(table(spark, sf_dir, "events"), user="user_id", resource="event_type")


_CHAIN = "SELECT event_id, user_id, ts, md5(cast(event_id AS varchar)) AS hash, md5(cast(CASE WHEN event_id % 101 = 0 THEN -1 ELSE lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) END AS varchar)) AS previous_hash FROM events"


@query(f"SELECT event_id FROM (SELECT *, lag(hash) OVER (PARTITION BY user_id ORDER BY event_id) AS expected FROM ({_CHAIN})) WHERE expected IS NOT NULL AND expected <> previous_hash")
def audit_chain(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    from pyspark.sql import Window

    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    e = e.select("event_id", "user_id", F.md5(F.col("event_id").cast("string").cast("binary")).alias("hash"), F.md5(F.when(F.col("event_id") % 101 == 0, F.lit(-1).cast("bigint")).otherwise(before).cast("string").cast("binary")).alias("previous_hash"))
    return audit.broken_links(e, sequence="event_id", partition=["user_id"]).select("event_id")


@query("SELECT event_id FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY md5(cast(event_id AS varchar))) AS b FROM events) WHERE ts < b")
def audit_time_order(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("place", F.md5(F.col("event_id").cast("string").cast("binary")))
    return audit.backward_in_time(e, sequence="place", ts="ts", partition=["user_id"]).select("event_id")


@query("SELECT event_type AS field, count(DISTINCT user_id) AS systems, CASE WHEN count(DISTINCT user_id) <= 2 THEN 'low' WHEN count(DISTINCT user_id) <= 5 THEN 'medium' WHEN count(DISTINCT user_id) <= 10 THEN 'high' ELSE 'critical' END AS risk FROM events GROUP BY 1")
def lineage_impact(spark, sf_dir):
    return audit.impact(table(spark, sf_dir, "events").withColumnRenamed("event_type", "field"), field="field", system="user_id")


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 6")
def event_threshold(spark, sf_dir):
    return audit.threshold_event(table(spark, sf_dir, "events"), 5, key="user_id", order=["ts", "event_id"]).select("event_id", "user_id")


@query("""WITH m AS (SELECT year(o_orderdate) AS y, strftime(o_orderdate, '%m') AS month, count(*) AS v FROM orders GROUP BY 1, 2),
j AS (SELECT a.month, a.v AS current, b.v AS baseline, round((b.v - a.v) / cast(b.v AS double), 9) AS change FROM m a JOIN m b USING (month) WHERE a.y = 1997 AND b.y = 1996)
SELECT month, current, baseline, change, CASE WHEN change < 0.02 THEN 'none' WHEN change < 0.05 THEN 'minor' WHEN change < 0.15 THEN 'major' ELSE 'critical' END AS status FROM j""")
def regression_check(spark, sf_dir):
    m = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y"), F.date_format("o_orderdate", "MM").alias("month")).agg(F.count("*").alias("v"))
    r = audit.regressions(m.where("y = 1997"), m.where("y = 1996"), metric="month", value="v").withColumn("change", F.round("change", 9))
    return r.withColumn("status", audit.change_status(F.col("change"))).select("month", "current", "baseline", "change", "status")

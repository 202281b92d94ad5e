"""Whole records: decode, encode, envelopes. Each is one ``select`` over the payload column,
so Catalyst prunes the fields that a query doesn't read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, NumericType, StructField, StructType

from ..errors import WARNINGS
from ..functions import codepages
from ..functions import fields as codec
from ..functions.fields import Options
from ..plans.layout import Field, Layout, project

SCHEMA_ID = "records.jsonl.v1"
_ERRORS = "array<struct<code:string,field_path:string,byte_offset:int>>"


class Many(NamedTuple):
    """An array of faults, where a Column alone is one fault or null."""

    faults: Column


def _together(faults: list) -> Column:
    one = [f for f in faults if not isinstance(f, Many)]
    parts = [F.filter(F.array(*one), lambda e: e.isNotNull()) if one else F.array()] + [f.faults for f in faults if isinstance(f, Many)]
    parts = [p.cast(_ERRORS) for p in parts]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def _every(tests: list[Column]) -> Column:
    """All of them, as a balanced tree."""
    if not tests:
        return F.lit(True)
    while len(tests) > 1:
        tests = [a & b for a, b in zip(tests[::2], tests[1::2])] + ([tests[-1]] if len(tests) % 2 else [])
    return tests[0]


class Plan:
    """The expressions of a layout over a payload column."""

    def __init__(self, layout: Layout, payload: Column, options: Options, *, lossless: bool = False, strict_arrays: bool = False, conditions: bool = True):
        self.layout, self.payload, self.o = layout, payload, options
        self.lossless, self.strict, self.conditions = lossless, strict_arrays, conditions
        self.good: list[Column] = []  # of what lies outside arrays: true where there is no fault
        self.counters = {f.counter: f for f in layout.walk() if f.counter}

    def _fault(self, error: Column, f: Field, offset) -> Column:
        at = F.lit(offset) if isinstance(offset, int) else offset
        return F.when(error.isNotNull(), F.struct(error.alias("code"), F.lit(f.path).alias("field_path"), at.cast("int").alias("byte_offset")))

    def _one(self, f: Field, offset, nested: bool) -> tuple[Column, list[Column]]:
        """One element at ``offset`` and its faults."""
        if f.kind == "group":
            parts, faults = [], []
            for c in f.children:
                for name, value, more in self._named(c, offset, f.offset, nested):
                    parts.append(value.alias(name))
                    faults += more
            return F.struct(*parts), faults
        d = codec.decode(f, self.payload, offset, self.o, nested)
        if not nested:
            self.good.append(d.good)
        return (d.text if self.lossless else d.value), [self._fault(d.error, f, offset)]

    def _clean(self, f: Field, value: Column) -> Column:
        """Whether a decoded element can have no fault, told from its value alone."""
        if f.kind == "group":
            parts = [c for c in f.children if c.kind != "condition" and not (c.filler and not self.layout.emit_filler)]
            each = lambda c: lambda v: self._clean(c, v)
            return _every([F.forall(value[c.name], each(c)) if c.array else self._clean(c, value[c.name]) for c in parts])
        good = value.isNotNull()
        if f.kind in ("text", "alias") and self.o.unmappable == "error" and self.o.codepage != "ascii":
            good = good & ~codepages.has_controls(value)
        return F.coalesce(good & (value != 0) if f.blank_zero else good, F.lit(False))

    def _named(self, f: Field, base, origin: int, nested: bool) -> list[tuple[str, Column, list[Column]]]:
        """(name, value, faults) of a field below ``base``, the place of what starts at ``origin``."""
        if f.kind == "condition" or f.filler and not self.layout.emit_filler:
            return []
        offset = base + (f.offset - origin)
        if f.array:
            out = [(f.name, *self._array(f, offset, nested))]
        else:
            out = [(f.name, *self._one(f, offset, nested))]
        if self.conditions and not f.array and f.kind not in ("group", "alias"):
            value = codec.decode(f, self.payload, offset, self.o).value
            out += [(c.name, codec.condition(c, value), []) for c in f.children if c.kind == "condition"]
        return out

    def count(self, f: Field) -> tuple[Column, Column, Column]:
        """(elements, declared, fault) of a counter-dependent array."""
        c = self.layout.find(f.counter)
        d = codec.decode(c, self.payload, c.offset, self.o, True)
        declared = F.coalesce(d.value.cast("int"), F.lit(0))
        low = self.layout.least(f)
        if f.size:
            room = F.floor((F.length(self.payload) - f.offset) / f.size).cast("int")
        else:
            room = F.lit(f.occurs)
        clamped = F.greatest(F.least(declared, F.lit(f.occurs)), F.lit(low))
        high = F.when(declared > f.occurs, F.lit("CBKS301")).when(declared < low, F.lit("CBKS301" if self.strict else "CBKS302")).when(room < clamped, F.lit("CBKD301"))
        return F.greatest(F.least(clamped, room), F.lit(0)), declared, high

    def _array(self, f: Field, offset, nested: bool) -> tuple[Column, list[Column]]:
        faults: list[Column] = []
        if f.counter:
            n, _, fault = self.count(f)
            faults.append(self._fault(fault, f, offset))
            self.good.append(fault.isNull())
        else:
            n = F.lit(f.occurs)
        # Of a number that is worked out once: what a lambda runs over is interpreted as well.
        indices = F.transform(F.array(n), lambda k: F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>")))[0]
        place = lambda i: i * f.size + offset
        value = F.transform(indices, lambda i: self._one(f, place(i), True)[0])

        inside = lambda i: _together(self._one(f, place(i), True)[1])
        every = F.flatten(F.transform(indices, inside))
        if not nested:
            # One expression gives the elements and whether all are clean: it is worked out once
            # for both, where a test of the elements alone would decode them again.
            both = F.transform(F.array(value), lambda v: F.struct(v.alias("value"), F.forall(v, lambda e: self._clean(f, e)).alias("good")))[0]
            value = both["value"]
            self.good.append(both["good"])
            every = F.when(both["good"], F.array().cast(_ERRORS)).otherwise(every.cast(_ERRORS))
        return value, [*faults, Many(every)]

    def _first_name(self, top: list[Field]) -> str:
        return next(f.name for f in top if f.kind != "condition" and not (f.filler and not self.layout.emit_filler))

    def columns(self) -> tuple[list[Column], Column]:
        """The record's columns and its array of errors. The codes and places of faults are
        worked out only for records in which some field isn't plainly good."""
        columns, faults = [], []
        for f in self.layout.top():
            for name, value, more in self._named(f, f.offset, f.offset, False):
                columns.append(value.alias(name))
                faults += more
        none = F.array().cast(_ERRORS)
        if len(columns) > 4:
            # A lambda keeps this projection out of whole-stage code: there all fields would share
            # one method, too long for the JIT compiler. By itself it is compiled in pieces.
            there = F.exists(F.array(F.length(self.payload) >= 0), lambda x: x)
            columns[0] = F.when(there, columns[0]).alias(self._first_name(self.layout.top()))
        return columns, F.when(_every(self.good), none).otherwise(_together(faults)) if faults else none


def _in_array(layout: Layout, f: Field) -> bool:
    return any(p.array and f.path.startswith(p.path + ".") for p in layout.walk())


def decode(df: DataFrame, layout: Layout, *, payload: str = "payload", options: Options | None = None, select: list[str] | None = None, lossless: bool = False, mode: str = "permissive", keep: list[str] | None = None, strict_arrays: bool = False, zone_metadata: bool = False) -> DataFrame:
    """Columns of each record, after the columns ``keep``.

    ``zone_metadata`` adds ``_encoding_metadata``: by name, the encoding (ascii or ebcdic) that
    the bytes of each zoned field show; ``encode`` can follow it.

    mode: ``permissive`` adds ``_errors``; ``drop`` leaves out records that have errors
    (warnings stay); ``fail`` raises on the first one read; ``off`` looks for none.
    """
    chosen = project(layout, select) if select else layout
    plan = Plan(chosen, F.col(payload), options or Options(layout.codepage), lossless=lossless, strict_arrays=strict_arrays)
    columns, errors = plan.columns()
    kept = [F.col(c) for c in keep or []]
    if zone_metadata:
        fields = [f for f in chosen.walk() if f.kind == "zoned" and not f.sign and not f.array and not _in_array(chosen, f)]
        shown = [F.struct(F.lit(f.name).alias("key"), codec.zones(codec.slice_of(F.col(payload), f.offset, f.size)).alias("value")) for f in fields]
        found = F.filter(F.array(*shown), lambda e: e["value"].isin("ascii", "ebcdic")) if shown else F.array().cast("array<struct<key:string,value:string>>")
        columns = [*columns, F.map_from_entries(found).alias("_encoding_metadata")]
    if mode == "off":
        return df.select(*kept, *columns)
    out = df.select(*kept, *columns, errors.alias("_errors"))
    if mode == "permissive":
        return out
    real = F.filter("_errors", lambda e: ~e["code"].isin(*WARNINGS))
    if mode == "drop":
        keeps = F.size(real) == 0
    elif mode == "fail":
        keeps = F.when(F.size(real) > 0, F.raise_error(F.concat(real[0]["code"], F.lit(": "), real[0]["field_path"])).cast("boolean")).otherwise(F.lit(True))
    else:
        raise ValueError(f"mode {mode}")
    # A filter would be pushed below the projection, and each field decoded twice: for the
    # filter and for the value. Rows are left out by a generator of one row or none instead.
    once = F.when((F.size("_errors") == 0) | keeps, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>"))
    names = [c for c in out.columns if c != "_errors"]
    return elements(out.select(*[F.col(f"`{c}`") for c in names], once.alias("_keep")), "_keep", "_kept", keep=names).drop("_kept")


def elements(df: DataFrame, array: str, name: str, *, keep: list[str]) -> DataFrame:
    """One row ``name`` for each element of a decoded array, after the columns ``keep``. Elements
    that are null are left out.

    From ``explode`` the optimizer infers a filter for arrays that aren't empty, and pushes it
    below the projection that decodes: each record would be decoded twice. It does not from
    ``explode_outer``.
    """
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.explode_outer(f"`{array}`").alias(name))
    return rows.where(F.col(f"`{name}`").isNotNull())


def encode(df: DataFrame, layout: Layout, *, options: Options | None = None, out: str = "payload", keep: list[str] | None = None, variable: bool = True, raw: str | None = None, verified: bool = False, raw_header: bool = False, zone_metadata: str | None = None, coerce: bool = True) -> DataFrame:
    """``out`` (bytes) and ``_errors`` of each row; columns are named as the layout's fields.

    Arrays are padded to their most elements, except a counter-dependent one (``variable``).
    Of views of one place the non-null one is written; more than one is CBKE501. ``raw``
    names a column of base64 bytes that are replayed (``verified``: only if values agree);
    with ``raw_header`` they begin with a record descriptor, which is made anew. The column
    ``zone_metadata`` (name to ascii or ebcdic) says how zoned fields are written. Without
    ``coerce`` a number in a text field is CBKE501.
    """
    o = options or Options(layout.codepage)
    faults: list[Column] = []

    def of_group(fields: list[Field], get, size: int, within: DataType | None, looped: bool) -> Column:
        """``within``: the type that holds the fields; ``looped``: inside an array."""
        parts, at = [], fields[0].offset if fields else 0
        real = [f for f in fields if f.kind not in ("condition", "alias")]
        clusters: list[list[Field]] = []
        for f in real:
            if f.redefines:
                clusters[-1].append(f)
            else:
                clusters.append([f])
        for views in clusters:
            start = views[0].offset
            if start > at:
                parts.append(F.lit(b"\0" * (start - at)))
            room = max(v.extent for v in views)
            if len(views) == 1:
                parts.append(of_field(views[0], get, within, looped))
            else:
                pad = F.lit(b"\0" * room)
                present = [get(v).isNotNull() for v in views]
                chosen = F.when(F.lit(False), pad)
                for v, p in zip(views, present):
                    chosen = chosen.when(p, F.concat(of_field(v, get, within, looped), pad).substr(1, room))
                parts.append(chosen.otherwise(pad))
                n = sum((p.cast("int") for p in present), F.lit(0))
                faults.append(F.when(n > 1, fault("CBKE501", views[0])))
            at = start + room
        return F.concat(*parts) if parts else F.lit(b"")

    def fault(code: str, f: Field) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit(f.path).alias("field_path"), F.lit(f.offset).alias("byte_offset"))

    def of_element(f: Field, value: Column, inside: bool, kind: DataType | None, looped: bool) -> Column:
        if f.kind == "group":
            return of_group(f.children, lambda c: value[c.name] if not c.filler else F.lit(None), f.size, kind, looped)
        said = F.try_element_at(F.col(zone_metadata), F.lit(f.name)) if zone_metadata and f.kind == "zoned" and not inside else None
        e = codec.encode(f, value, o, said)
        if looped and said is None:
            e = codec.shortened(f, value, o, kind, e)
        if f.kind == "text" and not coerce and not inside and names.get(f.name.lower()) in numeric:
            e = codec.Encoded(F.when(value.isNull(), e.data).otherwise(F.lit(b"\0" * f.size)), F.when(value.isNotNull(), F.lit("CBKE501")))
        if not inside:
            faults.append(F.when(e.error.isNotNull(), F.struct(e.error.alias("code"), F.lit(f.path).alias("field_path"), F.lit(f.offset).alias("byte_offset"))))
        return e.data

    def of_field(f: Field, get, within: DataType | None, looped: bool) -> Column:
        if f.filler:
            return F.lit(b"\0" * f.extent)
        value = get(f)
        kind = type_in(within, f)
        if not f.array:
            return of_element(f, value, False, kind, looped)
        kind = kind.elementType if isinstance(kind, ArrayType) else None
        before = len(faults)
        each = F.transform(F.coalesce(value, F.array().cast(df_type(f))) if df_type(f) else value, lambda v: F.hex(of_element(f, v, True, kind, True)))
        del faults[before:]  # of elements: their errors cannot leave the lambda
        data = F.unhex(F.array_join(each, ""))
        if f.counter:
            n = F.coalesce(F.size(value), F.lit(0))
            faults.append(F.when((n > f.occurs) | (n < layout.least(f)), fault("CBKE521", f)))
            if variable:
                return F.coalesce(data, F.lit(b""))
        return F.concat(F.coalesce(data, F.lit(b"")), F.lit(b"\0" * f.extent)).substr(1, f.extent)

    def type_in(within: DataType | None, f: Field) -> DataType | None:
        found = [c.dataType for c in within if c.name.lower() == f.name.lower()] if isinstance(within, StructType) else []
        return found[0] if len(found) == 1 else None

    def df_type(f: Field) -> str | None:
        return df.schema[f.name].dataType.simpleString() if f.name in df.columns else None

    names = {c.lower(): c for c in df.columns}
    numeric = {c.name for c in df.schema if isinstance(c.dataType, NumericType)}
    get = lambda f: F.col(f"`{names[f.name.lower()]}`") if f.name.lower() in names else F.lit(None)
    data = of_group(layout.top(), get, layout.lrecl, df.schema, False)
    if raw:
        replay = F.unbase64(F.col(raw))
        replay = replay.substr(F.lit(5), F.length(replay)) if raw_header else replay
        data = F.when(replay == data, replay).otherwise(data) if verified else F.coalesce(replay, data)
    errors = F.filter(F.array(*faults), lambda e: e.isNotNull()) if faults else F.array()
    # A generator of one row: the optimizer doesn't merge what reads the bytes into what makes
    # them, which would encode a record again for each of its fields. The bytes are made in the
    # projection below it, where they are compiled; a generator's own input would be interpreted.
    made = df.select(*[F.col(c) for c in keep or []], F.struct(data.alias(out), errors.cast(_ERRORS).alias("_errors")).alias("_made"))
    once = made.select(*(keep or []), F.explode(F.array("_made")).alias("_record"))
    return once.select(*(keep or []), f"_record.{out}", "_record._errors")


def envelope(df: DataFrame, layout: Layout, *, payload: str = "payload", index: str = "record_index", options: Options | None = None, raw: str = "off", header: str | None = None, native: bool = False) -> DataFrame:
    """One JSON text for each record: metadata, the fields flat, and ``fields``.

    raw: ``off``, ``record``, ``record+rdw`` (with ``header``) or ``field`` add base64 bytes.
    ``record_index`` counts from 1. Numbers are texts unless ``native``.
    """
    o = options or Options(layout.codepage)
    plan = Plan(layout, F.col(payload), o, lossless=not native, conditions=False)
    columns, errors = plan.columns()
    meta = [
        F.lit(SCHEMA_ID).alias("schema"), F.col(index).alias("record_index"), F.lit(o.codepage).alias("codepage"),
        F.length(payload).alias("length"), F.lit(layout.fingerprint).alias("schema_fingerprint"),
    ]
    extra, extra_names = [], ["raw_b64"]
    if raw == "record":
        extra = [F.base64(payload).alias("raw_b64")]
    elif raw == "record+rdw":
        extra = [F.base64(F.concat(F.col(header or "header"), F.col(payload))).alias("raw_b64")]
    elif raw == "field":
        singles = [f for f in layout.top() if f.kind not in ("group", "condition") and not f.array]
        extra, extra_names = [F.base64(codec.slice_of(F.col(payload), f.offset, f.size)).alias(f"{f.name}_raw_b64") for f in singles], [f"{f.name}_raw_b64" for f in singles]
    else:
        extra_names = []
    # Two projections: what is decoded in the first is referred to twice in the second.
    names = [f"_{i}" for i in range(len(columns))]
    said = [f.name for f in plan.layout.top() if f.kind != "condition" and not (f.filler and not layout.emit_filler)]
    once = df.select(*[c.alias(n) for c, n in zip(columns, names)], errors.alias("_errors"), F.struct(*meta).alias("_meta"), F.struct(F.lit(0).alias("_"), *extra).alias("_extra"))
    flat = [F.col(n).alias(s) for n, s in zip(names, said)]
    head = [F.col("_meta")[k].alias(k) for k in ("schema", "record_index", "codepage", "length", "schema_fingerprint")]
    tail = [F.col("_extra")[k].alias(k) for k in extra_names]
    return once.select(F.to_json(F.struct(*head, F.struct(*flat).alias("fields"), *flat, *tail), {"ignoreNullFields": "false"}).alias("value"), "_errors")


def from_json(lines: DataFrame, layout: Layout, schema, *, column: str = "value") -> DataFrame:
    """Rows of JSON lines, with or without the envelope; blank lines are skipped."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    wrapped = F.from_json(column, StructType([StructField("fields", kind)]))["fields"]
    plain = F.from_json(column, kind)
    return lines.where(F.trim(column) != "").select(F.coalesce(wrapped, plain).alias("r")).select("r.*")

"""Field codecs as Column builders: bytes at an offset to a value, a lossless text and an
error code (null if none), and back. Only built-in functions; nothing runs in Python.

Numbers of up to 18 digits are read as one whole number (``try_cast`` is null for bytes that
are no digits), and the value, its text and the test for faults all refer to that number, so
it is worked out once. ``good`` tells from the value alone that a field has no fault: the
codes are looked for only in records where some field is not good.

What lies in arrays is read and written inside lambdas, which Spark interprets: there nothing is
worked out once for all its uses, and calls to Java cost most. Plain numbers have short forms
for it.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, DecimalType, IntegerType, LongType, ShortType

from ..plans.layout import Field
from . import codepages, edited

class Decoded(NamedTuple):
    value: Column
    text: Column
    error: Column
    good: Column  # never null; true: no error and no warning (false says nothing)


class Encoded(NamedTuple):
    data: Column
    error: Column


@dataclass(frozen=True)
class Options:
    codepage: str = "cp037"
    unmappable: str = "error"  # error, replace, skip
    floats: str = "ieee"  # or "ibm"
    trim: bool = False
    zoned: str = "codepage"  # encode, where nothing else says: codepage, ascii, ebcdic
    zoned_override: str = ""  # encode: ascii or ebcdic, whatever a record's metadata says
    detect_zones: bool = False  # decode zoned numbers in the encoding that their bytes show


def _ok(condition: Column, value: Column) -> Column:
    return F.when(condition, value)


def _error(ok: Column, code: str) -> Column:
    return F.when(~F.coalesce(ok, F.lit(False)), F.lit(code))


def slice_of(payload: Column, offset, size) -> Column:
    """``size`` bytes from the 0-based ``offset``; numbers or columns."""
    as_column = lambda x, plus=0: F.lit(x + plus) if isinstance(x, int) else x + plus
    return payload.substr(as_column(offset, 1), as_column(size))


LONG = 18  # digits that a bigint holds


def _scaled(number: Column, n: int, scale: int) -> Column:
    """A whole number as a decimal with an implied point."""
    kind = f"decimal({max(n, 1)},{scale})"
    if not scale:
        return number.cast(kind)
    return (number.cast("decimal(20,0)") * F.lit(Decimal(1).scaleb(-scale)).cast(f"decimal({scale},{scale})")).cast(kind)


def _decimal(digits: Column, negative: Column, n: int, scale: int) -> Column:
    """Digits (all of them valid) as a decimal with an implied point."""
    sign = F.when(negative, F.lit("-")).otherwise(F.lit(""))
    if scale:
        digits = F.concat(F.substring(digits, 1, n - scale), F.lit("."), F.substring(digits, n - scale + 1, scale))
    return F.concat(sign, digits).cast(f"decimal({max(n, 1)},{scale})")


def _number(digits: Column, negative: Column, valid: Column, n: int, scale: int) -> Column:
    """Decimal of ``digits``, or null unless ``valid`` and all are digits. The text may hold
    any characters but blanks, signs and points."""
    if n <= LONG:
        whole = digits.try_cast("bigint")
        return _scaled(F.when(valid, F.when(negative, -whole).otherwise(whole)), n, scale)
    return F.when(valid & digits.rlike(f"^[0-9]{{{n}}}$"), _decimal(digits, negative, n, scale))


def _plain(value: Column) -> Column:
    return value.cast("string")


def _padded(value: Column, f: Field) -> Column:
    """Lossless text of a zoned integer: padded to its digits, zero as one digit."""
    if f.scale or f.blank_zero:
        return F.when(value == 0, F.lit("0") if not f.scale else _plain(value)).otherwise(_plain(value))
    width = F.lpad(F.abs(value).cast("string"), f.digits, "0")
    return F.when(value == 0, F.lit("0")).otherwise(F.concat(F.when(value < 0, F.lit("-")).otherwise(F.lit("")), width))


# --- decode -----------------------------------------------------------------------------


def _text(f: Field, raw: Column, o: Options) -> Decoded:
    t = codepages.to_text(raw, o.codepage, o.unmappable)
    good, error = F.lit(True), F.lit(None).cast("string")
    if o.unmappable == "error" and o.codepage != "ascii":
        good = ~codepages.has_controls(t)
        error = F.when(codepages.unmappable(raw, o.codepage), F.lit("CBKC301"))
    return Decoded(F.rtrim(t) if o.trim else t, t, error, F.coalesce(good, F.lit(False)))


_DIGITS = "0123456789"
# Last characters of signed ASCII numbers, digits 0 to 9.
_PLUS, _MINUS = "{ABCDEFGHI", "}JKLMNOPQR"
_PLUS_OUT, _MINUS_OUT = "ABCDEFGHIJ", "KLMNOPQRST"  # stand for a signed last digit below


#: What a cast to a number would overlook: blanks and controls around it, signs and points.
_FORGIVEN = "".join(map(chr, [*range(33), *range(127, 161)])) + "+-."


def _latin(zone: int) -> str:
    """The ten characters of a zone's bytes in Latin-1."""
    return "".join(chr(zone << 4 | d) for d in range(10))


def _marked(raw: Column, plain: str, plus: str, minus: str) -> Column:
    """One character for each byte: digits of the plain zone as they are, signed ones as the
    letters of ``_PLUS_OUT`` and ``_MINUS_OUT``, and ``x`` for what a cast would forgive."""
    pairs = {c: "x" for c in [*_FORGIVEN, *_DIGITS, *"ABCDEFGHIJKLMNOPQRST"]}
    for found, stands in ((plain, _DIGITS), (plus, _PLUS_OUT), (minus, _MINUS_OUT)):
        pairs |= dict(zip(found, stands))
    pairs = {a: b for a, b in pairs.items() if a != b}
    return F.translate(F.decode(raw, "ISO-8859-1"), "".join(pairs), "".join(pairs.values()))


def zones(raw: Column) -> Column:
    """What the zones of a zoned number show: ascii, ebcdic, mixed (or no zones), or auto (no bytes)."""
    h = F.hex(raw)
    ascii_, ebcdic = h.rlike("^(3.|7[BD]|4[1-9A-F]|5[0-2])+$"), h.rlike("^([CDF].)+$")
    return F.when(h == "", "auto").when(ascii_, "ascii").when(ebcdic, "ebcdic").otherwise("mixed")


def _zoned_value(f: Field, raw: Column, ebcdic: bool) -> Column:
    t = _marked(raw, _latin(0xF), _latin(0xC), _latin(0xD)) if ebcdic else _marked(raw, _DIGITS, _PLUS, _MINUS)
    whole = F.length(raw) == f.size
    if not f.signed:
        return _number(t, F.lit(False), whole, f.digits, f.scale)
    last = F.substring(t, f.digits, 1)
    digits = F.concat(F.substring(t, 1, f.digits - 1), F.translate(last, _PLUS_OUT + _MINUS_OUT, 2 * _DIGITS))
    return _number(digits, last.between("K", "T"), whole, f.digits, f.scale)


def _zoned_element(f: Field, raw: Column) -> Column:
    """``_zoned_value`` of an EBCDIC number in an array: from its hexadecimal digits."""
    h = F.hex(raw)
    if not f.signed:
        return _number(F.replace(h, F.lit("F"), F.lit("")), F.lit(False), h.rlike(f"^(F[0-9]){{{f.digits}}}$"), f.digits, f.scale)
    whole = h.rlike(f"^(F[0-9]){{{f.digits - 1}}}[CDF][0-9]$")
    return _number(F.translate(h, "CDF", ""), F.substring(h, 2 * f.digits - 1, 1) == "D", whole, f.digits, f.scale)


def _zoned(f: Field, raw: Column, o: Options, inside: bool = False) -> Decoded:
    if f.sign:
        return _separate(f, raw, o)
    page_ebcdic = o.codepage != "ascii"
    if o.detect_zones:
        found = zones(raw)
        value = F.when(found == "ascii", _zoned_value(f, raw, False)).when(found == "ebcdic", _zoned_value(f, raw, True))
        signed_anyway = F.lit(False) if f.signed else F.hex(raw).rlike("^(..)*([^3F].)$")
        error = F.when(found == "mixed", F.lit("CBKD414")).when(value.isNull() & signed_anyway, F.lit("CBKD413")).when(value.isNull(), F.lit("CBKD411"))
    else:
        value = _zoned_element(f, raw) if inside and page_ebcdic else _zoned_value(f, raw, page_ebcdic)
        error = F.when(value.isNull(), F.lit("CBKD411"))
    good = value.isNotNull()
    blank = raw == F.lit((b"\x40" if page_ebcdic else b" ") * f.size)
    if f.blank_zero:
        value = F.when(blank, F.lit(0).cast(f"decimal({f.digits},{f.scale})")).otherwise(value)
        error = F.when(blank, F.lit("CBKD412")).otherwise(error)
        good = ~F.coalesce(blank, F.lit(True)) & good
    elif o.detect_zones:
        error = F.when(blank, F.lit("CBKD411")).otherwise(error)
    return Decoded(value, _padded(value, f), error, good)


def _separate(f: Field, raw: Column, o: Options) -> Decoded:
    t = codepages.to_text(raw, o.codepage)
    head = f.sign == "leading"
    mark, digits = (F.substring(t, 1, 1), F.substring(t, 2, f.digits)) if head else (F.substring(t, f.digits + 1, 1), F.substring(t, 1, f.digits))
    if f.digits <= LONG:  # what a cast would forgive is made invalid
        digits = F.translate(digits, _FORGIVEN, "x" * len(_FORGIVEN))
    value = _number(digits, mark == "-", mark.isin("-", "+", " ", "0") & (F.length(raw) == f.size), f.digits, f.scale)
    return Decoded(value, _padded(value, f), F.when(value.isNull(), F.lit("CBKD411")), value.isNotNull())


def _packed(f: Field, raw: Column, o: Options, inside: bool = False) -> Decoded:
    h = F.hex(raw)
    n = 2 * f.size - 1
    sign = F.substring(h, n + 1, 1)
    if inside and f.signed and f.digits == n <= LONG:
        whole = F.substring(h, 1, n).try_cast("bigint")
        value = _scaled(F.when(sign.isin("A", "C", "E", "F"), whole).when(sign.isin("B", "D"), -whole), n, f.scale)
        return Decoded(value, _plain(value), F.when(value.isNull(), F.lit("CBKD401")), value.isNotNull())
    negative = sign.isin("B", "D") if f.signed else F.lit(False)
    valid = sign.isin("A", "B", "C", "D", "E", "F") if f.signed else sign == "F"
    if f.digits < n:  # the spare digit must be zero
        valid = valid & F.startswith(h, F.lit("0"))
    value = _number(F.substring(h, n - f.digits + 1, f.digits), negative, valid, f.digits, f.scale)
    return Decoded(value, _plain(value), F.when(value.isNull(), F.lit("CBKD401")), value.isNotNull())


_INTEGERS = {(16, True): "smallint", (16, False): "int", (32, True): "int", (32, False): "bigint", (64, True): "bigint", (64, False): "decimal(20,0)"}


def _binary(f: Field, raw: Column, o: Options) -> Decoded:
    ok = F.length(raw) == f.size
    if f.bits == 64:
        text = F.conv(F.hex(raw), 16, -10 if f.signed else 10)
        value = _ok(ok, text.cast(_INTEGERS[64, f.signed]))
        if not f.signed:  # beyond a signed word the format has no value
            ok = ok & (value <= F.lit((1 << 63) - 1).cast("decimal(20,0)"))
            value = _ok(ok, value)
    else:
        u = F.conv(F.hex(raw), 16, 10).cast("bigint")
        n = F.when(u >= 1 << (f.bits - 1), u - (1 << f.bits)).otherwise(u) if f.signed else u
        value = _ok(ok, n.cast(_INTEGERS[f.bits, f.signed]))
    return Decoded(value, _plain(value), _error(ok, "CBKD301"), value.isNotNull())


def _bits(raw: Column) -> Column:
    return F.conv(F.hex(raw), 16, -10).cast("bigint")


def _power(base: float, e: Column) -> Column:
    return F.pow(F.lit(float(base)), e.cast("double"))


def _float(f: Field, raw: Column, o: Options) -> Decoded:
    single = f.kind == "float"
    b = _bits(raw)
    if o.floats == "ibm":
        width = 24 if single else 56
        fraction = b.bitwiseAND(F.lit((1 << width) - 1)).cast("double") / float(1 << width)
        exponent = F.shiftrightunsigned(b, width).bitwiseAND(F.lit(127)) - 64
        negative = F.shiftrightunsigned(b, width + 7).bitwiseAND(F.lit(1)) == 1
        value = fraction * _power(16, exponent)
        special = F.lit(None).cast("string")
    else:
        width, bias, top = (23, 127, 255) if single else (52, 1023, 2047)
        fraction = b.bitwiseAND(F.lit((1 << width) - 1))
        exponent = F.shiftrightunsigned(b, width).bitwiseAND(F.lit(top))
        negative = F.shiftrightunsigned(b, 31 if single else 63).bitwiseAND(F.lit(1)) == 1
        normal = (fraction + F.lit(1 << width)).cast("double") / float(1 << width)
        # Two steps, so the smallest exponents don't underflow on the way.
        half = F.floor((exponent - bias) / 2)
        normal = normal * _power(2, half) * _power(2, exponent - bias - half)
        tiny = fraction.cast("double") * _power(2, F.lit(-width)) * (2.0 ** (1 - bias) if single else 2.0**-1022)
        value = F.when(exponent == 0, tiny).when(exponent < top, normal)
        special = F.when(exponent == top, F.when(fraction == 0, F.lit("CBKD432")).otherwise(F.lit("CBKD431")))
    ok = F.length(raw) == f.size
    value = _ok(ok, F.when(negative, -value).otherwise(value).cast("float" if single else "double"))
    return Decoded(value, _plain(value), F.when(~ok, F.lit("CBKD301")).otherwise(special), value.isNotNull())


def _edited(f: Field, raw: Column, o: Options) -> Decoded:
    value, error = edited.decode(f, codepages.to_text(raw, o.codepage))
    good = value.isNotNull() & (value != 0) if f.blank_zero else value.isNotNull()
    return Decoded(value, F.when(value == 0, F.lit("0")).otherwise(_plain(value)), error, F.coalesce(good, F.lit(False)))


_DECODERS = {"text": _text, "zoned": _zoned, "packed": _packed, "binary": _binary, "float": _float, "double": _float, "edited": _edited, "alias": _text}


def decode(f: Field, payload: Column, offset, o: Options, inside: bool = False) -> Decoded:
    """One element of ``f`` at ``offset``. A record that ends before it: CBKD301. ``inside``: an
    array, or what a lambda's array is made of."""
    raw = slice_of(payload, offset, f.size)
    d = _DECODERS[f.kind](f, raw, o, inside) if f.kind in ("zoned", "packed") else _DECODERS[f.kind](f, raw, o)
    end = (F.lit(offset) if isinstance(offset, int) else offset) + f.size
    short = F.length(payload) < end
    error = F.when(short, F.lit("CBKD301")).otherwise(d.error)
    if f.kind in ("zoned", "packed") and not f.blank_zero:  # null already, if any byte is missing
        return Decoded(d.value, d.text, error, d.good)
    there = F.coalesce(~short, F.lit(False))
    return Decoded(F.when(there, d.value), F.when(there, d.text), error, there & d.good)


def condition(f: Field, parent: Column) -> Column:
    """Whether the parent's value is one of a condition's values or inside one of its ranges."""
    out = F.lit(False)
    for low, high in f.values:
        a, b = (F.lit(x).cast("decimal(38,9)") if _is_number(x) else F.lit(x) for x in (low, high))
        left = parent.cast("decimal(38,9)") if _is_number(low) and _is_number(high) else F.rtrim(parent.cast("string"))
        out = out | left.between(a, b)
    return out


def _is_number(x: str) -> bool:
    return x.lstrip("+-").replace(".", "", 1).isdigit()


def with_scale(text: Column, scale: int) -> tuple[Column, Column]:
    """(decimal, error) of a number written as text: more digits after the point than ``scale``
    are CBKE505, what is no number CBKE501."""
    number = text.rlike(r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)\s*$")
    exact = F.when(number, text).try_cast("decimal(38,18)")
    fits = F.length(F.regexp_extract(text, r"\.([0-9]*?)0*\s*$", 1)) <= scale
    value = F.when(number & fits, exact.try_cast(f"decimal(38,{scale})"))
    return value, F.when(text.isNull(), F.lit(None).cast("string")).when(~F.coalesce(number, F.lit(False)), F.lit("CBKE501")).when(~fits, F.lit("CBKE505"))


def overpunched(byte: Column, codepage: str) -> Column:
    """Whether one byte can end a signed zoned number."""
    return F.hex(byte).rlike("^(3[0-9]|7[BD]|4[1-9A-F]|5[0-2])$" if codepage == "ascii" else "^[CDF][0-9]$")


def overpunches(codepage: str) -> list[int]:
    """Every such byte, in order."""
    if codepage == "ascii":
        return sorted([*range(0x30, 0x3A), *map(ord, _PLUS + _MINUS)])
    return [zone << 4 | d for zone in (0xC, 0xD, 0xF) for d in range(10)]


# --- encode -----------------------------------------------------------------------------


def _fits(value: Column, f: Field) -> tuple[Column, Column, Column]:
    """(all digits, whether negative, error) of a value with the field's scale."""
    exact = value.cast("decimal(38,18)")
    scaled = F.round(exact, f.scale)
    whole = F.ltrim(F.replace(F.abs(scaled).cast(f"decimal(38,{f.scale})").cast("string"), F.lit("."), F.lit("")), F.lit("0"))
    error = F.when(scaled != exact, F.lit("CBKE505")).when(F.length(whole) > f.digits, F.lit("CBKE510"))
    if not f.signed:
        error = F.when(scaled < 0, F.lit("CBKE501")).otherwise(error)
    return F.lpad(whole, f.digits, "0"), (scaled < 0) & (whole != ""), error


def _encode_text(f: Field, value: Column, o: Options) -> Encoded:
    t = value.cast("string")
    pad = F.lit(bytes([codepages.blank(o.codepage)]) * f.size)
    data = F.concat(codepages.to_bytes(t, o.codepage), pad).substr(1, f.size)
    error = F.when(F.octet_length(F.encode(t, "UTF-8")) > f.size, F.lit("CBKE515")).when(~codepages.encodable(t, o.codepage), F.lit("CBKC301"))
    return Encoded(data, error)


def _encode_separate(f: Field, value: Column, o: Options) -> Encoded:
    """Digits beyond the field's scale are cut off; what doesn't fit is CBKE530."""
    exact = value.cast("decimal(38,18)")
    cut = exact - exact % F.lit(Decimal(1).scaleb(-f.scale)).cast(f"decimal({f.scale + 1},{f.scale})")
    digits, negative, _ = _fits(cut, f)
    whole = F.ltrim(F.replace(F.abs(cut).cast(f"decimal(38,{f.scale})").cast("string"), F.lit("."), F.lit("")), F.lit("0"))
    mark = F.when(negative, F.lit("-")).otherwise(F.lit("+"))
    data = codepages.to_bytes(F.concat(mark, digits) if f.sign == "leading" else F.concat(digits, mark), o.codepage)
    return Encoded(data, F.when(F.length(whole) > f.digits, F.lit("CBKE530")))


def _encode_zoned(f: Field, value: Column, o: Options, said: Column | None = None) -> Encoded:
    """``said``: the encoding that the record's metadata names for this field, or null."""
    if f.sign:
        return _encode_separate(f, value, o)
    page = "ascii" if o.codepage == "ascii" else "ebcdic"
    usual = o.zoned_override or (page if o.zoned == "codepage" else o.zoned)
    if o.zoned_override or said is None:
        return _encode_zones(f, value, usual == "ebcdic")
    a, e = _encode_zones(f, value, False), _encode_zones(f, value, True)
    return Encoded(F.when(F.coalesce(said, F.lit(usual)) == "ascii", a.data).otherwise(e.data), a.error)


def _encode_zones(f: Field, value: Column, ebcdic: bool) -> Encoded:
    digits, negative, error = _fits(value, f)
    data = _zone_bytes(f, digits, negative, ebcdic)
    if f.blank_zero:
        blank = b"\x40" if ebcdic else b" "
        data = F.when(value.cast("decimal(38,18)") == 0, F.lit(blank * f.size)).otherwise(data)
    return Encoded(data, error)


def _zone_bytes(f: Field, digits: Column, negative: Column, ebcdic: bool) -> Column:
    """All digits of a number as zoned bytes."""
    if not f.signed:
        return F.encode(F.translate(digits, _DIGITS, _latin(0xF)) if ebcdic else digits, "ISO-8859-1")
    head, last = F.substring(digits, 1, f.digits - 1), F.substring(digits, f.digits, 1)
    if ebcdic:
        last_of = lambda zone: F.translate(last, _DIGITS, _latin(zone))
        plus = F.when(F.ltrim(digits, F.lit("0")) == "", last_of(0xF)).otherwise(last_of(0xC))  # zero has the plain zone
        head = F.translate(head, _DIGITS, _latin(0xF))
        end = F.when(negative, last_of(0xD)).otherwise(plus)
    else:
        end = F.when(negative, F.translate(last, _DIGITS, _MINUS)).otherwise(F.translate(last, _DIGITS, _PLUS))
    return F.encode(F.concat(head, end), "ISO-8859-1")


def _encode_packed(f: Field, value: Column, o: Options) -> Encoded:
    digits, negative, error = _fits(value, f)
    return Encoded(_packed_bytes(f, digits, negative), error)


def _packed_bytes(f: Field, digits: Column, negative: Column) -> Column:
    sign = F.when(negative, F.lit("D")).otherwise(F.lit("C")) if f.signed else F.lit("F")
    return F.unhex(F.concat(F.lpad(digits, 2 * f.size - 1, "0"), sign))


def _encode_binary(f: Field, value: Column, o: Options) -> Encoded:
    low, high = (-(1 << (f.bits - 1)), (1 << (f.bits - 1)) - 1) if f.signed else (0, min((1 << f.bits) - 1, (1 << 63) - 1))
    d = value.cast("decimal(38,0)")
    ok = d.between(F.lit(low), F.lit(high)) & (value.cast("decimal(38,9)") == d)
    n = F.when(ok, d).cast("bigint")
    data = F.unhex(F.substring(F.lpad(F.hex(n), 16, "0"), 17 - 2 * f.size, 2 * f.size))
    return Encoded(data, F.when(~ok, F.lit("CBKE501")))


def _encode_float(f: Field, value: Column, o: Options) -> Encoded:
    single = f.kind == "float"
    v = value.cast("float").cast("double") if single and o.floats == "ieee" else value.cast("double")
    a = F.abs(v)
    finite = ~F.isnan(v) & (a != float("inf"))
    negative = F.coalesce(v < 0, F.lit(False))
    if o.floats == "ibm":
        bits = 24 if single else 56
        # The hexadecimal exponent: from the logarithm, then made exact by one step either way.
        e = F.floor(F.log2(a) / 4) + 1
        e = F.when(a / _power(16, e) >= 1, e + 1).when(a / _power(16, e) < 1 / 16, e - 1).otherwise(e)
        m = F.round(a / _power(16, e) * float(1 << bits)).cast("decimal(20,0)")
        carry = m >= F.lit(1 << bits).cast("decimal(20,0)")
        m, e = F.when(carry, F.lit(1 << (bits - 4)).cast("decimal(20,0)")).otherwise(m), F.when(carry, e + 1).otherwise(e)
        ok = finite & ((e < 64) | (a == 0))
        zero = (a == 0) | (e <= -64)
        field_ = F.when(zero, F.lit(0).cast("bigint")).otherwise((F.shiftleft((e + 64).cast("bigint"), bits)) + m.cast("bigint"))
        top = bits + 7
    else:
        width, bias, least = (23, 127, -126) if single else (52, 1023, -1022)
        e = F.floor(F.log2(a))
        scaled = lambda x: a / _power(2, F.floor(x / 2)) / _power(2, x - F.floor(x / 2))
        e = F.when(scaled(e) >= 2, e + 1).when(scaled(e) < 1, e - 1).otherwise(e)
        e = F.greatest(e, F.lit(least))
        m = (scaled(e) * float(1 << width)).cast("bigint")
        normal = F.when(m >= 1 << width, F.shiftleft((e + bias).cast("bigint"), width) + (m - (1 << width))).otherwise(m)
        field_ = F.when(a == 0, F.lit(0).cast("bigint")).otherwise(normal)
        top = 31 if single else 63
        ok = finite
    word = F.when(ok, field_)
    h = F.lpad(F.hex(word), 16, "0")
    h = F.substring(h, 17 - 2 * f.size, 2 * f.size)
    first = F.substring(h, 1, 1)
    h = F.when(negative, F.concat(F.translate(first, "01234567", "89ABCDEF"), F.substring(h, 2, 15))).otherwise(h)
    del top
    return Encoded(F.unhex(h), F.when(~ok, F.lit("CBKE531")))


def _encode_edited(f: Field, value: Column, o: Options) -> Encoded:
    digits, negative, error = _fits(value, f)
    if not f.signed:
        error = F.when(value < 0, F.lit("CBKE501")).otherwise(error)
    return Encoded(codepages.to_bytes(edited.encode(f, digits, negative), o.codepage), error)


_ENCODERS = {"text": _encode_text, "zoned": _encode_zoned, "packed": _encode_packed, "binary": _encode_binary, "float": _encode_float, "double": _encode_float, "edited": _encode_edited}


def _plain_number(f: Field, value: Column, o: Options, kind: DataType | None) -> tuple[Column, Column] | None:
    """(whether it holds, bytes) of a zoned or packed number whose type needs no rounding: its own
    text gives the digits. Null, what doesn't fit and all else are left to ``encode``."""
    if f.kind not in ("zoned", "packed") or f.sign or f.blank_zero:
        return None
    if isinstance(kind, DecimalType):
        before, after = kind.precision - kind.scale, kind.scale
        text = F.replace(F.abs(value).cast("string"), F.lit("."), F.lit("")) if after else F.abs(value).cast("string")
    elif isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        before, after = {ByteType: 3, ShortType: 5, IntegerType: 10, LongType: 19}[type(kind)], 0
        text = F.replace(value.cast("string"), F.lit("-"), F.lit(""))
    else:
        return None
    room = f.digits - f.scale
    if room < 1 or not after <= min(f.scale, 6):  # with more places a text may have an exponent
        return None
    fits = value.isNotNull()
    if before > room:
        limit = F.lit(10**room if after == 0 and room < 19 else Decimal(10**room))
        fits = (value < limit) & (value > -limit)
    if not f.signed:
        fits = (value >= 0) & fits
    digits = F.lpad(F.concat(text, F.lit("0" * (f.scale - after))) if f.scale > after else text, f.digits, "0")
    if f.kind == "packed":
        return fits, _packed_bytes(f, digits, value < 0)
    page = "ascii" if o.codepage == "ascii" else "ebcdic"
    return fits, _zone_bytes(f, digits, value < 0, (o.zoned_override or (page if o.zoned == "codepage" else o.zoned)) == "ebcdic")


def shortened(f: Field, value: Column, o: Options, kind: DataType | None, e: Encoded) -> Encoded:
    """What ``encode`` gave, with the short form before it, for a part of an array of the type ``kind`` (if known)."""
    plain = _plain_number(f, value, o, kind)
    return Encoded(F.when(plain[0], plain[1]).otherwise(e.data), e.error) if plain else e


def encode(f: Field, value: Column, o: Options, said: Column | None = None) -> Encoded:
    """Exactly ``f.size`` bytes; a null value or an error gives zero bytes. ``said``: the zoned
    encoding that metadata names."""
    e = _encode_zoned(f, value, o, said) if f.kind == "zoned" else _ENCODERS[f.kind](f, value, o)
    good = e.error.isNull() & e.data.isNotNull()
    return Encoded(F.when(good, e.data).otherwise(F.lit(b"\0" * f.size)), e.error)

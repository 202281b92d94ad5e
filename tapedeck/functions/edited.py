"""Edited pictures: the mask is compiled on the driver, into one expression each way.

A mask position is a digit (9), a suppressed digit (Z, blank when leading), a filled digit
(*), a zero, a separator (, /), the point, a currency sign, a sign (+ -), a blank (B) or the
two letters CR or DB. Suppressed positions keep stored zeros when encoding.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.layout import Field


def tokens(pic: str) -> list[str]:
    return re.findall(r"CR|DB|.", pic.replace("V", ""))


def pattern(pic: str) -> str:
    """What a text under the mask looks like."""
    one = {"9": "[0-9]", "Z": "[0-9 ]", "*": "[0-9*]", "0": "0", ",": "[, *]", "/": "/", ".": r"[. *]", "$": r"[$ ]", "+": "[-+ ]", "-": "[- ]", "B": " ", "CR": "(?:CR|  )", "DB": "(?:DB|  )"}
    return "^" + "".join(one[t] for t in tokens(pic)) + "$"


def _runs(pic: str) -> list[tuple[str, int, int]]:
    """(token, place, length): neighbouring digit places are one run of the token 9."""
    out, at = [], 0
    for t in tokens(pic):
        kind = "9" if t in "9Z*" else t
        if kind == "9" and out and out[-1][0] == "9" and out[-1][1] + out[-1][2] == at:
            out[-1] = ("9", out[-1][1], out[-1][2] + 1)
        else:
            out.append((kind, at, len(t)))
        at += len(t)
    return out


def decode(f: Field, text: Column) -> tuple[Column, Column]:
    """(decimal, error)."""
    kind = f"decimal({max(f.digits, 1)},{f.scale})"
    ok = text.rlike(pattern(f.pic))
    picks = [F.substring(text, at + 1, n) for t, at, n in _runs(f.pic) if t == "9"]
    digits = F.translate(F.concat(*picks), " *", "00") if picks else F.lit("0")
    signs = [(t, at, n) for t, at, n in _runs(f.pic) if t in ("+", "-", "CR", "DB")]
    negative = F.lit(False)
    for t, at, n in signs:  # of several the last one holds
        negative = F.substring(text, at + 1, n) == ("-" if t in "+-" else t)
    whole, part = F.substring(digits, 1, f.digits - f.scale), F.substring(digits, f.digits - f.scale + 1, f.scale)
    number = F.concat(F.when(negative, F.lit("-")).otherwise(F.lit("")), F.lit("0"), whole, *([F.lit("."), part] if f.scale else []))
    value = F.when(ok, number.cast(kind))
    # If only the marks of a sign are wrong, that is another fault.
    but_signs = "^" + "".join("." * len(t) if t in ("+", "-", "CR", "DB") else pattern(t)[1:-1] for t in tokens(f.pic)) + "$"
    error = F.when(~F.coalesce(ok, F.lit(False)), F.when(text.rlike(but_signs), F.lit("CBKD422")).otherwise(F.lit("CBKD421")) if signs else F.lit("CBKD421"))
    blank = F.trim(text) == ""
    if f.blank_zero:
        return F.when(blank, F.lit(0).cast(kind)).otherwise(value), F.when(blank, F.lit("CBKD423")).otherwise(error)
    return value, error


def encode(f: Field, digits: Column, negative: Column) -> Column:
    """The text of all digits (padded to the mask's) under the mask."""
    out, used = [], 0
    for t, _, n in _runs(f.pic):
        if t == "9":
            out.append(F.substring(digits, used + 1, n))
            used += n
        elif t == "+":
            out.append(F.when(negative, F.lit("-")).otherwise(F.lit("+")))
        elif t == "-":
            out.append(F.when(negative, F.lit("-")).otherwise(F.lit(" ")))
        elif t in ("CR", "DB"):
            out.append(F.when(negative, F.lit(t)).otherwise(F.lit("  ")))
        else:
            out.append(F.lit(" " if t == "B" else t))
    text = F.concat(*out)
    if f.blank_zero:
        return F.when(digits.rlike("^0*$"), F.lit(" " * f.size)).otherwise(text)
    return text

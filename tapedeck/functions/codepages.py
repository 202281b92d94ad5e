"""Code pages as ``translate`` arguments, so text conversion stays inside code generation."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\ue000"  # stands for U+0000, which ``translate`` would delete
# Where a page differs from the platform's, or from page 037.
_CHANGES = {
    "cp273": {0x59: "ß", 0xA1: "~", 0xBC: "¯"},
    "cp1140": {0x9F: "¤", 0xFF: "€"},
    "cp1047": {0xAD: "[", 0xBD: "]", 0x5F: "^", 0xB0: "¬", 0xBA: "Ý", 0xBB: "¨"},
}
# Number, description and blank of each page.
PAGES = {
    "ascii": (0, "ASCII", 0x20), "cp037": (37, "EBCDIC US/Canada", 0x40), "cp273": (273, "EBCDIC Germany/Austria", 0x40),
    "cp500": (500, "EBCDIC International", 0x40), "cp1047": (1047, "EBCDIC Open Systems", 0x40), "cp1140": (1140, "EBCDIC US/Canada with euro", 0x40),
}


@lru_cache
def page(name: str) -> str:
    """The 256 characters of a page."""
    if name not in PAGES or name == "ascii":
        raise ValueError(f"no such page: {name}")
    base = bytes(range(256)).decode({"cp1047": "cp037"}.get(name, name))
    changes = _CHANGES.get(name, {})
    return "".join(changes.get(i, c) for i, c in enumerate(base))


@lru_cache
def _arguments(name: str) -> tuple[str, str]:
    latin = bytes(range(256)).decode("latin-1")
    return latin, page(name).replace("\0", NUL)


#: Unmappable: control characters other than tab, line feed and carriage return.
CONTROLS = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]"


def to_text(raw: Column, name: str, policy: str = "error") -> Column:
    """Bytes as text. policy: what becomes of unmappable bytes: ``replace`` (U+FFFD), ``skip``,
    or ``error`` (kept here; ``unmappable`` tells)."""
    if name == "ascii":
        return F.decode(raw, "UTF-8")
    text = F.translate(F.decode(raw, "ISO-8859-1"), *_arguments(name))
    if policy == "error":
        return text
    return F.regexp_replace(text, CONTROLS, "�" if policy == "replace" else "")


def has_controls(text: Column) -> Column:
    """Whether a text made under the policy ``error`` holds an unmappable character."""
    return text.rlike(CONTROLS[:-1] + NUL + "]")


@lru_cache
def _control_bytes(name: str) -> str:
    """A class of the Latin-1 characters whose bytes the page maps to ``CONTROLS``."""
    return "[" + "".join(f"\\x{i:02X}" for i, c in enumerate(page(name)) if c < " " and c not in "\t\n\r") + "]"


def unmappable(raw: Column, name: str) -> Column:
    """Whether any byte is unmappable: told from the bytes, so no text is made for it."""
    return F.decode(raw, "ISO-8859-1").rlike(_control_bytes(name))


def to_bytes(text: Column, name: str) -> Column:
    if name == "ascii":
        return F.encode(text, "UTF-8")
    latin, chars = _arguments(name)
    # Characters that are in no page become a code point that is no Latin-1 byte: "?" on encode.
    return F.encode(F.translate(text, chars, latin.replace("\0", NUL)), "ISO-8859-1")


def encodable(text: Column, name: str) -> Column:
    """Whether each character is in the page."""
    if name == "ascii":
        return F.lit(True)
    return F.length(F.translate(text, page(name).replace("\0", ""), "")) == 0


def blank(name: str) -> int:
    return PAGES[name][2]

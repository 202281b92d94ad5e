"""Record layouts: declaration text to a tree of fields with offsets, on the driver alone.

Grammar: level numbers 01-49, 66 (alias), 77, 88 (condition); PIC, USAGE, OCCURS [DEPENDING
ON], REDEFINES, SYNCHRONIZED, BLANK WHEN ZERO, SIGN SEPARATE, VALUE. Fixed (columns 8-72) and
free source forms.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field, replace

from ..errors import LayoutError
from . import features

MAX_RECORD = 16 << 20
DIALECTS = ("normative", "zero", "one")


@dataclass
class Field:
    name: str
    level: int
    kind: str  # text, zoned, packed, binary, float, double, edited, group, condition, alias
    path: str = ""
    offset: int = 0
    size: int = 0  # of one element
    digits: int = 0
    scale: int = 0
    signed: bool = False
    sign: str = ""  # "leading" or "trailing" if separate
    pic: str = ""
    bits: int = 0
    occurs: int = 1  # most elements; 1 and not array: a single field
    least: int = 1
    array: bool = False
    counter: str = ""
    redefines: str = ""
    blank_zero: bool = False
    sync: bool = False
    padding: int = 0
    values: list = field(default_factory=list)  # condition: (low, high) pairs
    alias: tuple = ()  # alias: (first, last)
    members: list = field(default_factory=list)
    children: list = field(default_factory=list)

    @property
    def extent(self) -> int:
        return self.size * self.occurs

    @property
    def filler(self) -> bool:
        return self.name.startswith("_filler_") or self.name == "FILLER"

    def walk(self):
        yield self
        for c in self.children:
            yield from c.walk()


@dataclass
class Layout:
    fields: list[Field]
    lrecl: int
    dialect: str = "normative"
    codepage: str = "cp037"
    emit_filler: bool = False

    def walk(self):
        for f in self.fields:
            yield from f.walk()

    def find(self, name: str) -> Field:
        """By path, by name, then without regard to case."""
        every = list(self.walk())
        for same in (lambda f: f.path == name, lambda f: f.name == name, lambda f: f.path.lower() == name.lower() or f.name.lower() == name.lower()):
            if found := [f for f in every if same(f)]:
                return found[0]
        raise LayoutError("CBKS703", f"no field {name}")

    def top(self) -> list[Field]:
        """What a record's columns are: the level-01 group is inlined."""
        out = []
        for f in self.fields:
            out += f.children if f.kind == "group" and f.level == 1 and not f.array else [f]
        return out

    @property
    def tail_array(self) -> Field | None:
        return next((f for f in self.walk() if f.counter), None)

    def least(self, f: Field) -> int:
        """Fewest elements under the dialect."""
        return {"normative": f.least, "zero": 0, "one": max(1, f.least)}[self.dialect]

    def canonical(self) -> str:
        def of(f: Field) -> dict:
            d = {k: v for k, v in vars(f).items() if k not in ("children",) and v not in ("", [], (), 0, False)}
            return d | ({"children": [of(c) for c in f.children]} if f.children else {})

        return json.dumps([of(f) for f in self.fields], sort_keys=True, separators=(",", ":"))

    @property
    def fingerprint(self) -> str:
        inner = hashlib.sha256(self.canonical().encode()).hexdigest()
        return hashlib.sha256(f"{inner}{self.codepage}{int(self.emit_filler)}".encode()).hexdigest()

    def table(self, spark):
        """One row for each field, in declaration order."""
        rows = [(i, f.level, f.name, f.path, f.kind, f.offset, f.size, f.occurs, f.digits, f.scale, f.signed, f.pic, f.redefines or None, f.counter or None) for i, f in enumerate(self.walk())]
        return spark.createDataFrame(rows, "position int, level int, name string, path string, kind string, offset int, size int, occurs int, digits int, scale int, signed boolean, pic string, redefines string, counter string")


# --- source lines to statements ---------------------------------------------------------


def is_fixed_form(text: str) -> bool:
    """At least half of the lines have blanks or digits in columns 1-6 and an indicator in 7."""
    lines = [x for x in text.splitlines() if x.strip()]
    looks = sum(bool(re.match(r"^[ 0-9]{6}[ *\-/]", x)) for x in lines)
    return bool(lines) and 2 * looks >= len(lines)


def statements(text: str, inline_comments: bool = True) -> list[list[str]]:
    fixed, joined = is_fixed_form(text), ""
    for line in text.splitlines():
        if line.startswith("*"):
            continue
        if fixed:
            mark, body = line[6:7], line[7:72]
            if mark in ("*", "/"):
                continue
            joined = joined.rstrip("\n") + body.lstrip() + "\n" if mark == "-" else joined + body + "\n"
        elif not line.lstrip().startswith("*"):
            joined += line + "\n"
    if not inline_comments and "*>" in joined:
        raise LayoutError("CBKP001", "a comment inside a line")
    joined = re.sub(r"\*>.*", "", joined)
    out: list[list[str]] = [[]]
    for t in re.findall(r"'[^']*'\.?|\"[^\"]*\"\.?|[^\s]+", joined):
        end = t.endswith(".")
        t = t[:-1] if end else t
        if t and t != ",":
            out[-1].append(t.rstrip(",") if t[-1] == "," and len(t) > 1 and t[0] not in "'\"" else t)
        if end:
            out.append([])
    if out[-1]:
        raise LayoutError("CBKP001", f"no period after {' '.join(out[-1][:4])}")
    return [s for s in out if s]


# --- pictures ---------------------------------------------------------------------------


def expand(pic: str) -> str:
    """``X(3)`` as ``XXX``."""
    p = pic.upper()
    if re.search(r"\((?!\d+\))|\(0+\)", p):
        raise LayoutError("CBKP101", f"repetition in picture {pic}")
    return re.sub(r"(CR|DB|.)\((\d+)\)", lambda m: m[1] * int(m[2]), p)


def picture(pic: str) -> dict:
    e = expand(pic)
    if re.fullmatch(r"X+", e):
        return {"kind": "text", "size": len(e)}
    if m := re.fullmatch(r"(S?)(9*)(?:V(9*))?", e):
        digits, scale = len(m[2]) + len(m[3] or ""), len(m[3] or "")
        if not digits:
            raise LayoutError("CBKP101", f"no digits in picture {pic}")
        return {"kind": "zoned", "digits": digits, "scale": scale, "signed": bool(m[1]), "size": digits}
    if not re.fullmatch(r"S?(?:[9Z*0B,/.$+\-V]|CR|DB)+", e) or e.count(".") + e.count("V") > 1:
        raise LayoutError("CBKP101", f"invalid picture {pic}")
    body = e.lstrip("S")
    tail = re.split(r"[.V]", body)[1] if re.search(r"[.V]", body) else ""
    scale = sum(c in "9Z*" for c in tail)
    digits = sum(c in "9Z*" for c in body)
    return {"kind": "edited", "digits": digits, "scale": scale, "signed": bool(re.search(r"[+\-]|CR|DB", body)), "size": len(body.replace("V", "")), "pic": body}


# --- statements to fields ---------------------------------------------------------------


def _number(token: str | None, what: str) -> int:
    if token is None or not token.isdigit():
        raise LayoutError("CBKP001", f"{what}: a number is needed, not {token}")
    return int(token)


def _literal(t: str) -> str:
    figurative = {"ZERO": "0", "ZEROS": "0", "ZEROES": "0", "SPACE": " ", "SPACES": " "}
    return t[1:-1] if t[:1] in "'\"" else figurative.get(t.upper(), t)


def _statement(tokens: list[str], n_filler: int) -> Field:
    level = _number(tokens[0], "level")
    if not (1 <= level <= 49 or level in (66, 77, 88)):
        raise LayoutError("CBKP001", f"level {level}")
    rest = tokens[1:]
    clauses = {"PIC", "PICTURE", "USAGE", "COMP", "COMP-1", "COMP-2", "COMP-3", "BINARY", "OCCURS", "REDEFINES", "VALUE", "DISPLAY"}
    name = rest.pop(0).upper() if rest and rest[0].upper() not in clauses else "FILLER"
    if name == "FILLER":
        name = f"_filler_{n_filler}"
    f = Field(name, level, "group")
    up = [t.upper() for t in rest]
    i, usage, has_pic = 0, "", False
    peek = lambda k=0: up[i + k] if i + k < len(up) else None
    if level == 88:
        if up[:1] not in (["VALUE"], ["VALUES"]):
            raise LayoutError("CBKP001", f"condition {name} without VALUE")
        values = [_literal(t) if t.upper() not in ("THRU", "THROUGH") else None for t in rest[1:] if t.upper() not in ("IS", "ARE")]
        while values:
            low = values.pop(0)
            if values and values[0] is None:
                values.pop(0)
                f.values.append((low, values.pop(0)))
            else:
                f.values.append((low, low))
        f.kind = "condition"
        return f
    if level == 66:
        if peek() != "RENAMES":
            raise LayoutError("CBKP001", f"alias {name} without RENAMES")
        parts = re.split(r" (?:THRU|THROUGH) ", " ".join(up[1:]))
        qualified = [".".join(reversed(re.split(r" (?:OF|IN) ", p))) for p in parts]
        f.kind, f.alias = "alias", (qualified[0], qualified[-1])
        return f
    while i < len(up):
        t = up[i]
        i += 1
        if t in ("PIC", "PICTURE"):
            i += peek() == "IS"
            if peek() is None:
                raise LayoutError("CBKP101", f"{name}: no picture")
            for k, v in picture(rest[i]).items():
                setattr(f, k, v)
            f.pic, has_pic = f.pic or expand(rest[i]), True
            i += 1
        elif t == "USAGE":
            i += peek() == "IS"
        elif t in ("COMP", "COMPUTATIONAL", "BINARY"):
            usage = "binary"
        elif t in ("COMP-1", "COMPUTATIONAL-1"):
            usage = "float"
        elif t in ("COMP-2", "COMPUTATIONAL-2"):
            usage = "double"
        elif t in ("COMP-3", "COMPUTATIONAL-3", "PACKED-DECIMAL"):
            usage = "packed"
        elif t == "REDEFINES":
            f.redefines = peek() or ""
            i += 1
        elif t == "OCCURS":
            f.array, f.occurs = True, _number(peek(), f"{name} OCCURS")
            f.least, i = f.occurs, i + 1
            if peek() == "TO":
                f.occurs, i = _number(peek(1), f"{name} OCCURS"), i + 2
            i += peek() == "TIMES"
            if peek() == "DEPENDING":
                i += 1
                i += peek() == "ON"
                f.counter, i = peek() or "", i + 1
                if f.least == f.occurs and "TO" not in up:
                    f.least = 0
            elif f.least != f.occurs:
                raise LayoutError("CBKP001", f"{name}: a range of OCCURS needs DEPENDING ON")
            if f.occurs < max(1, f.least):
                raise LayoutError("CBKP001", f"{name}: OCCURS {f.least} TO {f.occurs}")
            while peek() in ("INDEXED", "BY", "ASCENDING", "DESCENDING", "KEY"):
                i += 2 if peek() in ("BY", "KEY") else 1
        elif t in ("SYNC", "SYNCHRONIZED"):
            f.sync = True
            i += peek() in ("LEFT", "RIGHT")
        elif t == "BLANK":
            i += peek() == "WHEN"
            if peek() not in ("ZERO", "ZEROS", "ZEROES"):
                raise LayoutError("CBKP001", f"{name}: BLANK WHEN ZERO")
            f.blank_zero, i = True, i + 1
        elif t in ("SIGN", "LEADING", "TRAILING", "SEPARATE"):
            i -= 1
            words = []
            while peek() in ("SIGN", "IS", "LEADING", "TRAILING", "SEPARATE", "CHARACTER"):
                words.append(peek())
                i += 1
            if "SEPARATE" not in words or not {"LEADING", "TRAILING"} & set(words):
                raise LayoutError("CBKP001", f"{name}: SIGN needs LEADING or TRAILING, and SEPARATE")
            f.sign = "leading" if "LEADING" in words else "trailing"
        elif t == "VALUE":
            i += 1 + (peek() == "IS")
        elif t in ("DISPLAY", "IS", "JUSTIFIED", "JUST", "RIGHT", "GLOBAL", "EXTERNAL"):
            pass
        else:
            raise LayoutError("CBKP001", f"{name}: unexpected {t}")
    if usage in ("float", "double"):
        if has_pic:
            raise LayoutError("CBKP001", f"{name}: a float has no picture")
        f.kind, f.size = usage, 4 if usage == "float" else 8
    elif usage:
        if f.kind != "zoned":
            raise LayoutError("CBKP011", f"{name}: {usage} needs a numeric picture")
        f.kind = usage
        if usage == "packed":
            f.size = f.digits // 2 + 1
        else:
            bits = [b for low, high, b in ((1, 4, 16), (5, 9, 32), (10, 18, 64)) if low <= f.digits <= high]
            if not bits:
                raise LayoutError("CBKP101", f"{name}: {f.digits} binary digits")
            f.bits, f.size, f.scale = bits[0], bits[0] // 8, 0  # a binary field's implied scale is dropped
    elif f.sign:
        if f.kind != "zoned" or f.blank_zero:
            raise LayoutError("CBKP001", f"{name}: SIGN SEPARATE needs a signed DISPLAY number without BLANK WHEN ZERO")
        f.size, f.signed = f.digits + 1, True
    if f.kind in ("packed", "zoned") and f.digits > 38:
        raise LayoutError("CBKP101", f"{name}: {f.digits} digits")
    return f


def _tree(flat: list[Field]) -> list[Field]:
    roots: list[Field] = []
    stack: list[Field] = []
    for f in flat:
        if f.level in (88, 66):
            if f.level == 66:
                stack = stack[:1]
            if not stack:
                raise LayoutError("CBKP001", f"{f.name} belongs to no field")
            stack[-1].children.append(f)
            continue
        while stack and (f.level == 77 or stack[-1].level >= f.level):
            stack.pop()
        if stack:
            if stack[-1].kind != "group":
                raise LayoutError("CBKP001", f"{f.name}: {stack[-1].name} has a picture and no parts")
            stack[-1].children.append(f)
        else:
            roots.append(f)
        stack.append(f)
    for f in (x for r in roots for x in r.walk()):
        if f.kind == "group" and not [c for c in f.children if c.kind not in ("condition", "alias")]:
            raise LayoutError("CBKP001", f"{f.name} has neither picture nor parts")
    return roots


def _name(fields: list[Field], parent: str = "") -> None:
    seen: dict[str, int] = {}
    for f in fields:
        n = seen[f.name] = seen.get(f.name, 0) + 1
        f.name = f.name if n == 1 else f"{f.name}__dup{n}"
        f.path = f"{parent}.{f.name}" if parent else f.name
        _name(f.children, f.path)


def _place(fields: list[Field], at: int) -> int:
    """Offsets from ``at``; returns what follows. A cluster of views is as large as its largest."""
    starts: dict[str, int] = {}
    end = at
    for f in fields:
        if f.kind in ("condition", "alias"):
            continue
        if f.redefines:
            if f.redefines not in starts:
                raise LayoutError("CBKP001", f"{f.name} redefines {f.redefines}, which is no field before it")
            here = starts[f.redefines]
        else:
            here = end
        align = {"binary": f.size, "float": 4, "double": 8}.get(f.kind, 1) if f.sync else 1
        f.padding = -here % align
        f.offset = here + f.padding
        starts[f.name.split("__dup")[0]] = starts[f.name] = here if f.redefines else f.offset
        if f.kind == "group":
            f.size = _place(f.children, f.offset) - f.offset
        else:
            for c in f.children:
                c.offset = f.offset
        end = max(end, f.offset + f.extent)
        if end > MAX_RECORD:
            raise LayoutError("CBKS141", f"{f.name} ends at byte {end}")
    return end


def _check_arrays(layout: Layout) -> None:
    order = list(layout.walk())

    def visit(f: Field, over: list[Field], last: bool) -> None:
        if f.counter:
            if any(p.array for p in over):
                raise LayoutError("CBKP022", f"{f.path} inside an array")
            if f.redefines or any(p.redefines for p in over):
                raise LayoutError("CBKP023", f"{f.path} under a redefinition")
            if not last:
                raise LayoutError("CBKP021", f"{f.path} is followed by fields")
            found = [c for c in order[: order.index(f)] if c.name == f.counter]
            chain = lambda c: [p for p in order if c.path == p.path or c.path.startswith(p.path + ".")]
            found = [c for c in found if c.kind in ("zoned", "packed", "binary") and not any(p.array or p.redefines for p in chain(c))]
            if not found:
                raise LayoutError("CBKS121", f"counter {f.counter} of {f.path}")
            f.counter = found[-1].path
        real = [c for c in f.children if c.kind not in ("condition", "alias")]
        for i, c in enumerate(real):
            if f.counter and any(x.counter for x in c.walk()):
                raise LayoutError("CBKP022", f"{c.path} inside {f.path}")
            visit(c, [*over, f], last and i == len(real) - 1)

    for i, f in enumerate(layout.fields):
        visit(f, [], i == len(layout.fields) - 1)


def _resolve_aliases(layout: Layout, deep: bool) -> None:
    storage = lambda f: [c for c in f.children if c.kind not in ("condition", "alias")]
    for root in layout.fields:
        siblings = storage(root)
        for a in [f for f in root.children if f.kind == "alias"]:
            def named(name: str, fields) -> int | None:
                return next((i for i, f in enumerate(fields) if f.name == name or f.path.endswith("." + name)), None)

            at, to = named(a.alias[0], siblings), named(a.alias[1], siblings)
            if at is None and to is None and a.alias[0] == a.alias[1]:  # one field of a group
                inner = [f for f in root.walk() if f.kind not in ("alias", "condition")]
                i = named(a.alias[0], inner)
                if i is None:
                    raise LayoutError("CBKS601", f"{a.name}: {a.alias[0]}")
                a.offset, a.size = inner[i].offset, inner[i].size
                a.members = [f.path for f in inner[i].walk() if f.kind not in ("alias", "condition", "group")]
                continue
            if at is None:
                raise LayoutError("CBKS601", f"{a.name}: {a.alias[0]}")
            if to is None:
                raise LayoutError("CBKS602", f"{a.name}: {a.alias[1]}")
            if at > to:
                raise LayoutError("CBKS604", f"{a.name}: {a.alias[1]} ends before {a.alias[0]}")
            span = siblings[at : to + 1]
            for f in (f for f in span if f.array):
                if f.counter:
                    raise LayoutError("CBKS612", f"{a.name} over {f.name}")
                if not deep:
                    raise LayoutError("CBKS607", f"{a.name} over {f.name}")
                if at != to:
                    raise LayoutError("CBKS611", f"{a.name} over {f.name}")
            views = sum(bool(f.redefines) for f in span)
            if views > (1 if deep else 0):
                raise LayoutError("CBKS610" if deep else "CBKS609", a.name)
            if at != to:
                if storage(span[0]) or any(storage(f) for f in span[1:-1]):
                    raise LayoutError("CBKS605", a.name)
                if storage(span[-1]):
                    raise LayoutError("CBKS606", a.name)
            a.offset, a.size = span[0].offset, span[-1].offset + span[-1].extent - span[0].offset
            inside = [f for f in root.walk() if f.kind not in ("alias", "condition", "group") and a.offset <= f.offset and f.offset + f.extent <= a.offset + a.size]
            a.members = [f.path for f in inside]


def parse(text: str, *, codepage: str = "cp037", dialect: str = "normative", emit_filler: bool = False, deep_aliases: bool = False, inline_comments: bool = True, flags: dict[str, bool] | None = None) -> Layout:
    """A layout of the declaration ``text``. Raises LayoutError with a stable code.

    ``inline_comments=False`` refuses ``*>``; ``flags`` change feature flags (see ``features``);
    ``deep_aliases`` is short for the flag renames_r4_r6.
    """
    if dialect not in DIALECTS:
        raise LayoutError("CBKP011", f"dialect {dialect}")
    on = features.flags(flags)
    flat, n = [], 0
    for s in statements(text, inline_comments):
        f = _statement(s, n)
        n += f.filler
        flat.append(f)
    if not flat:
        raise LayoutError("CBKP001", "no declarations")
    for f in flat:
        need = {"float": "comp_1", "double": "comp_2"}.get(f.kind, "sign_separate" if f.sign else "")
        if need and not on[need]:
            raise LayoutError("CBKP011", f"{f.name}: {need} is switched off")
    roots = _tree(flat)
    _name(roots)
    layout = Layout(roots, 0, dialect, codepage, emit_filler)
    layout.lrecl = _place([r for r in roots], 0)
    for f in layout.walk():
        if f.filler and not f.name.startswith("_filler_0000"):
            f.name = f"_filler_{f.offset:06d}"
    _name(roots)
    _check_arrays(layout)
    _resolve_aliases(layout, deep_aliases or on["renames_r4_r6"])
    return layout


def project(layout: Layout, names: list[str]) -> Layout:
    """The layout of the chosen fields: groups with their parts, aliases with their members,
    conditions of chosen fields, the counters of chosen arrays, and all parents. The record's
    length stays. Catalyst then prunes what isn't read."""
    keep: set[str] = set()
    for name in [n.strip() for part in names for n in part.split(",") if n.strip()]:
        f = layout.find(name)
        if f.kind == "alias" and not f.members:
            raise LayoutError("CBKS702", f"{f.path} covers no field")
        keep |= {x.path for x in f.walk()} | set(f.members)
    for f in list(layout.walk()):
        if f.counter and f.path in keep:
            if not any(c.path == f.counter for c in layout.walk()):
                raise LayoutError("CBKS701", f"{f.path} needs {f.counter}")
            keep.add(f.counter)

    def pruned(f: Field) -> Field | None:
        children = [c for c in map(pruned, f.children) if c]
        own = f.path in keep
        if f.kind == "group":
            real = [c for c in children if c.kind not in ("condition", "alias")]
            return replace(f, children=children) if real or own or children else None
        return replace(f, children=children) if own else None

    return replace(layout, fields=[f for f in map(pruned, layout.fields) if f])

"""Layout compiler: offsets, error codes, projection."""

import pytest

from tapedeck.errors import LayoutError, exit_code
from tapedeck.plans.layout import expand, is_fixed_form, parse, picture, project

SIMPLE = """       01  CUSTOMER-RECORD.
      * a comment
           05  CUSTOMER-ID             PIC 9(6).
           05  CUSTOMER-NAME           PIC X(30).
           05  ACCOUNT-BALANCE         PIC S9(7)V99 COMP-3.
           05  LAST-ACTIVITY-DATE      PIC 9(8).
           05  STATUS-CODE             PIC X(1).
"""


def test_offsets():
    l = parse(SIMPLE)
    assert is_fixed_form(SIMPLE) and l.lrecl == 50
    assert [(f.offset, f.size) for f in l.top()] == [(0, 6), (6, 30), (36, 5), (41, 8), (49, 1)]
    assert parse("01 R. 05 A PIC 9(4) COMP. 05 N PIC 9(3). 05 H PIC X(20). 05 I OCCURS 1 TO 100 DEPENDING ON N. 10 P PIC 9(6). 10 Q PIC X(15). 10 R PIC S9(5)V99 COMP-3.").lrecl == 2525
    c = parse("01 R. 05 T PIC X(2). 05 A. 10 X PIC 9(10). 10 Y PIC 9(8). 05 B REDEFINES A. 10 Z PIC 9(12). 10 W PIC S9(9)V99 COMP-3. 05 C REDEFINES A. 10 D PIC 9(8). 10 E PIC 9(3). 10 I OCCURS 5. 15 J PIC X(4). 05 FILLER PIC X(10).")
    assert c.lrecl == 43 and c.find("Z").offset == 2 and c.find("J").offset == 13 and c.find("R._filler_000033").offset == 33
    s = parse("01 R. 05 A PIC X. 05 B PIC 9(9) COMP SYNC. 05 C COMP-2 SYNC.")
    assert [(f.offset, f.padding) for f in s.top()] == [(0, 0), (4, 3), (8, 0)] and s.lrecl == 16


@pytest.mark.parametrize("code, text", [
    ("CBKP001", "01 R. 05 A PIC X(3)"), ("CBKP001", "01 R. 05 A OCCURS 1 TO 5 PIC X."), ("CBKP001", "01 R. 05 A PIC S9 SIGN TRAILING."),
    ("CBKP101", "01 R. 05 A PIC Q."), ("CBKP101", "01 R. 05 A PIC X(0)."), ("CBKP101", "01 R. 05 A PIC 9(19) COMP."), ("CBKP101", "01 R. 05 A PIC 9(3)P99."),
    ("CBKP021", "01 R. 05 N PIC 9. 05 A PIC X OCCURS 1 TO 5 DEPENDING ON N. 05 B PIC X."),
    ("CBKP022", "01 R. 05 N PIC 9. 05 G OCCURS 2. 10 A PIC X OCCURS 1 TO 5 DEPENDING ON N."),
    ("CBKP023", "01 R. 05 N PIC 9. 05 X PIC X(9). 05 G REDEFINES X. 10 A PIC X OCCURS 1 TO 5 DEPENDING ON N."),
    ("CBKS121", "01 R. 05 A PIC X OCCURS 1 TO 5 DEPENDING ON N."), ("CBKS121", "01 R. 05 N PIC X. 05 A PIC X OCCURS 1 TO 5 DEPENDING ON N."),
    ("CBKP001", "01 R. 05 B REDEFINES A PIC X."), ("CBKS141", "01 R. 05 A PIC X(9000) OCCURS 9000."), ("CBKP011", "01 R. 05 A PIC X(3) COMP-3."),
    ("CBKS601", "01 R. 05 A PIC X. 66 Z RENAMES Q."), ("CBKS602", "01 R. 05 A PIC X. 66 Z RENAMES A THRU Q."), ("CBKS604", "01 R. 05 A PIC X. 05 B PIC X. 66 Z RENAMES B THRU A."),
    ("CBKS607", "01 R. 05 A PIC X OCCURS 3. 66 Z RENAMES A."), ("CBKS609", "01 R. 05 A PIC X. 05 B REDEFINES A PIC X. 66 Z RENAMES A THRU B."),
    ("CBKS605", "01 R. 05 G. 10 A PIC X. 05 B PIC X. 66 Z RENAMES G THRU B."), ("CBKS606", "01 R. 05 B PIC X. 05 G. 10 A PIC X. 66 Z RENAMES B THRU G."),
    ("CBKS612", "01 R. 05 N PIC 9. 05 A PIC X OCCURS 1 TO 3 DEPENDING ON N. 66 Z RENAMES N THRU A."),
])
def test_error_codes(code, text):
    with pytest.raises(LayoutError) as e:
        parse(text)
    assert e.value.code == code


@pytest.mark.parametrize("code, text", [
    ("CBKS610", "01 R. 05 A PIC X. 05 B REDEFINES A PIC X. 05 C REDEFINES A PIC X. 66 Z RENAMES A THRU C."),
    ("CBKS611", "01 R. 05 A PIC X. 05 B PIC X OCCURS 3. 66 Z RENAMES A THRU B."),
])
def test_error_codes_of_deep_aliases(code, text):
    with pytest.raises(LayoutError) as e:
        parse(text, flags={"renames_r4_r6": True})
    assert e.value.code == code


def test_flags_and_comments():
    for text, flag in (("01 R. 05 A COMP-1.", "comp_1"), ("01 R. 05 A COMP-2.", "comp_2"), ("01 R. 05 A PIC S9 SIGN LEADING SEPARATE.", "sign_separate")):
        parse(text)
        with pytest.raises(LayoutError, match="CBKP011"):
            parse(text, flags={flag: False})
    assert parse("01 R. 05 A PIC X. *> note\n").lrecl == 1
    with pytest.raises(LayoutError, match="CBKP001"):
        parse("01 R. 05 A PIC X. *> note\n", inline_comments=False)
    a = parse("01 R. 05 G. 10 A PIC X(2). 10 B PIC X(3). 05 C PIC X. 66 Z RENAMES B OF G.").find("Z")
    assert (a.offset, a.size, a.members) == (2, 3, ["R.G.B"])


def test_pictures():
    assert expand("S9(3)V99") == "S999V99" and picture("S9(7)V99") == {"kind": "zoned", "digits": 9, "scale": 2, "signed": True, "size": 9}
    p = picture("$ZZ,ZZ9.99CR")
    assert (p["kind"], p["digits"], p["scale"], p["signed"], p["size"]) == ("edited", 7, 2, True, 12)


def test_names_projection_and_fingerprint():
    l = parse("01 R. 05 A PIC X. 05 A PIC 9. 05 N PIC 9(2). 05 G OCCURS 0 TO 9 DEPENDING ON N. 10 P PIC X. 66 Z RENAMES A THRU N.")
    assert [f.name for f in l.top()][:2] == ["A", "A__dup2"]
    p = project(l, ["p"])
    assert [f.name for f in p.walk()] == ["R", "N", "G", "P"] or [f.name for f in p.walk()] == ["R", "G", "P"]
    assert {f.name for f in project(l, ["G"]).walk()} == {"R", "N", "G", "P"} and project(l, ["G"]).lrecl == l.lrecl
    assert {f.name for f in project(l, ["Z"]).walk()} >= {"Z", "A", "A__dup2", "N"}
    with pytest.raises(LayoutError) as e:
        project(l, ["nothing"])
    assert e.value.code == "CBKS703"
    assert l.fingerprint == parse("01 R. 05 A PIC X. 05 A PIC 9. 05 N PIC 9(2). 05 G OCCURS 0 TO 9 DEPENDING ON N. 10 P PIC X. 66 Z RENAMES A THRU N.").fingerprint != parse("01 R. 05 A PIC X.").fingerprint


def test_dialects_and_exit_codes():
    text = "01 R. 05 N PIC 9. 05 A PIC X OCCURS 3 TO 9 DEPENDING ON N."
    assert [parse(text, dialect=d).least(parse(text).tail_array) for d in ("normative", "zero", "one")] == [3, 0, 3]
    assert [exit_code(x) for x in ([], ["CBKD412"], ["CBKD401"], ["CBKE515"], ["CBKF221"], ["CBKP001"])] == [0, 0, 2, 3, 4, 1]

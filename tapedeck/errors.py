"""Error codes, a stable and observable contract, and what follows from them."""

from __future__ import annotations

# The error codes and what they mean.
CODES = {
    "CBKP001": "syntax error", "CBKP011": "unsupported clause", "CBKP021": "counter-dependent array not at the tail",
    "CBKP022": "nested counter-dependent array", "CBKP023": "counter-dependent array under a redefinition",
    "CBKP051": "unsupported edited picture", "CBKP101": "invalid picture",
    "CBKS121": "counter not found", "CBKS141": "record too large", "CBKS301": "counter above the maximum",
    "CBKS302": "counter below the minimum", "CBKS601": "alias start not found", "CBKS602": "alias end not found",
    "CBKS603": "alias range not contiguous", "CBKS604": "alias range reversed", "CBKS605": "alias start crosses a group",
    "CBKS606": "alias end crosses a group", "CBKS607": "alias over an array", "CBKS608": "qualified alias name not found",
    "CBKS609": "alias over a redefinition", "CBKS610": "alias over several redefinitions", "CBKS611": "alias over part of an array",
    "CBKS612": "alias over a counter-dependent array", "CBKS701": "counter of a selected array missing",
    "CBKS702": "alias without members", "CBKS703": "selected field not found", "CBKR211": "reserved bytes of a descriptor not zero",
    "CBKC201": "JSON write error", "CBKC301": "unmappable byte or character", "CBKD101": "invalid field",
    "CBKD301": "record too short", "CBKD302": "invalid number of elements", "CBKD401": "invalid packed nibble",
    "CBKD410": "zoned overflow", "CBKD411": "invalid zoned sign or digit", "CBKD412": "blank field read as zero",
    "CBKD413": "invalid zone", "CBKD414": "mixed zones", "CBKD415": "ambiguous zones", "CBKD421": "invalid edited format",
    "CBKD422": "edited sign mismatch", "CBKD423": "blank edited field read as zero", "CBKD431": "float not a number",
    "CBKD432": "float infinite", "CBKI001": "invalid state", "CBKE501": "type mismatch or out of range",
    "CBKE505": "scale mismatch", "CBKE510": "numeric overflow", "CBKE515": "text too long", "CBKE521": "array length out of bounds",
    "CBKE530": "sign encode error", "CBKE531": "float overflow", "CBKF102": "record length invalid",
    "CBKF104": "descriptor looks like text", "CBKF221": "truncated", "CBKA001": "baseline error", "CBKW001": "schema conversion",
    "CBKW002": "no type for a field", "CBKW003": "too many digits for a decimal", "CBKW004": "batch not built", "CBKW005": "file not written",
}
WARNINGS = frozenset({"CBKD412", "CBKD423", "CBKS301", "CBKS302", "CBKR211"})
# Exit code by family.
EXIT = {"CBKD": 2, "CBKE": 3, "CBKF": 4, "CBKI": 5}


class LayoutError(ValueError):
    """A layout, a selection or a whole file that cannot be used."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def exit_code(codes: list[str]) -> int:
    """0 without errors; else that of the first family found in the order D, E, F, I; 1 otherwise."""
    bad = [c for c in codes if c not in WARNINGS]
    return next((n for family, n in EXIT.items() if any(c.startswith(family) for c in bad)), 1 if bad else 0)


def severity(code: str) -> str:
    return "warning" if code in WARNINGS else "fatal" if code[:4] in ("CBKI", "CBKP", "CBKS") else "error"

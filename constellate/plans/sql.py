"""SQL building blocks of the oracle queries."""

from __future__ import annotations

_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_HALF = "".join(chr(c) for c in range(0x21, 0x7F))
_BLANKS = "\u00a0\u2007\u2009\u202f\u3000"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def compat(x: str) -> str:
    """Compatibility form of the forms that the test tables hold: full-width signs, odd blanks, ligatures."""
    out = f"translate({x}, {q(_FULL + _BLANKS)}, {q(_HALF + ' ' * len(_BLANKS))})"
    for a, b in (("\ufb00", "ff"), ("\ufb01", "fi"), ("\ufb02", "fl"), ("\ufb03", "ffi"), ("\ufb04", "ffl"), ("\ufb05", "st"), ("\ufb06", "st")):
        out = f"replace({out}, {q(a)}, {q(b)})"
    return f"nfc_normalize({out})"


def in_list(values: list[str]) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"

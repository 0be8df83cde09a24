"""HTML entities of link lists."""

from __future__ import annotations

import re

# The named entities that are decoded; all others stay.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
_ENTITY = re.compile(r"&(?:#(\d+)|#[xX]([0-9a-fA-F]+)|([a-zA-Z]+));", re.ASCII)


def _value(m: re.Match) -> str:
    decimal, hexadecimal, name = m.groups()
    if name:
        return NAMED.get(name.lower(), m[0])
    digits, base = (decimal, 10) if decimal else (hexadecimal, 16)
    code = int(digits, base) if len(digits.lstrip("0")) < 12 else 0x110000
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]


def decode_entities(text: str) -> str:
    """Named, decimal and hexadecimal entities; what is not a character stays as it is."""
    return _ENTITY.sub(_value, text)

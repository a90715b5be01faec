"""Cleaning raw report text.

These functions take and give SQL text: a raw row has some forty columns, and text
reaches the planner in one call where column objects need hundreds.
"""

from __future__ import annotations

from .. import schema as S

# --- fixed values: characters counted as white space at the ends of text ---
WHITESPACE = (
    "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
NUMBER_PATTERN = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
# No number holds any of these; what is left is a number or fails to cast.
NOT_IN_NUMBERS = "[^0-9eE.+ \\t\\n\\r\\f-]"


def _literal(text: str) -> str:
    escaped = "".join(f"\\u{ord(c):04x}" if not c.isprintable() or c in "'\\\xa0" else c for c in text)
    return f"'{escaped}'"


_TOKENS = ", ".join(_literal(token) for token in S.NULL_TOKENS)
_SPACES = _literal(WHITESPACE)


def null_tokens(text: str) -> str:
    """Spellings of a missing value become null."""
    return f"if({text} in ({_TOKENS}), null, {text})"


def strip(text: str) -> str:
    return f"btrim({text}, {_SPACES})"


def clean_string(text: str) -> str:
    """Stripped text; empty becomes null."""
    return f"nullif({strip(text)}, '')"


def coerce_numeric(text: str) -> str:
    """Text to double; null where the whole text is not one number.

    The cast trims, but it also takes ``1.5d``, ``NaN`` and hexadecimal digits.
    """
    return f"if({text} rlike '{NOT_IN_NUMBERS}', null, try_cast({text} as double))"


def to_units_e4(number: str) -> str:
    """A double to whole 1e-4 units; null where these are beyond ``bigint``."""
    return f"if(abs({number}) < {S.UNITS_LIMIT:.0f}D, floor({number} * 10000 + 0.5D), null)"


def to_int_trunc(number: str) -> str:
    """Toward zero, as ``bigint``; null beyond its range."""
    return f"try_cast({number} as bigint)"

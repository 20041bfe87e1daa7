"""Spreadsheet values in Python: numbers (float), str, bool, None (blank); errors are raised."""

from __future__ import annotations

import math
import re


class CellError(Exception):
    """A formula error such as #DIV/0!."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


_NUMBER = re.compile(r"[+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+", re.A)
# Fixed value: white space that ends of texts lose.
WHITE = "\t\n\x0b\x0c\r \xa0                　﻿"


def parsed(text: str) -> float:
    """The number a text spells, 0 for a blank one, NaN for any other."""
    text = text.strip(WHITE)
    if not text:
        return 0.0
    if not _NUMBER.fullmatch(text):
        return math.nan
    if text[:2].lower() in ("0x", "0o", "0b"):
        return float(int(text, 0))
    return float(text.replace("Infinity", "inf"))


def number(value) -> float:
    if value is None or value == "":
        return 0.0
    if isinstance(value, bool):
        return float(value)
    result = parsed(value) if isinstance(value, str) else float(value)
    if not math.isfinite(result):
        raise CellError("#VALUE!")
    return result


def shown(x: float) -> str:
    """Shortest digits that read back as x; exponents from 1e21 and below 1e-6."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    if x == 0:
        return "0"
    mantissa, exponent = f"{x!r}e0".lower().split("e")[:2] if "e" not in repr(x) else repr(x).split("e")
    sign, mantissa = ("-", mantissa[1:]) if mantissa.startswith("-") else ("", mantissa)
    whole, _, part = mantissa.partition(".")
    digits = (whole + part).lstrip("0")
    point = len(whole) + int(exponent) - (len(whole + part) - len(digits))
    digits = digits.rstrip("0")
    if 0 < point <= 21:
        body = digits + "0" * (point - len(digits)) if len(digits) <= point else f"{digits[:point]}.{digits[point:]}"
    elif -6 < point <= 0:
        body = "0." + "0" * -point + digits
    else:
        body = digits[0] + ("." + digits[1:] if len(digits) > 1 else "") + f"e{point - 1:+d}"
    return sign + body


def text(value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    return value if isinstance(value, str) else shown(float(value))


def truthy(value) -> bool:
    return bool(value) and not (isinstance(value, float) and math.isnan(value))


def code_units(value: str) -> int:
    return len(value.encode("utf-16-le")) // 2


def compare(left, right, operator: str) -> bool:
    """Texts without case; a blank is 0 or '' as the other side is; equality is within a type, order is by number across types."""
    left, right = (x.lower() if isinstance(x, str) else x for x in (left, right))
    if left is None:
        left = "" if isinstance(right, str) else 0.0
    if right is None:
        right = "" if isinstance(left, str) else 0.0
    if operator in ("=", "<>"):
        same_type = isinstance(left, str) == isinstance(right, str) and isinstance(left, bool) == isinstance(right, bool)
        return (same_type and left == right) == (operator == "=")
    if not (isinstance(left, str) and isinstance(right, str)):
        left, right = (parsed(x) if isinstance(x, str) else float(x) for x in (left, right))
    else:
        left, right = (x.encode("utf-16-be") for x in (left, right))
    return {"<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right}[operator]


def rounded(x: float, digits: float) -> float:
    """Half away from zero at the given digits, with a nudge for binary halves."""
    places = math.trunc(digits)
    if abs(places) > 308:
        raise CellError("#NUM!")
    scale = 10.0**places
    size = abs(x) * scale
    whole = math.floor(size + size * 4 * 2.0**-52 + 0.5) if math.isfinite(size) else size
    return math.copysign(whole, x) / scale if x else 0.0

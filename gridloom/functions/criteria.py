"""The criterion language of SUMIF, COUNTIF and AVERAGEIF, for Python values and as a regular expression for columns."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from gridloom.functions.values import WHITE, compare, parsed, text


@dataclass(frozen=True)
class Criterion:
    """``operator`` against ``operand``; ``pattern``: a whole-text expression over lower case instead, for = and <> on texts."""

    operator: str
    operand: object
    pattern: str | None = None
    as_text: bool = False

    def holds(self, value) -> bool:
        if self.pattern is not None:
            return (re.fullmatch(self.pattern, text(value).lower(), re.S) is not None) == (self.operator == "=")
        return compare(text(value) if self.as_text else value, self.operand, self.operator)


def wildcards(query: str) -> str:
    """* and ? as an expression; ~ takes the next character as it is."""
    out, i = [], 0
    while i < len(query):
        c = query[i]
        if c == "~" and i + 1 < len(query):
            i += 1
            out.append(re.escape(query[i]))
        else:
            out.append({"*": ".*", "?": "."}.get(c) or re.escape(c))
        i += 1
    return "".join(out)


def criterion(expected) -> Criterion:
    if not isinstance(expected, str):
        return Criterion("=", expected)
    found = re.fullmatch(r"(<>|<=|>=|=|<|>)([^\n\r  ]*)", expected)
    operator, query = (found[1], found[2]) if found else ("=", expected)
    if query.strip(WHITE) and math.isfinite(value := parsed(query)):
        return Criterion(operator, value)
    if operator in ("=", "<>"):
        return Criterion(operator, query, wildcards(query.lower()))
    return Criterion(operator, query, as_text=True)

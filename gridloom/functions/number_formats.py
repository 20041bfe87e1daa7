"""Number formats of spreadsheets: sections, digits, scaling, percent, exponents, fractions, dates and elapsed times.

A code is compiled once to sections of tokens. What a code asks for and this module does not know is
shown as General.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction
from functools import lru_cache

# The first days of both date systems, names, and the width of General.
EPOCH, EPOCH_1904, LAST_DAY = datetime(1899, 12, 30), datetime(1904, 1, 1), 2_958_466
DAYS, MONTHS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"), ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
GENERAL_DIGITS = 11

_TOKEN = re.compile(
    r"""(?P<text>"[^"]*")|\\(?P<escaped>.)|_(?P<space>.)|\*(?P<fill>.)|\[(?P<bracket>[^\]]*)\]|(?P<general>general)|(?P<half>am/pm|a/p)"""
    r"""|(?P<exponent>e[+-])|(?P<date>y+|m+|d+|h+|s+(?:\.0+)?)|(?P<digit>[0#?])|(?P<mark>[.,/%@])|(?P<other>.)""",
    re.I | re.S,
)
_CONDITION = re.compile(r"(<=|>=|<>|=|<|>)\s*(-?\d+(?:\.\d+)?)")


@dataclass
class Section:
    tokens: list[tuple[str, str]] = field(default_factory=list)
    condition: tuple[str, float] | None = None

    def has(self, kind: str, text: str | None = None) -> bool:
        return any(k == kind and (text is None or t == text) for k, t in self.tokens)


@lru_cache(4096)
def compiled(code: str) -> tuple[Section, ...]:
    out = [Section()]
    for found in _TOKEN.finditer(code):
        kind, text = found.lastgroup, found[found.lastgroup]
        if kind == "other" and text == ";":
            out.append(Section())
        elif kind == "bracket":
            test = _CONDITION.fullmatch(text)
            if test:
                out[-1].condition = test[1], float(test[2])
            elif re.fullmatch("h+|m+|s+", text, re.I):
                out[-1].tokens.append(("elapsed", text.lower()))
            elif text.startswith("$"):
                out[-1].tokens.append(("text", text[1:].partition("-")[0]))
        elif kind in ("text", "escaped", "other"):
            out[-1].tokens.append(("text", text[1:-1] if kind == "text" else text))
        elif kind == "space":
            out[-1].tokens.append(("text", " "))
        elif kind != "fill":
            out[-1].tokens.append((kind, text.lower() if kind in ("date", "half", "general", "exponent") else text))
    return tuple(out)


def general(x: float) -> str:
    """At most 11 characters of digits and point; exponents beyond."""
    if x == 0 or not math.isfinite(x):
        return "0" if x == 0 else str(x)
    size = math.floor(math.log10(abs(x)))
    if x == math.floor(x) and size < GENERAL_DIGITS:
        return str(int(x))
    if -5 <= size < GENERAL_DIGITS:
        text = f"{_half_up(abs(x), max(0, GENERAL_DIGITS - 2 - max(size, 0))):f}"
        text = text.rstrip("0").rstrip(".") if "." in text else text
    else:
        digits, _, power = f"{abs(x):.5E}".partition("E")
        text = f"{digits.rstrip('0').rstrip('.')}E{power[0]}{power[1:].lstrip('0').zfill(2)}"
    return ("-" if x < 0 and text != "0" else "") + text


def _half_up(x: float, places: int) -> Decimal:
    return Decimal(repr(x)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP) if abs(x) < 1e20 else Decimal(x).quantize(Decimal(1))


def _section(sections: tuple[Section, ...], x: float) -> tuple[Section, float] | None:
    """The section for a number, and the number as that section shows it."""
    numeric = [s for s in sections if not s.has("mark", "@")] or [Section([("general", "general")])]
    if any(s.condition for s in numeric):
        tests = {"<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "=": lambda a, b: a == b, "<>": lambda a, b: a != b}
        for i, s in enumerate(numeric):
            if s.condition is None or tests[s.condition[0]](x, s.condition[1]):
                return s, abs(x) if i and x < 0 else x
        return None
    if x < 0 and len(numeric) > 1:
        return numeric[1], -x
    if x == 0 and len(numeric) > 2:
        return numeric[2], 0.0
    return numeric[0], x


def shown(code: str | None, value, date1904: bool = False) -> str:
    """A cell's value as its format shows it; texts by the section of texts."""
    sections = compiled(code or "General")
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, str):
        own = next((s for s in sections if s.has("mark", "@")), None)
        return value if own is None else "".join(value if (k, t) == ("mark", "@") else t for k, t in own.tokens if k == "text" or (k, t) == ("mark", "@"))
    found = _section(sections, float(value))
    if found is None:
        return "#" * 8
    section, x = found
    if not section.tokens:
        return ""
    if section.has("general"):
        return "".join(general(x) if k == "general" else t for k, t in section.tokens if k in ("general", "text"))
    if section.has("date") or section.has("elapsed"):
        return _date(section, x, date1904)
    if not section.has("digit"):
        sign = "-" if x < 0 else ""
        return sign + "".join("%" if t == "%" else t for k, t in section.tokens if k == "text" or t == "%")
    if section.has("mark", "/"):
        return _fraction(section, x)
    return _number(section, x)


def _number(section: Section, x: float) -> str:
    tokens = section.tokens
    last = max(i for i, (k, _) in enumerate(tokens) if k == "digit")
    power = next((i for i, (k, _) in enumerate(tokens) if k == "exponent"), None)
    point = next((i for i, t in enumerate(tokens) if t == ("mark", ".")), None)
    end = power if power is not None else last + 1
    whole = [i for i, (k, _) in enumerate(tokens) if k == "digit" and i < (end if point is None else point)]
    part = [i for i, (k, _) in enumerate(tokens) if k == "digit" and point is not None and point < i < end]
    commas = [i for i, t in enumerate(tokens) if t == ("mark", ",")]
    grouped = bool(whole) and any(whole[0] < i < whole[-1] for i in commas)
    after = whole[-1] if point is None and whole else last
    scale = sum(1 for i in commas if (i > after or point is not None and whole and whole[-1] < i < point))
    x = x * 100 ** sum(t == ("mark", "%") for t in tokens) / 1000**scale
    exponent, size = 0, abs(x)
    if power is not None and size:
        step = max(1, len(whole))
        exponent = math.floor(math.log10(size))
        exponent = exponent - exponent % step if step > 1 else exponent
        size = size / 10.0**exponent
        if _half_up(size, len(part)) >= 10**step:
            exponent += step
            size /= 10.0**step
    text = f"{_half_up(size, len(part)):f}"
    head, _, tail = text.partition(".")
    head = head.lstrip("0")
    digits = _placed([tokens[i][1] for i in whole], head, grouped)
    while tail and part and tail[-1] == "0" and tokens[part[len(tail) - 1]][1] == "#":
        tail = tail[:-1]
    out, first = [], True
    for i, (kind, t) in enumerate(tokens):
        if i in whole:
            out.append(digits if first else "")
            first = False
        elif i in part:
            n = part.index(i)
            out.append(tail[n] if n < len(tail) else "")
        elif kind == "digit":
            continue
        elif i == point:
            out.append((digits if first and not whole else "") + ".")
        elif kind == "exponent":
            width = sum(1 for k, _ in tokens[i:] if k == "digit")
            out.append(t[0].upper() + ("-" if exponent < 0 else "+" if t[1] == "+" else "") + str(abs(exponent)).zfill(width))
        elif kind == "text" or t == "%":
            out.append(t)
    negative = x < 0 and any(c in "123456789" for c in text)
    return ("-" if negative else "") + "".join(out)


def _placed(places: list[str], digits: str, grouped: bool) -> str:
    """Digits in their places from the right; more digits than places all stand at the first."""
    least = len(places) - next((i for i, p in enumerate(places) if p != "#"), len(places))
    digits = digits.rjust(least, "0")
    if grouped:
        digits = f"{int(digits):,}".rjust(0) if digits and len(digits) == len(str(int(digits))) else re.sub(r"(?<=\d)(?=(\d{3})+$)", ",", digits)
    blanks = sum(1 for p in places[: max(0, len(places) - len(digits))] if p == "?")
    return " " * blanks + digits


def _fraction(section: Section, x: float) -> str:
    kinds = section.tokens
    slash = next(i for i, t in enumerate(kinds) if t == ("mark", "/"))
    below = "".join(t for k, t in kinds[slash + 1 :] if k == "digit" or k == "text" and t.isdigit())
    fixed = int(below) if below.isdigit() and int(below) else None
    above = [i for i, (k, _) in enumerate(kinds[:slash]) if k == "digit"]
    mixed = any(kinds[i] == ("text", " ") for i in range(above[0], above[-1])) if above else False
    size = abs(x)
    base = math.floor(size) if mixed else 0
    rest = Fraction(size - base)
    near = Fraction(round(rest * fixed), fixed) if fixed else rest.limit_denominator(10 ** max(1, len(below)) - 1)
    if mixed and near == 1:
        base, near = base + 1, Fraction(0)
    below_, above_ = (fixed, round(near * fixed)) if fixed else (near.denominator, near.numerator)
    sign = "-" if x < 0 else ""
    if mixed and not near:
        return sign + str(base)
    lead = f"{base} " if mixed and base else ""
    return f"{sign}{lead}{above_}/{below_}"


def _date(section: Section, x: float, date1904: bool) -> str:
    tokens = section.tokens
    if x < 0 or x >= LAST_DAY:
        return "#" * 8
    places = max((len(t) - t.index(".") - 1 for k, t in tokens if k == "date" and "." in t), default=0)
    elapsed = section.has("elapsed")
    unit = 10**places
    ticks = int((Decimal(repr(x)) * 86_400 * unit).to_integral_value(ROUND_HALF_UP))
    seconds, fraction = divmod(ticks, unit)
    # the 1900 system has a 29 February that never was
    days = seconds // 86_400 + (1 if not date1904 and seconds // 86_400 < 60 else 0)
    at = (EPOCH_1904 if date1904 else EPOCH) + timedelta(days=days)
    ghost = not date1904 and seconds // 86_400 == 60
    hour, minute, second = seconds % 86_400 // 3600, seconds % 3600 // 60, seconds % 60
    half = section.has("half")
    out = []
    for i, (kind, t) in enumerate(tokens):
        if kind == "elapsed":
            total = {"h": seconds // 3600, "m": seconds // 60, "s": seconds}[t[0]]
            out.append(str(total).zfill(len(t)))
        elif kind == "half":
            name = "AM" if hour < 12 else "PM"
            out.append(name if len(t) > 3 else name[0])
        elif kind == "date":
            before = next((u[0] for k, u in reversed(tokens[:i]) if k in ("date", "elapsed")), "")
            after = next((u[0] for k, u in tokens[i + 1 :] if k in ("date", "elapsed")), "")
            if t[0] == "m" and len(t) <= 2 and (before == "h" or after == "s"):
                out.append(str(minute).zfill(len(t)))
            elif t[0] == "m":
                out.append({1: str(at.month), 2: f"{at.month:02}", 3: MONTHS[at.month - 1][:3], 5: MONTHS[at.month - 1][0]}.get(len(t), MONTHS[at.month - 1]) if not ghost else {1: "2", 2: "02", 3: "Feb", 5: "F"}.get(len(t), "February"))
            elif t[0] == "y":
                out.append(f"{at.year % 100:02}" if len(t) <= 2 else f"{at.year:04}")
            elif t[0] == "d":
                day = 29 if ghost else at.day
                name = DAYS[(seconds // 86_400 + (5 if date1904 else 6)) % 7]
                out.append({1: str(day), 2: f"{day:02}", 3: name[:3]}.get(len(t), name))
            elif t[0] == "h":
                shown_hour = (hour % 12 or 12) if half else hour
                out.append(str(shown_hour).zfill(min(2, len(t))))
            else:
                whole, _, part = t.partition(".")
                out.append(str(second).zfill(min(2, len(whole))) + (f".{str(fraction).zfill(places)[: len(part)]}" if part else ""))
        elif kind == "text" or kind == "mark" and t in "/.,":
            out.append(t)
        elif kind == "digit" and elapsed:
            out.append("")
    return "".join(out)

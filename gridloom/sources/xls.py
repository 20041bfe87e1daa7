"""Binary workbooks (BIFF8 in a compound file) as the tables of ``xlsx``: cell, sheet, sheet_info, merge, column, row, xf, num_fmt, defined_name, workbook.

Records are read one after another; those of sheets that are not wanted are skipped by their
place. Formulas are written back from their stored tokens; what a formula needs that is not
known here leaves it blank, beside its saved value. Encrypted files are refused.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cached_property

from pyspark.sql import SparkSession

from gridloom.functions.cells import column_letters
from gridloom.sources import xlsx
from gridloom.sources.files import Window
from gridloom.sources.ole import streams

# Types of records.
BOF, EOF, CONTINUE, PASSWORD, SHEET, STRINGS, DATE_MODE, FORMAT, XF, NAME, SHEET_REFS, BOOKS = 0x809, 0x0A, 0x3C, 0x2F, 0x85, 0xFC, 0x22, 0x41E, 0xE0, 0x18, 0x17, 0x1AE
NUMBER, RK, MANY_RK, SHARED_TEXT, TEXT, FLAG, FORMULA, RESULT, FAMILY, BLANK, MANY_BLANK = 0x203, 0x27E, 0xBD, 0xFD, 0x204, 0x205, 0x06, 0x207, 0x4BC, 0x201, 0xBE
MERGES, COLUMN, ROW, SIZES, WIDTH, HEIGHT, VIEW = 0xE5, 0x7D, 0x208, 0x200, 0x55, 0x225, 0x23E
CELLS = (NUMBER, RK, MANY_RK, SHARED_TEXT, TEXT, FLAG, FORMULA, BLANK, MANY_BLANK)
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}
# Operators by token, functions by number, and the arguments of those that take a fixed number.
BINARY = {0x03: "+", 0x04: "-", 0x05: "*", 0x06: "/", 0x07: "^", 0x08: "&", 0x09: "<", 0x0A: "<=", 0x0B: "=", 0x0C: ">=", 0x0D: ">", 0x0E: "<>", 0x0F: " ", 0x10: ",", 0x11: ":"}
FUNCTIONS = {0: "COUNT", 1: "IF", 4: "SUM", 5: "AVERAGE", 6: "MIN", 7: "MAX", 20: "SQRT", 24: "ABS", 25: "INT", 27: "ROUND", 32: "LEN", 34: "TRUE", 35: "FALSE", 36: "AND", 37: "OR", 38: "NOT", 39: "MOD", 112: "LOWER", 113: "UPPER", 118: "TRIM", 169: "COUNTA", 183: "PRODUCT", 337: "POWER", 345: "SUMIF", 346: "COUNTIF"}
FIXED = {20: 1, 24: 1, 25: 1, 27: 2, 32: 1, 34: 0, 35: 0, 38: 1, 39: 2, 112: 1, 113: 1, 118: 1, 337: 2, 346: 2}
NAMED_FUNCTION = 255
STATES = ("visible", "hidden", "veryHidden")
MAX_RECORDS = 20_000_000

_KEPT = ("cell", "sheet", "sheet_info", "merge", "column", "row", "defined_name", "num_fmt")
SCHEMAS = {name: xlsx.SCHEMAS[name] for name in _KEPT} | {"xf": "workbook_id string, style_ix int, num_fmt_id int", "workbook": "workbook_id string, date1904 boolean"}


class Unknown(Exception):
    """A token that can't be written back."""


class Texts:
    """A reader over a record and those that continue it: characters that go on in another record begin with a byte that says how wide they are there."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.part, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            if self.part >= len(self.parts):
                raise ValueError("a text is cut short")
            more = self.parts[self.part][self.at : self.at + n - len(out)]
            self.at += len(more)
            out += more
            if self.at >= len(self.parts[self.part]) and len(out) < n:
                self.part, self.at = self.part + 1, 0
        return out

    def number(self, form: str) -> int:
        return struct.unpack("<" + form, self.take(struct.calcsize(form)))[0]

    def characters(self, n: int, wide: bool) -> str:
        out = []
        while n:
            if self.part >= len(self.parts):
                raise ValueError("a text is cut short")
            left = len(self.parts[self.part]) - self.at
            if left <= 0:
                self.part, self.at = self.part + 1, 0
                wide = bool(self.number("B") & 1)
                continue
            width = 2 if wide else 1
            count = min(n, left // width)
            if not count:
                raise ValueError("a text is cut short")
            out.append(self.take(count * width).decode("utf-16-le" if wide else "latin-1", "replace"))
            n -= count
        return "".join(out)

    def text(self, length: str = "H") -> str:
        n, flags = self.number(length), self.number("B")
        runs = self.number("H") if flags & 8 else 0
        more = self.number("I") if flags & 4 else 0
        found = self.characters(n, bool(flags & 1))
        self.take(4 * runs + more)
        return found


def decoded_rk(raw: int) -> float:
    value = float(struct.unpack("<i", struct.pack("<I", raw))[0] >> 2) if raw & 2 else struct.unpack("<d", struct.pack("<Q", (raw & 0xFFFFFFFC) << 32))[0]
    return value / 100 if raw & 1 else value


class Workbook:
    def __init__(self, data: bytes, name: str):
        self.id, self.window, found = name, Window(), streams(data)
        self.data = found.get("Workbook") or found.get("Book") or b""
        first = next(self.records(0), None)
        if first is None or first[0] != BOF or struct.unpack_from("<H", first[1])[0] != 0x600:
            raise ValueError("not a workbook of a known version")

    def records(self, at: int) -> Iterator[tuple[int, bytes, list[bytes]]]:
        """(type, body, the bodies that continue it) up to the end of the part that begins at ``at``."""
        depth, count = 0, 0
        while at + 4 <= len(self.data):
            kind, size = struct.unpack_from("<HH", self.data, at)
            body, at, more = self.data[at + 4 : at + 4 + size], at + 4 + size, []
            while at + 4 <= len(self.data) and struct.unpack_from("<H", self.data, at)[0] == CONTINUE:
                size = struct.unpack_from("<H", self.data, at + 2)[0]
                more.append(self.data[at + 4 : at + 4 + size])
                at += 4 + size
            count += 1
            if kind == PASSWORD or count > MAX_RECORDS:
                raise ValueError("the workbook is encrypted, or too large")
            depth += (kind == BOF) - (kind == EOF)
            yield kind, body, more
            if depth <= 0:
                return

    @cached_property
    def book(self) -> dict[int, list[tuple[bytes, list[bytes]]]]:
        out: dict[int, list] = {}
        for kind, body, more in self.records(0):
            out.setdefault(kind, []).append((body, more))
        return out

    @cached_property
    def sheets(self) -> list[tuple[str, str, int]]:
        """(name, state, place) of worksheets."""
        out = []
        for body, more in self.book.get(SHEET, []):
            place, state, kind = struct.unpack_from("<IBB", body)
            if kind == 0:
                out.append((Texts([body[6:], *more]).text("B"), STATES[min(state & 3, 2)], place))
        return out

    @cached_property
    def every_sheet(self) -> list[str]:
        return [Texts([body[6:], *more]).text("B") for body, more in self.book.get(SHEET, [])]

    @cached_property
    def strings(self) -> list[str]:
        out = []
        for body, more in self.book.get(STRINGS, [])[:1]:
            reader = Texts([body[8:], *more])
            out = [reader.text() for _ in range(struct.unpack_from("<I", body, 4)[0])]
        return out

    def chosen(self) -> Iterator[tuple[int, int]]:
        for i, (_, _, place) in enumerate(self.sheets):
            if self.window.sheet(i):
                yield i, place

    # -- tables -----------------------------------------------------------------

    def table_workbook(self):
        yield self.id, any(body[:2] == b"\x01\x00" for body, _ in self.book.get(DATE_MODE, []))

    def table_sheet(self):
        for i, (name, state, _) in enumerate(self.sheets):
            yield self.id, i, name, state

    def table_num_fmt(self):
        for body, more in self.book.get(FORMAT, []):
            yield self.id, struct.unpack_from("<H", body)[0], Texts([body[2:], *more]).text()

    def table_xf(self):
        for i, (body, _) in enumerate(self.book.get(XF, [])):
            yield self.id, i, struct.unpack_from("<H", body, 2)[0]

    def table_sheet_info(self):
        for i, place in self.chosen():
            rows = columns = 1
            chars = points = None
            lines = True
            for kind, body, _ in self.records(place):
                if kind == SIZES:
                    _, last, _, right = struct.unpack_from("<IIHH", body)
                    rows, columns = max(1, last), max(1, right)
                elif kind == WIDTH:
                    chars = float(struct.unpack_from("<H", body)[0])
                elif kind == HEIGHT:
                    points = struct.unpack_from("<H", body, 2)[0] / 20
                elif kind == VIEW:
                    lines = bool(struct.unpack_from("<H", body)[0] & 2)
            yield self.id, i, rows, columns, chars, points, lines

    def table_merge(self):
        for i, place in self.chosen():
            for kind, body, _ in self.records(place):
                if kind == MERGES:
                    for n in range(min(struct.unpack_from("<H", body)[0], (len(body) - 2) // 8)):
                        top, bottom, left, right = struct.unpack_from("<4H", body, 2 + 8 * n)
                        yield self.id, i, top, left, bottom, right

    def table_column(self):
        for i, place in self.chosen():
            for kind, body, _ in self.records(place):
                if kind == COLUMN:
                    first, last, width, style, flags = struct.unpack_from("<5H", body)
                    yield self.id, i, first, min(last, 255), width / 256, bool(flags & 1), style

    def table_row(self):
        for i, place in self.chosen():
            for kind, body, _ in self.records(place):
                if kind == ROW:
                    row, _, _, height, _, _, flags, style = struct.unpack_from("<8H", body)
                    hidden, own, styled = bool(flags & 0x20), bool(flags & 0x40), bool(flags & 0x80)
                    if hidden or own or styled:
                        yield self.id, i, row, (height & 0x7FFF) / 20 if own else None, hidden, style & 0xFFF if styled else None

    def table_defined_name(self):
        for (name, sheet), tokens in zip(self.names, self.name_tokens, strict=True):
            try:
                yield self.id, name, self.formula(tokens, 0, 0), None if sheet == 0 else sheet - 1
            except (Unknown, struct.error, IndexError):
                continue

    @cached_property
    def _names(self) -> list[tuple[str, int, bytes]]:
        out = []
        for body, _ in self.book.get(NAME, []):
            flags, _, length, size, _, sheet = struct.unpack_from("<HBBHHH", body)
            at = 14
            wide = body[at] & 1
            raw = body[at + 1 : at + 1 + length * (2 if wide else 1)]
            name = raw.decode("utf-16-le" if wide else "latin-1", "replace")
            if flags & 0x20 and len(name) == 1:
                name = {"\x06": "_xlnm.Print_Area", "\x0d": "_xlnm._FilterDatabase"}.get(name, f"_xlnm.{ord(name)}")
            at += 1 + len(raw)
            out.append((name, sheet, body[at : at + size]))
        return out

    @property
    def names(self) -> list[tuple[str, int]]:
        return [x[:2] for x in self._names]

    @property
    def name_tokens(self) -> list[bytes]:
        return [x[2] for x in self._names]

    def table_cell(self):
        for i, place in self.chosen():
            # a formula waits for the records that may follow it: its family's tokens, and its text
            families, held, text = {}, None, ""
            for kind, body, more in self.records(place):
                if held is not None and kind == FAMILY:
                    families[held[0], held[1]] = body[10 : 10 + struct.unpack_from("<H", body, 8)[0]]
                elif held is not None and kind == RESULT:
                    text = Texts([body, *more]).text()
                elif kind in CELLS or kind == EOF:
                    if held is not None and self.window.within(held[0], held[1]):
                        yield self.made(i, *held, string=text, families=families)
                    held, text = None, ""
                    if kind == EOF or self.window.past(struct.unpack_from("<H", body)[0]):
                        break
                    for found in self.cells(kind, *struct.unpack_from("<HH", body), body, more):
                        if kind == FORMULA:
                            held = found
                        elif self.window.within(found[0], found[1]):
                            yield self.made(i, *found)

    def cells(self, kind: int, row: int, column: int, body: bytes, more: list[bytes]) -> Iterator[tuple]:
        """(row, column, style, kind of value, value, tokens)."""
        if kind == MANY_RK:
            for n in range((len(body) - 6) // 6):
                style, raw = struct.unpack_from("<HI", body, 4 + 6 * n)
                yield row, column + n, style, "n", decoded_rk(raw), None
            return
        if kind == MANY_BLANK:
            for n in range((len(body) - 6) // 2):
                yield row, column + n, struct.unpack_from("<H", body, 4 + 2 * n)[0], None, None, None
            return
        style = struct.unpack_from("<H", body, 4)[0]
        if kind == NUMBER:
            yield row, column, style, "n", struct.unpack_from("<d", body, 6)[0], None
        elif kind == RK:
            yield row, column, style, "n", decoded_rk(struct.unpack_from("<I", body, 6)[0]), None
        elif kind == SHARED_TEXT:
            ix = struct.unpack_from("<I", body, 6)[0]
            if ix >= len(self.strings):
                raise ValueError("a shared text is missing")
            yield row, column, style, "s", self.strings[ix], None
        elif kind == TEXT:
            yield row, column, style, "s", Texts([body[6:], *more]).text(), None
        elif kind == FLAG:
            value, is_error = body[6], body[7]
            yield (row, column, style, "e", ERRORS.get(value, "#VALUE!"), None) if is_error else (row, column, style, "b", value == 1, None)
        elif kind == BLANK:
            yield row, column, style, None, None, None
        else:
            saved, size = body[6:14], struct.unpack_from("<H", body, 20)[0]
            tokens = b"".join([body, *more])[22 : 22 + size]
            if saved[6:8] != b"\xff\xff":
                yield row, column, style, "n", struct.unpack("<d", saved)[0], tokens
            elif saved[0] == 1:
                yield row, column, style, "b", saved[2] == 1, tokens
            elif saved[0] == 2:
                yield row, column, style, "e", ERRORS.get(saved[2], "#VALUE!"), tokens
            else:
                yield row, column, style, "string" if saved[0] == 0 else "s", "", tokens

    def made(self, sheet: int, row: int, column: int, style: int, kind: str | None, value, tokens: bytes | None, string: str | None = None, families=None) -> tuple:
        formula = None
        if tokens is not None:
            try:
                formula = self.formula(tokens, row, column, families)
            except (Unknown, struct.error, IndexError):
                formula = ""
        if kind == "string":
            kind, value = "s", string
        pick = lambda k: value if kind == k else None
        return self.id, sheet, row, column, kind, pick("n"), pick("s"), pick("b"), pick("e"), formula, None, None, style

    # -- formulas -----------------------------------------------------------------

    @cached_property
    def references(self) -> list[tuple[int, int]]:
        out = []
        for body, more in self.book.get(SHEET_REFS, []):
            raw = b"".join([body, *more])
            for n in range(struct.unpack_from("<H", raw)[0]):
                book, first, last = struct.unpack_from("<HHH", raw, 2 + 6 * n)
                own = book < len(self.book.get(BOOKS, [])) and self.book[BOOKS][book][0][2:4] == b"\x01\x04"
                out.append((first, last) if own else (0xFFFF, 0xFFFF))
        return out

    def sheet_prefix(self, ix: int) -> str:
        first = self.references[ix][0]
        if first >= len(self.every_sheet):
            raise Unknown
        name = self.every_sheet[first]
        return (name if name.isidentifier() else "'" + name.replace("'", "''") + "'") + "!"

    def formula(self, tokens: bytes, row: int, column: int, families=None) -> str:
        stack: list[str] = []
        at = 0

        def take(form: str):
            nonlocal at
            found = struct.unpack_from("<" + form, tokens, at)
            at += struct.calcsize("<" + form)
            return found

        def place(r: int, c: int, offset: bool) -> str:
            free_row, free_column, c = c & 0x8000, c & 0x4000, c & 0xFF
            if offset:
                r = (row + (r - 0x10000 if r >= 0x8000 else r)) & 0xFFFF if free_row else r
                c = (column + (c - 0x100 if c >= 0x80 else c)) & 0xFF if free_column else c
            return f"{'' if free_column else '$'}{column_letters(c)}{'' if free_row else '$'}{r + 1}"

        def call(name: str, n: int) -> None:
            parts = stack[len(stack) - n :]
            if len(parts) < n:
                raise Unknown
            del stack[len(stack) - n :]
            stack.append(f"{name}({','.join(parts)})")

        while at < len(tokens):
            t = tokens[at]
            at += 1
            base = t if t < 0x20 else t & 0x1F | 0x20
            if t == 0x01:
                top, left = take("HH")
                family = (families or {}).get((top, left))
                if family is None:
                    raise Unknown
                return self.formula(family, row, column)
            if t in BINARY:
                right, left = stack.pop(), stack.pop()
                stack.append(left + BINARY[t] + right)
            elif t in (0x12, 0x13):
                stack.append("+-"[t - 0x12] + stack.pop())
            elif t == 0x14:
                stack.append(stack.pop() + "%")
            elif t == 0x15:
                stack.append(f"({stack.pop()})")
            elif t == 0x16:
                stack.append("")
            elif t == 0x17:
                n, flags = take("BB")
                raw = tokens[at : at + n * (1 + (flags & 1))]
                at += len(raw)
                stack.append('"' + raw.decode("utf-16-le" if flags & 1 else "latin-1", "replace").replace('"', '""') + '"')
            elif t == 0x19:
                flags, data = take("BH")
                if flags & 0x04:
                    at += 2 * (data + 1)
                elif flags & 0x10:
                    call("SUM", 1)
            elif t == 0x1C:
                stack.append(ERRORS.get(take("B")[0], "#VALUE!"))
            elif t == 0x1D:
                stack.append("TRUE" if take("B")[0] else "FALSE")
            elif t == 0x1E:
                stack.append(str(take("H")[0]))
            elif t == 0x1F:
                value = take("d")[0]
                stack.append(str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value))
            elif base == 0x21:
                number = take("H")[0]
                if number not in FIXED:
                    raise Unknown
                call(FUNCTIONS[number], FIXED[number])
            elif base == 0x22:
                n, number = take("BH")
                n, number = n & 0x7F, number & 0x7FFF
                if number == NAMED_FUNCTION:
                    own = stack.pop(len(stack) - n)
                    call(own, n - 1)
                elif number in FUNCTIONS:
                    call(FUNCTIONS[number], n)
                else:
                    raise Unknown
            elif base == 0x23:
                ix = take("HH")[0]
                stack.append(self.names[ix - 1][0])
            elif base in (0x24, 0x2C):
                stack.append(place(*take("HH"), base == 0x2C))
            elif base in (0x25, 0x2D):
                top, bottom, left, right = take("HHHH")
                stack.append(f"{place(top, left, base == 0x2D)}:{place(bottom, right, base == 0x2D)}")
            elif base in (0x2A, 0x2B):
                take("HH" if base == 0x2A else "HHHH")
                stack.append("#REF!")
            elif base == 0x3A:
                ix, r, c = take("HHH")
                stack.append(self.sheet_prefix(ix) + place(r, c, False))
            elif base == 0x3B:
                ix, top, bottom, left, right = take("HHHHH")
                stack.append(f"{self.sheet_prefix(ix)}{place(top, left, False)}:{place(bottom, right, False)}")
            elif base in (0x3C, 0x3D):
                take("HHH" if base == 0x3C else "HHHHH")
                stack.append("#REF!")
            else:
                raise Unknown
        if len(stack) != 1:
            raise Unknown
        return stack[0]


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(xlsx._source("xls", SCHEMAS, "cell", Workbook))

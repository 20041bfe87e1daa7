"""Legacy presentations and word-processing files as tables.

``spark.read.format("ppt").option("path", ...).option("table", "shape")`` and
``spark.read.format("doc")``. Each file is one partition and is read where its rows are made.
Readers only decode records: colours, schemes of masters, inherited styles, overlaps and
outline texts are joins in ``gridloom.operators.slides``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

from gridloom.sources.files import FileReader
from gridloom.sources.ole import streams

# Types of records.
DOCUMENT, DOCUMENT_ATOM, SLIDE, SLIDE_ATOM, SLIDE_PERSIST, COLOR_SCHEME = 1000, 1001, 1006, 1007, 1011, 2032
OUTLINE_REF, TEXT_HEADER, TEXT_CHARS, TEXT_STYLE, MASTER_STYLE, TEXT_BYTES, FONT = 3998, 3999, 4000, 4001, 4003, 4008, 4023
SLIDE_LIST, USER_EDIT, CURRENT_USER, PERSIST = 4080, 4085, 4086, 6002
STORE, SHAPE, STORE_ENTRY, SHAPE_FLAGS, OPTIONS, CHILD_ANCHOR, ANCHOR = 0xF001, 0xF004, 0xF007, 0xF00A, (0xF00B, 0xF121, 0xF122), 0xF00F, 0xF010
BLIPS, PLAIN = (0xF01D, 0xF01E, 0xF02A), 0xE391C05F
# Properties in their stored order as (mask, name, format).
PARAGRAPH = ((0xF, "bullet", "H"), (0x80, "bullet_char", "H"), (0x10, "bullet_font", "H"), (0x40, "bullet_size", "H"), (0x20, "bullet_color", "I"), (0x800, "align", "H"), (0x1000, "line_spacing", "h"), (0x2000, "before", "h"), (0x4000, "after", "h"), (0x100, "margin", "h"), (0x400, "indent", "h"), (0x8000, "tab_size", "h"), (0x100000, "tabs", None), (0x10000, "font_align", "H"), (0xE0000, "wrap", "H"), (0x200000, "direction", "H"))
CHARACTER = ((0xFFFF, "flags", "H"), (0x10000, "font", "H"), (0x200000, "east_asian_font", "H"), (0x400000, "ansi_font", "H"), (0x800000, "symbol_font", "H"), (0x20000, "size", "h"), (0x40000, "color", "I"), (0x80000, "position", "h"))
FLAGS = ((1, "bold"), (2, "italic"), (4, "underline"), (16, "shadow"))
# Bounds of files, records, nesting, slides, shapes, pictures and runs.
SMALLEST, LARGEST, MAX_RECORDS, MAX_DEPTH, MAX_SLIDES, MAX_SHAPES, MAX_PICTURES, PICTURE_BYTES, MAX_RUNS = 512, 50 << 20, 100_000, 32, 1000, 4096, 4096, 128 << 20, 8192

_P = "bullet boolean, bullet_char string, bullet_font int, bullet_size int, bullet_color long, align int, line_spacing int, before int, after int, margin int, indent int, tab_size int, tabs array<struct<position:int,align:int>>, font_align int, wrap int, direction int"
_C = "bold boolean, italic boolean, underline boolean, shadow boolean, font int, east_asian_font int, ansi_font int, symbol_font int, size int, color long, position int"
PARAGRAPH_NAMES, CHARACTER_NAMES = ([x.split()[0] for x in s.split(", ")] for s in (_P, _C))
_TEXT = "doc_id string, slide_ix int, shape_ix int, text_ix int"
PPT = {
    "slide": "doc_id string, slide_ix int, id long, width int, height int, master_id long, master_scheme boolean, scheme array<long>",
    "master": "doc_id string, master_id long, scheme array<long>",
    "shape": "doc_id string, slide_ix int, shape_ix int, type int, left int, top int, width int, height int, fill_value long, stroke_value long, rotation double, image int, fit boolean, background boolean, outline_ix int",
    "text": f"{_TEXT}, role long, text string",
    "paragraph": f"{_TEXT}, role long, start int, end int, level int, {_P}",
    "text_run": f"{_TEXT}, start int, end int, {_C}",
    "style": f"doc_id string, master_id long, role long, level int, {_P}, {_C}",
    "font": "doc_id string, ix int, name string",
    "picture": "doc_id string, ix int, mime string, bytes binary",
}
DOC = {"text": "doc_id string, part string, paragraph_ix int, text string", "page_layout": "doc_id string, width int, height int, left int, right int, top int, bottom int"}


@dataclass(frozen=True)
class Record:
    type: int
    instance: int
    container: bool
    body: memoryview
    start: int

    def number(self, form: str, at: int = 0) -> int:
        return struct.unpack_from("<" + form, self.body, at)[0]

    def scheme(self) -> list[int]:
        return list(struct.unpack_from("<8I", self.body))


class Stream:
    """Records of one stream, counted against the budget of the file."""

    def __init__(self, data: bytes, budget: list[int]):
        self.data, self.budget = memoryview(data), budget

    def at(self, offset: int, end: int | None = None) -> Record:
        end = len(self.data) if end is None else end
        if offset + 8 > end:
            raise ValueError("a record is cut short")
        head, kind, size = struct.unpack_from("<HHI", self.data, offset)
        if offset + 8 + size > end:
            raise ValueError("a record exceeds its container")
        return Record(kind, head >> 4, head & 15 == 15, self.data[offset + 8 : offset + 8 + size], offset + 8)

    def children(self, parent: Record) -> Iterator[Record]:
        at, end = parent.start, parent.start + len(parent.body)
        while at < end:
            self.budget[0] -= 1
            if self.budget[0] < 0:
                raise ValueError("too many records")
            yield (one := self.at(at, end))
            at = one.start + len(one.body)

    def within(self, parent: Record, *types: int, depth: int = 0) -> Iterator[Record]:
        """Records of these types at any depth; what they hold is not searched."""
        if depth > MAX_DEPTH:
            raise ValueError("records are nested too deep")
        for one in self.children(parent):
            if one.type in types:
                yield one
            elif one.container:
                yield from self.within(one, *types, depth=depth + 1)


class Cursor:
    def __init__(self, body: memoryview):
        self.body, self.position = body, 0

    def take(self, form: str) -> int:
        value = struct.unpack_from("<" + form, self.body, self.position)[0]
        self.position += struct.calcsize("<" + form)
        return value

    def properties(self, known: tuple) -> dict:
        """The properties that the leading mask announces."""
        mask, out = self.take("I"), {}
        if known is CHARACTER and mask >> 24:
            raise ValueError("unknown character properties")
        for bits, name, form in known:
            if not mask & bits:
                continue
            if form is None:
                count = self.take("H")
                if count > 4096:
                    raise ValueError("too many tab stops")
                out[name] = [(self.take("h"), self.take("H")) for _ in range(count)]
                continue
            value = self.take(form)
            if name == "flags":
                out |= {n: bool(value & bit) for bit, n in FLAGS if mask & bit}
            elif name == "size" and not 1 <= value <= 4000:
                raise ValueError("invalid font size")
            else:
                out[name] = bool(value & 1) if name == "bullet" else chr(value) if name == "bullet_char" else value
        return out

    def spans(self, length: int, known: tuple, levels: bool) -> list[dict]:
        out, at = [], 0
        while at <= length:
            count, level = self.take("I"), self.take("H") if levels else 0
            if not 0 < count <= length + 1 - at or level > 8 or len(out) >= MAX_RUNS:
                raise ValueError("invalid run of text")
            out.append({"start": at, "end": at + count} | ({"level": level} if levels else {}) | self.properties(known))
            at += count
        return out


@dataclass
class Text:
    role: int = 4
    text: str = ""
    paragraphs: list | None = None
    runs: list | None = None

    @property
    def length(self) -> int:
        return len(self.text.encode("utf-16-le", "surrogatepass")) // 2

    def style(self, record: Record) -> None:
        """A damaged record leaves the text without styles."""
        cursor = Cursor(record.body)
        try:
            self.paragraphs, self.runs = cursor.spans(self.length, PARAGRAPH, True), cursor.spans(self.length, CHARACTER, False)
        except (ValueError, struct.error):
            self.paragraphs = self.runs = None

    @property
    def spans(self) -> tuple[list, list]:
        everything = {"start": 0, "end": self.length + 1}
        return self.paragraphs or [everything | {"level": 0}], self.runs or [everything]


def texts_of(records) -> list[Text]:
    out: list[Text] = []
    open_text = False
    for one in records:
        if one.type == TEXT_HEADER and len(one.body) >= 4:
            out.append(Text(one.number("I")))
            open_text = True
        elif one.type in (TEXT_CHARS, TEXT_BYTES):
            raw = bytes(one.body)
            if len(raw) > 2 << 20 or one.type == TEXT_CHARS and len(raw) % 2:
                raise ValueError("invalid text")
            if not open_text:
                out.append(Text())
                open_text = True
            text = raw.decode("utf-16-le", "replace") if one.type == TEXT_CHARS else raw.decode("latin-1")
            out[-1].text += text.translate({13: "\n", 11: "\n", 0: None})
        elif one.type == TEXT_STYLE and open_text:
            out[-1].style(one)
    return out


def image(record: Record) -> tuple[str, bytes] | None:
    """A PNG or JPEG that begins within the first 64 bytes."""
    if record.type not in BLIPS:
        return None
    raw = bytes(record.body)
    head = raw[: min(64, len(raw) - 8) + 5]
    marks = [(at, mime) for mark, mime in ((b"\x89PNG\r\n", "image/png"), (b"\xff\xd8\xff", "image/jpeg")) if 0 <= (at := head.find(mark, 16)) < min(64, len(raw) - 8)]
    return (min(marks)[1], raw[min(marks)[0] :]) if marks else None


class Presentation:
    def __init__(self, data: bytes, name: str):
        if not SMALLEST <= len(data) <= LARGEST:
            raise ValueError(f"invalid file size {len(data)}")
        parts = streams(data)
        if "PowerPoint Document" not in parts or "Current User" not in parts:
            raise ValueError("streams of the presentation are missing")
        self.id, budget = name, [MAX_RECORDS]
        self.main, self.blips = Stream(parts["PowerPoint Document"], budget), Stream(parts["Pictures"], budget) if "Pictures" in parts else None
        self.where, document = self.persisted(Stream(parts["Current User"], budget).at(0))
        self.document = self.main.at(self.where[document])
        if self.document.type != DOCUMENT or not self.document.container:
            raise ValueError("invalid document record")
        self.parts = list(self.main.children(self.document))
        atom = next((x for x in self.parts if x.type == DOCUMENT_ATOM and len(x.body) >= 8), None)
        self.width, self.height = struct.unpack_from("<ii", atom.body) if atom else (5760, 4320)
        if not (0 < self.width <= 100_000 and 0 < self.height <= 100_000):
            raise ValueError("invalid slide dimensions")

    def persisted(self, user: Record) -> tuple[dict[int, int], int]:
        """Offsets by persist id, those of the newest edit first, and the id of the document."""
        if user.type != CURRENT_USER or len(user.body) < 12:
            raise ValueError("invalid current user")
        if user.number("I", 4) != PLAIN:
            raise ValueError("encrypted presentations are refused")
        offset, edits, where, document = user.number("I", 8), set(), {}, None
        while offset:
            if offset in edits or len(edits) > 4096:
                raise ValueError("the edits form a cycle")
            edits.add(offset)
            edit = self.main.at(offset)
            if edit.type != USER_EDIT or len(edit.body) < 28 or len(edit.body) >= 32 and edit.number("I", 28):
                raise ValueError("invalid or encrypted edit")
            document = edit.number("I", 16) if document is None else document
            table = self.main.at(edit.number("I", 12))
            if table.type != PERSIST:
                raise ValueError("invalid persist directory")
            cursor = Cursor(table.body)
            while cursor.position < len(table.body):
                head = cursor.take("I")
                count = head >> 20
                if not count or cursor.position + 4 * count > len(table.body) or len(where) > MAX_RECORDS:
                    raise ValueError("invalid persist entry")
                for i in range(count):
                    where.setdefault((head & 0xFFFFF) + i, cursor.take("I"))
            offset = edit.number("I", 8)
        if document not in where:
            raise ValueError("the document is not in its directory")
        return where, document

    def palette(self, container: Record) -> list[int]:
        return next((x.scheme() for x in self.main.within(container, COLOR_SCHEME) if len(x.body) >= 32), [])

    def lists(self, instance: int) -> Iterator[Record]:
        for part in self.parts:
            if part.type == SLIDE_LIST and part.instance == instance:
                yield from self.main.children(part)

    @cached_property
    def masters(self) -> dict[int, Record]:
        entries = [x for x in self.lists(1) if x.type == SLIDE_PERSIST and len(x.body) >= 16]
        return {x.number("I", 12): self.main.at(self.where[x.number("I")]) for x in entries if x.number("I") in self.where}

    @cached_property
    def slides(self) -> list[tuple[int, Record, list[Text]]]:
        """(id, container, texts of the slide list) of the active slides in their order."""
        held: list[tuple[Record, list]] = []
        for one in self.lists(0):
            if one.type == SLIDE_PERSIST:
                if len(one.body) < 16 or one.number("I") not in self.where:
                    raise ValueError("a slide is missing")
                held.append((one, []))
            elif held:
                held[-1][1].append(one)
        if not 0 < len(held) <= MAX_SLIDES:
            raise ValueError("invalid number of slides")
        out = [(x.number("I", 12), self.main.at(self.where[x.number("I")]), texts_of(rest)) for x, rest in held]
        if any(c.type != SLIDE or not c.container for _, c, _ in out):
            raise ValueError("invalid slide")
        return out

    def shapes(self, slide: Record, outline: int) -> Iterator[tuple[tuple, list[Text]]]:
        found = 0
        for shape in self.main.within(slide, SHAPE):
            parts = list(self.main.children(shape))
            anchor = next((x for x in parts if x.type in (ANCHOR, CHILD_ANCHOR)), None)
            flags = next((x for x in parts if x.type == SHAPE_FLAGS), None)
            if anchor is None or flags is None or len(flags.body) < 8 or len(anchor.body) not in (8, 16):
                continue
            found += 1
            if found > MAX_SHAPES:
                raise ValueError("too many shapes")
            values = {}
            for item in parts:
                if item.type in OPTIONS:
                    if item.instance * 6 > len(item.body):
                        raise ValueError("invalid shape properties")
                    pairs = struct.iter_unpack("<HI", item.body[: item.instance * 6])
                    values |= {k & 0x3FFF: v for k, v in pairs if not k & 0x8000}
            box = struct.unpack("<4h" if len(anchor.body) == 8 else "<4i", anchor.body)
            # A client anchor stores its top first, a child anchor its left.
            (top, left), (right, bottom) = (box[:2], box[2:]) if anchor.type == ANCHOR else (box[1::-1], box[2:])
            inline = list(self.main.within(shape, TEXT_HEADER, TEXT_CHARS, TEXT_BYTES, TEXT_STYLE, OUTLINE_REF))
            refs = [x.number("i") for x in inline if x.type == OUTLINE_REF and len(x.body) >= 4][:1]
            if refs and not 0 <= refs[0] < outline:
                raise ValueError("invalid outline text reference")
            rotation = struct.unpack("<i", struct.pack("<I", values.get(4, 0)))[0] / 65536
            row = (flags.instance, left, top, max(0, right - left), max(0, bottom - top), values.get(385), values.get(448), rotation, values.get(260) or None, values.get(191, 0) & 0x40004 == 0x40004, bool(flags.number("I", 4) & 0x400), refs[0] if refs else None)
            yield row, [] if refs else texts_of(inline)

    def every_text(self) -> Iterator[tuple[int, int | None, int, Text]]:
        """Texts of the slides (listed ones, then those inside), and those of each shape."""
        for i, (_, container, listed) in enumerate(self.slides):
            for k, (_, own) in enumerate(self.shapes(container, len(listed))):
                for n, text in enumerate(own):
                    yield i, k, n, text
            inside = texts_of(self.main.within(container, TEXT_HEADER, TEXT_CHARS, TEXT_BYTES, TEXT_STYLE))
            for n, text in enumerate(listed + inside):
                yield i, None, n, text

    def table_slide(self):
        for i, (name, container, _) in enumerate(self.slides):
            atom = next((x for x in self.main.children(container) if x.type == SLIDE_ATOM and len(x.body) >= 24), None)
            master = atom.number("I", 12) if atom else None
            yield self.id, i, name, self.width, self.height, master, bool(atom and atom.number("H", 20) & 2), self.palette(container)

    def table_master(self):
        for name, container in self.masters.items():
            yield self.id, name, self.palette(container)

    def table_shape(self):
        for i, (_, container, listed) in enumerate(self.slides):
            for k, (row, _) in enumerate(self.shapes(container, len(listed))):
                yield self.id, i, k, *row

    def table_text(self):
        for i, k, n, text in self.every_text():
            yield self.id, i, k, n, text.role, text.text

    def table_paragraph(self):
        for i, k, n, text in self.every_text():
            for p in text.spans[0]:
                yield self.id, i, k, n, text.role, p["start"], p["end"], p["level"], *map(p.get, PARAGRAPH_NAMES)

    def table_text_run(self):
        for i, k, n, text in self.every_text():
            for r in text.spans[1]:
                yield self.id, i, k, n, r["start"], r["end"], *map(r.get, CHARACTER_NAMES)

    def table_style(self):
        """Levels of the document's defaults (master_id null) and of the masters; a damaged record has none."""
        for master, container in [(None, self.document), *self.masters.items()]:
            last = {one.instance: rows for one in self.main.within(container, MASTER_STYLE) if (rows := self.levels(one)) is not None}
            for role, rows in last.items():
                for level, p in rows.items():
                    yield self.id, master, role, level, *map(p[0].get, PARAGRAPH_NAMES), *map(p[1].get, CHARACTER_NAMES)

    @staticmethod
    def levels(record: Record) -> dict | None:
        cursor, out = Cursor(record.body), {}
        try:
            count = cursor.take("H")
            for i in range(count):
                level = cursor.take("H") if record.instance >= 5 else i
                if count > 5 or level >= count:
                    return None
                out[level] = cursor.properties(PARAGRAPH), cursor.properties(CHARACTER)
        except (ValueError, struct.error):
            return None
        return out

    def table_font(self):
        named = {x.instance: bytes(x.body[:64]).decode("utf-16-le", "replace").partition("\0")[0] for x in self.main.within(self.document, FONT) if len(x.body) == 68 and x.instance <= 128}
        for ix, name in named.items():
            yield self.id, ix, name

    def table_picture(self):
        """Pictures by the number that shapes name (from 1); those of other kinds are null."""
        ix, held, seen = 0, 0, set()
        for store in self.main.within(self.document, STORE):
            for entry in self.main.children(store):
                ix += 1
                if ix > MAX_PICTURES:
                    raise ValueError("too many pictures")
                found = None
                if entry.type == STORE_ENTRY and len(entry.body) >= 36:
                    later, inside = entry.number("I", 28), 36 + entry.body[33]
                    if inside + 8 <= len(entry.body):
                        key, found = ("inside", entry.start + inside), image(self.main.at(entry.start + inside))
                    elif self.blips and later != 0xFFFFFFFF and later + 8 <= len(self.blips.data):
                        key, found = ("later", later), image(self.blips.at(later))
                    if found and key not in seen:
                        seen.add(key)
                        held += len(found[1])
                        if held > PICTURE_BYTES:
                            raise ValueError("pictures exceed their budget")
                yield self.id, ix, *(found or (None, None))


class WordFile:
    # The default page in twips, and the section properties that change it.
    PAGE = {"width": 12240, "height": 15840, "left": 1440, "right": 1440, "top": 1440, "bottom": 1440}
    SET = {0xB01F: "width", 0xB020: "height", 0xB021: "left", 0xB022: "right", 0x9023: "top", 0x9024: "bottom"}
    OPERANDS = (1, 1, 2, 4, 2, 2, None, 3)
    # Fixed value: which pair tells the table of pieces.
    PIECES = 33

    def __init__(self, data: bytes, name: str):
        self.id, parts = name, streams(data)
        self.word = parts.get("WordDocument", b"")
        if len(self.word) < 34:
            raise ValueError("the word stream is missing")
        self.table = parts.get("1Table" if struct.unpack_from("<H", self.word, 10)[0] & 512 else "0Table")
        if not self.table:
            raise ValueError("the table stream is missing")

    def pairs(self) -> int:
        """The place of the file information's pairs of offset and length."""
        at = 32
        for width in (2, 4):
            at += 2 + width * struct.unpack_from("<H", self.word, at)[0]
        return at

    def table_text(self):
        """Paragraphs of the main text, footnotes, headers and footers. Of fields, the results; cells end a paragraph too."""
        at = self.pairs()
        long = 36 + 2 * struct.unpack_from("<H", self.word, 32)[0]
        lengths = struct.unpack_from("<3i", self.word, long + 12)
        if struct.unpack_from("<H", self.word, at)[0] <= self.PIECES:
            raise ValueError("invalid file information")
        offset, size = struct.unpack_from("<II", self.word, at + 2 + 8 * self.PIECES)
        text, first = self.stored_text(self.table[offset : offset + size]), 0
        for part, length in zip(("main", "footnotes", "headers"), lengths, strict=True):
            for i, paragraph in enumerate(self.paragraphs(text[first : first + length])):
                yield self.id, part, i, paragraph
            first += max(0, length)

    def stored_text(self, raw: bytes) -> str:
        """The text of all pieces, in order."""
        at = 0
        while at < len(raw) and raw[at] == 1:
            at += 3 + struct.unpack_from("<H", raw, at + 1)[0]
        if at + 5 > len(raw) or raw[at] != 2:
            raise ValueError("the table of pieces is missing")
        size = struct.unpack_from("<I", raw, at + 1)[0]
        table = raw[at + 5 : at + 5 + size]
        count = (len(table) - 4) // 12
        ends, out = struct.unpack_from(f"<{count + 1}I", table), []
        for i in range(count):
            place = struct.unpack_from("<I", table, 4 * (count + 1) + 8 * i + 2)[0]
            narrow, place, length = bool(place & 0x40000000), place & 0x3FFFFFFF, ends[i + 1] - ends[i]
            place, width = (place // 2, 1) if narrow else (place, 2)
            if length < 0 or place + length * width > len(self.word):
                raise ValueError("a piece of text lies outside the file")
            out.append(self.word[place : place + length * width].decode("cp1252" if narrow else "utf-16-le", "replace"))
        return "".join(out)

    @staticmethod
    def paragraphs(text: str) -> Iterator[str]:
        out, codes = [], []
        for c in text:
            if c in "\r\x07\x0c":
                yield "".join(out)
                out = []
            elif c == "\x13":
                codes.append(True)
            elif c == "\x14" and codes:
                codes[-1] = False
            elif c == "\x15" and codes:
                codes.pop()
            elif not any(codes) and (c >= " " or c in "\t\x0b"):
                out.append("\n" if c == "\x0b" else c)
        if out:
            yield "".join(out)

    def section(self) -> bytes:
        """The stored properties of the first section."""
        at = self.pairs()
        pairs = struct.unpack_from("<H", self.word, at)[0]
        if pairs < 7 or at + 2 + 8 * pairs > len(self.word):
            raise ValueError("invalid file information")
        offset, length = struct.unpack_from("<II", self.word, at + 2 + 6 * 8)
        if not length:
            return b""
        sections, rest = divmod(length - 4, 16)
        if rest or not 1 <= sections <= 4096 or offset + length > len(self.table):
            raise ValueError("invalid section directory")
        stored = struct.unpack_from("<i", self.table, offset + 4 * (sections + 1) + 2)[0]
        if stored == -1:
            return b""
        if not 0 <= stored <= len(self.word) - 2:
            raise ValueError("invalid section properties")
        size = struct.unpack_from("<H", self.word, stored)[0]
        if stored + 2 + size > len(self.word):
            raise ValueError("section properties are cut short")
        return self.word[stored + 2 : stored + 2 + size]

    def table_page_layout(self):
        page, raw, at = dict(self.PAGE), self.section(), 0
        while at < len(raw):
            try:
                code = struct.unpack_from("<H", raw, at)[0]
                at += 2
                size = self.OPERANDS[code >> 13]
                if size is None:
                    size, at = raw[at], at + 1
            except (struct.error, IndexError):
                raise ValueError("a section property is cut short") from None
            if at + size > len(raw):
                raise ValueError("a section property is cut short")
            if name := self.SET.get(code):
                page[name] = abs(int.from_bytes(raw[at : at + 2], "little", signed=True)) if name in ("top", "bottom") else int.from_bytes(raw[at : at + 2], "little")
            at += size
        if not all(144 <= page[x] <= 31680 for x in ("width", "height")) or page["left"] + page["right"] >= page["width"] or page["top"] + page["bottom"] >= page["height"]:
            raise ValueError("invalid page geometry")
        yield self.id, *page.values()


def _source(short: str, tables: dict[str, str], default: str, opened) -> type[DataSource]:
    class Legacy(DataSource):
        @classmethod
        def name(cls) -> str:
            return short

        def schema(self) -> str:
            return tables[self.options.get("table", default)]

        def reader(self, schema) -> DataSourceReader:
            return FileReader(self.options, short, self.options.get("table", default), opened)

    return Legacy


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session, and lets Spark hand them its filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(_source("ppt", PPT, "slide", Presentation))
    spark.dataSource.register(_source("doc", DOC, "page_layout", WordFile))

import struct

import pytest
from pyspark.sql import functions as F

from gridloom.operators import slides
from gridloom.sources import legacy
from gridloom.sources.ole import streams


def ole(parts: dict[str, bytes]) -> bytes:
    """A compound file with every stream in full sectors (the cutoff is 0)."""
    blocks, chains, entries = [], [], []
    for name, body in parts.items():
        n = max(1, -(-len(body) // 512))
        entries.append((name, 2, len(blocks), len(body)))
        chains += [*range(len(blocks) + 1, len(blocks) + n), 0xFFFFFFFE]
        blocks += [body[i * 512 : (i + 1) * 512].ljust(512, b"\0") for i in range(n)]
    rows = b"".join(name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HB", 2 * len(name) + 2, kind) + b"\0" * 49 + struct.pack("<II", first, size) + b"\0" * 4 for name, kind, first, size in [("Root Entry", 5, 0xFFFFFFFE, 0), *entries])
    directory, n = len(blocks), -(-len(rows) // 512)
    chains += [*range(directory + 1, directory + n), 0xFFFFFFFE, 0xFFFFFFFD]
    blocks += [rows[i * 512 : (i + 1) * 512].ljust(512, b"\0") for i in range(n)]
    fat = len(blocks)
    blocks.append(struct.pack("<128I", *chains, *[0xFFFFFFFF] * (128 - len(chains))))
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<IIIIIIIII", 1, directory, 0, 0, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0, fat)
    return head.ljust(512, b"\xff") + b"".join(blocks)


def record(kind: int, body: bytes = b"", instance: int = 0, container: bool = False) -> bytes:
    return struct.pack("<HHI", instance << 4 | 15 * container, kind, len(body)) + body


def ints(*values: int) -> bytes:
    return b"".join(struct.pack("<I", v & 0xFFFFFFFF) for v in values)


def presentation(cycle=False, broken=False, encrypted=False, anchor=(128, 256, 4000, 800), wide=False, child=False, inline=False, outline=0, fit=0, styled=False, cut=False, master=False, picture=b"") -> bytes:
    def text(value):
        style = struct.pack("<IHIH", len(value) + 1, 0, 2048, 1) + struct.pack("<IIHHHI", len(value) + 1, 0x10000 | 0x20000 | 0x40000 | 7, 7, 0, 18, 0xFE0000FF)
        return record(3999, ints(0)) + record(4000, value.encode("utf-16-le")) + (record(4001, style[:16] if cut else style) if styled else b"")

    box = record(0xF00F if child else 0xF010, struct.pack("<4i" if wide or child else "<4h", *anchor)) if anchor else b""
    options = record(0xF00B, struct.pack("<HIHI", 191, fit, 385, 0x08000001), 2)
    shape = record(0xF004, record(0xF00A, ints(100, 0x800), 1) + options + box + record(0xF00D, text("Local box") if inline else record(3998, ints(outline)), container=True), container=True)
    atom = record(1007, struct.pack("<12xI4xH2x", 17, 2)) if master else b""
    first = record(1006, atom + record(1036, record(0xF002, shape, container=True), container=True), container=True)
    second = record(1006, container=True)
    listed = record(4080, record(1011, ints(3, 4, 1, 300, 0)) + text("First: 中") + record(1011, ints(99 if broken else 2, 4, 1, 200, 0)) + text("Second"), container=True)
    levels = struct.pack("<HIHIH", 1, 2048, 2, 131072, 30)
    main = record(1016, record(4003, levels) + record(2032, ints(0, 0x332211, *[0] * 6)), container=True) if master else b""
    store = record(0xF001, record(0xF007, b"\0" * 36 + record(0xF01E, b"\0" * 17 + picture)), container=True) if picture else b""
    document = record(1000, record(1001, ints(5760, 4320)) + record(4023, "Georgia".encode("utf-16-le").ljust(68, b"\0")) + store + listed + (record(4080, record(1011, ints(4, 0, 0, 17)), 1, True) if master else b""), container=True)
    at_master = len(document + first + second)
    at_directory = at_master + len(main)
    offsets = [0, len(document + first), len(document)] + [at_master] * master
    directory = record(6002, ints(len(offsets) << 20 | 1, *offsets))
    at_edit = at_directory + len(directory)
    edit = record(4085, ints(300, 0x03000000, at_edit if cycle else 0, at_directory, 1, 4, 0))
    return ole({"PowerPoint Document": document + first + second + main + directory + edit, "Current User": record(4086, ints(20, 0xF3D1C4DF if encrypted else 0xE391C05F, at_edit, 0, 0))})


def rows(data: bytes, table: str, names: str = "") -> list[dict]:
    columns = [c.split()[0] for c in legacy.PPT[table].replace("array<struct<position:int,align:int>>", "t").split(", ")]
    return [dict(zip(columns, r, strict=True)) for r in getattr(legacy.Presentation(data, "x"), f"table_{table}")()]


def test_slides_follow_the_list_and_outline_texts():
    data = presentation()
    assert [(r["id"], r["width"]) for r in rows(data, "slide")] == [(300, 5760), (200, 5760)]
    assert [(r["slide_ix"], r["text"]) for r in rows(data, "text")] == [(0, "First: 中"), (1, "Second")]
    inline = [(r["shape_ix"], r["text"]) for r in rows(presentation(inline=True), "text") if r["slide_ix"] == 0]
    assert inline == [(0, "Local box"), (None, "First: 中"), (None, "Local box")]
    lost = [(r["shape_ix"], r["text"]) for r in rows(presentation(inline=True, anchor=None), "text") if r["slide_ix"] == 0]
    assert lost == [(None, "First: 中"), (None, "Local box")]


@pytest.mark.parametrize("options", [{}, {"wide": True}, {"child": True, "anchor": (256, 128, 4000, 800)}])
def test_anchors(options):
    shape = rows(presentation(**options), "shape")[0]
    assert [shape[c] for c in ("left", "top", "width", "height")] == [256, 128, 3744, 672]


def test_fit_needs_both_flags():
    assert [rows(presentation(fit=f), "shape")[0]["fit"] for f in (0, 4, 0x40000, 0x40004)] == [False, False, False, True]


@pytest.mark.parametrize("options", [{"cycle": True}, {"broken": True}, {"encrypted": True}, {"outline": -1}, {"outline": 99}])
def test_refused(options):
    with pytest.raises(ValueError):
        rows(presentation(**options), "shape")


@pytest.mark.parametrize("data", [b"", b"\0" * 20, b"\0" * 512, presentation()[:1500]])
def test_damaged_files(data):
    with pytest.raises(ValueError):
        rows(data, "slide")


def test_pictures():
    png = b"\x89PNG\r\n\x1a\n" + b"x" * 20
    assert [(r["ix"], r["mime"], r["bytes"]) for r in rows(presentation(picture=png), "picture")] == [(1, "image/png", png)]
    assert [r["mime"] for r in rows(presentation(picture=b"none of them" * 4), "picture")] == [None]


def test_own_and_cut_styles():
    run = rows(presentation(styled=True), "text_run")[0]
    assert {c: v for c, v in run.items() if v is not None and c not in slides.TEXT} == {"start": 0, "end": 9, "bold": True, "italic": True, "underline": True, "font": 0, "size": 18, "color": 0xFE0000FF}
    assert rows(presentation(styled=True), "font")[0]["name"] == "Georgia"
    cut = rows(presentation(styled=True, cut=True), "text_run")[0]
    assert cut["end"] == 9 and cut["bold"] is None


def test_joins_of_a_presentation(spark, tmp_path):
    legacy.register(spark)
    for name, options in {"own": {"master": True, "styled": True}, "inherits": {"master": True}, "inline": {"inline": True}}.items():
        (tmp_path / f"{name}.ppt").write_bytes(presentation(**options))
    t = {x: spark.read.format("ppt").option("path", str(tmp_path)).option("table", x).load().cache() for x in legacy.PPT}
    scheme = slides.schemes(t["slide"], t["master"]).cache()
    painted = {r.doc_id: r.fill for r in slides.painted(t["shape"], scheme).collect()}
    assert painted == {"own.ppt": "#112233", "inherits.ppt": "#112233", "inline.ppt": "#000000"}
    runs = slides.inherited_runs(slides.paragraph_runs(t["paragraph"], t["text_run"]), t["style"], scheme)
    sizes = {(r.doc_id, r.slide_ix): r.size for r in slides.text_sizes(runs).where("shape_ix is null and text_ix = 0").collect()}
    assert sizes["own.ppt", 0] == 18 and sizes["inherits.ppt", 0] == 30 and sizes["inline.ppt", 0] is None and sizes["inherits.ppt", 1] is None
    aligns = {r.doc_id: r.align for r in slides.inherited_paragraphs(t["paragraph"], t["style"], scheme).where("slide_ix = 0 and shape_ix is null and text_ix = 0").collect()}
    assert aligns == {"own.ppt": 1, "inherits.ppt": 2, "inline.ppt": None}
    shown = {(r.doc_id, r.text) for r in slides.shape_texts(t["shape"], t["text"]).collect()}
    assert shown == {("own.ppt", "First: 中"), ("inherits.ppt", "First: 中"), ("inline.ppt", "Local box")}
    rest = {(r.doc_id, r.text) for r in slides.transcript(t["shape"], t["text"]).collect()}
    assert rest == {("own.ppt", "Second"), ("inherits.ppt", "Second"), ("inline.ppt", "Second"), ("inline.ppt", "First: 中")}


def test_colors_and_bullets(spark):
    c = lambda x: F.lit(x).cast("long")
    none, scheme = F.lit(None).cast("array<long>"), F.array(c(0), c(0x332211))
    row = spark.range(1).select(slides.text_color(c(0xFE0000FF), none).alias("a"), slides.text_color(c(0x01000000), scheme).alias("b"), slides.text_color(c(0x05000000), scheme).alias("c"), slides.text_color(c(0xFF000000), scheme).alias("d"), slides.text_color(c(None), scheme).alias("e"), slides.shape_color(c(0x01000000), scheme).alias("f"), slides.bullet(F.lit("x"), F.lit(" 'Symbol' ")).alias("g"), slides.bullet(F.lit(""), F.lit("Arial")).alias("h")).first()
    assert tuple(row) == ("#ff0000", "#112233", "#222222", "#222222", "#222222", "transparent", "•x", "")


def word(stored: int = 920) -> bytes:
    body = bytearray(1024)
    for at, value in ((32, 14), (62, 22), (152, 93)):
        struct.pack_into("<H", body, at, value)
    struct.pack_into("<I", body, 206, 20)
    pairs = [(0xB01F, 15840), (0xB020, 12240), (0xB021, 1800), (0xB022, 1200), (0x9023, -900), (0x9024, 1440)]
    struct.pack_into("<H", body, 920, 4 * len(pairs))
    for i, (code, value) in enumerate(pairs):
        struct.pack_into("<Hh", body, 922 + 4 * i, code, value)
    table = bytearray(20)
    struct.pack_into("<I", table, 4, 10)
    struct.pack_into("<i", table, 10, stored)
    return ole({"WordDocument": bytes(body), "0Table": bytes(table)})


def test_page_layout(spark, tmp_path):
    legacy.register(spark)
    (tmp_path / "a.doc").write_bytes(word())
    row = spark.read.format("doc").option("path", str(tmp_path)).load().first()
    assert tuple(row) == ("a.doc", 15840, 12240, 1800, 1200, 900, 1440)
    assert tuple(next(legacy.WordFile(word(-1), "x").table_page_layout()))[1:] == (12240, 15840, 1440, 1440, 1440, 1440)
    with pytest.raises(ValueError):
        list(legacy.WordFile(word(1023), "x").table_page_layout())
    assert set(streams(word())) == {"WordDocument", "0Table"}

"""Styles of cells: colours, the joins of style tables, sizes in pixels, plain number formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Colours by index.
INDEXED = "000000 FFFFFF FF0000 00FF00 0000FF FFFF00 FF00FF 00FFFF 000000 FFFFFF FF0000 00FF00 0000FF FFFF00 FF00FF 00FFFF 800000 008000 000080 808000 800080 008080 C0C0C0 808080 9999FF 993366 FFFFCC CCFFFF 660066 FF8080 0066CC CCCCFF 000080 FF00FF FFFF00 00FFFF 800080 800000 008080 0000FF 00CCFF CCFFFF CCFFCC FFFF99 99CCFF FF99CC CC99FF FFCC99 3366FF 33CCCC 99CC00 FFCC00 FF9900 FF6600 666699 969696 003366 339966 003300 333300 993300 993366 333399 333333".split()
# Codes of the built-in number formats.
FORMATS = {0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??", 14: "m/d/yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@"}
# Pixels of the widest digit, its padding in 256ths of a character, largest indent.
DIGIT, PADDING, MAX_INDENT = 7, 18, 250


def rgb(text: Column) -> Column:
    """Six or eight hexadecimal digits to #rrggbb, else null."""
    return F.when(text.rlike("^([A-Fa-f0-9]{2})?[A-Fa-f0-9]{6}\\z"), F.concat(F.lit("#"), F.lower(F.right(text, F.lit(6)))))


def tinted(color: Column, tint: Column) -> Column:
    """#rrggbb with its lightness moved to black (tint < 0) or white; hue and saturation stay.

    With both kept, each channel's distance from the lightness scales with the room that is
    left for it, 1 - |2 l - 1|.
    """
    c = [F.conv(F.substring(color, at, 2), 16, 10).cast("double") / 255 for at in (2, 4, 6)]
    light = (F.greatest(*c) + F.least(*c)) / 2
    moved = F.when(tint < 0, light * (1 + tint)).otherwise(light * (1 - tint) + tint)
    room = lambda x: 1 - F.abs(2 * x - 1)
    scale = F.when(F.greatest(*c) == F.least(*c), 0.0).otherwise(room(moved) / room(light))
    part = lambda x: F.lower(F.lpad(F.hex(F.floor((moved + (x - light) * scale) * 255 + 0.5)), 2, "0"))
    return F.when(F.coalesce(tint, F.lit(0.0)) == 0, color).otherwise(F.concat(F.lit("#"), *map(part, c)))


def color(plain: Column, themed: Column, indexed: Column, tint: Column) -> Column:
    """A colour's own value, else the theme's, else the indexed one, tinted; null with a tint beyond 1."""
    table = F.array(*map(F.lit, INDEXED))
    found = F.coalesce(rgb(plain), rgb(themed), rgb(F.get(table, F.when(indexed >= 0, indexed))))
    return F.when(F.coalesce(tint, F.lit(0.0)).between(-1, 1), tinted(found, tint))


def colored(parts: DataFrame, themes: DataFrame, name: str = "color") -> DataFrame:
    """``parts`` (workbook_id, rgb, theme, indexed, tint) with its colour in their place."""
    own = themes.select("workbook_id", "theme", F.col("color").alias("_themed"))
    out = parts.join(own, ["workbook_id", "theme"], "left")
    kept = [c for c in parts.columns if c not in ("rgb", "theme", "indexed", "tint")]
    return out.select(*kept, color(F.col("rgb"), F.col("_themed"), F.col("indexed"), F.col("tint")).alias(name))


def resolved(xf: DataFrame, base: DataFrame, fonts: DataFrame, fills: DataFrame, borders: DataFrame, formats: DataFrame, themes: DataFrame) -> DataFrame:
    """The style of each style_ix: its own properties before those of its base."""
    names = [c for c in xf.columns if c not in ("workbook_id", "style_ix", "base_ix")]
    under = base.select("workbook_id", "base_ix", *[F.col(c).alias(f"_b_{c}") for c in names])
    own = xf.join(under, ["workbook_id", "base_ix"], "left").select("workbook_id", "style_ix", *[F.coalesce(c, f"_b_{c}").alias(c) for c in names])
    for c in ("font_ix", "fill_ix", "border_ix", "num_fmt_id"):
        own = own.withColumn(c, F.coalesce(c, F.lit(0)))
    font = colored(fonts, themes).withColumnRenamed("ix", "font_ix")
    fill = colored(fills.where("solid").drop("solid"), themes, "background").withColumnRenamed("ix", "fill_ix")
    edge = colored(borders, themes).groupBy("workbook_id", F.col("ix").alias("border_ix")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("side", F.struct("line", F.coalesce("color", F.lit("#000000")).alias("color")))))).alias("borders"))
    code = formats.select("workbook_id", "num_fmt_id", F.nullif("code", F.lit("")).alias("_code")).dropDuplicates(["workbook_id", "num_fmt_id"])
    out = own.join(font, ["workbook_id", "font_ix"], "left").join(fill, ["workbook_id", "fill_ix"], "left").join(edge, ["workbook_id", "border_ix"], "left").join(code, ["workbook_id", "num_fmt_id"], "left")
    known = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    yes = lambda c: F.coalesce(F.col(c).isin("1", "true"), F.lit(False))
    number = lambda c: F.coalesce(F.expr(f"try_cast({c} as double)"), F.lit(0.0))
    place = F.when(F.col("vertical") == "center", "middle").when(F.col("vertical").isin("top", "bottom"), F.col("vertical"))
    return out.select(
        "workbook_id", "style_ix", "bold", "italic", "strike", "underline", "font", "size", "script", "color", "background", "borders",
        F.coalesce("_code", F.try_element_at(known, F.col("num_fmt_id"))).alias("number_format"),
        F.when(F.col("horizontal").isin("left", "right", "center", "justify"), F.col("horizontal")).alias("align"), place.alias("vertical"),
        yes("wrap").alias("wrap"), yes("shrink").alias("shrink"),
        F.greatest(F.lit(0.0), F.least(F.lit(float(MAX_INDENT)), number("indent"))).alias("indent"), number("rotation").alias("rotation"),
    )


def column_pixels(chars: Column) -> Column:
    return F.floor((256 * chars + PADDING) / 256 * DIGIT)


def point_pixels(points: Column) -> Column:
    return points * 96 / 72


def formatted(value: Column, code: str) -> Column:
    """A number under a format of digits, one group separator, decimals, percent, or General; null for other codes.

    Halves go away from zero. Dates, fractions, exponents, colours and sections are not covered.
    """
    if code == "General":
        whole = (value == F.floor(value)) & (F.abs(value) < 1e11)
        return F.when(whole, value.cast("long").cast("string")).otherwise(value.cast("string"))
    plain = code.rstrip("%")
    percent = len(code) - len(plain)
    head, _, tail = plain.partition(".")
    if head not in ("0", "#,##0") or tail.strip("0") or percent > 1:
        return F.lit(None).cast("string")
    scaled = F.round((value * 100 if percent else value).cast("decimal(38,12)"), len(tail))
    text = F.format_number(scaled, len(tail))
    return F.concat(text if "," in head else F.replace(text, F.lit(","), F.lit("")), F.lit("%" * percent))

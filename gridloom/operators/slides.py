"""Joins over the tables of a presentation: schemes, colours, outline texts, inherited styles.

Every table is keyed by doc_id, so all of these partition by document; nothing is broadcast by hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.sources.legacy import CHARACTER_NAMES, PARAGRAPH_NAMES

TEXT = ["doc_id", "slide_ix", "shape_ix", "text_ix"]
# The role whose defaults serve roles without their own, and which no master changes.
OTHER_ROLE = 4


def _hex(value: Column) -> Column:
    """Stored blue, green, red to #rrggbb."""
    part = lambda at: F.lower(F.lpad(F.hex(F.shiftright(value, at).bitwiseAND(255)), 2, "0"))
    return F.concat(F.lit("#"), part(0), part(8), part(16))


def _nth(scheme: Column, index: Column) -> Column:
    return F.get(scheme, index.cast("int"))


def shape_color(value: Column, scheme: Column, fallback: str = "transparent") -> Column:
    """A fill or a line: a place of the scheme where the flag is set (black if there is none), else a literal."""
    named = value.bitwiseAND(0x08000000) != 0
    literal = F.when(F.shiftright(value, 24) == 0, _hex(value)).otherwise(fallback)
    return F.when(value.isNull(), fallback).when(named, _hex(F.coalesce(_nth(scheme, value.bitwiseAND(255)), F.lit(0).cast("long")))).otherwise(literal)


def text_color(value: Column, scheme: Column, fallback: str = "#222222") -> Column:
    """The leading byte is a place of the scheme, or 254 before a literal."""
    index = F.shiftright(value, 24)
    themed = F.when(index <= 7, _nth(scheme, index))
    return F.coalesce(F.when(index == 254, _hex(value)).otherwise(_hex(themed)), F.lit(fallback))


def schemes(slides: DataFrame, masters: DataFrame) -> DataFrame:
    """(doc_id, slide_ix, master_id, scheme): that of the master where the slide follows one, else its own."""
    of = masters.dropDuplicates(["doc_id", "master_id"]).select("doc_id", "master_id", F.col("scheme").alias("_scheme"), F.lit(True).alias("_found"))
    out = slides.join(of, ["doc_id", "master_id"], "left")
    return out.select("doc_id", "slide_ix", "master_id", F.when(F.col("_found") & F.col("master_scheme"), F.col("_scheme")).otherwise(F.col("scheme")).alias("scheme"), F.coalesce("_found", F.lit(False)).alias("has_master"))


def painted(shapes: DataFrame, scheme: DataFrame) -> DataFrame:
    """``shapes`` with fill and stroke as colours."""
    out = shapes.join(scheme.select("doc_id", "slide_ix", "scheme"), ["doc_id", "slide_ix"], "left")
    return out.withColumn("fill", shape_color(F.col("fill_value"), F.col("scheme"))).withColumn("stroke", shape_color(F.col("stroke_value"), F.col("scheme"))).drop("scheme")


def shape_texts(shapes: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, slide_ix, shape_ix, text_ix, role, text): a shape's own texts, or the outline text it names."""
    own = texts.where("shape_ix is not null").select(*TEXT, "role", "text")
    listed = texts.where("shape_ix is null").select("doc_id", "slide_ix", F.col("text_ix").alias("outline_ix"), "role", "text")
    named = shapes.where("outline_ix is not null").join(listed, ["doc_id", "slide_ix", "outline_ix"], "left")
    text = F.when(F.col("role").isNull(), F.raise_error(F.lit("Missing outline text"))).otherwise(F.col("text"))
    return own.unionByName(named.select("doc_id", "slide_ix", "shape_ix", F.lit(0).alias("text_ix"), "role", text.alias("text")))


def transcript(shapes: DataFrame, texts: DataFrame) -> DataFrame:
    """Texts of slides that no shape shows, by their value."""
    shown = shape_texts(shapes, texts).select("doc_id", "slide_ix", "text").distinct()
    return texts.where("shape_ix is null").join(shown, ["doc_id", "slide_ix", "text"], "left_anti").select("doc_id", "slide_ix", "text_ix", "role", "text")


def _same_text(a: str, b: str) -> Column:
    out = F.lit(True)
    for c in TEXT:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def paragraph_runs(paragraphs: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs cut at the paragraphs they overlap, with role and level of the paragraph. Texts are equi-joined; overlaps are checked within one."""
    hit = _same_text("p", "r") & (F.col("r.start") < F.col("p.end")) & (F.col("r.end") > F.col("p.start"))
    both = paragraphs.alias("p").join(runs.alias("r"), hit)
    named = {c: f"p.{c}" for c in (*TEXT, "role", "level")} | {c: f"r.{c}" for c in CHARACTER_NAMES}
    return both.select(F.greatest("p.start", "r.start").alias("start"), F.least("p.end", "r.end").alias("end"), *[F.col(x).alias(c) for c, x in named.items()])


def _inherited(items: DataFrame, styles: DataFrame, scheme: DataFrame, names: list[str]) -> DataFrame:
    level = ["doc_id", "role", "level"]
    base = styles.where("master_id is null").select(*level, *[F.col(c).alias(f"_d_{c}") for c in names], F.lit(True).alias("_d"))
    roles = base.select(F.col("doc_id").alias("_doc"), F.col("role").alias("_own_role")).distinct()
    above = styles.where("master_id is not null").where(f"role <> {OTHER_ROLE}").select(*level, "master_id", *[F.col(c).alias(f"_m_{c}") for c in names])
    out = items.join(scheme.select("doc_id", "slide_ix", "master_id"), ["doc_id", "slide_ix"], "left").join(above, [*level, "master_id"], "left")
    # A role without any defaults takes those of other texts.
    out = out.join(roles, (F.col("doc_id") == F.col("_doc")) & (F.col("role") == F.col("_own_role")), "left")
    out = out.withColumn("_role", F.when(F.col("_own_role").isNull(), F.lit(OTHER_ROLE)).otherwise(F.col("role")).cast("long"))
    out = out.join(base.withColumnRenamed("role", "_role"), ["doc_id", "_role", "level"], "left")
    return out.select([F.coalesce(c, f"_m_{c}", f"_d_{c}").alias(c) if c in names else F.col(c) for c in items.columns])


def inherited_runs(runs: DataFrame, styles: DataFrame, scheme: DataFrame) -> DataFrame:
    """Runs of ``paragraph_runs`` with what they lack from the master's level, then the document's."""
    return _inherited(runs, styles, scheme, CHARACTER_NAMES)


def inherited_paragraphs(paragraphs: DataFrame, styles: DataFrame, scheme: DataFrame) -> DataFrame:
    return _inherited(paragraphs, styles, scheme, PARAGRAPH_NAMES)


def text_sizes(runs: DataFrame) -> DataFrame:
    """The largest font size among each text's runs."""
    return runs.groupBy(*TEXT).agg(F.max("size").alias("size"))


def with_fonts(runs: DataFrame, fonts: DataFrame) -> DataFrame:
    """``runs`` with ``font_name``, that of their font's number."""
    return runs.join(fonts.select("doc_id", F.col("ix").alias("font"), F.col("name").alias("font_name")), ["doc_id", "font"], "left")


def distinct_pictures(pictures: DataFrame) -> DataFrame:
    """(doc_id, ix, picture_ix, mime): the first number under which a document's picture of the same bytes stands."""
    known = pictures.where("bytes is not null").select("doc_id", "ix", "mime", F.sha2("bytes", 256).alias("_h"))
    first = known.groupBy("doc_id", "mime", "_h").agg(F.min("ix").alias("picture_ix"))
    return known.join(first, ["doc_id", "mime", "_h"]).select("doc_id", "ix", "picture_ix", "mime")


def with_pictures(shapes: DataFrame, pictures: DataFrame) -> DataFrame:
    """``shapes`` with ``picture_ix`` and ``mime`` of the picture that they name; null where it is none that can be shown."""
    of = distinct_pictures(pictures).withColumnRenamed("ix", "image")
    return shapes.join(of, ["doc_id", "image"], "left")


def distinct_texts(texts: DataFrame) -> DataFrame:
    """Each text once, however often slides refer to it: what styles are inherited for."""
    return texts.dropDuplicates(TEXT)


def bullet(text: Column, font: Column) -> Column:
    """The private dot of the Symbol font as a plain one."""
    symbol = F.lower(F.trim(font)).rlike("^[\"']?symbol[\"']?\\z")
    return F.when(symbol, F.replace(text, F.lit(""), F.lit("•"))).otherwise(text)


def pixels(twips: Column) -> Column:
    return twips / 15

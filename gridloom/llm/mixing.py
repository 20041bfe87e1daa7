"""Mixing sources to target weights (operator 3).

Sources take weights in turn, in code-point order, null last. Their targets share a multiple
of all sizes by weight, none above ``CAP`` times its source's size, what is above being shared
again by weight. Every document has a hash-random key; within its source, documents are cut
into ranges of keys, prefix sums of sizes run over the ranges, and the source is taken in that
order: whole epochs as often as its target holds its size, then up to the exact budget, the
last document in part.

The budget ends within one range of a source, its cut. Rows of ranges before and after it are
decided where they are read, against a table of one row a source; only the rows of the cuts, one
in ``16 ** RANGE_DIGITS``, are sorted, and prefix sums run over them. No other text moves.

A size is the number of words; null or empty texts have size 0. Null sources are a source.
Documents of a null id are keyed by their text alone. Repeated rows are separate documents of
one key, in any order, which changes no row's result beyond which of the equals is cut. Extra
columns are kept, whatever their names, but for those of the results, which are replaced; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.store import documents, materialize

WEIGHTS, TOTAL, CAP = (5, 2, 1), 1.5, 2
#: Leading hexadecimal digits of the key that make a range.
RANGE_DIGITS = 3
#: Sources up to which their table, of under 100 bytes a source, is broadcast; with more it is joined by source.
BROADCAST_SOURCES = 100_000
RESULTS = ["size", "source_size", "target", "taken", "epochs"]


def word_count(text):
    """Words of a text: its words' first characters, each after white space or the beginning."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    A level L makes every target min(CAP * size, L * weight) and their sum TOTAL of all sizes.
    In order of CAP * size / weight, sources are capped as long as the level for the rest stays above.
    One task has them all, a row a source.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    weighted = sizes.withColumn("_i", F.row_number().over(order)).withColumn("w", F.element_at(F.array(*map(F.lit, map(float, WEIGHTS))), ((F.col("_i") - 1) % len(WEIGHTS) + 1).cast("int")))
    every = W.partitionBy(F.lit(0))
    upto = W.partitionBy(F.lit(0)).orderBy(F.col("source_size") / F.col("w"), "_i").rowsBetween(W.unboundedPreceding, -1)
    weighted = weighted.withColumn("size", F.col("source_size").cast("double"))
    weighted = weighted.withColumn("rest", TOTAL * F.sum("size").over(every) - CAP * F.coalesce(F.sum("size").over(upto), F.lit(0.0)))
    weighted = weighted.withColumn("rest_w", F.sum("w").over(every) - F.coalesce(F.sum("w").over(upto), F.lit(0.0)))
    weighted = weighted.withColumn("free", F.col("rest") * F.col("w") <= CAP * F.col("size") * F.col("rest_w"))
    first = weighted.withColumn("k", F.when(F.col("free"), F.col("source_size") / F.col("w"))).withColumn("level", F.min(F.when(F.col("free"), F.struct("k", "_i", "rest", "rest_w"))).over(every))
    share = F.col("level.rest") * F.col("w") / F.col("level.rest_w")
    capped = ~F.coalesce(F.struct(F.col("source_size") / F.col("w"), F.col("_i")) >= F.struct("level.k", "level._i"), F.lit(False))
    return first.select("source", "source_size", F.when(capped, CAP * F.col("size")).otherwise(share).alias("target"))


def _cuts(sized: DataFrame) -> DataFrame:
    """(of, source_size, target, whole, rest, cut, start): per source its epochs, the words left for the last, the range in which they end, and those before it."""
    # read thrice below: its exchange is reused, and texts are counted once
    ranges = sized.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    # at most 16 ** RANGE_DIGITS rows of a source come together here, whatever its documents
    order = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, 0)
    upto = ranges.withColumn("upto", F.sum("range_size").over(order))
    budget = targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size"))).withColumnRenamed("source", "of")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    budget = budget.withColumn("whole", whole).withColumn("rest", F.floor(F.col("target")).cast("long") - F.col("whole") * F.col("source_size"))
    ends = upto.join(budget.select("of", "rest"), upto["source"].eqNullSafe(F.col("of"))).where("upto > rest").groupBy("of").agg(F.min(F.struct("range", (F.col("upto") - F.col("range_size")).alias("start"))).alias("cut"))
    ends = ends.select(F.col("of").alias("ended"), "cut.range", "cut.start")
    return budget.join(ends, F.col("of").eqNullSafe(F.col("ended")), "left").select("of", "source_size", "target", "whole", "rest", F.col("range").alias("cut"), "start")


def _mixed(docs: DataFrame) -> DataFrame:
    """``doc`` (the row itself as a struct), size, source_size, target, taken, epochs."""
    key = F.md5(F.concat_ws(":", F.lit("mix"), F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))))
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    keyed = docs.select(doc, F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), key.alias("key")).withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    size = word_count(F.col("doc.text"))
    cuts = _cuts(keyed.select("source", "range", size.alias("size")))
    # a part of the result's own plan: no file is written, for which the JVM would start processes
    cuts = F.broadcast(cuts) if docs.select("source").distinct().count() <= BROADCAST_SOURCES else materialize(cuts, "cuts")
    out = keyed.join(cuts, F.col("source").eqNullSafe(F.col("of")))
    at_cut = F.coalesce(F.col("range") == F.col("cut"), F.lit(False))
    # words are counted after the choice of rows
    sure = out.where(~at_cut).withColumn("size", size).withColumn("part", F.when(F.col("range") < F.col("cut"), F.col("size")).otherwise(F.lit(0).cast("long")))
    inside = W.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    left = F.col("rest") - F.col("start") - F.coalesce(F.sum("size").over(inside), F.lit(0))
    cut = out.where(at_cut).withColumn("size", size).withColumn("part", F.least("size", F.greatest(F.lit(0).cast("long"), left)))
    out = sure.unionByName(cut).withColumn("taken", F.col("whole") * F.col("size") + F.col("part"))
    return out.withColumn("epochs", F.col("whole") + F.when(F.col("part") > 0, 1).otherwise(0)).select("doc", *RESULTS)


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, source, more) with ``size``, ``source_size``, ``target``, ``taken``, ``epochs``, which replace columns of these names.

    ``taken``: words the mix takes of the row, repeats counted; ``epochs``: the times it is taken, the last perhaps in part.
    """
    return _mixed(docs).select(*[F.col(f"doc.`{c}`") for c in docs.columns if c not in RESULTS], *RESULTS)


def repeated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with their columns alone, each as often as the mix takes it."""
    out = _mixed(docs).where("epochs > 0").select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("epochs"))).alias("epoch"))
    return out.select(*[F.col(f"doc.`{c}`") for c in docs.columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # ids, sources and sizes are enough here: texts are not moved
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5('mix:' || coalesce(doc_id::VARCHAR, text, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS i FROM d GROUP BY source),
w AS (SELECT *, CASE (i - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s),
r AS (SELECT *, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - 2.0::DOUBLE * coalesce(sum(source_size) OVER b, 0)::DOUBLE AS rest,
             sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS rest_w, row_number() OVER (ORDER BY source_size / w, i) AS n
      FROM w WINDOW b AS (ORDER BY source_size / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT * FROM r WHERE rest * w <= 2 * source_size * rest_w ORDER BY n LIMIT 1),
t AS (SELECT r.source, r.source_size, CASE WHEN f.n IS NULL OR r.n < f.n THEN 2.0::DOUBLE * r.source_size ELSE f.rest * r.w / f.rest_w END AS target FROM r LEFT JOIN f ON true),
o AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
             CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS whole
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (whole * size + least(size, greatest(0, floor(target)::BIGINT - whole * source_size - before)))::BIGINT AS taken FROM o
"""

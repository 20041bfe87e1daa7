"""Line dedup by distinct-site spread (operator 5).

Every line with a word has a hash, of its text without white space at the ends. For each hash,
HyperLogLog sketches of the sites that have it merge by aggregation. Lines whose estimate is
clearly at or above ``MIN_SITES`` are boilerplate; those near the threshold, by the sketch's
error, get exact distinct counts, site by site in two steps. Boilerplate lines are then
removed from every text.

Only built-in functions run; a line that a third of all rows have is sketched by partial
aggregates. Sites are a column, by default ``source``; a null site is one site. Null texts
stay null, with no lines; other lines keep their order. A null doc_id stays null; repeated
rows get equal results. Other columns are kept. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.store import documents, materialize, row_key, scratch

MIN_SITES = 5
#: Sketch size as a power of two, and standard errors that count as near.
LOG_SIZE, ERRORS = 10, 4
_EDGE = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hashes(text: Column) -> Column:
    """A hash for each line, null for lines without a word."""
    bare = lambda x: F.regexp_replace(x, _EDGE, "")
    return F.transform(_lines(text), lambda x: F.transform(F.array(bare(x)), lambda b: F.when(b != "", F.xxhash64(b)))[0])


def widespread(lines: DataFrame, sites: int = MIN_SITES) -> DataFrame:
    """Hashes of (h, site) rows that at least ``sites`` distinct sites have."""
    sketched = lines.groupBy("h").agg(F.hll_sketch_agg("site", F.lit(LOG_SIZE)).alias("sketch"), F.count("*").alias("n")).where(F.col("n") >= sites)
    sketched = materialize(sketched.select("h", F.hll_sketch_estimate("sketch").alias("sites")), "spread")
    margin = max(1.0, ERRORS * 1.04 / 2 ** (LOG_SIZE / 2) * sites)
    near = F.col("sites").between(sites - margin, sites + margin)
    sure = sketched.where(~near & (F.col("sites") > sites)).select("h")
    exact = lines.join(sketched.where(near).select("h"), "h", "left_semi").distinct().groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= sites).select("h")
    return sure.union(exact)


def without_boilerplate(docs: DataFrame, site: str = "source", sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with ``clean_text``, ``n_lines`` (lines with a word) and ``n_removed``, which replace columns of these names."""
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), row_key().alias("row"), F.col("text").alias("text"))
    with scratch(docs.sparkSession):
        lined = docs.select(row_key().alias("row"), F.coalesce(F.col(f"`{site}`").cast("string"), F.lit("")).alias("site"), F.posexplode(_hashes(F.col("text"))).alias("at", "h")).where("h is not null")
        lined = materialize(lined, "lines")
        common = materialize(widespread(lined.select("h", "site"), sites), "common")
        # equal rows share a key: their places come once
        hit = lined.join(common, "h").groupBy("row", "at").agg(F.lit(1).alias("one")).groupBy("row").agg(F.collect_list("at").alias("gone"))
        hit = materialize(hit, "hit", keep=True)
    out = carried.join(hit, "row", "left")
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    left = F.transform(F.array(_lines(F.col("text"))), lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), gone), lambda i: F.get(x, i)))[0]
    kept = F.when(F.size(gone) == 0, F.col("text")).otherwise(F.array_join(left, "\n"))
    n_lines = F.coalesce(F.size(F.filter(_lines(F.col("text")), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))), F.lit(0))
    new = {"clean_text": kept, "n_lines": F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long"), "n_removed": F.size(gone).cast("long")}
    return out.select(*[F.col(f"doc.`{c}`") for c in docs.columns if c not in new], *[c.alias(n) for n, c in new.items()])


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return without_boilerplate(docs).select("doc_id", "n_lines", "n_removed", F.length("clean_text").cast("long").alias("n_chars_kept"), F.md5("clean_text").alias("kept_md5"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, text, row_number() OVER () AS r, string_split(text, chr(10)) AS x FROM documents),
l AS (SELECT r, coalesce(source, '') AS source, unnest(x) AS line, unnest(range(len(x))) AS pos FROM d),
b AS (SELECT r, source, pos, line, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS bare FROM l),
c AS (SELECT bare FROM b WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT source) >= {MIN_SITES}),
m AS (SELECT r, pos, line, bare, bare IN (SELECT bare FROM c) AS gone FROM b),
k AS (SELECT r, count(*) FILTER (WHERE bare <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS clean FROM m GROUP BY r)
SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed, length(k.clean)::BIGINT AS n_chars_kept, md5(k.clean) AS kept_md5
FROM d LEFT JOIN k ON d.r = k.r
"""

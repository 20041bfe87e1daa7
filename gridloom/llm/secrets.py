"""Secret scans with corpus-wide ownership (operator 6).

Base patterns find assignments, access keys and hexadecimal strings. Their values, and other
long tokens that mix letters and digits, are candidates. Candidate hashes are aggregated over
the whole corpus by distinct repositories and owners. Values that many owners, or many
repositories, have are copied examples; values that stay with few owners and in few repositories
and look random are live-looking credentials. Of the latter, those that no base span covers
are added as spans of kind ``owned``; base spans always stay.

An owner is the document's source, a repository its source and language: the finest
grouping that the tables have.

Only built-in functions run. Values are counted in two steps (per value, owner and repository
first), so a value that a third of all rows have is not gathered. Texts are scanned whole.
Null and empty texts have no spans. Null owners or repositories count as one. A null doc_id is
kept as null. Repeated rows get equal results. Extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.spans import kinds, listed, matches, overlapping
from gridloom.llm.store import documents, materialize, row_key, scratch

#: Fixed patterns of the base kinds.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Other tokens of 20 or more characters; they must have a letter and a digit.
LOOSE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
KINDS = ["assign", "access", "hex", "owned"]
#: Most owners and repositories of a live-looking value, and those from which a value is a copied example.
FEW_OWNERS, MANY_OWNERS = 2, 5
FEW_REPOSITORIES, MANY_REPOSITORIES = 4, 10
#: Least distinct characters of a random value.
DISTINCT_CHARACTERS = 10


def base_spans(text: Column) -> Column:
    """Spans (s, k, e, v) of the base kinds, v the secret value."""
    value = lambda x: F.regexp_extract(x["v"], ASSIGN_VALUE, 1)
    assign = F.transform(matches(text, ASSIGN), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), value(x).alias("v")))
    return kinds({"assign": F.filter(assign, lambda x: F.length(x["v"]) >= 12), "access": matches(text, ACCESS), "hex": matches(text, HEX)})


def secret_spans(docs: DataFrame, owner: str = "source", repository: Column | None = None) -> DataFrame:
    """doc_id and, for each row: base spans, all spans (arrays of s, k, e), counts of owner-specific and of widely copied values, and the most owners and repositories of one value."""
    with scratch(docs.sparkSession):
        return materialize(_secret_spans(docs, owner, repository), "spans", keep=True)


def _secret_spans(docs: DataFrame, owner: str, repository: Column | None) -> DataFrame:
    repository = F.concat_ws("/", F.col("source"), F.col("lang")) if repository is None else repository
    text = F.coalesce(F.col("text"), F.lit(""))
    loose = F.transform(matches(text, LOOSE), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v")))
    loose = F.filter(loose, lambda x: x["v"].rlike("[0-9]") & x["v"].rlike("[A-Za-z]"))
    found = docs.select(row_key().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), repository.alias("repository"), base_spans(text).alias("base"), loose.alias("loose"))
    covered = F.transform(F.array(overlapping(F.col("loose"), F.col("base"))), lambda c: F.filter(F.transform("loose", lambda x, i: x.withField("c", F.get(c, i))), lambda x: ~x["c"]))[0]
    found = materialize(found.withColumn("loose", covered), "secrets")

    known = F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["v"].alias("v")))
    added = F.transform("loose", lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index("owned")).alias("k"), x["e"].alias("e"), x["v"].alias("v")))
    each = found.select("row", "owner", "repository", F.explode(F.concat(known, added)).alias("x")).select("row", "owner", "repository", "x.s", "x.k", "x.e", F.sha2("x.v", 256).alias("h"), (F.size(F.array_distinct(F.split("x.v", ""))) >= DISTINCT_CHARACTERS).alias("random"))
    spread = each.groupBy("h", "owner", "repository").agg(F.lit(1).alias("one")).groupBy("h").agg(F.countDistinct("owner").alias("owners"), F.countDistinct("repository").alias("repositories"))
    spread = materialize(spread, "spread")
    judged = each.select("row", "s", "k", "e", "h", "random").distinct().join(spread, "h")
    live = F.col("random") & (F.col("owners") <= FEW_OWNERS) & (F.col("repositories") <= FEW_REPOSITORIES)
    copied = (F.col("owners") >= MANY_OWNERS) | (F.col("repositories") >= MANY_REPOSITORIES)
    per = judged.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(live & (F.col("k") == KINDS.index("owned")), F.struct("s", "k", "e")))).alias("more"),
        F.count_if(live).alias("n_owned"),
        F.count_if(copied).alias("n_copied"),
        F.max("owners").alias("most_owners"),
        F.max("repositories").alias("most_repositories"),
    )
    base = F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    out = found.select("row", "doc_id", base.alias("base")).join(per, "row", "left")
    every = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<s:int,k:int,e:int>>"))))
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "base", every.alias("all"), F.coalesce("n_owned", zero).alias("n_owned"), F.coalesce("n_copied", zero).alias("n_copied"), F.coalesce("most_owners", zero).alias("most_owners"), F.coalesce("most_repositories", zero).alias("most_repositories"))


def digest(spans: DataFrame, names: list[str], base_kinds: int, more: list[str]) -> DataFrame:
    """Counts of each base kind, the hash of the base spans, and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long").alias(f"n_{names[k]}")
    return spans.select("doc_id", *(count(k) for k in range(base_kinds)), F.sha2(listed(F.col("base"), names), 256).alias("base_sha256"), listed(F.col("all"), names).alias("spans"), *more)


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(secret_spans(documents(spark, sf_dir)), KINDS, 3, ["n_owned", "n_copied", "most_owners", "most_repositories"])

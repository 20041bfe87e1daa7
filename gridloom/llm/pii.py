"""Personal data by bootstrapped contextual extraction (operator 10).

Base patterns find e-mail addresses, IP addresses, payment cards and telephone numbers. These
are the seeds. A lexical pattern is the word before or the word after an identifier-like
token (one with an @ or at least 5 digits). Over the whole corpus, patterns and distinct
tokens (instances) form a bipartite graph; in each of ``ROUNDS`` rounds, a pattern's
confidence is the share of its instances that are known, and tokens of accepted patterns (with
enough known instances and confidence) become known. Tokens discovered so, outside base
spans, are added as spans of kind ``context``; base spans always stay.

Only built-in functions run. The graph holds a row for each pattern and distinct token; the
words of very common patterns are counted by partial aggregates. Texts are scanned whole; null
and empty ones have no spans. A null doc_id stays null. Repeated rows get equal results. Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.secrets import digest
from gridloom.llm.spans import kinds, matches, overlapping
from gridloom.llm.store import documents, materialize, row_key, scratch

#: Fixed patterns of the base kinds. Possessive parts and the look-behinds change no match (a match may
#: begin inside a run only where the last one ended); they keep very long runs linear.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
KINDS = ["email", "ip", "card", "phone", "context"]
ROUNDS, MIN_KNOWN, MIN_CONFIDENCE = 3, 5, 0.8


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def base_spans(text: Column) -> Column:
    """Spans (s, k, e, v) of the base kinds."""
    small = lambda part: (F.length(F.regexp_replace(part, "^0+", "")) <= 3) & (F.coalesce(F.substring(F.regexp_replace(part, "^0+", ""), 1, 3).try_cast("int"), F.lit(0)) <= 255)
    ip = F.filter(matches(text, IP), lambda x: F.forall(F.split(x["v"], r"\."), small))
    card = F.filter(matches(text, CARD), lambda x: F.length(_digits(x["v"])).between(12, 19) & F.call_function("luhn_check", F.substring(_digits(x["v"]), 1, 19)))
    phone = F.filter(matches(text, PHONE), lambda x: F.length(_digits(x["v"])).between(9, 15))
    return kinds({"email": matches(text, EMAIL), "ip": ip, "card": card, "phone": phone})


def private_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base spans and all spans (arrays of s, k, e) of each row."""
    with scratch(docs.sparkSession):
        return materialize(_private_spans(docs), "spans", keep=True)


def _private_spans(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    word = lambda side, pattern: F.regexp_extract(side, pattern, 1)
    nearby = lambda side, own, token: F.lower(F.when(side.rlike(r"^[\x20\x09-\x0D]+\z"), F.coalesce(token, F.lit(""))).otherwise(own))

    def around(x, i):
        before = nearby(x["l"], word(x["l"], r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)[\x20\x09-\x0D]++\z"), F.when(i > 0, F.get("all", i - 1)["v"]))
        after = nearby(x["r"], word(x["r"], r"^[\x20\x09-\x0D]++([^\x20\x09-\x0D]++)"), F.get("all", i + 1)["v"])
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"), before.alias("before"), after.alias("after"))

    # a neighbour with a digit or an @ is a match itself
    tokens = F.filter(F.transform("all", around), lambda x: x["v"].contains("@") | (F.length(_digits(x["v"])) >= 5))
    docs = docs.select("doc_id", F.col("text"), matches(text, TOKEN, context=True).alias("all"))
    found = docs.select(row_key().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), base_spans(text).alias("base"), tokens.alias("tokens"))
    seeds = F.transform(F.array(overlapping(F.col("tokens"), F.col("base"))), lambda c: F.transform("tokens", lambda x, i: x.withField("seed", F.get(c, i))))[0]
    found = materialize(found.withColumn("tokens", seeds), "private")

    each = found.select("row", F.explode("tokens").alias("x")).select("row", "x.s", "x.e", F.xxhash64("x.v").alias("v"), "x.seed", F.explode(F.array(F.concat(F.lit("<"), "x.before"), F.concat(F.lit(">"), "x.after"))).alias("p")).where("length(p) > 1")
    graph = materialize(each.groupBy("p", "v").agg(F.max("seed").alias("seed")), "graph")
    known = graph.groupBy("v").agg(F.max("seed").alias("known"))
    accepted = None
    for _ in range(ROUNDS):
        scored = graph.join(known.where("known").select("v", F.lit(1).alias("hit")), "v", "left").groupBy("p").agg(F.count("hit").alias("n_known"), F.count("*").alias("n"))
        accepted = materialize(scored.where(f"n_known >= {MIN_KNOWN} and n_known >= {MIN_CONFIDENCE} * n").select("p"), "patterns")
        reached = graph.join(accepted, "p", "left_semi").select("v", F.lit(True).alias("known"))
        known = materialize(graph.select("v", F.col("seed").alias("known")).union(reached).groupBy("v").agg(F.max("known").alias("known")), "known")
    more = each.where("not seed").join(accepted, "p", "left_semi").select("row", "s", "e").distinct()
    more = more.groupBy("row").agg(F.collect_list(F.struct("s", F.lit(KINDS.index("context")).alias("k"), "e")).alias("more"))
    base = F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    out = found.select("row", "doc_id", base.alias("base")).join(more, "row", "left")
    return out.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<s:int,k:int,e:int>>")))).alias("all"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(private_spans(documents(spark, sf_dir)), KINDS, 4, [])

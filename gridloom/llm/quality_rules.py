"""Quality rules with risk-controlled thresholds (operator 7).

Each rule rejects a document when a statistic of its text passes a cutoff. A stratum (language)
rejects what any of its rules rejects, and it is this whole verdict whose false rejections are
bounded. Labelled documents are split by a hash of their id:

1. One half chooses. Per stratum and rule, the cutoff of a fixed grid that best separates bad
   from good is a candidate, if it gains anything; candidates are ordered by what they gain.
2. The other half tests. For each leading run of a stratum's candidates, an exact binomial test
   asks whether the share of good documents that any of them rejects is below ``RISK``: with k
   of n rejected, P(X <= k) for X ~ Bin(n, RISK) must be at most ``LEVEL`` divided by the number
   of tests, strata times rules (Bonferroni). That is the Clopper-Pearson bound, read the
   other way. The longest run that holds is on; with too few labels for any proof, none is.

As the runs are fixed before the second half is looked at, with probability 1 - ``LEVEL`` at
least, no stratum rejects more than ``RISK`` of its good documents by these rules. The fixed
base rules (under 10 words, many repeated words) are outside this bound.

Only built-in functions run. A text's statistics are computed inside its row, in one pass,
and nothing of a text is shuffled. Null texts have no words; a document of fewer than 10 words fails.
A null language is a stratum. A null doc_id matches no label. Of several labels of an id the
largest counts, and every document of that id takes it. Repeated rows get equal results. Extra
columns are ignored; an empty table gives an empty result. A document that fails a rule by a
statistic without a denominator (no words, no lines) fails no rule by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.store import documents, materialize, scratch

RISK, LEVEL = 0.02, 0.05
MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Share of bad documents a cutoff must reject, and what a rejected good document costs against a bad one.
MIN_GAIN, GOOD_COST = 0.01, 4.0
#: Strata up to which their cutoffs (a few hundred bytes each) are broadcast.
BROADCAST_STRATA = 2_000
#: Labelled ids (8 bytes each) up to which they are broadcast.
BROADCAST_LABELS = 1_000_000

#: Statistics of a row (n_words, word_chars, n_symbols, ... are its columns) and the grid of cutoffs for each.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / word_chars", (0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.3)),
    "capitals": ("n_capitals / word_chars", (0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.7)),
    "exclamations": ("n_exclamations / n_words", (0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5)),
    "duplicate_lines": ("n_dup_lines / n_lines", (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7)),
    "repeated_words": ("n_repeat_words / n_words", (0.02, 0.05, 0.08, 0.1, 0.12, 0.15, 0.18, 0.2)),
    "long_words": ("word_chars / n_words", (6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0)),
    "short_words": ("-word_chars / n_words", (-4.5, -4.0, -3.5, -3.0, -2.5, -2.0, -1.5, -1.2)),
}


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda x: x != "")


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of ``WINDOW`` words found twice or more in the text."""

    def hashed(w):
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)]))

    def covered(h):
        # sorted by hash, places of equal hashes stand together
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, x, j: (F.get(s, j)["h"].eqNullSafe(x["h"])) & j.between(0, F.size(s) - 1)
        places = F.transform(F.array(pairs), lambda s: F.array_sort(F.transform(F.filter(s, lambda x, j: same(s, x, j - 1) | same(s, x, j + 1)), lambda x: x["i"])))[0]
        return F.transform(F.array(places), lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))[0]

    some = F.transform(F.array(hashed(words)), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))[0]
    return F.when(F.size(words) > WINDOW, some).otherwise(0)


def _drop(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c))
    return text


def statistics(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, stratum and the statistics of each row; ``carry``: also the row itself, as ``_doc``."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def row(t, w):
        lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(_drop(t, " \n\t\r\x0b\x0c")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            F.transform(F.array(lines), lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))[0].alias("lines"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
            F.regexp_count(t, F.lit("[A-Z]")).cast("long").alias("n_capitals"),
            F.regexp_count(t, F.lit("!")).cast("long").alias("n_exclamations"),
        )

    x = F.transform(F.array(text), lambda t: F.transform(F.array(words_of(t)), lambda w: row(t, w))[0])[0]
    row_itself = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")] if carry else []
    # a generator of one row: what stands above it takes its columns, and never works a text again
    out = docs.select(*row_itself, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("stratum"), F.explode(F.array(x)).alias("x"))
    return out.select(*(["_doc"] if carry else []), "doc_id", "stratum", "x.n_words", "x.word_chars", "x.n_symbols", F.col("x.lines.dup").alias("n_dup_lines"), "x.n_repeat_words", F.col("x.lines.n").alias("n_lines"), "x.n_capitals", "x.n_exclamations")


def _value(rule: str) -> Column:
    above, below = RULES[rule][0].split(" / ")
    sign = -1.0 if above.startswith("-") else 1.0
    return F.when(F.col(below) > 0, sign * F.col(above.lstrip("-")) / F.col(below)).otherwise(F.lit(-1e9))


def binomial_at_most(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p), added up from X = 0 by the ratio of neighbouring terms, in logarithms."""
    first = n * F.log1p(F.lit(-p))
    odds = F.log(F.lit(p / (1 - p)))

    def add(acc, i):
        term = acc["term"] + F.log((n - i + 1) / i) + odds
        return F.struct(term.alias("term"), (acc["sum"] + F.exp(term)).alias("sum"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    return F.aggregate(steps, F.struct(first.alias("term"), F.exp(first).alias("sum")), add, lambda acc: F.least(F.lit(1.0), acc["sum"]))


def _labelled(labels: DataFrame, label: str) -> DataFrame:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null")
    return known.groupBy("doc_id").agg(F.max("label").alias("label"))


def chooses(doc_id: Column) -> Column:
    """Whether a labelled document is of the half that chooses."""
    return F.conv(F.substring(F.md5(doc_id.cast("string")), 1, 2), 16, 10).cast("int") % 2 == 0


def candidates(held: DataFrame) -> DataFrame:
    """(stratum, rule, cutoff, gain, place): per stratum and rule the cutoff that gains most on labelled statistics, in order of gain."""
    good, bad = F.col("label") == 1, F.col("label") != 1
    counts = [F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("cutoff"), F.count_if(good & (_value(rule) > c)).alias("good_rejected"), F.count_if(bad & (_value(rule) > c)).alias("bad_rejected")) for rule, (_, grid) in RULES.items() for c in grid]
    each = held.groupBy("stratum").agg(F.count_if(good).alias("n_good"), F.count_if(bad).alias("n_bad"), F.array(*counts).alias("t")).select("stratum", "n_good", "n_bad", F.explode("t").alias("t")).select("stratum", "n_good", "n_bad", "t.*")
    gain = F.col("bad_rejected") / F.greatest("n_bad", F.lit(1)) - GOOD_COST * F.col("good_rejected") / F.greatest("n_good", F.lit(1))
    best = each.withColumn("gain", gain).where(F.col("gain") >= MIN_GAIN).groupBy("stratum", "rule").agg(F.max(F.struct("gain", "cutoff")).alias("b"))
    return best.select("stratum", "rule", "b.cutoff", "b.gain", F.row_number().over(W.partitionBy("stratum").orderBy(F.desc("b.gain"), "rule")).alias("place"))


def _cut(chosen: DataFrame, value: str) -> DataFrame:
    """(stratum, cut): a map from rules to ``value``; broadcast up to ``BROADCAST_STRATA`` strata."""
    chosen = chosen.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", value))).alias("cut"))
    return F.broadcast(chosen) if chosen.count() <= BROADCAST_STRATA else chosen


def cutoffs(stats: DataFrame, labels: DataFrame, label: str = "quality", risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """(stratum, rule, cutoff, place, n_good, run_rejected) of the rules that are on; ``run_rejected``: good documents of the tests that this rule or one before it rejects."""
    with scratch(stats.sparkSession):
        return materialize(_cutoffs(stats, labels, label, risk, level), "cutoffs", keep=True)


def _cutoffs(stats: DataFrame, labels: DataFrame, label: str, risk: float, level: float) -> DataFrame:
    held = stats.join(_labelled(labels, label), "doc_id").withColumn("chooses", chooses(F.col("doc_id")))
    held = materialize(held, "held")
    number = len(RULES) * max(1, held.select("stratum").distinct().count())
    chosen = materialize(candidates(held.where("chooses")), "candidates")
    tested = held.where("not chooses and label = 1").join(_cut(chosen.withColumn("at", F.struct("cutoff", "place")), "at"), "stratum")
    at = lambda rule: F.try_element_at("cut", F.lit(rule))
    first = F.least(*[F.when(_value(rule) > at(rule)["cutoff"], at(rule)["place"]) for rule in RULES])
    per = tested.select("stratum", first.alias("first")).groupBy("stratum").agg(F.count("*").alias("n_good"), F.array(*[F.count_if(F.col("first") <= i) for i in range(1, len(RULES) + 1)]).alias("rejected"))
    run = chosen.join(per, "stratum").select("stratum", "rule", "cutoff", "place", "n_good", F.element_at("rejected", F.col("place")).alias("run_rejected"))
    # more rejected than RISK of all can't pass, and needs no sum
    safe = F.when(F.col("run_rejected") <= risk * F.col("n_good"), binomial_at_most(F.col("run_rejected"), F.col("n_good"), risk) <= level / number).otherwise(False)
    run = run.withColumn("safe", safe)
    longest = run.where("safe").groupBy("stratum").agg(F.max("place").alias("longest"))
    return run.join(longest, "stratum").where("place <= longest").drop("safe", "longest")


def judged(stats: DataFrame, chosen: DataFrame) -> DataFrame:
    """``stats`` with base_failed, failed_rules (names) and kept, by the rules that are on."""
    out = stats.join(_cut(chosen, "cutoff"), "stratum", "left")
    failed = F.array_compact(F.array(*[F.when(_value(rule) > F.try_element_at("cut", F.lit(rule)), F.lit(rule)) for rule in RULES]))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    out = out.withColumn("base_failed", base).withColumn("failed_rules", failed).drop("cut")
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def quality_rules(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    stats = materialize(statistics(docs), "statistics")
    return judged(stats, cutoffs(stats, labels, **how))


def kept_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", **how) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns. Each row is judged where it is read, and no text is shuffled.

    The cutoffs need the statistics of labelled rows: up to ``BROADCAST_LABELS`` ids these are found
    by a broadcast; beyond, all rows are measured, and their statistics meet the labels.
    """
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    known = materialize(_labelled(labels, label).select("doc_id"), "known")
    if known.count() <= BROADCAST_LABELS:
        some = some.join(F.broadcast(known), "doc_id", "left_semi")
    some = statistics(some)
    return judged(statistics(docs, carry=True), cutoffs(some, labels, label, **how)).where("kept").select("_doc.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join(F.array_sort("failed_rules"), ",").alias("failed_rules"))

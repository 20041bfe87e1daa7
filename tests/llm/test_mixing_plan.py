from pyspark.sql import functions as F

from gridloom.llm import mixing, store


def test_cuts_are_part_of_the_plan(spark, tmp_path, monkeypatch):
    """Their tables were files, and for each the JVM started two processes, which count an executor's memory twice while they start."""
    monkeypatch.setattr(store, "shared_root", lambda _: f"file://{tmp_path}")
    source = F.when(F.col("id") % 7 > 0, F.concat(F.lit("s"), F.col("id") % 7))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), source.alias("source"), F.repeat(F.lit("a bc "), (F.col("id") % 11).cast("int")).alias("text"))
    mixed = mixing.mixed(docs)
    rows = sorted(mixed.collect())
    assert len(rows) == 3000 and not list(tmp_path.iterdir())
    # texts are counted once for all that needs the sizes of ranges
    assert "ReusedExchange" in mixed._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(mixing.mixed(docs).collect()) == rows and list(tmp_path.iterdir())

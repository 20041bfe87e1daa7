"""Pipeline stages on rows of null and repeated ids."""

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string"


def test_near_duplicates_keep_one_row(spark):
    text = " ".join(f"w{i}" for i in range(40))
    near, other, third = text + " more", " ".join(f"x{i}" for i in range(40)), " ".join(f"y{i}" for i in range(40))
    rows = [(None, text), (5, text), (5, text), (7, near), (7, other), (None, third), (None, third), (9, None), (9, None), (8, "alone here")]
    docs = spark.createDataFrame([(*r, "en") for r in rows], SCHEMA)
    out = corpus_pipeline.ngram_join_stage(spark, docs, "")
    assert out.columns == docs.columns
    want = [(5, text), (7, other), (None, third), (9, None), (9, None), (8, "alone here")]
    assert sorted(((r[0], r[1]) for r in out.collect()), key=str) == sorted(want, key=str)


def test_leaks_go_by_row(spark, tmp_path):
    item = " ".join(f"q{i}" for i in range(30))
    clean = " ".join(f"c{i}" for i in range(30))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(None, item, "en"), (None, clean, "en"), (4, item, "en"), (4, clean, "en"), (6, None, "en")], SCHEMA)
    out = corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path))
    assert sorted(((r[0], r[1]) for r in out.collect()), key=str) == sorted([(None, clean), (4, clean), (6, None)], key=str)

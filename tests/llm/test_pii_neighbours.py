"""Neighbouring words that have digits, or are long, are patterns too."""

from gridloom.llm import pii


def test_neighbours_with_digits_and_long_ones(spark):
    long = "w" * 90
    rows = [(i, f"say ref2: a{i}@mail.org {long} end") for i in range(20)] + [(100, "say ref2: 7654321 x"), (101, f"x 1234567 {long} end"), (102, f"x 1234567 {'w' * 60} end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: [(x["s"], x["e"]) for x in r["all"]] for r in pii.private_spans(docs).collect()}
    assert out[100] == [(10, 17)] and out[101] == [(2, 9)]

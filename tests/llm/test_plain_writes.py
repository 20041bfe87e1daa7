from gridloom.llm import store


def test_intermediates_have_no_checksum_files(spark, tmp_path, monkeypatch):
    """Each such file took a process of its own, which counts an executor's memory twice while it starts."""
    monkeypatch.setattr(store, "shared_root", lambda _: f"file://{tmp_path}")
    made = store.materialize(spark.range(0, 100, 1, 5), "rows")
    assert made.count() == 100 and len(list(tmp_path.rglob("*.parquet"))) == 5
    assert not list(tmp_path.rglob(".*.crc"))

from netloom.llm import common, line_dedup


def test_shuffled_and_broadcast_joins_agree(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted(map(tuple, line_dedup.report(docs).collect()))
    monkeypatch.setattr(line_dedup, "MAX_BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "MAX_KEYS", 0)
    assert sorted(map(tuple, line_dedup.report(docs).collect())) == want

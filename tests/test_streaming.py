from __future__ import annotations

from datetime import datetime

from folia.streaming import corpus


def test_first_delivery_and_keywords(spark, tmp_path, rows):
    folder = str(tmp_path / "in")
    schema = "eid string, pub_id long, k string, loaded_at timestamp"
    day = lambda d: datetime(2024, 1, d)
    spark.createDataFrame([("a", 1, "X; y", day(1)), ("b", 2, None, day(2))], schema).coalesce(1).write.mode("append").parquet(folder)
    spark.createDataFrame([("a", 1, "X; y", day(3))], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = corpus.read_stream(spark, folder, spark.read.parquet(folder).schema, 1)
    out = corpus.stream_keywords(corpus.first_delivery(stream, "eid", "loaded_at"), "pub_id", "k")
    query = out.writeStream.format("memory").queryName("kw").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert rows(spark.table("kw")) == [(1, "x"), (1, "y"), (2, "unknown")]
    static = spark.read.parquet(folder)
    assert rows(corpus.keyword_counts(static, "k", "loaded_at").select("keyword", "n")) == [("x", 2), ("y", 2)]

from codegrove.streaming.ingest import latest, newest_wins_stream


def test_newest_wins_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id long, t long, o long, v string"
    for batch in ([(1, 1, 0, "a"), (2, 5, 1, "b")], [(1, 3, 2, "c"), (2, 4, 3, "d")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        newest_wins_stream(spark.readStream.schema(schema).parquet(source), ["id"], "t", "o", out, str(tmp_path / "cp")).awaitTermination()
    assert {(r["id"], r["v"]) for r in latest(spark, out).collect()} == {(1, "c"), (2, "b")}

from datetime import datetime

from parlaweave.streaming.mentions import windowed_weights


def test_weights(spark, tmp_path):
    t = datetime(2024, 2, 1, 10)
    rows = [(1, "g", "Ana", 2, t), (1, "g", "Ana", 2, t), (2, "g", "Ana", None, t), (3, "g", None, 1, t), (None, "g", "Ana", 1, t), (4, "g", "Rui", 5, datetime(2024, 2, 2))]
    df = spark.createDataFrame(rows, "speech_id long, graph_id string, word string, weight long, seen_at timestamp")
    df.write.parquet(str(tmp_path / "in"))
    q = windowed_weights(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.word, r.window_start.day): (r.speeches, r.weight) for r in spark.sql("select * from w").collect()}
    assert got == {("Ana", 1): (2, 2), ("Rui", 2): (1, 5)}

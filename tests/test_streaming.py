from lexloom.streaming.chain import amend_stream
from tests.test_documents import ACT, BASE


def test_a_law_is_amended_as_documents_come(spark, tmp_path):
    schema = "law string, ord int, kind string, text string"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    older = ACT.replace("3. Juni 2024", "3. Juni 2023").replace("„Probe“ durch das Wort „Übung“", "„Zweck“ durch das Wort „Ziel“")
    batches = [[("p", 0, "base", BASE), ("p", 1, "act", ACT)], [("p", 2, "act", older), ("p", 3, "act", older)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = amend_stream(spark.readStream.schema(schema).parquet(source))
        query = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    got = {r["place"]: r for r in spark.read.parquet(out).collect()}
    assert set(got) == {1, 2, 3} and got[1]["applied"] == 3
    assert "älter" in got[2]["warnings"] and "schon einmal" in got[3]["warnings"] and "Ziel ist die Übung." in got[2]["text"]

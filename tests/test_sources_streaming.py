import json

from pyspark.sql import functions as F

from notelake.sources import readers
from notelake.streaming import upkeep


def test_scan_markdown_tree(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / ".git").mkdir()
    good = "0190a000-0000-7000-8000-000000000000"
    (tmp_path / "a" / "x.md").write_bytes(f"---\r\nid: {good}\r\ntitle: T\r\n---\r\nbody\r\n".encode())
    (tmp_path / "a" / "y.md").write_text("---\nid: bad\n---\n")
    (tmp_path / "z.md").write_text("---\nopen\n")
    (tmp_path / "p.md").write_text("plain")
    (tmp_path / ".git" / "q.md").write_text("no")
    (tmp_path / "n.txt").write_text("no")
    notes = readers.scan_markdown(spark, str(tmp_path))
    assert {r.path: r.body for r in notes.collect()} == {"a/x.md": "body\n", "a/y.md": "", "z.md": "---\nopen\n", "p.md": "plain"}
    assert {tuple(r) for r in readers.store_problems(notes).collect()} == {("a/y.md", "invalid_id"), ("z.md", "unterminated_frontmatter")}
    assert {r.path for r in readers.scan_untracked(notes).collect()} == {"z.md", "p.md"}
    assert "content" not in readers.scan_stats(spark, str(tmp_path)).columns and readers.scan_stats(spark, str(tmp_path)).count() == 4


def test_work_pages_and_relations(spark, tmp_path):
    for i, items in enumerate(([{"id": 1, "subject": "a"}, {"id": 2, "subject": "b"}], [{"id": 2, "subject": "newer"}]), 1):
        (tmp_path / f"{i}.json").write_text(json.dumps({"offset": i, "total": 3, "_embedded": {"elements": items}}))
    made = readers.load_work_json(spark, str(tmp_path), "struct<id: int, subject: string>")
    assert sorted(tuple(r) for r in made.collect()) == [(1, "a"), (2, "newer")]
    rel = spark.createDataFrame([("1", "2", "blocks", "blocked")], "from_id string, to_id string, type string, reverse_type string")
    assert sorted(tuple(r) for r in readers.work_relations(rel).collect()) == [("1", "blocks", "2"), ("2", "blocked", "1")]


def test_streams_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("session"), "event_type")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = upkeep.session_state(stream, "3650 days").writeStream.outputMode("complete").format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    batch = events.groupBy("session").agg(F.min("ts"), F.max("ts"), F.count("*"))
    assert sorted(map(tuple, spark.table("sessions").collect())) == sorted(map(tuple, batch.collect()))


def test_reconcile_stream_reports_changes_once(spark, tmp_path):
    schema = "ts timestamp, concept_id string, path string, content_hash string"
    for i, rows in enumerate(([("a", "p", "1"), ("b", "q", "1")], [("a", "p", "2"), ("b", "r", "1"), ("c", "s", "1")])):
        spark.createDataFrame([(None, *r) for r in rows], schema).withColumn("ts", F.lit(f"2024-01-0{i + 1}").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    upkeep.reconcile_stream(stream, str(tmp_path / "state"), str(tmp_path / "check"), lambda df, n: seen.append(sorted(map(tuple, df.collect())))).awaitTermination()
    assert seen == [[("a", "new"), ("b", "new")], [("a", "changed"), ("b", "moved"), ("c", "new")]]

"""Keyed streams against batch: replay, out-of-order arrival, and reads only where sizes or times moved."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from notelake.operators import reconcile
from notelake.streaming import keyed

OBSERVED = "path string, seq long, size long, modified_at double, gone boolean, concept_id string, content_hash string"


@pytest.fixture()
def keyed_spark(spark):
    name = keyed._PROVIDER[0]
    before = spark.conf.get(name)
    yield keyed.with_keyed_state(spark)
    spark.conf.set(name, before)


def run(stream, tmp_path, name, once=True):
    query = stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    query.awaitTermination()


def batches(spark, tmp_path, groups, schema):
    for i, rows in enumerate(groups):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for n in os.listdir(tmp_path / "in"):
            if n.endswith(".parquet") and not n.startswith("b"):
                os.rename(tmp_path / "in" / n, tmp_path / "in" / f"b{i}-{n}")
                os.utime(tmp_path / "in" / f"b{i}-{n}", (1_000 + i, 1_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_changes_add_up_to_the_full_pass(keyed_spark, tmp_path):
    def seen(path, seq, text, size=None, concept=None, gone=False):
        return (path, seq, size or len(text or ""), float(seq), gone, None if gone else concept or path[0], None if gone else text)

    steps = [
        [seen("a.md", 1, "one"), seen("b.md", 1, "two"), seen("x.md", 1, None, 3)],
        [seen("a.md", 1, "one"), seen("b.md", 2, "two!")],
        [seen("c.md", 3, "one", concept="a"), seen("a.md", 3, None, gone=True)],
        [seen("b2.md", 4, "again", concept="b"), seen("b.md", 4, None, gone=True), seen("b.md", 5, "back", concept="b")],
        [seen("b.md", 6, None, gone=True), seen("c.md", 6, None, gone=True)],
    ]
    steps[0][2] = ("x.md", 1, 3, 1.0, False, None, None)  # a file that is no document
    stream = keyed.reconcile_changes(batches(keyed_spark, tmp_path, steps, OBSERVED))
    run(stream, tmp_path, "out")
    made = keyed_spark.read.parquet(str(tmp_path / "out")).collect()
    got = sorted((r.concept_id, r.change, r.path or "", r.old_path or "") for r in made)
    assert got == sorted([("a", "new", "a.md", ""), ("b", "new", "b.md", ""), ("b", "changed", "b.md", "b.md"), ("a", "moved", "c.md", "a.md"), ("b", "changed", "b.md", "b.md"), ("b", "changed", "b2.md", "b.md"), ("a", "removed", "", "c.md")])
    # What is held in the end is what a full pass over the last listing holds.
    contents = keyed_spark.createDataFrame([("b2.md", "b", "again")], "path string, concept_id string, content_hash string")
    none = keyed_spark.createDataFrame([], "concept_id string, path string, content_hash string, size long, modified_at double")
    assert [tuple(r) for r in reconcile.reconcile_full(none, contents).collect()] == [("b", "b2.md", "indexed")]
    run(stream, tmp_path, "out")  # nothing new: nothing is told twice
    assert keyed_spark.read.parquet(str(tmp_path / "out")).count() == len(made)


def test_a_replayed_batch_gives_the_same_rows(keyed_spark, tmp_path):
    stream = keyed.reconcile_changes(batches(keyed_spark, tmp_path, [[("a", 1, 1, 1.0, False, "a", "h")], [("a", 2, 2, 2.0, False, "a", "i")]], OBSERVED))
    run(stream, tmp_path, "out")
    first = sorted(map(tuple, keyed_spark.read.parquet(str(tmp_path / "out")).collect()))
    os.remove(tmp_path / "out-state" / "commits" / "1")  # the last batch ended before it was noted down
    if (tmp_path / "out-state" / "commits" / ".1.crc").exists():
        os.remove(tmp_path / "out-state" / "commits" / ".1.crc")
    run(stream, tmp_path, "out")
    assert sorted(map(tuple, keyed_spark.read.parquet(str(tmp_path / "out")).collect())) == first and len(first) == 2


def test_only_moved_files_are_read(keyed_spark, tmp_path):
    root, log = tmp_path / "notes", tmp_path / "reads"
    root.mkdir()
    log.mkdir()

    def read(row):
        with open(row.path, "rb") as file:
            content = file.read()
        open(os.path.join(str(log), f"{os.path.basename(row.path)}-{row.seq}"), "w").close()
        return os.path.basename(row.path), hashlib.sha256(content).hexdigest()

    def listing(seq):
        return [(str(root / n), seq, os.stat(root / n).st_size, os.stat(root / n).st_mtime, False, None, None) for n in sorted(os.listdir(root))]

    for n in range(20):
        (root / f"n{n}").write_text(f"text {n}")
    steps = [listing(1)]
    (root / "n3").write_text("longer text")
    os.utime(root / "n5", (5, 5))
    steps.append(listing(2))
    run(keyed.reconcile_changes(batches(keyed_spark, tmp_path, steps, OBSERVED), read), tmp_path, "out")
    assert sorted(n for n in os.listdir(log) if n.endswith("-2")) == ["n3-2", "n5-2"]
    assert sum(n.endswith("-1") for n in os.listdir(log)) == 20
    made = keyed_spark.read.parquet(str(tmp_path / "out"))
    assert [r.concept_id for r in made.filter("change = 'changed'").collect()] == [] or made.filter("change = 'changed'").count() == 1


def test_checkpoints_out_of_order_equal_batch(keyed_spark, tmp_path):
    kinds = {"signup": "open", "purchase": "wrap"}
    events = keyed_spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("user_id").cast("string").alias("session"), "event_id", F.col("ts").cast("timestamp").alias("at"), "event_type")
    events = events.replace(kinds, subset=["event_type"]).withColumnRenamed("event_type", "kind").filter("session <> '3' or kind <> 'open'")
    batch = reconcile.session_log(events)
    rows = events.orderBy("at", "event_id").collect()
    end = (None, 10**9, rows[-1].at.replace(year=2100), "open")
    # Each event arrives up to two batches early or late; the last row of all moves the watermark past every event.
    groups = [[] for _ in range(6)]
    for i, r in enumerate(rows):
        groups[min(5, max(0, i * 6 // len(rows) + (-1, 0, 1)[(r.event_id * 7) % 3]))].append(tuple(r))
    groups = [*groups, [("end", *end[1:])], [("end", end[1] + 1, end[2].replace(year=2101), "open")], [("end", end[1] + 2, end[2].replace(year=2102), "open")]]
    stream = keyed.append_checkpoints(batches(keyed_spark, tmp_path, groups, "session string, event_id long, at timestamp, kind string"), "3650 days")
    run(stream, tmp_path, "out")
    made = keyed_spark.read.parquet(str(tmp_path / "out")).filter("session <> 'end'").select("session", "event_id", "outcome", "last_seen_at")
    want = batch.select("session", "event_id", "outcome", "last_seen_at")
    assert sorted(map(repr, made.collect())) == sorted(map(repr, want.collect()))
    outcomes = {r.outcome for r in made.select("outcome").distinct().collect()}
    assert outcomes == {"opened", "logged", "refused", "wrapped", "ignored"}

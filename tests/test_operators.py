"""Hand-made cases for rules that the driver tables do not reach."""

from pyspark.sql import functions as F

from notelake.functions import text as T
from notelake.operators import graph, metadata, retrieval, state


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_resolve_path_escapes_and_dots(spark):
    df = spark.createDataFrame([("a/b/c.md", "../d.md"), ("a/b.md", "../../x.md"), ("a/b.md", "./c/./d.md")], "s string, t string")
    assert [r[0] for r in df.select(T.resolve_path(F.col("s"), F.col("t"))).collect()] == ["a/d.md", None, "a/c/d.md"]


def test_stale_exactly_at_the_boundary_and_naive_times(spark):
    df = spark.createDataFrame([("2024-05-15T00:00:00+00:00",), ("2024-05-15T00:00:00",), (None,), ("2024-05-15T02:00:01+02:00",)], "s string")
    assert [r[0] for r in df.select(T.is_stale(F.col("s"), "2024-05-15T00:00:00+00:00")).collect()] == [True, False, False, False]


def test_written_title_prefers_the_heading(spark):
    df = spark.createDataFrame([("x\n# Title here \ny", "a/b-c.md"), ("## no", "a/b-c.md")], "b string, p string")
    assert [r[0] for r in df.select(T.written_title(F.col("b"), F.col("p"))).collect()] == ["Title here", "b c"]


def test_lift_successor_moves_and_stops_on_cycles(spark):
    ranked = spark.createDataFrame([(1, "old", 1), (1, "x", 2), (1, "new", 3), (2, "a", 1), (2, "b", 2), (3, "p", 1), (3, "q", 2)], "query_id int, owner string, rank int")
    links = spark.createDataFrame([("old", "new"), ("p", "q"), ("q", "p")], "old string, new string")
    made = {(q, o): r for q, o, r in (tuple(x) for x in retrieval.lift_successors(ranked, links).select("query_id", "owner", "rank").collect())}
    assert [made[1, o] for o in ("new", "old", "x")] == [1, 2, 3]
    assert {made[3, "p"], made[3, "q"]} == {1, 2}
    assert [made[2, o] for o in "ab"] == [1, 2]


def test_traverse_keeps_first_arrival(spark):
    e = spark.createDataFrame([("b", "r", "d"), ("c", "r", "d"), ("a", "r", "b"), ("a", "r", "c")], "source_id string, relation_type string, target_id string")
    made = graph.traverse(e, spark.createDataFrame([("a",)], "seed string"), 3)
    assert rows(made) == [("a", "b", 1, "a"), ("a", "c", 1, "a"), ("a", "d", 2, "b")]


def test_parent_chain_marks_cycles(spark):
    p = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "child string, parent string")
    made = graph.parent_chain(p, spark.createDataFrame([("a",)], "start string"))
    assert [(r.ancestor, r.depth, r.problem) for r in made.orderBy("depth").collect()] == [("b", 1, None), ("c", 2, None), ("a", 3, "cycle")]


def test_required_closure_reaches_a_fixpoint(spark):
    e = spark.createDataFrame([("x", "s"), ("y", "x"), ("z", "q")], "source_id string, target_id string")
    assert rows(graph.required_closure(spark.createDataFrame([("s",)], "concept_id string"), e)) == [("s",), ("x",), ("y",)]


def test_ledger_twice_changes_nothing_and_reopening_is_a_new_row(spark):
    empty = spark.createDataFrame([], "fingerprint string, path string, detected_at string, resolved_at string")
    found = spark.createDataFrame([("f", "p")], "fingerprint string, path string")
    none = found.limit(0)
    first = state.ledger_reconcile(empty, found, "1")
    assert rows(state.ledger_reconcile(first, found, "2")) == [("f", "p", "1", None)]
    closed = state.ledger_reconcile(first, none, "2")
    assert rows(closed) == [("f", "p", "1", "2")]
    assert len(rows(state.ledger_reconcile(closed, found, "3").filter("resolved_at is null"))) == 1


def test_coalesce_changes_restarts_the_timer(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00.0", "a"), ("2024-01-01 00:00:00.5", "b"), ("2024-01-01 00:00:02.0", "c")], "ts string, path string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r.paths for r in state.coalesce_changes(df, "path").collect()) == [["a", "b"], ["c"]]


def test_duplicate_ids(spark):
    df = spark.createDataFrame([("a", "p"), ("a", "q"), ("b", "r")], "concept_id string, path string")
    assert rows(metadata.duplicate_ids(df)) == [("a", ["p", "q"])]

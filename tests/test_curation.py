"""Curation on hand-computed rows."""

from pyspark.sql import functions as F

from notelake.operators import curation


def test_hazards_name_line_and_column(spark):
    rows = [(1, "a\u200bb\u200c\n/home/user /home/Ann.b and /Users/me"), (2, ""), (3, None), (4, "C:\\Users\\Zoe\r\nx /srv/vault /srv/vault"), (5, "\U000e0041")]
    made = curation.text_hazards(spark.createDataFrame(rows, "doc long, body string"), "doc", "body", ("/srv/vault",))
    assert sorted(map(tuple, made.collect())) == [
        (1, "personal_path_posix", 2, 12),
        (1, "zero_width", 1, 2),
        (1, "zero_width", 1, 4),
        (4, "forbidden_path", 2, 3),
        (4, "personal_path_windows", 1, 1),
        (5, "tag_character", 1, 1),
    ]


def test_watched_paths(spark):
    paths = {"a/b.md": True, "a/.b.md": True, ".git/b.md": False, "a/~b.md": False, "a/.#b.md": False, "b.md.tmp": False, "b.txt": False, "../b.md": False, "/b.md": False, None: False}
    made = spark.createDataFrame([(p,) for p in paths], "p string").select("p", curation.is_watched(F.col("p")).alias("w")).collect()
    assert {r.p: r.w for r in made} == paths


def test_runs_compare_only_on_the_same_cases(spark):
    run = lambda *rows: spark.createDataFrame(rows, "case_id string, k int, recall double")
    one, two = run(("a", 5, 0.5), ("b", 5, 0.5)), run(("a", 5, 1.0), ("b", 5, 1.0))
    # A difference of exactly one case's swing cannot be told apart.
    assert tuple(curation.compare_runs(one, two).first()) == (0.5, 0.5, False, True)
    assert tuple(curation.compare_runs(run(("a", 5, 0.0), ("b", 5, 0.0)), two).first()) == (1.0, 0.5, True, True)
    assert tuple(curation.compare_runs(one, run(("a", 5, 1.0), ("b", 3, 1.0))).first()) == (None, None, None, False)
    assert tuple(curation.compare_runs(one, run(("a", 5, 1.0))).first()) == (None, None, None, False)
    empty = one.limit(0)
    assert tuple(curation.compare_runs(empty, empty).first()) == (None, None, None, False)


def test_identifiers_are_found_whole(spark):
    asked = spark.createDataFrame([(1, "ADR-0002"), (1, " "), (2, "x")], "query_id int, identifier string")
    texts = spark.createDataFrame([("a", "see adr-0002."), ("b", "ADR-00021 my-ADR-0002"), ("c", None)], "concept_id string, body string")
    assert [tuple(r) for r in curation.exact_identifier_lane(asked, texts).collect()] == [(1, "ADR-0002", "a")]


def test_broken_expectations(spark):
    ranked = spark.createDataFrame([(1, "d", 1), (1, "f", 2), (1, "r", 3), (1, "late", 4), (1, "g", 5)], "query_id int, owner string, rank int")
    wanted = [("required", "r"), ("required", "late"), ("required", "absent"), ("forbidden", "f"), ("forbidden", "g"), ("deprioritised", "d"), ("deprioritised", "g"), ("deprioritised", "absent")]
    expected = spark.createDataFrame([(1, k, o) for k, o in wanted + wanted[:1]] + [(2, "required", "r")], "query_id int, kind string, owner string")
    assert sorted(map(tuple, curation.violations(ranked, expected, 3).collect()), key=str) == [
        (1, "deprioritised", "d", 1),
        (1, "forbidden", "f", 2),
        (1, "required", "absent", None),
        (1, "required", "late", None),
        (2, "required", "r", None),
    ]


def test_declared_documents_that_did_not_change(spark):
    docs = spark.createDataFrame([("a", "a.md", "1", "09"), ("b", "b.md", "1", "09"), ("c", "c.md", "1", "09"), ("d", "d.md", "1", "11"), ("e", "e.md", "1", None)], "concept_id string, path string, digest string, modified_at string")
    declared = spark.createDataFrame([("s", x, "10") for x in "aabcdex"], "session string, concept_id string, started_at string")
    given = spark.createDataFrame([("s", "a", "1"), ("s", "b", "0"), ("t", "c", "0")], "session string, concept_id string, digest string")
    made = curation.declared_unchanged(declared, given, docs)
    assert sorted(map(tuple, made.collect())) == [("s", "a.md"), ("s", "c.md")]

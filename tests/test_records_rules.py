"""Records, rules, layout, references, drift and passages on rows worked out by hand."""

import pytest
from pyspark.sql import functions as F

from notelake.functions import layout
from notelake.operators import identity, placement, records, reconcile, references, rules

ID = "0190a000-0000-7000-8000-00000000000"


def notes(spark, fronts):
    rows = [(f"n/{i}.md", str(i), f) for i, f in enumerate(fronts)]
    return spark.createDataFrame(rows, "path string, concept_id string, fm string").withColumn("frontmatter", F.try_parse_json("fm")).drop("fm")


def test_records_keep_what_they_do_not_model(spark):
    made = records.metadata_record(notes(spark, ['{"title":" T ","type":" a ","tags":["x"," ",true,null],"deep":{"b":[1,{"c":null}],"a":2}}', "[1]", None, f'{{"title":[],"workspace":"{ID}1","area":"bad","status":""}}', f'{{"title":"t","workspace":7,"area":"{ID}2"}}', "{}"]))
    got = {r.concept_id: r for r in made.withColumn("extra", records.entries(F.col("extra"))).collect()}
    assert (got["0"].title, got["0"].type, got["0"].tags, got["0"].extra) == (" T ", "a", ["x", "true", "null"], ['deep={"a":2,"b":[1,{"c":null}]}'])
    assert all((got[i].title, got[i].type, got[i].extra, got[i].issues) == (i, "unknown", [], ["missing_title"]) for i in ("1", "2", "5"))
    assert (got["3"].workspace_id, got["3"].issues, got["3"].status) == (f"{ID}1", ["missing_title"], None)
    assert (got["4"].workspace_id, got["4"].issues) == (f"{ID}2", ["invalid_workspace_reference"])
    assert made.filter("false").count() == 0


def test_work_items(spark):
    pages = ['{"id":5,"subject":"S","_links":{"status":{"href":"/1","title":"New"},"assignee":{"href":null,"title":"x"},"parent":{"href":"/w/9/"}},"description":{"raw":"%s"},"customField3":[1],"customFieldZ":1,"percentageDone":0}' % ("ab " * 200), '{"subject":"no id"}', '{"id":"6","description":3}', "[]"]
    df = spark.createDataFrame([(p,) for p in pages], "p string").select(F.parse_json("p").alias("payload"))
    a, b = sorted(records.normalize_work_items(df, "c", "p", "http://t//").withColumn("extensions", records.entries(F.col("extensions"))).collect(), key=lambda r: r.external_id)
    assert (a.title, a.status, a.assignee, a.parent, a.url, a.extensions) == ("S", "New", None, "9", "http://t/work_packages/5", ["customField3=[1]"])
    assert len(a.extra["description_excerpt"]) <= 240 and a.extra["description_excerpt"].endswith("b…") and a.extra["percent_complete"] == "0"
    assert (b.title, b.parent, b.extensions) == ("", None, []) and "description" not in b.extra


REGISTRY = "type string, field string, rule string, argument string, code string, severity string"


def test_a_registry_row_changes_findings_without_code(spark):
    made = notes(spark, ['{"type":"task","size":"big","names":["a",1,"B"]}', '{"type":"other","size":"XL"}', '{"size":null}', "7"])
    words = spark.createDataFrame([("sizes", "big")], "name string, value string")

    def found(*rows):
        return sorted((r.path, r.code, r.value) for r in rules.apply_rules(made, spark.createDataFrame(rows, REGISTRY), words).collect())

    one = ("task", "size", "one_of", "sizes", "size", "error")
    assert found(one) == []
    assert found(("*", *one[1:])) == [("n/1.md", "size", "XL")]
    assert found(("task", "size", "pattern", "^[A-Z]+$", "size", "error")) == [("n/0.md", "size", "big")]
    assert found(("*", "size", "required", None, "gone", "error")) == [("n/3.md", "gone", "")]
    assert found(("*", "names", "list_of_strings", None, "kind", "error"), ("*", "names", "lowercase_items", None, "case", "warning")) == [("n/0.md", "case", "B"), ("n/0.md", "kind", "1")]
    assert found(("*", "size", "boolean", None, "b", "error")) == [("n/0.md", "b", "big"), ("n/1.md", "b", "XL"), ("n/2.md", "b", "null")]
    assert found(("*", "size", "one_of", "no such list", "size", "error"), ("*", "size", "unheard of", None, "x", "error")) == [("n/0.md", "size", "big"), ("n/1.md", "size", "XL")]


@pytest.mark.parametrize(
    "path, workspace, section",
    [
        ("10_Workspaces/A/workspace.md", "10_Workspaces/A", None), ("10_Workspaces/A/Goals/g.md", "10_Workspaces/A", "Goals"), ("10_Workspaces/index.md", None, None), ("10_Workspaces/A/Workspaces/b.md", "10_Workspaces/A", "Workspaces"),
        ("10_Workspaces/A/Workspaces/B/Workspaces/C/x/y.md", "10_Workspaces/A/Workspaces/B/Workspaces/C", "x"), ("20_Life/L/Workspaces/P/Logs/l.md", "20_Life/L/Workspaces/P", "Logs"), ("20_Life/L/Workspaces/x.md", None, None), ("90_Archive/Workspaces/A/z.md", "90_Archive/Workspaces/A", None), ("home.md", None, None),
    ],
)
def test_workspaces(spark, path, workspace, section):
    r = spark.createDataFrame([(path,)], "p string").select(layout.workspace_dir(F.col("p")).alias("w"), layout.workspace_section(F.col("p")).alias("s")).first()
    assert (r.w, r.s) == (workspace, section)


def test_placement(spark):
    places = spark.createDataFrame([("note", "directory", "30_Knowledge/Notes", True), ("idea", "workspace_section", "Ideas", False)], "type string, kind string, value string, binding boolean")
    rows = [("30_Knowledge/Notes/a.md", "note"), ("30_Knowledge/Notes/x/a.md", "note"), ("90_Archive/Knowledge/Notes/a.md", "note"), ("00_Inbox/a.md", "note"), ("10_Workspaces/A/Ideas/x/i.md", "idea"), ("10_Workspaces/A/i.md", "idea"), ("z.md", None), ("z.md", "new")]
    made = placement.rule_placement(spark.createDataFrame(rows, "path string, type string"), places)
    assert sorted(map(tuple, made.collect())) == [("10_Workspaces/A/i.md", "misplaced_document", "warning"), ("30_Knowledge/Notes/x/a.md", "misplaced_document", "error"), ("30_Knowledge/Notes/x/a.md", "nested_flat_area", "error")]


def test_references_try_roots_in_order(spark):
    text = "[a](one/a.md) [b](./two/b.py) [c](three/c.md) [up](../x/y.md) [w](http://a/b.md) [g](a/*.md) [n](a.md) [t](one/a.txt) [a](one/a.md)"
    files = spark.createDataFrame([("o", "f", text, ["r1", None, "r2"]), ("p", "f", None, ["r1"]), ("q", "f", "[c](three/c.md)", [])], "owner string, file string, text string, roots array<string>")
    listing = spark.createDataFrame([("r1", "one/a.md"), ("r2", "two/b.py"), ("r3", "three/c.md"), ("r1", "x/y.md")], "root string, path string")
    assert sorted(map(tuple, references.broken_references(files, listing).collect())) == [("o", "f", "../x/y.md"), ("o", "f", "three/c.md"), ("q", "f", "three/c.md")]


def test_drift_of_all_states(spark):
    records_ = spark.createDataFrame([(s, None if s == "i" else "d", u) for s, u in (("n", "current"), ("l", "unknown"), ("u", "ahead"), ("b", "ahead"), ("i", "current"), ("o", "current"))], "subject string, tree_digest string, upstream string")
    was = spark.createDataFrame([("n", "p", "1"), ("l", "p", "1"), ("l", "q", "1"), ("u", "p", "1"), ("b", "p", "1"), ("i", "p", "1"), ("o", "p", "1")], "subject string, path string, digest string")
    now = spark.createDataFrame([("n", "p", "1"), ("l", "p", "2"), ("l", "r", "1"), ("u", "p", "1"), ("b", "z", "1"), ("i", "p", "9"), ("m", "p", "1")], "subject string, path string, digest string")
    got = {r.subject: (r.state, r.drift, r.changed) for r in references.provenance_drift(records_, was, now).collect()}
    assert got == {"n": ("recorded", "none", []), "l": ("recorded", "local", ["p", "q", "r"]), "u": ("recorded", "upstream", []), "b": ("recorded", "both", ["p", "z"]), "i": ("incomplete", None, None), "o": ("orphaned", None, None), "m": ("missing", None, None)}


def test_passages(spark):
    hits = spark.createDataFrame([(1, "a", "k1"), (1, "a", "old"), (2, "gone", "k"), (2, "a", None)], "query_id int, owner string, chunk_key string")
    chunks = spark.createDataFrame([("a", 0, "k0", " open  ing\n", 1, 2), ("a", 1, "k1", "x" * 400, 3, 4), ("a", 2, "k1", "later", 5, 6)], "owner string, ordinal int, chunk_key string, text string, start_line int, end_line int")
    got = {(r.query_id, r.chunk_key): (r.passage[:8], len(r.passage), r.start_line, r.moved) for r in references.hit_passages(hits, chunks).collect()}
    assert got == {(1, "k1"): ("xxxxxxxx", 320, 3, False), (1, "old"): ("open ing", 8, 1, True), (2, "k"): ("", 0, None, True), (2, None): ("", 0, None, False)}


def test_referrers(spark):
    links = spark.createDataFrame([("s1", "p", None, "t"), ("s2", None, "Name", "t"), ("s3", None, "other", "x"), ("s4", "q", None, None), ("s5", None, "kept", "t")], "source string, target_path string, target_name string, target_id string")
    kind = "concept_id string, path string, names array<string>"
    before, changed = spark.createDataFrame([("t", "p", ["name", "Kept"])], kind), spark.createDataFrame([("t", "p2", ["kept"]), ("n", "q", ["OTHER"])], kind)
    assert sorted(r.source for r in reconcile.referrers_to_revisit(links, before, changed).collect()) == ["s1", "s2", "s3", "s4"]
    assert reconcile.referrers_to_revisit(links, before, before).collect() == []


def test_session_log(spark):
    rows = [("a", 1, 1, "write"), ("a", 2, 2, "open"), ("a", 3, 3, "write"), ("a", 4, 3, "write"), ("a", 5, 4, "open"), ("a", 6, 5, "wrap"), ("a", 7, 6, "wrap"), ("a", 8, 7, "write"), ("b", 9, 1, "wrap"), (None, 10, 1, "open")]
    df = spark.createDataFrame(rows, "session string, event_id long, t int, kind string").withColumn("at", F.timestamp_seconds("t"))
    got = {r.event_id: (r.outcome, r.place) for r in reconcile.session_log(df).collect()}
    assert got == {1: ("refused", None), 2: ("opened", None), 3: ("logged", 1), 4: ("logged", 2), 5: ("refused", None), 6: ("wrapped", None), 7: ("ignored", None), 8: ("logged", 3), 9: ("refused", None), 10: ("refused", None)}


def test_blocks_references_and_reserved_files(spark):
    made = notes(spark, ['{"by":{"who":"a","at":"2024-02-29T10:00:00+02:00"}}', '{"by":[{"who":"B","at":"2023-02-29T10:00:00Z"},null,{"who":"c"},7]}', '{"home":null,"area":1}', '{"schema":"2"}'])
    none = spark.createDataFrame([], "name string, value string")

    def found(*rule):
        return sorted((r.path, r.value) for r in rules.apply_rules(made, spark.createDataFrame([("*", *rule, "code", "error")], REGISTRY), none).collect())

    assert found("by", "members", "who,at") == [] and found("by", "each_members", "who,at") == [("n/1.md", "who")]
    assert found("by", "each_member_pattern", "who,at|^[a-z]$") == [("n/1.md", "B")] and found("by", "member_pattern", "who,at|^[b-z|]$") == [("n/0.md", "a")]
    assert found("by", "member_time", "at,who") == [] and found("by", "each_member_time", "at,who") == [("n/1.md", "2023-02-29T10:00:00Z")]
    assert found("by", "each_mapping", None) == [("n/1.md", "7")]
    assert found("home", "reference", None) == [("n/2.md", "null")] and found("area", "alone", "home") == [("n/2.md", "1")] and found("area", "alone", "other") == []
    assert found("schema", "equals", "2") == [] and found("schema", "equals", "1") == [("n/3.md", "2")]
    files = [("index.md", '{"okf_version":1,"type":"x"}'), ("a/index.md", '{"okf_version":1}'), ("a/log.md", "{}"), ("a/b.md", '{"type":"x"}'), ("index.md", '{"okf_version":1}'), ("a/log.md", None)]
    held = spark.createDataFrame(files, "path string, fm string").select("path", F.parse_json("fm").alias("frontmatter"))
    assert sorted((r.path, r.value) for r in rules.reserved_findings(held).collect()) == [("a/index.md", "okf_version"), ("index.md", "type")]


def test_identities(spark):
    kind = "path string, concept_id string, type string"
    rows = [("a.md", "i1", "note"), ("b.md", "i1", "note"), ("c.md", None, None), ("d.md", None, None), ("00_Inbox/e.md", None, None), ("x/log.md", None, None), ("f.md", None, None), ("s.md", "i9", "system_manifest")]
    known = spark.createDataFrame([("c.md", "i5"), ("f.md", "i1")], "path string, concept_id string")
    made = {(r.path, r.code, r.value) for r in identity.identity_checks(spark.createDataFrame(rows, kind), known).collect()}
    assert made == {("a.md", "duplicate_id", "i1"), ("b.md", "duplicate_id", "i1"), ("c.md", "identity_lost", "i5"), ("d.md", "untracked_document", ""), ("f.md", "identity_lost", "i1"), ("s.md", "duplicate_vault_identity", "i9"), ("50_System/system.md", "no_vault_identity", "")}
    there = identity.identity_checks(spark.createDataFrame([("50_System/system.md", "i0", "system_manifest")], kind), known)
    assert there.count() == 0
    assert [r.code for r in identity.identity_checks(spark.createDataFrame([], kind), known).collect()] == ["no_vault_identity"]

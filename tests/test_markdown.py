from notelake.functions import markdown as M


def test_fences_hide_headings_and_links():
    text = "# A\n```\n# not\n[x](y.md)\n```\n~~~\n```\n# no\n~~~\nB\n===\n[a](b.md) `[c](d.md)` ![i](j.png) [[Name|shown]]\n"
    assert [h[2] for h in M.headings(M.lines_of(text))] == ["A", "B"]
    assert M.links(text) == [("b.md", False), ("Name", True)]


def test_sections_nest_and_drop_trailing_blanks():
    assert M.sections("lead\n\n# A\nx\n## B\ny\n\n# C\n") == [([], 1, ["lead"]), (["A"], 3, ["# A", "x"]), (["A", "B"], 5, ["## B", "y"]), (["C"], 8, ["# C"])]


def test_chunks_cut_at_blank_lines_then_items_never_in_prose():
    prose = "word " * 300
    made = M.cut_chunks(["# H", "", prose, "", prose])
    assert [len(p) for _, p in made] == [4, 1] or [p[0] for _, p in made] == ["# H", prose]
    items = ["- " + "x" * 900 for _ in range(5)]
    assert all(len("\n".join(p)) <= 2000 for _, p in M.cut_chunks(items))
    assert len(M.cut_chunks(["y" * 5000])) == 1


def test_front_matter_needs_a_closing_fence():
    assert M.split_frontmatter("---\na: 1\n---\nbody") == ("a: 1", "body", 3)
    assert M.split_frontmatter("---\na: 1\nbody") == (None, "---\na: 1\nbody", 0)

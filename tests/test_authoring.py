"""Pages out of concepts, one after the other where they are for one page."""

from __future__ import annotations

from docloom.operators import authoring


def test_concepts_of_one_page_follow_each_other(spark):
    pages = spark.createDataFrame([("Old", "Old name", "---\nsource_files: [a.md]\n---\n\n# Old name\n\nText.")], "slug string, name string, content string")
    rows = [
        ("a.md", "Fresh", "s", None, None, "t1"), ("b.md", "Fresh", "s", None, None, "t2"), ("c.md", "Fresh", "s", None, None, "t3"),
        ("d.md", "Any", "s", "Old name", "exact", "t"), ("e.md", "Any", "s", "Old", "exact", "t"), ("f.md", "Other", None, "Old name", "similar", None),
        ("g.md", "Lost", "s", "Gone", "exact", "t"), ("h.md", "!?", "s", None, None, "t"), ("i.md", "Blank", "s", None, None, "t"),
    ]
    concepts = spark.createDataFrame(rows, "source string, name string, summary string, existing_match string, match_type string, text string")

    def model(prompts):
        out = []
        for p in prompts:
            if "Blank" in p:
                out.append(None)
            elif "기존 문서:" not in p:
                out.append("# " + p.split("\n")[0].removeprefix("개념: ") + "\n\nfrom " + p.strip().rsplit("\n", 1)[-1])
            elif "\n\nt2\n\n" in p:
                out.append("ACTION: complement\n---CONTENT---\n" + p.split("기존 문서:\n")[1] + " and t2")
            elif "출처: e.md" in p:
                out.append("ACTION: conflict\nCONFLICT_SUMMARY: e differs")
            else:
                out.append("ACTION: duplicate")
        return out

    touched, log = authoring.compiled(concepts, pages, model, "2026-01-02")
    got = {r.slug: (r.name, r.content) for r in touched.collect()}
    assert got["Fresh"] == ("Fresh", "---\nlast_updated: 2026-01-02\nsource_files:\n- c.md\n---\n\n# Fresh\n\nfrom t1 and t2")
    assert got["Old"][1].startswith("---\nlast_updated: 2026-01-02\nsource_files:\n- a.md\n- d.md\n- e.md\n---\n\n> ⚠️") and got["Old"][1].endswith("# Old name\n\nText.")
    assert set(got) == {"Fresh", "Old", "Other", "Lost"}
    done = {(r.round, r.slug, r.source): (r.action, r.conflict_summary) for r in log.collect()}
    assert done[(1, "Fresh", "a.md")] == ("created", None) and done[(2, "Fresh", "b.md")] == ("complemented", None) and done[(3, "Fresh", "c.md")] == ("duplicate", None)
    assert done[(1, "Old", "d.md")] == ("duplicate", None) and done[(2, "Old", "e.md")] == ("conflict", "e differs") and done[(1, "Blank", "i.md")] == ("", None)
    empty = authoring.compiled(concepts.limit(0), pages, model, "2026-01-02")
    assert empty[0].count() == 0 and empty[1].count() == 0

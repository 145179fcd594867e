from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from docloom import session
from docloom.functions import text as fx
from docloom.operators import chunking, compiling, context, graph, incremental, links, relations
from docloom.operators.components import components
from docloom.settings import DEFAULT, SMALL, TINY, Settings
from docloom.sources import export, ingest
from docloom.streaming import watch


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


def test_budgets():
    assert (DEFAULT.available, SMALL.available, TINY.available) == (189_000, 8_500, 1_500)
    assert (DEFAULT.ontology_budget, SMALL.ontology_budget) == (8_000, 1_275)
    assert Settings(context_limit=12_000).ontology_budget == 1_000


def test_tokens_and_strategy(spark):
    got = spark.createDataFrame([("",), (None,), ("abcd",), ("abcde",), ("한국",)], "t string").select(fx.estimate_tokens(F.col("t"))).collect()
    assert [r[0] for r in got] == [1, 1, 1, 2, 2]
    n = spark.createDataFrame([(6800,), (6801,), (25500,), (25501,)], "n long")
    assert [r[0] for r in n.select(fx.strategy(F.col("n"), SMALL)).collect()] == ["single_pass", "map_reduce", "map_reduce", "hierarchical"]


def test_front_matter(spark):
    text = "---\ntitle: A b\nlang: en\n---\n\n# H\n\n## 핵심 요약\n\nShort.\n\n## 관련 개념\n- [[X|y]]\n* Z\n1. (없음)\n"
    c = F.col("t")
    assert one(spark, fx.title(c, F.lit("a_b")), t=text) == "A b"
    assert one(spark, fx.title(c, F.lit("a_b")), t="no heading") == "a b"
    assert one(spark, fx.title(c, F.lit("a_b")), t="# Top\nx") == "Top"
    assert one(spark, fx.summary(c), t=text) == "Short."
    assert one(spark, fx.list_items(c, "관련 개념"), t=text) == ["X", "Z"]
    assert one(spark, fx.first_paragraph(c), t=text) == "# H\n\n## 핵심 요약"
    assert one(spark, fx.front_matter(c), t="---\nopen") is None
    assert one(spark, fx.body(c), t="---\nopen") == "---\nopen"


def test_json_array(spark):
    c = F.col("t")
    for text in ('```json\n[{"a": 1}]\n```', 'Sure: [{"a": 1}] bye', '[{"a": 1}]'):
        assert one(spark, fx.json_array(c), t=text) == '[{"a": 1}]'
    assert one(spark, fx.json_array(c), t="none") == ""


def test_byte_tail_keeps_whole_characters(spark):
    assert one(spark, fx.byte_tail(F.col("t"), 4), t="한국어") == "어"
    assert one(spark, fx.byte_tail(F.col("t"), 100), t="한국어") == "한국어"


def packed_by_hand(tokens, most):
    out, n, used, shut = [], -1, 0, True
    for t in tokens:
        if shut or t > most or used + t > most:
            n, used = n + 1, t
        else:
            used += t
        shut = t > most
        out.append(n)
    return out


def test_pack_sections_is_next_fit(spark):
    rng = random.Random(3)
    texts = {d: "\n\n".join(f"# S{k}\n" + "w" * rng.randint(1, 500) for k in range(rng.randint(1, 12))) for d in range(20)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, content string")
    got = chunking.pack(chunking.sections(docs), 100).orderBy("doc_id", "pos", "part").collect()
    for d in texts:
        mine = [r for r in got if r["doc_id"] == d]
        # one long word stays whole, so a section is one unit
        assert [r["chunk"] for r in mine] == packed_by_hand([r["tokens"] for r in mine], 100)
        assert len(mine) == texts[d].count("# S")


def test_long_sentence_stays_whole(spark):
    long_ = "x" * 2000
    parts = one(spark, chunking.split_paragraphs(F.col("t"), 100), t=f"A b. {long_}. C d.\n\nshort one\n\nshort two")
    assert parts == ["A b.", long_ + ".", "C d.", "short one\n\nshort two"]


def test_chunks_carry_headers_and_overlap(spark):
    text = "\n\n".join(f"## Part {k}\n\n" + " ".join(f"word{k}x{j}." for j in range(400)) for k in range(8))
    chunks = chunking.chunk_documents(spark.createDataFrame([(1, text), (2, "tiny"), (3, ""), (4, None)], "doc_id long, content string"), TINY).orderBy("doc_id", "index").collect()
    mine = [c for c in chunks if c["doc_id"] == 1]
    assert {c["strategy"] for c in mine} == {"hierarchical"} and [c["index"] for c in mine] == list(range(1, len(mine) + 1))
    assert [c["group"] for c in mine] == [k // 2 for k in range(len(mine))]
    assert all("<!-- overlap -->" in c["content"] for c in mine[1:]) and "overlap" not in mine[0]["content"]
    assert mine[0]["content"].startswith(f"[Doc 1 / Part 0 / {len(mine)}개 중 1번째]")
    assert [c["content"] for c in chunks if c["doc_id"] == 2] == ["[Doc 2 / 전체 / 1개 중 1번째]\n\ntiny"]
    assert {c["doc_id"] for c in chunks} == {1, 2}


def greedy_by_hand(rows, budget):
    out = []
    for i, _, t in sorted(rows, key=lambda r: (r[1], r[0])):
        if budget <= 0:
            break
        if t <= budget:
            budget -= t
            out.append((i, budget))
    return out


@pytest.mark.parametrize("block", [1, 4, 1024])
def test_greedy_skips_and_goes_on(spark, block, monkeypatch):
    monkeypatch.setattr(context, "BLOCK", block)
    rng = random.Random(block)
    rows = [(i, rng.choice([-3.0, -2.0, -1.0]), rng.randint(1, 40)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, rank double, tokens long")
    got = [(r["id"], r["remaining"]) for r in sorted(context.greedy(df, 150).collect(), key=lambda r: -r["remaining"])]
    assert got == greedy_by_hand(rows, 150)


def test_relevance_counts_repeats(spark):
    words = fx.question_words("Eau, eau and X1 a")
    assert words == ["eau", "eau", "and", "x1"]
    assert one(spark, fx.relevance(words, F.col("t"), F.col("s")), t="the EAU", s="x1_y") == pytest.approx((1 + 1 + 2) / 4)


def test_links(spark):
    pages = spark.createDataFrame([("A", "[[B]] [[B|x]] [[A]] [[no#way]] [[Q q]]"), ("B", "[[A]]"), ("C", "none")], "slug string, content string")
    assert sorted((r.slug, r.target) for r in links.links(pages).collect()) == [("A", "A"), ("A", "B"), ("A", "B"), ("A", "Q_q"), ("B", "A")]
    assert links.missing_backlinks(pages).count() == 0
    assert {(r.target, r.files) for r in links.unresolved(pages).collect()} == {("Q_q", "A")}
    edges = links.export_edges(pages).collect()
    assert [(r.source, r.target, r.n) for r in edges] == [("A", "B", 3)]
    assert {(r.slug, r.link_count) for r in links.export_nodes(pages).collect()} == {("A", 1), ("B", 2), ("C", 0)}
    renamed = links.rename(pages, spark.createDataFrame([("B", "New")], "old string, new string")).collect()
    assert [(r.slug, r.n_changed, r.content) for r in renamed] == [("A", 2, "[[New]] [[New|x]] [[A]] [[no#way]] [[Q q]]")]


def test_walks_on_a_cycle(spark):
    e = graph.edges(spark.createDataFrame([("a", "ENABLES", "b", 0.5, "", 1), ("b", "ENABLES", "a", 0.5, "", 2), ("a", "CO_OCCURS", "c", None, "", 3), ("a", "X", "b", 0.1, "", 4), (" ", "IS_A", "b", 0.1, "", 5), ("a", "CONTRADICTS", "b", 0.1, "one", 6), ("a", "CONTRADICTS", "b", 0.1, "two", 7)], "subject string, predicate string, object string, confidence double, reason string, seq long"))
    assert e.count() == 4
    assert [r.reason for r in e.where("predicate = 'CONTRADICTS'").collect()] == ["two"]
    assert [r.weight for r in e.where("predicate = 'CO_OCCURS'").collect()] == [0.7]
    assert {(r.start, r.node, r.hops) for r in graph.reach(e, ["ENABLES"], 4, least=2).collect()} == {("a", "a", 2), ("a", "b", 3), ("b", "b", 2), ("b", "a", 3)}
    assert {(r.start, r.node) for r in graph.reach(e, ["CO_OCCURS"], 2, undirected=True).collect()} == {("a", "c"), ("c", "a"), ("a", "a"), ("c", "c")}


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_relations(spark):
    concepts = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    rows = spark.createDataFrame([(1, 1, 2, "parent"), (2, 1, 2, "child"), (3, 2, 2, "related"), (4, 2, 3, "odd"), (5, 3, 9, "child")], "seq long, source long, target long, type string")
    first = relations.first_of_pair(relations.valid(rows, concepts))
    assert {(r.source, r.target, r.type) for r in relations.with_inverses(first).collect()} == {(1, 2, "parent"), (2, 1, "child"), (2, 3, "related")}


def test_changes_and_cache(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    store = spark.createDataFrame([("a", "1"), ("b", "x"), ("z", "9")], "path string, sha256 string")
    assert {(r.path, r.status) for r in incremental.changes(files, store).collect()} == {("b", "modified"), ("c", "new"), ("z", "deleted")}
    asked = spark.createDataFrame([("k1", "p1"), ("k2", "p2"), ("k2", "p2")], "key string, prompt string")
    cache = spark.createDataFrame([("k1", "old")], "key string, response string")
    assert {(r.key, r.response) for r in incremental.complete(asked, cache, lambda ps: [p.upper() for p in ps]).collect()} == {("k1", "old"), ("k2", "P2")}


def test_concepts_merge_deterministically(spark):
    outputs = [(1, 2, '[{"name": "A", "summary": "long one", "existing_match": null, "match_type": null}]'), (1, 1, 'x ```json\n[{"name": "A", "summary": "short", "existing_match": "M", "match_type": "exact"}, {"name": " ", "summary": "s"}]\n```'), (1, 3, "broken [")]
    got = [compiling.merge_concepts(compiling.parse_concepts(spark.createDataFrame(o, "source long, idx long, output string"))).collect() for o in (outputs, outputs[::-1])]
    assert got[0] == got[1] and [(r.name, r.chunks, r.summary, r.existing_match) for r in got[0]] == [("A", "1,2", "long one", "M")]


def test_html_round(spark):
    md = ingest.html_to_markdown("<html><head><title>T</title><style>p{}</style></head><body><nav>no</nav><h1>Head</h1><p>A <a href='/x'>link</a> &amp; b<script>var a='</p>'</script></p><ul><li>one</ul></body></html>")
    assert md == "# Head\n\nA [link](/x) & b\n\n- one"
    assert ingest.html_to_markdown(None) == ""
    html = export.markdown_to_html("---\na: b\n---\n# T <x>\n\n- a **b**\n- [[P q|r]]\n\n```\n<c>\n```\n\n| h | i |\n|---|---|\n| 1 | 2 |\n")
    for part in ("<h1>T &lt;x&gt;</h1>", "<li>a <strong>b</strong></li>", '<a href="P_q.html">r</a>', "&lt;c&gt;", "<tr><td>1</td><td>2</td></tr>"):
        assert part in html
    assert len(re.findall("<ul>", html)) == 1
    assert "<tr><th>h</th><th>i</th></tr>" in html
    assert export.markdown_to_html("- a\n  1. b\n  2. c\n- d").replace("\n", "") == "<ul><li>a<ol><li>b</li><li>c</li></ol></li><li>d</li></ul>"
    assert export.markdown_to_html("`**x**` and **`y`**") == "<p><code>**x**</code> and <strong><code>y</code></strong></p>"
    assert export.markdown_to_html("```\n# no") == "<pre>\n# no\n</pre>"
    assert export.markdown_to_html(None) == ""


def test_web_tables_and_main_part():
    md = ingest.html_to_markdown("<table><tr><th>a<th>b|c</tr><tr><td><p>1</p><p>2</p></td><td><table><tr><td>x<td>y</table></td></table>z")
    assert [x for x in md.split("\n") if x] == ["| a | b\\|c |", "|---|---|", "| 1 2 | x y |", "z"]
    assert ingest.html_to_markdown(f"<body>aside<main><p>{'w ' * 150}</p></main></body>") == ("w " * 150).strip()
    assert ingest.html_to_markdown("<body>aside<main><p>w</p></main></body>") == "aside\n\nw"


def test_sources(spark):
    assert one(spark, ingest.video_id(F.col("u")), u="https://www.youtube.com/watch?v=abcDEF_-123&x=1") == "abcDEF_-123"
    assert one(spark, ingest.source_kind(F.col("u")), u="deck.PPTX") == "ppt"
    assert one(spark, ingest.slide_numbers(F.col("u")), u="1,3,5-8, 3") == [1, 3, 5, 6, 7, 8]
    segments = spark.createDataFrame([(1, 1, 0, "a"), (1, 2, 119, "b"), (1, 3, 120, "c"), (1, 4, 239, "d"), (1, 5, 600, "e")], "video_id long, event_id long, start long, text string")
    assert sorted((r.section, r["first"], r.n) for r in ingest.transcript_sections(segments).collect()) == [(0, 0, 2), (1, 120, 2), (2, 600, 1)]


def test_streams_close_bursts(spark):
    rows = spark.sql("SELECT k AS key, timestamp_seconds(t) AS ts, 'x' AS action FROM VALUES (1L, 0), (1L, 1), (1L, 100), (2L, 5), (9L, 100000) AS v(k, t)")
    stream = watch.watched(spark, watch.as_folder(rows, "s"), "key long, ts timestamp, action string")
    got = {(r.key, r.n) for r in watch.drained(watch.debounced(stream, "10 seconds", "1 second"), "b").collect()}
    assert got >= {(1, 2), (1, 1), (2, 1)}


def by_batch(log, gap):
    window = F.window("ts", "1 hour") if gap is None else F.session_window("ts", gap)
    own = ["action"] if gap is None else ["key"]
    return sorted(map(tuple, log.groupBy(window.alias("w"), *own).agg(F.count("*").alias("n")).select("w.start", *([*own, "n"] if gap is None else ["w.end", *own, "n"])).collect()), key=str)


def test_stream_queries_keep_the_whole_log(spark):
    from docloom.jobs import knowledge
    from docloom.sources import views
    from tests.conftest import SF

    log = views.activity(spark, SF).select("ts", "action", F.col("member").alias("key"))
    assert sorted(map(tuple, knowledge.activity_stream_counts(spark, SF).select("start", "action", "n").collect()), key=str) == by_batch(log, None)
    assert sorted(map(tuple, knowledge.debounce_stream(spark, SF).select("start", "end", "key", "n").collect()), key=str) == by_batch(log, "1 hour")


def test_streams_over_many_files_and_arrivals(spark):
    """Each arrival has nine files, and each file rows of all its days; bursts cross arrivals."""
    log = spark.range(3000).selectExpr("timestamp_seconds(id * 1100) AS ts", "if(id % 2 = 0, 'a', 'b') AS action", "id % 2 AS key").repartition(9)
    log = log.unionByName(spark.createDataFrame([(None, "a", 1)], "ts timestamp, action string, key long"))
    for rows in (1100,):
        got = watch.replayed(log, lambda x: watch.counts(x, late="1 day"), "hourly", rows).select("start", "action", "n")
        assert sorted(map(tuple, got.collect()), key=str) == by_batch(log, None)
        got = watch.replayed(log, lambda x: watch.debounced(x, "1 hour", "1 day"), "bursts", rows).select("start", "end", "key", "n")
        assert sorted(map(tuple, got.collect()), key=str) == by_batch(log, "1 hour")
    assert watch.replayed(log.limit(0), lambda x: watch.counts(x), "hourly").count() == 0


def test_temporary_tables_go(spark):
    kept = session.scratch(spark, "kept")
    with session.temporary(spark):
        gone = session.materialize(spark.range(5), "gone")
        out = session.materialize(gone.where("id > 2"), "kept", kept)
    assert sorted(r.id for r in out.collect()) == [3, 4]
    with pytest.raises(Exception, match="(?i)exist"):
        gone.count()

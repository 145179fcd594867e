"""Queries that parse models' answers, write pages anew, and turn rows of office files into Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.jobs.corpus import _BODY, _LINKS, TRIM
from docloom.jobs.knowledge import _EDGES
from docloom.jobs.more import _EXPAND
from docloom.jobs.registry import query
from docloom.operators import graph, incremental, outputs, pages
from docloom.session import table
from docloom.sources import ingest, office, views
from docloom.sources.views import with_views

NL = "chr(10)"


def _md5(column: str) -> Column:
    return F.md5(F.col(column).cast("binary")).alias(column)


# Models' answers. The SQL parses the same answers with another engine's JSON functions.

_ANSWERS = "a0 AS (SELECT conv_id, turn, output, regexp_extract(output, '(?s)\\[.*\\]') AS j FROM {0}), a AS (SELECT conv_id, turn, k - 1 AS pos, json_extract(j, '$[' || (k - 1) || ']') AS t FROM a0, unnest(range(1, json_array_length(j)::BIGINT + 1)) u(k))"
_S = lambda name: f"trim(coalesce(json_extract_string(t, '$.{name}'), ''))"
_P = ", ".join(f"'{p}'" for p in graph.PREDICATES)
_TRIPLES = f"""{_ANSWERS.format('triple_outputs')}, p AS (SELECT conv_id AS source, turn AS idx, pos, {_S('subject')} AS subject, upper({_S('predicate')}) AS predicate, {_S('object')} AS object,
  round(least(greatest(coalesce(TRY_CAST(json_extract_string(t, '$.confidence') AS DOUBLE), 0.7), 0), 1), 2)::DOUBLE AS confidence, {_S('reason')} AS reason FROM a), pt AS (SELECT * FROM p WHERE subject <> '' AND object <> '' AND predicate IN ({_P}))"""


def _answers(df: DataFrame) -> DataFrame:
    return df.select(F.col("conv_id").alias("source"), F.col("turn").alias("idx"), "output")


@query(with_views(f", {_TRIPLES} SELECT * FROM pt", "triple_outputs"))
def triples_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outputs.parse_triples(_answers(views.triple_outputs(spark, sf_dir))).withColumn("pos", F.col("pos").cast("long"))


@query(with_views(f", {_TRIPLES}, g AS (SELECT subject AS src, predicate, object AS dst, max(struct_pack(s := source, i := idx, p := pos, c := confidence)) AS l FROM pt GROUP BY ALL) SELECT predicate, src, dst, CASE WHEN predicate = 'CO_OCCURS' THEN l.c END AS weight FROM g", "triple_outputs"))
def edges_of_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph that all answers give; of repeated statements the last counts."""
    found = outputs.parse_triples(_answers(views.triple_outputs(spark, sf_dir)))
    return graph.edges(found.withColumn("seq", F.struct("source", "idx", "pos"))).drop("reason")


@query(with_views(f", {_TRIPLES} SELECT source, count(*) AS n FROM pt WHERE source % 3 = 0 OR source % 5 = 0 GROUP BY source", "triple_outputs"))
def triples_of_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only pages that changed after their statements were taken, or have none, are read again."""
    answers = _answers(views.triple_outputs(spark, sf_dir))
    all_ = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key")).distinct()
    made = all_.where("key % 3 <> 0").selectExpr("key", "if(key % 5 = 0, 1, 3) AS mtime")
    stale = incremental.stale(made, all_.selectExpr("key", "2 AS mtime"))
    return outputs.parse_triples(answers.join(stale.select(F.col("key").alias("source")), "source", "left_semi")).groupBy("source").agg(F.count("*").alias("n"))


@query(with_views(f""", {_ANSWERS.format('relation_outputs')}, c AS (SELECT DISTINCT conv_id, 'T' || turn AS slug FROM conversations),
r AS (SELECT conv_id AS batch, turn, pos, {_S('source')} AS source, {_S('target')} AS target, lower({_S('type')}) AS type FROM a)
SELECT batch, pos, source, target, CASE WHEN type IN ('parent', 'child', 'related', 'conflict') THEN type ELSE 'related' END AS type FROM r WHERE source <> target AND EXISTS (SELECT 1 FROM c WHERE conv_id = batch AND slug = source) AND EXISTS (SELECT 1 FROM c WHERE conv_id = batch AND slug = target)""", "relation_outputs"))
def relations_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("batch"), F.concat(F.lit("T"), "turn").alias("slug")).distinct()
    rows = views.relation_outputs(spark, sf_dir).select(F.col("conv_id").alias("batch"), "output")
    return outputs.parse_relations(rows, concepts).withColumn("pos", F.col("pos").cast("long"))


@query(with_views(f""", {_ANSWERS.format('group_outputs')}, m AS (SELECT conv_id AS source, turn, pos, {_S('canonical')} AS canonical, list_filter(list_transform(from_json(json_extract(t, '$.members'), '["VARCHAR"]'), lambda x: trim(x)), lambda x: x <> '') AS l FROM a)
SELECT source, pos, canonical, array_to_string(l, ',') AS members FROM m WHERE canonical <> '' AND len(l) >= 2""", "group_outputs"))
def groups_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.group_outputs(spark, sf_dir).select(F.col("conv_id").alias("source"), "output")
    return outputs.parse_groups(rows).select("source", F.col("pos").cast("long").alias("pos"), "canonical", F.array_join("members", ",").alias("members"))


_MERGE = "CASE doc_id % 4 WHEN 0 THEN 'ACTION: Complement' || chr(10) || '---CONTENT---' || chr(10) || text WHEN 1 THEN 'ACTION: conflict' || chr(10) || 'CONFLICT_SUMMARY: ' || lang || ' differs' || chr(10) || '---CONTENT---' WHEN 2 THEN 'ACTION: nothing' || chr(10) || text ELSE text END"


@query(f"""WITH o AS (SELECT doc_id, trim({_MERGE}, {TRIM}) AS o FROM documents), p AS (SELECT *, instr(o, '---CONTENT---') AS spot FROM o),
q AS (SELECT *, CASE WHEN spot > 0 THEN substring(o, 1, spot - 1) ELSE o END AS head, CASE WHEN spot > 0 THEN trim(substring(o, spot + 13), {TRIM}) ELSE '' END AS content FROM p),
r AS (SELECT *, coalesce(list_filter(list_transform(regexp_extract_all(head, '(?m)^ACTION:(.*)$', 1), lambda x: lower(trim(x))), lambda x: x IN ('complement', 'duplicate', 'conflict'))[-1], 'complement') AS action FROM q)
SELECT doc_id, action, md5(CASE WHEN content = '' AND action = 'complement' THEN o ELSE content END) AS content, coalesce(trim(regexp_extract_all(head, '(?m)^CONFLICT_SUMMARY:(.*)$', 1)[-1]), '') AS conflict_summary FROM r""")
def merge_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _MERGE.replace("chr(10)", r"'\n'")
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{text} AS output").select("doc_id", outputs.merge_answer(F.col("output")).alias("m"))
    return rows.select("doc_id", "m.action", "m.content", "m.conflict_summary").withColumn("content", _md5("content"))


@query("SELECT '2026-01-02_' || substring(role || '_' || conv_id, 1, 30) || '_vs_' || substring(text, 1, 30) AS name, md5(answer) AS text FROM (SELECT *, trim(CASE WHEN turn % 2 = 0 THEN ' none found' ELSE text END) AS answer FROM conversations) WHERE NOT starts_with(upper(answer), 'NONE')")
def conflict_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").selectExpr("concat(role, '_', conv_id) AS page", "text AS source", "if(turn % 2 = 0, ' none found', text) AS answer")
    return outputs.conflicts(rows, "2026-01-02").withColumn("text", _md5("text"))


# Pages written anew

_HEAD = f"{NL} || '## {pages.RELATED}'"
_SPLIT = f"w AS (SELECT *, instr(content, {_HEAD} || {NL}) AS s FROM wiki_pages), w1 AS (SELECT *, CASE WHEN s > 0 THEN instr(substring(content, s + 9), {NL} || '## ') ELSE 0 END AS q FROM w), w2 AS (SELECT *, CASE WHEN q > 0 THEN left(content, s + 7 + q) ELSE content END AS upto, CASE WHEN q > 0 THEN substring(content, s + 8 + q) ELSE '' END AS rest FROM w1)"
_WIKI_LINKS = _LINKS.replace("md_docs", "wiki_pages")


@query(with_views(f""", {_WIKI_LINKS}, {_SPLIT}, e AS (SELECT DISTINCT l.slug AS source, target FROM li l JOIN wiki_pages t ON t.slug = target WHERE l.slug <> target AND NOT contains(t.content, '[[' || l.slug || ']]')),
n AS (SELECT target, count(*) AS n, string_agg('- [[' || source || ']] — 역참조', {NL} ORDER BY source) AS entries FROM e GROUP BY target)
SELECT slug, n AS n_inserted, md5(CASE WHEN s > 0 THEN rtrim(upto, {TRIM}) || {NL} || entries || {NL} || rest ELSE rtrim(content, {TRIM}) || {NL} || {_HEAD} || {NL} || entries || {NL} END) AS content FROM w2 JOIN n ON target = slug""", "md_docs", "wiki_pages"))
def backlinks_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.with_backlinks(views.wiki_pages(spark, sf_dir)).withColumn("content", _md5("content"))


_GONE = "g AS (SELECT slug FROM wiki_pages WHERE regexp_extract(content, '(?m)^source_files:[ ]*(.*)$', 1) IN ('raw/src1.md', 'raw/src7.md'))"


@query(with_views(rf""", {_GONE}, k AS (SELECT slug, string_split(content, {NL}) AS l FROM wiki_pages WHERE slug NOT IN (SELECT slug FROM g)),
x AS (SELECT slug, i, l[i] AS line, regexp_extract(l[i], '^\s*[-•]?\s*(?:→\s*)?\[\[([^\]|]+)\]\]', 1) IN (SELECT slug FROM g) AS hit FROM k, unnest(range(1, len(l) + 1)) u(i)),
y AS (SELECT slug, count(*) FILTER (hit) AS n, string_agg(CASE WHEN hit THEN '' ELSE line END, {NL} ORDER BY i) AS content FROM x GROUP BY slug)
SELECT slug, n AS n_removed, md5(CASE WHEN n > 0 THEN regexp_replace(content, '\n{{3,}}', {NL} || {NL}, 'g') ELSE content END) AS content FROM y""", "md_docs", "wiki_pages"))
def pages_without_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.functions.text import field

    own = views.wiki_pages(spark, sf_dir)
    gone = own.where(field(F.col("content"), "source_files").isin("raw/src1.md", "raw/src7.md")).select("slug")
    return pages.without_pages(own, gone).withColumn("content", _md5("content"))


_FIELD = lambda k: f"regexp_extract(content, '(?m)^{k}:[ ]*(.*)$', 1)"
_NEW = "'raw/src' || doc_id % 8 || '.md'"
_FRONT = f"'---' || {NL} || 'lang: ' || {_FIELD('lang')} || {NL} || {{0}} || 'title: ' || {_FIELD('title')} || {NL} || '---' || {NL} || {NL} || "
_FILES_LIST = f"'last_updated: 2026-01-02' || {NL} || 'source_files:' || {NL} || '- ' || {_FIELD('source_files')} || {NL} || CASE WHEN {_FIELD('source_files')} = {_NEW} THEN '' ELSE '- ' || {_NEW} || {NL} END"


@query(with_views(f" SELECT slug, md5({_FRONT.format(_FILES_LIST)} {_BODY}) AS content FROM md_docs", "md_docs"))
def source_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = F.concat(F.lit("raw/src"), F.col("doc_id") % 8, F.lit(".md"))
    return views.md_docs(spark, sf_dir).select("slug", pages.with_source(F.col("content"), new, "2026-01-02").alias("content")).withColumn("content", _md5("content"))


_ONE_FILE = f"'source_files: ' || {_FIELD('source_files')} || {NL}"


@query(with_views(f" SELECT slug, md5({_FRONT.format(_ONE_FILE)} '> ⚠️ **충돌 감지됨** — `raw/new.md` 과 내용이 상충합니다.' || {NL} || '> 충돌 보고: `' || slug || '.md`' || {NL} || {NL} || {_BODY}) AS content FROM md_docs", "md_docs"))
def conflict_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.md_docs(spark, sf_dir).select("slug", pages.with_notice(F.col("content"), F.lit("raw/new.md"), F.concat("slug", F.lit(".md"))).alias("content")).withColumn("content", _md5("content"))


_REL = "rel AS (SELECT doc_id AS seq, slug AS source, 'Doc_' || ((5 * doc_id + 2) % n) AS target, CASE doc_id % 4 WHEN 0 THEN 'parent' WHEN 1 THEN 'child' WHEN 2 THEN 'related' ELSE 'conflict' END AS type FROM md_docs, (SELECT count(*) AS n FROM md_docs) UNION ALL SELECT doc_id + 1000000000, slug, 'Doc_' || ((7 * doc_id + 3) % n), 'child' FROM md_docs, (SELECT count(*) AS n FROM md_docs) WHERE doc_id % 3 = 0)"
_KIND = "CASE type WHEN 'parent' THEN '상위 개념' WHEN 'child' THEN '하위 개념' WHEN 'related' THEN '관련 개념' ELSE '상충 개념' END"


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id")
    n = d.agg(F.count("*").alias("n"))
    rows = d.crossJoin(F.broadcast(n))  # n is one row
    one = rows.selectExpr("doc_id AS seq", "concat('Doc_', doc_id) AS source", "concat('Doc_', (5 * doc_id + 2) % n) AS target", "CASE doc_id % 4 WHEN 0 THEN 'parent' WHEN 1 THEN 'child' WHEN 2 THEN 'related' ELSE 'conflict' END AS type")
    return one.union(rows.where("doc_id % 3 = 0").selectExpr("doc_id + 1000000000", "concat('Doc_', doc_id)", "concat('Doc_', (7 * doc_id + 3) % n)", "'child'"))


@query(with_views(f""", {_REL}, d AS (SELECT DISTINCT source, type, target, replace(target, '_', ' ') AS name FROM rel WHERE target IN (SELECT slug FROM md_docs)),
r AS (SELECT source, string_agg('- [[' || target || '|' || name || ']] — ' || {_KIND}, {NL} ORDER BY type, target) AS lines, string_agg('- name: ' || name || {NL} || '  slug: ' || target || {NL} || '  type: ' || type, {NL} ORDER BY type, target) AS vals FROM d GROUP BY source),
b AS (SELECT slug, content, {_BODY} AS body FROM wiki_pages), b1 AS (SELECT *, instr(body, {_HEAD} || {NL}) AS s FROM b), b2 AS (SELECT *, CASE WHEN s > 0 THEN instr(substring(body, s + 9), {NL} || '##') ELSE 0 END AS q FROM b1),
n AS (SELECT slug, content, CASE WHEN s > 0 THEN left(body, s) ELSE rtrim(body, {TRIM}) || {NL} || {NL} END || '## {pages.RELATED}' || {NL} || {NL} || lines || CASE WHEN s > 0 THEN {NL} || {NL} || CASE WHEN q > 0 THEN substring(body, s + 8 + q) ELSE '' END ELSE {NL} END AS body, vals FROM b2 JOIN r ON source = slug)
SELECT slug, md5('---' || {NL} || 'lang: ' || {_FIELD('lang')} || {NL} || 'last_updated: 2026-01-02' || {NL} || 'related_concepts:' || {NL} || vals || {NL} || 'source_files: ' || {_FIELD('source_files')} || {NL} || 'title: ' || {_FIELD('title')} || {NL} || '---' || {NL} || {NL} || body) AS content FROM n""", "md_docs", "wiki_pages"))
def related_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = views.wiki_pages(spark, sf_dir).withColumn("name", F.replace("slug", F.lit("_"), F.lit(" ")))
    return pages.with_related(own, _relations(spark, sf_dir), "2026-01-02").withColumn("content", _md5("content"))


_TYPED = f"""{_LINKS}, {_REL}, ty AS (SELECT source, target, arg_max(type, seq) AS type, min(seq) AS seen FROM rel WHERE source <> target AND target IN (SELECT slug FROM md_docs) GROUP BY source, target),
ln AS (SELECT slug AS source, target, min(pos) AS pos FROM li WHERE slug <> target AND target IN (SELECT slug FROM md_docs) GROUP BY slug, target),
bo AS (SELECT coalesce(ln.source, ty.source) AS source, coalesce(ln.target, ty.target) AS target, type, pos, seen FROM ln FULL JOIN ty ON ln.source = ty.source AND ln.target = ty.target),
te AS (SELECT source, target, type FROM bo QUALIFY row_number() OVER (PARTITION BY least(source, target), greatest(source, target) ORDER BY type IS NULL, pos IS NULL, CASE WHEN pos IS NOT NULL THEN source END NULLS FIRST, coalesce(pos, seen), source, target) = 1)"""


@query(with_views(f", {_TYPED} SELECT * FROM te", "md_docs"))
def typed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.typed_edges(views.md_docs(spark, sf_dir), _relations(spark, sf_dir))


@query(with_views(f""", {_TYPED} SELECT 'node' AS kind, slug AS id, '{{"id":"' || slug || '","name":"Doc ' || doc_id || '","group":"concept"}}' AS json FROM md_docs
UNION ALL SELECT 'edge', source || '>' || target, '{{"source":"' || source || '","target":"' || target || '"' || coalesce(',"type":"' || type || '"', '') || '}}' FROM te""", "md_docs"))
def graph_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = views.md_docs(spark, sf_dir)
    return pages.graph_lines(own.select("slug", F.concat(F.lit("Doc "), "doc_id").alias("name")), pages.typed_edges(own, _relations(spark, sf_dir)))


@query(with_views(f", {_EDGES}, x2 AS ({_EXPAND}), n AS (SELECT name, " + ", ".join(f"replace(string_agg(other, ',' ORDER BY other) FILTER (kind = '{k}'), ',', ', ') AS {k}" for k in ("parents", "children", "enables", "requires", "contradicts")) + f" FROM x2 GROUP BY name) SELECT name, concat_ws({NL}, '# ' || name, '- 상위 개념: ' || parents, '- 하위 개념: ' || children, '- 가능하게 함: ' || enables, '- 필요로 함: ' || requires, '- 상충: ' || contradicts) AS text FROM n", "triples"))
def concept_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return office.concept_text(graph.expansion(graph.edges(views.triples(spark, sf_dir))))


# Rows of office files, repositories and transcripts

_CELLS = "SELECT p_brand AS sheet, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS r, p_partkey, p_name, p_size FROM part"


@query(f"""WITH p AS ({_CELLS}), c AS (SELECT *, p_partkey::VARCHAR AS c0, replace(p_name, 'e', '\\|') || CASE WHEN p_size % 3 = 0 THEN ' `[formula: =A' || r || ']`' ELSE '' END AS c1, CASE WHEN r > 0 AND p_size % 2 = 0 THEN p_size || '.5' ELSE '' END AS c2 FROM p),
t AS (SELECT sheet, max(r) AS total FROM c GROUP BY sheet), h AS (SELECT sheet, '| ' || c0 || ' | ' || c1 || ' | 열3 |' || {NL} || '| --- | --- | --- |' AS head FROM c WHERE r = 0),
b AS (SELECT sheet, (r - 1) // 100 AS block, min(r) AS f, max(r) AS l, string_agg('| ' || c0 || ' | ' || c1 || ' | ' || c2 || ' |', {NL} ORDER BY r) AS lines FROM c WHERE r > 0 GROUP BY 1, 2)
SELECT sheet, (block + 1)::BIGINT AS block, md5(CASE WHEN total > 100 THEN '**행 ' || f || '–' || l || ' / 전체 ' || total || '행 (청크 ' || (block + 1) || '/' || ceil(total / 100.0)::BIGINT || ')**' || {NL} || {NL} ELSE '' END || head || {NL} || lines) AS markdown FROM b JOIN t USING (sheet) JOIN h USING (sheet)""".replace("\\\\", "\\"))
def sheet_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_CELLS.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))
    cells = rows.selectExpr("sheet", "CAST(r AS INT) AS row", "inline(array(struct(0 AS col, concat(p_partkey, '.0') AS value, CAST(NULL AS STRING) AS formula), struct(1 AS col, replace(p_name, 'e', '|') AS value, if(p_size % 3 = 0, concat('=A', r), NULL) AS formula), struct(2 AS col, if(r > 0 AND p_size % 2 = 0, concat(p_size, '.5'), NULL) AS value, CAST(NULL AS STRING) AS formula)))")
    return office.sheet_pages(cells, 100).withColumn("markdown", _md5("markdown"))


@query(f"SELECT s_nationkey AS sheet, s_suppkey AS chart, '**[차트 ' || s_suppkey || ']** 유형: ' || CASE WHEN s_suppkey % 2 = 0 THEN 'Bar' ELSE 'Line' END || CASE WHEN s_suppkey % 3 > 0 THEN ' / 제목: ' || s_name ELSE '' END || {NL} || '  - 시리즈 1: ' || s_name || {NL} || '  - 시리즈 2' AS markdown FROM supplier")
def chart_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return office.chart_texts(table(spark, sf_dir, "supplier").selectExpr("s_nationkey AS sheet", "s_suppkey AS chart", "if(s_suppkey % 2 = 0, 'Bar', 'Line') AS kind", "if(s_suppkey % 3 > 0, s_name, NULL) AS title", "array(s_name, NULL) AS series"))


_SHAPES = "SELECT l_orderkey AS deck, l_suppkey % 2 + 1 AS slide, l_suppkey % 3 AS shape, l_linenumber AS pos, CASE WHEN l_partkey % 13 = 0 THEN ' ' ELSE ' item ' || l_partkey || ' ' END AS text, l_partkey % 3 AS level, l_quantity AS size FROM lineitem"


@query(f"""WITH p AS ({_SHAPES}), x AS (SELECT deck, slide, shape, pos, trim(text) AS t, CASE WHEN size >= 28 THEN '### ' || trim(text) WHEN size >= 20 THEN '#### ' || trim(text) WHEN level = 0 THEN trim(text) ELSE repeat('  ', level::INT) || '- ' || trim(text) END AS line FROM p),
h AS (SELECT deck, slide, (min(struct_pack(p := pos, t := t))).t AS title FROM x WHERE shape = 0 GROUP BY deck, slide),
s AS (SELECT deck, slide, shape, string_agg(line, {NL} ORDER BY pos, line) AS body FROM x WHERE shape > 0 AND t <> '' GROUP BY deck, slide, shape), b AS (SELECT deck, slide, string_agg(body, {NL} || {NL} ORDER BY shape) AS body FROM s GROUP BY deck, slide),
n AS (SELECT o_orderkey AS deck, 1 AS slide, {NL} || '> **Note:**' || {NL} || '> ' || o_orderpriority || {NL} || '> ' || o_orderstatus AS note FROM orders)
SELECT d.deck, d.slide, md5(concat_ws({NL} || {NL}, '## Slide ' || d.slide || CASE WHEN coalesce(title, '') <> '' THEN ': ' || title ELSE '' END, body, note)) AS markdown FROM (SELECT DISTINCT deck, slide FROM p) d LEFT JOIN h ON h.deck = d.deck AND h.slide = d.slide LEFT JOIN b ON b.deck = d.deck AND b.slide = d.slide LEFT JOIN n ON n.deck = d.deck AND n.slide = d.slide""")
def slide_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_SHAPES.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))
    notes = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS deck", "1 AS slide", r"concat(' ', o_orderpriority, '\n', o_orderstatus) AS note")
    return office.slide_pages(rows, notes).withColumn("markdown", _md5("markdown"))


_BLOCKS = "SELECT l_orderkey AS doc, l_linenumber * 10000000 + l_partkey AS pos, CASE l_suppkey % 5 WHEN 0 THEN 'Heading 2' WHEN 1 THEN 'List Bullet' WHEN 2 THEN 'List Number' ELSE 'Normal' END AS style, CASE WHEN l_partkey % 17 = 0 THEN ' ' ELSE 'text ' || l_partkey END AS text, l_returnflag = 'N' AS r FROM lineitem"


@query(f"""WITH b AS ({_BLOCKS}), l AS (SELECT doc, pos, r, CASE WHEN r THEN '| ' || coalesce(nullif(trim(text), ''), '') || ' | a\\|b |' WHEN trim(text) = '' THEN NULL ELSE CASE style WHEN 'Heading 2' THEN '## ' WHEN 'List Bullet' THEN '- ' WHEN 'List Number' THEN '1. ' ELSE '' END || trim(text) END AS x FROM b),
k AS (SELECT *, row_number() OVER w AS n, lag(r) OVER w AS was FROM l WHERE x IS NOT NULL WINDOW w AS (PARTITION BY doc ORDER BY pos, x))
SELECT doc, md5(string_agg(CASE WHEN n = 1 THEN '' WHEN r AND was THEN {NL} ELSE {NL} || {NL} END || x || CASE WHEN r AND NOT coalesce(was, false) THEN {NL} || '| --- | --- |' ELSE '' END, '' ORDER BY n)) AS markdown FROM k GROUP BY doc""".replace("\\\\", "\\"))
def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_BLOCKS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem")).selectExpr("doc", "pos", "style", "text", "if(r, array(text, 'a|b'), NULL) AS cells")
    return office.document_pages(rows).where("markdown <> ''").withColumn("markdown", _md5("markdown"))


_PDF = "SELECT l_orderkey AS doc, l_suppkey % 2 AS page, l_partkey % 2 AS block, l_linenumber AS pos, 'line ' || l_partkey AS text, round(l_quantity / 3, 1) AS size, l_returnflag = 'A' AS bold FROM lineitem"


@query(f"""WITH p AS ({_PDF}), s AS (SELECT doc, size, sum(length(text))::BIGINT AS n FROM p GROUP BY 1, 2), b AS (SELECT doc, arg_min(size, struct_pack(n := -n, s := size)) AS body FROM s GROUP BY doc), v AS (SELECT doc, round(body * 1.5::DOUBLE, 3) AS h1, round(body * 1.2::DOUBLE, 3) AS h2, round(body * 1.1::DOUBLE, 3) AS h3 FROM b),
x AS (SELECT doc, page, block, pos, CASE WHEN size >= h1 THEN '# ' || text WHEN size >= h2 THEN '## ' || text WHEN size >= h3 THEN '### ' || text WHEN bold THEN '**' || text || '**' ELSE text END AS line FROM p JOIN v USING (doc)),
k AS (SELECT doc, page, block, string_agg(line, {NL} ORDER BY pos, line) AS t FROM x GROUP BY 1, 2, 3) SELECT doc, page, md5(string_agg(t, {NL} || {NL} ORDER BY block)) AS markdown FROM k GROUP BY doc, page""")
def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_PDF.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))
    levels = ingest.font_levels(rows.select("doc", "size", F.length("text").alias("n")))
    return office.pdf_pages(rows, levels).withColumn("markdown", _md5("markdown"))


_PATH = "p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.Rs' ELSE '.bin' END"
_LANG = "CASE p_partkey % 4 WHEN 0 THEN 'python' WHEN 2 THEN 'rust' ELSE '' END"


@query(f"""WITH f AS (SELECT p_brand AS repo, p_partkey, {_PATH} AS path, CASE WHEN p_partkey % 4 = 1 THEN p_type ELSE '```' || {_LANG} || {NL} || p_type || {NL} || '```' END AS shown FROM part WHERE p_size <= 25),
l AS (SELECT repo, string_agg('- `' || path || '`', {NL} ORDER BY p_partkey) AS names, string_agg('## `' || path || '`' || {NL} || {NL} || shown || {NL}, {NL} ORDER BY p_partkey) AS parts FROM f GROUP BY repo),
s AS (SELECT p_brand AS repo, count(*) AS n, list_sort(list('`' || {_PATH} || '`'))[1:5] AS few FROM part WHERE p_size > 25 GROUP BY 1), r AS (SELECT p_brand AS repo, count(*) AS stars, min(p_size) % 2 AS odd FROM part GROUP BY 1)
SELECT repo, md5('# ' || repo || {NL} || {NL} || CASE WHEN odd = 1 THEN '> a repository' || {NL} || {NL} ELSE '' END || '**언어:** Python · **Stars:** ' || format('{{:,}}', stars * 1000) || {NL} || {NL} || '**레포:** https://github.com/' || repo || {NL} || '**브랜치:** `main`' || {NL} || {NL} || '---' || {NL} || {NL} || '## 수집 파일 목록' || {NL} || {NL} || names
  || coalesce({NL} || {NL} || '> 토큰 예산 초과로 ' || n || '개 파일 생략: ' || array_to_string(few, ', ') || CASE WHEN n > 5 THEN '...' ELSE '' END, '') || {NL} || {NL} || '---' || {NL} || {NL} || parts) AS markdown FROM r JOIN l USING (repo) LEFT JOIN s USING (repo)""")
def repository_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    repos = p.groupBy(F.col("p_brand").alias("repo")).agg((F.count("*") * 1000).alias("stars"), (F.min("p_size") % 2).alias("odd")).selectExpr("repo", "if(odd = 1, 'a repository', NULL) AS description", "'Python' AS language", "stars", "CAST(NULL AS STRING) AS license", "'main' AS branch")
    files = p.where("p_size <= 25").selectExpr("p_brand AS repo", "p_partkey AS pos", f"{_PATH} AS path", r"concat(p_type, ' \n') AS content")
    return office.repository_pages(repos, files, p.where("p_size > 25").selectExpr("p_brand AS repo", f"{_PATH} AS path")).withColumn("markdown", _md5("markdown"))


@query(with_views(f""", s AS (SELECT video_id, event_id, start, text, min(start) OVER (PARTITION BY video_id, start // 86400) AS first, start // 86400 AS section FROM segments), g AS (SELECT video_id, section, first, string_agg(text, ' ' ORDER BY event_id) AS t FROM s GROUP BY ALL), c AS (SELECT *, first % 90000 AS f FROM g)
SELECT video_id, section, '## ' || CASE WHEN f >= 3600 THEN format('[{{:02d}}:{{:02d}}:{{:02d}}]', (f // 3600)::INT, (f % 3600 // 60)::INT, (f % 60)::INT) ELSE format('[{{:02d}}:{{:02d}}]', (f // 60)::INT, (f % 60)::INT) END || '(https://www.youtube.com/watch?v=' || video_id || '&t=' || f || 's)' || {NL} || {NL} || t AS markdown FROM c""", "segments"))
def transcript_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    s = views.segments(spark, sf_dir).withColumn("section", F.expr("start div 86400"))
    first = F.min("start").over(Window.partitionBy("video_id", "section")) % 90000
    return office.transcript_pages(s.select("video_id", "section", first.alias("first"), F.col("event_id").alias("pos"), F.concat(F.lit(" "), "text", F.lit("\n")).alias("text")))


@query("WITH f AS (SELECT DISTINCT replace(p_name, ' ', '-') || '_' || p_partkey AS stem FROM part WHERE p_size % 3 = 0), k AS (SELECT stem FROM f UNION SELECT split_part(stem, '_', 1) FROM f) SELECT p_partkey AS id, replace(p_name, ' ', '-') IN (SELECT stem FROM k) AS duplicate FROM part")
def upload_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    files = p.where("p_size % 3 = 0").selectExpr("concat(replace(p_name, ' ', '-'), '_', p_partkey) AS stem")
    found = office.uploads(p.select(F.concat(F.lit(" "), F.upper("p_name")).alias("name")).distinct(), files)
    return p.select(F.col("p_partkey").alias("id"), F.concat(F.lit(" "), F.upper("p_name")).alias("name")).join(found, "name").select("id", "duplicate")

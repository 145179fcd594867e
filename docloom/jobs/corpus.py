"""Queries over documents: budgets, Markdown, chunks, links, search and contexts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as fx
from docloom.jobs.registry import query
from docloom.operators import chunking, context, links, search
from docloom.session import table
from docloom.settings import SMALL, TINY
from docloom.sources import views
from docloom.sources.views import with_views

TRIM = "' ' || chr(10) || chr(9) || chr(13)"
_TOKENS = "greatest(1, ceil(strlen(coalesce({0}, '')) / 4.0))::BIGINT"
_STRATEGY = "CASE WHEN tokens <= 1200 THEN 'single_pass' WHEN tokens <= 4500 THEN 'map_reduce' ELSE 'hierarchical' END"
_T = f"t AS (SELECT doc_id, {_TOKENS.format('text')} AS tokens FROM documents)"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", fx.estimate_tokens(F.col("text")).alias("tokens"))


@query(f"WITH {_T} SELECT * FROM t")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir)


@query(f"WITH {_T} SELECT doc_id, {_STRATEGY} AS strategy FROM t")
def strategy_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).select("doc_id", fx.strategy(F.col("tokens"), TINY).alias("strategy"))


@query(f"WITH {_T} SELECT doc_id, CASE WHEN tokens <= 1200 THEN 1 ELSE ceil(tokens / 1480.0) END::BIGINT AS chunks FROM t")
def chunks_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).select("doc_id", fx.chunks_needed(F.col("tokens"), TINY).alias("chunks"))


@query(f"WITH {_T} SELECT doc_id, tokens, 1500::BIGINT AS available, round_even(tokens / 1500.0, 4)::DOUBLE AS ratio, {_STRATEGY} AS strategy, CASE WHEN tokens <= 1200 THEN 1 ELSE ceil(tokens / 1480.0) END::BIGINT AS chunks FROM t")
def budget_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("tokens")
    return _tokens(spark, sf_dir).select("doc_id", "tokens", F.lit(TINY.available).cast("long").alias("available"), F.bround(t / TINY.available, 4).alias("ratio"), fx.strategy(t, TINY).alias("strategy"), fx.chunks_needed(t, TINY).alias("chunks"))


# Markdown

_BODY = rf"trim(regexp_replace(content, '(?s)^---.*?\n---\s*', ''), {TRIM})"


@query(with_views(r"SELECT slug, regexp_extract(content, '(?m)^title:[ ]*(.*)$', 1) AS title, regexp_extract(content, '(?m)^lang:[ ]*(.*)$', 1) AS lang, regexp_extract(content, '(?m)^# (.+)$', 1) AS h1 FROM md_docs", "md_docs"))
def frontmatter_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("content")
    return views.md_docs(spark, sf_dir).select("slug", fx.title(c, F.col("slug")).alias("title"), fx.field(c, "lang").alias("lang"), fx.first_h1(c).alias("h1"))


@query(with_views(rf"""SELECT slug, substring(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_BODY}, '(?s)```.*?```', ' ', 'g'), '`[^`]*`', ' ', 'g'), '(?m)^#{{1,6}}[ ]+', '', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '[*_~|>]', ' ', 'g'), '[\s\p{{Z}}]+', ' ', 'g')), 1, 300) AS excerpt FROM md_docs""", "md_docs"))
def excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.md_docs(spark, sf_dir).select("slug", fx.excerpt(F.col("content")).alias("excerpt"))


@query(with_views(rf"""SELECT slug, substring(list_filter(regexp_split_to_array({_BODY}, '\n{{2,}}'), lambda x: length(trim(x)) > 0 AND NOT starts_with(trim(x), '#'))[1], 1, 300) AS summary FROM md_docs""", "md_docs"))
def concept_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.md_docs(spark, sf_dir).select("slug", fx.summary(F.col("content")).alias("summary"))


@query(with_views(rf"""SELECT slug, CASE WHEN starts_with(b[1], '#') THEN array_to_string(b[1:2], chr(10) || chr(10)) ELSE b[1] END AS paragraph FROM (SELECT slug, regexp_split_to_array({_BODY}, '\n{{2,}}') AS b FROM md_docs)""", "md_docs"))
def first_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.md_docs(spark, sf_dir).select("slug", fx.first_paragraph(F.col("content")).alias("paragraph"))


@query("SELECT p_partkey AS id, list_filter(['Size ' || p_size, p_type, '2nd'], lambda x: x <> '')[1] AS first, 3::BIGINT AS n FROM part")
def list_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.concat(F.lit("# T\n\n## Notes\n\n- [[Size "), "p_size", F.lit("|s]]\n* "), "p_type", F.lit("\n1) 2nd\n- (none yet)\n\n## Other\n\n- no\n"))
    items = fx.list_items(page, "Notes")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), items[0].alias("first"), F.size(items).cast("long").alias("n"))


@query(with_views(r"SELECT id, CASE WHEN conv_id % 3 = 0 THEN trim(regexp_extract(output, '(?s)```json\n(.*?)\n```', 1)) ELSE trim(output) END AS plain FROM llm_outputs", "llm_outputs"))
def fence_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.llm_outputs(spark, sf_dir).select("id", fx.strip_fence(F.col("output")).alias("plain"))


@query("""SELECT p_partkey AS id, regexp_replace(substring(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(s, '[^\\p{L}\\p{N}_ \\-]', '', 'g'), '[ _]+', '-', 'g')), '-+', '-', 'g'), '^-|-$', '', 'g'), 1, 20), '-$', '') AS slug, regexp_replace(regexp_replace(s, '[^\\p{L}\\p{N}_]+', '_', 'g'), '^_+|_+$', '', 'g') AS stem FROM (SELECT p_partkey, ' ' || p_name || ' (' || p_type || ')!' AS s FROM part)""".replace("\\\\", "\\"))
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.concat(F.lit(" "), "p_name", F.lit(" ("), "p_type", F.lit(")!"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), fx.slug(s, 20).alias("slug"), fx.file_stem(s).alias("stem"))


@query("SELECT p_partkey AS id, 'Part ' || p_name || ' of type ' || p_type || ' {{ unknown }}' AS prompt FROM part")
def template_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fx.render("Part {{ name }} of type {{type}} {{ unknown }}", {"name": F.col("p_name"), "type": F.col("p_type")})
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), out.alias("prompt"))


# Chunks

_SECTIONS = rf"""s0 AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(content, '(?m)^(#{{1,3}} .+)', chr(1) || '\1', 'g'), chr(1)), lambda x: trim(x, {TRIM})), lambda x: length(x) > 0) AS l FROM md_docs),
sec AS (SELECT doc_id, i - 1 AS pos, trim(regexp_extract(l[i], '^#{{1,3}} ([^\n]+)', 1)) AS title, l[i] AS body FROM s0, unnest(range(1, len(l) + 1)) u(i))"""


@query(with_views(f", {_SECTIONS} SELECT doc_id, pos::BIGINT AS pos, title, md5(body) AS body FROM sec", "md_docs"))
def sectionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.sections(views.md_docs(spark, sf_dir)).select("doc_id", F.col("pos").cast("long").alias("pos"), "title", F.md5(F.col("body").cast("binary")).alias("body"))


MOST = 300
_PARTS = rf"""{_SECTIONS},
p0 AS (SELECT doc_id, pos, list_filter(list_transform(regexp_split_to_array(body, '\n{{2,}}'), lambda x: trim(x, {TRIM})), lambda x: length(x) > 0) AS l FROM sec),
p1 AS (SELECT doc_id, pos, k, l[k] AS x, {_TOKENS.format('l[k]')} > {MOST} AS long FROM p0, unnest(range(1, len(l) + 1)) u(k)),
p2 AS (SELECT *, CASE WHEN long THEN string_split(regexp_replace(x, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) ELSE [x] END AS a, CASE WHEN long THEN 'p' || k ELSE 'r' || sum(long::INT) OVER (PARTITION BY doc_id, pos ORDER BY k) END AS run FROM p1),
p3 AS (SELECT doc_id, pos, k, j, long, run, a[j] AS x, {_TOKENS.format('a[j]')} AS t, row_number() OVER (PARTITION BY doc_id, pos ORDER BY k, j) AS n FROM p2, unnest(range(1, len(a) + 1)) u(j)),
p4 AS (SELECT doc_id, pos, n, run, t, 1 AS part FROM p3 WHERE n = 1
  UNION ALL SELECT b.doc_id, b.pos, b.n, b.run, CASE WHEN b.run <> a.run OR a.t + b.t > {MOST} THEN b.t ELSE a.t + b.t END, CASE WHEN b.run <> a.run OR a.t + b.t > {MOST} THEN a.part + 1 ELSE a.part END FROM p4 a JOIN p3 b ON b.doc_id = a.doc_id AND b.pos = a.pos AND b.n = a.n + 1),
parts AS (SELECT p3.doc_id, p3.pos, part, CASE WHEN long THEN string_agg(x, ' ' ORDER BY p3.n) ELSE string_agg(x, chr(10) || chr(10) ORDER BY p3.n) END AS x FROM p3 JOIN p4 ON p3.doc_id = p4.doc_id AND p3.pos = p4.pos AND p3.n = p4.n GROUP BY p3.doc_id, p3.pos, part, long)"""


@query(with_views(f", {_PARTS} SELECT doc_id, pos::BIGINT AS pos, (part - 1)::BIGINT AS part, md5(x) AS body FROM parts", "md_docs", recursive=True))
def paragraph_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.sections(views.md_docs(spark, sf_dir)).select("doc_id", F.col("pos").cast("long").alias("pos"), F.posexplode(chunking.split_paragraphs(F.col("body"), MOST)).alias("part", "x"))
    return rows.select("doc_id", "pos", F.col("part").cast("long").alias("part"), F.md5(F.col("x").cast("binary")).alias("body"))


_PACK = rf"""{_PARTS},
u0 AS (SELECT doc_id, pos, 1 AS part, title, body AS x, {_TOKENS.format('body')} > {MOST} AS long FROM sec),
u1 AS (SELECT doc_id, pos, part, title, x, long FROM u0 WHERE NOT long UNION ALL SELECT u0.doc_id, u0.pos, parts.part, title, parts.x, long FROM u0 JOIN parts ON parts.doc_id = u0.doc_id AND parts.pos = u0.pos WHERE long),
u2 AS (SELECT *, {_TOKENS.format('x')} AS t, row_number() OVER (PARTITION BY doc_id ORDER BY pos, part) AS n FROM u1),
u3 AS (SELECT doc_id, n, t AS used, long AS shut, 0 AS chunk FROM u2 WHERE n = 1
  UNION ALL SELECT b.doc_id, b.n, CASE WHEN a.shut OR b.long OR a.used + b.t > {MOST} THEN b.t ELSE a.used + b.t END, b.long, CASE WHEN a.shut OR b.long OR a.used + b.t > {MOST} THEN a.chunk + 1 ELSE a.chunk END FROM u3 a JOIN u2 b ON b.doc_id = a.doc_id AND b.n = a.n + 1)"""


@query(with_views(f", {_PACK} SELECT u2.doc_id, chunk::BIGINT AS chunk, sum(t)::BIGINT AS tokens, count(*) AS n, min(pos)::BIGINT AS first, max(pos)::BIGINT AS last FROM u2 JOIN u3 ON u3.doc_id = u2.doc_id AND u3.n = u2.n GROUP BY u2.doc_id, chunk", "md_docs", recursive=True))
def pack_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = chunking.pack(chunking.sections(views.md_docs(spark, sf_dir)), MOST)
    return packed.groupBy("doc_id", "chunk").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"), F.min("pos").cast("long").alias("first"), F.max("pos").cast("long").alias("last"))


@query(with_views(f", {_PACK}, g AS (SELECT u2.doc_id, chunk, count(*) OVER (PARTITION BY u2.doc_id) AS x FROM u2 JOIN u3 ON u3.doc_id = u2.doc_id AND u3.n = u2.n) SELECT DISTINCT doc_id, (chunk + 1)::BIGINT AS index, (chunk // 2)::BIGINT AS grp, format('chunk_{{:04d}}.md', (chunk + 1)::INT) AS file FROM g", "md_docs", recursive=True))
def hierarchical_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = chunking.pack(chunking.sections(views.md_docs(spark, sf_dir)), MOST).select("doc_id", "chunk").distinct()
    return packed.select("doc_id", (F.col("chunk") + 1).alias("index"), F.floor(F.col("chunk") / 2).alias("grp"), F.format_string("chunk_%04d.md", F.col("chunk") + 1).alias("file"))


@query("SELECT doc_id, right(text, coalesce(list_max(list_filter(range(0, 81), lambda k: strlen(right(text, k)) <= 80)), 0)::INT) AS tail FROM documents")
def overlap_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", fx.byte_tail(F.col("text"), 80).alias("tail"))


def _packed(tag: str, most: int, source: str) -> str:
    """The packing's tables over other pages and another room, under names of their own."""
    names = "s0|sec|p0|p1|p2|p3|p4|parts|u0|u1|u2|u3|md_docs"
    text = re.sub(rf"\b({names})\b", lambda m: source if m[1] == "md_docs" else m[1] + tag, _PACK)
    return text.replace(f"> {MOST}", f"> {most}")


_TAIL = "right({0}, coalesce(list_max(list_filter(range(0, 81), lambda k: strlen(right({0}, k)) <= 80)), 0)::INT)"


def _chunked(tag: str, strategy: str, level: int) -> str:
    return f"""g{tag} AS (SELECT u2{tag}.doc_id, chunk, string_agg(x, chr(10) || chr(10) ORDER BY u2{tag}.n) AS raw, (list(title ORDER BY u2{tag}.n) FILTER (title <> ''))[1] AS section FROM u2{tag} JOIN u3{tag} ON u3{tag}.doc_id = u2{tag}.doc_id AND u3{tag}.n = u2{tag}.n GROUP BY u2{tag}.doc_id, chunk),
    h{tag} AS (SELECT doc_id, '{strategy}' AS strategy, chunk + 1 AS index, count(*) OVER (PARTITION BY doc_id) AS total, coalesce(section, 'Doc ' || doc_id) AS section, {level} AS level, {'chunk // 2' if level == 2 else '0'} AS grp, raw, {_TAIL.format('lag(raw) OVER (PARTITION BY doc_id ORDER BY chunk)')} AS tail FROM g{tag})"""


_KINDS = f"k AS (SELECT *, {_STRATEGY.replace('tokens', _TOKENS.format('content'))} AS kind FROM md_docs), km AS (SELECT * FROM k WHERE kind = 'map_reduce'), kh AS (SELECT * FROM k WHERE kind = 'hierarchical')"
_CHUNKS = f"""{_KINDS}, {_packed('m', 1180, 'km')}, {_packed('h', 580, 'kh')}, {_chunked('m', 'map_reduce', 1)}, {_chunked('h', 'hierarchical', 2)},
every AS (SELECT doc_id, 'single_pass' AS strategy, 1 AS index, 1 AS total, '전체' AS section, 1 AS level, 0 AS grp, content AS raw, NULL AS tail FROM k WHERE kind = 'single_pass' UNION ALL SELECT * FROM hm UNION ALL SELECT * FROM hh),
full_chunks AS (SELECT *, '[Doc ' || doc_id || ' / ' || section || ' / ' || total || '개 중 ' || index || '번째]' || chr(10) || chr(10) || CASE WHEN coalesce(tail, '') <> '' THEN '<!-- overlap -->' || chr(10) || tail || chr(10) || '<!-- /overlap -->' || chr(10) || chr(10) ELSE '' END || raw AS content FROM every)"""


@query(with_views(f", {_CHUNKS} SELECT doc_id, strategy, index::BIGINT AS index, total::BIGINT AS total, section, level::INT AS level, grp::BIGINT AS \"group\", md5(content) AS content, {_TOKENS.format('content')} AS token_count FROM full_chunks", "md_docs", recursive=True))
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(views.md_docs(spark, sf_dir), TINY).withColumn("content", F.md5(F.col("content").cast("binary")))


@query(with_views(f", {_CHUNKS} SELECT doc_id, strategy, count(*) AS total_chunks, sum({_TOKENS.format('content')})::BIGINT AS tokens, string_agg(format('chunk_{{:04d}}.md', index::INT), ',' ORDER BY index) AS files FROM full_chunks GROUP BY doc_id, strategy", "md_docs", recursive=True))
def chunk_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.manifest(chunking.chunk_documents(views.md_docs(spark, sf_dir), TINY))


# Links

_LINKS = r"""li AS (SELECT slug, i - 1 AS pos, replace(trim(l[i]), ' ', '_') AS target FROM (SELECT slug, regexp_extract_all(content, '\[\[([^\]|#]+?)(?:\|[^\]]+)?\]\]', 1) AS l FROM md_docs), unnest(range(1, len(l) + 1)) u(i))"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.md_docs(spark, sf_dir)


@query(with_views(f", {_LINKS} SELECT slug, pos::BIGINT AS pos, target FROM li", "md_docs"))
def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.links(_pages(spark, sf_dir)).select("slug", F.col("pos").cast("long").alias("pos"), "target")


@query(with_views(r"SELECT slug, unnest(list_distinct(regexp_extract_all(content, '\[\[([^\[\]]+)\]\]', 1))) AS target FROM md_docs", "md_docs"))
def link_extract_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.links(_pages(spark, sf_dir), keep_alias=True).select("slug", "target")


@query(with_views(f", {_LINKS}, d AS (SELECT DISTINCT slug, target FROM li WHERE slug <> target) SELECT slug AS source, target FROM d WHERE target IN (SELECT slug FROM md_docs) AND NOT EXISTS (SELECT 1 FROM d b WHERE b.slug = d.target AND b.target = d.slug)", "md_docs"))
def backlinks_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.missing_backlinks(_pages(spark, sf_dir))


#: Every fifth page names a page that isn't there.
_LOST = "d AS (SELECT doc_id, slug, CASE WHEN doc_id % 5 = 0 THEN replace(content, 'See [[Doc ', 'See [[Lost ' || doc_id % 7 || ' ') ELSE content END AS content FROM md_docs)"


def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = F.replace("content", F.lit("See [[Doc "), F.concat(F.lit("See [[Lost "), F.col("doc_id") % 7, F.lit(" ")))
    return _pages(spark, sf_dir).withColumn("content", F.when(F.col("doc_id") % 5 == 0, lost).otherwise(F.col("content")))


@query(with_views(f", {_LOST}, {_LINKS.replace('md_docs', 'd')}, e AS (SELECT DISTINCT slug, target FROM li) SELECT target, count(*) AS n_files, string_agg(slug, ',' ORDER BY slug) AS files FROM e WHERE target NOT IN (SELECT slug FROM d) GROUP BY target", "md_docs"))
def unresolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.unresolved(_damaged(spark, sf_dir))


@query(with_views("SELECT source_file AS source, count(*) AS n, min(slug) AS first, max(slug) AS last FROM concepts GROUP BY source_file", "concepts"))
def source_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.source_index(views.concepts(spark, sf_dir))


_ASKED = "a AS (SELECT DISTINCT regexp_replace(source_file, '^raw/', '') AS source FROM concepts)"


@query(with_views(f", {_ASKED} SELECT a.source, slug FROM a JOIN concepts ON ends_with(source_file, a.source)", "concepts"))
def related_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.concepts(spark, sf_dir)
    return links.related(c, c.select(F.regexp_replace("source_file", "^raw/", "").alias("source")).distinct(), "suffix")


@query(with_views(", a AS (SELECT DISTINCT 'other/' || regexp_replace(source_file, '^raw/', '') AS source FROM concepts) SELECT a.source, slug FROM a JOIN concepts ON split_part(source_file, '/', -1) = split_part(a.source, '/', -1)", "concepts"))
def related_basename(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.concepts(spark, sf_dir)
    return links.related(c, c.select(F.concat(F.lit("other/"), F.regexp_replace("source_file", "^raw/", "")).alias("source")).distinct(), "basename")


_GONE = "g AS (SELECT slug FROM md_docs WHERE regexp_extract(content, '(?m)^source_files:[ ]*(.*)$', 1) IN ('raw/src1.md', 'raw/src7.md'))"


@query(with_views(f", {_LINKS}, {_GONE} SELECT DISTINCT slug, 'delete' AS action FROM g UNION ALL SELECT DISTINCT slug, 'unlink' FROM li WHERE target IN (SELECT slug FROM g) AND slug NOT IN (SELECT slug FROM g)", "md_docs"))
def cascade_delete_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.deletion(_pages(spark, sf_dir), spark.createDataFrame([("raw/src1.md",), ("raw/src7.md",)], "source string"))


@query(with_views(r"SELECT slug, len(regexp_extract_all(content, '\[\[Doc [0-9]+(?:\|[^\]]+)?\]\]'))::BIGINT AS n_changed, md5(regexp_replace(content, '\[\[Doc ([0-9]+)((?:\|[^\]]+)?)\]\]', '[[Page \1\2]]', 'g')) AS content FROM md_docs WHERE regexp_matches(content, '\[\[Doc [0-9]+')", "md_docs"))
def rename_backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _pages(spark, sf_dir).select(F.concat(F.lit("Doc "), "doc_id").alias("old"), F.concat(F.lit("Page "), "doc_id").alias("new"))
    return links.rename(_pages(spark, sf_dir), names).select("slug", "n_changed", F.md5(F.col("content").cast("binary")).alias("content"))


@query(with_views("SELECT CASE WHEN doc_id % 2 = 0 THEN 'Doc ' || doc_id ELSE 'doc ' || doc_id END AS name, slug, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS rule FROM md_docs", "md_docs"))
def resolve_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _docs(spark, sf_dir).select(F.concat(F.when(F.col("doc_id") % 2 == 0, "Doc ").otherwise("doc "), "doc_id").alias("name"))
    return links.resolve(_pages(spark, sf_dir), names)


_KNOWN = f"{_LINKS}, e AS (SELECT * FROM li WHERE slug <> target AND target IN (SELECT slug FROM md_docs))"


@query(with_views(f", {_KNOWN}, q AS (SELECT least(slug, target) AS a, greatest(slug, target) AS b, slug, pos FROM e), f AS (SELECT a, b, arg_min(slug, struct_pack(s := slug, p := pos)) AS source, count(*) AS n FROM q GROUP BY a, b) SELECT source, CASE WHEN source = a THEN b ELSE a END AS target, n FROM f", "md_docs"))
def graph_export_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.export_edges(_pages(spark, sf_dir))


@query(with_views(f", {_LINKS}, c AS (SELECT target, count(*) AS n FROM li WHERE slug <> target GROUP BY target), r AS (SELECT slug, coalesce(n, 0) AS link_count FROM md_docs LEFT JOIN c ON c.target = slug) SELECT slug, link_count, round(6 + 14 * link_count / greatest(1, max(link_count) OVER ())::DOUBLE, 6) AS radius FROM r", "md_docs"))
def graph_export_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.export_nodes(_pages(spark, sf_dir))


@query(with_views(f", {_LOST}, q AS (SELECT doc_id, slug, CASE WHEN doc_id % 9 = 0 THEN regexp_replace(content, '^---', '') WHEN doc_id % 9 = 1 THEN replace(content, ']].', '].') ELSE content END AS content FROM d), {_LINKS.replace('md_docs', 'q')} SELECT 'front_matter' AS rule, slug FROM q WHERE doc_id % 9 = 0 UNION ALL SELECT 'unclosed_link', slug FROM q WHERE doc_id % 9 = 1 UNION ALL SELECT DISTINCT 'unresolved_link', slug FROM li WHERE target NOT IN (SELECT slug FROM q)", "md_docs"))
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of which some are damaged."""
    c = F.when(F.col("doc_id") % 9 == 0, F.regexp_replace("content", "^---", "")).when(F.col("doc_id") % 9 == 1, F.replace("content", F.lit("]]."), F.lit("]."))).otherwise(F.col("content"))
    return links.quality(_damaged(spark, sf_dir).withColumn("content", c))


@query(with_views("SELECT row_number() OVER (ORDER BY name) AS pos, name, '- [[' || name || ']] — ' || regexp_extract(summary, '^([^.]*)', 1) AS line FROM concepts", "concepts"))
def index_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.index_page(views.concepts(spark, sf_dir))


# Search

_TERMS = r"t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents)"


@query(rf"WITH {_TERMS} SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM t) GROUP BY doc_id, term) GROUP BY term")
def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.postings(_docs(spark, sf_dir)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def _bm25(asked: list[str]) -> str:
    f = [f"len(list_filter(w, lambda x: {f'starts_with(x, {chr(39)}{a}{chr(39)})' if k == len(asked) - 1 else f'x = {chr(39)}{a}{chr(39)}'}))::DOUBLE AS f{k}" for k, a in enumerate(asked)]
    score = " + ".join(f"ln(1 + (n - df{k} + 0.5::DOUBLE) / (df{k} + 0.5::DOUBLE)) * f{k} * 2.2::DOUBLE / (f{k} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a))" for k in range(len(asked)))
    return f"""WITH {_TERMS}, c AS (SELECT doc_id, len(w)::DOUBLE AS l, {", ".join(f)} FROM t), s AS (SELECT count(*)::DOUBLE AS n, avg(l) AS a, {", ".join(f"count(*) FILTER (f{k} > 0)::DOUBLE AS df{k}" for k in range(len(asked)))} FROM c)
    SELECT doc_id, round({score}, 6) AS score FROM c, s WHERE {" AND ".join(f"f{k} > 0" for k in range(len(asked)))} ORDER BY score DESC, doc_id LIMIT 20"""


@query(_bm25(["the", "and", "from"]))
def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(_docs(spark, sf_dir), "The and FROM")


@query(_bm25(["de", "men"]))
def search_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(_docs(spark, sf_dir), "de: men*")


@query(_bm25(["the", "and", "from"]))
def search_stored_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings are written in order of term, then read for the query's terms only."""
    return search.bm25_stored(spark, search.write_index(_docs(spark, sf_dir)), "The and FROM")


@query(_bm25(["de", "men"]))
def search_stored_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25_stored(spark, search.write_index(_docs(spark, sf_dir)), "de: men*")


@query("SELECT doc_id, substring(text, greatest(instr(lower(text), 'licen') - 60, 1), instr(lower(text), 'licen') - greatest(instr(lower(text), 'licen') - 60, 1) + 65) AS snippet FROM documents WHERE contains(lower(text), 'licen') ORDER BY doc_id LIMIT 20")
def search_substring_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.substring(_docs(spark, sf_dir), "Licen")


_ASKED_FUZZY = "blue gren bolt"


def _near(field: str, weight: str) -> str:
    """A field's part of a fuzzy score: all its parts are compared."""
    m = len(_ASKED_FUZZY)
    gap = f"(SELECT min(levenshtein(substring(f, i::INT, n::INT), '{_ASKED_FUZZY}')) FROM range(1, length(f) + 1) a(i), range(0, {2 * m}) b(n) WHERE i + n <= length(f) + 1) / {m}::DOUBLE"
    return f"""(SELECT slug, CASE WHEN gap <= 0.4 THEN pow(CASE WHEN f = '{_ASKED_FUZZY}' THEN pow(2::DOUBLE, -52) ELSE greatest(gap, 0.001) END, {weight} * round(1 / sqrt(len(regexp_extract_all(f, '[^ ]+'))), 3)) END AS s
      FROM (SELECT slug, f, {gap} AS gap FROM (SELECT slug, lower({field}) AS f FROM concepts)))"""


@query(with_views(f" SELECT slug, round(coalesce(t.s, 1) * coalesce(u.s, 1), 6) AS score FROM {_near('title', '(2 / 3::DOUBLE)')} t JOIN {_near('summary', '(1 / 3::DOUBLE)')} u USING (slug) WHERE t.s IS NOT NULL OR u.s IS NOT NULL ORDER BY score, slug LIMIT 50", "concepts"))
def search_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.fuzzy(views.concepts(spark, sf_dir), "Blue gren Bolt", limit=50)


@query(with_views(", h AS (SELECT doc_id FROM documents) SELECT action, count(*) AS n FROM (SELECT CASE WHEN doc_id % 10 = 0 THEN 'insert' WHEN doc_id % 3 = 0 THEN 'update' ELSE 'skip' END AS action FROM h UNION ALL SELECT 'delete' FROM h WHERE doc_id % 50 = 1) GROUP BY action", "concepts"))
def search_index_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id")
    name = F.concat(F.lit("wiki/"), "doc_id")
    indexed = d.where("doc_id % 10 <> 0").select(name.alias("path"), F.lit(1.0).alias("mtime")).union(d.where("doc_id % 50 = 1").select(F.concat(F.lit("old/"), "doc_id"), F.lit(1.0)))
    return search.sync(indexed, d.select(name.alias("path"), F.when(F.col("doc_id") % 3 == 0, 2.0).otherwise(1.001).alias("mtime"))).groupBy("action").agg(F.count("*").alias("n"))


@query(with_views("SELECT slug, title, status, count(*) OVER () AS total FROM concepts WHERE (contains(lower(slug), 'a') OR contains(lower(title), 'a')) AND status = 'stub' ORDER BY slug LIMIT 20 OFFSET 5", "concepts"))
def list_concepts_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.listing(views.concepts(spark, sf_dir), "A", "stub", 20, 5)


# Contexts

QUESTION = "What is the relation of eau and ung in en src7?"


def _scored(question: str) -> str:
    words = fx.question_words(question)
    score = "(" + " + ".join(f"(CASE WHEN contains(replace(stem, '_', ' '), '{w}') THEN 2 ELSE 0 END + CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END)" for w in words) + f") / {len(words)}::DOUBLE"
    return f"SELECT doc_id, text, stem, {score} AS score FROM (SELECT doc_id, text, lower(lang || '_' || source) AS stem FROM documents)"


_SCORED = f"sc AS ({_scored(QUESTION)})"


def _stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", "text", F.concat_ws("_", "lang", "source").alias("stem"))


@query(f"WITH {_SCORED} SELECT doc_id, round(score, 6) AS score FROM sc")
def relevance_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.scored(_stemmed(spark, sf_dir), QUESTION, F.col("text"), F.col("stem")).select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_SCORED} SELECT doc_id, round(score, 6) AS score FROM sc WHERE score > 0 ORDER BY sc.score DESC, doc_id LIMIT 25")
def relevance_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = context.scored(_stemmed(spark, sf_dir), QUESTION, F.col("text"), F.col("stem")).where("score > 0")
    return rows.orderBy(F.desc("score"), "doc_id").limit(25).select("doc_id", F.round("score", 6).alias("score"))


def _fold(name: str, source: str, budget: int) -> str:
    """Common tables of a greedy choice over SOURCE (n, tokens): NAME has a row (n, tokens, remaining) for each that is taken, by one fold over the ordered list."""
    return f"""{name}f AS (SELECT list_reduce(list(struct_pack(left := tokens, rows := [struct_pack(n := n, tokens := tokens, remaining := 0::BIGINT)]) ORDER BY n), lambda a, x: CASE WHEN a.left <= 0 OR x.left > a.left THEN a
        ELSE struct_pack(left := a.left - x.left, rows := list_append(a.rows, struct_pack(n := x.rows[1].n, tokens := x.left, remaining := a.left - x.left))) END,
        struct_pack(left := {budget}::BIGINT, rows := []::STRUCT(n BIGINT, tokens BIGINT, remaining BIGINT)[])).rows AS rows FROM {source}),
    {name} AS (SELECT unnest(rows, recursive := true) FROM {name}f)"""


def _ranked(name: str, source: str, body: str) -> str:
    return f"{name} AS (SELECT doc_id, score, {_TOKENS.format(body)} AS tokens, row_number() OVER (ORDER BY score DESC, doc_id) AS n FROM ({source}) WHERE score > 0)"


def _greedy(body: str, budget: int) -> str:
    return f"WITH {_ranked('r', _scored(QUESTION), body)}, {_fold('g', 'r', budget)} SELECT doc_id, round(score, 6) AS score, g.tokens, remaining FROM g JOIN r ON r.n = g.n"


@query(_greedy("text", 8500))
def context_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: documents that a question's context takes under a budget."""
    return context.context(_stemmed(spark, sf_dir), QUESTION, SMALL.available)


@query(_greedy("string_split(text, chr(10))[1]", 2000))
def context_first_para(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.context(_stemmed(spark, sf_dir), QUESTION, 2000, F.split("text", "\n")[0])


_BODIES = ("text", "string_split(text, chr(10))[1]", "stem")
_LEVELS = " UNION ALL ".join(f"SELECT {k} AS level, count(*) AS n_used, coalesce(sum(tokens), 0)::BIGINT AS tokens FROM l{k}" for k in range(3))
_FOLDS = ", ".join(f"{_ranked(f'l{k}r', _scored(QUESTION), body)}, {_fold(f'l{k}', f'l{k}r', 8500)}" for k, body in enumerate(_BODIES))


@query(f"WITH {_FOLDS}, n AS (SELECT count(*) AS n_scored FROM l0r), v AS ({_LEVELS}) SELECT level, n_scored, n_used, tokens FROM v, n WHERE level <= coalesce((SELECT min(level) FROM v, n WHERE n_used = n_scored), 2)")
def fallback_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.levels(_stemmed(spark, sf_dir), QUESTION, SMALL.available, F.split("text", "\n")[0])


PARTS = ("relation of eau", "ung in src7")


_ASKS = ", ".join(f"{_ranked(f'q{k}r', _scored(q), 'text')}, {_fold(f'q{k}', f'q{k}r', 4000)}" for k, q in enumerate(PARTS))


@query(f"WITH {_ASKS} SELECT doc_id, count(*) AS n_questions FROM ({' UNION ALL '.join(f'SELECT doc_id FROM q{k} JOIN q{k}r USING (n)' for k in range(len(PARTS)))}) GROUP BY doc_id")
def context_decomposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.decomposed(_stemmed(spark, sf_dir), list(PARTS), 4000)


#: Two index pages, then concepts and explorations, each with a heading of its own.
_KIND = "CASE WHEN doc_id < 2 THEN 'index' WHEN lang = 'de' THEN 'exploration' ELSE 'concept' END"
_ASSEMBLED = f"""WITH s AS (SELECT doc_id, lang, source, '# Page ' || doc_id || chr(10) || chr(10) || replace(coalesce(text, ''), chr(10), chr(10) || chr(10)) AS page FROM documents),
k AS (SELECT doc_id AS id, {_KIND} AS kind, page AS text, lower(lang || '_' || source) AS stem, CASE WHEN starts_with(page, '#') THEN array_to_string(regexp_split_to_array(page, '\n{{2,}}')[1:2], chr(10) || chr(10)) END AS first FROM s),
c AS (SELECT id, kind, text, first, {{score}} AS score FROM k),
m AS (SELECT unnest(['full', 'first_para', 'summaries_only']) AS mode),
t AS (SELECT mode, id, kind, score, greatest(1, ceil(strlen(CASE WHEN mode = 'first_para' AND kind = 'concept' THEN first ELSE text END) / 4.0))::BIGINT AS tokens FROM c, m WHERE score > 0 OR kind = 'index'),
r AS (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY CASE kind WHEN 'index' THEN 1 WHEN 'concept' THEN 2 ELSE 3 END, CASE kind WHEN 'index' THEN 0 ELSE -score END, id) AS n FROM t WHERE NOT (mode = 'summaries_only' AND kind = 'concept'))"""


def _modes(budget: int) -> str:
    words = fx.question_words(QUESTION)
    score = "(" + " + ".join(f"(CASE WHEN contains(replace(stem, '_', ' '), '{w}') THEN 2 ELSE 0 END + CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END)" for w in words) + f") / {len(words)}::DOUBLE"
    folds = ", ".join(_fold(f"f{k}", f"(SELECT * FROM r WHERE mode = '{m}')", budget) for k, m in enumerate(context.MODES))
    used = " UNION ALL ".join(f"SELECT '{m}' AS mode, * FROM f{k}" for k, m in enumerate(context.MODES))
    return f"""{_ASSEMBLED.replace("{score}", score)}, {folds}, u AS ({used}), e AS (SELECT mode, max(n) AS last FROM u WHERE remaining <= 0 GROUP BY mode)
    SELECT r.mode, r.id, kind, round(score, 6) AS score, r.tokens, CASE WHEN u.n IS NULL THEN 'skipped' ELSE 'used' END AS decision, remaining FROM r LEFT JOIN u ON u.mode = r.mode AND u.n = r.n LEFT JOIN e ON e.mode = r.mode WHERE last IS NULL OR r.n <= last
    UNION ALL SELECT mode, id, kind, round(score, 6), tokens, 'compressed', NULL FROM t WHERE mode = 'summaries_only' AND kind = 'concept'"""


@query(_modes(8500))
def context_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each page in a context of whole pages, of first paragraphs, and of summaries only."""
    page = F.concat(F.lit("# Page "), "doc_id", F.lit("\n\n"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n")))
    pages = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.expr(_KIND).alias("kind"), page.alias("text"), F.concat_ws("_", "lang", "source").alias("stem"))
    each = [context.assembled(pages, QUESTION, SMALL.available, m).withColumn("mode", F.lit(m)) for m in context.MODES]
    return each[0].union(each[1]).union(each[2]).withColumn("score", F.round("score", 6))


@query("WITH g AS (SELECT DISTINCT lower(p_type) AS gap FROM part), e AS (SELECT DISTINCT lower(p_type) AS t FROM part WHERE p_size < 3) SELECT gap FROM g WHERE gap NOT IN (SELECT t FROM e)")
def new_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return context.new_gaps(p.select(F.lower("p_type").alias("gap")).distinct(), p.where("p_size < 3").select(F.concat(F.lit("- open: "), "p_type", F.lit("!")).alias("text")).distinct())

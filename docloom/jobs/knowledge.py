"""Queries over statements, relations, changes, model outputs, organisations and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.jobs.corpus import _CHUNKS, TRIM
from docloom.jobs.registry import query
from docloom.operators import chunking, compiling, graph, incremental, org, relations
from docloom.session import table
from docloom.settings import SMALL, TINY
from docloom.sources import export, ingest, views
from docloom.sources.views import with_views
from docloom.streaming import watch

# Graph

_P = ", ".join(f"'{p}'" for p in graph.PREDICATES)
_EDGES = f"""x AS (SELECT trim(subject) AS s, trim(predicate) AS p, trim(object) AS o, confidence, reason, seq FROM triples WHERE trim(subject) <> '' AND trim(object) <> '' AND trim(predicate) IN ({_P})),
e AS (SELECT p AS predicate, s AS src, o AS dst, CASE WHEN p = 'CO_OCCURS' THEN least(greatest(coalesce(confidence, 0.7), 0), 1)::DOUBLE END AS weight, CASE WHEN p = 'CONTRADICTS' THEN coalesce(reason, '') END AS reason FROM x QUALIFY row_number() OVER (PARTITION BY p, s, o ORDER BY seq DESC) = 1)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges(views.triples(spark, sf_dir))


@query(with_views(f", {_EDGES} SELECT * FROM e", "triples"))
def edge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


@query(with_views(f", {_EDGES} SELECT (SELECT count(*) FROM (SELECT src FROM e UNION SELECT dst FROM e)) AS n_nodes, (SELECT count(*) FROM e) AS n_edges, (SELECT count(*) FROM triples) - (SELECT count(*) FROM x) AS n_skipped", "triples"))
def graph_load_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.load_report(views.triples(spark, sf_dir))


@query(with_views(f", {_EDGES}, n AS (SELECT src AS name FROM e UNION SELECT dst FROM e), s AS (SELECT 'part ' || id AS name, summary FROM concepts) SELECT n.name, coalesce(summary, '') AS summary FROM n LEFT JOIN s USING (name)", "triples", "concepts"))
def node_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts = views.concepts(spark, sf_dir).select(F.concat(F.lit("part "), "id").alias("name"), "summary")
    return graph.nodes(concepts, _edges(spark, sf_dir))


@query(with_views(f", {_EDGES} SELECT src, predicate, dst FROM e WHERE predicate IN ('IS_A', 'PART_OF')", "triples"))
def hierarchy_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).where(F.col("predicate").isin("IS_A", "PART_OF")).select("src", "predicate", "dst")


def _reach(predicate: str, depth: int, least: int = 1, start: str = "true", both: bool = False) -> str:
    step = f"SELECT DISTINCT src, dst FROM e WHERE predicate = '{predicate}'"
    if both:
        step += f" UNION SELECT dst, src FROM e WHERE predicate = '{predicate}'"
    return with_views(f", {_EDGES}, st AS ({step}), w AS (SELECT src AS start, dst AS node, 1 AS hops FROM st WHERE {start} UNION SELECT w.start, st.dst, hops + 1 FROM w JOIN st ON w.node = st.src WHERE hops < {depth}) SELECT start, node, min(hops) AS hops FROM w WHERE hops >= {least} GROUP BY start, node", "triples", recursive=True)


@query(_reach("IS_A", 5))
def ancestors_is_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reach(_edges(spark, sf_dir), ["IS_A"], 5)


@query(_reach("PART_OF", 5))
def ancestors_part_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reach(_edges(spark, sf_dir), ["PART_OF"], 5)


@query(_reach("ENABLES", 4, 2))
def enables_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reach(_edges(spark, sf_dir), ["ENABLES"], 4, least=2)


@query(with_views(f", {_EDGES}, b AS (SELECT src AS name, dst AS other, weight FROM e WHERE predicate = 'CO_OCCURS' AND weight >= 0.02 UNION ALL SELECT dst, src, weight FROM e WHERE predicate = 'CO_OCCURS' AND weight >= 0.02) SELECT name, other, max(weight) AS weight FROM b GROUP BY name, other", "triples"))
def cooccur_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(_edges(spark, sf_dir), "CO_OCCURS", 0.02).drop("reason")


@query(_reach("CO_OCCURS", 4, both=True))
def community_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reach(_edges(spark, sf_dir), ["CO_OCCURS"], 4, undirected=True)


@query(with_views(f", {_EDGES}, b AS (SELECT src AS name, dst AS other, reason FROM e WHERE predicate = 'CONTRADICTS' UNION ALL SELECT dst, src, reason FROM e WHERE predicate = 'CONTRADICTS') SELECT name, other, max(reason) AS reason FROM b GROUP BY name, other", "triples"))
def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(_edges(spark, sf_dir), "CONTRADICTS").drop("weight")


@query(with_views(f", {_EDGES} SELECT dst AS general, count(*) AS n, min(src) AS first FROM e WHERE predicate = 'EXEMPLIFIES' GROUP BY dst", "triples"))
def exemplifies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).where("predicate = 'EXEMPLIFIES'").groupBy(F.col("dst").alias("general")).agg(F.count("*").alias("n"), F.min("src").alias("first"))


@query(with_views(f""", {_EDGES}, b AS (SELECT src AS name, predicate, true AS o FROM e UNION ALL SELECT dst, predicate, false FROM e) SELECT name, count(*) FILTER (predicate IN ('IS_A', 'PART_OF') AND o) AS parents, count(*) FILTER (predicate IN ('IS_A', 'PART_OF') AND NOT o) AS children,
  count(*) FILTER (predicate = 'ENABLES' AND o) AS enables, count(*) FILTER (predicate = 'REQUIRES' AND o) AS requires, count(*) FILTER (predicate = 'CONTRADICTS') AS contradicts, count(*) FILTER (predicate = 'EXEMPLIFIES' AND o) AS examples FROM b GROUP BY name""", "triples"))
def analyze_concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.profile(_edges(spark, sf_dir))


@query(with_views(f", {_EDGES}, k AS (SELECT unnest([{_P}]) AS predicate), c AS (SELECT predicate, count(*) AS n FROM e GROUP BY predicate) SELECT predicate, coalesce(n, 0)::BIGINT AS n FROM k LEFT JOIN c USING (predicate) UNION ALL SELECT 'TOTAL', count(*) FROM e", "triples"))
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.statistics(_edges(spark, sf_dir))


@query(with_views(f", {_EDGES}, st AS (SELECT src, dst FROM e WHERE predicate = 'CO_OCCURS' UNION SELECT dst, src FROM e WHERE predicate = 'CO_OCCURS'), w AS (SELECT src AS node, src AS seen FROM st UNION SELECT node, dst FROM w JOIN st ON seen = src), c AS (SELECT node, min(seen) AS community FROM w GROUP BY node) SELECT community, count(*) AS size, min(node) AS first, max(node) AS last FROM c GROUP BY community HAVING count(*) >= 3", "triples", recursive=True))
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.communities(_edges(spark, sf_dir))


# Relations

_VALID = "v AS (SELECT seq, source, target, CASE WHEN type IN ('parent', 'child', 'related', 'conflict') THEN type ELSE 'related' END AS type FROM relations WHERE source <> target AND source IN (SELECT id FROM concepts) AND target IN (SELECT id FROM concepts)), f AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY seq) = 1)"


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.first_of_pair(relations.valid(views.relations(spark, sf_dir), views.concepts(spark, sf_dir)))


@query(with_views(f", {_VALID} SELECT * FROM f", "concepts", "relations"))
def dedup_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relations(spark, sf_dir)


@query(with_views(f", {_VALID} SELECT * FROM f UNION ALL SELECT seq, target, source, CASE type WHEN 'parent' THEN 'child' ELSE 'parent' END FROM f WHERE type IN ('parent', 'child') AND NOT EXISTS (SELECT 1 FROM f g WHERE g.source = f.target AND g.target = f.source)", "concepts", "relations"))
def inverse_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.with_inverses(_relations(spark, sf_dir))


@query(with_views(f", {_VALID} SELECT source, string_agg(type || ':' || target, ',' ORDER BY type, target) AS relations FROM f GROUP BY source", "concepts", "relations"))
def outgoing_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.outgoing(_relations(spark, sf_dir))


@query(with_views("SELECT (n // 30)::BIGINT AS batch, count(*) AS n, min(slug) AS first, max(slug) AS last FROM (SELECT slug, row_number() OVER (ORDER BY slug) - 1 AS n FROM concepts) GROUP BY 1", "concepts"))
def relation_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.batches(views.concepts(spark, sf_dir))


_GROUPS = "g AS (SELECT p_partkey // 7 AS gid, 'c' || (p_partkey // 7) AS canonical, 'm' || (p_partkey * 13 % 1499) AS member FROM part)"


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey div 7 AS gid", "concat('c', p_partkey div 7) AS canonical", "concat('m', p_partkey * 13 % 1499) AS member")


@query(f"WITH RECURSIVE {_GROUPS}, l AS (SELECT DISTINCT a.gid AS x, b.gid AS y FROM g a JOIN g b USING (member)), w AS (SELECT x AS node, x AS seen FROM l UNION SELECT node, y FROM w JOIN l ON seen = x), c AS (SELECT node, min(seen) AS comp FROM w GROUP BY node), m AS (SELECT DISTINCT comp, member FROM g JOIN c ON gid = node) SELECT 'c' || comp AS canonical, count(*) AS n, string_agg(member, ',' ORDER BY member) AS members FROM m GROUP BY comp HAVING count(*) > 1")
def merge_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.merged_groups(_groups(spark, sf_dir))


@query(f"WITH {_GROUPS}, p AS (SELECT 'm' || p_partkey AS name, length(p_name || p_type) AS size FROM part), j AS (SELECT gid, member, canonical, size FROM g JOIN p ON p.name = g.member) SELECT gid, arg_min(member, struct_pack(o := (member <> canonical)::INT, s := -size, m := member)) AS chosen FROM j GROUP BY gid")
def canonical_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "part").select(F.concat(F.lit("m"), "p_partkey").alias("name"), F.concat("p_name", "p_type").alias("content"))
    return relations.canonical_pages(_groups(spark, sf_dir), pages)


# Changes

_FILES = "f AS (SELECT 'raw/' || doc_id || '.md' AS path, sha256(text) AS sha FROM documents)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("concat('raw/', doc_id, '.md') AS path", "sha2(text, 256) AS sha256")


@query(with_views(f", {_FILES}, j AS (SELECT coalesce(f.path, h.path) AS path, sha, h.sha256 AS was FROM f FULL JOIN hash_store h ON h.path = f.path) SELECT path, CASE WHEN was IS NULL THEN 'new' WHEN sha IS NULL THEN 'deleted' ELSE 'modified' END AS status FROM j WHERE was IS DISTINCT FROM sha", "hash_store"))
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.changes(_files(spark, sf_dir), views.hash_store(spark, sf_dir))


@query(with_views(f", {_FILES}, d AS (SELECT path, sha FROM f WHERE substring(sha, 1, 1) < '8') SELECT path, sha256 FROM hash_store WHERE path NOT IN (SELECT path FROM d) UNION ALL SELECT path, sha FROM d", "hash_store"))
def hash_store_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.updated_store(views.hash_store(spark, sf_dir), _files(spark, sf_dir).where("substring(sha256, 1, 1) < '8'"))


@query(with_views(f", {_FILES} SELECT path, sha AS sha256 FROM f WHERE path NOT IN (SELECT path FROM hash_store)", "hash_store"))
def checkpoint_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.todo(_files(spark, sf_dir), views.hash_store(spark, sf_dir))


@query("SELECT doc_id AS key FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0")
def stale_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    made = d.where("doc_id % 3 <> 0").selectExpr("doc_id AS key", "if(doc_id % 5 = 0, 1, 3) AS mtime")
    return incremental.stale(made, d.selectExpr("doc_id AS key", "2 AS mtime"))


_CACHE = "q AS (SELECT sha256('m|s|' || text) AS key FROM conversations), c AS (SELECT sha256('m|s|' || text) AS key, turn AS hit_count, text AS response FROM conversations WHERE role = 'user')"


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = incremental.cache_key(F.lit("m"), F.lit("s"), F.col("text"))
    return table(spark, sf_dir, "conversations").select(key.alias("key"), "role", F.col("turn").alias("hit_count"), F.col("text").alias("response"), F.col("text").alias("prompt"))


@query(f"WITH {_CACHE} SELECT key, key IN (SELECT key FROM c) AS hit FROM q")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _requests(spark, sf_dir)
    return incremental.lookup(r, r.where("role = 'user'"))


@query(f"WITH {_CACHE} SELECT count(*) AS entries, sum(hit_count)::BIGINT AS hits, (sum(strlen(response)) // 1024)::BIGINT AS kilobytes FROM c")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.cache_report(_requests(spark, sf_dir).where("role = 'user'"))


@query("SELECT DISTINCT sha256('m|s|' || text) AS key, CASE WHEN role = 'user' THEN text ELSE substring(string_split(trim(text), chr(10))[-1], 1, 40) END AS response FROM conversations WHERE role = 'user' OR text NOT IN (SELECT text FROM conversations WHERE role = 'user')")
def cached_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _requests(spark, sf_dir)
    return incremental.complete(r, r.where("role = 'user'").dropDuplicates(["key"]), compiling.first_words)


# Models' outputs

_OUT = "o AS (SELECT conv_id AS source, turn AS idx, 'Topic ' || (conv_id % 37) AS name, regexp_extract(output, '\"summary\": \"([^\"]*)\"', 1) AS summary, CASE WHEN turn % 3 <> 0 THEN 'Known' END AS existing_match, 'similar' AS match_type FROM llm_outputs)"


def _outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.llm_outputs(spark, sf_dir).select(F.col("conv_id").alias("source"), F.col("turn").alias("idx"), "output")
    return compiling.parse_concepts(rows)


@query(with_views(f", {_OUT} SELECT * FROM o", "llm_outputs"))
def concepts_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outputs(spark, sf_dir).drop("pos")


@query(with_views(f", {_OUT} SELECT source // 4 AS source, name, string_agg(DISTINCT idx::VARCHAR, ',' ORDER BY idx::VARCHAR) AS chunks, arg_min(summary, struct_pack(l := -length(summary), i := idx, s := summary)) AS summary, arg_min(existing_match, idx) AS existing_match, 'similar' AS match_type FROM o GROUP BY source // 4, name", "llm_outputs"))
def concept_merge_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _outputs(spark, sf_dir).withColumn("source", F.expr("source div 4"))
    merged = compiling.merge_concepts(rows)
    return merged.withColumn("match_type", F.coalesce("match_type", F.lit("similar")))


@query(with_views(f", {_OUT}, k AS (SELECT DISTINCT 'Topic ' || c_custkey AS name FROM customer WHERE c_custkey < 20) SELECT source, count(*) FILTER (name NOT IN (SELECT name FROM k) AND match_type <> 'similar') AS created, count(*) FILTER (name IN (SELECT name FROM k)) AS complemented, count(*) FILTER (name NOT IN (SELECT name FROM k) AND match_type = 'similar') AS similar FROM o GROUP BY source", "llm_outputs"))
def action_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "customer").where("c_custkey < 20").select(F.concat(F.lit("Topic "), "c_custkey").alias("name"))
    return compiling.actions(_outputs(spark, sf_dir), known)


@query("""WITH a AS (SELECT conv_id, turn, substring(string_split(trim(text), chr(10))[-1], 1, 40) AS answer FROM conversations)
SELECT conv_id, string_agg('### 청크 ' || turn || chr(10) || answer, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn, answer) AS prompt FROM a GROUP BY conv_id""")
def map_reduce_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return compiling.reduced(compiling.mapped(rows, F.col("text"), compiling.first_words, ["conv_id", "turn"]), ["conv_id"], "turn")


_SAID = lambda x: f"left(string_split(trim({x}, {TRIM}), chr(10))[-1], 40)"
_BLOCKS = lambda n: f"string_agg('### 청크 ' || {n} || chr(10) || answer, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY {n})"


@query(with_views(f", {_CHUNKS}, an AS (SELECT doc_id, strategy, index, grp, {_SAID('content')} AS answer FROM full_chunks), tr AS (SELECT doc_id, grp + 1 AS n, {_SAID(_BLOCKS('index'))} AS answer FROM an WHERE strategy = 'hierarchical' GROUP BY doc_id, grp), al AS (SELECT doc_id, index AS n, answer FROM an WHERE strategy <> 'hierarchical' UNION ALL SELECT doc_id, n, answer FROM tr) SELECT doc_id, {_SAID(_BLOCKS('n'))} AS summary FROM al GROUP BY doc_id", "md_docs", recursive=True))
def map_reduce_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiling.summarise(chunking.chunk_documents(views.md_docs(spark, sf_dir), TINY), compiling.first_words)


@query("""WITH c AS (SELECT conv_id AS doc_id, turn AS index, (contains(lower(text), 'the'))::INT + (contains(lower(text), 'eau'))::INT + (contains(lower(text), 'ung'))::INT AS hits, greatest(1, ceil(strlen(text) / 4.0))::BIGINT AS tokens FROM conversations),
r AS (SELECT *, sum(tokens) OVER (PARTITION BY doc_id ORDER BY hits DESC, index, tokens ROWS UNBOUNDED PRECEDING) AS used FROM c WHERE hits > 0) SELECT doc_id, index, hits, tokens FROM r WHERE used <= 400""")
def keyword_chunk_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    chunks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("index"), c.alias("content"), F.greatest(F.lit(1), F.ceil(F.octet_length(c) / 4)).cast("long").alias("token_count"))
    return compiling.keyword_chunks(chunks, ["the", "eau", "ung"], 400)


# Organisations

@query(with_views("SELECT team, member, coalesce(role, 'viewer') AS role, coalesce(wiki, 'wiki/' || member) AS wiki FROM org_members", "org_members"))
def members_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return org.members(views.org_members(spark, sf_dir))


@query(with_views(", m AS (SELECT org, team, coalesce(role, 'viewer') AS role, pages FROM org_members) SELECT org, team, role, count(*) AS n_members, round(sum(pages), 2) AS pages, (CASE WHEN role IS NULL THEN 1 ELSE 0 END + CASE WHEN team IS NULL THEN 2 ELSE 0 END)::BIGINT AS level FROM m GROUP BY GROUPING SETS ((org, team, role), (org, team), (org))", "org_members"))
def org_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return org.rollup(views.org_members(spark, sf_dir))


@query(with_views("SELECT event_id, member, team, action FROM activity WHERE team = 2 ORDER BY ts DESC, event_id LIMIT 50", "activity"))
def activity_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return org.activity(views.activity(spark, sf_dir), team=2)


@query(with_views(", l AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY member ORDER BY ts, event_id) > 86400000000 AS new FROM activity), s AS (SELECT member, sum(coalesce(new, false)::INT) OVER (PARTITION BY member ORDER BY ts, event_id) AS session FROM l) SELECT member, session::BIGINT AS session, count(*) AS n FROM s GROUP BY member, session", "activity"))
def activity_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return org.sessions(views.activity(spark, sf_dir), 86400)


@query(with_views(", f AS (SELECT member, arg_min(coalesce(role, 'viewer'), struct_pack(t := team, r := coalesce(role, 'viewer'))) AS role FROM org_members GROUP BY member) SELECT member, role, role IN ('admin', 'editor') AS allowed FROM f", "org_members"))
def permission_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return org.allowed(views.org_members(spark, sf_dir), "write")


@query("SELECT source AS section, count(*) AS n, count(*) FILTER (doc_id % 7 = 0) AS stubs FROM documents GROUP BY source")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return org.status(d.select(F.col("source").alias("section"), F.concat("text", F.when(F.col("doc_id") % 7 == 0, "\nstatus: stub").otherwise("")).alias("content")))


@query("SELECT url AS path, CASE WHEN strlen(html) < 1024 THEN strlen(html) || ' B' WHEN strlen(html) < 1048576 THEN format('{:.1f} KB', floor(strlen(html) / 1024.0::DOUBLE * 10 + 0.5) / 10) ELSE format('{:.1f} MB', floor(strlen(html) / 1048576.0::DOUBLE * 10 + 0.5) / 10) END AS shown FROM pages")
def raw_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return org.human_sizes(table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.octet_length("html").alias("size")))


@query("SELECT p_name AS slug, count(*) AS n_versions, CASE WHEN count(*) = 1 THEN min(p_type) ELSE string_agg('## ' || p_partkey || '의 버전' || chr(10) || chr(10) || p_type, chr(10) || chr(10) ORDER BY p_partkey) END AS content FROM part GROUP BY p_name")
def shared_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return org.shared_pages(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("member"), F.col("p_name").alias("slug"), F.col("p_type").alias("content")))


@query(with_views("SELECT slug, title, (SELECT count(*) FROM concepts) AS total FROM concepts ORDER BY title, slug LIMIT 10", "concepts"))
def home_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return org.top_by_title(views.concepts(spark, sf_dir))


# Sources

_KIND = "CASE WHEN regexp_matches(lower(s), '^https?://(?:www\\.)?(?:youtube\\.com|youtu\\.be)/') THEN 'youtube' WHEN regexp_matches(lower(s), '^https?://github\\.com/[^/]+/[^/]+') THEN 'github' WHEN regexp_matches(lower(s), '^https?://') THEN 'web' WHEN regexp_matches(lower(s), '\\.pdf$') THEN 'pdf' WHEN regexp_matches(lower(s), '\\.(?:md|txt)$') THEN 'text' ELSE 'unsupported' END"
_NAMED = "n AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 'https://youtu.be/abcdefghi' || (10 + page_id % 90) || '?t=1' WHEN 2 THEN 'https://github.com/a/b' || page_id WHEN 3 THEN page_id || '.PDF' WHEN 4 THEN page_id || '.md' ELSE page_id || '.bin' END AS s FROM pages)"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = "CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN concat('https://youtu.be/abcdefghi', 10 + page_id % 90, '?t=1') WHEN 2 THEN concat('https://github.com/a/b', page_id) WHEN 3 THEN concat(page_id, '.PDF') WHEN 4 THEN concat(page_id, '.md') ELSE concat(page_id, '.bin') END AS s"
    return table(spark, sf_dir, "pages").selectExpr("page_id", s)


@query(f"WITH {_NAMED} SELECT page_id, {_KIND} AS kind, CASE WHEN page_id % 6 = 1 THEN 'abcdefghi' || (10 + page_id % 90) END AS video FROM n")
def source_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).select("page_id", ingest.source_kind(F.col("s")).alias("kind"), ingest.video_id(F.col("s")).alias("video"))


@query("""WITH u AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(url, '^[a-zA-Z]+://[^/]*', ''), '[?#].*$', ''), '/+$', '') AS p FROM pages), l AS (SELECT page_id, url, regexp_extract(p, '([^/]+)$', 1) AS last FROM u)
SELECT page_id, substring(regexp_replace(regexp_replace(lower(CASE WHEN last <> '' THEN regexp_replace(last, '\\.[A-Za-z0-9]{1,5}$', '') ELSE regexp_extract(url, '^[a-zA-Z]+://([^/:?#]*)', 1) END), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS slug FROM l""".replace("\\\\", "\\"))
def url_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", ingest.url_slug(F.col("url")).alias("slug"))


@query("SELECT page_id, '![a](images/' || substring(md5('https://x.org/' || page_id || '.png?v=1'), 1, 12) || '.png) and ![](images/' || substring(md5('http://y.org/b'), 1, 12) || ') end' AS markdown FROM pages")
def image_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = F.concat(F.lit("![a](https://x.org/"), "page_id", F.lit(".png?v=1) and ![](http://y.org/b) end"))
    return table(spark, sf_dir, "pages").select("page_id", ingest.local_images(md).alias("markdown"))


@query()
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.web_pages(table(spark, sf_dir, "pages"))


@query()
def md_to_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.html_pages(views.md_docs(spark, sf_dir))


@query(with_views(""", o AS (SELECT video_id, start, row_number() OVER (PARTITION BY video_id ORDER BY start, event_id) AS n FROM segments),
r AS (SELECT video_id, n, start AS first, 0 AS section FROM o WHERE n = 1 UNION ALL SELECT o.video_id, o.n, CASE WHEN o.start - r.first >= 86400 THEN o.start ELSE r.first END, CASE WHEN o.start - r.first >= 86400 THEN r.section + 1 ELSE r.section END FROM r JOIN o ON o.video_id = r.video_id AND o.n = r.n + 1)
SELECT video_id, section, first::BIGINT AS first, count(*) AS n FROM r GROUP BY video_id, section, first""", "segments", recursive=True))
def transcript_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.segments(spark, sf_dir)
    return ingest.transcript_sections(s, 86400)


@query("SELECT event_id, CASE WHEN s >= 3600 THEN format('[{:02d}:{:02d}:{:02d}]', (s // 3600)::INT, (s % 3600 // 60)::INT, (s % 60)::INT) ELSE format('[{:02d}:{:02d}]', (s // 60)::INT, (s % 60)::INT) END AS clock FROM (SELECT event_id, event_id * 7 % 9000 AS s FROM events)")
def clock_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", ingest.clock(F.col("event_id") * 7 % 9000).alias("clock"))


@query("""WITH r AS (SELECT p_brand AS sheet, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos, '| ' || p_partkey || ' | ' || replace(p_name, 'e', '\\|') || ' |' AS line FROM part), t AS (SELECT sheet, count(*) AS total FROM r GROUP BY sheet)
SELECT sheet, (pos // 100 + 1)::BIGINT AS block, ceil(any_value(total) / 100.0)::BIGINT AS blocks, min(pos) + 1 AS first, max(pos) + 1 AS last, count(*) AS n, md5(string_agg(line, chr(10) ORDER BY pos)) AS lines FROM r JOIN t USING (sheet) GROUP BY sheet, pos // 100""".replace("\\\\", "\\"))
def sheet_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("sheet"), pos.cast("long").alias("pos"), F.array(F.col("p_partkey").cast("string"), F.replace("p_name", F.lit("e"), F.lit("|"))).alias("cells"))
    return ingest.sheet_blocks(rows, SMALL.rows_per_block).withColumn("lines", F.md5(F.col("lines").cast("binary")))


@query("WITH s AS (SELECT l_orderkey AS doc, round(l_quantity / 3, 1) AS size, sum(l_linenumber * 10)::BIGINT AS n FROM lineitem GROUP BY 1, 2), b AS (SELECT doc, arg_min(size, struct_pack(n := -n, s := size)) AS body FROM s GROUP BY doc) SELECT doc, body, round(body * 1.5::DOUBLE, 3) AS h1, round(body * 1.2::DOUBLE, 3) AS h2, round(body * 1.1::DOUBLE, 3) AS h3 FROM b")
def font_heading_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.font_levels(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_quantity") / 3).alias("size"), (F.col("l_linenumber") * 10).alias("n")))


_BLOBS = "CASE p_partkey % 5 WHEN 0 THEN 'src/a/' WHEN 1 THEN 'docs/' WHEN 2 THEN 'node_modules/x/' ELSE '' END || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.bin' ELSE '/README.md' END"


@query(f"""WITH f AS (SELECT {_BLOBS} AS path, p_partkey * 7919 % 120000 AS size FROM part), p AS (SELECT *, CASE WHEN regexp_matches(lower(path), '(?:^|/)(?:node_modules|dist)/') THEN 999 WHEN ends_with(lower(path), '/readme.md') THEN 0 WHEN NOT regexp_matches(lower(path), '\\.(?:md|py)$') THEN 900 WHEN ends_with(lower(path), '.md') THEN 5 + len(string_split(path, '/')) - 1 ELSE 10 + len(string_split(path, '/')) - 1 END AS priority FROM f)
SELECT path, size, priority::INT AS priority FROM p WHERE size <= 100000 AND priority < 900 ORDER BY priority, size, path LIMIT 40""".replace("\\\\", "\\"))
def repo_file_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = "concat(CASE p_partkey % 5 WHEN 0 THEN 'src/a/' WHEN 1 THEN 'docs/' WHEN 2 THEN 'node_modules/x/' ELSE '' END, p_partkey, CASE p_partkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.bin' ELSE '/README.md' END) AS path"
    return ingest.select_files(table(spark, sf_dir, "part").selectExpr(path, "p_partkey * 7919 % 120000 AS size"))


@query("SELECT doc_id, CASE WHEN length(trim(regexp_replace(l, '^#+', ''))) > 0 THEN substring(trim(regexp_replace(l, '^#+', '')), 1, 80) ELSE 'note' END AS title FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '## ' ELSE '' END || CASE WHEN doc_id % 11 = 0 THEN '' ELSE string_split(text, chr(10))[1] END AS l FROM documents)")
def note_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.when(F.col("doc_id") % 3 == 0, "## ").otherwise(""), F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", ingest.note_title(line).alias("title"))


@query("SELECT p_partkey AS id, slug, CASE WHEN n = 1 THEN slug ELSE slug || '_' || n END AS name FROM (SELECT p_partkey, p_name AS slug, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.unique_names(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("slug")))


@query("SELECT page_id AS key, url AS source, page_id % 3 = 0 OR url IN (SELECT url FROM pages WHERE page_id % 3 = 0) AS known FROM pages")
def duplicate_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), F.col("url").alias("source"))
    return ingest.duplicates(p, p.where("key % 3 = 0"))


@query("SELECT p_partkey AS id, array_to_string(list_sort(list_distinct([(1 + p_partkey % 3)::INT, 3, 5, 6, 7])), ',') AS slides FROM part")
def slide_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = F.concat((1 + F.col("p_partkey") % 3).cast("string"), F.lit(", 3,5-7,x"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(F.transform(ingest.slide_numbers(spec), lambda x: x.cast("string")), ",").alias("slides"))


# Streams

@query(with_views(" SELECT date_trunc('hour', ts)::TIMESTAMP AS start, action, count(*) AS n FROM activity WHERE ts IS NOT NULL GROUP BY ALL", "activity"))
def activity_stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling counts by a stream over the whole log."""
    rows = views.activity(spark, sf_dir).select("ts", "action", F.col("member").alias("key"))
    return watch.replayed(rows, lambda log: watch.counts(log, late="1 day"), "hourly")


@query(with_views(", l AS (SELECT member, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY member ORDER BY ts) > 3600000000 AS new FROM activity WHERE ts IS NOT NULL), s AS (SELECT member, ts, sum(coalesce(new, true)::INT) OVER (PARTITION BY member ORDER BY ts) AS burst FROM l) SELECT member AS key, min(ts)::TIMESTAMP AS start, (max(ts) + INTERVAL 1 HOUR)::TIMESTAMP AS \"end\", count(*) AS n FROM s GROUP BY member, burst", "activity"))
def debounce_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of each member's events by a stream over the whole log."""
    rows = views.activity(spark, sf_dir).select("ts", "action", F.col("member").alias("key"))
    return watch.replayed(rows, lambda log: watch.debounced(log, "1 hour", "1 day"), "bursts")


@query(with_views(f", {_FILES} SELECT f.path, CASE WHEN h.path IS NULL THEN 'new' ELSE 'modified' END AS status FROM f LEFT JOIN hash_store h ON h.path = f.path WHERE h.sha256 IS DISTINCT FROM f.sha", "hash_store"))
def watch_foreach_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed files by a stream over a folder, batch by batch."""
    from docloom.session import scratch

    files = watch.watched(spark, watch.as_folder(_files(spark, sf_dir), "files"), "path string, sha256 string")
    out = scratch(spark, "changes")
    watch.watch(files, views.hash_store(spark, sf_dir), lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    return spark.read.schema("path string, status string, batch int").parquet(out).drop("batch")

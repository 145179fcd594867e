"""Further queries: updates of pages, choices of chunks, expansions, office sources and evictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as fx
from docloom.jobs.corpus import _TOKENS, TRIM, _fold
from docloom.jobs.knowledge import _EDGES
from docloom.jobs.registry import query
from docloom.operators import chunking, compiling, context, graph, incremental, links
from docloom.operators.components import components
from docloom.session import materialize, table
from docloom.sources import ingest, views
from docloom.sources.views import with_views


@query(with_views(r"""SELECT slug, md5(CASE WHEN doc_id % 2 = 0 THEN regexp_replace(replace(content, 'lang: ', 'last_updated: 2020-01-01' || chr(10) || 'lang: '), 'last_updated: 2020-01-01', 'last_updated: 2026-01-02') ELSE regexp_replace(content, '\n---\n', chr(10) || 'last_updated: 2026-01-02' || chr(10) || '---' || chr(10)) END) AS content FROM md_docs""", "md_docs"))
def frontmatter_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.when(F.col("doc_id") % 2 == 0, F.replace("content", F.lit("lang: "), F.lit("last_updated: 2020-01-01\nlang: "))).otherwise(F.col("content"))
    return views.md_docs(spark, sf_dir).select("slug", F.md5(fx.with_date(old, F.lit("2026-01-02")).cast("binary")).alias("content"))


@query(with_views(r"SELECT slug, md5(regexp_replace(content, '\[\[([^\]|#]+?)(?:\|[^\]]+)?\]\]', '[\1](/concepts/\1)', 'g')) AS content FROM md_docs", "md_docs"))
def link_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.md_docs(spark, sf_dir).select("slug", F.md5(links.markdown_links(F.col("content")).cast("binary")).alias("content"))


@query(with_views(", f AS (SELECT source_file, min(slug) AS first FROM concepts GROUP BY source_file) SELECT c.source_file AS source, md5('# Index' || chr(10) || string_agg('- [[' || slug || ']] — ' || summary, chr(10) ORDER BY slug)) AS page FROM concepts c JOIN f ON f.source_file = c.source_file AND slug <> first GROUP BY c.source_file", "concepts"))
def index_line_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.concepts(spark, sf_dir).groupBy(F.col("source_file").alias("source")).agg(F.min("slug").alias("first"), F.array_sort(F.collect_list(F.struct("slug", "summary"))).alias("l"))
    page = F.concat(F.lit("# Index\n"), F.array_join(F.transform("l", lambda x: F.concat(F.lit("- [["), x["slug"], F.lit("]] — "), x["summary"])), "\n"))
    return rows.select("source", F.md5(links.without_lines(page, F.col("first")).cast("binary")).alias("page"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN '# ' || repeat(p_type, 12) ELSE p_name END AS page FROM part")
def merge_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("# "), F.repeat("p_type", 12))).when(F.col("p_partkey") % 3 == 1, F.repeat("p_type", 20)).otherwise("# short")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), fx.kept_merge(merged, F.col("p_name")).alias("page"))


@query("""WITH RECURSIVE c AS (SELECT conv_id AS d, turn AS i, greatest(1, ceil(strlen(text) / 4.0))::BIGINT AS t, contains(text, 'e ') AND turn % 2 = 0 AS g FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) = 1),
n AS (SELECT * FROM c WHERE EXISTS (SELECT 1 FROM c x WHERE x.d = c.d AND x.g AND abs(x.i - c.i) <= 1)), o AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY NOT g, i) AS k FROM n),
r AS (SELECT d, i, k, t <= 300 AS used, CASE WHEN t <= 300 THEN 300 - t ELSE 300 END AS left_ FROM o WHERE k = 1 UNION ALL SELECT o.d, o.i, o.k, o.t <= r.left_, CASE WHEN o.t <= r.left_ THEN r.left_ - o.t ELSE r.left_ END FROM r JOIN o ON o.d = r.d AND o.k = r.k + 1)
SELECT d AS doc_id, i AS index FROM r WHERE used""")
def tagged_chunk_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    rows = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id"), F.col("turn").alias("index")).agg(F.min("text").alias("text"))
    chunks = rows.select("doc_id", "index", fx.estimate_tokens(t).alias("tokens"), (t.contains("e ") & (F.col("index") % 2 == 0)).alias("tagged"))
    return compiling.tagged_chunks(chunks, 300)


@query(with_views(", n AS (SELECT DISTINCT 'Topic ' || p_partkey % 40 AS name FROM part) SELECT replace(name, ' ', '_') AS slug, name FROM n WHERE name NOT IN (SELECT 'Topic ' || id FROM concepts WHERE id < 15)", "concepts"))
def concept_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.concat(F.lit("Topic "), F.col("p_partkey") % 40).alias("name"))
    pages = views.concepts(spark, sf_dir).where("id < 15").select(F.concat(F.lit("Topic_"), "id").alias("slug"), F.concat(F.lit("Topic "), "id").alias("name"))
    return compiling.stubs(names, pages)


def _few(kind: str, sql: str, most: int) -> str:
    return f"SELECT name, '{kind}' AS kind, other FROM (SELECT DISTINCT name, other FROM ({sql})) QUALIFY row_number() OVER (PARTITION BY name ORDER BY other) <= {most}"


_UP = "predicate IN ('IS_A', 'PART_OF')"
_EXPAND = " UNION ALL ".join([
    _few("parents", f"SELECT src AS name, dst AS other FROM e WHERE {_UP}", 5), _few("children", f"SELECT dst AS name, src AS other FROM e WHERE {_UP}", 5),
    _few("enables", "SELECT src AS name, dst AS other FROM e WHERE predicate = 'ENABLES'", 5), _few("requires", "SELECT src AS name, dst AS other FROM e WHERE predicate = 'REQUIRES'", 5),
    _few("contradicts", "SELECT src AS name, dst AS other FROM e WHERE predicate = 'CONTRADICTS' UNION ALL SELECT dst, src FROM e WHERE predicate = 'CONTRADICTS'", 3),
])


@query(with_views(f", {_EDGES}, x2 AS ({_EXPAND}) SELECT name, " + ", ".join(f"coalesce(string_agg(other, ',' ORDER BY other) FILTER (kind = '{k}'), '') AS {k}" for k in ("parents", "children", "enables", "requires", "contradicts")) + " FROM x2 GROUP BY name", "triples"))
def concept_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.expansion(graph.edges(views.triples(spark, sf_dir)))


@query(with_views(f", {_EDGES}, st AS (SELECT src, dst FROM e WHERE predicate = 'CO_OCCURS' UNION SELECT dst, src FROM e WHERE predicate = 'CO_OCCURS'), w AS (SELECT src AS node, src AS seen FROM st UNION SELECT node, dst FROM w JOIN st ON seen = src), c AS (SELECT node, min(seen) AS community FROM w GROUP BY node) SELECT community, count(*) AS size, count(*) FILTER (contains(lower(node), 'supplier 1')) AS matches FROM c GROUP BY community HAVING count(*) FILTER (contains(lower(node), 'supplier 1')) > 0", "triples", recursive=True))
def community_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = graph.edges(views.triples(spark, sf_dir)).where("predicate = 'CO_OCCURS'").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return graph.communities_with(components(materialize(own, "co-occurs")), "Supplier 1")


def _ontology(question: str, budget: int) -> str:
    """Communities, then concepts, each folded over what is left."""
    words = fx.question_words(question)
    score = lambda text: "(" + " + ".join(f"CASE WHEN contains(replace(lower(name), '_', ' '), '{w}') THEN 2 ELSE 0 END + CASE WHEN contains(lower({text}), '{w}') THEN 1 ELSE 0 END" for w in words) + f") / {len(words)}::DOUBLE"
    best = lambda table, text, n: f"(SELECT name, {_TOKENS.format('text')} AS tokens, row_number() OVER (ORDER BY {score(text)} DESC, name) AS n FROM {table} WHERE {score(text)} > 0 QUALIFY n <= {n})"
    return f"""WITH com AS (SELECT p_brand AS name, string_agg(DISTINCT p_name, ' ' ORDER BY p_name) AS text FROM part GROUP BY p_brand), con AS (SELECT p_name || ' ' || p_partkey AS name, p_name || ' ' || p_type AS text FROM part),
    b1 AS {best('com', 'text', 5)}, {_fold('f1', 'b1', budget)}, b2 AS {best('con', 'name', 3)}, {_fold('f2', 'b2', '(SELECT ' + str(budget) + ' - coalesce(sum(tokens), 0) FROM f1)')}
    SELECT 'community' AS kind, name, f1.tokens, remaining FROM f1 JOIN b1 USING (n) UNION ALL SELECT 'concept', name, f2.tokens, remaining FROM f2 JOIN b2 USING (n)"""


@query(_ontology("which red widget or hot gear", 1000))
def context_ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph's part of a context: brands as communities, parts as concepts."""
    p = table(spark, sf_dir, "part")
    communities = p.groupBy(F.col("p_brand").alias("name")).agg(F.concat_ws(" ", F.array_sort(F.collect_set("p_name"))).alias("text"))
    concepts = p.select(F.concat_ws(" ", "p_name", "p_partkey").alias("name"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return context.ontology(communities, concepts, "which red widget or hot gear", 1000)


_SLIDES = "concat('# D\n\n## Slide 1: a\n\n', if({0} % 2 = 0, '### 시각 분석\n\nseen\n\n', ''), '---\n\n## Slide 2: b\n\n', if({0} % 3 = 0, '### 시각 분석\n\n---\n', '### 시각 분석\n\nx\n'))"


@query("SELECT p_partkey AS doc_id, 1 AS slide FROM part WHERE p_partkey % 2 <> 0 UNION ALL SELECT p_partkey, 2 FROM part WHERE p_partkey % 3 = 0")
def slides_without_vision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.slides_without_vision(table(spark, sf_dir, "part").selectExpr("p_partkey AS doc_id", _SLIDES.format("p_partkey").replace("\n", "\\n") + " AS content"))


@query("WITH f AS (SELECT l_orderkey AS doc, l_suppkey % 4 - 1 AS note, min(l_linenumber) AS pos FROM lineitem WHERE l_suppkey % 4 - 1 > 0 GROUP BY 1, 2) SELECT doc, note, row_number() OVER (PARTITION BY doc ORDER BY pos, note)::INT AS number FROM f")
def note_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.note_numbers(table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc", "l_linenumber AS pos", "l_suppkey % 4 - 1 AS note"))


@query("SELECT l_orderkey AS doc, string_agg(CASE l_returnflag WHEN 'A' THEN '++' || l_linenumber || '++' WHEN 'R' THEN '~~' || l_linenumber || '~~' ELSE l_linenumber::VARCHAR END, '' ORDER BY l_linenumber, l_returnflag = 'R', l_returnflag = 'N') AS text FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_returnflag) = 1) GROUP BY l_orderkey")
def tracked_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("f"))
    return ingest.tracked(runs.selectExpr("l_orderkey AS doc", "l_linenumber AS pos", "CASE f WHEN 'A' THEN 'insert' WHEN 'R' THEN 'delete' ELSE 'plain' END AS kind", "CAST(l_linenumber AS STRING) AS text"))


@query(with_views(rf""", s0 AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(content, '(?m)^(## )', chr(1) || '\1', 'g'), chr(1)), lambda x: trim(x, {TRIM})), lambda x: length(x) > 0) AS l FROM md_docs),
s AS (SELECT doc_id, i, greatest(1, ceil(strlen(l[i]) / 4.0))::BIGINT AS t FROM s0, unnest(range(1, len(l) + 1)) u(i)),
r AS (SELECT doc_id, i, t AS used, 0 AS block FROM s WHERE i = 1 UNION ALL SELECT s.doc_id, s.i, CASE WHEN r.used >= 150 THEN s.t ELSE r.used + s.t END, CASE WHEN r.used >= 150 THEN r.block + 1 ELSE r.block END FROM r JOIN s ON s.doc_id = r.doc_id AND s.i = r.i + 1)
SELECT s.doc_id, block::BIGINT AS block, count(*) AS n, sum(t)::BIGINT AS tokens FROM r JOIN s ON s.doc_id = r.doc_id AND s.i = r.i GROUP BY s.doc_id, block""", "md_docs", recursive=True))
def merged_at_h2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.merged_at_h2(views.md_docs(spark, sf_dir), 150)


@query("SELECT event_id AS key FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def cache_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.activity(spark, sf_dir).select(F.col("event_id").alias("key"), F.col("ts").alias("created_at"))
    now = rows.agg(F.max("created_at").alias("now")).first()["now"]
    return incremental.unexpired(rows, F.lit(now), 7).select("key")


@query("SELECT user_id % 5 AS team, user_id AS member, count(*) FILTER (event_type = 'view') AS concepts, count(*) FILTER (event_type = 'click') AS explorations FROM events GROUP BY 1, 2")
def team_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.activity(spark, sf_dir).groupBy("team", "member").agg(F.count_if(F.col("action") == "view").alias("concepts"), F.count_if(F.col("action") == "click").alias("explorations"))

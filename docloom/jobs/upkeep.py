"""Queries over what is kept up to date: indexes in segments, trigrams, ledgers of batches and the steps after them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.jobs.corpus import _LINKS, _SCORED, _TERMS, QUESTION, _bm25
from docloom.jobs.registry import query
from docloom.jobs.writing import _BODY, _FILES_LIST, _FRONT, _NEW, NL
from docloom.operators import authoring, batches, compiling, grams, graph, index, org, outputs
from docloom.session import scratch, table
from docloom.sources import ingest, views
from docloom.sources.views import with_views
from docloom.streaming import bursts, steps


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def kept_up(spark: SparkSession, sf_dir: str) -> index.Index:
    """An index that had other documents, lacked some and had old texts of others, after four updates that bring it to all documents."""
    docs, own = _docs(spark, sf_dir), index.open_index(spark)
    old = docs.where("doc_id % 10 <> 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("outdated "), F.reverse("text"))).otherwise(F.col("text")).alias("text"))
    index.update(own, old.union(docs.where("doc_id % 50 = 1").select(F.col("doc_id") + (1 << 40), F.lit("the and from gone"))), fan=3)
    index.update(own, docs.where("doc_id % 10 = 0"), fan=3)
    index.update(own, docs.where("doc_id % 3 = 0 AND doc_id % 2 = 0"), docs.where("doc_id % 50 = 1").select((F.col("doc_id") + (1 << 40)).alias("doc_id")), fan=3)
    return index.update(own, docs.where("doc_id % 3 = 0 AND doc_id % 2 = 1"), fan=3)


@query(_bm25(["the", "and", "from"]))
def index_upkeep_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.bm25(kept_up(spark, sf_dir), "The and FROM")


@query(rf"WITH {_TERMS} SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM t) GROUP BY doc_id, term) GROUP BY term")
def index_upkeep_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_up(spark, sf_dir).postings().groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query("SELECT action, count(*) AS n FROM (SELECT CASE WHEN doc_id % 10 = 0 THEN 'insert' WHEN doc_id % 3 = 0 THEN 'update' ELSE 'skip' END AS action FROM documents UNION ALL SELECT 'delete' FROM documents WHERE doc_id % 50 = 1) GROUP BY action")
def index_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    seen = docs.where("doc_id % 10 <> 0").select("doc_id", F.lit(1.0).alias("mtime")).union(docs.where("doc_id % 50 = 1").select(F.col("doc_id") + (1 << 40), F.lit(1.0)))
    own = index.update(index.open_index(spark), docs.where("doc_id % 10 <> 0").union(docs.where("doc_id % 50 = 1").select(F.col("doc_id") + (1 << 40), F.lit("gone"))))
    return index.follow(own, docs.withColumn("mtime", F.when(F.col("doc_id") % 3 == 0, 2.0).otherwise(1.001)), seen)[1]


@query("SELECT doc_id, substring(text, greatest(instr(lower(text), 'licen') - 60, 1), instr(lower(text), 'licen') - greatest(instr(lower(text), 'licen') - 60, 1) + 65) AS snippet FROM documents WHERE contains(lower(text), 'licen') ORDER BY doc_id LIMIT 20")
def grams_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grams.substring(grams.write_grams(_docs(spark, sf_dir).withColumn("stem", F.lit(""))), "Licen")


@query(f"WITH {_SCORED} SELECT doc_id, round(score, 6) AS score FROM sc WHERE score > 0 ORDER BY sc.score DESC, doc_id LIMIT 25")
def grams_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = grams.write_grams(table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws("_", "lang", "source").alias("stem")))
    return grams.relevant(own, QUESTION).withColumn("score", F.round("score", 6))


# Batches that can stop, and what follows them


def failing(path: str, content: str, attempt: int) -> str:
    """A stand-in for compiling a page: some contents can't be compiled, others meet a rate limit at first."""
    k = int(path)
    if k % 11 == 0:
        raise ValueError("broken page")
    if k % 7 == 0 and attempt <= k % 3:
        raise RuntimeError("429: rate limit")
    return f"{len(content)} characters"


_OUTCOME = "CASE WHEN doc_id % 11 = 0 THEN 'broken' WHEN doc_id % 7 = 0 AND doc_id % 3 >= 2 THEN 'limited' ELSE 'done' END"


@query(f"""SELECT doc_id::VARCHAR AS path, CASE {_OUTCOME} WHEN 'done' THEN length(coalesce(text, '')) || ' characters' END AS result, CASE {_OUTCOME} WHEN 'broken' THEN 'ValueError: broken page' WHEN 'limited' THEN 'RuntimeError: 429: rate limit' END AS error,
CASE WHEN doc_id % 11 = 0 OR doc_id % 7 <> 0 THEN 1 ELSE least(doc_id % 3 + 1, 2) END::INT AS attempt FROM documents""")
def batch_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's result or error, after two attempts."""
    return batches.run(_docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content")), failing, scratch(spark, "ledger"), slices=4, attempts=2)


def _stepped(spark: SparkSession, sf_dir: str) -> steps.Steps:
    """All pages in four arrivals: first as they were before, without links, then as they are."""
    pages = views.md_docs(spark, sf_dir)
    old = pages.where("doc_id % 2 = 0").withColumn("content", F.lit("---\ntitle: old\n---\n\nNothing yet.\n"))
    folder, own, state = scratch(spark, "arrivals"), scratch(spark, "steps"), scratch(spark, "steps-state")
    for arrival in (old, pages.where("doc_id % 3 = 0"), pages.where("doc_id % 3 = 1"), pages.where("doc_id % 3 = 2")):
        arrival.write.mode("append").parquet(folder)
        done = steps.run(spark.readStream.schema(pages.schema).parquet(folder), own, state)
    return done


@query(with_views(f", {_LINKS} SELECT slug, pos::BIGINT AS pos, target FROM li", "md_docs"))
def after_batch_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stepped(spark, sf_dir).edges().select("slug", F.col("pos").cast("long").alias("pos"), "target")


@query(with_views(", a AS (SELECT doc_id, 0 AS batch, 0 AS n FROM md_docs WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, doc_id % 3 + 1, 2 FROM md_docs) SELECT batch::BIGINT AS batch, count(*) AS n_pages, sum(n)::BIGINT AS n_edges FROM a GROUP BY batch", "md_docs"))
def after_batch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stepped(spark, sf_dir).log()


# Files of repositories, known members, summaries under a budget

_FILES = "SELECT p_brand AS repo, concat('src', p_size % 4, '/d', p_size % 3, '/', p_partkey, CASE p_partkey % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.bin' WHEN 3 THEN '.txt' ELSE '.ts' END) AS path, p_partkey * 7919 % 120000 AS size FROM part"


@query(f"""WITH RECURSIVE f AS ({_FILES}), p AS (SELECT *, ceil(size / 4.0)::BIGINT + 1 AS tokens, len(string_split(path, '/')) - 1 AS depth FROM f WHERE size <= 100000 AND NOT ends_with(path, '.bin')),
q AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY CASE WHEN regexp_matches(path, '[.](md|txt)$') THEN 5 ELSE 10 END + depth, size, path) AS n FROM p QUALIFY n <= 40),
r AS (SELECT repo, n, tokens, path, true AS taken, 60000 - tokens AS remaining FROM q WHERE n = 1
  UNION ALL SELECT q.repo, q.n, q.tokens, q.path, q.tokens <= r.remaining, CASE WHEN q.tokens <= r.remaining THEN r.remaining - q.tokens ELSE r.remaining END FROM r JOIN q ON q.repo = r.repo AND q.n = r.n + 1)
SELECT repo, path, n::INT AS n, tokens, taken FROM r""")
def repository_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.sql(_FILES.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))
    return ingest.chosen_files(files.select("repo", "path", "size", (F.ceil(F.col("size") / 4) + 1).cast("long").alias("tokens")))


_MEMBERS = "concat('[{\"canonical\": \"c', o_orderkey % 7, '\", \"members\": [\"m', o_orderkey % 50, '\", \"m', o_custkey % 60, '\", \"ghost', o_orderkey % 3, '\", \" m', o_custkey % 45, ' \"]}]')"
_KNOWN = "SELECT concat('m', p_partkey) AS name FROM part WHERE p_partkey % 4 > 0"


@query(f"""WITH a AS (SELECT o_orderkey AS source, {_MEMBERS} AS output FROM orders), m AS (SELECT source, unnest(['m' || source % 50, regexp_extract(output, '"(m[0-9]+)", "ghost', 1), regexp_extract(output, '" (m[0-9]+) "', 1)]) AS name, unnest([0, 1, 3]) AS spot, regexp_extract(output, '"(c[0-9]+)"', 1) AS canonical FROM a),
k AS (SELECT source, canonical, string_agg(name, ',' ORDER BY spot) AS members, count(*) AS n FROM m WHERE name IN ({_KNOWN}) GROUP BY ALL) SELECT source, canonical, members FROM k WHERE n >= 2""")
def groups_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate groups of answers that name members nobody knows."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source"), F.expr(_MEMBERS).alias("output"))
    known = spark.sql(_KNOWN.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))
    return outputs.parse_groups(rows, known).select("source", "canonical", F.array_join("members", ",").alias("members"))


@query("WITH a AS (SELECT conv_id AS doc_id, turn, substring(regexp_extract(trim(coalesce(text, '')), '[^\\n]*$'), 1, 40) AS s FROM conversations WHERE coalesce(text, '') <> '') SELECT doc_id, count(*) AS n FROM a GROUP BY doc_id".replace("\\\\", "\\"))
def reduce_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to all turns, reduced in rounds under a budget by a model that keeps each answer's mark, counted."""
    turns = table(spark, sf_dir, "conversations").where("coalesce(text, '') <> ''").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("index"), F.concat(F.lit("@ "), "text").alias("content"))
    marks = lambda prompts: ["@" * p.count("@") for p in prompts]
    return compiling.summarised_within(turns, marks, 60).select("doc_id", F.length("summary").cast("long").alias("n"))


_TITLES = "concat(CASE doc_id % 5 WHEN 0 THEN '한국 ' WHEN 1 THEN '가나 ' WHEN 2 THEN '' WHEN 3 THEN upper(lang) ELSE concat(doc_id % 10, '. ') END, substring(regexp_replace(coalesce(text, ''), '[^a-zA-Z0-9]+', ' '{all}), 1, 12), ' ', doc_id)"


@query(f"SELECT title, row_number() OVER (ORDER BY title COLLATE ko, title)::INT AS pos FROM (SELECT {_TITLES.replace('{all}', ", 'g'")} AS title FROM documents)")
def titles_korean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All titles with their place in Korean order; places within ranges of titles, then sums over the ranges before."""
    titles = _docs(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select(F.expr(_TITLES.replace("{all}", "")).alias("title"))
    return org.placed_by_title(titles)


_CLUSTERS = "SELECT 'g' || c_nationkey AS component, c_name AS node FROM customer UNION ALL SELECT 's' || s_suppkey % 40, s_name FROM supplier"


@query(f"""WITH l AS ({_CLUSTERS}), s AS (SELECT component, count(*) AS size FROM l GROUP BY component HAVING count(*) >= 3),
k AS (SELECT component, node, sum(ceil((strlen(node) + 2) / 4.0)) OVER (PARTITION BY component ORDER BY node ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY component ORDER BY node) AS n FROM l),
m AS (SELECT component, count(*) AS shown, string_agg(node, ', ' ORDER BY node) AS members FROM k WHERE used <= 120 OR n = 1 GROUP BY component)
SELECT component AS community, size, shown, members, CASE WHEN starts_with(component, 's') THEN '개념 클러스터: ' || members ELSE trim(substring('개념 목록: ' || members, 1, 40)) END AS summary FROM m JOIN s USING (component)""")
def community_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of communities by a model that says nothing of suppliers."""
    labels = table(spark, sf_dir, "customer").select(F.concat(F.lit("g"), "c_nationkey").alias("component"), F.col("c_name").alias("node"))
    labels = labels.union(table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey") % 40), "s_name"))
    said = lambda prompts: ["" if "Supplier" in p else x for p, x in zip(prompts, compiling.first_words(prompts), strict=True)]
    return graph.community_summaries(labels, said, 120).select("community", "size", F.col("shown").cast("long").alias("shown"), "members", "summary")


@query(with_views(""", l AS (SELECT member, action, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY member ORDER BY ts) > 3600000000 AS new FROM activity WHERE ts IS NOT NULL AND member IS NOT NULL),
s AS (SELECT member, action, ts, sum(coalesce(new, true)::INT) OVER (PARTITION BY member ORDER BY ts) AS burst FROM l)
SELECT member::VARCHAR AS key, epoch_us(min(ts)) AS start, epoch_us(max(ts)) AS last, count(*) AS n, array_to_string(list_sort(list(DISTINCT action)), ',') AS paths FROM s GROUP BY member, burst""", "activity"))
def debounce_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of each member's events by timers, over the whole log, with what is open at its end."""
    log = views.activity(spark, sf_dir).select("ts", F.col("member").alias("key"), F.col("action").alias("path"))
    folder = scratch(spark, "events")
    log.write.parquet(folder)
    return bursts.debounced(spark.readStream.schema(log.schema).parquet(folder), 3600).withColumn("paths", F.array_join("paths", ","))


# Pages out of concepts


def writes(prompts: list[str]) -> list[str]:
    """A stand-in for a model: a page for a new concept; for one that is there, an action by the length of its name."""
    out = []
    for p in prompts:
        name = p.split("\n", 1)[0].removeprefix("개념: ")
        if "기존 문서:" not in p:
            out.append(f"```markdown\n# {name}\n\nNew.\n```")
        else:
            out.append(["ACTION: duplicate", "ACTION: conflict\nCONFLICT_SUMMARY: differs", f"ACTION: complement\n---CONTENT---\n# {name}\n\nMerged.", "ACTION: complement\n---CONTENT---\n"][len(name) % 4])
    return out


_NOTICE = f"'> ⚠️ **충돌 감지됨** — `' || {_NEW} || '` 과 내용이 상충합니다.' || {NL} || '> 충돌 보고: `conflicts/2026-01-02_' || slug || '.md`' || {NL} || {NL} || "


@query(with_views(f""", p AS (SELECT *, 'Doc ' || doc_id AS name, {_FRONT.format(_FILES_LIST)} {_BODY} AS sourced, {_FRONT.format(_FILES_LIST)} {_NOTICE} {_BODY} AS noticed FROM md_docs)
SELECT slug, CASE length(name) % 4 WHEN 0 THEN 'duplicate' WHEN 1 THEN 'conflict' ELSE 'complemented' END AS action, md5(CASE length(name) % 4 WHEN 1 THEN noticed WHEN 2 THEN '# ' || name || {NL} || {NL} || 'Merged.' WHEN 3 THEN 'ACTION: complement' || {NL} || '---CONTENT---' ELSE sourced END) AS content FROM p WHERE doc_id % 2 = 0
UNION ALL SELECT 'New_' || doc_id, 'created', md5('# New ' || doc_id || {NL} || {NL} || 'New.') FROM md_docs WHERE doc_id % 2 = 1""", "md_docs"))
def pages_compiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that concepts of all documents create or change."""
    pages = views.md_docs(spark, sf_dir)
    name = F.concat(F.when(F.col("doc_id") % 2 == 0, "Doc ").otherwise("New "), "doc_id")
    found = pages.select(F.concat(F.lit("raw/src"), F.col("doc_id") % 8, F.lit(".md")).alias("source"), name.alias("name"), F.lit("s").alias("summary"), F.when(F.col("doc_id") % 2 == 0, name).alias("existing_match"), F.when(F.col("doc_id") % 2 == 0, "exact").alias("match_type"), F.lit("text").alias("text"))
    touched, log = authoring.compiled(found, pages.select("slug", F.concat(F.lit("Doc "), "doc_id").alias("name"), "content"), writes, "2026-01-02")
    return touched.join(log.select("slug", "action"), "slug").select("slug", "action", F.md5(F.col("content").cast("binary")).alias("content"))

"""Tables of the corpus's own shapes, derived from the given tables.

Each view has its DuckDB text beside it (``DUCK``), for checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import table

#: Sections of a derived page begin before every so many lines.
LINES = 5


def md_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, slug, content): documents as Markdown pages with front matter, sections and links to other pages."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    n = docs.agg(F.count("*").alias("n"))
    page = r"""concat('---\ntitle: Doc ', doc_id, '\nlang: ', lang, '\nsource_files: raw/', source, '.md\n---\n\n# Doc ', doc_id, '\n\n',
      array_join(transform(split(text, '\n'), (x, i) -> concat(if(i % 5 = 0, concat('## Section ', i div 5 + 1, '\n\n'), ''), x)), '\n\n'),
      '\n\nSee [[Doc ', (7 * doc_id + 3) % n, ']] and [[Doc ', (3 * doc_id + 1) % n, '|alias ', doc_id, ']].\n')"""
    return docs.crossJoin(F.broadcast(n)).select("doc_id", F.expr("concat('Doc_', doc_id)").alias("slug"), F.expr(page).alias("content"))  # n is one row


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(slug, name, title, summary, status, source_file) from parts."""
    return table(spark, sf_dir, "part").select(
        F.expr("concat(replace(p_name, ' ', '_'), '_', p_partkey)").alias("slug"), F.expr("concat(p_name, ' ', p_partkey)").alias("name"), F.col("p_name").alias("title"),
        F.col("p_type").alias("summary"), F.when(F.col("p_size") % 10 == 0, "stub").alias("status"), F.expr("concat('raw/', p_brand, '.md')").alias("source_file"), F.col("p_partkey").alias("id"),
    )


_TRIPLES = [
    "SELECT concat('supplier ', s_suppkey) AS subject, 'PART_OF' AS predicate, n_name AS object, 0.9D AS confidence, '' AS reason, s_suppkey AS seq FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "SELECT n_name, 'PART_OF', r_name, 0.95D, '', 100000000 + n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey",
    "SELECT concat('part ', p_partkey), 'IS_A', p_type, 0.8D, '', 200000000 + p_partkey FROM part",
    "SELECT DISTINCT p_type, 'IS_A', concat('class ', substring(p_type, 1, 1)), 0.7D, '', 300000000 FROM part",
    "SELECT concat('customer ', c_custkey), 'BELONGS_TO', c_mktsegment, 0.6D, '', 400000000 + c_custkey FROM customer",
    # suppliers of a team of seven that follow each other among those of a part
    """SELECT concat('supplier ', a), 'CO_OCCURS', concat('supplier ', b), round(count(*) / 100.0D, 2), '', 500000000 + max(p) FROM
       (SELECT l_partkey AS p, l_suppkey AS a, lead(l_suppkey) OVER (PARTITION BY l_partkey, floor(l_suppkey / 7) ORDER BY l_suppkey) AS b FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)) WHERE b IS NOT NULL AND b - a = 1 GROUP BY a, b""",
    "SELECT concat('part ', p_partkey), 'ENABLES', concat('part ', (2 * p_partkey + 1) % 997 + 1), 0.5D, '', 600000000 + p_partkey FROM part WHERE p_partkey % 3 = 0",
    "SELECT concat('part ', p_partkey), 'REQUIRES', concat('part ', (5 * p_partkey) % 991 + 1), 0.5D, '', 700000000 + p_partkey FROM part WHERE p_partkey % 4 = 0",
    "SELECT concat('part ', p_partkey), 'PRECEDES', concat('part ', p_partkey + 1), 0.5D, '', 800000000 + p_partkey FROM part WHERE p_partkey % 5 <> 0",
    "SELECT concat('part ', p_partkey), 'CONTRADICTS', concat('part ', p_partkey % 50 + 1), 0.4D, concat('size ', p_size), 900000000 + p_partkey FROM part WHERE p_partkey % 9 = 0",
    "SELECT concat('part ', p_partkey), 'EXEMPLIFIES', p_brand, 0.4D, '', 1000000000 + p_partkey FROM part",
    # blanks, unknown predicates and repeats
    "SELECT concat('part ', p_partkey), if(p_partkey % 2 = 0, 'LIKES', 'IS_A'), if(p_partkey % 2 = 0, 'x', ' '), 1.5D, '', 1100000000 + p_partkey FROM part WHERE p_partkey % 11 = 0",
    "SELECT concat('part ', p_partkey), 'CONTRADICTS', concat('part ', p_partkey % 50 + 1), 0.3D, 'again', 1200000000 + p_partkey FROM part WHERE p_partkey % 18 = 0",
]
TRIPLE_TABLES = ("supplier", "nation", "region", "part", "customer", "lineitem")


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, predicate, object, confidence, reason, seq): statements with cycles, repeats, blanks and unknown predicates."""
    text = " UNION ALL ".join(f"({x})" for x in _TRIPLES)
    frames = {t: table(spark, sf_dir, t) for t in TRIPLE_TABLES}
    for t in TRIPLE_TABLES:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}} AS {t}").replace(f"JOIN {t}", f"JOIN {{{t}}} AS {t}")
    return spark.sql(text, **frames).withColumn("seq", F.col("seq").cast("long"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, source, target, type) between concepts by id, with self loops, repeats and unknown types."""
    p = table(spark, sf_dir, "part")
    one = p.selectExpr("CAST(p_partkey AS BIGINT) AS seq", "CAST(p_partkey AS BIGINT) AS source", "CAST(p_partkey * 3 % 500 AS BIGINT) AS target", "CASE p_size % 5 WHEN 0 THEN 'parent' WHEN 1 THEN 'child' WHEN 2 THEN 'related' WHEN 3 THEN 'conflict' ELSE 'unknown' END AS type")
    two = p.where("p_partkey % 4 = 0").selectExpr("CAST(p_partkey + 1000000000 AS BIGINT)", "CAST(p_partkey * 3 % 500 AS BIGINT)", "CAST(p_partkey AS BIGINT)", "'related'")
    return one.union(two).union(p.where("p_partkey % 6 = 0").selectExpr("CAST(p_partkey + 2000000000 AS BIGINT)", "CAST(p_partkey AS BIGINT)", "CAST(p_partkey * 3 % 500 AS BIGINT)", "'child'"))


def hash_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, sha256): an earlier state of the documents, with new, changed and vanished ones."""
    d = table(spark, sf_dir, "documents")
    old = d.where("doc_id % 10 <> 0").selectExpr("concat('raw/', doc_id, '.md') AS path", "sha2(if(doc_id % 7 = 0, concat(text, '!'), text), 256) AS sha256")
    return old.union(d.where("doc_id % 100 = 1").selectExpr("concat('raw/gone-', doc_id, '.md')", "sha2(text, 256)"))


def llm_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, conv_id, turn, output): model answers, fenced, bare or broken, of extracted concepts."""
    t = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    body = r"""concat('[{"name": "Topic ', conv_id % 37, '", "summary": "', replace(replace(replace(substring(text, 1, 20 + turn), '\\', ' '), '"', ''), '\n', ' '), '", "existing_match": ', if(turn % 3 = 0, 'null', '"Known"'), ', "match_type": "similar"}]')"""
    text = rf"""CASE conv_id % 3 WHEN 0 THEN concat('Here:\n```json\n', {body}, '\n```\n') WHEN 1 THEN {body} ELSE concat('Sure. ', {body}, ' Done.') END"""
    return t.select(F.expr("conv_id * 1000 + turn").alias("id"), "conv_id", "turn", F.expr(text).alias("output"))


_ANSWERS = {
    "triple_outputs": r"""concat('[{"subject": " Topic ', conv_id % 37, ' ", "predicate": "', element_at(array('is_a', 'CO_OCCURS', 'LIKES', 'part_of'), CAST(turn % 4 + 1 AS INT)), '", "object": "Topic ', turn % 11, '", "confidence": ', element_at(array('1.7', 'null', '0.456', '-1', '"0.3"'), CAST(turn % 5 + 1 AS INT)), ', "reason": "', {0}, '"}, {"subject": "", "predicate": "IS_A", "object": "x"}, {"subject": "Topic ', turn % 7, '", "predicate": "enables", "object": "Topic ', conv_id % 5, '"}]')""",
    "relation_outputs": r"""concat('[{"source": "T', turn, '", "target": " T', turn - 1, '", "type": "Parent"}, {"source": "T', turn, '", "target": "T', turn, '", "type": "child"}, {"source": "T', turn, '", "target": "T999", "type": "x"}, {"source": "T', turn - 1, '", "target": "T', turn, '", "type": "', {0}, '"}]')""",
    "group_outputs": r"""concat('[{"canonical": " ', {0}, ' ", "members": ["a', conv_id, '", " b ", ""]}, {"canonical": "x", "members": ["one", " "]}, {"canonical": "y', turn, '", "members": ["p", "q", "r"]}]')""",
}
_CLEAN = r"""replace(replace(replace(substring(text, 1, CAST(20 + turn AS INT)), '\\', ' '), '"', ''), '\n', ' ')"""


def _answers(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """(conv_id, turn, output): answers of a model to each assistant's turn, fenced, bare or in a sentence."""
    body = _ANSWERS[name].replace("{0}", _CLEAN)
    text = rf"""CASE conv_id % 3 WHEN 0 THEN concat('Here:\n```json\n', {body}, '\n```\n') WHEN 1 THEN {body} ELSE concat('Sure. ', {body}, ' Done.') END"""
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.expr(text).alias("output"))


def triple_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with statements, some without parts, with unknown predicates, or with odd confidences."""
    return _answers(spark, sf_dir, "triple_outputs")


def relation_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with relations, some to themselves, to unknown concepts, or of unknown types."""
    return _answers(spark, sf_dir, "relation_outputs")


def group_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with groups, some of one member."""
    return _answers(spark, sf_dir, "group_outputs")


def wiki_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """md_docs, half of them with a section of related concepts, some of these with a section after it."""
    more = r"""CASE WHEN doc_id % 2 = 0 THEN concat(content, '\n## 관련 개념\n\n- [[Doc_', (3 * doc_id + 1) % 90, ']]\n- [[Doc_', doc_id % 17, ']] — x\n', if(doc_id % 4 = 0, '\n## 출처\n\n- x\n', '')) ELSE content END AS content"""
    return md_docs(spark, sf_dir).selectExpr("doc_id", "slug", more)


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, member, team, action, detail) from events."""
    return table(spark, sf_dir, "events").selectExpr("event_id", "CAST(ts AS TIMESTAMP) AS ts", "user_id AS member", "user_id % 5 AS team", "event_type AS action", "props AS detail")


def org_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(org, team, member, role, wiki) from customers and nations."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    role = "CASE c_mktsegment WHEN 'BUILDING' THEN 'admin' WHEN 'MACHINERY' THEN 'editor' WHEN 'HOUSEHOLD' THEN NULL ELSE 'viewer' END AS role"
    return c.join(n, F.expr("c_nationkey = n_nationkey")).selectExpr("'org' AS org", "n_name AS team", "c_name AS member", role, "if(c_custkey % 4 = 0, NULL, concat('wiki/', c_custkey)) AS wiki", "c_custkey AS id", "c_acctbal AS pages")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, pos, start, text): each user's events as a transcript, with starts in seconds."""
    return table(spark, sf_dir, "events").selectExpr("user_id AS video_id", "event_id", "unix_micros(CAST(ts AS TIMESTAMP)) div 1000000 AS start", "event_type AS text")


def _duck(text: str) -> str:
    """The same statement for DuckDB."""
    return text.replace("D,", "::DOUBLE,").replace("100.0D", "100.0::DOUBLE").replace("if(p_partkey % 2 = 0, 'LIKES', 'IS_A'), if(p_partkey % 2 = 0, 'x', ' ')", "CASE WHEN p_partkey % 2 = 0 THEN 'LIKES' ELSE 'IS_A' END, CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE ' ' END").replace("0.9D AS", "0.9::DOUBLE AS")


DUCK = {
    "md_docs": r"""md_docs AS (SELECT doc_id, 'Doc_' || doc_id AS slug, '---' || chr(10) || 'title: Doc ' || doc_id || chr(10) || 'lang: ' || lang || chr(10) || 'source_files: raw/' || source || '.md' || chr(10) || '---' || chr(10) || chr(10) || '# Doc ' || doc_id || chr(10) || chr(10) ||
      array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: (CASE WHEN (i - 1) % 5 = 0 THEN '## Section ' || ((i - 1) // 5 + 1) || chr(10) || chr(10) ELSE '' END) || x), chr(10) || chr(10)) ||
      chr(10) || chr(10) || 'See [[Doc ' || ((7 * doc_id + 3) % n) || ']] and [[Doc ' || ((3 * doc_id + 1) % n) || '|alias ' || doc_id || ']].' || chr(10) AS content FROM documents, (SELECT count(*) AS n FROM documents))""",
    "concepts": """concepts AS (SELECT replace(p_name, ' ', '_') || '_' || p_partkey AS slug, p_name || ' ' || p_partkey AS name, p_name AS title, p_type AS summary, CASE WHEN p_size % 10 = 0 THEN 'stub' END AS status, 'raw/' || p_brand || '.md' AS source_file, p_partkey AS id FROM part)""",
    "triples": "triples AS (" + " UNION ALL ".join(f"({_duck(x)})" for x in _TRIPLES) + ")",
    "relations": """relations AS (SELECT p_partkey::BIGINT AS seq, p_partkey::BIGINT AS source, (p_partkey * 3 % 500)::BIGINT AS target, CASE p_size % 5 WHEN 0 THEN 'parent' WHEN 1 THEN 'child' WHEN 2 THEN 'related' WHEN 3 THEN 'conflict' ELSE 'unknown' END AS type FROM part
      UNION ALL SELECT p_partkey + 1000000000, p_partkey * 3 % 500, p_partkey, 'related' FROM part WHERE p_partkey % 4 = 0
      UNION ALL SELECT p_partkey + 2000000000, p_partkey, p_partkey * 3 % 500, 'child' FROM part WHERE p_partkey % 6 = 0)""",
    "hash_store": """hash_store AS (SELECT 'raw/' || doc_id || '.md' AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS sha256 FROM documents WHERE doc_id % 10 <> 0
      UNION ALL SELECT 'raw/gone-' || doc_id || '.md', sha256(text) FROM documents WHERE doc_id % 100 = 1)""",
    "llm_outputs": r"""llm_outputs AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'Here:' || chr(10) || '```json' || chr(10) || b || chr(10) || '```' || chr(10) WHEN 1 THEN b ELSE 'Sure. ' || b || ' Done.' END AS output FROM
      (SELECT conv_id, turn, '[{"name": "Topic ' || (conv_id % 37) || '", "summary": "' || replace(replace(replace(substring(text, 1, (20 + turn)::INT), '\', ' '), '"', ''), chr(10), ' ') || '", "existing_match": ' || (CASE WHEN turn % 3 = 0 THEN 'null' ELSE '"Known"' END) || ', "match_type": "similar"}]' AS b FROM conversations WHERE role = 'assistant'))""",
    "activity": """activity AS (SELECT event_id, ts, user_id AS member, user_id % 5 AS team, event_type AS action, props AS detail FROM events)""",
    "org_members": """org_members AS (SELECT 'org' AS org, n_name AS team, c_name AS member, CASE c_mktsegment WHEN 'BUILDING' THEN 'admin' WHEN 'MACHINERY' THEN 'editor' WHEN 'HOUSEHOLD' THEN NULL ELSE 'viewer' END AS role, CASE WHEN c_custkey % 4 <> 0 THEN 'wiki/' || c_custkey END AS wiki, c_custkey AS id, c_acctbal AS pages FROM customer JOIN nation ON c_nationkey = n_nationkey)""",
    "segments": """segments AS (SELECT user_id AS video_id, event_id, epoch_us(ts) // 1000000 AS start, event_type AS text FROM events)""",
}


def _duck_answers(name: str) -> str:
    body = _ANSWERS[name].replace("{0}", "replace(replace(replace(substring(text, 1, (20 + turn)::INT), '\\', ' '), '\"', ''), chr(10), ' ')").replace("element_at(array(", "list_extract(list_value(")
    return f"""{name} AS (SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'Here:' || chr(10) || '```json' || chr(10) || b || chr(10) || '```' || chr(10) WHEN 1 THEN b ELSE 'Sure. ' || b || ' Done.' END AS output FROM (SELECT conv_id, turn, {body} AS b FROM conversations WHERE role = 'assistant'))"""


DUCK |= {name: _duck_answers(name) for name in _ANSWERS}
DUCK["wiki_pages"] = """wiki_pages AS (SELECT doc_id, slug, CASE WHEN doc_id % 2 = 0 THEN content || chr(10) || '## 관련 개념' || chr(10) || chr(10) || '- [[Doc_' || ((3 * doc_id + 1) % 90) || ']]' || chr(10) || '- [[Doc_' || (doc_id % 17) || ']] — x' || chr(10) || CASE WHEN doc_id % 4 = 0 THEN chr(10) || '## 출처' || chr(10) || chr(10) || '- x' || chr(10) ELSE '' END ELSE content END AS content FROM md_docs)"""


def with_views(sql: str, *names: str, recursive: bool = False) -> str:
    """DuckDB text with views in front."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(DUCK[n] for n in names)} {sql}" if not sql.lstrip().startswith(",") else f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(DUCK[n] for n in names)}{sql}"

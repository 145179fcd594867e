"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from docloom.llm.licenses import TEMPLATES
from docloom.llm.secrets import BASE, MORE, Rule

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _lowered(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}')"


def _rule(rank: int, r: Rule) -> str:
    tested = f"regexp_extract_all(text, {_quoted(r.pattern)}, {r.group})"
    return f"""SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, stop - size AS start, stop, tested FROM (
      SELECT doc_id, size, tested, sum(gap + size) OVER (PARTITION BY doc_id ORDER BY k)::BIGINT AS stop FROM (
        SELECT doc_id, unnest(range(len(found))) AS k, unnest(list_transform(found, lambda x: length(x))) AS size,
          unnest(list_transform(pieces[:len(found)], lambda x: length(x))) AS gap, unnest(list_transform(tested, lambda x: length(x))) AS tested
        FROM (SELECT doc_id, regexp_extract_all(text, {_quoted(r.pattern)}) AS found, string_split_regex(text, {_quoted(r.pattern)}) AS pieces, {tested} AS tested
              FROM documents WHERE regexp_matches(text, {_quoted(r.hint or r.pattern)})))) WHERE tested >= {r.least}"""


SECRETS = f"""
WITH s AS ({" UNION ALL ".join(_rule(k, r) for k, r in enumerate(BASE + MORE))}),
g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)},
  coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < {len(BASE)}), '') AS base,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN g USING (doc_id)
"""

_TEMPLATES = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in TEMPLATES.items())
_WORDS = r"list_filter(string_split(regexp_replace(lower(body), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '')"
_GRAMS = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
LICENSES = f"""
WITH t0 AS (SELECT license, {_WORDS} AS w FROM (VALUES {_TEMPLATES}) v(license, body)),
t AS (SELECT license, len(w) AS n_words, {_GRAMS} AS tg FROM t0),
d AS (SELECT doc_id, {_WORDS} AS w FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents)),
l0 AS (SELECT doc_id, k AS line, {_WORDS} AS w FROM (SELECT doc_id, k, string_split(text, chr(10))[k] AS body FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) u(k))),
l AS (SELECT doc_id, line, w, {_GRAMS} AS g, (sum(len(w)) OVER (PARTITION BY doc_id ORDER BY line) - len(w))::BIGINT AS start FROM l0 WHERE len(w) > 0),
u AS (SELECT doc_id, 0 AS line, 0 AS last, w, NULL AS own FROM d
  UNION ALL SELECT doc_id, line, line, w, NULL FROM l
  UNION ALL SELECT x.doc_id, x.line, y.line, d.w[x.start + 1:y.start + len(y.w)], license FROM l x JOIN t ON list_has_any(x.g, tg) JOIN d ON d.doc_id = x.doc_id
    JOIN l y ON y.doc_id = x.doc_id AND y.line > x.line AND least(x.start + n_words, len(d.w)) - 1 BETWEEN y.start AND y.start + len(y.w) - 1),
ug AS (SELECT doc_id, line, last, own, {_GRAMS} AS g FROM u),
m AS (SELECT doc_id, line, last, license, 2.0::DOUBLE * len(list_intersect(g, tg)) / (len(g) + len(tg)) AS dice FROM ug JOIN t ON own IS NULL OR own = license),
best AS (SELECT * FROM m WHERE dice >= 0.8 - 1e-9 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, license, line, last) = 1)
SELECT d.doc_id, license, round(dice, 6) AS dice, line::BIGINT AS line, last::BIGINT AS last FROM d LEFT JOIN best USING (doc_id)
"""

MIX = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('17:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source),
w AS (SELECT *, CASE (n - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::DOUBLE AS weight, source_size * 2::DOUBLE AS ceiling FROM s),
f AS (SELECT *, ceiling / weight AS fill FROM w),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(ceiling) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
lv AS (SELECT arg_min(level, struct_pack(fill := fill, source := coalesce(source, ''))) AS v FROM l WHERE fill > level),
t AS (SELECT source, source_size, CASE WHEN v IS NULL OR ceiling <= v * weight THEN ceiling ELSE v * weight END AS target FROM l, lv),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12) ELSE 0 END::BIGINT AS epochs FROM t),
r AS (SELECT *, round(target - epochs * source_size)::BIGINT AS rest FROM e),
c AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT doc_id, size, source_size, round(target, 4) AS target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken
FROM c JOIN r ON c.source IS NOT DISTINCT FROM r.source
"""

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DECONTAMINATION = f"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_lowered("text")}, '{_ALNUM}') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all({_lowered("text")}, '{_ALNUM}') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id::VARCHAR AS item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s FROM iw, unnest(range(1, greatest(len(w) - 9, 1) + 1)) u(i) WHERE len(w) > 0),
pos AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM dw, (SELECT DISTINCT n FROM win), unnest(range(1, len(w) - n + 2)) u(p)),
hit AS (SELECT doc_id, p, n, item FROM pos JOIN win USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

PERSPECTIVES = """
WITH t AS (SELECT conv_id, turn, role AS speaker, replace(coalesce(text, ''), '<|', '< |') AS body FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker IS NOT NULL AND speaker <> 'system'),
e AS (SELECT t.conv_id, perspective, turn, speaker, body, CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role,
  CASE WHEN speaker = perspective OR speaker = 'system' THEN NULL ELSE speaker END AS name FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, '<|' || role || coalesce(' name=' || replace(name, '<|', '< |'), '') || '|>' || chr(10) AS head FROM e),
g0 AS (SELECT *, head || body || '<|end|>' || chr(10) AS segment FROM h),
g AS (SELECT *, (sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker NULLS FIRST, segment ROWS UNBOUNDED PRECEDING) - length(segment))::BIGINT AS start FROM g0)
SELECT conv_id, perspective, turn, role, name, segment, start, start + CASE WHEN role = 'assistant' THEN length(head) ELSE length(segment) END AS mask_start, start + length(segment) AS mask_stop FROM g
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_lowered("text")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(2, len(w)) - 1], ' ') AS s FROM w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS node, a AS seen FROM e UNION SELECT node, b FROM reach JOIN e ON e.a = seen),
c AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component, w.doc_id) AS component_id, coalesce(component, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = w.doc_id
"""



def _crc32(text: str) -> str:
    """CRC-32 of a text of ASCII characters."""
    bits = "list_reduce(range(8), lambda d, k: xor(d >> 1, (d & 1) * 3988292384), xor(c, b))"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT), lambda c, b: {bits}, 4294967295::BIGINT), 4294967295::BIGINT)"


_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
STRUCTURE = f"""
WITH RECURSIVE g AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM g WHERE kind <> 0),
o AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(role || chr(0) || text), copy) AS k, rtrim(text, {_WHITE}) AS rest FROM d),
f AS (SELECT *, CASE WHEN rest = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate' WHEN right(rest, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM o),
c AS (SELECT conv_id, greatest(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS last FROM f GROUP BY conv_id),
moves AS (SELECT s AS state, n AS inserts, CASE WHEN n = 0 THEN s WHEN s = 3 THEN CASE n % 2 WHEN 1 THEN 2 ELSE 3 END ELSE CASE n % 2 WHEN 1 THEN 3 ELSE 2 END END AS at,
  list_transform(range(n), lambda i: CASE WHEN (s = 3) = (i % 2 = 0) THEN 'assistant:' ELSE 'user:' END) AS lines FROM range(4) a(s), range(3) b(n)),
r AS (SELECT DISTINCT conv_id, 0::BIGINT AS k, 0 AS state, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS lines FROM f
  UNION ALL
  SELECT conv_id, k, state, cost, audit, lines FROM (
    SELECT r.conv_id, f.k, t.after AS state, r.cost + 3 * m.inserts + t.cost + CASE WHEN t.edit <> 'D' AND f.fault = 'truncated' THEN 3 ELSE 0 END AS cost, r.audit || repeat('I', m.inserts::BIGINT) || t.edit AS audit,
      r.lines || m.lines || CASE t.edit WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [t.role || ':' || f.text] END AS lines
    FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.k = r.k + 1 JOIN moves m ON m.state = r.state
    JOIN (SELECT s AS state, 'D' AS edit, s AS after, 4 AS cost, NULL AS due, NULL AS role FROM range(4) a(s)
      UNION ALL SELECT 0, 'K', 1, 0, 's', NULL UNION ALL SELECT s, 'K', 3, 0, 'u', NULL FROM range(3) a(s) UNION ALL SELECT 3, 'K', 2, 0, 'a', NULL
      UNION ALL SELECT s, 'R', 3, 3, NULL, 'user' FROM range(3) a(s) UNION ALL SELECT 3, 'R', 2, 3, NULL, 'assistant') t
    ON t.state = m.at AND (t.due IS NULL OR t.due = f.initial) AND (t.edit = 'D' OR f.fault NOT IN ('blank', 'duplicate')))
  QUALIFY row_number() OVER (PARTITION BY conv_id, k, state ORDER BY cost, audit) = 1),
z AS (SELECT r.conv_id, cost + CASE state WHEN 1 THEN 6 WHEN 3 THEN 3 ELSE 0 END AS cost, audit || CASE state WHEN 1 THEN 'II' WHEN 3 THEN 'I' ELSE '' END AS audit,
    lines || CASE state WHEN 1 THEN ['user:', 'assistant:'] WHEN 3 THEN ['assistant:'] ELSE []::VARCHAR[] END AS lines
  FROM r JOIN c ON c.conv_id IS NOT DISTINCT FROM r.conv_id AND r.k = c.last),
b AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM a.conv_id
"""

_SUMS = "count(*) FILTER (c = 1) AS n1, count(*) FILTER (c = 2) AS n2, count(*) FILTER (c = 3) AS n3, count(*) FILTER (c = 4) AS n4"
_DISCOUNTS = """SELECT *, n1::DOUBLE / (n1 + 2 * n2) AS y FROM {0}), {1} AS (SELECT *, n1 * n2 * n3 * n4 > 0 AND 1 - 2 * y * n2 / n1 BETWEEN 0 AND 1 AND 2 - 3 * y * n3 / n2 BETWEEN 0 AND 2 AND 3 - 4 * y * n4 / n3 BETWEEN 0 AND 3 AS fit FROM {1}0),
{1}d AS (SELECT *, CASE WHEN fit THEN 1 - 2 * y * n2 / n1 ELSE 0.5 END::DOUBLE AS d1, CASE WHEN fit THEN 2 - 3 * y * n3 / n2 ELSE 1 END::DOUBLE AS d2, CASE WHEN fit THEN 3 - 4 * y * n4 / n3 ELSE 1.5 END::DOUBLE AS d3 FROM {1}"""
_LESS = "CASE {0} WHEN 0 THEN 0 WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END"
LANGUAGE_MODEL = f"""
WITH t AS (SELECT doc_id, {_crc32("coalesce(doc_id::VARCHAR, '')")} % 7 = 2 AS held_out, list_append(regexp_extract_all({_lowered("text")}, '[^\x20\x09-\x0D]+'), chr(10)) AS w FROM documents),
k AS (SELECT doc_id, held_out, unnest(list_prepend(chr(9), w)[:len(w)]) AS v, unnest(w) AS w FROM t),
raw AS (SELECT w, count(*) AS c FROM k WHERE NOT held_out GROUP BY w),
tot AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS words FROM raw),
bi AS (SELECT v, w, count(*) AS c FROM k WHERE NOT held_out GROUP BY v, w),
uni AS (SELECT w, count(*) AS c FROM bi GROUP BY w),
ctx AS (SELECT v, sum(c) AS s, count(*) FILTER (c = 1) AS m1, count(*) FILTER (c = 2) AS m2, count(*) FILTER (c > 2) AS m3 FROM bi GROUP BY v),
b0 AS ({_DISCOUNTS.format(f"(SELECT {_SUMS} FROM bi)", "b")}),
u0 AS ({_DISCOUNTS.format(f"(SELECT sum(c) AS s, count(*) FILTER (c > 2) AS m3, {_SUMS} FROM uni)", "u")}),
low AS (SELECT w, ({{u}}) AS p FROM (SELECT DISTINCT w FROM k) LEFT JOIN (SELECT w, c FROM uni) USING (w), ud, tot),
p AS (SELECT k.doc_id, k.held_out, coalesce(raw.c, 0) AS c, log10((coalesce(raw.c, 0) + 1) / (n + words + 1)) AS base,
    log10(CASE WHEN s IS NULL THEN low.p ELSE (coalesce(bi.c, 0) - {_LESS.format("coalesce(bi.c, 0)")} + (d1 * m1 + d2 * m2 + d3 * m3) * low.p) / s END) AS full
  FROM k JOIN low ON low.w = k.w LEFT JOIN raw ON raw.w = k.w LEFT JOIN bi ON bi.v = k.v AND bi.w = k.w LEFT JOIN ctx ON ctx.v = k.v, bd, tot)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, (SELECT n FROM tot) AS train_tokens, round(fsum(base), 6) AS base_score, round(fsum("full"), 6) AS score FROM p GROUP BY doc_id, held_out
""".replace("{u}", f"(coalesce(c, 0) - {_LESS.format('coalesce(c, 0)')} + (d1 * n1 + d2 * n2 + d3 * m3) / (words + 1)) / s")

ORACLES: dict[str, str] = {
    "op1_secrets": SECRETS,
    "op4_licenses": LICENSES,
    "op6_source_mix": MIX,
    "op8_decontamination": DECONTAMINATION,
    "op9_perspectives": PERSPECTIVES,
    "op10_near_duplicates": NEAR_DUPLICATES,
    "op11_structure": STRUCTURE,
    "op13_language_model": LANGUAGE_MODEL,
}

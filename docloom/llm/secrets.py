"""Secret scans with an incremental blob ledger.

Every version of every path is content-addressed by SHA-256, once. The ledger has one
row for each blob: the rules (with their versions) that have been run on it and
the spans found. A scan takes one copy of each blob for which a rule is new,
runs the new rules only, adds rows to the ledger and joins findings back to all
paths and versions that hold the blob.

Spans count code points, end exclusive. A rule's matches are leftmost and don't
overlap; those that fail the rule's least length are dropped. Positions come
from the lengths of the pieces between matches.

Nulls and empties: null content is empty content. A null path or version is a
value of its own. Repeated rows get the same findings each. Further columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import materialize, small_or_none


@dataclass(frozen=True)
class Rule:
    """``least`` characters are asked for in the given group (0: the match); ``hint`` matches in every text with a match."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    version: int = 1
    hint: str | None = None

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: Rules whose patterns are fixed values; the order breaks ties.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 1),
    Rule("access", r"AKIA[A-Z0-9]+", 20, hint=r"AKIA[A-Z0-9]{16}"),
    Rule("hex", r"[0-9a-f]+", 24, hint=r"[0-9a-f]{24}"),
)
#: Further rules.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", r"\b(?:ghp|gho|ghs|glpat|xox[abp])[_-][A-Za-z0-9-]{16,}"),
)
SPAN = "array<struct<start:long,rank:int,kind:string,stop:long>>"


def address(content: Column) -> Column:
    return F.sha2(F.coalesce(content, F.lit("")), 256)


def _matches(blobs: DataFrame, rule: Rule, rank: int) -> DataFrame:
    """(blob, start, rank, kind, stop) of a rule on (blob, content, todo)."""
    pattern = F.lit(rule.pattern)
    rows = blobs.where(F.array_contains("todo", rule.name) & F.col("content").rlike(rule.hint or rule.pattern))
    pieces = F.transform(F.split("content", rule.pattern, -1), F.length)
    found = F.transform(F.regexp_extract_all("content", pattern, F.lit(0)), F.length)
    tested = F.transform(F.regexp_extract_all("content", pattern, F.lit(rule.group)), F.length) if rule.group else found
    each = rows.select("blob", F.posexplode(F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("gap"), found.alias("size"), tested.alias("tested"))).alias("k", "m"))
    along = Window.partitionBy("blob").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("m.gap") + F.col("m.size")).over(along)
    each = each.withColumn("stop", stop.cast("long")).where(F.col("m.tested") >= rule.least)
    return each.select("blob", (F.col("stop") - F.col("m.size")).alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), "stop")


def addresses(versions: DataFrame) -> DataFrame:
    """(path, version, blob, check) of versions (path, version, content), written once; check: a short hash that tells contents of one path and version apart."""
    content = F.coalesce("content", F.lit(""))
    return materialize(versions.select("path", "version", address(content).alias("blob"), F.xxhash64(content).alias("check")), "addresses")


def _merged(rows: DataFrame) -> DataFrame:
    """One row for each blob of a ledger's rows, of which each scan adds one for a blob that it was new for."""
    return rows.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("rules"), F.array_sort(F.flatten(F.collect_list("spans"))).cast(SPAN).alias("spans"))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = BASE + MORE, broadcast_blobs: int = 500_000, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Scan versions (path, version, content); return the new ledger and the findings.

    Ledger: (blob, rules, spans). What a scan adds is written as rows of its own; the old ones stay as they are.
    Findings: (path, version, blob, spans) for each row of versions, spans in order of start, then of the rules. Up to
    ``broadcast_blobs`` unseen blobs, which are counted, are broadcast; more are joined by a shuffle. Either way
    only unseen blobs' contents meet a rule. ``known``: the versions' ``addresses``, if they are there already.
    """
    known = addresses(versions) if known is None else known
    names = F.array(*[F.lit(r.name) for r in rules])
    copies = known.groupBy("blob").agg(F.min(F.struct("path", "version", "check")).alias("at")).select(F.col("blob").alias("_blob"), F.col("at.path").alias("_path"), F.col("at.version").alias("_version"), F.col("at.check").alias("_check"))
    if ledger is None:
        copies = copies.withColumn("todo", names)
    else:
        run = ledger.select(F.col("blob").alias("_blob"), F.col("rules").alias("_rules"))
        copies = copies.join(run, "_blob", "left").withColumn("todo", F.array_except(names, F.coalesce("_rules", F.array().cast("array<string>")))).where(F.size("todo") > 0).drop("_rules")
    copies = materialize(copies, "unseen")
    few = small_or_none(copies, broadcast_blobs)
    same = F.col("path").eqNullSafe(F.col("_path")) & F.col("version").eqNullSafe(F.col("_version"))
    # within a lambda, so that no part of it is tried on contents before the join
    asked = F.exists("todo", lambda t: reduce(lambda a, b: a | b, [(t == r.name) & F.col("content").rlike(r.hint or r.pattern) for r in rules]))
    once = versions.select("path", "version", F.coalesce("content", F.lit("")).alias("content"))
    if ledger is None and few is copies:  # all contents are unseen: the hints thin them out before they move
        once = once.where(reduce(lambda a, b: a | b, [F.col("content").rlike(r.hint or r.pattern) for r in rules]))
    once = once.join(few, same).where((F.xxhash64("content") == F.col("_check")) & asked)
    blobs = materialize(once.select(F.col("_blob").alias("blob"), "content", "todo").dropDuplicates(["blob"]), "blobs")  # repeated rows would give their blob twice
    found = reduce(DataFrame.unionByName, [_matches(blobs, r, k) for k, r in enumerate(rules)]).distinct()
    spans = found.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "stop"))).cast(SPAN).alias("spans"))
    new = copies.select(F.col("_blob").alias("blob"), F.col("todo").alias("rules")).join(spans, "blob", "left")
    new = materialize(new.withColumn("spans", F.coalesce("spans", F.array().cast(SPAN))), "ledger")
    every = new if ledger is None else ledger.select("blob", "rules", "spans").unionByName(new)
    hits = _merged(every.where(F.size("spans") > 0)).select("blob", "spans")
    out = known.select("path", "version", "blob").join(hits, "blob", "left")
    return _merged(every), out.select("path", "version", "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")

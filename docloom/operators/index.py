"""A stored search index that is kept up to date: segments of postings, tombstones, merges by size.

A folder holds ``postings/segment=N`` (term, doc_id, tf, in order of term), ``lengths/segment=N`` (doc_id, len),
``dead/update=V`` (segment, doc_id: what an update made void) and ``manifest/v=V``
(segment, level, n_docs, total, postings, dead: the live segments after update V). An update writes a
segment of the changed documents only, tombstones of what they replace, and a manifest; readers
take the last complete manifest, so a broken update leaves nothing but files that nobody reads, and
repeating it overwrites them. Segments of about one size are merged when there are ``fan`` of them, which
rewrites each posting once for each level: a logarithm of the corpus in all.

Null texts have no terms. Of several rows with one doc_id the greatest text counts; rows without doc_id are left
out. Deleting what isn't there changes nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.search import postings, query_terms, score, terms
from docloom.session import materialize, scratch

_POSTINGS = "term string, doc_id long, tf long, segment int"
_LENGTHS = "doc_id long, len long, segment int"
_DEAD = "segment int, doc_id long, update int"
_MANIFEST = "segment int, level int, n_docs long, total long, postings long, dead long"
#: So many ids of changed documents, or void rows, are broadcast; more are joined by a shuffle.
BROADCAST = 1_000_000


def _bounded(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST else df


@dataclass(frozen=True)
class Index:
    """An index's folder, with the number of the last complete update (0: none)."""

    spark: SparkSession
    folder: str

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last update whose manifest is complete."""
        path, fs = self._path("manifest")
        if not fs.exists(path):
            return 0
        names = [x.getPath() for x in fs.listStatus(path)]
        done = [int(p.getName()[2:]) for p in names if p.getName().startswith("v=") and fs.exists(self._path(f"manifest/{p.getName()}/_SUCCESS")[0])]
        return max(done, default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """(segment, level, n_docs, total, postings, dead): the live segments, a few rows for each level."""
        v = self.version() if version is None else version
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.folder}/manifest/v={v}") if v else self.spark.createDataFrame([], _MANIFEST)

    def _table(self, name: str, schema: str, segments: list[int]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.option("basePath", f"{self.folder}/{name}").schema(schema).parquet(*[f"{self.folder}/{name}/segment={k}" for k in segments])

    def _dead(self, segments: list[int], version: int) -> DataFrame:
        path, fs = self._path("dead")
        if not version or not segments or not fs.exists(path):
            return self.spark.createDataFrame([], "segment int, doc_id long")
        dead = self.spark.read.option("basePath", f"{self.folder}/dead").schema(_DEAD).parquet(f"{self.folder}/dead")
        return dead.where((F.col("update") <= version) & F.col("segment").isin(segments)).select("segment", "doc_id")

    def _live(self, name: str, schema: str, version: int, segments: list | None = None) -> DataFrame:
        rows = self.manifest(version).collect() if segments is None else segments
        own = self._table(name, schema, [r.segment for r in rows])
        void = [r.segment for r in rows if r.dead]
        if not void:
            return own
        return own.join(_bounded(self._dead(void, version), sum(r.dead for r in rows)), ["segment", "doc_id"], "left_anti")

    def postings(self, version: int | None = None) -> DataFrame:
        """(term, doc_id, tf) of the documents as they are now."""
        return self._live("postings", _POSTINGS, self.version() if version is None else version).select("term", "doc_id", "tf")

    def lengths(self, version: int | None = None) -> DataFrame:
        """(doc_id, len) of the documents as they are now."""
        return self._live("lengths", _LENGTHS, self.version() if version is None else version).select("doc_id", "len")

    def stats(self, version: int | None = None) -> tuple[int, float]:
        """How many documents there are, and their mean length."""
        n, total = self.manifest(version).agg(F.coalesce(F.sum(F.col("n_docs") - F.col("dead")), F.lit(0)), F.sum("total")).first()
        return n, (total or 0) / n if n else 0.0


def open_index(spark: SparkSession, folder: str | None = None) -> Index:
    """An index in a folder; a new one without."""
    return Index(spark, folder or scratch(spark, "segments"))


def _write_segment(index: Index, segment: int, post: DataFrame, lengths: DataFrame) -> None:
    post.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{index.folder}/postings/segment={segment}")
    lengths.write.mode("overwrite").parquet(f"{index.folder}/lengths/segment={segment}")


def _level(n: int, fan: int) -> int:
    return int(math.log(max(n, 1), fan) + 1e-9)


def update(index: Index, changed: DataFrame, deleted: DataFrame | None = None, fan: int = 4) -> Index:
    """Index changed documents (doc_id, text), new or not, and drop deleted ones (doc_id), then merge what is due.

    Reads the changed texts and the ids of indexed documents; of the postings only those that are merged.
    """
    spark, v = index.spark, index.version()
    rows = index.manifest(v).collect()
    changed = materialize(changed.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("text").alias("text")), "changed")
    new = (v + 1) << 8  # an update's segments have its number, so none is ever named again
    _write_segment(index, new, postings(changed), changed.select("doc_id", F.coalesce(F.size(terms(F.col("text"))), F.lit(0)).cast("long").alias("len")))

    gone = changed.select("doc_id")
    if deleted is not None:
        gone = materialize(gone.union(deleted.select(F.col("doc_id").cast("long"))).where("doc_id IS NOT NULL").distinct(), "gone")
    n_gone = gone.count()
    old = index._live("lengths", _LENGTHS, v, rows)
    void = materialize(old.join(_bounded(gone, n_gone), "doc_id", "left_semi").select("segment", "doc_id", "len"), "void")
    void.select("segment", "doc_id").write.mode("overwrite").parquet(f"{index.folder}/dead/update={v + 1}")
    lost = {r.segment: r for r in void.groupBy("segment").agg(F.count("*").alias("n"), F.sum("len").alias("total")).collect()}  # a row for each segment

    sizes = index._table("lengths", _LENGTHS, [new]).agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total")).first()
    n_postings = index._table("postings", _POSTINGS, [new]).count()
    live = [dict(segment=r.segment, level=r.level, n_docs=r.n_docs, total=r.total - (lost[r.segment].total if r.segment in lost else 0), postings=r.postings, dead=r.dead + (lost[r.segment].n if r.segment in lost else 0)) for r in rows]
    live.append(dict(segment=new, level=_level(n_postings, fan), n_docs=sizes.n, total=sizes.total, postings=n_postings, dead=0))
    live = _merged(index, [r for r in live if r["n_docs"] > r["dead"]], v + 1, new + 1, fan)
    schema = [c.split()[0] for c in _MANIFEST.split(", ")]
    spark.createDataFrame([tuple(r[c] for c in schema) for r in live], _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{index.folder}/manifest/v={v + 1}")
    return index


def _merged(index: Index, live: list[dict], version: int, free: int, fan: int) -> list[dict]:
    """Merge segments until no level has ``fan`` of them and none is mostly void."""
    while True:
        levels: dict[int, list[dict]] = {}
        for r in live:
            levels.setdefault(r["level"], []).append(r)
        due = next((x for _, x in sorted(levels.items()) if len(x) >= fan), None) or next(([r] for r in live if 2 * r["dead"] > r["n_docs"]), None)
        if not due:
            return live
        own = [SimpleNamespace(**r) for r in due]
        post = index._live("postings", _POSTINGS, version, own).drop("segment")
        _write_segment(index, free, post, index._live("lengths", _LENGTHS, version, own).drop("segment"))
        sizes = index._table("lengths", _LENGTHS, [free]).agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total")).first()
        n = index._table("postings", _POSTINGS, [free]).count()
        kept = [r for r in live if r not in due]
        live = [*kept, dict(segment=free, level=max(_level(n, fan), max(r["level"] for r in due) + (len(due) > 1)), n_docs=sizes.n, total=sizes.total, postings=n, dead=0)]
        free += 1


def bm25(index: Index, query: str, limit: int = 20) -> DataFrame:
    """(doc_id, score): the documents that have all words, the last as a prefix, best first; only the query's terms are read, in all live segments."""
    asked, spark, v = query_terms(query), index.spark, index.version()
    if not asked:
        return spark.createDataFrame([], "doc_id long, score double")
    stored, (n, mean) = index.postings(v), index.stats(v)
    found, counts = None, []
    for k, word in enumerate(asked):
        match = F.col("term").startswith(word) if k == len(asked) - 1 else F.col("term") == word
        own = stored.where(match).groupBy("doc_id").agg(F.sum("tf").cast("double").alias(f"f{k}"))
        counts.append(own.agg(F.count("*").cast("double").alias(f"df{k}")))
        found = own if found is None else found.join(own, "doc_id")
    both = counts[0]
    for c in counts[1:]:
        both = both.crossJoin(c)  # one row each
    rows = found.join(index.lengths(v), "doc_id").crossJoin(F.broadcast(both)).withColumns({"n": F.lit(float(n)), "avg": F.lit(mean)})
    return rows.select("doc_id", F.round(score(len(asked)), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(limit)


def follow(index: Index, files: DataFrame, seen: DataFrame, tolerance: float = 0.01) -> tuple[Index, DataFrame]:
    """Bring an index of files seen before (doc_id, mtime) up to files (doc_id, mtime, text); (index, (action, n)).

    What changed is told from ids and times alone; only changed files' texts are read after that.
    """
    was, now = seen.select("doc_id", F.col("mtime").alias("was")), files.select("doc_id", "mtime")
    action = F.when(F.col("mtime").isNull(), "delete").when(F.col("was").isNull(), "insert").when(F.abs(F.col("mtime") - F.col("was")) < tolerance, "skip").otherwise("update")
    told = materialize(was.join(now, "doc_id", "full").select("doc_id", action.alias("action")), "actions")
    todo = told.where("action IN ('insert', 'update')").select("doc_id")
    update(index, files.select("doc_id", "text").join(_bounded(todo, todo.count()), "doc_id", "left_semi"), told.where("action = 'delete'").select("doc_id"))
    return index, told.groupBy("action").agg(F.count("*").alias("n"))

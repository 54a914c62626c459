"""Search that keeps its comparisons: a document is tested against a criterion once, until it changes.

A comparison is (key, id, status, score, created, used): the digest of the criterion's canonical text, F for
a match and X for none, the match's score, when it was made and last used.  One is fresh while the
document's date isn't later than ``created`` and ``used`` is within ``keep``.  A search reads fresh
comparisons first; only the other documents are tokenised and tested, and their comparisons are added.

Rows are only ever appended, in folders by generation and key, and the latest of an id counts; ``purge``
writes the rows that are still in use into a new generation and deletes the older ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crivo.functions.tokens import let, with_tokens
from crivo.operators.criteria import Criterion, compile_criterion
from crivo.operators.session import LIMIT, cache_key, refine, start_session, term_score, unite

KEEP = "INTERVAL 180 DAYS"
RECENT = "INTERVAL 1 DAY"


@dataclass(frozen=True)
class CachedSearch:
    """Where comparisons with the documents of a type are kept; ids are unique, rows with a null id are left out."""

    path: str
    id_col: str = "doc_id"
    document: str = "text"
    date_col: str | None = None
    keep: str = KEEP

    def generation(self, spark: SparkSession) -> int:
        """The newest finished generation; 0 before the first purge."""
        root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        done = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/generation=*/_DONE")) or []
        return max((int(f.getPath().getParent().getName().split("=")[1]) for f in done), default=0)

    def rows(self, spark: SparkSession, key: str | None = None) -> DataFrame | None:
        """The latest comparison of each id with a criterion, or with all; None before the first search."""
        try:
            found = spark.read.parquet(f"{self.path}/generation={self.generation(spark)}")
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
                return None
            raise
        found = found if key is None else found.where(F.col("key") == key)
        last = F.max_by(F.struct("status", "score", "created"), "created").alias("z")
        return found.groupBy(F.col("key").cast("string").alias("key"), "id").agg(last, F.max("used").alias("used")).select("key", "id", "z.*", "used")

    def append(self, rows: DataFrame) -> None:
        rows.select("key", "id", "status", "score", "created", "used").write.mode("append").partitionBy("key").parquet(f"{self.path}/generation={self.generation(rows.sparkSession)}")

    def fresh(self, docs: DataFrame, key: str, now: Column) -> DataFrame | None:
        """Comparisons of ``docs`` with the criterion that still hold."""
        rows = self.rows(docs.sparkSession, key)
        if rows is None:
            return None
        date = F.col(self.date_col).cast("timestamp") if self.date_col else F.lit(None).cast("timestamp")
        dated = docs.select(F.col(self.id_col).alias("id"), date.alias("_date"))
        return rows.join(dated, "id").where((F.col("_date").isNull() | (F.col("_date") <= F.col("created"))) & (F.col("used") >= now - F.expr(self.keep))).drop("_date")

    def unsettled(self, docs: DataFrame, criterion: Criterion, now: Column) -> DataFrame:
        """Documents that have no fresh comparison: those that a search tokenises."""
        known = self.fresh(docs, cache_key(criterion), now)
        docs = docs.where(F.col(self.id_col).isNotNull())
        return docs if known is None else docs.join(known.select(F.col("id").alias(self.id_col)), self.id_col, "left_anti")

    def compared(self, docs: DataFrame, criterion: Criterion, now: Column) -> DataFrame:
        """New comparisons of ``docs``; a criterion of patterns has no score."""
        if criterion.kind == "dsl" and criterion.node is not None and not criterion.directives.any:
            tokens = with_tokens(docs, self.document)
            score = let(F.col("tok"), lambda x: F.when(criterion.maybe_on_tokens(x), F.when(criterion.on_tokens(x), term_score(x, criterion))))
            tested = tokens.select(F.col(self.id_col).alias("id"), F.explode_outer(F.array(score)).alias("score"))
        else:
            hit = F.when(criterion.on(F.col(self.document), docs.schema[self.document].dataType), F.lit(0).cast("long"))
            tested = docs.select(F.col(self.id_col).alias("id"), hit.alias("score"))
        status = F.when(F.col("score").isNotNull(), F.lit("F")).otherwise(F.lit("X"))
        return tested.select(F.lit(cache_key(criterion)).alias("key"), "id", status.alias("status"), "score", now.alias("created"), now.alias("used"))

    def search(self, docs: DataFrame, criterion: Criterion | str, now: Column | None = None, limit: int | None = LIMIT) -> DataFrame:
        """(id, score) of the best matches among ``docs``; what was compared for it is kept."""
        c = compile_criterion(criterion) if isinstance(criterion, str) else criterion
        if c.error:
            raise ValueError(c.error)
        now = F.current_timestamp() if now is None else now
        key = cache_key(c)
        # The new comparisons are written before anything is read again, so that no document is tested twice.
        self.append(self.compared(self.unsettled(docs, c, now), c, now))
        held = self.fresh(docs, key, now)
        self.touch(held, now)
        found = held.where("status = 'F'").select(F.col("id").alias(self.id_col), "score")
        return found if limit is None else found.orderBy(F.desc("score"), self.id_col).limit(limit)

    def touch(self, held: DataFrame, now: Column) -> None:
        """Note the use of comparisons whose last noted use is more than a day old."""
        old = held.where(F.col("used") < now - F.expr(RECENT))
        self.append(old.withColumn("used", now))

    def session(self, name: str, docs: DataFrame, criterion: Criterion | str, before: DataFrame | None = None, mode: str = "new", now: Column | None = None, limit: int = LIMIT) -> DataFrame:
        """The accepted documents of a session after a search: a new one, one more added, or one filtered by it."""
        found = self.search(docs, criterion, now, None if mode == "filter" else limit)
        if mode == "filter":
            kept = refine(before, found.select(F.col(self.id_col).alias("id")), limit)
            return kept.where("status = 'F'")
        added = start_session(name, found, self.id_col, "F")
        if mode not in ("new", "union"):
            raise ValueError(mode)
        return added if mode == "new" or before is None else unite(before, added)

    def purge(self, spark: SparkSession, now: Column) -> int:
        """Keep the comparisons used within ``keep``, one row each, in a new generation; its number."""
        rows, last = self.rows(spark), self.generation(spark)
        if rows is None:
            return last
        at = f"{self.path}/generation={last + 1}"
        rows.where(F.col("used") >= now - F.expr(self.keep)).write.mode("overwrite").partitionBy("key").parquet(at)
        path = spark._jvm.org.apache.hadoop.fs.Path
        files = path(at).getFileSystem(spark._jsc.hadoopConfiguration())
        files.createNewFile(path(f"{at}/_DONE"))
        files.delete(path(f"{self.path}/generation={last}"), True)
        return last + 1

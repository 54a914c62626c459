"""Corpus search: pre-search, refinement, sessions, caches and their upkeep.

Sessions are immutable tables: every step returns a new DataFrame, which the caller writes where it
wants.  Statuses: N new, I started, M matching, P pre-filtered, F accepted, X rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crivo.functions.tokens import let
from crivo.operators.criteria import Criterion, compile_criterion
from crivo.plans.arrays import matches
from crivo.plans.postings import fits_nothing, gathered
from crivo.plans.postings import search as postings_search
from crivo.plans.syntax import Blank, words_of

LIMIT = 1000
STATUS_ORDER = "NMP"


@dataclass(frozen=True)
class DocSource:
    """Where documents of a type live; names are checked against the table when it is read."""

    doc_type: str
    text_col: str = "text"
    id_col: str = "doc_id"
    date_col: str | None = None
    score_col: str | None = None
    json: bool = False

    def read(self, table: DataFrame) -> DataFrame:
        wanted = [c for c in (self.text_col, self.id_col, self.date_col, self.score_col) if c]
        missing = [c for c in wanted if c not in table.columns]
        if missing:
            raise ValueError(f"{self.doc_type}: no column {', '.join(missing)}")
        return table.withColumn(self.text_col, F.from_json(self.text_col, "map<string,string>")) if self.json else table


def term_score(tok: Column, criterion: Criterion) -> Column:
    """Summed frequency of the criterion's words in a document."""
    names = sorted({t.word for t in words_of(criterion.node) if not t.wild}) if criterion.node is not None else []
    return F.size(F.filter(tok, lambda x: x["w"].isin(*names))).cast("long") if names else F.lit(0).cast("long")


def pre_search(docs: DataFrame, criterion: Criterion, tok: str = "tok", limit: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """Documents whose words allow a match, with their score; the best ones if there is a limit."""
    score = let(F.col(tok), lambda x: F.when(criterion.maybe_on_tokens(x), term_score(x, criterion)))
    found = docs.select(*[c for c in docs.columns if c != tok], F.explode_outer(F.array(score)).alias("score")).where("score IS NOT NULL")
    return found if limit is None else found.orderBy(F.desc("score"), id_col).limit(limit)


def search(docs: DataFrame, criterion: Criterion | str, tok: str = "tok", id_col: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """(id, score) of the ``limit`` best matches: cheap condition, exact test and score on tokens bound once."""
    c = compile_criterion(criterion) if isinstance(criterion, str) else criterion
    score = let(F.col(tok), lambda x: F.when(c.maybe_on_tokens(x), F.when(c.on_tokens(x), term_score(x, c))))
    found = docs.select(id_col, F.explode_outer(F.array(score)).alias("score")).where("score IS NOT NULL")
    return found.orderBy(F.desc("score"), id_col).limit(limit)


def search_postings(postings: DataFrame, docs: DataFrame, criterion: Criterion | str, id_col: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """The same over stored postings."""
    c = compile_criterion(criterion) if isinstance(criterion, str) else criterion
    if c.node is not None and not isinstance(c.node, Blank) and not fits_nothing(c.node):
        held = gathered(c.node, postings, id_col, c.synonyms)
        found = held.where(matches(c.node, F.col("tok"), c.synonyms)).select(id_col, term_score(F.col("tok"), c).alias("score"))
    else:
        found = postings_search(c.node, postings, docs, id_col, c.synonyms).withColumn("score", F.lit(0).cast("long"))
        if c.node is not None and words_of(c.node):
            held = gathered(c.node, postings, id_col, c.synonyms).select(id_col, term_score(F.col("tok"), c).alias("held"))
            found = found.join(held, id_col, "left").select(id_col, F.coalesce("held", "score").alias("score"))
    return found.orderBy(F.desc("score"), id_col).limit(limit)


def start_session(session: str, found: DataFrame, id_col: str = "doc_id", status: str = "P") -> DataFrame:
    return found.select(F.lit(session).alias("session"), F.col(id_col).alias("id"), F.col("score").cast("double").alias("score"), F.lit(status).alias("status"))


def unite(session_docs: DataFrame, found: DataFrame) -> DataFrame:
    """Add documents that the session doesn't hold yet."""
    return session_docs.unionByName(found.join(session_docs.select("id"), "id", "left_anti").select(*session_docs.columns))


def narrow(session_docs: DataFrame, found: DataFrame) -> DataFrame:
    """Keep what is also found: P, the others X."""
    hits = found.select("id", F.lit(True).alias("_hit")).distinct()
    return session_docs.join(hits, "id", "left").withColumn("status", F.when(F.col("_hit"), F.lit("P")).otherwise(F.lit("X"))).select(*session_docs.columns)


def refine(session_docs: DataFrame, matched: DataFrame, limit: int | None = None) -> DataFrame:
    """Settle every document: F if it is in ``matched`` (id), X if not; with a limit the best matches only."""
    hits = matched.select("id", F.lit(True).alias("_hit")).distinct()
    out = session_docs.join(hits, "id", "left").withColumn("status", F.when(F.col("_hit"), F.lit("F")).otherwise(F.lit("X"))).select(*session_docs.columns)
    if limit is None:
        return out
    # A limit below the window leaves each task's first ``limit`` rows, so a large session isn't one task's work.
    best = Window.partitionBy("session").orderBy(F.desc("score"), "id")
    kept = out.where("status = 'F'").withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= limit).drop("_rank")
    return out.where("status <> 'F'").unionByName(kept)


def accepted(session_docs: DataFrame) -> DataFrame:
    return session_docs.where("status = 'F'")


def rollup(session_docs: DataFrame) -> DataFrame:
    """Counts of each session and the status it is in: the least advanced of N, M, P, else I or F."""
    order = F.when(F.instr(F.lit(STATUS_ORDER), F.col("status")) > 0, F.instr(F.lit(STATUS_ORDER), F.col("status"))).otherwise(F.lit(9))
    return session_docs.groupBy("session").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count_if(F.col("status") == "F").alias("n_accepted"),
        F.count_if(F.col("status") == "X").alias("n_removed"),
        F.min_by("status", order).alias("status"),
    )


def fresh(cache: DataFrame, docs: DataFrame, id_col: str = "id", date_col: str = "updated", cached_col: str = "created") -> DataFrame:
    """Cached rows that are not older than their documents."""
    return cache.join(docs.select(F.col(id_col), F.col(date_col).alias("_date")), id_col).where(F.col("_date").isNull() | (F.col("_date") <= F.col(cached_col))).drop("_date")


def stale(cache: DataFrame, docs: DataFrame, id_col: str = "id", date_col: str = "updated", cached_col: str = "created") -> DataFrame:
    """Documents without a fresh cached row, to be computed again."""
    return docs.join(fresh(cache, docs, id_col, date_col, cached_col).select(id_col), id_col, "left_anti")


def cache_key(criterion: Criterion) -> str:
    import hashlib

    return hashlib.sha1(criterion.canonical.encode()).hexdigest()


def digest(*parts: Column) -> Column:
    """Hex digest of a text, or of several joined by bars."""
    return F.sha1(F.concat_ws("|", *parts).cast("binary"))


def mini_digest(*parts: Column, step: int = 4) -> Column:
    """Every ``step``-th character of the digest."""
    return F.concat(*[F.substring(digest(*parts), k, 1) for k in range(1, 41, step)])


def touch(cache: DataFrame, now: Column, used_col: str = "used") -> DataFrame:
    """Set the time of use where it is more than a day old."""
    return cache.withColumn(used_col, F.when(F.col(used_col) < now - F.expr("INTERVAL 1 DAY"), now).otherwise(F.col(used_col)))


def touch_session(cache: DataFrame, session_docs: DataFrame, now: Column, used_col: str = "used") -> DataFrame:
    """``touch`` for the cached rows (id) whose documents are in a session (id); the others stay as they are."""
    held = session_docs.select("id", F.lit(True).alias("_held")).distinct()
    old = F.col("_held") & (F.col(used_col) < now - F.expr("INTERVAL 1 DAY"))
    return cache.join(held, "id", "left").withColumn(used_col, F.when(old, now).otherwise(F.col(used_col))).select(*cache.columns)


def purge(table: DataFrame, now: Column, keep: str = "INTERVAL 12 HOURS", time_col: str = "created") -> DataFrame:
    """Rows that have not outlived ``keep``."""
    return table.where(F.col(time_col) >= now - F.expr(keep))


def last_rows(log: DataFrame, n: int, time_col: str = "ts") -> DataFrame:
    """The newest ``n`` distinct rows of a log."""
    return log.distinct().orderBy(F.desc(time_col), *[c for c in log.columns if c != time_col]).limit(n)

"""Quality rules: counting rules plus a hashed n-gram log-likelihood ratio against trusted documents.

The model compares two multinomials over hashed one- and two-word features: one of the trusted
documents (labelled quality 1 and not toxic), one of the whole corpus, brought to the size of the trusted
counts and smoothed by the same pseudo-count, which is large enough that a small corpus' trusted documents
don't stand out by words of their own.  Toxicity is no verdict of this operator.  A document's score is the mean log ratio of its features; scores are
sums of integers, so they don't depend on the order of addition, and every document is decided by one
fixed threshold.  Counting and scoring are DataFrame expressions only.  The corpus counts cover every
document; what reaches the driver is one number for each of the ``BUCKETS`` features.

Defined cases: a null text counts as empty; an empty text has no words, fails the base rules and is
not kept; a null id is carried through; repeated rows are counted and decided each for itself; further
columns don't matter.  With no trusted documents the ratio is 0 for every feature, and only the base
rules decide.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crivo.llm._common import WORD_CLASS, words_of

BUCKETS = 1 << 15
PSEUDO_COUNT = 16.0
#: Mean natural-log ratio below which a document is rejected: halfway between the labelled test documents
#: of quality 1 (99 % above -0.02 on 1,000 and on 10,000 documents) and of quality 0 (99 % below -0.066).
THRESHOLD = -0.05
#: Log ratios are kept as integers of this many units.
UNITS = 1_000_000
WINDOW = 8


def let(value: Column, body) -> Column:
    """``body`` of ``value``, with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def repeated_words(hashes: Column) -> Column:
    """Words covered by 8-word windows that stand twice or more in the text, from the words' hashes."""

    def covered(windows: Column) -> Column:
        placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(p: Column) -> Column:
            last = F.size(p) - 1
            twice = F.filter(p, lambda x, i: (F.get(p, i - 1)["h"] == x["h"]) & (i > 0) | (F.get(p, i + 1)["h"] == x["h"]) & (i < last))
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        fold = F.aggregate(
            let(placed, starts),
            F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("total")),
            lambda s, p: F.struct(p.alias("last"), (s["total"] + F.least(F.lit(WINDOW), p - s["last"])).alias("total")),
            lambda s: s["total"],
        )
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(fold)

    def windows(h: Column) -> Column:
        return F.transform(F.slice(h, 1, F.size(h) - (WINDOW - 1)), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]))

    return F.when(F.size(hashes) < WINDOW + 1, F.lit(0).cast("long")).otherwise(let(windows(hashes), covered))


def features(hashes: Column) -> Column:
    """Hashed one- and two-word features of words' hashes, as bucket numbers from 0."""
    n = F.greatest(F.size(hashes) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, 2, n), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(BUCKETS)).cast("int"))
    return F.concat(F.transform(hashes, lambda a: F.pmod(a, F.lit(BUCKETS)).cast("int")), pairs)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[int]:
    """The log ratio of every bucket in 1/UNITS, from all documents and all trusted labels."""
    trusted = labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("trusted")).distinct()
    rows = docs.select(F.col(id_col).alias("doc"), let(hashed(words_of(F.coalesce(F.col(text_col).cast("string"), F.lit("")))), features).alias("f"))
    # Counts of the whole corpus come from the scan alone; only labelled texts take part in the join.
    count = lambda df, name: df.select(F.explode("f").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias(name))
    raw = {r["bucket"]: r["raw"] for r in count(rows, "raw").collect()}
    # Always a shuffle join: which side is small must not decide whether texts move.
    named = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("t")).hint("merge").join(trusted, F.col("doc") == F.col("trusted"), "left_semi")
    named = named.select(let(hashed(words_of(F.coalesce("t", F.lit("")))), features).alias("f"))
    target = {r["bucket"]: r["n"] for r in count(named, "n").collect()}
    n_raw, n_target = sum(raw.values()), sum(target.values())
    scale = n_target / n_raw if n_raw else 0.0
    return [round(UNITS * math.log((target.get(b, 0) + PSEUDO_COUNT) / (raw.get(b, 0) * scale + PSEUDO_COUNT))) for b in range(BUCKETS)]


def table_of(ratios: list[int]) -> Column:
    """The ratios as one constant array (folded once when the plan is made)."""
    return F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<bigint>")


def measures(text: Column, ratios: list[int], threshold: float) -> Column:
    """Counts, score and verdict of a text as one struct.

    Everything that is used twice is bound once, so that a filter on the verdict that the optimiser moves
    below other operators computes no part of it again.
    """
    table = table_of(ratios)

    def score(f: Column) -> Column:
        total = F.aggregate(f, F.lit(0).cast("long"), lambda s, b: s + F.get(table, b))
        return F.when(F.size(f) > 0, total / F.size(f) / F.lit(float(UNITS))).otherwise(F.lit(0.0))

    def counts(z: Column) -> Column:
        t, h = z["t"], z["h"]
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD_CLASS))
        return F.struct(
            F.size(h).cast("long").alias("n_words"),
            F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            repeated_words(h).alias("n_repeat_words"),
            let(features(h), score).alias("llr"),
        )

    def verdict(m: Column) -> Column:
        failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr")
        return F.struct(*[m[n].alias(n) for n in names], failed.alias("base_failed"), (~failed & (m["llr"] >= F.lit(threshold))).alias("kept"))

    plain = F.coalesce(text.cast("string"), F.lit(""))
    return let(F.struct(plain.alias("t"), hashed(words_of(plain)).alias("h")), lambda z: let(counts(z), verdict))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Id, counts, score and verdict of every row of ``docs``."""
    ratios = fit(docs, labels, id_col, text_col)
    judged = docs.select(F.col(id_col).alias("doc"), measures(F.col(text_col), ratios, threshold).alias("m"))
    return judged.select(F.col("doc").alias(id_col), "m.*")


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the rules keep."""
    return docs.where(measures(F.col(text_col), fit(docs, labels, id_col, text_col), threshold)["kept"])

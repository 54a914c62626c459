"""Filter interaction audit: what each of five filters removes at each place of every order they can stand in.

Words are exploded and counted by (document, word), then by document for totals and distinct words; the
other filters' flags meet those counts in an outer join.  A document is then one of 32 sets of failed
filters, and 32 conditional counts a part (with the labelled good and toxic ones apart) answer every
order: what a filter removes after others are the sets that hold it and none of the earlier ones.  Counts
are summed by part and set before they are pivoted, so a part of any size is no large group, and what
follows from them is a constant list of orders and steps exploded for each part.

Filters: A under ``MIN_WORDS`` words; B distinct words below ``DISTINCT_PERCENT`` % of words; C letters A-Z
above ``UPPER_PERCENT`` % of the characters; D holds one of ``SYMBOLS``; E equal to the text of a document
with a smaller id, whether that is removed or not.

Equal texts are known by 128 bits of hash.  Only texts that occur twice are looked up again, in a join
that is shuffled and left to Spark's skew handling.

Defined cases: a null text counts as empty and has no words, so it fails A; an empty text has as many
distinct words as words and fails neither B nor C; a null part counts as an empty string; rows that repeat
are documents each, counted alike and no copies of one another; a row with a null id is counted, has no
label and is no copy; several labels of an id count if one of them does; an empty table gives an empty
result; further columns don't matter.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crivo.llm._common import SPACE_CLASS

FILTERS = "ABCDE"
MIN_WORDS = 200
DISTINCT_PERCENT = 50
UPPER_PERCENT = 2
SYMBOLS = "#$%&*|"
SETS = 1 << len(FILTERS)
KINDS = ("n", "good", "toxic")


def word_totals(rows: DataFrame) -> DataFrame:
    """(key, low, total, words): words and distinct words of each (key, low, text), however often the row repeats.

    Every row adds one null word, so that rows without words are there and repetitions can be divided out.
    Words travel as 56 bits of hash: some two of a document's m distinct words share one with a chance of
    m squared in 2^57.
    """
    said = F.split("text", f"{SPACE_CLASS}+")
    exploded = rows.select("key", "low", F.explode(F.array_append(said, F.lit(None).cast("string"))).alias("word")).where("word IS NULL OR word <> ''")
    exploded = exploded.select("key", "low", F.when(F.col("word").isNotNull(), F.xxhash64("word").bitwiseAND(F.lit((1 << 56) - 1))).alias("word"))
    by_word = exploded.groupBy("key", "low", "word").agg(F.count(F.lit(1)).alias("n"))
    rows_alike = F.sum(F.when(F.col("word").isNull(), F.col("n")))
    by_doc = by_word.groupBy("key", "low").agg(F.coalesce(F.sum(F.when(F.col("word").isNotNull(), F.col("n"))), F.lit(0)).alias("said"), F.count("word").alias("words"), rows_alike.alias("rows"))
    return by_doc.select("key", "low", F.expr("said div rows").alias("total"), "words")


def copies(rows: DataFrame) -> DataFrame:
    """(h, h2, least): the smallest id of each text that several rows have."""
    return rows.groupBy("h", "h2").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("held")).where("held > 1 AND least IS NOT NULL").select("h", "h2", "least")


def failed_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc, part, failed): the filters that each document fails, as bits from A on."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    hashed = plain.withColumn("h", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(1), "text"))
    # Rows of one id that differ in their texts are told apart by 32 bits of hash, rows without an id by 96.
    keyed = hashed.withColumn("key", F.coalesce("doc", "h")).withColumn("low", F.col("h2").bitwiseAND(F.lit((1 << 32) - 1)))
    letters = F.regexp_count("text", F.lit("[A-Z]"))
    flags = keyed.select("doc", "part", "h", "h2", "key", "low", (100 * letters > UPPER_PERCENT * F.length("text")).alias("c"), F.col("text").rlike(f"[{SYMBOLS}]").alias("d"))
    first = copies(flags.select("doc", "h", "h2"))
    met = flags.hint("merge").join(first, ["h", "h2"], "left")
    counted = word_totals(keyed).withColumnsRenamed({"key": "of", "low": "of_low"})
    joined = met.join(counted.hint("merge"), (F.col("key") == F.col("of")) & (F.col("low") == F.col("of_low")), "full_outer")
    total, words = F.coalesce("total", F.lit(0)), F.coalesce("words", F.lit(0))
    tests = (total < MIN_WORDS, 100 * words < DISTINCT_PERCENT * total, F.col("c"), F.col("d"), F.coalesce(F.col("doc") > F.col("least"), F.lit(False)))
    bits = sum((F.when(test, F.lit(1 << k)).otherwise(F.lit(0)) for k, test in enumerate(tests)), F.lit(0))
    return joined.select("doc", "part", bits.alias("failed"))


def set_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, n_0 ... n_31, good_0 ..., toxic_0 ...): how many documents of a part fail exactly each set."""
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = failed.join(known.hint("merge"), F.col("doc") == F.col("labelled"), "left")
    # A row for each part and set at most; the 32 columns are made of these.
    few = marked.groupBy("part", "failed").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    return few.groupBy("part").agg(*[F.sum(F.when(F.col("failed") == s, F.col(kind)).otherwise(F.lit(0))).cast("long").alias(f"{kind}_{s}") for kind in KINDS for s in range(SETS)])


def over_sets(counts: Column, fits) -> Column:
    """Sum of the counts of the sets that fit."""
    held = F.filter(F.sequence(F.lit(0), F.lit(SETS - 1)), fits)
    return F.aggregate(held, F.lit(0).cast("long"), lambda total, s: total + F.get(counts, s))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``shapley`` sums what the step's filter removes over all orders, at whatever step: a document that
    fails k filters is removed by each of them in one k-th of the orders.
    """
    counts = set_counts(failed_sets(docs, id_col, text_col, part_col), labels)
    packed = counts.select("part", *[F.array(*[f"{kind}_{s}" for s in range(SETS)]).alias(kind) for kind in KINDS])
    orders = ["".join(order) for order in permutations(FILTERS)]
    ordered = packed.withColumn("filter_order", F.explode(F.split(F.lit(" ".join(orders)), " ")))
    placed = ordered.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = lambda k: F.expr(f"shiftleft(1, instr('{FILTERS}', substr(filter_order, {k}, 1)) - 1)")
    earlier = sum((F.when(F.col("step") > k, bit(k)).otherwise(F.lit(0)) for k in range(1, len(FILTERS))), F.lit(0))
    z = placed.withColumn("own", bit("step")).withColumn("before", earlier)
    own, before = F.col("own"), F.col("before")
    here = lambda s: (s.bitwiseAND(own) != 0) & (s.bitwiseAND(before) == 0)
    shapley = F.aggregate(
        F.filter(F.sequence(F.lit(1), F.lit(SETS - 1)), lambda s: s.bitwiseAND(own) != 0),
        F.lit(0).cast("long"),
        lambda total, s: total + F.get("n", s) * (F.lit(len(orders)) / F.bit_count(s)).cast("long"),
    )
    return z.select(
        "part",
        "filter_order",
        "step",
        over_sets(F.col("n"), lambda s: s.bitwiseAND(before.bitwiseOR(own)) == 0).alias("kept"),
        over_sets(F.col("n"), here).alias("removed"),
        over_sets(F.col("n"), lambda s: (s.bitwiseAND(own) != 0) & (s.bitwiseAND(before) != 0)).alias("redundant"),
        over_sets(F.col("n"), lambda s: s == own).alias("unique_fails"),
        over_sets(F.col("good"), here).alias("good_lost"),
        over_sets(F.col("toxic"), here).alias("toxic_lost"),
        shapley.alias("shapley"),
    )

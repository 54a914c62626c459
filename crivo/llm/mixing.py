"""Temperature mixing: how often each source is read, and in which order.

A source's share of all tokens, raised to an exponent and normalised, is its weight in the mixture; its
budget is the weight times the tokens of the mixture.  The exponent is bisected: for a target entropy, to
the exponent whose weights have it (above 1 where the sources' own entropy is larger); for a repetition
limit alone, to the smallest (flattest) exponent at which no source is read more often than the limit.
Where both are given the exponent is that of the entropy; a limit or an entropy that can't be met raises
ValueError.  Without ``budget_tokens`` the mixture is as long as it takes to read every source once.

A budget is realised as permutations of blocks: each pass over a source deals its documents into blocks by
a seeded hash, the blocks follow one another in the order of their numbers, and the documents of a block
in the order of their hashes.  The last pass stops where the budget is reached; documents are not cut.

Tokens are those of the given vocabulary, counted once in Arrow batches and written with the rows (bytes,
where no vocabulary is given).  Per-source sums, the search and the running sums are DataFrame aggregates.
A running sum is taken in a block (about ``BLOCK_TOKENS`` tokens), over the blocks of a strip of 1024 and
over strips, and rows are dealt by a number of their own, so a source or an id that holds a third of all
rows is still dealt over as many tasks as it has blocks.

Defined cases: a null text counts as empty; a document without tokens takes no budget: it is read once in
every full pass; a source without any tokens is read once; a null source is a source of its own; null ids
and repeated rows are documents like any other; a single source has no entropy to meet and keeps its
share; an empty table gives an empty result; further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crivo.llm._common import cut
from crivo.llm.packing import Encoder

BLOCK_TOKENS = 1 << 18
STRIP = 1024
#: Interior points evaluated at once: one round settles five bisections.
POINTS = 31
ROUNDS = 8
#: Largest exponent that is tried for a target entropy.
STEEPEST = 8.0


def counted(rows: DataFrame, text: str, vocabulary: str | None, ranks: str | None) -> DataFrame:
    """``rows`` with n_tokens in place of the column ``text``."""
    if vocabulary is None:
        return rows.withColumn("n_tokens", F.coalesce(F.octet_length(text), F.lit(0)).cast("long")).drop(text)
    kept = rows.drop(text)
    names = kept.columns

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode = Encoder(vocabulary, ranks)
        for batch in batches:
            sizes = pa.array([len(encode(t.as_py() or "")) for t in batch.column(text)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), sizes], names=[*names, "n_tokens"])

    return rows.mapInArrow(run, kept.withColumn("n_tokens", F.lit(0).cast("long")).schema)


def temperature_weights(totals: DataFrame, budget: int | None = None, max_repeats: float | None = None, target_entropy: float | None = None) -> tuple[DataFrame, float, float]:
    """Weights of (source, tokens) rows, the exponent found and the tokens of the mixture.

    ``target_entropy`` is a fraction of the largest possible entropy, that of equal weights.
    """
    facts = totals.where("tokens > 0").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all"), F.count(F.lit(1)).alias("n")).first()
    everything, n = facts["all"] or 1, facts["n"]
    shares = cut(totals.where("tokens > 0").select("source", "tokens", (F.col("tokens") / F.lit(everything)).alias("share")), "shares")

    def measured(exponents: list[float]) -> list[tuple[float, float, float]]:
        """(norm, entropy, repeats of the source read most often) at each exponent."""
        asked = []
        for k, a in enumerate(exponents):
            power = F.pow("share", F.lit(a))
            asked += [F.sum(power).alias(f"z{k}"), F.sum(power * F.log("share")).alias(f"y{k}"), F.max(power / F.col("share")).alias(f"r{k}"), F.max(F.col("share") / power).alias(f"c{k}")]
        row = shares.agg(*asked).first()
        out = []
        for k, a in enumerate(exponents):
            z = row[f"z{k}"]
            longest = budget / everything if budget is not None else z * row[f"c{k}"]
            out.append((z, log(z) - a * row[f"y{k}"] / z, row[f"r{k}"] / z * longest))
        return out

    def smallest(low: float, high: float, fits) -> float:
        """The smallest exponent in the range that fits, given that the highest one does."""
        if fits(measured([low])[0]):
            return low
        if not fits(measured([high])[0]):
            raise ValueError("no exponent meets the target entropy or the repetition limit")
        for _ in range(ROUNDS):
            points = [low + (high - low) * (k + 1) / (POINTS + 1) for k in range(POINTS)]
            good = [fits(x) for x in measured(points)]
            first = good.index(True) if True in good else POINTS
            low, high = (points[first - 1] if first else low), (points[first] if first < POINTS else high)
        return high

    # Sums of doubles differ in their last digits, so limits are met within a small part.
    within = lambda x: max_repeats is None or x[2] <= max_repeats * (1 + 1e-9)
    exponent = 1.0
    if n > 1 and target_entropy is not None:
        exponent = smallest(0.0, STEEPEST, lambda x: x[1] <= target_entropy * log(n) + 1e-12)
    elif n > 1 and max_repeats is not None:
        exponent = smallest(0.0, 1.0, within)
    norm, _, repeats = measured([exponent])[0] if n else (1.0, 0.0, 1.0)
    if not within((norm, 0.0, repeats)):
        raise ValueError(f"a source would be read {repeats:.3f} times, the limit is {max_repeats}")
    longest = budget if budget is not None else everything * norm * (shares.agg(F.max(F.col("share") / F.pow("share", F.lit(exponent)))).first()[0] or 0.0)
    return shares.select("source", "tokens", (F.pow("share", F.lit(exponent)) / F.lit(norm)).alias("weight")), exponent, float(longest)


def mix_sources(docs: DataFrame, vocabulary: str | None = None, ranks: str | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", budget_tokens: int | None = None, max_repeats: float | None = None, target_entropy: float | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each reading of a document: id, source, pass_no, block, n_tokens, weight (the
    source's), at (tokens of the source read before it) and order_key (that, as a fraction of the source's
    budget: sorting by it interleaves the sources by weight), with the columns named in ``keep``."""
    wanted = list(dict.fromkeys([id_col, source_col, *keep]))
    inner = {c: f"m_{k}" for k, c in enumerate(wanted)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in inner.items()], F.col(f"`{text_col}`").cast("string").alias("m_text"))
    key = F.struct(F.col(inner[source_col]).isNull().alias("none"), F.coalesce(F.col(inner[source_col]).cast("string"), F.lit("")).alias("name"))
    rows = cut(counted(rows, "m_text", vocabulary, ranks).withColumn("source_key", F.to_json(key)).withColumn("row", F.monotonically_increasing_id()), "counted")
    totals = cut(rows.groupBy(F.col("source_key").alias("source")).agg(F.sum("n_tokens").alias("tokens")), "sources")
    weights, _, longest = temperature_weights(totals, budget_tokens, max_repeats, target_entropy)
    budget = F.round(F.col("weight") * F.lit(longest)).cast("long")
    budget = F.greatest(budget, "tokens") if budget_tokens is None else budget
    plan = cut(totals.join(weights.select("source", "weight"), "source", "left").select(F.col("source").alias("source_key"), F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce(budget, F.lit(0)).alias("budget"), F.col("tokens").alias("total")), "plan")
    passes = F.when(F.col("total") > 0, F.ceil(F.col("budget") / F.greatest("total", F.lit(1)))).otherwise(F.lit(1)).cast("int")
    dealt = rows.join(plan, "source_key").where("budget > 0 OR total = 0").select("*", F.explode(F.sequence(F.lit(1), passes)).alias("pass_no"))
    n_blocks = F.greatest(F.ceil(F.col("total") / F.lit(block_tokens)), F.lit(1))
    where = F.xxhash64(F.lit(seed), "source_key", "pass_no", inner[id_col], "row")
    dealt = dealt.withColumn("rank_hash", F.xxhash64(where, F.lit(1))).withColumn("block", F.pmod(where, n_blocks))
    sums = cut(dealt.groupBy("source_key", "pass_no", "block").agg(F.sum("n_tokens").alias("tokens")).withColumn("strip", F.floor(F.col("block") / STRIP)), "blocks")
    strips = sums.groupBy("source_key", "pass_no", "strip").agg(F.sum("tokens").alias("tokens"))
    before = lambda order, *by: F.coalesce(F.sum("tokens").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    strips = strips.withColumn("strip_at", before("strip", "source_key", "pass_no")).drop("tokens")
    starts = sums.withColumn("in_strip", before("block", "source_key", "pass_no", "strip")).join(strips, ["source_key", "pass_no", "strip"])
    starts = starts.select("source_key", "pass_no", "block", (F.col("in_strip") + F.col("strip_at")).alias("block_at"))
    in_block = Window.partitionBy("source_key", "pass_no", "block").orderBy("rank_hash", "row").rowsBetween(Window.unboundedPreceding, -1)
    read = dealt.withColumn("doc_at", F.coalesce(F.sum("n_tokens").over(in_block), F.lit(0))).join(starts, ["source_key", "pass_no", "block"])
    read = read.withColumn("at", (F.col("pass_no") - 1) * F.col("total") + F.col("block_at") + F.col("doc_at"))
    full = F.col("pass_no") * F.col("total") <= F.col("budget")
    chosen = read.where(full | ((F.col("n_tokens") > 0) & (F.col("at") < F.col("budget"))))
    order_key = F.when(F.col("budget") > 0, F.col("at") / F.greatest("budget", F.lit(1))).otherwise(F.lit(0.0))
    return chosen.select(*[F.col(n).alias(c) for c, n in inner.items()], "pass_no", "block", "n_tokens", "weight", "at", order_key.alias("order_key"))

"""N-gram Jaccard self-join of texts with Bayesian pruning of candidates.

Similarity is the Jaccard coefficient of the sets of five-word shingles.  Candidates come from MinHash
bands (20 of 4 values: a pair at 0.8 is missed with a chance of 3e-5); their MinHash values are compared
eight at a time, pairs whose posterior chance of reaching the threshold falls below the tolerance are
dropped, and all others are verified on their whole sets.

Defined cases: a text of one to four words has one shingle, all its words; a null text, and one without
words, has none and links with nothing, its class is its own id.  A row whose id is null gets a null
class and no links.  Repeated rows are copies of one another: every input row has its own output row.
Only the id and the text are read, so further columns of any name don't matter.  An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crivo.llm._common import SHINGLE_WORDS, cut
from crivo.llm.near_sets import TILE_SHINGLES, hashed, near_links, representatives

BANDS, ROWS = 20, 4


def described(texts: DataFrame, bands: int, rows: int, size: int) -> DataFrame:
    """(doc, k1, k2, n, bands) of (doc, text) rows."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for a, b, k1, k2, n, keys in hashed(batch.column(1), bands, rows, size):
                lists = pa.ListArray.from_arrays(pa.array(range(0, keys.size + 1, bands), pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(k1), pa.array(k2), pa.array(n.astype("int32")), lists], names=["doc", "k1", "k2", "n", "bands"])

    return texts.mapInArrow(run, "doc long, k1 long, k2 long, n int, bands array<long>")


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, size: int = SHINGLE_WORDS, bands: int = BANDS, rows: int = ROWS, tolerance: float = 1e-6, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """One row for each row of ``docs``: id, class_id (smallest id reachable over links, own id included),
    copy_of (smallest id with the same shingle set), n_links (other rows at the threshold or above)."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    sets = cut(described(plain, bands, rows, size), "sets")
    reps = cut(representatives(sets.where("doc IS NOT NULL"), "doc"), "reps")

    def with_text(members: DataFrame) -> DataFrame:
        # Always a shuffle join: which side is small must not decide whether texts move.
        return members.join(plain.withColumnRenamed("doc", "first").hint("merge"), "first")

    linked = near_links(reps, with_text, threshold=threshold, bands=bands, rows=rows, tolerance=tolerance, tile_shingles=tile_shingles, size=size)
    found = reps.select("id", "k2", "copies", F.col("first").alias("copy_of")).join(linked, "id", "left").select("id", "k2", "copies", "copy_of", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "id").alias("root"))
    found = cut(found, "classes")
    least = found.groupBy("root").agg(F.min("copy_of").alias("least"))
    classes = found.join(least, "root").select(F.col("id").alias("k1"), "k2", "copy_of", F.col("least").alias("class"), (F.col("links") + F.col("copies") - 1).alias("links"))
    # Rows without words or id have no class to look up, so they stay out of the join, which they would skew.
    compared = F.col("doc").isNotNull() & (F.col("n") > 0)
    linked = sets.where(compared).select("doc", "k1", "k2").join(classes, ["k1", "k2"])
    alone = sets.where(~compared)
    return linked.select(F.col("doc").alias(id_col), F.col("class").alias("class_id"), "copy_of", F.col("links").cast("long").alias("n_links")).unionByName(
        alone.select(F.col("doc").alias(id_col), F.col("doc").alias("class_id"), F.col("doc").alias("copy_of"), F.lit(0).cast("long").alias("n_links"))
    )


def one_of_each(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is its class's smallest, one row an id; rows without an id stay."""
    kept = classes.where(F.col(id_col).isNotNull() & (F.col(id_col) == F.col("class_id"))).select(id_col).distinct()
    named = docs.where(F.col(id_col).isNotNull()).join(kept, id_col, "left_semi").dropDuplicates([id_col])
    return named.unionByName(docs.where(F.col(id_col).isNull())).select(*docs.columns)

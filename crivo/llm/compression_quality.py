"""Quality classifier by compression: two zstandard dictionaries, of good and of bad text, judge every text.

A text is cut into chunks of ``CHUNK_BYTES``, each is compressed with either dictionary, and the sizes are
summed over the whole text: which dictionary helps more is the normalised difference of the two sums.
Short chunks keep the dictionaries' part large however long the text is.  A logistic curve over that
difference and the text's squeeze (log of its smaller sum over its bytes, where that is below
``SQUEEZED``: text that repeats itself is small with any dictionary) makes the score.

Fitting is bounded and the same at every size: ``SAMPLE_DOCS`` labelled documents of each class, first by a
hash of their ids, and of their distinct chunks ``SAMPLE_CHUNKS`` of each class, first by a hash of their
content, make the dictionaries of ``DICTIONARY_BYTES``.  The curve is fitted on the same documents, each
measured with dictionaries that were made without its fold.  Everything but the fit reads every document
in full, in one pass without a shuffle.

Defined cases: a null text counts as empty; an empty text has a difference of 0 and no squeeze, and gets
the curve's score for these; a null id is carried through and not held out; rows that repeat are scored
alike; a label that is neither 0 nor 1, or without an id, is none, and of several labels of an id the
larger counts; with labels of one class, or of none, every text has the share of good labels, smoothed by
one of each; an empty table gives an empty result; further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crivo.llm._common import cut, release

CHUNK_BYTES = 512
DICTIONARY_BYTES = 256 << 10
LEVEL = 3
SAMPLE_DOCS = 4000
SAMPLE_CHUNKS = 16_000
FOLDS = 3
SQUEEZED = -1.5
THRESHOLD = 0.7
#: Weight of the curve's ridge penalty, in documents.
RIDGE = 0.1


def held_out(id_col: Column) -> Column:
    """Whether a document may not be learned from: the remainder 2 of the checksum of its id by 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def chunks_of(text: bytes) -> list[bytes]:
    return [text[k : k + CHUNK_BYTES] for k in range(0, len(text), CHUNK_BYTES)]


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of the samples; where they are too few to train one, the samples themselves."""
    import zstandard

    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, total // 2)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


class Measure:
    """Compressors of both classes: (difference, squeeze) of a text."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        import zstandard

        self.by = []
        for data in (good, bad):
            made = zstandard.ZstdCompressionDict(data)
            made.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_checksum=False, write_content_size=False, write_dict_id=False))

    def __call__(self, text: bytes) -> tuple[float, float]:
        if not text:
            return 0.0, 0.0
        good, bad = self.by
        a = b = 0
        for at in range(0, len(text), CHUNK_BYTES):
            chunk = text[at : at + CHUNK_BYTES]
            a += len(good.compress(chunk))
            b += len(bad.compress(chunk))
        return (b - a) / (a + b), min(0.0, float(np.log(min(a, b) / len(text))) - SQUEEZED)


@dataclass(frozen=True)
class Curve:
    """Weights of the difference, of the squeeze, and of one; the measures' means and spreads."""

    weights: tuple[float, float, float]
    mean: tuple[float, float] = (0.0, 0.0)
    spread: tuple[float, float] = (1.0, 1.0)

    def __call__(self, difference: float, squeeze: float) -> float:
        x = self.weights[2]
        for value, weight, mean, spread in zip((difference, squeeze), self.weights, self.mean, self.spread, strict=False):
            x += weight * (value - mean) / spread
        return float(1 / (1 + np.exp(-max(-40.0, min(40.0, x)))))


def fitted(x: np.ndarray, y: np.ndarray) -> Curve:
    """The logistic curve of most likelihood under a ridge penalty, by damped Newton steps."""
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread = np.where(spread > 0, spread, 1.0)
    z = np.concatenate(((x - mean) / spread, np.ones((len(x), 1))), axis=1)
    ridge = RIDGE * np.array([1.0, 1.0, 0.0])

    def loss(w: np.ndarray) -> float:
        t = z @ w
        return float(np.logaddexp(0, t).sum() - (y * t).sum() + (ridge * w * w).sum() / 2)

    w = np.array([0.0, 0.0, np.log((y.sum() + 1) / (len(y) - y.sum() + 1))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        slope = z.T @ (p - y) + ridge * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-9), slope)
        size, before = 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > before:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return Curve(tuple(map(float, w)), tuple(map(float, mean)), tuple(map(float, spread)))


def sampled_labels(labels: DataFrame) -> DataFrame:
    """(doc, good, fold): at most ``SAMPLE_DOCS`` labelled ids of each class that may be learned from."""
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out(F.col("doc_id")))
    by_id = known.groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.max("quality").cast("int").alias("good"))
    rank = F.xxhash64(F.lit(13), "doc")
    few = [by_id.where(F.col("good") == q).orderBy(rank, "doc").limit(SAMPLE_DOCS) for q in (0, 1)]
    return few[0].unionByName(few[1]).withColumn("fold", F.pmod(F.xxhash64(F.lit(7), "doc"), F.lit(FOLDS)).cast("int"))


def sampled_chunks(sample: DataFrame) -> dict[int, list[tuple[int, bytes]]]:
    """By class: (fold, chunk) of distinct chunks, at most ``SAMPLE_CHUNKS``, in the order of their hashes."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            good, fold, text = (batch.column(k) for k in range(3))
            for g, f, t in zip(good, fold, text, strict=True):
                parts = chunks_of(t.as_buffer().to_pybytes() if t.is_valid else b"")
                for at in range(0, len(parts), 10_000):
                    some = parts[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([g.as_py()] * len(some), pa.int32()), pa.array([f.as_py()] * len(some), pa.int32()), pa.array(some, pa.binary())], names=["good", "fold", "chunk"])

    cut_up = sample.select("good", "fold", "text").mapInArrow(run, "good int, fold int, chunk binary")
    distinct = cut_up.groupBy("good", "chunk").agg(F.min("fold").alias("fold"))
    out = {}
    for q in (0, 1):
        rows = distinct.where(F.col("good") == q).orderBy(F.xxhash64("chunk"), "chunk").limit(SAMPLE_CHUNKS).select("fold", "chunk").collect()
        out[q] = [(r["fold"], bytes(r["chunk"])) for r in rows]
    return out


def measured(rows: DataFrame, made: list[tuple[bytes, bytes]]) -> np.ndarray:
    """(good, difference, squeeze) of sampled documents, each by the dictionaries made without its fold."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        by_fold: dict[int, Measure] = {}
        for batch in batches:
            found = []
            for fold, text in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                if fold not in by_fold:
                    by_fold[fold] = Measure(*made[fold])
                found.append(by_fold[fold](text.as_buffer().to_pybytes() if text.is_valid else b""))
            d, s = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(d, pa.float64()), pa.array(s, pa.float64())], names=["good", "difference", "squeeze"])

    got = rows.select("good", "fold", "text").mapInArrow(run, "good int, difference double, squeeze double").toPandas()
    # The sums of the fit don't depend on the order in which tasks end.
    return got.sort_values(["good", "difference", "squeeze"]).to_numpy(np.float64)


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    curve: Curve


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    chosen = sampled_labels(labels)
    plain = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    # At most 2 * SAMPLE_DOCS ids: so small a side is broadcast, and no text is shuffled.
    sample = cut(plain.join(F.broadcast(chosen), "doc"), "labelled")
    parts = sampled_chunks(sample)
    if not parts[0] or not parts[1]:
        n = {r["good"]: r["n"] for r in sample.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
        release(sample)
        return Model(b"", b"", Curve((0.0, 0.0, float(np.log((n.get(1, 0) + 1) / (n.get(0, 0) + 1))))))
    of = lambda q, fold: dictionary([c for f, c in parts[q] if f != fold] or [c for _, c in parts[q]])
    x = measured(sample, [(of(1, k), of(0, k)) for k in range(FOLDS)])
    release(sample)
    return Model(of(1, -1), of(0, -1), fitted(x[:, 1:], x[:, 0]))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: id, held_out, score, predicted, and the measures difference and squeeze."""
    model = fit(docs, labels, id_col, text_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        measure = Measure(model.good, model.bad)
        for batch in batches:
            found = [measure(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(2)]
            scores = [model.curve(*x) for x in found]
            d, s = zip(*found, strict=True) if found else ((), ())
            columns = [pa.array(scores, pa.float64()), pa.array([int(x >= threshold) for x in scores], pa.int32()), pa.array(d, pa.float64()), pa.array(s, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc", "held", "score", "predicted", "difference", "squeeze"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc"), held_out(F.col(id_col)).alias("held"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(run, f"doc {kind}, held boolean, score double, predicted int, difference double, squeeze double")
    return scored.withColumnsRenamed({"doc": id_col, "held": "held_out"})

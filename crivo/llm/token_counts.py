"""Token counts of whole texts, without the tokens: Arrow batches in, lengths out, no shuffle.

Texts are taken from a batch in groups of about ``GROUP_BYTES`` bytes, so that a group of long texts holds
few of them.  A text above ``SPLIT_BYTES`` is cut at safe places and its parts are counted like texts of their
own: a single space between two characters that are neither spaces nor the library's own space mark.
No vocabulary entry has such a mark after another character, so no merge reaches over the cut, and the
space comes back as the mark that the library puts before every text.  Both facts are verified on the
vocabulary when a worker loads it; where one fails, texts are encoded whole.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); a null id is carried through; rows that
repeat are counted each; further columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crivo.llm._common import chunks, string_buffers

GROUP_BYTES = 1 << 20
SPLIT_BYTES = 1 << 16
LIMIT = 4096
MARK = "▁"


class PieceCounter:
    """Counts the pieces of texts with one loaded model."""

    def __init__(self, model_file: str, split_bytes: int = SPLIT_BYTES) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        whole = any(MARK in p.lstrip(MARK) for p in pieces)
        probe = ["b c", "bb  cc dd", "x\ny z"]
        joined = all(len(self.model.encode(p)) == len(self.model.encode(p[: p.rindex(" ")])) + len(self.model.encode(p[p.rindex(" ") + 1 :])) for p in probe)
        self.split = split_bytes if not whole and joined else 0

    def parts(self, text: str) -> list[str]:
        if not self.split or len(text) <= self.split:
            return [text]
        out, start = [], 0
        while len(text) - start > self.split:
            at = text.find(" ", start + self.split // 2)
            while at >= 0 and (at + 1 >= len(text) or text[at - 1] in (" ", MARK) or text[at + 1] in (" ", MARK)):
                at = text.find(" ", at + 1)
            if at < 0:
                break
            out.append(text[start:at])
            start = at + 1
        return [*out, text[start:]]

    def counts(self, texts: list[str]) -> list[int]:
        """Number of pieces of each text."""
        parts, owner = [], []
        for k, text in enumerate(texts):
            some = self.parts(text)
            parts += some
            owner += [k] * len(some)
        total = [0] * len(texts)
        at = 0
        while at < len(parts):
            # Short texts go in together; the parts of a long one a few at a time.
            upto, size = at + 1, len(parts[at].encode())
            while upto < len(parts) and size < GROUP_BYTES:
                size += len(parts[upto].encode())
                upto += 1
            for k, ids in zip(owner[at:upto], self.model.encode(parts[at:upto], num_threads=1), strict=True):
                total[k] += len(ids)
            at = upto
        return total


def token_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        counter = PieceCounter(model_file, split_bytes)
        for batch in batches:
            texts = batch.column(1)
            texts = texts.fill_null("") if texts.null_count else texts
            _, offsets = string_buffers(texts)
            for a, b in chunks(offsets, GROUP_BYTES):
                some = texts.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pc.binary_length(some).cast("int64"), pa.array(counter.counts(some.to_pylist()), pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    plain = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text_"))
    return plain.mapInArrow(run, f"`{id_col}` long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)

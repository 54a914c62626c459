"""Language-model scores from a subword lattice: the marginal probability of whole texts.

A text is drawn token by token: a word, or the end of the text.  A word's lattice has one arc for each
piece of an existing vocabulary at each place where it fits, weighted by the piece's unigram score; a
character that is no piece has an arc over its bytes; the lattice of a word seen in training has one more
arc, the whole word.  A word's probability is the sum over all paths, found by a forward recursion in log
space, and a text's is the product over its words and its end, since every path passes the words' bounds.

Pieces that open a word carry the vocabulary's mark and others don't, so the draws of pieces up to the
next marked one are a word: the spelled words share one unit of probability (or less, where bytes make no
characters).  Whole-word arcs weigh (count - D) / N, and what the discount D takes, D * V / N, is the
weight of the spelled paths.  D is estimated from the words seen once and twice.  The vocabulary is given;
its scores are learned from all distinct training words by expectation maximisation over the lattices.

How it runs.  Texts are written once with the block that each belongs to; each block gives its distinct
words with their training counts.  One shuffle by word sums the counts, each distinct word is scored once,
and the scores return to their blocks, where texts are summed.  The lattices of many words are walked
together, one place at a time, in arrays.  Words reach the driver in no form; what does is one number a
piece of the vocabulary and five totals.

Defined cases: a null text counts as empty and has one token, the end; a null id takes part in training
(its text is taken as the empty string); with no training rows the end and all words share the
probability by halves and every piece has the same score; repeated rows are scored each; very long words
are spelled like any other; an empty table gives an empty result; further columns don't matter.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crivo.llm._common import U64, chunks, cut, release, splitmix, string_buffers, word_hashes

MARK = "▁"
#: Text bytes in a block; a block never reaches over a partition of the scan.
BLOCK_BYTES = 48 << 20
#: Bytes of words whose lattices are walked together.
GROUP_BYTES = 1 << 18
PIECE_PRIOR = 0.1
#: Rounds of expectation maximisation over all distinct training words.
ROUNDS = 4
#: Score of a byte that the vocabulary has no piece for.
NO_BYTE = -30.0


def lowered(data: np.ndarray) -> np.ndarray:
    data = data.copy()
    upper = (data >= 65) & (data <= 90)
    data[upper] += 32
    return data


class Words:
    """Distinct words of a block with their counts in training and an example of their bytes."""

    def __init__(self) -> None:
        self.hashes = np.zeros(0, U64)
        self.counts = np.zeros(0, np.int64)
        self.texts: list = []
        self.size = 0

    def add(self, data: np.ndarray, offsets: np.ndarray, train: np.ndarray) -> None:
        import pyarrow as pa

        for a, b in chunks(offsets):
            part, bounds = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            hashes, rows, starts, ends = word_hashes(part, bounds, with_places=True)
            if not len(hashes):
                continue
            names, first, which = np.unique(hashes, return_index=True, return_inverse=True)
            counts = np.bincount(which, train[a:b][rows].astype(np.float64), len(names)).astype(np.int64)
            where = np.searchsorted(self.hashes, names)
            known = where < len(self.hashes)
            known[known] = self.hashes[where[known]] == names[known]
            self.counts[where[known]] += counts[known]
            new = np.flatnonzero(~known)
            if len(new):
                raw = part.tobytes()
                text = pa.array([raw[s:e] for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)], pa.binary())
                self.texts.append(text)
                hashes = np.concatenate((self.hashes, names[new]))
                counts = np.concatenate((self.counts, counts[new]))
                order = np.argsort(hashes, kind="stable")
                places = np.concatenate((getattr(self, "places", np.zeros(0, np.int64)), self.size + np.arange(len(new))))
                self.hashes, self.counts, self.places = hashes[order], counts[order], places[order]
                self.size += len(new)

    def rows(self, block: int):
        import pyarrow as pa

        if not self.size:
            return
        text = pa.chunked_array(self.texts).combine_chunks()
        for a in range(0, self.size, 50_000):
            b = min(a + 50_000, self.size)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, block)), pa.array(self.hashes[a:b].view(np.int64)), text.take(pa.array(self.places[a:b])), pa.array(self.counts[a:b])], names=["block", "h", "word", "n"])


def with_blocks(texts: DataFrame, block_bytes: int) -> DataFrame:
    """(block, doc, train, text): the rows of each partition in blocks of about ``block_bytes``."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 24, 0
        for batch in batches:
            size = batch.column(2).nbytes
            if held and held + size > block_bytes:
                number, held = number + 1, 0
            held += size
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), number)), *batch.columns], names=["block", "doc", "train", "text"])

    return texts.mapInArrow(run, "block long, doc long, train boolean, text string")


def word_table(texts: DataFrame) -> DataFrame:
    """(block, h, word, n): the distinct lower-cased words of each block and their training counts.

    A block that is read in two parts has two rows for the words of both.
    """

    def run(batches: Iterator) -> Iterator:
        words, current = Words(), None
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            for a, b in zip(edges := np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])), np.append(edges[1:], len(blocks)), strict=True):
                if current is not None and blocks[a] != current:
                    yield from words.rows(current)
                    words = Words()
                current = int(blocks[a])
                part = batch.slice(a, b - a)
                data, offsets = string_buffers(part.column(2))
                words.add(lowered(data), offsets, part.column(1).to_numpy(zero_copy_only=False).astype(bool))
        if current is not None:
            yield from words.rows(current)

    return texts.select("block", "train", "text").mapInArrow(run, "block long, h long, word binary, n long")


class Lattice:
    """Lattices of many words at once, under natural-log scores of the pieces.

    ``pieces`` may hold empty strings, which fit nowhere; ``<0x41>`` and the like stand for bytes.
    """

    def __init__(self, pieces: list[str], scores: np.ndarray) -> None:
        self.scores = np.asarray(scores, np.float64)
        self.bytes = np.full(256, -1)
        tables: list[dict[str, int]] = []
        for k, p in enumerate(pieces):
            if byte := re.fullmatch("<0x([0-9A-F]{2})>", p):
                self.bytes[int(byte[1], 16)] = k
                continue
            for n in range(1, len(p) + 1):
                if n > len(tables):
                    tables.append({})
                if n == len(p):
                    tables[n - 1][p] = k
                else:
                    tables[n - 1].setdefault(p[:n], -1)
        with np.errstate(over="ignore"):
            self.powers = np.multiply.accumulate(np.concatenate(([U64(1)], np.full(len(tables), 0xD6E8FEB86659FD93, U64))))
        self.tables = []
        for n, names in enumerate(tables, 1):
            codes = np.frombuffer("".join(names).encode("utf-32-le"), "<u4").reshape(len(names), n)
            with np.errstate(over="ignore"):
                hashes = (self.mixed(codes) * self.powers[:n]).sum(axis=1, dtype=U64)
            order = np.argsort(hashes)
            self.tables.append((hashes[order], np.array(list(names.values()))[order]))

    @staticmethod
    def mixed(codes: np.ndarray) -> np.ndarray:
        return splitmix(codes.astype(U64) + U64(0x5151))

    def arcs(self, codes: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, ...]:
        """(start, end, piece) of all arcs, ordered by their start's place in the word; a byte arc has -1."""
        n = len(codes)
        word = np.repeat(np.arange(len(begins)), stops - begins)
        mixed = self.mixed(codes)
        inner = codes == ord(MARK)
        inner[begins] = False
        mixed[inner] = U64(0x7777)  # a mark inside a word is an ordinary character without a piece
        stop = stops[word]
        active, hashes = np.arange(n), np.zeros(n, U64)
        starts, ends, names, single = [], [], [], np.zeros(n, bool)
        for size, (known, pieces) in enumerate(self.tables, 1):
            inside = active + size <= stop[active]
            active, hashes = active[inside], hashes[inside]
            if not len(active):
                break
            with np.errstate(over="ignore"):
                hashes = hashes + mixed[active + (size - 1)] * self.powers[size - 1]
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            fits = known[at] == hashes
            active, hashes, piece = active[fits], hashes[fits], pieces[at[fits]]
            whole = piece >= 0
            starts.append(active[whole])
            ends.append(active[whole] + size)
            names.append(piece[whole])
            if size == 1:
                single[active[whole]] = True
        spelled = np.flatnonzero(~single)
        start, end = np.concatenate([*starts, spelled]), np.concatenate([*ends, spelled + 1])
        name = np.concatenate([*names, np.full(len(spelled), -1)])
        order = np.lexsort((start, start - begins[word[start]]))
        return start[order], end[order], name[order], word

    def byte_ids(self, codes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Pieces of the bytes of each distinct character, and which one each of ``codes`` is."""
        characters, which = np.unique(codes, return_inverse=True)
        return [self.bytes[list(chr(c).encode("utf-8", "replace"))] for c in characters.tolist()], which

    def walk(self, data: np.ndarray, offsets: np.ndarray, total: np.ndarray | None = None) -> np.ndarray:
        """Log probability of every word; with ``total``, expected piece counts are added to it."""
        if len(offsets) < 2:
            return np.zeros(0)
        raw, mark = data.tobytes(), MARK.encode()
        text = b"".join([mark + raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]).decode("utf-8", "replace")
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        sizes = np.diff(np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]) + 1
        stops = np.cumsum(sizes)
        begins = stops - sizes
        start, end, name, word = self.arcs(codes, begins, stops)
        score = np.where(name >= 0, self.scores[name], 0.0)
        spelled = np.flatnonzero(name < 0)
        ids, which = self.byte_ids(codes[start[spelled]])
        if len(spelled):
            score[spelled] = np.array([np.where(k >= 0, self.scores[k], NO_BYTE).sum() for k in ids])[which]
        # Each word has one node more than characters.
        of = word[start]
        left, right = start + of, end + of
        first, last = begins + np.arange(len(begins)), stops + np.arange(len(begins))
        ahead = np.full(len(codes) + len(begins), -np.inf)
        ahead[first] = 0.0
        place = start - begins[of]
        bounds = np.searchsorted(place, np.arange(int(place[-1]) + 2)).tolist()
        # Arcs of one start reach different places, so none is added to twice here.
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            ahead[right[a:b]] = np.logaddexp(ahead[right[a:b]], ahead[left[a:b]] + score[a:b])
        found = ahead[last]
        if total is None:
            return found
        back = np.full(len(ahead), -np.inf)
        back[last] = -found
        for a, b in zip(bounds[-2::-1], bounds[:0:-1], strict=True):
            same = np.flatnonzero(np.append(True, left[a + 1 : b] != left[a : b - 1]))
            back[left[a:b][same]] = np.logaddexp.reduceat(score[a:b] + back[right[a:b]], same)
        flow = np.exp(ahead[left] + score + back[right])
        known = name >= 0
        total += np.bincount(name[known], flow[known], len(total))
        for k, x in zip(ids, np.bincount(which, flow[spelled], len(ids)).tolist(), strict=True):
            np.add.at(total, k[k >= 0], x)
        return found

    def many(self, column, total: np.ndarray | None = None) -> np.ndarray:
        """The same for an Arrow array of words, walked in bounded groups."""
        data, offsets = string_buffers(column)
        return np.concatenate([np.zeros(0), *(self.walk(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], total) for a, b in chunks(offsets, GROUP_BYTES))])


def segmented(words: DataFrame, model_file: str) -> DataFrame:
    """(piece, n) of the words' segmentation by the vocabulary's library, each distinct word counted once."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        total = np.zeros(model.get_piece_size(), np.int64)
        for batch in batches:
            texts = [w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()]
            for ids in model.encode(texts, num_threads=1):
                for k in ids:
                    total[k] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some].astype(np.float64))], names=["piece", "n"])

    return words.mapInArrow(run, "piece int, n double")


def learn_scores(words: DataFrame, pieces: list[str], model_file: str, rounds: int) -> np.ndarray:
    """Natural-log unigram scores of the pieces.

    Spelled paths serve words that are new or rare, so every distinct training word counts once, however
    often it stands in the texts.  The start is the vocabulary's own segmentation.
    """
    distinct = words.where("c > 0").select("word")
    fits = np.array([bool(p) for p in pieces])

    def scores_of(counted: DataFrame) -> np.ndarray:
        weight = np.full(len(pieces), PIECE_PRIOR)
        for row in counted.groupBy("piece").agg(F.sum("n").alias("n")).collect():
            weight[row["piece"]] += row["n"]
        weight = np.where(fits, weight, 1e-300)
        return np.log(weight / weight.sum())

    scores = scores_of(segmented(distinct, model_file))
    for _ in range(rounds):

        def run(batches: Iterator, scores=scores) -> Iterator:
            import pyarrow as pa

            lattice, total = Lattice(pieces, scores), np.zeros(len(pieces))
            for batch in batches:
                lattice.many(batch.column(0), total)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["piece", "n"])

        scores = scores_of(distinct.mapInArrow(run, "piece int, n double"))
    return scores


def vocabulary(model_file: str) -> list[str]:
    """Pieces by id; those that stand for no text (control pieces, the unknown one) are empty."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return ["" if model.is_control(k) or model.is_unknown(k) or model.is_unused(k) else model.id_to_piece(k) for k in range(model.get_piece_size())]


def lattice_scores(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2, rounds: int = ROUNDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a document: id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 of
    the text's probability, summed over all segmentations)."""
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(folds)
    plain = docs.select(F.col(id_col).cast("long").alias("doc"), (fold != held_fold).alias("train"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = cut(with_blocks(plain, block_bytes), "texts")
    table = cut(word_table(texts), "block_words")
    words = cut(table.groupBy("h").agg(F.first("word").alias("word"), F.sum("n").alias("c")), "words")
    ends = texts.where("train").count()
    facts = words.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.coalesce(F.sum((F.col("c") == 1).cast("long")), F.lit(0)).alias("once"), F.coalesce(F.sum((F.col("c") == 2).cast("long")), F.lit(0)).alias("twice")).first()
    n, v = facts["n"] + ends, facts["v"] + (ends > 0)
    once, twice = facts["once"] + (ends == 1), facts["twice"] + (ends == 2)
    discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5
    # Without training texts the spelled words and the end share the probability.
    spelled = math.log(discount * v / n) if n else math.log(0.5)
    end_score = math.log10((ends - discount) / n) if n else math.log10(0.5)
    pieces = vocabulary(model_file)
    scores = learn_scores(words, pieces, model_file, rounds)

    def weigh(batches: Iterator) -> Iterator:
        import pyarrow as pa

        lattice = Lattice(pieces, scores)
        for batch in batches:
            counts = batch.column(2).to_numpy()
            with np.errstate(divide="ignore"):
                whole = np.log(np.where(counts > 0, counts - discount, 0.0) / max(n, 1))
            found = np.logaddexp(lattice.many(batch.column(1)) + spelled, whole) / math.log(10)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found)], names=["h", "c", "lp"])

    weighed = cut(words.select("h", "word", "c").mapInArrow(weigh, "h long, c long, lp double"), "weighed")
    answers = cut(table.select("block", "h").join(weighed.hint("merge"), "h").select("block", "h", "c", "lp"), "answers")
    release(table, words, weighed)
    bottom = n + v + 1

    def total_up(key, left, right):
        import pyarrow as pa

        h = right.column("h").combine_chunks().to_numpy().view(U64)
        order = np.argsort(h)
        h = h[order]
        c = right.column("c").combine_chunks().to_numpy()[order]
        lp = right.column("lp").combine_chunks().to_numpy()[order]
        base = np.log10((c + 1) / bottom)
        parts = [np.zeros((4, 0))]
        for chunk in left.column("text").chunks:
            data, offsets = string_buffers(chunk)
            for a, b in chunks(offsets):
                hashes, rows = word_hashes(lowered(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a])
                at = np.searchsorted(h, hashes)
                parts.append(np.stack([np.bincount(rows, x, b - a) for x in (None, c[at] > 0, base[at], lp[at])]))
        tokens, known, base_sum, marginal = np.concatenate(parts, axis=1)
        return pa.table(
            {
                "doc": left.column("doc"),
                "held_out": pa.array(~left.column("train").to_numpy().astype(bool)),
                "n_tokens": pa.array(tokens.astype(np.int64) + 1),
                "n_known": pa.array(known.astype(np.int64) + int(ends > 0)),
                "base_score": pa.array(base_sum + math.log10((ends + 1) / bottom)),
                "score": pa.array(marginal + end_score),
            }
        )

    schema = "doc long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    summed = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(total_up, schema)
    return summed.select(F.col("doc").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")

"""Substring dedup on paragraphs: MinHash banding, exact Jaccard, removals by connected components.

A paragraph is a text's part between line feeds.  Those of ``min_words`` words or more are compared by
MinHash bands tuned for recall: with rows of 3 values, the fewest bands that find a pair at the threshold
with the wanted chance (10 bands: 99.9 %).  Equal paragraphs collapse before any comparison, pairs that
share a band are verified exactly, and of each component the first occurrence (smallest document id, then
position) stays.  Shorter paragraphs, of a word or more, are compared by their hash alone: equal ones are
classes and are reported, but all of them stay, since a heading or a notice that recurs is no copied text.

A passage of ``PASSAGE_WORDS`` (50) words or more that stands word for word elsewhere is found wherever
line feeds are.  Of every run of 50 words at least one 25-word gram is its neighbourhood's smallest hash
(winnowing), so a run that occurs twice has a selected gram that occurs twice; around those grams all
50-word windows are compared exactly.  This covers what the lines leave: windows that stand wholly in
dropped lines are not looked at.  The first occurrence of a window is its source; a window is a copy if it
doesn't overlap its source in the same text.  Copies that overlap are one passage, as are sources, so a
text that repeats itself with any period is one source and one passage however long it is.  Passages and
sources that share windows are a class.  A passage is marked if ``min_words`` or more of its words stand
outside the lines that are dropped; its row has a null ``paragraph``, and so have its sources' rows.

Defined cases: a null or empty text has no paragraphs; rows with a null id are not compared; repeated
rows of one id repeat its paragraphs, and rows that can't be told apart are marked alike; a text without
line feeds is one paragraph; an empty table gives an empty result; further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crivo.functions.scan import blocks
from crivo.functions.tokens import let
from crivo.llm._common import SHINGLE_WORDS, U64, chunks, components, cut, release, splitmix, string_buffers, word_hashes
from crivo.llm.near_sets import TILE_SHINGLES, hashed, near_links, representatives, tune_bands
from crivo.operators.spans import between, merged

ROWS = 3
RECALL = 0.999
MIN_WORDS = 20
#: Words of a window, and of the grams that are selected among the windows' grams.
PASSAGE_WORDS = 50
GRAM_WORDS = 25


def split_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the parts of every text between its line feeds."""
    feeds = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate((offsets[:-1], feeds + 1)), kind="stable")
    ends = np.sort(np.concatenate((offsets[1:], feeds)), kind="stable")
    row = np.searchsorted(offsets, ends, "left") - 1
    # An empty text's row can't be found by its end alone; it has no words, so it doesn't matter which.
    return np.clip(row, 0, len(offsets) - 2), starts, ends


def small_batches(batches: Iterator, text_column: int) -> Iterator:
    """The same rows in batches of about ``CHUNK_BYTES`` of text, which bounds a task's memory."""
    for batch in batches:
        _, offsets = string_buffers(batch.column(text_column))
        for a, b in chunks(offsets):
            yield batch.slice(a, b - a)


def described(texts: DataFrame, bands: int, rows: int, size: int, min_words: int) -> DataFrame:
    """(doc, paragraph, start, n_chars, n_words, k1, k2, n, bands) of the paragraphs of (doc, text) rows.

    Paragraphs of fewer than ``min_words`` words have no bands.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in small_batches(batches, 1):
            data, offsets = string_buffers(batch.column(1))
            if not len(data):
                continue
            row, start, end = split_lines(data, offsets)
            first = np.searchsorted(row, np.arange(len(offsets) - 1), "left")
            number = np.arange(len(row)) - first[row]
            chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
            bounds = np.concatenate((start, [len(data)]))
            n_words = np.zeros(len(row), np.int64)
            at = 0
            while at < len(row):
                upto = max(at + 1, int(np.searchsorted(bounds, bounds[at] + (2 << 20), "right")) - 1)
                upto = min(upto, len(row))
                _, where = word_hashes(data[bounds[at] : bounds[upto]], bounds[at : upto + 1] - bounds[at])
                n_words[at:upto] = np.bincount(where, minlength=upto - at)
                at = upto
            take = np.flatnonzero(n_words > 0)
            if not len(take):
                continue
            parts = [data[s:e].tobytes() for s, e in zip(start[take].tolist(), end[take].tolist(), strict=True)]
            ids = batch.column(0).take(pa.array(row[take]))
            columns = [number[take].astype("int32"), (chars[start[take]] - chars[offsets[row[take]]]).astype("int32"), (chars[end[take]] - chars[start[take]]).astype("int32"), n_words[take].astype("int32")]
            for a, b, k1, k2, n, keys in hashed(pa.array(parts, pa.large_binary()), bands, rows, size):
                long = n_words[take[a:b]] >= min_words
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(long * bands))), pa.int32()), pa.array(keys[long].ravel()))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), *(pa.array(c[a:b]) for c in columns), pa.array(k1), pa.array(k2), pa.array(n.astype("int32")), lists],
                    names=["doc", "paragraph", "start", "n_chars", "n_words", "k1", "k2", "n", "bands"],
                )

    return texts.mapInArrow(run, "doc long, paragraph int, start int, n_chars int, n_words int, k1 long, k2 long, n int, bands array<long>")


def grams(words: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``size`` words from each word on, and whether they stand in one text."""
    n = max(0, len(words) - size + 1)
    mixed = np.zeros(n, U64)
    factors = splitmix(np.arange(size, dtype=U64) + U64(7001)) | U64(1)
    with np.errstate(over="ignore"):
        for k in range(size):
            mixed += words[k : k + n] * factors[k]
    return splitmix(mixed), rows[:n] == rows[len(rows) - n :]


def selected_grams(texts: DataFrame) -> DataFrame:
    """(h, doc, t, pos, line): of each run of ``PASSAGE_WORDS`` words the gram with the smallest hash.

    ``line`` is the number of the line that holds all windows around the gram, null if they reach over it.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in small_batches(batches, 2):
            data, offsets = string_buffers(batch.column(2))
            words, rows, starts, _ = word_hashes(data, offsets, with_places=True)
            if len(words) < PASSAGE_WORDS:
                continue
            hashes, _ = grams(words, rows, GRAM_WORDS)
            whole = rows[: len(words) - PASSAGE_WORDS + 1] == rows[PASSAGE_WORDS - 1 :]
            span = PASSAGE_WORDS - GRAM_WORDS + 1
            at = np.unique((np.lib.stride_tricks.sliding_window_view(hashes, span).argmin(1) + np.arange(len(whole)))[whole])
            if not len(at):
                continue
            feeds = np.flatnonzero(data == 10)
            line = np.searchsorted(feeds, starts) - np.searchsorted(feeds, offsets[rows])
            first, last = np.searchsorted(rows, rows[at], "left"), np.searchsorted(rows, rows[at], "right") - 1
            low, high = np.maximum(at - (PASSAGE_WORDS - GRAM_WORDS), first), np.minimum(at + PASSAGE_WORDS - 1, last)
            where = pa.array(rows[at])
            lines = pa.array(line[at].astype(np.int32), mask=line[low] != line[high])
            yield pa.RecordBatch.from_arrays([pa.array(hashes[at].view(np.int64)), batch.column(0).take(where), batch.column(1).take(where), pa.array((at - first).astype(np.int32)), lines], names=["h", "doc", "t", "pos", "line"])

    return texts.mapInArrow(run, "h long, doc long, t long, pos int, line int")


def bare_windows(rows: DataFrame) -> DataFrame:
    """(h, doc, t, pos, first, last, before, upto): windows around the grams at the positions ``at``.

    ``gone`` are the places of dropped lines; a window is given if a word of it stands outside of them.
    ``first`` and ``last`` bound it in characters, ``before`` and ``upto`` count such words at its bounds.
    """
    kinds = "h long, doc long, t long, pos int, first int, last int, before int, upto int"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for doc, t, text, at, gone in zip(*(batch.column(k) for k in range(5)), strict=True):
                data, offsets = string_buffers(pa.array([text.as_py()], pa.large_string()))
                words, rows, starts, ends = word_hashes(data, offsets, with_places=True)
                hashes, _ = grams(words, rows, PASSAGE_WORDS)
                chars = np.concatenate((np.zeros(1, np.int32), np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)))
                starts, ends = chars[starts], chars[ends]
                bare = np.ones(len(words), bool)
                for line in gone.as_py() or []:
                    bare[np.searchsorted(starts, line["start"]) : np.searchsorted(starts, line["start"] + line["n_chars"])] = False
                sums = np.concatenate((np.zeros(1, np.int32), np.cumsum(bare, dtype=np.int32)))
                near = np.zeros(len(hashes), bool)
                for p in at.as_py():
                    near[max(0, p - PASSAGE_WORDS + GRAM_WORDS) : p + 1] = True
                near &= sums[PASSAGE_WORDS:] > sums[: len(hashes)]
                every = np.flatnonzero(near)
                for k in range(0, len(every), 1 << 16):
                    pos = every[k : k + (1 << 16)]
                    same = (np.full(len(pos), doc.as_py()), np.full(len(pos), t.as_py()))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (hashes[pos].view(np.int64), *same, pos.astype(np.int32), starts[pos], ends[pos + PASSAGE_WORDS - 1], sums[pos], sums[pos + PASSAGE_WORDS])], names=["h", "doc", "t", "pos", "first", "last", "before", "upto"])

    return rows.select("doc", "t", "text", "at", "gone").mapInArrow(run, kinds)


def passages(plain: DataFrame, lines: DataFrame, min_words: int) -> DataFrame:
    """Marks of passages of (doc, text) rows, given the marks of whole lines."""
    texts = plain.where("text IS NOT NULL").select("doc", F.xxhash64("text").alias("t"), "text")
    dropped = lines.where("NOT kept").select("doc", F.col("paragraph").alias("line")).distinct()
    chosen = cut(selected_grams(texts).join(dropped, ["doc", "line"], "left_anti").select("h", "doc", "t", "pos"), "grams")
    # Hashes alone are counted, on the scan's side first, so a passage of many copies is no large group.
    twice = chosen.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    near = chosen.join(twice, "h").groupBy("doc", "t").agg(F.collect_set("pos").alias("at"))
    gone = lines.where("NOT kept").groupBy("doc").agg(F.collect_set(F.struct("start", "n_chars")).alias("gone"))
    # Rows that repeat have the same windows, so one of them is looked at and each is marked through its id.
    near = cut(near.join(gone, "doc", "left"), "near")
    looked_at = texts.hint("merge").join(near, ["doc", "t"]).dropDuplicates(["doc", "t"])
    windows = cut(bare_windows(looked_at), "windows")
    place = ["doc", "t", "pos", "first", "last"]
    firsts = windows.groupBy("h").agg(F.min(F.struct(*place)).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    sources = spans_of(firsts.select("h", "f.*"), ["h"])
    sources = cut(sources.withColumn("source", F.xxhash64(F.lit(0), "doc", "t", "span")), "sources")
    met = windows.join(sources.select("h", "source", F.col("doc").alias("fd"), F.col("t").alias("ft"), F.col("pos").alias("fp")), "h")
    # A window that overlaps its source in the same text is no copy; the source itself is at distance 0.
    copies = spans_of(met.where(f"doc <> fd OR t <> ft OR pos - fp >= {PASSAGE_WORDS}"), ["source", "before", "upto"])
    copies = cut(copies.withColumn("passage", F.xxhash64(F.lit(1), "doc", "t", "span")), "passages")
    release(chosen, near, windows)
    whole = lambda df, name: df.groupBy(F.col(name).alias("span"), "doc").agg((F.max("pos") - F.min("pos") + PASSAGE_WORDS).alias("n_words"), F.min("first").alias("start"), (F.max("last") - F.min("first")).alias("n_chars"), *([(F.max("upto") - F.min("before")).alias("bare")] if name == "passage" else []))
    marked = whole(copies, "passage").where(F.col("bare") >= min_words).drop("bare").withColumn("kept", F.lit(False))
    edges = copies.select(F.col("passage").alias("a"), F.col("source").alias("b")).distinct().join(marked.select(F.col("span").alias("a")), "a", "left_semi")
    classes = components(edges).select(F.col("node").alias("span"), F.col("component").alias("class_id"))
    spans = marked.unionByName(whole(sources, "source").withColumn("kept", F.lit(True)))
    rows = cut(spans.join(classes, "span"), "spans")
    release(sources, copies)
    size = rows.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_class"), F.min("doc").alias("class_doc"))
    return rows.join(size, "class_id").select("doc", F.lit(None).cast("int").alias("paragraph"), F.col("start").cast("int").alias("start"), F.col("n_chars").cast("int").alias("n_chars"), F.col("n_words").cast("int").alias("n_words"), "class_id", "class_doc", "n_class", "kept")


def spans_of(windows: DataFrame, carried: list[str]) -> DataFrame:
    """``windows`` with the first position of the windows that overlap one another, as ``span``."""
    order = Window.partitionBy("doc", "t").orderBy("pos")
    apart = F.coalesce(F.col("pos") - F.lag("pos").over(order) >= PASSAGE_WORDS, F.lit(True))
    opened = windows.withColumn("opens", F.when(apart, F.col("pos")))
    return opened.select("doc", "t", "pos", "first", "last", *carried, F.max("opens").over(order).alias("span"))


def paragraph_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, size: int = SHINGLE_WORDS, min_words: int = MIN_WORDS, rows: int = ROWS, recall: float = RECALL, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """One row for each occurrence of a paragraph or passage that has an equal or similar one elsewhere.

    Columns: id, paragraph (number of the line, from 0; null for a passage), start and n_chars (in characters), n_words,
    class_id, class_doc (smallest document id of the class), n_class (occurrences), kept (the first; short
    paragraphs and the sources of passages all stay).
    """
    bands = tune_bands(threshold, recall, rows)
    plain = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    found = cut(described(plain, bands, rows, size, min_words), "paragraphs")
    reps = cut(representatives(found.where(F.size("bands") > 0).withColumn("at", F.struct("doc", "paragraph")), "at"), "reps")

    def with_text(members: DataFrame) -> DataFrame:
        # A text is joined and split once for all of its paragraphs.
        by_doc = members.groupBy(F.col("first.doc").alias("doc")).agg(F.collect_list(F.struct(*members.columns)).alias("of"))
        lines = lambda z: F.transform(z["of"], lambda m: F.struct(*[m[c].alias(c) for c in members.columns], F.get(z["lines"], m["first"]["paragraph"]).alias("text")))
        split = F.struct(F.col("of"), F.split("text", "\n", -1).alias("lines"))
        return by_doc.join(plain.hint("merge"), "doc").select(F.inline(let(split, lines)))

    linked = near_links(reps, with_text, threshold=threshold, bands=bands, rows=rows, tolerance=None, tile_shingles=tile_shingles, size=size)
    classes = cut(reps.select("id", "k2", "copies", "first").join(linked.select("id", "root"), "id", "left").select("id", "k2", "copies", "first", F.coalesce("root", "id").alias("root")), "classes")
    whole = classes.groupBy("root").agg(F.sum("copies").alias("n_class"), F.min("first").alias("head")).where("n_class > 1")
    marked = classes.join(whole, "root").select(F.col("id").alias("k1"), "k2", "root", "n_class", "head")
    columns = ("doc", "paragraph", "start", "n_chars", "n_words")
    first = (F.col("doc") == F.col("head.doc")) & (F.col("paragraph") == F.col("head.paragraph"))
    lines = found.where(F.size("bands") > 0).drop("bands").join(marked, ["k1", "k2"]).select(*columns, F.col("root").alias("class_id"), F.col("head.doc").alias("class_doc"), "n_class", first.alias("kept"))
    lines = cut(lines, "lines")
    short = found.where(F.size("bands") == 0).select(*columns, "k1", "k2")
    equal = short.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_class"), F.min("doc").alias("class_doc")).where("n_class > 1")
    recurring = short.join(equal, ["k1", "k2"]).select(*columns, F.xxhash64(F.lit(2), "k1", "k2").alias("class_id"), "class_doc", "n_class", F.lit(True).alias("kept"))
    copied = passages(plain, lines, min_words)
    out = cut(lines.unionByName(recurring).unionByName(copied), "marks")
    release(found, reps, classes, lines)
    return out.withColumnRenamed("doc", id_col)


def remove_paragraphs(docs: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the paragraphs and passages that ``marks`` doesn't keep; a text that loses all becomes empty.

    A paragraph goes with the line feed before it (a text counts as if it began with one), a passage alone.
    """
    begin = F.when(F.col("paragraph").isNull(), F.col("start") + 1).otherwise(F.col("start"))
    spans = F.struct(begin.alias("start"), (F.col("start") + F.col("n_chars") + 1).alias("end"))
    drop = marks.where("NOT kept").groupBy(F.col(id_col).alias("_gone_id")).agg(F.collect_set(spans).alias("_gone"))
    text = F.concat(F.lit("\n"), F.col(text_col))
    left = let(F.struct(merged(F.col("_gone")).alias("at"), blocks(text).alias("parts"), F.length(text).alias("size")), lambda z: between(z["parts"], z["at"], z["size"], lambda _: F.lit("")))
    out = docs.join(drop, F.col(id_col) == F.col("_gone_id"), "left")
    return out.withColumn(text_col, F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(F.regexp_replace(left, "^\n", ""))).select(*docs.columns)

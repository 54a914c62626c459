"""Best-fit packing by a grouping genetic algorithm, on islands.

Documents become token ids and, above the capacity, pieces; a full piece is a sequence of its own.  The
other pieces are dealt at random into shards of about ``SHARD_ITEMS``, and every shard is packed by
``ISLANDS`` populations that start from packings in random order and evolve apart; ``MIGRATIONS`` times
they hand their best packing to the next island and go on.  A crossover injects whole well-filled bins of
one parent into the other, removes the bins that hold a second copy of an injected piece, lets displaced
pieces take the place of shorter ones where they fill a bin better, and places what is left by best fit,
longest first.  An island rests when its packing has as few bins as the sum of lengths allows, or after
``STALL`` crossovers that don't improve it.  The bins of a shard's best packing that are not well filled
are opened again and their pieces go to the next level, where the opened bins of all shards compete anew,
until one shard is left or a level leaves more than half of its pieces open; that one is the last.

Nothing is gathered beyond a shard; the driver sees counts only.  A piece is told from its equals by the
number it gets when the pieces are written, so repeated rows and null ids are packed like any other.

Defined cases: a null or empty text is the one id 0; a text of exactly the capacity with its final 0 is
one full piece; an empty table gives an empty result; further columns don't matter.
"""

from __future__ import annotations

import random
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crivo.llm._common import chunks, cut, string_buffers

CAPACITY = 2048
SHARD_ITEMS = 1500
ISLANDS = 2
MIGRATIONS = 2
GENERATIONS = 100
STALL = 25
POPULATION = 4
#: A bin with at least this part of its capacity filled stays as it is when a level ends.
WELL_FILLED = 0.985
SPECIAL = "<|endoftext|>"
#: Bytes of texts whose distinct stretches are looked for together, and of those put together at once.
GROUP_BYTES = 8 << 20
TEXT_BYTES = 1 << 18
#: First bytes of characters that are surely no white space.
SOLID = np.zeros(256, bool)
SOLID[[*range(0x21, 0x7F), *range(0xC3, 0xE0), *range(0xE4, 0xF5)]] = True


class Encoder:
    """Ids of texts as the vocabulary's own library gives them, from its rank file where that is the same.

    The rank file encodes the same vocabulary with the same splitting pattern several times faster.  A
    text that holds the special token's string is encoded by the vocabulary's own library, since only that
    one recognises it; so are all texts where no rank file is given.

    The splitting pattern always begins a word at a space before a character that is no white space, and no
    merge reaches over a word's bounds.  So ``many`` cuts texts there and encodes each distinct stretch of a
    group of texts once.
    """

    def __init__(self, vocabulary: str, ranks: str | None = None) -> None:
        self.vocabulary, self.own, self.fast = vocabulary, None, None
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
            self.n_bytes = np.zeros(max(table.values()) + 1, np.int64)
            self.n_bytes[list(table.values())] = [len(token) for token in table]

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and SPECIAL not in text:
            return self.fast.encode_to_numpy(text, disallowed_special=()) if text else np.zeros(0, np.uint32)
        if self.own is None:
            from tokenizers import Tokenizer

            self.own = Tokenizer.from_file(self.vocabulary)
        return np.array(self.own.encode(text, add_special_tokens=False).ids, np.uint32)

    def many(self, texts) -> Iterator[np.ndarray]:
        """Ids of every text of an Arrow string array; nulls count as empty."""
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "")
        if self.fast is None:
            yield from (self(text.as_py()) for text in texts)
            return
        alone = pc.or_(pc.match_substring(texts, SPECIAL), pc.greater(pc.binary_length(texts), GROUP_BYTES))
        data, offsets = string_buffers(pc.if_else(alone, "", texts))
        k = 0
        for a, b in chunks(offsets, GROUP_BYTES):
            for ids in self.assembled(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                yield self(texts[k].as_py()) if alone[k].as_py() else ids
                k += 1

    def assembled(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """Ids of every text of a group, from those of its distinct stretches."""
        import pyarrow as pa

        edge = np.zeros(len(data) + 1, bool)
        edge[:-2] = (data[:-1] == 0x20) & SOLID[data[1:]] if len(data) else False
        # The last byte of a text is no edge for the next one's first.
        edge[offsets[1:] - 1] = False
        edge[offsets] = True
        bounds = np.flatnonzero(edge)
        buffers = [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
        stretches = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, buffers).dictionary_encode()
        which = stretches.indices.to_numpy()
        ids, begins, sizes = self.distinct(*string_buffers(stretches.dictionary))
        at = np.searchsorted(bounds, offsets)
        for a, b in chunks(offsets, TEXT_BYTES):
            own = which[at[a] : at[b]]
            ends = np.concatenate(([0], np.cumsum(sizes[own])))
            flat = ids[np.repeat(begins[own] - ends[:-1], sizes[own]) + np.arange(ends[-1])]
            places = ends[at[a : b + 1] - at[a]].tolist()
            yield from (flat[x:y] for x, y in zip(places[:-1], places[1:], strict=True))

    def distinct(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of stretches, where each one's begin, and how many they are."""
        lengths = np.diff(offsets)
        inner = lengths > 1
        first = offsets[:-1][inner]
        inner[inner] = (data[first] == 0x20) & SOLID[data[first + 1]]
        # Stretches that begin a word wherever they stand are encoded as one text and parted by their tokens' bytes.
        found = [self.fast.encode_to_numpy(data[np.repeat(inner, lengths)].tobytes().decode(), disallowed_special=())]
        until, upto = np.cumsum(self.n_bytes[found[0]]), np.cumsum(lengths[inner])
        ends = np.searchsorted(until, upto) + 1
        if not np.array_equal(until[ends - 1], upto):
            raise ValueError("a token reaches over a space that begins a word: the rank file's pattern isn't the one expected")
        sizes = np.zeros(len(lengths), np.int64)
        sizes[inner] = np.diff(ends, prepend=0)
        others = np.flatnonzero(~inner)
        found += [self(data[offsets[k] : offsets[k + 1]].tobytes().decode()) for k in others.tolist()]
        sizes[others] = [len(x) for x in found[1:]]
        order = np.concatenate((np.flatnonzero(inner), others))
        begins = np.zeros(len(lengths), np.int64)
        begins[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate(found), begins, sizes


@lru_cache(maxsize=2)
def loaded(vocabulary: str, ranks: str | None = None) -> Encoder:
    """An encoder that a Python worker keeps for its next task."""
    return Encoder(vocabulary, ranks)


def token_pieces(docs: DataFrame, vocabulary: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc, piece, start, length, ids_crc32[, ids]) of every document's pieces."""

    def run(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa

        encoder = loaded(vocabulary, ranks)
        for batch in batches:
            docs_ = batch.column(0).to_pylist()
            out: list[list] = [[], [], [], [], [], []]

            def flush(out=out):
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
                names = ["doc", "piece", "start", "length", "ids_crc32", "ids"][: 6 if with_ids else 5]
                full = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=False)][: len(names)], names=names)
                for c in out:
                    c.clear()
                return full

            for doc, ids in zip(docs_, encoder.many(batch.column(1)), strict=True):
                ids = np.append(ids, np.uint32(0)).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                bounds = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    values = (doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b].astype(np.int32) if with_ids else None)
                    for c, v in zip(out, values, strict=True):
                        c.append(v)
                if len(out[0]) >= 4096:
                    yield flush()
            yield flush()

    schema = "doc long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


# --- one shard: bins are lists of item numbers, lengths[k] is the length of item k -------------------


def best_fit(items: list[int], lengths: list[int], capacity: int, bins: list[list[int]], room: list[int]) -> None:
    """Place ``items`` in their order, each into the fullest bin that still takes it."""
    free = sorted((r, k) for k, r in enumerate(room) if r)
    for item in items:
        size = lengths[item]
        at = bisect_left(free, (size, -1))
        if at < len(free):
            left, k = free.pop(at)
            bins[k].append(item)
            left -= size
        else:
            k, left = len(bins), capacity - size
            bins.append([item])
            room.append(left)
        room[k] = left
        if left:
            insort(free, (left, k))


def loads(bins: list[list[int]], lengths: list[int]) -> list[int]:
    length = lengths.__getitem__
    return [sum(map(length, b)) for b in bins]


def fitness(bins: list[list[int]], lengths: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then the mean square of their fill."""
    fill = sum([(n / capacity) ** 2 for n in loads(bins, lengths)])
    return -len(bins), fill / max(1, len(bins))


def refill(items: list[int], lengths: list[int], capacity: int, bins: list[list[int]], room: list[int]) -> None:
    """Place displaced ``items``: first in exchange for shorter ones that leave more room unused, then by best fit."""
    loose = sorted((lengths[i], i) for i in items)
    for k, b in enumerate(bins):
        left = room[k]
        if not left:
            continue
        for at, i in enumerate(b):
            if not left or not loose:
                break
            length = lengths[i]
            j = bisect_left(loose, (length + left + 1, -1)) - 1
            if j >= 0 and loose[j][0] > length:
                size, b[at] = loose.pop(j)
                insort(loose, (length, i))
                left -= size - length
        room[k] = left
    best_fit([i for _, i in reversed(loose)], lengths, capacity, bins, room)


def cross(giver: list[list[int]], taker: list[list[int]], lengths: list[int], capacity: int, dice: random.Random) -> list[list[int]]:
    """Inject well-filled bins of ``giver`` into ``taker`` and place again what they displace."""
    full = loads(giver, lengths)
    ranked = sorted(range(len(giver)), key=full.__getitem__, reverse=True)
    good = ranked[: max(1, len(ranked) // 2)]
    injected = [k for k in good if dice.random() < 0.5] or good[:1]
    bins, displaced = [list(giver[k]) for k in injected], []
    room = [capacity - full[k] for k in injected]
    inside = {i for b in bins for i in b}
    for b, n in zip(taker, loads(taker, lengths), strict=True):
        if inside.isdisjoint(b):
            bins.append(list(b))
            room.append(capacity - n)
        else:
            displaced += [i for i in b if i not in inside]
    refill(displaced, lengths, capacity, bins, room)
    return bins


def evolve(lengths: list[int], capacity: int, elites: list[list[list[int]]], seed: int, generations: int, population: int, stall: int = STALL) -> list[list[int]]:
    """The best packing that one island finds, starting from ``elites`` and packings in random order."""
    dice = random.Random(seed)
    least = -(-sum(lengths) // capacity)
    herd = [(fitness(e, lengths, capacity), e) for e in elites]
    while len(herd) < population:
        shaken, bins = dice.sample(range(len(lengths)), len(lengths)), []
        best_fit(shaken, lengths, capacity, bins, [])
        herd.append((fitness(bins, lengths, capacity), bins))
    herd.sort(key=lambda x: x[0], reverse=True)
    calm = 0
    for _ in range(generations):
        if -herd[0][0][0] <= least or calm >= stall:
            break
        one, two = dice.sample(range(len(herd)), 2)
        child = cross(herd[min(one, two)][1], herd[max(one, two)][1], lengths, capacity, dice)
        worth = fitness(child, lengths, capacity)
        calm = 0 if worth > herd[0][0] else calm + 1
        if worth > herd[-1][0]:
            herd[-1] = (worth, child)
            herd.sort(key=lambda x: x[0], reverse=True)
    return herd[0][1]


def numbered(bins: list[list[int]], n: int) -> list[int]:
    """The bin of each item."""
    where = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            where[i] = k
    return where


def listed(where: list[int]) -> list[list[int]]:
    bins: list[list[int]] = [[] for _ in range(max(where, default=-1) + 1)]
    for i, k in enumerate(where):
        bins[k].append(i)
    return bins


def pack_level(items: DataFrame, shards: int, level: int, capacity: int, last: bool) -> DataFrame:
    """Pack (item, length) rows: (item, length, sequence_id, offset), the last two null for opened bins."""
    home = F.pmod(F.xxhash64(F.lit(level), "item"), F.lit(shards))
    shard = items.groupBy(home.alias("shard")).agg(F.sort_array(F.collect_list(F.struct("item", "length"))).alias("content"))

    def stage(batches: Iterator, first: bool) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            # One shard at a time is unpacked, so a task holds its batch and one shard's lists.
            for k in range(len(batch)):
                row = batch.slice(k, 1)
                shard, island = row.column("shard")[0].as_py(), row.column("island")[0].as_py()
                lengths = row.column("content").flatten().field("length").to_pylist()
                elites = [] if first else [listed(w) for w in row.column("elites")[0].as_py()]
                best = evolve(lengths, capacity, elites, hash((level, shard, island, first)) & 0xFFFFFFFF, GENERATIONS, POPULATION)
                worth = fitness(best, lengths, capacity)
                columns = [row.column("shard"), row.column("island"), row.column("content"), pa.array([numbered(best, len(lengths))], pa.list_(pa.int32())), pa.array([worth[0]], pa.int64()), pa.array([worth[1]], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "island", "content", "bins", "worth_bins", "worth_fill"])

    schema = "shard long, island int, content array<struct<item:long,length:long>>, bins array<int>, worth_bins long, worth_fill double"
    islands = shard.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1)))).repartition("shard", "island")
    packed = islands.select("shard", "island", "content").mapInArrow(lambda b: stage(b, True), schema)
    for _ in range(MIGRATIONS):
        # Each island's best goes to itself and to the next island of its shard.
        moved = packed.withColumn("island", F.explode(F.array(F.col("island"), ((F.col("island") + 1) % ISLANDS).cast("int"))))
        met = moved.groupBy("shard", "island").agg(F.first("content").alias("content"), F.collect_list("bins").alias("elites"))
        packed = met.mapInArrow(lambda b: stage(b, False), schema)
    best = packed.groupBy("shard").agg(F.max_by(F.struct("content", "bins"), F.struct("worth_bins", "worth_fill", "island")).alias("best"))

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for j in range(len(batch)):
                out: dict[str, list] = {"item": [], "length": [], "sequence_id": [], "offset": []}
                row = batch.slice(j, 1)
                shard, packed = row.column("shard")[0].as_py(), row.column("best").field("content").flatten()
                items, lengths = packed.field("item").to_pylist(), packed.field("length").to_pylist()
                for k, b in enumerate(listed(row.column("best").field("bins")[0].as_py())):
                    at, total = 0, sum(lengths[i] for i in b)
                    stays = last or total >= WELL_FILLED * capacity
                    for i in b:
                        out["item"].append(items[i])
                        out["length"].append(lengths[i])
                        out["sequence_id"].append((level << 57) + (shard << 20) + k if stays else None)
                        out["offset"].append(at if stays else None)
                        at += lengths[i]
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(n, pa.int64()) for n in out]))

    return best.mapInArrow(place, "item long, length long, sequence_id long, offset long")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(item, sequence_id, offset) for (item, length) rows; full ones get sequences of their own."""
    placed = pieces.where(F.col("length") >= capacity).select("item", (-F.col("item") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity).select("item", "length")
    left, level, before = rest.count(), 0, None
    while left:
        shards = max(1, ceil(left / shard_items))
        last = shards == 1 or (before is not None and 2 * left > before)
        result = cut(pack_level(rest, shards, level, capacity, last), f"packed{level}")
        placed = placed.unionByName(result.where("sequence_id IS NOT NULL").select("item", "sequence_id", "offset"))
        rest = result.where("sequence_id IS NULL").select("item", "length")
        before, left, level = left, rest.count(), level + 1
    return placed


def pack_documents(docs: DataFrame, vocabulary: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """One row a piece: id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for."""
    tokens = token_pieces(docs, vocabulary, ranks, id_col, text_col, capacity, with_ids)
    pieces = cut(tokens.withColumn("item", F.monotonically_increasing_id()), "pieces")
    placed = pack_pieces(pieces, capacity, shard_items)
    return pieces.join(placed, "item").select(F.col("doc").alias(id_col), "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), "sequence_id", "offset")

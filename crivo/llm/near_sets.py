"""Near-equal sets of word shingles: candidates from MinHash bands, exact verification in bounded tiles.

The steps, each of them a Spark job over the whole table:

1. ``describe`` hashes every text once: a 128-bit key of its shingle set, its size and its band keys.
2. Equal sets collapse to one representative, so copies are never compared with one another.
3. Representatives that share a band key are joined to the bucket's smallest; the components of these
   star edges say which representatives may have to meet.
4. Small components are dealt into tiles; a large component is cut into as many tiles as its weight
   asks for, and those of its tiles that share a bucket meet pairwise.  A task holds one or two tiles.
5. Inside a tile pairs that share a band are pruned on their MinHash values and verified exactly.  Each
   pair belongs to one tile or one pair of tiles, so links are counted once and pairs are not emitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crivo.llm._common import SHINGLE_WORDS, U64, chunks, components, cut, min_hashes, release, set_keys, shingle_sets, splitmix, string_buffers

#: Shingles in a tile; a text counts as TILE_TEXT more, which bounds the texts in a tile.
TILE_SHINGLES = 150_000
TILE_TEXT = 150


def band_recall(similarity: float, bands: int, rows: int) -> float:
    return 1 - (1 - similarity**rows) ** bands


def tune_bands(threshold: float, recall: float, rows: int) -> int:
    """The fewest bands of ``rows`` values that find a pair at the threshold with the wanted recall."""
    bands = 1
    while band_recall(threshold, bands, rows) < recall:
        bands += 1
    return bands


def least_matches(n_hashes: int, threshold: float, tolerance: float) -> list[int]:
    """For 0..n compared values, the fewest equal ones at which a pair stays.

    With a uniform prior the similarity after m of h equal values is Beta(m+1, h-m+1); the chance that
    it reaches the threshold equals P(Binomial(h+1, threshold) <= m).
    """
    need = []
    for h in range(n_hashes + 1):
        total, m = 0.0, -1
        while total < tolerance and m < h:
            m += 1
            total += comb(h + 1, m) * threshold**m * (1 - threshold) ** (h + 1 - m)
        need.append(m)
    return need


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(signature), bands), U64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            key = np.full(len(signature), b, U64)
            for r in range(rows):
                key = splitmix(key ^ (signature[:, b * rows + r].astype(U64) + U64(r << 40)))
            keys[:, b] = key
    return keys


def hashed(texts, bands: int, rows: int, size: int = SHINGLE_WORDS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For ranges of an Arrow string array: first row, last row, both keys, set sizes, band keys."""
    data, offsets = string_buffers(texts)
    for a, b in chunks(offsets):
        sets, starts = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
        k1, k2 = set_keys(sets, starts)
        yield a, b, k1.view(np.int64), k2.view(np.int64), np.diff(starts), band_keys(min_hashes(sets, starts, bands * rows), bands, rows).view(np.int64)


def representatives(sets: DataFrame, first: str) -> DataFrame:
    """Collapse equal sets: (id, k2, n, bands, copies, first), id being 64 bits of the key."""
    return sets.where("n > 0").groupBy(F.col("k1").alias("id"), "k2").agg(F.count(F.lit(1)).alias("copies"), F.min(first).alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"))


def near_links(reps: DataFrame, with_text, *, threshold: float, bands: int, rows: int, tolerance: float | None, tile_shingles: int = TILE_SHINGLES, size: int = SHINGLE_WORDS) -> DataFrame:
    """(id, links, root) of the representatives that have a link.

    ``links`` counts the rows of all linked representatives (copies included), ``root`` is the smallest
    id reachable.  ``with_text`` takes (id, first, ...) rows and adds the column ``text``; where it adds
    several rows for an id, the one whose set has the id's key counts.
    """
    buckets = reps.select("id", F.explode("bands").alias("bucket")).repartition("bucket")
    full = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("held"), F.min("id").alias("lead")).where("held > 1")
    held = cut(buckets.join(full.select("bucket", "lead"), "bucket"), "buckets")
    groups = components(held, "id", "lead")
    members = cut(groups.withColumnRenamed("node", "id").join(reps.drop("bands"), "id"), "members")
    weight = F.col("n") + F.lit(TILE_TEXT)
    loads = members.groupBy("component").agg(F.sum(weight).alias("load"))
    total = loads.agg(F.sum("load")).first()[0] or 0
    n_tiles = max(1, ceil(total / tile_shingles))
    parts = F.ceil(F.col("load") / F.lit(tile_shingles))
    tile = F.when(F.col("load") <= tile_shingles, F.pmod(F.xxhash64("component"), F.lit(n_tiles))).otherwise(F.xxhash64("component", F.pmod(F.xxhash64("id", F.lit(7)), parts)))
    dealt = cut(members.join(loads, "component").select("id", "first", "n", "copies", "component", tile.alias("tile"), (F.col("load") > tile_shingles).alias("large")), "tiles")
    spread = held.join(dealt.where("large").select("id", "tile"), "id").select("bucket", "tile").distinct()
    meet = spread.alias("x").join(spread.alias("y"), F.expr("x.bucket = y.bucket AND x.tile < y.tile")).select(F.col("x.tile").alias("ta"), F.col("y.tile").alias("tb")).distinct()
    meet = cut(meet, "meet")
    texts = cut(with_text(dealt.drop("large", "n")).select("id", "copies", "component", "tile", "text"), "texts")
    sides = meet.select(F.col("ta").alias("tile"), "ta", "tb").unionByName(meet.select(F.col("tb").alias("tile"), "ta", "tb"))
    own = texts.select("id", "copies", "component", "tile", "text", F.col("tile").alias("ta"), F.col("tile").alias("tb"))
    across = texts.join(sides, "tile").select("id", "copies", "component", "tile", "text", "ta", "tb")
    need = least_matches(bands * rows, threshold, tolerance) if tolerance else None

    def compare(pdf):
        return compare_tile(pdf, threshold, bands, rows, need, size)

    pairs = cut(own.unionByName(across).groupBy("ta", "tb").applyInPandas(compare, "id long, links long, root long"), "links")
    release(held, members, dealt, meet, texts)
    roots = components(pairs, "id", "root")
    counts = pairs.groupBy("id").agg(F.sum("links").alias("links"))
    return counts.join(roots.select(F.col("node").alias("id"), F.col("component").alias("root")), "id", "left").select("id", "links", F.coalesce("root", "id").alias("root"))


def compare_tile(pdf, threshold: float, bands: int, rows: int, need: list[int] | None, size: int):
    """Links inside a tile, or between two: (id, links, root) of each text that has one."""
    import pandas as pd
    import pyarrow as pa

    none = pd.DataFrame({"id": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "root": pd.Series(dtype="int64")})
    data, offsets = string_buffers(pa.array(pdf["text"], pa.large_string()))
    sets, keys, signatures = [], [], []
    for a, b in chunks(offsets):
        part, starts = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
        keys.append(set_keys(part, starts)[0].view(np.int64))
        signatures.append(min_hashes(part, starts, bands * rows))
        sets += [part[s:e] for s, e in zip(starts[:-1], starts[1:], strict=True)]
    ids = pdf["id"].to_numpy(np.int64)
    fit = np.flatnonzero(np.concatenate(keys) == ids)
    _, once = np.unique(ids[fit], return_index=True)
    rows_kept = fit[once]
    if len(rows_kept) < 2:
        return none
    ids, sets, signature = ids[rows_kept], [sets[k] for k in rows_kept], np.concatenate(signatures)[rows_kept]
    copies, tiles = pdf["copies"].to_numpy(np.int64)[rows_kept], pdf["tile"].to_numpy(np.int64)[rows_kept]
    m = len(ids)
    meets = np.zeros((m, m), bool)
    for key in band_keys(signature, bands, rows).T:
        order = np.argsort(key, kind="stable")
        edges = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1], [True])))
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            if e - s > 1:
                run = order[s:e]
                meets[np.ix_(run, run)] = True
    if pdf["ta"].iat[0] != pdf["tb"].iat[0]:
        meets &= tiles[:, None] != tiles[None, :]
    left, right = np.nonzero(np.triu(meets, 1))
    left, right = prune(signature, left, right, need)
    shared = overlaps(sets, left, right, pdf["component"].to_numpy(np.int64)[rows_kept])
    sizes = np.array([len(s) for s in sets])
    linked = shared / (sizes[left] + sizes[right] - shared) >= threshold
    left, right = left[linked], right[linked]
    links = np.bincount(left, copies[right], m) + np.bincount(right, copies[left], m)
    root = np.arange(m)
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if (root == before).all():
            break
    some = np.flatnonzero(links)
    return pd.DataFrame({"id": ids[some], "links": links[some].astype(np.int64), "root": ids[root[some]]})


def prune(signature: np.ndarray, left: np.ndarray, right: np.ndarray, need: list[int] | None, step: int = 8, block: int = 100_000):
    """Pairs that are still likely enough to reach the threshold after each further ``step`` values."""
    if need is None:
        return left, right
    kept = []
    for at in range(0, len(left), block):
        a, b = left[at : at + block], right[at : at + block]
        equal = np.zeros(len(a), np.int64)
        for h in range(0, signature.shape[1], step):
            upto = min(h + step, signature.shape[1])
            equal += (signature[a, h:upto] == signature[b, h:upto]).sum(1)
            stay = equal >= need[upto]
            a, b, equal = a[stay], b[stay], equal[stay]
        kept.append((a, b))
    return (np.concatenate([a for a, _ in kept]), np.concatenate([b for _, b in kept])) if kept else (left, right)


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of the pairs.  Dense groups are counted by matrix products."""
    shared = np.zeros(len(left), np.int64)
    order = np.argsort(group[left], kind="stable")
    runs = np.flatnonzero(np.concatenate(([True], np.diff(group[left[order]]) != 0, [True]))) if len(left) else np.zeros(1, int)
    for s, e in zip(runs[:-1], runs[1:], strict=True):
        pairs = order[s:e]
        rows, where = np.unique(np.concatenate((left[pairs], right[pairs])), return_inverse=True)
        if len(pairs) <= 3 * len(rows):
            for p in pairs:
                shared[p] = len(np.intersect1d(sets[left[p]], sets[right[p]], assume_unique=True))
            continue
        values, column, times = np.unique(np.concatenate([sets[r] for r in rows]), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(rows)), [len(sets[r]) for r in rows])
        several = np.flatnonzero(times > 1)
        place = np.full(len(values), -1)
        place[several] = np.arange(len(several))
        column = place[column]
        row, column = row[column >= 0], column[column >= 0]
        by = np.argsort(column, kind="stable")
        row, column = row[by], column[by]
        gram = np.zeros((len(rows), len(rows)))
        for c in range(0, len(several), 2048):
            x, y = np.searchsorted(column, (c, c + 2048))
            dense = np.zeros((len(rows), 2048), np.float32)
            dense[row[x:y], column[x:y] - c] = 1
            gram += dense @ dense.T
        shared[pairs] = gram[where[: len(pairs)], where[len(pairs) :]].round().astype(np.int64)
    return shared

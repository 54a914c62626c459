"""Embedding near-dedup with a forest of random-projection trees.

Every tree splits the unit sphere by a random plane at each node, at the median of a bounded sample, down to leaves
of about ``LEAF_ROWS`` vectors of one label; vectors near a plane go to both sides (``SPILL``, in parts of
the spread along the plane).  The sample (``SAMPLE_ROWS``) places the planes and says how many trees are
needed: trees are added until ``RECALL`` of sampled vectors meet a made partner at the threshold in a leaf,
so deeper trees come in larger numbers; where ``MOST_TREES`` don't reach that, a warning says what they reach,
and below ``LEAST_RECALL`` it is an error.  Every vector is routed through every tree and compared, in double
precision, with all vectors of its label in its leaves.  Where the tree is deeper than the sample can
place, planes pass through the mean of the last sampled node.  Equal vectors collapse before that.

A leaf with more than ``LEAF_ROWS`` vectors is cut into tiles whose pairs are compared in tasks of their
own.  A pair that shares several leaves counts in the first of them only, so links are counted without
emitting or shuffling pairs; a leaf reports a count and one edge for each vector.

Defined cases: a vector that is null, empty, zero or holds null or non-finite components, or whose label
is null, links with nothing and is its own component; vectors of different lengths never link; a row
whose id is null has no component and isn't kept; repeated rows are copies of one another; an empty table
gives an empty result; further columns don't matter.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crivo.llm._common import components, cut, release

LEAF_ROWS = 512
SPILL = 0.08
RECALL = 0.999
MOST_TREES = 64
LEAST_RECALL = 0.9
#: Sampled vectors that get a partner.
PROBES = 4000
SAMPLE_ROWS = 20_000
SAMPLE_NODE = 48
ROW_GROUP = 4096


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, safe against overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def matrix(column) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


class Forest:
    """Planes, offsets and margins of all trees for vectors of one length."""

    def __init__(self, sample: np.ndarray, depth: int, spill: float, threshold: float, recall: float, seed: int) -> None:
        self.dice = np.random.default_rng(seed)
        self.depth, self.spill = depth, spill
        self.planes, self.offsets, self.centres, self.margins = [], [], [], []
        probes = sample[:PROBES]
        partners = self.partners(probes, threshold)
        apart = np.ones(len(probes), bool)
        while True:
            self.add_tree(sample)
            row, leaf = (np.concatenate(x) for x in zip(self.leaves(probes, -1), self.leaves(partners, -1), strict=True))
            both = np.unique(np.stack((row, leaf)), axis=1, return_counts=True)
            apart[both[0][0][both[1] > 1]] = False
            if apart.sum() <= (1 - recall) * len(probes):
                break
            if len(self.planes) == MOST_TREES:
                reached = 1 - apart.mean()
                if reached < LEAST_RECALL:
                    raise ValueError(f"{MOST_TREES} trees let {reached:.3f} of partners meet; larger leaves or more spill are needed")
                warnings.warn(f"{MOST_TREES} trees let {reached:.4f} of partners meet, {recall} were asked for", stacklevel=2)
                break

    def partners(self, x: np.ndarray, threshold: float) -> np.ndarray:
        """For each vector one whose cosine with it is the threshold, in a random direction."""
        away = self.dice.standard_normal(x.shape)
        away -= (away * x).sum(axis=1, keepdims=True) * x
        length = np.sqrt((away * away).sum(axis=1, keepdims=True))
        return threshold * x + np.sqrt(1 - threshold**2) * away / np.where(length > 0, length, 1)

    def plane(self, n_dims: int) -> np.ndarray:
        plane = self.dice.standard_normal(n_dims)
        return plane / np.sqrt(plane @ plane)

    def add_tree(self, sample: np.ndarray) -> None:
        """Planes by level and node; a level's node 0 has the plane of nodes that the sample can't place."""
        n_dims = sample.shape[1]
        planes, offsets, margins, nodes = [], [], [], {1: np.arange(len(sample))}
        centres = {0: sample.mean(axis=0) if len(sample) else np.zeros(n_dims)}
        for _level in range(self.depth):
            of, at, room, below = {0: self.plane(n_dims)}, {}, {}, {}
            room[0] = self.spill * float((sample @ of[0]).std()) if len(sample) else 0.0
            for node, rows in nodes.items():
                if len(rows) < SAMPLE_NODE:
                    continue
                of[node] = self.plane(n_dims)
                side = sample[rows] @ of[node]
                at[node] = float(np.median(side))
                # The margin is a part of the spread over all vectors, so that it doesn't shrink with the node.
                room[node] = self.spill * float((sample @ of[node]).std())
                below[2 * node], below[2 * node + 1] = rows[side < at[node]], rows[side >= at[node]]
                centres[node] = sample[rows].mean(axis=0)
            nodes = below
            planes.append(of)
            offsets.append(at)
            margins.append(room)
        self.planes.append(planes)
        self.offsets.append(offsets)
        self.centres.append(centres)
        self.margins.append(margins)

    def split(self, tree: int, level: int, node: int) -> tuple[np.ndarray, float, float]:
        """(plane, offset, margin) of a node."""
        planes, offsets, margins = self.planes[tree][level], self.offsets[tree][level], self.margins[tree][level]
        if node in planes:
            return planes[node], offsets[node], margins[node]
        up = node
        while up and up not in self.centres[tree]:
            up >>= 1
        return planes[0], float(self.centres[tree][up] @ planes[0]), margins[0]

    def leaves(self, x: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs of the unit vectors ``x``."""
        rows, nodes = np.arange(len(x)), np.ones(len(x), np.int64)
        for level in range(self.depth):
            order = np.argsort(nodes, kind="stable")
            rows, nodes = rows[order], nodes[order]
            names, starts = np.unique(nodes, return_index=True)
            parts = []
            for name, some in zip(names.tolist(), np.split(rows, starts[1:]), strict=True):
                plane, offset, margin = self.split(tree, level, name)
                side = x[some] @ plane - offset
                for child, here in ((2 * name, some[side < margin]), (2 * name + 1, some[side >= -margin])):
                    parts.append((here, np.full(len(here), child)))
            rows, nodes = (np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (rows, nodes)
        return rows, nodes


def route(forests: dict[int, Forest]):
    """Each vector with the sorted list of its leaves (tree * 2^40 + node)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, len(batch), ROW_GROUP):
                part = batch.slice(at, ROW_GROUP)
                sizes = part.column("size").to_numpy()
                for size in np.unique(sizes):
                    rows = part.filter(pa.array(sizes == size))
                    x = unit(matrix(rows.column("vector")))
                    row, leaf = [], []
                    for tree in range(len(forests[int(size)].planes)):
                        r, n = forests[int(size)].leaves(x, tree)
                        row.append(r)
                        leaf.append(n + (tree << 40))
                    row, leaf = np.concatenate(row), np.concatenate(leaf)
                    order = np.lexsort((leaf, row))
                    bounds = np.searchsorted(row[order], np.arange(len(x) + 1))
                    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(leaf[order]))
                    yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("id", "label", "size", "copies", "vector")), lists], names=["id", "label", "size", "copies", "vector", "leaves"])

    return run


def compare_leaf(table, threshold: float):
    """Links of the vectors of a tile, or between two tiles, of one leaf: (id, links, root)."""
    import pyarrow as pa

    ids, copies, tile = (table.column(c).combine_chunks().to_numpy() for c in ("id", "copies", "tile"))
    order = np.argsort(ids, kind="stable")
    ids, copies, tile = ids[order], copies[order], tile[order]
    x = matrix(table.column("vector").combine_chunks().take(pa.array(order)))
    leaves = table.column("leaves").combine_chunks().take(pa.array(order))
    here = table.column("leaf")[0].as_py()
    n = len(ids)
    near = unit(x)
    links, root = np.zeros(n, np.int64), np.arange(n)
    width = int(np.diff(leaves.offsets.to_numpy()).max())
    held = np.full((n, width), -1, np.int64)
    for k, some in enumerate(leaves.to_pylist()):
        held[k, : len(some)] = some
    lengths = np.sqrt((x * x).sum(axis=1))
    safe = np.isfinite(lengths).all() and (lengths > 0).all()
    for a in range(0, n, 256):
        left, right = np.nonzero(near[a : a + 256] @ near.T >= threshold - 1e-9)
        left += a
        upper = left < right
        if table.column("ta")[0].as_py() != table.column("tb")[0].as_py():
            upper &= tile[left] != tile[right]
        left, right = left[upper], right[upper]
        for s in range(0, len(left), 20_000):
            i, j = left[s : s + 20_000], right[s : s + 20_000]
            exact = (x[i] * x[j]).sum(axis=1) / (lengths[i] * lengths[j]) if safe else (near[i] * near[j]).sum(axis=1)
            i, j = i[exact >= threshold], j[exact >= threshold]
            common = (held[i][:, :, None] == held[j][:, None, :]) & (held[i] >= 0)[:, :, None]
            first = np.where(common.any(axis=2), held[i], np.iinfo(np.int64).max).min(axis=1)
            i, j = i[first == here], j[first == here]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            while len(i):
                low = np.minimum(root[i], root[j])
                before = root.copy()
                np.minimum.at(root, root[i], low)
                np.minimum.at(root, root[j], low)
                root = root[root]
                if (root == before).all():
                    break
    some = np.flatnonzero(links)
    return pa.table({"id": pa.array(ids[some], pa.int64()), "links": pa.array(links[some], pa.int64()), "root": pa.array(ids[root[some]], pa.int64())})


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, leaf_rows: int = LEAF_ROWS, spill: float = SPILL, recall: float = RECALL, sample_rows: int = SAMPLE_ROWS, seed: int = 0) -> DataFrame:
    """One row a vector: id, n_links, component_id (smallest id reachable) and kept (its own component)."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == F.lit(float("inf"))))
    fit = v.isNotNull() & F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & F.coalesce(~bad, F.lit(False)) & F.coalesce(F.exists(v, lambda e: e != 0), F.lit(False))
    keyed = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), v.cast("array<double>").alias("vector"), F.coalesce(fit, F.lit(False)).alias("fit"))
    keyed = keyed.withColumn("h1", F.when(F.col("fit"), F.xxhash64("vector"))).withColumn("h2", F.when(F.col("fit"), F.xxhash64(F.lit(1), "vector")))
    reps = cut(keyed.where("fit").groupBy("label", "h1", "h2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector")).withColumn("size", F.size("vector")), "vectors")
    forests: dict[int, Forest] = {}
    for row in reps.groupBy("size", "label").count().groupBy("size").agg(F.max("count").alias("most")).collect():
        depth = max(0, ceil(log2(max(1.0, row["most"] / leaf_rows))))
        of_size = reps.where(F.col("size") == row["size"])
        sample = of_size.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample_rows).select("vector").toPandas()["vector"]
        x = unit(np.array(sample.tolist(), np.float64).reshape(len(sample), row["size"]))
        forests[row["size"]] = Forest(x, depth, spill, threshold, recall, seed)
    routed = cut(reps.select("id", "label", "size", "copies", "vector").mapInArrow(route(forests), "id long, label string, size int, copies long, vector array<double>, leaves array<long>"), "routed")
    at = ["label", "size", "leaf"]
    held = routed.select("label", "size", F.explode("leaves").alias("leaf")).groupBy(*at).agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    parts = F.ceil(F.col("held") / F.lit(2 * leaf_rows)).cast("int")
    dealt = routed.withColumn("leaf", F.explode("leaves")).join(held, at).withColumn("parts", parts).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumn("ta", F.least("tile", "other")).withColumn("tb", F.greatest("tile", "other")).drop("other", "held", "parts", "size")
    found = cut(dealt.groupBy("label", "leaf", "ta", "tb").applyInArrow(lambda t: compare_leaf(t, threshold), "id long, links long, root long"), "links")
    release(routed)
    roots = components(found, "id", "root").select(F.col("node").alias("id"), "component")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    done = reps.select("id", "label", "h1", "h2", "copies").join(counts, "id", "left").join(roots, "id", "left")
    done = done.select("label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "id").alias("component"))
    component = F.coalesce("component", "id")
    return keyed.drop("vector").join(done, ["label", "h1", "h2"], "left").select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))

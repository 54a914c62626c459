"""Hard-negative mining with vantage-point trees over norm-augmented vectors.

A vector v gets one more component, sqrt(M^2 - |v|^2) for the largest norm M, and an anchor q a zero, so
that |q - v|^2 = |q|^2 + M^2 - 2 q.v: higher inner products are smaller distances, and a window of scores
is an annulus around the anchor.  Components are floor(``SCALE`` * x), so scores are whole numbers.

The top of the tree is grown on a bounded sample (``SAMPLE_ROWS``) and cuts the space into cells of about
``CELL_ROWS`` vectors, as far as the sample can place them; every vector is routed to one cell, and the
cells keep the real bounds of all their vectors' distances to the vantage points above them.  A cell's
vectors are dealt by a hash of their ids into blocks of bounded size, and a task grows the tree of its
block down to ``LEAF_ROWS`` and walks it for the anchors that come to the block, themselves in chunks of
``CHUNK_ANCHORS``.  The walk takes nodes nearest first from a heap, leaves out those that lie wholly inside
or outside of the annulus, and ends when every window has its rows and no node left can hold better ones.

Anchors go to the nearest cell first, which bounds their windows from below; a second round visits the
other cells that can still hold something better.  Nothing is approximate: the result equals the
comparison with all rows.  Rounds of the same form find the positives (same label, no window) and then the
negatives (other labels, a window for each positive).

Defined cases: a row whose id, label or vector is null, or whose vector holds a null or non-finite
component, takes no part, nor does one whose scaled square norm reaches 2^53 (scores would not be exact);
a shorter vector counts as padded with zeros; an id counts once, with its smallest (label, vector); an
anchor without positives, or whose positive's score is negative, has no rows for it; an empty table gives
an empty result; further columns don't matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import ceil, inf, log2, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crivo.llm._common import cut, release

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: Bounds of a negative's score in hundredths of the positive's.
LOW, HIGH = 30, 90
SAMPLE_ROWS = 4096
#: Sampled vectors that a cell of the top tree must hold.
SAMPLE_NODE = 32
CELL_ROWS = 2048
LEAF_ROWS = 256
CHUNK_ANCHORS = 1024
EXACT = float(1 << 53)
ROW_GROUP = 4096


def matrix(column, width: int) -> np.ndarray:
    """Rows of an Arrow list column as a matrix of doubles, shorter ones padded with zeros."""
    out = np.zeros((len(column), width))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    rows = np.repeat(np.arange(len(column)), sizes)
    places = np.arange(len(flat)) - np.repeat(np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) if len(flat) else np.zeros(0, np.int64)
    out[rows, places] = flat
    return out


def augmented(x: np.ndarray, square: float) -> np.ndarray:
    return np.concatenate((x, np.sqrt(np.maximum(0.0, square - (x * x).sum(axis=1)))[:, None]), axis=1)


def vantage_point(x: np.ndarray) -> np.ndarray:
    """The row farthest from the first one: points at the edge tell the others apart best."""
    return x[int(np.argmin(x @ x[0]))]


class Tree:
    """A vantage-point tree: a node is an array of rows, or a point and its (low, high, node) children."""

    def __init__(self, x: np.ndarray, square: float, leaf_rows: int, most_depth: float = inf) -> None:
        self.x, self.square, self.leaf_rows = augmented(x, square), square, leaf_rows
        self.root = self.grown(np.arange(len(x)), most_depth)

    def grown(self, rows: np.ndarray, depth: float):
        if len(rows) <= self.leaf_rows or depth <= 0:
            return rows
        point = vantage_point(self.x[rows])
        away = np.sqrt(np.maximum(0.0, 2 * self.square - 2 * (self.x[rows] @ point)))
        radius = float(np.median(away))
        inner = away <= radius
        if inner.all():
            return rows
        parts = [(float(away[s].min()), float(away[s].max()), self.grown(rows[s], depth - 1)) for s in (inner, ~inner)]
        return point, radius, parts


    def packed(self) -> np.ndarray:
        """Put the rows of each leaf side by side, which leaves become slices of; the rows' new order."""
        order: list[np.ndarray] = []

        def place(node):
            if isinstance(node, np.ndarray):
                start = sum(map(len, order))
                order.append(node)
                return slice(start, start + len(node))
            return node[0], node[1], [(low, high, place(part)) for low, high, part in node[2]]

        self.root = place(self.root)
        rows = np.concatenate(order)
        self.x = self.x[rows]
        return rows


class Cells:
    """The leaves of a top tree, numbered; what routes vectors to them and bounds anchors' distances."""

    def __init__(self, tree: Tree) -> None:
        self.square = tree.square
        self.points: list[np.ndarray] = []
        self.radii: list[float] = []
        self.paths: list[list[int]] = []
        self.child: list[list[int]] = []
        self.number(tree.root, [])
        self.vantage = np.array(self.points).reshape(len(self.points), tree.x.shape[1])
        self.depth = max(map(len, self.paths))

    def number(self, node, path: list[int]) -> int:
        """A leaf's place is ~cell, an inner node's its index."""
        if isinstance(node, np.ndarray):
            self.paths.append(path)
            return ~(len(self.paths) - 1)
        at = len(self.points)
        self.points.append(node[0])
        self.radii.append(node[1])
        self.child.append([])
        self.child[at] = [self.number(part[2], [*path, at]) for part in node[2]]
        return at

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector, and its distances to the points above (NaN below the cell)."""
        full = augmented(x, self.square)
        place = np.full(len(x), 0 if self.points else ~0)
        away = np.full((len(x), self.depth), np.nan)
        for level in range(self.depth):
            for at in np.unique(place[place >= 0]):
                rows = np.flatnonzero(place == at)
                d = np.sqrt(np.maximum(0.0, 2 * self.square - 2 * (full[rows] @ self.vantage[at])))
                away[rows, level] = d
                place[rows] = np.where(d <= self.radii[at], *self.child[at])
        return ~place, away

    def bounds(self, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, most): bounds of the scores of every anchor with the vectors of every cell.

        ``low`` and ``high`` bound the cells' distances by level.
        """
        norms = (q * q).sum(axis=1)
        d = np.sqrt(np.maximum(0.0, norms[:, None] + self.square - 2 * (q @ self.vantage[:, :-1].T)))
        near, far = np.zeros((len(q), len(self.paths))), np.full((len(q), len(self.paths)), inf)
        for cell, path in enumerate(self.paths):
            for level, at in enumerate(path):
                near[:, cell] = np.maximum(near[:, cell], np.maximum(d[:, at] - high[cell, level], low[cell, level] - d[:, at]))
                far[:, cell] = np.minimum(far[:, cell], d[:, at] + high[cell, level])
        return scores_within(norms[:, None] + self.square, near, far, self.square)


def scores_within(total, near, far, square: float):
    """(least, most) of the score at distances from ``near`` to ``far``, with room for rounding."""
    slack = 1e-6 * sqrt(square) + 1e-6
    return (total - (far + slack) ** 2) / 2, (total - np.maximum(0.0, near - slack) ** 2) / 2


class Windows:
    """What an anchor looks for: for each window up to ``k`` rows, best first, with scores from lo to hi."""

    def __init__(self, lo: list, hi: list, k: int) -> None:
        self.k = k
        self.lo, self.hi = list(lo), list(hi)
        self.open = [w for w in range(len(self.lo)) if self.lo[w] <= self.hi[w]]
        self.scores: list[np.ndarray] = [np.zeros(0)] * len(self.lo)
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64)] * len(self.lo)

    def close(self, most: float) -> None:
        """Close windows that have all they want, or lie above, where only scores up to ``most`` are left."""
        self.open = [w for w in self.open if most >= self.lo[w] and (len(self.ids[w]) < self.k or most >= self.scores[w][-1])]

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(scores):
            return
        least, most = scores.min(), scores.max()
        for w in self.open:
            if most < self.lo[w] or least > self.hi[w] or len(self.ids[w]) == self.k and most < self.scores[w][-1]:
                continue
            fit = (scores >= self.lo[w]) & (scores <= self.hi[w])
            if len(self.ids[w]) == self.k:
                fit &= scores >= self.scores[w][-1]
            if fit.any():
                s, i = np.concatenate((self.scores[w], scores[fit])), np.concatenate((self.ids[w], ids[fit]))
                best = np.lexsort((i, -s))[: self.k]
                self.scores[w], self.ids[w] = s[best], i[best]


def walk(tree: Tree, ids: np.ndarray, wanted: np.ndarray, q: np.ndarray, windows: Windows) -> None:
    """Fill the windows from the wanted rows of a packed tree, nodes nearest to ``q`` first."""
    total = float(q @ q) + tree.square
    heap = [(0.0, 0, inf, tree.root)]
    pushed = 0
    while heap and windows.open:
        near, _, far, node = heapq.heappop(heap)
        least, most = scores_within(total, near, far, tree.square)
        windows.close(most)
        if not any(least <= windows.hi[w] for w in windows.open):
            continue
        if isinstance(node, slice):
            here = wanted[node]
            windows.add((tree.x[node, :-1] @ q)[here], ids[node][here])
            continue
        point, _, parts = node
        d = sqrt(max(0.0, total - 2 * float(point[:-1] @ q)))
        for low, high, part in parts:
            pushed += 1
            heapq.heappush(heap, (max(near, d - high, low - d), pushed, min(far, d + high), part))


def mine(key, block, asked, square: float, width: int, k: int, same: bool):
    """(anchor, window, id, score) that a block has for the anchors that come to it."""
    import pyarrow as pa

    anchor, window, found, score = [], [], [], []
    if len(block) and len(asked):
        ids = block.column("id").combine_chunks().to_numpy()
        x = matrix(block.column("q").combine_chunks(), width)
        tree = Tree(x, square, LEAF_ROWS)
        order = tree.packed()
        names = {}
        label = np.array([names.setdefault(v, len(names)) for v in block.column("label").to_pylist()])
        ids, label = ids[order], label[order]
        queries = matrix(asked.column("q").combine_chunks(), width)
        for row, (a, of, lo, hi) in enumerate(zip(*(asked.column(c).to_pylist() for c in ("anchor", "label", "lo", "hi")), strict=True)):
            own = names.get(of, -1)
            wanted = (label == own) & (ids != a) if same else label != own
            windows = Windows(lo, hi, k)
            walk(tree, ids, wanted, queries[row], windows)
            for w, (s, i) in enumerate(zip(windows.scores, windows.ids, strict=True)):
                anchor += [a] * len(i)
                window += [w] * len(i)
                found += i.tolist()
                score += s.astype(np.int64).tolist()
    return pa.table({"anchor": pa.array(anchor, pa.int64()), "window": pa.array(window, pa.int32()), "id": pa.array(found, pa.int64()), "score": pa.array(score, pa.int64())})


FOUND = "anchor long, window int, id long, score long"


class Index:
    """Routed vectors in bounded blocks, with what is needed to send anchors to them."""

    def __init__(self, rows: DataFrame, sample_rows: int, cell_rows: int) -> None:
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(square_norm(F.col("q"))).alias("square"), F.max(F.size("q")).alias("width")).first()
        self.n, self.square, self.width, self.cell_rows = size["n"], float(size["square"] or 0.0), size["width"] or 0, cell_rows
        few = rows.orderBy(F.xxhash64(F.lit(11), "id"), "id").limit(sample_rows).select("q").toPandas()["q"]
        sample = np.zeros((len(few), self.width))
        for k, q in enumerate(few):
            sample[k, : len(q)] = q
        depth = max(0, ceil(log2(max(1.0, self.n / cell_rows))))
        self.cells = Cells(Tree(sample, self.square, SAMPLE_NODE, depth))
        self.routed = cut(rows.select("id", "label", "q").mapInArrow(self.route, "id long, label string, q array<double>, cell int, away array<double>"), "routed")
        held = self.routed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[f(F.get("away", F.lit(k))).alias(f"{f.__name__}_{k}") for k in range(self.cells.depth) for f in (F.min, F.max)]).collect()
        shape = (len(self.cells.paths), self.cells.depth)
        self.low, self.high, self.counts = np.full(shape, inf), np.full(shape, -inf), np.zeros(shape[0], np.int64)
        for r in held:
            self.counts[r["cell"]] = r["n"]
            for k in range(len(self.cells.paths[r["cell"]])):
                self.low[r["cell"], k], self.high[r["cell"], k] = r[f"min_{k}"], r[f"max_{k}"]

    def route(self, batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, len(batch), ROW_GROUP):
                part = batch.slice(at, ROW_GROUP)
                cell, away = self.cells.route(matrix(part.column(2), self.width))
                lists = pa.ListArray.from_arrays(pa.array(range(0, away.size + 1, max(1, away.shape[1])) if away.size else [0] * (len(part) + 1), pa.int32()), pa.array(away.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), lists], names=["id", "label", "q", "cell", "away"])

    def visits(self, home: bool):
        """(request, cell) rows: the cell that may hold the best rows, or all others that may hold any."""
        cells, low, high, filled, width = self.cells, self.low, self.high, self.counts > 0, self.width

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                for at in range(0, len(batch), ROW_GROUP):
                    part = batch.slice(at, ROW_GROUP)
                    least, most = cells.bounds(matrix(part.column("q"), width), low, high)
                    may = np.zeros(most.shape, bool)
                    for r, (lo, hi) in enumerate(zip(part.column("lo").to_pylist(), part.column("hi").to_pylist(), strict=True)):
                        for a, b in zip(lo, hi, strict=True):
                            if a <= b:
                                may[r] |= (most[r] >= a) & (least[r] <= b)
                    may &= filled
                    if home:
                        best = np.where(may, most, -inf).argmax(axis=1)
                        row = np.flatnonzero(may.any(axis=1))
                        cell = best[row]
                    else:
                        seen = part.column("home").to_numpy(zero_copy_only=False)
                        may[np.arange(len(part)), seen] = False
                        row, cell = np.nonzero(may)
                    for k in range(0, len(row), ROW_GROUP):
                        some = part.select(["anchor", "label", "q", "lo", "hi"]).take(pa.array(row[k : k + ROW_GROUP]))
                        yield pa.RecordBatch.from_arrays([*some.columns, pa.array(cell[k : k + ROW_GROUP].astype(np.int32))], names=["anchor", "label", "q", "lo", "hi", "cell"])

        return run

    def round(self, requests: DataFrame, home: bool, k: int, same: bool) -> tuple[DataFrame, DataFrame]:
        """(visits, found) of one round over (anchor, label, q, lo, hi) rows, with home where it was visited."""
        kinds = "anchor long, label string, q array<double>, lo array<long>, hi array<long>, cell int"
        visits = cut(requests.mapInArrow(self.visits(home), kinds), "visits")
        asked = {r["cell"]: r["n"] for r in visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        blocks = F.array(*[F.lit(max(1, ceil(int(n) / self.cell_rows))) for n in self.counts])
        chunks = F.array(*[F.lit(ceil(asked.get(c, 0) / CHUNK_ANCHORS)) for c in range(len(self.counts))])
        parts = lambda of: F.sequence(F.lit(0), F.get(of, F.col("cell")) - 1)
        vectors = self.routed.where(F.get(chunks, F.col("cell")) > 0).select("id", "label", "q", "cell", F.pmod(F.xxhash64("id"), F.get(blocks, F.col("cell"))).cast("int").alias("block"), F.explode(parts(chunks)).alias("chunk"))
        dealt = visits.select("*", F.pmod(F.xxhash64("anchor"), F.get(chunks, F.col("cell"))).cast("int").alias("chunk"), F.explode(parts(blocks)).alias("block"))
        square, width = self.square, self.width
        at = ("cell", "block", "chunk")
        found = vectors.groupBy(*at).cogroup(dealt.groupBy(*at)).applyInArrow(lambda key, x, y: mine(key, x, y, square, width, k, same), FOUND)
        return visits, best(cut(found, "found"), k)

    def search(self, requests: DataFrame, k: int, same: bool) -> DataFrame:
        """(anchor, window, id, score, rank): the first ``k`` rows of each window, from all cells."""
        visits, first = self.round(requests, True, k, same)
        first = cut(first, "nearest")
        # The k-th score so far is what another cell has to reach.
        full = first.where(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("reached"))
        lows = F.transform("lo", lambda x, w: F.coalesce(F.greatest(x, F.try_element_at("reached", w)), x))
        raised = visits.withColumnRenamed("cell", "home").join(full, "anchor", "left").select("anchor", "label", "q", lows.alias("lo"), "hi", "home")
        others, more = self.round(raised, False, k, same)
        both = cut(best(first.drop("rank").unionByName(more.drop("rank")), k), "best")
        release(visits, others, first)
        return both


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def square_norm(q: Column) -> Column:
    return F.aggregate(q, F.lit(0.0), lambda s, e: s + e * e)


def usable(vectors: DataFrame, anchors: Column, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, q, anchor) of the rows that take part, an id once."""
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(inf)))
    named = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), F.col(vector_col).cast("array<double>").alias("v"))
    whole = named.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    scaled = whole.select("id", "label", "anchor", F.transform("v", lambda e: F.floor(F.lit(float(scale)) * e).cast("double")).alias("q")).where(square_norm(F.col("q")) < EXACT)
    return scaled.groupBy("id").agg(F.min(F.struct("label", "q", "anchor")).alias("r")).select("id", "r.label", "r.q", "r.anchor")


def hard_negatives(vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, sample_rows: int = SAMPLE_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows for which ``anchors`` holds.

    Positives are an anchor's best rows of its label; a positive's negatives are the best rows of other
    labels whose score lies from ``low`` to ``high`` hundredths of the positive's.
    """
    rows = cut(usable(vectors, anchors, id_col, vector_col, label_col, scale), "vectors")
    index = Index(rows, sample_rows, cell_rows)
    asking = rows.where("anchor").select(F.col("id").alias("anchor"), "label", "q")
    widest = 1 << 53
    near = index.search(asking.select("*", F.array(F.lit(-widest)).alias("lo"), F.array(F.lit(widest)).alias("hi")), positives, True)
    windows = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct(F.col("rank"), F.col("id").alias("positive"), F.col("score")))).alias("of"))
    hundredth = lambda x: F.call_function("div", x, F.lit(100))
    lo = F.transform("of", lambda x: F.when(x["score"] >= 0, hundredth(x["score"] * low + 99)).otherwise(F.lit(1)))
    hi = F.transform("of", lambda x: F.when(x["score"] >= 0, hundredth(x["score"] * high)).otherwise(F.lit(0)))
    mined = index.search(asking.join(windows, "anchor").select("anchor", "label", "q", lo.alias("lo"), hi.alias("hi")), negatives, False)
    paired = mined.join(near.select("anchor", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive"), F.col("score").alias("positive_score")), ["anchor", "window"])
    return paired.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

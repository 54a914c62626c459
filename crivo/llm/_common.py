"""Helpers shared by the training-data operators: tables, durable cuts of lineage, hashing of words.

``cut`` writes a table into the shared folder that the session names in ``spark.checkpoint.dir`` and
reads it back, so that lost executors cost a re-read and not a recomputation; ``release`` deletes a table
that nothing reads any more.  Nothing here collects rows to the driver.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed, return.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"
SHINGLE_WORDS = 5

U64 = np.uint64
CHUNK_BYTES = 2 << 20
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by the session; one of our own only in local mode, where the setting may be absent."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-crivo-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table.

    What the writing job shuffled is removed when it ends: later jobs read the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/crivo/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_SHUFFLES)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` once everything that reads them is written itself; a late read fails."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(column: Column | str) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a text as an array, without empty strings."""
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not use yet, also when compared without case."""
    taken = {c.lower() for c in df.columns}
    name, k = stem, 0
    while name.lower() in taken:
        k += 1
        name = f"{stem}_{k}"
    return name


# --- hashing of words and shingles -----------------------------------------------------------------


def splitmix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator, on unsigned 64-bit arrays."""
    with np.errstate(over="ignore"):
        x = x + U64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_BYTE = splitmix(np.arange(256, dtype=U64) + U64(977))
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) <= n:
        size = 1 << max(16, (n + 1).bit_length())
        tables = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                tables.append(np.multiply.accumulate(steps))
        _powers[:] = tables
    return _powers[0], _powers[1]


def string_buffers(array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array; nulls count as empty."""
    import pyarrow as pa

    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    kind = np.int64 if wide else np.int32
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES):
    """Row ranges of at most ``most`` bytes each (a longer text stands alone)."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def word_hashes(data: np.ndarray, offsets: np.ndarray, with_places: bool = False) -> tuple[np.ndarray, ...]:
    """Hash of every word of the texts in ``data``, the row that each stands in, and its bounds if asked for.

    Long texts are walked in ranges that end at white space, so memory beside the result stays bounded.
    """
    parts, at = [], 0
    while at < len(data):
        upto = at + CHUNK_BYTES
        while upto < len(data) and not _IS_SPACE[data[upto]]:
            gaps = np.flatnonzero(_IS_SPACE[data[upto : upto + CHUNK_BYTES]])
            upto = upto + int(gaps[0]) if len(gaps) else upto + CHUNK_BYTES
        upto = min(upto, len(data))
        first, last = np.searchsorted(offsets, (at, upto), "left")
        hashes, starts, ends = _words_in(data[at:upto], offsets[first:last] - at)
        parts.append((hashes, starts + at, ends + at))
        at = upto
    if not parts:
        nowhere = np.zeros(0, np.int64)
        return (np.zeros(0, U64), nowhere, nowhere, nowhere)[: 4 if with_places else 2]
    hashes, starts, ends = (np.concatenate(x) if len(parts) > 1 else x[0] for x in zip(*parts, strict=True))
    rows = np.searchsorted(offsets, starts, "right") - 1
    return (hashes, rows, starts, ends) if with_places else (hashes, rows)


def _words_in(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the words of a range of bytes in which texts begin at ``begins``."""
    word = ~_IS_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[begins] = True
    before = np.concatenate(([False], word[:-1])) & ~edge[:-1]
    after = np.concatenate((word[1:], [False])) & ~edge[1:]
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    up, down = _power_tables(len(data))
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, U64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=U64)))
        return splitmix((sums[ends] - sums[starts]) * down[starts]), starts, ends


_FACTORS = splitmix(np.arange(64, dtype=U64) + U64(31)) | U64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of every text, row after row, each row's sorted, and where rows begin.

    A text of fewer than ``size`` words, but one at least, has one shingle: all its words.
    """
    words, rows = word_hashes(data, offsets)
    n_rows = len(offsets) - 1
    counts = np.bincount(rows, minlength=n_rows) if len(rows) else np.zeros(n_rows, np.int64)
    with np.errstate(over="ignore"):
        if len(words) >= size:
            n = len(words) - size + 1
            mixed = np.zeros(n, U64)
            for k in range(size):
                mixed += words[k : k + n] * _FACTORS[k]
            whole = rows[:n] == rows[size - 1 :]
            full, full_rows = splitmix(mixed[whole]), rows[:n][whole]
        else:
            full, full_rows = np.zeros(0, U64), np.zeros(0, np.int64)
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):
            begin = np.concatenate(([0], np.cumsum(counts)))
            lone = np.array([int(sum(int(words[begin[r] + k]) * int(_FACTORS[k]) for k in range(counts[r]))) % (1 << 64) for r in short], dtype=U64)
            lone = splitmix(lone ^ (counts[short].astype(U64) * _FACTORS[40]))
            full, full_rows = np.concatenate((full, lone)), np.concatenate((full_rows, short))
            order = np.argsort(full_rows, kind="stable")
            full, full_rows = full[order], full_rows[order]
    starts = np.concatenate(([0], np.cumsum(np.bincount(full_rows, minlength=n_rows) if len(full_rows) else np.zeros(n_rows, np.int64))))
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a > 1:
            full[a:b].sort()
    if len(full):
        first = np.ones(len(full), dtype=bool)
        first[1:] = (full[1:] != full[:-1]) | (full_rows[1:] != full_rows[:-1])
        full, full_rows = full[first], full_rows[first]
        starts = np.concatenate(([0], np.cumsum(np.bincount(full_rows, minlength=n_rows))))
    return full, starts


def set_keys(shingles: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for the content of each set (zero for an empty one)."""
    keys = []
    lengths = np.diff(starts)
    for salt in (0x51, 0xA7):
        total = np.zeros(len(lengths), U64)
        if len(shingles):
            full = np.flatnonzero(lengths > 0)
            with np.errstate(over="ignore"):
                total[full] = np.add.reduceat(splitmix(shingles ^ splitmix(np.array([salt], U64))), starts[full])
        keys.append(total)
    return keys[0], keys[1]


def min_hashes(shingles: np.ndarray, starts: np.ndarray, n_hashes: int) -> np.ndarray:
    """MinHash values, one row a set; empty sets get zeros."""
    lengths = np.diff(starts)
    out = np.zeros((len(lengths), n_hashes), np.uint32)
    full = np.flatnonzero(lengths > 0)
    if not len(full):
        return out
    masks = splitmix(np.arange(n_hashes, dtype=U64) + U64(1009)).astype(np.uint32)
    factors = splitmix(np.arange(n_hashes, dtype=U64) + U64(5003)).astype(np.uint32) | np.uint32(1)
    for a, b in chunks(starts[np.concatenate((full, [len(lengths)]))], 60_000):
        ids = full[a:b]
        begin = starts[ids[0]]
        part = shingles[begin : starts[ids[-1] + 1]]
        at = starts[ids] - begin
        # Two halves, so that sets whose low halves agree by chance still differ in most values.
        low, high = part.astype(np.uint32), (part >> U64(32)).astype(np.uint32)
        with np.errstate(over="ignore"):
            for k in range(n_hashes):
                mixed = (low ^ masks[k]) * factors[k]
                mixed ^= mixed >> np.uint32(15)
                mixed += high * factors[(k * 7 + 3) % n_hashes]
                out[ids, k] = np.minimum.reduceat(mixed, at)
    return out


#: Edges that one task labels at once (some 20 MB); larger graphs are contracted first.
SMALL_GRAPH = 1_000_000


def labelled(table):
    """(node, component) of a bounded edge list (a, b), by union and find."""
    import pyarrow as pa

    nodes, ends = np.unique(np.concatenate([table.column(c).to_numpy() for c in ("a", "b")]), return_inverse=True)
    up = list(range(len(nodes)))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(*ends.reshape(2, -1).tolist(), strict=True):
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return pa.table({"node": pa.array(nodes), "component": pa.array(nodes[[top(x) for x in range(len(nodes))]])})


def components(edges: DataFrame, a: str = "a", b: str = "b", small: int = SMALL_GRAPH) -> DataFrame:
    """Connected components of an edge list of longs: (node, component), component the smallest node reached.

    In each round every node hooks to the neighbour (or itself) that is first in an order drawn anew from
    a hash, jumps once and the edges are contracted, so that about a third of the nodes is left whatever
    their numbering: chains of ascending ids take as many rounds as any others.  Once ``small`` edges or
    fewer are left, one task labels them.  Every round's tables are cut.  Nodes without an edge do not
    appear.
    """
    left = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = cut(left, "edges")
    found: DataFrame | None = None
    turn = 0

    def carried(moved: DataFrame) -> DataFrame:
        """The labels so far after a step (node, up) of the contracted nodes."""
        if found is None:
            return moved.select("node", F.col("up").alias("component"))
        step = moved.select(F.col("node").alias("component"), "up")
        return found.join(step, "component", "left").select("node", F.coalesce("up", "component").alias("component"))

    while left.count() > small:
        rank = lambda c, turn=turn: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("v"))
        both = left.select(F.col("b").alias("node"), F.col("a").alias("near")).unionByName(left.select(F.col("a").alias("node"), F.col("b").alias("near")))
        best = both.groupBy("node").agg(F.min(rank("near")).alias("m"))
        hook = best.select("node", F.least(F.col("m"), rank("node"))["v"].alias("up"))
        top = hook.select(F.col("node").alias("up"), F.col("up").alias("upper"))
        jump = cut(hook.join(top, "up").select("node", F.col("upper").alias("up")), "jumps")
        ends = jump.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        other = jump.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        moved = left.join(ends, "a").join(other, "b").where("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct()
        left, found, turn = cut(moved, "edges"), cut(carried(jump), "labels") if turn else carried(jump), turn + 1
    rest = left.groupBy().applyInArrow(labelled, "node long, component long")
    if found is None:
        return cut(rest, "labels")
    found = cut(carried(rest.withColumnRenamed("component", "up")), "labels")
    least = found.groupBy("component").agg(F.min("node").alias("least"))
    return found.join(least, "component").select("node", F.col("least").alias("component"))

"""Hard negatives, the filter audit and the compression classifier."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from crivo.llm import compression_quality as C
from crivo.llm import hard_negatives as H
from crivo.llm import queries
from crivo.llm.filter_audit import filter_audit

from .conftest import prose

# --- 11: hard negatives ---

VECTORS = "vec_id long, embedding array<float>, label int"


def by_hand(rows, anchor, positives=5, negatives=10):
    kept = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(e is not None and math.isfinite(e) for e in v):
            q = [math.floor(256 * float(np.float32(e))) for e in v]
            kept[i] = min(kept.get(i, ("~", [])), (str(label), q))
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for a, (label, q) in kept.items():
        if anchor(a):
            scored = sorted((-dot(q, w), i, of) for i, (of, w) in kept.items() if i != a)
            for s, i, _ in [x for x in scored if x[2] == label][:positives]:
                fit = [(t, j) for t, j, of in scored if of != label and 30 * -s <= 100 * -t <= 90 * -s]
                out += [(a, i, k + 1, j, -s, -t) for k, (t, j) in enumerate(fit[:negatives])]
    return sorted(out)


def mined(table, **options):
    return sorted(map(tuple, H.hard_negatives(table, F.col("vec_id") % 20 == 0, **options).collect()))


def vectors(seed, n, dims=8):
    dice = np.random.default_rng(seed)
    centres = dice.standard_normal((6, dims))
    rows = []
    for k in range(n):
        c = int(dice.integers(6))
        v = (centres[c] + 0.5 * dice.standard_normal(dims)) * float(dice.uniform(0.2, 2))
        rows.append((k, [float(np.float32(x)) for x in v], int((c + (dice.random() < 0.2)) % 5)))
    return rows


@pytest.mark.parametrize("cell_rows", [40, 2048])
def test_negatives_equal_brute_force(spark, cell_rows):
    rows = vectors(1, 600)
    # Copies of one vector make ties and a hot cell; a repeated row counts once; odd rows take no part.
    rows += [(1000 + k, rows[40][1], k % 3) for k in range(150)] + [rows[5], (7, None, 1), (None, [1.0] * 8, 1), (2000, [1.0] * 8, None), (2020, [float("nan")] * 8, 1), (2040, [None] * 8, 1), (2060, [], 1), (2080, [1.0, 2.0], 2), (2100, [0.0] * 8, 3)]
    table = spark.createDataFrame(rows, VECTORS).withColumns({n: F.lit(1) for n in ("id", "q", "cell", "anchor", "rank")})
    want = by_hand(rows, lambda i: i % 20 == 0)
    assert want and mined(table, cell_rows=cell_rows) == want


def test_walk_visits_few_leaves():
    x = np.array([v for _, v, _ in vectors(2, 3000, 3)])
    x = np.floor(256 * x / np.sqrt((x * x).sum(1, keepdims=True)))
    query = x[17]
    tree = H.Tree(x, float((x * x).sum(1).max()), 64)
    order = tree.packed()
    windows = H.Windows([-(1 << 53)], [1 << 53], 5)
    seen = []
    add = windows.add
    windows.add = lambda s, i: (seen.append(len(s)), add(s, i))
    H.walk(tree, np.arange(len(x))[order], np.ones(len(x), bool), query, windows)
    scores = x @ query
    assert windows.ids[0].tolist() == np.lexsort((np.arange(len(x)), -scores))[:5].tolist()
    assert sum(seen) < len(x) / 3


def test_negatives_of_odd_tables(spark):
    assert mined(spark.createDataFrame([], VECTORS)) == []
    alone = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1), (2, [0.5, 0.0], 2)], VECTORS)
    assert mined(alone) == []  # the only positive scores below zero
    huge = spark.createDataFrame([(0, [1e30], 1), (1, [1.0], 1), (20, [1.0], 1), (3, [0.5], 2)], VECTORS)
    assert mined(huge) == [(20, 1, 1, 3, 65536, 32768)]


# --- 12: filter audit ---


def audit_by_hand(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    texts = defaultdict(list)
    for i, t, *_ in rows:
        texts[t or ""].append(i)
    out = []
    for part in sorted({r[3] or "" for r in rows}):
        docs = []
        for i, t, _, source, *_ in rows:
            if (source or "") != part:
                continue
            t = t or ""
            words = re.findall(r"[^\x20\x09-\x0D]+", t)
            fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and any(j is not None and j < i for j in texts[t])}
            docs.append((i, {f for f in "ABCDE" if fails[f]}))
        shapley = Counter()
        lines = []
        for order in itertools.permutations("ABCDE"):
            gone = set()
            for step, f in enumerate(order, 1):
                failing = {k for k, (_, x) in enumerate(docs) if f in x}
                removed = failing - gone
                shapley[f] += len(removed)
                ids = [docs[k][0] for k in removed]
                lines.append((f, (part, "".join(order), step, len(docs) - len(gone | removed), len(removed), len(failing & gone), sum(x == {f} for _, x in docs), sum(i in good for i in ids), sum(i in toxic for i in ids))))
                gone |= removed
        out += [(*line, shapley[f]) for f, line in lines]
    return sorted(out)


AUDIT = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_equals_brute_force(spark, labels):
    from .conftest import SCHEMA, documents

    shouting = [(20 + k, prose(k, 300).upper() if k % 2 else prose(3, 250) + " #", "en", "a" if k % 3 else "", 0) for k in range(8)]
    varied = [(40 + k, " ".join(f"w{k}x{j}" for j in range(220)) + ("|" if k == 1 else ""), "en", "b", 0) for k in range(3)]
    rows = documents() + shouting + varied + [(50, " ".join(f"w0x{j}" for j in range(220)), "en", "b", 0)]
    table = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(1) for n in ("doc", "h", "part", "failed", "word", "n")})
    marks = [tuple(r) for r in labels.collect()] + [(40, 1, 1), (40, 0, 0), (50, 0, 1)]
    more = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = sorted(map(tuple, filter_audit(table, more).select(*AUDIT).collect()))
    assert got == audit_by_hand(rows, marks)


def test_audit_of_an_empty_table(no_docs, labels):
    assert filter_audit(no_docs, labels).count() == 0


# --- 13: compression classifier ---


def test_scores_tell_good_from_bad_by_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op13_compression_quality(spark, sf).collect()
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [(r.score, known[r.doc_id]) for r in got if r.held_out and r.doc_id in known]
    right = sum((s >= 0.7) == (q == 1) for s, q in held) / len(held)
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    above = sum((g > b) + (g == b) / 2 for g in good for b in bad) / len(good) / len(bad)
    assert right > 0.93 and above > 0.96
    assert sum(s >= 0.7 for s in good) / len(good) > 0.95


def test_held_out_labels_are_not_learned_from(spark, docs):
    ids = [i for i in range(1, 14) if zlib.crc32(str(i).encode()) % 4 == 2]
    rows = [(i, int(i % 2), 0) for i in range(1, 14)]
    turned = [(i, 1 - q if i in ids else q, t) for i, q, t in rows]
    scores = [sorted((str(r.doc_id), r.score) for r in C.quality_scores(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()) for x in (rows, turned)]
    assert ids and scores[0] == scores[1]


def test_scores_of_odd_tables(spark, odd_docs, no_docs, labels):
    got = C.quality_scores(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    empty = {r.score for r in got if r.doc_id in (5, 6)}
    assert len(empty) == 1
    assert C.quality_scores(no_docs, labels).count() == 0
    none = C.quality_scores(odd_docs, labels.where("quality = 1")).collect()
    learned = [i for i, q, _ in map(tuple, labels.collect()) if q == 1 and i in range(1, 14) and zlib.crc32(str(i).encode()) % 4 != 2]
    assert {round(r.score, 9) for r in none} == {round((len(learned) + 1) / (len(learned) + 2), 9)}


def test_curve_is_monotone_and_its_fit_repeats():
    dice = random.Random(3)
    x = np.array([[dice.gauss(0.1 * q, 0.05), 0.0] for q in (0, 1) for _ in range(200)])
    y = np.array([0.0] * 200 + [1.0] * 200)
    curve = C.fitted(x, y)
    values = [curve(d / 100, 0.0) for d in range(-20, 30)]
    assert values == sorted(values) and curve(0.05, 0.0) == pytest.approx(0.5, abs=0.1) and curve == C.fitted(x, y)

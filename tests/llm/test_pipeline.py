"""The pipeline's stages, each held against a plain-Python version on its own input."""

from collections import Counter

import corpus_pipeline
from crivo.llm import line_dedup
from crivo.llm._common import cut
from crivo.llm.quality import quality_rules

from . import brute
from .conftest import SCHEMA, documents

DATA = "/root/testdata/sf0.001"


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def lines_left(rows):
    """Texts without lines that stand in too many documents of their source."""
    n = Counter(s for _, _, _, s, _ in rows)
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r")
    held = Counter((s, x) for _, t, _, s, _ in rows for x in {strip(x) for x in (t or "").split("\n")} - {""})
    often = {(s, x) for (s, x), k in held.items() if k >= line_dedup.MIN_HELD and k > line_dedup.RATIO * n[s]}
    clean = lambda t, s: "\n".join(x for x in t.split("\n") if (s, strip(x)) not in often)
    return sorted((i, clean(t, s), g, s, len(clean(t, s))) for i, t, g, s, _ in rows)


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = cut(stages["quality rules"](spark, docs, DATA), "kept")
    good = {r.doc_id for r in quality_rules(docs, labels).where("kept").collect()}
    assert kept.columns == docs.columns and sorted(rows_of(kept)) == sorted(r for r in rows_of(docs) if r[0] in good)
    clean = cut(stages["line dedup"](spark, kept, DATA), "clean")
    assert clean.columns == docs.columns and sorted(rows_of(clean)) == lines_left(rows_of(kept))
    alone = cut(stages["n-gram Jaccard join"](spark, clean, DATA), "alone")
    found = brute.classes({r[0]: s for r in rows_of(clean) if (s := brute.shingles(r[1]))})
    assert sorted(rows_of(alone)) == sorted(r for r in rows_of(clean) if found.get(r[0], (r[0],))[0] == r[0])
    mixed = cut(stages["mixing sources to target weights"](spark, alone, DATA), "mixed")
    # Every document is read, and again where its source is small.
    assert mixed.columns == docs.columns and set(rows_of(mixed)) == set(rows_of(alone))
    total = lambda df: sum(len((r[1] or "").encode().split()) for r in rows_of(df))
    assert total(alone) <= total(mixed) <= 1.35 * total(alone) and max(Counter(r[0] for r in rows_of(mixed)).values()) <= 2
    packed = stages["best-fit packing"](spark, mixed, DATA).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r[0] for r in rows_of(mixed))
    filled = Counter()
    for r in packed:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048 and len(filled) <= sum(filled.values()) // 2048 + 2


def test_stages_on_odd_and_empty_tables(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (documents(), []):
        table = spark.createDataFrame(rows, SCHEMA)
        for name, stage in corpus_pipeline.STAGES:
            out = cut(stage(spark, table, str(tmp_path)), "stage")
            assert out.count() > 0 or not rows
            if name != "best-fit packing":
                assert out.columns == table.columns

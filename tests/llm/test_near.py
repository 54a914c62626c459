from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from .conftest import documents, edited, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from crivo.llm import _common as C
from crivo.llm.near_sets import band_recall, least_matches, overlaps, tune_bands
from crivo.llm.ngram_join import ngram_jaccard_join, one_of_each
from crivo.llm.paragraph_dedup import paragraph_dedup, remove_paragraphs

from . import brute


@given(st.lists(st.text(alphabet="ab \n\té", max_size=30), max_size=8))
@settings(max_examples=100, deadline=None)
def test_shingle_sets_are_exact(texts):
    data, offsets = C.string_buffers(pa.array(texts, pa.string()))
    found, starts = C.shingle_sets(data, offsets)
    seen = {}
    for k, text in enumerate(texts):
        sets = brute.shingles(text)
        assert starts[k + 1] - starts[k] == len(sets)
        part = frozenset(found[starts[k] : starts[k + 1]].tolist())
        assert seen.setdefault(sets, part) == part


def test_min_hash_estimates_the_similarity():
    a = prose(1, 400)
    texts = [a, edited(a, 2, 8)]
    data, offsets = C.string_buffers(pa.array(texts))
    sets, starts = C.shingle_sets(data, offsets)
    signature = C.min_hashes(sets, starts, 512)
    x, y = map(brute.shingles, texts)
    assert abs((signature[0] == signature[1]).mean() - len(x & y) / len(x | y)) < 0.08


def test_bands_and_pruning_keep_pairs_at_the_threshold():
    assert tune_bands(0.8, 0.999, 3) == 11 or band_recall(0.8, tune_bands(0.8, 0.999, 3), 3) >= 0.999
    need = least_matches(80, 0.8, 1e-6)
    assert need[80] <= 50 and all(b - a in (0, 1) for a, b in zip(need, need[1:], strict=False))


def test_gram_counts_equal_plain_intersections():
    dice = np.random.default_rng(0)
    sets = [np.unique(dice.integers(0, 90, 60).astype(np.uint64)) for _ in range(30)]
    left, right = np.triu_indices(30, 1)
    group = np.zeros(30, np.int64)
    assert overlaps(sets, left, right, group).tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(left, right, strict=True)]


@pytest.mark.parametrize("small", [0, 20, 1000])
def test_components(spark, small):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 205), (205, 203)]
    found = {r.node: r.component for r in C.components(spark.createDataFrame(edges, "a long, b long"), small=small).collect()}
    assert found == {**{k: 1 for k in range(1, 61)}, 100: 100, 101: 100, 200: 200, 205: 200, 203: 200}
    assert C.components(spark.createDataFrame([], "a long, b long"), small=small).collect() == []


def test_components_of_an_ascending_chain_take_few_rounds(spark, monkeypatch):
    names, write = [], C.cut
    monkeypatch.setattr(C, "cut", lambda df, name: names.append(name) or write(df, name))
    n = 10_000
    found = C.components(spark.range(n).selectExpr("id AS a", "id + 1 AS b"), small=0)
    assert found.groupBy("component").count().collect()[0]["count"] == n + 1
    assert names.count("jumps") <= 14


def expected(rows):
    rows = [(i, t) for i, t, *_ in rows if i is not None]
    keys = {k: brute.shingles(t) for k, (_, t) in enumerate(rows)}
    found = brute.classes({k: s for k, s in keys.items() if s})
    return sorted((rows[k][0], min(rows[j][0] for j in found if found[j][0] == found[k][0]) if k in found else rows[k][0], found[k][1] if k in found else 0) for k in keys)


def test_ngram_join_equals_brute_force(docs, odd_docs, no_docs):
    for table in (docs, odd_docs):
        found = ngram_jaccard_join(table).collect()
        assert sorted((r.doc_id, r.class_id, r.n_links) for r in found if r.doc_id is not None) == expected(documents())
        assert [(r.class_id, r.n_links) for r in found if r.doc_id is None] == [(None, 0)]
    assert ngram_jaccard_join(no_docs).collect() == []


def test_large_groups_are_tiled_without_losing_links(spark):
    base = prose(5, 150)
    rows = [(k, edited(base, k, 2)) for k in range(60)] + [(k, prose(k, 80)) for k in range(60, 80)] + [(k, base) for k in range(80, 100)]
    found = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), tile_shingles=2500).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in found) == expected(rows)


def test_one_of_each_keeps_one_row_a_class(docs):
    kept = one_of_each(docs, ngram_jaccard_join(docs)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 5, 6, 7, 8, 10, 11, 12, 13]
    assert sum(r.doc_id is None for r in kept) == 1


@pytest.fixture(scope="module")
def pages(spark):
    shared, other = prose(7, 60), prose(8, 70)
    rows = [(k, "\n".join([prose(100 + k, 30), shared if k % 2 else edited(shared, k, 1), "short line", prose(200 + k, 25)])) for k in range(12)]
    return rows + [(20, other), (21, other), (22, None), (23, ""), (None, other), (24, f"é\n\n{other}")]


def test_paragraph_dedup_equals_brute_force(spark, pages):
    table = spark.createDataFrame(pages, "doc_id long, text string")
    sets = {(i, k): brute.shingles(p) for i, t in pages if i is not None for k, p in enumerate((t or "").split("\n")) if len(brute.words(p)) >= 20}
    found = brute.classes(sets)
    size = {c: sum(v[0] == c for v in found.values()) for c, _ in found.values()}
    want = [(i, k, size[c], c == (i, k), c[0]) for (i, k), (c, _) in found.items() if size[c] > 1]
    short = defaultdict(list)
    for i, t in pages:
        for k, p in enumerate((t or "").split("\n")):
            if i is not None and 0 < len(brute.words(p)) < 20:
                short[brute.shingles(p)].append((i, k))
    want = sorted(want + [(i, k, len(at), True, min(at)[0]) for at in short.values() if len(at) > 1 for i, k in at])
    assert any(w[1] == 2 and w[3] for w in want)
    got = paragraph_dedup(table)
    assert sorted((r.doc_id, r.paragraph, r.n_class, r.kept, r.class_doc) for r in got.collect()) == want
    texts = dict(pages)
    for r in got.collect():
        assert texts[r.doc_id][r.start : r.start + r.n_chars] == texts[r.doc_id].split("\n")[r.paragraph]
    clean = {r.doc_id: r.text for r in remove_paragraphs(table, got).collect()}
    assert clean[21] == "" and clean[20] == texts[20] and clean[22] is None and clean[24] == "é\n"


def test_paragraph_dedup_of_nothing(no_docs, docs):
    assert paragraph_dedup(no_docs).collect() == []
    assert {r.doc_id for r in paragraph_dedup(docs).collect()} >= {1, 2, 3}


def passages_by_hand(rows):
    """(doc, first word, words, kept) of sources and copies, windows that overlap one another made one."""
    size, first, own, copied = 50, {}, defaultdict(set), defaultdict(set)
    windows = [(tuple(w[p : p + size]), i, p) for i, t in sorted(rows) for w in [brute.words(t)] for p in range(len(w) - size + 1)]
    for w, i, p in windows:
        source = first.setdefault(w, (i, p))
        if source[0] != i or p - source[1] >= size:
            copied[i].add(p)
            own[source[0]].add(source[1])
    # A window that only overlaps its own source makes no source of it.
    for w, i, p in windows:
        if first[w][0] == i and 0 < p - first[w][1] < size:
            own[i].add(first[w][1])
    out = []
    for kept, places in ((True, own), (False, copied)):
        for i, at in places.items():
            start = last = None
            for p in sorted(at):
                if last is None or p - last >= size:
                    if last is not None:
                        out.append((i, start, last + size - start, kept))
                    start = p
                last = p
            out.append((i, start, last + size - start, kept))
    return sorted(out)


def test_passages_equal_brute_force(spark):
    a, b, c = prose(70, 60), prose(71, 55), prose(72, 120)
    rows = [(1, f"{prose(81, 30)} {a} {prose(82, 30)} {c}"), (2, f"{a} {b}"), (3, f"{prose(83, 15)} {b} {a} {prose(84, 40)}"), (4, f"{c} {prose(85, 9)}"), (5, f"{prose(86, 20)} {c[: len(c) // 2]} {prose(87, 70)}")]
    rows += [(10, "again " * 3000), (11, " ".join([prose(88, 7)] * 500)), (12, f"{prose(89, 40)} " + " ".join([prose(88, 7)] * 20)), (13, " ".join([prose(90, 130)] * 3))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    marks = paragraph_dedup(table)
    got = []
    for r in marks.collect():
        if r.paragraph is None:
            text = dict(rows)[r.doc_id]
            got.append((r.doc_id, len(text[: r.start].split()), r.n_words, r.kept))
            assert len(text[r.start : r.start + r.n_chars].split()) == r.n_words
    assert sorted(got) == passages_by_hand(rows)
    by_class = Counter(r.class_id for r in marks.collect() if r.paragraph is None)
    assert all(r.n_class == by_class[r.class_id] for r in marks.collect() if r.paragraph is None)
    assert sum(r[0] in (10, 11, 12, 13) for r in got) == 7
    clean = {r.doc_id: r.text for r in remove_paragraphs(table, marks).collect()}
    assert clean[10] == "again " * 50 + " " and len(clean[11].split()) == 56 and len(clean[13].split()) == 130


def test_passages_over_lines_are_cut_with_their_breaks(spark):
    shared = "\n".join(prose(91 + k, 12) for k in range(5))
    rows = [(1, f"{prose(96, 30)}\n{shared}\nfirst tail"), (2, f"{prose(97, 30)}\n{shared}\nsecond close"), (3, "é\n\n" + prose(98, 25))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in remove_paragraphs(table, paragraph_dedup(table)).collect()}
    assert clean == {1: rows[0][1], 2: f"{prose(97, 30)}\n\nsecond close", 3: rows[2][1]}


def test_passages_inside_longer_lines_are_marked(spark):
    shared = prose(31, 55)
    rows = [(k, f"{prose(300 + k, 40)} {shared} {prose(400 + k, 40)}") for k in range(4)] + [(9, prose(500, 90) + "\n" + "é " + shared)]
    rows += [(20, prose(32, 49) + " " + prose(601, 60)), (21, prose(602, 60) + " " + prose(32, 49)), (30, "again " * 300)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    marks = paragraph_dedup(table)
    got = [r for r in marks.collect() if r.doc_id < 20]
    texts = dict(rows)
    assert sorted((r.doc_id, r.kept, r.class_doc, r.n_class, r.n_words) for r in got) == [(k, k == 0, 0, 5, 55) for k in (0, 1, 2, 3, 9)]
    assert all(texts[r.doc_id][r.start : r.start + r.n_chars] == shared for r in got)
    clean = {r.doc_id: r.text for r in remove_paragraphs(table, marks).collect()}
    assert clean == {k: t if k in (0, 20, 21) else "again " * 50 + " " if k == 30 else t.replace(shared, "") for k, t in texts.items()}


def test_a_released_table_cannot_be_read(spark):
    table = C.cut(spark.range(5), "gone")
    assert table.count() == 5
    C.release(table)
    with pytest.raises(Exception, match="(?i)exist|not found"):
        table.agg({"id": "sum"}).collect()


def test_a_forest_that_cannot_reach_its_recall_says_so(monkeypatch):
    from crivo.llm import embedding_dedup as E

    sample = E.unit(np.random.default_rng(1).standard_normal((3000, 16)))
    monkeypatch.setattr(E, "MOST_TREES", 1)
    with pytest.raises(ValueError, match="partners"):
        E.Forest(sample, 5, 0.0, 0.5, 0.999, 0)
    monkeypatch.setattr(E, "LEAST_RECALL", 0.0)
    with pytest.warns(UserWarning, match="partners"):
        E.Forest(sample, 5, 0.0, 0.5, 0.999, 0)

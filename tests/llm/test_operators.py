import functools
import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from .conftest import documents, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from crivo.llm import chat, lattice_lm, line_dedup, mixing, packing, quality, queries, token_counts
from crivo.llm.embedding_dedup import embedding_dedup

from . import brute

PIECES, IDS, RANKS = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


# --- 1: mixing ---


def weights_by_hand(totals, exponent):
    everything = sum(totals.values())
    power = {s: (n / everything) ** exponent for s, n in totals.items()}
    return {s: x / sum(power.values()) for s, x in power.items()}


def bisected(fits, low, high):
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if fits(middle) else (middle, high)
    return high


def entropy(weights):
    return -sum(x * math.log(x) for x in weights.values()) / math.log(len(weights))


def test_mixture_equals_brute_force(spark):
    from pyspark.sql import functions as F

    rows = [(k, prose(k, 20 + k % 50), "abc"[min(2, k % 7 // 3)]) for k in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n", F.lit(1))
    encode = packing.Encoder(IDS, RANKS)
    sizes = {i: len(encode(t)) for i, t, _ in rows}
    totals = Counter()
    for i, _, s in rows:
        totals[s] += sizes[i]
    everything = sum(totals.values())
    repeats = lambda w, longest: max(w[s] * longest / totals[s] for s in totals)
    once = lambda w: max(totals[s] / w[s] for s in totals)
    natural = entropy(weights_by_hand(totals, 1))
    cases = [
        ({"max_repeats": 1.5}, lambda a: repeats(weights_by_hand(totals, a), once(weights_by_hand(totals, a))) <= 1.5, 1),
        ({"max_repeats": 1.2, "budget_tokens": everything}, lambda a: repeats(weights_by_hand(totals, a), everything) <= 1.2, 1),
        ({"target_entropy": (1 + natural) / 2, "max_repeats": 4.0}, lambda a: entropy(weights_by_hand(totals, a)) <= (1 + natural) / 2, 8),
        ({"target_entropy": natural - 0.1}, lambda a: entropy(weights_by_hand(totals, a)) <= natural - 0.1, 8),
    ]
    for options, fits, steepest in cases:
        exponent = bisected(fits, 0, steepest)
        assert 0.01 < abs(exponent - 1) and 0 < exponent < 8
        weights = weights_by_hand(totals, exponent)
        longest = options.get("budget_tokens", once(weights))
        got = mixing.mix_sources(table, IDS, RANKS, block_tokens=300, **options).collect()
        by = defaultdict(list)
        for r in got:
            assert r.n_tokens == sizes[r.doc_id] and math.isclose(r.weight, weights[r.source], rel_tol=1e-6)
            by[r.source].append(r)
        for source, read in by.items():
            budget = weights[source] * longest
            assert budget - 1 <= sum(r.n_tokens for r in read) <= budget + max(sizes.values())
            assert max(Counter((r.doc_id, r.pass_no) for r in read).values()) == 1
            read.sort(key=lambda r: r.at)
            assert all(x.at + x.n_tokens == y.at and (x.pass_no, x.block) <= (y.pass_no, y.block) for x, y in zip(read, read[1:], strict=False))
            first = [r.doc_id for r in read if r.pass_no == 1]
            assert len({r.block for r in read}) > 2 and first != sorted(first)
            if "budget_tokens" not in options:
                assert len(first) == sum(s == source for _, _, s in rows)


def test_mixture_says_what_it_cannot_meet(spark):
    rows = [(k, "a b c", "ab"[k > 0]) for k in range(100)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for options in ({"max_repeats": 4.0, "target_entropy": 0.99}, {"max_repeats": 2.0, "budget_tokens": 10**4}):
        with pytest.raises(ValueError):
            mixing.mix_sources(table, **options)
    even = spark.createDataFrame([(k, "a b c", "ab"[k % 2]) for k in range(10)], "doc_id long, text string, source string")
    with pytest.raises(ValueError):
        mixing.mix_sources(even, target_entropy=0.5)


def test_mixing_odd_tables(docs, odd_docs, no_docs, spark):
    assert mixing.mix_sources(no_docs).collect() == []
    read = mixing.mix_sources(docs, max_repeats=1.0).collect()
    assert sorted(str(r.doc_id) for r in read) == sorted(str(i) for i, *_ in documents())
    assert len(mixing.mix_sources(odd_docs, max_repeats=1.0, keep=tuple(odd_docs.columns)).collect()) == len(read)
    blank = spark.createDataFrame([(1, "", "a"), (2, None, "a"), (3, "b", None)], "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in mixing.mix_sources(blank, IDS, RANKS, max_repeats=2.0).collect()) == [1, 2, 3]
    alike = spark.createDataFrame([(None, "same words here", "a")] * 400, "doc_id long, text string, source string")
    assert len({r.block for r in mixing.mix_sources(alike, block_tokens=300).collect()}) > 10


# --- 2: token counts ---


def test_token_counts_of_split_texts(docs, odd_docs, no_docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = sorted(((i is not None, i or 0), len((t or "").encode()), len(model.encode(t or ""))) for i, t, *_ in documents())
    for table in (docs, odd_docs):
        for split in (1 << 16, 50):
            got = token_counts.token_counts(table, PIECES, split_bytes=split).collect()
            assert sorted(((r.doc_id is not None, r.doc_id or 0), r.n_bytes, r.n_tokens) for r in got) == want
            assert all(r.over_limit == (r.n_tokens > 4096) for r in got)
    assert token_counts.token_counts(no_docs, PIECES).collect() == []


_counter = {}


@given(st.text(alphabet="ab▁ \n\t.é漢\xa0", max_size=80))
@settings(max_examples=200, deadline=None)
def test_safe_cuts(text):
    counter = _counter.setdefault(0, token_counts.PieceCounter(PIECES, 4))
    assert counter.counts([text]) == [len(counter.model.encode(text))]


# --- 3: line dedup ---


def test_line_dedup_sql(spark):
    d = "/root/testdata/sf0.01"
    duckdb_rows = duckdb.connect()
    duckdb_rows.sql(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet'")
    want = duckdb_rows.sql(queries.ORACLE_SQL["op3_site_line_dedup"]).df()
    got = queries.op3_site_line_dedup(spark, d).toPandas()
    key = lambda df: sorted(map(tuple, df[sorted(want.columns)].astype(str).values.tolist()))
    assert key(got) == key(want) and got.n_dropped.sum() > 0


def test_line_dedup_by_host(spark):
    rows = [(k, f"http://h.org/{k}", f"<p>menu</p><p>own line {k}</p><div>{'twice' if k < 3 else 'x' + str(k)}</div>") for k in range(40)]
    rows += [(200 + k, "http://few.org", f"<p>{'often' if k < 3 else 'seldom'}</p><p>{'pair' if k < 2 else k}</p>") for k in range(5)]
    rows += [(100, "http://u@H.org:80/z", "<li>menu</li>&amp;lt;<script>menu</script>"), (101, None, None), (102, "nowhere", ""), (None, "http://small.org", "<p>menu</p>")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in line_dedup.page_line_dedup(table).collect()}
    assert got[5].text.split() == ["own", "line", "5", "x5"] and got[5].n_dropped == 1
    assert "twice" in got[1].text
    assert [got[200 + k].n_dropped for k in range(5)] == [1, 1, 1, 0, 0] and "pair" in got[200].text
    assert got[100].host == "h.org" and got[100].n_dropped == 1 and got[100].text.strip() == "&lt;"
    assert got[101].text is None and got[101].n_lines == 0 and got[102].text == ""
    assert got[None].n_dropped == 0
    assert line_dedup.page_line_dedup(table.limit(0)).collect() == []


def test_line_dedup_carries_columns(odd_docs):
    from pyspark.sql import functions as F

    out = line_dedup.drop_site_lines(odd_docs, F.col("source"), "text", ratio=0.3, min_held=2)
    assert out.columns[: len(odd_docs.columns)] == odd_docs.columns and len(out.columns) == len(odd_docs.columns) + 2
    assert out.count() == odd_docs.count()


# --- 5: packing ---


def check_packing(got, capacity):
    rows = defaultdict(list)
    for r in got:
        rows[r.sequence_id].append((r.offset, r.length))
    for spans in rows.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= capacity
    return len(rows)


@pytest.mark.parametrize("shard", [1500, 5])
def test_packing(docs, odd_docs, no_docs, shard):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(IDS)
    for table in (docs, odd_docs):
        got = packing.pack_documents(table, IDS, RANKS, with_ids=True, shard_items=shard).collect()
        n = check_packing(got, 2048)
        assert n <= math.ceil(sum(r.length for r in got) / 2048) + 2
        texts = defaultdict(list)
        for i, t, *_ in documents():
            texts[i].append(own.encode(t or "", add_special_tokens=False).ids + [0])
        for i, ids in texts.items():
            pieces = sorted((r for r in got if r.doc_id == i), key=lambda r: (r.piece, r.sequence_id))
            assert sorted(x for r in pieces for x in r.ids) == sorted(x for some in ids for x in some)
            assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in pieces)
            assert all(r.length == 2048 for r in pieces if r.piece)
            if len(ids) == 1:
                assert [x for r in pieces for x in r.ids] == ids[0]
                assert [r.start for r in pieces] == [sum(p.length for p in pieces[:k]) for k in range(len(pieces))]
    assert packing.pack_documents(no_docs, IDS, RANKS).collect() == []


_encoders = {}


@given(st.text(max_size=60) | st.text(alphabet="ab <|endoftx>\n'ſ \x00٣", max_size=60))
@settings(max_examples=300, deadline=None)
def test_rank_file_gives_the_same_ids(text):
    fast = _encoders.setdefault("fast", packing.Encoder(IDS, RANKS))
    own = _encoders.setdefault("own", packing.Encoder(IDS))
    assert fast(text).tolist() == own(text).tolist()


@given(st.lists(st.none() | st.text(max_size=30) | st.text(alphabet="ab <|endoftx>\n'ſ \x00\x1c\x85\xa0\u3000٣漢", max_size=60), max_size=8), st.sampled_from([1, 9, 1 << 20]))
@settings(max_examples=300, deadline=None)
def test_texts_together_give_the_same_ids(texts, size):
    import pyarrow as pa

    own = _encoders.setdefault("own", packing.Encoder(IDS))
    fast = _encoders.setdefault("fast", packing.Encoder(IDS, RANKS))
    want = [own(t or "").tolist() for t in texts]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(packing, "GROUP_BYTES", size)
        patch.setattr(packing, "TEXT_BYTES", size)
        for encoder in (own, fast):
            for kind in (pa.string(), pa.large_string()):
                assert [x.tolist() for x in encoder.many(pa.array(["cut off", *texts], kind).slice(1))] == want


def test_repeated_stretches_are_encoded_once(monkeypatch):
    import pyarrow as pa

    encoder = packing.Encoder(IDS, RANKS)
    texts = [prose(k, 500) for k in range(40)]
    want, read, plain = [encoder(t).tolist() for t in texts], [], encoder.fast.encode_to_numpy
    monkeypatch.setattr(encoder.fast, "encode_to_numpy", lambda text, **more: read.append(len(text)) or plain(text, **more))
    assert [x.tolist() for x in encoder.many(pa.array(texts))] == want
    assert sum(read) < sum(map(len, texts)) / 50
    assert packing.loaded(IDS, RANKS) is packing.loaded(IDS, RANKS)


def test_a_pattern_that_joins_words_is_an_error():
    import pyarrow as pa
    import tiktoken

    encoder = packing.Encoder(IDS, RANKS)
    ranks = {bytes([k]): k for k in range(256)} | {b"b ": 256}
    encoder.fast = tiktoken.Encoding("joined", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
    encoder.n_bytes = np.array([1] * 256 + [2])
    with pytest.raises(ValueError, match="begins a word"):
        list(encoder.many(pa.array(["x ab ac"])))


def test_crossover_keeps_every_item_once():
    import random

    dice = random.Random(1)
    lengths = [dice.randrange(1, 90) for _ in range(60)]
    parents = [packing.evolve(lengths, 100, [], seed, 0, 2) for seed in (1, 2)]
    child = packing.cross(*parents, lengths, 100, dice)
    assert sorted(i for b in child for i in b) == list(range(60)) and all(sum(lengths[i] for i in b) <= 100 for b in child)
    assert packing.listed(packing.numbered(child, 60)) == [sorted(b) for b in child]


def test_crossover_saves_bins_that_best_fit_cannot():
    import random

    dice, lengths = random.Random(1), []
    for _ in range(60):
        a = dice.randrange(380, 490)
        b = dice.randrange(250, (1000 - a) // 2)
        lengths += [a, b, 1000 - a - b]
    plain: list = []
    packing.best_fit(sorted(range(180), key=lambda i: -lengths[i]), lengths, 1000, plain, [])
    start = packing.evolve(lengths, 1000, [], 0, 0, 4)
    islands = [packing.evolve(lengths, 1000, [], seed, packing.GENERATIONS, 4) for seed in (0, 1)]
    moved = [packing.evolve(lengths, 1000, islands, seed, packing.GENERATIONS, 4) for seed in (2, 3)]
    for bins in (*islands, *moved):
        assert sorted(i for b in bins for i in b) == list(range(180)) and all(sum(lengths[i] for i in b) <= 1000 for b in bins)
    assert min(map(len, moved)) <= min(map(len, islands)) < len(start) < len(plain)
    assert len(plain) >= 70 and min(map(len, moved)) <= 63


# --- 6: embeddings ---


def test_embedding_links_equal_brute_force(spark):
    dice = np.random.default_rng(3)
    base = dice.standard_normal((40, 16))
    rows, k = [], 0
    for c, b in enumerate(base):
        for _ in range(1 + c % 4):
            rows.append((k, (b + dice.standard_normal(16) * 0.04).tolist(), c % 2))
            k += 1
    rows += [(900 + j, base[0].tolist(), 0) for j in range(30)]
    rows += [(2000 + j, (base[1] + dice.standard_normal(16) * 0.01).tolist(), 1) for j in range(60)]
    x = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    label = {i: c for i, _, c in rows}
    union, links = brute.Union(x), Counter()
    ids = sorted(x)
    for a in ids:
        for b in ids:
            if a < b and label[a] == label[b] and float(x[a] @ x[b]) >= 0.98:
                union.join(a, b)
                links[a] += 1
                links[b] += 1
    odd = [(5000, None, 0), (5001, [0.0] * 16, 0), (5002, [float("nan")] * 16, 0), (5003, [1.0, None] + [0.0] * 14, 0), (5004, base[0].tolist(), None), (5005, [1.0, 2.0], 0), (5006, [], 0), (5007, [float("inf")] + [0.0] * 15, 0), (None, base[0].tolist(), 0)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS id", "2 AS leaf", "3 AS copies")
    for leaf in (512, 12):
        got = {r.vec_id: r for r in embedding_dedup(table, leaf_rows=leaf).collect()}
        assert all((got[i].n_links, got[i].component_id, got[i].kept) == (links[i], union.find(i), union.find(i) == i) for i in ids)
        assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i, *_ in odd if i is not None)
        assert got[None].component_id is None and not got[None].kept
    assert embedding_dedup(table.limit(0)).collect() == []


def test_recall_of_deep_trees(spark):
    dice = np.random.default_rng(11)
    centres = dice.standard_normal((8, 32)) * 0.5
    base = centres[dice.integers(0, 8, 3500)] + dice.standard_normal((3500, 32))
    near = base[:1200] + dice.standard_normal((1200, 32)) * 0.2 * np.sqrt((base[:1200] ** 2).mean(axis=1, keepdims=True))
    x = np.concatenate((base, near))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    want = np.triu(x @ x.T >= 0.98, 1)
    want = want.sum(axis=0) + want.sum(axis=1)
    table = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embedding_dedup(table, leaf_rows=16).collect()}
    found = np.array([got[k] for k in range(len(x))])
    assert np.ceil(np.log2(len(x) / 16)) >= 8 and want.sum() > 1000
    assert (found <= want).all() and found.sum() >= 0.99 * want.sum()


# --- 7: lattice ---


def low_words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))


def test_base_scores(docs, odd_docs, no_docs):
    rows = [(i, low_words(t)) for i, t, *_ in documents()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(w for i, ws in rows if not held(i) for w in [*ws, None])
    n, v = sum(counts.values()), len(counts)
    want = sorted(((i is not None, i or 0), held(i), len(ws) + 1, sum(counts[w] > 0 for w in [*ws, None]), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*ws, None]), 4)) for i, ws in rows)
    for table in (docs, odd_docs):
        got = lattice_lm.lattice_scores(table, PIECES).collect()
        assert sorted(((r.doc_id is not None, r.doc_id or 0), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lattice_lm.lattice_scores(no_docs, PIECES).collect() == []


def bytes_of(words):
    data = b"".join(w.encode() for w in words)
    return np.frombuffer(data, np.uint8), np.cumsum([0, *(len(w.encode()) for w in words)])


@functools.cache
def places(pieces):
    """Ids of the pieces that are text, and of all pieces."""
    return {x: k for k, x in enumerate(pieces) if x and not re.fullmatch("<0x..>", x)}, {x: k for k, x in enumerate(pieces)}


def plain_lattice(pieces, p, word):
    """(probability, expected counts) of a word by trying every arc, in plain probabilities."""
    text, (index, spell) = "▁" + word, places(tuple(pieces))
    arcs = []
    for i in range(len(text)):
        inner = text[i] == "▁" and i
        arcs += [(i, j, [index[text[i:j]]]) for j in range(i + 1, len(text) + 1) if text[i:j] in index and "▁" not in text[max(i, 1) : j]]
        if inner or text[i] not in index:
            arcs.append((i, i + 1, [spell[f"<0x{b:02X}>"] for b in text[i].encode()]))
    ahead, back = [1.0] + [0.0] * len(text), [0.0] * len(text) + [1.0]
    for i, j, ks in sorted(arcs):
        ahead[j] += ahead[i] * math.prod(p[k] for k in ks)
    for i, j, ks in sorted(arcs, reverse=True):
        back[i] += back[j] * math.prod(p[k] for k in ks)
    counts = Counter()
    for i, j, ks in arcs:
        for k in ks:
            counts[k] += ahead[i] * math.prod(p[x] for x in ks) * back[j] / ahead[-1]
    return ahead[-1], counts


def test_lattice_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "", *(f"<0x{b:02X}>" for b in range(256))]
    dice = np.random.default_rng(5)
    p = dice.random(len(pieces))
    p /= p.sum()
    lattice = lattice_lm.Lattice(pieces, np.log(p))
    words = ["a", "ab", "abab", "aabb", "éab", "a▁b", "<0x41>", "漢" * 30, "q"]
    total = np.zeros(len(pieces))
    found = lattice.walk(*bytes_of(words), total)
    want = [plain_lattice(pieces, p, w) for w in words]
    assert np.allclose(found, np.log([x for x, _ in want]), rtol=1e-10)
    assert np.allclose(total, [sum(c[k] for _, c in want) for k in range(len(pieces))])
    assert np.isfinite(lattice.walk(*bytes_of(["ab" * 5000, "漢" * 3000]))).all()


def test_spelled_words_share_one_unit():
    lattice = lattice_lm.Lattice(["▁a", "b"], np.log([0.5, 0.5]))
    assert math.isclose(np.exp(lattice.walk(*bytes_of(["a" + "b" * k for k in range(50)]))).sum(), 1)
    pieces, p = ["▁", "▁a", "a", "b", "ab"], np.array([0.3, 0.1, 0.2, 0.2, 0.2])
    words = [""] + ["".join(w) for n in range(1, 12) for w in itertools.product("ab", repeat=n)]
    assert 0.9 < np.exp(lattice_lm.Lattice(pieces, np.log(p)).walk(*bytes_of(words))).sum() <= 1


def test_scores_equal_brute_force(spark):
    import sentencepiece

    rows = [(k, prose(k, 30 + k) + (" Héé 漢字 </s> <0x41> a▁b" if k % 4 == 0 else "")) for k in range(24)] + [(30, ""), (31, None), (32, "zzq zzq")]
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    texts = {i: [w.decode() for w in low_words(t)] for i, t in rows}
    counts = Counter(w for i, ws in texts.items() if i not in held for w in ws)
    ends = len(rows) - len(held)
    n, v = sum(counts.values()) + ends, len(counts) + 1
    once, twice = sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
    discount = min(0.95, max(0.05, once / (once + 2 * twice)))
    pieces = lattice_lm.vocabulary(PIECES)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    total = Counter(k for w in counts for k in model.encode(w))
    for turn in range(lattice_lm.ROUNDS + 1):
        weight = np.array([total[k] + lattice_lm.PIECE_PRIOR if p else 1e-300 for k, p in enumerate(pieces)])
        p = (weight / weight.sum()).tolist()
        if turn < lattice_lm.ROUNDS:
            total = Counter()
            for w in counts:
                total.update(plain_lattice(pieces, p, w)[1])
    chance = {w: (counts[w] - discount) / n * (counts[w] > 0) + discount * v / n * plain_lattice(pieces, p, w)[0] for ws in texts.values() for w in ws}
    assert sum(chance[w] for w in counts) + (ends - discount) / n <= 1
    got = {r.doc_id: r for r in lattice_lm.lattice_scores(spark.createDataFrame(rows, "doc_id long, text string"), PIECES).collect()}
    assert lattice_lm.ROUNDS == 4 and {i for i, r in got.items() if r.held_out} == held and held
    for i, ws in texts.items():
        assert math.isclose(got[i].score, sum(math.log10(chance[w]) for w in ws) + math.log10((ends - discount) / n), rel_tol=1e-6)


def test_held_out_text_of_the_language_beats_noise(spark):
    rows = [(k, prose(k, 200)) for k in range(60)] + [(1000 + k, " ".join("qzxwvk"[(k * j) % 6] * 3 + str(j * k) for j in range(200))) for k in range(20)]
    got = lattice_lm.lattice_scores(spark.createDataFrame(rows, "doc_id long, text string").where("doc_id < 1000 OR crc32(CAST(doc_id AS STRING)) % 7 = 2"), PIECES).where("held_out").collect()
    rate = lambda some: sum(r.score for r in some) / sum(r.n_tokens for r in some)
    clean, noise = [r for r in got if r.doc_id < 1000], [r for r in got if r.doc_id >= 1000]
    assert clean and noise and rate(clean) > 2 * rate(noise)
    assert sum(r.score for r in clean) >= sum(r.base_score for r in clean) - 0.05 * sum(r.n_tokens for r in clean)


# --- 9: quality ---


def rule_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, docs, odd_docs, no_docs, labels):
    extra = [(50, "a b c d e f g h a b c d e f g h a b c"), (51, "x\nx\n \n\nx y\nx"), (52, "# % & | < > * $ ok"), (53, " ".join(["w"] * 40)), (54, "a b c d e f g h i j a b c d e f g h z " * 2)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    texts = {**{i: t for i, t, *_ in documents()}, **dict(extra)}
    for r in quality.quality_rules(table, labels).collect():
        want = rule_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and (not r.kept or not r.base_failed)
    out = quality.accepted(odd_docs, labels)
    assert out.columns == odd_docs.columns and out.count() > 0
    assert quality.quality_rules(no_docs, labels).collect() == []
    assert all(r.llr == 0 for r in quality.quality_rules(docs, labels.limit(0)).collect())


def test_quality_ratio_equals_brute_force(spark):
    rows = [(k, prose(k, 60)) for k in range(30)] + [(100 + k, " ".join(f"z{j * k % 13}%%" for j in range(60))) for k in range(30)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(0, 30, 2)] + [(1, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_rules(table, labels).collect()}
    feats = {r.doc_id: r.f for r in table.select("doc_id", quality.features(quality.hashed(quality.words_of(table.text))).alias("f")).collect()}
    raw = Counter(b for f in feats.values() for b in f)
    target = Counter(b for k in range(0, 30, 2) for b in feats[k])
    scale = sum(target.values()) / sum(raw.values())
    ratio = {b: round(1e6 * math.log((target[b] + 16) / (raw[b] * scale + 16))) for b in raw}
    assert all(len(f) == 119 for f in feats.values())
    assert all(math.isclose(got[k].llr, sum(ratio[b] for b in f) / len(f) / 1e6, abs_tol=1e-9) for k, f in feats.items())
    assert all(got[k].llr > quality.THRESHOLD > got[100 + k].llr for k in range(30))


# --- 10: chat ---


@given(st.text(alphabet="<|>\\/s[]INTa\nY«é", max_size=40))
@settings(max_examples=300, deadline=None)
def test_escapes_are_reversible(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text and not any(c in hidden for c in chat.CONTROL)
    assert chat.parse(f"{chat.OPEN}{hidden}{chat.HEAD}{hidden}{chat.CLOSE}")[0][:2] == (text, text)


@pytest.mark.parametrize("budget,history", [(1024, 256), (40, 15), (5, 0)])
def test_windows(spark, budget, history):
    rows = []
    for conv in range(8):
        roles = (["system"] if conv % 2 else []) + ["user", "assistant"] * (conv * 3)
        rows += [(conv, k, r, prose(conv * 100 + k, 1 + (k * 7) % 30)) for k, r in enumerate(roles)]
    rows += [(50, 0, "user", None), (50, 0, "user", None), (50, None, None, "x"), (None, 1, "assistant", "</s><|a|>\\"), (None, 1, "user", "q"), (51, 3, "system", "late"), (51, 1, "assistant", "a\\n")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS conv", "2 AS tokens", "3 AS window")
    windows = chat.format_chats(table, budget=budget, history=history)
    back = chat.read_back(windows).collect()
    assert sorted(back, key=str) == sorted(chat.read_back(windows, dealt=True).collect(), key=str)
    got = {r.conv_id: r for r in back if r.conv_id is not None}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append(((t is not None, t or 0), r or "", x or ""))
    lone = [hashlib.sha256(f"{r}\n{x}\n".encode()).hexdigest() for _, r, x in by.pop(None)]
    assert sorted((r.n_turns, r.turns_sha256) for r in back if r.conv_id is None) == sorted((1, x) for x in lone)
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        target = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(target), hashlib.sha256(target.encode()).hexdigest())
    for w in windows.collect():
        turns = chat.parse(w.formatted)
        cost = sum(math.ceil(len(x.encode()) / 4) + chat.TURN_TOKENS for _, x, _, _ in turns)
        own = turns[w.n_repeated :]
        assert cost <= budget or len(own) - (w.window == 0 and own[0][0] == "system") <= 1
        if w.window and w.conv_id is not None and w.conv_id < 50 and w.conv_id % 2:
            assert turns[0][0] == "system" and w.n_repeated >= 1
    assert chat.read_back(chat.format_chats(table.limit(0))).collect() == []


def test_windows_hold_the_vocabulary_s_tokens(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = [(conv, k, ["user", "assistant"][k % 2], prose(conv * 100 + k, 5 + (k * 11) % 60)) for conv in range(3) for k in range(12)]
    windows = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), PIECES, budget=200, history=80).collect()
    texts = {x for *_, x in rows}
    assert len(windows) > 6
    for w in windows:
        turns = chat.parse(w.formatted)
        cost = [len(model.encode(x)) + chat.TURN_TOKENS for _, x, _, _ in turns]
        assert {x for _, x, _, _ in turns} <= texts
        assert sum(cost) <= 200 or len(turns) == w.n_repeated + 1 == 1
        assert sum(cost[: w.n_repeated]) <= 80


def test_names_of_elements_are_told_apart():
    import re

    names = line_dedup.BLOCKS.split("|")
    pattern = re.compile(rf"</?{line_dedup.one_of(names)}\b[^>]*>")
    assert all(pattern.fullmatch(f"<{n}>") and pattern.fullmatch(f"</{n} a='b'>") for n in names)
    assert not any(pattern.fullmatch(f"<{n}>") for n in ("span", "b", "head", "t", "pr", "h7", "tablex", "d"))

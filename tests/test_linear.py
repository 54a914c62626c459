"""Scans, spans, splices and operators between positions: right by brute force, and in time that grows with the text."""

import itertools
import random
import re
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crivo.functions.scan import BLOCK, RADIX, blocks, piece, running_max, running_sums
from crivo.operators.criteria import compile_criterion, evaluate
from crivo.operators.rewrite import rewritten_text, split_directives
from crivo.operators.rule_index import apply_rule_index, key_words
from crivo.operators.rules import Rule, apply_rules, compile_rules
from crivo.operators.spans import extract, highlight_spans, highlight_terms, merged
from crivo.plans.arrays import near, reach
from crivo.plans.parser import parse
from crivo.plans.syntax import weaker
from crivo.sources.ingest import rejoin_lines

TEXT = T.StringType()


def one(spark, value, kind):
    return spark.createDataFrame([(value,)], f"x {kind}")


@pytest.mark.parametrize("n", [0, 1, RADIX, RADIX + 1, 200, 5000])
def test_scans(spark, n):
    dice = random.Random(n)
    values = [dice.randrange(-9, 10) for _ in range(n)]
    row = one(spark, values, "array<int>").select(running_sums(F.col("x")).alias("s"), running_max(F.col("x")).alias("m")).first()
    assert row.s == list(itertools.accumulate(values)) and row.m == list(itertools.accumulate(values, max))


def test_running_max_ignores_nulls(spark):
    assert one(spark, [None, 3, None, 1, 7, None], "array<int>").select(running_max(F.col("x"))).first()[0] == [None, 3, 3, 3, 7, 7]


def test_pieces_of_blocks(spark):
    text = "".join(random.Random(1).choice("aé漢😀\n ") for _ in range(3 * BLOCK + 17))
    cuts = [(0, 0), (0, 5), (BLOCK - 1, BLOCK + 1), (BLOCK, 2 * BLOCK), (7, 3 * BLOCK + 9), (0, len(text)), (len(text), len(text) + 4), (len(text) - 1, len(text) + 9)]
    rows = spark.createDataFrame([(text, a, b) for a, b in cuts], "x string, a int, b int")
    assert [r[0] for r in rows.select(piece(blocks(F.col("x")), F.col("a"), F.col("b"))).collect()] == [text[a:b] for a, b in cuts]


def spans(spark, text, pattern):
    return [(s.start, s.end, s.text) for s in one(spark, text, "string").select(extract(F.col("x"), TEXT, f"r:{pattern}").alias("s")).first().s]


@pytest.mark.parametrize("pattern", [r"\b(?=\w)", r"\b", r"[a-z]*", r"(?=b)", r"x*", "[0-9]+", "a|b", "$", "^"])
def test_spans_equal_those_of_another_engine(spark, pattern):
    for text in ("ab 12 cd", "", "aab\nb  ba", "x" * 5):
        assert spans(spark, text, pattern) == [(m.start(), m.end(), m.group()) for m in re.finditer(pattern, text)], text


def test_spans_of_letters_and_of_texts_with_breaks_and_marks(spark):
    assert spans(spark, "ab 12 cd", r"\p{L}*") == [(0, 2, "ab"), (2, 2, ""), (3, 3, ""), (4, 4, ""), (5, 5, ""), (6, 8, "cd"), (8, 8, "")]
    # A break is one character for all that follows it, and characters that spans are marked with are no marks.
    assert spans(spark, "a<br>Ção<BR>b 1", "cao|b|[0-9]") == [(2, 5, "Ção"), (6, 7, "b"), (9, 10, "1")]


def test_merged_spans_equal_brute_force(spark):
    dice = random.Random(4)
    for _ in range(20):
        given = [(a, a + dice.randrange(6)) for a in (dice.randrange(60) for _ in range(dice.randrange(12)))]
        want = []
        for a, b in sorted(given):
            if want and a <= want[-1][1]:
                want[-1][1] = max(want[-1][1], b)
            else:
                want.append([a, b])
        got = one(spark, given, "array<struct<start:int,end:int>>").select(merged(F.col("x")).alias("m")).first().m
        assert [[s.start, s.end] for s in got] == want


def test_marks_and_removals_of_long_texts(spark):
    text = "one the two\n" * 400
    row = one(spark, text, "string").select(highlight_spans(F.col("x"), extract(F.col("x"), TEXT, "r:the")).alias("h"), rewritten_text(F.col("x"), split_directives("a remover(the)")).alias("r")).first()
    assert row.h == text.replace("the", "<mark>the</mark>").replace("\n", "<br>") and row.r == text.replace("the", " ").strip(" ")


def positions(seed, n):
    dice = random.Random(seed)
    out, t, p = [], 0, 0
    for c in "AB":
        for _ in range(n):
            t, p = t + dice.randrange(1, 4), p + (dice.random() < 0.2)
            out.append(("w", t, p, c))
    return dice.sample(out, len(out))


@pytest.mark.parametrize("name", ["ADJ", "ADJC", "PROX", "PROXC", "COM", "MESMO"])
def test_operators_equal_all_pairs(spark, name):
    kind = "a array<struct<w:string,t:int,p:int,c:string>>, b array<struct<w:string,t:int,p:int,c:string>>"
    for number in (0, 1, 3):
        pairs = [(positions(k, k), positions(100 + k, 2 * k)) for k in (0, 1, 4, 9)] + [([], positions(1, 3)), (positions(1, 3), [])]

        def fits(a, b, number=number):
            if a[3] != b[3] or name in ("ADJC", "PROXC") and a[2] != b[2]:
                return False
            if name == "COM":
                return 0 <= b[2] - a[2] <= max(number - 1, 0)
            if name == "MESMO" or number == 0:
                return True
            return (-number if name.startswith("PROX") else 0) <= b[1] - a[1] <= number

        rows = spark.createDataFrame([(k, *x) for k, x in enumerate(pairs)], f"k int, {kind}").select("k", near(*reach(name, number), F.col("a"), F.col("b")).alias("got")).orderBy("k").collect()
        for (a, b), row in zip(pairs, rows, strict=True):
            want = [y for y in b if any(fits(x, y) for x in a)] + ([x for x in a if any(fits(x, y) for y in b)] if name.startswith("PROX") else [])
            assert sorted(map(tuple, row.got)) == sorted(want), (name, number)


def seconds(action):
    began = time.time()
    action()
    return time.time() - began


def test_long_texts_take_seconds(spark):
    table = one(spark, "the of " * 50_000, "string").withColumnRenamed("x", "text")
    for criterion in ("of ADJ1 the", "the PROX3 of", "the COM2 of"):
        evaluate(table.limit(0), criterion).collect()
        assert seconds(lambda c=criterion: evaluate(table, c).collect()) < 10
    size = lambda: table.select(F.size(extract(F.col("text"), TEXT, "r:the")), F.length(highlight_terms(F.col("text"), ["the"]))).first()
    assert seconds(size) < 15 and size()[0] == 50_000
    lines = one(spark, "a line that goes\non and ends.\n" * 20_000, "string")
    assert seconds(lambda: lines.select(F.length(rejoin_lines(F.col("x")))).collect()) < 10


# --- the rule index ---

CRITERIA = [
    "casa ADJ2 papel", "casa E NAO telha", "telha OU muro", "(casa OU muro) ADJ3 (papel OU telha)", "casa PROX2 papel", "casa PROXC2 papel", "papel ADJC3 muro", "casa COM2 muro", "casa MESMO muro",
    '"de papel"', "mur$ E casa", "t?lha", "NAO casa", "casa NAO papel", "casa ADJ0 telha", "casa ADJ2 pap$", "<vazio>", "r:pap[a-z]l", "l:%muro%", "casa remover(papel)", "zebra", "casa E casa", "E E",
]


@pytest.mark.parametrize("first_of_group", [True, False])
def test_rule_index_gives_the_labels_of_all_rules(spark, first_of_group):
    dice = random.Random(5)
    words = ["casa", "papel", "muro", "telha", "de", "x"]
    rows = [(k, "\n".join(" ".join(dice.choice(words) for _ in range(dice.randrange(1, 7))) for _ in range(dice.randrange(1, 4)))) for k in range(40)] + [(40, ""), (41, None), (42, "casas de papéis")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rules = compile_rules([Rule("g" if k % 3 else "h", f"l{k % 17}", c, k, head=5 if k == 12 else 0) for k, c in enumerate(CRITERIA)], synonyms={"muro": ["telha"]})
    assert len(rules.bad) == 2
    want = {r.doc_id: r.labels for r in apply_rules(docs, rules, first_of_group=first_of_group).collect()}
    got = {r.doc_id: r.labels for r in apply_rule_index(docs, rules, first_of_group=first_of_group).collect()}
    assert got == want and any(want.values())


def test_rule_index_of_fields_and_of_no_rules(spark):
    docs = spark.createDataFrame([(1, {"texto": "casa de papel", "ano": "2021"}), (2, {"texto": "casa", "ano": "1999"}), (3, {})], "doc_id long, f map<string,string>")
    rules = compile_rules([Rule("a", "new", "casa E @ano>=2000", 1), Rule("a", "old", "(casa).texto. E @ano<2000", 2), Rule("b", "year", "@ano=2021", 1), Rule("c", "word", "papel.texto.", 1)])
    want = {r.doc_id: r.labels for r in apply_rules(docs, rules, "f").collect()}
    assert {r.doc_id: r.labels for r in apply_rule_index(docs, rules, "f").collect()} == want == {1: ["new", "year", "word"], 2: ["old"], 3: []}
    assert [r.labels for r in apply_rule_index(docs, compile_rules([]), "f").collect()] == [[], [], []]


def test_rules_are_filed_under_their_rarest_words():
    df = {"casa": 90, "papel": 3, "muro": 30, "telha": 40}
    of = lambda text, synonyms=None: key_words(weaker(parse(text)), synonyms or {}, df)
    assert of("casa ADJ2 papel") == {"papel"} and of("casa E (muro OU telha)") == {"casa", "telha", "muro"} - {"casa"}
    assert of("casa NAO papel") == {"casa"} and of("NAO casa") is None and of("cas$ E muro") == {"muro"} and of("cas$ OU muro") is None
    assert of("casa", {"casa": ["papel"]}) == {"casa", "papel"} and compile_criterion("casa").node is not None

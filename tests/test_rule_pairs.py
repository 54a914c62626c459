"""Rules on two close words are filed under the pair, with the result of all rules."""

import pytest
from pyspark.sql import functions as F

from crivo.operators.rule_index import apply_rule_index
from crivo.operators.rules import Rule, apply_rules, compile_rules

CLOSE = ["a ADJ1 b", "a ADJ2 a", "b PROX3 a", "a ADJC2 c", "c PROXC2 a", "a PROX20 d", "big ADJ1 b", '"cars" ADJ1 "b"', "cars ADJ1 b"]
OTHERS = ["a ADJ21 d", "a MESMO b", "a COM2 c", "a$ ADJ1 b", "a ADJ1 b ADJ1 c", "NAO a", "a", "(a ADJ1 b).text."]
TEXTS = ["a b c", "a", "b a", "a x\nc", "c x x a", "a a", "a " + "x " * 19 + "d", "a " + "x " * 20 + "d", "d " + "x " * 19 + "a", "grand b large b", "car b", "", None, "a\n\nb", "a b a b\na c"]
SYNONYMS = {"big": ["grand", "large"]}


def rule_set(criteria):
    return compile_rules([Rule(f"g{k % 3}", f"l{k % 7}", x, k) for k, x in enumerate(criteria)], synonyms=SYNONYMS)


@pytest.mark.parametrize("first_of_group", [False, True])
@pytest.mark.parametrize("criteria", [CLOSE, CLOSE + OTHERS])
def test_pairs_give_the_labels_of_all_rules(spark, criteria, first_of_group):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    paged = docs.select("doc_id", F.split("text", "x", 2).alias("text"))
    rules = rule_set(criteria)
    assert not rules.bad
    for made in (docs, paged):
        want = {r.doc_id: r.labels for r in apply_rules(made, rules, first_of_group=first_of_group).collect()}
        got = {r.doc_id: r.labels for r in apply_rule_index(made, rules, first_of_group=first_of_group).collect()}
        assert got == want and any(want.values())


def test_fields_whose_names_differ_in_case(spark):
    docs = spark.createDataFrame([(1, {"text": "a x", "TEXT": "x b"}), (2, {"text": "a", "other": "b"}), (3, {"text": "a b"})], "doc_id long, text map<string,string>")
    rules = rule_set(CLOSE)
    want = {r.doc_id: r.labels for r in apply_rules(docs, rules, first_of_group=False).collect()}
    assert {r.doc_id: r.labels for r in apply_rule_index(docs, rules, first_of_group=False).collect()} == want


def test_pairs_are_no_candidates(spark):
    """Tokens aren't copied for each rule that a document may match, and no fold tests these rules one by one."""
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = lambda criteria: apply_rule_index(docs, rule_set(criteria), first_of_group=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(steps" not in plan(CLOSE) and "aggregate(steps" in plan(CLOSE + OTHERS)

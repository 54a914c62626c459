"""Rule sets: ordered (group, label, criterion) rules that give documents their labels.

All rules are evaluated in one projection over a document; texts and tokens that several rules need are
columns made once.  An ordered fold then emits labels: a rule is skipped if its label was emitted before
and, on demand, if a rule of its group was.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crivo.functions.ambiguity import ambiguous
from crivo.functions.normalize import full, head_tail, is_blank, light
from crivo.functions.patterns import regex_error
from crivo.functions.tokens import let, token_array
from crivo.operators.criteria import Criterion, compile_criterion, every_part, lightened
from crivo.operators.rewrite import rewritten
from crivo.operators.spans import SPAN, extract
from crivo.plans.syntax import Blank


@dataclass(frozen=True)
class Rule:
    group: str
    label: str
    rule: str
    order: int = 0
    tags: str = ""
    head: int = 0
    tail: int = 0
    attrs: Mapping[str, str] = field(default_factory=dict)


#: Names of rule files' keys (fixed values).
FILE_KEYS = {"grupo": "group", "rotulo": "label", "regra": "rule", "ordem": "order", "num_ordem": "order", "tags": "tags", "qtd_cabecalho": "head", "qtd_rodape": "tail"}
RULE_SCHEMA = "group string, label string, rule string, order int, tags string, head int, tail int, attrs map<string,string>"


def rule_of(row: Mapping) -> Rule:
    """A rule from a mapping with file or column names; other keys become attributes."""
    known, attrs = {}, {}
    for key, value in row.items():
        name = FILE_KEYS.get(key, key)
        if name in ("group", "label", "rule", "tags"):
            known[name] = "" if value is None else str(value)
        elif name in ("order", "head", "tail"):
            known[name] = int(value or 0)
        elif name == "attrs":
            attrs |= {k: str(v) for k, v in (value or {}).items()}
        elif value is not None:
            attrs[key] = str(value)
    return Rule(**known, attrs=attrs)


def load_rules(rules: DataFrame) -> list[Rule]:
    """Rules from a table with any of the known columns (a rule table is configuration, so it is collected)."""
    return [rule_of(r.asDict(recursive=True)) for r in rules.collect()]


def rules_table(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.group, r.label, r.rule, r.order, r.tags, r.head, r.tail, dict(r.attrs)) for r in rules], RULE_SCHEMA)


def sorted_rules(rules: Iterable[Rule]) -> list[Rule]:
    """By group and order; rules that tie keep their places."""
    return sorted(rules, key=lambda r: (r.group, r.order))


def tag_set(tags: str) -> set[str]:
    return {t for t in re.split(r"[\s\-|,;#]+", tags or "") if t}


def tags_meet(wanted: str, has: str) -> bool:
    want = tag_set(wanted)
    return not want or "*" in want or bool(want & tag_set(has)) or "*" in tag_set(has)


def is_tag_key(key: str) -> bool:
    return key.startswith(("tags_", "tags-"))


def filter_rules(rules: Iterable[Rule], tags: str = "", request: Mapping[str, str] | None = None) -> list[Rule]:
    """Rules that a request selects: by tags, by equal attributes, and by its tags_* keys.

    A rule with a filled tags_* attribute is left out unless the request meets it.
    """
    asked = {k: str(v) for k, v in (request or {}).items() if v}
    out = []
    for r in rules:
        named = {k: v for k, v in r.attrs.items() if is_tag_key(k) and v}
        fits = tags_meet(tags, r.tags)
        fits &= all(k in asked and tags_meet(asked[k], v) for k, v in named.items())
        fits &= all(r.attrs.get(k) == v for k, v in asked.items() if not is_tag_key(k))
        if fits:
            out.append(r)
    return out


@dataclass(frozen=True)
class RuleSet:
    """Compiled rules: those that can be applied, in order, those that can't with the reason, and of those that
    can the ones whose patterns may take exponential time."""

    rules: list[tuple[Rule, Criterion]]
    bad: list[tuple[Rule, str]]
    flagged: list[tuple[Rule, str]] = field(default_factory=list)


AMBIGUOUS = "a loop of the pattern reads a text in two ways, which can take exponential time"


def compile_rules(rules: Iterable[Rule], spark: SparkSession | None = None, refuse_ambiguous: bool = False, **options) -> RuleSet:
    """All rules, compiled; patterns are tried in one go, and one by one only if that fails.

    Rules with a pattern that can take exponential time are flagged, or refused if asked for.
    """
    made = [(r, compile_criterion(r.rule, spark=spark, try_pattern=False, **options)) for r in sorted_rules(rules)]
    spark = spark or SparkSession.getActiveSession()
    patterns = list(dict.fromkeys(c.pattern for _, c in made if c.kind != "dsl" and not c.error))
    wrong = {} if spark is None or not patterns or regex_error(spark, *patterns) is None else {p: regex_error(spark, p) for p in patterns}
    good, bad, flagged = [], [], []
    for r, c in made:
        error = c.error or (wrong.get(c.pattern) if c.kind != "dsl" else None if c.node is not None else "empty criterion")
        if not error and c.kind != "dsl" and ambiguous(c.pattern):
            flagged.append((r, AMBIGUOUS))
            error = AMBIGUOUS if refuse_ambiguous else None
        bad.append((r, error)) if error else good.append((r, c))
    return RuleSet(good, bad, flagged)


def trimmed(document: Column, kind: T.DataType, r: Rule, form) -> Column:
    """A document in its normalised form, cut to the rule's head and tail."""
    if not r.head and not r.tail:
        return document
    one = lambda x: head_tail(form(x), r.head, r.tail)
    if isinstance(kind, T.ArrayType):
        return F.transform(document, one)
    if isinstance(kind, T.MapType):
        return F.transform_values(document, lambda _, x: one(x))
    return one(document)


RESULTS = "array<struct<at:int,group:string,label:string,ok:boolean>>"


def emitted(results: Column, first_of_group: bool) -> Column:
    """Results (group, label, ok) that give a label, in order."""
    kind = "array<string>"
    start = F.struct(F.array().cast(kind).alias("groups"), F.array().cast(kind).alias("labels"), F.array().cast("array<int>").alias("at"))

    def step(acc: Column, r: Column) -> Column:
        used = F.array_contains(acc["labels"], r["label"])
        if first_of_group:
            used |= F.array_contains(acc["groups"], r["group"])
        grown = F.struct(F.concat(acc["groups"], F.array(r["group"])).alias("groups"), F.concat(acc["labels"], F.array(r["label"])).alias("labels"), F.concat(acc["at"], F.array(r["at"])).alias("at"))
        return F.when(r["ok"] & ~used, grown).otherwise(acc)

    return F.aggregate(results, start, step)


@dataclass
class Tested:
    """Rules as one expression: ``found`` is what the fold makes of their results, the rest what they were tested on."""

    found: Column
    tests: list[tuple[int, Rule, Criterion, int]]
    texts: dict[tuple, Column]
    forms: dict[tuple[int, str], int]


def tested(docs: DataFrame, rules: Iterable[tuple[int, Rule, Criterion]], document: str, fold: Callable[[Column], Column]) -> Tested:
    """All rules, numbered, on a document: texts and tokens that several need are made once."""
    kind, column = docs.schema[document].dataType, F.col(document)
    texts: dict[tuple, Column] = {}
    forms: dict[tuple[int, str], int] = {}
    tests = []
    for at, r, c in rules:
        regex = c.kind != "dsl"
        key = text_key(r, c)
        if key not in texts:
            text = trimmed(column, kind, r, light if regex else full)
            texts[key] = rewritten(text, kind, c.directives) if c.directives.any else text
        form = (list(texts).index(key), "light" if regex else "plain" if isinstance(c.node, Blank) else "tokens")
        tests.append((at, r, c, forms.setdefault(form, len(forms))))
    make = {"light": lightened, "tokens": token_array, "plain": lambda x, _: x}

    def result(at: int, r: Rule, c: Criterion, made: Column) -> Column:
        if c.kind != "dsl":
            ok = c.on_light(made, kind)
        else:
            ok = every_part(made, kind, is_blank) if isinstance(c.node, Blank) else c.on_tokens(made)
        return F.struct(F.lit(at).alias("at"), F.lit(r.group).alias("group"), F.lit(r.label).alias("label"), F.coalesce(ok, F.lit(False)).alias("ok"))

    def found_in(made: Column) -> Column:
        return fold(F.array(*[result(at, r, c, made[f"f{k}"]) for at, r, c, k in tests]).cast(RESULTS))

    if not tests:
        return Tested(fold(F.array().cast(RESULTS)), tests, texts, forms)
    bound = F.struct(*[x.alias(f"x{k}") for k, x in enumerate(texts.values())])
    found = let(bound, lambda z: let(F.struct(*[make[how](z[f"x{k}"], kind).alias(f"f{j}") for (k, how), j in forms.items()]), found_in))
    return Tested(found, tests, texts, forms)


def text_key(r: Rule, c: Criterion) -> tuple:
    """What tells apart the texts that rules are tested on."""
    return (c.kind != "dsl" and bool(r.head or r.tail), r.head, r.tail, replace(c.directives, criterion=""))


def apply_rules(docs: DataFrame, rules: RuleSet, document: str = "text", first_of_group: bool = True, with_spans: bool = False, detail: bool = False) -> DataFrame:
    """``docs`` with ``labels`` (in the order of emission) and on demand ``fired`` rules and ``spans``.

    With ``detail`` each fired rule comes with its weaker form and the text that it was tested on (as JSON
    for paged and fielded documents), with ``with_spans`` too with its own spans.

    The texts that the rules need (cut to head and tail, rewritten) are bound once, then what is made of
    them (light texts, tokens), and all rules are tested on these in one expression: a document is folded
    and tokenised once for each different text, whatever the number of rules.  Thousands of rules are for
    ``rule_index.apply_rule_index``.
    """
    kind = docs.schema[document].dataType
    made = tested(docs, [(at, r, c) for at, (r, c) in enumerate(rules.rules)], document, lambda results: emitted(results, first_of_group))
    found, tests, texts, forms = made.found, made.tests, made.texts, made.forms
    spans = []
    if with_spans:
        spans = [extract(texts[text_key(r, c)], kind, f"{'l' if c.kind == 'like' else 'r'}:{c.body}", dict(c.macros or {})) if c.kind != "dsl" else F.array().cast(SPAN) for _, r, c, _ in tests]
    out = docs.withColumn("_rules_found", F.explode_outer(F.array(found)))
    out = out.withColumn("labels", F.col("_rules_found.labels"))
    every = F.array(*spans) if spans else F.array().cast(f"array<{SPAN}>")
    if detail:
        as_text = lambda x: x.cast("string") if isinstance(kind, T.StringType) else F.to_json(x)
        shown = {k: as_text(x) for k, x in enumerate(texts.values())}
        text_of = {k: at for (at, _), k in forms.items()}
        listed = [[F.lit(r.group).alias("group"), F.lit(r.label).alias("label"), F.lit(r.rule).alias("rule"), F.lit(c.and_or_not).alias("and_or_not"), shown[text_of[k]].alias("processed")] for _, r, c, k in tests]
        if with_spans:
            listed = [[*columns, x.alias("spans")] for columns, x in zip(listed, spans, strict=True)]
        out = out.withColumn("fired", F.transform(F.col("_rules_found.at"), lambda k: F.get(F.array(*[F.struct(*x) for x in listed]), k)) if listed else F.array())
    if with_spans:
        out = out.withColumn("spans", F.flatten(F.transform(F.col("_rules_found.at"), lambda k: F.get(every, k))))
    return out.drop("_rules_found")


def label_rows(labelled: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, ord, label): one row a label."""
    return labelled.select(id_col, F.posexplode_outer("labels").alias("ord", "label")).where("ord IS NOT NULL")

"""Thousands of rules: each is filed under words that a document must have, and only those are tested.

A rule's key words are a set of which every matching document has one: of what must all be there the side
with the rarer words is taken, of alternatives both.  A document's distinct words meet the key words of all
rules, which gives the rules it may match; a rule that several of them lead to is tested at the first.

Candidates are evaluated by one expression, however many rules there are: a criterion is a row of steps in
postfix order, and the expression folds over them with a stack of position arrays, using the same kernels
as a criterion that is compiled alone.  Rules without key words (patterns, wildcards, comparisons, negations,
directives, heads and tails) are tested in one expression as before.

A rule that asks for two words a few places apart, and for nothing else, isn't a candidate at all: it is filed
under the pair.  The pairs that stand so close in a document, each once, meet the rules' pairs in one join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crivo.functions.tokens import TOKEN, let, unique_words, with_tokens
from crivo.operators.criteria import Criterion
from crivo.operators.rules import RESULTS, Rule, RuleSet, emitted, tested
from crivo.plans.arrays import near, nothing, reach, spellings, truth, wild_pattern
from crivo.plans.syntax import Absent, Binary, Blank, Compare, Node, Scope, Term, weaker

FILED = "word string, at int, `group` string, label string, keys array<string>, must array<string>, steps array<struct<op:string,words:array<string>,pattern:string,most:int,field:string,sign:string,value:string>>"

PAIRED = "pair string, at int, `group` string, label string"
#: The widest gap of a rule that is filed under a pair; a document has as many pairs as words times gap.
MOST_GAP = 20
#: Bytes of an index that every task may hold.
MOST_BROADCAST = 16 << 20
#: How two positions are brought together: (paragraph too, what is counted, either way).
BANDS = {"COM": (False, "p", False)} | {f"NEAR{k}": (paragraph, counted, both) for k, (paragraph, counted, both) in enumerate((p, c, b) for p in (False, True) for c in (None, "t") for b in (False, True))}


def step(op: str, words: Sequence[str] = (), pattern: str = "", most: int = 0, field: str = "", sign: str = "", value: str = "") -> tuple:
    return op, list(words), pattern, most, field, sign, value


def steps_of(node: Node, synonyms: Mapping[str, Sequence[str]]) -> list[tuple]:
    """A tree in postfix order."""
    match node:
        case Term():
            return [step("WILD", pattern=wild_pattern(node.word)) if node.wild and node.word.strip("$?") else step("TERM", () if node.wild else spellings(node, synonyms))]
        case Scope():
            return [*steps_of(node.of, synonyms), step("FIELD", field=node.field)]
        case Compare():
            return [step("COMPARE", field=node.field, sign=node.sign, value=node.value)]
        case Absent():
            return [*steps_of(node.of, synonyms), step("ABSENT")]
        case Binary():
            below = [*steps_of(node.left, synonyms), *steps_of(node.right, synonyms)]
            if node.name in ("E", "OU", "NAO"):
                return [*below, step(node.name)]
            paragraph, counted, most, both = reach(node.name, node.number)
            name = next(k for k, v in BANDS.items() if v == (paragraph, counted, both))
            return [*below, step(name, most=most)]
    raise TypeError(node)


def key_words(node: Node | None, synonyms: Mapping[str, Sequence[str]], df: Mapping[str, int]) -> set[str] | None:
    """Words of which a document that passes a weaker form has one, the rarest such set that the form shows; None if it shows none."""
    match node:
        case Term():
            return None if node.wild else set(spellings(node, synonyms))
        case Binary():
            left, right = key_words(node.left, synonyms, df), key_words(node.right, synonyms, df)
            if node.name == "OU":
                return None if left is None or right is None else left | right
            return min((k for k in (left, right) if k is not None), key=lambda k: (sum(df.get(w, 0) for w in k), sorted(k)), default=None)
    return None


def must_words(node: Node | None, synonyms: Mapping[str, Sequence[str]]) -> set[str]:
    """Words that a document which passes a weaker form has, every one of them."""
    match node:
        case Term():
            names = spellings(node, synonyms)
            return set(names) if not node.wild and len(names) == 1 else set()
        case Binary():
            left, right = must_words(node.left, synonyms), must_words(node.right, synonyms)
            return left & right if node.name == "OU" else left | right
    return set()


def gap_of(r: Rule, c: Criterion) -> tuple[bool, int] | None:
    """(same paragraph, how many words apart) of a rule that asks for two words close to each other; None of others."""
    n = c.node
    if not indexable(c) or r.head or r.tail or not isinstance(n, Binary) or n.name not in ("ADJ", "ADJC", "PROX", "PROXC"):
        return None
    if not all(isinstance(x, Term) and not x.wild for x in (n.left, n.right)):
        return None
    paragraph, counted, most, _ = reach(n.name, n.number)
    return (paragraph, most) if counted and most <= MOST_GAP else None


def paired(spark: SparkSession, rules: Sequence[tuple[int, Rule, Criterion]], gaps: Sequence[tuple[bool, int]]) -> DataFrame:
    """The index of rules on two words: a row for each pair of spellings, in both orders where either may come first."""
    rows = []
    for at, r, c in rules:
        left, right = (spellings(x, c.synonyms or {}) for x in (c.node.left, c.node.right))
        pairs = {(a, b) for a in left for b in right}
        if c.node.name.startswith("PROX"):
            pairs |= {(b, a) for a, b in pairs}
        rows += [(f"{gaps.index(gap_of(r, c))} {a} {b}", at, r.group, r.label) for a, b in sorted(pairs)]
    return small(spark.createDataFrame(rows, PAIRED), rows)


def pairs_of(tok: Column, gaps: Sequence[tuple[bool, int]]) -> Column:
    """The pairs of words, each once, that stand as close as one of ``gaps`` asks for; the tokens are those of one field."""

    def found(z: Column) -> Column:
        def at(k: int, paragraph: bool, d: int) -> Column:
            def pair(x: Column, i: Column) -> Column:
                other = F.get(z, i + d)
                both = F.concat(F.lit(f"{k} "), x["w"], F.lit(" "), other["w"])
                return F.when(x["p"] == other["p"], both) if paragraph else both

            return F.transform(z, pair)

        return F.array_distinct(F.concat(*[at(k, paragraph, d) for k, (paragraph, most) in enumerate(gaps) for d in range(most + 1)]))

    return let(tok, found)


def indexable(c: Criterion) -> bool:
    return c.kind == "dsl" and c.node is not None and not isinstance(c.node, Blank) and not c.directives.any


def document_frequencies(tokens: DataFrame, words: Sequence[str]) -> dict[str, int]:
    """In how many documents of (tok) rows the words of the rules stand; as many numbers as the rules have words."""
    # Not a plain explode: the filter that it brings along would make the tokens a second time.
    held = tokens.select(F.explode_outer(F.array_intersect(unique_words(F.col("tok")), F.array(*[F.lit(w) for w in words]))).alias("w"))
    return {r["w"]: r["n"] for r in held.where("w IS NOT NULL").groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}


def evaluated(tok: Column, steps: Column) -> Column:
    """Whether the tokens of a document match a criterion that is a column of steps."""
    stack_of = f"array<struct<at:{TOKEN}>>"
    flag = lambda yes: F.when(yes, truth()).otherwise(nothing())

    def run(stack: Column, s: Column) -> Column:
        top = lambda k: F.coalesce(F.try_element_at(stack, F.lit(-k))["at"], nothing())
        push = lambda kept, made: F.concat(F.slice(stack, 1, F.greatest(F.size(stack) - kept, F.lit(0))), F.array(F.struct(made.alias("at"))).cast(stack_of))
        leaf = F.when(s["op"] == "TERM", F.filter(tok, lambda x: F.array_contains(s["words"], x["w"])))
        leaf = leaf.when(s["op"] == "WILD", F.filter(tok, lambda x: F.rlike(x["w"], s["pattern"])))
        test = lambda x: F.coalesce(*[F.when(s["sign"] == sign, compared(x["w"], sign, s["value"])) for sign in ("=", ">", ">=", "<", "<=", "<>")], F.lit(False))
        leaf = leaf.otherwise(flag(F.exists(tok, lambda x: (x["c"] == s["field"]) & test(x))))
        one = F.when(s["op"] == "FIELD", F.filter(top(1), lambda x: x["c"] == s["field"])).otherwise(flag(F.size(top(1)) == 0))

        def joined(z: Column) -> Column:
            a, b = z["a"], z["b"]
            two = F.when(s["op"] == "E", F.when(F.size(a) > 0, b).otherwise(nothing()))
            two = two.when(s["op"] == "OU", F.concat(a, b)).when(s["op"] == "NAO", flag((F.size(a) > 0) & (F.size(b) == 0)))
            for name, (paragraph, counted, both) in BANDS.items():
                two = two.when(s["op"] == name, near(paragraph, counted, s["most"], both, a, b))
            return two

        pair = F.struct(top(2).alias("a"), top(1).alias("b"))
        return F.when(s["op"].isin("TERM", "WILD", "COMPARE"), push(0, leaf)).when(s["op"].isin("FIELD", "ABSENT"), push(1, one)).otherwise(push(2, let(pair, joined)))

    return F.aggregate(steps, F.array().cast(stack_of), run, lambda stack: F.size(F.element_at(stack, -1)["at"]) > 0)


def compared(w: Column, sign: str, value: Column) -> Column:
    """``compares`` where the value is a column: numbers with numbers, words with words."""
    number = lambda x: F.when(x.rlike("^[0-9]{1,38}$"), x.cast("decimal(38,0)"))
    word = lambda x: F.when(~x.rlike("^[0-9]+$"), x)
    fits = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "<>": lambda a, b: a != b}
    if sign == "=":
        return w == value
    return F.coalesce(F.when(value.rlike("^[0-9]+$"), fits[sign](number(w), number(value))).otherwise(fits[sign](word(w), value)), F.lit(False))


def small(index: DataFrame, rows: Sequence[tuple]) -> DataFrame:
    """An index for every task; its rows are on the driver, so their size is known, and a larger one is left to a shuffled join."""
    return F.broadcast(index) if sum(len(repr(row)) for row in rows) <= MOST_BROADCAST else index


def filed(spark: SparkSession, rules: Sequence[tuple[int, Rule, Criterion]], df: Mapping[str, int]) -> tuple[DataFrame, list[str], list[tuple[int, Rule, Criterion]]]:
    """The index, a row for each key word of each rule, its words, and the rules that have none."""
    rows, rest = [], []
    for at, r, c in rules:
        keys = key_words(weaker(c.node), c.synonyms or {}, df) if indexable(c) and not (r.head or r.tail) else None
        if keys is None:
            rest.append((at, r, c))
            continue
        steps = steps_of(c.node, c.synonyms or {})
        must = sorted(must_words(weaker(c.node), c.synonyms or {}))
        rows += [(word, at, r.group, r.label, sorted(keys), must, steps) for word in sorted(keys)]
    return small(spark.createDataFrame(rows, FILED), rows), sorted({row[0] for row in rows}), rest


def apply_rule_index(docs: DataFrame, rules: RuleSet, document: str = "text", id_col: str = "doc_id", first_of_group: bool = True) -> DataFrame:
    """(id, labels) of every document, its labels in the order of emission; ids are unique.

    The result is that of ``apply_rules``.
    """
    spark = docs.sparkSession
    tokens = with_tokens(docs.select(id_col, document), document).select(id_col, "tok")
    numbered = [(at, r, c) for at, (r, c) in enumerate(rules.rules)]
    # Fields whose names differ in case alone count their words apart, so pairs are read off plain and paged texts only.
    plain = not isinstance(docs.schema[document].dataType, (T.MapType, T.StructType))
    close = [x for x in numbered if plain and gap_of(*x[1:])]
    others = [x for x in numbered if not (plain and gap_of(*x[1:]))]
    parts = []
    if close:
        gaps = sorted({gap_of(r, c) for _, r, c in close})
        pairs = tokens.select(id_col, F.explode_outer(pairs_of(F.col("tok"), gaps)).alias("pair"))
        parts.append(pairs.join(paired(spark, close, gaps), "pair").select(id_col, F.struct("at", "group", "label", F.lit(True).alias("ok")).alias("r")))
    words = sorted({w for _, r, c in others if indexable(c) and not (r.head or r.tail) for w in listed_words(c)})
    index, keys, rest = filed(spark, others, document_frequencies(tokens, words) if words else {})
    if keys:
        known = tokens.withColumn("held", unique_words(F.col("tok")))
        hits = known.withColumn("hits", F.sort_array(F.array_intersect("held", F.array(*[F.lit(k) for k in keys]).cast("array<string>"))))
        led = hits.withColumn("word", F.explode_outer("hits")).join(index, "word")
        # A rule that several of a document's words lead to is tested once, at the first of them.
        first = F.array_min(F.array_intersect("keys", "hits")) == F.col("word")
        whole = F.forall("must", lambda w: F.array_contains("held", w))
        parts.append(led.where(first & whole).select(id_col, F.struct("at", "group", "label", evaluated(F.col("tok"), F.col("steps")).alias("ok")).alias("r")).where("r.ok"))
    if rest:
        alone = tested(docs, rest, document, lambda results: F.filter(results, lambda x: x["ok"]))
        parts.append(docs.select(id_col, F.explode(alone.found).alias("r")))
    if not parts:
        return docs.select(id_col, F.array().cast("array<string>").alias("labels"))
    matched = reduce(DataFrame.unionByName, parts)
    folded = matched.groupBy(id_col).agg(F.sort_array(F.collect_list("r")).cast(RESULTS).alias("results"))
    # Without a rule about groups the fold leaves each label's first place, which takes no search through those before.
    kept = let(F.col("results"), lambda x: emitted(x, True))["labels"] if first_of_group else F.array_distinct(F.col("results.label"))
    labels = folded.select(id_col, kept.alias("labels"))
    return docs.select(id_col).join(labels, id_col, "left").select(id_col, F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))


def listed_words(c: Criterion) -> list[str]:
    """Every word that could be a key of a criterion."""

    def of(n: Node | None) -> list[str]:
        match n:
            case Term():
                return [] if n.wild else spellings(n, c.synonyms or {})
            case Binary():
                return of(n.left) + of(n.right)
        return []

    return of(weaker(c.node)) if c.node is not None else []

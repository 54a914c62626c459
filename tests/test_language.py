import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from crivo.functions.normalize import full_text, singular_text
from crivo.plans.parser import parse, problem, tokens
from crivo.plans.syntax import Absent, Binary, CriterionError, Term, and_or_not, canonical, special, weaker


@pytest.mark.parametrize(
    "text,want",
    [
        ("Açúcar", "acucar"),
        ("R$ 1.234,56", "r$ 123456"),
        ("1.2.3", "12.3"),
        ("10, 20", "10 20"),
        ("a<br/>b<BR>c", "a\nb\nc"),
        ("§ 1 [x] {y}", " paragrafo  1 (x) (y)"),
        ("“a” ‘b´", '"a" ‘b"'),
    ],
)
def test_full_normalisation(text, want):
    assert full_text(text) == want


@pytest.mark.parametrize(
    "word,want",
    [("casas", "casa"), ("acoes", "acao"), ("paes", "pao"), ("jornais", "jornal"), ("papeis", "papel"), ("lencois", "lencol"), ("leis", "lei"), ("pais", "pai"), ("flores", "flor"), ("luzes", "luz"), ("fuzis", "fuzil"), ("homens", "homem"), ("onibus", "onibus"), ("gas", "gas"), ("class", "class"), ("www", "www"), ("bytes", "bytes"), ("crs", "crs"), ("accs", "accs"), ("casa", "casa")],
)
def test_singular(word, want):
    assert singular_text(word) == want


@pytest.mark.parametrize(
    "criterion,want",
    [
        ("casa papel", "casa E papel"),
        ("casas ADJ2 papeis NAO (x OU y)", "(casa ADJ2 papel) NAO (x OU y)"),
        ("a E b OU c ADJ3 d", "(a E b) OU (c ADJ3 d)"),
        ("NAO a E b", "NAO (a E b)"),
        ('"casa de papel"', '("casa" ADJ1 "de") ADJ1 "papel"'),
        ('"a" "b"', '"a" E "b"'),
        ("(a b) c", "(a E b) E c"),
        ('nao "a b" ', 'NAO ("a" ADJ1 "b")'),
        ('"casa"$', '"casa$"'),
        ("cas* teste-$", "cas$ E teste$"),
        ("abc123", "abc E 123"),
        ("a adj b", "a ADJ1 b"),
        ("casa.titulo.", "casa.titulo."),
        ("(casa papel.corpo.).titulo.", "casa.titulo. E papel.corpo."),
        ("@ano>=2017", "2017.ano>=."),
        ("(a NAO b) OU c", "(a NAO b) OU c"),
        ("<vazio>", "<vazio>"),
    ],
)
def test_canonical_form(criterion, want):
    assert canonical(parse(criterion)) == want


def test_equivalents_only_in_quotes():
    table = {"inss": ["instituto nacional"], "tribunal_de_contas": "tcu"}
    assert canonical(parse('"inss"', table)) == '"inss" OU ("instituto" ADJ1 "nacional")'
    assert canonical(parse("inss", table)) == "inss"
    assert '"tcu"' in canonical(parse('"tribunal de contas"', table))


@pytest.mark.parametrize("criterion", ['"a (b"', "a)", "(a", '"a', "E a", "(OU a)", "(a E)", "a E OU b", "a E NAO b", "a OU", "adj2 a", "OU"])
def test_errors(criterion):
    with pytest.raises(CriterionError):
        parse(criterion)
    assert problem(tokens(criterion))


def test_empty_criterion():
    assert parse("") is None and parse(" ... ") is None


@pytest.mark.parametrize(
    "criterion,want",
    [("a ADJ2 b", "a AND b"), ("a OU b COM c", "a OR (b AND c)"), ("a NAO b", "a NOT b"), ("a NAO (b ADJ2 c)", "a"), ("$asa E b", "asa AND b"), ("cas$", "cas*"), ("a.f. E @x>1", "a"), ("<vazio>", "")],
)
def test_index_form(criterion, want):
    assert and_or_not(parse(criterion)) == want


leaves = st.sampled_from([Term(w) for w in ("a1", "b", "cd", "x$", "y?z")])
trees = st.recursive(
    leaves,
    lambda t: st.builds(Binary, st.sampled_from(["E", "OU", "NAO", "MESMO", "ADJ", "ADJC", "PROX", "PROXC", "COM"]), t, t, st.integers(1, 4)) | st.builds(Absent, t),
    max_leaves=6,
)


@given(leaves | trees)
@settings(max_examples=200, deadline=None)
def test_canonical_text_parses_to_itself(tree):
    text = canonical(tree)
    once = canonical(parse(text))
    assert canonical(parse(once)) == once
    assert special(parse(once)) == special(parse(text))


@given(trees, st.lists(st.tuples(st.sampled_from(["a", "1", "b", "cd", "xx", "yaz"]), st.integers(0, 1)), max_size=7))
@settings(max_examples=300, deadline=None)
def test_weaker_condition_is_sound(tree, words):
    """Wherever a tree matches, its weaker form does, by a small evaluator of positions."""
    import re

    def positions(n):
        if isinstance(n, Term):
            pattern = n.word.replace("$", ".*").replace("?", ".?")
            return [(t, p) for t, (w, p) in enumerate(words) if (re.search(pattern, w) if n.wild else w == n.word)]
        if isinstance(n, Absent):
            return [] if positions(n.of) else [(0, 0)]
        a, b = positions(n.left), positions(n.right)
        if n.name == "E":
            return b if a else []
        if n.name == "OU":
            return a + b
        if n.name == "NAO":
            return [(0, 0)] if a and not b else []
        fits = [(x, y) for x, y in itertools.product(a, b) if ok(n, x, y)]
        return [y for _, y in fits] + ([x for x, _ in fits] if n.name.startswith("PROX") else [])

    def ok(n, x, y):
        t, p = y[0] - x[0], y[1] - x[1]
        return {"MESMO": True, "COM": 0 <= p < n.number, "ADJ": 0 <= t <= n.number, "ADJC": 0 <= t <= n.number and p == 0, "PROX": abs(t) <= n.number, "PROXC": abs(t) <= n.number and p == 0}[n.name]

    weak = weaker(tree)
    assert weak is None or not positions(tree) or positions(weak)

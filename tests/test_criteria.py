import pytest
from pyspark.sql import functions as F

from crivo.functions import normalize as N
from crivo.functions.patterns import expand, regex_error
from crivo.functions.tokens import posting_lists, postings, with_tokens
from crivo.operators import session as S
from crivo.operators.criteria import compile_criterion, evaluate, matching, trace
from crivo.operators.rewrite import removal_pattern, rewritten_text, split_directives
from crivo.operators.rules import Rule, apply_rules, compile_rules, filter_rules, label_rows, load_rules, rules_table
from crivo.operators.spans import extract_many, highlight, highlight_extractions
from crivo.plans.parser import parse
from crivo.plans.postings import search
from crivo.plans.thesaurus import EQUIVALENTS, SYNONYMS
from crivo.sources.ingest import read_rules, read_texts, rejoin_lines, split_pages, write_texts

HOUSE = "A casa de papel foi construída.\nO papel da casa é alegre, nº 1.234 em 2017"
PLAIN = [
    ("casa ADJ2 papel", True),
    ("casa ADJ1 papel", False),
    ("papel ADJ5 casa", True),
    ("papel ADJ2 construida", True),
    ("construida ADJ2 papel", True),
    ("construida ADJC2 papel", False),
    ("papel PROX2 casa", True),
    ("alegre PROXC3 casa", True),
    ("construida PROXC9 alegre", False),
    ("construida COM alegre", False),
    ("construida COM2 alegre", True),
    ("alegre COM2 construida", False),
    ("casas E papéis", True),
    ("casa NAO papel", False),
    ("casa NAO telha", True),
    ("NAO telha", True),
    ('"casa de papel"', True),
    ('"papel de casa"', False),
    ("cas$ E p?pel", True),
    ("feliz", True),
    ('"feliz"', False),
    ("telha OU muro OU alegre", True),
    ("1234", True),
    ("casa ADJ9 1234", True),
    ("casa MESMO alegre", True),
    ("casa.titulo.", False),
    ("@ano=2017", False),
    ("telha E (casa OU papel)", False),
    ("(casa OU telha) ADJ2 papel", True),
    ("r:constru[ií]da", True),
    ("r:CASA D.\\b", True),
    ("l:%papel%", False),
    ("l:papel%", False),
    ("<vazio>", False),
    ("", False),
    ("casa remover(alegre) E alegre", False),
    ("alegre recortar(a casa;papel)", False),
    ("casa recortar(a casa;papel)", True),
]


@pytest.fixture(scope="module")
def house(spark):
    return spark.createDataFrame([(1, HOUSE)], "doc_id long, text string")


def test_plain_documents(house):
    got = house.select(*[compile_criterion(c, SYNONYMS, EQUIVALENTS).on(F.col("text"), house.schema["text"].dataType).alias(f"c{k}") for k, (c, _) in enumerate(PLAIN)]).first()
    assert [(c, v) for (c, _), v in zip(PLAIN, got, strict=True)] == PLAIN


def test_postings_give_the_same(spark, house):
    docs = with_tokens(house)
    rows = postings(docs).cache()
    for criterion, want in PLAIN:
        c = compile_criterion(criterion, SYNONYMS, EQUIVALENTS)
        if c.kind == "dsl" and not c.directives.any and c.node is not None:
            assert bool(search(c.node, rows, docs, synonyms=SYNONYMS).collect()) == want, criterion


def test_paged_documents(spark):
    docs = spark.createDataFrame([(1, ["uma casa", None, "de papel"]), (2, []), (3, ["", " . "])], "doc_id long, pages array<string>")
    ask = lambda c: [r.matched for r in evaluate(docs, c, "pages").orderBy("doc_id").collect()]
    assert ask("casa ADJ2 papel") == [True, False, False]
    assert ask("casa COM2 papel") == [False, False, False]
    assert ask("casa COM3 papel") == [True, False, False]
    assert ask("r:papel") == [True, False, False]
    assert ask("<vazio>") == [False, True, True]
    spans = evaluate(docs, "r:pape.", "pages", with_spans=True).where("doc_id = 1").first().spans
    assert [(s.start, s.end, s.text, s.page) for s in spans] == [(3, 8, "papel", 3)]


def test_fielded_documents(spark):
    docs = spark.createDataFrame([(1, {"titulo": "casa de papel", "ano": "2017", "corpo": "uma telha"}), (2, {"titulo": None}), (3, {})], "doc_id long, f map<string,string>")
    ask = lambda c: next(r.matched for r in evaluate(docs, c, "f").collect() if r.doc_id == 1)
    cases = {"casa.titulo.": True, "casa.corpo.": False, "(casa papel).titulo.": True, "(casa telha.corpo.).titulo.": True, "casa ADJ5 telha": False, "casa E telha": True, "casa MESMO telha": False, "@ano>=2010": True, "@ano<2010": False, "@ano<>2016": True, "casa E @ano=2017": True, "@titulo=casa": True, "r:telha": True, "<vazio>": False}
    assert {c: ask(c) for c in cases} == cases
    spans = evaluate(docs, "r:telha", "f", with_spans=True).where("doc_id = 1").first().spans
    assert [(s.field, s.start) for s in spans] == [("corpo", 4)]


def test_struct_documents(spark):
    docs = spark.createDataFrame([(1, ("casa", "papel"))], "doc_id long, s struct<a:string,b:string>")
    assert matching(docs, "casa.a. E papel.b.", "s").count() == 1 and matching(docs, "casa.b.", "s").count() == 0


def test_errors_give_null(house):
    row = evaluate(house, "casa E", detail=True).first()
    assert row.matched is None and "operator" in row.error


def test_detail_and_marks(house):
    row = evaluate(house, '"casa de papel" OU alegre remover(telha)', detail=True, mark=True).first()
    assert row.matched and row.directives == "remover(telha)" and "alegre" in row.canonical
    assert "<mark>casa de papel</mark>" in row.highlighted and "<mark>alegre</mark>" in row.highlighted


def test_marks_keep_the_text(spark):
    docs = spark.createDataFrame([("Ação, ações e 1.234.\nação-x",), ("",), (None,)], "text string")
    got = [r.highlighted for r in highlight(docs, "acao OU 1234").collect()]
    assert got == ["<mark>Ação</mark>, <mark>ações</mark> e <mark>1.234</mark>.\n<mark>ação</mark>-x", "", None]


def test_normalisers_agree(spark):
    texts = ["Ação §1 [é] 1.234,5 e 1, 2", "ÀÉÎÕÜÇ ñ", "“q” 'r'", "a<br/>b <BR>", "ﬁ ß Ω ǆ"]
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select("x", N.full(F.col("x")).alias("full"), N.light(F.col("x")).alias("light")).collect()
    for r in rows:
        assert r.full == N.full_text(r.x)
        assert r.light == N.light_text(r.x) and len(r.light) == len(r.x) - 3 * r.x.count("<BR>")


def test_small_text_functions(spark):
    row = spark.createDataFrame([('a "b" c "d"', 'x "y', "o'neil “z” 'k'", "abcdefghij", "l\\nm")], "q string, odd string, u string, h string, n string").select(
        N.remove_quoted(F.col("q")).alias("q"), N.remove_quoted(F.col("odd")).alias("odd"), N.unify_quotes(F.col("u")).alias("u"),
        N.head_tail(F.col("h"), 2, 3).alias("both"), N.head_tail(F.col("h"), 6, 6).alias("whole"), N.head_tail(F.col("h"), -1, 3).alias("tail"), N.literal_breaks(F.col("n")).alias("n"),
    ).first()
    assert row == ("a   c  ", 'x "y', "o'neil \"z\" \"k\"", "ab hij", "abcdefghij", "hij", "l\nm")


@pytest.mark.parametrize(
    "pattern,text,want",
    [
        ("<CPF>", "cpf 123.456.789-09 ok", True),
        ("<CPF>", "1234567890", False),
        ("<CPF:12345678909>", "x i23.456.789-o9", True),
        ("<CNPJ>", "42.318.949/0001-84", True),
        ("<CNPJ:42318949>", "42.318.949/0001-84", True),
        ("<NUM:1234,50>", "total 1.234,50", True),
        ("<NUM:1234>", "11234", False),
        ("<OAB:DF1234>", "OAB/DF n. 1.234", True),
        ("<OAB:DF1234-> fim", "DF 1234-A fim", False),
        ("<OAB:DF1234A>", "DF 1234-A", True),
        ("<OAB>", "sob o n. 123/SP", True),
        ("a<TERMO>b", "a xyz b", True),
    ],
)
def test_ready_made_patterns(spark, pattern, text, want):
    from crivo.functions.patterns import regex_matches

    assert spark.createDataFrame([(text,)], "x string").select(regex_matches(F.col("x"), f"r:{pattern}").alias("m")).first().m == want


def test_pattern_validity(spark):
    assert regex_error(spark, "(a") and regex_error(spark, expand("<OAB:SP123>")) is None


def test_several_patterns(house):
    got = house.select(extract_many(F.col("text"), [{"regex": "papel", "kind": "p"}, {"regex": "casa", "kind": "c", "hide": "1"}], drop=("hide",)).alias("s")).first().s
    assert [(x.start, x.meta) for x in got] == [(2, '{"kind":"c"}'), (10, '{"kind":"p"}'), (34, '{"kind":"p"}'), (43, '{"kind":"c"}')]


@pytest.mark.parametrize(
    "directives,text,want",
    [
        ("remover(b?c)", "a bxc d bc e", "a   d   e"),
        ("remover(juizado*grau)", "o juizado de 1 grau diz", "o   diz"),
        ("remover(%**%)", 'x (abc) "de" y', 'x  de" y'),
        ("remover(aspas)", 'x "a b" y', "x   y"),
        ("remover(artigo&)", "artigos artigo", "  artigo".strip()),
        ("recortar(inicio;fim)", "0 inicio a fim b inicio c fim d", "inicio a fim\ninicio c fim"),
        ("recortar(inicio;)", "0 inicio a", "inicio a"),
        ("recortar(;fim)", "a fim b", "a fim"),
        ("recortar(inicio;fim)", "nada", ""),
        ("recortar(inicio?;fim)", "a fim b", "a fim"),
        ("recortar(inicio;fim?)", "x inicio b", "inicio b"),
        ("recortar(inicio?;fim?)", "só isso", "só isso"),
        ("recortar(A;B) remover(x)", "k Á x B", "Á   B"),
    ],
)
def test_directives(spark, directives, text, want):
    got = spark.createDataFrame([(text,)], "x string").select(rewritten_text(F.col("x"), split_directives(directives)).alias("y")).first().y
    assert got == want


def test_bad_directive_is_an_error():
    assert "remover" in compile_criterion("a remover(x{2,1})").error
    assert removal_pattern("***") == '[^"]{1,300}' and removal_pattern("a.b") == "a\\.b"


RULES = [
    Rule("g1", "A", "casa", 1, tags="t1 t2"),
    Rule("g1", "B", "papel", 2, tags="t2"),
    Rule("g2", "A", "papel", 1),
    Rule("g2", "C", "r:telha|alegre", 2, attrs={"uf": "df"}),
    Rule("g3", "D", "casa E", 1),
    Rule("g4", "H", "alegre", 1, head=10, attrs={"tags_letra": "x"}),
]


def test_rules(house):
    rules = compile_rules(RULES)
    assert [(r.label, bool(e)) for r, e in rules.bad] == [("D", True)]
    # A was emitted by g1, so g2 falls through to its next rule.
    assert apply_rules(house, rules).first().labels == ["A", "C"]
    row = apply_rules(house, rules, first_of_group=False, with_spans=True, detail=True).first()
    assert row.labels == ["A", "B", "C"] and [s.text for s in row.spans] == ["alegre"] and [f.rule for f in row.fired] == ["casa", "papel", "r:telha|alegre"]
    assert apply_rules(house, compile_rules([])).first().labels == []


def test_rule_filters():
    names = lambda **k: [r.label for r in filter_rules(RULES, **k)]
    assert names() == ["A", "B", "A", "C", "D"]
    assert names(tags="t1") == ["A"] and names(tags="t2,t9") == ["A", "B"] and names(tags="*") == ["A", "B", "A", "C", "D"]
    assert names(request={"uf": "df"}) == ["C"] and names(request={"uf": ""}) == names()
    assert names(request={"tags_letra": "x y"}) == ["A", "B", "A", "C", "D", "H"] and "H" not in names(request={"tags_letra": "z"})


def test_rule_tables_and_files(spark, tmp_path):
    assert load_rules(rules_table(spark, RULES)) == RULES
    path = tmp_path / "rules.json"
    path.write_text('{"regras": [{"grupo": "g", "rotulo": "r", "regra": "casa", "ordem": 2, "qtd_cabecalho": 5, "uf": "sp"}]}')
    assert read_rules(spark, str(path)) == [Rule("g", "r", "casa", 2, head=5, attrs={"uf": "sp"})]


def test_ingest(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("ação".encode())
    (tmp_path / "b.txt").write_bytes("ação".encode("latin-1"))
    assert [r.text for r in read_texts(spark, f"{tmp_path}/*.txt").collect()] == ["ação", "ação"]
    t = spark.createDataFrame([("a<<pg>>b<<pg>>",), ("<<pg>>a",), ("a",)], "x string")
    assert [r.p for r in t.select(split_pages(F.col("x")).alias("p")).collect()] == [["a", "b", ""], ["<<pg>>a"], ["a"]]
    lines = spark.createDataFrame([("Uma linha\nquebrada. \nOutra do art.\n5 segue\n\nfim!\nnova",)], "x string").select(rejoin_lines(F.col("x")).alias("y")).first().y
    assert lines == "Uma linha quebrada. \nOutra do art. 5 segue fim!\nnova"
    write_texts(t.withColumnRenamed("x", "text"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 3


def test_posting_lists(spark):
    docs = with_tokens(spark.createDataFrame([(1, "casas a\ncasa 2")], "doc_id long, text string"))
    assert {r.w: [(x.t, x.p) for x in r["at"]] for r in posting_lists(docs).collect()} == {"casa": [(0, 0), (2, 1)], "a": [(1, 0)], "2": [(3, 1)]}


def test_sessions(spark):
    docs = with_tokens(spark.createDataFrame([(1, "casa casa papel"), (2, "papel longe da casa"), (3, "papel"), (4, "casa papel")], "doc_id long, text string"))
    found = S.search(docs, "casa ADJ1 papel", limit=1).collect()
    assert [(r.doc_id, r.score) for r in found] == [(1, 3)]
    first = S.start_session("s", S.pre_search(docs, compile_criterion("casa ADJ1 papel")))
    assert sorted(r.id for r in first.collect()) == [1, 2, 4]
    more = S.unite(first, S.start_session("s", S.pre_search(docs, compile_criterion("papel"))))
    assert sorted(r.id for r in more.collect()) == [1, 2, 3, 4]
    hits = matching(docs.select("doc_id", "text"), "casa ADJ1 papel").selectExpr("doc_id AS id")
    done = S.refine(more, hits)
    assert {r.id: r.status for r in done.collect()} == {1: "F", 2: "X", 3: "X", 4: "F"}
    assert S.accepted(S.refine(more, hits, 1)).count() == 1
    roll = S.rollup(done).first()
    assert (roll.n_docs, roll.n_accepted, roll.n_removed) == (4, 2, 2)
    assert {r.id: r.status for r in S.narrow(first, hits).collect()} == {1: "P", 2: "X", 4: "P"}
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    log = spark.createDataFrame([(1, "2024-01-01 13:00:00"), (2, "2023-12-31 00:00:00")], "id long, created string").withColumn("created", F.col("created").cast("timestamp")).withColumn("used", F.col("created"))
    assert [r.id for r in S.purge(log, now).collect()] == [1]
    assert {r.id: r.used.day for r in S.touch(log, now).collect()} == {1: 1, 2: 2}
    changed = spark.createDataFrame([(1, "2024-01-01 12:00:00"), (2, "2024-01-01 00:00:00"), (3, "2024-01-01 00:00:00")], "id long, updated string").withColumn("updated", F.col("updated").cast("timestamp"))
    assert [r.id for r in S.fresh(log, changed).collect()] == [1] and sorted(r.id for r in S.stale(log, changed).collect()) == [2, 3]
    with pytest.raises(ValueError):
        S.DocSource("t", text_col="nope").read(docs)


def test_a_document_is_folded_and_tokenised_once_for_all_rules(spark):
    docs = spark.createDataFrame([(1, "a casa de papel"), (2, "um muro 1234")], "doc_id long, text string")
    rules = compile_rules([Rule("g", f"l{k}", c, k) for k, c in enumerate(("casa ADJ2 papel", "muro", "r:[0-9]{3}", "NAO telha", "casa OU telha", "r:cas."))])
    labelled = label_rows(apply_rules(docs, rules, first_of_group=False))
    plan = labelled._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[0-9]+|[a-z]+") == 1
    assert sorted((r.doc_id, r.label) for r in labelled.collect()) == [(1, "l0"), (1, "l3"), (1, "l4"), (1, "l5"), (2, "l1"), (2, "l2"), (2, "l3")]


def test_a_bad_pattern_is_an_error_of_its_rule(spark):
    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert matching(docs, "r:(abc").collect() == []
    assert [r.matched for r in evaluate(docs, "r:(abc").collect()] == [None]
    rules = compile_rules([Rule("g", "bad", "r:(abc", 1), Rule("g", "good", "r:abc", 2)])
    assert [r.label for r, _ in rules.bad] == ["bad"] and [r.label for r in label_rows(apply_rules(docs, rules)).collect()] == ["good"]


def test_equivalents_replace_whole_phrases():
    table = {"casa_de_papel": ["maison", "la casa"], "muro": "parede"}
    assert parse('"casa de papel"', table) == parse('("casa de papel" OU "maison" OU "la casa")')
    assert parse('telha E ("muro" NAO "casa de papel azul")', table) == parse('telha E (("muro" OU "parede") NAO "casa de papel azul")')
    assert parse("muro", table) == parse("muro")


def test_fired_rules_carry_their_spans_and_texts(spark):
    docs = spark.createDataFrame([(1, "Um muro 1234 e 567, casa")], "doc_id long, text string")
    rules = compile_rules([Rule("a", "numbers", "r:[0-9]{3,}", 1), Rule("b", "wall", "muro remover(casa)", 2), Rule("c", "head", "r:muro", 3, head=7), Rule("d", "none", "telha", 4)])
    row = apply_rules(docs, rules, with_spans=True, detail=True).collect()[0]
    assert [f.label for f in row.fired] == ["numbers", "wall", "head"]
    assert [[s.text for s in f.spans] for f in row.fired] == [["1234", "567"], [], ["muro"]]
    assert row.fired[0].processed == "Um muro 1234 e 567, casa" and "casa" not in row.fired[1].processed and row.fired[2].processed == "um muro"


def test_extractions_are_marked_in_every_page_and_field(spark):
    paged = spark.createDataFrame([(["a 1", "b\n22", "c"], {"x": "3 z", "y": "w"})], "pages array<string>, fields map<string,string>")
    assert highlight_extractions(paged, "r:[0-9]+", "pages").first().highlighted == ["a <mark>1</mark>", "b<br><mark>22</mark>", "c"]
    assert highlight_extractions(paged, "r:[0-9]+", "fields").first().highlighted == {"x": "<mark>3</mark> z", "y": "w"}


def test_trace_counts_positions_of_every_part(house):
    got = trace(house, "(casa ADJ9 papel) NAO telha").first().trace
    assert [x.n_positions for x in got][:3] == [2, 2, 2] and got[-1].n_positions == 1 and got[-2].n_positions == 0
    assert trace(house, "").first().trace == []

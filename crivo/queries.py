"""Registered queries over the test tables, each with the SQL of the same result.

The texts are invented en/fr/de/es prose, so criteria use words such as the, of, and, la, der.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crivo import oracle as O
from crivo.functions import normalize as N
from crivo.functions.patterns import expand, regex_matches
from crivo.functions.sql import register_normaliser
from crivo.functions.tokens import page_text, postings, unique_words, with_tokens, words
from crivo.operators import session as S
from crivo.operators.cached_search import CachedSearch
from crivo.operators.criteria import compile_criterion, matching, trace
from crivo.operators.rewrite import rewritten_text, split_directives
from crivo.operators.rule_index import apply_rule_index
from crivo.operators.rules import Rule, apply_rules, compile_rules, filter_rules, label_rows, load_rules
from crivo.operators.spans import extract, extract_many, highlight, highlight_extractions, highlight_spans, highlight_terms
from crivo.plans.parser import parse
from crivo.plans.postings import search as postings_search
from crivo.plans.syntax import special
from crivo.sources.ingest import ABBREVIATIONS, rejoin_lines, split_pages, turns_as_pages
from crivo.sources.store import TokenStore, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Partitions of the scan from which on documents are read as they lie.
MOST_PARTS = 64
SYNONYMS = {"the": ["la", "der"], "of": ["de"]}
EQUIVALENTS = {"of the": ["de la", "von der"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, sql: str | None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt anew where their scan has fewer partitions than a shuffle.

    A file of one row group is one task, however costly the criteria are; a corpus of many files isn't moved.
    """
    docs, parts = table(spark, sf_dir, "documents"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    return docs.repartition(parts) if docs.rdd.getNumPartitions() < min(parts, MOST_PARTS) else docs


def fielded(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = [x for c in ("lang", "source", "text") for x in (F.lit(c), F.col(c))]
    return documents(spark, sf_dir).select("doc_id", F.create_map(*entries).alias("fields"))


# --- tokens and normalisation ------------------------------------------------------------------------


@register("norm_text", f"SELECT doc_id, md5({O.full('text')}) AS digest FROM documents")
def norm_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(N.full(F.col("text"))).alias("digest"))


@register("light_norm", f"SELECT doc_id, md5({O.light('text')}) AS digest FROM documents")
def light_norm(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(N.light(F.col("text"))).alias("digest"))


@register("token_count", f"WITH {O.tokens()} SELECT d.doc_id, count(t.w) AS n_tokens, coalesce(max(t.p), 0) AS last_paragraph FROM documents d LEFT JOIN tok t USING (doc_id) GROUP BY d.doc_id")
def token_count(spark, sf_dir):
    docs = with_tokens(documents(spark, sf_dir))
    return docs.select("doc_id", F.size("tok").cast("long").alias("n_tokens"), F.coalesce(F.array_max(F.transform("tok", lambda x: x["p"])), F.lit(0)).cast("long").alias("last_paragraph"))


@register("token_df", f"WITH {O.tokens()} SELECT w, count(DISTINCT doc_id) AS df, count(*) AS tf FROM tok GROUP BY w")
def token_df(spark, sf_dir):
    # Words are counted as they stand first, so that each word of a document is brought to its singular once.
    found = documents(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all(N.full(F.col("text")), F.lit("[0-9]+|[a-z]+"), 0)).alias("word"))
    per_form = found.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    per_doc = per_form.groupBy(N.singular(F.col("word")).alias("w"), "doc_id").agg(F.sum("n").alias("n"))
    return per_doc.groupBy("w").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("tf"))


@register("singular_vocab", f"WITH {O.tokens()} SELECT w0 AS word, w AS singular FROM vocab")
def singular_vocab(spark, sf_dir):
    found = documents(spark, sf_dir).select(F.explode(F.regexp_extract_all(N.full(F.col("text")), F.lit("[0-9]+|[a-z]+"), 0)).alias("word")).distinct()
    return found.select("word", N.singular(F.col("word")).alias("singular"))


@register("unique_tokens", f"WITH {O.tokens()} SELECT d.doc_id, count(DISTINCT t.w) AS n_words FROM documents d LEFT JOIN tok t USING (doc_id) GROUP BY d.doc_id")
def unique_tokens(spark, sf_dir):
    return with_tokens(documents(spark, sf_dir)).select("doc_id", F.size(unique_words(F.col("tok"))).cast("long").alias("n_words"))


@register("postings_agg", f"WITH {O.tokens()} SELECT doc_id, w, string_agg(t || '/' || p, ' ' ORDER BY t) AS at FROM tok GROUP BY doc_id, w")
def postings_agg(spark, sf_dir):
    rows = postings(with_tokens(documents(spark, sf_dir)).select("doc_id", "tok")).groupBy("doc_id", "w").agg(F.sort_array(F.collect_list(F.struct("t", "p"))).alias("at"))
    return rows.select("doc_id", "w", F.array_join(F.transform("at", lambda x: F.concat_ws("/", x["t"], x["p"])), " ").alias("at"))


@register("word_stream", f"SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all({O.full('text')}, '[0-9]+|[a-z]+|\\n'), lambda x: {O.singular('x')}), ' ')) AS digest FROM documents")
def word_stream(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(F.array_join(words(F.col("text")), " ")).alias("digest"))


# --- criteria: array mode and postings mode ---------------------------------------------------------

CRITERIA = {
    "term": "thing",
    "term_and": "was E that",
    "term_or": "thing OU einst",
    "term_not": "the NAO that",
    "unary_not": "NAO of",
    "phrase": '"of the"',
    "wild_many": "anb$ed",
    "wild_one": "tha?",
    "adj": "the ADJ2 of",
    "adjc": "the ADJC2 of",
    "prox": "of PROX3 that",
    "proxc": "of PROXC3 that",
    "com1": "la COM de",
    "com3": "the COM3 thing",
    "mesmo": "the MESMO of",
    "adj_chain": "the ADJ20 of ADJ20 and ADJ20 is",
    "group_precedence": "and E that OU la ADJ3 de",
    "nao_binds_and_run": "the NAO that E with",
    "or_inside_adj": "(the OU la) ADJ2 (of OU de)",
    "nested": "((the ADJ3 of) E (that NAO was)) OU (der ADJ2 die)",
}


def match_query(criterion: str, **options) -> Query:
    def run(spark, sf_dir):
        return matching(documents(spark, sf_dir).select("doc_id", "text"), compile_criterion(criterion, **options)).select("doc_id")

    return run


def postings_query(criterion: str) -> Query:
    def run(spark, sf_dir):
        docs = with_tokens(documents(spark, sf_dir).select("doc_id", "text"))
        return postings_search(parse(criterion), postings(docs), docs)

    return run


for _name, _criterion in CRITERIA.items():
    register(_name, O.matching(_criterion))(match_query(_criterion))
for _name in ("term_and", "term_not", "unary_not", "phrase", "adj", "proxc", "com3", "or_inside_adj"):
    register(f"{_name}_postings", O.matching(CRITERIA[_name]))(postings_query(CRITERIA[_name]))
register("synonym", O.matching("the ADJ1 of", synonyms=SYNONYMS))(match_query("the ADJ1 of", synonyms=SYNONYMS))
register("equivalent", O.matching('"of the"', equivalents=EQUIVALENTS))(match_query('"of the"', equivalents=EQUIVALENTS))


def stored_query(criterion: str) -> Query:
    def run(spark, sf_dir):
        docs = documents(spark, sf_dir).select("doc_id", "text")
        store = TokenStore(shared_folder(spark, "tokens"))
        store.refresh(docs)
        return store.search(docs, criterion)

    return run


for _name in ("adj", "unary_not", "nested", "wild_many"):
    register(f"{_name}_stored", O.matching(CRITERIA[_name]))(stored_query(CRITERIA[_name]))


def stored_fields_query(criterion: str) -> Query:
    def run(spark, sf_dir):
        docs = fielded(spark, sf_dir)
        store = TokenStore(shared_folder(spark, "tokens"), document="fields")
        store.refresh(docs)
        return store.search(docs, criterion)

    return run


for _name, _criterion in {"field_cmp_stored": "of E @source>=12", "field_scope_stored": "(de ADJ3 la).text. E fr.lang."}.items():
    register(_name, O.matching(_criterion, fields=True))(stored_fields_query(_criterion))


@register("topk_stored", f"""WITH {O.tokens()}, sizes AS (SELECT d.doc_id, count(t.w) AS size FROM documents d LEFT JOIN tok t USING (doc_id) GROUP BY d.doc_id),
corpus AS (SELECT count(*) AS n, avg(size) AS mean FROM sizes),
tf AS (SELECT doc_id, w, count(*) AS tf FROM tok WHERE w IN ('the', 'of') GROUP BY doc_id, w), df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
scores AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS score FROM tf JOIN df USING (w) JOIN sizes USING (doc_id), corpus GROUP BY doc_id)
SELECT doc_id, round(score, 6) AS score FROM (SELECT DISTINCT doc_id FROM ({O.select(parse('the ADJ2 of'))})) JOIN scores USING (doc_id) ORDER BY scores.score DESC, doc_id LIMIT 20""")
def topk_stored(spark, sf_dir):
    """The best matches by the weight of their words in the document and in the corpus."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    store = TokenStore(shared_folder(spark, "tokens"))
    store.refresh(docs)
    return store.ranked(docs, "the ADJ2 of", 20).select("doc_id", F.round("score", 6).alias("score"))


_CHANGED = "SELECT doc_id, '' AS c, CASE WHEN lang = 'en' THEN 'la de ' || text ELSE text END AS text FROM documents"


@register("stored_refresh", f"WITH {O.tokens(_CHANGED)} SELECT DISTINCT doc_id FROM ({O.select(parse('(la ADJ1 de) NAO thing'))})")
def stored_refresh(spark, sf_dir):
    """English documents change after the first indexing; the second one reads them alone."""
    docs, changed = changed_documents(spark, sf_dir)
    store = TokenStore(shared_folder(spark, "tokens"), date_col="updated")
    store.refresh(docs)
    store.refresh(changed)
    return store.search(changed, "(la ADJ1 de) NAO thing")


def changed_documents(spark, sf_dir):
    """Documents of one day, and as they are a day later, when the English ones have changed."""
    at = lambda day: F.lit(f"2024-01-{day} 00:00:00").cast("timestamp")
    docs = documents(spark, sf_dir).select("doc_id", "lang", "text")
    english = F.col("lang") == "en"
    text = F.when(english, F.concat(F.lit("la de "), F.col("text"))).otherwise(F.col("text"))
    return docs.withColumn("updated", at("01")), docs.withColumn("text", text).withColumn("updated", F.when(english, at("02")).otherwise(at("01")))


def field_query(criterion: str) -> Query:
    def run(spark, sf_dir):
        docs = fielded(spark, sf_dir)
        return matching(docs, criterion, "fields").select("doc_id")

    return run


for _name, _criterion in {"field_scope": "(de ADJ3 la).text. E fr.lang.", "field_eq": "the E @lang=en", "field_cmp": "of E @source>=12", "field_same": "en MESMO the"}.items():
    register(_name, O.matching(_criterion, fields=True))(field_query(_criterion))


@register("empty_text", "SELECT doc_id, regexp_matches(text, '^[-\\s.,;:/?_=+`´~^\"!@#$%¨&*\\\\<>()\\[\\]{}|'']*$') AS blank FROM documents")
def empty_text(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", compile_criterion("<vazio>").on(F.col("text"), docs.schema["text"].dataType).alias("blank"))


@register("prefilter", f"WITH {O.tokens()} SELECT doc_id FROM tok GROUP BY doc_id HAVING bool_or(w = 'the') AND bool_or(w IN ('of', 'and'))")
def prefilter(spark, sf_dir):
    c = compile_criterion("(the ADJ2 (of OU and)) NAO (that ADJ9 is)")
    docs = with_tokens(documents(spark, sf_dir).select("doc_id", "text"))
    return docs.where(c.maybe_on_tokens(F.col("tok"))).select("doc_id")


# --- regular expressions -----------------------------------------------------------------------------


@register("regex_match", f"SELECT doc_id FROM documents WHERE regexp_matches({O.light('text')}, '(?i)\\bth[a-z]*tion\\b')")
def regex_match(spark, sf_dir):
    return documents(spark, sf_dir).where(regex_matches(F.col("text"), r"r:\bth[a-z]*tion\b")).select("doc_id")


@register("like_match", f"SELECT item_id FROM benchmark WHERE regexp_matches({O.light('text')}, '^.*the.*of.*$')")
def like_match(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").where(regex_matches(F.col("text"), "l:%the%of%")).select("item_id")


def _spans_sql(pattern: str, source: str = "SELECT doc_id, text FROM documents") -> str:
    return f"""
WITH f AS (SELECT doc_id, regexp_extract_all(x, '{pattern}') AS found, string_split_regex(x, '{pattern}') AS pieces FROM (SELECT doc_id, {O.light("text")} AS x FROM ({source}))),
u AS (SELECT doc_id, unnest(found) AS found, unnest(pieces[:len(found)]) AS piece, generate_subscripts(found, 1) AS k FROM f)
SELECT doc_id, CAST(k - 1 AS BIGINT) AS ord,
  CAST(sum(length(piece)) OVER w + coalesce(sum(length(found)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
  CAST(sum(length(piece) + length(found)) OVER w AS BIGINT) AS "end", found AS hit
FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY k)"""


@register("regex_offsets", _spans_sql("[a-z]+tion[a-z]*"))
def regex_offsets(spark, sf_dir):
    docs = documents(spark, sf_dir)
    spans = docs.select("doc_id", F.posexplode(extract(F.col("text"), docs.schema["text"].dataType, "r:[a-z]+tion[a-z]*")).alias("ord", "s"))
    return spans.select("doc_id", F.col("ord").cast("long").alias("ord"), F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"), N.light(F.col("s.text")).alias("hit"))


@register("regex_zero_width", f"""WITH p AS (SELECT doc_id, string_split(x, 'tion') AS pieces FROM (SELECT doc_id, {O.light('text')} AS x FROM documents)),
u AS (SELECT doc_id, unnest(pieces[:len(pieces) - 1]) AS piece, generate_subscripts(pieces[:len(pieces) - 1], 1) AS k FROM p)
SELECT doc_id, CAST(k - 1 AS BIGINT) AS ord, CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k) + 4 * (k - 1) AS BIGINT) AS start, CAST(0 AS BIGINT) AS size FROM u""")
def regex_zero_width(spark, sf_dir):
    """Places before an ending, which are matches of no length."""
    docs = documents(spark, sf_dir)
    spans = docs.select("doc_id", F.posexplode(extract(F.col("text"), docs.schema["text"].dataType, "r:(?=tion)")).alias("ord", "s"))
    return spans.select("doc_id", F.col("ord").cast("long").alias("ord"), F.col("s.start").cast("long").alias("start"), (F.col("s.end") - F.col("s.start")).cast("long").alias("size"))


#: The tables hold no registrations, so each document gets one, made from its number; Spark and SQL read this alike.
_NUMBER = "lpad(CAST(doc_id AS VARCHAR(12)), 9, '0')"
_MADE = f"""text || ' x ' || CASE doc_id % 5
 WHEN 0 THEN substr({_NUMBER}, 1, 3) || '.' || substr({_NUMBER}, 4, 3) || '.' || substr({_NUMBER}, 7, 3) || '-09'
 WHEN 1 THEN substr({_NUMBER}, 1, 2) || '.' || substr({_NUMBER}, 3, 3) || '.' || substr({_NUMBER}, 6, 3) || '/0001-95'
 WHEN 2 THEN '1.000,00'
 WHEN 3 THEN 'OAB/SP n. ' || substr({_NUMBER}, 4, 3) || '.' || substr({_NUMBER}, 7, 3)
 ELSE '1l.' || substr({_NUMBER}, 5, 2) END || ' y'"""

for _name, _macro in {"macro_cpf": "<CPF>", "macro_cnpj": "<CNPJ>", "macro_num": "<NUM:1000>", "macro_oab": "<OAB>", "macro_oab_value": "<OAB:SP000123>", "macro_cpf_value": "<CPF:00000000509>", "macro_cnpj_value": "<CNPJ:00000000>"}.items():

    def _macro_query(spark, sf_dir, macro=_macro):
        made = documents(spark, sf_dir).select("doc_id", F.expr(_MADE).alias("text"))
        return made.select("doc_id", regex_matches(F.col("text"), f"r:{macro}").alias("found"))

    register(_name, f"SELECT doc_id, regexp_matches({O.light('text')}, {O.literal(expand(_macro))}) AS found FROM (SELECT doc_id, {_MADE} AS text FROM documents)")(_macro_query)


# --- rewriting and marking ---------------------------------------------------------------------------


@register("remove_quotes", """SELECT doc_id, md5(CASE WHEN n > 0 AND n % 2 = 0 THEN regexp_replace(trim(text), '"[^"]*"', ' ', 'g') ELSE text END) AS digest
FROM (SELECT doc_id, text, length(text) - length(replace(text, '"', '')) AS n FROM documents)""")
def remove_quotes(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(N.remove_quoted(F.col("text"))).alias("digest"))


@register("remove_pattern", f"SELECT doc_id, md5(trim(regexp_replace({O.light('text')}, 'the .{{0,100}}tion', ' ', 'g'))) AS digest FROM documents")
def remove_pattern(spark, sf_dir):
    d = split_directives("of remover(the *tion)")
    return documents(spark, sf_dir).select("doc_id", F.md5(N.light(rewritten_text(F.col("text"), d))).alias("digest"))


@register("crop", f"SELECT doc_id, array_to_string(regexp_extract_all({O.light('text')}, '(?s)the.*?tion'), chr(10)) AS cropped FROM documents")
def crop(spark, sf_dir):
    d = split_directives("of recortar(the;tion)")
    return documents(spark, sf_dir).select("doc_id", N.light(rewritten_text(F.col("text"), d)).alias("cropped"))


@register("head_tail", "SELECT doc_id, CASE WHEN length(text) <= 150 THEN text ELSE left(text, 100) || ' ' || right(text, 50) END AS cut FROM documents")
def head_tail(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", N.head_tail(F.col("text"), 100, 50).alias("cut"))


@register("highlight_regex", f"SELECT doc_id, md5(replace(regexp_replace({O.light('text')}, '([0-9]+)', '<mark>\\1</mark>', 'g'), chr(10), '<br>')) AS digest FROM documents")
def highlight_regex(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", N.light(F.col("text")).alias("text"))
    return docs.select("doc_id", F.md5(highlight_spans(F.col("text"), extract(F.col("text"), docs.schema["text"].dataType, "r:[0-9]+"))).alias("digest"))


_MARKED_TERMS = ("the", "of the", "tion")


def _highlight_sql(terms) -> str:
    """Terms found in aligned text whose separators stand twice, so that neighbours can share them."""
    br = "<\\s*/?\\s*[bB][rR]\\s*/?\\s*>"
    parts = []
    for k, term in enumerate(terms):
        pattern = f"([0-9 \\n])(~*{term.replace(' ', '(?:[ ~]|' + chr(1) + '[ ~])*')}~*)([0-9 \\n])"
        parts.append(f"SELECT doc_id, {k} AS term, regexp_replace(twice, '{pattern}', '\\1' || chr(2) || '\\2' || chr(3) || '\\3', 'g') AS m FROM w")
    undone = f"regexp_replace(m, '([0-9 \\n])' || chr(1) || '[0-9 \\n]', '\\1', 'g')"
    return f"""
WITH s AS (SELECT doc_id, text, ' ' || replace(regexp_replace(text, '{br}', chr(10), 'g'), chr(13), chr(10)) || ' ' AS x FROM documents),
y AS (SELECT doc_id, {O.aligned('x')} AS y FROM s),
w AS (SELECT doc_id, regexp_replace(y, '([0-9 \\n])', '\\1' || chr(1) || '\\1', 'g') AS twice FROM y),
t AS ({" UNION ALL ".join(parts)}),
p AS (SELECT doc_id, term, string_split_regex({undone}, '[' || chr(2) || chr(3) || ']') AS pieces FROM t),
u AS (SELECT doc_id, term, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS k FROM p),
o AS (SELECT doc_id, term, k, sum(length(piece)) OVER (PARTITION BY doc_id, term ORDER BY k) AS upto, length(piece) AS size FROM u),
a AS (SELECT doc_id, upto - size AS b, upto AS e FROM o WHERE k % 2 = 0),
g AS (SELECT *, b > coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS opens FROM a),
h AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS n FROM g),
i AS (SELECT doc_id, n, min(b) AS b, max(e) AS e FROM h GROUP BY doc_id, n),
j AS (SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS before FROM i),
r AS (SELECT doc_id, max(e) AS last, string_agg(substr(x, CAST(before AS BIGINT) + 1, CAST(b - before AS BIGINT)) || '<mark>' || substr(x, CAST(b AS BIGINT) + 1, CAST(e - b AS BIGINT)) || '</mark>', '' ORDER BY b) AS head FROM j JOIN s USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CASE WHEN text = '' OR text IS NULL THEN text ELSE trim(coalesce(head, '') || substr(x, CAST(coalesce(last, 0) AS BIGINT) + 1)) END AS marked FROM s LEFT JOIN r USING (doc_id)"""


@register("highlight_terms", _highlight_sql(_MARKED_TERMS))
def highlight_terms_query(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", highlight_terms(F.col("text"), _MARKED_TERMS).alias("marked"))


@register("highlight_criterion", _highlight_sql(("the", "la", "der", "of the")).replace(" AS marked FROM s", " AS highlighted FROM s"))
def highlight_criterion(spark, sf_dir):
    """All terms of a criterion and their synonyms, negated ones too, a phrase as one."""
    return highlight(documents(spark, sf_dir).select("doc_id", "text"), 'the NAO "of the"', synonyms=SYNONYMS).select("doc_id", "highlighted")


@register("aligned_norm", f"SELECT doc_id, md5({O.aligned('text')}) AS digest FROM documents")
def aligned_norm(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(N.aligned(F.col("text"))).alias("digest"))


@register("sql_normaliser", f"SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all({O.full('text')}, '[0-9]+|[a-z]+|\\n'), lambda x: {O.singular('x')}), ' ')) AS digest FROM documents")
def sql_normaliser(spark, sf_dir):
    """The normaliser called from SQL."""
    register_normaliser(spark, "crivo_normalised")
    return spark.sql("SELECT doc_id, md5(crivo_normalised(text, false)) AS digest FROM {docs}", docs=documents(spark, sf_dir))


#: The texts hold few quotes, so some are set before and inside words; Spark and SQL read this alike.
_QUOTE = "chr(39)"
_QUOTED = f"replace(replace(replace(text, ' t', ' ' || {_QUOTE} || 't'), 'ti', 't' || {_QUOTE} || 'i'), ' of ', ' “of” ')"
_INNER = r"regexp_replace({}, '([\p{{L}}\p{{N}}_])' || chr(39) || '([\p{{L}}\p{{N}}_])', '\1' || chr(1) || '\2', 'g')"
_UNIFIED = f"replace(translate({_INNER.format(_INNER.format('q'))}, '“”' || {_QUOTE}, '\"\"\"'), chr(1), {_QUOTE})"
_UNQUOTED = "CASE WHEN n > 0 AND n % 2 = 0 THEN regexp_replace(trim(u), '\"[^\"]*\"', ' ', 'g') ELSE u END"


@register("unify_quotes", f"SELECT doc_id, md5({_UNIFIED}) AS digest FROM (SELECT doc_id, {_QUOTED} AS q FROM documents)")
def unify_quotes(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(N.unify_quotes(F.expr(_QUOTED))).alias("digest"))


@register("directives_in_order", f"""WITH u AS (SELECT doc_id, {_UNIFIED} AS u FROM (SELECT doc_id, {_QUOTED} AS q FROM documents)),
x AS (SELECT doc_id, {O.light(_UNQUOTED)} AS x FROM (SELECT doc_id, u, length(u) - length(replace(u, '"', '')) AS n FROM u)),
c AS (SELECT doc_id, array_to_string(list_filter([array_to_string(regexp_extract_all(x, '(?s)and.*?ing'), chr(10)), array_to_string(regexp_extract_all(x, '(?s)was.*?the'), chr(10))], lambda p: p <> ''), chr(10)) AS c FROM x)
SELECT doc_id, md5(trim(regexp_replace(trim(regexp_replace(c, 'th[a-z0-9]?', ' ', 'g')), 'er', ' ', 'g'))) AS digest FROM c""")
def directives_in_order(spark, sf_dir):
    """Quotes first, then both stretches of the text, then the removals one after another."""
    d = split_directives("of remover(th?) remover(er) recortar(and;ing) remover(aspas) recortar(was;the)")
    return documents(spark, sf_dir).select("doc_id", F.md5(N.light(rewritten_text(F.expr(_QUOTED), d))).alias("digest"))


def _many_sql() -> str:
    parts = [f"SELECT doc_id, start, \"end\", hit, '{meta}' AS meta FROM ({_spans_sql(pattern)})" for pattern, meta in (("[0-9]+", '{"kind":"number"}'), ("[a-z]*tion", '{"kind":"ending"}'))]
    return f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start, \"end\", hit, meta) - 1 AS BIGINT) AS ord, start, \"end\", meta FROM ({' UNION ALL '.join(parts)})"


@register("extract_many", _many_sql())
def extract_many_query(spark, sf_dir):
    """Spans of two patterns in one order, with what each pattern's entry says besides."""
    criteria = [{"regex": "[0-9]+", "kind": "number", "note": "x"}, {"regex": "[a-z]*tion", "kind": "ending"}]
    found = documents(spark, sf_dir).select("doc_id", F.posexplode(extract_many(F.col("text"), criteria, drop=("note",))).alias("ord", "s"))
    return found.select("doc_id", F.col("ord").cast("long").alias("ord"), F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"), F.col("s.meta").alias("meta"))


# --- rules -------------------------------------------------------------------------------------------

RULES = [
    Rule("language", "english", "the ADJ20 of", 1, tags="lang en"),
    Rule("language", "french", "la ADJ20 de", 2, tags="lang fr"),
    Rule("language", "german", "der PROX20 die", 3, tags="lang de"),
    Rule("shape", "numbers", "r:[0-9]{3}", 1, tags="shape", attrs={"level": "1"}),
    Rule("shape", "english", "thing", 2, tags="shape", attrs={"level": "2"}),
    Rule("shape", "long tail", "e:tion[a-z]*tion", 3, tags="shape", attrs={"level": "2"}),
    Rule("start", "starts with the", "l:the%", 1, head=200, attrs={"tags_area": "head"}),
    Rule("broken", "never", "the E E of", 1),
]


def _rule_sql(rules: list[Rule], first_of_group: bool, more=None) -> str:
    """Rules tested one by one, the fold written as a chain of conditions."""
    tests = {
        "the ADJ20 of": "EXISTS (SELECT 1 FROM m1 WHERE m1.doc_id = d.doc_id)",
        "la ADJ20 de": "EXISTS (SELECT 1 FROM m2 WHERE m2.doc_id = d.doc_id)",
        "der PROX20 die": "EXISTS (SELECT 1 FROM m3 WHERE m3.doc_id = d.doc_id)",
        "thing": "EXISTS (SELECT 1 FROM m4 WHERE m4.doc_id = d.doc_id)",
        "r:[0-9]{3}": f"regexp_matches({O.light('d.text')}, '[0-9]{{3}}')",
        "e:tion[a-z]*tion": f"regexp_matches({O.light('d.text')}, 'tion[a-z]*tion')",
        "l:the%": f"regexp_matches(left({O.light('d.text')}, 200), '^the.*$')",
    }
    good = sorted((r for r in rules if r.rule in tests), key=lambda r: (r.group, r.order))
    members = ", ".join(f"m{k} AS (SELECT DISTINCT doc_id FROM ({O.select(parse(c))}))" for k, c in ((1, "the ADJ20 of"), (2, "la ADJ20 de"), (3, "der PROX20 die"), (4, "thing")))
    fired: list[str] = []
    for k, r in enumerate(good):
        blocked = [f"f{j}" for j, b in enumerate(good[:k]) if b.label == r.label or (first_of_group and b.group == r.group)]
        fired.append(f"({tests[r.rule]})" + "".join(f" AND NOT {b}" for b in blocked) + f" AS f{k}")
    steps, last = [], "documents d"
    for k, f in enumerate(fired):
        steps.append(f"s{k} AS (SELECT d.*, {f} FROM {last})")
        last = f"s{k} d"
    rows = " UNION ALL ".join(f"SELECT doc_id, {O.literal(r.label)} AS label{', ' + more(r) if more else ''} FROM {last} WHERE f{k}" for k, r in enumerate(good))
    return f"WITH {O.tokens()}, {members}, {', '.join(steps)} {rows}"


def rule_query(rules: list[Rule], first_of_group: bool) -> Query:
    def run(spark, sf_dir):
        labelled = apply_rules(documents(spark, sf_dir).select("doc_id", "text"), compile_rules(rules), first_of_group=first_of_group)
        return label_rows(labelled).select("doc_id", "label")

    return run


register("rules_all", _rule_sql(RULES, False))(rule_query(RULES, False))
register("rules_first_of_group", _rule_sql(RULES, True))(rule_query(RULES, True))
for _name, _kept in {"rules_tag_filter": filter_rules(RULES, "lang"), "rules_attr_filter": filter_rules(RULES, "", {"level": "2"}), "rules_tag_key_filter": filter_rules(RULES, "", {"tags_area": "head"})}.items():
    register(_name, _rule_sql(_kept, True))(rule_query(_kept, True))


#: A rule made of the first two words of each text of the benchmark (an x before them makes no operator of
#: any): three forms are wrong, one is right.
_RULE_FORMS = """SELECT item_id, CASE item_id % 4 WHEN 0 THEN a || ' E E ' || b WHEN 1 THEN '(' || a || ' ADJ2 ' || b WHEN 2 THEN '"' || a || ' ' || b ELSE a || ' ADJ2 ' || b END AS rule
FROM (SELECT item_id, 'x' || regexp_extract(text, '([A-Za-z]+)[^A-Za-z]+([A-Za-z]+)', 1) AS a, 'x' || regexp_extract(text, '([A-Za-z]+)[^A-Za-z]+([A-Za-z]+)', 2) AS b FROM benchmark)"""


@register("rules_invalid", f"SELECT CAST(item_id AS VARCHAR) AS label, CASE item_id % 4 WHEN 0 THEN 'two operators in a row' WHEN 1 THEN 'parenthesis opened and not closed' ELSE 'quotes opened and not closed' END AS error FROM ({_RULE_FORMS}) WHERE item_id % 4 < 3")
def rules_invalid(spark, sf_dir):
    """The rules of a table that can't be compiled, with the reason."""
    made = spark.sql(_RULE_FORMS.replace("FROM benchmark", "FROM {items}"), items=table(spark, sf_dir, "benchmark"))
    rules = load_rules(made.select(F.lit("benchmark").alias("group"), F.col("item_id").cast("string").alias("label"), "rule"))
    return spark.createDataFrame([(r.label, e) for r, e in compile_rules(rules).bad], "label string, error string")


_PAIRS = f"""bw AS (SELECT item_id, list_transform(regexp_extract_all({O.full('text')}, '[0-9]+|[a-z]+'), lambda w: {O.singular('w')}) AS ws FROM benchmark),
pairs AS (SELECT DISTINCT ws[k] AS a, ws[k + d] AS b FROM (SELECT ws, unnest(range(1, len(ws))) AS k FROM bw), (SELECT unnest([1, 2, 3]) AS d) WHERE k + d <= len(ws))"""


@register("rules_indexed", f"WITH {O.tokens()}, {_PAIRS} SELECT DISTINCT x.doc_id, a || ' ' || b AS label FROM pairs JOIN tok x ON x.w = a JOIN tok y ON y.w = b AND y.doc_id = x.doc_id AND y.t - x.t BETWEEN 0 AND 2")
def rules_indexed(spark, sf_dir):
    """A rule for each two words of the benchmark that stand within three words: thousands, filed under their rarer word."""
    items = table(spark, sf_dir, "benchmark").select(F.transform(F.regexp_extract_all(N.full(F.col("text")), F.lit("[0-9]+|[a-z]+"), 0), N.singular).alias("ws"))
    near = lambda d: F.zip_with(F.slice("ws", 1, F.greatest(F.size("ws") - d, F.lit(0))), F.slice("ws", d + 1, F.greatest(F.size("ws") - d, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    made = items.select(F.explode(F.concat(near(1), near(2), near(3))).alias("p")).distinct()
    rules = load_rules(made.orderBy("p").select(F.lit("benchmark").alias("group"), F.concat_ws(" ", "p.a", "p.b").alias("label"), F.concat(F.lit('"'), F.col("p.a"), F.lit('" ADJ2 "'), F.col("p.b"), F.lit('"')).alias("rule")))
    labelled = apply_rule_index(documents(spark, sf_dir).select("doc_id", "text"), compile_rules(rules), first_of_group=False)
    return label_rows(labelled).select("doc_id", "label")


register("rules_index_mixed", _rule_sql(RULES, True))(lambda spark, sf_dir: label_rows(apply_rule_index(documents(spark, sf_dir).select("doc_id", "text"), compile_rules(RULES))).select("doc_id", "label"))


@register("rule_labels", f"SELECT l.label, count(*) AS n, CAST(sum(q.quality) AS BIGINT) AS n_quality FROM ({_rule_sql(RULES, True)}) l JOIN labels q USING (doc_id) GROUP BY l.label")
def rule_labels(spark, sf_dir):
    return QUERIES["rules_first_of_group"](spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("n_quality"))


_PAGED = "SELECT conv_id * 100000 + row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS doc_id, text FROM conversations"


@register("extract_paged", f"SELECT doc_id // 100000 AS conv_id, CAST(doc_id % 100000 AS INTEGER) AS page, start, \"end\" FROM ({_spans_sql('[a-z]+ing', _PAGED)})")
def extract_paged(spark, sf_dir):
    """Spans in every page, with the page's number."""
    paged = turns_as_pages(table(spark, sf_dir, "conversations"))
    found = paged.select("conv_id", F.explode(extract(F.col("pages"), paged.schema["pages"].dataType, "r:[a-z]+ing")).alias("s"))
    return found.select("conv_id", F.col("s.page").alias("page"), F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


@register("pages_by_mark", """SELECT doc_id, CAST(k - 1 AS BIGINT) AS page, md5(piece) AS digest FROM (SELECT doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS k
FROM (SELECT doc_id, CASE WHEN instr(marked, '<<pg>>') > 1 THEN string_split(marked, '<<pg>>') ELSE [marked] END AS pieces FROM (SELECT doc_id, replace(text, chr(10), '<<pg>>') AS marked FROM documents)))""")
def pages_by_mark(spark, sf_dir):
    marked = documents(spark, sf_dir).select("doc_id", F.replace("text", F.lit("\n"), F.lit("<<pg>>")).alias("text"))
    return marked.select("doc_id", F.posexplode(split_pages(F.col("text"))).alias("page", "x")).select("doc_id", F.col("page").cast("long").alias("page"), F.md5("x").alias("digest"))


@register("literal_breaks", "SELECT doc_id, md5(regexp_replace(x, '([^\\\\])\\\\n', '\\1' || chr(10), 'g')) AS digest FROM (SELECT doc_id, replace(text, ' the ', ' the\\n ') AS x FROM documents)")
def literal_breaks(spark, sf_dir):
    """A backslash and an n, written out in the texts, become line feeds."""
    written = F.replace("text", F.lit(" the "), F.lit(" the\\n "))
    return documents(spark, sf_dir).select("doc_id", F.md5(N.literal_breaks(written)).alias("digest"))


@register("digests", "SELECT doc_id, sha1(concat_ws('|', lang, text)) AS digest, array_to_string(list_transform(range(0, 10), lambda k: substr(sha1(text), CAST(4 * k + 1 AS BIGINT), 1)), '') AS mini FROM documents")
def digests(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", S.digest(F.col("lang"), F.col("text")).alias("digest"), S.mini_digest(F.col("text")).alias("mini"))


#: Criteria of two words of each text of the benchmark in six forms, and what is printed for each form.
_WORDS = "(SELECT item_id, lower('x' || regexp_extract(text, '([A-Za-z]+)[^A-Za-z]+([A-Za-z]+)', 1)) AS a, lower('x' || regexp_extract(text, '([A-Za-z]+)[^A-Za-z]+([A-Za-z]+)', 2)) AS b FROM benchmark)"
_FORMS = f"""SELECT item_id, CASE item_id % 6 WHEN 0 THEN a || ' ADJ2 ' || b WHEN 1 THEN '"' || a || '" OU ' || b || '$' WHEN 2 THEN a || ' NAO (' || b || ' E ' || a || ')'
WHEN 3 THEN '(' || a || ' PROX3 ' || b || ').text.' WHEN 4 THEN '"' || a || '"$' ELSE a || ' E ? ' || b END AS rule FROM {_WORDS}"""


@register("criterion_forms", f"""SELECT item_id, CASE item_id % 6 WHEN 0 THEN a || ' ADJ2 ' || b WHEN 1 THEN '"' || a || '" OU ' || r || '$' WHEN 2 THEN a || ' NAO (' || b || ' E ' || a || ')'
WHEN 3 THEN a || '.text. PROX3 ' || b || '.text.' WHEN 4 THEN '"' || q || '$"' ELSE a || ' E ?' || b END AS canonical,
CASE item_id % 6 WHEN 1 THEN '"' || a || '" OR ' || r || '*' WHEN 2 THEN a || ' NOT (' || b || ' AND ' || a || ')' WHEN 4 THEN q || '*' ELSE a || ' AND ' || b END AS and_or_not, item_id % 6 IN (0, 3) AS has_positions
FROM (SELECT item_id, {O.singular('a')} AS a, {O.singular('b')} AS b, a AS q, b AS r FROM {_WORDS})""")
def criterion_forms(spark, sf_dir):
    """The canonical text of criteria, their AND/OR/NOT form, and whether they need positions."""
    made = spark.sql(_FORMS.replace("FROM benchmark", "FROM {items}"), items=table(spark, sf_dir, "benchmark")).collect()
    rows = [(r["item_id"], c.canonical, c.and_or_not, special(c.node)) for r in made for c in [compile_criterion(r["rule"])]]
    return spark.createDataFrame(rows, "item_id long, canonical string, and_or_not string, has_positions boolean")


@register("regex_validity", f"SELECT item_id, item_id % 3 = 0 AS valid FROM {_WORDS}")
def regex_validity(spark, sf_dir):
    """Which patterns of a table compile."""
    made = spark.sql(f"SELECT CAST(item_id AS VARCHAR(20)) AS label, CASE item_id % 3 WHEN 0 THEN 'r:' || a || '[0-9]+' WHEN 1 THEN 'r:(' || a ELSE 'r:' || a || '{{{{2' END AS rule FROM {_WORDS.replace('FROM benchmark', 'FROM {items}')}", items=table(spark, sf_dir, "benchmark"))
    rules = compile_rules(load_rules(made.select(F.lit("benchmark").alias("group"), "label", "rule")))
    return spark.createDataFrame([(int(r.label), True) for r, _ in rules.rules] + [(int(r.label), False) for r, _ in rules.bad], "item_id long, valid boolean")


_PRINTED = {"the ADJ20 of": "the AND of", "la ADJ20 de": "la AND de", "der PROX20 die": "der AND die", "thing": "thing"}


@register("rules_detail", _rule_sql(RULES, False, lambda r: f"{O.literal(r.rule)} AS rule, {O.literal(_PRINTED.get(r.rule, ''))} AS and_or_not"))
def rules_detail(spark, sf_dir):
    """The rules that fired, with what they ask for and their weaker form."""
    found = apply_rules(documents(spark, sf_dir).select("doc_id", "text"), compile_rules(RULES), first_of_group=False, detail=True)
    return found.select("doc_id", F.inline("fired")).select("doc_id", "label", "rule", "and_or_not")


@register("json_fields", O.matching("(de ADJ3 la).text. E fr.lang.", fields=True))
def json_fields(spark, sf_dir):
    """Documents whose fields lie in a JSON text."""
    written = documents(spark, sf_dir).select("doc_id", F.to_json(F.struct("lang", "source", "text")).alias("text"))
    return matching(S.DocSource("documents", json=True).read(written), "(de ADJ3 la).text. E fr.lang.").select("doc_id")


# --- search sessions ---------------------------------------------------------------------------------


def _score_sql(criterion: str, names: str) -> str:
    return f"SELECT m.doc_id, count(*) FILTER (WHERE t.w IN ({names})) AS score FROM (SELECT DISTINCT doc_id FROM ({O.select(parse(criterion))})) m JOIN tok t USING (doc_id) GROUP BY m.doc_id"


def tokenised(spark, sf_dir):
    return with_tokens(documents(spark, sf_dir).select("doc_id", "text"))


@register("topk_score", f"WITH {O.tokens()} SELECT doc_id, score FROM ({_score_sql('the ADJ2 of', chr(39) + 'the' + chr(39) + ', ' + chr(39) + 'of' + chr(39))}) ORDER BY score DESC, doc_id LIMIT 20")
def topk_score(spark, sf_dir):
    return S.search(tokenised(spark, sf_dir), "the ADJ2 of", limit=20)


@register("topk_postings", ORACLE_SQL["topk_score"])
def topk_postings(spark, sf_dir):
    docs = tokenised(spark, sf_dir)
    return S.search_postings(postings(docs), docs, "the ADJ2 of", limit=20)


@register("search_cached", f"WITH {O.tokens(_CHANGED)} SELECT doc_id, score FROM ({_score_sql('la ADJ1 de', chr(39) + 'la' + chr(39) + ', ' + chr(39) + 'de' + chr(39))}) ORDER BY score DESC, doc_id LIMIT 50")
def search_cached(spark, sf_dir):
    """English documents change after a first search; the second one tests them alone."""
    at = lambda day: F.lit(f"2024-01-{day} 00:00:00").cast("timestamp")
    docs, changed = changed_documents(spark, sf_dir)
    search = CachedSearch(shared_folder(spark, "comparisons"), date_col="updated")
    search.search(docs, "la ADJ1 de", at("01"))
    return search.search(changed, "la ADJ1 de", at("03"), 50)


def session_of(spark, sf_dir, name, criterion):
    return S.start_session(name, S.pre_search(tokenised(spark, sf_dir), compile_criterion(criterion)))


_HAS = "SELECT doc_id, 'x' AS one FROM tok GROUP BY doc_id HAVING bool_or(w = '{0}') AND bool_or(w = '{1}')"


@register("session_new", f"WITH {O.tokens()} SELECT 's1' AS session, doc_id AS id, CAST(count(*) FILTER (WHERE w IN ('the', 'of')) AS DOUBLE) AS score, 'P' AS status FROM tok GROUP BY doc_id HAVING bool_or(w = 'the') AND bool_or(w = 'of')")
def session_new(spark, sf_dir):
    return session_of(spark, sf_dir, "s1", "the ADJ2 of")


@register("session_union", f"WITH {O.tokens()}, a AS ({_HAS.format('the', 'of')}), b AS ({_HAS.format('la', 'de')}) SELECT doc_id AS id FROM a UNION SELECT doc_id FROM b")
def session_union(spark, sf_dir):
    return S.unite(session_of(spark, sf_dir, "s1", "the ADJ2 of"), session_of(spark, sf_dir, "s1", "la ADJ2 de")).select("id")


@register("session_filter", f"WITH {O.tokens()}, a AS ({_HAS.format('the', 'of')}), b AS ({_HAS.format('that', 'was')}) SELECT a.doc_id AS id, CASE WHEN b.doc_id IS NULL THEN 'X' ELSE 'P' END AS status FROM a LEFT JOIN b USING (doc_id)")
def session_filter(spark, sf_dir):
    return S.narrow(session_of(spark, sf_dir, "s1", "the ADJ2 of"), session_of(spark, sf_dir, "s1", "that ADJ2 was")).select("id", "status")


def _refined(spark, sf_dir):
    hits = matching(documents(spark, sf_dir), "the ADJ2 of").select(F.col("doc_id").alias("id"))
    return S.refine(session_of(spark, sf_dir, "s1", "the ADJ2 of"), hits)


@register("status_rollup", f"WITH {O.tokens()}, a AS ({_HAS.format('the', 'of')}), m AS (SELECT DISTINCT doc_id FROM ({O.select(parse('the ADJ2 of'))})) SELECT 's1' AS session, count(*) AS n_docs, count(m.doc_id) AS n_accepted, count(*) - count(m.doc_id) AS n_removed FROM a LEFT JOIN m USING (doc_id)")
def status_rollup(spark, sf_dir):
    return S.rollup(_refined(spark, sf_dir)).select("session", "n_docs", "n_accepted", "n_removed")


@register("session_accepted", f"WITH {O.tokens()}, a AS ({_HAS.format('the', 'of')}) SELECT DISTINCT doc_id AS id FROM ({O.select(parse('the ADJ2 of'))}) JOIN a USING (doc_id)")
def session_accepted(spark, sf_dir):
    return S.accepted(_refined(spark, sf_dir)).select("id")


@register("session_status", """WITH s AS (SELECT CAST(doc_id % 40 AS VARCHAR) AS session, ['F', 'X', 'F', 'X', 'P', 'M', 'N'][1 + CASE WHEN doc_id % 40 < 8 THEN doc_id % 4 WHEN doc_id % 40 < 20 THEN doc_id // 40 % 5 ELSE doc_id // 40 % 7 END] AS status FROM documents)
SELECT session, count(*) AS n_docs, count(*) FILTER (WHERE status = 'F') AS n_accepted, count(*) FILTER (WHERE status = 'X') AS n_removed,
  ['N', 'M', 'P'][least(min(CASE status WHEN 'N' THEN 1 WHEN 'M' THEN 2 WHEN 'P' THEN 3 ELSE 9 END), 3)] AS least, min(CASE status WHEN 'N' THEN 1 WHEN 'M' THEN 2 WHEN 'P' THEN 3 ELSE 9 END) = 9 AS settled FROM s GROUP BY session""")
def session_status(spark, sf_dir):
    """The least advanced status of each session's documents, and whether all are settled."""
    turn = F.when(F.col("doc_id") % 40 < 8, F.col("doc_id") % 4).when(F.col("doc_id") % 40 < 20, F.floor(F.col("doc_id") / 40) % 5).otherwise(F.floor(F.col("doc_id") / 40) % 7)
    status = F.get(F.array(*map(F.lit, "FXFXPMN")), turn.cast("int"))
    rows = documents(spark, sf_dir).select((F.col("doc_id") % 40).cast("string").alias("session"), status.alias("status"))
    out = S.rollup(rows)
    settled = F.col("status").isin("F", "X")
    return out.select("session", "n_docs", "n_accepted", "n_removed", F.when(settled, F.lit("P")).otherwise(F.col("status")).alias("least"), settled.alias("settled"))


@register("cache_freshness", """WITH latest AS (SELECT user_id AS id, max(ts) AS updated FROM events GROUP BY user_id), cached AS (SELECT event_id, user_id AS id, ts AS created FROM events WHERE event_type = (SELECT min(event_type) FROM events))
SELECT c.event_id, c.id FROM cached c JOIN latest l USING (id) WHERE l.updated <= c.created""")
def cache_freshness(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    latest = events.groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("updated"))
    first = events.agg(F.min("event_type").alias("first"))
    cached = events.join(F.broadcast(first), events["event_type"] == first["first"], "left_semi").select("event_id", F.col("user_id").alias("id"), F.col("ts").alias("created"))
    return S.fresh(cached, latest).select("event_id", "id")


@register("ttl_purge", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 12 HOUR")
def ttl_purge(spark, sf_dir):
    return S.purge(table(spark, sf_dir, "events"), F.lit("2024-01-15 00:00:00").cast("timestamp"), time_col="ts").select("event_id")


@register("last_log_rows", "SELECT event_id, event_type FROM (SELECT DISTINCT ts, event_id, event_type FROM events) ORDER BY ts DESC, event_id LIMIT 100")
def last_log_rows(spark, sf_dir):
    return S.last_rows(table(spark, sf_dir, "events").select("ts", "event_id", "event_type"), 100).select("event_id", "event_type")


# --- word tables, pages, conversations ---------------------------------------------------------------


@register("dup_words", f"WITH {O.tokens()} SELECT w, count(DISTINCT w0) AS n_forms FROM vocab GROUP BY w HAVING count(DISTINCT w0) > 1")
def dup_words(spark, sf_dir):
    return singular_vocab(spark, sf_dir).groupBy(F.col("singular").alias("w")).agg(F.count(F.lit(1)).alias("n_forms")).where("n_forms > 1")


@register("group_concat_words", f"WITH {O.tokens()} SELECT w, string_agg(w0, ', ' ORDER BY w0) AS forms FROM vocab GROUP BY w HAVING count(*) > 1")
def group_concat_words(spark, sf_dir):
    return singular_vocab(spark, sf_dir).groupBy(F.col("singular").alias("w")).agg(F.sort_array(F.collect_list("word")).alias("words")).where(F.size("words") > 1).select("w", F.array_join("words", ", ").alias("forms"))


@register("exists_words", f"WITH {O.tokens()}, b AS (SELECT DISTINCT unnest(regexp_extract_all({O.full('text')}, '[a-z]+')) AS w0 FROM benchmark) SELECT w0 AS word FROM vocab WHERE w0 IN (SELECT w0 FROM b)")
def exists_words(spark, sf_dir):
    held = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(N.full(F.col("text")), F.lit("[a-z]+"), 0)).alias("word"))
    return singular_vocab(spark, sf_dir).select("word").join(held, "word", "left_semi")


@register("html_break_paragraphs", "SELECT page_id, length(x) - length(replace(x, chr(10), '')) AS n_breaks, md5(x) AS digest FROM (SELECT page_id, replace(regexp_replace(html, '<\\s*/?\\s*[bB][rR]\\s*/?\\s*>', chr(10), 'g'), chr(13), chr(10)) AS x FROM pages)")
def html_break_paragraphs(spark, sf_dir):
    x = N.breaks_from_html(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", (F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))).cast("long").alias("n_breaks"), F.md5(x).alias("digest"))


@register("turns_as_pages", "SELECT conv_id, count(*) AS n_pages, md5(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def turns_as_pages_query(spark, sf_dir):
    paged = turns_as_pages(table(spark, sf_dir, "conversations"))
    return paged.select("conv_id", F.size("pages").cast("long").alias("n_pages"), F.md5(page_text(F.col("pages"))).alias("digest"))


@register("paged_match", f"WITH {O.tokens('SELECT conv_id AS doc_id, $$$$ AS c, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id')} SELECT DISTINCT doc_id AS conv_id FROM ({O.select(parse('the COM2 of'))})")
def paged_match(spark, sf_dir):
    paged = turns_as_pages(table(spark, sf_dir, "conversations"))
    return matching(paged, "the COM2 of", "pages").select("conv_id")


@register("highlight_paged", f"SELECT conv_id, md5(string_agg(replace(regexp_replace({O.light('text')}, '([0-9]+)', '<mark>\\1</mark>', 'g'), chr(10), '<br>'), chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def highlight_paged(spark, sf_dir):
    paged = turns_as_pages(table(spark, sf_dir, "conversations").withColumn("text", N.light(F.col("text"))))
    return highlight_extractions(paged, "r:[0-9]+", "pages").select("conv_id", F.md5(page_text(F.col("highlighted"))).alias("digest"))


@register("trace", f"WITH {O.tokens()} SELECT d.doc_id, count(*) FILTER (WHERE t.w = 'the') AS n_left, count(*) FILTER (WHERE t.w = 'of') AS n_right, (SELECT count(*) FROM ({O.select(parse('the ADJ2 of'))}) m WHERE m.doc_id = d.doc_id) AS n_all FROM documents d LEFT JOIN tok t USING (doc_id) GROUP BY d.doc_id")
def trace_query(spark, sf_dir):
    found = trace(documents(spark, sf_dir).select("doc_id", "text"), "the ADJ2 of")
    return found.select("doc_id", *[F.get("trace", F.lit(k))["n_positions"].cast("long").alias(n) for k, n in enumerate(("n_left", "n_right", "n_all"))])


@register("cache_touch", """WITH used AS (SELECT DISTINCT user_id AS id FROM events WHERE event_type = (SELECT max(event_type) FROM events)), cached AS (SELECT event_id, user_id AS id, ts AS used FROM events WHERE event_type = (SELECT min(event_type) FROM events))
SELECT c.event_id, c.id, CASE WHEN u.id IS NOT NULL AND c.used < TIMESTAMP '2024-01-14 00:00:00' THEN TIMESTAMP '2024-01-15 00:00:00' ELSE c.used END AS used FROM cached c LEFT JOIN used u USING (id)""")
def cache_touch(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    first, last = events.agg(F.min("event_type"), F.max("event_type")).first()
    cached = events.where(F.col("event_type") == first).select("event_id", F.col("user_id").alias("id"), F.col("ts").alias("used"))
    session = events.where(F.col("event_type") == last).select(F.lit("s1").alias("session"), F.col("user_id").alias("id"))
    return S.touch_session(cached, session, F.lit("2024-01-15 00:00:00").cast("timestamp"))


_EDGES = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@register("rejoin_lines", f"""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS k FROM s),
e AS (SELECT *, regexp_matches(line, '[.?!]\\s*$') AND NOT regexp_matches(line, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(?:{ABBREVIATIONS})\\.\\s*$') AS ended FROM l),
g AS (SELECT *, coalesce(sum(ended::INT) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM e),
j AS (SELECT doc_id, g, list_reduce(list(line ORDER BY k), lambda a, b: {_EDGES.format("a")} || ' ' || b) AS paragraph FROM g GROUP BY doc_id, g)
SELECT doc_id, string_agg(paragraph, chr(10) ORDER BY g) AS text FROM j GROUP BY doc_id""")
def rejoin_lines_query(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", rejoin_lines(F.col("text")).alias("text"))


@register("source_terms", f"WITH {O.tokens()}, c AS (SELECT d.source, t.w, count(*) AS n FROM tok t JOIN documents d USING (doc_id) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, w) AS k FROM c) SELECT source, w, n, k FROM r WHERE k <= 5")
def source_terms(spark, sf_dir):
    counted = with_tokens(documents(spark, sf_dir)).select("source", F.explode("tok").alias("x")).groupBy("source", F.col("x.w").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("source").orderBy(F.desc("n"), "w")
    return counted.withColumn("k", F.row_number().over(best).cast("long")).where("k <= 5")

"""The numbered queries: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crivo.llm._common import read_table
from crivo.llm.chat import format_chats, read_back
from crivo.llm.compression_quality import quality_scores
from crivo.llm.embedding_dedup import embedding_dedup
from crivo.llm.filter_audit import filter_audit
from crivo.llm.hard_negatives import hard_negatives
from crivo.llm.lattice_lm import lattice_scores
from crivo.llm.line_dedup import BLOCKS, ENTITIES, MIN_HELD, RATIO, page_line_dedup
from crivo.llm.mixing import mix_sources
from crivo.llm.ngram_join import ngram_jaccard_join
from crivo.llm.packing import pack_documents
from crivo.llm.paragraph_dedup import paragraph_dedup
from crivo.llm.quality import quality_rules
from crivo.llm.token_counts import token_counts


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"), max_repeats=1.25)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op3_site_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_line_dedup(read_table(spark, sf_dir, "pages"))


def op4_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Lines of fewer than 20 words (headings, notices, menus) are compared by equality, reported and kept.
    return paragraph_dedup(read_table(spark, sf_dir, "documents"), min_words=20)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(read_table(spark, sf_dir, "embeddings"))


def op7_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_scores(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(read_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_chats(turns.unionByName(own), tokenizer_path("piece_bpe_32k.model")), dealt=True)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = read_table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_temperature_mixing, op2_token_counts, op3_site_line_dedup, op4_paragraph_dedup, op5_best_fit_packing, op6_embedding_dedup, op7_lattice_lm, op8_ngram_jaccard_join, op9_quality_rules, op10_chat_formatting, op11_hard_negatives, op12_filter_audit, op13_compression_quality)}

#: Text of a page, one line a block element.
_PAGE_TEXT = f"""regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\\b.*?</(script|style)\\s*>|<!--.*?-->', '', 'g'),
    '(?i)</?({BLOCKS})\\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g')"""
for _name, _character in ENTITIES:
    _PAGE_TEXT = "replace({}, '{}', '{}')".format(_PAGE_TEXT, _name, _character.replace("'", "''"))

ORACLE_SQL: dict[str, str] = {
    "op3_site_line_dedup": f"""
WITH t AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host, {_PAGE_TEXT} AS text FROM pages
), split AS (SELECT page_id, host, string_split(text, chr(10)) AS lines FROM t),
l AS (SELECT page_id, host, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split),
k AS (SELECT *, regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS trimmed FROM l),
h AS (SELECT host, count(*) AS pages FROM t GROUP BY host),
c AS (SELECT host, trimmed, count(DISTINCT page_id) AS held FROM k WHERE trimmed <> '' GROUP BY host, trimmed),
b AS (SELECT c.host, c.trimmed, true AS gone FROM c JOIN h ON c.host IS NOT DISTINCT FROM h.host WHERE c.held >= {MIN_HELD} AND c.held > CAST({RATIO} AS DOUBLE) * h.pages)
SELECT k.page_id, k.host, coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE b.gone IS NULL), '') AS text,
       count(*) FILTER (WHERE k.trimmed <> '') AS n_lines, count(*) FILTER (WHERE b.gone) AS n_dropped
FROM k LEFT JOIN b ON k.host IS NOT DISTINCT FROM b.host AND k.trimmed = b.trimmed
GROUP BY k.page_id, k.host""",
    "op11_hard_negatives": """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
s AS (
  SELECT a.id AS a, a.label AS of, b.id, b.label, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id
),
p AS (SELECT a, of, id, score FROM s WHERE label = of QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id) <= 5)
SELECT p.a AS anchor_id, p.id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND s.label <> p.of AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.a, p.id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 10""",
    "op12_filter_audit": r"""
WITH x AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
firsts AS (SELECT t, min(doc_id) AS least FROM x GROUP BY t),
known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails
  FROM x JOIN firsts USING (t) LEFT JOIN known USING (doc_id)
),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS v),
o AS (SELECT a.v || b.v || c.v || d.v || e.v AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.v, b.v, c.v, d.v, e.v])) = 5),
s AS (SELECT filter_order, k AS step, filter_order[k] AS own, filter_order[:k - 1] AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
c AS (
  SELECT part, filter_order, step, own, contains(fails, own) AS failing, step > 1 AND length(translate(fails, before, '')) < length(fails) AS earlier, fails, n, good, toxic FROM g, s
),
r AS (
  SELECT part, filter_order, step, own,
    CAST(coalesce(sum(n) FILTER (WHERE NOT failing AND NOT earlier), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (WHERE failing AND NOT earlier), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (WHERE failing AND earlier), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (WHERE fails = own), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (WHERE failing AND NOT earlier), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(toxic) FILTER (WHERE failing AND NOT earlier), 0) AS BIGINT) AS toxic_lost
  FROM c GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r""",
}

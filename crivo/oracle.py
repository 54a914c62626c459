"""DuckDB SQL that computes what the queries compute, from the same tables by other means."""

from __future__ import annotations

from crivo.functions.normalize import PLURAL_ENDINGS, PLURAL_EXCEPTIONS
from crivo.plans.arrays import spellings, wild_pattern
from crivo.plans.parser import parse
from crivo.plans.syntax import Absent, Binary, Compare, Node, Scope, Term

DOUBLED = "|".join(c * 2 for c in "abcdefghijklmnopqtuvwxyz0123456789")
QUOTE_CODES = ", ".join(str(ord(c)) for c in "'\"´`“”")


def fold(text: str) -> str:
    return f"lower(strip_accents({text}))"


def full(text: str) -> str:
    x = f"replace(replace({fold(text)}, '<br>', chr(10)), '§', ' paragrafo ')"
    x = f"translate({x}, '{{[}}]', '(())')"
    for code in (39, 180, 96, 8220, 8221):
        x = f"replace({x}, chr({code}), chr(34))"
    return f"regexp_replace(regexp_replace({x}, '([0-9])[.,]+([0-9])', '\\1\\2', 'g'), '([0-9])[.,]+ ', '\\1 ', 'g')"


def light(text: str) -> str:
    return f"replace(replace({fold(text)}, '<br>', chr(10)), chr(13), chr(10))"


def singular(w: str, twice: str | None = None) -> str:
    """``twice``: whether a character other than s and r stands doubled; by default looked for among letters and digits."""
    exceptions = ", ".join(f"'{x}'" for x in PLURAL_EXCEPTIONS)
    cases = "".join(f" WHEN regexp_matches({w}, '{e}') THEN regexp_replace({w}, '{e}', '{i}')" for e, i in PLURAL_ENDINGS)
    return f"CASE WHEN NOT suffix({w}, 's') OR {w} IN ({exceptions}) OR {twice or f"regexp_matches({w}, '{DOUBLED}')"} OR regexp_matches({w}, '[yw]') OR NOT regexp_matches({w}, '[aeiou]') THEN {w} WHEN {w} IN ('leis', 'pais') THEN {w}[:-2]{cases} ELSE {w} END"


def aligned(text: str) -> str:
    """Normalised text whose characters stand where the original's stand."""
    digits = lambda x: f"regexp_replace({x}, '([0-9])[.,]([0-9])', '\\1_\\2', 'g')"
    broken = f"replace(regexp_replace({fold(text)}, '<\\s*/?\\s*[bB][rR]\\s*/?\\s*>', chr(10), 'g'), chr(13), chr(10))"
    folded = f"replace({digits(digits(broken))}, '-', ' ')"
    twice = "len(list_filter(range(1, length(v[2])), lambda i: v[2][i] = v[2][i + 1] AND v[2][i] NOT IN ('s', 'r'))) > 0"
    padded = f"regexp_replace(rpad({singular('v[2]', twice)}, CAST(length(v[1]) AS INTEGER), '~'), '[^a-z0-9~_\\n§-]', ' ', 'g')"
    return f"array_to_string(list_transform(list_transform(string_split({folded}, ' '), lambda w: [w, replace(w, '~', '')]), lambda v: {padded}), ' ')"


def tokens(source: str = "SELECT doc_id, '' AS c, text FROM documents") -> str:
    """CTEs raw and tok(doc_id, c, w, t, p)."""
    return f"""
src AS ({source}),
norm AS (SELECT doc_id, c, string_split({full("text")}, chr(10)) AS lines FROM src),
line AS (SELECT doc_id, c, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS p FROM norm),
found AS (SELECT doc_id, c, p, regexp_extract_all(line, '[0-9]+|[a-z]+') AS ws FROM line),
raw AS (SELECT doc_id, c, p, unnest(ws) AS w0, generate_subscripts(ws, 1) AS i FROM found),
vocab AS (SELECT w0, {singular("w0")} AS w FROM (SELECT DISTINCT w0 FROM raw)),
tok AS (SELECT doc_id, c, w, p, row_number() OVER (PARTITION BY doc_id, c ORDER BY p, i) - 1 AS t FROM raw JOIN vocab USING (w0))"""


FIELDS = "SELECT doc_id, 'LANG' AS c, lang AS text FROM documents UNION ALL SELECT doc_id, 'SOURCE', source FROM documents UNION ALL SELECT doc_id, 'TEXT', text FROM documents"


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def select(node: Node, synonyms: dict | None = None) -> str:
    """Positions (doc_id, t, p, c) of a tree over tok."""

    def truth(docs: str) -> str:
        return f"SELECT doc_id, 0 AS t, 0 AS p, '' AS c FROM ({docs})"

    def band(n: Binary) -> str:
        same = "a.doc_id = b.doc_id AND a.c = b.c"
        ahead = f"b.t - a.t BETWEEN {-n.number if n.name.startswith('PROX') else 0} AND {n.number}"
        return {"MESMO": same, "COM": f"{same} AND b.p - a.p BETWEEN 0 AND {n.number - 1}"}.get(n.name, f"{same} AND {ahead}" + (" AND a.p = b.p" if n.name.endswith("C") else ""))

    def of(n: Node) -> str:
        match n:
            case Term():
                test = f"regexp_matches(w, {literal(wild_pattern(n.word))})" if n.wild else "w IN (" + ", ".join(map(literal, spellings(n, synonyms or {}))) + ")"
                return f"SELECT doc_id, t, p, c FROM tok WHERE {test}"
            case Scope():
                return f"SELECT * FROM ({of(n.of)}) WHERE c = {literal(n.field)}"
            case Compare():
                value = f"try_cast(w AS HUGEINT) {n.sign} {n.value}" if n.value.isdigit() and n.sign != "=" else f"w {n.sign} {literal(n.value)}"
                return truth(f"SELECT DISTINCT doc_id FROM tok WHERE c = {literal(n.field)} AND {value}")
            case Absent():
                return truth(f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({of(n.of)}))")
            case Binary():
                a, b = of(n.left), of(n.right)
                if n.name == "E":
                    return f"SELECT * FROM ({b}) WHERE doc_id IN (SELECT doc_id FROM ({a}))"
                if n.name == "OU":
                    return f"SELECT * FROM ({a}) UNION ALL SELECT * FROM ({b})"
                if n.name == "NAO":
                    return truth(f"SELECT DISTINCT doc_id FROM ({a}) WHERE doc_id NOT IN (SELECT doc_id FROM ({b}))")
                right = f"SELECT * FROM ({b}) b WHERE EXISTS (SELECT 1 FROM ({a}) a WHERE {band(n)})"
                if not n.name.startswith("PROX"):
                    return right
                return f"{right} UNION ALL SELECT * FROM ({a}) a WHERE EXISTS (SELECT 1 FROM ({b}) b WHERE {band(n)})"
        raise TypeError(n)

    return of(node)


def matching(criterion: str, fields: bool = False, synonyms: dict | None = None, equivalents: dict | None = None) -> str:
    """Ids of the documents that match."""
    node = parse(criterion, equivalents)
    return f"WITH {tokens(FIELDS) if fields else tokens()} SELECT DISTINCT doc_id FROM ({select(node, synonyms)})"

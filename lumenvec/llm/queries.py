"""The operators as queries over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenvec.llm import bpe, collocations, ctw, fingerprints, html, langid, licenses, mixing, quality, resample, secret_scan, setjoin, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(_documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_documents(spark, sf_dir))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.components(_documents(spark, sf_dir))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_documents(spark, sf_dir))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(_documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(_documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(_documents(spark, sf_dir))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_documents(spark, sf_dir))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = [op1_document_fingerprints, op2_language_id, op3_ngram_jaccard_join, op4_secret_scan, op5_bpe, op6_quality_rules, op7_toxicity, op8_mixing, op9_license_scan, op10_lm_scoring, op11_importance_resampling, op12_phrase_collocations, op13_html_extraction]
    return {f.__name__: f for f in every}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY a) m USING (doc_id)
"""

_SOLID = r"length(regexp_replace({0}, '[\x20\x09-\x0D]', '', 'g'))"
_COUNT = "(length({0}) - length(translate({0}, '{1}', '')))"


def _op6() -> str:
    """Lines are rows here: one is lost if a rule fails it or an equal one comes before it."""
    solid, count = _SOLID.format, _COUNT.format
    n, bars = r"len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))", count("x", "|»›•")
    bad = f"(100 * {count('x', '#*$%&<>')} > {quality.LINE_SYMBOLS} * {n} OR 100 * {count('x', '!?')} > {quality.LINE_SHOUTS} * {n} OR (100 * {bars} > {quality.LINE_BARS} * {n} AND {bars} >= 3) OR (length(x) <= {quality.BOILER_CHARS} AND regexp_matches(x, '{quality.BOILERPLATE}')))"
    return rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM w WHERE len(w) >= 3),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS r FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, x, i FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x, unnest(range(len(string_split(t, chr(10))))) AS i FROM w) WHERE {solid("x")} > 0),
told AS (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id, x ORDER BY i) > 1 AS again FROM lines),
lost AS (SELECT doc_id, count(*) FILTER (again) AS n_dup_lines, coalesce(sum({solid("x")}) FILTER (again OR {bad}), 0) AS lost_chars FROM told GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n_words, {solid("t")} AS word_chars, {_COUNT.format("t", "#*$%&|<>")} AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(r, 0) AS n_repeat_words, coalesce(lost_chars, 0) AS lost_chars
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id)),
b AS (SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * lost_chars <= {quality.MOST_LOST} * word_chars AS kept, CAST(lost_chars AS BIGINT) AS lost_chars FROM b
"""


OP8 = rf"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size,
  -ln((CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
  / greatest(0.1::DOUBLE, 1.0::DOUBLE - 8.0::DOUBLE * (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')))::DOUBLE / greatest(length(coalesce(text, '')), 1)::DOUBLE) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight, 2 * source_size::DOUBLE AS cap FROM s),
l AS (SELECT *, cap / weight AS ratio, (1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(cap) OVER o, 0)) / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER o, 0)) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size, CASE WHEN ratio <= level THEN cap ELSE weight * (SELECT arg_min(level, ratio) FROM l WHERE ratio > level) END AS target FROM l),
e AS (SELECT d.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN CAST(floor(g.target / g.source_size) AS BIGINT) ELSE 0 END AS epochs,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, CAST(round(target) AS BIGINT) - epochs * source_size - before)) AS BIGINT) AS taken FROM e
"""


def _op11() -> str:
    """CRC-32 goes by half bytes here, the lower one first."""
    table = "[" + ", ".join(f"{int(resample.CRC[16 * k])}::BIGINT" for k in range(16)) + "]"
    words = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
u AS (SELECT 0 AS side, doc_id AS id, unnest(w) AS a, unnest(range(len(w))) AS i FROM d UNION ALL SELECT 1, item_id, unnest(w), unnest(range(len(w))) FROM (SELECT item_id, {words} AS w FROM benchmark)),
l AS (SELECT side, id, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM u WINDOW o AS (PARTITION BY side, id ORDER BY i)),
e AS MATERIALIZED (SELECT side, id, a AS g FROM l UNION ALL SELECT side, id, a || ' ' || b FROM l WHERE b IS NOT NULL UNION ALL SELECT side, id, a || ' ' || b || ' ' || c FROM l WHERE c IS NOT NULL),
f AS (SELECT id AS doc_id, g FROM e WHERE side = 0),
b AS (SELECT g FROM e WHERE side = 1),
x AS (SELECT g, hex(g) AS h FROM (SELECT g FROM f UNION SELECT g FROM b)),
c AS MATERIALIZED (SELECT g, xor(list_reduce(list_transform(range(length(h)), lambda i: strpos('0123456789ABCDEF', substr(h, i + CASE WHEN i % 2 = 0 THEN 2 ELSE 0 END, 1)) - 1), lambda s, y: xor({table}[(xor(s, y) & 15) + 1], s >> 4), 4294967295::BIGINT), 4294967295::BIGINT) % {resample.BUCKETS} AS k FROM x),
s AS (SELECT k, count(*) AS n FROM f JOIN c USING (g) GROUP BY k), t AS (SELECT k, count(*) AS n FROM b JOIN c USING (g) GROUP BY k),
gain AS (SELECT k, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + {resample.BUCKETS})::DOUBLE / ((s.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + {resample.BUCKETS})::DOUBLE)))::BIGINT AS v FROM s LEFT JOIN t USING (k)),
o AS (SELECT doc_id, count(*) AS n_features, sum(v)::BIGINT AS weight FROM f JOIN c USING (g) JOIN gain USING (k) GROUP BY doc_id),
r AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{resample.SEED}:' || doc_id), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT) AS score FROM d LEFT JOIN o USING (doc_id)),
k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM r WHERE n_words >= {resample.LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {resample.PERCENT} * (SELECT count(*) FROM k) // 100 THEN rank END AS rank FROM r LEFT JOIN k USING (doc_id)
"""


OP12 = rf"""
WITH p AS (SELECT coalesce(lang, '{collocations.UNKNOWN}') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT row_number() OVER () AS piece, lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
u AS (SELECT piece, lang, unnest(w) AS a, unnest(range(len(w))) AS i FROM w),
l AS (SELECT lang, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c, lead(a, 3) OVER o AS d FROM u WINDOW o AS (PARTITION BY piece ORDER BY i)),
f AS MATERIALIZED (SELECT lang, g, count(*) AS f FROM (SELECT lang, [a] AS g FROM l UNION ALL SELECT lang, [a, b] FROM l WHERE b IS NOT NULL UNION ALL SELECT lang, [a, b, c] FROM l WHERE c IS NOT NULL UNION ALL SELECT lang, [a, b, c, d] FROM l WHERE d IS NOT NULL) GROUP BY lang, g HAVING count(*) >= {collocations.LEAST}),
cut AS (SELECT lang, g, f AS a, k, g[1:k] AS head, g[k + 1:len(g)] AS tail FROM (SELECT *, unnest(range(1, len(g))) AS k FROM f)),
best AS (SELECT c.lang, c.g, c.a, x.f AS l, y.f AS r, {collocations.SCALE}::HUGEINT * c.a // (x.f + y.f) AS score FROM cut c JOIN f x ON x.lang = c.lang AND x.g = c.head JOIN f y ON y.lang = c.lang AND y.g = c.tail QUALIFY row_number() OVER (PARTITION BY c.lang, c.g ORDER BY score, k) = 1),
inside AS (SELECT lang, g[i:i + n - 1] AS g, max(f) AS longer FROM (SELECT lang, g, f, n, unnest(range(1, len(g) - n + 2)) AS i FROM (SELECT lang, g, f, unnest(range(2, len(g))) AS n FROM f WHERE len(g) > 2)) GROUP BY ALL),
kept AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM best LEFT JOIN inside USING (lang, g) WHERE longer IS NULL OR 100 * longer < {collocations.COVERED} * a),
top AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept QUALIFY rank <= {collocations.FIRST})
SELECT lang, rank, phrase, a, l, r, (SELECT count(*) FROM u WHERE u.lang = top.lang) AS n, score::BIGINT AS score FROM top
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_jaccard_join": OP3, "op6_quality_rules": _op6(), "op8_mixing": OP8, "op11_importance_resampling": _op11(), "op12_phrase_collocations": OP12}

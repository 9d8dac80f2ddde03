"""One query per operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fuzzy_lines, language_id, lexical_search, media, order_minhash, packing, paragraphs, quality_rules, sentence_pieces, set_join, source_audit, substrings, toxicity
from .common import documents


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.line_frequency(documents(spark, sf_dir))


def op2_longest_previous_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(documents(spark, sf_dir)).drop("kept")


def op3_deficit_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), flatten=0.5)


def op4_rank_order_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language_id.identify(docs, language_id.fit_profiles(docs))


def op5_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.dedup_lines(documents(spark, sf_dir))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(documents(spark, sf_dir))


def op7_shared_prefix_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode(documents(spark, sf_dir), with_decoded=True)


def op8_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op9_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(documents(spark, sf_dir))


def interleaved_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.page_items(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.remove_paragraphs(documents(spark, sf_dir))


def op11_count_level_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(documents(spark, sf_dir))


def op12_block_max_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_set_relation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.jaccard_components(documents(spark, sf_dir))


REGISTERED = (
    op1_line_frequency,
    op2_longest_previous_factors,
    op3_deficit_round_robin,
    op4_rank_order_profiles,
    op5_fuzzy_lines,
    op6_order_minhash,
    op7_shared_prefix_viterbi,
    op8_counterfactual_toxicity,
    op9_interleaved_media,
    op10_paragraph_minhash,
    op11_count_level_bitmaps,
    op12_block_max_maxscore,
    op13_set_relation_join,
    interleaved_pages,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in REGISTERED}


WORD = r"[^\x20\x09-\x0D]+"
LINE_FREQUENCY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, chr(0)) AS host FROM documents),
split AS (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS ws FROM d),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM split),
win AS (SELECT doc_id, i, concat_ws(' ', w, {", ".join(f"lead(w, {k}) OVER o" for k in range(1, 8))}) AS k, lead(w, 7) OVER o IS NOT NULL AS whole
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, i, whole AND count(*) FILTER (whole) OVER (PARTITION BY doc_id, k) > 1 AS rep FROM win),
hit AS (SELECT doc_id, max(rep::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS hit FROM rep),
repeated AS (SELECT doc_id, sum(hit) AS n FROM hit GROUP BY 1),
l AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d),
ln AS (SELECT doc_id, host, line, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm, len(regexp_extract_all(line, '{WORD}')) AS words FROM l WHERE regexp_matches(line, '{WORD}')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n, count(DISTINCT norm) AS lines FROM ln GROUP BY 1),
hosts AS (SELECT host, count(*) AS docs FROM d GROUP BY 1),
often AS (SELECT host, norm FROM ln JOIN hosts USING (host) GROUP BY host, norm, docs HAVING count(DISTINCT doc_id) > 10 AND count(DISTINCT doc_id) > 0.001 * docs),
lost AS (SELECT doc_id, count(DISTINCT norm) AS n, sum(words) AS words FROM ln SEMI JOIN often USING (host, norm) GROUP BY 1),
facts AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_lines_removed, CAST(coalesce(lost.words, 0) AS BIGINT) AS n_words_removed
  FROM d JOIN split USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN repeated r USING (doc_id) LEFT JOIN lost USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  n_lines_removed > 0 AND (n_words - n_words_removed < 0.5 * n_words OR n_words - n_words_removed < 20) AS depleted FROM facts)
SELECT * EXCLUDE (depleted), NOT base_failed AND NOT depleted AS kept FROM judged"""

LONGEST_PREVIOUS_FACTORS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, CAST(len(h) // 2 AS BIGINT) AS n FROM d),
w AS (SELECT doc_id, h, unnest(range(n - 99)) AS s FROM n WHERE n >= 100),
k AS (SELECT doc_id, s, md5_number(substr(h, 2 * s + 1, 200)) AS k FROM w),
gone AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM k) WHERE r > 1),
edge AS (SELECT doc_id, s, CASE WHEN s > lag(s) OVER o + 100 THEN 1 ELSE 0 END AS new FROM gone WINDOW o AS (PARTITION BY doc_id ORDER BY s)),
part AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS part FROM edge),
span AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM part GROUP BY doc_id, part),
gap AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM span),
kept AS (SELECT n.doc_id, n.n, coalesce(sum(b - a), 0) AS removed, count(a) AS spans,
  coalesce(string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a), '') || substr(any_value(h), 2 * coalesce(max(b), 0) + 1) AS rest
  FROM n LEFT JOIN gap USING (doc_id) GROUP BY n.doc_id, n.n)
SELECT doc_id, n AS n_bytes, CAST(removed AS BIGINT) AS n_removed, spans AS n_spans, sha256(unhex(rest)) AS kept_sha256 FROM kept"""


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SOURCE_AUDIT = rf"""
WITH d AS (SELECT row_number() OVER () AS k, {LOWER} AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT k) AS docs FROM t GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 30),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
cell AS (SELECT g.lang, g.source, kept.term, CAST(coalesce(c.n, 0) AS HUGEINT) AS n, kept.n AS all_n FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
p AS (SELECT lang, source, term, n, 1 + 1000000000 * (n + 5) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p, 1 + 1000000000 * (all_n + 5) // (total + 5 * v) AS q FROM cell JOIN v USING (lang)),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, rank FROM ranked WHERE part = 'pair' OR rank <= 50"""


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LEXICAL_SEARCH = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({LOWER}, '{TERM}') AS ts FROM documents),
n AS (SELECT k, doc_id, len(ts) AS n FROM d WHERE len(ts) > 0),
z AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM n),
i AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all({LOWER}, '{TERM}') AS ts FROM benchmark),
q AS (SELECT i, item_id, term, count(*) AS times FROM (SELECT i, item_id, unnest(ts) AS term FROM i) GROUP BY ALL),
tf AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(ts) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, z GROUP BY term, nn),
s AS (SELECT i, item_id, k, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nn) // l)))) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN n USING (k), z GROUP BY ALL),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM s JOIN n USING (k) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 10"""


JACCARD_COMPONENTS = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({LOWER}, '{WORD}') AS ws FROM documents),
s AS (SELECT k, doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS sh FROM d),
e AS (SELECT k, unnest(sh) AS t FROM s),
c AS (SELECT a.k AS a, b.k AS b, count(*) AS n FROM e a JOIN e b ON a.t = b.t AND a.k < b.k GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN s x ON x.k = a JOIN s y ON y.k = b WHERE 100 * n >= 85 * (len(x.sh) + len(y.sh) - n)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT k, k AS m FROM s UNION SELECT reach.k, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.m)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id FROM reach JOIN s USING (k) JOIN s o ON o.k = reach.m GROUP BY s.k, s.doc_id, s.sh"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_frequency": LINE_FREQUENCY,
        "op2_longest_previous_factors": LONGEST_PREVIOUS_FACTORS,
        "op11_count_level_bitmaps": SOURCE_AUDIT,
        "op12_block_max_maxscore": LEXICAL_SEARCH,
        "op13_set_relation_join": JACCARD_COMPONENTS,
    }

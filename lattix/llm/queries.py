"""Registered queries of the corpus operators: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality, toxicity
from .alignment import align
from .common import is_held_out, table
from .decontaminate import find_overlaps
from .exact_dedup import exact_dedup
from .hard_negatives import mine_hard_negatives
from .license_scan import TEMPLATES, scan_licenses
from .line_dedup import repeated_line_chunks
from .mixing import mix_sources
from .near_dedup import near_duplicates
from .substring_dedup import repeated_passages
from .url_filter import filter_urls, rules_frame
from .vector_dedup import near_duplicate_vectors

#: The rules of op3 as (host, path, action).
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"),
        "worst_sentence", "worst_start", "worst_end", "n_toxic_sentences",
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality.train_and_score(docs, labels)
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), rules_frame(spark, URL_RULES))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("shuffle_key")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def substring_dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain form of op7: whole lines, every repeat of one."""
    return repeated_passages(table(spark, sf_dir, "documents"), unit="line", min_words=1, span_words=None)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_line_chunks(table(spark, sf_dir, "documents"))


def op9_hyperminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, threshold_percent=80)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


#: Where the public tokenizers' vocabulary files lie on every executor.
TOKENIZERS = "/opt/tokenizers"


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model", links="ends")


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(table(spark, sf_dir, "embeddings"), label=label)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_toxicity,
        op2_quality,
        op3_url_filter,
        op4_decontaminate,
        op5_mix_sources,
        op6_license_scan,
        op7_substring_dedup,
        substring_dedup_lines,
        op8_line_dedup,
        op9_hyperminhash_dedup,
        op10_exact_dedup,
        op11_token_alignment,
        op12_embedding_dedup,
        op13_hard_negatives,
    )
    return {f.__name__: f for f in own}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP3 = rf"""
WITH u AS (
  SELECT page_id,
         {_LOWER.format("coalesce(regexp_extract(url, '^[\\s\\S]*?://([^/?#]*)', 1), '')")} AS host,
         coalesce(regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r AS (
  SELECT *, CASE
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
      WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
      WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
      WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/'
    END AS rule
  FROM u
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IS NULL OR rule = 'example.com/en/7' THEN 'allow' ELSE 'block' END AS verdict
FROM r
"""

_OP5 = """
WITH sizes AS (
  SELECT source AS s, sum(length(text))::DOUBLE AS chars, pow(sum(length(text))::DOUBLE, 0.5) AS w
  FROM documents GROUP BY source
), rates AS (
  SELECT s, CASE WHEN chars = 0 THEN 1.0 ELSE (w / sum(w) OVER ()) / (chars / sum(chars) OVER ()) END AS rate FROM sizes
), terms AS (
  SELECT s, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p
  FROM rates, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 31)::BIGINT)) AS t(k)
), cdf AS (
  SELECT s, k, sum(p) OVER (PARTITION BY s ORDER BY k) AS c FROM terms
), draws AS (
  SELECT d.*, ('0x' || substr(md5('17:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents d
), counts AS (
  SELECT doc_id, count(*) FILTER (WHERE c <= u) AS n FROM draws JOIN cdf ON s IS NOT DISTINCT FROM source GROUP BY doc_id
)
SELECT d.*, t.c AS copy FROM documents d JOIN counts USING (doc_id), unnest(range(0, n)) AS t(c)
"""

_TEMPLATE_ROWS = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(TEMPLATES.items()))

_OP6 = rf"""
WITH t(template, body) AS (VALUES {_TEMPLATE_ROWS}),
tw AS (SELECT template, list_filter(regexp_split_to_array(lower(body), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM t),
ts AS (SELECT DISTINCT template, unnest([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) AS g FROM tw),
tn AS (SELECT template, count(*) AS n FROM ts GROUP BY template),
dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
ds AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) AS g FROM dw),
f AS (SELECT doc_id, template, count(*) AS found FROM ds JOIN ts USING (g) GROUP BY ALL)
SELECT doc_id, template, n::INT AS n_template, found::INT AS n_found, found / n AS containment
FROM f JOIN tn USING (template) WHERE found / n >= 0.8
"""

_LINES = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL AND text <> ''),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
w AS (
  SELECT doc_id, i, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_char,
         length(line) AS n_chars, list_filter(regexp_split_to_array(lower(line), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS words FROM l
), u AS (
  SELECT doc_id, i, start_char, start_char + n_chars AS end_char, len(words) AS n_words, array_to_string(words, ' ') AS unit,
         row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place
  FROM w WHERE len(words) > 0
), k AS (
  SELECT *, min(doc_id) OVER (PARTITION BY unit) AS keeper, count(*) OVER (PARTITION BY unit) AS n, row_number() OVER (PARTITION BY unit, doc_id ORDER BY i) AS nth FROM u
), r AS (
  SELECT *, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS run FROM k WHERE n > 1 AND (doc_id <> keeper OR nth > 1)
)
SELECT doc_id, min(start_char)::INT AS start_char, max(end_char)::INT AS end_char, count(*) AS n_units, sum(n_words)::BIGINT AS n_words, min(keeper) AS first_doc_id
FROM r GROUP BY doc_id, run
"""

_OP8 = """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), h AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h FROM l),
r AS (
  SELECT *, (h + 31 * coalesce(lag(h, 1) OVER w, 0) + 961 * coalesce(lag(h, 2) OVER w, 0)) % 4 = 0 AS ends
  FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), g AS (
  SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM r
), chunks AS (
  SELECT doc_id, c, min(i) AS start_line, max(i) AS end_line, string_agg(line, chr(10) ORDER BY i) AS chunk
  FROM g GROUP BY doc_id, c HAVING count(*) > 1
), f AS (
  SELECT *, first_value(doc_id) OVER w AS first_doc_id, first_value(start_line) OVER w AS first_start_line
  FROM chunks WINDOW w AS (PARTITION BY chunk ORDER BY doc_id, start_line)
)
SELECT doc_id, start_line::INT AS start_line, end_line::INT AS end_line, first_doc_id, first_start_line::INT AS first_start_line
FROM f WHERE (doc_id, start_line) <> (first_doc_id, first_start_line)
"""

_OP9 = f"""
WITH RECURSIVE n AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '[ \t-\r]+'), lambda x: x <> '') AS w FROM n),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE len(w) WHEN 0 THEN [] WHEN 1 THEN [w[1]] ELSE [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] END)) AS g FROM w
), k AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN k ka ON ka.doc_id = a JOIN k kb ON kb.doc_id = b WHERE 100 * common >= 80 * (ka.c + kb.c - common)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(id, r) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT b, r FROM reach JOIN both_ways ON a = id WHERE r < b
), c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT doc_id, coalesce(k.c, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN c ON id = doc_id LEFT JOIN k USING (doc_id)
"""

_OP10 = f"""
WITH n AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS norm FROM documents),
g AS (SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, norm FROM n)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

_OP12 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND {_FINITE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93::DOUBLE
), n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
reach(id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT b, r FROM reach JOIN l ON a = id WHERE r < b),
c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON id = vec_id LEFT JOIN n ON a = vec_id
"""

_OP13 = f"""
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND {_FINITE}
), s AS (
  SELECT a.id AS anchor_id, a.label AS anchor_label, b.id, b.label, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 100 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), n AS (
  SELECT anchor_id, positive_id, positive_score, id AS negative_id, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank
  FROM p JOIN s USING (anchor_id) WHERE label <> anchor_label AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_filter": _OP3,
        "op5_mix_sources": _OP5,
        "op6_license_scan": _OP6,
        "substring_dedup_lines": _LINES,
        "op8_line_dedup": _OP8,
        "op9_hyperminhash_dedup": _OP9,
        "op10_exact_dedup": _OP10,
        "op12_embedding_dedup": _OP12,
        "op13_hard_negatives": _OP13,
    }

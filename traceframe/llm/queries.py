"""The registered queries of these operators: whole tables, production parameters, digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.llm import (
    decontaminate, filter_audit, language_id, near_dedup, packing, pii, quality, risk_rules, secrets, token_align, token_counts, token_files, topk_search,
)
from traceframe.llm.common import fold, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op2_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), width=3, percent=85, bands=24, rows=4)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = quality.train(quality.training_rows(docs, table(spark, sf_dir, "labels")))
    scored = quality.score(docs, weights)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), token_files.default_tokenizer(), end_id=2)


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    asked = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return topk_search.top_documents(docs, asked)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), token_files.default_tokenizer(), end_id=1)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.fit(language_id.training_rows(docs)))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "languages")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), token_counts.default_tokenizer())


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op11_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk_rules.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))



def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.token_links(table(spark, sf_dir, "documents"), *token_align.default_tokenizers())


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_minmax_dedup, op3_quality, op4_token_files, op5_topk_search, op6_packing, op7_language_id, op8_decontamination,
        op9_token_counts, op10_pii, op11_risk_rules, op12_filter_audit, op13_token_align,
    )
}

_WORDS = r"regexp_extract_all(lower(text), '[0-9a-z_\x{80}-\x{10FFFF}]+')"

ORACLES: dict[str, str] = {
    "op2_minmax_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
low AS (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(l.b, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN low l USING (doc_id)""",
    "op5_topk_search": rf"""
WITH t AS (SELECT doc_id, unnest({_WORDS}) AS t FROM documents WHERE doc_id IS NOT NULL),
tf AS (SELECT doc_id, t, count(*) AS tf FROM t GROUP BY 1, 2),
len AS (SELECT doc_id, sum(tf) AS n FROM tf GROUP BY 1),
g AS (SELECT (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL) AS docs, (SELECT sum(n) FROM len) AS words),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1),
s AS (
  SELECT q.doc_id AS query_id, d.doc_id, round(sum(q.tf * ln(1 + (g.docs - df.df + 0.5) / (df.df + 0.5)) * d.tf * 2.2
    / (d.tf + 1.2 * (0.25 + 0.75 * len.n / (g.words / g.docs)))), 6) AS score
  FROM tf q JOIN tf d USING (t) JOIN df USING (t) JOIN len ON len.doc_id = d.doc_id CROSS JOIN g WHERE q.doc_id % 20 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, doc_id, score FROM r WHERE rank <= 10""",
    # Every item of the table has five words or more; shorter ones are tested against brute force.
    "op8_decontamination": rf"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
d AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM dw WHERE len(w) >= 5),
i AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM iw WHERE len(w) >= 5),
n AS (SELECT item_id, count(*) AS item_shingles FROM i GROUP BY 1),
c AS (SELECT doc_id, item_id, count(*) AS shared FROM d JOIN i USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, item_shingles, shared, shared / item_shingles AS containment FROM c JOIN n USING (item_id) WHERE 10 * shared >= 8 * item_shingles""",
    "op12_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::INT
      + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > least, false)::INT AS mask
  FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, good, toxic, count(*) AS n FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
p AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM f a, f b, f c, f d, f e
  WHERE a.b + b.b + c.b + d.b + e.b = 31 AND a.b | b.b | c.b | d.b | e.b = 31),
s AS (SELECT filter_order, k::INTEGER AS step, bits[k] AS own, coalesce(list_sum(bits[1:k - 1]), 0)::INT AS earlier FROM p, range(1, 6) r(k)),
x AS (SELECT *, mask & own <> 0 AS fails, mask & earlier = 0 AS fresh FROM c, s),
t AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (fresh AND NOT fails), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (fresh AND fails), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (fails AND NOT fresh), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails, coalesce(sum(n) FILTER (fresh AND fails AND good), 0)::BIGINT AS good_lost,
    coalesce(sum(n) FILTER (fresh AND fails AND toxic), 0)::BIGINT AS toxic_lost
  FROM x GROUP BY ALL)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM t""",
}

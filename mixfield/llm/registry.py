"""Driver queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, langid, mixing, neardup, ngram_lm, packing, passages, pii, quality_gam

#: Overlap and link thresholds, targets and cut-offs of the production run.
WINDOW, SHINGLE, PERCENT, NEAREST, QUALITY, END_ID = 10, 3, 85, 20, 0.3, 2


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), WINDOW)


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_lm.score(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", F.round("score", 4).alias("score"), F.round("mean", 6).alias("mean"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 20 == 0), NEAREST)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), QUALITY)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"), SHINGLE, PERCENT)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    trained = langid.train(docs.where(~held), vocabulary("piece_bpe_32k.model"))
    return langid.predict(docs, trained).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


def op9_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.tokenise(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), END_ID)


def op10_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeats(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_lm_score, op3_ann, op4_quality, op5_near_dedup, op6_language_id, op7_pii, op8_mix_sources, op9_token_packing, op10_passage_dedup)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1 = rf"""
WITH d AS (SELECT doc_id, [x FOR x IN string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS ws FROM documents),
b AS (SELECT item_id, [x FOR x IN string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS ws FROM benchmark),
bm AS (SELECT item_id, ws, least(10, len(ws)) AS m FROM b WHERE len(ws) > 0),
bn AS (SELECT row_number() OVER () AS b, item_id, ws, m FROM bm),
bi AS (SELECT b, item_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM bn),
bp AS (SELECT b, item_id, m, i AS j, array_to_string(ws[i : i + m - 1], ' ') AS k FROM bi),
bw AS (SELECT DISTINCT item_id, m, k FROM bp),
ms AS (SELECT DISTINCT m FROM bm),
di AS (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, ms),
dw AS (SELECT doc_id, m, i, array_to_string(ws[i : i + m - 1], ' ') AS k FROM di),
hit AS (SELECT DISTINCT dw.doc_id, dw.i, dw.m, bw.item_id FROM dw JOIN bw USING (m, k)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
diag AS (SELECT dw.doc_id, bp.b, dw.m, dw.i, dw.i - bp.j AS d FROM dw JOIN bp USING (m, k)),
isle AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, b, m, d ORDER BY i) AS g FROM diag),
runs AS (SELECT doc_id, count(*) + m - 1 AS n, min(i) - 1 AS p0 FROM isle GROUP BY doc_id, b, m, d, g),
lg AS (SELECT doc_id, n, p0 FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p0) = 1),
it AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(pos.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items,
  sha256(coalesce(it.items, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated, coalesce(lg.n, 0)::BIGINT AS longest, coalesce(lg.p0, -1)::BIGINT AS longest_at
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN lg USING (doc_id)
"""

_OP5 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, [x FOR x IN string_split_regex({_LOWER}, '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM documents),
i AS (SELECT doc_id, ws, least(3, len(ws)) AS m, unnest(range(1, len(ws) - least(3, len(ws)) + 2)) AS i FROM d WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + m - 1], ' ') AS k FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.doc_id),
g AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, g.component_id, d.doc_id = g.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN g USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": _OP1, "op2_lm_score": ngram_lm.ORACLE, "op5_near_dedup": _OP5, "op8_mix_sources": mixing.ORACLE}

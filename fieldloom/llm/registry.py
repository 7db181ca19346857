"""Queries of this subpackage: what __spark_entry__ adds to its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import ann, convtrie, fingerprints, lm, mixing, neardup, phrases, pieces, quality, secrets, sharding, urlrules, warc
from fieldloom.session import table


#: n-grams as lists of words; products are 128-bit integers
PHRASES_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
spoken AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
sized AS (SELECT lang, ws, unnest(generate_series(1, least(5, len(ws)))) AS m FROM spoken),
grams AS (SELECT lang, m, list_slice(ws, i, i + m - 1) AS g FROM (SELECT lang, ws, m, unnest(generate_series(1, len(ws) - m + 1)) AS i FROM sized)),
f AS (SELECT lang, m, g, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, g, f AS a FROM f WHERE m > 1 AND f >= 100),
cuts AS (SELECT lang, m, g, a, unnest(generate_series(1, m - 1)) AS k FROM c),
scored AS (
  SELECT cuts.lang, cuts.g, a, k, x.f AS l, y.f AS r, n, CAST(CAST(1000 AS HUGEINT) * a * n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts JOIN n USING (lang)
  JOIN f x ON x.lang = cuts.lang AND x.g = list_slice(cuts.g, 1, k)
  JOIN f y ON y.lang = cuts.lang AND y.g = list_slice(cuts.g, k + 1, cuts.m)),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inside AS (
  SELECT lang, list_slice(g, i, i + j - 1) AS g, max(a) AS f
  FROM (SELECT lang, g, a, m, j, unnest(generate_series(1, m - j + 1)) AS i FROM (SELECT *, unnest(generate_series(2, m - 1)) AS j FROM c WHERE m > 2))
  GROUP BY ALL),
free AS (SELECT best.*, array_to_string(best.g, ' ') AS phrase FROM best LEFT JOIN inside ON inside.lang = best.lang AND inside.g = best.g WHERE inside.f IS NULL OR 100 * inside.f < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM free QUALIFY rank <= 2000
"""


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table's shares in the mix; `shards` says for which shards words are taken (shard:words)."""
    shards = F.array_join(F.transform("parts", lambda p: F.concat_ws(":", p["shard"], p["b"] - p["a"])), ",")
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", shards.alias("shards"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("block"))
    return urlrules.judge(table(spark, sf_dir, "pages"), labels)


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convtrie.trie(table(spark, sf_dir, "conversations"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_neighbours": op2_neighbours,
        "op3_secrets": op3_secrets,
        "op4_shards": op4_shards,
        "op5_mix": op5_mix,
        "op6_pieces": op6_pieces,
        "op7_warc": op7_warc,
        "op8_neardup": op8_neardup,
        "op9_lm": op9_lm,
        "op10_urls": op10_urls,
        "op11_trie": op11_trie,
        "op12_phrases": op12_phrases,
        "op13_fingerprints": op13_fingerprints,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op12_phrases": PHRASES_SQL}

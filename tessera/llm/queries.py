"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pii, whitening
from .alignment import aligned
from .ann import nearest
from .embedding_dedup import near_vectors
from .mixing import mixed
from .packing import packed
from .preferences import preference_rows, swapped_replies
from .sharding import shuffled_shards
from .simhash import near_groups
from .suffix_dedup import remove_repeats
from .toxicity import held_out, scored, train
from .url_rules import judged


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> tuple[str, str]:
    """The path of byte_bpe_50k's ranks, the same vocabulary as byte_bpe_50k.json, and its split pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = train(docs, _table(spark, sf_dir, "labels"))
    return scored(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op6_pack_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents"), *vocabulary()).drop("ids")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pii.found_spans(docs, pii.train(docs)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op9_preference_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_rows(*swapped_replies(_table(spark, sf_dir, "conversations")))


def op10_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shuffled_shards(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: Rules of op11: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judged(_table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return aligned(_table(spark, sf_dir, "documents"), *vocabulary(), public_tokenizers.path("piece_bpe_32k.model"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    fitted = whitening.fit(vectors)
    rows = whitening.whiten(vectors, fitted).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    n, error, explained = (fitted.moments.n, fitted.identity_error, fitted.explained) if fitted else (None, None, [])
    shares = F.array(*(F.lit(x).cast("double") for x in explained)) if explained else F.array().cast("array<double>")
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup, op2_embedding_dedup, op3_toxicity, op4_mix_sources, op5_nearest_neighbours, op6_pack_mixture, op7_personal_data, op8_simhash_groups, op9_preference_rows, op10_shuffle_shards,
        op11_url_rules, op12_token_alignment, op13_whitening,
    )
}

ORACLES: dict[str, str] = {
    "op11_url_rules": """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
)
SELECT page_id, host, path,
  CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/' END AS rule,
  CASE rule WHEN 'example.com/en/' THEN 'block' WHEN 'net/es/' THEN 'block' WHEN 'net/fr/' THEN 'block' ELSE 'allow' END AS verdict
FROM parts
""",
    "op9_preference_rows": """
WITH given AS (
  SELECT conv_id AS pair_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), last AS (
  SELECT pair_id, max(turn) AS turn, arg_max(text, turn) AS reply FROM given WHERE role = 'assistant' GROUP BY pair_id
), swapped AS (
  SELECT g.pair_id, g.turn, g.role, CASE WHEN g.turn = m.turn AND g.role = 'assistant' AND t.reply IS NOT NULL THEN t.reply ELSE g.text END AS text
  FROM given g LEFT JOIN last m ON m.pair_id = g.pair_id LEFT JOIN last t ON t.pair_id = xor(g.pair_id, 1)
), c AS (
  SELECT pair_id, list({'role': role, 'text': text} ORDER BY turn, role, text) AS c FROM given GROUP BY pair_id
), r AS (
  SELECT pair_id, list({'role': role, 'text': text} ORDER BY turn, role, text) AS r FROM swapped GROUP BY pair_id
), agreed AS (
  SELECT pair_id, c, r, list_position(list_transform(range(1, least(len(c), len(r)) + 1), lambda i: c[i] = r[i]), false) AS first FROM c JOIN r USING (pair_id)
), cut AS (
  SELECT pair_id, CASE WHEN coalesce(first, 0) = 0 THEN least(len(c), len(r)) ELSE first - 1 END AS n, c, r FROM agreed
), sides AS (
  SELECT pair_id, 'p' AS side, i, c[i] AS t FROM cut, unnest(range(1, n + 1)) AS u(i)
  UNION ALL SELECT pair_id, 'c', i, c[i] FROM cut, unnest(range(n + 1, len(c) + 1)) AS u(i)
  UNION ALL SELECT pair_id, 'r', i, r[i] FROM cut, unnest(range(n + 1, len(r) + 1)) AS u(i)
), rendered AS (
  SELECT pair_id, side, i, t.role AS role, length(t.text) AS size, '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10) AS s FROM sides
), placed AS (
  SELECT *, sum(length(s)) OVER (PARTITION BY pair_id, side ORDER BY i) AS stop FROM rendered
), texts AS (
  SELECT pair_id, side, string_agg(s, '' ORDER BY i) AS s,
    string_agg(CAST(stop - size - 8 AS VARCHAR) || ':' || CAST(stop AS VARCHAR), ',' ORDER BY i) FILTER (WHERE role = 'assistant') AS mask
  FROM placed GROUP BY pair_id, side
)
SELECT cut.pair_id, CAST(n AS BIGINT) AS n_common, coalesce(p.s, '') AS prompt, coalesce(x.s, '') AS chosen, coalesce(y.s, '') AS rejected,
  coalesce(x.mask, '') AS chosen_mask, coalesce(y.mask, '') AS rejected_mask
FROM cut LEFT JOIN texts p ON p.pair_id = cut.pair_id AND p.side = 'p'
LEFT JOIN texts x ON x.pair_id = cut.pair_id AND x.side = 'c' LEFT JOIN texts y ON y.pair_id = cut.pair_id AND y.side = 'r'
""",
}

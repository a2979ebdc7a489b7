"""The registered queries of this subpackage, each over a whole table, and their DuckDB SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, bit_clusters, byte_bpe, cosine_links, line_dedup, mixing, near_dedup, personal_data, quality, token_alignment, toxicity, url_filter, vector_search
from .common import table

URL_POLICY = url_filter.UrlPolicy(
    rules=(("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")),
)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.personal_data(table(spark, sf_dir, "documents"))
    count = lambda a, k: F.size(F.filter(a, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *[count("base", k) for k in personal_data.KINDS],
        F.sha2(personal_data.as_text(F.col("base")), 256).alias("base_sha256"),
        personal_data.as_text(F.col("spans")).alias("spans"),
        F.size("learned").cast("long").alias("n_learned"),
        count("spans", "secret"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op5_audio_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of ``conversations``, played as tones, is a recording."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    found = audio.recording_classes(audio.fingerprints(turns, audio.tones, "text", audio.TONES))
    return found.select("conv_id", "turn", "n_frames", F.col("node").alias("prints_sha256"), "class", "n_links", F.col("other").alias("best_other"), "offset", "start", "frames", "bit_error")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"), URL_POLICY).select("page_id", "host", "path", "rule", "verdict")


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.ToxicityModel:
    """Trained on the labelled documents that aren't held out."""
    return toxicity.train(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id"))))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    score = toxicity.toxic_score(F.col("text"), toxicity_model(spark, docs, sf_dir), docs)
    scored = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeat_report(table(spark, sf_dir, "documents"), edits=2, least_chars=20)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encoded_digests(table(spark, sf_dir, "documents"), byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


def op11_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine_links.near_vectors(table(spark, sf_dir, "embeddings"), least=0.9)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte_level = token_alignment.ByteLevel(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = token_alignment.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return token_alignment.alignments(table(spark, sf_dir, "documents"), byte_level, pieces, public_tokenizers.PATTERN)


def op13_bit_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_clusters.clusters(table(spark, sf_dir, "embeddings"), k=16, rounds=3, scale=64, seed=1).drop("centroid")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_personal_data": op2_personal_data,
        "op3_exact_top_k": op3_exact_top_k,
        "op4_quality": op4_quality,
        "op5_audio_fingerprints": op5_audio_fingerprints,
        "op6_url_filter": op6_url_filter,
        "op7_toxicity": op7_toxicity,
        "op8_line_dedup": op8_line_dedup,
        "op9_near_dedup": op9_near_dedup,
        "op10_byte_bpe": op10_byte_bpe,
        "op11_near_vectors": op11_near_vectors,
        "op12_token_alignment": op12_token_alignment,
        "op13_bit_clusters": op13_bit_clusters,
    }


def _url_sql() -> str:
    lower = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    found = lambda term: f"regexp_matches({lower}, '(^|[^a-z0-9]){term}($|[^a-z0-9])')"
    strict = " OR ".join(found(t) for t in URL_POLICY.strict)
    soft = " + ".join(f"{w} * {found(t)}::INT" for t, w in URL_POLICY.soft.items())
    rules = sorted(URL_POLICY.rules, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in rules)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in rules)
    return f"""
WITH after AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM after)
SELECT page_id, host, path, CASE {rule} END AS rule,
    CASE {verdict} WHEN {strict} OR {soft} >= {URL_POLICY.soft_limit} THEN 'block' ELSE 'allow' END AS verdict FROM parts
"""


TOP_K_SQL = """
WITH usable AS (SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM usable q, usable c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM scored) WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    mix = mixing.MIX_SQL.format(docs="documents")
    return {
        "op1_mix_sources": f"WITH {mix} SELECT doc_id, size_ AS size, source_size, target, (size_ * n_)::BIGINT AS taken, source, n_::BIGINT AS copies FROM mixed_",
        "op3_exact_top_k": TOP_K_SQL,
        "op6_url_filter": _url_sql(),
        "op13_bit_clusters": bit_clusters.CLUSTERS_SQL,
    }

"""The registered queries of this subpackage, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import bpe, embedding_dedup, exact_dedup, merkle, packing, pii, quality, sharding, simhash, token_counts, toxicity, warc, whitening

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_SQL: dict[str, str] = {}


def _query(function):
    LLM_QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query
def op3_external_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_digest(sharding.external_shuffle(_table(spark, folder, "documents")))


@_query
def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, folder, "documents"))


LLM_SQL["op9_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS squeezed
  FROM documents
), g AS (
  SELECT doc_id, first_value(doc_id) OVER (PARTITION BY squeezed ORDER BY points DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY squeezed) AS group_size, sha256(squeezed) AS text_sha256 FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g"""


@_query
def op10_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


@_query
def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@_query
def op8_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.coding_digest(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@_query
def op1_pii_contexts(spark: SparkSession, folder: str) -> DataFrame:
    return pii.pii_digest(_table(spark, folder, "documents"))


@_query
def op2_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(_table(spark, folder, "embeddings"))


@_query
def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query
def op6_toxicity_chain(spark: SparkSession, folder: str) -> DataFrame:
    toxic = F.coalesce(F.col("toxic"), F.lit(0))
    labels = _table(spark, folder, "labels").select("doc_id", toxic.alias("toxic"), (toxic * (1 - F.coalesce("quality", F.lit(1)))).alias("toxic_junk"))
    return toxicity.toxicity(_table(spark, folder, "documents"), labels, ("toxic", "toxic_junk"))


@_query
def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(_table(spark, folder, "documents"))


@_query
def op11_warc_packages(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived_pages(_table(spark, folder, "pages"))


LLM_SQL["op11_warc_packages"] = """
WITH d AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex,
    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - i % 4 * 5 AS INTEGER)) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM d"""


@_query
def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(_table(spark, folder, "embeddings"))


@_query
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.verification(_table(spark, folder, "documents"))


def _merkle_sql(heights: tuple[int, int]) -> str:
    """The manifest level by level, for trees of groups and of subroots that are no higher than ``heights``."""

    def value(column: str) -> str:
        return f"coalesce(octet_length(encode(CAST({column} AS VARCHAR))) || ':' || CAST({column} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(value(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def level(name: str, below: str) -> str:
        """The next level of all trees; a tree of one node stays as it is."""
        return f"""
{name} AS (SELECT tree, CASE WHEN total = 1 THEN place ELSE place // 16 END AS place, (any_value(total) + 15) // 16 AS total,
    CASE WHEN any_value(total) = 1 THEN any_value(node) ELSE sha256(string_agg(node, '' ORDER BY {below}.place)) END AS node,
    CASE WHEN any_value(total) = 1 THEN NULL ELSE list(node ORDER BY {below}.place) END AS run
  FROM {below} GROUP BY tree, CASE WHEN total = 1 THEN place ELSE place // 16 END)"""

    def climbed(name: str, below: str, run: str, key: str) -> str:
        """Proof, folded node and place of each document, one level further up."""
        return f"""
{name} AS (SELECT d.* REPLACE (
      CASE WHEN run IS NULL THEN spot ELSE spot // 16 END AS spot,
      CASE WHEN run IS NULL THEN proof ELSE proof || array_to_string(list_concat(run[:spot % 16], run[spot % 16 + 2:]), '') END AS proof,
      CASE WHEN run IS NULL THEN folded ELSE sha256(array_to_string(list_concat(run[:spot % 16], [folded], run[spot % 16 + 2:]), '')) END AS folded)
  FROM {below} d JOIN {run} r ON r.tree = d.{key} AND r.place = CASE WHEN r.run IS NULL THEN d.spot ELSE d.spot // 16 END)"""

    crc = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)), " \
        "lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), " \
        "lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    groups, tops = heights
    parts = [
        f"""
leaves AS (SELECT doc_id, (source IS NOT NULL, coalesce(source, '')) AS tree, {leaf('text')} AS node,
    CASE WHEN {crc} % 5 = 0 THEN {leaf(lowered)} ELSE {leaf('text')} END AS other FROM documents)""",
        """
g0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, node) - 1 AS place, count(*) OVER (PARTITION BY tree) AS total FROM leaves)""",
        *(level(f"g{k + 1}", f"g{k}") for k in range(groups)),
        f"""
t0 AS (SELECT 0 AS tree, tree AS grp, node, row_number() OVER (ORDER BY tree[1], encode(tree[2])) - 1 AS place, count(*) OVER () AS total FROM g{groups})""",
        *(level(f"t{k + 1}", f"t{k}") for k in range(tops)),
        """
d0 AS (SELECT doc_id, tree, 0 AS whole, node AS leaf, place AS spot, '' AS proof, other AS folded FROM g0)""",
        *(climbed(f"d{k + 1}", f"d{k}", f"g{k + 1}", "tree") for k in range(groups)),
        f"""
u0 AS (SELECT d.* REPLACE (t0.place AS spot), t0.node AS subroot FROM d{groups} d JOIN t0 ON t0.grp = d.tree)""",
        *(climbed(f"u{k + 1}", f"u{k}", f"t{k + 1}", "whole") for k in range(tops)),
    ]
    return f"""WITH {",".join(parts)}
SELECT doc_id, leaf, subroot, (SELECT node FROM t{tops}) AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
  folded = (SELECT node FROM t{tops}) AS verified FROM u{tops}"""


# High enough for a million documents of one source, and for 4096 sources.
LLM_SQL["op13_merkle_manifest"] = _merkle_sql((5, 3))

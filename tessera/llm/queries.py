"""Queries of the text operators with production parameters, and their SQL where it exists."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import shared_dir, table
from tessera.llm.hard_negatives import HARD_NEGATIVES_SQL
from tessera.llm.line_dedup import LINE_DEDUP_SQL
from tessera.llm.prefix_trie import PREFIX_TRIE_SQL


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.sharding import assign_shards

    return assign_shards(table(spark, sf_dir, "documents"), shards=8)


def op5_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.token_files import read_digests, write_token_files

    path = shared_dir(spark)
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_digests(spark, path)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.lattice import encode_texts

    return encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), n_best=3)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.ngram_lm import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.decontamination import contaminations

    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("ld_lines_").alias("n_lines"), F.col("ld_dropped_n_").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.pii import replace_entities

    return replace_entities(table(spark, sf_dir, "documents"), key="tessera-demo-key")


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4, radius=4)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.hard_negatives import mine_hard_negatives

    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0, positives=5, negatives=10, window=(30, 90), scale=256)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.common import materialize
    from tessera.llm.prefix_trie import graft_heads, number_turns, prefix_trie

    turns = materialize(number_turns(table(spark, sf_dir, "conversations")))
    convs = turns.select("conv").distinct()
    conv = F.col("conv")
    built = graft_heads(turns, convs, F.crc32(conv.cast("string").cast("binary")) % 6, conv - conv % 100, longest_head=5)
    return prefix_trie(built, convs)


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.imatch import edit_and_fingerprint

    return edit_and_fingerprint(table(spark, sf_dir, "documents"), min_idf=3.0, max_idf=8.0)


QUERIES = {f.__name__: f for f in (op1_benchmark_decontamination, op2_quality_rules, op3_line_dedup, op4_sharding, op5_token_binary, op6_sentencepiece, op7_lm_scoring, op8_token_counts, op9_pii, op10_simhash_dedup, op11_hard_negatives, op12_prefix_trie, op13_document_fingerprints)}

ORACLES: dict[str, str] = {"op3_line_dedup": LINE_DEDUP_SQL, "op11_hard_negatives": HARD_NEGATIVES_SQL, "op12_prefix_trie": PREFIX_TRIE_SQL}

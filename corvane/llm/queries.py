"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bitplanes, html_text, langid, lines, minhash, mixing, neighbours, pieces, substrings, winnowing
from .sql import ORACLE

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with one occurrence of each group of nearly equal lines: doc_id, text, n_lines, n_removed."""
    return lines.dedup_lines(spark, table(spark, sf_dir, "documents"))


def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of each query: query_id, rank, vec_id, score."""
    return neighbours.nearest(spark, table(spark, sf_dir, "embeddings"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of documents on 2-word shingles: doc_id, n_shingles, component_id, kept."""
    return minhash.near_duplicates(spark, table(spark, sf_dir, "documents"), k=2)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document: doc_id, held_out, lang_pred, score."""
    return langid.identify(spark, table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, decoded again: doc_id, piece_ids, n_pieces, round_trip."""
    return pieces.encode_documents(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without repeated 35-word windows: doc_id, n_words, n_removed, kept_sha256."""
    return substrings.dedup_substrings(spark, table(spark, sf_dir, "documents"), texts=False)


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    return winnowing.fingerprints(spark, table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as read back from plane files: doc_id, start, n_tokens, ids_crc32, shard."""
    return bitplanes.token_files(spark, table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents selected by hierarchical budgeting: doc_id, domain, lang, source, n_tokens, epoch."""
    return mixing.mix(spark, table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "pipeline": pipeline,
        "op1_line_dedup": op1_line_dedup,
        "op2_nn_descent": op2_nn_descent,
        "op3_html_text": op3_html_text,
        "op4_minhash": op4_minhash,
        "op5_language_id": op5_language_id,
        "op6_sentencepiece": op6_sentencepiece,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_winnowing": op8_winnowing,
        "op9_token_files": op9_token_files,
        "op10_mix_sources": op10_mix_sources,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)

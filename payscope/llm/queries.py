"""The registered queries of the operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payscope.llm.bpe import Vocabulary, decode_ids, encode_texts
from payscope.llm.decontaminate import contaminated
from payscope.llm.html_text import extract_pages
from payscope.llm.kneser_ney import score_documents
from payscope.llm.langid import identify
from payscope.llm.lexical import SEARCH_SQL, search
from payscope.llm.minhash import edited_fingerprints
from payscope.llm.packing import pack_documents
from payscope.llm.pii import find_pii
from payscope.llm.shared import crc32_mod, read_table
from payscope.llm.simhash import hex_of, near_duplicates
from payscope.llm.spelling import SPELLING_SQL, group_spellings
from payscope.llm.suffix_dedup import remove_repeats
from payscope.llm.toxicity import score_toxicity


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(read_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = identify(docs, docs.where(crc32_mod(F.col("doc_id"), 5) != 0))
    return out.select("doc_id", (crc32_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score_documents(docs, crc32_mod(F.col("doc_id"), 7) != 2)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    train = labels.where(crc32_mod(F.col("doc_id"), 5) != 0).select("doc_id", "toxic")
    out = score_toxicity(docs, train)
    return out.select("doc_id", (crc32_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", "hits", "quoted_hits")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read_table(spark, sf_dir, "documents"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_of("fp").alias("fingerprint"), "component_id")


def op11_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    out = decode_ids(encode_texts(read_table(spark, sf_dir, "documents"), vocabulary), vocabulary)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(read_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_document_fingerprints, op2_suffix_dedup, op3_html_extraction, op4_packing, op5_decontamination,
        op6_language_id, op7_lm_scoring, op8_toxicity, op9_pii, op10_simhash_dedup, op11_bpe_encoding, op12_lexical_search, op13_spelling_variants, pipeline,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """Search and spelling variants in SQL.

    The others can't be held to SQL as a whole: each learns a model, hashes with XXH64, reads markup or follows links.  They are
    tested against brute force, plain versions, a public library and held-out accuracy in tests/llm.
    """
    return {"op12_lexical_search": SEARCH_SQL, "op13_spelling_variants": SPELLING_SQL}

"""The registered queries of this subpackage: each applies one operator to its whole table and derives the digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hamming, langid, licences, minhash, packing, quality, quotes, suffix_dedup, token_store
from .common import crc_of_id, shared_path

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_apart(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_of_id(F.col("doc_id")) % 5 == 0
    model = langid.fit_language_model(docs.filter(~held_out))
    return langid.identify_language(docs, model).select("doc_id", F.coalesce(crc_of_id(F.col("doc_id")) % 5 == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.FactorisationMachine | None:
    return quality.fit_quality_model(docs, labels.filter(crc_of_id(F.col("doc_id")) % 4 != 2))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    scored = quality.score_quality(docs, quality_model(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(crc_of_id(F.col("doc_id")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_token_store(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path(TOKENIZER)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    store = token_store.write_token_store(docs, shared_path(spark, "tokens"), str(tokenizer_path), end_id=2)
    return token_store.read_token_store(spark, store)


def op7_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.nearest_embeddings(table(spark, sf_dir, "embeddings"), k=10)


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents")).drop("spans")


def op9_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(table(spark, sf_dir, "conversations"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_best_fit_packing, op3_language_id, op4_quality, op5_suffix_dedup, op6_token_store, op7_hamming_topk, op8_licences, op9_quote_links, op10_minhash)}

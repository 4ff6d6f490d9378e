"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, conversation, embdedup, lexical, lm, mixing, packing, pii, quality, simhash, tokenstore, topk, toxicity, warc


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.table(spark, sf_dir, "documents"))


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"), word_tokenizer(), end_id=0, capacity=2048)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, common.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (common.doc_fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and base_sha256 are those of the base spans; spans and n_added have what the method adds."""
    return pii.extract(common.table(spark, sf_dir, "documents"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_duplicates(common.table(spark, sf_dir, "embeddings"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(common.table(spark, sf_dir, "embeddings"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.new_path(spark, "warc")
    return warc.read_records(warc.write_archives(common.table(spark, sf_dir, "pages"), folder), folder)


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "token-store")
    tokenstore.write_store(common.table(spark, sf_dir, "documents"), path, word_tokenizer(), end_id=2)
    return tokenstore.read_checks(spark, path)


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(common.table(spark, sf_dir, "documents"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, common.table(spark, sf_dir, "labels")))
    held_out = common.doc_fold(folds=quality.FOLDS) == quality.HELD_OUT
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.repair(conversation.damage(common.table(spark, sf_dir, "conversations")))


def embedding_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4 on every vector, a near copy of each fifth and an exact one of each tenth: the given vectors have no links of their own."""
    given = common.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    near = given.where("vec_id % 5 = 0").select((F.col("vec_id") + 1_000_000).alias("vec_id"), F.transform("embedding", lambda x, i: F.when(i < 1, -x).otherwise(x)).alias("embedding"))
    exact = given.where("vec_id % 10 = 0").select((F.col("vec_id") + 2_000_000).alias("vec_id"), "embedding")
    return embdedup.near_duplicates(given.unionAll(near).unionAll(exact))


def warc_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7 on every page, a copy of each third and a short page beside each seventh: the given payloads all differ and none is short."""
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    copies = pages.where("page_id % 3 = 0").select((F.col("page_id") + 1_000_000).alias("page_id"), "url", "html")
    short = pages.where("page_id % 7 = 0").select((F.col("page_id") + 2_000_000).alias("page_id"), "url", F.substring("html", 1, 40).alias("html"))
    folder = common.new_path(spark, "warc")
    return warc.read_records(warc.write_archives(pages.unionAll(copies).unionAll(short), folder), folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash,
    "op2_best_fit_packing": op2_pack,
    "op3_toxicity": op3_toxicity,
    "op5_pii": op5_pii,
    "op4_embedding_near_dedup": op4_embeddings,
    "op6_exact_top_k": op6_top_k,
    "op7_warc": op7_warc,
    "op8_source_mixing": op8_mix,
    "op9_token_store": op9_token_store,
    "op10_lm_scoring": op10_lm,
    "embedding_copies": embedding_copies,
    "warc_copies": warc_copies,
    "op11_quality": op11_quality,
    "op12_lexical_search": op12_lexical,
    "op13_conversation_repair": op13_conversations,
}

ORACLES: dict[str, str] = {
    "op4_embedding_near_dedup": embdedup.ORACLE,
    "op6_exact_top_k": topk.ORACLE,
    "op7_warc": warc.ORACLE,
    "op8_source_mixing": mixing.ORACLE,
    "embedding_copies": "WITH RECURSIVE given AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings), copied AS (SELECT * FROM given UNION ALL SELECT vec_id + 1000000, list_transform(embedding, lambda x, i: CASE WHEN i <= 1 THEN -x ELSE x END) FROM given WHERE vec_id % 5 = 0 UNION ALL SELECT vec_id + 2000000, embedding FROM given WHERE vec_id % 10 = 0), " + embdedup.ORACLE.strip().removeprefix("WITH RECURSIVE ").replace("FROM embeddings", "FROM copied"),
    "warc_copies": "WITH copied AS (SELECT page_id, url, html FROM pages UNION ALL SELECT page_id + 1000000, url, html FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT page_id + 2000000, url, substr(html, 1, 40) FROM pages WHERE page_id % 7 = 0), " + warc.ORACLE.strip().removeprefix("WITH ").replace("FROM pages", "FROM copied"),
    "op12_lexical_search": lexical.ORACLE,
    "op13_conversation_repair": conversation.ORACLE,
}

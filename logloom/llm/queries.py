"""Registered queries of this subpackage: thin digests over the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from logloom.llm import chat, containment, fim, langid, lines, minhash, mixing, nbsvm, pii, ranked, simhash, toxicity, warc
from logloom.llm.common import crc_mod, hex64, table
from logloom.session import scratch_path
from logloom.sinks import fs


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.remove_repeated_lines(table(spark, sf_dir, "documents"), window=3, counts=True)
    return found.select("doc_id", "text", "n_lines", "n_removed")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(chat.PROBE, "conv_id bigint, turn bigint, role string, text string")
    return chat.read_back(chat.format_chats(turns.unionByName(probe)))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    root = scratch_path(spark, "warc")
    warc.write_archives(pages, root)
    found = warc.lookup(spark, root, pages.select("url", "page_id").distinct(), payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return found.select("doc_id", hex64("fingerprint").alias("fingerprint"), "component_id")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(crc_mod("doc_id", 3) != 1))
    return langid.detect(docs, model).select(
        "doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = nbsvm.train(docs, labels.where(crc_mod("doc_id", 5) != 0), "quality")
    return nbsvm.score(docs, model).select(
        "doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"),
                                  threshold=0.8, shingle=5)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.with_edited(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = toxicity.train(docs, labels.where(crc_mod("doc_id", 4) != 2), "toxic")
    return toxicity.score(docs, lexicon).select(
        "doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "index")
    try:
        index = ranked.build_index(table(spark, sf_dir, "documents"), path)
        return ranked.search(index, table(spark, sf_dir, "benchmark"), k=10)
    finally:
        fs.delete(spark, path)


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"),
                        "spans", "n_added")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.transform(table(spark, sf_dir, "documents"), rate=90, spm_rate=20, salt="1"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_chat_format": op2_chat_format,
    "op3_warc": op3_warc,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_mix_sources": op5_mix_sources,
    "op6_language_id": op6_language_id,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_decontamination": op8_decontamination,
    "op9_fingerprints": op9_fingerprints,
    "op10_toxicity": op10_toxicity,
    "op11_ranked_search": op11_ranked_search,
    "op12_personal_data": op12_personal_data,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE: dict[str, str] = {
    "op1_line_dedup": lines.ORACLE,
    "op2_chat_format": chat.ORACLE,
    "op3_warc": warc.ORACLE,
    "op5_mix_sources": mixing.ORACLE,
    "op8_decontamination": containment.ORACLE,
    "op11_ranked_search": ranked.ORACLE,
    "op13_fill_in_middle": fim.ORACLE,
}

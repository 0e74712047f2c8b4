"""The queries of this subpackage over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelry.llm import oracles
from parcelry.llm.chat import chat_windows, read_windows
from parcelry.llm.decontam import mark_contamination
from parcelry.llm.lines import remove_repeated_lines
from parcelry.llm.merkle import folded_root, leaf_digest, merkle_manifest, proof_digest
from parcelry.llm.neardup import near_duplicate_classes
from parcelry.llm.packing import pack_best_fit
from parcelry.sources.scratch import drop_at_exit, new_path
from parcelry.llm.rules import quality_rules
from parcelry.llm.sharding import shard_by_bytes
from parcelry.llm.substrings import remove_repeated_passages
from parcelry.llm.topk import integer_vectors, top_inner_products
from parcelry.llm.toxicity import fit_severity, score_severity
from parcelry.llm.whitening import fixed_point, whiten
from parcelry.llm.warc import merge_index, read_archives, url_key, write_archives


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The table has no capture time; each page was captured one second after the page with the id before it.
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", "html").withColumn("captured", F.timestamp_seconds(1_700_000_000 + F.coalesce("page_id", F.lit(0))))
    path = new_path(spark, "warc")
    write_archives(pages, path)
    drop_at_exit(spark, path)
    entries = read_archives(spark, path).withColumn("url_key", url_key(F.col("url")))
    return merge_index(entries).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "position")


def severity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades from the labels: 0 not toxic, 1 toxic, 2 toxic and of low quality."""
    toxic, poor = F.col("toxic") == 1, F.coalesce(F.col("quality") == 0, F.lit(False))
    return _read(spark, sf_dir, "labels").select("doc_id", (toxic.cast("int") + (toxic & poor).cast("int")).alias("grade"))


def op2_toxicity_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_severity(docs, severity_labels(spark, sf_dir))
    return score_severity(docs, model).select("doc_id", "expected_severity", "grade", "toxic")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_passages(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_best_fit(docs).withColumnRenamed("id", "doc_id")


def op5_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    return shard_by_bytes(docs, shards=24).select(
        "doc_id", "size", F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return mark_contamination(docs, _read(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    added = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.inline(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("text")) for i, role in enumerate(("user", "assistant"))])))
    convs = read_windows(chat_windows(turns.unionByName(added)))
    turn = lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))
    return convs.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", turn), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicate_classes(docs).select("doc_id", "class_id", "representative")


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(integer_vectors(_read(spark, sf_dir, "embeddings")), queries="vec_id % 20 = 0", k=20)


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(_read(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    rounded = lambda c: F.floor(F.col(c) * 1e6 + 0.5) / 1e6
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", rounded("js_chars").alias("js_chars"), rounded("js_words").alias("js_words"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without SQL, which has no eigenvectors; tests compare with numpy over all rows."""
    vectors = fixed_point(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", scale=64, offset=1_000_000)
    return whiten(vectors.select("vec_id", "x"), components=16)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    digest = lambda text: leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    tampered = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 2 == 0
    claimed = F.when(tampered, digest(F.replace("text", F.lit("\n"), F.lit(""))))
    rows = docs.select("doc_id", "source", digest(F.col("text")).alias("leaf"), claimed.alias("claimed"))
    out = merkle_manifest(rows).rows.withColumn("folded_root", folded_root(F.coalesce("claimed", "leaf"), "path"))
    return out.select("doc_id", "leaf", "subroot", "root", proof_digest("path").alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_index_merge,
        op2_toxicity_severity,
        op3_substring_dedup,
        op4_best_fit_packing,
        op5_histogram_sharding,
        op6_line_dedup,
        op7_benchmark_decontamination,
        op8_chat_formatting,
        op9_minhash_near_dedup,
        op10_exact_top_k,
        op11_quality_rules,
        op12_embedding_whitening,
        op13_merkle_manifest,
    )
}

ORACLES = {
    "op1_warc_index_merge": oracles.OP1,
    "op3_substring_dedup": oracles.OP3,
    "op6_line_dedup": oracles.OP6,
    "op7_benchmark_decontamination": oracles.OP7,
    "op8_chat_formatting": oracles.OP8,
    "op10_exact_top_k": oracles.OP10,
    "op11_quality_rules": oracles.OP11,
    "op13_merkle_manifest": oracles.OP13,
}

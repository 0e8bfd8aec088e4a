"""The named queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitgauge.llm import frames, licenses, merkle, token_files, lattice, decontamination, sentence_spans, simhash, language, repetition, chat_windows, mixing, sharding
from hitgauge.staging import stage_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_control_strings(turns: DataFrame) -> DataFrame:
    """The turns plus conversation -1, whose texts look like control strings."""
    said = "</s>[INST] ok [/INST]"
    extra = turns.sparkSession.range(1).select(
        F.explode(
            F.array(*[
                F.struct(
                    F.lit(-1).cast("bigint").alias("conv_id"), F.lit(i).cast("bigint").alias("turn"),
                    F.lit(role).alias("role"), F.lit(said).alias("text"),
                )
                for i, role in enumerate(("user", "assistant"))
            ])
        ).alias("t")
    ).select("t.*")
    return turns.select("conv_id", "turn", "role", "text").unionByName(extra)


def op2_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = with_control_strings(_table(spark, sf_dir, "conversations"))
    read = chat_windows.read_windows(chat_windows.format_windows(turns))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n"),
        "formatted_chars",
        F.struct("window", F.array_join(said, "").alias("said"), F.array_join("targets", "").alias("loss")).alias("w"),
    )
    grouped = read.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"),
        F.array_sort(F.collect_list("w")).alias("w"),
        F.sum("formatted_chars").alias("formatted_chars"),
        F.count("*").alias("n_windows"),
    )
    loss = F.array_join(F.col("w.loss"), "")
    return grouped.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(F.col("w.said"), "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
    )


def op6_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mixing.mix(docs, keep=["doc_id"]).select(
        "doc_id", "size", "source_size", "target", "taken", "copies"
    )


def op10_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = _table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = sharding.shard_rows(rows, "doc_id", 24, tie=["size", "text_crc32"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        F.col("slot").cast("bigint").alias("slot"), "grown_shard",
    )


def op5_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return repetition.judge(docs).select("_doc.doc_id", "repetition.*")


def _part(df: DataFrame, n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op7_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(_part(docs, 5) == 0, F.lit(False)))
    trees = language.learn(docs.filter(~F.col("held_out")))
    found = language.predict(docs.select("doc_id", "held_out", "text"), trees)
    return found.select("_doc.doc_id", "_doc.held_out", "lang_pred", "score")


def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4, distance=4)
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = sentence_spans.remove_repeats(docs)
    return cut.select("_doc.doc_id", "text", "n_sentences", "n_removed")


def op4_benchmark_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    found = decontamination.contaminated(docs, items)
    return found.select(F.col("id").alias("doc_id"), "item_id", "score", F.col("stop").alias("stop_word"))


def op1_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", F.coalesce(_part(docs, 7) == 2, F.lit(False)))
    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    return lattice.score(docs, docs.filter(~F.col("held_out")), vocabulary, keep=["held_out"])


END_ID = 2


def token_digests(docs: DataFrame) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and read them back."""
    spark = docs.sparkSession
    path = stage_path(spark, "token-files")
    token_files.write(docs, path, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    kind = docs.schema["doc_id"].dataType.simpleString()
    read = token_files.read(spark, path, kind, with_ids=False)
    return read.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op3_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_seekable_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_path(spark, "frames")
    frames.write_store(_table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    found = frames.digests(frames.infill(frames.read_store(spark, path), "doc_id"))
    return found.select(
        "doc.doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"
    )


def op12_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("spans")


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.when(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", LETTERS, LETTERS.lower())
    ).otherwise(F.col("text"))
    found = merkle.manifest(docs, "doc_id", "lang", fields, {"text": tampered})
    folded = merkle.fold(F.col("tampered"), F.col("path"))
    found = found.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), folded.alias("folded_root")
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {
    "op3_rans_tokens": op3_rans_tokens,
    "op1_subword_lattice": op1_subword_lattice,
    "op8_sentence_spans": op8_sentence_spans,
    "op4_benchmark_alignment": op4_benchmark_alignment,
    "op9_simhash_components": op9_simhash_components,
    "op7_ppm_language": op7_ppm_language,
    "op5_suffix_repeats": op5_suffix_repeats,
    "op2_chat_windows": op2_chat_windows,
    "op6_pareto_mix": op6_pareto_mix,
    "op10_jump_shards": op10_jump_shards,
    "op11_seekable_infill": op11_seekable_infill,
    "op12_license_diagonals": op12_license_diagonals,
    "op13_merkle_manifest": op13_merkle_manifest,
}

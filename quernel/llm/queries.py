"""The registered query of each operator, with its production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm import ann, chatformat, decontam, langid, linededup, minhash, pieces, resample, sharding, spelling, tokencount, toxicity, warc
from quernel.store import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(_table(spark, sf_dir, "documents"))


def op2_anisotropic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op3_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return sharding.histogram_shards(docs, shards=16).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_word_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op5_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


#: Rank file of a byte-level vocabulary; a parameter of the operator.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op6_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document, and after three edits at places that its doc_id gives: words put in, characters
    taken out, and characters replaced."""
    docs = _table(spark, sf_dir, "documents")

    def place(turn: str) -> Column:
        return F.pmod(F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(turn)).cast("binary")), F.length("text") + 1).cast("int")

    def edit(turn: str, length: int, insert: str) -> Column:
        return F.struct(place(turn).alias("start"), F.lit(length).alias("length"), F.lit(insert).alias("insert"))

    edits = F.array(edit("a", 0, " more words,\n 12"), edit("b", 17, ""), edit("c", 9, "re's  "))
    counted = tokencount.counted_edits(docs.withColumn("edits", edits), RANKS, ["doc_id"])
    return counted.select("doc_id", "n_pretokens", "n_tokens", "n_tokens_edited", "n_reencoded")


def op7_cumulative_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")), ["doc_id"])


#: Where the model file of the box's public tokenizers is; a parameter of the operator.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op8_shared_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ids of each text, and whether decoding them gives the text back."""
    coded = pieces.round_trip(_table(spark, sf_dir, "documents"), PIECE_MODEL, ["doc_id"])
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "restored")


def op9_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


#: What op11 formats besides the table: a user's and an assistant's turn that hold the template's own control strings.
CONTROLS = r"\### Assistant: </turn> ok"


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a transcript, and what is read back from that."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(CONTROLS).alias("text"))
    out = chatformat.formatted(turns.unionByName(more))
    back = out.select("conv_id", "formatted", chatformat.read_back(F.col("formatted")).alias("turns"), chatformat.learned_text(F.col("segments")).alias("loss"))
    each = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(each, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op13_target_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=25, least=20, seed=7)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_dart_minhash": op1_dart_minhash,
        "op2_anisotropic": op2_anisotropic,
        "op3_histogram_shards": op3_histogram_shards,
        "op4_word_backoff": op4_word_backoff,
        "op5_line_windows": op5_line_windows,
        "op6_edit_counts": op6_edit_counts,
        "op7_cumulative_link": op7_cumulative_link,
        "op8_shared_prefix": op8_shared_prefix,
        "op9_capture_index": op9_capture_index,
        "op10_winnowing": op10_winnowing,
        "op11_chat_format": op11_chat_format,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_target_resample": op13_target_resample,
    }

"""The thin ``opN_<name>`` queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsquorum.llm import html, lm, mixing, neardup, negatives, packing, pii, quality, runs, sharding, tokenfile, vectors, warc
from tsquorum.llm.common import Cuts

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(read(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan_mix(read(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path())
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op6_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.train_and_score(read(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def counted(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(counted, pii.BASE_KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = Cuts(spark).cut(warc.write_archives(read(spark, sf_dir, "pages")), "archives")
    records = warc.read_archives(spark, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return warc.resolved(Cuts(spark).cut(records, "records"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(read(spark, sf_dir, "embeddings"))


def rehearsed(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's words: in documents that a checksum of their id picks, those from some place on repeat with some period."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1  # without an id, as they are
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(read(spark, sf_dir, "documents"), prepare=rehearsed)
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    best = found.withColumn("best", runs.strongest(F.col("runs"))).withColumn("listed", F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(F.lit("")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label").cast("bigint"))
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", shifted.alias("label"))
    return negatives.mine_negatives(vectors, F.col("vec_id") % 100 == 0)


def op13_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, files = tokenfile.write_token_files(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    pieces = Cuts(spark).cut(tokenfile.read_pieces(spark, folder, files), "pieces")
    return tokenfile.documents_of(pieces, files)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_html, op2_mix, op3_shard, op4_pack, op5_neardup, op6_likelihood, op7_pii, op8_warc, op9_quality, op10_vectors, op11_runs, op12_negatives, op13_tokens)}

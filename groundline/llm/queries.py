"""The numbered queries: each applies an operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.llm import (
    grid_codes,
    licenses,
    line_dedup,
    lm,
    mixing,
    packing,
    pii,
    quality,
    quality_rules,
    rabitq,
    reference_sql,
    resampling,
    simhash,
    toxicity,
)

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
QUALITY_FROM = 0.3
TOXIC_FROM = 0.7


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence of 4096 tokens."""
    return pack_documents(_table(spark, sf_dir, "documents"))


def pack_documents(docs: DataFrame) -> DataFrame:
    pieces = packing.token_pieces(docs, public_tokenizers.path(TOKENIZER), END_ID)
    digests = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(digests, packing.shards_for(docs), ["doc_id", "start", "ids_crc32", "doc_tokens"])


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels and places of every document."""
    return licenses.scan_licenses(_table(spark, sf_dir, "documents")).drop("detections")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share, as digests."""
    kept = line_dedup.drop_shared_lines(_table(spark, sf_dir, "documents"), min_documents=10, shortest=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every vector whose id is divisible by 20."""
    return rabitq.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document; ids with remainder 0 of 5 are held out."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    forest = quality.fit_on(docs, quality.labelled(labels, "quality", quality.remainder(5) != 0))
    scored = quality.score_quality(docs, forest)
    predicted = (F.col("score") >= QUALITY_FROM).cast("int").alias("predicted")
    return scored.select("doc_id", (quality.remainder(5) == 0).alias("held_out"), "score", predicted)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every document; ids with remainder 1 of 3 are held out."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    learnable = quality.labelled(labels, "toxic", quality.remainder(3) != 1, toxicity.LABELLED_ROWS)
    scored = toxicity.score_toxicity(docs, toxicity.fit(docs, learnable))
    predicted = (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted")
    return scored.select("doc_id", (quality.remainder(3) == 1).alias("held_out"), "score", predicted)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss differences of every document between documents labelled good and all documents."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    path = public_tokenizers.path(TOKENIZER)
    models = lm.gather(_marked_good(docs, labels), F.col("good"), path)
    return lm.score_difference(docs, models, path)


def _marked_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``text, good``: whether a label calls the document good. Rows without an id match no label.

    Labels grow with the corpus, so both sides are dealt by id at every size; rows without an id
    are dealt by their text.
    """
    none = F.col("doc_id").isNull()
    key = [F.coalesce("doc_id", F.lit(0)).alias("a"), F.when(none, F.xxhash64("text")).otherwise(0).alias("b"), none.alias("c")]
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(False).alias("c")).distinct()
    return docs.select("text", *key).join(good.withColumn("good", F.lit(True)).hint("merge"), ["a", "b", "c"], "left")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and verdict of every document."""
    docs = _table(spark, sf_dir, "documents")
    forest = quality_rules.fit_rules(docs, _table(spark, sf_dir, "labels"))
    judged = quality_rules.judge(docs, forest)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule_score")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document against the benchmark texts, and the ranks of the tenth that is drawn."""
    drawn = resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document: counts and digest of the base ones, and all."""
    return pii.find_personal_data(_table(spark, sf_dir, "documents")).drop("found")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code, error and error of the label's rows of every vector."""
    coded, codebooks = grid_codes.compress(_table(spark, sf_dir, "embeddings"))
    return coded.withColumn("codebooks_sha256", F.lit(grid_codes.digest(codebooks)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q
    for q in (op1_packing, op2_license_scan, op3_line_dedup, op4_nearest, op5_quality, op6_toxicity, op7_simhash, op8_lm_scores, op9_quality_rules, op10_mixing, op11_resampling, op12_personal_data, op13_vector_codes)
}
ORACLES: dict[str, str] = {
    "op3_line_dedup": reference_sql.LINE_DEDUP,
    "op11_resampling": reference_sql.RESAMPLING,
    "op13_vector_codes": reference_sql.VECTOR_CODES,
}

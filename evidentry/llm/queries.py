"""The queries of the thirteen operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentry.llm import decontam, dialogues, digests, langid, packing, pii, quality, secrets, sharding, simhash, tokenfiles, vectorcodes, wordpieces
from evidentry.llm.columns import table
from evidentry.session import scratch_path


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *map(count, pii.KINDS),
        F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"),
        pii.joined(F.concat("base", "more")).alias("spans"),
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    tokenfiles.write_token_files(table(spark, sf_dir, "documents"), folder)
    return tokenfiles.read_token_files(spark, folder, keep_ids=False)


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated_words(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["order"] < len(secrets.BASE_RULES))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(r.kind) for r in secrets.BASE_RULES), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(langid.fold("doc_id", 4) != 2))
    found = langid.predict(docs, model)
    return found.select("doc_id", F.coalesce(langid.fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.compared_with_next(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard_by_size(table(spark, sf_dir, "documents"), shards=8)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = quality.quality_scores(docs, labels.where(langid.fold("doc_id", 5) != 0))
    held_out = F.coalesce(langid.fold("doc_id", 5) == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vectorcodes.compressed(table(spark, sf_dir, "embeddings"))
    digits = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0"))), "")
    return codes.select(F.col("id").alias("vec_id"), digits.alias("code"), "error", "label_error", F.lit(vectorcodes.books_sha256(books)).alias("codebooks_sha256"))


def op12_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return dialogues.described(dialogues.damaged(rows), rows).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op13_wordpieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wordpieces.decoded(wordpieces.encoded(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (op1_simhash, op2_pii, op3_packing, op4_token_files, op5_decontam, op6_secrets, op7_language, op8_digests, op9_sharding, op10_quality, op11_vector_codes, op12_dialogues, op13_wordpieces)
}

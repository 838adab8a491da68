"""The operators as queries over the whole given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ondula.llm import centroids, chat, decontamination, embeddings, licenses, merkle, mixing, pii, quality, secrets, simhash, tokens, toxicity
from ondula.llm.common import word_count, written

WEIGHTS = (5, 2, 1)
PII_KEY = "ondula"
GOOD = 0.7
TOKENIZER, TOKEN_LIMIT = "byte_bpe_50k.json", 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha(strings: Column) -> Column:
    return F.sha2(strings.cast("binary"), 256)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = written(docs.select("doc_id", "source", word_count("text").alias("size")))
    mixed = mixing.mix(sized, mixing.cyclic_weights(sized, WEIGHTS), size="size")
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.sql("""SELECT CAST(-1 AS BIGINT) AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text
                       FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)""")
    return chat.read_back(chat.format_turns(rows.unionByName(own)))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 3)

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{secrets.KINDS[kind]}")

    return found.select("doc_id", count(0), count(1), count(2), sha(secrets.listed(base)).alias("base_sha256"),
                        secrets.listed(F.col("spans")).alias("spans"), F.size(F.filter("verdicts", lambda v: v["random"])).cast("long").alias("n_random_base"),
                        F.round(F.array_max("verdicts.p"), 6).alias("p_base"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_hit", F.size("items").cast("long").alias("n_items"),
                        sha(F.array_join("items", ",")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string")))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_notices"),
                        F.array_join(F.array_sort(F.array_distinct("licenses.license")), ",").alias("licenses"),
                        F.round(F.array_max("licenses.coverage"), 6).alias("coverage"), F.array_join(spans, ",").alias("spans"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = quality.held_out("doc_id", 4, 2)
    weights = quality.fit(docs, labels.where(~out))
    return docs.select("doc_id", out.alias("held_out"), quality.score(F.col("text"), weights, docs).alias("score")).withColumn(
        "predicted", (F.col("score") >= GOOD).cast("int"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    def count(kind: str) -> Column:
        return F.size(F.filter("pii.kind", lambda k: k == kind)).cast("long").alias(f"n_{kind}")

    return done.select("doc_id", *[count(k) for k in pii.KINDS], F.size("pii").cast("long").alias("n_pii"), "text")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = quality.held_out("doc_id", 3, 1)
    weights = toxicity.fit(docs.where(~out), labels.where(~out))
    return docs.select("doc_id", out.alias("held_out"), toxicity.score(F.col("text"), weights, docs).alias("score")).withColumn(
        "predicted", (F.col("score") >= GOOD).cast("int"))


def op11_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokens.token_counts(docs, public_tokenizers.path(TOKENIZER), TOKEN_LIMIT)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centers = centroids.cluster(table(spark, sf_dir, "embeddings"))
    return centroids.with_inertia(assigned, centers).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in merkle.FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    docs = docs.withColumn("tampered", F.when(hit, merkle.digest_of(*fields)))
    rows = merkle.manifest(docs, keep=("tampered",))
    rows = rows.withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return rows.select("doc_id", "leaf", "subroot", "root", sha(F.array_join("proof.digest", "")).alias("proof_sha256"), "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mixing, op2_chat, op3_embeddings, op4_secrets, op5_decontamination, op6_licenses, op7_quality, op8_pii, op9_simhash, op10_toxicity,
                              op11_tokens, op12_centroids, op13_merkle)
}

"""The queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary, bpe, cotrain, fertility, minmax, mixing, packing, phrases, pivots, secrets, sharding, toxicity, tput


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard."""
    return sharding.assign_shards(_read(spark, sf_dir, "documents"), limit=None, carry=["doc_id"]).select("doc_id", "n_bytes", "shard", "shard_bytes")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    plan = mixing.mix_plan(_read(spark, sf_dir, "documents"))
    return plan.selectExpr("doc_id", "size", "source_size", "target", "size * n_copies AS taken")


def op1_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its links of cosine 0.9 or more and its component."""
    return pivots.groups(_read(spark, sf_dir, "embeddings"), cosine=0.9).withColumnRenamed("id", "vec_id")


def op2_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component under similarity 0.85 of 3-word shingles."""
    return minmax.groups(_read(spark, sf_dir, "documents"), words=3, percent=85).withColumnRenamed("id", "doc_id")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded, and the ids decoded."""
    return bpe.digests(bpe.encode(_read(spark, sf_dir, "documents"), offsets=False, decoded=True))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every text holds of secrets. The first scan fills the ledger, the second finds no unseen blob in it and
    joins its findings back to all documents."""
    docs = _read(spark, sf_dir, "documents")
    ledger = secrets.Ledger(spark)
    secrets.update(ledger, docs)
    found = secrets.scan(docs, ledger)

    def count(kind: str):
        return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("findings", lambda x: x["kind"].isin(*secrets.BASE))
    return found.select("doc_id", *map(count, secrets.BASE), F.sha2(secrets.spans_of(base), 256).alias("base_sha256"), secrets.spans_of(F.col("findings")).alias("spans"))


def op6_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures of every text, and the verdict of its tokeniser's fertility."""
    judged = fertility.judge(_read(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", "chars_per_token", "byte_share", "entropy")


def op7_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality by two views."""
    views = cotrain.featured(_read(spark, sf_dir, "documents"))
    return cotrain.score_featured(views, cotrain.learn(views, _read(spark, sf_dir, "labels")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learnt from the labels outside the held-out fifth."""
    docs = _read(spark, sf_dir, "documents")
    remainder = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) % 5
    model = toxicity.learn(docs, _read(spark, sf_dir, "labels"), remainder("id") != 0)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (remainder("doc_id") == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written and read back by key."""
    docs = _read(spark, sf_dir, "documents")
    folder, manifest = binary.write(docs)
    found = binary.checksums(binary.look_up(spark, folder, docs))
    return binary.with_starts(found, manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, with its sequence."""
    return packing.pack(_read(spark, sf_dir, "documents"), ids=False)


def op12_tput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item's 20 best documents."""
    return tput.best(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), 20)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every language's strongest phrases."""
    return phrases.collocations(_read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_pivots": op1_pivots,
    "op2_minmax": op2_minmax,
    "op3_bpe": op3_bpe,
    "op4_sharding": op4_sharding,
    "op5_secrets": op5_secrets,
    "op6_fertility": op6_fertility,
    "op7_cotraining": op7_cotraining,
    "op8_toxicity": op8_toxicity,
    "op9_token_store": op9_token_store,
    "op10_mixing": op10_mixing,
    "op11_packing": op11_packing,
    "op12_tput": op12_tput,
    "op13_phrases": op13_phrases,
}
ORACLES = {"op4_sharding": sharding.ORACLE, "op10_mixing": mixing.ORACLE, "op12_tput": tput.ORACLE, "op13_phrases": phrases.ORACLE}

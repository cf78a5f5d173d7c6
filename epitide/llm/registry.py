"""Registered queries of the operators, each over its whole table, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epitide.llm import bpe, caps, decontam, fim, pages, prefixes, repeats, secret_scan, shards, simhash, suffixes, toxicity, vptree
from epitide.llm.common import table
from epitide.llm.sql import SQL  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_histogram_sort(spark, sf_dir):
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    out = shards.shard_documents(table(spark, sf_dir, "documents"), 16, text_crc32=crc)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


@query
def op2_sparse_suffixes(spark, sf_dir):
    out = suffixes.suffix_repeats(table(spark, sf_dir, "documents"), length=50)
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["stop"].cast("string"))), ",")
    return out.withColumn("spans", spans)


@query
def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op4_secret_scan(spark, sf_dir):
    out = secret_scan.secret_spans(table(spark, sf_dir, "documents"))
    kinds = [secret_scan.count_kind(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return out.select("doc_id", *kinds, F.sha2(secret_scan.joined(F.col("base")), 256).alias("base_sha256"),
                      secret_scan.joined(F.col("spans")).alias("spans"))


@query
def op5_style_tree(spark, sf_dir):
    out = pages.main_text(table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


@query
def op6_simhash(spark, sf_dir):
    return simhash.simhash_groups(table(spark, sf_dir, "documents"), shingle=3, distance=2)


@query
def op7_spherical_caps(spark, sf_dir):
    return caps.embedding_groups(table(spark, sf_dir, "embeddings"), threshold=0.93)


@query
def op8_decontamination(spark, sf_dir):
    out = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query
def op9_bpe(spark, sf_dir):
    import public_tokenizers  # only this query needs it

    out = bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


@query
def op10_fm_index(spark, sf_dir):
    out = repeats.repeated_passages(table(spark, sf_dir, "documents"), window=50)
    kept = F.when(F.col("kept").isNull(), F.col("whole_sha256")).otherwise(F.sha2("kept", 256))
    return out.select("doc_id", "n_words", "n_removed", kept.alias("kept_sha256"))


@query
def op11_vantage_points(spark, sf_dir):
    return vptree.nearest(table(spark, sf_dir, "embeddings"), k=5, every=50, recall=0.98)


@query
def op12_sequence_collapse(spark, sf_dir):
    return prefixes.conversation_trie(table(spark, sf_dir, "conversations")).digests()


@query
def op13_displacement_scatter(spark, sf_dir):
    out = fim.restore(fim.fill_in_middle(table(spark, sf_dir, "documents"), rate=90, spm=20))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output"), 256).alias("output_sha256"),
                      F.sha2(F.col("restored"), 256).alias("restored_sha256"))

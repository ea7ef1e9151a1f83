"""The queries that apply each operator to its whole table, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.oracles import ORACLES as ORACLES


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm import quality_rules as Q

    docs = documents(spark, sf_dir)
    rules = Q.learn(docs, labels(spark, sf_dir))
    return Q.judge(docs.select("doc_id", "text"), rules).select("doc_id", *Q.BASE_COUNTS, "base_failed", "kept", "rule")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op1's base rules count, and their verdict."""
    from assayer.llm import quality_rules as Q

    return Q.judge(documents(spark, sf_dir).select("doc_id", "text"), Q.DecisionList(())).select("doc_id", *Q.BASE_COUNTS, "base_failed")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm.fingerprints import compare_with_next

    return compare_with_next(documents(spark, sf_dir))


def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and edited texts that op2 compares."""
    return op2_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm.suffix_dedup import remove_repeats

    return remove_repeats(documents(spark, sf_dir), keep_text=False).drop("kept")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm import secret_scan as S

    found, spans = S.scan(documents(spark, sf_dir)), F.col("spans")
    return found.select(
        "doc_id",
        *(S.count_kind(spans, kind).alias(f"n_{kind}") for kind in S.BASE),
        F.sha2(S.render(spans, S.BASE), 256).alias("base_sha256"),
        S.render(spans).alias("spans"),
        "blob",
    )


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm.source_mixing import mix

    rows = documents(spark, sf_dir).select("doc_id", "source", "text", F.length("text").cast("long").alias("chars"))
    return mix(rows, size=F.coalesce("chars", F.lit(0))).select("doc_id", "source", "mix_copy", "mix_key", "chars", F.md5("text").alias("text_md5"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm import toxicity as T

    docs = documents(spark, sf_dir)
    bias, weights = T.train(docs, labels(spark, sf_dir))
    return T.score(docs, bias, weights).select(
        "doc_id", T.is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").alias("n_offending"), F.get("offending", F.lit(0))["start"].alias("first_start"), F.get("offending", F.lit(0))["end"].alias("first_end")
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm.packing import pack

    return pack(documents(spark, sf_dir), word_tokenizer())


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm.ngram_join import link_groups

    return link_groups(documents(spark, sf_dir)).drop("key")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm import license_scan as L

    return L.scan(documents(spark, sf_dir), L.notices(spark))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with all evidence; documents with their text and, as host, their source."""
    from assayer.llm import language_id as G

    docs = documents(spark, sf_dir)
    langs, table = G.train(docs)
    pages = G.identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), langs, table, "page_id", "html", "url", markup=True)
    texts = G.identify(docs, langs, table, "doc_id", "text", "source")
    nothing = F.lit(None).cast("long")
    return pages.select(nothing.alias("doc_id"), F.col("id").alias("page_id"), *pages.columns[1:]).unionByName(texts.select(F.col("id").alias("doc_id"), nothing.alias("page_id"), *texts.columns[1:]))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm.filter_audit import audit

    return audit(documents(spark, sf_dir), labels(spark, sf_dir))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from assayer.llm.alignment import align

    return align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm.simhash import near_groups

    return near_groups(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_fingerprints": op2_fingerprints,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_secret_scan": op4_secret_scan,
    "op5_source_mixing": op5_source_mixing,
    "op6_toxicity": op6_toxicity,
    "op7_packing": op7_packing,
    "op8_ngram_join": op8_ngram_join,
    "op9_license_scan": op9_license_scan,
    "op10_language_id": op10_language_id,
    "op11_filter_audit": op11_filter_audit,
    "op12_token_alignment": op12_token_alignment,
    "op13_simhash_dedup": op13_simhash_dedup,
    "op_quality_counts": quality_counts,
    "op_fingerprint_edits": fingerprint_edits,
}

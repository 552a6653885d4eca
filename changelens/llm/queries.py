"""The registered queries of this package: each applies its operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, exact_dedup, lm, pii, quality, shingle_join, toxicity, url_filter, warc
from .common import remainder, table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text with pseudonyms, and how many values got one."""
    out = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.size(F.filter(F.zip_with("found", "given", lambda a, b: a != b), lambda x: x)).cast("long").alias("n_replaced"))


def _labelled(spark: SparkSession, sf_dir: str, operator, threshold: float) -> DataFrame:
    out = operator.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep={"held_out": remainder(F.col("doc_id"), 3) == 1})
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir, toxicity, 0.7)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages).select("page_id", "host", "path", "rule", "verdict", "block_score")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir, quality, 0.5)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.round_trip(table(spark, sf_dir, "documents"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op7_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.similar(table(spark, sf_dir, "documents"))[0]


def captures(pages: DataFrame) -> DataFrame:
    """Captures of pages, since the tables have none. Each page has three responses (record_id: four times the page_id, and
    one, two more) and, after the second of them, a not-modified revisit (three more). The second response has the page's
    text, the others its URL. By page_id, the validators are etags, last-modified or none, and every fifth page's revisit has
    a validator that no response has."""
    start = F.lit(1700000000) + F.pmod(F.col("page_id") * 7919, F.lit(86400 * 30))
    kind = F.pmod("page_id", F.lit(4))
    row = lambda k, seconds, what, body: F.struct((F.col("page_id") * 4 + k).alias("record_id"), (start + seconds).alias("seconds"), F.lit(what).alias("kind"), (F.col("page_id") * 4 + (1 if what == "revisit" else k)).alias("version"), body.alias("body"))
    every = F.array(row(0, 0, "response", F.col("url")), row(1, 43200, "response", F.col("html")), row(2, 129600, "response", F.col("url")), row(3, 86400, "revisit", F.lit(None).cast("string")))
    rows = pages.select("page_id", "url", F.explode(every).alias("c")).select("page_id", "url", "c.*")
    revisit = F.col("kind") == "revisit"
    tag = F.when(revisit & (F.pmod("page_id", F.lit(5)) == 0), "new").otherwise(F.concat(F.lit("v"), F.col("version")))
    headers = F.create_map(F.lit("etag"), F.when(kind < 2, tag), F.lit("last-modified"), F.when(kind == 2, tag), F.lit("date"), F.col("record_id").cast("string"), F.lit("server"), F.when(revisit, "front").otherwise("origin"))
    return rows.select("record_id", "url", F.timestamp_seconds("seconds").alias("at"), "kind", headers.alias("headers"), "body")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.resolve(captures(table(spark, sf_dir, "pages")))
    return out.select(F.expr("(record_id - 3) div 4").alias("page_id"), "canonical_url", "response_id", "status", F.col("headers")["date"].alias("merged_date"), F.col("headers")["server"].alias("merged_server"), F.sha2(F.col("body").cast("binary"), 256).alias("body_sha256"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_pii, op3_toxicity, op4_url_filter, op5_quality, op6_bpe, op7_shingle_join, op8_warc, op9_lm, op10_decontaminate, pipeline)}

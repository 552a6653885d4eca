"""Exact deduplication by content-defined chunk recipes. DataFrame functions only.

A text without its white space is cut into chunks whose ends the content decides. Each chunk has a 64-bit identifier,
and the dictionary of distinct chunks verifies by SHA-256 that an identifier stands for one chunk; identifiers that
stand for several get an ordinal. Texts are read once; after that only ordered identifier lists move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, partitions, saved

#: A chunk: 256 to 2048 characters up to a content-defined end, or what is left.
CHUNK = r"(?s).{256,2048}?[aeiou][^aeiou][bcf-hk-mp]|.{1,2051}"


def _cut(docs: DataFrame, doc_id: str, text: str, identify) -> DataFrame:
    """doc_id, n_points, text_sha256, parts: identifier h and SHA-256 digest d of each chunk, in order."""
    whole = F.coalesce(F.col(text), F.lit(""))
    plain = F.replace(F.replace(whole, F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))
    norm = F.when(whole.rlike(r"[\x09\x0B-\x0D]"), F.regexp_replace(whole, WHITE, "")).otherwise(plain)  # the usual two are faster alone
    cut = docs.select(F.col(doc_id).alias("doc_id"), F.length(whole).cast("long").alias("n_points"), norm.alias("norm"))
    cut = cut.select("doc_id", "n_points", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), F.regexp_extract_all("norm", F.lit(CHUNK), F.lit(0)).alias("chunks"))
    return cut.select("doc_id", "n_points", "text_sha256", F.transform("chunks", lambda c: F.struct(identify(c).alias("h"), F.unhex(F.sha2(c.cast("binary"), 256)).alias("d"))).alias("parts"))


def dictionary(parts: DataFrame) -> DataFrame:
    """The distinct chunks: identifier h and digest d. Repeats go before the shuffle."""
    return parts.select(F.explode("parts").alias("part")).select("part.h", "part.d").distinct()


def recipes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", identify=F.xxhash64) -> DataFrame:
    """A row per document: doc_id, n_points, text_sha256, recipe (identifiers in order), amend (position and ordinal of
    each chunk whose identifier stands for several chunks; empty for nearly all). (recipe, amend) tells texts apart."""
    parts = saved(_cut(docs, doc_id, text, identify))
    distinct = dictionary(parts)
    shared = saved(distinct.groupBy("h").count().where("count > 1").select("h"))
    kept = parts.select("doc_id", "n_points", "text_sha256", F.transform("parts", lambda p: p["h"]).alias("recipe"))
    none = F.array().cast("array<struct<pos:int,ordinal:int>>")
    if shared.isEmpty():
        return kept.withColumn("amend", none)
    ordinals = distinct.join(shared, "h", "left_semi").select("h", "d", F.row_number().over(Window.partitionBy("h").orderBy("d")).alias("ordinal"))
    found = parts.select("doc_id", "text_sha256", F.posexplode("parts").alias("pos", "part")).select("doc_id", "text_sha256", "pos", "part.h", "part.d").join(ordinals, ["h", "d"]).select("doc_id", "text_sha256", "pos", "ordinal").distinct()
    amends = found.groupBy(F.col("doc_id").alias("amend_id"), F.col("text_sha256").alias("amend_sha")).agg(F.array_sort(F.collect_list(F.struct("pos", "ordinal"))).alias("amend"))
    return kept.join(amends, kept.doc_id.eqNullSafe(amends.amend_id) & (kept.text_sha256 == amends.amend_sha), "left").select(*kept.columns, F.coalesce("amend", none).alias("amend"))


def duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", identify=F.xxhash64) -> DataFrame:
    """A row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_points.

    Texts are equal when equal without white space; null counts as empty. Of equal texts the row with most code points
    stays, then the smallest doc_id (null ids last). Rows repeated with the same id are one document: all of them are
    marked kept, and group_size counts each. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    rows = saved(recipes(docs, doc_id, text, identify).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(4 * partitions(spark))).cast("int")))
    best: Column = F.min(F.struct((-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"))).alias("best")
    # A hot group is dealt over its salts: the counts meet as one row a salt, and each salt joins its own rows.
    salted = rows.groupBy("recipe", "amend", "salt").agg(best, F.count("*").alias("n"))
    groups = salted.groupBy("recipe", "amend").agg(F.min("best").alias("best"), F.sum("n").alias("group_size"), F.collect_set("salt").alias("salts"))
    groups = groups.select("recipe", "amend", F.explode("salts").alias("salt"), F.col("best.id").alias("keep_id"), (-F.col("best.less")).alias("keep_points"), "group_size")
    return rows.join(groups, ["recipe", "amend", "salt"]).select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points"))).alias("kept"), "text_sha256", "n_points")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns. Rows repeated with the same id and text leave one, that with
    most code points (of equal ones the one with the largest hash of its columns, maps aside)."""

    def named(identifier: Column) -> Column:
        return F.when(identifier.isNull(), "").otherwise(F.concat(F.lit("i"), identifier.cast("string"))).alias("_name")

    kept = duplicates(docs, doc_id, text).where("kept").select(named(F.col("doc_id")), F.col("text_sha256").alias("_sha")).distinct()
    whole = F.coalesce(F.col(text), F.lit(""))
    sha = F.sha2(F.regexp_replace(whole, WHITE, "").cast("binary"), 256)
    order = F.struct(F.length(whole), F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind]))
    keyed = docs.select(named(F.col(doc_id)), sha.alias("_sha"), order.alias("_order"), F.struct(*docs.columns).alias("_row"))
    # Repeated rows meet as one a task before the shuffle, which the join uses as well.
    once = keyed.groupBy("_name", "_sha").agg(F.max_by("_row", "_order").alias("_row"))
    return once.join(kept, ["_name", "_sha"], "left_semi").select("_row.*")

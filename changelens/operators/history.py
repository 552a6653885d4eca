"""Style learnt from past commit subjects. subjects: repo, pos, subject."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.messages import parse_conventional

LEAST = 5


def parsed(subjects: DataFrame) -> DataFrame:
    c = F.col("c")
    return subjects.where("subject <> ''").withColumn("c", parse_conventional(F.col("subject"))).select("repo", "pos", "subject", c["type"].alias("type"), c["scope"].alias("scope"), c["text"].alias("text"))


def _frequent(subjects: DataFrame, key: str) -> DataFrame:
    counts = parsed(subjects).where(f"{key} is not null").groupBy("repo", key).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("n"), key)))


def types(subjects: DataFrame) -> DataFrame:
    return _frequent(subjects, "type")


def scopes(subjects: DataFrame, most: int = 10) -> DataFrame:
    return _frequent(subjects, "scope").where(F.col("rank") <= most)


def style(subjects: DataFrame, least: int = LEAST) -> DataFrame:
    """Of repositories with enough subjects: average length in bytes (whole number), whether lower case is usual (0.8 of all
    subjects begin with a lower-case letter, conventional ones after their prefix), and the share of conventional ones."""
    rows = parsed(subjects)
    low = F.coalesce("text", "subject").rlike(r"^\p{IsLowercase}")
    n, good = F.count("*"), F.count_if(F.col("type").isNotNull())
    length = F.floor(F.sum(F.octet_length("subject")) / n)
    out = rows.groupBy("repo").agg(n.alias("n"), length.alias("avg_length"), good.alias("n_good"), F.count_if(low).alias("n_low")).where(F.col("n") >= least)
    ratio = F.round(F.col("n_good") / F.col("n"), 6)
    return out.select("repo", "n", "avg_length", (10 * F.col("n_low") >= 8 * F.col("n")).alias("lower_case"), ratio.alias("conventional_ratio"))


def samples(subjects: DataFrame, most: int = 5) -> DataFrame:
    """The first conventional subjects of each repository."""
    w = Window.partitionBy("repo").orderBy("pos")
    return parsed(subjects).where("type is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("repo", "rank", "subject")

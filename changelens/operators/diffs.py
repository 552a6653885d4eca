"""Lines, hunks and counts of changes.

lines: changeset_id, file_idx, path, line_no, raw. Windows are partitioned by file, so a large changeset is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.secrets import first_secret
from ..functions.values import SECRETS

HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
FILE_KEY = ("changeset_id", "file_idx")


def added(raw: Column) -> Column:
    return raw.startswith("+") & ~raw.startswith("+++")


def removed(raw: Column) -> Column:
    return raw.startswith("-") & ~raw.startswith("---")


def content(raw: Column) -> Column:
    return F.substring(raw, 2, 1 << 30)


def stripped(text: Column) -> Column:
    """text without white space (Unicode's) at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def split_lines(text: Column) -> Column:
    """Lines without their ends; a final line end opens no further line, and an empty text has none."""
    cut = F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n", -1)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(cut)


def hunks(lines: DataFrame) -> DataFrame:
    """The hunk headers: old and new start and count (1 where not given), in order."""
    at = lambda k: F.regexp_extract("raw", HUNK, k)
    count = lambda k: F.coalesce(F.nullif(at(k), F.lit("")).cast("long"), F.lit(1).cast("long"))
    found = lines.where(F.col("raw").rlike(HUNK))
    return found.select(*FILE_KEY, "path", "line_no", at(1).cast("long").alias("old_start"), count(2).alias("old_count"), at(3).cast("long").alias("new_start"), count(4).alias("new_count"))


def numbered(lines: DataFrame, any_advances: bool = False) -> DataFrame:
    """lines with hunk_seq, old_line and new_line: the start of the hunk and a running count of the lines before. Only
    lines that start with +, - or a space advance, or with any_advances all others advance both."""
    w = Window.partitionBy(*FILE_KEY).orderBy("line_no")
    rows = lines.withColumn("head", F.col("raw").rlike(HUNK))
    rows = rows.withColumn("hunk_seq", F.sum(F.col("head").cast("long")).over(w))
    inside = Window.partitionBy(*FILE_KEY, "hunk_seq").orderBy("line_no")
    plus, minus = F.col("raw").startswith("+"), F.col("raw").startswith("-")
    both = ~plus & ~minus if any_advances else F.col("raw").startswith(" ")
    step = lambda own: F.coalesce(F.sum(F.when(~F.col("head") & (own | both), 1).otherwise(0)).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = lambda k: F.first(F.regexp_extract("raw", HUNK, k)).over(inside).cast("long")
    rows = rows.where("hunk_seq > 0").withColumns({"old_line": start(1) + step(minus), "new_line": start(3) + step(plus)})
    return rows.where("not head").drop("head")


def counts(lines: DataFrame) -> DataFrame:
    """additions and deletions of each file."""
    return lines.groupBy(*FILE_KEY, "path", "status").agg(F.count_if(added(F.col("raw"))).alias("additions"), F.count_if(removed(F.col("raw"))).alias("deletions"))


def with_counts(files: DataFrame, lines: DataFrame) -> DataFrame:
    """files with additions and deletions; 0 for a file without lines."""
    own = counts(lines).drop("path", "status")
    return files.join(own, list(FILE_KEY), "left").fillna(0, ["additions", "deletions"])


def diffstat(counted: DataFrame) -> DataFrame:
    return counted.groupBy("changeset_id").agg(F.count("*").alias("files_changed"), F.sum("additions").alias("insertions"), F.sum("deletions").alias("deletions"))


def status_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("changeset_id").agg(*[F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in ("Added", "Modified", "Deleted", "Renamed")])


def summary(counted: DataFrame) -> DataFrame:
    """One line a changeset; renamed is named only where there are some."""
    n = lambda s: F.count_if(F.col("status") == s).cast("string")
    some = F.when(F.count_if(F.col("status") == "Renamed") > 0, F.concat(F.lit(", "), n("Renamed"), F.lit(" renamed"))).otherwise("")
    text = F.concat(F.count("*").cast("string"), F.lit(" files ("), n("Added"), F.lit(" added, "), n("Modified"), F.lit(" modified, "), n("Deleted"), F.lit(" deleted"), some, F.lit(") | +"), F.sum("additions").cast("string"), F.lit(" -"), F.sum("deletions").cast("string"))
    return counted.groupBy("changeset_id").agg(text.alias("summary"))


def secrets_in_diff(lines: DataFrame, found: list[tuple[str, str]] = SECRETS) -> DataFrame:
    """Secrets in added lines, with their line in the new file; the first pattern of a line names it."""
    rows = lines.where(F.col("raw").rlike(HUNK) | F.col("raw").rlike(r"^[+\- ]"))
    hits = numbered(rows).where(added(F.col("raw"))).withColumn("pattern", first_secret(content(F.col("raw")), found))
    return hits.where("pattern is not null").select("changeset_id", "path", "line_no", "new_line", "pattern")


def conflicts(lines: DataFrame) -> DataFrame:
    """Whether added lines of a changeset hold an outer conflict marker anywhere, leaving out files of which a part of the
    path is tests, docs or examples or holds "test"."""
    aside = F.exists(F.split("path", "/"), lambda p: p.isin("tests", "docs", "examples") | p.contains("test"))
    marker = F.col("raw").contains("<" * 7) | F.col("raw").contains(">" * 7)
    return lines.groupBy("changeset_id").agg(F.bool_or(added(F.col("raw")) & ~aside & marker).alias("has_conflicts"))

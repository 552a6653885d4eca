"""Shares of a size budget."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths

RESERVE, LEAST_DIFF = 2000, 4000
# Bytes of a file header besides its path, and the notes.
HEADER = len("\n---  ---\n")
LOCK, EXCEEDED, CUT = "(lock file - content skipped)\n", "... (budget exceeded)\n", "... ({} lines truncated)\n"


def _shown(files: DataFrame) -> Column:
    """Whether a file's content is shown at all: neither binary nor a lock file."""
    binary = F.col("is_binary") if "is_binary" in files.columns else paths.is_binary(F.col("path"))
    return ~binary & ~paths.skips_content(F.col("path"))


def file_lines(files: DataFrame, most: int = 500, most_file: int = 100) -> DataFrame:
    """How many diff lines each file may show: by the number of files with content, weighted by category."""
    n = files.groupBy("changeset_id").agg(F.count_if(_shown(files)).alias("n"))
    base = F.when(F.col("n") == 1, most).when(F.col("n") <= 3, F.lit(most // 2)).when(F.col("n") <= 6, F.floor(F.lit(most) / F.col("n"))).otherwise(F.greatest(F.lit(30), F.floor(F.lit(most) / F.col("n"))))
    weight = F.when(F.col("category") == "Source", 3).when(F.col("category") == "Test", 2).otherwise(1)
    rows = files.join(n, "changeset_id").withColumn("category", paths.file_category(F.col("path")))
    return rows.select("changeset_id", "file_idx", F.least(F.greatest(F.floor(base * weight / 2), F.lit(20)), F.lit(most_file)).cast("long").alias("max_lines"))


def split(changesets: DataFrame, chars: int = 24000) -> DataFrame:
    """changesets (has_diffs, has_signatures, used: bytes of summary and file list) with symbol_budget, block_budget and
    diff_budget. The diff has LEAST_DIFF at least, at the symbols' cost."""
    rest = F.greatest(F.lit(chars - RESERVE) - F.col("used"), F.lit(0))
    share = F.when(F.col("has_diffs"), 20).when(F.col("has_signatures"), 30).otherwise(20)
    diff = F.greatest(F.lit(LEAST_DIFF), rest - F.floor(rest * share / 100))
    symbols = F.greatest(rest - diff, F.lit(0))
    return changesets.withColumns({"symbol_budget": symbols.cast("long"), "block_budget": F.floor(symbols / 3), "diff_budget": diff.cast("long")})


def truncate(files: DataFrame, lines: DataFrame, limits: DataFrame, budget: int) -> DataFrame:
    """Lines shown of each file under one budget of bytes a changeset: (changeset_id, file_idx, listed, shown, total). Files
    come by priority. A header that does not fit ends the list; a line that does not fit ends its file. Lock files cost
    their placeholder, cut files their notes; binary files cost nothing."""
    binary = F.col("is_binary") if "is_binary" in files.columns else paths.is_binary(F.col("path"))
    totals = lines.groupBy("changeset_id", "file_idx").agg(F.count("*").alias("total"))
    rows = files.where(~binary).select("changeset_id", "file_idx", F.octet_length("path").alias("name"), paths.skips_content(F.col("path")).alias("lock"), paths.priority(paths.file_category(F.col("path"))).alias("priority"))
    own = lines.join(limits, ["changeset_id", "file_idx"]).where("line_no < max_lines").groupBy("changeset_id", "file_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.octet_length("raw").alias("n")))), lambda s: s["n"]).alias("sizes"))
    rows = rows.join(totals, ["changeset_id", "file_idx"], "left").join(own, ["changeset_id", "file_idx"], "left").fillna(0, ["total"])

    def one(data: pd.DataFrame) -> pd.DataFrame:
        used, out, ended = 0, [], False
        for f in data.sort_values(["priority", "file_idx"]).itertuples(index=False):
            head, shown, sizes = f.name + HEADER, 0, list(f.sizes) if f.sizes is not None and not f.lock else []
            ended = ended or used >= budget or used + head + 50 > budget
            if not ended:
                used += head + (len(LOCK) if f.lock else 0)
                for n in sizes:
                    if used + n + 1 > budget:
                        used += len(EXCEEDED)
                        break
                    used, shown = used + n + 1, shown + 1
                if not f.lock and f.total > len(sizes):
                    used += len(CUT.format(f.total - len(sizes)))
            out.append((f.changeset_id, f.file_idx, not ended, shown, f.total))
        return pd.DataFrame(out, columns=["changeset_id", "file_idx", "listed", "shown", "total"])

    return rows.groupBy("changeset_id").applyInPandas(one, "changeset_id string, file_idx long, listed boolean, shown long, total long")

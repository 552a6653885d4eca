"""Checks of results against expectations; a check without an expectation passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def meets(expected: Column, actual: Column) -> Column:
    return expected.isNull() | expected.eqNullSafe(actual)


def contains_all(text: Column, wanted: Column) -> Column:
    return F.coalesce(F.forall(wanted, lambda w: text.contains(w)), F.lit(True))


def contains_none(text: Column, unwanted: Column) -> Column:
    return F.coalesce(~F.exists(unwanted, lambda w: text.contains(w)), F.lit(True))


def type_matches(expected: Column, actual: Column) -> Column:
    return F.lower(expected).eqNullSafe(F.lower(actual))


def scope_matches(expected: Column, actual: Column) -> Column:
    return expected.isNull() | (expected == "optional") | expected.eqNullSafe(actual)


def subject_passes(subject: Column, wanted: Column, unwanted: Column, most: Column) -> Column:
    """Contents of the text after the first `: ` in any case, and bytes of the first line."""
    line = F.substring_index(subject, "\n", 1)
    text = F.lower(F.when(F.instr(line, ": ") > 0, F.regexp_extract(line, r"^.*?: (.*)$", 1)).otherwise(line))
    low = lambda a: F.transform(a, lambda x: F.lower(x))
    return contains_all(text, low(wanted)) & contains_none(text, low(unwanted)) & (most.isNull() | (F.octet_length(line) <= most))


def connections_pass(found: Column, count: Column, least: Column, wanted: Column) -> Column:
    return (count.isNull() | (F.size(found) == count)) & (least.isNull() | (F.size(found) >= least)) & contains_all(F.array_join(found, " "), wanted)


def breaking_passes(expected: Column, signals: Column, removed: Column) -> Column:
    return meets(expected, (F.size(signals) > 0) | (removed > 0))


def summary(results: DataFrame) -> DataFrame:
    """results: expected_type, passed. Passed and total by type."""
    return results.groupBy(F.lower("expected_type").alias("expected_type")).agg(F.count_if("passed").alias("n_passed"), F.count("*").alias("n_total"))

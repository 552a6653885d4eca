"""Evaluation fixtures: directories with metadata.toml and diff.patch, and perhaps symbols.toml."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METADATA = "name string, expected_type string, expected_scope string, evidence map<string,string>, breaking boolean"
SYMBOLS = "changeset_id string, sym_idx long, kind string, name string, file string, line long, end_line long, is_public boolean, is_added boolean, signature string, parent_scope string"
KINDS = ("Function", "Method", "Struct", "Enum", "Trait", "Impl", "Class", "Interface", "Const", "Type")


def kind(name: str | None) -> str:
    """The symbol kind of that name in any case; Function if there is none."""
    return {k.lower(): k for k in KINDS}.get((name or "").lower(), "Function")


def _texts(spark: SparkSession, path: str, glob: str) -> DataFrame:
    rows = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path, wholetext=True)
    return rows.select(F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1).alias("changeset_id"), "value")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    @F.udf(METADATA)
    def read(text: str):
        got = tomllib.loads(text)
        return got.get("name"), got.get("expected_type"), got.get("expected_scope"), {k: str(v) for k, v in got.get("evidence", {}).items()}, got.get("breaking", {}).get("expected")

    return _texts(spark, path, "metadata.toml").select("changeset_id", read("value").alias("m")).select("changeset_id", "m.*")


def symbols(spark: SparkSession, path: str) -> DataFrame:
    """Injected symbols; a file that cannot be read has none."""

    def rows(batches):
        import pandas as pd

        columns = [c.split()[0] for c in SYMBOLS.split(", ")]
        for batch in batches:
            out = []
            for changeset, text in zip(batch["changeset_id"], batch["value"]):
                try:
                    got = tomllib.loads(text).get("symbols", [])
                except tomllib.TOMLDecodeError:
                    got = []
                out += [(changeset, i, kind(s.get("kind")), s.get("name"), s.get("file"), s.get("line", 1), s.get("end_line", 1), s.get("is_public", False), s.get("is_added", False), s.get("signature"), s.get("parent_scope")) for i, s in enumerate(got)]
            yield pd.DataFrame(out, columns=columns)

    return _texts(spark, path, "symbols.toml").mapInPandas(rows, SYMBOLS)

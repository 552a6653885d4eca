"""Secrets in lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import SECRETS


def patterns(custom: list[str] = (), disabled: list[str] = ()) -> list[tuple[str, str]]:
    """The built-in patterns but those disabled (by name, any case), then the custom ones, numbered as given. What Java
    cannot compile is left out."""
    from pyspark.sql import SparkSession

    out = [(n, r) for n, r in SECRETS if n.lower() not in {d.lower() for d in disabled}]
    for i, regex in enumerate(custom, 1):
        try:
            SparkSession.getActiveSession().sparkContext._jvm.java.util.regex.Pattern.compile(regex)
        except Exception:  # noqa: BLE001  only Java can say which patterns it rejects
            continue
        out.append((f"Custom Pattern {i}", regex))
    return out


def first_secret(line: Column, found: list[tuple[str, str]] = SECRETS) -> Column:
    """The name of the first pattern that the line matches, or null."""
    return F.coalesce(*[F.when(line.rlike(regex), name) for name, regex in found])

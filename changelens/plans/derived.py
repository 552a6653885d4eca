"""Inputs derived from the driver's tables, which hold no diffs: files, lines, symbols, subjects and responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FILE_COLUMNS = (
    "source as changeset_id",
    "doc_id as file_idx",
    "case when n_chars % 5 = 0 then 'Added' when n_chars % 5 = 1 then 'Deleted' when n_chars % 5 = 2 then 'Renamed' else 'Modified' end as status",
    """concat(case when doc_id % 7 = 0 then 'tests/' when doc_id % 11 = 0 then 'docs/' else 'src/' end, 'm', cast(n_chars % 3 as {s}), '/',
      case when doc_id % 13 = 0 then 'Cargo.toml' else concat('f', cast(doc_id as {s}), case lang when 'en' then '.rs' when 'de' then '.py' when 'fr' then '.md' else '.yml' end) end) as path""",
)

RAW = """case when pos % 40 = 0 then concat('@@ -', cast(pos + 1 as {s}), ',40 +', cast(pos + 3 as {s}), ',40 @@')
  else concat(case when status = 'Added' then '+' when status = 'Deleted' then '-' when pos % 3 = 0 then '+' when pos % 3 = 1 then '-' else ' ' end,
    case (pos + file_idx) % 23 when 1 then 'use crate::m1::sym_3;' when 2 then '// fix: handle empty input' when 3 then 'let r: Result<u8> = sym_7(x)?;'
      when 4 then 'tracing::info!("step");' when 5 then 'assert_eq!(a, b);' when 6 then 'password = "abcdefgh12"' when 7 then '/// doc comment line'
      when 8 then 'rust-version = "1.94"' when 9 then 'pub use crate::old;' else line end) end"""

SYMBOL_COLUMNS = (
    "changeset_id",
    "file_idx * 4 + k as sym_idx",
    "case (file_idx + (case when k >= 2 then 1 else 0 end)) % 3 when 0 then 'Function' when 1 then 'Struct' else 'Method' end as kind",
    "concat('sym_', cast((file_idx + (case when k >= 2 then 1 else 0 end) * 3 + case when file_idx % 4 = 0 then k else 0 end) % 9 as {s})) as name",
    "path as file",
    "cast(1 + (file_idx + k * 3) % 12 as bigint) as line",
    "cast(1 + (file_idx + k * 3) % 12 + length(text) % 15 as bigint) as end_line",
    "file_idx % 2 = 0 as is_public",
    "k % 2 = 0 as is_added",
    "concat('fn sym(', case (file_idx + k) % 3 when 0 then 'a: u8' when 1 then 'a: Map<K, V>, b: u8' else 'a: u8, b: u8' end, ')') as signature",
)

SUBJECT = """case event_type when 'signup' then concat('feat(u', cast(user_id % 6 as {s}), '): add signup ', cast(event_id as {s}))
  when 'error' then concat('fix(u', cast(user_id % 6 as {s}), ')!: handle error') when 'click' then 'chore: bump click' when 'view' then 'Update view'
  else 'yolo: purchase' end"""

RESPONSE = """concat(case when turn % 2 = 0 then '<think>plan</think>' else 'Here is the commit message: ' end, '{{"type":"',
  case conv_id % 3 when 0 then 'feat' when 1 then 'Fix' else 'yolo' end, '","scope":"a b","subject":"', regexp_replace(text, '[^A-Za-z ]', ''{g}), '.","body":null}}')"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*[c.format(s="string") for c in FILE_COLUMNS], "text")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """changeset_id, file_idx, path, status, line_no, raw."""
    cut = files(spark, sf_dir).select("changeset_id", "file_idx", "path", "status", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return cut.selectExpr("changeset_id", "file_idx", "path", "status", "pos as line_no", RAW.format(s="string") + " as raw")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = files(spark, sf_dir).withColumn("k", F.explode(F.array(*map(F.lit, range(4)))))
    return each.selectExpr(*[c.format(s="string") for c in SYMBOL_COLUMNS])


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("concat('repo', cast(user_id % 4 as string)) as repo", "event_id as pos", SUBJECT.format(s="string") + " as subject")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", RESPONSE.format(g="") + " as raw")


#: The same inputs for DuckDB, as common table expressions.
CTE = f"""
with files as (select {', '.join(c.format(s='varchar') for c in FILE_COLUMNS)}, text from documents),
exploded as (select changeset_id, file_idx, path, status, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from files),
lines as (select changeset_id, file_idx, path, status, pos as line_no, {RAW.format(s='varchar')} as raw from exploded),
symbols as (select {', '.join(c.format(s='varchar') for c in SYMBOL_COLUMNS)} from files cross join (select unnest([0, 1, 2, 3]) as k)),
subjects as (select concat('repo', cast(user_id % 4 as varchar)) as repo, event_id as pos, {SUBJECT.format(s='varchar')} as subject from events),
responses as (select conv_id, turn, {RESPONSE.format(g=", 'g'")} as raw from conversations)
"""

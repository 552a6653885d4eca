"""The registered queries: each applies an operator to whole derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import messages, paths
from ..functions import secrets as sec
from ..operators import budget, diffs, evaluation, evidence, grouping, history, similarity, symbols
from ..sources import patches
from ..streaming import tokens
from . import derived as D

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def counted(spark: SparkSession, d: str) -> DataFrame:
    return diffs.with_counts(D.files(spark, d).drop("text"), D.lines(spark, d))


@query
def src_patch_split(spark, d):
    body = D.lines(spark, d).groupBy("changeset_id", "file_idx", "path", "status").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "raw"))), lambda s: s["raw"]), "\n").alias("body"))
    new = F.when(F.col("status") == "Deleted", F.lit("+++ /dev/null")).otherwise(F.concat(F.lit("+++ b/"), "path"))
    text = F.concat(F.lit("diff --git a/"), "path", F.lit(" b/"), "path", F.lit("\n--- a/"), "path", F.lit("\n"), new, F.lit("\n"), "body", F.lit("\n"))
    whole = body.select("changeset_id", "file_idx", text.alias("t")).groupBy("changeset_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_idx", "t"))), lambda s: s["t"]), "").alias("patch"))
    return patches.split_patch(whole).groupBy("changeset_id", "path").agg(F.count("*").alias("n_lines"))


@query
def src_name_status(spark, d):
    old = F.concat(F.lit("old/"), "path")
    code = F.col("status").substr(1, 1)
    entry = F.when(code == "R", F.concat(F.lit("R"), F.lpad((F.col("file_idx") % 101).cast("string"), 3, "0"), F.lit("\0"), old, F.lit("\0"), "path")).otherwise(F.concat(code, F.lit("\0"), "path"))
    stream = D.files(spark, d).select("changeset_id", "file_idx", entry.alias("e")).groupBy("changeset_id").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_idx", "e"))), lambda s: s["e"]), "\0"), F.lit("\0")).alias("stream"))
    return stream.select("changeset_id", F.posexplode(patches.name_status(F.col("stream"))).alias("pos", "e")).select("changeset_id", "pos", "e.*")


@query
def prj_file_category(spark, d):
    p = F.col("path")
    return D.files(spark, d).select("file_idx", paths.file_category(p).alias("category"), paths.priority(paths.file_category(p)).cast("int").alias("priority"), paths.is_binary(p).alias("is_binary"), paths.skips_content(p).alias("skips"))


@query
def prj_page_category(spark, d):
    p = F.regexp_extract("url", r"^[^:]+://[^/]*/([^?#]*)", 1)
    return D.table(spark, d, "pages").select("page_id", paths.file_category(p).alias("category"), paths.extension(p).alias("extension"), paths.stem(p).alias("stem"))


@query
def prj_scope_from_path(spark, d):
    return D.files(spark, d).select("file_idx", paths.scope(F.col("path")).alias("scope"))


@query
def prj_module(spark, d):
    return D.files(spark, d).select("file_idx", paths.module(F.col("path")).alias("module"), paths.stem(F.col("path")).alias("stem"), paths.parent(F.col("path")).alias("parent"))


@query
def prj_language(spark, d):
    return D.files(spark, d).select("file_idx", paths.language(F.col("path")).alias("language"))


@query
def agg_file_counts(spark, d):
    return counted(spark, d).select("changeset_id", "file_idx", "additions", "deletions")


@query
def agg_diffstat(spark, d):
    return diffs.diffstat(counted(spark, d))


@query
def agg_status_counts(spark, d):
    return diffs.status_counts(D.files(spark, d))


@query
def prj_summary(spark, d):
    return diffs.summary(counted(spark, d))


@query
def flt_exclude_glob(spark, d):
    globs = ["**/*.yml", "docs/**"]
    keep = ~F.greatest(*[F.col("path").rlike(paths.glob_to_regex(g)) for g in globs])
    return diffs.diffstat(counted(spark, d).where(keep))


@query
def flt_subset(spark, d):
    wanted = D.files(spark, d).where("file_idx % 3 = 0").select("changeset_id", "path").distinct()
    return diffs.diffstat(counted(spark, d).join(wanted, ["changeset_id", "path"], "left_semi"))


@query
def set_staged_unstaged(spark, d):
    f = D.files(spark, d)
    return f.where("status <> 'Added'").select("changeset_id", "path").intersect(f.where("file_idx % 2 = 0").select("changeset_id", "path"))


@query
def fn_hunk_header(spark, d):
    return diffs.hunks(D.lines(spark, d)).drop("path")


@query
def win_line_numbers(spark, d):
    rows = diffs.numbered(D.lines(spark, d)).where(diffs.added(F.col("raw")))
    return rows.select("changeset_id", "file_idx", "line_no", "old_line", "new_line")


@query
def safety_secret_scan(spark, d):
    return diffs.secrets_in_diff(D.lines(spark, d))


@query
def safety_first_pattern(spark, d):
    rows = D.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), sec.first_secret(F.col("line")).alias("pattern")).where("pattern is not null")


@query
def safety_conflicts(spark, d):
    return diffs.conflicts(D.lines(spark, d).withColumn("raw", F.when(F.col("line_no") % 17 == 3, F.lit("+======= x")).when(F.col("line_no") % 23 == 5, F.lit("+  <<<<<<< x")).otherwise(F.col("raw"))))


@query
def sym_added(spark, d):
    return symbols.only(D.symbols(spark, d), True).select("changeset_id", "sym_idx", "kind", "name", "file")


@query
def sym_removed(spark, d):
    return symbols.only(D.symbols(spark, d), False).select("changeset_id", "sym_idx", "kind", "name", "file")


@query
def sym_modified(spark, d):
    return symbols.modified(D.symbols(spark, d)).select("changeset_id", "sym_idx", "kind", "name", "file")


@query
def sym_signature_change(spark, d):
    return symbols.signature_changes(D.symbols(spark, d)).select("changeset_id", "sym_idx", "old_signature", "new_signature")


@query
def diff_fields(spark, d):
    return symbols.parameter_changes(symbols.signature_changes(D.symbols(spark, d))).select("changeset_id", "sym_idx", "added", "removed", "retyped")


@query
def diff_body_lines(spark, d):
    """Distinct lines that only one of two neighbouring documents has."""
    rows = D.table(spark, d, "documents").select("doc_id", F.array_distinct(F.split("text", "\n")).alias("body"))
    a, b = rows.alias("a"), rows.alias("b")
    return a.join(b, F.col("b.doc_id") == F.col("a.doc_id") + 1).select(F.col("a.doc_id").alias("doc_id"), F.size(F.array_except("b.body", "a.body")).alias("n_new"), F.size(F.array_except("a.body", "b.body")).alias("n_old"))


@query
def sym_span_hunk(spark, d):
    return symbols.in_hunks(D.symbols(spark, d), D.lines(spark, d)).select("changeset_id", "sym_idx")


@query
def sym_span_change(spark, d):
    return symbols.span_changes(D.symbols(spark, d), D.lines(spark, d)).select("changeset_id", "sym_idx", "span_change")


@query
def ev_bug(spark, d):
    return evidence.bug_evidence(D.lines(spark, d))


@query
def ev_mechanical(spark, d):
    return evidence.mechanical(counted(spark, d), D.symbols(spark, d))


@query
def ev_dependency_only(spark, d):
    return evidence.dependency_only(D.files(spark, d))


@query
def ev_intents(spark, d):
    return evidence.intents(D.lines(spark, d))


@query
def ev_imports(spark, d):
    return evidence.imports(D.lines(spark, d))


@query
def ev_breaking(spark, d):
    return evidence.metadata_breaking(D.lines(spark, d))


@query
def ev_connections(spark, d):
    return evidence.connections(D.lines(spark, d), D.symbols(spark, d))


@query
def ev_test_correlation(spark, d):
    return evidence.tested(D.files(spark, d).withColumn("path", F.regexp_replace("path", "f[0-9]+([0-9])[.]", "f$1.")))


@query
def ev_primary_change(spark, d):
    return evidence.primary_change(counted(spark, d), D.symbols(spark, d))


@query
def infer_type(spark, d):
    return evidence.infer_type(counted(spark, d), D.lines(spark, d), D.symbols(spark, d))


@query
def infer_scope(spark, d):
    return evidence.infer_scope(D.files(spark, d))


@query
def hist_parse(spark, d):
    return history.parsed(D.subjects(spark, d)).drop("subject")


@query
def hist_types(spark, d):
    return history.types(D.subjects(spark, d))


@query
def hist_scopes_top10(spark, d):
    return history.scopes(D.subjects(spark, d))


@query
def hist_style(spark, d):
    return history.style(D.subjects(spark, d))


@query
def hist_samples(spark, d):
    return history.samples(D.subjects(spark, d))


@query
def sim_tokens(spark, d):
    return D.files(spark, d).select("file_idx", F.size(similarity.tokens(F.regexp_replace("text", "[^\\x00-\\x7f]", " "))).alias("n_tokens"))


@query
def sim_jaccard_pairs(spark, d):
    return similarity.jaccard_pairs(similarity.file_tokens(D.lines(spark, d).withColumn("raw", F.regexp_replace("raw", "[^\\x00-\\x7f]", " "))))


@query
def sim_fingerprint(spark, d):
    return similarity.fingerprints(D.lines(spark, d))


@query
def sim_shape_pairs(spark, d):
    return similarity.shape_pairs(similarity.fingerprints(D.lines(spark, d)))


@query
def grp_module(spark, d):
    return grouping.modules(D.files(spark, d))


@query
def grp_moved_symbol_edges(spark, d):
    return symbols.moved(D.symbols(spark, d))


@query
def grp_call_edges(spark, d):
    return symbols.calls(D.symbols(spark, d), D.lines(spark, d))


@query
def grp_split(spark, d):
    return grouping.split(counted(spark, d), D.lines(spark, d), D.symbols(spark, d))


@query
def bud_symbols_prefix(spark, d):
    return symbols.within_budget(D.symbols(spark, d), 2000)


@query
def bud_file_lines(spark, d):
    return budget.file_lines(D.files(spark, d))


@query
def bud_split(spark, d):
    rows = D.files(spark, d).groupBy("changeset_id").agg((F.count("*") % 2 == 0).alias("has_diffs"), (F.max("file_idx") % 3 == 0).alias("has_signatures"), (F.count("*") * 400 + F.max("file_idx") * 10).alias("used"))
    return budget.split(rows)


@query
def bud_truncate_adaptive(spark, d):
    return budget.truncate(D.files(spark, d), D.lines(spark, d), budget.file_lines(D.files(spark, d)), 18000)


@query
def msg_json_extract(spark, d):
    c = messages.extract_json(F.col("raw"))
    return D.responses(spark, d).withColumn("c", c).select("conv_id", "turn", F.col("c.type").alias("type"), F.col("c.scope").alias("scope"), F.col("c.subject").alias("subject"), F.col("c.body").alias("body"))


@query
def msg_first_line(spark, d):
    """The normalised first line of each response, and whether it is too long."""
    rows = D.responses(spark, d).withColumn("line", messages.first_line(messages.extract_json(F.col("raw"))))
    return rows.select("conv_id", "turn", "line", (F.char_length("line") > 72).alias("too_long"))


@query
def msg_clean_text(spark, d):
    text = F.concat(F.lit("Suggested commit: "), F.when(F.col("turn") % 2 == 0, "feat: ").otherwise("hello: "), F.regexp_replace("text", "[^A-Za-z ]", ""))
    return D.table(spark, d, "conversations").select("conv_id", "turn", messages.clean_text(text).alias("cleaned"))


@query
def msg_sanitize(spark, d):
    """JSON responses on even turns, plain ones on odd turns, through the whole sanitizer."""
    plain = F.concat(F.lit("Suggested commit: feat(x): "), F.regexp_replace("text", "[^A-Za-z ]", ""))
    raw = F.when(F.col("turn") % 2 == 0, F.expr(D.RESPONSE.format(g=""))).otherwise(plain)
    return D.table(spark, d, "conversations").select("conv_id", "turn", messages.sanitize(raw).alias("s")).select("conv_id", "turn", "s.message", "s.error")


@query
def msg_format_body(spark, d):
    """Whole texts as body and as breaking change."""
    commit = F.struct(F.lit("Feat").alias("type"), F.lit("a b").alias("scope"), F.lit("Add it.").alias("subject"), F.col("text").alias("body"), F.col("text").alias("breaking_change"))
    return D.table(spark, d, "conversations").select("conv_id", "turn", messages.format_commit(commit)["message"].alias("message"))


@query
def msg_template(spark, d):
    """Roles and whole texts put into a template."""
    template = F.lit("[{{role}}] {{text}} {{other}}")
    return D.table(spark, d, "conversations").select("conv_id", "turn", messages.substitute(template, {"role": F.col("role"), "text": F.col("text")}).alias("filled"))


@query
def msg_generic_subject(spark, d):
    words = F.element_at(F.array(*map(F.lit, ["Update code", "improve the parser", "change  Logic now", "update a b c code", "fix code", "update"])), (F.col("turn") + F.col("conv_id")).cast("int") % 6 + 1)
    return D.table(spark, d, "conversations").select("conv_id", "turn", messages.is_generic(words).alias("generic"))


@query
def msg_validate(spark, d):
    c = F.col("c")
    got = messages.violations(c, F.col("conv_id") % 2 == 0, F.col("turn") % 2 == 0, F.col("conv_id") % 3, F.col("conv_id") % 5 == 0)
    rows = D.responses(spark, d).withColumn("c", messages.extract_json(F.col("raw")))
    return rows.select("conv_id", "turn", F.array_join(got.cast("array<string>"), ",").alias("violations"))


@query
def msg_control_chars(spark, d):
    text = F.concat("text", F.lit("\x01\x7f\t\x0b"))
    return D.table(spark, d, "conversations").select("conv_id", "turn", F.length(messages.strip_control(text)).alias("n"))


@query
def msg_wrap72(spark, d):
    return D.table(spark, d, "conversations").select("conv_id", "turn", messages.wrap_body(F.col("text"), 72).alias("wrapped"))


@query
def eval_summary(spark, d):
    rows = D.table(spark, d, "labels").select(F.when(F.col("doc_id") % 4 == 0, "feat").when(F.col("doc_id") % 4 == 1, "fix").when(F.col("doc_id") % 4 == 2, "docs").otherwise("style").alias("expected_type"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("passed"))
    return evaluation.summary(rows)


@query
def stream_ndjson_reassembly(spark, d):
    piece = F.posexplode(F.expr("transform(sequence(0, div(greatest(length(raw) - 1, 0), 7)), i -> substring(raw, int(i * 7 + 1), 7))")).alias("seq", "piece")
    rows = D.responses(spark, d).select(F.concat_ws("-", "conv_id", "turn").alias("request_id"), piece)
    lines = rows.select("request_id", "seq", F.concat(F.to_json(F.struct(F.col("piece").alias("response"), F.lit(False).alias("done"))), F.lit("\n")).alias("chunk"))
    return tokens.reassemble(lines)

import random
from types import SimpleNamespace

import json

from pyspark.sql import functions as F

from changelens.functions import messages, paths, secrets
from changelens.operators import budget, diffs, evidence, grouping, history, similarity, symbols
from changelens.sources import fixtures, patches
from changelens.streaming.tokens import Reader, reassemble

PATCH = """diff --git a/src/a.rs b/src/a.rs
--- a/src/a.rs
+++ b/src/a.rs
@@ -10,2 +10,3 @@
 keep
+password = "abcdefgh12"
-gone
diff --git a/x.bin b/x.bin
Binary files differ
diff --git a/old.py b/old.py
--- a/old.py
+++ /dev/null
@@ -1 +0,0 @@
-x
"""


def test_categories(spark):
    cases = {"src/a.rs": "Source", "tests/x.rs": "Test", "a/tests/x.rs": "Test", "a.test.ts": "Test", "docs/a.rs": "Docs", "README.md": "Docs", ".github/w.yml": "Build", ".gitlab-ci.yml": "Config", "Dockerfile": "Build", "Cargo.toml": "Config", "notes": "Other"}
    rows = spark.createDataFrame(list(cases.items()), "path string, want string").select("path", "want", paths.file_category(F.col("path")).alias("got")).collect()
    assert [r for r in rows if r.want != r.got] == []


def test_scope_and_module(spark):
    rows = spark.createDataFrame([("src/api/x.rs", "x.rs"), ("packages/web/src/main.ts", ""), ("a.rs", "")], "path string, o string").select(paths.scope(F.col("path")).alias("s"), paths.module(F.col("path")).alias("m")).collect()
    assert [(r.s, r.m) for r in rows] == [("api", "x"), ("web", "main"), (None, "a")]


def test_split_patch_and_line_numbers(spark):
    lines = patches.split_patch(spark.createDataFrame([("c", PATCH)], "changeset_id string, patch string"))
    assert {r.path for r in lines.select("path").distinct().collect()} == {"src/a.rs", "old.py"}
    rows = lines.withColumn("file_idx", F.lit(0)).where("path = 'src/a.rs'")
    found = diffs.secrets_in_diff(rows).collect()
    assert [(r.pattern, r.new_line) for r in found] == [("Generic Secret", 11)]


def test_patch_mode_and_fixtures(spark, tmp_path):
    d = tmp_path / "one"
    d.mkdir()
    (d / "diff.patch").write_text(PATCH)
    (d / "metadata.toml").write_text('name = "one"\nexpected_type = "fix"\n[breaking]\nexpected = false\n')
    (d / "symbols.toml").write_text('[[symbols]]\nkind = "struct"\nname = "A"\nfile = "src/a.rs"\n')
    got = patches.patch_changes(patches.read_patches(spark, str(tmp_path)))
    assert {(r.path, r.status) for r in got.select("path", "status").distinct().collect()} == {("src/a.rs", "Modified"), ("x.bin", "Modified"), ("old.py", "Modified")}
    assert fixtures.metadata(spark, str(tmp_path)).first().expected_type == "fix"
    assert fixtures.symbols(spark, str(tmp_path)).first().kind == "Struct"


def test_name_status(spark):
    stream = "A\0a\0R0x9\0b\0c\0T\0t\0M\0m\0R100\0lost\0"
    got = spark.createDataFrame([(stream,)], "s string").select(F.explode(patches.name_status(F.col("s"))).alias("e")).select("e.*").collect()
    assert [tuple(r) for r in got] == [("Added", "a", None, None), ("Renamed", "c", "b", 0), ("Modified", "m", None, None)]


def test_lines_keep_blank_lines(spark):
    got = spark.createDataFrame([("a\n\n",), ("",), ("a\r\nb",)], "t string").select(diffs.split_lines(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == [["a", ""], [], ["a", "b"]]


def test_conventional_subjects(spark):
    rows = [("feat(api)!: add x",), ("fix(): y",), ("Update z",), ("CHORE: w",)]
    got = spark.createDataFrame(rows, "s string").select(messages.parse_conventional(F.col("s")).alias("c")).collect()
    assert [tuple(r.c) if r.c else None for r in got] == [("feat", "api", "add x"), None, None, ("chore", None, "w")]


def test_messages(spark):
    raw = '<think>{"type"}</think>```json\n{"type":"Feat","scope":"A b","subject":"Add it.","body":null}\n```'
    row = spark.createDataFrame([(raw,)], "raw string").select(messages.first_line(messages.extract_json(F.col("raw"))).alias("line"), messages.wrap_body(F.lit("aa  bb cc\n\ndddddd"), 5).alias("w")).first()
    assert (row.line, row.w) == ("feat(a-b): add it", "aa bb\ncc\n\ndddddd")


def test_messages_of_whole_texts(spark):
    """The registered queries see cut texts; here the limit of 72 is met on whole ones."""
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", F.regexp_replace("text", "[^A-Za-z ]", "").alias("t")).where("trim(t) <> ''")
    c = messages.extract_json(F.concat(F.lit('{"type":"Feat","scope":"a b","subject":"'), "t", F.lit('.","body":null}')))
    none = F.lit(False)
    broken = messages.violations(c, none, none, F.lit(0), none)
    got = rows.select("t", messages.first_line(c).alias("line"), F.array_contains(broken, 7).alias("long"), messages.clean_text(F.concat(F.lit("feat: "), "t")).alias("cleaned")).collect()
    assert sum(len(r.t) > 200 for r in got) > 10 and {r.long for r in got} == {True, False}
    for r in got:
        t = r.t.lstrip(" ")
        assert r.line == f"feat(a-b): {t[0].lower()}{t[1:]}" and r.long == (len("feat") + len("a b") + 4 + len(t) > 72)
        assert r.cleaned == f"feat: {r.t[0].lower()}{r.t[1:]}".rstrip(" ")


def test_evidence_of_whole_inputs(spark):
    """The queries' changesets all have symbols and source files; here some have none."""
    counted = spark.createDataFrame([("bare", 0, "a.rs", 5, 4), ("hot", 0, "b.rs", 5, 4), ("src99", 0, "c.rs", 5, 4), ("src99", 1, "d.rs", 9, 0)], "changeset_id string, file_idx long, path string, additions long, deletions long")
    symbols = spark.createDataFrame([("hot", 7, "Struct", "old", True, False), ("hot", 9, "Function", "fresh", True, True), ("hot", 8, "Function", "own", False, True), ("src99", 3, "Trait", "gone", True, False)], "changeset_id string, sym_idx long, kind string, name string, is_public boolean, is_added boolean")
    assert {r.changeset_id: r.is_mechanical for r in evidence.mechanical(counted, symbols).collect()} == {"bare": True, "hot": False, "src99": False}
    assert {r.changeset_id: r.primary_change for r in evidence.primary_change(counted, symbols).collect()} == {"bare": "most changes in a (+5 -4)", "hot": "added Function fresh (public)", "src99": "removed Trait gone (public)"}
    files = spark.createDataFrame([("m", "Cargo.toml"), ("m", ".gitlab-ci.yml"), ("n", "Cargo.toml"), ("n", "src/a.rs")], "changeset_id string, path string")
    assert {r.changeset_id: r.is_dependency_only for r in evidence.dependency_only(files).collect()} == {"m": True, "n": False}


def test_custom_patterns(spark):
    names = [n for n, _ in secrets.patterns(["[bad", "ok+"], ["jwt token"])]
    assert names[-1] == "Custom Pattern 2" and "JWT Token" not in names and len(names) == 24


def test_globs():
    import re

    regex = paths.glob_to_regex("**/*.{yml,lock}")
    assert re.match(regex, "a/b.yml") and re.match(regex, "x.lock") and not re.match(regex, "a.rs")


def test_merge_compat_loses_pairs():
    class File:
        def __init__(self, path):
            self.path = path

    groups = [[File(c)] for c in "abcd"]
    assert len(grouping.merged(groups, [("a", "d"), ("b", "c")])) == 3
    assert len(grouping.merged(groups, [("a", "b"), ("b", "c")], connected=True)) == 2


def test_moved_symbols_go_out_as_they_arise(spark):
    """Repeated symbols make no repeated pairs, and no pair is moved to be made distinct."""
    rows = [("c", "Fn", "f", "a", False), ("c", "Fn", "f", "a", False), ("c", "Fn", "f", "b", True), ("c", "Fn", "f", "b", True), ("c", "Fn", "f", "a", True), ("c", "Fn", "g", "b", True), ("d", "Fn", "f", "e", True), (None, "Fn", "f", "e", True), (None, "Fn", "f", "a", False)]
    got = symbols.moved(spark.createDataFrame(rows, "changeset_id string, kind string, name string, file string, is_added boolean"))
    assert [tuple(r) for r in got.collect()] == [("c", "Fn", "f", "a", "b")]
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_stream_is_the_same_for_every_cut(spark):
    body = "".join(json.dumps({"response": c, "done": False}) + "\n" for c in "héy") + "no json\n" + json.dumps({"response": "", "done": True}) + "\n"
    for cut in range(len(body)):
        reader = Reader("ndjson")
        reader.feed(body[:cut])
        reader.feed(body[cut:], True)
        assert reader.text == "héy" and reader.done
    rows = [("r", i, body[i : i + 5]) for i in range(0, len(body), 5)]
    assert reassemble(spark.createDataFrame(rows, "request_id string, seq long, chunk string")).first().text == "héy"


def numbered_lines(spark, files):
    """files: (changeset_id, file_idx, path, lines)."""
    rows = [(c, i, p, k, raw) for c, i, p, body in files for k, raw in enumerate(body)]
    return spark.createDataFrame(rows, "changeset_id string, file_idx long, path string, line_no long, raw string")


def test_budget_truncation(spark):
    """A line that does not fit ends its file; a header that does not fit ends the list; lock files cost a placeholder."""
    lines = numbered_lines(spark, [("c", 0, "src/a.rs", ["x" * 500]), ("c", 1, "src/b.rs", ["short", "é" * 30]), ("d", 0, "src/a.rs", ["y" * 90]), ("d", 1, "src/" + "n" * 90 + ".rs", ["z"]), ("d", 2, "src/c.rs", ["z"])])
    lines = lines.unionByName(numbered_lines(spark, [("e", 0, "Cargo.lock", ["a"]), ("e", 1, "src/a.png", ["a"]), ("e", 2, "src/a.rs", ["a", "b", "c"])]))
    files = lines.select("changeset_id", "file_idx", "path").distinct()
    limits = files.select("changeset_id", "file_idx", F.lit(2).cast("long").alias("max_lines"))
    got = {(r.changeset_id, r.file_idx): (r.listed, r.shown, r.total) for r in budget.truncate(files, lines, limits, 200).collect()}
    assert got == {("c", 0): (True, 0, 1), ("c", 1): (True, 2, 2), ("d", 0): (True, 1, 1), ("d", 1): (False, 0, 1), ("d", 2): (False, 0, 1), ("e", 0): (True, 0, 1), ("e", 2): (True, 2, 3)}


def test_budget_split_has_a_floor(spark):
    rows = spark.createDataFrame([(True, False, 0), (False, True, 19000), (False, False, 30000)], "has_diffs boolean, has_signatures boolean, used long")
    got = [(r.symbol_budget, r.diff_budget) for r in budget.split(rows).orderBy("used").collect()]
    assert got == [(4400, 17600), (0, 4000), (0, 4000)]


def brute_wrap(text, width):
    out = []
    for paragraph in text.split("\n"):
        lines = [""]
        for k, word in enumerate(paragraph.split()):
            if k and len(lines[-1]) + 1 + len(word) > width:
                lines.append(word)
            else:
                lines[-1] += (" " if k else "") + word
        out.append("\n".join(lines))
    return "\n".join(out)


def test_sanitize(spark):
    """One response a row: JSON and plain paths, trailers, limits and errors."""
    long = "word " * 30
    cases = [
        ('<think>{"type": 1}</think> {"type":"Feat","scope":"a  b","subject":"Add it..","body":" two  words ","breaking_change":"gone"} bye', "feat(a-b)!: add it\n\ntwo words\n\nBREAKING CHANGE: gone", None),
        ('{"type":"fix","scope":" x","subject":"Cut\\u0007 it","body":null,"breaking_change":" NULL "}', "fix: cut it", None),
        ('{"type":"fix","subject":"x","breaking_change":"' + long + '"}', "fix!: x\n\nBREAKING CHANGE: " + brute_wrap(long, 55).replace("\n", "\n  "), None),
        ('{"type":"yolo","subject":"x"}', None, "Invalid commit type: 'yolo'. Must be one of: feat, fix, refactor, docs, test, chore, style, perf, build, ci, revert"),
        ('{"type":"fix","subject":"' + "y" * 80 + '"}', None, "First line is 85 chars (max 72): 'fix: " + "y" * 80 + "'"),
        ("Here is the commit message: fix(a): Mend it\nbody", "fix(a): mend it\nbody", None),
        ("nothing of the kind at all", None, "Message doesn't start with a valid type. Got: 'nothing of the kind '"),
        ("feat: " + "z" * 70, None, "First line is 76 chars (max 72): 'feat: " + "z" * 70 + "'"),
        (None, None, "Message doesn't start with a valid type. Got: ''"),
        ("", None, "Message doesn't start with a valid type. Got: ''"),
        ("{" * 20000 + "x" * 200000, None, "Message doesn't start with a valid type. Got: '" + "{" * 20 + "'"),
    ]
    rows = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, raw string")
    got = {r.k: (r.s.message, r.s.error) for r in rows.select("k", messages.sanitize(F.col("raw")).alias("s")).collect()}
    assert [got[k] for k in range(len(cases))] == [c[1:] for c in cases]
    bare = rows.where("k = 0").select(messages.sanitize(F.col("raw"), scoped=False, with_body=False, lowered=False)["message"]).first()[0]
    assert bare == "feat!: Add it\n\nBREAKING CHANGE: gone"


def test_wrap_against_brute_force(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abé  \n\t") * rng.choice([1, 1, 2, 9]) for _ in range(rng.randrange(60))) for _ in range(200)] + ["", "x" * 90, None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", messages.wrap_body(F.col("t"), 12).alias("w")).collect()
    assert [(r.t, r.w) for r in got if r.w != (None if r.t is None else brute_wrap(r.t, 12))] == []


def test_fingerprints_and_shapes(spark):
    lines = numbered_lines(spark, [("c", 0, "a", ["@@ x", "+a", "+ b", "+", "-a ", "-b", "- "]), ("c", 1, "b", ["+a", "-b"]), ("c", 2, "c", ["+q", "-r"]), ("c", 3, "d", [" same"])])
    got = {r.file_idx: (r.added, r.removed, r.hunks, r.balance, r.indent_ratio) for r in similarity.fingerprints(lines).collect()}
    assert got == {0: (3, 3, 1, 1.0, 1.0), 1: (1, 1, 0, 1.0, 0.0), 2: (1, 1, 0, 1.0, 0.0), 3: (0, 0, 0, 1.0, 0.0)}
    assert [(r.file_a, r.file_b) for r in similarity.shape_pairs(similarity.fingerprints(lines)).collect()] == [(1, 2)]


def test_word_pairs_against_brute_force(spark, monkeypatch):
    """Blocks of few files and words, and no pair is moved."""
    for name, value in {"BLOCK_FILES": 3, "BLOCK_WORDS": 40, "MEETINGS": 5, "COLUMNS": 2, "OFTEN": 0.2}.items():
        monkeypatch.setattr(similarity, name, value)
    rng = random.Random(3)
    rows = [(rng.choice("ab"), k, sorted({f"w{min(rng.randrange(40), rng.randrange(40))}" for _ in range(rng.choice([1, 4, 12, 30]))})) for k in range(60)] + [("a", 60, []), (None, 61, ["w1"]), (None, 62, ["w1"])]
    share = lambda x, y: len({*x} & {*y}) / len({*x} | {*y})
    brute = {(c, i, j, round(share(x, y), 6)) for c, i, x in rows for d, j, y in rows if c and c == d and i < j and x and y and share(x, y) > 0.4}
    got = similarity.jaccard_pairs(spark.createDataFrame(rows, "changeset_id string, file_idx long, tokens array<string>"))
    told = [tuple(r) for r in got.collect()]
    assert len(brute) > 20 and len(told) == len(brute) and set(told) == brute
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_conflict_markers(spark):
    body = {"a": ("README.md", "+======= x"), "b": ("src/a.rs", "+  <<<<<<< HEAD"), "c": ("src/a.rs", " >>>>>>> x"), "d": ("src/contest/a.rs", "+<<<<<<< x"), "e": ("docs/a.md", "+>>>>>>> x"), "f": ("documentation/a.md", "+x >>>>>>> y")}
    got = {r.changeset_id: r.has_conflicts for r in diffs.conflicts(numbered_lines(spark, [(c, 0, p, [raw]) for c, (p, raw) in body.items()])).collect()}
    assert got == {"a": False, "b": True, "c": False, "d": False, "e": False, "f": True}


def test_scope_and_style(spark):
    files = spark.createDataFrame([("a", "src/api/a.rs"), ("a", "main.rs"), ("b", "src/api/a.rs"), ("b", "src/db/a.rs"), ("c", "README.md")], "changeset_id string, path string")
    assert {r.changeset_id: r.scope for r in evidence.infer_scope(files).collect()} == {"a": "api", "b": None, "c": None}
    subjects = [("r", 0, "feat: add x")] + [("r", k, "Update y") for k in range(1, 5)] + [("s", k, "tidy z") for k in range(4)] + [("s", 4, "Fix")]
    got = {r.repo: (r.lower_case, r.conventional_ratio) for r in history.style(spark.createDataFrame(subjects, "repo string, pos long, subject string")).collect()}
    assert got == {"r": (False, 0.2), "s": (True, 0.0)}


def test_signals_of_lines(spark):
    lines = numbered_lines(spark, [("c", 0, "src/a.rs", ["+    import os", "-pub use a;", "-pub use b;", "-pub use b;", "+useful"]), ("c", 1, "Cargo.toml", ['+rust-version = "1.9"', "-[features]", "-x = [features]"])])
    assert [r.import_change for r in evidence.imports(lines).collect()] == ["a: added import os"]
    got = [r.signal for r in evidence.metadata_breaking(lines).orderBy("file_idx", "line_no").collect()]
    assert got == ["Removed public re-export: pub use a;", "Removed public re-export: pub use b;", 'MSRV changed in Cargo.toml: rust-version = "1.9"', "Cargo.toml [features] section modified"]


def test_parameters_with_generics(spark):
    rows = [("fn f(a: Map<K, V>, b: u8)", "fn f(a: Map<K, W>, c: (u8, u8), d)")]
    r = symbols.parameter_changes(spark.createDataFrame(rows, "old_signature string, new_signature string")).first()
    assert (r.added, r.removed, r.retyped) == ("c: (u8, u8),d", "b: u8", "a")


def test_support_files_and_tests():
    def file(path, category, size=10, module="m"):
        stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        return SimpleNamespace(path=path, category=category, additions=size, deletions=0, stem=stem, module=module, words={path}, balance=0.0, indent_ratio=0.0, hunks=1)

    rows = [file("src/a.rs", "Source", 10), file("src/b.rs", "Source", 90), file("tests/a.rs", "Test"), file("tests/b_test.rs", "Test"), file("docs/guide.md", "Docs"), file("docs/a.md", "Docs"), file("Cargo.toml", "Config"), file("Cargo.lock", "Config")]
    got = [[f.path for f in g] for g in grouping.fold(rows, [])]
    assert got == [["src/a.rs", "tests/a.rs", "docs/a.md"], ["src/b.rs", "tests/b_test.rs"], ["docs/guide.md"], ["Cargo.toml", "Cargo.lock"]]


def test_fold_looks_files_up():
    """The paths and words of a file are read a few times, however many files there are."""
    reads = []

    class File(SimpleNamespace):
        def __getattribute__(self, name):
            reads.append(name)
            return object.__getattribute__(self, name)

    kinds = {"Source": "src", "Test": "tests", "Docs": "docs", "Config": "conf"}
    rows = [File(path=f"{kinds[c]}/f{k}.x", category=c, additions=k + 1, deletions=0, stem=f"f{k}", module="m", words={f"w{k}", "w"}, balance=0.0, indent_ratio=0.0, hunks=1) for c in kinds for k in range(150)]
    groups = grouping.fold(rows, [], meets=[([f.path for f in rows], [rows[3].path])])
    read, every = len(reads), [f.path for g in groups for f in g]
    assert sorted(every) == sorted(f.path for f in rows)
    assert read < 40 * len(rows)


def test_edges_by_symbol_join_as_their_pairs_do():
    rng = random.Random(4)
    for _ in range(200):
        groups = [[SimpleNamespace(path=f"{i}.{k}") for k in range(rng.randrange(1, 4))] for i in range(rng.randrange(1, 9))]
        paths_ = [f.path for g in groups for f in g]
        pick = lambda: rng.sample(paths_, rng.randrange(min(4, len(paths_)) + 1))
        meets = [(pick(), pick()) for _ in range(3)]
        edges = [(a, b) for x, y in meets for a in x for b in y if a != b]
        for connected in (False, True):
            names = lambda out: [[f.path for f in g] for g in out]
            assert names(grouping.merged(groups, edges, connected)) == names(grouping.merged(groups, [], connected, meets))


def test_edges_of_groups_move_by_their_ends(spark):
    """As many rows as files, where the pairs of moved and called symbols are the square of that."""
    rows = [("c", "Fn", "f", f"src/{k}.rs", k % 2 == 0) for k in range(40)]
    changed = spark.createDataFrame(rows, "changeset_id string, kind string, name string, file string, is_added boolean")
    lines = numbered_lines(spark, [("c", k, f"src/{k}.rs", ["+f(g(x))"]) for k in range(40)])
    assert symbols.moved(changed).count() == 400 and symbols.moved_sides(changed).count() == 40
    assert symbols.calls(changed, lines).count() == 20 * 39 and symbols.called(changed, lines).count() == 60


def test_entry_points_have_names():
    import __spark_entry__ as entry

    assert {"infer_type", "grp_split", "stream_ndjson_reassembly"} <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""DuckDB SQL of the queries: written from the semantics, on the same derived inputs."""

from __future__ import annotations

from ..functions import values as V
from .derived import CTE


def _in(names) -> str:
    return "(" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + ")"


def _has(column: str, markers) -> str:
    return "(" + " or ".join(f"contains({column}, '" + m.replace("'", "''") + "')" for m in markers) + ")"


NAME = "regexp_extract({p}, '([^/]*)/*$', 1)"
UP = "regexp_extract({p}, '([^/]+)/[^/]*$', 1)"


def name(p="path"):
    return NAME.format(p=p)


def up(p="path"):
    return UP.format(p=p)


def ext(p="path"):
    return f"regexp_extract({name(p)}, '^.+\\.([^.]*)$', 1)"


def stem(p="path"):
    return f"case when regexp_matches({name(p)}, '^.+\\.[^.]*$') then regexp_extract({name(p)}, '^(.+)\\.[^.]*$', 1) else {name(p)} end"


def category(p="path"):
    first = f"split_part({p}, '/', 1)"
    return f"""case when {_has(name(p), ['_test.', '.test.', '_spec.'])} or {first} = 'tests' or {_has(p, ['/tests/', '/test/'])} then 'Test'
      when {first} = 'docs' or contains({p}, '/docs/') or {ext(p)} in ('md', 'rst', 'txt') then 'Docs'
      when {first} in ('.github', '.gitlab-ci', '.circleci') or {_has(p, ['/.github/', '/.circleci/'])} or {name(p)} in {_in(V.BUILD_NAMES)} or {ext(p)} in ('dockerfile', 'containerfile') then 'Build'
      when {name(p)} in {_in(V.CONFIG_NAMES)} or ({name(p)} like '.%' and {ext(p)} in ('json', 'yaml', 'yml', 'toml', 'ini', 'cfg')) then 'Config'
      when {ext(p)} in {_in(V.SOURCE_EXTENSIONS)} then 'Source' else 'Other' end"""


PLUS, MINUS = "(raw like '+%' and raw not like '+++%')", "(raw like '-%' and raw not like '---%')"
BODY = "substr(raw, 2)"
HEAD = r"regexp_matches(raw, '^@@ -(\d+)(,(\d+))? \+(\d+)(,(\d+))? @@')"


def head(k):
    return rf"regexp_extract(raw, '^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@', {k})"


COUNTED = f"""{CTE}, n as (select changeset_id, file_idx, count(*) filter ({PLUS}) as additions, count(*) filter ({MINUS}) as deletions from lines group by all),
counted as (select f.changeset_id, f.file_idx, f.path, f.status, coalesce(n.additions, 0) as additions, coalesce(n.deletions, 0) as deletions from files f left join n using (changeset_id, file_idx))
"""
STAT = "count(*) as files_changed, sum(additions)::bigint as insertions, sum(deletions)::bigint as deletions"
SECRET = "coalesce(" + ", ".join(f"case when regexp_matches({{c}}, '{r.replace(chr(39), chr(39) * 2)}') then '{n}' end" for n, r in V.SECRETS) + ")"
NUMBERED = f"""{CTE}, h as (select *, sum(case when {HEAD} then 1 else 0 end) over (partition by changeset_id, file_idx order by line_no) as hunk_seq from lines),
s as (select *, first_value({head(1)}) over w as o, first_value({head(3)}) over w as n,
  coalesce(sum(case when {HEAD} then 0 when raw like '-%' or {{both}} then 1 else 0 end) over (w rows between unbounded preceding and 1 preceding), 0) as so,
  coalesce(sum(case when {HEAD} then 0 when raw like '+%' or {{both}} then 1 else 0 end) over (w rows between unbounded preceding and 1 preceding), 0) as sn
  from h where hunk_seq > 0 window w as (partition by changeset_id, file_idx, hunk_seq order by line_no)),
numbered as (select *, (o::bigint + so)::bigint as old_line, (n::bigint + sn)::bigint as new_line from s where not {HEAD})
"""
SPACED = NUMBERED.replace("{both}", "raw like ' %'")
PRINTS = f"""{CTE}, shape as (select changeset_id, file_idx, count(*) filter ({PLUS}) as added, count(*) filter ({MINUS}) as removed, count(*) filter (raw like '@@%') as hunks from lines group by all),
t as (select changeset_id, file_idx, {BODY} as body, trim({BODY}) as bare, {PLUS} as plus, {MINUS} as minus from lines where {PLUS} or {MINUS}),
ind as (select changeset_id, file_idx, count(*) as indented from t where plus and exists (select 1 from t g where g.minus and g.changeset_id = t.changeset_id and g.file_idx = t.file_idx and g.bare = t.bare and g.body <> t.body) group by all),
prints as (select changeset_id, file_idx, added, removed, hunks, case when added + removed = 0 then 1.0::double else least(added, removed) / greatest(added, removed) end as balance, case when added = 0 then 0.0::double else coalesce(indented, 0) / added end as indent_ratio from shape left join ind using (changeset_id, file_idx))
"""
SIDES = f"""{CTE}, new as (select * from symbols where is_added), old as (select * from symbols where not is_added)
"""
MATCH = "o.changeset_id = n.changeset_id and o.kind = n.kind and o.name = n.name and o.file = n.file"
FIRST_OLD = "(select {c} from old o where " + MATCH + " order by o.sym_idx limit 1)"
PARSED = rf"""{CTE}, p as (select *, regexp_replace(trim(split_part(subject, ':', 1)), '!$', '') as prefix, trim(regexp_extract(subject, '^[^:]*:(.*)$', 1)) as txt from subjects where subject <> ''),
q as (select *, lower(trim(split_part(prefix, '(', 1))) as k, case when contains(prefix, '(') then trim(regexp_extract(prefix, '\(([^)]*)\)', 1)) end as sc from p),
parsed as (select repo, pos, subject, case when good then k end as type, case when good then sc end as scope, case when good then txt end as text
  from (select *, contains(subject, ':') and k in {_in(V.COMMIT_TYPES)} and (sc is null or sc <> '') and txt <> '' as good from q))
"""
BUG = f"({PLUS} and {_has('lower(raw)', V.BUG_MARKERS)})"
CALLS = f"""{SIDES}, tok as (select distinct changeset_id, file_idx, path, unnest(regexp_extract_all(raw, '([A-Za-z0-9_]+)\\(', 1)) as t from lines where {PLUS})
"""
JSON = r"""{cte}, j as (select conv_id, turn, regexp_extract(regexp_replace(raw, '<think>.*?</think>', '', 'gs'), '(\{{.*\}})', 1, 's') as j from responses),
c as (select conv_id, turn, j ->> '$.type' as type, j ->> '$.scope' as scope, j ->> '$.subject' as subject, j ->> '$.body' as body from j)
""".format(cte=CTE)

IMPORT = r"regexp_matches(substr(raw, 2), '^\s*(use |import |from |require\(|#include)')"
TEXT = f"trim({BODY})"
SYMBOL_TEXT = "concat(case when is_added then '[+] ' else '[-] ' end, signature, ' (', file, ':', line, ')')"

SQL = {
    "src_patch_split": f"{CTE} select changeset_id, path, 3 + count(*) as n_lines from (select l.*, max(file_idx) over (partition by changeset_id, path) as last from lines l) where file_idx = last group by all",
    "src_name_status": f"{CTE} select changeset_id, cast(row_number() over (partition by changeset_id order by file_idx) - 1 as int) as pos, status, path, case when status = 'Renamed' then concat('old/', path) end as old_path, case when status = 'Renamed' then cast(file_idx % 101 as int) end as similarity from files",
    "prj_file_category": f"{CTE} select file_idx, {category()} as category, cast(list_position({V.CATEGORIES}, {category()}) - 1 as int) as priority, {ext()} in {_in(V.BINARY_EXTENSIONS)} as is_binary, {name()} in {_in(V.LOCK_FILES)} as skips from files",
    "prj_page_category": f"with p as (select page_id, regexp_extract(url, '^[^:]+://[^/]*/([^?#]*)', 1) as path from pages) select page_id, {category()} as category, {ext()} as extension, {stem()} as stem from p",
    "prj_scope_from_path": f"{CTE} select file_idx, case when split_part(path, '/', 1) = 'src' then split_part(path, '/', 2) else {up()} end as scope from files",
    "prj_module": f"{CTE} select file_idx, case when {up()} in {_in(V.GENERIC_DIRECTORIES)} then {stem()} else {up()} end as module, {stem()} as stem, {up()} as parent from files",
    "prj_language": f"{CTE} select file_idx, case {ext()} when 'rs' then 'rust' when 'py' then 'python' end as language from files",
    "agg_file_counts": f"{COUNTED} select changeset_id, file_idx, additions, deletions from counted",
    "agg_diffstat": f"{COUNTED} select changeset_id, {STAT} from counted group by all",
    "agg_status_counts": f"{CTE} select changeset_id, " + ", ".join(f"count(*) filter (status = '{s}') as n_{s.lower()}" for s in ("Added", "Modified", "Deleted", "Renamed")) + " from files group by all",
    "prj_summary": f"""{COUNTED} select changeset_id, concat(count(*), ' files (', count(*) filter (status = 'Added'), ' added, ', count(*) filter (status = 'Modified'), ' modified, ', count(*) filter (status = 'Deleted'), ' deleted',
      case when count(*) filter (status = 'Renamed') > 0 then concat(', ', count(*) filter (status = 'Renamed'), ' renamed') else '' end, ') | +', sum(additions), ' -', sum(deletions)) as summary from counted group by changeset_id""",
    "flt_exclude_glob": f"{COUNTED} select changeset_id, {STAT} from counted where path not like '%.yml' and path not like 'docs/%' group by all",
    "flt_subset": f"{COUNTED} select changeset_id, {STAT} from counted c where exists (select 1 from files f where f.file_idx % 3 = 0 and f.changeset_id = c.changeset_id and f.path = c.path) group by all",
    "set_staged_unstaged": f"{CTE} select changeset_id, path from files where status <> 'Added' intersect select changeset_id, path from files where file_idx % 2 = 0",
    "fn_hunk_header": f"{CTE} select changeset_id, file_idx, line_no, {head(1)}::bigint as old_start, coalesce(nullif({head(2)}, '')::bigint, 1) as old_count, {head(3)}::bigint as new_start, coalesce(nullif({head(4)}, '')::bigint, 1) as new_count from lines where {HEAD}",
    "win_line_numbers": f"{SPACED} select changeset_id, file_idx, line_no, old_line, new_line from numbered where {PLUS}",
    "safety_secret_scan": f"{SPACED} select * from (select changeset_id, path, line_no, new_line, {SECRET.replace('{c}', BODY)} as pattern from numbered where {PLUS}) where pattern is not null",
    "safety_first_pattern": f"with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents) select * from (select doc_id, pos, {SECRET.replace('{c}', 'line')} as pattern from l) where pattern is not null",
    "safety_conflicts": f"""{CTE}, planted as (select * replace (case when line_no % 17 = 3 then '+======= x' when line_no % 23 = 5 then '+  <<<<<<< x' else raw end as raw) from lines)
      select changeset_id, bool_or({PLUS} and (contains(raw, repeat('<', 7)) or contains(raw, repeat('>', 7))) and path not like '%test%' and not regexp_matches(path, '(^|/)(docs|examples)(/|$)')) as has_conflicts from planted group by all""",
    "sym_added": f"{SIDES} select changeset_id, sym_idx, kind, name, file from new n where not exists (select 1 from old o where {MATCH})",
    "sym_removed": f"{SIDES} select changeset_id, sym_idx, kind, name, file from old o where not exists (select 1 from new n where {MATCH})",
    "sym_modified": f"{SIDES} select changeset_id, sym_idx, kind, name, file from new n where exists (select 1 from old o where {MATCH})",
    "sym_signature_change": f"{SIDES} select * from (select changeset_id, sym_idx, {FIRST_OLD.format(c='o.signature')} as old_signature, signature as new_signature from new n) where old_signature <> new_signature",
    "diff_fields": f"{SIDES} select changeset_id, sym_idx, case when contains(s, 'b:') and not contains(os, 'b:') then 'b: u8' else '' end as added, case when contains(os, 'b:') and not contains(s, 'b:') then 'b: u8' else '' end as removed, case when contains(s, 'Map') <> contains(os, 'Map') then 'a' else '' end as retyped from (select changeset_id, sym_idx, signature as s, {FIRST_OLD.format(c='o.signature')} as os from new n) where os <> s",
    "diff_body_lines": "with d as (select doc_id, list_distinct(string_split(text, chr(10))) as b from documents) select x.doc_id, len(list_filter(y.b, lambda l: not list_contains(x.b, l)))::int as n_new, len(list_filter(x.b, lambda l: not list_contains(y.b, l)))::int as n_old from d x join d y on y.doc_id = x.doc_id + 1",
    "sym_span_hunk": f"""{CTE}, h as (select changeset_id, path, {head(1)}::bigint as os, coalesce(nullif({head(2)}, '')::bigint, 1) as oc, {head(3)}::bigint as ns, coalesce(nullif({head(4)}, '')::bigint, 1) as nc from lines where {HEAD})
      select changeset_id, sym_idx from symbols s where exists (select 1 from h where h.changeset_id = s.changeset_id and h.path = s.file and case when s.is_added then s.line < ns + nc and s.end_line > ns else s.line < os + oc and s.end_line > os end)""",
    "sym_span_change": NUMBERED.replace("{both}", "(raw not like '+%' and raw not like '-%')")
    + f""", new as (select * from symbols where is_added), old as (select * from symbols where not is_added),
      spans as (select changeset_id, file, sym_idx, line, end_line, {FIRST_OLD.format(c='o.line')} as of_, {FIRST_OLD.format(c='o.end_line')} as ot from new n where exists (select 1 from old o where {MATCH})),
      j as (select s.changeset_id, s.sym_idx, l.file_idx, l.line_no, l.raw like '+%' as plus, regexp_replace(substr(l.raw, 2), '\\s', '', 'g') as body, trim(substr(l.raw, 2)) as t from spans s join numbered l on l.changeset_id = s.changeset_id and l.path = s.file and regexp_matches(l.raw, '^[+-]') and case when l.raw like '+%' then l.new_line between s.line and s.end_line else l.old_line between s.of_ and s.ot end),
      k as (select *, regexp_matches(t, '^(//|/\\*\\*|\\* |\\*/|#|\"\"\")') as doc from j),
      a as (select changeset_id, sym_idx, coalesce(string_agg(body, '' order by file_idx, line_no) filter (plus), '') as x, coalesce(string_agg(body, '' order by file_idx, line_no) filter (not plus), '') as y, bool_and(doc or t = '') as alld, bool_or(doc) as sm from k group by all)
      select changeset_id, sym_idx, case when x = y then 'WhitespaceOnly' when alld and sm then 'DocsOnly' when sm then 'Mixed' else 'Semantic' end as span_change from a""",
    "ev_bug": f"{CTE} select changeset_id, bool_or({BUG}) as has_bug_evidence from lines group by all",
    "ev_mechanical": f"{COUNTED} select changeset_id, not exists (select 1 from symbols s where s.changeset_id = g.changeset_id) and a + d between 1 and 80 and least(a, d) / greatest(a, d, 1) > 0.5 as is_mechanical from (select changeset_id, sum(additions) as a, sum(deletions) as d from counted group by all) g",
    "ev_dependency_only": f"{CTE} select changeset_id, bool_and({category()} in ('Config', 'Build')) as is_dependency_only from files group by all",
    "ev_intents": f"""{CTE}, g as (select changeset_id, count(*) filter ({PLUS}) as n, count(*) filter ({PLUS} and ({_has(TEXT, V.ERROR_MARKERS)} or {TEXT} like '%?')) as e,
      count(*) filter ({PLUS} and ({_has(TEXT, V.TEST_MARKERS)} or regexp_matches({TEXT}, '^(async )?fn test_'))) as t, count(*) filter ({PLUS} and {_has(TEXT, V.LOG_MARKERS)}) as l,
      bool_or({PLUS} and {name()} in {_in(V.MANIFESTS)} and {_has(TEXT, ['version', '"^', '"~'])}) as dep from lines group by all),
      u as (select changeset_id, 0 as o, 'ErrorHandling' as intent, least(1.0, e / n) as c from g where e > 2 union all select changeset_id, 1, 'Test', least(1.0, t / n) from g where t > 2 union all select changeset_id, 2, 'Logging', least(1.0, l / n) from g where l > 2 union all select changeset_id, 3, 'Dependency', 0.9 from g where dep)
      select changeset_id, cast(rank as int) as rank, intent, confidence from (select changeset_id, row_number() over (partition by changeset_id order by o) - 1 as rank, intent, round(c::double, 6) as confidence from u) where rank < 3""",
    "ev_imports": f"""{CTE} select * from (select changeset_id, cast(row_number() over (partition by changeset_id order by file_idx, line_no) as int) as rank, concat({stem()}, case when raw like '+%' then ': added ' else ': removed ' end, {TEXT}) as import_change from lines where regexp_matches(raw, '^[+-]') and raw not like '+++%' and raw not like '---%' and {IMPORT}) where rank <= 10""",
    "ev_breaking": f"""{CTE}, s as (select changeset_id, file_idx, line_no, case
        when {name()} = 'Cargo.toml' and {PLUS} and contains(raw, 'rust-version') then concat('MSRV changed in Cargo.toml: ', {TEXT})
        when {name()} = 'package.json' and {PLUS} and contains(raw, 'engines') and contains(raw, '"node"') then concat('Node engine requirement changed: ', {TEXT})
        when {name()} = 'pyproject.toml' and {PLUS} and contains(raw, 'requires-python') then concat('Python version requirement changed: ', {TEXT})
        when {name()} = 'Cargo.toml' and {MINUS} and {TEXT} like '[%' and contains(raw, 'features') then 'Cargo.toml [features] section modified'
        when {MINUS} and regexp_matches({TEXT}, '^pub (use|mod) ') then concat('Removed public re-export: ', {TEXT})
        when {MINUS} and regexp_matches({TEXT}, '^export (\\{{|default)') then concat('Removed JS/TS export: ', {TEXT}) end as signal from lines)
      select changeset_id, file_idx, line_no, signal from (select *, lag(signal) over (partition by changeset_id order by file_idx, line_no) as b from s where signal is not null) where signal is distinct from b""",
    "ev_connections": f"""{SIDES}, hits as (select distinct l.changeset_id, l.file_idx, n.sym_idx, concat({stem("l.path")}, ' calls ', n.name, '() — both changed') as t from lines l join new n on n.changeset_id = l.changeset_id and n.file <> l.path and contains(l.raw, concat(n.name, '(')) where {PLUS} and strlen(n.name) >= 4)
      select changeset_id, string_agg(t, '; ' order by t) as connections from (select distinct changeset_id, t from (select *, row_number() over (partition by changeset_id order by file_idx, sym_idx) as k from hits) where k <= 5) group by all""",
    "ev_test_correlation": f"""{CTE}, r as (select changeset_id, file_idx, regexp_replace(path, 'f[0-9]+([0-9])[.]', 'f\\1.') as path from files), c as (select *, {category()} as cat, {stem()} as st from r)
      select * from (select s.changeset_id, cast(row_number() over (partition by s.changeset_id order by s.file_idx, t.file_idx) as int) as rank, s.path as source_path, t.path as test_path from c s join c t on t.changeset_id = s.changeset_id and starts_with(t.st, s.st) where s.cat = 'Source' and t.cat = 'Test') where rank <= 5""",
    "ev_primary_change": f"""{COUNTED}, sy as (select * from symbols where is_public)
      select c.changeset_id, coalesce((select concat('added ', kind, ' ', name, ' (public)') from sy where sy.changeset_id = c.changeset_id and is_added order by sym_idx limit 1), (select concat('removed ', kind, ' ', name, ' (public)') from sy where sy.changeset_id = c.changeset_id and not is_added order by sym_idx limit 1), concat('most changes in ', {stem()}, ' (+', additions, ' -', deletions, ')')) as primary_change
      from (select *, row_number() over (partition by changeset_id order by additions + deletions desc, file_idx desc) as k from counted) c where k = 1""",
    "infer_type": f"""{COUNTED}, new as (select * from symbols where is_added), old as (select * from symbols where not is_added),
      b as (select changeset_id, count(*) as n, sum(additions) as ins, sum(deletions) as del, sum(case when {category()} = 'Test' then additions else 0 end) as test, count(*) filter (status = 'Added') as fresh, bool_and({category()} = 'Docs') as ad, bool_and({category()} = 'Test') as at_, bool_and({category()} = 'Config') as ac, bool_and({category()} = 'Build') as ab from counted group by all),
      g as (select changeset_id, bool_or({BUG}) as bug from lines group by all),
      nn as (select changeset_id, count(*) as k, bool_or(is_public and kind in ('Function', 'Struct', 'Trait')) as api from new n where not exists (select 1 from old o where {MATCH}) group by all),
      oo as (select changeset_id, count(*) as k, bool_or(is_public and kind in ('Function', 'Struct', 'Trait')) as api from old o where not exists (select 1 from new n where {MATCH}) group by all)
      select b.changeset_id, case when ad then 'docs' when at_ or test * 100 > ins * 80 then 'test' when ac then 'chore' when ab then 'build' when bug then 'fix' when nn.api and oo.api then 'refactor' when nn.api then 'feat' when fresh > n // 2 then 'feat' when del > 2 * ins then 'refactor'
        when ins < 20 and del < 20 and abs(ins - del) <= 5 and nn.k is null and oo.k is null then 'style' else 'refactor' end as commit_type from b left join g using (changeset_id) left join nn using (changeset_id) left join oo using (changeset_id)""",
    "infer_scope": f"{CTE}, s as (select changeset_id, case when split_part(path, '/', 1) = 'src' then split_part(path, '/', 2) else {up()} end as s from files where {category()} = 'Source') select changeset_id, (select case when count(distinct s) = 1 then min(s) end from s where s.changeset_id = f.changeset_id) as scope from (select distinct changeset_id from files) f",
    "hist_parse": f"{PARSED} select repo, pos, type, scope, text from parsed",
    "hist_types": f"{PARSED} select repo, type, n, cast(row_number() over (partition by repo order by n desc, type) as int) as rank from (select repo, type, count(*) as n from parsed where type is not null group by all)",
    "hist_scopes_top10": f"{PARSED} select * from (select repo, scope, n, cast(row_number() over (partition by repo order by n desc, scope) as int) as rank from (select repo, scope, count(*) as n from parsed where scope is not null group by all)) where rank <= 10",
    "hist_style": f"{PARSED} select repo, n, al as avg_length, 10 * low >= 8 * n as lower_case, round(good / n, 6) as conventional_ratio from (select repo, count(*) as n, sum(strlen(subject))::bigint // count(*) as al, count(type) as good, count(*) filter (regexp_matches(coalesce(text, subject), '^\\p{{Ll}}')) as low from parsed group by all) where n >= 5",
    "hist_samples": f"{PARSED} select repo, cast(rank as int) as rank, subject from (select repo, subject, row_number() over (partition by repo order by pos) as rank from parsed where type is not null) where rank <= 5",
    "sim_tokens": "select doc_id as file_idx, len(list_filter(list_distinct(regexp_split_to_array(regexp_replace(text, '[^\\x00-\\x7f]', ' ', 'g'), '[^A-Za-z0-9]+')), lambda t: strlen(t) > 2))::int as n_tokens from documents",
    "sim_jaccard_pairs": f"""{CTE}, w as (select distinct changeset_id, file_idx, t from (select changeset_id, file_idx, unnest(regexp_split_to_array(regexp_replace({BODY}, '[^\\x00-\\x7f]', ' ', 'g'), '[^A-Za-z0-9]+')) as t from lines where {PLUS} or {MINUS}) where strlen(t) > 2),
      z as (select changeset_id, file_idx, count(*) as n from w group by all), b as (select x.changeset_id, x.file_idx as fa, y.file_idx as fb, count(*) as common from w x join w y on y.changeset_id = x.changeset_id and y.t = x.t and y.file_idx > x.file_idx group by all)
      select b.changeset_id, fa as file_a, fb as file_b, round(common / (p.n + q.n - common), 6) as jaccard from b join z p on p.changeset_id = b.changeset_id and p.file_idx = fa join z q on q.changeset_id = b.changeset_id and q.file_idx = fb where common / (p.n + q.n - common) > 0.4""",
    "sim_fingerprint": f"{PRINTS} select * from prints",
    "sim_shape_pairs": f"""{PRINTS} select a.changeset_id, a.file_idx as file_a, b.file_idx as file_b from prints a join prints b on a.changeset_id = b.changeset_id and a.file_idx < b.file_idx
      where case when a.added + a.removed = 0 or b.added + b.removed = 0 then a.added + a.removed = b.added + b.removed else greatest(a.added + a.removed, b.added + b.removed) <= 3 * least(a.added + a.removed, b.added + b.removed) and abs(a.balance - b.balance) <= 0.4 and ((a.indent_ratio > 0.5 and b.indent_ratio > 0.5) or greatest(a.hunks, b.hunks) = 0 or least(a.hunks, b.hunks) / greatest(a.hunks, b.hunks, 1) > 0.3) end""",
    "grp_module": f"{CTE} select changeset_id, case when {up()} in {_in(V.GENERIC_DIRECTORIES)} then {stem()} else {up()} end as module, count(*) as n_files, min(file_idx) as first_file from files group by 1, 2",
    "grp_moved_symbol_edges": f"{SIDES} select distinct o.changeset_id, o.kind, o.name, o.file as from_file, n.file as to_file from old o join new n on n.changeset_id = o.changeset_id and n.kind = o.kind and n.name = o.name and n.file <> o.file",
    "grp_call_edges": f"{CALLS} select distinct tok.changeset_id, tok.path as caller_file, n.file as callee_file from tok join new n on n.changeset_id = tok.changeset_id and n.name = tok.t and n.file <> tok.path",
    "bud_symbols_prefix": f"""{CTE}, t as (select changeset_id, sym_idx, is_added, {SYMBOL_TEXT} as text from symbols), w as (select *, row_number() over w as k, sum(strlen(text)) over w as s from t window w as (partition by changeset_id, is_added order by sym_idx)),
      g as (select changeset_id, is_added, string_agg(text, chr(10) order by sym_idx) filter (s + greatest(k - 1, 1) <= 2000) as shown, count(*) filter (s + greatest(k - 1, 1) > 2000) as more from w group by all)
      select changeset_id, is_added, concat(coalesce(shown, ''), case when more > 0 then concat(chr(10), '... and ', more, ' more symbols') else '' end) as text from g""",
    "bud_file_lines": f"""{CTE}, n as (select *, count(*) over (partition by changeset_id) as n, {category()} as cat from files) select changeset_id, file_idx, least(greatest((case when n = 1 then 500 when n <= 3 then 250 when n <= 6 then 500 // n else greatest(30, 500 // n) end) * (case cat when 'Source' then 3 when 'Test' then 2 else 1 end) // 2, 20), 100)::bigint as max_lines from n""",
    "bud_split": f"""{CTE}, r as (select changeset_id, count(*) % 2 = 0 as has_diffs, max(file_idx) % 3 = 0 as has_signatures, (count(*) * 400 + max(file_idx) * 10)::bigint as used from files group by all),
      p as (select *, greatest(22000 - used, 0) as rest, case when has_diffs then 20 when has_signatures then 30 else 20 end as p from r), q as (select *, greatest(4000, rest - rest * p // 100) as diff from p)
      select changeset_id, has_diffs, has_signatures, used, greatest(rest - diff, 0)::bigint as symbol_budget, (greatest(rest - diff, 0) // 3)::bigint as block_budget, diff::bigint as diff_budget from q""",
    "msg_json_extract": f"{JSON} select conv_id, turn, type, scope, subject, body from c",
    "msg_first_line": rf"{JSON}, l as (select conv_id, turn, case when lower(type) in {_in(V.COMMIT_TYPES)} then concat(lower(type), '(a-b): ', lower(substr(s, 1, 1)), substr(s, 2)) end as line from (select *, regexp_replace(trim(subject), '\.+$', '') as s from c)) select conv_id, turn, line, length(line) > 72 as too_long from l",
    "msg_sanitize": rf"""{JSON}, l as (select conv_id, turn, type, concat(lower(type), '(a-b): ', lower(substr(s, 1, 1)), substr(s, 2)) as line from (select *, regexp_replace(trim(subject), '\.+$', '') as s from c) where turn % 2 = 0
      union all select conv_id, turn, 'feat', rtrim(concat('feat(x): ', lower(substr(b, 1, 1)), substr(b, 2))) from (select conv_id, turn, regexp_replace(text, '[^A-Za-z ]', '', 'g') as b from conversations where turn % 2 <> 0)),
      e as (select *, case when lower(type) not in {_in(V.COMMIT_TYPES)} then concat('Invalid commit type: ', chr(39), lower(type), chr(39), '. Must be one of: {", ".join(V.COMMIT_TYPES)}') when length(line) > 72 then concat('First line is ', length(line), ' chars (max 72): ', chr(39), line, chr(39)) end as error from l)
      select conv_id, turn, case when error is null then line end as message, error from e""",
    "msg_template": "select conv_id, turn, concat('[', coalesce(role, ''), '] ', coalesce(text, ''), ' {{other}}') as filled from conversations",
    "msg_generic_subject": "select conv_id, turn, (turn + conv_id) % 6 in (0, 2, 4) and (turn + conv_id) % 6 <> 4 as generic from conversations",
    "msg_validate": rf"""{JSON}, v as (select *, regexp_replace(trim(subject), '\.+$', '') as s from c) select conv_id, turn, array_to_string(list_filter([case when lower(type) = 'fix' and conv_id % 2 <> 0 then '1' end, case when conv_id % 3 > 0 then '2' end, case when turn % 2 = 0 and lower(type) in ('feat', 'fix') then '4' end,
      case when conv_id % 5 = 0 and lower(type) <> 'chore' then '5' end, case when length(s) + strlen(type) + strlen(scope) + 4 > 72 then '7' end], lambda x: x is not null), ',') as violations from v""",
    "msg_clean_text": "select conv_id, turn, case when turn % 2 = 0 then concat('feat: ', lower(substr(b, 1, 1)), substr(b, 2)) else concat('hello: ', lower(substr(b, 1, 1)), substr(b, 2)) end as cleaned from (select conv_id, turn, rtrim(regexp_replace(text, '[^A-Za-z ]', '', 'g')) as b from conversations)",
    "msg_control_chars": "select conv_id, turn, (length(regexp_replace(text, '[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x{9f}]', '', 'g')) + 1)::int as n from conversations",
    "eval_summary": "select expected_type, count(*) filter (passed) as n_passed, count(*) as n_total from (select case doc_id % 4 when 0 then 'feat' when 1 then 'fix' when 2 then 'docs' else 'style' end as expected_type, quality = 1 and toxic = 0 as passed from labels) group by all",
    "stream_ndjson_reassembly": f"{CTE} select concat(conv_id, '-', turn) as request_id, raw as text, null::varchar as error from responses",
}

"""Parsing, cleaning and validation of commit messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V

TYPES = "|".join(V.COMMIT_TYPES)
RAW = "type string, scope string, subject string, body string, breaking_change string"


def parse_conventional(subject: Column) -> Column:
    """Struct (type, scope, text) of `type(scope)!: text`, or null. The prefix ends at the first colon; one ! before it
    goes; a scope is what stands between the first ( and the first ); an empty one is no message."""
    prefix = F.regexp_replace(F.trim(F.substring_index(subject, ":", 1)), "!$", "")
    opened = F.instr(prefix, "(") > 0
    kind = F.lower(F.trim(F.when(opened, F.substring_index(prefix, "(", 1)).otherwise(prefix)))
    scope = F.when(opened, F.trim(F.regexp_extract(prefix, r"\(([^)]*)\)", 1)))
    text = F.trim(F.regexp_extract(subject, r"^[^:]*:([\s\S]*)$", 1))
    good = (F.instr(subject, ":") > 0) & kind.isin(*V.COMMIT_TYPES) & (scope.isNull() | (scope != "")) & (text != "")
    return F.when(good, F.struct(kind.alias("type"), scope.alias("scope"), text.alias("text")))


def is_generic(subject: Column) -> Column:
    """At most four words, the first a vague verb, a later one a vague noun."""
    words = F.filter(F.split(F.lower(subject), r"\s+"), lambda w: w != "")
    return (F.size(words) <= 4) & F.coalesce(F.get(words, F.lit(0)).isin(*V.VAGUE_VERBS), F.lit(False)) & F.arrays_overlap(F.slice(words, 2, 4), F.array(*map(F.lit, V.VAGUE_NOUNS)))


def strip_control(text: Column) -> Column:
    """Without control characters but line feed and tab."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b-\x1f\x7f-\x9f]", "")


def strip_thoughts(text: Column) -> Column:
    closed = F.regexp_replace(text, r"(?s)<(?:thought|think)>.*?</(?:thought|think)>", "")
    return F.regexp_replace(closed, r"(?i)^\s*<(?:thought|think)>\s*", "")


def extract_json(raw: Column) -> Column:
    """The struct of the JSON object in a response (type and subject required), or null. First the text from the brace
    before the first "type" to the last brace, else from the first to the last brace. Plain searches, so long texts are safe."""

    def read(text: Column, begin: Column) -> Column:
        end = F.length(text) - F.instr(F.reverse(text), "}") + 1
        got = F.from_json(F.when((begin > 0) & (end > begin), F.substring(text, begin, end - begin + 1)), RAW)
        return F.when(got["type"].isNotNull() & got["subject"].isNotNull(), got)

    def first(text: Column) -> Column:
        head = F.substring(text, F.lit(1), F.instr(text, '"type"') - 1)
        near = F.when(F.contains(head, F.lit("{")), F.length(head) - F.instr(F.reverse(head), "{") + 1)
        return F.coalesce(read(text, near), read(text, F.instr(text, "{")))

    return F.element_at(F.transform(F.array(strip_thoughts(raw)), first), 1)


def clean_text(raw: Column, lower_subject: bool = True) -> Column:
    """A plain message: without thought blocks, fences, what stands before the first type, outer quotes and preambles;
    the first letter after `: ` in lower case (unless lower_subject is off)."""
    blank = F.lit(" \n\t\r")

    def from_type(t: Column) -> Column:
        start = F.regexp_extract(t, rf"(?s)(?:^|\s)((?:{TYPES})(?:\(|!|:).*)$", 1)
        return F.trim(F.when(start != "", start).otherwise(t), blank)

    def unquoted(quote: str):
        return lambda t: F.when(t.rlike(rf"(?s)^{quote}.*{quote}$") & (F.length(t) >= 2), F.regexp_extract(t, rf"(?s)^{quote}(.*){quote}$", 1)).otherwise(t)

    def without(preamble: str):
        return lambda t: F.when(F.lower(t).contains(preamble), F.trim(F.regexp_extract(t, rf"(?is){preamble}:*(.*)$", 1), blank)).otherwise(t)

    def lowered(t: Column) -> Column:
        low = F.concat(F.regexp_extract(t, r"(?s)^(.*?: )", 1), F.lower(F.regexp_extract(t, r"(?s)^.*?: (.)", 1)), F.regexp_extract(t, r"(?s)^.*?: .(.*)$", 1))
        return F.when(t.rlike(r"(?s)^.*?: ."), low).otherwise(t)

    text = F.regexp_replace(strip_thoughts(raw), r"(?s)```.*?```", "")
    for step in (from_type, unquoted('"'), unquoted("'"), *map(without, V.PREAMBLES), *([lowered] if lower_subject else [])):
        # One element, so that each step computes the one before once.
        text = F.element_at(F.transform(F.array(text), step), 1)
    return text


def normal_scope(scope: Column) -> Column:
    """Lower case, spaces to hyphens, double hyphens to one; null where the shape is not a scope's."""
    kept = F.replace(F.replace(F.lower(scope), F.lit(" "), F.lit("-")), F.lit("--"), F.lit("-"))
    return F.when(kept.rlike(r"^[a-z0-9][a-z0-9\-_/.]*\z"), kept)


def bare(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def breaking(commit: Column) -> Column:
    """What breaks, or null where the field is blank or says "null"."""
    told = bare(commit["breaking_change"])
    return F.when(~F.lower(told).isin("", "null"), told)


def first_line(commit: Column, scoped: bool = True, lowered: bool = True) -> Column:
    """`type(scope)!: subject` of a commit struct; null for a type that is none."""
    kind = F.lower(commit["type"])
    scope = F.concat(F.lit("("), normal_scope(commit["scope"]), F.lit(")")) if scoped else F.lit(None).cast("string")
    subject = F.regexp_replace(bare(commit["subject"]), r"\.+\z", "")
    if lowered:
        subject = F.concat(F.lower(F.substring(subject, 1, 1)), F.substring(subject, 2, 1 << 30))
    bang = F.when(breaking(commit).isNotNull(), "!").otherwise("")
    return F.when(kind.isin(*V.COMMIT_TYPES), F.concat(kind, F.coalesce(scope, F.lit("")), bang, F.lit(": "), subject))


def too_long(line: Column) -> Column:
    """The error of a first line above the limit, else null."""
    n = F.char_length(line)
    text = F.concat(F.lit("First line is "), n.cast("string"), F.lit(f" chars (max {V.LINE}): '"), line, F.lit("'"))
    return F.when(n > V.LINE, text)


def footer(told: Column) -> Column:
    """The trailer of a breaking change: wrapped to fit the limit with its prefix, later lines indented by two spaces."""
    wrapped = wrap_body(bare(told), V.LINE - len(V.BREAKING))
    return F.concat(F.lit(V.BREAKING), F.replace(wrapped, F.lit("\n"), F.lit("\n  ")))


def _outcome(message: Column, error: Column) -> Column:
    return F.struct(F.when(error.isNull(), strip_control(message)).alias("message"), error.alias("error"))


def format_commit(commit: Column, scoped: bool = True, with_body: bool = True, lowered: bool = True) -> Column:
    """Struct (message, error) of a commit struct: first line, wrapped body and trailer, a blank line between them. An error
    where the type is none or the first line is too long. The trailer does not depend on with_body."""
    types = ", ".join(V.COMMIT_TYPES)
    unknown = F.concat(F.lit("Invalid commit type: '"), F.lower(commit["type"]), F.lit(f"'. Must be one of: {types}"))
    body = F.when(bare(commit["body"]) != "", wrap_body(bare(commit["body"]), V.LINE)) if with_body else F.lit(None).cast("string")

    def told(line: Column) -> Column:
        return _outcome(F.concat_ws("\n\n", line, body, footer(breaking(commit))), F.when(line.isNull(), unknown).otherwise(too_long(line)))

    return F.element_at(F.transform(F.array(first_line(commit, scoped, lowered)), told), 1)


def is_conventional(line: Column) -> Column:
    """A line that begins with a type and a colon, bracket or exclamation mark."""
    return line.rlike(rf"^(?:{TYPES})[:(!]")


def sanitize(raw: Column, scoped: bool = True, with_body: bool = True, lowered: bool = True) -> Column:
    """Struct (message, error) of a response; one of them is null. A JSON commit is formatted; any other text is cleaned and
    must begin with a type and keep the limit of the first line. A null response counts as empty."""

    def plain(text: Column) -> Column:
        line = F.regexp_replace(F.substring_index(text, "\n", 1), r"\r\z", "")
        odd = F.concat(F.lit("Message doesn't start with a valid type. Got: '"), F.substring(line, 1, 20), F.lit("'"))
        return _outcome(text, F.when(~is_conventional(line), odd).otherwise(too_long(line)))

    def either(commit: Column) -> Column:
        cleaned = F.element_at(F.transform(F.array(clean_text(given, lowered)), plain), 1)
        return F.when(commit.isNotNull(), format_commit(commit, scoped, with_body, lowered)).otherwise(cleaned)

    given = F.coalesce(raw, F.lit(""))
    return F.element_at(F.transform(F.array(extract_json(given)), either), 1)


def substitute(template: Column, values: dict[str, Column]) -> Column:
    """The template with each {{key}} replaced by its value, key by key; a null value counts as empty."""
    for key, value in values.items():
        template = F.replace(template, F.lit("{{" + key + "}}"), F.coalesce(value, F.lit("")))
    return template


def violations(commit: Column, bug: Column, mechanical: Column, removed: Column, dependency: Column) -> Column:
    """The numbers of the broken rules of a commit struct, given four kinds of evidence."""
    kind, breaking = F.lower(commit["type"]), commit["breaking_change"]
    subject = F.regexp_replace(F.trim(commit["subject"]), r"\.+$", "")
    prefix = F.octet_length(commit["type"]) + F.coalesce(F.octet_length(commit["scope"]) + 2, F.lit(0)) + F.when(breaking.isNotNull(), 1).otherwise(0) + 2
    labels = F.coalesce(F.exists(F.array(*map(F.lit, V.INTERNAL_LABELS)), lambda x: F.lower(breaking).contains(x)), F.lit(False))
    rules = [(kind == "fix") & ~bug, breaking.isNull() & (removed > 0), labels, mechanical & kind.isin("feat", "fix"), dependency & (kind != "chore"), is_generic(commit["subject"]), prefix + F.char_length(subject) > 72]
    return F.filter(F.array(*[F.when(r, i) for i, r in enumerate(rules, 1)]), lambda x: x.isNotNull())


def wrap_body(text: Column, width: int) -> Column:
    """Greedy word wrap of each paragraph; runs of white space become one space, longer words stand alone."""

    def put(so_far: Column, word: Column) -> Column:
        n = F.char_length(word)
        first, fits = so_far["n"] < 0, so_far["n"] + 1 + n <= width
        mark = F.when(first, "").when(fits, " ").otherwise("\n")
        return F.struct(F.concat(so_far["text"], mark, word).alias("text"), F.when(~first & fits, so_far["n"] + 1 + n).otherwise(n).alias("n"))

    words = lambda p: F.filter(F.split(p, r"(?U)\s+"), lambda w: w != "")
    none = F.struct(F.lit("").alias("text"), F.lit(-1).alias("n"))
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda p: F.aggregate(words(p), none, put, lambda x: x["text"])), "\n")

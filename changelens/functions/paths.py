"""Parts and classes of paths. A name that starts with its only dot has no extension."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def extension(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)


def stem(path: Column) -> Column:
    name = file_name(path)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)


def parent(path: Column) -> Column:
    """The name of the directory that holds the file, or an empty text."""
    return F.regexp_extract(path, r"([^/]+)/[^/]*$", 1)


def any_contains(text: Column, markers: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(m) for m in markers])


def file_category(path: Column) -> Column:
    """Test, Docs, Build, Config, Source or Other, by the first rule that fits."""
    name, ext, first = file_name(path), extension(path), F.regexp_extract(path, r"^([^/]*)", 1)
    return (
        F.when(any_contains(name, ["_test.", ".test.", "_spec."]) | (first == "tests") | any_contains(path, ["/tests/", "/test/"]), "Test")
        .when((first == "docs") | path.contains("/docs/") | ext.isin("md", "rst", "txt"), "Docs")
        .when(first.isin(".github", ".gitlab-ci", ".circleci") | any_contains(path, ["/.github/", "/.circleci/"]) | name.isin(*V.BUILD_NAMES) | ext.isin("dockerfile", "containerfile"), "Build")
        .when(name.isin(*V.CONFIG_NAMES) | (name.startswith(".") & ext.isin("json", "yaml", "yml", "toml", "ini", "cfg")), "Config")
        .when(ext.isin(*V.SOURCE_EXTENSIONS), "Source")
        .otherwise("Other")
    )


def priority(category: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, V.CATEGORIES)), category) - 1


def is_binary(path: Column) -> Column:
    return extension(path).isin(*V.BINARY_EXTENSIONS)


def skips_content(path: Column) -> Column:
    return file_name(path).isin(*V.LOCK_FILES)


def language(path: Column) -> Column:
    """The language of the extension, or null."""
    ext = extension(path)
    return F.coalesce(*[F.when(ext.isin(*own), name) for name, own in V.LANGUAGES.items()])


def scope(path: Column) -> Column:
    """The component after the first container that has a usable one, else the parent directory, else null."""
    parts = F.split(path, "/")
    after = F.filter(
        F.zip_with(parts, F.slice(F.concat(parts, F.array(F.lit(None).cast("string"))), 2, 10000), lambda a, b: F.when(b.isNotNull() & ~b.contains(".") & (a.isin(*V.WORKSPACES) | (a.isin(*V.CONTAINERS) & ~b.isin(*V.NOT_SCOPES))), b)),
        lambda x: x.isNotNull(),
    )
    up = parent(path)
    return F.coalesce(F.get(after, F.lit(0)), F.when(~up.isin("src", "lib", ".", ""), up))


def module(path: Column) -> Column:
    """The parent directory unless its name is generic, else the file's stem."""
    up = parent(path)
    return F.when(up.isin(*V.GENERIC_DIRECTORIES), stem(path)).otherwise(up)


def glob_to_regex(glob: str) -> str:
    """A glob over whole paths: ** crosses directories, * and ? cross them too, [..] and {a,b} as usual."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 2
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 1
        elif c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in glob[i:]:
            end = glob.index("]", i)
            out, i = out + "[" + glob[i + 1 : end].replace("!", "^", 1) + "]", end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += "\\" + c if not c.isalnum() and c not in "_/ -" else c
        i += 1
    return f"^{out}$"

"""Column expressions over paths, package names and configuration."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Config


def normalize_path(path: Column) -> Column:
    """Backslashes become slashes; one leading ./ goes."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^\./", "")


def package_name(specifier: Column) -> Column:
    """@scope/name of a scoped specifier, else its first segment."""
    parts = F.split(specifier, "/")
    return F.when(specifier.startswith("@"), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(F.get(parts, 0))


def types_package(name: Column) -> Column:
    """The type package of a name: @types/name, a scope joined by two underscores."""
    return F.concat(F.lit("@types/"), F.regexp_replace(F.regexp_replace(name, "^@", ""), "/", "__"))


def extension_in(path: Column, extensions: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for e in extensions:
        out = out | path.endswith(e)
    return out


def newlines(text: Column) -> Column:
    """Physical lines as the number of newlines."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def script_lines(text: Column) -> Column:
    """Lines counting a last one that has no newline."""
    return newlines(text) + F.when(text.endswith("\n") | (text == ""), 0).otherwise(1)


def js_round(x: Column) -> Column:
    """Half up, also below zero."""
    return F.floor(x + 0.5)


def tokens(text: Column) -> Column:
    """Path-like tokens of a text, in order."""
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_@.\-\\/]+"), F.lit(0))


def normalize_token(token: Column) -> Column:
    """The token as a relative path; null if it has no slash or an empty, . or .. segment after a leading ./ or slashes."""
    path = F.regexp_replace(F.translate(token, "\\", "/"), r"^(\./|/+)", "")
    bad = F.exists(F.split(path, "/"), lambda s: s.isin("", ".", ".."))
    return F.when(path.contains("/") & ~bad, path)


def suffix_keys(path: Column, least: int) -> Column:
    """All suffixes of a path that begin at a segment and have ``least`` segments or more."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(n >= least, F.transform(F.sequence(F.lit(1), n - least + 1), lambda i: F.array_join(F.slice(parts, i, n), "/"))).otherwise(F.array().cast("array<string>"))


def strip_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"(\.d)?\.[A-Za-z0-9]+$", "")


def segments(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def glob_regex(glob: str) -> str:
    """A glob as an anchored regular expression: **/ any folders, ** anything, * within a segment."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        elif glob[i] == "*":
            out.append("[^/]*")
            i += 1
        else:
            out.append(re.escape(glob[i]))
            i += 1
    return f"^{''.join(out)}$"


def selected(path: Column, selector: str) -> Column:
    """A selector with a star is a glob; another is a file or a folder with all below."""
    if "*" in selector:
        return path.rlike(glob_regex(selector))
    root = selector.rstrip("/")
    return (path == root) | path.startswith(root + "/")


def render(template: str, values: dict[str, Column]) -> Column:
    """{name} replaced by its value; an unknown name is refused when the plan is made."""
    parts = re.split(r"\{([A-Za-z]+)\}", template)
    unknown = [n for n in parts[1::2] if n not in values]
    if unknown:
        raise ValueError(f"unknown placeholder {unknown[0]}")
    return F.concat(*[values[x] if i % 2 else F.lit(x) for i, x in enumerate(parts) if x or i % 2])


def application(path: Column, config: Config) -> Column:
    """The application with the longest source root above the path; the first of equal ones."""
    out = F.lit(None).cast("string")
    for app in reversed(sorted(config.applications, key=lambda a: -len(a.source_root))):
        out = F.when(path.startswith(app.source_root.rstrip("/") + "/"), F.lit(app.name)).otherwise(out)
    return out


def owner(path: Column, config: Config) -> Column:
    """Source root of the application, else first-party package root, else the folder below a package root, else the first segment."""
    parts = F.split(path, "/")
    out = F.get(parts, 0)
    for root in reversed(config.package_roots):
        depth = root.count("/") + 1
        out = F.when(path.startswith(root + "/") & (F.size(parts) > depth + 1), F.array_join(F.slice(parts, 1, depth + 1), "/")).otherwise(out)
    for root in config.first_party_packages:
        out = F.when((path == root) | path.startswith(root + "/"), F.lit(root)).otherwise(out)
    for app in reversed(sorted(config.applications, key=lambda a: -len(a.source_root))):
        out = F.when(path.startswith(app.source_root.rstrip("/") + "/"), F.lit(app.source_root)).otherwise(out)
    return out


def domain(path: Column, config: Config) -> Column:
    """The first configured pattern that matches; else application:first folder (first/second below nested roots, :__root__ for files at the root); else the owner."""
    out = owner(path, config)
    for app in reversed(sorted(config.applications, key=lambda a: -len(a.source_root))):
        root = app.source_root.rstrip("/")
        rest = F.split(F.substring(path, len(root) + 2, 1 << 30), "/")
        first = F.get(rest, 0)
        name = F.when(F.size(rest) < 2, F.lit("__root__")).otherwise(F.when(first.isin(*app.nested_roots) & (F.size(rest) > 2), F.concat_ws("/", first, F.get(rest, 1))).otherwise(first) if app.nested_roots else first)
        out = F.when(path.startswith(root + "/"), F.concat(F.lit(app.name + ":"), name)).otherwise(out)
    for label, pattern in reversed(config.domains):
        out = F.when(path.rlike(pattern), F.lit(label)).otherwise(out)
    return out


def test_kind(path: Column, config: Config) -> Column:
    """The one test kind whose pattern matches, null for production files; two kinds are an error."""
    kinds = F.array_compact(F.array(*[F.when(path.rlike(p), F.lit(k)) for k, p in config.test_patterns]))
    return F.when(F.size(F.array_distinct(kinds)) > 1, F.raise_error(F.concat(F.lit("overlapping test kinds: "), path))).otherwise(F.get(kinds, 0))


def edge_kind(asset: Column, dynamic: Column, type_only: Column) -> Column:
    """asset before dynamic before type-only before static."""
    return F.when(asset, "asset").when(dynamic, "dynamic").when(type_only, "type-only").otherwise("static")


def closest(word: Column, others: Column) -> Column:
    """The nearest of an array by edit distance within max(2, length / 3), ties to the first in order; null if none is."""
    limit = F.greatest(F.lit(2), F.floor(F.length(word) / 3))
    near = F.array_sort(F.transform(others, lambda o: F.struct(F.levenshtein(word, o).alias("d"), o.alias("o"))))
    return F.when((F.size(near) > 0) & (F.get(near, 0)["d"] <= limit), F.get(near, 0)["o"])

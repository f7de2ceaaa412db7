"""Rewrites of what names a moved file: path tokens, import specifiers, aliases, entry points, targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import normalize_token, strip_extension, suffix_keys


def path_rewrites(tokens: DataFrame, moves: DataFrame, extensionless: bool = True) -> DataFrame:
    """(file, start, end, from, to, donor): the part of each token (file, start, token) that names a moved file (source, target), and what takes its place.

    A relative token names a source if it is equal to it; an absolute one if a suffix of whole
    segments is. A token without an extension names the source without its own, if that is
    allowed. Only the suffix is replaced, so what stands before it stays as it is written, and
    backslashes stay backslashes. Suffixes meet sources by an equality join.
    """
    slashed = F.translate("token", "\\", "/")
    path = normalize_token(F.col("token"))
    keys = F.when(slashed.startswith("/"), suffix_keys(F.col("path"), 1)).otherwise(F.array("path"))
    t = tokens.withColumn("path", path).where("path is not null").withColumn("ext", F.element_at(F.split("path", "/"), -1).contains("."))
    if not extensionless:
        t = t.where("ext")
    each = t.select("file", "start", "token", "ext", F.explode(keys).alias("key"))
    known = moves.select(F.col("source").alias("key"), F.col("source").alias("donor"), "target", F.lit(True).alias("ext"))
    bare = moves.select(strip_extension(F.col("source")).alias("key"), F.col("source").alias("donor"), strip_extension(F.col("target")).alias("target"), F.lit(False).alias("ext"))
    hit = each.join(known.union(bare), ["key", "ext"])
    end = F.col("start") + F.length("token")
    to = F.when(F.col("token").contains("\\"), F.translate("target", "/", "\\")).otherwise(F.col("target"))
    return hit.select("file", (end - F.length("key")).alias("start"), end.alias("end"), F.col("token").alias("from"), to.alias("to"), "donor")


def fits_literal(text: Column, delimiter: Column) -> Column:
    """Can the text stand between these delimiters as it is?"""
    plain = ~text.contains(delimiter) & ~text.contains("\\") & ~text.rlike(r"[\r\n]")
    return delimiter.isin('"', "'", "`") & plain & ((delimiter != "`") | ~text.contains("${"))


def specifier_rewrites(spans: DataFrame) -> DataFrame:
    """spans (text, start, end, to) with ``rewritten``: the literal at [start, end), delimiters included, holds ``to`` instead; null where that doesn't fit."""
    mark = F.substring(F.col("text"), F.col("start") + 1, F.lit(1))
    head = F.substring(F.col("text"), F.lit(1), F.col("start") + 1)
    tail = F.substring(F.col("text"), F.col("end"), F.length("text"))
    return spans.withColumn("rewritten", F.when(fits_literal(F.col("to"), mark), F.concat(head, F.col("to"), tail)))


def entry_points(packages: DataFrame, tree: DataFrame) -> DataFrame:
    """(owner, entry) of packages (owner, whole, on_import, on_default, on_types, main, types): the first of these that the tree (path) has; null if none."""
    tries = F.array(*[F.regexp_replace(c, r"^\./", "") for c in ("whole", "on_import", "on_default", "on_types", "main", "types")])
    each = packages.select("owner", F.posexplode(F.transform(tries, lambda x: F.concat(F.col("owner"), F.lit("/"), x))).alias("order", "path")).where("path is not null")
    found = each.join(tree.select("path").distinct(), "path").groupBy("owner").agg(F.min_by("path", "order").alias("entry"))
    return packages.select("owner").join(found, "owner", "left")


def alias_path(specifier: Column, aliases: list[tuple[str, str]]) -> Column:
    """What the first matching alias (pattern with at most one star, target) makes of a specifier; null if none does."""
    out = F.lit(None).cast("string")
    for pattern, target in reversed(aliases):
        prefix, star, suffix = pattern.partition("*")
        if star:
            hit = specifier.startswith(prefix) & specifier.endswith(suffix) & (F.length(specifier) >= len(prefix) + len(suffix))
            wild = F.substring(specifier, F.lit(len(prefix) + 1), F.length(specifier) - len(prefix) - len(suffix))
            before, _, after = target.partition("*")
            out = F.when(hit, F.concat(F.lit(before), wild, F.lit(after))).otherwise(out)
        else:
            out = F.when(specifier == pattern, target).otherwise(out)
    return out


def target_relative(path: Column, applications: tuple[str, ...], packages: tuple[str, ...]) -> Column:
    """The path below its application's root, or below its package and that package's src; null outside of every root."""
    parts = F.split(path, "/")
    out = F.lit(None).cast("string")
    for root in reversed(packages):
        depth = root.count("/") + 1
        skip = F.when(F.get(parts, depth + 1) == "src", depth + 2).otherwise(depth + 1)
        out = F.when(path.startswith(root + "/"), F.array_join(F.slice(parts, skip + 1, F.size(parts)), "/")).otherwise(out)
    for root in reversed(applications):
        out = F.when(path.startswith(root + "/"), F.substring(path, F.lit(len(root) + 2), F.length(path))).otherwise(out)
    return out


def target_subpath(value: Column) -> Column:
    """A folder below src of a package in its normal form; null if it is absolute, leaves src, or has empty, . or .. segments."""
    clean = F.regexp_replace(F.regexp_replace(F.translate(value, "\\", "/"), r"^\./", ""), "/+$", "")
    bad = F.exists(F.split(clean, "/"), lambda s: s.isin("", ".", ".."))
    return F.when(~bad & ((clean == "src") | clean.startswith("src/")), clean)


def module_path(path: Column, subpath: Column, relative: Column) -> Column:
    """Where a moved file lands below src: as it stood, or by its own name in the asked folder."""
    name = F.element_at(F.split(path, "/"), -1)
    below = F.substring(subpath, F.lit(5), F.length(subpath))
    return F.when(subpath.isNull(), relative).when(below == "", name).otherwise(F.concat(below, F.lit("/"), name))


def extension_violations(refs: DataFrame, approved: tuple[str, ...]) -> DataFrame:
    """Relative references (file, line, specifier) that don't end in an approved extension."""
    good = F.lit(False)
    for e in approved:
        good = good | F.col("specifier").endswith(e)
    return refs.where(F.col("specifier").startswith(".") & ~good).select("file", "line", "specifier")


def emitted_specifiers(texts: DataFrame, moves: DataFrame, base: str) -> DataFrame:
    """(file, specifier, to, choices): quoted relative strings of texts (file, text), resolved from ``base``, that name exactly one moved file (source, target)."""
    quoted = texts.select("file", F.explode(F.regexp_extract_all("text", F.lit("[\"'](\\.{1,2}/[^\"'\\s]+)[\"']"), F.lit(1))).alias("specifier")).distinct()
    start = F.array(*[F.lit(x) for x in base.split("/") if x]) if base else F.array().cast("array<string>")
    walk = F.aggregate(F.split("specifier", "/"), start, lambda at, s: F.when(s.isin("", "."), at).when(s == "..", F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))).otherwise(F.concat(at, F.array(s))))
    named = quoted.withColumn("key", strip_extension(F.array_join(walk, "/")))
    hit = named.join(moves.select(strip_extension(F.col("source")).alias("key"), "target"), "key")
    return hit.groupBy("file", "specifier").agg(F.countDistinct("target").alias("choices"), F.min("target").alias("to")).where("choices = 1").select("file", "specifier", "to")


def excerpt(text: Column, head: int, tail: int) -> Column:
    """The text if it is short, else its first and last characters around dots."""
    return F.when(F.length(text) <= head + tail, text).otherwise(F.concat(F.substring(text, F.lit(1), F.lit(head)), F.lit("..."), F.substring(text, F.length(text) - tail + 1, F.lit(tail))))


def common_ends(a: Column, b: Column) -> tuple[Column, Column]:
    """Lengths of the common prefix of two arrays of lines, and of the common suffix of what is left. The arrays are walked once, side by side."""
    n = F.least(F.size(a), F.size(b))
    unlike = lambda x, y: F.array_position(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), False).cast("int")
    run = lambda x, y, most: F.least(most, F.coalesce(F.nullif(unlike(x, y), F.lit(0)) - 1, most))
    front = run(a, b, n)
    return front, run(F.reverse(a), F.reverse(b), n - front)

"""Workspace globs and generated-file headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import glob_regex


def resolve_globs(folders: DataFrame, globs: list[str]) -> tuple[DataFrame, list[str]]:
    """(folders (path) that the globs pick, the positive globs that pick none). A leading ! takes away; ** is for those only."""
    positive, negative = [g for g in globs if not g.startswith("!")], [g[1:] for g in globs if g.startswith("!")]
    if any("**" in g for g in positive):
        raise ValueError("** is for negative globs only")
    path = F.col("path")
    hit, gone = F.lit(False), F.lit(False)
    for g in positive:
        hit = hit | path.rlike(glob_regex(g.rstrip("/")))
    for g in negative:
        gone = gone | path.rlike(glob_regex(g.rstrip("/")))
    counts = folders.agg(*[F.coalesce(F.bool_or(path.rlike(glob_regex(g.rstrip("/")))), F.lit(False)).alias(f"g{i}") for i, g in enumerate(positive)]).first() if positive else []
    return folders.where(hit & ~gone), [g for g, any_ in zip(positive, counts, strict=True) if not any_]


def provenance(text: Column, lines: int = 5) -> Column:
    """What the first lines say a file was generated from, or by; null if nothing."""
    head = F.array_join(F.slice(F.split(text, "\n"), 1, lines), "\n")
    found = F.regexp_extract(head, r"(?i)(?:generated (?:from|by)|source:)\s+([^\s*]+)", 1)
    return F.when(found != "", found)

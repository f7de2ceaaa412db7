"""Reports out: single JSON files, compact tables, evidence bundles."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame

from .functions.documents import canonical

#: Rows that a report for a person or a single file has, at most.
REPORT_ROWS = 1_000_000


def _rows(df: DataFrame, order: Iterable[str]) -> list[dict]:
    rows = [r.asDict(recursive=True) for r in df.orderBy(*order).limit(REPORT_ROWS + 1).collect()]
    if len(rows) > REPORT_ROWS:
        raise ValueError("too many rows for one report; write a table")
    return rows


def write_text(path: str, text: str, exclusive: bool = False) -> None:
    """Whole or not at all: a temporary file beside the target, then a rename; exclusive refuses an existing one."""
    if exclusive and os.path.exists(path):
        raise FileExistsError(path)
    fd, temp = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(temp, path)


def json_report(df: DataFrame, order: list[str]) -> str:
    """Canonical JSON of the rows in order, with a newline."""
    return canonical(json.loads(json.dumps(_rows(df, order), default=str))) + "\n"


def text_table(df: DataFrame, order: list[str]) -> str:
    """Columns padded to their widest value."""
    rows = [df.columns, *([str(v) for v in r.values()] for r in _rows(df, order))]
    widths = [max(len(r[i]) for r in rows) for i in range(len(df.columns))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in rows) + "\n"


def write_table(df: DataFrame, path: str, exclusive: bool = True) -> None:
    df.write.mode("errorifexists" if exclusive else "overwrite").parquet(path)


def write_bundle(folder: str, artifacts: dict[str, str], budget: int | None = None) -> dict:
    """Artifacts staged beside the target, checked against their manifest, then renamed into place."""
    manifest = [{"path": n, "sha256": hashlib.sha256(t.encode()).hexdigest(), "bytes": len(t.encode())} for n, t in sorted(artifacts.items())]
    if budget is not None and sum(m["bytes"] for m in manifest) > budget:
        raise ValueError("the bundle exceeds its budget")
    if os.path.exists(folder):
        raise FileExistsError(folder)
    stage = tempfile.mkdtemp(dir=os.path.dirname(folder.rstrip("/")) or ".")
    for n, t in artifacts.items():
        if os.path.basename(n) != n or n.startswith("."):
            raise ValueError(f"unsafe name {n}")
        Path(stage, n).write_text(t, encoding="utf-8")
    Path(stage, "manifest.json").write_text(canonical(manifest) + "\n", encoding="utf-8")
    faults = bundle_faults(stage)
    if faults:
        raise ValueError(f"bundle differs from its manifest: {faults}")
    os.rename(stage, folder)
    return {m["path"]: m["sha256"] for m in manifest}


def bundle_faults(folder: str) -> list[tuple[str, str]]:
    """(path, fault) of a bundle against its manifest: missing, unexpected, differs."""
    recorded = {m["path"]: m for m in json.loads(Path(folder, "manifest.json").read_text(encoding="utf-8"))}
    live = {p.name: p.read_bytes() for p in Path(folder).iterdir() if p.name != "manifest.json"}
    out = [(n, "missing") for n in recorded.keys() - live.keys()] + [(n, "unexpected") for n in live.keys() - recorded.keys()]
    out += [(n, "differs") for n in recorded.keys() & live.keys() if hashlib.sha256(live[n]).hexdigest() != recorded[n]["sha256"] or len(live[n]) != recorded[n]["bytes"]]
    return sorted(out)

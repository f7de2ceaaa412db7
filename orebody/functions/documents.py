"""Functions over JSON, text spans and style sheets that need Python; vectorised where they run on columns."""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(value: Any) -> str:
    """JSON with keys sorted at every depth, arrays as they stand, whole floats without a fraction."""

    def plain(x: Any) -> Any:
        if isinstance(x, dict):
            return {k: plain(x[k]) for k in sorted(x)}
        if isinstance(x, list):
            return [plain(y) for y in x]
        return int(x) if isinstance(x, float) and x.is_integer() and abs(x) < 1e21 else x

    return json.dumps(plain(value), ensure_ascii=False, separators=(",", ":"))


def _canonical_texts(texts: pd.Series) -> pd.Series:
    def one(t: str | None) -> str | None:
        try:
            return None if t is None else canonical(json.loads(t))
        except ValueError:
            return None

    return texts.map(one)


def canonical_json(texts: Column) -> Column:
    """canonical() of JSON texts; null for null and for text that isn't JSON."""
    return F.pandas_udf(_canonical_texts, "string")(texts)


def pointer(document: Any, path: str) -> Any:
    """The value at a JSON pointer; ~1 is a slash and ~0 a tilde. A missing step raises KeyError."""
    for part in path.split("/")[1:] if path else []:
        part = part.replace("~1", "/").replace("~0", "~")
        document = document[int(part)] if isinstance(document, list) else document[part]
    return document


def relocate_keys(text: str, at: str, moves: dict[str, str]) -> str:
    """The JSON text with the keys of the object at a pointer renamed; two keys that meet are refused."""
    document = json.loads(text)
    target = pointer(document, at)
    renamed: dict = {}
    for k, v in target.items():
        new = moves.get(k, k)
        if new in renamed or (new != k and new in target and moves.get(new, new) == new):
            raise ValueError(f"key {new} is taken")
        renamed[new] = v
    target.clear()
    target.update(renamed)
    return json.dumps(document, ensure_ascii=False, indent=2) + "\n"


def registry_values(text: str, pattern: str) -> list[tuple[str, str]]:
    """(pointer, value) of the strings that a pattern of keys reaches; * is any key or place."""
    found = [("", json.loads(text))]
    for part in pattern.strip("/").split("/"):
        following = []
        for at, x in found:
            keys = x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ()
            following += [(f"{at}/{k}", v) for k, v in keys if part in ("*", str(k))]
        found = following
    return [(at, v) for at, v in found if isinstance(v, str)]


def splice(text: Column, replacements: Column) -> Column:
    """text with array<struct<start, end, text>> (code points, disjoint) replaced, from the right so that offsets hold."""
    ordered = F.reverse(F.array_sort(replacements))
    return F.aggregate(ordered, text, lambda acc, r: F.concat(F.substring(acc, F.lit(1), r["start"]), r["text"], F.substring(acc, r["end"] + 1, F.length(acc))))


def css_rules(sheet: str) -> list[tuple[str, str]]:
    """(selector, declarations) of a style sheet; rules inside at-rules carry them in front."""
    sheet = re.sub(r"/\*.*?\*/", "", sheet, flags=re.S)
    out: list[tuple[str, str]] = []

    def walk(at: int, prefix: str) -> int:
        head = at
        while at < len(sheet):
            c = sheet[at]
            if c == "}":
                return at + 1
            if c == ";":
                head = at + 1
            elif c == "{":
                name = " ".join(sheet[head:at].split())
                if name.startswith("@") and not re.match(r"@(font-face|page)", name):
                    at = walk(at + 1, f"{prefix}{name} ")
                else:
                    end = sheet.find("}", at)
                    end = len(sheet) if end < 0 else end
                    body = ";".join(":".join(p.strip() for p in d.split(":", 1)) for d in sheet[at + 1 : end].split(";") if d.strip())
                    out.extend((prefix + s.strip(), body) for s in name.split(","))
                    at = end + 1
                head = at
                continue
            at += 1
        return at

    walk(0, "")
    return out


def exports_target(manifest: dict, subpath: str, conditions: tuple[str, ...] = ("import", "default")) -> str | None:
    """The file that a package's exports give for . or ./sub: exact keys before patterns, the longest pattern first, conditions in the map's order."""
    exports = manifest.get("exports")
    if exports is None:
        return None
    if isinstance(exports, str) or not any(k.startswith(".") for k in exports):
        exports = {".": exports}

    def pick(x: Any) -> str | None:
        if isinstance(x, dict):
            return next((y for k, v in x.items() if k in conditions and (y := pick(v))), None)
        if isinstance(x, list):
            return next((y for v in x if (y := pick(v))), None)
        return x

    if subpath in exports:
        return pick(exports[subpath])
    for key in sorted((k for k in exports if "*" in k), key=lambda k: (-k.index("*"), -len(k))):
        head, tail = key.split("*", 1)
        if subpath.startswith(head) and subpath.endswith(tail) and len(subpath) >= len(head) + len(tail):
            star = subpath[len(head) : len(subpath) - len(tail)]
            found = pick(exports[key])
            return found.replace("*", star) if found else None
    return None

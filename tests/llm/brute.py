"""Plain versions of the corpus operators, one text at a time, to hold results against."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Sequence
from fractions import Fraction

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def substring(texts: Sequence[str | None], length: int = 35) -> list[tuple[int, int, str]]:
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def lower(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def shingle_set(t: str | None, size: int = 2) -> frozenset:
    w = WORD.findall(lower(t or ""))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def near(rows: Sequence[tuple[int, str | None]], size: int = 2) -> dict[int, tuple[int, int]]:
    """doc_id: (n_shingles, component_id); all pairs, so for small inputs."""
    sets = [(d, shingle_set(t, size)) for d, t in rows]
    root = {d: d for d, _ in rows}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    by_size = sorted((x for x in sets if x[1]), key=lambda x: len(x[1]))
    for i, (a, s) in enumerate(by_size):
        for b, t in by_size[i + 1 :]:
            if len(t) * 80 > 100 * len(s):
                break
            if find(a) != find(b):
                n = len(s & t)
                if 100 * n >= 80 * (len(s) + len(t) - n):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {d: (len(s), find(d)) for d, s in sets}


def quality(t: str | None) -> tuple[int, int, int, int, int]:
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    where = defaultdict(list)
    for i in range(len(w) - 7):
        where[tuple(w[i : i + 8])].append(i)
    covered = {j for at in where.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def personal(t: str | None) -> list[tuple[str, int, int]]:
    t, out = t or "", []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, t):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                double = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
                if not 16 <= len(digits) <= 19 or sum(double) % 10:
                    continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def collocations(rows: Sequence[tuple[str | None, str | None]], least: int = 30, most: int = 2000) -> list[tuple]:
    """(lang, rank, phrase, a, l, r, n, score) with dictionaries."""
    f, total = defaultdict(Counter), Counter()
    for lang, t in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(t or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in (1, 2, 3, 4):
                f[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, counts in f.items():
        common = {p: c for p, c in counts.items() if c >= least and len(p) > 1}
        held = set()
        for p, c in common.items():
            held.update(q for m in range(2, len(p)) for s in range(len(p) - m + 1) if (q := p[s : s + m]) in common and 100 * c >= 80 * common[q])
        best = []
        for p, a in common.items():
            if p not in held:
                score, _, left, right = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(best)[:most], 1)]
    return out


def smallest_period(w: Sequence) -> int:
    fail = [0] * (len(w) + 1)
    k = 0
    for i in range(1, len(w)):
        while k and w[i] != w[k]:
            k = fail[k]
        k += w[i] == w[k]
        fail[i + 1] = k
    return len(w) - fail[len(w)]


def runs(w: Sequence, least: int = 24, periods: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period): stretches in which words q apart are equal, for every q."""
    ids = {}
    x = np.array([ids.setdefault(a, len(ids)) for a in w], np.int64)
    out = []
    for q in range(1, len(x) // periods + 1):
        same = np.concatenate([[False], x[:-q] == x[q:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a + q >= max(least, periods * q) and smallest_period(x[a : b + q].tolist()) == q:
                out.append((a, b - a + q, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id: int | None, w: list[str]) -> list[str]:
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def periodic(doc_id: int | None, t: str | None) -> tuple:
    w = planted(doc_id, WORD.findall(t or ""))
    found = runs(w)
    gone = {i for s, m, p in found for i in range(s + p, s + m)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else None
    lines = "".join(f"{s},{m},{p}\n" for s, m, p in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def squares(lengths: Sequence[int], size: int) -> list[list[int]]:
    """Sum-of-squares packing by trying every place: the sequences, as numbers of pieces, in any order."""
    bins: list[list[int]] = []
    gaps: list[int] = []
    for i, n in enumerate(lengths):
        counts = Counter(g for g in gaps if 0 < g < size)
        choices = []
        for g in sorted({g for g in gaps if g >= n} | {size}):
            c = counts.copy()
            if g < size:
                c[g] -= 1
            if 0 < g - n:
                c[g - n] += 1
            choices.append((sum(x * x for x in c.values()), g == size, g))
        g = min(choices)[2]
        if g == size:
            bins.append([i])
            gaps.append(size - n)
        else:
            k = max(j for j, x in enumerate(gaps) if x == g)
            bins[k].append(i)
            gaps[k] -= n
    return bins

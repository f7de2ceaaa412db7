"""Maximal periodic runs of words in texts: Lyndon roots from the inverse suffix array, extended by common prefixes.

Every run has, under an order of the words or under its inverse, a longest Lyndon word that is one of
its periods. The longest Lyndon word at i ends before the next smaller value of the inverse suffix
array; under the inverse order, before the next greater one (the end of a text counts as the smallest
word, so the greatest under the inverse). Each such root (i, j) of period p = j - i is extended to the
right by the longest common prefix of the suffixes at i and j, to the left by that of the reversed
text; what is as long as two periods is a run, and p its smallest period, as Lyndon words are primitive.

Common prefixes are minima over the LCP array, answered by a sparse table over blocks of it. The suffix
array comes of prefix doubling, in which only suffixes that are still tied are sorted again. Many
texts are treated at once: the first key is the text, so suffixes of two are never tied.

Asked are runs of three periods or more and of ``least`` words. In such a run each word stands at
least three times, so words that stand less often in their text end every run: texts fall into
segments between them, and segments shorter than ``least`` have no run. That loses nothing.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words treated at once, about; a longer segment is treated by itself.
BATCH = 250_000
_BLOCK = 32


def _ranks(keys: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(suffix array, its inverse, ranks by the first 1, 2, 4, ... words while any are tied) of many words in a row.

    ``ends`` is each position's end of text. A suffix that ends is smaller.
    """
    n = len(keys)
    sa = np.argsort(keys, kind="stable")
    heads = np.concatenate([[True], keys[sa][1:] != keys[sa][:-1]])
    rank = np.empty(n, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    tied = np.flatnonzero(~heads | np.append(~heads[1:], False))
    step, levels = 1, []
    while len(tied):
        levels.append(rank.copy())
        at = sa[tied]
        far = at + step
        second = np.where(far < ends[at], rank[np.minimum(far, n - 1)], -1)
        first = rank[at]
        order = np.lexsort((second, first))
        at, first, second = at[order], first[order], second[order]
        sa[tied] = at
        new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        rank[at] = tied[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        tied = tied[~new | np.append(~new[1:], False)]
        step *= 2
    return sa, rank, levels


class _Prefixes:
    """Longest common prefixes of two suffixes: minima over the LCP array."""

    def __init__(self, keys: np.ndarray, ends: np.ndarray):
        n = len(keys)
        sa, self.rank, levels = _ranks(keys, ends)
        lcp = np.zeros(n, np.int32)  # of each suffix and the one before it in the array
        if levels:
            live = np.flatnonzero(levels[0][sa[:-1]] == levels[0][sa[1:]])
            a, b = sa[live], sa[live + 1]
            got = np.zeros(len(live), np.int64)
            for k in range(len(levels) - 1, -1, -1):
                i, j = a + got, b + got
                same = (i < ends[a]) & (j < ends[b])
                same &= levels[k][np.minimum(i, n - 1)] == levels[k][np.minimum(j, n - 1)]
                got[same] += 1 << k
            lcp[live + 1] = got
        pad = -n % _BLOCK
        blocks = np.concatenate([lcp, np.full(pad, np.iinfo(np.int32).max, np.int32)]).reshape(-1, _BLOCK)
        self.lcp = lcp
        self.left = np.minimum.accumulate(blocks, axis=1).ravel()
        self.right = np.ascontiguousarray(np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]).ravel()
        self.tables = [blocks.min(axis=1)]
        while 2 << (len(self.tables) - 1) <= len(self.tables[0]):
            t, half = self.tables[-1], 1 << (len(self.tables) - 1)
            self.tables.append(np.minimum(t[:-half], t[half:]))

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[i], self.rank[j]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b)
        p, q = lo // _BLOCK, hi // _BLOCK
        out = np.minimum(self.right[lo], self.left[hi])
        wide = np.flatnonzero(q - p > 1)
        if len(wide):
            x, y = p[wide] + 1, q[wide] - 1
            level = np.frexp((y - x + 1).astype(np.float64))[1] - 1
            for k in np.unique(level).tolist():
                w = level == k
                t = self.tables[k]
                out[wide[w]] = np.minimum(out[wide[w]], np.minimum(t[x[w]], t[y[w] - (1 << k) + 1]))
        same = np.flatnonzero(p == q)
        if len(same):
            x, y = lo[same], hi[same]
            least = self.lcp[x].copy()
            for d in range(1, _BLOCK):
                on = x + d <= y
                if not on.any():
                    break
                least[on] = np.minimum(least[on], self.lcp[x[on] + d])
            out[same] = least
        return out.astype(np.int64)


def _next_beyond(rank: list[int], end: list[int], smaller: bool) -> list[int]:
    """For each position the next one of a smaller (greater) value, or its text's end (n if greater: no root)."""
    n = len(rank)
    out = [0] * n
    stack: list[int] = []
    last = -1
    for i in range(n - 1, -1, -1):
        if end[i] != last:
            stack.clear()
            last = end[i]
        r = rank[i]
        if smaller:
            while stack and rank[stack[-1]] > r:
                stack.pop()
        else:
            while stack and rank[stack[-1]] < r:
                stack.pop()
        out[i] = stack[-1] if stack else last if smaller else n
        stack.append(i)
    return out


def maximal(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(start, length, period) of every maximal run of two periods or more in many texts in a row, by start, then period.

    ``words`` are numbers; ``ends`` is each position's end of text.
    """
    n = len(words)
    if not n:
        return np.zeros((0, 3), np.int64)
    text = np.cumsum(np.concatenate([[0], ends[1:] != ends[:-1]]))
    keys = text * (int(words.max()) + 1) + words
    forward = _Prefixes(keys, ends)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(text)) + 1])[text]
    backward = _Prefixes(keys[::-1].copy(), n - starts[::-1])
    found = []
    rank, end = forward.rank.tolist(), ends.tolist()
    for smaller in (True, False):
        i = np.arange(n)
        j = np.array(_next_beyond(rank, end, smaller), np.int64)
        on = j < n
        i, j = i[on], j[on]
        more = np.zeros(len(i), np.int64)
        inside = np.flatnonzero(j < ends[i])
        more[inside] = forward.of(i[inside], j[inside])
        less = np.zeros(len(i), np.int64)
        inside = np.flatnonzero(i > starts[i])
        less[inside] = backward.of(n - i[inside], n - j[inside])  # the words before i and before j
        period = j - i
        length = less + period + more
        run = length >= 2 * period
        found.append(np.stack([(i - less)[run], length[run], period[run]], axis=1))
    out = np.unique(np.concatenate(found), axis=0)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def planted(doc_id: int, n: int) -> tuple[int, int] | None:
    """(a, p) if the words from a on are to repeat with period p, as the contract of op13 sets by the id's checksum."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


class _Found:
    """Runs of the texts of a batch, gathered segment by segment."""

    def __init__(self, least: int, periods: int):
        self.least, self.periods = least, periods
        self.clear()

    def clear(self) -> None:
        self.segments: list[tuple[int, int, np.ndarray]] = []  # text, first word, words
        self.n = 0

    def add(self, text: int, words: list[bytes]) -> None:
        if len(words) < self.least:
            return
        counts = Counter(words)
        numbers = {w: k for k, (w, c) in enumerate(counts.items(), 1) if c >= self.periods}
        if not numbers:
            return
        ids = np.fromiter((numbers.get(w, 0) for w in words), np.int64, len(words))
        bounds = np.concatenate([[-1], np.flatnonzero(ids == 0), [len(ids)]])
        for k in np.flatnonzero(np.diff(bounds) > self.least).tolist():
            segment = ids[bounds[k] + 1 : bounds[k + 1]]
            self.segments.append((text, int(bounds[k]) + 1, segment))
            self.n += len(segment)

    def runs(self) -> dict[int, np.ndarray]:
        """text: (start, length, period) of its runs, by start, then period."""
        out: dict[int, list[np.ndarray]] = {}
        first = 0
        while first < len(self.segments):
            last, size = first, 0
            while last < len(self.segments) and (last == first or size + len(self.segments[last][2]) <= BATCH):
                size += len(self.segments[last][2])
                last += 1
            some = self.segments[first:last]
            lengths = np.array([len(s) for _, _, s in some])
            stops = np.cumsum(lengths)
            found = maximal(np.concatenate([s for _, _, s in some]), np.repeat(stops, lengths))
            found = found[found[:, 1] >= np.maximum(self.least, self.periods * found[:, 2])]
            which = np.searchsorted(stops, found[:, 0], "right")
            for k in np.unique(which).tolist():
                text, at, _ = some[k]
                mine = found[which == k].copy()
                mine[:, 0] += at - (int(stops[k]) - int(lengths[k]))
                out.setdefault(text, []).append(mine)
            first = last
        self.clear()
        return {t: np.concatenate(x) for t, x in out.items()}


def found(docs: DataFrame, text: str = "text", least: int = 24, periods: int = 3, plant: bool = False, keep_text: bool = False) -> DataFrame:
    """docs (without the text) with n_runs, the strongest run's start, length, period and exponent_milli, runs_sha256, collapsed_sha256; if keep_text also ``runs`` (array of start, length, period) and ``collapsed``.

    Runs are of ``least`` words and ``periods`` periods (at least two) or more; the strongest has the greatest
    length / period, ties by the smallest start, then period. A word that any run holds after the run's first period is dropped from
    the collapsed text. Null and empty texts have no words, no runs, and the digests of no bytes; so has a
    text without a run an empty list. With ``plant`` the words are first repeated by planted() of
    doc_id; a null id plants nothing. Rows stand alone, repeated ones alike; an empty
    table stays empty. New columns replace columns of those names. A text is treated whole, whatever its length.
    """
    new = {"n_runs": "long", "start": "long", "length": "long", "period": "long", "exponent_milli": "long", "runs_sha256": "string", "collapsed_sha256": "string"}
    if keep_text:
        new |= {"runs": "array<struct<start:long,length:long,period:long>>", "collapsed": "string"}
    names = [c for c in docs.columns if c != text and c not in new]
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.col(text).alias("__text"), (F.col("doc_id").cast("string") if plant else F.lit(None).cast("string")).alias("__id"))
    schema = rows.select(*[F.col(f"`{c}`") for c in names], *[F.lit(None).cast(t).alias(c) for c, t in new.items()]).schema
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + ([run_type, pa.string()] if keep_text else [])

    def digest(words: list[bytes], runs: np.ndarray | None) -> tuple:
        if runs is None:
            kept = b" ".join(words)
            best, listed = (None,) * 4, []
        else:
            gone = np.zeros(len(words) + 1, np.int64)
            np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
            np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
            kept = b" ".join([w for w, d in zip(words, (np.cumsum(gone[:-1]) > 0).tolist(), strict=True) if not d])
            listed = runs.tolist()
            s, m, p = listed[0]
            for a, b, c in listed[1:]:  # by start, then period: only a greater exponent wins
                if b * p > m * c:
                    s, m, p = a, b, c
            best = (s, m, p, 1000 * m // p)
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in listed)
        row = (len(listed), *best, sha256(lines.encode()).hexdigest(), sha256(kept).hexdigest())
        return (*row, [{"start": a, "length": b, "period": c} for a, b, c in listed], kept.decode()) if keep_text else row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Found(least, periods)
        for whole in batches:
            row = 0
            while row < whole.num_rows:
                texts, first = [], row
                seen.clear()
                size = 0
                while row < whole.num_rows and (row == first or size < 4 * BATCH and seen.n < 4 * BATCH):
                    words = (whole.column(len(names))[row].as_py() or "").encode().split()
                    doc_id = whole.column(len(names) + 1)[row].as_py()
                    at = planted(doc_id, len(words)) if doc_id is not None else None
                    if at:
                        a, p = at
                        cycle = words[a : a + p]
                        rest = len(words) - a
                        words = words[:a] + (cycle * (rest // p + 1))[:rest]
                    seen.add(row - first, words)
                    texts.append(words)
                    size += len(words)
                    row += 1
                runs = seen.runs()
                cols = list(zip(*[digest(w, runs.get(k)) for k, w in enumerate(texts)], strict=True))
                part = whole.slice(first, row - first)
                arrays = [*[part.column(i) for i in range(len(names))], *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]]
                yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema([*[whole.schema.field(i) for i in range(len(names))], *[pa.field(c, k) for c, k in zip(new, kinds, strict=True)]]))

    return rows.mapInArrow(run, schema)

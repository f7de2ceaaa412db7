"""Personal data in text: patterns with checks, and a character-level bidirectional LSTM with CRF transitions, trained in numpy.

Base spans come from the patterns. The tagger is trained on the driver from labelled spans: the
base spans of a bounded sample of texts, and spans written into excerpts of the same texts in
forms that the patterns miss (SAMPLE texts at most): blanks around signs, dots in cards, phones
without a plus, and addresses spelled with "at" and "dot". It reads windows of WINDOW characters
that overlap by half. No span is kept that isn't plausible for its kind, which takes a digit, an
at sign, or a spelled "at" with a "dot" behind it; so windows that hold none of these can't begin
a span that is kept, and only those of them are run into which a span runs from the window beside.
Each window is decoded by Viterbi. A span that runs out of a window is joined with what the next
windows have of it, so a span may be of any length; of each character the best confidence counts.
Decoded spans compete globally in their text: other spans cut by a window's edge are dropped,
joined ones go first, then higher confidence wins, and a span that overlaps a base span is
dropped, so base spans stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
WINDOW = 64
#: Texts that the tagger is trained on, at most, the least by a hash.
SAMPLE = 400
#: Shares of the kinds among written spans: addresses have most forms.
SHARES = (0.55, 0.12, 0.13, 0.2)
#: Least marginal probability that every character of a decoded span must have.
SURE = 0.5

# The base patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Addresses that are spelled out: a name, "at", a host with "dot" or a dot, at least once.
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]+(?: at |[ ]?[\[(] ?at ?[\])][ ]?)[A-Za-z0-9-]+(?:(?: dot |[ ]?[\[(] ?dot ?[\])][ ]?|\.)[A-Za-z0-9-]+)+", re.I)
_TRIGGER = re.compile(r"[0-9@]|(?: at |[\[(] ?at ?[\])] ?)(?=[A-Za-z0-9-]+(?: dot | ?[\[(] ?dot ?[\])]))", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as in KINDS, then start; linear in the text."""
    out = []
    at = text.find("@")
    cursor = 0
    while at >= 0:
        start = at
        while start > cursor and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            cursor = m.end()
            at = text.find("@", cursor)
        else:
            at = text.find("@", at + 1)
    # (?<![0-9]) only saves retries inside a run of digits: a run that fails at its start fails throughout.
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:] if len(p) > 4 else p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


# Characters as the tagger sees them.
_SIGNS = "@.-+() _%:/,;\n#=&"
CLASSES = 5 + len(_SIGNS) + 26
_CODE = np.full(128, 4, np.int64)
for _i in range(128):
    _c = chr(_i)
    if _c.isdigit():
        _CODE[_i] = 1
    elif "a" <= _c <= "z":
        _CODE[_i] = 5 + len(_SIGNS) + ord(_c) - 97
    elif "A" <= _c <= "Z":
        _CODE[_i] = 2
    elif _c in _SIGNS:
        _CODE[_i] = 5 + _SIGNS.index(_c)
PAD = 0
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind


def _codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return np.where(points < 128, _CODE[np.minimum(points, 127)], 3)


def _allowed() -> np.ndarray:
    ok = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        ok[:, inside] = False
        ok[[inside - 1, inside], inside] = True
    return ok


OK = _allowed()
BAR = -1e4


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Tagger:
    """Embedding, one LSTM each way, emissions, CRF transitions; all arrays float32."""

    def __init__(self, embed: int = 10, hidden: int = 16, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        u = lambda *s: (rng.uniform(-1, 1, s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"E": u(CLASSES, embed) * np.float32(3), "T": np.zeros((TAGS, TAGS), np.float32), "V": u(2 * hidden, TAGS), "c": np.zeros(TAGS, np.float32)}
        for d in "fb":
            self.p["W" + d] = u(embed + hidden, 4 * hidden)
            self.p["b" + d] = np.zeros(4 * hidden, np.float32)
            self.p["b" + d][hidden : 2 * hidden] = 1

    def _lstm(self, x: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        n, length, _ = x.shape
        k = self.hidden
        h, c = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
        out = np.empty((n, length, k), np.float32)
        w, e = self.p["W" + d], x.shape[2]
        ahead = x @ w[:e] + self.p["b" + d]
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            z = ahead[:, t] + h @ w[e:]
            s = 1 / (1 + np.exp(-z[:, : 3 * k]))
            g = np.tanh(z[:, 3 * k :])
            before, c = c, s[:, k : 2 * k] * c + s[:, :k] * g
            tc = np.tanh(c)
            if keep is not None:
                keep.append((t, h, before, s, g, tc))
            h = s[:, 2 * k :] * tc
            out[:, t] = h
        return out

    def emissions(self, codes: np.ndarray, keep: dict | None = None) -> np.ndarray:
        x = self.p["E"][codes]
        kept = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
        h = np.concatenate([self._lstm(x, d, kept[d]) for d in "fb"], axis=2)
        if keep is not None:
            keep |= {"x": x, "h": h, **kept}
        return h @ self.p["V"] + self.p["c"]

    def _marginals(self, em: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(alpha, beta, log partition, transitions); positions past a window's end (mask 0) change nothing."""
        tr = np.where(OK, self.p["T"], BAR).astype(np.float32)
        n, length, _ = em.shape
        first = np.where(np.arange(TAGS) % 2 == 0, BAR, 0.0).astype(np.float32)
        first[0] = 0
        alpha, beta = np.empty_like(em), np.zeros_like(em)
        alpha[:, 0] = em[:, 0] + first
        for t in range(1, length):
            new = _lse(alpha[:, t - 1, :, None] + tr, 1) + em[:, t]
            alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
        for t in range(length - 2, -1, -1):
            new = _lse(tr + (em[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None], new, 0)
        return alpha, beta, _lse(alpha[:, -1], 1), tr

    def step(self, codes: np.ndarray, tags: np.ndarray, adam: dict, rate: float) -> float:
        """One Adam step on the mean negative log likelihood of the windows."""
        keep: dict = {}
        mask = codes != PAD
        em = self.emissions(codes, keep)
        alpha, beta, z, tr = self._marginals(em, mask)
        n, length, _ = em.shape
        rows = np.arange(n)
        d_em = np.exp(np.minimum(0, alpha + beta - z[:, None, None])) * mask[:, :, None]
        gold = np.zeros(n, np.float64)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        for t in range(length):
            gold += em[rows, t, tags[:, t]] * mask[:, t]
            d_em[rows, t, tags[:, t]] -= mask[:, t]
            if t:
                both = alpha[:, t - 1, :, None] + tr + (em[:, t] + beta[:, t])[:, None, :] - z[:, None, None]
                g["T"] += (np.exp(np.minimum(0, both)) * mask[:, t, None, None]).sum(axis=0)
                np.add.at(g["T"], (tags[:, t - 1], tags[:, t]), -mask[:, t].astype(np.float32))
                gold += tr[tags[:, t - 1], tags[:, t]] * mask[:, t]
        d_em = (d_em / n).astype(np.float32)
        g["T"] = np.where(OK, g["T"] / n, 0)
        h, k = keep["h"], self.hidden
        g["V"] = h.reshape(-1, 2 * k).T @ d_em.reshape(-1, TAGS)
        g["c"] = d_em.sum(axis=(0, 1))
        d_h = d_em @ self.p["V"].T
        d_x = np.zeros_like(keep["x"])
        for j, d in enumerate("fb"):
            w, e = self.p["W" + d], keep["x"].shape[2]
            dh, dc = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
            for t, before_h, before_c, s, gg, tc in reversed(keep[d]):
                dh = dh + d_h[:, t, j * k : (j + 1) * k]
                i, f, o = s[:, :k], s[:, k : 2 * k], s[:, 2 * k :]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * gg * i * (1 - i), dc * before_c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - gg * gg)], axis=1)
                g["W" + d][:e] += keep["x"][:, t].T @ dz
                g["W" + d][e:] += before_h.T @ dz
                g["b" + d] += dz.sum(axis=0)
                d_x[:, t] += dz @ w[:e].T
                dh, dc = dz @ w[e:].T, dc * f
        np.add.at(g["E"], codes, d_x)
        adam["t"] = adam.get("t", 0) + 1
        for name, v in self.p.items():
            m, s = adam.setdefault(name, (np.zeros_like(v), np.zeros_like(v)))
            m[:] = 0.9 * m + 0.1 * g[name]
            s[:] = 0.99 * s + 0.01 * g[name] ** 2
            v -= np.float32(rate) * (m / (1 - 0.9 ** adam["t"])) / (np.sqrt(s / (1 - 0.99 ** adam["t"])) + np.float32(1e-7))
        return float((z - gold).mean())

    def decode(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(best tags, marginal probability of each) of windows; pads are O."""
        mask = codes != PAD
        em = self.emissions(codes)
        alpha, beta, z, tr = self._marginals(em, mask)
        n, length, _ = em.shape
        first = np.where(np.arange(TAGS) % 2 == 0, BAR, 0.0)
        first[0] = 0
        best, back = em[:, 0] + first, np.zeros((n, length, TAGS), np.int8)
        for t in range(1, length):
            total = best[:, :, None] + tr
            back[:, t] = np.where(mask[:, t, None], total.argmax(axis=1), np.arange(TAGS))
            best = np.where(mask[:, t, None], total.max(axis=1) + em[:, t], best)
        tags = np.zeros((n, length), np.int64)
        tags[:, -1] = best.argmax(axis=1)
        for t in range(length - 1, 0, -1):
            tags[:, t - 1] = back[np.arange(n), t, tags[:, t]]
        sure = np.exp(np.minimum(0, np.take_along_axis(alpha + beta, tags[:, :, None], 2)[:, :, 0] - z[:, None]))
        return np.where(mask, tags, 0), np.where(mask, sure, 1)


def _written(kind: str, rng: np.random.Generator) -> str:
    """A made-up span of a kind, often in a form that the base patterns miss."""
    pick = lambda *x: x[int(rng.integers(len(x)))]
    digits = lambda n: "".join(str(int(d)) for d in rng.integers(0, 10, n))
    word = lambda: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(3, 9))))
    if kind == "email":
        host = f"{word()}{pick('', digits(1))}.{pick('example.com', 'example.org', 'com', 'net')}"
        name = f"{word()}{pick('', '.' + digits(2), '_' + word(), '.' + word())}"
        if rng.integers(3) == 0:
            at, dot = pick((" at ", " dot "), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" AT ", " DOT "))
            return f"{name}{at}{host.replace('.', dot)}"
        return f"{name}{pick('@', '@', ' @ ')}{host}"
    if kind == "ip":
        return pick(".", ".", ".", " . ").join(str(int(x)) for x in rng.integers(1, 256, 4))
    if kind == "card":
        d = pick("4", "5") + digits(14)
        d += next(str(c) for c in range(10) if luhn(d + str(c)))
        return pick("", "", " ", "-", ".").join((d[:4], d[4:8], d[8:12], d[12:]))
    a, b, c = digits(3), digits(3), digits(4)
    return pick(f"+1 ({a}) {b}-{c}", f"+1 {a} {b} {c}", f"({a}) {b}-{c}", f"+{digits(2)} {a} {b}{c}", f"{a}-{b}-{c}", f"+1-{a}-{b}-{c}")


def train(texts: list[str], steps: int = 1000, batch: int = 64, seed: int = 9) -> Tagger:
    """Fit on windows of the texts with their base spans, and with written spans put between words."""
    rng, tagger, adam = np.random.default_rng(seed), Tagger(), {}
    texts = [t for t in texts if t.strip()] or ["a b c d e f"]
    spans = [[s for s in base_spans(t)] for t in texts]
    for i in range(steps):
        codes, tags = np.full((batch, WINDOW), PAD), np.zeros((batch, WINDOW), np.int64)
        for j in range(batch):
            k = int(rng.integers(len(texts)))
            t, own = texts[k], spans[k]
            if j % 4 == 0 and own:
                mid = own[int(rng.integers(len(own)))][1]
            else:
                mid = int(rng.integers(0, len(t)))
            lo = max(0, mid - int(rng.integers(0, WINDOW)))
            part = t[lo : lo + WINDOW]
            marks = [(kind, max(0, a - lo), b - lo, a >= lo) for kind, a, b in own if b > lo and a < lo + WINDOW]
            if j % 4 in (1, 2) and not marks:
                kind = KINDS[int(rng.choice(len(KINDS), p=SHARES))]
                new = _written(kind, rng)
                blanks = [m.start() + 1 for m in re.finditer(" ", part)]
                at = blanks[int(rng.integers(len(blanks)))] if blanks else 0
                part = part[:at] + new + " " + part[at:]
                marks = [(kind, at, at + len(new), True)]
            elif j % 4 == 3 and not marks:
                # Digits that are not personal data, so that a digit alone is no sign of it.
                blanks = [m.start() + 1 for m in re.finditer(" ", part)]
                at = blanks[int(rng.integers(len(blanks)))] if blanks else 0
                some = "".join(str(int(d)) for d in rng.integers(0, 10, int(rng.integers(1, 14))))
                part = part[:at] + (some if rng.integers(2) else f"{some[:3]}.{some[3:5]}") + " " + part[at:]
            part = part[:WINDOW]
            codes[j, : len(part)] = _codes(part)
            for kind, a, b, begins in marks:
                inside = 2 + 2 * KINDS.index(kind)
                tags[j, a : min(b, len(part))] = inside
                if a < len(part):
                    tags[j, a] = inside - 1
        tagger.step(codes, tags, adam, 0.015 if i < steps // 2 else 0.005 if i < steps * 5 // 6 else 0.0015)
    return tagger


def _windows(text: str) -> list[int]:
    """Starts of the overlapping windows that hold a digit or an at sign."""
    half, last = WINDOW // 2, max(0, len(text) - WINDOW + WINDOW // 2 - 1)
    cells = sorted({m.start() // half for m in _TRIGGER.finditer(text)})
    starts = sorted({c for x in cells for c in (x - 1, x) if c >= 0})
    return [c * half for c in starts if c * half <= last or c == 0]


def _joined(windows: dict[int, list[tuple[int, int, int, np.ndarray]]], size: int) -> list[tuple[float, int, int, int]]:
    """(confidence, start, end, kind) of spans in several windows of a text: windows has by start the pieces (kind, start, end, sureness of each character) of each."""
    half, out = WINDOW // 2, []
    for s, pieces in windows.items():
        for kind, low, high, sure in pieces:
            # What begins in the second half of a window begins in the next one too.
            if low == s > 0 or low >= s + half or high < min(s + WINDOW, size) or high == size:
                continue
            parts, at = [(low, high, sure)], s
            while high == at + WINDOW < size:
                at += half
                on = [x for x in windows.get(at, []) if x[0] == kind and x[1] <= high and x[2] > low]
                if not on:
                    break
                _, a, high, sure = max(on, key=lambda x: x[2])
                parts.append((a, high, sure))
            else:
                best = np.zeros(high - low)
                for a, b, sure in parts:
                    a, sure = max(a, low), sure[max(0, low - a) :][: high - max(a, low)]
                    best[a - low : a - low + len(sure)] = np.maximum(best[a - low : a - low + len(sure)], sure)
                out.append((float(best.min()), low, high, kind))
    return out


def model_spans(tagger: Tagger, some: list[str]) -> list[list[tuple[str, int, int]]]:
    """Spans of the tagger in each text, reconciled over its windows; base spans play no part here."""
    half = WINDOW // 2
    places = [(i, s) for i, t in enumerate(some) for s in _windows(t)]
    run = set(places)
    found: list[dict[int, list[tuple[int, int, int, np.ndarray]]]] = [{} for _ in some]
    while places:
        beside = set()
        for lo in range(0, len(places), 1024):
            part = places[lo : lo + 1024]
            codes = np.full((len(part), WINDOW), PAD)
            for j, (i, s) in enumerate(part):
                piece = some[i][s : s + WINDOW]
                codes[j, : len(piece)] = _codes(piece)
            tags, sure = tagger.decode(codes)
            for j in np.flatnonzero(tags.any(axis=1)).tolist():
                i, s = part[j]
                row, size = tags[j], min(WINDOW, len(some[i]) - s)
                for a in np.flatnonzero(row[:size] % 2 == 1).tolist():
                    b = a + 1
                    while b < size and row[b] == row[a] + 1:
                        b += 1
                    before, after = a == 0 and s > 0, b == size and s + size < len(some[i])
                    found[i].setdefault(s, []).append((int(row[a]) // 2, s + a, s + b, sure[j, a:b]))
                    beside |= {(i, s - half)} if before else set()
                    beside |= {(i, s + half)} if after else set()
        # A span that runs out of a window is followed into the next one.
        places = sorted(beside - run)
        run |= beside
    out = []
    for text, windows in zip(some, found, strict=True):
        spans = {(0, -p, a, b, k) for p, a, b, k in _joined(windows, len(text))}
        for s, pieces in windows.items():
            spans |= {(1, -float(p.min()), a, b, k) for k, a, b, p in pieces if (a > s or s == 0) and (b < s + WINDOW or b == len(text))}
        taken: list[tuple[str, int, int]] = []
        for whole, minus, a, b, kind in sorted(spans):
            # A joined span that can't be one hides none of its parts.
            if -minus >= SURE and (whole or _plausible(KINDS[kind], text[a:b])) and all(b <= x or a >= y for _, x, y in taken):
                taken.append((KINDS[kind], a, b))
        out.append(taken)
    return out


def _plausible(kind: str, piece: str) -> bool:
    """A decoded span must look like its kind: enough digits, or an at sign and a dot, spelled out or not."""
    digits = sum("0" <= c <= "9" for c in piece)
    if kind == "email":
        return "@" in piece and "." in piece.split("@")[-1] or bool(_SPELLED.fullmatch(piece)) and bool(re.search("dot", piece, re.I))
    if kind == "ip":
        parts = [p.strip() for p in piece.split(".")]
        return len(parts) == 4 and all(p.isdigit() and p.isascii() and len(p) < 4 and int(p) < 256 for p in parts)
    if kind == "card":
        return 16 <= digits <= 19 and luhn("".join(c for c in piece if "0" <= c <= "9"))
    return 10 <= digits <= 15 and bool(re.search(r"[() .+-]", piece))


def all_spans(tagger: Tagger, some: list[str]) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """(base spans, all spans) of each text, both by kind, then start."""
    out, order = [], {k: i for i, k in enumerate(KINDS)}
    has = [bool(_TRIGGER.search(t)) for t in some]
    decoded = iter(model_spans(tagger, [t for t, h in zip(some, has, strict=True) if h]))
    for t, h in zip(some, has, strict=True):
        if not h:
            out.append(([], []))
            continue
        base, extra = base_spans(t), next(decoded)
        more = [x for x in extra if _plausible(x[0], t[x[1] : x[2]]) and all(x[2] <= a or x[1] >= b for _, a, b in base)]
        out.append((base, sorted(base + more, key=lambda s: (order[s[0]], s[1]))))
    return out


def fitted(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Tagger:
    """A tagger trained on up to ``sample`` texts with a digit or an at sign, about the least by a hash of the text.

    The distinct texts are counted first, and only those with a hash below the cut that leaves about that
    many come to the driver, each once.
    """
    some = docs.where(F.col(text).rlike("[0-9@]")).select(F.col(text).alias("t"))
    ring = 1 << 40
    hashed = some.withColumn("h", F.pmod(F.xxhash64("t"), F.lit(ring)))
    cut = int(ring * min(1.0, 1.5 * (sample + 20) / max(1, hashed.select("h").distinct().count())))
    rows = sorted((r["h"], r["t"]) for r in hashed.where(F.col("h") < cut).dropDuplicates(["h"]).collect())
    return train([t for _, t in rows[:sample]])


def found(docs: DataFrame, tagger: Tagger, text: str = "text", keep_text: bool = False, mask: bool = False) -> DataFrame:
    """docs (without the text unless kept) with n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans; with mask, the text with every span replaced by <KIND>.

    Null and empty texts have no span and the digest of the empty string; a masked null stays
    null. Each row stands alone. Columns with the new names are replaced.
    """
    new = [f"n_{k}" for k in KINDS] + ["base_sha256", "spans"]
    names = [c for c in docs.columns if c not in new and (c != text or keep_text and not mask)]
    base = docs.select(*[F.col(f"`{c}`") for c in names], F.col(text).alias("__text"))
    schema = base.drop("__text").withColumns({n: F.lit(0).cast("long") for n in new[:4]} | {n: F.lit("") for n in new[4:]} | ({text: F.lit(None).cast("string")} if mask else {})).schema
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(len(names)).to_pylist()
            rows: list[tuple] = []
            for lo in range(0, len(raw), 512):
                some = raw[lo : lo + 512]
                for t, (own, every) in zip(some, all_spans(shared.value, [x or "" for x in some]), strict=True):
                    row = [sum(s[0] == k for s in own) for k in KINDS]
                    row.append(sha256(",".join(f"{k}:{a}:{b}" for k, a, b in own).encode()).hexdigest())
                    row.append(",".join(f"{k}:{a}:{b}" for k, a, b in every))
                    if mask:
                        row.append(masked(t, every) if t else t)
                    rows.append(tuple(row))
            kinds = [pa.int64()] * 4 + [pa.string()] * (3 if mask else 2)
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)]
            fields = [batch.schema.field(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names))], *cols], schema=pa.schema([*fields, *zip(new + ([text] if mask else []), kinds, strict=True)]))

    return base.mapInArrow(run, schema)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span replaced by <KIND>; of overlapping spans (a phone in a card) the longest hides all it touches."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])

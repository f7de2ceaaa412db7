"""Pieces of a subword vocabulary, a double-array trie over their bytes, and lattice recursions over many words at once.

A piece is UTF-8 bytes with the white-space marker U+2581. Every word of a batch is laid in one
byte array; the trie is walked from all positions together, one byte a step, and Viterbi and
forward recursions advance all words by one position a step, so the cost per byte is a few
numpy operations rather than a Python loop.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

MARK = "▁"
NONE = -1e300


@dataclass(frozen=True)
class Vocabulary:
    """pieces[i] and scores[i]; byte_ids[b] is the piece of byte b; usable[i]: normal pieces, which the trie holds."""

    pieces: tuple[bytes, ...]
    scores: np.ndarray
    byte_ids: np.ndarray
    usable: np.ndarray

    def __hash__(self) -> int:
        return id(self)


def read(path: str) -> bytes:
    """A model file, read where the driver is; tasks get its bytes by broadcast, so executors need no such file."""
    with open(path, "rb") as f:
        return f.read()


def load(path: str) -> Vocabulary:
    return parsed(read(path))


@lru_cache(maxsize=4)
def parsed(model: bytes) -> Vocabulary:
    """Vocabulary of a SentencePiece model (any model type; its scores are taken as they stand)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    n = sp.get_piece_size()
    pieces = tuple(sp.id_to_piece(i).encode() for i in range(n))
    usable = np.array([not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)])
    byte_ids = np.full(256, -1, np.int64)
    for i in range(n):
        if sp.is_byte(i):
            byte_ids[int(pieces[i][1:-1], 16)] = i
    return Vocabulary(pieces, np.array([sp.get_score(i) for i in range(n)]), byte_ids, usable)


#: A rank r weighs 1 / (r + FLAT), as in Zipf's law flattened at its head.
FLAT = 50


def log_scores(vocabulary: Vocabulary) -> np.ndarray:
    """Log probability of each piece: a unigram model's own scores, or, where the scores are whole numbers (a BPE model's merge ranks), those of the ranks' order; unusable pieces NONE."""
    usable = np.flatnonzero(vocabulary.usable)
    own, out = vocabulary.scores[usable], np.full(len(vocabulary.pieces), NONE)
    if len(own) and (own == np.round(own)).all():
        own = np.empty(len(usable))
        own[np.argsort(-vocabulary.scores[usable], kind="stable")] = -np.log(np.arange(len(usable)) + FLAT)
    out[usable] = own - np.log(np.exp(own).sum()) if len(own) else own
    return out


class DoubleArray:
    """A double-array trie: child of node s by byte b is base[s] + b + 1 where check there is s; value: the piece that ends there, or -1.

    Built level by level; a node takes the first base, from a moving start, where all its children fit.
    """

    def __init__(self, keys: list[bytes], values: list[int]):
        order = sorted(range(len(keys)), key=keys.__getitem__)
        keys, values = [keys[i] for i in order], [values[i] for i in order]
        size = 1 << 14
        base, check, value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        check[0] = 0
        wide, level, self.depth = 1, [(0, 0, len(keys), 0)], 0
        while level:
            following = []
            for node, lo, hi, depth in level:
                if lo < hi and len(keys[lo]) == depth:
                    value[node] = values[lo]
                    lo += 1
                if lo >= hi:
                    continue
                self.depth = max(self.depth, depth + 1)
                cuts, labels = [], []
                for i in range(lo, hi):
                    if not labels or keys[i][depth] != labels[-1]:
                        labels.append(keys[i][depth])
                        cuts.append(i)
                cuts.append(hi)
                labels_at = np.array(labels) + 1
                at = -1
                while at < 0:
                    if wide + 4096 + 300 >= size:
                        base, check, value = np.concatenate([base, np.zeros(size, np.int64)]), np.concatenate([check, np.full(size, -1, np.int64)]), np.concatenate([value, np.full(size, -1, np.int64)])
                        size *= 2
                    slots = wide + np.flatnonzero(check[wide : wide + 4096] < 0)
                    slots = slots[slots >= labels_at[0]]
                    fits = np.flatnonzero((check[slots[:, None] + (labels_at - labels_at[0])] < 0).all(axis=1))
                    if len(fits):
                        at = int(slots[fits[0]] - labels_at[0])
                        if len(slots) < 1024:
                            wide += 512
                    else:
                        wide += 4096
                base[node] = at
                check[at + labels_at] = node
                following += [(at + int(x) + 1, cuts[k], cuts[k + 1], depth + 1) for k, x in enumerate(labels)]
            level = following
        self.base, self.check, self.value = base, check, value

    def walk(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every match that begins at a position of starts and doesn't pass its end: (index into starts, length, piece)."""
        found, at, node = [], np.arange(len(starts)), np.zeros(len(starts), np.int64)
        for step in range(self.depth):
            live = starts[at] + step < ends[at]
            at, node = at[live], node[live]
            if not len(at):
                break
            following = self.base[node] + data[starts[at] + step] + 1
            good = self.check[following] == node
            at, node = at[good], following[good]
            hit = self.value[node] >= 0
            found.append((at[hit], np.full(int(hit.sum()), step + 1), self.value[node[hit]]))
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


@lru_cache(maxsize=4)
def trie(vocabulary: Vocabulary) -> DoubleArray:
    ids = np.flatnonzero(vocabulary.usable).tolist()
    return DoubleArray([vocabulary.pieces[i] for i in ids], ids)


@dataclass
class Lattice:
    """Edges over the character boundaries of many words, sorted by end position, then word.

    Word w spans bytes offsets[w]:offsets[w+1]. source and target are byte positions plus the
    word's number (so that each word has its own start and end node); piece -1 is an unknown
    character, which stands for its bytes.
    """

    source: np.ndarray
    target: np.ndarray
    piece: np.ndarray
    steps: np.ndarray
    word: np.ndarray
    first: np.ndarray
    last: np.ndarray
    nodes: int


def build(vocabulary: Vocabulary, words: list[bytes], known_only: bool = False) -> Lattice:
    """The lattice of each word. A character without a piece of its own gets an unknown edge; with known_only none does."""
    data = np.frombuffer(b"".join(words), np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    word_of = np.repeat(np.arange(len(words)), lengths)
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    at, length, piece = trie(vocabulary).walk(data, heads, offsets[word_of[heads] + 1])
    begin = heads[at]
    # An unknown edge spans one character that no piece matches alone.
    following = np.minimum(np.append(heads[1:], len(data)), offsets[word_of[heads] + 1]) if len(heads) else heads
    char_length = following - heads
    alone = np.zeros(len(heads), bool)
    alone[at[length == char_length[at]]] = True
    lone = np.flatnonzero(~alone) if not known_only else np.zeros(0, np.int64)
    begin = np.concatenate([begin, heads[lone]])
    length = np.concatenate([length, char_length[lone]])
    piece = np.concatenate([piece, np.full(len(lone), -1)])
    word = word_of[begin]
    source, target = begin + word, begin + length + word
    depth = begin + length - offsets[word]
    order = np.lexsort((target, depth))
    return Lattice(source[order], target[order], piece[order], depth[order], word[order], offsets[:-1] + np.arange(len(words)), offsets[1:] + np.arange(len(words)), len(data) + len(words))


def _levels(key: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]]) if len(key) else np.zeros(1, np.int64)


def viterbi(g: Lattice, scores: np.ndarray, unknown: float) -> tuple[list[np.ndarray], np.ndarray]:
    """Best path of each word: (per word the edges' indices from left to right, score). Ties go to the edge with the longest last piece."""
    value = np.where(g.piece >= 0, scores[g.piece], unknown)
    best, back = np.full(g.nodes, NONE), np.full(g.nodes, -1)
    best[g.first] = 0
    cuts = _levels(g.steps)
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        total = best[g.source[lo:hi]] + value[lo:hi]
        groups = _levels(g.target[lo:hi])[:-1]
        top = np.maximum.reduceat(total, groups)
        node = g.target[lo:hi][groups]
        is_top = total == np.repeat(top, np.diff(np.append(groups, hi - lo)))
        length = np.where(is_top, g.target[lo:hi] - g.source[lo:hi], -1)
        longest = np.maximum.reduceat(length, groups)
        winner = np.flatnonzero(length == np.repeat(longest, np.diff(np.append(groups, hi - lo))))
        best[node] = top
        back[g.target[lo:hi][winner]] = winner + lo
    paths, at, alive = [], g.last.copy(), np.flatnonzero(g.last > g.first)
    while len(alive):
        edge = back[at[alive]]
        paths.append((alive, edge))
        at[alive] = g.source[edge]
        alive = alive[at[alive] > g.first[alive]]
    if not paths:
        return [np.zeros(0, np.int64)] * len(g.first), best[g.last]
    which, edges = np.concatenate([p[0] for p in paths[::-1]]), np.concatenate([p[1] for p in paths[::-1]])
    order = np.argsort(which, kind="stable")
    return np.split(edges[order], np.cumsum(np.bincount(which, minlength=len(g.first)))[:-1]), best[g.last]


def _log_sum(total: np.ndarray, groups: np.ndarray) -> np.ndarray:
    top = np.maximum.reduceat(total, groups)
    return top + np.log(np.add.reduceat(np.exp(total - np.repeat(top, np.diff(np.append(groups, len(total))))), groups))


def forward(g: Lattice, logs: np.ndarray, unknown: np.ndarray) -> np.ndarray:
    """Log of the summed weight of all paths to each node (natural logs); unknown[e] is the weight of an unknown edge e."""
    value = np.where(g.piece >= 0, logs[g.piece], unknown)
    alpha = np.full(g.nodes, NONE)
    alpha[g.first] = 0
    cuts = _levels(g.steps)
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        groups = _levels(g.target[lo:hi])[:-1]
        alpha[g.target[lo:hi][groups]] = _log_sum(alpha[g.source[lo:hi]] + value[lo:hi], groups)
    return alpha


def expected(g: Lattice, logs: np.ndarray, unknown: np.ndarray, weights: np.ndarray, size: int) -> tuple[np.ndarray, float, float]:
    """Forward-backward: expected uses of each piece, of unknown edges, and the summed log probability, each word by its weight."""
    value = np.where(g.piece >= 0, logs[g.piece], unknown)
    alpha = forward(g, logs, unknown)
    beta = np.full(g.nodes, NONE)
    beta[g.last] = 0
    start = g.source - g.first[g.word]
    order = np.lexsort((g.source, -start))
    source, target, val, key = g.source[order], g.target[order], value[order], start[order]
    cuts = _levels(key)
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        groups = _levels(source[lo:hi])[:-1]
        beta[source[lo:hi][groups]] = _log_sum(beta[target[lo:hi]] + val[lo:hi], groups)
    whole = alpha[g.last]
    share = np.exp(np.minimum(0, alpha[g.source] + value + beta[g.target] - whole[g.word])) * weights[g.word]
    known = g.piece >= 0
    counts = np.bincount(g.piece[known], share[known], minlength=size)
    return counts, float(share[~known].sum()), float((whole * weights)[g.last > g.first].sum())

"""Phrase collocations, sum-of-squares packing and periodic runs against plain versions."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
from test_operators import AWKWARD, SF, awkward, docs, empty, key  # noqa: F401
from tokenizers import Tokenizer

from orebody.llm import collocation, html_extract, lattice, lm_score, packing, runs, sentpiece, substring
from orebody.llm.queries import QUERIES


def rows_of(df, *names):
    return [tuple(r) for r in df.select(*names).collect()]


def test_op11_equals_dictionaries(spark, docs, awkward, empty):  # noqa: F811
    got = rows_of(QUERIES["op11_phrase_collocations"](spark, SF), "lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert len(got) > 40 and key(got) == key(brute.collocations(rows_of(docs, "lang", "text")))
    odd = awkward.unionByName(awkward.withColumn("lang", awkward["source"].substr(9, 1)))  # the second half's lang is empty
    nulls = odd.selectExpr("IF(lang = '', NULL, lang) AS lang", "text", "1 AS rank", "2 AS phrase", "3 AS id", "4 AS key")
    want = brute.collocations(rows_of(nulls, "lang", "text"), least=3)
    assert {x[0] for x in want} == {"en", "und"}
    assert key(rows_of(collocation.collocations(nulls, least=3), "lang", "rank", "phrase", "a", "l", "r", "n", "score")) == key(want)
    assert collocation.collocations(empty).count() == 0


def test_op11_small_chunks_salts_and_cuts(spark, docs, monkeypatch):  # noqa: F811
    rng = random.Random(5)
    texts = []
    for _ in range(300):
        words = [rng.choice(["Aa", "b", "c", "ß", "É", "dd", "\x00"]) for _ in range(rng.randrange(60))]
        texts.append((rng.choice(["x", None]), "".join(w + rng.choice([" ", "  ", "\t", ".", ", ", "\n", "\x0b", " "]) for w in words)))
    df = spark.createDataFrame(texts, "lang string, text string").repartition(3)
    want = key(brute.collocations(texts, least=10, most=25))
    for name, value in (("CHUNK_WORDS", 50), ("HELD", 40), ("SORTED", 20)):
        monkeypatch.setattr(collocation, name, value)
    assert key(rows_of(collocation.collocations(df, most=25, least=10), "lang", "rank", "phrase", "a", "l", "r", "n", "score")) == want


def test_op11_bitmap_loses_nothing(spark):
    rng = np.random.default_rng(3)
    grams = np.unique(rng.integers(1, 5000, (20_000, 3), dtype=np.uint32), axis=0)
    keys = spark.createDataFrame([(bytearray(g.astype(">u4").tobytes()),) for g in grams], "key binary").repartition(3)
    bitmap = collocation._bitmap(keys, 3)
    assert collocation._passes(bitmap, grams).all()
    assert collocation._passes(bitmap, rng.integers(5000, 9000, (20_000, 3), dtype=np.uint32)).mean() < 0.05


def test_op11_scores_are_exact_beyond_64_bits(spark):
    one, two = (1).to_bytes(4), (2).to_bytes(4)
    a, left, right = 9_000_000_000_007, 9_100_000_000_001, 9_200_000_000_003
    frequent = spark.createDataFrame([(bytearray(one), left), (bytearray(two), right), (bytearray(one + two), a)], "key binary, f long")
    assert [tuple(r)[1:] for r in collocation.scored(frequent).collect()] == [(a, left, right, 2_000_000 * a // (left + right))]


def check_packed(rows, size, lengths):
    """Every piece once, sequences gapless and within the size; returns the number of sequences."""
    by = defaultdict(list)
    pieces = defaultdict(list)
    for d, piece, start, length, _, s, offset in rows:
        by[s].append((offset, length))
        pieces[d].append((piece, start, length))
    for held in by.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= size
    for d, n in lengths.items():
        assert sorted(pieces[d]) == [(k, a, min(size, n - a)) for k, a in enumerate(range(0, n, size))]
    assert len(rows) == sum(-(-n // size) for n in lengths.values())
    return len(by)


COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_op12_pieces_are_those_of_whole_texts(spark, docs):  # noqa: F811
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = QUERIES["op12_sum_of_squares_packing"](spark, SF)
    assert out.columns == COLUMNS
    rows = rows_of(out, *COLUMNS)
    ids = {d: np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for d, x in rows_of(docs, "doc_id", "text")}
    n = check_packed(rows, 2048, {d: len(x) for d, x in ids.items()})
    assert all(crc == zlib.crc32(ids[d][s : s + m].tobytes()) for d, _, s, m, crc, _, _ in rows)
    assert n <= -(-sum(map(len, ids.values())) // 2048) + 1


def test_op12_awkward_rows(spark, awkward, empty):  # noqa: F811
    many = awkward.selectExpr("CAST(doc_id AS STRING) AS doc_id", "text", "1 AS piece", "2 AS ids", "3 AS sequence_id")
    plain = packing.packed(many, size=64, keep_ids=True)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [np.array([*t.encode(x or "", add_special_tokens=False).ids, 0]) for _, x in AWKWARD]
    rows = plain.collect()
    assert len(rows) == sum(-(-len(x) // 64) for x in want)
    by = packing.sequences(plain).collect()
    assert sum(len(r.ids) for r in by) == sum(map(len, want)) and max(len(r.ids) for r in by) <= 64
    first = {r.sequence_id: r for r in by}
    assert all(first[r.sequence_id].ids[r.offset : r.offset + r.length] == r.ids for r in rows)
    odd = ["a\x0bb", "a\x1cb\x85c", "don't it's", "é ́x", "<|endoftext|>x <|startoftext|>", "İ Σς", "  "]
    for x, r in zip(odd, packing.pieces(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").coalesce(1), keep_ids=True).orderBy("doc_id").collect(), strict=True):
        assert r.ids == [*t.encode(x, add_special_tokens=False).ids, 0]
    assert packing.packed(empty).count() == 0


def test_op12_packer_equals_trying_every_place():
    rng = random.Random(2)
    for _ in range(40):
        size = rng.choice([7, 16, 33])
        lengths = [rng.randint(1, size) for _ in range(rng.randrange(60))]
        p = packing.Packer(size)
        for i, n in enumerate(lengths):
            p.add(i, n)
        mine = p.closed + [b for _, b in p.open()]
        total = lambda bins: sorted(sum(lengths[i] for i in b) for b in bins)
        assert total(mine) == total(brute.squares(lengths, size)) and sorted(i for b in mine for i in b) == list(range(len(lengths)))


def test_op12_levels_and_waste(spark, monkeypatch):
    rng = np.random.default_rng(4)
    lengths = np.concatenate([rng.integers(1, 300, 4000), rng.integers(1, 100, 2000)])
    rows = [(i, "a " * (int(n) - 1)) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    monkeypatch.setattr(packing, "FAN", 3)
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 27))
    try:
        got = rows_of(packing.packed(df, size=256), *COLUMNS)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    n = check_packed(got, 256, {i: int(x) for i, x in enumerate(lengths)})
    assert len({r[5] >> 57 for r in got}) > 2  # levels
    assert n <= 1.004 * (lengths.sum() / 256) + 1


def test_op13_equals_all_periods(spark, docs, awkward, empty):  # noqa: F811
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    out = QUERIES["op13_periodic_runs"](spark, SF)
    assert out.columns == names
    got = key(rows_of(out, *names))
    assert got == key(brute.periodic(d, t) for d, t in rows_of(docs, "doc_id", "text"))
    assert sum(r[1] > 0 for r in got) > 15
    clash = awkward.selectExpr("doc_id", "text", "slot AS start", "spans AS runs", "n_chars")
    more = runs.found(clash, plant=True, keep_text=True)
    assert key(rows_of(more, *names)) == key(brute.periodic(d, t) for d, t in AWKWARD)
    assert set(more.columns) == {*names, "runs", "collapsed", "n_chars"}
    assert [r.asDict() for r in more.where("doc_id = 12").first().runs] == [{"start": 0, "length": 50, "period": 1}]
    assert runs.found(empty, plant=True).count() == 0


@pytest.mark.parametrize("batch", [20, 250_000])
def test_op13_runs_of_random_words(monkeypatch, batch):
    monkeypatch.setattr(runs, "BATCH", batch)
    rng = random.Random(1)
    for least, periods in ((24, 3), (4, 2), (6, 3)):
        texts = []
        for _ in range(60):
            words = [rng.choice("ab" if rng.random() < 0.5 else "abcdefgh") for _ in range(rng.randrange(40))]
            for _ in range(rng.randrange(4)):
                cycle = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))]
                words += (cycle * 6)[: rng.randrange(70)]
            texts.append(words)
        f = runs._Found(least, periods)
        for i, w in enumerate(texts):
            f.add(i, [x.encode() for x in w])
        got = f.runs()
        for i, w in enumerate(texts):
            assert [tuple(x) for x in got.get(i, np.zeros((0, 3), int)).tolist()] == brute.runs(w, least, periods)


def test_op13_all_runs_of_fibonacci_words_and_long_texts():
    a, b = "a", "ab"
    while len(b) < 2000:
        a, b = b, b + a
    x = np.array([ord(c) for c in b])
    got = runs.maximal(x, np.full(len(x), len(x)))
    assert [tuple(r) for r in got.tolist()] == brute.runs(b, 1, 2)
    long = np.tile(np.arange(1, 998), 300)
    assert runs.maximal(long, np.full(len(long), len(long))).tolist() == [[0, len(long), 997]]
    assert runs.maximal(np.ones(100_000, np.int64), np.full(100_000, 100_000)).tolist() == [[0, 100_000, 1]]


BODY = "".join(f"<p>Sentence number {i}, with some words, and more words that make a paragraph of length.</p>" for i in range(6))
TEXT = "\n".join(f"Sentence number {i}, with some words, and more words that make a paragraph of length." for i in range(6))


def test_op6_wrappers_siblings_and_lists():
    of = lambda inner: html_extract.main_text(f"<html><body><div class=menu><a href=x>Home</a></div>{inner}<div id=footer>Imprint</div></body></html>")
    assert of(f"<form runat=server><input name=q><button>Go</button><select><option>de</option></select><div id=content><h1>T</h1>{BODY}</div></form>") == "T\n" + TEXT
    assert of(f"<div style='visibility: hidden'><h1>T</h1>{BODY}</div>") == "T\n" + TEXT
    assert of(f"<div><article><h2>A</h2>{BODY}</article><article><h2>B</h2>{BODY}</article><article class=comment>{BODY}</article></div>") == f"A\n{TEXT}\nB\n{TEXT}"
    items = [f"Item {i}, with some words, and more words that make a list entry of length." for i in range(8)]
    assert of("<div><h1>Head</h1><ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul></div>") == "\n".join(["Head", *items])
    # Forms beside the article still go, whatever they say; so does what is not displayed.
    for other in ("<form><p>Sign up for our letter, please, with your address, it is free, and long enough to count.</p><input></form>", "<div style='visibility:hidden'><p>Only for machines, not for you.</p></div>", "<div style='display:none'>" + BODY + "</div>"):
        assert of(f"<article><h1>T</h1>{BODY}</article>{other}") == of(f"<div><h1>T</h1>{BODY}</div>{other}") == "T\n" + TEXT
    assert of(f"<article class=comment>{BODY}</article>") == TEXT


def test_op1_and_op5_need_no_model_file_on_executors(spark, tmp_path):
    """The file is gone before any task runs: only the driver has read it."""
    from orebody.llm.queries import held_out

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["one two", "two three", None, "four"])], "doc_id long, text string").repartition(2)
    for make in (lambda m: sentpiece.digests(rows, model=m), lambda m: sentpiece.encoded(rows, model=m)):
        copy = tmp_path / "a.model"
        copy.write_bytes(lattice.read(sentpiece.MODEL))
        out = make(str(copy))
        copy.unlink()
        assert out.count() == 4 and len(out.collect()) == 4
    (tmp_path / "b.model").write_bytes(lattice.read(sentpiece.MODEL))
    out = lm_score.scored(rows, held_out(7), model=str(tmp_path / "b.model"))
    (tmp_path / "b.model").unlink()
    assert len(out.collect()) == 4


def test_op10_alarms_broadcast_or_joined(docs, monkeypatch):  # noqa: F811
    """With a full sketch there are many false alarms; both ways of bringing them to their texts give the same."""
    monkeypatch.setattr(substring, "MOST_BITS", 12)
    want = key((d, *x) for (d, _), x in zip(rows_of(docs, "doc_id", "text"), brute.substring([t for _, t in rows_of(docs, "doc_id", "text")]), strict=True))
    for few in (0, 1_000_000):
        monkeypatch.setattr(substring, "FEW", few)
        assert key(tuple(r) for r in substring.removals(docs.select("doc_id", "text")).collect()) == want

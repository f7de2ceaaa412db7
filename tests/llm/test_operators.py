"""The corpus operators against plain versions, on the smallest tables and on awkward rows."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from orebody.llm import decontam, html_extract, lang_id, lm_score, neardup, pii, quality, sentpiece, shard, substring
from orebody.llm.queries import QUERIES, held_out

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))
AWKWARD = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "one"), (6, "One two"), (7, LONG), (8, LONG),
    (9, "start " + PASSAGE + " end"), (10, "other " + PASSAGE + " tail"), (10, "other " + PASSAGE + " tail"), (None, "no id here at all"),
    (11, "a b c ▁mark ▁▁ 日本語 \U0001f600 é"), (12, "x " * 50), (13, "\n\nline\nline\n \nline two\nline two\n"), (14, " lead and trail "),
]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(d, t, "en", "s", None, "clash", 1) for d, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string, slot int").repartition(3)


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def key(rows):
    return sorted(rows, key=repr)


def test_op1_base_and_model(docs, awkward, empty):
    for df in (docs, awkward):
        rows = [(d, brute.WORD.findall(brute.lower(t or "")) + [None]) for d, t in pairs(df)]
        out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
        c = Counter(x for d, w in rows if not out(d) for x in w)
        n, v = sum(c.values()), len(c)
        want = key((d, out(d), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 4)) for d, w in rows)
        clashing = df.select("doc_id", "text", *[F.lit(1).alias(c) for c in ("uid", "known", "base", "lp", "rare", "h", "n", "m", "score", "held_out")])
        got = lm_score.scored(clashing, held_out(7), frequent=50).collect()
        assert set(got[0].asDict()) > {"uid", "rare", "score", "word_score"}
        assert key((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lm_score.scored(empty.select("doc_id", "text"), held_out(7)).count() == 0


def test_op1_lattice_sums_all_segmentations(spark):
    from orebody.llm import lattice

    v = lattice.load(sentpiece.MODEL)
    p = lm_score.prior(v)
    pieces = {v.pieces[i]: p[i] for i in range(len(p)) if v.usable[i]}

    def total(word: bytes) -> float:
        memo = [1.0] + [0.0] * len(word)
        for end in range(1, len(word) + 1):
            memo[end] = sum(memo[s] * pieces.get(word[s:end], 0) for s in range(end))
        return memo[-1]

    words = ["the", "thereabouts", "über", "a", "1999", "x" * 40]
    got = lm_score.word_logs(v, p, words)
    for w, g in zip(words, got, strict=True):
        assert math.isclose(g, math.log(total(("▁" + w).encode())), rel_tol=1e-9)
    # Expected counts of the pieces of a word, weighted by their bytes, give its length.
    g, unknown = lm_score._lattice(v, words)
    counts, rest, _ = lattice.expected(g, lm_score._logs(p), unknown, __import__("numpy").ones(len(words)), len(p))
    assert math.isclose(sum(n * len(v.pieces[i]) for i, n in enumerate(counts)) + 0 * rest, sum(len(("▁" + w).encode()) for w in words), rel_tol=1e-6)


def test_op1_scores_match_a_plain_model(spark, docs, awkward):
    """Weights by expectation maximisation and marginals of whole texts, with dictionaries and recursion over characters."""
    from orebody.llm import lattice

    v = lattice.load(sentpiece.MODEL)
    start = lm_score.prior(v)
    pieces = {v.pieces[i]: i for i in range(len(start)) if v.usable[i]}
    for df in (docs.where("doc_id < 40"), awkward):
        rows = pairs(df)
        out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
        words = {d: [] for d, _ in rows}
        texts = [(d, brute.WORD.findall(brute.lower(t or ""))) for d, t in rows]
        counts = Counter(w for d, ws in texts if not out(d) for w in ws)
        ends = sum(not out(d) for d, _ in texts)
        del words

        def edges(word):
            """(from, to, piece or None, log weight of an unknown character) of a word's lattice."""
            raw = ("▁" + word.replace("▁", "\ue000")).encode()
            heads = [i for i in range(len(raw)) if raw[i] & 0xC0 != 0x80] + [len(raw)]
            found = []
            for j, e in enumerate(heads[1:], 1):
                for b in heads[max(0, j - 40) : j]:
                    if raw[b:e] in pieces:
                        found.append((b, e, pieces[raw[b:e]], 0.0))
                if raw[heads[j - 1] : e] not in pieces:
                    found.append((heads[j - 1], e, None, (e - heads[j - 1]) * math.log(lm_score.BYTES / 256)))
            return found, len(raw)

        some = {w: edges(w) for _, ws in texts for w in ws if len(w) < 200}

        def total(word, p):
            found, size = some[word]
            ways = [0.0] * (size + 1)
            ways[0] = 1.0
            for b, e, i, u in found:
                ways[e] += ways[b] * (p[i] if i is not None else math.exp(u))
            return ways

        p, end = start * (1 - lm_score.BYTES) / 2, 0.5
        for _ in range(lm_score.ROUNDS):
            uses = lm_score.PRIOR * start
            for w, n in counts.items():
                found, size = some[w]
                ahead, back = total(w, p), [0.0] * (size + 1)
                back[size] = 1.0
                for b, e, i, u in sorted(found, reverse=True):
                    back[b] += back[e] * (p[i] if i is not None else math.exp(u))
                for b, e, i, _ in found:
                    if i is not None:
                        uses[i] += n * ahead[b] * p[i] * back[e] / ahead[size]
            mass = uses.sum() + ends + 0.5
            p, end = uses / mass * (1 - lm_score.BYTES), (ends + 0.5) / mass * (1 - lm_score.BYTES)
        assert math.isclose(p.sum() + end + lm_score.BYTES, 1, rel_tol=1e-9)
        closing = (ends + 0.5) / (sum(counts.values()) + ends + 1) * (1 - lm_score.BYTES)
        as_they_stand = start * (1 - lm_score.BYTES - closing)
        assert math.isclose(as_they_stand.sum() + closing + lm_score.BYTES, 1, rel_tol=1e-9)
        log = {w: (math.log10(total(w, as_they_stand)[-1]), math.log10(total(w, p)[-1])) for w in some}
        want = key((d, round(sum(log[w][0] for w in ws) + math.log10(closing), 3), round(sum(log[w][1] for w in ws) + math.log10(end), 3)) for d, ws in texts)
        got = lm_score.scored(df.select("doc_id", "text"), held_out(7), frequent=30).collect()
        assert key((r.doc_id, round(r.score, 3), round(r.fitted_score, 3)) for r in got) == want
        assert all(r.word_score < 0 for r in got)


def test_op1_broadcasts_the_most_frequent_words_whatever_their_counts(spark):
    logs = spark.range(1, 5001).selectExpr("id AS h", "id * 1000 AS m")
    least = lm_score._least(logs, 100)
    assert 50 <= logs.where(F.col("m") >= least).count() <= 100
    assert lm_score._least(logs, 5000) == 1000 and lm_score._least(spark.range(0).selectExpr("id AS m"), 5) == 1 << 62


def test_op2_held_out_accuracy_and_edges(spark, docs, awkward, empty):
    model = lang_id.train(docs, ~held_out(4))
    rows = lang_id.predicted(docs, model).where(held_out(4)).collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.95 * len(rows)
    got = {(r.doc_id, r.text): r for r in lang_id.predicted(awkward, model).collect()}
    for (_, t), r in got.items():
        if not t or not re.search(r"[^\W\d_]", t):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred in model.langs and 0 <= r.score <= 1
    assert lang_id.predicted(empty, model).count() == 0
    none = lang_id.train(empty, ~held_out(4))
    assert {r.lang_pred for r in lang_id.predicted(awkward, none).collect()} == {"und"}


def test_op2_does_not_depend_on_neighbours(spark, docs):
    model = lang_id.train(docs, ~held_out(4))
    some = docs.limit(20)
    one = {r.doc_id: r.score for r in lang_id.predicted(some.repartition(1), model).collect()}
    many = {r.doc_id: r.score for r in lang_id.predicted(some.repartition(20), model).collect()}
    assert all(math.isclose(one[d], many[d], rel_tol=1e-9) for d in one)


def test_op3_finds_passages_and_substitutions(spark, docs, awkward, empty):
    tests = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = {(d, i) for d, t in pairs(docs) for i, x in tests.select("item_id", "text").collect() if x in t}
    got = {(r.doc_id, r.item_id) for r in decontam.overlaps(docs, tests).collect()}
    assert want <= got
    item = [f"item{i}" for i in range(40)]
    worn = [("changed" if i % 9 == 4 else w) for i, w in enumerate(item)]
    rows = [(1, "before " * 30 + " ".join(item) + " after"), (2, "before " + " ".join(worn).upper()), (3, " ".join(item[:11])), (4, " ".join(item[::-1])), (5, None), (6, ""), (None, " ".join(item))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    t = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "short item"), (10, " ".join(item[:6]))], "item_id long, text string")
    found = {r.doc_id: r for r in decontam.overlaps(d, t).collect()}
    assert set(found) == {1, 2, None} and (found[1].matched, found[1].start, found[1].span) == (40, 30, 40) and found[2].matched == sum(i % 9 != 4 for i in range(40))
    assert {r.doc_id for r in decontam.clean(d, t).collect()} == {3, 4, 5, 6}
    old, decontam.BROADCAST_ROWS = decontam.BROADCAST_ROWS, 0
    try:
        assert {r.doc_id for r in decontam.overlaps(d, t).collect()} == {1, 2, None}
    finally:
        decontam.BROADCAST_ROWS = old
    assert decontam.overlaps(empty, tests).count() == 0 == decontam.overlaps(awkward, tests.limit(0)).count()


PERSONAL = [
    "mail a.b+c@x-y.example.com. and c_d@e.f@g.h, @no.tld x@y", "1.2.3.4 256.1.1.1 1.2.3.4.5 001.02.3.4 9999999999.1.1.1 1..2.3.4",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111", "+1 (212) 555-0100 +123 +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6-7 ++49 30 1234567",
    "é 1.2.3.4 日本 a@b.cd \U0001f600 +4930123456", "1" * 5000, "a@" * 3000 + "b.c", "-5 4-4- 4 4", "",
]


@pytest.mark.parametrize("text", PERSONAL)
def test_op4_base_spans(text):
    assert pii.base_spans(text) == brute.personal(text)


def test_op4_random_base_spans():
    r = random.Random(4)
    for _ in range(3000):
        t = "".join(r.choice("0123456789..--  @@ab+()") for _ in range(r.randrange(60)))
        assert pii.base_spans(t) == brute.personal(t), t


def test_op4_tagger(spark, docs, awkward, empty):
    tagger = pii.fitted(docs)
    planted = ["the phone is +1 (212) 555-0100 and so on", "write to jane.42@mail3.example.com please", "card 4111 1111 1111 1111 was used", "from 10.20.30.40 it came"]
    spans = pii.model_spans(tagger, [("and then it was said that " * 3) + p for p in planted])
    assert sum(bool(s) for s in spans) >= 3
    for base, every in pii.all_spans(tagger, [t or "" for _, t in AWKWARD] + planted):
        assert set(base) <= set(every)
        extra = [s for s in every if s not in base]
        assert all(b <= x or a >= y for _, a, b in extra for _, x, y in base)
    rows = pii.found(awkward, tagger).collect()
    assert len(rows) == len(AWKWARD) and {r.doc_id for r in rows} == {d for d, _ in AWKWARD}
    got = {(r.doc_id, r.text) for r in pii.found(spark.createDataFrame([(1, planted[0]), (2, None)], "doc_id long, text string"), tagger, mask=True).collect()}
    assert got == {(1, "the phone is <PHONE> and so on"), (2, None)}
    assert pii.found(empty, tagger).count() == 0


HARD = {
    "email": ["jane.doe at example dot org", "k_miller [at] mail3 [dot] example [dot] com", "info (at) shop (dot) example (dot) net", "peter @ example . org", "first.last @ department.example.org"],
    "ip": ["10 . 20 . 30 . 40", "192 . 168 . 7 . 1"],
    "card": ["4111.1111.1111.1111", "5500.0000.0000.0004"],
    "phone": ["(212) 555-0100", "212-555-0100", "(030) 123-4567"],
}


def test_op4_adds_hard_spans_and_little_else(docs):
    """What the patterns miss, planted into texts of the table; and the same texts without it."""
    tagger = pii.fitted(docs)
    rng = random.Random(4)
    plain = [t for _, t in pairs(docs) if t and not pii._TRIGGER.search(t) and len(t.split()) > 60]
    found, planted = Counter(), Counter()
    some, want = [], []
    for kind, forms in HARD.items():
        for form in forms:
            assert not any(k == kind and b - a == len(form) for k, a, b in pii.base_spans(form))
            for _ in range(20):
                words = rng.choice(plain).split()
                at = rng.randrange(10, 50)
                before = " ".join(words[:at]) + " "
                some.append(before + form + " " + " ".join(words[at:]))
                want.append((kind, form, len(before), len(before) + len(form)))
    for (kind, form, a, b), (_, every) in zip(want, pii.all_spans(tagger, some), strict=True):
        planted[kind] += 1
        found[kind] += any(k == kind and min(y, b) - max(x, a) >= 0.8 * (b - a) for k, x, y in every)
    print({k: f"{found[k]}/{planted[k]}" for k in planted})
    assert sum(found.values()) >= 0.75 * sum(planted.values())
    assert all(not every for _, every in pii.all_spans(tagger, plain))
    numbers = [" ".join(w if rng.random() > 0.1 else str(rng.randrange(10_000)) for w in t.split()) for t in plain]
    assert sum(len(every) - len(base) for base, every in pii.all_spans(tagger, numbers)) <= 0.01 * sum(map(len, map(str.split, numbers)))


def test_op4_gradients_match_differences():
    import numpy as np

    t = pii.Tagger(embed=3, hidden=2)
    codes = np.array([[6, 7, 1, 1, 0], [2, 1, 8, 30, 31]])
    tags = np.array([[0, 0, 1, 2, 0], [3, 4, 4, 0, 5]])
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}

    def loss():
        em = t.emissions(codes)
        mask = codes != 0
        _, _, z, tr = t._marginals(em, mask)
        gold = sum((em[i, j, tags[i, j]] + (tr[tags[i, j - 1], tags[i, j]] if j else 0)) * mask[i, j] for i in range(2) for j in range(5))
        return (z.sum() - gold) / 2

    before = {k: v.copy() for k, v in t.p.items()}
    adam = {}
    t.step(codes, tags, adam, 0.0)
    for name in before:
        grad = adam[name][0] / 0.1
        flat = np.argsort(-np.abs(grad).ravel())[:2]
        for i in flat:
            at = np.unravel_index(i, grad.shape)
            t.p[name][at] += 1e-4
            up = loss()
            t.p[name][at] -= 2e-4
            down = loss()
            t.p[name][at] += 1e-4
            assert abs((up - down) / 2e-4 - grad[at]) < 2e-2 * max(1, abs(grad[at])), name


def test_op5_round_trip_and_best_path(spark, docs, awkward, empty):
    import numpy as np

    for df in (docs, awkward):
        for r in sentpiece.encoded(df).collect():
            assert r.decoded == r.text and (r.pieces is None) == (r.text is None)
    assert sentpiece.encoded(empty).count() == 0
    from orebody.llm import lattice

    codec = sentpiece.Codec(lattice.load(sentpiece.MODEL))
    v, s = codec.vocabulary, codec.scores
    known = {v.pieces[i].decode(): i for i in range(len(s)) if v.usable[i]}

    def best(t: str) -> float:
        """Viterbi over a whole text, character by character."""
        x = "".join(c if c != "▁" else "\0" for c in " " + t).replace(" ", "▁")
        score = [0.0] + [-1e18] * len(x)
        for end in range(1, len(x) + 1):
            if x[end - 1] not in known:
                score[end] = score[end - 1] + codec.unknown
            for start in range(max(0, end - 48), end):
                if (i := known.get(x[start:end])) is not None:
                    score[end] = max(score[end], score[start] + s[i])
        return score[-1]

    def of(ids: list[int]) -> float:
        """Score of ids; the bytes of an unknown character count once."""
        out, pending = 0.0, b""
        for i in ids:
            if codec.is_byte[i]:
                pending += codec.plain[i]
                try:
                    pending.decode()
                except UnicodeDecodeError:
                    continue
                out, pending = out + codec.unknown, b""
            else:
                out += s[i]
        return out

    for t in [t for _, t in pairs(docs.limit(15))] + ["a  b   c", "x\n\ny ▁z", "日本語 \U0001f600 ok", " "]:
        t = t[:1500]
        ids = np.frombuffer(codec.encode([t])[0], "<i4").tolist()
        assert math.isclose(of(ids), best(t), rel_tol=1e-9)
    assert [v.pieces[i].decode() for i in np.frombuffer(codec.encode(["the"])[0], "<i4")] == ["▁the"]


def test_op5_trie_holds_exactly_its_keys():
    import numpy as np

    from orebody.llm import lattice

    r = random.Random(5)
    keys = sorted({bytes(r.choice(b"abc\xff\x00") for _ in range(r.randrange(1, 7))) for _ in range(500)})
    t = lattice.DoubleArray(keys, list(range(len(keys))))
    data = np.frombuffer(bytes(r.choice(b"abc\xff\x00") for _ in range(3000)), np.uint8)
    at, length, value = t.walk(data, np.arange(3000), np.full(3000, 3000))
    raw = data.tobytes()
    want = {(i, len(k), j) for j, k in enumerate(keys) for i in range(3000) if raw.startswith(k, i)}
    assert set(zip(at.tolist(), length.tolist(), value.tolist(), strict=True)) == want


def page(body: str) -> str:
    return f"<html><head><title>t</title><style>p{{}}</style></head><body>{body}</body></html>"


PAGES = [
    (None, ""), ("", ""), ("just text", "just text"), ("<p>unclosed <b>bold<br>next<p>second &amp; third&nbsp;x", "unclosed bold next\nsecond & third x"),
    (page("<nav><a href=x>Home</a></nav><article><h1>T</h1><p>One,  two\n three.</p><script>var a='</p>';</script><p>Four.</p></article><footer>f</footer>"), "T\nOne, two three.\nFour."),
    (page("<div class='cookie-notice'>We use cookies, many of them, really a lot</div><div id=main><div class=post><p>Long enough paragraph, with commas, and more.</p><p>Another paragraph, also good.</p></div><div class=comments><p>I disagree, strongly, with all of this, dear author.</p></div></div><aside>side</aside>"), "Long enough paragraph, with commas, and more.\nAnother paragraph, also good."),
    (page("<div class='layout has-sidebar'><div class='post'><p>Kept text, of some length, here.</p></div><div class='right-sidebar'><p>Dropped text, of some length too, yes.</p></div></div>"), "Kept text, of some length, here."),
    (page("<article><p>Text one.<p>See <a href=x>a link</a> in text.</p><div class='share-buttons'>Share</div></article><section id='comments'><p>Nice post, thanks, really.</p></section><p>stray"), "Text one.\nSee a link in text."),
    (page("<form><p>Name, please</p></form><main><p>Main text.</p><ul><li>point one</li><li>point two</li></ul><!-- <p>no</p> --></main>"), "Main text.\npoint one\npoint two"),
]


@pytest.mark.parametrize("source, want", PAGES)
def test_op6_pages(source, want):
    assert html_extract.main_text(source) == want


ARTICLE = "<h1>Title here</h1><p>The first paragraph, which is long enough, says something.</p><p>The second one, shorter, too.</p>"
ARTICLE_TEXT = "Title here\nThe first paragraph, which is long enough, says something.\nThe second one, shorter, too."


@pytest.mark.parametrize("name", ["overflow-hidden", "text-search", "post-header", "article-comment", "site ads-free", "has-sidebar", "comments", "content banner"])
def test_op6_a_name_does_not_lose_the_article(name):
    assert html_extract.main_text(page(f"<nav>Menu</nav><div class='{name}'>{ARTICLE}</div><div class='sidebar'>Other things, of no matter.</div>")) == ARTICLE_TEXT
    assert html_extract.main_text(page(f"<div class='{name}'><article>{ARTICLE}</article></div><div class='ad'>Buy, buy, buy now</div>")) == ARTICLE_TEXT


@pytest.mark.parametrize("name", ["comments", "post-comments", "sidebar", "right-sidebar", "cookie-banner", "ad", "related", "visually-hidden", "newsletter-signup"])
def test_op6_names_still_take_out(name):
    assert html_extract.main_text(page(f"<div id='main'><div class='post'>{ARTICLE}</div><div class='{name}'><p>Something else, of some length, yes.</p></div></div>")) == ARTICLE_TEXT
    assert html_extract.main_text(page(f"<article>{ARTICLE}<div class='{name}'>Something else, of some length, yes.</div></article>")) == ARTICLE_TEXT


def test_op6_time_is_in_proportion_to_the_page():
    import time

    hostile = lambda n: ["<div>" * n + "text" + "</p>" * n, "<a \"" * n, "<a =\">\" " * n, "<p class=" + "a" * n, "<li>" * n + "x", "<div " + "b" * n + ">" + "y" * 9, "<" * n, "<!" * n, "<ul><li>" * n + "<p>t</ul>" * n]
    for small, large in zip(hostile(2_000), hostile(32_000), strict=True):
        began = time.process_time()
        html_extract.main_text(small)
        middle = time.process_time()
        html_extract.main_text(large)
        assert time.process_time() - middle < 64 * max(middle - began, 0.005), small[:20]


def test_op6_articles_come_through_what_surrounds_them():
    """Pages written around known paragraphs, in several layouts: each article comes back whole."""
    r = random.Random(6)
    sentence = lambda: " ".join(r.choice(["stone", "river", "garden", "window", "quiet", "market", "winter"]) for _ in range(r.randrange(6, 18))) + r.choice([", and more.", ".", ", it was said."])
    for i in range(60):
        paragraphs = [" ".join(sentence() for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(3, 9))]
        body = "".join(f"<p>{p.replace('river', '<b>river</b>')}</p>" for p in paragraphs)
        links = "<ul>" + "".join(f"<li><a href='/{j}'>{sentence()}</a></li>" for j in range(r.randrange(2, 9))) + "</ul>"
        wrapper = r.choice(["article", "main", "div class='post-body'", "div id='content'", "section", "div class='no-ads wide'", "td"])
        inner = f"<{wrapper}>{body}</{wrapper.split()[0]}>"
        inner = f"<table><tr><td>{links}</td>{inner}</tr></table>" if wrapper == "td" else inner
        text = page(f"<div class='top-menu'>{links}</div><div class='wrap'>{inner}<div class='{r.choice(['sidebar', 'related-posts', 'comments'])}'><p>{sentence()}</p></div>{links}</div><footer>{sentence()}</footer>")
        assert html_extract.main_text(text) == "\n".join(paragraphs), i


def test_op6_edges(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extracted(none).count() == 0
    long = "<p>" + "word, " * 200_000 + "</p>"
    got = html_extract.extracted(spark.createDataFrame([(1, long), (1, long), (None, None)], "page_id long, html string")).collect()
    assert sorted(r.n_chars for r in got) == [0, 1_199_999, 1_199_999]


def test_op6_query(spark):
    rows = QUERIES["op6_html_extract"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count() and all(r.n_chars == len(r.text) for r in rows)
    df = spark.createDataFrame([(1, None, "x"), (1, "<p>a", "y")], "page_id long, html string, text string")
    assert sorted((r.text, r.n_chars) for r in html_extract.extracted(df).collect()) == [("", 0), ("a", 1)]


def test_op7_counts(docs, awkward, empty):
    for df in (docs, awkward):
        want = key((d, *brute.quality(t)) for d, t in pairs(df))
        assert key(tuple(r) for r in quality.features(df.select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()) == want
    assert quality.features(empty).count() == 0


def test_op7_thresholds_hold_their_bound(spark):
    from math import comb

    tail = spark.createDataFrame([(k, n) for k in (0, 1, 5, 40) for n in (50, 100)], "k long, n long")
    for r in tail.select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), 0.05).alias("p")).collect():
        assert math.isclose(r.p, sum(comb(r.n, i) * 0.05**i * 0.95 ** (r.n - i) for i in range(r.k + 1)), rel_tol=1e-9)
    r = random.Random(1)
    rows = [("a", 100, 500, r.choice([0, 0, 0, 3]) if good else 200, 0, 0, int(good)) for good in [True] * 4000 + [False] * 500]
    rows += [("few", 100, 500, 300, 0, 0, 1)] * 5 + [("a", 100, 500, 0, 0, 0, None)]
    df = spark.createDataFrame(rows, "lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, quality int")
    cut = {(x.stratum, x.feature): x.cutoff for x in quality.thresholds(df, "lang").collect()}
    assert cut["a", "symbol_share"] == 0.01 and cut["few", "symbol_share"] == math.inf
    out = quality.verdicts(df, quality.thresholds(df, "lang"), "lang").where("lang = 'a'")
    assert out.where("quality = 1 and not kept").count() <= 0.01 * 4000 and out.where("quality = 0 and kept").count() == 0


def test_op8_classes(docs, awkward, empty):
    small = [(i, " ".join(f"t{(i // 7) * 1000 + j}" for j in range(60)) + f" tail{i % 7}") for i in range(210)]
    spark = docs.sparkSession
    chain = [(1000 + i, " ".join(f"c{j}" for j in range(i * 3, i * 3 + 60))) for i in range(12)]
    star = [(2000 + i, " ".join(f"s{j}" if j % 25 != i % 25 else f"s{j}v{i}" for j in range(100))) for i in range(60)]
    for df, most in ((docs, 5000), (spark.createDataFrame(small + chain + star, "doc_id long, text string"), 5000), (spark.createDataFrame(small + chain + star, "doc_id long, text string"), 9)):
        want = brute.near(pairs(df))
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, most=most).collect()}
        assert got == want
    got = neardup.near_duplicates(awkward).collect()
    assert len(got) == len(AWKWARD)
    by = {(r.doc_id, r.n_shingles): r for r in got}
    assert by[1, 0].component_id == 1 and by[2, 0].kept and by[5, 1].component_id == 4 and not by[8, len(brute.shingle_set(LONG))].kept
    assert neardup.near_duplicates(empty).count() == 0
    kept = [(r.doc_id, r.text) for r in neardup.representatives(awkward).collect()]
    assert key(kept) == key([x for i, x in enumerate(AWKWARD) if x[0] not in (5, 8, 10)])


@pytest.mark.parametrize("shards", [3, 40])
def test_op9_shards(docs, awkward, empty, shards):
    for df in (docs, awkward):
        rows = shard.assign(df, shards).select("doc_id", "text", "size", "text_crc32", "shard", "slot").collect()
        assert len(rows) == df.count()
        by, load, where = {}, Counter(), {}
        for r in rows:
            raw = (r.text or "").encode()
            assert r.size == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw)
            by.setdefault(r.shard, []).append(r.slot)
            load[r.shard] += r.size
            assert where.setdefault(r.text, r.shard) == r.shard
        assert all(sorted(x) == list(range(len(x))) for x in by.values()) and set(by) <= set(range(shards))
    assert shard.assign(empty, shards).count() == 0


def test_op9_schedule_is_longest_first():
    assert shard.schedule([(0, 7), (1, 7), (2, 6), (3, 6), (4, 5)], 2) == {0: 0, 1: 1, 2: 0, 3: 1, 4: 0}


def test_op9_near_equal_and_split(docs):
    big = docs.select("doc_id", "text").union(docs.sparkSession.range(0, 300).selectExpr("id + 10000", "'same text'"))
    rows = shard.assign(big, 4).collect()
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    largest = max(max(len((r.text or "").encode()) + 16 for r in rows), 300 * 25)
    assert max(load.values()) - min(load.values()) <= largest
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_op9_rows_equal_in_everything_are_split(spark, tmp_path):
    spark.range(0, 2000, 1, 4).selectExpr("1L AS doc_id", "'one text' AS text").write.parquet(f"{tmp_path}/same")
    out = shard.assign(spark.read.parquet(f"{tmp_path}/same"), 3)
    rows = out.collect()
    assert {r.shard for r in rows} == {rows[0].shard} and sorted(r.slot for r in rows) == list(range(2000))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "__piece" in plan


def test_op8_pairs_among_template_pages(spark):
    """Texts of one template at similarity about 0.5, and pairs among them at 0.8 or a little more: every pair is linked, nothing else."""
    r = random.Random(8)
    head = [f"t{i}" for i in range(60)]
    rows, pairs_of = [], []
    for i in range(3000):
        own = [f"p{i}w{j}" for j in range(30)]
        rows.append((i, " ".join(head + own)))
        if i < 150:
            changed = list(own)
            for j in r.sample(range(0, 30, 3), 4):
                changed[j] = f"q{i}w{j}"
            rows.append((10_000 + i, " ".join(head + changed)))
            pairs_of.append((i, 10_000 + i))
    a, b = brute.shingle_set(rows[0][1]), brute.shingle_set(rows[1][1])
    assert 0.8 <= len(a & b) / len(a | b) < 0.85
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[y] == x for x, y in pairs_of) and all(got[d] == d for d, _ in rows if d < 10_000)


def test_op8_ids_of_any_type_and_bulky_groups(spark, monkeypatch):
    base = [f"w{j}" for j in range(200)]
    rows = [(f"d{i:03}", " ".join(w if j != i else f"x{i}" for j, w in enumerate(base))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    links = neardup.links
    monkeypatch.setattr(neardup, "links", lambda *a: links(*a, bulk=2_000))
    assert {x.component_id for x in neardup.near_duplicates(df).collect()} == {"d000"}
    assert [x.doc_id for x in neardup.representatives(df).collect()] == ["d000"]
    assert sorted(x.doc_id for x in sentpiece.digests(df).collect()) == [d for d, _ in rows]


def test_joins_on_heavy_keys(spark, tmp_path):
    from orebody.llm.common import join_unique

    spark.range(0, 1000).selectExpr("IF(id < 900, 7L, IF(id < 990, id, NULL)) AS k", "id").write.parquet(f"{tmp_path}/left")
    left, right = spark.read.parquet(f"{tmp_path}/left"), spark.range(0, 980).selectExpr("id AS k", "id * 2 AS v")
    for how in ("inner", "left"):
        got, want = join_unique(left, right, "k", how), left.join(right, "k", how)
        assert key(map(tuple, got.collect())) == key(map(tuple, want.select(got.columns).collect()))


@pytest.mark.parametrize("length", [35, 3])
def test_op10_removals(docs, awkward, empty, length):
    for df in (docs, awkward):
        rows = pairs(df)
        want = key((d, *x) for (d, _), x in zip(rows, brute.substring([t for _, t in rows], length), strict=True))
        got = substring.removals(df.select("doc_id", "text"), length=length, keep_text=True)
        assert key(tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == want
    assert substring.removals(empty).count() == 0


def test_op10_loses_none_when_the_sketch_is_full(docs, monkeypatch):
    monkeypatch.setattr(substring, "MOST_BITS", 12)
    rows = pairs(docs)
    got = substring.removals(docs.select("doc_id", "text")).collect()
    assert key(tuple(r) for r in got) == key((d, *x) for (d, _), x in zip(rows, brute.substring([t for _, t in rows]), strict=True))


def test_pipeline_keeps_clean_documents(spark, docs):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    out = corpus_pipeline.run(spark, SF).collect()
    rows = dict(pairs(docs))
    tests = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    # The stage takes five words, not the two of op8's contract.
    classes = brute.near(list(rows.items()), 5)
    want = {d for d, t in rows.items() if t and classes[d][1] == d and not any(x in t for x in tests)}
    got = {r.doc_id: r for r in out}
    assert want == set(got)
    for d, r in got.items():
        masks = Counter(re.findall("<(EMAIL|IP|CARD|PHONE)>", r.text))
        assert sum(masks.values()) >= (1 if brute.personal(rows[d]) else 0)
        assert not brute.personal(r.text) and r.n_pieces == len(r.pieces)


def test_pipeline_on_awkward_and_empty_tables(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from pyspark.sql import types as T

    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    item = "benchmark item of quite a few words that a text must not hold at all here"
    for n, rows in enumerate(([], [(d, t, "en", "s", None) for d, t in AWKWARD] + [(20, "before " + item + " after", None, None, 1)])):
        sf = f"{tmp_path}/{n}"
        spark.createDataFrame(rows, T.StructType([T.StructField(f.name, f.dataType) for f in schema])).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        out = corpus_pipeline.run(spark, sf).collect()
        kept = {r.doc_id for r in out}
        # Texts without a letter go; of copies and near copies (9 and 10) one stays; the passage goes.
        assert kept == ({4, 6, 7, 9, None, 11, 12, 13, 14} if rows else set())
        assert all(r.n_pieces == len(r.pieces) for r in out)


def test_pipeline_near_duplicates_are_on_five_words(spark, docs):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")

    def five(t):
        w = brute.WORD.findall(brute.lower(t or ""))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    # A word changed every 25th: 0.85 on two words, 0.67 on five. Texts of fewer than five words are one shingle.
    base = [f"s{j}" for j in range(200)]
    apart = [(9000, " ".join(base)), (9001, " ".join(w if j % 25 != 12 else "x" for j, w in enumerate(base)))]
    short = [(9002, "a b c"), (9003, "A b  c"), (9004, "a b d"), (9005, "a b c d"), (9006, "b a c"), (9007, "a b c d e")]
    for rows in (pairs(docs), apart + short):
        root = {d: d for d, _ in rows}
        sets = sorted(((d, five(t)) for d, t in rows if five(t)), key=lambda x: len(x[1]))
        for i, (a, s) in enumerate(sets):
            for b, t in sets[i + 1 :]:
                if len(t) * 80 > 100 * len(s):
                    break
                if root[a] != root[b] and 100 * len(s & t) >= 80 * len(s | t):
                    low, high = sorted((root[a], root[b]))
                    root = {d: low if r == high else r for d, r in root.items()}
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, SF).collect()}
        assert got == {d for d, r in root.items() if d == r}


def test_op3_every_accepted_stretch_has_a_seed(spark):
    # Up to its 12th equal word, every part from the start of an accepted stretch scores above 0.
    patterns, open_ends = [], [((1,), 1)]
    while open_ends:
        p, score = open_ends.pop()
        if sum(p) == 12:
            patterns.append(p)
            continue
        open_ends.append((p + (1,), score + decontam.EQUAL))
        if score + decontam.UNEQUAL > 0:
            open_ends.append((p + (0,), score + decontam.UNEQUAL))
    seeded = lambda p: any(all(p[i + j] for j in m) for m in decontam.MASKS for i in range(len(p) - m[-1]))
    assert len(patterns) == 728 and all(map(seeded, patterns))
    # As texts: the item in each pattern with nothing beside it, and a long one with every sixth word changed.
    ends_best = lambda p: all(sum(3 * x - 2 for x in p[i:]) > 0 for i in range(1, len(p)))
    some = [p for p in patterns if ends_best(p)] + [tuple(int(i % 6 != 5) for i in range(60))]
    items = [(i, " ".join(f"i{i}w{j}" for j in range(len(p)))) for i, p in enumerate(some)]
    worn = [(i, " ".join(f"i{i}w{j}" if x else "changed" for j, x in enumerate(p))) for i, p in enumerate(some)]
    got = decontam.overlaps(spark.createDataFrame(worn, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.matched) for r in got} == {(i, i, sum(p)) for i, p in enumerate(some)}


def test_op2_threshold_is_the_conformal_quantile(spark):
    # 1,998 scores: the first from below; 1,999: the second. No constant bounds it, and 998 are too few.
    high = {50_000: 1, 60_000: 1}
    assert lang_id.threshold(high | {65_000: 1996}) == 50_000 / lang_id.BINS and lang_id.threshold(high | {65_000: 1997}) == 60_000 / lang_id.BINS
    assert lang_id.threshold({60_000: 998}) == 0.0 and lang_id.threshold({60_000: 999}) == 60_000 / lang_id.BINS and lang_id.threshold({}) == 0.0


def test_op2_calibrates_on_all_texts_that_were_not_fitted(spark):
    # Two languages, more texts than FIT and CALIBRATE hold, each text three times; then too few.
    words = {"aa": ["bana", "kolo", "mite", "sura", "pelo"], "bb": ["thrx", "wyzz", "krqw", "jhgf", "zzxv"]}
    rows = [(" ".join([words[x][i % 5], words[x][i // 5 % 5], words[x][i // 25 % 5], f"n{i}"]), x) for x in words for i in range(1000)]
    df = spark.createDataFrame(rows * 3, "text string, lang string")
    model = lang_id.train(df, F.lit(True))
    assert model.calibrated >= 999 and model.threshold > 0
    out = lang_id.predicted(df.distinct(), model).where("rejected or score < 0").count()
    assert out <= 2
    few = lang_id.train(df.where(F.col("text").rlike("n[0-9]{1,2}$")), F.lit(True))
    assert few.calibrated < 999 and few.threshold == 0.0


def test_op2_training_does_not_run_away(spark):
    model = lang_id.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), ~held_out(4))
    assert np.abs(model.scores).max() < 1e4 and 0 < model.threshold < 1 and 0.2 < model.temperature < 20


def test_samples_are_not_starved_by_copies(spark, monkeypatch):
    # 300 texts of the language stand beside 200,000 copies of one; all are fitted on or calibrate.
    copies = spark.range(0, 200_000).selectExpr("'the same text 5 again' AS text", "'en' AS lang")
    rest = spark.range(0, 300).selectExpr("concat('text number ', id) AS text", "'en' AS lang")
    other = spark.range(0, 300).selectExpr("concat('autre texte ', id) AS text", "'fr' AS lang")
    df = copies.union(rest).union(other)
    seen = []
    monkeypatch.setattr(lang_id, "fit", lambda rows, held: seen.append(Counter(x for _, x in rows + held)) or lang_id.Model([], np.zeros((1, 0), np.float32), np.zeros(0)))
    lang_id.train(df, F.lit(True))
    assert seen == [Counter({"en": 301, "fr": 300})]
    monkeypatch.setattr(pii, "train", lambda texts: len(texts))
    assert pii.fitted(df) == pii.SAMPLE


def test_op4_spans_longer_than_half_a_window(docs):
    texts = sorted({t for _, t in pairs(docs) if t and pii._TRIGGER.search(t)})
    tagger, rng = pii.train(texts), random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 10)))
    blank = [w for _, t in pairs(docs) if t for w in t.split() if w.isalpha()]
    around = lambda: " ".join(rng.choice(blank) for _ in range(rng.randint(5, 20)))
    for low, high in ((33, 45), (46, 64), (65, 90)):
        some, want = [], []
        while len(some) < 100:
            mail = f"{'.'.join(word() for _ in range(rng.randint(1, 4)))} @ {'.'.join(word() for _ in range(rng.randint(1, 6)))}.example.org"
            if low <= len(mail) <= high:
                before = around() + " "
                some.append(f"{before}{mail} {around()}")
                want.append(("email", len(before), len(before) + len(mail)))
        every = [x for _, x in pii.all_spans(tagger, some)]
        assert sum(x in spans for x, spans in zip(want, every, strict=True)) >= 75


def _plain_overlaps(docs, items, least=12):
    """{(doc, item): most equal words of an accepted stretch}: every item laid on every diagonal of every text."""
    out = {}
    cut = lambda t: brute.WORD.findall((t or "").lower())
    for i, x in items:
        item = cut(x)
        if len(item) < decontam.SHORTEST:
            continue
        where = {}
        for j, w in enumerate(item):
            where.setdefault(w, []).append(j)
        for d, t in docs:
            text = cut(t)
            equal = Counter(p - j for p, w in enumerate(text) for j in where.get(w, ()))
            for start, n in equal.items():
                if n < min(least, len(item)):
                    continue
                run, count, best, found = 0, 0, 0, 0
                for j, w in enumerate(item):
                    same = 0 <= start + j < len(text) and text[start + j] == w
                    if run <= 0:
                        run, count = 0, 0
                    run, count = run + (1 if same else -2), count + same
                    if run > best:
                        best, found = run, count
                if found >= min(least, len(item)):
                    out[d, i] = max(out.get((d, i), 0), found)
    return out


@pytest.mark.parametrize("limit", [500_000, 0])
def test_op3_matches_a_plain_search(spark, docs, monkeypatch, limit):
    """Both forms, with short items and worn passages, against every item on every diagonal."""
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(decontam, "BITMAP_ROWS", 1 << 10)
    r = random.Random(3)
    tests = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(x.item_id, x.text) for x in tests.select("item_id", "text").collect()] + [(900 + n, " ".join(f"s{n}w{j}" for j in range(n))) for n in range(4, 15)]
    rows = pairs(docs)
    for k in range(120):
        words = r.choice(items)[1].split()
        worn = [("other" if r.random() < 0.12 else w) for w in words]
        lo = r.randrange(0, max(1, len(worn) - 8))
        rows.append((5000 + k, " ".join(["so", "it", "goes"] * r.randrange(4) + worn[lo:] + ["and", "on"])))
    want = _plain_overlaps(rows, items)
    some = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = decontam.overlaps(some, spark.createDataFrame(items, "item_id long, text string"))
    assert {(x.doc_id, x.item_id): x.matched for x in got.collect()} == want and len(want) > 60


def test_op3_rows_that_share_an_id_stand_alone(spark):
    item = [f"item{i}" for i in range(40)]
    whole, weak = " ".join(item), " ".join(w if i in range(7) else f"other{i}" for i, w in enumerate(item))
    d = spark.createDataFrame([(x, t) for x in (None, 1) for t in (weak, whole, "clean text of few words", None)] + [(2, weak)], "doc_id long, text string").repartition(1)
    t = spark.createDataFrame([(7, whole)], "item_id long, text string")
    assert {(r.doc_id, r.matched, r.start) for r in decontam.overlaps(d, t).collect()} == {(None, 40, 0), (1, 40, 0)}
    kept = [(r.doc_id, r.text) for r in decontam.clean(d, t).collect()]
    assert key(kept) == key([(x, t) for x in (None, 1) for t in (weak, "clean text of few words", None)] + [(2, weak)])


def _plain_cutoffs(rows, alpha=quality.ALPHA, delta=quality.DELTA):
    """{stratum: {feature: cutoff}} from rows (stratum, tune, {feature: value}) of good rows."""
    from math import comb

    out, features = {}, list(quality.GRID)
    strata = {s for s, tune, _ in rows if not tune}
    for s in strata:
        part = {t: [v for x, tune, v in rows if x == s and tune == t] for t in (True, False)}
        least = {f: next((i for i, c in enumerate(quality.GRID[f]) if sum(v[f] > c for v in part[True]) <= alpha / len(features) * len(part[True])), 10) for f in features}
        best = None
        for t in range(9, -1, -1):
            cut = {f: quality.GRID[f][max(t, least[f])] if max(t, least[f]) < 10 else math.inf for f in features}
            n, k = len(part[False]), sum(any(v[f] > cut[f] for f in features) for v in part[False])
            if k > alpha * n or sum(comb(n, i) * alpha**i * (1 - alpha) ** (n - i) for i in range(k + 1)) > delta / len(strata):
                break
            best = cut
        out[s] = best or dict.fromkeys(features, math.inf)
    return out


def test_op7_verdicts_on_the_tables(spark):
    """Cutoffs and verdicts at sf0.1 against a plain version; the method rejects, and good rows are left alone."""
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op7_risk_controlled_quality"](spark, sf)
    extra = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").join(spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.min("quality").alias("quality")), "doc_id", "left")
    tune = F.pmod(F.xxhash64("doc_id", F.lit("tune")), F.lit(quality.TUNE)) == 0
    rows = got.join(extra, "doc_id").withColumn("tune", tune).collect()

    def value(r):
        n = max(1, r.n_words)
        return {"symbol_share": r.n_symbols / max(1, r.word_chars), "dup_line_share": r.n_dup_lines * 8 / n, "repeat_share": r.n_repeat_words / n, "mean_word": r.word_chars / n}

    cut = _plain_cutoffs([(r.lang, r.tune, value(r)) for r in rows if r.quality == 1])
    assert sum(min(c.values()) < math.inf for c in cut.values()) >= 3
    for r in rows:
        want = not r.base_failed and all(x <= cut.get(r.lang, {}).get(f, math.inf) for f, x in value(r).items())
        assert r.kept == want
    by_method = [r for r in rows if not r.base_failed and not r.kept]
    assert len(by_method) > 100
    for lang in cut:
        good = [r for r in rows if r.lang == lang and r.quality == 1]
        assert sum(not r.kept and not r.base_failed for r in good) <= quality.ALPHA * len(good)
    bad = [r for r in rows if r.quality == 0]
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad)


def test_op7_cutoffs_are_tested_in_a_fixed_sequence(spark):
    # 400 good rows in each of four strata, one null: (1 - alpha) ** 400 is below delta / 4; 200 are too few.
    rows = spark.range(0, 1600).selectExpr("nullif(concat('s', id % 4), 's3') AS lang", "100L AS n_words", "500L AS word_chars", "0L AS n_symbols", "0L AS n_dup_lines", "0L AS n_repeat_words", "1 AS quality")
    cut = {(x.stratum, x.feature): x.cutoff for x in quality.thresholds(rows, "lang").collect()}
    assert len(cut) == 16 and (None, "mean_word") in cut and all(cut[x, f] == min(c) for (x, f) in cut for c in [quality.GRID[f]])
    short = quality.thresholds(rows.where("lang = 's1'").limit(200).union(rows.where("lang is distinct from 's1'")), "lang").collect()
    assert {x.cutoff for x in short if x.stratum == "s1"} == {math.inf} and all(x.cutoff < math.inf for x in short if x.stratum != "s1")
    # Bad luck at one level stops the sequence there: 30 of 1,000 good rows have symbols, so stricter levels fail.
    some = spark.range(0, 1000).selectExpr("'a' AS lang", "100L AS n_words", "500L AS word_chars", "IF(id < 30, 45L, 0L) AS n_symbols", "0L AS n_dup_lines", "0L AS n_repeat_words", "1 AS quality")
    got = {x.feature: (x.cutoff, x.n, x.rejected) for x in quality.thresholds(some, "lang").collect()}
    assert got["symbol_share"] == (0.12, 1000, 0) and got["mean_word"][0] == quality.GRID["mean_word"][5]


def test_op7_edges(spark, empty):
    rows = quality.features(spark.createDataFrame([(1, None, None), (1, "w " * 30, None), (1, "w " * 30, None), (2, "", "")], "doc_id long, text string, lang string"))
    none = quality.thresholds(rows.withColumn("quality", F.lit(1)).limit(0), "lang")
    assert none.count() == 0
    out = quality.verdicts(rows, none, "lang").collect()
    assert len(out) == 4 and not any(r.kept for r in out)
    assert quality.verdicts(quality.features(empty), none, "lang").count() == 0

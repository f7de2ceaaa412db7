"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

Words are lower-cased. Each mask is a fixed pattern of words that ignores some
positions; the hash of the words it selects is a key of the window. Keys of the benchmark and
of the documents are joined; a hit fixes an item and a diagonal (where in the text the item's
first word would stand), and the item is then laid along that diagonal and compared word for
word: the best stretch counts +1 for an equal and -2 for an unequal word, so substituted words
are tolerated but unrelated text around a passage isn't taken in. A text is contaminated by an
item if such a stretch has at least ``least`` equal words, or is the whole item, word for word,
if it has fewer. Items of fewer than SHORTEST words say nothing and are left out.

A stretch that is accepted starts with 12 equal words among at most 5 unequal ones, such that
equal words outweigh unequal ones 2 to 1 in every part from its start. MASKS are seven of 7
words each, of which at least one falls on equal words only in every such pattern (a test
enumerates all 728), so with ``least`` of 12 or more no stretch that alignment accepts goes
without a key; a shorter item, taken whole, has one of the plain mask. A mask needs no more words
than it spans.

At scale: documents without a hit are never shuffled. Up to BROADCAST_ROWS keys of the benchmark are broadcast, each mask's to
its own join. Beyond, bits of the keys in BITMAP_ROWS words at most are broadcast, and the
document's keys that they let through (all that match, and a share of the others that the bits'
load sets) are shuffled alone, without text, to the benchmark's. Hits are deduplicated by
document, item and diagonal, again without text; only the words' hashes of documents with a hit (found by a broadcast of
their keys, or by bits of these) are then shuffled to them, once each, and aligned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, text_keys, written

#: Least words of an item.
SHORTEST = 7
MASKS = ((0, 1, 2, 4, 5, 8, 10), (0, 1, 2, 4, 6, 7, 11), (0, 1, 2, 3, 7, 10, 13), (0, 1, 2, 4, 5, 7, 9), (0, 1, 2, 3, 4, 8, 9), (0, 1, 2, 3, 5, 7, 11), (0, 1, 2, 3, 4, 5, 6))
#: Keys that are broadcast as they are, 24 bytes each; items of as many words at most, 8 bytes each.
BROADCAST_ROWS = 500_000
#: Words of 64 bits in the broadcast bitmap of more keys, 24 bytes each with their places.
BITMAP_ROWS = 1 << 22
EQUAL, UNEQUAL = 1, -2


def _hashes(text: str) -> Column:
    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
    return F.transform(F.filter(F.split(lowered, f"{SPACE}+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def _keys(h: Column, at: Column) -> list[Column]:
    """One key for each mask at position ``at``; null where the mask leaves the text."""
    return [F.when(at + mask[-1] < F.size(h), F.xxhash64(F.lit(m), *[F.get(h, at + i) for i in mask])) for m, mask in enumerate(MASKS)]


def overlaps(docs: DataFrame, tests: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", least: int = 12) -> DataFrame:
    """One row for each document and item that overlap: doc_id, item_id, matched (equal words), item_words, start (word of the text where the best stretch begins), span (its words).

    Null texts and items, and those of fewer than SHORTEST (7) words, overlap with nothing. Rows with a null id give a row with a null id. Documents with one id are
    taken together (best stretch), but each is verified by itself. Of equally good stretches the one that starts first counts. Texts are read whole, whatever their
    length; columns but the id and the text are not read, so their names can't clash. An empty benchmark gives no row.
    """
    found = _stretches(docs, tests, doc_id, item_id, text, least)
    best = F.max(F.struct(F.col("s.best_equal").alias("matched"), (-F.col("__start") - F.col("s.best_from")).alias("neg"), (F.col("s.best_to") - F.col("s.best_from") + 1).alias("span"), "item_words"))
    out = found.groupBy("doc_id", "item_id").agg(best.alias("b"))
    return out.select("doc_id", "item_id", F.col("b.matched").cast("long").alias("matched"), F.col("b.item_words").cast("long").alias("item_words"), (-F.col("b.neg")).cast("long").alias("start"), F.col("b.span").cast("long").alias("span"))


def _stretches(docs: DataFrame, tests: DataFrame, doc_id: str, item_id: str, text: str, least: int) -> DataFrame:
    """Accepted stretches of each row: its key (doc_id, tk1, tk2: the id and the hash of the text), item_id, __start, item_words, s."""
    row = ["doc_id", "tk1", "tk2"]
    items = written(tests.select(F.col(item_id).alias("item_id"), _hashes(text).alias("__ih")).where(F.size("__ih") >= SHORTEST), "items")
    seeds = items.select("item_id", "__ih", F.posexplode_outer("__ih").alias("__ip", "__w")).where("__ip is not null")
    seeds = seeds.select("item_id", "__ip", F.posexplode(F.array(*_keys(F.col("__ih"), F.col("__ip")))).alias("__mask", "__key")).where("__key is not null")
    seeds = written(seeds, "seeds")
    words = docs.select(F.col(doc_id).alias("doc_id"), *text_keys(F.col(text)), _hashes(text).alias("__dh"))
    at = words.select(*row, "__dh", F.posexplode_outer("__dh").alias("__dp", "__w")).where("__dp is not null")
    small = seeds.count() <= BROADCAST_ROWS
    if small:
        keyed = at.withColumns({f"__k{m}": k for m, k in enumerate(_keys(F.col("__dh"), F.col("__dp")))})
        for m in range(len(MASKS)):
            keys = seeds.where(F.col("__mask") == m).select(F.col("__key").alias(f"__m{m}")).distinct()
            keyed = keyed.join(F.broadcast(keys), F.col(f"__k{m}") == F.col(f"__m{m}"), "left")
        kept = [F.col(f"__m{m}") for m in range(len(MASKS))]
        asked = keyed.where(F.coalesce(*kept).isNotNull()).select(*row, "__dp", F.explode(F.array(*kept)).alias("__key")).where("__key is not null")
        hits = asked.join(F.broadcast(seeds.select("item_id", "__ip", "__key")), "__key")
    else:
        bits = _bits(seeds.select("__key"))
        asked = at.select(*row, "__dp", F.explode(F.array(*_keys(F.col("__dh"), F.col("__dp")))).alias("__key")).where("__key is not null")
        hits = _let_through(asked, F.col("__key"), bits).join(seeds.select("item_id", "__ip", "__key"), "__key")
    # One row for each document, item and diagonal, without text; then only what hit anything is read again.
    hits = written(hits.select(*row, "item_id", (F.col("__dp") - F.col("__ip")).alias("__start")).distinct(), "hits")
    found = written(hits.select(*row).distinct().select(*[F.col(c).alias(f"__{c}") for c in row]), "hit-rows")
    texts = words.select(*row, "__dh")
    if found.count() <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(found), _same(row, "__"), "left_semi")
    else:
        texts = _let_through(texts, F.xxhash64(*row), _bits(found.select(F.xxhash64(*[f"__{c}" for c in row]).alias("__key"))))
        texts = texts.select(*row, "__dh").join(found, _same(row, "__"), "left_semi")
    texts = texts.dropDuplicates(row).select(*[F.col(c).alias(f"__{c}") for c in row], F.col("__dh").alias("__part"))
    hits = hits.join(texts, _same(row, "__")).join(F.broadcast(items) if small else items, "item_id")
    laid = F.transform("__ih", lambda w, i: F.when(F.coalesce(F.get("__part", F.col("__start") + i) == w, F.lit(False)), F.lit(EQUAL)).otherwise(F.lit(UNEQUAL)))
    stretch = F.aggregate(
        laid,
        F.struct(*[F.lit(0).alias(c) for c in ("run", "equal", "from", "i", "best", "best_equal", "best_from", "best_to")]),
        _step,
    )
    found = hits.select(*row, "item_id", "__start", F.size("__ih").alias("item_words"), stretch.alias("s"))
    return found.where(F.col("s.best_equal") >= F.least(F.lit(least), F.col("item_words")))


def _place(key: Column) -> Column:
    return F.pmod(F.shiftright(key, 6), F.lit(BITMAP_ROWS)).cast("int")


def _bit(key: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(key, F.lit(64)).cast("int"))


def _bits(keys: DataFrame) -> DataFrame:
    """(__place, __bits) of keys (__key): at most BITMAP_ROWS words of 64 bits."""
    return keys.groupBy(_place(F.col("__key")).alias("__place")).agg(F.bit_or(_bit(F.col("__key"))).alias("__bits"))


def _let_through(rows: DataFrame, key: Column, bits: DataFrame) -> DataFrame:
    """The rows whose key may be among those of the bits, and with it all that are."""
    asked = rows.withColumn("__asked", key)
    return asked.withColumn("__place", _place(F.col("__asked"))).join(F.broadcast(bits), "__place").where(F.col("__bits").bitwiseAND(_bit(F.col("__asked"))) != 0).drop("__asked", "__place", "__bits")


def _same(row: list[str], mark: str) -> Column:
    """Equal keys of rows; null ids are equal to each other."""
    out = F.lit(True)
    for c in row:
        out = out & F.col(c).eqNullSafe(F.col(mark + c))
    return out


def _step(a: Column, score: Column) -> Column:
    """Best-scoring stretch (running maximum of sums), with its equal words and ends."""
    fresh = a["run"] <= 0
    run = F.when(fresh, score).otherwise(a["run"] + score)
    equal = F.when(fresh, F.lit(0)).otherwise(a["equal"]) + F.when(score > 0, 1).otherwise(0)
    start = F.when(fresh, a["i"]).otherwise(a["from"])
    better = run > a["best"]
    pick = lambda new, old: F.when(better, new).otherwise(a[old])
    return F.struct(
        run.alias("run"), equal.alias("equal"), start.alias("from"), (a["i"] + 1).alias("i"),
        pick(run, "best").alias("best"), pick(equal, "best_equal").alias("best_equal"), pick(start, "best_from").alias("best_from"), pick(a["i"], "best_to").alias("best_to"),
    )


def clean(docs: DataFrame, tests: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 12) -> DataFrame:
    """docs without those that overlap with a benchmark item; each row by itself, whatever ids it shares with others.

    A null or empty text holds nothing and stays; repeated rows fare alike; all columns stay as they are. An empty table stays empty.
    """
    found = _stretches(docs, tests, doc_id, "item_id", text, least)
    bad = found.select(F.col("doc_id").alias("__bad"), F.col("tk1").alias("__tk1"), F.col("tk2").alias("__tk2")).distinct()
    k1, k2 = text_keys(F.col(text))
    keyed = docs.withColumns({"__k1": k1, "__k2": k2})
    same = F.col(doc_id).eqNullSafe(F.col("__bad")) & (F.col("__k1") == F.col("__tk1")) & (F.col("__k2") == F.col("__tk2"))
    return keyed.join(bad, same, "left_anti").drop("__k1", "__k2")

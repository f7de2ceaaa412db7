"""Near-duplicate classes by an LSH forest over MinHash signatures, confirmed on full shingle sets.

1. Each text's set of distinct shingles of SHINGLE words (op8_lsh_forest: two) gets a 128-bit name (sid) and a MinHash signature.
   Texts with one set are one node from here on, so exact copies cost one node.
2. Forest: each of TREES orders sorts all nodes by a label of LEVELS hashes (a range partition, so
   a crowded prefix is split like any other). A node's candidates are the WIDTH (one) before
   it, which has the longest common prefix, and the first of its region, as long as the common prefix has LEAST hashes or more: in a
   crowded region the neighbours' common prefix, hence the depth, is longer, and elsewhere it is
   shorter. Sets of similarity 0.8 share LEAST hashes in one of the trees but for 3 in a million.
3. Candidates whose signatures agree on SCREEN of all hashes join nodes into groups; a pair of
   similarity 0.8 fails that by more than six standard deviations.
4. In each group the full sets are compared: every pair that is not yet in one class, but those
   whose sizes rule out the similarity or whose signatures agree below SCREEN. So a group of
   near copies costs about one comparison a member rather than all pairs, and no link between
   different classes goes untried. Groups above MOST nodes or BULK shingles are split: all parts
   hold the same few pivots, and what is left outside the largest class is compared with every
   part in blocks (as many comparisons as there are nodes left times nodes of the group).
5. Joins on a group, a class or a pointer, any of which may hold a third of all nodes, go by
   join_unique: heavy keys, of which there can only be a few, by broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Hasher, chunks, join_unique, mixed, parts, text_keys, texts, written

TREES, LEAST, LEVELS = 32, 5, 8
HASHES = TREES * LEAST
WIDTH = 1
SCREEN = 0.6
MOST = 5000
#: Shingles of a group that are compared in one task, at most, unless one text has more.
BULK = 20_000_000
PIVOTS = 8
PERCENT = 80
#: Words in a shingle, where nothing else is asked for; the contract of op8_lsh_forest is PAIRS.
SHINGLE = 5
PAIRS = 2

_RNG = np.random.default_rng(20)
_XOR = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2)
_ODD = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Hashes of each tree's label: its own LEAST, then some of the next trees.
_LABELS = np.array([[(t * LEAST + i) % HASHES for i in range(LEVELS)] for t in range(TREES)])


def shingles(hasher: Hasher, data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes of each row's shingles of ``size`` words, where each row begins); rows without a word are empty, those with fewer words have all of them as their one shingle."""
    words, at, _, _ = hasher.of_words(data, offsets, lower=True)
    counts = np.diff(at)
    row = np.repeat(np.arange(len(counts)), counts)
    place, end = np.arange(len(words)), at[1:][row]
    pairs = np.zeros(len(words), np.uint64)
    for k in range(size):
        # Past the end of its row a word counts as 0.
        next_word = np.append(words[k:], np.zeros(min(k, len(words)), np.uint64))
        pairs = mixed(pairs * np.uint64(0x9E3779B97F4A7C15) + np.where(place + k < end, next_word, np.uint64(0)) * np.uint64(0xC2B2AE3D27D4EB4F))
    keep = (place + size <= end) | (place == at[:-1][row])
    row = row[keep]
    pairs = pairs[keep]
    # Sorting the hashes with the row in place of their top bits would lose bits: sort by row apart.
    order = np.lexsort((pairs, row))
    pairs = pairs[order]
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs[1:] != pairs[:-1]) | (row[1:] != row[:-1])
    return pairs[new], np.searchsorted(row[new], np.arange(len(counts) + 1))


def signatures(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(rows, HASHES) of 16 bits; rows of empty sets are 0."""
    full = np.flatnonzero(np.diff(at))
    out = np.zeros((len(at) - 1, HASHES), np.uint16)
    if len(full):
        starts, buffer = at[:-1][full], np.empty_like(sets)
        for k in range(HASHES):
            np.bitwise_xor(sets, _XOR[k], out=buffer)
            np.multiply(buffer, _ODD[k], out=buffer)
            out[full, k] = (mixed(np.minimum.reduceat(buffer, starts)) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def _read(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """(doc_id, tk1, tk2, n_shingles, sid, sig); sig only where the task meets the sid for the first time."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), *text_keys(F.col(text)), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = Hasher(5), set()
        for batch in batches:
            sizes, sids, sigs = [], [], []
            for _, _, data, offsets in chunks(*texts(batch.column(3))):
                sets, at = shingles(hasher, data, offsets, size)
                n = np.diff(at)
                one, two = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                full = np.flatnonzero(n)
                if len(full):
                    one[full] = mixed(np.add.reduceat(sets, at[:-1][full])) ^ n[full].astype(np.uint64)
                    two[full] = np.add.reduceat(mixed(sets + np.uint64(99)), at[:-1][full])
                names = [x.tobytes() if k else None for x, k in zip(np.stack([one, two], axis=1), n, strict=True)]
                fresh = []
                for i, s in enumerate(names):
                    if s is not None and s not in seen:
                        seen.add(s)
                        fresh.append(i)
                held = [None] * len(n)
                if fresh:
                    part = np.concatenate([sets[at[i] : at[i + 1]] for i in fresh])
                    for i, sig in zip(fresh, signatures(part, np.concatenate([[0], np.cumsum(n[fresh])])), strict=True):
                        held[i] = sig.tobytes()
                if len(seen) > 1_000_000:
                    seen.clear()
                sizes.append(n)
                sids += names
                sigs += held
            new = {"n_shingles": pa.array(np.concatenate(sizes) if sizes else [], pa.int64()), "sid": pa.array(sids, pa.binary()), "sig": pa.array(sigs, pa.binary())}
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], *new.values()], schema=pa.schema([*[batch.schema.field(i) for i in range(3)], *[(k, v.type) for k, v in new.items()]]))

    schema = rows.drop("text").withColumns({"n_shingles": F.lit(None).cast("long"), "sid": F.lit(None).cast("binary"), "sig": F.lit(None).cast("binary")}).schema
    return rows.mapInArrow(run, schema)


def _numbered(df: DataFrame) -> DataFrame:
    """df with idx, a number of its own for each row; to be written, as another run numbers anew."""
    return df.withColumn("idx", F.monotonically_increasing_id())


def _forest(nodes: DataFrame) -> DataFrame:
    """Candidate pairs (a < b) of nodes' idx from all trees."""
    spark, width = nodes.sparkSession, WIDTH

    def labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            idx = batch.column(0).to_numpy()
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(len(idx), HASHES)
            for t in range(TREES):
                x = sig[:, _LABELS[t]].astype(np.uint64)
                l1, l2 = (x[:, i] << np.uint64(48) | x[:, i + 1] << np.uint64(32) | x[:, i + 2] << np.uint64(16) | x[:, i + 3] for i in (0, 4))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(idx), t, np.int32)), pa.array(l1.view(np.int64)), pa.array(l2.view(np.int64)), pa.array(idx)], names=["tree", "l1", "l2", "idx"])

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, head = [np.zeros(0, np.int64)] * 4, None
        for batch in batches:
            if not len(batch):
                continue
            old = len(held[0])
            cols = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
            tree, l1, l2, idx = cols
            top = l2 >> 48
            same = (tree[1:] == tree[:-1]) & (l1[1:] == l1[:-1]) & (top[1:] == top[:-1])
            region = np.concatenate([[0], np.cumsum(~same)])
            pairs = []
            for k in range(1, width + 1):
                i = np.arange(max(old, k), len(idx))
                i = i[region[i] == region[i - k]]
                pairs.append((idx[i - k], idx[i]))
            heads = np.concatenate([[0], np.flatnonzero(~same) + 1])
            first = idx[heads][region]
            if head is not None and old:
                first[region == region[old - 1]] = head
            pairs.append((first[old:], idx[old:]))
            a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
            good = a != b
            both = np.unique(np.stack([np.minimum(a, b)[good], np.maximum(a, b)[good]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])
            head, held = int(first[-1]), [c[-width:] for c in cols]

    trees = nodes.select("idx", "sig").mapInArrow(labels, "tree int, l1 long, l2 long, idx long")
    order = trees.repartitionByRange(parts(spark), "tree", "l1", "l2", "idx").sortWithinPartitions("tree", "l1", "l2", "idx")
    return order.mapInArrow(neighbours, "a long, b long").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).select("a", "b")


def _screened(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    a = nodes.select(F.col("idx").alias("a"), F.col("sig").alias("sa"))
    b = nodes.select(F.col("idx").alias("b"), F.col("sig").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            if n:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(n, HASHES) for i in (2, 3))
                yield batch.select([0, 1]).filter(pa.array((x == y).sum(axis=1) >= SCREEN * HASHES))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b): component is the least node reachable.

    Contraction: each node points to its least neighbour, pointers are doubled until they end at
    roots, and edges between different roots go to the next round. A dense group's edges are gone
    after the first. Every round is cut off as a written table.
    """
    now = written(edges.where("a <> b").select("a", "b").distinct(), "edges")
    labels = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        up = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("p")), "pointers")
        while True:
            further = up.select(F.col("u").alias("p"), F.col("p").alias("q"))
            jumped = written(join_unique(up, further, "p").select("u", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), "pointers")
            up = jumped.select("u", "p")
            if not jumped.where("moved").limit(1).collect():
                break
        if labels is None:
            labels = up.select(F.col("u").alias("node"), F.col("p").alias("component"))  # read from a table
        else:
            labels = written(join_unique(labels, up.withColumnRenamed("u", "component"), "component", "left").select("node", F.coalesce("p", "component").alias("component")), "labels")
        ends = written(join_unique(now, up.select(F.col("u").alias("a"), F.col("p").alias("ra")), "a"), "ends")
        ends = join_unique(ends, up.select(F.col("u").alias("b"), F.col("p").alias("rb")), "b")
        now = written(ends.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        if not now.limit(1).collect():
            return labels


def classes(sets: list[np.ndarray], sigs: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Class (least member's place) of each set under links of similarity percent / 100 or more.

    Every pair in different classes is compared, those apart that sizes or signatures rule out.
    The next to compare with all others is the one whose signature agrees most with the rest.
    """
    n = len(sets)
    root, sizes = np.arange(n), np.array([len(s) for s in sets])
    if n < 2:
        return root
    base = sigs[:: max(1, n // 64)]
    likeness = np.array([(sigs == b).mean(axis=1) for b in base]).mean(axis=0)
    for p in np.argsort(-likeness, kind="stable").tolist():
        other = np.flatnonzero(root != root[p])
        if not len(other):
            break
        x, y = np.minimum(sizes[other], sizes[p]), np.maximum(sizes[other], sizes[p])
        other = other[100 * x >= percent * y]
        other = other[(sigs[other] == sigs[p]).sum(axis=1) >= SCREEN * sigs.shape[1]]
        if not len(other):
            continue
        flat = np.concatenate([sets[i] for i in other])
        at = np.searchsorted(sets[p], flat)
        hit = sets[p][np.minimum(at, sizes[p] - 1)] == flat
        common = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(sizes[other])[:-1]]), dtype=np.int64)
        linked = other[100 * common >= percent * (sizes[other] + sizes[p] - common)]
        for r in np.unique(root[linked]):
            low, high = min(root[p], r), max(root[p], r)
            root[root == high] = low
    return root


def _resolve(percent: int, size: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("idx")
        data, offsets = texts(pa.array(frame["text"], pa.large_string()))
        hasher, sets = Hasher(5), []
        for a, b, some, at in chunks(data, offsets):
            flat, cuts = shingles(hasher, some, at, size)
            sets += [flat[cuts[i] : cuts[i + 1]] for i in range(b - a)]
        sigs = np.frombuffer(b"".join(frame["sig"]), np.uint16).reshape(len(frame), HASHES)
        idx = frame["idx"].to_numpy()
        root = classes(sets, sigs, percent)
        return pd.DataFrame({"a": idx, "b": idx[root]})

    return run


def links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, most: int = MOST, size: int = SHINGLE, bulk: int = BULK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: doc_id, n_shingles, sid; nodes: sid, idx; classes: node, component by idx) of documents linked at percent / 100 or more on shingles of ``size`` words."""
    spark = docs.sparkSession
    rows = written(_read(docs, doc_id, text, size), "rows")
    sets = rows.where("sid is not null").groupBy("sid").agg(F.max("sig").alias("sig"), F.max("n_shingles").alias("size"), F.min(F.struct("tk1", "tk2")).alias("tk"))
    nodes = written(_numbered(sets.select("sid", "sig", "size", "tk.tk1", "tk.tk2")), "nodes")
    pairs = _screened(_forest(nodes), nodes)
    groups = written(components(pairs).withColumnsRenamed({"node": "idx", "component": "grp"}), "groups")
    wanted = nodes.join(groups, "idx")
    pieces = F.ceil(F.greatest(F.count(F.lit(1)) / most, F.sum("size") / bulk)).cast("long")
    large = written(wanted.groupBy("grp").agg(pieces.alias("pieces")).where("pieces > 1"), "large")
    wanted = wanted.select("idx", "grp", "tk1", "tk2", "sig")
    keyed = docs.select(*text_keys(F.col(text)), F.col(text).alias("text"))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            keep = []
            for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keep.append(key not in seen)
                seen.add(key)
            if len(seen) > 1_000_000:
                seen.clear()
            yield batch.filter(pa.array(keep, pa.bool_()))

    first = keyed.mapInArrow(once, keyed.schema)
    found = first.join(wanted, ["tk1", "tk2"]).dropDuplicates(["tk1", "tk2"]).select("idx", "grp", "text", "sig")
    if not large.limit(1).collect():
        out = found.groupBy("grp").applyInPandas(_resolve(percent, size), "a long, b long")
        return rows, nodes, written(out.withColumnsRenamed({"a": "node", "b": "component"}), "classes")
    found = written(join_unique(written(found, "texts"), large, "grp", "left").fillna(1, ["pieces"]).withColumn("part", F.pmod(F.xxhash64("idx"), F.col("pieces")).cast("int")), "found")
    parts_of = found.select("grp", "part").distinct()
    # Pivots: the nodes with most screened candidates, ties to the least; the same in all parts.
    degree = pairs.select(F.col("a").alias("idx")).union(pairs.select(F.col("b").alias("idx"))).groupBy("idx").count().withColumnRenamed("count", "degree")
    best = Window.partitionBy("grp").orderBy(F.desc("degree"), "idx")
    ranked = found.where("pieces > 1").select("grp", "idx").join(degree, "idx").withColumn("rank", F.row_number().over(best))
    pivots = ranked.where(F.col("rank") <= PIVOTS).select("grp", "idx")
    shared = found.drop("part").join(pivots, ["grp", "idx"], "left_semi").join(parts_of, "grp")
    cols = ["idx", "grp", "text", "sig", "part"]
    round_one = found.select(*cols).union(shared.select(*cols)).dropDuplicates(["grp", "part", "idx"])
    edges = written(round_one.groupBy("grp", "part").applyInPandas(_resolve(percent, size), "a long, b long"), "links")
    one = components(edges)
    # The largest class of each group needs no more comparisons within itself; all other nodes get theirs.
    main = one.join(found.select(F.col("idx").alias("node"), "grp"), "node").groupBy("grp", "component").count()
    main = main.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("count"), "component"))).where("rank = 1")
    sure = one.join(main.select("component"), "component", "left_semi").select(F.col("node").alias("idx"))
    rest = found.where("pieces > 1").join(sure, "idx", "left_anti").withColumn("block", F.pmod(F.xxhash64("idx", F.lit(3)), F.col("pieces")).cast("int"))
    spread = rest.drop("part").join(parts_of, "grp").select(*cols, "block")
    members = found.select(*cols).join(rest.select("grp", "block").distinct(), "grp").select(*cols, "block")
    round_two = members.union(spread).dropDuplicates(["grp", "part", "block", "idx"])
    more = round_two.groupBy("grp", "part", "block").applyInPandas(_resolve(percent, size), "a long, b long")
    return rows, nodes, written(components(edges.union(more)), "classes")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, most: int = MOST, size: int = PAIRS) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept.

    component_id is the least doc_id of the class; rows whose doc_id is null take part but give
    no id (a class of such rows alone has a null one). Rows without words (null or empty text)
    are classes of their own. kept: doc_id is the component_id (null counts as equal to null),
    so repeated rows of the least doc_id are all kept. Ties among neighbours don't matter: every
    group is compared on full sets. Only doc_id and text are read, so other columns can't clash. An empty table gives an empty table.
    """
    rows, named = _named(docs, doc_id, text, percent, most, size)
    out = rows.join(named, "sid", "left").withColumn("component_id", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _named(docs: DataFrame, doc_id: str, text: str, percent: int, most: int, size: int) -> tuple[DataFrame, DataFrame]:
    """(rows; sid, component, component_id and the one row of the component that stays)."""
    rows, nodes, found = links(docs, doc_id, text, percent, most, size)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk1", "tk2")
    least = rows.where("sid is not null").groupBy("sid").agg(F.min(row).alias("low"))
    label = nodes.select("sid", "idx").join(least, "sid").join(found.withColumnRenamed("node", "idx"), "idx", "left").withColumn("component", F.coalesce("component", "idx"))
    label = written(label.select("sid", "component", "low"), "label")
    lowest = label.groupBy("component").agg(F.min("low").alias("stays"))
    return rows, join_unique(label, lowest, "component").select("sid", "component", F.col("stays.doc_id").alias("component_id"), "stays")


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, most: int = MOST, size: int = SHINGLE) -> DataFrame:
    """The rows of docs that stay: one of each class, that of the least doc_id (null last, then the least hash of the text), and all without words.

    Of repeated rows with one id and one text that stay, one does.
    """
    rows, named = _named(docs, doc_id, text, percent, most, size)
    stays = named.select("stays").distinct().select(F.col("stays.doc_id").alias("__id"), F.col("stays.tk1").alias("__k1"), F.col("stays.tk2").alias("__k2"))
    wordy = F.coalesce(F.col(text).rlike(WORD), F.lit(False))
    k1, k2 = text_keys(F.col(text))
    keyed = docs.withColumns({"__tk1": k1, "__tk2": k2})
    one = keyed.where(wordy).join(stays, keyed[doc_id].eqNullSafe(stays["__id"]) & (keyed["__tk1"] == stays["__k1"]) & (keyed["__tk2"] == stays["__k2"]), "left_semi")
    one = one.dropDuplicates([doc_id, "__tk1", "__tk2"])
    return one.union(keyed.where(~wordy)).drop("__tk1", "__tk2")

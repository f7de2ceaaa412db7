"""Operators on directed graphs given as edges (src, dst): components, layers, closure, communities.

Each iterative operator has two physical forms. If the distinct edges are at most KERNEL_EDGES
(16 bytes each, so the driver holds a bounded amount), a linear-time kernel runs on them;
beyond that the operator goes by rounds of DataFrame joins, cut off as written tables, that
broadcast nothing: what many rounds broadcast adds up on the driver. Components and closures hand over to the kernel what is small enough after trimming. Both give the same rows.
"""

from __future__ import annotations

from graphlib import TopologicalSorter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, grows

#: Edges that a kernel takes, at most.
KERNEL_EDGES = 2_000_000

#: Pairs of a closure after which a task gives a batch.
WALKED = 100_000


def simple(edges: DataFrame) -> DataFrame:
    """Distinct edges without nulls; self edges stay."""
    return edges.select("src", "dst").where("src is not null and dst is not null").distinct()


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()


def _small(edges: DataFrame, limit: int) -> pd.DataFrame | None:
    """The edges, if there are no more than ``limit``."""
    found = edges.limit(limit + 1).toArrow()
    return found.to_pandas() if found.num_rows <= limit else None


class Indexed:
    """Edges as arrays over 0..n-1, ids in order."""

    def __init__(self, frame: pd.DataFrame):
        both = pd.concat([frame["src"], frame["dst"]])
        self.ids = np.sort(both.unique())
        self.src, self.dst = np.searchsorted(self.ids, frame["src"].to_numpy()), np.searchsorted(self.ids, frame["dst"].to_numpy())
        order = np.lexsort((self.dst, self.src))
        self.src, self.dst = self.src[order], self.dst[order]
        self.at = np.searchsorted(self.src, np.arange(len(self.ids) + 1))

    def components(self) -> np.ndarray:
        """Least member of each node's strongly connected component (path-based, without recursion)."""
        n, at, dst = len(self.ids), self.at.tolist(), self.dst.tolist()
        number, comp = [-1] * n, [-1] * n
        path: list[int] = []
        bounds: list[int] = []
        count = 0
        for root in range(n):
            if number[root] >= 0:
                continue
            work = [(root, at[root])]
            number[root] = count
            count += 1
            path.append(root)
            bounds.append(root)
            while work:
                v, i = work[-1]
                if i < at[v + 1]:
                    work[-1] = (v, i + 1)
                    w = dst[i]
                    if number[w] < 0:
                        number[w] = count
                        count += 1
                        path.append(w)
                        bounds.append(w)
                        work.append((w, at[w]))
                    elif comp[w] < 0:
                        while number[bounds[-1]] > number[w]:
                            bounds.pop()
                else:
                    work.pop()
                    if bounds[-1] == v:
                        bounds.pop()
                        members = [path.pop()]
                        while members[-1] != v:
                            members.append(path.pop())
                        least = min(members)
                        for m in members:
                            comp[m] = least
        return np.array(comp, np.int64)


def strong_components(edges: DataFrame, limit: int = KERNEL_EDGES) -> DataFrame:
    """(id, comp): comp is the least id of the strongly connected component. Nodes without an edge aren't seen."""
    e = simple(edges)
    kind = e.schema["src"].dataType.simpleString()
    small = _small(e, limit)
    if small is not None:
        g = Indexed(small)
        comp = g.components() if len(g.ids) else np.zeros(0, np.int64)
        return _made(edges.sparkSession, {"id": g.ids, "comp": g.ids[comp]}, f"id {kind}, comp {kind}")
    return _coloured(cut(e), limit)


def _made(spark: SparkSession, columns: dict, schema: str) -> DataFrame:
    found = pa.table(columns)
    return spark.createDataFrame(found, schema) if found.num_rows else spark.createDataFrame([], schema)


def _coloured(e: DataFrame, limit: int) -> DataFrame:
    """Forward-backward colouring: each colour is the least id that reaches a node; what also reaches that id is its component. Once no more than ``limit`` edges are left, the kernel takes them."""
    left, done = cut(e.where("src <> dst")), cut(nodes(e).select("id", F.col("id").alias("comp")).limit(0))
    everyone = cut(nodes(e))
    while True:
        # Nodes without an edge in or out are components of their own.
        after = left.count()
        while after > limit:
            before = after
            left = cut(left.join(grows(left.select(F.col("src").alias("__s")).distinct()), F.col("dst") == F.col("__s"), "left_semi").join(grows(left.select(F.col("dst").alias("__d")).distinct()), F.col("src") == F.col("__d"), "left_semi"))
            after = left.count()
            if after == before:
                break
        if 0 < after <= limit:
            done = done.union(strong_components(left, limit))
            break
        if not after:
            break
        colour = _spread(left, nodes(left).select("id", F.col("id").alias("c")))
        within = left.join(grows(colour.select(F.col("id").alias("src"), F.col("c").alias("cs"))), "src").join(grows(colour.select(F.col("id").alias("dst"), F.col("c").alias("cd"))), "dst").where("cs = cd")
        back = cut(within.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("cs").alias("c")))
        found = cut(colour.where("id = c"))
        while True:
            grown = cut(found.union(back.join(grows(found.select(F.col("id").alias("src"), "c")), ["src", "c"]).select(F.col("dst").alias("id"), "c")).distinct())
            if grown.count() == found.count():
                break
            found = grown
        done = cut(done.union(found.select("id", F.col("c").alias("comp"))))
        gone = grows(found.select("id"))
        left = cut(left.join(gone, left["src"] == gone["id"], "left_anti").join(gone, left["dst"] == gone["id"], "left_anti"))
    return everyone.join(grows(done), "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))


def _spread(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Least label that reaches each node along edges."""
    now = cut(labels)
    while True:
        sent = edges.join(grows(now.select(F.col("id").alias("src"), "c")), "src").select(F.col("dst").alias("id"), "c")
        new = cut(now.union(sent).groupBy("id").agg(F.min("c").alias("c")))
        if not new.join(grows(now.withColumnRenamed("c", "was")), "id").where("c <> was").limit(1).collect():
            return new
        now = new


def condensed(edges: DataFrame, comps: DataFrame) -> DataFrame:
    """Distinct edges between components, without self edges."""
    a, b = comps.select(F.col("id").alias("src"), F.col("comp").alias("a")), comps.select(F.col("id").alias("dst"), F.col("comp").alias("b"))
    return simple(edges).join(grows(a), "src").join(grows(b), "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def layers(comp_nodes: DataFrame, comp_edges: DataFrame, limit: int = KERNEL_EDGES) -> DataFrame:
    """(comp, layer) of an acyclic graph: 0 without dependencies, else one more than the highest dependency. comp_nodes: (comp)."""
    kind = comp_nodes.schema["comp"].dataType.simpleString()
    small = _small(comp_edges, limit)
    if small is not None:
        g = Indexed(small)
        layer = np.zeros(len(g.ids), np.int64)
        waiting = np.diff(g.at)
        order = np.argsort(g.dst, kind="stable")
        back, back_at = g.src[order], np.searchsorted(g.dst[order], np.arange(len(g.ids) + 1))
        ready = np.flatnonzero(waiting == 0).tolist()
        seen = 0
        while ready:
            v = ready.pop()
            seen += 1
            for u in back[back_at[v] : back_at[v + 1]].tolist():
                layer[u] = max(layer[u], layer[v] + 1)
                waiting[u] -= 1
                if not waiting[u]:
                    ready.append(u)
        if seen < len(g.ids):
            raise ValueError("layers need an acyclic graph; condense it first")
        known = _made(comp_nodes.sparkSession, {"comp": g.ids, "layer": layer.astype(np.int32)}, f"comp {kind}, layer int")
    else:
        known = _peeled(comp_edges)
    return comp_nodes.select("comp").distinct().join(grows(known), "comp", "left").select("comp", F.coalesce("layer", F.lit(0)).alias("layer"))


def _peeled(e: DataFrame) -> DataFrame:
    """Layers by peeling: a node goes once all its dependencies have gone. A round looks only at who depended on what went in the round before; nodes that wait aren't written again."""
    left, done, k = cut(e), None, 0
    free = cut(left.select(F.col("dst").alias("id")).distinct().join(grows(left.select(F.col("src").alias("id")).distinct()), "id", "left_anti"))
    while not free.isEmpty():
        part = free.select(F.col("id").alias("comp"), F.lit(k).alias("layer"))
        done = part if done is None else done.union(part)
        now = grows(free.select(F.col("id").alias("dst")))
        met = left.join(now, "dst", "left_semi").select(F.col("src").alias("id")).distinct()
        rest = cut(left.join(now, "dst", "left_anti").select("src", "dst"))
        free = cut(met.join(grows(rest.select(F.col("src").alias("id")).distinct()), "id", "left_anti"))
        left = rest
        k += 1
    if not left.isEmpty():
        raise ValueError("layers need an acyclic graph; condense it first")
    return done if done is not None else e.select(F.col("src").alias("comp"), F.lit(0).alias("layer")).limit(0)


def key_layers(tables: dict[str, tuple[DataFrame, dict[str, str]]]) -> dict[str, DataFrame]:
    """kind -> (key, layer): layers of rows by their foreign keys, where the kinds themselves form an acyclic graph.

    tables: kind -> (rows, columns), the rows with ``key`` and, for each column, keys of the kind that it names; several rows may share a key,
    a kind without rows is named only, and a null is no dependency. Kinds go after those that they name, so each row is read with its
    dependencies' layers known: no rounds over edges. Where all keys of a kind have one layer, that is it; else the keys of other layers than the commonest are joined.
    """
    named: dict[str, list[DataFrame]] = {}
    for rows, columns in tables.values():
        for column, to in columns.items():
            named.setdefault(to, []).append(rows.select(F.col(column).alias("key"), F.lit(0).alias("layer")))
    out, common = {}, {}
    for kind in TopologicalSorter({k: set(columns.values()) for k, (_, columns) in tables.items()}).static_order():
        parts = named.get(kind, [])
        if kind in tables:
            rows, columns = tables[kind]
            layer = F.lit(0)
            for i, (column, to) in enumerate(columns.items()):
                below, others = common[to]
                known = F.lit(below)
                if others is not None:
                    rows = rows.join(grows(others.select(F.col("key").alias(column), F.col("layer").alias(f"__{i}"))), column, "left")
                    known = F.coalesce(F.col(f"__{i}"), known)
                layer = F.greatest(layer, F.when(F.col(column).isNotNull(), known + 1))
            parts = [*parts, rows.select("key", layer.alias("layer"))]
        every = parts[0]
        for part in parts[1:]:
            every = every.union(part)
        every = every.where("key is not null").groupBy("key").agg(F.max("layer").alias("layer"))
        if kind in named:
            every = cut(every)
            # As many rows as there are layers.
            sizes = sorted(every.groupBy("layer").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: (-r["n"], r["layer"]))
            most = sizes[0]["layer"] if sizes else 0
            common[kind] = most, every.where(F.col("layer") != most) if len(sizes) > 1 else None
        out[kind] = every
    return out


def closure(edges: DataFrame, limit: int = KERNEL_EDGES) -> DataFrame:
    """(src, dst): dst is reachable from src by one edge or more and isn't src itself.

    Up to ``limit`` edges, they are broadcast and sources are dealt out: each task walks from its
    own, and pairs are never shuffled. Beyond, the graph's ends are trimmed off until the rest is that small, and joined on again.
    """
    e = simple(edges).where("src <> dst")
    kind = e.schema["src"].dataType.simpleString()
    spark = edges.sparkSession
    small = _small(e, limit)
    if small is None:
        return _trimmed_closure(cut(e), limit)
    g = Indexed(small)
    shared = spark.sparkContext.broadcast((g.ids, g.at, g.dst))

    def walk(frames):
        ids, at, dst = shared.value
        at, dst = at.tolist(), dst.tolist()
        roots, found, held = [], [], 0
        for frame in frames:
            for root in frame["place"].tolist():
                seen, work = {root}, [root]
                while work:
                    v = work.pop()
                    for w in dst[at[v] : at[v + 1]]:
                        if w not in seen:
                            seen.add(w)
                            work.append(w)
                seen.discard(root)
                if seen:
                    roots.append((root, len(seen)))
                    found.append(np.fromiter(seen, np.int64, len(seen)))
                    held += len(seen)
                # Many sources share a batch: one for each took longer than the walk.
                if held >= WALKED:
                    yield _pairs(ids, roots, found)
                    roots, found, held = [], [], 0
        if found:
            yield _pairs(ids, roots, found)

    starts = spark.range(0, len(g.ids), 1, max(1, min(len(g.ids) // 64, spark.sparkContext.defaultParallelism * 4))).withColumnRenamed("id", "place")
    return starts.mapInPandas(walk, f"src {kind}, dst {kind}")


#: Of the edges, what a round of trimming must take off for another one to follow.
TRIMMED = 0.1


def _trimmed_closure(left: DataFrame, limit: int) -> DataFrame:
    """closure() of written distinct edges without self edges.

    A round takes off the nodes that nothing leads to (tops) and those that lead nowhere (bottoms). A path has such nodes at its ends only, so the
    closure of the rest, joined with the edges to bottoms and then behind those from tops, gives theirs: two joins a round,
    while a fixpoint takes one for each step of the longest path. What can't be trimmed goes by the fixpoint, if it is still too much.
    """
    rounds, size = [], left.count()
    while size > limit:
        goes = grows(left.select(F.col("src").alias("dst"), F.col("src").alias("__g")).distinct())
        comes = grows(left.select(F.col("dst").alias("src"), F.col("dst").alias("__c")).distinct())
        ends = cut(left.join(goes, "dst", "left").join(comes, "src", "left").select("src", "dst", F.col("__c").isNull().alias("top"), F.col("__g").isNull().alias("bottom")))
        before, left = size, ends.where("NOT top AND NOT bottom").select("src", "dst")
        size = left.count()
        rounds.append(ends)
        if before - size < TRIMMED * before:
            break
    # The walk of the rest is written: later rounds read it several times.
    known = cut(closure(left, limit)) if 0 < size <= limit else _fixpoint(left)
    while rounds:
        ends = rounds.pop()
        down = ends.where("bottom AND NOT top").select("src", "dst")
        known = known.union(cut(_after(known, down).union(down).distinct()))
        start = ends.where("top").select("src", "dst")
        known = known.union(cut(_after(start, known).union(start).distinct()))
    return known


def _after(first: DataFrame, then: DataFrame) -> DataFrame:
    """The ends of a pair of ``first`` and one of ``then`` that goes on from it."""
    return first.join(grows(then.select(F.col("src").alias("dst"), F.col("dst").alias("next"))), "dst").select("src", F.col("next").alias("dst"))


def _fixpoint(e: DataFrame) -> DataFrame:
    """closure() of written edges in semi-naive rounds of joins."""
    known = frontier = e
    ahead, rounds = grows(e.select(F.col("src").alias("dst"), F.col("dst").alias("next"))), 0
    while True:
        step = frontier.join(ahead, "dst").select("src", F.col("next").alias("dst")).where("src <> dst").distinct()
        frontier = cut(step.join(grows(known), ["src", "dst"], "left_anti"))
        if frontier.isEmpty():
            return known
        known, rounds = known.union(frontier), rounds + 1
        if rounds % 8 == 0:
            known = cut(known)


def _pairs(ids: np.ndarray, roots: list[tuple[int, int]], found: list[np.ndarray]) -> pd.DataFrame:
    """(src, dst) of sources, each with how many it reaches, and what they reach."""
    place, n = np.array(roots, np.int64).T
    return pd.DataFrame({"src": ids[np.repeat(place, n)], "dst": ids[np.concatenate(found)]})


def undirected(edges: DataFrame) -> DataFrame:
    """Unordered pairs (a < b), once each, without self edges."""
    return simple(edges).where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def hubs(edges: DataFrame, threshold: int) -> DataFrame:
    """(id, fan_in) of the nodes with at least ``threshold`` distinct importers."""
    return simple(edges).where("src <> dst").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("fan_in")).where(F.col("fan_in") >= threshold)


def local_move(pairs: list[tuple], passes: int = 100, m: int | None = None) -> dict:
    """The local-move phase of modularity clustering on undirected pairs: node -> community (its least member).

    Nodes are visited in order. Each is taken out of its community and put at once into the
    neighbouring one, its own among them, of greatest gain k_in / m - total * degree / (2 m^2), if
    that is above 0; ties go to the least label. Otherwise it stays. No coarsening.
    """
    near: dict = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    m = m or len(pairs)
    label = {v: v for v in near}
    total = {v: len(x) for v, x in near.items()}
    for _ in range(passes):
        moved = False
        for v in sorted(near):
            degree, own = len(near[v]), label[v]
            links: dict = {}
            for w in near[v]:
                links[label[w]] = links.get(label[w], 0) + 1
            total[own] -= degree
            best, pick = 0.0, own
            for c in sorted(links):
                gain = links[c] / m - total[c] * degree / (2 * m * m)
                if gain > best or gain == best and gain > 0 and c < pick:
                    best, pick = gain, c
            total[pick] += degree
            if pick != own:
                label[v] = pick
                moved = True
        if not moved:
            break
    members: dict = {}
    for v, c in label.items():
        members.setdefault(c, []).append(v)
    return {v: min(x) for x in members.values() for v in x}


def communities(edges: DataFrame, by: DataFrame, threshold: int = 12) -> DataFrame:
    """(app, id, community): modularity clusters inside each app, without the edges of hubs. by: (id, app).

    A move hangs on a node's neighbours and their communities, which lie in its connected
    component, and on the app only by its number of pairs; so components are treated side by side,
    each with that number, and give what the whole app would. One component's moves are in order, so it is one task.
    """
    kind = edges.schema["src"].dataType.simpleString()
    a, b = by.select(F.col("id").alias("src"), "app"), by.select(F.col("id").alias("dst"), F.col("app").alias("app2"))
    inner = simple(edges).where("src <> dst").join(a, "src").join(b, "dst").where("app = app2")
    heavy = inner.groupBy("app", "dst").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= threshold).select("app", F.col("dst").alias("hub"))
    kept = inner.join(heavy.select("app", F.col("hub").alias("src")), ["app", "src"], "left_anti").join(heavy.select("app", F.col("hub").alias("dst")), ["app", "dst"], "left_anti")
    pairs = kept.select("app", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()

    pairs = cut(pairs)
    ways = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    comps = strong_components(ways.union(ways.select("dst", "src")))
    sizes = pairs.groupBy("app").agg(F.count(F.lit(1)).alias("m"))
    parts = pairs.join(comps.select(F.col("id").alias("a"), "comp"), "a").join(sizes, "app")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        label = local_move(sorted(zip(frame["a"], frame["b"], strict=True)), m=int(frame["m"].iloc[0]))
        return pd.DataFrame({"app": frame["app"].iloc[0], "id": list(label), "community": list(label.values())})

    return parts.groupBy("app", "comp").applyInPandas(run, f"app string, id {kind}, community {kind}")

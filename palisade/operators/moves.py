"""Louvain's local moves over blocks of neighbour lists: labels are arrays that every task gets, links stay in blocks.

Gives what communities.local_moves gives, in two small jobs a round. Ids are the ranks of the nodes' names, so that ties between
communities fall alike. The driver and each worker hold a few numbers of every node, for at most MOST_NODES of them.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.sources import scratch

MOST_NODES = 1 << 21  # beyond, tables are joined instead
ENTRIES = 1 << 20  # neighbours in a block, about
BLOCKS = "node binary, start binary, near binary, weight binary"


def _pack(rows):
    """One block: its nodes, where each one's neighbours begin, the neighbours and their weights (none if all are 1)."""
    node, near, weight = (rows.column(c).to_numpy() for c in ("node", "near", "weight"))
    order = np.argsort(node, kind="stable")
    node, near, weight = node[order], near[order], weight[order]
    first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    parts = (node[first], np.r_[first, len(node)], near, weight if (weight != 1).any() else weight[:0])
    types = (np.int32, np.int64, np.int32, np.float64)
    return pa.table({c: pa.array([p.astype(t).tobytes()], pa.binary()) for c, p, t in zip(("node", "start", "near", "weight"), parts, types, strict=True)})


def blocks(links: DataFrame) -> DataFrame:
    """Neighbour lists both ways. links: a, b (ints, a <> b), weight; each node's list stands in one block."""
    count = max(links.sparkSession.sparkContext.defaultParallelism, 2 * links.count() // ENTRIES + 1)
    both = links.select(F.col("a").alias("node"), F.col("b").alias("near"), "weight").unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("near"), "weight"))
    return scratch.cut(both.groupBy(F.pmod("node", F.lit(count)).alias("block")).applyInArrow(_pack, BLOCKS), "blocks")


def _lists(batches):
    for batch in batches:
        for row in batch.to_pylist():
            yield tuple(np.frombuffer(row[c], t) for c, t in (("node", np.int32), ("start", np.int64), ("near", np.int32), ("weight", np.float64)))


def _sums(label, start, near, weight):
    """Place of the node in its block, neighbouring community, weight of the links between them; sorted by both."""
    size = np.int64(len(label))
    key = np.repeat(np.arange(len(start) - 1, dtype=np.int64), np.diff(start)) * size + label[near]
    if len(weight):
        order = np.argsort(key)
        key, weight = key[order], weight[order]
    else:
        key.sort()
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    inside = np.add.reduceat(weight, first) if len(weight) else np.diff(np.r_[first, len(key)]).astype(np.float64)
    return key[first] // size, (key[first] % size).astype(np.int32), inside


def _rows(found, *parts):
    return pa.RecordBatch.from_arrays([pa.array(p) for p in parts], found)


class Level:
    """A graph whose nodes are numbers below `size`: blocks of links, and by node the degree and the weight of its loop."""

    def __init__(self, links: DataFrame, size: int, degree: np.ndarray | None = None, loop: np.ndarray | None = None):
        self.spark, self.size = links.sparkSession, size
        self.blocks = blocks(links)
        self.loop = np.zeros(size) if loop is None else loop
        self.degree = self._degree() if degree is None else degree
        self.total = float(self.degree.sum())

    def _degree(self) -> np.ndarray:
        def of(batches):
            for node, start, _, weight in _lists(batches):
                yield _rows(("node", "degree"), node, np.add.reduceat(weight, start[:-1]) if len(weight) else np.diff(start).astype(np.float64))

        got, out = self.blocks.mapInArrow(of, "node int, degree double").toArrow(), 2 * self.loop
        out[got.column("node").to_numpy()] += got.column("degree").to_numpy()
        return out

    def look(self, label: np.ndarray, resolution: float) -> tuple[float, tuple[np.ndarray, ...]]:
        """Modularity under the labels, and the wishes (node, to, more) of the nodes that gain by moving."""
        degree, total = self.degree, self.total
        tot = np.bincount(label, degree, self.size)
        sent = self.spark.sparkContext.broadcast((label, tot, degree))

        def best(batches):
            label, tot, degree = sent.value
            for node, start, near, weight in _lists(batches):
                place, to, inside = _sums(label, start, near, weight)
                own, mine = label[node], degree[node]
                home = to == own[place]
                gain = inside - resolution * mine[place] * (tot[to] - np.where(home, mine[place], 0.0)) / total
                first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
                top = np.maximum.reduceat(gain, first)
                goal = np.maximum.reduceat(np.where(gain == top[place], to, -1), first).astype(np.int32)
                stay = -resolution * mine * (tot[own] - mine) / total
                stay[place[home]] = gain[home]
                some = np.flatnonzero(top - stay > 1e-12)
                yield _rows(("node", "to", "more"), np.r_[np.int32(-1), node[some]], np.r_[np.int32(-1), goal[some]], np.r_[inside[home].sum(), (top - stay)[some]])

        got = self.blocks.mapInArrow(best, "node int, to int, more double").toArrow()
        sent.destroy()
        node, to, more = (got.column(c).to_numpy() for c in ("node", "to", "more"))
        held = more[node < 0].sum() / 2 + self.loop.sum()  # a link inside is seen from both ends
        quality = 2 * held / total - np.dot(tot, tot) / total ** 2 if total else 0.0
        return quality, tuple(x[node >= 0] for x in (node, to, more))

    def moved(self, nodes: DataFrame, seed: int, resolution: float, least_rise: float, patience: int) -> tuple[np.ndarray, bool]:
        """Labels by moves of single nodes, and whether any round raised modularity; the rounds of communities.local_moves."""
        label, idle, rose, k = np.arange(self.size, dtype=np.int32), 0, False, 0
        best, wishes = self.look(label, resolution)
        while idle <= patience and len(wishes[0]):
            node, to, more = wishes
            if idle < patience:
                turn = np.zeros(self.size, bool)
                turn[nodes.filter(F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "node"), F.lit(2 << idle)) == 0).select("id").toArrow().column("id").to_numpy()] = True
                go = turn[node]
            else:
                go = np.lexsort((node, -more))[:1]
            after = label.copy()
            after[node[go]] = to[go]
            (now, wanted), k = self.look(after, resolution), k + 1
            if now > best + least_rise:
                label, best, wishes, idle, rose = after, now, wanted, 0, True
            else:
                idle += 1
        return label, rose

    def merged(self, label: np.ndarray) -> "Level":
        """Each community one node, under its label, with what it holds inside as a loop."""
        sent, size = self.spark.sparkContext.broadcast(label), self.size

        def between(batches):
            label = sent.value
            for node, start, near, weight in _lists(batches):
                place, to, inside = _sums(label, start, near, weight)
                own = label[node][place]
                some = own <= to  # links between communities are seen from both, those inside twice
                key, back = np.unique(own[some].astype(np.int64) * size + to[some], return_inverse=True)
                yield _rows(("a", "b", "weight"), (key // size).astype(np.int32), (key % size).astype(np.int32), np.bincount(back, inside[some], len(key)))

        parts = self.blocks.mapInArrow(between, "a int, b int, weight double")
        sums = scratch.cut(parts.groupBy("a", "b").agg(F.sum("weight").alias("weight")), "links")
        inner = sums.filter("a = b").select("a", "weight").toArrow()
        loop = np.bincount(label, self.loop, size)
        loop[inner.column("a").to_numpy()] += inner.column("weight").to_numpy() / 2
        out = Level(sums.filter("a <> b"), size, np.bincount(label, self.degree, size), loop)
        sent.destroy()
        return out


def communities(links: DataFrame, ends: DataFrame, seed: int, resolution: float, least_rise: float, patience: int = 2) -> DataFrame:
    """node, community by moves and merges in turn. links: a, b (names, a < b), weight 1; ends: node, every end once."""
    rank = (F.row_number().over(Window.orderBy("node")) - 1).cast("int")  # at most MOST_NODES rows
    nodes = scratch.cut(ends.select("node", rank.alias("id")), "numbered")
    of = lambda end: nodes.select(F.col("node").alias(end), F.col("id").alias(f"_{end}"))
    ids = scratch.cut(links.join(of("a"), "a").join(of("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"), "weight"), "ids")
    size = nodes.count()
    level, labels = Level(ids, size), np.arange(size, dtype=np.int32)
    while True:
        found, rose = level.moved(nodes, seed, resolution, least_rise, patience)
        labels, seed = found[labels], seed + 1
        if not rose:
            break
        level = level.merged(found)
    pairs = nodes.sparkSession.createDataFrame(pa.table({"id": np.arange(size, dtype=np.int32), "to": labels}))
    named = nodes.select(F.col("id").alias("to"), F.col("node").alias("community"))
    return scratch.cut(nodes.select("node", "id").join(pairs, "id").join(named, "to").select("node", "community"), "labels")

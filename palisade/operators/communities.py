"""Weak components and modularity communities of an ownership graph."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.operators import moves
from palisade.operators.components import components
from palisade.sources import scratch


def weak_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, component (the smallest id in it), size; ids are strings, numbered by rank of their hash order within."""
    numbered = scratch.cut(nodes.select("node").distinct().select("node", F.xxhash64("node").alias("id")), "numbered")
    links = edges.select(F.xxhash64("owner").alias("a"), F.xxhash64("asset").alias("b"))
    found = numbered.join(components(links), "id", "left").select("node", F.coalesce("component", "id").alias("c"))
    named = found.groupBy("c").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("size"))
    return found.join(named, "c").select("node", "component", "size")


def component_sizes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return weak_components(edges, nodes).select("component", "size").distinct()


def largest_component(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes of the largest weak component (the smallest name among equals)."""
    found = scratch.cut(weak_components(edges, nodes), "components")
    top = found.select("component", "size").distinct().orderBy(F.desc("size"), "component").limit(1).select("component")
    return found.join(F.broadcast(top), "component", "left_semi").select("node")  # one row


def modularity(links: DataFrame, labels: DataFrame) -> float:
    """Of an undirected weighted graph (a < b, weight) under labels (node, community)."""
    one = links.join(labels.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(labels.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    parts = one.select(F.explode(F.array(F.struct(F.col("ca").alias("c"), F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0).alias("w"), F.col("weight").alias("d")),
                                         F.struct(F.col("cb").alias("c"), F.lit(0.0).alias("w"), F.col("weight").alias("d")))).alias("x"))
    sums = parts.groupBy("x.c").agg(F.sum("x.w").alias("inside"), F.sum("x.d").alias("degree"))
    row = sums.agg(F.sum("inside").alias("inside"), F.sum("degree").alias("degree"), F.sum(F.col("degree") * F.col("degree")).alias("square")).first()
    if not row["degree"]:
        return 0.0
    return 2 * row["inside"] / row["degree"] - row["square"] / row["degree"] ** 2


def _both_ways(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def local_moves(links: DataFrame, seed: int = 42, resolution: float = 1.0, least_rise: float = 1e-3, patience: int = 2) -> tuple[DataFrame, bool]:
    """node, community by moves of single nodes, and whether any move raised modularity. links: a, b (a <= b), weight.

    A share of the nodes (half of them; by a seeded hash of node and round) looks at once for the neighbouring community
    with the highest gain. A round counts only if modularity rises; after one that doesn't, half as many nodes look, and
    after `patience` of them only the node that gains most. Moves end when that raises nothing either. Labels are node ids;
    the driver holds a few numbers a round.
    """
    degree = scratch.cut(_both_ways(links).groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("degree")), "degree")
    both = scratch.cut(_both_ways(links.filter("a <> b")), "both")
    total = degree.agg(F.sum("degree")).first()[0] or 0.0
    labels = degree.select("node", F.col("node").alias("community"))
    best, idle, rose, k = modularity(links, labels), 0, False, 0
    while idle <= patience:
        own = labels.join(degree, "node")
        sums = own.groupBy("community").agg(F.sum("degree").alias("tot"))
        near = (both.join(labels.select(F.col("node").alias("b"), F.col("community").alias("to")), "b").groupBy(F.col("a").alias("node"), "to").agg(F.sum("weight").alias("inside")))
        options = near.join(own, "node").join(sums.withColumnRenamed("community", "to"), "to")
        alone = own.join(sums, "community").select("node", (-F.lit(resolution) * F.col("degree") * (F.col("tot") - F.col("degree")) / F.lit(total)).alias("alone"))
        others = F.col("tot") - F.when(F.col("to") == F.col("community"), F.col("degree")).otherwise(0.0)
        gain = F.col("inside") - F.lit(resolution) * F.col("degree") * others / F.lit(total)
        stay = F.max(F.when(F.col("to") == F.col("community"), F.col("gain")))
        picked = (options.withColumn("gain", gain).groupBy("node", "community").agg(F.max(F.struct("gain", "to")).alias("top"), stay.alias("stay"))
                  .join(alone, "node").select("node", F.col("top.to").alias("to"), (F.col("top.gain") - F.coalesce("stay", "alone")).alias("more")).filter("more > 1e-12"))
        wishes = scratch.cut(picked, "wishes")
        if wishes.isEmpty():
            break
        turn = F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "node"), F.lit(2 << idle)) == 0
        movers = wishes.filter(turn) if idle < patience else wishes.orderBy(F.desc("more"), "node").limit(1)
        moved = scratch.cut(labels.join(movers, "node", "left").select("node", F.coalesce("to", "community").alias("community")), "labels")
        now, k = modularity(links, moved), k + 1
        if now > best + least_rise:
            labels, best, idle, rose = moved, now, 0, True
        else:
            idle += 1
    return labels, rose


def communities(edges: DataFrame, seed: int = 42, resolution: float = 1.0, least_rise: float = 1e-3) -> DataFrame:
    """node, community of the undirected graph, by Louvain's two phases in turn until neither raises modularity by least_rise.

    Nodes move between communities; then each community becomes one node, with what it holds inside as a loop, and these
    move. Labels are ids of nodes. Up to moves.MOST_NODES nodes a round runs over blocks of neighbour lists, beyond that by
    joins of tables; both give the same labels.
    """
    links = edges.filter("owner <> asset").select(F.least("owner", "asset").alias("a"), F.greatest("owner", "asset").alias("b")).distinct().withColumn("weight", F.lit(1.0))
    links, labels = scratch.cut(links, "links"), None
    ends = scratch.cut(links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct(), "ends")
    if 0 < ends.count() <= moves.MOST_NODES:
        return moves.communities(links, ends, seed, resolution, least_rise)
    while True:
        found, rose = local_moves(links, seed, resolution, least_rise)
        up = found.select(F.col("node").alias("community"), F.col("community").alias("_up"))
        labels = found if labels is None else scratch.cut(labels.join(up, "community").select("node", F.col("_up").alias("community")), "labels")
        if not rose:
            return labels
        of = lambda end: found.select(F.col("node").alias(end), F.col("community").alias(f"_{end}"))  # noqa: B023, E731
        joined = links.join(of("a"), "a").join(of("b"), "b")
        links = scratch.cut(joined.groupBy(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).agg(F.sum("weight").alias("weight")), "links")
        seed += 1


def community_profile(labels: DataFrame, nodes: DataFrame, top: int = 15) -> DataFrame:
    """community, size, dominant program, dominant type of the largest communities. nodes: node, entity_type, programs."""
    rows = labels.join(nodes, "node", "left")
    sizes = rows.groupBy("community").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "community").limit(top)

    def dominant(values: DataFrame, name: str) -> DataFrame:
        counts = values.filter(f"{name} is not null").groupBy("community", name).agg(F.count(F.lit(1)).alias("n"))
        return counts.groupBy("community").agg(F.min_by(name, F.struct((-F.col("n")).alias("n"), name)).alias(f"dominant_{name}"))

    programs = dominant(rows.select("community", F.explode("programs").alias("program")), "program")
    types = dominant(rows.select("community", F.col("entity_type").alias("type")), "type")
    return sizes.join(programs, "community", "left").join(types, "community", "left")

"""Ownership graphs: how much of an entity listed parties own, through whom, and the graph's structure.

edges: owner, asset, weight (a share, null where unknown). listed: node. nodes: node. Ids are strings.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.sources import scratch


def clean_edges(edges: DataFrame, unknown_weight: float = 1.0) -> DataFrame:
    return edges.select("owner", "asset", F.coalesce("weight", F.lit(float(unknown_weight))).alias("weight"))


def reach(edges: DataFrame, start: DataFrame, down: bool = True) -> DataFrame:
    """node: all that start (node) reaches, itself left out unless it reaches itself."""
    steps = edges.select(F.col("owner" if down else "asset").alias("node"), F.col("asset" if down else "owner").alias("next")).distinct()
    front = start.select("node").distinct()
    seen = None
    while True:
        new = front.join(steps, "node").select(F.col("next").alias("node")).distinct()
        if seen is not None:
            new = new.join(seen, "node", "left_anti")
        new = scratch.cut(new, "reached")
        if new.isEmpty():
            return seen if seen is not None else new
        seen, front = (new if seen is None else seen.unionByName(new)), new


def listed_fractions(edges: DataFrame, nodes: DataFrame, listed: DataFrame, unknown_weight: float = 1.0) -> DataFrame:
    """node, fraction for every node: 1 if listed, else the capped sum over owners of share x the owner's fraction.

    The cap of 1 holds at every level, listed nodes absorb, and an owner already on the way from the node counts 0. Nodes
    that no cycle is upstream of get their value round by round, each from its owners' final ones. Only nodes below a cycle
    need the tree of paths: it is expanded owner by owner through such nodes alone, then folded back level by level.
    """
    listed = scratch.cut(listed.select("node").distinct(), "listed")
    live = reach(edges, listed).join(listed, "node", "left_anti")  # the others are 0
    able = scratch.cut(live.unionByName(listed), "able")
    # an edge counts if something listed is above it; listed assets absorb
    used = scratch.cut(clean_edges(edges, unknown_weight).join(able.withColumnRenamed("node", "owner"), "owner", "left_semi")
                       .join(live.withColumnRenamed("node", "asset"), "asset", "left_semi"), "used")
    known = listed.withColumn("fraction", F.lit(1.0))
    open_nodes = scratch.cut(live, "open")
    while not open_nodes.isEmpty():
        sums = (used.join(open_nodes.withColumnRenamed("node", "asset"), "asset", "left_semi")
                .join(known.withColumnRenamed("node", "owner"), "owner", "left")
                .groupBy(F.col("asset").alias("node")).agg(F.count_if(F.col("fraction").isNull()).alias("due"), F.least(F.lit(1.0), F.sum(F.col("weight") * F.col("fraction"))).alias("fraction")))
        ready = scratch.cut(sums.filter("due = 0").select("node", "fraction"), "ready")
        if ready.isEmpty():
            known = known.unionByName(_fold_paths(used, known, open_nodes))
            break
        known = known.unionByName(ready)
        open_nodes = scratch.cut(open_nodes.join(ready, "node", "left_anti"), "open")
    everyone = nodes.select("node").unionByName(listed).distinct()
    return everyone.join(known, "node", "left").select("node", F.coalesce("fraction", F.lit(0.0)).alias("fraction"))


def _fold_paths(used: DataFrame, known: DataFrame, roots: DataFrame) -> DataFrame:
    """node, fraction of roots by the tree of their paths; owners in known are leaves."""
    steps = used.join(known.withColumnRenamed("node", "owner"), "owner", "left").select("asset", "owner", "weight", "fraction")
    steps = scratch.cut(steps, "steps")
    level = scratch.cut(roots.select(F.array("node").alias("path"), F.lit(None).cast("array<string>").alias("parent"), F.lit(1.0).alias("weight"), F.lit(None).cast("double").alias("leaf")), "tree")
    levels = []
    while not level.isEmpty():
        levels.append(level)
        head = level.filter("leaf is null").select("path", F.element_at("path", -1).alias("asset"))
        level = scratch.cut(head.join(steps, "asset").filter(~F.array_contains("path", F.col("owner"))).select(
            F.concat("path", F.array("owner")).alias("path"), F.col("path").alias("parent"), "weight", F.col("fraction").alias("leaf")), "tree")
    below = None
    for level in reversed(levels):
        if below is None:
            valued = level.withColumn("value", F.coalesce("leaf", F.lit(0.0)))
        else:
            sums = below.groupBy(F.col("parent").alias("path")).agg(F.least(F.lit(1.0), F.sum(F.col("weight") * F.col("value"))).alias("sum"))
            valued = level.join(sums, "path", "left").withColumn("value", F.coalesce("leaf", "sum", F.lit(0.0)))
        below = scratch.cut(valued.select("path", "parent", "weight", "value"), "fold")
    return below.select(F.element_at("path", 1).alias("node"), F.col("value").alias("fraction"))


def flag_blocked(edges: DataFrame, nodes: DataFrame, listed: DataFrame, threshold: float = 0.5, unknown_weight: float = 1.0) -> DataFrame:
    """node, fraction (4 digits) of nodes that aren't listed and whose fraction, before rounding, reaches the threshold.

    Sums of doubles differ in their last bits by the order of the owners, so 12 digits of the fraction count: what stands
    exactly on the threshold or halfway between two results (then the even one) is decided as such.
    """
    out = listed_fractions(edges, nodes, listed, unknown_weight).join(listed.select("node").distinct(), "node", "left_anti")
    return out.withColumn("fraction", F.round("fraction", 12)).filter(F.col("fraction") >= threshold).select("node", F.bround("fraction", 4).alias("fraction"))


def paths(edges: DataFrame, start: DataFrame, cutoff: int = 6, unknown_weight: float = 1.0, down: bool = True, targets: DataFrame | None = None) -> DataFrame:
    """path (from the owner down to the asset), weight of every simple path of 1 to cutoff edges from (or, up, to) each start node.

    With targets, only paths that end (down) or begin (up) there; each step keeps only nodes that can still lead to one.
    """
    own = clean_edges(edges, unknown_weight)
    near, far = ("owner", "asset") if down else ("asset", "owner")
    if targets is not None:
        leads = reach(edges, targets, down=not down).unionByName(targets.select("node")).distinct()
        own = own.join(leads.withColumnRenamed("node", far), far, "left_semi")
    own = scratch.cut(own, "steps")
    front, out = start.select(F.array("node").alias("path"), F.lit(1.0).alias("weight")), None
    for _ in range(cutoff):
        steps = own.select(F.col(near).alias("_at"), F.col(far).alias("_to"), F.col("weight").alias("_w"))
        new = (front.withColumn("_at", F.element_at("path", -1)).join(steps, "_at").filter(~F.array_contains("path", F.col("_to")))
               .select(F.concat("path", F.array("_to")).alias("path"), (F.col("weight") * F.col("_w")).alias("weight")))
        front = scratch.cut(new, "paths")
        if front.isEmpty():
            break
        out = front if out is None else out.unionByName(front)
    out = front if out is None else out
    if targets is not None:
        out = out.withColumn("node", F.element_at("path", -1)).join(targets.select("node").distinct(), "node", "left_semi").drop("node")
    return out if down else out.withColumn("path", F.reverse("path"))


def ownership_paths(edges: DataFrame, source: str, target: str, cutoff: int = 6, unknown_weight: float = 1.0) -> DataFrame:
    spark = edges.sparkSession
    node = lambda x: spark.createDataFrame([(x,)], "node string")
    return paths(edges, node(source), cutoff, unknown_weight, targets=node(target))


def explain_blocking(edges: DataFrame, start: DataFrame, listed: DataFrame, unknown_weight: float = 1.0, cutoff: int = 6) -> DataFrame:
    """node, listed_node, path, contribution (4 digits): each start node's best path from each listed ancestor, by node and
    from the largest contribution to the smallest; equal ones by listed_node.

    Paths may run through other listed nodes, so contributions need not sum to the fraction. Equal weights: the path that
    sorts first.
    """
    found = paths(edges, start, cutoff, unknown_weight, down=False, targets=listed)
    rows = found.select(F.element_at("path", -1).alias("node"), F.element_at("path", 1).alias("listed_node"), "path", "weight")
    best = rows.groupBy("node", "listed_node").agg(F.max("weight").alias("weight"), F.min_by("path", F.struct((-F.col("weight")).alias("w"), "path")).alias("path"))
    return best.select("node", "listed_node", "path", F.bround("weight", 4).alias("contribution")).orderBy("node", F.desc("contribution"), "listed_node")


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, out_degree, in_degree."""
    one = edges.select("owner", "asset").distinct()
    out = one.groupBy(F.col("owner").alias("node")).agg(F.count(F.lit(1)).alias("out_degree"))
    into = one.groupBy(F.col("asset").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))
    return nodes.select("node").distinct().join(out, "node", "left").join(into, "node", "left").fillna(0, ["out_degree", "in_degree"])


def top_owners(edges: DataFrame, nodes: DataFrame, n: int = 15) -> DataFrame:
    return degrees(edges, nodes).orderBy(F.desc("out_degree"), "node").limit(n)


def find_hub(edges: DataFrame, nodes: DataFrame, part: str, least: int = 50) -> DataFrame:
    """The first node (by id) whose full_name holds `part` and that owns more than `least` others; no row if there is none."""
    named = nodes.filter(F.col("full_name").contains(part)).join(degrees(edges, nodes), "node")
    return named.filter(F.col("out_degree") > least).orderBy("node").limit(1)


def subgraph(edges: DataFrame, keep: DataFrame) -> DataFrame:
    a = keep.select(F.col("node").alias("owner")).distinct()
    return edges.join(a, "owner", "left_semi").join(a.withColumnRenamed("owner", "asset"), "asset", "left_semi")


def without_anchor(edges: DataFrame, nodes: DataFrame, listed: DataFrame, anchor: str, threshold: float = 0.5, unknown_weight: float = 1.0) -> DataFrame:
    """Direct subsidiaries of the anchor that stay blocked when it is taken off the list and out of the graph."""
    direct = edges.filter(F.col("owner") == anchor).select(F.col("asset").alias("node")).distinct()
    rest = nodes.filter(F.col("node") != anchor)
    flagged = flag_blocked(subgraph(edges, rest), rest, listed.filter(F.col("node") != anchor), threshold, unknown_weight)
    return flagged.join(direct, "node", "left_semi")


def structure(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: nodes, edges, owners, assets, isolated nodes, mean out-degree of owners, and three times that."""
    d = degrees(edges, nodes)
    total = edges.select("owner", "asset").distinct().agg(F.count(F.lit(1)).alias("n_edges"))
    mean = F.avg(F.when(F.col("out_degree") > 0, F.col("out_degree")))
    return d.agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("out_degree") > 0).alias("n_owners"), F.count_if(F.col("in_degree") > 0).alias("n_assets"),
                 F.count_if((F.col("in_degree") == 0) & (F.col("out_degree") == 0)).alias("n_isolated"), mean.alias("mean_owned"), (mean * 3).alias("estimated_off_list")).crossJoin(total)

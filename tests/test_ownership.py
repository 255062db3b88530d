"""Ownership fractions, paths and structure; fixtures with exact expectations, and the recursive definition on random graphs."""

import random

import pytest

from palisade.operators import communities, moves, ownership
from palisade.operators.components import components


def graph(spark, edges, listed, lone=()):
    names = {x for e in edges for x in e[:2]} | set(lone) | set(listed)
    return (spark.createDataFrame([(*e, None) if len(e) == 2 else e for e in edges], "owner string, asset string, weight double"),
            spark.createDataFrame([(n,) for n in sorted(names)], "node string"), spark.createDataFrame([(n,) for n in listed], "node string"))


def by_definition(edges, listed, node, unknown=1.0, seen=frozenset()):
    if node in seen:
        return 0.0
    if node in listed:
        return 1.0
    return min(1.0, sum((unknown if w is None else w) * by_definition(edges, listed, a, unknown, seen | {node}) for (a, b), w in edges.items() if b == node))


CASES = [
    ([("S", "C", 0.6)], ["S"], {"S": 1.0, "C": 0.6}), ([("S", "A", 0.6), ("A", "B", 0.7)], ["S"], {"B": 0.42}), ([("S", "A", 0.8), ("A", "B", 0.8), ("B", "C", 0.8)], ["S"], {"C": 0.512}),
    ([("S", "C", 0.3), ("T", "C", 0.3)], ["S", "T"], {"C": 0.6}), ([("S", "C", 0.8), ("T", "C", 0.8)], ["S", "T"], {"C": 1.0}), ([("X", "C", 0.9)], ["Q"], {"C": 0.0}),
    ([("S", "A", 0.6), ("A", "B", 0.5), ("B", "C", 0.5), ("C", "A", 0.5)], ["S"], {"A": 0.6, "B": 0.3, "C": 0.15}), ([("S", "C", None)], ["S"], {"C": 1.0}),
    ([("S", "A", 0.9), ("T", "A", 0.9), ("A", "B", 0.5)], ["S", "T"], {"B": 0.5}), ([("S", "L", 0.1), ("L", "C", 0.7)], ["S", "L"], {"L": 1.0, "C": 0.7})]


def test_fractions(spark):
    """All cases at once, as parts of one graph."""
    edges, listed, want = [], [], {}
    for k, (own, on, values) in enumerate(CASES):
        edges += [(f"{k}{a}", f"{k}{b}", w) for a, b, w in own]
        listed += [f"{k}{x}" for x in on]
        want |= {f"{k}{n}": v for n, v in values.items()}
    got = {r.node: r.fraction for r in ownership.listed_fractions(*graph(spark, edges, listed, ["lone"])).collect()}
    assert got["lone"] == 0
    assert {n: got[n] for n in want} == pytest.approx(want)


def test_random_graphs_equal_the_definition(spark):
    rng = random.Random(3)
    edges, listed = {}, []
    for g in range(12):
        n = rng.randint(3, 6)
        for _ in range(rng.randint(2, 9)):
            a, b = rng.sample(range(n), 2)
            edges[f"{g}.{a}", f"{g}.{b}"] = rng.choice((None, 0.3, 0.6, 0.9))
        listed += [f"{g}.{x}" for x in rng.sample(range(n), rng.randint(1, 2))]
    got = ownership.listed_fractions(*graph(spark, [(*k, w) for k, w in edges.items()], listed), unknown_weight=0.5)
    for r in got.collect():
        assert r.fraction == pytest.approx(by_definition(edges, set(listed), r.node, 0.5)), r.node


def test_flags(spark):
    parts = graph(spark, [("S", "A", 0.49), ("S", "B", 0.5), ("S", "C", 0.8), ("C", "D", 0.8), ("S", "E", 0.6), ("E", "F", 0.6), ("S", "G", 0.75)], ["S"])
    assert {r.node: r.fraction for r in ownership.flag_blocked(*parts).collect()} == {"B": 0.5, "C": 0.8, "D": 0.64, "E": 0.6, "G": 0.75}
    assert {r.node for r in ownership.flag_blocked(*parts, threshold=0.0).collect()} == set("ABCDEFG")


def test_flags_on_the_border_whatever_the_order_of_owners(spark):
    """Shares of 3 to 40 owners that make exactly the threshold, or end halfway between two results."""
    shares = {(whole, n): whole / n / 100000 for whole in (50000, 55555, 55565, 75575, 77475) for n in range(3, 41)}
    edges = [(f"S{k}", f"{whole}.{n}", w) for (whole, n), w in shares.items() for k in range(n)]
    got = {r.node: r.fraction for r in ownership.flag_blocked(*graph(spark, edges, [f"S{k}" for k in range(40)])).collect()}
    want = {50000: 0.5, 55555: 0.5556, 55565: 0.5556, 75575: 0.7558, 77475: 0.7748}
    assert got == {f"{whole}.{n}": want[whole] for whole, n in shares}


def test_paths(spark):
    edges, nodes, listed = graph(spark, [("S", "A", 0.6), ("A", "B", 0.7), ("B", "A", 0.1), ("S", "B", 0.2), ("T", "S", 0.5)], ["S", "T"])
    rows = {tuple(r.path): round(r.weight, 6) for r in ownership.ownership_paths(edges, "S", "B").collect()}
    assert rows == {("S", "A", "B"): 0.42, ("S", "B"): 0.2}
    assert ownership.ownership_paths(edges, "S", "nobody").count() == 0
    assert ownership.ownership_paths(edges, "T", "B", cutoff=2).count() == 1
    why = {r.listed_node: (r.path, r.contribution) for r in ownership.explain_blocking(edges, nodes.filter("node = 'B'"), listed).collect()}
    assert why == {"S": (["S", "A", "B"], 0.42), "T": (["T", "S", "A", "B"], 0.21)}


def test_structure(spark):
    edges, nodes, listed = graph(spark, [("S", "A", 0.6), ("S", "B", 0.6), ("A", "B", 0.1)], ["S"], ["Z"])
    assert {r.node: (r.out_degree, r.in_degree) for r in ownership.degrees(edges, nodes).collect()} == {"S": (2, 0), "A": (1, 1), "B": (0, 2), "Z": (0, 0)}
    row = ownership.structure(edges, nodes).first()
    assert (row.n_nodes, row.n_edges, row.n_owners, row.n_assets, row.n_isolated, row.mean_owned, row.estimated_off_list) == (4, 3, 2, 2, 1, 1.5, 4.5)
    assert {(r.component, r["size"]) for r in communities.component_sizes(edges, nodes).collect()} == {("A", 3), ("Z", 1)}
    assert {r.node for r in communities.largest_component(edges, nodes).collect()} == {"S", "A", "B"}
    assert {r.node for r in ownership.reach(edges, nodes.filter("node = 'B'"), down=False).collect()} == {"S", "A"}
    named = nodes.selectExpr("node", "concat('Group ', node) as full_name")
    assert ownership.find_hub(edges, named, "Group", 1).first().node == "S"
    assert ownership.without_anchor(edges, nodes, listed, "S").count() == 0


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(100, 140)] + [(7, 9), (9, 7), (5, 5)], "a long, b long")
    got = {r.id: r.component for r in components(links).collect()}
    assert got == {k: 100 for k in range(100, 141)} | {7: 7, 9: 7}


def test_communities_find_cliques(spark):
    pairs = [(f"{g}{a}", f"{g}{b}") for g in "xyz" for a in range(5) for b in range(a)] + [("x0", "y0"), ("y1", "z1")]
    edges = spark.createDataFrame(pairs, "owner string, asset string")
    labels = communities.communities(edges)
    links = edges.selectExpr("least(owner, asset) as a", "greatest(owner, asset) as b", "1.0d as weight")
    assert communities.modularity(links, labels) > 0.5
    nodes = labels.selectExpr("node", "'Entity' as entity_type", "array(substr(node, 1, 1)) as programs")
    top = communities.community_profile(labels, nodes).collect()
    assert sum(r["size"] for r in top) == 15


def test_communities_end_where_no_merge_or_move_gains(spark):
    """Against all single moves and merges of the final communities, by modularity's definition."""
    rng = random.Random(6)
    links = {tuple(sorted((f"{g}.{i}", f"{g}.{j}"))) for g in range(12) for i in range(5) for j in range(i)}
    links |= {tuple(sorted((f"{g}.0", f"{(g + 1) % 12}.0"))) for g in range(12)}
    links |= {tuple(sorted(rng.sample([f"{g}.{i}" for g in range(12) for i in range(5)], 2))) for _ in range(15)}
    edges = spark.createDataFrame([(a, b, None) for a, b in links] + [("0.0", "0.0", None), ("0.1", "0.0", 0.5)], "owner string, asset string, weight double")
    label = {r.node: r.community for r in communities.communities(edges, least_rise=1e-6).collect()}
    degree = {n: sum(n in e for e in links) for n in label}

    def quality(of):
        inside = sum(of[a] == of[b] for a, b in links) / len(links)
        return inside - sum((sum(degree[n] for n in of if of[n] == c) / (2 * len(links))) ** 2 for c in set(of.values()))

    reached = quality(label)
    assert set(label) == {n for e in links for n in e}
    assert all(quality({n: c if x == d else x for n, x in label.items()}) <= reached + 1e-5 for c in set(label.values()) for d in set(label.values()))
    assert all(quality(label | {n: c}) <= reached + 1e-5 for n in label for c in set(label.values()))
    assert reached > 0.7


def test_communities_by_blocks_equal_those_by_tables_in_few_jobs(spark, monkeypatch):
    """The rounds' jobs are what large graphs take long for, so they are counted too."""
    rng = random.Random(9)
    links = {tuple(rng.sample([f"{g}.{i}" for i in range(12)], 2)) for g in range(20) for _ in range(40)}
    links |= {(f"{g}.{rng.randrange(12)}", f"{h}.{rng.randrange(12)}") for g in range(20) for h in range(20) if rng.random() < 0.4}
    edges = spark.createDataFrame([*links, ("1.1", "1.1")], "owner string, asset string")
    monkeypatch.setattr(moves, "ENTRIES", 300)  # several blocks at every level

    def found(group):
        spark.sparkContext.setJobGroup(group, group)
        try:
            labels = {r.node: r.community for r in communities.communities(edges, least_rise=1e-4).collect()}
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return labels, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    by_blocks, few = found("blocks")
    monkeypatch.setattr(moves, "MOST_NODES", 0)
    by_tables, many = found("tables")
    assert by_blocks == by_tables
    assert 1 < len(set(by_blocks.values())) < len(by_blocks)
    assert 3 * few < many, (few, many)

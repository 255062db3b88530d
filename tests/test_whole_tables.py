"""Registered queries against plain Python over the whole of the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from pyspark.sql import functions as F

from palisade.functions import arabic
from palisade.functions.kernels import metaphone_string
from palisade.functions.scores import plain_normalize, plain_scores
from palisade.operators import communities, querygen, screening
from palisade.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def column(name, *columns):
    return duckdb.connect().execute(f"select {', '.join(columns)} from '{SF}/{name}.parquet'").fetchall()


@pytest.fixture(scope="module")
def trade():
    """Edges and nodes from every row of the tables, without a filter."""
    customers = {k for k, in column("customer", "c_custkey")}
    buyer = {o: c for o, c in column("orders", "o_orderkey", "o_custkey") if c in customers}
    edges = {(f"s{s}", f"c{buyer[o]}") for o, s in column("lineitem", "l_orderkey", "l_suppkey") if o in buyer}
    return edges, {f"s{k}" for k, in column("supplier", "s_suppkey")} | {f"c{k}" for k in customers}


def components_of(edges, nodes):
    near = {n: [] for n in nodes}
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    seen, out = set(), []
    for n in sorted(nodes):
        if n not in seen:
            group, todo = {n}, [n]
            while todo:
                new = set(near[todo.pop()]) - group
                group |= new
                todo += new
            seen |= group
            out.append(group)
    return out


def test_degrees_of_all_edges(spark, trade):
    edges, nodes = trade
    out, into = Counter(a for a, _ in edges), Counter(b for _, b in edges)
    want = {n: (out[n], into[n]) for n in nodes}
    assert {r.node: (r.out_degree, r.in_degree) for r in catalogue.QUERIES["degrees"](spark, SF).collect()} == want
    top = sorted(((-o, n) for n, (o, _) in want.items()))[:15]
    assert [(-r.out_degree, r.node) for r in catalogue.QUERIES["top_owners"](spark, SF).collect()] == top


def test_structure_of_all_edges(spark, trade):
    edges, nodes = trade
    row = catalogue.QUERIES["graph_structure"](spark, SF).first()
    owners, assets = {a for a, _ in edges}, {b for _, b in edges}
    assert (row.n_nodes, row.n_edges, row.n_owners, row.n_assets, row.n_isolated) == (len(nodes), len(edges), len(owners), len(assets), len(nodes - owners - assets))
    assert row.mean_owned == pytest.approx(len(edges) / len(owners), abs=1e-6)


def test_components_of_all_edges(spark, trade):
    want = Counter((min(g), len(g)) for g in components_of(*trade))
    assert Counter((r.component, r["size"]) for r in catalogue.QUERIES["weak_components"](spark, SF).collect()) == want


def test_components_of_several_groups(spark):
    """The whole tables make one large component and lone nodes, so several are made here."""
    edges = {(f"s{k}", f"c{k % 5 + 5 * j}") for k in range(20) for j in range(3) if k % 5 != 4}
    nodes = {x for e in edges for x in e} | {"s4", "c99"}
    got = communities.component_sizes(spark.createDataFrame(sorted(edges), "owner string, asset string"), spark.createDataFrame([(n,) for n in sorted(nodes)], "node string"))
    want = Counter((min(g), len(g)) for g in components_of(edges, nodes))
    assert len(want) == 6
    assert Counter((r.component, r["size"]) for r in got.collect()) == want


def test_communities_cover_the_largest_component(spark, trade):
    sizes = [r["size"] for r in catalogue.QUERIES["community_sizes"](spark, SF).collect()]
    assert sum(sizes) == max(map(len, components_of(*trade)))


def test_scorers_face_all_negatives(spark):
    names = [r.query_name for df in (querygen.generate_hard_negatives(spark), querygen.generate_near_miss_negatives(spark)) for r in df.collect()]
    listed = {n for n, in column("part", "p_name")}
    best = {q: max(plain_scores(q, n)["jaro_winkler"] for n in listed) for q in set(names)}
    rows = {r.scorer: r for r in catalogue.QUERIES["scorer_summary"](spark, SF).collect()}
    assert {k: r.fp + r.tn for k, r in rows.items()} == dict.fromkeys(screening.SCORERS, 1200)
    assert rows["jw"].fp == sum(best[q] >= rows["jw"].threshold for q in names)


@pytest.fixture(scope="module")
def brand_pairs():
    """Pairs of different part names of a brand."""
    named = set(column("part", "p_brand", "p_name"))
    return {(b, x, y) for b, x in named for c, y in named if b == c and x < y}


def test_scores_of_all_pairs(spark, brand_pairs):
    want = {k: plain_scores(k[1], k[2]) for k in brand_pairs}
    rows = catalogue.QUERIES["score_all_pairs"](spark, SF).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert {k: r[k] for k in ("jaro_winkler", "token_set", "phonetic", "ensemble")} == pytest.approx(want[r.p_brand, r.name_a, r.name_b])
    for name, kind in (("token_set_pairs", "token_set"), ("phonetic_pairs", "phonetic")):
        got = {(r.p_brand, r.name_a, r.name_b): r.score for r in catalogue.QUERIES[name](spark, SF).collect()}
        assert got == pytest.approx({k: v[kind] for k, v in want.items()})


def test_gains_of_all_pairs(spark, brand_pairs):
    names = sorted({n for _, x, y in brand_pairs for n in (x, y)})
    forms = {r.name: r.form for r in spark.createDataFrame([(n,) for n in names], "name string").select("name", arabic.canonical_form(F.col("name")).alias("form")).collect()}
    sums = {}
    for _, x, y in brand_pairs:
        base, new = plain_scores(x, y)["ensemble"], plain_scores(forms[x], forms[y])["ensemble"]
        sums.setdefault("match" if new >= 1 else "improved" if new > base + 0.01 else "unchanged", []).append((base, new))
    rows = catalogue.QUERIES["canonical_gain_summary"](spark, SF).collect()
    assert {r.outcome: r.n for r in rows} == {k: len(v) for k, v in sums.items()}
    for r in rows:
        own = sums[r.outcome]
        assert (r.mean_base, r.mean_canonical, r.mean_gain) == pytest.approx((sum(b for b, _ in own) / len(own), sum(c for _, c in own) / len(own), sum(c - b for b, c in own) / len(own)))


def test_best_matches_and_failures(spark):
    listed = sorted({n for n, in column("part", "p_name")})
    kinds = dict(zip(screening.SCORERS, ("jaro_winkler", "token_set", "phonetic", "ensemble"), strict=True))
    missed = {}
    for r in catalogue.QUERIES["ensemble_best"](spark, SF).collect():
        scored = [(plain_scores(r.query_name, n), n) for n in listed]
        for k, kind in kinds.items():
            score, name = max(((s[kind], n) for s, n in scored), key=lambda x: (round(x[0], 12), [-ord(c) for c in x[1]]))
            assert r[f"{k}_score"] == pytest.approx(score)
            if k == "ens" and (score < 0.9 or name != r.true_entity_id):
                missed[r.q_ord] = "below_threshold" if score < 0.9 else "wrong_match"
    assert {r.q_ord: r.reason for r in catalogue.QUERIES["residual_failures"](spark, SF).collect()} == missed


def test_blocks_of_all_names(spark):
    listed = sorted({n for n, in column("part", "p_name")})
    codes = {n: metaphone_string(plain_normalize(n).split()[0]) for n in listed}
    rows = catalogue.QUERIES["phonetic_block"](spark, SF).collect()
    assert {r.name for r in rows} <= set(listed)
    for q, query in {(r.q_ord, r.query_name) for r in rows}:
        key = {r.block_key for r in rows if r.q_ord == q}
        assert len(key) == 1
        got = {r.name for r in rows if r.q_ord == q}
        assert got == {n for n in listed if codes[n] in key}

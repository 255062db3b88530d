"""Jaccard groups, substring dedup and the components they use, against brute force."""

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from palisade.llm import jaccard_groups, sketch, substring_dedup
from tests.llm.helpers import corpus, documents, tokens


def brute_components(rows, percent=85):
    def shingles(t):
        w = tokens(t, True)
        return frozenset(tuple(w[k:k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])

    items = [(i, shingles(t)) for i, t in rows if i is not None]
    label = {i: i for i, _ in items}
    partners = {}  # of a text's set: the other documents' texts that it links with

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in items:
        for j, b in items:
            if i < j and a and b and 100 * len(a & b) >= percent * len(a | b):
                partners.setdefault((i, a), set()).add((j, b))
                partners.setdefault((j, b), set()).add((i, a))
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    return Counter((i, len(s := shingles(t)), None if i is None else find(i), len(partners.get((i, s), ()))) for i, t in rows)


def test_components_equal_brute_force(spark):
    got = Counter(tuple(r) for r in jaccard_groups.join_near(documents(spark)).collect())
    assert got == brute_components(corpus())


@pytest.mark.parametrize("broadcast", [0])
def test_components_without_broadcasts(spark, monkeypatch, broadcast):
    monkeypatch.setattr(jaccard_groups, "BROADCAST_IDS", broadcast)
    got = Counter(tuple(r) for r in jaccard_groups.join_near(documents(spark)).collect())
    assert got == brute_components(corpus())


def test_components_with_an_overfull_sketch(spark, monkeypatch):
    monkeypatch.setattr(sketch, "is_set", lambda bitmap, cells: cells >= 0)
    got = Counter(tuple(r) for r in jaccard_groups.join_near(documents(spark)).collect())
    assert got == brute_components(corpus())


def test_links_between_groups_are_found(spark):
    """Chains whose ends don't meet, so that groups must query each other."""
    base = [f"t{k}" for k in range(200)]
    rows = [(100 - j, " ".join(base[5 * j:] + [f"n{j}x{k}" for k in range(5 * j)])) for j in range(20)]
    got = Counter(tuple(r) for r in jaccard_groups.join_near(documents(spark, rows)).collect())
    assert got == brute_components(rows)


def near_copies(n, length=200, seed=3):
    """Copies of one text with a few changed words each, so that some pairs are just over the border and some just under it."""
    rng = random.Random(seed)
    base = [f"t{k}" for k in range(length)]
    rows = []
    for i in range(n):
        at = rng.sample(range(length), rng.choice((2, 3, 4, 5)))
        rows.append((i + 1, " ".join(f"c{rng.randrange(40)}" if k in at else w for k, w in enumerate(base))))
    return rows


@pytest.mark.parametrize("box_bytes", [1 << 20, 1 << 14])
def test_a_large_group_at_the_border(spark, monkeypatch, box_bytes):
    monkeypatch.setattr(jaccard_groups, "BOX_BYTES", box_bytes)
    monkeypatch.setattr(jaccard_groups, "PART_BYTES", 4 * box_bytes)
    rows = near_copies(400)
    got = Counter(tuple(r) for r in jaccard_groups.join_near(documents(spark, rows)).collect())
    want = brute_components(rows)
    assert got == want
    assert 0 < sum(n for *_, n in want) < 400 * 399 // 2  # some pairs link, most don't


def test_tokens_of_many_boxes_are_split(spark, monkeypatch):
    monkeypatch.setattr(jaccard_groups, "HOT_POSTINGS", 5)
    monkeypatch.setattr(jaccard_groups, "BOX_BYTES", 1 << 13)
    rows = near_copies(120) + [(1000 + i, t) for i, t in corpus() if i is not None]
    got = Counter(tuple(r) for r in jaccard_groups.join_near(documents(spark, rows)).collect())
    assert got == brute_components(rows)


def test_every_text_of_a_repeated_id_counts(spark):
    one, two = (" ".join(f"{c}{k}" for k in range(n)) for c, n in (("p", 60), ("q", 90)))
    rows = [(5, one), (5, two), (2, one + " end"), (9, two + " end"), (3, two)]
    got = Counter(tuple(r) for r in jaccard_groups.join_near(documents(spark, rows)).collect())
    assert got == brute_components(rows)


def test_keep_one(spark):
    kept = jaccard_groups.keep_one(documents(spark))
    assert kept.columns == documents(spark).columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    want = {c for _, _, c, _ in brute_components(corpus()) if c is not None}
    assert ids == sorted(want)
    assert kept.filter("doc_id is null").count() == 2


def brute_removed(rows, window=50):
    first = {}
    for i, t in rows:
        w = tokens(t)
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k:k + window])
                first[key] = min(first.get(key, i), i)
    out = Counter()
    for i, t in rows:
        w = tokens(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k:k + window])] < i:
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i, len(w), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("broadcast", [0, 1_000_000])
def test_removed_words_equal_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(substring_dedup, "BROADCAST_IDS", broadcast)
    got = Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in substring_dedup.remove_repeats(documents(spark)).collect())
    assert got == brute_removed(corpus())


@pytest.mark.parametrize("most_bits", [0, 8])
def test_a_sketch_kept_as_a_table(spark, monkeypatch, most_bits):
    monkeypatch.setattr(sketch, "MOST_BITS", most_bits)
    docs = documents(spark)
    got = Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in substring_dedup.remove_repeats(docs).collect())
    assert got == brute_removed(corpus())
    assert substring_dedup.remove_repeats(documents(spark, [])).count() == 0


def test_overfull_sketch_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(sketch, "is_set", lambda bitmap, cells: cells >= 0)
    rows = corpus()[:40]
    got = Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in substring_dedup.remove_repeats(documents(spark, rows)).collect())
    assert got == brute_removed(rows)


def test_rewrite_keeps_columns_and_white_space(spark):
    docs = documents(spark)
    out = substring_dedup.rewrite(docs)
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    assert 10 not in rows and rows[3].text == dict(corpus())[3]  # 10 is a copy of 3
    assert all(len(r.text) == r.n_chars for r in rows.values() if r.text is not None)


def test_empty_tables(spark):
    docs = documents(spark, [])
    assert jaccard_groups.join_near(docs).count() == 0
    assert jaccard_groups.keep_one(docs).count() == 0
    assert substring_dedup.remove_repeats(docs).count() == 0
    assert substring_dedup.rewrite(docs).count() == 0


def test_prefixes_are_dealt_out_without_a_second_worker(spark):
    rng = np.random.default_rng(3)
    sizes = [0, 1, 5, 40]
    rows = [(k, n, 10 + k, 20 + k, k, rng.integers(-9, 9, n).tolist()) for k, n in enumerate(sizes)]
    sets = spark.createDataFrame(rows, "id long, n long, d1 long, least long, own long, prefix array<long>")
    found = jaccard_groups.postings(sets)
    assert "InArrow" not in found._jdf.queryExecution().toString()  # each one in a stage is a worker more for each task
    assert sorted(map(tuple, found.collect())) == sorted((t, own, i, n, d1, least) for i, n, d1, least, own, prefix in rows for t in prefix)


def test_a_stage_before_the_exchange_of_postings_has_one_worker(spark):
    rows = documents(spark).selectExpr("doc_id AS id", "text")
    held = spark.sparkContext.broadcast((np.zeros(0, np.uint64), np.zeros(0, np.int64), np.full(1 << 13, 255, np.uint8)))
    plan = jaccard_groups.postings(jaccard_groups.prefix_sets(rows, held, 4, 85, 16))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1, plan


@pytest.mark.parametrize("kind", [np.int64, np.uint32])
def test_packed_cells_take_little_memory(kind):
    cells = np.random.default_rng(4).integers(0, 1 << 21, 1 << 20).astype(kind)
    want = Counter(cells.tolist())
    tracemalloc.start()
    chunk, low, twice = sketch.packed(cells)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3.8 * cells.nbytes, peak
    got = {}
    for c, x, t in zip(chunk.tolist(), low, twice, strict=True):
        x = np.frombuffer(x, "<u2").astype(np.int64) + (c << sketch.CHUNK_BITS)
        got |= dict(zip(x.tolist(), np.unpackbits(np.frombuffer(t, np.uint8), count=len(x)).tolist(), strict=True))
    assert got == {c: int(n > 1) for c, n in want.items()}

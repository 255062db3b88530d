"""The pipeline's near-duplicate stage against brute force, with copies close to its border."""

import random

import corpus_pipeline
from tests.llm.helpers import documents, words


def shingles(text):
    w = text.split()
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)}


def test_copies_near_the_border(spark):
    rng = random.Random(11)
    rows = []
    for g, changes in enumerate((20, 21, 22, 23, 24)):
        base = words(rng, 1000, 100_000).split()
        copy = [f"x{g}y{k}" if k % 40 == 20 and k // 40 < changes else w for k, w in enumerate(base)]
        rows += [(10 * g, " ".join(base)), (10 * g + 1, " ".join(copy))]
    near = {j for i, a in rows for j, b in rows if i < j and 100 * len(shingles(a) & shingles(b)) >= 80 * len(shingles(a) | shingles(b))}
    assert near == {1, 11, 21}  # 20, 21 and 22 of 1000 words: Jaccard 0.818, 0.809, 0.801; 23 gives 0.793
    kept = corpus_pipeline.jaccard_join(spark, documents(spark, rows), None)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({i for i, _ in rows} - near)

"""Best corpus rows of a block of queries; kernels run only on pairs whose upper bounds reach the best score so far."""

from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa

from palisade.functions import kernels

SCORERS = ("jw", "ts", "ph", "ens")
CLASSES = 96
AT_ONCE = 64
SLACK = 1e-9  # of sums in another order


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


class Counts:
    """How often each class of characters (code points modulo CLASSES) occurs in each text.

    Two texts have at least as many classes in common as characters, so common classes bound matches and subsequences.
    """

    def __init__(self, texts: Sequence[str]):
        self.length = np.array([len(t) for t in texts], np.int64)
        cell = np.repeat(np.arange(len(texts)), self.length) + len(texts) * (_points("".join(texts)) % CLASSES)
        self.table = np.bincount(cell, minlength=CLASSES * len(texts)).reshape(CLASSES, -1).astype(np.int32)

    def common(self, text: str) -> np.ndarray:
        own = np.bincount(_points(text) % CLASSES, minlength=CLASSES).astype(np.int32)
        at = np.flatnonzero(own)
        return np.minimum(self.table[at], own[at, None]).sum(axis=0)


class Names:
    """Bounds of Jaro-Winkler."""

    def __init__(self, texts: Sequence[str]):
        self.counts = Counts(texts)
        self.heads = np.array([_head(t) for t in texts], np.int64).reshape(len(texts), 4)

    def bound(self, query: str) -> np.ndarray:
        m = self.counts.common(query)
        jaro = np.where(m > 0, (m / max(len(query), 1) + m / np.maximum(self.counts.length, 1) + 1) / 3, 0.0)
        same = self.heads == np.array(_head(query, -2), np.int64)
        prefix = np.cumprod(same, axis=1).sum(axis=1)
        return np.where(jaro > 0.7, jaro + 0.1 * prefix * (1 - jaro), jaro)


def _head(text: str, filler: int = -1) -> list[int]:
    return ([ord(c) for c in text[:4]] + [filler] * 4)[:4]


class TokenSets:
    """Bounds of the token set ratio: 1 where a token is shared, else by the characters in common."""

    def __init__(self, texts: Sequence[str]):
        sets = [set(t.split()) for t in texts]
        self.counts = Counts([" ".join(s) for s in sets])
        self.rows: dict[str, list[int]] = defaultdict(list)
        for i, s in enumerate(sets):
            for token in s:
                self.rows[token].append(i)

    def bound(self, query: str) -> np.ndarray:
        tokens = set(query.split())
        plain = " ".join(tokens)
        out = 2 * self.counts.common(plain) / np.maximum(self.counts.length + len(plain), 1)
        for token in tokens:
            out[self.rows.get(token, [])] = 1.0
        return out


def best_rows(batches: Iterator[pa.RecordBatch], queries: Sequence[tuple[str, str]], weights: Mapping[str, float]) -> Iterator[pa.RecordBatch]:
    """batches: c_ord, entity_id, norm, codes. queries: norm, codes. One row per query and scorer: norm, scorer, entity_id,
    c_ord, score of the best row of all batches, the lowest c_ord among equals."""
    share = [weights.get(k, 0) for k in ("jaro_winkler", "token_set", "phonetic")]
    best: list[list[tuple[float, int, str | None]] | None] = [None] * len(queries)
    for b in batches:
        if not b.num_rows:
            continue
        orders, entities, norms, codes = (c.to_pylist() for c in b.columns)
        names, tokens, sounds = Names(norms), TokenSets(norms), TokenSets(codes)
        for q, (norm, sound) in enumerate(queries):
            bounds = np.stack([names.bound(norm), tokens.bound(norm), sounds.bound(sound)])
            whole = np.array(share) @ bounds if min(share) >= 0 else np.full(len(orders), np.inf)
            bounds = np.vstack([bounds, whole]) + SLACK
            now = best[q] or [(-np.inf, 0, None)] * len(SCORERS)
            left = np.argsort(-whole, kind="stable")
            while len(left):
                for i in left[:AT_ONCE].tolist():
                    wanted = [bounds[k, i] >= now[k][0] for k in range(4)]
                    scores: list[float | None] = [None] * 4
                    if wanted[0] or wanted[3]:
                        scores[0] = kernels.jaro_winkler(norm, norms[i])
                    if wanted[1] or wanted[3]:
                        scores[1] = kernels.token_set(norm, norms[i])
                    if wanted[2] or wanted[3]:
                        scores[2] = kernels.token_set(sound, codes[i])
                    if wanted[3]:
                        scores[3] = share[0] * scores[0] + share[1] * scores[1] + share[2] * scores[2]
                    for k, score in enumerate(scores):
                        if score is not None and (score, -orders[i]) > now[k][:2]:
                            now[k] = (score, -orders[i], entities[i])
                left = left[AT_ONCE:]
                least = np.array([[x[0]] for x in now])
                left = left[(bounds[:, left] >= least).any(axis=0)]
            best[q] = now
    rows = [(queries[q][0], kind, e, -o, s) for q, found in enumerate(best) if found for kind, (s, o, e) in zip(SCORERS, found, strict=True)]
    if rows:
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64())
        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["norm", "scorer", "entity_id", "c_ord", "score"])

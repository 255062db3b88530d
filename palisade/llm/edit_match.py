"""Benchmark decontamination by pigeonhole edit matching.

A test item that occurs in a document with at most k edits, cut into k + 1 pieces, has at least one piece there
unchanged. An Aho-Corasick automaton of all pieces finds exact piece hits in one pass over a document; each hit fixes
where the item would lie, and Myers' bit-parallel algorithm gives the least edit distance of the item to any substring
around it. Texts are compared in lower case, ASCII punctuation and white space as single spaces.
"""

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.words import bound_batches, slices, tidied
from palisade.sources import scratch

CHARS_PER_EDIT = 25
BLOCK_CHARS = 4 << 20
KNOWN_WINDOWS = 1000
_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def plain(text: str | None) -> str:
    """Lower case, words joined by one space, UTF-8 bytes as one character each."""
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split()).decode("latin-1")


def pieces_of(item: str, chars_per_edit: int = CHARS_PER_EDIT) -> tuple[int, list[tuple[int, str]]]:
    """The error budget k, and k + 1 pieces with their offsets."""
    k = max(0, len(item) // chars_per_edit - 1)
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return k, [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def least_distance(item_masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of the item (of length m) to a substring of text, and where the first such substring ends."""
    high, full = 1 << (m - 1), (1 << m) - 1
    plus, minus, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = item_masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        hp = minus | ~(xh | plus) & full
        hm = plus & xh
        if hp & high:
            score += 1
        elif hm & high:
            score -= 1
            if score < best:
                best, end = score, j
        hp = hp << 1 & full  # a match may start anywhere
        plus = (hm << 1 & full) | ~(xv | hp) & full
        minus = hp & xv
    return best, end


class Matcher:
    def __init__(self, items: list[tuple[int, str]], chars_per_edit: int):
        self.items = [(i, t, *pieces_of(t, chars_per_edit)) for i, t in items]
        self.masks: dict[int, dict[str, int]] = {}
        found: dict[str, list[tuple[int, int]]] = {}
        for n, (_, _, _, pieces) in enumerate(self.items):
            for at, piece in pieces:
                found.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in found.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def hits(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, end in the plain text) of the best match of each item that lies in the text within its budget."""
        best: dict[int, tuple[int, int, int]] = {}
        if self.empty or not text:
            return []
        done: dict[int, set[int]] = {}
        known: dict[tuple[int, str], tuple[int, int]] = {}  # repetitive texts bring the same windows again
        for last, (size, owners) in self.automaton.iter(text):
            for n, at in owners:
                if n in best and best[n][0] == 0:
                    continue
                _, item, k, _ = self.items[n]
                where, m = last + 1 - size - at, len(item)
                places = done.setdefault(n, set())
                if where in places:
                    continue
                places.add(where)
                if where >= 0 and text.startswith(item, where):
                    best[n] = (0, where, where + m)
                    continue
                if k:
                    start = max(0, where - k)
                    window = text[start:where + m + k]
                    if (n, window) not in known:
                        if len(known) >= KNOWN_WINDOWS:
                            known.clear()
                        known[n, window] = least_distance(self.masks.setdefault(n, masks(item)), m, window)
                    d, end = known[n, window]
                    if d <= k and (n not in best or d < best[n][0]):
                        best[n] = (d, max(start, start + end - m), start + end)
        return [(self.items[n][0], *x) for n, x in sorted(best.items())]


HITS = "doc_id long, item_id long, distance int, start long, end long"


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """Items in plain form, in blocks of bounded size; equal items are matched once each."""
    block, held = [], 0
    for row in benchmark.select(F.col(id_col).cast("long"), F.col(text_col)).dropDuplicates().toLocalIterator():
        text = plain(row[1])
        if not text:
            continue
        block.append((row[0], text))
        held += len(text)
        if held >= block_chars:
            yield block
            block, held = [], 0
    if block:
        yield block


def find_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", chars_per_edit: int = CHARS_PER_EDIT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each document and test item that occurs in it within the item's budget of one edit in chars_per_edit.

    distance is the least of all places; start and end give the first such place in the plain text. The test set is the
    stated query set: its items go to the workers in blocks of about block_chars, each block a pass over the documents.
    Null, empty and all-punctuation texts match nothing; an item shorter than twice chars_per_edit must occur unchanged.
    Repeated rows of docs give repeated matches. Further columns of either table, whatever their names, are dropped; an
    empty table on either side gives no rows.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    out = None
    for block in benchmark_blocks(benchmark, item_id_col, item_text_col, block_chars):
        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, chars_per_edit)
            for b in batches:
                found = [(doc, *hit) for ids, texts in slices(b, 1) for doc, text in zip(ids, texts, strict=True) if text for hit in matcher.hits(plain(text))]
                if found:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                    yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*found, strict=True), kinds, strict=True)], ["doc_id", "item_id", "distance", "start", "end"])

        part = rows.mapInArrow(tidied(run), HITS)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], HITS)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Rows of docs without any match (a null id is kept only if no document with a null id matches, and rows that repeat an id
    go together). All columns pass, whatever their names; an empty table or test set takes nothing out."""
    bad = scratch.cut(find_matches(docs, benchmark, id_col, **options).select("doc_id").distinct(), "leaks").withColumnRenamed("doc_id", "_bad")
    if bad.count() <= 1_000_000:
        bad = F.broadcast(bad)
    return docs.join(bad, docs[id_col].cast("long").eqNullSafe(F.col("_bad")), "left_anti")

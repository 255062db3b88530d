"""Substring dedup: words under a long window that an earlier document has too are removed.

Pass 1 sketches. Every window of `window` words holds the same minimiser (its least hash of `window / 2` words) wherever
it occurs, so counts of minimisers overestimate counts of windows at a thirteenth of the work. Each task gathers the
cells of two count-min rows that its documents' minimisers fall into; the tasks' sketches are merged by ranges of cells
into one bit a cell: hit by two documents or more. Pass 2 hashes every window whose minimiser's cells are both set, and
groups these exactly, by 128 bits, to the smallest document id. No window that repeats is lost: a cell that two documents
hit is set. Exact copies of a text are set aside before, by its 128-bit hash.

The merged bits are broadcast while they fit `sketch.MOST_BITS` (about 7 GB of text). Beyond it they would be full and
keep every window, so there the sketch stays a table, one row of 2**64 cells counted by a grouping, and each text gets the
cells of its own that two documents hit. Both ways overestimate only, so results are the same.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.sources import scratch
from palisade.llm import sketch
from palisade.llm.words import MIX, WordHashes, bound_batches, flat_hashes, mix, parts, slices, tidied, window_owner, words_of

WINDOW = 50
ROWS = 2
BROADCAST_IDS = 1_000_000


def poly_windows(flat: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash modulo 2**64 of the n words from each position."""
    if len(flat) < n:
        return flat[:0]
    inverse = pow(int(base), -1, 1 << 64)
    up = np.cumprod(np.full(len(flat), base, dtype=np.uint64))
    down = np.cumprod(np.full(len(flat), inverse, dtype=np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(flat * up, dtype=np.uint64)])
    return mix((sums[n:] - sums[:-n]) * down[:len(flat) - n + 1])


def minimisers(flat: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window in a text: position, text number, and hash of its minimiser."""
    at, owner = window_owner(starts, window)
    if not len(at):
        return at, owner, flat[:0]
    k = window // 2
    grams = poly_windows(mix(flat + MIX[0]), k, MIX[0])
    least = grams.copy()  # over 1, 2, 4... positions, then over the whole span
    span, width = window - k + 1, 1
    while width * 2 <= span:
        least = np.minimum(least[:len(least) - width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[:len(least) - (span - width)], least[span - width:])
    return at, owner, least[at]


def cells_of(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix(hashes + MIX[r + 1]) >> np.uint64(64 - bits)).astype(np.int64) for r in range(ROWS)]


def cells_wanted(total_bytes: int) -> float:
    """About six cells a row for each minimiser that so many bytes hold."""
    return total_bytes / 80 * 6


def merged_sketch(texts: DataFrame, bits: int, window: int) -> np.ndarray:
    """Bits (one array a row) of the cells that at least two documents' minimisers fall into."""
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        held: list[list[np.ndarray]] = [[] for _ in range(ROWS)]

        def out() -> Iterator[pa.RecordBatch]:
            for r in range(ROWS):
                if held[r]:
                    joined = np.concatenate(held[r])
                    held[r].clear()
                    yield pa.record_batch([pa.array(x) for x in sketch.packed(joined, ROWS, r)], ["chunk", "cells", "twice"])

        for b in batches:
            for (part,) in slices(b, 0):
                flat, starts = flat_hashes(map(words_of, part), cache)
                _, owner, least = minimisers(flat, starts, window)
                if not len(least):
                    continue
                new = np.concatenate([[True], (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])])
                key = np.unique(np.stack([owner[new].astype(np.uint64), least[new]]), axis=1)[1]
                for r, cells in enumerate(cells_of(key, bits)):
                    held[r].append(cells.astype(np.uint32))
                if sum(map(len, held[0])) > 1 << 20:
                    yield from out()
        yield from out()

    return sketch.merged(texts.mapInArrow(tidied(gather), "chunk long, cells binary, twice binary"), bits, ROWS)


WINDOWS = "w1 long, w2 long, id long, text long, at int"


def _window_rows(flat: np.ndarray, starts: np.ndarray, at: np.ndarray, owner: np.ndarray, ids: list, hashes: list, window: int) -> pa.RecordBatch:
    w1 = poly_windows(mix(flat + MIX[1]), window, MIX[2])[at]
    w2 = poly_windows(mix(flat + MIX[2]), window, MIX[3])[at]
    return pa.record_batch([pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), pa.array(np.array(ids, np.int64)[owner]),
                            pa.array(np.array(hashes, np.int64)[owner]), pa.array((at - starts[owner]).astype(np.int32))], ["w1", "w2", "id", "text", "at"])


def repeated_windows(texts: DataFrame, held, bits: int, window: int) -> DataFrame:
    """Windows that the sketch holds for repeated. texts: id, text, hash of the text; held: the sketch as a Spark broadcast."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, bitmaps = WordHashes(), held.value
        for b in batches:
            for ids, part, hashes in slices(b, 1):
                flat, starts = flat_hashes(map(words_of, part), cache)
                at, owner, least = minimisers(flat, starts, window)
                keep = np.ones(len(at), bool)
                for bitmap, cells in zip(bitmaps, cells_of(least, bits), strict=True):
                    keep &= sketch.is_set(bitmap, cells)
                if keep.any():
                    yield _window_rows(flat, starts, at[keep], owner[keep], ids, hashes, window)

    return texts.mapInArrow(tidied(run), WINDOWS)


def _wide_cells(least: np.ndarray) -> np.ndarray:
    return mix(least + MIX[1]).view(np.int64)


def shared_cells(texts: DataFrame, window: int) -> DataFrame:
    """id, hash, cells: of each text the cells (of 2**64) that two documents' minimisers or more fall into."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in batches:
            for ids, part, hashes in slices(b, 1):
                flat, starts = flat_hashes(map(words_of, part), cache)
                _, owner, least = minimisers(flat, starts, window)
                if not len(least):
                    continue
                who, cells = np.unique(np.stack([owner, _wide_cells(least)]), axis=1)
                yield pa.record_batch([pa.array(np.array(ids, np.int64)[who]), pa.array(np.array(hashes, np.int64)[who]), pa.array(cells)], ["id", "hash", "cell"])

    cells = scratch.cut(texts.mapInArrow(tidied(run), "id long, hash long, cell long"), "minimisers")
    # written before the join, so that Spark may split a cell that very many documents hit
    often = scratch.cut(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("cell"), "cells")
    return cells.join(often, "cell", "left_semi").groupBy("id", "hash").agg(F.collect_set("cell").alias("cells"))


def windows_of_cells(texts: DataFrame, window: int) -> DataFrame:
    """What repeated_windows gives, by a sketch that stays a table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in batches:
            for ids, part, hashes, cells in slices(b, 1):
                flat, starts = flat_hashes(map(words_of, part), cache)
                at, owner, least = minimisers(flat, starts, window)
                keep = np.isin(_wide_cells(least), np.concatenate([np.array(c, np.int64) for c in cells]))
                if keep.any():
                    yield _window_rows(flat, starts, at[keep], owner[keep], ids, hashes, window)

    own = shared_cells(texts, window).select(F.col("id").alias("c_id"), F.col("hash").alias("c_hash"), "cells")
    held = texts.join(own, (F.col("id") == F.col("c_id")) & (F.col("h1") == F.col("c_hash"))).select("id", "text", "h1", "cells")
    return held.mapInArrow(tidied(run), WINDOWS)


def cover(words: list[bytes], at: list[int] | None, everything: bool, window: int) -> tuple[list[bytes], int]:
    """Kept words, and how many were removed."""
    if everything:
        return [], len(words)
    if not at:
        return words, 0
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    positions = np.array(at)
    np.add.at(edges, positions, 1)
    np.add.at(edges, positions + window, -1)
    keep = np.cumsum(edges[:-1]) == 0
    return [words[i] for i in np.flatnonzero(keep)], int(len(words) - keep.sum())


def _marked(docs: DataFrame, id_col: str, text_col: str, window: int, carried: list[Column]) -> DataFrame:
    """id, text, copy (of a text with a smaller id), at (where windows to remove begin) and the carried columns for every row of docs."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *carried)
    rows = rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text"), "n": F.coalesce(F.octet_length("text"), F.lit(0))})
    long_enough = rows.filter(f"id is not null and n >= {2 * window - 1}")  # a window has that many bytes
    keys = long_enough.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.sum("n").alias("n"))
    same = scratch.cut(keys.filter("first < last").select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), "first"), "copies")
    total = long_enough.agg(F.sum("n")).first()[0] or 0
    few = same.count() <= BROADCAST_IDS  # texts that occur more than once
    copies = F.broadcast(same) if few else same
    marked = long_enough.join(copies, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")), "left").withColumn("copy", F.coalesce(F.col("id") > F.col("first"), F.lit(False)))
    texts = marked.filter("not copy").select("id", "text", "h1")
    if sketch.fits(wanted := cells_wanted(total)):
        bits = sketch.bits_for(wanted)
        held = spark.sparkContext.broadcast(merged_sketch(texts.select("text"), bits, window))
        found = scratch.cut(repeated_windows(texts, held, bits, window), "windows")
        held.unpersist()
    else:
        found = scratch.cut(windows_of_cells(texts, window), "windows")
    # written before the join, so that Spark may split a window that very many documents hold
    firsts = scratch.cut(found.groupBy("w1", "w2").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
                         .select(F.col("w1").alias("f1"), F.col("w2").alias("f2"), "first"), "firsts")
    later = found.join(firsts, (F.col("w1") == F.col("f1")) & (F.col("w2") == F.col("f2")) & (F.col("id") > F.col("first")))
    marks = scratch.cut(later.groupBy("id", "text").agg(F.collect_list("at").alias("at")).select(F.col("id").alias("m_id"), F.col("text").alias("m_text"), "at"), "marks")

    whole = rows.join(copies, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")), "left").withColumn("copy", F.coalesce(F.col("id") > F.col("first"), F.lit(False)))
    names = [c for c in rows.columns if c not in ("id", "text", "h1", "h2", "n")]
    nothing = F.lit(None).cast("array<int>")
    on = (F.col("id") == F.col("m_id")) & (F.col("h1") == F.col("m_text"))
    if marks.count() <= BROADCAST_IDS:  # then only the texts that change are exchanged
        ids = F.broadcast(marks.select("m_id", "m_text"))
        some = whole.join(ids, on, "left_semi").join(marks, on).select("id", "text", "copy", "at", *names)
        rest = whole.join(ids, on, "left_anti").select("id", "text", "copy", nothing.alias("at"), *names)
        return some.unionByName(rest)
    return whole.join(marks, on, "left").select("id", "text", "copy", "at", *names)


RESULT = "doc_id long, n_words long, n_removed long, kept_text string"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text for every row of docs; kept_text has the kept words joined by one space.

    A word goes if a window that covers it also starts in a document with a smaller id; windows are those of the input.
    Words are runs of anything but ASCII white space. A null or short text has no window; rows with a null id are neither
    changed nor held against others; rows with one id count as one document. Further columns are dropped.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in parts(b, 1):
                done = []
                for text, whole, at in zip(*(part.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                    words = words_of(text)
                    kept, n = cover(words, at, whole and len(words) >= window, window)
                    done.append((len(words), n, b" ".join(kept).decode("utf-8", "surrogatepass")))
                yield pa.record_batch([part.column(0), *(pa.array(x, k) for x, k in zip(zip(*done, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_words", "n_removed", "kept_text"])

    return _marked(docs, id_col, text_col, window, []).mapInArrow(tidied(run), RESULT)


def rewrite(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with the repeated words taken out of the text; a text that loses none keeps its white space, and a row of
    which nothing is left goes. A column n_chars is set to the new text's length; other columns pass.

    Rows with a null id or a null or short text stay as they are; of rows that repeat id and text all stay; an empty table
    gives an empty one.
    """
    others = F.struct(*(docs[c] for c in docs.columns if c != text_col)).alias("row")
    marked = _marked(docs, id_col, text_col, window, [others])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in parts(b, 1):
                done = []
                for text, whole, at in zip(*(part.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                    words = words_of(text) if whole or at else ()  # else nothing goes
                    kept, n = cover(words, at, whole and len(words) >= window, window)
                    done.append((b" ".join(kept).decode("utf-8", "surrogatepass") if n else text, n > 0, not n or n < len(words)))
                text, changed, stays = zip(*done, strict=True)
                yield pa.record_batch([pa.array(text, pa.string()), pa.array(changed), part.column(4)], ["text", "changed", "row"]).filter(pa.array(stays))

    out = marked.mapInArrow(tidied(run), f"text string, changed boolean, row {marked.schema['row'].dataType.simpleString()}")
    new = {c: F.col("row")[c] for c in docs.columns if c != text_col} | {text_col: F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("changed"), F.length("text")).otherwise(F.col("row")["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*(new[c].alias(c) for c in docs.columns))
